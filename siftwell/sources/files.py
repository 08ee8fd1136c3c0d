"""Finding and reading the files of a source tree.

Discovery runs on the driver (git, or a walk); reading runs on the executors by
path, so the tree has to be on a file system that they share.
"""

from __future__ import annotations

import hashlib
import os
import re
import subprocess
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..functions.languages import language_of

# What an index leaves out unless its configuration says otherwise.
DEFAULT_EXCLUDES = [
    "**/node_modules/**",
    "**/dist/**",
    "**/build/**",
    "**/.git/**",
    "**/vendor/**",
    "**/__pycache__/**",
    "**/target/**",
    "**/.next/**",
    "**/coverage/**",
    "**/*.min.js",
    "**/*.min.css",
    "**/package-lock.json",
    "**/yarn.lock",
    "**/pnpm-lock.yaml",
]


@dataclass
class FileRules:
    include: list[str] = field(default_factory=lambda: ["**/*"])
    exclude: list[str] = field(default_factory=lambda: list(DEFAULT_EXCLUDES))
    extra_exclude: list[str] = field(default_factory=list)
    max_file_size: int = 1_000_000
    git_only: bool = True


def _braces(pattern: str) -> list[str]:
    found = re.search(r"\{([^{}]*,[^{}]*)\}", pattern)
    if not found:
        return [pattern]
    return [x for part in found.group(1).split(",") for x in _braces(pattern[: found.start()] + part + pattern[found.end() :])]


@lru_cache(maxsize=4096)
def _glob(pattern: str, dots: bool) -> re.Pattern:
    """A path glob: ** spans folders, * and ? stay in one; a leading dot is matched only if asked for or written."""
    hidden = "" if dots else r"(?!\.)"
    kinds = []
    for one in _braces(pattern):
        out, parts = [], one.split("/")
        for k, part in enumerate(parts):
            last = k == len(parts) - 1
            if part == "**":
                out.append(rf"(?:{hidden}(?!\.\.?(?:/|$))[^/]+(?:/|$))*" if last else rf"(?:{hidden}(?!\.\.?/)[^/]+/)*")
                continue
            text, i = "", 0
            while i < len(part):
                c = part[i]
                close = part.find("]", i + 2) if c == "[" else -1
                if c == "*":
                    text += "[^/]*"
                elif c == "?":
                    text += "[^/]"
                elif close > 0:
                    text += "[" + part[i + 1 : close].replace("\\", "\\\\").replace("!", "^", 1 if part[i + 1] == "!" else 0) + "]"
                    i = close
                else:
                    text += re.escape(c)
                i += 1
            lead = hidden if part[:1] in ("*", "?", "[") else ""
            out.append(lead + text + ("" if last else "/"))
        kinds.append("".join(out))
    return re.compile("(?:" + "|".join(kinds) + r")\Z")


def matches(path: str, rules: FileRules) -> bool:
    """Whether any include pattern (not for dot files) and no exclude pattern (also for those) matches a path."""
    if not any(_glob(p, False).match(path) for p in rules.include):
        return False
    return not any(_glob(p, True).match(path) for p in (*rules.exclude, *rules.extra_exclude))


def _git(root: str, *args: str) -> bytes | None:
    try:
        done = subprocess.run(["git", *args], cwd=root, capture_output=True, timeout=300)
    except (OSError, subprocess.TimeoutExpired):
        return None
    return done.stdout if done.returncode == 0 else None


def is_git_repo(root: str) -> bool:
    return _git(root, "rev-parse", "--git-dir") is not None


def tracked_files(root: str) -> list[str] | None:
    """Tracked files and untracked ones that aren't ignored, each once; None if git fails."""
    out = _git(root, "ls-files", "-z", "--cached", "--others", "--exclude-standard")
    return None if out is None else list(dict.fromkeys(x.decode("utf-8", "surrogateescape") for x in out.split(b"\0") if x))


def _walk(root: str) -> list[str]:
    found = []
    for folder, folders, names in os.walk(root):
        folders[:] = sorted(f for f in folders if not f.startswith("."))
        inner = os.path.relpath(folder, root).replace(os.sep, "/")
        found += [n if inner == "." else f"{inner}/{n}" for n in sorted(names) if not n.startswith(".")]
    return found


def scan_files(root: str, rules: FileRules | None = None) -> list[str]:
    """Paths, relative to root, of files to index: of a known language, matching the rules, of 1 to max_file_size bytes."""
    rules = rules or FileRules()
    listed = tracked_files(root) if rules.git_only and is_git_repo(root) else None
    kept = []
    for path in _walk(root) if listed is None else listed:
        path = path.replace("\\", "/")
        if language_of(path) is None or not matches(path, rules):
            continue
        try:
            size = os.stat(os.path.join(root, path)).st_size
        except OSError:
            continue
        if 0 < size <= rules.max_file_size:
            kept.append(path)
    return kept


def read_files(spark: SparkSession, root: str, paths: list[str], with_content: bool = True) -> DataFrame:
    """(filePath, language, content, fileHash, error) of files below root; error is set for those that can't be read."""
    tasks = max(1, min(len(paths) // 32 + 1, 4 * spark.sparkContext.defaultParallelism))
    listed = spark.createDataFrame([(p,) for p in paths], "filePath string").repartition(tasks)

    def read(batches):
        names = ["filePath", "language", "content", "fileHash", "error"]
        for batch in batches:
            out: dict = {n: [] for n in names}
            for path in batch.column(0).to_pylist():
                content = digest = problem = None
                try:
                    with open(os.path.join(root, path), "rb") as f:
                        data = f.read()
                    digest = hashlib.sha256(data).hexdigest()
                    content = data.decode("utf-8", "replace") if with_content else None
                except OSError as error:
                    problem = str(error)
                for n, v in zip(names, (path, (language_of(path) or ("unknown",))[0], content, digest, problem)):
                    out[n].append(v)
            yield pa.RecordBatch.from_pydict({n: pa.array(v, pa.string()) for n, v in out.items()})

    return listed.mapInArrow(read, "filePath string, language string, content string, fileHash string, error string")
