"""Splitting files into chunks: by lines in SQL, by symbols in Arrow batches."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.languages import language_of
from .symbols import symbols_of

MAX_LINES, OVERLAP = 100, 10
CHUNK_COLUMNS = "id string, filePath string, startLine int, endLine int, content string, symbolName string, symbolType string, language string, parentSymbol string, summary string"


def line_windows(first: int, last: int, max_lines: int = MAX_LINES, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """Windows of at most max_lines over first..last; each begins max_lines - overlap (at least 1) after the one before."""
    step = max(1, max_lines - overlap)
    count = max(0, -(-(last - first + 1 - max_lines) // step)) + 1
    return [(s, min(s + max_lines - 1, last)) for s in range(first, first + count * step, step)]


def window_starts(n_lines: Column, max_lines: int = MAX_LINES, overlap: int = OVERLAP) -> Column:
    """The first lines of the windows over 1..n_lines, as an array."""
    step = max(1, max_lines - overlap)
    more = F.greatest(F.lit(0), F.ceil((n_lines - max_lines) / step)).cast("int")
    return F.transform(F.sequence(F.lit(0), more), lambda k: k * step + 1)


def _trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+\z", "")


def line_chunks(files: DataFrame, max_lines: int = MAX_LINES, overlap: int = OVERLAP) -> DataFrame:
    """The chunks (CHUNK_COLUMNS) of files (filePath, language, content), and their other columns.

    Lines end at \\n only; a last \\n gives an empty last line; a file has one
    chunk at least. Symbol columns are empty strings.
    """
    cut = files.withColumn("_lines", F.split(F.coalesce("content", F.lit("")), "\n", -1)).drop("content")
    cut = cut.withColumn("_n", F.size("_lines")).withColumn("startLine", F.explode(window_starts(F.col("_n"), max_lines, overlap)))
    cut = cut.withColumn("endLine", F.least(F.col("startLine") + max_lines - 1, F.col("_n")))
    return _described(cut.withColumn("_part", F.slice("_lines", F.col("startLine"), F.col("endLine") - F.col("startLine") + 1)).drop("_lines", "_n"))


def _described(cut: DataFrame) -> DataFrame:
    """Line chunks from rows with filePath, language, startLine, endLine and their lines as the array _part."""
    where = lambda *x: F.concat(*(F.lit(y) if isinstance(y, str) else y.cast("string") for y in x))
    lead = F.substring(F.array_join(F.slice(F.filter("_part", lambda x: _trimmed(x) != ""), 1, 5), " "), 1, 200)
    path, a, b = F.col("filePath"), F.col("startLine"), F.col("endLine")
    empty = F.lit("")
    return (
        cut.withColumn("id", F.sha2(where(path, ":", a, ":", b), 256))
        .withColumn("content", F.array_join("_part", "\n"))
        .withColumn("summary", where(F.col("language"), " code in ", path, " (lines ", a, "-", b, "): ", lead))
        .withColumns({"symbolName": empty, "symbolType": empty, "parentSymbol": empty})
        .drop("_part")
    )


def uncovered_lines(covered: DataFrame, lengths: DataFrame) -> DataFrame:
    """(filePath, first, last): the maximal runs of lines that no interval of covered (filePath, startLine, endLine) holds, in files of lengths (filePath, n).

    Gaps and islands over the intervals themselves: no line is a row. Intervals may overlap; a file has one row in lengths.
    """
    ends = lengths.select("filePath", (F.col("n") + 1).alias("startLine"), (F.col("n") + 1).alias("endLine"))
    rows = covered.select("filePath", F.col("startLine").cast("int"), F.col("endLine").cast("int")).unionByName(ends)
    before = W.partitionBy("filePath").orderBy("startLine", "endLine").rowsBetween(W.unboundedPreceding, -1)
    first = F.coalesce(F.max("endLine").over(before), F.lit(0)) + 1
    return rows.withColumn("first", first).where(F.col("startLine") > F.col("first")).select("filePath", "first", (F.col("startLine") - 1).alias("last"))


def gap_chunks(files: DataFrame, covered: DataFrame, max_lines: int = MAX_LINES, overlap: int = OVERLAP) -> DataFrame:
    """The line chunks (CHUNK_COLUMNS, and other columns of files) over what covered (filePath, startLine, endLine) leaves of files (filePath, language, content).

    Each run that nothing covers is cut into windows from its first to its last line that isn't blank; blank runs give
    nothing. With the symbols' chunks as covered, these are the chunks that chunk_text adds to them. Paths are distinct.
    """
    cut = files.withColumn("_lines", F.split(F.coalesce("content", F.lit("")), "\n", -1)).drop("content")
    runs = uncovered_lines(covered, cut.select("filePath", F.size("_lines").alias("n")))
    cut = cut.join(runs, "filePath").withColumn("_run", F.slice("_lines", F.col("first"), F.col("last") - F.col("first") + 1)).drop("_lines")
    said = F.transform("_run", lambda x: _trimmed(x) != "")
    cut = cut.withColumn("_skip", F.array_position(said, True).cast("int") - 1).where("_skip >= 0")
    cut = cut.withColumn("_n", F.size("_run") - F.array_position(F.reverse(said), True).cast("int") + 1 - F.col("_skip"))
    cut = cut.withColumn("_at", F.explode(window_starts(F.col("_n"), max_lines, overlap)))
    size = F.least(F.lit(max_lines), F.col("_n") - F.col("_at") + 1)
    cut = cut.withColumn("startLine", F.col("first") + F.col("_skip") + F.col("_at") - 1).withColumn("endLine", F.col("startLine") + size - 1)
    return _described(cut.withColumn("_part", F.slice("_run", F.col("_skip") + F.col("_at"), size)).drop("_run", "_skip", "_n", "_at", "first", "last"))


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "replace")).hexdigest()


def chunk_text(path: str, content: str, language: str, max_lines: int = MAX_LINES, overlap: int = OVERLAP) -> list[dict]:
    """The chunks of one file: its symbols, and line windows over what they leave; line windows alone without symbols."""
    lines = content.split("\n")

    def by_lines(first: int, last: int) -> list[dict]:
        out = []
        for a, b in line_windows(first, last, max_lines, overlap):
            part = lines[a - 1 : b]
            lead = " ".join([x for x in part if x.strip()][:5])[:200]
            out.append(_chunk(_sha(f"{path}:{a}:{b}"), a, b, part, "", "", "", f"{language} code in {path} (lines {a}-{b}): {lead}"))
        return out

    def _chunk(id_: str, a: int, b: int, part: list[str], name: str, kind: str, parent: str, summary: str) -> dict:
        return {"id": id_, "filePath": path, "startLine": a, "endLine": b, "content": "\n".join(part), "symbolName": name, "symbolType": kind, "language": language, "parentSymbol": parent, "summary": summary}

    def of_symbol(kind: str, name: str, parent: str, a: int, b: int) -> dict:
        part = lines[a - 1 : b]
        lead = next((x.strip()[:150] for x in part if x.strip()), "")
        words = [f"{language} {kind}", *([f'"{name}"'] if name else []), f"in {path} (lines {a}-{b})", *([f"- {lead}"] if lead else [])]
        return _chunk(_sha(f"{path}:{a}:{b}:{kind}:{name}"), a, b, part, name, kind, parent, " ".join(words))

    grammar = (language_of(path) or (None, None))[1]
    found = symbols_of(content, grammar) if grammar else None
    if not found:
        return by_lines(1, len(lines))
    chunks: list[dict] = []
    covered = bytearray(len(lines) + 2)

    def emit(symbols) -> None:
        for s in symbols:
            size = s.last - s.first + 1
            if size <= max_lines:
                parts = [(s.first, s.last)]
            elif s.container:  # its head; the rest is covered by members and gaps
                parts = [(s.first, min(s.first + 5, s.last))]
            else:
                parts = line_windows(s.first, s.last, max_lines, overlap)
            for a, b in parts:
                chunks.append(of_symbol(s.kind, s.name, s.parent, a, b))
                covered[a : b + 1] = b"\1" * (b - a + 1)
            if s.container:
                emit(s.members)

    emit(found)
    gaps: list[dict] = []
    at = 1
    while at <= len(lines):
        if covered[at] or not lines[at - 1].strip():
            at += 1
            continue
        to = covered.find(1, at)
        to = len(lines) if to < 0 else min(len(lines), to - 1)
        while not lines[to - 1].strip():
            to -= 1
        gaps += by_lines(at, to)
        at = to + 1
    return sorted(chunks + gaps, key=lambda c: c["startLine"])


def symbol_chunks(files: DataFrame, max_lines: int = MAX_LINES, overlap: int = OVERLAP) -> DataFrame:
    """The chunks (CHUNK_COLUMNS, fileHash) of files (filePath, language, content, fileHash), and the column error.

    A file that can't be chunked, or that comes with an error of its own, gives one row with its path
    and the reason in error, and doesn't stop the others. Files keep to their tasks: no shuffle.
    """

    def run(batches):
        names = [*(c.split()[0] for c in CHUNK_COLUMNS.split(", ")), "fileHash", "error"]
        for batch in batches:
            out: dict = {n: [] for n in names}
            for row in batch.to_pylist():
                try:
                    if row.get("error"):
                        raise OSError(row["error"])
                    rows = chunk_text(row["filePath"], row["content"] or "", row["language"] or "unknown", max_lines, overlap)
                    problem = None
                except Exception as error:  # one file says nothing about the others
                    rows, problem = [{"filePath": row["filePath"]}], row.get("error") or f"{type(error).__name__}: {error}"
                for chunk in rows:
                    for n in names:
                        out[n].append(problem if n == "error" else row["fileHash"] if n == "fileHash" else chunk.get(n))
            yield pa.RecordBatch.from_pydict({n: pa.array(v, pa.int32() if n in ("startLine", "endLine") else pa.string()) for n, v in out.items()})

    given = [c for c in ("filePath", "language", "content", "fileHash", "error") if c in files.columns]
    return files.select(*given).mapInArrow(run, f"{CHUNK_COLUMNS}, fileHash string, error string")
