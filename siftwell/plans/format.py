"""Results as text, on the driver."""

from __future__ import annotations

from collections.abc import Iterable

LISTED = 10


def _fenced(language: str, text: str) -> list[str]:
    return [f"```{language}", text, "```", ""]


def code_results(rows: Iterable) -> str:
    rows = list(rows)
    if not rows:
        return "No matching code found."
    out = [f"Found {len(rows)} result(s):\n"]
    for i, r in enumerate(rows, 1):
        out += [f"--- Result {i} (score: {r['score']:.3f}) ---", f"File: {r['filePath']}:{r['startLine']}-{r['endLine']}"]
        out += [f"Symbol: {r['symbolType']} {r['symbolName']}"] if r["symbolName"] else []
        out += [f"Language: {r['language']}", *_fenced(r["language"], r["content"])]
    return "\n".join(out)


def file_results(rows: Iterable) -> str:
    rows = list(rows)
    if not rows:
        return "No matching files found."
    out = [f"Found {len(rows)} file(s):\n"]
    for i, r in enumerate(rows, 1):
        out += [f"{i}. **{r['filePath']}** (score: {r['score']:.3f})", f"   Language: {r['language']} | Chunks: {r['chunkCount']} | Symbols: {r['symbolCount']}"]
    return "\n".join(out)


def symbol_results(rows: Iterable) -> str:
    rows = list(rows)
    if not rows:
        return "No matching symbols found."
    out = [f"Found {len(rows)} symbol(s):\n"]
    for r in rows:
        lines = r["content"].split("\n")
        shown = "\n".join([*lines[:5], *(["  // ..."] if len(lines) > 5 else [])])
        out += [f'--- {r["symbolType"]} "{r["symbolName"]}" (score: {r["score"]:.3f}) ---', f"File: {r['filePath']}:{r['startLine']}-{r['endLine']}"]
        out += [f"Language: {r['language']}", *_fenced(r["language"], shown)]
    return "\n".join(out)


def skipped_files(skipped: list[tuple[str, str]]) -> list[str]:
    """Lines that name the files a run skipped, ten at most; none without such files."""
    if not skipped:
        return []
    out = ["", f"Skipped files ({len(skipped)}):", *(f"  {path}: {why}" for path, why in skipped[:LISTED])]
    return [*out, f"  … and {len(skipped) - LISTED} more (see server log)"] if len(skipped) > LISTED else out


def age(minutes: int) -> str:
    return f"{minutes}m ago" if minutes < 60 else f"{minutes // 60}h ago" if minutes < 1440 else f"{minutes // 1440}d ago"
