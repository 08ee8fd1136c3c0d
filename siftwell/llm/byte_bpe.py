"""Token ids of many texts at once by a byte-level BPE vocabulary.

A batch of texts is split into pre-tokens by array operations over its code
points, equal pre-tokens are found by Arrow's dictionary encoding, and only
different ones are encoded. The ids are those of the ``tokenizers`` library for
the same file without added special tokens.
"""

from __future__ import annotations

import json
import unicodedata

import numpy as np
import pyarrow as pa
import tiktoken

#: The pattern of the vocabulary's pre-tokens, which Splitter follows, and the code points of \s.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
WHITE = [*range(9, 14), 32, 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288]
SPACE, LETTER, NUMBER, OTHER = range(4)
REMEMBERED = 1 << 19
#: Characters of texts that are split at once; longer texts are cut where a word begins.
CHARS = 1 << 22


def _classes() -> np.ndarray:
    """The class of every code point."""
    first = [unicodedata.category(chr(c))[0] for c in range(0x110000)]
    out = np.full(len(first), OTHER, np.uint8)
    names = np.array(first)
    out[names == "L"], out[names == "N"] = LETTER, NUMBER
    out[WHITE] = SPACE
    return out


def pretoken_starts(points: np.ndarray, firsts: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Where pre-tokens begin in texts that stand one after the other; firsts: where the texts begin, none empty."""
    n = len(points)
    kind = classes[points]
    text_start = np.zeros(n + 1, bool)
    text_start[firsts] = True
    text_start[n] = True
    start = text_start[:n].copy()
    start[1:] |= kind[1:] != kind[:-1]
    # Of white space before something else, the last is apart; a blank goes to what follows it.
    last = np.flatnonzero((kind[:-1] == SPACE) & (kind[1:] != SPACE) & ~text_start[1:n])
    start[last] = True
    blank = last[points[last] == 32]
    start[blank + 1] = False
    # An apostrophe alone, at which a pre-token begins, takes an ending with it; the rest of the letters begins anew.
    mark = np.flatnonzero((points[:-1] == 39) & start[:-1] & (kind[1:] == LETTER) & ~text_start[1:n])
    if len(mark):
        one = points[mark + 1]
        there = ~text_start[np.minimum(mark + 2, n)]
        two = np.where(there, points[np.minimum(mark + 2, n - 1)], 0)
        single = np.isin(one, [115, 100, 109, 116])  # s d m t
        double = ((one == 108) & (two == 108)) | ((one == 118) & (two == 101)) | ((one == 114) & (two == 101))  # ll ve re
        for chosen, size in ((mark[single], 2), (mark[double & ~single], 3)):
            start[chosen + 1] = False
            ends = chosen + size
            start[ends[ends < n]] = True
    return np.flatnonzero(start)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places starts[i] .. starts[i] + lengths[i] - 1 of all i, one after the other."""
    ends = np.cumsum(lengths)
    out = np.ones(int(ends[-1]) if len(ends) else 0, np.int64)
    if len(out):
        full = lengths > 0
        starts, lengths, at = starts[full], lengths[full], (ends - lengths)[full]
        out[at[0]] = starts[0]
        out[at[1:]] = starts[1:] - (starts[:-1] + lengths[:-1] - 1)
        np.cumsum(out, out=out)
    return out


class ByteBPE:
    """ids(texts): the tokens of each text. ``path``: a vocabulary file of the tokenizers library with a byte-level BPE model."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            found = json.load(file)
        self.special = {t["content"]: t["id"] for t in found["added_tokens"]}
        # Bytes that print stand for themselves in the file's tokens, the others for code points from 256 on.
        printed = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in set(printed)]
        byte = {chr(b): b for b in printed} | {chr(256 + i): b for i, b in enumerate(rest)}
        ranks = {bytes(byte[c] for c in token): i for token, i in found["model"]["vocab"].items() if token not in self.special}
        self.encoding = tiktoken.Encoding("pieces", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.classes = _classes()
        #: Ids of pre-tokens as the bytes of unsigned 32-bit numbers.
        self.known: dict[bytes, bytes] = {}

    def _of_pieces(self, pieces: list[bytes]) -> list[bytes]:
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        out = list(map(known.get, pieces))
        for i in [i for i, ids in enumerate(out) if ids is None]:
            p = pieces[i]
            out[i] = ids = np.array(self.encoding._encode_single_piece(p), np.uint32).tobytes()
            if len(p) <= 64:
                known[p] = ids
        return out

    def _batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of texts, none empty, and their number for each."""
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        whole = "".join(texts)
        points = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        firsts = np.cumsum(sizes) - sizes
        starts = pretoken_starts(points, firsts, self.classes)
        data = whole.encode()
        offsets = np.append(starts, len(data))
        for least in (0x80, 0x800, 0x10000):  # a byte more for each code point from there on
            wide = np.flatnonzero(points >= least)
            offsets[:-1] += np.searchsorted(wide, starts)
        tokens = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
        codes = tokens.indices.to_numpy()
        of_piece = self._of_pieces(tokens.dictionary.to_pylist())
        lengths = np.fromiter(map(len, of_piece), np.int64, len(of_piece)) // 4
        flat = np.frombuffer(b"".join(of_piece), np.uint32)
        at = np.cumsum(lengths) - lengths
        out = flat[ragged(at[codes], lengths[codes])]
        first_token = np.searchsorted(starts, firsts)
        return out, np.add.reduceat(lengths[codes], first_token)

    def _segments(self, text: str) -> list:
        """Parts of a text that are split apart, and ids of special tokens between them; long parts in pieces."""
        parts: list = [text]
        for content, i in self.special.items():
            if content in text:
                parts = [x for part in parts for x in ([part] if isinstance(part, int) else [y for s in part.split(content) for y in (i, s)][1:])]
        out: list = []
        for part in parts:
            if isinstance(part, int):
                out.append(part)
                continue
            at = 0
            while at < len(part):
                to = at + CHARS if at + CHARS < len(part) else len(part)
                while to < len(part) and not (part[to] == " " and part[to - 1].isalpha() and part[to + 1 : to + 2].isalpha()):
                    to += 1
                out.append(part[at:to])
                at = to
        return out

    def ids(self, texts: list[str]):
        """(index, ids) for each text in order; long batches are worked off in groups of about CHARS characters."""
        group: list = []
        size = 0
        for i, text in enumerate(texts):
            parts = self._segments(text) if len(text) > CHARS or any(s in text for s in self.special) else [text] if text else []
            if size and size + len(text) > CHARS:
                yield from self._group(group)
                group, size = [], 0
            group.append((i, parts))
            size += len(text)
        yield from self._group(group)

    def _group(self, group: list):
        flat = [p for _, parts in group for p in parts if isinstance(p, str)]
        found: list = []
        at = 0
        while at < len(flat):  # a long text's pieces are more than one batch
            to, size = at, 0
            while to < len(flat) and (to == at or size + len(flat[to]) <= 2 * CHARS):
                size += len(flat[to])
                to += 1
            ids, counts = self._batch(flat[at:to])
            found += np.split(ids, np.cumsum(counts)[:-1])
            at = to
        of_part = iter(found)
        for i, parts in group:
            mine = [np.array([p], np.uint32) if isinstance(p, int) else next(of_part) for p in parts]
            yield i, mine[0] if len(mine) == 1 else np.concatenate(mine) if mine else np.zeros(0, np.uint32)
