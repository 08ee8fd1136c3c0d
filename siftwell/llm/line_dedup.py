"""Line dedup: an exact set-similarity join of lines (prefix, positional and length filters).

A line is the set of its words. Lines with equal sets form a class; a join finds
the pairs of classes with a Jaccard similarity of at least ``similarity``.

1. One pass counts words in a table of fixed size by hash; the counts, in steps
   of a logarithm, order a line's words by rarity. Similar sets share a word of
   their prefixes: of a set of n words, the n - ceil(t n) + 1 rarest.
2. The next pass posts each set under its prefix words, but not under those that
   occur once in all lines. Postings travel packed, sorted by word, a row for
   each receiver. A receiver joins the postings of a word: lengths, the word's
   positions and bitmaps of the sets bound the overlap, and a pair whose two rarest
   words that others have too show that it meets earlier is left to that place.
   A posting survives if a partner may be similar.
3. The survivors meet again with their whole sets and are compared exactly. A
   pair counts where its first common word is. Only counts leave a task: the
   pairs of a dense group are never written.

A word that more than ``part`` prefixes hold is not joined but split by a second
word: similar sets share l words of their n - ceil(t n) + l rarest, so the sets
meet again under each two words, and where these are as frequent under three and
four. Texts are read again for it, but only the lines concerned are posted. Sets
that share even so many words are dealt to tasks in blocks, each pair of blocks to one.
"""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LIST_BYTES, byte_chunks, listed, narrow_batches, packed, partitions, small, table, to_arrow, unpacked, unused, with_hash, written
from .quality import _powers

SIMILARITY = "4/5"
BITS = 24
SLOTS = 64
#: Classes that share a prefix word, or the first words of a chain, and are joined in one task.
PART = 1 << 15
#: Words that are sent to all tasks at once because more than PART classes share them; of more, texts are read again for each so many.
HOT_WORDS = 1 << 18
#: Postings that a receiver holds at once, about, and those that a sender gathers.
HELD = GATHERED = 1 << 19
#: Bitmaps have 64 bits for sets of up to so many words, and twice as many for each of these bounds that a set exceeds.
BOUNDS = (60, 120, 240)
WIDEST = 1 << len(BOUNDS)
#: Survivors of one group that are compared in one task; larger groups are dealt out in blocks.
DEALT = 2048
#: Sets up to which a group is compared pair by pair; larger groups are compared by matrix products.
FEW = 48
#: Pairs that are looked at together.
BLOCK = 1 << 19

_MIX1, _MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_SPACES = np.zeros(256, bool)
_SPACES[[9, 10, 11, 12, 13, 32]] = True
_VALUE = np.arange(1, 257, dtype=np.uint64)
_VALUE[65:91] += np.uint64(32)


def _mixed(words: np.ndarray, by: np.uint64) -> np.ndarray:
    with np.errstate(over="ignore"):
        words = (words ^ words >> np.uint64(32)) * by
        return words ^ words >> np.uint64(29)


def _by_line(line: np.ndarray, words: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Order by line, rank and word: by one number that ends with the place, and by all three only if that can't tell words apart."""
    if len(line) and len(line) <= 1 << 16 and line[-1] < 1 << 12:
        key = line.astype(np.uint64) << np.uint64(52) | rank.astype(np.uint64) << np.uint64(44) | words >> np.uint64(36) << np.uint64(16)
        key |= np.arange(len(line), dtype=np.uint64)
        key.sort()
        order = (key & np.uint64(0xFFFF)).astype(np.int64)
        key >>= np.uint64(16)
        sorted_ = words[order]
        if not ((key[1:] == key[:-1]) & (sorted_[1:] != sorted_[:-1])).any():
            return order
    return np.lexsort((words, rank, line))


def _class_sums(line: np.ndarray, word: np.ndarray, rows: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Number of words of each line, and two sums of hashes that stand for its set."""
    n = np.bincount(line, minlength=rows)
    ends = np.cumsum(n)
    sums = []
    with np.errstate(over="ignore"):
        for by in (_MIX1, _MIX2):
            total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_mixed(word, by))))
            sums.append((total[ends] - total[ends - n]).view(np.int64))
    return n, sums


class Lines:
    """The words of the lines of texts that lie end to end."""

    def __init__(self) -> None:
        self.up, self.down = _powers(1 << 19)

    def words(self, ends: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where words begin, and their hashes, repeats included."""
        n = len(data)
        if n >= len(self.up):
            self.up, self.down = _powers(2 * n)
        solid = np.zeros(n + 2, bool)
        np.logical_not(_SPACES[data], out=solid[1:-1])
        cut = np.zeros(n + 1, bool)
        cut[ends] = True
        starts = np.flatnonzero(solid[1:] & (~solid[:-1] | cut))
        stops = np.flatnonzero(solid[:-1] & (~solid[1:] | cut))
        if not len(starts):
            return starts, np.zeros(0, np.uint64)
        with np.errstate(over="ignore"):
            sums = np.zeros(n + 1, np.uint64)
            np.cumsum(_VALUE[data] * self.up[:n], out=sums[1:])
            return starts, _mixed((sums[stops] - sums[starts]) * self.down[starts], _MIX1)

    def of(self, ends: np.ndarray, data: np.ndarray, ranks: np.ndarray):
        """row, number: a line's text and its number in it; line, word: the line and the hash of each of
        its distinct words, a line's words together, the rarest first."""
        starts, words = self.words(ends, data)
        feeds = np.flatnonzero(data == 10)
        lines_of = np.diff(np.searchsorted(feeds, ends)) + 1
        row = np.repeat(np.arange(len(ends) - 1), lines_of)
        number = np.arange(len(row)) - (np.cumsum(lines_of) - lines_of)[row]
        # An empty last line begins where the next text does; the words there are the later line's.
        begins = np.sort(np.concatenate((ends[:-1], feeds + 1)))
        line = np.repeat(np.arange(len(begins)), np.diff(np.append(np.searchsorted(starts, begins), len(starts))))
        order = _by_line(line, words, ranks[_place(words)])
        line, words = line[order], words[order]
        new = np.concatenate(([True], (line[1:] != line[:-1]) | (words[1:] != words[:-1])))[: len(words)]
        return row, number, line[new], words[new]


def _place(words: np.ndarray) -> np.ndarray:
    return (words >> np.uint64(64 - BITS)).astype(np.int64)


def _counted(batches):
    """(slot, blob) for the words of a task's texts, counted by the leading bits of their hash."""
    lines, counts = Lines(), np.zeros(1 << BITS, np.uint32)
    for batch in narrow_batches(batches):
        for _, ends, data in byte_chunks(batch.column(0)):
            np.add.at(counts, _place(lines.words(ends, data)[1]), np.uint32(1))
    for slot, part in enumerate(counts.reshape(SLOTS, -1)):
        places = np.flatnonzero(part).astype(np.uint32)
        if len(places):
            steps = np.diff(places, prepend=np.uint32(0))
            blob = zstandard.compress(np.stack((steps, part[places])).tobytes(), 1)
            yield pa.RecordBatch.from_arrays([pa.array([slot], pa.int32()), pa.array([blob], pa.binary())], ["slot", "blob"])


def _count_codes(texts: DataFrame) -> np.ndarray:
    """A byte for each place of the table: 0 for none, else 1 + 8 times the count's logarithm to base 2.

    texts: (text). Each slot is summed in one task, from blobs of bounded
    size; the driver gets 2^24 bytes, however large the data.
    """

    def add(batches):
        total: dict = {}
        for batch in batches:
            for s, blob in zip(batch["slot"].to_pylist(), batch["blob"].to_pylist()):
                steps, counts = np.frombuffer(zstandard.decompress(blob), np.uint32).reshape(2, -1)
                if s not in total:
                    total[s] = np.zeros(1 << (BITS - 6), np.int64)
                total[s][np.cumsum(steps)] += counts
        codes = [np.where(v > 0, np.minimum(255, 1 + np.floor(8 * np.log2(np.maximum(v, 1)))), 0).astype(np.uint8).tobytes() for v in total.values()]
        yield pa.RecordBatch.from_pydict({"slot": list(total), "blob": codes}, schema=pa.schema([("slot", pa.int32()), ("blob", pa.binary())]))

    out = np.zeros((SLOTS, 1 << (BITS - 6)), np.uint8)
    slots = texts.mapInArrow(_counted, "slot int, blob binary")
    for slot, blob in slots.repartition(SLOTS, "slot").mapInArrow(add, "slot int, blob binary").collect():
        out[slot] = np.frombuffer(bytes(blob), np.uint8)
    return out.ravel()


def prefix_length(n, t: Fraction):
    """n - ceil(t n) + 1, for integers or arrays."""
    return n - (t.numerator * n + t.denominator - 1) // t.denominator + 1


def least_overlap(total, t: Fraction):
    """The overlap that two sets of ``total`` words together need: ceil(t / (1 + t) total)."""
    share = t / (1 + t)
    return (share.numerator * total + share.denominator - 1) // share.denominator


def least_size(t: Fraction) -> int:
    """The fewest words that two different sets can share if they are similar."""
    return math.ceil(t / (1 - t))


def _window_pairs(group: np.ndarray, size: np.ndarray, t: Fraction):
    """Index pairs i < j of rows of one group whose sizes allow similarity, in blocks. Rows are in order of group and size."""
    high = group.astype(np.int64) << 40
    last = np.searchsorted(high | size, high | size * t.denominator // t.numerator, side="right")
    count = last - np.arange(len(group)) - 1
    total = np.cumsum(count)
    at = 0
    while at < len(group):
        done = int(total[at - 1]) if at else 0
        to = max(at + 1, int(np.searchsorted(total, done + BLOCK, side="right")))
        if int(total[to - 1]) > done:
            i = np.repeat(np.arange(at, to), count[at:to])
            yield i, i + 1 + np.arange(len(i)) - np.repeat(total[at:to] - count[at:to] - done, count[at:to])
        at = to


def _planes(numbers: np.ndarray) -> bytes:
    """Sorted numbers as the bytes of their steps, all first bytes before all second ones: what compresses well."""
    with np.errstate(over="ignore"):
        return np.diff(numbers, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T.tobytes()


def _from_planes(blob: bytes) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumsum(np.ascontiguousarray(np.frombuffer(blob, np.uint8).reshape(8, -1).T).view(np.uint64).ravel(), dtype=np.uint64)


#: What is posted under a word: the class, its number of words, the word's place among them, two rarer
#: words (0 for none), the set's bitmap, and the last word of a chain. A posting of size 0 says that its word has too many.
_POSTING = {"token": np.uint64, "c1": np.int64, "size": np.uint32, "pos": np.uint32, "e0": np.uint64, "e1": np.uint64, "word": np.uint64} | {f"b{k}": np.uint64 for k in range(WIDEST)}


def _width(size: np.ndarray) -> np.ndarray:
    """64-bit words in the bitmap of a set."""
    return 1 << sum((size > b).astype(np.int64) for b in BOUNDS)


def _bitmaps(word: np.ndarray, n: np.ndarray, begin: np.ndarray) -> list[np.ndarray]:
    """Of each line WIDEST arrays, of which the width of its set is in use."""
    bit = _mixed(word, _MIX2)
    which = np.uint64(1) << (bit >> np.uint64(58))
    some = np.flatnonzero(n)
    width = _width(n)
    part = (bit >> np.uint64(8)).astype(np.int64) & np.repeat(width - 1, n)
    out = []
    for k in range(WIDEST):
        rows = some[width[some] > k]
        bits = np.zeros(len(n), np.uint64)
        if len(rows):
            bits[some] = np.bitwise_or.reduceat(np.where(part == k, which, np.uint64(0)), begin[some])
        out.append(bits)
    return out


def _pack(posts: dict[str, np.ndarray], level: int) -> bytes:
    """Postings in order of token; of bitmaps what is in use, the word only for chains."""
    width = _width(posts["size"])
    fields = [posts[c].tobytes() for c in ("c1", "size", "pos", "e0", "e1")] + [posts[f"b{k}"][width > k].tobytes() for k in range(WIDEST)]
    if level > 1:
        fields.append(posts["word"].tobytes())
    return zstandard.compress(np.array([len(width)], np.int64).tobytes() + _planes(posts["token"]) + b"".join(fields), 1)


def _unpack(blob: bytes, level: int) -> dict[str, np.ndarray]:
    data = zstandard.decompress(blob)
    n = int(np.frombuffer(data, np.int64, 1)[0])
    at = 8 + 8 * n
    out = {"token": _from_planes(data[8:at])}
    for c in ("c1", "size", "pos", "e0", "e1"):
        out[c] = np.frombuffer(data, _POSTING[c], n, at)
        at += out[c].nbytes
    width = _width(out["size"])
    for k in range(WIDEST):
        used = width > k
        out[f"b{k}"] = np.zeros(n, np.uint64)
        out[f"b{k}"][used] = np.frombuffer(data, np.uint64, m := int(used.sum()), at)
        at += 8 * m
    out["word"] = np.frombuffer(data, np.uint64, n, at) if level > 1 else out["token"]
    return out


def _taken(posts: dict, rows) -> dict:
    return {c: v[rows] for c, v in posts.items()}


def _joined(parts: list[dict]) -> dict:
    return {c: np.concatenate([p[c] for p in parts]) for c in _POSTING}


def _tidied(posts: dict, part: float) -> tuple[dict, np.ndarray, np.ndarray]:
    """Postings in order of token and size, each class once; and the tokens that more than part classes have, whose postings go, and how many."""
    order = np.lexsort((posts["c1"], posts["size"], posts["token"]))
    token, c1 = posts["token"][order], posts["c1"][order]
    new = np.concatenate(([True], (token[1:] != token[:-1]) | (c1[1:] != c1[:-1])))[: len(token)]
    order = order[new]
    token, edge = token[new], np.flatnonzero(np.concatenate(([True], token[new][1:] != token[new][:-1])))[: len(token)]
    runs = np.diff(np.append(edge, len(token)))
    if not len(edge):
        return _taken(posts, order), token, np.zeros(0, np.int64)
    marked = posts["size"][order] == 0
    number = np.add.reduceat(np.where(marked, posts["c1"][order], 1), edge)
    hot = (runs > part) | marked[edge]
    return _taken(posts, order[~np.repeat(hot, runs)]), token[edge[hot]], number[hot]


def _marks(tokens: np.ndarray, number: np.ndarray) -> dict:
    return {c: {"token": tokens, "word": tokens, "c1": number}.get(c, np.zeros(len(tokens), kind)) for c, kind in _POSTING.items()}


def _may_be_similar(posts: dict, t: Fraction, early: bool) -> np.ndarray:
    """Which postings have a partner under their token that the filters don't rule out and, if ``early``, that meets them nowhere earlier."""
    token, size, pos = posts["token"], posts["size"].astype(np.int64), posts["pos"].astype(np.int64)
    group = np.cumsum(np.concatenate(([0], token[1:] != token[:-1])))[: len(token)] if len(token) else np.zeros(0, np.int64)
    width = _width(size)
    bits = [posts[f"b{k}"] for k in range(WIDEST)]
    folded = np.bitwise_or.reduce(bits)
    survive = np.zeros(len(token), bool)
    for i, j in _window_pairs(group, size, t):
        total = size[i] + size[j]
        need = least_overlap(total, t)
        # A pair shares at most what comes before the word in both, and the word with what comes after it.
        keep = np.minimum(pos[i], pos[j]) + np.minimum(size[i] - pos[i], size[j] - pos[j]) >= need
        keep &= np.bitwise_count(folded[i] ^ folded[j]) <= total - 2 * need
        keep = np.flatnonzero(keep)
        i, j, room = i[keep], j[keep], (total - 2 * need)[keep]
        # A wider bitmap folds to a narrower one: place k of it is place k modulo the other's width.
        keep = np.ones(len(i), bool)
        for w in (2 ** np.arange(1, len(BOUNDS) + 1)).tolist():
            rows = np.flatnonzero(np.minimum(width[i], width[j]) == w)
            if len(rows):
                a, b, differ = i[rows], j[rows], np.zeros(len(rows), np.int64)
                for k in range(w):
                    differ += np.bitwise_count(np.bitwise_or.reduce([x[a] for x in bits[k::w]]) ^ np.bitwise_or.reduce([x[b] for x in bits[k::w]]))
                keep[rows] = differ <= room[rows]
        if early:
            for a in ("e0", "e1"):
                for b in ("e0", "e1"):
                    keep &= (posts[a][i] != posts[b][j]) | (posts[a][i] == 0)
        survive[i[keep]] = True
        survive[j[keep]] = True
    return survive

def _described(batch: pa.RecordBatch, found: Lines, ranks: np.ndarray, t: Fraction):
    """For each chunk of a batch (doc_id, th, text): at, row, number, line, word, n, sums and where each line's words begin."""
    for at, ends, data in byte_chunks(batch.column(2)):
        row, number, line, word = found.of(ends, data, ranks)
        n, sums = _class_sums(line, word, len(row))
        yield at, row, number, line, word, n, sums, np.cumsum(n) - n


class _Poster:
    """Gathers a task's postings of one level and gives them out in packed rows (part, sub, blob).

    hot: for each level before, the tokens that are too frequent. dealt: for those of this level the
    number of blocks, if their postings are to be dealt out: then token stands for a pair of blocks, e0 for the token.
    """

    def __init__(self, t: Fraction, ranks: np.ndarray, parts: int, subs: int, part: float, hot: list[np.ndarray], dealt: np.ndarray | None) -> None:
        self.t, self.ranks, self.parts, self.subs, self.part, self.hot, self.dealt = t, ranks, parts, subs, part, hot, dealt
        self.level = len(hot) + (dealt is None)
        self.held: list[dict] = []
        self.n = 0
        self.met: set = set()

    def add(self, line, word, n, sums, begin) -> None:
        """The postings of a chunk's lines, each class once as long as the task remembers it."""
        t, least = self.t, least_size(self.t)
        lines = np.flatnonzero(n >= least)
        keep = []
        for i, key in zip(lines.tolist(), sums[0][lines].tolist()):
            if key not in self.met:
                self.met.add(key)
                keep.append(i)
        if len(self.met) > 1 << 17:
            self.met.clear()
        if not keep:
            return
        keep = np.array(keep)
        size, first = n[keep], begin[keep]
        codes = self.ranks[_place(word)]
        prefix = prefix_length(size, t)
        of = np.repeat(np.arange(len(keep)), prefix)
        pos = np.arange(len(of)) - (np.cumsum(prefix) - prefix)[of]
        at = first[of] + pos
        use = codes[at] > 1  # a word that stands once in all lines is in no other set
        if self.hot:
            use &= np.isin(word[at], self.hot[0])
        of, pos, at = of[use], pos[use], at[use]
        if not len(of):
            return
        last = word[at]
        if self.level > 1:
            token, of, pos = self._chains(word, size, first, of, pos)
            last = word[first[of] + pos]
            early = [np.zeros(len(of), np.uint64)] * 2
        else:
            token = last
            # The two rarest words of the prefix that stand more than once, where they come before the word.
            new = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1])))
            nth = np.arange(len(of)) - np.repeat(new, np.diff(np.append(new, len(of))))
            heads = np.repeat(new, np.diff(np.append(new, len(of))))
            early = [np.where(nth > k, last[np.minimum(heads + k, len(last) - 1)], np.uint64(0)) for k in range(2)]
        posts = {"token": token, "c1": sums[0][keep][of], "size": size[of].astype(np.uint32), "pos": pos.astype(np.uint32), "e0": early[0], "e1": early[1], "word": last}
        posts |= {f"b{k}": bits[keep[of]] for k, bits in enumerate(_bitmaps(word, n, begin))}
        if self.dealt is not None:
            posts, of = self._in_blocks(posts)
        self.held.append(posts)
        self.n += len(of)

    def _chains(self, word, size, first, of, pos):
        """The chains of ``level`` words whose shorter chains all are too frequent: key, row, and position of the last word."""
        token, row, last = word[first[of] + pos], of, pos
        reach = prefix_length(size, self.t)
        for level in range(2, self.level + 1):
            more = np.maximum(0, (reach + level - 1)[row] - 1 - last)
            at = np.repeat(np.arange(len(row)), more)
            last = last[at] + 1 + np.arange(len(at)) - (np.cumsum(more) - more)[at]
            row = row[at]
            with np.errstate(over="ignore"):
                token = _mixed(token[at] * _MIX1 + word[first[row] + last], _MIX2)
            if level < self.level or self.dealt is not None:
                hot = np.isin(token, self.hot[level - 1])
                token, row, last = token[hot], row[hot], last[hot]
        return token, row, last

    def _in_blocks(self, posts: dict) -> tuple[dict, np.ndarray]:
        """Each posting once for every pair of blocks that its own is in."""
        blocks = self.dealt[np.searchsorted(self.hot[-1], posts["token"])]
        at = np.repeat(np.arange(len(blocks)), blocks)
        other = np.arange(len(at)) - (np.cumsum(blocks) - blocks)[at]
        own = (_mixed(posts["c1"].view(np.uint64), _MIX2) % blocks.astype(np.uint64)).astype(np.int64)[at]
        pair = (np.minimum(own, other) << 31 | np.maximum(own, other)).astype(np.uint64)
        posts = _taken(posts, at)
        posts["e0"] = posts["token"]
        with np.errstate(over="ignore"):
            posts["token"] = _mixed(posts["token"] * _MIX1 + pair, _MIX1)
        return posts, at

    def rows(self):
        if not self.held:
            return
        posts, hot, number = _tidied(_joined(self.held), self.part)
        self.held, self.n = [], 0
        if len(hot):
            posts = _joined([posts, _marks(hot, number)])
            posts = _taken(posts, np.argsort(posts["token"], kind="stable"))
        share = self.parts * self.subs
        of = ((posts["token"] >> np.uint64(32)) * np.uint64(share) >> np.uint64(32)).astype(np.int64)
        edge = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1])))
        for a, b in zip(edge.tolist(), [*edge[1:].tolist(), len(of)]):
            yield int(of[a]) // self.subs, int(of[a]) % self.subs, _pack(_taken(posts, slice(a, b)), self.level)


class _Receiver:
    """The postings of some tokens, given blob by blob; survivors, and the tokens with too many classes and about how many these are."""

    def __init__(self, level: int, t: Fraction, part: float, dealt: bool) -> None:
        self.level, self.t, self.part, self.dealt = level, t, part, dealt
        self.parts, self.n = [], 0
        self.hot, self.number = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def _found(self, hot: np.ndarray, number: np.ndarray) -> None:
        self.hot, at = np.unique(np.concatenate((self.hot, hot)), return_inverse=True)
        self.number = np.bincount(at, np.concatenate((self.number, number)), len(self.hot)).astype(np.int64)

    def _tidy(self) -> None:
        posts, hot, number = _tidied(_joined(self.parts), self.part)
        self._found(hot, number)
        known = np.isin(posts["token"], self.hot)  # found frequent before
        if known.any():
            self._found(*np.unique(posts["token"][known], return_counts=True))
            posts = _taken(posts, ~known)
        self.parts, self.n = [posts], 0

    def add(self, blob: bytes) -> None:
        self.parts.append(_unpack(blob, self.level))
        self.n += len(self.parts[-1]["token"])
        if self.n > HELD:  # copies of a class and frequent words go at once
            self._tidy()

    def settled(self) -> tuple[dict, np.ndarray, np.ndarray]:
        self._tidy()
        posts = self.parts[0]
        posts = _taken(posts, _may_be_similar(posts, self.t, self.level == 1 and not self.dealt))
        if self.dealt:
            posts["token"] = posts["e0"]
        return posts, self.hot, self.number


def _survivors(rows: DataFrame, level: int, t: Fraction, part: float, dealt: bool, id_type: T.DataType, what: str) -> DataFrame:
    """What receivers make of rows (part, sub, ids, lines, posts), written: lines (doc_id, th, line, c1, c2), survivors
    (c1, token, word) and frequent tokens (token, their number as word), told apart by their nulls."""
    parts = partitions(rows.sparkSession)
    schema = T.StructType([T.StructField("doc_id", id_type), *T.StructType.fromDDL("th long, line int, c1 long, c2 long, token long, word long")])
    id_arrow = to_arrow(id_type)

    def told(survivors: dict, hot: np.ndarray, number: np.ndarray):
        n, m = len(survivors["token"]), len(hot)
        token = np.concatenate((survivors["token"], hot)).view(np.int64)
        word = np.concatenate((survivors["word"].view(np.int64), number))
        c1 = pa.concat_arrays([pa.array(survivors["c1"]), pa.nulls(m, pa.int64())])
        return pa.RecordBatch.from_arrays([pa.nulls(n + m, id_arrow), pa.nulls(n + m, pa.int64()), pa.nulls(n + m, pa.int32()), c1, pa.nulls(n + m, pa.int64()), pa.array(token), pa.array(word)], schema.names)

    def receive(batches):
        key, held = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                if batch["lines"][i].is_valid:
                    yield _lines_from(batch["ids"][i].values, batch["lines"][i].as_py(), schema.names)
                    continue
                own = (batch["part"][i].as_py(), batch["sub"][i].as_py())
                if own != key:
                    if held:
                        yield told(*held.settled())
                    key, held = own, _Receiver(level, t, part, dealt)
                held.add(batch["posts"][i].as_py())
        if held:
            yield told(*held.settled())

    return written(rows.repartitionById(parts, F.col("part")).sortWithinPartitions("part", "sub").mapInArrow(receive, schema), what)


def _pack_lines(th, number, sums, none) -> bytes:
    return zstandard.compress(np.array([len(th)], np.int64).tobytes() + b"".join(np.ascontiguousarray(x).tobytes() for x in (th, number.astype(np.int32), *sums, none)), 1)


def _lines_from(ids: pa.Array, blob: bytes, names: list[str]) -> pa.RecordBatch:
    data = zstandard.decompress(blob)
    n, at, out = int(np.frombuffer(data, np.int64, 1)[0]), 8, []
    for kind in (np.int64, np.int32, np.int64, np.int64, bool):
        out.append(np.frombuffer(data, kind, n, at))
        at += out[-1].nbytes
    th, number, c1, c2, none = out
    return pa.RecordBatch.from_arrays([ids, pa.array(th), pa.array(number), pa.array(c1, mask=none), pa.array(c2, mask=none), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64())], names)


def _posted(docs: DataFrame, ranks, t: Fraction, part: float, subs: int, hot: list, dealt: np.ndarray | None, with_lines: bool) -> DataFrame:
    """Rows (part, sub, ids, lines, posts) of all docs: postings for the receiver of their words, and packed lines for any one."""
    parts, id_type = partitions(docs.sparkSession), docs.schema["doc_id"].dataType
    schema = T.StructType([*T.StructType.fromDDL("part int, sub int"), T.StructField("ids", T.ArrayType(id_type)), *T.StructType.fromDDL("lines binary, posts binary")])
    id_list = pa.list_(to_arrow(id_type))

    def run(batches):
        found, poster = Lines(), _Poster(t, ranks.value, parts, subs, part, hot, dealt)

        def packed_posts():
            rows = list(poster.rows())
            if rows:
                of, sub, blobs = zip(*rows)
                n = len(rows)
                yield pa.RecordBatch.from_arrays([pa.array(of, pa.int32()), pa.array(sub, pa.int32()), pa.nulls(n, id_list), pa.nulls(n, pa.binary()), pa.array(blobs, pa.binary())], schema.names)

        for batch in narrow_batches(batches):
            th, kept = batch.column(1).to_numpy(), []
            for at, row, number, line, word, n, sums, begin in _described(batch, found, ranks.value, t):
                poster.add(line, word, n, sums, begin)
                if with_lines:
                    kept.append((row + at, number, *sums, n == 0))
                if poster.n >= GATHERED:
                    yield from packed_posts()
            if kept:
                rows, number, a, b, none = (np.concatenate(x) for x in zip(*kept))
                ids = pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), batch.column(0).take(pa.array(rows)))
                blob = _pack_lines(th[rows], number, (a, b), none)
                yield pa.RecordBatch.from_arrays([pa.array([int(np.bitwise_xor.reduce(a) % parts)], pa.int32()), pa.array([-1], pa.int32()), ids, pa.array([blob], pa.binary()), pa.nulls(1, pa.binary())], schema.names)
        yield from packed_posts()

    return with_hash(docs).mapInArrow(run, schema)


def joined_lines(docs: DataFrame, similarity: str = SIMILARITY, part: int = PART, hot_words: int = HOT_WORDS) -> DataFrame:
    """(doc_id, th, line, class_doc_id, class_line, n_links, removed) for each line of docs (doc_id, text).

    The class of a line is named by its first line in order of doc_id and line;
    n_links counts the other classes that are similar. A line is removed if an
    earlier line of all docs has an equal or a similar set. Lines without words
    have no class and stay. Rows that agree in doc_id and text count as one
    document; their lines are judged alike. A null text is one empty line, a null
    doc_id comes before all others. Other columns of docs, of any name, aren't
    looked at; a table without rows gives none. ``part`` is the number of classes
    that share a word beyond which these are told apart by a second one; ``hot_words`` is how many such
    words tasks know at once, and any number of them is worked off.
    """
    t = Fraction(similarity)
    spark, id_type = docs.sparkSession, docs.schema["doc_id"].dataType
    codes = _count_codes(docs.select("text"))
    ranks = spark.sparkContext.broadcast(codes)
    some = codes > 0
    postings = float(1 - t) * (2.0 ** ((codes[some] - 1) / 8.0)).sum()
    subs = max(1, math.ceil(postings / partitions(spark) / HELD))
    levels = least_size(t) if t < 1 else 1

    def met_at(level: int, hot: list, dealt: np.ndarray | None, what: str) -> DataFrame:
        most = part if dealt is None else float("inf")
        return _survivors(_posted(docs, ranks, t, most, subs, hot, dealt, not hot), level, t, most, dealt is not None, id_type, what)

    def settled(level: int, met: DataFrame, hot: list):
        """The survivors of what too many classes shared at a level, and, slice by slice of such words, at the levels after it."""
        counts = written(met.where("line IS NULL AND c1 IS NULL").groupBy("token").agg(F.sum("word").alias("n")), "hot")
        slices = -(-counts.count() // hot_words)
        for k in range(slices):
            found = counts.where(F.pmod(F.xxhash64("token"), F.lit(slices)) == k).toArrow()
            tokens, n = found["token"].to_numpy().view(np.uint64), found["n"].to_numpy()
            order = np.argsort(tokens)
            chains, upto = [*hot, tokens[order]], min(level + 1, levels)
            blocks = -(-n[order] // part) if level == levels else None
            met = met_at(upto, chains, blocks, "chains")
            more = met.where("c1 IS NOT NULL").select("c1", "token", "word", F.lit(upto).alias("level"))
            if blocks is not None:
                yield more.distinct()
            else:
                yield more
                yield from settled(level + 1, met, chains)

    met = met_at(1, [], None, "lines")
    lines = met.where("line IS NOT NULL").select("doc_id", "th", "line", "c1", "c2")
    left = met.where("line IS NULL AND c1 IS NOT NULL").select("c1", "token", "word", F.lit(1).alias("level"))
    for more in settled(1, met, []):
        left = left.union(more)

    # Groups of many survivors are compared block by block.
    left = written(left, "left")
    sizes = small(written(left.groupBy("token", "word", "level").count().where(F.col("count") > DEALT).select(F.col("token").alias("t1"), F.col("word").alias("w1"), F.col("level").alias("l1"), F.ceil(F.col("count") / DEALT).alias("blocks")), "groups"))
    left = left.join(sizes, (F.col("token") == F.col("t1")) & (F.col("word") == F.col("w1")) & (F.col("level") == F.col("l1")), "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    left = left.withColumn("own", F.pmod(F.xxhash64("c1"), F.col("blocks"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = (F.least("own", "other") * (1 << 31) + F.greatest("own", "other")) * 2 + (F.col("own") > F.col("other")).cast("long")
    left = left.select("c1", "token", "word", "level", dealt.alias("dealt"))

    # Only classes of several lines, or with a survivor, are more than what their line says.
    first = F.min(F.struct("doc_id", "line", "th")).alias("first")
    classes = lines.where("c1 IS NOT NULL").groupBy("c1", "c2").agg(first, F.count("*").alias("n"))
    partnered = written(left.select(F.col("c1").alias("s1")).distinct(), "partnered")
    classes = written(classes.join(small(partnered), F.col("c1") == F.col("s1"), "left").where("n > 1 OR s1 IS NOT NULL").drop("n"), "classes")
    # Classes are looked up by one sum of their words' hashes; two classes that agree in it are both taken.
    wanted = classes.where("s1 IS NOT NULL").select("c1", "first.doc_id", "first.th", "first.line")
    lists = written(packed(left.join(wanted, "c1"), "line", "token", "word", "level", "dealt"), "left-lists")

    def send(batches):
        """The sets of listed lines; of rows alike in doc_id and text one, as long as the task remembers it."""
        found, met_before = Lines(), set()
        for batch in narrow_batches(batches):
            ids, th, texts, blobs = (batch.column(k) for k in range(4))
            texts = texts.cast(pa.large_binary())
            rows, entries, spans, held = [], [], [], []
            for r, key in enumerate(zip(ids.to_pylist(), th.to_pylist())):
                if key in met_before:
                    continue
                met_before.add(key)
                listed_ = unpacked(blobs[r].as_py(), 5)
                numbers, of = np.unique(listed_[:, 0], return_inverse=True)
                text = np.frombuffer(texts[r].as_py() or b"", np.uint8)
                edge = np.concatenate(([-1], np.flatnonzero(text == 10), [len(text)]))
                entries.append(np.column_stack((listed_, len(spans) + of)))
                rows.append(np.full(len(listed_), r))
                spans += [text[edge[k] + 1 : edge[k + 1]] for k in numbers.tolist()]
            if len(met_before) > 1 << 17:
                met_before.clear()
            if not entries:
                continue
            ends = np.cumsum([0, *map(len, spans)])
            for column in byte_chunks(pa.array([x.tobytes() for x in spans], pa.large_binary())):
                at, cuts, data = column
                row, _, line, word = found.of(cuts, data, ranks.value)
                n = np.bincount(line, minlength=len(row))
                begin = np.cumsum(n) - n
                held += [word[b : b + k].tobytes() for b, k in zip(begin.tolist(), n.tolist())]
            entries, rows = np.concatenate(entries), np.concatenate(rows)
            sets_ = pa.array(held, pa.binary()).take(pa.array(entries[:, 5]))
            rows = pa.array(rows)
            yield pa.RecordBatch.from_arrays(
                [
                    *(pa.array(np.ascontiguousarray(c)) for c in (entries[:, 1], entries[:, 2], entries[:, 3].astype(np.int32), entries[:, 4] >> 1, (entries[:, 4] & 1).astype(np.int32))),
                    *(ids.take(rows), th.take(rows), pa.array(entries[:, 0].astype(np.int32)), sets_),
                ],
                entry.names,
            )

    entry = T.StructType([*T.StructType.fromDDL("token long, word long, level int, blocks long, side int"), T.StructField("doc_id", id_type), *T.StructType.fromDDL("th long, line int, words binary")])
    sent = listed(docs, lists, broadcast_bytes=LIST_BYTES).mapInArrow(send, entry)
    sent = sent.repartition(partitions(spark), "token", "blocks").sortWithinPartitions("token", "blocks")

    def compared(batches):
        held, n = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            n += batch.nbytes
            if n >= 32 << 20:
                whole = pa.Table.from_batches(held)
                token, blocks = whole["token"].to_numpy(), whole["blocks"].to_numpy()
                ends = np.flatnonzero((token != token[-1]) | (blocks != blocks[-1]))
                if len(ends):
                    to = int(ends[-1]) + 1
                    yield _compared(whole.slice(0, to), ranks.value, t)
                    held = whole.slice(to).to_batches()
                    n = sum(x.nbytes for x in held)
        if held:
            yield _compared(pa.Table.from_batches(held), ranks.value, t)

    similar = sent.mapInArrow(compared, T.StructType([T.StructField("doc_id", id_type), *T.StructType.fromDDL("th long, line int, links long, earlier boolean")]))
    similar = similar.groupBy("doc_id", "th", "line").agg(F.sum("links").alias("links"), F.max("earlier").alias("earlier"))
    similar = written(similar.select(F.struct("doc_id", "line", "th").alias("s"), "links", "earlier"), "similar")
    known = classes.join(small(similar), classes["first"].eqNullSafe(F.col("s")), "left").select(F.col("c1").alias("k1"), F.col("c2").alias("k2"), "first", "links", "earlier")
    known = small(written(known, "known"))
    # Lines without words have a null for c2 and so meet no class; a hash deals them out.
    by = F.coalesce("c1", F.xxhash64("doc_id", "line"))
    out = lines.join(known, (by == F.col("k1")) & (F.col("c2") == F.col("k2")), "left")
    alone = F.col("k1").isNull() & F.col("c1").isNotNull()
    is_first = F.struct("doc_id", "line", "th").eqNullSafe(F.col("first"))
    removed = F.col("k1").isNotNull() & (~is_first | F.coalesce("earlier", F.lit(False)))
    return out.select(
        "doc_id", "th", "line", F.when(alone, F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("class_doc_id"), F.when(alone, F.col("line")).otherwise(F.col("first.line")).alias("class_line"), F.coalesce("links", F.lit(0)).alias("n_links"), removed.alias("removed")
    )


def _compared(rows: pa.Table, ranks: np.ndarray, t: Fraction) -> pa.RecordBatch:
    """(doc_id, th, line, links, earlier) of the rows with a similar partner in their group (token, word, level, blocks).

    A pair counts in the group whose chain are its first common words: then as many of its common
    words as the chain is long stand up to the chain's last.
    """
    names = ["doc_id", "th", "line"]
    id_rank = pc.rank(rows["doc_id"].combine_chunks(), sort_keys="ascending", null_placement="at_start", tiebreaker="dense").to_numpy().astype(np.int64)
    token, last, level, blocks, side, th, number = (rows[c].to_numpy() for c in ("token", "word", "level", "blocks", "side", "th", "line"))
    turn = np.lexsort((th, number, id_rank))
    place = np.empty(len(turn), np.int64)
    place[turn] = np.cumsum(np.concatenate(([0], np.any([c[turn][1:] != c[turn][:-1] for c in (id_rank, number, th)], axis=0))))[: len(turn)]
    alone = blocks >> 31 == blocks & (1 << 31) - 1
    blobs = rows["words"].combine_chunks()
    bounds = np.frombuffer(blobs.buffers()[1], np.int32)[blobs.offset : blobs.offset + len(blobs) + 1].astype(np.int64) // 8
    size = np.diff(bounds)
    every = np.frombuffer(blobs.buffers()[2], np.uint64)[bounds[0] : bounds[-1]] if blobs.buffers()[2] is not None else np.zeros(0, np.uint64)
    # In order of group and size, each line once: rows alike in doc_id and text may come from different tasks.
    order = np.lexsort((place, size, blocks, level, last, token))
    same = np.all([c[order][1:] == c[order][:-1] for c in (place, blocks, level, last, token)], axis=0)
    order = order[np.concatenate(([True], ~same))]
    token, last, level, blocks, place, size, side, alone = (c[order] for c in (token, last, level, blocks, place, size, side, alone))
    begin = bounds[:-1][order] - bounds[0]
    group = np.cumsum(np.concatenate(([0], np.any([c[1:] != c[:-1] for c in (token, last, level, blocks)], axis=0))))
    # Words by their place in the order of all words that are here.
    words = np.unique(every)
    words = words[np.lexsort((words, ranks[_place(words)]))]
    by = np.argsort(words)
    column = by[np.searchsorted(words[by], every)] if len(every) else np.zeros(0, np.int64)
    starts = np.cumsum(size) - size
    columns = column[np.repeat(begin - starts, size) + np.arange(int(size.sum()))]
    own = by[np.searchsorted(words[by], last.view(np.uint64))]
    links, earlier = np.zeros(len(group), np.int64), np.zeros(len(group), bool)

    def tell(i: np.ndarray, j: np.ndarray) -> None:
        np.add.at(links, i, 1)
        np.add.at(links, j, 1)
        earlier[np.where(place[i] < place[j], j, i)] = True

    edge = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1], [True])))
    few = np.repeat(np.diff(edge) <= FEW, np.diff(edge))
    wide = np.int64(len(words) + 1)
    chosen = np.flatnonzero(few)
    if len(chosen):
        keys = np.repeat(np.arange(len(group)), size) * wide + columns
        for i, j in _window_pairs(group[chosen], size[chosen], t):
            i, j = chosen[i], chosen[j]
            for at in range(0, len(i), 1 << 14):
                a, b = i[at : at + (1 << 14)], j[at : at + (1 << 14)]
                pair = np.repeat(np.arange(len(a)), size[a])
                where = np.repeat(starts[a] - (np.cumsum(size[a]) - size[a]), size[a]) + np.arange(len(pair))
                key = b[pair] * wide + columns[where]
                both = keys[np.minimum(np.searchsorted(keys, key), len(keys) - 1)] == key
                shared = np.bincount(pair, both, len(a))
                ahead = np.bincount(pair, both & (columns[where] <= own[a][pair]), len(a))
                ok = (shared >= least_overlap(size[a] + size[b], t)) & (ahead == level[a]) & (alone[a] | (side[a] != side[b]))
                tell(a[ok], b[ok])
    for a, b in zip(edge[:-1].tolist(), edge[1:].tolist()):
        if b - a > FEW:
            _dense_pairs(columns, starts[a:b], size[a:b], None if alone[a] else side[a:b], int(own[a]), int(level[a]), t, lambda i, j, a=a: tell(i + a, j + a))
    told = links > 0
    out = rows.select(names).take(pa.array(order[told])).combine_chunks()
    return pa.RecordBatch.from_arrays([*(out[c].combine_chunks() for c in names), pa.array(links[told]), pa.array(earlier[told])], [*names, "links", "earlier"])


def _dense_pairs(columns: np.ndarray, starts: np.ndarray, size: np.ndarray, side: np.ndarray | None, own: int, level: int, t: Fraction, tell, step: int = 256, wide: int = 8192) -> None:
    """The similar pairs of one group, of different sides if there are any, by matrix products of blocks of rows, which are in order of size."""
    low, high = int(starts[0]), int(starts[-1] + size[-1])
    every, column = np.unique(columns[low:high], return_inverse=True)
    shared = np.bincount(column) > 1  # a word of one row is common to none
    place = np.cumsum(shared) - 1
    row = np.repeat(np.arange(len(size)), size)[shared[column]]
    column = place[column[shared[column]]]
    upto = int(np.searchsorted(every[shared], own, side="right"))
    edge = np.searchsorted(row, np.arange(0, len(size) + step, step))
    at_of = np.full(int(shared.sum()), -1, np.int64)
    for x in range(len(edge) - 1):
        lo, hi = x * step, min(len(size), (x + 1) * step)
        r, c = row[edge[x] : edge[x + 1]] - lo, column[edge[x] : edge[x + 1]]
        own_columns = np.unique(c)
        at_of[own_columns] = np.arange(len(own_columns))
        ahead_to = int(np.searchsorted(own_columns, upto))
        for y in range(x, len(edge) - 1):
            lo2, hi2 = y * step, min(len(size), (y + 1) * step)
            if size[lo2] * t.numerator > size[hi - 1] * t.denominator:
                break
            r2, c2 = row[edge[y] : edge[y + 1]] - lo2, at_of[column[edge[y] : edge[y + 1]]]
            overlap, ahead = np.zeros((hi - lo, hi2 - lo2), np.float32), np.zeros((hi - lo, hi2 - lo2), np.float32)
            for start in range(0, max(1, len(own_columns)), wide):
                stop = min(len(own_columns), start + wide)
                left, right = np.zeros((hi - lo, stop - start), np.float32), np.zeros((hi2 - lo2, stop - start), np.float32)
                c1 = at_of[c]
                use = (c1 >= start) & (c1 < stop)
                left[r[use], c1[use] - start] = 1
                use = (c2 >= start) & (c2 < stop)
                right[r2[use], c2[use] - start] = 1
                overlap += left @ right.T
                if start < ahead_to:
                    ahead += left[:, : ahead_to - start] @ right[:, : ahead_to - start].T
            ok = (overlap >= least_overlap(size[lo:hi, None] + size[None, lo2:hi2], t)) & (ahead == level)
            if side is not None:
                ok &= side[lo:hi, None] != side[None, lo2:hi2]
            if x == y:
                ok = np.triu(ok, 1)
            i, j = np.nonzero(ok)
            tell(i + lo, j + lo2)
        at_of[own_columns] = -1


def without_later_lines(docs: DataFrame, similarity: str = SIMILARITY) -> DataFrame:
    """docs with removed lines taken out of text; all rows and other columns, of any name, stay, a null text too."""
    names = unused(docs, "id", "th", "gone")
    gone = joined_lines(docs.select("doc_id", "text"), similarity).where("removed").groupBy("doc_id", "th").agg(F.collect_set("line").alias(names[2]))
    gone = written(gone.withColumnsRenamed({"doc_id": names[0], "th": names[1]}), "gone")
    same = docs["doc_id"].eqNullSafe(gone[names[0]]) & (F.coalesce(F.xxhash64(docs["text"]), F.lit(0)) == gone[names[1]])
    kept = F.array_join(F.filter(F.split(docs["text"], "\n", -1), lambda x, i: ~F.array_contains(F.coalesce(gone[names[2]], F.array().cast("array<int>")), i)), "\n")
    return docs.join(gone, same, "left").select(*(kept.alias("text") if c == "text" else docs[c] for c in docs.columns))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joined_lines(table(spark, sf_dir, "documents")).drop("th")
