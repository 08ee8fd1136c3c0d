"""Edit-aware token counts.

A document's pre-tokens lie in blocks, the leaves of a segment tree that sums
characters and tokens. An edit is found by descending by characters. Only the
pre-tokens that it touches, and a few before as context, are split and encoded
anew, until a boundary of the new text falls on one of the old text behind the edit;
from there on the split is as before. The sums above the touched blocks are
then renewed.

``count_trees`` makes a table of trees, a row for each document, to be kept with
its sums; ``edit_trees`` applies a batch of edits to such a table and gives the
next one, in which only what the edits touch has been encoded anew and only edited
trees have been opened. ``save_trees``, ``edit_saved`` and ``current_trees`` keep such
a table in batches: a batch of edits writes the trees that it changes and no others.
``edited_counts`` stores the trees of texts that come with their edits and edits these.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import narrow_batches, small, table, written

#: Where the ranks of a public byte-level vocabulary are, and the pattern of its pre-tokens (fixed values).
#: Every executor opens the file by this path: it is on each machine, or in a folder that all of them share.
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters before an edit whose pre-tokens may see it: a pre-token looks less far ahead.
CONTEXT = 8
BLOCK = 64
REMEMBERED = 1 << 18


class Counter:
    """Pre-tokens of a text and their numbers of tokens, which are remembered up to a bound."""

    def __init__(self, ranks: str = RANKS, pattern: str = PATTERN) -> None:
        with open(ranks, "rb") as lines:
            merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding("counts", pat_str=pattern, mergeable_ranks=merges, special_tokens={})
        self.pattern = regex.compile(pattern)
        self.known: dict[str, int] = {}

    def tokens(self, piece: str) -> int:
        n = self.known.get(piece)
        if n is None:
            n = len(self.encoding.encode_ordinary(piece))
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            if len(piece) <= 64:
                self.known[piece] = n
        return n

    def measure(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Length and number of tokens of each pre-token."""
        pieces = self.pattern.findall(text)
        known = self.known
        counts = [known.get(p) for p in pieces]
        if None in counts:
            counts = [self.tokens(p) if n is None else n for p, n in zip(pieces, counts)]
        return np.fromiter(map(len, pieces), np.int32, len(pieces)), np.array(counts, np.int32)


class CountTree:
    """A text with its pre-tokens in a segment tree; tokens is the number of its tokens."""

    def __init__(self, text: str, counter: Counter, leaves: tuple[np.ndarray, np.ndarray] | None = None, sums: np.ndarray | None = None) -> None:
        """leaves: the lengths and counts of the text's pre-tokens if they are known; else it is encoded. sums: those of the tree over them."""
        self.text, self.counter, self.encoded = text, counter, 0
        if sums is None:
            self._build(*(counter.measure(text) if leaves is None else leaves))
            return
        self.blocks = self._blocks(*leaves)
        self.sums = sums.reshape(-1, 3).tolist()
        self.leaves = len(self.sums) // 2

    @staticmethod
    def _blocks(lengths: np.ndarray, counts: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        return [(lengths[i : i + BLOCK], counts[i : i + BLOCK]) for i in range(0, max(1, len(lengths)), BLOCK)]

    def stored(self) -> tuple[bytes, bytes, bytes]:
        """Lengths, counts and sums, from which the tree can be made again without encoding or adding up."""
        if any(len(b[0]) != BLOCK for b in self.blocks[:-1]):  # edits leave blocks of other sizes
            self._build(*self.leaves_())
        return (*(x.tobytes() for x in self.leaves_()), np.array(self.sums, np.int64).tobytes())

    def leaves_(self) -> tuple[np.ndarray, np.ndarray]:
        """Lengths and counts of all pre-tokens, from which the tree can be built again without encoding."""
        return tuple(np.concatenate([b[k] for b in self.blocks]).astype(np.int32) for k in range(2))

    def _build(self, lengths: np.ndarray, counts: np.ndarray) -> None:
        n = max(1, -(-len(lengths) // BLOCK))
        self.blocks = self._blocks(lengths, counts)
        self.leaves = 1 << (n - 1).bit_length()
        level = np.zeros((self.leaves, 3), np.int64)
        if len(lengths):
            cuts = np.arange(0, len(lengths), BLOCK)
            level[:n, 0], level[:n, 1] = np.add.reduceat(lengths, cuts), np.add.reduceat(counts, cuts)
            level[:n, 2] = np.diff(np.append(cuts, len(lengths)))
        levels = [level]
        while len(level) > 1:
            level = level[::2] + level[1::2]
            levels.append(level)
        self.sums = [[0, 0, 0], *np.concatenate(levels[::-1]).tolist()]

    @property
    def tokens(self) -> int:
        return self.sums[1][1]

    @property
    def pretokens(self) -> int:
        return self.sums[1][2]

    def _block_at(self, place: int) -> tuple[int, int]:
        """The block with the character at place, or the last with any, and where it begins."""
        node, begin = 1, 0
        while node < self.leaves:
            node *= 2
            if place - begin >= self.sums[node][0] and self.sums[node + 1][0]:
                begin += self.sums[node][0]
                node += 1
        return node - self.leaves, begin

    def _renew(self, block: int) -> None:
        lengths, counts = self.blocks[block]
        node = block + self.leaves
        self.sums[node] = [int(lengths.sum()), int(counts.sum()), len(lengths)]
        while node > 1:
            node //= 2
            a, b = self.sums[2 * node], self.sums[2 * node + 1]
            self.sums[node] = [a[0] + b[0], a[1] + b[1], a[2] + b[2]]

    def edit(self, at: int, remove: int, insert: str) -> int:
        """Replaces ``remove`` characters at ``at`` by ``insert``; the number of pre-tokens encoded anew.

        Places beyond the text count as its end.
        """
        at = min(max(0, at), len(self.text))
        end = min(at + max(0, remove), len(self.text))
        moved = len(insert) - (end - at)
        self.text = self.text[:at] + insert + self.text[end:]
        first, begin = self._block_at(max(0, at - CONTEXT))
        lengths = self.blocks[first][0]
        inside = np.cumsum(lengths)
        j = max(0, int(np.searchsorted(inside, max(0, at - CONTEXT) - begin, side="right")) - 1)
        if j == 0 and first:  # the pre-token before is in an earlier block
            previous, start = self._block_at(begin - 1)
            if len(self.blocks[previous][0]):
                first, begin, lengths = previous, start, self.blocks[previous][0]
                inside = np.cumsum(lengths)
                j = len(lengths) - 1
        scan = begin + (int(inside[j - 1]) if j else 0)

        last, k, old = first, j, scan  # the old pre-tokens up to (last, k) end at old
        new_lengths, new_counts, done = [], [], scan
        for match in self.counter.pattern.finditer(self.text, scan):
            piece = match.group()
            new_lengths.append(len(piece))
            new_counts.append(self.counter.tokens(piece))
            done += len(piece)
            if done < at + len(insert):
                continue
            while old < done - moved and last < len(self.blocks):
                if k < len(self.blocks[last][0]):
                    old += int(self.blocks[last][0][k])
                    k += 1
                else:
                    last, k = last + 1, 0
            if old == done - moved and old >= end:
                break
        else:
            last, k = len(self.blocks) - 1, len(self.blocks[-1][0])
        head, tail = self.blocks[first], self.blocks[min(last, len(self.blocks) - 1)]
        k = k if last < len(self.blocks) else len(tail[0])
        joined = [np.concatenate((h[:j], np.array(new, np.int32), t[k:])) for h, new, t in zip(head, (new_lengths, new_counts), tail)]
        self.blocks[first] = (joined[0], joined[1])
        empty = np.zeros(0, np.int32)
        for i in range(first + 1, min(last, len(self.blocks) - 1) + 1):
            self.blocks[i] = (empty, empty)
            self._renew(i)
        self._renew(first)
        if len(joined[0]) > 8 * BLOCK:
            self._build(np.concatenate([b[0] for b in self.blocks]), np.concatenate([b[1] for b in self.blocks]))
        self.encoded += len(new_lengths)
        return len(new_lengths)


EDITS = "array<struct<at:int,remove:int,insert:string>>"


def with_edits(docs: DataFrame, edits: DataFrame) -> DataFrame:
    """docs with their edits (doc_id, seq, at, remove, insert), in order of seq, as the array _edits.

    A document's edits are gathered in its row; documents without edits get an empty array. A column _edits
    that was there before is replaced, columns of other names stay.
    """
    docs = docs.drop("_edits")
    listed = edits.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("seq", "at", "remove", "insert"))).alias("e"))
    listed = small(listed.select(F.col("doc_id").alias("id"), F.transform("e", lambda x: F.struct(x["at"].cast("int").alias("at"), x["remove"].cast("int").alias("remove"), x["insert"].alias("insert"))).alias("edits")))
    return docs.join(listed, docs["doc_id"].eqNullSafe(listed["id"]), "left").select(*(docs[c] for c in docs.columns), F.coalesce(listed["edits"], F.array().cast(EDITS)).alias("_edits"))


TREE = "version int, text string, lengths binary, counts binary, sums binary, n_chars long, n_pretokens long, n_tokens long"
_STORED = ("text", "lengths", "counts", "sums")


def _tree_columns(trees: list[CountTree], versions: list[int]) -> list[pa.Array]:
    stored = [t.stored() for t in trees]
    return [
        pa.array(versions, pa.int32()), pa.array([t.text for t in trees], pa.string()), *(pa.array([x[k] for x in stored], pa.binary()) for k in range(3)),
        *(pa.array(x, pa.int64()) for x in ([len(t.text) for t in trees], [t.pretokens for t in trees], [t.tokens for t in trees])),
    ]


def _opened(batch: pa.RecordBatch, counter: Counter):
    """The stored trees of a batch."""
    for text, *arrays in zip(*(batch[c].to_pylist() for c in _STORED)):
        lengths, counts, sums = (np.frombuffer(x or b"", kind) for x, kind in zip(arrays, (np.int32, np.int32, np.int64)))
        yield CountTree(text or "", counter, (lengths, counts), sums)


def _apply(tree: CountTree, edits) -> int:
    """Applies the edits in order; how many there are."""
    for e in edits or ():
        if e is not None:
            tree.edit(e["at"] or 0, e["remove"] or 0, e["insert"] or "")
    return len(edits or ())


def count_trees(docs: DataFrame, ranks: str = RANKS, pattern: str = PATTERN, keep: tuple = ()) -> DataFrame:
    """(doc_id, tree, version 0, text, lengths, counts, sums, n_chars, n_pretokens, n_tokens) for each row of docs (doc_id, text): trees to be stored.

    A null text is empty. Repeated rows are trees of their own, told apart by the number ``tree``; other columns
    aren't looked at, but those named in keep stay behind the others.
    """
    schema = T.StructType([docs.schema["doc_id"], *T.StructType.fromDDL(f"tree long, {TREE}"), *(docs.schema[c] for c in keep)])

    def run(batches):
        from pyspark import TaskContext

        counter, number = Counter(ranks, pattern), TaskContext.get().partitionId() << 40
        for batch in narrow_batches(batches):
            trees = [CountTree(t or "", counter) for t in batch.column(1).to_pylist()]
            numbers = pa.array(range(number, number + len(trees)), pa.int64())
            number += len(trees)
            yield pa.RecordBatch.from_arrays([batch.column(0), numbers, *_tree_columns(trees, [0] * len(trees)), *batch.columns[2:]], schema.names)

    return docs.select("doc_id", "text", *keep).mapInArrow(run, schema)


def edit_trees(trees: DataFrame, edits: DataFrame, ranks: str = RANKS, pattern: str = PATTERN, only_edited: bool = False) -> DataFrame:
    """The next trees, with n_edits and n_encoded, from stored ones and edits (doc_id, seq, at, remove, insert).

    Trees with edits get the next version; of their text only what the edits touch is encoded, n_encoded
    pre-tokens in all. Trees without edits pass as they are and don't leave the JVM; with only_edited they are left out. Edits of
    unknown documents do nothing; those of a doc_id that has several trees apply to each. The vocabulary must be that of the stored counts.
    """
    schema = T.StructType([trees.schema["doc_id"], *T.StructType.fromDDL(f"tree long, {TREE}, n_edits long, n_encoded long")])
    kept = schema.names[:-2]

    def run(batches):
        counter = Counter(ranks, pattern)
        for batch in narrow_batches(batches):
            made = list(_opened(batch, counter))
            done = [_apply(tree, own) for tree, own in zip(made, batch["_edits"].to_pylist())]
            versions = [v + 1 for v in batch["version"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["tree"], *_tree_columns(made, versions), pa.array(done, pa.int64()), pa.array([t.encoded for t in made], pa.int64())], schema.names)

    known = with_edits(trees.select(*kept), edits)
    touched = known.where(F.size("_edits") > 0).mapInArrow(run, schema)
    if only_edited:
        return touched
    none = F.lit(0).cast("long")
    return touched.unionByName(known.where(F.size("_edits") == 0).select(*kept, none.alias("n_edits"), none.alias("n_encoded")))


def save_trees(docs: DataFrame, root: str, ranks: str = RANKS, pattern: str = PATTERN) -> None:
    """Writes the trees of docs as batch 0 below root."""
    none = F.lit(0).cast("long")
    count_trees(docs, ranks, pattern).select("*", none.alias("n_edits"), none.alias("n_encoded")).write.mode("overwrite").parquet(f"{root}/batch=0")


def current_trees(spark: SparkSession, root: str, upto: int) -> DataFrame:
    """The newest version of each tree in batches 0 to upto. Only numbers are shuffled to find it, and from one batch nothing."""
    rows = spark.read.parquet(*(f"{root}/batch={n}" for n in range(upto + 1)))
    if not upto:
        return rows
    later = spark.read.parquet(*(f"{root}/batch={n}" for n in range(1, upto + 1))).groupBy(F.col("tree").alias("_tree")).agg(F.max("version").alias("_newest"))
    return rows.join(later, (F.col("tree") == F.col("_tree")) & (F.col("version") < F.col("_newest")), "left_anti")


def edit_saved(spark: SparkSession, root: str, batch: int, edits: DataFrame, ranks: str = RANKS, pattern: str = PATTERN) -> None:
    """Applies edits to the trees of the batches before and writes those that change as this batch; run again, it replaces the batch."""
    edit_trees(current_trees(spark, root, batch - 1), edits, ranks, pattern, only_edited=True).write.mode("overwrite").parquet(f"{root}/batch={batch}")


def edited_counts(docs: DataFrame, ranks: str = RANKS, pattern: str = PATTERN) -> DataFrame:
    """(doc_id, n_chars, n_pretokens, n_tokens, n_edits, n_encoded, n_chars_after, n_pretokens_after, n_tokens_after)
    for each row of docs (doc_id, text, _edits): trees are stored, and the edits then applied to the stored ones.

    Edits apply one after the other, each to what the last one left. A null text
    is empty, a null array has no edits; a null place or length is 0, a null
    insert is empty. Repeated rows are counted each; other columns aren't looked
    at, and a table without rows gives none.
    """
    fields = "n_chars long, n_pretokens long, n_tokens long, n_edits long, n_encoded long, n_chars_after long, n_pretokens_after long, n_tokens_after long"
    schema = T.StructType([docs.schema["doc_id"], *T.StructType.fromDDL(fields)])
    trees = written(count_trees(docs.select("doc_id", "text", "_edits"), ranks, pattern, keep=("_edits",)), "trees")

    def run(batches):
        counter = Counter(ranks, pattern)
        for batch in narrow_batches(batches):
            out = []
            for tree, edits in zip(_opened(batch, counter), batch["_edits"].to_pylist()):
                before = (len(tree.text), tree.pretokens, tree.tokens)
                n_edits = _apply(tree, edits)
                out.append((*before, n_edits, tree.encoded, len(tree.text), tree.pretokens, tree.tokens))
            columns = [pa.array(list(c), pa.int64()) for c in (zip(*out) if out else [[]] * 8)]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *columns], schema.names)

    return trees.select("doc_id", *_STORED, "_edits").mapInArrow(run, schema)


def revision(text: Column, lang: Column, source: Column) -> Column:
    """The edits of op1's query: the source's name over five characters at a third of the text, the
    language's name as a word at two thirds, and eleven characters less in the middle."""
    n = F.coalesce(F.char_length(text), F.lit(0))
    edit = lambda at, remove, insert: F.struct(F.floor(at).cast("int").alias("at"), F.lit(remove).alias("remove"), insert.alias("insert"))
    return F.array(edit(n / 3, 5, F.coalesce(source, F.lit(""))), edit(2 * n / 3, 0, F.concat(F.lit(" "), F.coalesce(lang, F.lit("")), F.lit(" "))), edit(n / 2, 11, F.lit(""))).cast(EDITS)


def op1_edit_aware_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return edited_counts(docs.withColumn("_edits", revision(F.col("text"), F.col("lang"), F.col("source"))))
