import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from siftwell.llm.byte_bpe import ByteBPE
from siftwell.llm.packing import VOCABULARY, best_fit, crossover, evolved, filled, fitness, least_bins, mutated, packed, sequences

PARTS = ["'", " ", "  ", "\n", "\t", "s", "ll", "ve", "re", "d", "m", "t", "a", "é", "日", "1", "½", "!", "́", "\xa0", " ", "😀", "<|endoftext|>", "\x1c", "\x00", "_", "’", "S", "LL", "\r\n", "٣", "‍", "\x85", "　"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(VOCABULARY)


@pytest.fixture(scope="module")
def mine():
    return ByteBPE(VOCABULARY)


def test_ids_are_those_of_the_library(library, mine):
    rng = random.Random(3)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 14))) for _ in range(4000)] + ["", "It's we'll they've I'd ''s  's\n's 'S", "x" * 3000]
    assert [i.tolist() for _, i in mine.ids(texts)] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_long_texts_are_cut_where_words_begin(library, mine, monkeypatch):
    import siftwell.llm.byte_bpe as module

    monkeypatch.setattr(module, "CHARS", 50)
    text = "Some words, 'll be cut   here and\nthere; " * 40 + "y" * 300 + "<|endoftext|> end"
    texts = [text, "", "short", text * 2]
    assert [i.tolist() for _, i in mine.ids(texts)] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def one_by_one(lengths, room):
    bins = []
    for length in sorted(lengths, reverse=True):
        fits = [b for b in bins if sum(b) + length <= room]
        if fits:
            max(fits, key=sum).append(length)
        else:
            bins.append([length])
    return bins


def supply(packing):
    out = {}
    for pattern, bins in packing.items():
        for length, copies in pattern:
            out[length] = out.get(length, 0) + copies * bins
    return out


def test_best_fit_and_the_operators_keep_every_document():
    rng = random.Random(5)
    for _ in range(60):
        room = rng.choice([10, 40, 100])
        lengths = [rng.randint(1, room) for _ in range(rng.randint(1, 60))] + [rng.randint(1, 3)] * rng.randint(0, 30)
        counts = {n: lengths.count(n) for n in set(lengths)}
        best = best_fit(counts, {}, room)
        assert supply(best) == counts and sum(best.values()) == len(one_by_one(lengths, room))
        other = best_fit(counts, {}, room, sorted(counts))
        for child in (crossover(other, best, counts, room, rng), crossover(best, other, counts, room, rng), mutated(best, room, rng)):
            assert supply(child) == counts and all(filled(p) <= room for p in child)
        found = evolved([], counts, room, "seed", generations=4)
        assert sum(found[0].values()) <= sum(best.values()) and fitness(found[0], room) >= fitness(found[-1], room)
        assert sum(found[0].values()) >= least_bins(counts, room)


def test_evolution_finds_what_best_fit_misses():
    counts = {6: 2, 5: 2, 4: 2, 3: 2, 2: 2}  # 20 a bin needs {6, 5, 4, 3, 2} twice
    counts = {n: k * 9 for n, k in counts.items()} | {7: 9, 13: 9}
    assert sum(evolved([], counts, 20, "a", population=8, generations=30)[0].values()) == least_bins(counts, 20)


def check(rows, placed, library, room):
    """Every document's pieces hold its ids, and every sequence is without gaps."""
    expected = []
    for doc_id, text in rows:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        first = len(ids) % room or room if len(ids) > room else len(ids)
        cuts = [0, *range(first, len(ids) + 1, room)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            expected.append((doc_id, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())))
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in placed), key=key) == sorted(expected, key=key)
    bins = {}
    for r in placed:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for found in bins.values():
        at = 0
        for offset, length in sorted(found):
            assert offset == at
            at += length
        assert at <= room
    return bins


def test_rows(spark, make_docs, library):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 9)))
    rows = [(i, " ".join(word() for _ in range(rng.choice([1, 5, 20, 60, 200])))) for i in range(120)]
    rows += [(7, rows[7][1]), (None, "no id"), (None, "no id"), (200, None), (201, ""), (202, "same"), *[(300 + i, "copy of a text") for i in range(60)]]
    docs = make_docs(rows)
    bins = check(rows, packed(docs, 64, epochs=2).collect(), library, 64)
    total = sum(n for b in bins.values() for _, n in b)
    assert len(bins) <= -(-total // 64) * 1.02 + 1
    whole = packed(docs, 64, with_ids=True, epochs=1, islands=2)
    found = {r.sequence_id: r.ids for r in sequences(whole).collect()}
    placed = whole.collect()
    assert all(found[r.sequence_id][r.offset : r.offset + r.length] == r.ids for r in placed)
    assert sum(map(len, found.values())) == total


def test_clashing_columns_text_ids_and_empty_tables(spark, library):
    rows = [("b", "one two"), ("a", None), ("b", "one two")]
    docs = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "doc_id string, text string, length long, task string, sequence_id int")
    check(rows, packed(docs, 2048, epochs=1, islands=1).collect(), library, 2048)
    assert packed(docs.limit(0)).collect() == []
