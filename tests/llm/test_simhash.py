import random
import re

import numpy as np
import xxhash

from siftwell.llm.components import components
from siftwell.llm.simhash import exact_blocks, first_of_each, fingerprint, links, near_components, trie_pairs

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def roots(values):
    up = {v: v for v in values}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    values = list(up)
    for i, a in enumerate(values):
        for b in values[i + 1 :]:
            if (a ^ b).bit_count() <= 4:
                up[find(a)] = find(b)
    return {v: find(v) for v in values}


def test_fingerprints():
    for text in ("", "  \n", "One", "one two three", "a b c d e A B\tc\x0bd", "é É x y z w q " * 50):
        assert fingerprint(text.encode()) & (1 << 64) - 1 == plain_print(text)


def test_trie_join():
    r = random.Random(1)
    base = [r.getrandbits(64) for _ in range(4)]
    keys = np.array(sorted({b ^ sum(1 << r.randrange(64) for _ in range(r.randrange(6))) for b in base for _ in range(60)}), np.uint64)
    got = {(int(a), int(b)) for i, j in trie_pairs(keys, np.zeros(len(keys), int), np.zeros(len(keys), int), 0, 4) for a, b in zip(i, j)}
    assert got == {(i, j) for i in range(len(keys)) for j in range(i + 1, len(keys)) if int(keys[i] ^ keys[j]).bit_count() <= 4}
    side = np.arange(len(keys)) % 2
    order = np.lexsort((keys, side))
    k, s = keys[order], side[order]
    got = {(int(a), int(b)) for i, j in trie_pairs(k, np.zeros(len(k), int), s, 0, 4) for a, b in zip(i, j)}
    assert got == {(i, j) for i in range(len(k)) for j in range(len(k)) if s[i] == 0 and s[j] == 1 and int(k[i] ^ k[j]).bit_count() <= 4}


def test_links_join_what_is_near(spark):
    r = random.Random(2)
    base = [r.getrandbits(64) for _ in range(20)]
    values = {b ^ sum({1 << r.randrange(64) for _ in range(r.randrange(9))}) for b in base for _ in range(25)} | {0, 1, (1 << 64) - 1}
    want = roots(values)
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    fps = spark.createDataFrame([(signed(v),) for v in values], "fp long")
    for exact, part in ((1, 512), (1, 4), (2, 512)):
        found = components(links(fps, exact=exact, part=part)).collect()
        root = {x.node & (1 << 64) - 1: x.root for x in found}
        group = {}
        for v in values:
            group.setdefault(want[v], []).append(v)
        for members in group.values():
            assert len({root.get(v, signed(v)) for v in members}) == 1
        assert len({root.get(v, signed(v)) for v in values}) == len(group)


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, 101), (101, 100), (7, 7), (200, 5)]
    found = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {**{i: 1 for i in range(1, 61)}, 200: 1, 100: 100, 101: 100}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_rows(spark, make_docs):
    r = random.Random(3)
    long = " ".join(f"w{r.randrange(500)}" for _ in range(3000))
    near = long + " one more end"
    rows = [(5, long), (3, near), (9, "other words entirely here"), (1, None), (2, ""), (4, long), (4, long), (None, "lone text of a null id"), (8, "x" * 200_000)]
    found = [(x.doc_id, x.fp & (1 << 64) - 1, x.component_id) for x in near_components(make_docs(rows)).collect()]
    assert len(found) == len(rows) and all(fp == plain_print(dict(rows)[i]) for i, fp, _ in found)
    assert {(i, c) for i, _, c in found} == {(5, 3), (3, 3), (4, 3), (9, 9), (1, 1), (2, 1), (None, None), (8, 8)}
    kept = first_of_each(make_docs([*rows, (3, near)]))
    assert sorted(str(x.doc_id) for x in kept.collect()) == ["1", "3", "8", "9", "None"] and kept.columns[:2] == ["doc_id", "text"]
    assert near_components(make_docs(rows).limit(0)).collect() == []


def test_one_id_with_several_texts(make_docs):
    r = random.Random(5)
    a, b, c = (" ".join(f"{x}{r.randrange(400)}" for _ in range(2000)) for x in "abc")
    rows = [(3, a), (5, a + " end"), (5, b), (7, b + " end"), (5, c), (5, c), (5, c + " end"), (9, c), (3, None), (8, "")]
    kept = [(x.doc_id, (x.text or "")[:1]) for x in first_of_each(make_docs(rows)).collect()]
    assert sorted(kept) == [(3, ""), (3, "a"), (5, "b"), (5, "c")]


def test_more_blocks_for_more_prints():
    counts = (1, 512 << 12, 1 + (512 << 12), 512 << 21, 512 << 27, 1 + (512 << 27))
    assert [exact_blocks(n) for n in counts] == [1, 1, 2, 2, 3, 4]


def test_columns_of_any_name(spark, make_docs):
    docs = make_docs([(2, "a b c d e"), (1, "a b c d e"), (3, None)]).selectExpr("*", "'kept' AS root", "1 AS fp", "2 AS th", "3 AS _id", "4 AS row", "5 AS component_id", "6 AS first")
    kept = first_of_each(docs)
    assert kept.columns == docs.columns and {(r.doc_id, r.root, r.row) for r in kept.collect()} == {(1, "kept", 4), (3, "kept", 4)}
    assert {(r.doc_id, r.component_id) for r in near_components(docs).collect()} == {(1, 1), (2, 1), (3, 3)}
