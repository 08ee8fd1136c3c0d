import hashlib
import random
import re
from collections import Counter

import duckdb

from siftwell.llm import decontaminate
from siftwell.llm.decontaminate import ORACLE_SQL, contamination, decontamination_stage, near_contamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(text, items):
    w, hit, found = words(text), set(), set()
    for item_id, item in items:
        v = words(item)
        n = min(13, len(v))
        windows = {tuple(v[i : i + n]) for i in range(len(v) - n + 1)} if n else set()
        for p in range(len(w) - n + 1 if n else 0):
            if tuple(w[p : p + n]) in windows:
                hit |= set(range(p, p + n))
                if item_id is not None:
                    found.add(str(item_id))
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)


def fixture():
    r = random.Random(2)
    vocabulary = [f"w{i}" for i in range(30)] + ["É", "straße", "123"]
    items = [(i, " ".join(r.choice(vocabulary) for _ in range(r.choice([1, 5, 13, 14, 30])))) for i in range(12)]
    items += [(20, None), (21, "..."), (3, items[3][1]), (None, "null item words here now")]
    docs = []
    for i in range(40):
        text = " ".join(r.choice(vocabulary) for _ in range(r.randrange(200)))
        for _ in range(r.randrange(3)):
            text += ", " + (r.choice(items)[1] or "").upper() + " -- " + text[:50]
        docs.append((i, text))
    return docs + [(50, None), (51, ""), (52, "!!"), (1, docs[1][1]), (1, "other text"), (None, items[4][1]), (53, items[5][1] + " x" * 60_000)], items


def test_against_brute_force(spark, make_docs):
    docs, items = fixture()
    table = spark.createDataFrame(items, "item_id long, text string")
    rows = contamination(make_docs(docs), table).drop("h").collect()
    want = [(i, *brute(t, items)) for i, t in docs]
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(map(tuple, rows), key=key) == sorted(want, key=key)
    assert contamination(make_docs(docs), table.limit(0)).where("n_hit > 0").count() == 0
    assert contamination(make_docs(docs).limit(0), table).count() == 0


def test_sql_says_the_same(spark, make_docs):
    docs, items = fixture()
    docs, items = [d for d in docs if d[0] is not None], [i for i in items if i[0] is not None]
    documents, benchmark = make_docs(docs).toPandas(), spark.createDataFrame(items, "item_id long, text string").toPandas()  # noqa: F841
    got = duckdb.sql(ORACLE_SQL["op4_benchmark_decontamination"]).df()
    rows = [(int(r.doc_id), r.n_words, r.n_hit, r.n_items, r.items_sha256, bool(r.contaminated)) for r in got.itertuples()]
    assert sorted(rows) == sorted((i, *brute(t, items)) for i, t in docs)


def test_proximity_and_stage(spark, make_docs, tmp_path):
    passage = " ".join(f"p{i}" for i in range(13))
    mixed = " ".join(f"p{i}" for i in (3, 2, 1, 0, 4, 6, 5, 8, 7, 9, 11, 12, 10))
    docs = make_docs([(1, f"a b {passage} c"), (2, f"a {mixed} b"), (3, "clean text")])
    items = spark.createDataFrame([(7, passage)], "item_id long, text string")
    assert {r.doc_id for r in near_contamination(docs, items).collect()} == {1, 2}
    items.write.parquet(str(tmp_path / "benchmark.parquet"))
    kept = decontamination_stage(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {2, 3}


def near_brute(docs, items, least=0.8):
    """{(doc_id, item_id): places}: leading terms by the texts alone, and the stretches of 13 words that have to be found."""
    counts = Counter(w for _, t in docs for w in words(t))
    places, stretches = {}, set()
    for item_id, item in items:
        v = words(item)
        n = min(13, len(v))
        for window in {tuple(v[i : i + n]) for i in range(len(v) - n + 1)} if n else ():
            terms = set(window)
            need = min(c for c in range(1, len(terms) + 1) if c >= least * len(terms) - 1e-9)
            leads = sorted(terms, key=lambda t: (counts[t], t.encode()))[: len(terms) - need + 1]
            for doc_id, text in docs:
                w = words(text)
                for p, word in enumerate(w):
                    share = len(terms & set(w[max(0, p - 12) : p + 13])) / len(terms)
                    if word in leads and share >= least - 1e-9:
                        old = places.setdefault((doc_id, item_id), {})
                        old[p] = max(old.get(p, 0), share)
                    if len(terms & set(w[p : p + 13])) >= need:
                        stretches.add((doc_id, item_id))
    return places, stretches


def test_proximity_like_brute_force(spark, make_docs):
    r = random.Random(6)
    common = [f"c{i}" for i in range(12)]
    items = [(i, " ".join(r.choice([f"r{i}x{k}", r.choice(common)]) for k in range(r.choice([1, 4, 13, 16, 30])))) for i in range(12)] + [(None, "alone c1 c2"), (50, None), (51, "never seen here " * 3), (3, "c0 c0 c0")]
    docs = []
    for d in range(40):
        text = [r.choice(common) for _ in range(r.randrange(40))]
        for _, item in r.sample(items[:12], 2):
            part = words(item)[: r.choice([13, 20, 40])]
            for _ in range(r.randrange(4)):  # changed, dropped and moved words
                k = r.randrange(len(part))
                part = r.choice([part[:k] + ["changed"] + part[k + 1 :], part[:k] + part[k + 1 :] or part, sorted(part, key=lambda _: r.random())])
            at = r.randrange(len(text) + 1)
            text[at:at] = part
        docs.append((d, " ".join(text)))
    docs += [(100, None), (101, "")]
    found = {}
    for x in near_contamination(make_docs(docs), spark.createDataFrame(items + items[:2], "item_id long, text string")).collect():
        found.setdefault((x.doc_id, x.item_id), {})[x.at] = x.share
    want, stretches = near_brute(docs, items)
    assert stretches <= found.keys() and len(stretches) > 20
    assert {k: {p: round(s, 9) for p, s in v.items()} for k, v in found.items()} == {k: {p: round(s, 9) for p, s in v.items()} for k, v in want.items()}
    assert near_contamination(make_docs(docs).limit(0), spark.createDataFrame(items, "item_id long, text string")).collect() == []


def test_more_terms_than_may_be_broadcast(spark, make_docs, monkeypatch):
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", 0)
    docs, items = fixture()
    docs = [(i, t) for i, t in docs if i is not None and i < 20]
    rows = contamination(make_docs(docs), spark.createDataFrame(items, "item_id long, text string")).drop("h").collect()
    assert sorted(map(tuple, rows)) == sorted((i, *brute(t, items)) for i, t in docs)


def test_long_items(spark, make_docs):
    """An item as long as a book: its windows roll over its words."""
    long = [f"w{i}" for i in range(20_000)]
    rare = " ".join(long[11_000:11_020])
    docs = make_docs([(1, f"x {rare} y"), (2, "w5 w7 w9 " * 20), (3, " ".join(long))])
    items = spark.createDataFrame([(7, " ".join(long)), (8, rare)], "item_id long, text string")
    found = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.contaminated) for r in contamination(docs, items).collect()}
    assert found == {1: (22, 20, 2, True), 2: (60, 0, 0, False), 3: (20_000, 20_000, 2, True)}


def test_columns_of_any_name(spark, make_docs, tmp_path):
    passage = " ".join(f"p{i}" for i in range(13))
    docs = make_docs([(1, passage), (2, "clean"), (3, None)]).selectExpr("*", "'kept' AS h", "1 AS id", "2 AS _bad_id", "3 AS words", "4 AS term")
    items = spark.createDataFrame([(7, passage, 1, 2)], "item_id long, text string, item int, n int")
    assert {r.doc_id: r.n_hit for r in contamination(docs, items).collect()} == {1: 13, 2: 0, 3: 0}
    items.write.parquet(str(tmp_path / "benchmark.parquet"))
    kept = decontamination_stage(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns and {(r.doc_id, r.h) for r in kept.collect()} == {(2, "kept"), (3, "kept")}
