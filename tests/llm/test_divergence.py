import re
from collections import Counter, defaultdict

import pytest

from siftwell.llm.divergence import LEAST_DOCUMENTS, TOP, divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least=LEAST_DOCUMENTS):
    """The contract over (text, lang, source) rows."""
    df, counts, groups = Counter(), defaultdict(Counter), set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        terms = TERM.findall((text or "").translate(LOWER))
        df.update((lang, t) for t in set(terms))
        counts[lang, source].update(terms)
    out = []
    scaled = lambda c, n, v: 1 + 1_000_000_000 * (c + 2) // (n + 2 * v)
    apart = lambda p, q: (p - q) ** 2 // (p + q)
    for lang in {g[0] for g in groups}:
        kept = sorted(t for (x, t), n in df.items() if x == lang and n >= least)
        sources = sorted(s for x, s in groups if x == lang)
        total = {s: sum(counts[lang, s][t] for t in kept) for s in sources}
        whole = {t: sum(counts[lang, s][t] for s in sources) for t in kept}
        p = {s: {t: scaled(counts[lang, s][t], total[s], len(kept)) for t in kept} for s in sources}
        q = {t: scaled(whole[t], sum(whole.values()), len(kept)) for t in kept}
        for s in sources:
            pairs = [(x, sum(apart(p[s][t], p[x][t]) for t in kept)) for x in sources if x != s]
            terms = [(t, apart(p[s][t], q[t])) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, TOP)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, value, k + 1) for k, (item, value) in enumerate(found[:most])]
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def some_rows():
    words = "a bb Ccc dé Éa 日本 x'y z1z Ω".split()
    out = []
    for i in range(260):
        lang, source = ("en", "de", None, "fr")[i % 7 % 4], (None, "", "s1", "s2", "s3", "sé", "S1")[i % 5 if i % 3 else 6]
        out.append((" ".join(words[(i * k * k + k) % len(words)] for k in range(i % 23)), lang, source))
    out += [(None, "en", "null text"), ("", "en", "only empty"), ("once", "xx", "alone"), ("the same words", "it", "c"), *[("the same words", "it", "c")] * 12, *[("the other words", "it", "d")] * 11]
    return out


@pytest.mark.parametrize(("bucket", "tile", "chunk"), [(100_000, 128, 1 << 24), (7, 2, 1 << 24), (5, 1, 40)])
def test_like_brute_force(spark, bucket, tile, chunk):
    rows = some_rows()
    docs = spark.createDataFrame(rows, "text string, lang string, source string").repartition(5)
    assert rows_of(divergence(docs, bucket=bucket, tile=tile, chunk=chunk)) == brute(rows)


def test_a_long_text_is_one_document_though_it_comes_in_parts(spark):
    long = "word Übung " * 4000 + "w" * 5000
    rows = [(long, "en", "a"), *[("word here", "en", "b")] * 9, (long, "en", "b")]
    docs = spark.createDataFrame(rows, "text string, lang string, source string").repartition(1)
    for least in (2, 3, 11, 12):
        assert rows_of(divergence(docs, least, chunk=3000)) == brute(rows, least)


def test_odd_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string")
    assert divergence(docs).collect() == []
    clashing = spark.createDataFrame([("b a", "en", "s", "x", 1, 2, 3)] * 10 + [("b", "en", "t", "y", 4, 5, 6)], "text string, lang string, source string, term string, n long, value long, rank long")
    assert rows_of(divergence(clashing)) == brute([("b a", "en", "s")] * 10 + [("b", "en", "t")])
