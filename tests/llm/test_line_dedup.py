import random
from fractions import Fraction

from siftwell.llm import line_dedup
from siftwell.llm.line_dedup import joined_lines, least_overlap, prefix_length, without_later_lines


def brute(rows):
    """{(doc_id, line): (class, links, removed)} by comparing all pairs."""
    lines = [(i, k, frozenset(x.encode().lower().split())) for i, t in rows for k, x in enumerate((t or "").split("\n"))]
    first = {}
    for i, k, s in sorted(lines, key=lambda x: x[:2]):
        first.setdefault(s, (i, k))
    first.pop(frozenset(), None)
    similar = {s: [o for o in first if o != s and 5 * len(s & o) >= 4 * len(s | o)] for s in first}
    out = {}
    for i, k, s in lines:
        if not s:
            out[i, k] = (None, 0, False)
        else:
            out[i, k] = (first[s], len(similar[s]), (i, k) != first[s] or any(first[o] < first[s] for o in similar[s]))
    return out


def found(docs, **how):
    rows = joined_lines(docs, **how).collect()
    return {(r.doc_id, r.line): (None if r.class_line is None else (r.class_doc_id, r.class_line), r.n_links, r.removed) for r in rows}, len(rows)


def some_rows(seed, dense):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    base = [r.sample(words, 20) for _ in range(6)]
    rows = []
    for i in range(40):
        lines = []
        for _ in range(4):
            line = list(r.choice(base)) if r.random() < dense else r.sample(words, r.randrange(1, 15))
            for _ in range(r.randrange(3)):
                line[r.randrange(len(line))] = r.choice(words)
            lines.append(" ".join(line).upper() if r.random() < 0.1 else " ".join(line))
        rows.append((i, "\n".join([*lines, ""])))
    return rows


def test_thresholds():
    t = Fraction("4/5")
    assert [prefix_length(n, t) for n in (1, 4, 5, 10)] == [1, 1, 2, 3]
    assert least_overlap(20, t) == 9 and least_overlap(18, t) == 8


def test_against_all_pairs(make_docs):
    for dense, part in ((0.3, 512), (0.95, 512), (0.95, 3)):
        rows = some_rows(3, dense)
        got, n = found(make_docs(rows), part=part)
        assert got == brute(rows) and n == 200


def test_any_number_of_frequent_words(make_docs):
    """With room for a few of them at once, words that many classes share are worked off slice by slice at each level."""
    rows = some_rows(4, 0.95)[:25]
    got, n = found(make_docs(rows), part=6, hot_words=25)
    assert got == brute(rows) and n == 125


def test_large_groups_and_long_lines(make_docs, monkeypatch):
    """Groups that are compared by matrix products, whose words are split further, and sets with wide bitmaps."""
    r = random.Random(5)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for i in range(150):
        short, long = base[:16], list(base)
        for line, most in ((short := list(short), 2), (long, 25)):
            for _ in range(r.randrange(most)):
                line[r.randrange(len(line))] = f"x{r.randrange(40)}"
        rows.append((i, " ".join(short) + "\n" + " ".join(long)))
    for part, dealt in ((1 << 15, 2048), (20, 60)):
        monkeypatch.setattr(line_dedup, "DEALT", dealt)
        got, n = found(make_docs(rows), part=part)
        assert got == brute(rows) and n == 300


def test_columns_of_any_name(make_docs):
    rows = [(1, "one two three\nkeep me"), (2, "one two three\nnew"), (3, None)]
    docs = make_docs(rows).selectExpr("*", "'kept' AS _gone", "-doc_id AS th", "1 AS gone", "2 AS id", "3 AS _id", "4 AS line", "5 AS _th")
    out = without_later_lines(docs)
    assert out.columns == docs.columns
    assert {(r.doc_id, r.text, r._gone, r.th, r.gone, r.id, r._id, r.line, r._th) for r in out.collect()} == {
        (i, t, "kept", -i, 1, 2, 3, 4, 5) for i, t in ((1, "one two three\nkeep me"), (2, "new"), (3, None))
    }
    assert len(found(docs)[0]) == 5


def test_odd_rows(make_docs):
    rows = [(1, "a b c"), (2, None), (3, ""), (4, "\n\n"), (5, "A  b\tC"), (6, "x" * 50_000 + " y"), (None, "a b c")]
    got, _ = found(make_docs(rows))
    assert got[None, 0] == ((None, 0), 0, False) and got[1, 0][2] and got[5, 0] == ((None, 0), 0, True)
    assert got[2, 0] == got[3, 0] == got[4, 1] == (None, 0, False)
    assert found(make_docs([(1, "a b"), (1, "a b")]))[1] == 2
    assert found(make_docs(["x"]).limit(0)) == ({}, 0)


def test_repeated_rows_count_once(make_docs):
    rows = some_rows(3, 0.95)
    again = [*rows, *rows[:20], *rows[:5], *rows[:5]]
    for part, partitions in ((512, 1), (512, 7), (3, 7)):
        got, n = found(make_docs(again, partitions), part=part)
        assert got == brute(rows) and n == 5 * len(again)
    docs = make_docs([(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e g")], 3)
    assert sorted((r.doc_id, r.text) for r in without_later_lines(docs).collect()) == [(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e g")]
    docs = make_docs([(1, "a b c d e f g h i j"), (1, "a b c d e f g h i j"), (2, "a b c d e f g h i k")], 3)
    assert sorted((r.doc_id, r.text) for r in without_later_lines(docs).collect()) == [(1, "a b c d e f g h i j"), (1, "a b c d e f g h i j"), (2, "")]


def test_texts(make_docs):
    docs = make_docs([(1, "one two three\nkeep me"), (2, "one two three\nnew"), (3, None)])
    assert {r.doc_id: r.text for r in without_later_lines(docs).collect()} == {1: "one two three\nkeep me", 2: "new", 3: None}
