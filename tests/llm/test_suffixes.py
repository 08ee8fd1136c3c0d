import hashlib
import random

import numpy as np

from siftwell.llm.suffixes import common_prefix, deduplicated, front_coded, merge_runs

L = 200


def brute(rows):
    texts = [(i, (t or "").encode()) for i, t in rows]
    count = {}
    for _, b in texts:
        for s in range(len(b) - L + 1):
            count[b[s : s + L]] = count.get(b[s : s + L], 0) + 1
    out = []
    for i, b in texts:
        gone = np.zeros(len(b) + 1, bool)
        for s in range(len(b) - L + 1):
            if count[b[s : s + L]] > 1:
                gone[s : s + L] = True
        spans = int((np.diff(gone.astype(int)) == 1).sum()) + int(gone[0])
        out.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone[:-1]])).hexdigest()))
    return out


def found(docs, **how):
    return [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in deduplicated(docs, **how).collect()]


def test_loser_tree():
    r = random.Random(4)
    for ways in (1, 2, 3, 7, 12):
        runs = [sorted(bytes(r.choices(b"ab", k=r.randrange(12))) for _ in range(r.randrange(30))) for _ in range(ways)]

        def decoded(keys):
            shared, rests = front_coded(keys)
            last, at = b"", 0
            for n, key in zip(shared, keys):
                last, at = last[:n] + rests[at : at + len(key) - n], at + len(key) - n
                yield last, n, None

        merged = list(merge_runs([decoded(k) for k in runs]))
        assert [m[0] for m in merged] == sorted(x for k in runs for x in k)
        assert all(n == common_prefix(a[0], b[0], 0) for a, b, n in zip(merged, merged[1:], [m[1] for m in merged[1:]]))


def cases():
    r = random.Random(9)
    word = lambda: "".join(r.choices("abcdeé", k=r.randrange(1, 8)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passage, long = prose(80), prose(400)
    rows = [(i, prose(r.randrange(10, 200))) for i in range(12)]
    rows += [(20 + i, prose(20) + passage + prose(r.randrange(30))) for i in range(8)]
    rows += [(40, long), (41, long), (42, long[:700] + "X" + long[701:]), (43, long[5:1200]), (44, "ab" * 400), (45, "a" * 650), (46, passage + passage)]
    edge = passage.encode()[:260].decode("utf-8", "ignore")
    rows += [(50 + i, f"{i}{edge[i:]}{prose(5)}") for i in range(12)]
    return rows + [(60, None), (61, ""), (62, "short"), (62, "short"), (63, passage[:150] + "é" + passage[150:]), (None, passage)]


def test_against_brute_force(make_docs):
    rows = cases()
    want = sorted(brute(rows), key=lambda x: (x[0] is not None, x[0] or 0, *x[1:]))
    for group in (4096, 2):
        got = sorted(found(make_docs(rows), group=group), key=lambda x: (x[0] is not None, x[0] or 0, *x[1:]))
        assert got == want


def test_repeated_rows_and_empty_tables(make_docs):
    text = "".join(chr(97 + (i * i) % 26) + str(i) for i in range(300))
    assert [x[2] for x in found(make_docs([(1, text), (1, text)]))] == [len(text)] * 2
    assert [x[2] for x in found(make_docs([(1, text)]))] == [0]
    assert found(make_docs([(1, text)]).limit(0)) == []
