import os

import pytest

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_pipeline_against_its_parts(spark):
    """Each stage's effect on what the one before kept, by brute force where SQL can't say it."""
    import corpus_pipeline
    from tests.llm.test_decontaminate import brute
    from tests.llm.test_simhash import plain_print, roots

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "decontamination", "mixing", "sharding"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.collect()
        docs = stage(spark, docs, SF).cache()
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        got[name] = (before, docs.collect())
    before, after = got["quality"]
    right = [(d in {r.doc_id for r in after}) == bool(q) for d, q in labels.items()]
    assert sum(right) >= 0.9 * len(right)
    before, after = got["near_dedup"]
    prints = {r.doc_id: plain_print(r.text) for r in before}
    root = roots(set(prints.values()))
    first = {}
    for d in sorted(prints):
        first.setdefault(root[prints[d]], d)
    assert sorted(r.doc_id for r in after) == sorted(first.values())
    before, after = got["decontamination"]
    assert sorted(r.doc_id for r in after) == sorted(r.doc_id for r in before if not brute(r.text, items)[4])
    before, after = got["mixing"]
    assert {r.doc_id for r in after} == {r.doc_id for r in before}
    rows = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in after)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_registered():
    import __spark_entry__ as contract

    names = contract.queries()
    assert {n.split("_")[0] for n in names if n.startswith("op")} >= {f"op{i}" for i in range(1, 11)} and "pipeline" in names
    assert set(contract.oracle_sql()) <= set(names)
