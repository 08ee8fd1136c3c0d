import pytest

from siftwell.llm.common import scratch
from siftwell.llm.sharding import ShardStore, sharded


def test_append_compact_and_versions(spark, make_docs):
    docs = make_docs([(i, f"text {i} " * 200, f"s{i % 4}") for i in range(400)] + [(1, None), (None, ""), (2, "x" * 100_000)], partitions=12).withColumnRenamed("lang", "shard_group")
    store = ShardStore(spark, scratch(spark, "test"))
    assert store.version() == 0 and store.manifest().collect() == [] and store.compact() == 0
    store.append(docs.where("doc_id < 200"))
    assert store.append(docs.where("doc_id >= 200 OR doc_id IS NULL")) == 2
    small = store.manifest().count()
    assert store.compact(target=20_000) > 2 and store.manifest().count() < small
    assert store.manifest().agg({"n_rows": "sum"}).first()[0] == 403
    assert store.read().select(docs.columns).exceptAll(docs).isEmpty() and docs.exceptAll(store.read().select(docs.columns)).isEmpty()
    assert store.read(1).count() == 202  # an older version is read as it was
    with pytest.raises(Exception, match="exist"):
        store.commit(store.manifest(1), 0, "late", store.schema(1))
    with pytest.raises(ValueError, match="other columns"):
        store.append(docs.select("doc_id"))
    newest = store.version()
    store.vacuum(keep=1)
    assert store.version() == newest and store.read().count() == 403


def test_tiers(spark, make_docs):
    store = ShardStore(spark, scratch(spark, "test"))
    for i in range(5):
        store.append(make_docs([(i, f"{i}" * 3000)], partitions=1))
    plan = store.plan(target=1 << 20)
    assert plan.count() == 5 and plan.select("shard_group").distinct().count() == 1
    assert store.plan(target=1).count() == 0


def test_rows(spark, make_docs):
    docs = make_docs([(1, "a"), (1, "a"), (None, None)])
    rows = sharded(docs, scratch(spark, "test")).collect()
    assert sorted(str(r.doc_id) for r in rows) == ["1", "1", "None"] and {r.shard_rows for r in rows} <= {1, 2, 3}
    assert sharded(docs.limit(0), scratch(spark, "test")).collect() == []


def test_rounds_go_on_until_nothing_is_left(spark, make_docs):
    """Few files a round, many rounds; columns named like the work columns."""
    docs = make_docs([(i, f"t{i} " * 50) for i in range(60)]).selectExpr("*", "'kept' AS _path_of_file", "1 AS path_of_file", "2 AS shard_group")
    store = ShardStore(spark, scratch(spark, "test"))
    for k in range(6):
        store.append(docs.where(f"doc_id % 6 = {k}"))
    before = store.manifest().count()
    version = store.compact(target=1 << 20, files=4)
    assert store.plan(1 << 20).isEmpty() and store.manifest().count() < before and version > 7
    rows = store.read().select(docs.columns)
    assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, docs.collect()))
