import uuid

import duckdb
import pytest

from quern.llm import compaction as cp
from quern.llm.common import filesystem


@pytest.fixture
def store(spark, tmp_path):
    return cp.Store(spark, f"file://{tmp_path}/s", target=40_000, least=3_000, fan=3)


def frame(spark, a, b, parts=4):
    return spark.range(a, b, numPartitions=parts).selectExpr("id AS doc_id", "sha2(string(id), 512) AS text")


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_tiers_merge_into_target_sized_files(spark, store):
    for k in range(9):
        store.append(frame(spark, 100 * k, 100 * k + 100))
        assert ids(store.read()) == list(range(100 * k + 100))
        store.compact()
        assert ids(store.read()) == list(range(100 * k + 100))
    shards = store.manifest().shards
    assert len(shards) < 9 * 4 and all(s.bytes <= store.target * 1.2 for s in shards)
    assert sum(s.rows for s in shards) == 900
    of = [store.tier(s) for s in shards]
    assert all(of.count(t) < store.fan for t in set(of) - {None})


def data_files(spark, store):
    fs, path = filesystem(spark, f"{store.root}/data")
    found, out = fs.listFiles(path, True), set()
    while found.hasNext():
        p = found.next().getPath()
        if p.getName().endswith(".parquet"):
            out.add(p.toString())
    return out


def test_versions_are_snapshots(spark, store):
    first = store.append(frame(spark, 0, 10)).version
    store.append(frame(spark, 10, 20))
    assert ids(store.read(first)) == list(range(10)) and ids(store.read()) == list(range(20))
    store.vacuum()
    assert store.versions() == [2] and ids(store.read()) == list(range(20))


def test_readers_outlive_compaction(spark, store):
    for k in range(3):
        store.append(frame(spark, 10 * k, 10 * k + 10))
    before, version = store.read(), store.manifest().version
    assert store.compact() > 0
    assert ids(before) == ids(store.read(version)) == ids(store.read()) == list(range(30))
    assert store.vacuum(age_s=1e6) == 0 and ids(before) == list(range(30))  # the files are young
    assert store.vacuum(age_s=0) > 0
    assert ids(store.read()) == list(range(30)) and data_files(spark, store) == {s.path for s in store.manifest().shards}


def test_orphans_go(spark, store):
    store.append(frame(spark, 0, 10))
    frame(spark, 50, 60).write.parquet(f"{store.root}/data/{uuid.uuid4().hex}")
    assert store.vacuum(age_s=0) >= 4 and data_files(spark, store) == {s.path for s in store.manifest().shards}
    assert ids(store.read()) == list(range(10))


def test_arrivals_keep_the_schema(spark, store):
    store.append(frame(spark, 0, 10))
    for bad in (frame(spark, 0, 5).drop("text"), frame(spark, 0, 5).selectExpr("*", "1 AS more"), frame(spark, 0, 5).selectExpr("int(doc_id) AS doc_id", "text")):
        with pytest.raises(ValueError, match="the store has"):
            store.append(bad)
    store.append(frame(spark, 10, 20).select("text", "doc_id"))
    assert store.read().columns == ["doc_id", "text"] and store.read().where("length(text) = 128").count() == 20


def test_one_of_two_writers_wins(spark, store):
    now = store.append(frame(spark, 0, 10))
    new = cp.Manifest(now.version + 1, now.schema, now.shards)
    store.commit(new)
    with pytest.raises(cp.Conflict):
        store.commit(new)
    assert store.append(frame(spark, 10, 12)).version == new.version + 1
    with pytest.raises(cp.Conflict):
        store._change(now.schema, {"no such shard"}, [])
    fs, path = filesystem(spark, f"{store.root}/_manifests")
    assert not [s for s in fs.listStatus(path) if s.getPath().getName().startswith(".") and not s.getPath().getName().endswith(".crc")]


def test_files_without_a_manifest_are_not_read(spark, store):
    store.append(frame(spark, 0, 10))
    frame(spark, 50, 60).write.parquet(f"{store.root}/data/{uuid.uuid4().hex}")  # a writer that died before its commit
    assert ids(store.read()) == list(range(10))


def test_cases(spark, tmp_path):
    rows = [(None, None, 1, 4), (0, "", 2, None), (0, "", 2, None), (3, "é" * 300_000, 3, 4), (11, "x", None, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, arrival int, __quern_arrival int")
    got = cp.shard_documents(docs, f"file://{tmp_path}/a").read()
    assert got.columns == docs.columns and sorted(map(str, got.collect())) == sorted(map(str, docs.collect()))
    assert cp.shard_documents(docs.limit(0), f"file://{tmp_path}/b").read().count() == 0


def test_query_against_sql(spark):
    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.01/documents.parquet'")
    assert sorted(tuple(r) for r in cp.op3(spark, "/root/testdata/sf0.01").collect()) == sorted(con.execute(cp.ORACLE).fetchall())
