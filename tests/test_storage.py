import pytest

from quern.functions.types import Schema
from quern.plans import workload
from quern.sources import delimited, layout, storage
from quern.sources.database import Database, Index, ParquetCatalog

FIELDS = [("id", "int"), ("age", "int"), ("salary", "double")]


@pytest.fixture
def db(spark, tmp_path):
    base = Database(spark, f"file://{tmp_path}/db")
    base.create_relation("employee", FIELDS)
    for i in range(10):
        assert base.insert("employee", i, 2 * i + 20, 5000.0 * (10 + i)) == i
    return base


def ids(df):
    return sorted(r.id for r in df.select("id").collect())


def test_relations(db):
    with pytest.raises(ValueError):
        db.create_relation("employee", FIELDS)
    assert db.relation_names() == ["employee"] and db.has_relation("employee") and not db.has_relation("x")
    assert db.schema("employee").match(Schema("e", FIELDS))
    db.remove_relation("employee")
    assert not db.has_relation("employee")
    with pytest.raises(ValueError):
        db.remove_relation("employee")


def test_tuples_by_address(db):
    assert db.delete("employee", 3) == 1 and db.delete("employee", 3) == 0
    assert db.update("employee", 4, 40, 41, 42.0) == 1
    assert ids(db.table("employee")) == [0, 1, 2, 5, 6, 7, 8, 9, 40]
    assert db.insert("employee", 77, 1, 1.0) == 10  # addresses aren't used again
    assert {r._tid: r.id for r in db.rows("employee").collect()}[10] == 77
    with pytest.raises(ValueError):
        db.insert("employee", 1)
    assert len(list(db.tuples("employee"))) == 10


def test_only_touched_files_are_written_again(spark, db):
    db.insert_frame("employee", spark.range(100, 200, numPartitions=4).selectExpr("int(id) AS id", "int(1) AS age", "double(0) AS salary"))
    before = set(db.relations["employee"]["files"])
    assert db.delete_where("employee", "id == 105") == 1
    after = set(db.relations["employee"]["files"])
    assert len(before - after) == 1 and len(before & after) == len(before) - 1
    assert db.update_where("employee", "id >= 190 and age == 1", {"age": "age + id", "salary": "id * 2"}) == 10
    assert db.table("employee").where("id = 195").first().salary == 390.0 and db.table("employee").count() == 109


def test_indexes(db):
    primary = db.create_index("employee", ["id"], primary=True)
    age = db.create_index("employee", ["age"])
    for bad in (lambda: db.create_index("employee", ["age"]), lambda: db.create_index("employee", ["salary"], primary=True), lambda: db.create_index("employee", ["nope"]), lambda: db.remove_index(99)):
        with pytest.raises(ValueError):
            bad()
    assert db.has_index("employee", ["age"]) and db.match_index("employee", ["salary"]) is None and len(db.indexes_of("employee")) == 2
    assert ids(db.lookup(age, 24)) == [2] and db.lookup_key("employee", 5).age == 30 and db.lookup_key("employee", 55) is None
    assert [(r.age, r._tid) for r in db.scan_index(age).collect()] == [(2 * i + 20, i) for i in range(10)]
    assert db.update_key("employee", (5,), {"age": "24"}) == 1 and ids(db.lookup(age, 24)) == [2, 5]
    with pytest.raises(ValueError, match="unique"):
        db.update_key("employee", (5,), {"id": "6"})
    assert db.delete_by_index(age, 24) == 2 and db.delete_key("employee", 9) == 1
    assert db.update_by_index(age, (20,), {"salary": "salary + 1"}) == 1
    assert ids(db.table("employee")) == [0, 1, 3, 4, 6, 7, 8]
    db.remove_index(age)
    assert db.match_index("employee", ["age"]) is None and db.primary("employee").id == primary


def test_files(db):
    assert sum(r.tuples for r in db.files("employee").collect()) == 10 and db.files("employee").first().bytes > 0
    db.create_relation("empty", FIELDS)
    assert db.files("empty").count() == 0 and db.table("empty").count() == 0
    assert db.index(db.create_index("employee", ["age"])).key == ["age"]


def test_unique_index_needs_unique_keys(db):
    db.insert("employee", 1, 1, 1.0)
    with pytest.raises(ValueError):
        db.create_index("employee", ["id"], unique=True)


def test_unique_keys_on_insert(spark, db):
    db.create_index("employee", ["id"], primary=True)
    with pytest.raises(ValueError, match="unique"):
        db.insert("employee", 3, 1, 1.0)
    db.insert("employee", 60, 1, 1.0)
    with pytest.raises(ValueError, match="unique"):
        db.insert("employee", 60, 2, 2.0)  # still held
    for rows in ([(5, 0, 0.0)], [(70, 0, 0.0), (70, 0, 0.0)], [(60, 0, 0.0)]):
        with pytest.raises(ValueError, match="unique"):
            db.insert_frame("employee", spark.createDataFrame(rows, "id int, age int, salary double"))
    assert ids(db.table("employee")) == [*range(10), 60] and db.lookup_key("employee", 60).age == 1


def test_addresses_after_a_restart(spark, db):
    db.insert_frame("employee", spark.range(100, 140, numPartitions=4).selectExpr("int(id) AS id", "1 AS age", "0.5D AS salary"))
    again = Database(spark, db.folder)  # without a close
    for i in range(5):
        again.insert("employee", 200 + i, 1, 1.0)
    found = [r._tid for r in again.rows("employee").collect()]
    assert len(found) == len(set(found)) == 55


def test_frames_outlive_changes_until_vacuum(db):
    db.checkpoint()
    before = db.table("employee")
    db.delete_where("employee", "id < 5")
    db.cluster("employee", ["age"])
    assert ids(before) == list(range(10)) and ids(db.table("employee")) == [5, 6, 7, 8, 9]
    assert db.vacuum("employee") > 0 and db.vacuum("employee") == 0 and ids(db.table("employee")) == [5, 6, 7, 8, 9]


def test_truncate_and_store(spark, db):
    db.truncate("employee")
    assert db.table("employee").count() == 0 == db.direct("employee").count() and db.insert("employee", 1, 2, 3.0) == 10
    name = db.store(db.query().from_table("employee").where("id == 1"))
    assert ids(db.table(name)) == [1] and db.store(db.table("employee"), "kept") == "kept"
    db.close()
    assert Database(spark, db.folder).relation_names() == ["employee", "kept"]


def test_add_index(db):
    assert db.add_index(Index(7, "employee", ["age"])) == 7 and db.create_index("employee", ["id"], primary=True) == 8
    for bad in (Index(7, "employee", ["salary"]), Index(9, "employee", ["age"]), Index(9, "employee", ["salary"], True, True), Index(9, "employee", ["nope"])):
        with pytest.raises(ValueError):
            db.add_index(bad)


def test_views_are_made_again_when_stale(db):
    views = layout.MaterializedViews(db.spark, db.folder + "/views")
    views.define("ages", lambda: db.table("employee").where("age > 30"))
    assert views.stale("ages") and views.frame("ages").count() == 4 and not views.stale("ages")
    db.delete_where("employee", "age == 38")
    assert views.stale("ages") and views.frame("ages").count() == 3 and views.versions["ages"] == 2


def test_restart(spark, db):
    db.create_index("employee", ["id"], primary=True)
    db.cluster("employee", ["age"])
    db.close()
    again = Database(spark, db.folder)
    assert ids(again.table("employee")) == list(range(10)) and again.lookup_key("employee", 3).age == 26
    assert again.insert("employee", 50, 1, 1.0) == 10
    assert again.sql("SELECT max(id) AS m FROM employee").first().m == 50


def test_attach_and_detach(spark, db, tmp_path):
    path = f"file://{tmp_path}/outside"
    spark.range(5).selectExpr("int(id) AS id").write.parquet(path)
    db.attach_relation("outside", path)
    assert ids(db.table("outside")) == list(range(5)) and db.delete_where("outside", "id > 2") == 2
    assert spark.read.parquet(path).count() == 5
    files = list(db.relations["employee"]["files"])
    db.remove_relation("employee", keep_files=True)
    assert all(storage.exists(spark, f) for f in files)


def test_functions_for_sql(spark, db):
    import pandas as pd

    def double(x: pd.Series) -> pd.Series:
        return x * 2

    db.register_function("twice", double, "long")
    assert db.sql("SELECT sum(twice(id)) AS s FROM employee").first().s == 90


def test_delimited_text(spark, db, tmp_path):
    (tmp_path / "employee.csv").write_text("7|1996-01-01|1.5\n8|2001-12-31|2\n")
    db.create_relation("dated", [("id", "int"), ("day", "int"), ("x", "double")])
    delimited.import_file(db, f"file://{tmp_path}/employee.csv", "dated", "itd")
    assert sorted(tuple(r) for r in db.table("dated").collect()) == [(7, 19960101, 1.5), (8, 20011231, 2.0)]
    with pytest.raises(FileNotFoundError):
        delimited.load_dataset(db, f"file://{tmp_path}", {"employee_missing": "i"})
    spark.range(1000).selectExpr("id", "id AS age", "1.0 AS salary").write.csv(f"file://{tmp_path}/many.csv", sep="|")
    db.create_relation("many", FIELDS)
    delimited.load_dataset(db, f"file://{tmp_path}", {"many": "iid"}, scale=0.3)
    assert 200 < db.table("many").count() < 400


def test_layouts(spark, tmp_path):
    df = spark.range(1000).selectExpr("id", "id % 10 AS k")
    for name in ("quern_a", "quern_b"):
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        layout.bucketed(df.withColumnsRenamed({"id": f"id_{name}", "k": f"k_{name}"}), name, [f"k_{name}"], 4)
    a, b = spark.table("quern_a"), spark.table("quern_b")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = a.join(b, a.k_quern_a == b.k_quern_b)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Exchange" not in plan  # buckets meet without a shuffle
    layout.analyze(spark, "quern_a")
    assert "1000 rows" in str(spark.sql("DESCRIBE EXTENDED quern_a").where("col_name = 'Statistics'").first())
    assert layout.clustered(df, f"file://{tmp_path}/c", ["k"]).count() == layout.partitioned(df, f"file://{tmp_path}/p", ["k"]).count() == 1000
    assert layout.parallel(df, 3).rdd.getNumPartitions() == 3
    views = layout.MaterializedViews(spark, f"file://{tmp_path}/v")
    views.define("v", lambda: df.groupBy("k").count())
    assert views.frame("v").count() == 10
    views.refresh("v")
    assert views.frame("v").count() == 10 and views.versions == {"v": 2}
    with pytest.raises(ValueError):
        views.define("v", lambda: df)


def test_workloads(spark, db):
    assert workload.sequential_scan(db.table("employee"))["tuples"] == 10
    assert 0 < workload.random_access(spark.range(1000).withColumnRenamed("id", "_tid"), 0.5)["tuples"] < 1000
    assert set(workload.run(spark, "/root/testdata/sf0.001", ["scan_region"])) == {"scan_region"}
    catalog = ParquetCatalog(spark, "/root/testdata/sf0.001")
    assert catalog.has_relation("region") and not catalog.has_relation("nope")


def test_streams(spark, tmp_path):
    from quern.streaming import continuous

    df = spark.range(10).selectExpr("id", "id * 2 AS age")
    df.write.parquet(f"file://{tmp_path}/in")
    q = continuous.read_stream(spark, f"file://{tmp_path}/in", df).where("age < 10").select({"id": ("id", "long")})
    run = lambda: continuous.run_available(q, f"file://{tmp_path}/out", f"file://{tmp_path}/cp")
    run()
    df.write.mode("append").parquet(f"file://{tmp_path}/in")
    run()
    assert ids(spark.read.parquet(f"file://{tmp_path}/out")) == [0, 0, 1, 1, 2, 2, 3, 3, 4, 4]


def test_large_row_groups_keep_no_buffers_off_the_heap(spark, tmp_path):
    import numpy as np
    import pyarrow as pa
    import pyarrow.parquet as pq

    n = 4_000_000
    pq.write_table(pa.table({"x": np.random.default_rng(1).integers(0, 1 << 62, n)}), f"{tmp_path}/t.parquet", row_group_size=n, use_dictionary=False)
    beans = spark._jvm.java.lang.management.ManagementFactory.getPlatformMXBeans(spark._jvm.java.lang.Class.forName("java.lang.management.BufferPoolMXBean"))
    pool = next(b for b in beans if b.getName() == "direct")
    before = pool.getMemoryUsed()
    assert ParquetCatalog(spark, f"file://{tmp_path}").table("t").where("x % 2 = 0").count() > 0
    assert pool.getMemoryUsed() - before < 8 << 20  # the column has 32 MB
