import zlib

from pyspark.sql import functions as F

from quern.llm import common


def test_held_out_is_crc32_of_the_id(spark):
    rows = spark.range(200).select("id", common.held_out(F.col("id")).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 5 == 0) for r in rows)
    assert spark.sql("SELECT CAST(NULL AS BIGINT) AS i").select(common.held_out(F.col("i"))).first()[0] is False


def test_sample_is_bounded_and_keeps_back_held_out_rows(spark):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), "id").alias("text"), F.lit(1).alias("y"))
    labels = spark.range(20_000).select(F.col("id").alias("doc_id"), (F.col("id") % 10 == 0).cast("int").alias("toxic"), F.lit("x").alias("text"))
    got = common.labelled_sample(docs, labels, "toxic", 2000).collect()
    assert 1600 < len(got) <= 2400 and not any(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in got)
    assert all(r.y == (r.doc_id % 10 == 0) and r.text == f"t{r.doc_id}" for r in got)
    assert 800 < sum(r.y for r in got) < 1200  # half of the bound for the rarer class


def test_sample_of_odd_labels(spark):
    docs = spark.createDataFrame([(1, "a"), (1, "b"), (1, "b"), (2, None), (3, "c"), (None, "d")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (3, 0), (3, 1), (None, 1), (4, None), (7, 1), (8, 2)], "doc_id long, toxic int")
    assert sorted(tuple(r) for r in common.labelled_sample(docs, labels, "toxic", 100).select("doc_id", "text", "y").collect()) == [(1, "a", 1), (2, "", 0)]
    assert common.labelled_sample(docs, labels.limit(0), "toxic", 100).count() == 0


def test_slices_bound_rows_and_bytes():
    import pyarrow as pa

    texts = ["a" * n for n in (10, 500, 3, 0, 2000, 7, 7, 7, 90)] + [None]
    batch = pa.RecordBatch.from_arrays([pa.array(range(10)), pa.array(texts)], names=["i", "t"])
    parts = list(common.slices(iter([batch, batch.slice(0, 0)]), rows=3, size=600))
    assert [i for p in parts for i in p.column(0).to_pylist()] == list(range(10))
    sizes = [sum(len(t or "") for t in p.column(1).to_pylist()) for p in parts]
    assert all(p.num_rows <= 3 and (s <= 600 or p.num_rows == 1) for p, s in zip(parts, sizes)) and len(parts) == 5


def test_fresh_names():
    assert common.fresh(["a", "__QUERN_key", "__quern_key_"], "key", "key", "text") == ["__quern_key__", "__quern_key___", "__quern_text"]


def test_materialize_cuts_the_plan(spark):
    df = common.materialize(spark.range(100).groupBy((F.col("id") % 3).alias("k")).count(), "t")
    assert df.count() == 3 and "Aggregate" not in df._jdf.queryExecution().executedPlan().toString()


def test_smaller_batches_of_the_session_stay(spark):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    for own, want in (("64MB", str(common.HANDED_BYTES)), ("1m", "1m")):
        spark.conf.set(name, own)
        common.small_batches(spark)
        assert spark.conf.get(name) == want
    spark.conf.unset(name)
