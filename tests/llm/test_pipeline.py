import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cpl
from quern.llm import golay_simhash, mil_quality, packing, toxic_segments
from quern.llm.common import table

from .test_resemblance import plain_components

SF = "/root/testdata/sf0.001"


def test_run_against_brute_force(spark):
    rows = {r.doc_id: r.text for r in table(spark, SF, "documents").collect()}
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    toxic, good = toxic_segments.fit(docs, labels), mil_quality.fit(docs, labels)
    left = {i: t for i, t in rows.items() if toxic.probability(toxic_segments.evidence(toxic, t, {})[0]) < 0.5}
    left = {i: t for i, t in left.items() if good.score(t)[0] >= 0.3}
    of = plain_components(left)
    left = {i: t for i, t in left.items() if of[i] == i}
    assert 0 < len(left) < len(rows)
    encode = packing.encoder()
    want = sorted((i, p, s, n) for i, t in left.items() for p, (s, n) in enumerate(packing.cut(len(encode(t)) + 1)))
    got = cpl.run(spark, SF).collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length) for r in got) == want
    bins = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == bins.get(r.sequence_id, 0)
        bins[r.sequence_id] = r.offset + r.length
    assert max(bins.values()) <= 2048


def test_columns_of_clashing_names_keep_their_values(spark):
    names = ["__quern_key", "__quern_text", "component_id", "score", "set"]
    docs = table(spark, SF, "documents").selectExpr("*", *(f"doc_id * 10 + {i} AS {n}" for i, n in enumerate(names)))
    for _, stage in cpl.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        assert out.where(" OR ".join(f"{n} <> doc_id * 10 + {i}" for i, n in enumerate(names))).count() == 0 < out.count()


@pytest.mark.parametrize("rows", [[], [(1, None, "en", "s", 0), (2, "", "en", None, 0), (None, "a b", None, "s", 3), (None, "a b", None, "s", 3), (3, "a b", "en", "s", 3), (3, "a b", "en", "s", 3)]])
def test_stages_keep_the_columns(spark, rows):
    schema = table(spark, SF, "documents").schema
    docs = spark.createDataFrame(rows, schema)
    for name, stage in cpl.STAGES[:-1]:
        assert stage(spark, docs, SF).schema.names == schema.names
    out = cpl.near_duplicates(spark, docs, SF).collect()
    assert sorted(r.doc_id for r in out if r.doc_id is not None) == ([1, 3] if rows else [])
    assert len(out) == (2 if rows else 0)
    assert cpl.pack(spark, docs, SF).count() == len(rows)


@pytest.mark.parametrize("stage", [f for _, f in cpl.STAGES], ids=[n for n, _ in cpl.STAGES])
def test_long_texts_are_handed_over_in_small_batches(spark, stage, monkeypatch):
    def seen(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], names=["rows", "bytes"])

    for module, name in ((toxic_segments, "without_toxic"), (mil_quality, "of_quality"), (golay_simhash, "one_of_each_group"), (packing, "pack")):
        monkeypatch.setattr(module, name, lambda docs, *_: docs.mapInArrow(seen, "rows long, bytes long"))
        monkeypatch.setattr(module, "fit", lambda *_: None, raising=False)
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    docs = spark.range(0, 400, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("abcdefghij"), 6000).alias("text"))  # 24 MB
    got = stage(spark, docs, SF).collect()
    assert sum(r.rows for r in got) == 400 and max(r.bytes for r in got) < 9 << 20


@pytest.mark.parametrize("stage", [f for _, f in cpl.STAGES], ids=[n for n, _ in cpl.STAGES])
def test_stages_read_without_vectored_reads(spark, stage, monkeypatch):
    for module, name in ((toxic_segments, "without_toxic"), (mil_quality, "of_quality"), (golay_simhash, "one_of_each_group"), (packing, "pack")):
        monkeypatch.setattr(module, name, lambda docs, *_: docs)
        monkeypatch.setattr(module, "fit", lambda *_: None, raising=False)
    spark.conf.unset("parquet.hadoop.vectored.io.enabled")
    stage(spark, table(spark, SF, "documents"), SF)
    assert spark.conf.get("parquet.hadoop.vectored.io.enabled") == "false"
