"""Helpers shared by the training-data operators: table access, shared storage, label folds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import storage
from ..sources.storage import filesystem

#: Bytes of the white space that separates words: \x20 and \x09-\x0D.
ASCII_SPACE = b" \t\n\x0b\x0c\r"
#: Rows, and bytes of their texts, that are Python objects at a time.
MAX_BATCH, MAX_BYTES = 1000, 16 << 20
#: Bytes of rows that a task hands to Python at a time.  Spark holds a batch several times off the heap, and its default is 64 MB.
HANDED_BYTES = 8 << 20


def small_batches(spark: SparkSession, size: int = HANDED_BYTES) -> None:
    """From now on the session hands Python batches of at most about ``size`` bytes, or of one larger row; a smaller limit of its own stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    own = spark.conf.get(name, None)
    if own is None or spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(own) > size:
        spark.conf.set(name, str(size))


def plain_reads(spark: SparkSession) -> None:
    """From now on the session reads Parquet without vectored reads, which take a row group's column at once through a buffer off the heap that each thread keeps."""
    spark.conf.set("parquet.hadoop.vectored.io.enabled", "false")


def slices(batches: Iterator[pa.RecordBatch], rows: int = MAX_BATCH, size: int = MAX_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in parts of at most ``rows`` rows and, beyond a single row, ``size`` bytes of text."""
    for batch in batches:
        n = batch.num_rows
        if n <= rows and batch.nbytes <= size:
            if n:
                yield batch
            continue
        lengths = np.zeros(n, np.int64)
        for c in batch.columns:
            if pa.types.is_string(c.type) or pa.types.is_large_string(c.type) or pa.types.is_binary(c.type):
                lengths += pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(lengths)
        at = 0
        while at < n:
            stop = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, side="right"))
            stop = max(at + 1, min(at + rows, stop))
            yield batch.slice(at, stop - at)
            at = stop


def fresh(taken: list[str], *stems: str) -> list[str]:
    """Names like the stems that no column has, whatever its case."""
    known, out = {c.lower() for c in taken}, []
    for stem in stems:
        name = f"__quern_{stem}"
        while name in known:
            name += "_"
        known.add(name)
        out.append(name)
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in shared storage, removed when the driver ends."""
    return f"{storage.scratch(spark)}/{label}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Writes a result to shared storage and reads it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._quern_path = path
    return out


def discard(*frames: DataFrame) -> None:
    """Removes what ``materialize`` has written for these frames; nothing that is still to be computed may read them."""
    for df in frames:
        path = getattr(df, "_quern_path", None)
        if path:
            storage.delete(df.sparkSession, path)


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept back from learning: crc32 of its id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def text_docs(docs: DataFrame) -> DataFrame:
    """(doc_id, text) with null texts as empty ones; any other columns are left out."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def labelled_sample(docs: DataFrame, labels: DataFrame, column: str, bound: int) -> DataFrame:
    """(doc_id, text, y) of about ``bound`` labelled training rows, at most 1.2 times that.

    ``bound`` is a documented parameter of the two classifiers.  Rows are taken by a hash of the id, so the choice
    doesn't depend on order or partitions.  Held-out documents never get in.  Ids with contradictory labels and rows
    without a label are left out.
    """
    known = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("int").alias("y"))
        .where(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("y1"))
        .where("y = y1").select("doc_id", "y")
    )
    n = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    share = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(7)), F.lit(1 << 20)) / float(1 << 20)
    keep = F.lit(False)
    for y, rows in n.items():  # half of the bound for either class, the rest for the larger
        room = bound // 2 if rows > bound // 2 else rows
        other = n.get(1 - y, 0)
        if other < bound // 2:
            room = min(rows, bound - other)
        keep = keep | ((F.col("y") == y) & (share < room / rows))
    chosen = known.where(keep)
    found = text_docs(docs).join(F.broadcast(chosen), "doc_id")  # at most about ``bound`` rows of 12 bytes
    return found.groupBy("doc_id", "y").agg(F.min("text").alias("text")).select("doc_id", "text", "y")  # repeated rows count once
