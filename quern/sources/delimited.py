"""Delimited text files: reading by parser codes, sampled bulk loads, and the way to Parquet and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.types import Schema
from . import storage
from .database import Database

SEED = 12345


def _parse(code: str, value: Column) -> Column:
    """Parser codes: i integer, d double, s string, t ISO date as a number yyyymmdd."""
    if code == "i":
        return F.trim(value).cast("long")
    if code == "d":
        return F.trim(value).cast("double")
    if code == "t":
        return F.date_format(F.to_date(F.trim(value)), "yyyyMMdd").cast("int")
    if code == "s":
        return value
    raise ValueError(f"no parser {code}")


def read_delimited(spark: SparkSession, path: str, schema: Schema, parsers: str | None = None, separator: str = "|", header: bool = False) -> DataFrame:
    """A file or folder of lines as a schema; ``parsers`` has a code for each column, else types decide."""
    loose = T.StructType([T.StructField(n, T.StringType()) for n in schema.fields])
    raw = spark.read.schema(loose).option("quote", "").option("escape", "").option("header", header).csv(path, sep=separator)
    if parsers is None:
        return schema.conform(raw)
    if len(parsers) != len(schema.fields):
        raise ValueError("one parser code is needed for each column")
    return schema.conform(raw.select(*(_parse(c, F.col(n)).alias(n) for c, n in zip(parsers, schema.fields))))


def write_delimited(df: DataFrame, path: str, separator: str = "|") -> None:
    df.write.option("quote", "").option("escape", "").option("emptyValue", "").csv(path, sep=separator)


def import_file(db: Database, path: str, relation: str, parsers: str | None = None, separator: str = "|", scale: float = 1.0) -> None:
    """Loads a file into a relation, on request about a share ``scale`` of its rows."""
    if not storage.exists(db.spark, path):
        raise FileNotFoundError(path)
    df = read_delimited(db.spark, path, db.schema(relation), parsers, separator)
    db.insert_frame(relation, df if scale >= 1 else df.sample(scale, seed=SEED))


def load_dataset(db: Database, folder: str, tables: dict[str, str], scale: float = 1.0, suffix: str = ".csv") -> None:
    """Loads ``folder/<relation>.csv`` into each relation of ``tables`` (relation -> parser codes)."""
    for relation, parsers in tables.items():
        import_file(db, f"{folder}/{relation}{suffix}", relation, parsers, scale=scale)


def to_binary(df: DataFrame, path: str) -> None:
    df.write.parquet(path)


def from_binary(spark: SparkSession, path: str, schema: Schema) -> DataFrame:
    return spark.read.schema(schema.spark).parquet(path)
