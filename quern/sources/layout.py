"""Physical design: bucketed and sorted copies, materialised views, degree of parallelism, statistics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def bucketed(df: DataFrame, name: str, key: list[str], buckets: int) -> DataFrame:
    """A table bucketed and sorted by a key: joins and groupings on the key with the same buckets need no shuffle."""
    df.write.mode("overwrite").format("parquet").bucketBy(buckets, *key).sortBy(*key).saveAsTable(name)
    return df.sparkSession.table(name)


def clustered(df: DataFrame, path: str, key: list[str]) -> DataFrame:
    """A copy in sorted ranges of a key, for pruning by Parquet statistics."""
    df.repartitionByRange(*key).sortWithinPartitions(*key).write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitioned(df: DataFrame, path: str, key: list[str]) -> DataFrame:
    """A copy with a folder for each value of a (coarse) key, for partition pruning."""
    df.repartition(*key).write.mode("overwrite").partitionBy(*key).parquet(path)
    return df.sparkSession.read.parquet(path).select(*df.columns)


def parallel(df: DataFrame, degree: int) -> DataFrame:
    return df.repartition(degree)


def analyze(spark: SparkSession, name: str) -> None:
    """Row count, size and column statistics of a table, for Spark's cost-based optimizer."""
    spark.sql(f"ANALYZE TABLE {name} COMPUTE STATISTICS FOR ALL COLUMNS")


def cost_based(spark: SparkSession, on: bool = True) -> None:
    """Switches Spark's own cost-based join reordering."""
    spark.conf.set("spark.sql.cbo.enabled", str(on).lower())
    spark.conf.set("spark.sql.cbo.joinReorder.enabled", str(on).lower())


class MaterializedViews:
    """Named results, stored on first use, and made again where the files that they were made from have changed.

    Rollups (sums by keys) are found by what they hold: ``rollup`` answers from the stored one with the fewest keys that has
    the keys and sums asked for, and from the base where there is none.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.definitions: dict[str, Callable[[], DataFrame]] = {}
        self.versions: dict[str, int] = {}
        self.sources: dict[str, list[str]] = {}
        self.rollups: dict[str, tuple[str, dict[str, Column], dict[str, Column]]] = {}
        self.bases: dict[str, Callable[[], DataFrame]] = {}

    def define(self, name: str, definition: Callable[[], DataFrame]) -> None:
        if name in self.definitions:
            raise ValueError(f"view {name} exists")
        self.definitions[name] = definition

    def define_rollup(self, name: str, base: str, frame: Callable[[], DataFrame], keys: dict[str, Column], sums: dict[str, Column]) -> None:
        """A view of the sums of a base, a frame known by name, by keys."""
        self.define(name, lambda: frame().groupBy(*(k.alias(n) for n, k in keys.items())).agg(*(F.sum(v).alias(n) for n, v in sums.items())))
        self.rollups[name], self.bases[base] = (base, keys, sums), frame

    def refresh(self, name: str) -> None:
        version, df = self.versions.get(name, 0) + 1, self.definitions[name]()
        self.sources[name] = sorted(df.inputFiles())
        df.write.parquet(f"{self.folder}/{name}/v{version}")
        self.versions[name] = version

    def stale(self, name: str) -> bool:
        """Whether the view isn't stored, or was made from other files than its definition reads now."""
        return name not in self.versions or sorted(self.definitions[name]().inputFiles()) != self.sources[name]

    def frame(self, name: str) -> DataFrame:
        if self.stale(name):
            self.refresh(name)
        return self.spark.read.parquet(f"{self.folder}/{name}/v{self.versions[name]}")

    def rollup(self, base: str, keys: dict[str, Column], sums: dict[str, Column]) -> tuple[DataFrame, str | None]:
        """Sums of a base by keys, and the name of the view that they come from, if any.  Columns are told by their names."""
        fit = [n for n, (b, k, v) in self.rollups.items() if b == base and keys.keys() <= k.keys() and sums.keys() <= v.keys()]
        if not fit:
            rows = self.bases[base]()
            return rows.groupBy(*(k.alias(n) for n, k in keys.items())).agg(*(F.sum(v).alias(n) for n, v in sums.items())), None
        name = min(fit, key=lambda n: (len(self.rollups[n][1]), n))
        return self.frame(name).groupBy(*keys).agg(*(F.sum(n).alias(n) for n in sums)), name
