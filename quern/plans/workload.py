"""Runs queries of the catalogue and storage workloads, and times them."""

from __future__ import annotations

import time
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalogue import QUERIES
from .joinorder import PLANNERS, optimize


def timed(df: DataFrame) -> float:
    """Seconds to make all rows and columns of a frame."""
    began = time.perf_counter()
    df.write.format("noop").mode("overwrite").save()
    return time.perf_counter() - began


def run(spark: SparkSession, sf_dir: str, names: Iterable[str] | None = None) -> dict[str, float]:
    return {name: timed(QUERIES[name](spark, sf_dir)) for name in names or QUERIES}


def sequential_scan(df: DataFrame) -> dict[str, float]:
    """Rows, seconds and rows a second of a full scan."""
    n, seconds = df.count(), timed(df)
    return {"tuples": n, "seconds": seconds, "throughput": n / max(seconds, 1e-9)}


def random_access(rows: DataFrame, fraction: float, address: str = "_tid", seed: int = 12345) -> dict[str, float]:
    """Rows, seconds and rows a second of reading a random share of the rows by their addresses, in random order."""
    wanted = rows.select(address).sample(fraction, seed=seed).orderBy(F.rand(seed))
    found = rows.join(wanted, address, "left_semi")
    n, seconds = found.count(), timed(found)
    return {"tuples": n, "seconds": seconds, "throughput": n / max(seconds, 1e-9)}


def compare_planners(query) -> dict[str, dict[str, float]]:
    """Plans considered and seconds of planning of each join-order planner."""
    out = {}
    for name in PLANNERS:
        began = time.perf_counter()
        _, considered = optimize(query, name)
        out[name] = {"plans": considered, "seconds": time.perf_counter() - began}
    return out
