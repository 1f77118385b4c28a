"""Builder queries over streams.

A query of stateless operators (where, select, union, joins with a static side) lifts to a streaming DataFrame as it is;
a group-by needs an output mode that its sink supports.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..plans.builder import Query


def read_stream(spark: SparkSession, folder: str, like: DataFrame, name: str = "stream") -> Query:
    """Parquet files that arrive in a folder, as a relation with the schema of ``like``."""
    return Query(spark).from_frame(spark.readStream.schema(like.schema).parquet(folder), name)


def run_available(query: Query, path: str, checkpoint: str) -> StreamingQuery:
    """Takes in what has arrived since the last run, and appends the results as Parquet."""
    out = query.frame().writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    running = out.outputMode("append").trigger(availableNow=True).start()
    running.awaitTermination()
    return running
