"""Files in whatever store Hadoop reaches."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import SparkSession


def filesystem(spark: SparkSession, path: str):
    """Hadoop's (FileSystem, Path) of a path."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = filesystem(spark, path)
    return fs.exists(p)


def read_text(spark: SparkSession, path: str) -> str:
    fs, p = filesystem(spark, path)
    stream = fs.open(p)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Writes under another name, then renames over the path, so that readers see one version or the other."""
    fs, temporary = filesystem(spark, f"{path}.{uuid.uuid4().hex}")
    stream = fs.create(temporary, False)
    stream.write(bytearray(text.encode()))
    stream.close()
    jvm = spark.sparkContext._jvm
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(temporary.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    context.rename(temporary, jvm.org.apache.hadoop.fs.Path(path), options)


def delete(spark: SparkSession, path: str) -> None:
    fs, p = filesystem(spark, path)
    fs.delete(p, True)


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` where the session has one.

    Where it is unset a local session gets ``/tmp/checkpoints``, and a cluster its warehouse, which must then be in a store
    that all nodes reach: a ``file:`` path is refused.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if spark.sparkContext.master.startswith("local") and not spark.sparkContext.master.startswith("local-cluster"):
        return "file:///tmp/checkpoints"
    root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    fs, _ = filesystem(spark, root)
    if fs.getScheme() == "file":
        raise ValueError("set spark.checkpoint.dir to a folder that all nodes share: the warehouse is local to each")
    return f"{root}/_shared"


#: Scratch folders of this process, removed when it ends.
_made: dict[str, SparkSession] = {}


def _drop_all() -> None:
    for path, spark in _made.items():
        try:
            delete(spark, path)
        except Exception:  # the session may be gone already
            pass


atexit.register(_drop_all)


def scratch(spark: SparkSession) -> str:
    """A new folder in shared storage, removed when the driver ends."""
    path = f"{shared_root(spark)}/quern-{uuid.uuid4().hex}"
    _made[path] = spark
    return path
