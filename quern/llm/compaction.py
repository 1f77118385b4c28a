"""Sharding by size-tiered compaction over an immutable store with versioned manifests.

A store is a folder in shared storage.  ``append`` writes an arrival as small Parquet shards.  ``compact`` merges shards
of a tier (sizes within a factor of ``FAN``) once there are ``FAN`` of them, into files of up to the target size: the
reader packs whole shards into its splits, and each split is written as one file, so a merge needs no shuffle and no
driver loop over files.  Shards of at least half the target are final.

Every change is a new manifest ``_manifests/v<number>.json``: written under another name and renamed without overwrite,
so one of two writers of a version wins and readers see whole manifests only.  The loser takes the winner's version and
tries again.  The rename is atomic on HDFS and like stores; on local files Hadoop looks first and renames then, so
there one writer at a time is safe.  Shards never change, and every version stays readable until ``vacuum`` is asked to
remove old ones.  A task that is lost is run again by Spark's commit protocol; files that a dead driver has left are in no
manifest, are never read, and go with a ``vacuum`` once they are older than its age.
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import filesystem, fresh, scratch, table

TARGET, LEAST, FAN = 128 << 20, 1 << 20, 8
#: Files younger than this may be a writer's that has not committed yet.
AGE_S = 24 * 3600.0


@dataclass(frozen=True)
class Shard:
    path: str
    rows: int
    bytes: int


@dataclass(frozen=True)
class Manifest:
    version: int
    schema: str
    shards: tuple[Shard, ...]


class Conflict(RuntimeError):
    """Another writer has committed this version."""


class Store:
    """A shard store at ``root``.  ``target``: bytes of a final shard; ``least``: upper size of the lowest tier."""

    def __init__(self, spark: SparkSession, root: str, target: int = TARGET, least: int = LEAST, fan: int = FAN):
        self.spark, self.root, self.target, self.least, self.fan = spark, root.rstrip("/"), target, least, fan
        # merges need their own split sizes; a session beside the caller's keeps them apart
        self.side = spark.newSession()
        self.side.conf.set("spark.sql.files.maxPartitionBytes", str(target))
        self.side.conf.set("spark.sql.files.openCostInBytes", "0")
        self.side.conf.set("spark.sql.files.minPartitionNum", "1")

    # ---- manifests

    def versions(self) -> list[int]:
        fs, folder = filesystem(self.spark, f"{self.root}/_manifests")
        if not fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(folder)]
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def manifest(self, version: int | None = None) -> Manifest | None:
        """A version's manifest, by default the newest; None for a new store."""
        if version is None:
            known = self.versions()
            if not known:
                return None
            version = known[-1]
        fs, path = filesystem(self.spark, self._manifest_path(version))
        stream = fs.open(path)
        try:
            raw = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        found = json.loads(raw)
        return Manifest(found["version"], found["schema"], tuple(Shard(**s) for s in found["shards"]))

    def _manifest_path(self, version: int) -> str:
        return f"{self.root}/_manifests/v{version:012d}.json"

    def commit(self, manifest: Manifest) -> None:
        """Publishes a manifest, or raises Conflict if its version exists."""
        fs, temporary = filesystem(self.spark, f"{self.root}/_manifests/.{uuid.uuid4().hex}")
        stream = fs.create(temporary, False)
        stream.write(bytearray(json.dumps({"version": manifest.version, "schema": manifest.schema, "shards": [asdict(s) for s in manifest.shards]}).encode()))
        stream.close()
        jvm = self.spark.sparkContext._jvm
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(temporary.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        no_overwrite = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(temporary, jvm.org.apache.hadoop.fs.Path(self._manifest_path(manifest.version)), no_overwrite)
        except Exception as e:
            fs.delete(temporary, False)
            if "FileAlreadyExists" in str(e):
                raise Conflict(f"version {manifest.version} exists") from e
            raise

    def _change(self, schema: str, remove: set[str], add: list[Shard]) -> Manifest:
        """Commits a change on the newest version, again where another writer was first."""
        for _ in range(20):
            now = self.manifest()
            shards = now.shards if now else ()
            if not remove <= {s.path for s in shards}:
                raise Conflict("another writer has replaced shards that this change removes")
            new = Manifest((now.version if now else 0) + 1, schema, (*(s for s in shards if s.path not in remove), *add))
            try:
                self.commit(new)
                return new
            except Conflict:
                continue
        raise Conflict("too many writers")

    # ---- shards

    def _shards(self, folder: str, schema: T.StructType) -> list[Shard]:
        """The non-empty shards of a folder.  Rows come from the files' footers; one row a file reaches the driver."""
        fs, path = filesystem(self.spark, folder)
        files = {s.getPath().getName(): (s.getPath().toString(), s.getLen()) for s in fs.listStatus(path) if s.getPath().getName().endswith(".parquet")}
        if not files:
            return []
        counted = self.spark.read.schema(schema).parquet(folder).groupBy(F.col("_metadata.file_name").alias("name")).agg(F.count("*").alias("n")).collect()
        return sorted((Shard(files[r["name"]][0], r["n"], files[r["name"]][1]) for r in counted), key=lambda s: s.path)

    def _as_stored(self, df: DataFrame) -> DataFrame:
        """The frame with its columns as the store has them; refuses other names or types."""
        now = self.manifest()
        if now is None:
            return df
        schema = T.StructType.fromJson(json.loads(now.schema))
        kinds = lambda fields: {f.name: f.dataType.simpleString() for f in fields}
        if kinds(df.schema) != kinds(schema):
            raise ValueError(f"the store has {schema.simpleString()}, the arrival {df.schema.simpleString()}")
        return df.select(*(F.col(f"`{n}`") for n in schema.names))

    def append(self, df: DataFrame) -> Manifest:
        """Adds an arrival: one small shard from each task that has rows.

        The first arrival gives the store its columns; a later one with other names or types is refused, their order
        doesn't matter.  Nulls, empty and very long values and repeated rows are kept as they are.  An empty arrival makes a version
        without new shards.
        """
        df = self._as_stored(df)
        folder = f"{self.root}/data/{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(folder)
        return self._change(df.schema.json(), set(), self._shards(folder, df.schema))

    def append_by(self, df: DataFrame, arrival: F.Column) -> list[Manifest]:
        """Adds several arrivals, one version each in order of ``arrival`` (an integer), whose shards one job has written."""
        df = self._as_stored(df)
        (name,) = fresh(df.columns, "arrival")
        folder = f"{self.root}/data/{uuid.uuid4().hex}"
        df.withColumn(name, arrival).write.option("compression", "zstd").option("maxRecordsPerFile", 0).partitionBy(name).parquet(folder)
        fs, path = filesystem(self.spark, folder)
        own = sorted((s.getPath().toString() for s in fs.listStatus(path) if name in s.getPath().getName()), key=lambda p: int(p.rpartition("=")[2]))
        out = []
        for p in own:
            out.append(self._change(df.schema.json(), set(), self._shards(p, df.schema)))
            self.compact()
        return out or [self._change(df.schema.json(), set(), [])]

    def tier(self, shard: Shard) -> int | None:
        """Tier of a shard by its size; None for a final one."""
        if 2 * shard.bytes >= self.target:
            return None
        t, top = 0, self.least
        while shard.bytes > top:
            t, top = t + 1, top * self.fan
        return t

    def compact(self) -> int:
        """Merges tiers that are full until none is left; returns the number of merges."""
        merges, stuck = 0, set()
        while (now := self.manifest()) is not None:
            tiers: dict[int, list[Shard]] = {}
            for s in now.shards:
                if (t := self.tier(s)) is not None and t not in stuck:
                    tiers.setdefault(t, []).append(s)
            full = sorted(t for t, own in tiers.items() if len(own) >= self.fan)
            if not full:
                break
            old = tiers[full[0]]
            schema = T.StructType.fromJson(json.loads(now.schema))
            folder = f"{self.root}/data/{uuid.uuid4().hex}"
            self.side.read.schema(schema).parquet(*[s.path for s in old]).write.option("compression", "zstd").parquet(folder)
            new = self._shards(folder, schema)
            if sum(s.rows for s in new) != sum(s.rows for s in old):
                raise RuntimeError("a merge has lost rows")
            fs, path = filesystem(self.spark, folder)
            if len(new) >= len(old):  # the session's splits don't allow larger files: leave this tier as it is
                fs.delete(path, True)
                stuck.add(full[0])
                continue
            try:
                self._change(now.schema, {s.path for s in old}, new)
            except Conflict:  # another writer has merged these shards: look again
                fs.delete(path, True)
                continue
            merges += 1
        return merges

    def vacuum(self, keep: int = 1, age_s: float = AGE_S) -> int:
        """Removes all versions but the newest ``keep``, and the files older than ``age_s`` seconds that no version left names.

        Readers of the removed versions must be done.  Returns the number of files removed.
        """
        known = self.versions()
        needed = {s.path for v in known[-keep:] for s in self.manifest(v).shards}
        for v in known[:-keep]:
            fs, path = filesystem(self.spark, self._manifest_path(v))
            fs.delete(path, False)
        fs, folder = filesystem(self.spark, f"{self.root}/data")
        if not fs.exists(folder):
            return 0
        removed, last = 0, (time.time() - age_s) * 1000
        found = fs.listFiles(folder, True)
        while found.hasNext():
            status = found.next()
            if status.getPath().toString() not in needed and status.getModificationTime() <= last:
                removed += bool(fs.delete(status.getPath(), False))
        return removed

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, by default the newest; older ones can be read until ``vacuum`` removes them."""
        found = self.manifest(version)
        if found is None:
            raise FileNotFoundError(f"no manifest under {self.root}")
        schema = T.StructType.fromJson(json.loads(found.schema))
        if not found.shards:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[s.path for s in found.shards])


#: Arrivals that the query deals the documents into.
ARRIVALS = 8


def shard_documents(docs: DataFrame, root: str, arrivals: int = ARRIVALS, **sizes: int) -> Store:
    """Takes ``docs`` in as arrivals by doc_id modulo ``arrivals`` (rows without one in the first), compacting after each.

    All columns and rows are kept as they are: nulls, empty and long texts, repeated rows.  An empty table gives a
    manifest without shards.
    """
    store = Store(docs.sparkSession, root, **sizes)
    store.append_by(docs, F.coalesce(F.pmod(F.col("doc_id").cast("long"), F.lit(arrivals)), F.lit(0)).cast("int"))
    return store


def op3(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    store = shard_documents(docs, scratch(spark, "shards"))
    return store.read().select("doc_id", F.coalesce(F.pmod("doc_id", F.lit(ARRIVALS)), F.lit(0)).cast("int").alias("arrival"), "lang", "source", "n_chars", F.md5(F.col("text").cast("binary")).alias("text_md5"))


ORACLE = f"SELECT doc_id, (doc_id % {ARRIVALS})::INTEGER AS arrival, lang, source, n_chars, md5(text) AS text_md5 FROM documents"
