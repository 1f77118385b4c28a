"""Databases: named relations with schemas, tuple-level changes, indexes and a catalog that survives restarts.

A relation is a list of immutable Parquet files with a persistent row address ``_tid``.  Changes are copy-on-write by
file: only files that hold an affected row are read and written again; replaced files stay for frames that were made before, until
``vacuum``.  An index is an entry in a registry (key, whether unique or primary); lookups are predicates that Parquet statistics prune
on a relation clustered by its key, and unique keys are checked before anything is added or changed.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expressions import compile_predicate, compile_scalar
from ..functions.types import Schema
from ..plans.builder import Query
from . import storage

TID = "_tid"
#: Inserted tuples that are held before they are written.
BUFFER = 10_000
#: How tables are read: Parquet's vectored reads take a row group's column at once through a buffer off the heap, which each thread keeps.
READ = {"parquet.hadoop.vectored.io.enabled": "false"}


@dataclass
class Index:
    id: int
    relation: str
    key: list[str]
    unique: bool = False
    primary: bool = False


class ParquetCatalog:
    """A read-only database over a folder of Parquet tables."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self.indexes = spark, folder, {}
        self._tables: dict[str, DataFrame] = {}

    def query(self) -> Query:
        return Query(self)

    def has_relation(self, name: str) -> bool:
        return storage.exists(self.spark, f"{self.folder}/{name}.parquet")

    def table(self, name: str) -> DataFrame:
        """A table's frame, made once: its schema and file list are read on the first use."""
        if name not in self._tables:
            self._tables[name] = self.spark.read.options(**READ).parquet(f"{self.folder}/{name}.parquet")
        return self._tables[name]

    def schema(self, name: str) -> Schema:
        return Schema.of(name, self.table(name))

    def create_index(self, relation: str, key: list[str], unique: bool = False) -> int:
        index = Index(len(self.indexes) + 1, relation, key, unique)
        self.indexes[index.id] = index
        return index.id


class Database:
    """A writable database under ``folder``; opens the catalog that is there, if any."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.relations: dict[str, dict] = {}
        self.indexes: dict[int, Index] = {}
        self._buffers: dict[str, list[tuple]] = {}
        if storage.exists(spark, self._catalog):
            self._restore()

    # ---- catalog

    @property
    def _catalog(self) -> str:
        return f"{self.folder}/catalog.json"

    def _restore(self) -> None:
        found = json.loads(storage.read_text(self.spark, self._catalog))
        self.relations = found["relations"]
        self.indexes = {i["id"]: Index(**i) for i in found["indexes"]}

    def checkpoint(self) -> None:
        """Writes held tuples and the catalog."""
        for name in list(self._buffers):
            self._flush(name)
        storage.write_text(self.spark, self._catalog, json.dumps({"relations": self.relations, "indexes": [asdict(i) for i in self.indexes.values()]}))

    def close(self) -> None:
        """Drops temporary relations and writes the rest."""
        for name in [n for n, r in self.relations.items() if r.get("temporary")]:
            self.remove_relation(name)
        self.checkpoint()

    def query(self) -> Query:
        return Query(self)

    def sql(self, text: str) -> DataFrame:
        """SQL over this database's relations."""
        for name in self.relations:
            self.table(name).createOrReplaceTempView(name)
        return self.spark.sql(text)

    def create_relation(self, name: str, fields: list[tuple[str, str]]) -> Schema:
        if name in self.relations:
            raise ValueError(f"relation {name} exists")
        schema = Schema(name, fields)
        if TID in schema.fields:
            raise ValueError(f"{TID} is the row address")
        self.relations[name] = {"schema": schema.to_json(), "files": [], "next": 0, "external": False}
        self.checkpoint()
        return schema

    def remove_relation(self, name: str, keep_files: bool = False) -> None:
        """Drops a relation with its indexes; an attached one, or on request, keeps its files."""
        relation = self._relation(name)
        self.indexes = {k: i for k, i in self.indexes.items() if i.relation != name}
        del self.relations[name]
        self._buffers.pop(name, None)
        self.checkpoint()
        if not relation["external"] and not keep_files:
            for f in [*relation["files"], *relation.get("replaced", [])]:
                storage.delete(self.spark, f)

    def truncate(self, name: str) -> None:
        """Takes all rows out of a relation; its schema, indexes and next address stay."""
        self._buffers.pop(name, None)
        self._replace(name, [], self._relation(name)["files"])

    def vacuum(self, name: str) -> int:
        """Removes a relation's replaced files; frames that read them must be done.  Returns how many."""
        old = self._relation(name).pop("replaced", [])
        self.checkpoint()
        for f in old:
            storage.delete(self.spark, f)
        return len(old)

    def store(self, frame: DataFrame | Query, name: str | None = None) -> str:
        """Keeps an operator's output as a relation; without a name as a temporary one, which ``close`` drops.  Returns the name."""
        df = frame.frame() if isinstance(frame, Query) else frame
        temporary, name = name is None, name or f"temporary_{uuid.uuid4().hex}"
        self.create_relation(name, [(f, str(t)) for f, t in Schema.of(name, df).types.items()])
        self.relations[name]["temporary"] = temporary
        self.insert_frame(name, df)
        return name

    def attach_relation(self, name: str, folder: str) -> Schema:
        """Takes Parquet files as they are as a relation; row addresses are given by a rewrite on the first change."""
        if name in self.relations:
            raise ValueError(f"relation {name} exists")
        df = self.spark.read.parquet(folder)
        schema = Schema.of(name, df.drop(TID))
        if TID in df.columns:
            files, top = list(df.inputFiles()), (df.agg(F.max(TID)).first()[0] or 0) + 1
            self.relations[name] = {"schema": schema.to_json(), "files": files, "next": top, "external": True}
        else:
            self.relations[name] = {"schema": schema.to_json(), "files": [], "next": 0, "external": False}
            self.insert_frame(name, df)
        self.checkpoint()
        return schema

    def has_relation(self, name: str) -> bool:
        return name in self.relations

    def relation_names(self) -> list[str]:
        return list(self.relations)

    def schema(self, name: str) -> Schema:
        return Schema.from_json(self._relation(name)["schema"])

    def _relation(self, name: str) -> dict:
        if name not in self.relations:
            raise ValueError(f"no relation {name}")
        return self.relations[name]

    # ---- reading

    def _stored(self, name: str) -> T.StructType:
        return T.StructType([T.StructField(TID, T.LongType()), *self.schema(name).spark])

    def rows(self, name: str) -> DataFrame:
        """A relation with its row addresses."""
        self._flush(name)
        files = self._relation(name)["files"]
        if not files:
            return self.spark.createDataFrame([], self._stored(name))
        return self.spark.read.schema(self._stored(name)).parquet(*files)

    def table(self, name: str) -> DataFrame:
        return self.rows(name).drop(TID)

    def direct(self, name: str) -> DataFrame:
        """A plain scan of the files as they are, without held tuples; no pages are kept in memory by either scan."""
        return self._stored_rows(name).drop(TID) if self._relation(name)["files"] else self.spark.createDataFrame([], self.schema(name).spark)

    def tuples(self, name: str) -> Iterator[Row]:
        """Rows one partition at a time."""
        return self.table(name).toLocalIterator()

    def batches(self, name: str, f, schema: str) -> DataFrame:
        """Applies a function of an iterator of pandas batches to each partition."""
        return self.table(name).mapInPandas(f, schema)

    def files(self, name: str) -> DataFrame:
        """(path, bytes, tuples) of each file of a relation, from file metadata alone."""
        rows = self.rows(name)
        if not self._relation(name)["files"]:
            return self.spark.createDataFrame([], "path string, bytes long, tuples long")
        return rows.groupBy(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("bytes")).agg(F.count("*").alias("tuples"))

    # ---- changes

    def insert(self, name: str, *values) -> int:
        """Adds a tuple and returns its address.  Tuples are written in batches."""
        relation = self._relation(name)
        fields = self.schema(name).fields
        if len(values) != len(fields):
            raise ValueError(f"{name} has {len(fields)} fields")
        held = self._buffers.setdefault(name, [])
        for index in self._unique(name):
            at = [fields.index(c) for c in index.key]
            key = tuple(values[i] for i in at)
            if any(tuple(h[i + 1] for i in at) == key for h in held) or relation["files"] and not self._stored_rows(name).where(self._match(index, key)).isEmpty():
                raise ValueError(f"{', '.join(index.key)} of {name} isn't unique")
        tid = relation["next"]
        relation["next"] += 1
        held.append((tid, *values))
        if len(held) >= BUFFER:
            self._flush(name)
        return tid

    def _flush(self, name: str) -> None:
        held = self._buffers.pop(name, None)
        if held:
            schema = self.schema(name)
            wide = {T.ShortType(): T.LongType(), T.IntegerType(): T.LongType(), T.FloatType(): T.DoubleType()}
            loose = T.StructType([T.StructField(TID, T.LongType()), *(T.StructField(f.name, wide.get(f.dataType, f.dataType)) for f in schema.spark)])
            df = self.spark.createDataFrame(held, loose)
            self._add(name, df.select(TID, *(t.cast(F.col(n)).alias(n) for n, t in schema.types.items())))

    def insert_frame(self, name: str, df: DataFrame) -> None:
        """Adds a frame's rows, matched to the fields by name; none, where a unique key would occur twice."""
        self._flush(name)
        relation, schema = self._relation(name), self.schema(name)
        files = self._write(name, schema.conform(df).withColumn(TID, F.lit(relation["next"]) + F.monotonically_increasing_id()).select(TID, *schema.fields))
        if not files:
            return
        new = self.spark.read.schema(self._stored(name)).parquet(*files)  # as written: a frame may give other rows when it is run again
        try:
            self._check_unique(name, new, [])
        except ValueError:
            for f in files:
                storage.delete(self.spark, f)
            raise
        top = new.agg(F.max(TID)).first()[0]
        relation["next"] = max(relation["next"], (top if top is not None else -1) + 1)
        relation["files"] += files
        self.checkpoint()

    def _unique(self, name: str) -> list[Index]:
        return [i for i in self.indexes.values() if i.relation == name and i.unique]

    def _stored_rows(self, name: str) -> DataFrame:
        return self.spark.read.schema(self._stored(name)).parquet(*self._relation(name)["files"])

    def _replace(self, name: str, new: list[str], old: list[str]) -> None:
        """Puts new files in place of old ones, which stay on disk until ``vacuum``; an attached relation's are left alone."""
        relation = self._relation(name)
        relation["files"] = [f for f in relation["files"] if f not in old] + new
        if not relation["external"]:
            relation["replaced"] = relation.get("replaced", []) + list(old)
        self.checkpoint()

    def _write(self, name: str, df: DataFrame) -> list[str]:
        folder = f"{self.folder}/{name}/{uuid.uuid4().hex}"
        df.write.parquet(folder)
        return list(self.spark.read.schema(self._stored(name)).parquet(folder).inputFiles())

    def _add(self, name: str, df: DataFrame) -> None:
        self._relation(name)["files"] += self._write(name, df)
        self.checkpoint()

    def _rewrite(self, name: str, hit: Column, change: dict[str, Column] | None) -> int:
        """Deletes (``change`` None) or changes the rows where ``hit``; returns how many.  Other files stay as they are."""
        relation, rows = self._relation(name), self.rows(name)
        hit = F.coalesce(hit, F.lit(False))
        found = rows.where(hit).groupBy(F.col("_metadata.file_path").alias("f")).agg(F.count("*").alias("n")).collect() if relation["files"] else []  # one row for each file
        if not found:
            return 0
        norm = lambda p: p.split(":", 1)[-1].replace("///", "/").replace("//", "/")
        touched = {norm(r["f"]) for r in found}
        old = [f for f in relation["files"] if norm(f) in touched]
        part = self.spark.read.schema(self._stored(name)).parquet(*old)
        if change is None:
            new = part.where(~hit)
        else:
            types = self.schema(name).types
            new = part.select(TID, *((F.when(hit, types[c].cast(change[c])).otherwise(F.col(c)) if c in change else F.col(c)).alias(c) for c in types))
        if change is not None:
            self._check_unique(name, new, old)
        self._replace(name, self._write(name, new), old)
        return sum(r["n"] for r in found)

    def delete(self, name: str, tid: int) -> int:
        return self._rewrite(name, F.col(TID) == tid, None)

    def update(self, name: str, tid: int, *values) -> int:
        return self._rewrite(name, F.col(TID) == tid, {c: F.lit(v) for c, v in zip(self.schema(name).fields, values, strict=True)})

    def delete_where(self, name: str, predicate: str) -> int:
        return self._rewrite(name, compile_predicate(predicate, self.rows(name)), None)

    def update_where(self, name: str, predicate: str, values: dict[str, str]) -> int:
        """``values``: field -> expression over the row before the change."""
        rows = self.rows(name)
        return self._rewrite(name, compile_predicate(predicate, rows), {c: compile_scalar(x, rows) for c, x in values.items()})

    # ---- indexes

    def create_index(self, relation: str, key: list[str], unique: bool = False, primary: bool = False) -> int:
        fields = self.schema(relation).project(relation, key).fields
        return self.add_index(Index(max(self.indexes, default=0) + 1, relation, fields, unique or primary, primary))

    def add_index(self, index: Index) -> int:
        """Registers an index as it is, with its own id; refuses a second one on a key and a second primary one."""
        self.schema(index.relation).project(index.relation, index.key)  # the fields are there
        same = self.indexes_of(index.relation)
        if index.id in self.indexes:
            raise ValueError(f"index {index.id} exists")
        if any(i.key == index.key for i in same):
            raise ValueError(f"an index on {', '.join(index.key)} exists")
        if index.primary and any(i.primary for i in same):
            raise ValueError(f"{index.relation} has a primary index")
        if index.unique:
            self._check_key(self.table(index.relation), index)
        self.indexes[index.id] = index
        self.checkpoint()
        return index.id

    def _check_key(self, df: DataFrame, index: Index) -> None:
        if not df.groupBy(*index.key).count().where("count > 1").isEmpty():
            raise ValueError(f"{', '.join(index.key)} of {index.relation} isn't unique")

    def _check_unique(self, name: str, new: DataFrame, old: list[str]) -> None:
        """Whether the new rows, in place of the old files, keep the unique keys: within themselves, and against the other files."""
        rest = [f for f in self._relation(name)["files"] if f not in old]
        for index in self._unique(name):
            self._check_key(new, index)
            if rest:
                stored = self.spark.read.schema(self._stored(name)).parquet(*rest)
                if not stored.join(new.select(*index.key), index.key, "left_semi").isEmpty():
                    raise ValueError(f"{', '.join(index.key)} of {name} isn't unique")

    def remove_index(self, index_id: int) -> None:
        if index_id not in self.indexes:
            raise ValueError(f"no index {index_id}")
        del self.indexes[index_id]
        self.checkpoint()

    def has_index(self, relation: str, key: list[str]) -> bool:
        return self.match_index(relation, key) is not None

    def index(self, index_id: int) -> Index:
        if index_id not in self.indexes:
            raise ValueError(f"no index {index_id}")
        return self.indexes[index_id]

    def match_index(self, relation: str, key: list[str]) -> int | None:
        return next((i.id for i in self.indexes.values() if i.relation == relation and i.key == list(key)), None)

    def indexes_of(self, relation: str) -> list[Index]:
        return [i for i in self.indexes.values() if i.relation == relation]

    def _match(self, index: Index, key: tuple) -> Column:
        out = F.lit(True)
        for c, v in zip(index.key, key, strict=True):
            out = out & (F.col(c) == v)
        return out

    def lookup(self, index_id: int, *key) -> DataFrame:
        """Rows with a key, and their addresses."""
        index = self.indexes[index_id]
        return self.rows(index.relation).where(self._match(index, key))

    def primary(self, relation: str) -> Index:
        found = next((i for i in self.indexes.values() if i.relation == relation and i.primary), None)
        if found is None:
            raise ValueError(f"{relation} has no primary index")
        return found

    def lookup_key(self, relation: str, *key) -> Row | None:
        """The row of a primary key."""
        found = self.lookup(self.primary(relation).id, *key).take(2)
        if len(found) > 1:
            raise ValueError(f"two rows of {relation} with key {key}")
        return found[0] if found else None

    def scan_index(self, index_id: int) -> DataFrame:
        """Keys and addresses in the key's order."""
        index = self.indexes[index_id]
        return self.rows(index.relation).select(*index.key, TID).orderBy(*index.key, TID)

    def delete_by_index(self, index_id: int, *key) -> int:
        index = self.indexes[index_id]
        return self._rewrite(index.relation, self._match(index, key), None)

    def update_by_index(self, index_id: int, key: tuple, values: dict[str, str]) -> int:
        index = self.indexes[index_id]
        rows = self.rows(index.relation)
        return self._rewrite(index.relation, self._match(index, key), {c: compile_scalar(x, rows) for c, x in values.items()})

    def delete_key(self, relation: str, *key) -> int:
        return self.delete_by_index(self.primary(relation).id, *key)

    def update_key(self, relation: str, key: tuple, values: dict[str, str]) -> int:
        return self.update_by_index(self.primary(relation).id, key, values)

    def cluster(self, relation: str, key: list[str]) -> None:
        """Writes a relation again in ranges of a key, sorted, so that lookups and ranges read few row groups."""
        rows = self.rows(relation)
        self._replace(relation, self._write(relation, rows.repartitionByRange(*key).sortWithinPartitions(*key)), list(self._relation(relation)["files"]))
        self._relation(relation)["external"] = False  # its files are the database's own now
        self.checkpoint()

    # ---- functions

    def register_function(self, name: str, f, kind: str) -> None:
        """Makes a function of pandas Series (or a pandas UDF) known to SQL."""
        self.spark.udf.register(name, f if hasattr(f, "evalType") else F.pandas_udf(f, kind))
