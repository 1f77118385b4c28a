"""Near-duplicates by resemblance: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

Links are proposed in two ways and verified by the exact similarity of the whole sets:

* by Golay keys of the sets' SimHash fingerprints (``golay_simhash.links``), for pairs within three bits;
* by minimum hashes for the others, as pairs of similarity 0.8 are some ten bits apart, beyond what codewords can reach: a
  text gets 200 minimum hashes, joined by fives into 40 keys (Broder, 1997; Indyk and Motwani, 1998).  A pair of
  similarity 0.8 shares no key with a chance of (1 - 0.8^5)^40, about 1e-7, a more similar one with less.

No group's pairs are ever emitted.  First each text of a key is verified against the key's pivot, the text whose keys have
the most texts: copies of one original meet the original.  Links become parts.  Keys that still hold several parts join their texts into
clusters; in a cluster, each text that isn't of the largest part is held against all others by an inverted
index of shingles within a task, which gives at most a link for each part it finds similar.  So every pair that shares a
key is verified unless links join it already.  Clusters above ``BLOCK`` shingles are cut into blocks: a text is indexed in one of them,
and one that isn't of the largest part is looked up in all.  That step costs what the posting lists are long, so many
texts that share keys and yet aren't similar enough do cost time with the square of their number.

Scale: texts of equal sets are one row before any key is made.  Only keys of two or more sets are written, and only the
sets of those are compared.  Links become components as in ``golay_simhash``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import golay_simhash
from .common import discard, materialize, slices, text_docs
from .golay_simhash import SEED, components, named, shingle_hashes, simhash

SHINGLE = 5
#: Least similarity, as a fraction.
LEAST = (4, 5)
BANDS, ROWS = 40, 5
#: Shingles that are indexed together in a task.
BLOCK = 2_000_000

_rng = np.random.default_rng(SEED)
_FACTORS = _rng.integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
_ADDED = _rng.integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: str) -> np.ndarray:
    """A text's distinct shingle hashes, sorted."""
    return np.unique(shingle_hashes(text, SHINGLE))


def keys(hashes: np.ndarray) -> np.ndarray:
    """The 40 keys of a set of hashes; none for an empty set."""
    if not len(hashes):
        return np.empty(0, np.uint64)
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(hashes), 512):
        hashed = hashes[k : k + 512, None] * _FACTORS
        hashed += _ADDED
        np.minimum(low, hashed.min(axis=0), out=low)
    key = np.arange(BANDS, dtype=np.uint64)
    for part in low.reshape(BANDS, ROWS).T:
        key = (key ^ part) * _MIX
        key ^= key >> np.uint64(29)
    return key


def _digest(hashes: np.ndarray) -> int:
    import xxhash

    h = xxhash.xxh64_intdigest(hashes.tobytes(), SEED)
    return h - (1 << 64) if h >> 63 else h


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        found = [shingles(t) for t in batch.column(1).to_pylist()]
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64())]
        prints = np.array([simhash(s) for s in found], np.uint64).view(np.int64)
        columns = [map(_digest, found), map(len, found), prints, [keys(s).view(np.int64) for s in found]]
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds))], names=["doc_id", "set", "n", "fp", "keys"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(set, hashes) of (set, text); a row whose text has another set than that is of a repeated id."""
    for batch in slices(batches, 200):
        rows = [(d, s.view(np.int64)) for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if _digest(s := shingles(t)) == d]
        yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in rows], pa.int64()), pa.array([s for _, s in rows], pa.list_(pa.int64()))], names=["set", "hashes"])


def _alike(n: Column, m: Column) -> Column:
    """Whether sets of these sizes can be similar enough."""
    return F.least(n, m) * LEAST[1] >= F.greatest(n, m) * LEAST[0]


def similar(both: np.ndarray, n: np.ndarray, m: int) -> np.ndarray:
    """Whether sets of n and m shingles that share ``both`` are similar enough."""
    return both * sum(LEAST) >= (n + m) * LEAST[0]


class Index:
    """The shingles of a block's sets, with the sets that hold each."""

    def __init__(self, parts: list[int], hashes: list[np.ndarray]):
        self.parts, self.sizes = np.array(parts, np.int64), np.array([len(h) for h in hashes], np.int64)
        owner = np.repeat(np.arange(len(hashes)), self.sizes)
        every = np.concatenate(hashes) if hashes else np.empty(0, np.int64)
        order = np.argsort(every, kind="stable")
        every, self.owner = every[order], owner[order]
        self.start = np.flatnonzero(np.r_[True, every[1:] != every[:-1]]) if len(every) else np.empty(0, np.int64)
        self.known, self.size = every[self.start], np.diff(np.r_[self.start, len(every)])

    def parts_like(self, hashes: np.ndarray, part: int) -> np.ndarray:
        """Other parts with a set that is similar enough."""
        if not len(self.known):
            return np.empty(0, np.int64)
        at = np.minimum(np.searchsorted(self.known, hashes), len(self.known) - 1)
        at = at[self.known[at] == hashes]
        size = self.size[at]
        ends = np.cumsum(size)
        where = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.start[at] - (ends - size), size)
        both = np.bincount(self.owner[where], minlength=len(self.parts))
        return np.unique(self.parts[similar(both, self.sizes, len(hashes)) & (self.parts != part)])


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (cluster, block, home, probe, part, hashes), sorted with a block's home rows first: links (a, b) of similar parts.

    A block's home rows are held and indexed; others are looked up as they come.  Parts that a block has linked already
    aren't linked again.
    """
    block, index, home = None, None, []  # home: (probe, part, hashes)
    up: dict[int, int] = {}
    out: list[tuple[int, int]] = []

    def root(x: int) -> int:
        while (y := up.get(x, x)) != x:
            up[x] = x = up.get(y, y)
        return x

    def look(part: int, hashes: np.ndarray) -> None:
        for other in index.parts_like(hashes, part).tolist():
            a, b = sorted((root(part), root(other)))
            if a != b:
                up[b] = a
                out.append((a, b))

    def built() -> None:
        nonlocal index, home
        if index is None:
            index = Index([p for _, p, _ in home], [h for *_, h in home])
            for probe, part, hashes in home:
                if probe:
                    look(part, hashes)
            home = []

    for batch in slices(batches):
        flat = batch.column(5)
        for i, (cluster, b, own, probe, part) in enumerate(zip(*(c.to_pylist() for c in batch.columns[:5]))):
            if (cluster, b) != block:
                built()
                block, index, home = (cluster, b), None, []
                up.clear()
            hashes = flat[i].values.to_numpy()
            if own:
                home.append((probe, part, hashes))
            else:
                built()
                look(part, hashes)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["a", "b"])
            out.clear()
    built()
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["a", "b"])


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of sets that are similar enough."""
    one, other = (sets.select(F.col("set").alias(c), F.col("hashes").alias(f"{c}s")) for c in "ab")
    both = F.size(F.array_intersect("as", "bs"))
    joined = pairs.join(one, "a").join(other, "b").withColumn("both", both)
    return joined.where(F.col("both") * sum(LEAST) >= (F.size("as") + F.size("bs")) * LEAST[0]).select("a", "b")


def _pair(a: Column, b: Column) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def _golay_pairs(distinct: DataFrame) -> DataFrame:
    """(a, b): pairs of sets that connect those whose fingerprints are within three bits, by the Golay keys of ``golay_simhash``."""
    first = distinct.groupBy("fp").agg(F.min("set").alias("first"))
    near = golay_simhash.links(first)
    one, other = (first.select(F.col("fp").alias(c), F.col("first").alias(f"{c}_set")) for c in "ab")
    apart = near.join(one, "a").join(other, "b").select(*_pair(F.col("a_set"), F.col("b_set")))
    return apart.unionAll(distinct.join(first, "fp").where("set > first").select(F.col("first").alias("a"), F.col("set").alias("b")))


def groups(distinct: DataFrame, docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """(node, root) of the sets of ``distinct`` (set, n, fp, keys, rep) that chains of similar pairs join to a smaller one.

    ``docs``: (doc_id, text), with the text of every ``rep``.
    """
    keyed = distinct.select(F.explode("keys").alias("key"), "set", "n")
    sizes = keyed.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    shared = materialize(keyed.join(sizes, "key"), "shared")
    weight = shared.groupBy("set").agg(F.sum("size").alias("weight"))
    pivots = shared.join(weight, "set").groupBy("key").agg(F.max(F.struct("weight", "set", "n")).alias("pivot"))
    near = shared.join(pivots, "key").where((F.col("set") != F.col("pivot.set")) & _alike(F.col("n"), F.col("pivot.n"))).select(*_pair(F.col("set"), F.col("pivot.set")))
    near = materialize(near.unionAll(_golay_pairs(distinct)).distinct(), "proposed")
    wanted = shared.select("set").unionAll(near.select(F.explode(F.array("a", "b")).alias("set"))).distinct()
    reps = distinct.join(wanted, "set", "left_semi").select("set", F.col("rep").alias("doc_id"))
    sets = materialize(docs.join(reps, "doc_id").select("set", "text").mapInArrow(_sets, "set long, hashes array<long>").dropDuplicates(["set"]), "sets")
    joined = components(_verified(near, sets))

    parts = shared.join(joined.withColumnRenamed("node", "set"), "set", "left").select("key", "set", "n", F.coalesce("root", "set").alias("part"))
    several = parts.groupBy("key").agg(F.min("part").alias("low"), F.max("part").alias("high"), F.min("set").alias("first")).where("low < high").select("key", "first")
    left = materialize(parts.join(several, "key").select("set", "n", "part", "first").distinct(), "left")
    clusters = components(left.where("set <> first").select(*_pair(F.col("set"), F.col("first"))).distinct())
    members = left.select("set", "n", "part").distinct().join(clusters.withColumnRenamed("node", "set"), "set", "left").select("set", "n", "part", F.coalesce("root", "set").alias("cluster"))
    members = materialize(members, "members")
    of_part = members.groupBy("cluster", "part").agg(F.count("*").alias("texts"), F.sum("n").alias("n"))
    of_cluster = of_part.groupBy("cluster").agg(F.max(F.struct("texts", "part")).alias("largest"), F.ceil(F.sum("n") / block).cast("int").alias("blocks"))
    dealt = members.join(of_cluster, "cluster").select("set", "cluster", "part", (F.col("part") != F.col("largest.part")).alias("probe"), "blocks", F.pmod(F.xxhash64("set"), F.col("blocks")).cast("int").alias("own"))
    dealt = dealt.select("set", "cluster", "part", "probe", "own", F.explode(F.when(F.col("probe"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("own"))).alias("block"))
    rows = dealt.join(sets, "set").select("cluster", "block", (F.col("block") == F.col("own")).alias("home"), "probe", "part", "hashes")
    rows = rows.repartition("cluster", "block").sortWithinPartitions("cluster", "block", F.desc("home"))
    more = components(rows.mapInArrow(_compared, "a long, b long").distinct())
    found = joined.join(more.select(F.col("node").alias("root"), F.col("root").alias("further")), "root", "left").select("node", F.coalesce("further", "root").alias("root"))
    out = materialize(found.unionAll(more.select("node", "root")), "groups")
    discard(shared, near, sets, joined, left, clusters, members, more)
    return out


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, component_id) of every row of ``docs``: similar texts, and those that a chain of such joins, are a component.

    Null texts count as empty; texts without a word are one component, and texts of fewer than five words have one
    shingle.  A component is named by its smallest doc_id.  Every row needs a doc_id; one that has several texts is in the
    component of each.  Very long texts are read whole; an empty table gives no rows.
    """
    texts = text_docs(docs)
    sketches = materialize(texts.mapInArrow(_sketched, "doc_id long, set long, n int, fp long, keys array<long>"), "sketches")
    distinct = materialize(sketches.groupBy("set").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("keys").alias("keys")), "distinct")
    found = groups(distinct, texts)
    rooted = distinct.select("set", "rep").join(found.withColumnRenamed("node", "set"), "set", "left").withColumn("root", F.coalesce("root", "set"))
    return sketches.select("doc_id", "set").join(named(rooted).select("set", "component_id"), "set").select("doc_id", "component_id")
