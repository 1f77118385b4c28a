"""SimHash near-duplicates by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into segments of 21, 21 and 22 bits, each a word of the perfect binary Golay code [23, 12, 7]
with its unused bits at zero.  The keys of a segment are the codewords that it or a word one bit away decodes to: one
codeword if the segment is within two bits of it, otherwise six.  Two segments that differ in at most one bit share a key.

Three errors over three segments fall as (3,0,0), (2,1,0) or (1,1,1), or with fewer errors below one of these:

* in the first two, one segment is equal and another has at most one error: the key is the equal segment's bits with a
  codeword of the other, for all six ordered pairs of segments;
* in the last, all three have at most one error: the key is three codewords.  One side's expansion is enough for each
  segment, so a fingerprint gives its keys of the first segment with the decoded others, and the decoded first segment
  with all keys of the others.

So no pair within three bits is lost, and unrelated fingerprints meet with a chance of about 1e-8.  Fingerprints that
share a key are joined (shuffle by key, sorted) and verified by their exact distance.

Scale: texts are reduced to one row per distinct fingerprint before any key is made, so a group of exact copies costs
one row.  Within a key, a group's links are found by breadth-first search and emitted as a star, one row per member and
never all pairs.  A key of more than ``RUN`` fingerprints isn't held in a task: its rows get second keys, one for each of four 16-bit
blocks, of which a pair within three bits has one in common, and are dealt again.  Components come from
large-star/small-star rounds over the links, each written to shared storage.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, fresh, materialize, slices, table, text_docs

SHINGLE = 3
SEED = 42
MAX_DISTANCE = 3
#: Generator polynomial of the Golay code, x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GOLAY = 0b110001110101
#: (shift, width) of the segments of a fingerprint.
SEGMENTS = ((43, 21), (22, 21), (0, 22))
#: Fingerprints of a key that a task compares; those of more common keys are dealt again by second keys.
RUN = 20_000
#: Links that a file of a round of ``components`` holds, about, and the files that a round may have however few links there are.
FILE_LINKS, FILES = 100_000, 16


# ---- fingerprints


def shingle_hashes(text: str, size: int = SHINGLE) -> np.ndarray:
    """XXH64 (seed 42) of a text's word shingles, repeats included; fewer words than ``size`` give one shingle."""
    import xxhash

    words = text.encode().lower().split()  # bytes: only A-Z are lowered, only ASCII space separates
    if not words:
        return np.empty(0, np.uint64)
    digest, joined = xxhash.xxh64_intdigest, b" ".join(words)
    if len(words) <= size:
        return np.array([digest(joined, SEED)], np.uint64)
    ends = list(accumulate(map(len, words), lambda a, n: a + n + 1))
    starts = [0, *(e + 1 for e in ends)]
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, ends[size - 1 :])), np.uint64, len(words) - size + 1)


def simhash(hashes: np.ndarray) -> int:
    """A bit is 1 if it is set in over half the hashes; no hashes give zero."""
    n, ones = len(hashes), np.zeros(64, np.int64)
    for k in range(0, n, 1 << 16):
        part = hashes[k : k + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.uint32)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        prints = np.array([simhash(shingle_hashes(t)) for t in batch.column(1).to_pylist()], np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp): the 64-bit SimHash of every whole text, as a signed long."""
    return text_docs(docs).mapInArrow(_fingerprints, "doc_id long, fp long")


# ---- Golay keys


@lru_cache(1)
def _cosets() -> np.ndarray:
    """By syndrome: what to add to a word to reach the codewords that are its keys; unused places repeat the first."""
    of_bit = [_syndrome(1 << i) for i in range(23)]

    def syn(bits: tuple[int, ...]) -> int:
        out = 0
        for b in bits:
            out ^= of_bit[b]
        return out

    leader = {syn(bits): sum(1 << b for b in bits) for n in range(4) for bits in combinations(range(23), n)}
    table = np.zeros((2048, 6), np.int64)
    for s, error in leader.items():
        near = {error, *((1 << b) ^ leader[s ^ of_bit[b]] for b in range(23))}
        ways = [error, *sorted(near - {error})]
        table[s] = ways + [error] * (6 - len(ways))
    return table


def _syndrome(word: int) -> int:
    for shift in range(11, -1, -1):
        if word >> (shift + 11) & 1:
            word ^= GOLAY << shift
    return word


@lru_cache(1)
def _syndromes() -> tuple[np.ndarray, np.ndarray]:
    """Syndromes of the low 12 and the high 11 bits of a word."""
    return np.array([_syndrome(x) for x in range(1 << 12)], np.int64), np.array([_syndrome(x << 12) for x in range(1 << 11)], np.int64)


def codewords(words: np.ndarray) -> np.ndarray:
    """For each 23-bit word, six codewords within reach, the nearest first, as 12-bit indices; repeats fill up."""
    low, high = _syndromes()
    syndrome = low[words & 4095] ^ high[words >> 12]
    return (words[:, None] ^ _cosets()[syndrome]) >> 11


def keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row number, key) of all keys of unsigned fingerprints, without repeats in a row."""
    segments = [((fps >> np.uint64(s)) & np.uint64((1 << w) - 1)).astype(np.int64) for s, w in SEGMENTS]
    codes = [codewords(x) for x in segments]
    first = [c[:, :1] for c in codes]
    several = [c[:, 1] != c[:, 0] for c in codes]
    out_row, out_key = [], []
    rows = np.arange(len(fps))

    def add(tag: int, key: np.ndarray, used: np.ndarray) -> None:
        """key: (rows, n); used: which of them aren't repeats."""
        out_row.append(np.broadcast_to(rows[:, None], key.shape)[used])
        out_key.append((key | np.int64(tag << 40))[used])

    slots = [np.column_stack([np.ones(len(fps), bool), *[m] * 5]) for m in several]
    tag = 0
    for i in range(3):
        for j in range(3):
            if i != j:
                add(tag, (segments[i][:, None] << 12) | codes[j], slots[j])
                tag += 1
    add(tag, (codes[0] << 24) | (first[1] << 12) | first[2], slots[0])
    both = (codes[1][:, :, None] << 12) | codes[2][:, None, :]
    used = slots[1][:, :, None] & slots[2][:, None, :]
    used[:, 0, 0] = False  # the block above has it
    add(tag, ((first[0][:, :, None] << 24) | both).reshape(len(fps), 36), used.reshape(len(fps), 36))
    return np.concatenate(out_row), np.concatenate(out_key)


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fps = batch.column(0).to_numpy(zero_copy_only=False)
        for k in range(0, len(fps), 2000):
            part = fps[k : k + 2000]
            row, key = keys(part.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(part[row])], names=["key", "fp"])


# ---- links


def star(fps: np.ndarray, most: int = MAX_DISTANCE) -> tuple[np.ndarray, np.ndarray]:
    """Links that join the same fingerprints as all links of up to ``most`` bits do: each to the first of its component.

    Breadth-first over those not reached yet, so memory follows the number of fingerprints.
    """
    left, roots, members = fps, [], []
    while len(left) > 1:
        root, front, left = left[0], left[:1], left[1:]
        while len(front) and len(left):
            hit = np.zeros(len(left), bool)
            for f in front:
                hit |= np.bitwise_count(left ^ f) <= most
            front, left = left[hit], left[~hit]
            members.append(front)
            roots.append(np.full(len(front), root, np.uint64))
    if not members:
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    return np.concatenate(roots), np.concatenate(members)


def _linker(most: int | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function of rows (key, fp) sorted by key, to verified links (a, b) of each run of equal keys; a run may span batches.

    With ``most``, runs of more rows are passed on as they are, as (fp, fp, key).
    """

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(a: np.ndarray, b: np.ndarray, key: np.ndarray | None = None) -> pa.RecordBatch:
            a, b = a.view(np.int64), b.view(np.int64)
            kept = pa.nulls(len(a), pa.int64()) if key is None else pa.array(key)
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), kept], names=["a", "b", "key"])

        def runs(key: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
            if len(key) < 2:
                return
            edge = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            size = np.diff(np.r_[edge, len(key)])
            pair = edge[size == 2]
            pair = pair[np.bitwise_count(fp[pair] ^ fp[pair + 1]) <= MAX_DISTANCE]
            found = [(fp[pair], fp[pair + 1])]
            for a, n in zip(edge[size > 2], size[size > 2]):
                if most and n > most:
                    yield rows(fp[a : a + n], fp[a : a + n], key[a : a + n])
                else:
                    found.append(star(fp[a : a + n]))
            a, b = (np.concatenate(x) for x in zip(*found))
            if len(a):
                yield rows(a, b)

        held: list[tuple[np.ndarray, np.ndarray]] = []  # of one key, which may go on
        n, over = 0, None  # over: a key whose rows are passed on
        for batch in batches:
            key, fp = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
            if over is not None and len(key):
                k = int(np.searchsorted(key, over, side="right"))
                if k:
                    yield rows(fp[:k], fp[:k], key[:k])
                    key, fp = key[k:], fp[k:]
            if not len(key):
                continue
            over = None
            last = int(np.searchsorted(key, key[-1]))
            if last or not held or held[-1][0][-1] != key[-1]:
                held.append((key[:last], fp[:last]))
                yield from runs(*(np.concatenate(x) for x in zip(*held)))
                held, n = [], 0
            held.append((key[last:], fp[last:]))
            n += len(key) - last
            if most and n > most:
                for k, f in held:
                    yield rows(f, f, k)
                held, n, over = [], 0, key[-1]
        if held:
            yield from runs(*(np.concatenate(x) for x in zip(*held)))

    return linked


def links(distinct: DataFrame, most: int = RUN) -> DataFrame:
    """(a, b): links that connect the distinct fingerprints of ``fp`` as all links within three bits do."""
    schema = "a long, b long, key long"
    dealt = lambda rows: rows.repartition("key").sortWithinPartitions("key", "fp")
    keyed = distinct.select("fp").mapInArrow(_keyed, "key long, fp long")
    found = materialize(dealt(keyed).mapInArrow(_linker(most), schema), "links")
    large = found.where("key IS NOT NULL")
    out = found.where("key IS NULL").select("a", "b")
    if not large.isEmpty():
        blocks = F.array(*(F.xxhash64("key", F.lit(i), F.shiftrightunsigned("a", 16 * i).bitwiseAND(F.lit(65535))) for i in range(4)))
        again = large.select(F.explode(blocks).alias("key"), F.col("a").alias("fp"))
        out = out.unionAll(dealt(again).mapInArrow(_linker(None), schema).select("a", "b"))
    return out.distinct()


# ---- components


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable, for each node of the links (a < b) that isn't its own root.

    Alternates large-star and small-star (Kiveris and others, 2014) until the links stay as they are; every round is
    written to shared storage in place of the one before.  Rounds grow with the logarithm of the longest path.  A round
    is written in as many files as its links need and not one for each shuffle partition, as each costs requests, or processes
    that the executor forks where storage is a local folder.
    """
    edges = materialize(edges, "links")
    state, before = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first(), None
    while state[0] and state != before:
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("n"), "m").where("n <> m").distinct()
        parent = large.groupBy("n").agg(F.min("m").alias("m"))
        small = large.join(parent.withColumnRenamed("m", "r"), "n").select(F.explode(F.array("n", "m")).alias("n"), "r").where("n <> r")
        files = max(FILES, -(-state[0] // FILE_LINKS))
        former, edges = edges, materialize(small.select(F.col("r").alias("a"), F.col("n").alias("b")).distinct().coalesce(files), "links")
        discard(former)
        before, state = state, edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    out = edges.select(F.col("b").alias("node"), F.col("a").alias("root"))
    out._quern_path = edges._quern_path
    return out


def named(rooted: DataFrame) -> DataFrame:
    """``rooted`` (root, rep, ...) with component_id, the smallest rep of a root."""
    # written, so that the join isn't dealt as the sums are, and a root of many rows can be split
    least = materialize(rooted.groupBy("root").agg(F.min("rep").alias("component_id")), "roots")
    return rooted.join(least, "root")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row of ``docs``.

    Null texts count as empty; texts without a word have fingerprint zero and are linked like any other.  Repeated rows
    and ties share a component.  A row without a doc_id is returned with the component of its fingerprint and never
    names one; where no row of a component has a doc_id, component_id is null.  An empty table gives an empty result.
    """
    fps = materialize(fingerprints(docs), "fingerprints")
    distinct = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")), "distinct")
    found = components(links(distinct))
    rooted = distinct.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    ids = named(rooted).select("fp", "component_id")
    return fps.join(ids, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def one_of_each_group(docs: DataFrame, grouped: Callable[[DataFrame], DataFrame] = near_duplicates) -> DataFrame:
    """The rows of ``docs``, with all their columns, that stand for their component: those with its smallest doc_id.

    ``grouped`` gives the component_id of (doc_id, text); by default components are of fingerprints within three bits.  Of
    rows with equal doc_id and text one stays.  Rows without a doc_id stay only where no row of their component has
    one.  Texts are shuffled once, to meet the ids that stay.
    """
    key, text_hash = fresh(docs.columns, "key", "text")
    unnamed = F.xxhash64(F.coalesce("text", F.lit(""))).bitwiseAND(F.lit((1 << 62) - 1)) + F.lit(1 << 62)
    keyed = docs.withColumn(key, F.coalesce(F.col("doc_id").cast("long"), unnamed))
    groups = grouped(keyed.select(F.col(key).alias("doc_id"), "text"))
    chosen = groups.where("doc_id = component_id").select(F.col("doc_id").alias(key)).distinct()
    stay = keyed.join(chosen, key, "left_semi").withColumn(text_hash, F.xxhash64("text"))
    return stay.dropDuplicates([key, text_hash]).select(*(F.col(f"`{c}`") for c in docs.columns))


def op7(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
