"""Document fingerprints: a bottom-k sketch of word-shingle hashes.

A sketch keeps the k smallest of a text's distinct shingle hashes.  Sketches merge across parts (the k smallest of both),
and estimate resemblance, containment and the number of distinct shingles.  A text with at most k shingles has an exact
sketch.  Shingles take five words; a text of fewer words is one shingle, a text without words has an empty sketch.

The query needs each document's neighbour in descending doc_id order.  Spark deals the rows' keys (doc_id, hash of the text,
number of the row, so that equal ids and equal texts spread too) into ranges of like numbers of rows; from these come the ranges'
first keys, one for each input partition.  Texts then go to their ranges once, and of each range's first document one copy goes to the
end of the range before it (of the first range's to the end of the last).  No task sees more than its range.

Texts are hashed in pieces of ``PIECE`` bytes, so that memory follows a text's bytes and not some times that.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ASCII_SPACE, slices, table

K = 128
SHINGLE = 5
#: Texts are hashed in pieces of about so many bytes.
PIECE = 1 << 20
#: Hashes keep this many bits, six bytes of a fingerprint each.
BITS = 48

_SPACE = np.zeros(256, bool)
_SPACE[list(ASCII_SPACE)] = True
#: Odd multipliers: a polynomial over a word's bytes, and one for each place in a shingle.
_BASE = np.uint64(0x9E3779B97F4A7C15)
_PLACES = np.array([0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(data: bytes) -> np.ndarray:
    """64-bit hashes of the words of a UTF-8 text, in order."""
    if len(data) > 2 * PIECE:
        return np.concatenate([word_hashes(part) if isinstance(part, bytes) else part for part in _pieces(data)] or [np.empty(0, np.uint64)])
    raw = np.frombuffer(data, np.uint8)
    word = ~_SPACE[raw]
    edge = np.diff(word.view(np.int8), prepend=np.int8(0), append=np.int8(0))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(start):
        return np.empty(0, np.uint64)
    size = end - start
    offset = np.cumsum(size) - size
    place = np.arange(offset[-1] + size[-1]) - np.repeat(offset, size)
    power = np.multiply.accumulate(np.full(int(size.max()), _BASE, np.uint64))
    return _mix(np.add.reduceat((raw[word].astype(np.uint64) + np.uint64(1)) * power[place], offset))


def _pieces(data: bytes) -> Iterator[bytes | np.ndarray]:
    """A text cut at white space into pieces of at most ``PIECE`` bytes; a longer word comes as its hash."""
    space = _SPACE[np.frombuffer(data, np.uint8)]
    at = 0
    while at < len(data):
        stop = min(len(data), at + PIECE)
        if stop < len(data) and not space[stop]:
            found = np.flatnonzero(space[at:stop])
            if not len(found):  # in a word that is longer than a piece
                after = np.flatnonzero(space[stop:])[:1]
                stop = stop + int(after[0]) if len(after) else len(data)
                yield _long_word_hash(data, at, stop)
                at = stop
                continue
            stop = at + int(found[-1]) + 1
        yield data[at:stop]
        at = stop


def _long_word_hash(data: bytes, at: int, stop: int) -> np.ndarray:
    """The hash of one word, block by block."""
    total, power = np.zeros(1, np.uint64), np.multiply.accumulate(np.full(PIECE, _BASE, np.uint64))
    for k in range(at, stop, PIECE):
        raw = np.frombuffer(data, np.uint8, min(PIECE, stop - k), k).astype(np.uint64) + np.uint64(1)
        total += (raw * power[: len(raw)] * np.array([pow(int(_BASE), k - at, 1 << 64)], np.uint64)).sum(dtype=np.uint64)
    return _mix(total)


def _shingles(words: np.ndarray) -> np.ndarray:
    size = min(SHINGLE, len(words))
    out = np.full(len(words) - size + 1, size, np.uint64)
    for j in range(size):
        out += words[j : j + len(out)] * _PLACES[j]
    return _mix(out) >> np.uint64(64 - BITS)


def shingle_hashes(data: bytes) -> np.ndarray:
    """BITS-bit hashes of a text's word shingles, repeats included."""
    words = word_hashes(data)
    return _shingles(words) if len(words) else words


def _least(found: np.ndarray, k: int) -> np.ndarray:
    """The k smallest distinct hashes, ascending."""
    if len(found) > 16 * k:  # only the smallest need sorting; repeats may leave fewer than k
        low = np.unique(np.partition(found, 8 * k)[: 8 * k])
        if len(low) >= k:
            return low[:k]
    return np.unique(found)[:k]


def sketch(text: str, k: int = K) -> np.ndarray:
    """The k smallest distinct shingle hashes, ascending.  Case of A-Z and the kind of ASCII white space don't count."""
    data = text.encode().lower()
    if len(data) <= 2 * PIECE:
        return _least(shingle_hashes(data), k)
    out, held = np.empty(0, np.uint64), np.empty(0, np.uint64)  # held: words that shingles to come begin with
    for part in _pieces(data):
        held = np.concatenate([held, word_hashes(part) if isinstance(part, bytes) else part])
        if len(held) >= SHINGLE:
            out = merge(out, _least(_shingles(held), k), k)
            held = held[1 - SHINGLE :]
    # fewer words than a shingle has, in a text of giant words
    return out if len(out) or not len(held) else _least(_shingles(held), k)


def merge(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    """The sketch of two parts' shingles together."""
    return np.union1d(a, b)[:k]


def distinct(a: np.ndarray, k: int = K) -> float:
    """Estimated number of distinct shingles; exact below k."""
    return float(len(a)) if len(a) < k else (k - 1) / (float(a[-1]) + 1) * 2.0**BITS


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated Jaccard similarity; two texts without words are alike."""
    union = merge(a, b, k)
    if not len(union):
        return 1.0
    return float(np.isin(union, np.intersect1d(a, b, assume_unique=True), assume_unique=True).sum() / len(union))


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of a's shingles that b has."""
    if not len(a):
        return 1.0
    return min(1.0, resemblance(a, b, k) * distinct(merge(a, b, k), k) / distinct(a, k))


def encode(a: np.ndarray) -> str:
    return base64.b64encode(a.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()).decode()


def decode(text: str) -> np.ndarray:
    raw = np.frombuffer(base64.b64decode(text), np.uint8).reshape(-1, BITS // 8)
    return np.pad(raw, ((0, 0), (2, 0))).view(">u8").ravel().astype(np.uint64)


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, n_shingles) of every row; null texts count as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [sketch(t or "") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(encode, found), pa.string()), pa.array(map(distinct, found), pa.float64())], names=["doc_id", "fingerprint", "n_shingles"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fingerprint string, n_shingles double")


# ---- each document against its edited text and its neighbour

_LEAST = -(1 << 63)
#: Order of the rows: descending doc_id, then by text hash, then by the row's number.
_KEY = ["place", "h", "row"]


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    return rows.select("doc_id", "text", F.bitwise_not(F.coalesce("doc_id", F.lit(_LEAST))).alias("place"), F.xxhash64("text").alias("h"), F.monotonically_increasing_id().alias("row"))


def first_keys(rows: DataFrame, ranges: int) -> np.ndarray:
    """The first key of each of at most ``ranges`` ranges of like numbers of rows, ascending; 24 bytes a range reach the driver."""
    dealt = rows.select(*_KEY).repartitionByRange(ranges, *_KEY)
    found = dealt.groupBy(F.spark_partition_id()).agg(F.min(F.struct(*_KEY)).alias("k")).select("k.*").collect()
    return np.array(sorted(tuple(r) for r in found), [(c, "i8") for c in _KEY])


def with_neighbour_ranges(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, text, ghost) dealt into ranges of their keys, sorted within.

    The ghost at a range's end is a copy of the first document of the range that follows.
    """
    rows = _keyed(docs)
    firsts = first_keys(rows, max(2, docs.rdd.getNumPartitions()))
    n = max(1, len(firsts))

    @F.pandas_udf("int")
    def range_of(place: pd.Series, h: pd.Series, row: pd.Series) -> pd.Series:
        own = np.empty(len(place), firsts.dtype)
        own["place"], own["h"], own["row"] = place, h, row
        return pd.Series(np.searchsorted(firsts, own, side="right").astype(np.int32) - 1)

    dealt = rows.withColumn("range", F.greatest(range_of(*_KEY), F.lit(0)))
    # a row of equal id and text serves as well, wherever it is
    heads = rows.sparkSession.createDataFrame([(*map(int, f[["place", "h"]].item()), (i - 1) % n) for i, f in enumerate(firsts)], "place long, h long, range int")
    ghosts = rows.select("doc_id", "text", "place", "h").join(F.broadcast(heads), ["place", "h"])  # a row for each input partition
    ghosts = ghosts.groupBy("range").agg(F.first("doc_id").alias("doc_id"), F.first("text").alias("text"))
    none = F.lit(0).cast("long")
    both = dealt.select("doc_id", "text", F.lit(0).alias("ghost"), "range", *_KEY).unionAll(ghosts.select("doc_id", "text", F.lit(1).alias("ghost"), "range", *(none.alias(c) for c in _KEY)))
    return both.repartitionById(n, F.col("range")).sortWithinPartitions("ghost", *_KEY)


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "n_shingles"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.float64()]

    def row(doc: tuple, follower: tuple) -> tuple:
        (doc_id, text, own), (_, next_text, next_sketch) = doc, follower
        half = len(text) // 2
        edited = text[: len(text) - half] + next_text[:half]
        changed = sketch(edited)
        return doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), encode(own), encode(changed), resemblance(own, changed), resemblance(own, next_sketch), distinct(own)

    held, done = None, False
    for batch in slices(batches):
        rows = []
        for doc_id, text, ghost in zip(*(c.to_pylist() for c in batch.columns)):
            if done:
                break
            here = (doc_id, text, sketch(text))
            if held:
                rows.append(row(held, here))
            held, done = here, bool(ghost)  # the ghost follows the range's last document
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


def compare_neighbours(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text, of its edited text, and their likeness to it and to the next document.

    The next document is the one that follows in descending doc_id; rows of equal doc_id follow by their text's hash, rows without
    one come last, and after the last comes the first (itself, if there is but one).  Null texts count as empty.
    Repeated rows are returned as often as they occur; other columns are left out.  An empty table gives no rows.
    Very long texts are read whole, in pieces where their words are hashed.
    """
    dealt = with_neighbour_ranges(docs).select("doc_id", "text", "ghost")
    return dealt.mapInArrow(_compared, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_shingles double")


def op9(spark, sf_dir: str) -> DataFrame:
    return compare_neighbours(table(spark, sf_dir, "documents"))
