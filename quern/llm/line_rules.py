"""Quality rules: cross-document line frequency.

Lines are normalised (lower case, single spaces) and hashed; for every host (``source``) the distinct documents that hold
a line are counted.  A line in more documents of its host than max(``LEAST_LIMIT``, ``SHARE`` of the host's documents) is
removed from them, and a document that keeps less than ``LEAST_LEFT`` of its words is rejected, as are documents that
fail the base rules.

Texts are read once: a pass over them leaves counts and line hashes, written to shared storage.  Counting shuffles
(host, line, document), so a line that most documents share spreads over tasks and is counted from partial sums; only the
lines above the least limit go on, and joining them back is a plain equi-join that Spark splits where it is skewed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ASCII_SPACE, materialize, slices, table

WINDOW = 8
LEAST_WORDS, MOST_REPEATED = 20, 30
LEAST_LIMIT, SHARE = 10, 0.01
LEAST_LEFT = 0.3
_SYMBOLS = b"#*$%&|<>"


def line_hash(line: bytes) -> int | None:
    """Signed 64-bit hash of a normalised line; None for a line without a word."""
    import xxhash

    words = line.split()
    if not words:
        return None
    h = xxhash.xxh64_intdigest(b" ".join(words).decode().lower().encode())
    return h - (1 << 64) if h >> 63 else h


def repeated_words(words: list[bytes], size: int = WINDOW) -> int:
    """Words inside windows of ``size`` words that occur twice or more, each word once."""
    n = len(words) - size + 1
    if n < 2:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.uint64, len(words))
    if len(seen) == len(words):
        return 0
    rolled = np.zeros(n, np.uint64)
    for j in range(size):
        rolled = rolled * np.uint64(0x9E3779B97F4A7C15) + ids[j : j + n] + np.uint64(1)
    order = np.sort(rolled)
    if not (order[1:] == order[:-1]).any():  # equal windows have equal hashes
        return 0
    codes, width = ids.astype(np.int64), 1
    while width < size:  # exact: a code for each distinct run of 1, 2, 4, 8 words
        step = min(width, size - width)
        m = len(codes) - step
        codes = np.unique(codes[:m] * (int(codes.max()) + 1) + codes[step:], return_inverse=True)[1]
        width += step
    often = np.bincount(codes)[codes] > 1
    cover = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(often)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + size, -1)
    return int((np.cumsum(cover) > 0).sum())


def measures(text: str) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, and a text's distinct line hashes with their words."""
    data = text.encode()
    words = data.split()
    chars = len(text) - (len(data) - len(data.translate(None, ASCII_SPACE)))
    symbols = len(data) - len(data.translate(None, _SYMBOLS))
    seen: set[bytes] = set()
    dup, lines = 0, {}
    for line in data.split(b"\n"):
        h = line_hash(line)
        if h is None:
            continue
        dup += line in seen
        seen.add(line)
        lines[h] = lines.get(h, 0) + len(line.split())
    return len(words), chars, symbols, dup, repeated_words(words), list(lines), list(lines.values())


_MEASURED = "doc_id long, host string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, line array<long>, line_words array<long>"


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int64()] * 5 + [pa.list_(pa.int64())] * 2
    names = [c.split()[0] for c in _MEASURED.split(", ")]
    for batch in slices(batches):
        found = list(zip(*(measures(t) for t in batch.column(2).to_pylist()))) or [[]] * 7
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, k) for c, k in zip(found, kinds))], names=names)


def _hosted(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("host"), F.coalesce("text", F.lit("")).alias("text"))


def common_lines(measured: DataFrame, least: int = LEAST_LIMIT, share: float = SHARE) -> DataFrame:
    """(host, line): lines above their host's limit.  ``measured``: host, doc_id, line (hashes of a document)."""
    known = measured.select("host", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("d"), "line")
    counts = known.select("host", "d", F.explode("line").alias("line")).groupBy("host", "line").agg(F.count_distinct("d").alias("n")).where(F.col("n") > least)
    hosts = known.groupBy("host").agg(F.count_distinct("d").alias("docs"))
    return counts.join(hosts, "host").where(F.col("n") > F.ceil(F.col("docs") * F.lit(share))).select("host", "line")


def judge(docs: DataFrame, least: int = LEAST_LIMIT, share: float = SHARE, left: float = LEAST_LEFT) -> DataFrame:
    """Base measures and verdict of every row of ``docs``.

    Null texts are texts without words; a null source is a host of its own, the same as an empty one.  Rows that repeat
    a doc_id are judged each, and count as one document of their host; rows without a doc_id count as one together.
    Very long texts and lines are read whole.  An empty table gives no rows; other columns are left out.
    """
    measured = materialize(_hosted(docs).mapInArrow(_measured, _MEASURED).withColumn("row", F.monotonically_increasing_id()), "lines")
    common = common_lines(measured, least, share)
    lines = measured.select("row", "host", F.explode(F.arrays_zip("line", "line_words")).alias("x")).select("row", "host", F.col("x.line").alias("line"), F.col("x.line_words").alias("words"))
    removed = lines.join(common, ["host", "line"]).groupBy("row").agg(F.sum("words").alias("n_removed_words"))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    gone = F.coalesce("n_removed_words", F.lit(0))
    enough = (F.col("n_words") - gone).cast("double") >= F.lit(left) * F.col("n_words")
    return measured.drop("line", "line_words", "host").join(removed, "row", "left").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & enough).alias("kept"), gone.cast("long").alias("n_removed_words"),
    )


def without_common_lines(docs: DataFrame, least: int = LEAST_LIMIT, share: float = SHARE) -> DataFrame:
    """(doc_id, text) of every row, with the lines above their host's limit taken out of the text."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            lines = [t.split("\n") for t in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(lines, pa.list_(pa.string())), pa.array([[line_hash(x.encode()) for x in doc] for doc in lines], pa.list_(pa.int64()))], names=["row", "doc_id", "host", "text", "line"])

    rows = materialize(_hosted(docs).withColumn("row", F.monotonically_increasing_id()).select("row", "doc_id", "host", "text").mapInArrow(split, "row long, doc_id long, host string, text array<string>, line array<long>"), "texts")
    common = common_lines(rows, least, share)
    marked = rows.select("row", "host", F.explode(F.array_distinct("line")).alias("line")).join(common, ["host", "line"]).groupBy("row").agg(F.collect_list("line").alias("gone"))
    kept = F.filter(F.arrays_zip("text", "line"), lambda x: x["line"].isNull() | F.col("gone").isNull() | ~F.array_contains(F.col("gone"), x["line"]))
    return rows.join(marked, "row", "left").select("doc_id", F.concat_ws("\n", F.transform(kept, lambda x: x["text"])).alias("text"))


def op4(spark, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"))


ORACLE = rf"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         string_split(coalesce(text, ''), chr(10)) AS raw
  FROM documents
), windows AS (
  SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS win
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8)
), often AS (
  SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, win) > 1
), repeated AS (
  SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM often) GROUP BY doc_id
), lines AS (
  SELECT doc_id, host, line,
         lower(trim(regexp_replace(line, '[\x20\x09-\x0D]+', ' ', 'g'))) AS norm,
         len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS words
  FROM (SELECT doc_id, host, unnest(raw) AS line FROM d)
), real_lines AS (
  SELECT * FROM lines WHERE words > 0
), dups AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM real_lines GROUP BY doc_id
), common AS (
  SELECT host, norm FROM real_lines JOIN (SELECT host, count(DISTINCT doc_id) AS docs FROM d GROUP BY host) USING (host)
  GROUP BY host, norm, docs HAVING count(DISTINCT doc_id) > greatest({LEAST_LIMIT}, ceil(docs * {SHARE}::DOUBLE))
), removed AS (
  SELECT doc_id, sum(words) AS n_removed FROM real_lines JOIN common USING (host, norm) GROUP BY doc_id
), m AS (
  SELECT doc_id, len(w) AS n_words, len(array_to_string(w, '')) AS word_chars,
         len(text) - len(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_removed, 0) AS n_removed
  FROM d LEFT JOIN repeated USING (doc_id) LEFT JOIN dups USING (doc_id) LEFT JOIN removed USING (doc_id)
), f AS (
  SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed FROM m
)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
       n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
       NOT base_failed AND n_words - n_removed >= {LEAST_LEFT}::DOUBLE * n_words AS kept, n_removed::BIGINT AS n_removed_words
FROM f
"""
