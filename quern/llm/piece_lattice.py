"""SentencePiece encoding and decoding over a relational lattice.

Words (runs of spaces with the characters that follow, cut around line feeds) are independent, as no piece goes over
their borders.  The commonest distinct words are solved relationally: substrings up to the longest piece's length are
exploded, equi-joined to the piece table, and the edges that remain are grouped by word and folded with Spark's
``aggregate``: by Viterbi for a unigram model, by merges for a BPE model.  The fold by merges takes, again and again,
the adjacent pair whose edge has the best score, the leftmost of equals; Viterbi over a BPE model's scores gives other
ids than SentencePiece does, so it is used for unigram models alone.

The solved words are a dictionary of at most ``DICTIONARY`` entries, whatever the size of the corpus, and go to the tasks
as a broadcast variable.  Texts are then encoded in one pass without a shuffle; a word outside of the dictionary (rare,
or longer than ``LONGEST``) is encoded in its task by the same rule.  Only distinct words with their counts are shuffled.
"""

from __future__ import annotations

import heapq
import math
import re
import struct
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, slices, table, text_docs

#: Words solved relationally, at most, and their greatest length.
DICTIONARY, LONGEST = 300_000, 48
SPACE = "▁"
UNIGRAM, BPE = 1, 2
#: Score of a merge that no piece stands for.
_NEVER = float("-inf")
#: What an unknown character costs below the worst piece, in a unigram model.
UNKNOWN_PENALTY = 10.0


@dataclass
class Pieces:
    """A model's pieces: normal ones with id and score, byte pieces by value, and the text of every id."""

    kind: int
    normal: dict[str, tuple[int, float]]
    byte_ids: list[int]
    unknown: int
    dummy_prefix: bool
    texts: list[bytes] = field(default_factory=list)

    @cached_property
    def longest(self) -> int:
        return max(map(len, self.normal), default=1)

    @cached_property
    def scores(self) -> dict[str, float]:
        return {p: s for p, (_, s) in self.normal.items()}

    @cached_property
    def ids(self) -> dict[str, int]:
        return {p: i for p, (i, _) in self.normal.items()}

    @cached_property
    def splits(self) -> bool:
        """Whether words can be had by splitting texts at spaces and line feeds."""
        return self.dummy_prefix and not any("\n" in p or SPACE in p.lstrip(SPACE) for p in self.normal)

    @cached_property
    def pattern(self) -> re.Pattern:
        """Words that no piece crosses: cut before a space that follows another character, and around line feeds."""
        apart = not any("\n" in p for p in self.normal)
        if any(SPACE in p.lstrip(SPACE) for p in self.normal):  # pieces over several words: a text is one word
            return re.compile(r"\n|[^\n]+" if apart else r"(?s).+")
        return re.compile(rf"\n|{SPACE}*[^{SPACE}\n]+|{SPACE}+" if apart else rf"{SPACE}*[^{SPACE}]+|{SPACE}+")

    def characters(self, ids: list[int]) -> list[int]:
        """Spells out characters without a piece, given as -1 less their code points, in byte pieces."""
        if min(ids, default=0) >= 0:
            return ids
        out: list[int] = []
        for i in ids:
            if i >= 0:
                out.append(i)
            elif self.byte_ids:
                out.extend(self.byte_ids[b] for b in chr(-1 - i).encode())
            elif not out or out[-1] != self.unknown:
                out.append(self.unknown)
        return out


def load(path: str | None = None) -> Pieces:
    """Reads a .model file; by default the public BPE vocabulary with byte fallback."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    model = pb.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    of = lambda kind: [(i, p) for i, p in enumerate(model.pieces) if p.type == kind]
    normal = {p.piece: (i, p.score) for i, p in of(1)}
    raw = sorted((int(p.piece[3:5], 16), i) for i, p in of(6))
    texts = [p.piece.replace(SPACE, " ").encode() if p.type == 1 else bytes([int(p.piece[3:5], 16)]) if p.type == 6 else b" \xe2\x81\x87 " if p.type == 2 else b"" for p in model.pieces]
    return Pieces(model.trainer_spec.model_type, normal, [i for _, i in raw], of(2)[0][0], model.normalizer_spec.add_dummy_prefix, texts)


# ---- in a task: the same rules for single words


def merge(word: str, pieces: Pieces) -> list[int]:
    """BPE by merges, with a heap: the best-scoring adjacent pair first, the leftmost of equals."""
    normal, parts = pieces.normal, list(word)
    if len(parts) <= LONGEST:
        none, get = -math.inf, pieces.scores.get
        scores = [get(a + b, none) for a, b in zip(word, word[1:])]
        while scores and (best := max(scores)) > none:
            at = scores.index(best)
            parts[at] = both = parts[at] + parts.pop(at + 1)
            del scores[at]
            if at:
                scores[at - 1] = get(parts[at - 1] + both, none)
            if at < len(scores):
                scores[at] = get(both + parts[at + 1], none)
    else:
        n = len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list[tuple[float, int, int, str]] = []

        def push(i: int) -> None:
            if i >= 0 and after[i] < n and (found := normal.get(both := parts[i] + parts[after[i]])) is not None:
                heapq.heappush(heap, (-found[1], i, after[i], both))

        for i in range(n - 1):
            push(i)
        while heap:
            _, i, j, both = heapq.heappop(heap)
            if parts[i] == "" or after[i] != j or parts[i] + parts[j] != both:
                continue
            parts[i], parts[j] = both, ""
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            push(i)
            push(before[i])
        parts = [p for p in parts if p]
    ids = list(map(pieces.ids.get, parts))
    return ids if None not in ids else pieces.characters([-1 - ord(p) if i is None else i for p, i in zip(parts, ids)])


def viterbi(word: str, pieces: Pieces) -> list[int]:
    """The path of the greatest sum of scores; of equals the one whose last piece is longest."""
    lowest = min((s for _, s in pieces.normal.values()), default=0.0) - UNKNOWN_PENALTY
    best: list[tuple[float, int]] = [(0.0, 0)]
    longest = pieces.longest
    for e in range(1, len(word) + 1):
        ways = [(best[e - k][0] + pieces.normal[word[e - k : e]][1], k) for k in range(1, min(longest, e) + 1) if word[e - k : e] in pieces.normal]
        if word[e - 1] not in pieces.normal:
            ways.append((best[e - 1][0] + lowest, 1))
        best.append(max(ways))
    out, e = [], len(word)
    while e:
        k = best[e][1]
        part = word[e - k : e]
        out.append(pieces.normal[part][0] if part in pieces.normal else -1 - ord(part))
        e -= k
    return pieces.characters(out[::-1])


def words_of(text: str, pieces: Pieces, pattern: re.Pattern) -> list[str]:
    if not text:
        return []
    return pattern.findall(SPACE * pieces.dummy_prefix + text.replace(" ", SPACE))


def keys_of(text: str) -> list[str] | None:
    """A text's words by splitting alone: ``w`` stands for a word behind one space, ``\\nw`` for a line feed and a word.

    None for texts with runs of spaces, spaces at their ends or around line feeds, or U+2581, whose words need the pattern.
    """
    if SPACE in text:
        return None
    keys = text.replace("\n", " \n").split(" ")
    return None if "" in keys else keys


def key_of(word: str) -> str | None:
    """The key that stands for a word (behind its line feed, if it has no space)."""
    if word[:1] == SPACE:
        return word[1:] if len(word) > 1 and word[1] != SPACE else None
    return "\n" + word if word != "\n" else word


def words_of_key(key: str) -> list[str]:
    if key[0] == "\n":
        return ["\n", key[1:]] if len(key) > 1 else ["\n"]
    return [SPACE + key]


class Decoder:
    """Text of ids: the bytes of the pieces, one after the other."""

    def __init__(self, pieces: Pieces):
        size = np.array([len(t) for t in pieces.texts], np.int64)
        self.size, self.start, self.prefix = size, np.cumsum(size) - size, pieces.dummy_prefix
        self.data = np.frombuffer(b"".join(pieces.texts), np.uint8)

    def __call__(self, ids: np.ndarray) -> str:
        """Bytes that aren't UTF-8 become U+FFFD."""
        size = self.size[ids]
        ends = np.cumsum(size)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.start[ids] - (ends - size), size)
        data = self.data[at].tobytes()
        return data[1 if self.prefix and data[:1] == b" " else 0 :].decode(errors="replace")


# ---- the lattice


def edges(words: DataFrame, pieces: Pieces) -> DataFrame:
    """(word, m): for every word its edges, a map from start * 64 + length to (id, score).  words: distinct, in ``word``."""
    spark = words.sparkSession
    normal = spark.createDataFrame([(p, i, s) for p, (i, s) in pieces.normal.items()], "piece string, id int, score double")
    longest, size = pieces.longest, F.length("word")
    spans = F.flatten(F.transform(F.sequence(F.lit(0), size - 1), lambda a: F.transform(
        F.sequence(F.lit(1), F.least(F.lit(longest), size - a)), lambda n: F.struct((a * 64 + n).alias("k"), F.col("word").substr(a + 1, n).alias("piece")))))
    cut = words.where((size > 0) & (size <= LONGEST)).repartition("word").select("word", F.explode(spans).alias("x")).select("word", "x.k", "x.piece")
    small = F.broadcast(normal) if len(pieces.normal) <= 1_000_000 else normal  # a model's vocabulary; it doesn't grow with the corpus
    return cut.join(small, "piece").groupBy("word").agg(F.map_from_entries(F.collect_list(F.struct("k", F.struct("id", "score")))).alias("m"))


def _edge(m: Column, start: Column, end: Column) -> Column:
    return F.element_at(m, start * 64 + (end - start))


def _ids(m: Column, bounds: Column) -> Column:
    """Ids of the pieces between bounds; a character without a piece as -1 less its code point."""
    return F.transform(F.sequence(F.lit(0), F.size(bounds) - 2), lambda i: F.coalesce(
        _edge(m, F.get(bounds, i), F.get(bounds, i + 1))["id"], -1 - F.ascii(F.col("word").substr(F.get(bounds, i) + 1, F.lit(1)))))


def fold_merges(lattice: DataFrame) -> DataFrame:
    """(word, ids) by merges, the fold for BPE models.

    The state holds the bounds of the parts and the score of every merge of two neighbours (None as ``_NEVER``).  A step
    takes the leftmost best merge and scores the two pairs anew that the merged part is in.
    """
    m, size = F.col("m"), F.length("word")
    score = lambda a, b: F.coalesce(_edge(m, a, b)["score"], F.lit(_NEVER))

    def merged(state: Column, k: Column) -> Column:
        """Merges the parts at place k (from 1) and the next."""
        b, s = state["b"], state["s"]
        before = F.when(k > 1, F.array(score(F.get(b, k - 2), F.get(b, k + 1)))).otherwise(F.array().cast("array<double>"))
        after = F.when(k < F.size(s), F.array(score(F.get(b, k - 1), F.get(b, k + 2)))).otherwise(F.array().cast("array<double>"))
        return F.struct(
            F.concat(F.slice(b, F.lit(1), k), F.slice(b, k + 2, F.size(b))).alias("b"),
            F.concat(F.slice(s, F.lit(1), F.greatest(k - 2, F.lit(0))), before, after, F.slice(s, k + 2, F.size(s))).alias("s"))

    def step(state: Column, _: Column) -> Column:
        best = F.array_max(state["s"])
        # a fold over one element, so that the place of the best merge is found once
        return F.when(F.coalesce(best, F.lit(_NEVER)) == _NEVER, state).otherwise(
            F.aggregate(F.array(F.array_position(state["s"], best).cast("int")), state, merged))

    pairs = F.transform(F.sequence(F.lit(0), size - 2), lambda i: score(i, i + 2))
    start = F.struct(F.sequence(F.lit(0), size).alias("b"), F.when(size > 1, pairs).otherwise(F.array().cast("array<double>")).alias("s"))
    bounds = F.aggregate(F.sequence(F.lit(1), size), start, step)["b"]
    return lattice.select("word", "m", bounds.alias("bounds")).select("word", _ids(m, F.col("bounds")).alias("ids"))


def fold_viterbi(lattice: DataFrame, pieces: Pieces) -> DataFrame:
    """(word, ids) by Viterbi, the fold for unigram models."""
    m, size, longest = F.col("m"), F.length("word"), pieces.longest
    lowest = min((s for _, s in pieces.normal.values()), default=0.0) - UNKNOWN_PENALTY

    def step(state: Column, e: Column) -> Column:
        """state: best sums to every place so far, and the length of the piece that ends there."""
        ways = F.transform(F.sequence(F.lit(1), F.least(F.lit(longest), e)), lambda n: F.struct(
            (F.get(state["best"], e - n) + F.coalesce(_edge(m, e - n, e)["score"], F.when(n == 1, F.lit(lowest)))).alias("s"), n.alias("n")))
        return F.aggregate(F.array(F.array_max(F.filter(ways, lambda w: w["s"].isNotNull()))), state, lambda st, w: F.struct(
            F.concat(st["best"], F.array(w["s"])).alias("best"), F.concat(st["back"], F.array(w["n"])).alias("back")))

    start = F.struct(F.array(F.lit(0.0)).alias("best"), F.array(F.lit(0)).alias("back"))
    back = F.aggregate(F.sequence(F.lit(1), size), start, step)["back"]
    trace = F.aggregate(F.sequence(F.lit(1), size), F.array(size), lambda b, _: F.when(F.get(b, F.lit(0)) > 0, F.concat(F.array(F.get(b, F.lit(0)) - F.get(F.col("back"), F.get(b, F.lit(0)))), b)).otherwise(b))
    return lattice.select("word", "m", back.alias("back")).select("word", "m", trace.alias("bounds")).select("word", _ids(m, F.col("bounds")).alias("ids"))


def solve(words: DataFrame, pieces: Pieces) -> DataFrame:
    """(word, ids) of distinct words that have at least one edge."""
    lattice = edges(words, pieces)
    return fold_viterbi(lattice, pieces) if pieces.kind == UNIGRAM else fold_merges(lattice)


# ---- whole texts


def word_counts(docs: DataFrame, pieces: Pieces) -> DataFrame:
    """(word, n) over all texts; counted within tasks before they are shuffled."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, found, pattern, splits = Counter(), Counter(), pieces.pattern, pieces.splits

        def flush() -> pa.RecordBatch:
            for key, n in keys.items():
                for word in words_of_key(key):
                    found[word] += n
            keys.clear()
            return pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array(found.values(), pa.int64())], names=["word", "n"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                own = keys_of(text) if splits and text else None
                if own:
                    keys.update(own)
                else:
                    found.update(words_of(text, pieces, pattern))
                if len(found) + len(keys) > 400_000:
                    yield flush()
                    found.clear()
        if found or keys:
            yield flush()

    return docs.select("text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def dictionary(docs: DataFrame, pieces: Pieces, most: int = DICTIONARY) -> dict[str, bytes]:
    """The ids (as little-endian 32-bit bytes) of the commonest words, about ``most`` of them at most, by key or word.

    Words are taken by bands of their counts' logarithms, from a histogram, so no task sorts them all; the band that fills
    the dictionary gives a share of its words.
    """
    counts = materialize(word_counts(docs, pieces).where((F.length("word") <= LONGEST) & (F.col("n") > 1)), "words")
    level = F.floor(F.log2(F.col("n").cast("double")) * 16)
    bars = sorted(((r["level"], r["n"]) for r in counts.groupBy(level.alias("level")).agg(F.count("*").alias("n")).collect()), reverse=True)  # at most 64 * 16 rows
    chosen, room = F.lit(True), most
    for at, n in bars:
        if n > room:  # of the band that doesn't fit as many as there is room for, by their hashes
            chosen = (level > at) | ((level == at) & (F.pmod(F.xxhash64("word"), F.lit(1 << 20)) < room * (1 << 20) // n))
            break
        room -= n
    solved = solve(counts.where(chosen).select("word"), pieces).toArrow()  # about ``most`` rows
    out: dict[str, bytes] = {}
    splits = pieces.splits
    feed = np.array(pieces.characters([pieces.normal["\n"][0] if "\n" in pieces.normal else -11]), "<u4").tobytes()
    for batch in solved.to_batches(20_000):
        for word, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            found = np.array(pieces.characters(ids), "<u4").tobytes()
            if not splits:
                out[word] = found
            elif (key := key_of(word)) is not None:
                out[key] = found if key == "\n" or word[0] == SPACE else feed + found
    return out


def encode(docs: DataFrame, pieces: Pieces | None = None, most: int = DICTIONARY, with_ids: bool = True) -> DataFrame:
    """(doc_id, n_tokens, ids_crc32, round_trip, ids) of every whole text.

    Null and empty texts have no tokens.  ``round_trip``: decoding the ids gives the text back; U+2581 in a text comes
    back as a space, as it does from the library.  Repeated rows are encoded each; an empty table gives no rows; other
    columns are left out.  ``ids`` is left out on request.  Very long texts are encoded whole, a bounded number of bytes of
    other texts beside them; words beyond ``LONGEST`` characters are merged with a heap.
    """
    spark: SparkSession = docs.sparkSession
    pieces = pieces or load()
    rows = text_docs(docs)
    known = spark.sparkContext.broadcast(dictionary(rows, pieces, most))
    single: Callable[[str, Pieces], list[int]] = viterbi if pieces.kind == UNIGRAM else merge
    schema = "doc_id long, n_tokens long, ids_crc32 long, round_trip boolean" + ", ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pattern, common, memo, splits, decode = pieces.pattern, known.value, {}, pieces.splits, Decoder(pieces)

        def rare(word: str, key: bool) -> bytes:
            found = memo.get((word, key))
            if found is None:
                if len(memo) > 100_000:
                    memo.clear()
                ids = [i for w in (words_of_key(word) if key else [word]) for i in single(w, pieces)]
                found = memo[word, key] = struct.pack(f"<{len(ids)}I", *ids)
            return found

        for batch in slices(batches):
            out = []
            for text in batch.column(1).to_pylist():
                own = keys_of(text) if splits and text else None
                if own:
                    raw = b"".join([common.get(w) or rare(w, True) for w in own])
                else:  # the dictionary's keys are words themselves where a model's words can't be split off
                    raw = b"".join([(not splits and common.get(w)) or rare(w, False) for w in words_of(text, pieces, pattern)])
                ids = np.frombuffer(raw, "<u4")
                same = decode(ids) == text.replace(SPACE, " ")
                out.append((len(ids), zlib.crc32(raw), same, ids.astype(np.int32) if with_ids else None))
            kinds = [pa.int64(), pa.int64(), pa.bool_(), *[pa.list_(pa.int32())] * with_ids]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[i] for r in out], t) for i, t in enumerate(kinds))], names=[c.split()[0] for c in schema.split(", ")])

    return rows.mapInArrow(run, schema)


def decode_all(encoded: DataFrame, pieces: Pieces | None = None) -> DataFrame:
    """(doc_id, text) of rows with ``doc_id`` and ``ids``; null ids give an empty text."""
    pieces = pieces or load()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = Decoder(pieces)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([decode(np.array(i or [], np.int64)) for i in batch.column(1).to_pylist()], pa.string())], names=["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, text string")


def op10(spark, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"), with_ids=False)
