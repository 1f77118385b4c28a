"""Quality classifier by attention-based multiple-instance learning (Ilse, Tomczak and Welling, 2018).

A document is a bag of passages of 64 words.  Every passage becomes a feature vector (kinds of bytes, word shapes,
novelty of its words within the document, hashed words) and is encoded by a learned layer; gated attention weights,
learned from document labels alone, average the passages' codes, and a logistic layer scores the average.

Learning takes a bounded sample of labelled rows (``bound``): documents whole, with all their passages, as many as come to
``PASSAGES`` passages at most in a hashed order of their ids.  The model has a fixed size.  Scoring is one pass without a shuffle over all
passages of every whole text.  Texts are read in pieces of ``PIECE`` bytes, cut between passages, and attention is
accumulated online: memory follows a text's bytes and its distinct words, and the score doesn't depend on the pieces.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bottomk import word_hashes
from .common import ASCII_SPACE, discard, held_out, labelled_sample, materialize, slices, table, text_docs

PASSAGE = 64
#: Labelled rows to learn from, and their passages in all, at most.
BOUND, PASSAGES = 6_000, 150_000
#: Texts are read in pieces of about so many bytes.
PIECE = 1 << 22
CODE, GATE, BUCKETS = 24, 12, 64
THRESHOLD = 0.3


def _kinds() -> tuple[np.ndarray, int]:
    """A class for every byte: letters by case, digits, each ASCII punctuation mark, kinds of space, UTF-8 bytes."""
    kind = np.zeros(256, np.int64)
    kind[ord("a") : ord("z") + 1] = 1
    kind[ord("A") : ord("Z") + 1] = 2
    kind[ord("0") : ord("9") + 1] = 3
    kind[32], kind[9], kind[10] = 4, 5, 6
    kind[128:192], kind[192:] = 7, 8
    n = 9
    for c in range(33, 127):
        if not chr(c).isalnum():
            kind[c] = n
            n += 1
    return kind, n


_KIND, _KINDS = _kinds()
_SPACE = np.zeros(256, bool)
_SPACE[list(ASCII_SPACE)] = True
FEATURES = _KINDS + 6 + BUCKETS


def words_at(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of a text's bytes."""
    edge = np.diff((~_SPACE[raw]).view(np.int8), prepend=np.int8(0), append=np.int8(0))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _passages(raw: np.ndarray, data: bytes, total: int, seen: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(passages, FEATURES) of a piece, and the hashes of its words.  total: words of the whole text; seen: sorted hashes of
    the words before the piece; last: the hash of the word before it, if any."""
    start, end = words_at(raw)
    n = len(start)
    first = np.arange(0, n, PASSAGE)
    bounds = np.r_[0, start[first[1:]], len(raw)]
    size, words = np.diff(bounds), np.diff(np.r_[first, n])
    of_byte = np.repeat(np.arange(len(first)) * _KINDS, size)
    kinds = np.bincount(of_byte + _KIND[raw], minlength=len(first) * _KINDS).reshape(-1, _KINDS)
    hashes = word_hashes(data.lower())
    at = np.unique(hashes, return_index=True)[1]
    new = np.zeros(n)
    new[at] = 1
    if len(seen):
        at = at[new[at] > 0]
        place = np.minimum(np.searchsorted(seen, hashes[at]), len(seen) - 1)
        new[at[seen[place] == hashes[at]]] = 0
    again = np.r_[float(len(last) and last[0] == hashes[0]), hashes[1:] == hashes[:-1]]
    length = (end - start).astype(float)
    mean = lambda x: np.add.reduceat(x, first) / words
    sums = np.column_stack([mean(new), mean(again), mean(length) / 8, np.sqrt(np.maximum(0, mean(length**2) - mean(length) ** 2)) / 4, np.log1p(words), np.full(len(first), np.log1p(total))])
    bucket = (hashes >> np.uint64(40)) % np.uint64(BUCKETS)
    hashed = np.bincount((np.repeat(np.arange(len(first)) * BUCKETS, words) + bucket.astype(np.int64)), minlength=len(first) * BUCKETS).reshape(-1, BUCKETS) / words[:, None]
    return np.column_stack([np.log1p(100.0 * kinds / size[:, None]), sums, 4 * np.sqrt(hashed)]).astype(np.float32), hashes


def features(text: str, piece: int = 0) -> Iterator[np.ndarray]:
    """The passages' features of a whole text, piece by piece (of ``PIECE`` bytes by default); a text without words is one passage without words."""
    data, piece = text.encode(), piece or PIECE
    raw = np.frombuffer(data, np.uint8)
    if len(data) <= piece:
        if not (total := len(words_at(raw)[0])):
            yield np.zeros((1, FEATURES), np.float32)
        else:
            yield _passages(raw, data, total, np.empty(0, np.uint64), np.empty(0, np.uint64))[0]
        return
    total, inside = 0, False
    for k in range(0, len(raw), piece):
        word = ~_SPACE[raw[k : k + piece]]
        total += int(word[0] and not inside) + int((word[1:] & ~word[:-1]).sum())
        inside = bool(word[-1])
    if not total:
        yield np.zeros((1, FEATURES), np.float32)
        return
    seen = last = np.empty(0, np.uint64)
    at, size = 0, piece
    while at < len(raw):
        stop = min(len(raw), at + size)
        cut = stop
        if stop < len(raw):  # up to the last passage that begins here, as it may go on
            start = words_at(raw[at:stop])[0]
            k = (len(start) - 1) // PASSAGE * PASSAGE
            if k <= 0:
                size *= 2
                continue
            cut = at + int(start[k])
        if len(words_at(raw[at:cut])[0]):
            found, hashes = _passages(raw[at:cut], data[at:cut], total, seen, last)
            seen, last = np.union1d(seen, hashes), hashes[-1:]
            yield found
        at, size = cut, piece


@dataclass
class Model:
    """Weights: encoder (we, be), gated attention (v, u, w), scorer (c, b); features are shifted and scaled first."""

    shift: np.ndarray
    scale: np.ndarray
    p: dict[str, np.ndarray]

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes and attention logits of passages."""
        h = np.tanh(np.clip((x - self.shift) * self.scale, -4, 4) @ self.p["we"] + self.p["be"])
        return h, (np.tanh(h @ self.p["v"]) / (1 + np.exp(-(h @ self.p["u"])))) @ self.p["w"]

    def score(self, text: str) -> tuple[float, int, int]:
        """Score, number of passages, the passage with the largest weight."""
        top, weight, code, n, best = -np.inf, 0.0, np.zeros(CODE), 0, 0
        for x in features(text):
            h, a = self.encode(x)
            k = int(a.argmax())
            if a[k] > top:
                code, weight, top, best = code * np.exp(top - a[k]), weight * np.exp(top - a[k]), float(a[k]), n + k
            e = np.exp(a - top)
            code, weight, n = code + e @ h, weight + e.sum(), n + len(a)
        return float(1 / (1 + np.exp(-np.clip(code / weight @ self.p["c"] + self.p["b"][0], -35, 35)))), n, best


def gradients(p: dict[str, np.ndarray], x: np.ndarray, bag: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean cross-entropy of bags and its gradients.  x: passages' features; bag: the first passage of each bag."""
    owner = np.repeat(np.arange(len(bag)), np.diff(np.r_[bag, len(x)]))
    h = np.tanh(x @ p["we"] + p["be"])
    t, s = np.tanh(h @ p["v"]), 1 / (1 + np.exp(-(h @ p["u"])))
    a = (t * s) @ p["w"]
    e = np.exp(a - np.maximum.reduceat(a, bag)[owner])
    att = e / np.add.reduceat(e, bag)[owner]
    z = np.add.reduceat(att[:, None] * h, bag)
    out = 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["b"][0], -35, 35)))
    loss = -np.mean(y * np.log(out + 1e-12) + (1 - y) * np.log(1 - out + 1e-12))
    d = (out - y) / len(y)
    dz = d[:, None] * p["c"]
    datt = (h * dz[owner]).sum(1)
    da = att * (datt - np.add.reduceat(att * datt, bag)[owner])
    dts = da[:, None] * p["w"]
    dt, ds = dts * s * (1 - t * t), dts * t * s * (1 - s)
    dh = (att[:, None] * dz[owner] + dt @ p["v"].T + ds @ p["u"].T) * (1 - h * h)
    return float(loss), {"we": x.T @ dh, "be": dh.sum(0), "v": h.T @ dt, "u": h.T @ ds, "w": (t * s).T @ da, "c": z.T @ d, "b": np.array([d.sum()])}


def train(bags: list[np.ndarray], labels: np.ndarray, epochs: int = 20, seed: int = 0) -> Model:
    """Adam over batches of 64 bags, with weight decay."""
    rng = np.random.default_rng(seed)
    every = np.concatenate(bags)
    shift, scale = every.mean(0, dtype=float), 1 / (every.std(0, dtype=float) + 0.05)
    ends = np.cumsum([len(b) for b in bags])[:-1]
    every -= shift.astype(every.dtype)
    every *= scale.astype(every.dtype)
    bags = np.split(np.clip(every, -4, 4, out=every), ends)  # views: the sample is held once
    shapes = {"we": (FEATURES, CODE), "be": (CODE,), "v": (CODE, GATE), "u": (CODE, GATE), "w": (GATE,), "c": (CODE,), "b": (1,)}
    p = {k: rng.normal(0, 1 / np.sqrt(s[0]), s) if len(s) > 1 or k in "wc" else np.zeros(s) for k, s in shapes.items()}
    m, v, step = {k: np.zeros(s) for k, s in shapes.items()}, {k: np.zeros(s) for k, s in shapes.items()}, 0
    for epoch in range(epochs):
        order = rng.permutation(len(bags))
        for k in range(0, len(order), 64):
            take = order[k : k + 64]
            sizes = [len(bags[i]) for i in take]
            _, g = gradients(p, np.concatenate([bags[i] for i in take]), np.cumsum([0, *sizes[:-1]]), labels[take])
            step += 1
            rate = 4e-3 * (1 - epoch / epochs)
            for name in p:
                grad = g[name] + (1e-4 * p[name] if name != "b" else 0)
                m[name] = 0.9 * m[name] + 0.1 * grad
                v[name] = 0.999 * v[name] + 0.001 * grad**2
                p[name] = p[name] - rate * (m[name] / (1 - 0.9**step)) / (np.sqrt(v[name] / (1 - 0.999**step)) + 1e-8)
    return Model(shift, scale, p)


def fit(docs: DataFrame, labels: DataFrame, bound: int = BOUND, passages: int = PASSAGES) -> Model:
    """Learns from at most ``bound`` labelled rows that aren't held out, and ``passages`` passages of theirs.

    Documents are learned from whole or not at all.  Without labelled rows of both kinds every text gets the share of
    label 1 (a half without any).
    """

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            for doc_id, text, y in zip(*(c.to_pylist() for c in batch.columns)):  # a row at a time: features take some times a text's bytes
                x = np.concatenate(list(features(text)))
                yield pa.RecordBatch.from_arrays([pa.array([doc_id], pa.int64()), pa.array([y], pa.int32()), pa.array([len(x)], pa.int64()), pa.array([x.tobytes() if len(x) <= passages else None], pa.binary())], names=["doc_id", "y", "n", "x"])

    sample = labelled_sample(docs, labels, "quality", bound).select("doc_id", "text", "y")
    bags = materialize(sample.mapInArrow(measure, "doc_id long, y int, n long, x binary"), "bags")
    sizes = bags.where("x IS NOT NULL").select("doc_id", "n").orderBy(F.xxhash64("doc_id", F.lit(11)), "doc_id").collect()  # of the bounded sample
    ends = np.cumsum([r["n"] for r in sizes])
    chosen = [r["doc_id"] for r, end in zip(sizes, ends) if end <= passages]
    kept = bags if len(chosen) == len(sizes) else bags.where(F.col("doc_id").isin(chosen))
    rows = kept.where("x IS NOT NULL").select("doc_id", "y", "x").collect()  # at most ``passages`` passages
    discard(bags)
    rows.sort(key=lambda r: (r["doc_id"], bytes(r["x"])))
    y = np.array([r["y"] for r in rows], float)
    if len(set(y)) < 2:
        p = {"we": np.zeros((FEATURES, CODE)), "be": np.zeros(CODE), "v": np.zeros((CODE, GATE)), "u": np.zeros((CODE, GATE)), "w": np.zeros(GATE), "c": np.zeros(CODE), "b": np.array([0.0 if not len(y) else 4.0 if y[0] else -4.0])}
        return Model(np.zeros(FEATURES), np.ones(FEATURES), p)
    return train([np.frombuffer(r["x"], np.float32).reshape(-1, FEATURES) for r in rows], y)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, n_passages, top_passage) of every whole text.

    Null texts count as empty; an empty text is a bag of one passage without words and is scored like any other.
    Repeated rows are scored as often as they occur; other columns are left out; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [model.score(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[i] for r in found], k) for i, k in enumerate((pa.float64(), pa.int64(), pa.int64())))], names=["doc_id", "score", "n_passages", "top_passage"])

    return text_docs(docs).mapInArrow(run, "doc_id long, score double, n_passages long, top_passage long")


def of_quality(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, with all their columns, that score the threshold or more.

    Null texts count as empty, and an empty text is scored like any other; repeated rows share a verdict; very long texts
    are read whole; an empty table gives no rows.
    """
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield batch.filter(pa.array([model.score(t or "")[0] >= threshold for t in batch.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op1(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "n_passages", "top_passage")
