"""Toxicity by maximum-scoring segments.

* Tokens are lower-cased ``\\w+`` runs.  A token seen in too few training documents, or in too few to tell and in no clean
  one, backs off to its first six, five or four characters, so that inflected and compounded forms share evidence.
* A token's score is its log-odds between toxic and other labelled documents under a Dirichlet prior proportional to
  the pooled counts (Monroe and others, 2008).  Scores are signed: tokens of clean documents count against a segment,
  with their log-odds shrunk by their z-value where that is small.  Positive log-odds count where they are significant
  only; every token costs a small drift besides, which makes the expected score negative.
* All maximal-scoring segments of a text are found in time linear in its tokens (Ruzzo and Tompa, 1999).
* Segment scores follow an extreme-value law (Karlin and Altschul, 1990): a text of n tokens is expected to have
  K n exp(-lambda S) segments of score S or more by chance.  Lambda solves the moment equation over the background's
  scores, K is counted on background documents, less a share for wrong labels, as K follows the highest score.  Significant segments are toxic passages; a document's evidence is the
  sum of their normalised scores, brought to a probability by a logistic fit on labelled documents kept apart.

Learning: a bounded sample of labelled rows (``bound``); the model holds only significant tokens of that sample, so its
size doesn't grow with the corpus.  Scoring: one pass over the texts without a shuffle.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bottomk
from .common import held_out, labelled_sample, slices, table, text_docs

_TOKEN = re.compile(r"\w+")
#: Lengths of the prefixes that a rare token backs off to, and the number of training documents that make it common.
PREFIXES = (6, 5, 4)
COMMON = 3
#: Weight of the prior against the counts, least z-value of a positive score, least positive score, least score, cost of a token.
PRIOR, LEAST_Z, LEAST_SCORE, LOWEST, DRIFT = 0.05, 3.0, 1.0, -1.0, 0.05
#: Share of the background's documents, those of the highest segments, that may have a wrong label and don't count for K.
NOISE = 0.002
#: Chance of a segment by which it counts as a toxic passage.
SIGNIFICANCE = 0.01
#: Labelled rows to learn from, at most.
BOUND = 20_000
THRESHOLD = 0.5


def lowered(text: str) -> str:
    """Lower case of the same length, so that places in it are places in the text."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c if len(c.lower()) > 1 else c.lower() for c in text)


def tokens_of(text: str) -> list[str]:
    return _TOKEN.findall(lowered(text))


def chain(token: str) -> list[str]:
    """A token, then the prefixes that it backs off to."""
    return [token, *(token[:n] + "*" for n in PREFIXES if len(token) > n)]


@dataclass
class Model:
    scores: dict[str, float]
    drift: float = DRIFT
    lam: float = 1.0
    k: float = 1e-6
    weight: float = 1.0
    bias: float = 0.0

    def score(self, token: str) -> float:
        for t in chain(token):
            if (s := self.scores.get(t)) is not None:
                return s
        return 0.0

    def probability(self, evidence: float) -> float:
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, self.weight * math.log1p(evidence) + self.bias))))


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (first token, token after the last, score) of the tokens' scores, in order.

    Linear: each positive token is pushed and merged once; tokens that aren't positive begin and end no segment.
    """
    stack: list[list[float]] = []  # first, end, sum before, sum after, index of the nearest earlier one with a lower sum before
    at = np.flatnonzero(scores > 0)
    sums = np.concatenate([[0.0], np.cumsum(scores)])
    for p, before, after in zip(at.tolist(), sums[at].tolist(), sums[at + 1].tolist()):
        new = [p, p + 1, before, after, -1]
        j = len(stack) - 1
        while True:
            while j >= 0 and stack[j][2] >= new[2]:
                j = stack[j][4]
            if j < 0 or stack[j][3] >= new[3]:
                break
            new[0], new[2], below = stack[j][0], stack[j][2], stack[j][4]
            del stack[j:]  # merged
            j = below
        new[4] = j
        stack.append(new)
    return [(int(a), int(b), after - before) for a, b, before, after, _ in stack]


# ---- learning


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (token, n0, n1) of (text, y, weight): weights of the documents that hold it, by class; a token's prefixes are tokens too.

    Documents are counted and not occurrences, so that a text that repeats a rare word doesn't make it significant.
    """
    for batch in slices(batches):
        found: dict[str, list[float]] = {}
        for text, y, weight in zip(*(c.to_pylist() for c in batch.columns)):
            for t in {t for token in set(tokens_of(text)) for t in chain(token)}:
                found.setdefault(t, [0.0, 0.0])[y] += weight
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), *(pa.array([r[i] for r in found.values()], pa.float64()) for i in range(2))], names=["token", "n0", "n1"])


@F.pandas_udf(T.LongType())
def least_shingle(texts: pd.Series) -> pd.Series:
    return pd.Series([int(s[0]) if len(s := bottomk.sketch(t)) else -1 for t in texts], dtype="int64")


def token_scores(counts: list[tuple[str, float, float]], n0: float, n1: float) -> tuple[dict[str, float], dict[str, float]]:
    """Signed scores of the tokens, and the background's share of those that aren't zero.

    A zero stops the backing off to a prefix; a token of no clean document that is too rare to tell doesn't stop it.
    """
    scores, share = {}, {}
    total = max(1.0, PRIOR * (n0 + n1))
    for token, y0, y1 in counts:
        prior = PRIOR * (y0 + y1)
        a, b = y1 + prior, y0 + prior
        odds = math.log(a / max(1e-9, n1 + total - a)) - math.log(b / max(1e-9, n0 + total - b))
        z = odds / math.sqrt(1 / a + 1 / b)
        if odds >= LEAST_SCORE and z >= LEAST_Z:
            scores[token] = odds
        elif odds < 0 and not token.endswith("*"):
            scores[token] = max(LOWEST, odds) * min(1.0, -z / LEAST_Z)
        elif y0 > 1e-9:
            scores[token] = 0.0
        else:
            continue
        share[token] = b / (n0 + total)
    kept = {t: s for t, s in scores.items() if s or any(scores.get(x) for x in chain(t)[1:])}
    return kept, {t: share[t] for t, s in kept.items() if s}


def solve_lambda(gain: list[float], share: list[float], drift: float) -> float:
    """The positive root of E[exp(lambda score)] = 1 over the background; 1 where no score is positive."""
    if not gain:
        return 1.0
    g, p = np.array(gain), np.array(share)
    p = p / max(1.0, p.sum() / 0.5)
    value = lambda x: float((p * np.exp(np.minimum(x * (g - drift), 500))).sum() + (1 - p.sum()) * math.exp(-x * drift) - 1)
    low, high = 1e-9, 1.0
    while value(high) < 0 and high < 64:
        high *= 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if value(mid) < 0 else (low, mid)
    return low


def scores_of(model: Model, text: str, memo: dict[str, float]) -> np.ndarray:
    """The scores of a text's tokens, less the drift.  ``memo`` keeps tokens' scores from text to text."""
    tokens = tokens_of(text)
    get, out = memo.get, np.empty(len(tokens))
    if len(memo) > 200_000:
        memo.clear()
    for i, t in enumerate(tokens):
        s = get(t)
        if s is None:
            s = memo[t] = model.score(t)
        out[i] = s
    return out - model.drift


def chance_of(x: float) -> float:
    """Chance of a maximum of normalised score x or more: Gumbel's law."""
    return -math.expm1(-math.exp(-max(-30.0, min(700.0, x))))


def evidence(model: Model, text: str, memo: dict[str, float]) -> tuple[float, float, list[tuple[int, int, float]], int]:
    """Sum of the significant segments' normalised scores, the least chance of a segment, the segments, n tokens."""
    scores = scores_of(model, text, memo)
    total, best, found = 0.0, 1.0, []
    for a, b, s in segments(scores):
        x = model.lam * s - math.log(model.k * len(scores))
        chance = chance_of(x)
        best = min(best, chance)
        if chance <= SIGNIFICANCE:
            total += x
            found.append((a, b, s))
    return total, best, found, len(scores)


def fit(docs: DataFrame, labels: DataFrame, bound: int = BOUND) -> Model:
    """Learns from at most ``bound`` labelled rows that aren't held out.

    Copies and most near copies among them (those of one label whose least shingle hash is the same) weigh as much as
    one text together, lest the rare words of one copied text look significant; no text and no label is dropped for it.
    Three quarters give the token counts, the rest K and the logistic fit.  Without labelled rows of both kinds the
    model scores every text by the share of toxic rows.
    """
    rows = labelled_sample(docs, labels, "toxic", bound).withColumn("h", least_shingle("text")).persist()
    # a group of copies is on one side as a whole; a row for each group, at most ``bound`` or so
    apart = F.crc32(F.min("doc_id").cast("string").cast("binary")) % 5 == 1
    alike = rows.groupBy("h", "y").agg((1 / F.count("*")).alias("weight"), apart.alias("apart"))
    sample = rows.join(F.broadcast(alike), ["h", "y"]).select("text", "y", "weight", "apart")
    counted = (
        sample.where(~F.col("apart")).select("text", "y", "weight").mapInArrow(_counts, "token string, n0 double, n1 double")
        .groupBy("token").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    ).persist()
    whole = counted.where(~F.col("token").endswith("*")).agg(F.sum("n0"), F.sum("n1")).first()
    known = sorted((r.token, round(r.n0, 6), round(r.n1, 6)) for r in counted.where(f"n0 + n1 >= {COMMON - 1e-6}").collect())  # of the bounded sample
    scores, share = token_scores(known, whole[0] or 0, whole[1] or 0) if whole[0] and whole[1] else ({}, {})
    model = Model(scores)
    model.lam = solve_lambda([scores[t] for t in share], list(share.values()), model.drift)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per document: y, weight, number of tokens, scores of the segments."""
        memo: dict[str, float] = {}
        for batch in slices(batches):
            found = [scores_of(model, t, memo) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(map(len, found), pa.int64()), pa.array([[s for _, _, s in segments(x)] for x in found], pa.list_(pa.float64()))], names=["y", "weight", "n", "s"])

    measured = sorted(tuple(r) for r in sample.where("apart").select("text", "y", "weight").mapInArrow(measure, "y int, weight double, n long, s array<double>").collect())
    counted.unpersist()
    rows.unpersist()
    calibrate(model, measured, whole[0] or 0, whole[1] or 0)
    return model


def calibrate(model: Model, measured: list[tuple[int, float, int, list[float]]], n0: float, n1: float) -> None:
    """Sets K and the logistic weights from (y, weight, tokens, segments' scores) of documents kept apart."""
    background = sorted((s for y, _, _, s in measured if not y), key=lambda s: -max(s, default=0.0))
    chance = sorted((x for s in background[int(len(background) * NOISE):] for x in s), reverse=True)
    envelope = max([1.0, *((i + 1) * math.exp(model.lam * x) for i, x in enumerate(chance))])
    model.k = envelope / max(1, sum(n for y, _, n, _ in measured if not y))  # covers the background's tail at every score
    xs = []
    for _, _, n, s in measured:
        normal = [model.lam * x - math.log(model.k * max(1, n)) for x in s]
        xs.append(math.log1p(sum(x for x in normal if chance_of(x) <= SIGNIFICANCE)))
    ys, weights = [y for y, *_ in measured], [w for _, w, *_ in measured]
    if len(set(ys)) == 2:
        model.weight, model.bias = logistic(np.array(xs), np.array(ys, float), np.array(weights))
    else:
        share1 = n1 / max(1, n0 + n1)
        model.weight, model.bias = 1.0, math.log((share1 + 1e-3) / (1 - share1 + 1e-3))


def logistic(x: np.ndarray, y: np.ndarray, weights: np.ndarray, ridge: float = 0.02) -> tuple[float, float]:
    """Weight and bias of a weighted ridge logistic fit by Newton's method."""
    a = np.column_stack([x, np.ones(len(x))])
    b = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ b, -35, 35)))
        step = np.linalg.solve((a * (weights * p * (1 - p))[:, None]).T @ a + ridge * np.eye(2), a.T @ (weights * (y - p)) - ridge * b)
        b += step
        if np.abs(step).max() < 1e-9:
            break
    return float(b[0]), float(b[1])


# ---- scoring


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, n_passages, chance, passages) of every whole text; passages are (start, end, score) in code points.

    Null texts count as empty and, like texts without a known token, get the score of no evidence.  Repeated rows are
    scored as often as they occur; an empty table gives no rows.  Other columns are left out.  Very long texts are scored
    whole; memory follows the longest one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, float] = {}
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
        for batch in slices(batches):
            scores, passages, chances = [], [], []
            for text in batch.column(1).to_pylist():
                total, chance, found, _ = evidence(model, text, memo)
                scores.append(model.probability(total))
                chances.append(chance)
                if found:
                    places = [m.span() for m in _TOKEN.finditer(lowered(text))]
                    passages.append([{"start": places[a][0], "end": places[b - 1][1], "score": s} for a, b, s in found])
                else:
                    passages.append([])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array(map(len, passages), pa.int32()), pa.array(chances, pa.float64()), pa.array(passages, kind)], names=["doc_id", "score", "n_passages", "chance", "passages"])

    return text_docs(docs).mapInArrow(run, "doc_id long, score double, n_passages int, chance double, passages array<struct<start:long,end:long,score:double>>")


def without_toxic(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, with all their columns, that score below the threshold.

    Null and empty texts have no evidence and stay (unless the model was learned from toxic rows alone); repeated rows
    share a verdict; very long texts are read whole; an empty table gives no rows.
    """
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, float] = {}
        for batch in slices(batches):
            yield batch.filter(pa.array([model.probability(evidence(model, t or "", memo)[0]) < threshold for t in batch.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op2(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "n_passages", "chance")
