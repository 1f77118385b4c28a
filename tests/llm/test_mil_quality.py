import re
import zlib

import numpy as np
import pytest

from quern.llm import mil_quality as mq
from quern.llm.bottomk import word_hashes


def test_gradients_against_differences():
    rng = np.random.default_rng(1)
    sizes = [1, 3, 2, 7]
    x, bag, y = rng.normal(size=(13, mq.FEATURES)), np.cumsum([0, *sizes[:-1]]), np.array([0.0, 1, 1, 0])
    shapes = {"we": (mq.FEATURES, mq.CODE), "be": (mq.CODE,), "v": (mq.CODE, mq.GATE), "u": (mq.CODE, mq.GATE), "w": (mq.GATE,), "c": (mq.CODE,), "b": (1,)}
    p = {k: rng.normal(0, 0.3, s) for k, s in shapes.items()}
    _, g = mq.gradients(p, x, bag, y)
    for name in p:
        for _ in range(5):
            at = tuple(rng.integers(0, n) for n in p[name].shape)
            low, high = ({k: v.copy() for k, v in p.items()} for _ in range(2))
            low[name][at] -= 1e-5
            high[name][at] += 1e-5
            assert abs((mq.gradients(high, x, bag, y)[0] - mq.gradients(low, x, bag, y)[0]) / 2e-5 - g[name][at]) < 1e-6


def plain_features(text):
    """Passages' features word by word."""
    data = text.encode()
    spans = [m.span() for m in re.finditer(rb"[^ \t\n\x0b\x0c\r]+", data)]
    if not spans:
        return np.zeros((1, mq.FEATURES), np.float32)
    hashes = [int(word_hashes(data[a:b].lower())[0]) for a, b in spans]
    out, seen = [], set()
    for k in range(0, len(spans), mq.PASSAGE):
        own, h = spans[k : k + mq.PASSAGE], hashes[k : k + mq.PASSAGE]
        part = data[0 if not k else own[0][0] : spans[k + mq.PASSAGE][0] if k + mq.PASSAGE < len(spans) else len(data)]
        kinds, hashed = np.zeros(mq._KINDS), np.zeros(mq.BUCKETS)
        for c in part:
            kinds[mq._KIND[c]] += 1
        for x in h:
            hashed[(x >> 40) % mq.BUCKETS] += 1
        new = np.mean([x not in seen and not seen.add(x) for x in h])
        again = np.mean([k + i > 0 and hashes[k + i - 1] == x for i, x in enumerate(h)])
        size = np.array([b - a for a, b in own])
        sums = [new, again, size.mean() / 8, np.sqrt(max(0, (size**2).mean() - size.mean() ** 2)) / 4, np.log1p(len(own)), np.log1p(len(spans))]
        out.append(np.r_[np.log1p(100 * kinds / len(part)), sums, 4 * np.sqrt(hashed / len(h))])
    return np.array(out, np.float32)


def some_text(rng, n):
    words = rng.choice(["a", "bb", "C!!", "é", "the", "12", "x" * 90], n)
    return " \n"[int(rng.integers(2))].join("".join([w, " " * int(rng.integers(2))]) for w in words)


@pytest.mark.parametrize("piece", [50, 1000, 0])
def test_features_against_plain_ones_whatever_the_pieces(piece):
    rng = np.random.default_rng(3)
    for text in ["", " \n", "a", " a b ", " " * 300 + "a b", "w " * 64, "w " * 65, "v" * 5000, *(some_text(rng, int(n)) for n in rng.integers(1, 900, 25))]:
        got, want = np.concatenate(list(mq.features(text, piece))), plain_features(text)
        assert got.shape == want.shape and np.allclose(got, want, atol=1e-5)


def test_a_long_text_scores_the_same_whatever_the_pieces(monkeypatch):
    rng = np.random.default_rng(2)
    bags = [np.concatenate(list(mq.features(some_text(rng, 300)))).astype(float) for _ in range(40)]
    model = mq.train(bags, (np.arange(40) % 2).astype(float), epochs=2)
    text = some_text(rng, 1_500_000)
    assert len(text) > 9_000_000
    want = model.score(text)
    monkeypatch.setattr(mq, "PIECE", 1 << 20)
    got = model.score(text)
    assert abs(got[0] - want[0]) < 1e-9 and got[1:] == want[1:]


def test_whole_query_against_brute_force(spark):
    """Every row of the query: attention written out over plain features."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    model = mq.fit(docs, labels)
    got = {r.doc_id: r for r in mq.op1(spark, "/root/testdata/sf0.001").collect()}
    rows = docs.select("doc_id", "text").collect()
    assert len(got) == len(rows)
    for doc_id, text in rows:
        h, a = model.encode(plain_features(text or ""))
        w = np.exp(a - a.max())
        want = 1 / (1 + np.exp(-((w @ h) / w.sum() @ model.p["c"] + model.p["b"][0])))
        r = got[doc_id]
        assert abs(r.score - want) < 1e-4 and r.n_passages == len(a) and r.held_out == (zlib.crc32(str(doc_id).encode()) % 5 == 0)


def test_documents_are_learned_from_whole_or_not_at_all(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "good word " * (32 * (i + 1)) if i % 2 else "Bad! " * 64 * (i + 1)) for i in range(12)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(12)], "doc_id long, quality int")
    seen = []
    monkeypatch.setattr(mq, "train", lambda bags, y: seen.append([len(b) for b in bags]))
    mq.fit(docs, labels)
    mq.fit(docs, labels, passages=20)
    known = {i + 1 for i in range(12) if zlib.crc32(str(i).encode()) % 5}
    assert set(seen[0]) == known and set(seen[1]) < known and 0 < sum(seen[1]) <= 20


def test_held_out_accuracy(spark):
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    got = mq.op1(spark, "/root/testdata/sf0.1")
    assert got.count() == 10_000
    seen = got.join(labels, "doc_id").where("held_out").toPandas()
    assert (seen.predicted == (seen.score >= 0.3)).all() and seen.score.between(0, 1).all()
    rank, good = seen.score.rank(), seen.quality == 1
    auc = (rank[good].sum() - good.sum() * (good.sum() + 1) / 2) / (good.sum() * (~good).sum())
    kept, let_in = seen[good].predicted.mean(), seen[~good].predicted.mean()
    print("auc", auc, "kept", kept, "let in", let_in)
    assert auc > 0.97 and kept > 0.98 and let_in < 0.2


def test_cases(spark):
    docs = spark.createDataFrame([(1, None, 2), (2, "", 2), (2, "", 2), (None, "x " * 500_000, 1)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = mq.fit(docs, labels)
    assert [r.score for r in mq.score(docs, model).collect()] == [0.5] * 4
    assert mq.score(docs.limit(0), model).count() == 0
