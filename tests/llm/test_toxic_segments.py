import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from quern.llm import toxic_segments as ts


def plain_segments(scores):
    """All maximal segments by their definition: the best segment, then the same left and right of it."""
    best = None
    for a in range(len(scores)):
        total = 0
        for b in range(a, len(scores)):
            total += scores[b]
            if total > 1e-12 and (best is None or total > best[2] + 1e-12 or abs(total - best[2]) <= 1e-12 and (b - a) < best[1] - best[0] - 1 and a == best[0]):
                best = (a, b + 1, total)
    if not best:
        return []
    a, b, s = best
    return plain_segments(scores[:a]) + [best] + [(x + b, y + b, z) for x, y, z in plain_segments(scores[b:])]


def test_segments_against_definition():
    rng = random.Random(1)
    for _ in range(300):
        n = rng.randint(1, 30)
        scores = [rng.choice([0.5, 1.37, 2.01, -3.3, -0.01, -0.3, -1.0]) + rng.random() / 100 for _ in range(n)]
        want, got = plain_segments(scores), ts.segments(np.array(scores))
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want]
        assert all(abs(x[2] - y[2]) < 1e-9 for x, y in zip(got, want))


def test_segments_are_linear():
    n = 200_000
    assert len(ts.segments(np.tile([0.1, -0.9], n // 2))) > 0


def test_lambda_solves_the_moment_equation():
    lam = ts.solve_lambda([3.0, 5.0], [0.01, 0.001], 0.05)
    assert abs(0.01 * math.exp(lam * 2.95) + 0.001 * math.exp(lam * 4.95) + 0.989 * math.exp(-lam * 0.05) - 1) < 1e-6


def test_places_hold_where_lower_case_is_longer():
    assert len(ts.lowered("İdiot İ ABC")) == len("İdiot İ ABC") and ts.lowered("ABC İ") == "abc İ"


def test_scores_are_signed_and_back_off():
    scores, _ = ts.token_scores([("the", 900, 100), ("fine", 400, 1), ("bad", 0, 60), ("baddie", 0, 4), ("badly", 3, 2), ("bad*", 0, 66), ("clear", 50, 0)], 5000, 600)
    assert scores["bad"] > 0 > scores["fine"] >= ts.LOWEST and scores["clear"] < 0
    model = ts.Model(scores)
    assert "baddie" not in scores  # too rare to tell, in no clean document: its prefix decides
    assert ts.Model({"badd*": 2.0, "badly": 0.0}).score("baddie") == 2.0 and model.score("unknown") == 0.0


def plain_fit(docs, labels):
    """The model by plain counting: no Spark, quadratic segments."""
    crc = lambda i: zlib.crc32(str(i).encode()) % 5
    sample = [(i, docs[i], y) for i, y in labels.items() if y in (0, 1) and i in docs and crc(i)]
    h = {i: int(s[0]) if len(s := ts.bottomk.sketch(t)) else -1 for i, t, _ in sample}
    groups = Counter((h[i], y) for i, _, y in sample)
    first = {}
    for i, _, y in sample:
        first[h[i], y] = min(i, first.get((h[i], y), i))
    rows = [(t, y, 1 / groups[h[i], y], crc(first[h[i], y]) == 1) for i, t, y in sample]
    counts = {}
    for t, y, w, apart in rows:
        if not apart:
            for token in {c for x in set(ts.tokens_of(t)) for c in ts.chain(x)}:
                counts.setdefault(token, [0.0, 0.0])[y] += w
    n0, n1 = (sum(c[k] for token, c in counts.items() if not token.endswith("*")) for k in (0, 1))
    scores, share = ts.token_scores(sorted((t, round(a, 6), round(b, 6)) for t, (a, b) in counts.items() if a + b >= ts.COMMON - 1e-6), n0, n1)
    model = ts.Model(scores)
    model.lam = ts.solve_lambda([scores[t] for t in share], list(share.values()), model.drift)
    ts.calibrate(model, sorted((y, w, len(ts.tokens_of(t)), [s for _, _, s in plain_segments([model.score(x) - model.drift for x in ts.tokens_of(t)])]) for t, y, w, apart in rows if apart), n0, n1)
    return model


def test_whole_query_against_brute_force(spark):
    rng = random.Random(7)
    say = lambda n, words: " ".join(rng.choices(words, k=n))
    clean, foul = [f"word{i}" for i in range(60)], [f"vile{i}" for i in range(6)]
    docs = {i: say(30, clean) + (" " + say(3, foul) + " " + say(5, clean) if i % 4 == 0 else "") for i in range(400)} | {400: "", 401: "ünknown"}
    labels = {i: int(i % 4 == 0) for i in range(0, 380)}
    model = ts.fit(spark.createDataFrame(list(docs.items()), "doc_id long, text string"), spark.createDataFrame(list(labels.items()), "doc_id long, toxic int"))
    plain = plain_fit(docs, labels)
    assert model.scores == pytest.approx(plain.scores) and (model.lam, model.k, model.weight, model.bias) == pytest.approx((plain.lam, plain.k, plain.weight, plain.bias), rel=1e-6)
    got = {r.doc_id: r for r in ts.score(spark.createDataFrame(list(docs.items()), "doc_id long, text string"), model).collect()}
    for i, t in docs.items():
        tokens = ts.tokens_of(t)
        normal = [plain.lam * s - math.log(plain.k * len(tokens)) for _, _, s in plain_segments([plain.score(x) - plain.drift for x in tokens])]
        significant = [x for x in normal if ts.chance_of(x) <= ts.SIGNIFICANCE]
        assert got[i].n_passages == len(significant) and got[i].score == pytest.approx(plain.probability(sum(significant)), abs=1e-6)
    assert got[0].score > 0.5 > got[1].score


def test_a_wrong_label_does_not_hide_toxic_texts():
    """One of a thousand clean documents holds the worst passage of all."""
    rng = random.Random(4)
    clean = [(0, 1.0, 500, [rng.random() * 3 for _ in range(rng.randint(0, 2))]) for _ in range(1000)] + [(0, 1.0, 500, [85.0])]
    toxic = [(1, 1.0, 500, [10 + 10 * rng.random()]) for _ in range(100)]
    model = ts.Model({}, lam=1.2)
    ts.calibrate(model, sorted(clean + toxic), 1001.0, 100.0)
    x = [model.lam * s - math.log(model.k * 500) for s in (10.0, 3.0)]
    assert ts.chance_of(x[0]) < ts.SIGNIFICANCE < ts.chance_of(x[1]) and model.probability(x[0]) > 0.5 > model.probability(0.0)


def test_a_clean_and_a_toxic_text_of_one_least_shingle_are_both_kept(spark, monkeypatch):
    seen = []
    base = " ".join(f"word{i}" for i in range(300))
    docs = {i: base + (" vilest" if i % 2 else "") + f" end{i // 2}" for i in range(200)}
    assert len({int(ts.bottomk.sketch(t)[0]) for t in docs.values()}) < 5
    monkeypatch.setattr(ts, "token_scores", lambda rows, n0, n1: (seen.append({t: (a, b) for t, a, b in rows}), ({}, {}))[1])
    monkeypatch.setattr(ts, "COMMON", 0)
    ts.fit(spark.createDataFrame(list(docs.items()), "doc_id long, text string"), spark.createDataFrame([(i, i % 2) for i in docs], "doc_id long, toxic int"))
    assert seen[0]["word7"][0] > 0 and seen[0]["word7"][1] > 0 and seen[0]["vilest"][0] == 0 < seen[0]["vilest"][1]


@pytest.fixture(scope="module")
def learned(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    return ts.fit(docs, labels)


def test_held_out_accuracy(spark, learned):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    got = ts.op2(spark, "/root/testdata/sf0.1").join(labels, "doc_id").where("held_out").toPandas()
    assert (got.predicted == (got.score >= 0.5)).all()
    hit = got[got.toxic == 1].predicted.mean()
    wrong = got[got.toxic == 0].predicted.mean()
    print("recall", hit, "false alarms", wrong, len(got))
    assert hit > 0.9 and wrong < 0.01
    assert docs.count() == ts.op2(spark, "/root/testdata/sf0.1").count()


def test_cases(spark, learned):
    rows = [(1, None), (2, ""), (2, ""), (3, "you pathetic idiot, what a worthless moron"), (None, "İdiot scum"), (4, "the and of " * 100_000)]
    docs = spark.createDataFrame([(i, t, 0.5, 1) for i, t in rows], "doc_id long, text string, score double, y int")
    got = ts.score(docs, learned).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert by[3].score > 0.5 and by[3].n_passages >= 1 and "idiot" in rows[3][1][by[3].passages[0].start : by[3].passages[0].end]
    assert by[1].score == by[2].score == by[4].score < 0.5
    assert ts.score(docs.limit(0), learned).count() == 0


def test_no_labels(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = ts.fit(docs, labels)
    assert {r.score for r in ts.score(docs, model).collect()} and 0 <= ts.score(docs, model).first().score <= 1
