import hashlib
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quern.llm import bottomk as bk


def words(rng, n):
    return " ".join(f"w{rng.randrange(500)}" for _ in range(n))


def shingles(text):
    w = text.encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_estimates_follow_brute_force():
    rng = random.Random(1)
    for n in (3, 20, 100, 1000, 5000):
        a, b = words(rng, n), words(rng, n)
        mixed = a[: len(a) // 2] + b[len(b) // 2 :]
        x, y = shingles(a), shingles(mixed)
        s, t = bk.sketch(a), bk.sketch(mixed)
        assert abs(bk.resemblance(s, t) - len(x & y) / len(x | y)) < (1e-9 if len(x | y) <= bk.K else 0.17)
        assert abs(bk.containment(s, t) - len(x & y) / len(x)) < 0.3
        assert abs(bk.distinct(s) / len(x) - 1) < 0.4


def test_merge_is_the_sketch_of_both_parts():
    rng = random.Random(2)
    a, b = words(rng, 700), words(rng, 900)
    both = np.union1d(bk.shingle_hashes(a.encode()), bk.shingle_hashes(b.encode()))[: bk.K]
    assert (bk.merge(bk.sketch(a), bk.sketch(b)) == both).all()


def test_round_trip_and_repeats():
    for text in ("", "a", "a b c d e f", "x " * 100_000, words(random.Random(3), 9000)):
        s = bk.sketch(text)
        assert (bk.decode(bk.encode(s)) == s).all()
        assert (s == np.unique(bk.shingle_hashes(text.encode().lower()))[: bk.K]).all()


def xxhash64(text):
    """Spark's hash of a string."""
    h = xxhash.xxh64_intdigest(text.encode(), 42)
    return h - (1 << 64) if h >> 63 else h


def brute(rows):
    order = sorted(rows, key=lambda r: (-(r[0] if r[0] is not None else -(1 << 63)), xxhash64(r[1] or "")))
    out = []
    for i, (doc_id, text) in enumerate(order):
        text, after = text or "", order[(i + 1) % len(order)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        s, e, n = map(bk.sketch, (text, edited, after))
        out.append((doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), bk.encode(s), bk.encode(e), bk.resemblance(s, e), bk.resemblance(s, n)))
    return out


def test_long_texts_in_pieces(monkeypatch):
    rng = random.Random(6)
    cases = [words(rng, 5000), "y" * 9000, "a " + "z" * 5000 + " b c d e f", "é" * 4000 + "\n" + words(rng, 300), "k" * 3000 + " " + "l" * 3000, " " * 5000, "m" * 2048 + " " + "n" * 1024 + " o", "p " * 3000]
    whole = [(bk.sketch(t), bk.word_hashes(t.encode())) for t in cases]
    monkeypatch.setattr(bk, "PIECE", 1024)
    for t, (s, w) in zip(cases, whole):
        assert (bk.sketch(t) == s).all() and (bk.word_hashes(t.encode()) == w).all()


def test_memory_of_a_long_text():
    import tracemalloc

    text = "word and some " * 1_500_000  # 21 MB
    tracemalloc.start()
    bk.sketch(text)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 6 * len(text)


def test_equal_ids_spread(spark):
    docs = spark.createDataFrame([(None if i % 3 else 5, f"t{i}" if i % 2 else "same") for i in range(3000)], "doc_id long, text string").repartition(6)
    dealt = bk.with_neighbour_ranges(docs)
    sizes = [r["n"] for r in dealt.where("ghost = 0").groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
    assert sum(sizes) == 3000 and len(sizes) >= 5 and max(sizes) < 1200
    assert dealt.where("ghost = 1").count() <= 6


@pytest.mark.parametrize("case", ["empty", "one", "many", "ties"])
def test_neighbours_against_brute_force(spark, case):
    rng = random.Random(4)
    rows = {
        "empty": [],
        "one": [(3, "only one é text here now")],
        "many": [(i * i, words(rng, rng.choice([0, 1, 3, 50, 400]))) for i in rng.sample(range(500), 200)] + [(-5, None), (10**15, "é" * 50_001)],
        "ties": [(1, "b"), (1, "a"), (1, "a"), (2, None), (None, "last"), (None, "x"), (2, ""), (0, "c")],
    }[case]
    docs = spark.createDataFrame([(i, t, 1, "g") for i, t in rows], "doc_id long, text string, place int, ghost string").repartition(5)
    got = [tuple(r)[:7] for r in bk.compare_neighbours(docs).collect()]
    assert sorted(got, key=str) == sorted(brute(rows), key=str)


def test_query_over_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    got = [tuple(r)[:7] for r in bk.op9(spark, "/root/testdata/sf0.001").collect()]
    assert sorted(got, key=str) == sorted(brute([tuple(r) for r in docs.collect()]), key=str)
