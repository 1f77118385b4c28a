import random
from itertools import combinations

import numpy as np

import corpus_pipeline as cpl
from quern.llm import resemblance as rs
from quern.llm.common import table


def plain_shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def similar(a, b):
    if 5 * min(len(a), len(b)) < 4 * max(len(a), len(b)):
        return False
    both = len(a & b)
    return a == b or 5 * both >= 4 * (len(a) + len(b) - both)


def plain_components(texts):
    sets = {i: plain_shingles(t) for i, t in texts.items()}
    of = {i: i for i in sets}
    for a, b in combinations(sorted(sets), 2):
        if of[a] != of[b] and similar(sets[a], sets[b]):
            low, high = sorted((of[a], of[b]))
            of = {i: low if c == high else c for i, c in of.items()}
    return of


def cases():
    rng = random.Random(3)
    words = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    texts = [None, "", " \n", "a b", "A  b", "a b c d e", "a b c d e f"]
    for _ in range(12):  # chains of edits, of similarities about the least one
        text = words(rng.choice([20, 60, 300]))
        for _ in range(8):
            text = list(text)
            for _ in range(rng.choice([1, 1, 2, len(text) // 60 + 1])):
                text[rng.randrange(len(text))] = rng.choice(words(1))
            texts.append(" ".join(text))
    base = words(400)
    for i in range(60):  # a large group: most are near copies of each other, some of the template only in part
        own = base[: 400 - i] + words(i)
        texts.append(" ".join(own))
    rng.shuffle(texts)
    return dict(enumerate(texts, 5))


def test_components_against_brute_force(spark):
    texts = cases()
    docs = spark.createDataFrame([(i, t, 7) for i, t in texts.items()], "doc_id long, text string, n int")
    got = {r.doc_id: r.component_id for r in rs.near_duplicates(docs).collect()}
    want = plain_components(texts)
    assert got == want
    assert 15 < len(set(want.values())) < len(texts) - 40
    assert rs.near_duplicates(docs.limit(0)).count() == 0


def test_blocks_link_what_one_index_links(spark, monkeypatch):
    """Few shingles a block: clusters are cut, and texts of smaller parts are looked up in every block."""
    texts = cases()
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    whole = rs.groups
    monkeypatch.setattr(rs, "groups", lambda distinct, docs: whole(distinct, docs, block=500))
    assert {r.doc_id: r.component_id for r in rs.near_duplicates(docs).collect()} == plain_components(texts)


def test_index_against_plain_sets():
    rng = random.Random(5)
    sets = [np.unique(rng.choices(range(60), k=rng.randint(1, 40))) for _ in range(80)] + [np.empty(0, np.int64)]
    parts = [rng.randrange(9) for _ in sets]
    index = rs.Index(parts, sets)
    for s in sets:
        want = {p for p, t in zip(parts, sets) if p != 4 and 9 * len(set(s) & set(t)) >= 4 * (len(s) + len(t))}
        assert set(index.parts_like(s, 4).tolist()) == want


def test_a_large_group_costs_no_pairs(spark):
    """Copies of one original, edited more or less: proposals and links stay in proportion to the copies."""
    rng = random.Random(9)
    base = [f"w{i}" for i in range(150)]
    texts = {}
    for i in range(400):
        own = list(base)
        for _ in range(rng.randint(0, 9)):
            own[rng.randrange(150)] = f"x{rng.random()}"
        texts[i] = " ".join(own)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    assert {r.doc_id: r.component_id for r in rs.near_duplicates(docs).collect()} == plain_components(texts)


def test_no_similar_pair_survives_the_stage(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    of = plain_components({r.doc_id: r.text for r in docs.collect()})
    kept = cpl.near_duplicates(spark, docs, "").collect()
    assert sorted(r.doc_id for r in kept) == sorted(set(of.values()))
    sets = [plain_shingles(r.text) for r in kept]
    assert sum(similar(a, b) for a, b in combinations(sets, 2)) == 0
