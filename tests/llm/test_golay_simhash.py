import random
from itertools import combinations

import numpy as np
import pytest
import xxhash

from quern.llm import golay_simhash as gs


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(fps):
    """fps: {doc_id: fingerprint}; brute force over all pairs."""
    up = {d: d for d in fps}

    def root(d):
        while up[d] != d:
            d = up[d]
        return d

    for a, b in combinations(sorted(fps), 2):
        if (fps[a] ^ fps[b]).bit_count() <= 3:
            x, y = sorted((root(a), root(b)))
            up[y] = x
    return {d: root(d) for d in fps}


def test_code_is_perfect_and_keys_are_shared():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 1 << 23, 3000)
    near = gs.codewords(words)
    assert all(gs._syndrome(int(x)) == 0 for x in ((w ^ int(e)) for w, e in zip(words, gs._cosets()[[gs._syndrome(int(w)) for w in words], 0])))
    assert {len(set(r)) for r in near.tolist()} <= {1, 6}
    other = gs.codewords(words ^ (1 << rng.integers(0, 23, 3000)))
    assert all(set(a) & set(b) for a, b in zip(near.tolist(), other.tolist()))


def test_pairs_within_three_bits_share_a_key():
    rng = random.Random(2)
    for _ in range(400):
        x = rng.getrandbits(64)
        y = x
        for b in rng.sample(range(64), rng.randint(0, 3)):
            y ^= 1 << b
        row, key = gs.keys(np.array([x, y], np.uint64))
        assert set(key[row == 0]) & set(key[row == 1])
        assert len(set(key[row == 0].tolist())) == (row == 0).sum()


def test_star_joins_what_all_links_join():
    rng = random.Random(3)
    seeds = [rng.getrandbits(64) for _ in range(5)]
    fps = sorted({s ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))) for s in seeds for _ in range(30)})
    a, b = gs.star(np.array(fps, np.uint64))
    want = plain_components(dict(zip(fps, fps)))
    got = {f: f for f in fps}
    got.update(zip(b.tolist(), a.tolist()))
    assert got == want


@pytest.mark.parametrize("n", [0, 1])
def test_small_tables(spark, n):
    docs = spark.createDataFrame([(5, "a b c")] * n, "doc_id long, text string")
    assert gs.near_duplicates(docs).count() == n


def test_cases_against_brute_force(spark):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(300)]
    rows = [(0, None), (1, ""), (2, " \n"), (3, "One two"), (4, "one  TWO"), (5, "É x y"), (6, "é x y"), (7, "a b c d")]
    for i in range(8, 60, 4):
        words = rng.choices(vocabulary, k=400)
        rows += [(i, " ".join(words)), (i + 1, "\n".join(words)), (i + 2, " ".join(words[:-1])), (i + 3, " ".join(rng.choices(vocabulary, k=5)))]
    rows += [(60, "long " * 30000), (9, rows[9][1])]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, key string, fp int")
    got = gs.near_duplicates(docs).collect()
    fps = {i: plain_fingerprint(t) for i, t in rows}
    want = plain_components(fps)
    assert sorted((r.doc_id, r.fingerprint, r.component_id) for r in got) == sorted((i, f"{fps[i]:016x}", want[i]) for i, _ in rows)


def test_row_without_id(spark):
    docs = spark.createDataFrame([(None, "a b c d"), (7, "a b c d"), (None, "q r s t u")], "doc_id long, text string")
    got = {(r.doc_id, r.component_id) for r in gs.near_duplicates(docs).collect()}
    assert got == {(None, 7), (7, 7), (None, None)}


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 103), (101, 103)], "a long, b long")
    got = {r.node: r.root for r in gs.components(edges).collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, 101: 100, 103: 100}


def test_common_keys_are_dealt_again(spark):
    """Runs above the bound get second keys and join the same fingerprints."""
    rng = random.Random(6)
    fps = sorted({rng.getrandbits(1) << 60 ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))) for _ in range(300)})
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    distinct = spark.createDataFrame([(f,) for f in signed], "fp long").repartition(3)
    want = plain_components({s: f for s, f in zip(signed, fps)})
    for most in (5, 40, gs.RUN):
        found = {r.node: r.root for r in gs.components(gs.links(distinct, most)).collect()}
        assert {s: found.get(s, s) for s in signed} == want


def test_columns_keep_their_values(spark):
    docs = spark.createDataFrame([(1, "a b c d", 7, "x"), (2, "a b c d", 8, "y"), (None, "q r s", 9, "z")], "doc_id long, text string, __quern_key int, __QUERN_TEXT string")
    assert sorted(map(tuple, gs.one_of_each_group(docs).collect()), key=str) == sorted([(1, "a b c d", 7, "x"), (None, "q r s", 9, "z")], key=str)


def test_rounds_of_components_write_few_files(spark, monkeypatch):
    written = []

    def counted(df, label, real=gs.materialize):
        out = real(df, label)
        written.append(len(out.inputFiles()))
        return out

    monkeypatch.setattr(gs, "materialize", counted)
    edges = spark.range(100).selectExpr("id * 7 AS a", "id * 7 + 7 AS b")  # a path
    for name, value in (("spark.sql.shuffle.partitions", "60"), ("spark.sql.adaptive.coalescePartitions.enabled", "false")):
        spark.conf.set(name, value)
    try:
        got = gs.components(edges).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted(tuple(r) for r in got) == [(7 * i, 0) for i in range(1, 101)]
    assert len(written) > 2 and max(written[1:]) <= gs.FILES
