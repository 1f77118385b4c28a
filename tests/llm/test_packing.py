import math
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from quern.llm import packing as pk
from quern.llm.common import materialize

SLOW = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def ids_of(text):
    return SLOW.encode(text or "", add_special_tokens=False).ids + [0]


def test_encoders_agree():
    rng = random.Random(1)
    encode = pk.encoder()
    below = [chr(c) for c in range(1, 0x500)]
    for _ in range(400):
        text = "".join(rng.choices(below if rng.random() < 0.5 else list("ab 'sré\n\t  1!\xa0\x85"), k=rng.randint(0, 60)))
        assert encode(text).tolist() == ids_of(text)[:-1]
    for text in ("漢字 🙂 a", "x<|endoftext|>y", "", "  \n ", "ԱԲ"):
        assert encode(text).tolist() == ids_of(text)[:-1]


def plain_best_fit(lengths, capacity, most):
    """Closed bins as lists of items, by a plain search over the open bins."""
    bins, closed = [], []  # a bin: free space, items
    for i, n in enumerate(lengths):
        fits = [b for b in bins if b[0] >= n]
        own = min(reversed(fits), key=lambda b: b[0]) if fits else [capacity, []]
        if fits:
            bins = [b for b in bins if b is not own]
        own[0] -= n
        own[1].append(i)
        if own[0]:
            bins.append(own)  # of equal bins the one used last is taken
        else:
            closed.append(own[1])
        if len(bins) > most:
            fullest = min(reversed(bins), key=lambda b: b[0])
            bins = [b for b in bins if b is not fullest]
            closed.append(fullest[1])
    return closed + [b[1] for b in bins]


def test_best_fit_takes_the_fullest_that_fits():
    rng = random.Random(2)
    lengths = [rng.randint(1, 50) for _ in range(2000)]
    packer = pk.Packer(50, 5)
    closed = [[x for x, _ in b] for i, n in enumerate(lengths) for b in packer.add(i, n)]
    assert packer.open <= 5
    closed += [[x for x, _ in b] for b in packer.finish()]
    assert sorted(closed) == sorted(plain_best_fit(lengths, 50, 5))


@pytest.mark.parametrize("parts", [1, 7])
def test_whole_packing_against_plain_search(spark, parts):
    """However the texts are split, all pieces go through the bounded packer, in the order in which they are read."""
    rng = random.Random(8)
    docs = spark.createDataFrame([(i, "word " * rng.randint(0, 150)) for i in range(600)], "doc_id long, text string").repartition(parts)
    pieces = materialize(pk.cut_pieces(docs, capacity=64), "pieces")
    order = pieces.coalesce(1).collect()
    got = defaultdict(list)
    for r in pk.place(pieces.coalesce(1), capacity=64, bins=6).collect():
        got[r.sequence_id].append((r.offset, r.doc_id, r.piece))
    want = [[(order[i].doc_id, order[i].piece) for i in own] for own in plain_best_fit([r.length for r in order], 64, 6)]
    assert sorted([x[1:] for x in sorted(own)] for own in got.values()) == sorted(want)


def test_cut():
    assert pk.cut(1) == [(0, 1)] and pk.cut(2048) == [(0, 2048)] and pk.cut(2049) == [(0, 1), (1, 2048)] and pk.cut(4096) == [(0, 2048), (2048, 2048)]


def check(got, rows, slack):
    texts = defaultdict(list)
    for i, t in rows:
        texts[i].append(ids_of(t))
    pieces, bins = defaultdict(list), defaultdict(list)
    for r in got:
        pieces[r.doc_id].append(r)
        bins[r.sequence_id].append((r.offset, r.length))
    assert set(pieces) == set(texts)
    for i, own in pieces.items():
        want = sorted((p, s, n, zlib.crc32(np.array(ids[s : s + n], "<u4").tobytes())) for ids in texts[i] for p, (s, n) in enumerate(pk.cut(len(ids))))
        assert sorted((r.piece, r.start, r.length, r.ids_crc32) for r in own) == want
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
    total = sum(r.length for r in got)
    assert len(bins) <= math.ceil(total / 2048 * slack) + 1


def test_cases(spark):
    rng = random.Random(3)
    rows = [(1, None), (2, ""), (2, ""), (None, "no id"), (3, "word " * 30_000), (4, "<|endoftext|>")]
    rows += [(i, " ".join(rng.choices(["the", "é", "wörd", "x1"], k=rng.randint(0, 1500)))) for i in range(10, 300)]
    docs = spark.createDataFrame([(i, t, 5, [1]) for i, t in rows], "doc_id long, text string, piece int, ids array<int>").repartition(6)
    check(pk.pack(docs).collect(), rows, 1.05)
    assert pk.pack(docs.limit(0)).count() == 0


def test_sequences_hold_the_ids(spark):
    rows = [(i, f"text number {i} " * i) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    packed = pk.pack(docs, with_ids=True)
    check(packed.collect(), rows, 1.1)
    assert sum(len(r.ids) for r in pk.sequences(packed).collect()) == sum(len(ids_of(t)) for _, t in rows)


def test_query(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    check(pk.op6(spark, "/root/testdata/sf0.01").collect(), [tuple(r) for r in docs], 1.02)
