import random
import zlib
from itertools import combinations

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from quern.llm import piece_lattice as pl

SP = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
PIECES = pl.load()
TRICKY = ["", " ", "  ", "a", " a ", "hello  world\n\nfoo", "\t\x01é漢🙂", "a\n", "\n \n  b", "x" * 200, "the " * 50 + "     end", "____====....", "ÀÉîõü ßñ", "a b", "<0x0A> <s> </s>", "日本語テキスト", "ab" * 500, "a\0b", "\0", "\0\0 \0the"]


@pytest.fixture(scope="module")
def words(spark):
    text = "\n".join(r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect())
    return sorted({w for t in [text, *TRICKY] for w in pl.words_of(t, PIECES, PIECES.pattern)})


def library(word):
    """The library's ids of a single word, without the space that it puts before a text."""
    plain = word.replace(pl.SPACE, " ")
    if word.startswith(pl.SPACE):
        return SP.encode(plain[1:]) if plain[1:] else [PIECES.normal[pl.SPACE][0]]
    return SP.encode("\n" + plain)[2:]


def test_words_in_a_task_against_the_library(words):
    for w in words:
        assert pl.merge(w, PIECES) == library(w), w


def test_long_and_short_words_merge_alike(words, monkeypatch):
    short = [pl.merge(w, PIECES) for w in words if len(w) <= pl.LONGEST]
    monkeypatch.setattr(pl, "LONGEST", 0)
    assert short == [pl.merge(w, PIECES) for w in words if len(w) <= 48]


def test_keys_stand_for_the_pattern_s_words():
    rng = random.Random(5)
    for _ in range(500):
        text = "".join(rng.choices(["a", "bc", " ", "\n", "é", "▁"], k=rng.randint(1, 12)))
        keys = pl.keys_of(text)
        words = pl.words_of(text, PIECES, PIECES.pattern)
        if keys is not None:
            assert [w for k in keys for w in pl.words_of_key(k)] == words
        else:
            assert "  " in f" {text} " or " \n" in text or text[-1] == " " or text[0] == "\n" or "▁" in text


def test_lattice_against_the_task(spark, words):
    got = {r.word: PIECES.characters(r.ids) for r in pl.solve(spark.createDataFrame([(w,) for w in words], "word string"), PIECES).collect()}
    assert len(got) > 0.99 * sum(len(w) <= pl.LONGEST for w in words)
    for w, ids in got.items():
        assert ids == pl.merge(w, PIECES)


def test_viterbi_against_all_paths(spark):
    rng = random.Random(1)
    table = {"".join(p): (i + 3, -rng.random() * 9) for i, p in enumerate({tuple(rng.choices("abc", k=rng.randint(1, 4))) for _ in range(30)} - {("c",)})}
    pieces = pl.Pieces(pl.UNIGRAM, table, [], 0, True, [])
    low = min(s for _, s in table.values()) - pl.UNKNOWN_PENALTY
    words = sorted({"".join(rng.choices("abcé\0", k=rng.randint(1, 8))) for _ in range(60)})

    def brute(w):
        best = None
        for n in range(len(w)):
            for cuts in combinations(range(1, len(w)), n):
                b = [0, *cuts, len(w)]
                parts = [w[i:j] for i, j in zip(b, b[1:])]
                if all(p in table or len(p) == 1 for p in parts):
                    s = sum(table[p][1] if p in table else low for p in parts)
                    if best is None or s > best[0]:
                        best = (s, parts)
        return pieces.characters([table[p][0] if p in table else -1 - ord(p) for p in best[1]])

    got = {r.word: pieces.characters(r.ids) for r in pl.solve(spark.createDataFrame([(w,) for w in words], "word string"), pieces).collect()}
    for w in words:
        assert pl.viterbi(w, pieces) == brute(w)
        assert got.get(w, brute(w)) == brute(w)
    assert len(got) > len(words) // 2


def test_whole_texts(spark):
    rows = [(i, t) for i, t in enumerate(TRICKY)] + [(100, None), (None, "no id"), (3, "a"), (101, "long word " * 30_000), (102, "▁")]
    docs = spark.createDataFrame([(i, t, [1], True) for i, t in rows], "doc_id long, text string, ids array<int>, round_trip boolean")
    got = pl.encode(docs, most=50)
    out = got.collect()
    assert sorted((str(r.doc_id), tuple(r.ids)) for r in out) == sorted((str(i), tuple(SP.encode(t or ""))) for i, t in rows)
    assert all(r.round_trip and r.n_tokens == len(r.ids) for r in out)
    back = pl.decode_all(got).collect()
    assert sorted((str(r.doc_id), r.text) for r in back) == sorted((str(i), (t or "").replace("▁", " ")) for i, t in rows)
    assert pl.encode(docs.limit(0)).count() == 0


def test_fuzzed_texts_against_the_library(spark):
    rng = random.Random(11)
    kinds = [list("ab \n\0"), list("the in ion "), list("▁ a\t\x01é漢🙂"), [chr(c) for c in range(0x250)]]
    texts = ["".join(rng.choices(rng.choice(kinds), k=rng.randint(0, 25))) for _ in range(4000)]
    docs = spark.createDataFrame(list(enumerate(texts)) + [(-1 - i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for r in pl.encode(docs).collect():  # every word occurs twice at least, so the lattice has it
        text = texts[r.doc_id if r.doc_id >= 0 else -1 - r.doc_id]
        assert (r.ids, r.round_trip) == (SP.encode(text), True), text


def test_a_band_that_is_too_large_fills_the_dictionary(spark):
    docs = spark.createDataFrame([(i, " ".join(f"w{k:04d}x" for k in range(3000)) + " the the the") for i in range(2)], "doc_id long, text string")
    known = pl.dictionary(docs, PIECES, most=500)
    assert 350 < len(known) < 650 and "the" in known
    assert all(np.frombuffer(ids, "<u4").tolist() == SP.encode(w) for w, ids in known.items())


def test_query_against_the_library(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    got = pl.op10(spark, "/root/testdata/sf0.001").collect()
    assert len(got) == len(texts)
    for r in got:
        ids = SP.encode(texts[r.doc_id])
        assert (r.n_tokens, r.ids_crc32, r.round_trip) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), True)
