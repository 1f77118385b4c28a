import random
from collections import Counter, defaultdict

import duckdb

from quern.llm import line_rules as lr


def plain_repeats(words):
    wins = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    n = Counter(wins)
    return len({i + j for i, w in enumerate(wins) if n[w] > 1 for j in range(8)})


def test_repeated_words_against_brute_force():
    rng = random.Random(1)
    for _ in range(300):
        words = [rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randint(0, 60))]
        if rng.random() < 0.3:
            words = [b"%d" % rng.randrange(1000) for _ in range(30)] + words
        assert lr.repeated_words(words) == plain_repeats(words)


def test_measures():
    text = "A b\n\nA b \nA b\n \x0b\n#é\u2003$x y"
    n, chars, symbols, dup, repeat, lines, words = lr.measures(text)
    assert (n, chars, symbols, dup, repeat) == (8, 12, 2, 1, 0)
    assert len(lines) == 2 and sorted(words) == [2, 6]


def brute(rows):
    of = defaultdict(set)
    docs = defaultdict(set)
    for i, t, s in rows:
        d = -(1 << 63) if i is None else i
        docs[s or ""].add(d)
        for line in (t or "").split("\n"):
            if (h := lr.line_hash(line.encode())) is not None:
                of[s or "", h].add(d)
    out = []
    for i, t, s in rows:
        t = t or ""
        words = t.encode().split()
        gone = sum(len(x.encode().split()) for x in t.split("\n") if (h := lr.line_hash(x.encode())) is not None and len(of[s or "", h]) > max(10, -(-len(docs[s or ""]) // 100)))
        repeat = plain_repeats(words)
        failed = len(words) < 20 or 100 * repeat > 30 * len(words)
        out.append((i, len(words), repeat, failed, not failed and len(words) - gone >= 0.3 * len(words), gone))
    return out


def cases():
    rng = random.Random(2)
    sentence = lambda n: " ".join(f"w{rng.randrange(3000)}" for _ in range(n))
    rows = [(None, None, None), (None, "x y", ""), (1, "", "a"), (2, "long " * 40_000, "a"), (3, "é\n" * 30, None)]
    boiler = sentence(30)
    for i in range(10, 60):
        own = sentence(rng.choice([5, 15, 60]))
        rows.append((i, own + "\n" + (boiler.upper() if i % 2 else boiler) + "\n\t ", "a" if i % 3 else "b"))
    return rows + [rows[-1], rows[-1]]


def test_against_brute_force(spark):
    rows = cases()
    docs = spark.createDataFrame([(*r, 7, "z") for r in rows], "doc_id long, text string, source string, n_words int, host string")
    got = [(r.doc_id, r.n_words, r.n_repeat_words, r.base_failed, r.kept, r.n_removed_words) for r in lr.judge(docs).collect()]
    assert sorted(got, key=str) == sorted(brute(rows), key=str)
    assert any(r[4] for r in got) and any(not r[4] and not r[3] for r in got)
    assert lr.judge(docs.limit(0)).count() == 0


def test_lines_are_taken_out(spark):
    rows = [(i, f"own line {i} of text\nShared  line\n\nlast", "h") for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r.text for r in lr.without_common_lines(docs).collect()}
    assert got == {i: f"own line {i} of text\n" for i in range(30)}


def test_query_against_sql(spark):
    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.01/documents.parquet'")
    want = con.execute(lr.ORACLE).fetchall()
    got = [tuple(r) for r in lr.op4(spark, "/root/testdata/sf0.01").collect()]
    assert sorted(got) == sorted(want)
