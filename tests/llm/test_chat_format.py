import hashlib
import random

import duckdb
from pyspark.sql import functions as F

from quern.llm import chat_format as cf


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_round_trip_of_hostile_texts(spark):
    rng = random.Random(1)
    parts = [*cf.control_strings(), "\\", "\\l", "\\b", "\\s", "<", "[", "]", "é", "\n", " ", "x", "</", "<<", "[/"]
    roles = ["user", "assistant", "system", "tool", "", "a]b[\\", "</s>"]
    rows = [(c, t, rng.choice(roles), "".join(rng.choices(parts, k=rng.randint(0, 12)))) for c in range(150) for t in range(rng.randint(1, 6))]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    out = cf.format_conversations(df)
    got = {r.conv_id: r for r in cf.digests(out).collect()}
    shown = {r.conv_id: r for r in out.withColumn("turns", cf.read_turns(F.col("formatted"))).collect()}
    for c in range(150):
        own = [(r, t) for i, _, r, t in rows if i == c]
        assert [tuple(t) for t in shown[c].turns] == own
        loss = "".join(t for r, t in own if r == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256) == (len(own), sha("".join(f"{r}\n{t}\n" for r, t in own)))
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), sha(loss))
        assert got[c].formatted_chars == len(shown[c].formatted) == len("".join(s.text for s in shown[c].segments))
        for mark in cf.control_strings():
            assert not any(mark in s.text for s in shown[c].segments[1::3])


def test_machine(spark):
    wanted = {"ua": (True, None), "sua": (True, None), "uaua": (True, None), "u": (False, None), "uu": (False, 1), "a": (False, 0), "us": (False, 1), "uau": (False, None), "ss": (False, 1), "ut": (False, 1)}
    name = {"u": "user", "a": "assistant", "s": "system", "t": "tool"}
    rows = [(i, t, name[r], "x") for i, order in enumerate(wanted) for t, r in enumerate(order)]
    got = {r.conv_id: (r.valid, r.first_error) for r in cf.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert [got[i] for i in range(len(wanted))] == list(wanted.values())


def test_cases(spark):
    rows = [(1, 0, None, None, 1), (1, 0, "user", "a", 1), (1, 0, "user", "a", 1), (None, None, "user", "b" * 200_000, 1), (2, 5, "assistant", None, 1)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, segments int")
    got = {r.conv_id: (r.n_turns, r.loss_chars) for r in cf.digests(cf.format_conversations(df)).collect()}
    assert got == {1: (3, 0), None: (1, 0), 2: (1, 0)}
    assert cf.format_conversations(df.limit(0)).count() == 0


def test_rows_without_a_conversation_are_their_own(spark):
    rows = [(None, i, "user", f"t{i}") for i in range(50)] + [(3, 0, "user", "a"), (3, 1, "assistant", "b")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    got = cf.digests(cf.format_conversations(df)).collect()
    assert sorted((str(r.conv_id), r.n_turns) for r in got) == [("3", 2)] + [("None", 1)] * 50
    con = duckdb.connect()
    con.register("t", df.toPandas())
    con.execute("CREATE VIEW conversations AS SELECT conv_id::BIGINT AS conv_id, turn, role, text FROM t")
    assert sorted((str(r[0]), r[2]) for r in con.execute(cf.oracle()).fetchall() if r[0] != -7) == sorted((str(r.conv_id), r.turns_sha256) for r in got)


def test_plan_is_native(spark):
    plan = cf.op5(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))


def test_query_against_sql(spark):
    con = duckdb.connect()
    con.execute("CREATE VIEW conversations AS SELECT * FROM '/root/testdata/sf0.01/conversations.parquet'")
    want = con.execute(cf.oracle()).fetchall()
    got = [tuple(r) for r in cf.op5(spark, "/root/testdata/sf0.01").collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and any(r[0] == -7 for r in got)
