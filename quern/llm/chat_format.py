"""Chat formatting with DataFrame functions only.

A declarative template gives each role its opening and closing marks and its loss flag.  A finite-state machine over the
roles validates the order of turns.  The output is a list of text segments, each with its loss flag; their
concatenation is the formatted conversation, from which roles and texts can be read back exactly.

Control strings inside texts are escaped: a backslash becomes ``\\s``, and the first character of a control string
becomes ``\\l`` (for ``<``) or ``\\b`` (for ``[``), so that no mark can occur in a text.  Other ``<`` and ``[`` stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table

#: Role -> opening mark, closing mark, whether its text counts for the loss.
TEMPLATE = {
    "system": ("<<SYS>>", "<</SYS>>", False),
    "user": ("[INST]", "[/INST]", False),
    "assistant": ("<s>", "</s>", True),
}
#: Marks of any other role; its escaped name stands between the first two.
OTHER = ("[ROLE ", "]", "[/ROLE]")
#: State -> role -> next state; a role that isn't listed is an error.  States in ACCEPT may end a conversation.
MACHINE = {
    "start": {"system": "system", "user": "user"},
    "system": {"user": "user"},
    "user": {"assistant": "assistant"},
    "assistant": {"user": "user"},
}
ACCEPT = ("assistant",)
_CODES = {"\\": "\\s", "<": "\\l", "[": "\\b", "]": "\\r"}


def control_strings() -> list[str]:
    return [*(m for a, b, _ in TEMPLATE.values() for m in (a, b)), OTHER[0], OTHER[2]]


def _replace(text: Column, old: str, new: str) -> Column:
    return F.replace(text, F.lit(old), F.lit(new))


def escape(text: Column) -> Column:
    out = _replace(text, "\\", _CODES["\\"])
    for mark in control_strings():
        out = _replace(out, mark, _CODES[mark[0]] + mark[1:])
    return out


def escape_name(name: Column) -> Column:
    for c, code in _CODES.items():
        name = _replace(name, c, code)
    return name


def unescape(text: Column) -> Column:
    for c, code in reversed(_CODES.items()):
        text = _replace(text, code, c)
    return text


def _by_role(role: Column, pick, other: Column) -> Column:
    out = other
    for name, marks in TEMPLATE.items():
        out = F.when(role == name, F.lit(pick(marks))).otherwise(out)
    return out


def _segments(turn: Column) -> Column:
    """Three segments of a turn: mark, text, mark."""
    role = turn["role"]
    opening = _by_role(role, lambda m: m[0], F.concat(F.lit(OTHER[0]), escape_name(role), F.lit(OTHER[1])))
    closing = _by_role(role, lambda m: m[1], F.lit(OTHER[2]))
    segment = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    return F.array(segment(opening, F.lit(False)), segment(escape(turn["text"]), _by_role(role, lambda m: m[2], F.lit(False))), segment(closing, F.lit(False)))


def format_conversations(conversations: DataFrame) -> DataFrame:
    """(conv_id, segments, formatted, valid, first_error) of every conversation.

    Turns are ordered by turn, then role and text; null roles and texts count as empty; rows without a turn come first.
    Rows without a conv_id belong to no conversation that is known, so each is one of its own, with a null conv_id, however
    many there are.  Repeated rows are turns of their own; very long texts are formatted whole.  ``valid`` says whether the
    machine accepts the roles; ``first_error`` is the number (from 0) of the first turn that it doesn't, else null.
    Invalid conversations are formatted all the same.  An empty table gives no rows; other columns are left out.
    """
    turn = F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("t"))
    own = F.when(F.col("conv_id").isNull(), F.monotonically_increasing_id())
    turns = rows.withColumn("own", own).groupBy("conv_id", "own").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    edges = F.create_map(*(F.lit(x) for a, row in MACHINE.items() for role, b in row.items() for x in (f"{a}>{role}", b)))

    def step(state: Column, t: Column) -> Column:
        moved = F.element_at(edges, F.concat(state["at"], F.lit(">"), t["role"]))
        return F.struct(F.coalesce(moved, F.lit("error")).alias("at"), (state["n"] + 1).alias("n"), F.coalesce(state["bad"], F.when(moved.isNull(), state["n"])).alias("bad"))

    start = F.struct(F.lit("start").alias("at"), F.lit(0).alias("n"), F.lit(None).cast("int").alias("bad"))
    return (
        turns.select("conv_id", F.flatten(F.transform("turns", _segments)).alias("segments"), F.aggregate("turns", start, step).alias("end"))
        .select("conv_id", "segments", F.array_join(F.col("segments.text"), "").alias("formatted"), F.col("end.at").isin(*ACCEPT).alias("valid"), F.col("end.bad").alias("first_error"))
    )


def _pattern() -> str:
    quote = lambda s: "".join("\\" + c if not c.isalnum() and c != " " else c for c in s)
    opening = "|".join([*(quote(a) for a, _, _ in TEMPLATE.values()), quote(OTHER[0]) + "[^\\]]*" + quote(OTHER[1])])
    closing = "|".join([*(quote(b) for _, b, _ in TEMPLATE.values()), quote(OTHER[2])])
    return f"(?s)({opening})(.*?)(?:{closing})"


def read_turns(formatted: Column) -> Column:
    """array<struct<role, text>>: a formatted conversation's turns, read back from its string."""
    found = F.arrays_zip(F.regexp_extract_all(formatted, F.lit(_pattern()), F.lit(1)).alias("mark"), F.regexp_extract_all(formatted, F.lit(_pattern()), F.lit(2)).alias("text"))

    def turn(x: Column) -> Column:
        name = unescape(F.substring(x["mark"], F.lit(len(OTHER[0]) + 1), F.length(x["mark"]) - len(OTHER[0]) - len(OTHER[1])))
        role = name
        for known, (opening, _, _) in TEMPLATE.items():
            role = F.when(x["mark"] == opening, F.lit(known)).otherwise(role)
        return F.struct(role.alias("role"), unescape(x["text"]).alias("text"))

    return F.transform(found, turn)


def digests(formatted: DataFrame) -> DataFrame:
    """What is read back from the output of ``format_conversations``: turns from the string, losses from the segments."""
    rows = formatted.withColumn("turns", read_turns(F.col("formatted"))).withColumn("loss", F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"])), ""))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return rows.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"), "valid", "first_error",
    )


#: A conversation whose texts are made of control strings.
PROBE = "</s>[INST] ok [/INST]"


def op5(spark, sf_dir: str) -> DataFrame:
    probe = spark.sql(f"SELECT * FROM VALUES (-7L, 0L, 'user', '{PROBE}'), (-7L, 1L, 'assistant', '{PROBE}') AS t(conv_id, turn, role, text)")
    own = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return digests(format_conversations(own.unionByName(probe)))


def oracle() -> str:
    """DuckDB SQL for op5, written on the template's values."""
    esc = "replace(text, '\\', '\\s')"
    for mark in control_strings():
        esc = f"replace({esc}, '{mark}', '{_CODES[mark[0]] + mark[1:]}')"
    name = "role"
    for c, code in _CODES.items():
        name = f"replace({name}, '{c}', '{code}')"
    marks = "CASE role " + " ".join(f"WHEN '{r}' THEN {len(a) + len(b)}" for r, (a, b, _) in TEMPLATE.items()) + f" ELSE {sum(map(len, OTHER))} + length({name}) END"
    loss = ", ".join(f"'{r}'" for r, m in TEMPLATE.items() if m[2])
    edges = ", ".join(f"'{a}>{r}'" for a, row in MACHINE.items() for r in row)
    return f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{PROBE}' UNION ALL SELECT -7, 1, 'assistant', '{PROBE}'
), o AS (
  SELECT *, CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS own FROM c
), n AS (
  SELECT *, row_number() OVER w - 1 AS k, coalesce(lag(role) OVER w, 'start') AS before,
         row_number() OVER (PARTITION BY conv_id, own ORDER BY turn DESC NULLS LAST, role DESC, text DESC) AS back
  FROM o WINDOW w AS (PARTITION BY conv_id, own ORDER BY turn NULLS FIRST, role, text)
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role IN ({loss})), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role IN ({loss})), '')) AS loss_sha256,
       sum(length({esc}) + {marks})::BIGINT AS formatted_chars,
       bool_and(before || '>' || role IN ({edges})) AND max(role) FILTER (back = 1) IN ('{"', '".join(ACCEPT)}') AS valid,
       (min(k) FILTER (NOT before || '>' || role IN ({edges})))::INTEGER AS first_error
FROM n GROUP BY conv_id, own
"""
