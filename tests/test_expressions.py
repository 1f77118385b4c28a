"""The expression compiler against Python's own evaluation."""

import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from quern.functions import expressions as ex

ROWS = [(1, -7, 2.5, "abc"), (2, 3, -0.5, ""), (3, 0, 0.0, "Hello World"), (4, 12, 7.75, "é_x")]
NAMES = ("i", "n", "x", "s")


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame(ROWS, "i long, n long, x double, s string").cache()


def both(frame, text):
    got = {r.i: r.v for r in frame.select("i", ex.compile_scalar(text, frame).alias("v")).collect()}
    want = {r[0]: eval(text, {"math": math}, dict(zip(NAMES, r))) for r in ROWS}
    return got, want


CASES = [
    "n // 3", "n % 3", "n // -3", "n % -3", "x // 2", "n / 2", "i ** 2", "n * 2 - i + 1", "-n", "+n", "~n", "n & 6", "n | 6", "n ^ 6", "i << 3", "n >> 1",
    "n == 3", "n != 3", "1 < n <= 12", "n in (3, 12)", "n not in [3]", "not n", "n and i", "n or i", "s or 'none'", "(n > 1) and (x > 0) or not (i < 3)", "'yes' if n > 0 else 'no'",
    "abs(n)", "round(x)", "round(x, 1)", "min(n, i)", "max(n, i, 5)", "len(s)", "int(x)", "float(n)", "math.floor(x)", "math.ceil(x)", "math.sqrt(i)", "pow(i, 2)", "math.exp(x)",
    "s[0:2]", "s[1:]", "s[-2:]", "s[:-1]", "s + '!'", "s.lower()", "s.upper()", "s.startswith('a')", "s.endswith('d')", "'l' in s", "bool(n)", "n is None", "n is not None", "True", "s[1:3] == 'bc'",
]


@pytest.mark.parametrize("text", CASES)
def test_against_python(frame, text):
    got, want = both(frame, text)
    for i in want:
        assert got[i] == (pytest.approx(want[i]) if isinstance(want[i], float) else want[i]), (text, i)


def arithmetic():
    leaf = st.sampled_from(["i", "n", "2", "3", "-5"])
    return st.recursive(leaf, lambda x: st.tuples(x, st.sampled_from(["+", "-", "*"]), x).map(lambda t: f"({t[0]} {t[1]} {t[2]})") | st.tuples(x, st.sampled_from(["//", "%"]), st.sampled_from(["3", "-4", "i"])).map(lambda t: f"({t[0]} {t[1]} {t[2]})"), max_leaves=6)


@settings(max_examples=25, deadline=None, suppress_health_check=list(HealthCheck))
@given(a=arithmetic(), b=arithmetic(), op=st.sampled_from(["<", "<=", "==", "!="]))
def test_random_predicates(frame, a, b, op):
    got, want = both(frame, f"{a} {op} {b} and not ({b} > 100)")
    assert got == want


@pytest.mark.parametrize("text", ["__import__('os')", "i.real", "[n for n in s]", "lambda: 1", "missing + 1", "f'{i}'", "eval('1')", "s.format(1)", "i is 3", "n[0:1:2]", "1 +"])
def test_rejected(frame, text):
    with pytest.raises(ex.ExpressionError):
        ex.compile_scalar(text, frame)


def test_truth_of_numbers_and_strings(frame):
    assert {r.i for r in frame.where(ex.compile_predicate("n", frame)).collect()} == {1, 2, 4}
    assert {r.i for r in frame.where(ex.compile_predicate("s", frame)).collect()} == {1, 3, 4}


def test_planner_views():
    assert ex.conjuncts("a == 1 and (b < 2 or c) and d and (e and f)") == ["a == 1", "b < 2 or c", "d", "e", "f"]
    assert ex.attributes("math.sqrt(a) + len(b) > c.lower()") == {"a", "b", "c"}
    assert ex.is_attribute(" a ") and not ex.is_attribute("a + 1")
    assert ex.conjunction(["a or b", "c"]) == "(a or b) and c" and ex.conjunction([]) == "True"
