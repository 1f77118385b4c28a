"""Predicates and scalar expressions in Python's syntax, compiled to Spark columns.

Nothing is evaluated: a string is parsed and every node must be on the allow-list.  Values follow Python where Spark
differs: ``/`` is true division, ``//`` and ``%`` take the divisor's sign, comparisons chain, ``round`` goes to even,
numbers and strings have a truth value, ``and`` and ``or`` give an operand.  Nulls follow Spark.
"""

from __future__ import annotations

import ast
import datetime
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class ExpressionError(ValueError):
    """An expression that isn't supported."""


@dataclass(frozen=True)
class Value:
    """A column with what is known of its type: bool, int, float, str, none or any."""

    column: Column
    kind: str = "any"
    literal: object = None


def kind_of(t: T.DataType) -> str:
    if isinstance(t, T.BooleanType):
        return "bool"
    if isinstance(t, T.IntegralType):
        return "int"
    if isinstance(t, (T.FractionalType, T.DecimalType)):
        return "float"
    return "str" if isinstance(t, T.StringType) else "any"


def literal(value: object) -> Value:
    kinds = {bool: "bool", int: "int", float: "float", str: "str", type(None): "none"}
    if type(value) not in kinds and not isinstance(value, (datetime.date, datetime.datetime)):
        raise ExpressionError(f"a literal of type {type(value).__name__}")
    return Value(F.lit(value), kinds.get(type(value), "any"), value)


def truth(v: Value) -> Column:
    if v.kind in ("bool", "any"):
        return v.column
    if v.kind == "str":
        return F.length(v.column) > 0
    return F.lit(False) if v.kind == "none" else v.column != 0


def _number(v: Value) -> Value:
    """Booleans count as numbers in arithmetic."""
    return Value(v.column.cast("int"), "int") if v.kind == "bool" else v


def modulo(a: Value, b: Value) -> Value:
    a, b = _number(a), _number(b)
    rest = a.column % b.column
    return Value(F.when((rest != 0) & ((rest < 0) != (b.column < 0)), rest + b.column).otherwise(rest), "int" if a.kind == b.kind == "int" else "float")


def floor_divide(a: Value, b: Value) -> Value:
    a, b = _number(a), _number(b)
    if a.kind == b.kind == "int":  # exact, where a quotient of doubles isn't
        return Value(F.call_function("div", (a.column - modulo(a, b).column).cast("bigint"), b.column.cast("bigint")), "int")
    return Value(F.floor(a.column / b.column).cast("double"), "float")


def binary(op: type, a: Value, b: Value) -> Value:
    a, b = _number(a), _number(b)
    num = "int" if a.kind == b.kind == "int" else "float" if {a.kind, b.kind} <= {"int", "float"} else "any"
    if op is ast.Add:
        return Value(F.concat(a.column, b.column), "str") if a.kind == "str" or b.kind == "str" else Value(a.column + b.column, num)
    if op is ast.Sub:
        return Value(a.column - b.column, num)
    if op is ast.Mult:
        if a.kind == "str" or b.kind == "str":
            text, n = (a, b) if a.kind == "str" else (b, a)
            return Value(F.call_function("repeat", text.column, n.column.cast("int")), "str")
        return Value(a.column * b.column, num)
    if op is ast.Div:
        return Value(a.column.cast("double") / b.column.cast("double"), "float")
    if op is ast.FloorDiv:
        return floor_divide(a, b)
    if op is ast.Mod:
        return modulo(a, b)
    if op is ast.Pow:
        power = F.pow(a.column, b.column)
        return Value(power.cast("bigint"), "int") if num == "int" and isinstance(b.literal, int) and b.literal >= 0 else Value(power, "float")
    names = {ast.LShift: "shiftleft", ast.RShift: "shiftright"}
    if op in names:
        return Value(F.call_function(names[op], a.column.cast("bigint"), b.column.cast("int")), "int")
    bits = {ast.BitAnd: Column.bitwiseAND, ast.BitOr: Column.bitwiseOR, ast.BitXor: Column.bitwiseXOR}
    if op in bits:
        return Value(bits[op](a.column, b.column), "int")
    raise ExpressionError(f"operator {op.__name__}")


def compare(op: type, a: Value, b: Value) -> Column:
    if op in (ast.Is, ast.IsNot):
        if b.kind != "none":
            raise ExpressionError("'is' is for None alone")
        return a.column.isNull() if op is ast.Is else a.column.isNotNull()
    plain: dict[type, Callable[[Column, Column], Column]] = {
        ast.Eq: lambda x, y: x == y, ast.NotEq: lambda x, y: x != y, ast.Lt: lambda x, y: x < y,
        ast.LtE: lambda x, y: x <= y, ast.Gt: lambda x, y: x > y, ast.GtE: lambda x, y: x >= y,
    }
    return plain[op](a.column, b.column)


#: Functions of one value that keep their name's meaning: name -> (function, kind of the result).
_ONE = {
    "len": (F.length, "int"), "str": (lambda c: c.cast("string"), "str"), "float": (lambda c: c.cast("double"), "float"),
    "hash": (F.hash, "int"), "year": (F.year, "int"), "month": (F.month, "int"), "day": (F.dayofmonth, "int"),
    "yyyymmdd": (lambda c: F.date_format(c, "yyyyMMdd").cast("int"), "int"),
    "sqrt": (F.sqrt, "float"), "exp": (F.exp, "float"), "floor": (lambda c: F.floor(c).cast("bigint"), "int"), "ceil": (lambda c: F.ceil(c).cast("bigint"), "int"),
}
_MATH = ("sqrt", "exp", "floor", "ceil", "log", "pow", "fabs", "log2", "log10")
#: Methods of strings: name -> (function of the column and the arguments' columns, kind).
_METHODS = {
    "lower": (F.lower, "str"), "upper": (F.upper, "str"), "strip": (F.trim, "str"), "startswith": (Column.startswith, "bool"),
    "endswith": (Column.endswith, "bool"), "replace": (F.replace, "str"),
}


def call(name: str, args: list[Value]) -> Value:
    """A function of the allow-list."""
    columns = [a.column for a in args]
    if name in ("min", "max") and len(args) > 1:
        return Value((F.least if name == "min" else F.greatest)(*columns), "float" if any(a.kind == "float" for a in args) else args[0].kind)
    if name in ("date", "timestamp") and len(args) == 1:
        if isinstance(args[0].literal, str):
            return literal(datetime.date.fromisoformat(args[0].literal) if name == "date" else datetime.datetime.fromisoformat(args[0].literal))
        return Value(columns[0].cast("date" if name == "date" else "timestamp_ntz"), "any")
    if name == "datediff" and len(args) == 2:
        return Value(F.datediff(*columns), "int")
    if name == "substr" and len(args) == 3:
        return Value(columns[0].substr(columns[1], columns[2]), "str")
    if name in ("pow", "log") and len(args) == 2:
        return Value(F.pow(*columns) if name == "pow" else F.log(columns[0]) / F.log(columns[1]), "float")
    if name == "round" and len(args) == 1:
        return Value(F.rint(columns[0]).cast("bigint"), "int")
    if name == "round" and len(args) == 2 and isinstance(args[1].literal, int):
        return Value(F.bround(columns[0], args[1].literal), args[0].kind)
    if len(args) == 1:
        if name in ("abs", "fabs"):
            return Value(F.abs(_number(args[0]).column), "float" if name == "fabs" else _number(args[0]).kind)
        if name == "int":
            return Value((_number(args[0]).column if args[0].kind != "str" else F.trim(columns[0])).cast("bigint"), "int")
        if name == "bool":
            return Value(truth(args[0]), "bool")
        if name == "hash" and args[0].kind == "int":  # an integer is its own hash, but for -1
            return Value(F.when(columns[0] == -1, F.lit(-2).cast("bigint")).otherwise(columns[0].cast("bigint")), "int")
        if name in ("log", "log2", "log10"):
            return Value({"log": F.log, "log2": F.log2, "log10": F.log10}[name](columns[0]), "float")
        if name in _ONE:
            return Value(_ONE[name][0](columns[0]), _ONE[name][1])
    raise ExpressionError(f"function {name} of {len(args)}")


def slice_of(text: Value, start: int | None, stop: int | None) -> Value:
    """``text[start:stop]`` by Python's rules for negative and large places."""
    size = F.length(text.column)
    place = lambda i: F.lit(i) if i >= 0 else F.greatest(F.lit(0), size + i)
    a, b = place(start or 0), size if stop is None else place(stop)
    return Value(text.column.substr(a + 1, F.greatest(F.lit(0), b - a)), "str")


class _Compiler:
    def __init__(self, columns: dict[str, Value]):
        self.columns = columns

    def __call__(self, node: ast.AST) -> Value:
        method = getattr(self, f"on_{type(node).__name__}", None)
        if method is None:
            raise ExpressionError(f"{type(node).__name__} isn't supported: {ast.unparse(node)}")
        return method(node)

    def on_Expression(self, node):
        return self(node.body)

    def on_Constant(self, node):
        return literal(node.value)

    def on_Name(self, node):
        if node.id not in self.columns:
            raise ExpressionError(f"no column {node.id}")
        return self.columns[node.id]

    def on_BinOp(self, node):
        return binary(type(node.op), self(node.left), self(node.right))

    def on_UnaryOp(self, node):
        v = self(node.operand)
        if isinstance(node.op, ast.Not):
            return Value(~truth(v), "bool")
        v = _number(v)
        if isinstance(node.op, ast.USub):
            return literal(-v.literal) if isinstance(v.literal, (int, float)) else Value(-v.column, v.kind)
        return v if isinstance(node.op, ast.UAdd) else Value(F.bitwise_not(v.column), "int")

    def on_BoolOp(self, node):
        values = [self(v) for v in node.values]
        both = isinstance(node.op, ast.And)
        out = values[-1]
        for v in reversed(values[:-1]):
            if v.kind in ("bool", "any") and out.kind in ("bool", "any"):
                out = Value(v.column & out.column if both else v.column | out.column, "bool")
            else:
                a, b = (out.column, v.column) if both else (v.column, out.column)
                out = Value(F.when(truth(v), a).otherwise(b), out.kind if out.kind == v.kind else "any") if out.kind == v.kind else Value(truth(v) & truth(out) if both else truth(v) | truth(out), "bool")
        return out

    def on_Compare(self, node):
        left, out = self(node.left), None
        for op, right in zip(node.ops, node.comparators):
            if isinstance(op, (ast.In, ast.NotIn)):
                if not isinstance(right, (ast.Tuple, ast.List, ast.Set)):
                    text = self(right)  # a substring
                    test, value = F.contains(text.column, left.column), text
                else:
                    items = [self(x) for x in right.elts]
                    test = left.column.isin(*[x.column for x in items]) if items else F.lit(False)
                    value = None
                test = ~test if isinstance(op, ast.NotIn) else test
            else:
                value = self(right)
                test = compare(type(op), left, value)
            out, left = test if out is None else out & test, value
        return Value(out, "bool")

    def on_IfExp(self, node):
        a, b = self(node.body), self(node.orelse)
        return Value(F.when(truth(self(node.test)), a.column).otherwise(b.column), a.kind if a.kind == b.kind else "float" if {a.kind, b.kind} == {"int", "float"} else "any")

    def on_Call(self, node):
        if node.keywords:
            raise ExpressionError("keyword arguments")
        args = [self(a) for a in node.args]
        if isinstance(node.func, ast.Name):
            return call(node.func.id, args)
        if isinstance(node.func, ast.Attribute):
            if isinstance(node.func.value, ast.Name) and node.func.value.id == "math" and node.func.attr in _MATH:
                return call(node.func.attr, args)
            if node.func.attr in _METHODS:
                f, kind = _METHODS[node.func.attr]
                return Value(f(self(node.func.value).column, *[a.column for a in args]), kind)
        raise ExpressionError(f"call of {ast.unparse(node.func)}")

    def on_Subscript(self, node):
        text = self(node.value)
        if isinstance(node.slice, ast.Slice):
            if node.slice.step is not None:
                raise ExpressionError("a slice with a step")
            ends = [None if e is None else self(e).literal for e in (node.slice.lower, node.slice.upper)]
            if any(e is not None and not isinstance(e, int) for e in ends):
                raise ExpressionError("a slice whose ends aren't integers")
            return slice_of(text, *ends)
        i = self(node.slice).literal
        if not isinstance(i, int):
            raise ExpressionError("an index that isn't an integer")
        return slice_of(text, i, None if i == -1 else i + 1)


def values_of(df: DataFrame) -> dict[str, Value]:
    return {f.name: Value(F.col(f"`{f.name}`"), kind_of(f.dataType)) for f in df.schema}


def compile_value(text: str, columns: DataFrame | dict[str, Value]) -> Value:
    try:
        tree = ast.parse(text.strip(), mode="eval")
    except SyntaxError as e:
        raise ExpressionError(f"{text!r}: {e}") from e
    return _Compiler(values_of(columns) if isinstance(columns, DataFrame) else columns)(tree)


def compile_scalar(text: str, columns: DataFrame | dict[str, Value]) -> Column:
    """A scalar expression as a column."""
    return compile_value(text, columns).column


def compile_predicate(text: str, columns: DataFrame | dict[str, Value]) -> Column:
    """A predicate as a boolean column; numbers and strings stand for their truth."""
    return truth(compile_value(text, columns))


# ---- what a planner asks of an expression


def attributes(text: str) -> set[str]:
    """Names of the columns that an expression reads."""
    tree = ast.parse(text.strip(), mode="eval")
    called = {id(n.func) for n in ast.walk(tree) if isinstance(n, ast.Call)}
    modules = {id(n.value) for n in ast.walk(tree) if isinstance(n, ast.Attribute)}
    return {n.id for n in ast.walk(tree) if isinstance(n, ast.Name) and id(n) not in called and not (id(n) in modules and n.id == "math")}


def is_attribute(text: str) -> bool:
    """Whether an expression is a column alone."""
    return isinstance(ast.parse(text.strip(), mode="eval").body, ast.Name)


def conjuncts(text: str) -> list[str]:
    """The parts of a conjunction, each as source text."""

    def parts(node: ast.AST) -> list[ast.AST]:
        if isinstance(node, ast.BoolOp) and isinstance(node.op, ast.And):
            return [x for v in node.values for x in parts(v)]
        return [node]

    return [ast.unparse(p) for p in parts(ast.parse(text.strip(), mode="eval").body)]


def conjunction(parts: list[str]) -> str:
    """One expression that holds where all parts do."""
    trees = [ast.parse(p, mode="eval").body for p in parts]
    return ast.unparse(trees[0] if len(trees) == 1 else ast.BoolOp(ast.And(), trees)) if trees else "True"


def unparse(tree: ast.AST) -> str:
    """Source text of a syntax tree."""
    return ast.unparse(tree)
