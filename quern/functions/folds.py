"""User-defined aggregates as folds ``(init, step, final)`` or ``(init, step, final, merge)``.

``step(acc, row)`` and ``final(acc)`` are plain Python functions.  They are traced with symbols:

1. a fold whose step adds to, multiplies, or takes the minimum or maximum of its accumulator becomes a built-in
   aggregate (accumulators may be tuples of such parts), combined on the map side;
2. a step that can be traced otherwise depends on the order of rows: with a declared order it becomes Spark's
   ``aggregate`` over the group's ordered rows; without one it is rejected;
3. a step that can't be traced (control flow on values) runs in Python: with ``merge``, row by row within tasks and then
   over the tasks' accumulators, so that no group is ever held; without it, over ordered groups.
"""

from __future__ import annotations

import ast
import builtins
import types
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .expressions import Value, binary, call, compare, literal, slice_of

Fold = tuple


class Untraceable(Exception):
    """The function looks at values that are only known on the executors."""


#: Keys whose accumulators a task holds before it passes them on.
HELD_KEYS = 100_000


@dataclass(frozen=True, eq=False)
class Sym:
    """A symbolic value: a column of the row, the accumulator (or a part of it), or an operation."""

    op: str
    args: tuple = ()

    def __bool__(self):
        raise Untraceable("a truth value")

    def __iter__(self):
        raise Untraceable("an iteration")

    def __hash__(self):
        return id(self)

    def __getattr__(self, name: str):
        if name.startswith("_"):
            raise AttributeError(name)
        if self.op == "row":
            return Sym("column", (name,))
        raise Untraceable(f"attribute {name}")

    def __getitem__(self, key):
        if self.op == "row" and isinstance(key, str):
            return Sym("column", (key,))
        if isinstance(key, slice) and key.step is None:
            return Sym("slice", (self, key.start, key.stop))
        raise Untraceable("an index")


_OPS = {
    "add": ast.Add, "sub": ast.Sub, "mul": ast.Mult, "truediv": ast.Div, "floordiv": ast.FloorDiv, "mod": ast.Mod, "pow": ast.Pow,
    "lshift": ast.LShift, "rshift": ast.RShift, "and": ast.BitAnd, "or": ast.BitOr, "xor": ast.BitXor,
}
_TESTS = {"eq": ast.Eq, "ne": ast.NotEq, "lt": ast.Lt, "le": ast.LtE, "gt": ast.Gt, "ge": ast.GtE}
for _name in _OPS:
    setattr(Sym, f"__{_name}__", lambda a, b, _n=_name: Sym(_n, (a, b)))
    setattr(Sym, f"__r{_name}__", lambda a, b, _n=_name: Sym(_n, (b, a)))
for _name in _TESTS:
    setattr(Sym, f"__{_name}__", lambda a, b, _n=_name: Sym(_n, (a, b)))
Sym.__neg__ = lambda a: Sym("sub", (0, a))
Sym.__abs__ = lambda a: Sym("call", ("abs", a))
Sym.__round__ = lambda a, n=None: Sym("call", ("round", a) if n is None else ("round", a, n))

ROW = Sym("row")


def _function(name: str, plain: Callable) -> Callable:
    def wrapped(*args, **kwargs):
        if kwargs or not any(isinstance(a, Sym) for a in args):
            return plain(*args, **kwargs)
        return Sym("call", (name, *args))

    return wrapped


def trace(f: Callable, *args):
    """What ``f`` gives for symbols; its min, max, len, int, float, str, hash and math functions are symbolic too."""
    import math

    if not isinstance(f, types.FunctionType):
        raise Untraceable("not a Python function")
    names = {n: _function(n, getattr(builtins, n)) for n in ("min", "max", "len", "int", "float", "str", "hash", "abs", "round")}
    symbolic = types.SimpleNamespace(**{n: _function(n, g) for n, g in vars(math).items() if callable(g)})
    scope = {n: symbolic if g is math else g for n, g in f.__globals__.items()} | names
    patched = types.FunctionType(f.__code__, scope, f.__name__, f.__defaults__, f.__closure__)
    try:
        return patched(*args)
    except Untraceable:
        raise
    except Exception as e:
        raise Untraceable(str(e)) from e


def lower(x, columns: dict[str, Value], acc: dict[int, Value] | None = None) -> Value:
    """A traced value as a column."""
    if not isinstance(x, Sym):
        return literal(x)
    if acc and id(x) in acc:
        return acc[id(x)]
    if x.op == "column":
        if x.args[0] not in columns:
            raise KeyError(f"no column {x.args[0]}")
        return columns[x.args[0]]
    if x.op == "slice":
        return slice_of(lower(x.args[0], columns, acc), x.args[1], x.args[2])
    if x.op == "call":
        return call(x.args[0], [lower(a, columns, acc) for a in x.args[1:]])
    if x.op in _OPS:
        return binary(_OPS[x.op], *(lower(a, columns, acc) for a in x.args))
    if x.op in _TESTS:
        return Value(compare(_TESTS[x.op], *(lower(a, columns, acc) for a in x.args)), "bool")
    raise Untraceable(x.op)


def trace_row(f: Callable, columns: dict[str, Value]) -> list[Column]:
    """A function of a row (a key extractor) as columns; a tuple gives several."""
    out = trace(f, ROW)
    return [lower(x, columns).column for x in (out if isinstance(out, tuple) else (out,))]


def _uses(x, symbol: Sym) -> bool:
    return x is symbol or isinstance(x, Sym) and any(_uses(a, symbol) for a in x.args)


def _builtin(acc: Sym, step, init, columns: dict[str, Value], kind: T.DataType) -> Column | None:
    """The built-in aggregate that a traced step is, started from ``init``; None if it isn't one."""
    if step is acc:
        return F.first(F.lit(init)).cast(kind)
    if not isinstance(step, Sym):
        return None
    args = step.args[1:] if step.op == "call" else step.args
    rest = [a for a in args if a is not acc]
    if len(rest) != len(args) - 1 or len(args) != 2 or _uses(rest[0], acc):
        return None
    value = lower(rest[0], columns).column
    if step.op == "add" or step.op == "sub" and args[0] is acc:
        total = F.coalesce(F.sum(value.cast(kind) if isinstance(kind, T.FractionalType) else value), F.lit(0))
        return (F.lit(init) + total if step.op == "add" else F.lit(init) - total).cast(kind)
    if step.op == "mul":
        return (F.lit(init) * F.product(value)).cast(kind)
    if step.op == "call" and step.args[0] in ("min", "max"):
        least = step.args[0] == "min"
        return (F.least if least else F.greatest)(F.lit(init), (F.min if least else F.max)(value)).cast(kind)
    return None


@dataclass
class Lowered:
    """A fold as an aggregate column (``column``), or in Python (``fold``)."""

    column: Column | None
    fold: Fold | None
    tier: str


def lower_fold(fold: Fold, columns: dict[str, Value], kind: T.DataType, order: list[Column] | None) -> Lowered:
    init, step, final = fold[:3]
    parts = init if isinstance(init, tuple) else (init,)
    symbols = [Sym("acc", (i,)) for i in range(len(parts))]
    acc = tuple(symbols) if isinstance(init, tuple) else symbols[0]
    try:
        stepped = trace(step, acc, ROW)
        ended = trace(final, acc)
        stepped = stepped if isinstance(init, tuple) else (stepped,)
        if not isinstance(stepped, tuple) or len(stepped) != len(parts):
            raise Untraceable("the step gives another shape")
        of = lambda v: kind if len(parts) == 1 else T.DoubleType() if isinstance(v, float) else T.LongType() if isinstance(v, int) else T.StringType()
        folded = [_builtin(s, x, i, columns, of(i)) for s, x, i in zip(symbols, stepped, parts)]
        if all(f is not None for f in folded):
            known = {id(s): Value(f, "float" if isinstance(of(i), T.FractionalType) else "int") for s, f, i in zip(symbols, folded, parts)}
            return Lowered(lower(ended, columns, known).column.cast(kind), None, "built-in")
        if order is None and len(fold) < 4:
            raise ValueError("the fold depends on the order of rows: declare an order, or give a merge function")
        if order is not None:
            used = sorted(columns)
            rows = F.array_sort(F.collect_list(F.struct(*(o.alias(f"o{i}") for i, o in enumerate(order)), F.struct(*(columns[c].column.alias(c) for c in used)).alias("row"))))
            start = F.struct(*(F.lit(v).cast(of(v)).alias(f"a{i}") for i, v in enumerate(parts)))

            def known(a: Column) -> dict[int, Value]:
                return {id(s): Value(a[f"a{i}"], "float" if isinstance(of(v), T.FractionalType) else "int" if isinstance(v, int) else "str") for i, (s, v) in enumerate(zip(symbols, parts))}

            def merge(a: Column, r: Column) -> Column:
                own = {c: Value(r["row"][c], columns[c].kind) for c in used}
                return F.struct(*(lower(x, own, known(a)).column.cast(of(v)).alias(f"a{i}") for i, (x, v) in enumerate(zip(stepped, parts))))

            return Lowered(F.aggregate(rows, start, merge, lambda a: lower(ended, columns, known(a)).column.cast(kind)), None, "ordered")
    except Untraceable:
        pass
    return Lowered(None, fold, "python")


class _RowView:
    """A row's values as attributes and items, for folds in Python."""

    __slots__ = ("_values",)

    def __init__(self, values: dict):
        self._values = values

    def __getattr__(self, name: str):
        try:
            return self._values[name]
        except KeyError:
            raise AttributeError(name) from None

    def __getitem__(self, name: str):
        return self._values[name]


def python_folds(df: DataFrame, keys: list[str], folds: list[tuple[str, Fold, T.DataType]], order: list[str] | None) -> DataFrame:
    """(keys..., one column per fold) of folds that run in Python."""
    import pickle

    data = [c for c in df.columns if c not in keys]
    out = T.StructType([*(df.schema[k] for k in keys), *(T.StructField(n, kind) for n, _, kind in folds)])
    if order is None and any(len(f) < 4 for _, f, _ in folds):
        raise ValueError("a fold in Python without a merge function needs a declared order")

    def run(pdf: pd.DataFrame, finish: bool) -> list:
        if order:
            pdf = pdf.sort_values(order)
        accs = [f[0] for _, f, _ in folds]
        for values in pdf[data].to_dict("records"):
            row = _RowView(values)
            accs = [f[1](a, row) for a, (_, f, _) in zip(accs, folds)]
        return [f[2](a) for a, (_, f, _) in zip(accs, folds)] if finish else accs

    if order is not None or any(len(f) < 4 for _, f, _ in folds):
        return df.groupBy(*keys).applyInPandas(lambda key, pdf: pd.DataFrame([[*key, *run(pdf, True)]], columns=out.names), out)
    part = T.StructType([*(df.schema[k] for k in keys), T.StructField("acc", T.BinaryType())])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Accumulators of the keys that a task meets, row by row, so that no group is ever held."""
        schema, accs = to_arrow_schema(part), {}

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([{**dict(zip(keys, k)), "acc": pickle.dumps(a)} for k, a in accs.items()], schema=schema)

        for batch in batches:
            for values in batch.to_pylist():
                key, row = tuple(values[k] for k in keys), _RowView(values)
                own = accs.get(key) or [f[0] for _, f, _ in folds]
                accs[key] = [f[1](a, row) for a, (_, f, _) in zip(own, folds)]
            if len(accs) > HELD_KEYS:
                yield flush()
                accs.clear()
        if accs:
            yield flush()

    parts = df.mapInArrow(partial, part)

    def join(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        states = [pickle.loads(x) for x in pdf["acc"]]
        merged = states[0]
        for s in states[1:]:
            merged = [f[3](a, b) for a, b, (_, f, _) in zip(merged, s, folds)]
        return pd.DataFrame([[*key, *(f[2](a) for a, (_, f, _) in zip(merged, folds))]], columns=out.names)

    return parts.groupBy(*keys).applyInPandas(join, out)  # a row for each key and task that met it


