"""The relational operators as functions of DataFrames.  Each is a declarative plan; Catalyst picks the physical one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import compile_predicate, compile_scalar, conjuncts, attributes, values_of
from ..functions.folds import lower_fold, python_folds, trace_row
from ..functions.types import Schema, parse_type


def where(df: DataFrame, predicate: str | Column) -> DataFrame:
    return df.where(predicate if isinstance(predicate, Column) else compile_predicate(predicate, df))


def select(df: DataFrame, columns: dict[str, tuple[str, str]]) -> DataFrame:
    """Output name -> (expression, type): computed columns, cast to their declared types."""
    out = []
    for name, (text, kind) in columns.items():
        t = parse_type(kind)
        if t is None:
            raise ValueError(f"column {name}: no type {kind}")
        out.append(t.cast(compile_scalar(text, df)).alias(name))
    return df.select(*out)


def rename(df: DataFrame, names: dict[str, str]) -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"no column {', '.join(missing)}")
    return df.withColumnsRenamed(names)


# ---- joins

#: Method of a join -> Spark's hint for the right side.
HINTS = {"nested-loops": None, "block-nested-loops": "broadcast", "indexed": None, "hash": "shuffle_hash", "merge": "merge", None: None}
#: Estimated bytes up to which ``block-nested-loops`` broadcasts its right side.
BROADCAST_LIMIT = 256 << 20


def estimated_bytes(df: DataFrame) -> int:
    """Catalyst's estimate of a frame's size; very large where it knows nothing."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def join(lhs: DataFrame, rhs: DataFrame, method: str | None = None, expr: str | None = None, left_keys: list[str] | None = None, right_keys: list[str] | None = None, how: str = "inner") -> DataFrame:
    """A join whose columns are the left ones, then the right ones; names must not overlap.

    ``expr`` is any predicate over both sides; ``left_keys`` and ``right_keys`` are equal by position.  ``method`` hints
    at a physical join.  A hint to broadcast is given only where the side's estimated size is bounded.
    """
    if method not in HINTS:
        raise ValueError(f"no join method {method}")
    overlap = [c for c in lhs.columns if c in rhs.columns]
    if overlap:
        raise ValueError(f"overlapping columns {', '.join(overlap)}: rename one side")
    if len(left_keys or []) != len(right_keys or []):
        raise ValueError("as many left keys as right keys are needed")
    if expr is None and not left_keys:
        raise ValueError("a join needs a predicate or keys")
    on = [F.col(f"`{a}`") == F.col(f"`{b}`") for a, b in zip(left_keys or [], right_keys or [])]  # names are unique
    if expr is not None:
        on.append(compile_predicate(expr, values_of(lhs) | values_of(rhs)))
    condition = on[0]
    for c in on[1:]:
        condition = condition & c
    hint = HINTS[method]
    if hint == "shuffle_hash" and not left_keys and not equalities(expr, lhs.columns, rhs.columns):
        hint = None
    if hint == "broadcast" and estimated_bytes(rhs) > BROADCAST_LIMIT:
        hint = None
    if expr is not None and expr.strip() == "True" and not left_keys:
        return lhs.crossJoin(rhs) if how == "inner" else lhs.join(rhs, condition, how)
    return lhs.join(rhs.hint(hint) if hint else rhs, condition, how)


def equalities(expr: str | None, left: list[str], right: list[str]) -> list[tuple[str, str]]:
    """Pairs of sides of the conjuncts ``a == b`` with a from the left and b from the right."""
    import ast

    out = []
    for part in conjuncts(expr) if expr else []:
        node = ast.parse(part, mode="eval").body
        if isinstance(node, ast.Compare) and len(node.ops) == 1 and isinstance(node.ops[0], ast.Eq):
            a, b = ast.unparse(node.left), ast.unparse(node.comparators[0])
            for x, y in ((a, b), (b, a)):
                if attributes(x) and attributes(y) and attributes(x) <= set(left) and attributes(y) <= set(right):
                    out.append((x, y))
                    break
    return out


def _keyed(lhs: DataFrame, rhs: DataFrame, left_keys: list[str], right_keys: list[str], how: str) -> DataFrame:
    own = rhs.select(*(F.col(f"`{b}`").alias(f"__key{i}") for i, b in enumerate(right_keys)))
    return lhs.join(own, [F.col(f"`{a}`") == F.col(f"__key{i}") for i, a in enumerate(left_keys)], how)


def semi_join(lhs: DataFrame, rhs: DataFrame, left_keys: list[str], right_keys: list[str]) -> DataFrame:
    """Rows of the left side with a match (IN, EXISTS)."""
    return _keyed(lhs, rhs, left_keys, right_keys, "left_semi")


def anti_join(lhs: DataFrame, rhs: DataFrame, left_keys: list[str], right_keys: list[str]) -> DataFrame:
    """Rows of the left side without a match (NOT EXISTS)."""
    return _keyed(lhs, rhs, left_keys, right_keys, "left_anti")


# ---- grouping


def group_by(df: DataFrame, group_schema: Schema, agg_schema: Schema, group_expr: Callable | list[str], aggregates: list, order: list[str] | None = None) -> DataFrame:
    """Groups by a key function or a list of expressions, and folds each group.

    ``aggregates``: one for each field of ``agg_schema``: a fold (see ``functions.folds``) or a Spark aggregate column.
    ``order``: columns that order a group's rows, for folds that depend on it.
    """
    if len(aggregates) != len(agg_schema.fields) or not aggregates:
        raise ValueError("one aggregate is needed for each field of the aggregates' schema")
    columns = values_of(df)
    keys = trace_row(group_expr, columns) if callable(group_expr) else [compile_scalar(k, df) for k in group_expr]
    if len(keys) != len(group_schema.fields):
        raise ValueError("the group expression gives another number of keys than the group schema has")
    named = [t.cast(k).alias(n) for k, (n, t) in zip(keys, group_schema.types.items())]
    clash = [n for n in group_schema.fields if n in agg_schema.fields]
    if clash:
        raise ValueError(f"overlapping columns {', '.join(clash)}")
    ordered = [F.col(f"`{c}`") for c in order] if order else None
    native, python = [], []
    for (name, t), a in zip(agg_schema.types.items(), aggregates):
        if isinstance(a, Column):
            native.append(t.cast(a).alias(name))
            continue
        lowered = lower_fold(a, columns, t.spark, ordered)
        if lowered.column is not None:
            native.append(t.cast(lowered.column).alias(name))
        else:
            python.append((name, a, t.spark))
    names = [*group_schema.fields, *agg_schema.fields]
    parts = [df.groupBy(*named).agg(*native)] if native else []
    if python:
        hidden = {n: f"__key_{n}" for n in group_schema.fields}
        keyed = df.select(*(k.alias(hidden[n]) for k, n in zip(named, group_schema.fields)), *(F.col(f"`{c}`") for c in df.columns))
        parts.append(python_folds(keyed, list(hidden.values()), python, order).withColumnsRenamed({h: n for n, h in hidden.items()}))
    if len(parts) == 1:
        return parts[0].select(*names)
    left, right = parts[0], parts[1].withColumnsRenamed({n: f"__right_{n}" for n in group_schema.fields})
    match = F.lit(True)
    for n in group_schema.fields:
        match = match & left[n].eqNullSafe(right[f"__right_{n}"])
    return left.join(right, match).select(*names)


def eager_sum(df: DataFrame, keys: list[str], value: Column, name: str) -> DataFrame:
    """A sum by keys, to be made below a join and summed again above it (group-by placement)."""
    return df.groupBy(*keys).agg(F.sum(value).alias(name))


# ---- order, limits, sets


def order(df: DataFrame, key: str | Callable | list[str], ascending: bool = False, ties: list[str] | None = None) -> DataFrame:
    """Sorts by an expression, a list of them or a function of the row; descending by default, ties by ascending columns."""
    columns = trace_row(key, values_of(df)) if callable(key) else [compile_scalar(k, df) for k in ([key] if isinstance(key, str) else key)]
    return df.orderBy(*(c.asc() if ascending else c.desc() for c in columns), *(F.col(t).asc() for t in ties or []))


def union_all(lhs: DataFrame, rhs: DataFrame) -> DataFrame:
    """Rows of both; names, types and their order must be equal."""
    if [(f.name, f.dataType) for f in lhs.schema] != [(f.name, f.dataType) for f in rhs.schema]:
        raise ValueError("a union needs equal schemas")
    return lhs.union(rhs)


def union_distinct(lhs: DataFrame, rhs: DataFrame) -> DataFrame:
    return union_all(lhs, rhs).distinct()


def sample(df: DataFrame, factor: float, seed: int = 12345) -> DataFrame:
    """About one row of ``factor``."""
    return df.sample(fraction=1.0 / factor, seed=seed)
