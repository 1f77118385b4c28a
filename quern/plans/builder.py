"""A LINQ-style query builder over lazy DataFrames.

A query is an immutable chain of nodes; ``finalize`` gives a plan that lowers to one DataFrame, so Catalyst sees the
whole query.  Nodes are kept beside the DataFrame for explain, for statistics and for the join-order planners.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from ..functions.types import Schema
from ..operators import relational as ops

_ids = itertools.count(1)
_JOIN_NAMES = {"nested-loops": "NLJoin", "block-nested-loops": "BNLJoin", "indexed": "IndexJoin", "hash": "HashJoin", "merge": "MergeJoin", None: "Join"}


@dataclass(frozen=True, eq=False)
class Node:
    """An operator: its name, its parameters for explain, its inputs, and how it makes its frame from theirs."""

    op: str
    inputs: tuple[Node, ...]
    make: Callable[..., DataFrame]
    shown: str = ""
    info: dict = field(default_factory=dict)
    id: int = field(default_factory=lambda: next(_ids))

    def frame(self, leaf: Callable[[DataFrame], DataFrame] | None = None, memo: dict | None = None) -> DataFrame:
        """The node's DataFrame; ``leaf`` is applied to every scan (for sampling)."""
        memo = {} if memo is None else memo
        if self.id not in memo:
            out = self.make(*(n.frame(leaf, memo) for n in self.inputs))
            memo[self.id] = leaf(out) if leaf and not self.inputs else out
        return memo[self.id]

    def walk(self) -> Iterator[tuple[int, Node]]:
        """(depth, node) in pre-order."""
        stack = [(0, self)]
        while stack:
            depth, node = stack.pop()
            yield depth, node
            stack.extend((depth + 1, n) for n in reversed(node.inputs))


class Query:
    """A query under construction.  Every method returns a new one."""

    def __init__(self, database=None, node: Node | None = None):
        if database is None and node is None:
            raise ValueError("a query needs a database or a node")
        self.database, self.node = database, node

    def _next(self, node: Node) -> Query:
        return Query(self.database, node)

    def _own(self, what: str) -> Node:
        if self.node is None:
            raise ValueError(f"{what} needs a table first")
        return self.node

    # ---- sources

    def from_table(self, name: str) -> Query:
        db = self.database
        if not db.has_relation(name):
            raise ValueError(f"no relation {name}")
        return self._next(Node("TableScan", (), lambda: db.table(name), name, {"relation": name}))

    def from_frame(self, df: DataFrame, name: str = "frame") -> Query:
        """Any DataFrame as a relation; stateless operators work on streaming ones too."""
        return self._next(Node("TableScan", (), lambda: df, name, {"relation": name}))

    # ---- operators

    def where(self, predicate: str) -> Query:
        return self._next(Node("Select", (self._own("where"),), lambda df: ops.where(df, predicate), f"predicate='{predicate}'", {"predicate": predicate}))

    def select(self, columns: dict[str, tuple[str, str]]) -> Query:
        return self._next(Node("Project", (self._own("select"),), lambda df: ops.select(df, columns), f"projections={columns}"))

    def join(
        self, rhs: Query, *, method: str | None = None, expr: str | None = None, how: str = "inner",
        left_keys: list[str] | None = None, right_keys: list[str] | None = None, left_schema: Schema | None = None, right_schema: Schema | None = None,
        lhsSchema: Schema | None = None, rhsSchema: Schema | None = None, lhsKeySchema: Schema | None = None, rhsKeySchema: Schema | None = None,
        lhsHashFn: str | None = None, rhsHashFn: str | None = None, indexId: int | None = None,
    ) -> Query:
        """A join with columns of the left, then the right.  ``*_schema`` rename a side by position; hash functions only place rows, so Spark's own is used."""
        left_schema, right_schema = lhsSchema or left_schema, rhsSchema or right_schema
        left_keys = lhsKeySchema.fields if lhsKeySchema else left_keys
        right_keys = rhsKeySchema.fields if rhsKeySchema else right_keys
        if method == "hash" and not (left_keys and right_keys) and expr is None:
            raise ValueError("a hash join needs keys of both sides")
        if method == "indexed":
            if indexId is None or not left_keys:
                raise ValueError("an indexed join needs an index and the left keys")
            relation = rhs._own("join").info.get("relation")
            index = self.database.indexes.get(indexId)
            if index is None or index.relation != relation:
                raise ValueError("the index must be one of the right relation")
            names = dict(zip(self.database.schema(relation).fields, right_schema.fields)) if right_schema else {}
            right_keys = [names.get(k, k) for k in index.key]
        if method in ("nested-loops", "block-nested-loops") and expr is None and not left_keys:
            raise ValueError("a nested-loops join needs a predicate")

        def make(left: DataFrame, right: DataFrame) -> DataFrame:
            left = left.toDF(*left_schema.fields) if left_schema else left
            right = right.toDF(*right_schema.fields) if right_schema else right
            return ops.join(left, right, method, expr, left_keys, right_keys, how)

        shown = [f"expr='{expr}'"] * bool(expr) + [f"keys={list(zip(left_keys or [], right_keys or []))}"] * bool(left_keys)
        info = {"expr": expr, "keys": list(zip(left_keys or [], right_keys or [])), "how": how, "renames": bool(left_schema or right_schema), "method": method, "index": indexId}
        return self._next(Node(_JOIN_NAMES.get(method, "Join"), (self._own("join"), rhs._own("join")), make, ", ".join(shown), info))

    def union(self, other: Query) -> Query:
        return self._next(Node("UnionAll", (self._own("union"), other._own("union")), ops.union_all))

    def union_distinct(self, other: Query) -> Query:
        return self._next(Node("Union", (self._own("union"), other._own("union")), ops.union_distinct))

    def distinct(self) -> Query:
        return self._next(Node("Distinct", (self._own("distinct"),), lambda df: df.distinct()))

    def group_by(self, group_schema: Schema | None = None, agg_schema: Schema | None = None, group_expr=None, aggregates: list | None = None, order: list[str] | None = None,
                 groupSchema: Schema | None = None, aggSchema: Schema | None = None, groupExpr=None, aggExprs: list | None = None, groupHashFn=None) -> Query:
        """Groups by a function or expressions and folds each group.  ``groupHashFn`` only places rows, so Spark's own is used."""
        group_schema, agg_schema = group_schema or groupSchema, agg_schema or aggSchema
        group_expr, aggregates = group_expr or groupExpr, aggregates or aggExprs
        if not (group_schema and agg_schema and group_expr and aggregates):
            raise ValueError("a group-by needs group schema, aggregates' schema, group expression and aggregates")
        if len(aggregates) != len(agg_schema.fields):
            raise ValueError("one aggregate is needed for each field of the aggregates' schema")
        return self._next(Node("GroupBy", (self._own("group_by"),), lambda df: ops.group_by(df, group_schema, agg_schema, group_expr, aggregates, order), f"groupSchema={group_schema}, aggSchema={agg_schema}"))

    def order(self, key=None, ascending: bool = False, ties: list[str] | None = None, sortKeyFn=None, sortKeyDesc: str | None = None) -> Query:
        """Sorts; descending by default.  ``sortKeyDesc`` only describes the key in explain."""
        key = key or sortKeyFn
        return self._next(Node("Sort", (self._own("order"),), lambda df: ops.order(df, key, ascending, ties), f"sortKey={sortKeyDesc or key}"))

    def limit(self, n: int, offset: int = 0) -> Query:
        return self._next(Node("Limit", (self._own("limit"),), lambda df: (df.offset(offset) if offset else df).limit(n), f"{n}" + f" offset {offset}" * bool(offset)))

    def sampled(self, factor: float, seed: int = 12345) -> Query:
        """About one row of ``factor``."""
        return self._next(Node("Sample", (self._own("sampled"),), lambda df: ops.sample(df, factor, seed), f"1/{factor}"))

    def apply(self, f: Callable[[DataFrame], DataFrame], name: str = "Apply") -> Query:
        """Any other function of a DataFrame."""
        return self._next(Node(name, (self._own("apply"),), f))

    fromTable, groupBy = from_table, group_by

    def finalize(self) -> Plan:
        return Plan(self._own("finalize"), self.database)

    def frame(self) -> DataFrame:
        return self._own("frame").frame()


class Plan:
    """A finished query."""

    def __init__(self, root: Node, database=None):
        self.root, self.database = root, database

    def frame(self) -> DataFrame:
        return self.root.frame()

    def __iter__(self) -> Iterator[Row]:
        """Rows one partition at a time."""
        return self.frame().toLocalIterator()

    def schema(self, name: str = "result") -> Schema:
        return Schema.of(name, self.frame())

    def relations(self) -> list[str]:
        """Names of the scanned relations, in order, without repeats."""
        return list(dict.fromkeys(n.info["relation"] for _, n in self.root.walk() if "relation" in n.info))

    def flatten(self) -> list[tuple[int, str]]:
        """(depth, operator) in pre-order."""
        return [(d, n.op) for d, n in self.root.walk()]

    def joins(self) -> list[Node]:
        return [n for _, n in self.root.walk() if "keys" in n.info]

    def sources(self) -> list[Node]:
        return [n for _, n in self.root.walk() if not n.inputs]

    def explain(self, mode: str | None = None) -> str:
        """The operator tree with costs; with a mode, Spark's own plan (``simple``, ``formatted``, ``cost``...) besides."""
        from .stats import cost

        memo: dict = {}
        lines = ["  " * d + f"{n.op}[{n.id},cost={cost(n, memo=memo):.2f}]" + f"({n.shown})" * bool(n.shown) for d, n in self.root.walk()]
        if mode:
            query = self.frame()._jdf.queryExecution()
            lines.append(query.explainString(self.frame().sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString(mode)))
        return "\n".join(lines)

    def sample(self, factor: float, seed: int = 12345) -> float:
        """Estimated number of result rows: every scan sampled to one row of ``factor``, the count scaled by it."""
        return self.root.frame(leaf=lambda df: ops.sample(df, factor, seed)).agg(F.count("*")).first()[0] * factor

    def cardinality(self, estimated: bool = True) -> float:
        from .stats import cardinality

        return cardinality(self.root, estimated)

    def selectivity(self, estimated: bool = True) -> float:
        from .stats import selectivity

        return selectivity(self.root, estimated)

    def cost(self, estimated: bool = True) -> float:
        from .stats import cost

        return cost(self.root, estimated)


def with_inputs(node: Node, inputs: tuple[Node, ...]) -> Node:
    return replace(node, inputs=inputs, id=next(_ids))
