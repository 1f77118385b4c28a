"""Golden facts of the employee table: id 0..19, age 2 id + 20, department id % 2."""

import sys

import pytest
from pyspark.sql import functions as F

from quern.functions.types import Schema
from quern.plans.builder import Query
from quern.sources.database import Database


@pytest.fixture(scope="module")
def db(spark, tmp_path_factory):
    base = Database(spark, f"file://{tmp_path_factory.mktemp('db')}")
    base.create_relation("employee", [("id", "int"), ("age", "int"), ("dept_id", "int")])
    for i in range(20):
        base.insert("employee", i, 2 * i + 20, i % 2)
    return base


E2 = {"id": "id2", "age": "age2", "dept_id": "dept_id2"}


def table(db):
    return db.query().fromTable("employee")


def renamed(db):
    return db.schema("employee").rename("employee2", E2)


def test_scan_where_select(db):
    assert table(db).frame().count() == 20
    assert sorted(r.age for r in table(db).where("age < 30").finalize()) == [20, 22, 24, 26, 28]
    q = table(db).where("age < 30").select({"id": ("id", "int")}).finalize()
    assert sorted(r.id for r in q) == [0, 1, 2, 3, 4]
    assert q.relations() == ["employee"] and q.flatten() == [(0, "Project"), (1, "Select"), (2, "TableScan")]
    lines = q.explain().split("\n")
    assert lines[0].startswith("Project[") and lines[1].startswith("  Select[") and "predicate='age < 30'" in lines[1] and lines[2].endswith("(employee)")
    assert "Physical Plan" in q.explain("formatted")


def test_stacked_filters_all_hold(db):
    q = table(db)
    for text in ("age > 21", "age > 23", "age > 25", "id < 8", "dept_id == 1"):
        q = q.where(text)
    assert sorted(r.id for r in q.frame().collect()) == [3, 5, 7]


def test_union(db):
    assert table(db).union(table(db)).frame().count() == 40
    assert table(db).union_distinct(table(db)).frame().count() == 20
    with pytest.raises(ValueError):
        table(db).union(table(db).select({"id": ("id", "int")})).frame()


@pytest.mark.parametrize("how", [
    {"method": "nested-loops", "expr": "id == id2"}, {"method": "block-nested-loops", "expr": "id == id2"}, {"method": "merge", "expr": "id == id2"}, {"expr": "id == id2"},
    {"method": "hash", "lhsHashFn": "hash(id) % 4", "rhsHashFn": "hash(id2) % 4", "lhsKeySchema": Schema("k", [("id", "int")]), "rhsKeySchema": Schema("k2", [("id2", "int")])},
])
def test_equi_joins(db, how):
    got = table(db).join(table(db), rhsSchema=renamed(db), **how).frame()
    assert got.columns == ["id", "age", "dept_id", "id2", "age2", "dept_id2"]
    assert sorted((r.id, r.id2) for r in got.collect()) == [(i, i) for i in range(20)]


def test_theta_and_cross_joins(db):
    join = lambda expr: table(db).join(table(db), rhsSchema=renamed(db), method="block-nested-loops", expr=expr).frame()
    assert join("id <= id2").count() == 210 and join("True").count() == 400


def test_index_join(db):
    index = db.match_index("employee", ["age"]) or db.create_index("employee", ["age"])
    q = table(db).join(table(db), rhsSchema=renamed(db), method="indexed", indexId=index, lhsKeySchema=Schema("k", [("age", "int")]))
    assert sorted((r.id, r.id2) for r in q.frame().collect()) == [(i, i) for i in range(20)]
    many = table(db).join(table(db), rhsSchema=renamed(db), method="indexed", indexId=db.create_index("employee", ["dept_id"]), left_keys=["dept_id"], expr="id < id2")
    assert many.frame().count() == 90  # all matches of a key that isn't unique


def test_join_errors(db):
    for how in ({"method": "hash"}, {"method": "block-nested-loops"}, {"method": "indexed"}):
        with pytest.raises(ValueError):
            table(db).join(table(db), rhsSchema=renamed(db), **how)
    with pytest.raises(ValueError, match="overlapping"):
        table(db).join(table(db), expr="id == id").frame()
    with pytest.raises(ValueError):
        Query()
    with pytest.raises(ValueError):
        db.query().where("x")
    with pytest.raises(ValueError):
        db.query().from_table("nope")


def minmax(db, key, expr):
    folds = [(sys.maxsize, lambda acc, e: min(acc, e.age), lambda x: x), (0, lambda acc, e: max(acc, e.age), lambda x: x)]
    q = table(db).groupBy(groupSchema=key, aggSchema=Schema("a", [("low", "int"), ("high", "int")]), groupExpr=expr, aggExprs=folds, groupHashFn=lambda v: hash(v[0]) % 2)
    return sorted(tuple(r) for r in q.frame().collect())


def test_group_by(db):
    assert minmax(db, Schema("k", [("k", "int")]), lambda e: e.id % 2) == [(0, 20, 56), (1, 22, 58)]
    assert minmax(db, Schema("k", [("id", "int")]), lambda e: e.id) == [(i, 2 * i + 20, 2 * i + 20) for i in range(20)]
    assert minmax(db, Schema("k", [("d", "int"), ("half", "int")]), lambda e: (e.dept_id, e.id // 10)) == [(0, 0, 20, 36), (0, 1, 40, 56), (1, 0, 22, 38), (1, 1, 42, 58)]
    with pytest.raises(ValueError):
        table(db).groupBy(groupSchema=Schema("k", [("k", "int")]), aggSchema=Schema("a", [("a", "int")]), groupExpr=lambda e: e.id, aggExprs=[])
    with pytest.raises(ValueError):
        table(db).groupBy(groupSchema=Schema("k", [("k", "int")]), aggSchema=Schema("a", [("a", "int"), ("b", "int")]), groupExpr=lambda e: e.id, aggExprs=[(0, lambda a, e: a, lambda a: a)])


def grouped(db, fold, kind="double", **more):
    q = table(db).group_by(Schema("k", [("k", "int")]), Schema("a", [("a", kind)]), lambda e: e.dept_id, [fold], **more)
    return {r.k: r.a for r in q.frame().collect()}, q


def test_folds(db):
    ages = {k: [2 * i + 20 for i in range(k, 20, 2)] for k in (0, 1)}
    assert grouped(db, (0.0, lambda a, e: a + e.age * 0.5, lambda a: a))[0] == {k: sum(v) / 2 for k, v in ages.items()}
    assert grouped(db, ((0.0, 0), lambda a, e: (a[0] + e.age, a[1] + 1), lambda a: a[0] / a[1]))[0] == {k: sum(v) / len(v) for k, v in ages.items()}
    assert grouped(db, (100, lambda a, e: a - e.id, lambda a: -a), "long")[0] == {0: -10, 1: 0}
    ordered = (1.0, lambda a, e: a * 0.5 + e.age, lambda a: a)

    def plain(values):
        a = 1.0
        for v in values:
            a = a * 0.5 + v
        return a

    assert grouped(db, ordered, order=["id"])[0] == pytest.approx({k: plain(v) for k, v in ages.items()})
    with pytest.raises(ValueError, match="order"):
        grouped(db, ordered)[0]
    branch = lambda a, e: a + (e.age if e.age > 30 else 0)
    want = {k: float(sum(x for x in v if x > 30)) for k, v in ages.items()}
    assert grouped(db, (0, branch, lambda a: float(a), lambda a, b: a + b))[0] == want
    assert grouped(db, (0, branch, lambda a: float(a)), order=["id"])[0] == want
    with pytest.raises(ValueError, match="order"):
        grouped(db, (0, branch, lambda a: float(a)))[0]


def test_native_folds_have_no_python(db):
    _, q = grouped(db, ((0.0, 0), lambda a, e: (a[0] + e.age, a[1] + 1), lambda a: a[0] / a[1]))
    plan = q.finalize().explain("simple")
    assert "Python" not in plan and "HashAggregate" in plan


def test_order_and_limit(db):
    assert [r.id for r in table(db).order(sortKeyFn=lambda e: e.age, sortKeyDesc="age").frame().collect()] == list(range(19, -1, -1))
    assert [r.id for r in table(db).order("age", ascending=True).limit(3, offset=2).frame().collect()] == [2, 3, 4]


def test_sampling_and_statistics(spark, db):
    big = Query(db).from_frame(spark.range(20_000).withColumn("age", F.col("id") % 100))
    plan = big.where("age < 30").finalize()
    assert 4000 < plan.sample(10) < 8000
    assert 1500 < big.sampled(10).frame().count() < 2500
    assert plan.cardinality(estimated=False) == 6000 and plan.selectivity(estimated=False) == 0.3
    assert plan.cost(estimated=False) == 20_000 + 20_000 and plan.cost() > 0 and plan.cardinality() > 0


def test_pushdown_reaches_the_scan(db):
    plan = table(db).join(table(db), rhsSchema=renamed(db), expr="id == id2").where("age2 < 30").select({"id": ("id", "int")}).finalize().explain("formatted")
    assert "PushedFilters" in plan and "LessThan(age,30)" in plan
