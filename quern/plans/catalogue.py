"""The engine's queries by name, each with SQL for the same rows.

Sums of doubles are rounded, so that the order of additions doesn't show: revenues to four places, where the products of
cents and hundredths that they add up are exact, and no sum lies between two roundings.  Dates run from 1995 to 2001.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.types import Schema
from ..operators import relational as ops
from ..sources import delimited, layout, storage
from ..sources.database import Database, ParquetCatalog
from .builder import Query
from .joinorder import optimize

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Registers a query under its function's name."""

    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


def db(spark: SparkSession, sf_dir: str) -> ParquetCatalog:
    return ParquetCatalog(spark, sf_dir)


def scan(spark: SparkSession, sf_dir: str, name: str) -> Query:
    return db(spark, sf_dir).query().from_table(name)


def columns(*parts: str) -> dict[str, tuple[str, str]]:
    """``name:type`` or ``name:type=expression`` as a select list."""
    out = {}
    for part in parts:
        head, _, text = part.partition("=")
        name, _, kind = head.partition(":")
        out[name] = (text or name, kind)
    return out


# ---- scans, filters, projections


@query("SELECT r_regionkey, r_name FROM region")
def scan_region(spark, sf_dir):
    return scan(spark, sf_dir, "region").frame()


LINE = columns("l_orderkey:long", "l_partkey:long", "l_linenumber:int", "l_quantity:double", "l_returnflag:string")
LINE_SQL = "SELECT l_orderkey, l_partkey, l_linenumber, l_quantity, l_returnflag FROM lineitem WHERE "


@query(LINE_SQL + "l_quantity < 10 AND l_returnflag = 'R'")
def where_cmp(spark, sf_dir):
    return scan(spark, sf_dir, "lineitem").where("l_quantity < 10").where("l_returnflag == 'R'").select(LINE).frame()


@query(LINE_SQL + "(l_quantity < 5 OR l_discount > 0.08) AND NOT l_returnflag = 'N'")
def where_bool_mix(spark, sf_dir):
    return scan(spark, sf_dir, "lineitem").where("(l_quantity < 5 or l_discount > 0.08) and not l_returnflag == 'N'").select(LINE).frame()


@query(LINE_SQL + "l_returnflag IN ('R', 'A') AND l_linenumber NOT IN (1, 2)")
def where_in(spark, sf_dir):
    return scan(spark, sf_dir, "lineitem").where("l_returnflag in ('R', 'A') and l_linenumber not in (1, 2)").select(LINE).frame()


@query(LINE_SQL + "l_quantity >= 10 AND l_quantity < 12")
def where_chained(spark, sf_dir):
    return scan(spark, sf_dir, "lineitem").where("10 <= l_quantity < 12").select(LINE).frame()


@query(LINE_SQL + "l_linenumber % 2 <> 0 AND l_quantity > 45")
def where_truthy(spark, sf_dir):
    return scan(spark, sf_dir, "lineitem").where("l_linenumber % 2").where("l_quantity > 45").select(LINE).frame()


@query("SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) AS net, (l_orderkey // 7)::BIGINT AS seventh, (((l_linenumber - 4) % 3 + 3) % 3)::INTEGER AS turn, l_quantity / 2 AS half FROM lineitem")
def project_arith(spark, sf_dir):
    return scan(spark, sf_dir, "lineitem").select(columns("l_orderkey:long", "l_linenumber:int", "net:double=round(l_extendedprice * (1 - l_discount), 4)", "seventh:long=l_orderkey // 7", "turn:int=(l_linenumber - 4) % 3", "half:double=l_quantity / 2")).frame()


@query("SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'large' WHEN o_totalprice > 100000 THEN 'middle' ELSE 'small' END AS size FROM orders")
def project_cond(spark, sf_dir):
    return scan(spark, sf_dir, "orders").select(columns("o_orderkey:long", "size:char(8)='large' if o_totalprice > 200000 else 'middle' if o_totalprice > 100000 else 'small'")).frame()


@query("SELECT p_partkey, round(sqrt(p_retailprice), 6) AS root, abs(p_size - 25) AS off, greatest(p_size, 10) AS at_least, ceil(p_retailprice)::BIGINT AS up, (p_size::DOUBLE ** 2) AS square FROM part")
def project_math(spark, sf_dir):
    return scan(spark, sf_dir, "part").select(columns("p_partkey:long", "root:double=round(math.sqrt(p_retailprice), 6)", "off:int=abs(p_size - 25)", "at_least:int=max(p_size, 10)", "up:long=math.ceil(p_retailprice)", "square:double=p_size ** 2")).frame()


@query("SELECT p_partkey, rtrim(substr(p_name, 1, 4)) AS head, rtrim(right(p_name, 3)) AS tail, length(p_name)::INTEGER AS size, upper(p_brand) AS brand FROM part WHERE starts_with(p_type, 'P') OR contains(p_name, '1')")
def project_text(spark, sf_dir):
    return scan(spark, sf_dir, "part").where("p_type.startswith('P') or '1' in p_name").select(columns("p_partkey:long", "head:char(4)=p_name[0:4]", "tail:char(3)=p_name[-3:]", "size:int=len(p_name)", "brand:string=p_brand.upper()")).frame()


@query("SELECT o_orderkey, (year(o_orderdate) * 10000 + month(o_orderdate) * 100 + day(o_orderdate))::INTEGER AS day, year(o_orderdate)::INTEGER AS year, xor(o_custkey & 7, 5)::BIGINT AS bits FROM orders WHERE o_orderdate >= TIMESTAMP '1997-03-01' AND o_orderdate < TIMESTAMP '1997-06-01'")
def project_dates_bits(spark, sf_dir):
    return scan(spark, sf_dir, "orders").where("timestamp('1997-03-01') <= o_orderdate < timestamp('1997-06-01')").select(columns("o_orderkey:long", "day:int=yyyymmdd(o_orderdate)", "year:int=year(o_orderdate)", "bits:long=(o_custkey & 7) ^ 5")).frame()


@query("SELECT o_orderkey, (o_custkey % 5)::BIGINT AS part, CASE WHEN DATE '1997-03-01' <= o_orderdate::DATE THEN 1 ELSE 0 END AS late, CASE WHEN o_orderdate::DATE = DATE '1996-01-02' THEN 1 ELSE 0 END AS that_day FROM orders")
def project_hash_date(spark, sf_dir):
    return scan(spark, sf_dir, "orders").select(columns("o_orderkey:long", "part:long=hash(o_custkey) % 5", "late:int=1 if date('1997-03-01') <= date(o_orderdate) else 0", "that_day:int=1 if date(str(date(o_orderdate))) == date('1996-01-02') else 0")).frame()


@query("SELECT c_custkey, c_name FROM customer LEFT JOIN orders ON c_custkey = o_custkey WHERE o_orderkey IS NULL UNION ALL SELECT c_custkey, c_name FROM customer JOIN orders ON c_custkey = o_custkey WHERE o_totalprice > 400000 AND o_orderkey IS NOT NULL")
def where_is_none(spark, sf_dir):
    base = db(spark, sf_dir)
    q = base.query().from_table("customer").join(base.query().from_table("orders"), expr="c_custkey == o_custkey", how="left")
    return q.where("o_orderkey is None or o_totalprice > 400000 and o_orderkey is not None").select(columns("c_custkey:long", "c_name:string")).frame()


# ---- joins

ORDER_CUSTOMER_SQL = "SELECT o_orderkey, o_totalprice, c_custkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 100000"
ORDER_CUSTOMER = columns("o_orderkey:long", "o_totalprice:double", "c_custkey:long", "c_name:string")


def _orders_customers(spark, sf_dir, **how) -> DataFrame:
    customers = scan(spark, sf_dir, "customer")
    return scan(spark, sf_dir, "orders").where("o_totalprice > 100000").join(customers, **how).select(ORDER_CUSTOMER).frame()


@query("SELECT n_nationkey, n_name, n_regionkey, r_regionkey, r_name FROM nation JOIN region ON n_regionkey <= r_regionkey")
def nl_join_theta(spark, sf_dir):
    return scan(spark, sf_dir, "nation").join(scan(spark, sf_dir, "region"), method="nested-loops", expr="n_regionkey <= r_regionkey").frame()


@query(ORDER_CUSTOMER_SQL)
def bnl_join_equi(spark, sf_dir):
    return _orders_customers(spark, sf_dir, method="block-nested-loops", expr="o_custkey == c_custkey")


@query(ORDER_CUSTOMER_SQL)
def hash_join_equi(spark, sf_dir):
    key = lambda c: Schema(c, [(c, "long")])
    return _orders_customers(spark, sf_dir, method="hash", lhsHashFn="hash(o_custkey) % 4", rhsHashFn="hash(c_custkey) % 4", lhsKeySchema=key("o_custkey"), rhsKeySchema=key("c_custkey"))


@query(ORDER_CUSTOMER_SQL)
def merge_join_equi(spark, sf_dir):
    return _orders_customers(spark, sf_dir, method="merge", left_keys=["o_custkey"], right_keys=["c_custkey"])


@query(ORDER_CUSTOMER_SQL + " AND c_acctbal < o_totalprice / 50")
def index_join_equi(spark, sf_dir):
    """An indexed join with a residual predicate."""
    base = db(spark, sf_dir)
    index = base.create_index("customer", ["c_custkey"], unique=True)
    joined = base.query().from_table("orders").where("o_totalprice > 100000").join(base.query().from_table("customer"), method="indexed", indexId=index, left_keys=["o_custkey"], expr="c_acctbal < o_totalprice / 50")
    return joined.select(ORDER_CUSTOMER).frame()


@query("SELECT a.n_nationkey, a.n_name, a.n_regionkey, b.n_nationkey AS key2, b.n_name AS name2, b.n_regionkey AS region2 FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
def self_join_rename(spark, sf_dir):
    base = db(spark, sf_dir)
    other = base.schema("nation").rename("nation2", {"n_nationkey": "key2", "n_name": "name2", "n_regionkey": "region2"})
    nation = lambda: base.query().from_table("nation")
    return nation().join(nation(), rhsSchema=other, method="hash", expr="n_regionkey == region2 and n_nationkey < key2").frame()


@query("SELECT n_nationkey, n_name, n_regionkey, r_regionkey, r_name FROM nation, region")
def cross_join(spark, sf_dir):
    return scan(spark, sf_dir, "nation").join(scan(spark, sf_dir, "region"), method="nested-loops", expr="True").frame()


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")
def semi_join(spark, sf_dir):
    large = scan(spark, sf_dir, "orders").where("o_totalprice > 400000").frame()
    return ops.semi_join(scan(spark, sf_dir, "customer").frame(), large, ["c_custkey"], ["o_custkey"]).select("c_custkey", "c_name")


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderdate >= TIMESTAMP '2001-01-01')")
def anti_join(spark, sf_dir):
    late = scan(spark, sf_dir, "orders").where("o_orderdate >= timestamp('2001-01-01')").frame()
    return ops.anti_join(scan(spark, sf_dir, "customer").frame(), late, ["c_custkey"], ["o_custkey"]).select("c_custkey", "c_name")


@query("WITH y AS (SELECT o_custkey AS k, year(o_orderdate) AS y, count(*) AS n FROM orders GROUP BY 1, 2) SELECT a.k AS custkey, a.y::INTEGER AS year, (a.n - b.n)::BIGINT AS change FROM y a JOIN y b ON a.k = b.k AND a.y = b.y + 1")
def join_on_arithmetic(spark, sf_dir):
    key, n = Schema("k", [("k", "long"), ("y", "int")]), Schema("n", [("n", "long")])
    yearly = scan(spark, sf_dir, "orders").group_by(key, n, ["o_custkey", "year(o_orderdate)"], [(0, lambda acc, e: acc + 1, lambda a: a)])
    before = Schema("before", [("k2", "long"), ("y2", "int"), ("n2", "long")])
    return yearly.join(yearly, rhsSchema=before, method="hash", expr="k == k2 and y == y2 + 1").select(columns("custkey:long=k", "year:int=y", "change:long=n - n2")).frame()


# ---- grouping and folds


@query("SELECT c_nationkey, least(1000000, round(min(c_acctbal), 2))::DOUBLE AS low, greatest(0, round(max(c_acctbal), 2))::DOUBLE AS high FROM customer GROUP BY c_nationkey")
def groupby_minmax(spark, sf_dir):
    folds = [(1000000, lambda acc, e: min(acc, e.c_acctbal), lambda x: round(x, 2)), (0, lambda acc, e: max(acc, e.c_acctbal), lambda x: round(x, 2))]
    return scan(spark, sf_dir, "customer").groupBy(groupSchema=Schema("k", [("c_nationkey", "int")]), aggSchema=Schema("a", [("low", "double"), ("high", "double")]), groupExpr=lambda e: e.c_nationkey, aggExprs=folds, groupHashFn=lambda v: hash(v[0]) % 2).frame()


@query("SELECT (o_orderkey % 7)::BIGINT AS bucket, count(*)::BIGINT AS n FROM orders GROUP BY 1")
def groupby_mod(spark, sf_dir):
    return scan(spark, sf_dir, "orders").groupBy(groupSchema=Schema("k", [("bucket", "long")]), aggSchema=Schema("a", [("n", "long")]), groupExpr=lambda e: e.o_orderkey % 7, aggExprs=[(0, lambda acc, e: acc + 1, lambda x: x)]).frame()


@query("SELECT l_returnflag, l_linestatus, l_linenumber, count(*)::BIGINT AS n FROM lineitem GROUP BY ALL")
def groupby_multi(spark, sf_dir):
    return scan(spark, sf_dir, "lineitem").groupBy(groupSchema=Schema("k", [("l_returnflag", "string"), ("l_linestatus", "string"), ("l_linenumber", "int")]), aggSchema=Schema("a", [("n", "long")]), groupExpr=lambda e: (e.l_returnflag, e.l_linestatus, e.l_linenumber), aggExprs=[(0, lambda acc, e: acc + 1, lambda x: x)]).frame()


@query("SELECT l_returnflag, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem GROUP BY l_returnflag")
def fold_sum(spark, sf_dir):
    return scan(spark, sf_dir, "lineitem").groupBy(groupSchema=Schema("k", [("l_returnflag", "string")]), aggSchema=Schema("a", [("revenue", "double")]), groupExpr=lambda e: e.l_returnflag, aggExprs=[(0.0, lambda acc, e: acc + e.l_extendedprice * (1 - e.l_discount), lambda x: round(x, 2))]).frame()


@query("SELECT l_suppkey, sum(l_quantity) / count(*) AS mean FROM lineitem GROUP BY l_suppkey")
def fold_mean(spark, sf_dir):
    """A fold whose accumulator is a tuple."""
    fold = ((0.0, 0), lambda acc, e: (acc[0] + e.l_quantity, acc[1] + 1), lambda acc: acc[0] / acc[1])
    return scan(spark, sf_dir, "lineitem").groupBy(groupSchema=Schema("k", [("l_suppkey", "long")]), aggSchema=Schema("a", [("mean", "double")]), groupExpr=lambda e: e.l_suppkey, aggExprs=[fold]).frame()


@query("WITH RECURSIVE o AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS i FROM orders), f AS (SELECT o_custkey, i, (7 * 31 + o_orderkey) % 1000003 AS h FROM o WHERE i = 1 UNION ALL SELECT o.o_custkey, o.i, (f.h * 31 + o.o_orderkey) % 1000003 FROM f JOIN o ON o.o_custkey = f.o_custkey AND o.i = f.i + 1) SELECT o_custkey, max_by(h, i)::BIGINT AS digest FROM f GROUP BY o_custkey")
def fold_custom(spark, sf_dir):
    """A fold that depends on the order of rows: a rolling digest of each customer's orders by date."""
    fold = (7, lambda acc, e: (acc * 31 + e.o_orderkey) % 1000003, lambda x: x)
    return scan(spark, sf_dir, "orders").groupBy(groupSchema=Schema("k", [("o_custkey", "long")]), aggSchema=Schema("a", [("digest", "long")]), groupExpr=lambda e: e.o_custkey, aggExprs=[fold], order=["o_orderdate", "o_orderkey"]).frame()


def _longest(acc, e):
    """Control flow on values: it can't be traced."""
    if len(e.p_name) > len(acc) or len(e.p_name) == len(acc) and e.p_name < acc:
        return e.p_name
    return acc


def _longer(a, b):
    return min((a, b), key=lambda x: (-len(x), x))


@query("SELECT p_brand, arg_min(p_name, (-length(p_name), p_name)) AS longest FROM part GROUP BY p_brand")
def fold_python(spark, sf_dir):
    """A fold in Python, merged from parts of the groups."""
    return scan(spark, sf_dir, "part").groupBy(groupSchema=Schema("k", [("p_brand", "string")]), aggSchema=Schema("a", [("longest", "string")]), groupExpr=lambda e: e.p_brand, aggExprs=[("", _longest, lambda x: x, _longer)]).frame()


@query("WITH q AS (SELECT n_nationkey, n_name, p_partkey, p_name, sum(l_quantity) AS quantity FROM nation JOIN customer ON n_nationkey = c_nationkey JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey GROUP BY ALL) SELECT n_nationkey, n_name, p_partkey, p_name, quantity FROM q QUALIFY row_number() OVER (PARTITION BY n_nationkey ORDER BY quantity DESC, p_partkey) = 1")
def max_by_group(spark, sf_dir):
    """The most ordered part of each nation; of equals the smallest key.  Names are joined to the few rows that are left."""
    base = db(spark, sf_dir)
    quantities = _lines_of_nations(spark, sf_dir).group_by(
        Schema("k", [("n_nationkey", "int"), ("n_name", "string"), ("l_partkey", "long")]), Schema("a", [("quantity", "double")]),
        lambda e: (e.n_nationkey, e.n_name, e.l_partkey), [(0.0, lambda acc, e: acc + e.l_quantity, lambda x: x)]).frame()
    known = ops.semi_join(quantities, base.table("part"), ["l_partkey"], ["p_partkey"])
    best = F.max_by(F.struct("l_partkey", "quantity"), F.struct("quantity", -F.col("l_partkey")))
    top = known.groupBy("n_nationkey", "n_name").agg(best.alias("b")).select("n_nationkey", "n_name", "b.l_partkey", "b.quantity")
    return ops.join(top, base.table("part").select("p_partkey", "p_name"), left_keys=["l_partkey"], right_keys=["p_partkey"]).select("n_nationkey", "n_name", "p_partkey", "p_name", "quantity")


def _lines_of_nations(spark, sf_dir) -> Query:
    customers = scan(spark, sf_dir, "nation").join(scan(spark, sf_dir, "customer"), expr="n_nationkey == c_nationkey")
    return customers.join(scan(spark, sf_dir, "orders"), expr="c_custkey == o_custkey").join(scan(spark, sf_dir, "lineitem"), expr="o_orderkey == l_orderkey")


@query("SELECT count(*)::BIGINT AS tuples FROM lineitem")
def relation_count(spark, sf_dir):
    return scan(spark, sf_dir, "lineitem").frame().agg(F.count("*").alias("tuples"))


# ---- order and limits


@query("SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey")
def sort_desc(spark, sf_dir):
    return scan(spark, sf_dir, "customer").select(columns("c_custkey:long", "c_acctbal:double")).order(sortKeyFn=lambda e: e.c_acctbal, sortKeyDesc="c_acctbal", ties=["c_custkey"]).frame()


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def topk(spark, sf_dir):
    return scan(spark, sf_dir, "orders").select(columns("o_orderkey:long", "o_totalprice:double")).order("o_totalprice", ties=["o_orderkey"]).limit(25).frame()


@query("SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice, p_partkey LIMIT 10 OFFSET 20")
def limit_offset(spark, sf_dir):
    return scan(spark, sf_dir, "part").select(columns("p_partkey:long", "p_retailprice:double")).order("p_retailprice", ascending=True, ties=["p_partkey"]).limit(10, offset=20).frame()


# ---- sets


@query("SELECT n_nationkey AS key, n_name AS name FROM nation UNION ALL SELECT r_regionkey, r_name FROM region UNION ALL SELECT r_regionkey, r_name FROM region")
def union_all(spark, sf_dir):
    regions = scan(spark, sf_dir, "region").select(columns("key:int=r_regionkey", "name:string=r_name"))
    return scan(spark, sf_dir, "nation").select(columns("key:int=n_nationkey", "name:string=n_name")).union(regions).union(regions).frame()


@query("SELECT c_nationkey AS nation FROM customer UNION SELECT s_nationkey FROM supplier")
def union_distinct(spark, sf_dir):
    return scan(spark, sf_dir, "customer").select(columns("nation:int=c_nationkey")).union_distinct(scan(spark, sf_dir, "supplier").select(columns("nation:int=s_nationkey"))).frame()


# ---- storage


def _own(spark, sf_dir, name: str, source: str) -> Database:
    """A new database with a copy of a table."""
    base = Database(spark, storage.scratch(spark))
    df = db(spark, sf_dir).table(source)
    base.create_relation(name, [(f, str(t)) for f, t in Schema.of(name, df).types.items()])
    base.insert_frame(name, df)
    return base


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_custkey = 42")
def index_lookup(spark, sf_dir):
    base = _own(spark, sf_dir, "orders", "orders")
    base.cluster("orders", ["o_custkey"])
    return base.lookup(base.create_index("orders", ["o_custkey"]), 42).select("o_orderkey", "o_custkey", "o_totalprice")


@query("SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey = 7")
def primary_key_lookup(spark, sf_dir):
    base = _own(spark, sf_dir, "supplier", "supplier")
    return base.lookup(base.create_index("supplier", ["s_suppkey"], primary=True), 7).select("s_suppkey", "s_name")


@query("SELECT c_nationkey, c_custkey FROM customer ORDER BY c_nationkey, c_custkey")
def index_scan_ordered(spark, sf_dir):
    base = _own(spark, sf_dir, "customer", "customer")
    return base.scan_index(base.create_index("customer", ["c_nationkey", "c_custkey"])).select("c_nationkey", "c_custkey")


@query("SELECT s_suppkey, s_name, s_nationkey FROM supplier WHERE NOT (s_nationkey < 10 AND s_acctbal < 5000)")
def dml_delete(spark, sf_dir):
    base = _own(spark, sf_dir, "supplier", "supplier")
    base.delete_where("supplier", "s_nationkey < 10 and s_acctbal < 5000")
    return base.table("supplier").select("s_suppkey", "s_name", "s_nationkey")


@query("SELECT s_suppkey, CASE WHEN s_nationkey IN (1, 2, 3) THEN round(s_acctbal * 2 + 1, 2) ELSE round(s_acctbal, 2) END AS s_acctbal FROM supplier")
def dml_update(spark, sf_dir):
    base = _own(spark, sf_dir, "supplier", "supplier")
    base.update_where("supplier", "s_nationkey in (1, 2, 3)", {"s_acctbal": "s_acctbal * 2 + 1"})
    return base.table("supplier").select("s_suppkey", F.round("s_acctbal", 2).alias("s_acctbal"))


@query("SELECT r_regionkey, r_name FROM region WHERE r_regionkey <> 3 UNION ALL SELECT 77, 'ATLANTIS' UNION ALL SELECT 99, 'NEW'")
def dml_tuples(spark, sf_dir):
    """Inserts, an update and deletes by row address."""
    base = Database(spark, storage.scratch(spark))
    base.create_relation("region", [("r_regionkey", "int"), ("r_name", "char(25)")])
    at = {r.r_regionkey: base.insert("region", r.r_regionkey, r.r_name) for r in db(spark, sf_dir).table("region").collect()}  # five rows
    new = base.insert("region", 98, "OLD")
    base.insert("region", 77, "ATLANTIS")
    base.update("region", new, 99, "NEW")
    base.delete("region", at[3])
    return base.table("region")


@query("SELECT s_suppkey, s_name, CASE WHEN s_suppkey = 7 THEN 99 WHEN s_nationkey = 4 THEN s_nationkey + 100 ELSE s_nationkey END AS s_nationkey FROM supplier WHERE s_suppkey <> 3 AND s_nationkey <> 11")
def dml_by_key(spark, sf_dir):
    """Changes and deletes by primary key and by index."""
    base = _own(spark, sf_dir, "supplier", "supplier")
    nation = base.create_index("supplier", ["s_nationkey"])
    base.create_index("supplier", ["s_suppkey"], primary=True)
    base.update_by_index(nation, (4,), {"s_nationkey": "s_nationkey + 100"})
    base.delete_by_index(nation, 11)
    base.update_key("supplier", (7,), {"s_nationkey": "99"})
    base.delete_key("supplier", 3)
    return base.table("supplier").select("s_suppkey", "s_name", "s_nationkey")


@query("SELECT r_regionkey, r_name, count(*) OVER () AS n, true AS refused FROM (SELECT r_regionkey, r_name FROM region UNION ALL SELECT 50, 'LATER') x")
def unique_inserts(spark, sf_dir):
    """A second row with a primary key is refused, as a tuple and in a frame, and leaves nothing behind."""
    base, region = Database(spark, storage.scratch(spark)), db(spark, sf_dir).table("region")
    base.create_relation("region", [("r_regionkey", "int"), ("r_name", "char(25)")])
    base.create_index("region", ["r_regionkey"], primary=True)
    base.insert_frame("region", region)
    base.insert("region", 50, "LATER")
    refused = 0
    for change in (lambda: base.insert("region", 50, "AGAIN"), lambda: base.insert("region", 0, "AGAIN"), lambda: base.insert_frame("region", region.limit(2))):
        try:
            change()
        except ValueError:
            refused += 1
    rows = base.table("region")
    return rows.crossJoin(F.broadcast(rows.agg(F.count("*").alias("n")))).withColumn("refused", F.lit(refused == 3))  # one row


@query("SELECT s_suppkey, s_name, (s_suppkey >= 10000000) AS later FROM (SELECT s_suppkey, s_name FROM supplier UNION ALL SELECT 10000000 + range, 'added' FROM range(3)) x")
def db_restart(spark, sf_dir):
    """A database opened again goes on where it was: rows, indexes and row addresses."""
    base = _own(spark, sf_dir, "supplier", "supplier")
    base.create_index("supplier", ["s_suppkey"], primary=True)
    base.close()
    again = Database(spark, base.folder)
    source = again.table("supplier").limit(1).first().asDict()
    for i in range(3):
        again.insert("supplier", *(source | {"s_suppkey": 10_000_000 + i, "s_name": "added"}).values())
    again.close()
    third = Database(spark, base.folder)
    addresses = third.rows("supplier").groupBy("_tid").agg(F.count("*").alias("n"))
    rows = third.rows("supplier").join(addresses.where("n = 1"), "_tid", "left_semi")  # rows that share an address would be missing
    return rows.select("s_suppkey", "s_name", (F.col("s_suppkey") >= 10_000_000).alias("later"))


@query("SELECT n_nationkey, n_name FROM nation WHERE n_nationkey < 20")
def attach_detach(spark, sf_dir):
    """Files from outside as a relation; its changes leave them alone, and a detached relation's files can be attached again."""
    base = Database(spark, storage.scratch(spark))
    base.attach_relation("nation", f"{sf_dir}/nation.parquet")
    base.delete_where("nation", "n_nationkey >= 20")
    folder = base.relations["nation"]["files"][0].rsplit("/", 1)[0]
    base.remove_relation("nation", keep_files=True)
    base.attach_relation("again", folder)
    return base.table("again").select("n_nationkey", "n_name") if base.relation_names() == ["again"] and base.schema("again").fields else base.table("nation")


@query("WITH totals AS (SELECT o_custkey, sum(o_totalprice) AS total FROM orders GROUP BY o_custkey), large AS (SELECT * FROM totals WHERE total > 2000000) SELECT c_nationkey, count(*)::BIGINT AS n FROM large JOIN customer ON o_custkey = c_custkey GROUP BY c_nationkey")
def sql_cte(spark, sf_dir):
    base = Database(spark, storage.scratch(spark))
    for name in ("orders", "customer"):
        base.attach_relation(name, f"{sf_dir}/{name}.parquet")
    return base.sql("WITH totals AS (SELECT o_custkey, sum(o_totalprice) AS total FROM orders GROUP BY o_custkey), large AS (SELECT * FROM totals WHERE total > 2000000) SELECT c_nationkey, count(*) AS n FROM large JOIN customer ON o_custkey = c_custkey GROUP BY c_nationkey")


@query("SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 2")
def truncate_insert(spark, sf_dir):
    base = _own(spark, sf_dir, "nation", "nation")
    base.truncate("nation")
    base.insert_frame("nation", db(spark, sf_dir).table("nation").where("n_regionkey = 2"))
    return base.table("nation").select("n_nationkey", "n_name")


@query("SELECT c_nationkey, count(*)::BIGINT AS n FROM customer WHERE c_acctbal > 1000 GROUP BY c_nationkey HAVING count(*) > 3")
def temporary_relation(spark, sf_dir):
    """An operator's output, kept as a relation and read again."""
    base = Database(spark, storage.scratch(spark))
    name = base.store(scan(spark, sf_dir, "customer").where("c_acctbal > 1000"))
    q = base.query().from_table(name).group_by(Schema("k", [("c_nationkey", "int")]), Schema("a", [("n", "long")]), ["c_nationkey"], [(0, lambda acc, e: acc + 1, lambda x: x)])
    return q.where("n > 3").frame()


@query("SELECT n_nationkey, n_name FROM nation")
def tuple_iterator(spark, sf_dir):
    """Rows through the iterator of a relation's tuples, a partition at a time."""
    base = _own(spark, sf_dir, "nation", "nation")
    return spark.createDataFrame([(r.n_nationkey, r.n_name) for r in base.tuples("nation")], "n_nationkey int, n_name string")  # 25 rows


@query("SELECT c_nationkey, count(*)::BIGINT AS n FROM customer GROUP BY c_nationkey")
def page_iterator(spark, sf_dir):
    """A function of a relation's batches."""
    def count(batches):
        for pdf in batches:
            yield pdf.groupby("c_nationkey").size().reset_index(name="n")

    base = _own(spark, sf_dir, "customer", "customer")
    return base.batches("customer", count, "c_nationkey int, n long").groupBy("c_nationkey").agg(F.sum("n").alias("n"))


@query("SELECT count(*)::BIGINT AS tuples, true AS sized FROM orders")
def file_metadata(spark, sf_dir):
    base = _own(spark, sf_dir, "orders", "orders")
    return base.files("orders").agg(F.sum("tuples").alias("tuples"), (F.min("bytes") > 0).alias("sized"))


@query("SELECT count(*)::BIGINT AS n FROM supplier")
def direct_scan(spark, sf_dir):
    return _own(spark, sf_dir, "supplier", "supplier").direct("supplier").agg(F.count("*").alias("n"))


@query("SELECT true AS near, count(*) AS tuples FROM customer")
def sampled_load(spark, sf_dir):
    """Loads about a third of a file's rows: within six standard deviations, and all of them known rows."""
    base, source = Database(spark, storage.scratch(spark)), db(spark, sf_dir).table("customer").select("c_custkey", "c_name")
    folder = storage.scratch(spark)
    delimited.write_delimited(source, f"{folder}/customer.csv")
    base.create_relation("customer", [("c_custkey", "long"), ("c_name", "char(25)")])
    delimited.import_file(base, f"{folder}/customer.csv", "customer", "is", scale=1 / 3)
    loaded = base.table("customer").join(source, ["c_custkey", "c_name"], "left_semi").agg(F.count("*").alias("n"))
    whole = source.agg(F.count("*").alias("tuples"))
    near = F.abs(F.col("n") - F.col("tuples") / 3) <= 6 * F.sqrt(F.col("tuples") * 2 / 9)
    return whole.crossJoin(F.broadcast(loaded)).select(near.alias("near"), "tuples")  # one row each


@query("SELECT l_returnflag, sum(l_quantity) AS quantity, 'by_flag_status' AS view FROM lineitem WHERE l_linenumber <> 7 GROUP BY l_returnflag")
def view_rewrite(spark, sf_dir):
    """A rollup is answered from the stored view that covers it, which is made again once its base has changed."""
    base = Database(spark, storage.scratch(spark))
    base.create_relation("lines", [("l_returnflag", "string"), ("l_linestatus", "string"), ("l_linenumber", "int"), ("l_quantity", "double")])
    base.insert_frame("lines", db(spark, sf_dir).table("lineitem"))
    views, key = layout.MaterializedViews(spark, storage.scratch(spark)), lambda *names: {n: F.col(n) for n in names}
    for name, keys in (("by_flag_status", ("l_returnflag", "l_linestatus")), ("by_all", ("l_returnflag", "l_linestatus", "l_linenumber"))):
        views.define_rollup(name, "lines", lambda: base.table("lines"), key(*keys), {"quantity": F.col("l_quantity")})
    views.rollup("lines", key("l_returnflag"), {"quantity": F.col("l_quantity")})
    base.delete_where("lines", "l_linenumber == 7")
    found, name = views.rollup("lines", key("l_returnflag"), {"quantity": F.col("l_quantity")})
    return found.withColumn("view", F.lit(name))


@query("SELECT c_custkey, c_name, c_nationkey, round(c_acctbal, 2) AS c_acctbal, c_mktsegment FROM customer")
def delimited_round_trip(spark, sf_dir):
    """Delimited text, parsed by codes, to Parquet and back."""
    schema = Schema("customer", [("c_custkey", "long"), ("c_name", "char(25)"), ("c_nationkey", "int"), ("c_acctbal", "double"), ("c_mktsegment", "char(10)")])
    folder = storage.scratch(spark)
    delimited.write_delimited(db(spark, sf_dir).table("customer").select(*schema.fields), f"{folder}/customer.csv")
    delimited.to_binary(delimited.read_delimited(spark, f"{folder}/customer.csv", schema, "isids"), f"{folder}/customer.parquet")
    return delimited.from_binary(spark, f"{folder}/customer.parquet", schema).withColumn("c_acctbal", F.round("c_acctbal", 2))


@query()
def sample_estimate(spark, sf_dir):
    """The estimated and the actual number of rows of a filtered scan."""
    plan = scan(spark, sf_dir, "lineitem").where("l_quantity < 24").finalize()
    return spark.createDataFrame([(float(plan.sample(10)), plan.cardinality(estimated=False))], "estimate double, actual double")


@query("SELECT l_shipmonth, round(sum(net), 4) AS revenue FROM (SELECT (year(l_shipdate) * 100 + month(l_shipdate))::INTEGER AS l_shipmonth, l_extendedprice * (1 - l_discount) AS net FROM lineitem) GROUP BY 1")
def materialized_view(spark, sf_dir):
    """A rollup over a stored view of daily sums in place of the lines."""
    views = layout.MaterializedViews(spark, storage.scratch(spark))
    views.define("daily", lambda: scan(spark, sf_dir, "lineitem").frame().groupBy(F.to_date("l_shipdate").alias("day")).agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("net")))
    month = (F.year("day") * 100 + F.month("day")).cast("int")
    return views.frame("daily").groupBy(month.alias("l_shipmonth")).agg(F.round(F.sum("net"), 4).alias("revenue"))


# ---- join order

SIX_WAY_SQL = """SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue
FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey JOIN nation ON s_nationkey = n_nationkey
JOIN region ON n_regionkey = r_regionkey
WHERE r_name = 'ASIA' AND o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1997-01-01' GROUP BY n_name"""


def local_suppliers(spark, sf_dir) -> Query:
    """Revenue of a region's nations from local suppliers: a join of six relations."""
    t = db(spark, sf_dir).query().from_table
    nations = t("nation").join(t("region").where("r_name == 'ASIA'"), method="block-nested-loops", expr="n_regionkey == r_regionkey")
    suppliers = t("supplier").join(nations, expr="s_nationkey == n_nationkey")
    orders = t("orders").where("o_orderdate >= timestamp('1996-01-01')").where("o_orderdate < timestamp('1997-01-01')")
    lines = t("lineitem").join(suppliers, expr="l_suppkey == s_suppkey").join(orders, expr="l_orderkey == o_orderkey")
    return lines.join(t("customer"), expr="o_custkey == c_custkey and c_nationkey == s_nationkey")


def _revenue(q: Query, keys: list[tuple[str, str]]) -> Query:
    names = [n for n, _ in keys]
    return q.group_by(Schema("k", keys), Schema("a", [("revenue", "double")]), names, [(0.0, lambda acc, e: acc + e.l_extendedprice * (1 - e.l_discount), lambda x: round(x, 4))])


@query(SIX_WAY_SQL)
def join_order_leftdeep(spark, sf_dir):
    return optimize(_revenue(local_suppliers(spark, sf_dir), [("n_name", "string")]), "left-deep")[0].frame()


@query(SIX_WAY_SQL)
def join_order_bushy(spark, sf_dir):
    return optimize(_revenue(local_suppliers(spark, sf_dir), [("n_name", "string")]), "bushy")[0].frame()


@query(SIX_WAY_SQL)
def join_order_greedy(spark, sf_dir):
    return optimize(_revenue(local_suppliers(spark, sf_dir), [("n_name", "string")]), "greedy")[0].frame()


# ---- decision-support workload


@query("SELECT round(sum(l_extendedprice * l_discount), 4) AS revenue FROM lineitem WHERE l_shipdate >= TIMESTAMP '1996-01-01' AND l_shipdate < TIMESTAMP '1997-01-01' AND l_discount > 0.05 AND l_discount < 0.07 AND l_quantity < 24")
def forecast_revenue(spark, sf_dir):
    q = scan(spark, sf_dir, "lineitem").where("l_shipdate >= timestamp('1996-01-01')").where("l_shipdate < timestamp('1997-01-01')")
    q = q.where("l_discount > .05").where("l_discount < .07").where("l_quantity < 24")
    return q.frame().agg(F.round(F.sum(F.col("l_extendedprice") * F.col("l_discount")), 4).alias("revenue"))


@query("SELECT round(sum(l_extendedprice * l_discount), 4) AS revenue FROM lineitem WHERE l_shipdate >= TIMESTAMP '1996-01-01' AND l_shipdate < TIMESTAMP '1997-01-01' AND l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24")
def forecast_revenue_inclusive(spark, sf_dir):
    q = scan(spark, sf_dir, "lineitem").where("timestamp('1996-01-01') <= l_shipdate < timestamp('1997-01-01') and 0.05 <= l_discount <= 0.07 and l_quantity < 24")
    return q.frame().agg(F.round(F.sum(F.col("l_extendedprice") * F.col("l_discount")), 4).alias("revenue"))


@query("SELECT round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_shipdate >= TIMESTAMP '1996-09-01' AND l_shipdate < TIMESTAMP '1996-10-01'")
def monthly_part_revenue(spark, sf_dir):
    q = scan(spark, sf_dir, "lineitem").where("l_shipdate >= timestamp('1996-09-01')").where("l_shipdate < timestamp('1996-10-01')")
    q = q.join(scan(spark, sf_dir, "part"), method="block-nested-loops", expr="l_partkey == p_partkey")
    return q.frame().agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 4).alias("revenue"))


SHIPPING_SQL = "SELECT l_orderkey, o_orderdate::DATE AS o_orderdate, round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE c_mktsegment = 'BUILDING' AND o_orderdate < TIMESTAMP '1998-03-15' AND l_shipdate > TIMESTAMP '1998-03-15' GROUP BY 1, 2"


def _shipping(spark, sf_dir) -> Query:
    q = scan(spark, sf_dir, "lineitem").where("l_shipdate > timestamp('1998-03-15')")
    q = q.join(scan(spark, sf_dir, "orders").where("o_orderdate < timestamp('1998-03-15')"), expr="l_orderkey == o_orderkey")
    return q.join(scan(spark, sf_dir, "customer").where("c_mktsegment == 'BUILDING'"), expr="o_custkey == c_custkey")


@query(SHIPPING_SQL)
def shipping_priority(spark, sf_dir):
    return _revenue(_shipping(spark, sf_dir), [("l_orderkey", "long"), ("o_orderdate", "date")]).frame()


@query(SHIPPING_SQL)
def shipping_priority_eager(spark, sf_dir):
    """The same with the lines summed by order below the joins."""
    lines = scan(spark, sf_dir, "lineitem").where("l_shipdate > timestamp('1998-03-15')").frame()
    sums = ops.eager_sum(lines, ["l_orderkey"], F.col("l_extendedprice") * (1 - F.col("l_discount")), "part")
    q = Query(db(spark, sf_dir)).from_frame(sums, "sums").join(scan(spark, sf_dir, "orders").where("o_orderdate < timestamp('1998-03-15')"), expr="l_orderkey == o_orderkey")
    q = q.join(scan(spark, sf_dir, "customer").where("c_mktsegment == 'BUILDING'"), expr="o_custkey == c_custkey")
    return q.select(columns("l_orderkey:long", "o_orderdate:date", "revenue:double=round(part, 4)")).frame()


@query("SELECT c_custkey, c_name, round(c_acctbal, 2) AS c_acctbal, n_name, round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderdate >= TIMESTAMP '1996-10-01' AND o_orderdate < TIMESTAMP '1997-01-01' AND l_returnflag = 'R' GROUP BY 1, 2, 3, 4")
def returned_items(spark, sf_dir):
    t = lambda name: scan(spark, sf_dir, name)
    lines = t("lineitem").where("l_returnflag == 'R'").join(t("orders").where("o_orderdate < timestamp('1997-01-01')").where("o_orderdate >= timestamp('1996-10-01')"), expr="l_orderkey == o_orderkey")
    q = t("customer").join(t("nation"), method="block-nested-loops", expr="c_nationkey == n_nationkey").join(lines, expr="c_custkey == o_custkey")
    return _revenue(q, [("c_custkey", "long"), ("c_name", "string"), ("c_acctbal", "double"), ("n_name", "string")]).frame().withColumn("c_acctbal", F.round("c_acctbal", 2))


@query(SIX_WAY_SQL)
def local_supplier_volume(spark, sf_dir):
    return _revenue(local_suppliers(spark, sf_dir), [("n_name", "string")]).frame()


@query("SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base_price, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price, round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS sum_charge, round(avg(l_quantity), 4) AS avg_qty, round(avg(l_extendedprice), 4) AS avg_price, round(avg(l_discount), 6) AS avg_disc, count(*)::BIGINT AS count_order FROM lineitem WHERE l_shipdate <= TIMESTAMP '2001-09-02' GROUP BY 1, 2 ORDER BY 1, 2")
def pricing_summary(spark, sf_dir):
    price, disc = F.col("l_extendedprice"), 1 - F.col("l_discount")
    return (
        scan(spark, sf_dir, "lineitem").where("l_shipdate <= timestamp('2001-09-02')").frame().groupBy("l_returnflag", "l_linestatus")
        .agg(
            F.sum("l_quantity").alias("sum_qty"), F.round(F.sum(price), 2).alias("sum_base_price"), F.round(F.sum(price * disc), 2).alias("sum_disc_price"),
            F.round(F.sum(price * disc * (1 + F.col("l_tax"))), 2).alias("sum_charge"), F.round(F.avg("l_quantity"), 4).alias("avg_qty"),
            F.round(F.avg("l_extendedprice"), 4).alias("avg_price"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("count_order"),
        ).orderBy("l_returnflag", "l_linestatus")
    )


@query("SELECT c_name, c_custkey, o_orderkey, o_orderdate::DATE AS o_orderdate, round(o_totalprice, 2) AS o_totalprice, sum(l_quantity) AS quantity FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING sum(l_quantity) > 300) GROUP BY 1, 2, 3, 4, 5")
def large_orders(spark, sf_dir):
    """HAVING: the sums by order are made once, and only orders above the bound go on to the joins."""
    sums = scan(spark, sf_dir, "lineitem").group_by(Schema("k", [("l_orderkey", "long")]), Schema("a", [("quantity", "double")]), ["l_orderkey"], [(0.0, lambda acc, e: acc + e.l_quantity, lambda x: x)]).where("quantity > 300")
    q = sums.join(scan(spark, sf_dir, "orders"), expr="l_orderkey == o_orderkey").join(scan(spark, sf_dir, "customer"), expr="o_custkey == c_custkey")
    return q.select(columns("c_name:string", "c_custkey:long", "o_orderkey:long", "o_orderdate:date", "o_totalprice:double=round(o_totalprice, 2)", "quantity:double")).frame()


NATIONS = (13, 3, 23, 9, 0, 18, 17)


@query(f"SELECT c_nationkey, count(*)::BIGINT AS numcust, round(sum(c_acctbal), 2) AS totacctbal FROM customer WHERE c_nationkey IN {NATIONS} AND c_acctbal > (SELECT avg(c_acctbal) FROM customer WHERE c_acctbal > 0 AND c_nationkey IN {NATIONS}) AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderdate >= TIMESTAMP '2001-01-01') GROUP BY c_nationkey")
def dormant_customers(spark, sf_dir):
    """A scalar subquery and an anti-join."""
    chosen = scan(spark, sf_dir, "customer").where(f"c_nationkey in {NATIONS}").frame()
    mean = chosen.where("c_acctbal > 0").agg(F.avg("c_acctbal").alias("mean"))  # one row
    rich = chosen.crossJoin(F.broadcast(mean)).where("c_acctbal > mean").drop("mean")
    late = scan(spark, sf_dir, "orders").where("o_orderdate >= timestamp('2001-01-01')").frame()
    return ops.anti_join(rich, late, ["c_custkey"], ["o_custkey"]).groupBy("c_nationkey").agg(F.count("*").alias("numcust"), F.round(F.sum("c_acctbal"), 2).alias("totacctbal"))


@query("SELECT p_partkey, p_name, sum(l_quantity) AS quantity FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag = 'R' GROUP BY 1, 2 ORDER BY quantity DESC, p_partkey LIMIT 10")
def top_returned_parts(spark, sf_dir):
    q = scan(spark, sf_dir, "lineitem").where("l_returnflag == 'R'").join(scan(spark, sf_dir, "part"), expr="l_partkey == p_partkey")
    q = q.group_by(Schema("k", [("p_partkey", "long"), ("p_name", "string")]), Schema("a", [("quantity", "double")]), ["p_partkey", "p_name"], [(0.0, lambda acc, e: acc + e.l_quantity, lambda x: x)])
    return q.order("quantity", ties=["p_partkey"]).limit(10).frame()


@query("SELECT c_custkey, c_name, avg(date_diff('day', o_orderdate::DATE, l_shipdate::DATE)) AS wait FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2 ORDER BY wait DESC, c_custkey LIMIT 10")
def longest_waits(spark, sf_dir):
    q = scan(spark, sf_dir, "customer").join(scan(spark, sf_dir, "orders"), expr="c_custkey == o_custkey").join(scan(spark, sf_dir, "lineitem"), expr="o_orderkey == l_orderkey")
    fold = ((0, 0), lambda acc, e: (acc[0] + e.days, acc[1] + 1), lambda acc: acc[0] / acc[1])
    q = q.select(columns("c_custkey:long", "c_name:string", "days:long=datediff(l_shipdate, o_orderdate)")).group_by(Schema("k", [("c_custkey", "long"), ("c_name", "string")]), Schema("a", [("wait", "double")]), ["c_custkey", "c_name"], [fold])
    return q.order("wait", ties=["c_custkey"]).limit(10).frame()


@query("""WITH placed AS (
  SELECT n_name, n_nationkey, sum(o_totalprice) AS total FROM nation JOIN customer ON n_nationkey = c_nationkey JOIN orders ON c_custkey = o_custkey GROUP BY 1, 2 ORDER BY total DESC, n_nationkey LIMIT 5
), ranked AS (
  SELECT placed.n_name AS customer_nation, s.n_name AS supplier_nation, sum(o_totalprice) AS value,
         row_number() OVER (PARTITION BY placed.n_nationkey ORDER BY sum(l_extendedprice) DESC, s.n_nationkey) AS place
  FROM placed JOIN customer ON placed.n_nationkey = c_nationkey JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey
  JOIN supplier ON l_suppkey = s_suppkey JOIN nation s ON s_nationkey = s.n_nationkey GROUP BY placed.n_nationkey, placed.n_name, s.n_nationkey, s.n_name
) SELECT customer_nation, supplier_nation, round(value, 2) AS value FROM ranked WHERE place <= 5""")
def nation_trade(spark, sf_dir):
    """For the five nations with the largest orders the five that supply most; an order's value counts for each line."""
    customers = scan(spark, sf_dir, "nation").join(scan(spark, sf_dir, "customer"), expr="n_nationkey == c_nationkey").join(scan(spark, sf_dir, "orders"), expr="c_custkey == o_custkey")
    placed = customers.frame().groupBy("n_nationkey").agg(F.sum("o_totalprice").alias("total")).orderBy(F.desc("total"), "n_nationkey").limit(5).select(F.col("n_nationkey").alias("placer"))
    orders = ops.join(customers.frame(), placed, "block-nested-loops", left_keys=["n_nationkey"], right_keys=["placer"])
    other = Schema("s", [("key2", "int"), ("name2", "string"), ("region2", "int")])
    lines = Query(db(spark, sf_dir)).from_frame(orders, "orders_of_placers").join(scan(spark, sf_dir, "lineitem"), expr="o_orderkey == l_orderkey").join(scan(spark, sf_dir, "supplier"), expr="l_suppkey == s_suppkey")
    lines = lines.join(scan(spark, sf_dir, "nation"), rhsSchema=other, expr="s_nationkey == key2").frame()
    sums = lines.groupBy("n_nationkey", "n_name", "key2", "name2").agg(F.sum("o_totalprice").alias("value"), F.sum("l_extendedprice").alias("supplied"))
    place = F.row_number().over(Window.partitionBy("n_nationkey").orderBy(F.desc("supplied"), "key2"))  # at most a row for each nation
    return sums.withColumn("place", place).where("place <= 5").select(F.col("n_name").alias("customer_nation"), F.col("name2").alias("supplier_nation"), F.round("value", 2).alias("value"))


@query("WITH y AS (SELECT c_mktsegment AS segment, year(o_orderdate)::INTEGER AS year, count(*) AS n FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY 1, 2), last AS (SELECT segment, max(year) AS year FROM y GROUP BY segment) SELECT segment, last.year AS last_year, (a.n - b.n)::BIGINT AS change FROM last JOIN y a USING (segment, year) JOIN y b USING (segment) WHERE a.year = b.year + 1 AND a.n < b.n")
def declining_segments(spark, sf_dir):
    """Segments whose orders fell in their last year against the calendar year before."""
    yearly = scan(spark, sf_dir, "customer").join(scan(spark, sf_dir, "orders"), expr="c_custkey == o_custkey").group_by(
        Schema("k", [("segment", "string"), ("year", "int")]), Schema("a", [("n", "long")]), ["c_mktsegment", "year(o_orderdate)"], [(0, lambda acc, e: acc + 1, lambda x: x)]).frame()
    by_year = Window.partitionBy("segment").orderBy(F.desc("year"))  # a row for each year
    last = yearly.select("segment", "year", "n", F.row_number().over(by_year).alias("place"), F.lead("year").over(by_year).alias("before"), F.lead("n").over(by_year).alias("n_before"))
    return last.where("place = 1 and before = year - 1 and n < n_before").select("segment", F.col("year").alias("last_year"), (F.col("n") - F.col("n_before")).alias("change"))


# ---- operator workload: parts and suppliers


def _supplies(spark, sf_dir) -> Query:
    """Pairs of part and supplier, from the lines, with the quantity and the number of lines of each."""
    key, sums = Schema("k", [("ps_partkey", "long"), ("ps_suppkey", "long")]), Schema("a", [("ps_quantity", "double"), ("ps_lines", "long")])
    return scan(spark, sf_dir, "lineitem").group_by(key, sums, ["l_partkey", "l_suppkey"], [(0.0, lambda acc, e: acc + e.l_quantity, lambda x: x), (0, lambda acc, e: acc + 1, lambda x: x)])


@query("WITH ps AS (SELECT l_partkey, l_suppkey, sum(l_quantity) AS q, count(*) AS n FROM lineitem GROUP BY 1, 2), j AS (SELECT * FROM ps JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey) SELECT p_partkey, s_suppkey, p_name, s_name FROM j WHERE q = 1 UNION ALL SELECT p_partkey, s_suppkey, p_name, s_name FROM j WHERE n > 1")
def supply_union(spark, sf_dir):
    out = columns("p_partkey:long", "s_suppkey:long", "p_name:string", "s_name:string")

    def side(predicate: str) -> Query:
        q = _supplies(spark, sf_dir).where(predicate).join(scan(spark, sf_dir, "supplier"), method="block-nested-loops", expr="ps_suppkey == s_suppkey")
        return q.join(scan(spark, sf_dir, "part"), expr="ps_partkey == p_partkey").select(out)

    return side("ps_quantity == 1").union(side("ps_lines > 1")).frame()


@query("SELECT p_name, count(*)::BIGINT AS n FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag = 'R' GROUP BY p_name")
def returned_by_name(spark, sf_dir):
    q = scan(spark, sf_dir, "lineitem").where("l_returnflag == 'R'").join(scan(spark, sf_dir, "part"), expr="l_partkey == p_partkey")
    return q.group_by(Schema("k", [("p_name", "string")]), Schema("a", [("n", "long")]), lambda e: e.p_name, [(0, lambda acc, e: acc + 1, lambda x: x)]).frame()


PARTS_SQL = "SELECT n_name, p_name, count(*)::BIGINT AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2"


def _parts_by_nation(spark, sf_dir, order: list[str]) -> DataFrame:
    on = {"orders": "l_orderkey == o_orderkey", "part": "l_partkey == p_partkey", "customer": "o_custkey == c_custkey", "nation": "c_nationkey == n_nationkey"}
    q = scan(spark, sf_dir, "lineitem")
    for name in order:
        q = q.join(scan(spark, sf_dir, name), expr=on[name])
    return q.group_by(Schema("k", [("n_name", "string"), ("p_name", "string")]), Schema("a", [("n", "long")]), lambda e: (e.n_name, e.p_name), [(0, lambda acc, e: acc + 1, lambda x: x)]).frame()


@query(PARTS_SQL)
def parts_by_nation_orders_first(spark, sf_dir):
    return _parts_by_nation(spark, sf_dir, ["orders", "part", "customer", "nation"])


@query(PARTS_SQL)
def parts_by_nation_parts_first(spark, sf_dir):
    return _parts_by_nation(spark, sf_dir, ["part", "orders", "customer", "nation"])
