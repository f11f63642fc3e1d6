"""The registered queries over the driver's tables, each beside the SQL that must give the same rows."""

from __future__ import annotations

import operator
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnhelm.catalog import load
from tarnhelm.functions import scalars as S
from tarnhelm.functions import vectors as V
from tarnhelm.operators import relational as R
from tarnhelm.plans.levels import Level
from tarnhelm.plans.policy import KeyRegistry, trace_frame
from tarnhelm.service.server import QueryService
from tarnhelm.session import scratch_path
from tarnhelm.sources.delimited import from_rows, read_delimited
from tarnhelm.sources.sealed import write_sealed
from tarnhelm.workloads import bdb, iterative, tpch

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
#: Only these demonstrations use it; real keys come from the owner.
DEMO_KEY = b"demonstration..!"
C = F.col


def _reg(name: str, sql: str | None = None):
    def keep(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


def _simple(name: str, table: str, f: Callable[[DataFrame], DataFrame], sql: str) -> None:
    _reg(name, sql)(lambda spark, d: f(load(spark, d, table)))


# -- filters -----------------------------------------------------------------------------
for _op, _sql, _v in (("eq", "=", "F"), ("ne", "<>", "F"), ("lt", "<", "O"), ("le", "<=", "O"), ("gt", ">", "F"), ("ge", ">=", "O")):
    _simple(
        f"filter_cmp_{_op}", "orders", lambda df, o=_op, v=_v: R.where(df, getattr(operator, o)(C("o_orderstatus"), v)).select("o_orderkey", "o_orderstatus"),
        f"SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus {_sql} '{_v}'",
    )
_simple(
    "filter_and_or_not", "lineitem",
    lambda df: R.where(df, ((C("l_quantity") > 40) & (C("l_returnflag") == "R")) | ~(C("l_linestatus") == "O")).select("l_orderkey", "l_partkey", "l_quantity", "l_returnflag", "l_linestatus"),
    "SELECT l_orderkey, l_partkey, l_quantity, l_returnflag, l_linestatus FROM lineitem WHERE (l_quantity > 40 AND l_returnflag = 'R') OR NOT (l_linestatus = 'O')",
)
_simple("filter_between", "lineitem", lambda df: df.filter(C("l_quantity").between(2, 4)).select("l_orderkey", "l_quantity"), "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity BETWEEN 2 AND 4")
_simple("filter_contains", "part", lambda df: df.filter(S.contains(C("p_name"), "widget")).select("p_partkey", "p_name"), "SELECT p_partkey, p_name FROM part WHERE contains(p_name, 'widget')")
_simple(
    "filter_is_null", "orders",
    lambda df: df.select("o_orderkey", F.nullif(C("o_orderstatus"), F.lit("F")).alias("st")).filter(C("st").isNull()).select("o_orderkey", C("st").isNull().alias("missing")),
    "SELECT o_orderkey, true AS missing FROM orders WHERE nullif(o_orderstatus, 'F') IS NULL",
)
_simple(
    "filter_is_not_null", "orders",
    lambda df: df.select("o_orderkey", F.nullif(C("o_orderstatus"), F.lit("F")).alias("st")).filter(C("st").isNotNull()),
    "SELECT o_orderkey, nullif(o_orderstatus, 'F') AS st FROM orders WHERE nullif(o_orderstatus, 'F') IS NOT NULL",
)
_simple("scan_table", "nation", lambda df: df, "SELECT * FROM nation")

# -- projections -------------------------------------------------------------------------
_LI = "l_orderkey, l_partkey, l_linenumber"
_li = ("l_orderkey", "l_partkey", "l_linenumber")
_simple("project_arith", "lineitem", lambda df: R.project(df, *_li, F.round(C("l_extendedprice") * (1 - C("l_discount")) + C("l_tax") / 2, 4).alias("x")), f"SELECT {_LI}, round(l_extendedprice * (1 - l_discount) + l_tax / 2, 4) AS x FROM lineitem")
_simple("project_unary_minus", "lineitem", lambda df: df.select(*_li, (-C("l_quantity")).alias("x")), f"SELECT {_LI}, -l_quantity AS x FROM lineitem")
_simple("project_cast_num", "lineitem", lambda df: df.select(*_li, C("l_quantity").cast("int").alias("i"), C("l_linenumber").cast("double").alias("d"), C("l_partkey").cast("string").cast("long").alias("l")), f"SELECT {_LI}, CAST(l_quantity AS INTEGER) AS i, CAST(l_linenumber AS DOUBLE) AS d, CAST(CAST(l_partkey AS VARCHAR) AS BIGINT) AS l FROM lineitem")
_simple("project_cast_str", "orders", lambda df: df.select("o_orderkey", C("o_custkey").cast("string").alias("s"), C("o_orderdate").cast("date").cast("string").alias("d")), "SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS s, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS d FROM orders")
_simple("project_substring", "orders", lambda df: df.select("o_orderkey", S.substring(C("o_orderpriority"), 0, 8).alias("p"), S.substring(C("o_orderpriority"), -3, 2).alias("q")), "SELECT o_orderkey, substring(o_orderpriority, 1, 8) AS p, substring(o_orderpriority, -3, 2) AS q FROM orders")
_simple("project_if", "orders", lambda df: df.select("o_orderkey", S.if_else(F.nullif(C("o_orderstatus"), F.lit("P")) == "F", F.lit("done"), F.lit("open")).alias("x")), "SELECT o_orderkey, CASE WHEN nullif(o_orderstatus, 'P') = 'F' THEN 'done' ELSE 'open' END AS x FROM orders")
_simple("project_year", "orders", lambda df: df.select("o_orderkey", F.year("o_orderdate").alias("y")), "SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS y FROM orders")
_simple("project_exp", "lineitem", lambda df: df.select(*_li, F.round(F.exp(-C("l_discount")), 8).alias("x")), f"SELECT {_LI}, round(exp(-l_discount), 8) AS x FROM lineitem")
_simple("project_array", "lineitem", lambda df: df.select(*_li, F.array_join(F.transform(F.array("l_linenumber", F.lit(7)), lambda x: x.cast("string")), ",").alias("x")), f"SELECT {_LI}, array_to_string([CAST(l_linenumber AS VARCHAR), '7'], ',') AS x FROM lineitem")
_simple("project_divide", "lineitem", lambda df: df.select(*_li, F.round(S.divide(C("l_extendedprice"), C("l_discount")), 4).alias("x")), f"SELECT {_LI}, round(l_extendedprice / nullif(l_discount, 0), 4) AS x FROM lineitem")


# -- joins -------------------------------------------------------------------------------
def _oc(spark, d):
    return load(spark, d, "customer").filter(C("c_acctbal") > 0), load(spark, d, "orders").filter(C("o_totalprice") > 100000)


_C, _O = "(SELECT * FROM customer WHERE c_acctbal > 0)", "(SELECT * FROM orders WHERE o_totalprice > 100000)"
for _how, _sqlhow in (("inner", "JOIN"), ("left", "LEFT JOIN"), ("right", "RIGHT JOIN"), ("full", "FULL JOIN")):

    @_reg(f"join_{_how}", f"SELECT c_custkey, o_orderkey, o_totalprice FROM {_C} c {_sqlhow} {_O} o ON c_custkey = o_custkey")
    def _join(spark, d, how=_how):
        c, o = _oc(spark, d)
        return R.join(c, o, C("c_custkey") == C("o_custkey"), how).select("c_custkey", "o_orderkey", "o_totalprice")


for _how, _not in (("left_semi", ""), ("left_anti", "NOT ")):

    @_reg(f"join_{_how[5:]}", f"SELECT c_custkey, c_name FROM {_C} c WHERE {_not}EXISTS (SELECT 1 FROM {_O} o WHERE o_custkey = c_custkey)")
    def _join2(spark, d, how=_how):
        c, o = _oc(spark, d)
        return R.join(c, o, C("c_custkey") == C("o_custkey"), how).select("c_custkey", "c_name")


@_reg("join_cross", "SELECT n_name, r_name FROM nation CROSS JOIN region")
def _(spark, d):
    return R.join(load(spark, d, "nation"), load(spark, d, "region"), None, "cross").select("n_name", "r_name")


@_reg("join_multi_key", "SELECT s_suppkey, c_custkey FROM supplier JOIN customer ON s_nationkey = c_nationkey AND s_suppkey = c_custkey")
def _(spark, d):
    return R.join(load(spark, d, "supplier"), load(spark, d, "customer"), (C("s_nationkey") == C("c_nationkey")) & (C("s_suppkey") == C("c_custkey"))).select("s_suppkey", "c_custkey")


@_reg("join_residual", "SELECT o_orderkey, l_partkey, l_quantity FROM orders JOIN lineitem ON o_orderkey = l_orderkey AND l_extendedprice > o_totalprice / 4")
def _(spark, d):
    return R.join(load(spark, d, "orders"), load(spark, d, "lineitem"), C("o_orderkey") == C("l_orderkey"), residual=C("l_extendedprice") > C("o_totalprice") / 4).select("o_orderkey", "l_partkey", "l_quantity")


@_reg("join_using", "SELECT n_name, c_custkey FROM nation JOIN customer ON n_nationkey = c_nationkey")
def _(spark, d):
    return R.join(load(spark, d, "nation").withColumnRenamed("n_nationkey", "k"), load(spark, d, "customer").withColumnRenamed("c_nationkey", "k"), "k").select("n_name", "c_custkey")


@_reg("join_self", "SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
def _(spark, d):
    n = load(spark, d, "nation")
    return R.join(n.alias("a"), n.alias("b"), C("a.n_regionkey") == C("b.n_regionkey"), residual=C("a.n_nationkey") < C("b.n_nationkey")).select(C("a.n_name").alias("a"), C("b.n_name").alias("b"))


# -- aggregates --------------------------------------------------------------------------
for _f, _agg, _sql in (
    ("count", lambda: F.count("*"), "count(*)"), ("sum", lambda: F.round(F.sum("l_quantity"), 2), "round(sum(l_quantity), 2)"),
    ("avg", lambda: F.round(F.avg("l_extendedprice"), 4), "round(avg(l_extendedprice), 4)"),
    ("min", lambda: F.min("l_extendedprice"), "min(l_extendedprice)"), ("max", lambda: F.max("l_extendedprice"), "max(l_extendedprice)"),
):
    _simple(f"agg_{_f}", "lineitem", lambda df, a=_agg: R.aggregate(df, ["l_returnflag", "l_linestatus"], a().alias("v")), f"SELECT l_returnflag, l_linestatus, {_sql} AS v FROM lineitem GROUP BY ALL")
_simple("agg_first", "events", lambda df: R.aggregate(df, ["user_id"], F.min_by("event_type", "event_id").alias("v")), "SELECT user_id, arg_min(event_type, event_id) AS v FROM events GROUP BY user_id")
_simple("agg_last", "events", lambda df: R.aggregate(df, ["user_id"], F.max_by("event_type", "event_id").alias("v")), "SELECT user_id, arg_max(event_type, event_id) AS v FROM events GROUP BY user_id")


@_reg("agg_first_any", "SELECT o_orderkey, max(o_custkey) AS f, max(o_orderstatus) AS l, max(CASE WHEN l_linenumber > 1 THEN o_custkey END) AS some FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey")
def _(spark, d):
    """First and last of what an order has in all of its rows, and the first that isn't null."""
    j = R.join(load(spark, d, "orders"), load(spark, d, "lineitem"), C("o_orderkey") == C("l_orderkey"))
    later = F.when(C("l_linenumber") > 1, C("o_custkey"))
    return R.aggregate(j, ["o_orderkey"], F.first("o_custkey").alias("f"), F.last("o_orderstatus").alias("l"), F.first(later, ignorenulls=True).alias("some"))


_simple("agg_global", "lineitem", lambda df: R.aggregate(df, [], F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("q"), F.max("l_shipdate").cast("string").alias("d")), "SELECT count(*) AS n, round(sum(l_quantity), 2) AS q, CAST(max(l_shipdate) AS VARCHAR) AS d FROM lineitem")
_simple("agg_global_empty", "lineitem", lambda df: R.aggregate(df.filter("l_quantity < 0"), [], F.count("*").alias("n"), F.sum("l_quantity").alias("q")), "SELECT count(*) AS n, sum(l_quantity) AS q FROM lineitem WHERE l_quantity < 0")
_simple("agg_having", "lineitem", lambda df: R.aggregate(df, ["l_suppkey"], F.count("*").alias("n"), having=C("n") > 600), "SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) > 600")
_simple("agg_expr", "lineitem", lambda df: R.aggregate(df, ["l_returnflag"], F.round(2 * F.sum("l_quantity") + F.count("*"), 2).alias("v")), "SELECT l_returnflag, round(2 * sum(l_quantity) + count(*), 2) AS v FROM lineitem GROUP BY 1")
_simple("agg_count_distinct", "lineitem", lambda df: R.aggregate(df, ["l_returnflag"], F.countDistinct("l_suppkey").alias("v"), F.count("l_suppkey").alias("n")), "SELECT l_returnflag, count(DISTINCT l_suppkey) AS v, count(l_suppkey) AS n FROM lineitem GROUP BY 1")
_simple("agg_sum_distinct", "lineitem", lambda df: R.aggregate(df, ["l_returnflag"], F.sum_distinct(C("l_linenumber")).alias("v")), "SELECT l_returnflag, CAST(sum(DISTINCT l_linenumber) AS BIGINT) AS v FROM lineitem GROUP BY 1")
_simple("agg_null_group", "orders", lambda df: R.aggregate(df.select(F.nullif(C("o_orderstatus"), F.lit("F")).alias("k"), F.nullif(C("o_orderpriority"), F.lit("1-URGENT")).alias("p")), ["k"], F.count("*").alias("n"), F.count("p").alias("np"), F.max("p").alias("mp")), "SELECT nullif(o_orderstatus, 'F') AS k, count(*) AS n, count(nullif(o_orderpriority, '1-URGENT')) AS np, max(nullif(o_orderpriority, '1-URGENT')) AS mp FROM orders GROUP BY 1")
_simple("agg_by_name", "orders", lambda df: R.aggregate_by_name(df, "o_orderstatus", "o_custkey", "mean").select("o_orderstatus", F.round("mean(o_custkey)", 4).alias("v")), "SELECT o_orderstatus, round(avg(o_custkey), 4) AS v FROM orders GROUP BY 1")
_simple("distinct", "lineitem", lambda df: R.distinct(df.select("l_returnflag", "l_linestatus")), "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")

def _placed(df: DataFrame) -> DataFrame:
    """Where a row stands in the order in which the frame gives its rows (for small results)."""
    return df.withColumn("_at", F.monotonically_increasing_id()).withColumn("pos", F.row_number().over(Window.orderBy("_at"))).drop("_at")


# -- order, limit, sets ------------------------------------------------------------------
_simple("sort_multi", "nation", lambda df: _placed(R.sort(df, C("n_regionkey").desc(), C("n_name").asc())).select("n_name", "pos"), "SELECT n_name, CAST(row_number() OVER (ORDER BY n_regionkey DESC, n_name) AS INTEGER) AS pos FROM nation")
_simple("sort_total", "orders", lambda df: R.sort(df.select("o_orderkey", "o_totalprice"), C("o_totalprice").desc(), C("o_orderkey")), "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey")
_simple("top_k", "orders", lambda df: R.top_k(df, 25, C("o_totalprice").desc(), C("o_orderkey")).select("o_orderkey", "o_totalprice"), "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
_simple("union_all", "orders", lambda df: R.union_all(df.filter("o_orderstatus = 'F'").select("o_orderkey"), df.filter("o_totalprice > 200000").select("o_orderkey")), "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT o_orderkey FROM orders WHERE o_totalprice > 200000")
_simple("union_distinct", "orders", lambda df: R.union_distinct(df.filter("o_orderstatus = 'F'").select("o_orderkey"), df.filter("o_totalprice > 200000").select("o_orderkey")), "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' UNION SELECT o_orderkey FROM orders WHERE o_totalprice > 200000")
_simple("repartition", "orders", lambda df: df.repartition(4, "o_custkey").select("o_orderkey", "o_custkey"), "SELECT o_orderkey, o_custkey FROM orders")


# -- vectors -----------------------------------------------------------------------------
def _vec(spark, d):
    return load(spark, d, "embeddings").select("vec_id", "label", C("embedding").cast("array<double>").alias("v"))


_V = "(SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"


def _text(v, digits=5):
    """A vector as text with a fixed number of digits, so that it compares exactly."""
    return F.array_join(F.transform(v, lambda x: F.round(x * 10**digits, 0).cast("long").cast("string")), ",")


def _sql_text(v: str, digits=5) -> str:
    return f"array_to_string(list_transform({v}, lambda x: CAST(CAST(round(x * 1e{digits}, 0) AS BIGINT) AS VARCHAR)), ',')"


_AXIS = [1.0 if i % 2 else -0.5 for i in range(64)]
_AX = f"CAST([{', '.join(map(str, _AXIS))}] AS DOUBLE[])"


@_reg("vec_dot", f"SELECT vec_id, round(list_sum(list_transform(list_zip(v, {_AX}), lambda p: p[1] * p[2])), 6) AS x FROM {_V}")
def _(spark, d):
    return _vec(spark, d).select("vec_id", F.round(V.dot("v", V.as_vector(_AXIS)), 6).alias("x"))


@_reg("vec_add", f"SELECT vec_id, {_sql_text(f'list_transform(list_zip(v, {_AX}), lambda p: p[1] + p[2])')} AS x FROM {_V}")
def _(spark, d):
    return _vec(spark, d).select("vec_id", _text(V.vector_add("v", V.as_vector(_AXIS))).alias("x"))


@_reg("vec_scale", f"SELECT vec_id, {_sql_text('list_transform(v, lambda y: y * 2.5)')} AS x FROM {_V}")
def _(spark, d):
    return _vec(spark, d).select("vec_id", _text(V.vector_scale("v", 2.5)).alias("x"))


@_reg("vec_sum", f"SELECT label, {_sql_text('list(s ORDER BY i)', 4)} AS x FROM (SELECT label, i, sum(v[i]) AS s FROM {_V}, unnest(range(1, 65)) t(i) GROUP BY ALL) GROUP BY label")
def _(spark, d):
    return V.vector_sum(_vec(spark, d), ["label"], "v", "s", dim=64).select("label", _text(C("s"), 4).alias("x"))


_CENTERS = [[(0.1 if (i + k) % 3 else -0.1) for i in range(64)] for k in range(4)]
_CSQL = " UNION ALL ".join(f"SELECT {k} AS k, CAST([{', '.join(map(str, c))}] AS DOUBLE[]) AS c" for k, c in enumerate(_CENTERS))
_NEAREST = f"SELECT vec_id, v, arg_min(k, struct_pack(a := round(dist, 12), b := k)) AS k FROM (SELECT vec_id, v, k, list_sum(list_transform(list_zip(v, c), lambda p: (p[1] - p[2]) ** 2)) AS dist FROM {_V}, ({_CSQL})) GROUP BY vec_id, v"


@_reg("vec_closest", f"SELECT vec_id, CAST(k AS INTEGER) AS k FROM ({_NEAREST})")
def _(spark, d):
    return _vec(spark, d).select("vec_id", V.closest_index("v", _CENTERS).alias("k"))


@_reg("kmeans_iter", f"SELECT CAST(k AS INTEGER) AS cluster, count(*) AS n, round(sum(v[1]) / count(*), 6) AS c0, round(sum(v[64]) / count(*), 6) AS c63 FROM ({_NEAREST}) GROUP BY k")
def _(spark, d):
    return iterative.kmeans_step(_vec(spark, d), "v", _CENTERS).select("cluster", "n", F.round(C("center")[0], 6).alias("c0"), F.round(C("center")[63], 6).alias("c63"))


_W = f"CAST([{', '.join(['0.1'] * 64)}] AS DOUBLE[])"


@_reg("logreg_grad", f"SELECT round(sum(v[1] * s), 5) AS g0, round(sum(v[64] * s), 5) AS g63 FROM (SELECT v, (1 / (1 + exp(-y * list_sum(list_transform(list_zip(v, {_W}), lambda p: p[1] * p[2])))) - 1) * y AS s FROM (SELECT v, CASE WHEN label < 5 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS y FROM {_V}))")
def _(spark, d):
    pts = _vec(spark, d).select("v", F.when(C("label") < 5, 1.0).otherwise(-1.0).alias("y"))
    return iterative.logistic_gradient(pts, "v", "y", [0.1] * 64).select(F.round(C("gradient")[0], 5).alias("g0"), F.round(C("gradient")[63], 5).alias("g63"))


# -- workloads ---------------------------------------------------------------------------
@_reg("bdb_q1", "SELECT l_partkey, l_quantity FROM lineitem WHERE l_quantity > 10")
def _(spark, d):
    li = load(spark, d, "lineitem").select(C("l_partkey").alias("pageURL"), C("l_quantity").alias("pageRank"))
    return bdb.q1(li, 10).select(C("pageURL").alias("l_partkey"), C("pageRank").alias("l_quantity"))


@_reg("bdb_probe", "SELECT r_name, r_regionkey, CAST(row_number() OVER (ORDER BY r_regionkey DESC) AS INTEGER) AS pos FROM region")
def _(spark, d):
    v = load(spark, d, "region").select((-C("r_regionkey")).alias("adRevenue"), C("r_name").alias("destURL"), C("r_regionkey").alias("sourceIP"))
    return _placed(bdb.probe(v)).select(C("destURL").alias("r_name"), C("sourceIP").alias("r_regionkey"), "pos")


@_reg("bdb_q2", "SELECT substring(o_orderpriority, 1, 8) AS source, round(sum(o_totalprice), 2) AS revenue FROM orders GROUP BY 1")
def _(spark, d):
    o = load(spark, d, "orders").select(C("o_orderpriority").alias("sourceIP"), C("o_totalprice").alias("adRevenue"))
    return bdb.q2(o).select("source", F.round("revenue", 2).alias("revenue"))


@_reg("bdb_q3", "SELECT l_partkey, o_totalprice, l_extendedprice FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_quantity BETWEEN 2 AND 4 ORDER BY o_totalprice")
def bdb_q3(spark, d):
    o = load(spark, d, "orders").select(C("o_orderkey").alias("pageURL"), C("o_totalprice").alias("pageRank"))
    v = load(spark, d, "lineitem").select(C("l_partkey").alias("sourceIP"), C("l_orderkey").alias("destURL"), C("l_extendedprice").alias("adRevenue"), C("l_quantity").alias("duration"))
    return bdb.q3(o, v, 2, 4).select(C("sourceIP").alias("l_partkey"), C("pageRank").alias("o_totalprice"), C("adRevenue").alias("l_extendedprice"))


@_reg("tpch_q9_like", "SELECT n_name AS nation, CAST(year(o_orderdate) AS INTEGER) AS o_year, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_profit FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN orders ON l_orderkey = o_orderkey WHERE contains(p_name, 'widget') GROUP BY 1, 2")
def _(spark, d):
    t = {n: load(spark, d, n) for n in ("part", "supplier", "lineitem", "orders", "nation")}
    return tpch.q9(**t, word="widget").withColumn("sum_profit", F.round("sum_profit", 2))


@_reg("tpch_q9_supply", "WITH ps AS (SELECT l_partkey AS ps_partkey, l_suppkey AS ps_suppkey, max(l_quantity) AS ps_supplycost FROM lineitem GROUP BY 1, 2) SELECT n_name AS nation, CAST(year(o_orderdate) AS INTEGER) AS o_year, round(sum(l_extendedprice * (1 - l_discount) - ps_supplycost * l_quantity), 4) AS sum_profit FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN ps ON ps_partkey = l_partkey AND ps_suppkey = l_suppkey JOIN orders ON l_orderkey = o_orderkey WHERE contains(p_name, 'widget') AND l_quantity > 5 GROUP BY 1, 2")
def _(spark, d):
    t = {n: load(spark, d, n) for n in ("part", "supplier", "lineitem", "orders", "nation")}
    ps = t["lineitem"].groupBy(C("l_partkey").alias("ps_partkey"), C("l_suppkey").alias("ps_suppkey")).agg(F.max("l_quantity").alias("ps_supplycost"))
    return tpch.q9(**t, word="widget", partsupp=ps, min_quantity=5).withColumn("sum_profit", F.round("sum_profit", 4))


@_reg("pagerank_step", "WITH e AS (SELECT DISTINCT l_suppkey AS src, l_partkey AS dst FROM lineitem), g AS (SELECT src, count(*) AS n FROM e GROUP BY 1) SELECT dst AS id, round(0.15 + 0.85 * sum(1.0::DOUBLE / n), 6) AS rank FROM e JOIN g USING (src) GROUP BY 1")
def _(spark, d):
    e = load(spark, d, "lineitem").select(C("l_suppkey").alias("src"), C("l_partkey").alias("dst")).distinct()
    ranks = e.select(C("src").alias("id")).distinct().withColumn("rank", F.lit(1.0))
    return iterative.pagerank_step(e, ranks).withColumn("rank", F.round("rank", 6))


@_reg("least_squares_moments", "SELECT round(sum(l_quantity * l_quantity), 1) AS s11, round(sum(l_quantity * l_discount), 1) AS s12, round(sum(l_discount * l_discount), 1) AS s22, round(sum(l_quantity * l_extendedprice), 0) AS s1y, round(sum(l_discount * l_extendedprice), 0) AS s2y FROM lineitem")
def _(spark, d):
    m = iterative.least_squares_moments(load(spark, d, "lineitem"), "l_quantity", "l_discount", "l_extendedprice")
    return m.select(*[F.round(c, 1).alias(c) for c in ("s11", "s12", "s22")], *[F.round(c, 0).alias(c) for c in ("s1y", "s2y")])


# -- sealed and governed -----------------------------------------------------------------
@_reg("sealed_roundtrip", "SELECT * FROM orders")
def _(spark, d):
    return Level.SEALED.apply_to(load(spark, d, "orders"), "orders", DEMO_KEY)


@_reg("sealed_join", "SELECT n_name, c_custkey, c_acctbal FROM nation JOIN customer ON n_nationkey = c_nationkey")
def _(spark, d):
    n, c = (Level.SEALED.apply_to(load(spark, d, t), t, DEMO_KEY) for t in ("nation", "customer"))
    return R.join(n, c, C("n_nationkey") == C("c_nationkey")).select("n_name", "c_custkey", "c_acctbal")


@_reg("governed_agg", "SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_totalprice > 1000 GROUP BY 1")
def _(spark, d):
    registry = KeyRegistry(DEMO_KEY)
    policy = registry.open(registry.grant("reader", 1, 20))
    return policy.apply(load(spark, d, "orders")).filter("o_totalprice > 1000").aggregate(["o_orderstatus"], F.count("*").alias("n")).prepare_result()[0]


@_reg("cache_reuse", "SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY 1")
def _(spark, d):
    return R.aggregate(R.persist(load(spark, d, "customer")), ["c_mktsegment"], F.count("*").alias("n"))


@_reg("trace_edges", "SELECT * FROM (VALUES (0, 'scan', NULL::INTEGER, NULL::INTEGER), (1, 'scan', NULL, NULL), (2, 'filter', 1, NULL), (3, 'join', 0, 2), (4, 'project', 3, NULL), (5, 'result', 4, NULL)) t(node, op, left_input, right_input)")
def _(spark, d):
    registry = KeyRegistry(DEMO_KEY)
    policy = registry.open(registry.grant("reader", 1, 20))
    n, c = policy.apply(load(spark, d, "nation")), policy.apply(load(spark, d, "customer"))
    out = n.join(c.filter("c_acctbal > 0"), C("n_nationkey") == C("c_nationkey")).select("n_name")
    return trace_frame(spark, out.sort("n_name").prepare_result()[1])


@_reg("read_pipe", "SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders")
def _(spark, d):
    o = load(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    at = scratch_path(spark, "pipe")
    o.write.option("sep", "|").csv(at)
    return read_delimited(spark, at, o.schema, "|")


@_reg("rows_in_memory", "SELECT * FROM (VALUES (1, 'a'), (2, NULL), (NULL, 'c')) t(k, s)")
def _(spark, d):
    return from_rows(spark, [(1, "a"), (2, None), (None, "c")], T.StructType.fromDDL("k int, s string"), partitions=2)


# -- the service's endpoints, by their frames (whole results stay distributed) ---------------
def _service(spark, d, path, **params):
    registry = KeyRegistry(DEMO_KEY)
    tables = {t: write_sealed(load(spark, d, t), scratch_path(spark, f"sealed-{t}"), DEMO_KEY, t) for t in ("nation", "customer")}
    return QueryService(spark, registry, tables).frame(path, params | {"tk": registry.grant("reader", 1, 20)})


for _name, _path, _params, _sql in (
    ("filter", "/filter", {"t": "customer", "st": "c_acctbal > 5000 AND c_mktsegment IS NOT NULL"}, "SELECT * FROM customer WHERE c_acctbal > 5000 AND c_mktsegment IS NOT NULL"),
    ("selector", "/selector", {"t": "customer", "st": "c_custkey, c_name"}, "SELECT c_custkey, c_name FROM customer"),
    ("joiner", "/joiner", {"t1": "customer", "t2": "customer", "st": "c_custkey", "mode": "left_semi"}, "SELECT * FROM customer"),
    ("aggregator", "/aggregator", {"t": "customer", "group_col": "c_mktsegment", "agg_col": "c_custkey", "func": "max"}, 'SELECT c_mktsegment, max(c_custkey) AS "max(c_custkey)" FROM customer GROUP BY 1'),
    ("query", "/query", {"st": "WITH n AS (SELECT n_nationkey AS k, n_name FROM nation) SELECT n_name, count(*) AS m FROM customer JOIN n ON c_nationkey = k GROUP BY n_name"}, "SELECT n_name, count(*) AS m FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name"),
):
    _reg(f"endpoint_{_name}", _sql)(lambda spark, d, path=_path, params=_params: _service(spark, d, path, **params).prepare_result()[0])


@_reg("endpoint_sorter", "SELECT n_name, CAST(row_number() OVER (ORDER BY n_name DESC) AS INTEGER) AS pos FROM nation")
def _(spark, d):
    return _placed(_service(spark, d, "/sorter", t="nation", st="n_name", asc="False").prepare_result()[0]).select("n_name", "pos")


@_reg("trace_sql", "SELECT * FROM (VALUES (0, 'scan', NULL::INTEGER, NULL::INTEGER), (1, 'scan', NULL, NULL), (2, 'join', 0, 1), (3, 'filter', 2, NULL), (4, 'project', 3, NULL), (5, 'result', 4, NULL)) t(node, op, left_input, right_input)")
def _(spark, d):
    frame = _service(spark, d, "/query", st="SELECT a.n_name FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey WHERE a.n_nationkey < b.n_nationkey")
    return trace_frame(spark, frame.prepare_result()[1])
