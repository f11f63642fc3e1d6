"""What a SQL text may do before it runs, and which operators its analyzed plan has.

``check`` reads the parsed plan: only queries pass, over table names the caller knows, and
without functions that reach outside the query.  ``record`` walks the analyzed plan from the
leaves up, so that every operator is charged once and keeps all of its inputs in the trace.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession

#: Functions that call Java, read files or reveal where a query runs.
FORBIDDEN = {"reflect", "java_method", "try_reflect", "input_file_name", "input_file_block_start", "input_file_block_length"}
#: Nodes of a parsed query; commands and anything unknown are refused.
QUERY_NODES = {
    "Aggregate", "CTERelationRef", "Deduplicate", "Distinct", "Except", "Filter", "Generate", "GlobalLimit", "Intersect", "Join", "LateralJoin",
    "LocalLimit", "LocalRelation", "Offset", "OneRowRelation", "Pivot", "Project", "Sort", "SubqueryAlias", "Union", "UnresolvedHaving",
    "UnresolvedInlineTable", "UnresolvedRelation", "UnresolvedSubqueryColumnAliases", "UnresolvedWith", "Unpivot", "Window", "WithWindowDefinition",
}
CHARGED = {"Filter": "filter", "Project": "project", "Aggregate": "aggregate", "Distinct": "aggregate", "Join": "join", "LateralJoin": "join"}
_SUBQUERIES = ("ScalarSubquery", "ListQuery", "Exists", "LateralSubquery")


class QueryRefused(ValueError):
    """The text is no query, or does something that queries may not."""


def _seq(x) -> list:
    return [x.apply(i) for i in range(x.length())]


def _kind(x) -> str:
    return x.getClass().getSimpleName()


def _expressions(node) -> Iterator:
    todo = _seq(node.expressions())
    while todo:
        e = todo.pop()
        yield e
        todo += _seq(e.children())


def _subplans(node) -> list:
    return [e.plan() for e in _expressions(node) if _kind(e) in _SUBQUERIES]


def check(spark: SparkSession, sql: str) -> set[str]:
    """The tables that a query reads, in lower case; raises for anything but a query.

    A name is a table where no WITH clause around it, or before it in the same clause, has defined it.
    """
    parsed = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    tables: set[str] = set()

    def walk(node, scope: frozenset[str]) -> None:
        kind = _kind(node)
        if kind not in QUERY_NODES:
            raise QueryRefused(f"only queries are allowed, not {kind}")
        if kind == "UnresolvedWith":
            for pair in _seq(node.cteRelations()):
                walk(pair._2(), scope)
                scope = scope | {pair._1().lower()}
        if kind == "UnresolvedRelation":
            name = ".".join(_seq(node.multipartIdentifier())).lower()
            if name not in scope:
                tables.add(name)
        for e in _expressions(node):
            if _kind(e) == "UnresolvedFunction" and _seq(e.nameParts())[-1].lower() in FORBIDDEN:
                raise QueryRefused(f"function {_seq(e.nameParts())[-1]} is not allowed")
            if _kind(e) in _SUBQUERIES:
                walk(e.plan(), scope)
        for child in _seq(node.children()):
            walk(child, scope)

    walk(parsed, frozenset())
    return tables


def record(df: DataFrame, add: Callable[..., int], charge: Callable[..., int]) -> int:
    """Walk the analyzed plan; ``add(op, *inputs)`` notes free nodes and ``charge`` the others.  Returns the root's node.

    A view is one scan wherever it is read, whatever its own plan holds; a WITH definition is
    walked once; a subquery in an expression is a further input of its operator.
    """
    known: dict[int, int] = {}

    def walk(node) -> int:
        kind = _kind(node)
        if kind == "WithCTE":
            for d in _seq(node.cteDefs()):
                known[d.id()] = walk(d.child())
            return walk(node.plan())
        if kind == "CTERelationRef":
            return known[node.cteId()]
        if kind == "View":
            return add("scan")
        inputs = [walk(x) for x in [*_seq(node.children()), *_subplans(node)]]
        if kind in CHARGED:
            return charge(CHARGED[kind], *inputs)
        if len(inputs) > 1:
            return add("union", *inputs)
        return inputs[0] if inputs else add("scan")

    return walk(df._jdf.queryExecution().analyzed())
