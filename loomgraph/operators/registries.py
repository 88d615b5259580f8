"""Registries a user extends: evaluators, regulations and retrieval modes (run by ``operators.retrieval.answer``); and the guard for SQL that comes from outside."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Evaluator = Callable[[DataFrame], DataFrame]


class Evaluators:
    """Named functions from designs to designs with metric columns; an unknown name gives the first one registered."""

    def __init__(self, default: str, fn: Evaluator):
        self._default, self._known = default, {default: fn}

    def register(self, name: str, fn: Evaluator) -> None:
        self._known[name] = fn

    def get(self, name: str | None = None) -> Evaluator:
        return self._known.get(name or self._default, self._known[self._default])

    def names(self) -> list[str]:
        return sorted(self._known)


@dataclass(frozen=True)
class Regulation:
    """``applies`` and ``found`` are SQL predicates over a row of calculated limits."""

    key: str
    applies: str = "true"
    reason: str = ""
    found: str = "true"
    missing: str = ""


def regulation_status(rows: DataFrame, specs: list[Regulation], *keys: str) -> DataFrame:
    """A row per input row and regulation: the keys, ``regulation, status, note``; status is ``applies``, ``not_applicable`` or ``not_found``. A null predicate counts as false."""

    def told(s: Regulation) -> Column:
        on, seen = F.coalesce(F.expr(s.applies), F.lit(False)), F.coalesce(F.expr(s.found), F.lit(False))
        return F.struct(
            F.lit(s.key).alias("regulation"),
            F.when(~on, "not_applicable").when(~seen, "not_found").otherwise("applies").alias("status"),
            F.when(~on, s.reason).when(~seen, s.missing).otherwise("").alias("note"),
        )

    return rows.select(*keys, F.inline(F.array(*map(told, specs))))


@dataclass(frozen=True)
class Mode:
    """How a question is answered: what is searched, by which indexes, and whether hits may be limited to documents."""

    search: str
    top_k: int
    index: str
    keyword_index: str | None = None
    document_filter: bool = False
    nodes: str = "Chunk"
    text: tuple[str, ...] = ("text",)


# The retrieval modes by name; `graph` asks the graph alone and has no index.
MODES = {
    "vector": Mode("vector", 5, "vector", document_filter=True),
    "fulltext": Mode("vector", 5, "vector", "keyword"),
    "entity_vector": Mode("local_community", 10, "entity_vector", nodes="Entity", text=("id",)),
    "graph_vector": Mode("graph_vector", 5, "vector", document_filter=True),
    "graph_vector_fulltext": Mode("graph_vector", 5, "vector", "keyword"),
    "global_vector": Mode("global", 10, "community_vector", "community_keyword", nodes="Community", text=("summary",)),
    "graph": Mode("graph", 0, ""),
}
DEFAULT_MODE = "graph_vector_fulltext"

def mode(name: str | None) -> Mode:
    return MODES.get(name or DEFAULT_MODE, MODES[DEFAULT_MODE])


# Nodes that a parsed question may have, and the functions it may call.
PLAN_NODES = frozenset(
    "Project Filter Aggregate Sort GlobalLimit LocalLimit Offset Distinct Join SubqueryAlias UnresolvedSubqueryColumnAliases UnresolvedRelation UnresolvedWith UnresolvedHaving Union Except Intersect OneRowRelation UnresolvedInlineTable WithWindowDefinition Tail".split()
)
FUNCTIONS = frozenset(
    """abs array array_contains array_distinct array_join avg between cast ceil ceiling coalesce collect_list collect_set concat concat_ws contains count count_if date date_format date_trunc datediff day
    dense_rank element_at endswith explode first floor greatest hour if ifnull in instr isnotnull isnull lag last lead least left length like ln locate log lower lpad ltrim max max_by mean median min min_by
    minute mod month nullif nvl percentile percentile_approx position power quarter rank regexp_extract regexp_like regexp_replace replace right rlike round row_number rpad rtrim second size sort_array split
    sqrt startswith std stddev substr substring sum to_date to_timestamp trim upper variance weekofyear when year""".split()
)
MARKED = frozenset("UnresolvedGenerator UnresolvedTableValuedFunction UnresolvedTVFAliases ScriptTransformation CallFunction UnresolvedTableSpec".split())


def _seq(items) -> list:
    return [items.apply(i) for i in range(items.size())]


def _check_plan(plan, tables: frozenset[str], named: frozenset[str]) -> None:
    """Refuses whatever isn't known to read only; ``named`` are the names of common tables in scope."""
    kind = plan.getClass().getSimpleName()
    if kind not in PLAN_NODES:
        raise ValueError(f"not allowed here: {kind}")
    if kind == "UnresolvedRelation":
        name = _seq(plan.multipartIdentifier())
        if len(name) != 1 or name[0].lower() not in tables | named:
            raise ValueError(f"unknown table: {'.'.join(name)}")
    if kind == "UnresolvedWith":
        for pair in _seq(plan.cteRelations()):
            _check_plan(pair._2().child(), tables, named)
            named = named | {pair._1().lower()}
    for x in _seq(plan.expressions()):
        _check_expression(x, tables, named)
    for child in _seq(plan.children()):
        _check_plan(child, tables, named)


def _check_expression(x, tables: frozenset[str], named: frozenset[str]) -> None:
    kind = x.getClass().getSimpleName()
    if kind in MARKED:
        raise ValueError(f"not allowed here: {kind}")
    if kind == "UnresolvedFunction":
        name = ".".join(_seq(x.nameParts())).lower()
        if name not in FUNCTIONS:
            raise ValueError(f"function not allowed: {name}")
    if kind == "InSubquery":
        _check_expression(x.query(), tables, named)
    elif kind in ("ScalarSubquery", "Exists", "ListQuery"):
        _check_plan(x.plan(), tables, named)
    elif "Subquery" in kind:
        raise ValueError(f"not allowed here: {kind}")
    for child in _seq(x.children()):
        _check_expression(child, tables, named)


def read_only(spark: SparkSession, sql: str, tables: tuple[str, ...] | None = None) -> DataFrame:
    """Run one question over named views; anything else is refused before it runs.

    Spark's parser reads the text, and of its tree only known node kinds, the
    functions in ``FUNCTIONS`` and the tables of ``tables`` (by default the
    session's temporary views) may take part: no commands, no files by path, no
    reflection, no table functions.
    """
    known = frozenset(t.lower() for t in (tables if tables is not None else [t.name for t in spark.catalog.listTables() if t.isTemporary]))
    text = re.sub(r"[;\s]+\Z", "", sql or "")
    if not text:
        raise ValueError("a SELECT statement is needed")
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(text)
    except Exception as e:
        raise ValueError(f"only one SELECT statement is allowed: {str(e)[:200]}") from None
    _check_plan(plan, known, frozenset())
    return spark.sql(text)
