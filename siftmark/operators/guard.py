"""Read-only SQL over named frames: checked as a parsed plan, bounded in rows and time, with rights by table, row and column."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from .match import masked as masked_value

#: Nodes of a parsed SELECT; others, such as commands, writes and table functions, are refused.
NODES = {
    "Project", "Aggregate", "Filter", "Sort", "GlobalLimit", "LocalLimit", "Offset", "Distinct", "Join", "Union", "SetOperation", "Except", "Intersect", "SubqueryAlias", "UnresolvedRelation",
    "UnresolvedHaving", "UnresolvedWith", "UnresolvedInlineTable", "UnresolvedSubqueryColumnAliases", "OneRowRelation", "WithWindowDefinition", "UnresolvedHint", "LateralJoin", "Generate",
}
#: Built-in functions that reach beyond the rows given.
CALLS = {"reflect", "java_method", "try_reflect", "input_file_name", "input_file_block_start", "input_file_block_length", "raise_error", "assert_true", "version", "current_user", "user", "session_user", "current_catalog", "current_database", "current_schema"}


class Forbidden(ValueError):
    """SQL that may not run."""


class TooSlow(RuntimeError):
    """SQL that was stopped at its time limit."""


def items(seq) -> Iterator:
    for i in range(seq.size()):
        yield seq.apply(i)


class Check:
    """Walks a parsed plan; names of common tables hold in their scope only."""

    def __init__(self, spark: SparkSession, tables: set[str]):
        self.tables, self.used = tables, set()
        self.builtin = {r[0].lower() for r in spark.sql("SHOW SYSTEM FUNCTIONS").collect()}

    def plan(self, node, scope: frozenset[str] = frozenset()) -> None:
        kind = node.getClass().getSimpleName()
        if kind not in NODES:
            raise Forbidden(f"{kind} is not allowed")
        if kind == "UnresolvedWith":
            if node.allowRecursion():
                raise Forbidden("a recursive table is not allowed")
            for named in items(node.cteRelations()):  # each sees those before it
                self.plan(named._2(), scope)
                scope = scope | {named._1().lower()}
            self.plan(node.child(), scope)
            return
        if kind == "UnresolvedRelation":
            parts = [x.lower() for x in items(node.multipartIdentifier())]
            if len(parts) > 1 or parts[0] not in self.tables | scope:
                raise Forbidden(f"no table {'.'.join(parts)}")
            if parts[0] not in scope:
                self.used.add(parts[0])
        for e in items(node.expressions()):
            self.expression(e, scope)
        for child in items(node.children()):
            self.plan(child, scope)

    def expression(self, e, scope: frozenset[str]) -> None:
        kind = e.getClass().getSimpleName()
        if kind == "UnresolvedFunction":
            parts = [x.lower() for x in items(e.nameParts())]
            if len(parts) > 1 or parts[0] in CALLS or parts[0] not in self.builtin:
                raise Forbidden(f"function {'.'.join(parts)}")
        elif "plan" in {m.getName() for m in e.getClass().getMethods()}:  # a subquery
            self.plan(e.plan(), scope)
        for child in items(e.children()):
            self.expression(child, scope)


def guarded(spark: SparkSession, sql: str, tables: dict[str, DataFrame], limit: int = 1000, masked: tuple[str, ...] = (), where: dict[str, str] | None = None, columns: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """The rows of one SELECT over `tables` only, at most `limit`.

    where: a condition by table, the range of rows that the caller may see; columns: by table, the columns that the caller may
    see, all where a table is not named. Both hold for the table itself, so no query gets round them. Of `masked` columns
    only the first and last character of longer values are shown. Tables of the session, and its views of any name, are neither
    seen nor touched: each table is a common table of the query, over a view of a name of its own that goes again.
    """
    parser = spark._jsparkSession.sessionState().sqlParser()
    names = {t.lower(): t for t in tables}
    check = Check(spark, set(names))
    check.plan(parser.parsePlan(sql))
    low, views = {c.lower() for c in masked}, {}
    for key in sorted(check.used):
        name = names[key]
        df = tables[name]
        rows = df.where(where[name]) if where and name in where else df
        rights = None if columns is None or name not in columns else {c.lower() for c in columns[name]}
        of = lambda c: F.col("`" + c.replace("`", "``") + "`")
        shown = [masked_value(of(c)).alias(c) if c.lower() in low else of(c) for c in df.columns if rights is None or c.lower() in rights]
        views[name] = f"guarded_{uuid.uuid4().hex}"
        rows.select(*shown).createOrReplaceTempView(views[name])
    try:
        quoted = lambda n: "`" + n.replace("`", "``") + "`"
        common = ", ".join(f"{quoted(n)} AS (SELECT * FROM {v})" for n, v in views.items())
        return spark.sql(f"WITH {common} SELECT * FROM (\n{sql.strip().rstrip(';')}\n)" if views else sql).limit(limit)
    finally:
        for v in views.values():
            spark.catalog.dropTempView(v)


def answered(spark: SparkSession, sql: str, tables: dict[str, DataFrame], seconds: float = 30, **rights) -> list[Row]:
    """The rows of guarded(), computed within a time; TooSlow if they are not. Only this query's jobs are stopped."""
    df = guarded(spark, sql, tables, **rights)
    context, tag, over = spark.sparkContext, f"guarded-{uuid.uuid4().hex}", threading.Event()

    def stop() -> None:
        over.set()
        context.cancelJobsWithTag(tag)

    timer = threading.Timer(seconds, stop)
    context.addJobTag(tag)
    context.setInterruptOnCancel(True)
    timer.start()
    try:
        return df.collect()  # at most `limit` rows
    except Exception as e:
        if over.is_set():
            raise TooSlow(f"stopped after {seconds} s") from e
        raise
    finally:
        timer.cancel()
        context.removeJobTag(tag)
        context.setInterruptOnCancel(False)
