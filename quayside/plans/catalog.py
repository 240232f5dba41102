"""Every query by name, with the SQL that gives the same rows."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession

from ._tables import dealt, table
from .given import GIVEN

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        if name in _queries:
            raise ValueError(f"two queries are called {name}")
        _queries[name] = f
        if sql is not None:
            _sql[name] = sql
        return f

    return add


def literal(v) -> str:
    return "NULL" if v is None else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v).upper() if isinstance(v, bool) else repr(v)


KINDS = {"string": "VARCHAR", "int": "INTEGER", "long": "BIGINT", "double": "DOUBLE", "boolean": "BOOLEAN"}


def values(schema: str, rows: list[tuple]) -> str:
    """Stated rows as a subquery."""
    columns = [c.strip().split(" ") for c in schema.split(",")]
    typed = ", ".join(f"CAST({n} AS {KINDS[k]}) AS {n}" for n, k in columns)
    return f"(SELECT {typed} FROM (VALUES {', '.join('(' + ', '.join(map(literal, r)) + ')' for r in rows)}) AS t({', '.join(n for n, _ in columns)}))"


@dataclass(frozen=True)
class Rule:
    """A rule: its input columns, stated cases for the tests, the columns that it makes, and the SQL of each."""

    doc: str
    schema: str
    rows: list[tuple]
    made: dict[str, Callable[[], Column]]
    sql: dict[str, str]

    def over_cases(self, spark: SparkSession) -> DataFrame:
        names = [c.strip().split(" ")[0] for c in self.schema.split(",")]
        return spark.createDataFrame(self.rows, self.schema).select(*names, *[f().alias(k) for k, f in self.made.items()])

    def cases_sql(self) -> str:
        names = [c.strip().split(" ")[0] for c in self.schema.split(",")]
        return f"WITH v AS {values(self.schema, self.rows)} SELECT {', '.join([*names, *[f'{e} AS {k}' for k, e in self.sql.items()]])} FROM v"


rules: dict[str, Rule] = {}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def given(spark: SparkSession, d: str, sql: str, costly: bool = False) -> DataFrame:
    """Rows that SQL makes of the given tables."""
    used = [t for t in TABLES if re.search(rf"\b{t}\b", sql)]
    for t in used:
        rows = table(spark, d, t)
        (dealt(rows) if costly else rows).createOrReplaceTempView(t)
    try:
        return spark.sql(sql)
    finally:
        for t in used:
            spark.catalog.dropTempView(t)


def rule(name: str, doc: str, schema: str, rows: list[tuple], made: dict[str, Callable[[], Column]], sql: dict[str, str], costly: bool = False) -> None:
    """A rule. Its stated cases are tests; the query applies it to values made of a whole table, where there are such (plans/given.py). Rows of a costly one are dealt over all cores first."""
    rules[name] = Rule(doc, schema, rows, made, sql)
    over = GIVEN.get(name) or GIVEN.get(schema)
    if over is None:
        return

    def query(spark: SparkSession, d: str) -> DataFrame:
        return given(spark, d, over, costly).select("k", *[f().alias(k) for k, f in made.items()])

    query.__name__, query.__doc__ = name, doc
    register(name, f"WITH v AS ({over}) SELECT k, {', '.join(f'{e} AS {k}' for k, e in sql.items())} FROM v")(query)


def queries() -> dict[str, Query]:
    return _queries


def oracle_sql() -> dict[str, str]:
    return _sql
