"""Registration of queries and of the SQL they are checked against."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
# Named sub-queries shared by the SQL texts, in dependency order.
CTES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query builder, with its SQL where SQL can express it."""

    def wrap(fn):
        if name in QUERIES:
            raise ValueError(f"{name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = with_ctes(sql)
        return fn

    return wrap


def with_ctes(body: str) -> str:
    """Prefix the SQL with the named sub-queries it refers to."""
    needed: set[str] = set()

    def visit(text: str) -> None:
        for name in CTES:
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                visit(CTES[name])

    visit(body)
    if not needed:
        return body.strip()
    parts = [f"{name} AS ({CTES[name].strip()})" for name in CTES if name in needed]
    text = body.strip()
    if re.match(r"(?i)with\s+recursive\b", text):
        return "WITH RECURSIVE " + ",\n".join(parts) + ",\n" + re.sub(r"(?i)^with\s+recursive\s+", "", text)
    if re.match(r"(?i)with\b", text):
        return "WITH " + ",\n".join(parts) + ",\n" + re.sub(r"(?i)^with\s+", "", text)
    return "WITH " + ",\n".join(parts) + "\n" + text


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt_out(df: DataFrame, rows: int = 2**16) -> DataFrame:
    """The rows in parts of some ``rows`` each, for a scan that fans them out.

    A scan's task holds a whole row group; what it fans out to and groups would grow with
    that. A table of one part is left as it is. The rows are counted while the query is built.
    """
    parts = -(-df.count() // rows)
    return df.repartition(parts, *df.columns) if parts > 1 else df
