"""Typed export, layer tables, inventories and digests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from starloom.operators.joins import fail_when
from starloom.operators.reconcile import ResultContract, row_faults

def typed_export(df: DataFrame, contract: ResultContract, row_cap: int | None = None) -> DataFrame:
    """Result set in export form: contract column order, ISO dates, decimals as text.

    Broken types, nulls and keys stop the job that reads the result, in its own
    plan; nothing is run to build it. A result above ``row_cap``, if one is given,
    stops it too; it is never cut.
    """
    bad = row_faults(df, contract)
    checked = df.where(fail_when(F.size(F.array_compact(F.array(*[F.when(test, F.lit(rule)) for rule, test in bad.items()]))) > 0, "contract broken: type or null"))
    per_key = W.partitionBy(*contract.keys)
    checked = checked.withColumn("_n", F.count("*").over(per_key)).where(fail_when(F.col("_n") > 1, "contract broken: duplicate_grain"))
    if row_cap is not None:
        size = df.limit(row_cap + 1).agg(F.count("*").alias("n"))
        checked = checked.where(fail_when(size.scalar() > row_cap, f"more than {row_cap} rows"))
    types = {"integer": "decimal(38,0)", "boolean": "boolean", "number": "double"}

    def out(name: str, kind: str):
        c = F.col(name)
        return c.cast(types[kind]).cast("long") if kind == "integer" else c.cast(types.get(kind, "string"))

    return checked.select(*[out(n, r.type).alias(n) for n, r in contract.columns.items()])


def write_layer(df: DataFrame, path: str, *, partition_by: Sequence[str] = ()) -> DataFrame:
    """Create-or-replace a layer table and read it back with its own plan."""
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return df.sparkSession.read.parquet(path)


def _flatten(schema: T.StructType, prefix: tuple[str, ...] = ()):
    for field in schema:
        path = (*prefix, field.name)
        yield path, field
        inner = field.dataType
        while isinstance(inner, T.ArrayType):
            inner = inner.elementType
        if isinstance(inner, T.StructType):
            yield from _flatten(inner, path)


def catalog_inventory(tables: dict[str, DataFrame]) -> DataFrame:
    """Relation, column path, ordinal, type and observed nulls of every column, one scan per table."""
    out = None
    for relation, df in tables.items():
        fields = list(_flatten(df.schema))
        counts = df.agg(F.count("*").alias("_rows"), *[
            F.count_if(F.col(".".join(f"`{p}`" for p in path)).isNull()).alias(f"_n{i}") for i, (path, _) in enumerate(fields)
        ])
        entries = F.array(*[
            F.struct(
                F.lit(".".join(path)).alias("column_path"), F.lit(i + 1).alias("ordinal"),
                F.lit(field.dataType.simpleString()).alias("data_type"), F.col(f"_n{i}").alias("n_nulls"),
            ) for i, (path, field) in enumerate(fields)
        ])
        rows = counts.select(F.lit(relation).alias("relation"), F.col("_rows").alias("n_rows"), F.explode(entries).alias("_c"))
        rows = rows.select("relation", "_c.*", "n_rows")
        out = rows if out is None else out.unionByName(rows)
    return out


def session_catalog(spark: SparkSession, database: str) -> list[tuple[str, str, str, bool]]:
    """(table, column, type, nullable) of one catalog database; metadata only."""
    return [
        (t.name, c.name, c.dataType, c.nullable)
        for t in spark.catalog.listTables(database) for c in spark.catalog.listColumns(t.name, database)
    ]


def dataset_digest(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Row count and order-free content digest; partial sums combine map-side.

    A cell is written with its length, a null with a mark of its own, so rows of
    different cells are different texts. The eight 32-bit words of each row's
    SHA-256 are summed one by one; their sums are the digest.
    """
    def cell(c: str):
        text = F.col(c).cast("string")
        return F.coalesce(F.concat(F.lit("V"), F.length(text).cast("string"), F.lit(":"), text), F.lit("N"))

    row = F.sha2(F.concat(*[cell(c) for c in columns]), 256)
    hashed = df.select(row.alias("_h"))
    words = [F.sum(F.conv(F.substring("_h", 8 * k + 1, 8), 16, 10).cast("decimal(20,0)")).cast("string") for k in range(8)]
    return hashed.agg(F.count("*").alias("n_rows"), F.concat_ws(":", *words).alias("digest"))
