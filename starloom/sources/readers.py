"""Strict readers: explicit schemas, exact column sets, no type guessing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CORRUPT = "_corrupt_record"


class ContractError(ValueError):
    """Input that does not fit its declared shape."""


def read_raw(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet") -> DataFrame:
    """Load rows; a missing or extra column, or no row at all, is an error."""
    expected = sorted(schema.fieldNames())
    if fmt == "json":
        keys = F.array_sort(F.json_object_keys("value"))
        other = F.coalesce(keys != F.array(*[F.lit(c) for c in expected]), F.lit(True))
        if not spark.read.text(path).where(other).isEmpty():
            raise ContractError("a row differs from the declared column set")
        df = spark.read.schema(schema).json(path)
    else:
        found = spark.read.format(fmt).load(path)
        if sorted(found.columns) != expected:
            raise ContractError(f"columns {sorted(set(found.columns) ^ set(expected))} differ from the declared set")
        df = found.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])
    if df.isEmpty():
        raise ContractError("no rows")
    return df


def _text_schema(names: Sequence[str]) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in [*names, CORRUPT]])


def csv_header(spark: SparkSession, path: str) -> list[str]:
    """Header fields of the file set (one line reaches the driver)."""
    first = spark.read.option("header", False).option("escape", '"').csv(path).limit(1).collect()
    if not first:
        raise ContractError("header required")
    return [v or "" for v in first[0]]


def _csv(spark: SparkSession, path: str, names: Sequence[str], multi_line: bool = False, check_headers: bool = True) -> DataFrame:
    """Quotes inside a field are doubled. ``multi_line`` allows line breaks inside
    quoted fields, at the price of reading each file in one task. A file whose header
    differs from ``names`` stops the read, unless ``check_headers`` is off."""
    reader = spark.read.schema(_text_schema(names)).option("header", True).option("enforceSchema", not check_headers)
    reader = reader.option("escape", '"').option("multiLine", multi_line)
    return reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).csv(path)


def read_csv_text(spark: SparkSession, path: str, *, multi_line: bool = False) -> DataFrame:
    """All columns as text; the header is required. Ragged rows keep their raw
    line in ``_corrupt_record``. A UTF-8 byte-order mark is dropped by the line reader."""
    names = csv_header(spark, path)
    if len({n.strip().lower() for n in names}) != len(names) or "" in [n.strip() for n in names]:
        raise ContractError("header fields have to be named and distinct")
    return _csv(spark, path, names, multi_line)


def csv_profile(spark: SparkSession, path: str, max_field: int = 131_072) -> DataFrame:
    """Rows, ragged rows, oversized fields, duplicate and case-colliding headers."""
    names = csv_header(spark, path)
    cols = [f"_c{i}" for i in range(len(names))]
    exact = len(names) - len(set(names))
    folded = len(names) - len({n.strip().lower() for n in names}) - exact
    big = [F.sum(F.when(F.length(c) > max_field, 1).otherwise(0)) for c in cols]
    total = big[0]
    for b in big[1:]:
        total = total + b
    return _csv(spark, path, cols, check_headers=False).agg(
        F.count("*").alias("row_count"),
        F.count_if(F.col(CORRUPT).isNotNull()).alias("ragged_rows"),
        F.coalesce(total, F.lit(0)).alias("oversized_fields"),
    ).select("*", F.lit(exact).alias("duplicate_headers"), F.lit(folded).alias("case_collisions"))


def read_seed_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Typed CSV with declared columns; a bad cell or another header stops the read."""
    if csv_header(spark, path) != schema.fieldNames():
        raise ContractError("header differs from the declared columns")
    return spark.read.schema(schema).option("header", True).option("enforceSchema", False).option("mode", "FAILFAST").csv(path)


def read_registry_csv(
    spark: SparkSession, path: str, *, json_columns: Sequence[str] = (), attribute: str | None = None,
    values: Sequence[str] | None = None, required: str | None = None,
) -> DataFrame:
    """Inventory CSV: JSON-array cells become arrays, rows keep wanted attribute values only."""
    df = read_csv_text(spark, path)
    if required is not None:
        if required not in df.columns:
            raise ContractError(f"missing column {required}")
        df = df.where(F.trim(F.col(required)) != "")
    if attribute is not None and values is not None:
        df = df.where(F.upper(F.trim(F.col(attribute))).isin([v.strip().upper() for v in values]))
    return df.withColumns({c: F.from_json(c, "array<string>") for c in json_columns}).drop(CORRUPT)


def read_metadata(
    spark: SparkSession, path: str, allowed: Sequence[str], required: Sequence[str], key: Sequence[str]
) -> DataFrame:
    """Allow-listed columns only (pruned at the scan); required values and key uniqueness checked."""
    found = spark.read.parquet(path)
    missing = set(required) - set(found.columns)
    if missing:
        raise ContractError(f"missing columns {sorted(missing)}")
    df = found.select(*[c for c in allowed if c in found.columns])
    empty = F.lit(False)
    for c in required:
        empty = empty | F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == "")
    if not df.where(empty).isEmpty():
        raise ContractError("empty required value")
    if not df.groupBy(*key).count().where("count > 1").isEmpty():
        raise ContractError("repeated key")
    return df


def decode_json_rows(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def decode_csv_null_token(spark: SparkSession, path: str, schema: T.StructType, token: str) -> DataFrame:
    """CSV whose nulls are spelled ``token``; an empty cell is an empty text.

    A row of another width, or a cell that does not fit its type, stops the read.
    """
    if not token:
        raise ContractError("a null token is required")
    names = csv_header(spark, path)
    if sorted(names) != sorted(schema.fieldNames()):
        raise ContractError("header differs from the declared columns")
    texts = T.StructType([T.StructField(n, T.StringType()) for n in names])
    raw = spark.read.schema(texts).option("header", True).option("enforceSchema", False).option("escape", '"').option("mode", "FAILFAST").csv(path)
    cell = lambda c: F.when(F.col(c).isNull(), "").when(F.col(c) != token, F.col(c))
    return raw.select(*[cell(f.name).cast(f.dataType).alias(f.name) for f in schema])


# Response types accepted for each declared column type.
RESPONSE_TYPES = {
    "number": ("INTEGER", "INT64", "FLOAT", "FLOAT64", "NUMERIC", "BIGNUMERIC"),
    "boolean": ("BOOLEAN", "BOOL"),
    "date": ("DATE",),
    "string": ("STRING",),
}
SPARK_TYPES = {"number": "double", "boolean": "boolean", "date": "date", "string": "string"}
_RESPONSE = (
    "struct<jobComplete:boolean,pageToken:string,totalRows:string,"
    "schema:struct<fields:array<struct<name:string,type:string,mode:string>>>,"
    "rows:array<struct<f:array<struct<v:string>>>>>"
)


def decode_columnar_response(pages: DataFrame, payload: str, columns: dict[str, str], keep: Sequence[str] = ()) -> DataFrame:
    """Rows of nested ``{schema.fields, rows[].f[].v}`` payloads, one payload per input row.

    Payloads are decoded where they are. An incomplete page, another row count,
    another field set or an unsupported type raises inside the task that meets it.
    """
    r = F.from_json(payload, _RESPONSE)
    fields = F.col("_r.schema.fields")
    names = F.transform(fields, lambda f: f["name"])
    complete = (
        F.col("_r.jobComplete") & F.col("_r.pageToken").isNull()
        & (F.size(F.coalesce("_r.rows", F.array())) == F.col("_r.totalRows").try_cast("int"))
    )
    known = F.array_sort(names) == F.array(*[F.lit(c) for c in sorted(columns)])
    typed = F.lit(True)
    for name, kind in columns.items():
        typed = typed & F.exists(fields, lambda f: (f["name"] == name) & f["type"].isin(*RESPONSE_TYPES[kind])
                                 & F.coalesce(f["mode"], F.lit("NULLABLE")).isin("NULLABLE", "REQUIRED"))
    ok = F.coalesce(complete & known & typed, F.lit(False))
    checked = F.when(ok, F.col("_r.rows")).otherwise(
        F.raise_error(F.lit("incomplete or unsupported response page")).cast("array<struct<f:array<struct<v:string>>>>"))
    rows = pages.select(*keep, r.alias("_r")).select(*keep, names.alias("_names"), F.explode(checked).alias("_row"))
    cell = lambda n: F.element_at(F.col("_row.f"), F.array_position("_names", n).cast("int"))["v"]
    return rows.select(*keep, *[cell(n).cast(SPARK_TYPES[k]).alias(n) for n, k in columns.items()])
