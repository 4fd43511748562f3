"""Sources and sinks."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from starloom.functions.scalars import cents
from starloom.operators.cdc import current_state
from starloom.operators.reconcile import ColumnRule, ResultContract
from starloom.registry import derived as d
from starloom.registry.base import query, table
from starloom.session import scratch_path
from starloom.sources import readers, sinks

ORDERS = T.StructType([
    T.StructField("o_orderkey", T.LongType()), T.StructField("o_custkey", T.LongType()),
    T.StructField("o_orderstatus", T.StringType()), T.StructField("o_totalprice", T.DoubleType()),
    T.StructField("o_orderdate", T.TimestampNTZType()), T.StructField("o_orderpriority", T.StringType()),
])


@query("read_raw_strict", """
SELECT o_orderstatus, count(*) AS n_orders, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS total_cents
FROM orders GROUP BY o_orderstatus""")
def read_raw_strict(spark, sf):
    raw = readers.read_raw(spark, f"{sf}/orders.parquet", ORDERS)
    return raw.groupBy("o_orderstatus").agg(F.count("*").alias("n_orders"), F.sum(cents("o_totalprice")).alias("total_cents"))


def _written(df, name, **options):
    path = scratch_path(df.sparkSession, name)
    df.write.options(**options).csv(path)
    return path


@query("read_csv_text", """
SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, CAST(c_nationkey AS VARCHAR) AS c_nationkey, c_mktsegment FROM customer""")
def read_csv_text(spark, sf):
    path = _written(table(spark, sf, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment"), "customer-csv", header=True)
    return readers.read_csv_text(spark, path).drop(readers.CORRUPT)


@query("csv_profile", """
SELECT count(*) AS row_count, count(*) FILTER (WHERE o_orderpriority = '5-LOW') AS ragged_rows,
       CAST(0 AS BIGINT) AS oversized_fields, 0 AS duplicate_headers, 0 AS case_collisions FROM orders""")
def csv_profile(spark, sf):
    lines = table(spark, sf, "orders").select(
        "o_orderkey", "o_orderstatus",
        F.when(F.col("o_orderpriority") == "5-LOW", F.concat("o_orderpriority", F.lit(",extra")))
        .otherwise(F.col("o_orderpriority")).alias("o_orderpriority"))
    return readers.csv_profile(spark, _written(lines, "ragged-csv", header=True, quote=""))


CHARGES = T.StructType([
    T.StructField("tenant_id", T.StringType()), T.StructField("charge_id", T.StringType()),
    T.StructField("amount", T.DecimalType(18, 2)), T.StructField("updated_at", T.TimestampNTZType()),
    T.StructField("is_deleted", T.BooleanType()),
])


@query("read_seed_csv", """
SELECT tenant_id, rf = 'N' AND d = 0 AS is_deleted, count(*) AS n_rows, CAST(sum(e) AS BIGINT) AS amount_cents,
       CAST(CAST(max(l_shipdate) AS DATE) AS VARCHAR) AS last_update
FROM line_base GROUP BY 1, 2""")
def read_seed_csv(spark, sf):
    seed = d.line_base(spark, sf).select(
        "tenant_id", F.col("_line").alias("charge_id"), (F.col("_e").cast("decimal(18,2)") / 100).cast("decimal(18,2)").alias("amount"),
        F.col("_ship").alias("updated_at"), ((F.col("_rf") == "N") & (F.col("_d") == 0)).alias("is_deleted"))
    typed = readers.read_seed_csv(spark, _written(seed, "charges-csv", header=True), CHARGES)
    return typed.groupBy("tenant_id", "is_deleted").agg(
        F.count("*").alias("n_rows"), (F.sum("amount") * 100).cast("long").alias("amount_cents"),
        F.max("updated_at").cast("date").cast("string").alias("last_update"))


@query("read_registry_csv", """
SELECT p_brand AS table_name, p_name AS column_name, p_type AS attribute, 2 AS n_tags, p_brand AS last_tag, count(*) AS n
FROM part WHERE p_type IN ('PROMO', 'STANDARD') GROUP BY ALL""")
def read_registry_csv(spark, sf):
    registry = table(spark, sf, "part").select(
        F.col("p_brand").alias("table_name"), F.col("p_name").alias("column_name"), F.col("p_type").alias("attribute"),
        F.to_json(F.array("p_type", "p_brand")).alias("tags"))
    path = _written(registry, "registry-csv", header=True, escape='"')
    got = readers.read_registry_csv(spark, path, json_columns=["tags"], attribute="attribute",
                                    values=["promo", "standard"], required="column_name")
    return got.groupBy("table_name", "column_name", "attribute", F.size("tags").alias("n_tags"),
                       F.element_at("tags", -1).alias("last_tag")).agg(F.count("*").alias("n"))


@query("read_parquet_metadata", """
SELECT p_brand, count(*) AS n_entries, min(p_name) AS first_name, max(p_partkey) AS last_key FROM part GROUP BY p_brand""")
def read_parquet_metadata(spark, sf):
    meta = readers.read_metadata(spark, f"{sf}/part.parquet", ["p_partkey", "p_name", "p_brand"],
                                 ["p_partkey", "p_name", "p_brand"], ["p_partkey"])
    return meta.groupBy("p_brand").agg(F.count("*").alias("n_entries"), F.min("p_name").alias("first_name"), F.max("p_partkey").alias("last_key"))


@query("decode_json_rows", "SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier")
def decode_json_rows(spark, sf):
    supplier = table(spark, sf, "supplier")
    path = scratch_path(spark, "supplier-json")
    supplier.write.json(path)
    return readers.decode_json_rows(spark, path, supplier.schema)


@query("decode_csv_null_token", """
SELECT c_custkey, CASE WHEN c_acctbal >= 0 THEN CAST(round(c_acctbal * 100) AS BIGINT) END AS balance_cents, c_mktsegment FROM customer""")
def decode_csv_null_token(spark, sf):
    rows = table(spark, sf, "customer").select(
        "c_custkey", F.when(F.col("c_acctbal") >= 0, cents("c_acctbal").cast("string")).otherwise("#NULL#").alias("balance_cents"), "c_mktsegment")
    schema = T.StructType([T.StructField("c_custkey", T.LongType()), T.StructField("balance_cents", T.LongType()), T.StructField("c_mktsegment", T.StringType())])
    return readers.decode_csv_null_token(spark, _written(rows, "null-token-csv", header=True), schema, "#NULL#")


@query("decode_columnar_response", """
SELECT o_orderkey AS page_key, 'priority' AS name, CAST(length(o_orderpriority) AS DOUBLE) AS value FROM orders
UNION ALL SELECT o_orderkey, 'status', CAST(length(o_orderstatus) AS DOUBLE) FROM orders""")
def decode_columnar_response(spark, sf):
    cell = lambda c: F.struct(c.cast("string").alias("v"))
    row = lambda label, c: F.struct(F.array(cell(F.lit(label)), cell(F.length(c))).alias("f"))
    field = lambda name, kind: F.struct(F.lit(name).alias("name"), F.lit(kind).alias("type"))
    payload = F.to_json(F.struct(
        F.lit(True).alias("jobComplete"), F.lit("2").alias("totalRows"),
        F.struct(F.array(field("name", "STRING"), field("value", "INT64")).alias("fields")).alias("schema"),
        F.array(row("priority", F.col("o_orderpriority")), row("status", F.col("o_orderstatus"))).alias("rows")))
    pages = table(spark, sf, "orders").select(F.col("o_orderkey").alias("page_key"), payload.alias("payload"))
    return readers.decode_columnar_response(pages, "payload", {"name": "string", "value": "number"}, keep=["page_key"])


MONTHLY = ResultContract(
    {"order_month": ColumnRule("date", False), "n_orders": ColumnRule("integer", False), "amount": ColumnRule("decimal", False)}, ["order_month"])


@query("typed_export", """
SELECT strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS order_month, count(*) AS n_orders,
       printf('%d.%02d', CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) // 100,
              CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) % 100) AS amount
FROM orders GROUP BY 1""")
def typed_export(spark, sf):
    monthly = table(spark, sf, "orders").groupBy(F.trunc(F.col("o_orderdate").cast("date"), "month").alias("order_month")).agg(
        F.count("*").alias("n_orders"), F.sum(cents("o_totalprice")).alias("_c"))
    shaped = monthly.select("order_month", "n_orders", (F.col("_c").cast("decimal(20,2)") / 100).cast("decimal(20,2)").alias("amount"))
    return sinks.typed_export(shaped, MONTHLY)


@query("write_layer", """
SELECT tenant_id, status, count(*) AS n_invoices, CAST(sum(gross_cents) AS BIGINT) AS gross_cents FROM invoices GROUP BY 1, 2""")
def write_layer(spark, sf):
    root = scratch_path(spark, "layers")
    bronze = sinks.write_layer(d.invoice_cdc(spark, sf), f"{root}/bronze")
    current = current_state(bronze, ["tenant_id", "invoice_id"], d.ORDER_BY, F.col("op") == "DELETE")
    silver = sinks.write_layer(current.withColumn("status", F.lower(F.trim("status"))), f"{root}/silver")
    gold = silver.groupBy("tenant_id", "status").agg(F.count("*").alias("n_invoices"), F.sum("gross_cents").alias("gross_cents"))
    return sinks.write_layer(gold, f"{root}/gold")


_INVENTORY_SQL = " UNION ALL ".join(
    f"SELECT '{rel}' AS relation, '{col}' AS column_path, {i} AS ordinal, '{typ}' AS data_type, "
    f"count(*) FILTER (WHERE {col} IS NULL) AS n_nulls, count(*) AS n_rows FROM {rel}"
    for rel, cols in {
        "customer": [("c_custkey", "bigint"), ("c_name", "string"), ("c_nationkey", "int"), ("c_acctbal", "double"), ("c_mktsegment", "string")],
        "events": [("event_id", "bigint"), ("ts", "timestamp_ntz"), ("user_id", "bigint"), ("event_type", "string"), ("value", "double"), ("props", "string")],
        "labels": [("doc_id", "bigint"), ("quality", "int"), ("toxic", "int")],
    }.items() for i, (col, typ) in enumerate(cols, 1))


@query("catalog_inventory", _INVENTORY_SQL)
def catalog_inventory(spark, sf):
    return sinks.catalog_inventory({n: table(spark, sf, n) for n in ("customer", "events", "labels")})


_DIGEST_ROW = "sha256(" + " || ".join(
    f"coalesce('V' || CAST(length(CAST({c} AS VARCHAR)) AS VARCHAR) || ':' || CAST({c} AS VARCHAR), 'N')" for c in ("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")) + ")"


@query("dataset_digest", f"""
SELECT count(*) AS n_rows, concat_ws(':', {", ".join(f"CAST(sum(CAST('0x' || substr(h, {8 * k + 1}, 8) AS BIGINT)) AS VARCHAR)" for k in range(8))}) AS digest
FROM (SELECT {_DIGEST_ROW} AS h FROM orders)""")
def dataset_digest(spark, sf):
    return sinks.dataset_digest(table(spark, sf, "orders"), ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"])
