"""Window functions."""

from pyspark.sql import functions as F

from starloom.operators import cdc
from starloom.operators import joins as j
from starloom.operators import prefix
from starloom.operators import windows as w
from starloom.registry import derived as d
from starloom.registry.aggregates import orders_c
from starloom.registry.base import query

_LATEST = "SELECT tenant_id, invoice_id, status, gross_cents, discount_cents, source_seq FROM invoices"


@query("win_latest_version", _LATEST)
def win_latest_version(spark, sf):
    return d.invoices(spark, sf).select("tenant_id", "invoice_id", "status", "gross_cents", "discount_cents", "source_seq")


@query("win_history_number", """
SELECT tenant_id, customer_id, segment, row_number() OVER (PARTITION BY tenant_id, customer_id ORDER BY valid_from, valid_to, segment) AS history_row
FROM customer_history""")
def win_history_number(spark, sf):
    numbered = prefix.row_numbers(d.customer_history(spark, sf), ["tenant_id", "customer_id"], ["valid_from", "valid_to", "segment"], "history_row")
    return numbered.select("tenant_id", "customer_id", "segment", "history_row")


@query("win_partition_share", """
SELECT order_month, o_orderpriority, total_cents, CAST(total_cents AS DOUBLE) / nullif(sum(total_cents) OVER (PARTITION BY order_month), 0) AS month_share
FROM (SELECT order_month, o_orderpriority, CAST(sum(c) AS BIGINT) AS total_cents FROM orders_c GROUP BY 1, 2)""")
def win_partition_share(spark, sf):
    marks = orders_c(spark, sf).groupBy("order_month", "o_orderpriority").agg(F.sum("c").alias("total_cents"))
    return w.partition_share(marks, ["order_month"], "total_cents", "month_share")


@query("win_fixed_lod_repeat", """
SELECT o_orderkey, order_month, CAST(sum(c) OVER (PARTITION BY order_month) AS BIGINT) AS month_cents FROM orders_c""")
def win_fixed_lod_repeat(spark, sf):
    return j.join_lod(orders_c(spark, sf).select("o_orderkey", "order_month", "c"), ["order_month"], [F.sum("c").alias("month_cents")]).drop("c")


@query("win_prev_interval_end", """
SELECT tenant_id, customer_id, segment, CAST(max(coalesce(CAST(valid_to AS DATE), DATE '9999-12-31')) OVER (
  PARTITION BY tenant_id, customer_id ORDER BY valid_from, segment ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS VARCHAR) AS previous_end
FROM customer_history""")
def win_prev_interval_end(spark, sf):
    end = F.coalesce(F.col("valid_to").cast("date"), F.lit("9999-12-31").cast("date"))
    out = prefix.previous_max(d.customer_history(spark, sf), ["tenant_id", "customer_id"], ["valid_from", "segment"], end, "previous_end")
    return out.select("tenant_id", "customer_id", "segment", F.col("previous_end").cast("string").alias("previous_end"))
