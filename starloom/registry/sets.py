"""Sort, limit, set operations, de-duplication."""

from pyspark.sql import functions as F

from starloom.operators import sets as s
from starloom.registry import derived as d
from starloom.registry.aggregates import orders_c
from starloom.registry.base import CTES, query, table


@query("sort_nulls_first", """
SELECT l.quality, count(*) AS n FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY 1 ORDER BY 1 NULLS FIRST""")
def sort_nulls_first(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels"), "doc_id", "left")
    return s.sort_nulls_first(docs.groupBy("quality").agg(F.count("*").alias("n")), ["quality"])


@query("limit_report", "SELECT o_custkey, CAST(sum(c) AS BIGINT) AS total_cents FROM orders_c GROUP BY 1 ORDER BY 1 LIMIT 50")
def limit_report(spark, sf):
    totals = orders_c(spark, sf).groupBy("o_custkey").agg(F.sum("c").alias("total_cents"))
    return s.limit_report(s.sort_nulls_first(totals, ["o_custkey"]), 50)


@query("topk_sorted", "SELECT o_orderkey, c, false AS is_complete FROM orders_c ORDER BY c DESC, o_orderkey LIMIT 25")
def topk_sorted(spark, sf):
    return s.topk(orders_c(spark, sf).select("o_orderkey", "c"), [F.desc("c"), F.asc("o_orderkey")], 25)


CTES["lane_orders"] = """
SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' AND o_orderpriority = '1-URGENT' THEN c + 1000 ELSE c END AS c, order_month FROM orders_c"""


def lane_orders(spark, sf):
    """A second lane in which some amounts moved."""
    moved = (F.col("o_orderstatus") == "P") & (F.col("o_orderpriority") == "1-URGENT")
    return orders_c(spark, sf).select("o_orderkey", F.when(moved, F.col("c") + 1000).otherwise(F.col("c")).alias("c"), "order_month")


@query("order_sensitive_compare", """
SELECT e.o_orderkey, e.p AS expected_position, a.p AS actual_position FROM
 (SELECT o_orderkey, row_number() OVER (ORDER BY order_month, c, o_orderkey) AS p FROM orders_c) e
JOIN (SELECT o_orderkey, row_number() OVER (ORDER BY order_month, c, o_orderkey) AS p FROM lane_orders) a ON e.o_orderkey = a.o_orderkey WHERE e.p <> a.p""")
def order_sensitive_compare(spark, sf):
    ranked = lambda df: s.with_position(df, ["order_month", "c", "o_orderkey"])
    return s.order_mismatches(ranked(orders_c(spark, sf).select("o_orderkey", "c", "order_month")), ranked(lane_orders(spark, sf)), ["o_orderkey"])


@query("union_all", """
SELECT 'payment_orphan' AS issue, p.tenant_id, p.invoice_id FROM payments p WHERE (p.tenant_id, p.invoice_id) NOT IN (SELECT (tenant_id, invoice_id) FROM invoices)
UNION ALL SELECT 'adjustment_orphan', a.tenant_id, a.invoice_id FROM adjustments a WHERE (a.tenant_id, a.invoice_id) NOT IN (SELECT (tenant_id, invoice_id) FROM invoices)
UNION ALL SELECT 'credit_orphan', c.tenant_id, c.invoice_id FROM credits c WHERE (c.tenant_id, c.invoice_id) NOT IN (SELECT (tenant_id, invoice_id) FROM invoices)""")
def union_all(spark, sf):
    keys = ["tenant_id", "invoice_id"]
    parents = d.invoices(spark, sf).select(*keys)
    check = lambda name, df: df.select(*keys).join(parents, keys, "left_anti").select(F.lit(name).alias("issue"), *keys)
    return s.union_checks([check("payment_orphan", d.payments(spark, sf)), check("adjustment_orphan", d.adjustments(spark, sf)), check("credit_orphan", d.credits(spark, sf))])


@query("distinct_rows", "SELECT DISTINCT tenant_id, customer_id, valid_from, valid_to, segment FROM customer_history_raw")
def distinct_rows(spark, sf):
    return s.distinct_rows(d.customer_history_raw(spark, sf))


@query("set_difference_keys", """
SELECT doc_id, 'missing_key' AS kind FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
UNION ALL SELECT doc_id, 'extra_key' FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)""")
def set_difference_keys(spark, sf):
    return s.key_difference(table(spark, sf, "documents"), table(spark, sf, "labels"), ["doc_id"])


@query("set_intersect_keys", "SELECT c_nationkey AS nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def set_intersect_keys(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_nationkey").alias("nationkey"))
    return s.key_intersection(c, table(spark, sf, "supplier").select(F.col("s_nationkey").alias("nationkey")), ["nationkey"])


@query("duplicate_count", """
SELECT count(*) AS deliveries, count(DISTINCT (tenant_id, invoice_id, gross_cents, status, op, source_seq)) AS distinct_payloads,
       count(*) - count(DISTINCT (tenant_id, invoice_id, gross_cents, status, op, source_seq)) AS redundant FROM invoice_cdc""")
def duplicate_count(spark, sf):
    return s.duplicate_deliveries(d.invoice_cdc(spark, sf), ["tenant_id", "invoice_id", "gross_cents", "status", "op", "source_seq"])


@query("merge_no_conflict", """
SELECT o_orderkey, count(*) AS n_records, count(DISTINCT c) AS n_versions, CASE WHEN count(DISTINCT c) > 1 THEN 'conflict' ELSE 'merged' END AS status
FROM (SELECT o_orderkey, c FROM orders_c UNION ALL SELECT o_orderkey, c FROM lane_orders) GROUP BY 1""")
def merge_no_conflict(spark, sf):
    return s.merge_no_conflict([orders_c(spark, sf), lane_orders(spark, sf)], ["o_orderkey"], ["c", "order_month"])
