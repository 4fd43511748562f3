"""Aggregations."""

from pyspark.sql import functions as F

from starloom.functions.scalars import cents, month_start, ratio
from starloom.operators import aggregates as a
from starloom.plans.semantic import Measure, SemanticModel
from starloom.registry import derived as d
from starloom.registry.base import CTES, query, table

CTES["orders_c"] = """
SELECT *, CAST(round(o_totalprice * 100) AS BIGINT) AS c, strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS order_month FROM orders"""


def orders_c(spark, sf):
    return table(spark, sf, "orders").withColumns({"c": cents("o_totalprice"), "order_month": month_start("o_orderdate").cast("string")})


@query("agg_sum", "SELECT o_orderpriority, CAST(sum(c) AS BIGINT) AS total_cents FROM orders_c GROUP BY 1")
def agg_sum(spark, sf):
    return orders_c(spark, sf).groupBy("o_orderpriority").agg(F.sum("c").alias("total_cents"))


@query("agg_count", "SELECT status, count(*) AS n_rows, count(discount_cents) AS n_discounts FROM invoice_cdc GROUP BY 1")
def agg_count(spark, sf):
    return d.invoice_cdc(spark, sf).groupBy("status").agg(F.count("*").alias("n_rows"), F.count("discount_cents").alias("n_discounts"))


@query("agg_min_max", """
SELECT o_custkey, min(c) AS min_cents, max(c) AS max_cents, CAST(CAST(min(o_orderdate) AS DATE) AS VARCHAR) AS first_order FROM orders_c GROUP BY 1""")
def agg_min_max(spark, sf):
    return orders_c(spark, sf).groupBy("o_custkey").agg(
        F.min("c").alias("min_cents"), F.max("c").alias("max_cents"), F.min("o_orderdate").cast("date").cast("string").alias("first_order"))


@query("agg_count_distinct", """
SELECT order_month, count(DISTINCT o_custkey) AS customers, count(DISTINCT CASE WHEN o_orderstatus = 'F' THEN o_custkey END) AS filled_customers
FROM orders_c GROUP BY 1""")
def agg_count_distinct(spark, sf):
    filled = F.when(F.col("o_orderstatus") == "F", F.col("o_custkey"))
    return orders_c(spark, sf).groupBy("order_month").agg(F.count_distinct("o_custkey").alias("customers"), F.count_distinct(filled).alias("filled_customers"))


@query("agg_average", "SELECT o_orderpriority, CAST(sum(c) AS DOUBLE) / count(c) AS average_cents FROM orders_c GROUP BY 1")
def agg_average(spark, sf):
    return orders_c(spark, sf).groupBy("o_orderpriority").agg(ratio(F.sum("c"), F.count("c")).alias("average_cents"))


@query("agg_median", "SELECT o_orderpriority, quantile_cont(c, 0.5) AS median_cents FROM orders_c GROUP BY 1")
def agg_median(spark, sf):
    return a.percentile_exact(orders_c(spark, sf), ["o_orderpriority"], "c", 50.0, "median_cents")


@query("agg_percentile", "SELECT o_orderstatus, quantile_cont(c, 0.9) AS p90_cents FROM orders_c GROUP BY 1")
def agg_percentile(spark, sf):
    return a.percentile_exact(orders_c(spark, sf), ["o_orderstatus"], "c", 90.0, "p90_cents")


@query("agg_list", "SELECT p_brand, p_type, row_number() OVER (PARTITION BY p_brand ORDER BY p_type) AS position FROM (SELECT DISTINCT p_brand, p_type FROM part)")
def agg_list(spark, sf):
    return a.listed_values(table(spark, sf, "part"), ["p_brand"], "p_type")


CTES["fanout"] = """
SELECT l_returnflag, o_orderkey, c FROM lineitem JOIN orders_c ON l_orderkey = o_orderkey"""
CTES["fanout_once"] = "SELECT DISTINCT l_returnflag, o_orderkey, c FROM fanout"


def fanout(spark, sf):
    """Order amounts repeated on every line of the order."""
    o = orders_c(spark, sf).select("o_orderkey", "c")
    return table(spark, sf, "lineitem").select("l_returnflag", F.col("l_orderkey").alias("o_orderkey")).join(o, "o_orderkey")


@query("agg_sum_distinct_on", "SELECT l_returnflag, CAST(sum(c) AS BIGINT) AS order_cents FROM fanout_once GROUP BY 1")
def agg_sum_distinct_on(spark, sf):
    return a.distinct_on(fanout(spark, sf), ["l_returnflag"], "o_orderkey", "c", "sum", "order_cents")


@query("agg_average_distinct_on", "SELECT l_returnflag, round(CAST(sum(c) AS DOUBLE) / count(*), 4) AS average_cents FROM fanout_once GROUP BY 1")
def agg_average_distinct_on(spark, sf):
    out = a.distinct_on(fanout(spark, sf), ["l_returnflag"], "o_orderkey", "c", "average", "average_cents")
    return out.withColumn("average_cents", F.round("average_cents", 4))


@query("agg_median_distinct_on", "SELECT l_returnflag, quantile_cont(c, 0.5) AS median_cents FROM fanout_once GROUP BY 1")
def agg_median_distinct_on(spark, sf):
    return a.distinct_on(fanout(spark, sf), ["l_returnflag"], "o_orderkey", "c", "median", "median_cents")


@query("agg_percentile_distinct_on", "SELECT l_returnflag, quantile_cont(c, 0.25) AS p25_cents FROM fanout_once GROUP BY 1")
def agg_percentile_distinct_on(spark, sf):
    return a.distinct_on(fanout(spark, sf), ["l_returnflag"], "o_orderkey", "c", "percentile", "p25_cents", percent=25.0)


@query("agg_filtered_measure", """
SELECT order_month, count(*) AS n_orders, count(*) FILTER (WHERE o_orderstatus = 'F') AS n_filled,
       CAST(sum(c) FILTER (WHERE o_orderstatus = 'F') AS BIGINT) AS filled_cents, CAST(sum(c) FILTER (WHERE o_orderpriority = '1-URGENT') AS BIGINT) AS urgent_cents
FROM orders_c GROUP BY 1""")
def agg_filtered_measure(spark, sf):
    filled, urgent = F.col("o_orderstatus") == "F", F.col("o_orderpriority") == "1-URGENT"
    return orders_c(spark, sf).groupBy("order_month").agg(
        F.count("*").alias("n_orders"), F.count_if(filled).alias("n_filled"),
        a.sum_where(filled, "c").alias("filled_cents"), a.sum_where(urgent, "c").alias("urgent_cents"))


@query("agg_ratio_of_sums", """
SELECT tenant_id, CAST(sum(paid_cents) AS DOUBLE) / nullif(sum(net_cents), 0) AS paid_ratio FROM fct_billing GROUP BY 1""")
def agg_ratio_of_sums(spark, sf):
    return d.billing(spark, sf).groupBy("tenant_id").agg(ratio(F.sum("paid_cents"), F.sum("net_cents")).alias("paid_ratio"))


@query("agg_composed_measure", """
SELECT o_orderpriority, CAST(sum(c) AS BIGINT) AS total_cents, CAST(sum(c) FILTER (WHERE o_orderstatus = 'F') AS BIGINT) AS filled_cents,
       CAST(sum(c) AS BIGINT) - CAST(sum(c) FILTER (WHERE o_orderstatus = 'F') AS BIGINT) AS unfilled_cents,
       CAST(CAST(sum(c) AS BIGINT) - CAST(sum(c) FILTER (WHERE o_orderstatus = 'F') AS BIGINT) AS DOUBLE) / nullif(CAST(sum(c) AS BIGINT), 0) AS unfilled_share
FROM orders_c GROUP BY 1""")
def agg_composed_measure(spark, sf):
    model = SemanticModel(
        base="orders", views={"orders": orders_c(spark, sf)},
        measures={
            "total": Measure("sum", "orders__c"),
            "filled": Measure("sum", "orders__c", filters={"orders__o_orderstatus": {"is": "F"}}),
            "unfilled": Measure(compose=lambda m: m("total") - m("filled")),
            "unfilled_share": Measure(compose=lambda m: ratio(m("unfilled"), m("total"))),
        })
    return model.query({"o_orderpriority": "orders__o_orderpriority"}, {
        "total_cents": "total", "filled_cents": "filled", "unfilled_cents": "unfilled", "unfilled_share": "unfilled_share"})


@query("agg_conditional_max_flag", """
SELECT o_custkey, max(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS has_filled, max(CASE WHEN o_orderpriority = '1-URGENT' AND c > 30000000 THEN 1 ELSE 0 END) AS has_large_urgent
FROM orders_c GROUP BY 1""")
def agg_conditional_max_flag(spark, sf):
    return orders_c(spark, sf).groupBy("o_custkey").agg(
        a.flag_any(F.col("o_orderstatus") == "F").alias("has_filled"),
        a.flag_any((F.col("o_orderpriority") == "1-URGENT") & (F.col("c") > 30000000)).alias("has_large_urgent"))


@query("agg_signed_split", """
SELECT tenant_id, CAST(sum(CASE WHEN rf <> 'R' THEN e ELSE 0 END) AS BIGINT) AS fee_cents, CAST(sum(CASE WHEN rf = 'R' THEN -e ELSE 0 END) AS BIGINT) AS refund_cents,
       CAST(sum(CASE WHEN rf = 'R' THEN -e ELSE e END) AS BIGINT) AS net_cents FROM line_base GROUP BY 1""")
def agg_signed_split(spark, sf):
    refund = F.col("_rf") == "R"
    signed = d.line_base(spark, sf).withColumn("_s", F.when(refund, -F.col("_e")).otherwise(F.col("_e")).cast("decimal(18,0)"))
    zero = F.lit(0).cast("decimal(18,0)")
    return signed.groupBy("tenant_id").agg(
        F.sum(F.when(~refund, F.col("_s")).otherwise(zero)).cast("long").alias("fee_cents"),
        F.sum(F.when(refund, F.col("_s")).otherwise(zero)).cast("long").alias("refund_cents"), F.sum("_s").cast("long").alias("net_cents"))


@query("agg_preaggregate_then_join", """
SELECT i.invoice_id, i.gross_cents, coalesce(p.paid, 0) AS paid_cents, coalesce(c.credit, 0) AS credit_cents FROM invoices i
LEFT JOIN (SELECT tenant_id, invoice_id, CAST(sum(amount_cents) AS BIGINT) AS paid FROM payments GROUP BY 1, 2) p ON i.tenant_id = p.tenant_id AND i.invoice_id = p.invoice_id
LEFT JOIN (SELECT tenant_id, invoice_id, CAST(sum(amount_cents) AS BIGINT) AS credit FROM credits GROUP BY 1, 2) c ON i.tenant_id = c.tenant_id AND i.invoice_id = c.invoice_id""")
def agg_preaggregate_then_join(spark, sf):
    keys = ["tenant_id", "invoice_id"]
    paid = d.payments(spark, sf).groupBy(*keys).agg(F.sum("amount_cents").alias("paid_cents"))
    credit = d.credits(spark, sf).groupBy(*keys).agg(F.sum("amount_cents").alias("credit_cents"))
    out = d.invoices(spark, sf).select(*keys, "gross_cents").join(paid, keys, "left").join(credit, keys, "left")
    return out.select("invoice_id", "gross_cents", F.coalesce("paid_cents", F.lit(0)).alias("paid_cents"), F.coalesce("credit_cents", F.lit(0)).alias("credit_cents"))


@query("agg_having", "SELECT o_custkey, count(*) AS n_orders, CAST(sum(c) AS BIGINT) AS total_cents FROM orders_c GROUP BY 1 HAVING count(*) > 14")
def agg_having(spark, sf):
    return orders_c(spark, sf).groupBy("o_custkey").agg(F.count("*").alias("n_orders"), F.sum("c").alias("total_cents")).where("n_orders > 14")


@query("agg_period_snapshot", """
SELECT o_custkey, order_month, count(*) AS n_orders, CAST(sum(c) AS BIGINT) AS total_cents, max(c) AS largest_cents FROM orders_c GROUP BY 1, 2""")
def agg_period_snapshot(spark, sf):
    return orders_c(spark, sf).groupBy("o_custkey", "order_month").agg(F.count("*").alias("n_orders"), F.sum("c").alias("total_cents"), F.max("c").alias("largest_cents"))


@query("agg_first_event_cohort", """
SELECT f.first_month, o.order_month, count(DISTINCT o.o_custkey) AS active_customers FROM orders_c o
JOIN (SELECT o_custkey, min(order_month) AS first_month FROM orders_c WHERE o_orderstatus = 'F' GROUP BY 1) f ON o.o_custkey = f.o_custkey
WHERE o.order_month >= f.first_month GROUP BY 1, 2""")
def agg_first_event_cohort(spark, sf):
    o = orders_c(spark, sf)
    first = o.where("o_orderstatus = 'F'").groupBy("o_custkey").agg(F.min("order_month").alias("first_month"))
    months = o.select("o_custkey", "order_month").distinct()
    return months.join(first, "o_custkey").where("order_month >= first_month").groupBy("first_month", "order_month").agg(F.count("*").alias("active_customers"))


@query("agg_grand_total", """
SELECT 'all' AS population, count(*) AS n_orders, CAST(sum(c) AS BIGINT) AS total_cents FROM orders_c
UNION ALL SELECT 'empty', count(*), CAST(sum(c) AS BIGINT) FROM orders_c WHERE o_orderstatus = 'X'""")
def agg_grand_total(spark, sf):
    total = lambda name, df: df.agg(F.count("*").alias("n_orders"), F.sum("c").alias("total_cents")).select(F.lit(name).alias("population"), "*")
    o = orders_c(spark, sf)
    return total("all", o).unionByName(total("empty", o.where("o_orderstatus = 'X'")))


@query("agg_totals_recomputed", """
SELECT coalesce(o_orderpriority, '(total)') AS priority, coalesce(o_orderstatus, '(total)') AS status, count(*) AS n_orders, count(DISTINCT o_custkey) AS customers,
       CAST(sum(CASE WHEN o_orderdate < DATE '1998-01-01' THEN c END) AS DOUBLE) / nullif(CAST(sum(c) AS DOUBLE), 0) AS early_share
FROM orders_c GROUP BY ROLLUP (o_orderpriority, o_orderstatus)""")
def agg_totals_recomputed(spark, sf):
    early = F.col("o_orderdate") < F.lit("1998-01-01").cast("date")
    rolled = orders_c(spark, sf).rollup("o_orderpriority", "o_orderstatus").agg(
        F.count("*").alias("n_orders"), F.count_distinct("o_custkey").alias("customers"),
        ratio(a.sum_where(early, "c"), F.sum("c")).alias("early_share"))
    name = lambda c: F.coalesce(c, F.lit("(total)"))
    return rolled.select(name("o_orderpriority").alias("priority"), name("o_orderstatus").alias("status"), "n_orders", "customers", "early_share")


CTES["measure_inventory"] = """
SELECT p_partkey AS measure_id, p_brand AS model_id,
       CASE p_type WHEN 'PROMO' THEN 'sum' WHEN 'STANDARD' THEN 'count' WHEN 'ECONOMY' THEN 'ratio' WHEN 'LARGE' THEN 'count_distinct' WHEN 'MEDIUM' THEN 'sum' ELSE 'max' END AS aggregation,
       CASE WHEN p_size < 30 THEN 'additive' WHEN p_size < 40 THEN 'semi_additive' ELSE 'non_additive' END AS additivity FROM part"""


def measure_inventory(spark, sf):
    kinds = {"PROMO": "sum", "STANDARD": "count", "ECONOMY": "ratio", "LARGE": "count_distinct", "MEDIUM": "sum"}
    agg = F.coalesce(*[F.when(F.col("p_type") == t, k) for t, k in kinds.items()], F.lit("max"))
    add = F.when(F.col("p_size") < 30, "additive").when(F.col("p_size") < 40, "semi_additive").otherwise("non_additive")
    return table(spark, sf, "part").select(F.col("p_partkey").alias("measure_id"), F.col("p_brand").alias("model_id"), agg.alias("aggregation"), add.alias("additivity"))


@query("agg_additivity_class", """
SELECT model_id, CASE WHEN aggregation IN ('sum', 'count') AND additivity = 'additive' THEN 'pre_aggregate' ELSE 'keep_detail' END AS strategy, count(*) AS n_measures
FROM measure_inventory GROUP BY 1, 2""")
def agg_additivity_class(spark, sf):
    return a.additivity_strategy(measure_inventory(spark, sf)).groupBy("model_id", "strategy").agg(F.count("*").alias("n_measures"))


@query("agg_status_rollup", """
SELECT o_custkey, CASE max(CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 3 END) WHEN 1 THEN 'passed' WHEN 2 THEN 'pending' ELSE 'failed' END AS status
FROM orders GROUP BY 1""")
def agg_status_rollup(spark, sf):
    status = F.when(F.col("o_orderstatus") == "F", "passed").when(F.col("o_orderstatus") == "O", "pending").otherwise("failed")
    return table(spark, sf, "orders").withColumn("s", status).groupBy("o_custkey").agg(a.worst_status("s").alias("status"))
