"""Dataset comparison and scorecards."""

from pyspark.sql import functions as F

from starloom.operators import reconcile as r
from starloom.operators.sets import union_checks
from starloom.registry.aggregates import orders_c
from starloom.registry.base import CTES, query, table

CONTRACT = r.ResultContract({
    "o_orderkey": r.ColumnRule("integer", False), "c": r.ColumnRule("integer", abs_tolerance=100, rel_tolerance=0.0001), "o_orderstatus": r.ColumnRule("string")}, ["o_orderkey"])

# A candidate copy of orders: some keys lost, some added, some values moved a little or a lot.
CTES["candidate"] = """
SELECT o_orderkey, CASE WHEN o_orderpriority = '2-HIGH' THEN c + 90 WHEN o_orderpriority = '3-MEDIUM' THEN c + c // 5000 + 200 ELSE c END AS c,
       CASE WHEN o_orderpriority = '4-NOT SPECIFIED' AND o_orderstatus = 'P' THEN NULL ELSE o_orderstatus END AS o_orderstatus, order_month
FROM orders_c WHERE NOT (o_orderpriority = '5-LOW' AND o_orderstatus = 'O')
UNION ALL SELECT -1 - o_orderkey, c, o_orderstatus, order_month FROM orders_c WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'F'"""
# What a delivery may get wrong besides: some keys twice, some without a key.
CTES["faulty"] = """
SELECT o_orderkey, c, o_orderstatus FROM candidate
UNION ALL SELECT o_orderkey, c, o_orderstatus FROM candidate WHERE o_orderkey % 97 = 3
UNION ALL SELECT NULL, c, o_orderstatus FROM candidate WHERE o_orderkey % 101 = 5"""


def candidate(spark, sf):
    o = orders_c(spark, sf)
    pr, st = F.col("o_orderpriority"), F.col("o_orderstatus")
    moved = F.when(pr == "2-HIGH", F.col("c") + 90).when(pr == "3-MEDIUM", F.col("c") + F.expr("c div 5000") + 200).otherwise(F.col("c"))
    kept = o.where(~((pr == "5-LOW") & (st == "O"))).select("o_orderkey", moved.alias("c"), F.when(~((pr == "4-NOT SPECIFIED") & (st == "P")), st).alias("o_orderstatus"), "order_month")
    added = o.where((pr == "1-URGENT") & (st == "F")).select((-1 - F.col("o_orderkey")).alias("o_orderkey"), "c", "o_orderstatus", "order_month")
    return kept.unionByName(added)


def faulty(spark, sf):
    cand = candidate(spark, sf).select("o_orderkey", "c", "o_orderstatus")
    keyless = cand.where("o_orderkey % 101 = 5").withColumn("o_orderkey", F.lit(None).cast("long"))
    return cand.unionByName(cand.where("o_orderkey % 97 = 3")).unionByName(keyless)


CTES["refused"] = """
SELECT o_orderkey, CASE WHEN o_orderkey IS NULL THEN 'null_key' ELSE 'duplicate_key' END AS kind, NULL AS column_name,
       CAST((SELECT count(*) FROM orders_c e WHERE e.o_orderkey = f.o_orderkey) AS VARCHAR) AS e, CAST(count(*) AS VARCHAR) AS actual FROM faulty f GROUP BY o_orderkey HAVING count(*) > 1 OR o_orderkey IS NULL"""
CTES["keyed_findings"] = """
SELECT e.o_orderkey, 'missing_key' AS kind, NULL AS column_name, NULL AS expected, NULL AS actual FROM orders_c e WHERE e.o_orderkey NOT IN (SELECT o_orderkey FROM candidate)
UNION ALL SELECT a.o_orderkey, 'extra_key', NULL, NULL, NULL FROM candidate a WHERE a.o_orderkey NOT IN (SELECT o_orderkey FROM orders_c)
UNION ALL SELECT e.o_orderkey, 'value_mismatch', 'c', CAST(e.c AS VARCHAR), CAST(a.c AS VARCHAR) FROM orders_c e JOIN candidate a USING (o_orderkey) WHERE abs(e.c - a.c) > greatest(100, 0.0001 * abs(e.c))
UNION ALL SELECT e.o_orderkey, 'value_mismatch', 'o_orderstatus', e.o_orderstatus, a.o_orderstatus FROM orders_c e JOIN candidate a USING (o_orderkey) WHERE e.o_orderstatus IS DISTINCT FROM a.o_orderstatus"""


def baseline(spark, sf):
    return orders_c(spark, sf).select("o_orderkey", "c", "o_orderstatus")


@query("keyed_diff", """
SELECT * FROM keyed_findings WHERE o_orderkey NOT IN (SELECT o_orderkey FROM refused WHERE o_orderkey IS NOT NULL)
UNION ALL SELECT o_orderkey, kind, column_name, CASE WHEN e = '0' THEN NULL ELSE e END, actual FROM refused""")
def keyed_diff(spark, sf):
    return r.keyed_diff(baseline(spark, sf), faulty(spark, sf), CONTRACT)


@query("keyed_diff_summary", """
SELECT category, count(*) AS expected, count(*) FILTER (WHERE n = 0) AS passed, count(*) FILTER (WHERE n > 0) AS failed FROM (
  SELECT 'correctness' AS category, (SELECT count(*) FROM keyed_findings) AS n UNION ALL SELECT 'correctness', 0
  UNION ALL SELECT 'compatibility', (SELECT count(*) FROM orders_c JOIN candidate USING (o_orderkey) WHERE orders_c.o_orderstatus IS DISTINCT FROM candidate.o_orderstatus)) GROUP BY 1""")
def keyed_diff_summary(spark, sf):
    base, cand = baseline(spark, sf), candidate(spark, sf)
    shared = cand.join(base.select("o_orderkey"), "o_orderkey", "left_semi")
    status = r.ResultContract({k: CONTRACT.columns[k] for k in ("o_orderkey", "o_orderstatus")}, ["o_orderkey"])
    found = r.keyed_diff(base, shared, status).where("kind = 'value_mismatch'")
    return r.category_summary(union_checks([
        r.diff_summary(r.keyed_diff(base, cand, CONTRACT), "orders", "correctness"), r.diff_summary(r.keyed_diff(base, base, CONTRACT), "orders-self", "correctness"),
        r.diff_summary(found, "orders-status", "compatibility")]))


@query("parity_lanes", """
SELECT 'orders' AS case_id, 'warehouse' AS lane, (SELECT count(*) FROM orders_c) AS row_count, CAST(0 AS BIGINT) AS n_findings, 'passed' AS status
UNION ALL SELECT 'orders', 'semantic', (SELECT count(*) FROM candidate), (SELECT count(*) FROM keyed_findings), 'failed' UNION ALL SELECT 'orders', 'dashboard', 0, 0, 'pending'""")
def parity_lanes(spark, sf):
    return r.parity_lanes(baseline(spark, sf), {"warehouse": baseline(spark, sf), "semantic": candidate(spark, sf), "dashboard": None}, CONTRACT, "orders")


CTES["item_checks"] = """
SELECT e.order_month AS item_id, CASE WHEN max(CASE WHEN abs(e.c - a.c) > 100 THEN 1 ELSE 0 END) = 1 AND min(e.o_custkey) % 2 = 0 THEN 'failed' WHEN min(e.o_custkey) % 3 = 0 THEN 'pending' ELSE 'passed' END AS check_status
FROM orders_c e JOIN candidate a USING (o_orderkey) GROUP BY e.order_month, e.o_orderpriority"""
CTES["crosswalk"] = """
SELECT DISTINCT order_month AS item_id, CASE WHEN substr(order_month, 6, 2) = '02' THEN 'pending' WHEN substr(order_month, 6, 2) = '05' THEN 'unsupported' ELSE 'mapped' END AS mapping_status,
       substr(order_month, 1, 7) = '1999-03' AS is_stale FROM orders_c UNION ALL SELECT DISTINCT 'x' || o_orderpriority, 'mapped', false FROM orders_c"""
CTES["scorecard"] = """
SELECT w.item_id, coalesce(k.n, 0) AS case_count, coalesce(k.n, 0) > 0 AS is_required,
       CASE WHEN w.is_stale OR k.f > 0 THEN 'fail' WHEN coalesce(k.n, 0) = 0 OR w.mapping_status = 'unsupported' THEN 'unsupported' WHEN k.p > 0 OR w.mapping_status <> 'mapped' THEN 'pending' ELSE 'pass' END AS status
FROM crosswalk w LEFT JOIN (SELECT item_id, count(*) AS n, count(*) FILTER (WHERE check_status = 'failed') AS f, count(*) FILTER (WHERE check_status = 'pending') AS p FROM item_checks GROUP BY 1) k USING (item_id)"""


def scorecard(spark, sf):
    o = orders_c(spark, sf)
    pairs = o.select("o_orderkey", "order_month", "o_orderpriority", "o_custkey", "c").join(candidate(spark, sf).select("o_orderkey", F.col("c").alias("a")), "o_orderkey")
    checks = pairs.groupBy(F.col("order_month").alias("item_id"), "o_orderpriority").agg(F.max(F.abs(F.col("c") - F.col("a")) > 100).alias("_b"), F.min("o_custkey").alias("_k"))
    checks = checks.withColumn("check_status", F.when(F.col("_b") & (F.col("_k") % 2 == 0), "failed").when(F.col("_k") % 3 == 0, "pending").otherwise("passed"))
    month = F.substring("item_id", 6, 2)
    items = o.select(F.col("order_month").alias("item_id")).distinct().select(
        "item_id", F.when(month == "02", "pending").when(month == "05", "unsupported").otherwise("mapped").alias("mapping_status"), F.col("item_id").startswith("1999-03").alias("is_stale"))
    extra = o.select("o_orderpriority").distinct().select(F.concat(F.lit("x"), "o_orderpriority").alias("item_id"), F.lit("mapped").alias("mapping_status"), F.lit(False).alias("is_stale"))
    return r.parity_scorecard(items.unionByName(extra), checks, ["item_id"])


@query("parity_scorecard", "SELECT item_id, case_count, is_required, status FROM scorecard")
def parity_scorecard(spark, sf):
    return scorecard(spark, sf)


@query("parity_scorecard_status", """
SELECT count(*) FILTER (WHERE status = 'pass') AS n_pass, count(*) FILTER (WHERE status = 'fail') AS n_fail, count(*) FILTER (WHERE status = 'pending') AS n_pending, count(*) FILTER (WHERE status = 'unsupported') AS n_unsupported,
       CASE max(CASE WHEN NOT is_required THEN 0 WHEN status = 'fail' THEN 3 WHEN status = 'unsupported' THEN 2 WHEN status = 'pending' THEN 1 ELSE 0 END) WHEN 3 THEN 'fail' WHEN 2 THEN 'unsupported' WHEN 1 THEN 'pending' ELSE 'pass' END AS overall FROM scorecard""")
def parity_scorecard_status(spark, sf):
    return r.scorecard_status(scorecard(spark, sf))


@query("result_contract_check", """
SELECT 'type:o_orderkey' AS rule, CAST(0 AS BIGINT) AS violations UNION ALL SELECT 'null:o_orderkey', 0
UNION ALL SELECT 'type:order_month', 0 UNION ALL SELECT 'null:order_month', 0 UNION ALL SELECT 'type:o_orderstatus', 0
UNION ALL SELECT 'null:o_orderstatus', count(*) FROM candidate WHERE o_orderstatus IS NULL
UNION ALL SELECT 'type:ratio', count(*) FROM candidate WHERE c % 1000 <> 0
UNION ALL SELECT 'duplicate_grain', count(*) FROM (SELECT order_month, o_orderstatus FROM candidate GROUP BY 1, 2 HAVING count(*) > 1)
UNION ALL SELECT 'metric:o_orderkey', 1""")
def result_contract_check(spark, sf):
    contract = r.ResultContract({
        "o_orderkey": r.ColumnRule("integer", False), "order_month": r.ColumnRule("date", False), "o_orderstatus": r.ColumnRule("string", False), "ratio": r.ColumnRule("integer")},
        ["order_month", "o_orderstatus"], metrics={"o_orderkey": 1})
    return r.contract_violations(candidate(spark, sf).select("o_orderkey", "order_month", "o_orderstatus", (F.col("c") / 1000).alias("ratio")), contract)


@query("value_coverage", """
SELECT p_brand, p_name, count(l.l_orderkey) AS n_exact_checks, count(l.l_orderkey) > 0 AS is_covered FROM (SELECT DISTINCT p_brand, p_name FROM part) f
LEFT JOIN (SELECT p_brand, p_name, l_orderkey FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_discount = 0 AND l_tax = 0) l USING (p_brand, p_name) GROUP BY 1, 2""")
def value_coverage(spark, sf):
    part = table(spark, sf, "part").select("p_partkey", "p_brand", "p_name")
    checks = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("p_partkey"), F.col("l_discount").alias("abs_tolerance"), F.col("l_tax").alias("rel_tolerance")).join(part, "p_partkey")
    return r.value_coverage(part.select("p_brand", "p_name").distinct(), checks, ["p_brand", "p_name"])


@query("multi_denominator_overlap", """
SELECT matched, in_a, in_b, in_a + in_b - matched AS in_union, CAST(matched AS DOUBLE) / in_a AS of_a, CAST(matched AS DOUBLE) / in_b AS of_b, CAST(matched AS DOUBLE) / (in_a + in_b - matched) AS of_union FROM (
  SELECT (SELECT count(*) FROM (SELECT o_custkey FROM orders INTERSECT SELECT user_id FROM events)) AS matched,
         (SELECT count(DISTINCT o_custkey) FROM orders) AS in_a, (SELECT count(DISTINCT user_id) FROM events) AS in_b)""")
def multi_denominator_overlap(spark, sf):
    buyers = table(spark, sf, "orders").select(F.col("o_custkey").alias("id"))
    return r.overlap_rates(buyers, table(spark, sf, "events").select(F.col("user_id").alias("id")), ["id"])
