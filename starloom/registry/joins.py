"""Joins."""

from pyspark.sql import functions as F

from starloom.functions.scalars import cents
from starloom.operators import joins as j
from starloom.operators.quality import overlapping_intervals
from starloom.operators.windows import time_slice
from starloom.registry import derived as d
from starloom.registry.base import query, table


@query("join_inner", """
SELECT i.tenant_id, i.invoice_id, c.entry_id, c.amount_cents FROM invoices i
JOIN credits c ON i.tenant_id = c.tenant_id AND i.invoice_id = c.invoice_id AND i.currency = c.currency""")
def join_inner(spark, sf):
    keys = ["tenant_id", "invoice_id", "currency"]
    return d.invoices(spark, sf).select(*keys).join(d.credits(spark, sf).select(*keys, "entry_id", "amount_cents"), keys).drop("currency")


@query("join_left", """
SELECT i.tenant_id, i.invoice_id, i.gross_cents, a.adjustment_cents FROM invoices i
LEFT JOIN adjustments a ON i.tenant_id = a.tenant_id AND i.invoice_id = a.invoice_id""")
def join_left(spark, sf):
    keys = ["tenant_id", "invoice_id"]
    return d.invoices(spark, sf).select(*keys, "gross_cents").join(d.adjustments(spark, sf).drop("reason"), keys, "left")


@query("join_full_outer", """
SELECT coalesce(c.nk, s.nk) AS nationkey, coalesce(c.band, s.band) AS band, c.n_customers, s.n_suppliers FROM
 (SELECT c_nationkey AS nk, CAST(floor(c_acctbal / 250) AS BIGINT) AS band, count(*) AS n_customers FROM customer GROUP BY 1, 2) c
 FULL OUTER JOIN (SELECT s_nationkey AS nk, CAST(floor(s_acctbal / 250) AS BIGINT) AS band, count(*) AS n_suppliers FROM supplier GROUP BY 1, 2) s ON c.nk = s.nk AND c.band = s.band""")
def join_full_outer(spark, sf):
    band = lambda c: F.floor(F.col(c) / 250).alias("band")
    c = table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("nationkey"), band("c_acctbal")).agg(F.count("*").alias("n_customers"))
    s = table(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("nationkey"), band("s_acctbal")).agg(F.count("*").alias("n_suppliers"))
    return c.join(s, ["nationkey", "band"], "full_outer")


@query("join_asof_interval", """
SELECT i.tenant_id, i.invoice_id, h.segment, CAST(CAST(h.valid_from AS DATE) AS VARCHAR) AS segment_since FROM invoices i
LEFT JOIN customer_history h ON i.tenant_id = h.tenant_id AND i.customer_id = h.customer_id
 AND i.issued_at >= h.valid_from AND (i.issued_at < h.valid_to OR h.valid_to IS NULL)""")
def join_asof_interval(spark, sf):
    inv = d.invoices(spark, sf).select("tenant_id", "invoice_id", "customer_id", "issued_at")
    joined = j.join_as_of(inv, d.customer_history(spark, sf), ["tenant_id", "customer_id"], "issued_at", F.year, until=d.latest_issue(spark, sf))
    return joined.select("tenant_id", "invoice_id", "segment", F.col("valid_from").cast("date").cast("string").alias("segment_since"))


@query("join_asof_sliced", """
SELECT i.tenant_id, i.invoice_id, h.segment, CAST(CAST(h.valid_from AS DATE) AS VARCHAR) AS segment_since FROM invoices i
LEFT JOIN customer_history h ON i.tenant_id = h.tenant_id AND i.customer_id = h.customer_id
 AND i.issued_at >= h.valid_from AND (i.issued_at < h.valid_to OR h.valid_to IS NULL)""")
def join_asof_sliced(spark, sf):
    inv = d.invoices(spark, sf).select("tenant_id", "invoice_id", "customer_id", "issued_at")
    joined = j.join_as_of_sliced(inv, d.customer_history(spark, sf), ["tenant_id", "customer_id"], "issued_at", lambda t: time_slice(t, "year"))
    return joined.select("tenant_id", "invoice_id", "segment", F.col("valid_from").cast("date").cast("string").alias("segment_since"))


@query("join_unknown_member", """
SELECT i.tenant_id, i.invoice_id, coalesce(h.customer_key, md5(i.tenant_id || ':__UNKNOWN__')) AS customer_key FROM invoices i
LEFT JOIN dim_customers h ON i.tenant_id = h.tenant_id AND i.customer_id = h.customer_id
 AND i.issued_at >= h.valid_from AND (i.issued_at < h.valid_to OR h.valid_to IS NULL)""")
def join_unknown_member(spark, sf):
    inv = d.invoices(spark, sf).select("tenant_id", "invoice_id", "customer_id", "issued_at")
    joined = j.join_as_of(inv, d.dim_customers(spark, sf), ["tenant_id", "customer_id"], "issued_at", F.year, until=d.latest_issue(spark, sf))
    return j.with_unknown_member(joined, "customer_key", "tenant_id").select("tenant_id", "invoice_id", "customer_key")


@query("join_validated_m1", """
SELECT o_orderkey, c_mktsegment, n_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey""")
def join_validated_m1(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    c = table(spark, sf, "customer").select("c_custkey", "c_mktsegment", F.col("c_nationkey").alias("n_nationkey"))
    joined = j.join_many_to_one(o, c, ["c_custkey"])
    return j.join_many_to_one(joined, table(spark, sf, "nation"), ["n_nationkey"]).select("o_orderkey", "c_mktsegment", "n_name")


@query("join_strict_m1", """
SELECT i.tenant_id, i.invoice_id, p.entry_id, i.status FROM payments p JOIN invoices i ON p.tenant_id = i.tenant_id AND p.invoice_id = i.invoice_id
WHERE p.status = 'posted'""")
def join_strict_m1(spark, sf):
    """Payments of invoices that still exist, then the strict join has to hold."""
    inv = d.invoices(spark, sf).select("invoice_id", "tenant_id", F.col("status").alias("invoice_status"))
    paid = d.payments(spark, sf).where("status = 'posted'").join(inv.select("invoice_id"), "invoice_id", "left_semi").select("entry_id", "tenant_id", "invoice_id")
    return j.join_strict(paid, inv, ["invoice_id"], tenant="tenant_id").select("tenant_id", "invoice_id", "entry_id", F.col("invoice_status").alias("status"))


_OVERLAP = """
WITH o AS (SELECT *, coalesce(valid_to, TIMESTAMP '9999-12-31 00:00:00') AS ends FROM overlapping)
SELECT b.tenant_id, b.customer_id, strftime(b.valid_from, '%Y-%m-%d %H:%M:%S') AS starts, b.segment, strftime(max(a.ends), '%Y-%m-%d %H:%M:%S') AS covered_until
FROM o b JOIN o a ON a.tenant_id = b.tenant_id AND a.customer_id = b.customer_id AND (a.valid_from, a.ends, a.segment) < (b.valid_from, b.ends, b.segment) AND b.valid_from < a.ends
GROUP BY b.tenant_id, b.customer_id, b.valid_from, b.valid_to, b.segment"""
d.CTES["overlapping"] = """
SELECT tenant_id, customer_id, CASE WHEN valid_from <= TIMESTAMP '1993-01-01' THEN valid_from WHEN segment = 'FURNITURE' THEN valid_from - INTERVAL 40 DAY
       WHEN segment = 'MACHINERY' THEN valid_from - INTERVAL 6 HOUR ELSE valid_from END AS valid_from, valid_to, segment
FROM customer_history"""


def overlapping_history(spark, sf):
    """History in which the later interval of one segment starts 40 days early, that of another six hours."""
    later = F.col("valid_from") > F.lit("1993-01-01").cast("timestamp_ntz")
    moved = (F.when(later & (F.col("segment") == "FURNITURE"), F.col("valid_from") - F.expr("interval 40 days"))
             .when(later & (F.col("segment") == "MACHINERY"), F.col("valid_from") - F.expr("interval 6 hours")).otherwise(F.col("valid_from")))
    return d.customer_history(spark, sf).withColumn("valid_from", moved)


def _overlaps(spark, sf):
    rows = overlapping_intervals(overlapping_history(spark, sf), ["tenant_id", "customer_id"], "valid_from", "valid_to")
    at = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return rows.select("tenant_id", "customer_id", at("valid_from").alias("starts"), "segment", at("covered_until").alias("covered_until"))


query("join_self_overlap", _OVERLAP)(_overlaps)
query("dq_interval_overlap", _OVERLAP)(lambda spark, sf: _overlaps(spark, sf))


@query("join_role_aliases", """
SELECT b.n_name AS buyer_n_name, s.n_name AS seller_n_name, count(*) AS n_lines, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS amount_cents
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
LEFT JOIN nation b ON c_nationkey = b.n_nationkey LEFT JOIN nation s ON s_nationkey = s.n_nationkey GROUP BY 1, 2""")
def join_role_aliases(spark, sf):
    """Lines collapse to (buyer nation, seller nation) before the dimension is joined in its two roles."""
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_suppkey", cents("l_extendedprice").alias("_c"))
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("c_custkey"))
    c = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    facts = li.join(o, "l_orderkey").join(c, "c_custkey").join(s, "l_suppkey").groupBy("c_nationkey", "s_nationkey").agg(F.count("*").alias("n_lines"), F.sum("_c").alias("amount_cents"))
    named = j.join_roles(facts, table(spark, sf, "nation").select("n_nationkey", "n_name"), "n_nationkey", {"buyer": "c_nationkey", "seller": "s_nationkey"})
    return named.drop("c_nationkey", "s_nationkey")


@query("join_lod", """
SELECT o_orderkey, o_custkey, CAST(round(o_totalprice * 100) AS BIGINT) AS order_cents,
       CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) OVER (PARTITION BY o_custkey) AS BIGINT) AS customer_cents FROM orders""")
def join_lod(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", cents("o_totalprice").alias("order_cents"))
    return j.join_lod(o, ["o_custkey"], [F.sum("order_cents").alias("customer_cents")])


@query("join_topic_tree", """
WITH classes AS (SELECT s_nationkey, s_acctbal < 0 AS in_debt, count(*) AS n FROM supplier GROUP BY 1, 2),
priorities AS (SELECT o_custkey, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2)
SELECT n_name AS nation__n_name, in_debt AS classes__in_debt, o_orderpriority AS priorities__o_orderpriority, count(DISTINCT c_custkey) AS n_customers, CAST(sum(p.n) AS BIGINT) AS n_orders, CAST(max(k.n) AS BIGINT) AS n_suppliers
FROM nation LEFT JOIN classes k ON s_nationkey = n_nationkey LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN priorities p ON o_custkey = c_custkey GROUP BY 1, 2, 3""")
def join_topic_tree(spark, sf):
    """From nations outward: two one-to-many edges at the base and a third below, each checked on its own view.

    The child facts are summed to a few rows per parent before they meet, so nothing multiplies with the data.
    """
    t = lambda n: table(spark, sf, n)
    views = {
        "nation": t("nation").select("n_nationkey", "n_name"), "customer": t("customer").select("c_custkey", "c_nationkey"),
        "classes": t("supplier").groupBy("s_nationkey", (F.col("s_acctbal") < 0).alias("in_debt")).agg(F.count("*").alias("n")),
        "priorities": t("orders").groupBy("o_custkey", "o_orderpriority").agg(F.count("*").alias("n"))}
    edges = [j.Edge("nation", "classes", ("n_nationkey",), ("s_nationkey",), relationship="one_to_many"),
             j.Edge("customer", "nation", ("c_nationkey",), ("n_nationkey",)), j.Edge("priorities", "customer", ("o_custkey",), ("c_custkey",))]
    tree = j.join_tree(views, "nation", edges, ["classes", "customer", "priorities"])
    return tree.groupBy("nation__n_name", "classes__in_debt", "priorities__o_orderpriority").agg(
        F.count_distinct("customer__c_custkey").alias("n_customers"), F.sum("priorities__n").alias("n_orders"), F.max("classes__n").alias("n_suppliers"))


@query("join_declared_types", """
SELECT 'always_left' AS join_type, count(*) AS n_rows, count(s_suppkey) AS n_matched FROM nation LEFT JOIN supplier ON n_nationkey = s_nationkey
UNION ALL SELECT 'inner', count(*), count(n_name) FROM customer JOIN nation ON c_nationkey = n_nationkey
UNION ALL SELECT 'full_outer', count(*), count(l.doc_id) FROM documents d FULL OUTER JOIN labels l ON d.doc_id = l.doc_id
UNION ALL SELECT 'always_inner', count(*), count(r_name) FROM nation JOIN region ON n_regionkey = r_regionkey
UNION ALL SELECT 'left', count(*), count(c_name) FROM orders LEFT JOIN customer ON o_custkey = c_custkey""")
def join_declared_types(spark, sf):
    t = lambda name: table(spark, sf, name)
    lab = t("labels").withColumnRenamed("doc_id", "label_doc")
    cases = [
        ("always_left", t("nation"), t("supplier"), [("n_nationkey", "s_nationkey")], "one_to_many", "s_suppkey"),
        ("inner", t("customer"), t("nation"), [("c_nationkey", "n_nationkey")], "many_to_one", "n_name"),
        ("full_outer", t("documents"), lab, [("doc_id", "label_doc")], "one_to_one", "label_doc"),
        ("always_inner", t("nation"), t("region"), [("n_regionkey", "r_regionkey")], "many_to_one", "r_name"),
        ("left", t("orders"), t("customer"), [("o_custkey", "c_custkey")], "assumed_many_to_one", "c_name"),
    ]
    out = None
    for kind, left, right, on, rel, seen in cases:
        row = j.join_declared(left, right, on, kind, rel).agg(F.count("*").alias("n_rows"), F.count(seen).alias("n_matched")).select(F.lit(kind).alias("join_type"), "*")
        out = row if out is None else out.unionByName(row)
    return out


@query("join_anti", """
SELECT p.entry_id, p.tenant_id, p.invoice_id FROM payments p LEFT JOIN invoices i ON p.tenant_id = i.tenant_id AND p.invoice_id = i.invoice_id WHERE i.invoice_id IS NULL""")
def join_anti(spark, sf):
    keys = ["tenant_id", "invoice_id"]
    return d.payments(spark, sf).select("entry_id", *keys).join(d.invoices(spark, sf).select(*keys), keys, "left_anti")


@query("join_exactly_one", """
SELECT i.invoice_id, count(p.entry_id) AS n_matches FROM invoices i LEFT JOIN payments p ON i.tenant_id = p.tenant_id AND i.invoice_id = p.invoice_id
GROUP BY i.tenant_id, i.invoice_id HAVING count(p.entry_id) <> 1""")
def join_exactly_one(spark, sf):
    """Match counts come from one pre-aggregate, so the join cannot multiply rows."""
    inv = d.invoices(spark, sf).select("tenant_id", "invoice_id")
    counted = j.match_counts(inv, d.payments(spark, sf).select("tenant_id", "invoice_id"), ["tenant_id", "invoice_id"])
    return counted.where("n_matches <> 1").select("invoice_id", "n_matches")


@query("join_multiplicity", """
SELECT n_matches, count(*) AS left_rows, CAST(sum(gross_cents) AS BIGINT) AS measure_before, CAST(sum(gross_cents * n_matches) AS BIGINT) AS measure_after FROM (
 SELECT i.gross_cents, count(p.entry_id) AS n_matches FROM invoices i LEFT JOIN payments p ON i.tenant_id = p.tenant_id AND i.invoice_id = p.invoice_id
 GROUP BY i.tenant_id, i.invoice_id, i.gross_cents) GROUP BY 1""")
def join_multiplicity(spark, sf):
    keys = ["tenant_id", "invoice_id"]
    return j.multiplicity(d.invoices(spark, sf).select(*keys, "gross_cents"), d.payments(spark, sf).select(*keys), keys, "gross_cents")
