"""Projections, filters, predicates."""

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from starloom.functions.scalars import cents
from starloom.operators import filters as f
from starloom.registry import derived as d
from starloom.registry.base import query, table


@query("project_exprs", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, e AS gross_cents, e * d // 100 AS discount_cents,
       e - e * d // 100 AS net_cents
FROM (SELECT k AS l_orderkey, l_linenumber, l_partkey, l_suppkey, e, d FROM line_base)""")
def project_exprs(spark, sf):
    li = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", cents("l_extendedprice").alias("gross_cents"), cents("l_discount").alias("_d"))
    return li.withColumns({
        "discount_cents": F.expr("gross_cents * _d div 100"),
        "net_cents": F.col("gross_cents") - F.expr("gross_cents * _d div 100"),
    }).drop("_d")


@query("rename_outputs", "SELECT c_custkey AS customer_id, c_name AS customer_name, c_mktsegment AS segment FROM customer")
def rename_outputs(spark, sf):
    return f.rename_outputs(table(spark, sf, "customer"), {"c_custkey": "customer_id", "c_name": "customer_name", "c_mktsegment": "segment"})


@query("filter_is", """
SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders
WHERE o_orderstatus = 'F' AND o_orderpriority IN ('1-URGENT', '2-HIGH')""")
def filter_is(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    return f.filter_by(o, {"o_orderstatus": {"is": "F"}, "o_orderpriority": {"is": ["1-URGENT", "2-HIGH"]}})


@query("filter_not", """
SELECT d.doc_id, l.quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
WHERE (l.quality IS NULL OR l.quality <> 1) AND d.lang NOT IN ('de', 'fr')""")
def filter_not(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang").join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "left")
    return f.filter_by(docs, {"quality": {"not": 1}, "lang": {"not": ["de", "fr"]}}).select("doc_id", "quality")


@query("filter_compare", """
SELECT p_partkey, p_size, p_retailprice FROM part WHERE p_size > 10 AND p_size <= 40 AND p_retailprice >= 950 AND p_retailprice < 1200""")
def filter_compare(spark, sf):
    part = table(spark, sf, "part").select("p_partkey", "p_size", "p_retailprice")
    return f.filter_by(part, {
        "p_size": {"greater_than": 10, "less_than_or_equal_to": 40},
        "p_retailprice": {"greater_than_or_equal_to": 950, "less_than": 1200},
    })


@query("filter_text", """
SELECT p_partkey, p_name, p_brand FROM part
WHERE contains(p_name, 'e') AND NOT contains(p_name, 'small') AND p_brand LIKE 'Brand#1%' AND p_name LIKE '%t'""")
def filter_text(spark, sf):
    part = table(spark, sf, "part").select("p_partkey", "p_name", "p_brand")
    return f.filter_by(part, {"p_name": {"contains": "e", "not_contains": "small", "ends_with": "t"}, "p_brand": {"starts_with": "Brand#1"}})


@query("filter_date_range", """
SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS order_date FROM orders
WHERE o_orderdate >= DATE '1997-03-01' AND o_orderdate < DATE '1997-07-01'""")
def filter_date_range(spark, sf):
    o = table(spark, sf, "orders").where(f.date_range("o_orderdate", "1997-03-01", "1997-06-30", inclusive_end=True))
    return o.select("o_orderkey", F.col("o_orderdate").cast("date").cast("string").alias("order_date"))


@query("filter_optional", "SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders WHERE o_orderpriority = '3-MEDIUM'")
def filter_optional(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    return o.where(f.optional("o_orderpriority", "3-MEDIUM") & f.optional("o_orderstatus", "ALL") & f.optional("o_orderkey", None))


@query("filter_in_set", """
SELECT 'some' AS scenario, count(*) AS n FROM events WHERE event_type IN ('click', 'view')
UNION ALL SELECT 'none', count(*) FROM events WHERE false""")
def filter_in_set(spark, sf):
    e = table(spark, sf, "events").select("event_type")
    count = lambda name, values: e.where(f.in_set("event_type", values)).agg(F.count("*").alias("n")).select(F.lit(name).alias("scenario"), "n")
    return count("some", ["click", "view"]).unionByName(count("none", []))


@query("always_where", """
SELECT o_orderpriority, count(*) AS n_orders FROM orders
WHERE o_orderstatus <> 'P' AND o_orderdate >= DATE '1996-01-01' AND o_orderdate < DATE '1998-01-01' GROUP BY 1""")
def always_where(spark, sf):
    fixed = {"o_orderstatus": {"not": "P"}}
    defaults = {"o_orderdate": {"between_dates": ("1996-01-01", "1998-01-01")}}
    return f.filter_by(table(spark, sf, "orders"), {**fixed, **defaults}).groupBy("o_orderpriority").agg(F.count("*").alias("n_orders"))


@query("default_filters", """
SELECT o_orderpriority, count(*) AS n_orders FROM orders
WHERE o_orderstatus <> 'P' AND o_orderdate >= DATE '1999-01-01' AND o_orderdate < DATE '2000-01-01' GROUP BY 1""")
def default_filters(spark, sf):
    """A query filter replaces the topic's default filter on that field; the fixed filter stays."""
    fixed = {"o_orderstatus": {"not": "P"}}
    defaults = {"o_orderdate": {"between_dates": ("1996-01-01", "1998-01-01")}}
    asked = {"o_orderdate": {"between_dates": ("1999-01-01", "2000-01-01")}}
    return f.filter_by(table(spark, sf, "orders"), {**fixed, **{**defaults, **asked}}).groupBy("o_orderpriority").agg(F.count("*").alias("n_orders"))


@query("qualify_filter", """
SELECT order_month, o_orderpriority, total_cents FROM (
  SELECT strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS order_month, o_orderpriority,
         CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS total_cents FROM orders GROUP BY 1, 2)
QUALIFY row_number() OVER (PARTITION BY order_month ORDER BY total_cents DESC, o_orderpriority) <= 2""")
def qualify_filter(spark, sf):
    marks = table(spark, sf, "orders").groupBy(
        F.trunc(F.col("o_orderdate").cast("date"), "month").cast("string").alias("order_month"), "o_orderpriority",
    ).agg(F.sum(cents("o_totalprice")).alias("total_cents"))
    w = W.partitionBy("order_month").orderBy(F.desc("total_cents"), "o_orderpriority")
    return f.qualify(marks, F.row_number().over(w), lambda rn: rn <= 2)


@query("case_when", """
SELECT o_orderkey, CASE WHEN o_totalprice >= 300000 THEN 'large' WHEN o_totalprice >= 100000 THEN 'medium' ELSE 'small' END AS size_band FROM orders""")
def case_when(spark, sf):
    band = F.when(F.col("o_totalprice") >= 300000, "large").when(F.col("o_totalprice") >= 100000, "medium").otherwise("small")
    return table(spark, sf, "orders").select("o_orderkey", band.alias("size_band"))


@query("filtered_value", """
SELECT invoice_id, CASE WHEN status = 'posted' THEN gross_cents END AS posted_cents FROM invoices""")
def filtered_value(spark, sf):
    return d.invoices(spark, sf).select("invoice_id", F.when(F.col("status") == "posted", F.col("gross_cents")).alias("posted_cents"))


@query("three_valued_logic", """
SELECT coalesce(CAST(both_ok AS VARCHAR), 'null') AS both_ok, coalesce(CAST(any_ok AS VARCHAR), 'null') AS any_ok, coalesce(CAST(not_toxic AS VARCHAR), 'null') AS not_toxic, count(*) AS n FROM (
  SELECT (l.quality = 1 AND d.lang = 'en') AS both_ok, (l.quality = 1 OR d.lang = 'en') AS any_ok, NOT (l.toxic = 1) AS not_toxic
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id) GROUP BY ALL""")
def three_valued_logic(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang").join(table(spark, sf, "labels"), "doc_id", "left")
    good, english = F.col("quality") == 1, F.col("lang") == "en"
    shown = lambda test, name: F.coalesce(test.cast("string"), F.lit("null")).alias(name)
    flags = docs.select(shown(good & english, "both_ok"), shown(good | english, "any_ok"), shown(~(F.col("toxic") == 1), "not_toxic"))
    return flags.groupBy("both_ok", "any_ok", "not_toxic").agg(F.count("*").alias("n"))


@query("semi_reference_filter", """
SELECT p.entry_id, p.tenant_id, p.invoice_id, p.currency, p.amount_cents FROM payments p
WHERE EXISTS (SELECT 1 FROM invoices i WHERE i.tenant_id = p.tenant_id AND i.invoice_id = p.invoice_id AND i.currency = p.currency)""")
def semi_reference_filter(spark, sf):
    keys = ["tenant_id", "invoice_id", "currency"]
    kept = d.payments(spark, sf).join(d.invoices(spark, sf).select(*keys), keys, "left_semi")
    return kept.select("entry_id", "tenant_id", "invoice_id", "currency", "amount_cents")
