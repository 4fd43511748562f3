"""Data contracts."""

from pyspark.sql import functions as F

from starloom.functions.scalars import cents, identifier
from starloom.operators import quality as q
from starloom.operators.sets import union_checks
from starloom.registry import derived as d
from starloom.registry import modelling as m
from starloom.registry.aggregates import orders_c
from starloom.registry.base import CTES, query, table


@query("dq_grain", """
SELECT 'line_grain' AS issue, l_orderkey || '|' || l_linenumber AS entity, count(*) AS n_rows FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) <> 1
UNION ALL SELECT 'name_grain', p_name, count(*) FROM part GROUP BY p_name HAVING count(*) <> 1
UNION ALL SELECT 'invoice_grain', tenant_id || '|' || invoice_id, count(*) FROM invoices GROUP BY tenant_id, invoice_id HAVING count(*) <> 1
UNION ALL SELECT 'dimension_grain', coalesce(customer_id, '<null>') || '|' || tenant_id, count(*) FROM dim_customers GROUP BY tenant_id, customer_id HAVING count(*) <> 1 OR customer_id IS NULL""")
def dq_grain(spark, sf):
    return union_checks([
        q.grain(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"], "line_grain"), q.grain(table(spark, sf, "part"), ["p_name"], "name_grain"),
        q.grain(d.invoices(spark, sf), ["tenant_id", "invoice_id"], "invoice_grain"), q.grain(d.dim_customers(spark, sf), ["customer_id", "tenant_id"], "dimension_grain")])


CTES["flawed_log"] = """
SELECT k, CASE WHEN os = 'O' AND op = '1-URGENT' THEN '' ELSE tenant_id END AS tenant_id, CASE WHEN op = '2-HIGH' AND os = 'P' THEN NULL ELSE invoice_id END AS invoice_id,
       CASE WHEN op = '5-LOW' AND os = 'F' THEN 'C|' || k ELSE customer_id END AS customer_id, CASE WHEN op = '4-NOT SPECIFIED' AND os = 'O' THEN 0 ELSE 1 END AS seq,
       CASE WHEN os = 'P' THEN NULL ELSE g END AS amount FROM inv_base"""


def flawed_log(spark, sf):
    o = table(spark, sf, "orders")
    os_, pr = F.col("o_orderstatus"), F.col("o_orderpriority")
    return o.select(
        F.col("o_orderkey").alias("k"), F.when((os_ == "O") & (pr == "1-URGENT"), "").otherwise(d.tenant_of("o_orderkey")).alias("tenant_id"),
        F.when(~((pr == "2-HIGH") & (os_ == "P")), d.text("I", "o_orderkey")).alias("invoice_id"),
        F.when((pr == "5-LOW") & (os_ == "F"), d.text("C|", "o_orderkey")).otherwise(d.text("C", "o_custkey")).alias("customer_id"),
        F.when((pr == "4-NOT SPECIFIED") & (os_ == "O"), 0).otherwise(1).alias("seq"), F.when(os_ != "P", cents("o_totalprice")).alias("amount"))


@query("dq_required_values", """
SELECT CAST(k AS VARCHAR) AS entity, 'tenant_blank_or_unsafe' AS issue FROM flawed_log WHERE tenant_id IS NULL OR tenant_id = '' OR tenant_id LIKE '%|%'
UNION ALL SELECT CAST(k AS VARCHAR), 'invoice_blank_or_unsafe' FROM flawed_log WHERE invoice_id IS NULL OR invoice_id = '' OR invoice_id LIKE '%|%'
UNION ALL SELECT CAST(k AS VARCHAR), 'customer_blank_or_unsafe' FROM flawed_log WHERE customer_id IS NULL OR customer_id = '' OR customer_id LIKE '%|%'
UNION ALL SELECT CAST(k AS VARCHAR), 'sequence_not_positive' FROM flawed_log WHERE seq IS NULL OR seq < 1
UNION ALL SELECT CAST(k AS VARCHAR), 'amount_missing' FROM flawed_log WHERE amount IS NULL""")
def dq_required_values(spark, sf):
    return q.required_values(flawed_log(spark, sf), F.col("k"), {
        "tenant_blank_or_unsafe": q.blank_or_unsafe("tenant_id"), "invoice_blank_or_unsafe": q.blank_or_unsafe("invoice_id"), "customer_blank_or_unsafe": q.blank_or_unsafe("customer_id"),
        "sequence_not_positive": F.col("seq").isNull() | (F.col("seq") < 1), "amount_missing": F.col("amount").isNull()})


@query("dq_orphans", """
SELECT entry_id, tenant_id, invoice_id FROM credits c WHERE NOT EXISTS (SELECT 1 FROM invoices i WHERE i.tenant_id = c.tenant_id AND i.invoice_id = c.invoice_id)""")
def dq_orphans(spark, sf):
    keys = ["tenant_id", "invoice_id"]
    return q.orphans(d.credits(spark, sf).select("entry_id", *keys), d.invoices(spark, sf).select(*keys), keys)


@query("dq_interval_valid", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderdate >= l_shipdate""")
def dq_interval_valid(spark, sf):
    spans = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate").join(
        table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate"), "l_orderkey")
    return q.invalid_intervals(spans, "o_orderdate", "l_shipdate").drop("o_orderdate", "l_shipdate")


@query("dq_exactly_one_match", """
SELECT i.tenant_id, i.invoice_id, count(h.valid_from) AS n_matches FROM invoices i LEFT JOIN overlapping h ON i.tenant_id = h.tenant_id AND i.customer_id = h.customer_id
 AND i.issued_at >= h.valid_from AND (i.issued_at < h.valid_to OR h.valid_to IS NULL) GROUP BY 1, 2 HAVING count(h.valid_from) <> 1""")
def dq_exactly_one_match(spark, sf):
    from starloom.registry.joins import overlapping_history

    inv = d.invoices(spark, sf).select("tenant_id", "invoice_id", "customer_id", "issued_at")
    return q.match_count_violations(inv, overlapping_history(spark, sf), ["tenant_id", "customer_id"], ["tenant_id", "invoice_id"], "issued_at")


@query("dq_unique_no_dedupe", "SELECT tenant_id, customer_id, valid_from, count(*) AS n_rows FROM customer_history_raw GROUP BY 1, 2, 3 HAVING count(*) > 1")
def dq_unique_no_dedupe(spark, sf):
    from starloom.operators.joins import duplicate_keys

    return duplicate_keys(d.customer_history_raw(spark, sf), ["tenant_id", "customer_id", "valid_from"])


@query("dq_sum_reconciliation", """
SELECT o_orderkey, c, CAST(coalesce(t, 0) AS BIGINT) AS child_total FROM orders_c LEFT JOIN (SELECT l_orderkey, sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS t FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey
WHERE c <> coalesce(t, 0)""")
def dq_sum_reconciliation(spark, sf):
    lines = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), cents("l_extendedprice").alias("e"))
    return q.sum_mismatch(orders_c(spark, sf), lines, ["o_orderkey"], "c", "e")


@query("dq_row_identity", """
SELECT tenant_id, invoice_id, 'nothing_outstanding' AS identity FROM fct_adjusted WHERE outstanding_cents <> 0
UNION ALL SELECT tenant_id, invoice_id, 'net_is_amount_plus_adjustment' FROM fct_adjusted WHERE net_cents <> amount_cents + adjustment_cents""")
def dq_row_identity(spark, sf):
    return q.broken_identity(m.adjusted(spark, sf), ["tenant_id", "invoice_id"], {
        "nothing_outstanding": F.col("outstanding_cents") == 0,
        "net_is_amount_plus_adjustment": F.col("net_cents") == F.col("amount_cents") + F.col("adjustment_cents")})


@query("dq_quantity_chain", """
SELECT line_key, ordered_quantity, fulfilled_quantity, returned_quantity FROM (SELECT line_key, ordered_quantity, fulfilled_quantity, returned_quantity * 3 AS returned_quantity FROM fct_fulfillment)
WHERE fulfilled_quantity > ordered_quantity OR returned_quantity > fulfilled_quantity OR fulfilled_quantity < 0 OR returned_quantity < 0""")
def dq_quantity_chain(spark, sf):
    f = m.fulfillment(spark, sf).select("line_key", "ordered_quantity", "fulfilled_quantity", (F.col("returned_quantity") * 3).alias("returned_quantity"))
    return f.where("fulfilled_quantity > ordered_quantity OR returned_quantity > fulfilled_quantity OR fulfilled_quantity < 0 OR returned_quantity < 0")


@query("dq_fact_coverage", """
SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey, CASE WHEN b.o_orderkey IS NULL THEN 'missing_in_fact' WHEN a.o_orderkey IS NULL THEN 'missing_in_source' ELSE 'value_drift' END AS issue
FROM (SELECT CASE WHEN o_orderpriority = '5-LOW' THEN -1 - o_orderkey ELSE o_orderkey END AS o_orderkey, c FROM orders_c) a FULL OUTER JOIN (SELECT CASE WHEN c < 45000000 THEN o_orderkey ELSE 10000000000 + o_orderkey END AS o_orderkey, c FROM lane_orders) b ON a.o_orderkey = b.o_orderkey
WHERE a.o_orderkey IS NULL OR b.o_orderkey IS NULL OR a.c <> b.c""")
def dq_fact_coverage(spark, sf):
    from starloom.registry.sets import lane_orders

    key, moved = F.col("o_orderkey"), F.lit(10_000_000_000)
    source = orders_c(spark, sf).withColumn("o_orderkey", F.when(F.col("o_orderpriority") == "5-LOW", -1 - key).otherwise(key))
    fact = lane_orders(spark, sf).withColumn("o_orderkey", F.when(F.col("c") < 45000000, key).otherwise(moved + key))
    return q.coverage_drift(source, fact, ["o_orderkey"], ["c"])


@query("dq_currency_match", """
SELECT p.entry_id, p.currency, i.currency AS parent_currency FROM payments p JOIN invoices i ON p.tenant_id = i.tenant_id AND p.invoice_id = i.invoice_id WHERE p.currency <> i.currency AND p.status = 'posted'""")
def dq_currency_match(spark, sf):
    out = q.parent_mismatch(d.payments(spark, sf).where("status = 'posted'"), d.invoices(spark, sf), ["tenant_id", "invoice_id"], "currency")
    return out.select("entry_id", "currency", "parent_currency")


@query("dq_cross_tenant", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, sn.n_regionkey AS region_id, cn.n_regionkey AS parent_region_id
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation sn ON s_nationkey = sn.n_nationkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
JOIN nation cn ON c_nationkey = cn.n_nationkey WHERE sn.n_regionkey <> cn.n_regionkey""")
def dq_cross_tenant(spark, sf):
    region = lambda c: table(spark, sf, "nation").select(F.col("n_nationkey").alias(c), F.col("n_regionkey").alias("region_id"))
    supplier = table(spark, sf, "supplier").join(region("s_nationkey"), "s_nationkey").select(F.col("s_suppkey").alias("l_suppkey"), "region_id")
    customer = table(spark, sf, "customer").join(region("c_nationkey"), "c_nationkey").select(F.col("c_custkey").alias("o_custkey"), "region_id")
    orders = table(spark, sf, "orders").join(customer, "o_custkey").select(F.col("o_orderkey").alias("l_orderkey"), "region_id")
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").join(supplier, "l_suppkey")
    return q.parent_mismatch(lines, orders, ["l_orderkey"], "region_id")


@query("dq_type_contract", """
WITH cells AS (SELECT o_orderkey AS k, CASE WHEN o_orderstatus = 'P' THEN '99999999999999999999' ELSE CAST(o_orderkey AS VARCHAR) END AS amount, CASE WHEN o_orderpriority = '2-HIGH' THEN 'yes' ELSE 'true' END AS flag,
  CASE WHEN o_orderpriority = '1-URGENT' THEN '1998-2-30' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS day, CASE WHEN o_orderstatus = 'O' THEN 'a-' || o_orderkey ELSE 'a' || o_orderkey END AS id FROM orders)
SELECT CAST(k AS VARCHAR) AS entity, 'signed_64_bit' AS issue FROM cells WHERE TRY_CAST(amount AS BIGINT) IS NULL
UNION ALL SELECT CAST(k AS VARCHAR), 'boolean' FROM cells WHERE flag NOT IN ('true', 'false')
UNION ALL SELECT CAST(k AS VARCHAR), 'iso_date' FROM cells WHERE TRY_CAST(day AS DATE) IS NULL
UNION ALL SELECT CAST(k AS VARCHAR), 'identifier' FROM cells WHERE NOT regexp_full_match(id, '[A-Za-z0-9]+')""")
def dq_type_contract(spark, sf):
    pr, os_ = F.col("o_orderpriority"), F.col("o_orderstatus")
    cells = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("k"), F.when(os_ == "P", "99999999999999999999").otherwise(F.col("o_orderkey").cast("string")).alias("amount"),
        F.when(pr == "2-HIGH", "yes").otherwise("true").alias("flag"), F.when(pr == "1-URGENT", "1998-2-30").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("day"),
        F.when(os_ == "O", d.text("a-", "o_orderkey")).otherwise(d.text("a", "o_orderkey")).alias("id"))
    return q.type_violations(cells, F.col("k"), {
        "signed_64_bit": q.fits_long("amount"), "boolean": q.fits_boolean("flag"), "iso_date": q.fits_iso_date("day"), "identifier": q.fits_identifier("id")})


@query("dq_not_null_unique", """
SELECT 'quality' AS column_name, 'not_null' AS test, count(*) FILTER (WHERE quality IS NULL) AS failures FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
UNION ALL SELECT 'source', 'not_null', count(*) FILTER (WHERE source IS NULL) FROM documents
UNION ALL SELECT 'doc_id', 'unique', count(*) FROM (SELECT doc_id FROM documents GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT 'n_chars', 'unique', count(*) FROM (SELECT n_chars FROM documents GROUP BY 1 HAVING count(*) > 1)""")
def dq_not_null_unique(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "source", "n_chars").join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "left")
    return q.column_tests(docs, ["quality", "source"], ["doc_id", "n_chars"])


@query("dq_known_values", """
SELECT lang AS value, count(*) AS n_rows FROM documents WHERE lang NOT IN (SELECT DISTINCT d.lang FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE l.toxic = 1 AND l.quality = 0) GROUP BY 1""")
def dq_known_values(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang")
    known = docs.join(table(spark, sf, "labels").where("toxic = 1 AND quality = 0"), "doc_id", "left_semi")
    return q.unknown_values(docs, "lang", known, "lang")


@query("dq_key_normalization_collision", """
WITH spelled AS (SELECT CASE WHEN p_size % 2 = 0 THEN upper(p_name) ELSE p_name END AS raw FROM part UNION ALL SELECT CASE WHEN p_size > 25 THEN replace(p_name, ' ', '-') ELSE p_name END FROM part)
SELECT trim(regexp_replace(lower(trim(raw)), '[^a-z0-9]+', '_', 'g'), '_') AS normalized, count(DISTINCT raw) AS n_spellings FROM spelled GROUP BY 1 HAVING count(DISTINCT raw) > 1""")
def dq_key_normalization_collision(spark, sf):
    p = table(spark, sf, "part").select("p_name", "p_size")
    spellings = F.array(F.when(F.col("p_size") % 2 == 0, F.upper("p_name")).otherwise(F.col("p_name")), F.when(F.col("p_size") > 25, F.replace("p_name", F.lit(" "), F.lit("-"))).otherwise(F.col("p_name")))
    return q.normalization_collisions(p.select(F.explode(spellings).alias("raw")), "raw", identifier("raw"))


_PROFILE = " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(*) AS n_rows, count(*) FILTER (WHERE {c} IS NULL) AS n_nulls, count(*) FILTER (WHERE trim(CAST({c} AS VARCHAR)) = '') AS n_blanks, "
    f"count(DISTINCT {c}) AS n_distinct, count({c}) - count(DISTINCT {c}) AS n_duplicates, CAST(min({c}) AS VARCHAR) AS min_text, CAST(max({c}) AS VARCHAR) AS max_text FROM labelled"
    for c in ("doc_id", "lang", "source", "n_chars", "quality", "toxic"))
CTES["labelled"] = "SELECT d.doc_id, d.lang, CASE WHEN l.toxic = 1 THEN ' ' ELSE d.source END AS source, d.n_chars, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"


@query("profile_columns", _PROFILE)
def profile_columns(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars").join(table(spark, sf, "labels"), "doc_id", "left")
    docs = docs.withColumn("source", F.when(F.col("toxic") == 1, " ").otherwise(F.col("source")))
    return q.profile_columns(docs, ["doc_id", "lang", "source", "n_chars", "quality", "toxic"])


@query("dq_invariants", """
WITH dim AS (SELECT customer_id, tenant_id AS dim_tenant FROM customer_history WHERE valid_to IS NULL)
SELECT (SELECT count(*) FROM (SELECT entry_id FROM payments GROUP BY 1 HAVING count(*) > 1)) AS duplicate_keys, count(*) FILTER (WHERE n IS NULL) AS orphan_keys,
       count(*) FILTER (WHERE first_tenant <> tenant_id OR last_tenant <> tenant_id) AS tenant_violations, count(*) AS join_input_rows, CAST(sum(coalesce(n, 1)) AS BIGINT) AS join_output_rows
FROM (SELECT p.entry_id, p.tenant_id, i.customer_id FROM payments p LEFT JOIN invoices i ON p.tenant_id = i.tenant_id AND p.invoice_id = i.invoice_id) f
LEFT JOIN (SELECT customer_id, min(dim_tenant) AS first_tenant, max(dim_tenant) AS last_tenant, count(*) AS n FROM dim GROUP BY 1) x ON f.customer_id = x.customer_id""")
def dq_invariants(spark, sf):
    keys = ["tenant_id", "invoice_id"]
    fact = d.payments(spark, sf).select("entry_id", *keys).join(d.invoices(spark, sf).select(*keys, "customer_id"), keys, "left")
    dim = d.customer_history(spark, sf).where("valid_to IS NULL").select("customer_id", F.col("tenant_id").alias("dim_tenant"))
    return q.join_invariants(fact, dim, ["entry_id"], ["customer_id"], "tenant_id", "dim_tenant")
