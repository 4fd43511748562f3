"""Change logs to current state, history and star tables."""

from pyspark.sql import functions as F

from starloom.functions.scalars import cents, month_start
from starloom.operators import cdc
from starloom.operators import joins as j
from starloom.operators.reconcile import ColumnRule, ResultContract, keyed_diff
from starloom.operators.sets import union_checks
from starloom.plans import facts
from starloom.registry import derived as d
from starloom.registry.aggregates import orders_c
from starloom.registry.base import CTES, query, table

INVOICE = ["tenant_id", "invoice_id"]
PAYLOAD = ["customer_id", "issued_at", "currency", "gross_cents", "discount_cents", "status", "op"]


@query("cdc_current_state", """
SELECT tenant_id, entry_id, invoice_id, currency, amount_cents, status, source_seq, arrival_seq FROM payments""")
def cdc_current_state(spark, sf):
    return d.payments(spark, sf).select("tenant_id", "entry_id", "invoice_id", "currency", "amount_cents", "status", "source_seq", "arrival_seq")


CTES["conflicting_cdc"] = """
SELECT tenant_id, invoice_id, gross_cents, status, op, source_seq, arrival_seq FROM invoice_cdc
UNION ALL SELECT tenant_id, invoice_id, g + 100, s, 'UPSERT', 1, k * 10 + 8 FROM inv_base WHERE os = 'O' AND op = '3-MEDIUM'"""


def conflicting_cdc(spark, sf):
    """The invoice log with a second, different payload for some first versions."""
    log = d.invoice_cdc(spark, sf)
    o = table(spark, sf, "orders").where("o_orderstatus = 'O' AND o_orderpriority = '3-MEDIUM'")
    extra = o.select(
        d.tenant_of("o_orderkey").alias("tenant_id"), d.text("I", "o_orderkey").alias("invoice_id"), (cents("o_totalprice") + 100).alias("gross_cents"),
        F.lit("open").alias("status"), F.lit("UPSERT").alias("op"), F.lit(1).cast("long").alias("source_seq"), (F.col("o_orderkey") * 10 + 8).alias("arrival_seq"))
    return log.select(*extra.columns).unionByName(extra)


@query("cdc_version_conflicts", """
SELECT tenant_id, invoice_id, source_seq, count(*) AS n_payloads FROM (SELECT DISTINCT tenant_id, invoice_id, source_seq, gross_cents, status, op FROM conflicting_cdc)
GROUP BY 1, 2, 3 HAVING count(*) > 1""")
def cdc_version_conflicts(spark, sf):
    return cdc.version_conflicts(conflicting_cdc(spark, sf), INVOICE, "source_seq", ["gross_cents", "status", "op"])


CTES["delivered_events"] = """
SELECT event_id, user_id, event_type, CAST(round(value * 100) AS BIGINT) AS v FROM events
UNION ALL SELECT event_id, user_id, event_type, CAST(round(value * 100) AS BIGINT) FROM events WHERE event_type = 'click'
UNION ALL SELECT event_id, user_id, event_type, CAST(round(value * 100) AS BIGINT) + 1 FROM events WHERE event_type = 'error' AND value > 30"""


def delivered_events(spark, sf):
    """Events with exact redeliveries of clicks and altered redeliveries of some errors."""
    e = table(spark, sf, "events").select("event_id", "user_id", "event_type", cents("value").alias("v"), F.col("value").alias("_x"))
    copies = F.array_compact(F.array(
        F.col("v"), F.when(F.col("event_type") == "click", F.col("v")), F.when((F.col("event_type") == "error") & (F.col("_x") > 30), F.col("v") + 1)))
    return e.select("event_id", "user_id", "event_type", F.explode(copies).alias("v"))


@query("cdc_event_identity_conflicts", """
SELECT event_id, count(DISTINCT (user_id, event_type, v)) AS n_payloads FROM delivered_events GROUP BY 1 HAVING count(DISTINCT (user_id, event_type, v)) > 1""")
def cdc_event_identity_conflicts(spark, sf):
    return cdc.identity_conflicts(delivered_events(spark, sf), ["event_id"], ["user_id", "event_type", "v"])


@query("cdc_replay_count", """
SELECT tenant_id, count(*) AS deliveries, count(*) - count(DISTINCT (invoice_id, source_seq, gross_cents, status, op)) AS replays FROM invoice_cdc GROUP BY 1""")
def cdc_replay_count(spark, sf):
    return cdc.replay_count(d.invoice_cdc(spark, sf), [*INVOICE, "source_seq", "gross_cents", "status", "op"], by=["tenant_id"])


@query("cdc_incremental_apply", "SELECT tenant_id, invoice_id, status, gross_cents, source_seq FROM invoices")
def cdc_incremental_apply(spark, sf):
    """Newer versions first, older ones last: the late batch must not win."""
    log = d.invoice_cdc(spark, sf)
    late, early = log.where("source_seq = 1"), log.where("source_seq > 1")
    state = cdc.latest_version(early, INVOICE, d.ORDER_BY)
    state = cdc.apply_batch(state, late, INVOICE, d.ORDER_BY)
    return state.where("op <> 'DELETE'").select("tenant_id", "invoice_id", F.lower(F.trim("status")).alias("status"), "gross_cents", "source_seq")


@query("scd2_normalize", """
SELECT tenant_id, customer_id, segment, CAST(CAST(valid_from AS DATE) AS VARCHAR) AS valid_from, CAST(CAST(valid_to AS DATE) AS VARCHAR) AS valid_to FROM customer_history""")
def scd2_normalize(spark, sf):
    day = lambda c: F.col(c).cast("date").cast("string").alias(c)
    return d.customer_history(spark, sf).select("tenant_id", "customer_id", "segment", day("valid_from"), day("valid_to"))


@query("scd2_from_cdc", """
SELECT o_custkey, o_orderstatus, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS valid_from,
       CAST(CAST(lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate) AS DATE) AS VARCHAR) AS valid_to
FROM (SELECT o_custkey, o_orderdate, max(o_orderstatus) AS o_orderstatus FROM orders GROUP BY 1, 2)""")
def scd2_from_cdc(spark, sf):
    versions = table(spark, sf, "orders").groupBy("o_custkey", "o_orderdate").agg(F.max("o_orderstatus").alias("o_orderstatus"))
    out = cdc.history_from_versions(versions, ["o_custkey"], "o_orderdate")
    day = lambda c: F.col(c).cast("date").cast("string").alias(c)
    return out.select("o_custkey", "o_orderstatus", day("valid_from"), day("valid_to"))


@query("dim_history_key", """
SELECT md5(tenant_id || ':' || customer_id || ':' || strftime(valid_from, '%Y-%m-%d %H:%M:%S')) AS customer_key, tenant_id, customer_id, segment FROM customer_history""")
def dim_history_key(spark, sf):
    keyed = cdc.history_key(d.customer_history(spark, sf), ["tenant_id", "customer_id"], "valid_from", "customer_key", "yyyy-MM-dd HH:mm:ss")
    return keyed.select("customer_key", "tenant_id", "customer_id", "segment")


@query("dim_unknown_member", "SELECT customer_key, tenant_id, customer_id, segment FROM dim_customers")
def dim_unknown_member(spark, sf):
    return d.dim_customers(spark, sf).select("customer_key", "tenant_id", "customer_id", "segment")


@query("fact_invoice_billing", """
SELECT tenant_id, invoice_id, customer_id, CAST(invoice_date AS VARCHAR) AS invoice_date, currency, status, gross_cents, discount_cents, credit_cents,
       net_cents, paid_cents, invoice_key, customer_key, segment FROM fct_billing""")
def fact_invoice_billing(spark, sf):
    return d.billing(spark, sf).withColumn("invoice_date", F.col("invoice_date").cast("string")).drop("issued_at")


CTES["movements"] = """
SELECT tenant_id, invoice_id, CAST(coalesce(sum(v) FILTER (kind = 'paid'), 0) AS BIGINT) AS paid, CAST(coalesce(sum(v) FILTER (kind = 'moved'), 0) AS BIGINT) AS moved
FROM (SELECT tenant_id, invoice_id, 'paid' AS kind, amount_cents AS v FROM payments UNION ALL SELECT tenant_id, invoice_id, 'moved', adjustment_cents FROM adjustments) GROUP BY tenant_id, invoice_id"""
CTES["segment_then"] = """
SELECT v.tenant_id, v.invoice_id, max(strftime(m.valid_from, '%Y-%m-%d')) AS since, max(m.segment) AS segment FROM customer_history m JOIN invoices v USING (tenant_id, customer_id)
WHERE m.valid_from <= v.issued_at AND v.issued_at < coalesce(m.valid_to, TIMESTAMP '9999-12-31') GROUP BY v.tenant_id, v.invoice_id"""
CTES["fct_adjusted"] = """
WITH sums AS (
  SELECT v.tenant_id, v.invoice_id, v.customer_id, v.status, CAST(v.issued_at AS DATE) AS day, v.gross_cents AS g, coalesce(moved, 0) AS moved, coalesce(paid, 0) AS paid, since, segment
  FROM invoices v LEFT JOIN movements USING (tenant_id, invoice_id) LEFT JOIN segment_then USING (tenant_id, invoice_id))
SELECT concat(tenant_id, '|', invoice_id) AS invoice_key, tenant_id || '|' || customer_id || '|' || since AS customer_key, segment, tenant_id, invoice_id, customer_id, status,
       day AS invoice_date, CAST(date_trunc('month', day) AS DATE) AS invoice_month, g AS amount_cents, moved AS adjustment_cents, g + moved AS net_cents, paid AS paid_cents, g + moved - paid AS outstanding_cents FROM sums"""


def adjusted(spark, sf):
    return facts.invoice_adjusted(d.invoices(spark, sf), d.adjustments(spark, sf), d.payments(spark, sf), d.customer_history(spark, sf), d.latest_issue(spark, sf))


@query("fact_invoice_adjusted", """
SELECT tenant_id, invoice_id, customer_id, CAST(invoice_date AS VARCHAR) AS invoice_date, CAST(invoice_month AS VARCHAR) AS invoice_month, status, amount_cents,
       adjustment_cents, net_cents, paid_cents, outstanding_cents, invoice_key, customer_key, segment FROM fct_adjusted""")
def fact_invoice_adjusted(spark, sf):
    text = lambda c: F.col(c).cast("string")
    return adjusted(spark, sf).withColumns({"invoice_date": text("invoice_date"), "invoice_month": text("invoice_month")})


# Retail reading: line items are order lines, fulfilments and returns hang on them.
CTES["retail_lines"] = """
SELECT tenant_id, k AS order_id, line_id, l_partkey AS product_id, q AS quantity, e // q AS unit_price_cents, (e // q) * q * d // 100 AS discount_cents, rf, ls FROM line_base"""
CTES["fct_fulfillment"] = """
SELECT l.tenant_id || '|' || l.order_id || '|' || l.line_id AS line_key, l.tenant_id, l.order_id, l.line_id, l.product_id, CAST(o.o_orderdate AS DATE) AS order_date,
       CASE o.o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'open' ELSE 'pending' END AS order_status, l.quantity AS ordered_quantity,
       coalesce(f.fq, 0) AS fulfilled_quantity, coalesce(r.rq, 0) AS returned_quantity, l.quantity * l.unit_price_cents - l.discount_cents AS line_net_cents,
       coalesce(r.refund, 0) AS refund_cents, l.quantity * l.unit_price_cents - l.discount_cents - coalesce(r.refund, 0) AS retained_revenue_cents
FROM retail_lines l LEFT JOIN orders o ON l.order_id = o.o_orderkey
LEFT JOIN (SELECT line_id, CAST(sum(quantity - quantity // 4) AS BIGINT) AS fq FROM retail_lines WHERE ls = 'F' GROUP BY 1) f ON l.line_id = f.line_id
LEFT JOIN (SELECT line_id, CAST(sum(quantity // 3) AS BIGINT) AS rq, CAST(sum(unit_price_cents * (quantity // 3)) AS BIGINT) AS refund FROM retail_lines WHERE ls = 'F' AND rf = 'R' GROUP BY 1) r ON l.line_id = r.line_id"""


def retail_lines(spark, sf):
    return d.line_base(spark, sf).select(
        "tenant_id", F.col("_k").alias("order_id"), F.col("_line").alias("line_id"), F.col("_part").alias("product_id"), F.col("_q").alias("quantity"),
        F.expr("_e div _q").alias("unit_price_cents"), F.expr("((_e div _q) * _q * _d) div 100").alias("discount_cents"), "_rf", "_ls")


def fulfillment(spark, sf):
    lines = retail_lines(spark, sf)
    keys = ["tenant_id", "order_id", "line_id"]
    done = lines.where("_ls = 'F'").select(*keys, F.expr("quantity - quantity div 4").alias("quantity"))
    back = lines.where("_ls = 'F' AND _rf = 'R'").select(*keys, F.expr("quantity div 3").alias("quantity"), F.expr("unit_price_cents * (quantity div 3)").alias("refund_cents"))
    status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "open").otherwise("pending")
    orders = table(spark, sf, "orders").select(
        d.tenant_of("o_orderkey").alias("tenant_id"), F.col("o_orderkey").alias("order_id"), F.col("o_orderdate").cast("date").alias("order_date"), status.alias("order_status"))
    return facts.order_line_fulfillment(lines.drop("_rf", "_ls"), orders, done, back)


@query("fact_order_line_fulfillment", "SELECT * EXCLUDE (order_date), CAST(order_date AS VARCHAR) AS order_date FROM fct_fulfillment")
def fact_order_line_fulfillment(spark, sf):
    return fulfillment(spark, sf).withColumn("order_date", F.col("order_date").cast("string"))


CTES["rentals"] = """
SELECT tenant_id, o_orderkey AS rental_id, o_custkey % 25 AS location_id, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'open' ELSE 'cancelled' END AS rental_status,
       CAST(o_orderdate AS DATE) AS rental_date, CASE WHEN o_orderkey % 10 = 0 THEN 'EUR' ELSE 'USD' END AS currency FROM (SELECT *, 'T' || (o_orderkey % 5) AS tenant_id FROM orders)"""
CTES["charges"] = """
SELECT tenant_id, line_id AS charge_id, k AS rental_id, CASE rf WHEN 'N' THEN 'rental_fee' WHEN 'A' THEN 'damage_fee' ELSE CASE WHEN ls = 'F' THEN 'refund' ELSE 'deposit' END END AS charge_type,
       e AS amount, CASE WHEN t = 8 THEN 'GBP' WHEN k % 10 = 0 THEN 'EUR' ELSE 'USD' END AS currency FROM line_base"""
CTES["eligible"] = """
SELECT c.*, CASE WHEN c.charge_type = 'refund' THEN -c.amount ELSE c.amount END AS signed FROM charges c JOIN rentals r ON c.tenant_id = r.tenant_id AND c.rental_id = r.rental_id AND c.currency = r.currency
WHERE r.rental_status = 'completed' AND c.charge_type IN ('rental_fee', 'damage_fee', 'refund')"""


def rentals(spark, sf):
    status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "open").otherwise("cancelled")
    return table(spark, sf, "orders").select(
        d.tenant_of("o_orderkey").alias("tenant_id"), F.col("o_orderkey").alias("rental_id"), (F.col("o_custkey") % 25).alias("location_id"),
        status.alias("rental_status"), F.col("o_orderdate").cast("date").alias("rental_date"), d.currency_of("o_orderkey").alias("currency"))


def charges(spark, sf):
    kind = F.when(F.col("_rf") == "N", "rental_fee").when(F.col("_rf") == "A", "damage_fee").when(F.col("_ls") == "F", "refund").otherwise("deposit")
    return d.line_base(spark, sf).select(
        "tenant_id", F.col("_line").alias("charge_id"), F.col("_k").alias("rental_id"), kind.alias("charge_type"),
        (F.col("_e").cast("decimal(18,2)") / 100).cast("decimal(18,2)").alias("amount"), F.when(F.col("_t") == 8, "GBP").otherwise(d.currency_of("_k")).alias("currency"))


def locations(spark, sf):
    return table(spark, sf, "nation").select(
        F.explode(F.transform(F.sequence(F.lit(0), F.lit(4)), lambda t: F.concat(F.lit("T"), t.cast("string")))).alias("tenant_id"),
        F.col("n_nationkey").cast("long").alias("location_id"), F.col("n_name").alias("location_name"))


@query("fact_rental_revenue", """
SELECT r.tenant_id, r.rental_id, r.location_id, n_name AS location_name, r.rental_status, CAST(r.rental_date AS VARCHAR) AS rental_date, r.currency,
       coalesce(fee, 0) AS fee_cents, coalesce(refund, 0) AS refund_cents, coalesce(fee, 0) + coalesce(refund, 0) AS net_cents, coalesce(n, 0) AS eligible_charge_count
FROM rentals r JOIN nation ON r.location_id = n_nationkey
LEFT JOIN (SELECT tenant_id, rental_id, CAST(sum(CASE WHEN charge_type <> 'refund' THEN signed ELSE 0 END) AS BIGINT) AS fee, CAST(sum(CASE WHEN charge_type = 'refund' THEN signed ELSE 0 END) AS BIGINT) AS refund, count(*) AS n
  FROM eligible GROUP BY 1, 2) c ON r.tenant_id = c.tenant_id AND r.rental_id = c.rental_id WHERE r.rental_status = 'completed'""")
def fact_rental_revenue(spark, sf):
    out = facts.rental_revenue(rentals(spark, sf), charges(spark, sf), locations(spark, sf))
    in_cents = lambda c: (F.col(c) * 100).cast("long")
    return out.withColumns({"fee_cents": in_cents("fee_amount"), "refund_cents": in_cents("refund_amount"), "net_cents": in_cents("net_revenue"), "rental_date": F.col("rental_date").cast("string")}).drop("fee_amount", "refund_amount", "net_revenue")


CTES["fct_month"] = """
SELECT *, min(invoice_month) FILTER (has_paid_invoice = 1) OVER (PARTITION BY tenant_id, customer_id) AS first_paid_month FROM (
  SELECT tenant_id, customer_id, invoice_month, CAST(sum(net_cents) AS BIGINT) AS net_cents, CAST(sum(paid_cents) AS BIGINT) AS paid_cents, CAST(sum(net_cents - paid_cents) AS BIGINT) AS outstanding_cents,
         CAST(bool_or(status = 'posted' AND net_cents > 0) AS INTEGER) AS has_invoice, CAST(bool_or(status = 'posted' AND paid_cents > 0) AS INTEGER) AS has_paid_invoice
  FROM fct_adjusted GROUP BY tenant_id, customer_id, invoice_month)"""


@query("fact_customer_month", """
SELECT tenant_id || '|' || customer_id || '|' || strftime(invoice_month, '%Y-%m-%d') AS customer_month_key, tenant_id, customer_id, CAST(invoice_month AS VARCHAR) AS invoice_month,
       net_cents, paid_cents, outstanding_cents, has_invoice, has_paid_invoice, CAST(first_paid_month AS VARCHAR) AS first_paid_month FROM fct_month""")
def fact_customer_month(spark, sf):
    text = lambda c: F.col(c).cast("string")
    return facts.customer_month(adjusted(spark, sf)).withColumns({"invoice_month": text("invoice_month"), "first_paid_month": text("first_paid_month")})


@query("report_retail_summary", """
SELECT strftime(date_trunc('month', order_date), '%Y-%m-%d') AS order_month, product_id, CAST(sum(ordered_quantity) AS BIGINT) AS ordered_quantity, CAST(sum(fulfilled_quantity) AS BIGINT) AS fulfilled_quantity,
       CAST(sum(returned_quantity) AS BIGINT) AS returned_quantity, CAST(sum(line_net_cents) AS BIGINT) AS line_net_cents, CAST(sum(refund_cents) AS BIGINT) AS refund_cents,
       CAST(sum(retained_revenue_cents) AS BIGINT) AS retained_revenue_cents, CAST(sum(fulfilled_quantity) AS DOUBLE) / nullif(sum(ordered_quantity), 0) AS fulfillment_rate
FROM fct_fulfillment WHERE tenant_id = 'T1' AND order_date >= DATE '1996-01-01' AND order_date < DATE '1999-01-01' AND order_status = 'completed' GROUP BY 1, 2""")
def report_retail_summary(spark, sf):
    out = facts.retail_summary(fulfillment(spark, sf), "T1", "1996-01-01", "1999-01-01", "completed")
    return out.withColumn("order_month", F.col("order_month").cast("string"))


STATE = ResultContract({"tenant_id": ColumnRule("string", False), "invoice_id": ColumnRule("string", False), "status": ColumnRule("string"), "gross_cents": ColumnRule("integer")}, INVOICE)


@query("legacy_defect_probe", """
WITH good AS (SELECT tenant_id, invoice_id, status, gross_cents FROM invoices),
early_filter AS (SELECT tenant_id, invoice_id, lower(trim(status)) AS status, gross_cents FROM (
  SELECT *, row_number() OVER (PARTITION BY tenant_id, invoice_id ORDER BY source_seq DESC, arrival_seq DESC) AS rn FROM invoice_cdc WHERE op <> 'DELETE') WHERE rn = 1),
last_arrival AS (SELECT tenant_id, invoice_id, lower(trim(status)) AS status, gross_cents FROM (
  SELECT *, row_number() OVER (PARTITION BY tenant_id, invoice_id ORDER BY arrival_seq DESC) AS rn FROM invoice_cdc) WHERE rn = 1 AND op <> 'DELETE')
SELECT defect, kind, column_name, count(*) AS n FROM (
  SELECT 'early_tombstone_filter' AS defect, 'extra_key' AS kind, NULL AS column_name FROM early_filter b WHERE NOT EXISTS (SELECT 1 FROM good g WHERE g.invoice_id = b.invoice_id AND g.tenant_id = b.tenant_id)
  UNION ALL SELECT 'early_tombstone_filter', 'value_mismatch', 'gross_cents' FROM early_filter b JOIN good g USING (tenant_id, invoice_id) WHERE b.gross_cents <> g.gross_cents
  UNION ALL SELECT 'early_tombstone_filter', 'value_mismatch', 'status' FROM early_filter b JOIN good g USING (tenant_id, invoice_id) WHERE b.status <> g.status
  UNION ALL SELECT 'last_arrival', 'extra_key', NULL FROM last_arrival b WHERE NOT EXISTS (SELECT 1 FROM good g WHERE g.invoice_id = b.invoice_id AND g.tenant_id = b.tenant_id)
  UNION ALL SELECT 'last_arrival', 'missing_key', NULL FROM good b WHERE NOT EXISTS (SELECT 1 FROM last_arrival g WHERE g.invoice_id = b.invoice_id AND g.tenant_id = b.tenant_id)
  UNION ALL SELECT 'last_arrival', 'value_mismatch', 'gross_cents' FROM last_arrival b JOIN good g USING (tenant_id, invoice_id) WHERE b.gross_cents <> g.gross_cents
  UNION ALL SELECT 'last_arrival', 'value_mismatch', 'status' FROM last_arrival b JOIN good g USING (tenant_id, invoice_id) WHERE b.status <> g.status) GROUP BY ALL""")
def legacy_defect_probe(spark, sf):
    """Two known defects, each built as its own plan and compared with the right state."""
    log = d.invoice_cdc(spark, sf)
    shaped = lambda df: df.select(*INVOICE, F.lower(F.trim("status")).alias("status"), "gross_cents")
    good = shaped(d.invoices(spark, sf))
    variants = {
        "early_tombstone_filter": cdc.latest_version(log.where("op <> 'DELETE'"), INVOICE, d.ORDER_BY),
        "last_arrival": cdc.latest_version(log, INVOICE, ["arrival_seq"]).where("op <> 'DELETE'"),
    }
    found = [keyed_diff(good, shaped(v), STATE).groupBy("kind", "column_name").agg(F.count("*").alias("n")).withColumn("defect", F.lit(name)) for name, v in variants.items()]
    return union_checks(found)


@query("counterfactual_apply", """
SELECT o_orderpriority, count(*) AS n_orders, CAST(sum(CASE WHEN o_orderstatus = 'P' THEN 2 * c ELSE c END) AS BIGINT) AS total_cents FROM (
  SELECT o_orderkey, o_orderpriority, o_orderstatus, c FROM orders_c UNION ALL SELECT -1 - o_orderkey, o_orderpriority, 'F', c // 2 FROM orders_c WHERE o_orderpriority = '1-URGENT') GROUP BY 1""")
def counterfactual_apply(spark, sf):
    """Replace pending orders by doubled copies and append half-price urgent ones; the base table stays as it is."""
    o = orders_c(spark, sf).select("o_orderkey", "o_orderpriority", "o_orderstatus", "c")
    changed = o.where("o_orderstatus = 'P'").withColumn("c", F.col("c") * 2)
    added = o.where("o_orderpriority = '1-URGENT'").select((-1 - F.col("o_orderkey")).alias("o_orderkey"), "o_orderpriority", F.lit("F").alias("o_orderstatus"), F.expr("c div 2").alias("c"))
    return cdc.apply_counterfactual(o, ["o_orderkey"], replace=changed, append=added).groupBy("o_orderpriority").agg(F.count("*").alias("n_orders"), F.sum("c").alias("total_cents"))


@query("current_vs_asof_segment", """
WITH cur AS (SELECT tenant_id, customer_id, segment FROM customer_history WHERE valid_to IS NULL)
SELECT coalesce(a.segment, 'Unknown') AS segment, CAST(sum(a.asof) AS BIGINT) AS asof_cents, CAST(sum(a.cur) AS BIGINT) AS current_cents FROM (
  SELECT h.segment, i.gross_cents AS asof, 0 AS cur FROM invoices i LEFT JOIN customer_history h ON i.tenant_id = h.tenant_id AND i.customer_id = h.customer_id AND i.issued_at >= h.valid_from AND (i.issued_at < h.valid_to OR h.valid_to IS NULL)
  UNION ALL SELECT c.segment, 0, i.gross_cents FROM invoices i LEFT JOIN cur c ON i.tenant_id = c.tenant_id AND i.customer_id = c.customer_id) a GROUP BY 1""")
def current_vs_asof_segment(spark, sf):
    """Both totals come from one pass: history is pivoted to (as-of, current) segment per invoice, then folded."""
    keys = ["tenant_id", "customer_id"]
    inv = d.invoices(spark, sf).select(*keys, "issued_at", "gross_cents")
    hist = d.customer_history(spark, sf)
    now = hist.where("valid_to IS NULL").select(*keys, F.col("segment").alias("current_segment"))
    both = j.join_as_of(inv, hist, keys, "issued_at", facts.by_year, until=d.latest_issue(spark, sf)).join(now, keys, "left")
    pairs = both.groupBy("segment", "current_segment").agg(F.sum("gross_cents").alias("g"))
    rows = pairs.select(F.explode(F.array(
        F.struct(F.coalesce("segment", F.lit("Unknown")).alias("segment"), F.col("g").alias("a"), F.lit(0).cast("long").alias("c")),
        F.struct(F.coalesce("current_segment", F.lit("Unknown")).alias("segment"), F.lit(0).cast("long").alias("a"), F.col("g").alias("c")))).alias("r")).select("r.*")
    return rows.groupBy("segment").agg(F.sum("a").alias("asof_cents"), F.sum("c").alias("current_cents"))
