"""Change logs, histories and models derived from the supplied tables.

Each derivation exists twice: as a Spark plan, and as SQL text in ``CTES`` that
states the same rule on its own terms (unions of scans instead of one exploding
scan, ranking windows instead of ``max_by``).

Domain reading of the tables: an order is an invoice (or a rental), a line item
is a payment, credit, order line or charge, a customer has an effective-dated
segment history.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starloom.functions.scalars import cents
from starloom.operators.cdc import current_state, history_key, with_unknown_rows
from starloom.operators.joins import Edge
from starloom.plans import facts
from starloom.registry.base import CTES, dealt_out, table


def _versions(df: DataFrame, versions: list[Column]) -> DataFrame:
    """One scan fanned out to the versions that exist for each row."""
    kept = [c for c in df.columns if not c.startswith("_")]
    exploded = df.select(*kept, F.explode(F.array(*versions)).alias("_v")).where("_v IS NOT NULL")
    return exploded.select(*kept, "_v.*")


def text(prefix: str, c: str) -> Column:
    return F.concat(F.lit(prefix), F.col(c).cast("string"))


def tenant_of(c: str) -> Column:
    return F.concat(F.lit("T"), (F.col(c) % 5).cast("string"))


def currency_of(c: str) -> Column:
    return F.when(F.col(c) % 10 == 0, "EUR").otherwise("USD")


# ---------------------------------------------------------------- billing log

CTES["inv_base"] = """
SELECT o_orderkey AS k, 'T' || (o_orderkey % 5) AS tenant_id, 'I' || o_orderkey AS invoice_id,
       'C' || o_custkey AS customer_id,
       o_orderdate + to_hours(CAST(o_orderkey % 24 AS INTEGER)) AS issued_at,
       CAST(round(o_totalprice * 100) AS BIGINT) AS g,
       CASE WHEN o_orderkey % 10 = 0 THEN 'EUR' ELSE 'USD' END AS currency,
       CASE o_orderstatus WHEN 'F' THEN 'posted' WHEN 'O' THEN 'open' ELSE 'draft' END AS s,
       o_orderstatus AS os, o_orderpriority AS op
FROM orders"""
CTES["invoice_cdc"] = """
SELECT tenant_id, invoice_id, customer_id, issued_at, currency, g AS gross_cents,
       CASE WHEN os = 'F' THEN g // 50 END AS discount_cents, s AS status, 'UPSERT' AS op,
       CAST(1 AS BIGINT) AS source_seq, k * 10 + 1 AS arrival_seq FROM inv_base
UNION ALL
SELECT tenant_id, invoice_id, customer_id, issued_at, currency, g - g // 10,
       CASE WHEN os = 'F' THEN g // 50 END, ' Posted ', 'UPSERT', 2, k * 10 + 2
FROM inv_base WHERE os IN ('F', 'P')
UNION ALL
SELECT tenant_id, invoice_id, customer_id, issued_at, currency, g - g // 10,
       CASE WHEN os = 'F' THEN g // 50 END, ' Posted ', 'DELETE', 3, k * 10 + 3
FROM inv_base WHERE os = 'P' AND op = '5-LOW'
UNION ALL
SELECT tenant_id, invoice_id, customer_id, issued_at, currency, g,
       CASE WHEN os = 'F' THEN g // 50 END, s, 'UPSERT', 1, k * 10 + 9
FROM inv_base WHERE op = '1-URGENT'"""


def invoice_cdc(spark, sf) -> DataFrame:
    o = table(spark, sf, "orders")
    base = o.select(
        tenant_of("o_orderkey").alias("tenant_id"),
        text("I", "o_orderkey").alias("invoice_id"),
        text("C", "o_custkey").alias("customer_id"),
        F.expr("o_orderdate + make_dt_interval(0, cast(o_orderkey % 24 as int), 0, 0)").alias("issued_at"),
        currency_of("o_orderkey").alias("currency"),
        cents("o_totalprice").alias("_g"),
        F.col("o_orderkey").alias("_k"), F.col("o_orderstatus").alias("_os"), F.col("o_orderpriority").alias("_op"),
    )
    g, k, os_, pr = F.col("_g"), F.col("_k"), F.col("_os"), F.col("_op")
    first = F.when(os_ == "F", "posted").when(os_ == "O", "open").otherwise("draft")

    def version(seq, arrival, gross, status, op):
        return F.struct(
            gross.alias("gross_cents"), F.when(os_ == "F", F.expr("_g div 50")).alias("discount_cents"),
            status.alias("status"), F.lit(op).alias("op"),
            F.lit(seq).cast("long").alias("source_seq"), (k * 10 + arrival).alias("arrival_seq"),
        )

    amended = g - F.expr("_g div 10")
    return _versions(base, [
        version(1, 1, g, first, "UPSERT"),
        F.when(os_.isin("F", "P"), version(2, 2, amended, F.lit(" Posted "), "UPSERT")),
        F.when((os_ == "P") & (pr == "5-LOW"), version(3, 3, amended, F.lit(" Posted "), "DELETE")),
        F.when(pr == "1-URGENT", version(1, 9, g, first, "UPSERT")),
    ])


CTES["line_base"] = """
SELECT l_orderkey AS k, 'T' || (l_orderkey % 5) AS tenant_id, 'I' || l_orderkey AS invoice_id,
       l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS line_id,
       CAST(round(l_extendedprice * 100) AS BIGINT) AS e,
       CAST(round(l_discount * 100) AS BIGINT) AS d,
       CAST(round(l_tax * 100) AS BIGINT) AS t,
       CAST(l_quantity AS BIGINT) AS q, l_partkey, l_suppkey, l_linenumber, l_returnflag AS rf, l_linestatus AS ls, l_shipdate
FROM lineitem"""
CTES["payment_cdc"] = """
SELECT tenant_id, 'P' || line_id AS entry_id, invoice_id,
       CASE WHEN t = 8 THEN 'GBP' WHEN k % 10 = 0 THEN 'EUR' ELSE 'USD' END AS currency,
       e AS amount_cents, CASE WHEN ls = 'F' THEN 'posted' ELSE 'pending' END AS status, 'UPSERT' AS op,
       CAST(1 AS BIGINT) AS source_seq, k * 10 + 1 AS arrival_seq FROM line_base
UNION ALL
SELECT tenant_id, 'P' || line_id, invoice_id,
       CASE WHEN t = 8 THEN 'GBP' WHEN k % 10 = 0 THEN 'EUR' ELSE 'USD' END,
       e - e // 20, CASE WHEN ls = 'F' THEN 'posted' ELSE 'pending' END, 'UPSERT', 2, k * 10 + 2
FROM line_base WHERE rf = 'A'
UNION ALL
SELECT tenant_id, 'P' || line_id, invoice_id,
       CASE WHEN t = 8 THEN 'GBP' WHEN k % 10 = 0 THEN 'EUR' ELSE 'USD' END,
       e, CASE WHEN ls = 'F' THEN 'posted' ELSE 'pending' END, 'DELETE', 3, k * 10 + 3
FROM line_base WHERE rf = 'N' AND d = 0
UNION ALL
SELECT tenant_id, 'P' || line_id, invoice_id,
       CASE WHEN t = 8 THEN 'GBP' WHEN k % 10 = 0 THEN 'EUR' ELSE 'USD' END,
       e, CASE WHEN ls = 'F' THEN 'posted' ELSE 'pending' END, 'UPSERT', 1, k * 10 + 9
FROM line_base WHERE ls = 'F' AND q = 50"""


def line_base(spark, sf) -> DataFrame:
    li = table(spark, sf, "lineitem")
    return li.select(
        F.col("l_orderkey").alias("_k"),
        tenant_of("l_orderkey").alias("tenant_id"),
        text("I", "l_orderkey").alias("invoice_id"),
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("_line"),
        cents("l_extendedprice").alias("_e"), cents("l_discount").alias("_d"), cents("l_tax").alias("_t"),
        F.col("l_quantity").cast("long").alias("_q"),
        F.col("l_partkey").alias("_part"), F.col("l_suppkey").alias("_supp"), F.col("l_linenumber").alias("_no"),
        F.col("l_returnflag").alias("_rf"), F.col("l_linestatus").alias("_ls"), F.col("l_shipdate").alias("_ship"),
    )


def payment_cdc(spark, sf) -> DataFrame:
    base = line_base(spark, sf).withColumn("entry_id", F.concat(F.lit("P"), "_line")).withColumn(
        "currency", F.when(F.col("_t") == 8, "GBP").otherwise(currency_of("_k")))
    e, k = F.col("_e"), F.col("_k")

    def version(seq, arrival, amount, op):
        return F.struct(
            amount.alias("amount_cents"), F.when(F.col("_ls") == "F", "posted").otherwise("pending").alias("status"),
            F.lit(op).alias("op"), F.lit(seq).cast("long").alias("source_seq"), (k * 10 + arrival).alias("arrival_seq"))

    return _versions(base, [
        version(1, 1, e, "UPSERT"),
        F.when(F.col("_rf") == "A", version(2, 2, e - F.expr("_e div 20"), "UPSERT")),
        F.when((F.col("_rf") == "N") & (F.col("_d") == 0), version(3, 3, e, "DELETE")),
        F.when((F.col("_ls") == "F") & (F.col("_q") == 50), version(1, 9, e, "UPSERT")),
    ])


CTES["credit_cdc"] = """
SELECT tenant_id, 'R' || line_id AS entry_id, invoice_id,
       CASE WHEN k % 10 = 0 THEN 'EUR' ELSE 'USD' END AS currency, e * d // 100 AS amount_cents,
       CASE WHEN ls = 'F' THEN 'posted' ELSE 'pending' END AS status, 'UPSERT' AS op,
       CAST(1 AS BIGINT) AS source_seq, k * 10 + 1 AS arrival_seq FROM line_base WHERE rf = 'R'"""


def credit_cdc(spark, sf) -> DataFrame:
    return line_base(spark, sf).where("_rf = 'R'").select(
        "tenant_id", F.concat(F.lit("R"), "_line").alias("entry_id"), "invoice_id",
        currency_of("_k").alias("currency"), F.expr("(_e * _d) div 100").alias("amount_cents"),
        F.when(F.col("_ls") == "F", "posted").otherwise("pending").alias("status"), F.lit("UPSERT").alias("op"),
        F.lit(1).cast("long").alias("source_seq"), (F.col("_k") * 10 + 1).alias("arrival_seq"),
    )


def _current_sql(log: str, key: str, ties: str = "") -> str:
    return f"""SELECT * EXCLUDE (rn) FROM (
  SELECT *, row_number() OVER (PARTITION BY tenant_id, {key} ORDER BY source_seq DESC, arrival_seq DESC{ties}) AS rn
  FROM {log}) WHERE rn = 1 AND op <> 'DELETE'"""


CTES["invoices"] = f"""
SELECT tenant_id, invoice_id, customer_id, issued_at, currency, gross_cents,
       coalesce(discount_cents, 0) AS discount_cents, lower(trim(status)) AS status, source_seq, arrival_seq
FROM ({_current_sql('invoice_cdc', 'invoice_id')})"""
CTES["payments"] = _current_sql("payment_cdc", "entry_id", ", amount_cents DESC, status DESC")
CTES["credits"] = _current_sql("credit_cdc", "entry_id", ", amount_cents DESC, status DESC")

ORDER_BY = ("source_seq", "arrival_seq")


def invoices(spark, sf) -> DataFrame:
    current = current_state(invoice_cdc(spark, sf), ["tenant_id", "invoice_id"], ORDER_BY, F.col("op") == "DELETE")
    return current.withColumns({
        "discount_cents": F.coalesce("discount_cents", F.lit(0)), "status": F.lower(F.trim("status")),
    }).drop("op")


def payments(spark, sf) -> DataFrame:
    return current_state(payment_cdc(spark, sf), ["tenant_id", "entry_id"], ORDER_BY, F.col("op") == "DELETE")


def credits(spark, sf) -> DataFrame:
    return current_state(credit_cdc(spark, sf), ["tenant_id", "entry_id"], ORDER_BY, F.col("op") == "DELETE")


# ---------------------------------------------------------- customer history

CTES["customer_history_raw"] = """
SELECT 'T' || t.tn AS tenant_id, 'C' || c_custkey AS customer_id,
       CASE WHEN c_acctbal < 0 THEN '2038-01-01 00:00:00' ELSE '1992-01-01 00:00:00' END AS valid_from,
       CASE WHEN c_acctbal >= 1000 THEN strftime(DATE '1997-01-01' + c_nationkey * 30, '%Y-%m-%d') || ' 00:00:00' END AS valid_to,
       c_mktsegment AS segment
FROM customer, range(5) t(tn)
UNION ALL
SELECT 'T' || t.tn, 'C' || c_custkey,
       strftime(DATE '1997-01-01' + c_nationkey * 30, '%Y-%m-%d') || ' 00:00:00', NULL,
       CASE c_mktsegment WHEN 'BUILDING' THEN 'MACHINERY' WHEN 'MACHINERY' THEN 'FURNITURE' ELSE 'BUILDING' END
FROM customer, range(5) t(tn) WHERE c_acctbal >= 1000
UNION ALL
SELECT 'T' || t.tn, 'C' || c_custkey, CASE WHEN c_acctbal < 0 THEN '2038-01-01 00:00:00' ELSE '1992-01-01 00:00:00' END, NULL, c_mktsegment
FROM customer, range(5) t(tn) WHERE c_acctbal < 1000 AND c_mktsegment = 'HOUSEHOLD'"""
CTES["customer_history"] = """
SELECT DISTINCT tenant_id, customer_id, CAST(valid_from AS TIMESTAMP) AS valid_from,
       CAST(valid_to AS TIMESTAMP) AS valid_to, segment FROM customer_history_raw"""


def customer_history_raw(spark, sf) -> DataFrame:
    """Text history with an exact replay for some customers; that of a negative balance starts after all facts."""
    c = dealt_out(table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_mktsegment", "c_acctbal"))
    split = F.concat(F.date_add(F.lit("1997-01-01").cast("date"), F.col("c_nationkey") * 30).cast("string"), F.lit(" 00:00:00"))
    start = F.when(F.col("c_acctbal") < 0, "2038-01-01 00:00:00").otherwise("1992-01-01 00:00:00")
    rotated = (F.when(F.col("c_mktsegment") == "BUILDING", "MACHINERY")
               .when(F.col("c_mktsegment") == "MACHINERY", "FURNITURE").otherwise("BUILDING"))
    two = F.col("c_acctbal") >= 1000

    def interval(lo, hi, segment):
        return F.struct(lo.alias("valid_from"), hi.alias("valid_to"), segment.alias("segment"))

    none = F.lit(None).cast("string")
    base = c.select(
        F.explode(F.sequence(F.lit(0), F.lit(4))).alias("_t"), text("C", "c_custkey").alias("customer_id"),
        "c_nationkey", "c_mktsegment", "c_acctbal",
    ).withColumn("tenant_id", F.concat(F.lit("T"), F.col("_t").cast("string")))
    rows = F.array(
        interval(start, F.when(two, split), F.col("c_mktsegment")),
        F.when(two, interval(split, none, rotated)),
        F.when(~two & (F.col("c_mktsegment") == "HOUSEHOLD"), interval(start, none, F.col("c_mktsegment"))),
    )
    return base.select("tenant_id", "customer_id", F.explode(rows).alias("_h")).where("_h IS NOT NULL").select("tenant_id", "customer_id", "_h.*")


def customer_history(spark, sf) -> DataFrame:
    from starloom.operators.cdc import normalize_history

    return normalize_history(customer_history_raw(spark, sf), {"valid_from": "timestamp_ntz", "valid_to": "timestamp_ntz"})


CTES["dim_customers"] = """
SELECT md5(tenant_id || ':' || customer_id || ':' || strftime(valid_from, '%Y-%m-%d %H:%M:%S')) AS customer_key,
       tenant_id, customer_id, valid_from, valid_to, segment FROM customer_history
UNION ALL
SELECT md5(tenant_id || ':__UNKNOWN__'), tenant_id, NULL, NULL, NULL, 'Unknown'
FROM (SELECT DISTINCT tenant_id FROM invoices)"""


def keyed_history(spark, sf) -> DataFrame:
    """Customer dimension rows without the unknown members."""
    keyed = history_key(customer_history(spark, sf), ["tenant_id", "customer_id"], "valid_from", "customer_key", "yyyy-MM-dd HH:mm:ss")
    return keyed.select("customer_key", "tenant_id", "customer_id", "valid_from", "valid_to", "segment")


def dim_customers(spark, sf) -> DataFrame:
    return with_unknown_rows(keyed_history(spark, sf), invoices(spark, sf), "tenant_id", "customer_key", "segment")


# -------------------------------------------------------------- adjustments

CTES["adjustments"] = """
SELECT tenant_id, invoice_id, -(g // 100) AS adjustment_cents, 'goodwill' AS reason
FROM inv_base WHERE op = '2-HIGH' AND os <> 'P'"""


def adjustments(spark, sf) -> DataFrame:
    o = table(spark, sf, "orders").where("o_orderpriority = '2-HIGH' AND o_orderstatus <> 'P'")
    return o.select(
        tenant_of("o_orderkey").alias("tenant_id"), text("I", "o_orderkey").alias("invoice_id"),
        (-F.floor(cents("o_totalprice") / 100)).cast("long").alias("adjustment_cents"), F.lit("goodwill").alias("reason"),
    )


# --------------------------------------------------------------------- facts

CTES["ledger"] = """
SELECT tenant_id, invoice_id, currency, CAST(coalesce(sum(amount_cents) FILTER (side = 'in'), 0) AS BIGINT) AS came_in, CAST(coalesce(sum(amount_cents) FILTER (side = 'off'), 0) AS BIGINT) AS taken_off
FROM (SELECT 'in' AS side, tenant_id, invoice_id, currency, amount_cents, status FROM payments UNION ALL SELECT 'off', tenant_id, invoice_id, currency, amount_cents, status FROM credits)
WHERE status = 'posted' GROUP BY tenant_id, invoice_id, currency"""
CTES["billed_member"] = """
SELECT v.tenant_id, v.invoice_id, max(m.customer_key) AS member, max(m.segment) AS member_segment FROM dim_customers m JOIN invoices v USING (tenant_id, customer_id)
WHERE m.valid_from <= v.issued_at AND v.issued_at < coalesce(m.valid_to, TIMESTAMP '9999-12-31') GROUP BY v.tenant_id, v.invoice_id"""
CTES["fct_billing"] = """
WITH signed AS (
  SELECT v.*, coalesce(taken_off, 0) AS credit_cents, coalesce(came_in, 0) AS paid_cents, member, member_segment
  FROM invoices v LEFT JOIN ledger USING (tenant_id, invoice_id, currency) LEFT JOIN billed_member USING (tenant_id, invoice_id))
SELECT md5(concat(tenant_id, ':', invoice_id)) AS invoice_key, CASE WHEN member IS NULL THEN md5(concat(tenant_id, ':__UNKNOWN__')) ELSE member END AS customer_key,
       CASE WHEN member IS NULL THEN 'Unknown' ELSE member_segment END AS segment, tenant_id, invoice_id, customer_id, currency, status, issued_at,
       CAST(timezone('America/Chicago', timezone('UTC', issued_at)) AS DATE) AS invoice_date, gross_cents, discount_cents, credit_cents, paid_cents,
       gross_cents - (discount_cents + credit_cents) AS net_cents FROM signed"""


def latest_issue(spark, sf) -> Column:
    """A time that no invoice passes, from the order dates alone."""
    return table(spark, sf, "orders").agg((F.max("o_orderdate") + F.expr("interval 1 day")).alias("t")).scalar()


def billing(spark, sf) -> DataFrame:
    """``facts.invoice_billing`` over the derived logs."""
    return facts.invoice_billing(invoices(spark, sf), payments(spark, sf), credits(spark, sf), keyed_history(spark, sf), "America/Chicago", latest_issue(spark, sf))


# -------------------------------------------------------------- semantic views

def sales_views(spark, sf):
    """Orders star: orders -> customer -> nation -> region, with cents beside the double amount."""
    views = {n: table(spark, sf, n) for n in ("customer", "nation", "region")}
    views["orders"] = table(spark, sf, "orders").withColumns({
        "total_cents": cents("o_totalprice"), "order_month": F.trunc(F.col("o_orderdate").cast("date"), "month"),
    })
    edges = [
        Edge("orders", "customer", ("o_custkey",), ("c_custkey",)),
        Edge("customer", "nation", ("c_nationkey",), ("n_nationkey",), "left"),
        Edge("nation", "region", ("n_regionkey",), ("r_regionkey",), "left"),
    ]
    return views, edges
