"""Fact tables and summaries composed from current states, history and ledgers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starloom.functions.scalars import local_date, ratio, surrogate_key
from starloom.operators.aggregates import flag_any
from starloom.operators.joins import join_as_of, with_unknown_member


def by_year(t: Column) -> Column:
    """Period of the as-of joins: a customer's facts and history are split by year."""
    return F.year(t)


def invoice_billing(invoices: DataFrame, payments: DataFrame, credits: DataFrame, history: DataFrame, zone: str, until: Column | None = None) -> DataFrame:
    """Invoice grain: posted payments and credits of the same currency, as-of customer, local date.

    Both ledgers are summed at invoice grain before they meet the invoice, so
    two children cannot multiply each other. ``history`` is the customer dimension
    without its unknown members, which no customer can match; an unmatched invoice
    gets the unknown key by rule.
    """
    keys = ["tenant_id", "invoice_id", "currency"]
    posted = lambda df, out: df.where("status = 'posted'").groupBy(*keys).agg(F.sum("amount_cents").alias(out))
    base = (
        invoices.join(posted(payments, "paid_cents"), keys, "left").join(posted(credits, "credit_cents"), keys, "left")
        .withColumns({"paid_cents": F.coalesce("paid_cents", F.lit(0)), "credit_cents": F.coalesce("credit_cents", F.lit(0))})
    )
    joined = join_as_of(base, history, ["tenant_id", "customer_id"], "issued_at", by_year, until=until)
    return with_unknown_member(joined, "customer_key", "tenant_id").select(
        "tenant_id", "invoice_id", "customer_id", "issued_at", local_date("issued_at", zone).alias("invoice_date"),
        "currency", "status", "gross_cents", "discount_cents", "credit_cents",
        (F.col("gross_cents") - F.col("discount_cents") - F.col("credit_cents")).alias("net_cents"), "paid_cents",
        surrogate_key("tenant_id", "invoice_id").alias("invoice_key"), "customer_key",
        F.coalesce("segment", F.lit("Unknown")).alias("segment"),
    )


def invoice_adjusted(invoices: DataFrame, adjustments: DataFrame, payments: DataFrame, history: DataFrame, until: Column | None = None) -> DataFrame:
    """Invoice grain: manual adjustments, payments, outstanding balance, as-of segment."""
    keys = ["tenant_id", "invoice_id"]
    paid = payments.groupBy(*keys).agg(F.sum("amount_cents").alias("paid_cents"))
    base = (
        invoices.join(adjustments.select(*keys, "adjustment_cents"), keys, "left").join(paid, keys, "left")
        .withColumns({"adjustment_cents": F.coalesce("adjustment_cents", F.lit(0)), "paid_cents": F.coalesce("paid_cents", F.lit(0))})
        .withColumn("net_cents", F.col("gross_cents") + F.col("adjustment_cents"))
    )
    joined = join_as_of(base, history, ["tenant_id", "customer_id"], "issued_at", by_year, until=until)
    start = F.date_format("valid_from", "yyyy-MM-dd")
    return joined.select(
        *keys, "customer_id", F.col("issued_at").cast("date").alias("invoice_date"),
        F.trunc(F.col("issued_at").cast("date"), "month").alias("invoice_month"), "status",
        F.col("gross_cents").alias("amount_cents"), "adjustment_cents", "net_cents", "paid_cents",
        (F.col("net_cents") - F.col("paid_cents")).alias("outstanding_cents"),
        F.concat("tenant_id", F.lit("|"), "invoice_id").alias("invoice_key"),
        F.concat("tenant_id", F.lit("|"), "customer_id", F.lit("|"), start).alias("customer_key"), "segment",
    )


def order_line_fulfillment(lines: DataFrame, orders: DataFrame, fulfillments: DataFrame, returns: DataFrame) -> DataFrame:
    """Line grain: ordered, fulfilled and returned quantities, retained revenue."""
    keys = ["tenant_id", "order_id", "line_id"]
    done = fulfillments.groupBy(*keys).agg(F.sum("quantity").alias("fulfilled_quantity"))
    back = returns.groupBy(*keys).agg(F.sum("quantity").alias("returned_quantity"), F.sum("refund_cents").alias("refund_cents"))
    out = lines.join(orders, ["tenant_id", "order_id"], "left").join(done, keys, "left").join(back, keys, "left")
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("fulfilled_quantity", "returned_quantity", "refund_cents")}
    net = F.col("quantity") * F.col("unit_price_cents") - F.col("discount_cents")
    return out.withColumns({**zero, "line_net_cents": net}).select(
        F.concat_ws("|", *keys).alias("line_key"), *keys, "product_id", "order_date", "order_status",
        F.col("quantity").alias("ordered_quantity"), "fulfilled_quantity", "returned_quantity", "line_net_cents", "refund_cents",
        (F.col("line_net_cents") - F.col("refund_cents")).alias("retained_revenue_cents"),
    )


# Charge types counted as fees.
FEE_TYPES = ("rental_fee", "damage_fee")


def eligible_charges(charges: DataFrame, rentals: DataFrame) -> DataFrame:
    """Charges of completed rentals in the rental's own tenant and currency, refunds negative."""
    keys = ["tenant_id", "rental_id", "currency"]
    done = rentals.where("rental_status = 'completed'").select(*keys)
    signed = F.when(F.col("charge_type") == "refund", -F.col("amount")).otherwise(F.col("amount"))
    kept = charges.where(F.col("charge_type").isin(*FEE_TYPES, "refund")).join(done, keys, "left_semi")
    return kept.withColumn("signed_amount", signed.cast("decimal(18,2)"))


def rental_revenue(rentals: DataFrame, charges: DataFrame, locations: DataFrame) -> DataFrame:
    """Completed rentals with fees, refunds and net; rentals without charges stay at zero."""
    keys = ["tenant_id", "rental_id"]
    money = lambda c: c.cast("decimal(18,2)")
    zero = F.lit(0).cast("decimal(18,2)")
    fee = F.col("charge_type").isin(*FEE_TYPES)
    totals = eligible_charges(charges, rentals).groupBy(*keys).agg(
        money(F.sum(F.when(fee, F.col("signed_amount")).otherwise(zero))).alias("fee_amount"),
        money(F.sum(F.when(fee, zero).otherwise(F.col("signed_amount")))).alias("refund_amount"),
        F.count("charge_id").alias("eligible_charge_count"),
    )
    out = rentals.where("rental_status = 'completed'").join(locations, ["tenant_id", "location_id"]).join(totals, keys, "left")
    return out.select(
        *keys, "location_id", "location_name", "rental_status", "rental_date", "currency",
        money(F.coalesce("fee_amount", zero)).alias("fee_amount"), money(F.coalesce("refund_amount", zero)).alias("refund_amount"),
        money(F.coalesce("fee_amount", zero) + F.coalesce("refund_amount", zero)).alias("net_revenue"),
        F.coalesce("eligible_charge_count", F.lit(0)).alias("eligible_charge_count"),
    )


def customer_month(fact: DataFrame) -> DataFrame:
    """Customer-month balances with activity flags and the first paid month."""
    keys = ["tenant_id", "customer_id"]
    posted = F.col("status") == "posted"
    months = fact.groupBy(*keys, "invoice_month").agg(
        F.sum("net_cents").alias("net_cents"), F.sum("paid_cents").alias("paid_cents"), F.sum("outstanding_cents").alias("outstanding_cents"),
        flag_any(posted & (F.col("net_cents") > 0)).alias("has_invoice"),
        flag_any(posted & (F.col("paid_cents") > 0)).alias("has_paid_invoice"),
    )
    # The month rows already say whether the month was paid, so the cohort needs no second pass over invoices.
    first = months.where("has_paid_invoice = 1").groupBy(*keys).agg(F.min("invoice_month").alias("first_paid_month"))
    key = F.concat("tenant_id", F.lit("|"), "customer_id", F.lit("|"), F.date_format("invoice_month", "yyyy-MM-dd"))
    return months.join(first, keys, "left").select(key.alias("customer_month_key"), *months.columns, "first_paid_month")


def retail_summary(fact: DataFrame, tenant: str, start: str, end: str, status: str, product: str = "ALL") -> DataFrame:
    """Month x product report under its five parameters."""
    from starloom.operators.filters import date_range, optional

    kept = fact.where(
        (F.col("tenant_id") == tenant) & date_range("order_date", start, end)
        & (F.col("order_status") == status) & optional("product_id", product)
    )
    sums = ["ordered_quantity", "fulfilled_quantity", "returned_quantity", "line_net_cents", "refund_cents", "retained_revenue_cents"]
    return kept.groupBy(F.trunc("order_date", "month").alias("order_month"), "product_id").agg(
        *[F.sum(c).alias(c) for c in sums]
    ).withColumn("fulfillment_rate", ratio(F.col("fulfilled_quantity"), F.col("ordered_quantity")))
