"""Semantic-layer queries and filter context."""

from pyspark.sql import functions as F

from starloom.functions import scalars as s
from starloom.operators.aggregates import sum_where
from starloom.operators.windows import partition_share
from starloom.plans import context as ctx
from starloom.plans.semantic import Calculation, Measure, Pivot, SemanticModel, Timed, select_fields
from starloom.registry import derived as d
from starloom.registry.aggregates import orders_c
from starloom.registry.base import CTES, query, table


def billing_model(spark, sf) -> SemanticModel:
    """Invoices with tenant access, a fixed population and composed measures."""
    fact = d.billing(spark, sf).withColumn("invoice_month", F.trunc("invoice_date", "month").cast("string"))
    posted = {"invoices__status": {"is": "posted"}}
    return SemanticModel(
        base="invoices", views={"invoices": fact}, access={"invoices__tenant_id": "tenant_id"},
        always_where={"invoices__currency": {"is": "USD"}},
        measures={
            "invoice_count": Measure("count"), "net": Measure("sum", "invoices__net_cents"), "paid": Measure("sum", "invoices__paid_cents"),
            "posted_net": Measure("sum", "invoices__net_cents", filters=posted), "posted_count": Measure("count", filters=posted),
            "outstanding": Measure(compose=lambda m: m("net") - m("paid")), "paid_ratio": Measure(compose=lambda m: s.ratio(m("paid"), m("net"))),
        })


_BILLING = "FROM (SELECT *, strftime(date_trunc('month', invoice_date), '%Y-%m-%d') AS invoice_month FROM fct_billing WHERE currency = 'USD' AND tenant_id = 'T2')"


@query("semantic_query", f"""
SELECT invoice_month, segment, count(*) AS invoice_count, CAST(sum(net_cents) AS BIGINT) AS net_cents, CAST(sum(net_cents) FILTER (WHERE status = 'posted') AS BIGINT) AS posted_net_cents,
       count(*) FILTER (WHERE status = 'posted') AS posted_count, CAST(sum(net_cents) AS BIGINT) - CAST(sum(paid_cents) AS BIGINT) AS outstanding_cents,
       CAST(CAST(sum(paid_cents) AS BIGINT) AS DOUBLE) / nullif(CAST(sum(net_cents) AS BIGINT), 0) AS paid_ratio
{_BILLING} WHERE invoice_date >= DATE '1996-01-01' AND invoice_date < DATE '2000-01-01' GROUP BY 1, 2""")
def semantic_query(spark, sf):
    return billing_model(spark, sf).query(
        {"invoice_month": "invoices__invoice_month", "segment": "invoices__segment"},
        {"invoice_count": "invoice_count", "net_cents": "net", "posted_net_cents": "posted_net", "posted_count": "posted_count",
         "outstanding_cents": "outstanding", "paid_ratio": "paid_ratio"},
        filters={"invoices__invoice_date": {"between_dates": ("1996-01-01", "2000-01-01")}}, sorts=["invoice_month", "segment"], user={"tenant_id": "T2"})


@query("semantic_distinct_dims", f"SELECT DISTINCT segment, status {_BILLING}")
def semantic_distinct_dims(spark, sf):
    return billing_model(spark, sf).query({"segment": "invoices__segment", "status": "invoices__status"}, user={"tenant_id": "T2"})


@query("semantic_access_filter", """
SELECT tenant_id, status, count(*) AS invoice_count, CAST(sum(net_cents) AS BIGINT) AS net_cents FROM fct_billing WHERE tenant_id = 'T4' AND currency = 'USD' GROUP BY 1, 2""")
def semantic_access_filter(spark, sf):
    """Even a filter that asks for another tenant only narrows the user's own rows."""
    return billing_model(spark, sf).query(
        {"tenant_id": "invoices__tenant_id", "status": "invoices__status"}, {"invoice_count": "invoice_count", "net_cents": "net"}, user={"tenant_id": "T4"})


def sales_model(spark, sf, **extra) -> SemanticModel:
    views, edges = d.sales_views(spark, sf)
    urgent = {"orders__o_orderpriority": {"is": "1-URGENT"}}
    return SemanticModel(base="orders", views=views, edges=edges, measures={
        "orders": Measure("count"), "revenue": Measure("sum", "orders__total_cents"), "urgent_revenue": Measure("sum", "orders__total_cents", filters=urgent),
        "urgent_share": Measure(compose=lambda m: s.ratio(m("urgent_revenue"), m("revenue"))),
        "average": Measure(compose=lambda m: s.ratio(m("revenue"), m("orders"))),
    }, dimensions={"month": F.col("orders__order_month").cast("string")}, **extra)


CTES["sales"] = """
SELECT o.*, c_mktsegment, n_name, r_name FROM orders_c o LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey"""
CTES["orders_by_customer"] = """
SELECT o_custkey AS customer, count(*) AS order_count, CAST(sum(c) AS BIGINT) AS revenue_cents FROM orders_c WHERE o_orderstatus <> 'P' GROUP BY 1"""


def orders_by_customer(spark, sf):
    """Saved query that other queries use as a relation."""
    return sales_model(spark, sf).query({"customer": "orders__o_custkey"}, {"order_count": "orders", "revenue_cents": "revenue"}, filters={"orders__o_orderstatus": {"not": "P"}})


@query("semantic_query_view", """
SELECT c_mktsegment AS segment, count(*) AS customers, CAST(sum(order_count) AS BIGINT) AS order_count, max(revenue_cents) AS best_cents
FROM orders_by_customer JOIN customer ON customer = c_custkey GROUP BY 1""")
def semantic_query_view(spark, sf):
    view = orders_by_customer(spark, sf).join(table(spark, sf, "customer").select(F.col("c_custkey").alias("customer"), "c_mktsegment"), "customer")
    model = SemanticModel(base="v", views={"v": view}, measures={"customers": Measure("count"), "orders": Measure("sum", "v__order_count"), "best": Measure("max", "v__revenue_cents")})
    return model.query({"segment": "v__c_mktsegment"}, {"customers": "customers", "order_count": "orders", "best_cents": "best"})


@query("semantic_sql_view", """
SELECT order_count, count(*) AS customers, CAST(sum(revenue_cents) AS BIGINT) AS revenue_cents FROM orders_by_customer GROUP BY order_count HAVING count(*) > 1""")
def semantic_sql_view(spark, sf):
    return spark.sql(
        "SELECT order_count, count(*) AS customers, sum(revenue_cents) AS revenue_cents FROM {saved} GROUP BY order_count HAVING count(*) > 1",
        saved=orders_by_customer(spark, sf))


@query("semantic_field_selection", """
SELECT r_name AS region__r_name, c_mktsegment AS customer__c_mktsegment, o_orderstatus AS orders__o_orderstatus, count(*) AS n FROM sales GROUP BY 1, 2, 3""")
def semantic_field_selection(spark, sf):
    model = sales_model(spark, sf)
    tags = {"r_name": ("geo",), "n_name": ("geo", "detail"), "c_mktsegment": ("report",), "o_orderstatus": ("report",)}
    fields = [(v, c, tags.get(c, ()), ("dim",) if v != "orders" else ()) for v, df in model.views.items() for c in df.columns]
    chosen = [f.replace(".", "__") for f in select_fields(fields, ["tag:report", "tag:geo", "-tag:detail"])]
    counted = SemanticModel(base="orders", views=model.views, edges=model.edges, measures={"n": Measure("count")})
    return counted.query({c: c for c in chosen}, {"n": "n"})


@query("semantic_field_lineage", """
SELECT 'segment' AS output, 'customer__c_mktsegment' AS source_field, 'value' AS role, count(c_mktsegment) AS n_values FROM sales WHERE o_orderstatus <> 'P'
UNION ALL SELECT 'urgent_share', 'orders__total_cents', 'value', count(c) FROM sales WHERE o_orderstatus <> 'P'
UNION ALL SELECT 'urgent_share', 'orders__o_orderpriority', 'value', count(o_orderpriority) FROM sales WHERE o_orderstatus <> 'P'
UNION ALL SELECT 'segment', 'orders__o_orderstatus', 'population', count(o_orderstatus) FROM sales WHERE o_orderstatus <> 'P'
UNION ALL SELECT 'urgent_share', 'orders__o_orderstatus', 'population', count(o_orderstatus) FROM sales WHERE o_orderstatus <> 'P'""")
def semantic_field_lineage(spark, sf):
    """Which fields feed each output, with how many values each field supplies."""
    model = sales_model(spark, sf, always_where={"orders__o_orderstatus": {"not": "P"}})
    found = model.lineage({"segment": "customer__c_mktsegment"}, {"urgent_share": "urgent_share"})
    entries = [(out, f, role) for out, parts in found.items() for role, fs in (("value", parts["fields"]), ("population", parts["population"])) for f in fs]
    fields = sorted({f for _, f, _ in entries})
    counts = model.rows(None, {}, [F.col(f) for f in fields]).agg(*[F.count(f).alias(f) for f in fields])
    rows = F.array(*[F.struct(F.lit(o).alias("output"), F.lit(f).alias("source_field"), F.lit(r).alias("role"), F.col(f).alias("n_values")) for o, f, r in entries])
    return counts.select(F.explode(rows).alias("r")).select("r.*")


@query("query_pivot", """
SELECT order_month, CAST(sum(c) FILTER (WHERE o_orderstatus = 'F') AS BIGINT) AS "F", CAST(sum(c) FILTER (WHERE o_orderstatus = 'O') AS BIGINT) AS "O",
       CAST(sum(c) FILTER (WHERE o_orderstatus IS NULL OR o_orderstatus NOT IN ('F', 'O')) AS BIGINT) AS "P*" FROM orders_c GROUP BY 1""")
def query_pivot(spark, sf):
    """Two statuses asked for; every other one is in the rest column."""
    return sales_model(spark, sf).query({"order_month": "month", "status": "orders__o_orderstatus"}, {"revenue": "revenue"}, pivot=Pivot("status", ["F", "O"], rest="P*", limit=3))


@query("query_totals", """
SELECT coalesce(o_orderpriority, '(all)') AS priority, coalesce(o_orderstatus, '(all)') AS status, count(*) AS orders, CAST(sum(c) AS DOUBLE) / count(*) AS average_cents
FROM orders_c GROUP BY CUBE (o_orderpriority, o_orderstatus)""")
def query_totals(spark, sf):
    return sales_model(spark, sf).query({"priority": "orders__o_orderpriority", "status": "orders__o_orderstatus"}, {"orders": "orders", "average_cents": "average"}, totals=True)


def events_model(spark, sf) -> SemanticModel:
    """Events of some users carry no day."""
    day = F.when(F.col("events__user_id") % 97 != 5, F.col("events__ts").cast("date"))
    return SemanticModel(base="events", views={"events": table(spark, sf, "events")}, measures={"n": Measure("count")}, dimensions={"day": day})


@query("query_fill", """
WITH e AS (SELECT event_type, value, CASE WHEN user_id % 97 <> 5 THEN CAST(ts AS DATE) END AS day FROM events),
days AS (SELECT CAST(unnest(generate_series((SELECT min(day) FROM e), (SELECT max(day) FROM e), INTERVAL 1 DAY)) AS DATE) AS day),
large AS (SELECT event_type, day, count(*) AS n FROM e WHERE value > 100 GROUP BY 1, 2)
SELECT CAST(d.day AS VARCHAR) AS day, t.event_type, coalesce(n, 0) AS large_events FROM days d CROSS JOIN (SELECT DISTINCT event_type FROM large) t LEFT JOIN large l ON l.day = d.day AND l.event_type = t.event_type
UNION ALL SELECT NULL, event_type, n FROM large WHERE day IS NULL""")
def query_fill(spark, sf):
    out = events_model(spark, sf).query({"day": "day", "event_type": "events__event_type"}, {"large_events": "n"}, filters={"events__value": {"greater_than": 100}}, fill="day")
    return out.withColumn("day", F.col("day").cast("string"))


@query("query_calculations", """
SELECT order_month, revenue_cents, CAST(sum(revenue_cents) OVER (ORDER BY order_month) AS BIGINT) AS running_cents, revenue_cents - lag(revenue_cents) OVER (ORDER BY order_month) AS change_cents
FROM (SELECT order_month, CAST(sum(c) AS BIGINT) AS revenue_cents FROM orders_c GROUP BY 1)""")
def query_calculations(spark, sf):
    """Post-query columns, ordered range by range."""
    return sales_model(spark, sf).query(
        {"order_month": "month"}, {"revenue_cents": "revenue"}, sorts=["order_month"],
        calculations={"running_cents": Calculation("running_sum", "revenue_cents"), "change_cents": Calculation("change", "revenue_cents")})


@query("query_timezone", """
SELECT strftime((ts AT TIME ZONE 'UTC') AT TIME ZONE 'Asia/Tokyo', '%Y-%m-%d') AS local_day, event_type, count(*) AS n FROM events GROUP BY 1, 2""")
def query_timezone(spark, sf):
    out = events_model(spark, sf).query({"local_day": Timed("events__ts", "date"), "event_type": "events__event_type"}, {"n": "n"}, time_zone="Asia/Tokyo")
    return out.withColumn("local_day", F.col("local_day").cast("string"))


# ------------------------------------------------------------------- context

def report_rows(spark, sf):
    """Orders with customer segment and month, the rows every context report reads."""
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("segment"))
    return orders_c(spark, sf).join(c, "o_custkey").select("o_orderkey", "o_custkey", "o_orderdate", "order_month", "o_orderstatus", "o_orderpriority", "segment", "c")


CTES["report_rows"] = "SELECT o.*, c_mktsegment AS segment FROM orders_c o JOIN customer ON o_custkey = c_custkey"
CTES["report_year"] = "SELECT * FROM report_rows WHERE o_orderdate >= DATE '1996-01-01' AND o_orderdate < DATE '1997-01-01'"
YEAR = {"o_orderdate": {"between_dates": ("1996-01-01", "1997-01-01")}}
BUILT = {"segment": {"is": ["BUILDING", "MACHINERY"]}}


@query("ctx_fixed_lod", """
SELECT r.order_month, r.segment, CAST(sum(r.c) AS BIGINT) AS revenue_cents, min(f.v) AS smallest_customer_cents, max(f.v) AS largest_customer_cents FROM report_year r
JOIN (SELECT o_custkey, CAST(sum(c) AS BIGINT) AS v FROM report_year WHERE o_orderstatus = 'F' GROUP BY 1) f ON r.o_custkey = f.o_custkey
WHERE r.o_orderstatus = 'F' AND r.segment = 'BUILDING' GROUP BY 1, 2""")
def ctx_fixed_lod(spark, sf):
    return ctx.fixed_lod_report(
        report_rows(spark, sf), {**YEAR, "o_orderstatus": {"is": "F"}}, {"segment": {"is": "BUILDING"}}, ["o_custkey"], F.sum("c").alias("v"), ["order_month", "segment"],
        [F.sum("c").alias("revenue_cents"), F.min("v").alias("smallest_customer_cents"), F.max("v").alias("largest_customer_cents")])


@query("ctx_exclude_lod", """
SELECT r.order_month, r.segment, CAST(sum(r.c) AS BIGINT) AS revenue_cents, max(a.t) AS all_segments_cents FROM report_year r
JOIN (SELECT order_month, CAST(sum(c) AS BIGINT) AS t FROM report_year GROUP BY 1) a ON r.order_month = a.order_month WHERE r.segment IN ('BUILDING', 'MACHINERY') GROUP BY 1, 2""")
def ctx_exclude_lod(spark, sf):
    return ctx.context_report(report_rows(spark, sf), ["order_month", "segment"], {**YEAR, **BUILT}, {
        "revenue_cents": ctx.ContextMeasure("c"), "all_segments_cents": ctx.ContextMeasure("c", (ctx.Change("remove", "segment"),))}, locked=["o_orderdate"])


@query("ctx_replace_filter", """
SELECT segment, CAST(sum(CASE WHEN o_orderstatus = 'O' THEN c END) AS BIGINT) AS open_cents, CAST(sum(CASE WHEN o_orderstatus = 'F' THEN c END) AS BIGINT) AS filled_cents FROM report_year
GROUP BY 1 HAVING count(*) FILTER (WHERE o_orderstatus = 'O') > 0""")
def ctx_replace_filter(spark, sf):
    return ctx.context_report(report_rows(spark, sf), ["segment"], {**YEAR, "o_orderstatus": {"is": "O"}}, {
        "open_cents": ctx.ContextMeasure("c"), "filled_cents": ctx.ContextMeasure("c", (ctx.Change("replace", "o_orderstatus", {"is": "F"}),))})


@query("ctx_intersect_filter", """
SELECT segment, CAST(sum(c) AS BIGINT) AS shown_cents, CAST(sum(CASE WHEN o_orderstatus = 'F' THEN c END) AS BIGINT) AS kept_filled_cents, CAST(NULL AS BIGINT) AS kept_pending_cents
FROM report_year WHERE o_orderstatus IN ('F', 'O') GROUP BY 1""")
def ctx_intersect_filter(spark, sf):
    keep = lambda v: ctx.ContextMeasure("c", (ctx.Change("intersect", "o_orderstatus", {"is": v}),))
    return ctx.context_report(report_rows(spark, sf), ["segment"], {**YEAR, "o_orderstatus": {"is": ["F", "O"]}}, {
        "shown_cents": ctx.ContextMeasure("c"), "kept_filled_cents": keep("F"), "kept_pending_cents": keep("P")})


@query("ctx_visible_groups", """
SELECT v.order_month, v.o_orderpriority, v.selected_cents, f.filled_cents, m.month_cents FROM
 (SELECT order_month, o_orderpriority, CAST(sum(c) AS BIGINT) AS selected_cents FROM report_year WHERE o_orderstatus = 'P' AND segment = 'FURNITURE' GROUP BY 1, 2) v
LEFT JOIN (SELECT order_month, o_orderpriority, CAST(sum(c) AS BIGINT) AS filled_cents FROM report_year WHERE o_orderstatus = 'F' AND segment = 'FURNITURE' GROUP BY 1, 2) f
  ON v.order_month = f.order_month AND v.o_orderpriority = f.o_orderpriority
LEFT JOIN (SELECT order_month, CAST(sum(c) AS BIGINT) AS month_cents FROM report_year WHERE o_orderstatus = 'P' AND segment = 'FURNITURE' GROUP BY 1) m ON v.order_month = m.order_month""")
def ctx_visible_groups(spark, sf):
    return ctx.context_report(report_rows(spark, sf), ["order_month", "o_orderpriority"], {**YEAR, "o_orderstatus": {"is": "P"}, "segment": {"is": "FURNITURE"}}, {
        "selected_cents": ctx.ContextMeasure("c"), "filled_cents": ctx.ContextMeasure("c", (ctx.Change("replace", "o_orderstatus", {"is": "F"}),)),
        "month_cents": ctx.ContextMeasure("c", (ctx.Change("remove", "o_orderpriority"),))})


@query("ctx_selected_value", """
SELECT 'one' AS selection, segment, CAST(sum(c) AS BIGINT) * 2 AS scaled_cents FROM report_year GROUP BY 2
UNION ALL SELECT 'several', segment, CAST(sum(c) AS BIGINT) FROM report_year GROUP BY 2""")
def ctx_selected_value(spark, sf):
    base = ctx.context_report(report_rows(spark, sf), ["segment"], YEAR, {"r": ctx.ContextMeasure("c")})
    rows = {"one": [2], "several": [1, 2]}
    return base.select(F.explode(F.array(*[
        F.struct(F.lit(name).alias("selection"), "segment", (F.col("r") * ctx.selected_value(sel, 1)).alias("scaled_cents")) for name, sel in rows.items()])).alias("x")).select("x.*")


@query("ctx_what_if", "SELECT segment, CAST(sum(c) AS BIGINT) AS revenue_cents, CAST(sum(c) AS BIGINT) * 3 AS scenario_cents FROM report_year GROUP BY 1")
def ctx_what_if(spark, sf):
    base = ctx.context_report(report_rows(spark, sf), ["segment"], YEAR, {"revenue_cents": ctx.ContextMeasure("c")})
    return ctx.what_if(base, "revenue_cents", 3, "scenario_cents")


@query("ctx_share", """
SELECT order_month, segment, CAST(sum(c) AS BIGINT) AS revenue_cents, CAST(CAST(sum(c) AS BIGINT) AS DOUBLE) / nullif(CAST(sum(sum(c)) OVER (PARTITION BY order_month) AS DOUBLE), 0) AS month_share,
       CAST(CAST(sum(c) AS BIGINT) AS DOUBLE) / nullif(CAST(sum(sum(c)) OVER (PARTITION BY segment) AS DOUBLE), 0) AS segment_share FROM report_year GROUP BY 1, 2""")
def ctx_share(spark, sf):
    base = ctx.context_report(report_rows(spark, sf), ["order_month", "segment"], YEAR, {
        "revenue_cents": ctx.ContextMeasure("c"), "_all": ctx.ContextMeasure("c", (ctx.Change("remove", "segment"),))})
    shared = base.withColumn("month_share", s.ratio(F.col("revenue_cents"), F.col("_all"))).drop("_all")
    return partition_share(shared, ["segment"], "revenue_cents", "segment_share")


@query("ctx_blank_arith", """
SELECT doc_id, CASE WHEN quality IS NULL AND n IS NULL THEN NULL ELSE coalesce(quality, 0) + coalesce(n, 0) END AS added, CASE WHEN quality IS NULL AND n IS NULL THEN NULL ELSE coalesce(quality, 0) - coalesce(n, 0) END AS subtracted,
       quality * n AS multiplied, CASE WHEN n IS NULL OR n = 0 THEN NULL ELSE CAST(quality AS DOUBLE) / n END AS divided, CASE WHEN quality IS NULL OR quality = 0 THEN -1.0 ELSE CAST(n AS DOUBLE) / quality END AS divided_or
FROM (SELECT d.doc_id, CAST(l.quality AS BIGINT) AS quality, CASE WHEN d.lang = 'de' THEN NULL ELSE d.n_chars END AS n FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)""")
def ctx_blank_arith(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", "lang", "n_chars").join(table(spark, sf, "labels"), "doc_id", "left")
    a, b = F.col("quality").cast("long"), F.when(F.col("lang") != "de", F.col("n_chars"))
    return rows.select(
        "doc_id", s.blank_add(a, b).alias("added"), s.blank_subtract(a, b).alias("subtracted"), s.blank_multiply(a, b).alias("multiplied"),
        s.blank_divide(a, b).alias("divided"), s.blank_divide(b, a, F.lit(-1.0)).alias("divided_or"))


@query("ctx_empty_policy", """
SELECT 'one_null_row' AS policy, '-' AS grp, CAST(sum(c) AS BIGINT) AS revenue_cents FROM orders_c WHERE o_orderstatus = 'X'
UNION ALL SELECT 'explicit_zero', '-', CAST(coalesce(sum(c), 0) AS BIGINT) FROM orders_c WHERE o_orderstatus = 'X'
UNION ALL SELECT 'zero_rows', o_orderpriority, CAST(sum(c) AS BIGINT) FROM orders_c WHERE o_orderstatus = 'X' GROUP BY 2""")
def ctx_empty_policy(spark, sf):
    empty = {"o_orderstatus": {"is": "X"}}
    m = {"revenue_cents": ctx.ContextMeasure("c")}
    rows = report_rows(spark, sf)
    shape = lambda name, df, grp: df.select(F.lit(name).alias("policy"), grp.alias("grp"), "revenue_cents")
    return (shape("one_null_row", ctx.context_report(rows, [], empty, m), F.lit("-"))
            .unionByName(shape("explicit_zero", ctx.context_report(rows, [], empty, m, zeros=True), F.lit("-")))
            .unionByName(shape("zero_rows", ctx.context_report(rows, ["o_orderpriority"], empty, m), F.col("o_orderpriority"))))


@query("role_row_security", """
SELECT r_name, c_mktsegment AS segment, count(*) AS n_orders, CAST(sum(c) AS BIGINT) AS revenue_cents FROM orders_c JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
WHERE r_name = 'ASIA' AND o_orderstatus IN ('F', 'O') GROUP BY 1, 2""")
def role_row_security(spark, sf):
    """The role's predicates cut both inputs before they are joined."""
    policies = {
        "orders": {"asia_analyst": {"o_orderstatus": {"is": ["F", "O"]}}, "admin": {}},
        "customers": {"asia_analyst": {"r_name": {"is": "ASIA"}}, "admin": {}},
    }
    geo = table(spark, sf, "nation").withColumnRenamed("n_nationkey", "c_nationkey").join(table(spark, sf, "region").withColumnRenamed("r_regionkey", "n_regionkey"), "n_regionkey")
    customers = ctx.secure(table(spark, sf, "customer").join(geo, "c_nationkey"), "asia_analyst", policies["customers"])
    orders = ctx.secure(orders_c(spark, sf), "asia_analyst", policies["orders"])
    joined = orders.join(customers.select(F.col("c_custkey").alias("o_custkey"), "r_name", F.col("c_mktsegment").alias("segment")), "o_custkey")
    return joined.groupBy("r_name", "segment").agg(F.count("*").alias("n_orders"), F.sum("c").alias("revenue_cents"))


CTES["topics"] = """
SELECT p_brand AS base_view, p_partkey AS topic, CASE WHEN p_size <= 10 THEN NULL WHEN p_size <= 40 THEN m.main ELSE -1 END AS parent, m.main,
       p_type AS always_where, p_type = 'PROMO' AS has_type, p_size % 2 = 0 AS default_type FROM part JOIN (SELECT p_brand AS b, min(p_partkey) AS main FROM part WHERE p_size <= 10 GROUP BY 1) m ON p_brand = m.b"""


@query("topic_population_compare", """
SELECT t.base_view, t.topic, CASE WHEN t.topic = t.main THEN 'main' WHEN t.parent = t.main THEN 'variant' ELSE 'unlinked' END AS role, t.always_where = x.always_where AS same_population,
       CASE WHEN x.default_type AND t.has_type AND NOT x.has_type THEN 'type' ELSE '' END AS promoted_defaults
FROM topics t JOIN topics x ON t.main = x.topic AND t.base_view = x.base_view""")
def topic_population_compare(spark, sf):
    """Parts read as topics on their brand: small ones are roots, middle ones extend the first root."""
    p = table(spark, sf, "part")
    first = p.where("p_size <= 10").groupBy("p_brand").agg(F.min("p_partkey").alias("main"))
    fields = lambda test: F.when(test, F.array(F.lit("type"))).otherwise(F.array().cast("array<string>"))
    ancestors = F.when(F.col("p_size") <= 10, F.array().cast("array<bigint>")).when(F.col("p_size") <= 40, F.array("main")).otherwise(F.array(F.lit(-1).cast("long")))
    topics = p.join(first, "p_brand").select(
        F.col("p_brand").alias("base_view"), F.col("p_partkey").alias("topic"), ancestors.alias("ancestors"), F.col("p_type").alias("always_where"),
        fields(F.col("p_type") == "PROMO").alias("always_fields"), fields(F.col("p_size") % 2 == 0).alias("default_fields"))
    return ctx.topic_population(topics)
