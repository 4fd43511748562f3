"""Scalar functions and timeframes."""

from pyspark.sql import functions as F

from starloom.functions import scalars as s
from starloom.functions.timeframes import timeframe
from starloom.registry.base import query, table


@query("fn_string", """
SELECT p_partkey, lower(p_type) AS low, upper(p_name) AS up, trim('  ' || p_brand || ' ') AS trimmed, p_brand || '/' || p_type AS joined,
       concat_ws('-', p_brand, p_type, CAST(p_size AS VARCHAR)) AS joined_ws, p_name LIKE '%ring' AS is_ring, md5(p_name) AS hash, substr(p_brand, 1, 5) AS head FROM part""")
def fn_string(spark, sf):
    p = table(spark, sf, "part")
    return p.select(
        "p_partkey", F.lower("p_type").alias("low"), F.upper("p_name").alias("up"), F.trim(F.concat(F.lit("  "), "p_brand", F.lit(" "))).alias("trimmed"),
        F.concat("p_brand", F.lit("/"), "p_type").alias("joined"), F.concat_ws("-", "p_brand", "p_type", "p_size").alias("joined_ws"),
        F.col("p_name").like("%ring").alias("is_ring"), F.md5("p_name").alias("hash"), F.substring("p_brand", 1, 5).alias("head"))


@query("fn_cast", """
SELECT event_id, TRY_CAST(props AS BIGINT) AS not_a_number, TRY_CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS k, coalesce(nullif(event_type, 'view'), 'looked') AS kind,
       coalesce(CASE WHEN event_type = 'error' THEN NULL ELSE CAST(value * 100 AS BIGINT) END, 0) AS zero_if_null FROM events""")
def fn_cast(spark, sf):
    e = table(spark, sf, "events")
    scaled = F.round(F.col("value") * 100).cast("long")
    return e.select(
        "event_id", F.col("props").try_cast("long").alias("not_a_number"), F.regexp_extract("props", "[0-9]+", 0).try_cast("long").alias("k"),
        F.coalesce(F.nullif(F.col("event_type"), F.lit("view")), F.lit("looked")).alias("kind"),
        F.coalesce(F.when(F.col("event_type") != "error", scaled), F.lit(0)).alias("zero_if_null"))


@query("fn_date", """
SELECT event_id, strftime(date_trunc('month', ts), '%Y-%m-%d') AS month, strftime(ts, '%Y-%m-%d %H:%M:%S') AS stamp,
       CAST(CAST((ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/Chicago' AS DATE) AS VARCHAR) AS local_day FROM events""")
def fn_date(spark, sf):
    return table(spark, sf, "events").select(
        "event_id", s.month_start("ts").cast("string").alias("month"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("stamp"),
        s.local_date("ts", "America/Chicago").cast("string").alias("local_day"))


@query("fn_timeframes", """
SELECT event_id, strftime(ts, '%Y-%m-%d') AS date, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS hour,
       strftime(date_trunc('minute', ts), '%Y-%m-%d %H:%M:%S') AS minute, strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') AS second,
       strftime(date_trunc('week', ts), '%Y-%m-%d') AS week, strftime(date_trunc('week', CAST(ts AS DATE) + 1) - INTERVAL 1 DAY, '%Y-%m-%d') AS week_sunday,
       strftime(date_trunc('month', ts), '%Y-%m-%d') AS month, strftime(date_trunc('quarter', ts), '%Y-%m-%d') AS quarter, strftime(date_trunc('year', ts), '%Y-%m-%d') AS year,
       CAST(hour(ts) AS BIGINT) AS hour_of_day, dayname(ts) AS day_of_week_name, CAST(isodow(ts) AS BIGINT) AS day_of_week_num, CAST(day(ts) AS BIGINT) AS day_of_month,
       CAST(datediff('day', date_trunc('quarter', ts), ts) + 1 AS BIGINT) AS day_of_quarter, CAST(dayofyear(ts) AS BIGINT) AS day_of_year, monthname(ts) AS month_name,
       CAST(month(ts) AS BIGINT) AS month_num, CAST(quarter(ts) AS BIGINT) AS quarter_of_year,
       CAST(quarter(ts - INTERVAL 3 MONTH) AS BIGINT) AS fiscal_quarter, CAST(year(ts - INTERVAL 3 MONTH) AS BIGINT) AS fiscal_year FROM events""")
def fn_timeframes(spark, sf):
    e = table(spark, sf, "events")
    day = lambda n, **k: timeframe("ts", n, **k).cast("date").cast("string")
    stamp = lambda n: F.date_format(timeframe("ts", n), "yyyy-MM-dd HH:mm:ss")
    num = lambda n, **k: timeframe("ts", n, **k).cast("long")
    dates = ["date", "week", "month", "quarter", "year"]
    numbers = ["hour_of_day", "day_of_week_num", "day_of_month", "day_of_quarter", "day_of_year", "month_num", "quarter_of_year"]
    return e.select(
        "event_id", *[day(n).alias(n) for n in dates], *[stamp(n).alias(n) for n in ("hour", "minute", "second")],
        day("week", week_start_day="sunday").alias("week_sunday"), *[num(n).alias(n) for n in numbers],
        timeframe("ts", "day_of_week_name").alias("day_of_week_name"), timeframe("ts", "month_name").alias("month_name"),
        *[num(n, fiscal_month_offset=3).alias(n) for n in ("fiscal_quarter", "fiscal_year")])


@query("fn_math", """
SELECT s_suppkey, CAST(round(s_acctbal * 100) AS BIGINT) AS c, -CAST(round(s_acctbal * 100) AS BIGINT) AS negated,
       CAST(round(s_acctbal * 100) AS DOUBLE) / nullif(s_nationkey, 0) AS per_nation FROM supplier""")
def fn_math(spark, sf):
    c = s.cents("s_acctbal")
    return table(spark, sf, "supplier").select("s_suppkey", c.alias("c"), (-c).alias("negated"), s.ratio(c, F.col("s_nationkey")).alias("per_nation"))


@query("fn_hashing", """
SELECT doc_id, md5(lang || ':' || CAST(doc_id AS VARCHAR)) AS surrogate, sha256('{"doc_id":' || doc_id || ',"lang":"' || lang || '","source":"' || source || '"}') AS record_hash FROM documents""")
def fn_hashing(spark, sf):
    return table(spark, sf, "documents").select("doc_id", s.surrogate_key("lang", "doc_id").alias("surrogate"), s.row_hash("doc_id", "lang", "source").alias("record_hash"))


@query("fn_luhn", """
WITH digits AS (SELECT o_orderkey AS k, lpad(CAST(o_orderkey * 7919 + o_custkey AS VARCHAR), 16, '4') AS n FROM orders)
SELECT k AS o_orderkey, (list_sum(list_transform(range(1, 17), lambda i: CASE WHEN (16 - i) % 2 = 0 THEN CAST(substr(n, i, 1) AS INTEGER)
  ELSE CASE WHEN CAST(substr(n, i, 1) AS INTEGER) > 4 THEN CAST(substr(n, i, 1) AS INTEGER) * 2 - 9 ELSE CAST(substr(n, i, 1) AS INTEGER) * 2 END END)) % 10 = 0) AS is_valid FROM digits""")
def fn_luhn(spark, sf):
    number = F.lpad((F.col("o_orderkey") * 7919 + F.col("o_custkey")).cast("string"), 16, "4")
    return table(spark, sf, "orders").select("o_orderkey", s.luhn_ok(number).alias("is_valid"))


@query("fn_identifier", """
SELECT DISTINCT s_name, trim(regexp_replace(lower(trim(s_name)), '[^a-z0-9]+', '_', 'g'), '_') AS id FROM supplier
UNION ALL SELECT DISTINCT o_orderpriority, trim(regexp_replace(lower(trim(o_orderpriority)), '[^a-z0-9]+', '_', 'g'), '_') FROM orders""")
def fn_identifier(spark, sf):
    names = table(spark, sf, "supplier").select("s_name").distinct().unionByName(table(spark, sf, "orders").select(F.col("o_orderpriority").alias("s_name")).distinct())
    return names.select("s_name", s.identifier("s_name").alias("id"))


@query("fn_array_set", """
SELECT p_brand, string_agg(DISTINCT v, ',' ORDER BY v) AS ids FROM (SELECT p_brand, p_type AS v FROM part UNION ALL SELECT p_brand, split_part(p_name, ' ', 2) FROM part) GROUP BY 1""")
def fn_array_set(spark, sf):
    """Rows shrink to (brand, value) pairs before the sets are built."""
    p = table(spark, sf, "part")
    types = p.select("p_brand", F.col("p_type").alias("v")).distinct().groupBy("p_brand").agg(F.collect_set("v").alias("a"))
    nouns = p.select("p_brand", F.split_part("p_name", F.lit(" "), F.lit(2)).alias("v")).distinct().groupBy("p_brand").agg(F.collect_set("v").alias("b"))
    return types.join(nouns, "p_brand").select("p_brand", F.array_join(F.array_sort(F.array_union("a", "b")), ",").alias("ids"))


@query("fn_json", """
SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, '["' || event_type || '","' || user_id || '"]' AS pair, CAST(user_id AS VARCHAR) AS second_item FROM events""")
def fn_json(spark, sf):
    pair = F.to_json(F.array("event_type", F.col("user_id").cast("string")))
    return table(spark, sf, "events").select(
        "event_id", F.from_json("props", "k bigint")["k"].alias("k"), pair.alias("pair"), F.element_at(F.from_json(pair, "array<string>"), 2).alias("second_item"))
