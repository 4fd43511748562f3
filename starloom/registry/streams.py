"""Streaming queries: the derived logs are written as files and replayed."""

from pyspark.sql import functions as F

from starloom.operators import reconcile as r
from starloom.registry import derived as d
from starloom.registry.base import query, table
from starloom.session import scratch_path
from starloom.streaming import cdc as s

KEYS = ["tenant_id", "invoice_id"]


def _replayed_state(spark, sf):
    """Newest versions are delivered first, in several micro-batches."""
    root = scratch_path(spark, "invoice-stream")
    log = d.invoice_cdc(spark, sf)
    for batch, seqs in enumerate(("source_seq = 3", "source_seq = 2", "source_seq = 1")):
        log.where(seqs).write.parquet(f"{root}/log/batch={batch}")
    source = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", max(8, spark.sparkContext.defaultParallelism)).parquet(f"{root}/log/batch=*")
    s.start_upsert(source, KEYS, d.ORDER_BY, f"{root}/state", f"{root}/checkpoint").awaitTermination()
    return s.read_state(spark, f"{root}/state", KEYS, d.ORDER_BY, F.col("op") == "DELETE")


@query("stream_cdc_upsert", "SELECT tenant_id, invoice_id, status, gross_cents, source_seq FROM invoices")
def stream_cdc_upsert(spark, sf):
    return _replayed_state(spark, sf).select("tenant_id", "invoice_id", F.lower(F.trim("status")).alias("status"), "gross_cents", "source_seq")


@query("stream_dedup_events", "SELECT event_type, count(*) AS n_events, count(DISTINCT user_id) AS n_users FROM events GROUP BY 1")
def stream_dedup_events(spark, sf):
    root = scratch_path(spark, "event-stream")
    e = table(spark, sf, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type")
    copies = e.withColumn("_n", F.explode(F.sequence(F.lit(1), F.when(F.col("event_type") == "click", 3).otherwise(1)))).drop("_n")
    copies.repartition("event_id").write.parquet(f"{root}/log")
    # No row is later than the whole span, so none is dropped whatever order the files arrive in.
    span = e.agg((F.datediff(F.max("ts"), F.min("ts")) + 2).alias("n")).first()["n"] or 1
    stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 2).parquet(f"{root}/log")
    first = s.drop_redelivered(stream, ["event_id"], "ts", f"{span} days")
    job = first.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/checkpoint").outputMode("append").trigger(availableNow=True).start()
    job.awaitTermination()
    return spark.read.parquet(f"{root}/out").groupBy("event_type").agg(F.count("*").alias("n_events"), F.count_distinct("user_id").alias("n_users"))


@query("stream_equals_batch", """
SELECT 'invoices' AS case_id, 'correctness' AS category, CAST(0 AS BIGINT) AS missing_keys, CAST(0 AS BIGINT) AS extra_keys, CAST(0 AS BIGINT) AS value_mismatches, CAST(0 AS BIGINT) AS refused_keys, true AS passed""")
def stream_equals_batch(spark, sf):
    contract = r.ResultContract({c: r.ColumnRule("string") for c in (*KEYS, "status", "gross_cents", "source_seq")}, KEYS)
    cols = [*KEYS, F.lower(F.trim("status")).alias("status"), "gross_cents", "source_seq"]
    return r.diff_summary(r.keyed_diff(d.invoices(spark, sf).select(*cols), _replayed_state(spark, sf).select(*cols), contract), "invoices", "correctness")
