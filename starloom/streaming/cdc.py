"""Change logs and events as Structured Streaming jobs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starloom.operators.cdc import latest_version


def stream_latest(log: DataFrame, keys: Sequence[str], order_by: Sequence[str]) -> DataFrame:
    """Streaming aggregate that keeps the greatest version per key in the state store."""
    rest = [c for c in log.columns if c not in keys]
    ties = [c for c in rest if c not in order_by]
    picked = log.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order_by, *ties)).alias("_row"))
    return picked.select(*[F.col(c) if c in keys else F.col("_row")[c].alias(c) for c in log.columns])


def upsert_to(path: str):
    """Batch writer: the keys a micro-batch changed go to their own epoch folder.

    Overwriting the folder makes a retried epoch harmless, and no batch rewrites
    the rows of earlier ones.
    """
    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return write


def start_upsert(log: DataFrame, keys: Sequence[str], order_by: Sequence[str], path: str, checkpoint: str):
    writer = stream_latest(log, keys, order_by).writeStream.outputMode("update").foreachBatch(upsert_to(path))
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_state(spark, path: str, keys: Sequence[str], order_by: Sequence[str], is_deleted) -> DataFrame:
    """Current rows of an upsert target: latest version over its epochs, tombstones left out."""
    return latest_version(spark.read.parquet(path).drop("epoch"), keys, order_by).where(~is_deleted)


def drop_redelivered(events: DataFrame, event_id: Sequence[str], at: str, delay: str) -> DataFrame:
    """First delivery of each event id; ids are forgotten once the watermark passes."""
    return events.withWatermark(at, delay).dropDuplicatesWithinWatermark(list(event_id))
