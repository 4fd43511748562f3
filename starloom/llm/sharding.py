"""Uniform shuffle into shards of exact sizes by a hypergeometric communication matrix.

The rows of the input's partitions are first written with their place. A matrix
then says how many rows of each source partition go to each shard: its row for a
partition is drawn from the multivariate hypergeometric law of the room that is
left, so shard sizes are exact (at most one apart) and the result is distributed
like a uniform permutation. Each partition deals its rows out by its matrix row in
a random order, before they move; so they move once, whole. Each shard then orders what it got at random again.

All draws come from the seed and the rows' places; a lost executor repeats them.
Work is split by source partition, then by shard and slice of the random order:
no task holds a shard, and no key matters, so hot keys and copies don't either.
The driver holds one number per (partition, shard). Null texts, repeated rows and
ties are rows like others. More shards than rows leaves some shards empty.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from starloom.llm.common import written

ROWS_PER_SLICE = 1 << 16  # rows come with their texts


def communication_matrix(counts: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """Rows of each source partition that go to each shard."""
    rng = np.random.default_rng(seed)
    total = int(counts.sum())
    room = np.array([total // shards + (s < total % shards) for s in range(shards)], np.int64)
    rng.shuffle(room)
    out = np.zeros((len(counts), shards), np.int64)
    for p, n in enumerate(counts.tolist()):
        rest = int(room.sum())
        for s, good in enumerate(room.tolist()):
            rest -= good
            out[p, s] = hypergeometric(rng, good, rest, n)
            n -= int(out[p, s])
        room -= out[p]
    return out


def hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """Good ones among ``n`` drawn. Above numpy's limit the law is inverted over 14 deviations around its mode."""
    if n == 0 or good == 0:
        return 0
    if bad == 0:
        return n
    if good + bad < 1_000_000_000:
        return int(rng.hypergeometric(good, bad, n))
    low, high = max(0, n - bad), min(n, good)
    share = good / (good + bad)
    reach = int(14 * (n * share * (1 - share)) ** 0.5 + 50)
    k = np.arange(max(low, int(n * share) - reach), min(high, int(n * share) + reach) + 1, dtype=float)
    steps = np.log((good - k[:-1]) / (k[1:])) + np.log((n - k[:-1]) / (bad - n + k[1:]))
    log_p = np.concatenate([[0.0], np.cumsum(steps)])
    p = np.exp(log_p - log_p.max())
    return int(k[min(np.searchsorted(np.cumsum(p), rng.random() * p.sum()), len(k) - 1)])


def shard(df: DataFrame, shards: int, seed: int = 7) -> DataFrame:
    """All columns of ``df`` with shard (0 ..) and slot (gapless from 0 in each shard)."""
    spark = df.sparkSession
    place = F.monotonically_increasing_id()
    rows = written(df.select("*", place.alias("_place")), "shard-rows")
    source = F.shiftright("_place", 33)  # the input partition
    counts = sorted((r["p"], r["n"]) for r in rows.groupBy(source.alias("p")).agg(F.count("*").alias("n")).collect())
    matrix = communication_matrix(np.array([n for _, n in counts], np.int64), shards, seed)
    plan = spark.sparkContext.broadcast({p: row for (p, _), row in zip(counts, matrix, strict=True)})

    @F.pandas_udf("int")
    def dealt_to(places: pd.Series) -> pd.Series:
        """The partition's row of the matrix, dealt out in a random order to its rows, which are numbered from 0."""
        at = places.to_numpy(np.int64)
        out = np.empty(len(at), np.int32)
        for p in np.unique(at >> 33).tolist():
            mine = at >> 33 == p
            if p not in last:
                last.clear()
                last[p] = np.random.default_rng([seed, p]).permutation(np.repeat(np.arange(shards, dtype=np.int32), plan.value[p]))
            out[mine] = last[p][at[mine] & ((1 << 33) - 1)]
        return pd.Series(out)

    last: dict[int, np.ndarray] = {}
    dealt = rows.withColumn("shard", dealt_to("_place"))
    # Permute again inside each shard: slices of the random order, each counted, then numbered.
    slices = max(1, -(-sum(n for _, n in counts) // (shards * ROWS_PER_SLICE)))
    order = F.xxhash64(F.lit(seed + 1), "_place", "shard")
    sliced = dealt.withColumn("_o", order).withColumn("_s", F.floor((F.col("_o") / 2.0**64 + 0.5) * slices).cast("int"))
    before: dict[tuple[int, int], int] = {}
    at = Window.partitionBy("shard", "_s").orderBy("_o", "_place")
    numbered = sliced.withColumn("slot", F.row_number().over(at).cast("long") - 1)
    if slices > 1:
        held = sorted(((r["shard"], r["_s"]), r["n"]) for r in sliced.groupBy("shard", "_s").agg(F.count("*").alias("n")).collect())
        total: dict[int, int] = {}
        for (s, k), n in held:
            before[s, k] = total.get(s, 0)
            total[s] = before[s, k] + n
        offsets = spark.createDataFrame([(s, k, n) for (s, k), n in before.items()], "shard int, _s int, _before long")
        numbered = numbered.join(offsets, ["shard", "_s"]).withColumn("slot", F.col("slot") + F.col("_before")).drop("_before")
    return numbered.drop("_o", "_s", "_place")
