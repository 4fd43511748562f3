"""Integer k-means by column expressions: literal centroid arrays, exact sums.

Vectors become integers, ``floor(scale * x)`` for every component, and are
written once. A round is one scan of that table and one aggregate: ``zip_with``
and ``aggregate`` give the squared distance to each literal centroid, the least
struct (distance, number) of an array names the cluster, and the columns of the
vectors are summed by cluster, map-side first. The driver gets one row of sums
per cluster, whatever the table holds, and makes the next literals of them. No
Python code runs on a row, and a cluster with most rows is a few partial sums.

Only vectors of ``components`` components, none null or non-finite, are kept.
Centroids start as the kept vectors with the smallest hash of their id; equal
hashes (repeated ids) start in order of their components, each row by itself. A
null id hashes as the empty text. Fewer vectors than clusters give fewer
centroids, an empty table gives an empty result. Ties go to the smaller number,
an empty cluster stays where it is. Repeated rows count each. Other columns are
not read, so their names cannot clash.

Integers are exact: a component of ``LIMIT`` or more in size stops the job, since
squared distances of such vectors don't fit a long.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starloom.llm.common import written
from starloom.operators.joins import fail_when

LIMIT = 1 << 27  # integers below it: 64 squared differences fit a long


def integers(vectors: DataFrame, components: int = 64, scale: int = 1024, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id, q (the integer components) and norm (the sum of their squares) of the vectors that are kept."""
    kept = vectors.select(F.col(id_column).alias("vec_id"), F.col(vector).cast("array<double>").alias("x"))
    sound = F.forall("x", lambda v: F.coalesce(F.abs(v) < F.lit(float("inf")), F.lit(False)))  # NaN is above infinity
    kept = kept.where((F.size("x") == components) & sound)
    whole = kept.select("vec_id", F.transform("x", lambda v: F.floor(v * F.lit(float(scale)))).alias("q"))
    return whole.where(fail_when(F.exists("q", lambda v: (v >= F.lit(LIMIT)) | (v <= F.lit(-LIMIT))), f"a component is {LIMIT} or more in size")).withColumn("norm", F.aggregate("q", F.lit(0).cast("long"), lambda s, v: s + v * v))


def nearest(centroids: list[list[int]], q: str = "q") -> Column:
    """Struct of the least squared distance and its cluster, the smaller number on ties.

    The distance is the vector's ``norm`` (its squared length) and the centroid's less twice
    their product, one multiplication a component.
    """
    def squared(c: list[int]) -> Column:
        product = F.aggregate(F.zip_with(q, F.lit(np.array(c, np.int64)), lambda a, b: a * b), F.lit(0).cast("long"), lambda s, v: s + v)
        return F.col("norm") + F.lit(sum(x * x for x in c)).cast("long") - 2 * product

    return F.array_min(F.array(*[F.struct(squared(c).alias("distance"), F.lit(k).alias("cluster")) for k, c in enumerate(centroids)]))


def first_centroids(whole: DataFrame, clusters: int, salt: str = "3") -> list[list[int]]:
    """Vectors with the smallest sha256 of ``salt:vec_id``, at most one per cluster."""
    hashed = F.sha2(F.concat(F.lit(f"{salt}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))).cast("binary"), 256)
    return [list(r["q"]) for r in whole.select(hashed.alias("h"), "q").orderBy("h", "q").limit(clusters).collect()]


def next_centroids(whole: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """Component-wise floor of the mean of each cluster's vectors, from one aggregate."""
    size = len(centroids[0])
    marked = whole.select(nearest(centroids)["cluster"].alias("cluster"), "q")
    sums = marked.groupBy("cluster").agg(F.count("*").alias("n"), F.expr(f"array({', '.join(f'sum(q[{i}])' for i in range(size))})").alias("q"))
    out = list(centroids)
    for row in sums.collect():  # a row per cluster
        out[row["cluster"]] = [total // row["n"] for total in row["q"]]
    return out


def fit(whole: DataFrame, clusters: int = 8, rounds: int = 10, salt: str = "3") -> list[list[int]]:
    """Centroids after the rounds. ``whole``: a table as of ``integers``, written by the caller as it is read each round."""
    centroids = first_centroids(whole, clusters, salt)
    for _ in range(rounds if centroids else 0):
        centroids = next_centroids(whole, centroids)
    return centroids


def assign(whole: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """vec_id, cluster, distance of every kept vector, its cluster's and the total distance, and a digest of its centroid."""
    spark = whole.sparkSession
    if not centroids:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    found = whole.select("vec_id", nearest(centroids).alias("found")).select("vec_id", F.col("found.cluster").alias("cluster"), F.col("found.distance").alias("distance"))
    placed = written(found, "clustering-assigned")
    sums = {r["cluster"]: int(r["d"]) for r in placed.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("d")).collect()}
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    of = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), F.col("cluster") + 1)
    return placed.select(
        "vec_id", "cluster", "distance", of([sums.get(k, 0) for k in range(len(centroids))]).cast("long").alias("cluster_inertia"),
        F.lit(sum(sums.values())).cast("long").alias("inertia"), of(digests).alias("centroid_sha256"))


def centroid_clusters(vectors: DataFrame, clusters: int = 8, rounds: int = 10, salt: str = "3", components: int = 64, scale: int = 1024) -> DataFrame:
    """The whole job: integers written once, centroids fitted, every kept vector assigned."""
    whole = written(integers(vectors, components, scale), "clustering-integers")
    return assign(whole, fit(whole, clusters, rounds, salt))
