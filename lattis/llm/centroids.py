"""Centroid clustering with heap-ordered bounds, in exact integers.

A vector that was compared with all centroids has a gap: how much farther its second nearest centroid is than its own. The
gap lasts until centroids have moved by as much: an own centroid's move and the largest of the others' take from it. So
each cluster keeps a heap of its vectors' gaps, each raised by what the cluster had drifted in sum when it was pushed. A
round pops what lies at or below the drift so far and compares it with all centroids again; all others keep their cluster
unseen (Hamerly and Drake 2015). Distances are whole numbers; only gaps are floating, and give way by a margin that is
wider than their rounding.

Vectors are dealt to shards once, as a table bucketed by shard. A shard has a heap for each cluster, as one row; each round
sends the heaps to their vectors, which stay where they lie, and hands over what each cluster gained or lost in number and sum.
"""

from __future__ import annotations

import hashlib
import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattis.llm.components import keep
from lattis.llm.shards import dealt

CLUSTERS, ROUNDS, SIZE, SCALE = 16, 3, 64, 64
#: Vectors of a shard, on average.
SHARD = 4096
#: Whole numbers beyond this are set to it, so that squared distances fit a long: 64 * (2 * LARGEST) ** 2 < 2 ** 63.
LARGEST = 1 << 27
#: Relative margin of the gaps.
MARGIN = 1e-9


def whole_vector(v: Column) -> Column:
    """floor(SCALE * x) of each component, x as double, within LARGEST."""
    return F.transform(v, lambda x: F.least(F.greatest(F.floor(F.lit(float(SCALE)) * x.cast("double")), F.lit(-LARGEST)), F.lit(LARGEST)).cast("int"))


def usable(v: Column, size: int) -> Column:
    """size components, none null or not finite."""
    return F.coalesce((F.size(v) == size) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf"))), F.lit(False))


def squares(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances, vector x centroid."""
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(centroids).max(initial=0)))
    exact = 4 * most * most * x.shape[1] < 1 << 53  # doubles hold every sum, and multiply fast
    x, c = (x.astype(float), centroids.astype(float)) if exact else (x, centroids)
    return ((x * x).sum(axis=1)[:, None] - 2 * (x @ c.T) + (c * c).sum(axis=1)).astype(np.int64)


class Heaps:
    """The heaps of a shard: for each cluster (key, row), where key is a gap and the cluster's drift when it was pushed."""

    def __init__(self, k: int, state: pd.DataFrame):
        self.heaps: list[list[tuple[float, int]]] = [[] for _ in range(k)]
        for c, keys, rows in zip(state["cluster"], state["keys"], state["members"], strict=True):
            self.heaps[c] = list(zip(keys.tolist(), rows.tolist(), strict=True))  # written in heap order

    def expired(self, drift: list[float]) -> tuple[np.ndarray, np.ndarray]:
        """(row, cluster) of what is popped: gaps that the drift has used up."""
        out = []
        for c, heap in enumerate(self.heaps):
            limit = drift[c] * (1 + MARGIN)
            while heap and heap[0][0] <= limit:
                out.append((heapq.heappop(heap)[1], c))
        found = np.array(out, dtype=np.int64).reshape(-1, 2)
        return found[:, 0], found[:, 1]

    def push(self, rows: np.ndarray, near: np.ndarray, square: np.ndarray, drift: list[float]) -> None:
        """near: the nearest centroid of each row; square: squared distances to all."""
        if square.shape[1] == 1:
            gap = np.full(len(rows), np.inf)
        else:
            own = square[np.arange(len(rows)), near].astype(float)
            other = square.copy()
            other[np.arange(len(rows)), near] = np.iinfo(np.int64).max
            own, second = np.sqrt(own), np.sqrt(other.min(axis=1).astype(float))
            gap = second - own - MARGIN * (second + own)
        for row, c, g in zip(rows.tolist(), near.tolist(), gap.tolist(), strict=True):
            heapq.heappush(self.heaps[c], (g + drift[c], row))

    def assigned(self, n: int) -> np.ndarray:
        out = np.empty(n, dtype=np.int64)
        for c, heap in enumerate(self.heaps):
            if heap:
                out[[row for _, row in heap]] = c
        return out


STATE = "shard int, cluster int, keys array<double>, members array<int>, gained long, sums array<long>, scanned long"


def step(centroids: np.ndarray, drift: list[float], last: bool):
    """A round over a shard: (its vectors, its heaps) -> heaps with what each cluster gained; last: cluster and distance of each vector."""
    k = len(centroids)

    def run(vectors: pd.DataFrame, state: pd.DataFrame) -> pd.DataFrame:
        vectors = vectors.sort_values("at", ignore_index=True)
        x, heaps = np.stack(vectors["v"].to_list()).astype(np.int64), Heaps(k, state)
        rows, was = (np.arange(len(x)), np.full(len(x), -1)) if state.empty else heaps.expired(drift)
        square = squares(x[rows], centroids)
        near = square.argmin(axis=1)  # the smaller number at ties
        heaps.push(rows, near, square, drift)
        if last:
            cluster = heaps.assigned(len(x))
            return pd.DataFrame({"vec_id": vectors["vec_id"], "no_id": vectors["no_id"], "cluster": cluster, "distance": ((x - centroids[cluster]) ** 2).sum(axis=1)})
        moved, out = near != was, []
        for c in range(k):
            come, gone = x[rows[moved & (near == c)]], x[rows[moved & (was == c)]]
            keys, members = zip(*heaps.heaps[c], strict=True) if heaps.heaps[c] else ((), ())
            out.append((c, keys, members, len(come) - len(gone), come.sum(axis=0) - gone.sum(axis=0), len(rows) if c == 0 else 0))
        out = pd.DataFrame(out, columns=["cluster", "keys", "members", "gained", "sums", "scanned"])
        out.insert(0, "shard", int(vectors["shard"].iloc[0]))
        return out

    return run


def seeds(vectors: DataFrame, k: int) -> np.ndarray:
    """The k vectors of the smallest sha256 of `1:<vec_id>`, in ascending order of it; those of one id by their components."""
    told = F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256)
    first = vectors.where("not no_id").orderBy(told, "v").select("v").limit(k).collect()  # k rows
    return np.array([r["v"] for r in first], dtype=np.int64)


def cluster(table: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, size: int = SIZE, shard: int = SHARD) -> tuple[DataFrame, np.ndarray, list[int]]:
    """(rows of vec_id, cluster, distance; the final centroids; how many vectors each round compared with all centroids).

    table: vec_id, embedding. Vectors of another size, null or with null or non-finite components take no part. The first
    centroids are the k vectors of the smallest sha256 of `1:<vec_id>`; a vector without vec_id is clustered, but starts
    none. With fewer than k vectors that can, there are as many centroids; with none, there are no rows. Ties go to the
    smaller number; a centroid without vectors stays. Repeated rows and ids are clustered each. Components whose whole
    number is beyond LARGEST count as LARGEST, with their sign. Other columns are not touched.
    """
    spark = table.sparkSession
    n_shards = max(1, -(-table.count() // shard), 2 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("v")).where(usable(F.col("v"), size))
    rows = rows.select(F.coalesce("vec_id", F.lit(0)).alias("vec_id"), F.col("vec_id").isNull().alias("no_id"), whole_vector(F.col("v")).alias("v"), F.monotonically_increasing_id().alias("at"))
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("at"), F.lit(n_shards)).cast("int"))
    vectors, drop = dealt(rows, "shard")
    centroids = seeds(vectors, k)
    heaps = spark.createDataFrame([], STATE)
    drift, count, sums, scanned = [0.0] * len(centroids), [0] * len(centroids), [[0] * size for _ in centroids], []
    final = "vec_id long, no_id boolean, cluster int, distance long"
    if not len(centroids):
        drop()
        return spark.createDataFrame([], final).drop("no_id"), centroids, scanned
    for _ in range(rounds):
        heaps = keep(vectors.groupBy("shard").cogroup(heaps.groupBy("shard")).applyInPandas(step(centroids, drift, False), STATE))
        exact = [F.sum(F.get("sums", F.lit(j)).cast("decimal(38,0)")).alias(f"s{j}") for j in range(size)]
        for r in heaps.groupBy("cluster").agg(F.sum("gained").alias("gained"), F.sum("scanned").alias("scanned"), *exact).collect():  # k rows
            count[r["cluster"]] += r["gained"]
            sums[r["cluster"]] = [a + int(r[f"s{j}"]) for j, a in enumerate(sums[r["cluster"]])]
            if r["cluster"] == 0:
                scanned.append(r["scanned"])
        moved = np.array([[s // n for s in total] if n else old.tolist() for total, n, old in zip(sums, count, centroids, strict=True)], dtype=np.int64)
        far = [math.sqrt(int(((a - b) ** 2).sum())) for a, b in zip(moved, centroids, strict=True)]
        drift = [d + own + max(far[:c] + far[c + 1 :], default=0.0) for c, (d, own) in enumerate(zip(drift, far, strict=True))]
        centroids = moved
    out = keep(vectors.groupBy("shard").cogroup(heaps.groupBy("shard")).applyInPandas(step(centroids, drift, True), final))
    drop()
    return out.select(F.when(~F.col("no_id"), F.col("vec_id")).alias("vec_id"), "cluster", "distance"), centroids, scanned


def report(table: DataFrame, **options) -> DataFrame:
    """cluster() with what each cluster and all have: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    Inertias are sums of distances; one that does not fit a long is null.
    """
    rows, centroids, _ = cluster(table, **options)
    spark = table.sparkSession
    named = spark.createDataFrame([(c, hashlib.sha256(",".join(map(str, x.tolist())).encode()).hexdigest()) for c, x in enumerate(centroids)], "cluster int, centroid_sha256 string")
    inertia = rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("own"))
    all_of = inertia.agg(F.sum("own").alias("total"))
    told = inertia.crossJoin(F.broadcast(all_of)).join(F.broadcast(named), "cluster")  # one row, and k rows
    told = told.select("cluster", F.col("own").try_cast("long").alias("cluster_inertia"), F.col("total").try_cast("long").alias("inertia"), "centroid_sha256")
    return rows.join(F.broadcast(told), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
