"""Exact top-k search by three-phase uniform threshold.

The components of the vectors are dealt to LISTS lists; a list scores a candidate by its share of the inner product.
1. Gather: each list hands over, for each query, its k best local scores, and nothing else. The full scores of the
   candidates that any list named give the cutoff t: the k-th best of them, so the true k-th score is no lower.
2. Broadcast t. A candidate of a full score of t or more has t / LISTS or more in some list (the mean of its local scores
   is that high, whatever their signs), so each list hands over its entries of that height. A list that does not name a
   candidate scores it lower, which bounds its full score from above; candidates that can't reach t any more are dropped.
3. Resolve: for those left, the local scores that are still missing are computed, and the best full scores win.

Queries are taken in batches of bounded size, which are broadcast; a batch passes once over all candidates in each of the
two scans, so candidates are never copied or shuffled, and a task's memory depends on the batch and on k alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattis.llm.components import keep

LISTS = 4
#: Components of all queries of a batch together (16 MB as 32-bit numbers, 32 MB while scored).
BATCH_CELLS = 1 << 22
#: Cells of one score matrix.
CELLS = 1 << 21


def product(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Integer inner products, exact: in doubles while sums stay below 2**53, else in 64-bit integers."""
    bound = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * q.shape[1]
    if bound < 1 << 53:
        return (q.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64)
    return np.einsum("qd,xd->qx", q, x)


def top(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Column indices of the k best of each row, ties to the smaller id; ids ascend along columns."""
    k = min(k, scores.shape[1])
    if scores.shape[1] <= 4 * k:
        return np.argsort(-scores, axis=1, kind="stable")[:, :k]
    least = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
    out = np.empty((len(scores), k), dtype=np.int64)
    for i, t in enumerate(least):
        over = np.flatnonzero(scores[i] > t)
        at = np.concatenate((over, np.flatnonzero(scores[i] == t)[: k - len(over)]))
        out[i] = at[np.lexsort((at, -scores[i][at]))]
    return out


def integer_vectors(table: DataFrame, scale: int) -> DataFrame:
    """(vec_id, v): one row for each id. Rows whose id or vector is null, or that hold null or non-finite components, are left out."""
    x = F.col("embedding")
    fine = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    rows = table.where(F.col("vec_id").isNotNull() & x.isNotNull()).where(fine)
    v = F.transform(x, lambda e: F.floor(e.cast("double") * scale))
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).groupBy("vec_id").agg(F.min("v").alias("v"))


def top_k(table: DataFrame, k: int = 10, every: int = 100, scale: int = 1024, lists: int = LISTS) -> DataFrame:
    """The k highest inner products for each row whose vec_id is divisible by `every`, over all other rows.

    table: vec_id, embedding. Components become floor(scale * x). Returns query_id, rank (from 1), vec_id, score; ties go
    to the smaller vec_id; fewer rows if there are fewer candidates.

    Rows with a null id or vector, or null or non-finite components, take no part. Vectors are compared with those of
    their own length only. Of rows that share a vec_id the smallest vector (as an array) counts, once. An empty vector
    scores 0. Products must fit 64 bits. Empty tables give no rows.
    """
    v = keep(integer_vectors(table, scale))
    query = F.col("vec_id") % every == 0
    n, widest = v.where(query).agg(F.count("*"), F.max(F.size("v"))).first()
    batches = -(-n * max(1, widest or 0) // BATCH_CELLS)
    out = table.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    for batch in range(batches):
        asked = v.where(query & (F.pmod(F.xxhash64("vec_id"), F.lit(batches)) == batch)).toPandas()  # bounded by BATCH_CELLS
        if len(asked):
            found = _search(v, asked, k, lists)
            out = out.unionByName(keep(found) if batches > 1 else found)
    return out


def by_length(vectors: pd.Series, ids: pd.Series) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Ids, ascending, and the matrix of their vectors, for each length of vectors."""
    length = vectors.map(len).to_numpy()
    out = {}
    for dim in np.unique(length).tolist():
        at = np.flatnonzero(length == dim)
        at = at[np.argsort(ids.to_numpy()[at], kind="stable")]
        out[dim] = ids.to_numpy(np.int64)[at], np.array(vectors.iloc[at].tolist(), dtype=np.int64).reshape(len(at), dim)
    return out


def _search(v: DataFrame, asked: pd.DataFrame, k: int, lists: int) -> DataFrame:
    """One batch of queries over all candidates."""
    context = v.sparkSession.sparkContext
    queries = context.broadcast(by_length(asked["v"], asked["vec_id"]))

    def parts_of(dim: int) -> list[np.ndarray]:
        return [np.arange(i, dim, lists) for i in range(min(lists, max(dim, 1)))]

    def pairs(parts: Iterator[pd.DataFrame]):
        """(dim, first query, query ids, query matrix, candidate ids, candidate matrix, own: where a candidate is the query) in steps of bounded size."""
        for pdf in parts:
            for dim, (ids, x) in by_length(pdf["v"], pdf["vec_id"]).items():
                qid, q = queries.value.get(dim, ((), ()))
                step = max(1, CELLS // len(ids))
                for a in range(0, len(qid), step):
                    yield dim, a, qid[a : a + step], q[a : a + step], ids, x, qid[a : a + step, None] == ids[None, :]

    def gather(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for dim, _, qid, q, ids, x, own in pairs(parts):
            for i, p in enumerate(parts_of(dim)):
                local = product(q[:, p], x[:, p])
                local[own] = np.iinfo(np.int64).min
                best = top(local, ids, k)
                named = ~np.take_along_axis(own, best, 1).ravel()
                rows = {"list": i, "query_id": np.repeat(qid, best.shape[1]), "vec_id": ids[best].ravel(), "local": np.take_along_axis(local, best, 1).ravel()}
                yield pd.DataFrame(rows)[named]

    best_local = Window.partitionBy("list", "query_id").orderBy(F.desc("local"), "vec_id")
    named = v.mapInPandas(gather, "list int, query_id long, vec_id long, local long").withColumn("place", F.row_number().over(best_local)).where(F.col("place") <= k)
    named = keep(named.select("query_id", "vec_id").distinct())  # at most lists * k for each query
    pair = named.join(v, "vec_id").join(v.select(F.col("vec_id").alias("query_id"), F.col("v").alias("q")), "query_id")
    full = pair.select("query_id", "vec_id", F.aggregate(F.zip_with("v", "q", lambda a, b: a * b), F.lit(0).cast("long"), lambda s, x: s + x).alias("score"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    least = full.withColumn("place", F.row_number().over(best)).where(F.col("place") == k).collect()  # a row for each query of the batch
    # a query for which fewer than k candidates were named has no more of them, as each list names k if there are so many
    cut = {r["query_id"]: (r["score"], r["vec_id"]) for r in least}
    none = (-(1 << 60), np.iinfo(np.int64).max)
    cutoffs = context.broadcast({dim: np.array([cut.get(i, none) for i in ids.tolist()], dtype=np.int64).reshape(-1, 2) for dim, (ids, _) in queries.value.items()})

    def resolve(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for dim, at, qid, q, ids, x, own in pairs(parts):
            t, last = cutoffs.value[dim][at : at + len(qid), :1], cutoffs.value[dim][at : at + len(qid), 1]
            mine = parts_of(dim)
            bound = -(-t // len(mine))  # integers: t / LISTS or more
            known, missing = np.zeros(own.shape, dtype=np.int64), np.full(own.shape, len(mine), dtype=np.int64)
            told = []
            for p in mine:
                local = product(q[:, p], x[:, p])
                told.append(local >= bound)
                known += np.where(told[-1], local, 0)
                missing -= told[-1]
            # what a list has not told is less than the bound
            left = (missing < len(mine)) & (known + missing * (bound - 1) >= t) & ~own
            i, c = np.nonzero(left)
            score, lacking = known[i, c], missing[i, c]
            for p, has in zip(mine, told, strict=True):
                lacks = np.flatnonzero(~has[i, c])
                score[lacks] += np.einsum("nd,nd->n", q[i[lacks]][:, p], x[c[lacks]][:, p])
                lacking[lacks] -= 1
                able = score + lacking * (bound[i, 0] - 1) >= t[i, 0]
                i, c, score, lacking = i[able], c[able], score[able], lacking[able]
            # of equal scores only those of ids up to the cutoff's own can be among the k best
            enough = (score > t[i, 0]) | (ids[c] <= last[i])
            i, c, score = i[enough], c[enough], score[enough]
            order = np.lexsort((ids[c], -score, i))
            i, c, score = i[order], c[order], score[order]
            first = np.searchsorted(i, i)  # where the query's rows begin
            some = np.arange(len(i)) - first < k
            yield pd.DataFrame({"query_id": qid[i[some]], "vec_id": ids[c[some]], "score": score[some]})

    found = v.mapInPandas(resolve, "query_id long, vec_id long, score long")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
