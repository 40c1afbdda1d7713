"""Quality classifier by importance resampling.

Two generative models over hashed n-grams, one of the target (documents labelled good) and one of all raw text, give each
document a weight: the log of the ratio of its probabilities under the two. Documents are then drawn without replacement
by Gumbel top-k: the k largest of log weight plus standard Gumbel noise (Xie et al. 2023).

N-grams are of 2 to 4 bytes of the text, runs of white space as one space, and pairs of one word twice. The raw model counts every document, the target
model a bounded sample of labelled ones. Where the two probabilities of an n-gram are within a factor of e**TELLING they
count as the same: the many n-grams that tell little would add up to noise in long documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattis.llm.components import keep
from lattis.llm.hashing import SPACE, U, as_bytes, steps, words
from lattis.llm.shards import nullable_id, whole_id

#: Most labelled documents that the target model and k are fitted on: those of the smallest hashes of doc_id. A quarter of them is held out of the model, for k.
LABELLED = 20_000
#: Bytes of an n-gram, and hash cells: 2**BITS.
SIZES, BITS = (2, 3, 4), 18
#: The cell of a word that repeats the one before.
TWICE = 1
#: Pseudo-counts, and the least log ratio that counts.
PRIOR, TELLING = 1.0, 1.5
#: A log ratio is tempered by SHARPNESS over the square root of the text's n-grams: neighbouring n-grams depend on each other,
#: and plain sums drift so far in long texts that the noise and the rest of the ranking mean nothing beside them.
SHARPNESS = 20.0
SLICES = 64


def ngrams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(cell, text) of each n-gram; a text stands between two spaces."""
    data = np.frombuffer(b"\n" + b"\n\n".join(texts) + b"\n", dtype=np.uint8)
    owner = np.repeat(np.arange(len(texts)), [len(t) + 2 for t in texts])
    space = SPACE[data]
    one = np.ones(len(data), dtype=bool)
    one[1:] = ~space[1:] | ~space[:-1] | (owner[1:] != owner[:-1])
    x, owner = np.where(space, 32, data)[one].astype(np.uint64), owner[one]
    cells, owners, h = [], [], x
    with np.errstate(over="ignore"):
        for n in range(2, max(SIZES) + 1):
            h = h[:-1] * U(256) + x[n - 1 :]
            whole = owner[: len(h)] == owner[n - 1 :]
            if n in SIZES:
                cells.append((((h[whole] + U(n << 40)) * U(0x9E3779B97F4A7C15)) >> U(64 - BITS)).astype(np.int64))
                owners.append(owner[: len(h)][whole])
    h, bounds = words(texts)
    who = np.repeat(np.arange(len(texts)), np.diff(bounds))
    again = who[1:][(h[1:] == h[:-1]) & (who[1:] == who[:-1])]
    return np.concatenate([*cells, np.full(len(again), TWICE)]), np.concatenate([*owners, again])


def fit_ratio(rows: DataFrame) -> np.ndarray:
    """Log of target over raw probability by n-gram cell. rows: text, role (1: of the target)."""
    size = 1 << BITS

    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((2, size), dtype=np.int64)
        for pdf in parts:
            texts, target = as_bytes(pdf["text"]), (pdf["role"] == 1).to_numpy()
            for a, b in steps(texts):
                cell, owner = ngrams(texts[a:b])
                total[0] += np.bincount(cell, minlength=size)
                total[1] += np.bincount(cell[target[a:b][owner]], minlength=size)
        for k in range(SLICES):
            yield pd.DataFrame({"slice": [k], "cells": [np.ascontiguousarray(total[:, k::SLICES]).tobytes()]})

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(x, dtype=np.int64) for x in pdf["cells"])
        return pd.DataFrame({"slice": pdf["slice"].iloc[:1], "cells": [total.tobytes()]})

    kind = "slice int, cells binary"
    got = rows.mapInPandas(count, kind).groupBy("slice").applyInPandas(add, kind).collect()  # SLICES rows, 4 MB
    total = np.zeros((2, size), dtype=np.int64)
    for r in got:
        total[:, r["slice"] :: SLICES] = np.frombuffer(r["cells"], dtype=np.int64).reshape(2, -1)
    raw, target = total.astype(float)
    if not target.sum():
        return np.zeros(size)
    expected = raw * (target.sum() / raw.sum())
    log = np.log((target + PRIOR) / (expected + PRIOR))
    order = np.argsort(log)
    mass = np.cumsum(raw[order])
    log -= log[order][np.searchsorted(mass, mass[-1] / 2)]  # the usual n-gram tells nothing
    return np.where(np.abs(log) < TELLING, 0.0, log)


def weigh(docs: DataFrame, log: np.ndarray) -> DataFrame:
    """doc_id, log_weight: the log importance weight, the tempered sum over the n-grams of a text."""
    table = docs.sparkSession.sparkContext.broadcast(log.astype(np.float32))  # 1 MB, whatever the corpus

    def score(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            texts = as_bytes(pdf["text"])
            for a, b in steps(texts):
                cell, owner = ngrams(texts[a:b])
                n = np.bincount(owner, minlength=b - a)
                w = np.bincount(owner, weights=table.value[cell], minlength=b - a) * (SHARPNESS / np.sqrt(np.maximum(n, 1)))
                yield pd.DataFrame({"doc_id": pdf["doc_id"].iloc[a:b], "log_weight": np.round(w, 9)})

    return nullable_id(docs.select(whole_id("doc_id"), "text").mapInPandas(score, "doc_id long, log_weight double"), "doc_id")


def best_cut(good: np.ndarray, bad: np.ndarray) -> float:
    """The cut with the fewest errors: midway between the two scores around it."""
    if not len(bad) or not len(good):
        return -np.inf
    at = np.unique(np.concatenate((good, bad)))
    wrong = np.searchsorted(np.sort(good), at) + len(bad) - np.searchsorted(np.sort(bad), at)
    k = int(np.argmin(wrong))
    return float((at[k] + at[k - 1]) / 2) if k else -np.inf


def top_k_cut(keys: DataFrame, k: int) -> DataFrame:
    """The k rows with the largest sample_key, ties to the smaller doc_id: a histogram is refined around the k-th key."""
    low, high = keys.agg(F.min("sample_key"), F.max("sample_key")).first()
    if low is None or k <= 0:
        return keys.limit(0)
    above, bins = 0, 4096
    for _ in range(4):
        width = (high - low) / bins
        if not width > 0:
            break
        inside = keys.where(F.col("sample_key").between(low, high)).groupBy(F.least(F.floor((F.col("sample_key") - low) / width), F.lit(bins - 1)).alias("bin")).count()
        for b, n in sorted(((r["bin"], r["count"]) for r in inside.collect()), reverse=True):  # 4096 rows at most
            if above + n >= k:
                break
            above += n
        low, high = low + b * width, low + (b + 1) * width if b < bins - 1 else high
        if n <= 1:
            break
    # rounding at a bin's edge may move a row by one bin: what lies above is counted anew
    above = keys.where(F.col("sample_key") > high).count()
    rest = keys.where(F.col("sample_key").between(low, high)).orderBy(F.desc("sample_key"), F.asc_nulls_last("doc_id")).limit(max(0, k - above))
    return keys.where(F.col("sample_key") > high).union(rest)


def noise() -> Column:
    """Standard Gumbel noise that follows from doc_id."""
    unit = (F.pmod(F.xxhash64("doc_id", F.lit(6)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    return -F.log(-F.log(unit))


def resample(docs: DataFrame, labels: DataFrame, k: int | None = None, most: int = LABELLED) -> DataFrame:
    """k documents drawn by importance: doc_id, log_weight, sample_key.

    docs: doc_id, text; labels: doc_id, quality, toxic. Target: quality 1 and not toxic. k is how many documents to draw;
    unless given, as many as weigh at least what best parts labelled good from other documents, judged by labelled documents
    that the model was not fitted on. Noise follows from doc_id, so runs agree.

    Null and empty texts have a log_weight of 0 or near it. A null quality or toxic counts as not good; labels without
    doc_id are left out, and repeated labels of a document count once (the worst). Without labels of both kinds nothing is
    rejected. Repeated rows of documents are drawn each; as a labelled one, a repeated document counts once, by its
    smallest weight. An empty table gives an empty one.
    """
    good = (F.col("quality") == 1) & (F.coalesce("toxic", F.lit(1)) == 0)
    sample = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(F.coalesce(good, F.lit(False)).cast("int")).alias("good"))
    sample = sample.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    sample = keep(sample.withColumn("role", F.when(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(4)) == 3, F.lit(2)).otherwise(F.col("good"))))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    log = fit_ratio(rows.join(F.broadcast(sample.select("doc_id", "role")), "doc_id", "left").select("text", "role"))
    weights = keep(weigh(rows, log))
    if k is None:
        held = weights.join(F.broadcast(sample.where("role = 2").select("doc_id", "good")), "doc_id").groupBy("doc_id", "good").agg(F.min("log_weight").alias("w")).toPandas()  # `most` rows at most
        cut = best_cut(held["w"][held["good"] == 1].to_numpy(), held["w"][held["good"] == 0].to_numpy())
        k = weights.where(F.col("log_weight") >= F.lit(float(cut))).count()
    return top_k_cut(weights.withColumn("sample_key", F.col("log_weight") + noise()), k)
