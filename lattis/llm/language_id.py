"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Training is follow-the-regularised-leader (FTRL-proximal, McMahan et al. 2013) with elastic-net penalties, so most
weights are exactly zero; scores are calibrated by a temperature fitted on sample documents that training leaves out.
Document frequencies count all learnable documents; the weights are fitted on a bounded sample of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattis.llm.hashing import U, mix
from lattis.llm.shards import nullable_id, whole_id

#: Hash cells of n-grams of 1 to NGRAM characters.
CELLS, NGRAM = 1 << 15, 3
#: Most documents of a language that the weights are fitted on.
PER_LANGUAGE = 1000
ALPHA, BETA, L1, L2, EPOCHS = 0.5, 1.0, 0.02, 0.001, 3


def plain(text: str) -> np.ndarray:
    """Code points in lower case, with runs of anything but letters as one space."""
    x = np.frombuffer(text.lower().encode("utf-32-le", "replace"), dtype=np.uint32)
    letter = (x >= 97) & (x <= 122) | (x >= 0xC0) & (x != 0xD7) & (x != 0xF7) & ~((x >= 0x2000) & (x < 0x2070)) & ~((x >= 0x3000) & (x < 0x3040)) & ~((x >= 0x1F000) & (x < 0x20000))
    x = np.where(letter, x, 32)
    x = x[~((x == 32) & np.concatenate(([True], x[:-1] == 32)))] if len(x) else x
    return np.concatenate(([32], x, [32])).astype(np.uint64)


def cells_of(text: str) -> np.ndarray:
    x = plain(text)
    out = []
    with np.errstate(over="ignore"):
        h = np.zeros(len(x), dtype=np.uint64)
        for n in range(1, NGRAM + 1):
            if len(x) < n:
                break
            h = h[: len(x) - n + 1] * U(0x100000001B3) + x[n - 1 :] + U(1)
            out.append((mix(h, n) >> U(49)).astype(np.int64))
    return np.concatenate(out)


def vector(text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cells, unit-length TF-IDF), of the whole text; term frequencies are damped by a logarithm."""
    count = np.bincount(cells_of(text), minlength=CELLS)
    at = np.flatnonzero(count)
    x = (1 + np.log(count[at])) * idf[at]
    return at, x / max(np.sqrt((x * x).sum()), 1e-12)


def softmax(s: np.ndarray) -> np.ndarray:
    e = np.exp(s - s.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], classes: int) -> np.ndarray:
    z, n = np.zeros((CELLS, classes)), np.zeros((CELLS, classes))

    def weights(at):
        return np.where(np.abs(z[at]) <= L1, 0.0, -(z[at] - np.sign(z[at]) * L1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2))

    for _ in range(EPOCHS):
        for at, x, y in rows:
            w = weights(at)
            g = softmax(x @ w)
            g[y] -= 1
            g = x[:, None] * g
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - sigma * w
            n[at] += g * g
    return weights(slice(None))


def best_temperature(scores: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least log loss, from 0.05 to 20."""
    grid = np.exp(np.linspace(np.log(0.05), np.log(20), 121))
    if not len(y):
        return 1.0
    loss = [-np.log(np.maximum(softmax(scores / t)[np.arange(len(y)), y], 1e-12)).mean() for t in grid]
    return float(grid[int(np.argmin(loss))])


def identify(docs: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """doc_id, held_out, lang_pred, score for each document.

    docs: doc_id, text, lang. Learns from text and lang of documents with a lang whose crc32(doc_id as text) mod 4 is not
    2 (the others are held out); a prediction uses the whole text alone. lang_pred is a learned language, or `und` with a
    score of 0 if the text is null or has no letter, or nothing could be learned.

    Weights are fitted on at most about per_language documents of a language, chosen by hash of id and text; repeated rows
    count once there. Null texts are not learned
    from; a null doc_id is neither learned from nor held out. Repeated rows give a row each; an empty table gives none.
    """
    spark = docs.sparkSession
    third = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"), F.coalesce(third == 2, F.lit(False)).alias("held_out"))
    learn = rows.where("not held_out and doc_id is not null and lang is not null and text is not null")

    def frequency(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        df, seen, n = np.zeros(CELLS, dtype=np.int64), np.zeros(CELLS, dtype=bool), 0
        for pdf in parts:
            for text in pdf["text"]:
                seen[:] = False
                seen[cells_of(text)] = True
                df += seen
                n += 1
        yield pd.DataFrame({"slice": range(16), "n": n, "cells": [x.tobytes() for x in df.reshape(16, -1)]})

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"slice": pdf["slice"].iloc[:1], "n": [pdf["n"].sum()], "cells": [sum(np.frombuffer(x, dtype=np.int64) for x in pdf["cells"]).tobytes()]})

    kind = "slice int, n long, cells binary"
    got = sorted(learn.select("text").mapInPandas(frequency, kind).groupBy("slice").applyInPandas(add, kind).collect())  # 16 rows, 256 kB
    total = got[0]["n"] if got else 0
    df = np.concatenate([np.frombuffer(r["cells"], dtype=np.int64) for r in got]) if got else np.zeros(CELLS)
    idf = np.log((1 + total) / (1 + df)) + 0.1

    sizes = {r["lang"]: r["count"] for r in learn.groupBy("lang").count().collect()}  # a row for each language
    langs = sorted(sizes)
    if not langs:
        return rows.select("doc_id", "held_out", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    place = F.pmod(F.xxhash64("doc_id", "text", F.lit(2)), F.lit(1 << 30)) / float(1 << 30)
    share = F.create_map(*[F.lit(x) for lang in langs for x in (lang, min(1.0, per_language / sizes[lang]))])
    sample = learn.where(place < F.element_at(share, F.col("lang"))).select("doc_id", "text", "lang").distinct()

    def sparse(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            v = [vector(t, idf) for t in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "lang": pdf["lang"], "at": [a.astype(np.int32).tobytes() for a, _ in v], "x": [x.astype(np.float32).tobytes() for _, x in v]})

    def train(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "lang"])
        order = np.argsort(mix(pdf["doc_id"].to_numpy(np.int64).view(np.uint64), 3), kind="stable")
        data = [(np.frombuffer(pdf["at"].iloc[i], dtype=np.int32), np.frombuffer(pdf["x"].iloc[i], dtype=np.float32).astype(float), langs.index(pdf["lang"].iloc[i])) for i in order]
        out = len(data) // 5
        w = ftrl(data[out:], len(langs))
        held = data[:out]
        t = best_temperature(np.array([x @ w[at] for at, x, _ in held]).reshape(len(held), len(langs)), np.array([y for *_, y in held], dtype=int))
        return pd.DataFrame({"temperature": [t], "weights": [w.astype(np.float32).tobytes()]})

    # the sample is bounded: one group holds per_language documents of each language
    model = sample.mapInPandas(sparse, "doc_id long, lang string, at binary, x binary").groupBy(F.lit(1).alias("one")).applyInPandas(train, "temperature double, weights binary").first()
    if model is None:
        return rows.select("doc_id", "held_out", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = spark.sparkContext.broadcast((idf, np.frombuffer(model["weights"], dtype=np.float32).reshape(CELLS, len(langs)), model["temperature"], langs))

    def predict(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        idf, w, t, langs = shared.value
        for pdf in parts:
            lang, score = [], []
            for text in pdf["text"]:
                if not isinstance(text, str) or not any(map(str.isalpha, text)):
                    lang.append("und")
                    score.append(0.0)
                    continue
                at, x = vector(text, idf)
                p = softmax(x @ w[at] / t)
                k = int(np.argmax(p))
                lang.append(langs[k])
                score.append(float(min(1.0, p[k])))
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "held_out": pdf["held_out"], "lang_pred": lang, "score": score})

    out = rows.select(whole_id("doc_id"), "text", "held_out").mapInPandas(predict, "doc_id long, held_out boolean, lang_pred string, score double")
    return nullable_id(out, "doc_id")
