"""Conflict-constrained best-fit packing of documents into bins of bounded length.

Open bins are held in order of their residual. An item goes to the first bin at or above its size that holds neither its
source nor its duplicate cluster; both are bitmaps, so a bin is tried by two ANDs, and the search walks on to the next
larger residual until a bin fits. Without one, a bin is opened.

Only ids, lengths, sources and cluster names are shuffled. Items are dealt by a hash of row and piece to shards of about
SHARD documents, whatever their source and id, and packed per shard, longest first.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattis.llm.shards import nullable_id, whole_id

#: Words of a bin, and documents of a shard (a parameter of memory and of how full the last bins are).
CAPACITY, SHARD = 2048, 2000


def best_fit(sizes: list[int], sources: list[int], clusters: list[int], capacity: int) -> list[int]:
    """The bin of each item; items come longest first. sources and clusters: bits, 0 for none."""
    open_bins: list[tuple[int, int]] = []  # (residual, bin), in order
    held_source: list[int] = []
    held_cluster: list[int] = []
    out = []
    for size, s, c in zip(sizes, sources, clusters, strict=True):
        at = bisect_left(open_bins, (size, -1))
        while at < len(open_bins) and (held_source[open_bins[at][1]] & s or held_cluster[open_bins[at][1]] & c):
            at += 1
        if at < len(open_bins):
            residual, b = open_bins.pop(at)
        else:
            residual, b = capacity, len(held_source)
            held_source.append(0)
            held_cluster.append(0)
        held_source[b] |= s
        held_cluster[b] |= c
        if residual > size:
            insort(open_bins, (residual - size, b))
        out.append(b)
    return out


def bits(values: pd.Series) -> list[int]:
    """A bit for each distinct value, 0 for null."""
    names: dict = {}
    return [0 if v is None or v != v else 1 << names.setdefault(v, len(names)) for v in values]


def pack(docs: DataFrame, capacity: int = CAPACITY, shard: int = SHARD) -> DataFrame:
    """Packs all documents: bin_id, doc_id, piece, start, n_words.

    docs: doc_id, text, source. A document longer than `capacity` words is cut in pieces of `capacity`; start is the
    first word of a piece (from 0). No bin holds more than capacity words, two pieces of one source, or two pieces of one
    duplicate cluster (texts equal but for case and white space). A bin's words are those of its rows.

    Texts without words (null, empty, white space) are left out, as they fill nothing. A null source conflicts with
    nothing. Repeated rows are packed each, in different bins. An empty table gives no rows.
    """
    clean = F.trim(F.regexp_replace(F.coalesce(F.col("text").cast("string"), F.lit("")), r"[\x20\x09-\x0D]+", " "))
    rows = docs.select(whole_id("doc_id"), F.col("source").cast("string").alias("source"), clean.alias("clean")).where("clean <> ''")
    rows = rows.select("doc_id", "source", (F.length("clean") - F.length(F.translate("clean", " ", "")) + 1).cast("long").alias("words"), F.xxhash64(F.lower("clean")).alias("cluster"), F.monotonically_increasing_id().alias("row"))
    shards = max(1, -(-docs.select("doc_id").count() // shard))
    pieces = rows.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("words") - 1) / capacity))))
    pieces = pieces.withColumn("start", F.col("piece") * capacity).withColumn("n_words", F.least(F.lit(capacity), F.col("words") - F.col("start")).cast("long"))
    pieces = pieces.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "row"), F.lit(shards))).drop("words", "row")

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n_words", "doc_id", "piece"], ascending=[False, True, True], kind="stable")
        b = best_fit(pdf["n_words"].tolist(), bits(pdf["source"]), bits(pdf["cluster"]), capacity)
        return pd.DataFrame({"bin_id": [int(s) << 32 | x for s, x in zip(pdf["shard"], b, strict=True)], "doc_id": pdf["doc_id"], "piece": pdf["piece"], "start": pdf["start"], "n_words": pdf["n_words"]})

    return nullable_id(pieces.groupBy("shard").applyInPandas(fill, "bin_id long, doc_id long, piece long, start long, n_words long"), "doc_id")
