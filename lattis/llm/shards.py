"""Documents dealt to shards by a hash of doc_id, packed and compressed for the shuffle.

Operators that pass over texts several times, each time with what other documents have told, group by shard.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattis.llm.hashing import mix, steps
from lattis.session import shared_dir

#: Stands for a null doc_id inside a task, so it is no id itself; it sorts behind all others.
NO_ID = np.int64((1 << 63) - 1)


#: Bytes of text of a shard, which one task holds.
SHARD_BYTES = 64 << 20


def shards_for(docs: DataFrame, size: int | None = None) -> int:
    """How many shards: two for each shuffle partition, more if one's texts came to more than SHARD_BYTES. size: bytes of all texts, counted unless given."""
    if size is None:
        size = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    return max(2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // SHARD_BYTES))


def whole_id(name: str):
    """A long id for pandas, which would make floats of longs with nulls: NO_ID for null."""
    return F.coalesce(F.col(name).cast("long"), F.lit(int(NO_ID))).alias(name)


def nullable_id(df: DataFrame, name: str) -> DataFrame:
    return df.withColumn(name, F.nullif(F.col(name), F.lit(int(NO_ID))))


def shard_of(ids: np.ndarray, shards: int) -> np.ndarray:
    return (mix(ids.view(np.uint64), 17) % np.uint64(shards)).astype(np.int32)


def packed_texts(docs: DataFrame, shards: int) -> DataFrame:
    """(shard, docs): for each batch of rows and shard one compressed block of ids and texts. docs: doc_id, text."""

    def pack(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        zip_ = zstandard.ZstdCompressor(level=1)
        for pdf in parts:
            ids = pdf["doc_id"].to_numpy(np.int64)
            to = shard_of(ids, shards)
            order = np.argsort(to, kind="stable")
            found, at = np.unique(to[order], return_index=True)
            text = pdf["text"].tolist()
            out = []
            for a, b in zip(at, np.append(at[1:], len(order)), strict=True):
                raw = [t.encode("utf-8", "replace") if isinstance(t, str) else None for t in (text[i] for i in order[a:b])]
                size = np.array([-1 if t is None else len(t) for t in raw], dtype=np.int64)
                out.append(zip_.compress(b"".join([np.int64(b - a).tobytes(), ids[order[a:b]].tobytes(), size.tobytes(), *(t for t in raw if t)])))
            yield pd.DataFrame({"shard": found, "docs": out})

    rows = docs.select(whole_id("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInPandas(pack, "shard int, docs binary")


def documents(blocks) -> Iterator[tuple[np.ndarray, list[bytes | None]]]:
    """(ids, texts) of the blocks of a shard, about a step's bytes at a time."""
    unzip = zstandard.ZstdDecompressor()
    for block in blocks:
        data = unzip.decompress(block)
        n = int(np.frombuffer(data, dtype=np.int64, count=1)[0])
        ids, size = np.frombuffer(data, dtype=np.int64, count=2 * n, offset=8).reshape(2, n)
        ends = 8 + 16 * n + np.cumsum(np.maximum(size, 0))
        texts = [None if s < 0 else data[e - s : e] for s, e in zip(size.tolist(), ends.tolist(), strict=True)]
        for a, b in steps([t or b"" for t in texts]):
            yield ids[a:b], texts[a:b]


def dealt(df: DataFrame, column: str) -> tuple[DataFrame, Callable[[], None]]:
    """df as a table in the shared folder, bucketed by the column, and what removes it: later joins by the column leave its rows where they are."""
    spark, name = df.sparkSession, f"dealt_{uuid.uuid4().hex}"
    path, buckets = f"{shared_dir(spark)}/{name}", min(int(spark.conf.get("spark.sql.shuffle.partitions")), 100_000)
    df.repartition(buckets, column).write.format("parquet").bucketBy(buckets, column).sortBy(column).option("path", path).saveAsTable(name)

    def drop() -> None:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)

    return spark.table(name), drop
