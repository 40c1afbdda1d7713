"""A stored corpus that follows its files: a stream of changes upserts documents and postings, versioned and once only.

Documents are dealt to buckets by path. A batch of changes writes a new version of the buckets that it touches, then a
header that names the version of each bucket; readers take the newest header, so they see all of a batch or nothing. The
header also names the batch, so a batch that is told twice, after a crash, changes nothing the second time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from lattis.operators.index import field_terms, term_counts
from lattis.streaming.turns import refresh

BUCKETS = 64
DOCS = "path string, content string, mtime timestamp, bucket int, version int"
POSTINGS = "doc_id string, field string, len bigint, terms array<struct<term:string,tf:bigint>>, bucket int, version int"
CHANGE = "path string, change string, content string, mtime timestamp, turn long"


def bucket_of(path: Column) -> Column:
    return F.pmod(F.xxhash64(path), F.lit(BUCKETS)).cast("int")


def write_changes(old: DataFrame, new: DataFrame, log: str, turn: int) -> None:
    """Appends to the change log at `log` what turns the files old (path, mtime) into new (path, mtime, content): rows as CHANGE says, with the content of added and changed files."""
    rows = refresh(old.select("path", "mtime"), new.select("path", "mtime")).join(new.select("path", "content", "mtime"), "path", "left")
    rows.select("path", "change", "content", F.col("mtime").cast("timestamp").alias("mtime"), F.lit(turn).cast("long").alias("turn")).write.mode("append").parquet(log)


def header(spark: SparkSession, store: str) -> tuple[int, int, list[int]]:
    """(version, batch, version of each bucket) of the newest header; version 0 if there is none."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{store}/headers")
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return 0, -1, [0] * BUCKETS
    r = spark.read.schema("version int, batch long, buckets array<int>").json(f"{store}/headers").orderBy(F.desc("version")).first()
    return (r["version"], r["batch"], list(r["buckets"])) if r else (0, -1, [0] * BUCKETS)


def at_versions(spark: SparkSession, folder: str, schema: str, buckets: list[int]) -> DataFrame:
    """Rows of each bucket's version; other folders are pruned."""
    rows = spark.read.schema(schema).parquet(folder)
    return rows.where(F.col("version") == F.element_at(F.array(*map(F.lit, buckets)), F.col("bucket") + 1))


def read_store(spark: SparkSession, store: str) -> tuple[DataFrame, DataFrame]:
    """(documents: path, content, mtime; postings: doc_id (the path), field, term, len, tf) as of the newest header."""
    version, _, buckets = header(spark, store)
    docs, postings = (at_versions(spark, f"{store}/{x}", schema, buckets) if version else spark.createDataFrame([], schema) for x, schema in (("docs", DOCS), ("postings", POSTINGS)))
    return docs.drop("bucket", "version"), postings.select("doc_id", "field", "len", F.inline("terms"))


FILE_TERMS = "bucket int, doc_id string, field string, len bigint, terms array<struct<term:string,tf:bigint>>"


def file_terms(fields: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """What a task does with the terms of files (field_terms): -> FILE_TERMS, a row for each file and field with terms."""
    kind = to_arrow_schema(StructType.fromDDL(FILE_TERMS))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for field in fields:
                names, term, row, tf = term_counts(part[field], np.arange(part.num_rows), part.num_rows, by_row=True)
                own, begin = np.unique(row, return_index=True)
                counts = pa.StructArray.from_arrays([names.take(pa.array(term)), pa.array(tf.astype(np.int64))], ["term", "tf"])
                terms = pa.ListArray.from_arrays(pa.array(np.append(begin, len(row)).astype(np.int32)), counts)
                found = [part["bucket"].take(own), part["doc_id"].take(own), pa.array([field] * len(own), pa.string()), pc.list_value_length(part[field]).take(own), terms]
                yield pa.RecordBatch.from_arrays([x.cast(t.type) for x, t in zip(found, kind, strict=True)], schema=kind)

    return run


def apply_changes(changes: DataFrame, batch: int, store: str, fields: dict[str, bool]) -> None:
    """Upserts added and changed files and drops removed ones; of several changes of one path the last turn counts. Buckets that no change touches are left alone."""
    spark = changes.sparkSession
    version, done, buckets = header(spark, store)
    if batch <= done:
        return
    last = changes.groupBy("path").agg(F.max_by(F.struct("change", "content", "mtime"), "turn").alias("c")).select("path", "c.*").withColumn("bucket", bucket_of(F.col("path")))
    touched = sorted(r["bucket"] for r in last.select("bucket").distinct().collect())  # BUCKETS at most
    if not touched:
        return
    new = last.where("change <> 'removed'").select("path", "content", "mtime", "bucket")
    # a file's terms are one row, so they are counted where the file is
    postings = field_terms(new.withColumnRenamed("path", "doc_id"), fields, "bucket").mapInArrow(file_terms(list(fields)), FILE_TERMS)
    if version:
        changed, inside = last.select("path"), F.col("bucket").isin(touched)
        new = at_versions(spark, f"{store}/docs", DOCS, buckets).where(inside).drop("version").join(changed, "path", "left_anti").unionByName(new)
        old = at_versions(spark, f"{store}/postings", POSTINGS, buckets).where(inside).drop("version")
        postings = old.join(changed.withColumnRenamed("path", "doc_id"), "doc_id", "left_anti").unionByName(postings)
    for rows, folder in ((new, "docs"), (postings, "postings")):
        # a crash may have left a part of this version: it is written over
        rows.withColumn("version", F.lit(version + 1)).repartition("bucket").write.option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "version").mode("overwrite").parquet(f"{store}/{folder}")
    for b in touched:
        buckets[b] = version + 1
    spark.createDataFrame([(version + 1, batch, buckets)], "version int, batch long, buckets array<int>").coalesce(1).write.mode("append").json(f"{store}/headers")


def follow(spark: SparkSession, log: str, store: str, state: str, fields: dict[str, bool]) -> None:
    """Applies what the change log holds and no earlier call has applied. state: the stream's own checkpoint folder."""
    stream = spark.readStream.schema(CHANGE).parquet(log)
    stream.writeStream.foreachBatch(lambda rows, batch: apply_changes(rows, batch, store, fields)).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
