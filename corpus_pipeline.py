"""Corpus pipeline: quality, near duplicates, repeated passages, benchmark passages, packing."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattis.llm.components import keep
from lattis.llm.decontaminate import contaminated
from lattis.llm.jaccard_join import jaccard_components
from lattis.llm.packing import pack
from lattis.llm.quality import resample
from lattis.llm.substring_dedup import substring_dedup
from lattis.session import shared_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn by importance resampling stay; those that it rejects go.

    Rows with one doc_id are one document and stay if one of them is drawn; a null doc_id is a document as well. Null and
    empty texts weigh nothing for or against. Without labels, or with an empty table, nothing goes.
    """
    kept = keep(resample(docs, table(spark, sf_dir, "labels")).select("doc_id").distinct())
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["doc_id"]), "left_semi")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, that of the smallest doc_id: five-word shingles, similarity 0.8.

    Rows with one doc_id are one document and stay or go together. Null and empty texts, and rows without doc_id, link
    with nothing and stay.
    """
    first = keep(jaccard_components(docs, n=5, percent=80).where("doc_id <> component_id").select("doc_id").distinct())
    return docs.join(first, "doc_id", "left_anti").select(docs.columns)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of passages that a document with a smaller doc_id holds go; a text of which nothing goes stays as it is.

    A document of which nothing is left goes as a whole. Rows with one doc_id, or none, are judged each by its own text.
    Null and empty texts stay as they are. Columns of any other name pass through.
    """
    cut = substring_dedup(docs, with_text=True).where("n_removed > 0").dropDuplicates(["doc_id", "text_md5"]).alias("c")
    own = F.unhex(F.md5(F.col("d.text").cast("string").cast("binary")))
    rows = docs.alias("d").join(cut, F.col("d.doc_id").eqNullSafe(F.col("c.doc_id")) & (own == F.col("c.text_md5")), "left")
    changed = F.col("c.text_md5").isNotNull()
    new = {"text": F.when(changed, F.col("c.text")).otherwise(F.col("d.text"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(changed, F.length("c.text")).otherwise(F.col("d.n_chars")).cast(docs.schema["n_chars"].dataType)
    return rows.where(~changed | (F.col("c.n_removed") < F.col("c.n_words"))).select(*[new.get(x, F.col(f"d.`{x}`")).alias(x) for x in docs.columns])


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark passage go.

    Rows with one doc_id are one document and go together, as do rows without doc_id. Null and empty texts stay.
    """
    found = keep(contaminated(docs, table(spark, sf_dir, "benchmark")).select("doc_id").distinct())
    return docs.join(found, docs["doc_id"].eqNullSafe(found["doc_id"]), "left_anti")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bins of at most 2048 words without two documents of one source or duplicate cluster; see pack() for odd rows."""
    return pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("substring dedup", passages),
    ("benchmark decontamination", decontaminate),
    ("best-fit packing", packing),
]

#: Not expressible in SQL (a fitted classifier, best-fit packing): tests compare each stage with a brute-force version of it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage returns is written to spark.checkpoint.dir and read again by the next.

    A stage's folder goes as soon as the next stage is written.
    """
    root, before = f"{shared_dir(spark)}/stages-{uuid.uuid4().hex}", None
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{root}/{k}")
            docs = spark.read.parquet(f"{root}/{k}")
            if before:
                remove(spark, before)
            before = f"{root}/{k}"
    return docs


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder in the shared store."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
