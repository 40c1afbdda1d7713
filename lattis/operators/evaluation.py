"""Retrieval evaluation: key matches, recall, precision, MRR, NDCG, verdicts, summaries, buckets, percentiles.

Cases: id, query, category, expected (array of keys), expected_type. Returned: id, rank (from 1), key, type.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattis.session import keep

# Suffixes and the prefix that a key is compared without.
KEY_SUFFIX = r"\.weapon$|\.vehicle$|\.projectile$|\.call$|\.carry_item$|\.xml$|\.character$"
KEY_PREFIX = "^gkw_"


def normal_key(key: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(key), KEY_SUFFIX, ""), KEY_PREFIX, ""), "[_-]", "")


def match_keys(cases: DataFrame, returned: DataFrame) -> DataFrame:
    """(id, pos, rank): expected positions and returned ranks whose keys are part of each other. Only keys of one case meet."""
    want = cases.select("id", F.posexplode("expected").alias("pos", "want")).withColumn("want", normal_key(F.col("want")))
    got = returned.select("id", "rank", normal_key(F.col("key")).alias("got"))
    return want.join(got, "id").where(F.contains("got", "want") | F.contains("want", "got")).select("id", "pos", "rank")


def metrics(cases: DataFrame, returned: DataFrame) -> DataFrame:
    """(id, n_expected, n_returned, recall_1, recall_5, recall_10, recall_20, precision_5, mrr_10, ndcg_10)."""
    m = match_keys(cases, returned)
    by_pos = m.groupBy("id", "pos").agg(F.min("rank").alias("rank")).groupBy("id").agg(*[F.count_if(F.col("rank") <= k).alias(f"r{k}") for k in (1, 5, 10, 20)])
    by_rank = m.select("id", "rank").distinct().groupBy("id").agg(F.count_if(F.col("rank") <= 5).alias("p5"), F.min(F.when(F.col("rank") <= 10, F.col("rank"))).alias("first"), F.sum(F.when(F.col("rank") <= 10, 1 / F.log2(F.col("rank") + 1)).otherwise(0.0)).alias("dcg"))
    n = returned.groupBy("id").agg(F.count("*").alias("n"))
    rows = cases.select("id", F.size("expected").alias("e")).join(n, "id", "left").join(by_pos, "id", "left").join(by_rank, "id", "left").na.fill(0)
    none = F.col("e") == 0
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.least(F.col("e"), F.lit(10)), F.lit(1))), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    r = lambda x: F.round(x, 9)
    return rows.select(
        "id", F.col("e").alias("n_expected"), F.col("n").alias("n_returned"), *[F.when(none, 1.0).otherwise(r(F.col(f"r{k}") / F.col("e"))).alias(f"recall_{k}") for k in (1, 5, 10, 20)],
        F.when(none, (F.col("n") == 0).cast("double")).when(F.col("n") == 0, 0.0).otherwise(r(F.col("p5") / F.least(F.col("n"), F.lit(5)))).alias("precision_5"),
        F.when(none, 1.0).when(F.col("first") > 0, r(1 / F.col("first"))).otherwise(0.0).alias("mrr_10"), F.when(none, 1.0).otherwise(r(F.col("dcg") / ideal)).alias("ndcg_10"),
    )


def recall_at_k(cases: DataFrame, returned: DataFrame) -> DataFrame:
    return metrics(cases, returned).select("id", "recall_1", "recall_5", "recall_10", "recall_20")


def precision_at_k(cases: DataFrame, returned: DataFrame) -> DataFrame:
    return metrics(cases, returned).select("id", "precision_5")


def mrr_at_k(cases: DataFrame, returned: DataFrame) -> DataFrame:
    return metrics(cases, returned).select("id", "mrr_10")


def ndcg_at_k(cases: DataFrame, returned: DataFrame) -> DataFrame:
    return metrics(cases, returned).select("id", "ndcg_10")


def judge_cases(cases: DataFrame, returned: DataFrame) -> DataFrame:
    """metrics() with category, query, type_correct, empty, passed and reason."""
    typed = returned.join(cases.select("id", "expected_type"), "id").groupBy("id").agg(F.max((F.col("type") == F.col("expected_type")).cast("int")).alias("typed"))
    rows = metrics(cases, returned).join(cases.select("id", "query", "category", "expected_type"), "id").join(typed, "id", "left")
    empty, has = F.col("n_returned") == 0, F.coalesce("typed", F.lit(0)) == 1
    right = F.col("expected_type").isNull() | empty | has
    reason = (
        F.when(F.col("n_expected") == 0, F.when(empty, "none").otherwise("low_confidence")).when(empty, "candidate_missing")
        .when(F.col("recall_5") == 0, F.when(~has & F.col("expected_type").isNotNull(), "intent_wrong").otherwise("candidate_missing")).when(F.col("recall_5") < 1, "rerank_wrong").otherwise("none")
    )
    passed = (F.col("recall_5") >= 0.5) & F.when(F.col("n_expected") == 0, empty).otherwise(~empty) & right
    return rows.select("*", right.alias("type_correct"), empty.alias("empty"), passed.alias("passed"), reason.alias("reason")).drop("typed", "expected_type")


MEANS = ["recall_1", "recall_5", "recall_10", "recall_20", "precision_5", "mrr_10", "ndcg_10"]


def summarize_eval(judged: DataFrame) -> DataFrame:
    """One row of counts, means and reasons; the exact-key hit rate is 1 without such cases."""
    exact = F.col("category") == "exact-key"
    reasons = ["intent_wrong", "candidate_missing", "rerank_wrong", "low_confidence", "none"]
    mean = lambda c: F.round(F.avg(c), 6)
    return judged.agg(
        F.count("*").alias("cases"), F.count_if("passed").alias("passed"), *[mean(c).alias(c) for c in MEANS], mean(F.col("empty").cast("double")).alias("empty_rate"), mean(F.col("type_correct").cast("double")).alias("type_accuracy"),
        F.coalesce(F.round(F.count_if(exact & (F.col("recall_5") == 1)) / F.nullif(F.count_if(exact), F.lit(0)), 6), F.lit(1.0)).alias("exact_key_rate"), *[F.count_if(F.col("reason") == r).alias(f"reason_{r}") for r in reasons],
    )


def language_of(query: Column) -> Column:
    cjk, latin = query.rlike("[⺀-鿿가-힯豈-﫿]"), query.rlike("[a-zA-Z]")
    return F.when(cjk & latin, "mixed").when(cjk, "zh").otherwise("en")


def length_of(query: Column) -> Column:
    return F.when(F.length(query) <= 10, "short").when(F.length(query) <= 30, "medium").otherwise("long")


def bucket_eval(judged: DataFrame) -> DataFrame:
    """(bucket, n, passed, recall_5, precision_5, mrr_10, ndcg_10): by category, language and length of the query, in one pass."""
    rows = judged.withColumn("buckets", F.array(F.col("category"), F.concat(F.lit("lang:"), language_of(F.col("query"))), F.concat(F.lit("len:"), length_of(F.col("query")))))
    rows = rows.withColumn("bucket", F.explode("buckets"))
    return rows.groupBy("bucket").agg(F.count("*").alias("n"), F.count_if("passed").alias("passed"), *[F.round(F.avg(c), 6).alias(c) for c in ("recall_5", "precision_5", "mrr_10", "ndcg_10")])


def index_percentile(values: DataFrame, column: str, shares: list[float], *by: str) -> DataFrame:
    """(by, p<share>): the value at index floor(n * share) of the sorted values, the last if beyond.

    Values are dealt by ranges, so a group of any size is split; a row's rank is its rank in its range and the rows of the
    group in earlier ranges. Only the counts of a range and group are windowed by group.
    """
    rows = values.where(F.col(column).isNotNull()).select(*by, column)
    ranges = int(values.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = keep(rows.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(ranges, *by, column, "tie").drop("tie").withColumn("part", F.spark_partition_id()))
    group = Window.partitionBy(*by)
    held = rows.groupBy("part", *by).agg(F.count("*").alias("k")).withColumn("before", F.sum("k").over(group.orderBy("part")) - F.col("k")).withColumn("n", F.sum("k").over(group))
    held = held.drop("k").withColumnsRenamed({"part": "held_part", **{c: f"held_{c}" for c in by}})  # a row for each range and group
    same = [F.col(c).eqNullSafe(F.col(f"held_{c}")) for c in by]
    rows = rows.join(F.broadcast(held), [F.col("part") == F.col("held_part"), *same])
    rows = rows.withColumn("i", F.col("before") + F.row_number().over(Window.partitionBy("part", *by).orderBy(column)) - 1)
    return rows.groupBy(*by).agg(*[F.max(F.when(F.col("i") == F.least(F.floor(F.col("n") * s), F.col("n") - 1), F.col(column))).alias(f"p{round(s * 100)}") for s in shares])
