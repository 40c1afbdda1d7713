"""URL filters by a sort-merge range join.

A host's labels are put in reverse order, each followed by a dot: all hosts under a rule's host then begin with the
rule's key, so a rule is an interval of keys. Rules and urls are sorted together by key and swept once: a stack holds the
rules whose intervals are open, from the outermost to the innermost. The urls are dealt by ranges of (key, page_id), so
that a host with any share of all urls is split; what is open at the start of a range are the rules on the key's own
ancestors, looked up by a join.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattis.llm.components import keep
from lattis.llm.shards import nullable_id, whole_id

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (host, path, verdict)
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first :// up to / ? # or the end, A-Z in lower case. Path: from there up to ? # or the end. Both empty without ://."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    return F.translate(host, UPPER, LOWER), F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def host_key(host: Column) -> Column:
    """com.example. for example.com; empty for an empty host."""
    return F.when(host == "", F.lit("")).otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit(".")))


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """The longest rule that fits each url: page_id, host, path, rule, verdict.

    pages: page_id, url; rules: host, path, verdict. A rule fits its host and all subdomains if the url's path starts with
    the rule's. rule is host and path of the longest fitting rule (null if none; of equally long ones that with the longer
    host), verdict is the rule's, else `default`.

    A null url, or one without ://, has an empty host and path and fits no rule. Rules with a null are left out; of rules
    with one host and path the smallest verdict counts. Repeated pages give a row each; null page_ids are kept. Empty
    tables give no rows (pages) or the default (rules).
    """
    host, path = host_and_path(F.col("url").cast("string"))
    points = pages.select(whole_id("page_id"), host.alias("host"), path.alias("path"))
    points = points.withColumn("key", host_key(F.col("host")))
    rules = rules.where("host is not null and path is not null and verdict is not null")
    rules = rules.groupBy(F.translate(F.col("host"), UPPER, LOWER).alias("host"), "path").agg(F.min("verdict").alias("verdict"))
    rules = keep(rules.where("host <> ''").withColumn("key", host_key(F.col("host"))))
    both = points.select("key", "page_id", "host", "path", F.lit(1).alias("kind"), F.lit(None).cast("string").alias("verdict"))
    both = both.unionByName(rules.select("key", F.lit(0).cast("long").alias("page_id"), "host", "path", F.lit(0).alias("kind"), "verdict"))
    partitions = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    swept = keep(both.repartitionByRange(partitions, "key", "kind", "page_id").sortWithinPartitions("key", "kind", "page_id").withColumn("part", F.spark_partition_id()))
    # the rules open where a range begins: those on the first key and its ancestors
    first = swept.groupBy("part").agg(F.min("key").alias("key"))
    labels = F.split("key", r"\.")
    ancestors = F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))), lambda n: F.concat(F.array_join(F.slice(labels, 1, n), "."), F.lit(".")))
    opened = first.select("part", F.explode(ancestors).alias("key")).join(rules, "key")
    opened = opened.groupBy("part").agg(F.sort_array(F.collect_list(F.struct("key", "host", "path", "verdict"))).alias("opened"))
    rows = swept.withColumn("opened", F.lit(None).cast("array<struct<key:string,host:string,path:string,verdict:string>>"))
    starts = opened.select(F.lit("").alias("key"), F.lit(0).cast("long").alias("page_id"), F.lit("").alias("host"), F.lit("").alias("path"), F.lit(-1).alias("kind"), F.lit(None).cast("string").alias("verdict"), "part", "opened")
    rows = rows.unionByName(starts)

    def sweep(pdf: pd.DataFrame) -> pd.DataFrame:
        stack: list[tuple[str, dict[str, str], list[int]]] = []  # key, verdict by path, lengths of paths

        def open_rule(key: str, path: str, verdict: str, host: str) -> None:
            while stack and not key.startswith(stack[-1][0]):
                stack.pop()
            if not stack or stack[-1][0] != key:
                stack.append((key, {}, []))
            paths, lengths = stack[-1][1:]
            paths[path] = (host + path, verdict)
            if len(path) not in lengths:
                lengths.append(len(path))
                lengths.sort(reverse=True)

        out = []
        for key, page, host, path, kind, verdict, opened in pdf.sort_values(["kind_first", "key", "kind", "path"], kind="stable")[["key", "page_id", "host", "path", "kind", "verdict", "opened"]].itertuples(index=False):
            if kind == -1:
                for r in opened:
                    open_rule(r["key"], r["path"], r["verdict"], r["host"])
            elif kind == 0:
                open_rule(key, path, verdict, host)
            else:
                while stack and not key.startswith(stack[-1][0]):
                    stack.pop()
                best = None
                for _, paths, lengths in reversed(stack):
                    hit = next((paths[path[:n]] for n in lengths if n <= len(path) and path[:n] in paths), None)
                    if hit and (best is None or len(hit[0]) > len(best[0])):
                        best = hit
                out.append((page, host, path, best[0] if best else None, best[1] if best else default))
        return pd.DataFrame(out, columns=["page_id", "host", "path", "rule", "verdict"]).astype({"page_id": "int64"})

    rows = rows.withColumn("kind_first", (F.col("kind") >= 0).cast("int"))
    return nullable_id(rows.groupBy("part").applyInPandas(sweep, "page_id long, host string, path string, rule string, verdict string"), "page_id")
