"""A stored search index and exact top-k search over it.

Documents are dealt to shards; a shard holds the postings of its documents as one row for each field and term: the
documents in ascending order, how often each has the term, how long the field is there, and the term's rarity, from which a
search works out what the term is worth in each (BM25+ without the field's boost). Postings and documents are tables bucketed by shard, so a search reads each shard where it lies:
terms go to the shards by broadcast, in batches of bounded size, and only a shard's best documents are sent on. What begins
with a term is a range of a shard's own terms in order: it is found there, and no list of it is made or sent. What a term
expands to besides is joined with the shards' terms and comes to a shard with its documents, so the driver holds none of it.

Within a shard a query takes its terms by falling bound (weight times largest worth) until what is left can lift no other
document over the k-th best so far (MaxScore, Turtle and Flood 1995); the few documents that may still be among the best
are then scored in full from their own terms. Results equal those of scoring every document.
"""

from __future__ import annotations

import json
import re
import uuid
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from lattis.functions.text import CJK, tokenize
from lattis.session import keep

K1, B, DELTA = 1.2, 0.7, 0.5
#: Documents of a shard, on average, and (query, term) pairs of a batch, which the driver holds at some 300 bytes a pair.
SHARD_DOCS, BATCH_PAIRS = 2048, 250_000
#: First letters of terms that postings are read by; with more of them nearly all are asked for.
HEADS = 100
#: Scores are compared after rounding to 6 places; a shard hands over what lies within this of its k-th best.
ROUNDING = 2e-6
POSTINGS = "shard INT, field STRING, term STRING, docs ARRAY<BIGINT>, tfs ARRAY<BIGINT>, lens ARRAY<BIGINT>, idf DOUBLE"


@dataclass
class SearchIndex:
    """postings (see POSTINGS), docs (doc_id, shard and the columns kept for filters), vocabulary (term, n_docs: documents by field summed), n_docs, means (field -> terms of a document)."""

    postings: DataFrame
    docs: DataFrame
    vocabulary: DataFrame
    n_docs: int
    means: dict[str, float]


def shard_of(doc_id, shards: int):
    return F.pmod(F.xxhash64(doc_id), F.lit(shards)).cast("int")


def build_postings(docs: DataFrame, fields: dict[str, bool], *by: str) -> DataFrame:
    """(by, field, term, doc_id, tf, len) of lower-case terms; fields: column -> whether CJK runs are expanded. len: terms of the field in the document.

    by: columns of the documents that these are dealt by, if they are: then nothing is shuffled.
    """
    parts = F.array(*[F.struct(F.lit(f).alias("field"), tokenize(F.lower(F.col(f)), cjk).alias("terms")) for f, cjk in fields.items()])
    rows = docs.select(*by, "doc_id", F.explode(parts).alias("p")).select(*by, "doc_id", "p.field", F.size("p.terms").cast("long").alias("len"), F.explode("p.terms").alias("term"))
    return rows.groupBy(*by, "field", "term", "doc_id", "len").agg(F.count("*").alias("tf"))


def field_terms(docs: DataFrame, fields: dict[str, bool], *by: str) -> DataFrame:
    """(by, doc_id, a column for each field): the lower-case terms of the fields, in order; fields as for build_postings."""
    return docs.select(*by, "doc_id", *[tokenize(F.lower(F.col(f)), cjk).alias(f) for f, cjk in fields.items()])


def term_counts(lists: pa.Array, rows: np.ndarray, n: int, by_row: bool = False) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """(names, term, row, tf): the distinct terms of the lists, and for each term (a number in names) and row how often it has it, in order of both (by_row: of row and term). rows: which of n rows each list is of."""
    size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    own = lists.flatten().dictionary_encode()
    term, row, k = own.indices.to_numpy().astype(np.int64), np.repeat(rows, size), max(len(own.dictionary), 1)
    key, tf = np.unique(row * k + term if by_row else term * n + row, return_counts=True)
    return own.dictionary, *((key % k, key // k) if by_row else (key // n, key % n)), tf


LISTS = "shard INT, field STRING, term STRING, docs ARRAY<BIGINT>, tfs ARRAY<BIGINT>, lens ARRAY<BIGINT>, n BIGINT, total BIGINT"


def shard_lists(fields: list[str]) -> Callable[[pa.Table], pa.Table]:
    """What a task does with the terms of a shard's documents (field_terms): -> LISTS."""
    kind = to_arrow_schema(StructType.fromDDL(LISTS))

    def run(docs: pa.Table) -> pa.Table:
        out = []
        for field in fields:
            lists = docs[field].combine_chunks()
            size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            held, rows = np.unique(np.stack([docs["doc_id"].to_numpy(), size], 1), axis=0, return_inverse=True)  # documents in order
            names, term, row, tf = term_counts(lists, rows.ravel(), len(held))
            ends = np.searchsorted(term, np.arange(len(names) + 1)).astype(np.int32)
            arrays = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x.astype(np.int64))) for x in (held[row, 0], tf, held[row, 1])]
            total = np.add.reduceat(tf, ends[:-1]) if len(names) else tf
            shard = pa.array(np.full(len(names), docs["shard"][0].as_py(), dtype=np.int32))
            found = [shard, pa.array([field] * len(names), pa.string()), names, *arrays, pa.array(np.diff(ends).astype(np.int64)), pa.array(total.astype(np.int64))]
            out.append(pa.table([x.cast(t.type) for x, t in zip(found, kind, strict=True)], schema=kind))
        return pa.concat_tables(out)

    return run


def with_idf(lists: pa.Table, idf: pa.Table) -> pa.Table:
    """A shard's lists with the rarity of each (field, term)."""
    key = lambda x: pc.binary_join_element_wise(x["field"], x["term"], "\0")
    return lists.append_column("idf", idf["idf"].combine_chunks().take(pc.index_in(key(lists), key(idf).combine_chunks())))


def write_index(docs: DataFrame, path: str, fields: dict[str, bool], columns: list[str], shards: int | None = None) -> None:
    """Writes the index of docs (doc_id long, unique, and the fields and columns) below path; its header goes last, so a half-written one is not opened.

    Documents are shuffled once, to their shards; beside them only the (shard, field, term) are, without their lists.
    """
    spark = docs.sparkSession
    n_docs = docs.count()
    # a small corpus is dealt so that all tasks have a part
    shards = shards or max(1, -(-n_docs // SHARD_DOCS), min(int(spark.conf.get("spark.sql.shuffle.partitions")), n_docs // 256))
    buckets = min(shards, 100_000)
    dealt = docs.withColumn("shard", shard_of("doc_id", shards)).repartition(buckets, "shard")
    rows = field_terms(dealt, fields, "shard").groupBy("shard").applyInArrow(shard_lists(list(fields)), LISTS)

    names = []

    def bucketed(rows: DataFrame, what: str) -> DataFrame:
        names.append(name := f"index_{uuid.uuid4().hex}")
        rows.write.format("parquet").bucketBy(buckets, "shard").sortBy("shard").option("path", f"{path}/{what}").mode("overwrite").saveAsTable(name)
        return spark.table(name)

    lists = bucketed(rows, "lists")
    means = {r["field"]: r["total"] / max(n_docs, 1) for r in lists.groupBy("field").agg(F.sum("total").alias("total")).collect()}  # a row for each field
    df = keep(lists.groupBy("field", "term").agg(F.sum("n").alias("df")))
    idf = df.select("field", "term", F.log(1 + (F.lit(n_docs) - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    idf = lists.select("shard", "field", "term").join(idf, ["field", "term"]).select("shard", "field", "term", "idf").toDF("shard", "field", "term", "idf").repartition(buckets, "shard")
    bucketed(lists.drop("n", "total").groupBy("shard").cogroup(idf.groupBy("shard")).applyInArrow(with_idf, POSTINGS), "postings")
    own = bucketed(dealt.select("doc_id", "shard", *columns), "docs")
    df.groupBy("term").agg(F.sum("df").alias("n_docs")).sort("term").write.mode("overwrite").parquet(f"{path}/vocabulary")
    header = {"n_docs": n_docs, "buckets": buckets, "means": means, "docs": ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema)}
    for name in names:
        spark.sql(f"DROP TABLE {name}")
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/lists")  # the postings hold them
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
    spark.createDataFrame([(json.dumps(header),)], "header string").coalesce(1).write.mode("overwrite").text(f"{path}/header")


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a finished index lies there."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/header/_SUCCESS")
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def open_index(spark: SparkSession, path: str) -> SearchIndex:
    """The index that write_index() left below path, in this or an earlier session; its tables keep their buckets."""
    header = json.loads(spark.read.text(f"{path}/header").first()[0])

    def bucketed(what: str, columns: str) -> DataFrame:
        name = f"index_{what}_{uuid.uuid5(uuid.NAMESPACE_URL, path).hex}"
        spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet CLUSTERED BY (shard) INTO {header['buckets']} BUCKETS LOCATION '{path}/{what}'")
        return spark.table(name)

    return SearchIndex(bucketed("postings", POSTINGS), bucketed("docs", header["docs"]), spark.read.parquet(f"{path}/vocabulary"), header["n_docs"], header["means"])


def flat(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Positions of ranges, one after another."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)


class Shard:
    """A shard's postings for the terms of a batch, by term and by document."""

    def __init__(self, postings: pd.DataFrame, ids: np.ndarray, number: dict[str, int], boosts: dict[str, float], parts: np.ndarray | None = None):
        """parts: what each term is worth in each of its documents, one term after another, unless postings have it."""
        boost = postings["field"].map(boosts).to_numpy(float)
        self.term = postings["term"].map(number).to_numpy(np.int64)
        self.sizes = postings["docs"].map(len).to_numpy(np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.doc = np.searchsorted(ids, np.concatenate(postings["docs"].to_list()))
        self.value = (np.concatenate(postings["parts"].to_list()) if parts is None else parts) * np.repeat(boost, self.sizes)
        self.bound = postings["most"].to_numpy(float) * boost
        order = np.argsort(self.doc, kind="stable")
        self.own_row, self.own_value = np.repeat(np.arange(len(boost)), self.sizes)[order], self.value[order]
        self.own_start = np.searchsorted(self.doc[order], np.arange(len(ids) + 1))
        self.n = len(ids)

    def holding(self, weight: np.ndarray) -> np.ndarray:
        """Which documents have any term."""
        rows, out = np.flatnonzero(weight[self.term] > 0), np.zeros(self.n, dtype=bool)
        out[self.doc[flat(self.starts[rows], self.sizes[rows])]] = True
        return out

    def best(self, weight: np.ndarray, k: int | None, allowed: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores) of those with any term; with k, a superset of the k best and their ties. weight: by term of the batch."""
        w = weight[self.term]
        rows = np.flatnonzero(w > 0)
        rows = rows[np.argsort(-(w * self.bound)[rows])]
        rest = np.cumsum((w * self.bound)[rows][::-1])[::-1]  # of this and all later rows
        entries = np.cumsum(self.sizes[rows])
        total, score, at = int(entries[-1]) if len(rows) else 0, np.zeros(self.n), 0
        for part in (8, 4, 2, 1):
            end = int(np.searchsorted(entries, -(-total // part))) + 1 if part > 1 else len(rows)
            if end > at:
                own = rows[at:end]
                where = flat(self.starts[own], self.sizes[own])
                score += np.bincount(self.doc[where], weights=self.value[where] * np.repeat(w[own], self.sizes[own]), minlength=self.n)
                at = end
            if k is None or at >= len(rows):
                continue
            seen = score if allowed is None else np.where(allowed, score, 0.0)
            if k > self.n:
                continue
            least = np.partition(seen, self.n - k)[self.n - k] - ROUNDING
            if rest[at] < least:
                found = np.flatnonzero(seen + rest[at] >= least) if allowed is None else np.flatnonzero(allowed & (score + rest[at] >= least))
                size = self.own_start[found + 1] - self.own_start[found]
                if size.sum() < total - entries[at - 1]:
                    where = flat(self.own_start[found], size)
                    full = np.bincount(np.repeat(np.arange(len(found)), size), weights=self.own_value[where] * w[self.own_row[where]], minlength=len(found))
                    return top(found, full, k)
        found = np.flatnonzero(score > 0 if allowed is None else (score > 0) & allowed)
        return top(found, score[found], k)


def top(found: np.ndarray, score: np.ndarray, k: int | None) -> tuple[np.ndarray, np.ndarray]:
    if k is None or len(found) <= k:
        return found, score
    some = score >= np.partition(score, len(score) - k)[len(score) - k] - ROUNDING
    return found[some], score[some]


def worth(postings: pd.DataFrame, means: dict[str, float]) -> tuple[np.ndarray, np.ndarray]:
    """What each term is worth in each of its documents, one term after another, and the largest of each."""
    ends = np.cumsum(postings["docs"].map(len).to_numpy(np.int64))
    tf, size = (np.concatenate(postings[c].to_list()) for c in ("tfs", "lens"))
    each = lambda x: np.repeat(x.to_numpy(float), np.diff(ends, prepend=0))
    part = each(postings["idf"]) * (DELTA + tf * (K1 + 1) / (tf + K1 * (1 - B + B * size / each(postings["field"].map(means)))))
    return part, np.maximum.reduceat(part, ends - np.diff(ends, prepend=0))


def searcher(batch, boosts: dict[str, float], means: dict[str, float], k: int | None, filters: list[str], others: bool) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    """What a task does with a shard: its postings and documents -> (q, doc_id, score, others); with others, a row of a query besides that tells how many hits its filters pass over."""

    def run(postings: pd.DataFrame, docs: pd.DataFrame) -> pd.DataFrame:
        terms, prefixed, wanted = batch.value
        out: list[pd.DataFrame] = []
        near = None
        if "expanded" in docs:  # what the terms expand to in this shard lies beside its documents
            more = docs["expanded"].notna()
            near, docs = pa.Table.from_pandas(docs.loc[more, ["term", "expanded", "weight"]], preserve_index=False), docs[~more]
        if len(postings) and len(docs):
            queries = Queries(terms, near, prefixed)
            docs = docs.sort_values("doc_id", ignore_index=True)
            ids = docs["doc_id"].to_numpy(np.int64)
            names = sorted(set(postings["term"]))
            parts, most = worth(postings, means)
            shard = Shard(postings.assign(most=most), ids, {t: i for i, t in enumerate(names)}, boosts, parts)
            for q, weight in queries.over(names):
                allowed = other = None
                for column, want in zip(filters, wanted.get(q, ()), strict=False):
                    if want is not None:
                        mask = (docs[column] == want).to_numpy()
                        allowed = mask if allowed is None else allowed & mask
                        mask = ~mask & docs[column].notna().to_numpy()
                        other = mask if other is None else other | mask
                found, score = shard.best(weight, k, allowed)
                if len(found):
                    out.append(pd.DataFrame({"q": q, "doc_id": ids[found], "score": score, "others": 0}))
                if others and other is not None and (n := int((shard.holding(weight) & other).sum())):
                    out.append(pd.DataFrame({"q": [q], "doc_id": 0, "score": 0.0, "others": n}))
        return pd.concat(out) if out else pd.DataFrame({"q": [], "doc_id": [], "score": [], "others": []})

    return run


def ranges(keys: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, bounds): rows ordered by key, and where those of each key, 0 to n - 1, begin."""
    order = np.argsort(keys, kind="stable")
    return order, np.searchsorted(keys[order], np.arange(n + 1))


class Queries:
    """A batch of queries: the terms of each, with weights, what a term expands to, and what one that a term begins is worth (times the term's share of its length)."""

    def __init__(self, terms: pa.Table, more: pa.Table | None, prefixed: float | None = None):
        asked = terms["term"].to_pandas()
        other = more["term"].to_pandas() if more is not None else asked[:0]
        into = more["expanded"].to_pandas() if more is not None else asked[:0]
        code, names = pd.factorize(pd.concat([asked, other, into], ignore_index=True))
        self.words = list(names)
        a, b = len(asked), len(asked) + len(other)
        order, self.begin = ranges(code[a:b], len(names))
        self.into = code[b:][order].astype(np.int32)
        self.worth = more["weight"].to_numpy()[order] if more is not None else np.empty(0)
        self.stems = [self.words[i] for i in np.unique(code[:a])] if prefixed is not None else []
        self.stems, self.prefixed = [t for t in self.stems if not re.search(f"[{CJK}]", t)], prefixed
        q, names = pd.factorize(terms["q"].to_pandas())
        self.names = np.asarray(names)
        order, self.first = ranges(q, len(names))
        self.term, self.weight = code[:a][order], terms["weight"].to_numpy()[order]

    def begun(self, names: list[str]) -> dict[str, tuple[int, int, np.ndarray]]:
        """For each term that others may begin with, where these lie among the names, which are in order, and what each is worth."""
        lengths, worth, out = np.array([len(t) for t in names]), {}, {}
        for t in self.stems:
            begin, end = bisect_left(names, t), bisect_right(names, t, key=lambda x, n=len(t): x[:n])
            begin += begin < end and names[begin] == t
            if begin < end:
                if len(t) not in worth:
                    # as Spark rounds: halves of the shortest decimal go up
                    worth[len(t)] = np.array([0.0] + [float(Decimal(repr(self.prefixed * len(t) / n)).quantize(Decimal("0.000001"), ROUND_HALF_UP)) for n in range(1, int(lengths.max()) + 1)])
                out[t] = begin, end, worth[len(t)][lengths[begin:end]]
        return out

    def over(self, names: list[str]) -> Iterator[tuple[int, np.ndarray]]:
        """(q, weight of each name), for names in order; the array is used again for the next query."""
        number, begun = {t: i for i, t in enumerate(names)}, self.begun(names)
        here = np.array([number.get(t, len(names)) for t in self.words], dtype=np.int64)  # the last place is for what is not there
        weight = np.zeros(len(names) + 1)
        for i, q in enumerate(self.names.tolist()):
            weight[:] = 0
            own = self.term[self.first[i] : self.first[i + 1]]
            where = flat(self.begin[own], self.begin[own + 1] - self.begin[own])
            np.maximum.at(weight, here[self.into[where]], self.worth[where])
            for begin, end, worth in (begun[t] for t in map(self.words.__getitem__, own) if t in begun):
                np.maximum(weight[begin:end], worth, out=weight[begin:end])
            weight[here[own]] = np.maximum(weight[here[own]], self.weight[self.first[i] : self.first[i + 1]])
            yield q, weight[:-1]


def search_terms(index: SearchIndex, terms: DataFrame, boosts: dict[str, float], k: int | None = None, expansions: DataFrame | None = None, filters: DataFrame | None = None, columns: tuple[str, ...] = (), pairs: int = BATCH_PAIRS, prefixed: float | None = None, each: Callable[[DataFrame], DataFrame] | None = None, others: bool = False) -> DataFrame:
    """(qid, doc_id, score, rank): documents with any of a query's terms, best first, ties to the smaller doc_id; with k, the k best.

    terms: qid, term, weight, one row for each term of a query. expansions: term, expanded, weight: terms searched for as
    well. prefixed: terms that begin with a query's (unless that has CJK) are, too, at this times its share of their
    length, rounded to 6 places. Of several ways to a term the heaviest counts. filters: qid, want_<column> for some of the index's columns
    (null: any): other documents are passed over before the k best are taken. Scores are the sum over terms and fields of
    weight, boost and BM25+, rounded to 6 places. Queries go in batches whose terms are `pairs` or so, and expansions from the
    executors to the shards that have them; of several batches, with k or each, the rows are kept and the broadcast is given up before the next, so that the driver holds one batch.
    each: what is made of a batch's rows, which are all of its queries' rows; the result is then what it makes. others: with
    a column others, null but in rows without a document, some for a query: how many with its terms are passed over, as a
    wanted column has another value. They are counted in their shards.
    """
    spark = terms.sparkSession
    terms = terms.select("qid", "term", F.col("weight").cast("double").alias("weight"))
    qids = keep(terms.select("qid").distinct().withColumn("q", F.monotonically_increasing_id()))
    known = keep(terms.join(qids, "qid").select("q", "term", "weight"))
    total = known.count()
    if expansions is not None:
        expansions = keep(expansions.join(known.select("term").distinct(), "term", "left_semi").select("term", "expanded", F.col("weight").cast("double").alias("weight")))
        few = expansions.limit(pairs + 1).count() <= pairs
    names = [c for c in columns if filters is not None and f"want_{c}" in filters.columns]
    n, out = max(1, -(-total // pairs)), None
    for b in range(n):
        mine = lambda df: df.where(F.pmod(F.xxhash64("q"), F.lit(n)) == b) if n > 1 else df  # noqa: E731, B023
        some = mine(known)
        more = expansions if n == 1 or expansions is None else expansions.join(F.broadcast(some.select("term").distinct()), "term", "left_semi")
        own = some.toArrow()  # `pairs` rows or so
        wanted = {}
        if names:
            rows = filters.join(F.broadcast(mine(qids)), "qid").select("q", *[f"want_{c}" for c in names])
            wanted = {r["q"]: tuple(r[f"want_{c}"] for c in names) for r in rows.collect()}  # a row for each query of the batch
        batch = spark.sparkContext.broadcast((own, prefixed, wanted))
        asked = some.select("term") if more is None else some.select("term").unionByName(more.select(F.col("expanded").alias("term")))
        postings, heads = index.postings.where(F.col("field").isin(list(boosts))).select("shard", "field", "term", "docs", "tfs", "lens", "idf"), {t[:3] for t in Queries(own, None, prefixed).stems}
        docs = index.docs.select("shard", "doc_id", *names)
        if more is not None:
            near = postings.select("shard", F.col("term").alias("expanded")).distinct().join(more, "expanded").select("shard", F.lit(0).cast("long").alias("doc_id"), "term", "expanded", "weight")
            docs = docs.unionByName(near, allowMissingColumns=True)
        if more is not None and not few:
            pass  # so many expansions are not broadcast: all postings are read
        elif not heads:
            postings = postings.join(F.broadcast(asked.distinct()), "term", "left_semi")  # terms of the batch
        elif len(heads) <= HEADS:
            some_head = "^(?:" + "|".join(f"\\Q{h}\\E" for h in sorted(heads)) + ")"
            postings = postings.join(F.broadcast(asked.distinct().withColumn("asked", F.lit(True))), "term", "left").where(F.col("asked") | F.col("term").rlike(some_head)).drop("asked")
        hits = postings.groupBy("shard").cogroup(docs.groupBy("shard")).applyInPandas(searcher(batch, boosts, index.means, k, names, others), "q long, doc_id long, score double, others long")
        hits = hits.join(F.broadcast(mine(qids)), "q").select("qid", "doc_id", F.round("score", 6).alias("score"), "others")
        best = Window.partitionBy("qid").orderBy(*[F.col("others") > 0] * others, F.desc("score"), "doc_id")  # rows that only count come last
        hits = hits.withColumn("rank", F.row_number().over(best))
        hits = hits if k is None else hits.where((F.col("rank") <= k) | (F.col("others") > 0)) if others else hits.where(F.col("rank") <= k)
        counts = F.col("others") > 0
        hits = hits.select("qid", *[F.when(~counts, F.col(c)).alias(c) for c in ("doc_id", "score", "rank")], F.when(counts, F.col("others")).alias("others")) if others else hits.drop("others")
        hits = hits if each is None else each(hits)
        if n > 1 and (k is not None or each is not None):
            hits = keep(hits)
            batch.destroy()
        out = hits if out is None else out.unionByName(hits)
    return out
