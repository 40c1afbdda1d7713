"""The stored index and its pruned top-k against scoring every document, and held texts against brute force."""

import math
import random
from collections import Counter, defaultdict

import pytest

from lattis.operators import index as I
from lattis.operators import retrieval as R

FIELDS = {"key": False, "content": False}
BOOSTS = {"key": 3.0, "content": 1.0}


def corpus(seed=1, n=300):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcde") for _ in range(rng.randrange(1, 5))) for _ in range(120)]
    return [(7 * i - 400, f"k{i % 40} {rng.choice(words)}", " ".join(rng.choices(words, k=rng.randrange(0, 30))) or None, rng.choice(["x", "y", None])) for i in range(n)], words


def brute(rows, terms, boosts, allowed=lambda q, r: True):
    """(qid, doc_id, score, rank) by the formula, document by document."""
    lists = {(f, r[0]): [t for t in (r[c] or "").lower().split() if t] for r in rows for f, c in (("key", 1), ("content", 2))}
    mean = {f: sum(len(v) for (g, _), v in lists.items() if g == f) / len(rows) for f in boosts}
    df = Counter((f, t) for (f, _), v in lists.items() for t in set(v))
    queries, out = defaultdict(dict), []
    for q, t, w in terms:
        queries[q][t] = max(w, queries[q].get(t, 0))
    for q, weights in queries.items():
        scored = []
        for r in rows:
            s, met = 0.0, False
            for f, boost in boosts.items():
                own = lists[f, r[0]]
                for t, tf in Counter(own).items():
                    if t in weights:
                        met = True
                        idf = math.log(1 + (len(rows) - df[f, t] + 0.5) / (df[f, t] + 0.5))
                        s += weights[t] * boost * idf * (I.DELTA + tf * (I.K1 + 1) / (tf + I.K1 * (1 - I.B + I.B * len(own) / mean[f])))
            if met and allowed(q, r):
                scored.append((-round(s, 6), r[0]))
        out += [(q, d, -s, k) for k, (s, d) in enumerate(sorted(scored), 1)]
    return sorted(out)


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    rows, words = corpus()
    path = str(tmp_path_factory.mktemp("index"))
    df = spark.createDataFrame(rows, "doc_id long, key string, content string, type string")
    I.write_index(df, path, FIELDS, ["type"], shards=3)
    assert I.exists(spark, path) and not I.exists(spark, path + "/none")
    return rows, words, I.open_index(spark, path)


@pytest.mark.parametrize(("k", "pairs"), [(None, 10**6), (5, 10**6), (5, 60), (1, 10**6), (1000, 10**6)])
def test_top_k(spark, built, k, pairs):
    rows, words, found = built
    rng = random.Random(k or 0)
    own = [(q, t, 1.0) for q in range(8) for t in rng.sample(words, rng.randrange(1, 6))] + [(9, "unknown", 1.0), (10, "k3", 2.0)]
    more = [(t, e, 0.4) for t in {t for _, t, _ in own} for e in rng.sample(words, 20) if e != t]
    into = defaultdict(list)
    for t, e, w in more:
        into[t].append((e, w))
    every = own + [(q, e, w) for q, t, _ in own for e, w in into[t]]
    got = I.search_terms(found, spark.createDataFrame(own, "qid long, term string, weight double"), BOOSTS, k, spark.createDataFrame(more, "term string, expanded string, weight double"), pairs=pairs)
    want = [r for r in brute(rows, every, BOOSTS) if k is None or r[3] <= k]
    assert sorted((r.qid, r.doc_id, round(r.score, 6), r.rank) for r in got.collect()) == [(q, d, round(s, 6), n) for q, d, s, n in want]


def test_top_k_filters(spark, built):
    rows, words, found = built
    own = [(q, t, 1.0) for q in range(4) for t in random.Random(q).sample(words, 4)]
    wanted = {0: "x", 1: "y", 2: None}
    filters = spark.createDataFrame(list(wanted.items()), "qid long, want_type string")
    got = I.search_terms(found, spark.createDataFrame(own, "qid long, term string, weight double"), BOOSTS, 7, filters=filters, columns=("type",))
    want = [r for r in brute(rows, own, BOOSTS, lambda q, r: wanted.get(q) is None or r[3] == wanted[q]) if r[3] <= 7]
    assert sorted((r.qid, r.doc_id, r.rank) for r in got.collect()) == [(q, d, n) for q, d, _, n in want]


def test_others_are_counted_in_the_shards(spark, built):
    """Hits that a filter passes over come as numbers, not as rows; those without a value are neither."""
    rows, words, found = built
    rng = random.Random(9)
    own = [(q, t, 1.0) for q in range(8) for t in rng.sample(words, 4)]
    wanted = {q: ["x", "y", None, "nowhere"][q % 4] for q in range(8)}
    filters = spark.createDataFrame(list(wanted.items()), "qid long, want_type string")
    got = I.search_terms(found, spark.createDataFrame(own, "qid long, term string, weight double"), BOOSTS, 3, filters=filters, columns=("type",), others=True).collect()
    best = brute(rows, own, BOOSTS, lambda q, r: wanted[q] is None or r[3] == wanted[q])
    assert [(q, d, k) for q, d, _, k in best if k <= 3] == sorted((r.qid, r.doc_id, r["rank"]) for r in got if r.others is None)
    more = Counter(q for q, *_ in brute(rows, own, BOOSTS, lambda q, r: None not in (wanted[q], r[3]) and r[3] != wanted[q]))
    assert more and len(got) <= 8 * (3 + 3)  # three shards
    told = Counter()
    for r in got:
        told[r.qid] += r.others or 0
    assert +told == more


def test_pruning_leaves_terms_out():
    """With one telling term and many poor ones, the poor ones are looked up for a few documents only, and the best are the same."""
    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(1)
    n = 2000
    lists = [np.sort(rng.choice(n, 20, replace=False))] + [np.sort(rng.choice(n, 400, replace=False)) for _ in range(60)]
    frame = pd.DataFrame({"field": "content", "term": [f"t{i}" for i in range(61)], "docs": lists, "parts": [np.full(20, 50.0) + rng.random(20)] + [rng.random(400) * 0.1 for _ in range(60)]})
    frame["most"] = frame["parts"].map(max)
    shard = I.Shard(frame, np.arange(n), {f"t{i}": i for i in range(61)}, {"content": 1.0})
    weight = np.ones(61)
    found, score = shard.best(weight, 10, None)
    whole = np.bincount(shard.doc, weights=shard.value, minlength=n)
    best = np.argsort(-whole)[:10]
    assert set(best) <= set(found) and len(found) < 30 and np.allclose(score, whole[found])


def test_reads_stored_postings_without_shuffle(spark, built):
    """Postings stay where they lie: no exchange above their scan but that of the results."""
    _, words, found = built
    terms = spark.createDataFrame([(1, words[0], 1.0)], "qid long, term string, weight double")
    plan = I.search_terms(found, terms, BOOSTS, 5)._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.index("FlatMapCoGroups") :]
    assert "Bucketed: true" in below and below.count("hashpartitioning(shard") == 0


@pytest.mark.parametrize(("k", "each"), [(5, False), (5, True), (None, True)])
def test_driver_holds_one_batch(spark, built, k, each):
    """Of several batches each is done with before the next: no search and no broadcast of an earlier one is left in the plan."""
    rows, words, found = built
    own = [(q, t, 1.0) for q in range(12) for t in words[q : q + 6]]
    terms = spark.createDataFrame(own, "qid long, term string, weight double")
    best = lambda hits: hits.where("rank <= 3").select("qid", "doc_id", "rank")
    got = I.search_terms(found, terms, BOOSTS, k, pairs=12, **({"each": best} if each else {}))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan ExistingRDD") > 2 and "FlatMapCoGroups" not in plan and "Broadcast" not in plan
    want = [(q, d, n) for q, d, _, n in brute(rows, own, BOOSTS) if n <= (3 if each else k)]
    assert sorted((r.qid, r.doc_id, r.rank) for r in got.collect()) == want


@pytest.mark.parametrize("k", [None, 5])
def test_driver_holds_no_expansions(spark, built, k, monkeypatch):
    """What terms expand to, more than a batch, goes to the shards past the driver, which holds the terms alone."""
    rows, words, found = built
    own = [(q, t, 1.0) for q in range(3) for t in words[4 * q : 4 * q + 4]]
    more = [(t, e, 0.25) for t in words[:12] for e in words[20:50]]
    frame, held = type(spark.range(0)), []
    monkeypatch.setattr(frame, "toArrow", lambda self, f=frame.toArrow: (held.append(x := f(self)), x)[1])
    got = I.search_terms(found, spark.createDataFrame(own, "qid long, term string, weight double"), BOOSTS, k, spark.createDataFrame(more, "term string, expanded string, weight double"), pairs=40)
    assert [x.num_rows for x in held] == [len(own)]
    every = own + [(q, e, w) for q, t, _ in own for x, e, w in more if x == t]
    want = [r for r in brute(rows, every, BOOSTS) if k is None or r[3] <= k]
    assert sorted((r.qid, r.doc_id, round(r.score, 6), r.rank) for r in got.collect()) == [(q, d, round(s, 6), n) for q, d, s, n in want]


def test_containing_and_holding(spark):
    rng = random.Random(2)
    text = lambda n: "".join(rng.choice("ab c\U0001f600") for _ in range(n))
    small, big = [(i, text(rng.randrange(0, 5))) for i in range(30)], [(i, text(rng.randrange(0, 60))) for i in range(40)]
    got = R.containing(spark.createDataFrame(small, "a int, s string"), spark.createDataFrame(big, "b int, t string"))
    assert sorted(map(tuple, got.collect())) == sorted((a, b) for a, s in small for b, t in big if s and s in t)
    got = R.holding(spark.createDataFrame(small, "item int, s string"), spark.createDataFrame(big, "doc int, t string"))
    assert sorted(map(tuple, got.collect())) == sorted((a, b) for a, s in small for b, t in big if s and s in t)


def test_holding_is_linear(spark):
    """Twice the words take less than three times as long."""
    import time

    items = spark.createDataFrame([(1, "w5 w6 w7 w8"), (2, "w7"), (3, "zz")], "item int, s string")

    def seconds(n):
        docs = spark.createDataFrame([(1, " ".join(f"w{i % 997}" for i in range(n)))], "doc int, t string")
        began = time.time()
        assert R.holding(items, docs).count() == 2
        return time.time() - began

    seconds(1000)
    assert seconds(200_000) < 3 * max(seconds(100_000), 2.0)


@pytest.mark.parametrize("n", [0, 1, 500])
def test_running_sums(spark, n):
    """One group of most rows, ties and null groups: each row once, sums over the group's rows up to it."""
    from pyspark.sql import functions as F

    from lattis.operators.running import running_sums

    rng = random.Random(n)
    rows = [(rng.choice(["hot"] * 8 + ["b", "c", None]), rng.randrange(40), rng.randrange(5), i) for i in range(n)]
    got = running_sums(spark.createDataFrame(rows, "g string, o int, v int, id int"), "g", [F.desc("o")], total=F.col("v"), place=F.lit(1)).collect()
    assert len(got) == n
    for g in {r[0] for r in rows}:
        own = sorted((r for r in got if r.g == g), key=lambda r: r.place)
        assert [r.place for r in own] == list(range(1, len(own) + 1)) and [r.o for r in own] == sorted((r.o for r in own), reverse=True)
        assert [r.total for r in own] == [sum(x.v for x in own[: i + 1]) for i in range(len(own))]


@pytest.mark.parametrize(("k", "many"), [(None, False), (5, False), (5, True)])
def test_prefixes_are_found_in_the_shards(spark, built, k, many, monkeypatch):
    """Words that a term begins need no list of expansions; with it the result is the same, also where all postings are read."""
    rows, words, found = built
    monkeypatch.setattr(I, "HEADS", 0 if many else 100)
    own = [(q, t, w) for q, ts in enumerate([["a", "bc"], ["abcd", "k"], ["zz"], ["e", "ea", "eab"], ["k1"]]) for t, w in zip(ts, [1.0, 0.01, 2.0], strict=False)]
    terms = spark.createDataFrame(own, "qid long, term string, weight double")
    got = I.search_terms(found, terms, BOOSTS, k, prefixed=R.PREFIX_WEIGHT)
    listed = [tuple(r) for r in R.expand_terms(terms, found.vocabulary).where("kind = 'prefix'").select("term", "expanded", "weight").collect()]
    every = own + [(q, e, w) for q, t, _ in own for x, e, w in listed if x == t]
    want = [r for r in brute(rows, every, BOOSTS) if k is None or r[3] <= k]
    assert listed and sorted((r.qid, r.doc_id, round(r.score, 6), r.rank) for r in got.collect()) == [(q, d, round(s, 6), n) for q, d, s, n in want]


def test_worth_of_prefixes_is_rounded_as_spark_rounds():
    import pyarrow as pa

    asked = I.Queries(pa.table({"q": [1], "term": ["abc"], "weight": [1.0]}), None, 0.375)
    assert asked.begun(["ab", "abc", "abc" + "d" * 13, "abd"])["abc"][2].tolist() == [0.070313]  # 0.0703125


def test_documents_are_shuffled_not_their_postings(spark):
    """Of dealt documents the postings of a shard need no exchange of their own."""
    docs = spark.createDataFrame([(1, "a b"), (2, "b")], "doc_id long, content string").withColumn("shard", I.shard_of("doc_id", 2)).repartition(2, "shard")
    plan = I.build_postings(docs, {"content": False}, "shard").groupBy("shard", "field", "term").count()._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_lists_of_a_shard(spark):
    """Terms are counted by document and length, documents in order; a null field or one without terms has no lists."""
    import pyarrow as pa

    docs = pa.table({"shard": pa.array([4, 4, 4, 4], pa.int32()), "doc_id": [9, -2, 5, 7], "content": [["b", "a", "b"], ["b"], None, []], "key": pa.array([None] * 4, pa.list_(pa.string()))})
    rows = I.shard_lists(["content", "key"])(docs).to_pylist()
    assert rows == [
        {"shard": 4, "field": "content", "term": "b", "docs": [-2, 9], "tfs": [1, 2], "lens": [1, 3], "n": 2, "total": 3},
        {"shard": 4, "field": "content", "term": "a", "docs": [9], "tfs": [1], "lens": [3], "n": 1, "total": 1},
    ]
    idf = pa.table({"shard": pa.array([4, 4], pa.int32()), "field": ["content"] * 2, "term": ["a", "b"], "idf": [0.5, 0.25]})
    told = I.with_idf(I.shard_lists(["content"])(docs).drop(["n", "total"]), idf)
    assert dict(zip(told["term"].to_pylist(), told["idf"].to_pylist(), strict=True)) == {"a": 0.5, "b": 0.25}
