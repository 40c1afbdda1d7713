"""A corpus that follows its files equals one built anew, after each refresh, after a restart and after a batch told twice."""

import datetime
import random

from pyspark.sql import functions as F

from lattis.operators.index import build_postings, field_terms
from lattis.streaming import store as S

FIELDS = {"content": False}


def test_follow(spark, tmp_path):
    rng, log, store, state = random.Random(5), f"{tmp_path}/log", f"{tmp_path}/store", f"{tmp_path}/state"
    files, now, schema = {}, datetime.datetime(2024, 1, 1), "path string, mtime timestamp, content string"
    frame = lambda x: spark.createDataFrame([(p, t, c) for p, (t, c) in x.items()], schema)
    assert [df.count() for df in S.read_store(spark, store)] == [0, 0]
    for turn in range(4):
        old = dict(files)
        now += datetime.timedelta(hours=1)
        for p in rng.sample(sorted(files), len(files) // 4):
            del files[p]
        for p in rng.sample(sorted(files), len(files) // 4):
            files[p] = (now, f"changed {turn} {rng.choice(['a a', 'b', ''])}")
        if turn != 2:
            files |= {f"d{rng.randrange(500)}": (now, rng.choice([None, "", "x y x", "Ünï tail"])) for _ in range(40)}
        S.write_changes(frame(old), frame(files), log, turn)
        if turn == 1:
            continue  # two turns in one batch
        S.follow(spark, log, store, state, FIELDS)
        docs, postings = S.read_store(spark, store)
        assert sorted(map(tuple, docs.select("path", "mtime", "content").collect()), key=str) == sorted(((p, *x) for p, x in files.items()), key=str)
        whole = build_postings(frame(files).select(F.col("path").alias("doc_id"), "content"), FIELDS)
        columns = ["doc_id", "field", "term", "len", "tf"]
        assert sorted(map(tuple, postings.select(columns).collect())) == sorted(map(tuple, whole.select(columns).collect()))
    version, batch, _ = S.header(spark, store)
    S.apply_changes(spark.createDataFrame([("d1", "added", "again", now, 9)], S.CHANGE), batch, store, FIELDS)  # told twice
    assert S.header(spark, store)[:2] == (version, batch)
    S.follow(spark, log, store, state, FIELDS)  # nothing new
    assert S.header(spark, store)[:2] == (version, batch)


def test_terms_are_counted_where_the_file_is(spark):
    """A file's terms need no shuffle; a file without terms has no row."""
    files = spark.createDataFrame([(1, "p", "b a B"), (2, "q", None), (3, "r", " . "), (4, "s", "a")], "bucket int, doc_id string, content string")
    rows = field_terms(files, FIELDS, "bucket").mapInArrow(S.file_terms(["content"]), S.FILE_TERMS)
    assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.bucket, r.doc_id, r.field, r.len, sorted(map(tuple, r.terms))) for r in rows.collect()) == [(1, "p", "content", 3, [("a", 1), ("b", 2)]), (4, "s", "content", 1, [("a", 1)])]
