"""Queries on tables whose keys are larger than those of the given ones."""

import pytest

from lattis import plans
from tests.compare import differ


@pytest.fixture(scope="module")
def grown(spark, tmp_path_factory):
    """Lines whose parts have numbers beyond a million, so that a later line may have a much smaller one."""
    path = str(tmp_path_factory.mktemp("grown"))
    rows = [(o, (o * 7 + n * 37) % 4 * 700_000 + n, o % 5 * 4 + n % 3, n, 5.0 * n * n, "N", "O" if n % 2 else "F") for o in range(1, 30) for n in range(1, 8)]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_returnflag string, l_linestatus string").coalesce(1).toPandas().to_parquet(f"{path}/lineitem.parquet")
    return path


@pytest.mark.parametrize("name", ["d4_hit_protection", "l15_fit_prefix"])
def test_lines_stay_in_order(spark, grown, name):
    assert differ(spark, grown, plans.QUERIES[name], plans.ORACLE_SQL[name]) == ""


def test_translations_are_dealt_out_before_they_are_sorted(spark):
    """The aggregate of texts sorts the rows of a task: those of one file are dealt out before its first half, not only behind it."""
    from lattis.operators import corpus as C

    said = spark.createDataFrame([("en", i, f"n{i % 2}", f"t{i}") for i in range(6)], "lang string, ord long, key string, text string").coalesce(1)
    docs = spark.createDataFrame([(1, "call", None, "n1", None)], "id int, type string, spec_name string, name string, comment string")
    got = C.localize(docs, said)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(lang" in plan[plan.index("partial_max_by") :].split("hashpartitioning(name")[0] and "REPARTITION_BY_NUM" in plan
    assert [tuple(r) for r in got.collect()] == [(1, "en", 0, "n1", "t5")]


def test_braces_of_long_lines_are_not_found_by_a_pattern(spark):
    """Replacing all that is no brace by a pattern costs a step for each character, most of the time of a run over long lines."""
    from lattis.operators import corpus as C

    rows = [("a", 1, "class A { é{ }"), ("a", 2, "x" * 5000), ("a", 3, None), ("a", 4, "} }"), ("a", 5, "class B")]
    got = C.line_symbols(spark.createDataFrame(rows, "file string, line_no int, line string"))
    assert "regexp_replace" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(tuple(r) for r in got.collect()) == [("a", 1, "class", "A", 0), ("a", 5, "class", "B", -1)]


def test_timers_that_only_free_state_wait(spark, tmp_path):
    """A stream of sessions ends with its rows: no batch that visits every key again; the setting for it is as before."""
    import os

    from lattis.plans import streams as ST
    from lattis.streaming import turns as T

    events = spark.sql("SELECT cast(id % 5 AS string) AS turn, id AS seq, timestamp_seconds(1000000000 + id * id * 900) AS ts, 'click' AS type, '' AS text FROM range(40)")
    before = spark.conf.get(T.EMPTY_BATCHES)
    got = T.run_to_end(T.session_state(ST.stream_of(spark, events, str(tmp_path))), str(tmp_path), "st2", timers=False)
    assert [x for x in os.listdir(tmp_path / "st2" / "state" / "commits") if x.isdigit()] == ["0"] and spark.conf.get(T.EMPTY_BATCHES) == before
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, T.session_reads(events).select("turn", "seq", "hit").collect()))
