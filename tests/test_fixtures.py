"""Golden rows of the behaviour to match: intents, accounting, graphs, packing, file trees; brute-force walks and joins."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from lattis.functions import text as T
from lattis.operators import corpus as C
from lattis.operators import evaluation as E
from lattis.operators import graph as G
from lattis.operators import logs as L
from lattis.operators import retrieval as R
from lattis.operators import understanding as U
from lattis.sources import files as S


def test_intents(spark):
    rows = [
        ("有哪些武器", "enumeration", None, False, 150), ("list all weapons", "enumeration", None, False, 150), ("What are the specs of HK416?", "specific", None, False, 30), ("G36 vs AK47", "comparison", None, False, 30),
        ("gkw_g36 定义在哪个文件", "source", None, False, 12), ("what does gkw_g36 inherit from", "inheritance", None, False, 12), ("有哪些武器继承自 base_primary", "enumeration", None, False, 150), ("查询 gkw_g36.weapon", "specific", "gkw_g36.weapon", False, 5),
        ("hk416", "specific", None, False, 30), ("which files used base_weapon", "source", None, True, 12), ("G36 使用什么弹药", "specific", None, False, 30),
    ]
    q = F.col("q")
    df = spark.createDataFrame([(r[0],) for r in rows], "q string")
    got = df.select("q", T.intent(q), T.exact_key(q), T.reverse_lookup(q), T.retrieval_breadth(T.intent(q), T.exact_key(q), T.reverse_lookup(q))).collect()
    assert [tuple(r) for r in got] == rows


def test_tokens(spark):
    df = spark.createDataFrame([("",), ("abcd",), ("武器",), ("AK47突击步枪",), ("!?",)], "t string")
    assert [r[0] for r in df.select(T.token_estimate(F.col("t"))).collect()] == [0, 1, 2, 4, 1]
    assert [r[0] for r in df.select(T.tokenize(F.col("t"))).collect()] == [[], ["abcd"], ["武", "器", "武器"], ["AK47", "突", "击", "步", "枪", "突击", "击步", "步枪"], []]
    assert df.select(T.tokenize(F.col("t"), cjk=False)).collect()[3][0] == ["AK47突击步枪"]


def usage(spark, replay, calls, reported=None):
    tokens = spark.createDataFrame([(1, 100, 50, 200, 80, 30, 120, calls)], "turn int, system long, tool_defs long, context long, messages long, reasoning long, answer long, tool_calls long")
    steps = spark.createDataFrame([(1, i, s) for i, s in enumerate(replay)], "turn int, step int, sent long")
    basis = L.turn_basis(tokens, steps)
    return basis, L.resolve_usage(basis, spark.createDataFrame([reported] if reported else [], "turn int, input long, output long, last_input long, reasoning long, cache_read long"))


def test_accounting(spark):
    b = usage(spark, [100, 300, 250], 40)[0].first()
    assert (b.steps, b.in_system, b.in_tool_defs, b.in_context, b.in_messages, b.in_transcript, b.last_transcript) == (3, 300, 150, 600, 240, 350, 150)
    b = usage(spark, [500, 100], 0)[0].first()
    assert (b.in_transcript, b.last_transcript) == (0, 0)
    b = usage(spark, [], 0)[0].first()
    assert (b.steps, b.base_in) == (1, 430)
    u = usage(spark, [500, 900], 20, (1, 9000, 400, 5000, None, 0))[1]
    r = u.first()
    assert (r.prompt, r.completion, r.occupancy, r.estimated) == (9000, 400, 4720, False)
    a = L.attribute_usage(u).first()
    assert (a.system, a.tool_defs, a.context, a.messages, a.transcript, a.reasoning, a.tool_calls, a.answer) == (1429, 714, 2857, 1143, 2857, 71, 47, 282)
    r = usage(spark, [500, 900], 20)[1].first()
    assert (r.prompt, r.completion, r.occupancy, r.estimated) == (1260, 170, 770, True)
    n = spark.createDataFrame([(1, 0, 9000, 400, 650, 120, False, 2), (1, 1, 7000, 300, 10, 50, False, 1), (1, None, 2000, 500, 0, 300, False, 1)], "turn int, i int, prompt long, completion long, base_in long, answer long, estimated boolean, steps long")
    r = L.rollup_candidates(n).first()
    assert (r.prompt, r.completion, r.occupancy) == (18000, 1200, 950)


def test_shedding_and_admission(spark):
    m = spark.createDataFrame([(1, 0, "tool", 10000, 100), (1, 1, "tool", 10000, 100)], "turn int, pos int, role string, tokens int, small int")
    assert [r.shed for r in L.shed_oldest(m, 4096).orderBy("pos").collect()] == [True, False]
    msgs = [(1, i, "ok") for i in range(9)] + [(2, 0, "  "), (2, 1, "x" * 2001), (2, 2, "x" * 2000), (2, 3, None)]
    got = {(r.turn, r.seq): r.status for r in L.steer_admission(spark.createDataFrame(msgs, "turn int, seq int, message string")).collect()}
    assert [got[1, i] for i in (0, 7, 8)] == ["queued", "queued", "too_many"] and [got[2, i] for i in range(4)] == ["empty", "too_long", "queued", "empty"]


def test_duplicates(spark):
    c = spark.createDataFrame([(1, 0, 0, "t", '{"a":1,"b":2}'), (1, 0, 1, "t", '{"b":2,"a":1}'), (1, 1, 0, "t", '{"a": 1, "b": 2}'), (1, 2, 0, "t", '{"a":1}')], "turn int, step int, pos int, tool string, args string")
    assert {(r.step, r.pos): (r.prior, r.escalated) for r in L.duplicate_calls(c).collect()} == {(0, 0): (0, False), (0, 1): (0, False), (1, 0): (2, True), (2, 0): (0, False)}


def test_packing(spark):
    hits = spark.createDataFrame([("q", 1, 60), ("q", 2, 50), ("q", 3, 40)], "qid string, rank int, cost long")
    assert [r.whole for r in R.pack_prefix(hits, 100).orderBy("rank").collect()] == [True, False, False]
    assert [r.whole for r in R.pack_greedy(hits, 100).orderBy("rank").collect()] == [True, False, True]


def test_chain(spark):
    """A chain over two packages, a cycle, a self loop, a dangling target and an ambiguous one."""
    nodes = spark.createDataFrame([("a", "t", "f1", "m1", 1), ("b", "t", "f2", "m1", 2), ("c", "t", "f3", "m2", 3), ("x", "t", "f4", "m2", 4), ("x", "t", "f5", "m3", 5)], "key string, type string, file string, mod string, ord int")
    edges = spark.createDataFrame([("a", "b", "m1", None, 1), ("b", "c", "m1", "m2", 2), ("c", "a", "m2", "m1", 3), ("a", "a", "m1", None, 4), ("b", "gone", "m1", None, 5), ("c", "x", "m4", None, 6), ("b", "x", "m1", None, 7)], "from string, to string, mod string, to_mod string, ord int").withColumn("rel", F.lit("extends"))
    got = G.ancestor_chain(spark.createDataFrame([(1, "A", "m1")], "rid int, key string, mod string"), G.edge_targets(edges, nodes)).collect()
    assert {(r.key, r.mod, r.depth, r.ambiguous_in) for r in got} == {("a", "m1", 0, None), ("b", "m1", 1, None), ("c", "m2", 2, None), ("gone", "m1", 2, None), ("x", None, 2, "m2,m3")}


def test_evaluation_above_one(spark):
    cases = spark.createDataFrame([("1", "q", "c", ["m4"], None), ("2", "q", "c", [], None)], "id string, query string, category string, expected array<string>, expected_type string")
    hits = spark.createDataFrame([("1", 1, "m4", "w"), ("1", 2, "m4.weapon", "w")], "id string, rank int, key string, type string")
    got = {r.id: r for r in E.metrics(cases, hits).collect()}
    assert got["1"].ndcg_10 > 1.6 and got["2"].precision_5 == 1.0 and got["2"].recall_1 == 1.0


def test_history(spark):
    talk = [(1, 0, "user", "first question"), (1, 1, "assistant", "see `a.weapon`"), (1, 2, "user", "x" * 101), (1, 3, "user", "步枪"), (1, 4, "user", "last")]
    got = {r.turn: r.search_query for r in U.history_query(spark.createDataFrame(talk, "conv_id int, turn int, role string, text string")).collect()}
    assert got[0] == "first question" and got[4] == "x" * 80 + " 步枪 a.weapon last" and got[3] == "first question " + "x" * 80 + " a.weapon 步枪 weapon gun rifle"


def test_labels(spark):
    lines = ['// first', '{"a",1},', '', '{"b",2},', '// second', '', '{"c",3},', '{"666",-1},', '//', '{"d",4},']
    got = C.labelled_entries(spark.createDataFrame([("f", i, x) for i, x in enumerate(lines)], "file string, line_no int, line string")).orderBy("line_no").collect()
    assert [(r.key, r.label) for r in got] == [("a", "first"), ("b", ""), ("c", "second"), ("d", "second")]


def test_file_tree(spark, tmp_path):
    tree = {
        "one/package_config.xml": '<package name=" One "/>', "one/w/a.weapon": '<weapon key="a" class="x"><projectile file="p.projectile"/></weapon>', "one/models/m.xml": "<x/>", "one/read.md": "no",
        "one/nested/package_config.xml": "<package/>", "two/package_config.xml": "<package />", "two/maps/m.xml": "<x/>", "two/bad.xml": "<calls><call key=", "two/l.text_lines": "words", "three/z.as": "class Z {}",
    }
    for path, text in tree.items():
        os.makedirs(tmp_path / os.path.dirname(path), exist_ok=True)
        (tmp_path / path).write_text(text)
    m = S.file_manifest(spark, str(tmp_path))
    assert {r.path for r in m.select("path").collect()} == {"one/package_config.xml", "one/w/a.weapon", "one/nested/package_config.xml", "two/package_config.xml", "two/bad.xml", "two/l.text_lines", "three/z.as"}
    packages = S.discover_packages(m, "root")
    assert {tuple(r) for r in packages.collect()} == {("one", "One", "one"), ("two", "two", "two")}
    assert {r.path: r.package for r in S.assign_package(m.select("path"), packages).collect()}["one/nested/package_config.xml"] == "one"
    assert S.discover_packages(m.where("path = 'three/z.as'"), "root").first().name == "root"
    files = m.select("path", F.decode("content", "UTF-8").alias("content")).where("path like '%.weapon' or path like '%bad.xml'")
    assert {(r.type, r.key) for r in S.xml_records(files).collect()} == {("weapon", "a"), ("projectile", "a.weapon")}
    with pytest.raises(ValueError):
        C.restrict_packages(m.withColumn("package", F.lit("one")), ["none"])


def test_paths_and_markdown(spark):
    """Golden rows: parent steps fold one by one; stars inside emphasised text."""
    from pyspark.sql import functions as F

    from lattis.functions.text import strip_markdown
    from lattis.operators.graph import tidy

    paths = {"a/b/../../x": "x", "a/./b/../c.xml": "a/c.xml", "../x": "../x", "a/../../x": "../x", "a//b": "a/b", "x": "x", "": ""}
    got = {r.p: r.t for r in spark.createDataFrame([(p,) for p in paths], "p string").select("p", tidy(F.col("p")).alias("t")).collect()}
    assert got == paths
    texts = {"*a* and *b*": "a and b", "*a ** b* c": "a * b* c", "**bold** *it*": "bold it", "5 * 3 * 2": "5  3  2"}
    got = {r.p: r.t for r in spark.createDataFrame([(p,) for p in texts], "p string").select("p", strip_markdown(F.col("p")).alias("t")).collect()}
    assert got == texts


def test_names_by_part_of_key(spark):
    from lattis.operators.retrieval import resolve_names

    names = spark.createDataFrame([(1, "smg_kp31.weapon", "submachinegun", ["submachinegun"], 1, 1), (2, "ab.weapon", "rifle", ["rifle"], 1, 2)], "id long, key string, norm string, parts array<string>, kind_rank int, ord long")
    asked = spark.createDataFrame([(1, "submachine"), (2, "KP31.w"), (3, "b.w"), (4, "nothing"), (5, ""), (6, "the rifle here")], "rid long, name string")
    assert sorted(map(tuple, resolve_names(asked, names).collect())) == [(1, 1, 3), (2, 1, 5), (3, 2, 5), (6, 2, 3)]


def walk(seeds, have, spawns, visited, chain, depth=4, cap=20):
    """The nodes of a breadth-first walk, level by level."""
    level, n = list(dict.fromkeys(seeds)), 1
    while level and len(chain) < cap:
        after = []
        for key in level:
            if key in visited or len(chain) >= cap:
                continue
            visited.add(key)
            chain.append((key, n, key not in have))
            if key in have and n < depth:
                after += spawns(key)
        level, n = after, n + 1


def test_damage_chain_brute_force(spark):
    from lattis.plans.facts import j2_damage_chain

    sf = "/root/testdata/sf0.001"
    parts = {r[0] for r in spark.read.parquet(f"{sf}/part.parquet").select("p_partkey").collect()}
    notify = {k: k % 11 for k in parts if k % 3 == 0}
    effects = {k - 1: [k * 5, k + 50] for k in parts if k <= 8}
    want = []
    for (c,) in spark.read.parquet(f"{sf}/customer.parquet").select("c_custkey").collect():
        chain, visited = [], set()
        spawned = lambda k: [k * 2, k * 3 + 1]
        walk([c % 97 + 1, c % 41 + 1], parts, spawned, visited, chain)
        told = dict.fromkeys(notify[k] for k, _, _ in chain if k in notify)
        walk([x for t in told for x in effects.get(t, [])], parts, spawned, visited, chain)
        for pos, (k, n, missing) in enumerate(chain):
            effect = f"effect {notify[k] + 1}" if notify.get(k) in effects else None
            want.append((c, pos, k, n, missing, notify.get(k), effect, "projectile has no record" if missing else "notified key has no effect" if k in notify and not effect else None))
    got = [tuple(r) for r in j2_damage_chain(spark, sf).select("skill", "pos", "projectile", "depth", "unresolved", "notify", "effect", "note").collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_holding(spark):
    docs = [(1, "a bb ccc dddd e"), (2, "xa bb ccc ddddx"), (3, "bb"), (4, ""), (5, "a  bb"), (6, None)]
    items = [(1, "a bb ccc dddd"), (2, "bb"), (3, "b c"), (4, ""), (5, " bb "), (6, "a bb x"), (7, None), (8, "a  b"), (9, "bb ccc dd")]
    got = R.holding(spark.createDataFrame(items, "item int, s string"), spark.createDataFrame(docs, "doc int, t string"))
    assert sorted(map(tuple, got.collect())) == sorted((i, d) for i, s in items for d, t in docs if s and t and s in t)
    assert R.holding(spark.createDataFrame([], "item int, s string"), spark.createDataFrame(docs, "doc int, t string")).count() == 0


def test_near_terms(spark):
    import itertools
    import random

    rng = random.Random(3)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(1, 14))) for _ in range(150)})

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    want = {(a, b, edits(a, b)) for a, b in itertools.product(words, words) if a != b and edits(a, b) <= int(len(a) * 0.2 + 0.5)}
    got = R.near_terms(spark.createDataFrame([(w,) for w in words], "term string"), spark.createDataFrame([(w,) for w in words], "expanded string"))
    assert want and {tuple(r) for r in got.collect()} == want
