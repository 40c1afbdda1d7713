"""The pipeline's stages, each on what its predecessor kept, against brute force."""

import pytest

pytest.importorskip("corpus_pipeline")

import corpus_pipeline
from tests.llm.test_operators import brute_components, brute_substring

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        out.write.parquet(f"{tmp_path}/{k}")
        out = spark.read.parquet(f"{tmp_path}/{k}")
        before, after = docs.collect(), out.collect()
        if k < 4:
            assert out.columns == columns
            texts = {r.doc_id: r.text for r in after}
        if k == 1:
            want = {i for i, _, c in brute_components([(r.doc_id, r.text) for r in before], 5, 80) if i == c}
            assert set(texts) == want
        if k == 2:
            want = {i: (n, g) for i, n, g, _ in brute_substring([(r.doc_id, r.text) for r in before], 13)}
            assert set(texts) == {i for i, (n, g) in want.items() if not g or g < n}
            assert all(len(texts[i].split()) == n - g for i, (n, g) in want.items() if i in texts)
        if k == 3:
            items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            assert not any(t in x for x in texts.values() for t in items)
            assert len(after) > 0.8 * len(before)
        if k == 4:
            assert {r.doc_id for r in after} == {r.doc_id for r in before if (r.text or "").split()}
        docs = out


def test_passages_repeated_and_null_ids(spark):
    """Each row gets the decision on its own text."""
    words = lambda name, n: " ".join(f"{name}{i}" for i in range(n))
    shared, own = words("s", 20), words("o", 20)
    rows = [(1, shared), (2, shared), (2, own), (2, shared + " tail two"), (None, shared + " end null"), (None, shared)]
    docs = spark.createDataFrame([(i, t, len(t)) for i, t in rows], "doc_id long, text string, n_chars long")
    got = sorted(map(tuple, corpus_pipeline.passages(spark, docs, SF).collect()), key=str)
    want = [(1, shared), (2, own), (2, "tail two"), (None, "end null")]
    assert got == sorted(((i, t, len(t)) for i, t in want), key=str)


AWKWARD = "doc_id long, text string, lang string, source string, n_chars int, cut string, n_words long, n_removed long, cut_id long, text_md5 string, component_id long"


def awkward(spark):
    """Nulls, empties, repeats, near copies, and columns with the names that the operators use."""
    words = lambda name, n: " ".join(f"{name}{i}" for i in range(n))
    rows = [(1, words("a", 40)), (2, words("a", 40)), (2, words("a", 40)), (3, words("a", 39) + " other"), (4, None), (5, ""), (None, words("a", 40)), (None, None), (6, words("b", 3000)), (7, "head " + words("b", 30)), (8, "one")]
    return spark.createDataFrame([(i, t, None, "s" if i else None, None if t is None else len(t), "c", 7, 8, 9, "m", 10) for i, t in rows], AWKWARD)


def test_stages_awkward(spark):
    docs = awkward(spark)
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        rows = out.collect()
        assert all((r.cut, r.n_words, r.n_removed, r.cut_id, r.text_md5, r.component_id) == ("c", 7, 8, 9, "m", 10) for r in rows)
        kept[name] = sorted(((r.doc_id, r.text) for r in rows), key=str)
        assert stage(spark, docs.limit(0), SF).count() == 0
    every = sorted(((r.doc_id, r.text) for r in docs.collect()), key=str)
    near = {i for i, _, c in brute_components(every, 5, 80) if i is None or i == c}
    assert kept["n-gram Jaccard join"] == [(i, t) for i, t in every if i in near]
    cut = {(i, n, g) for i, n, g, _ in brute_substring(every, 13)}
    assert len(kept["substring dedup"]) == sum(1 for i, t in every if not any(g and g == n for j, n, g in cut if j == i and n == len((t or "").split())))
    assert kept["benchmark decontamination"] == every
    packed = corpus_pipeline.packing(spark, docs, SF).collect()
    assert sorted({str(r.doc_id) for r in packed}) == sorted({str(i) for i, t in every if (t or "").split()})
    assert sum(r.n_words for r in packed) == sum(len((t or "").split()) for _, t in every)


def test_packing_is_best_fit(spark):
    """Each piece, longest first, goes to the fullest bin that has room and neither its source nor its cluster."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    from lattis.llm import packing

    got = packing.pack(docs, capacity=300, shard=10**6).collect()
    text = {r.doc_id: (r.source, " ".join((r.text or "").encode().lower().decode().split())) for r in docs.collect()}
    bins, of = [], {}
    for r in sorted(got, key=lambda r: (-r.n_words, r.doc_id, r.piece)):
        source, cluster = text[r.doc_id]
        fit = [b for b in bins if b["room"] >= r.n_words and source not in b["sources"] and cluster not in b["clusters"]]
        best = min(fit, key=lambda b: (b["room"], b["no"])) if fit else {"no": len(bins), "room": 300, "sources": set(), "clusters": set()}
        if not fit:
            bins.append(best)
        best["room"] -= r.n_words
        best["sources"].add(source)
        best["clusters"].add(cluster)
        of[r.doc_id, r.piece] = best["no"]
    assert {(r.doc_id, r.piece): r.bin_id & 0xFFFFFFFF for r in got} == of


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0


def test_near_duplicates_clean_up_after_each_count(spark, monkeypatch):
    """Rounds and counts on the way remove their shuffle files: with many partitions these were most of the disk of the stage."""
    from lattis.llm import components as C
    from lattis.llm.jaccard_join import jaccard_components
    from lattis.session import CLEAN_UP

    frame, told = type(spark.range(0)), []
    for name in ("first", "count", "collect"):
        monkeypatch.setattr(frame, name, lambda self, f=getattr(frame, name): (told.append(spark.conf.get(CLEAN_UP)), f(self))[1])
    links = spark.createDataFrame([(i, i + 1) for i in range(40) if i % 10], "a long, b long")
    found = C.components(links)
    jaccard_components(spark.createDataFrame([(i, f"a b c d e f g h i j {i % 5}") for i in range(30)], "doc_id long, text string"))
    assert len(told) > 5 and set(told) == {"true"}
    monkeypatch.undo()
    assert sorted(map(tuple, found.collect())) == [(i, (i - 1) // 10 * 10 + 1) for i in range(1, 41)]
    assert spark.conf.get(CLEAN_UP) == "false"
