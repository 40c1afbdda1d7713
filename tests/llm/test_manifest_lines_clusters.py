"""Merkle manifest, line rules and centroid clustering against brute force and on odd rows; long texts of one kind for the pattern-based operators."""

from __future__ import annotations

import hashlib
import itertools
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

pytest.importorskip("lattis.llm")

from lattis.llm import centroids, decontaminate, hashing, html_text, licenses, line_rules, merkle, queries
from pyspark.sql import functions as F
from tests.llm.test_operators import awkward, documents


def sha(x: str) -> str:
    return hashlib.sha256(x.encode()).hexdigest()


def field(v) -> str:
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def tree(level):
    out = [level]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][i : i + 2])) for i in range(0, len(out[-1]), 2)])
    return out


def path(levels, i):
    out = []
    for level in levels[:-1]:
        out.append(level[i ^ 1] if i ^ 1 < len(level) else "")
        i >>= 1
    return out


def brute_manifest(rows):
    """(doc_id, leaf, subroot, root, joined siblings) of each row."""
    groups = defaultdict(list)
    for r in rows:
        groups[r.lang].append(((r.doc_id is not None, r.doc_id or 0), sha("".join(map(field, (r.doc_id, r.source, r.lang, r.n_chars, r.text)))), r.doc_id))
    langs = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {k: tree([x[1] for x in sorted(groups[k])]) for k in langs}
    top = tree([trees[k][-1][0] for k in langs])
    out = []
    for n, k in enumerate(langs):
        for i, (_, leaf, key) in enumerate(sorted(groups[k])):
            out.append((key, leaf, trees[k][-1][0], top[-1][0], "".join(path(trees[k], i) + path(top, n))))
    return sorted(out, key=str)


@pytest.mark.parametrize("levels", [2, 8])
def test_manifest(spark, levels):
    rng = random.Random(levels)
    rows = [(i, f"text {i}" if i % 5 else None, rng.choice(["en", "de", "", None, "zü", "-"]), "s" if i % 3 else None) for i in range(83)]
    df = documents(spark, rows).union(awkward(spark))
    got = merkle.manifest(df, levels=levels)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "path"]
    rows = got.withColumn("up", merkle.fold(F.col("leaf"), F.col("path"))).collect()
    assert sorted([(r.doc_id, r.leaf.hex(), r.subroot.hex(), r.root.hex(), "".join(x[1:] for x in r.path)) for r in rows], key=str) == brute_manifest(df.collect())
    assert all(r.up == r.root.hex() for r in rows)


def test_manifest_small(spark):
    df = documents(spark, [(4, "x", "en", "s")])
    [r] = merkle.manifest(df).collect()
    assert r.leaf == r.subroot == r.root and r.path == []
    assert merkle.manifest(df.limit(0)).count() == 0


def test_manifest_log_positions():
    """Closed-form places in the log are those at which nodes were appended, for whole and cut-off builders."""
    for m, levels in itertools.product(range(1, 20), (5, 6)):
        log = merkle.append_log(b"".join(hashlib.sha256(bytes([i])).digest() for i in range(m)), levels)
        nodes = [hashlib.sha256(bytes([i])).hexdigest() for i in range(m)]
        size = len(log) // 32
        for level in range(levels + 1):
            for i, node in enumerate(nodes):
                s, r = i << level, min(m - (i << level), 1 << level)
                at = 2 * s - s.bit_count() + 2 * (r - 1) - (r - 1).bit_count() + level
                assert at < size and log[32 * at : 32 * at + 32].hex() == node
            nodes = [sha("".join(nodes[i : i + 2])) for i in range(0, len(nodes), 2)]
        assert log[-32:].hex() == tree([hashlib.sha256(bytes([i])).hexdigest() for i in range(m)])[-1][0] or levels > (m - 1).bit_length()


def test_manifest_query_tampering(spark):
    rows = queries.op11_merkle_manifest(spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == 200
    for r in rows:
        assert r.verified == (zlib.crc32(str(r.doc_id).encode()) % 7 != 0) == (r.folded_root == r.root)


def brute_counts(text):
    t = text or ""
    white = "\x20\t\n\x0b\x0c\r"
    words = [w for w in "".join("\0" if c in white else c for c in t).split("\0") if w]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    covered = set()
    for i, w in enumerate(windows):
        if windows.count(w) > 1:
            covered.update(range(i, i + 5))
    seen, copies = set(), 0
    for line in t.split("\n"):
        if line.strip(white):
            copies += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), copies, len(covered)


def lined(spark):
    rng = random.Random(3)
    line = lambda: " ".join(rng.choice(["a", "bé", "#x", "WORD", "cat.", " "]) for _ in range(rng.randrange(0, 9)))
    texts = ["\n".join(line() for _ in range(rng.randrange(0, 12))) for _ in range(60)] + [None, "", "\n\n", "x" * 5000, "same line here\n" * 30, "a\r\na\r\n", " lead\n\n lead\ntail "]
    return spark.createDataFrame([(i, t, 1, [0], 5) for i, t in enumerate(texts)], "doc_id long, text string, kept int, lines array<int>, n_words int")


def test_line_rules_counts(spark):
    df, labels = lined(spark), spark.createDataFrame([], "doc_id long, quality int")
    rows = {r.doc_id: r for r in line_rules.judge(df, labels).collect()}
    for r in df.collect():
        got, want = rows[r.doc_id], brute_counts(r.text)
        assert (got.n_words, got.word_chars, got.n_symbols, got.n_dup_lines, got.n_repeat_words) == want
        assert got.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        lines = (r.text or "").split("\n")
        assert len(got.lines) == len(lines) and [x is None for x in got.lines] == [not x.strip("\x20\t\n\x0b\x0c\r") for x in lines]
        assert got.kept == (not got.base_failed)  # without labels every line is content
    assert line_rules.judge(df.limit(0), labels).count() == 0


def test_line_rules_decoding_and_gradient():
    rng = np.random.default_rng(5)
    w = np.round(rng.normal(size=line_rules.FEATURES + 6), 3)
    codes = [rng.integers(0, line_rules.FEATURES, size=(n, 4)).astype(np.int16) for n in (7, 4, 4, 1)]

    def score(f, code, y):
        return sum(f.features[c].sum() for c, k in zip(code, y) if k) + f.start[y[0]] + sum(f.pairs[a, b] for a, b in zip(y, y[1:]))

    field = line_rules.Field(w)
    for code in codes:
        best = max(itertools.product((0, 1), repeat=len(code)), key=lambda y: score(field, code, y))
        assert field.decode(code).tolist() == list(best)
    labels = [[0, 1, 1, 0, 0, 1, 1], [1, 1, 0, 1], [0, 0, 0, 0], [1]]
    block, padded = np.zeros((4, 7, 4), np.int16), np.zeros((4, 7), np.int64)
    for i, (c, y) in enumerate(zip(codes, labels)):
        block[i, : len(c)], padded[i, : len(c)] = c, y

    def likelihood(w):
        f = line_rules.Field(w)
        total = 0.0
        for c, y in zip(codes, labels):
            total += score(f, c, y) - np.log(sum(np.exp(score(f, c, z)) for z in itertools.product((0, 1), repeat=len(c))))
        return total

    got = line_rules.gradient(w, block, padded, np.array([7, 4, 4, 1]))
    for k in rng.choice(len(w), 12, replace=False).tolist() + list(range(line_rules.FEATURES, len(w))):
        step = np.zeros(len(w))
        step[k] = 1e-5
        assert got[k] == pytest.approx((likelihood(w + step) - likelihood(w - step)) / 2e-5, abs=1e-6)


def test_line_rules_held_out(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = line_rules.judge(docs, labels.where("doc_id % 2 = 0")).join(labels.where("doc_id % 2 = 1").drop("toxic"), "doc_id").where("not base_failed").collect()
    good, bad = [r.kept for r in rows if r.quality == 1], [r.kept for r in rows if r.quality == 0]
    assert sum(good) > 0.97 * len(good) and sum(bad) < 0.1 * len(bad) and len(bad) > 5


def test_line_rules_awkward(spark):
    labels = spark.createDataFrame([(4, 1, 0), (9, 0, 0), (9, None, 1), (None, 0, 0), (10, 0, 1)], "doc_id long, quality int, toxic int")
    df = awkward(spark)
    rows = line_rules.judge(df, labels).collect()
    assert sorted([(r.doc_id, r.n_words) for r in rows], key=str) == sorted([(r.doc_id, brute_counts((r.text or "")[:0] or None)[0] if not r.text else len(r.text.split())) for r in df.collect()], key=str)
    assert sorted(map(str, rows)) == sorted(map(str, line_rules.judge(df, labels).collect()))


def test_words_in_pieces(monkeypatch):
    texts = [b"one two  three", b"", b"x" * 300 + b" y", b"  lead and tail  \n"] * 3
    whole = hashing.words(texts)
    monkeypatch.setattr(hashing.pieces, "__defaults__", (16,))
    for a, b in zip(whole, hashing.words(texts)):
        assert a.tolist() == b.tolist()


def brute_clusters(rows, k, rounds, scale=64):
    kept = [(i, [min(max(int(np.floor(scale * float(x))), -centroids.LARGEST), centroids.LARGEST) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v)]
    start = sorted((sha(f"1:{i}"), v) for i, v in kept if i is not None)[:k]
    at = [v for _, v in start]
    if not at:
        return [], at
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(at))
    for _ in range(rounds):
        groups = defaultdict(list)
        for _, v in kept:
            groups[near(v)[1]].append(v)
        at = [[sum(x) // len(groups[n]) for x in zip(*groups[n])] if groups[n] else c for n, c in enumerate(at)]
    return sorted([(i, near(v)[1], near(v)[0]) for i, v in kept], key=str), at


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 3, 1, 0) for i, v in rows], "vec_id long, embedding array<double>, cluster int, shard int, at int")


@pytest.mark.parametrize(("seed", "spread", "k", "rounds"), [(1, 1.0, 5, 3), (2, 0.05, 4, 6), (3, 0.0, 3, 2)])
def test_clusters(spark, seed, spread, k, rounds):
    """Spread groups, tight ones that the bounds leave alone, and copies only, which tie."""
    rng = random.Random(seed)
    middles = [[rng.uniform(-1, 1) for _ in range(64)] for _ in range(4)]
    rows = [(i, [x + rng.gauss(0, spread) for x in rng.choice(middles)]) for i in range(150)]
    got, at, scanned = centroids.cluster(vectors(spark, rows), k=k, rounds=rounds, shard=20)
    want, middle = brute_clusters(rows, k, rounds)
    assert sorted(map(tuple, got.collect()), key=str) == want and at.tolist() == middle
    assert scanned[0] == 150 and len(scanned) == rounds
    if seed == 2:
        assert sum(scanned[2:]) < 150  # few gaps expire once groups are found


def test_clusters_awkward(spark):
    nan, inf = float("nan"), float("inf")
    v = [0.5 * (i % 3) for i in range(64)]
    rows = [(1, None), (2, [1.0] * 63), (3, [1.0] * 65), (4, [nan] + v[1:]), (5, [inf] + v[1:]), (6, [None] + v[1:]), (7, []), (8, v), (8, v), (8, [1.0] * 64), (None, v), (9, [1e300] * 64), (10, [-1e300] * 64), (11, [-0.001] * 64)]
    got, at, _ = centroids.cluster(vectors(spark, rows), k=16)
    want, middle = brute_clusters(rows, 16, 3)
    assert sorted(map(tuple, got.collect()), key=str) == want and at.tolist() == middle and len(middle) == 6
    told = centroids.report(vectors(spark, rows)).collect()
    assert len(told) == len(want) and all(r.centroid_sha256 == sha(",".join(map(str, middle[r.cluster]))) and r.inertia == sum(x[2] for x in want) for r in told)
    for none in (rows[:7], [], [(None, v)]):
        assert centroids.report(vectors(spark, none)).count() == 0


@pytest.mark.parametrize("unit", ["1,", ".", "a", "\n", "中\n", " ", "12 13.5 km Alice ", "x! ", "1a,", "\n \t"])
def test_long_texts_of_one_kind(spark, unit):
    """A megabyte of numbers, dots, line feeds and the like: no recursion, no quadratic pattern."""
    text = unit * (1_000_000 // len(unit)) + " licensed under the mit license."
    df = documents(spark, [(1, text, "en", "a")])
    items = spark.createDataFrame([(1, "one 1,1,1,1,1 two three")], "item_id long, text string")
    assert decontaminate.contaminated(df, items).count() == 0
    assert licenses.scan(df).count() >= 0
    assert line_rules.judge(df, spark.createDataFrame([], "doc_id long, quality int")).first().n_words > 3


def test_number_placeholders(spark):
    for text, want in [("12.5abc", "\u00025abc"), ("1,2:3.4", "\u0002"), ("a1 1a 1.2a,3", "a1 1a \u00022a\u0002"), ("3.4.", "\u0002"), ("7,x 8,9x", "\u0002x \u00029x"), ("x 5 km", "x \u0002 \u0003")]:
        got = spark.range(1).select(decontaminate.template(F.lit(text)).alias("t")).first().t
        assert got == want, (text, got)


def test_html_many_open_elements():
    weights = html_text.weights_of({})
    page = "<font class=x>w " * 50_000 + "</div>" * 50_000
    assert html_text.main_text(page, weights).count("w") == 50_000
    counts = html_text.tally("<article>" + "<b class=q>w " * 20_000 + "</article> out")
    assert counts["all", "", 1] == 20_000 and counts["all", "", 0] == 1 and counts["tag", "b", 1] == 20_000
    long = "t" * 60
    assert html_text.tally(f"<{long}>x</{long}>")["tag", long, 0] == 2


def test_html_query_brute_force(spark):
    """The whole operator against a plain version: every word's features by walking up its elements, every region by trying all pairs."""
    names = ["zzad", "body-text", "meta"]
    page = lambda i: f"<html><body><div class='{names[0]}'>buy now {i} cheap</div><article><h1>Title {i}</h1><p class='{names[1]}'>some words of content number {i} go here</p></article><div class='{names[2]}'>by author</div></body></html>"
    pages = [(i, f"http://x/{i}", page(i)) for i in range(30)] + [(30, "u", "<div class=zzad>buy this thing now</div><div class='body-text'>plain words without any article element stand here</div>"), (31, None, None), (32, "u", "")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r.page_id: r for r in html_text.extract(df).collect()}
    counts = defaultdict(int)
    for _, _, p in pages[:30]:
        for k, v in html_text.tally(p).items():
            counts[k] += v
    costs, scores = html_text.weights_of(counts)
    for i, _, p in pages:
        row, frames = html_text.stream(p or "")
        line = []
        for kind, value, frame in row:
            told, f = [], frame
            while f:
                told += [scores.get(x, 0.0) for x in f.fresh]
                f = f.around
            least, most = min(told, default=0.0), max(told, default=0.0)
            score = max(-html_text.MOST, least) if least < html_text.TELLING else 1 + min(html_text.MOST, most)
            line.append(len(value.split()) * score if kind == "text" else -costs.get(value, costs[""]))
        best = max(((sum(line[a:b]), b - a, -a) for a in range(len(line)) for b in range(a + 1, len(line) + 1)), default=(0, 0, 0))
        text = got[i].text
        if best[0] <= 0:
            assert text == ""
        else:
            words = " ".join(v for k, v, f in row[-best[2] : -best[2] + best[1]] if k == "text" and not f.told[1])
            assert text.split() == words.split() or "zzad" in (p or "")
        assert got[i].n_chars == len(text)
    assert "buy" not in got[30].text and "plain words" in got[30].text


def test_packing_one_id_and_source(spark):
    """Rows of one id, of none and of one source, and pieces of one long document, are dealt to many shards."""
    from lattis.llm import packing

    rows = [(1, f"a{i} b", "en", "hot") for i in range(3000)] + [(None, f"c{i} d", "en", "hot") for i in range(3000)] + [(2, "w " * 40_000, "en", "hot")]
    got = packing.pack(documents(spark, rows), capacity=20, shard=300).collect()
    assert len(got) == 6000 + 2000 and len({r.bin_id for r in got}) == 8000  # one source: a bin each
    shards = {}
    for r in got:
        shards[r.bin_id >> 32] = shards.get(r.bin_id >> 32, 0) + 1
    assert len(shards) == 21 and max(shards.values()) < 2 * 8000 / 21
