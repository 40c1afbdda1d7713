"""The ten operators against brute force, and on nulls, empty and long texts, ties, repeated rows, empty tables and extra columns."""

from __future__ import annotations

import hashlib
import math
import random
import zlib

import numpy as np
import pytest

pytest.importorskip("lattis.llm")

from lattis.llm import decontaminate, html_text, jaccard_join, language_id, licenses, packing, quality, queries, substring_dedup, topk_search, url_filter

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long, shard int, docs string, pos int"


def documents(spark, rows):
    """rows: (doc_id, text, lang, source); with extra columns of clashing names."""
    return spark.createDataFrame([(i, t, lang, s, None if t is None else len(t), 7, "x", 3) for i, t, lang, s in rows], DOC)


def awkward(spark):
    long = " ".join(f"w{i % 977}" for i in range(30_000))
    rows = [(1, None, None, None), (2, "", "en", "a"), (3, "  \n\t ", "fr", None), (4, long, "en", "a"), (5, long, "en", "a"), (5, long, "en", "a"), (None, long, "en", "b"), (6, "one", "en", "b"), (7, "one", "de", "b"), (8, "ünï \U0001f600 cödé é", "fr", "c"), (9, "a " * 40, "en", "c"), (10, "a " * 25 + "b", None, "c")]
    return documents(spark, rows)


def brute_substring(rows, window):
    first = {}
    split = [(i, (t or "").encode().split()) for i, t in rows]
    for i, w in split:
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            if i is not None:
                first[key] = min(first.get(key, i), i)
    out = []
    for i, w in split:
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            low = first.get(tuple(w[k : k + window]))
            if low is not None and (i is None or low < i):
                gone[k : k + window] = [True] * window
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", range(3))
def test_substring_dedup_small_alphabets(spark, seed):
    """Few words make long runs and periodic texts, where a local parse is hardest."""
    rng = random.Random(seed)
    pool = [" ".join(rng.choice(["a", "b", "c"][: 1 + rng.randrange(3)]) for _ in range(rng.randrange(5, 60))) for _ in range(8)]
    rows = [(i, " ".join(rng.choice(pool) for _ in range(rng.randrange(0, 4))) or None) for i in range(50)]
    got = substring_dedup.substring_dedup(documents(spark, [(i, t, "en", "s") for i, t in rows]))
    assert sorted(map(tuple, got.collect()), key=str) == brute_substring(rows, 13)


def test_substring_dedup_awkward(spark):
    df = awkward(spark)
    got = substring_dedup.substring_dedup(df)
    assert sorted(map(tuple, got.collect()), key=str) == brute_substring([(r.doc_id, r.text) for r in df.collect()], 13)
    text = {(r.doc_id, r.n_removed): r.text for r in substring_dedup.substring_dedup(df, with_text=True).collect()}
    assert text[1, 0] is None and text[3, 0] == "  \n\t " and text[None, 30_000] == ""
    assert substring_dedup.substring_dedup(df.limit(0)).count() == 0


def test_substring_dedup_negative_ids(spark):
    """The smaller doc_id keeps its words, below zero too."""
    text = " ".join(f"w{i}" for i in range(20))
    rows = [(3, text), (-5, text), (-7, text + " tail"), (0, "head " + text), (-(1 << 62), "short")]
    got = substring_dedup.substring_dedup(documents(spark, [(i, t, "en", "s") for i, t in rows]))
    assert sorted(map(tuple, got.collect()), key=str) == brute_substring(rows, 13)


def brute_components(rows, n, percent):
    low = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
    sets = []
    for i, t in rows:
        w = (t or "").encode().translate(low).split()
        sets.append((i, {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()))
    up = {i: i for i, _ in sets if i is not None}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for x, (i, a) in enumerate(sets):
        for j, b in sets[x + 1 :]:
            both = len(a & b)
            if None not in (i, j) and a and b and 100 * both >= percent * (len(a) + len(b) - both):
                p, q = find(i), find(j)
                up[max(p, q)] = min(p, q)
    return sorted(((i, len(s), None if i is None else find(i)) for i, s in sets), key=str)


def near_copies(seed, n=60):
    """Groups of near copies around the threshold, chains among them, sharing one frequent passage."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(400)}"
    passage = [word() for _ in range(15)]
    base = [[word() for _ in range(rng.randrange(20, 60))] + passage for _ in range(4)]
    rows = []
    for i in range(n):
        w = list(rng.choice(base))
        for _ in range(rng.randrange(0, 4)):
            w[rng.randrange(len(w))] = word().upper()
        rows.append((i * 3, " ".join(w)))
    return rows


@pytest.mark.parametrize(("block", "percent", "n"), [(100, 90, 3), (4, 90, 3), (4, 80, 5), (3, 60, 2)])
def test_jaccard_components(spark, monkeypatch, block, percent, n):
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    rows = near_copies(block + percent)
    got = jaccard_join.jaccard_components(documents(spark, [(i, t, "en", "s") for i, t in rows]), n, percent)
    assert sorted(map(tuple, got.collect()), key=str) == brute_components(rows, n, percent)


def test_jaccard_negative_ids(spark):
    rows = [(i - 90, t) for i, t in near_copies(11, 40)]
    got = jaccard_join.jaccard_components(documents(spark, [(i, t, "en", "s") for i, t in rows]), 3, 80)
    assert sorted(map(tuple, got.collect()), key=str) == brute_components(rows, 3, 80)


def test_jaccard_shared_passages(spark, monkeypatch):
    """Passages that most documents share, before and behind what is their own, among copies of them."""
    monkeypatch.setattr(jaccard_join, "BLOCK", 5)
    rng = random.Random(5)
    head, tail = ([f"{x}{i}" for i in range(8)] for x in "ht")
    base = [head + [f"w{rng.randrange(60)}" for _ in range(rng.randrange(0, 60))] + tail for _ in range(60)]
    rows = []
    for i, w in enumerate(base + rng.choices(base, k=30)):
        w = list(w)
        if i >= len(base):
            w[rng.randrange(len(w))] = "x"
        rows.append((i, " ".join(w)))
    for n, percent in ((3, 80), (2, 60)):
        got = jaccard_join.jaccard_components(documents(spark, [(i, t, "en", "s") for i, t in rows]), n, percent)
        assert sorted(map(tuple, got.collect()), key=str) == brute_components(rows, n, percent)


def test_jaccard_large_ids(spark):
    """Ids that floats can't hold."""
    rows = [((1 << 62) - 1 - i, t) for i, t in near_copies(7, 30)]
    got = jaccard_join.jaccard_components(documents(spark, [(i, t, "en", "s") for i, t in rows]), 3, 80)
    want = brute_components(rows, 3, 80)
    assert len({c for _, _, c in want}) < len({t for _, t in rows})
    assert sorted(map(tuple, got.collect()), key=str) == want


def test_block_links_ask_before_stored():
    """Documents that ask the block that stores them stay in its trie, whichever of their two rows comes first."""
    import numpy as np
    import pandas as pd

    data = np.arange(20, dtype=np.uint64).tobytes()
    rows = [(1, 1, 1, data), (2, 1, 2, data), (1, 0, 1, data)]
    for order in (rows, rows[::-1]):
        got = jaccard_join.block_links(pd.DataFrame(order, columns=["doc_id", "part", "label", "data"]), 90)
        assert got.values.tolist() == [[2, 1]]


def test_jaccard_awkward(spark):
    df = awkward(spark)
    got = jaccard_join.jaccard_components(df)
    assert sorted(map(tuple, got.collect()), key=str) == brute_components([(r.doc_id, r.text) for r in df.collect()], 3, 90)
    assert jaccard_join.jaccard_components(df.limit(0)).count() == 0


def test_top_k(spark):
    rng = random.Random(3)
    rows = [(i, [rng.choice([-0.5, 0.25, 0.1234, 0.9]) for _ in range(6)], 0) for i in range(400)]
    rows += [(7, rows[7][1], 0), (1000, None, 0), (1001, [None] * 6, 0), (1100, [float("nan")] * 6, 0), (1200, [1.0, 2.0], 0), (None, [0.5] * 6, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumnRenamed("label", "score")
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in topk_search.top_k(df).collect()}
    import numpy as np

    v = {i: np.floor(1024 * np.array(e, dtype=np.float32).astype(float)).astype(int) for i, e, _ in rows[:400]}
    want = {}
    for q in (x for x in v if x % 100 == 0):
        for k, (s, i) in enumerate(sorted((-int(v[q] @ v[i]), i) for i in v if i != q)[:10]):
            want[q, k + 1] = (i, -s)
    assert got == want
    assert topk_search.top_k(df.limit(0)).count() == 0


def test_top_k_lengths_and_batches(spark, monkeypatch):
    """Vectors of several lengths, few candidates, ties, negative scores; queries in one batch and in several."""
    import numpy as np

    rng = np.random.default_rng(2)
    rows = [(i * 10, (rng.integers(-3, 2, size=int(rng.choice([1, 2, 7, 64]))) / 4).tolist()) for i in range(200)] + [(5000, [0.5] * 9), (6000, []), (6010, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    v = {i: np.floor(1024 * np.array(e)).astype(int) for i, e in rows}
    want = {}
    for q in (x for x in v if x % 100 == 0):
        for k, (s, i) in enumerate(sorted((-int(v[q] @ v[i]), i) for i in v if i != q and len(v[i]) == len(v[q]))[:10]):
            want[q, k + 1] = (i, -s)
    for cells in (1 << 22, 300):
        monkeypatch.setattr(topk_search, "BATCH_CELLS", cells)
        assert {(r.query_id, r.rank): (r.vec_id, r.score) for r in topk_search.top_k(df).collect()} == want


def test_ftrl_brute_force():
    """Every coordinate and class by the formula of the method, one at a time."""
    rng, classes, cells = np.random.default_rng(5), 3, [2, 7, 11, 900]
    rows = []
    for _ in range(40):
        at = np.sort(rng.choice(cells, size=rng.integers(1, 5), replace=False))
        rows.append((at, rng.random(len(at)), int(rng.integers(classes))))
    z, n = {}, {}

    def weight(c, k):
        zk, nk = z.get((c, k), 0.0), n.get((c, k), 0.0)
        if abs(zk) <= language_id.L1:
            return 0.0
        return -(zk - math.copysign(language_id.L1, zk)) / ((language_id.BETA + math.sqrt(nk)) / language_id.ALPHA + language_id.L2)

    for _ in range(language_id.EPOCHS):
        for at, x, y in rows:
            w = {(c, k): weight(c, k) for c in at for k in range(classes)}
            e = [math.exp(sum(v * w[c, k] for c, v in zip(at, x))) for k in range(classes)]
            for c, v in zip(at, x):
                for k in range(classes):
                    g, was = v * (e[k] / sum(e) - (k == y)), n.get((c, k), 0.0)
                    z[c, k] = z.get((c, k), 0.0) + g - (math.sqrt(was + g * g) - math.sqrt(was)) / language_id.ALPHA * w[c, k]
                    n[c, k] = was + g * g
    got = language_id.ftrl(rows, classes)
    assert np.allclose(got[cells], [[weight(c, k) for k in range(classes)] for c in cells]) and np.abs(got[cells]).max() > 0
    assert np.count_nonzero(got) == np.count_nonzero(got[cells])


def test_language_id_repeated_rows_and_rare_letters(spark):
    texts = ["the cat and the dog of the house", "der hund und die katze aus dem haus"]
    rows = [(i, f"{texts[i % 2]} {i}", ["en", "de"][i % 2]) for i in range(200)]
    rows += [(1000 + i, "\U00020000\U00020001\U00020002" * 5, "zh") for i in range(40)] + [(2000, texts[0], "en")] * 300
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = language_id.identify(df, per_language=50).collect()
    assert len(out) == len(rows)
    truth = {r[0]: r[2] for r in rows}
    assert all(r.lang_pred == truth[r.doc_id] for r in out)


def test_language_id(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    rows = language_id.identify(df).join(df.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    assert sum(r.lang_pred == r.lang for r in held) / len(held) > 0.95
    out = {(r.doc_id, r.lang_pred, r.score) for r in language_id.identify(awkward(spark)).collect()}
    assert (1, "und", 0.0) in out and (2, "und", 0.0) in out
    assert language_id.identify(df.limit(0)).count() == 0


def test_licenses(spark):
    texts = ["x.\nLicensed under the Apache License, Version 2.0.\ny", "Released under the MIT License.\nRELEASED under   the MIT-License!", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version.", "This program is free software", "nothing", None, ""]
    got = licenses.scan(documents(spark, [(i, t, "en", "s") for i, t in enumerate(texts)])).collect()
    assert {(r.doc_id, r.licence, r.n_found) for r in got} == {(0, "Apache-2.0", 1), (1, "MIT", 2), (2, "GPL-3.0-or-later", 1), (3, "unmatched", 1)}
    assert next(r.first_sentence for r in got if r.doc_id == 0) == 1
    assert licenses.scan(awkward(spark)).count() == 0 and licenses.scan(awkward(spark).limit(0)).count() == 0


def test_licenses_notices(spark):
    """Notices as they stand in files: wrapped, behind comment signs, with text between them."""
    mit = """/*
 * Copyright (c) Someone
 *
 * Permission is hereby granted, free of charge, to any person obtaining a copy
 * of this software and associated documentation files (the "Software"), to deal
 * in the Software without restriction, including without limitation the rights
 * to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
 * copies of the Software, and to permit persons to whom the Software is
 * furnished to do so, subject to the following conditions:
 *
 * The above copyright notice and this permission notice shall be included in all
 * copies or substantial portions of the Software.
 */"""
    gpl = """# This program is free software: you can redistribute it and/or modify
# it under the terms of the GNU General Public License as published by
# the Free Software Foundation, either version 3 of the License, or
# (at your option) any later version."""
    apache = """// Licensed under the Apache License, Version 2.0 (the "License");
// you may not use this file except in compliance with the License.
// You may obtain a copy of the License at
//
//     http://www.apache.org/licenses/LICENSE-2.0
//
// Unless required by applicable law or agreed to in writing, software
// distributed under the License is distributed on an "AS IS" BASIS,
// WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
// See the License for the specific language governing permissions and
// limitations under the License."""
    bsd = """Copyright. All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

* Redistributions of source code must retain the above copyright notice,
  this list of conditions and the following disclaimer.
* Redistributions in binary form must reproduce the above copyright notice,
  this list of conditions and the following disclaimer in the documentation
  and/or other materials provided with the distribution."""
    lines = "one. " * 10
    texts = {0: mit, 1: gpl, 2: apache, 3: bsd, 4: mit + "\n\n" + gpl, 5: "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files.\n" + lines + "\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.", 6: "We love all rights reserved seats", 7: "x. " * 30_000 + gpl}
    rows = [(i, t, "en", "s") for i, t in texts.items()] + [(2, apache, "en", "s"), (None, mit, "en", "s")]
    got = {(r.doc_id, r.licence): (r.n_found, r.first_sentence) for r in licenses.scan(documents(spark, rows)).collect()}
    assert {k: n for k, (n, _) in got.items()} == {(0, "MIT"): 1, (1, "GPL-3.0-or-later"): 1, (2, "Apache-2.0"): 2, (3, "BSD-2-Clause"): 1, (3, "all-rights-reserved"): 1, (4, "MIT"): 1, (4, "GPL-3.0-or-later"): 1, (5, "MIT"): 1, (5, "unmatched"): 1, (7, "GPL-3.0-or-later"): 1, (None, "MIT"): 1}
    assert got[4, "MIT"][1] < got[4, "GPL-3.0-or-later"][1] and got[7, "GPL-3.0-or-later"][1] == 30_000 and got[5, "unmatched"][1] > 10


def test_url_filter(spark):
    urls = ["http://Example.ORG/es/1", "https://blog.example.org/en/19?x", "https://example.org/en/2", "http://badexample.org/es/", "ftp://a.com/de/x#y", "http://com/fr/", "http://a.net/", "nothing", None, "://", "http://x.org", "http://example.org/es/" + "a" * 20000]
    pages = spark.createDataFrame([(i, u, "h", "k") for i, u in enumerate(urls)] + [(None, urls[0], "h", "k")], "page_id long, url string, html string, key string")
    rules = spark.createDataFrame(url_filter.RULES, "host string, path string, verdict string")
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter.judge(pages, rules).collect()}
    for i, u in enumerate(urls):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        end = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host, path = rest[:end].lower(), rest[end:].split("?")[0].split("#")[0]
        fit = [(len(h + p), h + p, v) for h, p, v in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        assert got[i] == (max(fit)[1:] if fit else (None, "allow")), u
    assert got[None] == ("example.org/es/", "block")
    assert url_filter.judge(pages.limit(0), rules).count() == 0 and url_filter.judge(pages, rules.limit(0)).where("rule is not null").count() == 0


def test_packing(spark):
    df = awkward(spark).unionByName(spark.read.parquet(f"{SF}/documents.parquet"), allowMissingColumns=True)
    rows = packing.pack(df, capacity=500, shard=50).collect()
    words = sorted((r.doc_id if r.doc_id is not None else -1, len((r.text or "").encode().split())) for r in df.collect())
    want, got = {}, {}
    for i, n in words:
        want[i] = want.get(i, 0) + n
    bins, source = {}, {r.doc_id: r.source for r in df.collect()}
    for r in rows:
        i = r.doc_id if r.doc_id is not None else -1
        got[i] = got.get(i, 0) + r.n_words
        bins.setdefault(r.bin_id, []).append((r.n_words, source[r.doc_id]))
    assert got == {i: n for i, n in want.items() if n}
    for held in bins.values():
        sources = [s for _, s in held if s is not None]
        assert sum(n for n, _ in held) <= 500 and len(sources) == len(set(sources))
    assert packing.pack(df.limit(0)).count() == 0


def test_html(spark):
    page = '<!DOCTYPE html><html><head><title>T</title><script>var t="</p>";</script></head><body><header>Top</header><nav><a href="/">Menu</a></nav><div class="cookie-notice">We use</div><article><h1>Big &amp; <b>bold</b></h1><p>One\n two<br>three <p>Last &#233; &lt;x&gt;<div class="ad">buy</div></article><div id="comments"><p>I like this very much indeed</p></div><footer>F</footer>'
    plain = "<body><ul><li><a>x</a></li><li><a>y</a></li></ul><div><p>" + "word " * 30 + "</p><p>" + "more " * 20 + "</p></div><ul><li><a>z</a></li></ul></body>"
    pages = spark.createDataFrame([(1, "u", page, "t"), (2, None, None, None), (3, "u", "", "t"), (None, "u", plain, "t"), (5, "u", "just text < 3 & <", "t"), (6, "u", "<p>" * 5000 + "deep", "t")], "page_id long, url string, html string, text string")
    got = {r.page_id: r for r in html_text.extract(pages).collect()}
    assert got[1].text == "Big & bold\n\nOne two three\n\nLast é <x>" and got[1].n_chars == len(got[1].text)
    assert got[2].text == got[3].text == "" and got[None].text == ("word " * 30).strip() + "\n\n" + ("more " * 20).strip()
    assert got[5].text.startswith("just text") and got[6].text == "deep"
    assert html_text.extract(pages.limit(0)).count() == 0
    real = spark.read.parquet(f"{SF}/pages.parquet")
    import re

    for r in html_text.extract(real).join(real.select("page_id", "html"), "page_id").collect():
        import html as H

        article = r.html.split("<article>")[1].split("</article>")[0]
        assert re.sub(r"\s+", " ", r.text).strip() == re.sub(r"\s+", " ", H.unescape(re.sub(r"<[^>]*>", " ", article))).strip()


def test_html_best_region():
    """The scan against all regions."""
    rng = random.Random(4)
    for _ in range(300):
        x = [rng.choice([-2.5, -1.0, -0.5, 0.0, 1.0, 2.0]) for _ in range(rng.randrange(0, 14))]
        begin, end = html_text.best_region(x)
        best = max((sum(x[i:j]) for i in range(len(x)) for j in range(i, len(x) + 1)), default=0)
        assert sum(x[begin:end]) == max(best, 0) and (best > 0 or begin == end)


def test_html_without_article(spark):
    """Pages that don't mark their content, beside some that do; links, lists and headers stay in the text."""
    import html as H
    import re

    real = spark.read.parquet(f"{SF}/pages.parquet").toPandas().sort_values("page_id")
    text = {}
    for i, page in zip(real["page_id"], real["html"], strict=True):
        text[i] = re.sub(r"\s+", " ", H.unescape(re.sub(r"<[^>]*>", " ", page.split("<article>")[1].split("</article>")[0]))).strip()
    bare = real["page_id"] % 2 == 1
    real.loc[bare, "html"] = [x.replace("<article>", '<div class="story">').replace("</article>", "</div>") for x in real.loc[bare, "html"]]
    got = {r.page_id: re.sub(r"\s+", " ", r.text) for r in html_text.extract(spark.createDataFrame(real)).collect()}
    assert got == text
    odd = '<body><nav><a href="/">Home</a></nav><article><header><h1>Title</h1></header><p>Some <a href="x">linked words</a> here</p><ul><li>one</li><li>two</li></ul><div class="ad-box ad">Buy</div><div class="related-work"><p>More of it</p></div></article><div class="sidebar">Side</div><footer>End</footer></body>'
    rows = [(i, "u", odd) for i in range(40)]
    got = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).first()
    assert got.text == "Title\n\nSome linked words here\n\none\n\ntwo\n\nMore of it"


def test_decontaminate(spark):
    bench = spark.createDataFrame([(1, "If a train travels 60 km in 2 hours how far does it go in 5 hours at that speed"), (2, "the quick brown fox"), (3, None), (4, "")], "item_id long, text string")
    texts = ["Intro. IF a train, travels 80 miles in 3 hours: how far does it go in 7 hours at that speed?", "if a train travels 80 km in 3 hours how far does it go in 3 hours at that speed", "if a train travels 60 km in 2 hours how far does it go in 5 hours at that speed", "a train travels far", "the quick brown fox", "we saw the quick brown fox", None, ""]
    got = {(r.doc_id, r.item_id): r for r in decontaminate.contaminated(documents(spark, [(i, t, "en", "s") for i, t in enumerate(texts)]), bench).collect()}
    assert set(got) == {(0, 1), (1, 1), (2, 1), (4, 2), (5, 2)} and got[2, 1].exact and not got[0, 1].exact
    mixed = "if a train travels 80 km in 3 hours how far does it go in 7 hours at that speed 60 km in 2 hours"
    same = spark.createDataFrame([(1, "from 7 to 7 they went on and on all day long")], "item_id long, text string")
    assert decontaminate.contaminated(documents(spark, [(1, "from 7 to 9 they went on and on all day long", "en", "s")]), same).where("n_slots > 0").count() == 0
    assert decontaminate.contaminated(documents(spark, [(1, mixed, "en", "s")]), bench.limit(0)).count() == 0
    assert decontaminate.contaminated(awkward(spark).limit(0), bench).count() == 0
    real, items = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    found = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(real, items).collect()}
    planted = {(d.doc_id, b.item_id) for d in real.collect() for b in items.collect() if b.text in (d.text or "")}
    assert planted <= found


def test_decontaminate_verbatim_windows(spark):
    """Passages with an inconsistent slot beside them or mostly of names and numbers."""
    items = [(1, "from 7 to 7 they went on and on all day long"), (2, "So Alice paid 3 dollars, Bob paid 4 dollars, Carol paid 5 dollars")]
    texts = ["from 7 to 9 they went on and on all day long", "then Alice paid 3 dollars, Bob paid 4 dollars, Carol paid 5 dollars each", "then Alice paid 8 dollars, Bob paid 9 dollars, Carol paid 6 dollars each"]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.n_windows, r.n_slots, r.exact) for r in decontaminate.contaminated(documents(spark, [(i, t, "en", "s") for i, t in enumerate(texts)]), bench).collect()}
    assert got[0, 1] == (1, 0, True)
    assert (1, 2) in got and (2, 2) not in got


def test_decontaminate_short_and_repeated_items(spark):
    """Items of fewer words than a window stand anywhere in a text; null and repeated item_ids take part."""
    items = [(1, "quick brown fox"), (2, "Paris"), (None, "it rained for 3 days"), (4, "one two three four five six seven eight nine"), (4, "ten eleven"), (4, "ten eleven"), (5, " "), (6, "a b c d e f g h")]
    texts = ["So the QUICK, brown fox ran", "We went to see Paris once", "and it rained for 3 days there", "and it rained for 4 days there", "two three four five six seven eight nine", "say ten eleven", "quick brown", "a b c d e f g"]
    docs = documents(spark, [(i, t, "en", "s") for i, t in enumerate(texts)] + [(None, texts[0], None, None), (0, texts[0], "en", "s")])
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, source string")
    got = {(r.doc_id, r.item_id): (r.n_windows, r.n_slots, r.exact) for r in decontaminate.contaminated(docs, bench).collect()}
    assert got[0, 1] == got[None, 1] == (1, 0, True) and got[2, None] == (1, 2, True)
    assert set(got) == {(0, 1), (None, 1), (2, None), (4, 4), (5, 4)}


def test_decontaminate_shuffled_join(spark, monkeypatch):
    """A benchmark too large to broadcast gives the same rows."""
    real, items = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    want = sorted(map(tuple, decontaminate.contaminated(real, items).collect()))
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", 0)
    assert want and sorted(map(tuple, decontaminate.contaminated(real, items).collect())) == want


def test_quality(spark):
    df, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    kept = {r.doc_id for r in quality.resample(df, labels).collect()}
    rows = labels.collect()
    good = [r.doc_id in kept for r in rows if r.quality == 1 and r.toxic == 0]
    bad = [r.doc_id in kept for r in rows if r.quality == 0 or r.toxic == 1]
    assert sum(good) / len(good) > 0.95 and sum(bad) / len(bad) < 0.1
    assert quality.resample(df, labels, k=100).count() == 100
    assert quality.resample(awkward(spark), labels.limit(0)).count() == awkward(spark).count()
    assert quality.resample(df.limit(0), labels).count() == 0
    odd = spark.createDataFrame([(2, None, 1), (None, 1, 0), (4, 1, None), (9, 1, 0), (9, 0, 0)], "doc_id long, quality int, toxic int")
    assert quality.resample(awkward(spark), odd).count() > 0


def test_quality_brute_force(spark, monkeypatch):
    """Weights, noise and the k largest keys, recomputed n-gram by n-gram."""
    import math
    from collections import Counter

    monkeypatch.setattr(quality, "BITS", 20)
    texts = ["good words here", "fine good words", "good  good\tthings", "bad junk junk", "junk bad ###", None, "", "é", "fine things", "bad ### ###"]
    df = documents(spark, [(i, t, "en", "s") for i, t in enumerate(texts)])
    labels = spark.createDataFrame([(0, 1, 0), (1, 1, 0), (2, 1, 0), (3, 0, 0), (4, 1, 1), (9, 0, 0)], "doc_id long, quality int, toxic int")

    def grams(t):
        x = b" " + b" ".join((t or "").encode().split()) + b" " if (t or "").split() else b" "
        w = (t or "").split()
        x = b"  " if not t else x  # an empty text is two spaces, which are one
        x = b" " if x == b"  " else x
        return [x[i : i + n] for n in (2, 3, 4) for i in range(len(x) - n + 1)] + ["twice"] * sum(a == b for a, b in zip(w, w[1:]))

    held = {r.doc_id for r in labels.selectExpr("doc_id").where("pmod(xxhash64(doc_id, 5), 4) = 3").collect()}
    raw = Counter(g for t in texts for g in grams(t))
    target = Counter(g for i in {0, 1, 2} - held for g in grams(texts[i]))
    share = sum(target.values()) / sum(raw.values())
    log = {g: math.log((target[g] + 1) / (n * share + 1)) for g, n in raw.items()}
    middle, seen = sum(raw.values()) / 2, 0
    for g in sorted(log, key=log.get):
        seen += raw[g]
        if seen >= middle:
            break
    log = {h: x - log[g] for h, x in log.items()}
    log = {h: x if abs(x) >= quality.TELLING else 0.0 for h, x in log.items()}
    weight = {i: sum(log[g] for g in grams(t)) * quality.SHARPNESS / math.sqrt(max(1, len(grams(t)))) for i, t in enumerate(texts)}
    noise = {r.doc_id: r.n for r in df.select("doc_id", quality.noise().alias("n")).collect()}
    for k in (0, 3, 10):
        got = {r.doc_id: (r.log_weight, r.sample_key) for r in quality.resample(df, labels, k=k).collect()}
        assert set(got) == set(sorted(weight, key=lambda i: -(weight[i] + noise[i]))[:k])
        for i, (w, key) in got.items():
            assert abs(w - weight[i]) < 1e-4 and abs(key - w - noise[i]) < 1e-9


def test_oracles(spark):
    from tests.compare import differ

    for name, sql in queries.ORACLE_SQL.items():
        assert differ(spark, SF, queries.QUERIES[name], sql) == "", name


def test_decontaminate_many_windows_of_a_long_text(spark):
    """All windows of a long text match: none carries the text's words, which would come to some 10 GB here."""
    docs = spark.createDataFrame([(1, "7 " * 20_000), (2, "7 " * 7)], "doc_id long, text string")
    items = spark.createDataFrame([(1, " ".join(["7"] * 8))], "item_id long, text string")
    df = decontaminate.contaminated(docs, items)
    assert [tuple(r) for r in df.select("doc_id", "item_id", "n_windows", "n_slots", "exact").collect()] == [(1, 1, 1, 1, True)]
    plan = df._jdf.queryExecution().sparkPlan().toString()
    joined = next(line for line in reversed(plan[: plan.index("BroadcastHashJoin")].split("\n")) if "Project" in line)
    assert "lambda" not in joined  # compiled together with the join
