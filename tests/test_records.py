"""Typed records and flattened attributes against plain Python over ElementTree and JSON."""

import json
import os
import random
import xml.etree.ElementTree as ET
from xml.sax.saxutils import escape, quoteattr

import pytest

from lattis.sources import records as R


def node(e):
    out = {f"@_{k}": v for k, v in e.attrib.items()}
    for c in e:
        v = node(c)
        if c.tag in out:
            out[c.tag] = [*out[c.tag], v] if isinstance(out[c.tag], list) else [out[c.tag], v]
        else:
            out[c.tag] = v
    text = ((e.text or "") + "".join(c.tail or "" for c in e)).strip()
    if text and out:
        out["#text"] = text
    return out or text


def brute_records(path, content):
    try:
        root = ET.fromstring(content)
    except ET.ParseError:
        return []
    t = {root.tag: node(root)}
    base = os.path.basename(path)
    stem, ext = os.path.splitext(base)
    ext = ext.lower()
    many = lambda v: v if isinstance(v, list) else [v]
    get = lambda v, k: v.get(k) if isinstance(v, dict) else None
    key = lambda v, other: next((v[k] for k in R.KEYS if isinstance(v, dict) and k in v), other)
    inside = lambda around, kind: get(t.get(around), kind)
    typed = lambda kind, nodes: [(kind, key(v, f"{kind}_{i}"), None, v) for i, v in enumerate(many(nodes))]
    if ext == ".call":
        return typed("call", inside("calls", "call")) if inside("calls", "call") else []
    if ext == ".character":
        return [("character", stem, None, t)]
    if inside("calls", "call"):
        return typed("call", inside("calls", "call"))
    if t.get("faction"):
        f = t["faction"]
        own = key(f, base.removesuffix(".xml"))
        if get(f, "soldier"):
            return [("soldier", key(v, "unknown_soldier"), own, v) for v in many(f["soldier"])]
        return [("faction", own, None, f)]
    if t.get("factions"):
        return [("faction", get(v, "@_file") or "unknown", None, v) for v in many(inside("factions", "faction"))] if inside("factions", "faction") else []
    if t.get("soldier"):
        return typed("soldier", t["soldier"])
    for kind in ("weapon", "carry_item", "vehicle", "projectile"):
        if inside(f"{kind}s", kind):
            return typed(kind, inside(f"{kind}s", kind))
        if t.get(kind):
            return [("carry_item", key(t[kind], stem), None, t[kind])] if kind == "carry_item" else typed(kind, t[kind])
    return [("script_chunk", stem, None, t)]


def random_xml(rng, tag, depth):
    attrs = "".join(f" {k}={quoteattr(rng.choice(['1', '007', 'a b', '<&>', 'ü', '']))}" for k in rng.sample(["key", "name", "file", "x"], rng.randrange(0, 3)))
    inner = ""
    if depth:
        for _ in range(rng.randrange(0, 4)):
            inner += rng.choice(["", " ", "text ", escape("a<b&c"), "<!-- <weapon key='no'/> -->", "<![CDATA[<soldier key='no'/>]]>"])
            inner += random_xml(rng, rng.choice(["soldier", "weapon", "call", "faction", "item", "vehicle", "projectile", "carry_item", "x"]), depth - 1)
    elif rng.random() < 0.3:
        inner = rng.choice(["plain", " 5 ", "1e5", "true"])
    return f"<{tag}{attrs}>{inner}</{tag}>" if inner or rng.random() < 0.5 else f"<{tag}{attrs}/>"


def test_typed_records(spark):
    rng = random.Random(4)
    files = []
    for i in range(250):
        root = rng.choice(["calls", "weapons", "carry_items", "vehicles", "projectiles", "faction", "factions", "soldier", "weapon", "call", "carry_item", "vehicle", "projectile", "thing"])
        text = rng.choice(["", '<?xml version="1.0" encoding="UTF-8"?>\n', "<!-- c -->"]) + random_xml(rng, root, rng.randrange(0, 4))
        files.append((f"p/f{i}.v{rng.choice(['.xml', '.call', '.character', '.Weapon', ''])}", text))
    files += [("p/bad1.xml", "<weapons><weapon key='b'></weapons>"), ("p/bad2.xml", "plain"), ("p/bad3.xml", ""), ("p/bad4.xml", None), ("p/two.xml", "<a/><b/>"), ("p/deep.xml", "<a>" * 1000 + "</a>" * 1000)]
    df = spark.createDataFrame(files, "path string, content string")
    got = {}
    for r in R.typed_records(df).selectExpr("path", "pos", "type", "key", "faction", "to_json(tree) as t").collect():
        got.setdefault(r.path, []).append((r.pos, r.type, r.key, r.faction, json.loads(r.t)))
    kinds = set()
    for path, content in files[:-1]:
        want = [(i, *x) for i, x in enumerate(brute_records(path, content))] if content else []
        assert sorted(got.get(path, []), key=lambda x: x[0]) == want, (path, content)
        kinds |= {x[1] for x in want}
    assert "p/deep.xml" not in got and len(kinds) == 9
    assert R.typed_records(df.limit(0)).count() == 0


def brute_flatten(v):
    """path -> [(places in arrays, late, value)]"""
    leaves = {}

    def walk(v, path, at, late):
        if isinstance(v, dict):
            for k in sorted(v):
                walk(v[k], path if k == "#text" else f"{path}.{k.removeprefix('@_')}" if path else k.removeprefix("@_"), at, 0 if k.startswith("@_") else 1)
        elif isinstance(v, list):
            for i, x in enumerate(v):
                walk(x, path, (*at, i), 1)
        elif v is not None:
            leaves.setdefault(path or "text", []).append((at, late, str(v).lower() if isinstance(v, bool) else str(v)))

    walk(v, "", (), 0)
    out = {}
    for path, h in leaves.items():
        h.sort()
        out[path] = h[-1][2]
        group = h
        while len({x[0] for x in group}) > 1:
            firsts = [x[0][:1] for x in group]
            if len(set(firsts)) > 1:
                out[f"{path}[]"] = ", ".join([x[2] for i, x in enumerate(group) if i == len(group) - 1 or group[i + 1][0][:1] != x[0][:1]])
                break
            group = [(x[0][1:], *x[1:]) for x in group]
    return out


def test_flatten_variants(spark):
    rng = random.Random(9)

    def value(depth):
        kind = rng.random()
        if depth == 0 or kind < 0.3:
            return rng.choice(["a", "007", "", None, 5, True])
        if kind < 0.75:
            return {k: value(depth - 1) for k in rng.sample(["@_x", "x", "y", "#text", "z"], rng.randrange(0, 4))}
        return [value(depth - 1) for _ in range(rng.randrange(0, 4))]

    rows = [(i, json.dumps(value(5))) for i in range(200)] + [(200, None), (201, json.dumps([[1, [2, 3]], [[4]]]))]
    df = spark.createDataFrame(rows, "id int, j string").selectExpr("id", "parse_json(j) as v", "1 as key", "2 as value", "3 as path")
    got = {}
    for r in R.flatten_variants(df, "id", "v").collect():
        assert got.setdefault(r.id, {}).setdefault(r.path, r.value) == r.value
    for i, j in rows:
        want = brute_flatten(json.loads(j)) if j else {}
        assert got.get(i, {}) == want, (j, got.get(i), want)


@pytest.mark.parametrize("text", ["<a>" + "<b/>" * 50_000 + "</a>", "<a x='" + "y" * 1_000_000 + "'/>", "<a>" + "t " * 500_000 + "</a>"])
def test_large_files(spark, text):
    [r] = R.typed_records(spark.createDataFrame([("f.xml", text)], "path string, content string")).select("type").collect()
    assert r.type == "script_chunk"


def test_nested_variants_are_told_from_their_own_level(spark):
    """No level asks for the schema of all that is in a variant; empty objects and arrays, nulls and JSON in a text give what they gave."""
    rows = [(1, '{"a": {}, "b": [], "c": null, "d": "[1, 2]", "e": [[], {"f": "{}"}], "g": true}'), (2, "[]"), (3, "{}"), (4, "null"), (5, '"x"'), (6, "1.5")]
    df = R.flatten_variants(spark.createDataFrame(rows, "k int, j string").selectExpr("k", "parse_json(j) AS v"), "k", "v")
    assert "schemaofvariant" not in df._jdf.queryExecution().optimizedPlan().toString().lower().replace("_", "")
    assert sorted(map(tuple, df.collect())) == [(1, "d", "[1, 2]"), (1, "e.f", "{}"), (1, "g", "true"), (5, "text", "x"), (6, "text", "1.5")]
