"""XML files as trees, typed records with their context, and attributes of records of any depth."""

from __future__ import annotations

import json
from collections.abc import Iterator
from xml.parsers import expat

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattis.session import keep

#: Elements may be nested this deep; deeper files count as malformed.
DEEPEST = 400
# Attributes that name a record, and per type the root around its elements and the name of one without key.
KEYS = ["@_key", "@_name", "@_filename"]
RECORDS = [("call", "calls", "call_"), ("weapon", "weapons", "weapon_"), ("carry_item", "carry_items", "carry_item_"), ("vehicle", "vehicles", "vehicle_"), ("projectile", "projectiles", "projectile_")]


def tree_json(text: str) -> str | None:
    """A file as JSON: {root: node}; attributes are under @_name, repeated elements in an array, text beside others under #text, an element of text alone is a string. None if it is not well-formed."""
    top: dict = {}
    open_: list[tuple[str, dict, list[str]]] = [("", top, [])]

    def start(name: str, attributes: dict[str, str]) -> None:
        if len(open_) > DEEPEST:
            raise ValueError("nested too deep")
        open_.append((name, {f"@_{k}": v for k, v in attributes.items()}, []))

    def end(_: str) -> None:
        name, node, text = open_.pop()
        said, around = "".join(text).strip(), open_[-1][1]
        if said and node:
            node["#text"] = said
        value = node or said
        if name not in around:
            around[name] = value
        elif isinstance(around[name], list):
            around[name].append(value)
        else:
            around[name] = [around[name], value]

    parser = expat.ParserCreate()
    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = start, end, lambda x: open_[-1][2].append(x)
    try:
        parser.Parse(text.encode(), True)
    except (expat.ExpatError, ValueError):
        return None
    return json.dumps(top)


def xml_trees(files: DataFrame) -> DataFrame:
    """(path, tree) of well-formed files: tree is a variant, see tree_json(); comments are left out, CDATA is text, and values stay text as written.

    files: path, content (text). A null or malformed content gives no row. Spark's own XML reader would make numbers of
    values that look like some (007), and ends the job at the first malformed file.
    """

    def parse(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            trees = [tree_json(x) if isinstance(x, str) else None for x in pdf["content"]]
            yield pd.DataFrame({"path": pdf["path"], "tree": trees})

    return files.select("path", "content").mapInPandas(parse, "path string, tree string").where("tree is not null").select("path", F.parse_json("tree").alias("tree"))


def at(v: Column, *names: str) -> Column:
    """The node below, or null; an element with nothing in it counts as absent."""
    v = F.try_variant_get(v, "$" + "".join(f"['{n}']" for n in names), "variant")
    return F.when(F.coalesce(F.try_variant_get(v, "$", "string"), F.lit("x")) != "", v)


def listed(v: Column) -> Column:
    """The elements of an array, or the one node there is; none for null."""
    return F.when(v.isNotNull(), F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.array(v)))


def key_of(node: Column, otherwise: Column) -> Column:
    return F.coalesce(*[F.try_variant_get(node, f"$['{k}']", "string") for k in KEYS], otherwise)


def typed_records(files: DataFrame) -> DataFrame:
    """(path, pos, type, key, faction, tree): the records of XML files.

    The file's extension, then its root decides: calls, weapons and the like hold records of their type; a faction holds
    soldiers, which carry its key, or is a record itself; a root may be a record alone; any other file is one record,
    script_chunk. Keys: the attribute key, name or filename, else type and place, or the file's name. Records keep all
    that is nested in them as a variant. files: path, content; malformed ones give no rows.
    """
    base = F.element_at(F.split("path", "/"), -1)
    ext = F.lower(F.regexp_extract(base, r"(?s)[^.](\.[^.]*)$", 1))
    stem = F.when(ext != "", F.substring(base, F.lit(1), F.length(base) - F.length(ext))).otherwise(base)
    faction = at(F.col("tree"), "faction")
    rows = xml_trees(files).select("path", "tree", ext.alias("ext"), stem.alias("stem"), F.regexp_replace(base, r"\.xml$", "").alias("plain"))

    def records(kind: str, nodes: Column, fallback: Column | str, own: Column | None = None) -> Column:
        """An array of (type, key, faction, tree), null if there are no nodes."""
        key = lambda x, i: key_of(x, F.concat(F.lit(fallback), i.cast("string")) if isinstance(fallback, str) else fallback)
        return F.transform(nodes, lambda x, i: F.struct(F.lit(kind).alias("type"), key(x, i).alias("key"), (own if own is not None else F.lit(None).cast("string")).alias("faction"), x.alias("tree")))

    tree, stem = F.col("tree"), F.col("stem")
    within = {kind: listed(at(tree, around, kind)) for kind, around, _ in RECORDS}
    names = {kind: name for kind, _, name in RECORDS}
    none = F.array().cast("array<struct<type:string,key:string,faction:string,tree:variant>>")
    owner = key_of(faction, F.col("plain"))
    references = F.transform(listed(at(tree, "factions", "faction")), lambda x: F.struct(F.lit("faction").alias("type"), F.coalesce(F.try_variant_get(x, "$['@_file']", "string"), F.lit("unknown")).alias("key"), F.lit(None).cast("string").alias("faction"), x.alias("tree")))
    whole = lambda kind: F.array(F.struct(F.lit(kind).alias("type"), stem.alias("key"), F.lit(None).cast("string").alias("faction"), tree.alias("tree")))
    soldiers = F.transform(listed(at(faction, "soldier")), lambda x: F.struct(F.lit("soldier").alias("type"), key_of(x, F.lit("unknown_soldier")).alias("key"), owner.alias("faction"), x.alias("tree")))
    alone = lambda kind: records(kind, listed(at(tree, kind)), names.get(kind, f"{kind}_"))
    found = (
        F.when(F.col("ext") == ".call", F.coalesce(records("call", within["call"], "call_"), none))
        .when(F.col("ext") == ".character", whole("character"))
        .when(within["call"].isNotNull(), records("call", within["call"], "call_"))
        .when(faction.isNotNull(), F.coalesce(soldiers, records("faction", listed(faction), F.col("plain"))))
        .when(at(tree, "factions").isNotNull(), F.coalesce(references, none))
        .otherwise(F.coalesce(
            alone("soldier"), records("weapon", within["weapon"], "weapon_"), alone("weapon"), records("carry_item", within["carry_item"], "carry_item_"), records("carry_item", listed(at(tree, "carry_item")), stem),
            records("vehicle", within["vehicle"], "vehicle_"), alone("vehicle"), records("projectile", within["projectile"], "projectile_"), alone("projectile"), whole("script_chunk"),
        ))
    )
    return rows.select("path", F.posexplode(found).alias("pos", "r")).select("path", "pos", "r.*")


def flatten_variants(df: DataFrame, key: str, column: str) -> DataFrame:
    """(key, path, value) of variants of any depth: dotted paths, attributes without @_; of repeats the last value, and under `path[]` those of all.

    A path below an array has its last value; `path[]` holds the last value of each element of the outermost array in which
    the path occurs more than once. #text is the value of its element (at the top: text). Nulls give no row. One round of
    lateral variant_explode for each level of nesting.
    """
    spark = df.sparkSession

    def kept(rows: DataFrame) -> DataFrame:
        """With whether a variant is nested, told from its own level: its schema would be that of all that is in it, at each level anew."""
        shallow = [F.try_variant_get("_v", "$", kind).isNotNull() for kind in ("array<variant>", "map<string,variant>")]
        return keep(rows.withColumn("_nested", shallow[0] | shallow[1]))

    rows = kept(df.select(F.col(key).alias("_key"), F.lit("").alias("_path"), F.array().cast("array<int>").alias("_at"), F.lit(0).alias("_late"), F.col(column).alias("_v")).where("_v is not null"))
    leaves = None
    while True:
        nested = F.col("_nested")
        value = F.try_variant_get("_v", "$", "string")
        done = rows.where(~nested & value.isNotNull()).select("_key", F.when(F.col("_path") == "", "text").otherwise(F.col("_path")).alias("_path"), "_at", "_late", value.alias("_value"))
        leaves = done if leaves is None else leaves.unionByName(done)
        deeper = rows.where(nested)
        if not deeper.limit(1).count():
            break
        inner = deeper.lateralJoin(spark.tvf.variant_explode(F.col("_v").outer()))
        name = F.regexp_replace("key", "^@_", "")
        path = F.when(F.col("key").isNull() | (F.col("key") == "#text"), F.col("_path")).when(F.col("_path") == "", name).otherwise(F.concat("_path", F.lit("."), name))
        rows = kept(inner.select("_key", path.alias("_path"), F.when(F.col("key").isNull(), F.array_append("_at", F.col("pos"))).otherwise(F.col("_at")).alias("_at"), F.when(F.col("key").startswith("@_"), 0).otherwise(1).alias("_late"), F.col("value").alias("_v")))
    found = leaves.groupBy("_key", "_path").agg(F.sort_array(F.collect_list(F.struct("_at", "_late", "_value"))).alias("h"))
    first, last = F.get("h", F.lit(0))["_at"], F.element_at("h", -1)["_at"]
    # levels of arrays in which all places agree
    same = F.aggregate(F.zip_with(first, last, lambda x, y: x.eqNullSafe(y)), F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda s, x: F.struct((s["n"] + (s["on"] & x).cast("int")).alias("n"), (s["on"] & x).alias("on")))["n"]
    found = found.withColumn("n", same)
    element = lambda x: F.get(x["_at"], F.col("n"))
    ends = F.filter("h", lambda x, i: (i == F.size("h") - 1) | ~element(x).eqNullSafe(element(F.get("h", i + 1))))
    every = F.array_join(F.transform(ends, lambda x: x["_value"]), ", ")
    out = F.array(F.struct(F.col("_path").alias("path"), F.element_at("h", -1)["_value"].alias("value")))
    out = F.when(first != last, F.concat(out, F.array(F.struct(F.concat("_path", F.lit("[]")).alias("path"), every.alias("value"))))).otherwise(out)
    return found.select(F.col("_key").alias(key), F.explode(out).alias("x")).select(key, "x.path", "x.value")
