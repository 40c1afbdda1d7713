"""Fact joins: upgrade and skill maps, modal traits, cooldowns, timelines, block facts."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattis.operators.graph import bounded_bfs

#: A call that pairs a source item with the item it turns into: upgrade("from", "to").
UPGRADE_CALL = r'\w+\(\s*"([^"]+)"\s*,\s*"([^"]+)"\s*\)'
#: A list of modifiers is made of so many rows at most, as a binary logarithm.
LIST_BITS = 16


def upgrade_map(lines: DataFrame, items: DataFrame, translations: DataFrame, pattern: str = UPGRADE_CALL) -> DataFrame:
    """(group, sources, targets, names): items that the calls of a group of lines turn into one another.

    lines: group, line; items: key, name; translations: name, text. Sets are sorted and joined by commas; names are the
    translations of the targets that have one.
    """
    calls = lines.select("group", F.explode(F.regexp_extract_all("line", F.lit(pattern), F.lit(0))).alias("call"))
    calls = calls.select("group", F.regexp_extract("call", pattern, 1).alias("source"), F.regexp_extract("call", pattern, 2).alias("target")).distinct()
    names = items.groupBy("key").agg(F.min("name").alias("name"))
    said = translations.groupBy("name").agg(F.min("text").alias("text"))
    rows = calls.join(names, F.col("target") == F.col("key"), "left").join(said, "name", "left")
    join = lambda c: F.array_join(F.sort_array(F.collect_set(c)), ",")
    return rows.groupBy("group").agg(join("source").alias("sources"), join("target").alias("targets"), join("text").alias("names"))


#: Calls of a script: an item's upgrade, the weapon that a group gets, and the weapon that a group's queue takes.
SCRIPT_CALLS = {
    "upgrade": r'\bupgrade\([^")]*"(?<group>[^"]+)"\s*,\s*"(?<key>[^"]+)"',
    "gives": r'\bgive\([^")]*"(?<key>[^"]+)"\s*,[^",]*,\s*"(?<group>[^"]+)"',
    "takes": r'\bqueue\([^")]*"(?<group>[^"]+)"\)[^{]*?item\s*==?\s*"(?<key>[^"]+)"',
}


def script_calls(scripts: DataFrame, calls: dict[str, str] = SCRIPT_CALLS) -> DataFrame:
    """(file, kind, group, key): calls of each kind in scripts (file, content); a pattern names its group and key."""
    def found(kind: str, pattern: str) -> Column:
        plain, first = re.sub(r"\?<\w+>", "", pattern), re.search(r"\?<(\w+)>", pattern).group(1)
        place = {first: 1, "key" if first == "group" else "group": 2}
        one = F.regexp_extract_all("content", F.lit(plain), F.lit(0))
        return F.transform(one, lambda c: F.struct(F.lit(kind).alias("kind"), *[F.regexp_extract(c, plain, place[x]).alias(x) for x in ("group", "key")]))

    return scripts.select("file", F.explode(F.concat(*[found(*x) for x in calls.items()])).alias("c")).select("file", "c.kind", "c.group", "c.key")


def upgrade_entries(scripts: DataFrame, items: DataFrame, translations: DataFrame, calls: dict[str, str] = SCRIPT_CALLS) -> DataFrame:
    """(item, group, takes, gives, name, text): an entry for each upgrade call, with the weapons its group takes and gives.

    scripts: file, content; items: key, name; translations: name, text. Sets are sorted and joined by commas; an item
    without a name, or a name without a translation, has an empty one.
    """
    rows = script_calls(scripts, calls).select("kind", "group", "key").distinct()
    join = lambda kind: F.array_join(F.sort_array(F.collect_set(F.when(F.col("kind") == kind, F.col("key")))), ",").alias(kind)
    weapons = rows.where("kind <> 'upgrade'").groupBy("group").agg(join("takes"), join("gives"))
    names, said = items.groupBy("key").agg(F.min("name").alias("name")), translations.groupBy("name").agg(F.min("text").alias("text"))
    out = rows.where("kind = 'upgrade'").join(weapons, "group", "left").join(names, "key", "left").join(said, "name", "left")
    return out.select(F.col("key").alias("item"), "group", *[F.coalesce(c, F.lit("")).alias(c) for c in ("takes", "gives", "name", "text")])


def skill_map(weapons: DataFrame, handlers: DataFrame, projectiles: DataFrame, effects: DataFrame) -> DataFrame:
    """(weapon, index, handler, projectile, notify, effect, missing): each weapon's way to its effect; missing names the first step that has no fact.

    weapons: weapon, index; handlers: index, handler, projectile; projectiles: projectile, notify; effects: notify, effect.
    """
    rows = weapons.join(handlers, "index", "left").join(projectiles, "projectile", "left").join(effects, "notify", "left")
    missing = F.when(F.col("handler").isNull(), "handler").when(F.col("projectile").isNull(), "projectile").when(F.col("notify").isNull(), "notify").when(F.col("effect").isNull(), "effect")
    return rows.select("weapon", "index", "handler", "projectile", "notify", "effect", missing.alias("missing"))


def damage_chain(skills: DataFrame, projectiles: DataFrame, spawns: DataFrame, effects: DataFrame, depth: int = 4, cap: int = 20) -> DataFrame:
    """(skill, pos, projectile, depth, unresolved, notify, effect, note): what a skill's projectiles spawn, then what the effects that these notify spawn.

    skills: skill, projectile, ord; projectiles: projectile, notify; spawns: projectile, spawned, ord; effects: notify,
    effect, projectile (null: it spawns none), ord. Both walks share their nodes and the cap. A projectile without a
    record stays as unresolved; note names what is missing on its way.
    """
    known = projectiles.select(F.col("projectile").alias("key"))
    edges = spawns.select(F.col("projectile").alias("from"), F.col("spawned").alias("to"), "ord")
    first = bounded_bfs(skills.select(F.col("skill").alias("rid"), F.col("projectile").alias("key"), "ord"), edges, known, depth, cap)
    told = first.join(projectiles, F.col("key") == F.col("projectile")).where(F.col("notify").isNotNull()).groupBy("rid", "notify").agg(F.min("pos").alias("at"))
    more = told.join(effects.where(F.col("projectile").isNotNull()), "notify")
    # an effect's projectiles come in the order in which the effects are told
    more = more.select("rid", F.col("projectile").alias("key"), F.row_number().over(Window.partitionBy("rid").orderBy("at", "notify", "ord", "projectile")).alias("ord"))
    nodes = bounded_bfs(more, edges, known, depth, cap, first)
    names = effects.groupBy("notify").agg(F.min("effect").alias("effect"))
    rows = nodes.join(projectiles, F.col("key") == F.col("projectile"), "left").drop("projectile").join(names, "notify", "left")
    note = F.when(F.col("unresolved"), "projectile has no record").when(F.col("notify").isNotNull() & F.col("effect").isNull(), "notified key has no effect")
    return rows.select(F.col("rid").alias("skill"), F.col("pos").cast("int").alias("pos"), F.col("key").alias("projectile"), "depth", "unresolved", "notify", "effect", note.alias("note"))


def modal_value(df: DataFrame, group: str, value: str) -> DataFrame:
    """(group, modal, candidates): the most frequent value if it is strictly ahead, else null and the candidates in order."""
    n = df.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count("*").alias("n"))
    top = n.withColumn("r", F.dense_rank().over(Window.partitionBy(group).orderBy(F.desc("n")))).where("r = 1")
    rows = top.groupBy(group).agg(F.sort_array(F.collect_list(value)).alias("v"))
    return rows.select(group, F.when(F.size("v") == 1, F.col("v")[0]).alias("modal"), F.when(F.size("v") > 1, F.array_join("v", ",")).alias("candidates"))


def disambiguate(candidates: DataFrame, labels: DataFrame) -> DataFrame:
    """(id, value): the first candidate that is part of the label of its id. candidates: id, value, ord; labels: id, label. The join is on id, with containment as its condition."""
    hit = candidates.join(labels, "id").where(F.contains(F.lower("label"), F.lower("value")))
    return hit.groupBy("id").agg(F.min_by("value", "ord").alias("value"))


def effective_cooldown(skills: DataFrame, modifiers: DataFrame, least: float = 0.1) -> DataFrame:
    """(skill, modifier, seconds): max(seconds * multiplier - minus, least) under each modifier of a skill's class. skills: skill, class, base; modifiers: modifier, class, multiplier, minus.

    Modifiers of a class that do the same are joined as lists, so that the seconds are worked out, and rounded, once for
    each skill and list. Classes are few, so each is dealt in four slices for each shuffle partition; partitions hold few
    rows but make many, so their number is given.
    """
    parts = int(skills.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    slices, some = 4 * parts, F.shiftright(F.monotonically_increasing_id(), LIST_BITS).alias("_some")
    same = modifiers.select("*", some).groupBy("class", "multiplier", "minus", "_some").agg(F.collect_list(F.struct("modifier")).alias("_modifiers"))
    same = same.withColumn("_slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1)))).repartition(parts, "class", "_slice")
    dealt = skills.withColumn("_slice", F.pmod(F.xxhash64("skill"), F.lit(slices)).cast("int")).repartition(parts, "class", "_slice")
    seconds = F.round(F.greatest(F.col("base") * F.col("multiplier") - F.col("minus"), F.lit(least)), 6)
    rows = dealt.join(same, ["class", "_slice"]).select("skill", seconds.alias("seconds"), "_modifiers")
    return rows.select("skill", F.inline("_modifiers"), "seconds")


def tick_timeline(effects: DataFrame) -> DataFrame:
    """(effect, tick, at, last): times of an effect's ticks; repeats = start - threshold + 1. effects: effect, delay, interval, start, threshold."""
    n = F.greatest(F.col("start") - F.col("threshold") + 1, F.lit(0))
    rows = effects.where(n > 0).withColumn("tick", F.explode(F.sequence(F.lit(1), n.cast("int"))))
    return rows.select("effect", "tick", F.round(F.col("delay") + (F.col("tick") - 1) * F.col("interval"), 3).alias("at"), F.round(F.col("delay") + (n - 1) * F.col("interval"), 3).alias("last"))


def uncovered(names: DataFrame, covered: DataFrame) -> DataFrame:
    """(norm, name): first names whose normalised form nothing covers. names: name, ord; covered: name."""
    norm = F.regexp_replace(F.lower("name"), "[^a-z0-9]+", "")
    left = names.withColumn("norm", norm).join(covered.select(norm.alias("norm")).distinct(), "norm", "left_anti")
    return left.groupBy("norm").agg(F.min_by("name", "ord").alias("name"))


BLOCK_SCHEMA = "struct<element:array<struct<_key:string,result:array<struct<_class:string,_key:string,_damage:string,_radius:string>>>>>"


def block_facts(files: DataFrame, schema: str = BLOCK_SCHEMA) -> DataFrame:
    """(file, pos, key, class, result_key, damage, radius): results of every element block of an XML file by class. files: file, content; malformed files give no rows."""
    rows = files.select("file", F.posexplode(F.from_xml("content", schema)["element"]).alias("pos", "e"))
    rows = rows.select("file", "pos", F.col("e._key").alias("key"), F.explode("e.result").alias("r"))
    return rows.select("file", "pos", "key", F.col("r._class").alias("class"), F.col("r._key").alias("result_key"), F.expr("try_cast(r._damage as double)").alias("damage"), F.expr("try_cast(r._radius as double)").alias("radius"))
