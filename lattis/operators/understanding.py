"""Batch query understanding: synonyms, history-aware queries, trigger routing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattis.functions.text import mentioned_keys, mentioned_names

# Chinese terms and the English ones they stand for, in order of precedence.
SYNONYMS = [
    ("武器", ["weapon"]), ("枪", ["weapon", "gun"]), ("步枪", ["weapon", "rifle"]), ("冲锋枪", ["weapon", "submachine gun", "smg"]), ("狙击", ["weapon", "sniper", "sniper rifle"]), ("霰弹枪", ["weapon", "shotgun"]),
    ("手枪", ["weapon", "pistol"]), ("机枪", ["weapon", "machine gun"]), ("火箭筒", ["weapon", "rocket launcher"]), ("榴弹", ["grenade", "projectile", "explosive"]), ("手雷", ["grenade", "projectile"]), ("伤害", ["damage"]),
    ("射速", ["rpm", "rate of fire"]), ("射程", ["range"]), ("弹匣", ["magazine", "magazine_size"]), ("载具", ["vehicle"]), ("坦克", ["vehicle", "tank"]), ("吉普", ["vehicle", "jeep"]), ("装甲车", ["vehicle", "apc"]), ("船", ["vehicle", "boat"]),
    ("飞机", ["vehicle", "plane", "aircraft"]), ("士兵", ["soldier"]), ("兵种", ["soldier", "class"]), ("阵营", ["faction"]), ("派系", ["faction"]), ("护甲", ["armor", "vest", "carry_item"]), ("防弹衣", ["armor", "vest", "carry_item"]),
    ("外骨骼", ["exosuit", "exoframe", "carry_item"]), ("呼叫", ["call", "airstrike", "reinforcement"]), ("空袭", ["call", "airstrike"]), ("支援", ["call", "reinforcement"]), ("道具", ["carry_item", "item", "gear"]),
    ("装备", ["carry_item", "gear", "equipment"]), ("投掷物", ["projectile", "grenade"]), ("角色", ["character"]), ("等级", ["class"]), ("属性", ["specification"]), ("规格", ["specification"]),
]


def expand_synonyms(queries: DataFrame, key: str, text: str, synonyms: list[tuple[str, list[str]]] = SYNONYMS, most: int = 5) -> DataFrame:
    """Adds `expanded`: the question with at most `most` distinct terms of the other language.

    A Chinese term in the question adds its English terms that are not in it; an English term that stands by itself adds
    the Chinese one if that is not in it. The dictionary is a small fixed table and becomes part of the plan.
    """
    q, low = F.col(text), F.lower(F.col(text))
    found = []
    for cn, terms in synonyms:
        forward = F.filter(F.array(*map(F.lit, terms)), lambda t: ~F.contains(low, t))
        alone = "|".join(terms)
        back = F.when(low.rlike(f"(^|[^a-z0-9_])({alone})([^a-z0-9_]|$)"), F.array(F.lit(cn))).otherwise(F.array().cast("array<string>"))
        found.append(F.when(F.contains(q, F.lit(cn)), forward).otherwise(back))
    extra = F.slice(F.array_distinct(F.concat(*found)), 1, most)
    return queries.withColumn("expanded", F.concat_ws(" ", q, F.when(F.size(extra) > 0, F.array_join(extra, " "))))


def history_query(conversations: DataFrame, summaries: DataFrame | None = None, synonyms: list[tuple[str, list[str]]] = SYNONYMS) -> DataFrame:
    """For each user turn (conv_id, turn) the search query in the light of what came before it in the conversation.

    Parts in order, each distinct one once: 150 characters of the summary, its first 5 entities, the last 2 user turns
    (whole up to 100 characters, else 80), up to 10 keys that answers named or else up to 5 names, the expanded question.
    summaries: conv_id, summary, entities (array). One shuffle by conversation serves all parts.
    """
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    clean = F.trim("text")
    rows = conversations.withColumn("asked", F.when(F.col("role") == "user", F.when(F.length(clean) <= 100, clean).otherwise(F.substring(clean, 1, 80))))
    keys = F.when(F.col("role") == "assistant", mentioned_keys(F.col("text")))
    rows = rows.withColumn("keys", keys).withColumn("names", F.when(F.size("keys") == 0, mentioned_names(F.col("text"))))
    rows = rows.withColumn("history", F.collect_list("asked").over(before)).withColumn("all_keys", F.flatten(F.collect_list("keys").over(before))).withColumn("all_names", F.flatten(F.collect_list("names").over(before)))
    rows = expand_synonyms(rows.where("role = 'user'"), "conv_id", "text", synonyms)
    last = F.slice("history", F.greatest(F.size("history") - 1, F.lit(1)), 2)
    some_keys, some_names = F.slice(F.array_distinct("all_keys"), 1, 10), F.slice(F.array_distinct("all_names"), 1, 5)
    told = F.when(F.size(some_keys) > 0, F.array_join(some_keys, " ")).when(F.size(some_names) > 0, F.array_join(some_names, " "))
    head = F.array().cast("array<string>")
    if summaries is not None:
        rows = rows.join(summaries.select("conv_id", "summary", "entities"), "conv_id", "left")
        entities = F.when(F.size("entities") > 0, F.array_join(F.slice("entities", 1, 5), " "))
        head = F.array(F.when(F.col("summary") != "", F.substring("summary", 1, 150)), entities)
    parts = F.array_distinct(F.array_compact(F.concat(head, last, F.array(told, F.col("expanded")))))
    return rows.select("conv_id", "turn", F.array_join(parts, " ").alias("search_query"))


def route_triggers(queries: DataFrame, items: DataFrame, key: str, text: str, least: int = 0) -> DataFrame:
    """(key, item): items one of whose triggers is part of the question, and items without triggers.

    items: item, trigger (null: always kept). All items are kept while there are fewer than `least`. The items are a
    registry of bounded size; beyond 10,000 rows the join is left to Spark's choice.
    """
    n = items.agg(F.count_distinct("item"), F.count("*")).first()
    if n[0] < least:
        return queries.select(key).withColumn("item", F.explode(F.lit([r["item"] for r in items.select("item").distinct().collect()])))
    low = items.withColumn("trigger", F.lower("trigger"))
    low = F.broadcast(low) if n[1] <= 10_000 else low
    hit = low["trigger"].isNull() | F.contains(F.lower(queries[text]), low["trigger"])
    return queries.join(low, hit).select(key, "item").distinct()
