"""A Merkle manifest of a table: Spark jobs write the trees as postorder logs and read proofs from them by position.

Rows are leaves, numbered within their group. Aligned builders of BLOCK leaves append each node to a log as soon as it is
complete, so children stand before their parent and the root of a builder's leaves comes last. The roots are the leaves
of the next round's builders, until one node of the group is left; the groups' nodes are leaves of one more tree. Where a
node stands in a log follows from the sizes of the subtrees before it, so a proof is read by position, without a search:
a full binary subtree of s leaves has 2s - popcount(s) complete nodes, and one cut off at r leaves below level l has
2(r - 1) - popcount(r - 1) + l + 1. Proofs go from the top down: a builder's own path is known before those of its leaves.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from lattis.llm.components import keep

#: Levels of a builder: it takes up to 2 ** LEVELS nodes of a group that follow each other.
LEVELS = 8
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def field(value: Column) -> Column:
    """What a value adds to its leaf: byte count, colon, value; - if null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(values: list[Column]) -> Column:
    """The leaf's digest, 32 bytes."""
    return F.unhex(F.sha2(F.concat(*[field(v) for v in values]), 256))


def numbered(rows: DataFrame, group: str, order: list[Column]) -> DataFrame:
    """rows with pos, from 0 within the group by the order, and n, the group's rows. `order` must tell all rows apart that differ.

    Rows are sorted over all partitions, so a group may be of any size; counts of partitions make the offsets.
    """
    at = F.monotonically_increasing_id()
    rows = keep(rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order).select("*", at.alias("_at")))
    part = F.shiftright("_at", 33)
    parts = rows.groupBy(group, part.alias("_part")).agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = Window.partitionBy(group).orderBy("_part")
    parts = parts.select(group, "_part", "_first", (F.sum("_n").over(before) - F.col("_n")).alias("_before"), F.sum("_n").over(Window.partitionBy(group)).alias("n"))
    # a row for each partition and group in it: at most one more than partitions and groups together, keyed by both
    parts = keep(parts.withColumn("_slot", F.concat_ws(":", F.col("_part").cast("string"), F.col(group))).drop(group, "_part"))
    rows = rows.withColumn("_slot", F.concat_ws(":", part.cast("string"), F.col(group)))
    joined = rows.join(F.broadcast(parts), "_slot") if parts.count() <= BROADCAST_ROWS else rows.join(parts, "_slot")
    return joined.withColumn("pos", F.col("_at") - F.col("_first") + F.col("_before")).drop("_at", "_first", "_before", "_slot")


#: Offsets of so many partitions and groups are broadcast (some 100 bytes each).
BROADCAST_ROWS = 100_000


def append_log(leaves: bytes, levels: int) -> bytes:
    """The nodes over some leaves (32 bytes each) up to a level, in the order in which they are complete."""
    log: list[bytes] = []
    waits: list[bytes | None] = [None] * (levels + 1)

    def add(node: bytes, level: int) -> None:
        log.append(node)
        while level < levels and waits[level]:
            node, waits[level] = hashlib.sha256((waits[level].hex() + node.hex()).encode()).digest(), None
            log.append(node)
            level += 1
        waits[level] = node

    for i in range(0, len(leaves), 32):
        add(leaves[i : i + 32], 0)
    for level in range(levels):  # nodes without a partner, from below
        if waits[level]:
            node, waits[level] = waits[level], None
            add(hashlib.sha256(node.hex().encode()).digest(), level + 1)
    return b"".join(log)


@F.pandas_udf(BinaryType())
def logs(leaves: pd.Series, levels: pd.Series) -> pd.Series:
    return pd.Series([append_log(x, k) for x, k in zip(leaves, levels, strict=True)], dtype=object)


def build(nodes: DataFrame, levels: int) -> DataFrame:
    """One round. nodes: grp, pos, digest, n -> (grp, block, n, held, top, log): a row for each builder.

    n: nodes of the group in this round; held: nodes of the builder; top: whether it has all of its group.
    """
    block = F.shiftright("pos", levels)
    many = nodes.groupBy("grp", block.alias("block")).agg(F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("pos", "digest"))).alias("found"))
    many = many.select("grp", "block", "n", F.size("found").alias("held"), (F.col("n") <= 1 << levels).alias("top"), F.expr("aggregate(found, X'', (a, x) -> concat(a, x.digest))").alias("leaves"))
    height = F.when(F.col("held") == 1, 0).otherwise(F.length(F.bin(F.col("held") - 1)))
    height = F.when(F.col("top"), height).otherwise(F.lit(levels))
    return many.select("grp", "block", "n", "held", "top", height.alias("height"), logs(F.col("leaves"), height).alias("log"))


def roots(log: DataFrame, levels: int) -> DataFrame:
    """The next round's nodes: what comes last in the logs of groups with several builders."""
    return log.where("not top").select("grp", F.col("block").alias("pos"), F.substring("log", -32, 32).alias("digest"), F.shiftright(F.col("n") + ((1 << levels) - 1), levels).alias("n"))


def siblings(at: Column, held: Column, height: Column, log: Column) -> Column:
    """For each level below height the sibling of the node over leaf `at`: L or R for its side and its hex digest; '' if it has none."""

    def step(level: Column) -> Column:
        first = F.call_function("shiftleft", F.call_function("shiftright", at, level).bitwiseXOR(F.lit(1)), level)
        r = F.least(held - first, F.call_function("shiftleft", F.lit(1), level))
        place = 2 * first - F.bit_count(first) + 2 * (r - 1) - F.bit_count(r - 1) + level
        return F.when(first < held, F.concat(F.when(first > at, "R").otherwise("L"), F.lower(F.hex(F.call_function("substring", log, (32 * place + 1).cast("int"), F.lit(32)))))).otherwise("")

    return F.when(height > 0, F.transform(F.sequence(F.lit(0), height - 1), step)).otherwise(F.array().cast("array<string>"))


def trees(nodes: DataFrame, levels: int = LEVELS) -> list[DataFrame]:
    """The logs of all rounds (see build). nodes: grp, pos, digest, n; rounds are as many as the largest group needs."""
    most, rounds = nodes.agg(F.max("n")).first()[0] or 0, []
    while not rounds or most > 1:
        rounds.append(keep(build(nodes, levels)))
        nodes, most = roots(rounds[-1], levels), -(-most // (1 << levels))
    return rounds


def paths(rounds: list[DataFrame], above: DataFrame, levels: int = LEVELS) -> DataFrame:
    """(grp, block, held, height, log, path, ...) of the first round's builders; path: their siblings up to the root of all.

    above: grp and path of each group, with any other columns, which pass down.
    """
    more = [c for c in above.columns if c not in ("grp", "path")]
    known = None
    for log in reversed(rounds):
        own = log.where("top").join(above, "grp").select("grp", "block", "held", "height", "log", "path", *more)
        if known is not None:
            low = log.where("not top").withColumn("up", F.shiftright("block", levels)).alias("l")
            at = F.col("l.block").bitwiseAND((1 << levels) - 1).cast("int")
            both = low.join(known.alias("k"), (F.col("l.grp") == F.col("k.grp")) & (F.col("l.up") == F.col("k.block")))
            path = F.concat(siblings(at, F.col("k.held"), F.col("k.height"), F.col("k.log")), F.col("k.path"))
            own = own.unionByName(both.select("l.grp", "l.block", "l.held", "l.height", "l.log", path.alias("path"), *[f"k.{c}" for c in more]))
        known = own
    return keep(known)


def fold(start: Column, path: Column) -> Column:
    """The root, in hex, that a leaf (32 bytes) and the siblings of a path give."""

    def up(node: Column, s: Column) -> Column:
        other = F.substring(s, 2, 64)
        return F.sha2(F.when(s.startswith("L"), F.concat(other, node)).when(s.startswith("R"), F.concat(node, other)).otherwise(node), 256)

    return F.aggregate(path, F.lower(F.hex(start)), up)


def manifest(rows: DataFrame, key: str = "doc_id", group: str = "lang", columns: tuple[str, ...] = COLUMNS, carry: dict[str, Column] | None = None, levels: int = LEVELS) -> DataFrame:
    """(key, leaf, subroot, root, path, ...): every row as a leaf of its group's tree, with what proves it.

    A leaf is the digest of `columns`; leaves of a group ascend by key. Digests are 32 bytes. path: the sibling of each
    level from the leaf to the root over all groups, L or R for its side and then its hex digest, '' where there is none.
    carry: more columns, of the input's, to hand through.

    A null key comes first in its group and rows with one key go by their leaf; equal rows have a place each. A null group
    is a group and the first; an empty text is a value, a null one isn't. An empty table has no root and gives no rows.
    """
    told = F.coalesce(F.concat(F.lit("+"), F.col(group).cast("string")), F.lit("-"))  # '+' < '-': nulls are put first below
    leaves = rows.select(told.alias("grp"), F.col(key).alias("_key"), leaf([F.col(c) for c in columns]).alias("digest"), *[v.alias(k) for k, v in (carry or {}).items()])
    leaves = keep(leaves.withColumn("_row", F.monotonically_increasing_id()))
    order = [F.col("_key").asc_nulls_first(), F.col("digest"), F.col("_row")]
    leaves = keep(numbered(leaves, "grp", order))
    rounds = trees(leaves.select("grp", "pos", "digest", "n"), levels)
    subroots = rounds[0].where("top").select("grp", "log")
    for log in rounds[1:]:
        subroots = subroots.unionByName(log.where("top").select("grp", "log"))
    subroots = subroots.select(F.lit("all").alias("all"), "grp", F.substring("log", -32, 32).alias("digest"))
    top = keep(numbered(subroots, "all", [(F.col("grp") != "-").alias("named"), F.col("grp")]))
    over = trees(top.select(F.col("all").alias("grp"), "pos", "digest", "n"), levels)
    root = over[-1].where("top").select("grp", F.array().cast("array<string>").alias("path"), F.substring("log", -32, 32).alias("root"))
    above = climb(top.select(F.col("all").alias("grp"), "pos", F.col("grp").alias("name"), F.col("digest").alias("subroot")), paths(over, root, levels), levels)
    groups = keep(above.select(F.col("name").alias("grp"), "path", "subroot", "root"))
    out = climb(leaves, paths(rounds, groups, levels), levels)
    return out.select(F.col("_key").alias(key), F.col("digest").alias("leaf"), "subroot", "root", "path", *(carry or {}))


def climb(nodes: DataFrame, builders: DataFrame, levels: int) -> DataFrame:
    """nodes (grp, pos, ...) with the whole path of each, from the log and the path of its builder."""
    more = [c for c in builders.columns if c not in ("grp", "block", "held", "height", "log", "path")]
    at = F.col("pos").bitwiseAND((1 << levels) - 1).cast("int")
    nodes = nodes.withColumn("block", F.shiftright("pos", levels)).alias("x").join(builders.alias("b"), ["grp", "block"])
    path = F.concat(siblings(at, F.col("b.held"), F.col("b.height"), F.col("b.log")), F.col("b.path"))
    return nodes.select("x.*", path.alias("path"), *[f"b.{c}" for c in more])
