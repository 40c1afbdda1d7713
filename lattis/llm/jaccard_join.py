"""N-gram Jaccard join with a prefix tree.

Sets of n-word shingles are put in one global order, shingles of rare words first; a shingle's place is part of its
64-bit name. Two sets that reach the threshold share a shingle among the first of each (the prefix), so:

1. Equal sets fall together by a 128-bit fingerprint; one document of each stands for them.
2. Prefix shingles go to buckets by name; the smallest document of a shingle that two or more have is its leader. The
   prefix is twice the least that holds a common shingle, so linked documents share a good part of it; those with too few
   shared ones go no further. Each other document joins the groups of its first shared shingles' leaders, those of the
   fewest documents first, so that passages of many documents make groups only of those that hold little else; linked
   documents meet in at least one. One leader stands for many shingles, so a document's set is sent to few groups.
3. A group is dealt in blocks of bounded size, the leader's set in each. A task stores its block as a trie of ordered
   sets and walks it with each set, sharing the overlap of shared beginnings and leaving subtrees whose remaining lengths
   can't reach the threshold. Subtrees whose documents are already connected with the set are left too: components ask
   for connection, not for every pair.
4. Components of the links. Groups of several blocks that are still in several components get a second round: documents
   outside the group's largest component meet every block. No link between different components is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattis.llm.components import components, join_by_size, keep
from lattis.llm.hashing import U, as_bytes, combine, mix, steps, windows, words
from lattis.llm.shards import NO_ID, documents, nullable_id, packed_texts, shard_of, shards_for, whole_id
from lattis.llm.substring_dedup import lowest, opened, packed
from lattis.session import cleaned_up

#: Cells of the word counts behind the order: 256 kB of 32-bit counts, whatever the corpus.
CELLS = 1 << 16
SLICES = 32
#: Documents of a group that one task stores as a trie.
BLOCK = 100
#: Bits of a shingle's name that hold its place in the order.
RANK_BITS = 8


def word_counts(docs: DataFrame, lower: bool) -> tuple[np.ndarray, int]:
    """How often the words of each hash cell occur in all texts, and the bytes of all texts."""

    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cells, size = np.zeros(CELLS, dtype=np.int64), 0
        for pdf in parts:
            texts = as_bytes(pdf["text"])
            size += sum(map(len, texts))
            for a, b in steps(texts):
                cells += np.bincount((words(texts[a:b], lower)[0] >> U(48)).astype(np.int64), minlength=CELLS)
        yield pd.DataFrame({"slice": range(SLICES), "size": size, "cells": [x.tobytes() for x in cells.reshape(SLICES, -1)]})

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(x, dtype=np.int64) for x in pdf["cells"])
        return pd.DataFrame({"slice": pdf["slice"].iloc[:1], "size": [pdf["size"].sum()], "cells": [total.tobytes()]})

    kind = "slice int, size long, cells binary"
    rows = docs.select("text").mapInPandas(count, kind).groupBy("slice").applyInPandas(add, kind).collect()  # 32 rows, 512 kB
    if not rows:
        return np.zeros(CELLS, dtype=np.int64), 0
    return np.concatenate([np.frombuffer(r["cells"], dtype=np.int64) for r in sorted(rows)]), rows[0]["size"]


def ordered_sets(texts: list[bytes], n: int, lower: bool, cost: np.ndarray | None) -> Iterator[np.ndarray]:
    """For each text its distinct shingles as names, sorted; with cost (by cell) names begin with their place in the order."""
    h, bounds = words(texts, lower)
    every = windows(h, n)
    if cost is not None:
        c = np.concatenate(([0.0], np.cumsum(cost[(h >> U(48)).astype(np.int64)])))
        place = np.rint((c[n:] - c[:-n]) / n).astype(np.uint64) if len(h) >= n else np.empty(0, dtype=np.uint64)
        every = place << U(64 - RANK_BITS) | every >> U(RANK_BITS)
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        if b - a >= n:
            yield np.unique(every[a : b - n + 1])
        elif b > a:
            yield combine([h[i : i + 1] for i in range(a, b)], seed=int(b - a)) >> U(RANK_BITS)
        else:
            yield np.empty(0, dtype=np.uint64)


def eighths(n: np.ndarray) -> np.ndarray:
    """Counts as a byte each: eight times the binary logarithm."""
    return np.minimum(8 * np.log2(np.maximum(n, 1)), 255).astype(np.uint8)


def margin(n: int, percent: int) -> tuple[int, int]:
    """(d, c) for a set of n: a linked set lacks at most d of its shingles; so d + c first ones hold the first c common ones."""
    d = n + (-percent * n) // 100
    return d, max(1, min(d, n - d))


def prefix(n: int, percent: int) -> int:
    return sum(margin(n, percent))


def probes(shared: np.ndarray, n: int, percent: int) -> np.ndarray:
    """Of the shingles of a prefix that other prefixes have too, the first so many that hold the first common one.

    shared may be in any order, if it is the same for all documents. A linked set has at least `percent` of n shingles, so the two prefixes share its c at least; with fewer shared
    shingles than that, nothing links.
    """
    least = margin(-(-percent * n // 100), percent)[1]
    return shared[: max(0, len(shared) - least + 1)]


class Trie:
    """Ordered sets by shared beginnings. A node: shared run of names, members' range in sorted order, sizes, children."""

    def __init__(self, sets: list[np.ndarray]):
        big = [s.astype(">u8").tobytes() for s in sets]
        self.order = sorted(range(len(sets)), key=big.__getitem__)
        self.sets = [sets[i] for i in self.order]
        self.root = self.node(0, len(sets), 0)

    def node(self, lo: int, hi: int, depth: int):
        first, last = self.sets[lo], self.sets[hi - 1]
        sizes = [len(s) for s in self.sets[lo:hi]]
        if hi - lo == 1:
            return first[depth:], lo, hi, sizes[0], sizes[0], len(first), ()
        k = min(len(first), len(last)) - depth
        differ = np.flatnonzero(first[depth : depth + k] != last[depth : depth + k])
        end = depth + (int(differ[0]) if len(differ) else k)
        kids, at = [], lo
        while at < hi and len(self.sets[at]) == end:  # sets that end here
            kids.append(self.node(at, at + 1, end))
            at += 1
        while at < hi:
            stop = at + 1
            while stop < hi and self.sets[stop][end] == self.sets[at][end]:
                stop += 1
            kids.append(self.node(at, stop, end))
            at = stop
        return first[depth:end], lo, hi, min(sizes), max(sizes), end, kids

    def links(self, x: np.ndarray, percent: int, skip) -> Iterator[int]:
        """Members whose sets reach the threshold with x; skip(lo, hi) tells whether a range needs no visit (asked anew at each)."""
        n = len(x)
        todo = [(self.root, 0, 0)]
        while todo:
            (run, lo, hi, least, most, depth, kids), at, overlap = todo.pop()
            if skip(lo, hi):
                continue
            if len(run):
                place = np.searchsorted(x, run)
                overlap += int((x[np.minimum(place, n - 1)] == run).sum())
                at = int(np.searchsorted(x, run[-1], side="right"))
            if (100 + percent) * (overlap + min(n - at, most - depth)) < percent * (n + least):
                continue
            if not kids:
                yield lo
            else:
                todo.extend((kid, at, overlap) for kid in reversed(kids))


class Merger:
    """Union-find over one block."""

    def __init__(self, labels):
        first: dict = {}
        self.up = [first.setdefault(x, i) for i, x in enumerate(labels)]

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i


def block_links(pdf: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Links that connect what is connected within a block. Rows: doc_id, part (0: stored, 1: only asks), label, data."""
    pdf = pdf.drop_duplicates(["doc_id", "part", "data"])  # a document may be stored in the block it asks
    ids, part = pdf["doc_id"].to_numpy(), pdf["part"].to_numpy()
    sets = [np.frombuffer(x, dtype=np.uint64) for x in pdf["data"]]
    stored = np.flatnonzero(part == 0)
    out: list[tuple[int, int]] = []
    if len(stored) and len(ids) > 1:
        trie, group = Trie([sets[i] for i in stored]), Merger(pdf["label"].tolist())
        member = [int(stored[i]) for i in trie.order]
        asks = range(len(ids)) if (part == 0).all() else np.flatnonzero(part == 1).tolist()
        for i in asks:
            def skip(lo: int, hi: int, i=i) -> bool:
                mine = group.find(i)
                return all(group.find(m) == mine for m in member[lo:hi])

            for k in trie.links(sets[i], percent, skip):
                a, b = group.find(i), group.find(member[k])
                if a != b:
                    group.up[max(a, b)] = min(a, b)
                    out.append((int(ids[i]), int(ids[member[k]])))
    return pd.DataFrame(out, columns=["a", "b"])


def jaccard_components(docs: DataFrame, n: int = 3, percent: int = 90, lower: bool = True, shards: int | None = None) -> DataFrame:
    """Groups documents linked by Jaccard similarity of their n-word shingle sets: percent * |union| <= 100 * |intersection|.

    docs: doc_id (whole number), text; other columns are ignored. Words are maximal runs of bytes other than ASCII white
    space, A-Z lower-cased if lower. A text shorter than n words is one shingle as a whole. Returns doc_id, n_shingles,
    component_id (the smallest doc_id reachable by links, itself included).

    A null or empty text has no shingles and links with nothing. Rows with one doc_id are one document with the links of
    all of them; each gives a row. A null doc_id links with nothing and gets a null component. Empty tables give empty ones.
    """
    with cleaned_up(docs.sparkSession):  # counts on the way leave shuffle files, too
        return components_of(docs, n, percent, lower, shards)


def components_of(docs: DataFrame, n: int, percent: int, lower: bool, shards: int | None) -> DataFrame:
    rows = docs.select(whole_id("doc_id"), F.col("text").cast("string").alias("text"))
    counts, size = word_counts(rows, lower)
    shards = shards or shards_for(docs, size)
    buckets = -(-shards // 2)
    cost = np.minimum(np.log2(1 + counts) / max(1.0, np.log2(1 + counts.max())) * ((1 << RANK_BITS) - 1), (1 << RANK_BITS) - 1)
    by_shard = packed_texts(rows, shards).groupBy("shard")

    def sets_of(pdf: pd.DataFrame, wanted: set) -> Iterator[tuple[int, np.ndarray]]:
        for ids, texts in documents(pdf["docs"]):
            at = [i for i, x in enumerate(ids.tolist()) if x in wanted]
            if at:
                yield from zip(ids[at].tolist(), ordered_sets([texts[i] or b"" for i in at], n, lower, cost), strict=True)

    def fingerprints(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            texts, out = as_bytes(pdf["text"]), []
            with np.errstate(over="ignore"):
                for a, b in steps(texts):
                    for s in ordered_sets(texts[a:b], n, lower, cost):
                        out.append((len(s), *(int(mix(s, k).sum().astype(np.int64)) if len(s) else 0 for k in (1, 2))))
            got = pd.DataFrame(out, columns=["n_shingles", "f1", "f2"])
            yield got.assign(doc_id=pdf["doc_id"].to_numpy(), shard=shard_of(pdf["doc_id"].to_numpy(np.int64), shards))[["doc_id", "n_shingles", "f1", "f2", "shard"]]

    prints = keep(nullable_id(rows.mapInPandas(fingerprints, "doc_id long, n_shingles long, f1 long, f2 long, shard int"), "doc_id"))
    meant = F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0)
    same = keep(prints.where(meant).groupBy("n_shingles", "f1", "f2").agg(F.min("doc_id").alias("rep"), F.min_by("shard", "doc_id").alias("shard"), F.count("*").alias("copies")))
    reps = same.select("shard", F.col("rep").alias("doc_id"))

    def first_shingles(pdf: pd.DataFrame, chosen: pd.DataFrame) -> pd.DataFrame:
        names, who = [np.empty(0, dtype=np.uint64)], [np.empty(0, dtype=np.uint64)]
        for doc, s in sets_of(pdf, set(chosen["doc_id"])):
            p = s[: prefix(len(s), percent)]
            names.append(p)
            who.append(np.full(len(p), doc, dtype=np.int64).view(np.uint64))
        if len(names) == 1:
            return pd.DataFrame(columns=["bucket", "shard", "n", "data"])
        (names,), low, high, count = lowest([np.concatenate(names)], np.concatenate(who).view(np.int64))
        return packed([names], low.view(np.uint64), high.view(np.uint64), int(pdf["shard"].iloc[0]), buckets, mix(names, 3), eighths(count))

    def leaders(pdf: pd.DataFrame) -> pd.DataFrame:
        names, low, high = opened(pdf["n"], pdf["data"], 1)
        held = np.exp2(np.concatenate([np.frombuffer(x, dtype=np.uint8, offset=24 * k) for k, x in zip(pdf["n"], pdf["data"], strict=True)]) / 8)
        low, high = low.view(np.int64), high.view(np.int64)
        shard = np.repeat(pdf["shard"].to_numpy(), pdf["n"])
        order = np.argsort(names, kind="stable")
        names, low, high, shard, held = names[order], low[order], high[order], shard[order], held[order]
        at = np.flatnonzero(np.concatenate(([True], names[1:] != names[:-1])))
        count = np.diff(np.append(at, len(names)))
        least, most = np.repeat(np.minimum.reduceat(low, at), count), np.repeat(np.maximum.reduceat(high, at), count)
        back = least < most
        often = np.repeat(eighths(np.add.reduceat(held, at)), count)
        names, least, shard, often = names[back], least[back].view(np.uint64), shard[back], often[back]
        order = np.argsort(shard, kind="stable")
        found, at = np.unique(shard[order], return_index=True)
        cut = np.append(at, len(order))
        return pd.DataFrame([(int(s), int(b - a), b"".join(x[order[a:b]].tobytes() for x in (names, least, often))) for s, a, b in zip(found, cut[:-1], cut[1:], strict=True)], columns=["shard", "n", "data"])

    back = by_shard.cogroup(reps.groupBy("shard")).applyInPandas(first_shingles, "bucket int, shard int, n int, data binary").groupBy("bucket").applyInPandas(leaders, "shard int, n int, data binary")
    # names have no id; NO_ID keeps the column whole, as a null would make floats of all ids
    told = back.select("shard", "n", "data", F.lit(int(NO_ID)).alias("doc_id")).unionByName(reps.select("shard", F.lit(0).alias("n"), F.lit(None).cast("binary").alias("data"), "doc_id"))

    def groups(pdf: pd.DataFrame, back: pd.DataFrame) -> pd.DataFrame:
        mine = back[back["data"].isna()]
        back = back[back["data"].notna()]
        out = []
        if len(pdf) and len(back):
            parts = [(np.frombuffer(x, dtype=np.uint64, count=2 * k), np.frombuffer(x, dtype=np.uint8, offset=16 * k)) for k, x in zip(back["n"], back["data"], strict=True)]
            known, least = (np.concatenate([x[i * len(o) : (i + 1) * len(o)] for x, o in parts]) for i in (0, 1))
            often = np.concatenate([o for _, o in parts])
            order = np.argsort(known)
            known, least, often = known[order], least[order].view(np.int64), often[order]
            for doc, s in sets_of(pdf, set(mine["doc_id"])):
                p = s[: prefix(len(s), percent)]
                at = np.minimum(np.searchsorted(known, p), len(known) - 1)
                at = at[known[at] == p]
                at = at[np.argsort(often[at], kind="stable")]  # the same order for all documents: how often, then name
                out += [(int(doc), int(x)) for x in np.unique(probes(least[at], len(s), percent))]
        got = pd.DataFrame(out, columns=["doc_id", "leader"])
        got["shard"] = pdf["shard"].iloc[0] if len(pdf) else 0
        return got

    member = keep(by_shard.cogroup(told.groupBy("shard")).applyInPandas(groups, "doc_id long, leader long, shard int").distinct())
    many = keep(member.groupBy("leader").agg(F.count("*").alias("members")).where("members > 1"))
    dealt = keep(join_by_size(member, many, ["leader"], "members").withColumn("block", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.ceil(F.col("members") / BLOCK)).cast("int")))

    def asked(table: DataFrame) -> DataFrame:
        """The sets for rows of (shard, doc_id, grp, part, label)."""

        def send(pdf: pd.DataFrame, rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
            to: dict[int, list] = {}
            for doc, grp, part, label in zip(rows["doc_id"], rows["grp"], rows["part"], rows["label"], strict=True):
                to.setdefault(doc, []).append((grp, part, label))
            out = [(grp, int(doc), part, label, s.tobytes()) for doc, s in sets_of(pdf, set(to)) for grp, part, label in to[doc]]
            return pd.DataFrame(out, columns=["grp", "doc_id", "part", "label", "data"])

        return by_shard.cogroup(table.groupBy("shard")).applyInPandas(send, "grp string, doc_id long, part int, label long, data binary")

    def linked(sets: DataFrame) -> DataFrame:
        return sets.groupBy("grp").applyInPandas(lambda pdf: block_links(pdf, percent), "a long, b long")

    blocks = dealt.select("leader", "block").where("members > " + str(BLOCK)).distinct()
    leader_at = blocks.join(reps.select(F.col("doc_id").alias("leader"), "shard"), "leader").select("shard", F.col("leader").alias("doc_id"), "leader", "block")
    first = dealt.select("shard", "doc_id", "leader", "block").unionByName(leader_at).distinct()
    first = first.select("shard", "doc_id", F.concat_ws("/", "leader", "block").alias("grp"), F.lit(0).alias("part"), F.col("doc_id").alias("label"))
    links = keep(linked(asked(first)))

    large = dealt.where(F.col("members") > BLOCK).select("shard", "doc_id", "leader", "block", "members")
    if large.limit(1).count():
        comp = components(links).withColumnRenamed("id", "doc_id")
        large = keep(large.join(comp, "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id")))
        share = large.groupBy("leader", "component").agg(F.count("*").alias("k"))
        # of each group still apart: its largest component, and how many blocks the documents outside of it make
        top = share.groupBy("leader").agg(F.max(F.struct("k", F.col("component").alias("top"))).alias("t"), F.sum("k").alias("held"), F.count("*").alias("parts")).where("parts > 1")
        top = keep(top.select("leader", "t.top", "held", F.ceil((F.col("held") - F.col("t.k")) / BLOCK).cast("int").alias("askers")))
        minor = keep(join_by_size(large, top, ["leader"], "held").drop("held"))
        stored = minor.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("askers") - 1))).select("shard", "doc_id", F.concat_ws("/", "leader", "block", "j").alias("grp"), F.lit(0).alias("part"), F.col("component").alias("label"))
        asks = minor.where("component <> top").withColumn("j", F.pmod(F.xxhash64("doc_id", F.lit(2)), "askers"))
        asks = asks.withColumn("block", F.explode(F.sequence(F.lit(0), F.ceil(F.col("members") / BLOCK).cast("int") - 1)))
        asks = asks.select("shard", "doc_id", F.concat_ws("/", "leader", "block", "j").alias("grp"), F.lit(1).alias("part"), F.col("component").alias("label"))
        links = links.unionByName(linked(asked(stored.unionByName(asks))))

    comp = components(links)
    of = keep(same.join(comp, same["rep"] == comp["id"], "left").select("n_shingles", "f1", "f2", "copies", F.coalesce("component", "rep").alias("component_id")))
    # copies of one text may be a large part of all rows, and so may empty texts, which need no join
    linked_rows = join_by_size(prints.where(meant), of, ["n_shingles", "f1", "f2"], "copies")
    out = linked_rows.select("doc_id", "n_shingles", "component_id")
    return out.unionByName(prints.where(~meant).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
