"""Entity graph: nodes, edges, reference resolution, chains, reverse lookups, bounded expansion.

Keys compare without case; the first of equals (smallest ord) wins. Requests are tables: a lookup is a join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattis.session import keep

# Fixed values: (child tag or `self`, attribute, relation, whether the attribute names a file).
EDGE_RULES = [
    ("self", "file", "extends", True), ("self", "transform_on_consume", "transforms_to", False), ("projectile", "file", "fires", True),
    ("call", "file", "includes", True), ("next_in_chain", "key", "next_in_chain", False), ("weapon", "file", "references", True),
]


def build_nodes(elements: DataFrame) -> DataFrame:
    """(key, type, file, name, mod, ord): keyed elements, the first of a key and file. elements: package, file, ord, tag, attrs (map), root_type."""
    base = F.element_at(F.split("file", "/"), -1)
    a = F.col("attrs")
    rows = elements.select(F.coalesce(a["key"], a["name"], a["filename"], base).alias("key"), F.coalesce("root_type", F.element_at(F.split(base, r"\."), -1)).alias("type"), "file", a["name"].alias("name"), F.col("package").alias("mod"), "ord")
    first = rows.groupBy("key", "file").agg(F.min_by(F.struct("type", "name", "mod", "ord"), "ord").alias("n"))
    return first.select("key", "n.type", "file", "n.name", "n.mod", "n.ord")


def extract_edges(elements: DataFrame) -> DataFrame:
    """(from, from_file, target, is_file, rel, mod, ord) of elements and their children. elements: package, file, ord, key, attrs (map), children (array of tag and attrs)."""
    none = F.lit(None).cast("struct<target:string,is_file:boolean,rel:string>")

    def edge(value: Column, rel: str, is_file: bool) -> Column:
        return F.when(F.trim(value) != "", F.struct(value.alias("target"), F.lit(is_file).alias("is_file"), F.lit(rel).alias("rel"))).otherwise(none)

    own = [edge(F.col("attrs")[attr], rel, is_file) for tag, attr, rel, is_file in EDGE_RULES if tag == "self"]

    def of_child(c: Column) -> Column:
        return F.coalesce(*[F.when(c["tag"] == tag, edge(c["attrs"][attr], rel, is_file)) for tag, attr, rel, is_file in EDGE_RULES if tag != "self"], none)

    every = F.filter(F.concat(F.array(*own), F.transform("children", of_child)), lambda e: e.isNotNull())
    rows = elements.select(F.coalesce("key", F.element_at(F.split("file", "/"), -1)).alias("from"), F.col("file").alias("from_file"), F.col("package").alias("mod"), "ord", F.posexplode(every).alias("pos", "e"))
    return rows.select("from", "from_file", "e.target", "e.is_file", "e.rel", "mod", F.struct("ord", "pos").alias("ord"))


def tidy(path: Column) -> Column:
    """A path without empty and `.` steps; each `..` takes the step before it, if there is one."""
    steps = F.filter(F.split(path, "/"), lambda x: ~x.isin("", "."))
    up = lambda done: (F.size(done) > 0) & (F.coalesce(F.try_element_at(done, F.lit(-1)), F.lit("..")) != "..")
    fold = F.aggregate(steps, F.array().cast("array<string>"), lambda done, x: F.when((x == "..") & up(done), F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.array_append(done, x)))
    return F.array_join(fold, "/")


def resolve_refs(edges: DataFrame, files: DataFrame) -> DataFrame:
    """Edges with `to` (the key of the file that a reference names, else the reference) and to_mod.

    A file is looked for beside the referring one, in its package, then in the data root. edges: ..., from_file,
    package_dir, target, is_file, ord; files: path, key, package.
    """
    folder = F.regexp_replace("from_file", "/[^/]*$", "")
    tries = F.array(*[tidy(F.concat(root, F.lit("/"), F.col("target"))) for root in (folder, F.col("package_dir"))], tidy(F.col("target")))
    tried = edges.where("is_file").select("ord", F.posexplode(tries).alias("cand_ord", "path"))
    hit = tried.join(files, "path").groupBy("ord").agg(F.min_by(F.struct("key", "package"), "cand_ord").alias("f"))
    rows = edges.join(hit, "ord", "left")
    return rows.withColumn("to", F.coalesce("f.key", "target")).withColumn("to_mod", F.col("f.package")).drop("f")


def dedup_edges(edges: DataFrame) -> DataFrame:
    """The first edge of each (from, to, rel, mod, to_mod), nulls equal."""
    return edges.groupBy("from", "to", "rel", "mod", "to_mod").agg(F.min("ord").alias("ord"))


def first_nodes(nodes: DataFrame, *extra: str) -> DataFrame:
    """The first node of a key (and package): low, extra, node."""
    return nodes.withColumn("low", F.lower("key")).groupBy("low", *extra).agg(F.min_by(F.struct("key", "type", "file", "mod"), "ord").alias("node"))


def lookup_nodes(requests: DataFrame, nodes: DataFrame) -> DataFrame:
    """(rid, file, type, mod, elsewhere): the node of a key in the package asked for (null: any); elsewhere: other packages, sorted, if there is none."""
    low = requests.select("rid", F.lower("key").alias("low"), "mod")
    scoped = low.where("mod is not null").join(first_nodes(nodes, "mod"), ["low", "mod"]).select("rid", "node")
    free = low.where("mod is null").join(first_nodes(nodes), "low").select("rid", "node")
    packages = nodes.groupBy(F.lower("key").alias("low")).agg(F.sort_array(F.collect_set("mod")).alias("mods"))
    rows = low.join(scoped.unionByName(free), "rid", "left").join(packages, "low", "left")
    other = F.when(F.col("node").isNull(), F.array_join(F.filter("mods", lambda m: ~m.eqNullSafe(F.col("mod"))), ","))
    return rows.select("rid", "node.file", "node.type", F.col("node.mod").alias("mod"), other.alias("elsewhere"))


def edge_targets(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with target_mod, target_file and ambiguous_in.

    The package an edge is pinned to, then its own, then the only candidate; several candidates are listed, none is null.
    """
    by_mod = first_nodes(nodes, "mod")
    every = nodes.groupBy(F.lower("key").alias("low")).agg(F.count("*").alias("n"), F.min_by(F.struct("key", "type", "file", "mod"), "ord").alias("only"), F.sort_array(F.collect_set("mod")).alias("mods"))
    rows = edges.withColumn("low", F.lower("to"))
    rows = rows.join(by_mod.select("low", F.col("mod").alias("to_mod"), F.col("node").alias("pinned")), ["low", "to_mod"], "left")
    rows = rows.join(by_mod.select("low", "mod", F.col("node").alias("scoped")), ["low", "mod"], "left").join(every, "low", "left")
    node = F.coalesce("pinned", "scoped", F.when(F.col("n") == 1, F.col("only")))
    unclear = F.when(node.isNull() & (F.col("n") > 1), F.array_join("mods", ","))
    return rows.select("ord", "from", "to", "rel", "mod", "to_mod", node["mod"].alias("target_mod"), node["file"].alias("target_file"), unclear.alias("ambiguous_in"))


def ancestor_chain(requests: DataFrame, targets: DataFrame, most: int = 15) -> DataFrame:
    """(rid, key, mod, depth, ambiguous_in): chain_above() for each request (rid, key, mod), walked once for equal ones."""
    asked = requests.select("rid", F.lower("key").alias("start"), F.col("mod").alias("scope"))
    starts = asked.select(F.struct("start", "scope").alias("rid"), F.col("start").alias("key"), F.col("scope").alias("mod")).distinct()
    chain = chain_above(starts, targets, most).withColumnRenamed("rid", "s")
    on = (asked["start"] == chain["s"]["start"]) & asked["scope"].eqNullSafe(chain["s"]["scope"])
    return asked.join(chain, on).select("rid", "key", "mod", "depth", "ambiguous_in")


def chain_above(requests: DataFrame, targets: DataFrame, most: int = 15) -> DataFrame:
    """(rid, key, mod, depth, ambiguous_in): layers above each request, breadth first.

    requests: rid, key, mod; targets: edge_targets() of the `extends` edges. A key is visited once for a request,
    whatever its package; of edges to it in one step the smallest ord counts. A hop follows the package it landed in; an
    ambiguous target is told and not followed. Each step is written to the checkpoint folder.
    """
    up = keep(targets.where("rel = 'extends'").select(F.lower("from").alias("low"), F.col("mod").alias("at"), "ord", "to", "ambiguous_in", F.coalesce("target_mod", "to_mod", "mod").alias("next")))
    front = requests.select("rid", F.lower("key").alias("low"), F.col("mod").alias("at"), F.lit(0).alias("depth"))
    seen, out = front, front.select("rid", F.col("low").alias("key"), F.col("at").alias("mod"), "depth", F.lit(None).cast("string").alias("ambiguous_in"))
    for depth in range(1, most + 1):
        step = front.drop("depth").join(up, ["low", "at"])
        unclear = step.where("ambiguous_in is not null").select("rid", F.lower("to").alias("key"), F.lit(None).cast("string").alias("mod"), F.lit(depth).alias("depth"), "ambiguous_in").distinct()
        new = step.where("ambiguous_in is null").groupBy("rid", F.lower("to").alias("low")).agg(F.min_by("next", "ord").alias("at"))
        front = keep(new.join(seen.select("rid", "low"), ["rid", "low"], "left_anti").withColumn("depth", F.lit(depth)))
        out = out.unionByName(unclear).unionByName(front.select("rid", F.col("low").alias("key"), F.col("at").alias("mod"), "depth", F.lit(None).cast("string").alias("ambiguous_in")))
        if not front.limit(1).count():
            break
        seen = seen.unionByName(front)
    return out


def parents_children(requests: DataFrame, targets: DataFrame) -> DataFrame:
    """(rid, side, key, mod, n): direct parents and children by `extends`, in the package asked for. requests: rid, key, mod."""
    low = requests.select("rid", F.lower("key").alias("low"), F.col("mod").alias("scope"))
    edges = targets.where("rel = 'extends'")
    up = low.join(edges, (F.lower("from") == F.col("low")) & F.coalesce(F.col("mod") == F.col("scope"), F.lit(True)))
    up = up.where("target_file is not null or ambiguous_in is not null").select("rid", F.lit("parent").alias("side"), F.col("to").alias("key"), F.coalesce("target_mod", "ambiguous_in").alias("mod"))
    down = low.join(edges, (F.lower("to") == F.col("low")) & F.coalesce(F.col("mod") == F.col("scope"), F.lit(True))).select("rid", F.lit("child").alias("side"), F.col("from").alias("key"), "mod")
    return up.unionByName(down).groupBy("rid", "side", "key", "mod").agg(F.count("*").alias("n"))


def successor_chain(requests: DataFrame, successors: DataFrame, most: int = 50) -> DataFrame:
    """(rid, key, depth): each request's chain along single successors (key, next, ord; the first of a key counts), cycle-safe.

    Pointers are doubled: after k joins a key knows its successors up to 2**k away, so a chain of 50 takes 6 joins.
    """
    one = successors.groupBy("key").agg(F.min_by("next", "ord").alias("next"))
    path = one.select("key", F.array("next").alias("path"))
    size = 1
    while size < most:
        path = keep(path.alias("a").join(path.alias("b"), F.element_at("a.path", -1) == F.col("b.key"), "left").select("a.key", F.concat("a.path", F.coalesce("b.path", F.array().cast(dict(one.dtypes)["next"].join(("array<", ">"))))).alias("path")))
        size *= 2
    rows = requests.join(path, "key", "left").select("rid", F.concat(F.array("key"), F.coalesce("path", F.array().cast(dict(one.dtypes)["next"].join(("array<", ">"))))).alias("p"))
    # the chain ends before a key comes again
    cut = F.aggregate(F.slice("p", 1, most), F.struct(F.array().cast(rows.schema["p"].dataType).alias("seen"), F.lit(False).alias("stop")), lambda s, k: F.when(s["stop"] | F.array_contains(s["seen"], k), F.struct(s["seen"].alias("seen"), F.lit(True).alias("stop"))).otherwise(F.struct(F.array_append(s["seen"], k).alias("seen"), F.lit(False).alias("stop"))))
    return rows.select("rid", F.posexplode(cut["seen"]).alias("depth", "key"))


def references(requests: DataFrame, edges: DataFrame, most: int = 15) -> DataFrame:
    """(rid, referenced_by, references, withheld, first_by, first_to): counts, and the first `most` keys of each side.

    requests: rid, key, mod (null: any package); withheld counts edges to the key from other packages.
    """
    low = requests.select("rid", F.lower("key").alias("low"), F.col("mod").alias("scope"))
    inside = F.coalesce(F.col("mod") == F.col("scope"), F.lit(True))
    by = low.join(edges, F.lower("to") == F.col("low")).select("rid", F.lit("by").alias("side"), F.col("from").alias("key"), "ord", inside.alias("inside"))
    to = low.join(edges, F.lower("from") == F.col("low")).where(inside).select("rid", F.lit("to").alias("side"), F.col("to").alias("key"), "ord", F.lit(True).alias("inside"))
    rows = by.unionByName(to)
    order = Window.partitionBy("rid", "side", "inside").orderBy("ord", "key")
    rows = rows.withColumn("k", F.row_number().over(order))
    shown = lambda side: F.array_join(F.transform(F.sort_array(F.collect_list(F.when((F.col("side") == side) & F.col("inside") & (F.col("k") <= most), F.struct("k", "key")))), lambda x: x["key"]), ",")
    n = lambda c: F.count_if(c)
    got = rows.groupBy("rid").agg(n((F.col("side") == "by") & F.col("inside")).alias("referenced_by"), n(F.col("side") == "to").alias("references"), n(~F.col("inside")).alias("withheld"), shown("by").alias("first_by"), shown("to").alias("first_to"))
    return requests.select("rid").join(got, "rid", "left").fillna(0).fillna("")


def glob_nodes(requests: DataFrame, nodes: DataFrame, most: int = 15) -> DataFrame:
    """(rid, total, withheld, keys): nodes whose file or key fits a glob anywhere, without case, of a type and package (null: any).

    requests: rid, pattern, type, mod: a batch of bounded size, broadcast up to 10,000 rows.
    """
    escaped = F.regexp_replace("pattern", r"([.+?^${}()|\[\]\\])", r"\\$1")
    asked = requests.select("rid", F.concat(F.lit("(?i)"), F.replace(escaped, F.lit("*"), F.lit(".*"))).alias("regex"), F.col("type").alias("want"), F.col("mod").alias("scope"))
    asked = F.broadcast(asked) if requests.limit(10_001).count() <= 10_000 else asked
    hit = nodes.join(asked, F.expr("(file rlike regex or key rlike regex) and coalesce(type = want, true)"))
    inside = F.coalesce(F.col("mod") == F.col("scope"), F.lit(True))
    hit = hit.withColumn("inside", inside).withColumn("k", F.row_number().over(Window.partitionBy("rid", "inside").orderBy("ord")))
    keys = F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("inside") & (F.col("k") <= most), F.struct("k", "key")))), lambda x: x["key"]), ",")
    got = hit.groupBy("rid").agg(F.count_if("inside").alias("total"), F.count_if(~F.col("inside")).alias("withheld"), keys.alias("keys"))
    return requests.select("rid").join(got, "rid", "left").fillna(0).fillna("")


def shared_keys(nodes: DataFrame) -> DataFrame:
    """(key, packages): keys that more than one package defines."""
    return nodes.groupBy(F.lower("key").alias("key")).agg(F.count_distinct("mod").alias("packages")).where("packages > 1")


def graph_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(what, kind, n): nodes by type, edges by relation, files; a null kind is the total."""
    n = nodes.rollup("type").agg(F.count("*").alias("n")).select(F.lit("nodes").alias("what"), F.col("type").alias("kind"), "n")
    e = edges.rollup("rel").agg(F.count("*").alias("n")).select(F.lit("edges").alias("what"), F.col("rel").alias("kind"), "n")
    files = nodes.agg(F.count_distinct("file").alias("n")).select(F.lit("files").alias("what"), F.lit(None).cast("string").alias("kind"), "n")
    return n.unionByName(e).unionByName(files)


def bounded_bfs(seeds: DataFrame, edges: DataFrame, known: DataFrame, depth: int = 4, cap: int = 20, done: DataFrame | None = None) -> DataFrame:
    """(rid, key, depth, pos, unresolved): breadth-first expansion of each seed set, at most `cap` nodes of it.

    seeds: rid, key, ord; edges: from, to, ord; known: key. Nodes come in the order of their parents, then of the edges;
    a key without a record is kept as unresolved and not expanded. With the result of an earlier walk (done), its nodes are
    not met again and count against the cap; the result holds both walks.
    """
    front = seeds.groupBy("rid", "key").agg(F.min("ord").alias("at")).withColumn("at", F.array(F.col("at").cast("long")))
    out, level = done, 1
    while True:
        place = Window.partitionBy("rid").orderBy("at", "key")
        if out is None:
            new = front.withColumn("before", F.lit(0).cast("long"))
        else:
            have = out.groupBy("rid").agg(F.count("*").alias("before"))
            new = front.join(out.select("rid", "key"), ["rid", "key"], "left_anti").join(have, "rid", "left").na.fill(0, ["before"])
        new = new.withColumn("pos", F.col("before") + F.row_number().over(place) - 1).where(F.col("pos") < cap)
        flags = new.join(known.select("key").distinct().withColumn("has", F.lit(True)), "key", "left")
        new = keep(flags.select("rid", "key", F.lit(level).alias("depth"), "pos", F.col("has").isNull().alias("unresolved")))
        out = new if out is None else keep(out.unionByName(new))
        if level == depth or not new.limit(1).count():
            return out
        step = new.where("not unresolved").join(edges, F.col("key") == F.col("from")).select("rid", F.col("to").alias("key"), F.array(F.col("pos").cast("long"), F.col("ord").cast("long")).alias("at"))
        front = step.groupBy("rid", "key").agg(F.min("at").alias("at"))
        level += 1
