"""Entity graph, G1 to G14, over parts, orders and pages.

Nodes are parts: key p_name, package p_brand, type p_type, file p_brand/p_partkey, order p_partkey. Part k extends part
k div 4 in that part's package, which is left open for k mod 7 = 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattis.operators import graph as G
from lattis.plans.common import table, values_sql


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_name").alias("key"), F.col("p_type").alias("type"), F.concat("p_brand", F.lit("/"), F.col("p_partkey").cast("string")).alias("file"), F.col("p_brand").alias("mod"), F.col("p_partkey").alias("ord"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    a, b = p.alias("a"), p.alias("b")
    up = a.join(b, F.floor(F.col("a.p_partkey") / 4) == F.col("b.p_partkey"))
    return up.select(F.col("a.p_partkey").alias("ord"), F.col("a.p_name").alias("from"), F.col("b.p_name").alias("to"), F.lit("extends").alias("rel"), F.col("a.p_brand").alias("mod"), F.when(F.col("a.p_partkey") % 7 != 0, F.col("b.p_brand")).alias("to_mod"))


N_SQL = "(SELECT p_name AS key, p_type AS type, p_brand || '/' || p_partkey AS file, p_brand AS mod, p_partkey AS ord FROM part)"
E_SQL = "(SELECT a.p_partkey AS ord, a.p_name AS f, b.p_name AS t, 'extends' AS rel, a.p_brand AS mod, CASE WHEN a.p_partkey % 7 <> 0 THEN b.p_brand END AS to_mod FROM part a JOIN part b ON a.p_partkey // 4 = b.p_partkey)"
TARGETS = f"""
n AS {N_SQL}, e AS {E_SQL},
m AS (SELECT lower(key) AS low, mod, arg_min(file, ord) AS file FROM n GROUP BY 1, 2),
y AS (SELECT lower(key) AS low, count(*) AS k, arg_min(mod, ord) AS mod, arg_min(file, ord) AS file, string_agg(DISTINCT mod, ',' ORDER BY mod) AS mods FROM n GROUP BY 1),
tg AS (SELECT e.ord, f, t, rel, e.mod, to_mod, CASE WHEN p.low IS NOT NULL THEN p.mod WHEN s.low IS NOT NULL THEN s.mod WHEN y.k = 1 THEN y.mod END AS target_mod,
   CASE WHEN p.low IS NOT NULL THEN p.file WHEN s.low IS NOT NULL THEN s.file WHEN y.k = 1 THEN y.file END AS target_file, CASE WHEN p.low IS NULL AND s.low IS NULL AND y.k > 1 THEN y.mods END AS ambiguous_in
   FROM e LEFT JOIN m p ON p.low = lower(t) AND p.mod = to_mod LEFT JOIN m s ON s.low = lower(t) AND s.mod = e.mod LEFT JOIN y ON y.low = lower(t))"""


def elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as elements with attributes and children: keys missing by turns, references to files and keys."""
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    attrs = F.map_filter(F.create_map(F.lit("key"), F.when(k % 3 == 0, F.col("p_name")), F.lit("name"), F.when(k % 4 == 0, F.concat(F.lit("name "), "p_type")), F.lit("file"), F.when(k % 2 == 0, F.concat(F.floor(k / 4).cast("string"), F.lit(".xml"))), F.lit("transform_on_consume"), F.when(k % 5 == 0, F.col("p_type"))), lambda _, v: v.isNotNull())
    child = lambda tag, attr, v: F.struct(F.lit(tag).alias("tag"), F.create_map(F.lit(attr), v).alias("attrs"))
    children = F.array(child("projectile", "file", F.when(k % 7 == 0, F.lit("shot.xml"))), child("next_in_chain", "key", F.col("p_name")), child("sound", "file", F.lit("x.wav")), child("weapon", "file", F.when(k % 3 == 1, F.lit("  ")).otherwise(F.lit("w.xml"))))
    return p.select(F.col("p_brand").alias("package"), F.concat("p_brand", F.lit("/"), (k % 50).cast("string"), F.lit(".xml")).alias("file"), k.alias("ord"), F.col("p_type").alias("tag"), attrs.alias("attrs"), F.when(k % 6 == 0, "weapon").alias("root_type"), attrs["key"].alias("key"), children.alias("children"))


def g1_build_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.build_nodes(elements(spark, sf_dir))


G1_SQL = """
WITH e AS (SELECT p_brand AS mod, p_brand || '/' || (p_partkey % 50) || '.xml' AS file, p_partkey AS ord, CASE WHEN p_partkey % 4 = 0 THEN 'name ' || p_type END AS name,
 CASE WHEN p_partkey % 3 = 0 THEN p_name WHEN p_partkey % 4 = 0 THEN 'name ' || p_type ELSE (p_partkey % 50) || '.xml' END AS key, CASE WHEN p_partkey % 6 = 0 THEN 'weapon' ELSE 'xml' END AS type FROM part)
SELECT key, type, file, name, mod, ord FROM e QUALIFY row_number() OVER (PARTITION BY key, file ORDER BY ord) = 1
"""


def g2_extract_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.extract_edges(elements(spark, sf_dir)).select(F.col("from").alias("src"), "from_file", "target", "is_file", "rel", "mod", F.col("ord.ord").alias("ord"))


G2_SQL = """
WITH e AS (SELECT *, p_brand || '/' || (p_partkey % 50) || '.xml' AS file, CASE WHEN p_partkey % 3 = 0 THEN p_name ELSE (p_partkey % 50) || '.xml' END AS src FROM part),
x AS (SELECT src, file, p_brand AS mod, p_partkey AS ord, unnest([{'t': CASE WHEN p_partkey % 2 = 0 THEN (p_partkey // 4) || '.xml' END, 'f': true, 'r': 'extends'}, {'t': CASE WHEN p_partkey % 5 = 0 THEN p_type END, 'f': false, 'r': 'transforms_to'},
 {'t': CASE WHEN p_partkey % 7 = 0 THEN 'shot.xml' END, 'f': true, 'r': 'fires'}, {'t': p_name, 'f': false, 'r': 'next_in_chain'}, {'t': CASE WHEN p_partkey % 3 <> 1 THEN 'w.xml' END, 'f': true, 'r': 'references'}]) AS s FROM e)
SELECT src, file AS from_file, s.t AS target, s.f AS is_file, s.r AS rel, mod, ord FROM x WHERE s.t IS NOT NULL
"""


def g3_resolve_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References among part files: some beside, some in the package, some in the root, some nowhere."""
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    name = F.concat((k % 50).cast("string"), F.lit(".xml"))
    place = F.when(k % 3 == 0, F.concat("p_brand", F.lit("/sub/"), name)).when(k % 3 == 1, F.concat("p_brand", F.lit("/"), name)).otherwise(name)
    files = p.select(place.alias("path"), F.col("p_name").alias("key"), F.col("p_brand").alias("package"), "p_partkey").groupBy("path").agg(F.min_by(F.struct("key", "package"), "p_partkey").alias("f")).select("path", "f.key", "f.package")
    target = F.when(k % 4 == 0, F.concat(F.lit("../"), ((k + 1) % 60).cast("string"), F.lit(".xml"))).otherwise(F.concat(((k + 1) % 60).cast("string"), F.lit(".xml")))
    refs = p.select(k.alias("ord"), F.concat("p_brand", F.lit("/sub/"), name).alias("from_file"), F.col("p_brand").alias("package_dir"), target.alias("target"), (k % 9 != 0).alias("is_file"))
    return G.resolve_refs(refs, files).select("ord", "to", "to_mod")


G3_SQL = r"""
WITH f AS (SELECT path, arg_min(key, k) AS key, arg_min(mod, k) AS mod FROM (SELECT CASE p_partkey % 3 WHEN 0 THEN p_brand || '/sub/' || (p_partkey % 50) || '.xml' WHEN 1 THEN p_brand || '/' || (p_partkey % 50) || '.xml' ELSE (p_partkey % 50) || '.xml' END AS path, p_name AS key, p_brand AS mod, p_partkey AS k FROM part) GROUP BY path),
r AS (SELECT p_partkey AS ord, p_brand AS b, p_partkey % 9 <> 0 AS is_file, ((p_partkey + 1) % 60) || '.xml' AS n, p_partkey % 4 = 0 AS up FROM part),
c AS (SELECT ord, is_file, CASE WHEN up THEN '../' ELSE '' END || n AS target, CASE WHEN up THEN b || '/' || n ELSE b || '/sub/' || n END AS c0, CASE WHEN up THEN n ELSE b || '/' || n END AS c1, CASE WHEN up THEN '../' || n ELSE n END AS c2 FROM r)
SELECT ord, coalesce(CASE WHEN is_file THEN coalesce(f0.key, f1.key, f2.key) END, target) AS "to", CASE WHEN is_file THEN coalesce(f0.mod, f1.mod, f2.mod) END AS to_mod
FROM c LEFT JOIN f f0 ON f0.path = c0 LEFT JOIN f f1 ON f1.path = c1 LEFT JOIN f f2 ON f2.path = c2
"""


def g4_dedup_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.dedup_edges(edges(spark, sf_dir)).select(F.col("from").alias("src"), F.col("to").alias("dst"), "rel", "mod", "to_mod", "ord")


G4_SQL = f"SELECT f AS src, t AS dst, rel, mod, to_mod, min(ord) AS ord FROM {E_SQL} GROUP BY ALL"


def scoped_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part asks for its key: in its package, in a fixed one, or in any."""
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(k.alias("rid"), F.upper("p_name").alias("key"), F.when(k % 3 == 0, F.col("p_brand")).when(k % 3 == 1, "Brand#11").alias("mod"))


R_SQL = "(SELECT p_partkey AS rid, lower(p_name) AS low, CASE WHEN p_partkey % 3 = 0 THEN p_brand WHEN p_partkey % 3 = 1 THEN 'Brand#11' END AS scope FROM part)"


def g5_lookup_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.lookup_nodes(scoped_requests(spark, sf_dir), nodes(spark, sf_dir))


G5_SQL = f"""
WITH {TARGETS}, r AS {R_SQL}
SELECT rid, x.file, x.type, x.mod, CASE WHEN x.file IS NULL THEN coalesce((SELECT string_agg(DISTINCT n.mod, ',' ORDER BY n.mod) FROM n WHERE lower(n.key) = low AND n.mod IS DISTINCT FROM scope), '') END AS elsewhere
FROM r LEFT JOIN LATERAL (SELECT arg_min(file, ord) AS file, arg_min(type, ord) AS type, arg_min(mod, ord) AS mod FROM n WHERE lower(n.key) = low AND (scope IS NULL OR n.mod = scope)) x ON true
"""


def targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.edge_targets(edges(spark, sf_dir), nodes(spark, sf_dir))


def g6_edge_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return targets(spark, sf_dir).select("ord", F.col("from").alias("src"), F.col("to").alias("dst"), "mod", "to_mod", "target_mod", "target_file", "ambiguous_in")


G6_SQL = f"WITH {TARGETS} SELECT ord, f AS src, t AS dst, mod, to_mod, target_mod, target_file, ambiguous_in FROM tg"


def g7_ancestor_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("rid"), F.col("p_name").alias("key"), F.col("p_brand").alias("mod"))
    return G.ancestor_chain(requests, targets(spark, sf_dir))


G7_SQL = f"""
WITH RECURSIVE {TARGETS},
up AS (SELECT lower(f) AS low, mod, ord, lower(t) AS t, ambiguous_in AS amb, coalesce(target_mod, to_mod, mod) AS nxt FROM tg),
w(rid, key, mod, depth) USING KEY (rid, key) AS (
  SELECT p_partkey, lower(p_name), p_brand, 0 FROM part
  UNION
  SELECT w.rid, up.t, arg_min(nxt, ord), w.depth + 1 FROM w JOIN up ON up.low = w.key AND up.mod = w.mod
  WHERE amb IS NULL AND w.depth < 15 AND NOT EXISTS (SELECT 1 FROM recurring.w r WHERE r.rid = w.rid AND r.key = up.t) GROUP BY w.rid, up.t, w.depth)
SELECT rid, key, mod, depth, NULL AS ambiguous_in FROM w
UNION ALL SELECT DISTINCT rid, up.t, NULL, depth + 1, amb FROM w JOIN up ON up.low = w.key AND up.mod = w.mod WHERE amb IS NOT NULL AND depth < 15
"""


def g8_parents_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests = table(spark, sf_dir, "part").select(F.col("p_name").alias("key"), F.col("p_brand").alias("mod")).distinct().select(F.concat_ws("/", "key", "mod").alias("rid"), "key", "mod")
    return G.parents_children(requests, targets(spark, sf_dir))


G8_SQL = f"""
WITH {TARGETS}, r AS (SELECT DISTINCT p_name || '/' || p_brand AS rid, lower(p_name) AS low, p_brand AS scope FROM part)
SELECT rid, 'parent' AS side, t AS key, coalesce(target_mod, ambiguous_in) AS mod, count(*) AS n FROM r JOIN tg ON lower(f) = low AND mod = scope WHERE target_file IS NOT NULL OR ambiguous_in IS NOT NULL GROUP BY ALL
UNION ALL SELECT rid, 'child', f, mod, count(*) FROM r JOIN tg ON lower(t) = low AND mod = scope GROUP BY ALL
"""


def g9_successor_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains of at most 12 along the next order of the same customer, from every order; each customer's last order leads back to the first."""
    o = table(spark, sf_dir, "orders")
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    nxt = F.coalesce(F.lead("o_orderkey").over(w), F.first("o_orderkey").over(w))
    succ = o.select(F.col("o_orderkey").alias("key"), nxt.alias("next"), F.lit(0).alias("ord"))
    return G.successor_chain(o.select(F.col("o_orderkey").alias("rid"), F.col("o_orderkey").alias("key")), succ, 12).select("rid", F.col("depth").cast("int").alias("depth"), "key")


G9_SQL = """
WITH c AS (SELECT o_custkey AS c, o_orderkey AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS i, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders)
SELECT a.k AS rid, CAST((b.i - a.i + a.n) % a.n AS INTEGER) AS depth, b.k AS key FROM c a JOIN c b ON a.c = b.c WHERE (b.i - a.i + a.n) % a.n < 12
"""


def supplier_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as references of parts to suppliers; the package is the line's return flag."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("from"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("to"), F.lit("references").alias("rel"), F.col("l_returnflag").alias("mod"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"))


def g10_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every supplier and part, in package R or any."""
    s, p = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "part")
    asked = s.select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("key"), F.when(F.col("s_suppkey") % 2 == 0, "R").alias("mod")).unionByName(p.select(F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("key"), F.when(F.col("p_partkey") % 2 == 0, "R").alias("mod")))
    return G.references(asked.withColumn("rid", F.lower("key")), supplier_edges(spark, sf_dir)).withColumnRenamed("references", "refs")


G10_SQL = """
WITH e AS (SELECT 'p' || l_partkey AS f, 's' || l_suppkey AS t, l_returnflag AS mod, l_orderkey * 10 + l_linenumber AS ord FROM lineitem),
r AS (SELECT 's' || s_suppkey AS rid, CASE WHEN s_suppkey % 2 = 0 THEN 'R' END AS scope FROM supplier UNION ALL SELECT 'p' || p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'R' END FROM part),
x AS (SELECT rid, 'by' AS side, f AS key, ord, scope IS NULL OR mod = scope AS ins FROM r JOIN e ON t = rid UNION ALL SELECT rid, 'to', t, ord, true FROM r JOIN e ON f = rid WHERE scope IS NULL OR mod = scope),
k AS (SELECT *, row_number() OVER (PARTITION BY rid, side, ins ORDER BY ord, key) AS k FROM x)
SELECT r.rid, count(*) FILTER (side = 'by' AND ins) AS referenced_by, count(*) FILTER (side = 'to') AS refs, count(*) FILTER (NOT ins) AS withheld,
 coalesce(string_agg(key, ',' ORDER BY k) FILTER (side = 'by' AND ins AND k <= 15), '') AS first_by, coalesce(string_agg(key, ',' ORDER BY k) FILTER (side = 'to' AND k <= 15), '') AS first_to
FROM r LEFT JOIN k USING (rid) GROUP BY r.rid
"""
GLOBS = [(0, "brand#1*/1*", None, None), (1, "a*e", None, "Brand#11"), (2, "GREEN", None, None), (3, "*", "STEEL", "Brand#21"), (4, "none.at(all", None, None)]


def g11_glob_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.glob_nodes(spark.createDataFrame(GLOBS, "rid int, pattern string, type string, mod string"), nodes(spark, sf_dir))


G11_SQL = rf"""
WITH g AS {values_sql(GLOBS, 'rid, pattern, want, scope')},
n AS {N_SQL},
h AS (SELECT rid, key, ord, scope IS NULL OR mod = scope AS ins FROM g JOIN n ON (regexp_matches(file, '(?i)' || replace(regexp_replace(pattern, '([.+?^${{}}()|\[\]\\])', '\\\1', 'g'), '*', '.*')) OR regexp_matches(key, '(?i)' || replace(regexp_replace(pattern, '([.+?^${{}}()|\[\]\\])', '\\\1', 'g'), '*', '.*'))) AND (want IS NULL OR type = want)),
k AS (SELECT *, row_number() OVER (PARTITION BY rid, ins ORDER BY ord) AS k FROM h)
SELECT g.rid, count(*) FILTER (ins) AS total, count(*) FILTER (NOT ins) AS withheld, coalesce(string_agg(key, ',' ORDER BY k) FILTER (ins AND k <= 15), '') AS keys FROM g LEFT JOIN k USING (rid) GROUP BY g.rid
"""


def g12_shared_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.shared_keys(nodes(spark, sf_dir))


G12_SQL = f"SELECT lower(key) AS key, count(DISTINCT mod) AS packages FROM {N_SQL} GROUP BY 1 HAVING count(DISTINCT mod) > 1"


def g13_graph_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = supplier_edges(spark, sf_dir).select("rel").unionByName(edges(spark, sf_dir).select("rel"))
    return G.graph_stats(nodes(spark, sf_dir), e)


G13_SQL = f"""
SELECT 'nodes' AS what, p_type AS kind, count(*) AS n FROM part GROUP BY ROLLUP (p_type)
UNION ALL SELECT 'edges', rel, count(*) FROM (SELECT 'references' AS rel FROM lineitem UNION ALL SELECT rel FROM {E_SQL}) GROUP BY ROLLUP (rel)
UNION ALL SELECT 'files', NULL, count(DISTINCT p_brand || '/' || p_partkey) FROM part
"""


def g14_bounded_bfs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From each part by the parts 2k, 2k + 1 and 2k + 3, at most 3 deep and 9 nodes; beyond the last part keys are unresolved."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"))
    e = p.select(F.col("k").alias("from"), F.posexplode(F.array(F.col("k") * 2, F.col("k") * 2 + 1, F.col("k") * 2 + 3)).alias("ord", "to"))
    return G.bounded_bfs(p.select(F.col("k").alias("rid"), F.col("k").alias("key"), F.lit(0).alias("ord")), e, p.select(F.col("k").alias("key")), 3, 9).select("rid", "key", "depth", F.col("pos").cast("int").alias("pos"), "unresolved")


G14_SQL = """
WITH p AS (SELECT p_partkey AS k FROM part), e AS (SELECT k AS f, unnest([0, 1, 2]) AS ord, unnest([k * 2, k * 2 + 1, k * 2 + 3]) AS t FROM p),
l1 AS (SELECT k AS rid, k AS key, 0 AS pos FROM p),
s2 AS (SELECT rid, t AS key, min(ord) AS o FROM l1 JOIN e ON f = key GROUP BY rid, t),
l2 AS (SELECT * FROM (SELECT rid, key, row_number() OVER (PARTITION BY rid ORDER BY o, key) AS pos FROM s2 WHERE key <> rid) WHERE pos < 9),
s3 AS (SELECT l2.rid, t AS key, min(l2.pos * 10 + ord) AS o FROM l2 JOIN e ON f = l2.key GROUP BY l2.rid, t),
n2 AS (SELECT rid, count(*) AS c FROM l2 GROUP BY rid),
l3 AS (SELECT * FROM (SELECT s3.rid, s3.key, c + row_number() OVER (PARTITION BY s3.rid ORDER BY o, s3.key) AS pos FROM s3 JOIN n2 USING (rid) WHERE s3.key <> s3.rid AND NOT EXISTS (SELECT 1 FROM l2 WHERE l2.rid = s3.rid AND l2.key = s3.key)) WHERE pos < 9),
a AS (SELECT rid, key, 1 AS depth, pos FROM l1 UNION ALL SELECT rid, key, 2, pos FROM l2 UNION ALL SELECT rid, key, 3, pos FROM l3)
SELECT rid, key, depth, CAST(pos AS INTEGER) AS pos, key NOT IN (SELECT k FROM p) AS unresolved FROM a
"""

QUERIES = {f.__name__: f for f in (g1_build_nodes, g2_extract_edges, g3_resolve_refs, g4_dedup_edges, g5_lookup_nodes, g6_edge_targets, g7_ancestor_chain, g8_parents_children, g9_successor_chain, g10_references, g11_glob_nodes, g12_shared_keys, g13_graph_stats, g14_bounded_bfs)}
ORACLE_SQL = {k: globals()[k.split("_")[0].upper() + "_SQL"] for k in QUERIES}
