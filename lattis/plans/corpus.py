"""Corpus build: S4, S5, S7 to S9, S12, S13, D1 to D12, D14 on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattis.operators import corpus as C
from lattis.operators import scripts as SC
from lattis.plans.common import sql_text, table, values_sql
from lattis.sources import records as R


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as files: package, mtime."""
    return table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("package"), F.col("o_orderdate").alias("mtime"), F.col("o_orderstatus").alias("state"))


def s4_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.fingerprint(manifest(spark, sf_dir), "package")


S4_SQL = "SELECT o_orderpriority AS package, count(*) AS files, max(o_orderdate) AS max_mtime FROM orders GROUP BY 1"


def s5_stale_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index per customer, built when only its finished orders were there; every 7th is of an old version, every 11th of another root, every 13th missing."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("package"), F.col("o_orderdate").alias("mtime"), "o_orderstatus")
    current = C.fingerprint(orders, "package").withColumn("root", F.lit("/data"))
    meta = C.fingerprint(orders.where("o_orderstatus = 'F'"), "package").where("package % 13 <> 0")
    meta = meta.withColumn("version", F.when(F.col("package") % 7 == 0, 3).otherwise(4)).withColumn("root", F.when(F.col("package") % 11 == 0, "/old").otherwise("/data"))
    return C.stale_reason(meta, current, "package", 4)


S5_SQL = """
WITH c AS (SELECT o_custkey AS package, count(*) AS files, max(o_orderdate) AS m FROM orders GROUP BY 1),
b AS (SELECT o_custkey AS package, count(*) AS files, max(o_orderdate) AS m FROM orders WHERE o_orderstatus = 'F' AND o_custkey % 13 <> 0 GROUP BY 1)
SELECT c.package, CASE WHEN b.package IS NULL THEN 'missing' WHEN b.package % 7 = 0 THEN 'version' WHEN b.package % 11 = 0 THEN 'root' WHEN c.files <> b.files THEN 'file count changed' WHEN c.m > b.m THEN 'files modified' END AS reason
FROM c LEFT JOIN b USING (package)
"""


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: package, path, content."""
    return table(spark, sf_dir, "documents").select(F.col("source").alias("package"), F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit("."), "lang").alias("path"), F.col("text").alias("content"))


def s7_text_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.text_documents(files(spark, sf_dir)).withColumn("raw_text", F.md5("raw_text"))


S7_SQL = "SELECT source AS package, source || '/' || doc_id || '.' || lang AS path, 'script_chunk' AS type, doc_id || '.' || lang AS key, 'PlainText' AS label, 'File: ' || doc_id || '.' || lang || ' (type: ' || lang || ')' AS description, md5(text) AS raw_text FROM documents"

SCRIPT = """#include "base.as"
namespace game::core {
shared class Gun : Base {
  private int count = 0;
  void fire(int n) {
    if (n > 0) { return shoot(n); }
    array<int>@ list(const string name) const { }
  }
}
interface IFire { }
enum Mode { A, B }
funcdef void Callback(int)
}
void main() {
return foo(1);
mixin Hot"""
#: What a line of a document declares, beside real declarations.
DOC_RULES = [*C.SYMBOL_RULES, ("class", r"^([A-Z][a-z]+) the "), ("function", r"^(\w+) \w+\.$"), ("enum", r"^Of (\w+)")]


def script_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("file"), "text")
    return C.lines_of(docs.unionByName(spark.createDataFrame([("script.as", SCRIPT)], "file string, text string")), "text", "file")


LINES_SQL = f"(SELECT file, CAST(i AS INTEGER) AS line_no, ls[i] AS line FROM (SELECT file, string_split(text, chr(10)) AS ls, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM (SELECT 'd' || doc_id AS file, text FROM documents UNION ALL SELECT 'script.as', {sql_text(SCRIPT)})))"


def s8_line_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.line_symbols(script_lines(spark, sf_dir), DOC_RULES)


def s8_script_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as scripts: a class after a comment that holds another, with a member and a function over two lines for each order, braces in texts and comments."""
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey").cast("string")
    body = F.concat(F.lit("  int m_"), k, F.lit(" = "), k, F.lit("; // { note\n  void f_"), k, F.lit('(int part,\n       string s = "}{") {\n    if (part > 0) { call(s); }\n  }'))
    files = o.groupBy("o_custkey").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("o_orderkey", body.alias("b")))), lambda x: x["b"]), "\n").alias("b"))
    c = F.col("o_custkey").cast("string")
    text = F.concat(F.lit('#include "lib/'), c, F.lit('.as"\n/* class Old {\n*/ class C'), c, F.lit("\n{\n"), "b", F.lit("\n}"))
    return SC.script_symbols(C.lines_of(files.select(c.alias("file"), text.alias("text")), "text", "file"))


S8_SCRIPT_SQL = """
WITH o AS (SELECT CAST(o_custkey AS VARCHAR) AS file, 'C' || o_custkey AS parent, CAST(o_orderkey AS VARCHAR) AS k, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS INTEGER) AS i FROM orders)
SELECT file, 5 + 5 * i AS line_no, 'property' AS kind, 'm_' || k AS name, 'int m_' || k || ' = ' || k || '; // { note' AS signature, parent FROM o
UNION ALL SELECT file, 6 + 5 * i, 'function', 'f_' || k, 'void f_' || k || '(int part, string s = "}{")', parent FROM o
UNION ALL SELECT file, 3, 'class', parent, '*/ class ' || parent, NULL FROM o WHERE i = 0
UNION ALL SELECT file, 1, 'include', 'lib/' || file || '.as', '#include "lib/' || file || '.as"', NULL FROM o WHERE i = 0
"""

KIND_SQL = "CASE " + " ".join(f"WHEN regexp_extract(line, {sql_text(p)}, 1) <> '' THEN '{k}'" for k, p in DOC_RULES) + " END"
NAME_SQL = "CASE " + " ".join(f"WHEN regexp_extract(line, {sql_text(p)}, 1) <> '' THEN regexp_extract(line, {sql_text(p)}, 1)" for _, p in DOC_RULES) + " END"
SYMBOLS_SQL = rf"""(SELECT file, line_no, kind, name, CAST(coalesce(depth, 0) AS BIGINT) AS depth FROM (
SELECT file, line_no, {KIND_SQL} AS kind, {NAME_SQL} AS name, regexp_matches(line, '^\s*(?:{C.CONTROL_WORDS})\b') AS control,
sum(length(regexp_replace(line, '[^{{]', '', 'g')) - length(regexp_replace(line, '[^}}]', '', 'g'))) OVER (PARTITION BY file ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS depth
FROM {LINES_SQL}) WHERE kind IS NOT NULL AND NOT control)"""
S8_SQL = f"SELECT * FROM {SYMBOLS_SQL}"


def s9_symbol_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.symbol_summary(s8_line_symbols(spark, sf_dir), most=3)


S9_SQL = f"""
WITH f AS (SELECT file, kind, name, min(line_no) AS l FROM {SYMBOLS_SQL} GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY file, kind ORDER BY l, name) AS k FROM f)
SELECT file, kind, count(*) AS n, string_agg(name, ', ' ORDER BY k) FILTER (k <= 3) || CASE WHEN count(*) > 3 THEN ' …+' || (count(*) - 3) || ' more' ELSE '' END AS names FROM r GROUP BY file, kind
"""


def s9_symbol_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every file with symbols asks for itself by its base name, in its package, another, or any."""
    s = s8_line_symbols(spark, sf_dir).withColumn("mod", F.substring("file", 1, 4))
    n = F.length("file")
    asked = s.select("file", "mod").distinct().select(F.col("file").alias("rid"), F.concat(F.lit("x/"), F.element_at(F.split("file", "/"), -1)).alias("file"), F.when(n % 2 == 0, F.col("mod")).when(n % 3 == 0, "none").alias("mod"))
    return C.symbol_lookup(asked, s)


S9_LOOKUP_SQL = f"""
WITH s AS (SELECT file, kind, name, line_no, substr(file, 1, 4) AS mod, string_split(file, '/')[-1] AS base FROM {SYMBOLS_SQL}),
a AS (SELECT DISTINCT file AS rid, base, CASE WHEN length(file) % 2 = 0 THEN mod WHEN length(file) % 3 = 0 THEN 'none' END AS scope FROM s)
SELECT rid, kind, name, line_no, file FROM a JOIN s USING (base) WHERE scope IS NULL OR scope = mod
"""


def s12_restrict_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.restrict_packages(files(spark, sf_dir), ["src1", "src3", "nowhere"]).select("package", "path")


S12_SQL = "SELECT source AS package, source || '/' || doc_id || '.' || lang AS path FROM documents WHERE source IN ('src1', 'src3', 'nowhere')"


def s13_read_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each document lines 2 to 4 (every 3rd: the whole), asked from package src1 (every 4th: any)."""
    docs = table(spark, sf_dir, "documents")
    lines = C.lines_of(docs, "text", F.col("doc_id").alias("file"), F.col("source").alias("package"))
    whole = F.col("doc_id") % 3 == 0
    asked = docs.select(F.col("doc_id").alias("rid"), F.col("doc_id").alias("file"), F.when(~whole, 2).alias("start"), F.when(~whole, 4).alias("end"), F.when(F.col("doc_id") % 4 != 0, "src1").alias("mod"))
    return C.read_lines(asked, lines).withColumn("content", F.md5("content")).drop("file")


S13_SQL = r"""
WITH d AS (SELECT doc_id, source, string_split(text, chr(10)) AS ls FROM documents),
r AS (SELECT doc_id AS rid, source, len(ls) AS n, array_to_string(CASE WHEN doc_id % 3 = 0 THEN ls ELSE ls[2:4] END, chr(10)) AS c, CASE WHEN doc_id % 4 <> 0 THEN 'src1' END AS mod FROM d WHERE doc_id % 3 = 0 OR len(ls) >= 2)
SELECT rid, CAST(n AS INTEGER) AS n_lines, md5(CASE WHEN length(c) > 4000 THEN substr(c, 1, 4000) || chr(10) || '... [truncated]' ELSE c END) AS content, length(c) > 4000 AS truncated, source AS owner, mod IS NOT NULL AND mod <> source AS out_of_scope FROM r
"""


def d1_flatten_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_returnflag"))), lambda x: F.struct(x["l_partkey"].alias("part"), x["l_returnflag"].alias("flag"))).alias("line"))
    orders = table(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    nested = orders.select("o_orderkey", F.struct(F.col("o_orderstatus").alias("status"), F.struct(F.col("o_custkey").alias("key")).alias("customer"), "line").alias("record"))
    return C.flatten_attributes(nested, "o_orderkey", "record")


D1_SQL = """
WITH l AS (SELECT l_orderkey AS o_orderkey, list(CAST(l_partkey AS VARCHAR) ORDER BY l_linenumber, l_partkey, l_returnflag) AS p, list(l_returnflag ORDER BY l_linenumber, l_partkey, l_returnflag) AS f FROM lineitem GROUP BY 1),
o AS (SELECT o_orderkey, o_orderstatus, CAST(o_custkey AS VARCHAR) AS c, p, f FROM orders JOIN l USING (o_orderkey))
SELECT o_orderkey, 'status' AS path, o_orderstatus AS value FROM o UNION ALL SELECT o_orderkey, 'customer.key', c FROM o
UNION ALL SELECT o_orderkey, 'line.part', p[-1] FROM o UNION ALL SELECT o_orderkey, 'line.flag', f[-1] FROM o
UNION ALL SELECT o_orderkey, 'line.part[]', array_to_string(p, ', ') FROM o WHERE len(p) > 1 UNION ALL SELECT o_orderkey, 'line.flag[]', array_to_string(f, ', ') FROM o WHERE len(p) > 1
"""


def d1_flatten_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with their orders and the lines of these, nested as JSON, and the properties of events."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_returnflag"))), lambda x: F.struct(x["l_partkey"].alias("@_part"), x["l_returnflag"].alias("flag"))).alias("line"))
    orders = table(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    orders = orders.groupBy("o_custkey").agg(F.transform(F.sort_array(F.collect_list(F.struct("o_orderkey", "o_orderstatus", "line"))), lambda x: F.struct(x["o_orderkey"].alias("@_key"), F.struct(x["o_orderstatus"].alias("#text"), F.lit(1).alias("seen")).alias("status"), x["line"].alias("line"))).alias("order"))
    nested = orders.select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("entity"), F.to_json(F.struct(F.struct("order").alias("all"))).alias("j"))
    events = table(spark, sf_dir, "events").select(F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("entity"), F.col("props").alias("j"))
    return R.flatten_variants(nested.unionByName(events).select("entity", F.try_parse_json("j").alias("v")), "entity", "v")


D1_VARIANTS_SQL = """
WITH o AS (SELECT 'c' || o_custkey AS entity, o_orderkey AS k, CAST(o_orderkey AS VARCHAR) AS key, o_orderstatus AS st, p, f FROM orders LEFT JOIN (SELECT l_orderkey, list(CAST(l_partkey AS VARCHAR) ORDER BY l_linenumber, l_partkey, l_returnflag) AS p, list(l_returnflag ORDER BY l_linenumber, l_partkey, l_returnflag) AS f FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey),
g AS (SELECT entity, count(*) AS n, count(p) AS m, list(key ORDER BY k) AS ks, list(st ORDER BY k) AS ss, list('1') AS seen, list(p[-1] ORDER BY k) FILTER (p IS NOT NULL) AS ps, list(f[-1] ORDER BY k) FILTER (p IS NOT NULL) AS fs, any_value(p) AS p1, any_value(f) AS f1 FROM o GROUP BY 1),
v AS (SELECT entity, 'all.order.key' AS path, ks AS v FROM g UNION ALL SELECT entity, 'all.order.status', ss FROM g UNION ALL SELECT entity, 'all.order.status.seen', seen FROM g
 UNION ALL SELECT entity, 'all.order.line.part', CASE WHEN m > 1 THEN ps ELSE p1 END FROM g WHERE m > 0 UNION ALL SELECT entity, 'all.order.line.flag', CASE WHEN m > 1 THEN fs ELSE f1 END FROM g WHERE m > 0)
SELECT entity, path, v[-1] AS value FROM v UNION ALL SELECT entity, path || '[]', array_to_string(v, ', ') FROM v WHERE len(v) > 1
UNION ALL SELECT 'e' || event_id, 'k', json_extract_string(props, '$.k') FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL
"""


KINDS = ["weapon", "projectile", "vehicle", "soldier", "call", "character", "carry_item"]


def part_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as entities: entity, type, path, value; some values are empty."""
    p = table(spark, sf_dir, "part")
    kind = F.element_at(F.array(*map(F.lit, KINDS)), (F.col("p_partkey") % 7 + 1).cast("int"))
    k = F.col("p_partkey")
    pairs = [
        ("class", F.col("p_brand")), ("damage", F.when(k % 5 == 0, "").otherwise(F.col("p_size").cast("string"))), ("specification.damage", F.col("p_name")), ("rpm", (k % 100).cast("string")), ("speed", (k % 7).cast("string")),
        ("carry_in_back", (k % 2).cast("string")), ("can_shoot_down", (k % 4).cast("string")), ("max_speed", F.when(k % 3 == 2, (k % 50).cast("string"))), ("weapon", F.col("p_type")),
        ("name", F.col("p_name")), ("faction", F.col("p_type")), ("cost", F.col("p_size").cast("string")), ("inventory.price", (k % 9).cast("string")), ("commonness.value", (k % 3).cast("string")), ("commonness.in_stock", (k % 2).cast("string")),
        ("modifier.speed", F.element_at(F.array(F.lit("+0.2"), F.lit("-0.1"), F.lit("0.3"), F.lit("0"), F.lit("x")), (k % 5 + 1).cast("int"))), ("next_in_chain.key[]", F.concat("p_brand", F.lit(", "), "p_type")), ("next_in_chain.share_ammo[]", F.concat(F.lit("0, "), (k % 2).cast("string"))),
    ]
    return p.select(k.alias("entity"), kind.alias("type"), F.explode(F.array(*[F.struct(F.lit(i).alias("pos"), F.lit(n).alias("path"), v.alias("value")) for i, (n, v) in enumerate(pairs)])).alias("a")).select("entity", "type", "a.*")


ATTRS_SQL = f"""(SELECT p_partkey AS entity, {KINDS!r}[CAST(p_partkey % 7 + 1 AS INTEGER)] AS type, unnest([
{{'pos': 0, 'path': 'class', 'value': p_brand}}, {{'pos': 1, 'path': 'damage', 'value': CASE WHEN p_partkey % 5 = 0 THEN '' ELSE CAST(p_size AS VARCHAR) END}}, {{'pos': 2, 'path': 'specification.damage', 'value': p_name}},
{{'pos': 3, 'path': 'rpm', 'value': CAST(p_partkey % 100 AS VARCHAR)}}, {{'pos': 4, 'path': 'speed', 'value': CAST(p_partkey % 7 AS VARCHAR)}}, {{'pos': 5, 'path': 'carry_in_back', 'value': CAST(p_partkey % 2 AS VARCHAR)}},
{{'pos': 6, 'path': 'can_shoot_down', 'value': CAST(p_partkey % 4 AS VARCHAR)}}, {{'pos': 7, 'path': 'max_speed', 'value': CASE WHEN p_partkey % 3 = 2 THEN CAST(p_partkey % 50 AS VARCHAR) END}}, {{'pos': 8, 'path': 'weapon', 'value': p_type}},
{{'pos': 9, 'path': 'name', 'value': p_name}}, {{'pos': 10, 'path': 'faction', 'value': p_type}}, {{'pos': 11, 'path': 'cost', 'value': CAST(p_size AS VARCHAR)}}, {{'pos': 12, 'path': 'inventory.price', 'value': CAST(p_partkey % 9 AS VARCHAR)}},
{{'pos': 13, 'path': 'commonness.value', 'value': CAST(p_partkey % 3 AS VARCHAR)}}, {{'pos': 14, 'path': 'commonness.in_stock', 'value': CAST(p_partkey % 2 AS VARCHAR)}}, {{'pos': 15, 'path': 'modifier.speed', 'value': ['+0.2', '-0.1', '0.3', '0', 'x'][CAST(p_partkey % 5 + 1 AS INTEGER)]}},
{{'pos': 16, 'path': 'next_in_chain.key[]', 'value': p_brand || ', ' || p_type}}, {{'pos': 17, 'path': 'next_in_chain.share_ammo[]', 'value': '0, ' || (p_partkey % 2)}}], recursive := true) FROM part)"""
ALIASES = [("hurt", 0, "damage"), ("hurt", 1, "specification.damage"), ("pace", 0, "max_speed"), ("pace", 1, "speed"), ("pace", 2, "rpm")]


def d2_first_present(spark: SparkSession, sf_dir: str) -> DataFrame:
    aliases = spark.createDataFrame(ALIASES, "field string, ord int, path string")
    return C.first_present(part_attributes(spark, sf_dir), F.broadcast(aliases))


D2_SQL = f"SELECT entity, field, arg_min(value, ord) AS value FROM {ATTRS_SQL} JOIN {values_sql(ALIASES, 'field, ord, path')} USING (path) WHERE value <> '' GROUP BY entity, field"


def d3_describe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.describe(part_attributes(spark, sf_dir).drop("pos"))


D3_SQL = f"""
WITH t AS {values_sql(C.template_rows(), 'type, ord, aord, path, fmt, other, mode')},
p AS (SELECT entity, ord, fmt, other, mode, arg_min(value, aord) AS v FROM {ATTRS_SQL} a JOIN t USING (type, path) WHERE value <> '' GROUP BY entity, ord, fmt, other, mode)
SELECT entity, string_agg(CASE WHEN mode = 'flag' AND v <> '1' OR mode = 'zero' AND TRY_CAST(v AS DOUBLE) = 0 THEN other
  WHEN mode = 'sign' AND NOT regexp_matches(v, '^[+-]') THEN CASE WHEN TRY_CAST(v AS DOUBLE) > 0 THEN replace(split_part(other, '|', 1), '{{}}', v) ELSE split_part(other, '|', 2) END
  WHEN mode = 'any' AND NOT regexp_matches(v, '(^|, )1(,|$)') THEN NULL ELSE replace(fmt, '{{}}', v) END, ' ' ORDER BY ord) AS description FROM p GROUP BY entity
"""


def layers(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Attributes of customers (0), nations (1) and regions (2), and which layers a customer inherits from."""
    c, n, r = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    owner = lambda kind, key: F.concat(F.lit(kind), F.col(key).cast("string"))
    own = c.select(owner("c", "c_custkey").alias("owner"), F.explode(F.array(
        F.struct(F.lit("spec.segment").alias("path"), F.lit(0).alias("pos"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).alias("value")), F.struct(F.lit("note").alias("path"), F.lit(0).alias("pos"), F.col("c_name").alias("value")))).alias("a")).select("owner", "a.*").where("value is not null")
    mid = n.select(owner("n", "n_nationkey").alias("owner"), F.explode(F.array(F.struct(F.lit("spec.segment").alias("path"), F.lit(0).alias("pos"), F.lit("NATION").alias("value")), F.struct(F.lit("spec.nation").alias("path"), F.lit(0).alias("pos"), F.col("n_name").alias("value")), F.struct(F.lit("note").alias("path"), F.lit(0).alias("pos"), F.col("n_name").alias("value")), F.struct(F.lit("file").alias("path"), F.lit(0).alias("pos"), F.lit("f").alias("value")))).alias("a")).select("owner", "a.*")
    top = r.select(owner("r", "r_regionkey").alias("owner"), F.explode(F.array(F.struct(F.lit("area.name").alias("path"), F.lit(0).alias("pos"), F.col("r_name").alias("value")), F.struct(F.lit("note").alias("path"), F.lit(0).alias("pos"), F.col("r_name").alias("value")))).alias("a")).select("owner", "a.*")
    up = c.join(F.broadcast(n), c["c_nationkey"] == n["n_nationkey"])
    closure = up.select(F.col("c_custkey").alias("entity"), F.posexplode(F.array(owner("c", "c_custkey"), owner("n", "n_nationkey"), owner("r", "n_regionkey"))).alias("depth", "ancestor"))
    return own.unionByName(mid).unionByName(top), closure


def d5_effective_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    attrs, closure = layers(spark, sf_dir)
    return C.effective_attributes(attrs, closure, ["note"])


D5_SQL = """
WITH u AS (SELECT * FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
SELECT c_custkey AS entity, 'spec.segment' AS path, 0 AS pos, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE 'NATION' END AS value, CASE WHEN c_custkey % 2 = 0 THEN 0 ELSE 1 END AS depth FROM u
UNION ALL SELECT c_custkey, 'spec.nation', 0, n_name, 1 FROM u WHERE c_custkey % 2 <> 0
UNION ALL SELECT c_custkey, 'area.name', 0, r_name, 2 FROM u
UNION ALL SELECT c_custkey, 'note', 0, r_name, 2 FROM u UNION ALL SELECT c_custkey, 'note', 1, n_name, 1 FROM u UNION ALL SELECT c_custkey, 'note', 2, c_name, 0 FROM u
"""


def named_parts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Parts with names of two halves, and translations of names and halves, some of them twice."""
    p = table(spark, sf_dir, "part")
    word = F.split("p_name", " ")
    docs = p.select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 4 == 0, "call").otherwise("weapon").alias("type"), F.when(F.col("p_partkey") % 3 == 0, "").otherwise(F.concat(word[0], F.lit("-"), "p_brand")).alias("spec_name"), F.col("p_name").alias("name"), F.col("p_type").alias("comment"))
    keys = p.select(F.col("p_partkey").alias("ord"), F.explode(F.array(word[0], F.col("p_name"), F.col("p_type"))).alias("key"))
    langs = keys.withColumn("lang", F.explode(F.array(F.lit("en"), F.lit("cn"), F.lit("fr")))).where("lang <> 'cn' or length(key) % 2 = 0")
    return docs, langs.select("lang", "ord", "key", F.concat("lang", F.lit(":"), F.upper("key"), (F.col("ord") % 2).cast("string")).alias("text"))


NAMED_SQL = """
d AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 4 = 0 THEN 'call' ELSE 'weapon' END AS type, CASE WHEN p_partkey % 3 = 0 THEN p_name ELSE string_split(p_name, ' ')[1] || '-' || p_brand END AS spec, p_type AS comment FROM part),
c AS (SELECT id, list_filter([spec, CASE WHEN type = 'call' THEN comment END, CASE WHEN contains(spec, '-') THEN string_split(spec, '-')[1] END], lambda x: x IS NOT NULL AND x <> '') AS ns FROM d),
n AS (SELECT DISTINCT id, list_position(us, x) - 1 AS cand_ord, x AS name FROM (SELECT id, us, unnest(us) AS x FROM (SELECT id, list_filter(ns, lambda x, i: list_position(ns, x) = i) AS us FROM c))),
k AS (SELECT p_partkey AS ord, unnest([string_split(p_name, ' ')[1], p_name, p_type]) AS key FROM part),
t AS (SELECT lang, key, arg_max(lang || ':' || upper(key) || CAST(ord % 2 AS VARCHAR), ord) AS text FROM k, (VALUES ('en'), ('cn'), ('fr')) AS l(lang) WHERE lang <> 'cn' OR length(key) % 2 = 0 GROUP BY lang, key),
z AS (SELECT id, lang, CAST(cand_ord AS INTEGER) AS cand_ord, name, text FROM n JOIN t ON n.name = t.key)
"""


def d7_localize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.localize(*named_parts(spark, sf_dir))


def d8_localized_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.localized_name(d7_localize(spark, sf_dir), "cn")


def d9_indexed_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.indexed_names(d7_localize(spark, sf_dir))


D7_SQL = f"WITH {NAMED_SQL} SELECT * FROM z"
D8_SQL = f"WITH {NAMED_SQL} SELECT id, arg_min(text, cand_ord) AS text FROM z WHERE lang = 'cn' GROUP BY id"
D9_SQL = f"WITH {NAMED_SQL} SELECT id, array_to_string(list_filter(ts, lambda x, i: list_position(ts, x) = i), ' ') AS names FROM (SELECT id, list(text ORDER BY lang, cand_ord) AS ts FROM z WHERE lang IN ('en', 'cn') GROUP BY id)"


def d10_render_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", F.when(F.col("doc_id") % 2 == 0, "script_chunk").otherwise("weapon").alias("type"), F.col("doc_id").cast("string").alias("key"), F.lit("PlainText").alias("label"), F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.col("source")).alias("faction"),
        F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("File: "), "lang")).alias("description"), F.concat(F.lit("chars: "), F.col("n_chars").cast("string")).alias("attributes"), F.col("text").alias("raw_text"))
    return docs.select("doc_id", F.md5(C.render_content(docs)).alias("content_md5"))


D10_SQL = r"""
SELECT doc_id, md5(concat_ws(chr(10) || chr(10),
  '[Type: ' || CASE WHEN doc_id % 2 = 0 THEN 'script_chunk' ELSE 'weapon' END || '] [Key: ' || doc_id || ']' || CASE WHEN doc_id % 3 = 0 THEN '' ELSE ' [Faction: ' || source || ']' END || chr(10) || 'PlainText: ' || doc_id,
  CASE WHEN doc_id % 5 = 0 THEN 'Description: File: ' || lang END, 'Attributes:' || chr(10) || 'chars: ' || n_chars,
  CASE WHEN doc_id % 2 = 0 AND trim(regexp_replace(substr(text, 1, 500), '\s+', ' ', 'g')) <> '' THEN 'Content Snippet:' || chr(10) || substr(text, 1, 500) END)) AS content_md5 FROM documents
"""


def d11_to_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    entities = p.select(F.col("p_brand").alias("package"), F.col("p_type").alias("type"), F.when(k % 3 == 0, F.col("p_name")).alias("key"), F.when(k % 3 == 1, F.concat(F.lit("n"), k.cast("string"))).alias("name"), F.when(k % 6 == 2, F.lit("file.xml")).alias("filename"), F.col("p_size").alias("file_ord"), k.cast("int").alias("pos"))
    return C.to_documents(entities).select("id", "package", "key", F.col("seq").cast("long").alias("seq"))


D11_SQL = """
WITH e AS (SELECT p_brand AS package, p_type AS type, CASE WHEN p_partkey % 3 = 0 THEN p_name WHEN p_partkey % 3 = 1 THEN 'n' || p_partkey WHEN p_partkey % 6 = 2 THEN 'file.xml' ELSE p_type || '_' || p_partkey END AS key,
  row_number() OVER (PARTITION BY p_brand ORDER BY p_size, p_partkey) - 1 AS seq FROM part)
SELECT package || ':' || type || ':' || key || ':' || seq AS id, package, key, seq FROM e
"""


def d12_compare_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    attrs = part_attributes(spark, sf_dir).withColumn("entity", F.concat(F.lit("e"), F.col("entity").cast("string")))
    return C.compare_entities(attrs, ["e1", "e2", "e5"])


D12_SQL = f"SELECT path, min(value) FILTER (entity = 1) AS e1, min(value) FILTER (entity = 2) AS e2, min(value) FILTER (entity = 5) AS e5 FROM {ATTRS_SQL} WHERE entity IN (1, 2, 5) GROUP BY path"


def dictionary_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of a customer as lines of a dictionary: comments, entries and blank lines by the order's key."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey") % 5
    line = F.when(k == 0, F.concat(F.lit("  // "), "o_orderpriority")).when(k == 1, "").otherwise(F.concat(F.lit('{"'), F.when(F.col("o_orderkey") % 11 == 0, "666").otherwise(F.col("o_orderstatus")), F.lit('", '), F.col("o_orderkey").cast("string"), F.lit("},")))
    return o.select(F.col("o_custkey").alias("file"), F.col("o_orderkey").alias("line_no"), line.alias("line"))


def d14_labelled_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.labelled_entries(dictionary_lines(spark, sf_dir))


D14_SQL = """
WITH l AS (SELECT o_custkey AS f, o_orderkey AS k, CASE WHEN o_orderkey % 5 = 0 THEN o_orderpriority END AS label, o_orderkey % 5 = 1 AS blank, CASE WHEN o_orderkey % 5 > 1 AND o_orderkey % 11 <> 0 THEN o_orderstatus END AS key FROM orders),
e AS (SELECT * FROM l WHERE key IS NOT NULL),
c AS (SELECT e.f, e.k, e.key, (SELECT max(k) FROM l WHERE l.f = e.f AND l.k < e.k AND l.label IS NOT NULL) AS lk FROM e),
b AS (SELECT c.*, (SELECT max(x.k) FROM l x WHERE x.f = c.f AND x.k < c.k AND x.k > c.lk AND x.blank) AS bk, (SELECT min(x.k) FROM e x WHERE x.f = c.f AND x.k > c.lk) AS ek FROM c)
SELECT b.f AS file, b.k AS line_no, b.key, CAST(b.k AS INTEGER) AS index, CASE WHEN lk IS NULL OR (bk IS NOT NULL AND ek < bk) THEN '' ELSE (SELECT label FROM l WHERE l.f = b.f AND l.k = b.lk) END AS label FROM b
"""

QUERIES = {f.__name__: f for f in (s4_fingerprint, s5_stale_reason, s7_text_documents, s8_line_symbols, s8_script_symbols, s9_symbol_summary, s9_symbol_lookup, s12_restrict_packages, s13_read_lines, d1_flatten_attributes, d1_flatten_variants, d2_first_present, d3_describe, d5_effective_attributes, d7_localize, d8_localized_name, d9_indexed_names, d10_render_content, d11_to_documents, d12_compare_entities, d14_labelled_entries)}
ORACLE_SQL = {k: globals()[k.split("_")[0].upper() + "_SQL"] for k in QUERIES} | {"s9_symbol_lookup": S9_LOOKUP_SQL, "d1_flatten_variants": D1_VARIANTS_SQL, "s8_script_symbols": S8_SCRIPT_SQL}
