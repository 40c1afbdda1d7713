"""Streams ST1 to ST7 over events and conversations, each run to its end; S3, S6, S10, S11, D4 over files that Spark derives from the tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattis.functions.text import SEPARATOR
from lattis.operators import corpus as C
from lattis.operators import logs as L
from lattis.plans.common import table
from lattis.session import shared_dir
from lattis.sources import files as S
from lattis.sources import records as R
from lattis.streaming import store as ST
from lattis.streaming import turns as T


def scratch(spark: SparkSession) -> str:
    """A new folder below the one that all executors share."""
    return f"{shared_dir(spark)}/run-{uuid.uuid4().hex}"


def stream_of(spark: SparkSession, df: DataFrame, folder: str) -> DataFrame:
    """A table as a stream of files."""
    df.write.parquet(f"{folder}/in")
    return spark.readStream.schema(df.schema).parquet(f"{folder}/in")


def turn_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events: a turn for each user; a purchase ends it."""
    e = table(spark, sf_dir, "events")
    kind = F.when(F.col("event_type") == "purchase", "finish").otherwise(F.col("event_type"))
    return e.select(F.col("user_id").cast("string").alias("turn"), F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"), kind.alias("type"), F.col("props").alias("text"))


def st1_read_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as JSON lines; every 50th line is cut short, every 60th has no type; clicks are the known type."""
    e = turn_events(spark, sf_dir)
    line = F.to_json(F.struct("turn", "seq", F.when(F.col("seq") % 60 != 0, F.col("type")).alias("type"), "text"))
    folder = scratch(spark)
    e.select(F.when(F.col("seq") % 50 == 0, F.substring(line, 1, 12)).otherwise(line).alias("value")).write.text(f"{folder}/lines")
    out = T.parse_events(spark.readStream.text(f"{folder}/lines"), ["click"]).select("turn", "seq", "type", "text", "known")
    return T.run_to_end(out, folder, "st1")


ST1_SQL = "SELECT CAST(user_id AS VARCHAR) AS turn, event_id AS seq, CASE WHEN event_type = 'purchase' THEN 'finish' ELSE event_type END AS type, props AS text, event_type = 'click' AS known FROM events WHERE event_id % 50 <> 0 AND event_id % 60 <> 0"


def st2_session_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark)
    return T.run_to_end(T.session_state(stream_of(spark, turn_events(spark, sf_dir), folder)), folder, "st2", timers=False)


ST2_SQL = "SELECT CAST(user_id AS VARCHAR) AS turn, event_id AS seq, coalesce(ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 6 HOURS, false) AS hit FROM events"


def st2_session_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.session_reads(turn_events(spark, sf_dir)).select("turn", "seq", "hit")


def st3_open_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns live 2 days here, as the events of a user lie days apart."""
    folder = scratch(spark)
    return T.run_to_end(T.open_turns(stream_of(spark, turn_events(spark, sf_dir), folder), 2 * 86400, remember_seconds=1000 * 86400), folder, "st3")


ST3_SQL = """
SELECT CAST(user_id AS VARCHAR) AS turn, event_id AS seq, CASE WHEN ts < first_value(ts) OVER w + INTERVAL 2 DAYS AND coalesce(sum((event_type = 'purchase')::INTEGER) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 0 THEN 'ok' ELSE 'not_found' END AS status
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id) QUALIFY row_number() OVER w > 1
"""


def st3_turn_admissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.turn_admissions(turn_events(spark, sf_dir), "2 days")


def st4_announce_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark)
    once = T.announce_once(stream_of(spark, turn_events(spark, sf_dir), folder), "100 days").select("turn", "text")
    return T.run_to_end(once, folder, "st4")


ST4_SQL = "SELECT DISTINCT CAST(user_id AS VARCHAR) AS turn, props AS text FROM events"


def turn_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", (F.col("turn") + 1).alias("turn_count"))


def st5_summary_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark)
    return T.run_to_end(T.summary_due_stream(stream_of(spark, turn_counts(spark, sf_dir), folder), 3), folder, "st5")


ST5_SQL = "SELECT conv_id, turn + 1 AS fired FROM conversations WHERE (turn + 1) % 3 = 0"


def st5_summary_due_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.summary_due(turn_counts(spark, sf_dir), 3)


def st6_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks with the views of the same user and number within 30 days. What stays open is told once the watermark, 60 days behind the slower side, has passed its 30 days."""
    e = turn_events(spark, sf_dir).withColumn("call", F.get_json_object("text", "$.k"))
    folder = scratch(spark)
    opened = stream_of(spark, e.where("type = 'click'").select("turn", "call", "ts"), f"{folder}/a")
    closed = stream_of(spark, e.where("type = 'view'").select("turn", "call", "ts", F.lit(True).alias("ok")), f"{folder}/b")
    return T.run_to_end(T.tool_calls_stream(opened, closed, "60 days", "30 days"), folder, "st6").withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("opened", "closed")})


ST6_SQL = """
WITH e AS (SELECT CAST(user_id AS VARCHAR) AS turn, json_extract_string(props, '$.k') AS call, ts, event_type FROM events)
SELECT a.turn, a.call, a.ts AS opened, b.ts AS closed, true AS ok FROM e a JOIN e b ON a.turn = b.turn AND a.call = b.call AND b.ts BETWEEN a.ts AND a.ts + INTERVAL 30 DAYS WHERE a.event_type = 'click' AND b.event_type = 'view'
UNION ALL SELECT turn, call, ts, NULL, NULL FROM e a WHERE event_type = 'click' AND ts + INTERVAL 30 DAYS < (SELECT min(m) - INTERVAL 60 DAYS FROM (SELECT max(ts) AS m FROM e WHERE event_type IN ('click', 'view') GROUP BY event_type))
 AND NOT EXISTS (SELECT 1 FROM e b WHERE a.turn = b.turn AND a.call = b.call AND b.event_type = 'view' AND b.ts BETWEEN a.ts AND a.ts + INTERVAL 30 DAYS)
"""


def st6_turn_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks as calls, views as results (those of every 7th event failed), errors as errors."""
    e = turn_events(spark, sf_dir)
    kind = F.when(F.col("type") == "click", "call").when(F.col("type") == "view", "result").otherwise(F.col("type"))
    folder = scratch(spark)
    rows = T.turn_rollup(stream_of(spark, e.select("turn", "ts", kind.alias("type"), (F.col("seq") % 7 != 0).alias("ok")), folder))
    return T.run_updates(rows, folder, "st6r", "turn").withColumn("last_at", F.col("last_at").cast("timestamp_ntz"))


ST6_ROLLUP_SQL = """SELECT CAST(user_id AS VARCHAR) AS turn, count(*) FILTER (event_type = 'click') AS calls, count(*) FILTER (event_type = 'error' OR event_type = 'view' AND event_id % 7 = 0) AS failures, max(ts) AS last_at FROM events GROUP BY 1"""


def st7_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as files: finished ones were there before, every 9th has gone, every 4th is newer now."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("path"), F.col("o_orderdate").alias("mtime"), "o_orderkey", "o_orderstatus")
    new = o.where("o_orderkey % 9 <> 0").select("path", F.when(F.col("o_orderkey") % 4 == 0, F.col("mtime") + F.expr("interval 1 day")).otherwise(F.col("mtime")).alias("mtime"))
    return T.refresh(o.where("o_orderstatus = 'F'").select("path", "mtime"), new)


ST7_SQL = """
SELECT CAST(o_orderkey AS VARCHAR) AS path, CASE WHEN o_orderstatus <> 'F' THEN 'added' WHEN o_orderkey % 9 = 0 THEN 'removed' ELSE 'changed' END AS change FROM orders
WHERE (o_orderstatus = 'F' OR o_orderkey % 9 <> 0) AND (o_orderstatus <> 'F' OR o_orderkey % 9 = 0 OR o_orderkey % 4 = 0)
"""


def st7_stored_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files in three turns: two thirds of them; the others come, every 4th is changed, every 5th goes; then every 7th is changed and every 5th comes again. What is stored at the end, with the number of its terms."""
    d, folder, k = table(spark, sf_dir, "documents"), scratch(spark), F.col("doc_id")
    name, day = k.cast("string").alias("path"), lambda n: F.lit(f"2024-01-0{n}").cast("timestamp")
    first = d.where(k % 3 != 0).select(name, day(1).alias("mtime"), F.col("text").alias("content"))
    second = d.where(k % 5 != 0).select(name, F.when((k % 4 == 0) | (k % 3 == 0), day(2)).otherwise(day(1)).alias("mtime"), F.when(k % 4 == 0, F.concat(F.lit("second "), "text")).otherwise(F.col("text")).alias("content"))
    changed = F.when(k % 7 == 0, F.concat(F.lit("third "), "text")).when((k % 4 == 0) & (k % 5 != 0), F.concat(F.lit("second "), "text")).otherwise(F.col("text"))
    third = d.select(name, F.when((k % 7 == 0) | (k % 5 == 0), day(3)).when((k % 4 == 0) | (k % 3 == 0), day(2)).otherwise(day(1)).alias("mtime"), changed.alias("content"))
    old = first.limit(0)
    for turn, new in enumerate((first, second, third)):
        ST.write_changes(old, new, f"{folder}/log", turn)
        ST.follow(spark, f"{folder}/log", f"{folder}/store", f"{folder}/state", {"content": False})
        old = new
    docs, postings = ST.read_store(spark, f"{folder}/store")
    terms = postings.groupBy(F.col("doc_id").alias("path")).agg(F.count("*").alias("terms"), F.sum("tf").alias("words"))
    return docs.join(terms, "path", "left").select("path", F.md5("content").alias("content"), F.date_format("mtime", "dd").alias("day"), F.coalesce("terms", F.lit(0)).alias("terms"), F.coalesce("words", F.lit(0)).alias("words"))


ST7_STORED_SQL = f"""
WITH d AS (SELECT CAST(doc_id AS VARCHAR) AS path, CASE WHEN doc_id % 7 = 0 THEN 'third ' || text WHEN doc_id % 4 = 0 AND doc_id % 5 <> 0 THEN 'second ' || text ELSE text END AS content, CASE WHEN doc_id % 7 = 0 OR doc_id % 5 = 0 THEN '03' WHEN doc_id % 4 = 0 OR doc_id % 3 = 0 THEN '02' ELSE '01' END AS day FROM documents),
t AS (SELECT *, list_filter(regexp_split_to_array(lower(coalesce(content, '')), '{SEPARATOR}'), lambda t: t <> '') AS ts FROM d)
SELECT path, md5(content) AS content, day, CAST(len(list_distinct(ts)) AS BIGINT) AS terms, CAST(len(ts) AS BIGINT) AS words FROM t
"""


def s3_assign_package(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files in folders by source and language; sources are packages, and so is one language of every second."""
    d = table(spark, sf_dir, "documents")
    paths = d.select(F.concat_ws("/", F.when(F.col("doc_id") % 7 == 0, F.lit("loose")).otherwise(F.col("source")), "lang", F.col("doc_id").cast("string")).alias("path"))
    tops = d.select(F.col("source").alias("name"), F.col("source").alias("dir")).distinct()
    subs = d.where("lang = 'fr'").select(F.concat("source", F.lit("-fr")).alias("name"), F.concat("source", F.lit("/fr")).alias("dir")).distinct()
    return S.assign_package(paths, tops.unionByName(subs))


S3_SQL = "SELECT CASE WHEN doc_id % 7 = 0 THEN 'loose' ELSE source END || '/' || lang || '/' || doc_id AS path, CASE WHEN doc_id % 7 <> 0 THEN CASE WHEN lang = 'fr' THEN source || '-fr' ELSE source END END AS package FROM documents"


def s1_file_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as a tree of XML and JSON files by source, once more in a folder that is left out: records of kept files by source."""
    folder, d = scratch(spark), table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    for place, form in (("kept", "xml"), ("kept", "json"), ("kept/maps", "xml")):
        d.write.mode("append").partitionBy("source").option("rowTag", "doc").format(form).save(f"{folder}/{place}")
    m = S.file_manifest(spark, folder)
    records = F.regexp_count(F.decode("content", "UTF-8"), F.lit("<doc_id>"))
    return m.groupBy(F.regexp_extract("path", "source=([^/]*)/", 1).alias("source"), "ext").agg(F.sum(records).alias("n"))


S1_SQL = "SELECT source, '.xml' AS ext, count(*) AS n FROM documents GROUP BY source"


def s2_discover_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as folders with a marker file: every 4th of them one level too deep, the next without a name to show."""
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey")
    path = F.concat(F.when(k % 4 == 0, "deep/").otherwise(""), "c_name", F.lit(f"/{S.PACKAGE_MARKER}"))
    mark = F.concat(F.lit("<?xml version='1.0'?><package"), F.when(k % 4 == 1, "").otherwise(F.concat(F.lit(' name="'), "c_mktsegment", F.lit('"'))), F.lit("/>"))
    other = c.select(F.concat("c_name", F.lit("/weapons/a.weapon")).alias("path"), F.encode(F.lit("<weapon/>"), "UTF-8").alias("content"))
    return S.discover_packages(c.select(path.alias("path"), F.encode(mark, "UTF-8").alias("content")).unionByName(other), "root")


S2_SQL = "SELECT c_name AS name, CASE c_custkey % 4 WHEN 1 THEN c_name ELSE c_mktsegment END AS display_name, c_name AS dir FROM customer WHERE c_custkey % 4 <> 0"


def s6_xml_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as files of their orders: calls, weapons and unknown elements; files of every 11th are cut short."""
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    tag = F.when(k % 3 == 0, "weapon").when(k % 3 == 1, "call").otherwise("thing")
    xml = F.concat(F.lit("<"), tag, F.lit(' key="k'), k.cast("string"), F.lit('" status="'), F.col("o_orderstatus"), F.lit('"/>'))
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("o_orderkey", xml.alias("x")))), lambda e: e["x"]), "")
    files = o.groupBy(F.col("o_custkey").cast("string").alias("path")).agg(body.alias("b"))
    files = files.select("path", F.concat(F.lit("<file>"), "b", F.when(F.col("path").cast("long") % 11 == 0, "").otherwise("</file")).alias("c")).select("path", F.when(F.endswith("c", F.lit("</file")), F.concat("c", F.lit(">"))).otherwise(F.concat("c", F.lit(" cut"))).alias("content"))
    return S.xml_records(files).select("path", "pos", "type", "key", F.col("attrs")["status"].alias("status"))


S6_SQL = """
WITH o AS (SELECT CAST(o_custkey AS VARCHAR) AS path, o_orderkey AS k, o_orderstatus AS st FROM orders WHERE o_custkey % 11 <> 0), r AS (SELECT path, CAST(row_number() OVER (PARTITION BY path ORDER BY k) - 1 AS INTEGER) AS pos, CASE k % 3 WHEN 0 THEN 'weapon' ELSE 'call' END AS type, 'k' || k AS key, st AS status FROM o WHERE k % 3 <> 2)
SELECT * FROM r UNION ALL SELECT DISTINCT path, 0, 'generic', path, NULL FROM o WHERE path NOT IN (SELECT path FROM r)
"""


def s6_typed_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as files of their orders, with lines nested in them, comments and CDATA: a faction's soldiers, weapons, a single vehicle, or unknown; files of every 11th are cut short."""
    o, k = table(spark, sf_dir, "orders"), F.col("o_custkey")
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda x: F.concat(F.lit('<line part="0'), x["l_partkey"].cast("string"), F.lit('"/>'))), "<!-- <soldier key='no'/> -->").alias("lines"))
    kind = F.element_at(F.array(*map(F.lit, ["soldier", "weapon", "vehicle", "thing"])), (k % 4 + 1).cast("int"))
    xml = F.concat(F.lit("<"), kind, F.lit(' key="k'), F.col("o_orderkey").cast("string"), F.lit('">'), F.coalesce("lines", F.lit("")), F.lit("<state><![CDATA[<"), "o_orderstatus", F.lit(">]]></state></"), kind, F.lit(">"))
    files = o.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").groupBy("o_custkey").agg(F.sort_array(F.collect_list(F.struct("o_orderkey", xml.alias("x")))).alias("e"))
    body = F.when(k % 4 == 2, F.get("e", F.lit(0))["x"]).otherwise(F.array_join(F.transform("e", lambda e: e["x"]), "\n"))
    root = F.element_at(F.array(*map(F.lit, ["faction", "weapons", "", "things"])), (k % 4 + 1).cast("int"))
    whole = F.when(k % 4 == 2, body).otherwise(F.concat(F.lit("<"), root, F.lit(' name="c'), k.cast("string"), F.lit('">'), body, F.lit("</"), root, F.lit(">")))
    files = files.select(F.concat(F.lit("a/"), k.cast("string"), F.lit(".xml")).alias("path"), F.when(k % 11 == 0, F.substring(whole, F.lit(1), F.length(whole) - 2)).otherwise(whole).alias("content"))
    rows = R.typed_records(files)
    line = F.try_variant_get("tree", "$.line", "variant")
    return rows.select("path", "pos", "type", "key", "faction", F.coalesce(F.size(R.listed(line)), F.lit(0)).alias("lines"), F.try_variant_get(F.get(R.listed(line), F.lit(0)), "$['@_part']", "string").alias("part"), F.try_variant_get("tree", "$.state", "string").alias("state"))


S6_TYPED_SQL = """
WITH l AS (SELECT l_orderkey, count(*) AS n, '0' || arg_min(l_partkey, (l_linenumber, l_partkey)) AS part FROM lineitem GROUP BY 1),
o AS (SELECT o_custkey AS c, 'a/' || o_custkey || '.xml' AS path, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS INTEGER) AS pos, o_orderkey AS k, '<' || o_orderstatus || '>' AS state, CAST(coalesce(n, 0) AS INTEGER) AS n, part FROM orders LEFT JOIN l ON l_orderkey = o_orderkey WHERE o_custkey % 11 <> 0)
SELECT path, pos, ['soldier', 'weapon', 'vehicle'][c % 4 + 1] AS type, 'k' || k AS key, CASE WHEN c % 4 = 0 THEN 'c' || c END AS faction, n AS lines, part, state FROM o WHERE c % 4 < 2 OR c % 4 = 2 AND pos = 0
UNION ALL SELECT DISTINCT path, 0, 'script_chunk', CAST(c AS VARCHAR), NULL, 0, NULL, NULL FROM o WHERE c % 4 = 3
"""


def s10_translations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as files of texts of their customers, even ones English; the first of a language is read by itself, each includes the next of its language, in a ring, of which ten levels are read."""
    c, k = table(spark, sf_dir, "customer"), F.col("c_nationkey")
    text = F.concat(F.lit('<text key="'), F.col("c_mktsegment"), F.lit('" text="'), "c_name", F.lit('"/>'))
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("c_custkey", text.alias("t")))), lambda x: x["t"]), "")
    files = c.groupBy("c_nationkey").agg(body.alias("b"))
    files = files.select(F.when(k % 2 == 0, "en").otherwise("cn").alias("lang"), F.concat(k.cast("string"), F.lit(".xml")).alias("path"), (k < 2).alias("entry"), F.concat(F.lit('<r><include file="'), F.when(k < 23, k + 2).otherwise(k % 2).cast("string"), F.lit('.xml"/>'), "b", F.lit("</r>")).alias("content"))
    return S.translations(files)


S10_SQL = """
SELECT CASE WHEN c_nationkey % 2 = 0 THEN 'en' ELSE 'cn' END AS lang, c_mktsegment AS key, arg_max(c_name, (-c_nationkey, c_custkey)) AS text FROM customer WHERE c_nationkey < 22 GROUP BY 1, 2
"""


def s11_write_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as a corpus and read back, with the header's count."""
    folder = scratch(spark)
    S.write_corpus(table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("mod"), F.col("text").alias("content")), folder)
    header, docs = S.read_corpus(spark, folder)
    per = docs.groupBy("mod").agg(F.count("*").alias("n"), F.sum(F.length("content")).alias("chars"))
    return per.join(header.select(F.explode("packages").alias("p"), "documents").select("p.mod", F.col("p.n").alias("told"), "documents"), "mod")


S11_SQL = "SELECT source AS mod, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars, count(*) AS told, (SELECT count(*) FROM documents) AS documents FROM documents GROUP BY source"


def d4_hit_protection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of an order as modifiers."""
    li = table(spark, sf_dir, "lineitem")
    names = list(C.PROTECTION_CLASSES)
    kind = F.when(F.col("l_suppkey") % 4 == 3, "speed").otherwise(F.element_at(F.array(*map(F.lit, names)), (F.col("l_suppkey") % 4 + 1).cast("int")))
    rows = li.select(F.col("l_orderkey").alias("entity"), F.struct("l_linenumber", "l_partkey").alias("pos"), kind.alias("class"), F.when(F.col("l_returnflag") == "R", "wound").otherwise("death").alias("input"), F.col("l_linestatus").alias("output"), F.col("l_partkey").cast("string").alias("value"))
    return C.hit_protection(rows).select("entity", F.array_join("facts", "; ").alias("facts"))


D4_SQL = f"""
SELECT l_orderkey AS entity, string_agg({list(C.PROTECTION_CLASSES.values())!r}[CAST(l_suppkey % 4 + 1 AS INTEGER)] || ' ' || l_linestatus || ' ' || l_partkey, '; ' ORDER BY l_linenumber, l_partkey, {list(C.PROTECTION_CLASSES.values())!r}[CAST(l_suppkey % 4 + 1 AS INTEGER)], l_linestatus) AS facts
FROM lineitem WHERE l_returnflag <> 'R' AND l_suppkey % 4 <> 3 GROUP BY l_orderkey
"""

def d6_expand_includes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as files of their orders; every order of a number divisible by 5 includes the file of the customer half as far, a cycle back from 1 to 2."""
    o = table(spark, sf_dir, "orders")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    half = F.when(c == 1, 2).otherwise(F.floor(c / 2))
    rows = o.select(c.cast("string").alias("path"), k.alias("ord"), F.when(k % 5 == 0, half.cast("string")).alias("include"), F.when(k % 5 != 0, k).alias("value"))
    return C.expand_includes(rows, 4).groupBy("root").agg(F.count("*").alias("n"), F.sum("value").alias("total"), F.count_distinct("path").alias("files"), F.max(F.size("ord")).alias("deepest"))


D6_SQL = """
WITH RECURSIVE r AS (SELECT o_custkey AS path, o_orderkey AS ord, CASE WHEN o_orderkey % 5 = 0 THEN CASE WHEN o_custkey = 1 THEN 2 ELSE o_custkey // 2 END END AS inc, o_orderkey AS v FROM orders),
w AS (SELECT path AS root, path, [path] AS seen, inc, v, 1 AS d FROM r UNION ALL SELECT w.root, r.path, list_append(seen, r.path), r.inc, r.v, d + 1 FROM w JOIN r ON w.inc = r.path AND NOT list_contains(seen, r.path) WHERE d <= 4)
SELECT CAST(root AS VARCHAR) AS root, count(*) AS n, CAST(sum(v) AS BIGINT) AS total, count(DISTINCT path) AS files, max(d) AS deepest FROM w WHERE inc IS NULL GROUP BY root
"""

QUERIES = {f.__name__: f for f in (st1_read_events, st2_session_state, st2_session_reads, st3_open_turns, st3_turn_admissions, st4_announce_once, st5_summary_due, st5_summary_due_batch, st6_tool_calls, st6_turn_rollup, st7_refresh, st7_stored_corpus, s1_file_manifest, s2_discover_packages, s3_assign_package, s6_xml_records, s6_typed_records, s10_translations, s11_write_corpus, d4_hit_protection, d6_expand_includes)}
ORACLE_SQL = {k: globals()[k.split("_")[0].upper() + "_SQL"] for k in QUERIES} | {"st6_turn_rollup": ST6_ROLLUP_SQL, "s6_typed_records": S6_TYPED_SQL, "st7_stored_corpus": ST7_STORED_SQL}
