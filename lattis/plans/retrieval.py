"""Retrieval R1 to R14 and evaluation E1 to E9.

Documents: key <source>_<doc_id>, name source and the first two words, content the text, type the language, package the
source. Queries: the text of every benchmark item, with terms that begin with or are spelt nearly as its own. Relevant:
documents that hold an item's text.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattis.functions.text import ENTITY_STOP_WORDS, SEPARATOR
from lattis.operators import evaluation as E
from lattis.operators import index as I
from lattis.operators import retrieval as R
from lattis.plans.common import sql_text, table, values_sql
from lattis.session import keep, shared_dir


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    first = F.array_join(F.slice(F.split("text", " "), 1, 2), " ")
    return d.select("doc_id", F.concat("source", F.lit("_"), F.col("doc_id").cast("string")).alias("key"), F.concat("source", F.lit(" "), first).alias("name"), F.col("text").alias("content"), F.col("lang").alias("type"), F.col("source").alias("mod"))


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("q"))


FIELDS = {"key": False, "name": False, "content": False, "type": False}
D_SQL = "(SELECT doc_id, source || '_' || doc_id AS key, source || ' ' || array_to_string(string_split(text, ' ')[1:2], ' ') AS name, text AS content, lang AS type, source AS mod FROM documents)"
Q_SQL = "(SELECT item_id AS qid, text AS q FROM benchmark)"
TERMS = lambda x: f"list_filter(regexp_split_to_array(lower({x}), '{SEPARATOR}'), lambda t: t <> '')"
P_CTE = f"d AS {D_SQL}, q AS {Q_SQL}, p AS (SELECT doc_id, field, term, count(*) AS tf FROM (" + " UNION ALL ".join(f"SELECT doc_id, '{f}' AS field, unnest({TERMS(f)}) AS term FROM d" for f in FIELDS) + ") GROUP BY ALL), qt AS (SELECT DISTINCT qid, unnest(" + TERMS("q") + ") AS term, 1.0 AS weight FROM q)"


def rank_cte(name: str, terms: str, boosts: dict[str, float]) -> str:
    """CTE name(qid, doc_id, score, rank) of terms(qid, term, weight)."""
    b = values_sql([(f, w) for f, w in boosts.items() if f in FIELDS], "field, boost")
    return f"""
{name}_p AS (SELECT p.*, boost FROM p JOIN {b} USING (field)), {name}_l AS (SELECT field, doc_id, sum(tf) AS len FROM {name}_p GROUP BY ALL),
{name}_m AS (SELECT field, sum(len) / (SELECT count(*) FROM d) AS mean FROM {name}_l GROUP BY field), {name}_f AS (SELECT field, term, count(*) AS df FROM {name}_p GROUP BY ALL),
{name} AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM (
 SELECT qid, doc_id, round(sum(CAST(boost AS DOUBLE) * CAST(weight AS DOUBLE) * ln(1 + ((SELECT count(*) FROM d) - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * ({I.DELTA}::DOUBLE + tf * {I.K1 + 1}::DOUBLE / (tf + {I.K1}::DOUBLE * ({1 - I.B}::DOUBLE + {I.B}::DOUBLE * len / mean)))), 6) AS score
 FROM {terms} JOIN {name}_p USING (term) JOIN {name}_f USING (field, term) JOIN {name}_l USING (field, doc_id) JOIN {name}_m USING (field) GROUP BY qid, doc_id))"""


#: DuckDB counts edits in bytes: letters beyond ASCII are mapped to one byte each.
ONE_BYTE = lambda c: f"translate({c}, 'éèêçñíóáúüöäß', '!#$%&()*+,-./')"


def expand_cte(name: str, terms: str) -> str:
    """CTEs: name_x(term, expanded, kind, weight) of terms(qid, term, weight), and name(qid, term, weight) with what it adds."""
    return f"""
{name}_v AS (SELECT DISTINCT term AS e FROM p), {name}_t AS (SELECT DISTINCT term FROM {terms}), {name}_k AS (SELECT term, CAST(round(length(term) * {R.FUZZY}) AS INTEGER) AS k FROM {name}_t),
{name}_x AS (SELECT term, e AS expanded, 'prefix' AS kind, round({R.PREFIX_WEIGHT}::DOUBLE * length(term) / length(e), 6) AS weight FROM {name}_t JOIN {name}_v ON starts_with(e, term) AND e <> term AND substr(e, 1, 1) = substr(term, 1, 1)
 UNION ALL SELECT term, e, 'fuzzy', round({R.FUZZY_WEIGHT}::DOUBLE * (1 - levenshtein({ONE_BYTE('term')}, {ONE_BYTE('e')}) / length(term)), 6) FROM (SELECT *, unnest(range(length(term) - k, length(term) + k + 1)) AS z FROM {name}_k WHERE k > 0) k2 JOIN {name}_v ON length(e) = z WHERE levenshtein({ONE_BYTE('term')}, {ONE_BYTE('e')}) BETWEEN 1 AND k AND NOT starts_with(e, term)),
{name} AS (SELECT qid, term, max(weight) AS weight FROM (SELECT * FROM {terms} UNION ALL SELECT qid, expanded, x.weight FROM {terms} q JOIN {name}_x x USING (term)) GROUP BY ALL)"""


R_CTE = P_CTE + "," + expand_cte("qe", "qt") + "," + rank_cte("r", "qe", R.BOOSTS)


COLUMNS = ["type", "mod"]


def index(spark: SparkSession, sf_dir: str) -> I.SearchIndex:
    """The stored index of the documents, below spark.lattis.index.dir if that is set, else in the shared folder; written if these files, in size and time, have none yet."""
    files = table(spark, sf_dir, "documents").select(F.xxhash64("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").cast("decimal(38,0)").alias("f")).distinct()
    n, told = files.agg(F.count("*"), F.sum("f")).first()
    root = spark.conf.get("spark.lattis.index.dir", None) or shared_dir(spark)
    path = f"{root}/index-{uuid.uuid5(uuid.NAMESPACE_URL, f'{sf_dir} {n} {told}').hex}"
    if not I.exists(spark, path):
        I.write_index(docs(spark, sf_dir), path, FIELDS, COLUMNS)
    return I.open_index(spark, path)


def ranked(spark: SparkSession, sf_dir: str, k: int | None = None, found: I.SearchIndex | None = None, wanted: DataFrame | None = None, each: Callable[[DataFrame], DataFrame] | None = None, others: bool = False) -> DataFrame:
    """What the queries' terms find, and what these expand to; or what each makes of it, query by query."""
    found = found or index(spark, sf_dir)
    terms = R.query_terms(queries(spark, sf_dir))
    return I.search_terms(found, terms, R.BOOSTS, k, R.fuzzy_terms(terms, found.vocabulary), wanted, COLUMNS, prefixed=R.PREFIX_WEIGHT, each=each, others=others)


def r1_build_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = index(spark, sf_dir).postings
    return rows.select("field", "term", F.explode(F.arrays_zip("docs", "tfs")).alias("x")).select("field", "term", F.col("x.docs").alias("doc_id"), F.col("x.tfs").alias("tf"))


R1_SQL = f"WITH {P_CTE} SELECT field, term, doc_id, tf FROM p"


def r2_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(spark, sf_dir, 50)


R2_SQL = f"WITH {R_CTE} SELECT * FROM r WHERE rank <= 50"


def r3_expand_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms of the queries, expanded over the words of all documents."""
    return R.expand_terms(R.query_terms(queries(spark, sf_dir)), index(spark, sf_dir).vocabulary)


R3_SQL = f"WITH {P_CTE}, {expand_cte('qe', 'qt')} SELECT * FROM qe_x"


def r4_pin_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.pin_entities(queries(spark, sf_dir), index(spark, sf_dir))


STOP = ", ".join(map(sql_text, ENTITY_STOP_WORDS))
PIN_CTE = R_CTE + f""",
et AS (SELECT qid, unnest(ts) AS token, unnest(range(len(ts))) AS pos FROM (SELECT qid, list_filter(regexp_extract_all(q, '[a-zA-Z][a-zA-Z0-9_-]{{1,}}'), lambda t: lower(t) NOT IN ({STOP}))[1:5] AS ts FROM q)),
tt AS (SELECT DISTINCT {{'q': qid, 'p': pos}} AS qid, unnest({TERMS('token')}) AS term, 1.0 AS weight FROM et),""" + expand_cte("te", "tt") + "," + rank_cte("h", "te", R.PIN_BOOSTS) + f""",
pf AS (SELECT h.qid.q AS qid, doc_id, round(arg_min(score, h.qid.p) * {R.PIN_FACTOR}, 6) AS score FROM h WHERE rank <= {R.PIN_PER_TOKEN} GROUP BY 1, 2),
pin AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM pf) WHERE rank <= {R.PIN_TOTAL})"""
R4_SQL = f"WITH {PIN_CTE} SELECT * FROM pin"


def filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = table(spark, sf_dir, "benchmark")
    return q.select(F.col("item_id").alias("qid"), F.when(F.col("item_id") % 3 == 0, "en").alias("want_type"), F.when(F.col("item_id") % 5 == 0, "src1").alias("want_mod"))


def r5_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places 3 to 22 of pinned, then ranked documents, filtered by type and package."""
    found, wanted = index(spark, sf_dir), filters(spark, sf_dir)
    pinned = keep(R.pin_entities(queries(spark, sf_dir), found))
    # of the best that pass the filters, as many as pinned ones may take away are asked for besides
    return R.merge_hits(pinned, ranked(spark, sf_dir, 22 + R.PIN_TOTAL, found, wanted), found.docs, wanted, COLUMNS, 2, 20)


R5_SQL = f"""
WITH {PIN_CTE}, u AS (SELECT *, true AS pinned FROM pin UNION ALL SELECT *, false FROM r WHERE NOT EXISTS (SELECT 1 FROM pin WHERE pin.qid = r.qid AND pin.doc_id = r.doc_id)),
f AS (SELECT u.*, row_number() OVER (PARTITION BY qid ORDER BY pinned DESC, rank) AS place FROM u JOIN d USING (doc_id) WHERE (qid % 3 <> 0 OR type = 'en') AND (qid % 5 <> 0 OR mod = 'src1'))
SELECT qid, doc_id, score, pinned, place FROM f WHERE place BETWEEN 3 AND 22
"""


def r6_exact_key_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each item asks for the key of the document of its number in one of 20 sources; the ten best keys that hold it."""
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.concat(F.lit("SRC"), (F.col("item_id") % 20).cast("string"), F.lit("_"), F.col("item_id").cast("string")).alias("key"))
    return R.exact_key_search(asked, index(spark, sf_dir), docs(spark, sf_dir))


R6_SQL = f"WITH {P_CTE}, a AS (SELECT item_id AS qid, 'src' || (item_id % 20) || '_' || item_id AS q FROM benchmark), aterm AS (SELECT DISTINCT qid, unnest({TERMS('q')}) AS term, 1.0 AS weight FROM a)," + rank_cte("x", "aterm", {**R.BOOSTS, "key": 10.0}) + """,
k AS (SELECT qid, doc_id, row_number() OVER (PARTITION BY qid ORDER BY rank) AS place FROM x JOIN d USING (doc_id) JOIN a USING (qid) WHERE contains(lower(d.key), a.q))
SELECT * FROM k WHERE place <= 10
"""


def r7_apply_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, wanted = index(spark, sf_dir), filters(spark, sf_dir)

    def told(hits: DataFrame) -> DataFrame:
        return R.apply_filters(hits.join(found.docs.select("doc_id", *COLUMNS), "doc_id"), wanted, COLUMNS).groupBy("qid", "type").agg(F.count("*").alias("n"), F.min("rank").alias("best"))

    return ranked(spark, sf_dir, found=found, each=told)


R7_SQL = f"WITH {R_CTE} SELECT qid, type, count(*) AS n, min(rank) AS best FROM r JOIN d USING (doc_id) WHERE (qid % 3 <> 0 OR type = 'en') AND (qid % 5 <> 0 OR mod = 'src1') GROUP BY qid, type"


def r8_scoped_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.when(F.col("item_id") % 4 == 0, "nowhere").when(F.col("item_id") % 4 == 1, "src2").alias("mod"), (F.col("item_id") % 40 - 1).alias("limit"))
    wanted = asked.select("qid", F.col("mod").alias("want_mod"))
    got = ranked(spark, sf_dir, R.SCOPED, wanted=wanted, each=lambda hits: R.scoped_hits(asked, hits, docs(spark, sf_dir)), others=True)
    return R.scoped_search(asked, got).withColumn("snippet", F.md5("snippet"))


R8_SQL = f"""
WITH {R_CTE}, a AS (SELECT item_id AS qid, CASE item_id % 4 WHEN 0 THEN 'nowhere' WHEN 1 THEN 'src2' END AS scope, greatest(1, least(30, item_id % 40 - 1)) AS lim FROM benchmark),
x AS (SELECT r.qid, r.doc_id, substr(content, 1, 500) AS cut, lim, scope IS NULL OR mod = scope AS ins, row_number() OVER (PARTITION BY r.qid, scope IS NULL OR mod = scope ORDER BY rank) AS k FROM r JOIN d USING (doc_id) JOIN a USING (qid)),
g AS (SELECT qid, count(*) FILTER (ins AND k <= lim) AS hits, count(*) FILTER (NOT ins) AS out, min(doc_id) FILTER (ins AND k = 1) AS top, min(cut) FILTER (ins AND k = 1) AS snippet FROM x GROUP BY qid)
SELECT a.qid, coalesce(hits, 0) AS hits, CASE WHEN coalesce(hits, 0) = 0 THEN coalesce(out, 0) ELSE 0 END AS elsewhere, coalesce(hits, 0) BETWEEN 1 AND 2 AS low_confidence, top, md5(snippet) AS snippet FROM a LEFT JOIN g USING (qid)
"""


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    first = p.groupBy("p_name").agg(F.min("p_partkey").alias("k"))
    return first.select(F.col("k").alias("id"), F.concat(F.lit("key_"), F.col("k").cast("string")).alias("key"), F.regexp_replace(F.lower("p_name"), "[^a-z0-9]+", "").alias("norm"), F.split(F.lower("p_name"), " ").alias("parts"), (F.col("k") % 3).alias("kind_rank"), F.col("k").alias("ord"), F.col("p_name").alias("raw"))


def r9_resolve_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part asks by key, by name in other spelling, by a part of the name, by mixed words, by a part of a key, or by nothing known."""
    k, w = F.col("p_partkey"), F.split("p_name", " ")
    name = F.when(k % 35 == 0, F.concat(F.lit("Y_"), (k % 90).cast("string"))).when(k % 5 == 0, F.concat(F.lit("KEY_"), (k % 200).cast("string"))).when(k % 5 == 1, F.upper("p_name")).when(k % 5 == 2, w[0]).when(k % 5 == 3, F.concat(w[1], F.lit(" zzz"))).otherwise(F.concat(w[1], F.lit(" "), w[0], F.lit(" qq")))
    return R.resolve_names(table(spark, sf_dir, "part").select(k.alias("rid"), name.alias("name")), names(spark, sf_dir))


R9_SQL = """
WITH n AS (SELECT min(p_partkey) AS id, 'key_' || min(p_partkey) AS key, regexp_replace(lower(p_name), '[^a-z0-9]+', '', 'g') AS norm, string_split(lower(p_name), ' ') AS parts, min(p_partkey) % 3 AS kr FROM part GROUP BY p_name),
q AS (SELECT p_partkey AS rid, lower(CASE WHEN p_partkey % 35 = 0 THEN 'Y_' || (p_partkey % 90) WHEN p_partkey % 5 = 0 THEN 'key_' || (p_partkey % 200) WHEN p_partkey % 5 = 1 THEN p_name WHEN p_partkey % 5 = 2 THEN string_split(p_name, ' ')[1] WHEN p_partkey % 5 = 3 THEN string_split(p_name, ' ')[2] || ' zzz' ELSE string_split(p_name, ' ')[2] || ' ' || string_split(p_name, ' ')[1] || ' qq' END) AS low FROM part),
r AS (SELECT rid, low, regexp_replace(low, '[^a-z0-9]+', '', 'g') AS want, list_distinct(list_filter(regexp_split_to_array(low, '[^a-z0-9]+'), lambda t: t <> '')) AS has FROM q),
c AS (SELECT rid, id, kr, CASE WHEN low = key THEN 1 WHEN want = norm THEN 2 WHEN want <> '' AND norm <> '' AND (contains(norm, want) OR contains(want, norm)) THEN 3 WHEN len(list_intersect(has, parts)) / len(has) >= 0.6 THEN 4 WHEN low <> '' AND contains(key, low) THEN 5 END AS rung, least(length(norm), length(want)) AS l, len(list_intersect(has, parts)) / len(has) AS s FROM r, n)
SELECT rid, id, rung FROM c WHERE rung IS NOT NULL QUALIFY row_number() OVER (PARTITION BY rid ORDER BY rung, CASE rung WHEN 3 THEN l WHEN 4 THEN round(s, 6) ELSE 0 END DESC, kr DESC, id) = 1
"""


def r10_suggest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that share words with the words of each part's name and type."""
    p = table(spark, sf_dir, "part").select(F.concat_ws(" ", "p_name", "p_type").alias("rid")).distinct()
    asked = p.select("rid", F.split(F.lower("rid"), " ").alias("parts"))
    known = table(spark, sf_dir, "part").select(F.concat_ws(" ", "p_name", "p_brand").alias("raw"), F.split(F.lower("p_name"), " ").alias("parts"))
    return R.suggest(asked, known, ["steel"])


R10_SQL = """
WITH a AS (SELECT DISTINCT p_name || ' ' || p_type AS rid FROM part), r AS (SELECT rid, list_filter(list_distinct(string_split(lower(rid), ' ')), lambda x: x <> 'steel') AS has FROM a),
n AS (SELECT DISTINCT p_name || ' ' || p_brand AS raw, list_distinct(string_split(lower(p_name), ' ')) AS parts FROM part),
h AS (SELECT rid, raw, len(list_intersect(has, parts)) AS b, len(has) AS z FROM r, n)
SELECT rid, raw, row_number() OVER (PARTITION BY rid ORDER BY b DESC, raw) AS place FROM h WHERE b >= 2 AND b / z >= 0.5 QUALIFY row_number() OVER (PARTITION BY rid ORDER BY b DESC, raw) <= 3
"""


def costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of a source as its hits, by length; a hit costs a quarter of its characters."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.concat_ws("/", F.col("source"), (F.col("doc_id") % 97).cast("string")).alias("qid"), F.col("doc_id").alias("rank"), F.floor(F.col("n_chars") / 4).alias("cost"))


COST_SQL = "(SELECT source || '/' || (doc_id % 97) AS qid, doc_id AS rank, n_chars // 4 AS cost FROM documents)"


def r11_pack_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.pack_prefix(costs(spark, sf_dir), 1000)


R11_SQL = f"SELECT *, sum(cost) OVER (PARTITION BY qid ORDER BY rank) <= 1000 AS whole FROM {COST_SQL}"


def r12_pack_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.pack_greedy(costs(spark, sf_dir), 1000)


R12_SQL = f"""
WITH RECURSIVE c AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rank) AS i FROM {COST_SQL}),
f AS (SELECT qid, rank, i, cost <= 1000 AS whole, CASE WHEN cost <= 1000 THEN cost ELSE 0 END AS used FROM c WHERE i = 1
 UNION ALL SELECT c.qid, c.rank, c.i, used + cost <= 1000, CASE WHEN used + cost <= 1000 THEN used + cost ELSE used END FROM f JOIN c ON c.qid = f.qid AND c.i = f.i + 1)
SELECT qid, rank, whole FROM f
"""


def r13_fit_drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.fit_drafts(costs(spark, sf_dir).select(F.col("qid").alias("turn"), F.col("rank").alias("i"), F.col("cost").alias("tokens")), 2000)


R13_SQL = f"""
WITH c AS (SELECT qid AS turn, rank AS i, cost AS tokens, sum(cost) OVER (PARTITION BY qid) AS t, count(*) OVER (PARTITION BY qid) AS n FROM {COST_SQL})
SELECT turn, i, tokens, CAST(CASE WHEN t <= 2000 OR tokens <= 2000 // n THEN tokens ELSE least(tokens, greatest(500, tokens * 2000 // t)) END AS BIGINT) AS allowed FROM c
"""


def r14_fit_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.fit_tail(costs(spark, sf_dir).select(F.split("qid", "/")[0].alias("turn"), F.col("rank").alias("pos"), F.col("cost").alias("tokens")), 5000)


R14_SQL = "SELECT source AS turn, doc_id AS pos, n_chars // 4 AS tokens, sum(n_chars // 4) OVER w <= 5000 OR row_number() OVER w <= 5 AS kept FROM documents WINDOW w AS (PARTITION BY source ORDER BY doc_id DESC)"

# --- evaluation -------------------------------------------------------------------------------------------------------

CRAFTED_CASES = [("x1", "exact-key", "gkw_g36.weapon", "GKW_G36.weapon|m4_a1", "weapon"), ("x2", "enumeration", "有哪些 m4", "m4-a1", "weapon"), ("x3", "edge-case", "步枪", "", None), ("x4", "edge-case", "nothing at all expected here, a long query", "", None), ("x5", "bilingual", "步枪", "rifle", "vehicle")]
CRAFTED_HITS = [("x1", 1, "g36.weapon", "weapon"), ("x1", 2, "zzz", "weapon"), ("x1", 3, "m4a1.xml", "weapon"), ("x2", 1, "m4a", "vehicle"), ("x2", 2, "m4a1x", "weapon"), ("x2", 7, "m4-a1.call", "weapon"), ("x4", 1, "some", "weapon"), ("x5", 1, "pistol", "weapon")]


def cases_and_hits(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Items with the keys of the documents that hold them; the top 20 of each query; and crafted cases."""
    b, d = table(spark, sf_dir, "benchmark"), docs(spark, sf_dir)
    held = R.holding(b.select(F.col("item_id").alias("item"), F.col("text").alias("s")), d.select(F.col("key").alias("doc"), F.col("content").alias("t")))
    rel = held.groupBy(F.col("item").alias("item_id")).agg(F.sort_array(F.collect_list("doc")).alias("expected"))
    cases = b.join(rel, "item_id", "left").select(F.col("item_id").cast("string").alias("id"), F.col("text").alias("query"), F.when(F.col("item_id") % 3 == 0, "exact-key").otherwise("specific-item").alias("category"), F.coalesce("expected", F.array().cast("array<string>")).alias("expected"), F.when(F.col("item_id") % 2 == 0, "en").alias("expected_type"))
    crafted = spark.createDataFrame(CRAFTED_CASES, "id string, category string, query string, expected string, expected_type string")
    crafted = crafted.withColumn("expected", F.filter(F.split("expected", r"\|"), lambda k: k != "")).select("id", "query", "category", "expected", "expected_type")
    hits = ranked(spark, sf_dir, 20).join(d.select("doc_id", "key", "type"), "doc_id").select(F.col("qid").cast("string").alias("id"), F.col("rank").cast("int").alias("rank"), "key", "type")
    return keep(cases.unionByName(crafted)), keep(hits.unionByName(spark.createDataFrame(CRAFTED_HITS, "id string, rank int, key string, type string")))


NORM = lambda c: f"regexp_replace(regexp_replace(regexp_replace(lower({c}), '{E.KEY_SUFFIX}', ''), '{E.KEY_PREFIX}', ''), '[_-]', '', 'g')"
EVAL_CTE = R_CTE + f""",
cs AS (SELECT CAST(item_id AS VARCHAR) AS id, text AS query, CASE WHEN item_id % 3 = 0 THEN 'exact-key' ELSE 'specific-item' END AS category,
  coalesce((SELECT list(key ORDER BY key) FROM d WHERE contains(content, b.text)), []) AS expected, CASE WHEN item_id % 2 = 0 THEN 'en' END AS expected_type FROM benchmark b
  UNION ALL SELECT id, query, category, list_filter(string_split(expected, '|'), lambda k: k <> ''), et FROM {values_sql(CRAFTED_CASES, 'id, category, query, expected, et')}),
hs AS (SELECT CAST(qid AS VARCHAR) AS id, CAST(rank AS INTEGER) AS rank, key, type FROM r JOIN d USING (doc_id) WHERE rank <= 20 UNION ALL SELECT * FROM {values_sql(CRAFTED_HITS, 'id, rank, key, type')}),
mk AS (SELECT w.id, pos, rank FROM (SELECT id, unnest(expected) AS k, unnest(range(len(expected))) AS pos FROM cs) w JOIN hs USING (id) WHERE contains({NORM('key')}, {NORM('k')}) OR contains({NORM('k')}, {NORM('key')})),
bp AS (SELECT id, pos, min(rank) AS rank FROM mk GROUP BY ALL), br AS (SELECT DISTINCT id, rank FROM mk),
mt AS (SELECT cs.id, len(expected) AS n_expected, (SELECT count(*) FROM hs WHERE hs.id = cs.id) AS n_returned,
  {', '.join(f"CASE WHEN len(expected) = 0 THEN 1.0 ELSE round((SELECT count(*) FROM bp WHERE bp.id = cs.id AND rank <= {k}) / len(expected), 9) END AS recall_{k}" for k in (1, 5, 10, 20))},
  CASE WHEN len(expected) = 0 THEN CASE WHEN EXISTS (SELECT 1 FROM hs WHERE hs.id = cs.id) THEN 0.0 ELSE 1.0 END WHEN NOT EXISTS (SELECT 1 FROM hs WHERE hs.id = cs.id) THEN 0.0 ELSE round((SELECT count(*) FROM br WHERE br.id = cs.id AND rank <= 5) / least(5, (SELECT count(*) FROM hs WHERE hs.id = cs.id)), 9) END AS precision_5,
  CASE WHEN len(expected) = 0 THEN 1.0 ELSE coalesce(round(1 / (SELECT min(rank) FROM br WHERE br.id = cs.id AND rank <= 10), 9), 0) END AS mrr_10,
  CASE WHEN len(expected) = 0 THEN 1.0 ELSE coalesce(round((SELECT sum(1 / log2(rank + 1)) FROM br WHERE br.id = cs.id AND rank <= 10) / list_sum(list_transform(range(1, least(len(expected), 10) + 1), lambda i: 1 / log2(i + 1))), 9), 0) END AS ndcg_10 FROM cs),
jd AS (SELECT mt.*, query, category, expected_type IS NULL OR n_returned = 0 OR has AS type_correct, n_returned = 0 AS empty,
  recall_5 >= 0.5 AND (CASE WHEN n_expected = 0 THEN n_returned = 0 ELSE n_returned > 0 END) AND (expected_type IS NULL OR n_returned = 0 OR has) AS passed,
  CASE WHEN n_expected = 0 THEN CASE WHEN n_returned = 0 THEN 'none' ELSE 'low_confidence' END WHEN n_returned = 0 THEN 'candidate_missing' WHEN recall_5 = 0 THEN CASE WHEN NOT has AND expected_type IS NOT NULL THEN 'intent_wrong' ELSE 'candidate_missing' END WHEN recall_5 < 1 THEN 'rerank_wrong' ELSE 'none' END AS reason
  FROM mt JOIN (SELECT cs.*, EXISTS (SELECT 1 FROM hs WHERE hs.id = cs.id AND hs.type = cs.expected_type) AS has FROM cs) USING (id))"""


def e1_match_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.match_keys(*cases_and_hits(spark, sf_dir))


def e2_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.recall_at_k(*cases_and_hits(spark, sf_dir))


def e3_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.precision_at_k(*cases_and_hits(spark, sf_dir))


def e4_mrr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.mrr_at_k(*cases_and_hits(spark, sf_dir))


def e5_ndcg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.ndcg_at_k(*cases_and_hits(spark, sf_dir))


def e6_judge_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.judge_cases(*cases_and_hits(spark, sf_dir))


def e7_summarize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.summarize_eval(e6_judge_cases(spark, sf_dir))


def e8_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.bucket_eval(e6_judge_cases(spark, sf_dir))


def e9_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p50 and p95 of the event values of each type."""
    return E.index_percentile(table(spark, sf_dir, "events"), "value", [0.5, 0.95], "event_type")


E1_SQL = f"WITH {EVAL_CTE} SELECT * FROM mk"
E2_SQL = f"WITH {EVAL_CTE} SELECT id, recall_1, recall_5, recall_10, recall_20 FROM mt"
E3_SQL = f"WITH {EVAL_CTE} SELECT id, precision_5 FROM mt"
E4_SQL = f"WITH {EVAL_CTE} SELECT id, mrr_10 FROM mt"
E5_SQL = f"WITH {EVAL_CTE} SELECT id, ndcg_10 FROM mt"
E6_SQL = f"WITH {EVAL_CTE} SELECT * FROM jd"
AVG = lambda c: f"round(avg({c}), 6) AS {c}"
E7_SQL = f"""WITH {EVAL_CTE} SELECT count(*) AS cases, count(*) FILTER (passed) AS passed, {', '.join(map(AVG, E.MEANS))}, round(avg(empty::INTEGER), 6) AS empty_rate, round(avg(type_correct::INTEGER), 6) AS type_accuracy,
coalesce(round(count(*) FILTER (category = 'exact-key' AND recall_5 = 1) / nullif(count(*) FILTER (category = 'exact-key'), 0), 6), 1.0) AS exact_key_rate, {', '.join(f"count(*) FILTER (reason = '{r}') AS reason_{r}" for r in ('intent_wrong', 'candidate_missing', 'rerank_wrong', 'low_confidence', 'none'))} FROM jd"""
E8_SQL = f"""WITH {EVAL_CTE}, bk AS (SELECT *, unnest([category, 'lang:' || CASE WHEN regexp_matches(query, '[⺀-鿿가-힯豈-﫿]') THEN CASE WHEN regexp_matches(query, '[a-zA-Z]') THEN 'mixed' ELSE 'zh' END ELSE 'en' END, 'len:' || CASE WHEN length(query) <= 10 THEN 'short' WHEN length(query) <= 30 THEN 'medium' ELSE 'long' END]) AS bucket FROM jd)
SELECT bucket, count(*) AS n, count(*) FILTER (passed) AS passed, {', '.join(map(AVG, ('recall_5', 'precision_5', 'mrr_10', 'ndcg_10')))} FROM bk GROUP BY bucket"""
E9_SQL = "SELECT event_type, v[least(CAST(floor(len(v) * 0.5) AS BIGINT), len(v) - 1) + 1] AS p50, v[least(CAST(floor(len(v) * 0.95) AS BIGINT), len(v) - 1) + 1] AS p95 FROM (SELECT event_type, list(value ORDER BY value) AS v FROM events WHERE value IS NOT NULL GROUP BY event_type)"

QUERIES = {f.__name__: f for f in (r1_build_postings, r2_rank, r3_expand_terms, r4_pin_entities, r5_search, r6_exact_key_search, r7_apply_filters, r8_scoped_search, r9_resolve_names, r10_suggest, r11_pack_prefix, r12_pack_greedy, r13_fit_drafts, r14_fit_tail, e1_match_keys, e2_recall, e3_precision, e4_mrr, e5_ndcg, e6_judge_cases, e7_summarize, e8_buckets, e9_percentile)}
ORACLE_SQL = {k: globals()[k.split("_")[0].upper() + "_SQL"] for k in QUERIES}
