"""The registered queries opN_<name>, each over its whole table, and their DuckDB SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattis.llm import centroids, decontaminate, html_text, jaccard_join, language_id, licenses, line_rules, merkle, packing, quality, substring_dedup, topk_search, url_filter


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.top_k(table(spark, sf_dir, "embeddings"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.substring_dedup(table(spark, sf_dir, "documents"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(url_filter.RULES, "host string, path string, verdict string")
    return url_filter.judge(table(spark, sf_dir, "pages"), rules)


def op6_bestfit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op7_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_quality_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, more = table(spark, sf_dir, "documents"), F.col("n_chars").cast("long") + 1
    crc = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    tampered = F.when(crc % 7 == 0, merkle.leaf([more if c == "n_chars" else F.col(c) for c in merkle.COLUMNS]))
    rows = merkle.manifest(docs, carry={"tampered": tampered})
    proof = F.sha2(F.array_join(F.transform("path", lambda s: F.substring(s, 2, 64)), ""), 256)
    rows = rows.select("doc_id", F.lower(F.hex("leaf")).alias("leaf"), F.lower(F.hex("subroot")).alias("subroot"), F.lower(F.hex("root")).alias("root"), proof.alias("proof_sha256"), merkle.fold(F.coalesce("tampered", "leaf"), F.col("path")).alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = line_rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "content_share")


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.report(table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_topk_search, op2_language_id, op3_substring_dedup, op4_license_scan, op5_url_filter, op6_bestfit_packing, op7_html_extract, op8_decontaminate, op9_quality_resample, op10_jaccard_join, op11_merkle_manifest, op12_line_rules, op13_centroid_clustering)}

NUMBER_OF = {name: k for k, name in enumerate(licenses.SENTENCES)}
KNOWN = {licenses.normal(t): NUMBER_OF[name] for name, texts in licenses.SENTENCES.items() for t in texts}
KNOWN_SQL = ", ".join(f"('{t}', {k})" for t, k in KNOWN.items())
PATTERN, LICENCES = licenses.rule_patterns(licenses.RULES, NUMBER_OF)
MEANT = ", ".join(f"('{m}', '{name}')" for m, name in LICENCES.items())
UNIT = "'" + licenses.unit_pattern(list(KNOWN)).replace("\u0001", r"\x01").replace("\u0002", r"\x02") + "'"

SPACED = r"string_split(trim(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')), ' ')"
NUMBER = lambda x: rf"regexp_replace({x}, '(^|[^\p{{L}}\p{{N}}])\p{{N}}+(?:[.,:]\p{{N}}+)*($|[^\p{{L}}\p{{N}}])', '\1' || chr(2) || '\2', 'g')"


def template_sql(name: str, table: str, key: str, lengths: str) -> str:
    """CTEs up to {name}w(key, pos, n, w, slots): the windows of a text's template, of each of the lengths."""
    return rf"""
{name}0 AS (SELECT {key}, {SPACED} AS raw FROM {table} WHERE trim(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) <> ''),
{name}1 AS (SELECT {key}, raw, list_transform(raw, lambda t, i: CASE WHEN i > 1 AND regexp_matches(raw[i - 1], '[\p{{L}}\p{{N}},;)]$') THEN regexp_replace(t, '^\p{{Lu}}\p{{Ll}}+([^\p{{L}}\p{{N}}]|$)', chr(1) || '\1') ELSE t END) AS a FROM {name}0),
{name}2 AS (SELECT {key}, raw, list_transform(a, lambda t: {NUMBER(NUMBER('t'))}) AS b FROM {name}1),
{name}3 AS (SELECT {key}, raw, list_transform(b, lambda t, i: CASE WHEN i > 1 AND ends_with(b[i - 1], chr(2)) THEN regexp_replace(t, '(?i)^(?:{decontaminate.UNITS})([^\p{{L}}\p{{N}}]|$)', chr(3) || '\1') ELSE t END) AS c FROM {name}2),
{name} AS (SELECT {key}, raw, list_transform(c, lambda t: lower(regexp_replace(t, '[^\p{{L}}\p{{M}}\p{{N}}' || chr(1) || '-' || chr(3) || ']+', '', 'g'))) AS shape FROM {name}3),
{name}w AS (SELECT {key}, i AS pos, n, array_to_string(shape[i:i + n - 1], ' ') AS w,
  list_transform(list_filter(range(i, i + n), lambda j: regexp_matches(shape[j], '[' || chr(1) || '-' || chr(3) || ']')), lambda j: lower(regexp_replace(raw[j], '^[^\p{{L}}\p{{N}}]+|[^\p{{L}}\p{{N}}]+$', '', 'g'))) AS slots
  FROM (SELECT *, unnest(range(1, len(shape) - n + 2)) AS i FROM (SELECT *, unnest({lengths}) AS n FROM {name}) WHERE n <= len(shape)))"""


def leaf_sql(n_chars: str) -> str:
    text = lambda x: f"coalesce(CAST(strlen(CAST({x} AS VARCHAR)) AS VARCHAR) || ':' || CAST({x} AS VARCHAR), '-')"
    return f"sha256({' || '.join(text(x) for x in ('doc_id', 'source', 'lang', n_chars, 'text'))})"


def clustering_sql() -> str:
    """A CTE pair for each round: the assignment by distance, and the centroids it gives."""
    k, near = centroids.CLUSTERS, "SELECT vec_id, min_by(c, (d, c)) AS c, min(d) AS d FROM (SELECT v.vec_id, m.c, CAST(list_sum(list_transform(list_zip(v.e, m.e), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS d FROM v, {m} m) GROUP BY vec_id"
    sql = f"""
WITH x AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({centroids.SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings WHERE len(embedding) = {centroids.SIZE} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
v AS MATERIALIZED (SELECT * FROM x),
m0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS c, e FROM v ORDER BY c LIMIT {k})"""
    for t in range(centroids.ROUNDS):
        sql += f""",
a{t} AS MATERIALIZED ({near.format(m=f'm{t}')}),
s{t} AS (SELECT c, list(q ORDER BY i) AS e FROM (SELECT c, i, CAST((sum(x) - (((sum(x) % count(*)) + count(*)) % count(*))) // count(*) AS BIGINT) AS q FROM (SELECT c, unnest(e) AS x, unnest(range(len(e))) AS i FROM a{t} JOIN v USING (vec_id)) GROUP BY c, i) GROUP BY c),
m{t + 1} AS MATERIALIZED (SELECT c, coalesce(s{t}.e, m{t}.e) AS e FROM m{t} LEFT JOIN s{t} USING (c))"""
    last = f"m{centroids.ROUNDS}"
    return sql + f""",
z AS ({near.format(m=last)})
SELECT vec_id, CAST(c AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(e, ',')) AS centroid_sha256 FROM z JOIN {last} USING (c)
"""


ORACLE_SQL = {
    "op13_centroid_clustering": clustering_sql(),
    "op8_decontaminate": f"""
WITH {template_sql('b', 'benchmark', 'item_id', f'[least({decontaminate.WINDOW}, len(shape))]')}, {template_sql('d', 'documents', 'doc_id', '(SELECT list(DISTINCT n) FROM bw)')},
k AS (SELECT DISTINCT item_id, pos, w, n, slots, n - len(slots) < least({decontaminate.LITERAL}, n) AS dense FROM bw),
m AS (SELECT doc_id, item_id, dw.pos - k.pos AS o, k.pos AS pos, k.slots AS i, dw.slots AS d, dense, k.slots = dw.slots AS same FROM dw JOIN k ON dw.w = k.w AND dw.n = k.n),
s AS (SELECT doc_id, item_id, o, unnest(i) AS i, unnest(d) AS d FROM m WHERE NOT dense),
z AS (SELECT doc_id, item_id, o, count(DISTINCT (i, d)) AS p, count(DISTINCT i) AS n_slots, bool_and(i = d) AS exact FROM s GROUP BY ALL),
t AS (SELECT doc_id, item_id, o, count(DISTINCT i) AS same_slots FROM (SELECT doc_id, item_id, o, unnest(i) AS i FROM m WHERE same) GROUP BY ALL),
g AS (SELECT doc_id, item_id, o, count(DISTINCT pos) FILTER (NOT dense) AS n_open, count(DISTINCT pos) FILTER (same) AS n_same FROM m GROUP BY ALL),
a AS (SELECT g.*, coalesce(n_slots, 0) AS n_slots, coalesce(same_slots, 0) AS same_slots, coalesce(exact, true) AS exact, n_open > 0 AND coalesce(p = n_slots, true) AS whole
      FROM g LEFT JOIN z USING (doc_id, item_id, o) LEFT JOIN t USING (doc_id, item_id, o)),
f AS (SELECT doc_id, item_id, whole, CASE WHEN whole THEN n_open ELSE n_same END AS n_windows, CASE WHEN whole THEN n_slots ELSE same_slots END AS n_slots, CASE WHEN whole THEN exact ELSE true END AS exact FROM a WHERE whole OR n_same > 0)
SELECT doc_id, item_id, n_windows, n_slots, exact FROM f QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY whole DESC, n_windows DESC, exact DESC, n_slots DESC) = 1
""",
    "op4_license_scan": rf"""
WITH k(sentence, sid) AS (VALUES {KNOWN_SQL}), meant(m, licence) AS (VALUES {MEANT}),
a AS (SELECT row_number() OVER () AS r, doc_id, regexp_replace(regexp_replace(regexp_replace(text, '[.!?;:]+(\s|$)', chr(1) || '\1', 'g'), '\n[ \t\r]*\n', chr(1), 'g'), '\n', chr(2), 'g') AS t FROM documents WHERE text IS NOT NULL),
b AS (SELECT r, doc_id, regexp_replace(regexp_replace(regexp_replace(lower(t), '[^a-z0-9\x01\x02]+', ' ', 'g'), '[ \x01\x02]*\x01[ \x01\x02]*', ' ' || chr(1) || ' ' || chr(1) || ' ', 'g'), '[ ]*\x02[ \x02]*', ' ' || chr(2) || ' ' || chr(2) || ' ', 'g') AS t FROM a),
u AS (SELECT r, doc_id, regexp_extract_all(chr(1) || ' ' || trim(t) || ' ' || chr(1), {UNIT}, 1) AS us FROM b),
e AS (SELECT r, doc_id, sid, pos, lag(pos) OVER (PARTITION BY r ORDER BY pos) AS before FROM (SELECT r, doc_id, unnest(us) AS x, unnest(range(len(us))) AS pos FROM u) JOIN k ON sentence = replace(x, ' ' || chr(2) || ' ' || chr(2) || ' ', ' ')),
l AS (SELECT r, doc_id, string_agg(CASE WHEN pos - before > {licenses.GAP + 1} THEN ' | ' ELSE '' END || ' ' || sid || '@' || pos || ' ', '' ORDER BY pos) AS line FROM e GROUP BY r, doc_id),
f AS (SELECT doc_id, unnest(regexp_extract_all(line, '({PATTERN})')) AS m FROM l
      UNION ALL SELECT doc_id, unnest(regexp_extract_all(regexp_replace(line, '{PATTERN}', ' ', 'g'), '\d+@\d+')) AS m FROM l)
SELECT doc_id, coalesce(licence, 'unmatched') AS licence, count(*) AS n_found, min(CAST(regexp_extract(f.m, '@(\d+)', 1) AS BIGINT)) AS first_sentence FROM f LEFT JOIN meant ON meant.m = regexp_replace(f.m, '@\d+', '', 'g') GROUP BY 1, 2
""",
    "op1_topk_search": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS e FROM embeddings WHERE embedding IS NOT NULL),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10
""",
    "op3_substring_dedup": r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w WHERE len(ws) >= 13)),
low AS (SELECT s, min(doc_id) AS d FROM win GROUP BY s),
hit AS (SELECT DISTINCT win.doc_id, unnest(range(win.i, win.i + 13)) AS i FROM win JOIN low USING (s) WHERE low.d < win.doc_id),
gone AS (SELECT doc_id, list(i) AS g FROM hit GROUP BY doc_id),
kept AS (SELECT w.doc_id, len(ws) AS n, coalesce(len(g), 0) AS k,
         CASE WHEN g IS NULL THEN ws ELSE list_filter(ws, lambda x, i: NOT list_contains(g, i)) END AS rest FROM w LEFT JOIN gone USING (doc_id))
SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(k AS BIGINT) AS n_removed, sha256(coalesce(array_to_string(rest, ' '), '')) AS kept_sha256 FROM kept
""",
    "op5_url_filter": r"""
WITH r(rh, rp, v) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
m AS (SELECT p.*, rh || rp AS rule, v, row_number() OVER (PARTITION BY page_id ORDER BY length(rh || rp) DESC, length(rh) DESC) AS k
      FROM p LEFT JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp))
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM m WHERE k = 1
""",
    "op10_jaccard_join": r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 2], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 1, 2))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
x AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM x JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * k >= 90 * (na.n + nb.n - k)),
reach(a, b) AS (SELECT a, b FROM l UNION SELECT reach.a, l.b FROM reach JOIN l ON reach.b = l.a)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, least(w.doc_id, coalesce(min(reach.b), w.doc_id)) AS component_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN reach ON reach.a = w.doc_id GROUP BY w.doc_id, n.n
""",
    "op11_merkle_manifest": f"""
WITH RECURSIVE d AS (SELECT *, list_reduce([4294967295] || list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ord(c) AS BIGINT)), lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, z: xor(v >> 1, (v & 1) * 3988292384))) AS c FROM documents),
f AS (SELECT doc_id, coalesce('+' || lang, '-') AS g, lang, {leaf_sql('n_chars')} AS leaf, CASE WHEN xor(c, 4294967295) % 7 = 0 THEN {leaf_sql('CAST(n_chars AS BIGINT) + 1')} END AS changed FROM d),
l AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM f),
n(g, level, pos, h) AS (SELECT g, 0, pos, leaf FROM l UNION ALL SELECT g, level + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM (SELECT *, count(*) OVER (PARTITION BY g) AS c FROM n) WHERE c > 1 GROUP BY g, level, pos // 2),
s AS (SELECT g, max_by(h, level) AS subroot, max(level) AS top, row_number() OVER (ORDER BY g <> '-', g) - 1 AS pos FROM n GROUP BY g),
u(level, pos, h) AS (SELECT 0, pos, subroot FROM s UNION ALL SELECT level + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM (SELECT *, count(*) OVER () AS c FROM u) WHERE c > 1 GROUP BY level, pos // 2),
p(doc_id, leaf, g, level, pos, h, proof) AS (SELECT doc_id, leaf, g, 0, pos, coalesce(changed, leaf), '' FROM l
  UNION ALL SELECT doc_id, leaf, p.g, p.level + 1, p.pos // 2, sha256(CASE WHEN p.pos % 2 = 1 THEN coalesce(o.h, '') || p.h ELSE p.h || coalesce(o.h, '') END), proof || coalesce(o.h, '') FROM p JOIN s ON s.g = p.g AND p.level < s.top LEFT JOIN n o ON o.g = p.g AND o.level = p.level AND o.pos = xor(p.pos, 1)),
q(doc_id, leaf, subroot, level, pos, h, proof) AS (SELECT doc_id, leaf, subroot, 0, s.pos, h, proof FROM p JOIN s ON s.g = p.g AND p.level = s.top
  UNION ALL SELECT doc_id, leaf, subroot, q.level + 1, q.pos // 2, sha256(CASE WHEN q.pos % 2 = 1 THEN coalesce(o.h, '') || q.h ELSE q.h || coalesce(o.h, '') END), proof || coalesce(o.h, '') FROM q LEFT JOIN u o ON o.level = q.level AND o.pos = xor(q.pos, 1) WHERE q.level < (SELECT max(level) FROM u))
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, h AS folded_root, h = root AS verified FROM q, (SELECT max_by(h, level) AS root, max(level) AS top FROM u) WHERE q.level = top
""",
}
