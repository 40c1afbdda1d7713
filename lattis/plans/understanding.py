"""Query understanding, Q1 to Q11, with token estimates (L1) and plain text (D13)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattis.functions import text as T
from lattis.operators import understanding as U
from lattis.plans.common import QUESTIONS_SQL, questions, sql_text, table, values_sql


def q1_tokenize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document and question."""
    docs = table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), T.tokenize(F.col("text"), cjk=False).alias("t"))
    asked = questions(spark, sf_dir).select(F.col("qid").alias("id"), T.tokenize(F.col("q")).alias("t"))
    rows = docs.unionByName(asked).select("id", F.explode("t").alias("token"))
    return rows.groupBy("id", "token").agg(F.count("*").alias("n"))


Q1_SQL = rf"""
WITH d AS (SELECT 'd' || doc_id AS id, list_filter(regexp_split_to_array(text, '{T.SEPARATOR}'), lambda t: t <> '') AS ts FROM documents),
p AS (SELECT qid AS id, unnest(list_filter(regexp_split_to_array(q, '{T.SEPARATOR}'), lambda t: t <> '')) AS t FROM {QUESTIONS_SQL}),
r AS (SELECT id, unnest(regexp_extract_all(t, '([{T.CJK}]+|[^{T.CJK}]+)')) AS r FROM p),
k AS (SELECT id, CASE WHEN regexp_matches(r, '[{T.CJK}]') THEN list_concat(list_transform(range(1, length(r) + 1), lambda i: substr(r, i, 1)), list_transform(range(1, length(r)), lambda i: substr(r, i, 2))) ELSE [r] END AS ts FROM r),
a AS (SELECT id, unnest(ts) AS token FROM (SELECT id, ts FROM d UNION ALL SELECT id, ts FROM k))
SELECT id, token, count(*) AS n FROM a GROUP BY id, token
"""


def q2_entity_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return questions(spark, sf_dir).select("qid", F.array_join(T.entity_tokens(F.col("q")), "|").alias("tokens"))


STOP = ", ".join(map(sql_text, T.ENTITY_STOP_WORDS))
Q2_SQL = f"SELECT qid, array_to_string(list_filter(regexp_extract_all(q, '{T.ENTITY_TOKEN}'), lambda t: lower(t) NOT IN ({STOP}))[1:5], '|') AS tokens FROM {QUESTIONS_SQL}"


def q3_intent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return questions(spark, sf_dir).select("qid", T.intent(F.col("q")).alias("intent"))


INTENT_SQL = "CASE " + " ".join(f"WHEN regexp_matches(q, {sql_text(p)}, 'i') THEN '{n}'" for n, p in T.INTENTS) + " ELSE 'specific' END"
Q3_SQL = f"SELECT qid, {INTENT_SQL} AS intent FROM {QUESTIONS_SQL}"


def q4_exact_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return questions(spark, sf_dir).select("qid", T.exact_key(F.col("q")).alias("exact_key"))


KEY_SQL = f"(CASE WHEN regexp_extract(trim(q), {sql_text(T.KEY_TOKEN)}) <> '' AND length(trim(regexp_replace(trim(q), {sql_text(T.KEY_TOKEN)}, ''))) <= 12 THEN regexp_extract(trim(q), {sql_text(T.KEY_TOKEN)}) END)"
Q4_SQL = f"SELECT qid, {KEY_SQL} AS exact_key FROM {QUESTIONS_SQL}"


def q5_reverse_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return questions(spark, sf_dir).select("qid", T.reverse_lookup(F.col("q")).alias("reverse"))


REVERSE_SQL = f"regexp_matches(q, '(?is)({T.REVERSE_SUBJECT}).*({T.REVERSE_VERB})')"
Q5_SQL = f"SELECT qid, {REVERSE_SQL} AS reverse FROM {QUESTIONS_SQL}"


def q6_meta_question(spark: SparkSession, sf_dir: str) -> DataFrame:
    return questions(spark, sf_dir).select("qid", T.meta_question(F.col("q")).alias("meta"))


Q6_SQL = f"SELECT qid, length(trim(q)) <= 50 AND regexp_matches(trim(q), {sql_text(T.META)}, 'i') AS meta FROM {QUESTIONS_SQL}"


def q7_retrieval_breadth(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("q")
    return questions(spark, sf_dir).select("qid", T.retrieval_breadth(T.intent(q), T.exact_key(q), T.reverse_lookup(q)).alias("breadth"))


Q7_SQL = f"SELECT qid, CASE WHEN {KEY_SQL} IS NOT NULL THEN 5 WHEN {REVERSE_SQL} THEN 12 WHEN {INTENT_SQL} = 'enumeration' THEN 150 WHEN {INTENT_SQL} IN ('inheritance', 'source', 'script') THEN 12 ELSE 30 END AS breadth FROM {QUESTIONS_SQL}"


def q8_expand_synonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.expand_synonyms(questions(spark, sf_dir), "qid", "q").select("qid", "expanded")


Q8_SQL = rf"""
WITH s AS {values_sql([(i, j, cn, en) for i, (cn, terms) in enumerate(U.SYNONYMS) for j, en in enumerate(terms)], "i, j, cn, en")},
q AS (SELECT qid, q, lower(q) AS low FROM {QUESTIONS_SQL}),
x AS (SELECT qid, i, j, en AS term FROM q JOIN s ON contains(q.q, cn) AND NOT contains(low, en)
      UNION ALL SELECT qid, i, -1, min(cn) FROM q JOIN s ON NOT contains(q.q, cn) AND regexp_matches(low, '(^|[^a-z0-9_])' || en || '([^a-z0-9_]|$)') GROUP BY qid, i),
f AS (SELECT qid, term, min(i * 100 + j) AS o FROM x GROUP BY qid, term),
k AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY o) AS r FROM f),
g AS (SELECT qid, string_agg(term, ' ' ORDER BY o) AS extra FROM k WHERE r <= 5 GROUP BY qid)
SELECT q.qid, q.q || coalesce(' ' || extra, '') AS expanded FROM q LEFT JOIN g USING (qid)
"""

#: Answers with marked keys and names.
ANSWERS = ["Use `gkw_g36.weapon` and **m4a1.weapon**, `gkw_g36.weapon`", "see plain hk416.weapon and tank_1.vehicle.", "**Heavy Tank** beats **AK** and **x** and **Heavy Tank**", "nothing here", "**步枪** and **M1 步枪**"]
ANSWERS_SQL = "(SELECT 'c' || CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) AS id, text AS a FROM conversations WHERE role = 'assistant' UNION ALL SELECT 'x' || CAST(i AS VARCHAR) AS id, a FROM " + values_sql(list(enumerate(ANSWERS)), "i, a") + ")"


def q9_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = table(spark, sf_dir, "conversations").where("role = 'assistant'").select(F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string")).alias("id"), F.col("text").alias("a"))
    said = said.unionByName(spark.createDataFrame([(f"x{i}", a) for i, a in enumerate(ANSWERS)], "id string, a string"))
    return said.select("id", F.array_join(T.mentioned_keys(F.col("a")), "|").alias("keys"), F.array_join(T.mentioned_names(F.col("a")), "|").alias("names"))


Q9_SQL = rf"""
WITH m AS (SELECT id, a, list_concat(regexp_extract_all(a, '`({T.MENTION_KEY})`', 1), regexp_extract_all(a, '\*\*({T.MENTION_KEY})\*\*', 1)) AS marked, regexp_extract_all(a, '\b({T.MENTION_KEY})\b', 1) AS plain,
           list_filter(list_transform(regexp_extract_all(a, '\*\*([^*]+)\*\*', 1), lambda x: trim(x)), lambda x: length(x) BETWEEN 2 AND 50 AND regexp_matches(x, '[a-zA-Z0-9]')) AS names FROM {ANSWERS_SQL}),
k AS (SELECT id, CASE WHEN len(marked) > 0 THEN marked ELSE plain END AS ks, names FROM m)
SELECT id, array_to_string(list_filter(ks, lambda x, i: list_position(ks, x) = i), '|') AS keys,
       array_to_string(list_filter(names, lambda x, i: list_position(names, x) = i)[1:10], '|') AS names FROM k
"""


def q10_search_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The history-aware query of every user turn."""
    return U.history_query(table(spark, sf_dir, "conversations"))


Q10_SQL = r"""
WITH u AS (SELECT conv_id, turn, trim(text) AS t, CASE WHEN length(trim(text)) <= 100 THEN trim(text) ELSE substr(trim(text), 1, 80) END AS cut, text FROM conversations WHERE role = 'user'),
r AS (SELECT *, lag(cut, 1) OVER w AS p1, lag(cut, 2) OVER w AS p2 FROM u WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
l AS (SELECT conv_id, turn, list_filter([p2, p1, text], lambda x: x IS NOT NULL) AS parts FROM r)
SELECT conv_id, turn, array_to_string(list_filter(parts, lambda x, i: list_position(parts, x) = i), ' ') AS search_query FROM l
"""

TRIGGERS = [("t1", "damage"), ("t1", "伤害"), ("t2", "thth"), ("t2", "rifle"), ("t3", "onen"), ("t4", None)]


def q11_route_triggers(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spark.createDataFrame(TRIGGERS, "item string, trigger string")
    return U.route_triggers(questions(spark, sf_dir), items, "qid", "q")


Q11_SQL = f"""
WITH t AS {values_sql(TRIGGERS, "item, trig")}
SELECT DISTINCT qid, item FROM {QUESTIONS_SQL} JOIN t ON trig IS NULL OR contains(lower(q), lower(trig))
"""


def l1_token_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Estimated tokens of each conversation, question and message."""
    turns = table(spark, sf_dir, "conversations").select(F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("id"), "text")
    rows = turns.unionByName(questions(spark, sf_dir).select(F.col("qid").alias("id"), F.col("q").alias("text")))
    return rows.groupBy("id").agg(F.sum(T.token_estimate(F.col("text"))).alias("tokens"), F.count("*").alias("messages"))


L1_SQL = f"""
WITH r AS (SELECT 'c' || conv_id AS id, text FROM conversations UNION ALL SELECT qid, q FROM {QUESTIONS_SQL}),
k AS (SELECT id, length(regexp_replace(text, '[^{T.CJK}]', '', 'g')) AS c, length(text) AS n FROM r)
SELECT id, CAST(sum(ceil(c / 1.5 + (n - c) / 4.0)) AS BIGINT) AS tokens, count(*) AS messages FROM k GROUP BY id
"""

MARKDOWN = ["# Title\n\n**bold** and *soft* `code`\n\n\n\n- item\n* item\n1. one\n> quote\n---\n[link](http://x)", "```js\nlet a = 1;\n```\nafter", "inline ```x``` end"]


def d13_strip_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), "text")
    rows = rows.unionByName(spark.createDataFrame([(f"x{i}", t) for i, t in enumerate(MARKDOWN)], "id string, text string"))
    return rows.select("id", F.md5(T.strip_markdown(F.col("text"))).alias("plain_md5"))


STRIP = "text"
#: DuckDB's patterns don't look around: what isn't a star is doubled, so that a match may take a neighbour and leave its twin to the next.
for a, b in ((r"(?sm)^```\w*\n?(.*?)```", r"\1"), (r"(?s)```(.*?)```", r"\1"), (r"(?m)^#{1,6}\s+", ""), (r"\*\*(.+?)\*\*", r"\1"), (r"([^*])", r"\1\1"), (r"(^|[^*])\*(.+?)\*($|[^*])", r"\1\2\3"), (r"([^*])[^*]", r"\1"), ("`(.+?)`", r"\1"), (r"(?m)^\s*[-*+]\s+", "• "), (r"(?m)^\s*\d+\.\s+", ""), (r"\[(.+?)\]\(.+?\)", r"\1"), (r"(?m)^>\s+", ""), (r"(?m)^---+$", ""), (r"\n{3,}", "\n\n")):
    STRIP = f"regexp_replace({STRIP}, {sql_text(a)}, {sql_text(b)}, 'g')"
D13_SQL = f"SELECT id, md5(trim({STRIP})) AS plain_md5 FROM (SELECT CAST(doc_id AS VARCHAR) AS id, text FROM documents UNION ALL SELECT 'x' || CAST(i AS VARCHAR), t FROM {values_sql(list(enumerate(MARKDOWN)), 'i, t')})"

QUERIES = {f.__name__: f for f in (q1_tokenize, q2_entity_tokens, q3_intent, q4_exact_key, q5_reverse_lookup, q6_meta_question, q7_retrieval_breadth, q8_expand_synonyms, q9_mentions, q10_search_query, q11_route_triggers, l1_token_estimate, d13_strip_markdown)}
ORACLE_SQL = {"q1_tokenize": Q1_SQL, "q2_entity_tokens": Q2_SQL, "q3_intent": Q3_SQL, "q4_exact_key": Q4_SQL, "q5_reverse_lookup": Q5_SQL, "q6_meta_question": Q6_SQL, "q7_retrieval_breadth": Q7_SQL, "q8_expand_synonyms": Q8_SQL, "q9_mentions": Q9_SQL, "q10_search_query": Q10_SQL, "q11_route_triggers": Q11_SQL, "l1_token_estimate": L1_SQL, "d13_strip_markdown": D13_SQL}
