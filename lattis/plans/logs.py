"""Turn-log analytics, L2 to L20: orders as turns, their lines as steps and calls, events as tool events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattis.functions.text import CJK
from lattis.operators import logs as L
from lattis.plans.common import table, values_sql


def tool_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks open a call, views close it, errors fail it; the call is the number in props, the turn the user."""
    e, k = table(spark, sf_dir, "events"), F.get_json_object("props", "$.k").cast("long")
    kind = F.when(F.col("event_type") == "click", "open").when(F.col("event_type") == "view", "close").when(F.col("event_type") == "error", "fail")
    payload = F.when(F.col("event_type") == "error", '{"error":"boom"}').when(k % 4 == 0, F.concat(F.lit('{"total":'), k.cast("string"), F.lit("}"))).when(k % 4 == 1, '{"chain":[1,2]}').when(k % 4 == 2, '{"x":1}').otherwise('{"totalLines":7}')
    return e.select(F.col("user_id").alias("turn"), (k % 10).alias("call"), F.col("event_id").alias("seq"), "ts", kind.alias("kind"), payload.alias("payload")).where("kind is not null")


TOOL_SQL = """(SELECT user_id AS turn, k % 10 AS call, event_id AS seq, ts, CASE event_type WHEN 'click' THEN 'open' WHEN 'view' THEN 'close' ELSE 'fail' END AS kind,
CASE WHEN event_type = 'error' THEN 'boom' WHEN k % 4 = 0 THEN k || ' result(s)' WHEN k % 4 = 1 THEN '2 layer(s)' WHEN k % 4 = 2 THEN 'done' ELSE '7 line(s)' END AS label FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) WHERE event_type IN ('click', 'view', 'error'))"""


def l2_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.tool_calls(tool_events(spark, sf_dir))


L2_SQL = f"""
WITH g AS (SELECT turn, call, min(ts) FILTER (kind = 'open') AS opened, arg_max({{'ts': ts, 'kind': kind, 'label': label}}, seq) FILTER (kind <> 'open') AS c FROM {TOOL_SQL} GROUP BY turn, call)
SELECT turn, call, opened, c.ts AS closed, c.kind = 'close' AS ok, round(epoch_us(c.ts) / 1e6 - epoch_us(opened) / 1e6, 3) AS seconds, c.label AS label FROM g
"""


def l3_turn_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' events as turns: clicks say the type of event, views and errors close calls, purchases finish, signups steer."""
    e = table(spark, sf_dir, "events")
    t = F.col("event_type")
    kind = F.when(t == "click", "text").when(t.isin("view", "error"), "close").when(t == "purchase", "finish").otherwise("steer")
    rows = e.select(F.col("user_id").alias("turn"), F.col("event_id").alias("seq"), kind.alias("type"), F.concat(F.lit("e"), F.col("event_id").cast("string"), F.lit(";")).alias("text"), (t != "error").alias("ok"), F.when(F.col("event_id") % 3 == 0, "duplicate_call").otherwise("done").alias("label"), F.when(F.col("event_id") % 2 == 0, "completed").otherwise("stopped").alias("reason"))
    return L.turn_observations(rows)


L3_SQL = """
SELECT user_id AS turn, coalesce(string_agg('e' || event_id || ';', '' ORDER BY event_id) FILTER (event_type = 'click'), '') AS answer, count(*) FILTER (event_type IN ('view', 'error')) AS calls, count(*) FILTER (event_type = 'error') AS failed,
 count(*) FILTER (event_type IN ('view', 'error') AND event_id % 3 = 0) AS duplicates, count(*) FILTER (event_type NOT IN ('click', 'view', 'error', 'purchase')) AS steers, arg_max(CASE WHEN event_id % 2 = 0 THEN 'completed' ELSE 'stopped' END, event_id) FILTER (event_type = 'purchase') AS stop_reason FROM events GROUP BY user_id
"""


def l4_duplicate_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as calls: a tool by return flag, arguments by the supplier's parity in either key order."""
    li = table(spark, sf_dir, "lineitem")
    a, b = (F.col("l_suppkey") % 2).cast("string"), F.col("l_linestatus")
    args = F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit('{"a":'), a, F.lit(', "b":"'), b, F.lit('"}'))).otherwise(F.concat(F.lit('{"b": "'), b, F.lit('","a":'), a, F.lit("}")))
    return L.duplicate_calls(li.select(F.col("l_orderkey").alias("turn"), F.floor(F.col("l_linenumber") / 2).cast("int").alias("step"), F.col("l_linenumber").alias("pos"), F.col("l_returnflag").alias("tool"), args.alias("args")))


L4_SQL = """
WITH c AS (SELECT l_orderkey AS turn, CAST(l_linenumber // 2 AS INTEGER) AS step, l_linenumber AS pos, l_returnflag AS tool, '{"a":' || (l_suppkey % 2) || ',"b":"' || l_linestatus || '"}' AS args FROM lineitem),
n AS (SELECT *, count(*) OVER (PARTITION BY turn, tool, args ORDER BY step RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior FROM c)
SELECT *, prior >= 2 AS escalated FROM n
"""
CALLS = ["grep", "CAT", "ls", "searchDocs", "find", "read"]
ARGS = ['{"pattern":"x"}', '{"path":"","file":"f.as"}', '{"dir":"d"}', '{"pattern":5}', "not json"]


def l5_repair_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as calls of known, wrong and unknown tools, with arguments that fit by turns."""
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    pick = lambda xs, n: F.element_at(F.array(*map(F.lit, xs)), (n % len(xs) + 1).cast("int"))
    return L.repair_calls(p.select(k.alias("id"), pick(CALLS, k).alias("tool"), pick(ARGS, k).alias("args")))


FIXES = [(t.lower(), a, tool, field, v) for t, tool, field, keys in L.CALL_ALIASES for a, kv in ((ARGS[0], {"pattern": "x"}), (ARGS[1], {"file": "f.as"}), (ARGS[2], {"dir": "d"})) for v in [next((kv[k] for k in keys if k in kv), None)] if v]
L5_SQL = f"""
WITH c AS (SELECT p_partkey AS id, {CALLS!r}[CAST(p_partkey % {len(CALLS)} + 1 AS INTEGER)] AS tool, {ARGS!r}[CAST(p_partkey % {len(ARGS)} + 1 AS INTEGER)] AS args FROM part)
SELECT c.*, fixed AS fixed_tool, '{{"' || field || '":"' || v || '"}}' AS fixed_args FROM c LEFT JOIN {values_sql(FIXES, 'low, a, fixed, field, v')} f ON f.low = lower(c.tool) AND f.a = c.args
"""


def turns_and_steps(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    k = F.col("o_orderkey")
    tokens = o.select(k.alias("turn"), (k % 100).alias("system"), (k % 50).alias("tool_defs"), (k % 200).alias("context"), (F.col("o_custkey") % 80).alias("messages"), (k % 30).alias("reasoning"), (F.col("o_custkey") % 120).alias("answer"), (k % 20).alias("tool_calls"))
    return tokens, li.where("l_orderkey % 3 <> 0").select(F.col("l_orderkey").alias("turn"), F.struct("l_linenumber", "l_partkey", "l_quantity").alias("step"), (F.col("l_quantity") * 10).cast("long").alias("sent"))


def l6_turn_basis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.turn_basis(*turns_and_steps(spark, sf_dir))


BASIS = """
t AS (SELECT o_orderkey AS turn, o_orderkey % 100 AS sy, o_orderkey % 50 AS td, o_orderkey % 200 AS cx, o_custkey % 80 AS ms, o_orderkey % 30 AS rs, o_custkey % 120 AS an, o_orderkey % 20 AS tc FROM orders),
s AS (SELECT l_orderkey AS turn, {'l': l_linenumber, 'p': l_partkey, 'q': l_quantity} AS st, CAST(l_quantity * 10 AS BIGINT) AS sent FROM lineitem WHERE l_orderkey % 3 <> 0),
f AS (SELECT turn, count(*) AS n, arg_min(sent, st) AS base, arg_max(sent, st) AS last FROM s GROUP BY turn),
v AS (SELECT turn, sum(greatest(sent - base, 0)) AS tr FROM s JOIN f USING (turn) GROUP BY turn),
b0 AS (SELECT turn, greatest(coalesce(n, 0), 1) AS steps, sy * greatest(coalesce(n, 0), 1) AS in_system, td * greatest(coalesce(n, 0), 1) AS in_tool_defs, cx * greatest(coalesce(n, 0), 1) AS in_context, ms * greatest(coalesce(n, 0), 1) AS in_messages,
 CAST(coalesce(tr, 0) AS BIGINT) AS in_transcript, rs AS out_reasoning, tc AS out_tool_calls, an AS out_answer, sy + td + coalesce(base, cx + ms) AS base_in, greatest(coalesce(last - base, 0), 0) AS last_transcript FROM t LEFT JOIN f USING (turn) LEFT JOIN v USING (turn)),
b AS (SELECT *, in_system + in_tool_defs + in_context + in_messages + in_transcript AS in_total, out_reasoning + out_tool_calls + out_answer AS out_total FROM b0)"""
L6_SQL = f"WITH {BASIS} SELECT * FROM b"


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reported by two orders in three; zeros, nulls and no report by turns."""
    k = F.col("o_orderkey")
    reported = table(spark, sf_dir, "orders").where("o_orderkey % 5 <> 4").select(k.alias("turn"), F.when(k % 3 == 0, None).otherwise(k % 9000).alias("input"), (k % 400).alias("output"), F.when(k % 2 == 0, k % 5000).alias("last_input"), F.when(k % 4 == 0, k % 25).alias("reasoning"), F.when(k % 6 == 0, float("nan")).otherwise((k % 90).cast("double")).alias("cache_read"))
    return L.resolve_usage(l6_turn_basis(spark, sf_dir), reported)


def l7_resolve_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage(spark, sf_dir)


USAGE = BASIS + """,
rp AS (SELECT o_orderkey AS turn, CASE WHEN o_orderkey % 3 <> 0 THEN nullif(o_orderkey % 9000, 0) END AS i, nullif(o_orderkey % 400, 0) AS o, CASE WHEN o_orderkey % 2 = 0 THEN nullif(o_orderkey % 5000, 0) END AS li, CASE WHEN o_orderkey % 4 = 0 THEN nullif(o_orderkey % 25, 0) END AS rs, CASE WHEN o_orderkey % 6 <> 0 THEN nullif(o_orderkey % 90, 0) END AS ca FROM orders WHERE o_orderkey % 5 <> 4),
u AS (SELECT b.*, coalesce(i, in_total) AS prompt, coalesce(o, out_total) AS completion, CASE WHEN li IS NULL THEN base_in ELSE greatest(li - last_transcript, 0) END + out_answer AS occupancy, rs AS reasoning, ca AS cache_read, i IS NULL OR o IS NULL AS estimated FROM b LEFT JOIN rp USING (turn))"""
L7_SQL = f"WITH {USAGE} SELECT * FROM u"


def l8_attribute_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.attribute_usage(usage(spark, sf_dir))


SC = lambda c, whole, target: f"CAST(CASE WHEN {whole} > 0 THEN round({c} * (CAST({target} AS DOUBLE) / {whole})) ELSE 0 END AS BIGINT)"
L8_SQL = f"""
WITH {USAGE}, r AS (SELECT *, coalesce(reasoning, {SC('out_reasoning', 'out_total', 'completion')}) AS spent FROM u)
SELECT turn, {', '.join(f"{SC(f'in_{c}', 'in_total', 'prompt')} AS {c}" for c in ('system', 'tool_defs', 'context', 'messages', 'transcript'))}, coalesce(cache_read, 0) AS cache_read, spent AS reasoning,
 {SC('out_tool_calls', '(out_total - out_reasoning)', 'greatest(completion - spent, 0)')} AS tool_calls, {SC('out_answer', '(out_total - out_reasoning)', 'greatest(completion - spent, 0)')} AS answer, steps FROM r
"""


def l9_rollup_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of an order as candidates; its line 4 is the judge."""
    li, n = table(spark, sf_dir, "lineitem"), F.col("l_linenumber")
    return L.rollup_candidates(li.select(F.col("l_orderkey").alias("turn"), F.when(n != 4, n.cast("long") * 1000000000 + F.col("l_partkey") * 1000 + F.col("l_suppkey")).alias("i"), (F.col("l_partkey") % 9000).alias("prompt"), (F.col("l_suppkey") % 400).alias("completion"), (F.col("l_partkey") % 77).alias("base_in"), (F.col("l_suppkey") % 5 * 10).alias("answer"), (F.col("l_returnflag") == "R").alias("estimated"), n.cast("long").alias("steps")))


L9_SQL = """
SELECT l_orderkey AS turn, count(*) FILTER (l_linenumber <> 4) AS candidates, CAST(sum(l_partkey % 9000) AS BIGINT) AS prompt, CAST(sum(l_suppkey % 400) AS BIGINT) AS completion,
 arg_min(l_partkey % 77, l_linenumber::BIGINT * 1000000000 + l_partkey * 1000 + l_suppkey) FILTER (l_linenumber <> 4) + coalesce(max(nullif(l_suppkey % 5 * 10, 0)) FILTER (l_linenumber = 4), arg_min(l_suppkey % 5 * 10, l_linenumber::BIGINT * 1000000000 + l_partkey * 1000 + l_suppkey) FILTER (l_linenumber <> 4)) AS occupancy,
 bool_or(l_returnflag = 'R') AS estimated, CAST(sum(l_linenumber) AS BIGINT) AS steps FROM lineitem GROUP BY l_orderkey
"""


def l10_fold_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    reviews = table(spark, sf_dir, "orders").where("o_orderkey % 3 = 1").select(k.alias("turn"), (k % 70).alias("r_prompt"), (k % 30).alias("r_completion"), (k % 2 == 0).alias("r_estimated"), (k % 500).alias("original"), F.when(k % 4 == 1, k % 90).alias("revised"))
    return L.fold_review(usage(spark, sf_dir).select("turn", "prompt", "completion", "occupancy", "estimated"), reviews)


L10_SQL = f"""
WITH {USAGE} SELECT turn, prompt + CASE WHEN turn % 3 = 1 THEN turn % 70 ELSE 0 END AS prompt, completion + CASE WHEN turn % 3 = 1 THEN turn % 30 ELSE 0 END AS completion,
 CASE WHEN turn % 3 = 1 AND turn % 4 = 1 THEN greatest(occupancy - turn % 500 + turn % 90, 0) ELSE occupancy END AS occupancy, estimated OR (turn % 3 = 1 AND turn % 2 = 0) AS estimated FROM u
"""


def l11_best_draft(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as drafts: some without text, some that failed."""
    li, n = table(spark, sf_dir, "lineitem"), F.col("l_linenumber")
    finish = F.when(F.col("l_returnflag") == "R", "error").when(F.col("l_suppkey") % 3 == 0, "length").when(F.col("l_suppkey") % 3 == 1, "tool-calls").otherwise("stop")
    return L.best_draft(li.select(F.col("l_orderkey").alias("turn"), (n.cast("long") * 1000000000 + F.col("l_partkey") * 1000 + F.col("l_suppkey")).alias("i"), F.when(F.col("l_partkey") % 3 == 0, "  ").otherwise("text").alias("answer"), (F.col("l_partkey") % 4).cast("int").alias("steps"), finish.alias("finish")))


L11_SQL = """
WITH d AS (SELECT l_orderkey AS turn, l_linenumber::BIGINT * 1000000000 + l_partkey * 1000 + l_suppkey AS i, l_partkey % 3 <> 0 AS txt, l_partkey % 4 AS steps, CASE WHEN l_returnflag = 'R' THEN 'error' WHEN l_suppkey % 3 = 0 THEN 'length' WHEN l_suppkey % 3 = 1 THEN 'tool-calls' ELSE 'stop' END AS finish FROM lineitem)
SELECT turn, i, CASE WHEN finish = 'length' THEN 'output-limit' WHEN finish = 'tool-calls' AND NOT txt THEN 'step-limit' ELSE 'completed' END AS reason FROM d
QUALIFY row_number() OVER (PARTITION BY turn ORDER BY CASE WHEN txt AND finish <> 'error' THEN 0 WHEN txt THEN 1 ELSE 2 END, steps DESC, i, finish, txt) = 1
"""


def l12_review_triggers(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    return L.review_triggers(o.select(k.alias("turn"), (k % 11 != 0).alias("enabled"), (k % 13 == 0).alias("stopped"), (k % 17 == 0).alias("gone"), F.when(k % 5 == 0, "step-limit").when(k % 7 == 0, "stopped").otherwise("completed").alias("stop_reason"), (k % 4 != 0).alias("has_answer"), (k % 3).alias("failures"), F.when(k % 6 == 0, "inheritance").when(k % 6 == 1, "enumeration").otherwise("specific").alias("intent")))


L12_SQL = """
WITH o AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 5 = 0 THEN 'step-limit' WHEN o_orderkey % 7 = 0 THEN 'stopped' ELSE 'completed' END AS s FROM orders)
SELECT k AS turn, CASE WHEN k % 11 = 0 OR k % 13 = 0 OR k % 17 = 0 OR s = 'stopped' OR (k % 4 = 0 AND s <> 'step-limit') THEN NULL ELSE nullif(concat_ws(',', CASE WHEN k % 3 > 0 THEN 'tool-failure' END, CASE WHEN s = 'step-limit' THEN s END, CASE WHEN k % 6 = 0 THEN 'intent-inheritance' END, CASE WHEN k % 6 = 1 THEN 'intent-enumeration' END), '') END AS triggers FROM o
"""
CODES = [" Missing_Citation", "wrong  count", "EMPTY answer", "weird Thing ", "other", "scope-violation"]


def l13_normalise_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return L.normalise_findings(o.select(F.element_at(F.array(*map(F.lit, CODES)), (F.col("o_orderkey") % len(CODES) + 1).cast("int")).alias("code")))


L13_SQL = f"""
SELECT code, detail, count(*) AS n FROM (SELECT ['missing-citation', 'count-mismatch', 'no-answer', 'other', 'other', 'scope-violation'][CAST(o_orderkey % {len(CODES)} + 1 AS INTEGER)] AS code, CASE WHEN o_orderkey % {len(CODES)} = 3 THEN 'weird Thing' END AS detail FROM orders) GROUP BY ALL
"""


def l14_shed_oldest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of a conversation as messages: user turns stand for tool results that shrink to 5 tokens."""
    c = table(spark, sf_dir, "conversations")
    return L.shed_oldest(c.select(F.col("conv_id").alias("turn"), F.col("turn").alias("pos"), F.when(F.col("role") == "user", "tool").otherwise("text").alias("role"), F.length("text").alias("tokens"), F.lit(5).alias("small")), 900)


L14_SQL = """
WITH m AS (SELECT conv_id AS turn, turn AS pos, CASE WHEN role = 'user' THEN 'tool' ELSE 'text' END AS role, length(text) AS tokens, 5 AS small FROM conversations),
s AS (SELECT *, sum(tokens) OVER (PARTITION BY turn) AS t, max(pos) FILTER (role = 'tool') OVER (PARTITION BY turn) AS nw FROM m),
v AS (SELECT *, CASE WHEN role = 'tool' AND pos <> nw THEN greatest(tokens - 5, 0) ELSE 0 END AS sv FROM s)
SELECT turn, pos, role, tokens, small, sv > 0 AND t - coalesce(sum(sv) OVER (PARTITION BY turn ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) > 900 AS shed FROM v
"""


def l15_fit_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return L.fit_prefix(li.select(F.col("l_orderkey").alias("list"), F.struct("l_linenumber", "l_partkey").alias("pos"), F.col("l_quantity").alias("cost")), 100)


L15_SQL = """
SELECT list, count(*) FILTER (f) AS kept, count(*) FILTER (NOT f) AS dropped FROM (SELECT l_orderkey AS list, sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey ROWS UNBOUNDED PRECEDING) <= 100 AS f FROM lineitem) GROUP BY list
"""


def l16_assess_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as turns: the flags of their lines as tools, the priority as the answer."""
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    tools = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_set("l_returnflag").alias("tools"), F.count("*").alias("steps"))
    seen = o.join(tools, "o_orderkey").select(k.alias("turn"), F.when(k % 9 == 0, " ").otherwise(F.col("o_orderpriority")).alias("answer"), "tools", F.when(k % 4 == 0, "stopped").otherwise("completed").alias("stop_reason"), "steps", (k % 4).alias("duplicates"))
    cases = o.select(k.alias("turn"), F.array(F.lit("A"), F.lit("R")).alias("tools"), F.array(F.lit("URGENT"), F.lit("-")).alias("keys"), F.when(k % 8 == 0, "stopped").otherwise("completed").alias("stop_reason"), F.lit(4).alias("max_steps"))
    return L.assess_turns(seen, cases)


L16_SQL = """
WITH t AS (SELECT l_orderkey AS k, bool_or(l_returnflag = 'A') AS a, bool_or(l_returnflag = 'R') AS r, count(*) AS n FROM lineitem GROUP BY 1),
o AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 9 = 0 THEN ' ' ELSE o_orderpriority END AS an, CASE WHEN o_orderkey % 4 = 0 THEN 'stopped' ELSE 'completed' END AS s, CASE WHEN o_orderkey % 8 = 0 THEN 'stopped' ELSE 'completed' END AS w FROM orders)
SELECT k AS turn, concat_ws('|', CASE WHEN trim(an) = '' AND w <> 'stopped' THEN 'no answer' END, CASE WHEN s <> w THEN 'stopped by ' || s END, CASE WHEN NOT a THEN 'never called A' END, CASE WHEN NOT r THEN 'never called R' END,
 CASE WHEN NOT contains(an, 'URGENT') THEN 'omits URGENT' END, CASE WHEN NOT contains(an, '-') THEN 'omits -' END, CASE WHEN n > 4 THEN 'over budget' END, CASE WHEN k % 4 > 1 THEN 'thrashing' END) AS failures FROM o JOIN t USING (k)
"""


def l17_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.admission(table(spark, sf_dir, "conversations"), 3, 700, 300)


L17_SQL = f"""
WITH c AS (SELECT conv_id, count(*) FILTER (role = 'user') AS a, CAST(ceil(count(*) FILTER (role <> 'system') / 2.0) AS BIGINT) AS rounds, CAST(sum(ceil(length(regexp_replace(text, '[^{CJK}]', '', 'g')) / 1.5 + (length(text) - length(regexp_replace(text, '[^{CJK}]', '', 'g'))) / 4.0)) AS BIGINT) AS tokens FROM conversations GROUP BY 1)
SELECT conv_id, rounds, tokens, CASE WHEN a = 0 THEN 'no user message' WHEN rounds > 3 THEN 'too long' WHEN tokens > 489 THEN 'too large' WHEN tokens + 300 > 700 THEN 'prompt too large' END AS refusal FROM c
"""


def l18_session_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.session_list(table(spark, sf_dir, "conversations").withColumn("at", F.col("turn")))


L18_SQL = """
WITH c AS (SELECT conv_id, trim(coalesce(arg_min(text, turn) FILTER (role = 'user'), '')) AS t, count(*) AS turns, max(turn) AS last_at FROM conversations GROUP BY 1)
SELECT conv_id, CASE WHEN length(t) > 30 THEN substr(t, 1, 30) || '...' ELSE t END AS title, turns, last_at FROM c
"""


def l19_summary_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation's turns in steps of 2 (or 1), a summary every 3."""
    c = table(spark, sf_dir, "conversations").select("conv_id", (F.col("turn") + F.when(F.col("conv_id") % 2 == 0, F.col("turn")).otherwise(F.lit(1))).alias("turn_count"))
    return L.summary_due(c, 3)


L19_SQL = """
WITH RECURSIVE c AS (SELECT DISTINCT conv_id, CASE WHEN conv_id % 2 = 0 THEN turn * 2 ELSE turn + 1 END AS n FROM conversations),
f AS (SELECT conv_id, 0::BIGINT AS fired FROM c GROUP BY conv_id UNION ALL SELECT f.conv_id, (SELECT min(n) FROM c WHERE c.conv_id = f.conv_id AND n - f.fired >= 3) FROM f WHERE EXISTS (SELECT 1 FROM c WHERE c.conv_id = f.conv_id AND n - f.fired >= 3))
SELECT conv_id, fired FROM f WHERE fired > 0
"""


def l19_summary_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.summary_input(table(spark, sf_dir, "conversations"))


L19_INPUT_SQL = """SELECT conv_id, turn, array_to_string(list(role || ': ' || substr(text, 1, 200)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), chr(10)) AS text FROM conversations"""


def l20_steer_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user as messages: some blank, some long, the third valid one too many."""
    e = table(spark, sf_dir, "events")
    m = F.when(F.col("event_id") % 5 == 0, "  ").when(F.col("event_id") % 7 == 0, F.repeat(F.lit("x"), 2001)).otherwise(F.col("event_type"))
    return L.steer_admission(e.select(F.col("user_id").alias("turn"), F.col("event_id").alias("seq"), m.alias("message")), most=2).drop("message")


L20_SQL = """
WITH e AS (SELECT user_id AS turn, event_id AS seq, CASE WHEN event_id % 5 = 0 THEN 'empty' WHEN event_id % 7 = 0 THEN 'too_long' END AS bad FROM events)
SELECT turn, seq, coalesce(bad, CASE WHEN count(*) FILTER (bad IS NULL) OVER (PARTITION BY turn ORDER BY seq) > 2 THEN 'too_many' ELSE 'queued' END) AS status FROM e
"""

QUERIES = {f.__name__: f for f in (l2_tool_calls, l3_turn_observations, l4_duplicate_calls, l5_repair_calls, l6_turn_basis, l7_resolve_usage, l8_attribute_usage, l9_rollup_candidates, l10_fold_review, l11_best_draft, l12_review_triggers, l13_normalise_findings, l14_shed_oldest, l15_fit_prefix, l16_assess_turns, l17_admission, l18_session_list, l19_summary_due, l19_summary_input, l20_steer_admission)}
ORACLE_SQL = {k: globals()[k.split("_")[0].upper() + "_SQL"] for k in QUERIES} | {"l19_summary_input": L19_INPUT_SQL}
