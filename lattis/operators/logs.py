"""Turn-log analytics: tool calls, observations, duplicates, token accounting, budgets, admission, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattis.functions.text import token_estimate

# Wrong tool names, the tool and field meant, and the arguments that may hold the value, in order.
CALL_ALIASES = [
    ("grep", "searchDocs", "query", ["pattern", "query", "regex", "q", "search"]), ("search", "searchDocs", "query", ["query", "pattern", "q"]), ("search_files", "searchDocs", "query", ["query", "pattern", "q"]),
    ("ripgrep", "searchDocs", "query", ["pattern", "query", "regex"]), ("cat", "readSource", "file", ["path", "file", "filename"]), ("read", "readSource", "file", ["path", "file", "filename"]), ("read_file", "readSource", "file", ["path", "file", "filename"]),
    ("ls", "listFiles", "pattern", ["pattern", "glob", "path", "dir"]), ("find", "listFiles", "pattern", ["pattern", "glob", "name", "path"]), ("glob", "listFiles", "pattern", ["pattern", "glob", "path"]), ("list_files", "listFiles", "pattern", ["pattern", "glob", "path"]),
]
# Codes of review findings, and other names for them.
ISSUE_CODES = ["missing-citation", "missing-key", "count-mismatch", "unsupported-claim", "scope-violation", "no-answer", "other"]
ISSUE_ALIASES = {"missing-source": "missing-citation", "missing-file": "missing-citation", "no-citation": "missing-citation", "missing-keys": "missing-key", "wrong-count": "count-mismatch", "count-error": "count-mismatch", "unsupported": "unsupported-claim", "unsupported-fact": "unsupported-claim", "out-of-scope": "scope-violation", "empty-answer": "no-answer"}
# Lists that a result may hold, and what they are counted as.
RESULT_UNITS = [("chain", "layer"), ("parents", "parent"), ("referencedBy", "ref"), ("symbols", "symbol")]


def result_label(payload: Column) -> Column:
    """A short label of a result given as JSON: its error, a count, or done."""
    at = lambda p: F.get_json_object(payload, p)
    size = lambda p: F.json_array_length(at(p))
    counted = [F.when(size(f"$.{k}").isNotNull(), F.concat(size(f"$.{k}").cast("string"), F.lit(f" {unit}(s)"))) for k, unit in RESULT_UNITS]
    return F.coalesce(at("$.error"), F.concat(at("$.total"), F.lit(" result(s)")), *counted, F.concat(at("$.totalLines"), F.lit(" line(s)")), F.lit("done"))


def tool_calls(events: DataFrame) -> DataFrame:
    """(turn, call, opened, closed, ok, seconds, label): opening and closing events of a call paired. events: turn, call, seq, ts, kind (open, close, fail), payload."""
    shut = F.col("kind").isin("close", "fail")
    rows = events.groupBy("turn", "call").agg(F.min(F.when(F.col("kind") == "open", F.col("ts"))).alias("opened"), F.max_by(F.when(shut, F.struct("ts", "kind", "payload")), F.when(shut, F.col("seq"))).alias("c"))
    seconds = F.unix_micros(F.col("c.ts").cast("timestamp")) / 1e6 - F.unix_micros(F.col("opened").cast("timestamp")) / 1e6
    return rows.select("turn", "call", "opened", F.col("c.ts").alias("closed"), (F.col("c.kind") == "close").alias("ok"), F.round(seconds, 3).alias("seconds"), F.when(F.col("c").isNotNull(), result_label(F.col("c.payload"))).alias("label"))


def turn_observations(events: DataFrame) -> DataFrame:
    """(turn, answer, calls, failed, duplicates, steers, stop_reason): a turn's events folded. events: turn, seq, type, text, ok, label, reason."""
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("type") == "text", F.struct("seq", "text")))), lambda x: x["text"]), "")
    call = F.col("type") == "close"
    return events.groupBy("turn").agg(text.alias("answer"), F.count_if(call).alias("calls"), F.count_if(call & ~F.col("ok")).alias("failed"), F.count_if(call & (F.col("label") == "duplicate_call")).alias("duplicates"), F.count_if(F.col("type") == "steer").alias("steers"), F.max_by(F.when(F.col("type") == "finish", F.col("reason")), F.when(F.col("type") == "finish", F.col("seq"))).alias("stop_reason"))


def duplicate_calls(calls: DataFrame) -> DataFrame:
    """Adds args (canonical JSON), prior (calls alike in earlier steps of the turn) and escalated (2 or more). calls: turn, step, pos, tool, args.

    Calls of one step don't see each other. Keys are sorted by the variant type, so their order in the text doesn't count.
    """
    rows = calls.withColumn("args", F.to_json(F.parse_json("args")))
    earlier = Window.partitionBy("turn", "tool", "args").orderBy("step").rangeBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("prior", F.count("*").over(earlier))
    return rows.withColumn("escalated", F.col("prior") >= 2)


def repair_calls(calls: DataFrame, aliases: list[tuple] = CALL_ALIASES) -> DataFrame:
    """Adds fixed_tool and fixed_args: known wrong names become the tool meant, with the first usable argument; null if it can't be repaired. calls: tool, args (JSON)."""
    low = F.lower("tool")
    value = lambda k: F.when(F.schema_of_variant(F.try_variant_get(F.try_parse_json("args"), f"$.{k}", "variant")) == "STRING", F.nullif(F.get_json_object("args", f"$.{k}"), F.lit("")))
    tool = F.coalesce(*[F.when(low == name, F.lit(t)) for name, t, _, _ in aliases])
    made = F.coalesce(*[F.when(low == name, F.to_json(F.create_map(F.lit(field), F.coalesce(*map(value, keys))))) for name, _, field, keys in aliases])
    found = F.coalesce(*[F.when(low == name, F.coalesce(*map(value, keys))) for name, _, _, keys in aliases])
    return calls.withColumn("fixed_tool", F.when(found.isNotNull(), tool)).withColumn("fixed_args", F.when(found.isNotNull(), made))


def turn_basis(tokens: DataFrame, steps: DataFrame) -> DataFrame:
    """Estimated tokens of each turn by slice. tokens: turn, system, tool_defs, context, messages, reasoning, answer, tool_calls; steps: turn, step, sent."""
    first = steps.groupBy("turn").agg(F.count("*").alias("n"), F.min_by("sent", "step").alias("base"), F.max_by("sent", "step").alias("last"))
    over = steps.join(first.select("turn", "base"), "turn").groupBy("turn").agg(F.sum(F.greatest(F.col("sent") - F.col("base"), F.lit(0))).alias("transcript"))
    rows = tokens.join(first, "turn", "left").join(over, "turn", "left")
    n = F.greatest(F.coalesce("n", F.lit(0)), F.lit(1))
    slices = {f"in_{c}": (F.col(c) * n).cast("long") for c in ("system", "tool_defs", "context", "messages")} | {"in_transcript": F.coalesce("transcript", F.lit(0)).cast("long")}
    base = F.col("system") + F.col("tool_defs") + F.coalesce("base", F.col("context") + F.col("messages"))
    rows = rows.select("turn", n.cast("long").alias("steps"), *[v.alias(k) for k, v in slices.items()], F.col("reasoning").alias("out_reasoning"), F.col("tool_calls").alias("out_tool_calls"), F.col("answer").alias("out_answer"), base.cast("long").alias("base_in"), F.greatest(F.coalesce(F.col("last") - F.col("base"), F.lit(0)), F.lit(0)).cast("long").alias("last_transcript"))
    total = lambda p: sum((F.col(c) for c in rows.columns if c.startswith(p)), F.lit(0)).cast("long")
    return rows.withColumn("in_total", total("in_")).withColumn("out_total", total("out_"))


def resolve_usage(basis: DataFrame, reported: DataFrame) -> DataFrame:
    """basis with prompt, completion, occupancy, reasoning, cache_read, estimated. reported: turn, input, output, last_input, reasoning, cache_read; 0, NaN and null are absent."""
    have = lambda c: F.when(F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)) > 0, F.col(c).cast("long"))
    r = reported.select("turn", *[have(c).alias(f"r_{c}") for c in ("input", "output", "last_input", "reasoning", "cache_read")])
    rows = basis.join(r, "turn", "left")
    carried = F.coalesce(F.greatest(F.col("r_last_input") - F.col("last_transcript"), F.lit(0)), F.col("base_in"))
    carried = F.when(F.col("r_last_input").isNull(), F.col("base_in")).otherwise(carried)
    return rows.select(*basis.columns, F.coalesce("r_input", "in_total").alias("prompt"), F.coalesce("r_output", "out_total").alias("completion"), (carried + F.col("out_answer")).cast("long").alias("occupancy"), F.col("r_reasoning").alias("reasoning"), F.col("r_cache_read").alias("cache_read"), (F.col("r_input").isNull() | F.col("r_output").isNull()).alias("estimated"))


def attribute_usage(usage: DataFrame) -> DataFrame:
    """Totals spread over the slices in proportion; a reported reasoning count stays as it is. usage: resolve_usage()."""
    scale = lambda c, whole, target: F.when(whole > 0, F.round(F.col(c) * (target / whole))).otherwise(0).cast("long")
    reasoning = F.coalesce("reasoning", scale("out_reasoning", F.col("out_total"), F.col("completion")))
    rows = usage.withColumn("spent_reasoning", reasoning)
    rest, left = F.col("out_total") - F.col("out_reasoning"), F.greatest(F.col("completion") - F.col("spent_reasoning"), F.lit(0))
    return rows.select("turn", *[scale(f"in_{c}", F.col("in_total"), F.col("prompt")).alias(c) for c in ("system", "tool_defs", "context", "messages", "transcript")], F.coalesce("cache_read", F.lit(0)).alias("cache_read"), F.col("spent_reasoning").alias("reasoning"), scale("out_tool_calls", rest, left).alias("tool_calls"), scale("out_answer", rest, left).alias("answer"), "steps")


def rollup_candidates(usage: DataFrame) -> DataFrame:
    """(turn, candidates, prompt, completion, occupancy, estimated, steps): a best-of-N turn. usage: turn, i (null: the judge), prompt, completion, base_in, answer, estimated, steps; without a judge the first candidate's answer counts."""
    judge = F.col("i").isNull()
    last = F.coalesce(F.max(F.when(judge, F.nullif("answer", F.lit(0)))), F.min_by(F.when(~judge, F.col("answer")), F.when(~judge, F.col("i"))))
    return usage.groupBy("turn").agg(F.count_if(~judge).alias("candidates"), F.sum("prompt").alias("prompt"), F.sum("completion").alias("completion"), (F.min_by(F.when(~judge, F.col("base_in")), F.when(~judge, F.col("i"))) + last).alias("occupancy"), F.bool_or("estimated").alias("estimated"), F.sum("steps").alias("steps"))


def fold_review(turns: DataFrame, reviews: DataFrame) -> DataFrame:
    """Turns with a review's spend added; occupancy moves only where it revised the answer. turns: turn, prompt, completion, occupancy, estimated; reviews: turn, r_prompt, r_completion, r_estimated, original, revised (null: no revision)."""
    rows = turns.join(reviews, "turn", "left")
    moved = F.when(F.col("revised").isNotNull(), F.greatest(F.col("occupancy") - F.col("original") + F.col("revised"), F.lit(0))).otherwise(F.col("occupancy"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return rows.select("turn", (F.col("prompt") + zero("r_prompt")).alias("prompt"), (F.col("completion") + zero("r_completion")).alias("completion"), moved.alias("occupancy"), (F.col("estimated") | F.coalesce("r_estimated", F.lit(False))).alias("estimated"))


def best_draft(drafts: DataFrame) -> DataFrame:
    """(turn, i, reason): text without an error, else text, else any; most steps, then the first. drafts: turn, i, answer, steps, finish."""
    text = F.trim("answer") != ""
    pool = F.when(text & (F.col("finish") != "error"), 0).when(text, 1).otherwise(2)
    best = drafts.groupBy("turn").agg(F.min_by(F.struct("i", "finish", "answer"), F.struct(pool, -F.col("steps"), F.col("i"))).alias("b"))
    reason = F.when(F.col("b.finish") == "length", "output-limit").when((F.col("b.finish") == "tool-calls") & (F.trim("b.answer") == ""), "step-limit").otherwise("completed")
    return best.select("turn", "b.i", reason.alias("reason"))


def review_triggers(turns: DataFrame) -> DataFrame:
    """(turn, triggers): why a turn should be reviewed; null if it shouldn't. turns: turn, enabled, stopped, gone, stop_reason, has_answer, failures, intent."""
    barred = ~F.col("enabled") | F.col("stopped") | F.col("gone") | (F.col("stop_reason") == "stopped") | (~F.col("has_answer") & (F.col("stop_reason") != "step-limit"))
    every = F.array_compact(F.array(F.when(F.col("failures") > 0, "tool-failure"), F.when(F.col("stop_reason") == "step-limit", "step-limit"), F.when(F.col("intent") == "inheritance", "intent-inheritance"), F.when(F.col("intent") == "enumeration", "intent-enumeration")))
    return turns.select("turn", F.when(~barred & (F.size(every) > 0), F.array_join(every, ",")).alias("triggers"))


def normalise_findings(findings: DataFrame) -> DataFrame:
    """(code, detail, n): findings by code of the closed set; unknown ones are `other` with the original as detail. findings: code."""
    folded = F.regexp_replace(F.lower(F.trim("code")), r"[\s_]+", "-")
    alias = F.coalesce(*[F.when(folded == a, F.lit(c)) for a, c in ISSUE_ALIASES.items()])
    code = F.when(folded.isin(ISSUE_CODES), folded).otherwise(alias)
    rows = findings.select(F.coalesce(code, F.lit("other")).alias("code"), F.when(code.isNull(), F.trim("code")).alias("detail"))
    return rows.groupBy("code", "detail").agg(F.count("*").alias("n"))


def shed_oldest(messages: DataFrame, budget: int) -> DataFrame:
    """Adds `shed`: tool results shrink, oldest first and the newest never, until a turn fits. messages: turn, pos, role, tokens, small (its size when shed)."""
    turn = Window.partitionBy("turn")
    tool = F.col("role") == "tool"
    rows = messages.withColumn("total", F.sum("tokens").over(turn)).withColumn("newest", F.max(F.when(tool, F.col("pos"))).over(turn))
    saving = F.when(tool & (F.col("pos") != F.col("newest")), F.greatest(F.col("tokens") - F.col("small"), F.lit(0))).otherwise(0)
    rows = rows.withColumn("saving", saving)
    older = F.coalesce(F.sum("saving").over(turn.orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("shed", (F.col("saving") > 0) & (F.col("total") - older > budget)).drop("total", "newest", "saving")


def fit_prefix(items: DataFrame, budget: int) -> DataFrame:
    """(list, kept, dropped): how many first items of a list fit the budget. items: list, pos, cost."""
    run = Window.partitionBy("list").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = items.withColumn("fits", F.sum("cost").over(run) <= budget)
    return rows.groupBy("list").agg(F.count_if("fits").alias("kept"), F.count_if(~F.col("fits")).alias("dropped"))


def assess_turns(observed: DataFrame, cases: DataFrame) -> DataFrame:
    """(turn, failures): what a turn missed of its case; failures are joined by a bar, empty if there are none.

    observed: turn, answer, tools (array), stop_reason, steps, duplicates; cases: turn, tools, keys (arrays), stop_reason, max_steps.
    """
    o, c = observed.alias("o"), cases.alias("c")
    rows = c.join(o, F.col("c.turn") == F.col("o.turn"))
    missing = F.transform(F.array_except("c.tools", "o.tools"), lambda t: F.concat(F.lit("never called "), t))
    omitted = F.transform(F.filter("c.keys", lambda k: ~F.contains(F.col("o.answer"), k)), lambda k: F.concat(F.lit("omits "), k))
    first = F.array(F.when((F.trim("o.answer") == "") & (F.col("c.stop_reason") != "stopped"), "no answer"), F.when(F.col("o.stop_reason") != F.col("c.stop_reason"), F.concat(F.lit("stopped by "), "o.stop_reason")))
    last = F.array(F.when(F.col("o.steps") > F.col("c.max_steps"), "over budget"), F.when(F.col("o.duplicates") > 1, "thrashing"))
    return rows.select("c.turn", F.array_join(F.array_compact(F.concat(first, missing, omitted, last)), "|").alias("failures"))


def admission(conversations: DataFrame, max_rounds: int, window: int, reserve: int, system: int = 0) -> DataFrame:
    """(conv_id, rounds, tokens, refusal): the first reason to refuse a conversation, null if admitted. conversations: conv_id, turn, role, text."""
    rows = conversations.groupBy("conv_id").agg(F.count_if(F.col("role") == "user").alias("asked"), F.ceil(F.count_if(F.col("role") != "system") / 2).cast("long").alias("rounds"), F.sum(token_estimate(F.col("text"))).alias("tokens"))
    refusal = F.when(F.col("asked") == 0, "no user message").when((F.lit(max_rounds) > 0) & (F.col("rounds") > max_rounds), "too long").when(F.col("tokens") > int(window * 0.7), "too large").when(F.col("tokens") + system + reserve > window, "prompt too large")
    return rows.select("conv_id", "rounds", "tokens", refusal.alias("refusal"))


def session_list(conversations: DataFrame, title: int = 30) -> DataFrame:
    """(conv_id, title, turns, last_at): conversations by their last turn; sort by it for the newest first. conversations: conv_id, turn, role, text, at."""
    user = F.col("role") == "user"
    rows = conversations.groupBy("conv_id").agg(F.trim(F.coalesce(F.min_by(F.when(user, F.col("text")), F.when(user, F.col("turn"))), F.lit(""))).alias("t"), F.count("*").alias("turns"), F.max("at").alias("last_at"))
    return rows.select("conv_id", F.when(F.length("t") > title, F.concat(F.substring("t", 1, title), F.lit("..."))).otherwise(F.col("t")).alias("title"), "turns", "last_at")


def summary_due(counts: DataFrame, every: int) -> DataFrame:
    """(conv_id, fired): the turn counts at which a summary is due: `every` after the last one. counts: conv_id, turn_count. Each firing resets the counter: a fold."""
    rows = counts.groupBy("conv_id").agg(F.array_sort(F.collect_list("turn_count")).alias("c"))
    start = F.array().cast("array<long>")
    fired = F.aggregate("c", start, lambda s, x: F.when(x.cast("long") - F.coalesce(F.try_element_at(s, F.lit(-1)), F.lit(0)) >= every, F.array_append(s, x.cast("long"))).otherwise(s))
    return rows.select("conv_id", F.explode(fired).alias("fired"))


def summary_input(conversations: DataFrame, messages: int = 10, chars: int = 200) -> DataFrame:
    """(conv_id, turn, text): the last `messages` messages up to each turn, `chars` characters of each."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(1 - messages, 0)
    return conversations.select("conv_id", "turn", F.array_join(F.collect_list(F.concat("role", F.lit(": "), F.substring("text", 1, chars))).over(w), "\n").alias("text"))


def steer_admission(messages: DataFrame, most_chars: int = 2000, most: int = 8) -> DataFrame:
    """Adds `status`: empty, too_long, too_many (beyond `most` valid ones of a turn) or queued. messages: turn, seq, message."""
    text = F.trim("message")
    bad = F.when(F.coalesce(text, F.lit("")) == "", "empty").when(F.length(text) > most_chars, "too_long")
    order = Window.partitionBy("turn").orderBy("seq")
    rows = messages.withColumn("bad", bad).withColumn("k", F.count_if(F.col("bad").isNull()).over(order))
    return rows.withColumn("status", F.coalesce("bad", F.when(F.col("k") > most, "too_many").otherwise("queued"))).drop("bad", "k")
