"""Benchmark decontamination by template canonicalisation, with DataFrame functions only.

Numbers, names and units of a text become typed placeholders; what is left of a word is its letters and digits in lower
case. Windows of the template are hash-joined with those of the benchmark. A window that matches with other slot values
counts if the values are consistent: over all windows of one alignment, equal benchmark values face equal document
values. So a passage is found as it is, in other punctuation or case, and with its parameters changed. Windows of mostly
placeholders (dense) match with equal slot values only. Windows with equal slot values count without a consistent alignment too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattis.llm.components import keep

#: Words of a window; an item of fewer is one window. A window with fewer than LITERAL words that are no placeholders is dense.
WINDOW, LITERAL = 8, 5
#: Stands for a word that is no placeholder; no value is it, as values begin with a letter or digit.
NONE = "\u0004"
#: Bytes of benchmark windows that are still broadcast; beyond, the join shuffles.
BROADCAST_BYTES = 64 << 20
#: Unit words that follow a number.
UNITS = "kg|g|mg|lb|oz|km|m|cm|mm|mi|mile|miles|ft|in|inch|inches|meter|meters|metre|metres|l|ml|s|sec|seconds|min|minutes|h|hour|hours|day|days|week|weeks|year|years|usd|eur|dollar|dollars|cent|cents|euro|euros|percent"


def spaced(text: Column) -> Column:
    """One space between words, none around."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " "))


def template(text: Column) -> Column:
    """The template of a spaced text, word by word. A name is a capitalised word that does not open a sentence or line."""
    # looking ahead first costs little at most places; looking behind is left for the few that pass
    named = F.regexp_replace(text, r"(?=\p{Lu}\p{Ll})(?<=[\p{L}\p{N},;)] )\p{Lu}\p{Ll}+(?=[^\p{L}\p{N}]|$)", "\u0001")
    # possessive, so that a chain of any length is matched without recursion; a part that a letter follows is not taken
    number = F.regexp_replace(named, r"(?=\p{N})(?<![\p{L}\p{N}])\p{N}++(?:[.,:]\p{N}++(?!\p{L}))*+(?!\p{L})", "\u0002")
    unit = F.when(F.instr(number, "\u0002 ") > 0, F.regexp_replace(number, rf"(?i)(?<=\u0002 )(?:{UNITS})(?=[^\p{{L}}\p{{N}}]|$)", "\u0003")).otherwise(number)
    return F.lower(F.regexp_replace(unit, "[^\\p{L}\\p{M}\\p{N}\u0001-\u0003 ]+", ""))


def words_of(texts: DataFrame, key: str) -> DataFrame:
    """(key, words, shape) of texts that have words: the words of the text, and those of its template."""
    # a filter on what is computed would compute it twice, so texts without words go by their own look
    rows = texts.select(key, F.col("text").cast("string").alias("text")).where(F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return rows.select(key, spaced(F.col("text")).alias("raw")).select(key, F.split("raw", " ").alias("words"), F.split(template(F.col("raw")), " ").alias("shape"))


def hash_of(n: Column, lengths: list[int]) -> Column:
    """The hash of the n words of shape from pos on; n is one of lengths."""
    out = F.lit(None).cast("long")
    for length in lengths:
        out = F.when(n == length, F.xxhash64(*[F.get("shape", F.col("pos") - 1 + k) for k in range(length)])).otherwise(out)
    return out


def values_of() -> Column:
    """For each word behind a placeholder what it says, without case and outer punctuation; NONE for other words."""
    value = lambda s, r: F.when(s.rlike("[\u0001-\u0003]"), F.lower(F.regexp_replace(r, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", ""))).otherwise(NONE)
    return F.zip_with("shape", "words", value)


def slots_of(n: Column) -> Column:
    """The values of the placeholders among the n words from pos on; null if there are none.

    Only expressions that Spark compiles: the windows of a document that match come out of one loop and are held together, so
    none may carry the arrays of the whole document, as it would into an expression of another kind.
    """
    slots = F.array_remove(F.slice("values", F.col("pos"), n), NONE)
    return F.when(F.size(slots) > 0, slots)


def benchmark_windows(bench: DataFrame, window: int, literal: int) -> DataFrame:
    """(item_id, pos, n, hash, islots, dense) of the windows."""
    n = F.least(F.lit(window), F.size("shape"))
    rows = words_of(bench, "item_id").select("item_id", "shape", values_of().alias("values")).select("item_id", "shape", "values", n.alias("n"), F.explode(F.sequence(F.lit(1), F.size("shape") - n + 1)).alias("pos"))
    rows = rows.select("item_id", "pos", "n", hash_of(F.col("n"), list(range(1, window + 1))).alias("hash"), slots_of(F.col("n")).alias("islots"))
    literals = F.col("n") - F.coalesce(F.size("islots"), F.lit(0))
    return rows.withColumn("dense", literals < F.least(F.lit(literal), "n")).distinct()


def document_windows(docs: DataFrame, lengths: list[int]) -> DataFrame:
    """(doc_id, values, shape, n, pos, hash) of the windows of each length."""
    last = F.size("shape") - min(lengths) + 1
    rows = words_of(docs, "doc_id").select("doc_id", "shape", values_of().alias("values"))
    rows = rows.select("doc_id", "values", "shape", F.explode(F.when(last >= 1, F.sequence(F.lit(1), last))).alias("pos"))
    n = F.lit(lengths[0])
    if len(lengths) > 1:
        rows, n = rows.select("doc_id", "values", "shape", "pos", F.explode(F.array(*map(F.lit, lengths))).alias("n")), F.col("n")
        rows = rows.where(F.col("pos") + F.col("n") - 1 <= F.size("shape"))
    return rows.select("doc_id", "values", "shape", n.alias("n"), "pos", hash_of(n, lengths).alias("hash"))


def contaminated(docs: DataFrame, bench: DataFrame, window: int = WINDOW, literal: int = LITERAL) -> DataFrame:
    """Documents that hold a passage of the benchmark: doc_id, item_id, n_windows, n_slots, exact.

    docs: doc_id, text; bench: item_id, text. One row for each pair with a consistent alignment, with its largest number
    of matched windows that aren't dense, the number of benchmark slot values in it, and whether all of them are
    unchanged. A pair without one has a row if any window matches with equal slot values, dense ones too; these are
    counted then.

    An item of fewer words than a window is one window of its own length, looked for at every place of every text.

    Null and empty texts match nothing. Repeated rows of either table count once; null ids take part as a document or item
    of their own. Empty tables give no rows.
    """
    keys = keep(benchmark_windows(bench, window, literal))
    lengths = sorted(r["n"] for r in keys.select("n").distinct().collect()) or [window]  # `window` numbers at most
    found = document_windows(docs.select("doc_id", "text"), lengths)
    told = F.concat_ws("", F.col("islots"), F.col("item_id").cast("string"))
    size = keys.agg(F.sum(64 + F.octet_length(told))).first()[0] or 0
    slots, keys = slots_of(F.col("n")), keys.select("item_id", F.col("pos").alias("at"), "hash", "islots", "dense")
    held = ["doc_id", "item_id", "at", (F.col("pos") - F.col("at")).alias("offset"), "islots", "dense"]
    if size <= BROADCAST_BYTES:  # slots are made only where a window with placeholders matches
        match = found.join(F.broadcast(keys), "hash").select(*held, F.when(F.col("islots").isNotNull(), slots).alias("slots"))
    else:
        match = found.select("doc_id", "pos", "hash", slots.alias("slots")).join(keys, "hash").select(*held, "slots")
    open_, same = ~F.col("dense"), F.col("islots").isNull() | (F.col("islots") == F.col("slots"))
    pairs = F.coalesce(F.arrays_zip(F.col("islots").alias("i"), F.col("slots").alias("d")), F.array().cast("array<struct<i:string,d:string>>"))
    aligned = match.groupBy("doc_id", "item_id", "offset").agg(
        F.size(F.collect_set(F.when(open_, F.col("at")))).alias("n_open"), F.array_distinct(F.flatten(F.collect_set(F.when(open_, pairs)))).alias("pairs"),
        F.size(F.collect_set(F.when(same, F.col("at")))).alias("n_same"), F.size(F.array_distinct(F.flatten(F.collect_set(F.when(same, F.col("islots")))))).alias("same_slots"),
    )
    n_slots = F.size(F.array_distinct(F.transform("pairs", lambda p: p["i"])))
    aligned = aligned.withColumn("consistent", (F.col("n_open") > 0) & (F.size("pairs") == n_slots)).where("consistent or n_same > 0")

    def pick(whole: Column, verbatim: Column) -> Column:
        return F.when(F.col("consistent"), whole).otherwise(verbatim)

    row = F.struct("consistent", pick(F.col("n_open"), F.col("n_same")).cast("long").alias("n_windows"), pick(F.forall("pairs", lambda p: p["i"] == p["d"]), F.lit(True)).alias("exact"), pick(n_slots, F.col("same_slots")).cast("long").alias("n_slots"))
    best = aligned.groupBy("doc_id", "item_id").agg(F.max(row).alias("best"))
    return best.select("doc_id", "item_id", "best.n_windows", "best.n_slots", "best.exact")
