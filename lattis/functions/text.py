"""Columns over question and document text: tokens, intents, mentions, token estimates, plain text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Scripts written without spaces, and the patterns that tell what a question asks for.
CJK = "぀-ヿ㐀-䶿一-鿿豈-﫿가-힯"
SEPARATOR = r"[\n\r\p{Z}\p{P}\p{S}]+"
ENTITY_TOKEN = "[a-zA-Z][a-zA-Z0-9_-]{1,}"
ENTITY_STOP_WORDS = ["weapon", "the", "and", "for", "with", "list", "all", "data"]
INTENTS = [
    ("enumeration", r"有哪些|列出|所有|全部|list all|enumerate|show all|what are (?:all|the different|the available)|what \w+ are (?:there|available)|what are the \w+\s*\??$"),
    ("comparison", r"对比|比较|区别|差异|\bvs\b|versus|\bbetter\b|difference between|compared (?:to|with)"),
    ("comparison", r"哪(?:个|把|款|种|一个)[^，。？?！!]{0,8}(?:高|低|好|强|弱|大|小|快|慢|多|少|远|近|准|优|厉害)"),
    ("comparison", r"和[^，。？?]{1,16}(?:相比|比起来|做对比|比一比)"),
    ("script", r"angelscript|\.as\b|脚本|游戏模式|game mode|script|函数签名|hook"),
    ("inheritance", r"继承|父类|基类|基础文件|父文件|派生|模板|继承链|inherit|extends|parent file|base file|derive"),
    ("source", r"源码|源文件|原始文件|哪个文件|文件在哪|定义在哪|哪里定义|source file|raw file|which file|defined in|file path"),
]
REVERSE_SUBJECT = "有哪些|哪些|什么|谁|which|who|what"
REVERSE_VERB = "引用|用到|使用|用了|reference[sd]?|use[sd]?|using"
KEY_TOKEN = r"\b[A-Za-z0-9][A-Za-z0-9_.\-]*\.(?:weapon|soldier|faction|script_chunk|projectile|vehicle|call|character|carry_item|resource)\b"
META = "^(你是谁|你有什么能力|你好|你叫什么|介绍一下你自己|你是什么|who are you|what can you do|hello|hi\\b|what are you|tell me about yourself|你的功能|你能做什么|你能干什么|你能帮什么)"
MENTION_KEY = r"[a-zA-Z0-9_]+\.(?:weapon|vehicle|projectile|call|carry_item|xml|character)"
BREADTH = {"enumeration": 150, "inheritance": 12, "source": 12, "script": 12}
# Characters that one token stands for.
CJK_PER_TOKEN, OTHER_PER_TOKEN = 1.5, 4


def split_plain(text: Column) -> Column:
    """Tokens between white space, punctuation and symbols."""
    return F.filter(F.split(text, SEPARATOR), lambda t: t != "")


def tokenize(text: Column, cjk: bool = True) -> Column:
    """Tokens of a text; with cjk, runs of CJK characters become their characters and then their pairs."""
    plain = split_plain(text)
    if not cjk:
        return plain

    def pieces(token: Column) -> Column:
        runs = F.regexp_extract_all(token, F.lit(f"([{CJK}]+|[^{CJK}]+)"), F.lit(1))
        return F.flatten(F.transform(runs, lambda r: F.when(r.rlike(f"[{CJK}]"), F.concat(chars(r), pairs(r))).otherwise(F.array(r))))

    def chars(run: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.length(run)), lambda i: F.substring(run, i, F.lit(1)))

    def pairs(run: Column) -> Column:
        return F.when(F.length(run) > 1, F.transform(F.sequence(F.lit(1), F.length(run) - 1), lambda i: F.substring(run, i, F.lit(2)))).otherwise(F.array().cast("array<string>"))

    return F.flatten(F.transform(plain, lambda t: F.when(t.rlike(f"[{CJK}]"), pieces(t)).otherwise(F.array(t))))


def entity_tokens(question: Column, most: int = 5) -> Column:
    """The first tokens that look like identifiers and are no stop words."""
    found = F.regexp_extract_all(question, F.lit(f"({ENTITY_TOKEN})"), F.lit(1))
    return F.slice(F.filter(found, lambda t: ~F.lower(t).isin(ENTITY_STOP_WORDS)), 1, most)


def intent(question: Column) -> Column:
    """The first intent whose pattern fits, else `specific`."""
    rules = [F.when(question.rlike(f"(?i){p}"), F.lit(name)) for name, p in INTENTS]
    return F.coalesce(*rules, F.lit("specific"))


def exact_key(question: Column, other: int = 12) -> Column:
    """The typed key a question is about: it leaves at most so many other characters. Else null."""
    q = F.trim(question)
    key = F.regexp_extract(q, f"({KEY_TOKEN})", 1)
    # only the first occurrence is taken out
    at = F.instr(q, key)
    rest = F.trim(F.concat(F.substring(q, F.lit(1), at - 1), F.substring(q, at + F.length(key), F.length(q))))
    return F.when((key != "") & (F.length(rest) <= other), key)


def reverse_lookup(question: Column) -> Column:
    """Whether an interrogative comes first and a verb of reference after it."""
    subject = F.regexp_instr(question, F.lit(f"(?i)({REVERSE_SUBJECT})"))
    return (subject > 0) & F.substring(question, subject, F.length(question)).rlike(f"(?i)({REVERSE_VERB})")


def meta_question(question: Column, most: int = 50) -> Column:
    """Whether a short question is about the answering system itself."""
    q = F.trim(question)
    return (F.length(q) <= most) & q.rlike(f"(?i){META}")


def retrieval_breadth(category: Column, key: Column, reverse: Column) -> Column:
    """Documents to retrieve: 5 for a key, 12 for a reverse lookup, else by intent."""
    by_intent = reduce(lambda c, kv: c.when(category == kv[0], F.lit(kv[1])), BREADTH.items(), F.when(F.lit(False), F.lit(0)))
    return F.when(key.isNotNull(), F.lit(5)).when(reverse, F.lit(12)).otherwise(F.coalesce(by_intent, F.lit(30)))


def mentioned_keys(text: Column) -> Column:
    """Distinct typed keys in back ticks, then in bold; plain ones only without either."""
    ticked = F.regexp_extract_all(text, F.lit(f"`({MENTION_KEY})`"), F.lit(1))
    bold = F.regexp_extract_all(text, F.lit(rf"\*\*({MENTION_KEY})\*\*"), F.lit(1))
    plain = F.regexp_extract_all(text, F.lit(rf"\b({MENTION_KEY})\b"), F.lit(1))
    marked = F.concat(ticked, bold)
    return F.array_distinct(F.when(F.size(marked) > 0, marked).otherwise(plain))


def mentioned_names(text: Column, most: int = 10) -> Column:
    """Distinct bold names of 2 to 50 characters with a Latin letter or digit."""
    names = F.transform(F.regexp_extract_all(text, F.lit(r"\*\*([^*]+)\*\*"), F.lit(1)), lambda n: F.trim(n))
    return F.slice(F.array_distinct(F.filter(names, lambda n: F.length(n).between(2, 50) & n.rlike("[a-zA-Z0-9]"))), 1, most)


def token_estimate(text: Column) -> Column:
    """Tokens a text will take: CJK characters count two thirds, others a quarter."""
    cjk = F.length(F.regexp_replace(text, f"[^{CJK}]", ""))
    return F.coalesce(F.ceil(cjk / CJK_PER_TOKEN + (F.length(text) - cjk) / OTHER_PER_TOKEN), F.lit(0)).cast("long")


def strip_markdown(text: Column) -> Column:
    """Plain text of markdown: code, headings, emphasis, links and quotes lose their marks, list items begin with a bullet."""
    # The rules, in their order.
    steps = [
        (r"(?sm)^```\w*\n?(.*?)```", "$1"), (r"(?s)```(.*?)```", "$1"), (r"(?m)^#{1,6}\s+", ""), (r"\*\*(.+?)\*\*", "$1"), (r"(?<!\*)\*(.+?)\*(?!\*)", "$1"), ("`(.+?)`", "$1"),
        (r"(?m)^\s*[-*+]\s+", "• "), (r"(?m)^\s*\d+\.\s+", ""), (r"\[(.+?)\]\(.+?\)", "$1"), (r"(?m)^>\s+", ""), (r"(?m)^---+$", ""), (r"\n{3,}", "\n\n"),
    ]
    return F.trim(reduce(lambda c, s: F.regexp_replace(c, *s), steps, text))
