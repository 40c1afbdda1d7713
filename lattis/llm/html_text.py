"""Main text of web pages by the maximum-scoring subsequence of words and tags.

A page is a row of words and tags. A word scores what its place tells, a tag minus its cost; the contiguous region of the
largest sum is the content, found in one scan (Pasternack and Roth 2009). Scores come from labelled pages, those that mark
their content with article or main:
- a tag costs the more, the more often it stands outside of content;
- a word's score comes from the log odds of content, beside those of any word, given its features: telling elements around
  it (links, menus, forms, article) and the words of the class, id and role of all elements around it. Features that few
  pages have keep near the prior PRIOR_FEATURES, which knows what menus, forms and adverts are called; where labelled pages
  say otherwise, they lose.
Inside the best region, what stands in an element of a negative feature (an advert in the article, say; but not a link) is
left out.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate
from math import inf, log
from zlib import crc32

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattis.llm.shards import nullable_id, whole_id

#: About so many pages, by hash of page_id and url, are looked at for the labelled ones that weights are fitted on.
LABELLED = 4000
TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<(/?)([A-Za-z][^\s/>]*)([^>]*)(?:>|\Z)""", re.DOTALL)
RAW = {t: re.compile(rf"</{t}\s*>", re.IGNORECASE) for t in ("script", "style", "textarea", "title", "noscript", "iframe", "xmp", "template", "svg")}
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
MARKS = re.compile(r"""(?i)\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""")
#: What is known of features before any page is seen, as if each of them had been seen on so many words outside of content: a name
#: of a tag, or a word of a class, id or role after a dot. Only a few words of doubt stand against a class of general meaning.
PRIOR_FEATURES = dict.fromkeys("head nav footer aside form menu select button dialog input label fieldset object embed applet canvas script style textarea title noscript iframe xmp template svg".split(), 1000.0)
PRIOR_FEATURES |= dict.fromkeys("a header".split(), 10.0)
PRIOR_FEATURES |= dict.fromkeys((f".{x}" for x in "ad ads advert advertisement adsbygoogle sponsor sponsored promo cookie cookies consent nav navbar navigation menu breadcrumb breadcrumbs sidebar footer masthead comments disqus newsletter complementary contentinfo toolbar pagination pager".split()), 1000.0)
PRIOR_FEATURES |= dict.fromkeys((f".{x}" for x in "banner notice comment respond reply replies share sharing social related subscribe subscription popup modal search login".split()), 30.0)
#: The least a tag costs, and what it costs more where it always stands outside of content; words inside content seen beforehand.
BASE, OUTSIDE, SEEN = 0.1, 5.0, 10.0
#: Words of class, id and role that the prior doesn't know are told apart by a hash of so many cells.
CELLS = 1 << 16
#: A log odds below TELLING speaks against a word; scores lie between -MOST and 1 + MOST.
TELLING, MOST = -0.7, 4.0


def tokens(page: str) -> Iterator[tuple[str, str, bool, str]]:
    """(kind, value, closing, attributes): kind is text or tag."""
    at = 0
    while at < len(page):
        m = TAG.search(page, at)
        if not m:
            yield "text", page[at:], False, ""
            return
        if m.start() > at:
            yield "text", page[at : m.start()], False, ""
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        closing, attributes = bool(m[1] or m[4]), m[3] or m[6] or ""
        if name in RAW and not closing and not attributes.endswith("/"):
            end = RAW[name].search(page, at)
            at = end.end() if end else len(page)
            yield "tag", name, False, attributes
            yield "tag", name, True, ""
        else:
            yield "tag", name, closing, attributes


def features(name: str, attributes: str, marked: bool) -> tuple[str, ...]:
    """What an element tells: its name if that is a telling one (a header isn't inside of an article or main element), and after a dot the words of its class, id and role."""
    out = {name} if name in PRIOR_FEATURES and not (marked and name == "header") or name in ("article", "main") else set()
    for m in MARKS.finditer(attributes):
        for word in re.split(r"[^a-z0-9]+", (m[2] or m[3] or m[4] or "").lower()):
            if word:
                out.add(f".{word}" if f".{word}" in PRIOR_FEATURES else f".{crc32(word.encode()) % CELLS}")
    return tuple(sorted(out))


class Frame:
    """An open element, linked to the one around it: the features that those have not, whether it is in an article or main element or is one, and what weigh() tells it."""

    __slots__ = ("around", "fresh", "marked", "told")

    def __init__(self, around: Frame | None, fresh: tuple[str, ...], marked: bool):
        self.around, self.fresh, self.marked, self.told = around, fresh, marked, (0.0, False)


def stream(page: str) -> tuple[list[tuple[str, str, Frame]], list[Frame]]:
    """The row of (kind, value, innermost open element) and all elements, outer ones first; kind: text, open, close. Cost and memory are linear in the page."""
    root = Frame(None, (), False)
    out, frames, names, open_, held = [], [root], [], [root], Counter()
    opened: Counter = Counter()

    def shut() -> str:
        held.subtract(open_.pop().fresh)
        name = names.pop()
        opened[name] -= 1
        return name

    for kind, value, closing, attributes in tokens(page):
        top = open_[-1]
        if kind == "text":
            out.append(("text", value, top))
        elif not closing:
            out.append(("open", value, top))
            if value not in VOID and not attributes.endswith("/"):
                if value in ("p", "li", "option", "dt", "dd", "tr", "td", "th") and names and names[-1] == value:  # these close themselves
                    shut()
                    top = open_[-1]
                fresh = tuple(f for f in features(value, attributes, top.marked) if not held[f])
                held.update(fresh)
                names.append(value)
                opened[value] += 1
                open_.append(Frame(top, fresh, top.marked or value in ("article", "main")))
                frames.append(open_[-1])
        else:
            if opened[value]:
                while shut() != value:
                    pass
            out.append(("close", value, open_[-1]))
    return out, frames


def best_region(scores: list[float]) -> tuple[int, int]:
    """(begin, end) of the contiguous region of the largest sum, the longest of equals; (0, 0) if none is positive."""
    best, begin, low, low_at, region = 0.0, 0, 0.0, 0, (0, 0)
    for i, s in enumerate(accumulate(scores), 1):
        if s - low > best or (s - low == best and best > 0 and i - low_at > region[1] - region[0]):
            best, region = s - low, (low_at, i)
        if s < low:
            low, low_at = s, i
    return region


def weights_of(counts: dict[tuple[str, str, int], int]) -> tuple[dict[str, float], dict[str, float]]:
    """Costs of tags (of unknown ones under an empty name), and log odds of features. counts: (tag, word or all, name, inside) -> how many."""

    def odds(what: str, name: str, against: float = 0.0) -> float:
        return log((counts.get((what, name, 1), 0) + SEEN) / (counts.get((what, name, 0), 0) + SEEN + against))

    costs = {"": BASE if counts else 1.0, "article": 0.0, "main": 0.0}
    for name in {n for w, n, _ in counts if w == "tag"}:
        inside, outside = counts.get(("tag", name, 1), 0), counts.get(("tag", name, 0), 0)
        costs[name] = BASE + OUTSIDE * max(0.0, 2 * (outside + 0.5) / (inside + outside + 1) - 1)
    base = odds("all", "")
    scores = {name: odds("word", name, PRIOR_FEATURES.get(name, 0.0)) - base for name in {n for w, n, _ in counts if w == "word"} | set(PRIOR_FEATURES)}
    return costs, scores


def weigh(frames: list[Frame], scores: dict[str, float]) -> None:
    """Tells each element the score of a word in it, and whether such a word may be left out of the region."""
    sums: dict[Frame | None, tuple[float, float, bool]] = {None: (inf, -inf, False)}
    for frame in frames:
        least, most, out = sums[frame.around]
        for f in frame.fresh:
            x = scores.get(f, 0.0)
            least, most, out = min(least, x), max(most, x), out or (x < TELLING and f != "a")
        sums[frame] = least, most, out
        frame.told = (max(-MOST, least), out) if least < TELLING else (1 + min(MOST, most if most > -inf else 0.0), False)


def main_text(page: str, weights: tuple[dict[str, float], dict[str, float]]) -> str:
    costs, scores = weights
    row, frames = stream(page)
    weigh(frames, scores)
    line = [len(value.split()) * frame.told[0] if kind == "text" else -costs.get(value, costs[""]) for kind, value, frame in row]
    begin, end = best_region(line)
    blocks, now = [], []
    for kind, value, frame in [*row[begin:end], ("close", "div", frames[0])]:
        if kind == "text":
            if not frame.told[1]:
                now.append(value)
        elif value == "br":
            now.append(" ")
        elif value in BLOCK:
            text = " ".join(html.unescape("".join(now)).split())
            if text:
                blocks.append(text)
            now = []
    return "\n\n".join(blocks)


def tally(page: str) -> Counter:
    """(tag, word or all, name, inside) -> how many: words by each feature of the elements around them, and tags."""
    n: Counter = Counter()
    row, frames = stream(page)
    inside: dict[Frame, list[int]] = {f: [0, 0] for f in frames}
    for kind, value, frame in row:
        if kind == "text":
            inside[frame][frame.marked] += len(value.split())
        elif value not in ("article", "main"):
            n["tag", value, int(frame.marked)] += 1
    for frame in reversed(frames):  # inner elements come after those around them
        for k in (0, 1):
            for f in frame.fresh if inside[frame][k] else ():
                n["word", f, k] += inside[frame][k]
            if frame.around:
                inside[frame.around][k] += inside[frame][k]
    for k in (0, 1):
        n["all", "", k] += inside[frames[0]][k]
    return n


def extract(pages: DataFrame, labelled: int = LABELLED) -> DataFrame:
    """page_id, url, text (the main text, empty if none) and n_chars (its code points) of each page.

    pages: page_id, url, html; the whole html is read. Character references are decoded, white space inside a block
    becomes one space, blocks are joined by two line feeds in page order.

    A null or empty html has an empty text. Without labelled pages fixed scores apply (a tag costs 1). Repeated rows give
    a row each; nulls in page_id and url pass through; an empty table gives an empty one.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    place = F.pmod(F.xxhash64("page_id", "url"), F.lit(max(1, pages.select("page_id").count())))
    marked = rows.where((place < labelled) & F.col("html").rlike(r"(?i)<(article|main)[\s>]")).select("html")

    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n: Counter = Counter()
        for pdf in parts:
            for page in pdf["html"]:
                n.update(tally(page))
        yield pd.DataFrame([(w, x, i, c) for (w, x, i), c in n.items()], columns=["what", "name", "inside", "n"])

    counted = marked.mapInPandas(count, "what string, name string, inside int, n long").groupBy("what", "name", "inside").agg(F.sum("n").alias("n"))
    weights = weights_of({(r["what"], r["name"], r["inside"]): r["n"] for r in counted.collect()})  # of LABELLED pages, by name or cell

    def text_of(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            text = [main_text(p, weights) if isinstance(p, str) else "" for p in pdf["html"]]
            yield pd.DataFrame({"page_id": pdf["page_id"], "url": pdf["url"], "text": text, "n_chars": [len(t) for t in text]})

    out = rows.select(whole_id("page_id"), "url", "html").mapInPandas(text_of, "page_id long, url string, text string, n_chars long")
    return nullable_id(out, "page_id")
