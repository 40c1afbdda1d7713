"""Quality rules: counts over words and lines, and a linear-chain CRF that marks each line as content or boilerplate.

A line is described by binned shares of its words (capitals, symbols, digits, repeats) and by its end; the field adds what
two lines that follow each other tell of each other. Viterbi decoding gives the best labelling of a document's lines as a
whole; the share of words in content lines decides. The field is fitted on labelled documents: lines of good documents are
content; those of others are boilerplate at first, and are read anew once by a model without transitions, which may
call up to half of such a document content.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattis.llm.components import keep
from lattis.llm.hashing import SPACE, as_bytes, hash_words, pieces, steps, windows
from lattis.llm.shards import nullable_id, whole_id

#: Most labelled documents that the field is fitted on, those of the smallest hashes of doc_id, and the most lines with words that such a document has.
LABELLED, LINES = 4000, 200
#: Share of words in content lines from which a document is kept.
SHARE = 0.5
#: Words of a window, the least number of words, and the per cent of words in repeated windows that is allowed.
WINDOW, LEAST_WORDS, MOST_REPEATS = 5, 10, 20
#: Steps and rate of the fit, and its penalty on squared weights.
ROUNDS, RATE, PENALTY = 80, 0.15, 0.5

BYTES = np.arange(256)
#: What is counted of a word's bytes: characters, ASCII capitals and letters, symbols, exclamation and question marks, digits.
COUNTED = [(BYTES & 0xC0 != 0x80) & ~SPACE, (BYTES >= 65) & (BYTES <= 90), (BYTES >= 65) & (BYTES <= 90) | (BYTES >= 97) & (BYTES <= 122), np.isin(BYTES, list(b"#*$%&|<>")), np.isin(BYTES, list(b"!?")), (BYTES >= 48) & (BYTES <= 57)]
CHARS, CAPITALS, LETTERS, SYMBOLS, MARKS, DIGITS = range(6)
#: Bins of a line's features: words; capitals of letters; symbols, marks and digits of characters; words like the one before, and in repeated windows, of words; characters a word.
BINS = [(2, 4, 8, 16, 32), (0.02, 0.1, 0.3, 0.7), (0.001, 0.02, 0.08, 0.2), (0.001, 0.02, 0.08), (0.001, 0.05, 0.3), (0.001, 0.1, 0.5), (0.001, 0.2, 0.8), (2.5, 3.5, 5, 7, 10)]
ENDS = [b".", b"!?", b",;:", b"#*$%&|<>", b")]}\"'"]
SIZES = [len(b) + 1 for b in BINS] + [2, len(ENDS) + 1]
FIRST = np.concatenate(([0], np.cumsum(SIZES)))
FEATURES = int(FIRST[-1])
END_OF = np.full(256, len(ENDS), dtype=np.int16)
for k, ends in enumerate(ENDS):
    END_OF[list(ends)] = k


def word_table(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, counts, last byte, line) of each word, and bounds: the words of text i. Lines are numbered through all texts."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    out, at, lines = [], [], 0
    for a, b in pieces(data):
        part = data[a:b]
        hashes, begins = hash_words(part)
        breaks = np.cumsum(part == 10, dtype=np.int32)
        if len(begins):
            counts = np.stack([np.add.reduceat(c[part].astype(np.int32), begins) for c in COUNTED], axis=1)
            stops = np.flatnonzero(SPACE[part[1:]] & ~SPACE[part[:-1]])
            out.append((hashes, counts, part[stops], breaks[begins] + lines))
            at.append(begins + a)
        lines += int(breaks[-1])
    ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts)))
    if not out:
        return np.empty(0, np.uint64), np.empty((0, len(COUNTED)), np.int32), np.empty(0, np.uint8), np.empty(0, np.int64), np.zeros(len(texts) + 1, np.int64)
    return *(np.concatenate(x) for x in zip(*out, strict=True)), np.concatenate(([0], np.searchsorted(np.concatenate(at), ends)))


def repeated(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Whether each word lies in a window of WINDOW words that its text holds twice or more."""
    every, out = windows(hashes, WINDOW), np.zeros(len(hashes) + 1, dtype=np.int32)
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        if b - a > WINDOW:
            own = every[a : b - WINDOW + 1]
            order = np.argsort(own, kind="stable")
            same = own[order][1:] == own[order][:-1]
            if same.any():
                starts = a + np.unique(np.concatenate((order[1:][same], order[:-1][same])))
                out[starts] += 1
                out[starts + WINDOW] -= 1
    return np.cumsum(out[:-1]) > 0


def describe(texts: list[bytes]) -> Iterator[dict]:
    """For each text its counts, and of its lines with words: place (from 0, empty ones counted), words, and codes, a row of features each."""
    hashes, counts, last, line, bounds = word_table(texts)
    again = repeated(hashes, bounds)
    before = np.zeros(len(hashes), dtype=bool)
    before[1:] = hashes[1:] == hashes[:-1]
    first = np.flatnonzero(np.concatenate(([True], line[1:] != line[:-1]))) if len(line) else np.empty(0, np.int64)
    before[first] = False
    if len(first):
        n = np.diff(np.append(first, len(line)))
        total = np.add.reduceat(counts, first).astype(float)
        share = lambda x, of: x / np.maximum(of, 1)
        told = [n, share(total[:, CAPITALS], total[:, LETTERS]), share(total[:, SYMBOLS], total[:, CHARS]), share(total[:, MARKS], total[:, CHARS]), share(total[:, DIGITS], total[:, CHARS])]
        told += [share(np.add.reduceat(x.astype(np.int64), first), n) for x in (before, again)] + [share(total[:, CHARS], n)]
        codes = np.zeros((len(first), len(SIZES)), dtype=np.int16)
        for k, (x, bins) in enumerate(zip(told, BINS, strict=True)):
            codes[:, k] = FIRST[k] + np.digitize(x, bins)
        codes[:, -1] = FIRST[-2] + END_OF[last[first + n - 1]]
    start, line0 = np.searchsorted(first, bounds), 0
    for i, t in enumerate(texts):
        a, b = start[i], start[i + 1]
        seen, copies, places = set(), [], line[first[a:b]] - line0 if b > a else np.empty(0, np.int64)
        own = t.split(b"\n")
        for p in places.tolist():
            copies.append(own[p] in seen)
            seen.add(own[p])
        doc = counts[bounds[i] : bounds[i + 1]].sum(axis=0, dtype=np.int64)
        row = {"n_words": int(bounds[i + 1] - bounds[i]), "word_chars": int(doc[CHARS]), "n_symbols": int(doc[SYMBOLS]), "n_dup_lines": sum(copies), "n_repeat_words": int(again[bounds[i] : bounds[i + 1]].sum())}
        if b > a:
            codes[a:b, -2] = FIRST[-3] + np.array(copies, dtype=np.int16)
        yield row | {"n_lines": len(own), "places": places, "words": n[a:b] if b > a else np.empty(0, np.int64), "codes": codes[a:b] if b > a else np.empty((0, len(SIZES)), np.int16)}
        line0 += len(own)


class Field:
    """A linear-chain CRF of two labels: the score of content for each feature, of each pair of labels, and of the first label."""

    def __init__(self, weights: np.ndarray):
        self.features, self.pairs, self.start = weights[:FEATURES], weights[FEATURES : FEATURES + 4].reshape(2, 2), weights[FEATURES + 4 :]

    def decode(self, codes: np.ndarray) -> np.ndarray:
        """The best labelling of lines, 1 for content; of equal ones that with content later."""
        if not len(codes):
            return np.empty(0, dtype=np.int8)
        scores = self.features[codes].sum(axis=1).tolist()
        (t00, t01), (t10, t11) = self.pairs.tolist()
        s0, s1 = self.start.tolist()
        s1, back = s1 + scores[0], []
        for e in scores[1:]:
            to0, to1 = s1 + t10 > s0 + t00, s1 + t11 > s0 + t01
            back.append((to0, to1))
            s0, s1 = (s1 + t10 if to0 else s0 + t00), (s1 + t11 if to1 else s0 + t01) + e
        out = np.empty(len(scores), dtype=np.int8)
        label = int(s1 >= s0)
        out[-1] = label
        for k in range(len(back) - 1, -1, -1):
            label = int(back[k][label])
            out[k] = label
        return out


def gradient(weights: np.ndarray, codes: np.ndarray, labels: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Of the log likelihood. codes: document x line x feature, documents by falling length; labels: document x line."""
    field = Field(weights)
    d, t = labels.shape
    active = [int(np.searchsorted(-lengths, -k, side="left")) for k in range(t)]  # documents with more than k lines
    score = np.zeros((d, t, 2))
    score[:, :, 1] = field.features[codes].sum(axis=2)
    ahead, behind = np.zeros((t, d, 2)), np.zeros((t, d, 2))
    ahead[0] = field.start + score[:, 0]
    for k in range(1, t):
        n = active[k]
        ahead[k, :n] = np.logaddexp(ahead[k - 1, :n, :1] + field.pairs[0], ahead[k - 1, :n, 1:] + field.pairs[1]) + score[:n, k]
    for k in range(t - 2, -1, -1):
        n = active[k + 1]
        ahead_of = behind[k + 1, :n] + score[:n, k + 1]
        behind[k, :n] = np.logaddexp(field.pairs[:, 0] + ahead_of[:, :1], field.pairs[:, 1] + ahead_of[:, 1:])
    whole = np.logaddexp(ahead[lengths - 1, np.arange(d), 0], ahead[lengths - 1, np.arange(d), 1])
    out, pairs = np.zeros(len(weights)), np.zeros((2, 2))
    for k in range(t):
        n = active[k]
        content = np.exp(ahead[k, :n, 1] + behind[k, :n, 1] - whole[:n])
        wrong = labels[:n, k] - content
        out[:FEATURES] += np.bincount(codes[:n, k].ravel(), weights=np.repeat(wrong, codes.shape[2]), minlength=FEATURES)
        if k == 0:
            out[FEATURES + 4 :] = -wrong.sum(), wrong.sum()
        else:
            p = np.exp(ahead[k - 1, :n, :, None] + field.pairs + (score[:n, k] + behind[k, :n])[:, None, :] - whole[:n, None, None])
            pairs -= p.sum(axis=0)
            np.add.at(pairs, (labels[:n, k - 1], labels[:n, k]), 1)
    out[FEATURES : FEATURES + 4] = pairs.ravel()
    return out


def train(codes: np.ndarray, labels: np.ndarray, lengths: np.ndarray, chained: bool) -> np.ndarray:
    """Weights of the largest penalised likelihood, by steps of Adam; not chained: those of pairs and the first label stay 0."""
    w = np.zeros(FEATURES + 6)
    mean, square = np.zeros_like(w), np.zeros_like(w)
    for k in range(1, ROUNDS + 1):
        g = (gradient(w, codes, labels, lengths) - PENALTY * w) / len(lengths)
        if not chained:
            g[FEATURES:] = 0
        mean, square = 0.9 * mean + 0.1 * g, 0.99 * square + 0.01 * g * g
        w = w + RATE * (mean / (1 - 0.9**k)) / (np.sqrt(square / (1 - 0.99**k)) + 1e-8)
    return np.round(w, 6)


def fit(docs: list[np.ndarray], good: list[bool]) -> np.ndarray:
    """Weights from the codes of documents, which have lines, and whether each document is good."""
    order = sorted(range(len(docs)), key=lambda i: (-len(docs[i]), i))
    lengths = np.array([len(docs[i]) for i in order])
    codes = np.zeros((len(docs), lengths[0], len(SIZES)), dtype=np.int16)
    labels = np.zeros((len(docs), lengths[0]), dtype=np.int64)
    for row, i in enumerate(order):
        codes[row, : len(docs[i])] = docs[i]
        labels[row, : len(docs[i])] = good[i]
    single = Field(train(codes, labels, lengths, chained=False))
    for row, i in enumerate(order):
        if not good[i]:
            score = single.features[docs[i]].sum(axis=1)
            best = np.argsort(-score, kind="stable")[: len(score) // 2]
            labels[row, best[score[best] > 0]] = 1
    return train(codes, labels, lengths, chained=True)


def labelled(docs: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """doc_id, good, codes of the sample that the field is fitted on: documents with 1 to LINES lines that have words."""
    good = F.coalesce(F.col("quality") == 1, F.lit(False))
    sample = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(good.cast("int")).alias("good"))
    sample = keep(sample.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(sample), "doc_id")

    def code(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            texts = as_bytes(pdf["text"])
            for a, b in steps(texts):
                rows = [(i, x["codes"]) for i, x in zip(range(a, b), describe(texts[a:b]), strict=True) if 0 < len(x["codes"]) <= LINES]
                if rows:
                    yield pd.DataFrame({"doc_id": pdf["doc_id"].iloc[[i for i, _ in rows]], "good": pdf["good"].iloc[[i for i, _ in rows]], "codes": [np.ascontiguousarray(c).tobytes() for _, c in rows]})

    return rows.mapInPandas(code, "doc_id long, good int, codes binary").groupBy("doc_id", "good").agg(F.min("codes").alias("codes"))


def fit_field(docs: DataFrame, labels: DataFrame, most: int = LABELLED) -> np.ndarray | None:
    """Weights fitted in one task on the sample; None without labelled documents of both kinds."""

    def all_of(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("doc_id")
        if pdf["good"].nunique() < 2:
            return pd.DataFrame({"weights": []})
        w = fit([np.frombuffer(x, dtype=np.int16).reshape(-1, len(SIZES)) for x in pdf["codes"]], (pdf["good"] == 1).tolist())
        return pd.DataFrame({"weights": [w.tobytes()]})

    got = labelled(docs, labels, most).groupBy().applyInPandas(all_of, "weights binary").collect()  # one row
    return np.frombuffer(got[0]["weights"]) if got else None


def judge(docs: DataFrame, labels: DataFrame, share: float = SHARE, most: int = LABELLED) -> DataFrame:
    """Counts, line labels and verdict: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, content_share, lines.

    docs: doc_id, text; labels: doc_id, quality. lines holds a value for each line of the text (split at line feeds): true
    for content, false for boilerplate, null for a line without a word. content_share: words in content lines of all words.
    kept: false if base_failed (fewer than LEAST_WORDS words, or too many in repeated windows), else whether content_share
    is at least `share`.

    A null text counts as empty: no words, so base_failed. Each row is judged by its own text, with repeated and null ids
    alike. Labels without doc_id are left out; of several for a document the worst counts, and a null quality is not good.
    Without labels of both kinds every line is content. Columns of other names are not touched. An empty table gives an
    empty one.
    """
    weights = fit_field(docs, labels, most)
    kind = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, content_share double, lines array<boolean>"

    def verdicts(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        field = None if weights is None else Field(weights)
        for pdf in parts:
            texts, ids = as_bytes(pdf["text"]), pdf["doc_id"].tolist()
            for a, b in steps(texts):
                out = []
                for x in describe(texts[a:b]):
                    codes, words, n = x.pop("codes"), x.pop("words"), x["n_words"]
                    content = np.ones(len(codes), dtype=np.int8) if field is None else field.decode(codes)
                    lines = np.full(x.pop("n_lines"), None, dtype=object)
                    lines[x.pop("places")] = content.astype(bool)
                    part = float(words[content == 1].sum()) / n if n else 0.0
                    failed = n < LEAST_WORDS or 100 * x["n_repeat_words"] > MOST_REPEATS * n
                    out.append(x | {"base_failed": failed, "kept": not failed and part >= share, "content_share": part, "lines": lines})
                yield pd.DataFrame({"doc_id": ids[a:b]} | {k: [x[k] for x in out] for k in out[0]})

    return nullable_id(docs.select(whole_id("doc_id"), F.col("text").cast("string").alias("text")).mapInPandas(verdicts, kind), "doc_id")
