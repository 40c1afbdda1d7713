"""Substring dedup by recompression.

Each document is parsed into a hierarchy of symbols. A round first names the inside of maximal runs (a, a, a, a -> a, a^2, a), then parts the
alphabet in two and names every pair of a left and a right symbol. Names are hashes of what they stand for, so all
tasks of a round give equal content equal names without a dictionary on any one machine. The parse is locally
consistent: a symbol carries the span of words that fixes it (its context), and wherever that span occurs, in any
document, the same symbol stands inside. A window with a whole context inside thus shows a common symbol to every other
copy of the window; the few windows that hold none (most of a long run, say) stand for themselves.

1. Symbols of the last round, named by the words of their context, and windows without one, go to buckets by name:
   which are in two documents or more?
2. A window all of whose symbols are shared is a candidate. Their 128-bit names go to buckets: the smallest document of each?
3. Words covered by windows that a smaller document has go.

Documents are held in shards by id. A shard sends a name once, however many of its documents have it, so a passage that
a third of all documents share costs its bucket one entry for each shard. What comes back to a shard is only what
others share. The shards' rows are shuffled once; the three passes read the same shuffle.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from lattis.llm.hashing import U, combine, mix, powers, powers_inverse, windows, within_text, words
from lattis.llm.shards import NO_ID, documents, packed_texts, shards_for

#: Words of a window.
WINDOW = 13
#: Rounds of recompression: four leave about 0.3 symbols a word, and 95 in 100 windows of 13 words hold a whole context.
ROUNDS = 4
FAR = 1 << 62


def recompress(symbols, begin, end, owner, level: int):
    """One round: runs, then pairs. begin and end: the words that fix each symbol; FAR away at a text's edge."""
    n = len(symbols)
    if not n:
        return symbols, begin, end, owner
    fresh = np.concatenate(([True], (symbols[1:] != symbols[:-1]) | (owner[1:] != owner[:-1])))
    at = np.flatnonzero(fresh)
    length = np.diff(np.append(at, n))
    last = at + length - 1
    before, after = np.maximum(at - 1, 0), np.minimum(last + 1, n - 1)
    from_b, from_e = (at > 0) & (owner[before] == owner[at]), (last + 1 < n) & (owner[after] == owner[at])
    # a run keeps its two ends beside its inside's name: an end next to another symbol looks the same in runs of any length
    size = np.minimum(length, 3)
    pos = np.concatenate(([0], np.cumsum(size)))
    m = int(pos[-1])
    name, who = np.repeat(symbols[at], size), np.repeat(owner[at], size)
    b, e = np.empty(m, dtype=np.int64), np.empty(m, dtype=np.int64)
    head, tail = pos[:-1], pos[1:] - 1
    b[tail], e[tail] = begin[last], end[last]
    b[head], e[head] = begin[at], end[at]
    run, long = length > 1, length > 2
    for where, other, inner in ((head, before, from_b), (tail, after, from_e)):
        w, o, ok = where[run], other[run], inner[run]
        b[w], e[w] = np.where(ok, np.minimum(b[w], begin[o]), -FAR), np.where(ok, np.maximum(e[w], end[o]), FAR)
    inside = head[long] + 1
    name[inside] = combine([symbols[at][long], length[long].astype(np.uint64)], seed=100 + level)
    b[inside], e[inside] = np.minimum(b[head[long]], b[tail[long]]), np.maximum(e[head[long]], e[tail[long]])

    left = (mix(name, 200 + level) >> U(63)).astype(bool)
    head = np.concatenate((left[:-1] & ~left[1:] & (who[1:] == who[:-1]), [False]))
    idx = np.flatnonzero(~np.concatenate(([False], head[:-1])))
    pair = head[idx]
    other = np.where(pair | left[idx], np.minimum(idx + 1, m - 1), np.maximum(idx - 1, 0))  # the neighbour that decides
    inner = (other != idx) & (who[other] == who[idx])
    out = name[idx]
    out[pair] = combine([name[idx][pair], name[other][pair]], seed=300 + level)
    ob = np.where(inner, np.minimum(b[idx], b[other]), -FAR)
    oe = np.where(inner, np.maximum(e[idx], e[other]), FAR)
    return out, ob, oe, who[idx]


def parse(texts: list[bytes], window: int, rounds: int):
    """Words, bounds, start of each window; names of anchors with their text and the windows (first, last) that hold them."""
    h, bounds = words(texts)
    owner = np.repeat(np.arange(len(texts)), np.diff(bounds))
    starts = within_text(bounds, window)
    sym, b, e, who = h, np.arange(len(h)), np.arange(len(h)), owner
    for level in range(rounds):
        sym, b, e, who = recompress(sym, b, e, who, level)
    use = (b > -FAR) & (e < FAR)
    use[use] &= e[use] - b[use] < window
    sym, b, e, who = sym[use], b[use], e[use], who[use]
    first = np.maximum(e - window + 1, bounds[who])
    last = np.minimum(b, bounds[who + 1] - window)
    ok = first <= last
    sym, who, first, last = sym[ok], who[ok], first[ok], last[ok]
    sym = spans(h, b[ok], e[ok])
    bare = starts[covered(first, last, len(h))[starts] == 0] if len(starts) else starts
    names = combine([windows(h, window)[bare]], seed=9) if len(bare) else np.empty(0, dtype=np.uint64)
    return h, bounds, owner, starts, (np.concatenate((sym, names)), np.concatenate((who, owner[bare])), np.concatenate((first, bare)), np.concatenate((last, bare)))


def spans(h: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Names of the word sequences from begin to end, both inclusive."""
    with np.errstate(over="ignore"):
        total = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(mix(h, 11) * powers(len(h)))))
        return mix((total[end + 1] - total[begin]) * powers_inverse(len(h) + 1)[begin] + mix((end - begin).astype(np.uint64), 12), 13)


def covered(first: np.ndarray, last: np.ndarray, n: int) -> np.ndarray:
    """How many of the closed intervals hold each of n positions."""
    return np.cumsum(np.bincount(first, minlength=n + 1) - np.bincount(last + 1, minlength=n + 1))[:n]


def ordered(ids: np.ndarray) -> np.ndarray:
    """Ids as unsigned numbers in the same order, negative ones first."""
    return ids.view(np.uint64) ^ U(1 << 63)


def lowest(keys: list[np.ndarray], ids: np.ndarray):
    """Distinct keys with the smallest and largest id of each, and how many rows have it."""
    order = np.lexsort((ids, *keys[::-1]))
    keys, ids = [k[order] for k in keys], ids[order]
    new = np.ones(len(ids), dtype=bool)
    if len(ids):
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    at = np.flatnonzero(new)
    ends = np.append(at[1:], len(ids))
    return [k[at] for k in keys], ids[at], ids[ends - 1] if len(ids) else ids, ends - at if len(ids) else at


PACKED = "bucket int, shard int, n int, data binary"


def packed(keys: list[np.ndarray], low: np.ndarray, high: np.ndarray, shard: int, buckets: int, spread: np.ndarray | None = None, more: np.ndarray | None = None) -> pd.DataFrame:
    """One row for each bucket: n of each key, then n smallest ids and n distances to the largest, byte by byte to compress well, then n bytes of more.

    A bucket is a range of the first keys, or of spread if keys are not even.
    """
    to = (((keys[0] if spread is None else spread) >> U(32)) * U(buckets) >> U(32)).astype(np.int64)
    order = np.argsort(to, kind="stable")
    cols = [x[order] for x in (*keys, low, high - low)]
    more = np.empty(0, dtype=np.uint8) if more is None else more[order]
    cut = np.searchsorted(to[order], np.arange(buckets + 1))
    rows = [(k, shard, int(b - a), b"".join([x[a:b].tobytes() for x in cols[:-2]] + [planes(x[a:b]) for x in cols[-2:]] + [more[a:b].tobytes()])) for k, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if b > a]
    return pd.DataFrame(rows, columns=["bucket", "shard", "n", "data"])


def planes(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8).T).tobytes()


def opened(n, data, keys: int) -> list[np.ndarray]:
    """What packed() has packed: keys, low, high."""
    parts = [[] for _ in range(keys + 2)]
    for k, x in zip(n, data, strict=True):
        for i in range(keys):
            parts[i].append(np.frombuffer(x, dtype=np.uint64, count=k, offset=8 * k * i))
        for i in (keys, keys + 1):
            parts[i].append(np.ascontiguousarray(np.frombuffer(x, dtype=np.uint8, count=8 * k, offset=8 * k * i).reshape(8, k).T).view(np.uint64).ravel())
    out = [np.concatenate(p) if p else np.empty(0, dtype=np.uint64) for p in parts]
    return [*out[:-1], out[-2] + out[-1]]


def unpacked(n, data, width: int) -> list[np.ndarray]:
    parts = [[] for _ in range(width)]
    for k, x in zip(n, data, strict=True):
        for i, col in enumerate(np.frombuffer(x, dtype=np.uint64).reshape(width, k)):
            parts[i].append(col)
    return [np.concatenate(p) if p else np.empty(0, dtype=np.uint64) for p in parts]


def substring_dedup(docs: DataFrame, window: int = WINDOW, rounds: int = ROUNDS, shards: int | None = None, with_text: bool = False) -> DataFrame:
    """Removes each word covered by a window of `window` words whose sequence also starts in a document with a smaller doc_id.

    docs: doc_id (whole number), text; other columns are ignored. Words are maximal runs of bytes other than ASCII white
    space. Returns doc_id, n_words, n_removed, kept_sha256 (of the kept words joined by one space), and with_text the kept
    text: the whole text as it was if nothing goes, else the kept words joined by one space; and text_md5, the MD5 of the
    text as it was (null where nothing goes), which names a row beside its doc_id.

    A null or empty text has no words, and the hash of the empty string; a null text stays null. Rows with one doc_id are
    judged each by itself and don't remove from one another. A null doc_id counts as larger than any. An empty table gives
    an empty table. The largest long stands for a null doc_id. Memory: a task holds one shard of documents (two for each
    shuffle partition, more if a shard's texts came to more than SHARD_BYTES), or a bucket of names, and each shard adds a
    name to it once.
    """
    shards = shards or shards_for(docs)
    buckets = -(-shards // 2)

    def symbols(pdf: pd.DataFrame) -> pd.DataFrame:
        keys, who = [], []
        for ids, texts in documents(pdf["docs"]):
            *_, (names, owner, _, _) = parse([t or b"" for t in texts], window, rounds)
            keys.append(names)
            who.append(ordered(ids)[owner])
        (names,), low, high, _ = lowest([np.concatenate(keys)], np.concatenate(who))
        return packed([names], low, high, int(pdf["shard"].iloc[0]), buckets)

    def shared(width: int):
        """Back to each shard: the keys, with the smallest document anywhere, that a document other than the shard's smallest has."""

        def of(pdf: pd.DataFrame) -> pd.DataFrame:
            *keys, low, high = opened(pdf["n"], pdf["data"], width)
            shard = np.repeat(pdf["shard"].to_numpy(), pdf["n"])
            order = np.lexsort(keys[::-1])
            keys = [k[order] for k in keys]
            low, high, shard = low[order], high[order], shard[order]
            at = np.flatnonzero(np.concatenate(([True], np.logical_or.reduce([k[1:] != k[:-1] for k in keys]))))
            count = np.diff(np.append(at, len(low)))
            least, most = np.repeat(np.minimum.reduceat(low, at), count), np.repeat(np.maximum.reduceat(high, at), count)
            back = least < (most if width == 1 else high)
            keys, least, shard = [k[back] for k in keys], least[back], shard[back]
            order = np.argsort(shard, kind="stable")
            shard = shard[order]
            out = [x[order] for x in (*keys, least)[: width + (width > 1)]]
            found, at = np.unique(shard, return_index=True)
            cut = np.append(at, len(shard))
            return pd.DataFrame([(int(s), int(b - a), b"".join(x[a:b].tobytes() for x in out)) for s, a, b in zip(found, cut[:-1], cut[1:], strict=True)], columns=["shard", "n", "data"])

        return of

    def candidates(pdf: pd.DataFrame, back: pd.DataFrame) -> pd.DataFrame:
        if not len(pdf) or not len(back):
            return pd.DataFrame(columns=["bucket", "shard", "n", "data"])
        (known,) = unpacked(back["n"], back["data"], 1)
        known.sort()
        one, two, who = [], [], []
        for ids, texts in documents(pdf["docs"]):
            texts = [t or b"" for t in texts]
            h, _, owner, starts, (names, _, first, last) = parse(texts, window, rounds)
            hit = member(names, known)
            if hit.any():
                own = covered(first[~hit], last[~hit], len(h))[starts] > 0
                at = starts[(covered(first[hit], last[hit], len(h))[starts] > 0) & ~own]
                one.append(windows(h, window)[at])
                two.append(windows(h, window, seed=5)[at])
                who.append(ordered(ids)[owner[at]])
        if not one:
            return pd.DataFrame(columns=["bucket", "shard", "n", "data"])
        keys, low, high, _ = lowest([np.concatenate(one), np.concatenate(two)], np.concatenate(who))
        return packed(keys, low, high, int(pdf["shard"].iloc[0]), buckets)

    def removed(pdf: pd.DataFrame, back: pd.DataFrame) -> pd.DataFrame:
        one, two, least = unpacked(back["n"], back["data"], 3)
        order = np.lexsort((two, one))
        one, two, least = one[order], two[order], least[order]
        out = []
        for ids, raw in documents(pdf["docs"]):
            texts = [t or b"" for t in raw]
            h, bounds = words(texts)
            gone = np.zeros(len(h), dtype=bool)
            if len(one) and len(h) >= window:
                starts = within_text(bounds, window)
                owner = np.repeat(ordered(ids), np.diff(bounds))
                w1, w2 = windows(h, window), windows(h, window, seed=5)
                starts = starts[member(w1[starts], one)]
                smaller = np.zeros(len(starts), dtype=bool)
                at = np.searchsorted(one, w1[starts])
                going = np.ones(len(starts), dtype=bool)  # names equal in their first half are tried in turn
                while going.any():
                    on = np.minimum(at, len(one) - 1)
                    going &= (at < len(one)) & (one[on] == w1[starts])
                    smaller |= going & (two[on] == w2[starts]) & (least[on] < owner[starts])
                    at = at + 1
                hit = starts[smaller]
                gone = covered(hit, hit + window - 1, len(h)) > 0
            for i, text in enumerate(texts):
                mask = gone[bounds[i] : bounds[i + 1]]
                n_gone = int(mask.sum())
                kept = b" ".join(compress(text.split(), ~mask) if n_gone else text.split())
                row = (None if ids[i] == NO_ID else int(ids[i]), len(mask), n_gone, hashlib.sha256(kept).hexdigest())
                whole = kept if n_gone else raw[i]
                out.append((*row, None if whole is None else whole.decode("utf-8", "replace"), hashlib.md5(text).digest() if n_gone else None) if with_text else row)
        names = ["doc_id", "n_words", "n_removed", "kept_sha256"] + ["text", "text_md5"] * with_text
        result = pd.DataFrame(out, columns=names)
        result["doc_id"] = result["doc_id"].astype("Int64")
        return result

    back_type = "shard int, n int, data binary"
    by_shard = packed_texts(docs, shards).groupBy("shard")
    known = by_shard.applyInPandas(symbols, PACKED).groupBy("bucket").applyInPandas(shared(1), back_type)
    least = by_shard.cogroup(known.groupBy("shard")).applyInPandas(candidates, PACKED).groupBy("bucket").applyInPandas(shared(2), back_type)
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", text string, text_md5 binary" * with_text
    return by_shard.cogroup(least.groupBy("shard")).applyInPandas(removed, schema)


def member(x: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which of x are in the sorted array."""
    if not len(known):
        return np.zeros(len(x), dtype=bool)
    return known[np.minimum(np.searchsorted(known, x), len(known) - 1)] == x
