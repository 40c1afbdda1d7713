"""Vectorised words and hashes of text, used inside Spark tasks.

Words are maximal runs of bytes other than ASCII white space (0x20 and 0x09 to 0x0D) of the UTF-8 text.
Hashes are 64-bit polynomial sums over a fixed random byte table, finished by a mixing step; they depend on the
bytes alone, so every task names equal words equally.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

U = np.uint64
#: Bytes of text that one vectorised step works on; a longer document is a step of its own, whose bytes are hashed in pieces.
STEP_BYTES = 1 << 20


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    with np.errstate(over="ignore"):
        z = x + U((0x9E3779B97F4A7C15 * (seed + 1)) & 0xFFFFFFFFFFFFFFFF)
        z = (z ^ (z >> U(30))) * U(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> U(27))) * U(0x94D049BB133111EB)
        return z ^ (z >> U(31))


TABLE = mix(np.arange(256, dtype=np.uint64), 7)
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
TABLE[SPACE] = 0
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
FACTOR = 0xD6E8FEB86659FD93


def powers(n: int) -> np.ndarray:
    out = np.empty(max(n, 1), dtype=np.uint64)
    out[0] = 1
    with np.errstate(over="ignore"):
        out[1:] = U(FACTOR)
        return np.multiply.accumulate(out)


def steps(texts: list[bytes], most: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about so many bytes together."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield at, i
            at, size = i, 0
        size += len(t) + 1
    if at < len(texts):
        yield at, len(texts)


def as_bytes(texts) -> list[bytes]:
    """UTF-8 of each text; null is empty. Lone surrogates can't come from Spark strings."""
    return [t.encode("utf-8", "replace") if isinstance(t, str) else b"" for t in texts]


def pieces(data: np.ndarray, most: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of about so many bytes, cut behind white space; data ends with white space. A longer word is not cut."""
    at = 0
    while at < len(data):
        end = at + most
        if end >= len(data):
            end = len(data)
        else:
            back = np.flatnonzero(SPACE[data[at:end]])
            end = at + int(back[-1]) + 1 if len(back) else end + int(np.argmax(SPACE[data[end:]])) + 1
        yield at, end
        at = end


def hash_words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, begin) of each word; data ends with white space."""
    space = SPACE[data]
    begins = np.flatnonzero(~space & np.concatenate(([True], space[:-1])))
    if not len(begins):
        return np.empty(0, dtype=np.uint64), begins
    spans = np.diff(np.append(begins, len(data)))
    within = np.arange(begins[0], len(data)) - np.repeat(begins, spans)
    with np.errstate(over="ignore"):
        value = TABLE[data[begins[0] :]] * powers(int(spans.max()))[within]
        return mix(np.add.reduceat(value, begins - begins[0])), begins


def words(texts: list[bytes], lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, bounds): the words of text i are bounds[i] to bounds[i + 1]. A long text is hashed piece by piece."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    hashes, begins = [], []
    for a, b in pieces(data):
        h, at = hash_words(LOWER[data[a:b]] if lower else data[a:b])
        hashes.append(h)
        begins.append(at + a)
    ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts)))
    return np.concatenate(hashes), np.concatenate(([0], np.searchsorted(np.concatenate(begins), ends)))


def combine(parts: list[np.ndarray], seed: int = 0) -> np.ndarray:
    """One hash of several, in order."""
    with np.errstate(over="ignore"):
        out = mix(parts[0], seed)
        for x in parts[1:]:
            out = mix(out * U(FACTOR) + x, seed)
        return out


def windows(hashes: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """The hash of each n consecutive values, by prefix sums of powers: cost does not grow with n."""
    if len(hashes) < n:
        return np.empty(0, dtype=np.uint64)
    with np.errstate(over="ignore"):
        p = powers(len(hashes))
        total = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(mix(hashes, seed) * p)))
        back = powers_inverse(len(hashes) - n + 1)
        return mix((total[n:] - total[:-n]) * back, seed)


def powers_inverse(n: int) -> np.ndarray:
    out = np.empty(max(n, 1), dtype=np.uint64)
    out[0] = 1
    with np.errstate(over="ignore"):
        out[1:] = U(pow(FACTOR, -1, 1 << 64))
        return np.multiply.accumulate(out)


def within_text(bounds: np.ndarray, n: int) -> np.ndarray:
    """Start positions of the windows of n words that stay in one text."""
    total = int(bounds[-1])
    stop = np.repeat(bounds[1:], np.diff(bounds))
    at = np.arange(total)
    return at[at + n <= stop]


def shingles(hashes: np.ndarray, bounds: np.ndarray, n: int) -> Iterator[np.ndarray]:
    """For each text its distinct n-word shingles, sorted; a shorter text is one shingle as a whole, an empty one none."""
    every = windows(hashes, n)
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        if b - a >= n:
            yield np.unique(every[a : b - n + 1])
        elif b > a:
            yield combine([hashes[i : i + 1] for i in range(a, b)], seed=int(b - a))
        else:
            yield np.empty(0, dtype=np.uint64)
