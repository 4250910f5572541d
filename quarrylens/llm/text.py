"""Vectorised text primitives: code points, words and word-shingle hashes in numpy."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Code points hashed at once; a longer text goes piece by piece, cut between words.
PIECE = 1 << 20


@lru_cache(maxsize=1)
def word_table() -> np.ndarray:
    """Which code points belong to words: letters and digits of any script, and the underscore."""
    table = np.fromiter((chr(i).isalnum() for i in range(0x110000)), dtype=bool, count=0x110000)
    table[ord("_")] = True
    return table


@lru_cache(maxsize=1)
def letter_table() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (two multiply-xorshift rounds)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_powers: dict[str, np.ndarray] = {}


def _power(kind: str, n: int) -> np.ndarray:
    have = _powers.get(kind)
    if have is None or len(have) < n:
        base = _BASE if kind == "up" else _INVERSE
        size = max(n, PIECE + 1)
        have = np.full(size, base, dtype=U64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if n <= PIECE + 1:
            _powers[kind] = have
    return have


def _pieces(points: np.ndarray, is_word: np.ndarray):
    at = 0
    while at < len(points):
        end = min(len(points), at + PIECE)
        if end < len(points):
            gaps = np.flatnonzero(~is_word[at:end])
            if len(gaps):
                end = at + int(gaps[-1]) + 1
            else:
                after = np.flatnonzero(~is_word[end:])
                end = end + int(after[0]) + 1 if len(after) else len(points)
        yield at, end
        at = end


def word_hashes(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of every maximal run of word characters."""
    is_word = word_table()[points]
    hashes, starts = [], []
    for at, end in _pieces(points, is_word):
        w = np.concatenate(([False], is_word[at:end], [False]))
        edge = np.flatnonzero(w[1:] != w[:-1])
        s, e = edge[::2], edge[1::2]
        if not len(s):
            continue
        n = end - at
        total = np.zeros(n + 1, dtype=U64)
        np.cumsum((points[at:end].astype(U64) + U64(1)) * _power("up", n)[:n], out=total[1:])
        hashes.append(mix((total[e] - total[s]) * _power("down", n)[s] + (e - s).astype(U64)))
        starts.append(s + at)
    if not hashes:
        return np.empty(0, dtype=U64), np.empty(0, dtype=np.int64)
    return np.concatenate(hashes), np.concatenate(starts)


def shingles(texts: list[str], width: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The multiset of word shingles of up to 256 texts: (text number, 56-bit shingle hash, count), sorted.

    Words are lower-cased runs of letters, digits and underscores.  A text of one to width-1
    words has one shingle of all its words; a text without words has none.
    """
    assert len(texts) <= 256
    points = [code_points(t.lower()) for t in texts]
    hs, ds = [], []
    group: list[int] = []
    size = 0

    def flush() -> None:
        nonlocal size
        if not group:
            return
        if len(group) == 1:
            h, s = word_hashes(points[group[0]])
            d = np.full(len(h), group[0], dtype=np.int64)
        else:
            gap = np.array([10], dtype=np.uint32)
            joined = np.concatenate([p for g in group for p in (points[g], gap)])
            begins = np.cumsum([0] + [len(points[g]) + 1 for g in group[:-1]])
            h, s = word_hashes(joined)
            d = np.asarray(group)[np.searchsorted(begins, s, side="right") - 1]
        hs.append(h)
        ds.append(d)
        group.clear()
        size = 0

    for i, p in enumerate(points):
        if size + len(p) > PIECE // 2:
            flush()
        group.append(i)
        size += len(p) + 1
    flush()
    h = np.concatenate(hs) if hs else np.empty(0, dtype=U64)
    d = np.concatenate(ds) if ds else np.empty(0, dtype=np.int64)
    key = _windows(h, d, width, len(texts))
    if not len(key):
        return np.empty(0, dtype=np.int64), key, np.empty(0, dtype=np.int64)
    key.sort()
    first = np.concatenate(([True], key[1:] != key[:-1]))
    at = np.flatnonzero(first)
    count = np.diff(np.append(at, len(key)))
    key = key[at]
    return (key >> U64(56)).astype(np.int64), key & U64((1 << 56) - 1), count


def _windows(h: np.ndarray, d: np.ndarray, width: int, n_texts: int) -> np.ndarray:
    """Keys (text number, 56-bit hash) of every window of width words within one text."""
    if not len(h):
        return np.empty(0, dtype=U64)
    n = len(h) - width + 1
    out = []
    if n > 0:
        total = np.zeros(n, dtype=U64)
        for j in range(width):
            total = mix(total + h[j : j + n])
        inside = d[:n] == d[width - 1 :]
        out.append((d[:n][inside].astype(U64) << U64(56)) | (total[inside] >> U64(8)))
    words = np.bincount(d, minlength=n_texts)
    for text in np.flatnonzero((words > 0) & (words < width)):
        own = h[np.searchsorted(d, text) : np.searchsorted(d, text, side="right")]
        whole = np.full(1, len(own), dtype=U64)
        for j in range(len(own)):
            whole = mix(whole + own[j : j + 1])
        out.append((U64(text) << U64(56)) | (whole >> U64(8)))
    return np.concatenate(out) if out else np.empty(0, dtype=U64)
