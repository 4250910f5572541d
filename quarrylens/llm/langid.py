"""Language identification by the nearest of several clustered centroids per language.

A text becomes a vector of hashed character 1- to 3-gram counts, damped, weighted by inverse
document frequency and scaled to unit length.  Spherical k-means gives each language several
centroids; a text gets the language of the centroid with the largest cosine.  It is rejected when
that cosine lies far below what the centroid's own training texts reach, or when too large a share
of its 3-grams occurs in no training text of its language.  A cosine rises with a text's length, as
a long text of any script fills the hashed buckets; the share does not.

Fitting reads a bounded sample of labelled rows (SAMPLE_PER_LANG a language, by a hash of the row);
their texts become vectors and sets of 3-grams in the executors, and the driver gets those alone.  Prediction
reads every whole text and nothing but the text.

Defined results: a text that is null or has no letter is 'und' with score 0 and rejected; with no
labelled row at all every text is 'und'; rows with a null or repeated doc_id are predicted like any
other; a labelled row that occurs again is learned from once; ties between languages go to the first in
alphabetical order; an empty table gives an empty result; extra columns are ignored; more than
1,000 different labels are an error.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_sample, checkpointed, filtered_texts, fold, mapped_texts, table
from .text import code_points, letter_table

#: Training rows a language, at most about: a bound on what the driver holds.
SAMPLE_PER_LANG = 800
CENTROIDS_PER_LANG = 4
#: Portions in which the driver gets what it learns from.
PARTS = 8
BUCKETS = 1 << 12
#: Code points turned into n-grams at a time.
PIECE = 1 << 19
#: Sharpness of the score: softmax over languages of SHARPNESS x cosine.
SHARPNESS = 25.0
#: A text is rejected below this share of the cosine that nearly all training texts of its centroid reach.
REJECT_SHARE, REJECT_QUANTILE = 0.25, 0.005
#: Bits of the hash by which 3-grams are known: a few thousand a language seldom share a value.
KNOWN_BITS = 18
#: A text is rejected if more than this share of its 3-grams is unknown in its language, or, where its
#: training texts hold more that no other of them has, more than nearly all of those do; a text of
#: few 3-grams may exceed it by UNKNOWN_SPREAD standard deviations.
UNKNOWN_SHARE, UNKNOWN_SPREAD = 0.35, 2.0


def _grams(points: np.ndarray) -> Iterator[np.ndarray]:
    """64-bit hashes of the 1-, 2- and 3-grams of letters, with one space between words."""
    letters = letter_table()[points]
    x = np.where(letters, points, np.uint32(32)).astype(np.uint64)
    keep = np.ones(len(x), dtype=bool)
    keep[1:] = letters[1:] | letters[:-1]
    x = np.concatenate(([np.uint64(32)], x[keep], [np.uint64(32)]))
    one = x * np.uint64(0x9E3779B97F4A7C15)
    two = (one[:-1] ^ (x[1:] * np.uint64(0xC2B2AE3D27D4EB4F))) * np.uint64(0xFF51AFD7ED558CCD)
    three = (two[:-1] ^ (x[2:] * np.uint64(0x165667B19E3779F9))) * np.uint64(0xC4CEB9FE1A85EC53)
    yield one[x != 32] * np.uint64(0xD6E8FEB86659FD93)
    yield two
    yield three


def counts(texts: list[str]) -> np.ndarray:
    """Hashed n-gram counts of each text (float32, one row a text)."""
    out = np.zeros((len(texts), BUCKETS), dtype=np.float32)
    for i, text in enumerate(texts):
        points = code_points(text.lower())
        for at in range(0, len(points), PIECE):
            for hashed in _grams(points[at : at + PIECE]):
                out[i] += np.bincount((hashed >> np.uint64(52)).astype(np.int64), minlength=BUCKETS)
    return out


def _triples(text: str) -> Iterator[np.ndarray]:
    """The values by which a text's 3-grams are known, piece by piece."""
    points = code_points(text.lower())
    for at in range(0, len(points), PIECE):
        *_, three = _grams(points[at : at + PIECE])
        yield (three >> np.uint64(64 - KNOWN_BITS)).astype(np.int64)


def unknown_share(text: str, known: np.ndarray) -> tuple[float, int]:
    """Share of a text's 3-grams that are not known, and the number of its 3-grams."""
    n = unknown = 0
    for t in _triples(text):
        n += len(t)
        unknown += int(np.count_nonzero(~known[t]))
    return unknown / max(n, 1), n


def triple_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The different values of a text's 3-grams and how often each occurs."""
    total = np.zeros(1 << KNOWN_BITS, dtype=np.int64)
    for t in _triples(text):
        total += np.bincount(t, minlength=1 << KNOWN_BITS)
    values = np.flatnonzero(total)
    return values, total[values]


def accepted_share(alone: Iterable[float]) -> float:
    """The largest share of unknown 3-grams that is accepted; alone: of each training text the share that no other has."""
    return max(UNKNOWN_SHARE, float(np.quantile(list(alone), 1 - REJECT_QUANTILE)))


def weighted(c: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(c)
    x *= idf
    for at in range(0, len(x), 256):  # no whole copy of x besides x
        x[at : at + 256] /= np.maximum(np.linalg.norm(x[at : at + 256], axis=1, keepdims=True), 1e-12)
    return x


class LanguageModel:
    """Centroids with their languages and rejection radii; known: of each language what known_triples gives."""

    def __init__(self, langs: list[str], idf: np.ndarray, centroids: np.ndarray, owner: np.ndarray, radius: np.ndarray, known: list[tuple[np.ndarray, float]]):
        self.langs, self.idf, self.centroids, self.owner, self.radius, self.known = langs, idf, centroids, owner, radius, known

    @classmethod
    def fit(cls, raw: np.ndarray, langs: list[str], known: dict[str, tuple[np.ndarray, float]] | None = None) -> LanguageModel:
        """raw: n-gram counts of each training text; langs: their languages; known: by language which 3-grams occur, and the share accepted."""
        names = sorted(set(langs))
        if not names:
            return cls([], np.zeros(BUCKETS, np.float32), np.zeros((0, BUCKETS), np.float32), np.zeros(0, int), np.zeros(0), [])
        idf = (np.log((1 + len(raw)) / (1 + (raw > 0).sum(0))) + 1).astype(np.float32)
        x = weighted(raw, idf)
        label = np.array([names.index(v) for v in langs])
        centroids, owner, radius = [], [], []
        for k in range(len(names)):
            own = x[label == k]
            c = spherical_kmeans(own, CENTROIDS_PER_LANG, seed=k)
            sims = own @ c.T
            best = sims.argmax(1)
            for j in range(len(c)):
                mine = sims[best == j, j]
                if len(mine):
                    centroids.append(c[j])
                    owner.append(k)
                    radius.append(REJECT_SHARE * float(np.quantile(mine, REJECT_QUANTILE)))
        return cls(names, idf, np.array(centroids, dtype=np.float32), np.array(owner), np.array(radius), [known[name] for name in names])

    def foreign(self, text: str, k: int) -> bool:
        """Whether too many 3-grams of a text are unknown in language k."""
        known, limit = self.known[k]
        share, n = unknown_share(text, known)
        return share > limit + UNKNOWN_SPREAD * (limit * (1 - limit) / max(n, 1)) ** 0.5

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, bool]]:
        """(language, score, rejected) of each text."""
        out: list[tuple[str, float, bool]] = [("und", 0.0, True)] * len(texts)
        if not self.langs:
            return out
        for at in range(0, len(texts), 64):
            some = [(at + i, t) for i, t in enumerate(texts[at : at + 64]) if t]
            raw = counts([t for _, t in some])
            has = raw.sum(1) > 0
            sims = weighted(raw, self.idf) @ self.centroids.T
            best = np.full((len(some), len(self.langs)), -1.0)
            for j, k in enumerate(self.owner):
                best[:, k] = np.maximum(best[:, k], sims[:, j])
            e = np.exp(SHARPNESS * (best - best.max(1, keepdims=True))) if len(some) else best
            p = e / e.sum(1, keepdims=True) if len(some) else best
            for r, (i, t) in enumerate(some):
                if has[r] and _has_letter(t):
                    k = int(best[r].argmax())
                    near = int(sims[r].argmax())
                    out[i] = (self.langs[k], float(min(1.0, p[r, k])), bool(sims[r, near] < self.radius[near]) or self.foreign(t, k))
        return out


def _has_letter(text: str) -> bool:
    return any(map(str.isalpha, text[:256])) or any(map(str.isalpha, text[256:]))


def spherical_kmeans(x: np.ndarray, k: int, seed: int, rounds: int = 12, starts: int = 4) -> np.ndarray:
    """Unit centroids that maximise the summed cosine, the best of several seedings by squared distance (k-means++).

    A cluster of hardly any member is seeded anew from the largest one, so odd single texts don't
    use up a language's centroids.
    """
    k = min(k, len(x))
    best_c, best_sum = x[:k].copy(), -np.inf
    for start in range(starts):
        rng = np.random.default_rng([seed, start])
        picks = [int(rng.integers(len(x)))]
        while len(picks) < k:
            gap = np.maximum(1 - (x @ x[picks].T).max(1), 0).astype(np.float64)
            left = [i for i in range(len(x)) if i not in picks]
            picks.append(int(rng.choice(len(x), p=gap / gap.sum())) if gap.sum() > 1e-9 else left[0])
        c = x[picks].copy()
        least = max(1, len(x) // (20 * k)) if len(x) > 20 * k else 1
        for r in range(rounds):
            sims = x @ c.T
            near = sims.argmax(1)
            size = np.bincount(near, minlength=k)
            for j in range(k):
                if size[j] < least and r < rounds // 2:
                    c[j] = x[rng.choice(np.flatnonzero(near == size.argmax()))]
                elif size[j]:
                    m = x[near == j].sum(0)
                    c[j] = m / max(float(np.linalg.norm(m)), 1e-12)
        total = float((x @ c.T).max(1).sum())
        if total > best_sum:
            best_c, best_sum = c, total
    return best_c


def fit_on(labelled: DataFrame) -> LanguageModel:
    """Fit on a bounded sample of (doc_id, text, lang) rows."""
    rows = labelled.filter("lang is not null and text is not null").select("doc_id", F.col("text"), F.col("lang").cast("string").alias("lang"))
    rows = bounded_sample(rows, "lang", SAMPLE_PER_LANG, F.xxhash64("doc_id", "text")).dropDuplicates(["doc_id", "text", "lang"])

    def value(texts: list[str | None]) -> list[list]:
        raw = counts(texts)
        triples = [triple_counts(t) for t in texts]
        at = [np.flatnonzero(r) for r in raw]
        return [
            list(map(_has_letter, texts)), [i.astype("<u2").tobytes() for i in at], [r[i].astype("<f4").tobytes() for r, i in zip(raw, at, strict=True)],
            *([t[k].astype("<u4").tobytes() for t in triples] for k in (0, 1)),
        ]

    names = ("at", "n", "triples", "times")  # as bytes: numbers as objects would take ten times the driver's memory
    made = mapped_texts(rows, ["doc_id", "lang"], "text", [("letters", T.BooleanType()), *((n, T.BinaryType()) for n in names)], value)
    made = checkpointed(made.filter("letters")).coalesce(PARTS)  # an iterator is a job a partition
    got: list[tuple] = []
    holders: dict[str, np.ndarray] = {}  # of each 3-gram value how many texts of a language hold it
    for r in made.select("lang", "doc_id", "at", "n", "triples").toLocalIterator():
        got.append((r.lang, r.doc_id is not None, r.doc_id or 0, bytes(r.at), bytes(r.n)))
        holders.setdefault(r.lang, np.zeros(1 << KNOWN_BITS, dtype=np.int32))[np.frombuffer(r.triples, "<u4")] += 1
    shares: dict[str, list[float]] = {lang: [] for lang in holders}
    for r in made.select("lang", "triples", "times").toLocalIterator():
        times = np.frombuffer(r.times, "<u4")
        shares[r.lang].append(float(times[holders[r.lang][np.frombuffer(r.triples, "<u4")] < 2].sum()) / max(1, int(times.sum())))
    got.sort()
    raw = np.zeros((len(got), BUCKETS), dtype=np.float32)
    for i, r in enumerate(got):
        raw[i, np.frombuffer(r[3], "<u2")] = np.frombuffer(r[4], "<f4")
    return LanguageModel.fit(raw, [r[0] for r in got], {lang: (h > 0, accepted_share(shares[lang])) for lang, h in holders.items()})


def predict_languages(docs: DataFrame, model: LanguageModel, keep: list[str], text_col: str = "text") -> DataFrame:
    """The kept columns of every row with lang_pred, score and rejected."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def value(texts: list[str | None]) -> list[list]:
        found = shared.value.predict(texts)
        return [[f[i] for f in found] for i in range(3)]

    return mapped_texts(docs, keep, text_col, [("lang_pred", T.StringType()), ("score", T.DoubleType()), ("rejected", T.BooleanType())], value)


def in_known_languages(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """The rows that predict() doesn't reject, all columns as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return filtered_texts(docs, text_col, lambda texts: [not f[2] for f in shared.value.predict(texts)])


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit_on(docs.filter(~fold("doc_id", 3, 1)))
    return predict_languages(docs, model, ["doc_id"]).select("doc_id", fold("doc_id", 3, 1).alias("held_out"), "lang_pred", "score", "rejected")
