"""Quality scores by Bradley-Terry ranking of preference pairs.

Each text gets a vector of shape features (repetition, symbols, case, lines, word lengths), cut
into bins.  Every pair of a good and a bad document is a preference; logistic loss on the
difference of their features learns one weight a bin, and a document's raw score is the weighted
sum.  The decision threshold is the quantile of raw scores below which, by the labelled rows'
shares, the bad ones should lie; scores are scaled so that it maps to THRESHOLD.

Fitting reads every labelled row and counts every pair.  A row becomes 20 levels (2 bytes a
feature), which stay distributed; bins, gradients and thresholds are sums over them, so the driver
gets arrays whose size doesn't depend on the number of rows.  The loss of a pair depends on the
difference of two scores alone: weights are kept on a grid, scores are then whole cells of it, and
the counts of good and bad rows a cell give the gradient of all pairs without listing any.  The
last Newton step leaves the grid.  Scoring reads every whole text and nothing but the text.

Defined results: a null text counts as an empty one, which is scored like any other; rows with a
null or repeated doc_id are scored on their own; labels that are null are ignored, an id with
several labels counts once a label, and of several texts under a labelled id the one with the
smallest features is learned from; with one class or none every score is 0.5; an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpointed, filtered_texts, fold, mapped_texts, python_ready, table
from .text import code_points

BINS = 8
#: Up to so many labels are broadcast to the texts; more meet the texts' levels in a shuffle of narrow rows.
BROADCAST_LABELS = 200_000
#: Tasks of a pass over the labelled rows' levels, each of which sends one array to the driver.
PARTS = 8
#: Cells of a histogram of scores; joint counts of cell and bin, for the curvature alone, take WIDE cells at a time.
CELLS, WIDE = 2048, 16
STEPS = 12
THRESHOLD = 0.7
L2 = 1e-3
FEATURES = (
    "log_words", "word_length", "distinct_words", "top_word", "repeats_next", "letters", "upper", "digits", "marks", "symbols",
    "words_ending_odd", "line_length", "repeated_lines", "short_lines", "stops", "upper_words", "bars", "spaces", "long_words", "runs",
)


def features(text: str) -> list[float]:
    """Shape of one whole text, each value bounded or on a log scale."""
    words = text.split()
    n = max(1, len(words))
    p = code_points(text)
    total = max(1, len(p))
    seen = np.bincount(np.minimum(p, 128), minlength=129)
    lower, upper, digits = int(seen[97:123].sum()), int(seen[65:91].sum()), int(seen[48:58].sum())
    marks = int(seen[[33, 34, 39, 44, 45, 46, 58, 59, 63]].sum())
    spaces = int(seen[[9, 10, 13, 32]].sum())
    plain = lower + upper + digits + marks + spaces + int(seen[128])
    ranked = Counter(words)
    lines = [x for x in text.split("\n") if x.strip()]
    m = max(1, len(lines))
    joined = "\n".join(words)
    odd = sum(joined.count(f"{c}\n") for c in "!#$%&*|@^~<>=+_/\\{}[]")
    up = sum(map(str.isupper, words))
    runs = int((p[1:] == p[:-1]).sum()) if len(p) > 1 else 0
    return [
        math.log1p(len(words)), math.log1p(total / n), len(ranked) / n, max(ranked.values(), default=0) / n,
        sum(map(str.__eq__, words, words[1:])) / n, (lower + upper + int(seen[128])) / total, upper / max(1, lower + upper), digits / total,
        marks / total, (total - plain) / total, odd / n, math.log1p(total / m), 1 - len(set(lines)) / m if lines else 0.0,
        sum(len(x) < 30 for x in lines) / m, (text.count(". ") + text.count(".\n")) / n, up / n, text.count("|") / n, spaces / total,
        sum(len(x) > 20 for x in words) / n, runs / total,
    ]


class QualityModel:
    def __init__(self, edges: np.ndarray, weights: np.ndarray, centre: float, scale: float):
        self.edges, self.weights, self.centre, self.scale = edges, weights, centre, scale

    def binned(self, x: np.ndarray) -> np.ndarray:
        """One-hot bins of each feature, side by side."""
        out = np.zeros((len(x), len(FEATURES) * (BINS + 1)))
        for j in range(len(FEATURES)):
            b = np.searchsorted(self.edges[j], x[:, j], side="right")
            out[np.arange(len(x)), j * (BINS + 1) + b] = 1
        return out

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.binned(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.scale:
            return np.full(len(x), 0.5)
        z = self.scale * (self.raw(x) - self.centre) + math.log(THRESHOLD / (1 - THRESHOLD))
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, share_bad: float) -> QualityModel:
        """x: features, y: labels 0/1, share_bad: share of label 0 among all labelled rows."""
        rows = levels(x)
        return fit_by(lambda part: part(rows, y), share_bad)


#: Levels are the leading bits of a feature's value, from 2^-20 (below that: 0) to 2^12, 2,048 a power of two.
_SHIFT, _LEAST = np.uint64(41), (1023 - 20) << 11


def levels(x: np.ndarray) -> np.ndarray:
    """The level of each value, rounded down."""
    bits = np.ascontiguousarray(x, dtype=np.float64).view(np.uint64) >> _SHIFT
    return np.clip(bits.astype(np.int64) - _LEAST, 0, 65535).astype(np.uint16)


def level_value(level: np.ndarray) -> np.ndarray:
    """The least value of each level."""
    bits = (level.astype(np.int64) + _LEAST).astype(np.uint64) << _SHIFT
    return np.where(level == 0, 0.0, bits.view(np.float64))


#: Sums part(levels, labels) over all portions of the labelled rows.
Total = Callable[[Callable[[np.ndarray, np.ndarray], np.ndarray]], np.ndarray]


def _reached(mass: np.ndarray, shares: np.ndarray) -> np.ndarray:
    """The first cell at which the summed mass reaches each share."""
    return np.minimum(np.searchsorted(np.cumsum(mass), shares - 1e-12), len(mass) - 1)


def _edges(total: Total, n: np.ndarray) -> np.ndarray:
    """Of each feature the levels at its BINS quantiles, both classes having equal mass: leading bytes first, then the second ones under those."""
    k, shares = len(FEATURES), np.linspace(0, 1, BINS + 2)[1:-1]

    def leading(rows: np.ndarray, y: np.ndarray) -> np.ndarray:
        at = (y[:, None] * k + np.arange(k)) * 256 + (rows >> 8)
        return np.bincount(at.ravel(), minlength=2 * k * 256).astype(float)

    mass = (total(leading).reshape(2, k, 256) / (2 * n[:, None, None])).sum(0)
    high = np.array([_reached(m, shares) for m in mass])

    def second(rows: np.ndarray, y: np.ndarray) -> np.ndarray:
        out = np.zeros((k, BINS, 2 * 256))
        for j in range(k):
            for q in range(BINS):
                own = (rows[:, j] >> 8) == high[j, q]
                out[j, q] = np.bincount(y[own] * 256 + (rows[own, j] & 255), minlength=2 * 256)
        return out.ravel()

    below = np.cumsum(mass, 1)
    low = (total(second).reshape(k, BINS, 2, 256) / (2 * n[:, None])).sum(2)
    out = np.zeros((k, BINS), dtype=np.uint16)
    for j in range(k):
        for q in range(BINS):
            before = below[j, high[j, q] - 1] if high[j, q] else 0.0
            out[j, q] = high[j, q] * 256 + _reached(low[j, q], shares[q : q + 1] - before)[0]
    return out


def _weights(total: Total, n: np.ndarray, bins: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Newton steps on the mean logistic loss of all pairs; bins: levels -> columns of the weights, one a feature."""
    k, width = len(FEATURES), len(FEATURES) * (BINS + 1)
    coarse = CELLS // WIDE + 2
    w = np.zeros(width)
    for _ in range(STEPS):
        spans = w.reshape(k, BINS + 1)
        span = float((spans.max(1) - spans.min(1)).sum())
        unit = 2.0 ** math.ceil(math.log2(max(span, 1e-3) / (CELLS - 2 * k)))
        grid = np.round(w / unit).astype(np.int64)
        low = int(grid.reshape(k, BINS + 1).min(1).sum())

        def histogram(rows: np.ndarray, y: np.ndarray, grid: np.ndarray = grid, low: int = low) -> np.ndarray:
            cell = grid[bins(rows)].sum(1) - low
            return np.bincount(y * CELLS + cell, minlength=2 * CELLS).astype(float)

        bad, good = total(histogram).reshape(2, CELLS) / n[:, None]
        lost = 1 / (1 + np.exp(np.clip(unit * (np.arange(CELLS)[:, None] - np.arange(CELLS)), -30, 30)))  # of a good cell against a bad one
        bend = lost * (1 - lost)
        # of a row in a cell: its share of the gradient and of the curvature, by label
        pull = np.stack([lost.T @ good, -(lost @ bad)]) / n[:, None]
        curve = np.stack([bend.T @ good, bend @ bad]) / n[:, None]

        def sums(rows: np.ndarray, y: np.ndarray, grid: np.ndarray = grid, low: int = low, pull: np.ndarray = pull, curve: np.ndarray = curve) -> np.ndarray:
            at = bins(rows)
            cell = grid[at].sum(1) - low
            grad = np.bincount(at.ravel(), np.repeat(pull[y, cell], k), minlength=width)
            hess = np.zeros((width, width))
            for i in range(0, len(at), 4096):
                hot = np.zeros((len(at[i : i + 4096]), width))
                np.put_along_axis(hot, at[i : i + 4096], 1.0, axis=1)
                hess += (hot * curve[y[i : i + 4096], cell[i : i + 4096], None]).T @ hot
            joint = np.bincount((((y * coarse + cell // WIDE) * width)[:, None] + at).ravel(), minlength=2 * coarse * width)
            return np.concatenate([grad, hess.ravel(), joint])

        got = total(sums)
        grad = got[:width] + L2 * unit * grid
        joint = got[width + width * width :].reshape(2, coarse, width) / n[:, None, None]
        gap = unit * WIDE * (np.arange(coarse)[:, None] - np.arange(coarse))
        p = 1 / (1 + np.exp(np.clip(gap, -30, 30)))
        cross = joint[1].T @ (p * (1 - p)) @ joint[0]
        hess = got[width : width + width * width].reshape(width, width) - cross - cross.T
        step = np.linalg.solve(hess + L2 * np.eye(width), grad)
        w = unit * grid - step
        if np.abs(step).max() < 2 * unit:
            break
    return w


def _score_quantiles(total: Total, n: np.ndarray, raw: Callable[[np.ndarray], np.ndarray], low: float, high: float, asked: list[tuple[np.ndarray, float]]) -> list[float]:
    """For each (mass of a row by label, share) the score that parts the rows of so large a share from the others: cells first, then cells within those."""
    wide = max(high - low, 1e-9) * (1 + 1e-9) / CELLS

    def first(rows: np.ndarray, y: np.ndarray) -> np.ndarray:
        cell = np.clip((raw(rows) - low) / wide, 0, CELLS - 1).astype(np.int64)
        return np.bincount(y * CELLS + cell, minlength=2 * CELLS).astype(float)

    counts = total(first).reshape(2, CELLS)
    masses = [(mass[:, None] * counts).sum(0) for mass, _ in asked]
    at = [int(_reached(m, np.array([share]))[0]) for m, (_, share) in zip(masses, asked, strict=True)]

    def within(rows: np.ndarray, y: np.ndarray) -> np.ndarray:
        place = (raw(rows) - low) / wide
        cell = np.clip(place, 0, CELLS - 1).astype(np.int64)
        out = []
        for c in at:
            own = cell == c
            fine = np.clip((place[own] - c) * CELLS, 0, CELLS - 1).astype(np.int64)
            out.append(np.bincount(y[own] * CELLS + fine, minlength=2 * CELLS).astype(float))
        return np.concatenate(out)

    fine = total(within).reshape(len(asked), 2, CELLS)
    out = []
    for i, (mass, share) in enumerate(asked):
        m = (mass[:, None] * fine[i]).sum(0)
        here = int(_reached(m, np.array([share - masses[i][: at[i]].sum()]))[0])
        later = np.flatnonzero(m[here + 1 :])
        cut = here + 1 + (float(later[0]) / 2 if len(later) else 0.0)
        out.append(low + wide * (at[i] + cut / CELLS))
    return out


def fit_by(total: Total, share_bad: float) -> QualityModel:
    """The model of all labelled rows, of which only sums over portions are asked for."""
    k = len(FEATURES)
    blank = QualityModel(np.zeros((k, BINS)), np.zeros(k * (BINS + 1)), 0.0, 0.0)
    n = total(lambda rows, y: np.bincount(y, minlength=2).astype(float))
    if not n.all():
        return blank
    cuts = _edges(total, n)

    def bins(rows: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(cuts[j], rows[:, j], side="right") + j * (BINS + 1) for j in range(k)], axis=1)

    w = _weights(total, n, bins)
    spans = w.reshape(k, BINS + 1)
    of_bad, of_good = np.array([1 / n[0], 0.0]), np.array([0.0, 1 / n[1]])
    asked = [(share_bad * of_bad + (1 - share_bad) * of_good, share_bad), (of_bad, 0.5), (of_good, 0.5)]
    centre, bad, good = _score_quantiles(total, n, lambda rows: w[bins(rows)].sum(1), float(spans.min(1).sum()), float(spans.max(1).sum()), asked)
    return QualityModel(level_value(cuts), w, centre, 8.0 / (good - bad) if good - bad > 1e-9 else 0.0)


def feature_rows(texts: list[str | None]) -> np.ndarray:
    return np.array([features(t or "") for t in texts], dtype=float).reshape(-1, len(FEATURES))


def fit_on(docs: DataFrame, labels: DataFrame) -> QualityModel:
    """Fit on all labelled rows of docs."""
    labels = labels.filter("quality in (0, 1) and doc_id is not null").select("doc_id", F.col("quality").cast("int").alias("quality")).distinct()
    shares = {r[0]: r[1] for r in labels.groupBy("quality").count().collect()}
    made = [("x", T.BinaryType())]  # big-endian, so that their order is that of the features

    def value(texts: list[str | None]) -> list[list]:
        return [[r.tobytes() for r in levels(feature_rows(texts)).astype(">u2")]]

    rows = docs.select("doc_id", "text")
    if sum(shares.values()) <= BROADCAST_LABELS:
        x = mapped_texts(rows.join(F.broadcast(labels), "doc_id"), ["doc_id", "quality"], "text", made, value)
    else:
        x = mapped_texts(rows, ["doc_id"], "text", made, value).join(labels, "doc_id")
    x = x.groupBy("doc_id", "quality").agg(F.min("x").alias("x"))  # one row an id and label, however often the id occurs
    x = checkpointed(x.select("quality", "x")).coalesce(PARTS)
    python_ready(docs.sparkSession)

    def total(part: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = None
            for b in batches:
                y = b.column(0).to_numpy().astype(np.int64)
                got = part(np.frombuffer(b"".join(b.column(1).to_pylist()), ">u2").reshape(-1, len(FEATURES)).astype(np.uint16), y)
                held = got if held is None else held + got
            if held is not None:
                yield pa.RecordBatch.from_arrays([pa.array([held.tobytes()], pa.binary())], names=["sums"])

        none = np.zeros((0, len(FEATURES)), dtype=np.uint16), np.zeros(0, dtype=np.int64)
        return sum((np.frombuffer(r.sums) for r in x.mapInArrow(run, "sums binary").collect()), part(*none))

    return fit_by(total, shares.get(0, 0) / max(1, sum(shares.values())))


def score_quality(docs: DataFrame, model: QualityModel, keep: list[str], text_col: str = "text") -> DataFrame:
    """The kept columns of every row with score and predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def value(texts: list[str | None]) -> list[list]:
        s = shared.value.score(feature_rows(texts))
        return [s.tolist(), (s >= THRESHOLD).astype(int).tolist()]

    return mapped_texts(docs, keep, text_col, [("score", T.DoubleType()), ("predicted", T.IntegerType())], value)


def at_least(docs: DataFrame, model: QualityModel, least: float, text_col: str = "text") -> DataFrame:
    """The rows whose text scores least or more, all columns as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return filtered_texts(docs, text_col, lambda texts: (shared.value.score(feature_rows(texts)) >= least).tolist())


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit_on(docs.filter(~fold("doc_id", 4, 2)), labels.filter(~fold("doc_id", 4, 2)))
    return score_quality(docs, model, ["doc_id"]).select("doc_id", fold("doc_id", 4, 2).alias("held_out"), "score", "predicted")
