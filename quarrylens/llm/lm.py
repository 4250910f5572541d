"""Stupid-backoff language-model scores from relational n-gram count tables.

The n-grams of all documents are exploded to a relation (block, bucket, n-gram, count): a document
lies in a block, an n-gram in a bucket, each by a hash.  Equal n-grams of a block are combined
before they are shuffled, so one that every document holds is one entry a block and no bucket is
hot.  Grouped by bucket they are summed to count tables, partitioned by hash; the tables are joined
with the exploded n-grams on bucket and n-gram, and the totals go back to the blocks, where every
word is scored and the logarithms are summed per document.

Rows are narrow and many (three n-grams a word), so the entries of one block and bucket travel as
one packed row: sorted codes as differences in byte planes, compressed.  One row an n-gram and
document would be 324 million rows of 24 bytes for 0.5 GB of documents, 15 times the input.  Packed
rows are never more than the n-grams of the blocks.

Counts leave out the document that is scored (its own n-grams don't vouch for it).  A word's score
is c(w1 w2 w3) / c(w1 w2) if the trigram occurs elsewhere, else BACKOFF x c(w2 w3) / c(w2), else
BACKOFF^2 x c(w3) / N, where a word that occurs nowhere else counts half; N is the number of words
elsewhere.  The first two words have shorter contexts and no penalty for it.

Within its bucket an n-gram is a code of CODE_BITS bits; bucket and code come from different mixes
of a 64-bit hash.  Buckets are sized by characters: BUCKET_CHARS of text have at most 6 million
n-grams, among which 0.001 pairs are expected to share a code, whatever the size of the corpus.

Defined results: a text that is null or without a word has 0 words, score 0 and a null mean; rows
with a null or repeated doc_id are scored each on its own, leaving out its own counts; ties and
order play no part; very long texts are read whole, a block holds at least one; an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import few, odd_rows, python_ready, table
from .text import code_points, mix, word_hashes

ORDER = 3
BACKOFF = 0.4
#: Characters of text that a block holds, on average, and whose n-grams a bucket holds: both grow in number, not in size.
BLOCK_CHARS, BUCKET_CHARS = 6 << 20, 4 << 20
CODE_BITS = 54
#: Equal rows that are spread over so many parts at a time.
PORTION = 1_000

_U = np.uint64
_SALT = [_U(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]
_BUCKET_SALT = _U(0xE7037ED1A0B428DB)


def grams(text: str, order: int) -> list[np.ndarray]:
    """Hashes of the n-grams of orders 1 to order, each at the position of its last word."""
    words = word_hashes(code_points(text.lower()))[0]
    out = [mix(words + _SALT[0])]
    for k in range(1, order):
        out.append(mix(out[k - 1][:-1] * _SALT[k] + words[k:]) if len(words) > k else np.empty(0, dtype=_U))
    return out


class Block:
    """The n-grams of some texts: the different ones, each text's share of them, and where they occur.

    values: sorted hashes; counts: how often each occurs; at: of each text and order the positions'
    places in values.
    """

    def __init__(self, texts: list[str], order: int):
        own = [grams(t, order) for t in texts]
        parts = [g for o in own for g in o]
        every = np.concatenate([np.empty(0, dtype=_U), *parts])
        self.n_words = [len(o[0]) for o in own]
        self.values, places, self.counts = np.unique(every, return_inverse=True, return_counts=True)
        ends = np.cumsum([len(g) for g in parts])
        cut = np.split(places.astype(np.int32), ends[:-1]) if parts else []
        self.at = [cut[i * order : (i + 1) * order] for i in range(len(texts))]

    def scores(self, totals: np.ndarray, all_words: int) -> list[tuple[int, float]]:
        """(words, summed natural logarithm of the scores) of each text, leaving out its own counts; totals: of values."""
        out = []
        mine = np.zeros(len(self.values), dtype=np.int64)
        for n, at in zip(self.n_words, self.at, strict=True):
            if not n:
                out.append((0, 0.0))
                continue
            for a in at:
                np.add.at(mine, a, 1)
            left = [totals[a] - mine[a] for a in at]  # counts elsewhere, at each position
            for a in at:
                mine[a] = 0
            score = np.maximum(left[0], 0.5) / max(all_words - n, 1)
            for k in range(1, len(at)):
                if n > k:
                    context = left[k - 1][:-1]
                    seen = (left[k] > 0) & (context > 0)
                    score[k:] = np.where(seen, left[k] / np.maximum(context, 1), BACKOFF * score[k:])
            out.append((n, float(np.log(score).sum())))
        return out


def bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(hashes ^ _BUCKET_SALT) % _U(buckets)).astype(np.int64)


def codes(hashes: np.ndarray) -> np.ndarray:
    return hashes >> _U(64 - CODE_BITS)


_ZSTD = pa.Codec("zstd", 1)


def pack_numbers(x: np.ndarray) -> bytes:
    """64-bit numbers as eight byte planes, each compressed by itself: small numbers leave planes of zeros."""
    planes = np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    used = 8
    while used and not planes[used - 1].any():
        used -= 1
    parts = [len(x).to_bytes(4, "little"), bytes([used])]
    for p in planes[:used]:
        small = _ZSTD.compress(p.tobytes(), asbytes=True)
        parts += [len(small).to_bytes(4, "little"), small]
    return b"".join(parts)


def unpack_numbers(b: bytes) -> np.ndarray:
    n, used, at = int.from_bytes(b[:4], "little"), b[4], 5
    planes = np.zeros((8, n), dtype=np.uint8)
    for k in range(used):
        size = int.from_bytes(b[at : at + 4], "little")
        planes[k] = np.frombuffer(_ZSTD.decompress(b[at + 4 : at + 4 + size], decompressed_size=n), dtype=np.uint8)
        at += 4 + size
    return np.ascontiguousarray(planes.T).view("<u8").reshape(-1)


def sum_lists(lists: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """(sorted codes, summed counts) of lists (codes, counts)."""
    every = np.concatenate([np.empty(0, dtype=_U), *(c for c, _ in lists)])
    counts = np.concatenate([np.empty(0, dtype=np.int64), *(n.astype(np.int64) for _, n in lists)])
    order = np.argsort(every, kind="stable")
    every = every[order]
    first = np.flatnonzero(np.concatenate((np.ones(min(1, len(every)), dtype=bool), every[1:] != every[:-1])))
    return every[first], np.add.reduceat(counts[order], first) if len(first) else counts


_LISTED = pa.schema([("block", pa.int64()), ("bucket", pa.int64()), ("codes", pa.binary()), ("counts", pa.binary())])
_TABLE = pa.schema([("bucket", pa.int64()), ("codes", pa.binary()), ("counts", pa.binary())])
_TOTALS = pa.schema([("block", pa.int64()), ("bucket", pa.int64()), ("others", pa.binary())])
_SCORED = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("log_score", pa.float64())])
#: The bucket of an entry that counts the words of a block.
WORDS = -1


def _rows(schema: pa.Schema, rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) or [()] * len(schema)
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _lists(group: pa.Table) -> list[tuple[np.ndarray, np.ndarray]]:
    return [(np.cumsum(unpack_numbers(c), dtype=_U), unpack_numbers(n)) for c, n in zip(group.column("codes").to_pylist(), group.column("counts").to_pylist(), strict=True)]


def exploded_ngrams(dealt: DataFrame, order: int, buckets: int) -> DataFrame:
    """(block, bucket, codes, counts): the n-grams of the texts of each block, by bucket; dealt: (doc_id, text, block)."""

    def explode(group: pa.Table) -> pa.Table:
        number = group.column("block")[0].as_py()
        block = Block(group.column("text").to_pylist(), order)
        bucket = bucket_of(block.values, buckets)
        by_bucket = np.argsort(bucket, kind="stable")  # keeps the hashes sorted within
        ends = np.cumsum(np.bincount(bucket, minlength=buckets))
        rows = [(number, WORDS, pack_numbers(np.zeros(1)), pack_numbers(np.array([sum(block.n_words)])))]
        for k, (a, b) in enumerate(zip(np.append(0, ends[:-1]), ends, strict=True)):
            if b > a:
                at = by_bucket[a:b]
                rows.append((number, k, pack_numbers(np.diff(codes(block.values[at]), prepend=_U(0))), pack_numbers(block.counts[at])))
        return _rows(_LISTED, rows)

    return dealt.groupBy("block").applyInArrow(explode, "block long, bucket long, codes binary, counts binary")


def count_tables(listed: DataFrame) -> DataFrame:
    """(bucket, codes, counts): how often each n-gram occurs in all blocks, partitioned by hash."""

    def add(group: pa.Table) -> pa.Table:
        values, counts = sum_lists(_lists(group))
        return _rows(_TABLE, [(group.column("bucket")[0].as_py(), pack_numbers(np.diff(values, prepend=_U(0))), pack_numbers(counts))])

    return listed.groupBy("bucket").applyInArrow(add, "bucket long, codes binary, counts binary")


def joined_counts(listed: DataFrame) -> DataFrame:
    """(block, bucket, others): each block's n-grams joined with the count tables on bucket and n-gram; others: counts in other blocks.

    The table of a bucket is summed where its n-grams lie, so the join needs no second shuffle.
    """

    def join(group: pa.Table) -> pa.Table:
        lists = _lists(group)
        values, counts = sum_lists(lists)
        rows = [(block, bucket, pack_numbers(counts[np.searchsorted(values, own)] - n.astype(np.int64))) for block, bucket, (own, n) in zip(group.column("block").to_pylist(), group.column("bucket").to_pylist(), lists, strict=True)]
        return _rows(_TOTALS, rows)

    return listed.groupBy("bucket").applyInArrow(join, "block long, bucket long, others binary")


def _dealt(docs: DataFrame, blocks: int) -> DataFrame:
    """(doc_id, text, block) of every row: by a hash of id and text.

    Equal rows under a null or repeated doc_id are counted and dealt out again by their number.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    place = lambda *c: F.pmod(F.xxhash64("doc_id", "text", *c), F.lit(blocks)).alias("block")
    odd = odd_rows(own, "doc_id")
    if odd.isEmpty():
        return own.select("doc_id", "text", place())
    odd, same = few(odd), F.col("doc_id").eqNullSafe(F.col("odd_id"))
    several = own.join(odd, same, "left_semi").groupBy("doc_id", "text").agg(F.count(F.lit(1)).alias("m"))
    portions = several.withColumn("portion", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("m") - 1) / PORTION)))).repartition("doc_id", "portion")
    rank: Column = F.explode(F.sequence(F.col("portion") * PORTION, F.least(F.col("m"), (F.col("portion") + 1) * PORTION) - 1))
    ranked = portions.withColumn("rank", rank)
    return own.join(odd, same, "left_anti").select("doc_id", "text", place()).unionByName(ranked.select("doc_id", "text", place(F.col("rank"))))


def backoff_scores(docs: DataFrame, order: int = ORDER, n_chars: int | None = None) -> DataFrame:
    """(doc_id, n_words, log_score, mean_log_score) of every row."""
    python_ready(docs.sparkSession)
    if n_chars is None:
        n_chars = docs.agg(F.sum(F.char_length("text"))).first()[0] or 0
    buckets = max(1, -(-n_chars // BUCKET_CHARS))
    dealt = _dealt(docs, max(1, -(-n_chars // BLOCK_CHARS)))
    listed = exploded_ngrams(dealt, order, buckets)
    others = joined_counts(listed)

    def score(texts: pa.Table, found: pa.Table) -> pa.Table:
        block = Block(texts.column("text").to_pylist(), order)
        parts = {k: unpack_numbers(t).astype(np.int64) for k, t in zip(found.column("bucket").to_pylist(), found.column("others").to_pylist(), strict=True)}
        counts = block.counts.astype(np.int64)
        by_bucket = np.argsort(bucket_of(block.values, buckets), kind="stable")
        counts[by_bucket] += np.concatenate([np.empty(0, dtype=np.int64), *(parts[k] for k in sorted(parts) if k != WORDS)])
        scored = block.scores(counts, int(parts[WORDS][0]) + sum(block.n_words))
        return pa.Table.from_arrays([texts.column("doc_id"), pa.array([s[0] for s in scored], pa.int64()), pa.array([s[1] for s in scored], pa.float64())], schema=_SCORED)

    scored = dealt.groupBy("block").cogroup(others.groupBy("block")).applyInArrow(score, "doc_id long, n_words long, log_score double")
    return scored.withColumn("mean_log_score", F.when(F.col("n_words") > 0, F.col("log_score") / F.col("n_words")))


def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = backoff_scores(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", F.round("log_score", 4).alias("log_score"), F.round("mean_log_score", 6).alias("mean_log_score"))


OP5_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+') AS a FROM documents),
p AS (SELECT doc_id, unnest(a) AS w3, unnest(range(1, len(a) + 1)) AS i FROM w),
g AS (SELECT doc_id, i, w3, lag(w3) OVER d AS w2, lag(w3, 2) OVER d AS w1 FROM p WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
k AS (SELECT doc_id, i, w3 AS g1, w2 || ' ' || w3 AS g2, w1 || ' ' || w2 || ' ' || w3 AS g3, w2 AS c1, w1 || ' ' || w2 AS c2 FROM g),
n1 AS (SELECT g1 AS g, count(*) AS n FROM k GROUP BY 1), n2 AS (SELECT g2 AS g, count(*) AS n FROM k WHERE g2 IS NOT NULL GROUP BY 1),
n3 AS (SELECT g3 AS g, count(*) AS n FROM k WHERE g3 IS NOT NULL GROUP BY 1),
o1 AS (SELECT doc_id, g1 AS g, count(*) AS n FROM k GROUP BY ALL), o2 AS (SELECT doc_id, g2 AS g, count(*) AS n FROM k WHERE g2 IS NOT NULL GROUP BY ALL),
o3 AS (SELECT doc_id, g3 AS g, count(*) AS n FROM k WHERE g3 IS NOT NULL GROUP BY ALL),
l1 AS (SELECT o1.doc_id, o1.g, n1.n - o1.n AS n FROM o1 JOIN n1 USING (g)), l2 AS (SELECT o2.doc_id, o2.g, n2.n - o2.n AS n FROM o2 JOIN n2 USING (g)),
l3 AS (SELECT o3.doc_id, o3.g, n3.n - o3.n AS n FROM o3 JOIN n3 USING (g)),
t AS (SELECT doc_id, count(*) AS own FROM k GROUP BY 1),
s AS (SELECT k.doc_id, CASE WHEN k.g3 IS NOT NULL AND a3.n > 0 AND b2.n > 0 THEN a3.n / CAST(b2.n AS DOUBLE)
    ELSE (CASE WHEN k.g3 IS NOT NULL THEN 0.4 ELSE 1.0 END) * (CASE WHEN k.g2 IS NOT NULL AND a2.n > 0 AND b1.n > 0 THEN a2.n / CAST(b1.n AS DOUBLE)
      ELSE (CASE WHEN k.g2 IS NOT NULL THEN 0.4 ELSE 1.0 END) * greatest(a1.n, 0.5) / greatest((SELECT count(*) FROM k) - t.own, 1) END) END AS s
  FROM k JOIN t ON t.doc_id = k.doc_id JOIN l1 a1 ON a1.doc_id = k.doc_id AND a1.g = k.g1 LEFT JOIN l2 a2 ON a2.doc_id = k.doc_id AND a2.g = k.g2
  LEFT JOIN l3 a3 ON a3.doc_id = k.doc_id AND a3.g = k.g3 LEFT JOIN l1 b1 ON b1.doc_id = k.doc_id AND b1.g = k.c1 LEFT JOIN l2 b2 ON b2.doc_id = k.doc_id AND b2.g = k.c2),
r AS (SELECT doc_id, count(*) AS n_words, sum(ln(s)) AS log_score FROM s GROUP BY 1)
SELECT d.doc_id, coalesce(r.n_words, 0) AS n_words, round(coalesce(r.log_score, 0.0), 4) AS log_score, round(r.log_score / r.n_words, 6) AS mean_log_score
FROM documents d LEFT JOIN r ON r.doc_id = d.doc_id
"""
