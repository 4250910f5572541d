"""Approximate nearest neighbours by cross-polytope hashing with multiprobe and exact reranking.

Each of TABLES hash tables turns a unit vector by random signs and a fast Hadamard transform (three
rounds) and assigns it to the nearest signed axis; it does so with several rotations side by side,
and the axes together are the vector's cell.  The number of rotations grows with the logarithm of
the number of vectors (rotations()), so cells get finer as the index grows.  A query probes in
every table the cells whose axes lie nearest to it, by the sum of its coordinates there; how many
falls as a share of all cells (probes()), so the share of the vectors that a query is compared with
falls as the index grows.  What lies in a probed cell is scored exactly, in double precision, on
the original vectors.  For vectors of unequal length one coordinate is added that makes them all
equally long (and 0 in queries), so the nearest direction is the largest inner product.

Equal vectors are one entry of the index, with its smallest ids: copies cost nothing and crowd
nobody out.  Cells that begin with the same axes travel together, in groups that are cut into
blocks of bounded size on both sides, so a hot cell is many tasks.  Queries that find fewer
neighbours than asked for while more exist are compared with all vectors, block by block.

Defined results: a vector that is null, empty, zero or holds a null or non-finite component, or
that has no id, takes no part; only vectors of as many components are compared; of rows with the
same id none is a neighbour of another; ties go to the smaller id; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpointed, few, python_ready, table

TABLES, NEIGHBOURS = 12, 20
#: Bytes of the vectors, and of the queries, that one block holds as double numbers.
BLOCK_BYTES = 32 << 20
#: Share of the cells that a query probes among 500 vectors; it falls by this power of their number,
#: and by that factor with each rotation beyond two.  Chosen on independent normal vectors, the hardest.
SHARE, FALL, FINER = 0.6, 0.36, 0.6
#: Vectors of unequal length take this many times the probes: the added coordinate separates them less well.
UNEQUAL = 2.5
#: Norms that differ by less than this share count as equal.
EQUAL_NORMS = 1e-3


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of each row, scaled to keep lengths; the width is a power of two."""
    n, d = x.shape
    h = 1
    while h < d:
        x = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack((x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]), axis=2).reshape(n, d)
        h *= 2
    return x / np.sqrt(d)


def rotated(x: np.ndarray, t: int) -> np.ndarray:
    """x under pseudo-rotation number t, padded to a power of two."""
    d = 1 << max(1, (x.shape[1] - 1).bit_length())
    y = np.zeros((len(x), d))
    y[:, : x.shape[1]] = x
    signs = np.random.default_rng([20240607, t, d]).choice([-1.0, 1.0], (3, d))
    for s in signs:
        y = hadamard(y * s)
    return y


def rotations(n: int) -> int:
    """How many rotations make up a cell: two up to a million vectors, three up to a hundred million, and so on."""
    return max(2, math.ceil(math.log(max(n, 2) / 64, 128)))


def probes(n: int, axes: int, k: int, unequal: bool = False) -> int:
    """How many of the axes^k cells of a table a query probes among n vectors."""
    share = SHARE * (500 / max(n, 500)) ** FALL * FINER ** (k - 2) * (UNEQUAL if unequal else 1)
    return max(1, min(axes**k, math.ceil(share * axes**k / TABLES)))


def _axes(x: np.ndarray, t: int, k: int) -> list[np.ndarray]:
    """The rows' coordinates along every signed axis of table t's rotations: 2 axis + sign."""
    out = []
    for j in range(k):
        y = rotated(x, 64 * t + j)
        out.append(np.stack((y, -y), axis=2).reshape(len(y), -1))
    return out


def cells(x: np.ndarray, t: int, k: int) -> np.ndarray:
    """The cell of each row in table t: its nearest signed axis under each of k rotations, as one number."""
    cell = np.zeros(len(x), dtype=np.int64)
    for y in _axes(x, t, k):
        cell = cell * y.shape[1] + y.argmax(1)
    return cell


def probed(x: np.ndarray, t: int, k: int, n: int) -> np.ndarray:
    """The n cells of table t nearest to each row (rows x n): the largest sums of k coordinates.

    Cells of the best sums over the first rotations alone can lead to the best over all.
    """
    first, *rest = _axes(x, t, k)
    axes = first.shape[1]
    m = min(n, axes)
    cell = np.argpartition(-first, m - 1, axis=1)[:, :m]
    total = np.take_along_axis(first, cell, 1)
    for y in rest:
        sums = (total[:, :, None] + y[:, None, :]).reshape(len(x), -1)
        m = min(n, sums.shape[1])
        best = np.argpartition(-sums, m - 1, axis=1)[:, :m]
        total = np.take_along_axis(sums, best, 1)
        cell = np.take_along_axis(cell, best // axes, 1) * axes + best % axes
    return cell


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _unit(x: np.ndarray, longest: float | None, query: bool) -> np.ndarray:
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    if longest is not None:
        x = np.hstack((x, np.zeros_like(norm) if query else np.sqrt(np.maximum(longest**2 - norm**2, 0))))
        norm = np.linalg.norm(x, axis=1, keepdims=True)
    return x / norm


def coded(rows: DataFrame, longest: float | None, n: int, query: bool, k: int | None = None) -> DataFrame:
    """(id, emb, key, cells): a row for each table and group that a vector lies in or a query probes.

    longest: the largest norm, if norms differ; n: the number of vectors; cells: the vector's cell,
    or the probed ones of the group.
    """
    python_ready(rows.sparkSession)
    schema = rows.select("id", "emb").schema.add("key", "long").add("cells", T.ArrayType(T.LongType()))
    k = k or rotations(n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, emb = b.column(0), b.column(1)
            sizes = np.diff(emb.offsets.to_numpy())
            for size in np.unique(sizes):
                every = np.flatnonzero(sizes == size)
                for cut in range(0, len(every), 64 if query else 4096):
                    at = pa.array(every[cut : cut + (64 if query else 4096)])
                    e, i = emb.take(at), ids.take(at)
                    x = _unit(_matrix(e), longest, query)
                    axes = 2 << max(1, (x.shape[1] - 1).bit_length())
                    # Cells that share their first axes are a group; of as many as hold half a block of vectors.
                    together = axes * max(1, min(axes ** (k - 1), BLOCK_BYTES // (16 * int(size)) * axes ** (k - 1) // max(n, 1)))
                    for t in range(TABLES):
                        c = np.sort(probed(x, t, k, probes(n, axes, k, longest is not None)), axis=1) if query else cells(x, t, k)[:, None]
                        group = c // together
                        new = np.ones(c.shape, dtype=bool)
                        new[:, 1:] = group[:, 1:] != group[:, :-1]
                        row = pa.array(np.nonzero(new)[0])
                        starts = np.append(np.flatnonzero(new.reshape(-1)), c.size).astype(np.int32)
                        # One number for components, table and group; components and groups are mixed in, as both may be many.
                        key = group.reshape(-1)[starts[:-1]] * TABLES + t
                        key = key * 1_000_003 + int(size)
                        lists = pa.ListArray.from_arrays(pa.array(starts), pa.array(c.reshape(-1)))
                        for part in range(0, len(row), 2048):
                            r = row.slice(part, 2048)
                            yield pa.RecordBatch.from_arrays([i.take(r), e.take(r), pa.array(key[part : part + 2048]), lists.slice(part, 2048)], names=["id", "emb", "key", "cells"])

    return rows.select("id", "emb").mapInArrow(run, schema)


_FOUND = pa.schema([("query", pa.int64()), ("id", pa.int64()), ("score", pa.float64())])


def _block_scores(k: int):
    """The k nearest of the vectors of a block in each query's cells; of all of them if it has no cells."""

    def run(queries: pa.Table, vectors: pa.Table) -> pa.Table:
        if not queries.num_rows or not vectors.num_rows:
            return _FOUND.empty_table()
        q, v = (_matrix(t.column("emb").combine_chunks()) for t in (queries, vectors))
        qid, vid = (t.column("id").to_numpy() for t in (queries, vectors))
        whole = queries.column("cells").null_count == queries.num_rows
        if whole:
            v_cell, wanted, ends = np.zeros(len(v), dtype=np.int64), np.zeros(len(q), dtype=np.int64), np.arange(len(q) + 1)
        else:
            v_cell = vectors.column("cells").combine_chunks().flatten().to_numpy()
            lists = queries.column("cells").combine_chunks()
            wanted, ends = lists.flatten().to_numpy(), np.append(0, np.cumsum(lists.value_lengths().to_numpy()))
        order = np.argsort(v_cell, kind="stable")
        v, vid, v_cell = v[order], vid[order], v_cell[order]
        begin, end = np.searchsorted(v_cell, wanted, "left"), np.searchsorted(v_cell, wanted, "right")
        size = end - begin
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for i in range(len(q)):
            lo, n = begin[ends[i] : ends[i + 1]], size[ends[i] : ends[i + 1]]
            total = int(n.sum())
            if not total:
                continue
            at = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(total)  # the vectors of its cells, which lie side by side
            s = (v[at] * q[i]).sum(1)  # in the same order for each row, so that finds in several tables are equal to the last bit
            if total > k:
                best = np.flatnonzero(s >= np.partition(s, total - k)[total - k])
                at, s = at[best], s[best]
            top = np.lexsort((vid[at], -s))[:k]  # ties keep the smaller id
            out.append((np.full(len(top), qid[i]), vid[at[top]], s[top]))
        if not out:
            return _FOUND.empty_table()
        return pa.table([np.concatenate(c) for c in zip(*out, strict=True)], schema=_FOUND)

    return run


def _nearest(found: DataFrame, k: int) -> DataFrame:
    """(query, id, score): each query's k nearest; the same neighbour found in several tables counts once.

    dense_rank gives equal finds one rank, so every task keeps k neighbours a query before the shuffle.
    """
    by = Window.partitionBy("query").orderBy(F.col("score").desc(), "id")
    return found.withColumn("r", F.dense_rank().over(by)).filter(F.col("r") <= k).select("query", "id", "score").distinct()


def _by_blocks(qs: DataFrame, vs: DataFrame, k: int) -> DataFrame:
    """The finds of queries (id, emb, key, cells) among the vectors of the same key, block by block."""
    n_blocks = F.ceil(F.sum(F.size("emb").cast("long")) * 8 / BLOCK_BYTES).cast("int")
    q_blocks, v_blocks = (rows.groupBy("key").agg(n_blocks.alias(c)) for rows, c in ((qs, "qb"), (vs, "vb")))
    blocks = few(checkpointed(q_blocks.join(v_blocks, "key")))
    spread: dict[str, Column] = {n: F.pmod(F.xxhash64("id", F.lit(7)), F.col(n)).cast("int") for n in ("qb", "vb")}
    qs = qs.join(blocks, "key").select("id", "emb", "cells", "key", spread["qb"].alias("q"), F.explode(F.sequence(F.lit(0), F.col("vb") - 1)).alias("v"))
    vs = vs.join(blocks, "key").select("id", "emb", "cells", "key", F.explode(F.sequence(F.lit(0), F.col("qb") - 1)).alias("q"), spread["vb"].alias("v"))
    found = qs.groupBy("key", "q", "v").cogroup(vs.groupBy("key", "q", "v")).applyInArrow(_block_scores(k), "query long, id long, score double")
    return _nearest(found, k)


def nearest_entries(queries: DataFrame, entries: DataFrame, longest: float | None, k: int, n: int, rotations_: int | None = None) -> DataFrame:
    """(query, id, score): up to k nearest index entries found for each query vector.

    queries, entries: (id, emb); n: the number of entries.
    """
    return _by_blocks(coded(queries, longest, n, True, rotations_), coded(entries, longest, n, False, rotations_), k)


def nearest_of_all(queries: DataFrame, entries: DataFrame, k: int) -> DataFrame:
    """(query, id, score): the k nearest of all entries of as many components, for the queries that the tables fail."""
    none = F.lit(None).cast("array<long>")
    parts = [rows.select(F.col("id").alias("id"), F.col("emb").alias("emb"), F.size("emb").cast("long").alias("key"), none.alias("cells")) for rows in (queries, entries)]
    return _by_blocks(*parts, k)


def search(vectors: DataFrame, is_query: Column, k: int = NEIGHBOURS, id_col: str = "vec_id", emb_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found for each row that is_query marks."""
    rows = vectors.filter(is_query.isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(emb_col).alias("emb"), is_query.alias("asks"))
    finite = F.forall("emb", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.filter(F.col("id").isNotNull() & F.col("emb").isNotNull() & (F.size("emb") > 0) & finite & F.exists("emb", lambda x: x != 0))
    rows = rows.withColumn("h", F.xxhash64("emb")).withColumn("g", F.xxhash64(F.lit(77), "emb"))
    same = Window.partitionBy("h", "g").orderBy("id")
    first = rows.withColumn("n", F.row_number().over(same)).filter(F.col("n") <= k + 1)  # limited before the shuffle too
    entries = checkpointed(first.groupBy("h", "g").agg(F.min("id").alias("id"), F.sort_array(F.collect_set("id")).alias("ids"), F.first("emb").alias("emb")))
    norm = F.sqrt(F.aggregate("emb", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    low, high, n = entries.agg(F.min(norm), F.max(norm), F.count(F.lit(1))).first()
    longest = None if high is None or high - low <= EQUAL_NORMS * high else float(high)

    asks = checkpointed(rows.filter("asks").select(F.col("id").alias("query_id"), "h", "g").distinct())
    shapes = entries.join(asks.select("h", "g").distinct(), ["h", "g"], "left_semi")
    found = checkpointed(nearest_entries(shapes.select("id", "emb"), entries.select("id", "emb"), longest, k + 1, n))
    # Every row of a found entry is a neighbour; an entry's ids suffice for k of them.
    got = found.join(entries.select("id", "ids"), "id")
    total = got.groupBy("query").agg(F.sum(F.size("ids")).alias("n"))
    sizes = rows.groupBy(F.size("emb").alias("d")).agg(F.count(F.lit(1)).alias("all_rows"))
    short = shapes.join(total, shapes.id == total.query, "left").join(few(checkpointed(sizes)), F.size("emb") == F.col("d"))
    short = checkpointed(short.filter(F.coalesce("n", F.lit(0)) < F.least(F.lit(k + 1), F.col("all_rows"))).select("id", "emb"))
    if not short.isEmpty():
        more = checkpointed(nearest_of_all(short, entries.select("id", "emb"), k + 1))
        found = found.join(short.select(F.col("id").alias("query")), "query", "left_anti").unionByName(more)
        got = found.join(entries.select("id", "ids"), "id")
    lists = got.select("query", F.explode("ids").alias("vec_id"), "score")
    by = Window.partitionBy("query").orderBy(F.col("score").desc(), "vec_id")
    lists = lists.withColumn("r", F.row_number().over(by)).filter(F.col("r") <= k + 1)
    lists = lists.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("r", "vec_id", "score"))).alias("all"))
    out = asks.join(shapes.select("h", "g", F.col("id").alias("query")), ["h", "g"]).join(lists, "query")
    own = F.slice(F.filter("all", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    return out.select("query_id", F.posexplode(own).alias("p", "x")).select("query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))


def op4_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
