"""Hierarchical multi-length packing of documents into training sequences.

Every document becomes token ids and an end id.  Its full windows of the longest context are
sequences as they are; what remains is routed to the smallest context tier that holds it.  Tiers
are packed from the longest down: each remainder opens a window of its tier, and the window's gap
is filled with the largest fitting pieces of shorter tiers, the last one cut to fit.  So a window
is exactly its tier long, a power of two, and needs no padding.  Sequences are then dealt to step
groups of even token counts.

Packing streams over each input partition in groups of GROUP_TOKENS ids, so nothing is shuffled
and memory is bounded by a group and one document.  Sequence ids carry the partition number.  Step
groups are balanced within such a group of one partition, not across the table.

Defined results: a null text counts as an empty one and yields the end id alone; rows with a
repeated or null doc_id are packed as documents of their own; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

import heapq
import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import VOCABULARY, bpe
from .common import python_ready, table

#: Tiers below 64 take only a group's last rest, which so needs no padding either.
TIERS = (1024, 512, 256, 128, 64, 32, 16, 8, 4, 2, 1)
GROUP_TOKENS = 1 << 20
STEP_TOKENS = 1 << 16
END_ID = 0

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_group long"

Piece = tuple[int, int, int]  # length, document number, start


def pack_lengths(lengths: list[int], tiers: tuple[int, ...] = TIERS) -> list[list[Piece]]:
    """Sequences of pieces: every id of every document in exactly one piece.

    All sequences are as long as one of the tiers but for at most one short rest.
    """
    top = tiers[0]
    done: list[list[Piece]] = []
    rest: list[Piece] = []
    for doc, n in enumerate(lengths):
        full = n - n % top
        done += [[(top, doc, at)] for at in range(0, full, top)]
        if n > full:
            rest.append((n - full, doc, full))
    rest.sort()
    tail: list[Piece] = []
    while rest:
        head = rest.pop()
        tier = min(t for t in tiers if t >= head[0])
        window, gap = [head], tier - head[0]
        while gap and rest:
            at = bisect_right(rest, (gap, 1 << 62, 0)) - 1
            if at >= 0:
                piece = rest.pop(at)
            else:  # nothing fits whole: cut the shortest there is
                n, doc, start = rest.pop(0)
                piece = (gap, doc, start)
                insort(rest, (n - gap, doc, start + gap))
            window.append(piece)
            gap -= piece[0]
        if gap:
            tail = window
        else:
            done.append(window)
    return done + _spread(tail, tiers)


def _spread(pieces: list[Piece], tiers: tuple[int, ...]) -> list[list[Piece]]:
    """Deal out what is left to windows of the largest tiers that it fills, and one short rest."""
    left = sum(n for n, _, _ in pieces)
    queue = pieces[::-1]
    out = []
    while left:
        want = next((t for t in tiers if t <= left), left)
        window = []
        gap = want
        while gap:
            n, doc, start = queue.pop()
            take = min(n, gap)
            window.append((take, doc, start))
            if n > take:
                queue.append((n - take, doc, start + take))
            gap -= take
        out.append(window)
        left -= want
    return out


def step_groups(sizes: list[int], step_tokens: int = STEP_TOKENS) -> list[int]:
    """A step number for each sequence, so that the steps' token counts are even: largest first, to the emptiest."""
    steps = max(1, -(-sum(sizes) // step_tokens))
    heap = [(0, s) for s in range(steps)]
    out = [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        load, s = heapq.heappop(heap)
        out[i] = s
        heapq.heappush(heap, (load + sizes[i], s))
    return out


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, tiers: tuple[int, ...] = TIERS) -> DataFrame:
    """One row a piece of a document; see SCHEMA."""
    python_ready(docs.sparkSession)
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = bpe(vocabulary)
        base = TaskContext.get().partitionId() << 36
        sequence, step = base, base
        ids: list[np.ndarray] = []
        keys: list[int | None] = []
        size = 0

        def close() -> pa.RecordBatch:
            nonlocal sequence, step, size
            windows = pack_lengths([len(x) for x in ids], tiers)
            sizes = [sum(p[0] for p in w) for w in windows]
            steps = step_groups(sizes)
            rows: list[list] = [[] for _ in names]
            for w, tokens, s in zip(windows, sizes, steps, strict=True):
                offset = 0
                tier = next((t for t in reversed(tiers) if t >= tokens), tiers[0]) if tokens & (tokens - 1) == 0 else tiers[0]
                for n, doc, start in w:
                    crc = zlib.crc32(ids[doc][start : start + n])
                    for col, v in zip(rows, (keys[doc], start, n, crc, len(ids[doc]), sequence, offset, tier, step + s), strict=True):
                        col.append(v)
                    offset += n
                sequence += 1
            step += max(steps, default=-1) + 1
            out = pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if k == "tier" else pa.int64()) for k, c in zip(names, rows, strict=True)], names=names)
            ids.clear()
            keys.clear()
            size = 0
            return out

        for b in batches:
            for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                x = np.append(coder.ids(text), np.array([END_ID], dtype="<u4")).astype("<u4")
                ids.append(x)
                keys.append(key)
                size += len(x)
                if size >= GROUP_TOKENS:
                    yield close()
        if ids:
            yield close()

    return plain.mapInArrow(run, SCHEMA)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
