"""Shared plumbing of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..storage import checkpointed, python_ready, shared_folder

__all__ = ["all_columns", "bounded_sample", "checkpointed", "few", "filtered_texts", "fold", "id_crc", "mapped_texts", "odd_rows", "python_ready", "shared_folder", "table"]

#: Up to this many rows of a few numbers each (some 30 MB) are broadcast; more go by shuffle joins.
BROADCAST_ROWS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def few(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df (narrow, cheap to compute), marked for broadcast if its rows are counted and within the limit."""
    return F.broadcast(df) if df.count() <= limit else df


def all_columns(df: DataFrame, *more: Column) -> DataFrame:
    """df's columns under names of our own (_k0, _k1, ...), so that none can clash with added ones, and more."""
    return df.select(*(F.col(f"`{c}`").alias(f"_k{i}") for i, c in enumerate(df.columns)), *more)


def odd_rows(docs: DataFrame, id_col: str) -> DataFrame:
    """(odd_id) of each id that is null or occurs again, checkpointed; for most tables there is none.

    Ids alone are shuffled, combined before that, so a repeated id is one row a task.
    """
    sizes = docs.groupBy(F.col(f"`{id_col}`").alias("odd_id")).agg(F.count(F.lit(1)).alias("n"))
    return checkpointed(sizes.filter("n > 1 or odd_id is null").select("odd_id"))


def id_crc(column: str = "doc_id") -> Column:
    """crc32 of an id written as text: what the train and held-out folds are cut by."""
    return F.crc32(F.col(column).cast("string").cast("binary"))


def fold(column: str, parts: int, held: int) -> Column:
    """True for held-out rows; a null id counts as held out, so it is never learned from."""
    return F.coalesce(id_crc(column) % parts == held, F.lit(True))


def bounded_sample(df: DataFrame, key: str, per_key: int, order: Column, most_keys: int = 1_000) -> DataFrame:
    """At most about per_key rows of each value of key, picked by a hash and so the same at every run.

    Counts per key come first (a combined aggregate); the sample is a hash threshold, not a
    sort of a hot key's rows, so no task has to hold one.  order must tell unlike rows apart; equal
    rows have one fate.  More values of key than most_keys are no classes to learn: an error.
    """
    counts = {r[0]: r[1] for r in df.groupBy(key).count().limit(most_keys + 1).collect()}
    if len(counts) > most_keys:
        raise ValueError(f"more than {most_keys} different values of {key} to learn")
    keep = F.lit(False)
    for value, n in sorted(counts.items(), key=lambda x: str(x[0])):
        share = min(1.0, per_key / n)
        keep = keep | (F.col(key).eqNullSafe(F.lit(value)) & (F.pmod(order, F.lit(1_000_003)) < F.lit(int(share * 1_000_003) + 1)))
    return df.filter(keep)


def mapped_texts(docs: DataFrame, keep: list[str], text_col: str, added: list[tuple[str, T.DataType]], value: Callable[[list[str | None]], list[list]]) -> DataFrame:
    """The kept columns of every row with columns made from its whole text in Python workers.

    value: texts of one batch -> one list a column of added.  Input columns travel under names of
    our own, so none can clash with the added ones; an added column replaces a kept namesake.
    """
    python_ready(docs.sparkSession)
    names = [n for n, _ in added]
    keep = [c for c in keep if c not in names]
    plain = docs.select(*(F.col(f"`{c}`").alias(f"_k{i}") for i, c in enumerate(keep)), *([] if text_col in keep else [F.col(f"`{text_col}`").alias("_text")]))
    at, width = keep.index(text_col) if text_col in keep else len(keep), len(keep)
    schema = T.StructType(plain.schema.fields[:width])
    for name, kind in added:
        schema = schema.add(name, kind)
    kinds = [to_arrow_type(kind) for _, kind in added]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = value(b.column(at).to_pylist())
            columns = [b.column(i) for i in range(width)] + [pa.array(v, k) for v, k in zip(made, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return plain.mapInArrow(run, schema).withColumnsRenamed({f"_k{i}": c for i, c in enumerate(keep)})


def filtered_texts(docs: DataFrame, text_col: str, keeps: Callable[[list[str | None]], list[bool]]) -> DataFrame:
    """The rows of docs, all columns as they are, whose whole text keeps() says to keep; nothing is added."""
    python_ready(docs.sparkSession)
    plain, at = all_columns(docs), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(keeps(b.column(at).to_pylist()), pa.bool_()))

    return plain.mapInArrow(run, plain.schema).withColumnsRenamed({f"_k{i}": c for i, c in enumerate(docs.columns)})
