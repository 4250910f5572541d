"""Document fingerprints: a canonical exact digest, built from DataFrame functions only.

The canonical form of a text is its Unicode compatibility composition (NFKC), full case
folding, composition again, every run of white space turned into one space, and trimming.
Its fingerprint is a 128-bit digest of two differently seeded xxhash64 values.  Inside each
bucket of equal digests the canonical bytes are compared; should two different canonical texts
ever share a bucket, each fingerprint there gets a suffix of its own, so equal fingerprints
always mean equal canonical bytes.

Defined results: a null text counts as an empty one; equal texts have equal fingerprints; rows
with a repeated doc_id are each kept and follow one another by a hash of their text, equal ones in
a row; a row without doc_id comes before all others; very long texts are read and edited whole; an
empty table gives an empty result; extra columns are ignored whatever their names.  The likeness of
two exact digests is 1 or 0.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, checkpointed, few, odd_rows, table

#: Ranges of rows that the neighbour window is cut into, at most about: their bounds are a constant of the plan.
MAX_CELLS = 20_000
ROWS_PER_CELL = 1_000
#: Equal rows that one task writes at a time.
PORTION = 50_000

_SECOND_SEED = 0x5DEECE66D1234567


def _compose(c: Column) -> Column:
    return F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), c, F.lit(True))


def canonical(text: Column) -> Column:
    """NFKC, full case folding, NFKC, white space folded to single spaces, trimmed; null as ''."""
    folded = F.reflect(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), _compose(F.coalesce(text, F.lit(""))), F.lit(True))
    return F.trim(F.regexp_replace(_compose(folded), r"[\s\p{Z}\x1c-\x1f\x85]+", " "))


def digest(canon: Column) -> Column:
    """128 bits as 32 hex digits: xxhash64 under two seeds."""
    two = (F.xxhash64(canon), F.xxhash64(F.lit(_SECOND_SEED), canon))
    return F.concat(*(F.lpad(F.lower(F.hex(x)), 16, "0") for x in two))


def among(rows: DataFrame, wanted: DataFrame, column: str) -> DataFrame:
    """The rows whose column is in wanted (one column, checkpointed): by broadcast if it is small."""
    side = wanted.select(F.col(wanted.columns[0]).alias("_wanted")).distinct()
    side = F.broadcast(side) if wanted.count() <= BROADCAST_ROWS else side
    return rows.join(side, F.col(column).eqNullSafe(F.col("_wanted")), "left_semi")


def shared_digests(digests: DataFrame) -> DataFrame:
    """The digests that occur more than once: only they can stand for two texts."""
    return checkpointed(digests.groupBy("fp").count().filter("count > 1").select("fp"))


def collided_digests(texts: DataFrame) -> DataFrame:
    """The digests that stand for more than one canonical text, by comparing bytes within each.

    texts: (fp, canon) under shared digests.  They are combined before the shuffle: copies of a
    text leave one row a task.
    """
    distinct = texts.groupBy("fp", "canon").agg(F.lit(1).alias("one"))
    return distinct.groupBy("fp").count().filter("count > 1").select("fp")


def resolved(rows: DataFrame, collided: DataFrame, *columns: tuple[str, str]) -> DataFrame:
    """Give each text under a collided digest a suffix from a second digest of its bytes.

    columns: pairs (digest column, column of the second digest).
    """
    collided = checkpointed(collided)
    if collided.isEmpty():
        return rows
    for fp, check in columns:
        hit = collided.select(F.col("fp").alias("_hit"))
        rows = rows.join(hit, F.col(fp) == F.col("_hit"), "left")
        rows = rows.withColumn(fp, F.when(F.col("_hit").isNotNull(), F.concat(fp, F.lit("-"), F.substring(check, 1, 32))).otherwise(F.col(fp))).drop("_hit")
    return rows


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint) of every row; equal fingerprints mean equal canonical bytes."""
    base = docs.select(F.col(id_col), canonical(F.col(text_col)).alias("canon"))
    rows = base.select(F.col(id_col), digest(F.col("canon")).alias("fp"), "canon")
    collided = collided_digests(among(rows.select("fp", "canon"), shared_digests(rows.select("fp")), "fp"))
    named = rows.select(F.col(id_col), "fp", F.sha2(F.col("canon"), 256).alias("check"))
    return resolved(named, collided, ("fp", "check")).select(id_col, F.col("fp").alias("fingerprint"))


def _key() -> Column:
    """What rows are ordered by: null ids first, then the id, then the text's hash."""
    return F.struct(F.col("doc_id").isNotNull().alias("known"), F.coalesce("doc_id", F.lit(0)).alias("id"), F.xxhash64("text").alias("h"))


def _bounds_up_to(bounds: Column, key: Column, n: int) -> Column:
    """How many of the n sorted bounds are not above key, by halving."""

    def step(at: Column, width: Column) -> Column:
        further = at + width
        return F.when((further <= n) & (F.get(bounds, further - 1) <= key), further).otherwise(at)

    return F.aggregate(F.array(*(F.lit(1 << k) for k in range(n.bit_length() - 1, -1, -1))), F.lit(0), step)


def _folded(docs: DataFrame) -> DataFrame:
    """(doc_id, text, m): each different row once with its number; null texts as ''.

    Only rows whose doc_id is null or occurs again are grouped, combined before they are shuffled.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    odd = odd_rows(own, "doc_id")
    if odd.isEmpty():
        return own.withColumn("m", F.lit(1).cast("long"))
    odd, same = few(odd), F.col("doc_id").eqNullSafe(F.col("odd_id"))
    several = own.join(odd, same, "left_semi").groupBy("doc_id", "text").agg(F.count(F.lit(1)).alias("m"))
    return own.join(odd, same, "left_anti").withColumn("m", F.lit(1).cast("long")).unionByName(several)


def with_next(rows: DataFrame) -> DataFrame:
    """rows (doc_id, text, m) with next_id and next_text: those of the row after it, after the last the first.

    Rows that a hash of (doc_id, text) picks, one in about ROWS_PER_CELL, are the bounds of ranges
    (cells), so cells are even wherever the ids lie, and an id with many texts spans many.  A row
    that begins a cell is also a guest at the end of the cell before, so one shuffle of the text
    and a window per cell give every neighbour; no window spans the table.
    """
    n = rows.select("doc_id").count()
    share = max(ROWS_PER_CELL, n // MAX_CELLS)
    picked = F.pmod(F.xxhash64(F.lit(13), "doc_id", F.xxhash64("text")), F.lit(share)) == 0
    # One row of about MAX_CELLS keys at most, whatever the input.  As a constant it is no part of any row.
    least, cuts = rows.agg(F.min(_key()), F.sort_array(F.collect_set(F.when(picked, _key())))).first()
    kind = "struct<known: boolean, id: bigint, h: bigint>"
    constant = lambda value, kind: F.from_json(F.lit(json.dumps(value)), kind)
    bounds = constant([k.asDict() for k in cuts], f"array<{kind}>")
    keyed = rows.withColumn("key", _key())
    cell = _bounds_up_to(bounds, F.col("key"), len(cuts)) if cuts else F.lit(0)
    is_least = F.col("key") == constant(least.asDict() if least else None, kind)
    keyed = keyed.select("doc_id", "text", "m", cell.alias("cell"), picked.alias("begins"), is_least.alias("least"))
    places = F.array_compact(F.array(
        F.struct("cell", F.lit(0).alias("guest")),
        F.when(F.col("begins"), F.struct((F.col("cell") - 1).alias("cell"), F.lit(1).alias("guest"))),
        F.when(F.col("least"), F.struct(F.lit(len(cuts)).alias("cell"), F.lit(2).alias("guest"))),
    ))
    both = keyed.select("doc_id", "text", "m", F.inline(places))
    by = Window.partitionBy("cell").orderBy("guest", F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), "text")
    return both.select("doc_id", "text", "m", "guest", F.lead("doc_id").over(by).alias("next_id"), F.lead("text").over(by).alias("next_text")).filter("guest = 0").drop("guest")


def with_edit(rows: DataFrame) -> DataFrame:
    """with_next, and the canonical forms and digests of each text and of its edited text; copies: output rows it stands for.

    Of m equal rows all but the last are followed by an equal one.
    """
    rows = with_next(rows)
    again = rows.filter("m > 1").select("doc_id", "text", (F.col("m") - 1).alias("copies"), F.col("doc_id").alias("next_id"), F.col("text").alias("next_text"))
    rows = rows.select("doc_id", "text", F.lit(1).cast("long").alias("copies"), "next_id", "next_text").unionByName(again)
    rows = rows.withColumn("n_chars", F.char_length("text").cast("long"))
    k = F.floor(F.col("n_chars") / 4).cast("int")
    rows = rows.select(
        "doc_id", "next_id", "n_chars", "copies", "next_text", canonical(F.col("text")).alias("canon"),
        F.concat(F.expr("substring(text, 1, cast(n_chars - floor(n_chars / 4) as int))"), F.substring(F.col("next_text"), F.lit(1), k)).alias("edited"),
    ).withColumn("edited_canon", canonical(F.col("edited")))
    return rows.withColumn("fp", digest(F.col("canon"))).withColumn("efp", digest(F.col("edited_canon")))


def neighbour_report(docs: DataFrame) -> DataFrame:
    """The rows of ``op9_fingerprint``: each text's fingerprint, its edited text's, and likenesses."""
    docs = _folded(docs)
    rows = with_edit(docs)
    narrow = checkpointed(rows.select(
        "doc_id", "next_id", "n_chars", "copies", F.sha2("edited", 256).alias("edited_sha256"), "fp", "efp",
        F.sha2("canon", 256).alias("check"), F.sha2("edited_canon", 256).alias("echeck"),
        F.when((F.col("fp") == F.col("efp")) & (F.col("canon") == F.col("edited_canon")), 1.0).otherwise(0.0).alias("near_edited"),
        F.when(F.col("canon") == canonical(F.col("next_text")), 1.0).otherwise(0.0).alias("near_next"),
    ))
    shared = shared_digests(narrow.select(F.explode(F.array("fp", "efp")).alias("fp")))
    own = among(docs.select(canonical(F.col("text")).alias("canon")).withColumn("fp", digest(F.col("canon"))), shared, "fp").select("fp", "canon")
    # Edited texts are made anew for those rows alone whose edited digest is shared; a row's neighbour
    # comes along, so it is still the next one among the rows that are left.
    again = checkpointed(among(narrow, shared, "efp").select("doc_id", "next_id"))
    some = among(docs, checkpointed(again.select(F.explode(F.array("doc_id", "next_id")).alias("id")).distinct()), "doc_id")
    edited = among(among(with_edit(some), again.select("doc_id"), "doc_id"), shared, "efp").select(F.col("efp").alias("fp"), F.col("edited_canon").alias("canon"))
    named = resolved(narrow, collided_digests(own.unionByName(edited)), ("fp", "check"), ("efp", "echeck"))
    out = [F.col("doc_id"), F.col("n_chars"), F.col("edited_sha256"), F.col("fp").alias("fingerprint"), F.col("efp").alias("edited_fingerprint"), F.col("near_edited"), F.col("near_next")]
    many = checkpointed(named.filter("copies > 1"))
    if many.isEmpty():
        return named.select(*out)
    portions = many.withColumn("portion", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / PORTION)))).repartition("doc_id", "check", "portion")
    repeated = portions.withColumn("one", F.explode(F.sequence(F.col("portion") * PORTION, F.least(F.col("copies"), (F.col("portion") + 1) * PORTION) - 1)))
    return named.filter("copies = 1").select(*out).unionByName(repeated.select(*out))


def op9_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbour_report(table(spark, sf_dir, "documents"))
