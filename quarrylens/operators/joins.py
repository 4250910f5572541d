"""Joins that the analyzers share, as compositions of DataFrame operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import degraded_key, join_key_of, normalized_path
from ..storage import checkpointed


def last_by_key(rows: DataFrame, key: str) -> DataFrame:
    """One row a key: the one that was ingested last.  A combined aggregate, not a sort of each key."""
    rest = [c for c in rows.columns if c != key]
    last = rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*rest), "_ord").alias("_last"))
    return last.select(key, *(F.col(f"_last.{c}").alias(c) for c in rest))


def prefixed(rows: DataFrame, prefix: str) -> DataFrame:
    return rows.select(*(F.col(c).alias(prefix + c) for c in rows.columns))


def _tier_keys(norm: Column) -> tuple[Column, Column]:
    """A normalized path's own key and the bare name it falls back to, as tagged text."""
    k = join_key_of(norm)
    return F.concat(F.when(k["full"], "p:").otherwise("n:"), k["key"]), F.concat(F.lit("n:"), degraded_key(k))


def keyed(build: DataFrame, path_col: str) -> DataFrame:
    """build with _key, what probes look up; without rows that have no name."""
    own, name = _tier_keys(F.col("_norm"))
    return build.withColumn("_norm", normalized_path(F.col(path_col))).withColumn("_bare", name).filter("_bare <> 'n:'").withColumn("_key", own)


def lists_by_key(build: DataFrame, path_col: str, keys: DataFrame, payload: Column) -> DataFrame:
    """(key, items): the payloads of each of the keys (a table of one column) in ingest order.  A row is in one list, however many look it up."""
    wanted = keyed(build, path_col).join(keys.toDF("_key").distinct(), "_key", "left_semi")
    listed = wanted.groupBy("_key").agg(F.sort_array(F.collect_list(F.struct(F.col("_ord").alias("o"), payload.alias("payload")))).alias("_listed"))
    return listed.select(F.col("_key").alias("key"), F.transform("_listed", lambda x: x["payload"]).alias("items"))


def two_tier_join(probe: DataFrame, probe_id: str, raw: Column, build: DataFrame, path_col: str, *, matched: str | None = None, **aggregates: Column) -> DataFrame:
    """(probe_id, the aggregates over its matches, degraded) of the probe rows that match anything; matched: a column for the key that was found.

    A probe matches build rows of an equal key; only a probe without such a match falls back to
    build rows that are bare names equal to its own base name.  The build side is combined per key
    before the join, so a key that many rows share is one row; the tier is decided per probe row.
    """
    # Normalized once, in a projection of its own: inlined into each use, it makes code too large to be compiled.
    own, name = _tier_keys(F.col("_norm"))
    probes = probe.select(F.col(probe_id), normalized_path(raw).alias("_norm")).filter("_norm is not null").select(probe_id, own.alias("_own"), name.alias("_bare"))
    probes = probes.select(probe_id, F.inline(F.array(F.struct(F.lit(0).alias("tier"), F.col("_own").alias("_key")), F.struct(F.lit(1).alias("tier"), F.col("_bare").alias("_key")))))
    built = keyed(build, path_col).groupBy("_key").agg(*(c.alias(n) for n, c in aggregates.items()))
    best = probes.join(built, "_key").groupBy(probe_id).agg(F.min_by(F.struct("tier", "_key", *aggregates), "tier").alias("b"))
    return best.select(probe_id, *(F.col(f"b.{n}").alias(n) for n in aggregates), *([F.col("b._key").alias(matched)] if matched else []), (F.col("b.tier") == 1).alias("degraded"))


def two_tier_matches(probe: DataFrame, probe_id: str, raw: Column, build: DataFrame, path_col: str, payload: Column) -> DataFrame:
    """(probe_id, matches, degraded): the payloads of all matches in ingest order."""
    listed = F.sort_array(F.collect_list(F.struct(F.col("_ord").alias("o"), payload.alias("payload"))))
    out = two_tier_join(probe, probe_id, raw, build, path_col, matches=listed)
    return out.withColumn("matches", F.transform("matches", lambda x: x["payload"]))


def range_join(probe: DataFrame, start: str, build: DataFrame, ts: str, width_us: int) -> DataFrame:
    """Pairs with start <= ts <= start + width, both ends closed.

    Both sides are bucketed by the width: a probe looks into its own bucket and the next one, so
    the join is an equi-join that Spark can shuffle, broadcast or split if skewed.
    """
    bucket = F.floor(F.unix_micros(start) / F.lit(width_us)).cast("bigint")
    probes = probe.withColumn("_bucket", F.explode(F.array(bucket, bucket + 1)))
    built = build.withColumn("_bucket", F.floor(F.unix_micros(ts) / F.lit(width_us)).cast("bigint"))
    gap = F.unix_micros(ts) - F.unix_micros(start)
    return probes.join(built, "_bucket").filter(gap.between(0, width_us)).drop("_bucket")


def exists_flag(left: DataFrame, keys: DataFrame, key: str, name: str) -> DataFrame:
    """left with a boolean: whether its key is among keys (a semi-join that keeps every row)."""
    marks = keys.select(key).distinct().withColumn(name, F.lit(True))
    return left.join(marks, key, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def mft_paths(entries: DataFrame, root: int = 5, drive: str = "C:", depth: int = 255) -> DataFrame:
    """(rec, path, complete) of MFT entries (rec, name, parent) by pointer doubling.

    Each round joins what a record has climbed with what its ancestor has climbed, so a path of d
    components takes log2(d) rounds; a walk ends at the root, at a missing parent, at a record
    seen before, or after `depth` components.  Of several entries for a record the last counts.  The low
    48 bits of rec and parent are record numbers; what lies above tells volumes apart.
    """
    is_root = lambda c: F.col(c).bitwiseAND(F.lit((1 << 48) - 1)) == root
    base = last_by_key(entries.select("rec", "name", "parent", "_ord"), "rec").select("rec", F.col("parent").alias("at"), F.array(F.struct("rec", "name")).alias("up"))
    walk, climbed = checkpointed(base.filter(~is_root("rec"))), 1
    while climbed < depth:
        step = walk.select(F.col("rec").alias("at"), F.col("at").alias("at2"), F.col("up").alias("up2"))
        longer = walk.join(step, "at", "left")
        longer = checkpointed(longer.select(
            "rec",
            F.coalesce("at2", "at").alias("at"),
            F.slice(F.concat(F.col("up"), F.coalesce(F.col("up2"), F.array().cast(walk.schema["up"].dataType))), 1, depth + 1).alias("up"),
            F.col("at2").isNotNull().alias("moved"),
        ))
        walk, climbed = longer.drop("moved"), 2 * climbed
        if longer.filter("moved").isEmpty():
            break
    # A walk that comes to a record again goes round for ever: its distinct records are what comes before.
    n = F.least(F.size(F.array_distinct(F.transform("up", lambda x: x["rec"]))), F.lit(depth))
    names = F.transform(F.reverse(F.slice("up", 1, n)), lambda x: x["name"])
    complete = is_root("at") & (F.size("up") == n) & (n < depth)
    return walk.select("rec", F.concat(F.lit(drive + "\\"), F.array_join(names, "\\")).alias("path"), complete.alias("complete"))
