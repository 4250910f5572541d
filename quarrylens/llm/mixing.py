"""Mixing sources to target weights by Poisson replication, built from DataFrame functions only.

Each source's mean repetition rate is target share x output size / rows of the source.  A
document's number of copies inverts the Poisson distribution with that mean at a uniform number
hashed from its id, so the same document always gets the same number, on any cluster; expected
counts hit the target weights and no counter is shared between tasks.  Copies are then dealt out
by a hash and sorted by it in each partition, which is a global random order.

Rows whose doc_id is null or occurs again draw by a hash of the whole row and by their number among
equal rows, so each of them draws for itself and totals hit the targets there too.  Equal rows are
counted before they are shuffled and numbered in portions, so a huge group of them is many tasks.

Defined results: a null source is a source of its own; a null text is copied like any other; a
source without a weight in a given mapping has weight 0; an empty table gives an empty result; the
columns copy, n_copies and shuffle_key replace namesakes of the input, and with marks=False the
columns of the input come back as they are and nothing is added.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import all_columns, checkpointed, few, odd_rows, table

#: Means above this are split into equal parts whose Poisson counts are added up.
PART_MEAN = 64
#: Sources up to this number (a row of a few hundred bytes each) are broadcast.
BROADCAST_SOURCES = 50_000
#: Salts of the shuffle join beyond that number.
SALTS = 64
SEED = "mix-1"
#: Equal rows that one task numbers at a time.
PORTION = 50_000


def uniform(seed: str, *parts: Column) -> Column:
    """A number in [0, 1) from 52 bits of an md5."""
    text = F.concat_ws(":", F.lit(seed), *(F.coalesce(p.cast("string"), F.lit("null")) for p in parts))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def source_rates(docs: DataFrame, weights: dict[str, float] | None, epochs: float, source_col: str) -> DataFrame:
    """(src, mean of one part, number of parts, cumulative probabilities below 1) of each source.

    weights: target share by source, in any unit; None: the square root of each source's rows,
    which lifts small sources without letting them dominate.
    """
    stats = docs.groupBy(F.col(source_col).alias("src")).agg(F.count(F.lit(1)).alias("rows"))
    if weights is None:
        stats = stats.withColumn("weight", F.sqrt(F.col("rows").cast("double")))
    else:
        weight = F.lit(0.0)
        for name, w in weights.items():
            weight = F.when(F.col("src").eqNullSafe(F.lit(name)), F.lit(float(w))).otherwise(weight)
        stats = stats.withColumn("weight", weight)
    total = stats.agg(F.sum("rows").alias("all_rows"), F.sum("weight").alias("all_weight"))
    rate = F.when(F.col("all_weight") > 0, F.col("weight") / F.col("all_weight") * F.col("all_rows") * F.lit(float(epochs)) / F.col("rows")).otherwise(0.0)
    rates = stats.crossJoin(F.broadcast(total)).select("src", rate.alias("rate"))  # total: one row
    rates = rates.withColumn("parts", F.greatest(F.lit(1), F.ceil(F.col("rate") / PART_MEAN)).cast("int")).withColumn("mean", F.col("rate") / F.col("parts"))
    last = F.ceil(F.col("mean") + 12 * F.sqrt("mean") + 20).cast("int")
    start = F.struct(F.exp(-F.col("mean")).alias("p"), F.exp(-F.col("mean")).alias("c"), F.array(F.exp(-F.col("mean"))).alias("all"))

    def step(acc: Column, k: Column) -> Column:
        p = acc["p"] * F.col("mean") / k
        return F.struct(p.alias("p"), (acc["c"] + p).alias("c"), F.concat(acc["all"], F.array(acc["c"] + p)).alias("all"))

    cdf = F.aggregate(F.sequence(F.lit(1), last), start, step, lambda acc: acc["all"])
    return rates.select("src", "parts", F.filter(cdf, lambda c: c < 1).alias("cdf"))


def _told_apart(docs: DataFrame, id_col: str, plain: DataFrame, did: str) -> DataFrame:
    """plain (all columns of docs under our names) with draw_id: what a row's numbers are hashed from.

    The doc_id; where that is null or occurs again, with a hash of the row and its number among
    equal rows.
    """
    odd = odd_rows(docs, id_col)
    by_id = F.coalesce(F.col(did).cast("string"), F.lit("null"))
    if odd.isEmpty():
        return plain.withColumn("draw_id", by_id)
    odd = few(odd)
    same = F.col(did).eqNullSafe(F.col("odd_id"))
    hashed = plain.join(odd, same, "left_semi").withColumn("h", F.md5(F.to_json(F.struct(*plain.columns), {"ignoreNullFields": "false"})))
    groups = hashed.groupBy("h").agg(F.count(F.lit(1)).alias("m"), *(F.first(c).alias(c) for c in plain.columns))  # equal rows: any one's values
    portions = groups.withColumn("portion", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("m") - 1) / PORTION)))).repartition("h", "portion")
    last = F.least(F.col("m"), (F.col("portion") + 1) * PORTION) - 1
    ranked = portions.withColumn("rank", F.explode(F.sequence(F.col("portion") * PORTION, last)))
    ranked = ranked.select(*plain.columns, F.concat_ws(":", F.coalesce(F.col(did).cast("string"), F.lit("null")), "h", "rank").alias("draw_id"))
    return plain.join(odd, same, "left_anti").withColumn("draw_id", by_id).unionByName(ranked)


def poisson_mix(
    docs: DataFrame, weights: dict[str, float] | None = None, epochs: float = 1.0, seed: str = SEED, id_col: str = "doc_id", source_col: str = "source", marks: bool = True
) -> DataFrame:
    """Every column of docs, once per copy, with copy (from 0), n_copies and shuffle_key if marks is set."""
    docs = docs.drop("copy", "n_copies", "shuffle_key") if marks else docs
    # Few rows of numbers; checkpointed, they cost one scan of one column.
    rates = checkpointed(source_rates(docs, weights, epochs, source_col))
    plain = {c: f"_k{i}" for i, c in enumerate(docs.columns)}  # no name of the input can clash with ours
    did, src = plain[id_col], plain[source_col]
    rows = _told_apart(docs, id_col, all_columns(docs), did)
    if rates.count() <= BROADCAST_SOURCES:
        rows = rows.join(F.broadcast(rates), F.col(src).eqNullSafe(F.col("src")))
    else:
        rows = rows.withColumn("salt", F.pmod(F.xxhash64("draw_id"), F.lit(SALTS)))
        rates = rates.withColumn("salt2", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rows = rows.join(rates, F.col(src).eqNullSafe(F.col("src")) & (F.col("salt") == F.col("salt2")))
    counts = F.aggregate(
        F.sequence(F.lit(1), F.col("parts")), F.lit(0),
        lambda n, i: n + F.size(F.filter(F.col("cdf"), lambda c: c <= uniform(seed, F.col("draw_id"), i))),
    )
    # The draw of the first part does not depend on a lambda variable, so it is computed once a row.
    first = F.size(F.filter(F.col("cdf"), lambda c: c <= F.col("u")))
    rows = rows.withColumn("u", uniform(seed, F.col("draw_id"), F.lit(1))).withColumn("n_copies", F.when(F.col("parts") == 1, first).otherwise(counts))
    rows = rows.filter("n_copies > 0").select(*plain.values(), "draw_id", "n_copies", F.explode(F.sequence(F.lit(0), F.col("n_copies") - 1)).alias("copy"))
    key = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed + "-order"), "draw_id", F.col("copy").cast("string")).cast("binary")), 1, 15), 16, 10).cast("long")
    rows = rows.withColumn("shuffle_key", key).repartition("shuffle_key").sortWithinPartitions("shuffle_key", did, "copy")
    return rows.select(*(F.col(a).alias(c) for c, a in plain.items()), *(["copy", "n_copies", "shuffle_key"] if marks else []))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return poisson_mix(table(spark, sf_dir, "documents"))


OP10_SQL = """
WITH s AS (SELECT source AS src, count(*) AS n FROM documents GROUP BY 1),
r AS (SELECT src, sqrt(CAST(n AS DOUBLE)) / (SELECT sum(sqrt(CAST(n AS DOUBLE))) FROM s) * (SELECT sum(n) FROM s) / n AS rate FROM s),
m AS (SELECT src, greatest(1, CAST(ceil(rate / 64) AS INT)) AS parts, rate / greatest(1, CAST(ceil(rate / 64) AS INT)) AS mean FROM r),
t AS (SELECT src, mean, k, CASE WHEN k = 0 THEN exp(-mean) ELSE exp(-mean + k * ln(mean) - lgamma(k + 1)) END AS p
      FROM m, (SELECT CAST(range AS INT) AS k FROM range(0, 200)) WHERE mean > 0),
c AS (SELECT src, k, sum(p) OVER (PARTITION BY src ORDER BY k) AS cum FROM t),
u AS (SELECT d.*, m.mean, q.i,
        CAST(('0x' || substr(md5('mix-1:' || coalesce(CAST(d.doc_id AS VARCHAR), 'null') || ':' || CAST(q.i AS VARCHAR)), 1, 13)) AS BIGINT) / 4503599627370496.0 AS u
      FROM documents d JOIN m ON d.source IS NOT DISTINCT FROM m.src, LATERAL (SELECT unnest(range(1, m.parts + 1)) AS i) q),
n AS (SELECT u.doc_id, u.source, u.lang, u.n_chars, u.text, u.i, (SELECT count(*) FROM c WHERE c.src IS NOT DISTINCT FROM u.source AND c.cum <= u.u AND c.cum < 1) AS k FROM u),
g AS (SELECT doc_id, source, lang, n_chars, text, CAST(sum(k) AS INT) AS n_copies FROM n GROUP BY ALL),
x AS (SELECT *, unnest(range(0, n_copies)) AS copy FROM g WHERE n_copies > 0)
SELECT doc_id, text, lang, source, n_chars, CAST(copy AS INT) AS copy, n_copies,
  CAST(('0x' || substr(md5('mix-1-order:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || CAST(copy AS VARCHAR)), 1, 15)) AS BIGINT) AS shuffle_key
FROM x
"""
