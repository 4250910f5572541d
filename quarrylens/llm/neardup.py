"""Near-duplicate classes by BagMinHash, banding and exact verification.

A text is the multiset of its five-word shingles; two texts are linked if their weighted Jaccard
similarity (sum of the smaller counts over sum of the larger) is at least 0.8.  Classes are the
connected components of the links.

Signature: for every shingle, points of Poisson processes over (time, weight level) are drawn from
a generator seeded by the shingle alone.  The weight axis is cut into the dyadic levels 0-1, 1-2,
2-4, 4-8, ...; a level of width r has one process of rate r, and each of its points falls on one
of its unit cells by hashed bits, so a count of c takes the points of its first c cells and two
texts share exactly the points below both counts.  Each point goes to one of the signature's
components, which keeps its earliest.  The chance that two components agree is the similarity.

Rows of one class of equal shingle multisets are folded into one first, so copies cost nothing.
Texts that share a band are candidates: in each bucket all members are checked against one hub,
the member that shares most buckets.  In the buckets that still hold several components, members
outside the hub's are compared with all others: pair by pair in small buckets; in large ones block
by block, best partners by signature first, where texts are compared within the block and only
links that join components leave it.  So a large group whose members differ by more than the
threshold makes no quadratic number of rows.  A block is bounded in members and in characters.
Keys that many members share are joined apart from the others, and a hub's text goes to as many
tasks as its members fill, so no key is one task's work.  Every link comes from comparing the two
multisets.  Pairs whose signatures agree in less than PROMISING are not verified (at a similarity
of 0.8 that has a chance of 4 in 100,000, no more than sharing no band has); promising=0 verifies
every pair that shares a band.

Defined results: a null text, or one without a word, is in no link and a class of its own; a text
of one to four words has one shingle of all its words; rows with the same doc_id are one document,
linked if any of its texts is; a row without doc_id has class null; an empty table gives an empty
result; extra columns are ignored.  ``one_of_each_class`` says what it does with them itself.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, all_columns, checkpointed, few, odd_rows, python_ready, table
from .text import mix, shingles

SHINGLE_WORDS = 5
SIMILARITY = 0.8
BANDS, BAND_ROWS = 26, 5
COMPONENTS = BANDS * BAND_ROWS
#: Share of agreeing components below which a pair is not verified.
PROMISING = 0.66
#: Buckets of more members are compared in blocks of so many members, or characters of their texts.
SMALL_BUCKET, BLOCK, BLOCK_CHARS = 24, 1024, 16 << 20
#: Keys with more rows are joined apart (their narrow side is broadcast), hubs with more pairs spread.
HOT = 1024
#: Tasks of a round over few edges.
PARTS = 8

_U = np.uint64
_GOLDEN = _U(0x9E3779B97F4A7C15)


def bag_signatures(doc: np.ndarray, shingle: np.ndarray, count: np.ndarray, n_docs: int, m: int = COMPONENTS) -> np.ndarray:
    """BagMinHash values (n_docs x m, float64; inf for a text without shingles)."""
    best = np.full(n_docs * m, np.inf)
    weight = np.bincount(doc, count, minlength=n_docs)
    # The earliest points of all components lie before this time, nearly always; else it is doubled.
    limit = np.where(weight > 0, m * (np.log(m) + 6) / np.maximum(weight, 1), 0.0)
    open_docs = weight > 0
    while open_docs.any():
        own = np.flatnonzero(open_docs[doc])
        levels = np.ceil(np.log2(np.maximum(count[own], 1))).astype(np.int64) + 1
        at = np.repeat(own, levels)
        level = np.arange(len(at)) - np.repeat(np.cumsum(levels) - levels, levels)
        low = np.where(level == 0, 0, 1 << np.maximum(level - 1, 0))
        width = np.maximum(low, 1)
        d, c, last = doc[at], count[at], limit[doc[at]]
        state = mix(shingle[at] ^ (level.astype(_U) * _U(0xD6E8FEB86659FD93)))
        time = np.zeros(len(at))
        while len(state):
            state = state + _GOLDEN
            z = mix(state)
            time = time - np.log1p(-((z >> _U(11)).astype(np.float64) * 2.0**-53)) / width
            on = np.flatnonzero(time <= last)
            state, time, d, c, low, width, last = (x[on] for x in (state, time, d, c, low, width, last))
            z = mix(state ^ _U(0xA0761D6478BD642F))
            cell = low + ((z & _U(0xFFFFFF)) % width.astype(_U)).astype(np.int64)
            inside = np.flatnonzero(cell < c)
            slot = d[inside] * m + ((z[inside] >> _U(32)) % _U(m)).astype(np.int64)
            np.minimum.at(best, slot, time[inside])
        open_docs &= ~np.isfinite(best.reshape(n_docs, m)).all(1)
        limit = limit * 2
    return best.reshape(n_docs, m)


def band_keys(signatures: np.ndarray) -> np.ndarray:
    """One 64-bit key a band (n x BANDS)."""
    bits = mix(signatures.view(_U)).reshape(len(signatures), BANDS, BAND_ROWS)
    key = np.broadcast_to(np.arange(BANDS, dtype=_U), bits.shape[:2]).copy()
    for j in range(BAND_ROWS):
        key = mix(key * _GOLDEN + bits[:, :, j])
    return key.view(np.int64)


def bag_digests(doc: np.ndarray, shingle: np.ndarray, count: np.ndarray, n_docs: int) -> list[bytes | None]:
    """128-bit digests of whole multisets; None for an empty one."""
    parts = []
    with np.errstate(over="ignore"):
        for salt in (_U(0x8EBC6AF09C88C6E3), _U(0x589965CC75374CC3)):
            total = np.zeros(n_docs, dtype=_U)
            np.add.at(total, doc, mix(shingle * salt + mix(count.astype(_U) ^ salt)))
            parts.append(total)
    size = np.bincount(doc, minlength=n_docs)
    return [parts[0][i].tobytes() + parts[1][i].tobytes() if size[i] else None for i in range(n_docs)]


def signature_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, bands, sig, chars) of every text; digest, bands and sig are null without a word.

    sig: one byte a component, enough to estimate similarities, and then the band keys; chars: the text's length.
    """
    python_ready(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 64):
                part = b.slice(at, 64)
                texts = part.column(1).to_pylist()
                doc, sh, n = shingles(texts, SHINGLE_WORDS)
                digest = bag_digests(doc, sh, n, part.num_rows)
                signatures = bag_signatures(doc, sh, n, part.num_rows)
                keys = band_keys(signatures)
                small = (mix(signatures.view(_U)) >> _U(17)).astype(np.uint8)
                sig = [x.tobytes() + k.tobytes() if g else None for x, k, g in zip(small, keys, digest, strict=True)]
                bands = [k.tolist() if g else None for k, g in zip(keys, digest, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(digest, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(sig, pa.binary()), pa.array(list(map(len, texts)), pa.int64())], names=["doc_id", "digest", "bands", "sig", "chars"])

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return plain.mapInArrow(run, "doc_id long, digest binary, bands array<long>, sig binary, chars long")


def text_bag(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The multiset of a text's shingles: sorted values and counts."""
    _, values, counts = shingles([text], SHINGLE_WORDS)
    return values, counts


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two multisets given as (sorted values, counts); 0 if their sizes alone rule out a link."""
    n, m = int(a[1].sum()), int(b[1].sum())
    if min(n, m) < SIMILARITY * max(n, m):
        return 0.0  # as far as anybody asks
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = int(np.minimum(a[1][i], b[1][j]).sum())
    every = n + m - both
    return both / every if every else 0.0


def hot_keys(sizes: DataFrame) -> DataFrame | None:
    """(key) of the keys with more than HOT rows, for a broadcast; None if there are none (or too many); sizes: (key, n)."""
    hot = checkpointed(sizes.filter(F.col("n") > HOT).select("key"))
    return F.broadcast(hot) if 0 < hot.count() <= BROADCAST_ROWS else None


def join_hot(rows: DataFrame, side: DataFrame, hot: DataFrame | None) -> DataFrame:
    """rows joined with side (one narrow row a key) on key; the rows of hot keys meet theirs by broadcast."""
    if hot is None:
        return rows.join(side, "key")
    cold = rows.join(hot, "key", "left_anti").join(side.join(hot, "key", "left_anti"), "key")
    return cold.unionByName(rows.join(F.broadcast(side.join(hot, "key", "left_semi")), "key"))


def spread_hubs(pairs: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """pairs (a, b) with a salt, and (b, salt): a hub b of many pairs has several salts, HOT pairs each; n: number of pairs."""
    hubs = pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / HOT).cast("int").alias("salts"))
    large = hubs.filter("salts > 1")  # of n pairs at most n / HOT are
    salted = pairs.join(F.broadcast(large) if n <= HOT * BROADCAST_ROWS else large, "b", "left").withColumn("salts", F.coalesce("salts", F.lit(1)))
    salted = salted.select("a", "b", F.pmod(F.xxhash64("a", F.lit(9)), F.col("salts")).cast("int").alias("salt"))
    return salted, hubs.select("b", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))


def verified(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """Those (a, b) whose texts reach the similarity, by comparing their shingle multisets."""
    python_ready(docs.sparkSession)
    n = pairs.count()
    pairs, hubs = spread_hubs(pairs.select("a", "b"), n)
    if n <= BROADCAST_ROWS:  # narrow rows: then texts meet their pairs where they are read
        pairs, hubs = F.broadcast(pairs), F.broadcast(hubs)
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), "text").filter("text is not null")
    left = texts.join(pairs, F.col("id") == F.col("a")).select("a", "b", "salt", F.col("text").alias("text_a"))
    right = texts.join(hubs, F.col("id") == F.col("b")).select("b", "salt", F.col("text").alias("text_b"))
    joined = left.join(right, ["b", "salt"]).select("a", "b", "text_a", "text_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_text, last_bag = None, None
        for batch in batches:
            keep = []
            for ta, tb in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if tb != last_text:
                    last_text, last_bag = tb, text_bag(tb)
                keep.append(similarity(text_bag(ta), last_bag) >= SIMILARITY)
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep)) for c in (batch.column(0), batch.column(1))], names=["a", "b"])

    return joined.mapInArrow(run, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(id, class): the smallest id that each id of the edges (a, b) is connected with.

    Each round takes the smallest label among an id's neighbours and itself and then the label of
    that label, so the number of rounds is logarithmic in a component's width.  Labels stay
    distributed; where they are few they are broadcast, and a round is one combined aggregate.
    Where the edges are few too, a round has PARTS tasks: the driver keeps a record of each task.
    """
    ends = [F.struct(F.col(x).alias("a"), F.col(y).alias("b")) for x, y in ("ab", "ba", "aa", "bb")]
    both = checkpointed(edges.select(F.inline(F.array(*ends))).distinct())
    in_parts = (lambda df: df.coalesce(PARTS)) if both.count() <= BROADCAST_ROWS else (lambda df: df)
    both = in_parts(both)
    labels = checkpointed(in_parts(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("class"))))
    few = labels.count() <= BROADCAST_ROWS
    while True:
        side = F.broadcast(labels) if few else labels
        near = both.join(side.select(F.col("id").alias("b"), "class"), "b").groupBy(F.col("a").alias("id"))
        step = near.agg(F.min("class").alias("class"), F.min(F.when(F.col("a") == F.col("b"), F.col("class"))).alias("old"))
        jump = side.select(F.col("id").alias("class"), F.col("class").alias("far"))
        new = checkpointed(in_parts(step.join(jump, "class").select("id", "old", F.least("class", "far").alias("class"))))
        changed = not new.filter("old <> class").isEmpty()
        labels = new.select("id", "class")
        if not changed:
            return labels


def _bytes(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(len(column), -1)


def _components(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return _bytes(column)[:, :COMPONENTS]


def _bands(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.ascontiguousarray(_bytes(column)[:, COMPONENTS:]).view(np.int64)


def promising(pairs: DataFrame, sigs: DataFrame, least: float) -> DataFrame:
    """Those (a, b) whose signatures agree in a share of least or more; sigs: (id, sig, ...)."""
    if least <= 0:
        return pairs.select("a", "b")
    pairs = checkpointed(pairs)
    salted, hubs = spread_hubs(pairs, pairs.count())
    sigs = sigs.select("id", "sig")
    right = hubs.join(sigs.toDF("b", "sig_b"), "b")
    both = salted.join(sigs.toDF("a", "sig_a"), "a").join(right, ["b", "salt"]).select("a", "b", "sig_a", "sig_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                keep = pa.array((_components(b.column(2)) == _components(b.column(3))).mean(1) >= least)
                yield pa.RecordBatch.from_arrays([b.column(i).filter(keep) for i in (0, 1)], names=["a", "b"])

    return both.mapInArrow(run, "a long, b long")


def _agreement(queries: pa.Table, members: pa.Table, least: float):
    """Row by row of the queries: the members of other components that promise a link, the best first.

    A pair that shares several buckets is looked at in the one of the lowest band alone.
    """
    q, v = _components(queries.column("sig")), _components(members.column("sig"))
    qb, vb = _bands(queries.column("sig")), _bands(members.column("sig"))
    qc, vc = queries.column("class").to_numpy(), members.column("class").to_numpy()
    band = int((qb[0] == queries.column("key")[0].as_py()).argmax())
    for at in range(0, len(q), 32):
        share = (q[at : at + 32, None] == v[None]).mean(2)
        share[qc[at : at + 32, None] == vc[None]] = -1
        for i in range(len(share)):
            found = np.flatnonzero(share[i] >= least)
            found = found[~(vb[found, :band] == qb[at + i, :band]).any(1)]
            yield at + i, found[np.argsort(-share[i, found], kind="stable")]


_PAIR = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _pairs(a: list[int], b: list[int]) -> pa.Table:
    x, y = np.array(a, dtype=np.int64), np.array(b, dtype=np.int64)
    return pa.table([np.minimum(x, y), np.maximum(x, y)], schema=_PAIR)


def _block_links(queries: pa.Table, members: pa.Table, least: float) -> pa.Table:
    """Links between a block's queries and members, verified on their texts, as many as join components.

    A pair is left out only if its components are joined already.
    """
    if not queries.num_rows or not members.num_rows:
        return _PAIR.empty_table()
    qi, vi = queries.column("id").to_numpy(), members.column("id").to_numpy()
    qc, vc = queries.column("class").to_pylist(), members.column("class").to_pylist()
    texts = {"q": queries.column("text"), "v": members.column("text")}
    bags: dict[tuple[str, int], tuple[np.ndarray, np.ndarray]] = {}
    joined: dict[int, int] = {}

    def bag_of(side: str, i: int) -> tuple[np.ndarray, np.ndarray]:
        if (side, i) not in bags:
            bags[side, i] = text_bag(texts[side][i].as_py())
        return bags[side, i]

    def root(c: int) -> int:
        while c in joined:
            c = joined[c]
        return c

    a, b = [], []
    for i, found in _agreement(queries, members, least):
        for j in found.tolist():
            x, y = root(qc[i]), root(vc[j])
            if x != y and similarity(bag_of("q", i), bag_of("v", j)) >= SIMILARITY:
                joined[x] = y
                a.append(int(qi[i]))
                b.append(int(vi[j]))
    return _pairs(a, b)


def _open_buckets(members: DataFrame, labels: DataFrame, hot: DataFrame | None) -> DataFrame:
    """members (key, id, score, n, chars) with class and main, of the buckets that hold several components.

    main: the class of the bucket's best-connected member.
    """
    known = members.join(labels, "id", "left").withColumn("class", F.coalesce("class", "id"))
    mixed = known.groupBy("key").agg(F.min("class").alias("lo"), F.max("class").alias("hi"), F.max(F.struct("score", (-F.col("id")).alias("minus"), "class"))["class"].alias("main"))
    return join_hot(known, mixed.filter("lo <> hi").select("key", "main"), hot)


def _by_blocks(open_: DataFrame, columns: list[str], f: Callable[[pa.Table, pa.Table], pa.Table], side: DataFrame, hot: DataFrame | None) -> DataFrame:
    """f over every pair of blocks of each large bucket: members outside the main class against all.

    side: (id, more columns), attached last.  Who belongs to which blocks is settled on narrow
    rows; a bucket of one block, nearly all of them, sends each member once.
    """
    many = open_.filter(F.col("n") > SMALL_BUCKET)
    python_ready(open_.sparkSession)
    asks = F.col("class") != F.col("main")
    blocks = lambda n, chars: F.ceil(F.greatest(n / BLOCK, chars / BLOCK_CHARS)).cast("int")
    sizes = many.groupBy("key").agg(blocks(F.count_if(asks), F.sum(F.when(asks, F.col("chars")).otherwise(0))).alias("qb"), blocks(F.count(F.lit(1)), F.sum("chars")).alias("vb"))
    spread = {c: F.pmod(F.xxhash64("id", F.lit(5)), F.col(c)).cast("int") for c in ("qb", "vb")}  # ids are dealt to blocks by a hash
    all_v, all_q = (F.sequence(F.lit(0), F.col(c) - 1) for c in ("vb", "qb"))
    as_query = F.transform(all_v, lambda v: F.struct(spread["qb"].alias("q"), v.alias("v"), F.lit("q").alias("role")))
    as_member = F.transform(all_q, lambda q: F.struct(q.alias("q"), spread["vb"].alias("v"), F.lit("v").alias("role")))
    alone = F.array(F.struct(F.lit(0).alias("q"), F.lit(0).alias("v"), F.when(asks, "b").otherwise("v").alias("role")))
    places = F.when((F.col("qb") == 1) & (F.col("vb") == 1), alone).when(asks, F.concat(as_query, as_member)).otherwise(as_member)
    rows = join_hot(many, sizes, hot).select("key", "id", "class", F.inline(places)).join(side, "id").select("key", "q", "v", "role", *columns)

    def run(group: pa.Table) -> pa.Table:
        role = group.column("role")
        return f(*(group.filter(pc.is_in(role, pa.array(r))) for r in (["q", "b"], ["v", "b"])))

    return rows.groupBy("key", "q", "v").applyInArrow(run, "a long, b long").distinct()


def remaining_pairs(open_: DataFrame, sigs: DataFrame, least: float) -> DataFrame:
    """Promising pairs (a < b) across components that share a small bucket."""
    little = open_.filter(F.col("n") <= SMALL_BUCKET)
    other = little.filter("class <> main").select("key", F.col("id").alias("other"), F.col("class").alias("other_class"))
    small = little.join(other, "key").filter("class <> other_class").select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct()
    return promising(small, sigs, least)


def block_links(open_: DataFrame, sigs: DataFrame, docs: DataFrame, least: float, hot: DataFrame | None) -> DataFrame:
    """Verified links (a < b) that join the components left in large buckets."""
    large = open_.filter(F.col("n") > SMALL_BUCKET)
    ids = checkpointed(large.select("id").distinct())
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), "text").filter("text is not null").join(few(ids), "id", "left_semi")
    return _by_blocks(large, ["id", "class", "sig", "text"], lambda q, v: _block_links(q, v, least), sigs.join(texts, "id"), hot)


def _made_ids(texts: DataFrame, used: DataFrame) -> DataFrame:
    """texts (doc_id, h1, h2) with an id of its own for each, none of which is used (id)."""
    salt = 0
    while True:
        made = checkpointed(texts.withColumn("id", F.xxhash64(F.lit(salt), "doc_id", "h1", "h2")))
        met = made.select("id").unionByName(used).groupBy("id").count().filter("count > 1")
        if made.join(met, "id", "left_semi").isEmpty():
            return made
        salt += 1


def _hashed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.withColumns({"h1": F.xxhash64(text), "h2": F.xxhash64(F.lit(1), text)})


def _own_ids(docs: DataFrame, odd: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(doc_id, text) without the odd ids; (doc_id, text) with a made id a text of those; (doc_id, h1, h2, id)."""
    odd = few(odd)
    same = F.col("doc_id").eqNullSafe(F.col("odd_id"))
    plain = docs.select("doc_id", "text").join(odd, same, "left_anti")
    several = _hashed(docs.select("doc_id", "text").join(odd, same, "left_semi"))
    ids = few(_made_ids(several.select("doc_id", "h1", "h2").distinct(), docs.select(F.col("doc_id").alias("id")).distinct()))
    named = several.join(ids.withColumnRenamed("doc_id", "own"), F.col("doc_id").eqNullSafe(F.col("own")) & (several.h1 == ids.h1) & (several.h2 == ids.h2))
    return plain, checkpointed(named.select(F.col("id").alias("doc_id"), "text").dropDuplicates(["doc_id"])), ids


def near_duplicate_classes(docs: DataFrame, least: float = PROMISING) -> DataFrame:
    """(doc_id, class_id) of every row; class_id is the smallest doc_id of its class.

    A repeated doc_id may stand for several texts.  Each of them is classed under an id of its own,
    and the classes that one doc_id belongs to are united at the end.  least: see PROMISING.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    odd = odd_rows(docs, "doc_id").filter("odd_id is not null")
    if odd.isEmpty():
        return _classes(docs, least)
    plain, apart, ids = _own_ids(docs, odd)
    classes = _classes(plain.unionByName(apart), least).filter("doc_id is not null")
    for c in ("doc_id", "class_id"):  # back from the ids made; a class's id is one of its members'
        origin = ids.select(F.col("id").alias(c), F.col("doc_id").alias("origin"))
        classes = classes.join(origin, c, "left").withColumn(c, F.coalesce("origin", c)).drop("origin")
    united = components(classes.select(F.col("doc_id").alias("a"), F.col("class_id").alias("b")))
    return docs.select("doc_id").join(united.toDF("doc_id", "class_id"), "doc_id", "left")


def _classes(docs: DataFrame, least: float) -> DataFrame:
    """near_duplicate_classes of rows none of which repeats a doc_id."""
    rows = checkpointed(signature_rows(docs))
    known = rows.filter("digest is not null and doc_id is not null")
    # Equal multisets have equal bands: any row's will do, combined before the shuffle.
    reps = checkpointed(known.groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.first("bands").alias("bands"), F.first("sig").alias("sig"), F.max("chars").alias("chars")))
    folded = reps.select("digest", F.col("doc_id").alias("id"))
    buckets = reps.select(F.col("doc_id").alias("id"), F.explode("bands").alias("key"), "chars")
    sizes = checkpointed(buckets.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
    score = F.sum("n").over(Window.partitionBy("id"))  # over a text's bands
    hot = hot_keys(sizes)
    members = checkpointed(join_hot(buckets, sizes, hot).select("key", "id", score.alias("score"), "n", "chars"))
    sigs = checkpointed(reps.select(F.col("doc_id").alias("id"), "sig").join(members.select("id").distinct(), "id", "left_semi"))

    hub = members.groupBy("key").agg(F.max(F.struct("score", (-F.col("id")).alias("minus"))).alias("top")).select("key", (-F.col("top.minus")).alias("b"))
    stars = join_hot(members, hub, hot).filter("id <> b").select(F.col("id").alias("a"), "b").distinct()
    stars = checkpointed(promising(stars, sigs, least))
    links = checkpointed(verified(stars, docs))
    tried = stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    labels = components(links)
    open_ = checkpointed(_open_buckets(members, labels, hot))
    if not open_.isEmpty():
        pairs = checkpointed(remaining_pairs(open_, sigs, least).join(tried, ["a", "b"], "left_anti"))
        links = checkpointed(links.unionByName(verified(pairs, docs)))
        large = members.filter(F.col("n") > SMALL_BUCKET)
        if not large.isEmpty():
            labels = components(links)
            open_ = checkpointed(_open_buckets(large, labels, hot))
            links = links.unionByName(block_links(open_, sigs, docs, least, hot))
        labels = components(links)

    folded = folded.join(labels, "id", "left").select("digest", F.coalesce("class", "id").alias("rep"))
    return rows.select("doc_id", "digest").join(folded, "digest", "left").select("doc_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("rep", "doc_id")).alias("class_id"))


def one_of_each_class(docs: DataFrame, least: float = PROMISING) -> DataFrame:
    """The rows of docs without those that repeat another; all columns as they are.

    Here every text is a document of its own, whatever its doc_id: unlike texts under one doc_id,
    or under none, are all kept unless they repeat another text.  Of each class the row with the
    smallest doc_id stays (one without a doc_id last), of several texts of that id the one whose
    hash is smallest.  Of rows equal in doc_id and text one stays, by the hash of all its columns;
    rows without a doc_id and without a word all stay.
    """
    odd = odd_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id")), "doc_id")
    if odd.isEmpty():
        classes = checkpointed(_classes(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), least))
        gone = checkpointed(classes.filter("class_id <> doc_id").select("doc_id"))
        return docs.join(few(gone), "doc_id", "left_anti").select(docs.columns)
    ours = all_columns(docs, F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    kept = [c for c in ours.columns if c.startswith("_k")]
    plain, apart, ids = _own_ids(ours, odd)
    classes = _classes(plain.unionByName(apart), least)
    named = classes.join(ids.select(F.col("id").alias("doc_id"), F.col("doc_id").alias("own"), F.lit(True).alias("made")), "doc_id", "left")
    named = named.withColumn("own", F.when(F.col("made"), F.col("own")).otherwise(F.col("doc_id")))
    first = named.groupBy("class_id").agg(F.min(F.struct(F.col("own").isNull().alias("none"), "own", "doc_id"))["doc_id"].alias("id"))
    stay = checkpointed(first.select("id"))
    same = F.col("doc_id").eqNullSafe(F.col("odd_id"))
    one = ours.join(few(odd), same, "left_anti").join(stay, F.col("doc_id") == F.col("id"), "left_semi").select(kept)
    several = _hashed(ours.join(few(odd), same, "left_semi"))
    lone = several.filter(F.col("doc_id").isNull() & ~F.rlike(F.coalesce("text", F.lit("")), F.lit(r"(?U)[\p{L}\p{Nd}\p{N}_]")))
    rest = several.filter(F.col("doc_id").isNotNull() | F.rlike(F.coalesce("text", F.lit("")), F.lit(r"(?U)[\p{L}\p{Nd}\p{N}_]")))
    staying = ids.withColumnRenamed("doc_id", "own").join(stay, "id", "left_semi")
    whole = F.struct(*kept)
    rest = rest.join(staying, F.col("doc_id").eqNullSafe(F.col("own")) & (rest.h1 == staying.h1) & (rest.h2 == staying.h2))
    rest = rest.groupBy("id").agg(F.min_by(whole, F.md5(F.to_json(whole))).alias("_row")).select("_row.*")
    out = one.unionByName(rest).unionByName(lone.select(kept))
    return out.select(*(F.col(f"_k{i}").alias(c) for i, c in enumerate(docs.columns)))


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_classes(table(spark, sf_dir, "documents"))
