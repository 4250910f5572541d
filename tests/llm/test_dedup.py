import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrylens.llm import fingerprint, neardup
from quarrylens.llm.text import code_points, shingles, word_hashes

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts, schema=SCHEMA):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], schema)


def bag(text):
    w = re.findall(r"\w+", (text or "").lower())
    return Counter(zip(*[w[i:] for i in range(5)], strict=False)) if len(w) >= 5 else Counter([tuple(w)] if w else [])


def brute_classes(rows):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    bags = [(i, bag(t)) for i, t in rows]
    for n, (i, a) in enumerate(bags):
        find(i)
        for j, b in bags[:n]:
            both = sum((a & b).values())
            if i == j or (both and both >= 0.8 * (sum(a.values()) + sum(b.values()) - both)):
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    return {i: find(i) for i, _ in rows}


def vocabulary(seed, n):
    r = random.Random(seed)
    return r, ["".join(r.choices("abcdefghij", k=6)) for _ in range(n)]


def test_classes_against_brute_force(spark):
    r, words = vocabulary(1, 3000)
    texts = []
    for _ in range(25):
        base = r.choices(words, k=r.choice([3, 8, 60, 300]))
        texts.append(" ".join(base))
        for _ in range(r.randint(0, 5)):
            copy = list(base)
            for _ in range(r.choice([0, 1, 2, len(base) // 25, len(base) // 10])):
                copy[r.randrange(len(copy))] = r.choice(words)
            texts.append(r.choice([" ", "  ", ", "]).join(copy).title())
    texts += ["a b c d e " * 40, "a b c d e " * 33, "a b c d e " * 20, "", "!!!", "one two", "One, two!", "x " * 4000]
    got = {r.doc_id: r.class_id for r in neardup.near_duplicate_classes(docs(spark, texts)).collect()}
    assert got == brute_classes(list(enumerate(texts))) | {i: i for i, t in enumerate(texts) if not re.search(r"\w", t)}


def test_large_group_of_unlike_copies(spark):
    """A group whose members differ around the threshold: large buckets, blocks on both sides."""
    r, words = vocabulary(2, 5000)
    base = r.choices(words, k=120)
    texts = []
    for _ in range(260):
        copy = list(base)
        for k in range(len(copy)):
            if r.random() < 0.025:
                copy[k] = r.choice(words)
        texts.append(" ".join(copy))
    want = brute_classes(list(enumerate(texts)))
    assert 1 < len(set(want.values())) < 260
    for small, block in ((neardup.SMALL_BUCKET, neardup.BLOCK), (4, 16)):
        with pytest.MonkeyPatch.context() as m:
            m.setattr(neardup, "SMALL_BUCKET", small)
            m.setattr(neardup, "BLOCK", block)
            got = {r.doc_id: r.class_id for r in neardup.near_duplicate_classes(docs(spark, texts)).collect()}
        assert got == want


def test_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(40))
    rows = [(None, long), (1, None), (2, long), (2, "quite another text of six words"), (5, "quite another text of six words"), (7, long), (8, None)]
    df = spark.createDataFrame([(i, t, "x", "y", "z") for i, t in rows], "doc_id long, text string, digest string, class_id string, id string")
    got = sorted(map(tuple, neardup.near_duplicate_classes(df).collect()), key=str)
    assert got == sorted([(None, None), (1, 1), (2, 2), (2, 2), (5, 2), (7, 2), (8, 8)], key=str)
    kept = neardup.one_of_each_class(df)
    # Of the copies of a text the smallest doc_id stays; unlike texts under one doc_id both stay.
    assert sorted((r.doc_id, r.text or "") for r in kept.collect()) == [(1, ""), (2, "quite another text of six words"), (2, long), (8, "")] and kept.columns == df.columns
    assert neardup.near_duplicate_classes(df.limit(0)).count() == 0


def test_near_copies_of_each_text_of_a_repeated_id(spark):
    """A doc_id with unlike texts is linked by each of them; ids may lie anywhere."""
    r, words = vocabulary(3, 4000)
    rows, want, top = [], {}, (1 << 63) - 1
    for g in range(12):
        own = 1000 + g if g % 2 else top - g
        for j in range(4):  # four unlike texts of one id, and a near copy of each elsewhere
            base = r.choices(words, k=90)
            copy = list(base)
            copy[r.randrange(90)] = "changed"
            other = g * 10 + j if g % 3 else -g * 10 - j - 1
            rows += [(own, " ".join(base)), (other, " ".join(copy)), (own, " ".join(base))]
            want |= {other: g, own: g}
    lone = [(5000, None), (5000, ""), (None, rows[0][1]), (5001, "a text alone"), (5001, "and another text")]
    df = spark.createDataFrame(rows + lone, "doc_id long, text string").repartition(3)
    got = [(x.doc_id, x.class_id) for x in neardup.near_duplicate_classes(df).collect()]
    first = {g: min(i for i in want if want[i] == g) for g in want.values()}
    assert sorted(got, key=str) == sorted([(i, first[want[i]]) for i, _ in rows] + [(5000, 5000), (5000, 5000), (None, None), (5001, 5001), (5001, 5001)], key=str)
    kept = neardup.one_of_each_class(df).collect()
    assert len(kept) == 4 * len(first) + 3 and {(r.doc_id, r.text) for r in kept} <= {(r.doc_id, r.text) for r in df.collect()}
    assert sorted(r.text for r in kept if r.doc_id == 5001) == ["a text alone", "and another text"]


def test_unlike_texts_of_one_id_stay(spark):
    rows = [(1, "alpha beta gamma delta epsilon zeta"), (1, "one two three four five six"), (1, "one two three four five six"), (None, "x y"), (None, "x z"), (None, None), (None, "")]
    df = spark.createDataFrame([(i, t, [k], "c") for k, (i, t) in enumerate(rows)], "doc_id long, text string, m array<int>, id string")
    kept = neardup.one_of_each_class(df)
    assert kept.columns == df.columns
    got = sorted((str(r.doc_id), r.text or "") for r in kept.collect())
    assert got == sorted([("1", rows[0][1]), ("1", rows[1][1]), ("None", "x y"), ("None", "x z"), ("None", ""), ("None", "")])
    assert neardup.one_of_each_class(df.limit(0)).count() == 0


def test_every_candidate_pair_verified(spark):
    """promising=0 drops no candidate on its signature; on the small tables that changes no class."""
    for folder in ("sf0.001", "sf0.01"):
        docs = spark.read.parquet(f"/root/testdata/{folder}/documents.parquet")
        a, b = ({r.doc_id: r.class_id for r in neardup.near_duplicate_classes(docs, least).collect()} for least in (neardup.PROMISING, 0.0))
        assert a == b


def test_hot_keys_and_hubs_are_spread(spark, monkeypatch):
    r, words = vocabulary(6, 4000)
    base = r.choices(words, k=150)
    texts = []
    for _ in range(160):
        copy = list(base)
        copy[r.randrange(150)] = r.choice(words)
        texts.append(" ".join(copy))
    texts += [" ".join(r.choices(words, k=40)) for _ in range(20)]
    want = brute_classes(list(enumerate(texts)))
    for hot, chars in ((5, 1 << 24), (30, 4_000)):
        monkeypatch.setattr(neardup, "HOT", hot)
        monkeypatch.setattr(neardup, "BLOCK_CHARS", chars)
        assert {r.doc_id: r.class_id for r in neardup.near_duplicate_classes(docs(spark, texts)).collect()} == want
    pairs = spark.range(1, 500).selectExpr("id as a", "0L as b")
    monkeypatch.setattr(neardup, "HOT", 50)
    salted, hubs = neardup.spread_hubs(pairs, 499)
    sizes = [r["count"] for r in salted.groupBy("b", "salt").count().collect()]
    assert len(sizes) == hubs.count() == 10 and max(sizes) < 100


def test_signature_estimates_similarity():
    rng = np.random.default_rng(3)
    for overlap in (0.5, 0.8, 0.95):
        n = 400
        common = rng.integers(1, 1 << 55, int(n * 2 * overlap / (1 + overlap)), dtype=np.uint64)
        sets = [np.sort(np.concatenate([common, rng.integers(1, 1 << 55, n - len(common), dtype=np.uint64)])) for _ in range(2)]
        counts = [rng.integers(1, 9, len(s)) for s in sets]
        counts[1][np.isin(sets[1], common)] = counts[0][np.isin(sets[0], common)]
        doc = np.repeat([0, 1], [len(s) for s in sets])
        sig = neardup.bag_signatures(doc, np.concatenate(sets), np.concatenate(counts), 2, 4096)
        true = neardup.similarity((sets[0], counts[0]), (sets[1], counts[1]))
        if true:
            assert abs((sig[0] == sig[1]).mean() - true) < 0.04


def test_shingles_are_windows_of_words():
    texts = ["", "A b", "a B", "the quick brown fox jumps over the quick brown fox jumps", "Ünïcode wörds über größe straße ok", "x" * 3_000_000 + " y", "a-b_c d1 e.f g"]
    d, h, n = shingles(texts)
    got = [sorted(n[d == i].tolist()) for i in range(len(texts))]
    assert got == [sorted(bag(t).values()) for t in texts]
    assert (h[d == 1] == h[d == 2]).all()
    assert len(word_hashes(code_points("Ab ab AB".lower()))[0]) == 3 and len(set(word_hashes(code_points("ab ab ab"))[0].tolist())) == 1


# ---- fingerprints ---------------------------------------------------------------------------


def canonical(t):
    import unicodedata

    x = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", t or "").casefold())
    return " ".join(x.split())


def test_fingerprints_against_python(spark):
    texts = ["Straße  ﬁn", "STRASSE\tfin ", "é", "é", "Ａ", "a", "", None, " \n", "abc", "ABC", "abd", "x" * 100_000, " q r", "q r"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.fingerprint for r in fingerprint.fingerprints(df).collect()}
    groups, want = defaultdict(set), defaultdict(set)
    for i, t in enumerate(texts):
        groups[got[i]].add(i)
        want[canonical(t)].add(i)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_collided_digests_get_apart(spark):
    rows = spark.createDataFrame([("f", "a"), ("f", "b"), ("f", "a"), ("g", "c"), ("g", "c")], "fp string, canon string")
    hit = fingerprint.collided_digests(rows)
    assert [r.fp for r in hit.collect()] == ["f"]
    named = rows.selectExpr("canon", "fp", "sha2(canon, 256) as chk")
    got = {(r.canon, r.fp) for r in fingerprint.resolved(named, hit, ("fp", "chk")).collect()}
    assert len(got) == 3 and ("c", "g") in got


def test_neighbour_report(spark):
    import hashlib

    texts = ["abcdefgh", None, "xyz", "Hello World again", "hello  world AGAIN", "", "𝄞𝄞𝄞𝄞ab", "same text here", "same text here"]
    ids = [5, 9, 12, 40, 41, 100, 101, 10_000, 10_001]
    df = spark.createDataFrame(list(zip(ids, texts, texts, strict=True)), "doc_id long, text string, cell string")
    with pytest.MonkeyPatch.context() as m:
        m.setattr(fingerprint, "ROWS_PER_CELL", 2)
        got = {r.doc_id: r for r in fingerprint.neighbour_report(df).collect()}
    full = [t or "" for t in texts]
    for k, i in enumerate(ids):
        t, after = full[k], full[(k + 1) % len(full)]
        q = len(t) // 4
        edited = t[: len(t) - q] + after[:q]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert r.near_edited == float(canonical(edited) == canonical(t)) and r.near_next == float(canonical(after) == canonical(t))
        assert (r.fingerprint == r.edited_fingerprint) == (canonical(edited) == canonical(t))
    assert got[40].fingerprint == got[41].fingerprint and got[10_000].fingerprint == got[10_001].fingerprint
    assert fingerprint.neighbour_report(df.limit(0)).count() == 0
    one = fingerprint.neighbour_report(df.filter("doc_id = 40")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0


def report_by_brute_force(rows):
    """(doc_id, edited digest) of each row: sorted by id, null first, equal ids by a hash of the text that only Spark knows; so of single ids alone."""
    import hashlib

    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    out = []
    for k, (i, t) in enumerate(rows):
        t, after = t or "", rows[(k + 1) % len(rows)][1] or ""
        q = len(t) // 4
        out.append((i, hashlib.sha256((t[: len(t) - q] + after[:q]).encode()).hexdigest()))
    return out


@pytest.mark.parametrize("per_cell", [1, 3, 1000])
def test_neighbours_of_outlying_and_clustered_ids(spark, monkeypatch, per_cell):
    monkeypatch.setattr(fingerprint, "ROWS_PER_CELL", per_cell)
    r = random.Random(8)
    ids = [1 << 60, -(1 << 62), None] + list(range(200)) + [10**9 + k for k in r.sample(range(50), 30)]
    rows = [(i, "".join(r.choices("abcd ", k=r.choice([0, 1, 7, 40])))) for i in ids] + [(500, "long " * 200_000)]
    got = fingerprint.neighbour_report(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert sorted(map(str, ((x.doc_id, x.edited_sha256) for x in got.collect()))) == sorted(map(str, report_by_brute_force(rows)))


def test_cells_are_even_wherever_ids_lie(spark, monkeypatch):
    monkeypatch.setattr(fingerprint, "ROWS_PER_CELL", 50)
    for ids in ([1 << 60] + list(range(2000)), [None] * 2001, [7] * 2001):
        rows = fingerprint._folded(spark.createDataFrame([(i, f"text {k}") for k, i in enumerate(ids)], "doc_id long, text string"))
        cuts = rows.select(fingerprint._key().alias("key"))
        bounds = sorted({tuple(x.key) for x in cuts.filter(F.pmod(F.xxhash64(F.lit(13), F.when(F.col("key.known"), F.col("key.id")), "key.h"), F.lit(50)) == 0).collect()})
        assert 15 < len(bounds) < 90
        plan = fingerprint.with_next(rows)
        assert plan.count() == 2001


def test_repeated_and_null_ids_in_the_report(spark, monkeypatch):
    monkeypatch.setattr(fingerprint, "ROWS_PER_CELL", 2)
    monkeypatch.setattr(fingerprint, "PORTION", 3)
    rows = [(1, "aaaa"), (1, "bbbb"), (None, "cccc"), (None, None), (2, "same text")] + [(3, "copy of it")] * 11 + [(None, "null too")] * 5
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = fingerprint.neighbour_report(df).collect()
    assert Counter((r.doc_id, r.n_chars) for r in got) == Counter((i, len(t or "")) for i, t in rows)
    copies = [r for r in got if r.doc_id == 3]
    assert sum(r.near_next for r in copies) == 10 and len({r.fingerprint for r in copies}) == 1
    assert sum(r.near_next for r in got if r.doc_id is None and r.n_chars == 8) == 4
    # Every row is the next one of exactly one: over each ring the first quarters that edits take are those of all rows.
    nexts = fingerprint.with_next(fingerprint._folded(df)).collect()
    assert Counter((r.next_id, r.next_text) for r in nexts) == Counter((r.doc_id, r.text) for r in nexts)


def test_rounds_over_few_edges_have_few_tasks(spark):
    """A chain, a star and a loop under 60 shuffle partitions: right classes, and no stage of 60 tasks a round."""
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(200, 200)]
    df, sc = spark.createDataFrame(edges, "a long, b long"), spark.sparkContext
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "60")
    try:
        sc.setJobGroup("rounds", "")
        got = {r[0]: r[1] for r in neardup.components(df).collect()}
        stages = {i for j in sc.statusTracker().getJobIdsForGroup("rounds") for i in sc.statusTracker().getJobInfo(j).stageIds}
        wide = [i for i in stages if (info := sc.statusTracker().getStageInfo(i)) and info.numTasks >= 60 and info.numCompletedTasks]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        sc._jsc.clearJobGroup()
    assert got == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(30)} | {200: 200}
    assert len(wide) <= 4, wide
