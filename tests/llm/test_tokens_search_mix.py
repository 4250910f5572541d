import json
import os
import random
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrylens.llm import ann, catalog, mixing, packing, tokencount
from quarrylens.llm.bpe import bpe


def test_fast_and_reference_ids_agree():
    r = random.Random(1)
    alphabet = [chr(i) for i in range(1, 0x250)] + list("‐‧‰⁞€←↓−  \n\n  '' 's 'll don't AB12") * 8
    b = bpe()
    for _ in range(400):
        t = "".join(r.choices(alphabet, k=r.randint(0, 60)))
        assert b.fast.encode_ordinary(t) == b.slow.encode(t, add_special_tokens=False).ids
    for t in ("日本語 text", "🎉 x", "á", "ᚠ", "<|endoftext|>"):
        assert b.ids(t).tolist() == b.slow.encode(t, add_special_tokens=False).ids


def test_tree_after_any_edits():
    r = random.Random(2)
    counter = tokencount.Counter(bpe())
    pieces = ["'re", "'s", " ", "  ", "\n\n ", "a", " don't", "9", "###", "é", "x y", "'", "", "re", "日本"]
    for k in range(300):
        text = "".join(r.choices(pieces, k=r.choice([0, 1, 5, 60, 800])))
        tree = tokencount.TokenTree(text, counter)
        for _ in range(4):
            n = len(tree.text)
            a = r.randint(0, n)
            b = min(n, a + r.choice([0, 0, 1, 2, 5, 200]))
            new = "".join(r.choices(pieces, k=r.choice([0, 1, 3, 300 if k % 9 == 0 else 2])))
            want = tree.text[:a] + new + tree.text[b:]
            tree.edit(a, b, new)
            found = counter.cut.findall(want)
            assert tree.text == want and (tree.pretokens, tree.tokens) == (len(found), len(bpe().ids(want)))
        for i in range(1, tree.size):
            assert tree.sums[i] == tuple(x + y for x, y in zip(tree.sums[2 * i], tree.sums[2 * i + 1], strict=True))


def test_small_edit_of_a_long_text_encodes_little():
    tree = tokencount.TokenTree("some words in a row, " * 20_000, tokencount.Counter(bpe()))
    tree.edit(200_000, 200_004, "other")
    assert tree.encoded < 12 and tree.tokens == len(bpe().ids(tree.text))


def test_token_count_rows(spark, sf_dir):
    rows = [(1, None, None), (2, "", [(0, 0, "x y")]), (None, "abc", [(-5, 99, None)]), (3, "a b c", [(1, 1, "'s"), None]), (3, "it" * 50_000, [(5, 3, "z")])]
    df = spark.createDataFrame(rows, "doc_id long, text string, edits array<struct<begin:int,finish:int,words:string>>").withColumn("n_tokens", F.lit("clash"))
    got = tokencount.count_tokens(df).collect()
    assert [(r.n_tokens, r.edited_chars, r.edited_tokens) for r in got[:4]] == [(0, 0, 0), (0, 3, 2), (1, 0, 0), (3, 7, 4)]
    assert tokencount.count_tokens(df.limit(0)).count() == 0
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    edited = {r.doc_id: r for r in tokencount.sample_edits(docs).collect()}
    for r in tokencount.op6_token_counts(spark, sf_dir).collect():
        text = edited[r.doc_id].text
        assert r.n_tokens == len(bpe().ids(text))
        for e in edited[r.doc_id].edits:
            text = text[: e.begin] + e.words + text[e.finish :]
        assert (r.edited_chars, r.edited_tokens) == (len(text), len(bpe().ids(text)))


# ---- packing --------------------------------------------------------------------------------


@pytest.mark.parametrize("lengths", [[], [1], [1024], [1025], [3, 5, 1000, 64], [17] * 500, [5000, 1, 1, 1], [random.Random(3).randint(1, 4000) for _ in range(700)]])
def test_pack_lengths(lengths):
    windows = packing.pack_lengths(lengths)
    seen = {}
    short = 0
    for w in windows:
        size = sum(p[0] for p in w)
        short += size not in packing.TIERS
        assert 0 < size <= 1024
        for n, doc, start in w:
            assert n > 0
            seen.setdefault(doc, []).append((start, n))
    for doc, n in enumerate(lengths):
        at = 0
        for start, m in sorted(seen[doc]):
            assert start == at
            at += m
        assert at == n
    assert short <= 1


def test_step_groups_are_even():
    r = random.Random(5)
    sizes = [r.choice(packing.TIERS) for _ in range(2000)]
    loads = np.bincount(packing.step_groups(sizes, 65536), weights=sizes)
    assert loads.max() - loads.min() <= 1024


def test_pack_round_trip(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    docs = docs.unionByName(spark.createDataFrame([(10_000, None), (10_001, ""), (10_002, "word " * 30_000), (10_003, "日本語")], docs.schema)).withColumn("length", F.lit("clash"))
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    pieces = packing.pack(docs).collect()
    by_doc, by_seq = {}, {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
        by_seq.setdefault(p.sequence_id, []).append(p)
    assert set(by_doc) == set(texts)
    for i, t in texts.items():
        ids = np.append(bpe().slow.encode(t, add_special_tokens=False).ids, 0).astype("<u4")
        at = 0
        for p in sorted(by_doc[i], key=lambda p: p.start):
            assert (p.start, p.doc_tokens, p.ids_crc32) == (at, len(ids), zlib.crc32(ids[p.start : p.start + p.length].tobytes()))
            at += p.length
        assert at == len(ids)
    padding = total = 0
    for s in by_seq.values():
        at = 0
        for p in sorted(s, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        total += at
        padding += 0 if at & (at - 1) == 0 else 1024 - at
    assert padding < 0.02 * total
    assert packing.pack(docs.limit(0)).count() == 0
    again = spark.createDataFrame([(None, "a"), (7, "b c"), (7, "b c")], "doc_id long, text string")
    assert packing.pack(again).count() >= 3


# ---- search ---------------------------------------------------------------------------------


def brute_search(ids, x, query, k=20):
    s = x @ x[ids.index(query)]
    order = sorted((i for i in range(len(ids)) if ids[i] != query), key=lambda i: (-s[i], ids[i]))
    return [ids[i] for i in order[:k]]


def test_hadamard_and_cells():
    x = np.random.default_rng(0).standard_normal((50, 64))
    y = ann.rotated(x, 3)
    assert np.allclose(np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1)) and np.allclose(x @ x.T, y @ y.T)
    for k in (1, 2, 3):
        own, near = ann.cells(x, 1, k), ann.probed(x, 1, k, 40)
        assert near.shape == (50, 40) and own.max() < 128**k and (near == own[:, None]).any(1).all()
        axes = ann._axes(x[:2], 1, k)
        for i in range(2):  # the forty largest of all sums
            sums = axes[0][i]
            for y in axes[1:]:
                sums = (sums[:, None] + y[i][None]).reshape(-1)
            assert set(np.argsort(-sums)[:40]) == set(near[i])


def test_finer_cells_and_fewer_of_them_as_the_index_grows():
    assert [ann.rotations(n) for n in (10, 500, 10**6, 10**7, 10**9)] == [2, 2, 2, 3, 4]
    shares = [ann.TABLES * ann.probes(n, 128, ann.rotations(n)) / 128 ** ann.rotations(n) for n in (500, 2_000, 10_000, 10**6, 10**7, 10**9)]
    assert shares == sorted(shares, reverse=True) and shares[-1] < 0.01


def scored_share(x, queries):
    """The share of the vectors that lie in a query's probed cells, by the operator's own functions."""
    n, k = len(x), ann.rotations(len(x))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    seen = np.zeros((len(queries), n), dtype=bool)
    for t in range(ann.TABLES):
        c = ann.cells(unit, t, k)
        for i, p in enumerate(ann.probed(unit[queries], t, k, ann.probes(n, 2 * x.shape[1], k))):
            seen[i] |= np.isin(c, p)
    return seen


def test_scored_share_falls(spark):
    shares = []
    for folder in ("sf0.01", "sf0.1"):
        rows = spark.read.parquet(f"/root/testdata/{folder}/embeddings.parquet").collect()
        x = np.array([r.embedding for r in rows], dtype=float)
        q = np.array([i for i, r in enumerate(rows) if r.vec_id % 20 == 0])
        seen = scored_share(x, q)
        s = x[q] @ x.T
        s[np.arange(len(q)), q] = -np.inf
        top = np.argsort(-s, axis=1)[:, :20]
        assert np.take_along_axis(seen, top, 1).mean() >= 0.9
        shares.append(seen.mean())
    assert shares[1] < 0.8 * shares[0]


def test_recall_of_clustered_vectors_and_of_three_rotations(spark):
    r = np.random.default_rng(7)
    centres = r.standard_normal((40, 64))
    x = centres[r.integers(0, 40, 3000)] + 0.6 * r.standard_normal((3000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids = list(range(3000))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for row in ann.search(df, F.col("vec_id") % 100 == 0).collect():
        got.setdefault(row.query_id, set()).add(row.vec_id)
    assert np.mean([len(v & set(brute_search(ids, x, q))) / 20 for q, v in got.items()]) >= 0.95
    entries = df.selectExpr("vec_id as id", "embedding as emb")
    found = {}
    for row in ann.nearest_entries(entries.filter("id % 100 = 0"), entries, None, 21, 3000, 3).collect():
        found.setdefault(row.query, set()).add(row.id)
    assert np.mean([len(v & set(brute_search(ids, x, q))) / 20 for q, v in found.items()]) >= 0.9


def test_recall(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()
    ids, x = [r.vec_id for r in rows], np.array([r.embedding for r in rows], dtype=float)
    got = {}
    for r in ann.op4_ann(spark, sf_dir).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(got) == {i for i in ids if i % 20 == 0}
    hits = []
    for q, found in got.items():
        found.sort()
        assert [f[0] for f in found] == list(range(1, 21)) and all(abs(f[2] - float(x[ids.index(f[1])] @ x[ids.index(q)])) < 1e-12 for f in found)
        hits.append(len({f[1] for f in found} & set(brute_search(ids, x, q))) / 20)
    assert np.mean(hits) >= 0.9


def test_unequal_norms_copies_and_bad_vectors(spark):
    r = np.random.default_rng(4)
    rows = [(i, (r.standard_normal(8) * r.uniform(0.1, 5)).tolist()) for i in range(120)]
    rows += [(200 + i, rows[3][1]) for i in range(60)]
    bad = [(400, None), (420, [0.0] * 8), (440, [float("nan")] + [1.0] * 7), (460, [None] + [1.0] * 7), (480, []), (None, [1.0] * 8), (500, [float("inf")] + [1.0] * 7)]
    other = [(600, [1.0, 2.0]), (601, [2.0, 1.0])]
    df = spark.createDataFrame([(i, v, "c") for i, v in rows + bad + other], "vec_id long, embedding array<double>, score string")
    got = {}
    for x in ann.search(df, F.col("vec_id") % 20 == 0).collect():
        got.setdefault(x.query_id, []).append((x["rank"], x.vec_id, x.score))
    ids, x = [i for i, _ in rows], np.array([v for _, v in rows])
    assert set(got) == {i for i in ids if i % 20 == 0} | {600}
    assert got[600] == [(1, 601, 4.0)]
    hits = []
    for q in set(got) - {600}:
        found = [v for _, v, _ in sorted(got[q])]
        assert q not in found and len(found) == 20
        scores = [round(s, 9) for _, _, s in sorted(got[q])]
        assert scores == sorted(scores, reverse=True)
        for a, b in zip(sorted(got[q]), sorted(got[q])[1:], strict=False):
            assert a[2] > b[2] or a[1] < b[1]
        hits.append(len(set(found) & set(brute_search(ids, x, q))) / 20)
    assert np.mean(hits) >= 0.9
    assert ann.search(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    few = df.filter("vec_id < 5")
    assert ann.search(few, F.col("vec_id") == 0).count() == 4


def test_blocks_of_hot_cells(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK_BYTES", 8 * 8 * 3)
    r = np.random.default_rng(5)
    near = [(i, (np.array([1.0] + [0.0] * 7) + 0.01 * r.standard_normal(8)).tolist()) for i in range(150)]
    df = spark.createDataFrame(near, "vec_id long, embedding array<double>")
    got = {}
    for x in ann.search(df, F.col("vec_id") % 20 == 0).collect():
        got.setdefault(x.query_id, set()).add(x.vec_id)
    ids, x = [i for i, _ in near], np.array([v for _, v in near])
    x32 = x
    assert np.mean([len(v & set(brute_search(ids, x32, q))) / 20 for q, v in got.items()]) >= 0.9


# ---- mixing ---------------------------------------------------------------------------------


def test_mix_hits_target_weights(spark):
    df = spark.range(40_000).selectExpr("id as doc_id", "case when id % 10 < 6 then 'hot' when id % 10 < 9 then 'b' end as source", "'t' as text")
    got = {r.source: r["count"] for r in mixing.poisson_mix(df, {"hot": 1.0, "b": 2.0, None: 1.0}).groupBy("source").count().collect()}
    assert abs(got["hot"] / 10_000 - 1) < 0.05 and abs(got["b"] / 20_000 - 1) < 0.05 and abs(got[None] / 10_000 - 1) < 0.05
    twice = mixing.poisson_mix(df, {"hot": 1.0}, epochs=200.0).groupBy("doc_id").agg(F.count("*").alias("n"), F.max("n_copies").alias("m"))
    row = twice.agg(F.avg("n").alias("mean"), F.variance("n").alias("var"), F.max(F.abs(F.col("n") - F.col("m"))).alias("gap"), F.count("*").alias("docs")).first()
    assert row.docs == 24_000 and row.gap == 0 and abs(row["mean"] / (200 / 0.6) - 1) < 0.01 and abs(row["var"] / row["mean"] - 1) < 0.1


def test_mix_is_poisson(spark):
    df = spark.range(50_000).selectExpr("id as doc_id", "'s' as source")
    n = dict(mixing.poisson_mix(df).groupBy("doc_id").count().groupBy("count").count().collect())
    for k, p in ((1, 0.3679), (2, 0.1839), (3, 0.0613)):
        assert abs(n[k] / 50_000 - p) < 0.01


def test_mix_odd_rows(spark, monkeypatch):
    df = spark.createDataFrame([(None, None, "x", 1), (1, "a", None, 2), (1, "a", "y", 3), (2, "a", "", 4)], "doc_id long, source string, text string, copy int")
    got = mixing.poisson_mix(df, epochs=30.0).collect()
    counts = {}
    for r in got:
        counts.setdefault((r.doc_id, r.text), []).append(r.copy)
    assert all(sorted(v) == list(range(len(v))) for v in counts.values()) and len(counts) == 4
    assert len(counts[1, None]) != len(counts[1, "y"])  # unlike rows of one doc_id draw by themselves
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    assert sorted(map(str, mixing.poisson_mix(df, epochs=30.0).collect())) == sorted(map(str, got))
    assert mixing.poisson_mix(df.limit(0)).count() == 0


def test_mix_of_many_null_and_repeated_ids(spark, monkeypatch):
    """Totals hit the targets, and copies spread over all partitions, where doc_id tells nothing apart."""
    monkeypatch.setattr(mixing, "PORTION", 100)
    for ids, texts in (("cast(null as long)", "concat('text ', id)"), ("7L", "'the same text'"), ("cast(null as long)", "cast(null as string)")):
        df = spark.range(2000).selectExpr(f"{ids} as doc_id", "'s' as source", f"{texts} as text", "map('k', 1) as extra")
        got = mixing.poisson_mix(df, epochs=3.0)
        assert got.select("shuffle_key").distinct().count() == got.count() and abs(got.count() / 6000 - 1) < 0.05
        assert sorted(map(str, got.collect())) == sorted(map(str, mixing.poisson_mix(df.repartition(7), epochs=3.0).collect()))
    n = dict(mixing.poisson_mix(df, epochs=1.0).groupBy("n_copies").count().collect())
    assert abs(n[1] / 2000 - 0.368) < 0.05 and abs(n[2] / 2 / 2000 - 0.184) < 0.05


def test_mix_of_long_texts_and_unmarked(spark):
    df = spark.createDataFrame([(1, "a", "long " * 300_000, "mine", 5), (2, "a", None, "its", 6)], "doc_id long, source string, text string, copy string, shuffle_key int")
    got = mixing.poisson_mix(df, epochs=20.0, marks=False)
    assert got.columns == df.columns and got.schema["copy"].dataType.simpleString() == "string"
    assert set(map(tuple, got.collect())) == set(map(tuple, df.collect())) and got.count() > 20


# ---- registered SQL -------------------------------------------------------------------------


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_sql(spark, sf_dir, tmp_path, name):
    df = catalog.queries()[name](spark, sf_dir)
    df.write.parquet(str(tmp_path / "out"))
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.execute(f"create view {f[:-8]} as select * from '{sf_dir}/{f}'")
    con.execute(f"create table want as {catalog.oracle_sql()[name]}")
    con.execute(f"create table got as select * from '{tmp_path}/out/*.parquet'")
    c = ", ".join(df.columns)
    for a, b in (("want", "got"), ("got", "want")):
        assert con.execute(f"select {c} from {a} except all select {c} from {b} limit 3").fetchall() == []


def plain_pipeline(spark, docs, sf_dir):
    """Kept ids after each of the first three stages, and copies after the fourth, by other means: predict(), brute-force classes, exact Poisson counts."""
    import hashlib
    import math
    from collections import Counter

    from test_dedup import brute_classes

    from quarrylens.llm import langid, quality
    from quarrylens.llm.common import fold

    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    model = langid.fit_on(docs.filter(~fold("doc_id", 3, 1)))
    rows = [r for r, p in zip(rows, model.predict([r[1] for r in rows]), strict=True) if not p[2]]
    kept = [sorted(r[0] for r in rows)]
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    left = docs.join(spark.createDataFrame([(r[0],) for r in rows], "doc_id long"), "doc_id")
    model = quality.fit_on(left.filter(~fold("doc_id", 4, 2)), labels.filter(~fold("doc_id", 4, 2)))
    rows = [r for r, s in zip(rows, model.score(quality.feature_rows([r[1] for r in rows])), strict=True) if s >= 0.5]
    kept.append(sorted(r[0] for r in rows))
    classes = brute_classes([(r[0], r[1]) for r in rows])
    rows = [r for r in rows if classes[r[0]] == r[0]]
    kept.append(sorted(r[0] for r in rows))
    of = Counter(r[2] for r in rows)
    weight = {s: math.sqrt(n) for s, n in of.items()}
    copies = []
    for i, _, s in rows:
        mean = weight[s] / sum(weight.values()) * len(rows) / of[s]
        u = int(hashlib.md5(f"mix-1:{i}:1".encode()).hexdigest()[:13], 16) / 2**52
        k, p = 0, math.exp(-mean)
        c = p
        while c <= u and k < 60:
            k += 1
            p *= mean / k
            c += p
        copies += [i] * k
    return [*kept, sorted(copies)]


def test_pipeline(spark, sf_dir):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = plain_pipeline(spark, docs, sf_dir)
    for (name, stage), ids in zip(cp.STAGES[:-1], want, strict=True):
        before = docs
        docs = spark.createDataFrame(stage(spark, docs, sf_dir).collect(), docs.schema)
        assert docs.columns == before.columns and sorted(r.doc_id for r in docs.collect()) == ids, name
    texts = sorted((r.doc_id, len(bpe().ids(r.text or "")) + 1) for r in docs.collect())
    pieces = cp.run(spark, sf_dir).collect()
    tokens = {r.doc_id: r.doc_tokens for r in pieces}
    assert sum(r.length for r in pieces) == sum(n for _, n in texts) and tokens == dict(texts)
    assert cp.ORACLE_SQL is None and json.dumps([n for n, _ in cp.STAGES])


def test_pipeline_stages_on_odd_rows(spark, sf_dir):
    """Nulls, empty and long texts, ties, repeated rows, no rows, and columns named like those the operators add."""
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    some = [r.text for r in docs.filter("length(text) > 300").orderBy("doc_id").limit(6).collect()]
    texts = [(None, None), (1, None), (2, ""), (3, some[0]), (4, some[0]), (5, some[1]), (5, some[1]), (6, some[2]), (6, some[3]), (None, some[4]), (7, some[5] + " " + " ".join(some) * 400), (8, "123")]
    names = ["lang_pred", "score", "rejected", "predicted", "copy", "n_copies", "shuffle_key", "n_chars", "class_id", "x", "id", "_k0", "key"]
    schema = "doc_id long, text string, lang string, source string, " + ", ".join(f"{n} string" for n in names)
    odd = spark.createDataFrame([(i, t, None, None, *(f"{n}-{k}" for n in names)) for k, (i, t) in enumerate(texts)], schema)
    whole = docs.select("doc_id", "text", "lang", "source", *(F.concat(F.lit(f"{n}-"), F.col("doc_id")).alias(n) for n in names)).filter("doc_id > 8")
    table = whole.unionByName(odd)
    mine = {tuple(r) for r in table.collect()}
    kept = {}
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, table, sf_dir)
        assert out.columns == table.columns, name
        rows = [tuple(r) for r in out.collect()]
        assert set(rows) <= mine, name  # every column as it came, whatever its name
        kept[name] = [(r[0], r[1]) for r in rows if r[4].split("-")[1] in map(str, range(12)) and r in {tuple(x) for x in odd.collect()}]
        assert stage(spark, table.limit(0), sf_dir).count() == 0, name
    assert sorted(str(i) for i, _ in kept["language ID"]) == sorted(["3", "4", "5", "5", "6", "6", "None", "7"])
    assert sorted(str(i) for i, _ in kept["MinHash near-dedup"]).count("6") == 2 and [i for i, _ in kept["MinHash near-dedup"]].count(5) == 1 and 4 not in [i for i, _ in kept["MinHash near-dedup"]]
    pieces = cp.pack_sequences(spark, odd.withColumn("offset", F.lit("mine")), sf_dir).collect()
    assert sum(p.length for p in pieces) == sum(len(bpe().ids(t or "")) + 1 for _, t in texts)
    assert cp.pack_sequences(spark, odd.limit(0), sf_dir).count() == 0


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    from types import SimpleNamespace

    from quarrylens.storage import shared_folder

    unset = SimpleNamespace(get=lambda k, d=None: d)
    for master, works in (("local[4]", True), ("spark://host:7077", False), ("yarn", False), ("local-cluster[2,1,1024]", False)):
        session = SimpleNamespace(conf=unset, sparkContext=SimpleNamespace(master=master))
        if works:
            assert shared_folder(session)
        else:
            with pytest.raises(RuntimeError, match="checkpoint"):
                shared_folder(session)
    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")
