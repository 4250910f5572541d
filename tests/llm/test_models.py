import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrylens.llm import html_main, langid, lm, quality
from quarrylens.llm.common import fold

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_language_rows(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = langid.op2_language_id(spark, sf_dir).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert len(got) == docs.count() and np.mean([r.lang == r.lang_pred for r in held]) > 0.95
    assert all(0 <= r.score <= 1 for r in got)
    other = docs.withColumn("lang", F.when(fold("doc_id", 3, 1), F.lit("de")).otherwise(F.col("lang")))
    model = langid.fit_on(other.filter(~fold("doc_id", 3, 1)))
    again = {r.doc_id: r.lang_pred for r in langid.predict_languages(docs, model, ["doc_id"]).collect()}
    assert again == {r.doc_id: r.lang_pred for r in got}  # held-out labels play no part


def test_language_odd_rows(spark, sf_dir):
    model = langid.fit_on(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    rows = [(1, None), (2, ""), (3, "123 !!"), (None, "the and of"), (4, "the " * 200_000), (5, "日本語の文章です" * 20), (6, "a")]
    df = spark.createDataFrame([(i, t, "x", 1.0) for i, t in rows], "doc_id long, text string, lang_pred string, score double")
    got = {r.doc_id: r for r in langid.predict_languages(df, model, df.columns).collect()}
    assert len(got) == len(rows) and all((got[i].lang_pred, got[i].score, got[i].rejected) == ("und", 0.0, True) for i in (1, 2, 3))
    assert got[4].lang_pred == "en" and got[5].rejected and got[6].lang_pred != "und" and got[None].lang_pred == "en"
    none = langid.LanguageModel.fit([], [])
    assert none.predict(["abc"]) == [("und", 0.0, True)]
    assert langid.predict_languages(df.limit(0), model, ["doc_id"]).count() == 0
    empty = langid.fit_on(df.limit(0).selectExpr("doc_id", "text", "cast(null as string) as lang"))
    assert empty.langs == []


def test_unlearned_languages_are_rejected(spark, sf_dir):
    """At every length: a language nobody taught, random letters, and letters of another script."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = langid.fit_on(docs.filter(~fold("doc_id", 3, 1)))
    r = random.Random(5)
    finnish = "kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan heille on annettu järki ja omatunto ja heidän on toimittava toisiaan kohtaan veljeyden hengessä".split()
    for n in (20, 100, 400, 2000, 8000):
        texts = [" ".join(r.choices(finnish, k=n))]
        texts += [" ".join("".join(r.choices(letters, k=r.randint(2, 9))) for _ in range(n)) for letters in ("abcdefghijklmnopqrstuvwxyz", "αβγδεζηθικλμνξοπρστυφχψω", [chr(i) for i in range(0x4E00, 0x5E00)])]
        assert all(p[2] for p in model.predict(texts)), n
    held = [x.text for x in docs.filter(fold("doc_id", 3, 1)).filter("length(text) > 200").collect()]
    assert len(held) > 30 and not any(p[2] for p in model.predict(held))
    assert not any(p[2] for p in model.predict([t + " " + t for t in held]))


def brute_grams(text):
    x = re.sub(" +", " ", " " + "".join(c if c.isalpha() else " " for c in (text or "").lower()) + " ")
    return [x[i : i + k] for k in (1, 2, 3) for i in range(len(x) - k + 1) if not (k == 1 and x[i] == " ")]


def test_language_against_brute_force(spark, sf_dir):
    """TF-IDF vectors, cosines and softmax over dictionaries, written apart; buckets by the operator's hash of each n-gram."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = langid.fit_on(docs.filter(~fold("doc_id", 3, 1)))
    assert len(model.centroids) > len(model.langs)  # several a language
    texts = [r.text for r in docs.filter("length(text) > 0").orderBy("doc_id").limit(40).collect()] + ["Ab 1 cd", "é"]
    texts = [t[:400] for t in texts]

    def bucket(g):
        points = [np.uint64(ord(c)) for c in g]
        with np.errstate(over="ignore"):
            h = points[0] * np.uint64(0x9E3779B97F4A7C15)
            if len(g) == 1:
                h = h * np.uint64(0xD6E8FEB86659FD93)
            if len(g) > 1:
                h = (h ^ (points[1] * np.uint64(0xC2B2AE3D27D4EB4F))) * np.uint64(0xFF51AFD7ED558CCD)
            if len(g) > 2:
                h = (h ^ (points[2] * np.uint64(0x165667B19E3779F9))) * np.uint64(0xC4CEB9FE1A85EC53)
        return int(h) >> 52

    for t, (lang, score, _) in zip(texts, model.predict(texts), strict=True):
        n = {}
        for g in brute_grams(t):
            n[bucket(g)] = n.get(bucket(g), 0) + 1
        if not n:
            assert lang == "und"
            continue
        v = {b: math.log1p(c) * float(model.idf[b]) for b, c in n.items()}
        size = math.sqrt(sum(x * x for x in v.values()))
        best = {}
        for c, k in zip(model.centroids, model.owner, strict=True):
            cosine = sum(x * float(c[b]) for b, x in v.items()) / size
            best[model.langs[k]] = max(best.get(model.langs[k], -1), cosine)
        total = sum(math.exp(langid.SHARPNESS * x) for x in best.values())
        want = min(best, key=lambda name: (-best[name], name))
        assert lang == want and abs(score - math.exp(langid.SHARPNESS * best[want]) / total) < 1e-4


def test_language_ties_repeats_and_many_labels(spark, sf_dir):
    twin = langid.LanguageModel(["aa", "bb"], np.ones(langid.BUCKETS, np.float32), np.ones((2, langid.BUCKETS), np.float32) / 64, np.array([0, 1]), np.zeros(2), [(np.ones(1 << langid.KNOWN_BITS, bool), 1.0)] * 2)
    assert twin.predict(["any text"])[0][0] == "aa"  # a tie goes to the first in alphabetical order
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    again = docs.unionByName(docs.limit(1).crossJoin(spark.range(500)).drop("id"))  # a row that occurs 500 times more
    a, b = langid.fit_on(docs), langid.fit_on(again)
    assert a.langs == b.langs and np.allclose(a.idf, b.idf)
    with pytest.raises(ValueError, match="different values"):
        langid.fit_on(spark.range(1200).selectExpr("id as doc_id", "'some text' as text", "cast(id as string) as lang"))


def test_language_fit_spares_the_driver(spark, sf_dir):
    """Jobs don't grow with the partitions; weights make no whole copies of the vectors besides one."""
    import tracemalloc

    docs, sc = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.sparkContext
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "60")
    try:
        sc.setJobGroup("language fit", "")
        langid.fit_on(docs)
        assert len(sc.statusTracker().getJobIdsForGroup("language fit")) < 60
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        sc._jsc.clearJobGroup()
    raw = np.random.default_rng(0).random((2_000, langid.BUCKETS), dtype=np.float32)
    tracemalloc.start()
    got = langid.weighted(raw, raw[0])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 1.5 * raw.nbytes and np.allclose(np.linalg.norm(got, axis=1), 1, atol=1e-5)


def test_kmeans_and_grams():
    x = np.eye(4, dtype=np.float32)[[0, 0, 1, 1, 2, 3]]
    assert len({tuple(c) for c in langid.spherical_kmeans(x, 4, 0).round(3).tolist()}) == 4
    assert (langid.counts(["a b"]) == langid.counts(["A 1 B"])).all() and langid.counts(["ab"]).sum() == 2 + 3 + 2


def test_quality(spark, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    got = quality.op8_quality(spark, sf_dir).join(labels, "doc_id").collect()
    good, bad = ([r.score for r in got if r.quality == q] for q in (1, 0))
    assert np.mean([a > b for a in good for b in bad]) > 0.9
    assert all(r.predicted == int(r.score >= 0.7) and 0 <= r.score <= 1 for r in got)


def test_quality_odd_rows(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit_on(docs, labels)
    rows = [(1, None), (2, ""), (None, "x"), (3, "word " * 300_000), (3, "again")]
    df = spark.createDataFrame([(i, t, 5) for i, t in rows], "doc_id long, text string, predicted int")
    got = quality.score_quality(df, model, df.columns).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if not r.text}) == 1
    assert quality.score_quality(df.limit(0), model, ["doc_id"]).count() == 0
    assert quality.fit_on(docs, labels.filter("quality = 1")).score(np.zeros((2, len(quality.FEATURES)))).tolist() == [0.5, 0.5]
    assert quality.fit_on(docs, labels.limit(0)).scale == 0


def test_bradley_terry_orders_pairs():
    rng = np.random.default_rng(0)
    x = rng.random((600, len(quality.FEATURES)))
    y = (x[:, 0] + 0.05 * rng.standard_normal(600) > 0.3).astype(int)
    m = quality.QualityModel.fit(x, y, 1 - y.mean())
    s = m.score(x)
    assert np.mean(s[y == 1][:, None] > s[y == 0][None]) > 0.97
    assert abs((s >= quality.THRESHOLD).mean() - y.mean()) < 0.03  # the quantile of the threshold


def test_quality_against_brute_force():
    """Every pair a preference, plain gradient descent on the logistic loss, then the quantile: the same order and threshold."""
    rng = np.random.default_rng(3)
    x = rng.random((120, len(quality.FEATURES)))
    y = (x[:, 0] + x[:, 1] + 0.3 * rng.standard_normal(120) > 0.8).astype(int)
    share = float((y == 0).mean())
    m = quality.QualityModel.fit(x, y, share)
    hot = [[float(j == sum(v >= e for e in m.edges[f])) for f, v in enumerate(row) for j in range(quality.BINS + 1)] for row in x]
    assert np.allclose(hot, m.binned(x))
    hot = np.array(hot)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    d = np.array([hot[a] - hot[b] for a in good for b in bad])
    w = np.zeros(hot.shape[1])
    for _ in range(3000):
        p = 1 / (1 + np.exp(d @ w))
        w += 1.0 * (d.T @ p / len(d) - quality.L2 * w)
    assert np.corrcoef(hot @ w, m.raw(x))[0, 1] > 0.99
    ranked = sorted(m.raw(x))
    below = sum(v < m.centre for v in ranked) / len(ranked)
    assert abs(below - share) <= 1.5 / len(x)
    assert all((s >= quality.THRESHOLD) == (r >= m.centre) for s, r in zip(m.score(x), m.raw(x), strict=True))


def test_quality_repeated_labels_and_ids(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    plain = quality.fit_on(docs, labels)
    more = labels.unionByName(labels).unionByName(labels.limit(5).withColumn("quality", F.lit(None).cast(labels.schema["quality"].dataType)))
    twice = quality.fit_on(docs.unionByName(docs), more)
    assert np.allclose(plain.weights, twice.weights) and np.isclose(plain.centre, twice.centre)


def test_quality_learns_from_every_labelled_row(spark, monkeypatch):
    """9,300 labelled rows, more of one class than any sample held; broadcast or joined as levels, the fit of all of them at once."""
    texts = [" ".join(f"{'word' * (i % 3 + 1)}{i * j % 7}" for j in range(i % 11 + 3)) + "." * (i % 4) for i in range(9_000)] + ["# | " * (i % 9 + 1) + "a b C " * (i % 5) for i in range(300)]
    y = [1] * 9_000 + [0] * 300
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame(list(enumerate(y)), "doc_id long, quality int")
    want = quality.QualityModel.fit(quality.feature_rows(texts), np.array(y), 300 / 9_300)
    for limit in (200_000, 0):
        monkeypatch.setattr(quality, "BROADCAST_LABELS", limit, raising=False)
        got = quality.fit_on(docs, labels)
        assert np.array_equal(got.edges, want.edges) and np.allclose(got.weights, want.weights)
        assert np.isclose(got.centre, want.centre) and np.isclose(got.scale, want.scale)
        assert int((got.raw(quality.feature_rows(texts)) < got.centre).sum()) in range(295, 306)


# ---- main text ------------------------------------------------------------------------------


def test_blocks():
    page = "<html><head><title>T</title><script>var a='<p>x</p>'</script></head><body><!-- c --><ul><li>a<li>b</ul><p>one <b>two</b><br>three&amp;&nbsp;four<p>five <a href=x>link</a></div><p>6 &lt; 7<h"
    found = html_main.blocks(page)
    assert [b.text for b in found] == ["T", "a", "b", "one two three& four", "five link", "6 < 7"]
    assert found[4].linked > 0 and found[1].tag == "li" and html_main.blocks("") == []
    assert [b.text for b in html_main.blocks("a < b <3 & c")] == ["a < b <3 & c"]
    assert html_main.blocks("<script>never closed <p>x") == []


def test_labeller_gradients():
    rng = np.random.default_rng(1)
    m = html_main.Labeller(3)
    m.p = {k: v.astype(np.float64) for k, v in m.p.items()}
    x = rng.standard_normal((4, 2, html_main.PATH + html_main.WORDS + html_main.SHAPE))
    y, mask = rng.integers(0, 2, (4, 2)).astype(float), np.array([[1, 1], [1, 1], [1, 0], [1, 0]], float)

    def loss():
        p = m.scores(x, mask)
        return -(mask * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum() / mask.sum()

    g = m.gradients(x, y, mask)
    for name in ("in", "fx", "bh", "fc", "out"):
        i = tuple(rng.integers(0, n) for n in m.p[name].shape)
        old = m.p[name][i]
        m.p[name][i] = old + 1e-3
        up = loss()
        m.p[name][i] = old - 1e-3
        down = loss()
        m.p[name][i] = old
        assert abs((up - down) / 2e-3 - g[name][i]) < 2e-3


def test_held_out_layouts():
    pages = html_main.training_pages(150, 999)
    got = html_main.trained().label([x for x, _ in pages])
    assert np.mean(np.concatenate([a == (y > 0) for a, (_, y) in zip(got, pages, strict=True)])) > 0.97


def test_extraction(spark, sf_dir):
    page = "<html><body><nav><ul><li><a href=/>Home</a></li></ul></nav><article><h1>Big  title</h1><p>First &amp; best.</p><p>Second\n one.</p></article><div class='comments'><p>Nice post, thanks.</p></div><footer>&copy; me</footer></body></html>"
    df = spark.createDataFrame([(1, "u", page, "x"), (2, None, None, "y"), (None, "v", "", "z"), (3, "w", "<p>" * 3, "q")], "page_id long, url string, html string, text string")
    got = {r.page_id: (r.text, r.n_chars) for r in html_main.extract_main(df, ["page_id", "url"]).collect()}
    want = "Big title\nFirst & best.\nSecond one."
    assert got == {1: (want, len(want)), 2: ("", 0), None: ("", 0), 3: ("", 0)}
    assert html_main.extract_main(df.limit(0), ["page_id"]).count() == 0
    assert html_main.op3_html_text(spark, sf_dir).filter("n_chars > 0").count() == 50


def scalar_scores(model, page):
    """The network written out for one page, step by step and unit by unit."""
    p = {k: v.astype(float).tolist() for k, v in model.p.items()}
    sig = lambda z: 1 / (1 + math.exp(-z))
    dot = lambda x, m, j: sum(a * row[j] for a, row in zip(x, m, strict=True))
    e = [[math.tanh(dot(x, p["in"], j) + p["inb"][j]) for j in range(html_main.INNER)] for x in page.tolist()]
    both = {}
    for side, order in (("f", range(len(e))), ("b", range(len(e) - 1, -1, -1))):
        h, c = [0.0] * html_main.HIDDEN, [0.0] * html_main.HIDDEN
        both[side] = [None] * len(e)
        for t in order:
            z = [dot(e[t], p[side + "x"], j) + dot(h, p[side + "h"], j) + p[side + "c"][j] for j in range(4 * html_main.HIDDEN)]
            n = html_main.HIDDEN
            c = [sig(z[n + u]) * c[u] + sig(z[u]) * math.tanh(z[3 * n + u]) for u in range(n)]
            h = [sig(z[2 * n + u]) * math.tanh(c[u]) for u in range(n)]
            both[side][t] = h
    return [sig(dot(both["f"][t] + both["b"][t] + e[t], p["out"], 0) + p["outb"][0]) for t in range(len(e))]


def test_network_against_scalar_form():
    model = html_main.trained()
    pages = [x for x, _ in html_main.training_pages(6, 321)]
    x, mask = html_main._padded(pages)
    got = model.scores(x, mask)
    for k, page in enumerate(pages):
        assert np.allclose(got[: len(page), k], scalar_scores(model, page), atol=1e-4)


def test_all_words_of_a_block_count():
    base = [f"w{i}" for i in range(400)]
    v = html_main.word_vector(" ".join(base))
    for k in (0, 100, 200, 399):
        other = [*base[:k], "different", *base[k + 1 :]]
        slots = [html_main.zlib.crc32(w.encode()) for w in (base[k], "different")]
        if slots[0] % html_main.WORDS != slots[1] % html_main.WORDS:
            assert not np.allclose(html_main.word_vector(" ".join(other)), v)
    assert np.allclose(html_main.word_vector(" ".join(reversed(base))), v) and not html_main.word_vector("").any()


def test_article_texts_of_the_tables(spark):
    """At least 99 of 100 pages equal the text of their article element, block by block."""
    rows = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").select("page_id", "html").collect()
    found = [html_main.blocks(r.html or "") for r in rows]
    labels = html_main.trained().label([html_main.vectors(f) for f in found])
    same = 0
    for r, f, y in zip(rows, found, labels, strict=True):
        article = re.search(r"<article\b[^>]*>(.*?)</article>", r.html, re.S)[1]
        same += "\n".join(b.text for b, k in zip(f, y, strict=True) if k) == "\n".join(b.text for b in html_main.blocks(article))
    assert same >= 0.99 * len(rows)


def test_long_tied_and_repeated_pages(spark):
    prose = " ".join(f"Sentence number {i} of this article, which goes on." for i in range(40_000))
    page = f"<html><body><nav><ul><li><a href=/>Home</a></li></ul></nav><article><h1>Title</h1><p>{prose}</p><p>Last words.</p></article><footer>&copy; me</footer></body></html>"
    rows = [(1, "u", page), (1, "u", page), (1, "v", "<article><h1>Other</h1><p>Words of the other page.</p></article>"), (2, "w", "<article>" + "<p>Same line.</p>" * 5_000 + "</article>")]
    got = html_main.extract_main(spark.createDataFrame(rows, "page_id long, url string, html string"), ["page_id", "url"]).collect()
    assert len(got) == 4 and [r.text for r in got if r.url == "u"] == ["Title\n" + prose + "\nLast words."] * 2
    assert next(r.text for r in got if r.url == "w") == "\n".join(["Same line."] * 5_000)


# ---- language model -------------------------------------------------------------------------


def brute_scores(texts, order=3):
    words = [re.findall(r"\w+", (t or "").lower()) for t in texts]
    own = [Counter(tuple(w[i : i + k]) for k in range(1, order + 1) for i in range(len(w) - k + 1)) for w in words]
    total = sum(own, Counter())
    n = sum(map(len, words))
    out = []
    for w, mine in zip(words, own, strict=True):
        c = lambda g, mine=mine: total[g] - mine[g]
        s = 0.0
        for i in range(len(w)):
            v = max(c((w[i],)), 0.5) / max(n - len(w), 1)
            for k in range(1, order):
                if i >= k:
                    g = tuple(w[i - k : i + 1])
                    v = c(g) / c(g[:-1]) if c(g) > 0 and c(g[:-1]) > 0 else lm.BACKOFF * v
            s += math.log(v)
        out.append((len(w), s))
    return out


def test_backoff_against_brute_force(spark, monkeypatch):
    r = random.Random(4)
    texts = [" ".join(r.choices("alpha beta gamma delta eps zeta Ünder_score".split(), k=r.choice([0, 1, 2, 3, 50]))) for _ in range(60)] + [None, "!!", "beta " * 20_000]
    monkeypatch.setattr(lm, "BLOCK_CHARS", 9_000)
    monkeypatch.setattr(lm, "BUCKET_CHARS", 12_000)
    df = spark.createDataFrame([(i, t, 1.0) for i, t in enumerate(texts)], "doc_id long, text string, log_score double")
    got = {r.doc_id: r for r in lm.backoff_scores(df).collect()}
    for i, (n, s) in enumerate(brute_scores(texts)):
        assert got[i].n_words == n and abs(got[i].log_score - s) < 1e-6 * max(1, abs(s))
        assert (got[i].mean_log_score is None) == (n == 0)
    assert lm.backoff_scores(df.limit(0)).count() == 0


def test_backoff_of_null_and_repeated_ids(spark, monkeypatch):
    """Each row is scored by itself, with its own counts left out; a huge group of equal rows is many blocks."""
    monkeypatch.setattr(lm, "BLOCK_CHARS", 40)
    monkeypatch.setattr(lm, "BUCKET_CHARS", 50)
    monkeypatch.setattr(lm, "PORTION", 3)
    rows = [(None, "a b"), (None, "a b"), (None, "a b c"), (1, "a c"), (1, "a c"), (1, "b a c"), (2, None), (3, "a b c d")] + [(7, "the same heading and more")] * 25
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((str(r.doc_id), r.n_words, round(r.log_score, 9)) for r in lm.backoff_scores(df).collect())
    assert got == sorted((str(i), n, round(s, 9)) for (i, _), (n, s) in zip(rows, brute_scores([t for _, t in rows]), strict=True))
    own = spark.createDataFrame([(None, "x y z " * 9 + str(i)) for i in range(300)], "doc_id long, text string")
    sizes = [r["count"] for r in lm._dealt(own, 30).groupBy("block").count().collect()]
    assert sum(sizes) == 300 and max(sizes) < 40
    same = spark.createDataFrame([(None, "x y z")] * 300, "doc_id long, text string")
    sizes = [r["count"] for r in lm._dealt(same, 30).groupBy("block").count().collect()]
    assert sum(sizes) == 300 and max(sizes) < 40


def test_count_tables(spark):
    df = spark.createDataFrame([(i, "one two one" if i % 2 else "two one", i % 3) for i in range(12)], "doc_id long, text string, block int")
    tables = lm.count_tables(lm.exploded_ngrams(df, 2, 4)).collect()
    counted = {}
    for t in tables:
        if t.bucket != lm.WORDS:
            values = np.cumsum(lm.unpack_numbers(t.codes), dtype=np.uint64)
            counted |= {(t.bucket, int(c)): int(n) for c, n in zip(values, lm.unpack_numbers(t.counts), strict=True)}
    one, two = lm.grams("two one", 2)
    want = {int(two[0]): 12, int(one[1]): 18, int(one[0]): 12, int(lm.grams("one two", 2)[1][0]): 6}
    assert counted == {(int(lm.bucket_of(np.array([h], dtype=np.uint64), 4)[0]), h >> (64 - lm.CODE_BITS)): n for h, n in want.items()}


def test_number_packing():
    x = np.array([0, 1, 255, 1 << 41, (1 << 63) + 5], dtype=np.uint64)
    assert (lm.unpack_numbers(lm.pack_numbers(x)) == x).all() and len(lm.unpack_numbers(lm.pack_numbers(x[:0]))) == 0
    assert len(lm.pack_numbers(np.ones(10_000, dtype=np.int64))) < 100
