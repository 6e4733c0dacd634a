"""Language ID and toxicity on held-out rows, their cases, and the pipeline against its stages."""

import itertools
import math
import random
import string
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from corvane.llm import common, langid, packing, toxicity

WORDS = {"aa": "lorem ipsum dolor amet".split(), "bb": "kjør fjord bølge skog".split(), "cc": "щука дерево луна ветер".split()}


def text_of(rng, lang, n=30):
    return " ".join(rng.choice(WORDS[lang]) + rng.choice(["", "", ",", "."]) for _ in range(n))


def held(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(2)
    rows = [(i, text_of(rng, lang := rng.choice("aa bb cc".split())), lang, "s", 1.0) for i in range(200)]
    rows += [(300, None, "aa", "s", 1.0), (301, "", None, None, None), (302, "123 -- !?", "bb", None, None), (None, text_of(rng, "cc"), "cc", None, None), (5, rows[5][1], rows[5][2], "s", 1.0)]
    rows += [(400, text_of(rng, "aa", 60) + " " + text_of(rng, "cc", 40), None, "mixed", None), (401, "lorem " * 400_000, None, None, None)]
    # The clashing names must neither be read nor lost.
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score double").withColumn("doc", F.lit("d")).withColumn("lang_pred", F.lit("p"))


def test_fold(spark):
    got = spark.createDataFrame([(i,) for i in range(500)] + [(None,)], "i long").select("i", common.held_out(F.col("i")).alias("h")).collect()
    assert all(r.h == (r.i is not None and held(r.i)) for r in got)


def test_languages(spark, docs):
    got = {r.doc_id: r for r in langid.language_id(docs).collect()}
    truth = {r.doc_id: r.lang for r in docs.filter("doc_id < 200").collect()}
    assert all(got[i].lang_pred == lang for i, lang in truth.items()) and all(0 <= r.score <= 1 for r in got.values())
    assert [got[i].lang_pred for i in (300, 301, 302)] == ["und"] * 3 and got[None].lang_pred == "cc" and got[401].lang_pred == "aa"
    assert got[400].languages == ["aa", "cc"] and 0.5 < got[400].shares[0] < 0.8
    kept = langid.with_language(docs)
    assert kept.columns == docs.columns and kept.count() == docs.count() - 3 and {r.lang_pred for r in kept.collect()} == {"p"}


def test_labels_of_the_held_out_fold_teach_nothing(docs):
    # The held-out rows get a language of their own: it must not be learned.
    marked = docs.withColumn("lang", F.when(common.held_out(F.col("doc_id")), "zz").otherwise(F.col("lang")))
    langs, p = langid.learn(marked)
    assert langs == ["aa", "bb", "cc"] and np.allclose(p.sum(axis=0), 1)
    assert {r.lang_pred for r in langid.language_id(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_mixture_shares_are_a_maximum():
    rng = np.random.default_rng(1)
    p = rng.dirichlet(np.ones(50), 3).T
    c = rng.integers(0, 20, 50).astype(float)
    theta, best = langid.shares(p, c, 500)
    for _ in range(200):
        other = rng.dirichlet(np.ones(3))
        assert float(c @ np.log(p @ other)) <= best + 1e-6
    assert math.isclose(theta.sum(), 1)


def plain_languages(taught, texts, penalty=langid.PENALTY):
    """language and share of each text by plain counting, dictionaries and EM, a trigram at a time."""

    def grams(t):
        c = [(x.lower() if len(x.lower()) == 1 else x) if x.isalpha() else " " for x in f" {t or ''} "]
        h = lambda a: 0 if a == " " else ord(a)
        out = {}
        for x, y, z in zip(c, c[1:], c[2:], strict=False):
            if y != " ":
                v = (h(x) * 0x9E3779B1 + h(y) * 0x85EBCA77 + h(z) * 0xC2B2AE3D) & 0xFFFFFFFF
                v = ((v ^ v >> 15) * 0x2C1B3C6D & 0xFFFFFFFF) >> 16
                out[v] = out.get(v, 0) + 1
        return out

    counts = {}
    for lang, t in taught:
        for g, n in grams(t).items():
            counts.setdefault(lang, {}).setdefault(g, 0)
            counts[lang][g] += n
    langs = sorted(counts)
    total = {x: sum(counts[x].values()) + 0.1 * 65536 for x in langs}
    p = lambda x, g: (counts[x].get(g, 0) + 0.1) / total[x]

    def em(c, among):
        share = dict.fromkeys(among, 1 / len(among))
        for _ in range(400 if len(among) > 1 else 0):
            new = dict.fromkeys(among, 0.0)
            for g, n in c.items():
                mix = sum(share[x] * p(x, g) for x in among)
                for x in among:
                    new[x] += n * share[x] * p(x, g) / mix
            share = {x: v / sum(c.values()) for x, v in new.items()}
        return share, sum(n * math.log(sum(share[x] * p(x, g) for x in among)) for g, n in c.items())

    out = []
    for t in texts:
        c = grams(t)
        if not c:
            out.append(("und", 0.0))
            continue
        overall, _ = em(c, langs)
        ranked, best = sorted(langs, key=lambda x: -overall[x]), None
        for k in range(1, len(langs) + 1):
            share, value = em(c, ranked[:k])
            value -= penalty * (k - 1) * math.log(sum(c.values()) + 1)
            if k > 1 and (overall[ranked[k - 1]] < langid.LEAST_SHARE or value <= best[0]):
                break
            best = (value, share if k > 1 else {ranked[0]: overall[ranked[0]]})
        top = max(best[1], key=best[1].get)
        out.append((top, best[1][top]))
    return out


def test_predictions_are_those_of_plain_counting(spark):
    rng = random.Random(8)
    rows = [(i, text_of(rng, x := rng.choice("aa bb cc".split()), 12), x) for i in range(60)]
    rows += [(100 + i, text_of(rng, "aa", 10 + i) + " " + text_of(rng, "bb", 18 - i), None) for i in range(8)] + [(200, "щ7a", None), (201, "!", None), (202, "Ÿß İ", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in langid.language_id(docs).collect()}
    want = plain_languages([(x, t) for i, t, x in rows if x and not held(i)], [t for _, t, _ in rows])
    for (i, _, _), (lang, share) in zip(rows, want, strict=True):
        assert got[i].lang_pred == lang and math.isclose(got[i].score, share, abs_tol=2e-2), i


def test_more_languages_than_the_model_may_have(spark):
    many = spark.range(400).selectExpr("id as doc_id", "'abc' as text", "concat('l', id) as lang")
    with pytest.raises(Exception, match="more than 128 languages"):
        langid.learn(many)


def test_language_of_an_empty_table(docs):
    assert langid.language_id(docs.limit(0)).count() == langid.with_language(docs.limit(0)).count() == 0


@pytest.fixture(scope="module")
def rated(spark):
    rng = random.Random(7)
    rows, labels = [], []
    for i in range(600):
        bad = i % 5 == 0
        words = [rng.choice("tree river stone cloud paper") for _ in range(40)]
        text = " ".join(words[:20] + ([rng.choice(["vile", "VILE!", "rotten"])] if bad else []) + words[20:])
        rows.append((i, text, "x"))
        labels.append((i, int(bad)))
    rows += [(900, None, "x"), (901, "", "x"), (None, "rotten vile", "x"), (7, rows[7][1], "x"), (902, "stone " * 200_000 + "rotten vile vile!", "x")]
    labels += [(7, 0), (None, 1), (903, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, score string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_toxicity(rated):
    docs, labels = rated
    got = toxicity.toxicity(docs, labels).collect()
    assert len(got) == docs.count()
    out = [r for r in got if r.doc_id is not None and r.doc_id < 600 and r.held_out]
    assert out and all(r.predicted == int(r.doc_id % 5 == 0) for r in out)
    by = {r.doc_id: r for r in got}
    assert by[900].score == by[901].score < 0.3 and by[902].predicted == 1 and by[None].predicted == 1
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) and r.held_out == (r.doc_id is not None and held(r.doc_id)) for r in got)
    kept = toxicity.without_toxic(docs, labels)
    assert kept.columns == docs.columns and kept.filter("text like '%vile%' or text like '%rotten%'").count() == 0 and kept.count() == sum(not r.predicted for r in got)


def plain_fit(rows, epochs, alpha, beta, l1, l2):
    """The same steps, a coordinate at a time."""
    z, n = {}, {}

    def weight(k):
        most = 0 if k == 0 else l1
        x = z.get(k, 0.0)
        return 0.0 if abs(x) <= most else -(x - math.copysign(most, x)) / ((beta + math.sqrt(n.get(k, 0.0))) / alpha + l2)

    for _ in range(epochs):
        for f, label, share in rows:
            w = {k: weight(k) for k in f}
            g = share * (1 / (1 + math.exp(-sum(w.values()))) - label)
            for k in f:
                sigma = (math.sqrt(n.get(k, 0.0) + g * g) - math.sqrt(n.get(k, 0.0))) / alpha
                z[k] = z.get(k, 0.0) + g - sigma * w[k]
                n[k] = n.get(k, 0.0) + g * g
    return {k: w for k in z if (w := weight(k))}


def plain_features(text):
    """Numbers of words, stems, pairs and pairs with one between, by plain integers."""
    words = "".join(" " if c in string.punctuation else c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    x, (m, k, s), top = [zlib.crc32(w) for w in words], map(int, toxicity.MIX), (1 << 32) - 1
    mixed = [v * m for v in x] + [zlib.crc32(w[: toxicity.STEM]) * s + m for w in words]
    mixed += [a * k + b * m for a, b in itertools.pairwise(x)] + [a * s + b * m + k for a, b in zip(x, x[2:], strict=False)]
    mixed = [v & top for v in mixed]
    return {0} | {1 + (((v ^ v >> 15) * k & top) >> 32 - toxicity.BITS) % ((1 << toxicity.BITS) - 1) for v in mixed}


def test_scores_are_those_of_a_plain_model(rated):
    docs, labels = rated
    text = {r.doc_id: r.text for r in docs.filter("doc_id < 600").collect()}
    known = {i: int(i % 5 == 0) for i in range(600) if not held(i)}
    order = sorted(known, key=lambda i: (zlib.crc32(str(i).encode()), i))
    w = plain_fit([(plain_features(text[i]), known[i], 1.0) for i in order], toxicity.EPOCHS, toxicity.ALPHA, toxicity.BETA, toxicity.L1, toxicity.L2)
    assert any(w.get(k) for k in plain_features("vile"))
    for r in toxicity.toxicity(docs.filter("doc_id < 600"), labels).collect():
        assert math.isclose(r.score, 1 / (1 + math.exp(-sum(w.get(k, 0.0) for k in plain_features(text[r.doc_id])))), abs_tol=1e-6)


def test_other_labels_teach_nothing(spark, rated):
    docs, labels = rated
    odd = labels.unionByName(spark.createDataFrame([(i, x) for i in range(0, 600, 5) for x in (2, -1)] + [(11, 7)], "doc_id long, toxic int"))
    assert np.array_equal(toxicity.model(docs, odd), toxicity.model(docs, labels))


def test_toxicity_without_labels(rated):
    docs, labels = rated
    assert {r.predicted for r in toxicity.toxicity(docs, labels.limit(0)).collect()} == {0}
    assert {r.predicted for r in toxicity.toxicity(docs, labels.filter("toxic = 0")).collect()} == {0}
    assert toxicity.toxicity(docs.limit(0), labels).count() == 0


def test_weights_are_sparse_and_the_sample_is_bounded(rated):
    docs, labels = rated
    assert 0 < np.count_nonzero(toxicity.model(docs, labels)) < 2000
    assert toxicity.sample_labels(labels, "doc_id", "toxic", 50).count() < 160


@pytest.mark.parametrize(("every", "fit_rows"), [(9, 500), (9, 20_000), (40, 500), (40, 5_000)])
def test_sampled_classes_keep_their_ratio(spark, every, fit_rows):
    labels = spark.range(60_000).selectExpr("id as doc_id", f"cast(id % {every} = 0 as int) as toxic")
    true = {r.toxic: r["count"] for r in labels.filter(~common.held_out(F.col("doc_id"))).groupBy("toxic").count().collect()}
    got = {r.label: r for r in toxicity.sample_labels(labels, "doc_id", "toxic", fit_rows).groupBy("label").agg(F.sum("share").alias("weight"), F.count("share").alias("n")).collect()}
    assert all(got[k].n <= 1.2 * fit_rows for k in (0, 1))
    assert math.isclose(got[0].weight / got[1].weight, true[0] / true[1], rel_tol=0.15)


def test_pipeline(spark, docs, rated, tmp_path):
    texts = [r.text for r in docs.filter("doc_id < 100").collect()]
    toxic_docs, labels = rated
    bad = [r.text for r in toxic_docs.filter("doc_id % 5 = 0 and doc_id < 100").collect()]
    close = [" ".join([*t.split()[:-1], "otherwise"]) for t in texts[40:48]]
    rows = [(i, t) for i, t in enumerate(texts + texts[:30] + bad)] + [(200 + i, t) for i, t in enumerate(close)] + [(990, "..."), (991, None), (3, texts[3])]
    all_docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    known = spark.createDataFrame([(i, int(i >= 130)) for i in range(150)], "doc_id long, toxic int")
    all_docs.write.parquet(f"{tmp_path}/documents.parquet")
    known.write.parquet(f"{tmp_path}/labels.parquet")
    now, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = common.staged(stage(spark, now, str(tmp_path)))
        assert now.columns == all_docs.columns, name
        kept.append({r.doc_id for r in now.collect()})
    assert kept[0] == {i for i, t in rows if t and any(c.isalpha() for c in t)}
    by_id = {i: t for i, t in rows if i in kept[0]}
    order = sorted((i for i in range(150) if not held(i) and i in by_id), key=lambda i: (zlib.crc32(str(i).encode()), i))
    w = plain_fit([(plain_features(by_id[i]), int(i >= 130), 1.0) for i in order], toxicity.EPOCHS, toxicity.ALPHA, toxicity.BETA, toxicity.L1, toxicity.L2)
    assert kept[1] == {i for i, t in by_id.items() if 1 / (1 + math.exp(-sum(w.get(k, 0.0) for k in plain_features(t)))) < 0.3} < kept[0]
    assert kept[2] == {min(i for i, t in rows if t == rows_text and i in kept[1]) for rows_text in {t for i, t in rows if i in kept[1]}}
    grams = {i: frozenset(tuple(x[k : k + 5]) for k in range(max(1, len(x) - 4))) for i in kept[2] for x in [by_id[i].lower().split()]}
    root = {i: i for i in grams}
    for i in sorted(grams):
        for j in sorted(grams):
            if j < i and len(grams[i] & grams[j]) >= 0.8 * len(grams[i] | grams[j]):
                root = {k: root[j] if r == root[i] else r for k, r in root.items()}
    assert kept[3] == {min(i for i in root if root[i] == r) for r in root.values()} < kept[2] and now.count() == len(kept[3])
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in out} == kept[3] and set(out[0].asDict()) == {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"}
    assert packing.CAPACITY == 4096
