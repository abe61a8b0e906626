from __future__ import annotations

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleaner.llm import mixing, quality
from gleaner.llm.common import table

SMALL = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs, labels = table(spark, SMALL, "documents"), table(spark, SMALL, "labels")
    out = quality.digest(docs, labels).join(labels.select("doc_id", "quality"), "doc_id").toPandas()
    assert (out.held_out == [zlib.crc32(str(d).encode()) % 5 == 0 for d in out.doc_id]).all()
    held = out[out.held_out]
    assert len(held) > 40 and (held.predicted == held.quality).mean() >= 0.9
    assert out.score.between(0, 1).all() and (out.predicted == (out.score >= 0.3)).all()


def test_scores_do_not_use_other_columns(spark):
    docs, labels = table(spark, SMALL, "documents"), table(spark, SMALL, "labels")
    model = quality.fit_quality(docs, labels)
    plain = {r.doc_id: r.score for r in quality.score_documents(docs, model).collect()}
    odd = docs.withColumn("lang", F.lit("zz")).withColumn("source", F.lit(None).cast("string")).withColumn("score", F.lit(9)).withColumn("held_out", F.lit(1))
    assert {r.doc_id: r.score for r in quality.score_documents(odd, model).collect()} == plain
    kept = {r.doc_id for r in quality.keep_good(odd, model).collect()}
    assert kept == {d for d, s in plain.items() if s >= 0.3}


def test_additive_model_learns_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.random((4000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality.fit_additive(x[:3000], y[:3000])
    assert ((model.score(x[3000:]) > 0.5) == (y[3000:] > 0.5)).mean() > 0.9
    alone = quality.fit_additive(x[:3000], y[:3000], interactions=0)
    assert ((alone.score(x[3000:]) > 0.5) == (y[3000:] > 0.5)).mean() < 0.7


@pytest.mark.parametrize("labels", [[], [(1, 1), (2, 1)], [(1, None)]])
def test_poor_labels(spark, labels):
    docs = spark.createDataFrame([(1, "some words"), (2, None), (3, ""), (None, "x " * 5000), (1, "some words")], "doc_id long, text string")
    out = quality.digest(docs, spark.createDataFrame(labels, "doc_id long, quality int")).toPandas()
    assert len(out) == 5 and out.score.between(0, 1).all()
    assert quality.digest(docs.limit(0), spark.createDataFrame(labels, "doc_id long, quality int")).count() == 0


def test_features_of_odd_texts():
    for text in ("", " ", "\n", "a", "é" * 10, "x" * 100_000):
        assert np.isfinite(quality.text_features(text)).all()


def mixture(rows: int, seed: int = 1):
    rng = random.Random(seed)
    out = []
    for i in range(rows):
        p = [rng.random() ** 2 + 0.01 for _ in range(3)]
        out.append((i, rng.randrange(0, 400), [v / sum(p) for v in p]))
    return out


@pytest.mark.parametrize("weights,growth,least", [([0.6, 0.2, 0.2], 1.0, 0.0), ([0.3, 0.3, 0.4], 2.0, 1.0)])
def test_rates_meet_targets(spark, weights, growth, least):
    rows = mixture(400)
    members = spark.createDataFrame(rows, "id long, tokens long, p array<double>")
    mix = mixing.fit_rates(members, mixing.DomainModel(["a", "b", "c"]), weights, growth, least)
    tokens, p = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    rate = mix.rates(p)
    total = tokens.sum()
    assert (rate >= least).all()
    assert np.abs((tokens * rate) @ p / total - np.array(weights) * growth).max() < 2e-3
    got = members.select("id", mix.rate(F.col("p")).alias("r")).collect()
    assert np.allclose([r.r for r in sorted(got)], rate)


def test_unreachable_targets_reach_the_best_of_least_squares(spark):
    rows = [(i, 10, [0.9, 0.1]) for i in range(20)]
    members = spark.createDataFrame(rows, "id long, tokens long, p array<double>")
    mix = mixing.fit_rates(members, mixing.DomainModel(["a", "b"]), [0.0, 1.0])
    r = mix.rates(np.array([[0.9, 0.1]]))[0]
    assert r == pytest.approx(0.1 / (0.81 + 0.01), abs=0.02)  # minimises (0.9 r)^2 + (0.1 r - 1)^2


def test_mixed_rates_and_copies(spark):
    docs, labels = table(spark, SMALL, "documents"), table(spark, SMALL, "labels")
    out, mix = mixing.mixed_rates(docs, labels, mixing.TARGETS)
    rows = out.toPandas()
    assert len(rows) == docs.count() and (rows.rate >= 0).all()
    totals = np.array([(rows.tokens * rows.rate * rows[f"p_{d}"]).sum() for d in mixing.DOMAINS])
    assert np.abs(totals / rows.tokens.sum() - mixing.TARGETS).max() < 2e-3
    assert abs((rows.copies - rows.rate).mean()) < 0.1 and ((rows.copies - rows.rate).abs() < 1).all()
    known = rows.merge(labels.toPandas(), on="doc_id")
    right = np.where(known.toxic == 1, known.p_toxic, np.where(known.quality == 0, known.p_low, known.p_good))
    assert (right > 0.5).mean() > 0.9


def test_mixing_odd_inputs(spark):
    labels = spark.createDataFrame([(1, 1, None), (2, None, 1), (None, 1, 0)], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame([(1, "a b"), (2, None), (None, ""), (2, "c")], "doc_id long, text string")
    assert mixing.mixed_rates(docs, labels, mixing.TARGETS)[0].count() == 4
    assert mixing.mixed_rates(docs.limit(0), labels, mixing.TARGETS)[0].count() == 0
    assert mixing.mixed_rates(docs, labels.limit(0), mixing.TARGETS)[0].count() == 4


def test_apply_mix_repeats_rows(spark):
    docs = spark.createDataFrame([(i, "w " * (i + 1), "x") for i in range(50)], "doc_id long, text string, rate string")
    mix = mixing.Mix(mixing.DomainModel(["a", "b"]), 1.0, [[-1.0, -1.0]])
    got = mixing.apply_mix(docs, mix)
    assert got.columns == docs.columns and got.count() == 100  # rate 1 + 0.5 + 0.5 = 2


def test_a_repeated_id_cannot_lift_the_sample(spark):
    docs = spark.range(3000).select(F.when(F.col("id") < 2000, 7).otherwise(F.col("id")).alias("doc_id"), F.concat(F.lit("some words "), F.col("id").cast("string")).alias("text"))
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"), F.lit(0).alias("toxic"))
    seen = []
    fit, quality.fit_additive = quality.fit_additive, lambda x, y: seen.append(len(y)) or fit(x, y)
    soft, mixing._softmax_fit = mixing._softmax_fit, lambda x, y, n: seen.append(len(y)) or soft(x, y, n)
    try:
        quality.fit_quality(docs, labels, max_rows=50)
        quality.fit_quality(docs.where("doc_id = 7"), labels, max_rows=50)
        mixing.fit_domains(docs, mixing.labelled_domains(labels), mixing.DOMAINS, max_rows=50)
        mixing.fit_domains(docs.where("doc_id = 7"), mixing.labelled_domains(labels), mixing.DOMAINS, max_rows=5000)
    finally:
        quality.fit_additive, mixing._softmax_fit = fit, soft
    assert seen[0] == 50 and seen[1] <= 1 and seen[2] == 50 and seen[3] == 1


def test_scores_by_adding_tables_one_by_one():
    rng = np.random.default_rng(4)
    x = rng.random((800, 5)).round(2)
    model = quality.fit_additive(x[:600], ((x[:600, 0] + x[:600, 1] * x[:600, 2]) > 0.8).astype(float), rounds=20)
    for row, score in zip(x[600:], model.score(x[600:]), strict=True):
        total = model.intercept
        for value, cuts, table in zip(row, model.cuts, model.tables, strict=True):
            total += table[sum(c <= value for c in cuts)]
        for i, j, a, b, table in model.pairs:
            total += table[sum(c <= row[i] for c in a), sum(c <= row[j] for c in b)]
        assert score == pytest.approx(1 / (1 + np.exp(-total)), abs=1e-9)


@pytest.mark.parametrize("weights,growth,least", [([0.9, 0.08, 0.02], 1.0, 0.0), ([0.0, 0.0, 1.0], 1.0, 0.0), ([0.98, 0.01, 0.01], 1.1, 1.0), ([1, 1, 1], 0.1, 0.0)])
def test_totals_of_an_independent_solver(spark, weights, growth, least):
    """Bounded least squares by coordinate descent; the totals of the optimum are unique, reachable or not."""
    rows = mixture(60, 5)
    tokens, p = np.array([r[1] for r in rows], float), np.array([r[2] for r in rows])
    a, wanted = (tokens[:, None] * p) / tokens.sum(), np.array(weights, float) / sum(weights) * growth
    rate = np.full(len(rows), max(least, 1.0))
    for _ in range(4000):
        for d in np.flatnonzero(tokens):
            rate[d] = max(least, rate[d] + a[d] @ (wanted - rate @ a) / (a[d] @ a[d]))
    best = rate @ a
    members = spark.createDataFrame(rows, "id long, tokens long, p array<double>")
    mix = mixing.fit_rates(members, mixing.DomainModel(["a", "b", "c"]), weights, growth, least)
    found = mix.rates(p) @ a
    assert np.allclose(np.array(mix.reached) / tokens.sum(), found, atol=1e-9)
    assert np.abs(found - best).max() < 5e-3 and ((found - wanted) ** 2).sum() <= ((best - wanted) ** 2).sum() + 1e-4
