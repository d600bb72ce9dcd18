"""Learned scores: held-out accuracy, what they may not look at, and awkward rows."""

from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from verdikt.llm.quality_ranker import crossed_sums, preference_weights, quantile_cut, rank_quality
from verdikt.llm.queries import op3, op6
from verdikt.llm.toxicity import LEVELS, Model, toxicity, typical

FOLDER = "/root/testdata/sf0.1"


def held_out(spark, query, label):
    rows = query(spark, FOLDER)
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    assert rows.count() == docs.count()
    found = rows.join(spark.read.parquet(f"{FOLDER}/labels.parquet"), "doc_id").collect()
    assert all(r.held_out == (crc32(str(r.doc_id).encode()) % 5 == 0) for r in found)
    assert all(0 <= r.score <= 1 for r in found)
    return [(r[label], r.predicted, r.score) for r in found if r.held_out]


def test_quality_on_held_out_rows(spark):
    found = held_out(spark, op6, "quality")
    assert np.mean([a == b for a, b, _ in found]) > 0.98


def test_toxicity_on_held_out_rows(spark):
    found = held_out(spark, op3, "toxic")
    assert np.mean([a == b for a, b, _ in found]) > 0.96
    assert np.mean([a for a, b, _ in found if b]) > 0.9
    assert np.mean([b for a, b, _ in found if a]) > 0.65


@pytest.mark.parametrize("score,label", [(toxicity, "toxic"), (rank_quality, "quality")])
def test_held_out_labels_change_nothing(spark, score, label):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    flipped = labels.withColumn(label, F.when(held, 1 - F.col(label)).otherwise(F.col(label)))
    assert sorted(score(docs, labels).collect()) == sorted(score(docs, flipped).collect())


@pytest.mark.parametrize("score,label", [(toxicity, "toxic"), (rank_quality, "quality")])
def test_awkward_rows(spark, awkward, score, label):
    labels = spark.createDataFrame([(1, 1), (3, 0), (4, 1), (4, 0), (None, 1), (5, None), (7, 0)], f"doc_id long, {label} int")
    for some in (labels, labels.where(f"{label} = 1"), labels.limit(0)):
        got = score(awkward, some)
        assert got.count() == awkward.count()
        assert all(0 <= r.score <= 1 for r in got.collect())
    assert score(awkward.limit(0), labels).count() == 0


def test_quality_learns_from_every_labelled_row(spark):
    """Marks that stand only in good documents beyond the first 6,000 by hash still raise a score."""
    ids = spark.range(17_000).where(F.crc32(F.col("id").cast("string").cast("binary")) % 5 != 0)
    good = ids.where("id % 2 = 0").orderBy(F.xxhash64("id"))
    late = [r.id for r in good.collect()[6000:]]
    assert len(late) > 100
    text = F.when(F.col("id").isin(*late) | (F.col("id") >= 20_000), "one two | three 4 five").otherwise("one two three four five")
    every = ids.unionByName(spark.range(20_000, 20_001)).unionByName(spark.range(20_001, 20_002))
    docs = every.select(F.col("id").alias("doc_id"), F.when(F.col("id") == 20_001, "one two three four five").otherwise(text).alias("text"))
    labels = ids.select(F.col("id").alias("doc_id"), (1 - F.col("id") % 2).cast("int").alias("quality"))
    score = {r.doc_id: r.score for r in rank_quality(docs, labels).where("doc_id >= 20000").collect()}
    assert score[20_000] > score[20_001] + 0.1


def test_rare_labels_reach_every_block(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 60, "| | |").otherwise("some plain words").alias("text"))
    labels = docs.select("doc_id", (F.col("doc_id") >= 60).cast("int").alias("quality"))
    one, many = ({r.doc_id: r.score for r in rank_quality(docs, labels, folds=7, block=b).collect()} for b in (4096, 64))
    for score in (one, many):
        assert max(score[i] for i in range(60)) < 0.3 <= min(score[i] for i in range(60, 3000))


def test_crossed_sums_are_those_of_all_pairs():
    draw = np.random.default_rng(5)
    good, bad, weights = draw.normal(size=(7, 3)), draw.normal(size=(5, 3)), draw.normal(size=3)
    gap = (good[:, None] - bad[None]).reshape(-1, 3)
    lost = 1 / (1 + np.exp(gap @ weights))
    rise, bend = crossed_sums(good, bad, weights)
    assert np.allclose(rise, gap.T @ lost) and np.allclose(bend, (gap.T * lost * (1 - lost)) @ gap)


def test_preferences_are_recovered():
    draw = np.random.default_rng(3)
    rows, truth = draw.normal(size=(4000, 3)), np.array([2.0, -1.0, 0.0])
    better, worse = rows[:2000], rows[2000:]
    swap = draw.random(2000) > 1 / (1 + np.exp(-(better - worse) @ truth))
    better[swap], worse[swap] = worse[swap].copy(), better[swap].copy()
    assert np.allclose(preference_weights(better, worse, penalty=1e-3), truth, atol=0.2)


def test_quantile_cut_separates_and_breaks_ties():
    raw = np.array([0.0, 1.0, 1.0, 2.0, 3.0, 3.0])
    labels = np.array([0, 0, 0, 1, 1, 1.0])
    assert 1 < quantile_cut(raw, labels, np.ones(6)) < 2
    assert quantile_cut(np.ones(3), np.array([0, 1, 1.0]), np.ones(3)) < 1


def test_gain_of_typical_words():
    from collections import Counter

    words = typical(Counter({b"vile": 40, b"the": 50}), 50, Counter({b"the": 500}), 500)
    assert words == [b"vile"]
    model = Model(b"the plain words of every day go here and there", b"vile stuff wretched")
    assert model.gain(b"wretched") > 3 and model.gain(b"vile") > 0
    assert model.gain(b"every") < LEVELS[0] and model.gain(b"zqxj") < LEVELS[0]
