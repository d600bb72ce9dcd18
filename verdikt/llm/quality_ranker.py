"""Quality scores by Bradley-Terry pairwise ranking.

A pair is a labelled good and a labelled bad document; the good one is
preferred.  The log-odds of the preference are the difference of the documents'
scores, a score is linear in the features, and the weights minimise the logistic
loss of the feature differences of the pairs.  The threshold is the quantile of
the scores, among those of a grid, at which the two sides hold the fewest wrong
labels; published scores are shifted so that the threshold lies at ``cutoff``.

Every labelled document is learned from.  Features are computed once, where the
texts are read.  The labelled rows are dealt into blocks of about ``block`` of
the commoner label; a rarer label's rows come to several blocks where they are
too few.  In a block every good document meets every bad one.  Each Newton step
sums the blocks' gradients and curvatures in Spark, and the quantiles are those
of all labelled rows, so only sums and the grid's cells reach the driver.

Defined results: null and empty texts have all features at zero words and score
like any text of none; repeated rows score each, and of rows that share a doc_id
the text least by its opening is learned from; without labels of both kinds
every score is the share of good labels; an empty table gives no rows; a text
of any length is read whole.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdikt.llm.common import fold, learned_labels, logistic, map_batches, pin
from verdikt.llm.quality_rules import text_metrics
from verdikt.operators.running import running_totals

MARKS = ".,;:!?"
DIGITS = "0123456789"


def features(text: str) -> list[float]:
    """Shares and logarithms of the whole text, all bounded."""
    n, chars, symbols, twice, repeats, lines, capitals = text_metrics(text)
    words = text.split()
    return [
        symbols / max(1, chars),
        twice / max(1, lines),
        repeats / max(1, n),
        capitals / max(1, chars),
        sum(map(text.count, MARKS)) / max(1, chars),
        sum(map(text.count, DIGITS)) / max(1, chars),
        len(set(words)) / max(1, n),
        min(1.0, text.count("|") / max(1, n)),
        min(20.0, chars / max(1, n)) / 20,
        math.log1p(n) / 10,
        math.log1p(n / max(1, lines)) / 10,
        float(n < 50),
    ]


WIDTH = len(features(""))


@dataclass
class Model:
    weights: np.ndarray
    centre: np.ndarray
    spread: np.ndarray
    shift: float

    def scaled(self, rows: np.ndarray) -> np.ndarray:
        return np.clip((rows - self.centre) / self.spread, -6, 6)

    def raw(self, rows: np.ndarray) -> np.ndarray:
        return self.scaled(rows) @ self.weights

    def scores(self, rows: np.ndarray) -> list[float]:
        return [round(logistic(float(x) + self.shift), 6) for x in self.raw(rows)]


def newton(sums: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]], width: int, penalty: float = 1.0, steps: int = 40) -> np.ndarray:
    """Weights of the ridge Bradley-Terry fit; ``sums`` gives the pairs' gradient and curvature at some weights."""
    weights = np.zeros(width)
    for _ in range(steps):
        rise, bend = sums(weights)
        step = np.linalg.solve(bend + penalty * np.eye(width), rise - penalty * weights)
        weights = weights + step
        if np.abs(step).max() < 1e-8:
            break
    return weights


def preference_weights(better: np.ndarray, worse: np.ndarray, penalty: float = 1.0, steps: int = 40) -> np.ndarray:
    """The fit to given pairs of feature rows in memory."""
    gap = better - worse

    def sums(weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lost = 1 / (1 + np.exp(np.clip(gap @ weights, -30, 30)))
        return gap.T @ lost, (gap * (lost * (1 - lost))[:, None]).T @ gap

    return newton(sums, gap.shape[1], penalty, steps)


def crossed_sums(good: np.ndarray, bad: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and curvature of all pairs of a good and a bad row."""
    lost = 1 / (1 + np.exp(np.clip((good @ weights)[:, None] - (bad @ weights)[None, :], -30, 30)))
    rise = good.T @ lost.sum(axis=1) - bad.T @ lost.sum(axis=0)
    lost *= 1 - lost
    across = good.T @ lost @ bad
    bend = (good.T * lost.sum(axis=1)) @ good + (bad.T * lost.sum(axis=0)) @ bad - across - across.T
    return rise, bend


def quantile_cut(raw: np.ndarray, labels: np.ndarray, weight: np.ndarray, grid: int = 400) -> float:
    """The score quantile with the least weight of wrong labels; of equal ones the middle."""
    order = np.argsort(raw, kind="stable")
    raw, labels, weight = raw[order], labels[order], weight[order]
    return grid_cut(raw, raw, weight * labels, weight * (1 - labels), grid)


def grid_cut(low: np.ndarray, high: np.ndarray, good: np.ndarray, bad: np.ndarray, grid: int) -> float:
    """The cut of ascending cells, each from ``low`` to ``high`` with its weight of good and bad labels."""
    good_below = np.concatenate([[0], np.cumsum(good)])
    bad_below = np.concatenate([[0], np.cumsum(bad)])
    wrong = good_below + bad_below[-1] - bad_below
    share = np.concatenate([[0], np.cumsum(good + bad)]) / (good + bad).sum()
    at = np.unique(np.searchsorted(share, np.arange(grid + 1) / grid).clip(0, len(low)))
    at = at[[0 < i < len(low) and high[i - 1] < low[i] for i in at]]
    if not len(at):
        return float(low[0]) - 1e-9
    best = at[wrong[at] == wrong[at].min()]
    i = int(best[len(best) // 2])
    return float(high[i - 1] + low[i]) / 2


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, WIDTH))


def featured(docs: DataFrame) -> DataFrame:
    """(doc_id, mark, f): features of every text; ``mark`` orders texts by opening and digest, null for none."""

    def mark(text: str | None) -> str | None:
        return None if text is None else f"{text[:24]}\0{blake2b(text.encode(), digest_size=8).hexdigest()}"

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch["text"].to_pylist()
        rows = pa.array([features(text or "") for text in texts], pa.list_(pa.float64()))
        return pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(map(mark, texts), pa.string()), rows], ["doc_id", "mark", "f"])

    kind = dict(docs.dtypes)["doc_id"]
    return map_batches(docs, ["doc_id", "text"], run, f"doc_id {kind}, mark string, f array<double>")


def exact_sum(value, scale: int):
    """A sum that doesn't depend on the order of its rows."""
    return F.sum(value.cast(f"decimal(28,{scale})")).cast("double")


def spread_of(learned: DataFrame, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and deviation of each feature."""
    f = [F.get("f", F.lit(i)) for i in range(WIDTH)]
    sums = np.array(learned.agg(*[exact_sum(x, 18) for x in f], *[exact_sum(x * x, 18) for x in f]).first(), dtype=float) / rows
    centre = sums[:WIDTH]
    return centre, np.maximum(np.sqrt(np.maximum(sums[WIDTH:] - centre**2, 0)), 1e-3)


def dealt(learned: DataFrame, counts: dict[int, int], model: Model, block: int, least: int = 32) -> DataFrame:
    """One row a block: its good and its bad rows, scaled, as two arrays of doubles in bytes."""
    blocks = max(1, -(-max(counts.values()) // block))
    copies = {label: min(blocks, max(1, -(-least * blocks // n))) for label, n in counts.items()}
    turns = F.sequence(F.lit(0), F.when(F.col("label") == 1, copies[1]).otherwise(copies[0]) - 1)
    rows = learned.select("doc_id", "label", "f", F.explode(turns).alias("turn"))
    at = F.pmod(F.xxhash64("doc_id") + F.col("turn"), F.lit(blocks)).cast("int")

    def pack(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("doc_id")
        scaled = model.scaled(matrix(rows["f"].combine_chunks()))
        label = rows["label"].to_numpy()
        sides = [pa.array([scaled[label == side].tobytes()], pa.binary()) for side in (1, 0)]
        return pa.table([rows["block"][:1], *sides], ["block", "good", "bad"])

    placed = rows.select("doc_id", "label", "f", at.alias("block")).repartition(-(-blocks // 32), "block")
    return placed.groupBy("block").applyInArrow(pack, "block int, good binary, bad binary")


def fitted(blocks: DataFrame, partners: int) -> np.ndarray:
    """Weights over the pairs of all blocks; a block weighs ``partners`` pairs for each row of its rarer label."""

    def sums(weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            out = []
            for packed in zip(batch["good"], batch["bad"], strict=True):
                good, bad = (np.frombuffer(side.as_py()).reshape(-1, WIDTH) for side in packed)
                if len(good) and len(bad):
                    rise, bend = crossed_sums(good, bad, weights)
                    out.append(np.concatenate([rise, bend.ravel()]) * (partners / max(len(good), len(bad))))
            at = np.tile(np.arange(WIDTH + WIDTH**2, dtype=np.int32), len(out))
            return pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.concatenate(out) if out else [], pa.float64())], ["i", "v"])

        found = map_batches(blocks, ["good", "bad"], run, "i int, v double").groupBy("i").agg(exact_sum(F.col("v"), 12).alias("v"))
        total = np.zeros(WIDTH + WIDTH**2)
        for i, v in found.collect():
            total[i] = v
        return total[:WIDTH], total[WIDTH:].reshape(WIDTH, WIDTH)

    return newton(sums, WIDTH)


def cut_of(learned: DataFrame, model: Model, rows: int, grid: int = 400) -> float:
    """The quantile cut of all learned rows: equal scores are one cell, cells of one grid step are joined."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        raw = pa.array(np.round(model.raw(matrix(batch["f"])), 9), pa.float64())
        return pa.RecordBatch.from_arrays([batch["label"], raw], ["label", "raw"])

    scored = map_batches(learned, ["label", "f"], run, "label int, raw double")
    cells = scored.groupBy("raw").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("good"))
    upto = running_totals(cells, [], [F.col("raw").asc()], {"upto": F.col("n")})
    step = F.floor((F.col("upto") - F.col("n")) * F.lit(grid) / F.lit(rows))
    joined = upto.groupBy(step.alias("step")).agg(F.min("raw"), F.max("raw"), F.sum("good"), F.sum(F.col("n") - F.col("good")))
    low, high, good, bad = np.array(sorted(tuple(r)[1:] for r in joined.collect()), dtype=float).T
    return grid_cut(low, high, good, bad, grid)


def train(learned: DataFrame, shares: dict[int, float], cutoff: float, partners: int, block: int) -> Model:
    """A model from all rows (doc_id, label, f); ``shares`` are those of the labels."""
    counts = {r[0]: r[1] for r in learned.groupBy("label").count().collect()}
    if len(counts) < 2:
        share = min(max(shares.get(1, 0.0), 1e-6), 1 - 1e-6)
        return Model(np.zeros(WIDTH), np.zeros(WIDTH), np.ones(WIDTH), math.log(share / (1 - share)))
    rows = sum(counts.values())
    model = Model(np.zeros(WIDTH), *spread_of(learned, rows), 0.0)
    model.weights = fitted(pin(dealt(learned, counts, model, block), "quality-blocks"), partners)
    model.shift = math.log(cutoff / (1 - cutoff)) - cut_of(learned, model, rows)
    return model


def rank_quality(
    docs: DataFrame, labels: DataFrame, cutoff: float = 0.3, partners: int = 10, folds: int = 5, block: int = 1024
) -> DataFrame:
    """(doc_id, score) of every document.

    ``labels`` has doc_id and ``quality``; only rows of a fold other than 0 are
    learned from, all of them.  Texts are read once, into a table of features.
    """
    counted = labels.where(F.col("quality").isNotNull() & (fold(F.col("doc_id"), folds) != 0))
    counts = {int(r[0]): r[1] for r in counted.groupBy(F.col("quality").cast("int")).count().collect()}
    shares = {label: n / max(1, sum(counts.values())) for label, n in counts.items()}
    table = pin(featured(docs), "quality-features")
    keys = learned_labels(labels, "quality", folds).where("label IN (0, 1)")
    none = F.array(*map(F.lit, features("")))
    learned = table.join(keys, "doc_id").groupBy("doc_id", "label").agg(F.coalesce(F.min_by("f", "mark"), none).alias("f"))
    model = train(pin(learned, "quality-learned"), shares, cutoff, partners, block)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        scores = pa.array(shared.value.scores(matrix(batch["f"])), pa.float64())
        return pa.RecordBatch.from_arrays([batch["doc_id"], scores], ["doc_id", "score"])

    kind = dict(docs.dtypes)["doc_id"]
    return map_batches(table, ["doc_id", "f"], run, f"doc_id {kind}, score double")
