"""Coverage, discrimination, weights and candidate scores."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdikt.session import ship_package
from verdikt.functions.text import ratio
from verdikt.operators.running import ranked

# Quality buckets by role.
REPORT_STRONG = ("gold_like", "strong_anchor", "frontier_generated", "open_generated", "pair_anchor")
BANK_STRONG = ("gold_like", "strong_anchor", "frontier_generated", "open_generated")
GATE_STRONG = ("gold_like", "strong_anchor")
WEAK = ("synthetically_degraded",)

# Multipliers of the answer-type weight adjustment.
CORRECTNESS_FACTOR = 3.0
FORMAT_FACTOR = 0.35
STYLE_FACTOR = 0.15
PROXY_FACTOR = 0.35


def discrimination(p: Column) -> Column:
    return p * (1.0 - p)


def rubric_coverage(evals: DataFrame, keys: Sequence[str] = ("example_id", "rubric_id")) -> DataFrame:
    """Satisfied count, fire rate p and p(1-p) per rubric."""
    return (
        evals.groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("total"),
            F.sum(F.col("satisfied").cast("bigint")).alias("coverage_count"),
        )
        .withColumn("p", ratio(F.col("coverage_count"), F.col("total")))
        .withColumn("pq", discrimination(F.col("p")))
    )


def discrimination_filter(evals: DataFrame, threshold: float) -> DataFrame:
    """Rubrics kept for scoring: drop p(1-p) < threshold, unless none would stay.

    Examples with fewer than two candidates keep everything.
    """
    stats = rubric_coverage(evals)
    if threshold <= 0:
        return stats.withColumn("kept", F.lit(True))
    passing = (F.col("pq") >= threshold) | (F.col("total") < 2)
    bank = Window.partitionBy("example_id")
    return stats.withColumn("kept", passing | ~F.max(passing).over(bank))


def misalignment(evals: DataFrame, margin: float = 0.05) -> DataFrame:
    """Strong and weak satisfaction means per rubric and the reject flag."""
    hit = F.col("satisfied").cast("int")
    strong = F.col("quality_bucket").isin(*GATE_STRONG)
    weak = F.col("quality_bucket").isin(*WEAK)
    means = evals.groupBy("example_id", "rubric_id").agg(
        F.avg(F.when(strong, hit)).alias("s"), F.avg(F.when(weak, hit)).alias("w")
    )
    both = F.col("s").isNotNull() & F.col("w").isNotNull()
    return means.select(
        "example_id",
        "rubric_id",
        F.when(both, F.col("s")).otherwise(0.0).alias("strong_mean"),
        F.when(both, F.col("w")).otherwise(0.0).alias("weak_mean"),
        F.when(both, F.col("w") > F.col("s") + margin).otherwise(False).alias("misaligned"),
    )


def uniform_weights(rubrics: DataFrame) -> DataFrame:
    bank = Window.partitionBy("example_id")
    return rubrics.withColumn("weight", F.lit(1.0) / F.count(F.lit(1)).over(bank))


def adjusted_weights(weights: DataFrame) -> DataFrame:
    """Rescale weights by answer kind and renormalise within the example.

    Needs ``weight``, ``exact_kind``, ``style``, ``proxy`` and the example flags
    ``exact_task`` and ``code_task``.  A zero total leaves the input weights.
    """
    factor = (
        F.when(F.col("exact_task") & (F.col("exact_kind") == "correctness"), CORRECTNESS_FACTOR)
        .when(F.col("exact_task") & (F.col("exact_kind") == "format"), FORMAT_FACTOR)
        .otherwise(1.0)
        * F.when(F.col("code_task") & F.col("style"), STYLE_FACTOR).otherwise(1.0)
        * F.when(F.col("code_task") & F.col("proxy"), PROXY_FACTOR).otherwise(1.0)
    )
    bank = Window.partitionBy("example_id")
    raw = weights.withColumn("_raw", F.col("weight") * factor)
    whole = F.sum("_raw").over(bank)
    return raw.withColumn(
        "adjusted_weight", F.when(whole <= 0, F.col("weight")).otherwise(F.col("_raw") / whole)
    ).drop("_raw")


def score_candidates(evals: DataFrame, weights: DataFrame, digits: int = 12) -> DataFrame:
    """Weighted score and satisfied count per candidate.

    Weights are one row per rubric of an example, far smaller than the facts, so
    the join is left to the size-based choice of Spark.  Scores are rounded so
    that summation order cannot turn a tie into a preference.
    """
    hit = F.col("satisfied")
    return (
        evals.join(weights.select("example_id", "rubric_id", "weight"), ["example_id", "rubric_id"])
        .groupBy("example_id", "candidate_id")
        .agg(
            F.round(F.sum(F.when(hit, F.col("weight")).otherwise(0.0)), digits).alias("score"),
            F.sum(hit.cast("bigint")).alias("satisfied_count"),
        )
    )


def rank_candidates(scores: DataFrame, keys: Sequence[str] = ("example_id",),
                    max_rows: int | None = None, at_most: int | None = None) -> DataFrame:
    """Distinct ranks by score, then satisfied count, then id."""
    order = [F.col("score").desc(), F.col("satisfied_count").desc(), F.col("candidate_id").asc()]
    return ranked(scores, list(keys), order, "rank", max_rows, at_most)


# ------------------------------------------------------------- whitening

WHITEN_SCHEMA = "example_id string, rubric_id string, weight double, raw_weight double, unstable boolean"


def gram(wide: DataFrame, rubric_ids: Sequence[str], key: str = "example_id") -> DataFrame:
    """Counts that determine the population covariance of the 0/1 matrix.

    One pass with map-side partial sums, whatever the number of candidates: the
    result has one row per example with n, the column sums and the co-sums.
    """
    cells = [
        F.sum(F.col(a).cast("bigint") * F.col(b).cast("bigint"))
        for i, a in enumerate(rubric_ids)
        for b in rubric_ids[i:]
    ]
    return wide.groupBy(F.col(key).alias("example_id")).agg(
        F.count(F.lit(1)).alias("n"),
        F.array(*[F.sum(F.col(a).cast("bigint")) for a in rubric_ids]).alias("sums"),
        F.array(*cells).alias("cosums"),
    )


def near_ridge_unstable(eigenvalues: np.ndarray, ridge: float) -> np.ndarray:
    """Too many eigenvalues at the ridge: at least max(2, n // 2)."""
    flat = (eigenvalues <= ridge * 1.05).sum(axis=-1)
    return flat >= max(2, eigenvalues.shape[-1] // 2)


def whitened(n: np.ndarray, sums: np.ndarray, cosums: np.ndarray, ridge: float):
    """Batched inverse-square-root weights from the sufficient counts."""
    batch, k = sums.shape
    if k == 1:
        return np.ones((batch, 1)), np.ones((batch, 1)), np.zeros(batch, dtype=bool)
    upper = np.triu_indices(k)
    cov = np.zeros((batch, k, k))
    mean = sums / n[:, None]
    cov[:, upper[0], upper[1]] = cosums / n[:, None]
    cov = cov + np.transpose(np.triu(cov, 1), (0, 2, 1))
    cov -= mean[:, :, None] * mean[:, None, :]
    cov += ridge * np.eye(k)
    values, vectors = np.linalg.eigh(cov)
    values = np.clip(values, ridge, None)
    raw = np.einsum("bij,bj,bkj->bi", vectors, values**-0.5, vectors)
    clipped = np.clip(raw, 0.0, None)
    empty = clipped.sum(axis=1) <= 0
    clipped[empty] = 1.0
    return clipped / clipped.sum(axis=1, keepdims=True), raw, near_ridge_unstable(values, ridge)


def whitened_weights(grams: DataFrame, rubric_ids: Sequence[str], ridge: float = 1e-3) -> DataFrame:
    """Whitened-uniform weights; numpy works on batches of example rows."""
    names = list(rubric_ids)
    ship_package(grams.sparkSession)

    def batches(frames):
        for pdf in frames:
            if pdf.empty:
                continue
            weight, raw, unstable = whitened(
                pdf["n"].to_numpy(dtype=float),
                np.stack(pdf["sums"].to_numpy()).astype(float),
                np.stack(pdf["cosums"].to_numpy()).astype(float),
                ridge,
            )
            k = len(names)
            yield pd.DataFrame(
                {
                    "example_id": np.repeat(pdf["example_id"].to_numpy(), k),
                    "rubric_id": names * len(pdf),
                    "weight": weight.ravel(),
                    "raw_weight": raw.ravel(),
                    "unstable": np.repeat(unstable, k),
                }
            )

    return grams.mapInPandas(batches, WHITEN_SCHEMA)


def two_rubric_whitening(grams: DataFrame, ridge: float = 1e-3) -> DataFrame:
    """Closed form for exactly two rubrics, entirely as expressions."""
    n = F.col("n").cast("double")
    p, q = F.col("sums")[0] / n, F.col("sums")[1] / n
    a = F.col("cosums")[0] / n - p * p + ridge
    b = F.col("cosums")[1] / n - p * q
    c = F.col("cosums")[2] / n - q * q + ridge
    root = F.sqrt(a * c - b * b)
    # inverse square root of [[a, b], [b, c]] is (adj(M) + root I) / (root * sqrt(trace + 2 root))
    first = F.greatest(c + root - b, F.lit(0.0))
    second = F.greatest(a + root - b, F.lit(0.0))
    whole = first + second
    return grams.select(
        "example_id",
        F.when(whole <= 0, 0.5).otherwise(first / whole).alias("weight_a"),
        F.when(whole <= 0, 0.5).otherwise(second / whole).alias("weight_b"),
    )
