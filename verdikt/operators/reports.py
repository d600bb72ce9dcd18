"""Rank-based report metrics without enumerating candidate pairs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdikt.functions.text import ratio
from verdikt.operators.running import running_totals
from verdikt.operators.scoring import REPORT_STRONG, WEAK


def strong_vs_weak(ranking: DataFrame, keys: Sequence[str] = ("example_id",),
                   max_rows: int | None = None, at_most: int | None = None) -> DataFrame:
    """Pairs (strong, weak) ranked the right way round, and their mean margin.

    Walking down the ranking, each weak candidate adds the strong ones already
    seen.  The margin of all S*W pairs is mean(strong) - mean(weak), so no pair
    is ever materialised.
    """
    keys = list(keys)
    strong = F.col("quality_bucket").isin(*REPORT_STRONG)
    weak = F.col("quality_bucket").isin(*WEAK)
    graded = ranking.where(strong | weak).select(
        *keys, "rank", "score", strong.cast("bigint").alias("is_strong")
    )
    seen = running_totals(graded, keys, [F.col("rank").asc()], {"above": F.col("is_strong")}, max_rows, at_most)
    s, w = F.col("is_strong") == 1, F.col("is_strong") == 0
    sums = seen.groupBy(*keys).agg(
        F.sum("is_strong").alias("strong_n"),
        F.sum(1 - F.col("is_strong")).alias("weak_n"),
        F.sum(F.when(w, F.col("above")).otherwise(0)).alias("correct"),
        F.avg(F.when(s, F.col("score"))).alias("strong_mean"),
        F.avg(F.when(w, F.col("score"))).alias("weak_mean"),
    )
    return sums.select(
        *keys,
        (F.col("strong_n") * F.col("weak_n")).alias("total"),
        "correct",
        F.coalesce(F.col("strong_mean") - F.col("weak_mean"), F.lit(0.0)).alias("margin"),
    )


def reference_top1(ranking: DataFrame, keys: Sequence[str] = ("example_id",)) -> DataFrame:
    ref = F.col("source_label") == "reference_note"
    return ranking.groupBy(*keys).agg(
        F.max(ref).alias("has_reference"),
        F.max(ref & (F.col("rank") == 1)).alias("reference_top1"),
    )


def anchor_preferences(ranking: DataFrame, keys: Sequence[str] = ("example_id",)) -> DataFrame:
    """Proxy pairs: the first reference (else first augmented) against all others.

    Candidates are folded into a score histogram per key before the anchor (an
    argmin aggregate) is joined, so a hot example joins a few score levels
    instead of all of its candidates.  The anchor's own level adds no win and no
    margin; it only has to be taken off the pair count.
    """
    keys = list(keys)
    pick = lambda label: F.min(
        F.when(F.col("source_label") == label, F.struct("candidate_id", "score"))
    )
    anchors = (
        ranking.groupBy(*keys)
        .agg(F.coalesce(pick("reference_note"), pick("augmented_note")).alias("a"))
        .where(F.col("a").isNotNull())
        .select(*keys, F.col("a.score").alias("anchor_score"))
    )
    levels = ranking.groupBy(*keys, "score").agg(F.count(F.lit(1)).alias("n"))
    gap = F.col("anchor_score") - F.col("score")
    return levels.join(anchors, keys).groupBy(*keys).agg(
        (F.sum("n") - 1).alias("pair_count"),
        F.sum(F.when(gap > 0, F.col("n")).otherwise(0)).alias("correct"),
        F.sum(gap * F.col("n")).alias("margin_sum"),
    ).where(F.col("pair_count") > 0)


def earlier_preferred(scored: DataFrame, keys: Sequence[str], levels: Sequence[float],
                      max_rows: int | None = None, at_most: int | None = None) -> DataFrame:
    """Agreement over all unordered pairs when the earlier candidate is labelled better.

    ``levels`` lists every possible score.  Running counts per level give, for
    each candidate, how many earlier ones score higher: linear in candidates.
    """
    keys = list(keys)
    totals: dict[str, Column] = {
        f"c{i}": (F.col("score") == F.lit(v)).cast("bigint") for i, v in enumerate(levels)
    }
    totals["seen"] = F.lit(1).cast("bigint")
    totals["score_sum"] = F.col("score")
    run = running_totals(scored, keys, [F.col("candidate_id").asc()], totals, max_rows, at_most)
    higher = sum(
        (F.when(F.lit(v) > F.col("score"), F.col(f"c{i}")).otherwise(0) for i, v in enumerate(levels)),
        F.lit(0).cast("bigint"),
    )
    before = F.col("seen") - 1
    margin = (F.col("score_sum") - F.col("score")) - before * F.col("score")
    return run.groupBy(*keys).agg(
        F.sum(before).alias("pair_count"),
        F.sum(higher).alias("correct"),
        F.sum(margin).alias("margin_sum"),
    ).select(
        *keys,
        "pair_count",
        ratio(F.col("correct"), F.col("pair_count")).alias("pairwise_accuracy"),
        ratio(F.col("margin_sum"), F.col("pair_count")).alias("mean_margin"),
    )


def pair_outcome(score_a: Column, score_b: Column, rank_a: Column, rank_b: Column, label: Column) -> Column:
    """correct / wrong / unevaluable; an exact score tie is evaluable but wrong."""
    scored = score_a.isNotNull() & score_b.isNotNull()
    by_rank = rank_a.isNotNull() & rank_b.isNotNull()
    winner = F.when(
        scored, F.when(score_a > score_b, "a").when(score_a < score_b, "b").otherwise("")
    ).otherwise(F.when(rank_a < rank_b, "a").when(rank_a > rank_b, "b").otherwise(""))
    return (
        F.when(~label.isin("a", "b"), "unevaluable")
        .when(~scored & ~by_rank, "unevaluable")
        .when(winner == label, "correct")
        .otherwise("wrong")
    )
