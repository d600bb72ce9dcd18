"""Run aggregation, penalties, selection scores and promotion gates."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdikt.functions.text import ratio

# Promotion gate limits.
MIN_OVERALL, MIN_FAMILY = 86.0, 82.0
MAX_TIE_RATE, MAX_EXACT_RATE = 0.05, 0.06
MIN_REASONING_TRIGGER, MAX_DISAGREEMENT, MIN_EXTERNAL = 0.10, 0.05, 75.0
# Floors of the blind gate used in the selection penalty.
MIN_FOCUS_COVERAGE, MIN_PARSER_RATE, MIN_LOW_CONFIDENCE = 0.75, 0.65, 0.65


def weighted_family(families: DataFrame, weights: Mapping[str, float], keys: list[str], default: str) -> DataFrame:
    """Weighted mean over the families present; the default where none is."""
    weight = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])[F.col("family")]
    s = families.groupBy(*keys).agg(
        F.sum(F.col("accuracy") * weight).alias("_t"),
        F.sum(F.when(F.col("accuracy").isNotNull(), weight)).alias("_w"), F.max(default).alias("_d"),
    )
    return s.select(*keys, F.coalesce(F.when(F.col("_w") > 0, F.col("_t") / F.col("_w")), F.col("_d")).alias("weighted"))


def over(value: Column, limit: float | None, factor: float, scale: float = 1.0) -> Column:
    """Penalty for exceeding a limit; none when the limit is unset."""
    if limit is None:
        return F.lit(0.0)
    return F.greatest(F.lit(0.0), (value - limit) * scale) * factor


def under(value: Column, limit: float, factor: float) -> Column:
    return F.greatest(F.lit(0.0), F.lit(limit) - value) * factor


def aggregate_runs(runs: DataFrame) -> DataFrame:
    """Means, extremes and population deviation of a candidate's runs."""
    worst = F.min(F.struct("worst_family_wu", "run", "worst_family"))
    mean = {c: F.avg(c).alias(f"mean_{c}") for c in (
        "overall_wu", "overall_uniform", "target_wu", "hard_wu", "focus_coverage", "parser_rate",
        "low_confidence", "fold_stddev")}
    return runs.groupBy("label").agg(
        F.count(F.lit(1)).alias("run_count"), *mean.values(), F.stddev_pop("overall_wu").alias("run_wu_stdev"),
        F.avg(F.col("overall_wu") - F.col("overall_uniform")).alias("mean_gap"), worst.alias("_w"),
        *[F.max(c).alias(f"max_{c}") for c in ("failure_count", "exact_failures", "tie_failures", "failure_rate",
                                               "exact_rate", "tie_rate")],
    ).withColumns({"worst_family_wu": F.col("_w.worst_family_wu"), "worst_family": F.col("_w.worst_family")}).drop("_w")


def selection_score(agg: DataFrame, min_family: float, max_gap: float, max_failure_rate: float | None,
                    max_exact_rate: float | None, max_tie_rate: float | None, max_failures: int | None = None,
                    max_exact: int | None = None, max_ties: int | None = None) -> DataFrame:
    """Weighted base minus piecewise-linear penalties, and the combined gate."""
    c = F.col
    # Slopes and offsets of the penalties.
    penalty = (
        under(c("worst_family_wu"), min_family, 2.0) + over(c("mean_gap"), max_gap, 1.0)
        + over(c("max_failure_count"), max_failures, 0.50) + over(c("max_exact_failures"), max_exact, 0.35)
        + over(c("max_tie_failures"), max_ties, 0.50) + over(c("max_failure_rate"), max_failure_rate, 0.50, 100.0)
        + over(c("max_exact_rate"), max_exact_rate, 0.35, 100.0) + over(c("max_tie_rate"), max_tie_rate, 0.50, 100.0)
        + c("mean_fold_stddev") * 0.25 + c("run_wu_stdev") * 0.50
        + under(c("mean_focus_coverage"), MIN_FOCUS_COVERAGE, 8.0) + under(c("mean_parser_rate"), MIN_PARSER_RATE, 6.0)
        + under(c("mean_low_confidence"), MIN_LOW_CONFIDENCE, 5.0)
    )
    base = (
        c("mean_overall_wu") * 0.40 + c("mean_target_wu") * 0.20 + c("mean_hard_wu") * 0.15
        + c("worst_family_wu") * 0.20 + c("mean_overall_wu") * 0.05
    )
    gate = (c("worst_family_wu") >= min_family) & (c("mean_gap") <= max_gap) & (
        c("mean_focus_coverage") >= MIN_FOCUS_COVERAGE) & (c("mean_parser_rate") >= MIN_PARSER_RATE) & (
        c("mean_low_confidence") >= MIN_LOW_CONFIDENCE)
    for name, limit in (("max_failure_rate", max_failure_rate), ("max_exact_rate", max_exact_rate),
                        ("max_tie_rate", max_tie_rate)):
        if limit is not None:
            gate = gate & (c(name) <= limit)
    return agg.withColumns({"penalty": penalty, "selection_score": base - penalty, "passes_all": gate})


def promotion_gates(summary: DataFrame) -> DataFrame:
    """Every promotion gate as a row (gate, value, passed)."""
    c = F.col
    tie, exact = ratio(c("tie_failures"), c("pair_count")), ratio(c("exact_failures"), c("pair_count"))
    rows = [
        ("overall_wu", c("overall"), c("overall") >= MIN_OVERALL),
        ("mmlu_pro_wu", c("mmlu"), c("mmlu") >= MIN_FAMILY),
        ("reasoning_wu", c("reasoning"), c("reasoning") >= MIN_FAMILY),
        ("math_wu", c("math"), c("math") >= MIN_FAMILY),
        ("tie_failure_rate", tie, tie <= MAX_TIE_RATE),
        ("exact_answer_failure_rate", exact, exact <= MAX_EXACT_RATE),
        ("reasoning_verifier_trigger_rate", c("reasoning_trigger"), c("reasoning_trigger") >= MIN_REASONING_TRIGGER),
        ("discriminator_order_disagreement_rate", c("disagreement"), c("disagreement") <= MAX_DISAGREEMENT),
        ("external_slice_wu", c("external"), c("external") >= MIN_EXTERNAL),
    ]
    cells = F.array(*[F.struct(F.lit(g).alias("gate"), v.cast("double").alias("value"), p.alias("passed")) for g, v, p in rows])
    return summary.select(F.inline(cells)).where(F.col("value").isNotNull())


def criterion_outcomes(results: DataFrame, minimum: float) -> DataFrame:
    """Case decision from hard and soft criterion results.

    ``results``: case_id, hard, verdict, score (nullable), confidence (nullable).
    """
    from verdikt.functions.rubrics import overall_decision, training_bucket

    soft = F.coalesce(
        F.col("score"),
        F.when(F.col("verdict") == "MET", 1.0).when(F.col("verdict") == "UNMET", 0.0).otherwise(0.5),
    )
    s = results.groupBy("case_id").agg(
        F.max(F.col("hard") & (F.col("verdict") == "UNMET")).alias("unmet"),
        F.max(F.col("hard") & (F.col("verdict") == "CANNOT_ASSESS")).alias("unknown"),
        F.max(F.col("verdict") == "CANNOT_ASSESS").alias("any_unknown"),
        F.max(F.col("hard") & (F.col("verdict") != "MET")).alias("hard_failed"),
        F.avg(F.when(~F.col("hard"), soft)).alias("soft_mean"),
        F.avg("confidence").alias("avg_confidence"),
    )
    overall = overall_decision(F.col("unmet"), F.col("unknown"), F.col("soft_mean"), F.lit(minimum))
    return s.withColumn("overall_decision", overall).withColumn(
        "training_bucket", training_bucket(F.col("overall_decision"))
    ).drop("unmet", "unknown")


def dimension_scores(results: DataFrame) -> DataFrame:
    dim = F.coalesce("dimension", F.lit("unknown"))
    s = results.groupBy("case_id", dim.alias("dimension")).agg(
        F.sum(F.coalesce("score", F.lit(0.0))).alias("earned"), F.count(F.lit(1)).alias("criteria")
    )
    return s.select("*", ratio(F.col("earned"), F.col("criteria"), 1.0).alias("normalized"))


def review_reasons(model: DataFrame, heuristic: DataFrame | None = None, low: float = 0.6) -> DataFrame:
    """Reasons a case goes to review, in a fixed order."""
    df = model
    disagree = F.lit(None).cast("string")
    if heuristic is not None:
        h = heuristic.select("case_id", F.col("overall_decision").alias("h_overall"), F.col("hard_failed").alias("h_failed"))
        df = df.join(h, "case_id", "left")
        differs = (F.col("overall_decision") != F.col("h_overall")) | (F.col("hard_failed") != F.col("h_failed"))
        disagree = F.when(differs, "judge_disagreement")
    reasons = F.array_compact(F.array(
        F.when(F.col("any_unknown"), "llm_cannot_assess"),
        F.when(F.col("avg_confidence") < low, "low_llm_confidence"), disagree,
    ))
    return df.select("case_id", F.array_join(reasons, ",").alias("reasons"), F.size(reasons).alias("reason_count"))
