"""Accuracy, failure, calibration and consensus reports over judged pairs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdikt.functions import decisions as D
from verdikt.functions.text import ratio


def double_order(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Percentage of pairs judged right in both orders together."""
    right = D.votes_correct(F.col("label"), F.col("decision"), F.col("decision_reversed"))
    sums = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("pair_count"), F.sum(right.cast("bigint")).alias("correct")
    )
    return sums.withColumn("accuracy_pct", ratio(F.col("correct"), F.col("pair_count")) * 100.0)


def family_breakdown(df: DataFrame) -> DataFrame:
    """Overall plus each built-in family in one pass; an absent family scores 0."""
    right = D.votes_correct(F.col("label"), F.col("decision"), F.col("decision_reversed")).cast("bigint")
    groups = [("overall", F.lit(True))] + [(f, F.col("source_family") == f) for f in D.FAMILIES]
    aggs = [c for i, (_, hit) in enumerate(groups)
            for c in (F.count(F.when(hit, 1)).alias(f"n{i}"), F.sum(F.when(hit, right).otherwise(0)).alias(f"c{i}"))]
    rows = F.array(*[
        F.struct(F.lit(name).alias("family"), F.col(f"n{i}").alias("pair_count"),
                 (ratio(F.coalesce(F.col(f"c{i}"), F.lit(0)), F.col(f"n{i}")) * 100.0).alias("accuracy_pct"))
        for i, (name, _) in enumerate(groups)
    ])
    return df.agg(*aggs).select(F.inline(rows))


def failure_analysis(df: DataFrame) -> DataFrame:
    """Failure counts per family, decision and rubric-count bucket.

    Failures are counted conditionally and empty groups dropped afterwards: a
    filter on the decision would be pushed through every cascade layer and
    rewritten in terms of the inputs, which explodes the predicate.
    """
    failed = F.col("decision") != F.col("label")

    def n(c: Column) -> Column:
        return F.count(F.when(failed & c, 1))

    decision = F.when(F.col("decision") == "", "unknown").otherwise(F.col("decision"))
    return df.groupBy(
        "source_family", decision.alias("failed_decision"),
        D.rubric_count_bucket(F.col("rubric_count")).alias("rubric_bucket"),
    ).agg(
        n(F.lit(True)).alias("failures"),
        n(F.col("decision") == D.EVEN).alias("tie_failures"),
        n(F.col("exact_task")).alias("exact_answer_failures"),
        n(F.col("code_task")).alias("code_failures"),
        n(F.col("broad_rubrics") > 0).alias("broad_failures"),
    ).where(F.col("failures") > 0)


def calibration(df: DataFrame, digits: int = 6) -> DataFrame:
    """Coverage, trigger, parser, low-confidence and disagreement rates."""
    low = (
        F.col("verifier_confidence").isin("", "low")
        | (F.col("discriminator_used") & F.col("discriminator_confidence").isin("", "low"))
        | (F.col("pair_margin") <= 0.006)
    )
    focus = F.col("source_family").isin(*D.FOCUS_FAMILIES)

    def n(c: Column) -> Column:
        return F.count(F.when(c, 1))

    s = df.agg(
        F.count(F.lit(1)).alias("pair_count"),
        n(F.col("verifier_available")).alias("available"),
        n(F.col("verifier_triggered")).alias("triggered"),
        n(focus).alias("focus"),
        n(focus & F.col("verifier_available")).alias("focus_available"),
        n(focus & F.col("verifier_triggered")).alias("focus_triggered"),
        n(F.col("exact_task")).alias("exact_n"),
        n(F.col("exact_task") & F.col("parsed_a") & F.col("parsed_b")).alias("parsed"),
        n(low).alias("low_n"),
        n(low & (F.col("decision") == F.col("label"))).alias("low_ok"),
        n(F.col("discriminator_used")).alias("used"),
        n(F.col("discriminator_used") & ~F.col("order_consistent")).alias("disagree"),
    )

    def r(a: str, b: str, default: float = 0.0) -> Column:
        return F.round(ratio(F.col(a), F.col(b), default), digits)

    return s.select(
        "pair_count",
        r("available", "pair_count").alias("verifier_coverage_rate"),
        r("focus_available", "focus").alias("focus_verifier_coverage_rate"),
        r("triggered", "pair_count").alias("verifier_trigger_rate"),
        r("focus_triggered", "focus").alias("focus_verifier_trigger_rate"),
        r("parsed", "exact_n").alias("exact_answer_parser_success_rate"),
        F.col("exact_n").alias("exact_answer_task_count"),
        r("low_ok", "low_n", 1.0).alias("low_confidence_bucket_accuracy"),
        F.col("low_n").alias("low_confidence_bucket_count"),
        r("used", "pair_count").alias("discriminator_usage_rate"),
        r("disagree", "used").alias("discriminator_order_disagreement_rate"),
    )


def confusion(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Counts of prediction against gold with recall per class and baselines."""
    gold_a, gold_b = F.col("gold") == "a", F.col("gold") == "b"
    pred = F.col("pred")

    def n(c: Column) -> Column:
        return F.count(F.when(c, 1))

    s = df.where(gold_a | gold_b).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        n(gold_a).alias("gold_a"),
        n(gold_b).alias("gold_b"),
        n((pred == "a") & gold_a).alias("pred_a_gold_a"),
        n((pred == "a") & gold_b).alias("pred_a_gold_b"),
        n((pred == "b") & gold_a).alias("pred_b_gold_a"),
        n((pred == "b") & gold_b).alias("pred_b_gold_b"),
        n(pred == "tie").alias("ties"),
        n(pred == "").alias("no_score"),
    )
    correct = F.col("pred_a_gold_a") + F.col("pred_b_gold_b")
    wrong = F.col("pred_a_gold_b") + F.col("pred_b_gold_a")
    return s.select(
        "*",
        ratio(correct, F.col("n")).alias("accuracy"),
        ratio(correct, correct + wrong).alias("decided_accuracy"),
        ratio(F.col("pred_a_gold_a"), F.col("gold_a")).alias("recall_a"),
        ratio(F.col("pred_b_gold_b"), F.col("gold_b")).alias("recall_b"),
        ratio(F.col("gold_a"), F.col("n")).alias("always_a"),
        ratio(F.col("gold_b"), F.col("n")).alias("always_b"),
    )


def consensus(votes: DataFrame) -> DataFrame:
    """Majority decision per pair over runs.

    ``votes``: pair_id, run, source_family, label, decision.  Three counters per
    pair replace sorting the votes; ties between the top two give A=B.
    """
    def n(d: str) -> Column:
        return F.count(F.when(F.col("decision") == d, 1))

    counts = votes.groupBy("pair_id").agg(
        F.countDistinct("run").alias("runs_seen"),
        F.max("source_family").alias("source_family"),
        F.max("label").alias("label"),
        n(D.EVEN).alias("even"), n(D.FIRST).alias("first"), n(D.SECOND).alias("second"),
    ).where(F.col("even") + F.col("first") + F.col("second") > 0)
    e, a, b = F.col("even"), F.col("first"), F.col("second")
    top = F.greatest(e, a, b)
    # binary order of the labels: A=B < A>B < B>A
    leader = F.when(e == top, D.EVEN).when(a == top, D.FIRST).otherwise(D.SECOND)
    middle = e + a + b - top - F.least(e, a, b)
    unanimous = top == F.col("runs_seen")
    split = ~unanimous & (top > middle)
    winner = F.when(unanimous | split, leader).otherwise(D.EVEN)
    return counts.select(
        "pair_id", "source_family", "label", "runs_seen",
        e.alias("votes_even"), a.alias("votes_first"), b.alias("votes_second"),
        winner.alias("consensus_decision"),
        F.when(unanimous, "unanimous").when(split, "split").otherwise("tie").alias("agreement"),
        (winner == F.col("label")).alias("is_correct"),
    )


def best_of_n(pairs: DataFrame) -> DataFrame:
    """Per subset: an item is right iff all of its pairs are.

    ``pairs``: subset, item_id, decision, decision_source, confidence.
    """
    right = (F.col("decision") == D.FIRST).cast("bigint")
    sure = (F.col("decision_source").isin(*D.HIGH_PRECISION_SOURCES) & (F.col("confidence") == "high")).cast("bigint")
    items = pairs.groupBy("subset", "item_id").agg(
        F.count(F.lit(1)).alias("pairs"), F.sum(right).alias("right"), F.sum(sure).alias("sure")
    )
    return items.groupBy("subset").agg(
        F.count(F.lit(1)).alias("item_count"),
        F.sum((F.col("right") == F.col("pairs")).cast("bigint")).alias("items_correct"),
        F.sum("pairs").alias("pair_count"),
        F.sum("right").alias("pairs_correct"),
        F.sum("sure").alias("pairs_high_confidence"),
    ).select(
        "*",
        (ratio(F.col("items_correct"), F.col("item_count")) * 100.0).alias("accuracy_pct"),
        (ratio(F.col("pairs_correct"), F.col("pair_count")) * 100.0).alias("pair_accuracy_pct"),
    )


def best_of_n_summary(subsets: DataFrame, ties: str = "Ties") -> DataFrame:
    """Macro average without the ties subset, and the half-and-half ties score."""
    is_tie = F.col("subset") == ties
    s = subsets.agg(
        F.avg(F.when(~is_tie, F.col("accuracy_pct"))).alias("macro"),
        F.max(F.when(is_tie, F.col("pair_accuracy_pct"))).alias("acc"),
        F.max(F.when(is_tie, ratio(F.col("pairs_high_confidence"), F.col("pair_count")) * 100.0)).alias("margin"),
    )
    return s.select(
        F.coalesce("macro", F.lit(0.0)).alias("average_pct"),
        F.col("acc").alias("ties_accuracy_term"),
        F.col("margin").alias("ties_margin_term"),
        (F.col("acc") * 0.5 + F.col("margin") * 0.5).alias("ties_weighted_score"),
    )


def plurality(votes: DataFrame, key: str, answer: str) -> DataFrame:
    """Most frequent valid answer per key; a tie at the top is inconclusive."""
    counted = votes.where(F.coalesce(F.col(answer), F.lit("")) != "").groupBy(key, answer).agg(
        F.count(F.lit(1)).alias("n")
    )
    # argmax by (count desc, answer asc) and the number of answers sharing the top
    best = counted.groupBy(key).agg(
        F.min(F.struct((-F.col("n")).alias("neg"), F.col(answer).alias("answer"))).alias("m"),
        F.max("n").alias("top"),
    )
    shared = counted.join(best, key).where(F.col("n") == F.col("top")).groupBy(key).agg(
        F.count(F.lit(1)).alias("sharing"), F.first("m.answer").alias("answer"), F.max("top").alias("top_votes")
    )
    out = votes.groupBy(key).agg(F.count(F.lit(1)).alias("samples")).join(shared, key, "left")
    clear = F.col("sharing") == 1
    return out.select(
        key, "samples", F.coalesce("top_votes", F.lit(0)).alias("top_votes"),
        F.when(clear, F.col("answer")).otherwise("").alias("winner"),
        F.when(F.col("sharing").isNull(), "no_valid_answers").when(clear, "").otherwise("inconclusive").alias("status"),
    )


def majority(votes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Yes/no majority; an even split counts as no."""
    yes = F.sum(F.col("satisfied").cast("bigint"))
    return votes.groupBy(*keys).agg(F.count(F.lit(1)).alias("samples"), yes.alias("yes_votes")).withColumn(
        "satisfied", F.col("yes_votes") > F.col("samples") - F.col("yes_votes")
    )
