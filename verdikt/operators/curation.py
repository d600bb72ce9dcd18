"""Row pruning, cluster collapse, relevance gates, schedules and profile choice."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdikt.operators.running import top_k

# Fixed values: (rows kept, broad rows kept) per family and pruning profile.
PRUNING_V1 = {"mmlu-pro": (18, 5), "livebench-reasoning": (16, 4), "livebench-math": (16, 4), "": (18, 4)}
PRUNING_V2 = {"mmlu-pro": (16, 3), "livebench-reasoning": (14, 2), "livebench-math": (15, 3),
              "livecodebench": (18, 3), "": (16, 3)}
# Verdicts a relevance gate keeps.
GATE_KEEPS = {"conservative": ("APPLICABLE", "UNCERTAIN"), "aggressive": ("APPLICABLE",)}
# Temperatures of the generation schedule.
TEMPERATURES = (0.0, 0.2, 0.3, 0.1)
# Weights of feature counts per profile.
PROFILE_WEIGHTS = {
    "note_documentation": {"documentation": 0.5, "clinical": 1.5},
    "documentation_variants": {"documentation": 2.0, "structure": 1.25, "actions": 0.75},
    "rewrite_editing": {"rewrite": 3.0, "constraints": 1.0, "structure": 0.5},
    "clinical_decision_support": {"recommendation": 2.5, "evidence": 1.0, "clinical": 1.0},
    "general_instruction_following": {"constraints": 1.5, "structure": 0.5, "answer_format": 1.5,
                                      "multiple_choice": 1.25, "code": 1.0, "examples": 0.5},
    "agentic_workflows": {"steps": 2.0, "tool_results": 2.5, "verification": 1.5, "failure": 1.5},
}


def collapse_clusters(rows: DataFrame, keys: Sequence[str], cluster: str, order: Sequence[Column],
                      row_id: str) -> DataFrame:
    """Best row per cluster; rows without a cluster all pass."""
    group = F.coalesce(F.col(cluster), F.concat(F.lit("row:"), F.col(row_id).cast("string")))
    return top_k(rows.withColumn("_g", group), [*keys, "_g"], order, 1, "_k").drop("_g", "_k")


def limits(family: Column, table: Mapping[str, tuple[int, int]]) -> tuple[Column, Column]:
    """(max rows, max broad rows) columns by family, '' being the default."""
    total, broad = F.lit(table[""][0]), F.lit(table[""][1])
    for name, (t, b) in table.items():
        if name:
            total = F.when(family == name, t).otherwise(total)
            broad = F.when(family == name, b).otherwise(broad)
    return total, broad


def prune(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], family: str,
          table: Mapping[str, tuple[int, int]] = PRUNING_V2) -> DataFrame:
    """Best rows under a total cap and a cap on broad rows.

    Walking down the priority order and skipping broad rows beyond their cap is
    the same as cutting the broad rows first and then all rows: two top-k steps,
    both limited before the shuffle.
    """
    total, broad = limits(F.col(family), table)
    most = max(t for t, _ in table.values())
    first = top_k(rows, [*keys, "is_broad"], order, most, "_b").where(~F.col("is_broad") | (F.col("_b") <= broad))
    return top_k(first, list(keys), order, most, "position").where(F.col("position") <= total).drop("_b")


def relevance_gate(criteria: DataFrame, verdicts: DataFrame, keys: Sequence[str], strictness: str = "conservative") -> DataFrame:
    """Criteria a relevance verdict lets through; a missing verdict is uncertain."""
    joined = criteria.join(verdicts.select(*keys, "verdict"), list(keys), "left")
    known = F.when(F.col("verdict").isin("APPLICABLE", "UNCERTAIN", "NOT_APPLICABLE"), F.col("verdict")).otherwise("UNCERTAIN")
    return joined.withColumn("verdict", known).where(F.col("verdict").isin(*GATE_KEEPS[strictness]))


def generation_plan(examples: DataFrame, key: str, models: Sequence[str], styles: Sequence[str], count: int) -> DataFrame:
    """Round-robin model x style x temperature schedule per example."""
    jobs = F.array(*[
        F.struct(F.lit(i).alias("job"), F.lit(models[i % len(models)]).alias("model"),
                 F.lit(styles[i % len(styles)]).alias("style"), F.lit(TEMPERATURES[i % 4]).alias("temperature"))
        for i in range(count)
    ])
    return examples.select(key, F.inline(jobs))


def top_terms(tokens: DataFrame, keys: Sequence[str], k: int = 3) -> DataFrame:
    """Most frequent terms per key; equal counts go to the earlier first occurrence.

    ``tokens``: keys, term, place (a sortable struct).
    """
    counted = tokens.groupBy(*keys, "term").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("_p"))
    return top_k(counted, list(keys), [F.col("n").desc(), F.col("_p").asc()], k).drop("_p")


def profile_scores(features: DataFrame, key: str) -> DataFrame:
    """Profile scores of a slice from feature counts plus two points per routed example.

    ``features``: key, profile (routed), counts as columns named in the weights.
    """
    routed = {p: F.sum((F.col("profile") == p).cast("bigint")).alias(f"_r_{p}") for p in PROFILE_WEIGHTS}
    names = sorted({f for w in PROFILE_WEIGHTS.values() for f in w})
    sums = features.groupBy(key).agg(*routed.values(), *[F.sum(n).alias(n) for n in names if n in features.columns])
    cells = F.array(*[
        F.struct(F.lit(p).alias("profile"), (
            F.col(f"_r_{p}") * 2.0 + sum((F.col(f) * w for f, w in weights.items() if f in features.columns), F.lit(0.0))
        ).alias("score"))
        for p, weights in PROFILE_WEIGHTS.items()
    ])
    return sums.select(key, F.inline(cells))


def parent_profile(scores: DataFrame, key: str) -> DataFrame:
    return top_k(scores, [key], [F.col("score").desc(), F.col("profile").asc()], 1).drop("rank")


def ungrounded_terms(note: Column, dialogue: Column, terms: Sequence[str]) -> Column:
    """First listed term that the note uses and the dialogue does not, or NULL."""
    n, d = F.lower(note), F.lower(dialogue)
    return F.coalesce(*[F.when(F.contains(n, F.lit(t)) & ~F.contains(d, F.lit(t)), t) for t in terms])


# Source labels from the most to the least trusted.
SOURCE_PRIORITY = ("reference_note", "reference_artifact", "augmented_note", "augmented_artifact",
                   "note_truncated", "artifact_truncated")


def source_rank(label: Column, priority: Sequence[str] = SOURCE_PRIORITY) -> Column:
    out = F.lit(99)
    for i, name in reversed(list(enumerate(priority))):
        out = F.when(label == name, i).otherwise(out)
    return out


def strong_and_weak(candidates: DataFrame, key: str = "example_id") -> DataFrame:
    """Each candidate's role in discovery pairs: strong, weak or unused.

    Strong is the best original by source priority.  Weak are the synthetic
    candidates, or, where an example has none, the originals after the strong one.
    """
    synthetic = F.col("origin_kind") == "synthetic"
    order = F.struct(source_rank(F.col("source_label")).alias("p"), F.col("candidate_id").alias("id"))
    facts = candidates.groupBy(key).agg(
        F.min(F.when(~synthetic, order)).alias("_s"), F.max(synthetic).alias("_any")
    )
    role = (
        F.when(~synthetic & (F.col("candidate_id") == F.col("_s.id")), "strong")
        .when(F.col("_s").isNull(), "unused")
        .when(synthetic, "weak")
        .when(~F.col("_any") & (order > F.col("_s")), "weak")
        .otherwise("unused")
    )
    return candidates.join(facts, key).withColumn("role", role).drop("_s", "_any")


def side_assignment(pairs: DataFrame, seed: str) -> DataFrame:
    """Put the strong response on side A or B by a hash of the pair id."""
    first = F.substring(F.md5(F.concat(F.lit(seed + "|"), F.col("pair_id").cast("string"))), 1, 1) < "8"
    return pairs.select(
        "*", F.when(first, F.col("strong")).otherwise(F.col("weak")).alias("response_a"),
        F.when(first, F.col("weak")).otherwise(F.col("strong")).alias("response_b"),
        F.when(first, "A>B").otherwise("B>A").alias("label"),
    )


def blind_view(pairs: DataFrame, hidden: Sequence[str], visible: Column) -> DataFrame:
    """Blank reference columns where a row may not see them."""
    return pairs.withColumns({c: F.when(visible, F.col(c)).otherwise(F.lit("")) for c in hidden})


def fold_gap(results: DataFrame, held_out: Column) -> DataFrame:
    """Accuracy per family on the fitted and on the held-out rows, and their gap."""
    def rate(side: Column) -> Column:
        n, ok = F.count(F.when(side, 1)), F.count(F.when(side & F.col("correct"), 1))
        return F.when(n == 0, 0.0).otherwise(ok * 100.0 / n)

    s = results.groupBy("source_family").agg(rate(~held_out).alias("train_fit"), rate(held_out).alias("held_out"))
    return s.withColumn("gap", F.round(F.col("train_fit") - F.col("held_out"), 6))
