"""Decision overrides for a pair, as layers of CASE over one row.

State columns: decision, decision_reversed, policy, base_decision, score_a,
score_b, unstable, no_signal.  Every layer rewrites those and nothing else, so
the whole cascade is one projection: no shuffle after the pair row exists.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdikt.functions import decisions as D

# Fixed value: largest score margin an unstable whitened decision may be flipped at.
UNSTABLE_MARGIN = 0.006
# The wider discriminator gate.
WIDE_MARGIN = 0.02
WIDE_REASONING_MARGIN = 0.05


def margin() -> Column:
    return F.abs(F.col("score_a") - F.col("score_b"))


def _override(df: DataFrame, when: Column, decision: Column, policy: str, reverse: bool = True,
              keep_base: bool = False, extra: dict[str, Column] | None = None) -> DataFrame:
    """One layer: the condition becomes a column once, the state columns read it."""
    df = df.withColumn("_fire", F.coalesce(when, F.lit(False)))
    fire = F.col("_fire")
    changed = {
        "policy": F.when(fire, policy).otherwise(F.col("policy")),
        "decision": F.when(fire, decision).otherwise(F.col("decision")),
    }
    if not keep_base:
        changed["base_decision"] = F.when(fire, F.col("decision")).otherwise(F.col("base_decision"))
    if reverse:
        changed["decision_reversed"] = F.when(fire, D.flip(decision)).otherwise(F.col("decision_reversed"))
    for name, value in (extra or {}).items():
        changed[name] = F.when(fire, value).otherwise(F.col(name))
    return df.withColumns(changed).drop("_fire")


def start(df: DataFrame) -> DataFrame:
    """Initial state from score_a, score_b, unstable and no_signal."""
    decision = D.compare(F.col("score_a"), F.col("score_b"))
    return df.withColumns(
        {
            "decision": decision,
            "decision_reversed": D.flip(decision),
            "policy": F.lit("whitened_uniform"),
            "base_decision": F.lit(""),
        }
    )


def _take_uniform(df, when, policy):
    scores = {"score_a": F.col("uniform_score_a"), "score_b": F.col("uniform_score_b")}
    return _override(df, when, F.col("uniform_decision"), policy, extra=scores)


def stabilize(df: DataFrame) -> DataFrame:
    """Uniform weighting breaks a strict tie or overrides unstable whitening."""
    directional = D.is_directional(F.col("uniform_decision")) & F.col("strict")
    flipped = (
        directional & F.col("unstable") & D.is_directional(F.col("decision"))
        & (F.col("uniform_decision") != F.col("decision"))
    )
    tie = directional & (F.col("decision") == D.EVEN)
    out = df.withColumn("_tie", tie).withColumn("_flip", flipped)
    out = _take_uniform(out, F.col("_tie"), "uniform_breaks_strict_tie")
    return _take_uniform(out, F.col("_flip"), "uniform_overrides_unstable_whitening").drop("_tie", "_flip")


def stabilize_blind(df: DataFrame) -> DataFrame:
    """The variant without references: three families, no-signal ties, tiny margins."""
    directional = (
        D.is_directional(F.col("uniform_decision")) & F.col("strict")
        & F.col("source_family").isin(*D.BLIND_FAMILIES)
    )
    tie = directional & (F.col("decision") == D.EVEN) & F.col("no_signal")
    flipped = (
        directional & F.col("unstable") & (margin() <= UNSTABLE_MARGIN)
        & D.is_directional(F.col("decision")) & (F.col("uniform_decision") != F.col("decision"))
    )
    out = df.withColumn("_tie", tie).withColumn("_flip", flipped)
    out = _take_uniform(out, F.col("_tie"), "blind_uniform_breaks_tie")
    return _take_uniform(out, F.col("_flip"), "blind_uniform_overrides_unstable_whitening").drop("_tie", "_flip")


def apply_verifier(df: DataFrame, decision: Column, confidence: Column, source: Column,
                   agreeing_high: Column) -> DataFrame:
    usable = D.is_directional(decision) & confidence.isin("medium", "high")
    precise = (confidence == "high") & (source.isin(*D.HIGH_PRECISION_SOURCES) | agreeing_high)
    shaky = (confidence == "high") & F.col("unstable") & (margin() <= UNSTABLE_MARGIN)
    tie = F.col("decision") == D.EVEN
    when = usable & (F.col("decision") != decision) & (
        (tie & F.col("no_signal")) | (~tie & (precise | shaky))
    )
    return _override(df, when, decision, "pair_verifier")


def apply_discriminator(df: DataFrame, decision: Column, confidence: Column) -> DataFrame:
    """Only ties without signal, and never the multiple-choice family."""
    when = (
        (F.col("source_family") != "mmlu-pro") & D.is_directional(decision) & (confidence != "low")
        & (F.col("decision") == D.EVEN) & F.col("no_signal")
    )
    return _override(df, when, decision, "pairwise_discriminator", keep_base=True)


def apply_blind_discriminator(df: DataFrame, decision: Column, confidence: Column,
                              routed: Column) -> DataFrame:
    when = routed & D.is_directional(decision) & (confidence != "low") & (F.col("decision") != decision)
    return _override(df, when, decision, "blind_pair_discriminator")


def apply_holistic(df: DataFrame, decision: Column, confidence: Column, consistent: Column,
                   low_margin: float = 0.005, high_only: bool = True) -> DataFrame:
    """Low-margin override; the reversed decision is left as it was."""
    allowed = confidence.isin("high") if high_only else confidence.isin("medium", "high")
    directional = D.is_directional(F.col("decision"))
    when = (
        D.is_directional(decision) & allowed & consistent
        & (~directional | ((F.col("decision") != decision) & (margin() <= low_margin)))
    )
    return _override(df, when, decision, "holistic_judge", reverse=False)


def discriminator_route(rubric_count: Column, verifier_decision: Column, verifier_confidence: Column,
                        strict_mode: bool = True, wide: bool = False,
                        small_margin: Column | None = None) -> Column:
    """Whether the costly discriminator runs for a pair."""
    small = F.lit(False) if small_margin is None else small_margin
    # Rubric counts and margins of the routes.
    least = F.when(small, 14 if strict_mode else 12).otherwise(16 if strict_mode else 14)
    limit = F.when(small, 0.01 if strict_mode else 0.0125).otherwise(0.0025 if strict_mode else 0.0035)
    reasoning = F.col("source_family") == "livebench-reasoning"
    family_margin = F.when(reasoning, WIDE_REASONING_MARGIN).otherwise(WIDE_MARGIN)
    if wide:
        least = F.least(least, F.lit(10))
        limit = F.greatest(limit, family_margin)
    settled = D.is_directional(verifier_decision) & verifier_confidence.isin("medium", "high")
    by_margin = F.when(small, margin() <= limit).otherwise(F.col("unstable") & (margin() <= limit))
    if wide:
        by_margin = by_margin | (margin() <= family_margin) | F.col("unstable")
    return F.coalesce(
        F.col("source_family").isin(*D.BLIND_FAMILIES) & ~settled & (rubric_count >= least)
        & F.when(F.col("decision") == D.EVEN, F.col("no_signal")).otherwise(by_margin),
        F.lit(False),
    )


def _tally(attempts: Column, test) -> Column:
    return F.size(F.filter(attempts, test))


def with_discriminator(df: DataFrame, attempts: str, prefix: str = "disc") -> DataFrame:
    """Unanimity among directional attempts, with a merged confidence.

    ``attempts`` is the short array<struct<order, decision, confidence>> a pair
    carries (two per sampling round), so the vote stays inside the row.
    """
    rows = F.col(attempts)
    ranks = F.transform(
        F.filter(rows, lambda x: x["decision"].isin(*D.DIRECTIONAL)), lambda x: D.confidence_rank(x["confidence"])
    )
    df = df.withColumns({
        "_a": _tally(rows, lambda x: x["decision"] == D.FIRST),
        "_b": _tally(rows, lambda x: x["decision"] == D.SECOND),
        "_e": _tally(rows, lambda x: x["decision"] == D.EVEN),
        "_r": ranks,
    })
    a, b, even, r = F.col("_a"), F.col("_b"), F.col("_e"), F.col("_r")
    split, none = (a > 0) & (b > 0), (a + b) == 0
    strong = (F.size(r) >= 2) & (F.array_min(r) >= 2)
    return df.withColumns({
        f"{prefix}_decision": F.when(none & (even == 0), "").when(none, D.EVEN).when(split, "")
        .when(a > 0, D.FIRST).otherwise(D.SECOND),
        f"{prefix}_confidence": F.when(none & (even == 0), "").when(none, "low").when(split, "")
        .when(strong & (even > 0), "medium").when(strong, "high")
        .when(F.array_max(r) >= 2, "medium").otherwise("low"),
        f"{prefix}_consistent": ~split,
    }).drop("_a", "_b", "_e", "_r")


def with_holistic(df: DataFrame, attempts: str, prefix: str = "holi") -> DataFrame:
    """The holistic judge's vote: one direction is enough, confidence needs all."""
    rows = F.col(attempts)
    df = df.withColumns({
        "_a": _tally(rows, lambda x: x["decision"] == D.FIRST),
        "_b": _tally(rows, lambda x: x["decision"] == D.SECOND),
        "_e": _tally(rows, lambda x: x["decision"] == D.EVEN),
        "_s": _tally(rows, lambda x: x["confidence"] != ""),
        "_h": _tally(rows, lambda x: x["confidence"] == "high"),
        "_m": _tally(rows, lambda x: x["confidence"].isin("high", "medium")),
    })
    a, b = F.col("_a"), F.col("_b")
    split, none = (a > 0) & (b > 0), (a + b) == 0
    return df.withColumns({
        f"{prefix}_decision": F.when(split, "").when(a > 0, D.FIRST).when(b > 0, D.SECOND)
        .when((F.col("_e") == F.size(rows)) & (F.size(rows) > 0), D.EVEN).otherwise(""),
        f"{prefix}_confidence": F.when(split | none, "")
        .when((F.col("_s") > 0) & (F.col("_h") == F.col("_s")), "high")
        .when(F.col("_m") > 0, "medium").otherwise("low"),
        f"{prefix}_consistent": ~split,
    }).drop("_a", "_b", "_e", "_s", "_h", "_m")


# Override policies each ablation reverts.
ABLATION_POLICIES = {
    "no_holistic": ("holistic_judge",),
    "no_discriminator": ("blind_pair_discriminator", "pairwise_discriminator"),
    "no_pair_verifier": ("pair_verifier",),
}
ABLATIONS = (
    "v2_full",
    "no_holistic",
    "no_discriminator",
    "no_pair_verifier",
    "no_holistic+no_discriminator",
    "no_holistic+no_pair_verifier",
    "no_holistic+no_discriminator+no_pair_verifier",
)


def ablated(df: DataFrame) -> DataFrame:
    """One row per (pair, ablation) with the decision after reverting policies."""
    variants = []
    for name in ABLATIONS:
        gone = [p for part in name.split("+") for p in ABLATION_POLICIES.get(part, ())]
        back = F.col("policy").isin(*gone) & F.col("base_decision").isin(*D.DIRECTIONAL, D.EVEN) if gone else F.lit(False)
        variants.append(
            F.struct(
                F.lit(name).alias("ablation"),
                F.when(back, F.col("base_decision")).otherwise(F.col("decision")).alias("ablated_decision"),
                F.when(back, D.flip(F.col("base_decision"))).otherwise(F.col("decision_reversed"))
                .alias("ablated_reversed"),
            )
        )
    return df.select("*", F.inline(F.array(*variants)))
