"""Alignment of generated criteria to expert criteria, and its reports."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from verdikt.functions.text import ratio
from verdikt.operators.rowwise import with_python_column
from verdikt.operators.running import top_k

DIRECT, PARTIAL, FAMILY_BONUS = 0.55, 0.30, 0.2     # fixed values


CELLS = 1_000_000    # pairs of one prompt scored at once


def match_lists(expert_tokens, expert_family, made_tokens, made_family) -> list[tuple[float, int]]:
    """Best (score, generated index) per expert criterion; the first index wins ties.

    Intersections of one prompt's two lists are counted through the places of
    each token, for as many experts at a time as keep the pairs bounded.
    """
    if not len(expert_tokens):
        return []
    made = len(made_tokens)
    if not made:
        return [(0.0, -1)] * len(expert_tokens)
    places: dict = {}
    for i, toks in enumerate(made_tokens):
        for t in set(toks):
            places.setdefault(t, []).append(i)
    places = {t: np.array(at) for t, at in places.items()}
    made_size = np.array([len(t) for t in made_tokens], dtype=float)
    gf = np.asarray(made_family)
    out = []
    rows = max(1, CELLS // made)
    for start in range(0, len(expert_tokens), rows):
        some = expert_tokens[start : start + rows]
        hits = [places[t] + e * made for e, toks in enumerate(some) for t in set(toks) if t in places]
        inter = np.bincount(np.concatenate(hits), minlength=len(some) * made) if hits else np.zeros(len(some) * made)
        inter = inter.reshape(len(some), made).astype(float)
        union = np.array([len(t) for t in some], dtype=float)[:, None] + made_size[None, :] - inter
        ef = np.asarray(expert_family[start : start + rows])
        bonus = np.where((ef[:, None] == gf[None, :]) & (ef != "other")[:, None], FAMILY_BONUS, 0.0)
        score = np.round(inter / np.maximum(union, 1.0) + bonus, 9)
        best = score.argmax(axis=1)
        top = score[np.arange(len(best)), best]
        out += [(float(s), int(i) if s > 0 else -1) for s, i in zip(top, best)]
    return out


BEST = ArrayType(StructType([StructField("score", DoubleType()), StructField("index", IntegerType())]))


def best_matches(*lists) -> list[dict]:
    return [{"score": score, "index": index} for score, index in match_lists(*lists)]


def aligned(prompts: DataFrame) -> DataFrame:
    """Prompts with ``matches`` (one per expert) and ``assessed`` (one per generated).

    ``prompts`` carries experts array<struct<tokens, family, points, polarity>>
    and generated array<struct<tokens, family, polarity>>.  A prompt's lists are
    one row, so alignment needs no join and no pair becomes a row.
    """
    def part(c: str, name: str) -> Column:
        return F.transform(c, lambda x: x[name])

    sides = prompts.withColumns({
        "_et": part("experts", "tokens"), "_ef": part("experts", "family"), "_gt": part("generated", "tokens"), "_gf": part("generated", "family"),
        "experts": F.transform("experts", lambda e: e.dropFields("tokens")), "generated": F.transform("generated", lambda g: g.dropFields("tokens")),
    })
    found = with_python_column(sides, ["_et", "_ef", "_gt", "_gf"], "_best", BEST, best_matches).withColumns({
        "_made": F.transform("generated", lambda g: F.struct(g["family"].alias("family"), g["polarity"].alias("polarity"))),
        "_ef": F.array_distinct(part("experts", "family")),
    })

    def match(e: Column, i: Column) -> Column:
        b = F.col("_best")[i]
        label = F.when(b["score"] >= DIRECT, "direct").when(b["score"] >= PARTIAL, "partial").otherwise("none")
        index = F.when(b["score"] >= PARTIAL, b["index"])
        return F.struct(
            i.alias("expert_index"), e["family"].alias("family"), e["points"].alias("points"),
            label.alias("match_label"), index.alias("generated_index"),
            F.when(index.isNotNull(), F.col("_made")[index]["polarity"] == e["polarity"]).alias("polarity_match"),
        )

    out = found.withColumn("matches", F.transform("experts", match)).withColumn(
        "_hit", F.transform("matches", lambda m: m["generated_index"])
    )

    def assess(g: Column, i: Column) -> Column:
        fam = g["family"]
        label = (
            F.when(F.exists("_hit", lambda h: h == i), "aligned")
            .when(F.array_contains("_ef", fam) & (fam != "other"), "broader_but_valid")
            .when(fam == "other", "off_target").otherwise("valid_extra")
        )
        return F.struct(i.alias("generated_index"), fam.alias("family"), label.alias("precision_label"))

    return out.withColumn("assessed", F.transform("_made", assess)).drop("_best", "_made", "_ef", "_hit", "experts", "generated")


def _listed(rows: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    # outer + null filter: a plain explode would evaluate the array again as a filter
    return rows.select(*keys, F.explode_outer(column).alias("r")).where(F.col("r").isNotNull()).select(*keys, "r.*")


def match_rows(rows: DataFrame, keys: Sequence[str] = ("prompt_id",)) -> DataFrame:
    return _listed(rows, keys, "matches")


def assessment_rows(rows: DataFrame, keys: Sequence[str] = ("prompt_id",)) -> DataFrame:
    """aligned / broader_but_valid / valid_extra / off_target per generated criterion."""
    return _listed(rows, keys, "assessed")


def prompt_counts(rows: DataFrame) -> DataFrame:
    """Integer counts of one prompt; every report level is a sum of these."""
    def n(c: str, test=None) -> Column:
        return F.size(c if test is None else F.filter(c, test)).cast("bigint")

    def weight(test) -> Column:
        return F.aggregate(F.filter("matches", test), F.lit(0).cast("bigint"),
                           lambda acc, m: acc + F.abs(m["points"]).cast("bigint"))

    def labelled(value: str):
        return lambda g: g["precision_label"] == value

    hit = lambda m: m["match_label"] != "none"
    return rows.withColumns({
        "expert_total": n("matches"), "matched": n("matches", hit),
        "direct": n("matches", lambda m: m["match_label"] == "direct"),
        "matched_weight": weight(hit), "weight": weight(lambda m: F.lit(True)),
        "polarity_n": n("matches", lambda m: m["polarity_match"].isNotNull()),
        "polarity_ok": n("matches", lambda m: F.coalesce(m["polarity_match"], F.lit(False))),
        "generated_total": n("assessed"),
        **{name: n("assessed", labelled(value)) for name, value in (
            ("aligned", "aligned"), ("broader", "broader_but_valid"), ("extra", "valid_extra"), ("off_target", "off_target"))},
    }).drop("matches", "assessed")


COUNTS = ("expert_total", "matched", "direct", "matched_weight", "weight", "polarity_n", "polarity_ok",
          "generated_total", "aligned", "broader", "extra", "off_target")


def expert_metrics(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Recall, precision and polarity accuracy; keys choose prompt, profile or overall level."""
    s = counts.groupBy(*keys).agg(F.count(F.lit(1)).alias("examples"), *[F.sum(c).alias(c) for c in COUNTS])
    return s.select(
        *keys, "examples", "expert_total", "matched", "direct", "generated_total", "aligned", "off_target",
        ratio(F.col("matched_weight"), F.col("weight")).alias("weighted_recall"),
        ratio(F.col("matched"), F.col("expert_total")).alias("expert_recall"),
        ratio(F.col("aligned") + F.col("broader"), F.col("generated_total")).alias("precision"),
        ratio(F.col("polarity_ok"), F.col("polarity_n")).alias("polarity_accuracy"),
    )


def gaps(rows: DataFrame, profile: str) -> DataFrame:
    """Granularity gaps of both sides, from one pass over the aligned prompts."""
    def gap(x: Column, side: str, kind: Column) -> Column:
        return F.struct(x["family"].alias("family"), F.lit(side).alias("side"), kind.alias("gap_type"))

    gold = F.transform(F.filter("matches", lambda m: m["match_label"] != "direct"), lambda m: gap(
        m, "gold", F.when(m["match_label"] == "none", "missing_gold_criterion").otherwise("too_coarse")))
    made = F.transform(F.filter("assessed", lambda g: g["precision_label"].isin("off_target", "valid_extra")), lambda g: gap(
        g, "generated", F.when(g["precision_label"] == "off_target", "off_target").otherwise("too_granular")))
    found = rows.select(F.col(profile).alias("profile"), F.concat(gold, made).alias("g"))
    return _listed(found, ["profile"], "g")


def family_coverage(alignment: DataFrame) -> DataFrame:
    hit = F.col("match_label").isin("direct", "partial")
    weight = F.abs("points").cast("bigint")
    s = alignment.groupBy("family").agg(
        F.count(F.lit(1)).alias("expert_count"), F.sum(weight).alias("expert_weight"),
        F.count(F.when(hit, 1)).alias("matched_count"), F.sum(F.when(hit, weight).otherwise(0)).alias("matched_weight"),
    )
    return s.select(
        "*", ratio(F.col("matched_weight"), F.col("expert_weight")).alias("weighted_recall"),
        ratio(F.col("matched_count"), F.col("expert_count")).alias("expert_recall"),
    )


def gap_counts(gaps: DataFrame) -> DataFrame:
    """Gap counts overall, by profile and by family: one pass with grouping sets."""
    return gaps.groupingSets(
        [(F.col("gap_type"),), (F.col("profile"), F.col("gap_type")), (F.col("family"), F.col("gap_type"))],
        F.col("profile"), F.col("family"), F.col("gap_type"),
    ).agg(F.count(F.lit(1)).alias("gaps"))


def calibration_hints(gaps: DataFrame, least: int = 2) -> DataFrame:
    """Families missed or exceeded often enough to bias the next run."""
    missing = F.col("gap_type").isin("too_coarse", "family_mismatch", "missing_gold_criterion") & (F.col("side") == "gold")
    extra = F.col("gap_type").isin("too_granular", "family_mismatch", "off_target") & (F.col("side") == "generated")
    s = gaps.groupBy("profile", "family").agg(
        F.count(F.when(missing, 1)).alias("missing"), F.count(F.when(extra, 1)).alias("extra")
    )
    return s.select(
        "profile", "family", "missing", "extra", (F.col("missing") >= least).alias("split_bias"),
        (F.col("extra") >= least).alias("merge_bias"),
        (F.col("family").isin("other", "content_coverage") & (F.col("extra") >= least)).alias("drop_family"),
    ).where(F.col("split_bias") | F.col("merge_bias"))


def dimension_bias(gaps: DataFrame, least: int = 2) -> DataFrame:
    """Most frequent family per (profile, dimension), when seen at least ``least`` times."""
    counts = gaps.groupBy("profile", "dimension", "family").agg(F.count(F.lit(1)).alias("n"))
    return top_k(counts, ["profile", "dimension"], [F.col("n").desc(), F.col("family").asc()], 1).where(
        F.col("n") >= least
    ).drop("rank")


def profile_policy(before: DataFrame, after: DataFrame, min_examples: int = 5,
                   protected: Sequence[str] = ("note_documentation",)) -> DataFrame:
    """Profiles whose held-out metrics did not regress, with the reason."""
    metrics = ("weighted_recall", "expert_recall", "precision", "off_target")
    b = before.select("profile", F.col("examples").alias("b_examples"), *[F.col(m).alias(f"b_{m}") for m in metrics])
    j = after.join(b, "profile", "full")
    j = j.withColumns({f"d_{m}": F.coalesce(m, F.lit(0.0)) - F.coalesce(f"b_{m}", F.lit(0.0)) for m in metrics})
    n = F.coalesce("examples", "b_examples", F.lit(0))
    kept = F.col("profile").isin(*protected)
    better = (
        (F.col("d_weighted_recall") >= 0) & (F.col("d_expert_recall") >= 0) & (F.col("d_precision") >= 0)
        & (F.col("d_off_target") <= 0)
    )
    why = F.concat_ws(
        ",",
        F.when(F.col("d_weighted_recall") < 0, "weighted_recall_regressed"),
        F.when(F.col("d_expert_recall") < 0, "expert_recall_regressed"),
        F.when(F.col("d_precision") < 0, "precision_regressed"),
        F.when(F.col("d_off_target") > 0, "off_target_increased"),
    )
    return j.select(
        "profile", n.alias("examples_scored"), (~kept & (n >= min_examples) & better).alias("eligible"),
        F.when(kept, "protected_profile").when(n < min_examples, "insufficient_heldout_examples")
        .when(better, "heldout_improvement").otherwise(why).alias("reason"),
        *[F.col(f"d_{m}") for m in metrics],
    )
