"""Rule-based compression of rubric banks and behaviour statistics."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdikt.functions import text as T
from verdikt.functions.text import ratio
from verdikt.operators.scoring import BANK_STRONG, WEAK, discrimination


@dataclass(frozen=True)
class CategoryRule:
    category_id: str
    family: str
    priority: int
    keywords: tuple[str, ...]
    anti_keywords: tuple[str, ...] = ()
    min_hits: int = 1


def _hits(v: Column, words: Sequence[str]) -> Column:
    """Phrases found; a single [a-z0-9] word is a token lookup, others are patterns."""
    def found(w: str) -> Column:
        plain = w.isascii() and w.isalnum()
        return F.array_contains(v["tokens"], w) if plain else T.has_phrase(v["low"], w)

    return sum((found(w.lower()).cast("int") for w in words), F.lit(0))


def categories_of(text: Column, rules: Sequence[CategoryRule]) -> Column:
    """Array of matching categories (2 per keyword, -2 per anti-keyword).

    One self-contained expression: the normalised text and the counts are bound
    once, so a predicate pushed below it repeats it at most once.
    """
    ordered = sorted(rules, key=lambda r: r.priority)

    def counts(v: Column) -> Column:
        return F.array(*[
            F.struct(
                F.lit(r.category_id).alias("category_id"), F.lit(r.family).alias("family"),
                F.lit(r.min_hits).alias("min_hits"), _hits(v, r.keywords).alias("hits"),
                _hits(v, r.anti_keywords).alias("anti"),
            )
            for r in ordered
        ])

    view = T.let(F.lower(T.squeeze(text)), lambda low: F.struct(low.alias("low"), T.token_set(low).alias("tokens")))
    cells = T.let(view, counts)
    matches = F.filter(cells, lambda m: (m["hits"] >= m["min_hits"]) & (m["hits"] > m["anti"]))
    return F.transform(matches, lambda m: F.struct(
        m["category_id"].alias("category_id"), m["family"].alias("family"), m["hits"].alias("hits"),
        ((m["hits"] - m["anti"]) * 2).alias("score"),
    ))


def matched_categories(rubrics: DataFrame, rules: Sequence[CategoryRule], text: str = "text") -> DataFrame:
    """Rubrics with their matching categories; rules are expressions, not a join."""
    return rubrics.withColumn("categories", categories_of(F.col(text), rules))


def representative_score(m: Column, words: Column) -> Column:
    # Bonuses and the length penalty of a representative.
    return (
        (m["score"] + m["hits"]).cast("double")
        + F.when(F.col("source_stage") == "initial", 2.5).otherwise(0.0)
        + F.when(F.col("depth") == 0, 1.0).otherwise(0.0)
        + F.least(F.col("coverage_count"), F.lit(8)) * 0.1
        - F.greatest(words, F.lit(1)) / 200.0
    )


def compress(matched: DataFrame, keys: Sequence[str], words: str = "word_count") -> DataFrame:
    """Per category: members, representative (argmax, first wins) and coverage."""
    # outer + null filter: a plain explode would re-evaluate the array as a filter in the scan
    exploded = matched.select("*", F.explode_outer("categories").alias("m")).where(F.col("m").isNotNull())
    members = exploded.select(
        *keys, "rubric_id", "depth", "coverage_count",
        F.col("m.category_id").alias("category_id"), F.col("m.family").alias("family"),
        F.round(representative_score(F.col("m"), F.col(words)), 9).alias("rep_score"),
    )
    best = F.max(F.struct(F.col("rep_score"), (-F.col("rubric_id")).alias("neg")))
    return members.groupBy(*keys, "category_id", "family").agg(
        F.count(F.lit(1)).alias("member_count"),
        F.max("coverage_count").alias("max_coverage_count"),
        F.min("depth").alias("min_depth"),
        best.alias("_b"),
    ).withColumn("representative_id", -F.col("_b.neg")).drop("_b")


def behavior(evals: DataFrame, membership: DataFrame) -> DataFrame:
    """Union coverage, discrimination and strong/weak rates per (example, group).

    ``membership`` maps rubric_id to group_id.  The union over member rubrics is
    a max per candidate, so satisfying sets are never built.
    """
    any_hit = (
        evals.join(membership, "rubric_id")
        .groupBy("example_id", "group_id", "candidate_id", "quality_bucket")
        .agg(F.max("satisfied").alias("hit"))
    )
    hit = F.col("hit").cast("bigint")
    strong, weak = F.col("quality_bucket").isin(*BANK_STRONG), F.col("quality_bucket").isin(*WEAK)
    s = any_hit.groupBy("example_id", "group_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum(hit).alias("coverage_count"),
        F.count(F.when(strong, 1)).alias("sn"), F.sum(F.when(strong, hit).otherwise(0)).alias("sh"),
        F.count(F.when(weak, 1)).alias("wn"), F.sum(F.when(weak, hit).otherwise(0)).alias("wh"),
    )
    p = ratio(F.col("coverage_count"), F.col("n"))
    return s.select(
        "example_id", "group_id", "coverage_count", p.alias("coverage_ratio"),
        discrimination(p).alias("discrimination_score"),
        ratio(F.col("sh"), F.col("sn")).alias("strong_rate"),
        ratio(F.col("wh"), F.col("wn")).alias("weak_rate"),
    )


def production_bank(compressed: DataFrame, groups: dict[str, str], keys: Sequence[str],
                    members: DataFrame) -> DataFrame:
    """Compressed categories regrouped; merged when several categories or members meet."""
    mapping = F.create_map(*[F.lit(x) for kv in groups.items() for x in kv])
    group = F.coalesce(mapping[F.col("category_id")], F.col("category_id"))
    cats = compressed.withColumn("group_id", group).groupBy(*keys, "group_id").agg(
        F.count(F.lit(1)).alias("category_count"),
        F.max(F.struct("member_count", "max_coverage_count", "representative_id")).alias("_b"),
    )
    distinct = members.withColumn("group_id", group).groupBy(*keys, "group_id").agg(
        F.countDistinct("rubric_id").alias("source_member_count")
    )
    return cats.join(distinct, [*keys, "group_id"]).select(
        *keys, "group_id", "category_count", "source_member_count",
        F.col("_b.member_count").alias("largest_category"),
        F.when((F.col("category_count") > 1) | (F.col("source_member_count") > 1), "merged")
        .otherwise("kept").alias("action_taken"),
    )


# Defaults of the decomposition gate.
MIN_RECALL, MAX_EXTRA, MAX_PAIR_OVERLAP, MIN_GAIN = 0.85, 0.15, 0.75, 0.03


def decomposition_gate(wide: DataFrame, parent: str, left: str, right: str,
                       key: str = "example_id") -> DataFrame:
    """Whether two children may replace their parent, from counts alone."""
    p, a, b = (F.col(c) == 1 for c in (parent, left, right))

    def n(c: Column) -> Column:
        return F.count(F.when(c, 1))

    s = wide.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"), n(p).alias("p"), n(a).alias("a"), n(b).alias("b"),
        n(a | b).alias("u"), n(p & (a | b)).alias("pu"), n((a | b) & ~p).alias("extra"), n(a & b).alias("ab"),
    )
    total = F.col("n")
    s = s.withColumns({
        "coverage_recall": ratio(F.col("pu"), F.col("p")),
        "extra_ratio": ratio(F.col("extra"), F.col("u")),
        "pair_overlap": ratio(F.col("ab"), F.col("u"), 1.0),
        "discrimination_gain": F.greatest(
            discrimination(ratio(F.col("a"), total)), discrimination(ratio(F.col("b"), total))
        ) - discrimination(ratio(F.col("p"), total)),
    })
    informative = (F.col("a") > 0) & (F.col("a") < total) & (F.col("b") > 0) & (F.col("b") < total)
    narrower = (F.col("p") > 0) & (F.col("a") < F.col("p")) & (F.col("b") < F.col("p"))
    retain = (
        informative & narrower & (F.col("coverage_recall") >= MIN_RECALL) & (F.col("extra_ratio") <= MAX_EXTRA)
        & (F.col("pair_overlap") <= MAX_PAIR_OVERLAP) & (F.col("discrimination_gain") >= MIN_GAIN)
    )
    return s.select(
        key, F.col("p").alias("parent_coverage"), F.col("u").alias("child_union"), "coverage_recall", "extra_ratio",
        "pair_overlap", "discrimination_gain", retain.alias("retain_children"),
    )


def bank_judgment(banks: DataFrame, overlap: str = "overlap") -> DataFrame:
    """Heuristic 0-10 scores of a bank from its size, phrasing and overlap."""
    n = F.col("rubric_count").cast("double")
    # Offsets and slopes of the heuristic scores.
    parts = {
        "coverage": F.least(F.lit(10.0), 4.0 + n / 3.0),
        "atomicity": F.greatest(F.lit(0.0), 9.0 - F.col("stacked")),
        "redundancy": F.greatest(F.lit(0.0), 10.0 - F.col(overlap) * 12.0),
        "directionality": F.lit(8.0),
        "executability": F.greatest(F.lit(0.0), 8.5 - F.col("wordy") * 0.5),
    }
    scored = banks.select("*", *[F.when(n == 0, 0.0).otherwise(c).alias(k) for k, c in parts.items()])
    mean = sum((F.col(k) for k in parts), F.lit(0.0)) / float(len(parts))
    return scored.withColumn("overall_usefulness", mean)
