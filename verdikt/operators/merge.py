"""Dedupe, merge and library operators.

Identity is a digest of the normalised text, so shuffles carry 32 bytes per row
instead of the text; first-seen values are min-by-ordinal aggregates, which fold
a hot group of copies on the map side.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from verdikt.session import durable
from verdikt.functions import text as T
from verdikt.operators.running import top_k


def normal_key(c: Column) -> Column:
    return F.lower(T.squeeze(c))


def digest(*cols: Column) -> Column:
    """Collision-safe identity of normalised parts."""
    return F.sha2(F.concat_ws("||", *[normal_key(c) for c in cols]), 256)


def first_seen(df: DataFrame, key: str, ordinal: str, carry: Sequence[str] = ()) -> DataFrame:
    """One row per key: the earliest ordinal, its carried columns and the copies."""
    if not carry:
        return df.groupBy(key).agg(F.min(ordinal).alias(ordinal), F.count(F.lit(1)).alias("copies"))
    first = F.min(F.struct(ordinal, *carry))
    out = df.groupBy(key).agg(first.alias("_f"), F.count(F.lit(1)).alias("copies"))
    return out.select(key, *[F.col(f"_f.{c}").alias(c) for c in (ordinal, *carry)], "copies")


def merge_members(df: DataFrame, key: str, ordinal: str, lists: Sequence[str]) -> DataFrame:
    """The distinct values behind a merged row, with their first position.

    Kept as rows, because a list column of a hot key would not fit one record.
    """
    kinds = F.array(*[
        F.struct(F.lit(c).alias("kind"), F.col(c).cast("string").alias("value")) for c in lists
    ])
    return (
        df.select(key, ordinal, F.inline(kinds))
        .where(F.coalesce(F.col("value"), F.lit("")) != "")
        .groupBy(key, "kind", "value")
        .agg(F.min(ordinal).alias("first_ordinal"))
    )


def latest_per_key(df: DataFrame, key: str, ordinal: str, payload: Sequence[str]) -> DataFrame:
    """Last record per key wins."""
    last = F.max(F.struct(ordinal, *payload))
    return df.groupBy(key).agg(last.alias("_l")).select(
        key, F.col(f"_l.{ordinal}").alias(ordinal), *[F.col(f"_l.{c}").alias(c) for c in payload]
    )


def merge_libraries(existing: DataFrame, new: DataFrame, key: str, prefer_new: bool = False) -> DataFrame:
    """Keyed union: one side wins on a conflict, by an anti join."""
    winner, other = (new, existing) if prefer_new else (existing, new)
    return winner.unionByName(other.join(winner.select(key), key, "left_anti"))


def library_order(family: Column) -> list[Column]:
    return [
        (F.col("severity_tier") != "hard_gate").asc(),
        (~F.array_contains(F.col("applicable_families"), family)).asc(),
        F.col("direction_evidence").desc(),
        F.col("criterion_id").asc(),
    ]


def matches_family(family: Column, strict: bool = False) -> Column:
    fams = F.col("applicable_families")
    named = F.array_contains(fams, family)
    return named if strict else named | (F.size(fams) == 0) | F.array_contains(fams, "generic")


def filter_by_family(library: DataFrame, families: Sequence[str], limit: int, strict: bool = False,
                     focus: Sequence[str] = ()) -> DataFrame:
    """Top criteria per family; with focus kinds, families without any fall back to all."""
    wanted = library.withColumn("family", F.explode(F.array(*[F.lit(f) for f in families]))).where(
        matches_family(F.col("family"), strict)
    )
    kinds = [k.strip().lower() for k in focus if k.strip()]
    order = library_order(F.col("family"))
    if not kinds:
        return top_k(wanted, ["family"], order, limit)
    hit = F.lower("focus_kind").isin(*kinds)
    # focused rows first: the fallback applies only where the first row has no focus
    ranked = top_k(wanted.withColumn("_hit", hit), ["family"], [F.col("_hit").desc(), *order], limit)
    some = ranked.groupBy("family").agg(F.max("_hit").alias("_some"))
    return ranked.join(some, "family").where(F.col("_hit") | ~F.col("_some")).drop("_hit", "_some")


def summarize_library(library: DataFrame) -> DataFrame:
    """Counts by family (exploded), dimension and severity in one pass."""
    fams = F.when(F.size("applicable_families") == 0, F.array(F.lit("generic"))).otherwise(F.col("applicable_families"))
    facets = F.concat(
        F.transform(fams, lambda f: F.struct(F.lit("family").alias("facet"), f.alias("value"))),
        F.array(
            F.struct(F.lit("dimension").alias("facet"), F.col("dimension").alias("value")),
            F.struct(F.lit("severity").alias("facet"), F.col("severity_tier").alias("value")),
        ),
    )
    return library.select(F.inline(facets)).groupBy("facet", "value").agg(F.count(F.lit(1)).alias("criteria"))


def budgeted(criteria: DataFrame, per_dimension: int = 6, per_family: int = 14, total: int = 60) -> DataFrame:
    """Greedy budget in (hard gate, evidence, dimension, id) order, in rounds.

    Counts only grow, so within one (dimension, family set) the accepted rows
    are a prefix of at most ``per_dimension`` rows, and a distributed top-k drops
    the rest.  A round knows two counts before each open row: the accepted ones,
    which reject it where they fill a cap, and those with the open ones, which
    accept it where even they don't.  The first open row is always decided.
    """
    order = [
        (F.col("severity_tier") != "hard_gate").asc(), F.col("direction_evidence").desc(),
        F.col("dimension").asc(), F.col("criterion_id").asc(),
    ]
    fams = F.array_join(F.array_sort("applicable_families"), ",")
    short = top_k(criteria.withColumn("_fams", fams), ["dimension", "_fams"], order, per_dimension, "_k")
    keys = ["criterion_id", "dimension", "severity_tier", "direction_evidence"]
    capped = F.array_remove(F.array_distinct("applicable_families"), "generic")
    rows = durable(short.select(*keys, capped.alias("families"), F.lit("open").alias("state")))

    def before(*group: str) -> list[Column]:
        window = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        hits = ((F.col("state") == "accepted"), (F.col("state") != "rejected"))
        return [F.coalesce(F.sum(hit.cast("long")).over(window), F.lit(0)) for hit in hits]

    while not rows.where("state = 'open'").isEmpty():
        sure, most = before("family")
        by_family = (
            rows.withColumn("family", F.explode("families")).select("criterion_id", sure.alias("sure"), most.alias("most"))
            .groupBy("criterion_id").agg(F.max("sure").alias("fam_sure"), F.max("most").alias("fam_most"))
        )
        sure, most = before("dimension")
        counted = rows.withColumn("sure", sure).withColumn("most", most).join(by_family, "criterion_id", "left")
        full = (F.col("sure") >= per_dimension) | F.coalesce(F.col("fam_sure") >= per_family, F.lit(False))
        free = (F.col("most") < per_dimension) & F.coalesce(F.col("fam_most") < per_family, F.lit(True))
        state = F.when(F.col("state") != "open", F.col("state")).when(full, "rejected").when(free, "accepted").otherwise("open")
        rows = durable(counted.select(*keys, "families", state.alias("state")))

    taken = rows.where("state = 'accepted'").orderBy(*order).limit(total)
    number = F.row_number().over(Window.orderBy(*order)) - 1  # over at most ``total`` rows
    return taken.select("criterion_id", F.concat(F.lit("cluster_"), F.lpad(number.cast("string"), 3, "0")).alias("cluster_id"))
