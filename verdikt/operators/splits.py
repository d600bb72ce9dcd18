"""Splits, shards, folds, leakage checks and capped selections."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdikt.operators.running import ranked, top_k


def balanced_folds(pairs: DataFrame, fold_count: int, seed: int | None = None,
                   max_rows: int | None = None) -> DataFrame:
    """Round-robin folds inside each family; never more folds than the rarest family has pairs.

    With a seed the order inside a family is a hash order, reproducible anywhere.
    """
    sizes = pairs.groupBy("source_family").count().agg(F.min("count"), F.max("count")).first()
    smallest, largest = sizes[0] or 1, sizes[1] or 0
    folds = max(1, min(fold_count, smallest))
    order = [F.col("pair_id").asc()]
    if seed is not None:
        order = [F.md5(F.concat(F.lit(f"{seed}|"), F.col("pair_id").cast("string"))).asc(), *order]
    numbered = ranked(pairs, ["source_family"], order, "_pos", max_rows, at_most=largest)
    return numbered.withColumn("fold_index", (F.col("_pos") - 1) % folds).drop("_pos")


def split_and_shard(rows: DataFrame, ordinal: str, split: str | None = None, train_size: int = 0,
                    val_size: int = 0, num_shards: int = 1, shard_index: int = 0) -> DataFrame:
    """Contiguous slice of the rows in ``ordinal`` order (0-based, dense).

    Uneven shards are an error, as is an index out of range.
    """
    if num_shards < 1 or not 0 <= shard_index < num_shards:
        raise ValueError(f"shard_index must be in [0, {num_shards}); got {shard_index}")
    if split not in (None, "all", "train", "val"):
        raise ValueError(f"unknown split {split!r}")
    if train_size < 0 or val_size < 0:
        raise ValueError("train_size and val_size must be non-negative")
    pos = F.col(ordinal)
    if split == "val":
        return rows.where((pos >= train_size) & (pos < train_size + val_size))
    part = rows if split in (None, "all") else rows.where(pos < train_size)
    if num_shards == 1:
        return part
    total = part.count()
    if total % num_shards:
        raise ValueError(f"{total} rows cannot be divided evenly into {num_shards} shards")
    size = total // num_shards
    return part.where((pos >= shard_index * size) & (pos < (shard_index + 1) * size))


def shard_of(ordinal: Column, total: int, num_shards: int) -> Column:
    """The contiguous equal shard of a 0-based position below ``total``; uneven shards are an error."""
    if num_shards < 1 or total % num_shards:
        raise ValueError(f"{total} rows cannot be divided evenly into {num_shards} shards")
    return F.floor(ordinal / max(1, total // num_shards))


def with_ordinal(rows: DataFrame, order: Sequence[Column], name: str = "ordinal",
                 max_rows: int | None = None) -> DataFrame:
    """Dense 0-based position over the whole table."""
    return ranked(rows, [], order, name, max_rows).withColumn(name, F.col(name) - 1)


def ensure_disjoint(train: DataFrame, val: DataFrame, key: str) -> None:
    """Raise with a short preview when a key occurs on both sides."""
    shared = train.select(key).join(val.select(key), key, "left_semi").distinct().orderBy(key).limit(10)
    preview = [r[0] for r in shared.collect()]
    if preview:
        raise ValueError(f"train/validation overlap on {key}: {preview}")


def join_pairs(local: DataFrame, official: DataFrame, split_name: str) -> DataFrame:
    """Local rows joined to official pairs on pair_id; the official side wins when not blank.

    Raises when local rows have no official pair (count and first ids).
    """
    o = official.select(*[F.col(c).alias(f"o_{c}") for c in official.columns])
    joined = local.join(o, F.col("pair_id") == F.col("o_pair_id"), "left")
    missing = joined.where(F.col("o_pair_id").isNull()).select("pair_id")
    first = [r[0] for r in missing.orderBy("pair_id").limit(8).collect()]
    if first:
        raise ValueError(f"{split_name}: {missing.count()} pair_ids have no official pair, first: {first}")
    blank = F.lit("")
    norm = lambda c: F.regexp_replace(F.trim(c), r"\s+", " ")
    return joined.select(
        F.lit(split_name).alias("split_name"), "pair_id",
        F.coalesce(F.nullif(F.col("o_source"), blank), F.col("source")).alias("source"),
        F.coalesce(F.nullif(F.col("o_question"), blank), F.col("question")).alias("question"),
        (norm(F.col("question")) != norm(F.col("o_question"))).alias("question_mismatch"),
        F.col("o_response_a").alias("response_a"), F.col("o_response_b").alias("response_b"),
        F.col("o_label").alias("label"),
    )


def capped_selection(items: DataFrame, key: str, order: Sequence[Column], per_key: int, total: int) -> DataFrame:
    """At most ``per_key`` items per key, then the first ``total`` in the same order."""
    return top_k(items, [key], order, per_key, "_k").drop("_k").orderBy(*order).limit(total)


def first_items(items: DataFrame, subset: str, order: Sequence[Column], per_subset: int) -> DataFrame:
    return top_k(items, [subset], order, per_subset, "position")


def expand_item(items: DataFrame, max_chosen: int | None = None, max_rejected: int | None = None) -> DataFrame:
    """chosen x rejected of one item as rows; blank completions are skipped."""
    def capped(c: str, n: int | None) -> Column:
        cut = F.col(c) if n is None else F.slice(c, 1, n)
        return F.transform(cut, lambda x, i: F.struct(i.alias("index"), F.trim(x).alias("text")))

    left = items.withColumn("_c", F.explode(F.filter(capped("chosen", max_chosen), lambda x: x["text"] != "")))
    both = left.withColumn("_r", F.explode(F.filter(capped("rejected", max_rejected), lambda x: x["text"] != "")))
    return both.select(
        *[c for c in items.columns if c not in ("chosen", "rejected")],
        F.col("_c.index").alias("chosen_index"), F.col("_r.index").alias("rejected_index"),
        F.col("_c.text").alias("response_a"), F.col("_r.text").alias("response_b"),
        F.lit("A>B").alias("label"),
    )
