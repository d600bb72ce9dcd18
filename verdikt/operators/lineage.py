"""Ancestor closure of a parent table and grounding of proposals in what separates two texts."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from verdikt.functions import rubrics as X
from verdikt.functions import text as T
from verdikt.operators.rowwise import with_python_column
from verdikt.session import durable


def lineage(parents: DataFrame, key: str = "criterion_id", parent: str = "parent_id") -> DataFrame:
    """(key, root, depth, state) of every row of (key, parent), by pointer doubling.

    The root is the last ancestor that has a row, depth the steps to it.  state is
    ``whole``, ``orphan`` where the root names a parent without a row, or ``ring``
    where the ancestors come back on themselves; a ring has no root and no depth.
    Keys are unique and not null.  Each round doubles the reach, so the rounds are
    the logarithm of the longest line; rows still open when no line of the table
    could be longer are in or behind a ring.
    """
    rows = parents.select(F.col(key).alias("k"), F.col(parent).alias("p"))
    known = rows.select(F.col("k").alias("p"), F.lit(True).alias("has"))
    state = durable(rows.join(known, "p", "left").select(
        "k", F.when(F.col("has"), F.col("p")).alias("up"), F.col("k").alias("root"), F.lit(0).cast("long").alias("depth"),
        (F.col("p").isNotNull() & F.col("has").isNull()).alias("orphan"),
    ))
    # Where a row has a known parent, its root so far is that parent.
    state = state.withColumn("root", F.coalesce("up", "k")).withColumn("depth", F.col("up").isNotNull().cast("long"))
    size, reach = state.count(), 1
    while reach < 2 * size and not state.where("up is not null").isEmpty():
        above = state.select(
            F.col("k").alias("up"), F.col("up").alias("next"), F.col("root").alias("a_root"), F.col("depth").alias("a_depth"), F.col("orphan").alias("a_orphan")
        )
        state = durable(state.join(above, "up", "left").select(
            "k", F.col("next").alias("up"), F.coalesce("a_root", "root").alias("root"),
            (F.col("depth") + F.coalesce("a_depth", F.lit(0))).alias("depth"), F.coalesce("a_orphan", "orphan").alias("orphan"),
        ))
        reach *= 2
    ring = F.col("up").isNotNull()
    return state.select(
        F.col("k").alias(key), F.when(~ring, F.col("root")).alias("root"), F.when(~ring, F.col("depth")).alias("depth"),
        F.when(ring, "ring").when(F.col("orphan"), "orphan").otherwise("whole").alias("state"),
    )


def criterion_id(root_pair: Column, depth: Column, parent: Column, index: Column, dimension: Column, label: Column, requirement: Column) -> Column:
    """Name of a proposal from its place in the recursion and its words."""
    from pyspark.sql.types import LongType, StringType, StructField, StructType

    from verdikt.functions.keys import stable_hash

    texts = {"root_pair_id": root_pair, "parent_criterion_id": F.coalesce(parent, F.lit("")), "dimension": dimension, "label": label, "requirement": requirement}
    numbers = {"recursion_depth": depth.cast("long"), "proposal_index": index.cast("long")}
    payload = F.struct(*[c.alias(n) for n, c in (texts | numbers).items()])
    kind = StructType([StructField(n, StringType()) for n in texts] + [StructField(n, LongType()) for n in numbers])
    return F.concat(root_pair, F.lit("__criterion_"), depth.cast("string"), F.lit("_"), F.substring(stable_hash(payload, kind), 1, 12))


OPENING = 32  # characters by which the places of a text are sorted


def held_terms(lists: list[list[str]] | None, text: str | None) -> list[list[str]] | None:
    """Of each list the terms that stand in the text.

    The places of the text are sorted by what opens there, so a term takes a
    binary search and not a pass over the text; a longer term is then compared
    at the places that share its opening.
    """
    if lists is None:
        return None
    if text is None:
        return [[] for _ in lists]
    if len(text) < 2000:
        return [[t for t in terms if t is not None and t in text] for terms in lists]
    openings = sorted({text[i : i + OPENING] for i in range(len(text))})
    known: dict[str, bool] = {"": True}

    def holds(term: str) -> bool:
        start = term[:OPENING]
        at = bisect_left(openings, start)
        if at == len(openings) or not openings[at].startswith(start):
            return False
        return len(term) <= OPENING or term in text

    def looked_up(term: str) -> bool:
        if term not in known:
            known[term] = holds(term)
        return known[term]

    return [[t for t in terms if t is not None and looked_up(t)] for terms in lists]


def with_delta_hits(rows: DataFrame, terms: str, delta: str, target: str) -> DataFrame:
    """``rows`` with ``target`` in place of ``terms`` (an array of lists of terms) and ``delta``: the terms of each list that stand in it."""
    return with_python_column(rows, [terms, delta], target, ArrayType(ArrayType(StringType())), held_terms)


def grounded(
    blob: Column, terms: Column, delta: Column | None, keywords: Sequence[str], allowed: Sequence[str] = (), blocked: Sequence[str] = ()
) -> Column:
    """Whether a proposal fits the edit that separates two texts, and why.

    ``blob`` is the proposal in matched form, ``terms`` its salient terms, ``delta``
    the lines on one side only, in matched form.  A proposal is kept if one of its
    terms stands in the delta or a keyword of the edit in the proposal, and, where
    the edit names phrases, if it holds an allowed one (a keyword where none are
    named) and no blocked one.  Without ``delta`` the terms are those of
    ``with_delta_hits``, which looks up all lines of a text at once.
    """
    def hits(phrases: Sequence[str]) -> Column:
        named = F.array(*map(F.lit, phrases)).cast("array<string>")
        return F.filter(named, lambda p: F.contains(blob, T.matched_text(p)))

    found = terms if delta is None else F.filter(terms, lambda t: F.contains(delta, t))
    profile = hits(keywords)
    touched = (F.size(found) > 0) | (F.size(profile) > 0)
    if not allowed and not blocked:
        keep, good, bad = touched, F.array().cast("array<string>"), F.array().cast("array<string>")
    else:
        good, bad = hits(allowed) if allowed else profile, hits(blocked)
        keep = touched & (F.size(good) > 0) & (F.size(bad) == 0)
    return F.struct(
        keep.alias("keep"), found.alias("delta_hits"), profile.alias("profile_hits"), good.alias("allowed_hits"), bad.alias("blocked_hits")
    )


def proposal_terms(dimension: Column, label: Column, requirement: Column) -> Column:
    return X.salient_terms(F.concat_ws(" ", dimension, label, requirement))
