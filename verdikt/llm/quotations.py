"""Quotation linking: reply-ordered conversations without quotes.

A line that starts with ``>`` marks is quoted, as deep as it has marks.  Lines
of one depth that follow each other are a passage.  Its normalised text (lower
case, runs of white space as one space) is hashed and joined to the first
message that wrote the same itself, as its whole text, a paragraph or a line:
first in the same conversation before the quoting turn, else the first of all
other conversations.  So are the passage's own paragraphs and lines that make up
``LEAST_SHARE`` percent of it or more, and the longest part with an original
links the passage.  The parent of a message is the latest turn of its conversation
that it quotes at depth one.  A reply follows its parent and the parent's
earlier replies: ``reply_path`` holds the turns from the thread's first message
down to the message, and conversations are ordered by it.

Only hashes, ids and turns are shuffled to find links, and originals are reduced
to one row for each hash (and conversation) before the join, so a line that a
third of all messages share is one row.  No Python runs on the executors.

Defined results: a null text has no lines and stays null; a message of quotes
alone gets an empty text; empty passages link to nothing; repeated rows are
returned each, with the same links; a null conv_id or turn neither quotes nor
is quoted; of equal originals the smallest (conv_id, turn) counts, of equally
long parts one of the same conversation, then the first in the passage.  An
empty table gives no rows, other columns are never read, and the messages of a
conversation of any length are spread over tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdikt.llm.common import pin

MARKS = r"^((?:[ \t]*>)+)"
QUOTING = r"(?:^|\n)[ \t]*>"
LEAST_SHARE = 50


def depth(line: Column) -> Column:
    return F.length(F.regexp_replace(F.regexp_extract(line, MARKS, 1), "[^>]", ""))


def normal(text: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(text, r"[ \t\r\n]+", " ")))


def own_text(text: Column) -> Column:
    """The text without its quoted lines; one without quotes is left as it is."""
    lines = F.filter(F.split(text, "\n"), lambda line: ~line.rlike(MARKS))
    return F.when(text.rlike(QUOTING), F.regexp_replace(F.array_join(lines, "\n"), r"^[ \t\r\n]+|[ \t\r\n]+$", "")).otherwise(text)


def units(text: Column) -> Column:
    """(size, hash) of the normalised whole text, its paragraphs and its lines, without the empty ones."""
    cut = F.concat(F.array(text), F.split(text, r"\n[ \t\r]*\n"), F.split(text, "\n"))
    kept = F.array_distinct(F.filter(F.transform(cut, normal), lambda u: u != ""))
    return F.transform(kept, lambda u: F.struct(F.length(u).alias("size"), F.md5(u.cast("binary")).alias("hash")))


def passages(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, said, depth, at, hash, parts): every quoted passage and its units, the whole first.

    ``said`` identifies the message's text.
    """
    quoting = messages.where(
        F.col("text").rlike(QUOTING) & F.col("conv_id").isNotNull() & F.col("turn").isNotNull()
    ).select("conv_id", "turn", F.md5(F.col("text").cast("binary")).alias("said"), "text").distinct()
    key = ["conv_id", "turn", "said"]
    lines = quoting.select(*key, F.posexplode(F.split("text", "\n")).alias("at", "line")).select(
        *key, "at", depth(F.col("line")).alias("depth"), F.regexp_replace("line", MARKS, "").alias("body")
    )
    run = F.col("at") - F.row_number().over(Window.partitionBy(*key, "depth").orderBy("at"))
    return (
        lines.where("depth > 0")
        .withColumn("run", run)
        .groupBy(*key, "depth", "run")
        .agg(F.min("at").alias("at"), F.array_sort(F.collect_list(F.struct("at", "body"))).alias("lines"))
        .select(*key, "depth", "at", F.array_join(F.transform("lines", lambda x: x["body"]), "\n").alias("quoted"))
        .where(normal(F.col("quoted")) != "")
        .select(*key, "depth", "at", F.md5(normal(F.col("quoted")).cast("binary")).alias("hash"),
                F.length(normal(F.col("quoted"))).alias("whole"), units(F.col("quoted")).alias("parts"))
    )


def originals(messages: DataFrame) -> DataFrame:
    """(hash, conv_id, turn): the first turn of each conversation that wrote each unit itself."""
    return (
        messages.where("conv_id is not null and turn is not null")
        .select("conv_id", "turn", F.explode(units(own_text(F.col("text")))["hash"]).alias("hash"))
        .groupBy("hash", "conv_id")
        .agg(F.min("turn").alias("turn"))
    )


def links(messages: DataFrame) -> DataFrame:
    """Passages plus (to_conv, to_turn) of the original, null where there is none."""
    quoted = pin(passages(messages), "quoted-passages")
    key = ["conv_id", "turn", "said", "depth", "at"]
    large = F.filter("parts", lambda p: 100 * p["size"] >= LEAST_SHARE * F.col("whole"))
    parts = quoted.select(*key, F.posexplode(large).alias("place", "part")).select(*key, "place", "part.size", "part.hash")
    wanted = originals(messages).join(parts.select("hash").distinct(), "hash", "left_semi")
    first = pin(wanted, "quoted-originals")
    near = first.select("hash", "conv_id", F.col("turn").alias("near_turn"))
    # the first of two conversations at least is not the quoting one
    order = Window.partitionBy("hash").orderBy("conv_id")
    ranked = first.withColumn("nth", F.row_number().over(order)).where("nth <= 2")
    far = ranked.groupBy("hash").agg(
        *[F.min(F.when(F.col("nth") == n, F.struct("conv_id", "turn"))).alias(name) for n, name in ((1, "far"), (2, "farther"))]
    )
    joined = parts.join(near, ["hash", "conv_id"], "left").join(far, "hash", "left")
    is_near = F.coalesce(F.col("near_turn") < F.col("turn"), F.lit(False))
    other = F.when(F.col("far.conv_id") != F.col("conv_id"), F.col("far")).otherwise(F.col("farther"))
    target = F.when(is_near, F.struct("conv_id", F.col("near_turn").alias("turn"))).otherwise(other)
    best = (
        joined.select(*key, F.struct(-F.col("size"), ~is_near, "place").alias("rank"), target.alias("target"))
        .where("target is not null")
        .groupBy(*key)
        .agg(F.min_by("target", "rank").alias("target"))
    )
    return quoted.join(best, key, "left").select(
        *key, "hash", F.col("target.conv_id").alias("to_conv"), F.col("target.turn").alias("to_turn")
    )


def reply_paths(parents: DataFrame) -> DataFrame:
    """(conv_id, turn, path) of messages with a parent (conv_id, turn, parent), by pointer doubling.

    A parent's turn is always smaller, so paths end; each round doubles their
    reach, and rounds stop when no path has an open end.  A turn with several
    texts counts with its latest parent.
    """
    state = parents.groupBy("conv_id", "turn").agg(F.max("parent").alias("top")).withColumn("path", F.array("turn"))
    state = pin(state, "reply-paths")
    while not state.where("top is not null").isEmpty():
        above = state.select("conv_id", F.col("turn").alias("top"), F.col("top").alias("next"), F.col("path").alias("upper"))
        joined = state.join(above, ["conv_id", "top"], "left")
        state = pin(
            joined.select(
                "conv_id", "turn", F.col("next").alias("top"),
                F.when(F.col("top").isNull(), F.col("path"))
                .otherwise(F.concat(F.coalesce("upper", F.array("top")), "path")).alias("path"),
            ),
            "reply-paths",
        )
    return state.select("conv_id", "turn", "path")


def reply_ordered(messages: DataFrame) -> DataFrame:
    """Every message: conv_id, turn, role, own text, quote counts, parent_turn, reply_path (array).

    The result is sorted by conversation and path over ranges, so one very long
    conversation is spread over tasks.
    """
    linked = pin(links(messages), "quotation-links")
    counts = linked.groupBy("conv_id", "turn", "said").agg(
        F.count(F.lit(1)).alias("n_quotes"),
        F.count("to_turn").alias("n_linked"),
        F.max("depth").alias("max_depth"),
        F.max(F.when((F.col("depth") == 1) & (F.col("to_conv") == F.col("conv_id")), F.col("to_turn"))).alias("parent_turn"),
    )
    paths = reply_paths(counts.where("parent_turn is not null").select("conv_id", "turn", F.col("parent_turn").alias("parent")))
    found = counts.join(paths, ["conv_id", "turn"], "left")
    said = F.md5(F.col("text").cast("binary"))
    return (
        messages.select("conv_id", "turn", "role", own_text(F.col("text")).alias("text"), said.alias("said"))
        .join(found, ["conv_id", "turn", "said"], "left")
        .select(
            "conv_id", "turn", "role", "text",
            *[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("n_quotes", "n_linked", "max_depth")],
            "parent_turn", F.coalesce("path", F.array("turn")).alias("reply_path"),
        )
        .orderBy("conv_id", "reply_path", "turn")
    )
