"""Refinement of an example's rubrics in rounds, offline rules only.

An example is one row; its rubrics are an array, and every step is a fold over
that array inside the row, so a round is a map without a shuffle.  Whether a
candidate satisfies a rubric depends only on the rubric's rule, so candidates are
read once for each of the six rules, and a rubric carries just its rule.

Round d visits the active rubrics of depth d in order and replaces a broad one
by its two children when those pass the acceptance gates and split it well.
Once an example has more rejections than ``most_rejected``, the rubrics not yet
visited stay as they are and are counted as unfinished.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdikt.functions import rubrics as X
from verdikt.functions import text as T
from verdikt.operators.banks import MAX_EXTRA, MAX_PAIR_OVERLAP, MIN_GAIN, MIN_RECALL
from verdikt.operators.scoring import discrimination

# Default initial rubrics.
INITIAL_RUBRICS = (
    "The note states the chief complaint or visit reason supported by the transcript.",
    "The note captures the clinically important symptoms and relevant negatives discussed in the transcript.",
    "The note records medications and dose or frequency details only when they are supported by the transcript.",
    "The note separates patient-reported history from clinician exam findings or observed results.",
    "The note includes the clinician assessment or main diagnoses only when they are supported by the transcript.",
    "The note includes follow-up, orders, referrals, or counseling that were explicitly discussed.",
    "The note avoids unsupported facts, diagnoses, medications, and test results.",
    "The note uses a clear clinical structure with sectioned or problem-oriented organization.",
)
# Two narrower rubrics by keyword, in order; the last entry is the default.
CHILDREN = (
    (("symptoms", "negatives"), (
        "The note captures the main presenting symptoms or complaints that were discussed.",
        "The note preserves clinically relevant negatives or denials that matter for the assessment.")),
    (("medications", "dose"), (
        "The note names the medications that were discussed in the transcript.",
        "The note preserves dose, frequency, or route details when they were stated in the transcript.")),
    (("assessment", "diagnoses"), (
        "The note includes the clinician assessment or diagnoses that were explicitly discussed.",
        "The note links the assessment or diagnoses to supporting findings from the transcript.")),
    (("follow-up", "orders", "referrals", "counseling"), (
        "The note records follow-up actions, referrals, or ordered next steps that were discussed.",
        "The note preserves counseling or adherence guidance that was explicitly discussed.")),
    (("unsupported", "avoid"), (
        "The note does not introduce unsupported diagnoses, medications, or procedures.",
        "The note does not introduce unsupported results, follow-up instructions, or safety claims.")),
    (("structure", "organization"), (
        "The note uses clear section headers or problem-oriented organization.",
        "The note places findings and plans in appropriate clinical sections.")),
    ((), (
        "The note captures the key patient history that matters for this encounter.",
        "The note captures the clinician assessment or plan that matters for this encounter.")),
)
# One wording for each rule of functions.rubrics.heuristic_satisfaction, and what selects it.
RULES = (
    ("chief complaint", ("chief complaint", "visit reason")),
    ("medication", ("medication",)),
    ("follow-up", ("follow-up", "referral", "next step")),
    ("unsupported", ("unsupported",)),
    ("structure", ("structure", "section")),
    ("", ()),
)
STRONG, WEAK = ("gold_like", "strong_anchor"), ("synthetically_degraded",)
REASONS = ("overlap", "conflict", "misaligned", "no_gain")


def rule_of(rubric: Column) -> Column:
    """Position of the rubric's rule in RULES."""
    choice = F.lit(len(RULES) - 1)
    for i, (_, words) in reversed(list(enumerate(RULES[:-1]))):
        choice = F.when(T.has_any(rubric, words), F.lit(i)).otherwise(choice)
    return choice


def kind_of(rubric: Column) -> Column:
    """Position of the rubric's children in CHILDREN."""
    choice = F.lit(len(CHILDREN) - 1)
    for i, (words, _) in reversed(list(enumerate(CHILDREN[:-1]))):
        choice = F.when(T.has_any(rubric, words), F.lit(i)).otherwise(choice)
    return choice


def described(rubric: Column, depth: int) -> Column:
    """A lower-case rubric text with what the gates look at."""
    return F.struct(
        rubric.alias("text"), F.lit(depth).alias("depth"), rule_of(rubric).alias("rule"),
        X.word_set(rubric).alias("words"), X.content_tokens(rubric).alias("tokens"), X.polarity(rubric).alias("side"),
        kind_of(rubric).alias("kind"),
    )


def spread(hits: Column) -> Column:
    return discrimination(T.ratio(held(hits), F.size(hits)))


def held(hits: Column) -> Column:
    return F.size(F.filter(hits, lambda h: h))


def both(a: Column, b: Column, join) -> Column:
    return F.zip_with(a, b, join)


def rule_facts(texts: Column, buckets: Column) -> Column:
    """For each rule: which candidates satisfy it, and whether weak ones do so more often than strong ones."""
    pool = F.zip_with(texts, buckets, lambda t, b: F.struct(F.lower(t).alias("t"), b.alias("b")))

    def judged(c: Column) -> Column:
        hits = [F.coalesce(X.satisfied(c["t"], c["b"], F.lit(wording)), F.lit(False)) for wording, _ in RULES]
        return F.struct(F.array(*hits).alias("hits"), c["b"].alias("b"))

    def facts(cells: Column, rule: int) -> Column:
        def hit(c: Column) -> Column:
            return F.get(c["hits"], F.lit(rule))

        def share(side: tuple[str, ...]) -> Column:
            mine = F.filter(cells, lambda c: c["b"].isin(*side))
            return F.when(F.size(mine) > 0, F.size(F.filter(mine, hit)) / F.size(mine))

        worse = F.coalesce(share(WEAK) > share(STRONG) + 0.05, F.lit(False))
        return F.struct(F.transform(cells, hit).alias("hits"), worse.alias("misaligned"))

    # each text is put in lower case once and read once for all rules
    return T.let(F.transform(pool, judged), lambda cells: F.array(*[facts(cells, i) for i in range(len(RULES))]))


def near_in_size(a: Column, b: Column) -> Column:
    """Sets of very different size cannot reach the overlap of 0.7: a cheap test before the costly one."""
    return (F.size(a) * 10 >= F.size(b) * 7) & (F.size(b) * 10 >= F.size(a) * 7)


def turned_away(active: Column, rubric: Column, facts: Column) -> Column:
    """The first gate that a rubric fails against the active ones; null if none."""
    return (
        F.when(rubric["text"] == "", "empty")
        .when(F.exists(active, lambda o: o["text"] == rubric["text"]), "duplicate")
        .when(F.exists(active, lambda o: near_in_size(rubric["words"], o["words"]) & X.overlaps(rubric["words"], o["words"])), "overlap")
        .when(F.exists(active, lambda o: X.conflicts(rubric["side"], rubric["tokens"], o["side"], o["tokens"])), "conflict")
        .when(F.get(facts, rubric["rule"])["misaligned"], "misaligned")
    )


def splits_well(parent: Column, left: Column, right: Column) -> Column:
    """Whether two children's hits may stand for their parent's: the gate of operators.banks on one array."""
    either = both(left, right, lambda a, b: a | b)
    kept = held(both(parent, either, lambda p, e: p & e))
    extra = held(both(parent, either, lambda p, e: e & ~p))
    shared = held(both(left, right, lambda a, b: a & b))
    narrower = [(held(c) > 0) & (held(c) < held(parent)) & (held(c) < F.size(parent)) for c in (left, right)]
    return (
        narrower[0] & narrower[1]
        & (T.ratio(kept, held(parent)) >= MIN_RECALL)
        & (T.ratio(extra, held(either)) <= MAX_EXTRA)
        & (T.ratio(shared, held(either), 1.0) <= MAX_PAIR_OVERLAP)
        & (F.greatest(spread(left), spread(right)) - spread(parent) >= MIN_GAIN)
    )


def children() -> Column:
    """All pairs of children, described; a constant."""
    texts = F.array(*[F.array(*[F.lit(text.lower()) for text in pair]) for _, pair in CHILDREN])
    return F.transform(texts, lambda pair: F.transform(pair, lambda text: described(text, 0)))


def first_round(starts: Column, facts: Column) -> Column:
    """Accept the starting rubrics one after the other: struct (active, rejected reasons)."""
    empty = F.filter(starts, lambda _: F.lit(False))
    state = F.struct(empty.alias("active"), F.array().cast("array<string>").alias("rejected"))

    def step(s: Column, rubric: Column) -> Column:
        return T.let(turned_away(s["active"], rubric, facts), lambda why: F.struct(
            F.when(why.isNull(), F.concat(s["active"], F.array(rubric))).otherwise(s["active"]).alias("active"),
            F.when(why.isNull(), s["rejected"]).otherwise(F.concat(s["rejected"], F.array(why))).alias("rejected")))

    return F.aggregate(starts, state, step)


def next_round(state: Column, facts: Column, kids: Column, gate: Column, depth: int, limits: dict[str, int]) -> Column:
    """Visit the active rubrics of ``depth``; the state gains or replaces rubrics of depth + 1."""

    def hits(rubric: Column) -> Column:
        return F.get(facts, rubric["rule"])["hits"]

    def state_of(s: Column, **new: Column) -> Column:
        return F.struct(*[new.get(f, s[f]).alias(f) for f in ("active", "rejected", "replaced", "unfinished")])

    def offered(s: Column, rubric: Column) -> Column:
        pair = F.transform(F.get(kids, rubric["kind"]), lambda kid: kid.withField("depth", F.lit(depth + 1)))
        return T.let(pair, lambda bound: with_pair(s, rubric, bound))

    def with_pair(s: Column, rubric: Column, pair: Column) -> Column:
        one, two = F.get(pair, F.lit(0)), F.get(pair, F.lit(1))

        def with_rest(rest: Column) -> Column:
            def with_one(no_one: Column) -> Column:
                beside = F.when(no_one.isNull(), F.concat(rest, F.array(one))).otherwise(rest)
                return T.let(beside, lambda b: T.let(turned_away(b, two, facts), lambda no_two: with_both(no_one, no_two)))

            def with_both(no_one: Column, no_two: Column) -> Column:
                good = no_one.isNull() & no_two.isNull() & splits_well(hits(rubric), hits(one), hits(two))
                why = [F.coalesce(no, F.lit("no_gain")) for no in (no_one, no_two)]
                return T.let(good, lambda split: state_of(
                    s, active=F.when(split, F.concat(rest, pair)).otherwise(s["active"]),
                    rejected=F.when(split, s["rejected"]).otherwise(F.concat(s["rejected"], F.array(*why))),
                    replaced=s["replaced"] + split.cast("int")))

            return T.let(turned_away(rest, one, facts), with_one)

        return T.let(F.filter(s["active"], lambda o: o["text"] != rubric["text"]), with_rest)

    def step(s: Column, rubric: Column) -> Column:
        stopped = F.size(s["rejected"]) > limits["most_rejected"]
        broad = (held(hits(rubric)) >= gate) & (F.size(s["active"]) < limits["most_rubrics"])
        waits = state_of(s, unfinished=F.concat(s["unfinished"], F.array(rubric["text"])))
        return F.when(stopped, waits).when(broad, offered(s, rubric)).otherwise(s)

    return F.aggregate(F.filter(state["active"], lambda r: r["depth"] == depth), state, step)


def refined(examples: DataFrame, key: str, threshold: int = 4, most_depth: int = 3, most_rubrics: int = 24,
            most_rejected: int = 15) -> DataFrame:
    """``examples``: key, texts, buckets, seeds (arrays); one row out per example.

    The four limits are those of the rounds: the gate's ceiling, the number of
    rounds, the active rubrics beyond which none is split, and the rejections
    after which an example is left unfinished (``status`` stopped).
    """
    limits = {"most_rubrics": most_rubrics, "most_rejected": most_rejected}
    seeds = F.filter(F.transform("seeds", lambda t: F.lower(T.squeeze(F.coalesce(t, F.lit(""))))), lambda t: t != "")
    starts = F.array_distinct(F.concat(seeds, F.array(*[F.lit(t.lower()) for t in INITIAL_RUBRICS])))
    n = F.size("texts")
    rows = examples.select(
        key, rule_facts(F.col("texts"), F.col("buckets")).alias("facts"),
        F.transform(starts, lambda t: described(t, 0)).alias("starts"),
        F.least(F.greatest(F.lit(2), F.floor((n + 1) / 2)), F.greatest(F.lit(1), F.lit(threshold))).alias("gate"),
    )
    rows = rows.select(key, "facts", "gate", first_round(F.col("starts"), F.col("facts")).alias("state"))
    rows = rows.select(key, "facts", "gate", children().alias("kids"), F.struct(
        "state.active", "state.rejected", F.lit(0).alias("replaced"), F.array().cast("array<string>").alias("unfinished")).alias("state"))
    for depth in range(most_depth):
        round_ = next_round(F.col("state"), F.col("facts"), F.col("kids"), F.col("gate"), depth, limits)
        rows = rows.select(key, "facts", "gate", "kids", round_.alias("state"))

    def rejections(reason: Column) -> Column:
        return F.size(F.filter("state.rejected", lambda w: w == reason)).cast("long")

    done = F.array_except(F.transform("state.active", lambda r: r["text"]), F.col("state.unfinished"))
    return rows.select(
        key, F.size(done).cast("long").alias("final_count"), F.size("state.rejected").cast("long").alias("rejected_count"),
        F.col("state.replaced").cast("long").alias("superseded_count"),
        F.size("state.unfinished").cast("long").alias("unfinished_count"),
        *[rejections(F.lit(reason)).alias(reason) for reason in REASONS],
        F.when(F.size("state.unfinished") > 0, "stopped").otherwise("complete").alias("status"),
        F.md5(F.array_join(done, "\n").cast("binary")).alias("final_digest"),
    )
