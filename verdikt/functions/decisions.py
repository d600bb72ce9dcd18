"""Pair decisions, format features and verifier scores as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdikt.functions import text as T

# Decision labels and confidence order.
FIRST, SECOND, EVEN = "A>B", "B>A", "A=B"
DIRECTIONAL = (FIRST, SECOND)
CONFIDENCE_ORDER = ("", "low", "medium", "high")

# Families with a built-in route.
FAMILIES = ("mmlu-pro", "livebench-reasoning", "livebench-math", "livecodebench")
BLIND_FAMILIES = ("mmlu-pro", "livebench-reasoning", "livebench-math")
FOCUS_FAMILIES = ("mmlu-pro", "livebench-reasoning")

# Verifiers whose high-confidence outcome overrides the rubric score.
HIGH_PRECISION_SOURCES = (
    "code_execution_verifier",
    "leetcode_test_runner",
    "mmlu_independent_answerer",
    "math_independent_solver",
)

# Phrases that ask for an answer format.
FORMAT_CUES = {
    "wants_terse": (
        r"\bin\s+one\s+sentence\b",
        r"\bin\s+a\s+sentence\b",
        r"\bone[-\s]liner\b",
        r"\b(very\s+)?(briefly|concisely|short(est)?)\b",
        r"\bshort\s+answer\b",
    ),
    "wants_list": (r"\b(list|enumerate)\b", r"\bbullet(?:ed|s|\s+points?)?\b"),
    "wants_numbered": (r"\bstep[-\s]by[-\s]step\b", r"\bnumbered\s+list\b", r"\bin\s+order\b"),
    "wants_table": (r"\btable\b", r"\btabular\b"),
    "wants_code": (
        r"\bwrite\s+(?:a\s+)?(?:python|javascript|js|typescript|sql|bash|shell)\b",
        r"\bimplement\s+(?:a\s+)?function\b",
        r"\bcode\s+(?:snippet|example)\b",
    ),
    "wants_explain": (
        r"\bexplain\s+(?:in\s+detail|thoroughly|step\b)",
        r"\belaborate\b",
        r"\bdescribe\s+in\s+detail\b",
        r"\bin\s+detail\b",
    ),
}
# Line shapes of formatted answers.
BULLET_LINE = r"^\s*([-*\x{2022}]|\d+[.)])\s+"
TABLE_LINE = r"^\s*\|.+\|\s*$"
TABLE_RULE = r"^\s*\|?\s*-{3,}.*\|.*$"


def compare(a: Column, b: Column) -> Column:
    return F.when(a > b, FIRST).when(a < b, SECOND).otherwise(EVEN)


def flip(d: Column) -> Column:
    return F.when(d == FIRST, SECOND).when(d == SECOND, FIRST).otherwise(d)


def is_directional(d: Column) -> Column:
    return F.coalesce(d.isin(*DIRECTIONAL), F.lit(False))


def confidence_rank(c: Column) -> Column:
    return F.when(c == "high", 3).when(c == "medium", 2).when(c == "low", 1).otherwise(0)


def predict(score_a: Column, score_b: Column) -> Column:
    """a / b / tie, or '' when a score is missing."""
    return (
        F.when(score_a.isNull() | score_b.isNull(), "")
        .when(score_a > score_b, "a")
        .when(score_b > score_a, "b")
        .otherwise("tie")
    )


def source_family(source: Column) -> Column:
    """Family by prefix, else the part before the first dash, else unknown."""
    s = F.lower(T.strip(F.coalesce(source, F.lit(""))))
    out = F.when(s.startswith(FAMILIES[0]), FAMILIES[0])
    for name in FAMILIES[1:]:
        out = out.when(s.startswith(name), name)
    return (
        out.when(s.startswith("livebench"), "livebench")
        .when(F.contains(s, F.lit("-")), F.substring_index(s, "-", 1))
        .when(s == "", "unknown")
        .otherwise(s)
    )


def format_request(question: Column) -> dict[str, Column]:
    return {name: question.rlike("(?i)(" + "|".join(p) + ")") for name, p in FORMAT_CUES.items()}


def format_features(text: Column) -> Column:
    """Struct of counts; one split of the whole text feeds the line features."""
    def line_counts(rows: Column) -> Column:
        table_rows = F.size(F.filter(rows, lambda x: x.rlike(TABLE_LINE)))
        return F.struct(
            F.size(F.filter(rows, lambda x: x.rlike(BULLET_LINE))).cast("bigint").alias("bullet_count"),
            table_rows.cast("bigint").alias("table_rows"),
            ((table_rows >= 2) & F.exists(rows, lambda x: x.rlike(TABLE_RULE))).alias("has_table"),
        )

    return T.let(
        T.let(F.split(text, "\n"), line_counts),
        lambda v: F.struct(
            F.length(text).cast("bigint").alias("char_count"),
            T.word_count(text).cast("bigint").alias("word_count"),
            v["bullet_count"].alias("bullet_count"),
            v["table_rows"].alias("table_rows"),
            v["has_table"].alias("has_table"),
            F.floor(T.count_of(text, "```") / 2).cast("bigint").alias("code_blocks"),
        ),
    )


def format_votes(cues: dict[str, Column], a: Column, b: Column,
                 terse: float = 0.7, explain: float = 1.5) -> tuple[Column, Column]:
    """Votes for A and for B given cue flags and two feature structs."""
    wa, wb = a["word_count"].cast("double"), b["word_count"].cast("double")
    spoken = (wa > 0) & (wb > 0)
    a_over_b, b_over_a = wa / F.greatest(F.lit(1.0), wb), wb / F.greatest(F.lit(1.0), wa)
    lists = cues["wants_list"] | cues["wants_numbered"]
    duels = [
        (cues["wants_terse"] & spoken, a_over_b < terse, b_over_a < terse),
        (lists, (a["bullet_count"] >= 2) & (b["bullet_count"] < 2),
         (b["bullet_count"] >= 2) & (a["bullet_count"] < 2)),
        (cues["wants_table"], a["has_table"] & ~b["has_table"], b["has_table"] & ~a["has_table"]),
        (cues["wants_code"], (a["code_blocks"] > 0) & (b["code_blocks"] == 0),
         (b["code_blocks"] > 0) & (a["code_blocks"] == 0)),
        (cues["wants_explain"] & spoken, a_over_b > explain, b_over_a > explain),
    ]
    for_a = sum(((asked & won).cast("bigint") for asked, won, _ in duels), F.lit(0).cast("bigint"))
    for_b = sum(((asked & ~won & lost).cast("bigint") for asked, won, lost in duels),
                F.lit(0).cast("bigint"))
    return for_a, for_b


def format_verdict(votes_a: Column, votes_b: Column) -> Column:
    return F.when(votes_a > votes_b, "a").when(votes_b > votes_a, "b").otherwise("tie")


def verifier_score(family: Column, s: Column, exact_task: Column) -> Column:
    """Additive answer-signal score of one side."""
    # The points below.
    def points(flag: Column, value: float) -> Column:
        return F.when(flag, value).otherwise(0.0)

    mmlu, reasoning, math = (family == f for f in BLIND_FAMILIES)
    letter, value = s["choice_letter"], s["choice_value"]
    return (
        points(s["exact_match"], 5.0)
        + points(s["consistent"], 2.0)
        + points(s["format_ok"], 1.25)
        + points(s["explicit"], 1.0)
        + points(letter, 0.5)
        + points(value, 0.35)
        + points(s["conflicting"], -2.75)
        + points(s["marker_count"] > 1, -0.5)
        + points(mmlu & s["exact_match"], 1.5)
        + points(mmlu & letter & value, 0.65)
        + points(mmlu & s["option_map"] & ~s["explicit"], -0.5)
        + points(reasoning & s["consistent"], 0.75)
        + points(reasoning & s["explicit"], 0.5)
        + points(reasoning & ~s["explicit"] & ~s["extracted"], -0.5)
        + points(math & s["format_ok"], 0.5)
        + points(math & s["extracted"], 0.35)
        + points(~exact_task & ~s["consistent"], -0.25)
    )


def verifier_threshold(family: Column) -> Column:
    return (
        F.when(family == "mmlu-pro", 1.0)
        .when(family.isin("livebench-reasoning", "livebench-math"), 1.25)
        .otherwise(1.5)
    )


def verifier_confidence(family: Column, a: Column, b: Column, margin: Column) -> Column:
    return (
        F.when(a["exact_match"] != b["exact_match"], "high")
        .when((a["consistent"] != b["consistent"]) & (margin >= 1.5), "high")
        .when(margin >= 3.0, "high")
        .when(margin >= 1.75, "medium")
        .when((family == "mmlu-pro") & (margin >= 1.0), "medium")
        .otherwise("low")
    )


def verifier_outcome(df: DataFrame, family: str, sig_a: str, sig_b: str, exact_task: str,
                     out: str = "verifier") -> DataFrame:
    """Add struct(decision, confidence, margin, reason, triggered).

    The side scores and the margin are columns of their own so that the later
    CASE layers read them instead of repeating the sums.
    """
    fam, a, b = F.col(family), F.col(sig_a), F.col(sig_b)
    df = df.withColumns({"_va": verifier_score(fam, a, F.col(exact_task)),
                         "_vb": verifier_score(fam, b, F.col(exact_task))})
    df = df.withColumn("_vm", F.round(F.abs(F.col("_va") - F.col("_vb")), 6))
    passed = F.col("_vm") >= verifier_threshold(fam)
    confidence = F.when(passed, verifier_confidence(fam, a, b, F.col("_vm"))).otherwise(
        F.when(F.col("_vm") > 0, "low").otherwise("")
    )
    df = df.withColumns({"_vp": passed, "_vc": confidence})
    trusted = F.col("_vp") & F.col("_vc").isin("medium", "high")
    side = F.when(F.col("_va") > F.col("_vb"), "a_").otherwise("b_")
    cause = (
        F.when(a["exact_match"] != b["exact_match"], "exact_answer_match")
        .when(a["consistent"] != b["consistent"], "answer_consistency")
        .when(a["conflicting"] != b["conflicting"], "marker_conflict")
        .when(a["format_ok"] != b["format_ok"], "answer_format")
        .when(fam == "livebench-reasoning", "reasoning_state_tracking")
        .when(fam == "mmlu-pro", "choice_alignment")
        .otherwise("verifier_margin")
    )
    outcome = F.struct(
        F.when(trusted, compare(F.col("_va"), F.col("_vb"))).otherwise("").alias("decision"),
        F.col("_vc").alias("confidence"),
        F.col("_vm").alias("margin"),
        F.when(F.col("_vp"), F.concat(side, cause)).otherwise("insufficient_verifier_margin").alias("reason"),
        trusted.alias("triggered"),
    )
    return df.withColumn(out, outcome).drop("_va", "_vb", "_vm", "_vp", "_vc")


def single_match(solver: Column, a: Column, b: Column, solver_error: Column | None = None) -> Column:
    """Independent-solver outcome: a decision only when exactly one side agrees."""
    unusable = (F.coalesce(solver, F.lit("")) == "")
    if solver_error is not None:
        unusable = unusable | (F.coalesce(solver_error, F.lit("")) != "")
    hit_a = (F.coalesce(a, F.lit("")) != "") & (a == solver)
    hit_b = (F.coalesce(b, F.lit("")) != "") & (b == solver)
    one = ~unusable & (hit_a != hit_b)
    return F.struct(
        F.when(one & hit_a, FIRST).when(one, SECOND).otherwise("").alias("decision"),
        F.when(one, "high").when(~unusable & hit_a, "medium").otherwise("low").alias("confidence"),
        one.alias("triggered"),
    )


def pass_rate_outcome(rate_a: Column, rate_b: Column, min_margin: float = 0.34,
                      high_margin: float = 0.5) -> Column:
    """Test-pass-rate decision: margin of at least a third, high from one half."""
    margin = F.abs(rate_a - rate_b)
    fired = margin >= min_margin
    return F.struct(
        F.when(fired, compare(rate_a, rate_b)).otherwise("").alias("decision"),
        F.when(margin >= high_margin, "high").when(fired, "medium").otherwise("low").alias("confidence"),
        fired.alias("triggered"),
    )


def votes_correct(label: Column, original: Column, reversed_: Column) -> Column:
    """Double-order check: +1 per agreeing order, -1 per opposite one, right iff > 0."""
    opposite = flip(label)
    score = F.lit(0)
    for d in (original, flip(reversed_)):
        score = score + F.when(d == label, 1).when(d == opposite, -1).otherwise(0)
    return score > 0


def rubric_count_bucket(n: Column) -> Column:
    return (
        F.when(n <= 5, "0_5").when(n <= 10, "6_10").when(n <= 15, "11_15").otherwise("16_plus")
    )


def verdict_label(verdict: Column, original: Column, tie_policy: str = "original") -> Column:
    """New pair label from a judge verdict; no information keeps the original."""
    tie = {"a": F.lit("reference_answer_a"), "b": F.lit("reference_answer_b")}.get(tie_policy, original)
    return (
        F.when(verdict == "A", "reference_answer_a")
        .when(verdict == "B", "reference_answer_b")
        .when(verdict == "TIE", tie)
        .otherwise(original)
    )


def keyword_judge(prompt: Column, response_a: Column, response_b: Column) -> Column:
    """Fallback judge: which response contains more of the prompt's words."""
    terms = F.filter(
        F.transform(T.words(prompt), lambda w: F.lower(F.btrim(w, F.lit(".,;:")))), lambda w: w != ""
    )

    def hits(terms_: Column, response: Column) -> Column:
        return T.let(F.lower(response), lambda low: F.size(F.filter(terms_, lambda t: F.contains(low, t))))

    votes = T.let(terms, lambda t: F.struct(hits(t, response_a).alias("a"), hits(t, response_b).alias("b")))
    return T.let(votes, lambda v: compare(v["a"], v["b"]))
