"""Quality rules with risk-controlled cutoffs.

Every rule is a signal of the whole text (larger is worse) with a list of
cutoffs.  Labelled good documents of a stratum are the holdout: for a cutoff,
k of n of them are rejected, and the exact binomial tail P(Bin(n, a) <= k) is
the p-value of "this cutoff rejects more than a share a of good documents".
It is at most d exactly when the upper Clopper-Pearson bound at level d is at
most a.  A cutoff is used only if that is so for a = alpha / rules and
d = delta / (strata * rules); within a stratum and rule, cutoffs are tried from
the mildest on (fixed sequence, which needs no further correction).  So, with
probability 1 - delta, in every stratum together all rules reject at most a
share alpha of good documents.  Of the proven cutoffs the mildest is used that
rejects nearly as many labelled bad documents (NEARLY percent) as the strictest;
a rule that rejects none is not used.  A stratum with too few labels proves no
cutoff and rejects nothing beyond the base rule.

Defined results: a null or blank text has no words and fails the base rule; a
null stratum is ``und``; ratios over nothing are zero; repeated rows are judged
each; labels of a doc_id that occur more than once count as the worst of them;
without labels or documents only the base rule acts.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from verdikt.llm.common import pin, with_column_of

BLANKS = " \t\n\v\f\r"
SYMBOLS = "#*$%&|<>"
CAPITALS = bytes(range(ord("A"), ord("Z") + 1))
METRICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals")
MIN_WORDS = 50
NEARLY = 98


@dataclass(frozen=True)
class Rule:
    """Share ``part`` / ``whole`` of two metrics, tried at ``cutoffs`` (in thousandths, mildest first)."""

    name: str
    part: str
    whole: str
    cutoffs: tuple[int, ...]

    def above(self, thousandths: Column | int) -> Column:
        """The exact integer test part / whole > cutoff, false over nothing."""
        cut = thousandths if isinstance(thousandths, Column) else F.lit(thousandths)
        return F.col(self.part) * 1000 > F.col(self.whole) * cut


RULES = (
    Rule("symbols", "n_symbols", "word_chars", (200, 150, 100, 80, 60, 40, 30, 20)),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", (700, 500, 400, 300, 200, 150, 100)),
    Rule("repeated_words", "n_repeat_words", "n_words", (450, 400, 350, 300, 250, 200, 150)),
    Rule("capitals", "n_capitals", "word_chars", (800, 700, 600, 500, 400, 300, 200)),
)


def text_metrics(text: str) -> tuple[int, ...]:
    """The values of METRICS for one whole text."""
    data = text.encode()
    words = data.split()
    n = len(words)
    repeats = 0
    windows = list(zip(words, words[1:], words[2:], strict=False))
    if len(set(windows)) < len(windows):
        seen: dict[tuple, int] = {}
        covered = bytearray(n)
        for i, window in enumerate(windows):
            first = seen.setdefault(window, i)
            if first != i:
                covered[first : first + 3] = covered[i : i + 3] = b"\1\1\1"
        repeats = sum(covered)
    lines = [line for line in text.split("\n") if line.strip(BLANKS)]
    return (
        n,
        len(text) - sum(map(text.count, BLANKS)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeats,
        len(lines),
        len(data) - len(data.translate(None, CAPITALS)),
    )


def with_metrics(docs: DataFrame, text: str = "text", name: str = "metrics") -> DataFrame:
    """``docs`` plus a struct column of the METRICS."""

    def measured(texts: list) -> pa.Array:
        rows = [text_metrics(text or "") for text in texts]
        columns = zip(*rows, strict=True) if rows else [()] * len(METRICS)
        return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], names=list(METRICS))

    return with_column_of(docs, text, name, StructType([StructField(name, LongType()) for name in METRICS]), measured)


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def stratum(column: Column) -> Column:
    return F.coalesce(column, F.lit("und"))


def lower_tail(k: int, n: int, p: float) -> float:
    """P(Bin(n, p) <= k), exact up to rounding; terms are added from the largest on, both ways."""
    if k >= n or p <= 0:
        return 1.0
    top = min(k, int((n + 1) * p))
    first = math.exp(
        math.lgamma(n + 1) - math.lgamma(top + 1) - math.lgamma(n - top + 1) + top * math.log(p) + (n - top) * math.log1p(-p)
    )
    total, term = first, first
    for i in range(top, 0, -1):
        term *= i / (n - i + 1) * (1 - p) / p
        total += term
        if term < total * 1e-17:
            break
    term = first
    for i in range(top, k):
        term *= (n - i) / (i + 1) * p / (1 - p)
        total += term
        if term < total * 1e-17:
            break
    return min(1.0, total)


def calibrate(
    metrics: DataFrame, labels: DataFrame, alpha: float = 0.08, delta: float = 0.1, rules: tuple[Rule, ...] = RULES
) -> DataFrame:
    """Proven cutoffs: a small table (stratum, one column of thousandths per rule, null if none).

    ``metrics`` has doc_id, stratum and the METRICS; ``labels`` has doc_id and
    ``good``.  One aggregate counts rejections of all cutoffs; what comes to the
    driver is one row for each stratum that has enough labels to prove anything.
    """
    spark = metrics.sparkSession
    judged = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(F.col("good").cast("int")).alias("good"))
    good, bad = F.col("good") == 1, F.col("good") == 0

    def rejected(rule: Rule, cut: int, side: Column) -> Column:
        return F.count(F.when(rule.above(cut) & side, 1))

    counted = (
        metrics.join(judged, "doc_id")
        .groupBy("stratum")
        .agg(
            F.count(F.when(good, 1)).alias("n"),
            *[rejected(rule, cut, good).alias(f"{rule.name}_{cut}") for rule in rules for cut in rule.cutoffs],
            *[rejected(rule, cut, bad).alias(f"{rule.name}_{cut}_bad") for rule in rules for cut in rule.cutoffs],
        )
        .where(F.col("n") >= math.ceil(math.log(delta) / math.log1p(-alpha)))
    )
    rows = [row.asDict() for row in counted.collect()]
    tests, share = max(1, len(rows) * len(rules)), alpha / len(rules)
    found = []
    for row in rows:
        cutoffs: list[int | None] = []
        for rule in rules:
            proven: dict[int, int] = {}
            for cut in rule.cutoffs:
                if lower_tail(row[f"{rule.name}_{cut}"], row["n"], share) > delta / tests:
                    break
                proven[cut] = row[f"{rule.name}_{cut}_bad"]
            most = max(proven.values(), default=0)
            enough = [cut for cut, caught in proven.items() if most and 100 * caught >= NEARLY * most]
            cutoffs.append(max(enough, default=None))
        found.append((row["stratum"], *cutoffs))
    return spark.createDataFrame(found, "stratum string, " + ", ".join(f"{rule.name} int" for rule in rules))


def judge(metrics: DataFrame, cutoffs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``metrics`` plus base_failed, rejected_by (array of rule names) and kept.

    ``cutoffs`` is broadcast: calibrate() made it on the driver from strata with
    proven counts, so its size is bounded by the labelled rows over about thirty.
    """
    proven = F.broadcast(cutoffs.select(F.col("stratum").alias("_at"), *[F.col(r.name).alias(f"_{r.name}") for r in rules]))
    hits = F.array_compact(
        F.array(*[F.when(rule.above(F.col(f"_{rule.name}")), F.lit(rule.name)) for rule in rules])
    )
    return (
        metrics.join(proven, F.col("stratum") == F.col("_at"), "left")
        .withColumn("base_failed", base_failed())
        .withColumn("rejected_by", hits)
        .withColumn("kept", ~F.col("base_failed") & (F.size("rejected_by") == 0))
        .drop("_at", *[f"_{rule.name}" for rule in rules])
    )


def quality_rules(docs: DataFrame, labels: DataFrame, **limits: float) -> DataFrame:
    """One row per document: doc_id, stratum, the METRICS and the verdict of judge().

    Texts are read once; the narrow metrics are pinned and serve both the
    calibration and the verdicts.
    """
    narrow = with_metrics(docs.select("doc_id", stratum(F.col("lang")).alias("stratum"), "text"))
    metrics = pin(narrow.select("doc_id", "stratum", "metrics.*"), "quality-metrics")
    return judge(metrics, calibrate(metrics, labels, **limits))


def keep_good(docs: DataFrame, labels: DataFrame, **limits: float) -> DataFrame:
    """The documents that pass, with their own columns; texts take part in no shuffle."""
    narrow = with_metrics(docs.select("doc_id", stratum(F.col("lang")).alias("stratum"), "text"))
    cutoffs = calibrate(narrow.select("doc_id", "stratum", "metrics.*"), labels, **limits)
    fresh = "metrics"
    while fresh in docs.columns:
        fresh += "_"
    own = F.struct(*[F.col(f"`{name}`") for name in docs.columns]).alias("own")
    whole = with_metrics(docs, name=fresh).select(own, stratum(F.col("lang")).alias("stratum"), f"{fresh}.*")
    return judge(whole, cutoffs).where("kept").select(*[F.col(f"own.`{name}`").alias(name) for name in docs.columns])
