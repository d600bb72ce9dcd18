"""Pair queries: decisions, override cascade and the reports built on them."""

from __future__ import annotations

from pyspark.sql import functions as F

from verdikt.functions import decisions as D
from verdikt.functions import text as T
from verdikt.operators import cascade as C
from verdikt.operators import pair_metrics as M
from verdikt.operators import reports as R
from verdikt.plans import base as B
from verdikt.plans.registry import query

LANG_FAMILY = {"en": "mmlu-pro", "fr": "livebench-reasoning", "de": "livebench-math", "es": "livecodebench"}
PROMPTS = [
    "Summarize the text in one sentence",
    "List the main points",
    "Explain the method step by step",
    "Show the parts in a table",
    "Write a Python function for it",
    "Explain in detail what it says",
    "What is this text about",
]
FEATURES = ("char_count", "word_count", "bullet_count", "table_rows", "has_table", "code_blocks")


def side_rows(spark, folder):
    cands = B.candidates(spark, folder, D.format_features(F.col("text")).alias("fmt"))
    family = F.create_map(*[F.lit(x) for kv in LANG_FAMILY.items() for x in kv])
    return cands.select(
        F.floor(F.col("candidate_id") / 2).cast("bigint").alias("pair_id"),
        (F.col("candidate_id") % 2).alias("side"),
        F.col("example_id").alias("source"),
        family[F.col("family")].alias("source_family"),
        (2 * F.coalesce("quality", F.lit(0)) - F.coalesce("toxic", F.lit(0))).alias("grade"),
        "satisfied_count", "adjusted_points", *B.RULE_IDS, "fmt.*",
    )


def pair_rows(spark, folder):
    """One row per pair with a struct per side; only narrow features are shuffled."""
    rows = side_rows(spark, folder)
    body = F.struct(*[c for c in rows.columns if c not in ("pair_id", "side")])
    sides = rows.groupBy("pair_id").agg(
        F.max(F.when(F.col("side") == 0, body)).alias("a"),
        F.max(F.when(F.col("side") == 1, body)).alias("b"),
    ).where(F.col("a").isNotNull() & F.col("b").isNotNull())
    a, b = F.col("a"), F.col("b")
    agree = B.total([(a[r] == b[r]).cast("int") for r in B.RULE_IDS])
    label = D.compare(a["grade"], b["grade"])
    prompts = F.array(*[F.lit(p) for p in PROMPTS])
    return sides.select(
        "pair_id", "a", "b",
        a["source_family"].alias("source_family"),
        a["source"].alias("source"),
        label.alias("label"),
        F.when(label == D.FIRST, "a").when(label == D.SECOND, "b").otherwise("").alias("gold"),
        F.element_at(prompts, (F.col("pair_id") % len(PROMPTS) + 1).cast("int")).alias("question"),
        (a["satisfied_count"] / F.lit(float(B.RULE_COUNT))).alias("uniform_score_a"),
        (b["satisfied_count"] / F.lit(float(B.RULE_COUNT))).alias("uniform_score_b"),
        (a["adjusted_points"] / F.lit(float(B.ADJUSTED_TOTAL))).alias("score_a"),
        (b["adjusted_points"] / F.lit(float(B.ADJUSTED_TOTAL))).alias("score_b"),
        (agree == B.RULE_COUNT).alias("no_signal"),
        (agree >= B.RULE_COUNT - 2).alias("unstable"),
        (a["source_family"] != "livecodebench").alias("strict"),
        (a["source_family"] == "mmlu-pro").alias("exact_task"),
        (a["source_family"] == "livecodebench").alias("code_task"),
        (a["satisfied_count"] + b["satisfied_count"]).alias("rubric_count"),
        (a["r02"] + b["r02"]).alias("broad_rubrics"),
        (a["r02"] == 1).alias("parsed_a"),
        (b["r02"] == 1).alias("parsed_b"),
    ).withColumn("uniform_decision", D.compare(F.col("uniform_score_a"), F.col("uniform_score_b")))


def signals(side):
    names = {"exact_match": "r03", "consistent": "r06", "format_ok": "r05", "explicit": "r07",
             "choice_letter": "r04", "choice_value": "r08", "conflicting": "r09",
             "option_map": "r01", "extracted": "r02"}
    return F.struct(
        *[(side[col] == 1).alias(name) for name, col in names.items()],
        side["bullet_count"].alias("marker_count"),
    )


def verified(pairs):
    tagged = pairs.withColumns({
        "sig_a": signals(F.col("a")), "sig_b": signals(F.col("b")),
        "verifier_source": F.when(F.col("code_task"), "code_execution_verifier")
        .when(F.col("exact_task"), "mmlu_independent_answerer").otherwise("exact_answer_verifier"),
        "agreeing_high": F.col("a.r02") != F.col("b.r02"),
    })
    return D.verifier_outcome(tagged, "source_family", "sig_a", "sig_b", "exact_task")


def graded_by(ratio_a, ratio_b, step_num, step_den):
    """Decision and confidence from two counts: larger by a factor wins."""
    a, b = ratio_a, ratio_b
    decision = (
        F.when(a * step_den > b * step_num, D.FIRST).when(b * step_den > a * step_num, D.SECOND).otherwise(D.EVEN)
    )
    big, small = F.greatest(a, b), F.least(a, b)
    return decision, F.when(big >= 2 * small, "high").when(big * 2 >= 3 * small, "medium").otherwise("low")


def attempts():
    """Two directional attempts of a stand-in discriminator, by words and by characters."""
    a, b = F.col("a"), F.col("b")
    rows = []
    for order, field, num, den in (("AB", "word_count", 6, 5), ("BA", "char_count", 13, 10)):
        decision, confidence = graded_by(a[field], b[field], num, den)
        rows.append(F.struct(F.lit(order).alias("order"), decision.alias("decision"), confidence.alias("confidence")))
    return F.array(*rows)


def holistic_rows():
    a, b = F.col("a"), F.col("b")
    rows = []
    for order, field, unit in (("AB", "satisfied_count", 1), ("BA", "adjusted_points", 100)):
        gap = F.abs(a[field] - b[field])
        rows.append(F.struct(
            F.lit(order).alias("order"), D.compare(a[field], b[field]).alias("decision"),
            F.when(gap >= 2 * unit, "high").when(gap >= unit, "medium").otherwise("").alias("confidence"),
        ))
    return F.array(*rows)


def discriminated(pairs):
    return C.with_discriminator(pairs.withColumn("attempts", attempts()), "attempts")


def judged(spark, folder):
    """Pairs after the whole override cascade.

    One shuffle (the pair key); every later layer is a projection of that row.
    """
    pairs = verified(pair_rows(spark, folder))
    scored = D.compare(F.col("score_a"), F.col("score_b"))  # before any override
    pairs = pairs.withColumns({"attempts": attempts(), "holistic": holistic_rows(), "scored": scored})
    df = C.with_holistic(C.with_discriminator(pairs.drop("a", "b", "sig_a", "sig_b"), "attempts"), "holistic")
    df = C.stabilize(C.start(df.drop("attempts", "holistic")))
    v = F.col("verifier")
    df = C.apply_verifier(df, v["decision"], v["confidence"], F.col("verifier_source"), F.col("agreeing_high"))
    route = C.discriminator_route(F.col("rubric_count"), v["decision"], v["confidence"], wide=True)
    df = df.withColumn("routed", route)
    df = C.apply_blind_discriminator(df, F.col("disc_decision"), F.col("disc_confidence"), F.col("routed"))
    return C.apply_holistic(df, F.col("holi_decision"), F.col("holi_confidence"), F.col("holi_consistent"),
                            low_margin=0.05)


def _points(side: str) -> str:
    other = [
        (f"{side}.r03 = 1", 5.0), (f"{side}.r06 = 1", 2.0), (f"{side}.r05 = 1", 1.25), (f"{side}.r07 = 1", 1.0),
        (f"{side}.r04 = 1", 0.5), (f"{side}.r08 = 1", 0.35), (f"{side}.r09 = 1", -2.75),
        (f"{side}.bullet_count > 1", -0.5),
        (f"a.source_family = 'mmlu-pro' AND {side}.r03 = 1", 1.5),
        (f"a.source_family = 'mmlu-pro' AND {side}.r04 = 1 AND {side}.r08 = 1", 0.65),
        (f"a.source_family = 'mmlu-pro' AND {side}.r01 = 1 AND {side}.r07 = 0", -0.5),
        (f"a.source_family = 'livebench-reasoning' AND {side}.r06 = 1", 0.75),
        (f"a.source_family = 'livebench-reasoning' AND {side}.r07 = 1", 0.5),
        (f"a.source_family = 'livebench-reasoning' AND {side}.r07 = 0 AND {side}.r02 = 0", -0.5),
        (f"a.source_family = 'livebench-math' AND {side}.r05 = 1", 0.5),
        (f"a.source_family = 'livebench-math' AND {side}.r02 = 1", 0.35),
        (f"a.source_family <> 'mmlu-pro' AND {side}.r06 = 0", -0.25),
    ]
    return " + ".join(f"(CASE WHEN {c} THEN {p} ELSE 0.0 END)::DOUBLE" for c, p in other)


def _sql_flip(d: str) -> str:
    return f"CASE {d} WHEN 'A>B' THEN 'B>A' WHEN 'B>A' THEN 'A>B' ELSE {d} END"


def _sql_compare(a: str, b: str) -> str:
    return f"CASE WHEN {a} > {b} THEN 'A>B' WHEN {a} < {b} THEN 'B>A' ELSE 'A=B' END"


SQL_ROWS = "string_split(text, chr(10))"
SIDES = B.CANDS + f""",
sides AS (
  SELECT candidate_id // 2 AS pair_id, candidate_id % 2 AS side, * EXCLUDE (text),
    CASE family {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in LANG_FAMILY.items())} END AS source_family,
    2 * coalesce(quality, 0) - coalesce(toxic, 0) AS grade,
    length(text) AS char_count, len({B.sql_words('text')}) AS word_count,
    len(list_filter({SQL_ROWS}, lambda x: regexp_matches(x, '{D.BULLET_LINE}'))) AS bullet_count,
    len(list_filter({SQL_ROWS}, lambda x: regexp_matches(x, '{D.TABLE_LINE}'))) AS table_rows,
    len(list_filter({SQL_ROWS}, lambda x: regexp_matches(x, '{D.TABLE_LINE}'))) >= 2
      AND len(list_filter({SQL_ROWS}, lambda x: regexp_matches(x, '{D.TABLE_RULE}'))) > 0 AS has_table,
    len(regexp_extract_all(text, '```')) // 2 AS code_blocks
  FROM cands)"""

PAIRS = SIDES + f""",
pairs AS (
  SELECT a.pair_id, a.source_family, a.example_id AS source,
    {_sql_compare('a.grade', 'b.grade')} AS label,
    CASE WHEN a.grade > b.grade THEN 'a' WHEN a.grade < b.grade THEN 'b' ELSE '' END AS gold,
    [{', '.join(f"'{p}'" for p in PROMPTS)}][a.pair_id % {len(PROMPTS)} + 1] AS question,
    a.satisfied_count / {B.RULE_COUNT}.0::DOUBLE AS uniform_score_a,
    b.satisfied_count / {B.RULE_COUNT}.0::DOUBLE AS uniform_score_b,
    a.adjusted_points / {B.ADJUSTED_TOTAL}.0::DOUBLE AS score_a,
    b.adjusted_points / {B.ADJUSTED_TOTAL}.0::DOUBLE AS score_b,
    {_sql_compare('a.satisfied_count', 'b.satisfied_count')} AS uniform_decision,
    ({' + '.join(f'(a.{r} = b.{r})::INT' for r in B.RULE_IDS)}) AS agree,
    a.source_family <> 'livecodebench' AS strict, a.source_family = 'mmlu-pro' AS exact_task,
    a.source_family = 'livecodebench' AS code_task,
    a.satisfied_count + b.satisfied_count AS rubric_count, a.r02 + b.r02 AS broad_rubrics,
    a.r02 = 1 AS parsed_a, b.r02 = 1 AS parsed_b, a.r02 <> b.r02 AS agreeing_high,
    {_points('a')} AS va, {_points('b')} AS vb,
    a.r03 <> b.r03 AS d_exact, a.r06 <> b.r06 AS d_consistent, a.r09 <> b.r09 AS d_conflict, a.r05 <> b.r05 AS d_format,
    {', '.join(f'{s}.{f} AS {f}_{s}' for s in 'ab' for f in FEATURES)},
    a.satisfied_count AS sat_a, b.satisfied_count AS sat_b, a.adjusted_points AS pts_a, b.adjusted_points AS pts_b
  FROM sides a JOIN sides b ON a.pair_id = b.pair_id AND a.side = 0 AND b.side = 1)"""

VERIFIED = PAIRS + """,
v1 AS (SELECT *, round(abs(va - vb), 6) AS v_margin,
    CASE source_family WHEN 'mmlu-pro' THEN 1.0 WHEN 'livebench-reasoning' THEN 1.25 WHEN 'livebench-math' THEN 1.25
      ELSE 1.5 END::DOUBLE AS v_threshold FROM pairs),
v2 AS (SELECT *, v_margin >= v_threshold AS v_passed,
    CASE WHEN v_margin < v_threshold THEN CASE WHEN v_margin > 0 THEN 'low' ELSE '' END
      WHEN d_exact THEN 'high' WHEN d_consistent AND v_margin >= 1.5 THEN 'high' WHEN v_margin >= 3.0 THEN 'high'
      WHEN v_margin >= 1.75 THEN 'medium' WHEN source_family = 'mmlu-pro' THEN 'medium' ELSE 'low' END AS v_confidence FROM v1),
verified AS (SELECT *, v_passed AND v_confidence IN ('medium', 'high') AS v_triggered,
    CASE WHEN v_passed AND v_confidence IN ('medium', 'high') THEN CASE WHEN va > vb THEN 'A>B' ELSE 'B>A' END ELSE '' END AS v_decision,
    CASE WHEN NOT v_passed THEN 'insufficient_verifier_margin' ELSE
      CASE WHEN va > vb THEN 'a_' ELSE 'b_' END || CASE WHEN d_exact THEN 'exact_answer_match'
        WHEN d_consistent THEN 'answer_consistency' WHEN d_conflict THEN 'marker_conflict' WHEN d_format THEN 'answer_format'
        WHEN source_family = 'livebench-reasoning' THEN 'reasoning_state_tracking'
        WHEN source_family = 'mmlu-pro' THEN 'choice_alignment' ELSE 'verifier_margin' END END AS v_reason,
    CASE WHEN code_task THEN 'code_execution_verifier' WHEN exact_task THEN 'mmlu_independent_answerer'
      ELSE 'exact_answer_verifier' END AS v_source FROM v2)"""


def _sql_attempt(order, field, num, den):
    a, b = f"{field}_a", f"{field}_b"
    return f"""SELECT pair_id, '{order}' AS ord,
    CASE WHEN {a} * {den} > {b} * {num} THEN 'A>B' WHEN {b} * {den} > {a} * {num} THEN 'B>A' ELSE 'A=B' END AS d,
    CASE WHEN greatest({a}, {b}) >= 2 * least({a}, {b}) THEN 'high'
      WHEN greatest({a}, {b}) * 2 >= 3 * least({a}, {b}) THEN 'medium' ELSE 'low' END AS c FROM pairs"""


ATTEMPTS = f"""att AS ({_sql_attempt('AB', 'word_count', 6, 5)} UNION ALL {_sql_attempt('BA', 'char_count', 13, 10)}),
disc AS (
  SELECT pair_id, list(d ORDER BY ord) AS ds, list(d) FILTER (d <> 'A=B') AS dirs,
    list(CASE c WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END) FILTER (d <> 'A=B') AS ranks FROM att GROUP BY ALL),
discr AS (SELECT pair_id, CASE WHEN dirs IS NULL THEN 'A=B' WHEN len(list_distinct(dirs)) > 1 THEN '' ELSE dirs[1] END AS disc_decision,
    CASE WHEN dirs IS NULL THEN 'low' WHEN len(list_distinct(dirs)) > 1 THEN ''
      WHEN len(dirs) >= 2 AND list_min(ranks) >= 2 THEN CASE WHEN list_contains(ds, 'A=B') THEN 'medium' ELSE 'high' END
      WHEN list_max(ranks) >= 2 THEN 'medium' ELSE 'low' END AS disc_confidence,
    dirs IS NULL OR len(list_distinct(dirs)) = 1 AS order_consistent FROM disc)"""

HOLISTIC = f"""hat AS (
  SELECT pair_id, {_sql_compare('sat_a', 'sat_b')} AS d,
    CASE WHEN abs(sat_a - sat_b) >= 2 THEN 'high' WHEN abs(sat_a - sat_b) >= 1 THEN 'medium' ELSE '' END AS c FROM pairs
  UNION ALL SELECT pair_id, {_sql_compare('pts_a', 'pts_b')},
    CASE WHEN abs(pts_a - pts_b) >= 200 THEN 'high' WHEN abs(pts_a - pts_b) >= 100 THEN 'medium' ELSE '' END FROM pairs),
hl AS (SELECT pair_id, list_distinct(list(d) FILTER (d <> 'A=B')) AS dirs, bool_and(d = 'A=B') AS all_even,
    count(*) FILTER (c <> '') AS stated, count(*) FILTER (c = 'high') AS high,
    count(*) FILTER (c IN ('high', 'medium')) AS sure FROM hat GROUP BY ALL),
holi AS (SELECT pair_id, CASE WHEN len(dirs) = 1 THEN dirs[1] WHEN len(dirs) = 2 THEN '' WHEN all_even THEN 'A=B' ELSE '' END AS holi_decision,
    CASE WHEN len(dirs) = 1 THEN CASE WHEN stated > 0 AND high = stated THEN 'high' WHEN sure > 0 THEN 'medium' ELSE 'low' END
      ELSE '' END AS holi_confidence, coalesce(len(dirs), 0) < 2 AS holi_consistent FROM hl)"""

JUDGED = VERIFIED + ", " + ATTEMPTS + ", " + HOLISTIC + f""",
j0 AS (SELECT v.*, disc_decision, disc_confidence, order_consistent, holi_decision, holi_confidence, holi_consistent,
    agree = {B.RULE_COUNT} AS no_signal, agree >= {B.RULE_COUNT - 2} AS unstable,
    {_sql_compare('pts_a', 'pts_b')} AS d0 FROM verified v JOIN discr USING (pair_id) JOIN holi USING (pair_id)),
j1 AS (SELECT *, CASE WHEN strict AND uniform_decision <> 'A=B' AND d0 = 'A=B' THEN 'uniform_breaks_strict_tie'
    WHEN strict AND uniform_decision <> 'A=B' AND d0 <> 'A=B' AND uniform_decision <> d0 AND unstable
      THEN 'uniform_overrides_unstable_whitening' ELSE 'whitened_uniform' END AS p1 FROM j0),
j2 AS (SELECT *, CASE WHEN p1 = 'whitened_uniform' THEN d0 ELSE uniform_decision END AS d1,
    CASE WHEN p1 = 'whitened_uniform' THEN '' ELSE d0 END AS b1,
    CASE WHEN p1 = 'whitened_uniform' THEN abs(score_a - score_b) ELSE abs(uniform_score_a - uniform_score_b) END AS m1 FROM j1),
j3 AS (SELECT *, v_decision <> '' AND v_decision <> d1 AND CASE WHEN d1 = 'A=B' THEN no_signal ELSE
      (v_confidence = 'high' AND (v_source IN ('code_execution_verifier', 'mmlu_independent_answerer') OR agreeing_high))
      OR (v_confidence = 'high' AND unstable AND m1 <= 0.006) END AS f2 FROM j2),
j4 AS (SELECT *, CASE WHEN f2 THEN v_decision ELSE d1 END AS d2, CASE WHEN f2 THEN d1 ELSE b1 END AS b2,
    CASE WHEN f2 THEN 'pair_verifier' ELSE p1 END AS p2 FROM j3),
j5 AS (SELECT *, source_family <> 'livecodebench' AND v_decision = '' AND rubric_count >= 10 AND
    CASE WHEN d2 = 'A=B' THEN no_signal ELSE unstable OR
      m1 <= CASE WHEN source_family = 'livebench-reasoning' THEN 0.05 ELSE 0.02 END END AS routed FROM j4),
j6 AS (SELECT *, routed AND disc_decision IN ('A>B', 'B>A') AND disc_confidence <> 'low' AND d2 <> disc_decision AS f3 FROM j5),
j7 AS (SELECT *, CASE WHEN f3 THEN disc_decision ELSE d2 END AS d3, CASE WHEN f3 THEN d2 ELSE b2 END AS b3,
    CASE WHEN f3 THEN 'blind_pair_discriminator' ELSE p2 END AS p3 FROM j6),
j8 AS (SELECT *, holi_decision IN ('A>B', 'B>A') AND holi_confidence = 'high' AND holi_consistent
    AND (d3 = 'A=B' OR (d3 <> holi_decision AND m1 <= 0.05)) AS f4 FROM j7),
judged AS (SELECT * EXCLUDE (d0, d1, d2, d3, b1, b2, b3, p1, p2, p3),
    CASE WHEN f4 THEN holi_decision ELSE d3 END AS decision, {_sql_flip('d3')} AS decision_reversed,
    CASE WHEN f4 THEN d3 ELSE b3 END AS base_decision, CASE WHEN f4 THEN 'holistic_judge' ELSE p3 END AS policy FROM j8)"""

SQL_CORRECT = """((decision = label)::INT - (decision = CASE label WHEN 'A>B' THEN 'B>A' WHEN 'B>A' THEN 'A>B' END
    AND decision <> label)::INT
  + (CASE decision_reversed WHEN 'A>B' THEN 'B>A' WHEN 'B>A' THEN 'A>B' ELSE decision_reversed END = label)::INT
  - (CASE decision_reversed WHEN 'A>B' THEN 'B>A' WHEN 'B>A' THEN 'A>B' ELSE decision_reversed END
     = CASE label WHEN 'A>B' THEN 'B>A' WHEN 'B>A' THEN 'A>B' END)::INT)"""
# label A=B flips to itself, so a matching decision counts once and never minus
SQL_RIGHT = f"coalesce({SQL_CORRECT}, (decision = label)::INT + (decision_reversed = label)::INT) > 0"


@query("pair_preference", f"""WITH {PAIRS},
o AS (SELECT source_family, 'uniform' AS method, gold, sat_a > sat_b AS wa, sat_a < sat_b AS wb FROM pairs
  UNION ALL SELECT source_family, 'adjusted', gold, pts_a > pts_b, pts_a < pts_b FROM pairs)
SELECT source_family, method, count(*) FILTER (gold <> '') AS evaluable,
  count(*) FILTER ((gold = 'a' AND wa) OR (gold = 'b' AND wb)) AS correct,
  round(coalesce(count(*) FILTER ((gold = 'a' AND wa) OR (gold = 'b' AND wb))
    / nullif(count(*) FILTER (gold <> ''), 0)::DOUBLE, 0), 6) AS accuracy FROM o GROUP BY ALL""")
def pair_preference(spark, folder):
    none = F.lit(None).cast("bigint")
    methods = F.array(*[
        F.struct(F.lit(m).alias("method"), R.pair_outcome(F.col(a), F.col(b), none, none, F.col("gold")).alias("outcome"))
        for m, a, b in (("uniform", "uniform_score_a", "uniform_score_b"), ("adjusted", "score_a", "score_b"))
    ])
    rows = pair_rows(spark, folder).select("source_family", F.inline(methods))
    return rows.groupBy("source_family", "method").agg(
        F.count(F.when(F.col("outcome") != "unevaluable", 1)).alias("evaluable"),
        F.count(F.when(F.col("outcome") == "correct", 1)).alias("correct"),
    ).select("*", F.round(T.ratio(F.col("correct"), F.col("evaluable")), 6).alias("accuracy"))


@query("confusion_matrix", f"""WITH {PAIRS},
p AS (SELECT source_family, gold, CASE WHEN pts_a > pts_b THEN 'a' WHEN pts_b > pts_a THEN 'b' ELSE 'tie' END AS pred
  FROM pairs WHERE gold <> ''),
c AS (SELECT source_family, count(*) AS n, count(*) FILTER (gold = 'a') AS gold_a, count(*) FILTER (gold = 'b') AS gold_b,
  count(*) FILTER (pred = 'a' AND gold = 'a') AS pred_a_gold_a, count(*) FILTER (pred = 'a' AND gold = 'b') AS pred_a_gold_b,
  count(*) FILTER (pred = 'b' AND gold = 'a') AS pred_b_gold_a, count(*) FILTER (pred = 'b' AND gold = 'b') AS pred_b_gold_b,
  count(*) FILTER (pred = 'tie') AS ties, 0::BIGINT AS no_score FROM p GROUP BY ALL)
SELECT *, round((pred_a_gold_a + pred_b_gold_b) / n::DOUBLE, 6) AS accuracy,
  round(coalesce((pred_a_gold_a + pred_b_gold_b) / nullif(n - ties, 0)::DOUBLE, 0), 6) AS decided_accuracy,
  round(coalesce(pred_a_gold_a / nullif(gold_a, 0)::DOUBLE, 0), 6) AS recall_a,
  round(coalesce(pred_b_gold_b / nullif(gold_b, 0)::DOUBLE, 0), 6) AS recall_b,
  round(gold_a / n::DOUBLE, 6) AS always_a, round(gold_b / n::DOUBLE, 6) AS always_b FROM c""")
def confusion_matrix(spark, folder):
    rows = pair_rows(spark, folder).select(
        "source_family", "gold", D.predict(F.col("score_a"), F.col("score_b")).alias("pred")
    )
    out = M.confusion(rows, ["source_family"])
    rates = ("accuracy", "decided_accuracy", "recall_a", "recall_b", "always_a", "always_b")
    return out.select(*[F.round(c, 6).alias(c) if c in rates else F.col(c) for c in out.columns])


@query("format_features", f"""WITH {SIDES}
SELECT candidate_id, char_count, word_count, bullet_count, table_rows, has_table, code_blocks FROM sides""")
def format_features(spark, folder):
    docs = B.table(spark, folder, "documents")
    return docs.select(F.col("doc_id").alias("candidate_id"), D.format_features(F.col("text")).alias("f")).select(
        "candidate_id", "f.*"
    )


FORMAT_VOTES = """,
cue AS (SELECT *, pair_id % 7 AS k FROM pairs),
cue2 AS (SELECT *, k = 0 AS terse, k = 1 AS list, k = 2 AS numbered, k = 3 AS tbl, k = 4 AS code, k IN (2, 5) AS expl,
  word_count_a / greatest(1, word_count_b)::DOUBLE AS ab, word_count_b / greatest(1, word_count_a)::DOUBLE AS ba,
  word_count_a > 0 AND word_count_b > 0 AS spoken FROM cue),
votes AS (SELECT *,
  (terse AND spoken AND ab < 0.7)::INT + ((list OR numbered) AND bullet_count_a >= 2 AND bullet_count_b < 2)::INT
  + (tbl AND has_table_a AND NOT has_table_b)::INT + (code AND code_blocks_a > 0 AND code_blocks_b = 0)::INT
  + (k = 5 AND spoken AND ab > 1.5)::INT AS votes_a,
  (terse AND spoken AND NOT ab < 0.7 AND ba < 0.7)::INT + ((list OR numbered) AND bullet_count_b >= 2 AND bullet_count_a < 2)::INT
  + (tbl AND has_table_b AND NOT has_table_a)::INT + (code AND code_blocks_b > 0 AND code_blocks_a = 0)::INT
  + (k = 5 AND spoken AND NOT ab > 1.5 AND ba > 1.5)::INT AS votes_b FROM cue2)"""


def with_format(pairs):
    cues = D.format_request(F.col("question"))
    named = pairs.withColumns(cues)
    va, vb = D.format_votes({c: F.col(c) for c in cues}, F.col("a"), F.col("b"))
    return named.withColumn("votes_a", va).withColumn("votes_b", vb).withColumn(
        "format_verdict", D.format_verdict(F.col("votes_a"), F.col("votes_b"))
    )


@query("format_prior", f"""WITH {PAIRS}{FORMAT_VOTES}
SELECT pair_id, votes_a::BIGINT AS votes_a, votes_b::BIGINT AS votes_b,
  CASE WHEN votes_a > votes_b THEN 'a' WHEN votes_b > votes_a THEN 'b' ELSE 'tie' END AS verdict FROM votes""")
def format_prior(spark, folder):
    return with_format(pair_rows(spark, folder)).select(
        "pair_id", "votes_a", "votes_b", F.col("format_verdict").alias("verdict")
    )


TIEBREAK = f"""WITH {PAIRS}{FORMAT_VOTES}, {ATTEMPTS},
t AS (SELECT v.pair_id, gold, CASE WHEN pts_a > pts_b THEN 'a' WHEN pts_b > pts_a THEN 'b' ELSE 'tie' END AS primary_pred,
  CASE WHEN votes_a > votes_b THEN 'a' WHEN votes_b > votes_a THEN 'b' ELSE 'tie' END AS fmt,
  CASE WHEN sat_a > sat_b THEN 'a' WHEN sat_b > sat_a THEN 'b' ELSE 'tie' END AS uni,
  CASE disc_decision WHEN 'A>B' THEN 'a' WHEN 'B>A' THEN 'b' ELSE 'tie' END AS judge FROM votes v JOIN discr USING (pair_id)),
r AS (SELECT *, CASE WHEN gold = '' THEN 'unevaluable' WHEN primary_pred <> 'tie' THEN 'primary' WHEN fmt <> 'tie' THEN 'format'
    WHEN uni <> 'tie' THEN 'uniform' WHEN judge <> 'tie' THEN 'judge_anti_tie' ELSE 'judge_anti_tie_tied' END AS policy,
  CASE WHEN gold = '' THEN '' WHEN primary_pred <> 'tie' THEN primary_pred WHEN fmt <> 'tie' THEN fmt
    WHEN uni <> 'tie' THEN uni ELSE judge END AS pred FROM t)"""


@query("tiebreak_cascade", TIEBREAK + """
SELECT policy, gold, count(*) AS n, count(*) FILTER (policy <> 'unevaluable' AND pred = gold) AS correct,
  count(*) FILTER (policy <> 'unevaluable' AND pred = 'tie') AS tie,
  count(*) FILTER (policy <> 'unevaluable' AND pred <> gold AND pred <> 'tie') AS wrong FROM r GROUP BY ALL""")
def tiebreak_cascade(spark, folder):
    """Primary score, then format prior, then uniform score, then the judge verdict."""
    df = discriminated(with_format(pair_rows(spark, folder)))
    judge = F.col("disc_decision")
    judge_pred = F.when(judge == D.FIRST, "a").when(judge == D.SECOND, "b").otherwise("tie")
    steps = [
        ("primary", D.predict(F.col("score_a"), F.col("score_b"))),
        ("format", F.col("format_verdict")),
        ("uniform", D.predict(F.col("uniform_score_a"), F.col("uniform_score_b"))),
        ("judge_anti_tie", judge_pred),
    ]
    policy = F.when(F.col("gold") == "", "unevaluable")
    pred = F.when(F.col("gold") == "", "")
    for name, value in steps:
        policy = policy.when(value.isin("a", "b"), name)
        pred = pred.when(value.isin("a", "b"), value)
    rows = df.select("gold", policy.otherwise("judge_anti_tie_tied").alias("policy"), pred.otherwise("tie").alias("pred"))
    usable = F.col("policy") != "unevaluable"
    right, tied = F.col("pred") == F.col("gold"), F.col("pred") == "tie"
    return rows.groupBy("policy", "gold").agg(
        F.count(F.lit(1)).alias("n"),
        F.count(F.when(usable & right, 1)).alias("correct"),
        F.count(F.when(usable & tied, 1)).alias("tie"),
        F.count(F.when(usable & ~right & ~tied, 1)).alias("wrong"),
    )


@query("verifier_margin", f"""WITH {VERIFIED}
SELECT pair_id, v_decision AS decision, v_confidence AS confidence, v_margin AS margin, v_reason AS reason,
  v_triggered AS triggered FROM verified""")
def verifier_margin(spark, folder):
    return verified(pair_rows(spark, folder)).select("pair_id", "verifier.*")


@query("discriminator_unanimity", f"""WITH {PAIRS}, {ATTEMPTS}
SELECT pair_id, disc_decision AS decision, disc_confidence AS confidence, order_consistent FROM discr""")
def discriminator_unanimity(spark, folder):
    return discriminated(pair_rows(spark, folder)).select(
        "pair_id", F.col("disc_decision").alias("decision"), F.col("disc_confidence").alias("confidence"),
        F.col("disc_consistent").alias("order_consistent"),
    )


@query("holistic_attempts", f"""WITH {PAIRS}, {HOLISTIC}
SELECT pair_id, holi_decision AS decision, holi_confidence AS confidence, holi_consistent AS order_consistent FROM holi""")
def holistic_attempts(spark, folder):
    rows = pair_rows(spark, folder).withColumn("holistic", holistic_rows())
    return C.with_holistic(rows, "holistic").select(
        "pair_id", F.col("holi_decision").alias("decision"), F.col("holi_confidence").alias("confidence"),
        F.col("holi_consistent").alias("order_consistent"),
    )


@query("override_cascade", f"""WITH {JUDGED}
SELECT pair_id, source_family, label, decision, decision_reversed, base_decision, policy, routed FROM judged""")
def override_cascade(spark, folder):
    return judged(spark, folder).select(
        "pair_id", "source_family", "label", "decision", "decision_reversed", "base_decision", "policy", "routed"
    )


@query("blind_stabilizer", f"""WITH {PAIRS},
j AS (SELECT *, agree = {B.RULE_COUNT} AS no_signal, agree >= {B.RULE_COUNT - 2} AS unstable, {_sql_compare('pts_a', 'pts_b')} AS d0,
  source_family IN ('mmlu-pro', 'livebench-reasoning', 'livebench-math') AND strict AND uniform_decision <> 'A=B' AS ok FROM pairs),
k AS (SELECT *, CASE WHEN ok AND d0 = 'A=B' AND no_signal THEN 'blind_uniform_breaks_tie'
  WHEN ok AND unstable AND d0 <> 'A=B' AND d0 <> uniform_decision AND abs(score_a - score_b) <= 0.006
  THEN 'blind_uniform_overrides_unstable_whitening' ELSE 'whitened_uniform' END AS policy FROM j)
SELECT pair_id, policy, CASE WHEN policy = 'whitened_uniform' THEN d0 ELSE uniform_decision END AS decision FROM k""")
def blind_stabilizer(spark, folder):
    return C.stabilize_blind(C.start(pair_rows(spark, folder))).select("pair_id", "policy", "decision")


@query("tie_discriminator", f"""WITH {PAIRS}, {ATTEMPTS},
j AS (SELECT *, {_sql_compare('pts_a', 'pts_b')} AS d0 FROM pairs JOIN discr USING (pair_id)),
k AS (SELECT *, source_family <> 'mmlu-pro' AND disc_decision IN ('A>B', 'B>A') AND disc_confidence <> 'low'
  AND d0 = 'A=B' AND agree = {B.RULE_COUNT} AS f FROM j)
SELECT pair_id, CASE WHEN f THEN disc_decision ELSE d0 END AS decision,
  CASE WHEN f THEN 'pairwise_discriminator' ELSE 'whitened_uniform' END AS policy FROM k""")
def tie_discriminator(spark, folder):
    df = C.start(discriminated(pair_rows(spark, folder)))
    return C.apply_discriminator(df, F.col("disc_decision"), F.col("disc_confidence")).select(
        "pair_id", "decision", "policy"
    )


@query("double_order_accuracy", f"""WITH {JUDGED}
SELECT source_family, count(*) AS pair_count, sum(({SQL_RIGHT})::INT)::BIGINT AS correct,
  round(100.0::DOUBLE * sum(({SQL_RIGHT})::INT) / count(*), 6) AS accuracy_pct FROM judged GROUP BY ALL""")
def double_order_accuracy(spark, folder):
    out = M.double_order(judged(spark, folder), ["source_family"])
    return out.withColumn("accuracy_pct", F.round("accuracy_pct", 6))


@query("family_breakdown", f"""WITH {JUDGED},
f(family) AS (VALUES ('overall'), {', '.join(f"('{x}')" for x in D.FAMILIES)})
SELECT family, count(source_family) AS pair_count,
  round(coalesce(100.0::DOUBLE * sum(({SQL_RIGHT})::INT) / nullif(count(source_family), 0), 0), 6) AS accuracy_pct
FROM f LEFT JOIN judged ON family = 'overall' OR family = source_family GROUP BY family""")
def family_breakdown(spark, folder):
    return M.family_breakdown(judged(spark, folder)).withColumn("accuracy_pct", F.round("accuracy_pct", 6))


@query("failure_buckets", f"""WITH {JUDGED}
SELECT source_family, decision AS failed_decision,
  CASE WHEN rubric_count <= 5 THEN '0_5' WHEN rubric_count <= 10 THEN '6_10' WHEN rubric_count <= 15 THEN '11_15'
    ELSE '16_plus' END AS rubric_bucket, count(*) AS failures, count(*) FILTER (decision = 'A=B') AS tie_failures,
  count(*) FILTER (exact_task) AS exact_answer_failures, count(*) FILTER (code_task) AS code_failures,
  count(*) FILTER (broad_rubrics > 0) AS broad_failures
FROM judged WHERE decision <> label GROUP BY ALL""")
def failure_buckets(spark, folder):
    return M.failure_analysis(judged(spark, folder))


def calibrated(spark, folder):
    v = F.col("verifier")
    return judged(spark, folder).select(
        "source_family", "decision", "label", "exact_task", "parsed_a", "parsed_b",
        F.col("disc_consistent").alias("order_consistent"),
        (v["confidence"] != "").alias("verifier_available"), v["triggered"].alias("verifier_triggered"),
        v["confidence"].alias("verifier_confidence"), F.col("routed").alias("discriminator_used"),
        F.col("disc_confidence").alias("discriminator_confidence"), C.margin().alias("pair_margin"),
    )


SQL_LOW = """(v_confidence IN ('', 'low') OR (routed AND disc_confidence IN ('', 'low')) OR m1 <= 0.006)"""


def _rate(a, b, default="0"):
    return f"round(coalesce(count(*) FILTER ({a}) / nullif(count(*) FILTER ({b}), 0)::DOUBLE, {default}), 6)"


FOCUS = "source_family IN ('mmlu-pro', 'livebench-reasoning')"


@query("calibration_rates", f"""WITH {JUDGED}
SELECT count(*) AS pair_count, {_rate("v_confidence <> ''", 'true')} AS verifier_coverage_rate,
  {_rate(f"{FOCUS} AND v_confidence <> ''", FOCUS)} AS focus_verifier_coverage_rate,
  {_rate('v_triggered', 'true')} AS verifier_trigger_rate, {_rate(f'{FOCUS} AND v_triggered', FOCUS)} AS focus_verifier_trigger_rate,
  {_rate('exact_task AND parsed_a AND parsed_b', 'exact_task')} AS exact_answer_parser_success_rate,
  count(*) FILTER (exact_task) AS exact_answer_task_count,
  {_rate(f'{SQL_LOW} AND decision = label', SQL_LOW, '1')} AS low_confidence_bucket_accuracy,
  count(*) FILTER ({SQL_LOW}) AS low_confidence_bucket_count, {_rate('routed', 'true')} AS discriminator_usage_rate,
  {_rate('routed AND NOT order_consistent', 'routed')} AS discriminator_order_disagreement_rate FROM judged""")
def calibration_rates(spark, folder):
    return M.calibration(calibrated(spark, folder))


@query("verifier_rates_by_family", f"""WITH {JUDGED}
SELECT source_family, {_rate("v_confidence <> ''", 'true')} AS coverage_rate, {_rate('v_triggered', 'true')} AS trigger_rate
FROM judged GROUP BY ALL""")
def verifier_rates_by_family(spark, folder):
    def share(c):
        return F.round(T.ratio(F.count(F.when(c, 1)), F.count(F.lit(1))), 6)

    return calibrated(spark, folder).groupBy("source_family").agg(
        share(F.col("verifier_available")).alias("coverage_rate"),
        share(F.col("verifier_triggered")).alias("trigger_rate"),
    )


@query("policy_counts", f"""WITH {JUDGED} SELECT policy, count(*) AS pairs,
  count(*) FILTER (decision = label) AS correct FROM judged GROUP BY ALL""")
def policy_counts(spark, folder):
    return judged(spark, folder).groupBy("policy").agg(
        F.count(F.lit(1)).alias("pairs"), F.count(F.when(F.col("decision") == F.col("label"), 1)).alias("correct")
    )


def _sql_ablation(name):
    gone = [p for part in name.split("+") for p in C.ABLATION_POLICIES.get(part, ())]
    back = f"policy IN ({', '.join(repr(p) for p in gone)}) AND base_decision <> ''" if gone else "false"
    return f"""SELECT '{name}' AS ablation, source_family, label, decision AS final,
      CASE WHEN {back} THEN base_decision ELSE decision END AS decision,
      CASE WHEN {back} THEN {_sql_flip('base_decision')} ELSE decision_reversed END AS decision_reversed FROM judged"""


@query("ablation", f"""WITH {JUDGED}, ab AS ({' UNION ALL '.join(_sql_ablation(n) for n in C.ABLATIONS)})
SELECT ablation, source_family, count(*) AS pair_count, count(*) FILTER (decision <> final) AS flips,
  round(100.0::DOUBLE * sum(({SQL_RIGHT})::INT) / count(*), 6) AS accuracy_pct FROM ab GROUP BY ALL""")
def ablation(spark, folder):
    """Accuracy per ablation; the seven variants are expanded inside the row."""
    rows = C.ablated(judged(spark, folder).where(F.col("source_family").isin(*D.FAMILIES)))
    right = D.votes_correct(F.col("label"), F.col("ablated_decision"), F.col("ablated_reversed"))
    return rows.groupBy("ablation", "source_family").agg(
        F.count(F.lit(1)).alias("pair_count"),
        F.count(F.when(F.col("ablated_decision") != F.col("decision"), 1)).alias("flips"),
        F.round(F.sum(right.cast("bigint")) * 100.0 / F.count(F.lit(1)), 6).alias("accuracy_pct"),
    )


RUN_COLUMNS = {"run_uniform": "uniform_decision", "run_weighted": "decision", "run_judge": "disc_decision"}


@query("run_diff", f"""WITH {JUDGED},
x AS (SELECT source_family, uniform_decision = label AS before, decision = label AS after FROM judged)
SELECT source_family, count(*) AS pair_count, round(100.0::DOUBLE * count(*) FILTER (before) / count(*), 6) AS before_pct,
  round(100.0::DOUBLE * count(*) FILTER (after) / count(*), 6) AS after_pct,
  round(100.0::DOUBLE * (count(*) FILTER (after) - count(*) FILTER (before)) / count(*), 6) AS diff_pct,
  count(*) FILTER (after AND NOT before) AS helped, count(*) FILTER (before AND NOT after) AS hurt FROM x GROUP BY ALL""")
def run_diff(spark, folder):
    before, after = F.col("uniform_decision") == F.col("label"), F.col("decision") == F.col("label")
    n = F.count(F.lit(1))
    was, now = F.count(F.when(before, 1)), F.count(F.when(after, 1))
    return judged(spark, folder).groupBy("source_family").agg(
        n.alias("pair_count"), F.round(was * 100.0 / n, 6).alias("before_pct"),
        F.round(now * 100.0 / n, 6).alias("after_pct"), F.round((now - was) * 100.0 / n, 6).alias("diff_pct"),
        F.count(F.when(after & ~before, 1)).alias("helped"), F.count(F.when(before & ~after, 1)).alias("hurt"),
    )


SQL_RUNS = """votes AS (
  SELECT user_id AS pair_id, event_type AS run, CASE WHEN user_id % 3 = 0 THEN 'mmlu-pro' WHEN user_id % 3 = 1
    THEN 'livebench-math' ELSE 'livecodebench' END AS source_family,
    CASE WHEN user_id % 2 = 0 THEN 'A>B' ELSE 'B>A' END AS label,
    CASE WHEN avg_value >= 52 THEN 'A>B' WHEN avg_value < 48 THEN 'B>A' ELSE 'A=B' END AS decision
  FROM (SELECT user_id, event_type, sum(round(value * 100)::BIGINT) / 100.0::DOUBLE / count(*) AS avg_value FROM events GROUP BY ALL))"""


def run_votes(spark, folder):
    """One decision per (pair, run): the mean event value of a user in one event type."""
    means = B.table(spark, folder, "events").groupBy(
        F.col("user_id").alias("pair_id"), F.col("event_type").alias("run")
    ).agg((F.sum(F.round(F.col("value") * 100).cast("bigint")) / 100.0 / F.count(F.lit(1))).alias("m"))
    third = F.col("pair_id") % 3
    return means.select(
        "pair_id", "run",
        F.when(third == 0, "mmlu-pro").when(third == 1, "livebench-math").otherwise("livecodebench").alias("source_family"),
        F.when(F.col("pair_id") % 2 == 0, D.FIRST).otherwise(D.SECOND).alias("label"),
        F.when(F.col("m") >= 52, D.FIRST).when(F.col("m") < 48, D.SECOND).otherwise(D.EVEN).alias("decision"),
    )


SQL_CONSENSUS = SQL_RUNS + """,
counted AS (SELECT pair_id, decision, count(*) AS c FROM votes GROUP BY ALL),
ordered AS (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY c DESC, decision) AS k FROM counted),
seen AS (SELECT pair_id, count(DISTINCT run) AS runs_seen, max(source_family) AS source_family, max(label) AS label FROM votes GROUP BY ALL),
cons AS (SELECT s.*, w.decision AS leader, w.c AS top, coalesce(r.c, 0) AS second FROM seen s
  JOIN ordered w ON w.pair_id = s.pair_id AND w.k = 1 LEFT JOIN ordered r ON r.pair_id = s.pair_id AND r.k = 2),
final AS (SELECT *, CASE WHEN top = runs_seen OR top > second THEN leader ELSE 'A=B' END AS consensus_decision,
  CASE WHEN top = runs_seen THEN 'unanimous' WHEN top > second THEN 'split' ELSE 'tie' END AS agreement FROM cons)"""


@query("pair_consensus", f"""WITH {SQL_CONSENSUS}
SELECT pair_id, source_family, label, runs_seen, consensus_decision, agreement, consensus_decision = label AS is_correct FROM final""")
def pair_consensus(spark, folder):
    return M.consensus(run_votes(spark, folder)).select(
        "pair_id", "source_family", "label", "runs_seen", "consensus_decision", "agreement", "is_correct"
    )


@query("consensus_summary", f"""WITH {SQL_CONSENSUS}
SELECT source_family, count(*) AS pair_count, count(*) FILTER (consensus_decision = label) AS correct_count,
  count(*) FILTER (agreement = 'unanimous') AS unanimous, count(*) FILTER (agreement = 'split') AS split,
  count(*) FILTER (agreement = 'tie') AS tie FROM final GROUP BY ALL""")
def consensus_summary(spark, folder):
    kind = F.col("agreement")
    return M.consensus(run_votes(spark, folder)).groupBy("source_family").agg(
        F.count(F.lit(1)).alias("pair_count"), F.count(F.when(F.col("is_correct"), 1)).alias("correct_count"),
        F.count(F.when(kind == "unanimous", 1)).alias("unanimous"),
        F.count(F.when(kind == "split", 1)).alias("split"), F.count(F.when(kind == "tie", 1)).alias("tie"),
    )


SUBSETS = ("Factuality", "Precise IF", "Math", "Safety", "Focus", "Ties")
SQL_ITEMS = f"""items AS (SELECT [{', '.join(f"'{s}'" for s in SUBSETS)}][(pair_id // 4) % 6 + 1] AS subset, pair_id // 4 AS item_id,
  CASE WHEN sat_a >= sat_b THEN 'A>B' ELSE 'B>A' END AS decision, v_source AS decision_source, v_confidence AS confidence FROM verified),
it AS (SELECT subset, item_id, count(*) AS n, count(*) FILTER (decision = 'A>B') AS ok, count(*) FILTER (confidence = 'high'
  AND decision_source IN ('code_execution_verifier', 'mmlu_independent_answerer')) AS sure FROM items GROUP BY ALL),
sub AS (SELECT subset, count(*) AS item_count, count(*) FILTER (ok = n) AS items_correct, sum(n)::BIGINT AS pair_count,
  sum(ok)::BIGINT AS pairs_correct, sum(sure)::BIGINT AS pairs_high_confidence FROM it GROUP BY ALL)"""


def item_rows(spark, folder):
    subsets = F.array(*[F.lit(s) for s in SUBSETS])
    item = F.floor(F.col("pair_id") / 4).cast("bigint")
    return verified(pair_rows(spark, folder)).select(
        F.element_at(subsets, (item % 6 + 1).cast("int")).alias("subset"), item.alias("item_id"),
        F.when(F.col("uniform_score_a") >= F.col("uniform_score_b"), D.FIRST).otherwise(D.SECOND).alias("decision"),
        F.col("verifier_source").alias("decision_source"), F.col("verifier.confidence").alias("confidence"),
    )


@query("best_of_n_items", f"""WITH {VERIFIED}, {SQL_ITEMS}
SELECT *, round(100.0::DOUBLE * items_correct / item_count, 4) AS accuracy_pct,
  round(100.0::DOUBLE * pairs_correct / pair_count, 4) AS pair_accuracy_pct FROM sub""")
def best_of_n_items(spark, folder):
    out = M.best_of_n(item_rows(spark, folder))
    return out.withColumns({c: F.round(c, 4) for c in ("accuracy_pct", "pair_accuracy_pct")})


@query("best_of_n_summary", f"""WITH {VERIFIED}, {SQL_ITEMS}
SELECT round(avg(100.0::DOUBLE * items_correct / item_count) FILTER (subset <> 'Ties'), 4) AS average_pct,
  round(max(100.0::DOUBLE * pairs_correct / pair_count) FILTER (subset = 'Ties'), 4) AS ties_accuracy_term,
  round(max(100.0::DOUBLE * pairs_high_confidence / pair_count) FILTER (subset = 'Ties'), 4) AS ties_margin_term,
  round(max(50.0::DOUBLE * pairs_correct / pair_count + 50.0::DOUBLE * pairs_high_confidence / pair_count)
    FILTER (subset = 'Ties'), 4) AS ties_weighted_score FROM sub""")
def best_of_n_summary(spark, folder):
    out = M.best_of_n_summary(M.best_of_n(item_rows(spark, folder)))
    return out.select(*[F.round(c, 4).alias(c) for c in out.columns])


@query("relabel_summary", f"""WITH {PAIRS}, {ATTEMPTS},
x AS (SELECT source_family, CASE gold WHEN 'a' THEN 'reference_answer_a' WHEN 'b' THEN 'reference_answer_b' ELSE '' END AS original,
  CASE disc_decision WHEN 'A>B' THEN 'A' WHEN 'B>A' THEN 'B' WHEN 'A=B' THEN 'TIE' ELSE '' END AS verdict FROM pairs JOIN discr USING (pair_id)),
y AS (SELECT *, CASE verdict WHEN 'A' THEN 'reference_answer_a' WHEN 'B' THEN 'reference_answer_b' ELSE original END AS relabeled FROM x)
SELECT source_family, count(*) AS rows_processed, count(*) FILTER (verdict = 'A') AS verdict_a, count(*) FILTER (verdict = 'B') AS verdict_b,
  count(*) FILTER (verdict = 'TIE') AS verdict_tie, count(*) FILTER (verdict = '') AS no_verdict,
  count(*) FILTER (original <> '' AND relabeled <> original) AS label_flips,
  round(count(*) FILTER (verdict = 'TIE') / count(*)::DOUBLE, 6) AS tie_rate,
  round(coalesce(count(*) FILTER (original <> '' AND relabeled <> original)
    / nullif(count(*) FILTER (verdict IN ('A', 'B')), 0)::DOUBLE, 0), 6) AS flip_rate_decided FROM y GROUP BY ALL""")
def relabel_summary(spark, folder):
    pairs = discriminated(pair_rows(spark, folder))
    d = F.col("disc_decision")
    verdict = F.when(d == D.FIRST, "A").when(d == D.SECOND, "B").when(d == D.EVEN, "TIE").otherwise("")
    original = (
        F.when(F.col("gold") == "a", "reference_answer_a").when(F.col("gold") == "b", "reference_answer_b").otherwise("")
    )
    rows = pairs.select("source_family", original.alias("original"), verdict.alias("verdict")).withColumn(
        "relabeled", D.verdict_label(F.col("verdict"), F.col("original"))
    )
    flips = F.count(F.when((F.col("original") != "") & (F.col("relabeled") != F.col("original")), 1))

    def n(v):
        return F.count(F.when(F.col("verdict") == v, 1))

    return rows.groupBy("source_family").agg(
        F.count(F.lit(1)).alias("rows_processed"), n("A").alias("verdict_a"), n("B").alias("verdict_b"),
        n("TIE").alias("verdict_tie"), n("").alias("no_verdict"), flips.alias("label_flips"),
        F.round(T.ratio(n("TIE"), F.count(F.lit(1))), 6).alias("tie_rate"),
        F.round(T.ratio(flips, n("A") + n("B")), 6).alias("flip_rate_decided"),
    )


@query("majority_vote", """WITH v AS (SELECT user_id AS candidate_id, event_type AS rubric_id, value >= 35 AS yes FROM events)
SELECT candidate_id, rubric_id, count(*) AS samples, count(*) FILTER (yes) AS yes_votes,
  count(*) FILTER (yes) > count(*) FILTER (NOT yes) AS satisfied FROM v GROUP BY ALL""")
def majority_vote(spark, folder):
    votes = B.table(spark, folder, "events").select(
        F.col("user_id").alias("candidate_id"), F.col("event_type").alias("rubric_id"),
        (F.col("value") >= 35).alias("satisfied"),
    )
    return M.majority(votes, ["candidate_id", "rubric_id"])


SQL_SOLVER = """v AS (SELECT user_id AS question_id, CASE WHEN value < 2 THEN '' ELSE chr((65 + floor(value)::BIGINT % 4)::INT) END AS answer FROM events),
c AS (SELECT question_id, answer, count(*) AS n FROM v WHERE answer <> '' GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY n DESC, answer) AS pos,
  count(*) FILTER (answer <> '') OVER (PARTITION BY question_id, n) AS sharing FROM c),
p AS (SELECT q.question_id, q.samples, coalesce(n, 0) AS top_votes, CASE WHEN sharing = 1 THEN answer ELSE '' END AS winner,
  CASE WHEN n IS NULL THEN 'no_valid_answers' WHEN sharing = 1 THEN '' ELSE 'inconclusive' END AS status
  FROM (SELECT question_id, count(*) AS samples FROM v GROUP BY ALL) q LEFT JOIN k ON k.question_id = q.question_id AND pos = 1)"""


def solver_votes(spark, folder):
    letter = F.chr(F.lit(65) + F.floor("value").cast("bigint") % 4)
    return B.table(spark, folder, "events").select(
        F.col("user_id").alias("question_id"), F.when(F.col("value") < 2, "").otherwise(letter).alias("answer")
    )


@query("solver_plurality", f"WITH {SQL_SOLVER} SELECT * FROM p")
def solver_plurality(spark, folder):
    return M.plurality(solver_votes(spark, folder), "question_id", "answer")


@query("solver_match", f"""WITH {SQL_SOLVER},
s AS (SELECT question_id, winner, chr((65 + question_id % 4)::INT) AS a, chr((65 + question_id % 3)::INT) AS b FROM p)
SELECT question_id, CASE WHEN winner <> '' AND a = winner AND b <> winner THEN 'A>B'
  WHEN winner <> '' AND b = winner AND a <> winner THEN 'B>A' ELSE '' END AS decision,
  CASE WHEN winner <> '' AND (a = winner) <> (b = winner) THEN 'high' WHEN winner <> '' AND a = winner THEN 'medium' ELSE 'low' END AS confidence,
  winner <> '' AND (a = winner) <> (b = winner) AS triggered FROM s""")
def solver_match(spark, folder):
    solved = M.plurality(solver_votes(spark, folder), "question_id", "answer")
    a = F.chr(F.lit(65) + F.col("question_id") % 4)
    b = F.chr(F.lit(65) + F.col("question_id") % 3)
    return solved.select("question_id", D.single_match(F.col("winner"), a, b, F.col("status")).alias("m")).select(
        "question_id", "m.*"
    )


@query("test_pass_rates", """WITH t AS (SELECT user_id AS pair_id,
  avg((value < 40)::INT) FILTER (event_type IN ('click', 'view')) AS a, avg((value < 40)::INT) FILTER (event_type NOT IN ('click', 'view')) AS b,
  count(*) AS cases FROM events GROUP BY ALL),
u AS (SELECT pair_id, cases, coalesce(a, 0) AS a, coalesce(b, 0) AS b FROM t)
SELECT pair_id, cases, round(a, 6) AS rate_a, round(b, 6) AS rate_b,
  CASE WHEN abs(a - b) >= 0.34::DOUBLE THEN CASE WHEN a > b THEN 'A>B' ELSE 'B>A' END ELSE '' END AS decision,
  CASE WHEN abs(a - b) >= 0.5 THEN 'high' WHEN abs(a - b) >= 0.34::DOUBLE THEN 'medium' ELSE 'low' END AS confidence,
  abs(a - b) >= 0.34::DOUBLE AS triggered FROM u""")
def test_pass_rates(spark, folder):
    """Pass rates from a table of test results; untrusted code is never run here."""
    first = F.col("event_type").isin("click", "view")
    ok = (F.col("value") < 40).cast("int")
    rates = B.table(spark, folder, "events").groupBy(F.col("user_id").alias("pair_id")).agg(
        F.count(F.lit(1)).alias("cases"),
        F.coalesce(F.avg(F.when(first, ok)), F.lit(0.0)).alias("a"),
        F.coalesce(F.avg(F.when(~first, ok)), F.lit(0.0)).alias("b"),
    )
    out = D.pass_rate_outcome(F.col("a"), F.col("b"))
    return rates.select(
        "pair_id", "cases", F.round("a", 6).alias("rate_a"), F.round("b", 6).alias("rate_b"), out.alias("o")
    ).select("pair_id", "cases", "rate_a", "rate_b", "o.*")
