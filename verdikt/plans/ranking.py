"""Candidate scoring, ranking and report queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from verdikt.functions import text as T
from verdikt.operators import reports as R
from verdikt.operators import running as RT
from verdikt.operators import scoring as S
from verdikt.plans import base as B
from verdikt.plans.registry import query
from verdikt.session import durable

SCORED = B.CANDS + f""",
scored AS (
  SELECT 'uniform' AS method, candidate_id, example_id, family, quality_bucket, satisfied_count,
         satisfied_count / {B.RULE_COUNT}.0::DOUBLE AS score FROM cands
  UNION ALL
  SELECT 'adjusted', candidate_id, example_id, family, quality_bucket, satisfied_count,
         adjusted_points / {B.ADJUSTED_TOTAL}.0::DOUBLE FROM cands),
ranking AS (
  SELECT *, {B.SQL_LABEL} AS source_label, {B.SQL_ORIGIN} AS origin_kind,
    row_number() OVER (PARTITION BY method, example_id
      ORDER BY score DESC, satisfied_count DESC, candidate_id) AS rank
  FROM scored)"""


def scored(spark, folder):
    """Both weightings of every candidate as long rows (method, candidate)."""
    cands = B.candidates(spark, folder).select(
        "candidate_id", "example_id", "family", "quality_bucket", "satisfied_count", "adjusted_points"
    )
    methods = F.array(
        F.struct(F.lit("uniform").alias("method"),
                 (F.col("satisfied_count") / F.lit(float(B.RULE_COUNT))).alias("score")),
        F.struct(F.lit("adjusted").alias("method"),
                 (F.col("adjusted_points") / F.lit(float(B.ADJUSTED_TOTAL))).alias("score")),
    )
    return cands.select("*", F.inline(methods)).drop("adjusted_points")


def ranking(spark, folder):
    """Ranked candidates; reports that read them twice pin the narrow table first,
    so the texts are scanned and matched once."""
    out = S.rank_candidates(scored(spark, folder), ["method", "example_id"], at_most=B.row_bound(spark, folder))
    return out.withColumn("source_label", B.source_label()).withColumn("origin_kind", B.origin())


@query("rank_uniform", f"""WITH {B.CANDS}
SELECT example_id, candidate_id, satisfied_count, {B.RULE_COUNT}::BIGINT AS rubric_count,
  round(satisfied_count / {B.RULE_COUNT}.0::DOUBLE, 6) AS score,
  row_number() OVER (PARTITION BY example_id ORDER BY satisfied_count DESC, candidate_id) AS rank
FROM cands""")
def rank_uniform(spark, folder):
    """Facts x uniform weights -> scores -> distinct ranks."""
    cands = B.candidates(spark, folder, labels=False).select("candidate_id", "example_id", "satisfied_count")
    scores = cands.withColumn("score", F.col("satisfied_count") * F.lit(1.0) / F.lit(float(B.RULE_COUNT)))
    return S.rank_candidates(scores, at_most=B.row_bound(spark, folder)).select(
        "example_id", "candidate_id", "satisfied_count",
        F.lit(B.RULE_COUNT).cast("bigint").alias("rubric_count"),
        F.round("score", 6).alias("score"), "rank",
    )


@query("score_from_facts", f"""WITH {B.EVALS}
SELECT example_id, candidate_id, sum(sat)::BIGINT AS satisfied_count,
  round(sum(sat) / {B.RULE_COUNT}.0::DOUBLE, 6) AS score
FROM evals GROUP BY ALL""")
def score_from_facts(spark, folder):
    """The general fact-table route: facts joined to per-example uniform weights."""
    evals = B.evaluations(B.candidates(spark, folder, labels=False)).select(
        "example_id", "candidate_id", "rubric_id", "satisfied"
    )
    weights = S.uniform_weights(evals.select("example_id", "rubric_id").distinct())
    return S.score_candidates(evals, weights).select(
        "example_id", "candidate_id", "satisfied_count", F.round("score", 6).alias("score")
    )


@query("rubric_coverage_discrimination", f"""WITH {B.EVALS},
c AS (SELECT example_id, rubric_id, count(*) AS total, sum(sat)::BIGINT AS coverage_count FROM evals GROUP BY ALL)
SELECT example_id, rubric_id, total, coverage_count,
  round(coverage_count / total::DOUBLE, 6) AS p,
  round((coverage_count / total::DOUBLE) * (1 - coverage_count / total::DOUBLE), 6) AS pq FROM c""")
def rubric_coverage_discrimination(spark, folder):
    evals = B.evaluations(B.candidates(spark, folder, labels=False))
    return S.rubric_coverage(evals).select(
        "example_id", "rubric_id", "total", "coverage_count",
        F.round("p", 6).alias("p"), F.round("pq", 6).alias("pq"),
    )


@query("satisfied_sets", f"""WITH {B.EVALS}
SELECT example_id, rubric_id, candidate_id FROM evals WHERE sat = 1""")
def satisfied_sets(spark, folder):
    """Satisfying candidates per rubric, as rows: a set column could not hold a hot rubric."""
    evals = B.evaluations(B.candidates(spark, folder, labels=False))
    return evals.where("satisfied").select("example_id", "rubric_id", "candidate_id")


DISCRIMINATION = 0.15


@query("discrimination_filter", f"""WITH {B.EVALS},
c AS (SELECT example_id, rubric_id, count(*) AS total, sum(sat) / count(*)::DOUBLE AS p FROM evals GROUP BY ALL),
k AS (SELECT *, (p * (1 - p) >= {DISCRIMINATION}::DOUBLE OR total < 2) AS passing FROM c)
SELECT example_id, rubric_id, passing OR NOT bool_or(passing) OVER (PARTITION BY example_id) AS kept FROM k""")
def discrimination_filter(spark, folder):
    evals = B.evaluations(B.candidates(spark, folder, labels=False))
    return S.discrimination_filter(evals, DISCRIMINATION).select("example_id", "rubric_id", "kept")


@query("misalignment_filter", f"""WITH {B.EVALS},
m AS (SELECT example_id, rubric_id,
  avg(sat) FILTER (quality_bucket IN ('gold_like','strong_anchor')) AS s,
  avg(sat) FILTER (quality_bucket = 'synthetically_degraded') AS w FROM evals GROUP BY ALL)
SELECT example_id, rubric_id,
  round(CASE WHEN s IS NULL OR w IS NULL THEN 0 ELSE s END::DOUBLE, 6) AS strong_mean,
  round(CASE WHEN s IS NULL OR w IS NULL THEN 0 ELSE w END::DOUBLE, 6) AS weak_mean,
  coalesce(w > s + 0.05::DOUBLE, false) AS misaligned FROM m""")
def misalignment_filter(spark, folder):
    evals = B.evaluations(B.candidates(spark, folder))
    return S.misalignment(evals).select(
        "example_id", "rubric_id", F.round("strong_mean", 6).alias("strong_mean"),
        F.round("weak_mean", 6).alias("weak_mean"), "misaligned",
    )


SQL_SVW = f"""svw AS (
  SELECT s.method, s.example_id, count(*) AS total, sum((s.rank < w.rank)::INT)::BIGINT AS correct,
    avg(s.score - w.score) AS margin
  FROM ranking s JOIN ranking w USING (method, example_id)
  WHERE s.quality_bucket IN {B.SQL_STRONG} AND w.quality_bucket = 'synthetically_degraded'
  GROUP BY ALL)"""


@query("strong_vs_weak", f"""WITH {SCORED}, {SQL_SVW}
SELECT method, e.example_id, coalesce(total, 0) AS total, coalesce(correct, 0) AS correct,
  round(coalesce(margin, 0), 6) AS margin
FROM (SELECT DISTINCT method, example_id FROM ranking
      WHERE quality_bucket IN {B.SQL_STRONG} OR quality_bucket = 'synthetically_degraded') e
LEFT JOIN svw USING (method, example_id)""")
def strong_vs_weak(spark, folder):
    out = R.strong_vs_weak(ranking(spark, folder), ["method", "example_id"], at_most=B.row_bound(spark, folder))
    return out.select("method", "example_id", "total", "correct", F.round("margin", 6).alias("margin"))


@query("reference_top1", f"""WITH {SCORED}
SELECT method, example_id, bool_or(source_label = 'reference_note') AS has_reference,
  bool_or(source_label = 'reference_note' AND rank = 1) AS reference_top1
FROM ranking GROUP BY ALL""")
def reference_top1(spark, folder):
    return R.reference_top1(ranking(spark, folder), ["method", "example_id"])


@query("method_metrics", f"""WITH {SCORED}, {SQL_SVW},
top AS (SELECT method, example_id, bool_or(source_label = 'reference_note') AS has_ref,
  bool_or(source_label = 'reference_note' AND rank = 1) AS hit FROM ranking GROUP BY ALL),
e AS (SELECT top.*, coalesce(total, 0) AS total, coalesce(correct, 0) AS correct, coalesce(margin, 0) AS margin
  FROM top LEFT JOIN svw USING (method, example_id))
SELECT method, count(*) AS examples,
  round(coalesce(sum(hit::INT) / nullif(sum(has_ref::INT), 0)::DOUBLE, 0), 6) AS reference_top1_rate,
  round(coalesce(sum(correct) / nullif(sum(total), 0)::DOUBLE, 0), 6) AS strong_vs_weak_accuracy,
  round(sum(margin) / count(*), 6) AS mean_strong_weak_margin,
  {B.RULE_COUNT}::DOUBLE AS avg_rubric_count
FROM e GROUP BY method""")
def method_metrics(spark, folder):
    """Per method: micro accuracies, and the mean over examples of per-example margins."""
    keys = ["method", "example_id"]
    ranks = durable(ranking(spark, folder))
    per_example = R.reference_top1(ranks, keys).join(R.strong_vs_weak(ranks, keys, at_most=B.row_bound(spark, folder)), keys, "left")
    return per_example.groupBy("method").agg(
        F.count(F.lit(1)).alias("examples"),
        F.sum(F.col("has_reference").cast("bigint")).alias("refs"),
        F.sum(F.col("reference_top1").cast("bigint")).alias("hits"),
        F.sum(F.coalesce("total", F.lit(0))).alias("total"),
        F.sum(F.coalesce("correct", F.lit(0))).alias("correct"),
        F.sum(F.coalesce("margin", F.lit(0.0))).alias("margin"),
    ).select(
        "method", "examples",
        F.round(T.ratio(F.col("hits"), F.col("refs")), 6).alias("reference_top1_rate"),
        F.round(T.ratio(F.col("correct"), F.col("total")), 6).alias("strong_vs_weak_accuracy"),
        F.round(T.ratio(F.col("margin"), F.col("examples")), 6).alias("mean_strong_weak_margin"),
        F.lit(float(B.RULE_COUNT)).alias("avg_rubric_count"),
    )


SQL_ANCHOR = """anchor AS (
  SELECT method, example_id, candidate_id AS anchor_id, score AS anchor_score FROM ranking
  WHERE source_label IN ('reference_note', 'augmented_note')
  QUALIFY row_number() OVER (PARTITION BY method, example_id
    ORDER BY (source_label = 'augmented_note')::INT, candidate_id) = 1),
prefs AS (
  SELECT method, example_id, count(*) AS pair_count, sum((anchor_score > score)::INT)::BIGINT AS correct,
    avg(anchor_score - score) AS mean_margin
  FROM ranking JOIN anchor USING (method, example_id) WHERE candidate_id <> anchor_id GROUP BY ALL)"""


@query("anchor_preferences", f"""WITH {SCORED}, {SQL_ANCHOR}
SELECT method, example_id, pair_count, round(correct / pair_count::DOUBLE, 6) AS pairwise_accuracy,
  round(mean_margin, 6) AS mean_margin FROM prefs""")
def anchor_preferences(spark, folder):
    out = R.anchor_preferences(durable(ranking(spark, folder)), ["method", "example_id"])
    return out.select(
        "method", "example_id", "pair_count",
        F.round(T.ratio(F.col("correct"), F.col("pair_count")), 6).alias("pairwise_accuracy"),
        F.round(T.ratio(F.col("margin_sum"), F.col("pair_count")), 6).alias("mean_margin"),
    )


@query("preference_macro", f"""WITH {SCORED}, {SQL_ANCHOR},
x AS (SELECT r.method, r.example_id, coalesce(max(pair_count), 0) AS pair_count,
  coalesce(max(correct / pair_count::DOUBLE), 0) AS acc, coalesce(max(mean_margin), 0) AS margin
  FROM ranking r LEFT JOIN prefs USING (method, example_id) GROUP BY ALL)
SELECT method, count(*) AS examples, sum(pair_count)::BIGINT AS pair_count, round(avg(acc), 6) AS avg_pairwise_accuracy,
  round(avg(margin), 6) AS avg_mean_margin FROM x GROUP BY method""")
def preference_macro(spark, folder):
    """Macro mean over examples; an example without pairs counts with zero."""
    keys = ["method", "example_id"]
    ranks = durable(ranking(spark, folder))
    per = ranks.select(*keys).distinct().join(R.anchor_preferences(ranks, keys), keys, "left")
    zero = F.lit(0)
    return per.groupBy("method").agg(
        F.count(F.lit(1)).alias("examples"),
        F.sum(F.coalesce("pair_count", zero)).alias("pair_count"),
        F.round(F.avg(F.coalesce(T.ratio(F.col("correct"), F.col("pair_count")), zero)), 6)
        .alias("avg_pairwise_accuracy"),
        F.round(F.avg(F.coalesce(T.ratio(F.col("margin_sum"), F.col("pair_count")), zero)), 6)
        .alias("avg_mean_margin"),
    )


@query("generated_pair_preferences", f"""WITH {SCORED},
g AS (SELECT * FROM ranking WHERE origin_kind = 'generated' AND method = 'uniform')
SELECT e.example_id, count(b.candidate_id) AS pair_count,
  round(coalesce(avg((a.score > b.score)::INT), 0), 6) AS pairwise_accuracy,
  round(coalesce(avg(a.score - b.score), 0), 6) AS mean_margin
FROM (SELECT DISTINCT example_id FROM g) e
LEFT JOIN (g a JOIN g b ON a.example_id = b.example_id AND a.candidate_id < b.candidate_id)
  ON a.example_id = e.example_id
GROUP BY e.example_id""")
def generated_pair_preferences(spark, folder):
    """All unordered pairs of generated candidates, earlier side as default label."""
    cands = B.candidates(spark, folder).where(B.origin() == "generated").select(
        "example_id", "candidate_id",
        (F.col("satisfied_count") / F.lit(float(B.RULE_COUNT))).alias("score"),
    )
    levels = [i / float(B.RULE_COUNT) for i in range(B.RULE_COUNT + 1)]
    out = R.earlier_preferred(cands, ["example_id"], levels, at_most=B.row_bound(spark, folder))
    return out.select(
        "example_id", "pair_count", F.round("pairwise_accuracy", 6).alias("pairwise_accuracy"),
        F.round("mean_margin", 6).alias("mean_margin"),
    )


@query("flatten_rankings", f"""WITH {SCORED}
SELECT example_id, family, method, candidate_id, source_label, quality_bucket, rank, round(score, 6) AS score
FROM ranking""")
def flatten_rankings(spark, folder):
    return ranking(spark, folder).select(
        "example_id", "family", "method", "candidate_id", "source_label", "quality_bucket", "rank",
        F.round("score", 6).alias("score"),
    )


@query("gold_rank_histogram", f"""WITH {SCORED},
best AS (SELECT method, example_id, min(rank) AS rank FROM ranking
  WHERE source_label = 'reference_note' GROUP BY ALL)
SELECT method, rank, count(*) AS examples FROM best GROUP BY ALL""")
def gold_rank_histogram(spark, folder):
    best = (
        ranking(spark, folder).where(F.col("source_label") == "reference_note")
        .groupBy("method", "example_id").agg(F.min("rank").alias("rank"))
    )
    return best.groupBy("method", "rank").agg(F.count(F.lit(1)).alias("examples"))


@query("weight_adjust", f"""WITH {B.EVALS},
kinds(rubric_id, kind) AS (VALUES {', '.join(f"('{r.rubric_id}', '{r.kind}')" for r in B.RULES)}),
bank AS (SELECT example_id, rubric_id, any_value(kind) AS kind FROM evals JOIN kinds USING (rubric_id) GROUP BY ALL),
w AS (SELECT *, 1.0::DOUBLE / count(*) OVER (PARTITION BY example_id) AS weight FROM bank),
raw AS (SELECT *, weight * CASE kind WHEN 'correctness' THEN 3.0 WHEN 'format' THEN 0.35
  WHEN 'style' THEN 0.15 WHEN 'proxy' THEN 0.35 ELSE 1.0 END::DOUBLE AS r FROM w)
SELECT example_id, rubric_id, round(weight, 6) AS weight,
  round(r / sum(r) OVER (PARTITION BY example_id), 6) AS adjusted_weight FROM raw""")
def weight_adjust(spark, folder):
    kinds = F.array(*[F.struct(F.lit(r.rubric_id).alias("rubric_id"), F.lit(r.kind).alias("kind")) for r in B.RULES])
    examples = B.table(spark, folder, "documents").select(F.col("source").alias("example_id")).distinct()
    bank = S.uniform_weights(examples.select("example_id", F.inline(kinds)))
    tagged = bank.select(
        "example_id", "rubric_id", "weight",
        F.when(F.col("kind").isin("correctness", "format"), F.col("kind")).otherwise("").alias("exact_kind"),
        (F.col("kind") == "style").alias("style"), (F.col("kind") == "proxy").alias("proxy"),
        F.lit(True).alias("exact_task"), F.lit(True).alias("code_task"),
    )
    return S.adjusted_weights(tagged).select(
        "example_id", "rubric_id", F.round("weight", 6).alias("weight"),
        F.round("adjusted_weight", 6).alias("adjusted_weight"),
    )


@query("whitened_rank")
def whitened_rank(spark, folder):
    """Covariance-whitened weights from one aggregate pass, then scores and ranks."""
    cands = durable(B.candidates(spark, folder, labels=False))
    weights = S.whitened_weights(S.gram(cands, B.RULE_IDS), B.RULE_IDS)
    per_example = weights.groupBy("example_id").agg(
        F.map_from_entries(F.collect_list(F.struct("rubric_id", "weight"))).alias("w")
    )
    scores = cands.join(per_example, "example_id").select(
        "example_id", "candidate_id", "satisfied_count",
        F.round(B.total([F.col(r) * F.col("w")[r] for r in B.RULE_IDS]), 12).alias("score"),
    )
    return S.rank_candidates(scores, at_most=B.row_bound(spark, folder)).withColumn("score", F.round("score", 6))


@query("whitened_two_rubrics", f"""WITH {B.CANDS},
g AS (SELECT example_id, count(*)::DOUBLE AS n, sum(r02)::DOUBLE AS sa, sum(r06)::DOUBLE AS sb,
  sum(r02 * r06)::DOUBLE AS sab FROM cands GROUP BY ALL),
m AS (SELECT example_id, sa / n - (sa / n) * (sa / n) + 0.001::DOUBLE AS a, sab / n - (sa / n) * (sb / n) AS b,
  sb / n - (sb / n) * (sb / n) + 0.001::DOUBLE AS c FROM g),
s AS (SELECT *, sqrt(a * c - b * b) AS root FROM m),
w AS (SELECT *, greatest(c + root - b, 0) AS x, greatest(a + root - b, 0) AS y FROM s)
SELECT example_id, round(CASE WHEN x + y <= 0 THEN 0.5 ELSE x / (x + y) END, 6) AS weight_a,
  round(CASE WHEN x + y <= 0 THEN 0.5 ELSE y / (x + y) END, 6) AS weight_b FROM w""")
def whitened_two_rubrics(spark, folder):
    grams = S.gram(B.candidates(spark, folder, labels=False), ["r02", "r06"])
    return S.two_rubric_whitening(grams).select(
        "example_id", F.round("weight_a", 6).alias("weight_a"), F.round("weight_b", 6).alias("weight_b")
    )


@query("evaluation_matrix", f"""WITH {B.CANDS}
SELECT example_id, candidate_id, {', '.join(B.RULE_IDS)} FROM cands""")
def evaluation_matrix(spark, folder):
    """Facts pivoted back to one 0/1 row per candidate; a missing fact is 0."""
    evals = B.evaluations(B.candidates(spark, folder, labels=False)).where("satisfied")
    cells = [
        F.max((F.col("rubric_id") == r).cast("int")).alias(r) for r in B.RULE_IDS
    ]
    hit = evals.groupBy("candidate_id").agg(*cells)
    docs = B.table(spark, folder, "documents").select(
        F.col("source").alias("example_id"), F.col("doc_id").alias("candidate_id")
    )
    return docs.join(hit, "candidate_id", "left").select(
        "example_id", "candidate_id", *[F.coalesce(F.col(r), F.lit(0)).alias(r) for r in B.RULE_IDS]
    )


QUANTILES = (0.10, 0.25, 0.50, 0.75, 0.90, 0.99)


@query("quantile_report", f"""SELECT lang AS family, count(*) AS n,
{', '.join(f"round(quantile_cont(length(text), {q}), 4) AS p{round(q * 100)}" for q in QUANTILES)}
FROM documents GROUP BY lang""")
def quantile_report(spark, folder):
    docs = B.table(spark, folder, "documents").select(
        F.col("lang").alias("family"), F.length("text").cast("bigint").alias("chars")
    )
    out = RT.exact_quantiles(docs, ["family"], "chars", QUANTILES)
    cols = [F.round(f"p{round(q * 100)}", 4).alias(f"p{round(q * 100)}") for q in QUANTILES]
    return out.select("family", "n", *cols)


@query("discrimination_bands", f"""WITH {B.EVALS},
c AS (SELECT example_id, family, rubric_id, sum(sat) / count(*)::DOUBLE AS p FROM evals GROUP BY ALL)
SELECT family, CASE WHEN p * (1 - p) < 0.05::DOUBLE THEN 'useless' WHEN p * (1 - p) < 0.15::DOUBLE THEN 'weak'
  ELSE 'strong' END AS band, count(*) AS rubrics, round(avg(p), 6) AS mean_fire_rate FROM c GROUP BY ALL""")
def discrimination_bands(spark, folder):
    evals = B.evaluations(B.candidates(spark, folder, labels=False))
    stats = S.rubric_coverage(evals, ["example_id", "family", "rubric_id"])
    band = F.when(F.col("pq") < 0.05, "useless").when(F.col("pq") < 0.15, "weak").otherwise("strong")
    return stats.groupBy("family", band.alias("band")).agg(
        F.count(F.lit(1)).alias("rubrics"), F.round(F.avg("p"), 6).alias("mean_fire_rate")
    )


@query("pool_origin_gap", f"""WITH {B.CANDS},
o AS (SELECT example_id, {B.SQL_ORIGIN} AS origin_kind, satisfied_count / {B.RULE_COUNT}.0::DOUBLE AS rate FROM cands),
m AS (SELECT example_id, count(*) AS total,
  count(*) FILTER (origin_kind = 'anchor') AS anchors, count(*) FILTER (origin_kind = 'generated') AS generated,
  count(*) FILTER (origin_kind = 'synthetic') AS synthetic,
  avg(rate) FILTER (origin_kind = 'anchor') AS a, avg(rate) FILTER (origin_kind = 'generated') AS g FROM o GROUP BY ALL)
SELECT example_id, total, anchors, generated, synthetic, round(a, 6) AS anchor_mean, round(g, 6) AS generated_mean,
  round(a - g, 6) AS anchor_minus_generated FROM m""")
def pool_origin_gap(spark, folder):
    """Pool composition and anchor-minus-generated satisfaction per example."""
    kind, rate = F.col("origin_kind"), F.col("satisfied_count") / F.lit(float(B.RULE_COUNT))
    cands = B.candidates(spark, folder).withColumn("origin_kind", B.origin())
    m = cands.groupBy("example_id").agg(
        F.count(F.lit(1)).alias("total"),
        F.count(F.when(kind == "anchor", 1)).alias("anchors"),
        F.count(F.when(kind == "generated", 1)).alias("generated"),
        F.count(F.when(kind == "synthetic", 1)).alias("synthetic"),
        F.avg(F.when(kind == "anchor", rate)).alias("a"),
        F.avg(F.when(kind == "generated", rate)).alias("g"),
    )
    return m.select(
        "example_id", "total", "anchors", "generated", "synthetic", F.round("a", 6).alias("anchor_mean"),
        F.round("g", 6).alias("generated_mean"), F.round(F.col("a") - F.col("g"), 6).alias("anchor_minus_generated"),
    )


STAGE_FIELDS = ("rubric_count", "coverage", "strong_vs_weak_accuracy", "mean_margin")


@query("stage_comparison", f"""WITH {B.EVALS},
c AS (SELECT example_id, rubric_id, count(*) AS total, sum(sat) / count(*)::DOUBLE AS p FROM evals GROUP BY ALL),
k AS (SELECT *, (p * (1 - p) >= {DISCRIMINATION}::DOUBLE OR total < 2) AS passing FROM c),
kept AS (SELECT example_id, rubric_id, passing OR NOT bool_or(passing) OVER (PARTITION BY example_id) AS keep FROM k),
st AS (SELECT e.*, 'one_shot' AS stage FROM evals e UNION ALL
  SELECT e.*, 'refined' FROM evals e JOIN kept USING (example_id, rubric_id) WHERE keep),
sc AS (SELECT stage, example_id, candidate_id, quality_bucket, sum(sat)::BIGINT AS s, count(*) AS n FROM st GROUP BY ALL),
rk AS (SELECT *, s / n::DOUBLE AS score, row_number() OVER (PARTITION BY stage, example_id ORDER BY s DESC, candidate_id) AS rank FROM sc),
pairs AS (SELECT a.stage, a.example_id, avg((a.rank < b.rank)::INT) AS acc, avg(a.score - b.score) AS margin
  FROM rk a JOIN rk b USING (stage, example_id)
  WHERE a.quality_bucket IN {B.SQL_STRONG} AND b.quality_bucket = 'synthetically_degraded' GROUP BY ALL),
per AS (SELECT rk.stage, rk.example_id, max(n) AS rubric_count, avg(score) AS coverage,
  coalesce(max(acc), 0) AS acc, coalesce(max(margin), 0) AS margin
  FROM rk LEFT JOIN pairs USING (stage, example_id) GROUP BY ALL),
t AS (SELECT count(DISTINCT example_id) AS examples,
  {', '.join(f"avg({c}) FILTER (stage = '{s}') AS {s}_{f}" for s in ('one_shot', 'refined')
             for f, c in zip(STAGE_FIELDS, ('rubric_count', 'coverage', 'acc', 'margin')))} FROM per)
SELECT examples, {', '.join(f"round({s}_{f}, 6) AS {s}_{f}" for s in ('one_shot', 'refined') for f in STAGE_FIELDS)},
  {', '.join(f"round(refined_{f} - one_shot_{f}, 6) AS delta_{f}" for f in STAGE_FIELDS)} FROM t""")
def stage_comparison(spark, folder):
    """Full rubric set against the discrimination-filtered one: means and deltas."""
    evals = B.evaluations(durable(B.candidates(spark, folder))).select(
        "example_id", "candidate_id", "quality_bucket", "rubric_id", "satisfied"
    )
    kept = S.discrimination_filter(evals, DISCRIMINATION).where("kept").select("example_id", "rubric_id")
    stages = evals.withColumn("stage", F.lit("one_shot")).unionByName(
        evals.join(kept, ["example_id", "rubric_id"], "left_semi").withColumn("stage", F.lit("refined"))
    )
    keys = ["stage", "example_id"]
    scores = stages.groupBy(*keys, "candidate_id", "quality_bucket").agg(
        F.sum(F.col("satisfied").cast("bigint")).alias("satisfied_count"), F.count(F.lit(1)).alias("n")
    ).withColumn("score", T.ratio(F.col("satisfied_count"), F.col("n")))
    ranks = S.rank_candidates(scores, keys, at_most=B.row_bound(spark, folder))
    per = ranks.groupBy(*keys).agg(F.max("n").alias("rubric_count"), F.avg("score").alias("coverage")).join(
        R.strong_vs_weak(ranks, keys, at_most=B.row_bound(spark, folder)), keys, "left"
    ).select(
        *keys, "rubric_count", "coverage",
        F.coalesce(T.ratio(F.col("correct"), F.col("total")), F.lit(0.0)).alias("strong_vs_weak_accuracy"),
        F.coalesce("margin", F.lit(0.0)).alias("mean_margin"),
    )
    aggs = [F.avg(F.when(F.col("stage") == s, F.col(f))).alias(f"{s}_{f}")
            for s in ("one_shot", "refined") for f in STAGE_FIELDS]
    t = per.agg(F.countDistinct("example_id").alias("examples"), *aggs)
    return t.select(
        "examples",
        *[F.round(f"{s}_{f}", 6).alias(f"{s}_{f}") for s in ("one_shot", "refined") for f in STAGE_FIELDS],
        *[F.round(F.col(f"refined_{f}") - F.col(f"one_shot_{f}"), 6).alias(f"delta_{f}") for f in STAGE_FIELDS],
    )
