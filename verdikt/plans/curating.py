"""Pruning, gating, scheduling, packaging and failure-cluster queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from verdikt.functions import decisions as D
from verdikt.functions import rubrics as X
from verdikt.functions import text as T
from verdikt.operators import curation as U
from verdikt.plans import base as B
from verdikt.plans import pairs as Q
from verdikt.plans.merging import CASE_FAMILY
from verdikt.plans.registry import query
from verdikt.plans.texts import _sql_profiles, _sql_words_any, _truncated, docs
from verdikt.sources import writers

SQL_ROWS = f"""rows AS (SELECT d.doc_id AS row_id, source AS example_id, {CASE_FAMILY} AS family, n_chars AS size, d.doc_id % 5 AS n,
  CASE quality WHEN 1 THEN 3 WHEN 0 THEN 1 ELSE 2 END AS severity, CASE WHEN d.doc_id % 5 <> 0 THEN lang || (n_chars % 3) END AS cluster,
  n_chars % 2 = 0 AS is_broad FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)"""


def canonical_rows(spark, folder):
    rows = docs(spark, folder).select(
        F.col("doc_id").alias("row_id"), F.col("source").alias("example_id"), F.expr(CASE_FAMILY).alias("family"),
        F.col("n_chars").alias("size"), (F.col("doc_id") % 5).alias("n"), (F.col("n_chars") % 2 == 0).alias("is_broad"),
        F.when(F.col("doc_id") % 5 != 0, F.concat("lang", (F.col("n_chars") % 3).cast("string"))).alias("cluster"),
    )
    labels = B.table(spark, folder, "labels").select(F.col("doc_id").alias("row_id"), "quality")
    severity = F.when(F.col("quality") == 1, 3).when(F.col("quality") == 0, 1).otherwise(2)
    return rows.join(labels, "row_id", "left").withColumn("severity", severity).drop("quality")


def priority():
    return [F.col("severity").desc(), F.col("n").desc(), F.col("size").desc(), F.col("row_id").asc()]


@query("cluster_collapse", f"""WITH {SQL_ROWS}
SELECT example_id, row_id, cluster FROM rows QUALIFY row_number() OVER (PARTITION BY example_id, coalesce(cluster, 'row:' || row_id)
  ORDER BY severity DESC, n DESC, size DESC, row_id) = 1""")
def cluster_collapse(spark, folder):
    out = U.collapse_clusters(canonical_rows(spark, folder), ["example_id"], "cluster", priority(), "row_id")
    return out.select("example_id", "row_id", "cluster")


SQL_LIMITS = "lim(family, total, broad) AS (VALUES ('mmlu-pro', 16, 3), ('livebench-reasoning', 14, 2), ('livebench-math', 15, 3), ('livecodebench', 18, 3))"


@query("pruned_rows", f"""WITH {SQL_ROWS}, {SQL_LIMITS},
b AS (SELECT *, row_number() OVER (PARTITION BY example_id, family, is_broad ORDER BY severity DESC, n DESC, size DESC, row_id) AS k FROM rows JOIN lim USING (family)),
p AS (SELECT *, row_number() OVER (PARTITION BY example_id, family ORDER BY severity DESC, n DESC, size DESC, row_id)::INT AS position FROM b WHERE NOT is_broad OR k <= broad)
SELECT example_id, family, row_id, is_broad, position FROM p WHERE position <= total""")
def pruned_rows(spark, folder):
    out = U.prune(canonical_rows(spark, folder), ["example_id", "family"], priority(), "family")
    return out.select("example_id", "family", "row_id", "is_broad", "position")


@query("relevance_gate", f"""WITH {SQL_ROWS},
v AS (SELECT doc_id AS row_id, CASE WHEN toxic = 1 THEN 'NOT_APPLICABLE' WHEN quality = 1 THEN 'APPLICABLE' ELSE 'unclear' END AS verdict FROM labels)
SELECT row_id, example_id, CASE WHEN verdict IN ('APPLICABLE', 'NOT_APPLICABLE') THEN verdict ELSE 'UNCERTAIN' END AS verdict
FROM rows LEFT JOIN v USING (row_id) WHERE coalesce(verdict, '') <> 'NOT_APPLICABLE'""")
def relevance_gate(spark, folder):
    verdict = F.when(F.col("toxic") == 1, "NOT_APPLICABLE").when(F.col("quality") == 1, "APPLICABLE").otherwise("unclear")
    verdicts = B.table(spark, folder, "labels").select(F.col("doc_id").alias("row_id"), verdict.alias("verdict"))
    rows = docs(spark, folder).select(F.col("doc_id").alias("row_id"), F.col("source").alias("example_id"))
    return U.relevance_gate(rows, verdicts, ["row_id"])


MODELS, STYLES = ("writer_one", "writer_two", "writer_three"), ("brief", "full")


@query("generation_plan", f"""SELECT doc_id, j::INT AS job, [{', '.join(f"'{m}'" for m in MODELS)}][j % 3 + 1] AS model,
  [{', '.join(f"'{s}'" for s in STYLES)}][j % 2 + 1] AS style, ([0.0, 0.2, 0.3, 0.1][j % 4 + 1])::DOUBLE AS temperature
FROM documents, range(8) t(j)""")
def generation_plan(spark, folder):
    return U.generation_plan(docs(spark, folder).select("doc_id"), "doc_id", MODELS, STYLES, 8)


@query("top_terms", f"""WITH t AS (SELECT lang AS family, doc_id, unnest({B.sql_tokens('text')}) AS term, generate_subscripts({B.sql_tokens('text')}, 1) AS pos FROM documents),
c AS (SELECT family, term, count(*) AS n, min((doc_id, pos)) AS p FROM t WHERE length(term) >= 4 GROUP BY ALL)
SELECT family, term, n, row_number() OVER (PARTITION BY family ORDER BY n DESC, p)::INT AS rank FROM c QUALIFY rank <= 3""")
def top_terms(spark, folder):
    toks = docs(spark, folder).select(
        F.col("lang").alias("family"), "doc_id", F.posexplode_outer(T.alnum_tokens(F.col("text"))).alias("pos", "term")
    ).where(F.length("term") >= 4)
    return U.top_terms(toks.select("family", "term", F.struct("doc_id", "pos").alias("place")), ["family"])


SQL_FEATURES = f"""f AS (SELECT page_id % 10 AS slice, {_sql_profiles(X.WORD_PROFILES, _sql_words_any)} AS profile, contains(html, '<ul>')::INT AS structure,
  contains(html, '<code>')::INT AS code, contains(low, 'must')::INT AS constraints, 1 AS examples FROM (SELECT *, lower(html) AS low FROM pages)),
r AS (SELECT slice, profile, count(*) AS n FROM f GROUP BY ALL), s AS (SELECT slice, sum(structure) AS st, sum(code) AS co, sum(constraints) AS cs, sum(examples) AS ex FROM f GROUP BY ALL),
w(profile, wst, wco, wcs, wex) AS (VALUES ('note_documentation', 0.0, 0.0, 0.0, 0.0), ('documentation_variants', 1.25, 0.0, 0.0, 0.0), ('rewrite_editing', 0.5, 0.0, 1.0, 0.0),
  ('clinical_decision_support', 0.0, 0.0, 0.0, 0.0), ('general_instruction_following', 0.5, 1.0, 1.5, 0.5), ('agentic_workflows', 0.0, 0.0, 0.0, 0.0)),
sc AS (SELECT s.slice, w.profile, (coalesce(n, 0) * 2.0 + st * wst + co * wco + cs * wcs + ex * wex)::DOUBLE AS score FROM s, w LEFT JOIN r ON r.slice = s.slice AND r.profile = w.profile)"""


def page_features(spark, folder):
    html = F.col("html")
    return B.table(spark, folder, "pages").select(
        (F.col("page_id") % 10).alias("slice"), X.profile_by_words(html).alias("profile"),
        F.contains(html, F.lit("<ul>")).cast("int").alias("structure"), F.contains(html, F.lit("<code>")).cast("int").alias("code"),
        F.contains(F.lower(html), F.lit("must")).cast("int").alias("constraints"), F.lit(1).alias("examples"),
    )


@query("profile_scores", f"WITH {SQL_FEATURES} SELECT slice, profile, round(score, 6) AS score FROM sc")
def profile_scores(spark, folder):
    return U.profile_scores(page_features(spark, folder), "slice").withColumn("score", F.round("score", 6))


@query("parent_profile", f"""WITH {SQL_FEATURES}
SELECT slice, profile, round(score, 6) AS score FROM sc QUALIFY row_number() OVER (PARTITION BY slice ORDER BY score DESC, profile) = 1""")
def parent_profile(spark, folder):
    scores = U.profile_scores(page_features(spark, folder), "slice")
    return U.parent_profile(scores, "slice").withColumn("score", F.round("score", 6))


RISK = ("worthless", "http", "@", "three")


@query("ungrounded_terms", f"""WITH t AS (SELECT doc_id, lower(text) AS n, lower({_truncated()}) AS d FROM documents)
SELECT doc_id, CASE {' '.join(f"WHEN contains(n, '{r}') AND NOT contains(d, '{r}') THEN '{r}'" for r in RISK)} END AS term FROM t""")
def ungrounded_terms(spark, folder):
    """Risk terms in the full text that its truncated variant does not support."""
    rows = docs(spark, folder).select("doc_id", "text", X.truncate_half(F.col("text")).alias("half"))
    return rows.select("doc_id", U.ungrounded_terms(F.col("text"), F.col("half"), RISK).alias("term"))


@query("packaged_evaluations", f"""WITH {B.EVALS},
r(rubric_id, rubric_text) AS (VALUES {', '.join(f"('{r.rubric_id}', '{r.text}')" for r in B.RULES)})
SELECT example_id AS id, candidate_id, rubric_id, rubric_text, CASE WHEN quality_bucket = 'open_generated' THEN 'generated_note'
  WHEN quality_bucket = 'synthetically_degraded' THEN 'synthetic' ELSE 'anchor' END AS candidate_role, sat = 1 AS satisfied FROM evals JOIN r USING (rubric_id)""")
def packaged_evaluations(spark, folder):
    """Facts with rubric texts and candidate roles, as a packaged table."""
    cands = B.candidates(spark, folder).select("example_id", "candidate_id", "quality_bucket", *B.RULE_IDS)
    facts = B.evaluations(cands).select("example_id", "candidate_id", "rubric_id", "satisfied", F.lit("").alias("reasoning"))
    texts = F.array(*[F.struct(F.lit(r.rubric_id).alias("rubric_id"), F.lit(r.text).alias("text")) for r in B.RULES])
    rubrics = B.table(spark, folder, "documents").select(F.col("source").alias("example_id")).distinct().select("example_id", F.inline(texts))
    people = cands.select("example_id", "candidate_id", B.origin().alias("origin_kind"), B.source_label().alias("source_label"),
                          F.lit("").alias("text"))
    return writers.package_evaluations(facts, rubrics, people).select(
        "id", "candidate_id", "rubric_id", "rubric_text", "candidate_role", "satisfied"
    )


@query("failure_clusters", f"""WITH {Q.PAIRS},
p AS (SELECT *, CASE WHEN pts_a > pts_b THEN 'a' WHEN pts_b > pts_a THEN 'b' ELSE 'tie' END AS pred, abs(pts_a - pts_b) AS m FROM pairs WHERE gold <> ''),
x AS (SELECT source_family, CASE WHEN m = 0 THEN 'tie' WHEN m <= 50 THEN 'narrow' WHEN m <= 150 THEN 'medium' ELSE 'wide' END AS margin,
  CASE WHEN greatest(word_count_a, word_count_b) >= 2 * least(word_count_a, word_count_b) THEN 'unequal' ELSE 'similar' END AS lengths, pred = gold AS ok FROM p)
SELECT source_family, margin, lengths, count(*) AS pairs, count(*) FILTER (NOT ok) AS failures FROM x GROUP BY ALL""")
def failure_clusters(spark, folder):
    a, b = F.col("a"), F.col("b")
    gap = F.abs(a["adjusted_points"] - b["adjusted_points"])
    wa, wb = a["word_count"], b["word_count"]
    rows = Q.pair_rows(spark, folder).select(
        "source_family", "gold",
        F.when(gap == 0, "tie").when(gap <= 50, "narrow").when(gap <= 150, "medium").otherwise("wide").alias("margin"),
        F.when(F.greatest(wa, wb) >= 2 * F.least(wa, wb), "unequal").otherwise("similar").alias("lengths"),
        (D.predict(F.col("score_a"), F.col("score_b")) == F.col("gold")).alias("ok"),
    )
    return rows.where(F.col("gold") != "").groupBy("source_family", "margin", "lengths").agg(
        F.count(F.lit(1)).alias("pairs"), F.count(F.when(~F.col("ok"), 1)).alias("failures")
    )


@query("strong_weak_roles", f"""WITH {B.CANDS},
c AS (SELECT *, {B.SQL_ORIGIN} AS origin_kind, {B.SQL_LABEL} AS source_label FROM cands),
p AS (SELECT *, CASE source_label WHEN 'reference_note' THEN 0 WHEN 'augmented_note' THEN 2 WHEN 'note_truncated' THEN 4 ELSE 99 END AS pr FROM c),
s AS (SELECT example_id, min((pr, candidate_id)) FILTER (origin_kind <> 'synthetic') AS st, bool_or(origin_kind = 'synthetic') AS any_syn FROM p GROUP BY ALL)
SELECT example_id, candidate_id, CASE WHEN origin_kind <> 'synthetic' AND (pr, candidate_id) = st THEN 'strong' WHEN st IS NULL THEN 'unused'
  WHEN origin_kind = 'synthetic' THEN 'weak' WHEN NOT any_syn AND (pr, candidate_id) > st THEN 'weak' ELSE 'unused' END AS role FROM p JOIN s USING (example_id)""")
def strong_weak_roles(spark, folder):
    cands = B.candidates(spark, folder).select(
        "example_id", "candidate_id", B.origin().alias("origin_kind"), B.source_label().alias("source_label")
    )
    return U.strong_and_weak(cands).select("example_id", "candidate_id", "role")


@query("side_assignment", """SELECT doc_id AS pair_id, CASE WHEN left(md5('s1|' || doc_id), 1) < '8' THEN lang ELSE source END AS response_a,
  CASE WHEN left(md5('s1|' || doc_id), 1) < '8' THEN source ELSE lang END AS response_b,
  CASE WHEN left(md5('s1|' || doc_id), 1) < '8' THEN 'A>B' ELSE 'B>A' END AS label FROM documents""")
def side_assignment(spark, folder):
    pairs = docs(spark, folder).select(F.col("doc_id").alias("pair_id"), F.col("lang").alias("strong"), F.col("source").alias("weak"))
    return U.side_assignment(pairs, "s1").drop("strong", "weak")


@query("blind_view", """SELECT doc_id, lang, CASE WHEN lang = 'en' THEN '' ELSE md5(text) END AS reference_answer FROM documents""")
def blind_view(spark, folder):
    rows = docs(spark, folder).select("doc_id", "lang", F.md5("text").alias("reference_answer"))
    return U.blind_view(rows, ["reference_answer"], F.col("lang") != "en")


@query("slim_projection", """SELECT d.doc_id, source, CASE quality WHEN 1 THEN 'reference_answer_a' ELSE 'reference_answer_b' END AS correct_answer
FROM documents d JOIN labels l ON l.doc_id = d.doc_id WHERE toxic = 0""")
def slim_projection(spark, folder):
    """Listed columns only; rows with a missing column or an unknown label are dropped."""
    labels = B.table(spark, folder, "labels")
    label = F.when(F.col("toxic") == 1, "tie").when(F.col("quality") == 1, "reference_answer_a").when(
        F.col("quality") == 0, "reference_answer_b")
    rows = docs(spark, folder).select("doc_id", "source", "n_chars").join(labels, "doc_id", "left").withColumn("correct_answer", label)
    return writers.project(rows, ["doc_id", "source", "correct_answer"], "correct_answer")


SQL_FOLDED = f"""{Q.PAIRS},
x AS (SELECT pair_id, source_family, CASE WHEN pts_a > pts_b THEN 'A>B' WHEN pts_a < pts_b THEN 'B>A' ELSE 'A=B' END = label AS ok FROM pairs),
k AS (SELECT least(5, min(n)) AS folds FROM (SELECT count(*) AS n FROM x GROUP BY source_family)),
f AS (SELECT x.*, (row_number() OVER (PARTITION BY source_family ORDER BY pair_id) - 1) % folds AS fold_index FROM x, k)"""


def folded_results(spark, folder):
    from verdikt.operators.splits import balanced_folds

    rows = Q.pair_rows(spark, folder).select(
        "pair_id", "source_family", (D.compare(F.col("score_a"), F.col("score_b")) == F.col("label")).alias("correct")
    )
    return balanced_folds(rows, 5)


@query("fold_metrics", f"""WITH {SQL_FOLDED},
p AS (SELECT fold_index, count(*) AS pairs, count(*) FILTER (ok) AS correct FROM f GROUP BY ALL)
SELECT fold_index, pairs, correct, round(100.0::DOUBLE * correct / pairs, 6) AS accuracy_pct FROM p""")
def fold_metrics(spark, folder):
    """All folds in one job: the fold is a column, not a process."""
    n, ok = F.count(F.lit(1)), F.count(F.when(F.col("correct"), 1))
    return folded_results(spark, folder).groupBy("fold_index").agg(
        n.alias("pairs"), ok.alias("correct"), F.round(ok * 100.0 / n, 6).alias("accuracy_pct")
    )


@query("fold_gap", f"""WITH {SQL_FOLDED},
g AS (SELECT source_family, coalesce(100.0::DOUBLE * count(*) FILTER (ok AND fold_index <> 0) / nullif(count(*) FILTER (fold_index <> 0), 0), 0) AS t,
  coalesce(100.0::DOUBLE * count(*) FILTER (ok AND fold_index = 0) / nullif(count(*) FILTER (fold_index = 0), 0), 0) AS h FROM f GROUP BY ALL)
SELECT source_family, round(t, 6) AS train_fit, round(h, 6) AS held_out, round(t - h, 6) AS gap FROM g""")
def fold_gap(spark, folder):
    out = U.fold_gap(folded_results(spark, folder), F.col("fold_index") == 0)
    return out.withColumns({c: F.round(c, 6) for c in ("train_fit", "held_out")})
