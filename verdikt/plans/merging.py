"""Dedupe, merge, library, bank and refinement queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from verdikt.functions import decisions as D
from verdikt.functions import rubrics as X
from verdikt.functions import text as T
from verdikt.operators import banks as K
from verdikt.operators import greedy as G
from verdikt.operators import merge as M
from verdikt.operators import refinement as RF
from verdikt.operators import scoring as S
from verdikt.plans import base as B
from verdikt.plans.registry import query
from verdikt.plans.texts import SQL_LINES, docs
from verdikt.session import durable, ship_package

NORM = f"lower({B.sql_squeeze('text')})"


def body():
    return F.col("text")


@query("dedupe_first_seen", f"""WITH t AS (SELECT doc_id, sha256({NORM}) AS k FROM documents WHERE {NORM} <> '')
SELECT min(doc_id) AS doc_id, count(*) AS copies FROM t GROUP BY k""")
def dedupe_first_seen(spark, folder):
    rows = docs(spark, folder).select("doc_id", M.digest(body()).alias("k"), (M.normal_key(body()) != "").alias("ok"))
    return M.first_seen(rows.where("ok"), "k", "doc_id").select("doc_id", "copies")


SQL_PROPOSALS = f"""prop AS (SELECT d.doc_id, lang AS dimension,
  CASE quality WHEN 1 THEN 'high' WHEN 0 THEN 'low' ELSE 'medium' END AS severity_tier,
  source AS example_id, (d.doc_id // 2)::VARCHAR AS pair_id, 'depth_' || (d.doc_id % 3) AS recursion_reason,
  md5(text) AS raw_digest, sha256({NORM}) AS body_key, text
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id),
keyed AS (SELECT *, sha256(dimension || '||' || severity_tier || '||' || body_key) AS merge_key FROM prop)"""


def proposals(spark, folder):
    """Documents as local proposals; the requirement is identified by its digest."""
    rows = docs(spark, folder).select(
        "doc_id", F.col("lang").alias("dimension"), F.col("source").alias("example_id"),
        F.floor(F.col("doc_id") / 2).cast("string").alias("pair_id"),
        F.concat(F.lit("depth_"), (F.col("doc_id") % 3).cast("string")).alias("recursion_reason"),
        F.md5("text").alias("raw_digest"), M.digest(body()).alias("body_key"),
    )
    tier = F.when(F.col("quality") == 1, "high").when(F.col("quality") == 0, "low").otherwise("medium")
    out = rows.join(B.table(spark, folder, "labels"), "doc_id", "left").withColumn("severity_tier", tier)
    return out.withColumn(
        "merge_key", F.sha2(F.concat_ws("||", "dimension", "severity_tier", "body_key"), 256)
    )


@query("merge_proposals", f"""WITH {SQL_PROPOSALS}
SELECT merge_key, min(doc_id) AS doc_id, arg_min(raw_digest, doc_id) AS raw_digest, arg_min(severity_tier, doc_id) AS severity_tier,
  arg_min(dimension, doc_id) AS dimension, count(*) AS copies FROM keyed GROUP BY merge_key""")
def merge_proposals(spark, folder):
    return M.first_seen(
        proposals(spark, folder), "merge_key", "doc_id", ["raw_digest", "severity_tier", "dimension"]
    )


LISTS = ("example_id", "pair_id", "recursion_reason")


@query("merge_members", f"""WITH {SQL_PROPOSALS},
m AS ({' UNION ALL '.join(f"SELECT merge_key, doc_id, '{c}' AS kind, {c} AS value FROM keyed" for c in LISTS)})
SELECT merge_key, kind, value, min(doc_id) AS first_ordinal FROM m WHERE value <> '' GROUP BY ALL""")
def merge_members(spark, folder):
    return M.merge_members(proposals(spark, folder), "merge_key", "doc_id", LISTS)


@query("promoted_templates", f"""WITH {SQL_PROPOSALS},
g AS (SELECT merge_key, arg_min(severity_tier, doc_id) AS sev, count(*) AS support, count(DISTINCT example_id) AS scopes,
  min(example_id) AS scope FROM keyed GROUP BY merge_key)
SELECT 'discovered__' || left(sha256(merge_key), 16) AS template_id, support,
  CASE sev WHEN 'high' THEN 'essential' WHEN 'medium' THEN 'important' ELSE 'optional' END AS tier,
  CASE WHEN scopes = 1 THEN scope END AS family_scope FROM g WHERE support >= 2""")
def promoted_templates(spark, folder):
    """Support threshold, tier mapping and a scope only when all examples share it."""
    g = proposals(spark, folder).groupBy("merge_key").agg(
        F.min(F.struct("doc_id", "severity_tier")).alias("f"), F.count(F.lit(1)).alias("support"),
        F.min("example_id").alias("lo"), F.max("example_id").alias("hi"),
    ).where(F.col("support") >= 2)
    return g.select(
        X.template_id(F.col("merge_key")).alias("template_id"), "support",
        X.capped_tier(X.severity_tier(F.col("f.severity_tier"))).alias("tier"),
        F.when(F.col("lo") == F.col("hi"), F.col("lo")).alias("family_scope"),
    )


@query("index_aggregate", f"""WITH t AS (SELECT doc_id, lang, source, doc_id % 4 AS depth, n_chars % 9 AS cov,
  sha1({NORM}) AS k FROM documents WHERE {NORM} <> '')
SELECT 'med_lib_' || left(k, 16) AS rubric_id, min(doc_id) AS first_doc, count(*) AS occurrence_count, sum(cov)::BIGINT AS coverage_count,
  min(depth) AS depth_min, count(DISTINCT source) AS sources FROM t GROUP BY k""")
def index_aggregate(spark, folder):
    key = M.normal_key(body())
    rows = docs(spark, folder).select(
        "doc_id", "source", (F.col("doc_id") % 4).alias("depth"), (F.col("n_chars") % 9).alias("cov"),
        F.sha1(key).alias("k"), (key != "").alias("ok"),
    ).where("ok")
    return rows.groupBy("k").agg(
        F.min("doc_id").alias("first_doc"), F.count(F.lit(1)).alias("occurrence_count"),
        F.sum("cov").alias("coverage_count"), F.min("depth").alias("depth_min"),
        F.countDistinct("source").alias("sources"),
    ).select(F.concat(F.lit("med_lib_"), F.substring("k", 1, 16)).alias("rubric_id"), "first_doc",
             "occurrence_count", "coverage_count", "depth_min", "sources")


@query("latest_cache", """SELECT user_id || '::' || event_type AS key, max(event_id) AS ordinal, arg_max(value, event_id) AS value,
  arg_max(props, event_id) AS props FROM events GROUP BY user_id, event_type""")
def latest_cache(spark, folder):
    """Append-only cache log: the last record of a key wins."""
    log = B.table(spark, folder, "events").select(
        F.concat(F.col("user_id").cast("string"), F.lit("::"), F.col("event_type")).alias("key"),
        F.col("event_id").alias("ordinal"), "value", "props",
    )
    return M.latest_per_key(log, "key", "ordinal", ["value", "props"])


CASE_FAMILY = "CASE lang WHEN 'en' THEN 'mmlu-pro' WHEN 'fr' THEN 'livebench-reasoning' WHEN 'de' THEN 'livebench-math' ELSE 'livecodebench' END"
SQL_LIBRARY = f"""lib AS (SELECT 'lib_' || left(sha1(text), 16) AS criterion_id, min(d.doc_id) AS doc_id, any_value(source) AS dimension,
  min(CASE WHEN toxic = 1 THEN 'hard_gate' ELSE 'medium' END) AS severity_tier, min(d.doc_id % 5) = 0 AS generic,
  min({CASE_FAMILY}) AS fam, min(n_chars % 7) AS direction_evidence, 'kind' || min(d.doc_id % 3) AS focus_kind
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id GROUP BY sha1(text)),
library AS (SELECT criterion_id, dim AS dimension, severity_tier, generic, fam, direction_evidence, focus_kind
  FROM lib JOIN (SELECT doc_id, source AS dim FROM documents) USING (doc_id))"""


def library(spark, folder):
    """Distinct texts as library criteria."""
    family = F.expr(CASE_FAMILY)
    rows = docs(spark, folder).select(
        "doc_id", F.concat(F.lit("lib_"), F.substring(F.sha1("text"), 1, 16)).alias("criterion_id"),
        F.col("source").alias("dimension"), family.alias("fam"), (F.col("n_chars") % 7).alias("ev"),
    ).join(B.table(spark, folder, "labels").select("doc_id", "toxic"), "doc_id", "left")
    g = rows.groupBy("criterion_id").agg(
        F.min(F.struct("doc_id", "dimension")).alias("f"),
        F.min(F.when(F.col("toxic") == 1, "hard_gate").otherwise("medium")).alias("severity_tier"),
        F.min(F.col("doc_id") % 5).alias("g"), F.min("fam").alias("fam"), F.min("ev").alias("direction_evidence"),
        F.concat(F.lit("kind"), F.min(F.col("doc_id") % 3).cast("string")).alias("focus_kind"),
    )
    fams = F.when(F.col("g") == 0, F.array(F.lit("generic"), F.col("fam"))).otherwise(F.array("fam"))
    return g.select("criterion_id", F.col("f.dimension").alias("dimension"), "severity_tier",
                    fams.alias("applicable_families"), "direction_evidence", "focus_kind")


SQL_FAMS = "fams(family) AS (VALUES " + ", ".join(f"('{f}')" for f in D.FAMILIES) + ")"
SQL_ORDER = "severity_tier <> 'hard_gate', fam <> family, direction_evidence DESC, criterion_id"


@query("library_filter", f"""WITH {SQL_LIBRARY}, {SQL_FAMS},
x AS (SELECT family, criterion_id, row_number() OVER (PARTITION BY family ORDER BY {SQL_ORDER})::INT AS rank
  FROM fams JOIN library ON fam = family OR generic)
SELECT * FROM x WHERE rank <= 12""")
def library_filter(spark, folder):
    return M.filter_by_family(library(spark, folder), D.FAMILIES, 12).select("family", "criterion_id", "rank")


@query("library_strict", f"""WITH {SQL_LIBRARY}, {SQL_FAMS},
x AS (SELECT family, criterion_id, row_number() OVER (PARTITION BY family ORDER BY {SQL_ORDER})::INT AS rank
  FROM fams JOIN library ON fam = family)
SELECT * FROM x WHERE rank <= 4""")
def library_strict(spark, folder):
    return M.filter_by_family(library(spark, folder), D.FAMILIES, 4, strict=True).select("family", "criterion_id", "rank")


@query("library_focus", f"""WITH {SQL_LIBRARY}, {SQL_FAMS},
m AS (SELECT *, focus_kind = 'kind1' AS hit, bool_or(focus_kind = 'kind1') OVER (PARTITION BY family) AS any_hit
  FROM fams JOIN library ON fam = family OR generic),
x AS (SELECT family, criterion_id, row_number() OVER (PARTITION BY family ORDER BY {SQL_ORDER})::INT AS rank FROM m WHERE hit OR NOT any_hit)
SELECT * FROM x WHERE rank <= 6""")
def library_focus(spark, folder):
    return M.filter_by_family(library(spark, folder), D.FAMILIES, 6, focus=["kind1"]).select("family", "criterion_id", "rank")


@query("library_summary", f"""WITH {SQL_LIBRARY},
f AS (SELECT 'family' AS facet, fam AS value FROM library UNION ALL SELECT 'family', 'generic' FROM library WHERE generic
  UNION ALL SELECT 'dimension', dimension FROM library UNION ALL SELECT 'severity', severity_tier FROM library)
SELECT facet, value, count(*) AS criteria FROM f GROUP BY ALL""")
def library_summary(spark, folder):
    return M.summarize_library(library(spark, folder))


@query("library_merge", f"""WITH {SQL_LIBRARY},
old AS (SELECT criterion_id, 'old' AS origin FROM library WHERE direction_evidence <= 4),
new AS (SELECT criterion_id, 'new' AS origin FROM library WHERE direction_evidence >= 3)
SELECT * FROM new UNION ALL SELECT * FROM old WHERE criterion_id NOT IN (SELECT criterion_id FROM new)""")
def library_merge(spark, folder):
    lib = library(spark, folder).select("criterion_id", "direction_evidence")
    old = lib.where("direction_evidence <= 4").select("criterion_id", F.lit("old").alias("origin"))
    new = lib.where("direction_evidence >= 3").select("criterion_id", F.lit("new").alias("origin"))
    return M.merge_libraries(old, new, "criterion_id", prefer_new=True)


@query("library_budget", f"""WITH {SQL_LIBRARY},
ordered AS (SELECT list({{'criterion_id': criterion_id, 'dimension': dimension, 'fam': fam}}
  ORDER BY severity_tier <> 'hard_gate', direction_evidence DESC, dimension, criterion_id) AS rows FROM library),
folded AS (SELECT list_reduce(list_transform(rows, lambda r: {{'r': r, 'acc': rows[1:0]}}), lambda a, x: {{'r': x.r, 'acc': CASE
    WHEN len(a.acc) < 60 AND len(list_filter(a.acc, lambda y: y.dimension = x.r.dimension)) < 6 AND len(list_filter(a.acc, lambda y: y.fam = x.r.fam)) < 14
    THEN list_append(a.acc, x.r) ELSE a.acc END}}, {{'r': rows[1], 'acc': rows[1:0]}}).acc AS acc FROM ordered)
SELECT c.criterion_id, 'cluster_' || lpad(i::VARCHAR, 3, '0') AS cluster_id FROM (SELECT unnest(acc) AS c, unnest(range(len(acc))) AS i FROM folded)""")
def library_budget(spark, folder):
    """Greedy caps per dimension, family and in total."""
    return M.budgeted(library(spark, folder))


RULES = (
    K.CategoryRule("articles", "grammar", 10, ("the", "le", "der", "el"), ("with",)),
    K.CategoryRule("conjunctions", "grammar", 20, ("and", "et", "und", "y")),
    K.CategoryRule("prepositions", "grammar", 30, ("of", "in", "to", "by"), ("a",), 2),
    K.CategoryRule("pronouns", "reference", 40, ("it", "he", "that", "elle"), ("is",), 2),
    K.CategoryRule("quantities", "content", 50, ("three", "one", "two")),
)
GROUPS = {"articles": "function_words", "conjunctions": "function_words", "prepositions": "function_words",
          "pronouns": "referring", "quantities": "amounts"}


def _sql_rule(r):
    def count(words):
        return " + ".join(f"regexp_matches(low, '{T.word_bound(w)}')::INT" for w in words) or "0"

    return f"""SELECT *, '{r.category_id}' AS category_id, '{r.family}' AS family, {count(r.keywords)} AS hits,
      2 * ({count(r.keywords)}) - 2 * ({count(r.anti_keywords)}) AS score, {r.min_hits} AS min_hits FROM rub"""


SQL_RULES = f"""rub AS (SELECT doc_id AS rubric_id, source AS example_id, {NORM} AS low, doc_id % 3 AS depth, n_chars % 11 AS cov,
    len({B.sql_words('text')}) AS words FROM documents),
allm AS ({' UNION ALL '.join(_sql_rule(r) for r in RULES)}),
mem AS (SELECT *, round((score + hits)::DOUBLE + CASE WHEN depth = 0 THEN 2.5 ELSE 0 END::DOUBLE + CASE WHEN depth = 0 THEN 1.0 ELSE 0 END::DOUBLE
    + least(cov, 8) * 0.1::DOUBLE - greatest(words, 1) / 200.0::DOUBLE, 9) AS rep FROM allm WHERE hits >= min_hits AND score > 0)"""


def rubric_bank(spark, folder):
    rows = docs(spark, folder).select(
        F.col("doc_id").alias("rubric_id"), F.col("source").alias("example_id"), body(),
        (F.col("doc_id") % 3).alias("depth"), (F.col("n_chars") % 11).alias("coverage_count"),
        T.word_count(body()).alias("word_count"),
        F.when(F.col("doc_id") % 3 == 0, "initial").otherwise("decomposition").alias("source_stage"),
    )
    return K.matched_categories(rows, RULES).drop("text")


@query("rule_compression", f"""WITH {SQL_RULES},
r AS (SELECT *, row_number() OVER (PARTITION BY example_id, category_id ORDER BY rep DESC, rubric_id) AS k FROM mem)
SELECT example_id, category_id, family, count(*) AS member_count, max(cov) AS max_coverage_count, min(depth) AS min_depth,
  max(rubric_id) FILTER (k = 1) AS representative_id FROM r GROUP BY ALL""")
def rule_compression(spark, folder):
    return K.compress(rubric_bank(spark, folder), ["example_id"])


@query("unmapped_rubrics", f"""WITH {SQL_RULES}
SELECT example_id, rubric_id, depth FROM rub WHERE rubric_id NOT IN (SELECT rubric_id FROM mem)""")
def unmapped_rubrics(spark, folder):
    return rubric_bank(spark, folder).where(F.size("categories") == 0).select("example_id", "rubric_id", "depth")


@query("production_groups", f"""WITH {SQL_RULES},
g(category_id, group_id) AS (VALUES {', '.join(f"('{k}', '{v}')" for k, v in GROUPS.items())}),
c AS (SELECT example_id, category_id, count(*) AS n, max(cov) AS cov FROM mem GROUP BY ALL),
h AS (SELECT example_id, group_id, count(*) AS category_count, max(n) AS largest_category FROM c JOIN g USING (category_id) GROUP BY ALL),
d AS (SELECT example_id, group_id, count(DISTINCT rubric_id) AS source_member_count FROM mem JOIN g USING (category_id) GROUP BY ALL)
SELECT *, CASE WHEN category_count > 1 OR source_member_count > 1 THEN 'merged' ELSE 'kept' END AS action_taken
FROM h JOIN d USING (example_id, group_id)""")
def production_groups(spark, folder):
    bank = durable(rubric_bank(spark, folder))
    members = bank.select("example_id", "rubric_id", F.explode_outer("categories.category_id").alias("category_id"))
    members = members.where(F.col("category_id").isNotNull())
    return K.production_bank(K.compress(bank, ["example_id"]), GROUPS, ["example_id"], members)


BEHAVIOR = {"r01": "structure", "r05": "structure", "r07": "structure", "r02": "content", "r03": "content",
            "r08": "content", "r04": "style", "r06": "style", "r09": "style", "r10": "style"}


@query("production_behavior", f"""WITH {B.EVALS},
g(rubric_id, group_id) AS (VALUES {', '.join(f"('{k}', '{v}')" for k, v in BEHAVIOR.items())}),
a AS (SELECT example_id, group_id, candidate_id, quality_bucket, max(sat) AS hit FROM evals JOIN g USING (rubric_id) GROUP BY ALL),
s AS (SELECT example_id, group_id, count(*) AS n, sum(hit)::BIGINT AS coverage_count,
  avg(hit) FILTER (quality_bucket IN ('gold_like', 'strong_anchor', 'open_generated')) AS sr,
  avg(hit) FILTER (quality_bucket = 'synthetically_degraded') AS wr FROM a GROUP BY ALL)
SELECT example_id, group_id, coverage_count, round(coverage_count / n::DOUBLE, 6) AS coverage_ratio,
  round((coverage_count / n::DOUBLE) * (1 - coverage_count / n::DOUBLE), 6) AS discrimination_score,
  round(coalesce(sr, 0), 6) AS strong_rate, round(coalesce(wr, 0), 6) AS weak_rate FROM s""")
def production_behavior(spark, folder):
    rows = F.array(*[F.struct(F.lit(k).alias("rubric_id"), F.lit(v).alias("group_id")) for k, v in BEHAVIOR.items()])
    membership = spark.range(1).select(F.inline(rows))
    out = K.behavior(B.evaluations(B.candidates(spark, folder)), membership)
    rates = ("coverage_ratio", "discrimination_score", "strong_rate", "weak_rate")
    return out.select("example_id", "group_id", "coverage_count", *[F.round(c, 6).alias(c) for c in rates])


@query("decomposition_gate", f"""WITH {B.CANDS},
s AS (SELECT example_id, count(*)::DOUBLE AS n, sum(r04) AS p, sum(r06) AS a, sum(r01) AS b, sum(greatest(r06, r01)) AS u,
  sum(r04 * greatest(r06, r01)) AS pu, sum((1 - r04) * greatest(r06, r01)) AS ex, sum(r06 * r01) AS ab FROM cands GROUP BY ALL),
m AS (SELECT *, coalesce(pu / nullif(p, 0)::DOUBLE, 0) AS recall, coalesce(ex / nullif(u, 0)::DOUBLE, 0) AS extra,
  coalesce(ab / nullif(u, 0)::DOUBLE, 1) AS ov, greatest(a / n * (1 - a / n), b / n * (1 - b / n)) - p / n * (1 - p / n) AS gain FROM s)
SELECT example_id, p::BIGINT AS parent_coverage, u::BIGINT AS child_union, round(recall, 6) AS coverage_recall, round(extra, 6) AS extra_ratio,
  round(ov, 6) AS pair_overlap, round(gain, 6) AS discrimination_gain,
  a > 0 AND a < n AND b > 0 AND b < n AND p > 0 AND a < p AND b < p AND recall >= 0.85::DOUBLE AND extra <= 0.15::DOUBLE
    AND ov <= 0.75 AND gain >= 0.03::DOUBLE AS retain_children FROM m""")
def decomposition_gate(spark, folder):
    out = K.decomposition_gate(B.candidates(spark, folder, labels=False), "r04", "r06", "r01")
    ratios = ("coverage_recall", "extra_ratio", "pair_overlap", "discrimination_gain")
    return out.select(*[F.round(c, 6).alias(c) if c in ratios else F.col(c) for c in out.columns])


@query("bank_judgment", f"""WITH {SQL_LINES},
ws AS (SELECT doc_id, ord, lower(raw) AS low, {B.sql_words('lower(raw)')} AS w FROM line),
s AS (SELECT *, list_distinct(w) AS st FROM ws),
pr AS (SELECT a.doc_id, avg(len(list_intersect(a.st, b.st)) / greatest(1, len(a.st) + len(b.st) - len(list_intersect(a.st, b.st)))::DOUBLE) AS ov
  FROM s a JOIN s b ON a.doc_id = b.doc_id AND a.ord < b.ord GROUP BY ALL),
bk AS (SELECT doc_id, count(*) AS n, count(*) FILTER (contains(low, ' and ')) AS stacked, count(*) FILTER (len(w) > 35) AS wordy FROM s GROUP BY ALL),
sc AS (SELECT bk.doc_id, n, coalesce(ov, 0) AS ov, least(10.0, 4.0 + n / 3.0::DOUBLE) AS c, greatest(0.0, 9.0 - stacked)::DOUBLE AS a,
  greatest(0.0, 10.0 - coalesce(ov, 0) * 12.0::DOUBLE) AS r, greatest(0.0, 8.5 - wordy * 0.5)::DOUBLE AS e FROM bk LEFT JOIN pr ON pr.doc_id = bk.doc_id)
SELECT doc_id, n AS rubric_count, round(ov, 4) AS overlap, round(c, 2) AS coverage, round(a, 2) AS atomicity, round(e, 2) AS executability,
  round((c + a + r + 8.0 + e) / 5.0, 3) AS overall_usefulness FROM sc""")
def bank_judgment(spark, folder):
    """Heuristic scores of the bank formed by the lines of one document."""
    rows = docs(spark, folder).select("doc_id", F.transform(T.full_lines(body()), F.lower).alias("l")).where(F.size("l") > 0)
    words = rows.select("doc_id", "l", F.transform("l", T.words).alias("w"))
    ship_package(spark)
    banks = words.select(
        "doc_id", F.size("l").cast("bigint").alias("rubric_count"),
        F.size(F.filter("l", lambda x: F.contains(x, F.lit(" and ")))).alias("stacked"),
        F.size(F.filter("w", lambda x: F.size(x) > 35)).alias("wordy"),
        G.mean_overlap_udf("w").alias("overlap"),
    )
    out = K.bank_judgment(banks)
    return out.select(
        "doc_id", "rubric_count", F.round("overlap", 4).alias("overlap"),
        *[F.round(c, 2).alias(c) for c in ("coverage", "atomicity", "executability")],
        F.round("overall_usefulness", 3).alias("overall_usefulness"),
    )


@query("pair_grounding", f"""WITH t AS (SELECT doc_id, {B.sql_full_lines('text')} AS l, {B.sql_token_set('text')} AS strong FROM documents),
h AS (SELECT doc_id, strong, {B.sql_token_set("coalesce(l[len(l)], '')")} AS req,
  {B.sql_token_set("array_to_string(l[1:len(l) // 2], chr(10))")} AS weak FROM t),
o AS (SELECT doc_id, len(req) AS req_n, len(list_intersect(req, strong)) AS s, len(list_intersect(req, weak)) AS w FROM h)
SELECT doc_id, s AS strong_overlap, w AS weak_overlap, req_n > 0 AND s > 0 AND s >= w AS aligned FROM o""")
def pair_grounding(spark, folder):
    """A requirement (last line) must share at least as much with the strong side as with the weak one."""
    rows = docs(spark, folder).select("doc_id", "text", T.full_lines(body()).alias("l"))
    sets = rows.select(
        "doc_id", T.token_set(body()).alias("strong"),
        T.token_set(F.when(F.size("l") > 0, F.element_at("l", -1)).otherwise("")).alias("req"),
        T.token_set(F.array_join(F.slice("l", 1, F.floor(F.size("l") / 2).cast("int")), "\n")).alias("weak"),
    )
    s = F.size(F.array_intersect("req", "strong")).cast("bigint")
    w = F.size(F.array_intersect("req", "weak")).cast("bigint")
    return sets.select("doc_id", s.alias("strong_overlap"), w.alias("weak_overlap")).withColumn(
        "aligned", (F.col("strong_overlap") > 0) & (F.col("strong_overlap") >= F.col("weak_overlap"))
    )


def line_proposals(spark, folder):
    lines = docs(spark, folder).select("doc_id", T.full_lines(body()).alias("l"))
    tiers = F.array(*[F.lit(t) for t in G.SEVERITY])
    return lines.select(
        "doc_id", F.transform("l", T.token_set).alias("tokens"),
        F.transform("l", lambda x, i: F.element_at(tiers, (i % 4 + 1).cast("int"))).alias("severities"),
        F.transform("l", lambda x, i: (i % 3 + 1).cast("int")).alias("counts"),
    )


_SIMILAR = "len(x.t) > 0 AND len(list_intersect(x.t, k.t)) >= 0.5 * (len(x.t) + len(k.t) - len(list_intersect(x.t, k.t)))"
_PLACE = f"list_position(list_transform(a.kept, lambda k: {_SIMILAR}), true)"


@query("redundancy_greedy", f"""WITH t AS (SELECT doc_id, {B.sql_full_lines('text')} AS l FROM documents),
rows AS (SELECT doc_id, list_transform(l, lambda v, i: {{'p': i - 1, 't': {B.sql_token_set('v')}, 's': (i - 1) % 4, 'n': (i - 1) % 3 + 1}}) AS r FROM t WHERE len(l) > 0),
folded AS (SELECT doc_id, list_reduce(list_transform(r, lambda x: {{'p': x.p, 't': x.t, 's': x.s, 'n': x.n, 'kept': r[1:0]}}), lambda a, x:
  {{'p': x.p, 't': x.t, 's': x.s, 'n': x.n, 'kept': CASE WHEN coalesce({_PLACE}, 0) = 0 THEN list_append(a.kept, {{'p': x.p, 't': x.t, 's': x.s, 'n': x.n}})
    ELSE list_transform(a.kept, lambda k, i: CASE WHEN i <> {_PLACE} THEN k
      WHEN x.s < k.s OR (x.s = k.s AND x.n > k.n) THEN {{'p': x.p, 't': x.t, 's': x.s, 'n': k.n + x.n}} ELSE {{'p': k.p, 't': k.t, 's': k.s, 'n': k.n + x.n}} END) END}},
  {{'p': r[1].p, 't': r[1].t, 's': r[1].s, 'n': r[1].n, 'kept': r[1:0]}}).kept AS kept FROM rows)
SELECT doc_id, k.p::INT AS position, k.n::BIGINT AS count FROM (SELECT doc_id, unnest(kept) AS k FROM folded)""")
def redundancy_greedy(spark, folder):
    """Greedy collapse of one document's lines."""
    return G.redundancy(line_proposals(spark, folder), "doc_id", 0.5)


@query("refinement_worklist")
def refinement_worklist(spark, folder):
    """Refinement in rounds per document: pool = text and its weak variants, seeds = its lines."""
    rows = docs(spark, folder).select("doc_id", "text", X.remove_plan_details(body()).alias("bare"))
    bare = F.col("bare")
    examples = rows.select(
        "doc_id", F.array(body(), X.truncate_half(body()), bare, X.truncate_half(bare)).alias("texts"),
        F.array(*map(F.lit, ("gold_like", "frontier_generated", "strong_anchor", "synthetically_degraded"))).alias("buckets"),
        F.transform(T.full_lines(body()), lambda x: F.concat(F.lit("The note includes "), x)).alias("seeds"),
    )
    return RF.refined(examples, "doc_id")


@query("rubric_coverage_by_rule", f"""WITH {B.EVALS}
SELECT rubric_id, count(*) AS total, sum(sat)::BIGINT AS coverage_count FROM evals GROUP BY ALL""")
def rubric_coverage_by_rule(spark, folder):
    return S.rubric_coverage(B.evaluations(B.candidates(spark, folder, labels=False)), ["rubric_id"]).select(
        "rubric_id", "total", "coverage_count"
    )
