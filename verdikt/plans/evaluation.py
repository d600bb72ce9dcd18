"""Splits, retrieval, expert alignment, gates and audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from verdikt.functions import decisions as D
from verdikt.functions import rubrics as X
from verdikt.functions import text as T
from verdikt.operators import audit as A
from verdikt.operators import experts as E
from verdikt.operators import merge as M
from verdikt.operators import retrieval as V
from verdikt.operators import splits as P
from verdikt.plans import base as B
from verdikt.plans import pairs as Q
from verdikt.plans.merging import BEHAVIOR, CASE_FAMILY, NORM
from verdikt.plans.registry import SQL, query
from verdikt.plans.texts import SQL_LINES, _sql_list, _truncated, docs


def body():
    return F.col("text")


# ------------------------------------------------------------------ splits


@query("balanced_folds", f"""WITH f AS (SELECT doc_id AS pair_id, {CASE_FAMILY} AS source_family FROM documents),
k AS (SELECT least(5, min(n)) AS folds FROM (SELECT count(*) AS n FROM f GROUP BY source_family)),
r AS (SELECT *, row_number() OVER (PARTITION BY source_family ORDER BY pair_id) - 1 AS pos FROM f)
SELECT pair_id, source_family, pos % folds AS fold_index FROM r, k""")
def balanced_folds(spark, folder):
    pairs = docs(spark, folder).select(F.col("doc_id").alias("pair_id"), F.expr(CASE_FAMILY).alias("source_family"))
    return P.balanced_folds(pairs, 5)


@query("shuffled_folds", f"""WITH f AS (SELECT doc_id AS pair_id, {CASE_FAMILY} AS source_family FROM documents),
k AS (SELECT least(5, min(n)) AS folds FROM (SELECT count(*) AS n FROM f GROUP BY source_family)),
r AS (SELECT *, row_number() OVER (PARTITION BY source_family ORDER BY md5('17|' || pair_id), pair_id) - 1 AS pos FROM f)
SELECT pair_id, source_family, pos % folds AS fold_index FROM r, k""")
def shuffled_folds(spark, folder):
    pairs = docs(spark, folder).select(F.col("doc_id").alias("pair_id"), F.expr(CASE_FAMILY).alias("source_family"))
    return P.balanced_folds(pairs, 5, seed=17)


SQL_ORDINAL = "o AS (SELECT event_id, event_type, row_number() OVER (ORDER BY ts, event_id) - 1 AS ordinal FROM events)"


def ordered_events(spark, folder):
    events = B.table(spark, folder, "events").select("event_id", "event_type", "ts")
    return P.with_ordinal(events, [F.col("ts").asc(), F.col("event_id").asc()]).drop("ts")


@query("split_shard", f"""WITH {SQL_ORDINAL}, n AS (SELECT count(*) AS n FROM events)
SELECT event_id, ordinal, CASE WHEN ordinal < n * 6 // 10 THEN 'train' WHEN ordinal < n * 8 // 10 THEN 'val' ELSE 'rest' END AS part,
  CASE WHEN ordinal < n * 6 // 10 THEN ordinal // (n // 5) END AS shard FROM o, n""")
def split_shard(spark, folder):
    """Three contiguous train shards and a validation slice over the whole table."""
    rows = ordered_events(spark, folder)
    n = B.table(spark, folder, "events").count()
    train, val = n * 6 // 10, n * 8 // 10 - n * 6 // 10
    pos = F.col("ordinal")
    return rows.select(
        "event_id", "ordinal",
        F.when(pos < train, "train").when(pos < train + val, "val").otherwise("rest").alias("part"),
        F.when(pos < train, P.shard_of(pos, train, 3)).alias("shard"),
    )


@query("pilot_slices", f"""WITH {SQL_ORDINAL}, n AS (SELECT count(*) AS n FROM events)
SELECT event_type, count(*) FILTER (ordinal < n // 4) AS design, count(*) FILTER (ordinal >= n // 4 AND ordinal < n // 2) AS validation,
  count(*) FILTER (ordinal >= n // 2) AS pilot FROM o, n GROUP BY event_type""")
def pilot_slices(spark, folder):
    rows = ordered_events(spark, folder)
    n = B.table(spark, folder, "events").count()
    pos = F.col("ordinal")
    return rows.groupBy("event_type").agg(
        F.count(F.when(pos < n // 4, 1)).alias("design"),
        F.count(F.when((pos >= n // 4) & (pos < n // 2), 1)).alias("validation"),
        F.count(F.when(pos >= n // 2, 1)).alias("pilot"),
    )


@query("disjoint_train", f"""WITH k AS (SELECT doc_id, lang, sha256({NORM}) AS h FROM documents),
v AS (SELECT h FROM k JOIN labels USING (doc_id))
SELECT doc_id, lang FROM k WHERE doc_id NOT IN (SELECT doc_id FROM labels) AND h NOT IN (SELECT h FROM v)""")
def disjoint_train(spark, folder):
    """Training rows that share neither id nor text with the validation side."""
    keyed = docs(spark, folder).select("doc_id", "lang", M.digest(body()).alias("h"))
    held = B.table(spark, folder, "labels").select("doc_id")
    seen = keyed.join(held, "doc_id", "left_semi").select("h").distinct()
    return keyed.join(held, "doc_id", "left_anti").join(seen, "h", "left_anti").select("doc_id", "lang")


@query("split_leakage", f"""WITH k AS (SELECT lang, source, sha256({NORM}) AS h FROM documents),
s AS (SELECT lang, h, bool_or(source IN ('src0', 'src1', 'src2', 'src3')) AS val, bool_or(source NOT IN ('src0', 'src1', 'src2', 'src3')) AS train
  FROM k GROUP BY ALL)
SELECT lang, count(*) AS distinct_texts, count(*) FILTER (val AND train) AS leaked FROM s GROUP BY lang""")
def split_leakage(spark, folder):
    """Texts occurring on both sides of a split, found by one aggregate."""
    val = F.col("source").isin("src0", "src1", "src2", "src3")
    sides = docs(spark, folder).select("lang", M.digest(body()).alias("h"), val.alias("v")).groupBy("lang", "h").agg(
        F.max("v").alias("val"), F.max(~F.col("v")).alias("train")
    )
    return sides.groupBy("lang").agg(
        F.count(F.lit(1)).alias("distinct_texts"), F.count(F.when(F.col("val") & F.col("train"), 1)).alias("leaked")
    )


@query("joined_pairs", """WITH c AS (SELECT * FROM conversations)
SELECT u.conv_id || ':' || u.turn AS pair_id, 'train' AS split_name, md5(u.text) AS question_digest, md5(a.text) AS a_digest,
  md5(coalesce(b.text, '')) AS b_digest, u.turn % 2 <> 0 AS question_mismatch, CASE WHEN length(a.text) >= length(coalesce(b.text, '')) THEN 'A>B' ELSE 'B>A' END AS label
FROM c u JOIN c a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant'
LEFT JOIN c b ON b.conv_id = u.conv_id AND b.turn = u.turn + 3 AND b.role = 'assistant' WHERE u.role = 'user'""")
def joined_pairs(spark, folder):
    """User turns joined to their answers on (conversation, turn): unique keys, no hot side."""
    c = B.table(spark, folder, "conversations")
    say = c.where("role = 'assistant'").select("conv_id", "turn", "text")
    a = say.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("response_a"))
    b = say.select("conv_id", (F.col("turn") - 3).alias("turn"), F.col("text").alias("response_b"))
    asked = c.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"))
    full = asked.join(a, ["conv_id", "turn"]).join(b, ["conv_id", "turn"], "left")
    key = F.concat_ws(":", "conv_id", "turn").alias("pair_id")
    blank = F.lit("")
    local = full.select(key, F.lit("local").alias("source"), "question")
    official = full.select(
        key, F.lit("").alias("source"),
        F.when(F.col("turn") % 2 == 0, F.col("question")).otherwise(F.concat(F.col("question"), F.lit(" x"))).alias("question"),
        "response_a", F.coalesce("response_b", blank).alias("response_b"),
        F.when(F.length("response_a") >= F.length(F.coalesce("response_b", blank)), "A>B").otherwise("B>A").alias("label"),
    )
    joined = P.join_pairs(local, official, "train")
    shown = F.when(F.col("question_mismatch"), F.substring("question", F.lit(1), F.length("question") - 2)).otherwise(F.col("question"))
    return joined.select(
        "pair_id", "split_name", F.md5(shown).alias("question_digest"), F.md5("response_a").alias("a_digest"),
        F.md5("response_b").alias("b_digest"), "question_mismatch", "label",
    )


@query("capped_per_group", f"""WITH {B.CANDS},
k AS (SELECT *, row_number() OVER (PARTITION BY example_id ORDER BY satisfied_count, candidate_id) AS pos FROM cands)
SELECT example_id, candidate_id, satisfied_count FROM k WHERE pos <= 2 ORDER BY satisfied_count, candidate_id LIMIT 25""")
def capped_per_group(spark, folder):
    """Disagreement sample: at most two per example, then the first 25."""
    items = B.candidates(spark, folder, labels=False).select("example_id", "candidate_id", "satisfied_count")
    return P.capped_selection(items, "example_id", [F.col("satisfied_count").asc(), F.col("candidate_id").asc()], 2, 25)


@query("items_per_subset", """SELECT lang AS subset, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id)::INT AS position
FROM documents QUALIFY position <= 7""")
def items_per_subset(spark, folder):
    return P.first_items(docs(spark, folder).select(F.col("lang").alias("subset"), "doc_id"), "subset", [F.col("doc_id").asc()], 7)


@query("item_pairs", f"""WITH ls AS (SELECT doc_id, {B.sql_full_lines('text')} AS l FROM documents),
c AS (SELECT doc_id, unnest(l[1:2]) AS a, generate_subscripts(l[1:2], 1) - 1 AS chosen_index FROM ls),
r AS (SELECT doc_id, unnest(l[3:]) AS b, generate_subscripts(l[3:], 1) - 1 AS rejected_index FROM ls)
SELECT doc_id, chosen_index::INT AS chosen_index, rejected_index::INT AS rejected_index, md5(a) AS a_digest, md5(b) AS b_digest, 'A>B' AS label
FROM c JOIN r USING (doc_id) WHERE rejected_index < 3""")
def item_pairs(spark, folder):
    """item_pairs_all with the option of at most three rejected completions of an item."""
    return _item_pairs(spark, folder, max_rejected=3)


@query("item_pairs_all", f"""WITH ls AS (SELECT doc_id, {B.sql_full_lines('text')} AS l FROM documents),
c AS (SELECT doc_id, unnest(l[1:2]) AS a, generate_subscripts(l[1:2], 1) - 1 AS chosen_index FROM ls),
r AS (SELECT doc_id, unnest(l[3:]) AS b, generate_subscripts(l[3:], 1) - 1 AS rejected_index FROM ls)
SELECT doc_id, chosen_index::INT AS chosen_index, rejected_index::INT AS rejected_index, md5(a) AS a_digest, md5(b) AS b_digest, 'A>B' AS label
FROM c JOIN r USING (doc_id)""")
def item_pairs_all(spark, folder):
    """chosen x rejected of one item, all of them, the lists being lines of one document."""
    return _item_pairs(spark, folder)


def _item_pairs(spark, folder, max_rejected=None):
    l = F.col("l")
    items = docs(spark, folder).select("doc_id", T.full_lines(body()).alias("l")).select(
        "doc_id", F.slice(l, 1, 2).alias("chosen"), F.slice(l, F.lit(3), F.greatest(F.size(l), F.lit(1))).alias("rejected")
    )
    out = P.expand_item(items, max_rejected=max_rejected)
    return out.select("doc_id", "chosen_index", "rejected_index", F.md5("response_a").alias("a_digest"),
                      F.md5("response_b").alias("b_digest"), "label")


@query("external_slices", f"""WITH ls AS (SELECT doc_id, lang, {B.sql_full_lines('text')} AS l FROM documents),
p AS (SELECT doc_id, lang, list_filter(list_transform({B.sql_words("coalesce(l[1], '')")}, lambda w: lower(trim(w, '.,;:'))), lambda w: w <> '') AS t,
  lower(array_to_string(l[2:(len(l) + 1) // 2], ' ')) AS a, lower(array_to_string(l[(len(l) + 1) // 2 + 1:], ' ')) AS b FROM ls),
s AS (SELECT lang, len(list_filter(t, lambda w: contains(a, w))) AS sa, len(list_filter(t, lambda w: contains(b, w))) AS sb FROM p)
SELECT lang AS source_family, count(*) AS pair_count, count(*) FILTER (sa > sb) AS correct_count, count(*) FILTER (sa = sb) AS tie_count,
  round(100.0::DOUBLE * count(*) FILTER (sa > sb) / count(*), 4) AS score FROM s GROUP BY lang""")
def external_slices(spark, folder):
    """Held-out pairs scored by the keyword fallback judge, per family."""
    l = F.col("l")
    half = F.floor((F.size("l") + 1) / 2).cast("int")
    rows = docs(spark, folder).select("lang", T.full_lines(body()).alias("l")).select(
        "lang", F.when(F.size(l) > 0, F.element_at(F.concat(l, F.array(F.lit(""))), 1)).otherwise("").alias("prompt"),
        F.array_join(F.slice(l, 2, F.greatest(half - 1, F.lit(0))), " ").alias("a"),
        F.array_join(F.slice(l, half + 1, F.size(l)), " ").alias("b"),
    )
    judged = rows.select("lang", D.keyword_judge(F.col("prompt"), F.col("a"), F.col("b")).alias("d"))
    right = F.count(F.when(F.col("d") == D.FIRST, 1))
    return judged.groupBy(F.col("lang").alias("source_family")).agg(
        F.count(F.lit(1)).alias("pair_count"), right.alias("correct_count"),
        F.count(F.when(F.col("d") == D.EVEN, 1)).alias("tie_count"),
        F.round(right * 100.0 / F.count(F.lit(1)), 4).alias("score"),
    )


# --------------------------------------------------------------- retrieval


@query("cosine_topk", """WITH s AS (SELECT q.vec_id AS query_id, e.vec_id AS item_id, list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) AS c
  FROM embeddings q, embeddings e WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(c, 12) DESC, item_id)::INT AS rank FROM s)
SELECT query_id, item_id, round(c, 6) AS cosine, rank FROM r WHERE rank <= 3""")
def cosine_topk(spark, folder):
    """The stated query set, every id divisible by 50, against all vectors in blocks."""
    e = B.table(spark, folder, "embeddings")
    index = e.select(F.col("vec_id").alias("item_id"), "embedding")
    queries = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return V.cosine_top_k(queries, index, 3).withColumn("cosine", F.round("cosine", 6))


SQL_TFIDF = f"""dt AS (SELECT doc_id, t AS term, count(*) AS tf FROM (SELECT doc_id, unnest({B.sql_tokens('text')}) AS t FROM documents) GROUP BY ALL),
nn AS (SELECT count(*)::DOUBLE AS n FROM documents), df AS (SELECT term, count(*) AS df FROM dt GROUP BY term),
w AS (SELECT doc_id, term, tf * (ln((n + 1) / (df + 1)) + 1) AS w FROM dt JOIN df USING (term), nn),
dn AS (SELECT doc_id, sqrt(sum(w * w)) AS dn FROM w GROUP BY ALL),
qt AS (SELECT item_id, t AS term, count(*) AS tf FROM (SELECT item_id, unnest({B.sql_tokens('text')}) AS t FROM benchmark) GROUP BY ALL),
qw AS (SELECT item_id, term, tf * (ln((n + 1) / (coalesce(df, 0) + 1)) + 1) AS qw FROM qt LEFT JOIN df USING (term), nn),
qn AS (SELECT item_id, sqrt(sum(qw * qw)) AS qn FROM qw GROUP BY ALL),
s AS (SELECT item_id AS query_id, doc_id, round(sum(w * qw) / any_value(dn * qn), 9) AS sim FROM qw JOIN w USING (term) JOIN dn USING (doc_id)
  JOIN qn USING (item_id) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, doc_id)::INT AS rank FROM s WHERE sim > 0)"""


@query("tfidf_topk", f"WITH {SQL_TFIDF} SELECT query_id, doc_id, round(sim, 6) AS similarity, rank FROM r WHERE rank <= 3")
def tfidf_topk(spark, folder):
    corpus = docs(spark, folder).select("doc_id", T.alnum_tokens(body()).alias("tokens"))
    asked = B.table(spark, folder, "benchmark").select(F.col("item_id").alias("query_id"), T.alnum_tokens(body()).alias("tokens"))
    return V.tfidf_top_k(asked, corpus, 3).select(
        "query_id", "doc_id", F.round("similarity", 6).alias("similarity"), "rank"
    )


@query("few_shot_budget", f"""WITH {SQL_TFIDF},
b AS (SELECT query_id, doc_id, rank, least(length(text), 400) + 60 AS chars FROM r JOIN documents USING (doc_id) WHERE rank <= 5),
c AS (SELECT *, sum(chars) OVER (PARTITION BY query_id ORDER BY rank) AS used FROM b)
SELECT query_id, count(*) AS demonstrations, max(used)::BIGINT AS chars FROM c WHERE used <= 1500 GROUP BY query_id""")
def few_shot_budget(spark, folder):
    """Demonstrations that fit a character budget, best first (at most five per query)."""
    from pyspark.sql import Window

    corpus = docs(spark, folder).select("doc_id", T.alnum_tokens(body()).alias("tokens"))
    asked = B.table(spark, folder, "benchmark").select(F.col("item_id").alias("query_id"), T.alnum_tokens(body()).alias("tokens"))
    best = V.tfidf_top_k(asked, corpus, 5)
    sizes = docs(spark, folder).select("doc_id", (F.least(F.length(body()), F.lit(400)) + 60).cast("bigint").alias("chars"))
    used = F.sum("chars").over(Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    return best.join(sizes, "doc_id").withColumn("used", used).where(F.col("used") <= 1500).groupBy("query_id").agg(
        F.count(F.lit(1)).alias("demonstrations"), F.max("used").alias("chars")
    )


@query("diverse_topk", f"""WITH {B.CANDS},
a AS (SELECT *, row_number() OVER (PARTITION BY example_id, quality_bucket ORDER BY satisfied_count DESC, candidate_id) AS s FROM cands),
b AS (SELECT example_id, candidate_id, quality_bucket, row_number() OVER (PARTITION BY example_id ORDER BY (s > 1)::INT, satisfied_count DESC, candidate_id)::INT AS rank FROM a)
SELECT * FROM b WHERE rank <= 5""")
def diverse_topk(spark, folder):
    rows = B.candidates(spark, folder).select("example_id", "candidate_id", "quality_bucket", "satisfied_count")
    order = [F.col("satisfied_count").desc(), F.col("candidate_id").asc()]
    return V.diverse_top_k(rows, ["example_id"], "quality_bucket", order, 5).select(
        "example_id", "candidate_id", "quality_bucket", "rank"
    )


@query("retrieval_similarity", f"""WITH ls AS (SELECT doc_id, lang, {CASE_FAMILY} AS fam, {B.sql_full_lines('text')} AS l FROM documents),
q AS (SELECT doc_id, fam, coalesce(l[1], '') AS q, coalesce(l[len(l)], '') AS c FROM ls),
s AS (SELECT doc_id, fam, {B.sql_token_set('q')} AS a, {B.sql_token_set('c')} AS b, contains(q, '|') AND contains(c, '|') AS code FROM q),
x AS (SELECT *, {B.sql_jaccard('a', 'b')} AS lexical FROM s)
SELECT doc_id, round(lexical, 6) AS lexical, round(CASE WHEN fam = 'mmlu-pro' THEN lexical * 0.95::DOUBLE + 0.75::DOUBLE + code::INT * 0.05::DOUBLE
  ELSE lexical * 0.35::DOUBLE + 0.75::DOUBLE + code::INT * 0.20::DOUBLE END, 6) AS total FROM x""")
def retrieval_similarity(spark, folder):
    rows = docs(spark, folder).select("doc_id", F.expr(CASE_FAMILY).alias("fam"), T.full_lines(body()).alias("l")).select(
        "doc_id", "fam",
        F.when(F.size("l") > 0, F.element_at("l", 1)).otherwise("").alias("q"),
        F.when(F.size("l") > 0, F.element_at("l", -1)).otherwise("").alias("c"),
    )
    both = F.contains(F.col("q"), F.lit("|")) & F.contains(F.col("c"), F.lit("|"))
    s = rows.select("doc_id", "fam", T.token_set(F.col("q")).alias("a"), T.token_set(F.col("c")).alias("b"),
                    both.cast("int").alias("code")).withColumn("lexical", T.jaccard(F.col("a"), F.col("b")))
    parts = {"lexical": F.col("lexical"), "same_family": F.lit(1.0), "code_task_match": F.col("code")}
    return s.select("doc_id", F.round("lexical", 6).alias("lexical"),
                    F.round(V.similarity_total(parts, F.col("fam")), 6).alias("total"))


# ------------------------------------------------------- expert alignment

FAMILY_OF_LINE = [("^[A-Ea-e]", "grounding"), ("^[F-Of-o]", "structure"), ("^[P-Zp-z]", "other")]
SQL_LINE_FAMILY = "CASE " + " ".join(f"WHEN regexp_matches(raw, '{p}') THEN '{f}'" for p, f in FAMILY_OF_LINE) + " ELSE 'safety' END"

SQL_EXPERTS = f"""{SQL_LINES},
sized AS (SELECT line.*, len(l) AS n, lang FROM line JOIN ls USING (doc_id) JOIN (SELECT doc_id, lang FROM documents) USING (doc_id)),
crit AS (SELECT doc_id, lang, {SQL_LINE_FAMILY} AS family, ord > (n + 1) // 2 AS gen,
  CASE WHEN ord > (n + 1) // 2 THEN ord - (n + 1) // 2 - 1 ELSE ord - 1 END AS idx,
  list_distinct(list_filter({B.sql_tokens('raw')}, lambda t: length(t) >= 4 AND NOT list_contains({_sql_list(X.FAMILY_STOPWORDS)}, t))) AS toks FROM sized),
ex AS (SELECT *, (idx * 7) % 11 - 5 AS points FROM crit WHERE NOT gen),
ge AS (SELECT *, CASE WHEN idx % 3 = 0 THEN 'negative' ELSE 'positive' END AS polarity FROM crit WHERE gen),
sc AS (SELECT e.doc_id, e.idx AS ei, g.idx AS gi, g.polarity, round({B.sql_jaccard('e.toks', 'g.toks')} +
    CASE WHEN e.family = g.family AND e.family <> 'other' THEN 0.2 ELSE 0.0 END::DOUBLE, 9) AS score FROM ex e JOIN ge g USING (doc_id)),
best AS (SELECT * FROM sc WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY doc_id, ei ORDER BY score DESC, gi) = 1),
al AS (SELECT e.doc_id, e.lang, e.idx AS expert_index, e.family, e.points, CASE WHEN score >= 0.55 THEN 'direct' WHEN score >= 0.30 THEN 'partial' ELSE 'none' END AS match_label,
  CASE WHEN score >= 0.30 THEN gi END AS generated_index,
  CASE WHEN score >= 0.30 THEN polarity = CASE WHEN e.points < 0 THEN 'negative' ELSE 'positive' END END AS polarity_match
  FROM ex e LEFT JOIN best b ON b.doc_id = e.doc_id AND b.ei = e.idx),
asg AS (SELECT g.doc_id, g.lang, g.idx AS generated_index, g.family, CASE WHEN EXISTS (SELECT 1 FROM al WHERE al.doc_id = g.doc_id AND al.generated_index = g.idx) THEN 'aligned'
  WHEN g.family <> 'other' AND EXISTS (SELECT 1 FROM ex WHERE ex.doc_id = g.doc_id AND ex.family = g.family) THEN 'broader_but_valid'
  WHEN g.family = 'other' THEN 'off_target' ELSE 'valid_extra' END AS precision_label FROM ge g)"""


def prompts(spark, folder):
    """First half of a document's lines as expert criteria, second half as generated ones."""
    def family(x):
        out = F.when(x.rlike(FAMILY_OF_LINE[0][0]), FAMILY_OF_LINE[0][1])
        for pattern, name in FAMILY_OF_LINE[1:]:
            out = out.when(x.rlike(pattern), name)
        return out.otherwise("safety")

    def expert(x, i):
        points = (i * 7) % 11 - 5
        return F.struct(X.family_tokens(x).alias("tokens"), family(x).alias("family"), points.alias("points"),
                        F.when(points < 0, "negative").otherwise("positive").alias("polarity"))

    def generated(x, i):
        return F.struct(X.family_tokens(x).alias("tokens"), family(x).alias("family"),
                        F.when(i % 3 == 0, "negative").otherwise("positive").alias("polarity"))

    l = F.col("l")
    half = F.floor((F.size(l) + 1) / 2).cast("int")
    # a test of the array would be pushed below it and split every text twice
    written = docs(spark, folder).where(body().rlike(f"[^{T.SPACE_CHARS}]"))
    rows = written.select(F.col("doc_id").alias("prompt_id"), "lang", T.full_lines(body()).alias("l"))
    return rows.select("prompt_id", "lang", F.slice(l, 1, half).alias("e"), F.slice(l, half + 1, F.size(l)).alias("g")).select(
        "prompt_id", "lang", F.transform("e", expert).alias("experts"), F.transform("g", generated).alias("generated")
    )


def aligned(spark, folder):
    return E.aligned(prompts(spark, folder))


@query("expert_alignment", f"""WITH {SQL_EXPERTS}
SELECT doc_id AS prompt_id, expert_index::INT AS expert_index, family, points::INT AS points, match_label, generated_index::INT AS generated_index, polarity_match FROM al""")
def expert_alignment(spark, folder):
    return E.match_rows(aligned(spark, folder))


@query("generated_assessment", f"""WITH {SQL_EXPERTS}
SELECT doc_id AS prompt_id, generated_index::INT AS generated_index, family, precision_label FROM asg""")
def generated_assessment(spark, folder):
    return E.assessment_rows(aligned(spark, folder))


SQL_METRICS = """e AS (SELECT lang AS profile, count(*) AS expert_total, count(*) FILTER (match_label <> 'none') AS matched, count(*) FILTER (match_label = 'direct') AS direct,
  sum(abs(points)) FILTER (match_label <> 'none') AS mw, sum(abs(points)) AS w, count(polarity_match) AS pn, count(*) FILTER (polarity_match) AS po FROM al GROUP BY ALL),
g AS (SELECT lang AS profile, count(*) AS generated_total, count(*) FILTER (precision_label = 'aligned') AS aligned,
  count(*) FILTER (precision_label = 'broader_but_valid') AS broader, count(*) FILTER (precision_label = 'off_target') AS off_target FROM asg GROUP BY ALL)"""


@query("expert_recall", f"""WITH {SQL_EXPERTS}, {SQL_METRICS}
SELECT e.profile, expert_total, matched, direct, coalesce(generated_total, 0) AS generated_total, coalesce(aligned, 0) AS aligned, coalesce(off_target, 0) AS off_target,
  round(coalesce(mw, 0) / w::DOUBLE, 6) AS weighted_recall, round(matched / expert_total::DOUBLE, 6) AS expert_recall,
  round(coalesce((aligned + broader) / nullif(generated_total, 0)::DOUBLE, 0), 6) AS precision, round(coalesce(po / nullif(pn, 0)::DOUBLE, 0), 6) AS polarity_accuracy
FROM e LEFT JOIN g USING (profile)""")
def expert_recall(spark, folder):
    counts = E.prompt_counts(aligned(spark, folder)).withColumnRenamed("lang", "profile")
    out = E.expert_metrics(counts, ["profile"]).drop("examples")
    rates = ("weighted_recall", "expert_recall", "precision", "polarity_accuracy")
    return out.select(*[F.round(c, 6).alias(c) if c in rates else F.col(c) for c in out.columns])


@query("family_coverage", f"""WITH {SQL_EXPERTS}
SELECT family, count(*) AS expert_count, sum(abs(points))::BIGINT AS expert_weight, count(*) FILTER (match_label <> 'none') AS matched_count,
  coalesce(sum(abs(points)) FILTER (match_label <> 'none'), 0)::BIGINT AS matched_weight,
  round(coalesce(sum(abs(points)) FILTER (match_label <> 'none'), 0) / sum(abs(points))::DOUBLE, 6) AS weighted_recall,
  round(count(*) FILTER (match_label <> 'none') / count(*)::DOUBLE, 6) AS expert_recall FROM al GROUP BY family""")
def family_coverage(spark, folder):
    out = E.family_coverage(E.match_rows(aligned(spark, folder)))
    return out.withColumns({c: F.round(c, 6) for c in ("weighted_recall", "expert_recall")})


SQL_GAPS = """gaps AS (
  SELECT lang AS profile, family, 'gold' AS side, CASE match_label WHEN 'none' THEN 'missing_gold_criterion' ELSE 'too_coarse' END AS gap_type FROM al WHERE match_label <> 'direct'
  UNION ALL SELECT lang, family, 'generated', CASE precision_label WHEN 'off_target' THEN 'off_target' ELSE 'too_granular' END FROM asg
  WHERE precision_label IN ('off_target', 'valid_extra'))"""


def gap_rows(spark, folder):
    return E.gaps(aligned(spark, folder), "lang")


@query("granularity_gaps", f"""WITH {SQL_EXPERTS}, {SQL_GAPS}
SELECT profile, family, gap_type, count(*) AS gaps FROM gaps GROUP BY GROUPING SETS ((gap_type), (profile, gap_type), (family, gap_type))""")
def granularity_gaps(spark, folder):
    return E.gap_counts(gap_rows(spark, folder))


@query("calibration_hints", f"""WITH {SQL_EXPERTS}, {SQL_GAPS},
c AS (SELECT profile, family, count(*) FILTER (side = 'gold') AS missing, count(*) FILTER (side = 'generated') AS extra FROM gaps GROUP BY ALL)
SELECT *, missing >= 2 AS split_bias, extra >= 2 AS merge_bias, family IN ('other', 'content_coverage') AND extra >= 2 AS drop_family
FROM c WHERE missing >= 2 OR extra >= 2""")
def calibration_hints(spark, folder):
    return E.calibration_hints(gap_rows(spark, folder))


@query("dimension_bias", f"""WITH {SQL_EXPERTS}, {SQL_GAPS},
c AS (SELECT profile, gap_type AS dimension, family, count(*) AS n FROM gaps GROUP BY ALL)
SELECT * FROM c WHERE n >= 2 QUALIFY row_number() OVER (PARTITION BY profile, dimension ORDER BY n DESC, family) = 1""")
def dimension_bias(spark, folder):
    return E.dimension_bias(gap_rows(spark, folder).withColumnRenamed("gap_type", "dimension"))


SQL_POLICY = f"""rows AS (SELECT lang AS profile, prompt_id % 2 AS run, prompt_id, r FROM (SELECT doc_id AS prompt_id, lang, 1 AS r FROM documents)),
m AS (SELECT lang AS profile, doc_id % 2 AS run, count(DISTINCT doc_id) AS examples,
  round(coalesce(sum(abs(points)) FILTER (match_label <> 'none'), 0) / sum(abs(points))::DOUBLE, 9) AS wr,
  round(count(*) FILTER (match_label <> 'none') / count(*)::DOUBLE, 9) AS er FROM al GROUP BY ALL),
p AS (SELECT lang AS profile, doc_id % 2 AS run, round(count(*) FILTER (precision_label IN ('aligned', 'broader_but_valid')) / count(*)::DOUBLE, 9) AS pr,
  count(*) FILTER (precision_label = 'off_target') AS ot FROM asg GROUP BY ALL),
x AS (SELECT m.*, coalesce(pr, 0) AS pr, coalesce(ot, 0) AS ot FROM m LEFT JOIN p USING (profile, run)),
d AS (SELECT b.profile, a.examples, a.wr - b.wr AS wr, a.er - b.er AS er, a.pr - b.pr AS pr, (a.ot - b.ot)::DOUBLE AS ot FROM x a JOIN x b ON a.profile = b.profile AND a.run = 1 AND b.run = 0)"""


@query("profile_policy", f"""WITH {SQL_EXPERTS}, {SQL_POLICY}
SELECT profile, examples AS examples_scored, profile <> 'es' AND examples >= 5 AND wr >= 0 AND er >= 0 AND pr >= 0 AND ot <= 0 AS eligible,
  CASE WHEN profile = 'es' THEN 'protected_profile' WHEN examples < 5 THEN 'insufficient_heldout_examples'
    WHEN wr >= 0 AND er >= 0 AND pr >= 0 AND ot <= 0 THEN 'heldout_improvement'
    ELSE concat_ws(',', CASE WHEN wr < 0 THEN 'weighted_recall_regressed' END, CASE WHEN er < 0 THEN 'expert_recall_regressed' END,
      CASE WHEN pr < 0 THEN 'precision_regressed' END, CASE WHEN ot > 0 THEN 'off_target_increased' END) END AS reason,
  round(wr, 6) AS d_weighted_recall, round(er, 6) AS d_expert_recall, round(pr, 6) AS d_precision, ot AS d_off_target FROM d""")
def profile_policy(spark, folder):
    """Baseline against applied run (even and odd prompts) per profile."""
    counts = E.prompt_counts(aligned(spark, folder)).withColumnRenamed("lang", "profile")
    m = E.expert_metrics(counts.withColumn("run", F.col("prompt_id") % 2), ["profile", "run"]).select(
        "profile", "run", "examples", F.col("off_target").cast("double").alias("off_target"),
        *[F.round(c, 9).alias(c) for c in ("weighted_recall", "expert_recall", "precision")],
    )
    out = E.profile_policy(m.where("run = 0").drop("run"), m.where("run = 1").drop("run"), protected=("es",))
    return out.withColumns({c: F.round(c, 6) for c in ("d_weighted_recall", "d_expert_recall", "d_precision")})


# ---------------------------------------------------------- gates, audits

SQL_RESULTS = B.EVALS + f""",
res AS (SELECT candidate_id AS case_id, rubric_id, rubric_id IN ('r03', 'r10') AS hard,
  CASE WHEN sat = 1 THEN 'MET' WHEN rubric_id = 'r10' THEN 'CANNOT_ASSESS' ELSE 'UNMET' END AS verdict,
  CASE WHEN rubric_id <> 'r04' THEN sat::DOUBLE END AS score, sat,
  CASE WHEN rubric_id <> 'r01' THEN ((candidate_id * 3 + right(rubric_id, 2)::INT) % 10) / 10.0::DOUBLE END AS confidence,
  CASE rubric_id {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in BEHAVIOR.items())} END AS dimension FROM evals)"""


def criterion_results(spark, folder):
    dims = F.create_map(*[F.lit(x) for kv in BEHAVIOR.items() for x in kv])
    rid, ok = F.col("rubric_id"), F.col("satisfied")
    facts = B.evaluations(B.candidates(spark, folder))
    return facts.select(
        F.col("candidate_id").alias("case_id"), rid, rid.isin("r03", "r10").alias("hard"),
        F.when(ok, "MET").when(rid == "r10", "CANNOT_ASSESS").otherwise("UNMET").alias("verdict"),
        F.when(rid != "r04", ok.cast("double")).alias("score"),
        F.when(rid != "r01", ((F.col("candidate_id") * 3 + F.substring(rid, 2, 2).cast("int")) % 10) / F.lit(10.0)).alias("confidence"),
        dims[rid].alias("dimension"),
    )


SQL_CASES = """cs AS (SELECT case_id, bool_or(hard AND verdict = 'UNMET') AS unmet, bool_or(hard AND verdict = 'CANNOT_ASSESS') AS unknown,
  bool_or(verdict = 'CANNOT_ASSESS') AS any_unknown, bool_or(hard AND verdict <> 'MET') AS hard_failed,
  avg(coalesce(score, sat)) FILTER (NOT hard) AS soft_mean, avg(confidence) AS avg_confidence FROM res GROUP BY case_id),
cd AS (SELECT *, CASE WHEN unmet THEN 'do_not_train' WHEN unknown THEN 'repair' WHEN soft_mean < 0.55::DOUBLE THEN 'repair' ELSE 'sft_include' END AS overall_decision FROM cs)"""


@query("hard_soft_gate", f"""WITH {SQL_RESULTS}, {SQL_CASES}
SELECT case_id, hard_failed, round(soft_mean, 6) AS soft_mean, overall_decision,
  CASE overall_decision WHEN 'sft_include' THEN 'gold_sft' ELSE overall_decision END AS training_bucket FROM cd""")
def hard_soft_gate(spark, folder):
    out = A.criterion_outcomes(criterion_results(spark, folder), 0.55)
    return out.select("case_id", "hard_failed", F.round("soft_mean", 6).alias("soft_mean"), "overall_decision", "training_bucket")


@query("dimension_scores", f"""WITH {SQL_RESULTS}
SELECT case_id, dimension, sum(coalesce(score, 0.0)) AS earned, count(*) AS criteria, round(sum(coalesce(score, 0.0)) / count(*), 6) AS normalized FROM res GROUP BY ALL""")
def dimension_scores(spark, folder):
    return A.dimension_scores(criterion_results(spark, folder)).withColumn("normalized", F.round("normalized", 6))


@query("review_queue", f"""WITH {SQL_RESULTS}, {SQL_CASES},
h AS (SELECT case_id, bool_or(hard AND rubric_id = 'r03' AND sat = 0) AS h_failed, avg(sat) FILTER (NOT hard) AS sm FROM res GROUP BY ALL),
hd AS (SELECT *, CASE WHEN h_failed THEN 'do_not_train' WHEN sm < 0.55::DOUBLE THEN 'repair' ELSE 'sft_include' END AS h_overall FROM h),
r AS (SELECT case_id, concat_ws(',', CASE WHEN any_unknown THEN 'llm_cannot_assess' END, CASE WHEN round(avg_confidence, 9) < 0.4::DOUBLE THEN 'low_llm_confidence' END,
  CASE WHEN overall_decision <> h_overall OR hard_failed <> h_failed THEN 'judge_disagreement' END) AS reasons FROM cd JOIN hd USING (case_id))
SELECT case_id, reasons FROM r""")
def review_queue(spark, folder):
    """Model results against a heuristic that never abstains."""
    results = criterion_results(spark, folder)
    model = A.criterion_outcomes(results, 0.55).withColumn("avg_confidence", F.round("avg_confidence", 9))
    plain = results.withColumn("hard", F.col("rubric_id") == "r03").where(F.col("rubric_id") != "r10").withColumn(
        "score", (F.col("verdict") == "MET").cast("double")
    )
    return A.review_reasons(model, A.criterion_outcomes(plain, 0.55), low=0.4).select("case_id", "reasons")


WEIGHTS = {"mmlu-pro": 0.4, "livebench-reasoning": 0.3, "livebench-math": 0.2, "livecodebench": 0.1}
HARD = {"livebench-reasoning": 1.0, "livecodebench": 1.0}


def _sql_weight(w):
    return "CASE family " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in w.items()) + " END::DOUBLE"


SQL_AUDIT = f"""{Q.PAIRS},
r AS (SELECT 'uniform' AS label, source AS run, source_family AS family, label AS gold, uniform_decision AS d, uniform_decision AS u, exact_task, parsed_a AND parsed_b AS parsed, agree FROM pairs
  UNION ALL SELECT 'adjusted', source, source_family, label, CASE WHEN pts_a > pts_b THEN 'A>B' WHEN pts_a < pts_b THEN 'B>A' ELSE 'A=B' END, uniform_decision, exact_task, parsed_a AND parsed_b, agree FROM pairs),
fam AS (SELECT label, run, family, 100.0::DOUBLE * count(*) FILTER (d = gold) / count(*) AS acc FROM r GROUP BY ALL),
fw AS (SELECT label, run, min(acc) AS worst_wu, arg_min(family, (acc, family)) AS worst_family, stddev_pop(acc) AS fold_stddev,
  sum(acc * {_sql_weight(WEIGHTS)}) / sum({_sql_weight(WEIGHTS)}) AS target, sum(acc * {_sql_weight(HARD)}) / sum({_sql_weight(HARD)}) AS hard FROM fam GROUP BY ALL),
ov AS (SELECT label, run, 100.0::DOUBLE * count(*) FILTER (d = gold) / count(*) AS wu, 100.0::DOUBLE * count(*) FILTER (u = gold) / count(*) AS uni,
  count(*) FILTER (d <> gold) AS fails, count(*) FILTER (d <> gold AND exact_task) AS exact, count(*) FILTER (d <> gold AND d = 'A=B') AS ties, count(*) AS n,
  coalesce(count(*) FILTER (exact_task AND parsed) / nullif(count(*) FILTER (exact_task), 0)::DOUBLE, 0) AS parser,
  count(*) FILTER (agree < 8) / count(*)::DOUBLE AS focus, coalesce(count(*) FILTER (agree >= 8 AND d = gold) / nullif(count(*) FILTER (agree >= 8), 0)::DOUBLE, 1) AS lowc FROM r GROUP BY ALL),
runs AS (SELECT *, coalesce(hard, wu) AS hard2 FROM ov JOIN fw USING (label, run)),
ag AS (SELECT label, count(*) AS run_count, avg(wu) AS mwu, avg(uni) AS muni, avg(target) AS mt, avg(hard2) AS mh, avg(focus) AS mf, avg(parser) AS mp, avg(lowc) AS ml,
  avg(fold_stddev) AS mfs, stddev_pop(wu) AS rsd, avg(wu - uni) AS gap, min(worst_wu) AS worst, max(fails) AS mxf, max(fails / n::DOUBLE) AS fr, max(exact / n::DOUBLE) AS er, max(ties / n::DOUBLE) AS tr FROM runs GROUP BY label),
pen AS (SELECT *, greatest(0, 50 - worst) * 2.0 + greatest(0, gap - 3) * 1.0 + greatest(0, (fr - 0.6) * 100) * 0.5 + greatest(0, (er - 0.4) * 100) * 0.35 + greatest(0, (tr - 0.2) * 100) * 0.5
  + mfs * 0.25 + rsd * 0.5 + greatest(0, 0.75 - mf) * 8.0 + greatest(0, 0.65 - mp) * 6.0 + greatest(0, 0.65 - ml) * 5.0 AS penalty FROM ag)"""


def run_records(spark, folder):
    """Per (configuration, run): accuracies, failures and rates."""
    base = Q.pair_rows(spark, folder).select(
        "source", "source_family", F.col("label").alias("gold"), "uniform_decision",
        D.compare(F.col("score_a"), F.col("score_b")).alias("adjusted"), "exact_task",
        (F.col("parsed_a") & F.col("parsed_b")).alias("parsed"), "unstable",
    )
    kinds = F.array(*[F.struct(F.lit(n).alias("label"), F.col(c).alias("d")) for n, c in (("uniform", "uniform_decision"), ("adjusted", "adjusted"))])
    rows = base.select(F.col("source").alias("run"), F.col("source_family").alias("family"), "gold", "uniform_decision",
                       "exact_task", "parsed", "unstable", F.inline(kinds))
    keys = ["label", "run"]
    right, failed = F.col("d") == F.col("gold"), F.col("d") != F.col("gold")

    def n(c):
        return F.count(F.when(c, 1))

    every = F.count(F.lit(1))
    fam = rows.groupBy(*keys, "family").agg((n(right) * 100.0 / every).alias("accuracy"))
    overall = rows.groupBy(*keys).agg(
        (n(right) * 100.0 / every).alias("overall_wu"),
        (n(F.col("uniform_decision") == F.col("gold")) * 100.0 / every).alias("overall_uniform"),
        n(failed).alias("failure_count"), n(failed & F.col("exact_task")).alias("exact_failures"),
        n(failed & (F.col("d") == D.EVEN)).alias("tie_failures"),
        T.ratio(n(failed), every).alias("failure_rate"), T.ratio(n(failed & F.col("exact_task")), every).alias("exact_rate"),
        T.ratio(n(failed & (F.col("d") == D.EVEN)), every).alias("tie_rate"),
        T.ratio(n(F.col("exact_task") & F.col("parsed")), n(F.col("exact_task"))).alias("parser_rate"),
        T.ratio(n(~F.col("unstable")), every).alias("focus_coverage"),
        T.ratio(n(F.col("unstable") & right), n(F.col("unstable")), 1.0).alias("low_confidence"),
    )
    worst = fam.groupBy(*keys).agg(F.min(F.struct("accuracy", "family")).alias("w"), F.stddev_pop("accuracy").alias("fold_stddev"))
    tagged = fam.join(overall.select(*keys, "overall_wu"), keys)
    target = A.weighted_family(tagged, WEIGHTS, keys, "overall_wu").withColumnRenamed("weighted", "target_wu")
    hard = A.weighted_family(tagged, HARD, keys, "overall_wu").withColumnRenamed("weighted", "hard_wu")
    return overall.join(worst, keys).join(target, keys).join(hard, keys).withColumns(
        {"worst_family_wu": F.col("w.accuracy"), "worst_family": F.col("w.family")}
    ).drop("w")


@query("selection_audit", f"""WITH {SQL_AUDIT}
SELECT label, run_count, round(mwu, 6) AS mean_overall_wu, round(mt, 6) AS mean_target_wu, round(mh, 6) AS mean_hard_wu, round(worst, 6) AS worst_family_wu,
  round(rsd, 6) AS run_wu_stdev, mxf AS max_failure_count, round(penalty, 5) AS penalty,
  round(mwu * 0.40 + mt * 0.20 + mh * 0.15 + worst * 0.20 + mwu * 0.05 - penalty, 5) AS selection_score,
  worst >= 50 AND gap <= 3 AND mf >= 0.75 AND mp >= 0.65 AND ml >= 0.65 AND fr <= 0.6 AND er <= 0.4 AND tr <= 0.2 AS passes_all FROM pen""")
def selection_audit(spark, folder):
    agg = A.aggregate_runs(run_records(spark, folder))
    out = A.selection_score(agg, 50.0, 3.0, 0.6, 0.4, 0.2)
    return out.select(
        "label", "run_count", *[F.round(c, 6).alias(c) for c in ("mean_overall_wu", "mean_target_wu", "mean_hard_wu", "worst_family_wu", "run_wu_stdev")],
        "max_failure_count", F.round("penalty", 5).alias("penalty"), F.round("selection_score", 5).alias("selection_score"), "passes_all",
    )


@query("promotion_gates", f"""WITH {Q.JUDGED},
x AS (SELECT source_family AS f, label, CASE WHEN pts_a > pts_b THEN 'A>B' WHEN pts_a < pts_b THEN 'B>A' ELSE 'A=B' END AS d, exact_task, v_triggered, routed, order_consistent FROM judged),
e AS (SELECT 100.0::DOUBLE * sum(correct_count) / sum(pair_count) AS external FROM ({SQL['external_slices']})),
s AS (SELECT 100.0::DOUBLE * count(*) FILTER (d = label) / count(*) AS overall, 100.0::DOUBLE * count(*) FILTER (d = label AND f = 'mmlu-pro') / count(*) FILTER (f = 'mmlu-pro') AS mmlu,
  100.0::DOUBLE * count(*) FILTER (d = label AND f = 'livebench-reasoning') / count(*) FILTER (f = 'livebench-reasoning') AS reasoning,
  100.0::DOUBLE * count(*) FILTER (d = label AND f = 'livebench-math') / count(*) FILTER (f = 'livebench-math') AS math,
  count(*) FILTER (d <> label AND d = 'A=B') / count(*)::DOUBLE AS tie, count(*) FILTER (d <> label AND exact_task) / count(*)::DOUBLE AS exact,
  count(*) FILTER (v_triggered AND f = 'livebench-reasoning') / count(*) FILTER (f = 'livebench-reasoning')::DOUBLE AS trig,
  coalesce(count(*) FILTER (routed AND NOT order_consistent) / nullif(count(*) FILTER (routed), 0)::DOUBLE, 0) AS torn FROM x)
SELECT 'overall_wu' AS gate, round(overall, 6) AS value, overall >= 86 AS passed FROM s UNION ALL SELECT 'mmlu_pro_wu', round(mmlu, 6), mmlu >= 82 FROM s
UNION ALL SELECT 'reasoning_wu', round(reasoning, 6), reasoning >= 82 FROM s UNION ALL SELECT 'math_wu', round(math, 6), math >= 82 FROM s
UNION ALL SELECT 'tie_failure_rate', round(tie, 6), tie <= 0.05::DOUBLE FROM s UNION ALL SELECT 'exact_answer_failure_rate', round(exact, 6), exact <= 0.06::DOUBLE FROM s
UNION ALL SELECT 'reasoning_verifier_trigger_rate', round(trig, 6), trig >= 0.10::DOUBLE FROM s
UNION ALL SELECT 'discriminator_order_disagreement_rate', round(torn, 6), torn <= 0.05::DOUBLE FROM s
UNION ALL SELECT 'external_slice_wu', round(external, 6), external >= 75 FROM e""")
def promotion_gates(spark, folder):
    """Gate table of one run; the external slice gate is absent when there is no slice."""
    rows = Q.judged(spark, folder).select(
        "source_family", "label", F.col("scored").alias("d"), "exact_task",
        F.col("verifier.triggered").alias("t"), "routed", (F.col("routed") & ~F.col("disc_consistent")).alias("torn"),
    )
    right, failed = F.col("d") == F.col("label"), F.col("d") != F.col("label")

    def n(c):
        return F.count(F.when(c, 1))

    def acc(family):
        mine = F.col("source_family") == family
        return T.ratio(n(right & mine), n(mine)) * 100.0

    reasoning = F.col("source_family") == "livebench-reasoning"
    summary = rows.agg(
        F.count(F.lit(1)).alias("pair_count"), (n(right) * 100.0 / F.count(F.lit(1))).alias("overall"),
        acc("mmlu-pro").alias("mmlu"), acc("livebench-reasoning").alias("reasoning"), acc("livebench-math").alias("math"),
        n(failed & (F.col("d") == D.EVEN)).alias("tie_failures"), n(failed & F.col("exact_task")).alias("exact_failures"),
        T.ratio(n(reasoning & F.col("t")), n(reasoning)).alias("reasoning_trigger"),
        T.ratio(n(F.col("torn")), n(F.col("routed"))).alias("disagreement"),
    )
    external = external_slices(spark, folder).agg((F.sum("correct_count") * 100.0 / F.sum("pair_count")).alias("external"))
    both = summary.unionByName(external, allowMissingColumns=True)  # two single rows become one
    summary = both.agg(*[F.max(c).alias(c) for c in both.columns])
    return A.promotion_gates(summary).withColumn("value", F.round("value", 6))
