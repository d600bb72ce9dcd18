"""Text function queries over whole documents, pages and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from verdikt.functions import decisions as D
from verdikt.functions import rubrics as X
from verdikt.functions import text as T
from verdikt.plans import base as B
from verdikt.plans.registry import query

def body():
    return F.col("text")


def docs(spark, folder):
    return B.table(spark, folder, "documents")


def _truncated(e="text"):
    parts = (f"list_filter(list_transform(regexp_split_to_array({e}, '\\n\\s*\\n'), lambda x: {B.sql_strip('x')}), "
             "lambda x: x <> '')")
    return B.sql_strip(f"array_to_string(list_slice({parts}, 1, greatest(1, len({parts}) // 2)), chr(10) || chr(10))")


def _no_plan(e="text"):
    kept = f"list_filter({B.sql_lines(e)}, lambda x: NOT regexp_matches(x, '(?i){X.PLAN_WORDS}'))"
    return B.sql_strip(
        f"regexp_replace({B.sql_strip(f'array_to_string({kept}, chr(10))')}, '\\b\\d+(\\.\\d+)?\\b', '[unspecified]', 'g')"
    )


@query("truncate_half", f"""WITH t AS (SELECT doc_id, {_truncated()} AS x FROM documents)
SELECT doc_id, length(x) AS chars, md5(x) AS digest FROM t""")
def truncate_half(spark, folder):
    x = X.truncate_half(body())
    return docs(spark, folder).select("doc_id", x.alias("x")).select(
        "doc_id", F.length("x").cast("bigint").alias("chars"), F.md5("x").alias("digest")
    )


@query("synthetic_degradations", f"""WITH t AS (SELECT doc_id, text, {_no_plan()} AS bare FROM documents),
v AS (SELECT doc_id, 'weak_truncate' AS kind, {_truncated()} AS x FROM t
  UNION ALL SELECT doc_id, 'weak_remove_plan', bare FROM t UNION ALL SELECT doc_id, 'weak_short', {_truncated('bare')} FROM t)
SELECT doc_id, kind, length(x) AS chars, md5(x) AS digest FROM v WHERE x <> ''""")
def synthetic_degradations(spark, folder):
    """Three weak variants per text, expanded inside the row."""
    base = docs(spark, folder).select("doc_id", "text", X.remove_plan_details(body()).alias("bare"))
    kinds = [("weak_truncate", X.truncate_half(body())), ("weak_remove_plan", F.col("bare")),
             ("weak_short", X.truncate_half(F.col("bare")))]
    rows = F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("x")) for k, v in kinds])
    return base.select("doc_id", F.inline(rows)).where(F.col("x") != "").select(
        "doc_id", "kind", F.length("x").cast("bigint").alias("chars"), F.md5("x").alias("digest")
    )


DROP = r"(?i)(^|\s)(the|les|und|los)(\s|$)"


@query("drop_lines_mutation", f"""WITH t AS (SELECT doc_id, text, {B.sql_lines('text')} AS ls FROM documents),
u AS (SELECT *, array_to_string(list_filter(ls, lambda x: NOT regexp_matches(x, '{DROP}')), chr(10)) AS kept,
  len(list_filter(ls, lambda x: regexp_matches(x, '{DROP}'))) AS gone FROM t),
v AS (SELECT doc_id, text, CASE WHEN gone = 0 OR {B.sql_strip('kept')} = '' THEN text ELSE kept END AS x FROM u)
SELECT doc_id, length(x) AS chars, md5(x) AS digest, x <> text AS changed FROM v""")
def drop_lines_mutation(spark, folder):
    return docs(spark, folder).select("doc_id", "text", X.drop_lines(body(), DROP).alias("x")).select(
        "doc_id", F.length("x").cast("bigint").alias("chars"), F.md5("x").alias("digest"),
        (F.col("x") != body()).alias("changed"),
    )


@query("certainty_mutation", f"""WITH t AS (SELECT doc_id, trim(regexp_replace(text, '{B.RE2_SPACE}+\\z', '') ||
  '{X.CERTAINTY_ADDENDUM}', '{T.SPACE_CHARS}') AS x FROM documents)
SELECT doc_id, length(x) AS chars, md5(x) AS digest FROM t""")
def certainty_mutation(spark, folder):
    return docs(spark, folder).select("doc_id", X.inflate_certainty(body()).alias("x")).select(
        "doc_id", F.length("x").cast("bigint").alias("chars"), F.md5("x").alias("digest")
    )


def _norm(e):
    return f"array_to_string({B.sql_tokens(f'translate({e}, chr(95), chr(32))')}, ' ')"


@query("line_delta", f"""WITH t AS (SELECT doc_id, {B.sql_full_lines('text')} AS s, {B.sql_full_lines(_truncated())} AS w FROM documents),
n AS (SELECT *, list_transform(s, lambda x: {_norm('x')}) AS sn, list_transform(w, lambda x: {_norm('x')}) AS wn FROM t),
o AS (SELECT doc_id, list_filter(s, lambda x: {_norm('x')} <> '' AND NOT list_contains(wn, {_norm('x')})) AS so,
  list_filter(w, lambda x: {_norm('x')} <> '' AND NOT list_contains(sn, {_norm('x')})) AS wo FROM n)
SELECT doc_id, len(so) AS strong_only, len(wo) AS weak_only, md5(array_to_string(so, chr(10))) AS digest FROM o""")
def line_delta(spark, folder):
    """Lines lost between a text and its truncated variant."""
    d = docs(spark, folder).select("doc_id", X.line_delta(body(), X.truncate_half(body())).alias("d"))
    return d.select(
        "doc_id", F.size("d.strong_only").cast("bigint").alias("strong_only"),
        F.size("d.weak_only").cast("bigint").alias("weak_only"),
        F.md5(F.array_join("d.strong_only", "\n")).alias("digest"),
    )


SQL_LINES = f"""ls AS (SELECT doc_id, {B.sql_full_lines('text')} AS l FROM documents),
line AS (SELECT doc_id, unnest(l) AS raw, generate_subscripts(l, 1) AS ord FROM ls),
req AS (SELECT doc_id, ord, CASE WHEN ord % 2 = 1 THEN 'The note includes ' ELSE 'Note avoids ' END || raw AS text FROM line)"""


def _sql_list(values):
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def requirements(spark, folder):
    """Lines of a document as the rubric texts of one example, kept in the row."""
    rows = F.transform(
        T.full_lines(body()),
        lambda x, i: F.concat(F.when(i % 2 == 0, "The note includes ").otherwise("Note avoids "), x),
    )
    return docs(spark, folder).select("doc_id", rows.alias("reqs"))


@query("rubric_conflicts", f"""WITH {SQL_LINES},
tok AS (SELECT doc_id, ord, CASE WHEN ord % 2 = 1 THEN 'positive' ELSE 'negative' END AS pol,
  list_distinct(list_filter(regexp_split_to_array(regexp_replace(lower({B.sql_squeeze('text')}), '[^a-z0-9\\s]', ' ', 'g'), '\\s+'),
    lambda t: length(t) > 2 AND NOT list_contains({_sql_list(X.RUBRIC_STOPWORDS)}, t))) AS toks,
  list_distinct({B.sql_words(f"lower({B.sql_squeeze('text')})")}) AS ws FROM req),
p AS (SELECT n.doc_id, n.ord,
  bool_or(len(list_intersect(n.ws, o.ws)) / (len(n.ws) + len(o.ws) - len(list_intersect(n.ws, o.ws)))::DOUBLE >= 0.7::DOUBLE) AS ov,
  bool_or(n.pol <> o.pol AND len(n.toks) > 0 AND len(o.toks) > 0
    AND len(list_intersect(n.toks, o.toks)) / greatest(1, least(len(n.toks), len(o.toks)))::DOUBLE >= 0.6::DOUBLE) AS cf
  FROM tok n JOIN tok o ON n.doc_id = o.doc_id AND o.ord < n.ord GROUP BY ALL)
SELECT d.doc_id, len(l) AS lines, count(*) FILTER (ov) AS overlapping, count(*) FILTER (cf) AS conflicting
FROM ls d LEFT JOIN p ON p.doc_id = d.doc_id GROUP BY d.doc_id, len(l)""")
def rubric_conflicts(spark, folder):
    """Per example: requirements that overlap or contradict an earlier one.

    The bank of one example lives in one row, so the comparison needs no
    shuffle and no pair ever becomes a row.
    """
    rows = F.transform("reqs", lambda x: F.struct(
        X.polarity(x).alias("pol"), X.content_tokens(x).alias("tok"), X.word_set(x).alias("ws")))
    bank = requirements(spark, folder).select("doc_id", rows.alias("bank"))

    def hits(test):
        return F.size(F.filter(
            F.transform("bank", lambda n, i: F.exists(F.slice(F.col("bank"), 1, i), lambda o: test(n, o))),
            lambda h: h,
        )).cast("bigint")

    return bank.select(
        "doc_id", F.size("bank").cast("bigint").alias("lines"),
        hits(lambda n, o: X.overlaps(n["ws"], o["ws"])).alias("overlapping"),
        hits(lambda n, o: X.conflicts(n["pol"], n["tok"], o["pol"], o["tok"])).alias("conflicting"),
    )


RUBRIC_REPLY = "CASE WHEN doc_id % 3 = 0 THEN '<RUBRIC> ' || replace(text, chr(10), ' </RUBRIC> x <rubric>') || ' </RUBRIC>' ELSE '- 1. ' || text END"


@query("extract_rubrics", f"""WITH t AS (SELECT doc_id, {RUBRIC_REPLY} AS r FROM documents),
x AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN
    list_filter(list_transform(regexp_extract_all(r, '(?is)<RUBRIC>\\s*(.*?)\\s*</RUBRIC>', 1), lambda e: {B.sql_squeeze('e')}), lambda e: e <> '')
  ELSE list_transform(list_filter(list_transform({B.sql_lines('r')}, lambda e: {B.sql_strip("regexp_replace(e, '^[-*0-9.)' || chr(92) || 's]+', '')")}),
    lambda e: length(e) >= 12), lambda e: {B.sql_squeeze('e')}) END AS rs FROM t)
SELECT doc_id, len(rs) AS rubrics, md5(array_to_string(rs, chr(10))) AS digest FROM x""")
def extract_rubrics(spark, folder):
    rows = docs(spark, folder).select("doc_id", X.extract_rubrics(F.expr(RUBRIC_REPLY)).alias("rs"))
    return rows.select(
        "doc_id", F.size("rs").cast("bigint").alias("rubrics"), F.md5(F.array_join("rs", "\n")).alias("digest")
    )


REPLY = """CASE event_type WHEN 'click' THEN concat('{"verdict": "', CASE WHEN value > 50 THEN 'yes' ELSE 'No' END, '"}')
  WHEN 'view' THEN concat('<EVALUATION> ', CASE WHEN value > 40 THEN 'pass' ELSE 'fail' END, ' </EVALUATION>')
  WHEN 'error' THEN concat('```json', chr(10), '{"label": "', CASE WHEN value > 30 THEN 'TRUE' ELSE 'n' END, '"}', chr(10), '```')
  WHEN 'signup' THEN CASE WHEN value > 20 THEN 'Yes it does' ELSE 'no' END ELSE concat('see ', props, ' end') END"""


@query("parse_verdicts", f"""WITH t AS (SELECT event_id, event_type, {REPLY} AS r FROM events),
j AS (SELECT *, regexp_extract(r, '(?s)\\{{.*\\}}') AS obj FROM t),
v AS (SELECT event_id, CASE WHEN event_type IN ('click', 'error')
    THEN upper(coalesce(json_extract_string(obj, '$.verdict'), json_extract_string(obj, '$.label')))
  WHEN event_type = 'view' THEN upper(regexp_extract(r, '<EVALUATION>\\s*(.*?)\\s*</EVALUATION>', 1))
  ELSE upper(string_split(r, ' ')[1]) END AS w FROM j)
SELECT event_id, CASE WHEN w IN ('YES', 'Y', 'TRUE', 'PASS') THEN true WHEN w IN ('NO', 'N', 'FALSE', 'FAIL') THEN false END AS verdict FROM v""")
def parse_verdicts(spark, folder):
    replies = B.table(spark, folder, "events").select("event_id", F.expr(REPLY).alias("r"))
    return replies.select("event_id", X.parse_yes_no(F.col("r")).alias("verdict"))


@query("json_replies", """WITH t AS (SELECT event_id, regexp_extract('reply: ' || props || ' done', '(?s)\\{.*\\}') AS obj FROM events)
SELECT event_id, json_extract_string(obj, '$.k')::BIGINT AS k FROM t""")
def json_replies(spark, folder):
    reply = F.concat(F.lit("reply: "), F.col("props"), F.lit(" done"))
    return B.table(spark, folder, "events").select(
        "event_id", F.get_json_object(X.json_object(reply), "$.k").cast("bigint").alias("k")
    )


def _sql_profiles(profiles, test):
    arms = " ".join(f"WHEN {test(cues)} THEN '{name}'" for name, cues in profiles)
    return f"CASE {arms} ELSE '{X.DEFAULT_PROFILE}' END"


def _sql_words_any(cues):
    return "regexp_matches(low, '" + "|".join(T.word_bound(c).replace("'", "''") for c in cues) + "')"


@query("profile_routing", f"""WITH t AS (SELECT page_id, lower(html) AS low FROM pages)
SELECT page_id, {_sql_profiles(X.SUBSTRING_PROFILES, lambda cues: '(' + ' OR '.join(f"contains(low, '{c}')" for c in cues) + ')')} AS by_substring,
  {_sql_profiles(X.WORD_PROFILES, _sql_words_any)} AS by_words FROM t""")
def profile_routing(spark, folder):
    """The two routers differ by design: substrings against whole words."""
    return B.table(spark, folder, "pages").select(
        "page_id", X.profile_by_substring(F.col("html")).alias("by_substring"),
        X.profile_by_words(F.col("html")).alias("by_words"),
    )


SALIENT = "translate(text, chr(95), chr(32))"


@query("salient_terms", f"""WITH t AS (SELECT doc_id, list_filter({B.sql_tokens(SALIENT)},
    lambda t: length(t) >= 4 AND NOT list_contains({_sql_list(X.DISCOVERY_STOPWORDS)}, t)) AS k FROM documents),
g AS (SELECT doc_id, list_concat(
    list_transform(range(1, len(k) - 1), lambda i: k[i] || ' ' || k[i + 1] || ' ' || k[i + 2]),
    list_transform(range(1, len(k)), lambda i: k[i] || ' ' || k[i + 1]), list_filter(k, lambda t: length(t) >= 7)) AS p FROM t),
u AS (SELECT doc_id, unnest(p) AS term, generate_subscripts(p, 1) AS ord FROM g),
f AS (SELECT doc_id, term, min(ord) AS ord FROM u GROUP BY ALL)
SELECT doc_id, array_to_string(list(term ORDER BY ord)[1:18], ', ') AS terms FROM f GROUP BY doc_id""")
def salient_terms(spark, folder):
    rows = docs(spark, folder).select("doc_id", X.salient_terms(body()).alias("t"))
    return rows.where(F.size("t") > 0).select("doc_id", F.array_join("t", ", ").alias("terms"))


@query("decomposition_reasons", f"""WITH t AS (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'completeness' ELSE 'structure' END AS dim,
  {B.sql_squeeze('text')} AS req FROM documents),
m AS (SELECT *, lower(req) AS low, len(list_filter(regexp_split_to_array('item ' || req, '[^a-z0-9]+'), lambda w: w <> '')) AS words FROM t)
SELECT doc_id, CASE WHEN dim = 'completeness' THEN 'generic_dimension_broad_requirement'
  WHEN (length(low) - length(replace(low, ' and ', ''))) / 5 + (length(low) - length(replace(low, ';', ''))) + (length(low) - length(replace(low, ', ', ''))) / 2 >= 2
    THEN 'compound_requirement' WHEN words >= 18 THEN 'long_requirement' END AS reason FROM m""")
def decomposition_reasons(spark, folder):
    dim = F.when(F.col("doc_id") % 4 == 0, "completeness").otherwise("structure")
    return docs(spark, folder).select(
        "doc_id", X.decomposition_reason(dim, F.lit("item"), T.squeeze(body())).alias("reason")
    )


@query("severity_mapping", """WITH t AS (SELECT event_type, CASE event_type WHEN 'click' THEN ' Hard_Gate ' WHEN 'view' THEN 'HIGH'
  WHEN 'error' THEN 'medium-high' WHEN 'signup' THEN 'medium' ELSE 'low' END AS raw FROM events),
m AS (SELECT raw, CASE WHEN contains(lower(raw), 'hard_gate') THEN 'catastrophic' WHEN contains(lower(raw), 'high') THEN 'essential'
  WHEN contains(lower(raw), 'medium') THEN 'important' ELSE 'optional' END AS tier FROM t)
SELECT raw, tier, CASE tier WHEN 'catastrophic' THEN 'essential' ELSE tier END AS capped, count(*) AS n FROM m GROUP BY ALL""")
def severity_mapping(spark, folder):
    raw = F.expr("CASE event_type WHEN 'click' THEN ' Hard_Gate ' WHEN 'view' THEN 'HIGH' WHEN 'error' THEN 'medium-high' "
                 "WHEN 'signup' THEN 'medium' ELSE 'low' END")
    rows = B.table(spark, folder, "events").select(raw.alias("raw"))
    tiers = rows.withColumn("tier", X.severity_tier(F.col("raw"))).withColumn("capped", X.capped_tier(F.col("tier")))
    return tiers.groupBy("raw", "tier", "capped").agg(F.count(F.lit(1)).alias("n"))


ANSWERS = """CASE conv_id % 5 WHEN 0 THEN concat(text, chr(10), 'FINAL_ANSWER: ', chr((65 + turn % 4)::INT))
  WHEN 1 THEN concat(text, ' so ', repeat(chr((65 + turn % 4)::INT), 5), '.') WHEN 2 THEN concat('The answer is (', chr((97 + turn % 4)::INT), ') ', text)
  WHEN 3 THEN concat(text, ' (B) and then (', chr((65 + turn % 4)::INT), ')') ELSE text END"""
REPEATED = "|".join(f"{c}{c}{c}{c}{c}+" for c in "ABCDEFGHIJ")


@query("answer_letters", f"""WITH t AS (SELECT conv_id, turn, {ANSWERS} AS r FROM conversations),
x AS (SELECT *, regexp_extract(r, '(?i)FINAL[_\\s]?ANSWER\\s*[:\\-]\\s*([A-Za-z])\\b', 1) AS a,
  left(regexp_extract(r, '\\b({REPEATED}|{REPEATED.lower()})\\b'), 1) AS b,
  regexp_extract(r, '(?i)(?:final\\s+answer|the\\s+answer\\s+is|answer\\s*[:\\-])\\s*[:\\-]?\\s*\\(?([A-Ja-j])\\)?', 1) AS c,
  coalesce(regexp_extract_all(right(r, 500), '\\(([A-Ja-j])\\)', 1)[-1], '') AS d FROM t)
SELECT conv_id, turn, upper(CASE WHEN a <> '' THEN a WHEN b <> '' THEN b WHEN c <> '' THEN c ELSE d END) AS letter FROM x""")
def answer_letters(spark, folder):
    r = F.expr(ANSWERS.replace("::INT", "").replace("(65 + turn % 4)", "65 + turn % 4").replace("(97 + turn % 4)", "97 + turn % 4"))
    return B.table(spark, folder, "conversations").select("conv_id", "turn", X.answer_letter(r).alias("letter"))


def _value(e):
    return (f"lower({B.sql_squeeze(f'trim({e}, chr(96) || chr(42) || chr(95) || chr(32) || chr(9) || chr(13) || chr(10) || {chr(39)}.,:;!?{chr(34)}{chr(39)} || chr(39))')})")


@query("exact_answers", f"""WITH t AS (SELECT conv_id, turn, {B.sql_full_lines('text')} AS l FROM conversations),
u AS (SELECT conv_id, turn, CASE WHEN len(l) > 0 THEN l[-1] ELSE '' END AS last_line FROM t),
w AS (SELECT *, CASE WHEN turn % 2 = 0 THEN '**' || last_line || '**' ELSE '``` ' || last_line || ' ```' END AS answer FROM u)
SELECT conv_id, turn, md5(last_line) AS line_digest, md5({_value('answer')}) AS value_digest FROM w""")
def exact_answers(spark, folder):
    line = B.table(spark, folder, "conversations").select("conv_id", "turn", X.last_line(body()).alias("l"))
    wrapped = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("**"), F.col("l"), F.lit("**"))).otherwise(
        F.concat(F.lit("``` "), F.col("l"), F.lit(" ```"))
    )
    return line.select(
        "conv_id", "turn", F.md5("l").alias("line_digest"), F.md5(X.exact_answer_value(wrapped)).alias("value_digest")
    )


@query("answer_modes", """WITH t AS (SELECT event_type, CASE event_type WHEN 'click' THEN 'Give a **bold** word' WHEN 'view' THEN 'a single digit'
  WHEN 'error' THEN 'One SINGLE PHRASE' WHEN 'signup' THEN 'single string please' ELSE 'pick one' END AS q,
  CASE WHEN user_id % 2 = 0 THEN 'CCC' ELSE 'abc' END AS ref FROM events)
SELECT q, ref, CASE WHEN ref = 'CCC' THEN 'repeated_choice' WHEN contains(lower(q), 'bold') THEN 'decorated_span'
  WHEN contains(lower(q), 'single digit') THEN 'single_digit' WHEN contains(lower(q), 'single phrase') THEN 'single_phrase'
  WHEN contains(lower(q), 'single string') THEN 'single_word' ELSE '' END AS mode, count(*) AS n FROM t GROUP BY ALL""")
def answer_modes(spark, folder):
    q = F.expr("CASE event_type WHEN 'click' THEN 'Give a **bold** word' WHEN 'view' THEN 'a single digit' "
               "WHEN 'error' THEN 'One SINGLE PHRASE' WHEN 'signup' THEN 'single string please' ELSE 'pick one' END")
    ref = F.when(F.col("user_id") % 2 == 0, "CCC").otherwise("abc")
    rows = B.table(spark, folder, "events").select(q.alias("q"), ref.alias("ref"))
    return rows.withColumn("mode", X.answer_mode(F.col("q"), F.col("ref"))).groupBy("q", "ref", "mode").agg(
        F.count(F.lit(1)).alias("n")
    )


@query("output_prefix_match", f"""WITH t AS (SELECT doc_id, {B.sql_words('text')} AS a, {B.sql_words(_truncated())} AS e, {B.sql_words(_no_plan())} AS p FROM documents)
SELECT doc_id, CASE WHEN len(e) = 0 THEN len(a) = 0 ELSE a[1:len(e)] = e END AS truncated_ok,
  CASE WHEN len(p) = 0 THEN len(a) = 0 ELSE a[1:len(p)] = p END AS stripped_ok FROM t""")
def output_prefix_match(spark, folder):
    return docs(spark, folder).select(
        "doc_id", X.outputs_match(body(), X.truncate_half(body())).alias("truncated_ok"),
        X.outputs_match(body(), X.remove_plan_details(body())).alias("stripped_ok"),
    )


@query("source_families", """WITH t AS (SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'MMLU-Pro-law' WHEN 1 THEN 'livebench-math-x' WHEN 2 THEN 'livebench-other'
  WHEN 3 THEN lang || '-' || source WHEN 4 THEN '' ELSE source END AS s FROM documents)
SELECT CASE WHEN starts_with(lower(s), 'mmlu-pro') THEN 'mmlu-pro' WHEN starts_with(lower(s), 'livebench-math') THEN 'livebench-math'
  WHEN starts_with(lower(s), 'livebench') THEN 'livebench' WHEN contains(s, '-') THEN split_part(s, '-', 1) WHEN s = '' THEN 'unknown' ELSE s END AS family,
  count(*) AS n FROM t GROUP BY ALL""")
def source_families(spark, folder):
    s = F.expr("CASE doc_id % 6 WHEN 0 THEN 'MMLU-Pro-law' WHEN 1 THEN 'livebench-math-x' WHEN 2 THEN 'livebench-other' "
               "WHEN 3 THEN concat(lang, '-', source) WHEN 4 THEN '' ELSE source END")
    rows = docs(spark, folder).select(D.source_family(s).alias("family"))
    return rows.groupBy("family").agg(F.count(F.lit(1)).alias("n"))


@query("normalize_examples", f"""WITH t AS (SELECT doc_id, 'Src ' || source || '-x' AS source, CASE WHEN doc_id % 5 = 0 THEN ' ' ELSE 'id ' || doc_id END AS sid,
  CASE WHEN doc_id % 3 = 0 THEN ' ' END AS conversation, text AS dialogue, text AS transcript,
  CASE WHEN doc_id % 4 = 0 THEN 'Candidate_A' WHEN doc_id % 4 = 1 THEN ' B ' WHEN doc_id % 4 = 2 THEN 'c' END AS label FROM documents)
SELECT replace(replace(lower(source), ' ', '_'), '-', '_') || '__' ||
    CASE WHEN trim(sid) = '' THEN doc_id::VARCHAR ELSE replace(trim(sid), ' ', '_') END AS example_id,
  md5({B.sql_strip('dialogue')}) AS context_digest,
  CASE WHEN doc_id % 4 = 0 THEN 'a' WHEN doc_id % 4 = 1 THEN 'b' ELSE '' END AS pair_label FROM t""")
def normalize_examples(spark, folder):
    """Alias back-fill, joined distinct context, example key and label aliases."""
    i = F.col("doc_id")
    raw = docs(spark, folder).select(
        i, F.concat(F.lit("Src "), F.col("source"), F.lit("-x")).alias("src"),
        F.when(i % 5 == 0, " ").otherwise(F.concat(F.lit("id "), i.cast("string"))).alias("sid"),
        F.when(i % 3 == 0, " ").alias("conversation"), body(),
        F.when(i % 4 == 0, "Candidate_A").when(i % 4 == 1, " B ").when(i % 4 == 2, "c").alias("label"),
    )
    return raw.select(
        X.example_key(F.col("src"), F.col("sid"), i).alias("example_id"),
        F.md5(T.joined_context(F.col("conversation"), body(), body())).alias("context_digest"),
        F.coalesce(X.pair_label(F.col("label")), F.lit("")).alias("pair_label"),
    )


@query("head_phrases", """WITH t AS (SELECT lang AS family, array_to_string(list_filter(regexp_split_to_array(regexp_replace(lower(text), '[^a-z0-9\\s]', ' ', 'g'), '\\s+'),
  lambda w: w <> '')[1:2], ' ') AS head FROM documents)
SELECT family, head, count(*) AS n FROM t GROUP BY ALL""")
def head_phrases(spark, folder):
    rows = docs(spark, folder).select(F.col("lang").alias("family"), X.head_phrase(body(), 2).alias("head"))
    return rows.groupBy("family", "head").agg(F.count(F.lit(1)).alias("n"))


@query("stable_ids", f"""SELECT doc_id, 'med_lib_' || left(sha1(lower({B.sql_squeeze('text')})), 16) AS library_id,
  left(sha1(lower(lang || '|' || source || '|' || text || '|high')), 16) AS fingerprint,
  'discovered__' || left(sha256(text), 16) AS template_id FROM documents""")
def stable_ids(spark, folder):
    return docs(spark, folder).select(
        "doc_id", F.concat(F.lit("med_lib_"), X.text_digest(body())).alias("library_id"),
        X.criterion_fingerprint(F.col("lang"), F.col("source"), body(), F.lit("high")).alias("fingerprint"),
        X.template_id(body()).alias("template_id"),
    )


@query("heuristic_satisfaction", f"""WITH {B.CANDS},
r(rid, rubric) AS (VALUES (1, 'The note states the chief complaint or visit reason.'), (2, 'The note avoids unsupported facts.'),
  (3, 'The note uses a clear clinical structure.'), (4, 'The note records medications.'), (5, 'The note includes follow-up.'), (6, 'Other quality.'))
SELECT family, rid::BIGINT AS rid, count(*) FILTER (CASE rid
  WHEN 1 THEN contains(lower(text), 'chief complaint') OR contains(lower(text), 'history of present illness') OR contains(lower(text), 'cc:')
  WHEN 2 THEN quality_bucket <> 'synthetically_degraded'
  WHEN 3 THEN regexp_matches(lower(text), 'assessment|plan|history|review of systems|objective|subjective|chief complaint')
  WHEN 4 THEN regexp_matches(lower(text), '\\bmg\\b|medication|aspirin|lisinopril|atorvastatin|metformin')
  WHEN 5 THEN regexp_matches(lower(text), 'follow up|follow-up|return|referral')
  ELSE quality_bucket IN ('gold_like', 'strong_anchor') END) AS satisfied, count(*) AS n FROM cands, r GROUP BY ALL""")
def heuristic_satisfaction(spark, folder):
    """Offline rule for six rubric texts, evaluated in the scan stage."""
    texts = ["The note states the chief complaint or visit reason.", "The note avoids unsupported facts.",
             "The note uses a clear clinical structure.", "The note records medications.",
             "The note includes follow-up.", "Other quality."]
    labels = B.table(spark, folder, "labels")
    kinds = ("gold_like", "synthetically_degraded", "open_generated")

    def rule(kind):
        # with literal rubric and bucket the rule folds to one predicate on the text
        return F.array(*[X.heuristic_satisfaction(body(), F.lit(kind), F.lit(t)) for t in texts])

    # evaluated per bucket before the join, so no text is shuffled
    scanned = docs(spark, folder).select("doc_id", "lang", *[rule(k).alias(k) for k in kinds])
    bucket = F.when(F.col("quality") == 1, "gold_like").when(F.col("quality") == 0, kinds[1]).otherwise(kinds[2])
    rows = scanned.join(labels, "doc_id", "left").withColumn("bucket", bucket)
    picked = F.when(F.col("bucket") == kinds[0], F.col(kinds[0])).when(F.col("bucket") == kinds[1], F.col(kinds[1])).otherwise(F.col(kinds[2]))
    facts = F.transform(picked, lambda ok, i: F.struct((i + 1).cast("bigint").alias("rid"), ok.alias("ok")))
    return rows.select(F.col("lang").alias("family"), F.inline(facts)).groupBy("family", "rid").agg(
        F.count(F.when(F.col("ok"), 1)).alias("satisfied"), F.count(F.lit(1)).alias("n")
    )
