"""Guided retrieval over the conversations.

record    = a turn; its source is one of five benchmark names by conversation
question  = the instruction of ``answers`` and the whole text
"""

from __future__ import annotations

from pyspark.sql import functions as F

from verdikt.operators import guided as G
from verdikt.operators.retrieval import SIMILARITY_WEIGHTS
from verdikt.plans import answers as P
from verdikt.plans import base as B
from verdikt.plans.registry import query

_SOURCE = """CASE CAST(conv_id % 6 AS INT) WHEN 0 THEN 'MMLU-Pro-law' WHEN 1 THEN 'livebench-math-olympiad' WHEN 2 THEN 'livebench-reasoning-zebra'
  WHEN 3 THEN 'livecodebench' WHEN 4 THEN 'MMLU-Pro-biology' ELSE CASE WHEN conv_id = 5 AND turn = 0 THEN 'solo-' || role ELSE 'livebench-reasoning-web' END END"""
TOP = 5


def records(spark, folder):
    rows = B.table(spark, folder, "conversations").where("conv_id IS NOT NULL AND turn IS NOT NULL AND text IS NOT NULL")
    return rows.select(
        (F.col("conv_id") * 10_000 + F.col("turn")).alias("id"), F.expr(_SOURCE).alias("source"),
        F.concat_ws("\n", F.expr(P._QUESTION), "text").alias("question"), F.expr(P._REFERENCE).alias("reference"),
    )


_LETTERS = f"""list_sort(list_distinct(list_transform(list_concat(regexp_extract_all(question, '\\(([A-Ja-j])\\)', 1),
  regexp_extract_all(regexp_replace(question, '{B.RE2_SPACE}', '  ', 'g'), '(?:^| )([A-Ja-j])[).:] ', 1)), lambda l: upper(l))))"""
_TAGS = "[" + ", ".join([
    "CASE WHEN n_words <= 20 THEN 'w:s' WHEN n_words <= 60 THEN 'w:m' ELSE 'w:l' END", "CASE WHEN n_lines <= 2 THEN 'l:c' WHEN n_lines <= 6 THEN 'l:s' ELSE 'l:m' END",
    "CASE WHEN mode <> '' THEN 'm:' || mode END", "CASE WHEN len(letters) > 0 THEN 'mc' END", "CASE WHEN len(letters) > 0 THEN 'o:' || least(len(letters), 6) END",
    "CASE WHEN exact THEN 'x' END", "CASE WHEN code THEN 'c' END",
    *["CASE WHEN contains(lower(question), '{}') THEN '{}' END".format(n.replace("'", "''"), t) for n, t in G.PHRASE_TAGS.items()],
]) + "]"


def _any(e: str, needles) -> str:
    return "(" + " OR ".join("contains({}, '{}')".format(e, n.replace("'", "''")) for n in needles) + ")"


def _list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def _total(weights) -> str:
    return " + ".join(["lexical * {}::DOUBLE".format(weights["lexical"]), "(0.0::DOUBLE + " + " + ".join(f"{p} * {weights[p]}::DOUBLE" for p in G.STRUCTURE) + ")"])


def _jaccard(a: str, b: str) -> str:
    return f"CASE WHEN len({a}) + len({b}) = 0 THEN 0.0::DOUBLE ELSE len(list_intersect({a}, {b})) / (len({a}) + len({b}) - len(list_intersect({a}, {b})))::DOUBLE END"


_SQL = f"""WITH recs AS (
  SELECT conv_id * 10000 + turn AS id, conv_id, {_SOURCE} AS source, {P._duck(P._QUESTION)} || chr(10) || text AS question, {P._duck(P._REFERENCE)} AS reference
  FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL AND text IS NOT NULL),
valued AS (SELECT *, {P._sql_value('reference')} AS ref FROM recs),
moded AS (SELECT *, {P._sql_mode('question', 'ref')} AS mode, {_LETTERS} AS letters, len({B.sql_words('question')}) AS n_words, len({B.sql_full_lines('question')}) AS n_lines FROM valued),
plain AS (SELECT id AS conv_id, 0 AS turn, {P._CHOICE_TEXT} AS q FROM recs),{P._sql_options('bracketed', 'q', r'\(([A-Ja-j])\)')},{P._sql_options('listed', "replace(q, ' ', '  ')", r'(?:^| )([A-Ja-j])[).:] ')},
mapped AS (SELECT conv_id AS id FROM bracketed GROUP BY 1 HAVING count(*) >= 2 UNION SELECT conv_id FROM listed GROUP BY 1 HAVING count(*) >= 2),
trait AS (
  SELECT *, {_any('lower(question)', G.EXACT_CUES)} OR regexp_matches({B.sql_strip('reference')}, '^[A-Ja-j]{{1,5}}$') OR mode <> '' OR id IN (SELECT id FROM mapped) AS exact,
    {_any("lower(source || chr(10) || question || chr(10) || reference)", G.CODE_CUES)} AS code,
    CASE WHEN starts_with(lower(source), 'mmlu-pro') THEN 'mmlu-pro' WHEN starts_with(lower(source), 'livebench-reasoning') THEN 'livebench-reasoning'
      WHEN starts_with(lower(source), 'livebench-math') THEN 'livebench-math' WHEN starts_with(lower(source), 'livecodebench') THEN 'livecodebench' ELSE split_part(lower(source), '-', 1) END AS family,
    list_filter({B.sql_tokens('source')}, lambda t: length(t) >= 4 AND NOT list_contains({_list(G.FAMILY_WORDS)}, t)) AS words,
    list_distinct(list_filter({B.sql_tokens("source || chr(10) || question")}, lambda t: length(t) >= 4 AND NOT list_contains({_list(G.STOPWORDS)}, t))) AS toks FROM moded),
f AS (SELECT *, list_concat(list_filter({_TAGS}, lambda t: t IS NOT NULL), list_transform(words, lambda w: 's:' || w)) AS shape, count(*) OVER (PARTITION BY family) AS members FROM trait),
pairs AS (
  SELECT a.id AS query_id, b.id, a.family, {_jaccard('a.toks', 'b.toks')} AS lexical, (a.family = b.family)::INT::DOUBLE AS same_family, (a.mode = b.mode)::INT::DOUBLE AS answer_mode_match,
    (a.exact = b.exact)::INT::DOUBLE AS exact_answer_match, (a.code AND b.code)::INT::DOUBLE AS code_task_match,
    CASE WHEN len(a.letters) = 0 OR len(b.letters) = 0 THEN 0.0::DOUBLE ELSE least({_jaccard('a.letters', 'b.letters')} + CASE WHEN len(a.letters) = len(b.letters) THEN 0.25 ELSE 0.0 END::DOUBLE, 1.25::DOUBLE) END AS option_structure,
    {_jaccard('a.shape', 'b.shape')} AS shape_similarity, {_jaccard('a.words', 'b.words')} AS source_domain
  FROM f a JOIN f b ON a.id <> b.id AND (a.family = b.family OR a.members = 1) WHERE a.conv_id % 50 = 0 OR a.id = 50000),
totals AS (SELECT *, round(CASE WHEN family = 'mmlu-pro' THEN {_total(SIMILARITY_WEIGHTS['mmlu-pro'])} ELSE {_total(SIMILARITY_WEIGHTS[''])} END, 12) AS total FROM pairs),
best AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY total DESC, id) AS rank FROM totals QUALIFY rank <= {TOP})
SELECT query_id, id, rank, {', '.join(f'round({p}, 6) AS {p}' for p in (*G.PARTS, 'total'))} FROM best"""


@query("guided_retrieval", _SQL)
def guided_retrieval(spark, folder):
    """Queries are the turns of conversations with an id divisible by 50, and one record that is alone in its family."""
    asked = (F.col("id") == 50_000) | (F.expr("id div 10000") % 50 == 0)
    return G.guided_top_k(records(spark, folder), asked, TOP)[0]
