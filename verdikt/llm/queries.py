"""Thin registered queries of this subpackage, each next to its SQL where SQL can state it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdikt.llm.collocations import collocations
from verdikt.llm.common import fold, table
from verdikt.llm.decontaminate import find_leaks
from verdikt.llm.html_text import extract
from verdikt.llm.language_id import HELD_OUT, identify
from verdikt.llm.packing import pack_documents
from verdikt.llm.quality_ranker import rank_quality
from verdikt.llm.quality_rules import METRICS, NEARLY, RULES, quality_rules
from verdikt.llm.quotations import LEAST_SHARE, reply_ordered
from verdikt.llm.repeats import without_repeats
from verdikt.llm.secrets import with_findings
from verdikt.llm.simhash import hexadecimal, near_duplicates
from verdikt.llm.spelling import spelling_variants
from verdikt.llm.toxicity import toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql.strip()
        return fn

    return add


def good_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("good"))


ALPHA, DELTA = 0.08, 0.1
_CUTS = ",\n".join(
    f"('{r.name}', {i}, {cut}, {ALPHA / len(RULES)})" for r in RULES for i, cut in enumerate(r.cutoffs)
)
_PARTS = " ".join(f"WHEN '{r.name}' THEN {r.part}" for r in RULES)
_WHOLES = " ".join(f"WHEN '{r.name}' THEN {r.whole}" for r in RULES)
OP1_SQL = rf"""
WITH cuts(rule, step, cut, share) AS (VALUES {_CUTS}),
split AS (
  SELECT doc_id, coalesce(lang, 'und') AS stratum, coalesce(text, '') AS text, row_number() OVER () AS rid,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
windows AS (
  SELECT rid, pos, words[pos] || ' ' || words[pos + 1] || ' ' || words[pos + 2] AS gram
  FROM (SELECT rid, words, unnest(range(1, len(words) - 1)) AS pos FROM split)),
doubled AS (SELECT rid, gram FROM windows GROUP BY ALL HAVING count(*) > 1),
covered AS (
  SELECT rid, count(DISTINCT spot) AS n
  FROM (SELECT w.rid, unnest([pos, pos + 1, pos + 2]) AS spot FROM windows w JOIN doubled USING (rid, gram)) GROUP BY rid),
metrics AS (
  SELECT s.rid, doc_id, stratum, len(words)::BIGINT AS n_words,
    length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
    coalesce(c.n, 0)::BIGINT AS n_repeat_words, len(lines)::BIGINT AS n_lines,
    length(regexp_replace(text, '[^A-Z]', '', 'g'))::BIGINT AS n_capitals
  FROM split s LEFT JOIN covered c ON s.rid = c.rid),
judged_labels AS (SELECT doc_id, min(quality) AS good FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
holdout AS (SELECT m.*, good FROM metrics m JOIN judged_labels USING (doc_id)),
strata AS (SELECT stratum, count(*) FILTER (good = 1) AS n FROM holdout GROUP BY 1
  HAVING count(*) FILTER (good = 1) >= ceil(ln({DELTA}) / ln(1 - {ALPHA}))),
counts AS (
  SELECT stratum, n, rule, step, cut, share, count(*) FILTER (over AND good = 1) AS k, count(*) FILTER (over AND good = 0) AS caught
  FROM (SELECT *, CASE rule {_PARTS} END * 1000 > CASE rule {_WHOLES} END * cut AS over
    FROM holdout JOIN strata USING (stratum) CROSS JOIN cuts) GROUP BY ALL),
tested AS (
  SELECT *, k < n AND list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(n + 1) - CASE WHEN i = 0 THEN 0 ELSE lgamma(i + 1) END
      - lgamma(n - i + 1) + i * ln(share) + (n - i) * ln(1 - share))))
    <= {DELTA} / ((SELECT count(*) FROM strata) * {len(RULES)}) AS ok
  FROM counts),
sure AS (SELECT *, max(caught) OVER (PARTITION BY stratum, rule) AS most FROM tested t WHERE ok AND NOT EXISTS (
    SELECT 1 FROM tested u WHERE u.stratum = t.stratum AND u.rule = t.rule AND u.step < t.step AND NOT u.ok)),
proven AS (SELECT stratum, rule, max(cut) AS cut FROM sure WHERE most > 0 AND 100 * caught >= {NEARLY} * most GROUP BY 1, 2),
hits AS (
  SELECT DISTINCT m.rid FROM metrics m JOIN proven p ON m.stratum = p.stratum
  WHERE CASE p.rule {_PARTS} END * 1000 > CASE p.rule {_WHOLES} END * p.cut),
judged AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM metrics)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT EXISTS (SELECT 1 FROM hits h WHERE h.rid = j.rid) AS kept
FROM judged j
"""


@query("op1_quality_rules", OP1_SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules(table(spark, sf_dir, "documents"), good_labels(spark, sf_dir), alpha=ALPHA, delta=DELTA)
    return judged.select("doc_id", *METRICS[:5], "base_failed", "kept")


@query("op9_simhash")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = near_duplicates(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", hexadecimal("bits").alias("fingerprint"), "component_id")


def vocabulary() -> tuple[str, str, str]:
    """Tokenizer file, its ranks and its word pattern."""
    import public_tokenizers

    name = "byte_bpe_50k"
    return public_tokenizers.path(f"{name}.json"), public_tokenizers.path(f"{name}.tiktoken"), public_tokenizers.PATTERN


@query("op7_best_fit_packing")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), vocabulary())


@query("op5_decontamination")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op10_secret_scan")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = with_findings(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary()[1:]).select("doc_id", "findings.*")
    return found.select(
        "doc_id", "n_assign", "n_access", "n_hex", "base_sha256", F.col("written").alias("spans"), "n_random"
    )


def predictions(scored: DataFrame, cutoff: float) -> DataFrame:
    return scored.select(
        "doc_id",
        (fold(F.col("doc_id"), 5) == 0).alias("held_out"),
        "score",
        (F.col("score") >= cutoff).cast("int").alias("predicted"),
    )


@query("op3_toxicity")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predictions(toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")), 0.5)


@query("op2_language_id")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = identify(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", (fold(F.col("doc_id"), 4) == HELD_OUT).alias("held_out"), "lang_pred", "score", "ambiguous"
    )


@query("op6_quality_ranking")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = rank_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), cutoff=0.3)
    return predictions(scored, 0.3)


@query("op8_html_extraction")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


_OWN = r"""CASE WHEN regexp_matches(text, '(^|\n)[ \t]*>') THEN regexp_replace(array_to_string(list_filter(
  string_split(text, chr(10)), lambda l: NOT regexp_matches(l, '^((?:[ \t]*>)+)')), chr(10)), '^[ \t\r\n]+|[ \t\r\n]+$', '', 'g')
  ELSE text END"""
_NORMAL = r"lower(trim(regexp_replace({}, '[ \t\r\n]+', ' ', 'g')))"
OP4_SQL = rf"""
WITH RECURSIVE source AS (SELECT conv_id, turn, role, text, {_OWN} AS own, md5(text) AS said FROM conversations),
lines AS (
  SELECT conv_id, turn, said, spot, line, length(regexp_replace(regexp_extract(line, '^((?:[ \t]*>)+)', 1), '[^>]', '', 'g')) AS depth
  FROM (SELECT conv_id, turn, said, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS spot
    FROM (SELECT DISTINCT conv_id, turn, said, text FROM source
      WHERE regexp_matches(text, '(^|\n)[ \t]*>') AND conv_id IS NOT NULL AND turn IS NOT NULL))),
runs AS (SELECT *, spot - row_number() OVER (PARTITION BY conv_id, turn, said, depth ORDER BY spot) AS run FROM lines WHERE depth > 0),
passages AS (
  SELECT *, {_NORMAL.format("quoted")} AS whole FROM (
    SELECT conv_id, turn, said, depth, run, string_agg(regexp_replace(line, '^((?:[ \t]*>)+)', ''), chr(10) ORDER BY spot) AS quoted
    FROM runs GROUP BY conv_id, turn, said, depth, run) WHERE {_NORMAL.format("quoted")} <> ''),
parts AS (
  SELECT conv_id, turn, said, depth, run, whole, body, min(place) AS place FROM (
    SELECT *, {_NORMAL.format("unit")} AS body FROM (
      SELECT *, unnest(us) AS unit, unnest(range(len(us))) AS place FROM (
        SELECT *, list_concat([quoted], string_split_regex(quoted, '\n[ \t\r]*\n'), string_split(quoted, chr(10))) AS us FROM passages)))
  WHERE body <> '' AND 100 * length(body) >= {LEAST_SHARE} * length(whole) GROUP BY ALL),
units AS (
  SELECT DISTINCT conv_id, turn, {_NORMAL.format("unit")} AS body FROM (
    SELECT conv_id, turn, own AS unit FROM source
    UNION ALL SELECT conv_id, turn, unnest(string_split_regex(own, '\n[ \t\r]*\n')) FROM source
    UNION ALL SELECT conv_id, turn, unnest(string_split(own, chr(10))) FROM source)
  WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
near AS (SELECT body, conv_id, min(turn) AS turn FROM units WHERE body IN (SELECT body FROM parts) GROUP BY 1, 2),
tried AS (
  SELECT p.*, n.conv_id AS to_conv, n.turn AS to_turn, 0 AS far FROM parts p JOIN near n ON n.body = p.body AND n.conv_id = p.conv_id AND n.turn < p.turn
  UNION ALL SELECT p.*, f.conv_id, f.turn, 1 FROM parts p JOIN near f ON f.body = p.body AND f.conv_id <> p.conv_id),
best AS (
  SELECT * FROM tried QUALIFY row_number() OVER (PARTITION BY conv_id, turn, said, depth, run ORDER BY length(body) DESC, far, place, to_conv) = 1),
linked AS (
  SELECT p.conv_id, p.turn, p.said, p.depth, b.to_conv, b.to_turn FROM passages p LEFT JOIN best b
    ON b.conv_id = p.conv_id AND b.turn = p.turn AND b.said = p.said AND b.depth = p.depth AND b.run = p.run),
counts AS (
  SELECT conv_id, turn, said, count(*) AS n_quotes, count(to_turn) AS n_linked, max(depth) AS max_depth,
    max(to_turn) FILTER (WHERE depth = 1 AND to_conv = conv_id) AS parent_turn
  FROM linked GROUP BY 1, 2, 3),
parents AS (SELECT conv_id, turn, max(parent_turn) AS parent FROM counts WHERE parent_turn IS NOT NULL GROUP BY 1, 2),
climb AS (
  SELECT conv_id, turn, parent AS top, turn::VARCHAR AS path FROM parents
  UNION ALL
  SELECT c.conv_id, c.turn, p.parent, c.top::VARCHAR || '.' || c.path
  FROM climb c LEFT JOIN parents p ON p.conv_id = c.conv_id AND p.turn = c.top WHERE c.top IS NOT NULL),
paths AS (SELECT conv_id, turn, path FROM climb WHERE top IS NULL)
SELECT s.conv_id, s.turn, role, own AS text, coalesce(n_quotes, 0)::BIGINT AS n_quotes, coalesce(n_linked, 0)::BIGINT AS n_linked,
  coalesce(max_depth, 0)::BIGINT AS max_depth, parent_turn, coalesce(path, s.turn::VARCHAR, '') AS reply_path
FROM source s LEFT JOIN counts c ON c.conv_id = s.conv_id AND c.turn = s.turn AND c.said = s.said
LEFT JOIN paths p ON p.conv_id = s.conv_id AND p.turn = s.turn AND c.said IS NOT NULL
"""


@query("op4_quotation_linking", OP4_SQL)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    ordered = reply_ordered(table(spark, sf_dir, "conversations"))
    return ordered.withColumn("reply_path", F.array_join(F.transform("reply_path", lambda x: x.cast("string")), "."))


OP11_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS piece, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS body FROM documents),
words AS (SELECT lang, regexp_extract_all(body, '[^\x20\x09]+') AS w FROM pieces),
grams AS (
  SELECT lang, size, unnest(list_transform(range(1, len(w) - size + 2), lambda i: array_to_string(w[i:i + size - 1], ' '))) AS phrase
  FROM words, (VALUES (1), (2), (3)) AS s(size) WHERE len(w) >= size),
f AS (SELECT lang, size, phrase, count(*)::HUGEINT AS f FROM grams GROUP BY ALL),
totals AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE size = 1 GROUP BY 1),
found AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE size > 1 AND f >= 10),
cuts AS (
  SELECT c.lang, c.phrase, c.size, c.f AS a, k, x.f AS l, y.f AS r, 1000000 * c.f * c.f // (x.f * y.f) AS score
  FROM (SELECT *, unnest(range(1, size)) AS k FROM found) c
  JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[:k], ' ')
  JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[k + 1:], ' ')),
cut AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
longer AS (
  SELECT lang, phrase, max(f) AS f FROM (
    SELECT lang, f, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase FROM found WHERE size = 3) GROUP BY 1, 2),
ranked AS (
  SELECT c.*, row_number() OVER (PARTITION BY c.lang ORDER BY score DESC, a DESC, c.phrase) AS rank
  FROM cut c LEFT JOIN longer o ON o.lang = c.lang AND o.phrase = c.phrase WHERE o.f IS NULL OR 100 * o.f < 50 * a)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score::BIGINT AS score
FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""


@query("op11_collocations", OP11_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH RECURSIVE bytes AS (
  SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, b) ORDER BY b) AS crc
  FROM (SELECT unnest(range(256)) AS b)),
runs AS (
  SELECT key, run, count(*) AS n FROM (
    SELECT coalesce(doc_id::VARCHAR, '') AS key,
      unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+')) AS run
    FROM documents) GROUP BY ALL),
spelt AS (SELECT run, n, hex(encode(key || ':' || run)) AS h FROM runs),
checked AS (
  SELECT run, n, xor(list_reduce(
    list_transform(range(1, length(h), 2), lambda i: (instr('0123456789ABCDEF', h[i]) - 1) * 16 + instr('0123456789ABCDEF', h[i + 1]) - 1),
    lambda c, b: xor(c // 256, crc[(xor(c, b) % 256) + 1]), 4294967295), 4294967295) AS h
  FROM spelt, bytes),
counted AS (
  SELECT CASE WHEN h % 97 = 0 THEN run[:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word, sum(n)::BIGINT AS n
  FROM checked GROUP BY 1),
words AS (SELECT word, n FROM counted WHERE length(word) >= 5 AND n >= 3),
less AS (SELECT DISTINCT word, n, spot, word[:spot - 1] || word[spot + 1:] AS body FROM (SELECT *, unnest(range(1, length(word) + 1)) AS spot FROM words)),
near AS (
  SELECT DISTINCT a.word, b.word AS other, b.n FROM less a JOIN less b ON a.spot = b.spot AND a.body = b.body AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM less a JOIN words b ON a.body = b.word
  UNION SELECT b.word, a.word, a.n FROM less a JOIN words b ON a.body = b.word),
best AS (SELECT *, count(*) OVER (PARTITION BY word) AS n_near FROM near QUALIFY row_number() OVER (PARTITION BY word ORDER BY n DESC, other) = 1),
forms AS (
  SELECT w.word, CASE WHEN b.n >= 2 * w.n THEN b.other END AS form, w.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN b.n >= 2 * w.n THEN b.n END AS form_n
  FROM words w LEFT JOIN best b USING (word)),
climb AS (
  SELECT word, word AS root FROM forms
  UNION ALL SELECT c.word, f.form FROM climb c JOIN forms f ON f.word = c.root WHERE f.form IS NOT NULL),
ends AS (SELECT c.word, c.root FROM climb c JOIN forms f ON f.word = c.root WHERE f.form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN ends USING (word)
"""


@query("op12_spelling_variants", OP12_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH split AS (SELECT doc_id, row_number() OVER () AS rid, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (SELECT rid, pos, array_to_string(w[pos:pos + 34], ' ') AS body FROM (SELECT rid, w, unnest(range(1, len(w) - 33)) AS pos FROM split)),
repeated AS (SELECT rid, pos FROM windows QUALIFY count(*) OVER (PARTITION BY body) > 1),
spots AS (SELECT DISTINCT rid, unnest(range(pos, pos + 35)) AS spot FROM repeated),
kept AS (
  SELECT rid, count(*) AS n, string_agg(word, ' ' ORDER BY spot) AS body
  FROM (SELECT rid, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS spot FROM split) ANTI JOIN spots USING (rid, spot) GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(body, '')) AS kept_sha256
FROM split LEFT JOIN kept USING (rid)
"""


@query("op13_substring_dedup", OP13_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(table(spark, sf_dir, "documents"))
