"""Answers in replies: the value given, its canonical form, and whether the marks agree.

question  = the turn before, with an instruction of one of seven kinds
reply     = conversations.text with a closing mark of one of fifteen kinds
The marks are made of the words, lengths and numbers of the text itself.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from verdikt.functions import answers as A
from verdikt.functions import rubrics as X
from verdikt.plans import base as B
from verdikt.plans.registry import query

_NL = "chr(10)"
_WORD = "split_part(replace(text, chr(10), ' '), ' ', 1)"
_LETTER = "chr(CAST(65 + (conv_id + turn) % 10 AS INT))"
_LEN = "CAST(length(text) AS STRING)"
_REPLIES = (
    f"text || {_NL} || 'Final answer: **' || {_WORD} || '**'",
    f"text || ' so ***' || repeat({_LETTER}, 5) || '*** it is'",
    f"text || {_NL} || 'Answer: ' || repeat({_LETTER}, 3) || ' or ' || {_LETTER}",
    f"text || {_NL} || chr(92) || 'boxed{{' || {_LEN} || '/' || CAST((turn + 2) * 12 AS STRING) || '}}'",
    f"text || {_NL} || 'The answer is ' || CAST(length(text) * 3 AS STRING) || '.' || CAST(turn * 250 AS STRING) || '00'",
    f"text || {_NL} || repeat({_LETTER}, 5)",
    f"'**Answer** **' || {_WORD} || ',no ,  Yes.** and' || {_NL} || text",
    f"text || {_NL} || 'FINAL_ANSWER: $' || {_LEN} || '/0$'",
    f"'Thus, the answer is:' || {_NL} || {_NL} || {_LETTER} || {_NL} || text",
    f"text || {_NL} || 'I choose option (' || {_LETTER} || '), value 4' || CAST(turn % 10 AS STRING) || '.0'",
    f"'**' || repeat({_LETTER}, 2) || '** ' || text || {_NL} || 'Answer: -00' || {_LEN}",
    f"repeat({_LETTER}, 5)",
    f"text || {_NL} || 'The option ' || lower({_LETTER}) || ' is 30' || {_NL} || 'answer ' || {_LETTER} || {_LETTER}",
    f"text || ' so ' || repeat({_LETTER}, 5) || ' or ' || {_LEN} || {_NL} || 'as was shown.'",
    "text",
)
_QUESTIONS = (
    "'Pick (A) 30 (B) 45 (C) ' || {0} || ' and duplicate that letter five times.'",
    "'Reply with a SINGLE DIGIT, please: ' || {0}",
    "'Give it in **bold**: a. red b. blue c. ' || {0}",
    "'Answer with a single phrase. ' || {0}",
    "'a single word, (a) ' || {0} || ' (b) no'",
    "'Which? A) 40.0 B) ' || {0} || ' A) 41'",
    "{0}",
)


def _cases(options, key: str) -> str:
    whens = " ".join(f"WHEN {i} THEN {o}" for i, o in enumerate(options))
    return f"CASE CAST({key} AS INT) {whens} END"


_REPLY = _cases(_REPLIES, "(conv_id * 4 + turn) % 15")
_QUESTION = _cases([q.format(_WORD) for q in _QUESTIONS], "(conv_id + turn * 3) % 7")
_REFERENCE = f"CASE CAST((conv_id + turn) % 5 AS INT) WHEN 1 THEN repeat({_LETTER}, 5) WHEN 2 THEN {_WORD} ELSE '' END"


def _duck(e: str) -> str:
    return e.replace("AS STRING", "AS VARCHAR")


_ROWS_SQL = f"""SELECT conv_id, turn, {_duck(_REPLY)} AS reply, {_duck(_QUESTION)} AS question, {_duck(_REFERENCE)} AS reference
  FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL"""


def replies(spark, folder):
    rows = B.table(spark, folder, "conversations").where("conv_id IS NOT NULL AND turn IS NOT NULL")
    return rows.select("conv_id", "turn", F.expr(_REPLY).alias("reply"), F.expr(_QUESTION).alias("question"), F.expr(_REFERENCE).alias("reference"))


# ---- the same grammar in SQL -------------------------------------------------

_OUTER_VALUE = "chr(96) || '*_ ' || chr(9) || chr(13) || chr(10) || '.,:;!?' || chr(34) || chr(39)"
_PUNCTUATION = "'.,;:!?' || chr(34) || chr(39) || chr(96) || '()[]{}' || chr(92) || '$'"


def _letters(low: int, high: int | str, last: str = "j", upper: bool = False) -> str:
    chars = [chr(c) for c in range(97, ord(last) + 1)]
    chars += [c.upper() for c in chars] if upper else []
    return "^(" + "|".join(f"{c}{{{low},{high}}}" for c in chars) + ")$"


def _sql_value(e: str) -> str:
    fenced = f"CASE WHEN starts_with({B.sql_strip(e)}, '```') AND ends_with({B.sql_strip(e)}, '```') THEN {B.sql_strip(f'trim({B.sql_strip(e)}, chr(96))')} ELSE {B.sql_strip(e)} END"
    return f"(SELECT lower({B.sql_squeeze(f'''trim(CASE WHEN starts_with(v, '**') AND ends_with(v, '**') AND length(v) > 4 THEN v[3:-3] ELSE v END, {_OUTER_VALUE})''')}) FROM (SELECT {fenced} AS v))"


def _sql_tokens(e: str, pattern: str) -> str:
    return f"list_filter(regexp_extract_all({e}, '[\\p{{L}}\\p{{N}}_]+'), lambda w: regexp_matches(w, '{pattern}'))"


def _sql_all(e: str, pattern: str, group: int = 1) -> str:
    return f"regexp_extract_all({e}, '{pattern.replace(chr(39), chr(39) * 2)}', {group})"


def _sql_mode(question: str, ref: str) -> str:
    q = f"lower({question})"
    return f"""CASE WHEN regexp_matches({ref}, '{_letters(1, 10)}') OR contains({q}, 'duplicate that letter five times') THEN 'repeated_choice'
  WHEN contains({q}, '***') OR contains({q}, 'bold') OR contains({q}, 'double asterisks') THEN 'decorated_span'
  WHEN contains({q}, 'single digit') THEN 'single_digit' WHEN contains({q}, 'single phrase') THEN 'single_phrase'
  WHEN contains({q}, 'single word') OR contains({q}, 'single string') THEN 'single_word' ELSE '' END"""


_SQL_LINES = "(?im)^" + A.ANSWER_LINE


def _sql_extracted(rows: str) -> str:
    """``rows`` (key columns, reply, question, reference) with mode, ref and x = (source, value, explicit) of the reply."""
    same = lambda e: f"CASE WHEN regexp_matches({e}, '{_letters(1, 10)}') AND length({e}) = length(ref) THEN {e} END"
    pick = "coalesce({0}[-1], {1}[-1])"
    two = lambda e: _sql_tokens(e, _letters(2, 10, upper=True))
    choice = lambda e: pick.format(two(e), _sql_tokens(e, "^[A-Ja-j]$"))
    sized = lambda e: f"list_filter({_sql_tokens(e, _letters(1, 10, upper=True))}, lambda w: length(w) = length(ref))[-1]"
    return f"""
marked AS (
  SELECT *, {_sql_value('reply')} AS whole, {_sql_value('reference')} AS ref, {_sql_all('reply', A.TRIPLE)}[-1] AS triple, {_sql_all('reply', A.BOLD)}[-1] AS bold,
    {_sql_all('reply', _SQL_LINES)}[-1] AS line, {B.sql_full_lines('reply')}[-1] AS tail FROM {rows}),
moded AS (SELECT *, {_sql_mode('question', 'ref')} AS mode, {_sql_value('triple')} AS v_triple, {_sql_value('bold')} AS v_bold, {_sql_value('line')} AS v_line, {_sql_value('tail')} AS v_tail FROM marked),
tried AS (
  SELECT *, CASE
    WHEN regexp_matches(ref, '{_letters(1, 10)}') THEN [
      {{'s': 'entire_response', 'v': {same('whole')}, 'e': true}}, {{'s': 'triple_asterisk_span', 'v': {same('v_triple')}, 'e': true}},
      {{'s': 'bold_span', 'v': {same('v_bold')}, 'e': true}}, {{'s': 'final_answer_line', 'v': {sized('line')}, 'e': true}},
      {{'s': 'last_line', 'v': {same('v_tail')}, 'e': true}}, {{'s': 'inline_repeated_choice', 'v': {sized('reply')}, 'e': false}}]
    WHEN ref = '' AND mode = 'repeated_choice' THEN [
      {{'s': 'entire_response', 'v': CASE WHEN regexp_matches(whole, '{_letters(2, 10)}') THEN whole END, 'e': true}},
      {{'s': 'triple_asterisk_span', 'v': {choice('triple')}, 'e': true}}, {{'s': 'bold_span', 'v': {choice('bold')}, 'e': true}},
      {{'s': 'final_answer_line', 'v': {choice('line')}, 'e': true}}, {{'s': 'last_line', 'v': {choice('tail')}, 'e': true}},
      {{'s': 'inline_repeated_choice', 'v': {two('reply')}[-1], 'e': false}}]
    ELSE [
      {{'s': 'triple_asterisk_span', 'v': triple, 'e': true}}, {{'s': 'bold_span', 'v': bold, 'e': true}}, {{'s': 'final_answer_line', 'v': line, 'e': true}},
      {{'s': 'last_line', 'v': CASE WHEN ref = '' AND mode = 'single_digit' THEN regexp_extract_all(tail, '-?[0-9]+')[-1]
        WHEN contains(lower(question), 'single phrase') OR ref = '' AND mode IN ('single_word', 'single_phrase', 'decorated_span') THEN tail END, 'e': true}},
      {{'s': 'inline_integer', 'v': CASE WHEN ref = '' AND mode = 'single_digit' THEN regexp_extract_all(reply, '-?[0-9]+')[-1] END, 'e': false}}]
    END AS tries FROM moded),
picked AS (SELECT *, list_filter(tries, lambda t: t.v IS NOT NULL)[1] AS best FROM tried),
extracted AS (SELECT *, {_sql_value('best.v')} AS best_value FROM picked)"""


@query("answer_candidates", f"""WITH replies AS ({_ROWS_SQL}),{_sql_extracted('replies')}
SELECT conv_id, turn, mode, CASE WHEN best_value <> '' THEN md5(best_value) END AS value_digest,
  CASE WHEN best_value <> '' THEN best.s END AS source, CASE WHEN best_value <> '' THEN best.e END AS explicit FROM extracted""")
def answer_candidates(spark, folder):
    rows = replies(spark, folder)
    question, reference = F.col("question"), F.col("reference")
    found = rows.withColumn("x", A.exact_answer(F.col("reply"), question, reference))
    return found.select(
        "conv_id", "turn", X.answer_mode(question, reference).alias("mode"), F.md5("x.value").alias("value_digest"), "x.source", "x.explicit"
    )


def _sql_bare(e: str) -> str:
    return B.sql_strip(f"trim({B.sql_strip(e)}, {_PUNCTUATION})")


_FINAL_SQL = f"""coalesce({_sql_bare(f"{_sql_all('reply', '(?i)' + A.FINAL_MARK)}[1]")}, {_sql_bare(f"{_sql_all('reply', A.BOXED)}[-1]")},
  {_sql_tokens('reply', _letters(5, '', 'z', True))}[-1], {_sql_bare(f"{_sql_all('reply', '(?i)' + A.PHRASE_MARK)}[1]")},
  regexp_extract_all(right(reply, 500), '{A.NUMBER}')[-1], {_sql_bare(f"{B.sql_full_lines('reply')}[-1]")}, '')"""
_HEADING = "^(?:" + "|".join(A.HEADINGS) + ")"
_REASONED_SQL = f"""coalesce({_sql_all('reply', '(?i)' + A.FINAL_MARK)}[1], list_filter(list_transform({_sql_all('reply', A.BOLD)}, lambda b: {B.sql_strip('b')}),
  lambda b: b <> '' AND NOT regexp_matches(lower(b), '{_HEADING}'))[-1], {B.sql_full_lines('reply')}[-1])"""


def _sql_plain(e: str) -> str:
    bare = B.sql_squeeze(f"rtrim({B.sql_strip(f'''lower(replace({B.sql_strip(e)}, '*', ''))''')}, '.,!?;:')")
    return f"""coalesce((SELECT CASE WHEN len(parts) > 1 THEN array_to_string(parts, ', ') ELSE b END
  FROM (SELECT b, list_filter(list_transform(string_split(b, ','), lambda p: {B.sql_strip('p')}), lambda p: p <> '') AS parts FROM (SELECT {bare} AS b))), '')"""


_LEADING_SQL = "(?i)" + A.LEADING.replace(r"\s", r"[\s\x0B]")
_TOP, _BOTTOM = (f"TRY_CAST(split_part(number, '/', {i}) AS HUGEINT)" for i in (1, 2))
_CANONICAL_SQL = f"""WITH rows AS (SELECT 'reply' AS kind, conv_id AS id, turn, reply FROM ({_ROWS_SQL}) UNION ALL SELECT 'document', doc_id, 0, text FROM documents WHERE text IS NOT NULL),
finals AS (SELECT *, {_FINAL_SQL} AS final, {_REASONED_SQL} AS picked FROM rows),
opened AS (SELECT *, {B.sql_strip(f"coalesce({_sql_all('final', A.BOXED)}[1], final)")} AS inner_text FROM finals),
bare AS (SELECT *, lower({_sql_bare(B.sql_strip(f"regexp_replace(inner_text, '{_LEADING_SQL}', '')"))}) AS c FROM opened),
parsed AS (SELECT *, {_sql_tokens('c', _letters(5, '', 'z'))}[1] AS run, regexp_extract_all(c, '{A.NUMBER}')[-1] AS number FROM bare),
canonical AS (
  SELECT *, CASE WHEN run IS NOT NULL THEN run WHEN regexp_matches(c, '{_letters(3, '', 'z')}') OR regexp_matches(c, '^[a-z]$') OR number IS NULL THEN c
    WHEN contains(number, '/') THEN CASE WHEN {_TOP} IS NULL OR {_BOTTOM} IS NULL OR {_BOTTOM} = 0 THEN number
      ELSE ({_TOP} // gcd({_TOP}, {_BOTTOM}))::VARCHAR || '/' || ({_BOTTOM} // gcd({_TOP}, {_BOTTOM}))::VARCHAR END
    WHEN contains(number, '.') THEN regexp_replace(regexp_replace(regexp_replace(round(TRY_CAST(number AS DECIMAL(38, 12)), 8)::VARCHAR, '0+$', ''), '\\.$', ''), '^-0$', '0')
    ELSE TRY_CAST(number AS HUGEINT)::VARCHAR END AS form
  FROM parsed)
SELECT kind, id, turn, md5(final) AS final_digest, md5(coalesce(form, '')) AS canonical_digest, md5({_sql_plain('picked')}) AS reasoned_digest FROM canonical"""


@query("canonical_answers", _CANONICAL_SQL)
def canonical_answers(spark, folder):
    talk = replies(spark, folder).select(F.lit("reply").alias("kind"), F.col("conv_id").alias("id"), "turn", "reply")
    docs = B.table(spark, folder, "documents").where("text IS NOT NULL").select(
        F.lit("document").alias("kind"), F.col("doc_id").alias("id"), F.lit(0).cast("long").alias("turn"), F.col("text").alias("reply")
    )
    rows = talk.unionByName(docs)
    return rows.select("kind", "id", "turn", "reply", A.final_value(F.col("reply")).alias("final")).select(
        "kind", "id", "turn", F.md5("final").alias("final_digest"), F.md5(A.canonical_answer(F.col("final"))).alias("canonical_digest"),
        F.md5(A.reasoned_answer(F.col("reply"))).alias("reasoned_digest"),
    )


_DISTINCT_VALUES = "list_distinct(list_filter(list(best_value), lambda v: v <> ''))"
_NORMAL = B.sql_squeeze("seg")
_CHOICE_TEXT = B.sql_squeeze("replace(" * len(A.LATEX_SPACES) + "question" + "".join(f", '{m}', ' ')" for m in A.LATEX_SPACES))


def _sql_options(name: str, text: str, pattern: str) -> str:
    """CTEs for the options after the marks of one kind: ``name`` (conv_id, turn, letter, value), the last of a letter."""
    return f"""
{name}_cut AS (SELECT conv_id, turn, string_split(regexp_replace({text}, '{pattern}', chr(1) || '\\1' || chr(2), 'g'), chr(1))[2:] AS parts FROM plain),
{name}_all AS (SELECT conv_id, turn, unnest(parts) AS part, unnest(range(len(parts))) AS pos FROM {name}_cut),
{name} AS (SELECT * FROM (
  SELECT conv_id, turn, pos, lower(split_part(part, chr(2), 1)) AS letter, {_sql_value("trim(split_part(part, chr(2), 2), ' :-.;,')")} AS value
  FROM {name}_all WHERE contains(part, chr(2))) WHERE value <> '' QUALIFY row_number() OVER (PARTITION BY conv_id, turn, letter ORDER BY pos DESC) = 1)"""


_SIGNAL_SQL = f"""WITH replies AS ({_ROWS_SQL}),
plain AS (SELECT conv_id, turn, {_CHOICE_TEXT} AS q FROM replies),{_sql_options('bracketed', 'q', r'\(([A-Ja-j])\)')},{_sql_options('listed', "replace(q, ' ', '  ')", r'(?:^| )([A-Ja-j])[).:] ')},
choices AS (
  SELECT conv_id, turn, list({{'letter': letter, 'value': value}} ORDER BY letter) AS choices FROM (
    SELECT conv_id, turn, letter, value FROM bracketed
    UNION ALL SELECT conv_id, turn, letter, value FROM listed WHERE (conv_id, turn) NOT IN (
      SELECT (conv_id, turn) FROM bracketed GROUP BY conv_id, turn HAVING count(*) >= 2))
  GROUP BY 1, 2 HAVING count(*) >= 2),
cut AS (
  SELECT conv_id, turn, question, reference, unnest(segs) AS seg, unnest(range(len(segs))) AS pos FROM (SELECT *, list_concat(
    {_sql_all('reply', _SQL_LINES)}, {_sql_all('reply', A.TRIPLE)}, {_sql_all('reply', A.BOLD)}, {B.sql_full_lines('reply')}[-1:]) AS segs FROM replies)),
segments AS (
  SELECT conv_id, turn, question, reference, reply, pos FROM (SELECT *, {_NORMAL} AS reply FROM cut) WHERE reply <> ''
  QUALIFY row_number() OVER (PARTITION BY conv_id, turn, lower(reply) ORDER BY pos) = 1),
candidates AS (SELECT conv_id, turn, -1 AS pos, question, reference, reply FROM replies UNION ALL SELECT conv_id, turn, pos, question, reference, reply FROM segments),{_sql_extracted('candidates')},
lettered AS (
  SELECT e.*, lower({B.sql_squeeze('reply')}) AS low, coalesce(choices, []) AS choices FROM extracted e LEFT JOIN choices USING (conv_id, turn)),
named AS (
  SELECT *, list_transform(list_filter(choices, lambda o: length(o.value) > 1 AND contains(low, o.value)), lambda o: o.letter) AS said,
    list_concat(list_transform({_sql_tokens('low', _letters(2, 10))}, lambda w: w[1]), {_sql_all('low', A.CUE)}, CASE WHEN regexp_matches(low, '^[a-j]$') THEN [low] ELSE [] END) AS cued
  FROM lettered),
reply_side AS (SELECT *, CASE WHEN regexp_matches(best_value, '{_letters(1, 10)}') THEN best_value[1] END AS final FROM named WHERE pos = -1),
marks AS (
  SELECT conv_id, turn, {_DISTINCT_VALUES} AS vals, list_distinct(flatten(list(list_concat(cued, said)))) AS letters FROM named WHERE pos >= 0 GROUP BY 1, 2),
joined AS (
  SELECT r.*, coalesce(vals, []) AS vals, list_distinct(list_concat(coalesce(letters, []), CASE WHEN len(list_distinct(said)) = 1 THEN said ELSE [] END)) AS letters,
    coalesce(best_value, '') AS value, coalesce(best_value, '') <> '' AND best.e AS explicit FROM reply_side r LEFT JOIN marks USING (conv_id, turn)),
judged AS (
  SELECT *, len(vals) > 1 OR (len(choices) > 0 AND len(letters) > 0 AND (len(letters) > 1 OR (final IS NOT NULL AND NOT list_contains(letters, final)))) AS conflicting,
    CASE WHEN regexp_matches(ref, '{_letters(1, 10)}') THEN length(ref) WHEN contains(lower(question), 'five times') THEN 5 ELSE 2 END AS needed FROM joined)
SELECT conv_id, turn, md5(value) AS value_digest, explicit,
  explicit AND value <> '' AND (mode <> 'repeated_choice' OR (len(list_distinct(string_split(value, ''))) = 1 AND length(value) >= needed)) AS format_ok,
  explicit AND NOT conflicting AS consistent, len(choices) > 0 AS option_map, conflicting,
  len(list_distinct(list_concat(vals, letters, CASE WHEN final IS NULL THEN [] ELSE [final] END)))::BIGINT AS marker_count
FROM judged"""


@query("answer_signals", _SIGNAL_SQL)
def answer_signals(spark, folder):
    rows = replies(spark, folder).withColumn("choices", A.question_choices(F.col("question")))
    signal = A.answer_signal(F.col("reply"), F.col("question"), F.col("reference"), F.col("choices"))
    return rows.select("conv_id", "turn", signal.alias("s")).select(
        "conv_id", "turn", F.md5("s.value").alias("value_digest"), "s.explicit", "s.format_ok", "s.consistent", "s.option_map",
        "s.conflicting", "s.marker_count",
    )
