"""Lineage of documents as recursive proposals, and proposals grounded in an edit of their document.

parent    = a third of the id; some have none, some an unknown one, and every
            hundredth id starts a ring of two with the next
proposal  = a line of a document, as a requirement
edit      = one of three that drop lines: with the first words, of numbers, none
"""

from __future__ import annotations

from pyspark.sql import functions as F

from verdikt.functions import rubrics as X
from verdikt.functions import text as T
from verdikt.operators import lineage as L
from verdikt.plans import base as B
from verdikt.plans.registry import query

_PARENT = """CASE WHEN doc_id % 100 = 60 THEN doc_id + 1 WHEN doc_id % 100 = 61 THEN doc_id - 1 WHEN doc_id % 7 = 0 THEN NULL
  WHEN doc_id % 31 = 5 THEN doc_id + 1000000007 ELSE CAST(floor(doc_id / 3) AS BIGINT) END"""


def documents(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet").where("doc_id IS NOT NULL")


@query("proposal_lineage", f"""WITH RECURSIVE t AS (SELECT DISTINCT doc_id AS k, {_PARENT} AS p FROM documents WHERE doc_id IS NOT NULL),
climb AS (
  SELECT k, k AS node, 0::BIGINT AS depth FROM t
  UNION ALL SELECT c.k, t.p, c.depth + 1 FROM climb c JOIN t ON t.k = c.node WHERE t.p IN (SELECT k FROM t) AND c.depth < 64),
ends AS (SELECT k, max(depth) AS depth, arg_max(node, depth) AS root FROM climb GROUP BY 1)
SELECT e.k AS doc_id, CASE WHEN e.depth < 64 THEN root END AS root, CASE WHEN e.depth < 64 THEN e.depth END AS depth,
  CASE WHEN e.depth >= 64 THEN 'ring' WHEN r.p IS NOT NULL THEN 'orphan' ELSE 'whole' END AS state
FROM ends e JOIN t r ON r.k = e.root""")
def proposal_lineage(spark, folder):
    rows = documents(spark, folder).select("doc_id", F.expr(_PARENT).alias("parent_id")).distinct()
    return L.lineage(rows, "doc_id", "parent_id")


# keywords, allowed and blocked phrases of the edits by doc_id % 3
EDITS = (
    (("the", "les", "die"), ("the", "of", "le", "und"), ("with", "avec")),
    (("one", "three"), ("and", "et"), ()),
    (("thing",), (), ()),
)
_DROP = r"(?i)(^|[^a-z])(of|et|zu|[0-9])"


def _norm(e: str) -> str:
    return f"array_to_string({B.sql_tokens(f'''replace({e}, '_', ' ')''')}, ' ')"


def _hits(phrases) -> str:
    return "list_filter([" + ", ".join(f"'{p}'" for p in phrases) + "]::VARCHAR[], lambda p: contains(blob, p))"


def _keep(edit) -> str:
    keywords, allowed, blocked = edit
    touched = f"(len(delta_hits) > 0 OR len({_hits(keywords)}) > 0)"
    if not allowed and not blocked:
        return touched
    return f"{touched} AND len({_hits(allowed or keywords)}) > 0 AND len({_hits(blocked)}) = 0"


_STOPS = "[" + ", ".join(f"'{w}'" for w in X.DISCOVERY_STOPWORDS) + "]"


@query("grounded_proposals", f"""WITH d AS (SELECT doc_id, row_number() OVER () AS rid, {B.sql_full_lines('text')} AS l FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
w AS (SELECT *, list_filter(l, lambda x: NOT regexp_matches(x, '{_DROP}')) AS weak FROM d),
n AS (SELECT *, list_transform(weak, lambda x: {_norm('x')}) AS weak_norms FROM w),
b AS (SELECT *, {_norm("array_to_string(list_filter(l, lambda x: " + _norm('x') + " <> '' AND NOT list_contains(weak_norms, " + _norm('x') + ")), chr(10))")} AS delta FROM n),
p AS (SELECT doc_id, rid, delta, unnest(l) AS line, unnest(range(1, len(l) + 1)) AS place FROM b),
k AS (SELECT *, {_norm("'content item ' || line")} AS blob, list_filter({B.sql_tokens("'content item ' || replace(line, '_', ' ')")},
  lambda t: length(t) >= 4 AND NOT list_contains({_STOPS}, t)) AS toks FROM p),
g AS (SELECT *, list_concat(list_concat(
    CASE WHEN len(toks) >= 3 THEN list_transform(range(1, len(toks) - 1), lambda i: toks[i] || ' ' || toks[i + 1] || ' ' || toks[i + 2]) ELSE [] END,
    CASE WHEN len(toks) >= 2 THEN list_transform(range(1, len(toks)), lambda i: toks[i] || ' ' || toks[i + 1]) ELSE [] END),
  list_filter(toks, lambda t: length(t) >= 7)) AS grams FROM k),
s AS (SELECT *, list_filter(list_filter(grams, lambda t, i: list_position(grams, t) = i)[1:18], lambda t: contains(delta, t)) AS delta_hits FROM g),
f AS (SELECT doc_id, place, len(delta_hits) AS delta_hits_n, CASE doc_id % 3 WHEN 0 THEN {_keep(EDITS[0])} WHEN 1 THEN {_keep(EDITS[1])} ELSE {_keep(EDITS[2])} END AS keep,
  CASE doc_id % 3 WHEN 0 THEN len({_hits(EDITS[0][0])}) WHEN 1 THEN len({_hits(EDITS[1][0])}) ELSE len({_hits(EDITS[2][0])}) END AS profile_n,
  CASE doc_id % 3 WHEN 0 THEN len({_hits(EDITS[0][2])}) ELSE 0 END AS blocked_n FROM s)
SELECT doc_id, count(*) AS proposals, count(*) FILTER (keep) AS accepted, count(*) FILTER (delta_hits_n > 0) AS in_delta,
  count(*) FILTER (profile_n > 0) AS in_profile, count(*) FILTER (blocked_n > 0) AS blocked, coalesce(sum(place) FILTER (keep), 0)::BIGINT AS places FROM f GROUP BY doc_id""")
def grounded_proposals(spark, folder):
    """Per document: its lines as proposals, accepted where they fit the edit that dropped lines."""
    rows = B.table(spark, folder, "documents").where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", T.full_lines(F.col("text")).alias("l"))
    weak = F.filter("l", lambda x: ~x.rlike(_DROP))
    sides = rows.select("doc_id", "l", X.line_delta(F.array_join("l", "\n"), F.array_join(weak, "\n"))["strong_only"].alias("only"))
    item = lambda x: (F.lit("content"), F.lit("item"), x)
    whole = sides.select("doc_id", "l", F.transform("l", lambda x: L.proposal_terms(*item(x))).alias("terms"), T.matched_text(F.array_join("only", "\n")).alias("delta"))
    found = L.with_delta_hits(whole, "terms", "delta", "hits")
    lines = found.select("doc_id", F.posexplode(F.arrays_zip("l", "hits")).alias("place", "line"))
    named = lines.select("doc_id", "place", T.matched_text(F.concat_ws(" ", *item(F.col("line.l")))).alias("blob"), F.col("line.hits").alias("hits"))
    judged = [L.grounded(F.col("blob"), F.col("hits"), None, *edit) for edit in EDITS]
    edit = F.col("doc_id") % 3
    found = named.select("doc_id", "place", F.when(edit == 0, judged[0]).when(edit == 1, judged[1]).otherwise(judged[2]).alias("g"))
    count = lambda c: F.count(F.when(c, 1))
    return found.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("proposals"), count(F.col("g.keep")).alias("accepted"), count(F.size("g.delta_hits") > 0).alias("in_delta"),
        count(F.size("g.profile_hits") > 0).alias("in_profile"), count(F.size("g.blocked_hits") > 0).alias("blocked"),
        F.coalesce(F.sum(F.when(F.col("g.keep"), F.col("place") + 1)), F.lit(0)).alias("places"),
    )
