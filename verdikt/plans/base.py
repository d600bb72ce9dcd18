"""How the driver tables play the roles of the evaluation model.

example   = documents.source       candidate = documents row
family    = documents.lang         quality   = labels (left join)
rubrics   = the rule table below, evaluated as predicates on the whole text
pairs     = documents 2k and 2k+1 as answers A and B of pair k

Text never travels through a shuffle: every plan first projects the narrow
features it needs in the scan stage.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verdikt.functions import text as T


@dataclass(frozen=True)
class Rule:
    rubric_id: str
    text: str
    column: object          # text Column -> boolean Column
    sql: str                # same predicate in SQL
    kind: str = ""          # '', correctness, format, style, proxy


def _rx(pattern: str):
    return lambda c: c.rlike(pattern)


RULES = [
    Rule("r01", "The note includes at least three lines.",
         lambda c: T.count_of(c, "\n") >= 2,
         "length(text) - length(replace(text, chr(10), '')) >= 2"),
    Rule("r02", "The note contains eight hundred characters or more.",
         lambda c: F.length(c) >= 800, "length(text) >= 800"),
    Rule("r03", "The note specifies a number.",
         _rx("[0-9]"), "regexp_matches(text, '[0-9]')", "correctness"),
    Rule("r04", "The note uses the common article.",
         lambda c: F.lower(c).rlike(T.word_bound("the")),
         "regexp_matches(lower(text), '(^|[^a-z0-9])the($|[^a-z0-9])')"),
    Rule("r05", "The note has a table bar or a bullet line.",
         lambda c: F.contains(c, F.lit("|")) | c.rlike(r"(^|\n)[-*] "),
         "contains(text, '|') OR regexp_matches(text, '(^|\\n)[-*] ')", "format"),
    Rule("r06", "The note separates its parts with commas.",
         lambda c: T.count_of(c, ",") >= 5,
         "length(text) - length(replace(text, ',', '')) >= 5"),
    Rule("r07", "The note ends with a full stop.",
         _rx(r"[.]\s*\z"), r"regexp_matches(text, '[.]\s*\z')"),
    Rule("r08", "The note preserves a contact or link.",
         lambda c: F.contains(c, F.lit("@")) | F.contains(c, F.lit("http")),
         "contains(text, '@') OR contains(text, 'http')", "proxy"),
    Rule("r09", "The note asks or exclaims.",
         lambda c: F.contains(c, F.lit("?")) | F.contains(c, F.lit("!")),
         "contains(text, '?') OR contains(text, '!')"),
    Rule("r10", "The note avoids shouting.",
         lambda c: ~c.rlike("[A-Z]{5,}"), "NOT regexp_matches(text, '[A-Z]{5,}')", "style"),
]
RULE_IDS = [r.rubric_id for r in RULES]
RULE_COUNT = len(RULES)

# Weight of each rule in hundredths after the answer-type adjustment of
# weights.adjusted_weights: correctness x3, format x0.35, style x0.15, proxy x0.35.
ADJUSTED = {"": 100, "correctness": 300, "format": 35, "style": 15, "proxy": 35}
ADJUSTED_TOTAL = sum(ADJUSTED[r.kind] for r in RULES)


# tables whose rows carry long texts: worth spreading when a scan is too coarse
WIDE_TEXT = ("documents", "pages")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Scan a driver table.

    A small file with one row group is one task however many cores there are, so
    text tables with fewer scan partitions than cores are dealt out first.  A
    table of many files already has more partitions and is left as it is.
    """
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    if name in WIDE_TEXT and df.rdd.getNumPartitions() < cores:
        return df.repartition(cores)
    return df


def row_bound(spark: SparkSession, folder: str, name: str = "documents") -> int:
    """Rows of a table, read from the file footers: bounds any group of it."""
    return spark.read.parquet(f"{folder}/{name}.parquet").count()


def bucket() -> Column:
    return (
        F.when((F.col("quality") == 1) & (F.col("toxic") == 0), "gold_like")
        .when(F.col("quality") == 1, "strong_anchor")
        .when(F.col("quality") == 0, "synthetically_degraded")
        .otherwise("open_generated")
    )


def origin(bucket_col: str = "quality_bucket") -> Column:
    return (
        F.when(F.col(bucket_col).isin("gold_like", "strong_anchor"), "anchor")
        .when(F.col(bucket_col) == "synthetically_degraded", "synthetic")
        .otherwise("generated")
    )


def source_label(bucket_col: str = "quality_bucket") -> Column:
    return (
        F.when(F.col(bucket_col) == "gold_like", "reference_note")
        .when(F.col(bucket_col) == "strong_anchor", "augmented_note")
        .when(F.col(bucket_col) == "synthetically_degraded", "note_truncated")
        .otherwise("generated_note")
    )


def flags() -> list[Column]:
    return [r.column(F.col("text")).cast("int").alias(r.rubric_id) for r in RULES]


def total(cols: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, cols)


def candidates(spark: SparkSession, folder: str, *features: Column, labels: bool = True) -> DataFrame:
    """Candidate rows with rule flags; text itself is dropped after projection.

    Without ``labels`` the quality join is left out for plans that do not read it.
    """
    docs = table(spark, folder, "documents").select(
        F.col("doc_id").alias("candidate_id"),
        F.col("source").alias("example_id"),
        F.col("lang").alias("family"),
        *flags(),
        *features,
    )
    if labels:
        quality = table(spark, folder, "labels").withColumnRenamed("doc_id", "candidate_id")
        docs = docs.join(quality, "candidate_id", "left").withColumn("quality_bucket", bucket())
    return docs.withColumns({
        "satisfied_count": total([F.col(r) for r in RULE_IDS]).cast("bigint"),
        "adjusted_points": total([F.col(r.rubric_id) * ADJUSTED[r.kind] for r in RULES]).cast("bigint"),
    })


def evaluations(cands: DataFrame) -> DataFrame:
    """The fact table: one row per (candidate, rubric), no join involved."""
    facts = F.array(
        *[F.struct(F.lit(r).alias("rubric_id"), (F.col(r) == 1).alias("satisfied")) for r in RULE_IDS]
    )
    keep = [c for c in cands.columns if c not in RULE_IDS]
    return cands.select(*keep, F.inline(facts))


# ------------------------------------------------------------------ SQL side

RE2_SPACE = T.RE2_SPACE
RE2_BREAK = T.LINE_BREAK


def sql_strip(e: str) -> str:
    return f"trim({e}, '{T.SPACE_CHARS}')"


def sql_squeeze(e: str) -> str:
    return sql_strip(f"regexp_replace({e}, '{RE2_SPACE}+', ' ', 'g')")


def sql_words(e: str) -> str:
    return f"list_filter(regexp_split_to_array({e}, '{RE2_SPACE}+'), lambda w: w <> '')"


def sql_lines(e: str) -> str:
    return f"regexp_split_to_array({e}, '{RE2_BREAK}')"


def sql_full_lines(e: str) -> str:
    return (
        f"list_filter(list_transform({sql_lines(e)}, lambda x: {sql_strip('x')}), lambda x: x <> '')"
    )


def sql_tokens(e: str) -> str:
    return f"list_filter(regexp_split_to_array(lower({e}), '[^a-z0-9]+'), lambda t: t <> '')"


def sql_token_set(e: str) -> str:
    return f"list_distinct({sql_tokens(e)})"


def sql_jaccard(a: str, b: str, empty: str = "0.0") -> str:
    inter = f"len(list_intersect({a}, {b}))"
    union = f"(len({a}) + len({b}) - {inter})"
    return f"CASE WHEN {union} = 0 THEN {empty}::DOUBLE ELSE {inter} / {union}::DOUBLE END"


SQL_BUCKET = """CASE WHEN quality = 1 AND toxic = 0 THEN 'gold_like'
     WHEN quality = 1 THEN 'strong_anchor'
     WHEN quality = 0 THEN 'synthetically_degraded' ELSE 'open_generated' END"""
SQL_ORIGIN = """CASE WHEN quality_bucket IN ('gold_like','strong_anchor') THEN 'anchor'
     WHEN quality_bucket = 'synthetically_degraded' THEN 'synthetic' ELSE 'generated' END"""
SQL_LABEL = """CASE WHEN quality_bucket = 'gold_like' THEN 'reference_note'
     WHEN quality_bucket = 'strong_anchor' THEN 'augmented_note'
     WHEN quality_bucket = 'synthetically_degraded' THEN 'note_truncated' ELSE 'generated_note' END"""

SQL_STRONG = "('gold_like','strong_anchor','frontier_generated','open_generated','pair_anchor')"

CANDS = f"""flagged AS (
  SELECT d.doc_id AS candidate_id, source AS example_id, lang AS family, text,
    {SQL_BUCKET} AS quality_bucket, quality, toxic,
    {', '.join(f'({r.sql})::INT AS {r.rubric_id}' for r in RULES)}
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id),
cands AS (
  SELECT *, ({' + '.join(RULE_IDS)})::BIGINT AS satisfied_count,
    ({' + '.join(f'{r.rubric_id} * {ADJUSTED[r.kind]}' for r in RULES)})::BIGINT AS adjusted_points
  FROM flagged)"""

EVALS = CANDS + f""",
evals AS (
  UNPIVOT (SELECT candidate_id, example_id, family, quality_bucket, {', '.join(RULE_IDS)} FROM cands)
  ON {', '.join(RULE_IDS)} INTO NAME rubric_id VALUE sat)"""
