"""Scans: raw JSON rows, normalised examples, caches, libraries, artifacts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verdikt.functions import rubrics as X
from verdikt.functions import text as T
from verdikt.operators.merge import latest_per_key

FIELDS = "map<string,string>"
STAMP = "appended_at"

# Column aliases in order of preference.
CONTEXT_KEYS = ("conversation", "dialogue", "transcript", "input", "context", "source_context", "source_text",
                "request_context")
PROMPT_KEYS = ("task_prompt", "instruction", "instructions", "prompt", "task", "request", "user_request",
               "Question", "question")
REFERENCE_KEYS = ("reference_artifact", "reference_output", "reference_response", "reference_text", "reference_note",
                  "ideal_completion", "ideal_output", "gold_output", "target")
AUGMENTED_KEYS = ("augmented_artifact", "augmented_output", "augmented_response", "augmented_text", "augmented_note",
                  "candidate_output", "candidate_response", "response", "assistant_response", "completion", "output",
                  "alt_completion")
TRUNCATED_KEYS = ("artifact_truncated", "output_truncated", "response_truncated", "note_truncated")
SIDE_A_KEYS = ("reference_answer_a", "response_a", "answer_a", "candidate_a", "pair_response_a")
SIDE_B_KEYS = ("reference_answer_b", "response_b", "answer_b", "candidate_b", "pair_response_b")
LABEL_KEYS = ("correct_answer", "preferred_answer", "pair_correct_label", "winner", "label")
SUMMARY_KEYS = ("structured_summary", "summary_json", "structured_context")
OTHER_KEYS = ("source", "source_id", "id", "dataset_subset", "task_profile_id", "task_family_id", "artifact_kind",
              "note_family_id")
KNOWN_KEYS = (*OTHER_KEYS, *CONTEXT_KEYS, *PROMPT_KEYS, *REFERENCE_KEYS, *AUGMENTED_KEYS, *TRUNCATED_KEYS,
              *SUMMARY_KEYS, *SIDE_A_KEYS, *SIDE_B_KEYS, *LABEL_KEYS)


def read_rows(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """JSON lines as (row_key, raw, fields).

    ``row_key`` is a digest of the whole line: it names a row that has no id of its
    own and does not depend on how files are split; equal lines share it.  Blank
    lines, malformed lines and rows that are not objects are skipped; strict mode
    raises on the first malformed line instead.
    """
    lines = spark.read.text(path).where(F.trim("value") != "")
    mode = {"mode": "FAILFAST"} if strict else {}
    parsed = lines.select(row_key(F.col("value")), F.col("value").alias("raw"), F.from_json("value", FIELDS, mode).alias("fields"))
    return parsed if strict else parsed.where(F.col("fields").isNotNull() & F.trim("raw").startswith("{"))


def row_key(raw: Column) -> Column:
    return F.substring(F.sha2(raw, 256), 1, 20).alias("row_key")


def read_payload(spark: SparkSession, path: str) -> DataFrame:
    """A whole-file JSON array, or the list under ``rows`` or ``examples``."""
    whole = spark.read.text(path, wholetext=True)
    nested = F.from_json("value", "struct<rows:array<variant>,examples:array<variant>>")
    listed = F.coalesce(F.from_json("value", "array<variant>"), nested["rows"], nested["examples"])
    rows = whole.select(F.explode(listed).alias("row")).select(F.to_json("row").alias("raw"))  # value types stay
    return rows.select(row_key(F.col("raw")), "raw", F.from_json("raw", FIELDS).alias("fields")).where(F.col("fields").isNotNull())


def field(*keys: str) -> Column:
    """First non-blank value among the aliases."""
    return T.first_text(*[F.col("fields")[k] for k in keys])


def normalize(rows: DataFrame, reference_first: Sequence[str] = (), source_filter: str | None = None) -> DataFrame:
    """Raw rows to the fixed example schema, unknown columns kept as JSON."""
    reference = field(*dict.fromkeys([*reference_first, *REFERENCE_KEYS]))
    blob = F.concat_ws(
        " ", F.nullif(field(*PROMPT_KEYS), F.lit("")),
        F.nullif(T.joined_context(*[F.col("fields")[k] for k in CONTEXT_KEYS]), F.lit("")),
        F.nullif(field("task_family_id"), F.lit("")), F.nullif(field("artifact_kind"), F.lit("")),
    )
    is_note = (field("reference_note") != "") | (field("augmented_note") != "")
    explicit = field("task_profile_id")
    base = rows.withColumns({
        "profile": F.when(explicit != "", explicit).otherwise(X.profile_by_substring(blob, is_note)),
        "reference": reference,
        "augmented": field(*AUGMENTED_KEYS),
        "truncated": field(*TRUNCATED_KEYS),
        "a": field(*SIDE_A_KEYS), "b": field(*SIDE_B_KEYS),
    })
    source = F.when(field("source") != "", field("source")).otherwise(F.col("profile"))
    labels = [F.nullif(_label(F.col("raw"), k), F.lit("")) for k in LABEL_KEYS]
    both = (F.col("a") != "") & (F.col("b") != "")
    augmented = F.when(F.col("augmented") == F.col("reference"), "").otherwise(F.col("augmented"))
    out = base.select(
        "row_key",
        X.example_key(source, field("source_id", "id"), F.col("row_key")).alias("example_id"),
        source.alias("source"),
        field("source_id", "id").alias("source_id"),
        field("dataset_subset").alias("dataset_subset"),
        T.joined_context(*[F.col("fields")[k] for k in CONTEXT_KEYS]).alias("conversation"),
        field(*PROMPT_KEYS).alias("task_prompt"),
        F.col("reference").alias("reference_artifact"),
        augmented.alias("augmented_artifact"),
        F.col("truncated").alias("artifact_truncated"),
        F.col("profile").alias("task_profile_id"),
        field("task_family_id", "note_family_id").alias("task_family_id"),
        F.when(field("artifact_kind") != "", field("artifact_kind"))
        .when(F.col("profile").isin("note_documentation", "documentation_variants"), "note")
        .when(F.col("profile").isin("general_instruction_following", "clinical_decision_support"), "response")
        .otherwise("artifact").alias("artifact_kind"),
        field(*SUMMARY_KEYS).alias("structured_summary"),
        F.col("a").alias("pair_response_a"), F.col("b").alias("pair_response_b"),
        F.when(both, F.coalesce(*labels, F.lit(""))).otherwise("").alias("pair_correct_label"),
        F.to_json(F.map_filter("fields", lambda k, v: ~k.isin(*KNOWN_KEYS))).alias("extra_fields"),
    )
    if source_filter:
        out = out.where(F.contains(F.lower("source"), F.lit(source_filter.lower())))
    return out


def _label(raw: Column, key: str) -> Column:
    """Label aliases as JSON text, or the JSON numbers 0 and 1; digits as text, true and false stay unlabelled."""
    value = F.try_variant_get(F.try_parse_json(raw), f"$.{key}", "variant")
    kind, text = F.schema_of_variant(value), F.try_variant_get(value, "$", "string")
    number = F.try_variant_get(value, "$", "double").cast("int")
    return F.when(kind == "STRING", X.pair_label(text)).when(kind != "BOOLEAN", X.numeric_pair_label(number)).otherwise("")


def anchors(examples: DataFrame) -> DataFrame:
    """Anchor candidates; a labelled pair replaces the note anchors."""
    def anchor(suffix: str, text: str, label: str, bucket: str, kind: str) -> Column:
        return F.struct(
            F.concat(F.col("example_id"), F.lit(f"__{suffix}")).alias("candidate_id"), F.col(text).alias("text"),
            F.lit(label).alias("source_label"), F.lit(bucket).alias("quality_bucket"), F.lit(kind).alias("origin_kind"),
        )

    pair = F.array(
        anchor("pair_a", "pair_response_a", "pair_response_a", "pair_anchor", "pair_anchor"),
        anchor("pair_b", "pair_response_b", "pair_response_b", "pair_anchor", "pair_anchor"),
    )
    notes = F.array(
        anchor("reference_note", "reference_artifact", "reference_note", "gold_like", "anchor"),
        anchor("augmented_note", "augmented_artifact", "augmented_note", "strong_anchor", "anchor"),
        anchor("note_truncated", "artifact_truncated", "note_truncated", "synthetically_degraded", "anchor"),
    )
    has_pair = (F.col("pair_response_a") != "") & (F.col("pair_response_b") != "")
    rows = F.filter(F.when(has_pair, pair).otherwise(notes), lambda c: c["text"] != "")
    return examples.select("example_id", "pair_correct_label", F.inline_outer(rows)).where(F.col("candidate_id").isNotNull())


def read_cache(spark: SparkSession, path: str, value: str = "raw") -> DataFrame:
    """Append-only log of {"key": ..., payload}: the record appended last wins.

    append_cache stamps every record; records without a stamp are older than all
    others, and of equal stamps the greater text wins.
    """
    fields = F.col("fields")
    rows = read_rows(spark, path).select(
        fields["key"].alias("key"), F.struct(F.coalesce(fields[STAMP].cast("bigint"), F.lit(-1)), F.col("raw")).alias("at"), "raw"
    )
    log = rows.where(F.coalesce("key", F.lit("")) != "")
    return latest_per_key(log, "key", "at", ["raw"]).select("key", F.col("raw").alias(value))


def cached_votes(requests: DataFrame, cache: DataFrame, fallback: Column) -> DataFrame:
    """Join model verdicts by content key; a miss takes the deterministic fallback.

    The cache side is left to Spark's size-based join choice.
    """
    hit = F.col("verdict").isNotNull()
    return requests.join(cache.select("key", "verdict"), "key", "left").select(
        *requests.columns, F.coalesce("verdict", fallback).alias("satisfied"), hit.alias("cache_hit")
    )


def read_run_artifacts(spark: SparkSession, run_dir: str) -> DataFrame:
    """Pair artifacts below a run folder; the last path of a pair wins."""
    raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").text(run_dir, wholetext=True)
    path = F.col("_metadata.file_path")
    get = lambda p: F.get_json_object("value", p)
    rows = raw.select(
        get("$.pair.pair_id").alias("pair_id"), path.alias("path"), get("$.pair.label").alias("label"),
        get("$.pair.source_family").alias("source_family"),
        get("$.scoring.whitened_uniform.result.decision").alias("decision"),
        get("$.scoring.whitened_uniform.result.decision_policy").alias("policy"),
        get("$.scoring.whitened_uniform.result.base_decision").alias("base_decision"),
        get("$.scoring.pair_verifier.decision_source").alias("decision_source"),
        F.lower(get("$.scoring.pair_verifier.confidence")).alias("confidence"),
    ).where(F.contains(path, F.lit("/examples/")) & (F.coalesce("pair_id", F.lit("")) != ""))
    carried = [c for c in rows.columns if c not in ("pair_id", "path")]
    return latest_per_key(rows, "pair_id", "path", carried)


def read_slice(spark: SparkSession, path: str, name: str, families: Sequence[str]) -> DataFrame:
    """Held-out pairs: chosen/rejected aliases, unknown labels and families normalised."""
    label, family = field("label"), F.lower(field("source_family"))
    return read_rows(spark, path).select(
        F.when(field("pair_id") != "", field("pair_id"))
        .otherwise(F.concat(F.lit(f"{name}_"), F.col("row_key"))).alias("pair_id"),
        field("prompt").alias("prompt"), field("response_a", "chosen").alias("response_a"),
        field("response_b", "rejected").alias("response_b"),
        F.when(label.isin("A>B", "B>A", "A=B"), label).otherwise("A>B").alias("label"),
        F.when(family.isin(*families), family).otherwise("generic").alias("source_family"),
    )


def read_preferences(spark: SparkSession, path: str, mapping: Mapping[str, str], source: str) -> DataFrame:
    """Preference JSON lines under a column mapping; incomplete rows are dropped."""
    cols = {c: field(mapping.get(c, c)) for c in ("pair_id", "prompt", "chosen", "rejected", "source_family", "focus_kind")}
    rows = read_rows(spark, path).select(*[v.alias(k) for k, v in cols.items()], F.lit(source).alias("source"))
    parts = [F.sha2(F.col(c), 256) for c in ("source", "prompt", "chosen", "rejected")]  # whole texts
    digest = F.substring(F.sha2(F.concat_ws(":", *parts), 256), 1, 20)
    kept = rows.where((F.col("prompt") != "") & (F.col("chosen") != "") & (F.col("rejected") != ""))
    return kept.withColumn("pair_id", F.when(F.col("pair_id") != "", F.col("pair_id")).otherwise(digest))


def read_vector_index(spark: SparkSession, path: str, dim: int) -> DataFrame:
    """Index items; rows without id or text or with a wrong-sized vector are skipped."""
    schema = ("rubric_id string, text string, embedding array<double>, occurrence_count bigint, "
              "coverage_count bigint, depth int, severity_tier string")
    return spark.read.schema(schema).json(path).where(
        (F.coalesce("rubric_id", F.lit("")) != "") & (F.coalesce("text", F.lit("")) != "") & (F.size("embedding") == dim)
    )


EXPERT_SCHEMA = (
    "prompt_id string, dialogue string, reference_answer string, "
    "completions array<struct<id:string,text:string,source:string>>, "
    "expert_rubrics array<struct<criterion:string,points:int,tags:array<string>>>"
)


def read_expert_examples(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(EXPERT_SCHEMA).json(path).where(F.coalesce("prompt_id", F.lit("")) != "")


def read_library(spark: SparkSession, path: str) -> DataFrame:
    """Criteria library; no family means generic."""
    schema = ("criterion_id string, dimension string, label string, requirement string, severity_tier string, "
              "applicable_families array<string>, source_tag string, focus_kind string, direction_evidence int")
    tiers = ("hard_gate", "high", "medium", "low")
    rows = spark.read.schema(schema).json(path).where(F.coalesce("criterion_id", F.lit("")) != "")
    fams = F.when(F.coalesce(F.size("applicable_families"), F.lit(0)) <= 0, F.array(F.lit("generic"))).otherwise(
        F.col("applicable_families")
    )
    tier = F.lower(F.coalesce("severity_tier", F.lit("")))
    return rows.withColumns({
        "applicable_families": fams, "severity_tier": F.when(tier.isin(*tiers), tier).otherwise("medium"),
        "focus_kind": F.coalesce("focus_kind", F.lit("")), "direction_evidence": F.coalesce("direction_evidence", F.lit(0)),
    })
