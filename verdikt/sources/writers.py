"""Sinks: JSON lines, CSV, report bundles and packaged evaluations."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdikt.functions import rubrics as X
from verdikt.sources.readers import STAMP


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


def append_cache(df: DataFrame, path: str) -> None:
    """Append key/payload records with the time of the call; readers take the latest per key."""
    df.withColumn(STAMP, F.lit(time.time_ns())).write.mode("append").json(path)


def write_csv(df: DataFrame, path: str) -> bool:
    """CSV with header; nothing is written for an empty table."""
    if df.isEmpty():
        return False
    df.write.mode("overwrite").option("header", True).csv(path)
    return True


def write_bundle(tables: dict[str, DataFrame], folder: str) -> list[str]:
    """One CSV folder per non-empty report table."""
    return [name for name, df in tables.items() if write_csv(df, f"{folder}/{name}")]


def markdown_table(df: DataFrame, limit: int = 200) -> str:
    """A small aggregate as a markdown table; a row over the limit is an error."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} rows: write the table instead")
    head = "| " + " | ".join(df.columns) + " |"
    rule = "| " + " | ".join("---" for _ in df.columns) + " |"
    body = ["| " + " | ".join(f"{v:.3f}" if isinstance(v, float) else str(v) for v in r) + " |" for r in rows]
    return "\n".join([head, rule, *body])


def clipped(reasoning: Column, limit: int | None) -> Column:
    """The whole text, or its first ``limit`` characters and three dots where a limit is given."""
    text = F.coalesce(reasoning, F.lit(""))
    if limit is None:
        return text
    return F.when(F.length(text) > limit, F.concat(F.rtrim(F.substring(text, 1, limit)), F.lit("..."))).otherwise(text)


def package_evaluations(evals: DataFrame, rubrics: DataFrame, candidates: DataFrame, limit: int | None = None) -> DataFrame:
    """Evaluations joined to rubric texts and candidates; unknown candidates get a role."""
    r = rubrics.select("example_id", "rubric_id", F.col("text").alias("rubric_text"))
    c = candidates.select(
        "example_id", "candidate_id", X.candidate_role(F.col("origin_kind"), F.col("source_label")).alias("role"),
        F.col("origin_kind").alias("candidate_origin"), F.col("text").alias("candidate_text"),
    )
    joined = evals.join(r, ["example_id", "rubric_id"], "left").join(c, ["example_id", "candidate_id"], "left")
    return joined.select(
        X.short_id(F.col("example_id")).alias("id"), "example_id", "rubric_id",
        F.coalesce("rubric_text", F.lit("")).alias("rubric_text"), "candidate_id",
        F.coalesce("role", F.lit("unknown")).alias("candidate_role"), "candidate_origin", "candidate_text", "satisfied",
        clipped(F.col("reasoning"), limit).alias("reasoning"),
    )


def aligned_to(rows: DataFrame, order: DataFrame, key: str = "id") -> DataFrame:
    """Rows in the order of an alignment table (key, position)."""
    return rows.join(order.select(key, "position"), key).orderBy("position")


def project(rows: DataFrame, fields: list[str], label: str | None = None) -> DataFrame:
    """Keep listed fields; drop rows with a missing one or an invalid label."""
    kept = rows.select(*fields).dropna(subset=fields)
    if label:
        kept = kept.where(F.col(label).isin("reference_answer_a", "reference_answer_b"))
    return kept
