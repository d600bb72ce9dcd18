"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator
from zlib import crc32

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructField, StructType

from verdikt.session import ship_package

SLICE_CHARS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a local session without one gets its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        import tempfile

        folder = tempfile.mkdtemp(prefix="verdikt-checkpoint-")
        spark.sparkContext.setCheckpointDir(folder)
        folder = spark.sparkContext.getCheckpointDir()
    return folder


def pin(df: DataFrame, label: str) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends here."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fold(key: Column, parts: int) -> Column:
    """crc32 of the key as text, modulo ``parts``; null keys count as fold 0 of the empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % F.lit(parts)


def fold_of(key: object, parts: int) -> int:
    return crc32(b"" if key is None else str(key).encode()) % parts


def map_batches(
    df: DataFrame,
    columns: list[str],
    fn: Callable[[pa.RecordBatch], pa.RecordBatch | pa.Table],
    schema: str,
) -> DataFrame:
    """``fn`` over Arrow batches of the named columns alone, in scan order, without a shuffle."""
    ship_package(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                out = fn(part)
                yield from out.to_batches() if isinstance(out, pa.Table) else [out]

    return df.select(*columns).mapInArrow(run, schema)


def with_column_of(df: DataFrame, source: str, target: str, kind: DataType, fn: Callable[[list], pa.Array]) -> DataFrame:
    """``df`` with a column ``target`` that ``fn`` makes of whole values of ``source``, in scan order, no shuffle.

    A column of that name is replaced in its place.  Values are turned into
    Python objects a few hundred rows at a time.
    """
    ship_package(df.sparkSession)
    names = df.columns if target in df.columns else [*df.columns, target]
    schema = StructType([StructField(n, kind) if n == target else df.schema[n] for n in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 500):
                made = fn(part[source].to_pylist())
                yield pa.RecordBatch.from_arrays([made if n == target else part[n] for n in names], names)

    return df.mapInArrow(run, schema)


def slices(batch: pa.RecordBatch, rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """Smaller batches, so that what a task holds at once does not follow the batch size."""
    for start in range(0, batch.num_rows, rows):
        yield batch.slice(start, rows)


def chunks(texts: list[str], limit: int = SLICE_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts of about ``limit`` characters together, one text at least."""
    start, held = 0, 0
    for i, text in enumerate(texts):
        if held and held + len(text) > limit:
            yield start, i
            start, held = i, 0
        held += len(text)
    if start < len(texts):
        yield start, len(texts)


def texts_of(column: pa.Array) -> list[str]:
    return [text or "" for text in column.to_pylist()]


def learned_labels(labels: DataFrame, label: str, folds: int = 5) -> DataFrame:
    """(doc_id, label) of the labelled ids with fold other than 0, one row each."""
    return (
        labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (fold(F.col("doc_id"), folds) != 0))
        .groupBy("doc_id")
        .agg(F.max(F.col(label).cast("int")).alias("label"))
    )


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, bounds: dict[int, int], folds: int = 5) -> DataFrame:
    """A bounded sample of (doc_id, text, label) with fold other than 0.

    ``bounds`` gives the most rows for each label value.  Rows with the smallest
    hash of the id are taken, so a sample does not depend on partitioning.
    A repeated doc_id counts once.  Only ids are sorted; the texts are read by a
    join with at most ``sum(bounds.values())`` ids.
    """
    keys = learned_labels(labels, label, folds).withColumn("at", F.xxhash64("doc_id"))
    parts = [keys.where(F.col("label") == value).orderBy("at", "doc_id").limit(most) for value, most in bounds.items()]
    ids = parts[0]
    for part in parts[1:]:
        ids = ids.unionByName(part)
    texts = docs.select("doc_id", "text").join(F.broadcast(ids.select("doc_id", "label")), "doc_id")
    return texts.groupBy("doc_id", "label").agg(F.min("text").alias("text"))


def logistic(x: float) -> float:
    return 1 / (1 + math.exp(-x)) if x >= 0 else math.exp(x) / (1 + math.exp(x))
