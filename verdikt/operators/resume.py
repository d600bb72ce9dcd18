"""Fingerprints of the work behind a row, and which rows a new run has to do again."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdikt.functions.keys import stable_hash


def with_fingerprint(df: DataFrame, columns: Sequence[str], settings: DataFrame | None = None, name: str = "fingerprint") -> DataFrame:
    """``df`` with a digest of the named columns and of the one row of ``settings``.

    The order of columns and of fields in them doesn't matter; a changed value,
    a null included, or another setting gives another digest.
    """
    payload = F.struct(*columns)
    kind = df.select(payload.alias("p")).schema["p"].dataType
    own = stable_hash(payload, kind)
    if settings is None:
        return df.withColumn(name, own)
    row = settings.select(F.struct("*").alias("s"))
    both = row.select(stable_hash(F.col("s"), row.schema["s"].dataType).alias("h")).take(2)
    if len(both) != 1:
        raise ValueError("settings must be one row")
    return df.withColumn(name, F.sha2(F.concat_ws("::", F.lit(both[0].h), own), 256))


def resume(current: DataFrame, earlier: DataFrame, key: str, fingerprint: str = "fingerprint") -> DataFrame:
    """``current`` with ``state``: reused, stale or new.

    ``earlier`` holds (key, fingerprint) of what earlier runs have finished, in
    any number of rows a key.  A row is reused if one of them has its fingerprint,
    stale if the key is known with others only.  Null keys are always new.
    """
    known = earlier.groupBy(F.col(key).alias("_key"), F.col(fingerprint).alias("_done")).agg(F.count(F.lit(1)).alias("_n"))
    keys = earlier.select(F.col(key).alias("_known")).distinct()
    done = current.join(known, (F.col(key) == F.col("_key")) & (F.col(fingerprint) == F.col("_done")), "left")
    state = F.when(F.col("_n").isNotNull(), "reused").when(F.col("_known").isNotNull(), "stale").otherwise("new")
    return done.join(keys, F.col(key) == F.col("_known"), "left").withColumn("state", state).drop("_key", "_done", "_n", "_known")


def pending(current: DataFrame, earlier: DataFrame, key: str, fingerprint: str = "fingerprint") -> DataFrame:
    """The rows no earlier run has finished in their present form."""
    return current.join(earlier.select(key, fingerprint).distinct(), [key, fingerprint], "left_anti")
