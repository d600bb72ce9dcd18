"""Columns that Python computes from the values of one row, a few rows at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import DataType, StructField, StructType

from verdikt.session import ship_package

ROWS = 64  # held as Python objects at once, whatever the Arrow batch holds


def with_python_column(df: DataFrame, sources: Sequence[str], target: str, kind: DataType, fn: Callable, rows: int = ROWS) -> DataFrame:
    """``df`` without ``sources`` and with ``target``, which ``fn`` makes of their values in one row; no shuffle."""
    ship_package(df.sparkSession)
    kept = [n for n in df.columns if n not in sources]
    schema = StructType([*[df.schema[n] for n in kept], StructField(target, kind)])
    from pyspark.sql.pandas.types import to_arrow_type

    made_type = to_arrow_type(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, rows):
                part = batch.slice(start, rows)
                made = [fn(*values) for values in zip(*(part[n].to_pylist() for n in sources), strict=True)]
                yield pa.RecordBatch.from_arrays([*[part[n] for n in kept], pa.array(made, made_type)], [*kept, target])

    return df.mapInArrow(run, schema)
