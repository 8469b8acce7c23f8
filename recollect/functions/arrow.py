"""Python over Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame


def task_mapper(df: DataFrame, columns: list, schema: str, make: Callable[[], Callable]) -> DataFrame:
    """Apply a function of column lists to every Arrow batch of ``columns``.

    ``columns`` are Columns, already aliased; only they reach Python.  ``make`` runs
    once per task and returns ``f(list, list, ...) -> tuple of lists``, one list for
    each output field.  Rows in and rows out need not be equally many.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    out = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = None
        for batch in batches:
            f = f or make()
            lists = f(*(c.to_pylist() for c in batch.columns))
            yield pa.RecordBatch.from_arrays([pa.array(x, field.type) for x, field in zip(lists, out)], schema=out)

    return df.select(*columns).mapInArrow(run, schema)


def batch_mapper(df: DataFrame, columns: list, schema: str, f: Callable) -> DataFrame:
    """``task_mapper`` for a function that needs no preparation."""
    return task_mapper(df, columns, schema, lambda: f)
