"""Passes over the rows of a key in order, without holding them."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import groupby
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

ROWS_OUT = 4096


def arrow_rows(rows: Iterable[tuple], schema: pa.Schema, per_batch: int = ROWS_OUT) -> Iterator[pa.RecordBatch]:
    """Batches of rows as they are made."""
    made: list[tuple] = []
    for row in rows:
        made.append(row)
        if len(made) == per_batch:
            yield _batch(made, schema)
            made = []
    if made:
        yield _batch(made, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def map_rows(df: DataFrame, fn: Callable[[Iterator[dict[str, Any]]], Iterable[tuple]], schema: str) -> DataFrame:
    """``fn`` over the rows of each partition."""
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return arrow_rows(fn(row for batch in batches for row in batch.to_pylist()), arrow)

    return df.mapInArrow(run, schema)


def fold_in_order(df: DataFrame, by: list[str], order: list[str], fold: Callable[[tuple, Iterator[dict[str, Any]]], Iterable[tuple]], schema: str) -> DataFrame:
    """``fold(key, rows)`` over the rows of each key in order: Spark shuffles and sorts, a task sees one row at a time."""

    def each(rows: Iterator[dict[str, Any]]) -> Iterator[tuple]:
        for key, own in groupby(rows, key=lambda r: tuple(r[c] for c in by)):
            yield from fold(key, own)

    # Stated, as keys are many and small: merging partitions by their bytes would leave the Python work to few tasks.
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return map_rows(df.repartition(parts, *by).sortWithinPartitions(*by, *order), each, schema)
