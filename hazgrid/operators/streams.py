"""Folds over the rows of a key in order, where what happens to a row depends on the last one that was kept.

The rows of a key are sorted and pass through one task in Arrow batches: a fold keeps one state and yields rows as it goes,
so nothing of a key is gathered, however many rows it has.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame

#: (state or None at a key's first row, row as a tuple) -> (state, rows to yield now)
Step = Callable[[Any, tuple], tuple[Any, list[tuple]]]


def fold(df: DataFrame, keys: list[str], order: list[str], values: list[str], schema: str, step: Step, last: Callable[[Any, tuple], list[tuple]] | None = None) -> DataFrame:
    """Rows of ``schema`` that ``step`` yields for the rows of each key in ``order``, given as (keys, order, values), and that
    ``last`` yields at a key's end, given its state and last row. Rows that are alike in keys and order come in any turn."""
    names = [*keys, *order, *values]
    n_keys = len(keys)
    fields = df.sparkSession.createDataFrame([], schema).schema
    out = pa.schema([(f.name, _arrow(f.dataType.simpleString())) for f in fields])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, before = None, None
        for batch in batches:
            found: list[tuple] = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if before is not None and row[:n_keys] != before[:n_keys]:
                    if last is not None:
                        found += last(state, before)
                    state = None
                state, more = step(state, row)
                found += more
                before = row
            if found:
                yield _batch(found, out)
        if before is not None and last is not None:
            yield _batch(last(state, before), out)

    return df.select(*names).repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _arrow(kind: str) -> pa.DataType:
    return {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_()}[kind]
