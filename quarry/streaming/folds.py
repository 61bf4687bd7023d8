"""A fold over each key's rows in order, with one row's state at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType


def sorted_fold(rows: DataFrame, keys: list[str], order: list[str], takes: list[str], start: Callable[[], object], step: Callable[..., tuple[object, tuple]], adds: str) -> DataFrame:
    """``rows`` with the columns ``adds`` (a schema), which ``step(state, *takes)`` makes of each row, with the next state.

    Rows are dealt by ``keys`` and sorted by Spark, which spills, and stream through a task in batches; a key begins with
    ``start()``. What is held is one batch and one state, whatever a key's rows are many. One
    key's rows stay in one task, as each row's result depends on all before it.
    """
    added = StructType.fromDDL(adds)
    kinds = [to_arrow_type(f.dataType) for f in added]
    names = [*rows.columns, *added.names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in takes]
            out = []
            for now, *values in zip(zip(*(batch.column(k).to_pylist() for k in keys), strict=True), *columns, strict=True):
                if now != key:
                    key, state = now, start()
                state, made = step(state, *values)
                out.append(made)
            yield pa.record_batch([*batch.columns, *(pa.array([o[i] for o in out], kind) for i, kind in enumerate(kinds))], names)

    ordered = rows.repartition(*keys).sortWithinPartitions(*keys, *order)
    return ordered.mapInArrow(run, StructType([*rows.schema.fields, *added.fields]))
