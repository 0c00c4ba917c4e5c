"""Sequential scans: for rules whose next answer depends on all before, in order, within a key."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T


def ordered_scan(df: DataFrame, keys: list[str], order: list[str], start: Callable[[], object], step: Callable[..., tuple[object, object]], uses: list[str], out: str, kind: T.DataType) -> DataFrame:
    """df with out = the answers of step(state, *uses) -> (state, answer) over each key's rows in order.

    Rows are sorted by shuffle and stream through; a task holds one key's state and never its rows.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = None, None
        for batch in batches:
            answers = []
            own = zip(*(batch.column(c).to_pylist() for c in keys), strict=True)
            rows = zip(*(batch.column(c).to_pylist() for c in uses), strict=True)
            for key, row in zip(own, rows, strict=True):
                if key != last:
                    last, state = key, start()
                state, answer = step(state, *row)
                answers.append(answer)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(answers, arrow)], names=[*batch.schema.names, out])

    from pyspark.sql.pandas.types import to_arrow_type

    arrow = to_arrow_type(kind)
    ordered = df.repartition(*keys).sortWithinPartitions(*keys, *order)
    return ordered.mapInArrow(scan, T.StructType([*df.schema.fields, T.StructField(out, kind)]))
