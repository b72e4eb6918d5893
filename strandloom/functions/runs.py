"""Groups streamed from sorted partitions: one Python call for a partition, one group in memory at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string


def fold_groups(df: DataFrame, key: list[str], order: list[str], body: Callable[[list[dict]], Iterable[tuple]], schema: str) -> DataFrame:
    """``body`` of each group's rows, sorted by ``order``; it returns tuples of the schema's columns.

    For many small groups: they are shuffled once by key and cut where the key changes, without a call for each.
    """
    with_types: StructType = _parse_datatype_string(schema)
    arrow = to_arrow_schema(with_types)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        out: list[tuple] = []

        def packed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], arrow.field(i).type) for i in range(len(arrow))], schema=arrow)

        for batch in batches:
            for row in batch.to_pylist():
                if held and any(row[k] != held[0][k] for k in key):
                    out.extend(body(held))
                    held = []
                held.append(row)
            if len(out) >= 10_000:
                yield packed()
                out = []
        if held:
            out.extend(body(held))
        if out:
            yield packed()

    return df.repartition(*key).sortWithinPartitions(*key, *order).mapInArrow(run, with_types)
