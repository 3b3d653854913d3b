"""Append columns that a Python function computes from one text column, in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql.types import StructField, StructType

from .common import text_slices


def annotate(df: DataFrame, text: str, fields: list[StructField], make: Callable[[], Callable]) -> DataFrame:
    """df with `fields` appended (columns of those names are replaced).

    make() runs once in each task and returns f(column) -> one list for each field; it sees the text column in slices of
    about 2 MB, or one text if that is longer, which bounds a task's memory.
    """
    df = df.drop(*[f.name for f in fields])
    schema = StructType([*df.schema.fields, *fields])

    def run(batches) -> Iterator:
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_type

        apply = make()
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text))
            for a, b in text_slices(column):
                made = apply(column.slice(a, b - a))
                new = [pa.array(v, type=to_arrow_type(f.dataType)) for v, f in zip(made, fields, strict=True)]
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*part.columns, *new], names=[*part.schema.names, *[f.name for f in fields]])

    return df.mapInArrow(run, schema)
