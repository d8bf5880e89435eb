"""Adding columns to every row with a function over Arrow columns."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T


def schema_with(df: DataFrame, added: dict[str, str]) -> T.StructType:
    extra = T.StructType.fromDDL(", ".join(f"`{k}` {v}" for k, v in added.items()))
    return T.StructType([*df.schema.fields, *extra.fields])


def add_columns(df: DataFrame, source: str, added: dict[str, str], make: Callable[[pa.Array], list[pa.Array]]) -> DataFrame:
    """``df`` and the columns that ``make`` gives for batches of column ``source``.

    Columns of ``df`` that have one of the added names are replaced; all others
    pass through.  Works per batch, so memory is bounded by the batch.
    """
    df = df.drop(*[name for name in added if name != source])
    schema = schema_with(df, added)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = make(batch.column(batch.schema.names.index(source)))
            yield pa.RecordBatch.from_arrays([*batch.columns, *out], names=[*batch.schema.names, *added])

    return df.mapInArrow(run, schema)
