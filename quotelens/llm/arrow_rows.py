"""Map one text column of a table to new columns, batch by batch, beside columns that pass through unchanged."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .ship import ship

TEXT = "__text"
ROWS = 512


def slices(batches):
    """Batches of at most ROWS rows, so that one batch of long texts is not held several times over."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


def column(values, kind: pa.DataType) -> pa.Array:
    """An Arrow column of a list of values, or of (offsets, flat values) of a column of lists."""
    if isinstance(values, tuple):
        return pa.ListArray.from_arrays(pa.array(values[0], pa.int32()), pa.array(values[1], kind.value_type), type=kind)
    return pa.array(values, type=kind)


def with_text_columns(df: DataFrame, text: str, schema: StructType, make: Callable[[], Callable[[list], dict]],
                      keep: list[str] | None = None) -> DataFrame:
    """`keep` (default: every column of `df`) plus the columns of `schema`.

    `make()` runs once in each task and returns a function from a list of texts to a dict of columns (see `column`). New columns replace
    those of `df` with the same name. No shuffle.
    """
    ship(df.sparkSession)
    new = [f.name for f in schema]
    names = [c for c in (df.columns if keep is None else keep) if c not in new]
    source = df.select(*names, F.col(text).cast("string").alias(TEXT))
    out = StructType([source.schema[c] for c in names] + list(schema))
    arrow = to_arrow_schema(out)

    def run(batches):
        work = make()
        for batch in slices(batches):
            cols = work(batch.column(len(names)).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(i).cast(arrow.field(i).type) for i in range(len(names))]
                + [column(cols[f.name], arrow.field(f.name).type) for f in schema], schema=arrow)

    return source.mapInArrow(run, out)
