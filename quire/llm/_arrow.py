"""Row-wise text operators over Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from quire.llm._pieces import release

#: Rows handled at once: what a worker holds besides Spark's own batch.
ROWS = 256


def col(name: str):
    """A column by its plain name, dots included."""
    return F.col(f"`{name}`")


#: Rows of the batches that go to Python: Spark's 10,000 texts would be held several times over.
BATCH = 512


def bounded_batches(spark) -> None:
    """Smaller Arrow batches, unless the session has a number of its own.

    The setting is the session's, read when a plan runs; so it stays changed.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(BATCH))


def map_texts(
    df: DataFrame,
    text_col: str,
    keep: Sequence[str],
    fields: Sequence[StructField],
    make: Callable[[], Callable[[list], list[list]]],
    keep_memo: bool = False,
) -> DataFrame:
    """``keep`` columns of each row beside columns computed from its text.

    ``make()`` runs once in a worker's task and returns the function from the
    texts of some rows (None for null) to one list per field.  No other column
    of ``df`` is read, so extra columns can't clash with anything.
    """
    bounded_batches(df.sparkSession)
    schema = StructType([StructField(k, df.schema[k].dataType) for k in keep] + list(fields))
    types = [f.type for f in to_arrow_schema(schema)][len(keep):]
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not keep_memo:
            release()
        fn = make()
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                part = whole.slice(at, ROWS)
                out = fn(part.column(len(keep)).to_pylist())
                arrays = [part.column(i) for i in range(len(keep))]
                arrays += [pa.array(values, t) for values, t in zip(out, types, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, names)

    picked = [col(k).alias(f"k{i}") for i, k in enumerate(keep)]
    return df.select(*picked, col(text_col).alias("t")).mapInArrow(run, schema)


def explode_texts(
    df: DataFrame,
    text_col: str,
    keep: Sequence[str],
    fields: Sequence[StructField],
    make: Callable[[], Callable[[list], tuple[list[int], list[list]]]],
    keep_memo: bool = False,
) -> DataFrame:
    """As ``map_texts``, with any number of rows for each input row.

    The function returns, besides the columns, the index of the input row that
    each output row belongs to.
    """
    bounded_batches(df.sparkSession)
    schema = StructType([StructField(k, df.schema[k].dataType) for k in keep] + list(fields))
    types = [f.type for f in to_arrow_schema(schema)][len(keep):]
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not keep_memo:
            release()
        fn = make()
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                part = whole.slice(at, ROWS)
                owner, out = fn(part.column(len(keep)).to_pylist())
                take = pa.array(owner, pa.int64())
                arrays = [part.column(i).take(take) for i in range(len(keep))]
                arrays += [pa.array(values, t) for values, t in zip(out, types, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, names)

    picked = [col(k).alias(f"k{i}") for i, k in enumerate(keep)]
    return df.select(*picked, col(text_col).alias("t")).mapInArrow(run, schema)
