"""A column worked out by Python over Arrow batches, inside the row."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T


#: Bytes of a batch that are turned into Python objects at once; a row that is larger by itself goes alone.
SLICE = 1 << 20


def sliced(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in runs of rows of at most ``SLICE`` bytes, halved until they fit."""
    todo = [batch]
    while todo:
        b = todo.pop()
        if b.num_rows > 1 and b.nbytes > SLICE:
            half = b.num_rows // 2
            todo += [b.slice(half), b.slice(0, half)]
        else:
            yield b


def appended(df: DataFrame, columns: list[str], make: Callable[[], Callable[..., pa.Array]], into: str, kind: str, whole: bool = False) -> DataFrame:
    """``df`` with a column (in place of one of that name) that a function of other columns gives, slice by slice of each batch.

    ``make`` is called once for each task. The step is a wall in the plan: nothing is worked out twice behind it. With ``whole``
    the function gets each batch as it comes; it then minds its memory itself.
    """
    rest = df.drop(into) if into not in columns else df
    at = [rest.columns.index(c) for c in columns]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for b in parts if whole else chain.from_iterable(map(sliced, parts)):
            yield pa.RecordBatch.from_arrays([*b.columns, f(*[b.column(i) for i in at])], names=[*b.schema.names, into])

    return rest.mapInArrow(run, T.StructType([*rest.schema.fields, T.StructField(into, T.DataType.fromDDL(kind))]))
