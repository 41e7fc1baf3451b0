"""Python work on texts inside tasks, batch by batch as Arrow."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tunedata.session import ship_package

from .common import fresh

#: A batch of texts handed on to numpy holds about so many characters at most
#: (or one text), however many rows an Arrow batch has.
BATCH_CHARS = 4 << 20


def runs(column: pa.Array) -> Iterator[tuple[slice, list[str | None]]]:
    """Consecutive pieces of an Arrow column of texts, of about BATCH_CHARS
    bytes each (or one text), with their texts as Python strings."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    start, size = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if i > start and size + n > BATCH_CHARS:
            yield slice(start, i), column.slice(start, i - start).to_pylist()
            start, size = i, 0
        size += n
    if start < len(sizes):
        yield slice(start, len(sizes)), column.slice(start).to_pylist()


def add_columns(df: DataFrame, text_col: str, keep: list[str], added: str,
                work: Callable[[list[str | None]], list[tuple]]) -> DataFrame:
    """``keep`` columns as they are (ids never pass through floats) and the
    ``added`` columns (a schema string) that ``work`` makes from the texts, one
    tuple a row."""
    ship_package(df.sparkSession)
    [own] = fresh(keep, "text")
    source = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text_col}`").alias(own))
    extra = df.sparkSession.createDataFrame([], added).schema
    types = [_arrow(f.dataType) for f in extra]
    schema = source.drop(own).schema
    for f in extra:
        schema = schema.add(f)
    names = [f.name for f in schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in runs(batch.column(batch.num_columns - 1)):
                rows = work(texts)
                piece = batch.slice(part.start, part.stop - part.start)
                columns = [piece.column(i) for i in range(piece.num_columns - 1)]
                columns += [pa.array([r[i] for r in rows], t) for i, t in enumerate(types)]
                yield pa.RecordBatch.from_arrays(columns, names)

    return source.mapInArrow(run, schema)


def _arrow(kind) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)
