"""Small helpers of the functions that take Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.sources.ship import ship

#: Texts of about so many bytes are worked on together.
SLICE_BYTES = 8 << 20


def text_rows(docs: DataFrame, *more: str | Column) -> DataFrame:
    """``doc_id`` as bigint and ``text`` as string, then ``more``; the code is sent along."""
    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"), *more)


def slices(batches: Iterator[pa.RecordBatch], limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in slices whose ``text`` has at most ``limit`` bytes, or in single rows."""
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index("text"))
        at, size = 0, 0
        for i in range(len(batch)):
            n = len(texts[i].as_buffer()) if texts[i].is_valid else 0
            if i > at and size + n > limit:
                yield batch.slice(at, i - at)
                at, size = i, 0
            size += n
        if at < len(batch):
            yield batch.slice(at)


def encoded(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of every text; nothing for a null."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]
