"""Words, batches and row helpers shared by the operators of this subpackage.

Texts travel as UTF-8 bytes: ``bytes.split`` cuts exactly at the six ASCII white-space bytes
(``[\\x20\\x09-\\x0D]``) and ``bytes.lower`` changes A-Z alone, which is what the operators ask for.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from string import ascii_lowercase as LOWER
from string import ascii_uppercase as UPPER

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def utf8(column: pa.Array) -> list[bytes]:
    """The texts of an Arrow column as bytes; null is empty."""
    return [b or b"" for b in column.cast(pa.binary()).to_pylist()]


def words(text: bytes) -> list[bytes]:
    return text.split()


def lower_words(text: bytes) -> list[bytes]:
    return text.lower().split()


def arrow_schema(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def per_row(df: DataFrame, schema: str, of: Callable[[dict[str, list]], Iterable[list]],
            columns: Iterable[str], text: str = "text") -> DataFrame:
    """``df`` reduced to ``columns`` and mapped batch by batch: ``of`` gets the columns as lists
    (texts as bytes) and returns the output columns."""
    picked = df.select(*columns)
    out = T.StructType.fromDDL(schema)
    target = arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = {name: utf8(batch.column(name)) if name == text
                    else batch.column(name).to_pylist() for name in batch.schema.names}
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(of(data), target)], schema=target)

    return picked.mapInArrow(run, out)


def whole_number(column: str) -> F.Column:
    """An id column as long, whatever integer type the table has."""
    return F.col(column).cast("long").alias(column)
