"""Helpers the text operators share."""

from __future__ import annotations

import ctypes
import gc
import sys
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space that separates words, as a character class; ``bytes.split()`` separates at the same bytes.
SPACE = r"[\x20\x09-\x0D]"
#: A task takes this many bytes of text at a time, or one text if that is longer.
BATCH_BYTES = 4 << 20


def read(spark, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def unused(name: str, df: DataFrame) -> str:
    """A column name that ``df`` does not have yet."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def give_back(run: Callable) -> Callable:
    """A task function that returns freed memory to the system at its end: workers are used again, and what
    one operator has held must not add to what the next one needs."""
    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            if sys.platform.startswith("linux"):
                ctypes.CDLL(None).malloc_trim(0)

    return wrapped


def slices(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that each holds about BATCH_BYTES of ``text`` at most."""
    for batch in batches:
        at = size = 0
        column = batch.column(text)
        for i in range(batch.num_rows):
            n = column[i].as_buffer().size if column[i].is_valid else 0
            if size and size + n > BATCH_BYTES:
                yield batch.slice(at, i - at)
                at, size = i, 0
            size += n
        if at < batch.num_rows:
            yield batch.slice(at)


def per_text(df: DataFrame, text: str, fn: Callable[[list], list], schema: str, keep_text: bool = False) -> DataFrame:
    """Append columns computed from whole texts in Python.

    ``fn`` takes a list of texts (``bytes`` or None) and returns one list per column of ``schema``;
    all columns of ``df`` are passed through, the text itself only with ``keep_text``.
    """
    keep = [f for f in df.schema.fields if keep_text or f.name != text]
    out = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in keep] + [schema])
    names = [f.name for f in keep]
    spark = df.sparkSession
    target = spark.createDataFrame([], schema).schema
    from pyspark.sql.pandas.types import to_arrow_type
    types = [to_arrow_type(f.dataType) for f in target.fields]
    new = [f.name for f in target.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            values = batch.column(text).cast(pa.binary()).to_pylist()
            columns = fn(values)
            yield pa.RecordBatch.from_arrays(
                [batch.column(n) for n in names] + [pa.array(c, t) for c, t in zip(columns, types)], names=names + new)

    return df.mapInArrow(give_back(run), out)


def words_of(text: Column) -> Column:
    """The words of a text as an array, JVM-side; null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), "")
