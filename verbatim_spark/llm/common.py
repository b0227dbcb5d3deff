"""Shared pieces of the training-data operators: words, texts in batches, tables
kept between jobs."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.kept import drop, keep, shared_folder
from ..functions.shipping import ship

__all__ = ["WORD", "drop", "keep", "lower_ascii", "shared_folder", "shipped", "slices", "table", "text_bytes", "words"]

#: Words of most contracts: runs of ASCII letters, digits and non-ASCII characters.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Lower-cases A-Z and turns every byte outside WORD into a space. Every byte of
#: a non-ASCII character in UTF-8 is 0x80 or more, so bytes and characters agree.
_TO_WORDS = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32
    for b in range(256)
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shipped(f: Callable) -> Callable:
    """An operator on a DataFrame that first sends the library to the executors,
    so that it works on any session's tables."""

    @functools.wraps(f)
    def run(df: DataFrame, *args, **kwargs):
        ship(df.sparkSession)
        return f(df, *args, **kwargs)

    return run


def words(text: bytes) -> list[bytes]:
    """The words of a UTF-8 text, with A-Z lower-cased first."""
    return text.translate(_TO_WORDS).split()


def lower_ascii(col: Column) -> Column:
    """Lower-cases A-Z only; ``lower`` would also change other letters."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(col, upper, upper.lower())


def text_bytes(column: pa.Array) -> list[bytes | None]:
    """A string column as UTF-8 bytes, without decoding them."""
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    return column.cast(pa.large_binary() if large else pa.binary()).to_pylist()


def slices(batches: Iterator[pa.RecordBatch], column: int = 1, most: int = 32 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that each holds at most about ``most`` bytes of a text
    column, or one row: memory then doesn't depend on how long texts are."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        size = max(batch.column(column).nbytes // batch.num_rows, 1)
        step = max(1, most // size)
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)
