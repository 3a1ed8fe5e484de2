"""What the operators share: reading tables, adding columns by Arrow batches, words as bytes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

# A word is a run of what is left after the ASCII signs, once A-Z is lower-cased. In UTF-8
# these are 0-9, a-z and all bytes from 0x80, so bytes can be translated and split.
WORD_PATTERN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD_TABLE = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32
    for b in range(256)
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def byte_words(text: bytes) -> list[bytes]:
    """Lower-cased words of a UTF-8 text."""
    return text.translate(WORD_TABLE).split()


def text_bytes(batch: pa.RecordBatch, column: str) -> list[bytes]:
    """A text column as bytes; null is empty."""
    return [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]


def text_strings(batch: pa.RecordBatch, column: str) -> list[str]:
    """A text column as strings; null is empty."""
    return [x or "" for x in batch.column(column).to_pylist()]


def byte_groups(texts: pa.Array, most: int) -> Iterator[pa.Array]:
    """Texts without null in order, some `most` bytes or one text at a time."""
    size = np.cumsum(pc.binary_length(texts).to_numpy())
    start = 0
    while start < len(texts):
        before = size[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(size, before + most, "right")))
        yield texts.slice(start, end - start)
        start = end


def chosen_lists(flat: np.ndarray, sizes: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """The chosen of lists that stand one after the other in `flat`, one after the other."""
    starts, lengths = np.cumsum(sizes) - sizes, sizes[chosen]
    place = np.repeat(starts[chosen] - np.cumsum(lengths) + lengths, lengths)
    place += np.arange(len(place))
    return flat[place]


def add_columns(
    df: DataFrame,
    columns: str,
    fn: Callable[[pa.RecordBatch], list[pa.Array]],
    drop: tuple[str, ...] = (),
) -> DataFrame:
    """df with new columns, computed from Arrow batches without a shuffle.

    `columns` is their DDL; fn returns their arrays in that order. A column of the
    same name is replaced, those in `drop` stay behind.
    """
    new = _parse_datatype_string(columns)
    gone = {f.name for f in new} | set(drop)
    kept = [f for f in df.schema if f.name not in gone]
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                arrays = [batch.column(c) for c in names] + fn(batch)
                yield pa.RecordBatch.from_arrays(arrays, names + new.names)

    return df.mapInArrow(run, StructType([StructField(f.name, f.dataType, True) for f in kept] + new.fields))


def text_key(text: str = "text") -> Column:
    """Two independent 64-bit hashes of a text, null as empty."""
    value = F.coalesce(F.col(text), F.lit(""))
    return F.struct(F.xxhash64(value).alias("a"), F.xxhash64(F.lit(7), value).alias("b"))
