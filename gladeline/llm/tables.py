"""Inputs, stored intermediate tables and small Arrow helpers that the operators share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gladeline.session import scratch_folder

#: Text handled at once inside a task; a longer text is a piece of its own.
PIECE_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder, tightly packed, and go on from the files.

    A lost executor then costs its unfinished tasks only, and what follows reads the table as often as it likes.
    """
    path = scratch_folder(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def held_out(key: Column, folds: int, fold: int) -> Column:
    """True where the CRC-32 of the key as text leaves ``fold`` modulo ``folds``; a null key is never held out."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % folds == fold, F.lit(False))


def filtered(docs: DataFrame, keep) -> DataFrame:
    """The rows that ``keep``, a generator over Arrow batches, lets through; it may use the column ``text``.

    All other columns get plain names on the way, as names with dots do not pass.
    """
    plain = docs.toDF(*[c if c == "text" else f"c{i}" for i, c in enumerate(docs.columns)])
    return plain.mapInArrow(keep, plain.schema).toDF(*docs.columns)


def arrow_texts(column: pa.Array) -> pa.Array:
    """Texts as one string array without nulls; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.cast(pa.string()).fill_null("")


def raw_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts and the border of each text, from 0."""
    _, offsets, data = texts.buffers()
    if len(texts) == 0 or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    at = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def mapped(texts: pa.Array, table_of_bytes: np.ndarray) -> pa.Array:
    """Texts with every byte replaced by ``table_of_bytes``; it must take ASCII to ASCII and leave the rest."""
    raw, at = raw_bytes(texts)
    data = pa.py_buffer(np.ascontiguousarray(table_of_bytes[raw]))
    return pa.StringArray.from_buffers(len(texts), pa.py_buffer(at.astype(np.int32)), data)


def byte_table(keep) -> np.ndarray:
    """A byte table that lower-cases A-Z and turns the bytes that ``keep`` refuses into spaces."""
    out = np.arange(256, dtype=np.uint8)
    out[65:91] += 32
    for b in range(256):
        if not keep(b):
            out[b] = 32
    return out


def pieces(batch: pa.RecordBatch, name: str, most: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``most`` bytes of text each, one row at least."""
    _, at = raw_bytes(arrow_texts(batch.column(name)))
    start = 0
    while start < batch.num_rows:
        stop = max(start + 1, int(np.searchsorted(at, at[start] + most, side="right")) - 1)
        yield batch.slice(start, stop - start)
        start = stop


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions ``starts[i] .. starts[i] + lengths[i] - 1`` of all i in turn."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words between ASCII white space, and the border of each text among them."""
    lists = pc.ascii_split_whitespace(texts)
    at, flat = np.asarray(lists.offsets, dtype=np.int64), lists.flatten()
    at = at - at[0]
    # Arrow gives an empty word where a text is empty or begins or ends with white space
    some = np.asarray(pc.binary_length(flat)) > 0
    if some.all():
        return flat, at
    return flat.filter(pa.array(some)), np.concatenate([[0], np.cumsum(some)])[at]
