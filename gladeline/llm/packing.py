"""Concatenate and cut: documents as one stream of token ids, cut into windows of fixed width.

Two passes. The first encodes every text where it lies and notes how many ids stand before it in its partition;
the second adds the total of the partitions before and cuts at the window borders. Only one number per partition
is gathered, no document is moved, and every window but the last is full.

Defined cases: a null text is empty and still has its end id; an empty table gives no pieces; rows with a null or
repeated ``doc_id`` are packed like any other; further columns are left out, whatever their names; a text longer
than a window is cut, and its pieces keep their order.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gladeline.llm.tables import pieces, stored
from gladeline.llm.tokens import END_ID, default_path, document_ids

WIDTH = 4096
_ID_BYTES = 4


def encode_documents(docs: DataFrame, tokenizer: str | None = None, end_id: int | None = END_ID) -> DataFrame:
    """First pass: ``doc_id, part, before, n_tokens, ids``.

    ``ids`` are little-endian 32-bit numbers, ``before`` counts the ids of the rows before in the same ``part``.
    Stored at once, so that ``part`` and ``before`` of a row always come from the same attempt of a task.
    """
    path = tokenizer or default_path()

    def encode(batches):
        part, before = TaskContext.get().partitionId(), 0
        for batch in batches:
            for piece in pieces(batch, "text"):
                ids, at = document_ids(path, piece.column("text"), end_id)
                ids = ids.astype("<u4")
                n = np.diff(at)
                yield pa.RecordBatch.from_arrays(
                    [
                        piece.column("doc_id"),
                        pa.array(np.full(len(n), part, np.int32)),
                        pa.array(before + at[:-1]),
                        pa.array(n),
                        pa.array([ids[a:b].tobytes() for a, b in zip(at[:-1], at[1:])], pa.binary()),
                    ],
                    names=["doc_id", "part", "before", "n_tokens", "ids"],
                )
                before += int(at[-1])

    columns = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return stored(columns.mapInArrow(encode, "doc_id long, part int, before long, n_tokens long, ids binary"))


def global_starts(encoded: DataFrame) -> DataFrame:
    """``part, offset``: ids in all parts before. One row per partition of the input, so one task may sum them."""
    totals = encoded.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("offset"))


def cut(encoded: DataFrame, width: int = WIDTH) -> DataFrame:
    """Second pass: a row per piece, ``doc_id, start, length, ids, doc_tokens, sequence_id, offset``.

    A document that crosses a window border gets a piece on either side of it.
    """
    # one row per partition of the first pass: 16 bytes for each input split
    placed = encoded.join(F.broadcast(global_starts(encoded)), "part").withColumn("at", F.col("before") + F.col("offset"))
    first = F.floor(F.col("at") / width)
    last = F.floor((F.col("at") + F.col("n_tokens") - 1) / width)

    def piece(window):
        begin = F.greatest(window * width, F.col("at"))
        end = F.least((window + 1) * width, F.col("at") + F.col("n_tokens"))
        skipped = (begin - F.col("at")).cast("int")
        ids = F.substring(F.col("ids"), skipped * _ID_BYTES + 1, ((end - begin) * _ID_BYTES).cast("int"))
        return F.struct(
            (begin - F.col("at")).alias("start"), (end - begin).alias("length"), ids.alias("ids"),
            window.alias("sequence_id"), (begin - window * width).alias("offset"),
        )

    return (
        placed.filter(F.col("n_tokens") > 0)
        .select("doc_id", F.col("n_tokens").alias("doc_tokens"), F.explode(F.transform(F.sequence(first, last), piece)).alias("p"))
        .select("doc_id", "p.start", "p.length", "p.ids", "doc_tokens", "p.sequence_id", "p.offset")
    )


def pack(docs: DataFrame, tokenizer: str | None = None, width: int = WIDTH, end_id: int | None = END_ID) -> DataFrame:
    """Pieces of all documents, see :func:`cut`."""
    return cut(encode_documents(docs, tokenizer, end_id), width)


def piece_digest(packed: DataFrame) -> DataFrame:
    """Pieces with the CRC-32 of their ids in place of the ids."""
    return packed.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )
