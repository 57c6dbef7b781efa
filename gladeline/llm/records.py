"""Length-delimited binary records of token ids, with an offset index beside them for shuffled reads.

A shard ``*.rec`` is a run of frames. A frame is the payload's length (8 bytes), the masked checksum of those 8
bytes (4), the payload, and the masked checksum of the payload (4), all little-endian. A payload is the document's
id (8), a flag whether it has one (1), the width of a token id in bytes (1), and the ids. The shard's ``*.idx``
holds the byte offset of each frame (8 each), so any record can be read alone. The mask rotates a CRC-32 right by
15 bits and adds a constant, so that a checksum over data that holds checksums stays useful.

Documents are range-partitioned by ``doc_id`` and written where they land; a shard is closed at a byte bound. Shard
names carry the task attempt, and only shards of committed attempts are in the manifest, so a task that is run
again does no harm.

Defined cases: a null text is an empty one, a null ``doc_id`` comes first, equal ids are ordered by a hash of the
text and share the range if that is equal too; an empty table gives no shard and no rows; further columns are left out.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gladeline.llm.tables import pieces, stored
from gladeline.llm.tokens import END_ID, default_path, document_ids
from gladeline.session import scratch_folder

SHARD_BYTES = 64 << 20
_MASK = 0xA282EAD8
_HEAD = struct.Struct("<qBB")
_MANIFEST = "part int, nth int, shard string, n_records long, n_tokens long"
_RECORD = "doc_id long, start long, n_tokens long, ids binary"


class DamagedRecord(ValueError):
    """A frame whose length or payload does not match its checksum."""


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + _MASK) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    length = struct.pack("<Q", len(payload))
    return b"".join((length, struct.pack("<I", masked(length)), payload, struct.pack("<I", masked(payload))))


def payload(doc_id: int | None, ids: np.ndarray, width: int) -> bytes:
    return _HEAD.pack(doc_id or 0, doc_id is not None, width) + ids.astype(f"<u{width}").tobytes()


def opened(data: bytes) -> tuple[int | None, np.ndarray]:
    """``payload`` undone: the document's id and its token ids as 32-bit numbers."""
    doc_id, has_id, width = _HEAD.unpack_from(data)
    return doc_id if has_id else None, np.frombuffer(data, f"<u{width}", offset=_HEAD.size).astype("<u4")


def read_frame(stream) -> bytes:
    """The next payload of a stream, checked."""
    head = stream.read(12)
    if len(head) < 12 or masked(head[:8]) != struct.unpack_from("<I", head, 8)[0]:
        raise DamagedRecord("length")
    (size,) = struct.unpack_from("<Q", head)
    body = stream.read(size + 4)
    if len(body) < size + 4 or masked(body[:size]) != struct.unpack_from("<I", body, size)[0]:
        raise DamagedRecord("payload")
    return body[:size]


class _Shard:
    def __init__(self, files, path: str):
        self.files, self.path, self.at, self.n_tokens, self.index = files, path, 0, 0, []
        self.stream = files.open_output_stream(f"{path}.rec")

    def add(self, data: bytes, n_tokens: int) -> None:
        self.index.append(self.at)
        self.stream.write(data)
        self.at += len(data)
        self.n_tokens += n_tokens

    def close(self) -> None:
        self.stream.close()
        with self.files.open_output_stream(f"{self.path}.idx") as out:
            out.write(np.asarray(self.index, "<u8").tobytes())


def write_records(
    docs: DataFrame, folder: str, tokenizer: str | None = None, end_id: int | None = END_ID, shard_bytes: int = SHARD_BYTES
) -> DataFrame:
    """Write all documents in ascending ``doc_id`` order below ``folder``, which all executors share.

    Returns the manifest, a row per shard: ``part, nth, shard, n_records, n_tokens``; ``(part, nth)`` is the order.
    """
    path = tokenizer or default_path()

    def write(batches):
        files, root = pafs.FileSystem.from_uri(folder)
        files.create_dir(root, recursive=True)
        task = TaskContext.get()
        part, attempt, width, done, shard = task.partitionId(), task.taskAttemptId(), 0, [], None
        for batch in batches:
            for piece in pieces(batch, "text"):
                ids, at = document_ids(path, piece.column("text"), end_id)
                width = width or (2 if _vocabulary(path) <= 1 << 16 else 4)
                for doc_id, a, b in zip(piece.column("doc_id").to_pylist(), at[:-1], at[1:]):
                    if shard is None:
                        shard = _Shard(files, f"{root}/part-{part:06d}-{attempt}-{len(done):05d}")
                    shard.add(frame(payload(doc_id, ids[a:b], width)), int(b - a))
                    if shard.at >= shard_bytes:
                        shard.close()
                        done.append(shard)
                        shard = None
        if shard is not None:
            shard.close()
            done.append(shard)
        for nth, s in enumerate(done):
            name = s.path.rsplit("/", 1)[1]
            row = {"part": part, "nth": nth, "shard": name, "n_records": len(s.index), "n_tokens": s.n_tokens}
            yield pa.RecordBatch.from_pylist([row], _manifest_schema())

    keyed = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.xxhash64("text").alias("__mix"))
    ordered = keyed.repartitionByRange("doc_id", "__mix").sortWithinPartitions("doc_id", "__mix").drop("__mix")
    return stored(ordered.mapInArrow(write, _MANIFEST))


def _manifest_schema() -> pa.Schema:
    return pa.schema([("part", pa.int32()), ("nth", pa.int32()), ("shard", pa.string()), ("n_records", pa.int64()), ("n_tokens", pa.int64())])


def _vocabulary(path: str) -> int:
    from gladeline.llm.tokens import encoder

    return encoder(path).tokenizer.get_vocab_size(with_added_tokens=True)


def read_records(manifest: DataFrame, folder: str) -> DataFrame:
    """All records of the shards in a manifest: ``doc_id, start, n_tokens, ids``, every checksum tested.

    ``start`` counts the token ids before the document in the order of the shards. The offsets come from the
    manifest, one row per shard, so a task can begin with any shard.
    """
    order = Window.orderBy("part", "nth").rowsBetween(Window.unboundedPreceding, -1)
    placed = manifest.select("shard", F.coalesce(F.sum("n_tokens").over(order), F.lit(0)).alias("start"))
    # a task per shard or so; a manifest row is a few bytes and stands for a whole shard
    dealt = placed.repartition(max(1, manifest.count()), "shard")

    def read(batches):
        files, root = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for row in batch.to_pylist():
                yield from _read_shard(files, f"{root}/{row['shard']}", row["start"])

    return dealt.mapInArrow(read, _RECORD)


def _read_shard(files, path: str, start: int, rows: int = 512):
    with files.open_input_stream(f"{path}.idx") as index:
        n = len(index.read()) // 8
    with files.open_input_stream(f"{path}.rec", buffer_size=1 << 20) as stream:
        out = []
        for left in range(n, 0, -1):
            doc_id, ids = opened(read_frame(stream))
            out.append((doc_id, start, len(ids), ids.tobytes()))
            start += len(ids)
            if len(out) == rows or left == 1:
                arrays = [pa.array(x, t) for x, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.binary()))]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "start", "n_tokens", "ids"])
                out = []


def read_record(folder: str, shard: str, nth: int) -> tuple[int | None, np.ndarray]:
    """One record by its place, through the offset index: the random access of a shuffled reader."""
    files, root = pafs.FileSystem.from_uri(folder)
    with files.open_input_file(f"{root}/{shard}.idx") as index:
        (offset,) = struct.unpack("<Q", index.read_at(8, 8 * nth))
    with files.open_input_file(f"{root}/{shard}.rec") as stream:
        stream.seek(offset)
        return opened(read_frame(stream))


def round_trip(docs: DataFrame, tokenizer: str | None = None, end_id: int | None = END_ID) -> DataFrame:
    """Write all documents and read them back, see :func:`read_records`."""
    folder = scratch_folder(docs.sparkSession)
    return read_records(write_records(docs, folder, tokenizer, end_id), folder)
