"""Alignment of two tokenizers: which tokens of one cover the bytes of which tokens of the other.

A is a byte-level BPE over space and text, B a piece model that puts the space there itself. Inside a task all
work is columns of Arrow: token lists are flattened with the numbers of their documents, byte lengths are summed up
within each document, and an outer hash join on (document, end) brings the ends of both sides together. Where both
end, a group closes; where one alone ends, the token of the other side is the next one to end, so that filling up
from behind gives every overlapping pair once. ``Table.group_by`` counts the documents of each id pair in a chunk.

Spark adds the counts of all chunks, finds the best count of each A id (a row per id of A's vocabulary at most, which
is what is broadcast) and takes the counts back to the chunks that hold the pair. Documents are never taken apart:
they come with the different pairs of each, by number in their chunk, packed in a few bytes.

Defined cases: a null or empty text, and one that either tokenizer does not give back byte for byte, has no tokens,
zeros and an empty digest; every row is a document of its own, whatever its ``doc_id`` (null and repeated ones
included); an empty table gives no rows; further columns are left out. A chunk holds ``CHUNK_BYTES`` of text or one
document, so a very long text takes memory in proportion to its own length.
"""

from __future__ import annotations

import hashlib
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gladeline.llm.tables import arrow_texts, pieces, raw_bytes, spread, stored
from gladeline.llm.tokens import WordEncoder

#: Text per chunk; the pairs of a chunk are counted together.
CHUNK_BYTES = 4 << 20

_SEEN = (
    "chunk long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, groups_sha256 string, "
    "held binary, pair_a array<int>, pair_b array<int>, pair_docs array<long>"
)
_OUT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def default_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def byte_level_alphabet() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable bytes stand for themselves."""
    own = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def fragments(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """A space and each text, cut before single spaces that a printable ASCII sign follows; the border of each text.

    No token of either kind reaches across such a cut: white space only ever begins a token.
    """
    raw, at = raw_bytes(pc.binary_join_element_wise(pa.scalar(""), texts, " "))
    cut = np.zeros(len(raw) + 1, bool)
    blank = (raw == 32) | ((raw >= 9) & (raw <= 13))
    cut[1 : len(raw) - 1] = (raw[1:-1] == 32) & ~blank[:-2] & (raw[2:] > 32) & (raw[2:] < 127)
    cut[at] = True
    where = np.flatnonzero(cut)
    cuts = pa.StringArray.from_buffers(len(where) - 1, pa.py_buffer(where.astype(np.int32)), pa.py_buffer(raw))
    return cuts, np.searchsorted(where, at)


class Side(WordEncoder):
    """One tokenizer: ids of many texts, each different fragment encoded once, and the bytes of every id."""

    def __init__(self, encode, spelled: list[bytes]):
        self._encoded = encode
        self.words, self.pool = pa.array([], pa.string()), np.zeros(0, np.uint32)
        self.lengths, self.needed, self.calls = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
        self.spelled = pa.array(spelled, pa.binary())
        self.widths = pc.binary_length(self.spelled).cast(pa.int64())

    def __call__(self, parts: pa.DictionaryArray, at: np.ndarray) -> pa.ListArray:
        """Token ids of texts that begin at ``at`` among the fragments."""
        part = self._places(parts.dictionary)[np.asarray(parts.indices)]
        lengths = self.lengths[part]
        ids = self.pool[spread((np.cumsum(self.lengths) - self.lengths)[part], lengths)]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        return pa.ListArray.from_arrays(pa.array(ends[at].astype(np.int32)), pa.array(ids.astype(np.int32)))


_ONE_WORD = re.compile(" [A-Za-z]+").fullmatch


def byte_side(path: str) -> Side:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    tokenizer, alphabet = Tokenizer.from_file(path), byte_level_alphabet()
    tokenizer.encode_special_tokens = True
    spelled = [b""] * tokenizer.get_vocab_size()
    for token, i in tokenizer.get_vocab().items():
        spelled[i] = bytes(alphabet[c] for c in token) if all(c in alphabet for c in token) else token.encode()
    one, letter = tokenizer.model.tokenize, {b: c for c, b in alphabet.items()}

    def encode(parts):
        # a space and letters are one word to the pre-tokenizer, which only spells its bytes
        out = [[t.id for t in one(p.translate(letter))] if _ONE_WORD(p) else None for p in parts]
        rest = [i for i, got in enumerate(out) if got is None]
        for i, got in zip(rest, tokenizer.encode_batch_fast([parts[i] for i in rest], add_special_tokens=False)):
            out[i] = got.ids
        return out

    return Side(encode, spelled)


def piece_side(path: str) -> Side:
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)

    def spell(i):
        piece = model.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if model.is_byte(i) else piece.replace("▁", " ").encode()

    # every fragment begins with a space, which the model puts there itself
    encode = lambda parts: model.encode([p[1:] for p in parts], num_threads=1)
    return Side(encode, [spell(i) for i in range(model.get_piece_size())])


_sides: dict[tuple[str, str], tuple[Side, Side]] = {}


def sides(paths: tuple[str, str]) -> tuple[Side, Side]:
    """Both tokenizers of this worker process, loaded once."""
    if paths not in _sides:
        _sides[paths] = byte_side(paths[0]), piece_side(paths[1])
    return _sides[paths]


def _same_bytes(side: Side, tokens: pa.ListArray, texts: list[str]) -> list[bool]:
    """Whether the tokens of each text spell a space and the text."""
    raw, token_at = raw_bytes(side.spelled.take(tokens.flatten()))
    data = memoryview(raw)
    at = token_at[np.asarray(tokens.offsets)]
    return [data[a:b] == b" " + t.encode() for t, a, b in zip(texts, at[:-1].tolist(), at[1:].tolist())]


def _ends(side: Side, tokens: pa.ListArray, ids: str) -> pa.Table:
    """``doc, end`` and the id of every token; ``end`` counts the bytes from the start of the document."""
    flat, doc = pc.list_flatten(tokens), pc.list_parent_indices(tokens)
    ends = pc.cumulative_sum(side.widths.take(flat))
    total = np.concatenate([[0], np.asarray(ends)])
    before = pa.array(total[np.asarray(tokens.offsets)[:-1]])
    return pa.table({"doc": doc, "end": pc.subtract(ends, before.take(doc)), ids: flat})


def _joined(ids: pa.Array, group: np.ndarray, n_groups: int) -> pa.Array:
    """The ids of each group in decimal, joined by commas."""
    at = np.concatenate([[0], np.cumsum(np.bincount(group, minlength=n_groups))]).astype(np.int32)
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(at), ids.cast(pa.string())), ",")


class Aligned:
    """Groups and links of the texts of a chunk; every text must be spelled alike by both sides."""

    def __init__(self, a: Side, b: Side, of_a: pa.ListArray, of_b: pa.ListArray):
        n = len(of_a)
        both = _ends(a, of_a, "a").join(_ends(b, of_b, "b"), ["doc", "end"], join_type="full outer", use_threads=False)
        both = both.sort_by([("doc", "ascending"), ("end", "ascending")]).combine_chunks()
        doc = np.asarray(both["doc"])
        ends_a, ends_b = (np.asarray(pc.is_valid(both[c])) for c in "ab")
        closes = ends_a & ends_b
        group = np.cumsum(closes) - closes
        self.n_groups = np.bincount(doc[closes], minlength=n)
        self.n_links = np.bincount(doc, minlength=n)
        parts = [_joined(pc.drop_null(both[c]).combine_chunks(), group[e], int(closes.sum())) for c, e in (("a", ends_a), ("b", ends_b))]
        at = np.concatenate([[0], np.cumsum(self.n_groups)]).astype(np.int32)
        grouped = pc.binary_join_element_wise(*parts, "|")
        self.groups = pc.binary_join(pa.ListArray.from_arrays(pa.array(at), grouped), ";")

        links = pa.table({"doc": both["doc"], "a": pc.fill_null_backward(both["a"]), "b": pc.fill_null_backward(both["b"])})
        held = links.group_by(["doc", "a", "b"], use_threads=False).aggregate([([], "count_all")])
        pairs = held.group_by(["a", "b"], use_threads=False).aggregate([([], "count_all")])
        pairs = pairs.append_column("pair", pa.array(np.arange(pairs.num_rows, dtype=np.int32)))
        self.pairs = pairs
        held = held.join(pairs.select(["a", "b", "pair"]), ["a", "b"], use_threads=False)
        held = held.sort_by([("doc", "ascending"), ("pair", "ascending")])
        cut = np.searchsorted(np.asarray(held["doc"]), np.arange(n + 1))
        pair, times = np.asarray(held["pair"]), np.asarray(held["count_all"])
        self.held = [packed(pair[x:y], times[x:y]) for x, y in zip(cut[:-1], cut[1:])]


def packed(pairs: np.ndarray, times: np.ndarray) -> bytes:
    """Ascending numbers and how often each occurs: steps and repeats, like bytes side by side, compressed."""
    steps = np.diff(pairs, prepend=0).astype("<u4")
    split = np.concatenate([steps, (times - 1).astype("<u4")]).view(np.uint8).reshape(-1, 4).T
    return len(pairs).to_bytes(4, "little") + pa.compress(split.tobytes(), "zstd", asbytes=True)


def unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int.from_bytes(data[:4], "little")
    raw = pa.decompress(data[4:], 8 * n, "zstd", asbytes=True)
    both = np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)
    return np.cumsum(both[:n]), both[n:] + 1


def _chunk_rows(chunk: int, rows: pa.RecordBatch, a: Side, b: Side, whole: bool) -> pa.RecordBatch:
    """A row per document, and last a row with the pairs of the chunk."""
    n = rows.num_rows
    texts = arrow_texts(rows.column("text")).to_pylist()
    some = [i for i, t in enumerate(texts) if t]
    spelled = [texts[i] for i in some]
    parts, borders = fragments(pa.array(spelled, pa.string()))
    parts = parts.dictionary_encode()
    of_a, of_b = a(parts, borders), b(parts, borders)
    same = np.array(_same_bytes(a, of_a, spelled), bool) & np.array(_same_bytes(b, of_b, spelled), bool)
    at = np.array(some, np.int64)[same]
    of_a, of_b = of_a.filter(pa.array(same)), of_b.filter(pa.array(same))
    got = Aligned(a, b, of_a, of_b)

    counts = {}
    for name, x in (("n_a", pc.list_value_length(of_a)), ("n_b", pc.list_value_length(of_b)), ("n_groups", got.n_groups), ("n_links", got.n_links)):
        counts[name] = np.zeros(n, np.int64)
        counts[name][at] = np.asarray(x)
    digests, groups, held = [""] * n, [""] * n, [packed(np.zeros(0, np.int64), np.zeros(0, np.int64))] * n
    for i, text, mine in zip(at.tolist(), got.groups.to_pylist(), got.held):
        digests[i], held[i] = hashlib.sha256(text.encode()).hexdigest(), mine
        if whole:
            groups[i] = text
    last = [None]
    lists = [[None] * n + [got.pairs[c].to_pylist()] for c in ("a", "b", "count_all")]
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.full(n + 1, chunk, np.int64)),
            pa.array(rows.column("doc_id").to_pylist() + last, pa.int64()),
            *[pa.array(x.tolist() + last, pa.int64()) for x in counts.values()],
            pa.array(groups + last, pa.string()), pa.array(digests + last, pa.string()), pa.array(held + last, pa.binary()),
            *[pa.array(x, pa.list_(kind)) for x, kind in zip(lists, (pa.int32(), pa.int32(), pa.int64()))],
        ],
        names=[c.split()[0] for c in _SEEN.split(", ")],
    )


def align_chunks(docs: DataFrame, paths: tuple[str, str] | None = None, whole: bool = True, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Rows of documents (``held`` is not null) and of chunks (``pair_a`` is not null), stored.

    ``whole`` keeps the text of the groups beside its digest.
    """
    files = paths or default_paths()

    def work(batches):
        pa.set_cpu_count(1)
        (a, b), chunk = sides(files), TaskContext.get().partitionId() << 32
        for batch in batches:
            for piece in pieces(batch, "text", chunk_bytes):
                yield _chunk_rows(chunk, piece, a, b, whole)
                chunk += 1

    columns = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return stored(columns.mapInArrow(work, _SEEN))


def chunk_pairs(aligned: DataFrame) -> DataFrame:
    """``chunk, pair, a, b, docs``: the id pairs linked in a chunk and in how many of its documents."""
    rows = aligned.filter(F.col("pair_a").isNotNull())
    lists = F.arrays_zip(F.col("pair_a").alias("a"), F.col("pair_b").alias("b"), F.col("pair_docs").alias("docs"))
    return rows.select("chunk", F.posexplode(lists).alias("pair", "p")).select("chunk", "pair", "p.a", "p.b", "p.docs")


def pair_counts(pairs: DataFrame) -> DataFrame:
    """``a, b, docs, best``: documents with the pair linked, corpus-wide; ``best`` where no pair of the same A has more."""
    counts = stored(pairs.groupBy("a", "b").agg(F.sum("docs").alias("docs")))
    # one row per id of A's vocabulary at most
    top = F.broadcast(counts.groupBy("a").agg(F.max("docs").alias("top")))
    return counts.join(top, "a").select("a", "b", "docs", (F.col("docs") == F.col("top")).alias("best"))


def _rate(documents: pa.Table, pairs: pa.Table) -> pa.Table:
    """Adds up, for the documents of a chunk, the counts of their links."""
    place = np.asarray(pairs["pair"])
    docs, best = np.zeros(len(place), np.int64), np.zeros(len(place), bool)
    docs[place], best[place] = np.asarray(pairs["docs"]), np.asarray(pairs["best"])
    sums, bests = [], []
    for data in documents["held"].to_pylist():
        pair, times = unpacked(data)
        sums.append(int(docs[pair] @ times))
        bests.append(int(best[pair] @ times))
    out = {c.split()[0]: c for c in _OUT.split(", ")}
    own = {"n_best": pa.array(bests, pa.int64()), "count_sum": pa.array(sums, pa.int64())}
    return pa.table({c: own[c] if c in own else documents[c] for c in out})


def alignment(docs: DataFrame, paths: tuple[str, str] | None = None, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Per document ``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``."""
    aligned = align_chunks(docs, paths, whole=False, chunk_bytes=chunk_bytes)
    documents = aligned.filter(F.col("held").isNotNull()).drop("groups", "pair_a", "pair_b", "pair_docs")
    pairs = chunk_pairs(aligned)
    # a pair comes once per chunk, so even the most frequent one has few rows; exploded rows look smaller than they are
    rated = pairs.hint("merge").join(pair_counts(pairs).withColumnRenamed("docs", "all_docs"), ["a", "b"])
    rated = rated.select(F.col("chunk").alias("home"), "pair", F.col("all_docs").alias("docs"), "best")
    return documents.groupBy("chunk").cogroup(rated.groupBy("home")).applyInArrow(_rate, _OUT)


def token_links(docs: DataFrame, paths: tuple[str, str] | None = None) -> DataFrame:
    """``a, b, docs, best``: the translation table between the two vocabularies that the corpus gives."""
    return pair_counts(chunk_pairs(align_chunks(docs, paths, whole=False)))
