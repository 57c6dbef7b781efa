"""SimHash near-duplicates by pigeonhole blocks.

A text's words are the stretches without ASCII white space, A-Z lower-cased; its shingles are three words in a row,
repeats included (fewer words: the whole sequence). A bit of the fingerprint is 1 if more than half of the
shingles' XXH64 hashes (seed 42) have it; a text without words has fingerprint zero. Fingerprints that differ in
at most three bits are linked, and linked ones form a component.

Two fingerprints within three bits agree on at least one of four blocks. They are therefore joined on blocks and
then verified. A block value that very many share is not compared pair by pair: its fingerprints agree on that
block, so the bits left are cut into four smaller blocks and joined again, until a bucket is small or so few bits
are left that all in it are linked. Nothing is lost at any size, and no bucket's pairs are ever listed: a bucket
gives as many links as keep its linked members together.

Defined cases: null, empty and blank texts have fingerprint zero and link like others; equal texts, and different
texts with the same fingerprint, meet before any comparison; a null ``doc_id`` is a member of its component but
never its name unless nothing else is there (then null); an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gladeline.llm.tables import arrow_texts, pieces, stored
from gladeline.operators.graph import collapse
from gladeline.operators.joins import fresh, join_to_unique

MOST = 3
SHINGLE = 3
SEED = 42
#: Buckets up to this size are compared inside one task; larger ones are cut into finer blocks.
BUCKET = 128
_LANES = np.uint64(0x0101010101010101)
_KEYED = "fp long, free long, key long"


def shingle_hashes(text: str, words: int = SHINGLE, seed: int = SEED) -> list[int]:
    # bytes.lower and bytes.split know ASCII letters and ASCII white space only, as the definition asks
    found = text.encode().lower().split()
    joined = b" ".join(found)
    if len(found) <= words:
        return [xxhash.xxh64_intdigest(joined, seed)] if found else []
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1)
    starts = np.concatenate([[0], ends[:-words]]).tolist()
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a:b], seed) for a, b in zip(starts, (ends[words - 1 :] - 1).tolist())]


def majority(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Fingerprints of consecutive groups of hashes; ``counts`` holds the size of each group."""
    out = np.zeros(len(counts), np.uint64)
    some = np.flatnonzero(counts)
    if not len(some):
        return out
    n = counts[some]
    # count bits in byte lanes over runs of at most 255 hashes, then add the runs of a group
    runs = -(-n // 255)
    first_run = np.cumsum(runs) - runs
    nth = np.arange(int(runs.sum())) - np.repeat(first_run, runs)
    run_start = np.repeat(np.cumsum(n) - n, runs) + 255 * nth
    ones = np.empty((len(some), 8, 8), np.int64)
    for j in range(8):
        lanes = np.add.reduceat((hashes >> np.uint64(j)) & _LANES, run_start).view(np.uint8).reshape(-1, 8)
        ones[:, :, j] = np.add.reduceat(lanes.astype(np.int64), first_run, axis=0)
    bits = 2 * ones > n[:, None, None]
    out[some] = np.packbits(bits, axis=2, bitorder="little").reshape(-1, 8).copy().view("<u8").ravel()
    return out


def fingerprints(docs: DataFrame, words: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """``doc_id, text_hash, fp`` per document; ``fp`` holds the 64 bits as a signed number."""

    def fingerprint(batches):
        for batch in batches:
            for piece in pieces(batch, "text"):
                hashes, counts = [], []
                for text in arrow_texts(piece.column("text")).to_pylist():
                    got = shingle_hashes(text, words, seed)
                    counts.append(len(got))
                    hashes.append(np.array(got, np.uint64))
                fp = majority(np.concatenate(hashes), np.array(counts, np.int64)).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [piece.column("doc_id"), piece.column("text_hash"), pa.array(fp)], names=["doc_id", "text_hash", "fp"]
                )

    columns = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), F.col("text").cast("string"))
    return columns.mapInArrow(fingerprint, "doc_id long, text_hash long, fp long")


def _blocks(free: int, n: int) -> list[int]:
    """The bits of ``free`` in ``n`` nearly equal blocks, as masks."""
    bits = [1 << b for b in range(64) if free >> b & 1]
    cuts = [len(bits) * i // n for i in range(n + 1)]
    return [sum(bits[a:b]) for a, b in zip(cuts, cuts[1:])]


def _finer(rows: DataFrame, most: int) -> DataFrame:
    """``fp, free`` to ``fp, free, key``: one row per block of the free bits, with that block fixed as well."""

    def cut(batches):
        for batch in batches:
            fp = np.asarray(batch.column("fp")).view(np.uint64)
            free = np.asarray(batch.column("free")).view(np.uint64)
            for mask in np.unique(free):
                own = fp[free == mask]
                for block in _blocks(int(mask), most + 1):
                    left = np.uint64(int(mask) & ~block)
                    key = own & ~left
                    columns = (own, np.full(len(own), left), key)
                    yield pa.RecordBatch.from_arrays([pa.array(c.view(np.int64)) for c in columns], names=["fp", "free", "key"])

    return rows.select("fp", "free").mapInArrow(cut, _KEYED)


def _compared(buckets: DataFrame, most: int) -> DataFrame:
    """Links inside small buckets: ``a, b`` with ``a > b``, a spanning set of each bucket's linked members."""

    def compare(batches):
        rest = None
        for batch in batches:
            rows = np.stack([np.asarray(batch.column(c)) for c in ("free", "key", "fp")])
            if rest is not None:
                rows = np.concatenate([rest, rows], axis=1)
            if rows.shape[1] == 0:
                continue
            new = np.any(rows[:2, 1:] != rows[:2, :-1], axis=0)
            last = int(np.flatnonzero(new)[-1]) + 1 if new.any() else 0
            rest = rows[:, last:]  # its bucket may go on in the next batch
            yield _spanning(rows[:, :last], most)
        if rest is not None:
            yield _spanning(rest, most)

    placed = buckets.repartition("free", "key").sortWithinPartitions("free", "key", "fp")
    return placed.select("free", "key", "fp").mapInArrow(compare, "a long, b long")


def _spanning(rows: np.ndarray, most: int) -> pa.RecordBatch:
    free, key, fp = rows
    bits = fp.view(np.uint64) if fp.flags.c_contiguous else np.ascontiguousarray(fp).view(np.uint64)
    parent: dict[int, int] = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    links = []
    apart = 1
    while apart < len(fp):
        same = np.flatnonzero((free[apart:] == free[:-apart]) & (key[apart:] == key[:-apart]))
        if not len(same):
            break
        near = same[np.bitwise_count(bits[same] ^ bits[same + apart]) <= most]
        for i, j in zip(near.tolist(), (near + apart).tolist()):
            a, b = root(i), root(j)
            if a != b:
                parent[max(a, b)] = min(a, b)
                links.append((i, j))
        apart += 1
    pairs = np.array(links, np.int64).reshape(-1, 2)
    a, b = fp[pairs[:, 0]], fp[pairs[:, 1]]
    return pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], names=["a", "b"])


def near_links(different: DataFrame, most: int = MOST, bucket: int = BUCKET) -> DataFrame:
    """Links ``a, b`` that keep together what differs in at most ``most`` bits; ``different`` has one row per ``fp``."""
    links, rows, level = [], different.select("fp", F.lit(-1).cast("long").alias("free")), 0
    few = F.bit_count("free") <= most
    while True:
        keyed = _finer(rows, most)
        # two ways of cutting may fix the same bits
        keyed = stored(keyed.distinct() if level else keyed)
        sizes = keyed.groupBy("free", "key").agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("head"))
        shared = stored(join_to_unique(keyed, sizes.filter(F.col("n") > 1), ["free", "key"]))
        links.append(shared.filter(few & (F.col("fp") != F.col("head"))).select(F.col("fp").alias("a"), F.col("head").alias("b")))
        links.append(_compared(shared.filter(~few & (F.col("n") <= bucket)), most))
        rows = shared.filter(~few & (F.col("n") > bucket))
        if rows.isEmpty():
            break
        level += 1
    out = links[0]
    for more in links[1:]:
        out = out.unionByName(more)
    return out.distinct()


def components(marked: DataFrame, most: int = MOST) -> DataFrame:
    """Add ``component_id``, the smallest ``doc_id`` of the component, to rows ``doc_id, fp``."""
    marked = stored(marked)
    by_fp = stored(marked.groupBy("fp").agg(F.min("doc_id").alias("smallest")))
    home = stored(collapse(near_links(by_fp, most)))
    homed = by_fp.join(home.withColumnRenamed("id", "fp"), "fp", "left").withColumn("home", F.coalesce("home", "fp"))
    names = homed.groupBy("home").agg(F.min("smallest").alias("component_id"))
    named = join_to_unique(homed.select("fp", "home"), names, ["home"]).select("fp", "home", "component_id")
    return join_to_unique(marked, stored(named), ["fp"])


def near_duplicates(docs: DataFrame, most: int = MOST) -> DataFrame:
    """``doc_id, fingerprint, component_id`` per document; the fingerprint as 16 hexadecimal digits."""
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return components(fingerprints(docs), most).select("doc_id", digits.alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, most: int = MOST) -> DataFrame:
    """The documents that stay when one of each component does: the smallest id, then the smallest text hash.

    A document without an id stays only where its whole component has none.
    """
    known = components(fingerprints(docs), most)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_hash")).alias("first")
    kept = known.groupBy("home").agg(first).select("first.doc_id", "first.text_hash")
    keys = fresh(docs.columns, "__id", "__no", "__hash")
    own = [F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), F.col("doc_id").isNull(), F.xxhash64("text")]
    keyed = docs.withColumns(dict(zip(keys, own)))
    chosen = kept.select(*[c.alias(k) for k, c in zip(keys, [F.coalesce("doc_id", F.lit(0)), F.col("doc_id").isNull(), F.col("text_hash")])])
    # copies have ids of their own, so no key is frequent; the join's placing serves the last step as well
    return keyed.join(chosen.distinct(), keys).dropDuplicates(keys).select(*[F.col(f"`{c}`") for c in docs.columns])
