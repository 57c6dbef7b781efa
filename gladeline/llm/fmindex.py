"""Benchmark decontamination with an FM-index per training shard.

Texts are lower-cased over A-Z and read as words of digits, letters and everything beyond ASCII. A test phrase is
any 13 words in a row of a benchmark item, or the whole item if it is shorter. A shard is a bounded run of
documents; its words become numbers over the benchmark's vocabulary, and the stretches that could hold a phrase at
all (words of the vocabulary only, as long as the shortest phrase) are laid end to end and indexed: suffix array,
Burrows-Wheeler transform in a wavelet matrix, and every n-th suffix position kept. All phrases are searched
backward at once, their occurrences located by walking to a kept position, and marked as spans; spans that touch
merge. A shard answers for its documents alone, so nothing is shuffled.

The benchmark is cut into blocks of bounded size: repeated items count once, long ones are cut with an overlap. The
blocks pass through the driver one after the other and are fetched and searched one after the other, so neither the
driver nor a task holds the texts of more than one block (and the cut of an item beyond its bound).

Defined cases: a null or empty text has no words and no hits; an item without words has no phrase; items without an
id mark hits but are not listed, and rows of one id are one item; an empty benchmark or table is no error; further
columns are passed on by :func:`keep_clean` and ignored elsewhere.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gladeline.llm.tables import arrow_texts, byte_table, filtered, mapped, pieces, split_words, spread, stored
from gladeline.operators.ordering import running_sums

WINDOW = 13
#: Text and number of texts after which a shard is closed.
SHARD_BYTES = 16 << 20
SHARD_TEXTS = 20_000
#: Benchmark text per block.
BLOCK_BYTES = 32 << 20
#: Text of an item after which it is cut.
ITEM_BYTES = 1 << 20
#: Every so many suffix positions are kept.
SAMPLE = 16
#: Occurrences located at once.
LOCATED = 1 << 18
_WORD = byte_table(lambda b: 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128)


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts, and the border of each text among them."""
    return split_words(mapped(texts, _WORD))


class WaveletMatrix:
    """Rank and access over a sequence of small numbers, one bit vector per binary digit."""

    def __init__(self, values: np.ndarray, top: int):
        self.n = len(values)
        self.levels = max(1, int(top).bit_length())
        self.bits, self.ones, self.zeros = [], [], []
        for level in reversed(range(self.levels)):
            bit = (values >> level & 1).astype(bool)
            packed = np.zeros((self.n // 64 + 1) * 8, np.uint8)
            raw = np.packbits(bit, bitorder="little")
            packed[: len(raw)] = raw
            words = packed.view("<u8")
            ones = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])
            self.bits.append(words)
            self.ones.append(ones)
            self.zeros.append(self.n - int(ones[-1]))
            values = np.concatenate([values[~bit], values[bit]])

    def _rank(self, k: int, at: np.ndarray) -> np.ndarray:
        word, bit = at >> 6, (at & 63).astype(np.uint64)
        below = self.bits[k][word] & ((np.uint64(1) << bit) - np.uint64(1))
        return self.ones[k][word] + np.bitwise_count(below)

    def rank(self, value: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often ``value`` stands before ``at``, for each pair."""
        start = np.zeros_like(at)
        for k in range(self.levels):
            one = (value >> (self.levels - 1 - k) & 1).astype(bool)
            start, at = (np.where(one, self.zeros[k] + r, x - r) for x, r in ((x, self._rank(k, x)) for x in (start, at)))
        return at - start

    def access(self, at: np.ndarray) -> np.ndarray:
        """The value at each place."""
        value = np.zeros_like(at)
        for k in range(self.levels):
            one = (self.bits[k][at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
            rank = self._rank(k, at)
            value = value << 1 | one
            at = np.where(one, self.zeros[k] + rank, at - rank)
        return value


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Suffixes in order, by prefix doubling; 0 ends a stretch, and every 0 counts as a symbol of its own."""
    n = len(symbols)
    ends = symbols == 0
    first = np.where(ends, np.cumsum(ends) - 1, int(ends.sum()) + symbols.astype(np.int64))
    order = np.argsort(first, kind="stable")
    rank = np.empty(n, np.int64)
    rank[order] = _heads(first[order])
    active, width = _tied(rank), 1
    while len(active):
        # each tied suffix has its successor, for no stretch goes on past its own end
        key = rank[active] * (n + 1) + rank[active + width]
        order = np.argsort(key, kind="stable")
        active, key = active[order], key[order]
        group = key // (n + 1)
        new_group = np.concatenate([[True], group[1:] != group[:-1]])
        inside = np.arange(len(active)) - np.maximum.accumulate(np.where(new_group, np.arange(len(active)), 0))
        new_key = np.concatenate([[True], key[1:] != key[:-1]])
        head = np.maximum.accumulate(np.where(new_key, np.arange(len(active)), 0))
        rank[active] = group + inside[head]
        size = np.diff(np.append(np.flatnonzero(new_key), len(active)))
        active = active[np.repeat(size > 1, size)]
        width *= 2
    out = np.empty(n, np.int64)
    out[rank] = np.arange(n)
    return out


def _heads(ordered: np.ndarray) -> np.ndarray:
    new = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    return np.maximum.accumulate(np.where(new, np.arange(len(ordered)), 0))


def _tied(rank: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.bincount(rank, minlength=len(rank))[rank] > 1)


class FMIndex:
    """Backward search and location over stretches of numbers from 1 to ``top``, each ended by 0."""

    def __init__(self, symbols: np.ndarray, top: int, sample: int = SAMPLE):
        self.n = len(symbols)
        suffixes = suffix_array(symbols)
        before = symbols[suffixes - 1]
        self.matrix = WaveletMatrix(before, top)
        self.smaller = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=top + 1))])
        # the first of a stretch is kept too, so that no walk has to cross a 0
        kept = (suffixes % sample == 0) | (before == 0)
        self.kept = WaveletMatrix(kept.astype(np.int64), 1)
        self.kept_at = suffixes[kept]

    def _back(self, symbol: np.ndarray, row: np.ndarray) -> np.ndarray:
        return self.smaller[symbol] + self.matrix.rank(symbol, row)

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the suffixes that begin with each phrase, as half-open ranges; phrases are padded rows."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        for step in range(phrases.shape[1] if len(phrases) else 0):
            live = np.flatnonzero((lengths > step) & (low < high))
            symbol = phrases[live, lengths[live] - 1 - step]
            low[live], high[live] = self._back(symbol, low[live]), self._back(symbol, high[live])
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions of the suffixes in these rows."""
        out, steps = np.empty(len(rows), np.int64), 0
        left = np.arange(len(rows))
        while len(left):
            hit = self.kept.access(rows) == 1
            out[left[hit]] = self.kept_at[self.kept.rank(np.ones(int(hit.sum()), np.int64), rows[hit])] + steps
            left, rows = left[~hit], rows[~hit]
            rows = self._back(self.matrix.access(rows), rows)
            steps += 1
        return out


class Phrases:
    """The different test phrases of a block of benchmark items, over their own vocabulary."""

    def __init__(self, items: list[tuple[str | None, str]], window: int = WINDOW):
        words, at = words_of(arrow_texts(pa.array([text for _, text in items], pa.string())))
        flat = words.dictionary_encode()
        self.vocabulary = flat.dictionary
        coded = np.asarray(flat.indices, dtype=np.int64) + 1
        found: dict[tuple, int] = {}
        owners: list[set] = []
        for (item, _), a, b in zip(items, at[:-1].tolist(), at[1:].tolist()):
            phrase = tuple(coded[a:b].tolist())
            if not phrase:
                continue
            for i in range(max(1, len(phrase) - window + 1)):
                nth = found.setdefault(phrase[i : i + window], len(found))
                if nth == len(owners):
                    owners.append(set())
                if item is not None:
                    owners[nth].add(item)
        self.lengths = np.array([len(p) for p in found], np.int64)
        self.table = np.zeros((len(found), int(self.lengths.max(initial=0))), np.int64)
        for nth, phrase in enumerate(found):
            self.table[nth, : len(phrase)] = phrase
        self.items = sorted(set().union(*owners)) if owners else []
        number = {item: i for i, item in enumerate(self.items)}
        self.owner_at = np.concatenate([[0], np.cumsum([len(o) for o in owners], dtype=np.int64)])
        self.owner = np.array([number[i] for o in owners for i in o], np.int64)
        self.shortest = int(self.lengths.min(initial=window))


def _places(known: np.ndarray, at: np.ndarray, phrases: Phrases) -> np.ndarray:
    """Words of the stretches that may hold a phrase, each stretch followed by -1."""
    border = np.zeros(len(known) + 1, bool)
    border[at] = True
    valid = known > 0
    before = np.concatenate([[False], valid[:-1]])
    after = np.concatenate([valid[1:], [False]])
    starts = np.flatnonzero(valid & (border[:-1] | ~before))
    lengths = np.flatnonzero(valid & (border[1:] | ~after)) + 1 - starts
    enough = lengths >= phrases.shortest
    starts, lengths = starts[enough], lengths[enough]
    out = np.full(int(lengths.sum()) + len(lengths), -1, np.int64)
    out[spread(np.cumsum(lengths + 1) - (lengths + 1), lengths)] = spread(starts, lengths)
    return out


def search_shard(words: list[pa.Array], at: np.ndarray, phrases: Phrases) -> tuple[np.ndarray, np.ndarray]:
    """Search a shard's words, whose texts begin at ``at``.

    Returns a flag per word that lies inside an occurrence, and the pairs (text, item number) with an occurrence.
    """
    inside = np.zeros(int(at[-1]), bool)
    nothing = np.zeros((0, 2), np.int64)
    if not len(phrases.lengths):
        return inside, nothing
    found = [pc.index_in(w, value_set=phrases.vocabulary).fill_null(-1) for w in words]
    known = np.concatenate([np.asarray(f, dtype=np.int64) for f in found]) + 1
    places = _places(known, at, phrases)
    if not len(places):
        return inside, nothing
    symbols = np.where(places < 0, 0, known[places])
    index = FMIndex(symbols, len(phrases.vocabulary))
    low, high = index.search(phrases.table, phrases.lengths)
    until = np.cumsum(high - low)
    edges, pairs = np.zeros(len(known) + 1, np.int64), [np.zeros(0, np.int64)]
    for begin in range(0, int(until[-1]), LOCATED):
        nth = np.arange(begin, min(begin + LOCATED, int(until[-1])))
        phrase = np.searchsorted(until, nth, side="right")
        word = places[index.locate(high[phrase] - (until[phrase] - nth))]
        edges += np.bincount(word, minlength=len(edges))
        edges -= np.bincount(word + phrases.lengths[phrase], minlength=len(edges))
        text = np.searchsorted(at, word, side="right") - 1
        pairs.append(np.unique(text * len(phrases.lengths) + phrase))
    text, phrase = np.divmod(np.unique(np.concatenate(pairs)), len(phrases.lengths))
    per_phrase = np.diff(phrases.owner_at)[phrase]
    items = phrases.owner[spread(phrases.owner_at[phrase], per_phrase)]
    both = np.unique(np.repeat(text, per_phrase) * max(1, len(phrases.items)) + items)
    return np.cumsum(edges[:-1]) > 0, np.stack(np.divmod(both, max(1, len(phrases.items))), axis=1)


class Found:
    """What a shard's search found for each of its texts."""

    def __init__(self, rows: list[pa.RecordBatch], blocks):
        read = [words_of(arrow_texts(r.column("text"))) for r in rows]
        words = [w for w, _ in read]
        sizes = np.concatenate([np.diff(borders) for _, borders in read])
        at = np.concatenate([[0], np.cumsum(sizes)])
        hit, self.items = np.zeros(int(at[-1]), bool), [[] for _ in sizes]
        for phrases in blocks:
            inside, pairs = search_shard(words, at, phrases)
            hit |= inside
            for text, item in pairs.tolist():
                self.items[text].append(phrases.items[item])
        self.items = [sorted(set(x)) for x in self.items]
        self.n_words = sizes
        total = np.concatenate([[0], np.cumsum(hit)])
        self.n_hit = total[at[1:]] - total[at[:-1]]
        border = np.zeros(len(hit) + 1, bool)
        border[at] = True
        starts = np.flatnonzero(hit & (border[:-1] | ~np.concatenate([[False], hit[:-1]]))) if len(hit) else hit
        ends = np.flatnonzero(hit & (border[1:] | ~np.concatenate([hit[1:], [False]]))) + 1 if len(hit) else hit
        self.spans = [[] for _ in sizes]
        text = np.searchsorted(at, starts, side="right") - 1
        for t, a, b in zip(text.tolist(), (starts - at[text]).tolist(), (ends - at[text]).tolist()):
            self.spans[t].append({"first": a, "end": b})

    def contaminated(self) -> np.ndarray:
        return (self.n_hit > 0) & (20 * self.n_hit >= self.n_words)


def _shards(batches):
    """Runs of rows with a bounded amount of text."""
    rows, size = [], 0
    for batch in batches:
        for piece in pieces(batch, "text"):
            rows.append(piece)
            size += arrow_texts(piece.column("text")).nbytes
            if size >= SHARD_BYTES or sum(r.num_rows for r in rows) >= SHARD_TEXTS:
                yield rows
                rows, size = [], 0
    if rows:
        yield rows


def _cut_items(benchmark: DataFrame, window: int) -> DataFrame:
    """``item, words``: the items' words, lower-cased and joined, different rows only.

    An item of more than ``ITEM_BYTES`` is cut; the cuts overlap by one word less than a phrase, so none is lost.
    """

    def cut(batches):
        for batch in batches:
            for piece in pieces(batch, "text"):
                words, at = words_of(arrow_texts(piece.column("text")))
                ends = np.cumsum(np.asarray(pc.binary_length(words), dtype=np.int64) + 1)
                items, texts = [], []
                for item, a, b in zip(piece.column("item").to_pylist(), at[:-1].tolist(), at[1:].tolist()):
                    while a < b:
                        room = (ends[a - 1] if a else 0) + ITEM_BYTES
                        stop = min(b, max(a + window, int(np.searchsorted(ends, room, side="right"))))
                        items.append(item)
                        texts.append(" ".join(words[a:stop].to_pylist()))
                        a = b if stop == b else stop - window + 1
                yield pa.RecordBatch.from_arrays([pa.array(items, pa.string()), pa.array(texts, pa.string())], names=["item", "words"])

    given = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("string").alias("text"))
    return given.mapInArrow(cut, "item string, words string").distinct()


def _in_blocks(benchmark: DataFrame, window: int) -> DataFrame:
    """The cut items with a ``block`` each. Running sums over a digest's order deal them, so that a block has at most
    ``BLOCK_BYTES`` and one cut more, however many rows share an id."""
    marked = F.concat(F.coalesce(F.concat(F.lit("+"), "item"), F.lit("-")), F.lit(" "), "words")
    cut = _cut_items(benchmark, window).select("item", "words", F.sha2(marked.cast("binary"), 256).alias("digest"), F.octet_length("words").cast("long").alias("size"))
    dealt = running_sums(stored(cut), [F.col("digest")], {"upto": "size"})
    return stored(dealt.select("item", "words", F.floor((F.col("upto") - F.col("size")) / F.lit(BLOCK_BYTES)).cast("int").alias("block")))


def _blocks(spark: SparkSession, benchmark: DataFrame, window: int):
    """The benchmark as broadcasts of bounded size, and a function that yields their phrases inside a task."""
    items, run = _in_blocks(benchmark, window), uuid.uuid4().hex
    n = items.agg(F.max("block")).first()[0]
    sent = []
    for nth in range(0 if n is None else n + 1):
        block = items.filter(F.col("block") == nth).select("item", "words").collect()
        sent.append(spark.sparkContext.broadcast([tuple(r) for r in block]))

    def blocks():
        for nth, one in enumerate(sent):
            yield _phrases((run, nth), one, window)

    return blocks


_last: dict[str, tuple] = {}


def _phrases(key: tuple, sent, window: int) -> Phrases:
    """The phrases of a block; a worker keeps those of the last one it used, and no block's texts."""
    if _last.get("key") != key:
        _last.clear()
        _last.update(key=key, phrases=Phrases(sent.value, window))
        if getattr(sent, "_path", None):
            vars(sent).pop("_value", None)  # the texts; the broadcast reads its file again if asked again
    return _last["phrases"]


def find_phrases(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``doc_id, n_words, n_hit, items, spans`` per document.

    ``items`` are the ids of the items with an occurring phrase, as sorted strings; ``spans`` the merged stretches
    of words to remove, ``first`` included and ``end`` not.
    """
    blocks = _blocks(docs.sparkSession, benchmark, window)

    def search(batches):
        for rows in _shards(batches):
            got = Found(rows, blocks())
            ids = pa.concat_arrays([r.column("doc_id") for r in rows])
            yield pa.RecordBatch.from_arrays(
                [
                    ids, pa.array(got.n_words), pa.array(got.n_hit), pa.array(got.items, pa.list_(pa.string())),
                    pa.array(got.spans, pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))),
                ],
                names=["doc_id", "n_words", "n_hit", "items", "spans"],
            )

    columns = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    kind = "doc_id long, n_words long, n_hit long, items array<string>, spans array<struct<first:long,end:long>>"
    return columns.mapInArrow(search, kind)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated``: a twentieth of the words decides."""
    return find_phrases(docs, benchmark, window).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )


def keep_clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents that are not contaminated, with all their columns, unchanged."""
    blocks = _blocks(docs.sparkSession, benchmark, window)

    def keep(batches):
        for rows in _shards(batches):
            good = ~Found(rows, blocks()).contaminated()
            at = 0
            for row in rows:
                yield row.filter(pa.array(good[at : at + row.num_rows]))
                at += row.num_rows

    return filtered(docs, keep)
