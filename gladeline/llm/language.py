"""Language identification by error-correcting output codes.

Every language has a codeword; one binary n-gram classifier per bit says how much a text's byte trigrams speak for a
1. The classifiers are naive Bayes: a bit's weight of a trigram is the difference of its smoothed log shares among
the languages whose codeword has a 1 and those with a 0. All of them follow from one table of trigram counts per
language, gathered from every training text in one pass; no row is sampled and no text shortened. Decoding adds up
a logistic loss per bit, weighted by how far apart the bit's two sides lie, and takes the codeword with the least; a
text whose second-best codeword costs nearly as little is flagged as ambiguous.

Defined cases: a null text or one without a letter is ``und`` with score 0; training rows with null text or ``lang``
teach nothing; without any training row all texts are ``und``; with one language every text with a letter has it;
repeated rows count as often as they stand; further columns are passed on by :func:`keep_known` and ignored elsewhere.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gladeline.llm.tables import arrow_texts, byte_table, filtered, mapped, pieces, raw_bytes

UNKNOWN = "und"
#: Trigrams fall into so many buckets; the last one takes what is no trigram of one text.
BUCKETS = 1 << 13
PIECE = 1 << 20
#: A text's mean evidence per trigram counts as often as it has trigrams, up to this number.
EVIDENCE = 64
#: A second codeword within this share of the best one's loss makes a text ambiguous.
CLOSE = 0.25
_LETTERS = byte_table(lambda b: 65 <= b <= 90 or 97 <= b <= 122 or b >= 128)


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """``n`` codewords as rows of 0 and 1: all useful splits of up to seven languages, else random ones far apart."""
    if n <= 1:
        return np.ones((n, 1), np.int8)
    if n <= 7:
        columns = [c for c in itertools.product((0, 1), repeat=n) if c[0] == 1 and not all(c)]
        return np.array(columns, np.int8).T
    rng = np.random.default_rng(seed)
    width = 15 * int(np.ceil(np.log2(n)))
    tries = [rng.integers(0, 2, (n, width)).astype(np.int8) for _ in range(50)]

    def apart(code):
        distance = (code[:, None, :] != code[None, :, :]).sum(2) + width * np.eye(n, dtype=int)
        return distance.min() * ((code.min(0) == 0) & (code.max(0) == 1)).all()

    return max(tries, key=apart)


def trigrams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bucket at which each byte's trigram falls, and the border of each text."""
    raw, at = raw_bytes(mapped(texts, _LETTERS))
    code = raw.astype(np.uint32)
    out = np.full(len(code), BUCKETS - 1, np.int64)
    if len(code) > 2:
        mixed = (code[:-2] * np.uint32(0x9E3779B1)) ^ (code[1:-1] * np.uint32(0x85EBCA77)) ^ (code[2:] * np.uint32(0xC2B2AE3D))
        mixed = (mixed ^ (mixed >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
        out[:-2] = (mixed >> np.uint32(8)) % np.uint32(BUCKETS - 1)
    for back in (1, 2):  # the last two bytes of a text begin no trigram of it
        last = at[1:] - back
        out[last[last >= at[:-1]]] = BUCKETS - 1
    return out, at


def trigram_counts(docs: DataFrame) -> DataFrame:
    """``lang, bucket, n`` over all rows of ``lang, text``; a partition sends one row per language and bucket."""

    def count(batches):
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for piece in pieces(batch, "text", PIECE):
                bucket, at = trigrams(arrow_texts(piece.column("text")))
                langs = piece.column("lang").to_pylist()
                names = sorted(set(langs))
                number = np.array([names.index(x) for x in langs], np.int64)
                cell = np.repeat(number, np.diff(at)) * BUCKETS + bucket
                counts = np.bincount(cell, minlength=len(names) * BUCKETS).reshape(-1, BUCKETS)
                for name, row in zip(names, counts):
                    total[name] = total.get(name, 0) + row
        for name, row in total.items():
            some = np.flatnonzero(row[:-1])
            columns = [pa.array([name] * len(some), pa.string()), pa.array(some.astype(np.int32)), pa.array(row[some])]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "bucket", "n"])

    parts = docs.select(F.col("lang").cast("string"), F.col("text").cast("string")).mapInArrow(count, "lang string, bucket int, n long")
    return parts.groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


class LanguageModel:
    """Codewords and bit classifiers; its size depends on the number of languages only."""

    def __init__(self, languages: list[str], counts: np.ndarray):
        self.languages = languages
        self.code = codewords(len(languages))
        share = counts / np.maximum(counts.sum(1, keepdims=True), 1)  # each language counts the same
        bits = self.code.shape[1]
        self.weights = np.zeros((BUCKETS, bits), np.float32)
        self.trust = np.ones(bits)
        for b in range(bits if len(languages) > 1 else 0):
            on, off = (share[self.code[:, b] == v].mean(0) + 0.1 / BUCKETS for v in (1, 0))
            on, off = on / on.sum(), off / off.sum()
            self.weights[:-1, b] = np.log(on / off)
            self.trust[b] = ((on - off) * np.log(on / off)).sum()
        self.trust /= self.trust.sum()

    def evidence(self, texts: pa.Array) -> np.ndarray:
        """For each text and bit, how much the text speaks for a 1."""
        bucket, at = trigrams(texts)
        totals = np.zeros((len(texts), self.weights.shape[1]), np.float64)
        some = np.flatnonzero(np.diff(at))
        if len(some):
            totals[some] = np.add.reduceat(self.weights[bucket], at[some], axis=0, dtype=np.float64)
        n = np.maximum(np.diff(at) - 2, 1)
        return totals / n[:, None] * np.minimum(n, EVIDENCE)[:, None]

    def decode(self, evidence: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The nearest codeword by weighted loss, its share of the belief, and whether another is close."""
        sign = 2.0 * self.code - 1
        loss = (np.logaddexp(0, -evidence[:, None, :] * sign[None]) * self.trust).sum(2)
        best = loss.argmin(1)
        belief = np.exp(loss.min(1, keepdims=True) - loss)
        score = 1 / belief.sum(1)
        if len(self.languages) < 2:
            return best, score, np.zeros(len(best), bool)
        first, second = np.sort(loss, axis=1)[:, :2].T
        return best, score, second - first <= CLOSE * second

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and ambiguity of each text."""
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), bool)
        best, score, close = self.decode(self.evidence(texts))
        letter = np.asarray(pc.match_substring_regex(texts, r"\pL"))
        langs = [self.languages[i] if has else UNKNOWN for i, has in zip(best.tolist(), letter.tolist())]
        return langs, np.where(letter, score, 0.0), close & letter


def fit(training: DataFrame) -> LanguageModel:
    """Learn from all rows of ``lang, text`` with both; only the counts, languages times buckets, reach the driver."""
    rows = trigram_counts(training.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())).collect()
    languages = sorted({r["lang"] for r in rows})
    counts = np.zeros((len(languages), BUCKETS - 1))
    number = {name: i for i, name in enumerate(languages)}
    for r in rows:
        counts[number[r["lang"]], r["bucket"]] = r["n"]
    return LanguageModel(languages, counts)


def predict(docs: DataFrame, model: LanguageModel, held_out: Column) -> DataFrame:
    """``doc_id, held_out, lang_pred, score, ambiguous`` per document."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # some hundred kilobytes for a handful of languages

    def name(batches):
        for batch in batches:
            for piece in pieces(batch, "text", PIECE):
                langs, score, close = sent.value.predict(arrow_texts(piece.column("text")))
                columns = [piece.column("doc_id"), piece.column("held_out"), pa.array(langs, pa.string()), pa.array(score), pa.array(close)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "lang_pred", "score", "ambiguous"])

    columns = docs.select(F.col("doc_id").cast("long"), held_out.alias("held_out"), F.col("text").cast("string"))
    return columns.mapInArrow(name, "doc_id long, held_out boolean, lang_pred string, score double, ambiguous boolean")


def keep_known(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """The documents with a recognised language, with all their columns, unchanged."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def keep(batches):
        for batch in batches:
            for piece in pieces(batch, "text", PIECE):
                langs, _, _ = sent.value.predict(arrow_texts(piece.column("text")))
                yield piece.filter(pa.array([x != UNKNOWN for x in langs], pa.bool_()))

    return filtered(docs, keep)
