"""Quality classifier: a sparse ensemble of rules read off trees.

Statistics of whole texts (shares of kinds of characters, word and line shapes, repetition) feed a forest of shallow
trees. Every path from a root is a rule, a conjunction of bounds on statistics; a lasso logistic regression over the
rules' truth values keeps few of them, and those become one Spark column expression, so scoring a table is a
projection. The fit runs on at most ``SAMPLE`` labelled rows, taken by a hash of the id; statistics are computed for
all rows and stored once for both uses.

Defined cases: null and empty texts have all statistics 0 and are scored like any other; rows with a null label or id
teach nothing, several labels of one document are averaged and rounded down to 0 when split; with no training rows the
score is 0.5, with one class it is that label; further columns are ignored.
"""

from __future__ import annotations

import re
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gladeline.llm.tables import arrow_texts, byte_table, mapped, pieces, raw_bytes, split_words, stored

#: Labelled rows that the fit uses at most.
SAMPLE = 20_000
TREES = 24
DEPTH = 3
LASSO = 0.002
THRESHOLD = 0.3
PIECE = 2 << 20

#: Classes of bytes whose share of the text is a statistic.
CLASSES = {
    "lower": b"abcdefghijklmnopqrstuvwxyz", "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789", "space": b" \t",
    "line": b"\n", "stop": b".", "comma": b",", "bang": b"!?", "pipe": b"|", "symbol": b"#$%&*@^~<>=_+\\/{}[]", "quote": b"\"'()-:;",
}
STATISTICS = [
    "log_bytes", *[f"{c}_share" for c in CLASSES], "beyond_ascii_share", "mean_word", "long_word_share", "word_variety",
    "same_word_share", "same_pair_share", "words_a_line", "line_variety", "words_a_stop",
]
_CLASS = np.full(256, len(CLASSES) + 1, np.int64)
for _i, _members in enumerate(CLASSES.values()):
    _CLASS[list(_members)] = _i
_CLASS[128:] = len(CLASSES)
_PLAIN = byte_table(lambda b: 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128)


def _different(text: np.ndarray, code: np.ndarray, n: int) -> np.ndarray:
    """How many different codes each of ``n`` texts has."""
    width = int(code.max(initial=0)) + 1
    return np.bincount(np.unique(text * width + code) // width, minlength=n)


def statistics(texts: pa.Array) -> np.ndarray:
    """One row of ``STATISTICS`` per text."""
    raw, at = raw_bytes(texts)
    n, size = len(texts), np.diff(at)
    text = np.repeat(np.arange(n), size)
    kinds = len(CLASSES) + 2
    count = np.bincount(text * kinds + _CLASS[raw], minlength=n * kinds).reshape(n, kinds)
    some = np.maximum(size, 1)
    words, word_at = split_words(mapped(texts, _PLAIN))
    code = np.asarray(words.dictionary_encode().indices, dtype=np.int64)
    n_words = np.diff(word_at)
    owner = np.repeat(np.arange(n), n_words)
    length = np.diff(raw_bytes(words)[1])
    with_words = np.maximum(n_words, 1)

    def again(apart: int) -> np.ndarray:
        """Share of words equal to the one ``apart`` places before."""
        same = (code[apart:] == code[:-apart]) & (owner[apart:] == owner[:-apart]) if len(code) > apart else np.zeros(0, bool)
        return np.bincount(owner[apart:][same] if len(same) else owner[:0], minlength=n) / with_words

    breaks = count[:, list(CLASSES).index("line")] + 1
    # a line is told from others by a sum over its bytes that depends on their places
    line_of = np.concatenate([[0], np.cumsum((raw[:-1] == 10) | (text[1:] != text[:-1]))]) if len(raw) else np.zeros(0, np.int64)
    first = np.flatnonzero(np.concatenate([[True], line_of[1:] != line_of[:-1]])) if len(raw) else np.zeros(0, np.int64)
    place = np.arange(len(raw)) - np.repeat(first, np.diff(np.append(first, len(raw))))
    mixed = (raw.astype(np.uint64) + np.uint64(1)) * (place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) | np.uint64(1))
    mixed[raw == 10] = 0  # the last line of a text has no line feed
    sums = np.add.reduceat(mixed, first) if len(first) else np.zeros(0, np.uint64)
    line_text = text[first] if len(first) else np.zeros(0, np.int64)
    different = _different(line_text, np.unique(sums, return_inverse=True)[1].astype(np.int64), n)
    lines = np.maximum(np.bincount(line_text, minlength=n), 1)
    return np.column_stack([
        np.log1p(size), count[:, : len(CLASSES) + 1] / some[:, None],
        np.bincount(owner, length, minlength=n) / with_words, np.bincount(owner, length > 12, minlength=n) / with_words,
        _different(owner, code, n) / with_words, again(1), again(2), n_words / breaks, different / lines,
        n_words / (count[:, list(CLASSES).index("stop")] + 1),
    ])


def measured(docs: DataFrame) -> DataFrame:
    """``doc_id`` and the statistics of each whole text."""

    def measure(batches):
        for batch in batches:
            for piece in pieces(batch, "text", PIECE):
                values = statistics(arrow_texts(piece.column("text")))
                yield pa.RecordBatch.from_arrays(
                    [piece.column("doc_id"), *[pa.array(np.ascontiguousarray(v)) for v in values.T]], names=["doc_id", *STATISTICS]
                )

    columns = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return columns.mapInArrow(measure, ", ".join(["doc_id long", *[f"{s} double" for s in STATISTICS]]))


Bound = tuple[str, str, float]  # statistic, "<=" or ">", bound


def paths(description: str, names: list[str]) -> set[tuple[Bound, ...]]:
    """All conjunctions on the way from the root to a node, from a tree's printed form."""
    found, stack = set(), []
    for line in description.splitlines():
        m = re.match(r"( *)(?:If|Else) \(feature (\d+) (<=|>) (\S+)\)", line)
        if not m:
            continue
        depth, bound = len(m[1]), (names[int(m[2])], m[3], float(m[4]))
        stack = [x for x in stack if x[0] < depth] + [(depth, bound)]
        found.add(_narrowed([b for _, b in stack]))
    return found


def _narrowed(bounds: list[Bound]) -> tuple[Bound, ...]:
    """A conjunction with the tightest bound on each side of each statistic."""
    best: dict[tuple[str, str], float] = {}
    for name, side, value in bounds:
        old = best.get((name, side), value)
        best[name, side] = min(old, value) if side == "<=" else max(old, value)
    return tuple(sorted((n, s, v) for (n, s), v in best.items()))


def holds(rule: tuple[Bound, ...]) -> Column:
    """A rule as a Spark condition."""
    sides = [F.col(n) <= F.lit(v) if s == "<=" else F.col(n) > F.lit(v) for n, s, v in rule]
    return reduce(lambda a, b: a & b, sides)


class RuleModel:
    """Weighted rules and their compiled form."""

    def __init__(self, intercept: float, rules: dict[tuple[Bound, ...], float]):
        self.intercept, self.rules = intercept, rules

    def score(self) -> Column:
        """The chance of label 1 as one expression over the statistics."""
        total = F.lit(float(self.intercept))
        for rule, weight in self.rules.items():
            total = total + F.when(holds(rule), F.lit(float(weight))).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def fit(training: DataFrame, sample: int = SAMPLE) -> RuleModel:
    """Learn from rows of ``label`` and the statistics; at most about ``sample`` of them, by a hash of ``doc_id``."""
    n, ones = training.agg(F.count(F.lit(1)), F.sum("label")).first()
    if not n or not ones or ones == n:
        return RuleModel(0.0 if not n else 40.0 if ones else -40.0, {})
    if n > sample:
        share = sample / n
        training = training.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < F.lit(int(share * (1 << 20))))
    rows = stored(VectorAssembler(inputCols=STATISTICS, outputCol="features").transform(training))
    rows = rows.coalesce(max(1, rows.sparkSession.sparkContext.defaultParallelism)).cache()
    forest = RandomForestClassifier(
        labelCol="label", numTrees=TREES, maxDepth=DEPTH, subsamplingRate=0.5, featureSubsetStrategy="onethird", seed=11
    ).fit(rows)
    rules = sorted(set().union(*(paths(t.toDebugString, STATISTICS) for t in forest.trees)))
    if not rules:
        rows.unpersist()
        return RuleModel(float(np.log(ones / (n - ones))), {})
    # one pass turns a row into the truth values of its rules
    truth = rows.select("label", *[holds(r).cast("double").alias(f"r{i}") for i, r in enumerate(rules)])
    truth = VectorAssembler(inputCols=[f"r{i}" for i in range(len(rules))], outputCol="truth").transform(truth).select("label", "truth").cache()
    lasso = LogisticRegression(
        featuresCol="truth", labelCol="label", elasticNetParam=1.0, regParam=LASSO, maxIter=60, standardization=True
    ).fit(truth)
    truth.unpersist()
    rows.unpersist()
    weights = lasso.coefficients.toArray()
    return RuleModel(lasso.intercept, {r: w for r, w in zip(rules, weights) if abs(w) > 1e-9})


def label_of(labels: DataFrame) -> DataFrame:
    """``doc_id, label``: one row per labelled document."""
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
    label = F.when(F.avg("quality") > 0.5, F.lit(1)).otherwise(F.lit(0)).alias("label")
    return known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(label)


def classify(docs: DataFrame, labels: DataFrame, held_out: Column, sample: int = SAMPLE) -> DataFrame:
    """``doc_id, held_out, score, predicted`` per document; ``held_out`` marks rows that teach nothing."""
    known = stored(measured(docs).withColumn("held_out", held_out))
    teaching = known.filter(~F.col("held_out")).join(label_of(labels), "doc_id")
    model = fit(teaching, sample)
    scored = known.withColumn("score", model.score())
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
