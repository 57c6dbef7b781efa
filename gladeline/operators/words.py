"""Cells, runs and bit words: the three forms of a mask or footprint.

* cells: ``(row, col)``
* runs: ``(keys..., row, col_lo, col_hi)``, inclusive
* words: ``(keys..., row, word, bits)``
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gladeline.grid import WORD_SHIFT, has_bit, low_bits, one_bit, run_bits_in_word, word_of


def cells_to_words(cells: DataFrame, **masks: Column) -> DataFrame:
    """One row per ``(row, word)`` with a bit column per mask expression."""
    bit = one_bit(low_bits(F.col("col"), WORD_SHIFT))
    zero = F.lit(0).cast("long")
    aggs = [F.bit_or(F.when(m, bit).otherwise(zero)).alias(name) for name, m in masks.items()]
    return cells.groupBy(F.col("row").cast("long").alias("row"), word_of(F.col("col")).alias("word")).agg(*aggs)


def explode_words(runs: DataFrame, lo: Column, hi: Column) -> DataFrame:
    """One row per word that columns ``lo..hi`` touch."""
    return runs.withColumn("word", F.explode(F.sequence(word_of(lo), word_of(hi))))


def runs_to_words(runs: DataFrame, keys: Sequence[str]) -> DataFrame:
    lo, hi = F.col("col_lo"), F.col("col_hi")
    return (
        explode_words(runs, lo, hi)
        .groupBy(*keys, F.col("row").cast("long").alias("row"), "word")
        .agg(F.bit_or(run_bits_in_word(lo, hi, F.col("word"))).alias("bits"))
    )


def words_to_pieces(words: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Runs of set bits, cut at word borders: no shuffle, no window.

    A run starts at a set bit whose lower neighbour is clear and ends at one whose upper neighbour is clear.
    """
    bits = F.col("bits")
    starts = bits.bitwiseAND(F.bitwise_not(F.shiftleft(bits, 1)))
    ends = bits.bitwiseAND(F.bitwise_not(F.shiftrightunsigned(bits, 1)))
    places = F.sequence(F.lit(0), F.lit(63))
    pairs = F.arrays_zip(
        F.filter(places, lambda i: has_bit(F.col("starts"), i)).alias("first"),
        F.filter(places, lambda i: has_bit(F.col("ends"), i)).alias("last"),
    )
    base = F.shiftleft(F.col("word"), WORD_SHIFT)
    return (
        words.filter(bits != F.lit(0))
        .select(*keys, "row", "word", starts.alias("starts"), ends.alias("ends"))
        .select(*keys, "row", "word", F.explode(pairs).alias("run"))
        .select(*keys, "row", (base + F.col("run.first")).alias("col_lo"), (base + F.col("run.last")).alias("col_hi"))
    )


def merge_pieces(pieces: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Join disjoint pieces that touch into full runs.

    A window holds one raster row of one footprint, so its size follows the width of that footprint.
    """
    in_row = Window.partitionBy(*keys, "row").orderBy("col_lo")
    begins = F.coalesce(F.col("col_lo") > F.lag("col_hi").over(in_row) + F.lit(1), F.lit(True))
    return (
        pieces.withColumn("begins", begins.cast("long"))
        .withColumn("run_no", F.sum("begins").over(in_row.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        .groupBy(*keys, "row", "run_no")
        .agg(F.min("col_lo").alias("col_lo"), F.max("col_hi").alias("col_hi"))
        .drop("run_no")
    )


def words_to_runs(words: DataFrame, keys: Sequence[str]) -> DataFrame:
    return merge_pieces(words_to_pieces(words, keys), keys)


def words_to_cells(words: DataFrame, keys: Sequence[str]) -> DataFrame:
    place = F.explode(F.sequence(F.lit(0), F.lit(63))).alias("place")
    return (
        words.select(*keys, "row", "word", "bits", place)
        .filter(has_bit(F.col("bits"), F.col("place")))
        .select(*keys, "row", (F.shiftleft(F.col("word"), WORD_SHIFT) + F.col("place")).alias("col"))
    )
