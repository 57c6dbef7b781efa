"""The raster grid: cell size, pixel area, and bit words.

A raster mask is stored as *words*: one row per ``(row, word)`` where ``word = col >> 6`` and bit
``col & 63`` of a BIGINT says whether that cell is set. Building words is ``bit_or`` over cells, so it
combines on the map side, needs no sort, and turns 64 cells into one row before any spatial join.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_M = 6_371_008.8  # mean Earth radius
WORD_SHIFT = 6  # 64 columns per word
BLOCK_SHIFT = 3  # 8 x 8 cells per block


@dataclass(frozen=True)
class GridSpec:
    """Square cells. With ``lat0`` and ``cell_deg`` set, rows run south from latitude ``lat0``."""

    cell_m: float = 10.0
    lat0: float | None = None
    cell_deg: float | None = None

    def pixel_area(self, row: Column) -> Column:
        """Area of a cell in m2; it depends on the row alone."""
        if self.lat0 is None or self.cell_deg is None:
            return F.lit(float(self.cell_m) ** 2)
        step = math.radians(self.cell_deg)
        north = F.lit(math.radians(self.lat0)) - row * F.lit(step)
        strip = F.sin(north) - F.sin(north - F.lit(step))
        return F.lit(EARTH_RADIUS_M**2 * step) * strip

    def cells(self, metres: float) -> float:
        return metres / self.cell_m


def word_of(col: Column) -> Column:
    """Word index; an arithmetic shift, so it floors for negative columns too."""
    return F.shiftright(col.cast("long"), WORD_SHIFT)


def block_of(index: Column) -> Column:
    return F.shiftright(index.cast("long"), BLOCK_SHIFT)


def low_bits(index: Column, shift: int) -> Column:
    """Position inside a word or block: the lowest ``shift`` bits."""
    return index.cast("long").bitwiseAND(F.lit((1 << shift) - 1).cast("long")).cast("int")


def one_bit(position: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), position.cast("int"))


def bit_range(first: Column, last: Column) -> Column:
    """Bits ``first..last`` (inclusive, 0..63) set."""
    ones = F.lit(-1).cast("long")
    return F.call_function("shiftleft", ones, first.cast("int")).bitwiseAND(
        F.call_function("shiftrightunsigned", ones, (F.lit(63) - last).cast("int"))
    )


def has_bit(bits: Column, position: Column) -> Column:
    return F.getbit(bits, position) == F.lit(1)


def without(bits: Column, erased: Column) -> Column:
    """``bits`` minus ``erased``."""
    return bits.bitwiseAND(F.bitwise_not(erased))


def run_bits_in_word(col_lo: Column, col_hi: Column, word: Column) -> Column:
    """The part of columns ``col_lo..col_hi`` inside ``word``, as bits (0 when they do not meet)."""
    first = F.greatest(col_lo.cast("long"), F.shiftleft(word, WORD_SHIFT))
    last = F.least(col_hi.cast("long"), F.shiftleft(word, WORD_SHIFT) + F.lit(63))
    bits = bit_range(low_bits(first, WORD_SHIFT), low_bits(last, WORD_SHIFT))
    return F.when(first <= last, bits).otherwise(F.lit(0).cast("long"))
