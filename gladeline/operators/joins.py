"""Joins of many rows to a table with one row per key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def join_to_unique(many: DataFrame, unique: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join where a key may be very frequent in ``many`` and occurs once in ``unique``.

    Adaptive execution can split a skewed partition only when a plain shuffle feeds the join. A side that was
    just aggregated by the same keys brings its own partitioning and has none, so a hash of the keys joins
    along with them: both sides are then shuffled for this join, and a hot key is spread over many tasks.

    The sides often come out of an ``explode``, whose size Spark takes to be that of its input. The hint keeps
    it from broadcasting a side that only looks small.
    """
    mix, (name,) = F.xxhash64(*keys), fresh([*many.columns, *unique.columns], "__mix")
    left, right = many.withColumn(name, mix), unique.withColumn(name, mix)
    return left.hint("merge").join(right, [name, *keys], how).drop(name)


def fresh(taken: Sequence[str], *names: str) -> list[str]:
    """``names``, each lengthened until no column of ``taken`` is called so; case does not tell names apart."""
    known = {c.lower() for c in taken}
    out = []
    for name in names:
        while name.lower() in known:
            name += "_"
        known.add(name.lower())
        out.append(name)
    return out
