"""Row numbers, ranks and running sums over a whole table without a one-task window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gladeline.session import cut_lineage


def running_sums(df: DataFrame, order: Sequence[Column], sums: dict[str, str]) -> DataFrame:
    """Running totals in the given order; ``sums`` maps a new column to the column it adds up.

    The order must be total. Rows are range-partitioned and written once (the range bounds come from a
    sample, so both uses below must see the same split); then each partition is summed on its own and
    shifted by the totals of the partitions before it. Only one row per partition is gathered.
    """
    split = cut_lineage(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    totals = split.groupBy("__part").agg(*[F.sum(c).alias(f"__{new}") for new, c in sums.items()])
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        "__part", *[F.coalesce(F.sum(f"__{new}").over(before), F.lit(0)).alias(f"__{new}") for new in sums]
    )
    in_part = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # one offset row per partition of the shuffle: a few thousand at most
    joined = split.join(F.broadcast(offsets), "__part")
    return joined.select(
        *df.columns, *[(F.sum(c).over(in_part) + F.col(f"__{new}")).alias(new) for new, c in sums.items()]
    )


def number_rows(df: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """Sequential numbers from 0 in the given total order."""
    numbered = running_sums(df.withColumn("__one", F.lit(1).cast("long")), order, {name: "__one"})
    return numbered.withColumn(name, F.col(name) - F.lit(1)).drop("__one")


def shuffled_rank(df: DataFrame, group: str, key: str, seed: int, buckets: int = 1 << 14) -> DataFrame:
    """Add ``rank`` (from 1) of each row inside its group, in an order fixed by ``key`` and ``seed``.

    The order is that of a hash of the key. Its top bits cut every group into ``buckets`` even pieces, so a
    group that holds nearly all rows is still ranked by many tasks; a small count table per group and bucket
    gives each piece its offset. Depends on keys alone, not on row order or partition count.
    """
    mix = shuffle_key(F.col(key), seed)
    keyed = df.withColumn("__mix", mix).withColumn("__bucket", F.floor(F.col("__mix") / F.lit((1 << 32) // buckets)))
    counts = keyed.groupBy(F.col(group).alias("__group"), F.col("__bucket").alias("__at")).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy("__group").orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("__group", "__at", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"))
    in_bucket = Window.partitionBy(group, "__bucket").orderBy("__mix", key)
    ranked = keyed.withColumn("__place", F.row_number().over(in_bucket))
    same = F.col(group).eqNullSafe(F.col("__group")) & (F.col("__bucket") == F.col("__at"))
    return ranked.join(offsets, same).select(*df.columns, (F.col("__place") + F.col("__offset")).cast("long").alias("rank"))


def shuffle_key(key: Column, seed: int) -> Column:
    """A 32-bit number that scatters integer keys: the first 8 hex digits of an MD5."""
    text = F.concat_ws(":", F.lit(str(seed)), key.cast("string"))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long")
