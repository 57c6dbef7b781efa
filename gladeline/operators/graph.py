"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gladeline.operators.joins import join_to_unique
from gladeline.session import cut_lineage


def collapse(edges: DataFrame) -> DataFrame:
    """Edges ``(a, b)`` to ``(id, home)``: every node with its cluster's smallest node.

    Randomised contraction: in each round every node moves to the smallest of its own and its neighbours'
    random numbers, and nodes that meet become one. About half the nodes or more vanish per round whatever the
    shape, so all rounds together cost little more than the first, and a cluster of great diameter needs no
    more rounds than a compact one. Only minima per node are taken; no neighbour list is gathered.
    """
    moves = []
    edges = cut_lineage(edges)
    while not edges.isEmpty():
        moved = cut_lineage(_smallest_near(edges, len(moves)))
        edges = cut_lineage(_contract(edges, moved))
        moves.append(moved)
    if not moves:
        return edges.select(F.col("a").alias("id"), F.col("b").alias("home"))
    ends = _follow(moves)
    smallest = ends.groupBy("round", "end").agg(F.min("a").alias("home"))
    return join_to_unique(ends, smallest, ["round", "end"]).select(F.col("a").alias("id"), "home")


def _smallest_near(edges: DataFrame, number: int) -> DataFrame:
    """``(a, to)``: the smallest number among a node and its neighbours.

    The hash of one BIGINT with a fixed seed maps BIGINTs one to one, so equal numbers mean the same node.
    """

    def drawn(node: str):
        return F.xxhash64(F.lit(number), F.col(node))

    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return both.groupBy("a").agg(F.min(drawn("b")).alias("near")).select("a", F.least("near", drawn("a")).alias("to"))


def _contract(edges: DataFrame, moved: DataFrame) -> DataFrame:
    first = join_to_unique(edges, moved, ["a"]).select(F.col("b").alias("a"), F.col("to").alias("x"))
    both = join_to_unique(first, moved, ["a"]).filter(F.col("x") != F.col("to"))
    return both.select(F.greatest("x", "to").alias("a"), F.least("x", "to").alias("b")).distinct()


def _follow(moves: list[DataFrame]) -> DataFrame:
    """``(a, round, end)``: where each first-round node ends up. A number is unique within its round only."""
    ends = None
    for number, moved in reversed(list(enumerate(moves))):
        here = moved.select("a", "to", F.lit(number).alias("here"))
        if ends is None:
            ends = here.select("a", F.col("here").alias("round"), F.col("to").alias("end"))
            continue
        later = join_to_unique(here, ends.withColumnRenamed("a", "to"), ["to"], "left")
        ends = later.select("a", F.coalesce("round", "here").alias("round"), F.coalesce("end", "to").alias("end"))
        if number % 4 == 0:
            ends = cut_lineage(ends)
    return ends
