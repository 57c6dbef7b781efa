"""Outline polygons of footprints: sides of cells, linked into closed rings."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from gladeline.grid import without
from gladeline.operators.words import merge_pieces, runs_to_words, words_to_pieces
from gladeline.session import cut_lineage

# directions of a side, clockwise with y pointing down
RIGHT, DOWN, LEFT, UP = range(4)


def _directed_sides(runs: DataFrame, id_col: str) -> DataFrame:
    """Straight outline sides ``(id, x1, y1, x2, y2, way)`` from turn to turn."""
    words = runs_to_words(runs, [id_col])
    down = Window.partitionBy(id_col, "word").orderBy("row")
    zero = F.lit(0).cast("long")
    bits, row = F.col("bits"), F.col("row")
    over = F.when(F.lag("row").over(down) == row - 1, F.lag("bits").over(down)).otherwise(zero)
    under = F.when(F.lead("row").over(down) == row + 1, F.lead("bits").over(down)).otherwise(zero)

    def part(way: int, mask: Column) -> Column:
        return F.struct(F.lit(way).alias("way"), mask.alias("bits"))

    # upper sides, lower sides, and whole rows, whose ends are the upright sides
    whole = -1
    parts = F.array(part(RIGHT, without(bits, F.col("over"))), part(LEFT, without(bits, F.col("under"))), part(whole, bits))
    pieces = words.withColumns({"over": over, "under": under}).select(id_col, "row", "word", F.explode(parts).alias("part"))
    pieces = words_to_pieces(pieces.select(id_col, "row", "word", "part.way", "part.bits"), [id_col, "way"])
    level = merge_pieces(pieces, [id_col, "way"])
    lo, hi, way = F.col("col_lo"), F.col("col_hi") + 1, F.col("way")
    flat = level.filter(way != whole).select(
        id_col, F.when(way == RIGHT, lo).otherwise(hi).alias("x1"), F.when(way == RIGHT, row).otherwise(row + 1).alias("y1"),
        F.when(way == RIGHT, hi).otherwise(lo).alias("x2"), F.when(way == RIGHT, row).otherwise(row + 1).alias("y2"), "way",
    )
    # ends of runs, one below the other, as runs of rows: ``row`` is the x here and ``col_*`` are rows
    ends = F.array(*[F.struct(F.lit(w).alias("way"), x.alias("x")) for w, x in ((UP, lo), (DOWN, hi))])
    upright = level.filter(way == whole).select(id_col, "row", F.explode(ends).alias("end"))
    upright = upright.select(id_col, "end.way", F.col("end.x").alias("row"), F.col("row").alias("col_lo"), F.col("row").alias("col_hi"))
    upright = merge_pieces(upright, [id_col, "way"])
    return flat.unionByName(upright.select(
        id_col, row.alias("x1"), F.when(way == UP, hi).otherwise(lo).alias("y1"),
        row.alias("x2"), F.when(way == UP, lo).otherwise(hi).alias("y2"), "way",
    ))


def outline_edges(runs: DataFrame, id_col: str = "farm_id") -> DataFrame:
    """Straight outline sides ``(id, x1, y1, x2, y2)`` in cell corners, from turn to turn, the inside on the right hand.

    A cell side is on the outline when the cell across it is outside. Works on whole words: the upper sides
    of a row are its bits minus those of the row above. A window holds one raster row or column of one footprint.
    """
    return _directed_sides(runs, id_col).drop("way")


#: Sides are linked in tiles of 256 x 256 corners first, then in tiles 8 times as wide each round; rows linked at once.
TILE_SHIFT, TILE_STEP, BATCH_ROWS = 8, 3, 100_000


def _chains(keys: list[tuple], ons: list[tuple], lengths: list[int], lows: list[tuple], low_steps: list[int]) -> list[tuple]:
    """Walks the items of one tile from each to the one it leads to: ``chain, pos, closed, length, to, low, low_pos`` of each.

    An item is a stretch of ``length`` sides that begins at the side ``key`` and leads on to the side ``on``; ``low``
    is its smallest side, ``low_steps`` from its start. A chain begins at an item that no other of the tile leads
    to. What is left are rings, which begin at their smallest item.
    """
    at = {k: i for i, k in enumerate(keys)}
    following = [at.get(k, -1) for k in ons]
    entered = set(following)
    starts = [i for i in range(len(keys)) if i not in entered]
    open_chains, out, chain = len(starts), [None] * len(keys), 0
    done = [False] * len(keys)
    if open_chains < len(keys):
        starts += sorted(range(len(keys)), key=keys.__getitem__)
    for nth, start in enumerate(starts):
        if done[start]:
            continue
        members, places, i, pos, low = [], [], start, 0, None
        while i >= 0 and not done[i]:
            done[i] = True
            members.append(i)
            places.append(pos)
            if low is None or lows[i] < low[0]:
                low = lows[i], pos + low_steps[i]
            pos += lengths[i]
            i = following[i]
        for m, place in zip(members, places):
            out[m] = chain, place, nth >= open_chains, pos, ons[members[-1]], *low
        chain += 1
    return out


def _link_tiles(batches, id_col: str, kind: pa.Schema):
    """The items with their chains; rows come sorted by footprint and tile, and no tile is cut."""
    waiting = None

    def linked(rows: pa.Table):
        def values(name):
            column = rows[name]
            # whole numbers by way of NumPy, several times faster
            return column.to_numpy().tolist() if pa.types.is_integer(column.type) and not column.null_count else column.to_pylist()

        def tuples(*names):
            return list(zip(*map(values, names)))

        tile, found, a = tuples(id_col, "ty", "tx"), [], 0
        keys, ons, lows = (tuples(*[f"{end}_{c}" for c in ("y", "x", "way")]) for end in ("at", "to", "low"))
        lengths, steps = values("length"), values("low_steps")
        while a < len(tile):
            b = a + 1
            while b < len(tile) and tile[b] == tile[a]:
                b += 1
            found += _chains(keys[a:b], ons[a:b], lengths[a:b], lows[a:b], steps[a:b])
            a = b
        chain, pos, closed, length, to, low, low_pos = zip(*found)
        new = {"chain": chain, "pos": pos, "closed": closed, "chain_length": length, "chain_low_pos": low_pos}
        for name, ends in (("chain_to", to), ("chain_low", low)):
            new |= dict(zip((f"{name}_y", f"{name}_x", f"{name}_way"), zip(*ends)))
        columns = [pa.array(list(new[f.name]), f.type) if f.name in new else rows[f.name].cast(f.type) for f in kind]
        return pa.Table.from_arrays(columns, schema=kind).to_batches()

    for batch in batches:
        rows = pa.Table.from_batches([batch])
        waiting = rows if waiting is None else pa.concat_tables([waiting, rows])
        if waiting.num_rows < BATCH_ROWS:
            continue
        # the last tile may go on in the next batch
        last = waiting.slice(waiting.num_rows - 1).select([id_col, "ty", "tx"]).to_pylist()[0].values()
        cut = waiting.num_rows
        while cut and tuple(waiting.slice(cut - 1, 1).select([id_col, "ty", "tx"]).to_pylist()[0].values()) == tuple(last):
            cut -= 1
        if cut:
            yield from linked(waiting.slice(0, cut).combine_chunks())
            waiting = waiting.slice(cut)
    if waiting is not None and waiting.num_rows:
        yield from linked(waiting.combine_chunks())


def _corner(prefix: str) -> Column:
    return F.struct(*[F.col(f"{prefix}_{c}").alias(c) for c in ("y", "x", "way")])


def _first_items(runs: DataFrame, id_col: str) -> DataFrame:
    """The sides, each as an item of length 1 that leads to the next side."""
    sides = _directed_sides(runs, id_col)
    leaving = sides.groupBy(id_col, F.col("x1").alias("x2"), F.col("y1").alias("y2")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1), F.col("way"))).alias("ways")
    )
    right, left = (F.col("way") + 1) % 4, (F.col("way") + 3) % 4
    way_on = F.when(F.getbit("ways", right) == 1, right).otherwise(left)
    at = {"y": F.col("y1").cast("long"), "x": F.col("x1").cast("long"), "way": F.col("way")}
    to = {"y": F.col("y2").cast("long"), "x": F.col("x2").cast("long"), "way": way_on}
    return sides.join(leaving, [id_col, "x2", "y2"]).select(
        id_col, *[v.alias(f"{end}_{c}") for end, corner in (("at", at), ("to", to), ("low", at)) for c, v in corner.items()],
        F.lit(1).cast("long").alias("length"), F.lit(0).cast("long").alias("low_steps"),
    )


def outline_corners(runs: DataFrame, id_col: str = "farm_id") -> DataFrame:
    """Corners of all outline rings as rows ``(id, head, place, x, y)``.

    ``head`` names the ring by its uppermost, then leftmost corner, and ``place`` orders the corners from there,
    from 0. At a corner shared by two rings, each turns right.

    The list of sides shrinks while it is ranked: within a tile items are walked into chains, most rings being
    closed by that; the chains that leave their tile are the items of the next round, whose tiles are wider. When
    none is left, the places go back down, round by round. No ring is ever held by one task: a tile holds what
    crosses the borders of its 64 parts, so its items follow its circumference.
    """
    items, rounds = _first_items(runs, id_col), []
    by = [id_col, "ty", "tx"]
    while True:
        shift = TILE_SHIFT + TILE_STEP * len(rounds)
        # tiles lie around 0, so that one of them holds everything in the end
        tile = {t: F.shiftright(F.col(f"at_{c}") + (1 << shift - 1 if shift else 0), shift) for t, c in (("ty", "y"), ("tx", "x"))}
        placed = items.withColumns(tile).repartition(*by).sortWithinPartitions(*by)
        more = "chain int, pos long, closed boolean, chain_length long, chain_low_pos long"
        more += "".join(f", {end}_{c} {kind}" for end in ("chain_to", "chain_low") for c, kind in (("y", "long"), ("x", "long"), ("way", "int")))
        spark_kind = StructType([*placed.schema.fields, *StructType.fromDDL(more).fields])
        kind = to_arrow_schema(spark_kind)
        linked = cut_lineage(placed.mapInArrow(lambda batches, kind=kind: _link_tiles(batches, id_col, kind), spark_kind))
        rounds.append(linked)
        left = linked.filter("NOT closed AND pos = 0")
        if left.isEmpty():
            break
        ends = [F.col(f"{a}_{c}").alias(f"{b}_{c}") for a, b in (("at", "at"), ("chain_to", "to"), ("chain_low", "low")) for c in ("y", "x", "way")]
        items = left.select(id_col, *ends, F.col("chain_length").alias("length"), F.col("chain_low_pos").alias("low_steps"))
    known = None
    for linked in reversed(rounds):
        start = F.pmod(F.col("pos") - F.col("chain_low_pos"), F.col("chain_length"))
        found = linked.filter("closed").select(
            id_col, _corner("at").alias("at"), _corner("chain_low").alias("head"), start.alias("place"), F.col("chain_length").alias("around")
        )
        if known is not None:
            # a chain of this round was one item of the next; it is named by its tile and number, its start by a side
            begun = linked.filter("NOT closed AND pos = 0").select(*by, "chain", _corner("at").alias("at")).join(known, [id_col, "at"])
            inner = linked.filter("NOT closed").hint("merge").join(begun.drop("at"), [*by, "chain"])
            place = F.pmod(F.col("place") + F.col("pos"), F.col("around"))
            found = found.unionByName(inner.select(id_col, _corner("at").alias("at"), "head", place.alias("place"), "around"))
        known = found
    return known.select(id_col, "head", "place", F.col("at.x").alias("x"), F.col("at.y").alias("y"))


def polygonize(runs: DataFrame, id_col: str = "farm_id") -> DataFrame:
    """``id, rings ARRAY<ARRAY<STRUCT<x, y>>>`` in cell corners.

    Outer rings run with the inside on the right, holes the other way; parts that touch only at a corner get
    rings of their own. Only the finished value of a footprint is an array; rings come as rows from
    :func:`outline_corners`.
    """
    points = F.sort_array(F.collect_list(F.struct("place", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))))
    rings = outline_corners(runs, id_col).groupBy(id_col, "head").agg(points.alias("p"))
    ring = F.transform(F.concat("p", F.slice("p", 1, 1)), lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))
    shapes = rings.select(id_col, "head", ring.alias("ring")).groupBy(id_col).agg(
        F.sort_array(F.collect_list(F.struct("head", "ring"))).alias("rings")
    )
    return shapes.select(id_col, F.transform("rings", lambda r: r["ring"]).alias("rings"))
