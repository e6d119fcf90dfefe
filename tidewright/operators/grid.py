"""Square tiles over a grid of series, their overlap with storage chunks, and what is still to do."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tiled(points: DataFrame, side: int) -> DataFrame:
    """Adds the tile (ty, tx) of each point (y, x)."""
    return points.withColumn("ty", F.floor(F.col("y") / side)).withColumn("tx", F.floor(F.col("x") / side))


def spans(points: DataFrame, side: int, chunk: int) -> DataFrame:
    """(axis, tile, chunk, start, end, chunk_points): where tiles and chunks overlap on each axis.

    The chunks of a tile follow from its bounds, so this is a map over the tiles of the two axes, without a range join.
    """
    extent = points.agg((F.max("y") + 1).alias("y"), (F.max("x") + 1).alias("x"))
    axes = extent.select(F.inline(F.array(*(F.struct(F.lit(a).alias("axis"), F.col(a).alias("n")) for a in ("y", "x")))))
    tiles = axes.select("axis", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / side))).alias("tile"))
    last = F.least((F.col("tile") + 1) * side, F.col("n"))
    cut = tiles.withColumn("stop", last).withColumn("chunk", F.explode(F.sequence(F.floor(F.col("tile") * side / chunk), F.floor((F.col("stop") - 1) / chunk))))
    return cut.select(
        "axis", "tile", "chunk", F.greatest(F.col("tile") * side, F.col("chunk") * chunk).alias("start"), F.least("stop", (F.col("chunk") + 1) * chunk).alias("end"),
        (F.least((F.col("chunk") + 1) * chunk, F.col("n")) - F.col("chunk") * chunk).alias("chunk_points"),
    )


def read_amplification(spans: DataFrame) -> DataFrame:
    """(ty, tx, points_read, points_used, amplification): what reading whole chunks costs each tile."""
    s = spans.groupBy("axis", "tile").agg(F.sum("chunk_points").alias("read"), F.sum(F.col("end") - F.col("start")).alias("used"))
    y, x = (s.where(F.col("axis") == a).select(F.col("tile").alias(f"t{a}"), F.col("read").alias(f"read_{a}"), F.col("used").alias(f"used_{a}")) for a in ("y", "x"))
    both = y.crossJoin(x).withColumn("points_read", F.col("read_y") * F.col("read_x")).withColumn("points_used", F.col("used_y") * F.col("used_x"))  # a row per tile
    return both.select("ty", "tx", "points_read", "points_used", (F.col("points_read") / F.col("points_used")).alias("amplification"))


class CoverError(ValueError):
    """Tiles that do not hold each place once."""


def uncovered(tiles: DataFrame, points: DataFrame) -> DataFrame:
    """(y, x, n_missing, n_extra): places that the tiles (y0, y1, x0, x1; ends left out) do not hold, or hold more often than they are there."""
    rows = tiles.select(F.explode(F.sequence("y0", F.col("y1") - 1)).alias("y"), "x0", "x1")
    held = rows.select("y", F.explode(F.sequence("x0", F.col("x1") - 1)).alias("x"))
    places = points.select(F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"))
    missing, extra = places.exceptAll(held), held.exceptAll(places)
    found = missing.withColumn("missing", F.lit(1)).unionByName(extra.withColumn("missing", F.lit(0)))
    return found.groupBy("y", "x").agg(F.sum("missing").alias("n_missing"), F.sum(1 - F.col("missing")).alias("n_extra"))


def rectangles(points: DataFrame, side: int) -> DataFrame:
    """(ty, tx, y0, y1, x0, x1): the tiles of a whole grid, cut at its last row and column."""
    e = points.agg(*(f(c).cast("long").alias(f"{n}_{c}") for n, f in (("min", F.min), ("max", F.max)) for c in ("y", "x"))).where("min_y is not null")
    t = e.withColumn("ty", F.explode(F.sequence(F.floor(F.col("min_y") / side), F.floor(F.col("max_y") / side)))).withColumn("tx", F.explode(F.sequence(F.floor(F.col("min_x") / side), F.floor(F.col("max_x") / side))))
    lo = lambda c: F.greatest(F.col(f"t{c}") * side, F.col(f"min_{c}")).cast("long").alias(f"{c}0")
    hi = lambda c: F.least((F.col(f"t{c}") + 1) * side, F.col(f"max_{c}") + 1).cast("long").alias(f"{c}1")
    return t.select("ty", "tx", lo("y"), hi("y"), lo("x"), hi("x"))


def check_cover(tiles: DataFrame, points: DataFrame) -> DataFrame:
    """The tiles, refused if a place of the grid is in none or in two of them, or if they hold a place that the grid has not."""
    if odd := uncovered(tiles, points).orderBy("y", "x").limit(1).collect():
        raise CoverError(f"the tiles do not hold each place once: ({odd[0].y}, {odd[0].x}) is missing {odd[0].n_missing} times and extra {odd[0].n_extra} times")
    return tiles


def outstanding(tiles: DataFrame, done: DataFrame) -> DataFrame:
    """Tiles without a completion row."""
    return tiles.join(done.select("ty", "tx"), ["ty", "tx"], "left_anti")
