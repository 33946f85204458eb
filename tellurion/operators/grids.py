"""Tiles and grids: addresses, neighbours, blending, alignment of several layers, drainage from terrain, gap filling; and functions of the user's own."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .focal import FOUR, higher_neighbours, window_sums
from .zonal import with_totals

CELL = ["row", "col"]


def tile_of(x: Column, y: Column, west: float, north: float, resolution: float, size: int) -> Column:
    """(tile_row, tile_col) of the tile of size by size cells that a point falls into; rows go south."""
    at = lambda d: F.floor(F.floor(d / resolution) / size).cast("int")
    return F.struct(at(north - y).alias("tile_row"), at(x - west).alias("tile_col"))


def tile_neighbours(tiles: DataFrame, diagonal: bool = True) -> DataFrame:
    """(tile_row, tile_col, next_row, next_col) of the tiles beside each that are there."""
    offsets = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a, b) != (0, 0)] if diagonal else FOUR
    step = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in offsets]))
    asked = tiles.select("tile_row", "tile_col", step.alias("s")).select("tile_row", "tile_col", (F.col("tile_row") + F.col("s.a")).alias("next_row"), (F.col("tile_col") + F.col("s.b")).alias("next_col"))
    return asked.join(tiles.select(F.col("tile_row").alias("next_row"), F.col("tile_col").alias("next_col")), ["next_row", "next_col"], "left_semi")


def overview_factors(width: Column, height: Column, least: int = 256) -> Column:
    """Powers of two by which the shorter side has least cells still."""
    return F.filter(F.transform(F.sequence(F.lit(1), F.lit(30)), lambda i: F.pow(F.lit(2), i).cast("int")), lambda f: F.floor(F.least(width, height) / f) >= least)


def ramp(place: Column, size: int, overlap: int, mode: str = "linear") -> Column:
    """A weight of 0 to 1 over a tile's size cells: rising over the first overlap cells and falling over the last; mode none, linear or feather (a cosine)."""
    if mode == "none" or overlap < 2:
        return F.lit(1.0)
    w = F.least(F.lit(1.0), place / (overlap - 1), (size - 1 - place) / (overlap - 1))
    if mode == "linear":
        return w
    if mode == "feather":
        return (1 - F.cos(w * math.pi)) / 2
    raise ValueError(f"blending {mode!r} isn't supported")


def bell(row: Column, col: Column, size: int) -> Column:
    """exp(-(x² + y²) / 0.5) over a tile's [-1, 1]²: the weight of predictions of overlapping tiles."""
    at = lambda c: 2 * c / (size - 1) - 1
    return F.exp(-(at(row) * at(row) + at(col) * at(col)) / 0.5)


def predict_tiles(tiled: DataFrame, model: Callable, schema: str, value: str, size: int, overlap: int) -> DataFrame:
    """value of each cell: the mean, weighted by bell, of what model gives in the tiles that the cell is in.

    model takes a pandas frame of a tile's cells, halo included, and returns one with row, col and value; a tile bounds the memory of a call.
    """

    def run(cells):
        out = model(cells)
        out["tile_row"], out["tile_col"] = cells["tile_row"].iloc[0], cells["tile_col"].iloc[0]
        return out

    got = tiled.groupBy("tile_row", "tile_col").applyInPandas(run, f"{schema}, tile_row int, tile_col int")
    own = lambda c, t: F.col(c) - (F.col(t) * size - overlap)
    w = bell(own("row", "tile_row"), own("col", "tile_col"), size + 2 * overlap)
    return got.withColumn("w_", w).groupBy(*CELL).agg((F.sum(F.col("w_") * F.col(value)) / F.sum("w_")).alias(value))


def array_function(f: Callable, kind: str = "double"):
    """A vectorised function of a column of arrays, a tile's values each, from one over an array: whole batches cross to Python at once."""
    import pandas as pd
    from pyspark.sql.functions import pandas_udf

    def run(tiles):
        return tiles.map(lambda x: None if x is None else f(x))

    run.__annotations__ = {"tiles": pd.Series, "return": pd.Series}
    return pandas_udf(run, kind)


def composed(f: Callable, before: Callable | None = None, after: Callable | None = None) -> Callable:
    """One function of a tile from a step before, the algorithm and a step after."""
    return lambda x: reduce(lambda v, g: g(v), [g for g in (before, f, after) if g], x)


class Registry:
    """Algorithms and rules by name: functions of a DataFrame, or columns."""

    def __init__(self):
        self._known: dict[str, tuple[object, dict]] = {}

    def register(self, name: str, thing, **about) -> None:
        if name in self._known:
            raise ValueError(f"{name!r} is registered already")
        self._known[name] = (thing, about)

    def get(self, name: str):
        return self._known[name][0]

    def names(self, **about) -> list[str]:
        return sorted(n for n, (_, a) in self._known.items() if all(a.get(k) == v for k, v in about.items()))

    def failures(self, df: DataFrame) -> DataFrame:
        """df with failed: the names of the registered rules (boolean columns) that a row breaks; a rule that is NULL is broken."""
        return df.withColumn("failed", F.array_compact(F.array(*[F.when(~F.coalesce(rule, F.lit(False)), n) for n, (rule, _) in sorted(self._known.items())])) if self._known else F.array().cast("array<string>"))


def chain(df: DataFrame, steps: list[Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """Corrections one after another: terrain, atmosphere, normalisation."""
    return reduce(lambda d, f: f(d), steps, df)


def shapes_differ(layers: dict[str, DataFrame]) -> DataFrame:
    """(layer, missing): cells of any layer that another lacks, by name; no row where all have the same cells."""
    names = sorted(layers)
    every = reduce(DataFrame.unionByName, [layers[n].select(*CELL, F.lit(n).alias("layer")) for n in names]).distinct()
    whole = every.groupBy(*CELL).agg(F.collect_set("layer").alias("have"))  # a few names a cell
    lacking = whole.select(F.explode(F.array_except(F.array(*map(F.lit, names)), "have")).alias("layer"))
    return lacking.groupBy("layer").agg(F.count("*").alias("missing"))


# ---------------------------------------------------------------- terrain and gaps


def fill_depressions(px: DataFrame, elev: str) -> DataFrame:
    """filled: the lesser of a cell's height and the highest of its 3 by 3 cells in a seed that has the raster's border and is without bound inside."""
    out = with_totals(px, top_=F.min("row"), bottom_=F.max("row"), left_=F.min("col"), right_=F.max("col"))
    border = (F.col("row") == F.col("top_")) | (F.col("row") == F.col("bottom_")) | (F.col("col") == F.col("left_")) | (F.col("col") == F.col("right_"))
    seed = F.when(border, F.col(elev)).otherwise(F.lit(float("inf")))
    return window_sums(out, {"max_seed": seed}, 3).withColumn("filled", F.least(F.col(elev).cast("double"), "max_seed")).drop("top_", "bottom_", "left_", "right_", "max_seed")


def drainage(px: DataFrame, elev: str, share: float = 0.95) -> DataFrame:
    """accumulation (1 and the higher of the eight neighbours) of the filled heights, and channel: cells at or above that share's percentile."""
    out = higher_neighbours(fill_depressions(px, elev), "filled")
    out = with_totals(out, cut_=F.percentile("accumulation", share))
    return out.withColumn("channel", F.col("accumulation") >= F.col("cut_")).drop("cut_")


def fill_nearest(px: DataFrame, value: str) -> DataFrame:
    """filled: a NULL cell has the value of the nearest cell with one (the lowest of equally near ones), however far."""
    from .composite import nearest

    known = px.where(F.col(value).isNotNull()).select(*CELL, F.col(value).cast("double").alias("v_"))
    gaps = px.where(F.col(value).isNull()).select(*CELL)
    got = nearest(gaps, known, "v_")
    return px.join(got.select(*CELL, F.col("n_.e").alias("near_")), CELL, "left").withColumn("filled", F.coalesce(F.col(value), "near_")).drop("near_")


def above_percentile(px: DataFrame, value: str, share: float = 0.95) -> DataFrame:
    """Hot spots: cells above a percentile of the whole raster."""
    return with_totals(px, cut_=F.percentile(value, share)).where(F.col(value) > F.col("cut_")).drop("cut_")


def residual(px: DataFrame, value: str, reference: str, k: int) -> DataFrame:
    """residual: the mean of abs(value - reference) over the k by k cells about each."""
    d = F.abs(F.col(value) - F.col(reference))
    out = window_sums(px, {"n_": F.when(d.isNotNull(), 1).otherwise(0), "s_": d}, k)
    return out.withColumn("residual", F.when(F.col("n_") > 0, F.col("s_") / F.col("n_"))).drop("n_", "s_")


def boundary_z(px: DataFrame, gradient: str, size: int) -> DataFrame:
    """One row: how many deviations steeper rows at tiles' boundaries are than all the others."""
    edge = (F.col("row") % size == 0) & (F.col("row") > 0)
    m = px.agg(F.avg(F.when(edge, F.col(gradient))).alias("on"), F.avg(F.when(~edge, F.col(gradient))).alias("off"), F.stddev_pop(F.when(~edge, F.col(gradient))).alias("sd_"))
    return m.select("on", "off", ((F.col("on") - F.col("off")) / F.when(F.col("sd_") >= 1e-10, F.col("sd_")).otherwise(1.0)).alias("z"))


def bounds_issues(boxes: DataFrame) -> DataFrame:
    """boxes with issue: out_of_range, empty, or whole_earth; NULL where there is none."""
    out = (F.col("west") < -180) | (F.col("east") > 180) | (F.col("south") < -90) | (F.col("north") > 90)
    empty = (F.col("west") >= F.col("east")) | (F.col("south") >= F.col("north"))
    return boxes.withColumn("issue", F.when(out, "out_of_range").when(empty, "empty").when((F.col("east") - F.col("west") >= 360) & (F.col("north") - F.col("south") >= 180), "whole_earth"))


def web_mercator(lon: Column, lat: Column) -> Column:
    """(x, y) in metres."""
    r = 6378137.0  # fixed value: the sphere's radius
    return F.struct((F.radians(lon) * r).alias("x"), (F.log(F.tan(F.lit(math.pi / 4) + F.radians(lat) / 2)) * r).alias("y"))


def from_web_mercator(x: Column, y: Column) -> Column:
    r = 6378137.0
    return F.struct(F.degrees(x / r).alias("lon"), F.degrees(2 * F.atan(F.exp(y / r)) - math.pi / 2).alias("lat"))


def reprojected(px: DataFrame, value: str, west: float, north: float, degrees_: float, metres: float) -> DataFrame:
    """A raster of degrees on a grid of Web Mercator metres with the same corner: each new cell takes the nearest old one; several old ones, the last."""
    lon, lat = F.lit(west) + (F.col("col") + 0.5) * degrees_, F.lit(north) - (F.col("row") + 0.5) * degrees_
    corner = web_mercator(F.lit(west), F.lit(north))
    at = px.withColumn("m_", web_mercator(lon, lat)).withColumn("k_", corner)
    at = at.select(F.floor((F.col("k_.y") - F.col("m_.y")) / metres).cast("int").alias("new_row"), F.floor((F.col("m_.x") - F.col("k_.x")) / metres).cast("int").alias("new_col"), F.struct("row", "col", F.col(value).alias("v")).alias("s_"))
    return at.groupBy(F.col("new_row").alias("row"), F.col("new_col").alias("col")).agg(F.max("s_").alias("s_")).select(*CELL, F.col("s_.v").alias(value))


def on_one_grid(layers: dict[str, tuple[DataFrame, str, int]]) -> DataFrame:
    """(layer, row, col, value) of several rasters (frame, value column, factor) averaged by their factors onto one grid."""
    cell = lambda c, f: F.floor(F.col(c) / f).cast("int").alias(c)
    return reduce(DataFrame.unionByName, [df.groupBy(cell("row", f), cell("col", f)).agg(F.avg(v).alias("value")).select(F.lit(n).alias("layer"), *CELL, "value") for n, (df, v, f) in layers.items()])


def scenario(members: DataFrame, keys: list[str], member: str, value: str, kind: str, share: float = 0.9, which: int = 0) -> DataFrame:
    """value of each key: the largest, smallest or percentile over all members, or one member's."""
    if kind == "member":
        return members.where(F.col(member) == which).select(*keys, F.col(value).alias("scenario"))
    how = {"highest": F.max(value), "lowest": F.min(value), "percentile": F.percentile(value, share)}
    if kind not in how:
        raise ValueError(f"scenario {kind!r} isn't supported")
    return members.groupBy(*keys).agg(how[kind].alias("scenario"))


def extrapolated(found: DataFrame, quality: Column) -> tuple[Column, Column]:
    """Of an as-of lookup outside its samples, the value of the nearest edge, and half the quality."""
    outside = F.col("before_at").isNull() | F.col("after_at").isNull()
    return F.when(outside, F.coalesce("before_value", "after_value")), F.when(outside, quality * 0.5).otherwise(quality)


def impact_model(thresholds: list[tuple[float, str]], lowest: str = "none") -> Callable[[Column], Column]:
    """A user's impact model: the name of the highest threshold that a value reaches."""

    def run(value: Column) -> Column:
        out = F.when(value.isNull(), None)
        for least, name in sorted(thresholds, reverse=True):
            out = out.when(value >= least, F.lit(name))
        return out.otherwise(F.lit(lowest))

    return run


# fixed values: what providers call a variable, the common name, and the factor and offset to its unit
VARIABLES = {"tp": ("precipitation_mm", 1000.0, 0.0), "t2m": ("temperature_c", 1.0, -273.15), "APCP": ("precipitation_mm", 1.0, 0.0), "TMP": ("temperature_c", 1.0, -273.15), "u10": ("wind_u_ms", 1.0, 0.0), "GUST": ("gust_ms", 1.0, 0.0)}


def normalised(name: Column, value: Column) -> Column:
    """(variable, value) of a provider's variable in the common name and unit; others stay as they are."""
    pick = lambda i, other: F.coalesce(reduce(lambda c, kv: c.when(name == kv[0], F.lit(kv[1][i])), VARIABLES.items(), F.when(F.lit(False), None)), other)
    return F.struct(pick(0, name).alias("variable"), (value * pick(1, F.lit(1.0)) + pick(2, F.lit(0.0))).alias("value"))
