"""Neighbourhoods, components, tiles and pyramids of pixel tables.

A window of k by k cells is two passes of k neighbours, rows then columns, wherever its statistic is separable (sums, extremes): k + k copies of a cell, not
k * k. Each pass is an explode and a partial aggregate on the cell, so no task holds a raster.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import components
from .zonal import with_totals


def _extent(px: DataFrame) -> DataFrame:
    return px.agg(F.max("row").alias("max_row_"), F.max("col").alias("max_col_"))


def _reflect(i: Column, most: Column, pad: str) -> Column:
    """Where a cell's copy lands: also on the cells whose window reaches it by reflection. mirror repeats no edge cell, symmetric does."""
    if pad == "none":
        return F.array(i)
    if pad == "mirror":
        return F.array_distinct(F.array(i, -i, 2 * most - i))
    if pad == "symmetric":
        return F.array(i, -i - 1, 2 * most + 1 - i)
    raise ValueError(f"padding {pad!r} isn't supported")


def window_sums(px: DataFrame, values: dict[str, Column], k: int, pad: str = "none") -> DataFrame:
    """px's cells with the sums of values (and extremes, for names that begin with min_ or max_) over k by k cells about each; NULL counts as absent."""
    h = k // 2
    how = {n: (F.min if n.startswith("min_") else F.max if n.startswith("max_") else F.sum) for n in values}
    out = px.select("row", "col", *[v.alias(n) for n, v in values.items()])
    for axis, other, most in (("row", "col", "max_row_"), ("col", "row", "max_col_")):
        places = F.array(F.col(axis))
        if pad != "none":
            out = out.crossJoin(F.broadcast(_extent(px)))
            places = F.array_sort(_reflect(F.col(axis), F.col(most), pad))
        reach = F.flatten(F.transform(places, lambda p: F.transform(F.sequence(p - h, p + h), lambda x: x.cast("int"))))
        out = out.withColumn("at_", F.explode(reach)).groupBy(F.col("at_").alias(axis), other).agg(*[how[n](n).alias(n) for n in values])
    return px.join(out, ["row", "col"], "left")


def local_statistics(px: DataFrame, value: str, k: int, pad: str = "mirror") -> DataFrame:
    """n_, mean_, var_ (population, not under 0), low_ and high_ of the valid cells of each window."""
    v = F.col(value)
    out = window_sums(px, {"n_": F.when(v.isNotNull(), 1).otherwise(0), "s1_": v, "s2_": v * v, "min_v": v, "max_v": v}, k, pad)
    mean = F.when(F.col("n_") > 0, F.col("s1_") / F.col("n_"))
    out = out.withColumn("mean_", mean).withColumn("var_", F.greatest(F.lit(0.0), F.when(F.col("n_") > 0, F.col("s2_") / F.col("n_")) - F.col("mean_") * F.col("mean_")))
    return out.withColumnRenamed("min_v", "low_").withColumnRenamed("max_v", "high_").drop("s1_", "s2_")


def contextual_fires(px: DataFrame, kelvin: str, k: int = 21, threshold: float = 320.0, least_delta: float = 10.0, sigmas: float = 3.0, least: int = 3) -> DataFrame:
    """fire: hot, and hotter than its background, the valid cells of its window that aren't nearly hot, the cell itself left out."""
    t = F.col(kelvin)
    cool = F.when(t < threshold - 10, t)
    out = window_sums(px.withColumn("cool_", cool), {"n_": F.when(cool.isNotNull(), 1).otherwise(0), "s1_": cool, "s2_": cool * cool}, k)
    own = F.when(F.col("cool_").isNotNull(), 1).otherwise(0)
    n = F.col("n_") - own
    s1, s2 = F.coalesce("s1_", F.lit(0.0)) - F.coalesce("cool_", F.lit(0.0)), F.coalesce("s2_", F.lit(0.0)) - F.coalesce(F.col("cool_") * F.col("cool_"), F.lit(0.0))
    mean = F.when(n >= least, s1 / n)
    std = F.when(n >= least, F.sqrt(F.greatest(F.lit(0.0), s2 / n - (s1 / n) * (s1 / n))))
    out = out.withColumn("background", mean).withColumn("spread", std)
    d = t - F.col("background")
    return out.withColumn("fire", F.coalesce((t > threshold) & (d > least_delta) & (d > sigmas * F.col("spread")), F.lit(False))).drop("cool_", "n_", "s1_", "s2_")


def neighbours(px: DataFrame, value: str, offsets: list[tuple[int, int]]) -> DataFrame:
    """A row for each cell and neighbour that is there: row, col, value, d_row, d_col, other."""
    shifts = F.array(*[F.struct(F.lit(a).alias("d_row"), F.lit(b).alias("d_col")) for a, b in offsets])
    sent = px.select("row", "col", F.col(value).alias("other"), F.explode(shifts).alias("s")).select((F.col("row") - F.col("s.d_row")).alias("row"), (F.col("col") - F.col("s.d_col")).alias("col"), "s.d_row", "s.d_col", "other")
    return px.select("row", "col", value).join(sent.hint("merge"), ["row", "col"])  # Spark takes sent for as small as px, and would broadcast all of it


EIGHT = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a, b) != (0, 0)]
FOUR = [(-1, 0), (1, 0), (0, -1), (0, 1)]


def higher_neighbours(px: DataFrame, elev: str = "elev") -> DataFrame:
    """accumulation: 1 and the number of higher cells about each."""
    n = neighbours(px, elev, EIGHT).where(F.col("other") > F.col(elev)).groupBy("row", "col").agg(F.count("*").alias("h"))
    return px.join(n, ["row", "col"], "left").withColumn("accumulation", 1 + F.coalesce("h", F.lit(0))).drop("h")


def slope_aspect(px: DataFrame, elev: str = "elev", cell_m: float = 30.0) -> DataFrame:
    """slope and aspect in radians by central differences; NULL at the edges."""
    n = neighbours(px, elev, FOUR).groupBy("row", "col").agg(*[F.max(F.when((F.col("d_row") == a) & (F.col("d_col") == b), F.col("other"))).alias(name) for name, (a, b) in {"n": (-1, 0), "s": (1, 0), "w": (0, -1), "e": (0, 1)}.items()])
    dx, dy = (F.col("e") - F.col("w")) / (2 * cell_m), (F.col("s") - F.col("n")) / (2 * cell_m)
    return px.join(n, ["row", "col"]).withColumn("slope", F.atan(F.sqrt(dx * dx + dy * dy))).withColumn("aspect", F.atan2((F.col("w") - F.col("e")) / (2 * cell_m), dy)).drop("n", "s", "w", "e")


def morans_i(px: DataFrame, value: str) -> DataFrame:
    """One row: n, weight and Moran's I with weights of 1 over distance to the eight neighbours."""
    out = with_totals(px.where(F.col(value).isNotNull()), mu_=F.avg(value), ss_=F.sum(F.lit(0.0)), n_=F.count("*"), var_=F.var_pop(value))
    out = out.withColumn("dev_", F.col(value) - F.col("mu_"))
    pairs = neighbours(out, "dev_", EIGHT)
    w = F.when((F.col("d_row") == 0) | (F.col("d_col") == 0), 1.0).otherwise(1 / F.sqrt(F.lit(2.0)))
    s = pairs.agg(F.sum(w * F.col("dev_") * F.col("other")).alias("num"), F.sum(w).alias("weight"))
    total = out.agg(F.count("*").alias("n"), F.var_pop(value).alias("v"))
    return s.crossJoin(F.broadcast(total)).select("n", "weight", F.when(F.col("v") > 0, F.col("num") / F.col("weight") / F.col("v")).alias("morans_i"))


def hot_spots(px: DataFrame, value: str, k: int = 5, critical: float = 1.96) -> DataFrame:
    """gi and hot by Getis and Ord's statistic with weights of 1 in a k by k window; cells beyond the edge are 0."""
    out = window_sums(px, {"s_": F.col(value)}, k)
    out = with_totals(out, mu_=F.avg(value), sd_=F.stddev_pop(value), n_=F.count(value))
    w = float(k * k)
    gi = (F.col("s_") - w * F.col("mu_")) / (F.col("sd_") * F.sqrt((F.col("n_") * w - w * w) / (F.col("n_") - 1)))
    return out.withColumn("gi", F.when(F.col("sd_") > 0, gi)).withColumn("hot", F.coalesce(F.col("gi") > critical, F.lit(False))).drop("s_", "mu_", "sd_", "n_")


def isolated(px: DataFrame, flag: Column) -> DataFrame:
    """Flagged cells none of whose eight neighbours is flagged."""
    hit = px.where(flag).select("row", "col", F.lit(1).alias("v"))
    return hit.join(neighbours(hit, "v", EIGHT).select("row", "col"), ["row", "col"], "left_anti").select("row", "col")


def regions(px: DataFrame, flag: Column, width: int, diagonal: bool = False) -> DataFrame:
    """row, col, region (row * width + col of its first cell) of the flagged cells joined edge to edge."""
    hit = px.where(flag).select("row", "col", F.lit(1).alias("v"))
    cell = lambda r, c: r.cast("long") * width + c
    n = neighbours(hit, "v", [(0, 1), (1, 0)] + ([(1, 1), (1, -1)] if diagonal else []))
    edges = n.select(cell(F.col("row"), F.col("col")).alias("u"), cell(F.col("row") + F.col("d_row"), F.col("col") + F.col("d_col")).alias("v"))
    found = components(edges)
    own = cell(F.col("row"), F.col("col"))
    return hit.withColumn("node", own).join(found, "node", "left").select("row", "col", F.coalesce("component", "node").alias("region"))


def sieve(labelled: DataFrame, least: int) -> DataFrame:
    """The cells of regions of at least so many."""
    return labelled.join(labelled.groupBy("region").agg(F.count("*").alias("n_")).where(F.col("n_") >= least).select("region"), "region")


def polygons(labelled: DataFrame) -> DataFrame:
    """A feature for each region: cells, bounds, centroid and the bounds as WKT."""
    g = labelled.groupBy("region").agg(F.count("*").alias("cells"), F.min("row").alias("r0"), F.max("row").alias("r1"), F.min("col").alias("c0"), F.max("col").alias("c1"), F.avg("row").alias("row"), F.avg("col").alias("col"))
    ring = F.format_string("POLYGON((%d %d, %d %d, %d %d, %d %d, %d %d))", "c0", "r0", F.col("c1") + 1, "r0", F.col("c1") + 1, F.col("r1") + 1, "c0", F.col("r1") + 1, "c0", "r0")
    return g.withColumn("wkt", ring)


def fill_idw(px: DataFrame, value: str, reach: int = 2, power: float = 2.0) -> DataFrame:
    """filled: NULL cells get the inverse-distance mean of the valid cells within reach rows and columns."""
    offsets = [(a, b) for a in range(-reach, reach + 1) for b in range(-reach, reach + 1) if (a, b) != (0, 0)]
    gaps = px.where(F.col(value).isNull()).select("row", "col")
    known = px.where(F.col(value).isNotNull())
    shifts = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit((a * a + b * b) ** (-power / 2)).alias("w")) for a, b in offsets])
    asked = gaps.select("row", "col", F.explode(shifts).alias("s")).select(F.col("row").alias("r0"), F.col("col").alias("c0"), (F.col("row") + F.col("s.a")).alias("row"), (F.col("col") + F.col("s.b")).alias("col"), "s.w")
    got = asked.join(known.select("row", "col", F.col(value).alias("v")), ["row", "col"]).groupBy(F.col("r0").alias("row"), F.col("c0").alias("col")).agg((F.sum(F.col("w") * F.col("v")) / F.sum("w")).alias("v_"))
    return px.join(got, ["row", "col"], "left").withColumn("filled", F.coalesce(value, "v_")).drop("v_")


# ---------------------------------------------------------------- tiles


def tiles(width: int, height: int, size: int, overlap: int, spark) -> DataFrame:
    """tile_id, tile_row, tile_col and the bounds of a grid of tiles with overlap."""
    n_cols, n_rows = -(-width // size), -(-height // size)
    t = spark.range(n_cols * n_rows).select(F.col("id").alias("tile_id"), F.floor(F.col("id") / n_cols).cast("int").alias("tile_row"), (F.col("id") % n_cols).cast("int").alias("tile_col"))
    clamp = lambda c, most: F.greatest(F.lit(0), F.least(F.lit(most), c)).cast("int")
    return t.select("*", clamp(F.col("tile_row") * size - overlap, height).alias("row_start"), clamp((F.col("tile_row") + 1) * size + overlap, height).alias("row_end"), clamp(F.col("tile_col") * size - overlap, width).alias("col_start"), clamp((F.col("tile_col") + 1) * size + overlap, width).alias("col_end"))


def to_tiles(px: DataFrame, size: int, overlap: int = 0) -> DataFrame:
    """Cells with the tile they belong to, and, with overlap, those whose halo they're in; core tells which."""
    if not overlap:
        return px.withColumn("tile_row", F.floor(F.col("row") / size).cast("int")).withColumn("tile_col", F.floor(F.col("col") / size).cast("int")).withColumn("core", F.lit(True))
    span = lambda c: F.sequence(F.floor((F.col(c) - overlap) / size), F.floor((F.col(c) + overlap) / size))
    out = px.withColumn("tile_row", F.explode(span("row"))).withColumn("tile_col", F.explode(span("col")))
    out = out.withColumn("core", (F.floor(F.col("row") / size) == F.col("tile_row")) & (F.floor(F.col("col") / size) == F.col("tile_col")))
    return out.where("tile_row >= 0 and tile_col >= 0").withColumn("tile_row", F.col("tile_row").cast("int")).withColumn("tile_col", F.col("tile_col").cast("int"))


def stitch(tiled: DataFrame, value: str, method: str, size: int, overlap: int) -> DataFrame:
    """One value a cell of overlapping tiles: replace (the core's), average, max, min, or feather (weights fall to the tile's edge)."""
    if method == "replace":
        return tiled.where("core").select("row", "col", value)
    if method in ("average", "max", "min"):
        f = {"average": F.avg, "max": F.max, "min": F.min}[method]
        return tiled.groupBy("row", "col").agg(f(value).alias(value))
    if method == "feather":
        edge = lambda c, t: F.least(F.col(c) - (F.col(t) * size - overlap) + 1, (F.col(t) + 1) * size + overlap - F.col(c))
        w = F.least(edge("row", "tile_row"), edge("col", "tile_col"), F.lit(2 * overlap + 1)).cast("double")
        return tiled.withColumn("w_", w).groupBy("row", "col").agg((F.sum(F.col("w_") * F.col(value)) / F.sum("w_")).alias(value))
    raise ValueError(f"stitching {method!r} isn't supported")


def downsample(px: DataFrame, value: str, factor: int, method: str = "average") -> DataFrame:
    """Blocks of factor by factor cells made one: average, min, max, nearest (the block's centre) or mode (ties to the smallest)."""
    r, c = F.floor(F.col("row") / factor).cast("int").alias("row"), F.floor(F.col("col") / factor).cast("int").alias("col")
    if method == "nearest":
        h = factor // 2
        return px.where((F.col("row") % factor == h) & (F.col("col") % factor == h)).select(r, c, value)
    if method == "mode":
        n = px.where(F.col(value).isNotNull()).groupBy(r, c, value).agg(F.count("*").alias("n_"))
        return n.groupBy("row", "col").agg(F.max(F.struct("n_", (-F.col(value)).alias("low"), F.col(value).alias("v"))).alias("b")).select("row", "col", F.col("b.v").alias(value))
    f = {"average": F.avg, "min": F.min, "max": F.max}.get(method)
    if f is None:
        raise ValueError(f"resampling {method!r} isn't supported")
    return px.groupBy(r, c).agg(f(value).alias(value))


def upsample(px: DataFrame, factor: int) -> DataFrame:
    """Each cell repeated, nearest."""
    steps = F.sequence(F.lit(0), F.lit(factor - 1))
    return px.withColumn("a_", F.explode(steps)).withColumn("b_", F.explode(steps)).withColumn("row", (F.col("row") * factor + F.col("a_")).cast("int")).withColumn("col", (F.col("col") * factor + F.col("b_")).cast("int")).drop("a_", "b_")


def mosaic(obs: DataFrame, method: str) -> DataFrame:
    """One value a cell of observations (ts, source_id, value, quality): first, last, average, max, min, or best (quality, then the later)."""
    if method in ("average", "max", "min"):
        f = {"average": F.avg, "max": F.max, "min": F.min}[method]
        return obs.groupBy("row", "col").agg(f("value").alias("value"))
    keys = {"first": F.min(F.struct("ts", "source_id", "value")), "last": F.max(F.struct("ts", "source_id", "value")), "best": F.max(F.struct("quality", "ts", "source_id", "value"))}
    if method not in keys:
        raise ValueError(f"mosaic {method!r} isn't supported")
    return obs.where(F.col("value").isNotNull()).groupBy("row", "col").agg(keys[method].alias("b")).select("row", "col", F.col("b.value").alias("value"))
