"""Detectors and checks made of several others: the burned-area classifier, drainage, surfaces of uncertainty, tile functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tellurion.sources.shared import stash

from .focal import EIGHT, neighbours, window_sums
from .timeline import around
from .zonal import with_totals

CELL = ["row", "col"]


def burned_classes(px: DataFrame, features: list[str], label: Column, positive: float = 0.5) -> DataFrame:
    """probability and burned of each cell by a distance classifier trained on the cells whose label is 1 or 0.

    Each class has a mean and a spread (plus 1e-6) of every feature; a feature's weight is how far apart the means are in spreads, made to sum to 1. The
    probability is 1 - d1 / (d1 + d0 + 1e-6) of the weighted distances. Cells with a NULL feature have NULL.
    """
    marked = px.withColumn("label_", label)
    aggs = {}
    for f in features:
        for c in (0, 1):
            v = F.when(F.col("label_") == c, F.col(f))
            aggs[f"m{c}_{f}"], aggs[f"s{c}_{f}"] = F.avg(v), F.stddev_pop(v) + 1e-6
    out = with_totals(marked, **aggs)
    weights = {f: F.abs(F.col(f"m1_{f}") - F.col(f"m0_{f}")) / (F.col(f"s1_{f}") + F.col(f"s0_{f}")) for f in features}
    total = sum(weights.values(), F.lit(0.0))
    d = {c: F.sqrt(sum((weights[f] / total * F.pow((F.col(f) - F.col(f"m{c}_{f}")) / F.col(f"s{c}_{f}"), 2) for f in features), F.lit(0.0))) for c in (0, 1)}
    out = out.withColumn("probability", 1 - d[1] / (d[1] + d[0] + 1e-6))
    return out.withColumn("burned", F.coalesce(F.col("probability") >= positive, F.lit(False))).drop("label_", *aggs)


def nearest(asked: DataFrame, known: DataFrame, value: str) -> DataFrame:
    """asked's cells with n_: (squared distance d, value e) of the nearest known cell, however far, of equally near ones the least e; NULL if there is none.

    A distance transform in two passes: along each row the nearest known cell on either side, by running lasts; then along each column the least sum of
    squares. The second pass widens ring by ring, and only for cells that a further row might still improve, so near cells cost few rounds.
    """
    cells = asked.select(*CELL).unionByName(known.select(*CELL))
    edge = cells.agg(F.min("col").alias("lo_"), F.max("col").alias("hi_"))
    told = known.select(*CELL, F.struct(F.col("col").alias("c"), F.col(value).alias("e")).alias("s_"))
    whole = told.select("row").distinct().crossJoin(F.broadcast(edge)).select("row", F.explode(F.sequence("lo_", "hi_")).alias("col"))  # cells that aren't there pass on too
    sides = around(whole.join(told, CELL, "left"), ["row"], "s_", "col", 512.0)
    best = F.array_min(F.filter(F.array(*[F.struct(F.pow(F.col("col") - F.col(f"{x}.c"), 2).alias("d"), F.col(f"{x}.e").alias("e")) for x in ("before_", "after_")]), lambda x: x["d"].isNotNull()))
    own = stash(sides.select(*CELL, best.alias("own")))  # of each cell of a row with known cells, the nearest of its row
    done, lo, width = asked.select(*CELL).join(own, CELL, "left").withColumnRenamed("own", "n_"), 1, 2
    if own.isEmpty():
        return done
    span = cells.agg(F.max("row") - F.min("row")).first()[0]
    while lo <= span:
        hi = min(span, lo + width - 1)
        reach = F.array(*[F.lit(k) for k in range(lo, hi + 1)])
        open_ = done.where(F.col("n_").isNull() | (F.col("n_.d") >= float(lo * lo)))  # a row lo away may be as near
        if open_.isEmpty():
            break
        asks = open_.select("row", "col", F.explode(F.array_union(reach, F.transform(reach, lambda k: -k))).alias("k"))
        asks = asks.select("row", "col", (F.col("row") + F.col("k")).alias("other"), F.pow("k", 2).alias("k2"))
        met = asks.join(own.select(F.col("row").alias("other"), "col", "own"), ["other", "col"])
        nearer = met.groupBy("row", "col").agg(F.min(F.struct((F.col("own.d") + F.col("k2")).alias("d"), F.col("own.e").alias("e"))).alias("m_"))
        done = done.join(nearer, CELL, "left").select(*CELL, F.when(F.col("m_").isNull() | (F.col("n_") <= F.col("m_")), F.col("n_")).otherwise(F.col("m_")).alias("n_"))
        done, lo, width = stash(done), hi + 1, min(64, 2 * width)
    return done


def height_above_drainage(px: DataFrame, elev: str, is_drainage: Column) -> DataFrame:
    """hand: how far a cell is above the nearest drainage cell, however far that is, not under 0; of equally near ones, the lowest. NULL if there is none."""
    near = nearest(px, px.where(is_drainage).select(*CELL, F.col(elev).cast("double").alias("e_")), "e_")
    return px.join(near, CELL, "left").withColumn("hand", F.when(F.col("n_").isNotNull(), F.greatest(F.lit(0.0), F.col(elev) - F.col("n_.e")))).drop("n_")


def zones(px: DataFrame, value: str, n: int) -> DataFrame:
    """zone (0 to n - 1, by quantiles, [lo, hi)), with n, mean, std, min and max."""
    out = with_totals(px.where(F.col(value).isNotNull()), q_=F.percentile(value, F.array(*[F.lit(i / n) for i in range(1, n)])))
    z = F.size(F.filter("q_", lambda q: q <= F.col(value)))
    return out.groupBy(z.alias("zone")).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.min(value).alias("min"), F.max(value).alias("max"))


def lag_autocorrelation(px: DataFrame, value: str, lag: int = 1) -> DataFrame:
    """One row: the mean of the autocorrelations along rows and along columns."""
    t = px.agg(F.avg(value).alias("mu_"), F.var_pop(value).alias("var_"))
    p = neighbours(px, value, [(0, lag), (lag, 0)]).crossJoin(F.broadcast(t))
    product = (F.col(value) - F.col("mu_")) * (F.col("other") - F.col("mu_"))
    one = lambda cond: F.avg(F.when(cond, product)) / F.max("var_")
    return p.agg(((one(F.col("d_row") == 0) + one(F.col("d_col") == 0)) / 2).alias("autocorrelation"))


def sobel(px: DataFrame, value: str) -> DataFrame:
    """gradient: Sobel's magnitude, of cells that have all eight neighbours."""
    wx = F.col("d_col") * F.when(F.col("d_row") == 0, 2).otherwise(1)
    wy = F.col("d_row") * F.when(F.col("d_col") == 0, 2).otherwise(1)
    n = neighbours(px, value, EIGHT).groupBy(*CELL).agg(F.count("*").alias("n_"), F.sum(wx * F.col("other")).alias("gx"), F.sum(wy * F.col("other")).alias("gy")).where("n_ = 8")
    return px.join(n, CELL).withColumn("gradient", F.sqrt(F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy"))).drop("n_", "gx", "gy")


def gradient_noise(px: DataFrame, value: str) -> DataFrame:
    """One row: 1.4826 times the median absolute deviation of differences along rows."""
    d = neighbours(px, value, [(0, 1)]).select((F.col("other") - F.col(value)).alias("d"))
    return with_totals(d, m_=F.median("d")).agg((1.4826 * F.median(F.abs(F.col("d") - F.col("m_")))).alias("noise"))


def seams(px: DataFrame, value: str, size: int) -> DataFrame:
    """One row: mean gradient across the edges of tiles of size columns and elsewhere, and how much greater it is at the edges."""
    d = neighbours(px, value, [(0, 1)]).withColumn("g", F.abs(F.col("other") - F.col(value))).withColumn("edge", (F.col("col") + 1) % size == 0)
    s = d.agg(F.avg(F.when(F.col("edge"), F.col("g"))).alias("on"), F.avg(F.when(~F.col("edge"), F.col("g"))).alias("off"))
    return s.select("on", "off", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("on") / F.when(F.col("off") > 0, F.col("off")) - 1)).alias("score"))


def smoothed(px: DataFrame, value: str, k: int) -> DataFrame:
    """smooth: the mean of the k by k cells about each."""
    return window_sums(px, {"n_": F.when(F.col(value).isNotNull(), 1).otherwise(0), "s_": F.col(value)}, k).withColumn("smooth", F.when(F.col("n_") > 0, F.col("s_") / F.col("n_"))).drop("n_", "s_")


def apply_to_tiles(tiled: DataFrame, f: Callable, schema: StructType | str) -> DataFrame:
    """f, from a pandas frame of a tile's cells (halo and core) to one, on each tile: for algorithms that no expression has. A tile bounds the memory of a call."""
    return tiled.groupBy("tile_row", "tile_col").applyInPandas(f, schema)


def gap_fillers(primary: DataFrame, fillers: DataFrame, keys: list[str], most: float, at: str = "hours") -> DataFrame:
    """Fillers strictly inside the primary series' gaps of over most hours: both series' instants run as one, each filler between its neighbours."""
    both = primary.select(*keys, at, F.lit(None).cast("long").alias("filler"), F.col(at).alias("p_")).unionByName(fillers.select(*keys, at, F.col("id").cast("long").alias("filler"), F.lit(None).cast("double").alias("p_")))
    both = around(both, keys, "p_", at)
    return both.where(F.col("filler").isNotNull() & (F.col("after_") - F.col("before_") > most) & (F.col(at) > F.col("before_")) & (F.col(at) < F.col("after_"))).select(*keys, F.col("filler").alias("id"), at)


def tagged(products: DataFrame, tags: list[str], every: bool) -> DataFrame:
    """Products (tags array) with every one of tags, or with any."""
    wanted = F.array(*[F.lit(t) for t in tags])
    return products.where(F.size(F.array_except(wanted, "tags")) == 0 if every else F.arrays_overlap("tags", wanted))


def return_period(z: Column, per_year: float, cdf: Callable[[Column], Column]) -> Column:
    """Years between values as extreme under a normal distribution, 10,000 at most."""
    p = 1 - cdf(F.abs(z))
    return F.when(p > 0, F.least(F.lit(10_000.0), 1 / (p * per_year))).otherwise(10_000.0)
