"""Series in time: bins, resampling, as-of lookups, gaps, runs and checks.

Windows are partitioned by the series' keys, never global. A lookup across two series is one union and running lasts over stretches of the keys' time. Instants are hours as double (column hours) beside the timestamp.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

AGGREGATES = {
    "mean": F.avg, "median": F.median, "min": F.min, "max": F.max, "sum": F.sum, "count": F.count,
}


def hour_bins(df: DataFrame, keys: list[str], hours: float, methods: list[str], value: str = "value", at: str = "hours", start: float = 0.0) -> DataFrame:
    """bin (number from start), centre and the named aggregates of each key's bins of so many hours, [from, to).

    first and last are by time; ties go to the smaller, or larger, value. weighted is by the column quality, or 0 where all weights are 0.
    """
    b = F.floor((F.col(at) - start) / hours).cast("bigint")
    aggs = []
    for m in methods:
        if m == "first":
            aggs.append(F.min(F.struct(at, value))[value].alias(m))
        elif m == "last":
            aggs.append(F.max(F.struct(at, value))[value].alias(m))
        elif m == "weighted":
            aggs.append((F.sum(F.col(value) * F.col("quality")) / F.when(F.sum("quality") == 0, 1.0).otherwise(F.sum("quality"))).alias(m))
        elif m in AGGREGATES:
            aggs.append(AGGREGATES[m](value).alias(m))
        else:
            raise ValueError(f"aggregate {m!r} isn't supported")
    return df.groupBy(*keys, b.alias("bin")).agg(*aggs).withColumn("centre", start + (F.col("bin") + 0.5) * hours)


def calendar_bins(df: DataFrame, keys: list[str], unit: str, value: str = "value", at: str = "ts") -> DataFrame:
    """start of the hour, day, week or month, with mean and n."""
    return df.groupBy(*keys, F.date_trunc(unit, at).cast("timestamp_ntz").alias("start")).agg(F.avg(value).alias("mean"), F.count(value).alias("n"))


#: A series is dealt to tasks by stretches of so many hours.
STRETCH_HOURS = 24.0


def around(rows: DataFrame, keys: list[str], sample: str, at: str = "hours", stretch: float = STRETCH_HOURS) -> DataFrame:
    """rows with before_ and after_: the sample (a column that orders by time, NULL in rows without one) last at or before each row, first at or after it.

    Keys are split into stretches of time, so a key with most of the rows is many groups; frames only grow, one over rising and one over falling time. What
    a row's stretch lacks comes from the stretches around it, of which a window over one row a stretch keeps account.
    """
    cut = rows.withColumn("stretch_", F.floor(F.col(at) / stretch))
    up, down = (Window.partitionBy(*keys, "stretch_").orderBy(o).rangeBetween(Window.unboundedPreceding, Window.currentRow) for o in (F.asc(at), F.desc(at)))
    own = cut.withColumn("before_", F.last(sample, True).over(up)).withColumn("after_", F.last(sample, True).over(down))
    edges = cut.groupBy(*keys, "stretch_").agg(F.min(sample).alias("low_"), F.max(sample).alias("high_"))
    past, future = (Window.partitionBy(*keys).orderBy(o).rowsBetween(Window.unboundedPreceding, -1) for o in (F.asc("stretch_"), F.desc("stretch_")))
    edges = edges.select(*[F.col(k).alias(f"{k}__") for k in keys], F.col("stretch_").alias("stretch__"), F.last("high_", True).over(past).alias("past_"), F.last("low_", True).over(future).alias("future_"))
    same = F.col("stretch_") == F.col("stretch__")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"{k}__"))
    out = own.join(edges, same, "left").withColumn("before_", F.coalesce("before_", "past_")).withColumn("after_", F.coalesce("after_", "future_"))
    return out.drop("stretch_", "stretch__", "past_", "future_", *[f"{k}__" for k in keys])


def as_of(targets: DataFrame, samples: DataFrame, keys: list[str], at: str = "hours", value: str = "value", stretch: float = STRETCH_HOURS) -> DataFrame:
    """Each target's last sample at or before it and first at or after it: before_at, before_value, after_at, after_value."""
    pack = F.struct(F.col(at).alias("at"), F.col(value).alias("v"))
    names = [c for c in targets.columns if c not in (*keys, at)]
    left = targets.select(*keys, at, F.struct(*[F.col(c) for c in names], F.lit(1).alias("is_target")).alias("t_"), F.lit(None).cast(samples.select(pack.alias("s")).schema["s"].dataType).alias("s_"))
    right = samples.select(*keys, at, F.lit(None).cast(left.schema["t_"].dataType).alias("t_"), pack.alias("s_"))
    both = around(left.unionByName(right), keys, "s_", at, stretch).where("t_ is not null")  # peers at one instant count for both sides
    return both.select(*keys, at, *[F.col(f"t_.{c}").alias(c) for c in names], F.col("before_.at").alias("before_at"), F.col("before_.v").alias("before_value"), F.col("after_.at").alias("after_at"), F.col("after_.v").alias("after_value"))


def interpolate(found: DataFrame, at: str = "hours", method: str = "linear", max_gap: float | None = None) -> DataFrame:
    """value by linear, nearest (ties to before), previous or next; NULL across gaps over max_gap hours, and outside the samples for linear."""
    t0, t1, v0, v1 = (F.col(c) for c in ("before_at", "after_at", "before_value", "after_value"))
    if method == "linear":
        v = F.when(t0 == t1, v0).otherwise(v0 + (v1 - v0) * (F.col(at) - t0) / (t1 - t0))
    elif method == "nearest":
        v = F.when(t0.isNull(), v1).when(t1.isNull(), v0).when(F.col(at) - t0 <= t1 - F.col(at), v0).otherwise(v1)
    elif method == "previous":
        v = v0
    elif method == "next":
        v = v1
    else:
        raise ValueError(f"interpolation {method!r} isn't supported")
    return found.withColumn("interpolated", v if max_gap is None else F.when(t1 - t0 > max_gap, None).otherwise(v))


def nearest_within(found: DataFrame, tolerance: float, at: str = "hours") -> DataFrame:
    near = interpolate(found, at, "nearest")
    d = F.least(F.col(at) - F.col("before_at"), F.col("after_at") - F.col(at))
    return near.withColumn("distance", d).where(F.col("distance") <= tolerance)


def regular_times(df: DataFrame, keys: list[str], step: float, at: str = "hours") -> DataFrame:
    """Every step-th hour of each key's span."""
    span = df.groupBy(*keys).agg((F.ceil(F.min(at) / step)).cast("bigint").alias("lo"), F.floor(F.max(at) / step).cast("bigint").alias("hi")).where("lo <= hi")
    return span.select(*keys, F.explode(F.transform(F.sequence("lo", "hi"), lambda i: i * step)).alias(at))


def steps_of(df: DataFrame, keys: list[str], value: str = "value", at: str = "hours", tie: str = "id") -> DataFrame:
    """Each row's previous instant and value, and the differences."""
    w = Window.partitionBy(*keys).orderBy(at, tie)
    out = df.withColumn("prev_at", F.lag(at).over(w)).withColumn("prev_value", F.lag(value).over(w))
    return out.withColumn("gap", F.col(at) - F.col("prev_at")).withColumn("delta", F.col(value) - F.col("prev_value"))


def gaps(df: DataFrame, keys: list[str], start: float, end: float, most: float, at: str = "hours") -> DataFrame:
    """kind (leading, inner, trailing), begins, ends and hours of the stretches over most hours without a row."""
    w = Window.partitionBy(*keys).orderBy(at)
    inner = df.select(*keys, F.lag(at).over(w).alias("begins"), F.col(at).alias("ends")).where("begins is not null").withColumn("kind", F.lit("inner"))
    edge = df.groupBy(*keys).agg(F.min(at).alias("a"), F.max(at).alias("z"))
    edges = edge.select(*keys, F.explode(F.array(F.struct(F.lit(start).alias("begins"), F.col("a").alias("ends"), F.lit("leading").alias("kind")), F.struct(F.col("z").alias("begins"), F.lit(end).alias("ends"), F.lit("trailing").alias("kind")))).alias("e")).select(*keys, "e.*")
    return inner.unionByName(edges).withColumn("hours", F.col("ends") - F.col("begins")).where(F.col("hours") > most)


def runs(df: DataFrame, keys: list[str], condition: Column, at: str = "hours", tie: str = "id") -> DataFrame:
    """run, begins, ends, rows of each unbroken run of rows for which condition holds."""
    w = Window.partitionBy(*keys).orderBy(at, tie)
    flagged = df.withColumn("hit_", F.coalesce(condition, F.lit(False)))
    numbered = flagged.withColumn("island_", F.sum(F.when(F.col("hit_"), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.where("hit_").groupBy(*keys, F.col("island_").alias("run")).agg(F.min(at).alias("begins"), F.max(at).alias("ends"), F.count("*").alias("rows"))


def autocorrelation(df: DataFrame, keys: list[str], value: str = "value", at: str = "hours", tie: str = "id") -> DataFrame:
    """Lag-1 autocorrelation: the mean product of neighbours' deviations over the population variance."""
    m = df.groupBy(*keys).agg(F.avg(value).alias("mu_"), F.var_pop(value).alias("var_"))
    w = Window.partitionBy(*keys).orderBy(at, tie)
    d = df.join(m, keys).withColumn("dev_", F.col(value) - F.col("mu_")).withColumn("next_", F.lead("dev_").over(w))
    return d.groupBy(*keys).agg((F.avg(F.col("dev_") * F.col("next_")) / F.when(F.max("var_") > 0, F.max("var_"))).alias("lag1"))


def overlapping(a: DataFrame, b: DataFrame, keys: list[str], tolerance: float, at: str = "hours") -> DataFrame:
    """Rows of a with a row of b within tolerance hours: each row of b is put into the bins it can reach, and bins meet by equality."""
    cell = F.floor(F.col(at) / tolerance)
    left = a.withColumn("cell_", cell)
    right = b.select(*keys, F.col(at).alias("other_"), F.explode(F.array(cell - 1, cell, cell + 1)).alias("cell_"))
    hit = left["cell_"] == right["cell_"]
    for k in keys:
        hit = hit & (left[k] == right[k])
    return left.join(right, hit & (F.abs(left[at] - right["other_"]) <= tolerance), "left_semi").drop("cell_")
