"""Band and sample statistics, histograms, calibration, histories: aggregates with a partial stage, and expressions over their one row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tellurion.functions.base import uniform

from .zonal import with_group_totals, with_totals

PERCENTILES = (2, 5, 25, 50, 75, 95, 98)


def band_statistics(px: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """count, valid, min, max, mean, std (population), median, variance, sum, distinct, cv, snr and percentiles of each group."""
    v = F.col(value)
    out = px.groupBy(*keys).agg(
        F.count("*").alias("n"), F.count(v).alias("valid"), F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"),
        F.var_pop(v).alias("variance"), F.sum(v).alias("sum"), F.countDistinct(v).alias("distinct"), F.percentile(v, F.array(*[F.lit(p / 100) for p in PERCENTILES])).alias("p"),
    )
    out = out.select("*", *[F.get("p", i).alias(f"p{q}") for i, q in enumerate(PERCENTILES)]).drop("p")
    return out.withColumn("cv", F.when(F.col("mean") != 0, F.col("std") / F.col("mean"))).withColumn("snr", F.when(F.col("std") > 0, F.col("mean") / F.col("std")))


def histogram(px: DataFrame, keys: list[str], value: str = "value", bins: int = 10, log: bool = False) -> DataFrame:
    """bin (0 to bins - 1, of equal width, or of equal width of ln(1 + x)) and n, of each group."""
    v = F.log1p(value) if log else F.col(value)
    out = px.where(F.col(value).isNotNull()).withColumn("v_", v)
    out = with_group_totals(out, keys, lo_=F.min("v_"), hi_=F.max("v_")) if keys else with_totals(out, lo_=F.min("v_"), hi_=F.max("v_"))
    width = (F.col("hi_") - F.col("lo_")) / bins
    b = F.when(width > 0, F.least(F.lit(bins - 1), F.floor((F.col("v_") - F.col("lo_")) / width).cast("int"))).otherwise(0)
    return out.groupBy(*keys, b.alias("bin")).agg(F.count("*").alias("n"))


def percentile_histogram(px: DataFrame, keys: list[str], value: str = "value", bins: int = 4) -> DataFrame:
    """bin by the group's own quantiles, [lo, hi), and n."""
    cuts = F.percentile(value, F.array(*[F.lit(i / bins) for i in range(1, bins)]))
    out = with_group_totals(px.where(F.col(value).isNotNull()), keys, q_=cuts)
    return out.groupBy(*keys, F.size(F.filter("q_", lambda q: q <= F.col(value))).alias("bin")).agg(F.count("*").alias("n"))


def sample_metrics(df: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """n, mean, std (ddof 1), standard error, cv, adjusted skewness and kurtosis, iqr; z-intervals for 68, 95 and 99 %."""
    x = F.col(value)
    m = df.groupBy(*keys).agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.var_pop(x).alias("m2"), F.percentile(x, F.lit(0.25)).alias("q1"), F.percentile(x, F.lit(0.75)).alias("q3"))
    centred = df.join(m.select(*keys, "mean"), keys).groupBy(*keys).agg(F.avg(F.pow(x - F.col("mean"), 3)).alias("m3"), F.avg(F.pow(x - F.col("mean"), 4)).alias("m4"))
    j, n = m.join(centred, keys), F.col("n")
    skew = F.when((n > 2) & (F.col("m2") > 0), F.sqrt(n * (n - 1)) / (n - 2) * F.col("m3") / F.pow("m2", F.lit(1.5)))
    kurt = F.when((n > 3) & (F.col("m2") > 0), (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * (F.col("m4") / F.pow("m2", F.lit(2)) - 3) + 6))
    se = F.col("std") / F.sqrt(n)
    z = {"68": 1.0, "95": 1.96, "99": 2.576}
    return j.select(*keys, "n", "mean", "std", se.alias("se"), F.when(F.col("mean") != 0, F.col("std") / F.abs(F.col("mean"))).alias("cv"), skew.alias("skewness"), kurt.alias("kurtosis"), (F.col("q3") - F.col("q1")).alias("iqr"), *[(F.col("mean") + s * zz * se).alias(f"{side}{k}") for k, zz in z.items() for side, s in (("low", -1), ("high", 1))])


def bootstrap(df: DataFrame, keys: list[str], statistic: Column, value: str = "value", resamples: int = 200, low: float = 0.025, high: float = 0.975, seed: int = 1, names: list[str] | None = None) -> DataFrame:
    """Percentile interval of a statistic of value. Each row takes part in a resample as often as a Poisson draw of a digest of it (or of names) says, so a resample is one
    conditional aggregate and rows aren't copied per resample beyond that."""
    u = uniform(*[F.col(c) for c in (names or df.columns)], F.col("draw_"), F.lit(seed))
    # Poisson(1) by its distribution function; fixed values
    times = F.when(u < 0.36787944, 0).when(u < 0.73575888, 1).when(u < 0.91969860, 2).when(u < 0.98101184, 3).when(u < 0.99634015, 4).otherwise(5)
    drawn = df.withColumn("draw_", F.explode(F.sequence(F.lit(1), F.lit(resamples)))).withColumn("times_", times).where("times_ > 0").withColumn("copy_", F.explode(F.sequence(F.lit(1), F.col("times_"))))
    return drawn.groupBy(*keys, "draw_").agg(statistic.alias("s_")).groupBy(*keys).agg(F.avg("s_").alias("mean"), F.percentile("s_", F.lit(low)).alias("low"), F.percentile("s_", F.lit(high)).alias("high"))


def entropy(counts: DataFrame, keys: list[str], n: str = "n") -> DataFrame:
    """Shannon entropy in bits of each group's counts."""
    t = counts.groupBy(*keys).agg(F.sum(n).alias("t"), F.sum(F.when(F.col(n) > 0, F.col(n) * F.log2(n)).otherwise(0.0)).alias("s"))
    return t.select(*keys, F.when(F.col("t") > 0, F.log2("t") - F.col("s") / F.col("t")).alias("entropy"))


def calibration(df: DataFrame, p: str = "p", o: str = "o", bins: int = 10) -> DataFrame:
    """bin, n, mean_p, mean_o: a reliability diagram."""
    b = F.least(F.lit(bins - 1), F.floor(F.col(p) * bins).cast("int"))
    return df.groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.avg(p).alias("mean_p"), F.avg(o).alias("mean_o"))


def calibration_errors(df: DataFrame, p: str = "p", o: str = "o", bins: int = 10) -> DataFrame:
    """One row: ece, mce, brier, reliability, resolution, uncertainty."""
    c = calibration(df, p, o, bins)
    base = df.agg(F.count("*").alias("t"), F.avg(F.pow(F.col(p) - F.col(o), 2)).alias("brier"), F.avg(o).alias("base"))
    j = c.crossJoin(F.broadcast(base))
    gap, w = F.abs(F.col("mean_p") - F.col("mean_o")), F.col("n") / F.col("t")
    return j.agg(F.sum(w * gap).alias("ece"), F.max(gap).alias("mce"), F.max("brier").alias("brier"), F.sum(w * gap * gap).alias("reliability"), F.sum(w * F.pow(F.col("mean_o") - F.col("base"), 2)).alias("resolution"), F.max(F.col("base") * (1 - F.col("base"))).alias("uncertainty"))


def contingency(df: DataFrame, keys: list[str], forecast: str, observed: str) -> DataFrame:
    """hits, misses, false_alarms and correct_negatives of each group, with pod, far, csi, bias, hss, pss, iou and kappa."""
    f, o = F.col(forecast) == 1, F.col(observed) == 1
    c = lambda cond: F.count(F.when(cond, 1))
    t = df.groupBy(*keys) if keys else df.groupBy()
    t = t.agg(c(f & o).alias("hits"), c(~f & o).alias("misses"), c(f & ~o).alias("false_alarms"), c(~f & ~o).alias("correct_negatives"))
    h, m, a, n = (F.col(x).cast("double") for x in ("hits", "misses", "false_alarms", "correct_negatives"))
    total = h + m + a + n
    div = lambda x, y: F.when(y != 0, x / y)
    chance = (h + m) * (h + a) + (n + m) * (n + a)
    return t.select(
        *keys, "hits", "misses", "false_alarms", "correct_negatives", div(h, h + m).alias("pod"), div(a, h + a).alias("far"), div(h, h + m + a).alias("csi"), div(h + a, h + m).alias("bias"),
        div(2 * (h * n - m * a), (h + m) * (m + n) + (h + a) * (a + n)).alias("hss"), (div(h, h + m) - div(a, a + n)).alias("pss"), div(h, h + m + a).alias("iou"),
        div(div(h + n, total) - div(chance, total * total), 1 - div(chance, total * total)).alias("kappa"),
    )


def percentile_of(value: Column, knots: list[tuple[Column, float]]) -> Column:
    """Piecewise-linear percentile of value between knots (value, percentile), 0 and 100 beyond."""
    out = F.when(value.isNull(), None).when(value < knots[0][0], 0.0)
    for (a, pa_), (b, pb) in zip(knots[:-1], knots[1:], strict=True):
        out = out.when(value <= b, F.when(b > a, pa_ + (pb - pa_) * (value - a) / (b - a)).otherwise(F.lit(float(pb))))
    return out.otherwise(100.0)
