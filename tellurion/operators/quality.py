"""Quality rules: sanity of values, image checks, gating, flags, routing and fallbacks. A rule is a Column, so all rules of a table are one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tellurion.functions.base import clip

from .zonal import with_group_totals, with_totals

# fixed values
FLAG_FACTORS = {"CLOUD_AFFECTED": 0.8, "SINGLE_SENSOR": 0.9, "HISTORICAL_PROXY": 0.7, "INTERPOLATED": 0.85, "DEGRADED_RESOLUTION": 0.9, "LOW_CONFIDENCE": 0.6}
PENALTIES = {"critical": 0.4, "high": 0.2, "medium": 0.1, "low": 0.05}


def range_check(df: DataFrame, keys: list[str], value: str, low: float, high: float) -> DataFrame:
    """n, nulls, outside, share and severity (critical over 5 %, high over 1 %) of each group."""
    v = F.col(value)
    out = df.groupBy(*keys).agg(F.count("*").alias("n"), F.count(F.when(v.isNull() | F.isnan(v), 1)).alias("nulls"), F.count(F.when((v < low) | (v > high), 1)).alias("outside"))
    share = F.when(F.col("n") > 0, F.col("outside") / F.col("n"))
    return out.withColumn("share", share).withColumn("severity", F.when(share > 0.05, "critical").when(share > 0.01, "high").when(share > 0, "medium").otherwise("none"))


def anomalies(df: DataFrame, keys: list[str], value: str, z: float = 3.0, iqr: float = 1.5, saturation: float = 0.99) -> DataFrame:
    """Counts of cells beyond z deviations, beyond the quartiles' fences, and at the maximum, with a score less penalties."""
    v = F.col(value)
    s = with_group_totals(df, keys, mu_=F.avg(v), sd_=F.stddev_pop(v), q1_=F.percentile(v, F.lit(0.25)), q3_=F.percentile(v, F.lit(0.75)), mx_=F.max(v))
    c = lambda cond: F.count(F.when(cond, 1))
    span = F.col("q3_") - F.col("q1_")
    out = s.groupBy(*keys).agg(F.count(v).alias("n"), c(F.abs(v - F.col("mu_")) > z * F.col("sd_")).alias("z_outliers"), c((v < F.col("q1_") - iqr * span) | (v > F.col("q3_") + iqr * span)).alias("iqr_outliers"), c(v >= saturation * F.col("mx_")).alias("saturated"))
    n = F.col("n")
    loss = F.when(F.col("z_outliers") / n > 0.01, PENALTIES["medium"]).otherwise(0.0) + F.when(F.col("iqr_outliers") / n > 0.02, PENALTIES["low"]).otherwise(0.0) + F.when(F.col("saturated") / n > 0.005, PENALTIES["high"]).otherwise(0.0)
    return out.withColumn("score", F.round(F.greatest(F.lit(0.0), 1 - loss), 3))


def gate(checks: DataFrame, keys: list[str]) -> DataFrame:
    """status and confidence of each product from checks (category, passed, mandatory): BLOCKED, REVIEW_REQUIRED, PASS_WITH_WARNINGS or PASS."""
    fail = ~F.col("passed")
    c = lambda cond: F.count(F.when(cond, 1))
    g = checks.groupBy(*keys).agg(c(fail & (F.col("category") == "mandatory")).alias("mandatory"), c(fail & (F.col("category") == "critical")).alias("critical"), c(fail & (F.col("category") == "advisory")).alias("warnings"))
    status = F.when(F.col("mandatory") > 0, "BLOCKED").when(F.col("critical") > 0, "REVIEW_REQUIRED").when(F.col("warnings") > 0, "PASS_WITH_WARNINGS").otherwise("PASS")
    confidence = F.when(F.col("mandatory") > 0, 0.0).when(F.col("critical") > 0, F.greatest(F.lit(0.5), 1 - 0.1 * F.col("critical"))).when(F.col("warnings") > 0, F.greatest(F.lit(0.8), 1 - 0.02 * F.col("warnings"))).otherwise(1.0)
    return g.withColumn("status", status).withColumn("confidence", confidence)


def flag_modifier(flags: DataFrame, keys: list[str]) -> DataFrame:
    """The product of the factors of each product's distinct flags."""
    factor = F.create_map(*[F.lit(x) for kv in FLAG_FACTORS.items() for x in kv])[F.col("flag")]
    d = flags.select(*keys, "flag").distinct()
    return d.groupBy(*keys).agg(F.count("*").alias("flags"), F.exp(F.sum(F.log(factor))).alias("modifier"))


def condition_flags(cloud: Column, single_sensor: Column, confidence: Column) -> Column:
    """An array of the flags that hold."""
    return F.filter(F.array(F.when(cloud > 30, "CLOUD_AFFECTED"), F.when(single_sensor, "SINGLE_SENSOR"), F.when(confidence < 0.5, "LOW_CONFIDENCE")), lambda x: x.isNotNull())


def haze(px: DataFrame, blue: str, red: str) -> DataFrame:
    """One row: 0.6 of the excess of blue over red, and 0.4 of the lack of contrast."""
    s = px.agg(F.avg(F.col(blue)).alias("b"), F.avg(F.col(red)).alias("r"), F.stddev_pop(F.col(blue)).alias("c"))
    return s.select((0.6 * clip((F.col("b") / F.col("r") - 1) / 0.5, 0, 1) + 0.4 * F.greatest(F.lit(0.0), 1 - 2 * F.col("c"))).alias("haze"))


def clouds_and_shadows(px: DataFrame, bands: list[str], bright: float = 0.7, dark: float = 0.15) -> DataFrame:
    """brightness (mean of the bands between their 2nd and 98th percentiles), cloud and shadow of each cell."""
    totals = {f"{q}_{b}": F.percentile(b, F.lit(p)) for b in bands for q, p in (("lo", 0.02), ("hi", 0.98))}
    out = with_totals(px, **totals)
    mean = sum((clip((F.col(b) - F.col(f"lo_{b}")) / (F.col(f"hi_{b}") - F.col(f"lo_{b}")), 0, 1) for b in bands), F.lit(0.0)) / len(bands)
    out = out.withColumn("brightness", mean).drop(*totals)
    return out.withColumn("cloud", F.coalesce(F.col("brightness") > bright, F.lit(False))).withColumn("shadow", F.coalesce((F.col("brightness") < dark) & ~F.col("cloud"), F.lit(False)))


def speckle(px: DataFrame, keys: list[str], intensity: str) -> DataFrame:
    """enl = (mean / std)**2 and cv of each group."""
    s = px.groupBy(*keys).agg(F.avg(intensity).alias("m"), F.stddev_pop(intensity).alias("s"))
    return s.select(*keys, F.when(F.col("s") > 0, F.pow(F.col("m") / F.col("s"), 2)).alias("enl"), F.when(F.col("m") != 0, F.col("s") / F.col("m")).alias("cv"))


def degraded_level(*factors: Column) -> tuple[Column, Column]:
    """(geometric mean of the factors, level)."""
    product = F.lit(1.0)
    for f in factors:
        product = product * F.greatest(F.lit(0.01), f)
    g = F.pow(product, 1.0 / len(factors))
    return g, F.when(g >= 0.8, "FULL").when(g >= 0.6, "PARTIAL").when(g >= 0.4, "MINIMAL").when(g >= 0.2, "EMERGENCY").otherwise("UNAVAILABLE")


def first_available(chain: list[tuple[str, Column, float]]) -> tuple[Column, Column]:
    """(the first option whose condition holds, the confidence lost to the ones before): a fallback chain."""
    choice, loss, lost = F.when(F.lit(False), None), F.when(F.lit(False), None), 0.0
    for name, ok, cost in chain:
        lost += cost
        choice, loss = choice.when(ok, F.lit(name)), loss.when(ok, F.lit(lost))
    return choice.otherwise("none"), loss.otherwise(1.0)


def assign_reviewers(requests: DataFrame, experts: DataFrame) -> DataFrame:
    """Each request's eligible expert: of its domain first, then the least loaded, then by name."""
    best = F.min(F.struct("load", "expert"))
    open_to = F.when(F.col("priority_access"), F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(False)))
    able = experts.select("expert", "domain", "load", F.explode(open_to).alias("critical"))
    own = able.groupBy(F.col("domain").alias("wants"), "critical").agg(best.alias("own"))
    other = able.groupBy("critical").agg(best.alias("other"))  # two rows at most
    j = requests.select("request", "wants", F.coalesce("critical", F.lit(True)).alias("critical")).join(own, ["wants", "critical"], "left").join(F.broadcast(other), "critical")
    found = lambda n, e: F.struct(F.lit(n).alias("o1"), F.col(f"{e}.load").alias("load"), F.col(f"{e}.expert").alias("expert"))
    pick = F.min(F.when(F.col("own").isNotNull(), found(0, "own")).otherwise(found(1, "other")))
    return j.groupBy("request").agg(pick.alias("b")).select("request", F.col("b.expert").alias("expert"))
