"""Checks of whole scenes and products: percentiles, sensors' quality scores, bands, manifests, checksums, outcomes, reviews and reports."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tellurion.functions.base import clip, lookup

from .focal import local_statistics, neighbours
from .zonal import with_totals

CELL = ["row", "col"]
# fixed values: percentiles of the plausibility check
PERCENTILES = (0.001, 0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99, 0.999)


def percentile_check(df: DataFrame, keys: list[str], value: str, most: float = 10.0, tail: float = 0.05) -> DataFrame:
    """For each key p (the nine percentiles), iqr, how many of those the outer percentiles are from the median, extreme, and tails: the share under the
    second or over the last but one, which is an issue above tail."""
    p = df.groupBy(*keys).agg(F.count(value).alias("n"), F.percentile(value, F.array(*map(F.lit, PERCENTILES))).alias("p"))
    at = lambda i: F.element_at("p", i + 1)
    iqr = at(5) - at(3)
    p = p.withColumn("iqr", iqr).withColumn("lower", F.when(iqr > 0, F.abs(at(0) - at(4)) / iqr)).withColumn("upper", F.when(iqr > 0, F.abs(at(8) - at(4)) / iqr))
    p = p.withColumn("extreme", F.coalesce((F.col("lower") > most) | (F.col("upper") > most), F.lit(False)))
    low, high = at(1), at(7)
    cut = p.select(*keys, low.alias("low_"), high.alias("high_"))
    tails = df.join(cut, keys).groupBy(*keys).agg(F.avg(F.when(F.col(value).isNotNull(), ((F.col(value) < F.col("low_")) | (F.col(value) > F.col("high_"))).cast("double"))).alias("tails"))
    return p.join(tails, keys).withColumn("tail_issue", F.col("tails") > tail)


# ---------------------------------------------------------------- optical, radar and elevation


def sun_glint(px: DataFrame, nir: str, water: Column, threshold: float = 0.3) -> DataFrame:
    """glint: water whose near infrared, from the median (0) to the 98th percentile (1) over water, is above threshold."""
    out = with_totals(px.withColumn("water_", water), q_=F.percentile(F.when(water, F.col(nir)), F.array(F.lit(0.5), F.lit(0.98))))
    low, span = F.element_at("q_", 1), F.element_at("q_", 2) - F.element_at("q_", 1)
    level = F.when(span > 1e-6, (F.col(nir) - low) / span).otherwise(F.col(nir))
    return out.withColumn("glint", F.coalesce(F.col("water_") & (level > threshold), F.lit(False))).drop("q_", "water_")


def optical_score(cloud: Column, shadow: Column, haze: Column, glint: Column, saturated: Column, clear: Column) -> Column:
    """0 to 1, from percents (haze: a share)."""
    lost = lambda c, most: F.greatest(F.lit(0.0), 1 - c / most)
    return clip(0.35 * lost(cloud, 100) + 0.15 * lost(shadow, 50) + 0.15 * (1 - haze) + 0.10 * lost(glint, 30) + 0.10 * lost(saturated, 10) + 0.15 * clear / 100, 0, 1)


def decibels(intensity: Column) -> Column:
    return F.when(intensity > 0, 10 * F.log10(intensity))


def local_looks(px: DataFrame, intensity: str, k: int = 7, least: int = 10) -> DataFrame:
    """One row, looks: the median of (mean / deviation)² over all whole windows with enough valid cells, of those between 0.5 and 100; 1 if none is."""
    half = k // 2
    s = with_totals(local_statistics(px.withColumn("v_", F.col(intensity)), "v_", k, "none"), top_=F.max("row"), right_=F.max("col"))
    s = s.where(F.col("v_").isNotNull() & F.col("row").between(half, F.col("top_") - half) & F.col("col").between(half, F.col("right_") - half) & (F.col("n_") >= least) & (F.col("var_") > 1e-20) & (F.col("mean_") > 1e-10))
    looks = F.col("mean_") * F.col("mean_") / F.col("var_")
    return s.agg(F.coalesce(F.median(F.when((looks > 0.5) & (looks < 100), looks)), F.lit(1.0)).alias("looks"))


def steepness(px: DataFrame, elev: str) -> DataFrame:
    """slope in degrees, of cells with all four neighbours, for cells as wide as heights' unit."""
    n = neighbours(px, elev, [(0, 1), (0, -1), (1, 0), (-1, 0)]).groupBy(*CELL).agg(F.count("other").alias("n_"), F.sum(F.col("d_col") * F.col("other") / 2).alias("gx_"), F.sum(F.col("d_row") * F.col("other") / 2).alias("gy_")).where("n_ = 4")
    return px.join(n, CELL, "left").withColumn("slope", F.degrees(F.atan(F.sqrt(F.col("gx_") * F.col("gx_") + F.col("gy_") * F.col("gy_"))))).drop("n_", "gx_", "gy_")


def radar_geometry(px: DataFrame, intensity: str, look_angle: float = 35.0) -> DataFrame:
    """One row of a raster with slope: layover and shadow percents, the mean in decibels, calibration error, slopes' deviation, and issues."""
    db = decibels(F.col(intensity))
    shadow = (F.coalesce(F.col("slope"), F.lit(0.0)) > look_angle) | (F.coalesce(db, F.lit(-40.0)) < -30)
    out = px.where(F.col(intensity).isNotNull()).agg(
        (100 * F.avg((F.coalesce(F.col("slope"), F.lit(0.0)) > 90 - look_angle).cast("double"))).alias("layover"), (100 * F.avg(shadow.cast("double"))).alias("shadow"),
        F.avg(db).alias("mean_db"), F.stddev_pop("slope").alias("roughness"), F.percentile(db, 0.99).alias("bright_db"),
    )
    error = F.when((F.col("mean_db") < -20) | (F.col("mean_db") > 0), F.abs(F.col("mean_db") + 10)).otherwise(0.0)
    issues = F.array_compact(F.array(F.when(F.col("roughness") > 15, "complex_terrain"), F.when(F.col("bright_db") > 5, "bright_artifacts")))
    return out.withColumn("calibration_error", error).withColumn("issues", issues)


def radar_score(looks: Column, calibration_error: Column, layover: Column, shadow: Column) -> Column:
    speckle = F.when(looks < 1, 0.0).when(looks < 3, 0.3 * looks / 3).when(looks < 10, 0.3 + 0.5 * (looks - 3) / 7).otherwise(F.least(F.lit(1.0), 0.8 + 0.2 * F.least(F.lit(1.0), (looks - 10) / 40)))
    lost = lambda c, most: F.greatest(F.lit(0.0), 1 - c / most)
    return clip(0.35 * speckle + 0.25 * lost(F.abs(calibration_error), 5) + 0.25 * lost(layover, 50) + 0.15 * lost(shadow, 30), 0, 1)


def elevation_artifacts(px: DataFrame, elev: str, margin: float = 100.0, share: float = 0.1) -> DataFrame:
    """One row: spikes and pits, cells beyond the mean by three deviations and margin, their percents, and whether those are over share."""
    out = with_totals(px.where(F.col(elev).isNotNull()), mu_=F.avg(elev), sd_=F.stddev_pop(elev))
    high, low = F.col(elev) > F.col("mu_") + 3 * F.col("sd_") + margin, F.col(elev) < F.col("mu_") - 3 * F.col("sd_") - margin
    out = out.agg(F.count(F.when(high, 1)).alias("spikes"), F.count(F.when(low, 1)).alias("pits"), F.count("*").alias("n_"))
    for name in ("spikes", "pits"):
        out = out.withColumn(f"{name}_percent", 100 * F.col(name) / F.col("n_")).withColumn(f"{name}_issue", F.col(f"{name}_percent") > share)
    return out.drop("n_")


# fixed values: vertical accuracy of elevation models in metres
ACCURACY = {"SRTM": 16.0, "ASTER": 17.0, "Copernicus": 4.0, "ALOS": 5.0, "NASADEM": 12.0, "LiDAR": 0.15}


def vertical_accuracy(px: DataFrame, elev: str, reference: str, source: str, noise: float, stated: float | None = None, least: int = 100) -> DataFrame:
    """One row: accuracy and method. By a reference with more than least cells; else as stated; else from the source and the noise."""
    d = F.col(elev) - F.col(reference)
    out = px.agg(F.count(d).alias("n"), F.sqrt(F.avg(d * d)).alias("rmse"), F.avg(F.abs(d)).alias("mae"), F.avg(d).alias("bias"))
    known = F.col("n") > least
    otherwise = F.lit(stated) if stated is not None else F.lit(math.hypot(ACCURACY.get(source, 10.0), noise))
    return out.select("n", F.when(known, F.col("rmse")).otherwise(otherwise).alias("accuracy"), F.when(known, "reference").otherwise("stated" if stated is not None else "estimated").alias("method"), "mae", "bias")


# ---------------------------------------------------------------- bands and files


def band_issues(px: DataFrame, expected: list[str], required: list[str]) -> DataFrame:
    """(band, issue) of a raster whose bands are columns: missing_required, missing, blank (no value or only 0) or constant. One pass over all bands."""
    there = [b for b in expected if b in px.columns]
    stats = [x for b in there for x in (F.count(F.when(F.col(b) != 0, 1)).alias(f"n_{b}"), F.min(b).alias(f"lo_{b}"), F.max(b).alias(f"hi_{b}"))]
    one = px.agg(F.count("*").alias("n_"), *stats)
    found = [F.struct(F.lit(b).alias("band"), F.lit("missing_required" if b in required else "missing").alias("issue")) for b in expected if b not in there]
    for b in there:
        found.append(F.struct(F.lit(b).alias("band"), F.when(F.col(f"n_{b}") == 0, "blank").when(F.col(f"lo_{b}") == F.col(f"hi_{b}"), "constant").alias("issue")))
    return one.select(F.explode(F.array(*found)).alias("x")).select("x.*").where("issue is not null")


def radar_issues(px: DataFrame, keys: list[str], db: str, low: float = -50.0, high: float = 10.0, least: int = 100) -> DataFrame:
    """(keys, issue): out_of_range where over 1 % of the decibels lie outside, too_few cells, or speckle where their deviation is over 8."""
    s = px.groupBy(*keys).agg(F.count(db).alias("n_"), F.avg((~F.col(db).between(low, high)).cast("double")).alias("out_"), F.stddev_pop(db).alias("sd_"))
    found = F.array_compact(F.array(F.when(F.col("out_") > 0.01, "out_of_range"), F.when(F.col("n_") < least, "too_few"), F.when(F.col("sd_") > 8, "speckle")))
    return s.select(*keys, F.explode(found).alias("issue"))


def verdict(issues: DataFrame, keys: list[str], severity: dict[str, str]) -> DataFrame:
    """status of each key with issues: invalid if any is an error, else warnings; and how many of each."""
    s = lookup(F.col("issue"), severity, "warning")
    out = issues.groupBy(*keys).agg(F.count(F.when(s == "error", 1)).alias("errors"), F.count(F.when(s != "error", 1)).alias("warnings"))
    return out.withColumn("status", F.when(F.col("errors") > 0, "invalid").otherwise("warnings"))


def missing_tiles(present: DataFrame, rows: int, cols: int) -> DataFrame:
    """(tile_row, tile_col) of a grid of tiles that aren't present."""
    spark = present.sparkSession
    grid = spark.range(rows * cols).select(F.floor(F.col("id") / cols).cast("int").alias("tile_row"), (F.col("id") % cols).cast("int").alias("tile_col"))
    return grid.join(present.select("tile_row", "tile_col"), ["tile_row", "tile_col"], "left_anti")


def checksum(content: Column, algorithm: str) -> Column:
    """Of a text or binary column, in lower-case hex; null is as empty content."""
    raw = F.coalesce(content.cast("binary"), F.lit(b""))
    if algorithm == "md5":
        return F.md5(raw)
    if algorithm in ("sha256", "sha512"):
        return F.sha2(raw, int(algorithm[3:]))
    raise ValueError(f"checksum {algorithm!r} isn't supported")


def radiometric_score(saturated: Column, snr: Column, striping: Column, saturation_most: float = 1.0, snr_least: float = 10.0, striping_most: float = 0.1) -> Column:
    """1 less penalties for saturation (percent), a low signal to noise ratio and striping; what is NULL costs nothing."""
    cost = lambda bad, severity, weight: F.coalesce(F.when(bad, 1 - weight * F.least(severity, F.lit(1.0))), F.lit(1.0))
    return cost(saturated > saturation_most, saturated / 10, 0.3) * cost(snr < snr_least, (snr_least - snr) / snr_least, 0.2) * cost(striping > striping_most, (striping - striping_most) / 0.5, 0.15)


# ---------------------------------------------------------------- outcomes, reviews and reports

# fixed values: what a conflict's severity leaves of the confidence
PENALTIES = {"none": 1.0, "low": 0.95, "medium": 0.8, "high": 0.6, "critical": 0.3}
# fixed values: gates' thresholds: confidence, soft failures, warnings, coverage percent, uncertainty, agreement
GATES = {"emergency": (0.4, 5, 10, 60.0, 0.5, 0.5), "research": (0.8, 1, 3, 90.0, 0.2, 0.85)}


def after_conflict(confidence: Column, severity: Column) -> Column:
    return confidence * lookup(severity, PENALTIES, 1.0)


def combined(layers: DataFrame, keys: list[str], value: str, confidence: str, power: float = 2.0) -> DataFrame:
    """mean, weighted (by confidence to a power, with weighted_confidence likewise), median and surest (the value of the highest confidence, then the least)."""
    w = F.pow(F.col(confidence), power)
    share = lambda x: F.sum(w * x) / F.when(F.sum(w) > 0, F.sum(w))
    return layers.groupBy(*keys).agg(F.avg(value).alias("mean"), share(F.col(value)).alias("weighted"), share(F.col(confidence)).alias("weighted_confidence"), F.median(value).alias("median"), F.max(F.struct(F.col(confidence).alias("c"), (-F.col(value)).alias("v"))).alias("s_")).withColumn("surest", -F.col("s_.v")).drop("s_")


def with_second_choice(first: Column, first_confidence: Column, second: Column, least: float) -> tuple[Column, Column]:
    """The value, the second where the first isn't confident enough, and whether it was taken."""
    second_taken = F.coalesce(first_confidence < least, F.lit(True)) & second.isNotNull()
    return F.when(second_taken, second).otherwise(first), second_taken


def overall_outcome(comparisons: DataFrame, keys: list[str], coincident: Column) -> DataFrame:
    """outcome and confidence of each key's comparisons (outcome, agreement), those with too little data left out; coincident is an aggregate."""
    of = comparisons.where("outcome <> 'insufficient_data'")
    n = lambda *names: F.count(F.when(F.col("outcome").isin(*names), 1)) / F.count("*")
    of = of.groupBy(*keys).agg(n("consistent").alias("c_"), n("consistent", "minor_discrepancy").alias("m_"), n("conflict").alias("x_"), (F.avg("agreement") * F.when(coincident, 1.0).otherwise(0.8)).alias("k_"))
    kind = F.when(F.col("c_") >= 0.8, "consistent").when(F.col("m_") >= 0.7, "minor_discrepancy").when(F.col("x_") >= 0.5, "conflict").otherwise("significant_discrepancy")
    return of.select(*keys, kind.alias("outcome"), (F.col("k_") * lookup(kind, {"minor_discrepancy": 0.9, "conflict": 0.5, "significant_discrepancy": 0.7}, 1.0)).alias("confidence"))


def overall_agreement(cells: DataFrame, keys: list[str], level: str = "level") -> DataFrame:
    share = lambda *names: F.avg(F.col(level).isin(*names).cast("double"))
    of = cells.groupBy(*keys).agg(share("excellent").alias("e_"), share("excellent", "good").alias("g_"), share("critical").alias("c_"))
    return of.select(*keys, F.when((F.col("e_") >= 0.8) | (F.col("g_") >= 0.95), "excellent").when(F.col("g_") >= 0.8, "good").when(F.col("g_") >= 0.5, "moderate").when(F.col("c_") < 0.5, "poor").otherwise("critical").alias("agreement"))


def confidence_flag(confidence: Column) -> Column:
    return F.when(confidence >= 0.8, "HIGH_CONFIDENCE").when(confidence >= 0.6, "MEDIUM_CONFIDENCE").when(confidence >= 0.4, "LOW_CONFIDENCE").otherwise("INSUFFICIENT_CONFIDENCE")


def gate_passes(preset: str, confidence: Column, soft: Column, warnings: Column, coverage: Column, uncertainty: Column, agreement: Column) -> Column:
    a, b, c, d, e, f = GATES[preset]
    return (confidence >= a) & (soft <= b) & (warnings <= c) & (coverage >= d) & (uncertainty <= e) & (agreement >= f)


def review_of(failed: Column, status: Column, event: Column) -> Column:
    """(kind, domain, priority) of the review that a gating decision asks for; failed is an array of names of failed critical rules, first ones first."""
    has = lambda x, *names: F.greatest(*[F.contains(F.lower(x), F.lit(n)) for n in names], F.lit(False))
    one = lambda x: F.when(has(x, "cross", "agreement"), "ALGORITHM_AGREEMENT").when(has(x, "uncertainty"), "UNCERTAINTY_ASSESSMENT").when(has(x, "artifact"), "ARTIFACT_VERIFICATION").when(has(x, "spatial", "boundary"), "BOUNDARY_VALIDATION").when(has(x, "temporal"), "TEMPORAL_CONSISTENCY")
    kind = F.coalesce(F.get(F.filter(F.transform(failed, one), lambda k: k.isNotNull()), 0), F.lit("QUALITY_VALIDATION"))
    domain = F.when(F.lower(event).isin("flood", "wildfire", "storm"), F.upper(event)).otherwise("GENERAL")
    return F.struct(kind.alias("kind"), domain.alias("domain"), F.when((status == "BLOCKED") | (F.size(failed) > 2), "HIGH").otherwise("NORMAL").alias("priority"))


def overdue(requests: DataFrame, now: Column, hours: dict[str, float], at: str = "ts") -> DataFrame:
    """Requests still open (pending or assigned) for longer than their priority allows, with waited (hours)."""
    waited = (F.unix_micros(now) - F.unix_micros(F.col(at).cast("timestamp"))) / 3.6e9
    return requests.where(F.col("status").isin("pending", "assigned")).withColumn("waited", waited).where(waited > lookup(F.col("priority"), hours, max(hours.values())))


def against_baseline(baseline: DataFrame, current: DataFrame, keys: list[str]) -> DataFrame:
    """delta and percent of metrics there in both, and change: new, resolved or kept."""
    out = baseline.withColumnRenamed("value", "before").join(current.withColumnRenamed("value", "after"), keys, "full")
    change = F.when(F.col("before").isNull(), "new").when(F.col("after").isNull(), "resolved").otherwise("kept")
    return out.withColumn("delta", F.col("after") - F.col("before")).withColumn("percent", F.when(F.col("before") != 0, 100 * F.col("delta") / F.abs("before"))).withColumn("change", change)


def by_status(items: DataFrame, status: str, size: str) -> DataFrame:
    """n, size and share of the items of each status: a cache's, a pipeline's or a tile run's statistics."""
    return with_totals(items.groupBy(status).agg(F.count("*").alias("n"), F.sum(size).alias("size")), all_=F.sum("n")).withColumn("share", F.col("n") / F.col("all_")).drop("all_")


def first_of_each(artifacts: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first artifact of each place and kind."""
    return artifacts.withColumn("n_", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("n_ = 1").drop("n_")


def blocking(px: DataFrame, value: str, size: int) -> DataFrame:
    """One row: size and score, how much steeper cells on the edges of size by size blocks are than others, 0 to 1."""
    s = steepness(px.select(*CELL, F.col(value).alias("v_")), "v_").withColumn("g_", F.tan(F.radians("slope")))
    edge = (F.col("row") % size == 0) | (F.col("col") % size == 0)
    m = s.agg(F.avg(F.when(edge, F.col("g_"))).alias("on"), F.avg(F.when(~edge, F.col("g_"))).alias("off"))
    return m.select(F.lit(size).alias("size"), F.coalesce(F.when(F.col("off") >= 1e-10, clip(F.col("on") / F.col("off") - 1, 0, 1)), F.lit(0.0)).alias("score"))
