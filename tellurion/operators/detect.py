"""Detection of floods, fires and storm damage on pixel tables (row, col, ...).

A detector adds columns to its input, so a chain of them stays one stage; statistics are one aggregate at the end. NULL cells are invalid: they're
never detected and count in nothing.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tellurion.functions import spectral as S
from tellurion.functions.base import clip

from .zonal import with_totals


def sar_flood(px: DataFrame, db: str, threshold: float = -15.0) -> DataFrame:
    """Open water reflects radar away: dark cells are flooded."""
    x = F.col(db)
    return px.withColumn("flood", F.coalesce(x < threshold, F.lit(False))).withColumn("confidence", S.sar_confidence(x, threshold))


def sar_flood_change(px: DataFrame, pre: str, post: str, threshold: float = -15.0, change_db: float = 3.0) -> DataFrame:
    """Dark after and brighter before by more than change_db."""
    fall = F.col(pre) - F.col(post)
    flood = F.coalesce((F.col(post) < threshold) & (fall > change_db), F.lit(False))
    return px.withColumn("flood", flood).withColumn("confidence", (S.sar_confidence(F.col(post), threshold) + clip(fall / (3 * change_db), 0, 1)) / 2)


def ndwi_flood(px: DataFrame, green: str = "green", nir: str = "nir", threshold: float = 0.0) -> DataFrame:
    w = S.ndwi(F.col(green), F.col(nir))
    return px.withColumn("ndwi", w).withColumn("flood", F.coalesce(F.col("ndwi") > threshold, F.lit(False))).withColumn("confidence", S.index_confidence(F.col("ndwi"), threshold))


def ndwi_flood_change(px: DataFrame, pre: str, post: str, threshold: float = 0.0, least_change: float = 0.2) -> DataFrame:
    rise = F.col(post) - F.col(pre)
    flood = F.coalesce((F.col(post) > threshold) & (rise > least_change), F.lit(False))
    return px.withColumn("flood", flood).withColumn("confidence", (S.index_confidence(F.col(post), threshold) + clip(rise / (2 * least_change), 0, 1)) / 2)


def scaled_reflectance(px: DataFrame, band: str) -> DataFrame:
    """A band with values over 1 holds reflectance times 10000."""
    return with_totals(px, most_=F.max(band)).withColumn(band, F.when(F.col("most_") > 1, F.col(band) / 10000).otherwise(F.col(band))).drop("most_")


def clipped_change(px: DataFrame, pre: str, post: str, method: str = "normalized_difference", sigmas: float = 3.0) -> DataFrame:
    """The change of each cell, clipped to so many population standard deviations about its mean."""
    out = px.withColumn("change", S.change(F.col(pre), F.col(post), method))
    out = with_totals(out, mean_=F.avg("change"), std_=F.stddev_pop("change"))
    low, high = F.col("mean_") - sigmas * F.col("std_"), F.col("mean_") + sigmas * F.col("std_")
    return out.withColumn("change", F.when(F.col("change").isNotNull(), F.greatest(low, F.least(high, F.col("change"))))).drop("mean_", "std_")


def changed(change: Column, sensor: str, threshold: float = 0.15, method: str = "difference") -> tuple[Column, Column]:
    """(changed, confidence): radar falls, optical moves either way."""
    if sensor == "sar":
        edge = 1 - threshold if method == "ratio" else -threshold
        size = (1 - change if method == "ratio" else -change) / (3 * threshold)
        return F.coalesce(change < edge, F.lit(False)), clip(size, 0, 1)
    return F.coalesce(F.abs(change) > threshold, F.lit(False)), clip(F.abs(change) / (3 * threshold), 0, 1)


def burn(px: DataFrame, nir_pre: str, swir_pre: str, nir_post: str, swir_post: str) -> DataFrame:
    """dnbr, severity and confidence of burning between two dates."""
    d = S.nbr(F.col(nir_pre), F.col(swir_pre)) - S.nbr(F.col(nir_post), F.col(swir_post))
    return burn_severity(px.withColumn("dnbr", d))


def burn_severity(px: DataFrame, dnbr: str = "dnbr") -> DataFrame:
    d = F.col(dnbr)
    confidence = F.when(d >= 0.10, 0.5 + 0.5 * clip((d - 0.10) / 0.56, 0, 1)).otherwise(clip((0.10 - d) / 0.20, 0, 1))
    return px.withColumn("severity", S.dnbr_severity(d)).withColumn("burned", F.coalesce(d >= 0.10, F.lit(False))).withColumn("confidence", F.when(d.isNotNull(), confidence))


def hot_spots(px: DataFrame, kelvin: str, threshold: float = 320.0, saturation: float = 360.0) -> DataFrame:
    """Fires by brightness temperature alone."""
    t = F.col(kelvin)
    return px.withColumn("fire", F.coalesce(t > threshold, F.lit(False))).withColumn("confidence", clip((t - (threshold + 10)) / (saturation - threshold - 10), 0, 1))


def radiative_power(px: DataFrame, kelvin: str, pixel_m: float = 375.0) -> DataFrame:
    """Megawatts of each fire over the median temperature of the rest; 0 elsewhere."""
    out = with_totals(px, background_=F.median(F.when(~F.col("fire"), F.col(kelvin))))
    return out.withColumn("frp", F.when(F.col("fire"), F.coalesce(S.fire_radiative_power(F.col(kelvin), F.col("background_"), pixel_m), F.lit(0.0))).otherwise(0.0)).drop("background_")


def wind_damage(px: DataFrame, vi_pre: str, vi_post: str, loss: float = -0.2, least_vi: float = 0.3) -> DataFrame:
    """Loss of vegetation where there was some."""
    d = F.col(vi_post) - F.col(vi_pre)
    green = F.col(vi_pre) >= least_vi
    return (
        px.withColumn("damaged", F.coalesce((d <= loss) & green, F.lit(False)))
        .withColumn("severity", F.when(green & d.isNotNull(), S.wind_severity(d)).otherwise(0))
        .withColumn("confidence", F.when(green, 0.7 * clip(-d / (2 * abs(loss)), 0, 1) + 0.3 * clip((F.col(vi_pre) - 0.1) / 0.9, 0, 1)))
    )


def structural_score(brightness: Column, texture: Column, coherence: Column | None = None) -> Column:
    base = 0.4 * brightness + 0.6 * texture
    return base if coherence is None else 0.7 * base + 0.3 * coherence


def damage_grade(score: Column, grades: int = 4, low: float = 0.15, high: float = 0.7) -> Column:
    """0 to grades: how many of the evenly spaced thresholds are reached."""
    out, span = F.lit(0), float(Decimal(str(high)) - Decimal(str(low)))  # 0.55 for 0.7 and 0.15, not a double's 0.5499999999999999
    for i in range(grades):
        at = high if i and i == grades - 1 else low + span * i / max(1, grades - 1)
        out = out + (score >= at).cast("int")
    return F.when(score.isNotNull(), out)


def detection_statistics(px: DataFrame, flag: str, valid: str, pixel_m: float = 10.0) -> DataFrame:
    """One row: total, valid and detected cells, area_ha, percent, mean_confidence."""
    ok, hit = F.col(valid).isNotNull(), F.col(flag)
    n = F.count(F.when(hit & ok, 1))
    return px.agg(
        F.count("*").alias("total_pixels"), F.count(F.when(ok, 1)).alias("valid_pixels"), n.alias("detected_pixels"),
        (n * (pixel_m * pixel_m / 1e4)).alias("area_ha"), F.when(F.count(F.when(ok, 1)) > 0, 100.0 * n / F.count(F.when(ok, 1))).alias("percent"),
        F.avg(F.when(hit, F.col("confidence"))).alias("mean_confidence"),
    )


def hand_susceptibility(hand: Column, slope: Column, most: float = 10.0, slope_weight: float = 0.3) -> tuple[Column, Column]:
    """(susceptible, confidence) from the height above the nearest drainage and the slope in degrees."""
    return F.coalesce(hand <= most, F.lit(False)), (1 - slope_weight) * clip(1 - hand / most, 0, 1) + slope_weight * clip(1 - slope / 20, 0, 1)
