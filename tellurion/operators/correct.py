"""Radiometric corrections of pixel tables; band statistics are one-row aggregates put beside the cells."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tellurion.functions.base import clip

from .zonal import with_group_totals, with_totals


def dark_object(px: DataFrame, band: str, percentile: float = 0.01, factor: float = 1.0) -> DataFrame:
    """Takes a band's dark percentile off, no cell going under 0."""
    out = with_totals(px, dark_=F.percentile(band, F.lit(percentile)))
    return out.withColumn(band, F.when(F.col(band).isNotNull(), F.greatest(F.lit(0.0), F.col(band) - factor * F.col("dark_")))).drop("dark_")


def improved_factor(wavelength: float) -> float:
    return 1 + 0.01 * (550 / wavelength) ** 4


def cosine_transmittance(px: DataFrame, band: str, sun_cosine: float, transmittance: float) -> DataFrame:
    out = dark_object(px, band)
    return out.withColumn(band, clip(F.col(band) / sun_cosine / transmittance, 0, 1))


def match_percentiles(px: DataFrame, band: str, reference: str, low: float = 0.02, high: float = 0.98) -> DataFrame:
    """A linear map of the band's percentiles onto the reference's."""
    p = lambda c, q: F.percentile(c, F.lit(q))
    out = with_totals(px, a0=p(band, low), a1=p(band, high), b0=p(reference, low), b1=p(reference, high))
    scale = F.when(F.col("a1") > F.col("a0"), (F.col("b1") - F.col("b0")) / (F.col("a1") - F.col("a0"))).otherwise(1.0)
    return out.withColumn("matched", F.col("b0") + (F.col(band) - F.col("a0")) * scale).drop("a0", "a1", "b0", "b1")


def invariant(px: DataFrame, band: str, reference: str, threshold: float = 0.95) -> DataFrame:
    """Cells whose relative difference from the reference is under 1 - threshold."""
    return px.where(F.abs(F.col(band) - F.col(reference)) < (1 - threshold) * F.abs(F.col(reference)))


def invariant_regression(px: DataFrame, band: str, reference: str, threshold: float = 0.95, least: int = 100) -> DataFrame:
    """normalized: gain and offset from invariant cells, or percentile matching where those are fewer than least."""
    fit = invariant(px, band, reference, threshold).agg(F.count("*").alias("n_"), F.regr_slope(reference, band).alias("gain_"), F.regr_intercept(reference, band).alias("offset_"))
    out = match_percentiles(px, band, reference).crossJoin(F.broadcast(fit))
    return out.withColumn("normalized", F.when(F.col("n_") >= least, F.col(band) * F.col("gain_") + F.col("offset_")).otherwise(F.col("matched"))).drop("matched", "n_", "gain_", "offset_")


def relative(px: DataFrame, band: str, reference: str) -> DataFrame:
    """normalized: the band's z-scores on the reference's mean and spread."""
    out = with_totals(px, ma=F.avg(band), sa=F.stddev_pop(band), mb=F.avg(reference), sb=F.stddev_pop(reference))
    return out.withColumn("normalized", F.when(F.col("sa") > 0, (F.col(band) - F.col("ma")) / F.col("sa") * F.col("sb") + F.col("mb")).otherwise(F.col("mb"))).drop("ma", "sa", "mb", "sb")


def group_stretch(px: DataFrame, keys: list[str], value: str, low: float = 0.02, high: float = 0.98) -> DataFrame:
    """stretched: 0 to 1 between two percentiles of the cell's group."""
    out = with_group_totals(px, keys, lo_=F.percentile(value, F.lit(low)), hi_=F.percentile(value, F.lit(high)))
    return out.withColumn("stretched", clip(F.when(F.col("hi_") > F.col("lo_"), (F.col(value) - F.col("lo_")) / (F.col("hi_") - F.col("lo_"))), 0, 1)).drop("lo_", "hi_")
