"""Indices, change measures and confidences of single cells."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .base import clip, ratio, steps


def normalized_difference(a: Column, b: Column, least: float = 0.0, otherwise: float | None = 0.0) -> Column:
    """(a - b) / (a + b), clipped to -1..1."""
    return clip(ratio(a - b, a + b, least, otherwise), -1, 1)


def ndwi(green: Column, nir: Column) -> Column:
    return F.when(green + nir > 1e-6, normalized_difference(green, nir, 1e-6, None))


def nbr(nir: Column, swir: Column) -> Column:
    return normalized_difference(nir, swir)


def ndvi(nir: Column, red: Column) -> Column:
    return ratio(nir - red, nir + red, 0.0, 0.0)


def evi(red: Column, nir: Column, blue: Column, gain: float = 2.5, c1: float = 6.0, c2: float = 7.5, offset: float = 1.0) -> Column:
    return clip(gain * ratio(nir - red, nir + c1 * red - c2 * blue + offset, 0.0, 0.0), -1, 1)


def bai(red: Column, nir: Column) -> Column:
    """Burned area index, capped at 1000."""
    d = F.pow(0.1 - red, 2) + F.pow(0.06 - nir, 2)
    return F.least(ratio(F.lit(1.0), d, 0.0, 1000.0), F.when(d.isNotNull(), F.lit(1000.0)))


def mirbi(nir: Column, swir: Column) -> Column:
    return 10 * swir - 9.8 * nir + 2


def sar_confidence(db: Column, threshold: float) -> Column:
    return clip((threshold - db) / abs(threshold), 0, 1)


def index_confidence(x: Column, threshold: float) -> Column:
    return clip(0.5 + 0.5 * (x - threshold) / (1 - threshold), 0, 1)


def change(pre: Column, post: Column, method: str) -> Column:
    """difference, ratio (of post to pre, which counts as 1e-6 at least) or normalized_difference."""
    if method == "difference":
        return post - pre
    if method == "ratio":
        return F.when(pre.isNotNull(), post / F.greatest(pre, F.lit(1e-6)))
    if method == "normalized_difference":
        return ratio(post - pre, F.abs(post) + F.abs(pre), 1e-6, 0.0)
    raise ValueError(f"change method {method!r} isn't supported")


def dnbr_severity(d: Column) -> Column:
    """0 unburned, 1 regrowth, 2 low, 3 moderate-low, 4 moderate-high, 5 high."""
    return steps(d, [-0.10, 0.10, 0.27, 0.44, 0.66], [1, 0, 2, 3, 4], 5)


def wind_severity(vi_change: Column) -> Column:
    """0 none, 1 minor, 2 moderate, 3 severe loss of vegetation."""
    return F.when(vi_change.isNull(), None).when(vi_change <= -0.4, 3).when(vi_change <= -0.2, 2).when(vi_change <= -0.1, 1).otherwise(0)


def brightness_temperature(radiance: Column, wavelength_um: float) -> Column:
    """Kelvin, by Planck's law turned round; NULL for no radiance."""
    c1, c2 = 1.191042e8, 1.4387774e4  # fixed values
    return F.when(radiance > 0, c2 / (wavelength_um * F.log(c1 / (wavelength_um**5 * radiance) + 1)))


def fire_radiative_power(kelvin: Column, background: Column, pixel_m: float, emissivity: float = 0.98) -> Column:
    """Megawatts of a pixel, not under 0."""
    return F.greatest(F.lit(0.0), pixel_m * pixel_m * 5.67e-8 * emissivity * (F.pow(kelvin, 4) - F.pow(background, 4)) / 1e6)


def illumination(slope: Column, aspect: Column, zenith: float, azimuth: float) -> Column:
    """Cosine of the angle of incidence on a slope (radians), at least 0.001."""
    import math

    return F.when(slope.isNotNull() & aspect.isNotNull(), F.greatest(F.lit(0.001), F.cos(slope) * math.cos(zenith) + F.sin(slope) * math.sin(zenith) * F.cos(F.lit(azimuth) - aspect)))


def terrain_correction(value: Column, cos_i: Column, slope: Column, zenith: float, method: str, k: float = 0.5, c: float = 0.5) -> Column:
    """cosine, minnaert, c or scs."""
    import math

    z = math.cos(zenith)
    if method == "cosine":
        return value * z / cos_i
    if method == "minnaert":
        return value * F.pow(z / cos_i, k)
    if method == "c":
        return value * (z + c) / (cos_i + c)
    if method == "scs":
        return value * z * F.cos(slope) / cos_i
    raise ValueError(f"terrain correction {method!r} isn't supported")


def top_of_atmosphere(value: Column, sun_zenith: float, scale: float = 1e4) -> Column:
    import math

    return clip(value / scale / math.cos(sun_zenith), 0, 1)


def transmittance(wavelength: float, optical_depth: float, sun_zenith: float, view_zenith: float) -> float:
    import math

    return math.exp(-optical_depth * (wavelength / 550) ** -1.4 * (1 / math.cos(sun_zenith) + 1 / math.cos(view_zenith)))
