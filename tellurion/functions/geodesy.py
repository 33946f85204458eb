"""Boxes, tiles and zones from longitude and latitude."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0088
EQUATOR_M = 40075016.68557849


def boxes_intersect(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """(west, south, east, north) of each; a box whose west is over its east goes across the antimeridian."""
    aw, as_, ae, an = a
    bw, bs, be, bn = b
    lat = (as_ <= bn) & (an >= bs)
    plain = (aw <= be) & (ae >= bw)
    lon = F.when((aw > ae) & (bw > be), True).when(aw > ae, (aw <= be) | (ae >= bw)).when(bw > be, (bw <= ae) | (be >= aw)).otherwise(plain)
    return lat & lon


def box_contains(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    return (a[0] <= b[0]) & (a[1] <= b[1]) & (a[2] >= b[2]) & (a[3] >= b[3])


def overlap_area(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Square degrees, 0 for boxes apart."""
    w = F.least(a[2], b[2]) - F.greatest(a[0], b[0])
    h = F.least(a[3], b[3]) - F.greatest(a[1], b[1])
    return F.when((w > 0) & (h > 0), w * h).otherwise(0.0)


def box_area_km2(west: Column, south: Column, east: Column, north: Column) -> Column:
    return F.round(EARTH_KM * EARTH_KM * F.abs(F.sin(F.radians(north)) - F.sin(F.radians(south))) * F.abs(F.radians(east) - F.radians(west)), 2)


def tile_x(lon: Column, zoom: int) -> Column:
    n = 1 << zoom
    return F.greatest(F.lit(0), F.least(F.lit(n - 1), F.floor((lon + 180) / 360 * n).cast("int")))


def tile_y(lat: Column, zoom: int) -> Column:
    n = 1 << zoom
    rad = F.radians(F.greatest(F.lit(-85.0511), F.least(F.lit(85.0511), lat)))
    return F.greatest(F.lit(0), F.least(F.lit(n - 1), F.floor((1 - F.asinh(F.tan(rad)) / math.pi) / 2 * n).cast("int")))


def tile_north(y: Column, zoom: int) -> Column:
    return F.degrees(F.atan(F.sinh(math.pi * (1 - 2 * y / (1 << zoom)))))


def tile_west(x: Column, zoom: int) -> Column:
    return x / (1 << zoom) * 360 - 180


def metres_per_pixel(lat: Column, zoom: Column | int, tile: int = 256) -> Column:
    return EQUATOR_M * F.cos(F.radians(lat)) / (tile * F.pow(F.lit(2.0), F.lit(zoom) if isinstance(zoom, int) else zoom))


def zoom_for_resolution(resolution: Column, lat: Column, tile: int = 256, most: int = 24) -> Column:
    """The least zoom with pixels as fine as resolution."""
    z = F.ceil(F.log2(EQUATOR_M * F.cos(F.radians(lat)) / (tile * resolution)))
    return F.greatest(F.lit(0), F.least(F.lit(most), z.cast("int")))


def utm_epsg(lon: Column, lat: Column) -> Column:
    """EPSG code of the UTM zone, with the exceptions of Norway and Svalbard."""
    zone = F.least(F.lit(60), F.floor((lon + 180) / 6).cast("int") + 1)
    svalbard = (lat >= 72) & (lat < 84)
    zone = (
        F.when((lat >= 56) & (lat < 64) & (lon >= 3) & (lon < 12), 32)
        .when(svalbard & (lon >= 0) & (lon < 9), 31).when(svalbard & (lon >= 9) & (lon < 21), 33)
        .when(svalbard & (lon >= 21) & (lon < 33), 35).when(svalbard & (lon >= 33) & (lon < 42), 37).otherwise(zone)
    )
    return (F.when(lat < 0, 32700).otherwise(32600) + zone).cast("int")


def to_metres(value: Column, unit: str, lat: Column) -> Column:
    if unit == "metre":
        return value
    if unit == "degree":
        return value * 111_320 * F.cos(F.radians(lat))
    if unit == "foot":
        return value * 0.3048
    if unit == "arcsecond":
        return value / 3600 * 111_320 * F.cos(F.radians(lat))
    raise ValueError(f"unit {unit!r} isn't supported")


def distance_km(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Equirectangular."""
    x = F.radians(lon2 - lon1) * F.cos(F.radians((lat1 + lat2) / 2))
    return EARTH_KM * F.sqrt(x * x + F.pow(F.radians(lat2 - lat1), 2))
