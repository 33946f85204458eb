"""Tile tables, time stacks, GeoJSON, item catalogues and storage addresses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def write_tiles(px: DataFrame, path: str, size: int, mode: str = "error") -> None:
    """Cells as Parquet partitioned by tile row and column: a window reads only its tiles."""
    tiled = px.withColumn("tile_row", F.floor(F.col("row") / size).cast("int")).withColumn("tile_col", F.floor(F.col("col") / size).cast("int"))
    tiled.repartition("tile_row", "tile_col").write.mode(mode).partitionBy("tile_row", "tile_col").parquet(path)


def read_window(spark: SparkSession, path: str, size: int, row: int, row_end: int, col: int, col_end: int) -> DataFrame:
    """The cells of a half-open window: partition pruning by tile, then pushed-down bounds."""
    t = spark.read.parquet(path)
    t = t.where(f"tile_row between {row // size} and {(row_end - 1) // size} and tile_col between {col // size} and {(col_end - 1) // size}")
    return t.where(f"row >= {row} and row < {row_end} and col >= {col} and col < {col_end}").drop("tile_row", "tile_col")


def append_timestep(px: DataFrame, path: str, ts: str) -> None:
    """A scene added to a stack of scenes by day; other days aren't rewritten."""
    px.withColumn("ts", F.lit(ts).cast("timestamp_ntz")).withColumn("day", F.to_date("ts")).write.mode("append").partitionBy("day").parquet(path)


def chunks(size_bytes: Column, chunk_mb: int) -> Column:
    return F.ceil(size_bytes / (chunk_mb * 1024 * 1024))


def to_geojson(rows: DataFrame, x: str, y: str, properties: list[str]) -> DataFrame:
    """value: a GeoJSON point feature for each row, a line of text."""
    geometry = F.struct(F.lit("Point").alias("type"), F.array(x, y).alias("coordinates"))
    return rows.select(F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), F.struct(*properties).alias("properties"))).alias("value"))


def from_geojson(lines: DataFrame, properties: str) -> DataFrame:
    """The properties and x, y of GeoJSON point features; a line that doesn't parse gives NULLs."""
    schema = f"type string, geometry struct<type: string, coordinates: array<double>>, properties struct<{', '.join(p.strip().replace(' ', ': ', 1) for p in properties.split(','))}>"
    return lines.select(F.from_json("value", schema).alias("f")).select("f.properties.*", F.col("f.geometry.coordinates")[0].alias("x"), F.col("f.geometry.coordinates")[1].alias("y"))


def items(rows: DataFrame, collection: str) -> DataFrame:
    """value: a catalogue item (id, bbox, datetime, properties) as JSON for each row of key, west, south, east, north, t0."""
    return rows.select(F.to_json(F.struct(F.lit("Feature").alias("type"), F.col("key").cast("string").alias("id"), F.lit(collection).alias("collection"), F.array("west", "south", "east", "north").alias("bbox"), F.struct(F.date_format("t0", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("datetime")).alias("properties"))).alias("value"))


def parse_uri(uri: Column) -> tuple[Column, Column, Column]:
    """scheme (file where there's none), bucket and key of a storage address."""
    pattern = r"^([a-z0-9]+)://([^/]*)/?(.*)$"
    scheme = F.regexp_extract(uri, pattern, 1)
    plain = scheme == ""
    return F.when(plain, "file").otherwise(scheme), F.when(plain, "").otherwise(F.regexp_extract(uri, pattern, 2)), F.when(plain, uri).otherwise(F.regexp_extract(uri, pattern, 3))


def violations(df: DataFrame, rules: dict[str, Column], key: str) -> DataFrame:
    """key, rule of each row for which a rule doesn't hold, or is unknown: a schema check as data."""
    broken = F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()])
    return df.select(key, F.explode(F.filter(broken, lambda x: x.isNotNull())).alias("rule"))
