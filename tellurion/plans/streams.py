"""Queries of event streams, in their batch form, and one as a stream that takes what is there."""

from __future__ import annotations

from pyspark.sql import functions as F

from tellurion.functions.base import rounded
from tellurion.sources import catalog as sources
from tellurion.sources.shared import new_path
from tellurion.streaming import windows

from .fixtures import px_static, table
from .registry import query


def r(name, expr, digits=6):
    return rounded(expr, digits).alias(name)


@query("select time_bucket(interval '6 hours', ts, timestamp '1970-01-01') as start, event_type, count(*) as n, round(avg(value), 6) as mean, max(value) as max from events group by 1, 2")
def stream_tumbling(spark, d):
    t = windows.tumbling(table(spark, d, "events"), "6 hours", ["event_type"])
    return t.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", r("mean", F.col("mean")), "max")


@query("with s as (select unnest([time_bucket(interval '6 hours', ts, timestamp '1970-01-01'), time_bucket(interval '6 hours', ts, timestamp '1970-01-01') - interval '6 hours']) as start, event_type from events) select start, event_type, count(*) as n from s group by 1, 2")
def stream_sliding(spark, d):
    t = windows.tumbling(table(spark, d, "events"), "12 hours", ["event_type"], slide="6 hours")
    return t.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query("with l as (select user_id, ts, case when ts < lag(ts) over (partition by user_id order by ts) + interval '4 hours' then 0 else 1 end as new from events), s as (select *, sum(new) over (partition by user_id order by ts rows unbounded preceding) as k from l) select user_id, min(ts) as start, max(ts) + interval '4 hours' as end, count(*) as n from s group by user_id, k")
def stream_sessions(spark, d):
    s = windows.sessions(table(spark, d, "events"), "4 hours", ["user_id"])
    return s.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")


@query("select distinct user_id, event_type from events")
def stream_distinct(spark, d):
    return windows.distinct(table(spark, d, "events"), ["user_id", "event_type"]).select("user_id", "event_type")


@query("select event_id, user_id, c_mktsegment as segment from events left join customer on user_id = c_custkey")
def stream_enrich(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("segment"))
    return windows.enriched(table(spark, d, "events"), c, "user_id").select("event_id", "user_id", "segment")


@query("select time_bucket(interval '1 day', ts, timestamp '1970-01-01') as start, user_id, count(*) as n from events group by 1, 2 having count(*) > 5")
def rate_limits(spark, d):
    return windows.over_limit(table(spark, d, "events"), ["user_id"], 5, "1 day").select(F.col("start").cast("timestamp_ntz").alias("start"), "user_id", "n")


@query("with m as (select user_id, ts, event_id, case when value > 60 then 'EMERGENCY' when value > 30 then 'PARTIAL' else 'FULL' end as m from events), l as (select *, lag(m) over (partition by user_id order by ts, event_id) as p from m) select user_id, ts as at, p as from_mode, m as to_mode from l where p <> m")
def mode_changes(spark, d):
    v = F.col("value")
    return windows.mode_changes(table(spark, d, "events"), ["user_id"], F.when(v > 60, "EMERGENCY").when(v > 30, "PARTIAL").otherwise("FULL"))


@query("select event_type, count(*) as n, round(sum(value), 4) as total from events group by 1")
def stream_available_now(spark, d):
    """The events through Structured Streaming once, de-duplicated by id, then summed from the sink."""
    folder = new_path(spark, "stream")
    events = table(spark, d, "events")
    out = windows.run_available(spark, f"{d}/events.parquet*", events.schema, lambda s: s.select("event_id", "event_type", "value", F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", "1 hour").dropDuplicatesWithinWatermark(["event_id"]), f"{folder}/out", f"{folder}/state")
    return out.groupBy("event_type").agg(F.count("*").alias("n"), r("total", F.sum("value"), 4))


@query("select row, col, elev from px_static where row // 8 = 1 and col // 8 between 0 and 2", "px_static")
def tile_window_read(spark, d):
    """A window of a raster written as a partitioned tile table and read back: only the partitions it touches are scanned."""
    path = new_path(spark, "tiles")
    sources.write_tiles(px_static(spark, d).select("row", "col", "elev"), path, 8)
    return sources.read_window(spark, path, 8, 8, 16, 0, 24).select("row", "col", "elev")


@query("select c_custkey as id, c_mktsegment as name, (c_custkey % 360 - 180)::double as x, (c_custkey * 7 % 170 - 85)::double as y from customer")
def geojson_round_trip(spark, d):
    """Points written as a GeoJSON text and parsed back."""
    k = F.col("c_custkey")
    points = table(spark, d, "customer").select(k.alias("id"), F.col("c_mktsegment").alias("name"), (k % 360 - 180).cast("double").alias("x"), (k * 7 % 170 - 85).cast("double").alias("y"))
    return sources.from_geojson(sources.to_geojson(points, "x", "y", ["id", "name"]), "id bigint, name string")


@query("select c_custkey as id, 's3' as scheme, 'b' || (c_custkey % 7) as bucket, 'a/' || c_custkey || '.tif' as key from customer")
def storage_uris(spark, d):
    uris = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.concat(F.lit("s3://b"), (F.col("c_custkey") % 7).cast("string"), F.lit("/a/"), F.col("c_custkey").cast("string"), F.lit(".tif")).alias("uri"))
    scheme, bucket, key = sources.parse_uri(F.col("uri"))
    return uris.select("id", scheme.alias("scheme"), bucket.alias("bucket"), key.alias("key"))
