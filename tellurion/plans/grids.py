"""Queries of tiles, grids, terrain, gaps, scenarios and functions of the user's own."""

from __future__ import annotations

from pyspark.sql import functions as F

from tellurion.functions.base import rounded
from tellurion.operators import focal, graph, timeline
from tellurion.operators import grids as G
from tellurion.operators import validate as V

from .fixtures import boxes, candidates, members, px_bands, px_layers, px_pre_post, px_static, series, table
from .registry import query
from .spatial import _DAG, _dag

CELL = ["row", "col"]


def r(name, expr, digits=6):
    return rounded(expr, digits).alias(name)


@query("select key, floor(floor((85 - south) / 0.5) / 16)::int as tile_row, floor(floor((west + 180) / 0.5) / 16)::int as tile_col from boxes", "boxes")
def tile_at_point(spark, d):
    return boxes(spark, d).select("key", G.tile_of(F.col("west"), F.col("south"), -180.0, 85.0, 0.5, 16).alias("t")).select("key", "t.*")


_TILES = "t as (select distinct (row // 6)::int as tile_row, (col // 9)::int as tile_col from px_static where elev > 20)"


@query(f"with {_TILES} select a.tile_row, a.tile_col, b.tile_row as next_row, b.tile_col as next_col from t a join t b on abs(a.tile_row - b.tile_row) <= 1 and abs(a.tile_col - b.tile_col) <= 1 and (a.tile_row <> b.tile_row or a.tile_col <> b.tile_col)", "px_static")
def tile_neighbours(spark, d):
    t = px_static(spark, d).where("elev > 20").select(F.floor(F.col("row") / 6).cast("int").alias("tile_row"), F.floor(F.col("col") / 9).cast("int").alias("tile_col")).distinct()
    return G.tile_neighbours(t).select("tile_row", "tile_col", "next_row", "next_col")


@query("with x as (select dataset_id, (dataset_id % 5000 + 100)::int as w, (dataset_id * 7 % 9000 + 200)::int as h from candidates) select dataset_id, array_to_string(list_filter([2, 4, 8, 16, 32, 64, 128], lambda f: least(w, h) // f >= 256), ',') as factors from x", "candidates")
def overview_factors(spark, d):
    k = F.col("dataset_id")
    f = G.overview_factors((k % 5000 + 100).cast("int"), (k * 7 % 9000 + 200).cast("int"))
    return candidates(spark, d).select("dataset_id", F.concat_ws(",", f.cast("array<string>")).alias("factors"))


@query("with p as (select row, col, elev, row % 20 as y, col % 25 as x from px_static) select row, col, round(least(1, y / 3, (19 - y) / 3), 6) as linear, round((1 - cos(least(1, x / 4, (24 - x) / 4) * pi())) / 2, 6) + 0.0 as feather, round(exp(-(power(2 * y / 19 - 1, 2) + power(2 * x / 19 - 1, 2)) / 0.5), 6) as bell from p", "px_static")
def blend_masks(spark, d):
    y, x = F.col("row") % 20, F.col("col") % 25
    return px_static(spark, d).select(*CELL, r("linear", G.ramp(y, 20, 4)), r("feather", G.ramp(x, 25, 5, "feather")), r("bell", G.bell(y, x, 20)))


@query("with v as (select row, col, elev, (elev - (select avg(elev) from px_static)) as m from px_static) select row, col, round(2 * elev + 1, 6) as value from v", "px_static")
def tiled_model(spark, d):
    def model(cells):
        out = cells[["row", "col"]].copy()
        out["value"] = 2 * cells["elev"] + 1
        return out

    tiled = focal.to_tiles(px_static(spark, d), 10, 2)
    return G.predict_tiles(tiled, model, "row int, col int, value double", "value", 10, 2).select(*CELL, r("value", F.col("value")))


@query("select (row // 8)::int as tile_row, (col // 8)::int as tile_col, round(stddev_pop(elev) + 1, 6) as spread from px_static group by 1, 2", "px_static")
def array_udf(spark, d):
    import numpy as np

    spread = G.array_function(G.composed(lambda v: float(np.std(v)), before=lambda v: np.asarray(v, float), after=lambda v: v + 1))
    t = focal.to_tiles(px_static(spark, d), 8).groupBy("tile_row", "tile_col").agg(F.sort_array(F.collect_list("elev")).alias("v"))  # a tile's cells
    return t.select("tile_row", "tile_col", r("spread", spread("v")))


@query("select dataset_id, array_to_string(list_filter([case when not coalesce(cloud <= 60, false) then 'clouds' end, case when not coverage >= 40 then 'coverage' end, case when not resolution_m <= 70 then 'resolution' end], lambda x: x is not null), ',') as failed from candidates", "candidates")
def registered_rules(spark, d):
    rules = G.Registry()
    rules.register("clouds", F.col("cloud") <= 60, kind="optical")
    rules.register("resolution", F.col("resolution_m") <= 70)
    rules.register("coverage", F.col("coverage") >= 40)
    return rules.failures(candidates(spark, d)).select("dataset_id", F.concat_ws(",", "failed").alias("failed"))


@query("with e as (select min(row) as t, max(row) as b, min(col) as l, max(col) as r from px_static), n as (select a.row, a.col, count(*) as higher from px_static a join px_static b on abs(a.row - b.row) <= 1 and abs(a.col - b.col) <= 1 and b.elev > a.elev group by 1, 2), x as (select row, col, 1 + coalesce(higher, 0) as accumulation from px_static left join n using (row, col)), q as (select quantile_cont(accumulation, 0.95) as cut from x) select row, col, accumulation from x cross join q where accumulation >= cut", "px_static")
def drainage_network(spark, d):
    return G.drainage(px_static(spark, d), "elev").where("channel").select(*CELL, "accumulation")


@query("with g as (select row, col from px_bands where green is null), n as (select g.row, g.col, arg_min(b.green, (power(g.row - b.row, 2) + power(g.col - b.col, 2), b.green)) as v from g join px_bands b on b.green is not null group by 1, 2) select row, col, round(v, 6) as filled from n", "px_bands")
def nearest_fill(spark, d):
    px = px_bands(spark, d).select(*CELL, "green")
    return G.fill_nearest(px, "green").where("green is null").select(*CELL, r("filled", F.col("filled")))


@query("with q as (select quantile_cont(brightness, 0.95) as cut from px_static) select row, col, round(brightness, 6) as brightness from px_static cross join q where brightness > cut", "px_static")
def percentile_hotspots(spark, d):
    return G.above_percentile(px_static(spark, d), "brightness").select(*CELL, r("brightness", F.col("brightness")))


@query("select a.row, a.col, round(avg(abs(b.pre - b.post)), 6) as residual, round(max(case when a.row = b.row and a.col = b.col then abs(b.pre - b.post) / abs(b.post) end), 6) as relative from px_pre_post a join px_pre_post b on abs(a.row - b.row) <= 2 and abs(a.col - b.col) <= 2 where b.pre is not null and b.post is not null group by 1, 2", "px_pre_post")
def residual_uncertainty(spark, d):
    px = G.residual(px_pre_post(spark, d), "pre", "post", 5).where("residual is not null")
    return px.select(*CELL, r("residual", F.col("residual")), r("relative", F.abs(F.col("pre") - F.col("post")) / F.abs("post")))


@query("with n as (select a.row, a.col, count(b.elev) as n, sum((b.col - a.col) * b.elev / 2) as gx, sum((b.row - a.row) * b.elev / 2) as gy from px_static a join px_static b on abs(a.row - b.row) + abs(a.col - b.col) = 1 group by 1, 2), g as (select row, sqrt(gx * gx + gy * gy) as g from n where n = 4), m as (select avg(g) filter (row % 8 = 0 and row > 0) as a, avg(g) filter (not (row % 8 = 0 and row > 0)) as b, stddev_pop(g) filter (not (row % 8 = 0 and row > 0)) as sd from g) select round(a, 6) as on_edge, round(b, 6) as elsewhere, round((a - b) / sd, 5) + 0.0 as z from m", "px_static")
def tile_boundaries(spark, d):
    s = V.steepness(px_static(spark, d), "elev").where("slope is not null").withColumn("g", F.tan(F.radians("slope")))
    return G.boundary_z(s, "g", 8).select(r("on_edge", F.col("on")), r("elsewhere", F.col("off")), r("z", F.col("z"), 5))


@query("select key, case when west < -180 or east > 180 or south < -90 or north > 90 then 'out_of_range' when west >= east or south >= north then 'empty' when east - west >= 360 and north - south >= 180 then 'whole_earth' end as issue from (select key, west - case when key % 17 = 0 then 10 else 0 end as west, east, south, case when key % 13 = 0 then south else north end as north from boxes)", "boxes")
def geographic_bounds(spark, d):
    k = F.col("key")
    b = boxes(spark, d).withColumn("west", F.col("west") - F.when(k % 17 == 0, 10).otherwise(0)).withColumn("north", F.when(k % 13 == 0, F.col("south")).otherwise(F.col("north")))
    return G.bounds_issues(b).select("key", "issue")


@query("select key, round(radians(west) * 6378137, 3) + 0.0 as x, round(ln(tan(pi() / 4 + radians(south) / 2)) * 6378137, 3) + 0.0 as y, round(west, 6) + 0.0 as lon, round(south, 6) + 0.0 as lat from boxes", "boxes")
def mercator_points(spark, d):
    b = boxes(spark, d).withColumn("m", G.web_mercator(F.col("west"), F.col("south"))).withColumn("back", G.from_web_mercator(F.col("m.x"), F.col("m.y")))
    return b.select("key", r("x", F.col("m.x"), 3), r("y", F.col("m.y"), 3), r("lon", F.col("back.lon")), r("lat", F.col("back.lat")))


@query("with a as (select row, col, elev, radians(10 + (col + 0.5) * 0.1) * 6378137 as x, ln(tan(pi() / 4 + radians(50 - (row + 0.5) * 0.1) / 2)) * 6378137 as y from px_static), b as (select *, floor((ln(tan(pi() / 4 + radians(50.0::double) / 2)) * 6378137 - y) / 15000)::int as r2, floor((x - radians(10.0::double) * 6378137) / 15000)::int as c2 from a) select r2 as row, c2 as col, arg_max(elev, (row, col)) as elev from b group by 1, 2", "px_static")
def mercator_raster(spark, d):
    return G.reprojected(px_static(spark, d), "elev", 10.0, 50.0, 0.1, 15000.0)


@query("with a as (select 'elev' as layer, (row // 4)::int as row, (col // 4)::int as col, avg(elev) as v from px_static group by all), b as (select 'value' as layer, (row // 2)::int as row, (col // 2)::int as col, avg(value) as v from px_layers group by all) select layer, row, col, round(v, 6) as value from (select * from a union all select * from b)", "px_static px_layers")
def aligned_layers(spark, d):
    return G.on_one_grid({"elev": (px_static(spark, d), "elev", 4), "value": (px_layers(spark, d), "value", 2)}).select("layer", *CELL, r("value", F.col("value")))


@query("select 'after' as layer, count(*) as missing from (select row, col from px_pre_post where pre is not null except select row, col from px_pre_post where post is not null) having count(*) > 0 union all select 'before', count(*) from (select row, col from px_pre_post where post is not null except select row, col from px_pre_post where pre is not null) having count(*) > 0", "px_pre_post")
def shape_check(spark, d):
    px = px_pre_post(spark, d)
    return G.shapes_differ({"before": px.where("pre is not null"), "after": px.where("post is not null")})


_COST = "cost as (select node, (1 + node % 7)::double as cost from (select u as node from dag union select v from dag))"


@query(f"with recursive {_DAG}, {_COST}, p as (select 0::bigint as node, 1.0::double as dist union select v, dist + c.cost from p join dag on p.node = dag.u join cost c on c.node = v) select round(max(dist), 6) as distance from p")
def critical_path(spark, d):
    edges = _dag(spark, d)
    nodes = edges.select(F.col("u").alias("node")).union(edges.select("v")).distinct().withColumn("cost", (1 + F.col("node") % 7).cast("double"))
    return graph.critical_path(edges, nodes).agg(r("distance", F.max("distance")))


@query(f"with {_DAG}, h as (select sha256(u || '>' || v) as h from dag), s as (select count(*) as n, sum(('0x' || h[1:8])::bigint::hugeint) as a, sum(('0x' || h[9:16])::bigint::hugeint) as b, sum(('0x' || h[17:24])::bigint::hugeint) as c, sum(('0x' || h[25:32])::bigint::hugeint) as d from h) select n, sha256(a || ',' || b || ',' || c || ',' || d) as hash from s")
def graph_hash(spark, d):
    return graph.fingerprint(_dag(spark, d))


@query(f"with recursive {_DAG}, p as (select 2::bigint as node union select v from p join dag on p.node = dag.u), n as (select u as node from dag union select v from dag) select node from n anti join p using (node)")
def cascade_delete(spark, d):
    edges = _dag(spark, d)
    nodes = edges.select(F.col("u").alias("node")).union(edges.select("v")).distinct()
    return graph.delete_with_dependents(edges, nodes, spark.range(2, 3).select(F.col("id").alias("node")))


# ---------------------------------------------------------------- forecasts


@query("select cell, round(max(value), 6) + 0.0 as highest, round(min(value), 6) + 0.0 as lowest, round(quantile_cont(value, 0.9), 6) + 0.0 as p90, round(max(value) filter (member = 3), 6) + 0.0 as third from members group by 1", "members")
def member_scenarios(spark, d):
    m = members(spark, d)
    one = lambda kind, name: G.scenario(m, ["cell"], "member", "value", kind, 0.9, 3).withColumnRenamed("scenario", name)
    out = one("highest", "highest").join(one("lowest", "lowest"), "cell").join(one("percentile", "p90"), "cell").join(one("member", "third"), "cell")
    return out.select("cell", *[r(n, F.col(n)) for n in ("highest", "lowest", "p90", "third")])


@query("with s as (select cell, avg(value) as m, stddev_samp(value) as spread, max(value) filter (member = 0) as o from members group by 1), v as (select cell % 4 as variable, sqrt(avg(power(m - o, 2))) as rmse, corr(m, o) as c, abs(avg(m - o)) as bias, avg(spread) as spread from s group by 1) select round(avg(rmse), 6) as rmse, round(avg(c), 6) + 0.0 as correlation, round(avg(bias), 6) as bias, round(avg(spread), 6) as spread, round(avg(spread) / avg(rmse), 6) as spread_skill from v", "members")
def ensemble_skill(spark, d):
    s = members(spark, d).groupBy("cell").agg(F.avg("value").alias("m"), F.stddev_samp("value").alias("spread"), F.max(F.when(F.col("member") == 0, F.col("value"))).alias("o"))
    e = F.col("m") - F.col("o")
    v = s.groupBy(F.col("cell") % 4).agg(F.sqrt(F.avg(e * e)).alias("rmse"), F.corr("m", "o").alias("c"), F.abs(F.avg(e)).alias("bias"), F.avg("spread").alias("spread"))
    return v.agg(r("rmse", F.avg("rmse")), r("correlation", F.avg("c")), r("bias", F.avg("bias")), r("spread", F.avg("spread")), r("spread_skill", F.avg("spread") / F.avg("rmse")))


@query("select key, t0::date as begins from boxes where west >= -60 and east <= 60 and south >= -40 and north <= 40 and t0 >= timestamp '1995-01-01' and t0 <= timestamp '1997-12-31'", "boxes")
def forecast_slice(spark, d):
    inside = F.col("west").between(-60, 60) & (F.col("east") <= 60) & (F.col("south") >= -40) & (F.col("north") <= 40)
    return boxes(spark, d).where(inside & F.col("t0").between(F.lit("1995-01-01").cast("timestamp_ntz"), F.lit("1997-12-31").cast("timestamp_ntz"))).select("key", F.to_date("t0").alias("begins"))


@query("with x as (select event_id, list_extract(['tp', 't2m', 'APCP', 'TMP', 'u10', 'other'], (event_id % 6 + 1)::int) as name, value from events) select event_id, case name when 'tp' then 'precipitation_mm' when 'APCP' then 'precipitation_mm' when 't2m' then 'temperature_c' when 'TMP' then 'temperature_c' when 'u10' then 'wind_u_ms' else name end as variable, round(case name when 'tp' then value * 1000 when 't2m' then value - 273.15::double when 'TMP' then value - 273.15::double else value end, 6) + 0.0 as value, case when value >= 60 then 'severe' when value >= 20 then 'moderate' else 'none' end as impact from x")
def forecast_variables(spark, d):
    e = table(spark, d, "events")
    name = F.element_at(F.array(*map(F.lit, ("tp", "t2m", "APCP", "TMP", "u10", "other"))), (F.col("event_id") % 6 + 1).cast("int"))
    e = e.withColumn("x", G.normalised(name, F.col("value")))
    return e.select("event_id", "x.variable", r("value", F.col("x.value")), G.impact_model([(20.0, "moderate"), (60.0, "severe")])(F.col("value")).alias("impact"))


@query("with t as (select entity, id, hours from series where sensor = 'purchase'), s as (select entity, hours as at, avg(value) as v from series where sensor = 'view' group by 1, 2), b as (select t.entity, t.id, t.hours, s.at as t0, s.v as v0 from t asof left join s on t.entity = s.entity and t.hours >= s.at), a as (select t.id, s.at as t1, s.v as v1 from t asof left join s on t.entity = s.entity and t.hours <= s.at) select b.id, round(coalesce(v0, v1), 6) as value, 0.4::double as quality from b join a using (id) where (t0 is null or t1 is null) and (t0 is not null or t1 is not null)", "series")
def extrapolated_values(spark, d):
    s = series(spark, d)
    found = timeline.as_of(s.where("sensor = 'purchase'").select("entity", "id", "hours"), s.where("sensor = 'view'").groupBy("entity", "hours").agg(F.avg("value").alias("value")), ["entity"])
    value, quality = G.extrapolated(found, F.lit(0.8))
    return found.withColumn("v", value).where("v is not null").select("id", r("value", F.col("v")), quality.alias("quality"))


@query("with o as (select row, col, source_id, floor(epoch_us(ts) / 8.64e10 / 365) as y, avg(value) as v from px_obs group by all), w as (select *, lag(v) over (partition by row, col order by y, source_id) as p from o), g as (select row, col, count(*) as n, avg(v) as mu, stddev_pop(v) as sd, count(*) filter (abs(v - p) > 25) as jumps, count(*) filter (v < p) as falls from w group by 1, 2) select row, col, n, jumps, falls, round(sd / mu, 6) as variation, jumps > 2 or falls > 0.6 * (n - 1) as suspect from g where n > 3", "px_obs")
def raster_series(spark, d):
    from pyspark.sql import Window

    from .fixtures import px_obs

    o = px_obs(spark, d).groupBy(*CELL, "source_id", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 8.64e10 / 365).alias("y")).agg(F.avg("value").alias("v"))
    w = o.withColumn("p", F.lag("v").over(Window.partitionBy(*CELL).orderBy("y", "source_id")))
    n = lambda c: F.count(F.when(c, 1))
    g = w.groupBy(*CELL).agg(F.count("*").alias("n"), F.avg("v").alias("mu"), F.stddev_pop("v").alias("sd"), n(F.abs(F.col("v") - F.col("p")) > 25).alias("jumps"), n(F.col("v") < F.col("p")).alias("falls")).where("n > 3")
    return g.select(*CELL, "n", "jumps", "falls", r("variation", F.col("sd") / F.col("mu")), ((F.col("jumps") > 2) | (F.col("falls") > 0.6 * (F.col("n") - 1))).alias("suspect"))


@query("with s as (select sensor, hours, avg(value) as v from series group by 1, 2), t as (select unnest(range(0, 745, 24))::double as hours), k as (select distinct sensor from s), x as (select k.sensor, t.hours from k cross join t), b as (select x.sensor, x.hours, s.hours as t0, s.v as v0 from x asof left join s on x.sensor = s.sensor and x.hours >= s.hours), a as (select x.sensor, x.hours, s.hours as t1, s.v as v1 from x asof left join s on x.sensor = s.sensor and x.hours <= s.hours) select sensor, hours, round(case when t0 is null then v1 when t1 is null then v0 when hours - t0 <= t1 - hours then v0 else v1 end, 6) as value from b join a using (sensor, hours)", "series")
def shared_timeline(spark, d):
    s = series(spark, d).groupBy("sensor", "hours").agg(F.avg("value").alias("value"))
    times = s.select("sensor").distinct().select("sensor", F.explode(F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: i * 24.0)).alias("hours"))
    return timeline.interpolate(timeline.as_of(times, s, ["sensor"]), "hours", "nearest").select("sensor", "hours", r("value", F.col("interpolated")))
