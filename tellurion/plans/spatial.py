"""Queries of neighbourhoods, regions, graphs, tiles and mosaics."""

from __future__ import annotations

from pyspark.sql import functions as F

from tellurion.functions.base import rounded
from tellurion.operators import focal, graph

from .fixtures import px_bands, px_layers, px_obs, px_pre_post, px_static, table
from .registry import query

CELL = ["row", "col"]


def r(name, expr, digits=6):
    return rounded(expr, digits).alias(name)


def _window(value, k, source, aggs):
    h = k // 2
    return f"select a.row, a.col, {aggs} from {source} a join {source} b on b.row between a.row - {h} and a.row + {h} and b.col between a.col - {h} and a.col + {h} group by a.row, a.col"


@query("with " + "w as (" + _window("elev", 5, "px_static", "avg(b.elev) as m, var_pop(b.elev) as v, min(b.elev) as lo, max(b.elev) as hi, count(b.elev) as n") + ") select row, col, n, round(m, 6) as mean, round(v, 8) + 0.0 as variance, lo as low, hi as high, round(case when m <> 0 then sqrt(greatest(v, 0)) / m end, 5) + 0.0 as cv from w", "px_static")
def focal_statistics(spark, d):
    s = focal.local_statistics(px_static(spark, d), "elev", 5, "none")
    return s.select(*CELL, F.col("n_").cast("bigint").alias("n"), r("mean", F.col("mean_")), r("variance", F.col("var_"), 8), F.col("low_").alias("low"), F.col("high_").alias("high"), r("cv", F.when(F.col("mean_") != 0, F.sqrt("var_") / F.col("mean_")), 5))


_MIRROR = "e as (select max(row) as mr, max(col) as mc from px_static), p as (select unnest(list_distinct([row, -row, 2 * mr - row])) as row, col, elev, mc from px_static cross join e), q as (select row, unnest(list_distinct([col, -col, 2 * mc - col])) as col, elev from p)"


@query(f"with {_MIRROR} select a.row, a.col, round(avg(b.elev), 6) as mean, round(sqrt(greatest(0, avg(b.elev * b.elev) - avg(b.elev) * avg(b.elev))), 5) + 0.0 as std from px_static a join q b on b.row between a.row - 1 and a.row + 1 and b.col between a.col - 1 and a.col + 1 group by 1, 2", "px_static")
def focal_mirror(spark, d):
    s = focal.local_statistics(px_static(spark, d), "elev", 3, "mirror")
    return s.select(*CELL, r("mean", F.col("mean_")), r("std", F.sqrt("var_"), 5))


@query("with k as (select row, col, 280 + elev as t from px_static), w as (select a.row, a.col, any_value(a.t) as t, count(b.t) as n, avg(b.t) as m, stddev_pop(b.t) as s from k a left join k b on b.row between a.row - 3 and a.row + 3 and b.col between a.col - 3 and a.col + 3 and (a.row <> b.row or a.col <> b.col) and b.t < 310 group by 1, 2) select row, col, case when n >= 3 then round(m, 6) end as background, coalesce(n >= 3 and t > 320 and t - m > 10 and t - m > 2.0001 * s, false) as fire from w", "px_static")
def contextual_fire(spark, d):
    px = px_static(spark, d).select(*CELL, (280 + F.col("elev")).alias("t"))
    return focal.contextual_fires(px, "t", 7, 320.0, 10.0, 2.0001).select(*CELL, r("background", F.col("background")), "fire")


_PP = "p as (select * from px_pre_post where pre is not null and post is not null)"


@query(f"with {_PP}, a as (select x.row, x.col, var_pop(y.pre) as v, var_pop(y.post) as w from p x join p y on y.row between x.row - 2 and x.row + 2 and y.col between x.col - 2 and x.col + 2 group by 1, 2) select row, col, round(greatest(0, least(2, abs(w - v) / greatest(v, 1e-6))) / 2, 5) + 0.0 as texture_change from a", "px_pre_post")
def texture_change(spark, d):
    px = px_pre_post(spark, d).where("pre is not null and post is not null")
    a = focal.local_statistics(px.select(*CELL, "pre"), "pre", 5, "none").select(*CELL, F.col("var_").alias("v"))
    b = focal.local_statistics(px.select(*CELL, "post"), "post", 5, "none").select(*CELL, F.col("var_").alias("w"))
    return a.join(b, CELL).select(*CELL, r("texture_change", F.greatest(F.lit(0.0), F.least(F.lit(2.0), F.abs(F.col("w") - F.col("v")) / F.greatest("v", F.lit(1e-6)))) / 2, 5))


_EIGHT = "b.row between a.row - 1 and a.row + 1 and b.col between a.col - 1 and a.col + 1 and (a.row <> b.row or a.col <> b.col)"


@query(f"select a.row, a.col, (1 + count(b.elev))::bigint as accumulation from px_static a left join px_static b on {_EIGHT} and b.elev > a.elev group by 1, 2", "px_static")
def flow_neighbours(spark, d):
    return focal.higher_neighbours(px_static(spark, d)).select(*CELL, "accumulation")


@query("with n as (select a.row, a.col, max(case when b.row < a.row then b.elev end) as n, max(case when b.row > a.row then b.elev end) as s, max(case when b.col < a.col then b.elev end) as w, max(case when b.col > a.col then b.elev end) as e from px_static a join px_static b on abs(a.row - b.row) + abs(a.col - b.col) = 1 group by 1, 2) select row, col, round(atan(sqrt(power((e - w) / 60, 2) + power((s - n) / 60, 2))), 6) as slope, round(atan2((w - e) / 60, (s - n) / 60), 6) + 0.0 as aspect from n where n is not null and s is not null and w is not null and e is not null and (e <> w or s <> n)", "px_static")
def slope_aspect(spark, d):
    s = focal.slope_aspect(px_static(spark, d)).where("slope is not null and slope > 0")
    return s.select(*CELL, r("slope", F.col("slope")), r("aspect", F.col("aspect")))


@query(f"with m as (select avg(elev) as mu, var_pop(elev) as v, count(*) as n from px_static), p as (select (a.elev - mu) * (b.elev - mu) as x, case when a.row = b.row or a.col = b.col then 1.0::double else 1 / sqrt(2.0) end as w from px_static a join px_static b on {_EIGHT} cross join m) select max(n) as n, round(sum(w), 5) as weight, round(sum(w * x) / sum(w) / max(v), 6) + 0.0 as morans_i from p cross join m", "px_static")
def morans_i(spark, d):
    return focal.morans_i(px_static(spark, d), "elev").select("n", r("weight", F.col("weight"), 5), r("morans_i", F.col("morans_i")))


@query("with m as (select avg(elev) as mu, stddev_pop(elev) as sd, count(*) as n from px_static), w as (" + _window("elev", 5, "px_static", "sum(b.elev) as s") + "), g as (select row, col, (s - 25 * mu) / (sd * sqrt((n * 25.0 - 625) / (n - 1))) as gi from w cross join m) select row, col, round(gi, 6) + 0.0 as gi, gi > 1.96 as hot from g", "px_static")
def getis_ord(spark, d):
    return focal.hot_spots(px_static(spark, d), "elev").select(*CELL, r("gi", F.col("gi")), "hot")


@query(f"with h as (select row, col from px_static where elev > 40) select a.row, a.col from h a where not exists (select 1 from h b where {_EIGHT})", "px_static")
def isolated_pixels(spark, d):
    return focal.isolated(px_static(spark, d), F.col("elev") > 40)


_REG = "with recursive h as (select row, col, row::bigint * 50 + col as node from px_static where elev > 22), e as (select a.node as u, b.node as v from h a join h b on abs(a.row - b.row) + abs(a.col - b.col) = 1), reach as (select node as u, node as v from h union select reach.u, e.v from reach join e on reach.v = e.u where e.v < reach.u or true), reg as (select u as node, min(v) as region from reach group by 1)"


@query(f"{_REG.replace(' where e.v < reach.u or true', '').replace('elev > 22', 'elev > 32')} select h.row, h.col, region from h join reg using (node)", "px_static")
def connected_regions(spark, d):
    return focal.regions(px_static(spark, d), F.col("elev") > 32, 50)


@query(f"{_REG.replace(' where e.v < reach.u or true', '').replace('elev > 22', 'elev > 32')} select region, count(*) as cells, min(h.row) as r0, max(h.row) as r1, min(h.col) as c0, max(h.col) as c1, printf('POLYGON((%d %d, %d %d, %d %d, %d %d, %d %d))', min(h.col), min(h.row), max(h.col) + 1, min(h.row), max(h.col) + 1, max(h.row) + 1, min(h.col), max(h.row) + 1, min(h.col), min(h.row)) as wkt from h join reg using (node) group by 1 having count(*) >= 3", "px_static")
def region_features(spark, d):
    labelled = focal.sieve(focal.regions(px_static(spark, d), F.col("elev") > 32, 50), 3)
    return focal.polygons(labelled).select("region", "cells", "r0", "r1", "c0", "c1", "wkt")


@query("with g as (select row, col from px_bands where green is null), p as (select g.row, g.col, b.green as v, 1 / (power(g.row - b.row, 2) + power(g.col - b.col, 2)) as w from g join px_bands b on b.row between g.row - 2 and g.row + 2 and b.col between g.col - 2 and g.col + 2 and b.green is not null) select row, col, round(sum(w * v) / sum(w), 6) as filled from p group by 1, 2", "px_bands")
def idw_fill(spark, d):
    px = px_bands(spark, d).select(*CELL, "green")
    return focal.fill_idw(px, "green").where("green is null and filled is not null").select(*CELL, r("filled", F.col("filled")))


@query("with o as (select (pre > 25)::double as o, (post > 25)::double as f, row, col from px_pre_post where pre is not null and post is not null), w as (select a.row, a.col, avg(b.o) as po, avg(b.f) as pf from o a join o b on b.row between a.row - 1 and a.row + 1 and b.col between a.col - 1 and a.col + 1 group by 1, 2) select round(1 - avg(power(po - pf, 2)) / (avg(po * po) + avg(pf * pf)), 6) as fss from w", "px_pre_post")
def fractions_skill(spark, d):
    px = px_pre_post(spark, d).where("pre is not null and post is not null").select(*CELL, (F.col("pre") > 25).cast("double").alias("o"), (F.col("post") > 25).cast("double").alias("f"))
    w = focal.window_sums(px.withColumn("one", F.lit(1)), {"n_": F.lit(1), "so": F.col("o"), "sf": F.col("f")}, 3).select((F.col("so") / F.col("n_")).alias("po"), (F.col("sf") / F.col("n_")).alias("pf"))
    return w.agg(r("fss", 1 - F.avg(F.pow(F.col("po") - F.col("pf"), 2)) / (F.avg(F.col("po") * F.col("po")) + F.avg(F.col("pf") * F.col("pf")))))


@query("with m as (select row, avg(elev) as m from px_static group by 1), s as (select median(m) as md, stddev_pop(m) as sd from m), f as (select row, m, abs(m - md) / sd > 1.5001 as odd from m cross join s) select row, round(m, 6) as mean, odd from f where odd", "px_static")
def row_stripes(spark, d):
    from tellurion.operators.zonal import with_totals

    m = px_static(spark, d).groupBy("row").agg(F.avg("elev").alias("m"))
    f = with_totals(m, md=F.median("m"), sd=F.stddev_pop("m")).withColumn("odd", F.abs(F.col("m") - F.col("md")) / F.col("sd") > 1.5001)
    return f.where("odd").select("row", r("mean", F.col("m")), "odd")


# ---------------------------------------------------------------- graphs

_DAG = "dag as (select o_orderkey as v, o_orderkey // 3 as u from orders where o_orderkey >= 1 union select o_orderkey, o_orderkey // 5 from orders where o_orderkey >= 5)"


def _dag(spark, d):
    o = table(spark, d, "orders").where("o_orderkey >= 1").select(F.col("o_orderkey").alias("v"))
    return o.select(F.expr("v div 3").alias("u"), "v").union(o.where("v >= 5").select(F.expr("v div 5").alias("u"), "v")).distinct()


@query(f"with recursive {_DAG}, p as (select 0::bigint as node, 0 as level union select v, level + 1 from p join dag on p.node = dag.u) select node, max(level)::int as level from p group by 1")
def dag_levels(spark, d):
    return graph.levels(_dag(spark, d))


@query(f"with recursive {_DAG}, p as (select 2::bigint as node union select v from p join dag on p.node = dag.u) select 2::bigint as root, node from p where node <> 2")
def lineage_closure(spark, d):
    roots = spark.range(2, 3).select(F.col("id").alias("node"))
    return graph.descendants(_dag(spark, d), roots).select("root", "node")


# ---------------------------------------------------------------- tiles

for _m, _o in (("first", "ts, source_id, value"), ("last", "ts desc, source_id desc, value desc"), ("best", "quality desc, ts desc, source_id desc, value desc")):

    def _mosaic(spark, d, m=_m):
        return focal.mosaic(px_obs(spark, d), m).select(*CELL, r("value", F.col("value")))

    _mosaic.__name__ = f"mosaic_{_m}"
    query(f"select row, col, round(value, 6) as value from (select *, row_number() over (partition by row, col order by {_o}) as rn from px_obs) where rn = 1", "px_obs")(_mosaic)


@query("select row, col, round(avg(value), 6) as average, max(value) as max, min(value) as min from px_obs group by 1, 2", "px_obs")
def mosaic_aggregates(spark, d):
    px = px_obs(spark, d)
    a, b, c = (focal.mosaic(px, m).withColumnRenamed("value", m) for m in ("average", "max", "min"))
    return a.join(b, CELL).join(c, CELL).select(*CELL, r("average", F.col("average")), "max", "min")


@query("with k as (select (row // 4)::int as row, (col // 4)::int as col, elev, count(*) as n from px_static group by 1, 2, 3), m as (select row, col, elev as mode from (select *, row_number() over (partition by row, col order by n desc, elev) as rn from k) where rn = 1), a as (select (row // 4)::int as row, (col // 4)::int as col, round(avg(elev), 6) as average, max(elev) as max from px_static group by 1, 2), c as (select (row // 4)::int as row, (col // 4)::int as col, elev as nearest from px_static where row % 4 = 2 and col % 4 = 2) select row, col, average, max, mode, nearest from a join m using (row, col) join c using (row, col)", "px_static")
def regrid(spark, d):
    px = px_static(spark, d)
    a, m, c, x = (focal.downsample(px, "elev", 4, how).withColumnRenamed("elev", how) for how in ("average", "mode", "nearest", "max"))
    return a.join(m, CELL).join(c, CELL).join(x, CELL).select(*CELL, r("average", F.col("average")), "max", "mode", "nearest")


@query("with a as (select 1 as level, (row // 2)::int as row, (col // 2)::int as col, avg(elev) as v from px_static group by all), b as (select 2 as level, (row // 2)::int as row, (col // 2)::int as col, avg(v) as v from a group by all), c as (select 3 as level, (row // 2)::int as row, (col // 2)::int as col, avg(v) as v from b group by all) select level, row, col, round(v, 6) as value from (select * from a union all select * from b union all select * from c)", "px_static")
def pyramid(spark, d):
    level, out = px_static(spark, d).select(*CELL, F.col("elev").alias("value")), None
    for i in (1, 2, 3):
        level = focal.downsample(level, "value", 2)
        own = level.select(F.lit(i).alias("level"), *CELL, r("value", F.col("value")))
        out = own if out is None else out.unionByName(own)
    return out


@query("with t as (select row, col, elev, unnest(range(((row - 2) // 10)::bigint, ((row + 2) // 10)::bigint + 1)) as tr from px_static), u as (select *, unnest(range(((col - 2) // 10)::bigint, ((col + 2) // 10)::bigint + 1)) as tc from t), v as (select *, elev + tr * 0.5 + tc * 0.25 as x, least(least(row - (tr * 10 - 2) + 1, (tr + 1) * 10 + 2 - row), least(col - (tc * 10 - 2) + 1, (tc + 1) * 10 + 2 - col), 5)::double as w from u where tr >= 0 and tc >= 0) select row, col, round(sum(w * x) / sum(w), 6) as feather, round(avg(x), 6) as average from v group by 1, 2", "px_static")
def tile_stitch(spark, d):
    px = px_static(spark, d).where("row >= 0")
    t = focal.to_tiles(px, 10, 2).withColumn("x", F.col("elev") + F.col("tile_row") * 0.5 + F.col("tile_col") * 0.25)
    a, b = (focal.stitch(t, "x", m, 10, 2).withColumnRenamed("x", m) for m in ("feather", "average"))
    return a.join(b, CELL).select(*CELL, r("feather", F.col("feather")), r("average", F.col("average")))


@query("select (row // 8)::int as tile_row, (col // 8)::int as tile_col, count(*) as cells, round(avg(elev), 6) as mean, round(median(elev), 6) as median, min(elev) as min from px_static group by 1, 2", "px_static")
def tile_aggregates(spark, d):
    t = focal.to_tiles(px_static(spark, d), 8)
    return t.groupBy("tile_row", "tile_col").agg(F.count("*").alias("cells"), r("mean", F.avg("elev")), r("median", F.median("elev")), F.min("elev").alias("min"))


@query("select i as tile_id, (i // 3)::int as tile_row, (i % 3)::int as tile_col, greatest(0, least(40, (i // 3) * 20 - 2))::int as row_start, greatest(0, least(40, (i // 3 + 1) * 20 + 2))::int as row_end, greatest(0, least(50, (i % 3) * 20 - 2))::int as col_start, greatest(0, least(50, (i % 3 + 1) * 20 + 2))::int as col_end from range(6) t(i)")
def tile_grid(spark, d):
    return focal.tiles(50, 40, 20, 2, spark)


@query("select row, col, count(value) as layers, count(value) = 5 as full from px_layers group by 1, 2", "px_layers")
def layer_coverage(spark, d):
    return px_layers(spark, d).groupBy(*CELL).agg(F.count("value").alias("layers"), (F.count("value") == 5).alias("full"))
