"""Queries of composite detectors and checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from tellurion.functions import spectral as S
from tellurion.functions.base import normal_cdf, normal_cdf_sql, rounded
from tellurion.operators import composite, focal, fuse

from .fixtures import candidates, px_bands, px_layers, px_pre_post, px_static, px_votes, series, table
from .registry import query

CELL = ["row", "col"]


def r(name, expr, digits=6):
    return rounded(expr, digits).alias(name)


_FE = ("nbr", "ndvi", "mirbi")
_STATS = ", ".join(f"avg(case when label = {c} then {f} end) as m{c}_{f}, stddev_pop(case when label = {c} then {f} end) + 1e-6 as s{c}_{f}" for f in _FE for c in (0, 1))
_WT = {f: f"(abs(m1_{f} - m0_{f}) / (s1_{f} + s0_{f}))" for f in _FE}
_SUM = " + ".join(_WT.values())
_D = {c: "sqrt(" + " + ".join(f"{_WT[f]} / ({_SUM}) * power(({f} - m{c}_{f}) / s{c}_{f}, 2)" for f in _FE) + ")" for c in (0, 1)}


@query(f"with x as (select row, col, case when nir + swir <> 0 then (nir - swir) / (nir + swir) else 0 end as nbr, case when nir + red <> 0 then (nir - red) / (nir + red) else 0 end as ndvi, 10 * swir - 9.8 * nir + 2 as mirbi from px_bands where nir is not null and red is not null and swir is not null), y as (select *, case when nbr < -0.1 and ndvi < 0.2 then 1 when nbr > 0.1 then 0 end as label from x), s as (select {_STATS} from y), p as (select row, col, 1 - {_D[1]} / ({_D[1]} + {_D[0]} + 1e-6) as p from y cross join s) select row, col, round(p, 5) + 0.0 as probability, p >= 0.5 as burned from p", "px_bands")
def burned_area_classifier(spark, d):
    red, nir, swir = (F.col(c) for c in ("red", "nir", "swir"))
    px = px_bands(spark, d).where("nir is not null and red is not null and swir is not null").select(*CELL, S.nbr(nir, swir).alias("nbr"), S.ndvi(nir, red).alias("ndvi"), S.mirbi(nir, swir).alias("mirbi"))
    label = F.when((F.col("nbr") < -0.1) & (F.col("ndvi") < 0.2), 1).when(F.col("nbr") > 0.1, 0)
    return composite.burned_classes(px, list(_FE), label).select(*CELL, r("probability", F.col("probability"), 5), "burned")


@query("with n as (select a.row, a.col, a.elev, b.elev as e, row_number() over (partition by a.row, a.col order by power(a.row - b.row, 2) + power(a.col - b.col, 2), b.elev) as rn from px_static a join px_static b on b.elev <= 5) select row, col, greatest(0, elev - e)::double as hand from n where rn = 1", "px_static")
def height_above_drainage(spark, d):
    return composite.height_above_drainage(px_static(spark, d), "elev", F.col("elev") <= 5).select(*CELL, "hand")


@query("with q as (select quantile_cont(elev, [0.25, 0.5, 0.75]) as q from px_static) select len(list_filter(q, lambda x: x <= elev))::int as zone, count(*) as n, round(avg(elev), 6) as mean, round(stddev_pop(elev), 6) as std, min(elev) as min, max(elev) as max from px_static cross join q group by 1", "px_static")
def uncertainty_zones(spark, d):
    return composite.zones(px_static(spark, d), "elev", 4).select("zone", "n", r("mean", F.col("mean")), r("std", F.col("std")), "min", "max")


@query("with m as (select avg(elev) mu, var_pop(elev) v from px_static), h as (select avg((a.elev - mu) * (b.elev - mu)) / max(v) as x from px_static a join px_static b on a.row = b.row and b.col = a.col + 1 cross join m), w as (select avg((a.elev - mu) * (b.elev - mu)) / max(v) as x from px_static a join px_static b on a.col = b.col and b.row = a.row + 1 cross join m) select round((h.x + w.x) / 2, 6) + 0.0 as autocorrelation from h cross join w", "px_static")
def spatial_autocorrelation(spark, d):
    return composite.lag_autocorrelation(px_static(spark, d), "elev").select(r("autocorrelation", F.col("autocorrelation")))


@query("with n as (select a.row, a.col, count(*) as n, sum((b.col - a.col) * case when a.row = b.row then 2 else 1 end * b.elev) as gx, sum((b.row - a.row) * case when a.col = b.col then 2 else 1 end * b.elev) as gy from px_static a join px_static b on abs(a.row - b.row) <= 1 and abs(a.col - b.col) <= 1 and (a.row <> b.row or a.col <> b.col) group by 1, 2) select row, col, round(sqrt(gx * gx + gy * gy), 6) as gradient from n where n = 8", "px_static")
def sobel_gradient(spark, d):
    return composite.sobel(px_static(spark, d), "elev").select(*CELL, r("gradient", F.col("gradient")))


@query("with d as (select b.elev - a.elev as d from px_static a join px_static b on a.row = b.row and b.col = a.col + 1), m as (select median(d) as m from d) select round(1.4826::double * median(abs(d - m)), 6) as noise from d cross join m", "px_static")
def elevation_noise(spark, d):
    return composite.gradient_noise(px_static(spark, d), "elev").select(r("noise", F.col("noise")))


@query("with d as (select abs(b.elev - a.elev) as g, (a.col + 1) % 10 = 0 as e from px_static a join px_static b on a.row = b.row and b.col = a.col + 1), s as (select avg(case when e then g end) as x, avg(case when not e then g end) as y from d) select round(x, 6) as on, round(y, 6) as off, round(greatest(0, least(1, x / y - 1)), 6) + 0.0 as score from s".replace(" as on,", ' as "on",'), "px_static")
def tile_seams(spark, d):
    s = composite.seams(px_static(spark, d), "elev", 10)
    return s.select(r("on", F.col("on")), r("off", F.col("off")), r("score", F.col("score")))


@query("select a.row, a.col, round(avg(b.brightness), 8) as smooth from px_static a join px_static b on abs(a.row - b.row) <= 1 and abs(a.col - b.col) <= 1 group by 1, 2", "px_static")
def smooth_surface(spark, d):
    return composite.smoothed(px_static(spark, d), "brightness", 3).select(*CELL, r("smooth", F.col("smooth"), 8))


@query("with m as (select (row // 10)::int as tr, (col // 10)::int as tc, avg(elev) as mu, stddev_pop(elev) as sd from px_static group by 1, 2) select row, col, round((elev - mu) / sd, 6) + 0.0 as z from px_static join m on (row // 10)::int = tr and (col // 10)::int = tc where sd > 0", "px_static")
def tile_function(spark, d):
    """A function over pandas frames applied to each tile: its cells' z-scores."""

    def z(cells):
        sd = cells["elev"].std(ddof=0)
        out = cells[["row", "col"]].copy()
        out["z"] = (cells["elev"] - cells["elev"].mean()) / sd if sd > 0 else float("nan")
        return out

    tiled = focal.to_tiles(px_static(spark, d), 10)
    return composite.apply_to_tiles(tiled, z, "row int, col int, z double").where(~F.isnan("z")).select(*CELL, r("z", F.col("z")))


@query("with p as (select entity, hours from series where sensor = 'view'), g as (select entity, hours as a, lead(hours) over (partition by entity order by hours) as b from p) select s.entity, s.id, round(s.hours, 6) as hours from series s join g on s.entity = g.entity and s.hours > a and s.hours < b and b - a > 48 where s.sensor = 'click'", "series")
def densify_coverage(spark, d):
    s = series(spark, d)
    f = composite.gap_fillers(s.where("sensor = 'view'"), s.where("sensor = 'click'"), ["entity"], 48.0)
    return f.select("entity", "id", r("hours", F.col("hours")))


_TAGS = "t as (select dataset_id, list_filter([data_type, cost_tier, flag], lambda x: x is not null) as tags from candidates)"


@query(f"with {_TAGS} select dataset_id, list_has_all(tags, ['sar', 'open']) as every from t where list_has_any(tags, ['sar', 'open'])", "candidates")
def search_tags(spark, d):
    t = candidates(spark, d).select("dataset_id", F.array_compact(F.array("data_type", "cost_tier", "flag")).alias("tags"))
    every = composite.tagged(t, ["sar", "open"], True).select("dataset_id", F.lit(True).alias("e"))
    return composite.tagged(t, ["sar", "open"], False).join(every, "dataset_id", "left").select("dataset_id", F.coalesce("e", F.lit(False)).alias("every"))


@query(f"with m as (select avg(post) as mu, stddev_pop(post) as sd from px_pre_post where post is not null), z as (select row, col, abs((post - mu) / sd) as z from px_pre_post cross join m where post is not null), p as (select row, col, 1 - {normal_cdf_sql('z')} as p from z) select row, col, round(case when p > 0 then least(10000, 1 / (p * 12)) else 10000 end, 3) as years from p", "px_pre_post")
def return_periods(spark, d):
    """Years between values as far out as each cell's, with 12 values a year."""
    from tellurion.operators.zonal import z_scores

    z = z_scores(px_pre_post(spark, d).where("post is not null"), "post")
    return z.select(*CELL, r("years", composite.return_period(F.col("z"), 12.0, normal_cdf), 3))


@query("with c as (select row, col, avg(yes) as m from px_votes group by 1, 2), l as (select v.source_id, v.row, v.col, 1 - abs(v.yes - m) as rel, v.yes, v.confidence from px_votes v join c using (row, col)), s as (select row, col, sum(rel * case when yes = 1 then confidence else 1 - confidence end) / sum(rel) as p from l group by 1, 2 having sum(rel) > 0) select row, col, round(p, 9) as probability, p >= 0.5001 as detected from s", "px_votes")
def ensemble_reliability(spark, d):
    v = px_votes(spark, d)
    m = v.groupBy(*CELL).agg(F.avg("yes").alias("m"))
    rel = 1 - F.abs(F.col("yes") - F.col("m"))
    p = F.when(F.col("yes") == 1, F.col("confidence")).otherwise(1 - F.col("confidence"))
    s = v.join(m, CELL).groupBy(*CELL).agg(F.sum(rel * p).alias("t"), F.sum(rel).alias("w")).where("w > 0")
    return s.select(*CELL, r("probability", F.col("t") / F.col("w"), 9), (F.col("t") / F.col("w") >= 0.5001).alias("detected"))


@query("with recursive s as (select row, col, row::bigint * 50 + col as node from (select row, col, stddev_pop(value) / avg(value) as cv from px_layers group by 1, 2) where cv > 0.3001), e as (select a.node as u, b.node as v from s a join s b on abs(a.row - b.row) + abs(a.col - b.col) = 1), reach as (select node as u, node as v from s union select reach.u, e.v from reach join e on reach.v = e.u), g as (select u as node, min(v) as region from reach group by 1) select region, count(*) as cells from g group by 1 having count(*) >= 4", "px_layers")
def disagreement_regions(spark, d):
    s = px_layers(spark, d).groupBy(*CELL).agg((F.stddev_pop("value") / F.avg("value")).alias("cv"))
    labelled = focal.sieve(focal.regions(s, F.col("cv") > 0.3001, 50), 4)
    return labelled.groupBy("region").agg(F.count("*").alias("cells"))


@query("select row, col, count(*) as n, round(avg(value), 8) as mean, round(stddev_pop(value) * sqrt(1.0 / count(*)), 6) as uncertainty from px_layers group by 1, 2 having count(*) >= 5", "px_layers")
def disagreement_uncertainty(spark, d):
    g = fuse.resolve_mean(px_layers(spark, d)).select(*CELL, F.col("value").alias("m"))
    s = px_layers(spark, d).groupBy(*CELL).agg(F.count("*").alias("n"), F.stddev_pop("value").alias("s")).where("n >= 5")
    return s.join(g, CELL).select(*CELL, "n", r("mean", F.col("m"), 8), r("uncertainty", F.col("s") * F.sqrt(1 / F.col("n"))))


@query("with p as (select a.event_id as id, a.user_id, a.ts, row_number() over (partition by user_id order by ts desc, event_id desc) as rn from events a) select user_id, id, ts, rn::int as place from p where rn <= 3")
def lineage_recent(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return table(spark, d, "events").withColumn("place", F.row_number().over(w)).where("place <= 3").select("user_id", F.col("event_id").alias("id"), "ts", "place")


@query("select a.data_type as a, b.data_type as b, greatest(a.t0, b.t0) as start, least(a.t1, b.t1) as end, least(a.t0, b.t0) as hull_start, greatest(a.t1, b.t1) as hull_end from (select data_type, min(acquired) as t0, max(acquired) as t1 from candidates group by 1) a join (select data_type, min(acquired) as t0, max(acquired) as t1 from candidates group by 1) b on a.data_type < b.data_type and a.t0 <= b.t1 and a.t1 >= b.t0", "candidates")
def interval_algebra(spark, d):
    t = candidates(spark, d).groupBy("data_type").agg(F.min("acquired").alias("t0"), F.max("acquired").alias("t1"))  # a row a data type
    a, b = (t.select(F.col("data_type").alias(n), F.col("t0").alias(f"{n}0"), F.col("t1").alias(f"{n}1"), F.lit(1).alias("k")) for n in ("a", "b"))
    j = a.join(b, "k").where("a < b and a0 <= b1 and a1 >= b0")
    return j.select("a", "b", F.greatest("a0", "b0").alias("start"), F.least("a1", "b1").alias("end"), F.least("a0", "b0").alias("hull_start"), F.greatest("a1", "b1").alias("hull_end"))


@query("with g as (select t / 10.0 as threshold from range(1, 10) x(t)), s as (select threshold, count(*) filter (p >= threshold and o = 1) as h, count(*) filter (p < threshold and o = 1) as m, count(*) filter (p >= threshold and o = 0) as f from forecast cross join g group by 1) select round(threshold, 6)::double as threshold, round(h / (h + m + f), 6) as csi, row_number() over (order by h / (h + m + f) desc, threshold)::int as place from s", "forecast")
def tune_threshold(spark, d):
    """A grid of thresholds scored in one pass: each event counts in the grid's cells by an explode of nine values."""
    from pyspark.sql import Window

    from .fixtures import forecast

    g = forecast(spark, d).withColumn("t", F.explode(F.array(*[F.lit(i) for i in range(1, 10)]))).withColumn("threshold", F.col("t") / 10)
    c = lambda cond: F.count(F.when(cond, 1))
    yes, o = F.col("p") >= F.col("threshold"), F.col("o") == 1
    s = g.groupBy("threshold").agg(c(yes & o).alias("h"), c(~yes & o).alias("m"), c(yes & ~o).alias("f")).withColumn("csi", F.col("h") / (F.col("h") + F.col("m") + F.col("f")))
    return s.select(r("threshold", F.col("threshold")), r("csi", F.col("csi")), F.row_number().over(Window.partitionBy().orderBy(F.desc("csi"), "threshold")).alias("place"))  # nine rows
