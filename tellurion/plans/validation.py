"""Queries of scene and product checks, outcomes, reviews and reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from tellurion.functions.base import rounded
from tellurion.operators import focal
from tellurion.operators import validate as V

from .fixtures import candidates, px_bands, px_layers, px_obs, px_pre_post, px_static, px_votes, series, table
from .registry import query

CELL = ["row", "col"]


def r(name, expr, digits=6):
    return rounded(expr, digits).alias(name)


_P = "[" + ", ".join(map(str, V.PERCENTILES)) + "]"


@query(f"with p as (select sensor, count(value) as n, quantile_cont(value, {_P}) as p from series group by 1), t as (select sensor, avg((value < p[2] or value > p[8])::int) as tails from series join p using (sensor) group by 1) select sensor, n, round(p[1], 6) + 0.0 as p001, round(p[9], 6) as p999, round(p[6] - p[4], 6) as iqr, round(abs(p[1] - p[5]) / (p[6] - p[4]), 6) as lower, round(abs(p[9] - p[5]) / (p[6] - p[4]), 6) as upper, abs(p[1] - p[5]) / (p[6] - p[4]) > 3 or abs(p[9] - p[5]) / (p[6] - p[4]) > 3 as extreme, round(tails, 6) as tails, tails > 0.05 as tail_issue from p join t using (sensor)", "series")
def percentile_checks(spark, d):
    p = V.percentile_check(series(spark, d), ["sensor"], "value", most=3.0)
    return p.select("sensor", "n", r("p001", F.element_at("p", 1)), r("p999", F.element_at("p", 9)), r("iqr", F.col("iqr")), r("lower", F.col("lower")), r("upper", F.col("upper")), "extreme", r("tails", F.col("tails")), "tail_issue")


def _scene(spark, d):
    return px_bands(spark, d).join(px_static(spark, d), CELL)


_GLINT = "px as (select * from px_bands join px_static using (row, col)), q as (select quantile_cont(case when elev <= 20 then nir end, 0.5) as lo, quantile_cont(case when elev <= 20 then nir end, 0.98) as hi from px), g as (select px.*, coalesce(elev <= 20 and (nir - lo) / (hi - lo) > 0.3, false) as glint from px cross join q)"


@query(f"with {_GLINT} select row, col, round(nir, 6) as nir from g where glint", "px_bands px_static")
def sun_glint(spark, d):
    return V.sun_glint(_scene(spark, d), "nir", F.col("elev") <= 20).where("glint").select(*CELL, r("nir", F.col("nir")))


@query(f"with {_GLINT}, s as (select 100 * avg((coalesce(blue, 0) > 0.6)::int) as cloud, 100 * avg((coalesce(nir, 1) < 0.3)::int) as shadow, 100 * avg(glint::int) as glint, 100 * avg((coalesce(red, 0) > 0.95 and coalesce(green, 0) > 0.5)::int) as saturated from g) select round(cloud, 6) as cloud, round(shadow, 6) as shadow, round(glint, 6) as glint, round(0.35::double * (1 - cloud / 100) + 0.15::double * greatest(0, 1 - shadow / 50) + 0.15::double * 0.8::double + 0.1::double * greatest(0, 1 - glint / 30) + 0.1::double * greatest(0, 1 - saturated / 10) + 0.15::double * greatest(0, 100 - cloud - shadow) / 100, 6) as score from s", "px_bands px_static")
def optical_score(spark, d):
    g = V.sun_glint(_scene(spark, d), "nir", F.col("elev") <= 20)
    share = lambda c: 100 * F.avg(c.cast("double"))
    s = g.agg(share(F.coalesce("blue", F.lit(0)) > 0.6).alias("cloud"), share(F.coalesce("nir", F.lit(1)) < 0.3).alias("shadow"), share(F.col("glint")).alias("glint"), share((F.coalesce("red", F.lit(0)) > 0.95) & (F.coalesce("green", F.lit(0)) > 0.5)).alias("saturated"))
    clear = F.greatest(F.lit(0.0), 100 - F.col("cloud") - F.col("shadow"))
    return s.select(r("cloud", F.col("cloud")), r("shadow", F.col("shadow")), r("glint", F.col("glint")), r("score", V.optical_score(F.col("cloud"), F.col("shadow"), F.lit(0.2), F.col("glint"), F.col("saturated"), clear)))


def _radar(spark, d):
    return px_pre_post(spark, d).join(px_static(spark, d), CELL).select(*CELL, (F.col("post") / 100).alias("intensity"), (F.col("elev") / 20).alias("elev"))


_RADAR = """px as (select row, col, post / 100 as intensity, elev / 20 as elev from px_pre_post join px_static using (row, col)), n as (select a.row, a.col, count(b.elev) as n, sum((b.col - a.col) * b.elev / 2) as gx, sum((b.row - a.row) * b.elev / 2) as gy from px a join px b on abs(a.row - b.row) + abs(a.col - b.col) = 1 group by 1, 2),
s as (select px.*, degrees(atan(sqrt(gx * gx + gy * gy))) as slope, case when intensity > 0 then 10 * log10(intensity) end as db from px left join (select * from n where n = 4) n using (row, col)),
g as (select 100 * avg((coalesce(slope, 0) > 55)::int) as layover, 100 * avg((coalesce(slope, 0) > 35 or coalesce(db, -40) < -30)::int) as shadow, avg(db) as mean_db, stddev_pop(slope) as roughness, quantile_cont(db, 0.99) as bright from s where intensity is not null),
w as (select a.row, a.col, count(b.intensity) as n, avg(b.intensity) as m, var_pop(b.intensity) as v from px a join px b on abs(a.row - b.row) <= 3 and abs(a.col - b.col) <= 3 where a.intensity is not null and a.row between 3 and (select max(row) from px) - 3 and a.col between 3 and (select max(col) from px) - 3 group by 1, 2),
l as (select coalesce(median(case when m * m / v > 0.5 and m * m / v < 100 then m * m / v end), 1) as looks from w where n >= 10 and v > 0)"""


@query(f"with {_RADAR} select round(layover, 6) as layover, round(shadow, 6) as shadow, round(mean_db, 6) as mean_db, round(looks, 5) as looks, array_to_string(list_filter([case when roughness > 15 then 'complex_terrain' end, case when bright > 5 then 'bright_artifacts' end], lambda x: x is not null), ',') as issues, round(0.35::double * case when looks < 1 then 0 when looks < 3 then 0.1::double * looks when looks < 10 then 0.3::double + 0.5::double * (looks - 3) / 7 else least(1, 0.8::double + 0.2::double * least(1, (looks - 10) / 40)) end + 0.25::double * greatest(0, 1 - case when mean_db < -20 or mean_db > 0 then abs(mean_db + 10) else 0 end / 5) + 0.25::double * greatest(0, 1 - layover / 50) + 0.15::double * greatest(0, 1 - shadow / 30), 5) as score from g cross join l", "px_pre_post px_static")
def radar_score(spark, d):
    px = _radar(spark, d)
    g = V.radar_geometry(V.steepness(px, "elev"), "intensity").crossJoin(F.broadcast(V.local_looks(px, "intensity")))  # a row each
    score = V.radar_score(F.col("looks"), F.col("calibration_error"), F.col("layover"), F.col("shadow"))
    return g.select(r("layover", F.col("layover")), r("shadow", F.col("shadow")), r("mean_db", F.col("mean_db")), r("looks", F.col("looks"), 5), F.concat_ws(",", "issues").alias("issues"), r("score", score, 5))


@query("with m as (select avg(elev) as mu, stddev_pop(elev) as sd, count(*) as n from px_static), c as (select count(*) filter (elev > mu + 3 * sd - 50) as spikes, count(*) filter (elev < mu - 3 * sd + 50) as pits, max(n) as n from px_static cross join m), a as (select count(elev - 30 * brightness) as k, sqrt(avg(power(elev - 30 * brightness, 2))) as rmse, avg(abs(elev - 30 * brightness)) as mae, avg(elev - 30 * brightness) as bias from px_static) select spikes, round(100 * spikes / n, 6) as spikes_percent, 100 * spikes / n > 0.1 as spikes_issue, pits, round(100 * pits / n, 6) as pits_percent, 100 * pits / n > 0.1 as pits_issue, round(case when k > 100 then rmse else sqrt(16 * 16 + 4) end, 6) as accuracy, case when k > 100 then 'reference' else 'estimated' end as method, round(mae, 6) as mae, round(bias, 6) as bias from c cross join a", "px_static")
def elevation_checks(spark, d):
    px = px_static(spark, d).withColumn("reference", 30 * F.col("brightness"))
    a = V.vertical_accuracy(px, "elev", "reference", "SRTM", 2.0).drop("n")
    out = V.elevation_artifacts(px, "elev", margin=-50.0).crossJoin(F.broadcast(a))  # a row each
    return out.select("spikes", r("spikes_percent", F.col("spikes_percent")), "spikes_issue", "pits", r("pits_percent", F.col("pits_percent")), "pits_issue", r("accuracy", F.col("accuracy")), "method", r("mae", F.col("mae")), r("bias", F.col("bias")))


@query("with v as (select row, col, row * 1000 + col as node from px_bands where green is null), e as (select a.node as u, b.node as v from v a join v b on (abs(a.row - b.row) + abs(a.col - b.col)) = 1), c as (with recursive x as (select node, node as seen from v union select x.node, e.v from x join e on x.seen = e.u) select node, min(seen) as region from x group by 1) select region::bigint as region, count(*) as cells from c group by 1", "px_bands")
def elevation_voids(spark, d):
    voids = px_bands(spark, d).where("green is null").select(*CELL)
    return focal.regions(voids, F.lit(True), 1000).groupBy("region").agg(F.count("*").alias("cells"))


@query("select 'optical' as sensor, 'tir' as name, 'missing_required' as issue union all select 'optical', 'cirrus', 'missing' union all select 'sar', source_id::varchar, unnest(list_filter([case when avg((not (-value between -45 and 10))::int) > 0.01 then 'out_of_range' end, case when count(value) < 100 then 'too_few' end, case when stddev_pop(-value) > 8 then 'speckle' end], lambda x: x is not null)) from px_obs group by source_id", "px_obs")
def scene_issues(spark, d):
    bands = V.band_issues(px_bands(spark, d), ["blue", "green", "red", "nir", "swir", "tir", "cirrus"], ["green", "tir"]).select(F.lit("optical").alias("sensor"), F.col("band").alias("name"), "issue")
    radar = V.radar_issues(px_obs(spark, d).withColumn("db", -F.col("value")), ["source_id"], "db", -45.0)
    return bands.unionByName(radar.select(F.lit("sar").alias("sensor"), F.col("source_id").cast("string").alias("name"), "issue"))


@query("with g as (select data_type, list_filter([case when avg((cloud > 80)::int) > 0.1 then 'clouds' end, case when min(coverage) < 5 then 'no_coverage' end, case when count(*) < 10 then 'too_few' end], lambda x: x is not null) as i from candidates group by 1), x as (select data_type, unnest(i) as issue from g) select data_type, count(*) filter (issue = 'no_coverage') as errors, count(*) filter (issue <> 'no_coverage') as warnings, case when count(*) filter (issue = 'no_coverage') > 0 then 'invalid' else 'warnings' end as status from x group by 1", "candidates")
def image_validation(spark, d):
    g = candidates(spark, d).groupBy("data_type").agg(F.avg((F.col("cloud") > 80).cast("double")).alias("clouds"), F.min("coverage").alias("least"), F.count("*").alias("n"))
    issues = g.select("data_type", F.explode(F.array_compact(F.array(F.when(F.col("clouds") > 0.1, "clouds"), F.when(F.col("least") < 5, "no_coverage"), F.when(F.col("n") < 10, "too_few")))).alias("issue"))
    return V.verdict(issues, ["data_type"], {"no_coverage": "error"})


@query("with t as (select x.i::int as tile_row, y.i::int as tile_col from range(8) x(i) cross join range(5) y(i)), p as (select distinct (row // 7)::int as tile_row, (col // 10)::int as tile_col from px_static where elev > 3) select tile_row, tile_col from t anti join p using (tile_row, tile_col)", "px_static")
def tile_manifest(spark, d):
    present = px_static(spark, d).where("elev > 3").select(F.floor(F.col("row") / 7).cast("int").alias("tile_row"), F.floor(F.col("col") / 10).cast("int").alias("tile_col")).distinct()
    return V.missing_tiles(present, 8, 5)


@query("select doc_id, md5(coalesce(text, '')) as md5, sha256(coalesce(text, '')) as sha256, case when doc_id % 5 = 0 then false else true end as verified from documents")
def checksums(spark, d):
    t = table(spark, d, "documents").withColumn("expected", F.when(F.col("doc_id") % 5 == 0, F.lit("0")).otherwise(V.checksum(F.col("text"), "md5")))
    return t.select("doc_id", V.checksum(F.col("text"), "md5").alias("md5"), V.checksum(F.col("text"), "sha256").alias("sha256"), (F.col("expected") == V.checksum(F.col("text"), "md5")).alias("verified"))


@query("with b as (select source_id, row, value, ts from px_obs), s as (select source_id, 100 * avg((value >= 50 or value <= 1)::int) as saturated, abs(avg(value)) / stddev_pop(value) as snr, stddev_pop(value) as sd from b group by 1), w as (select source_id, stddev_pop(m) as rs from (select source_id, row, avg(value) as m from b group by 1, 2) group by 1), x as (select *, rs / sd as striping from s join w using (source_id)) select source_id, round(saturated, 6) as saturated, round(snr, 6) as snr, round(striping, 6) as striping, round(case when saturated > 1 then 1 - 0.3::double * least(saturated / 10, 1) else 1 end * case when snr < 10 then 1 - 0.2::double * least((10 - snr) / 10, 1) else 1 end * case when striping > 0.1 then 1 - 0.15::double * least((striping - 0.1::double) / 0.5::double, 1) else 1 end, 6) as score from x", "px_obs")
def radiometric_score(spark, d):
    px = px_obs(spark, d)
    s = px.groupBy("source_id").agg((100 * F.avg(((F.col("value") >= 50) | (F.col("value") <= 1)).cast("double"))).alias("saturated"), (F.abs(F.avg("value")) / F.stddev_pop("value")).alias("snr"), F.stddev_pop("value").alias("sd"))
    w = px.groupBy("source_id", "row").agg(F.avg("value").alias("m")).groupBy("source_id").agg(F.stddev_pop("m").alias("rs"))
    x = s.join(w, "source_id").withColumn("striping", F.col("rs") / F.col("sd"))
    return x.select("source_id", r("saturated", F.col("saturated")), r("snr", F.col("snr")), r("striping", F.col("striping")), r("score", V.radiometric_score(F.col("saturated"), F.col("snr"), F.col("striping"))))


# ---------------------------------------------------------------- outcomes, reviews and reports

_SEV = "case when max(value) - min(value) > 40 then 'critical' when max(value) - min(value) > 30 then 'high' when max(value) - min(value) > 20 then 'medium' when max(value) - min(value) > 10 then 'low' else 'none' end"


@query(f"with g as (select row, col, avg(confidence) as c, {_SEV} as severity from px_layers group by 1, 2) select row, col, severity, round(c * case severity when 'critical' then 0.3::double when 'high' then 0.6::double when 'medium' then 0.8::double when 'low' then 0.95::double else 1 end, 9) as confidence from g", "px_layers")
def conflict_confidence(spark, d):
    span = F.max("value") - F.min("value")
    g = px_layers(spark, d).groupBy(*CELL).agg(F.avg("confidence").alias("c"), F.when(span > 40, "critical").when(span > 30, "high").when(span > 20, "medium").when(span > 10, "low").otherwise("none").alias("severity"))
    return g.select(*CELL, "severity", r("confidence", V.after_conflict(F.col("c"), F.col("severity")), 9))


@query("select row, col, round(avg(value), 6) as mean, round(sum(value * confidence * confidence) / sum(confidence * confidence), 6) as weighted, round(sum(confidence * confidence * confidence) / sum(confidence * confidence), 6) as weighted_confidence, round(median(value), 6) as median, round(arg_min(value, (-confidence, value)), 6) as surest from px_layers group by 1, 2", "px_layers")
def combined_layers(spark, d):
    c = V.combined(px_layers(spark, d), CELL, "value", "confidence")
    return c.select(*CELL, *[r(x, F.col(x)) for x in ("mean", "weighted", "weighted_confidence", "median", "surest")])


@query("with g as (select row, col, avg(value) as first, median(value) as second, avg(confidence) as c, stddev_pop(value) as sd, avg((abs(value - 25) < 12)::int) as agreement from px_layers group by 1, 2) select row, col, round(case when c < 0.96 then second else first end, 6) as value, c < 0.96 as second_taken, round(agreement * c, 6) as confidence, round(sd * (1 - agreement * c), 6) as uncertainty from g", "px_layers")
def second_choice(spark, d):
    g = px_layers(spark, d).groupBy(*CELL).agg(F.avg("value").alias("first"), F.median("value").alias("second"), F.avg(F.col("confidence").cast("decimal(38,20)")).cast("double").alias("c"), F.stddev_pop("value").alias("sd"), F.avg((F.abs(F.col("value") - 25) < 12).cast("double")).alias("agreement"))
    value, taken = V.with_second_choice(F.col("first"), F.col("c"), F.col("second"), 0.96)
    sure = F.col("agreement") * F.col("c")
    return g.select(*CELL, r("value", value), taken.alias("second_taken"), r("confidence", sure), r("uncertainty", F.col("sd") * (1 - sure)))


_CMP = "cmp as (select o_custkey % 50 as key, case o_orderkey % 7 when 0 then 'conflict' when 1 then 'significant_discrepancy' when 2 then 'minor_discrepancy' when 3 then 'insufficient_data' else 'consistent' end as outcome, (o_orderkey % 10) / 10 as agreement, o_orderkey % 3 <> 0 as near from orders where o_custkey % 5 = 0 or o_orderkey % 7 > 3)"


@query(f"with {_CMP}, g as (select key, count(*) filter (outcome = 'consistent') / count(*) as c, count(*) filter (outcome in ('consistent', 'minor_discrepancy')) / count(*) as m, count(*) filter (outcome = 'conflict') / count(*) as x, avg(agreement) * case when bool_and(near) then 1 else 0.8::double end as k from cmp where outcome <> 'insufficient_data' group by 1) select key, case when c >= 0.8 then 'consistent' when m >= 0.7 then 'minor_discrepancy' when x >= 0.5 then 'conflict' else 'significant_discrepancy' end as outcome, round(k * case when c >= 0.8 then 1 when m >= 0.7 then 0.9::double when x >= 0.5 then 0.5::double else 0.7::double end, 6) as confidence from g")
def overall_outcomes(spark, d):
    k = F.col("o_orderkey")
    o = table(spark, d, "orders").where("o_custkey % 5 = 0 or o_orderkey % 7 > 3").select((F.col("o_custkey") % 50).alias("key"), F.when(k % 7 == 0, "conflict").when(k % 7 == 1, "significant_discrepancy").when(k % 7 == 2, "minor_discrepancy").when(k % 7 == 3, "insufficient_data").otherwise("consistent").alias("outcome"), (k % 10 / 10).alias("agreement"), (k % 3 != 0).alias("near"))
    out = V.overall_outcome(o, ["key"], F.bool_and("near"))
    return out.select("key", "outcome", r("confidence", F.col("confidence")))


@query("with l as (select row, case when max(value) - min(value) < 12 then 'excellent' when max(value) - min(value) < 20 then 'good' when max(value) - min(value) < 28 then 'moderate' when max(value) - min(value) < 36 then 'poor' else 'critical' end as level from px_layers group by row, col), g as (select row, avg((level = 'excellent')::int) as e, avg((level in ('excellent', 'good'))::int) as g, avg((level = 'critical')::int) as c from l group by 1) select row, case when e >= 0.8 or g >= 0.95 then 'excellent' when g >= 0.8 then 'good' when g >= 0.5 then 'moderate' when c < 0.5 then 'poor' else 'critical' end as agreement from g", "px_layers")
def overall_agreement(spark, d):
    span = F.max("value") - F.min("value")
    level = F.when(span < 12, "excellent").when(span < 20, "good").when(span < 28, "moderate").when(span < 36, "poor").otherwise("critical")
    return V.overall_agreement(px_layers(spark, d).groupBy(*CELL).agg(level.alias("level")), ["row"])


_PRODUCTS = "products as (select user_id as product, avg(value) / 100 as confidence, count(*) filter (event_type = 'error') as soft, count(*) filter (value > 90) as warnings, 100 - min(value) as coverage, stddev_pop(value) / 100 as uncertainty, median(value) / 60 as agreement, list_distinct(list_filter([case when count(*) filter (event_type = 'error') > 2 then 'Cross_validation' end, case when max(value) > 95 then 'max_uncertainty' end, case when min(value) < 1 then 'spatial_boundary' end, case when count(*) > 15 then 'temporal_gap' end], lambda x: x is not null)) as failed from events group by 1)"


def _products(spark, d):
    e = table(spark, d, "events")
    n = lambda c: F.count(F.when(c, 1))
    failed = F.array_compact(F.array(F.when(n(F.col("event_type") == "error") > 2, "Cross_validation"), F.when(F.max("value") > 95, "max_uncertainty"), F.when(F.min("value") < 1, "spatial_boundary"), F.when(F.count("*") > 15, "temporal_gap")))
    return e.groupBy(F.col("user_id").alias("product")).agg((F.avg("value") / 100).alias("confidence"), n(F.col("event_type") == "error").alias("soft"), n(F.col("value") > 90).alias("warnings"), (100 - F.min("value")).alias("coverage"), (F.stddev_pop("value") / 100).alias("uncertainty"), (F.median("value") / 60).alias("agreement"), failed.alias("failed"))


_PASS = {k: f"confidence >= {a} and soft <= {b} and warnings <= {c} and coverage >= {x} and uncertainty <= {y} and agreement >= {z}" for k, (a, b, c, x, y, z) in V.GATES.items()}


@query(f"with {_PRODUCTS} select product, {_PASS['emergency']} as emergency, {_PASS['research']} as research, case when confidence >= 0.8 then 'HIGH_CONFIDENCE' when confidence >= 0.6 then 'MEDIUM_CONFIDENCE' when confidence >= 0.4 then 'LOW_CONFIDENCE' else 'INSUFFICIENT_CONFIDENCE' end as flag from products")
def gate_presets(spark, d):
    names = ("confidence", "soft", "warnings", "coverage", "uncertainty", "agreement")
    return _products(spark, d).select("product", *[V.gate_passes(g, *map(F.col, names)).alias(g) for g in ("emergency", "research")], V.confidence_flag(F.col("confidence")).alias("flag"))


@query(f"with {_PRODUCTS} select product, case when list_contains(failed, 'Cross_validation') then 'ALGORITHM_AGREEMENT' when list_contains(failed, 'max_uncertainty') then 'UNCERTAINTY_ASSESSMENT' when list_contains(failed, 'spatial_boundary') then 'BOUNDARY_VALIDATION' when list_contains(failed, 'temporal_gap') then 'TEMPORAL_CONSISTENCY' else 'QUALITY_VALIDATION' end as kind, case product % 4 when 0 then 'FLOOD' when 1 then 'WILDFIRE' when 2 then 'STORM' else 'GENERAL' end as domain, case when soft > 5 or len(failed) > 2 then 'HIGH' else 'NORMAL' end as priority from products")
def review_requests(spark, d):
    p = _products(spark, d)
    event = F.element_at(F.array(*map(F.lit, ("Flood", "wildfire", "storm", "quake"))), (F.col("product") % 4 + 1).cast("int"))
    return p.select("product", V.review_of(F.col("failed"), F.when(F.col("soft") > 5, "BLOCKED").otherwise("REVIEW_REQUIRED"), event).alias("x")).select("product", "x.*")


@query("with o as (select o_orderkey as request, case o_orderstatus when 'O' then 'pending' when 'P' then 'assigned' else 'done' end as status, left(o_orderpriority, 1) as priority, datediff('day', o_orderdate::date, date '1998-09-01') * 24.0 as waited from orders) select request, status, priority, waited::double as waited from o where status <> 'done' and waited > case priority when '1' then 240 when '2' then 2400 else 24000 end")
def escalations(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("request"), F.when(F.col("o_orderstatus") == "O", "pending").when(F.col("o_orderstatus") == "P", "assigned").otherwise("done").alias("status"), F.substring("o_orderpriority", 1, 1).alias("priority"), F.to_date("o_orderdate").alias("ts"))
    out = V.overdue(o, F.lit("1998-09-01").cast("timestamp"), {"1": 240.0, "2": 2400.0, "3": 24000.0})
    return out.select("request", "status", "priority", "waited")


@query("with b as (select user_id, event_type, avg(value) as value from events where event_id % 2 = 0 group by 1, 2), a as (select user_id, event_type, avg(value) as value from events where event_id % 2 = 1 group by 1, 2) select user_id, event_type, round(a.value - b.value, 6) + 0.0 as delta, round(case when b.value <> 0 then 100 * (a.value - b.value) / abs(b.value) end, 4) + 0.0 as percent, case when b.value is null then 'new' when a.value is null then 'resolved' else 'kept' end as change from b full join a using (user_id, event_type)")
def baseline_changes(spark, d):
    e = table(spark, d, "events")
    half = lambda k: e.where(F.col("event_id") % 2 == k).groupBy("user_id", "event_type").agg(F.avg("value").alias("value"))
    x = V.against_baseline(half(0), half(1), ["user_id", "event_type"])
    return x.select("user_id", "event_type", r("delta", F.col("delta")), r("percent", F.col("percent"), 4), "change")


@query("select o_orderstatus as status, count(*) as n, round(sum(o_totalprice), 2) as size, round(count(*) / sum(count(*)) over (), 6) as share from orders group by 1")
def run_statistics(spark, d):
    s = V.by_status(table(spark, d, "orders").withColumnRenamed("o_orderstatus", "status"), "status", "o_totalprice")
    return s.select("status", "n", r("size", F.col("size"), 2), r("share", F.col("share")))


@query("with a as (select event_type as kind, floor(value / 5)::bigint as r0, user_id % 4 as band, event_id, value from events), n as (select *, row_number() over (partition by kind, r0, band order by event_id) as n from a) select kind, r0, band, event_id from n where n = 1")
def distinct_artifacts(spark, d):
    a = table(spark, d, "events").select(F.col("event_type").alias("kind"), F.floor(F.col("value") / 5).alias("r0"), (F.col("user_id") % 4).alias("band"), "event_id")
    return V.first_of_each(a, ["kind", "r0", "band"], ["event_id"])


@query("with n as (select a.row, a.col, count(b.elev) as n, sum((b.col - a.col) * b.elev / 2) as gx, sum((b.row - a.row) * b.elev / 2) as gy from px_static a join px_static b on abs(a.row - b.row) + abs(a.col - b.col) = 1 group by 1, 2), g as (select row, col, sqrt(gx * gx + gy * gy) as g from n where n = 4), s as (select unnest([4, 8])::int as size), m as (select size, avg(g) filter (row % size = 0 or col % size = 0) as a, avg(g) filter (not (row % size = 0 or col % size = 0)) as b from g cross join s group by 1) select size, round(coalesce(case when b >= 1e-10 then greatest(0, least(1, a / b - 1)) end, 0), 5) + 0.0 as score from m", "px_static")
def compression_blocks(spark, d):
    px = px_static(spark, d)
    both = reduce(lambda a, b: a.unionByName(b), [V.blocking(px, "elev", n) for n in (4, 8)])
    return both.select("size", r("score", F.col("score"), 5))


@query("with x as (select 'votes' as part, source_id::varchar as item, count(*)::bigint as n, count(*) filter (yes = 1)::bigint as hits from px_votes group by source_id union all select 'scenes', data_type, count(*), count(*) filter (coverage >= 50) from candidates group by data_type) select part, json_object('item', item, 'n', n, 'hits', hits, 'status', case when 2 * hits >= n then 'pass' else 'fail' end)::varchar as report from x", "px_votes candidates")
def qa_report(spark, d):
    parts = [px_votes(spark, d).groupBy(F.lit("votes").alias("part"), F.col("source_id").cast("string").alias("item")).agg(F.count("*").alias("n"), F.count(F.when(F.col("yes") == 1, 1)).alias("hits")), candidates(spark, d).groupBy(F.lit("scenes").alias("part"), F.col("data_type").alias("item")).agg(F.count("*").alias("n"), F.count(F.when(F.col("coverage") >= 50, 1)).alias("hits"))]
    x = reduce(lambda a, b: a.unionByName(b), parts)
    return x.select("part", F.to_json(F.struct("item", "n", "hits", F.when(2 * F.col("hits") >= F.col("n"), "pass").otherwise("fail").alias("status"))).alias("report"))
