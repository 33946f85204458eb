"""Queries of local map algebra: detection, corrections and propagation on pixels."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from tellurion.functions import spectral as S
from tellurion.functions import uncertainty as U
from tellurion.functions.base import clip, normal_cdf_sql, rounded, uniform_sql
from tellurion.operators import correct, detect

from .fixtures import px_bands, px_layers, px_pre_post, px_static
from .registry import query

CELL = ["row", "col"]


def r(name, expr, digits=6):
    return rounded(expr, digits).alias(name)


@query("select row, col, coalesce(post_db < -15 and pre_db - post_db > 3, false) as flood, round((greatest(0, least(1, (-15 - post_db) / 15)) + greatest(0, least(1, (pre_db - post_db) / 9))) / 2, 6) + 0.0 as confidence from px_pre_post where pre is not null and post is not null", "px_pre_post")
def sar_flood_change(spark, d):
    px = px_pre_post(spark, d).where("pre is not null and post is not null")
    return detect.sar_flood_change(px, "pre_db", "post_db").select(*CELL, "flood", r("confidence", F.col("confidence")))


@query("select row, col, coalesce(post_db < -15, false) as flood, case when post_db is not null then round(greatest(0, least(1, (-15 - post_db) / 15)), 6) + 0.0 end as confidence from px_pre_post", "px_pre_post")
def sar_threshold(spark, d):
    return detect.sar_flood(px_pre_post(spark, d), "post_db").select(*CELL, "flood", r("confidence", F.col("confidence")))


@query("with x as (select *, greatest(0, least(1, (-15 - post_db) / 15)) as c from px_pre_post) select count(*) as total_pixels, count(post_db) as valid_pixels, count(case when post_db < -25 then 1 end) as detected_pixels, round(count(case when post_db < -25 then 1 end) * 0.01::double, 6) as area_ha, round(100.0::double * count(case when post_db < -25 then 1 end) / count(post_db), 6) as percent, round(avg(case when post_db < -25 then greatest(0, least(1, (-25 - post_db) / 25)) end), 6) as mean_confidence from x", "px_pre_post")
def sar_statistics(spark, d):
    out = detect.detection_statistics(detect.sar_flood(px_pre_post(spark, d), "post_db", -25.0), "flood", "post_db")
    return out.select("total_pixels", "valid_pixels", "detected_pixels", *[r(c, F.col(c)) for c in ("area_ha", "percent", "mean_confidence")])


NDWI = "case when green + nir > 1e-6 then greatest(-1, least(1, (green - nir) / (green + nir))) end"


@query(f"with x as (select row, col, {NDWI} as w from px_bands) select row, col, round(w, 6) + 0.0 as ndwi, coalesce(w > 0, false) as flood, case when w is not null then round(greatest(0, least(1, 0.5 + 0.5 * w)), 6) + 0.0 end as confidence from x", "px_bands")
def ndwi_detect(spark, d):
    return detect.ndwi_flood(px_bands(spark, d)).select(*CELL, r("ndwi", F.col("ndwi")), "flood", r("confidence", F.col("confidence")))


@query("with x as (select row, col, pre / 50 as a, post / 50 as b from px_pre_post) select row, col, coalesce(b > 0.5 and b - a > 0.1, false) as flood, case when a is not null and b is not null then round((greatest(0, least(1, 0.5 + 0.5 * (b - 0.5) / 0.5)) + greatest(0, least(1, (b - a) / 0.2))) / 2, 6) + 0.0 end as confidence from x", "px_pre_post")
def ndwi_change(spark, d):
    px = px_pre_post(spark, d).select(*CELL, (F.col("pre") / 50).alias("a"), (F.col("post") / 50).alias("b"))
    return detect.ndwi_flood_change(px, "a", "b", 0.5, 0.1).select(*CELL, "flood", r("confidence", F.col("confidence")))


@query("with m as (select max(green * 20000) as mx from px_bands) select row, col, round(case when mx > 1 then green * 20000 / 10000 else green * 20000 end, 6) + 0.0 as green from px_bands cross join m", "px_bands")
def reflectance_scale(spark, d):
    px = px_bands(spark, d).withColumn("green", F.col("green") * 20000)
    return detect.scaled_reflectance(px, "green").select(*CELL, r("green", F.col("green")))


for _m, _sql in (("difference", "post - pre"), ("ratio", "post / greatest(pre, 1e-6)"), ("normalized_difference", "case when abs(post) + abs(pre) > 1e-6 then (post - pre) / (abs(post) + abs(pre)) else 0 end")):

    def _change(spark, d, m=_m):
        px = px_pre_post(spark, d).where("pre is not null and post is not null")
        return px.select(*CELL, r("change", S.change(F.col("pre"), F.col("post"), m)))

    _change.__name__ = f"change_{_m}"
    query(f"select row, col, round({_sql}, 6) + 0.0 as change from px_pre_post where pre is not null and post is not null", "px_pre_post")(_change)


@query("with x as (select row, col, post - pre as c from px_pre_post where pre is not null and post is not null), s as (select avg(c) as m, stddev_pop(c) as s from x) select row, col, round(greatest(m - 1.5 * s, least(m + 1.5 * s, c)), 6) + 0.0 as change from x cross join s", "px_pre_post")
def outlier_clip(spark, d):
    px = px_pre_post(spark, d).where("pre is not null and post is not null")
    return detect.clipped_change(px, "pre", "post", "difference", 1.5).select(*CELL, r("change", F.col("change")))


@query("with x as (select row, col, (post - pre) / 50 as c from px_pre_post where pre is not null and post is not null) select row, col, c < -0.1501 as sar_changed, abs(c) > 0.1501 as optical_changed, round(greatest(0, least(1, abs(c) / (3 * 0.1501))), 6) + 0.0 as confidence from x", "px_pre_post")
def change_threshold(spark, d):
    px = px_pre_post(spark, d).where("pre is not null and post is not null")
    c = (F.col("post") - F.col("pre")) / 50
    optical, confidence = detect.changed(c, "optical", 0.1501)
    return px.select(*CELL, detect.changed(c, "sar", 0.1501)[0].alias("sar_changed"), optical.alias("optical_changed"), r("confidence", confidence))


@query("with b as (select unnest([blue, green, red]) as v, unnest([green, red, nir]) as w, row, col from px_bands where blue is not null and green is not null and red is not null and nir is not null) select row, col, round(avg(w - v), 6) + 0.0 as change from b group by 1, 2", "px_bands")
def change_multiband(spark, d):
    px = px_bands(spark, d).where("blue is not null and green is not null and red is not null and nir is not null")
    pairs = F.explode(F.array(*[F.struct(F.col(a).alias("v"), F.col(b).alias("w")) for a, b in (("blue", "green"), ("green", "red"), ("red", "nir"))]))
    return px.select(*CELL, pairs.alias("p")).groupBy(*CELL).agg(r("change", F.avg(F.col("p.w") - F.col("p.v"))))


def _nd(a, b):
    return f"case when {a} is null or {b} is null then null when {a} + {b} <> 0 then greatest(-1, least(1, ({a} - {b}) / ({a} + {b}))) else 0 end"


@query(f"with x as (select row, col, {_nd('nir', 'swir')} as nbr, {_nd('red', 'green')} as nbr_pre from px_bands), y as (select row, col, nbr, nbr_pre - nbr as dn from x) select row, col, round(nbr, 6) + 0.0 as nbr, round(dn, 6) + 0.0 as dnbr, case when dn < -0.1 then 1 when dn < 0.1 then 0 when dn < 0.27 then 2 when dn < 0.44 then 3 when dn < 0.66 then 4 when dn is not null then 5 end::int as severity, case when dn >= 0.1 then round(0.5 + 0.5 * greatest(0, least(1, (dn - 0.1) / 0.56)), 6) when dn is not null then round(greatest(0, least(1, (0.1 - dn) / 0.2)), 6) end as confidence from y where dn is not null", "px_bands")
def dnbr_severity(spark, d):
    px = px_bands(spark, d).withColumn("nbr", S.nbr(F.col("nir"), F.col("swir")))
    return detect.burn(px, "red", "green", "nir", "swir").where("dnbr is not null").select(*CELL, r("nbr", F.col("nbr")), r("dnbr", F.col("dnbr")), F.col("severity").cast("int"), r("confidence", F.col("confidence")))


@query(f"with x as (select {_nd('red', 'green')} - {_nd('nir', 'swir')} as dn from px_bands), y as (select dn, case when dn < -0.1 then 1 when dn < 0.1 then 0 when dn < 0.27 then 2 when dn < 0.44 then 3 when dn < 0.66 then 4 else 5 end::int as severity from x where dn is not null) select severity, count(*) as pixels, round(count(*) * 0.09::double, 6) as area_ha, round(100.0::double * count(*) / sum(count(*)) over (), 6) as percent, round(avg(dn), 6) + 0.0 as mean_dnbr from y group by 1", "px_bands")
def burn_statistics(spark, d):
    from pyspark.sql import Window

    px = detect.burn(px_bands(spark, d), "red", "green", "nir", "swir").where("dnbr is not null")
    out = px.groupBy(F.col("severity").cast("int").alias("severity")).agg(F.count("*").alias("pixels"), F.avg("dnbr").alias("m"))
    total = F.sum("pixels").over(Window.partitionBy())  # six rows
    return out.select("severity", "pixels", r("area_ha", F.col("pixels") * 0.09), r("percent", 100.0 * F.col("pixels") / total), r("mean_dnbr", F.col("m")))


@query("select row, col, round(case when nir + red <> 0 then (nir - red) / (nir + red) else 0 end, 6) + 0.0 as ndvi, round(case when nir is null or red is null or blue is null then null when nir + 6 * red - 7.5 * blue + 1 <> 0 then greatest(-1, least(1, 2.5 * (nir - red) / (nir + 6 * red - 7.5 * blue + 1))) else 0 end, 6) + 0.0 as evi, round(least(1000, 1 / (power(0.1 - red, 2) + power(0.06 - nir, 2))), 6) as bai, round(10 * swir - 9.8 * nir + 2, 6) + 0.0 as mirbi from px_bands where nir is not null and red is not null and swir is not null", "px_bands")
def vegetation_burn_indices(spark, d):
    blue, red, nir, swir = (F.col(c) for c in ("blue", "red", "nir", "swir"))
    px = px_bands(spark, d).where("nir is not null and red is not null and swir is not null")
    return px.select(*CELL, r("ndvi", S.ndvi(nir, red)), r("evi", S.evi(red, nir, blue)), r("bai", S.bai(red, nir)), r("mirbi", S.mirbi(nir, swir)))


@query("with x as (select row, col, 1.4387774e4 / (11.0 * ln(1.191042e8 / (power(11.0, 5) * (brightness * 12 + elev / 10)) + 1)) as k from px_static) select row, col, round(k, 6) as kelvin, k > 305.3 as fire, round(greatest(0, least(1, (k - 315.3) / (360 - 305.3 - 10))), 6) + 0.0 as confidence from x", "px_static")
def planck_fire(spark, d):
    px = px_static(spark, d).withColumn("k", S.brightness_temperature(F.col("brightness") * 12 + F.col("elev") / 10, 11.0))
    return detect.hot_spots(px, "k", 305.3).select(*CELL, r("kelvin", F.col("k")), "fire", r("confidence", F.col("confidence")))


@query("with x as (select row, col, 280 + elev as k from px_static), b as (select median(k) as bg from x where not k > 322.5) select row, col, round(case when k > 322.5 then greatest(0, 375.0 * 375.0 * 5.67e-8 * 0.98 * (power(k, 4) - power(bg, 4)) / 1e6) else 0 end, 6) as frp from x cross join b", "px_static")
def fire_power(spark, d):
    px = detect.hot_spots(px_static(spark, d).withColumn("k", 280 + F.col("elev")), "k", 322.5)
    return detect.radiative_power(px, "k").select(*CELL, r("frp", F.col("frp")))


@query("with x as (select row, col, pre / 50 as a, post / 50 as b, post / 50 - pre / 50 as c from px_pre_post where pre is not null and post is not null) select row, col, c <= -0.2 and a >= 0.3 as damaged, case when a >= 0.3 then case when c <= -0.4 then 3 when c <= -0.2 then 2 when c <= -0.1 then 1 else 0 end else 0 end::int as severity, case when a >= 0.3 then round(0.7 * greatest(0, least(1, -c / 0.4)) + 0.3 * greatest(0, least(1, (a - 0.1) / 0.9)), 6) + 0.0 end as confidence from x", "px_pre_post")
def wind_damage(spark, d):
    px = px_pre_post(spark, d).where("pre is not null and post is not null").select(*CELL, (F.col("pre") / 50).alias("a"), (F.col("post") / 50).alias("b"))
    return detect.wind_damage(px, "a", "b").select(*CELL, "damaged", F.col("severity").cast("int"), r("confidence", F.col("confidence")))


@query("with x as (select row, col, abs(post - pre) / 50 as b, elev / 50 as t, brightness - 0.9 as h from px_pre_post join px_static using (row, col) where pre is not null and post is not null), y as (select *, 0.7 * (0.4 * b + 0.6 * t) + 0.3 * h as s from x) select row, col, round(s, 6) + 0.0 as score, ((s >= 0.15)::int + (s >= 0.15 + 0.55 / 3)::int + (s >= 0.15 + 0.55 * 2 / 3)::int + (s >= 0.7)::int)::int as grade from y", "px_pre_post px_static")
def structural_damage(spark, d):
    px = px_pre_post(spark, d).where("pre is not null and post is not null").join(px_static(spark, d), CELL)
    s = detect.structural_score(F.abs(F.col("post") - F.col("pre")) / 50, F.col("elev") / 50, F.col("brightness") - 0.9)
    return px.withColumn("s", s).select(*CELL, r("score", F.col("s")), detect.damage_grade(F.col("s")).cast("int").alias("grade"))


@query("select row, col, elev <= 10 as susceptible, round(0.7 * greatest(0, least(1, 1 - elev / 10)) + 0.3 * greatest(0, least(1, 1 - (brightness * 100 - 90) / 20)), 6) + 0.0 as confidence from px_static", "px_static")
def hand_susceptibility(spark, d):
    flag, confidence = detect.hand_susceptibility(F.col("elev"), F.col("brightness") * 100 - 90)
    return px_static(spark, d).select(*CELL, flag.alias("susceptible"), r("confidence", confidence))


_Z, _A = math.radians(40), math.radians(135)
_COS_I = f"greatest(0.001, cos(s) * {math.cos(_Z)!r} + sin(s) * {math.sin(_Z)!r} * cos({_A!r} - a))"


@query(f"with x as (select row, col, brightness as v, elev / 60 as s, brightness * 6 as a from px_static), y as (select *, {_COS_I} as i from x) select row, col, round(i, 6) as illumination, round(v * {math.cos(_Z)!r} / i, 6) as cosine, round(v * power({math.cos(_Z)!r} / i, 0.5), 6) as minnaert, round(v * ({math.cos(_Z)!r} + 0.5) / (i + 0.5), 6) as c, round(v * {math.cos(_Z)!r} * cos(s) / i, 6) as scs from y", "px_static")
def terrain_correction(spark, d):
    px = px_static(spark, d).select(*CELL, F.col("brightness").alias("v"), (F.col("elev") / 60).alias("s"), (F.col("brightness") * 6).alias("a"))
    px = px.withColumn("i", S.illumination(F.col("s"), F.col("a"), _Z, _A))
    return px.select(*CELL, r("illumination", F.col("i")), *[r(m, S.terrain_correction(F.col("v"), F.col("i"), F.col("s"), _Z, m)) for m in ("cosine", "minnaert", "c", "scs")])


@query("with p as (select quantile_cont(green, 0.01) as q from px_bands) select row, col, case when green is not null then round(greatest(0, green - q * (1 + 0.01 * power(550.0 / 560.0, 4))), 6) + 0.0 end as green from px_bands cross join p", "px_bands")
def dark_object_subtraction(spark, d):
    return correct.dark_object(px_bands(spark, d), "green", 0.01, correct.improved_factor(560.0)).select(*CELL, r("green", F.col("green")))


@query(f"select row, col, round(greatest(0, least(1, green * 10000 / 10000 / {math.cos(_Z)!r})), 6) + 0.0 as toar from px_bands where green is not null", "px_bands")
def top_of_atmosphere(spark, d):
    return px_bands(spark, d).where("green is not null").select(*CELL, r("toar", S.top_of_atmosphere(F.col("green") * 10000, _Z)))


_T = S.transmittance(560.0, 0.1, _Z, math.radians(10))


@query(f"with p as (select quantile_cont(green, 0.01) as q from px_bands) select row, col, case when green is not null then round(greatest(0, least(1, greatest(0, green - q) / {math.cos(_Z)!r} / {_T!r})), 6) + 0.0 end as green from px_bands cross join p", "px_bands")
def cost_correction(spark, d):
    return correct.cosine_transmittance(px_bands(spark, d), "green", math.cos(_Z), _T).select(*CELL, r("green", F.col("green")))


@query("with q as (select quantile_cont(green, 0.02) a0, quantile_cont(green, 0.98) a1, quantile_cont(nir, 0.02) b0, quantile_cont(nir, 0.98) b1 from px_bands) select row, col, round(b0 + (green - a0) * (b1 - b0) / (a1 - a0), 6) + 0.0 as matched from px_bands cross join q", "px_bands")
def histogram_match(spark, d):
    return correct.match_percentiles(px_bands(spark, d), "green", "nir").select(*CELL, r("matched", F.col("matched")))


@query("with x as (select * from px_pre_post where pre is not null and post is not null), f as (select regr_slope(post, pre) as g, regr_intercept(post, pre) as o from x where abs(pre - post) < 0.5 * abs(post)) select row, col, round(pre * g + o, 6) + 0.0 as normalized from x cross join f", "px_pre_post")
def invariant_regression(spark, d):
    px = px_pre_post(spark, d).where("pre is not null and post is not null")
    return correct.invariant_regression(px, "pre", "post", 0.5, 10).select(*CELL, r("normalized", F.col("normalized")))


@query("with s as (select avg(pre) ma, stddev_pop(pre) sa, avg(post) mb, stddev_pop(post) sb from px_pre_post) select row, col, round((pre - ma) / sa * sb + mb, 6) + 0.0 as normalized from px_pre_post cross join s", "px_pre_post")
def relative_normalization(spark, d):
    return correct.relative(px_pre_post(spark, d), "pre", "post").select(*CELL, r("normalized", F.col("normalized")))


@query("with q as (select source_id, quantile_cont(value, 0.02) lo, quantile_cont(value, 0.98) hi from px_layers group by 1) select row, col, source_id, round(greatest(0, least(1, (value - lo) / (hi - lo))), 6) + 0.0 as stretched from px_layers join q using (source_id)", "px_layers")
def band_stretch(spark, d):
    return correct.group_stretch(px_layers(spark, d), ["source_id"], "value").select(*CELL, "source_id", r("stretched", F.col("stretched")))


_P = {"a": "pre", "sa": "0.1 * pre", "b": "post", "sb": "0.05 * post"}


@query("with x as (select row, col, pre a, 0.1 * pre sa, post b, 0.05 * post sb from px_pre_post where pre is not null and post is not null) select row, col, round(sqrt(sa * sa + sb * sb + 0.6 * sa * sb), 6) as added, round(sqrt(greatest(0, sa * sa + sb * sb - 0.6 * sa * sb)), 6) as subtracted, round(abs(a * b) * sqrt(power(sa / a, 2) + power(sb / b, 2) + 0.6 * (sa / a) * (sb / b)), 6) as multiplied, round(abs(a / b) * sqrt(greatest(0, power(sa / a, 2) + power(sb / b, 2) - 0.6 * (sa / a) * (sb / b))), 6) as divided, round(abs(2.0 * power(a, 2.0) / a) * sa, 6) as squared, round(a + 1.96 * sa, 6) as upper, round(sa / abs(a), 6) as relative from x", "px_pre_post")
def propagate_arithmetic(spark, d):
    px = px_pre_post(spark, d).where("pre is not null and post is not null")
    a, b = F.col("pre"), F.col("post")
    sa, sb = 0.1 * a, 0.05 * b
    return px.select(*CELL, r("added", U.add(sa, sb, 0.3)), r("subtracted", U.add(sa, sb, 0.3, -1)), r("multiplied", U.multiply(a, sa, b, sb, 0.3)), r("divided", U.divide(a, sa, b, sb, 0.3)), r("squared", U.power(a, sa, 2.0)), r("upper", a + 1.96 * sa), r("relative", sa / F.abs(a)))


@query("with x as (select row, col, value v, 0.1 * value s, quality w from px_layers) select row, col, round(sum(w * v) / sum(w), 7) as mean, round(sqrt(sum(w * w * s * s)) / sum(w), 6) as uncertainty, round(sqrt(sum(s * s)), 6) as rss from x group by 1, 2 having sum(w) > 0", "px_layers")
def propagate_weighted_mean(spark, d):
    px = px_layers(spark, d)
    v, s, w = F.col("value"), 0.1 * F.col("value"), F.col("quality")
    out = px.groupBy(*CELL).agg(F.sum(w).alias("w"), F.sum(w * v).alias("wv"), F.sum(w * w * s * s).alias("ws"), F.sum(s * s).alias("ss")).where("w > 0")
    return out.select(*CELL, r("mean", F.col("wv") / F.col("w"), 7), r("uncertainty", F.sqrt("ws") / F.col("w")), r("rss", F.sqrt("ss")))


@query("with x as (select source_id, avg(0.1 * value) s from px_layers group by 1) select source_id, round(s * s / sum(s * s) over (), 6) as share, row_number() over (order by s desc, source_id) = 1 as dominant from x", "px_layers")
def error_budget(spark, d):
    from pyspark.sql import Window

    x = px_layers(spark, d).groupBy("source_id").agg(F.avg(0.1 * F.col("value")).alias("s"))
    every = Window.partitionBy()  # a row a source
    return x.select("source_id", r("share", F.col("s") * F.col("s") / F.sum(F.col("s") * F.col("s")).over(every)), (F.row_number().over(every.orderBy(F.desc("s"), "source_id")) == 1).alias("dominant"))


@query("with s as (select row, col, value from px_layers) select row, col, round(exp(avg(ln(value))), 6) as geometric, round(count(*) / sum(1 / value), 6) as harmonic, round(1.253 * 0.1 * avg(value) / sqrt(count(*)), 6) as median_uncertainty from s group by 1, 2", "px_layers")
def aggregate_uncertainty(spark, d):
    v = F.col("value")
    return px_layers(spark, d).groupBy(*CELL).agg(r("geometric", F.exp(F.avg(F.log(v)))), r("harmonic", F.count("*") / F.sum(1 / v)), r("median_uncertainty", 1.253 * 0.1 * F.avg(v) / F.sqrt(F.count("*"))))


@query(f"select row, col, round({normal_cdf_sql('-((25 - post) / (0.1::double * post))')}, 6) + 0.0 as p, round(abs((sin(post + 0.0001::double) - sin(post - 0.0001::double)) / 0.0002::double) * 0.1::double * post, 4) + 0.0 as sine from px_pre_post where post is not null", "px_pre_post")
def exceedance_probability(spark, d):
    """P(value > 25) of each cell under a normal error."""
    px = px_pre_post(spark, d).where("post is not null")
    return px.select(*CELL, r("p", U.exceedance(F.col("post"), 0.1 * F.col("post"), 25.0)), r("sine", U.function(F.col("post"), 0.1 * F.col("post"), F.sin), 4))


_DRAW = f"sqrt(-2 * ln(1 - {uniform_sql('row', 'col', 'draw', '1')})) * cos(2 * pi() * {uniform_sql('row', 'col', 'draw', '2')})"


@query(f"with d as (select row, col, post, unnest(range(1, 65)) as draw from px_pre_post where post is not null), x as (select row, col, post * (1 + 0.1::double * {_DRAW}) as x from d) select row, col, round(avg(x * x), 5) as mean, round(stddev_samp(x * x), 5) as std from x group by 1, 2", "px_pre_post")
def monte_carlo(spark, d):
    """Mean and spread of the square of each cell's value under a normal error, of 64 draws that the cell and their number decide."""
    px = px_pre_post(spark, d).where("post is not null").select(*CELL, "post").withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(64))))
    x = F.col("post") * (1 + 0.1 * U.normal_draw(F.col("row"), F.col("col"), F.col("draw")))
    return px.withColumn("y", x * x).groupBy(*CELL).agg(r("mean", F.avg("y"), 5), r("std", F.stddev("y"), 5))
