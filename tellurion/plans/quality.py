"""Queries of quality: sanity, anomalies, gates, flags, sensor quality, fallbacks."""

from __future__ import annotations

from pyspark.sql import functions as F

from tellurion.functions.base import rounded
from tellurion.operators import quality as Q

from .fixtures import candidates, px_bands, px_layers, px_obs, series, table
from .registry import query


def r(name, expr, digits=6):
    return rounded(expr, digits).alias(name)


@query("with g as (select source_id, count(*) as n, count(*) filter (value is null) as nulls, count(*) filter (value < 5 or value > 47) as outside from px_obs group by 1) select *, round(outside / n, 6) as share, case when outside / n > 0.05 then 'critical' when outside / n > 0.01 then 'high' when outside > 0 then 'medium' else 'none' end as severity from g", "px_obs")
def value_ranges(spark, d):
    return Q.range_check(px_obs(spark, d), ["source_id"], "value", 5, 47).select("source_id", "n", "nulls", "outside", r("share", F.col("share")), "severity")


@query("with m as (select sensor, avg(value) as mu, stddev_pop(value) as sd, quantile_cont(value, 0.25) as q1, quantile_cont(value, 0.75) as q3, max(value) as mx from series group by 1), c as (select sensor, count(value) as n, count(*) filter (abs(value - mu) > 2 * sd) as z_outliers, count(*) filter (value < q1 - 1.5 * (q3 - q1) or value > q3 + 1.5 * (q3 - q1)) as iqr_outliers, count(*) filter (value >= 0.99 * mx) as saturated from series join m using (sensor) group by 1) select *, round(greatest(0, 1 - case when z_outliers / n > 0.01 then 0.1::double else 0 end - case when iqr_outliers / n > 0.02 then 0.05::double else 0 end - case when saturated / n > 0.005 then 0.2::double else 0 end), 3) as score from c", "series")
def anomaly_counts(spark, d):
    return Q.anomalies(series(spark, d), ["sensor"], "value", z=2.0)


_CHECKS = "checks as (select user_id as product, case when event_type = 'error' then 'mandatory' when event_type in ('purchase', 'signup') then 'critical' else 'advisory' end as category, value < case when event_type = 'error' then 45 when event_type in ('purchase', 'signup') then 60 else 90 end as passed from events)"


def _checks(spark, d):
    e = table(spark, d, "events")
    category = F.when(F.col("event_type") == "error", "mandatory").when(F.col("event_type").isin("purchase", "signup"), "critical").otherwise("advisory")
    most = F.when(F.col("event_type") == "error", 45).when(F.col("event_type").isin("purchase", "signup"), 60).otherwise(90)
    return e.select(F.col("user_id").alias("product"), category.alias("category"), (F.col("value") < most).alias("passed"))


@query(f"with {_CHECKS}, g as (select product, count(*) filter (not passed and category = 'mandatory') as mandatory, count(*) filter (not passed and category = 'critical') as critical, count(*) filter (not passed and category = 'advisory') as warnings from checks group by 1) select *, case when mandatory > 0 then 'BLOCKED' when critical > 0 then 'REVIEW_REQUIRED' when warnings > 0 then 'PASS_WITH_WARNINGS' else 'PASS' end as status, round(case when mandatory > 0 then 0 when critical > 0 then greatest(0.5::double, 1 - 0.1::double * critical) when warnings > 0 then greatest(0.8::double, 1 - 0.02::double * warnings) else 1 end, 6) as confidence from g")
def gating_status(spark, d):
    g = Q.gate(_checks(spark, d), ["product"])
    return g.select("product", "mandatory", "critical", "warnings", "status", r("confidence", F.col("confidence")))


_FLAGS = "f as (select provider, unnest([case when cloud > 30 then 'CLOUD_AFFECTED' end, case when data_type = 'sar' then 'SINGLE_SENSOR' end, case when coverage / 100 < 0.5 then 'LOW_CONFIDENCE' end]) as flag from candidates)"


def _flags(spark, d):
    c = candidates(spark, d)
    return c.select("provider", F.explode(Q.condition_flags(F.col("cloud"), F.col("data_type") == "sar", F.col("coverage") / 100)).alias("flag"))


@query(f"with {_FLAGS}, x as (select distinct provider, flag from f where flag is not null) select provider, count(*) as flags, round(product(case flag when 'CLOUD_AFFECTED' then 0.8::double when 'SINGLE_SENSOR' then 0.9::double else 0.6::double end), 6) as modifier from x group by 1", "candidates")
def flag_modifiers(spark, d):
    return Q.flag_modifier(_flags(spark, d), ["provider"]).select("provider", "flags", r("modifier", F.col("modifier")))


@query(f"with {_FLAGS} select flag, count(*) as n, count(distinct provider) as providers from f where flag is not null group by 1", "candidates")
def flag_summary(spark, d):
    return _flags(spark, d).groupBy("flag").agg(F.count("*").alias("n"), F.countDistinct("provider").alias("providers"))


_BRIGHT = " + ".join(f"greatest(0, least(1, ({b} - lo_{b}) / (hi_{b} - lo_{b})))" for b in ("blue", "green", "red"))


@query("with b as (select * from px_bands where blue is not null and green is not null and red is not null), q as (select " + ", ".join(f"quantile_cont({b}, 0.02) as lo_{b}, quantile_cont({b}, 0.98) as hi_{b}" for b in ("blue", "green", "red")) + f" from b), x as (select row, col, ({_BRIGHT}) / 3 as br from b cross join q) select row, col, round(br, 6) + 0.0 as brightness, br > 0.7001 as cloud, br < 0.1501 as shadow from x", "px_bands")
def cloud_shadow(spark, d):
    px = px_bands(spark, d).where("blue is not null and green is not null and red is not null")
    return Q.clouds_and_shadows(px, ["blue", "green", "red"], 0.7001, 0.1501).select("row", "col", r("brightness", F.col("brightness")), "cloud", "shadow")


@query("select round(0.6::double * greatest(0, least(1, (avg(blue) / avg(red) - 1) / 0.5)) + 0.4::double * greatest(0, 1 - 2 * stddev_pop(blue)), 6) as haze from px_bands", "px_bands")
def haze(spark, d):
    return Q.haze(px_bands(spark, d), "blue", "red").select(r("haze", F.col("haze")))


@query("select source_id, round(power(avg(value) / stddev_pop(value), 2), 6) as enl, round(stddev_pop(value) / avg(value), 6) as cv from px_layers group by 1", "px_layers")
def speckle(spark, d):
    return Q.speckle(px_layers(spark, d), ["source_id"], "value").select("source_id", r("enl", F.col("enl")), r("cv", F.col("cv")))


@query("with g as (select dataset_id, power(greatest(0.01, 1 - coalesce(cloud, 0) / 100) * greatest(0.01, coverage / 100) * greatest(0.01, exp(-resolution_m / 100)), 1.0 / 3) as g from candidates) select dataset_id, round(g, 6) as condition, case when round(g, 9) >= 0.8 then 'FULL' when round(g, 9) >= 0.6 then 'PARTIAL' when round(g, 9) >= 0.4 then 'MINIMAL' when round(g, 9) >= 0.2 then 'EMERGENCY' else 'UNAVAILABLE' end as level from g", "candidates")
def degraded_mode(spark, d):
    g, level = Q.degraded_level(1 - F.coalesce("cloud", F.lit(0.0)) / 100, F.col("coverage") / 100, F.exp(-F.col("resolution_m") / 100))
    return candidates(spark, d).select("dataset_id", r("condition", g), level.alias("level"))


@query("select dataset_id, case when data_type = 'optical' and cloud < 30 then 'optical' when data_type in ('optical', 'sar') and coverage > 20 then 'sar' when resolution_m < 50 then 'coarse' else 'none' end as choice, round(case when data_type = 'optical' and cloud < 30 then 0.0::double when data_type in ('optical', 'sar') and coverage > 20 then 0.1::double when resolution_m < 50 then 0.4::double else 1.0::double end, 6) as loss from candidates", "candidates")
def fallback_chain(spark, d):
    t = F.col("data_type")
    choice, loss = Q.first_available([("optical", (t == "optical") & (F.col("cloud") < 30), 0.0), ("sar", t.isin("optical", "sar") & (F.col("coverage") > 20), 0.1), ("coarse", F.col("resolution_m") < 50, 0.3)])
    return candidates(spark, d).select("dataset_id", choice.alias("choice"), r("loss", loss))


@query("with e as (select * from (values ('ana', 'flood', 2, true), ('bo', 'fire', 1, false), ('cy', 'storm', 3, true), ('di', 'flood', 1, false)) v(expert, domain, load, priority_access)), q as (select o_orderkey as request, case o_orderkey % 3 when 0 then 'flood' when 1 then 'fire' else 'storm' end as wants, o_orderpriority like '1%' as critical from orders), j as (select request, expert, row_number() over (partition by request order by domain <> wants, load, expert) as rn from q cross join e where not critical or priority_access) select request, expert from j where rn = 1")
def assign_reviewers(spark, d):
    e = spark.createDataFrame([("ana", "flood", 2, True), ("bo", "fire", 1, False), ("cy", "storm", 3, True), ("di", "flood", 1, False)], "expert string, domain string, load int, priority_access boolean")
    k = F.col("o_orderkey") % 3
    q = table(spark, d, "orders").select(F.col("o_orderkey").alias("request"), F.when(k == 0, "flood").when(k == 1, "fire").otherwise("storm").alias("wants"), F.col("o_orderpriority").startswith("1").alias("critical"))
    return Q.assign_reviewers(q, e)


@query("select source_id, count(*) as n, round(100.0::double * count(*) filter (quality > 0) / count(*), 6) as valid_percent, count(distinct value) as distinct_values, round(max(k) / count(*), 6) as dominant from (select *, count(*) over (partition by source_id, value) as k from px_obs) group by 1", "px_obs")
def completeness(spark, d):
    v = px_obs(spark, d).groupBy("source_id", "value").agg(F.count("*").alias("k"), F.count(F.when(F.col("quality") > 0, 1)).alias("ok"))
    return v.groupBy("source_id").agg(F.sum("k").alias("n"), r("valid_percent", 100.0 * F.sum("ok") / F.sum("k")), F.count("*").alias("distinct_values"), r("dominant", F.max("k") / F.sum("k")))
