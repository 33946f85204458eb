"""Queries of forecasts: scenarios, impacts and their verification over the events' days."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tellurion.functions.base import rounded, steps

from .fixtures import series
from .registry import query


def r(name, expr, digits=6):
    return rounded(expr, digits).alias(name)


def _days(spark, d):
    return series(spark, d).groupBy("sensor", F.floor(F.col("hours") / 24).cast("bigint").alias("day")).agg(F.avg("value").alias("v"), F.max("value").alias("peak"))


_DAYS = "days as (select sensor, floor(hours / 24)::bigint as day, avg(value) as v, max(value) as peak from series group by 1, 2)"
_LEVELS = ([10.0, 20.0, 40.0, 80.0], ["none", "minor", "moderate", "major"], "extreme")
_CASE = "case when {0} < 10 then 'none' when {0} < 20 then 'minor' when {0} < 40 then 'moderate' when {0} < 80 then 'major' else 'extreme' end"


@query(f"with {_DAYS} select sensor, day, round(v, 6) as value, {_CASE.format('round(v, 9)')} as impact, round(sum(v) over (partition by sensor order by day rows unbounded preceding), 5) as cumulative from days", "series")
def impact_projection(spark, d):
    w = Window.partitionBy("sensor").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    return _days(spark, d).select("sensor", "day", r("value", F.col("v")), steps(F.round("v", 9), *_LEVELS).alias("impact"), r("cumulative", F.sum("v").over(w), 5))


@query(f"with {_DAYS}, s as (select day, max(case when sensor = 'view' then v end) as a, max(case when sensor = 'click' then v end) as b from days group by 1) select day, {_CASE.format('round(greatest(a, b), 9)')} as worst, round((case when a >= 20 then 0.5 else 0.1 end) * (case when b >= 20 then 0.5 else 0.1 end)::double, 6) as joint, case when a >= 20 and b >= 20 then 1.5::double when a >= 20 or b >= 20 then 1.2::double else 1.0::double end as synergy from s where a is not null and b is not null", "series")
def compound_impact(spark, d):
    x = _days(spark, d).groupBy("day").agg(*[F.max(F.when(F.col("sensor") == s, F.col("v"))).alias(n) for s, n in (("view", "a"), ("click", "b"))]).where("a is not null and b is not null")
    a, b = F.col("a") >= 20, F.col("b") >= 20
    joint = F.when(a, 0.5).otherwise(0.1) * F.when(b, 0.5).otherwise(0.1)
    return x.select("day", steps(F.round(F.greatest("a", "b"), 9), *_LEVELS).alias("worst"), r("joint", joint), F.when(a & b, 1.5).when(a | b, 1.2).otherwise(1.0).alias("synergy"))


@query(f"with {_DAYS} select sensor, round(avg(peak), 6) as mean_peak, round(max(peak), 6) as max_peak, round(max(peak) - min(peak), 6) as range, round(stddev_pop(peak), 6) as std, row_number() over (order by avg(peak) desc, sensor)::int as rank from days group by 1", "series")
def compare_scenarios(spark, d):
    g = _days(spark, d).groupBy("sensor").agg(F.avg("peak").alias("m"), F.max("peak").alias("x"), (F.max("peak") - F.min("peak")).alias("g"), F.stddev_pop("peak").alias("s"))
    return g.select("sensor", r("mean_peak", F.col("m")), r("max_peak", F.col("x")), r("range", F.col("g")), r("std", F.col("s")), F.row_number().over(Window.partitionBy().orderBy(F.desc("m"), "sensor")).alias("rank"))  # a row a scenario


@query(f"with {_DAYS} select sensor, day, round(v * 1.2 + 3, 6) as what_if, round(v * 1.2 + 3 - v, 6) as delta from days where sensor in ('view', 'click')", "series")
def what_if(spark, d):
    new = F.col("v") * 1.2 + 3
    return _days(spark, d).where("sensor in ('view', 'click')").select("sensor", "day", r("what_if", new), r("delta", new - F.col("v")))


@query(f"with {_DAYS}, p as (select a.day, a.v as f, b.v as o from days a join days b on a.day = b.day and a.sensor = 'view' and b.sensor = 'click') select count(*) as n, round(sqrt(avg(power(f - o, 2))), 6) as rmse, round(avg(f - o), 6) + 0.0 as bias, round(corr(f, o), 6) + 0.0 as correlation, count(*) filter (f >= 20 and o >= 20) as hits, count(*) filter (f < 20 and o >= 20) as misses from p", "series")
def match_forecast(spark, d):
    p = _days(spark, d).groupBy("day").agg(*[F.max(F.when(F.col("sensor") == s, F.col("v"))).alias(n) for s, n in (("view", "f"), ("click", "o"))]).where("f is not null and o is not null")
    e = F.col("f") - F.col("o")
    return p.agg(F.count("*").alias("n"), r("rmse", F.sqrt(F.avg(e * e))), r("bias", F.avg(e)), r("correlation", F.corr("f", "o")), F.count(F.when((F.col("f") >= 20) & (F.col("o") >= 20), 1)).alias("hits"), F.count(F.when((F.col("f") < 20) & (F.col("o") >= 20), 1)).alias("misses"))


@query(f"with {_DAYS}, w as (select sensor, day, v, lead(v) over (partition by sensor order by day) as o from days), s as (select sensor, day % 7 as lead, sqrt(avg(power(v - o, 2))) as rmse, count(*) as n from w where o is not null group by 1, 2) select lead::bigint as lead, round(avg(rmse), 6) as rmse, sum(n)::bigint as n from s group by 1", "series")
def persistence_by_lead(spark, d):
    w = _days(spark, d).withColumn("o", F.lead("v").over(Window.partitionBy("sensor").orderBy("day"))).where("o is not null")
    s = w.groupBy("sensor", (F.col("day") % 7).alias("lead")).agg(F.sqrt(F.avg(F.pow(F.col("v") - F.col("o"), 2))).alias("e"), F.count("*").alias("k"))
    return s.groupBy("lead").agg(r("rmse", F.avg("e")), F.sum("k").alias("n"))
