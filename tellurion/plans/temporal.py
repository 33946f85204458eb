"""Queries of time series: bins, as-of lookups, gaps, runs and checks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tellurion.functions.base import rounded
from tellurion.operators import timeline

from .fixtures import px_obs, series
from .registry import query


def r(name, expr, digits=6):
    return rounded(expr, digits).alias(name)


@query("select sensor, floor(hours / 6)::bigint as bin, round((floor(hours / 6) + 0.5) * 6, 6) as centre, round(avg(value), 6) as mean, round(median(value), 7) as median, round(min(value), 6) as min, round(max(value), 6) as max, round(sum(value), 4) as sum, count(value) as count, round(arg_min(value, (hours, value)), 6) as first, round(arg_max(value, (hours, value)), 6) as last from series group by 1, 2, 3", "series")
def bins_six_hours(spark, d):
    b = timeline.hour_bins(series(spark, d), ["sensor"], 6.0, ["mean", "median", "min", "max", "sum", "count", "first", "last"])
    return b.select("sensor", "bin", r("centre", F.col("centre")), r("mean", F.col("mean")), r("median", F.col("median"), 7), r("min", F.col("min")), r("max", F.col("max")), r("sum", F.col("sum"), 4), "count", r("first", F.col("first")), r("last", F.col("last")))


@query("select source_id, floor(epoch_us(ts) / 3.6e9 / 720)::bigint as bin, round(sum(value * quality) / case when sum(quality) = 0 then 1 else sum(quality) end, 7) as weighted from px_obs group by 1, 2", "px_obs")
def bins_weighted(spark, d):
    px = px_obs(spark, d).withColumn("hours", F.unix_micros(F.col("ts").cast("timestamp")) / 3.6e9)
    return timeline.hour_bins(px, ["source_id"], 720.0, ["weighted"]).select("source_id", "bin", r("weighted", F.col("weighted"), 7))


for _u in ("hour", "day", "week", "month"):

    def _calendar(spark, d, u=_u):
        return timeline.calendar_bins(series(spark, d), ["sensor"], u).select("sensor", "start", r("mean", F.col("mean")), "n")

    _calendar.__name__ = f"resample_{_u}"
    query(f"select sensor, date_trunc('{_u}', ts)::timestamp as start, round(avg(value), 6) as mean, count(value) as n from series group by 1, 2", "series")(_calendar)


_TARGETS = "t as (select entity, id, hours from series where sensor = 'purchase'), s as (select entity, hours as at, avg(value) as v from series where sensor = 'view' group by 1, 2), b as (select t.entity, t.id, t.hours, s.at as t0, s.v as v0 from t asof left join s on t.entity = s.entity and t.hours >= s.at), a as (select t.id, s.at as t1, s.v as v1 from t asof left join s on t.entity = s.entity and t.hours <= s.at)"


def _found(spark, d):
    s = series(spark, d)
    targets = s.where("sensor = 'purchase'").select("entity", "id", "hours")
    samples = s.where("sensor = 'view'").groupBy("entity", "hours").agg(F.avg("value").alias("value"))
    return timeline.as_of(targets, samples, ["entity"])


@query(f"with {_TARGETS} select b.id, round(case when t0 = t1 then v0 else v0 + (v1 - v0) * (hours - t0) / (t1 - t0) end, 6) + 0.0 as linear, round(case when t0 is null then v1 when t1 is null then v0 when hours - t0 <= t1 - hours then v0 else v1 end, 6) as nearest, round(v0, 6) as previous, round(v1, 6) as next from b join a using (id) where t0 is not null or t1 is not null", "series")
def as_of_interpolate(spark, d):
    f = _found(spark, d).where("before_at is not null or after_at is not null")
    for m in ("linear", "nearest", "previous", "next"):
        f = timeline.interpolate(f, "hours", m).withColumnRenamed("interpolated", m)
    return f.select("id", *[r(m, F.col(m)) for m in ("linear", "nearest", "previous", "next")])


@query(f"with {_TARGETS} select b.id, round(least(hours - t0, t1 - hours), 6) + 0.0 as distance, round(case when t0 is null then v1 when t1 is null then v0 when hours - t0 <= t1 - hours then v0 else v1 end, 6) as value from b join a using (id) where least(hours - t0, t1 - hours) <= 24", "series")
def nearest_within_tolerance(spark, d):
    f = timeline.nearest_within(_found(spark, d), 24.0)
    return f.select("id", r("distance", F.col("distance")), r("value", F.col("interpolated")))


@query("with s as (select sensor, hours, avg(value) as v from series group by 1, 2), m as (select sensor, ceil(min(hours) / 6)::bigint as lo, floor(max(hours) / 6)::bigint as hi from s group by 1), t as (select sensor, unnest(range(lo, hi + 1)) * 6.0 as hours from m), b as (select t.sensor, t.hours, s.hours as t0, s.v as v0 from t asof left join s on t.sensor = s.sensor and t.hours >= s.hours), a as (select t.sensor, t.hours, s.hours as t1, s.v as v1 from t asof left join s on t.sensor = s.sensor and t.hours <= s.hours) select sensor, round(hours, 6)::double as hours, round(case when t1 - t0 > 3 then null when t0 = t1 then v0 else v0 + (v1 - v0) * (hours - t0) / (t1 - t0) end, 6) as value from b join a using (sensor, hours)", "series")
def dense_timeline(spark, d):
    s = series(spark, d).groupBy("sensor", "hours").agg(F.avg("value").alias("value"))
    t = timeline.regular_times(s, ["sensor"], 6.0)
    f = timeline.interpolate(timeline.as_of(t, s, ["sensor"]), "hours", "linear", 3.0)
    return f.select("sensor", r("hours", F.col("hours")), r("value", F.col("interpolated")))


@query("select a.id from series a where a.sensor = 'purchase' and exists (select 1 from series b where b.sensor = 'click' and b.entity = a.entity and abs(a.hours - b.hours) <= 12)", "series")
def overlapping_times(spark, d):
    s = series(spark, d)
    return timeline.overlapping(s.where("sensor = 'purchase'"), s.where("sensor = 'click'"), ["entity"], 12.0).select("id")


@query("with i as (select entity, lag(hours) over (partition by entity order by hours) as b, hours as e from series), g as (select entity, 'inner' as kind, b, e from i where b is not null union all select entity, 'leading', 0.0, min(hours) from series group by 1 union all select entity, 'trailing', max(hours), 744.0 from series group by 1) select entity, kind, round(b, 6) + 0.0 as begins, round(e, 6) as ends, round(e - b, 6) as hours from g where e - b > 24", "series")
def temporal_gaps(spark, d):
    g = timeline.gaps(series(spark, d), ["entity"], 0.0, 744.0, 24.0)
    return g.select("entity", "kind", r("begins", F.col("begins")), r("ends", F.col("ends")), r("hours", F.col("hours")))


_STEPS = "s as (select *, lag(hours) over w as p, lag(value) over w as pv from series window w as (partition by entity order by hours, id))"


@query(f"with {_STEPS} select entity, count(*) as n, round(avg(hours - p), 6) as mean_gap, round(max(hours - p), 6) as max_gap, round(min(hours - p), 6) + 0.0 as min_gap, count(*) filter (value > pv) as rises, count(*) filter (value < pv) as falls, count(*) filter (value < pv) > 0.2 * count(pv) as violates from s group by 1 having count(*) > 1", "series")
def monotonicity(spark, d):
    s = timeline.steps_of(series(spark, d), ["entity"])
    up, down = F.count(F.when(F.col("delta") > 0, 1)), F.count(F.when(F.col("delta") < 0, 1))
    return s.groupBy("entity").agg(F.count("*").alias("n"), r("mean_gap", F.avg("gap")), r("max_gap", F.max("gap")), r("min_gap", F.min("gap")), up.alias("rises"), down.alias("falls"), (down > 0.2 * F.count("delta")).alias("violates")).where("n > 1")


@query(f"with {_STEPS}, x as (select sensor, entity, id, abs(value - pv) / (hours - p) as rate from s where hours > p), m as (select avg(rate) as mu, stddev_pop(rate) as sd from x) select id, round(rate, 4) as rate from x cross join m where rate > mu + 0.5 * sd", "series")
def rate_of_change(spark, d):
    from tellurion.operators.zonal import with_totals

    s = timeline.steps_of(series(spark, d), ["entity"]).where("gap > 0").withColumn("rate", F.abs(F.col("delta")) / F.col("gap"))
    s = with_totals(s, mu=F.avg("rate"), sd=F.stddev_pop("rate"))
    return s.where("rate > mu + 0.5 * sd").select("id", r("rate", F.col("rate"), 4))


@query(f"with {_STEPS}, m as (select entity, avg(value - pv) as mu, stddev_pop(value - pv) as sd from s group by 1) select id, round((value - pv - mu) / sd, 6) + 0.0 as z from s join m using (entity) where sd > 0 and abs((value - pv - mu) / sd) > 2.5", "series")
def sudden_changes(spark, d):
    from tellurion.operators.zonal import with_group_totals

    s = with_group_totals(timeline.steps_of(series(spark, d), ["entity"]), ["entity"], mu=F.avg("delta"), sd=F.stddev_pop("delta"))
    return s.where("sd > 0").withColumn("z", (F.col("delta") - F.col("mu")) / F.col("sd")).where("abs(z) > 2.5").select("id", r("z", F.col("z")))


@query("with m as (select entity, avg(value) as mu, var_pop(value) as v from series group by 1), d as (select entity, value - mu as dev, v, lead(value - mu) over (partition by entity order by hours, id) as nx from series join m using (entity)) select entity, round(avg(dev * nx) / max(v), 6) + 0.0 as lag1 from d group by 1 having max(v) > 0 and count(nx) > 0", "series")
def lag1_autocorrelation(spark, d):
    return timeline.autocorrelation(series(spark, d), ["entity"]).where("lag1 is not null").select("entity", r("lag1", F.col("lag1")))


@query("with f as (select *, sum(case when value > 40 then 0 else 1 end) over (partition by sensor order by hours, id rows unbounded preceding) as island from series), g as (select sensor, island, count(*) as rows, min(hours) as b, max(hours) as e from f where value > 40 group by 1, 2) select sensor, count(*) as runs, max(rows) as longest, round(avg(rows), 6) as mean_rows, round(avg(e - b), 6) as mean_hours from g group by 1", "series")
def exceedance_runs(spark, d):
    g = timeline.runs(series(spark, d), ["sensor"], F.col("value") > 40)
    return g.groupBy("sensor").agg(F.count("*").alias("runs"), F.max("rows").alias("longest"), r("mean_rows", F.avg("rows")), r("mean_hours", F.avg(F.col("ends") - F.col("begins"))))


@query("select sensor, round(avg((value > 40)::double), 6) as probability, round(max(value), 6) as peak, round(sum(value), 4) as cumulative from series group by 1", "series")
def exceedance_probability_over_time(spark, d):
    return series(spark, d).groupBy("sensor").agg(r("probability", F.avg((F.col("value") > 40).cast("double"))), r("peak", F.max("value")), r("cumulative", F.sum("value"), 4))


@query("with s as (select *, sum(value) over (partition by entity order by hours, id rows unbounded preceding) as c from series) select id, round(c, 4) as cumulative, case when c < 100 then 'none' when c < 300 then 'minor' when c < 600 then 'moderate' when c < 1000 then 'major' else 'extreme' end as impact from s", "series")
def running_impact(spark, d):
    from tellurion.functions.base import steps

    w = Window.partitionBy("entity").orderBy("hours", "id").rowsBetween(Window.unboundedPreceding, 0)
    s = series(spark, d).withColumn("c", F.sum("value").over(w))
    return s.select("id", r("cumulative", F.col("c"), 4), steps(F.col("c"), [100.0, 300.0, 600.0, 1000.0], ["none", "minor", "moderate", "major"], "extreme").alias("impact"))


@query("with p as (select entity, max(hours) as pre from series where hours < 360 group by 1), q as (select entity, min(hours) as post from series where hours >= 360 group by 1) select entity, round(pre, 6) as pre, round(post, 6) as post, round(post - pre, 6) as gap, case when post - 360 <= 24 then 'OPTIMAL' when post - 360 <= 72 then 'GOOD' when post - 360 <= 168 then 'ACCEPTABLE' else 'POOR' end as timing from p join q using (entity) where post - pre >= 1", "series")
def event_timing(spark, d):
    from tellurion.functions.base import steps

    e = series(spark, d).groupBy("entity").agg(F.max(F.when(F.col("hours") < 360, F.col("hours"))).alias("pre"), F.min(F.when(F.col("hours") >= 360, F.col("hours"))).alias("post")).where("post - pre >= 1")
    late = F.col("post") - 360
    timing = F.when(late <= 24, "OPTIMAL").when(late <= 72, "GOOD").when(late <= 168, "ACCEPTABLE").otherwise("POOR")
    return e.select("entity", r("pre", F.col("pre")), r("post", F.col("post")), r("gap", F.col("post") - F.col("pre")), timing.alias("timing"))


@query("select a.sensor as a, b.sensor as b, count(*) as pairs from series a join series b on a.entity = b.entity and a.sensor < b.sensor and abs(a.hours - b.hours) <= 3 group by 1, 2", "series")
def sensor_coincidence(spark, d):
    """Pairs of readings of an entity by two sensors within three hours, by bins of three hours that meet by equality."""
    s = series(spark, d).withColumn("cell", F.floor(F.col("hours") / 3))
    a = s.select(F.col("sensor").alias("a"), "entity", F.col("hours").alias("ha"), "cell")
    b = s.select(F.col("sensor").alias("b"), "entity", F.col("hours").alias("hb"), F.explode(F.array(F.col("cell") - 1, F.col("cell"), F.col("cell") + 1)).alias("cell"))
    return a.join(b, ["entity", "cell"]).where("a < b and abs(ha - hb) <= 3").groupBy("a", "b").agg(F.count("*").alias("pairs"))


@query("select event_type as sensor, json_extract_string(props, '$.k')::int as k, count(*) as n, round(avg(value), 6) as mean from events group by 1, 2")
def json_properties(spark, d):
    from .fixtures import table

    e = table(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    return e.groupBy(F.col("event_type").alias("sensor"), "k").agg(F.count("*").alias("n"), r("mean", F.avg("value")))


@query("select event_id, epoch_us(ts) // 1000000 as epoch, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') as iso, strftime(ts, '%Y%m%d') as compact from events")
def timestamp_formats(spark, d):
    """Instants written in several formats and read back by the first format that fits."""
    from .fixtures import table

    e = table(spark, d, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("iso"), F.date_format("ts", "yyyyMMdd").alias("compact"))
    parsed = F.coalesce(*[F.try_to_timestamp("iso", F.lit(p)) for p in ("yyyy-MM-dd'T'HH:mm:ss'Z'", "yyyy-MM-dd", "yyyyMMdd")])
    return e.select("event_id", F.unix_timestamp(parsed).alias("epoch"), "iso", "compact")
