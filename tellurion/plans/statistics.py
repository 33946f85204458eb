"""Queries of statistics: bands, histograms, samples, ensembles of members, calibration and history."""

from __future__ import annotations

from pyspark.sql import functions as F

from tellurion.functions.base import rounded, uniform_sql
from tellurion.operators import stats

from .fixtures import binary_labels, forecast, members, px_layers, px_obs, px_static, series
from .registry import query

CELL = ["row", "col"]


def r(name, expr, digits=6):
    return rounded(expr, digits).alias(name)


_P = ", ".join(f"round(quantile_cont(value, {p / 100}), 7) as p{p}" for p in stats.PERCENTILES)


@query(f"select source_id, count(*) as n, count(value) as valid, min(value) as min, max(value) as max, round(avg(value), 6) as mean, round(stddev_pop(value), 6) as std, round(median(value), 7) as median, round(var_pop(value), 6) as variance, round(sum(value), 4) as sum, count(distinct value) as distinct_values, round(stddev_pop(value) / avg(value), 6) as cv, round(avg(value) / stddev_pop(value), 6) as snr, {_P} from px_obs group by 1", "px_obs")
def band_stats(spark, d):
    s = stats.band_statistics(px_obs(spark, d), ["source_id"])
    return s.select("source_id", "n", "valid", "min", "max", *[r(c, F.col(c)) for c in ("mean", "std", "variance", "cv", "snr")], r("median", F.col("p50"), 7), r("sum", F.col("sum"), 4), F.col("distinct").alias("distinct_values"), *[r(f"p{p}", F.col(f"p{p}"), 7) for p in stats.PERCENTILES])


@query("with q as (select source_id, avg(value) as m, stddev_pop(value) as s, min(value) as lo, max(value) as hi, quantile_cont(value, 0.02) as p2, quantile_cont(value, 0.98) as p98 from px_layers group by 1) select source_id, round(lo, 7) as minmax_low, round(hi, 7) as minmax_high, round(p2, 7) as percentile_low, round(p98, 7) as percentile_high, round(m - 2 * s, 6) as stddev_low, round(m + 2 * s, 6) as stddev_high from q", "px_layers")
def stretch_parameters(spark, d):
    s = stats.band_statistics(px_layers(spark, d), ["source_id"])
    return s.select("source_id", r("minmax_low", F.col("min"), 7), r("minmax_high", F.col("max"), 7), r("percentile_low", F.col("p2"), 7), r("percentile_high", F.col("p98"), 7), r("stddev_low", F.col("mean") - 2 * F.col("std")), r("stddev_high", F.col("mean") + 2 * F.col("std")))


@query("with m as (select source_id, min(value) as lo, max(value) as hi from px_obs group by 1) select source_id, least(9, floor((value - lo) / ((hi - lo) / 10))::int)::int as bin, count(*) as n from px_obs join m using (source_id) group by 1, 2", "px_obs")
def histogram_linear(spark, d):
    return stats.histogram(px_obs(spark, d), ["source_id"])


@query("with x as (select sensor, ln(1 + value) as v from series), m as (select sensor, min(v) as lo, max(v) as hi from x group by 1) select sensor, least(9, floor((v - lo) / ((hi - lo) / 10))::int)::int as bin, count(*) as n from x join m using (sensor) group by 1, 2", "series")
def histogram_log(spark, d):
    return stats.histogram(series(spark, d), ["sensor"], log=True)


@query("with q as (select sensor, quantile_cont(value, [0.25, 0.5, 0.75]) as q from series group by 1) select sensor, len(list_filter(q, lambda z: z <= value))::int as bin, count(*) as n from series join q using (sensor) group by 1, 2", "series")
def histogram_percentile(spark, d):
    return stats.percentile_histogram(series(spark, d), ["sensor"])


@query("with m as (select sensor, count(value) as n, avg(value) as mu, stddev_samp(value) as sd, var_pop(value) as m2, quantile_cont(value, 0.25) as q1, quantile_cont(value, 0.75) as q3 from series group by 1), c as (select sensor, avg(power(value - mu, 3)) as m3, avg(power(value - mu, 4)) as m4 from series join m using (sensor) group by 1) select sensor, n, round(mu, 6) as mean, round(sd, 6) as std, round(sd / sqrt(n), 6) as se, round(sd / mu, 6) as cv, round(sqrt(n * (n - 1)) / (n - 2) * m3 / power(m2, 1.5), 5) as skewness, round((n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * (m4 / power(m2, 2) - 3) + 6), 4) as kurtosis, round(q3 - q1, 6) as iqr, round(mu - 1.96 * sd / sqrt(n), 6) as low95, round(mu + 2.576 * sd / sqrt(n), 6) as high99 from m join c using (sensor)", "series")
def sample_metrics(spark, d):
    s = stats.sample_metrics(series(spark, d), ["sensor"])
    return s.select("sensor", "n", *[r(c, F.col(c)) for c in ("mean", "std", "se", "cv", "iqr", "low95", "high99")], r("skewness", F.col("skewness"), 5), r("kurtosis", F.col("kurtosis"), 4))


_TIMES = "case when u < 0.36787944 then 0 when u < 0.73575888 then 1 when u < 0.91969860 then 2 when u < 0.98101184 then 3 when u < 0.99634015 then 4 else 5 end"


@query(f"with d as (select sensor, id, value, unnest(range(1, 51)) as draw from series), u as (select sensor, value, draw, {uniform_sql('id', 'draw', '1')} as u from d), t as (select sensor, draw, value, unnest(range({_TIMES})) as k from u), s as (select sensor, draw, median(value) as s from t group by 1, 2) select sensor, round(avg(s), 6) as mean, round(quantile_cont(s, 0.025), 6) as low, round(quantile_cont(s, 0.975), 6) as high from s group by 1", "series")
def bootstrap_interval(spark, d):
    """Interval of each sensor's median from 50 resamples."""
    b = stats.bootstrap(series(spark, d).select("sensor", "id", "value"), ["sensor"], F.median("value"), resamples=50, names=["id"])
    return b.select("sensor", r("mean", F.col("mean")), r("low", F.col("low")), r("high", F.col("high")))


@query("with s as (select cell, avg(value) as mean, stddev_samp(value) as std, max(value) - min(value) as spread, quantile_cont(value, 0.025) as low, quantile_cont(value, 0.975) as high, avg((value > 0.05)::double) as p from members group by 1) select cell, round(mean, 6) + 0.0 as mean, round(std, 6) as std, round(spread, 6) as spread, round(low, 6) + 0.0 as low, round(high, 6) + 0.0 as high, round(greatest(p, 1 - p), 6) as agreement, round(case when p <= 0 or p >= 1 then 0 else -(p * log2(p) + (1 - p) * log2(1 - p)) end, 6) + 0.0 as entropy from s", "members")
def ensemble_members(spark, d):
    v = F.col("value")
    s = members(spark, d).groupBy("cell").agg(F.avg(v).alias("m"), F.stddev_samp(v).alias("s"), (F.max(v) - F.min(v)).alias("sp"), F.percentile(v, F.lit(0.025)).alias("lo"), F.percentile(v, F.lit(0.975)).alias("hi"), F.avg((v > 0.05).cast("double")).alias("p"))
    p = F.col("p")
    return s.select("cell", r("mean", F.col("m")), r("std", F.col("s")), r("spread", F.col("sp")), r("low", F.col("lo")), r("high", F.col("hi")), r("agreement", F.greatest(p, 1 - p)), r("entropy", F.when((p <= 0) | (p >= 1), 0.0).otherwise(-(p * F.log2(p) + (1 - p) * F.log2(1 - p)))))


@query("with m as (select cell, avg(value) as mu, stddev_pop(value) as sd from members group by 1) select member, count(*) as outliers from members join m using (cell) where abs(value - mu) > 2.5 * sd group by 1", "members")
def outlier_members(spark, d):
    from tellurion.operators.zonal import with_group_totals

    x = with_group_totals(members(spark, d), ["cell"], mu=F.avg("value"), sd=F.stddev_pop("value"))
    return x.where(F.abs(F.col("value") - F.col("mu")) > 2.5 * F.col("sd")).groupBy("member").agg(F.count("*").alias("outliers"))


@query("with c as (select row, col, source_id, count(*) as n from px_obs group by all), t as (select row, col, sum(n) as t, sum(n * log2(n)) as s from c group by 1, 2) select row, col, round(log2(t) - s / t, 6) + 0.0 as entropy from t", "px_obs")
def source_entropy(spark, d):
    c = px_obs(spark, d).groupBy(*CELL, "source_id").agg(F.count("*").alias("n"))
    return stats.entropy(c, CELL).select(*CELL, r("entropy", F.col("entropy")))


@query("select least(9, floor(p * 10)::int)::int as bin, count(*) as n, round(avg(p), 6) as mean_p, round(avg(o), 6) as mean_o from forecast group by 1", "forecast")
def reliability_diagram(spark, d):
    return stats.calibration(forecast(spark, d)).select("bin", "n", r("mean_p", F.col("mean_p")), r("mean_o", F.col("mean_o")))


@query("with b as (select least(9, floor(p * 10)::int) as bin, count(*) as n, avg(p) as mp, avg(o) as mo from forecast group by 1), t as (select count(*) as t, avg(power(p - o, 2)) as brier, avg(o) as base from forecast) select round(sum(n / t * abs(mp - mo)), 6) as ece, round(max(abs(mp - mo)), 6) as mce, round(max(brier), 6) as brier, round(sum(n / t * power(mp - mo, 2)), 6) as reliability, round(sum(n / t * power(mo - base, 2)), 6) as resolution, round(max(base * (1 - base)), 6) as uncertainty from b cross join t", "forecast")
def calibration_errors(spark, d):
    c = stats.calibration_errors(forecast(spark, d))
    return c.select(*[r(x, F.col(x)) for x in c.columns])


_SKILL = "hits, misses, false_alarms, correct_negatives, round(h / (h + m), 6) as pod, round(a / (h + a), 6) as far, round(h / (h + m + a), 6) as csi, round((h + a) / (h + m), 6) as bias, round(2 * (h * n - m * a) / ((h + m) * (m + n) + (h + a) * (a + n)), 6) + 0.0 as hss, round(h / (h + m) - a / (a + n), 6) + 0.0 as pss, round(h / (h + m + a), 6) as iou, round(((h + n) / t - e) / (1 - e), 6) + 0.0 as kappa"


@query(f"with c as (select count(*) filter (forecast = 1 and observed = 1) as hits, count(*) filter (forecast <> 1 and observed = 1) as misses, count(*) filter (forecast = 1 and observed <> 1) as false_alarms, count(*) filter (forecast <> 1 and observed <> 1) as correct_negatives from binary_labels), x as (select *, hits::double as h, misses::double as m, false_alarms::double as a, correct_negatives::double as n, (hits + misses + false_alarms + correct_negatives)::double as t from c), y as (select *, ((h + m) * (h + a) + (n + m) * (n + a)) / (t * t) as e from x) select {_SKILL} from y", "binary_labels")
def contingency(spark, d):
    c = stats.contingency(binary_labels(spark, d), [], "forecast", "observed")
    return c.select("hits", "misses", "false_alarms", "correct_negatives", *[r(x, F.col(x)) for x in c.columns[4:]])


@query(f"with c as (select lead, count(*) filter (p >= 0.5 and o = 1) as hits, count(*) filter (p < 0.5 and o = 1) as misses, count(*) filter (p >= 0.5 and o = 0) as false_alarms, count(*) filter (p < 0.5 and o = 0) as correct_negatives from forecast group by 1), x as (select *, hits::double as h, misses::double as m, false_alarms::double as a, correct_negatives::double as n, (hits + misses + false_alarms + correct_negatives)::double as t from c), y as (select *, ((h + m) * (h + a) + (n + m) * (n + a)) / (t * t) as e from x) select lead, {_SKILL} from y", "forecast")
def skill_by_lead(spark, d):
    c = stats.contingency(forecast(spark, d).withColumn("f", (F.col("p") >= 0.5).cast("int")), ["lead"], "f", "o")
    return c.select("lead", "hits", "misses", "false_alarms", "correct_negatives", *[r(x, F.col(x)) for x in c.columns[5:]])


@query("select lead, count(*) as n, round(sqrt(avg(power(p - o, 2))), 6) as rmse, round(avg(abs(p - o)), 6) as mae, round(avg(p - o), 6) + 0.0 as bias, round(corr(p, o), 6) + 0.0 as correlation, round(1 - var_pop(p - o) / var_pop(o), 6) + 0.0 as explained from forecast group by 1", "forecast")
def continuous_metrics(spark, d):
    e = F.col("p") - F.col("o")
    return forecast(spark, d).groupBy("lead").agg(F.count("*").alias("n"), r("rmse", F.sqrt(F.avg(e * e))), r("mae", F.avg(F.abs(e))), r("bias", F.avg(e)), r("correlation", F.corr("p", F.col("o").cast("double"))), r("explained", 1 - F.var_pop(e) / F.var_pop("o")))


@query("with b as (select month(ts)::int as month, avg(value) as m, stddev_pop(value) as s, min(value) as lo, max(value) as hi from px_obs where ts < timestamp '2000-01-01' group by 1), c as (select month(ts)::int as month, avg(value) as v, max(value) as mx from px_obs where ts >= timestamp '2000-01-01' group by 1) select month, round(m, 6) as baseline, round(v, 6) as current, round((v - m) / s, 6) + 0.0 as z, mx > hi as exceeds, case when abs((v - m) / s) > 3 then 'extreme' when abs((v - m) / s) > 2 then 'high' when abs((v - m) / s) > 0.02 then 'moderate' else 'normal' end as severity from b join c using (month)", "px_obs")
def historical_anomaly(spark, d):
    px = px_obs(spark, d).withColumn("month", F.month("ts"))
    old = F.col("ts") < F.lit("2000-01-01").cast("timestamp_ntz")
    s = px.groupBy("month").agg(*[f(F.when(old, F.col("value"))).alias(n) for f, n in ((F.avg, "m"), (F.stddev_pop, "s"), (F.max, "hi"))], F.avg(F.when(~old, F.col("value"))).alias("v"), F.max(F.when(~old, F.col("value"))).alias("mx")).where("v is not null and m is not null")
    z = (F.col("v") - F.col("m")) / F.col("s")
    return s.select("month", r("baseline", F.col("m")), r("current", F.col("v")), r("z", z), (F.col("mx") > F.col("hi")).alias("exceeds"), F.when(F.abs(z) > 3, "extreme").when(F.abs(z) > 2, "high").when(F.abs(z) > 0.02, "moderate").otherwise("normal").alias("severity"))


@query("with k as (select quantile_cont(elev, [0.05, 0.25, 0.5, 0.75, 0.95]) as q from px_static) select row, col, round(case when elev < q[1] then 0 when elev <= q[2] then 5 + 20 * (elev - q[1]) / (q[2] - q[1]) when elev <= q[3] then 25 + 25 * (elev - q[2]) / (q[3] - q[2]) when elev <= q[4] then 50 + 25 * (elev - q[3]) / (q[4] - q[3]) when elev <= q[5] then 75 + 20 * (elev - q[4]) / (q[5] - q[4]) else 100 end, 6) + 0.0 as percentile from px_static cross join k", "px_static")
def historical_percentile(spark, d):
    from tellurion.operators.zonal import with_totals

    px = px_static(spark, d)
    ps = (5.0, 25.0, 50.0, 75.0, 95.0)
    px = with_totals(px, q=F.percentile("elev", F.array(*[F.lit(p / 100) for p in ps])))
    return px.select(*CELL, r("percentile", stats.percentile_of(F.col("elev"), [(F.get("q", i), p) for i, p in enumerate(ps)])))


@query("with b as (select row, col, avg(value) as m, stddev_pop(value) as s, count(*) as n from px_obs where ts < timestamp '2000-01-01' group by 1, 2), c as (select row, col, avg(value) as v from px_obs where ts >= timestamp '2000-01-01' group by 1, 2) select row, col, round((v - m) / s, 6) + 0.0 as z from b join c using (row, col) where s > 0 and abs((v - m) / s) > 1", "px_obs")
def spatial_anomaly(spark, d):
    old = F.col("ts") < F.lit("2000-01-01").cast("timestamp_ntz")
    s = px_obs(spark, d).groupBy(*CELL).agg(F.avg(F.when(old, F.col("value"))).alias("m"), F.stddev_pop(F.when(old, F.col("value"))).alias("s"), F.avg(F.when(~old, F.col("value"))).alias("v")).where("s > 0 and v is not null")
    return s.select(*CELL, r("z", (F.col("v") - F.col("m")) / F.col("s"))).where("abs(z) > 1")


@query("select split_part(event_type, 'e', 1) as family, event_type, grouping_id(split_part(event_type, 'e', 1), event_type)::bigint as level, count(*) as n, count(distinct user_id) as users from events group by rollup (split_part(event_type, 'e', 1), event_type)")
def class_rollup(spark, d):
    from .fixtures import table

    e = table(spark, d, "events").withColumn("family", F.split_part("event_type", F.lit("e"), F.lit(1)))
    return e.rollup("family", "event_type").agg(F.grouping_id().cast("bigint").alias("level"), F.count("*").alias("n"), F.countDistinct("user_id").alias("users"))


@query("select corr(value, hours) is null as flat, sensor, round(corr(value, hours), 6) + 0.0 as correlation, round(covar_samp(value, hours) / var_pop(hours), 6) + 0.0 as slope, round(covar_samp(value, hours) / var_pop(hours) * avg(hours) / avg(value), 6) + 0.0 as elasticity from series group by sensor having count(*) >= 10", "series")
def sensitivity(spark, d):
    g = series(spark, d).groupBy("sensor").agg(F.count("*").alias("n"), F.corr("value", "hours").alias("c"), (F.covar_samp("value", "hours") / F.var_pop("hours")).alias("s"), F.avg("hours").alias("h"), F.avg("value").alias("v")).where("n >= 10")
    return g.select(F.col("c").isNull().alias("flat"), "sensor", r("correlation", F.col("c")), r("slope", F.col("s")), r("elasticity", F.col("s") * F.col("h") / F.col("v")))
