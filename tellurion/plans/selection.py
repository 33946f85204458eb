"""Queries of data selection: soft constraints, sensors, fusion plans, pairs and grids."""

from __future__ import annotations

from pyspark.sql import functions as F

from tellurion.functions.base import rounded
from tellurion.operators import selection as S

from .fixtures import candidates, series, table
from .registry import query


def r(name, expr, digits=6):
    return rounded(expr, digits).alias(name)


def _case(c, d, otherwise):
    return f"case {c} " + " ".join(f"when '{k}' then {v}::double" for k, v in d.items()) + f" else {otherwise} end"


def scenes(spark, d):
    """candidates with what scenes tell of themselves."""
    c = candidates(spark, d)
    k = F.col("dataset_id")
    return c.select(
        "*", (k % 11 != 0).alias("available"), F.when(k % 4 == 0, (k % 9) / 2).alias("looks"), F.when(k % 4 == 1, (k % 20 - 30).cast("double")).alias("noise_db"), F.when(k % 4 == 2, F.col("flag")).alias("sar_quality"),
        F.when(k % 5 == 0, (k % 40).cast("double")).alias("accuracy_m"), F.when(k % 5 == 1, k % 2 == 0).alias("ortho"), F.when(k % 5 == 2, F.when(k % 3 == 0, "L2A").when(k % 3 == 1, "L1C_x").otherwise("l0")).alias("level"),
        F.when(k % 7 < 5, k % 120 - 59.75).alias("lat"), F.when(k % 7 < 5, k % 300 - 150.0).alias("lon"), F.when(k % 7 == 5, F.concat(F.lit("t"), (k % 3).cast("string"))).alias("tile"),
        F.when(k % 3 == 0, (k % 50).cast("double")).alias("off_nadir"), F.when(k % 3 == 1, (k % 90).cast("double")).alias("sun"), F.when(k % 4 < 3, (15 + k % 50).cast("double")).alias("incidence"), F.when(k % 2 == 0, "ascending").alias("look"),
    )


_SCENES = "scenes as (select *, dataset_id % 11 <> 0 as available, case when dataset_id % 4 = 0 then (dataset_id % 9) / 2 end as looks, case when dataset_id % 4 = 1 then (dataset_id % 20 - 30)::double end as noise_db, case when dataset_id % 4 = 2 then flag end as sar_quality, case when dataset_id % 5 = 0 then (dataset_id % 40)::double end as accuracy_m, case when dataset_id % 5 = 1 then dataset_id % 2 = 0 end as ortho, case when dataset_id % 5 = 2 then case dataset_id % 3 when 0 then 'L2A' when 1 then 'L1C_x' else 'l0' end end as level, case when dataset_id % 7 < 5 then dataset_id % 120 - 59.75::double end as lat, case when dataset_id % 7 < 5 then dataset_id % 300 - 150.0::double end as lon, case when dataset_id % 7 = 5 then 't' || (dataset_id % 3) end as tile, case when dataset_id % 3 = 0 then (dataset_id % 50)::double end as off_nadir, case when dataset_id % 3 = 1 then (dataset_id % 90)::double end as sun, case when dataset_id % 4 < 3 then (15 + dataset_id % 50)::double end as incidence, case when dataset_id % 2 = 0 then 'ascending' end as look from candidates)"
_LEVEL = "case " + " ".join(f"when contains(upper(level), '{k}') then {v}::double" for k, v in S.LEVELS.items()) + " else 0.7::double end"
_SOFT = f"""{_SCENES}, parts as (select dataset_id, data_type,
 case when not available then 0.0::double else {_case("coalesce(cost_tier, 'open')", S.TIERS, 0.5)} end as availability,
 case when looks is not null then least(1, looks / 4) when noise_db is not null then greatest(0, least(1, 1 - (noise_db + 25) / 10)) when sar_quality is not null then {_case("lower(sar_quality)", S.LABELS, 0.5)} else 0.7::double end as noise,
 case when accuracy_m is not null then exp(-accuracy_m / 10) when ortho then 1.0::double when not ortho then 0.6::double else {_LEVEL} end as geometry,
 coalesce(case when lat is not null then greatest(0.2::double, exp(-sqrt(power(abs(lat - 10) * 111, 2) + power(abs(lon - 20) * 111 * cos(radians((lat + 10) / 2)), 2)) / 50)) end, case when tile = 't1' then 1.0::double when tile is not null then 0.6::double end, case when coverage >= 95 then 0.95::double when coverage >= 80 then 0.85::double else 0.7::double end) as proximity,
 coalesce(case when data_type = 'optical' then coalesce(case when off_nadir is not null then greatest(0.1::double, least(1, exp(-off_nadir / 20))) end, case when sun is not null then greatest(0.1::double, least(1, sun / 90)) end) when data_type = 'sar' then case when incidence between 30 and 45 then 1.0::double when incidence between 20 and 55 then 0.8::double when incidence is not null then greatest(0.3::double, 1 - least(abs(incidence - 30), abs(incidence - 45)) / 30) when look is not null then 0.85::double end end, 0.75::double) as angle from scenes)"""


@query(f"with {_SOFT} select dataset_id, round(availability, 6) as availability, round(noise, 6) as noise, round(geometry, 6) as geometry, round(proximity, 6) as proximity, round(angle, 6) as angle, round((0.3::double * availability + 0.2::double * geometry + 0.2::double * proximity + case when data_type = 'sar' then 0.15::double * noise else 0 end + case when data_type in ('sar', 'optical') then 0.15::double * angle else 0 end) / (0.7::double + case when data_type = 'sar' then 0.15::double else 0 end + case when data_type in ('sar', 'optical') then 0.15::double else 0 end), 6) as score from parts", "candidates")
def soft_constraints(spark, d):
    s = scenes(spark, d)
    c = F.col
    s = s.select(
        "dataset_id", "data_type", S.availability(c("available"), c("cost_tier")).alias("availability"), S.sar_noise(c("looks"), c("noise_db"), c("sar_quality")).alias("noise"), S.geometric_accuracy(c("accuracy_m"), c("ortho"), c("level")).alias("geometry"),
        S.proximity(c("lat"), c("lon"), (10.0, 20.0), c("tile"), "t1", c("coverage")).alias("proximity"), S.view_angle(c("data_type"), c("off_nadir"), c("sun"), c("incidence"), c("look")).alias("angle"),
    )
    radar, imaging, always = c("data_type") == "sar", c("data_type").isin("sar", "optical"), F.lit(True)
    score = S.soft_score({"availability": (c("availability"), always, 0.3), "geometry": (c("geometry"), always, 0.2), "proximity": (c("proximity"), always, 0.2), "noise": (c("noise"), radar, 0.15), "angle": (c("angle"), imaging, 0.15)})
    return s.select("dataset_id", *[r(x, c(x)) for x in ("availability", "noise", "geometry", "proximity", "angle")], r("score", score))


_SENSORS = ("sar", "optical", "dem", "thermal", "ancillary")
_CLASSES = ("flood.coastal", "flood.urban", "wildfire.active", "wildfire.forest", "storm.tornado", "storm.coastal", "drought")


def situations(spark, d):
    """What is asked for at each customer: an event class, sensors there, weather."""
    k = F.col("c_custkey")
    bits = F.array_compact(F.array(*[F.when(F.shiftright(k, i).bitwiseAND(1) == 1, s) for i, s in enumerate(_SENSORS)]))
    return table(spark, d, "customer").select(k.alias("key"), F.element_at(F.array(*map(F.lit, _CLASSES)), (k % 7 + 1).cast("int")).alias("event_class"), bits.alias("available"), F.when(k % 9 != 0, (k * 7 % 101).cast("double")).alias("cloud"), (k % 3 == 0).alias("rain"), (k % 5 == 0).alias("dark"), (k % 2 == 0).alias("allow_degraded"))


_list = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]::varchar[]"
_SITUATIONS = f"situations as (select c_custkey as key, list_extract({_list(_CLASSES)}, (c_custkey % 7 + 1)::int) as event_class, list_filter([" + ", ".join(f"case when (c_custkey >> {i}) & 1 = 1 then '{s}' end" for i, s in enumerate(_SENSORS)) + "], lambda x: x is not null) as available, case when c_custkey % 9 <> 0 then (c_custkey * 7 % 101)::double end as cloud, c_custkey % 3 = 0 as rain, c_custkey % 5 = 0 as dark, c_custkey % 2 = 0 as allow_degraded from customer)"
_OBSERVED = "observed as (select *, unnest(case when event_class like 'flood%' then case when event_class like '%riverine%' or event_class like '%coastal%' then ['water_extent', 'terrain_height', 'flood_depth'] else ['water_extent', 'terrain_height'] end when event_class like 'wildfire%' then case when event_class like '%active%' or event_class like '%ongoing%' then ['burn_severity', 'active_fire'] else ['burn_severity'] end when event_class like 'storm%' then case when event_class like '%urban%' or event_class like '%tornado%' or event_class like '%hurricane%' then ['vegetation_damage', 'land_cover', 'structural_damage'] else ['vegetation_damage', 'land_cover'] end else []::varchar[] end) as observable from situations)"
_CAPABLE = "cap as (select * from (values " + ", ".join(f"('{o}', {p}, '{s}', '{c}', {_list(q)}, {_list(g)}, {_list(a)})" for o, p, s, c, q, g, a in S.CAPABILITIES) + ") v(observable, preference, sensor, confidence, requires, degrades, alternatives))"
_CHOSEN = f"""{_SITUATIONS}, {_OBSERVED}, {_CAPABLE}, base as (select key, observable, available, allow_degraded, cloud, rain, dark, preference, sensor, requires, alternatives, degrades, case confidence when 'high' then 3 when 'medium' then 2 else 1 end as lv, list_contains(degrades, 'cloud_cover') and cloud is not null as cl from observed join cap using (observable)),
lev as (select *, case when cl and cloud > 60 then case lv when 3 then 1 when 2 then 0 else lv end when cl and cloud > 30 then greatest(lv - 1, 0) else lv end as l2 from base),
met as (select *, case when (cl and cloud > 80) or (list_contains(degrades, 'darkness') and dark and sensor = 'optical') then 'unreliable' else ['unreliable', 'low', 'medium', 'high'][l2 + 1] end as now from lev),
why as (select *, case when not list_contains(available, sensor) then 'not_available' when now = 'unreliable' then 'unreliable_conditions' when now = 'low' and not allow_degraded then 'degraded_not_allowed' end as why from met),
pick as (select *, row_number() over (partition by key, observable order by preference) as n from why where why is null),
rel as (select key, observable, list(sensor) filter (now <> 'unreliable') as ok, list({{'p': preference, 's': sensor || ':' || why}} order by preference) as tried from why group by 1, 2),
chosen as (select p.key, p.observable, p.sensor, p.now, p.now = 'low' as degraded, list_sort(list_filter(p.alternatives, lambda s: list_contains(p.available, s) and list_contains(coalesce(rel.ok, []), s) and s <> p.sensor)) as supporting, list_transform(list_filter(rel.tried, lambda t: t.p < p.preference), lambda t: t.s) as rejected, p.requires from pick p join rel using (key, observable) where n = 1)"""


def _asked(spark, d):
    s = situations(spark, d)
    return s.select("key", "available", "cloud", "rain", "dark", "allow_degraded", F.explode(S.observables(F.col("event_class"))).alias("observable"))


@query(f"with {_CHOSEN} select key, observable, sensor, now, degraded, array_to_string(supporting, ',') as supporting, array_to_string(rejected, ',') as rejected from chosen")
def sensor_choice(spark, d):
    got = S.choose_sensors(_asked(spark, d), ["key"])
    return got.withColumn("supporting", F.concat_ws(",", "supporting")).withColumn("rejected", F.concat_ws(",", "rejected"))


@query(f"with {_CHOSEN} select key, observable, sensor from chosen join (select key, list(observable) as have from chosen group by 1) using (key) where list_has_all(have, requires)")
def sensor_sets(spark, d):
    return S.satisfied(S.choose_sensors(_asked(spark, d), ["key"]), ["key"]).select("key", "observable", "sensor")


@query(f"with {_SITUATIONS} select key, case when event_class like 'flood%' then case when coalesce(cloud, 0) > 80 then 'flood_sar_only' when list_contains(available, 'sar') and list_contains(available, 'optical') then 'flood_complementary' when list_contains(available, 'sar') then 'flood_sar_only' else 'temporal_densification' end when event_class like 'wildfire%' then 'wildfire_complementary' when event_class like 'storm%' then 'storm_redundant' else 'temporal_densification' end as configuration from situations")
def fusion_strategy(spark, d):
    return situations(spark, d).select("key", S.strategy(F.col("event_class"), F.col("available"), F.col("cloud")).alias("configuration"))


_FACTORS = f"list_filter([1 - cloud / 100, coverage / 100, exp(-resolution_m / 100), case when flag is not null then {_case('flag', S.LABELS, 0.5)} end], lambda x: x is not null)"


@query(f"with f as (select *, list_avg({_FACTORS}) as q from candidates where data_type in ('sar', 'optical') and resolution_m <= 60 and coalesce(cloud, 0) <= 60), n as (select *, row_number() over (partition by provider, data_type order by q desc, dataset_id) as n from (select provider, data_type, dataset_id, round(q, 9) as q, q as q0 from f)), s as (select provider, data_type, count(*) as n, sum(q0) as q from n where n <= 3 group by 1, 2), w as (select provider, count(*)::int as sensors, sum(n)::bigint as datasets, sum(case data_type when 'sar' then 0.6::double else 0.4::double end) as w, sum(q * case data_type when 'sar' then 0.6::double else 0.4::double end) as q from s group by 1) select provider, sensors, datasets, round(0.4::double * sensors / 2 + 0.6::double * q / w / datasets, 6) as confidence from w", "candidates")
def fusion_plan(spark, d):
    c = candidates(spark, d)
    order = [F.desc(F.round(S.quality_factor(F.col("cloud"), F.col("coverage"), F.col("resolution_m"), F.col("flag")), 9)), F.asc("dataset_id")]
    p = S.fusion_plan(c, ["provider"], {"sar": 0.6, "optical": 0.4}, (F.col("resolution_m") <= 60) & (F.coalesce("cloud", F.lit(0)) <= 60), 3, order)
    return p.select("provider", "sensors", "datasets", r("confidence", F.col("confidence")))


_RULES = "rules as (select * from (values " + ", ".join(f"('{a}', '{b}', '{o}', {x}::double, {y}::double)" for a, b, o, x, y, _, _ in S.RULES) + ") v(a, b, observable, low, high))"


@query(f"with s as (select unnest(['sar', 'optical', 'dem', 'thermal', 'lidar']) as s), p as (select x.s as sensor_a, y.s as sensor_b from s x cross join s y), {_RULES}, k as (select least(a, b) as a, greatest(a, b) as b, observable, low, high from rules) select sensor_a, sensor_b, observable, low as correlation_low, high as correlation_high, coalesce(least(sensor_a, sensor_b) || '|' || greatest(sensor_a, sensor_b) in ('optical|sar', 'optical|thermal', 'dem|sar', 'dem|optical'), false) as complementary from p left join k on least(sensor_a, sensor_b) = a and greatest(sensor_a, sensor_b) = b")
def sensor_pairs(spark, d):
    names = F.array(*map(F.lit, ("sar", "optical", "dem", "thermal", "lidar")))
    pairs = spark.range(1).select(F.explode(names).alias("sensor_a")).select("sensor_a", F.explode(names).alias("sensor_b"))
    known = S.rules(spark).select(F.least("sensor_a", "sensor_b").alias("a"), F.greatest("sensor_a", "sensor_b").alias("b"), "observable", "correlation_low", "correlation_high")
    met = pairs.join(F.broadcast(known), (F.least("sensor_a", "sensor_b") == F.col("a")) & (F.greatest("sensor_a", "sensor_b") == F.col("b")), "left")  # a rule table's rows
    return met.select("sensor_a", "sensor_b", "observable", "correlation_low", "correlation_high", S.complementary(F.col("sensor_a"), F.col("sensor_b")).alias("complementary"))


@query("with a as (select entity, hours from series where sensor = 'view'), b as (select entity, hours from series where sensor = 'purchase'), p as (select b.entity, a.hours as pre, b.hours as post, b.hours - a.hours as gap from a join b on a.entity = b.entity and b.hours - a.hours >= 24), k as (select *, row_number() over (partition by entity order by gap, pre) as n from p) select entity, round(pre, 6) + 0.0 as pre, round(post, 6) as post, round(gap, 6) as gap from k where n = 1", "series")
def change_pairs(spark, d):
    s = series(spark, d)
    p = S.change_pairs(s.where("sensor = 'view'").select("entity", "hours"), s.where("sensor = 'purchase'").select("entity", "hours"), ["entity"], 24.0)
    return p.select("entity", r("pre", F.col("pre")), r("post", F.col("post")), r("gap", F.col("gap")))


@query("with x as (select dataset_id, (dataset_id * 13 % 200)::double as delay, case dataset_id % 4 when 0 then 'flood' when 1 then 'wildfire' when 2 then 'storm' else 'drought' end as event, case when dataset_id % 8 <> 0 then datediff('day', acquired::date, date '1998-09-01') end as age from candidates), y as (select *, case event when 'wildfire' then 6 when 'storm' then 12 else 24 end as best, case event when 'wildfire' then 48 when 'storm' then 96 else 72 end as last from x) select dataset_id, case when delay <= best then 'optimal' when delay <= 2 * best then 'good' when delay <= last then 'acceptable' when delay <= 2 * last then 'poor' else 'unusable' end as timing, round(case when age is null then 0.7::double when age > 30 then 1 - 0.5::double * least((age - 30) / 60, 1) else 1 end, 6) as freshness from y", "candidates")
def acquisition_timing(spark, d):
    c = candidates(spark, d)
    k = F.col("dataset_id")
    event = F.when(k % 4 == 0, "flood").when(k % 4 == 1, "wildfire").when(k % 4 == 2, "storm").otherwise("drought")
    age = F.when(k % 8 != 0, F.datediff(F.lit("1998-09-01").cast("date"), F.col("acquired").cast("date")))
    return c.select("dataset_id", S.timing((k * 13 % 200).cast("double"), event).alias("timing"), r("freshness", S.staleness(age)))


@query("with g as (select data_type, min(resolution_m) as finest, max(resolution_m) as coarsest, median(resolution_m) as middle from candidates group by 1) select data_type, finest, coarsest, middle, round(coarsest / finest, 6) as scale, greatest(1, ceil(round(2 / (middle / 111000), 9)))::int as n_rows, greatest(1, ceil(round(3 / (middle / 111000), 9)))::int as n_cols from g", "candidates")
def common_resolutions(spark, d):
    g = candidates(spark, d).groupBy("data_type").agg(*[S.common_resolution(F.col("resolution_m"), s).alias(n) for s, n in (("finest", "finest"), ("coarsest", "coarsest"), ("median", "middle"))])
    shape = S.grid_shape(F.lit(0.0), F.lit(0.0), F.lit(3.0), F.lit(2.0), F.col("middle") / 111000)
    return g.withColumn("s", shape).select("data_type", "finest", "coarsest", "middle", r("scale", F.col("coarsest") / F.col("finest")), F.col("s.rows").alias("n_rows"), F.col("s.cols").alias("n_cols"))


@query(f"with {_SITUATIONS}, p as (select provider, min(case cost_tier when 'open' then 0 when 'open_restricted' then 1 else 2 end) as tier, list(distinct data_type) as types from candidates group by 1) select key, provider, row_number() over (partition by key order by tier, provider)::int as place from situations cross join p where list_has_any(types, available) and event_class not like 'drought%'", "candidates")
def applicable_providers(spark, d):
    from pyspark.sql import Window

    c = candidates(spark, d)
    tier = F.when(F.col("cost_tier") == "open", 0).when(F.col("cost_tier") == "open_restricted", 1).otherwise(2)
    providers = c.groupBy("provider").agg(F.min(tier).alias("tier"), F.collect_set("data_type").alias("types"))
    # by type, so that providers and situations meet by equality
    offers = providers.select("provider", "tier", F.explode("types").alias("data_type"))
    asks = situations(spark, d).where(~F.startswith("event_class", F.lit("drought"))).select("key", F.explode("available").alias("data_type"))
    met = asks.join(offers, "data_type").select("key", "provider", "tier").distinct()
    return met.select("key", "provider", F.row_number().over(Window.partitionBy("key").orderBy("tier", "provider")).alias("place"))


@query("select c_custkey as key, coalesce(case when trim(explicit) <> '' then explicit end, case when trim(worked) <> '' then worked end) as event_class from (select c_custkey, case when c_custkey % 3 = 0 then 'flood.coastal' when c_custkey % 3 = 1 then ' ' end as explicit, case when c_custkey % 4 <> 0 then lower(c_mktsegment) end as worked from customer)")
def resolved_class(spark, d):
    k = F.col("c_custkey")
    explicit, worked = F.when(k % 3 == 0, "flood.coastal").when(k % 3 == 1, " "), F.when(k % 4 != 0, F.lower("c_mktsegment"))
    return table(spark, d, "customer").select(k.alias("key"), S.first_known(explicit, worked).alias("event_class"))
