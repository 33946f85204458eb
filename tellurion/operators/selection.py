"""Choosing data: soft constraints, sensors for what is to be observed, fusion strategies and plans, pairs for change detection."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tellurion.functions.base import clip, lookup

# fixed values: scores by tier, by quality label and by processing level
TIERS = {"open": 1.0, "open_restricted": 0.8, "restricted": 0.5, "commercial": 0.3}
LABELS = {"excellent": 1.0, "good": 0.8, "fair": 0.6, "poor": 0.3, "bad": 0.1}
LEVELS = {"L2A": 1.0, "L2": 0.95, "L1C": 0.85, "L1": 0.75, "L0": 0.5}
# fixed values: sensors able to see each observable, best first, with confidence, needs, what degrades them and alternatives
CAPABILITIES = [
    ("water_extent", 1, "sar", "high", [], [], ["optical"]),
    ("water_extent", 2, "optical", "medium", [], ["cloud_cover", "darkness"], ["sar"]),
    ("flood_depth", 1, "dem", "high", ["water_extent"], [], []),
    ("burn_severity", 1, "optical", "high", [], ["cloud_cover"], ["sar"]),
    ("burn_severity", 2, "sar", "medium", [], [], ["optical"]),
    ("active_fire", 1, "thermal", "high", [], ["cloud_cover"], ["optical"]),
    ("active_fire", 2, "optical", "medium", [], ["cloud_cover", "darkness"], ["thermal"]),
    ("vegetation_damage", 1, "optical", "high", [], ["cloud_cover"], ["sar"]),
    ("vegetation_damage", 2, "sar", "medium", [], [], ["optical"]),
    ("structural_damage", 1, "sar", "high", ["land_cover"], [], ["optical"]),
    ("structural_damage", 2, "optical", "medium", ["land_cover"], ["cloud_cover"], ["sar"]),
    ("terrain_height", 1, "dem", "high", [], [], []),
    ("land_cover", 1, "ancillary", "high", [], [], ["optical"]),
]
CAPABILITY = "observable string, preference int, sensor string, confidence string, requires array<string>, degrades array<string>, alternatives array<string>"
# fixed values: how observations of one thing by two sensors should agree
RULES = [
    ("optical", "sar", "water_extent", 0.5, 0.95, -0.15, 0.15),
    ("optical", "optical", "water_extent", 0.85, 1.0, -0.05, 0.05),
    ("sar", "sar", "water_extent", 0.8, 1.0, -0.1, 0.1),
    ("optical", "thermal", "burn_severity", 0.6, 0.9, -0.2, 0.2),
    ("optical", "sar", "burn_severity", 0.4, 0.8, -0.25, 0.25),
    ("optical", "sar", "vegetation_damage", 0.5, 0.85, -0.2, 0.2),
    ("optical", "lidar", "vegetation_damage", 0.6, 0.95, -0.15, 0.15),
    ("dem", "optical", "flood_susceptibility", 0.3, 0.7, -0.3, 0.3),
]
COMPLEMENTARY = [("optical", "sar"), ("optical", "thermal"), ("dem", "sar"), ("dem", "optical")]


def availability(available: Column, tier: Column) -> Column:
    return F.when(~available, 0.0).otherwise(lookup(F.coalesce(tier, F.lit("open")), TIERS, 0.5))


def sar_noise(looks: Column, noise_db: Column, label: Column) -> Column:
    """By looks, else by noise floor, else by label; 0.7 where nothing is known."""
    return F.when(looks.isNotNull(), F.least(F.lit(1.0), looks / 4)).when(noise_db.isNotNull(), clip(1 - (noise_db + 25) / 10, 0, 1)).when(label.isNotNull(), lookup(F.lower(label), LABELS, 0.5)).otherwise(0.7)


def geometric_accuracy(metres: Column, ortho: Column, level: Column) -> Column:
    by_level = F.when(F.lit(False), None)
    for name, score in LEVELS.items():
        by_level = by_level.when(F.contains(F.upper(level), F.lit(name)), F.lit(score))
    return F.when(metres.isNotNull(), F.exp(-metres / 10)).when(ortho, 1.0).when(~ortho, 0.6).otherwise(F.coalesce(by_level, F.lit(0.7)))


def proximity(lat: Column, lon: Column, centre: tuple[float, float], tile: Column, target: str | None, coverage: Column) -> Column:
    """By distance to the centre of interest, else by tile, else by coverage (percent)."""
    north = F.abs(lat - centre[0]) * 111.0
    east = F.abs(lon - centre[1]) * 111.0 * F.cos((lat + centre[0]) / 2 * (math.pi / 180))
    near = clip(F.exp(-F.sqrt(north * north + east * east) / 50), 0.2, 1)
    by_tile = F.lit(None).cast("double") if target is None else F.when(tile == target, 1.0).when(tile.isNotNull(), 0.6)
    return F.coalesce(near, by_tile, F.when(coverage >= 95, 0.95).when(coverage >= 80, 0.85).otherwise(0.7))


def view_angle(kind: Column, off_nadir: Column, sun: Column, incidence: Column, look: Column) -> Column:
    far = F.least(F.abs(incidence - 30), F.abs(incidence - 45))
    radar = F.when(incidence.between(30, 45), 1.0).when(incidence.between(20, 55), 0.8).when(incidence.isNotNull(), F.greatest(F.lit(0.3), 1 - far / 30)).when(look.isNotNull(), 0.85)
    optical = F.coalesce(clip(F.exp(-off_nadir / 20), 0.1, 1), clip(sun / 90, 0.1, 1))
    return F.coalesce(F.when(kind == "optical", optical).when(kind == "sar", radar), F.lit(0.75))


def soft_score(parts: dict[str, tuple[Column, Column, float]]) -> Column:
    """The weighted mean of (score, whether it applies, weight); 0 where none applies."""
    total = sum((F.when(applies, score * weight).otherwise(0.0) for score, applies, weight in parts.values()), F.lit(0.0))
    weights = sum((F.when(applies, F.lit(float(weight))).otherwise(0.0) for _, applies, weight in parts.values()), F.lit(0.0))
    return F.when(weights > 0, total / weights).otherwise(0.0)


# ---------------------------------------------------------------- sensors


def capabilities(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CAPABILITIES, CAPABILITY)


def rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RULES, "sensor_a string, sensor_b string, observable string, correlation_low double, correlation_high double, bias_low double, bias_high double")


def confidence_now(sensor: Column, confidence: Column, degrades: Column, cloud: Column, rain: Column, dark: Column) -> Column:
    """The confidence (high, medium, low, unreliable) that clouds (percent), rain and darkness leave a sensor."""
    level = lookup(confidence, {"high": 3, "medium": 2, "low": 1}, 0)
    by_cloud = F.array_contains(degrades, "cloud_cover") & cloud.isNotNull()
    level = F.when(by_cloud & (cloud > 60), F.when(level == 3, 1).when(level == 2, 0).otherwise(level)).when(by_cloud & (cloud > 30), F.greatest(level - 1, F.lit(0))).otherwise(level)
    level = F.when(F.array_contains(degrades, "precipitation") & rain, F.greatest(level - 1, F.lit(0))).otherwise(level)
    useless = (by_cloud & (cloud > 80)) | (F.array_contains(degrades, "darkness") & dark & (sensor == "optical"))
    return F.when(F.coalesce(useless, F.lit(False)), F.lit("unreliable")).otherwise(F.element_at(F.array(*map(F.lit, ("unreliable", "low", "medium", "high"))), level + 1))


def choose_sensors(asked: DataFrame, keys: list[str]) -> DataFrame:
    """For each row of asked (keys, observable, available array, cloud, rain, dark, allow_degraded): the first usable sensor in order of preference.

    sensor, now (its confidence), degraded, supporting (its alternatives that are there and not unreliable) and rejected (those before it, with why); no
    row where none is usable. The capabilities are a table of a dozen rows.
    """
    table = capabilities(asked.sparkSession)
    met = asked.join(F.broadcast(table), "observable")
    met = met.withColumn("now", confidence_now(F.col("sensor"), F.col("confidence"), F.col("degrades"), F.col("cloud"), F.col("rain"), F.col("dark")))
    why = F.when(~F.array_contains("available", F.col("sensor")), "not_available").when(F.col("now") == "unreliable", "unreliable_conditions").when((F.col("now") == "low") & ~F.col("allow_degraded"), "degraded_not_allowed")
    of = met.withColumn("why", why).groupBy(*keys, "observable").agg(F.sort_array(F.collect_list(F.struct("preference", "sensor", "now", "why", "alternatives", "available"))).alias("all"))  # a few sensors an observable
    first = F.element_at(F.filter("all", lambda x: x["why"].isNull()), 1)
    of = of.withColumn("pick", F.when(F.exists("all", lambda x: x["why"].isNull()), first)).where("pick is not null")
    reliable = F.transform(F.filter("all", lambda x: x["now"] != "unreliable"), lambda x: x["sensor"])
    support = F.filter(F.col("pick.alternatives"), lambda s: F.array_contains(F.col("pick.available"), s) & F.array_contains(reliable, s) & (s != F.col("pick.sensor")))
    before = F.filter("all", lambda x: x["preference"] < F.col("pick.preference"))
    return of.select(*keys, "observable", F.col("pick.sensor").alias("sensor"), F.col("pick.now").alias("now"), (F.col("pick.now") == "low").alias("degraded"), F.array_sort(support).alias("supporting"), F.transform(before, lambda x: F.concat(x["sensor"], F.lit(":"), x["why"])).alias("rejected"))


def satisfied(chosen: DataFrame, keys: list[str], passes: int = 2) -> DataFrame:
    """Of the choices, those whose required observables are chosen too, followed for so many passes: the requirements are one deep."""
    needs = {}
    for observable, _, _, _, requires, _, _ in CAPABILITIES:
        needs[observable] = requires
    have = chosen.groupBy(*keys).agg(F.collect_set("observable").alias("have"))
    table = F.create_map(*[x for k, v in needs.items() for x in (F.lit(k), F.array(*map(F.lit, v)).cast("array<string>"))])
    done = F.array().cast("array<string>")
    within = lambda known: F.filter("have", lambda o: F.size(F.array_except(table[o], known)) == 0)
    for _ in range(min(passes, len(needs))):
        done = within(done)
    out = have.select(*keys, F.explode(done).alias("observable"))
    return chosen.join(out, [*keys, "observable"])


def observables(event_class: Column) -> Column:
    """What an event of a class is observed by; empty for classes that aren't known."""
    has = lambda *names: F.greatest(*[F.contains(event_class, F.lit(n)) for n in names], F.lit(False))
    some = lambda *names: F.array(*map(F.lit, names))
    flood = F.when(has("riverine", "coastal"), some("water_extent", "terrain_height", "flood_depth")).otherwise(some("water_extent", "terrain_height"))
    fire = F.when(has("active", "ongoing"), some("burn_severity", "active_fire")).otherwise(some("burn_severity"))
    storm = F.when(has("urban", "tornado", "hurricane"), some("vegetation_damage", "land_cover", "structural_damage")).otherwise(some("vegetation_damage", "land_cover"))
    return F.when(F.startswith(event_class, F.lit("flood")), flood).when(F.startswith(event_class, F.lit("wildfire")), fire).when(F.startswith(event_class, F.lit("storm")), storm).otherwise(F.array().cast("array<string>"))


def complementary(a: Column, b: Column) -> Column:
    return F.coalesce(F.concat_ws("|", F.least(a, b), F.greatest(a, b)).isin(*["|".join(sorted(p)) for p in COMPLEMENTARY]), F.lit(False))


def strategy(event_class: Column, available: Column, cloud: Column) -> Column:
    """The fusion configuration for an event class, the sensors there and the cloud cover in percent."""
    radar, optical = F.array_contains(available, "sar"), F.array_contains(available, "optical")
    flood = F.when(F.coalesce(cloud, F.lit(0)) > 80, "flood_sar_only").when(radar & optical, "flood_complementary").when(radar, "flood_sar_only").otherwise("temporal_densification")
    return F.when(F.startswith(event_class, F.lit("flood")), flood).when(F.startswith(event_class, F.lit("wildfire")), "wildfire_complementary").when(F.startswith(event_class, F.lit("storm")), "storm_redundant").otherwise("temporal_densification")


def quality_factor(cloud: Column, coverage: Column, resolution: Column, label: Column) -> Column:
    """The mean of what is known of a dataset: clear share, coverage (both from percent), exp(-metres / 100) and label."""
    parts = F.array_compact(F.array(1 - cloud / 100, coverage / 100, F.exp(-resolution / 100), F.when(label.isNotNull(), lookup(label, LABELS, 0.5))))
    return F.aggregate(parts, F.lit(0.0), lambda a, x: a + x) / F.size(parts)


def fusion_plan(candidates: DataFrame, keys: list[str], weights: dict[str, float], condition: Column, per_sensor: int, order: list[Column]) -> DataFrame:
    """One row a group of keys: sensors found, datasets chosen (the first per_sensor by order of those that meet condition) and confidence.

    Sensors' weights are made to sum to 1 over those found; confidence is 0.4 of the share of sensors found and 0.6 of the mean of quality times weight.
    """
    from pyspark.sql import Window

    wanted = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])
    fit = candidates.where(F.col("data_type").isin(*weights) & condition).withColumn("quality_", quality_factor(F.col("cloud"), F.col("coverage"), F.col("resolution_m"), F.col("flag")))
    fit = fit.withColumn("n_", F.row_number().over(Window.partitionBy(*keys, "data_type").orderBy(*order))).where(F.col("n_") <= per_sensor)
    of = fit.groupBy(*keys, "data_type").agg(F.count("*").alias("n_"), F.sum("quality_").alias("q_"))
    whole = of.groupBy(*keys).agg(F.count("*").cast("int").alias("sensors"), F.sum("n_").alias("datasets"), F.sum(wanted[F.col("data_type")]).alias("w_"), F.sum(F.col("q_") * wanted[F.col("data_type")]).alias("q_"))
    quality = F.col("q_") / F.when(F.col("w_") > 0, F.col("w_")).otherwise(1.0) / F.col("datasets")
    return whole.select(*keys, "sensors", "datasets", clip(0.4 * F.col("sensors") / len(weights) + 0.6 * quality, 0, 1).alias("confidence"))


# ---------------------------------------------------------------- time


def change_pairs(before: DataFrame, after: DataFrame, keys: list[str], least_hours: float, at: str = "hours") -> DataFrame:
    """The closest pair of an instant before and one after, at least so many hours apart: pre, post and gap, for each key that has one.

    For every later instant the last earlier one that is far enough is looked up as of that instant less the gap, so no pairs are made.
    """
    from .timeline import as_of

    asked = after.select(*keys, (F.col(at) - least_hours).alias(at), F.col(at).alias("post"))
    found = as_of(asked, before.select(*keys, at, F.lit(0.0).alias("value")), keys, at).where("before_at is not null")
    pair = F.struct((F.col("post") - F.col("before_at")).alias("gap"), F.col("before_at").alias("pre"), "post")
    return found.groupBy(*keys).agg(F.min(pair).alias("p")).select(*keys, "p.pre", "p.post", "p.gap")


# fixed values: hours after an event by which an acquisition is best, and of use
TIMING = {"flood": (24, 72), "wildfire": (6, 48), "storm": (12, 96)}


def timing(delay: Column, event: Column) -> Column:
    best, last = (lookup(event, {k: v[i] for k, v in TIMING.items()}, (24, 72)[i]) for i in range(2))
    return F.when(delay.isNull(), None).when(delay <= best, "optimal").when(delay <= best * 2, "good").when(delay <= last, "acceptable").when(delay <= last * 2, "poor").otherwise("unusable")


def staleness(days: Column, threshold: float = 30) -> Column:
    """1 up to threshold days of age, falling to 0.5; 0.7 where the age isn't known."""
    return F.when(days.isNull(), 0.7).when(days > threshold, 1 - 0.5 * F.least((days - threshold) / (2 * threshold), F.lit(1.0))).otherwise(1.0)


# ---------------------------------------------------------------- resolutions


def common_resolution(metres: Column, strategy: str) -> Column:
    """An aggregate: the finest, coarsest or median resolution."""
    return {"finest": F.min, "coarsest": F.max, "median": F.median}[strategy](metres)


def grid_shape(west: Column, south: Column, east: Column, north: Column, resolution: Column) -> Column:
    """(rows, columns) of a grid of cells of so many units over a box, one at least."""
    cells = lambda d: F.greatest(F.lit(1), F.ceil(F.round(d / resolution, 9))).cast("int")
    return F.struct(cells(north - south).alias("rows"), cells(east - west).alias("cols"))


def first_known(*choices: Column) -> Column:
    """An explicit class before one that was worked out."""
    return F.coalesce(*[F.when(F.trim(c) != "", c) for c in choices])


