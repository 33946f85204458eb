"""Queries of catalogues: constraints, ranking, the spatiotemporal index, registries and text."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tellurion.functions import geodesy as G
from tellurion.functions.base import rounded
from tellurion.operators import catalog
from tellurion.sources import static

from .fixtures import boxes, candidates, table
from .registry import query


def r(name, expr, digits=6):
    return rounded(expr, digits).alias(name)


REF = "1998-06-01"
_PASS = "coverage >= 50 and resolution_m <= 60 and (data_type <> 'optical' or cloud is null or cloud <= 40)"


@query(f"select dataset_id, data_type from candidates where {_PASS} and acquired >= timestamp '1997-01-01' and acquired <= timestamp '1999-12-31'", "candidates")
def hard_constraints(spark, d):
    return candidates(spark, d).where(catalog.passes(start="1997-01-01", end="1999-12-31")).select("dataset_id", "data_type")


_SCORED = f"""scored as (select *, coverage / 100 as s1, exp(-abs(epoch_us(acquired) - epoch_us(timestamp '{REF}')) / 8.64e10 / 7) as s2, least(1, exp(-resolution_m / 100)) as s3, case when cloud is null then 1 else 1 - cloud / 100 end as s4,
case when flag is null then 0.8::double else case flag when 'excellent' then 1.0::double when 'good' then 0.8::double when 'fair' then 0.6::double when 'poor' then 0.3::double else 0.1::double end end as s5, case cost_tier when 'open' then 1.0::double when 'open_restricted' then 0.7::double else 0.3::double end as s6 from candidates where {_PASS}),
totals as (select *, round(0.25::double * s1 + 0.15::double * s2 + 0.20::double * s3 + 0.15::double * s4 + 0.10::double * s5 + 0.10::double * s6 + 0.05::double * 0.5::double, 9) as score from scored),
ranked as (select *, row_number() over (partition by data_type order by score desc, dataset_id)::int as rank from totals)"""


def _ranked(spark, d):
    return catalog.ranked(candidates(spark, d).where(catalog.passes()), REF, ["data_type"])


@query(f"with {_SCORED} select dataset_id, data_type, score, rank from ranked", "candidates")
def rank_candidates(spark, d):
    return _ranked(spark, d).select("dataset_id", "data_type", "score", "rank")


@query(f"with {_SCORED} select data_type, dataset_id, provider, score, rank from ranked where rank <= 4", "candidates")
def select_best_per_type(spark, d):
    return catalog.best(_ranked(spark, d), ["data_type"], 4).select("data_type", "dataset_id", "provider", "score", "rank")


@query(f"with {_SCORED}, w as (select * from ranked where rank = 1), x as (select r.data_type, r.dataset_id, r.rank, unnest(['spatial_coverage', 'temporal_proximity', 'resolution', 'cloud_cover', 'data_quality', 'access_cost', 'provider_preference']) as criterion, unnest([round(r.s1 - w.s1, 6) + 0.0, round(r.s2 - w.s2, 6) + 0.0, round(r.s3 - w.s3, 6) + 0.0, round(r.s4 - w.s4, 6) + 0.0, round(r.s5 - w.s5, 6) + 0.0, round(r.s6 - w.s6, 6) + 0.0, 0.0]) as delta from ranked r join w using (data_type) where r.rank between 2 and 4), y as (select *, (row_number() over (partition by dataset_id order by abs(delta) desc, criterion) - 1)::int as place from x) select data_type, dataset_id, rank, place, criterion, delta from y where place < 2", "candidates")
def trade_offs(spark, d):
    return catalog.trade_offs(_ranked(spark, d), ["data_type"])


@query("with a as (select provider, data_type, count(*) as n, count(*) filter (acquired < timestamp '1998-01-01') as old from candidates group by 1, 2), n as (select distinct provider from candidates), t as (select unnest(['optical', 'sar', 'dem', 'weather', 'ancillary', 'thermal']) as data_type) select provider, data_type from n cross join t anti join a using (provider, data_type)", "candidates")
def missing_types(spark, d):
    c = candidates(spark, d)
    needed = c.groupBy("provider").agg(F.lit(1).alias("one")).select("provider", F.explode(F.array(*[F.lit(t) for t in ("optical", "sar", "dem", "weather", "ancillary", "thermal")])).alias("data_type"))
    return needed.join(c.select("provider", "data_type").distinct(), ["provider", "data_type"], "left_anti")


_ALG = "alg as (select * from (values " + ", ".join(f"('{a}', '{e}', '{c}', {q!r}, {m if m is not None else 'null'}, {str(g).lower()}, {x}::double, {str(t).lower()})" for a, e, c, q, m, g, x, t in static.ALGORITHMS) + ") v(algorithm, event_class, category, requires, memory_mb, needs_gpu, accuracy, deterministic))"


@query(f"with {_ALG} select algorithm, category, accuracy, row_number() over (order by category, accuracy desc, algorithm)::int as place from alg where list_has_all(['sar', 'optical'], requires) and (memory_mb is null or memory_mb <= 4096) and not needs_gpu and (event_class = 'flood' or event_class like 'flood.%')")
def runnable_algorithms(spark, d):
    a = catalog.runnable(static.algorithms(spark), ["sar", "optical"], 4096, gpu=False).where(catalog.class_matches(F.col("event_class"), "flood.*"))
    return a.select("algorithm", "category", "accuracy", F.row_number().over(Window.partitionBy().orderBy("category", F.desc("accuracy"), "algorithm")).alias("place"))  # a registry's rows


@query(f"with {_ALG}, x as (select algorithm, case when needs_gpu then 'no_gpu' when memory_mb > 3500 then 'memory' when not deterministic then 'not_deterministic' end as rejected, case when memory_mb is null then 0.7::double when memory_mb / 4096 > 1 then 0.0::double when memory_mb / 4096 <= 0.5 then 0.9::double else 0.6::double end as efficiency, least(accuracy + 0.1::double, 1) as validation, case category when 'baseline' then 0.8::double else 0.6::double end as category_score from alg) select algorithm, rejected, round(0.4::double * validation + 0.3::double * category_score + 0.3::double * efficiency, 6) as score from x")
def score_algorithms(spark, d):
    a = static.algorithms(spark)
    rejected = F.when(F.col("needs_gpu"), "no_gpu").when(F.col("memory_mb") > 3500, "memory").when(~F.col("deterministic"), "not_deterministic")
    share = F.col("memory_mb") / 4096
    efficiency = F.when(share.isNull(), 0.7).when(share > 1, 0.0).when(share <= 0.5, 0.9).otherwise(0.6)
    category = F.when(F.col("category") == "baseline", 0.8).otherwise(0.6)
    return a.select("algorithm", rejected.alias("rejected"), r("score", 0.4 * F.least(F.col("accuracy") + 0.1, F.lit(1.0)) + 0.3 * category + 0.3 * efficiency))


_Q = "q as (select key as query, west - 5 as west, south - 5 as south, east + 5 as east, north + 5 as north, timestamp '1996-01-01' as t0, timestamp '1999-01-01' as t1 from boxes where key < 20)"


@query(f"with {_Q}, j as (select query, key, round(sqrt(greatest(0, least(b.east, q.east) - greatest(b.west, q.west)) * greatest(0, least(b.north, q.north) - greatest(b.south, q.south)) / ((q.east - q.west) * (q.north - q.south)) * ((epoch_us(least(b.t1, q.t1)) - epoch_us(greatest(b.t0, q.t0))) / (epoch_us(q.t1) - epoch_us(q.t0)))), 9) as score from boxes b, q where b.west <= q.east and b.east >= q.west and b.south <= q.north and b.north >= q.south and b.t0 <= q.t1 and b.t1 >= q.t0), k as (select *, row_number() over (partition by query order by score desc, key)::int as rank from j) select query, key, score, rank from k where rank <= 10", "boxes")
def box_time_query(spark, d):
    b = boxes(spark, d)
    ntz = lambda s: F.lit(s).cast("timestamp_ntz")
    asked = b.where("key < 20").select(F.col("key").alias("query"), (F.col("west") - 5).alias("west"), (F.col("south") - 5).alias("south"), (F.col("east") + 5).alias("east"), (F.col("north") + 5).alias("north"), ntz("1996-01-01").alias("t0"), ntz("1999-01-01").alias("t1"))
    return catalog.box_query(b, asked, 10)


@query("select key from boxes where west <= 10.5 and east >= 10.5 and south <= -10.5 and north >= -12.5", "boxes")
def point_query(spark, d):
    b = boxes(spark, d)
    return b.where((F.col("west") <= 10.5) & (F.col("east") >= 10.5) & (F.col("south") <= -10.5) & (F.col("north") >= -12.5)).select("key")


@query("select data_type, count(*) as n, count(distinct floor((west + 180) / 30) * 100 + floor((south + 90) / 30)) as cells, round(avg(resolution_m), 6) as mean_resolution, min(t0) as first, max(t1) as last from boxes where east >= -60 and west <= 60 group by 1", "boxes")
def index_coverage(spark, d):
    b = boxes(spark, d).where("east >= -60 and west <= 60")
    return b.groupBy("data_type").agg(F.count("*").alias("n"), F.countDistinct(F.floor((F.col("west") + 180) / 30) * 100 + F.floor((F.col("south") + 90) / 30)).alias("cells"), r("mean_resolution", F.avg("resolution_m")), F.min("t0").alias("first"), F.max("t1").alias("last"))


@query("select key, (west <= 170 and east >= 170) or (west <= -170 and east >= -170) or west >= 170 or east <= -170 as crosses, west >= -20 and south >= -20 and east <= 20 and north <= 20 as within, round(greatest(0, least(east, 20) - greatest(west, -20)) * greatest(0, least(north, 20) - greatest(south, -20)) / 1600 * 100, 6) as coverage, round(6371.0088 * 6371.0088 * abs(sin(radians(north)) - sin(radians(south))) * abs(radians(east) - radians(west)), 2) as area_km2 from boxes", "boxes")
def box_relations(spark, d):
    b = boxes(spark, d)
    box = tuple(F.col(c) for c in ("west", "south", "east", "north"))
    band = tuple(F.lit(float(x)) for x in (170, -90, -170, 90))
    area = tuple(F.lit(float(x)) for x in (-20, -20, 20, 20))
    return b.select("key", G.boxes_intersect(box, band).alias("crosses"), G.box_contains(area, box).alias("within"), r("coverage", G.overlap_area(box, area) / 1600 * 100), G.box_area_km2(*box).alias("area_km2"))


@query("with p as (select key, west + 1 as lon, south + 1 as lat from boxes), t as (select *, least(1023, greatest(0, floor((lon + 180) / 360 * 1024)::int))::int as x, least(1023, greatest(0, floor((1 - asinh(tan(radians(greatest(-85.0511, least(85.0511, lat))))) / pi()) / 2 * 1024)::int))::int as y from p) select key, x, y, round(degrees(atan(sinh(pi() * (1 - 2 * y / 1024)))), 6) + 0.0 as north, round(x / 1024 * 360 - 180, 6) + 0.0 as west, round(40075016.68557849 * cos(radians(lat)) / (256 * power(2.0, 10)), 4) as metres, greatest(0, least(24, ceil(log2(40075016.68557849 * cos(radians(lat)) / (256 * 10)))::int))::int as zoom from t", "boxes")
def slippy_tiles(spark, d):
    p = boxes(spark, d).select("key", (F.col("west") + 1).alias("lon"), (F.col("south") + 1).alias("lat"))
    t = p.withColumn("x", G.tile_x(F.col("lon"), 10)).withColumn("y", G.tile_y(F.col("lat"), 10))
    return t.select("key", "x", "y", r("north", G.tile_north(F.col("y"), 10)), r("west", G.tile_west(F.col("x"), 10)), r("metres", G.metres_per_pixel(F.col("lat"), 10), 4), G.zoom_for_resolution(F.lit(10.0), F.col("lat")).alias("zoom"))


@query("with p as (select key, west + 1 as lon, south + 1 as lat from boxes) select key, ((case when lat < 0 then 32700 else 32600 end) + case when lat >= 56 and lat < 64 and lon >= 3 and lon < 12 then 32 when lat >= 72 and lat < 84 and lon >= 0 and lon < 9 then 31 when lat >= 72 and lat < 84 and lon >= 9 and lon < 21 then 33 when lat >= 72 and lat < 84 and lon >= 21 and lon < 33 then 35 when lat >= 72 and lat < 84 and lon >= 33 and lon < 42 then 37 else least(60, floor((lon + 180) / 6)::int + 1) end)::int as epsg, round(0.001 * 111320 * cos(radians(lat)), 6) as metres, round(6371.0088 * sqrt(power(radians(0 - lon) * cos(radians((lat + 0) / 2)), 2) + power(radians(0 - lat), 2)), 4) as km from p", "boxes")
def utm_zones(spark, d):
    p = boxes(spark, d).select("key", (F.col("west") + 1).alias("lon"), (F.col("south") + 1).alias("lat"))
    return p.select("key", G.utm_epsg(F.col("lon"), F.col("lat")).alias("epsg"), r("metres", G.to_metres(F.lit(0.001), "degree", F.col("lat"))), r("km", G.distance_km(F.col("lon"), F.col("lat"), F.lit(0.0), F.lit(0.0)), 4))


TAXONOMY = {"article.definite": ["the", "les", "der", "die", "las", "los"], "article.indefinite": ["une", "ein", "eine", "una"], "preposition": ["with", "for", "von", "pour", "por", "para", "sur"], "abuse": ["stupid", "idiot", "trash", "scum"]}
_TAX = "tax as (select * from (values " + ", ".join(f"('{c}', {ks!r})" for c, ks in TAXONOMY.items()) + ") v(class, ks))"
_KW = f"{_TAX}, w as (select doc_id, list_distinct(list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}]+'), lambda x: length(x) > 2)) as ws from documents), m as (select doc_id, class, len(ks) as k, len(list_intersect(ws, ks)) as matches from w cross join tax), b as (select *, max(matches) over (partition by doc_id) as best from m)"


@query(f"with {_KW} select doc_id, class, matches::int as matches, round(least(0.99::double, matches / greatest(best, k)) * case when matches < k / 2 then 0.7::double else 1 end, 6) as confidence from b where matches > 0")
def keyword_scores(spark, d):
    s = catalog.keyword_scores(table(spark, d, "documents"), TAXONOMY, "doc_id")
    return s.select("doc_id", "class", "matches", r("confidence", F.col("confidence")))


@query(f"with {_KW} select doc_id, class, matches::int as matches from (select *, row_number() over (partition by doc_id order by matches desc, class) as rn from b where matches > 0) where rn = 1")
def keyword_classify(spark, d):
    s = catalog.keyword_scores(table(spark, d, "documents"), TAXONOMY, "doc_id")
    best = F.min(F.struct((-F.col("matches")).alias("m"), "class", "matches"))
    return s.groupBy("doc_id").agg(best.alias("t")).select("doc_id", "t.class", "t.matches")


@query("select conv_id, turn, len(text) - len(replace(lower(text), 'the ', '')) as hits, role from conversations where contains(lower(text), 'the ')")
def phrase_hits(spark, d):
    c = table(spark, d, "conversations").where(F.contains(F.lower("text"), F.lit("the ")))
    return c.select("conv_id", "turn", (F.length("text") - F.length(F.replace(F.lower("text"), F.lit("the "), F.lit("")))).cast("bigint").alias("hits"), "role")


@query("select dataset_id, sha256(concat_ws('|', provider, dataset_id::varchar, data_type, cost_tier))[1:32] as cache_key from candidates", "candidates")
def cache_keys(spark, d):
    return candidates(spark, d).select("dataset_id", F.substring(F.sha2(F.concat_ws("|", "provider", F.col("dataset_id").cast("string"), "data_type", "cost_tier"), 256), 1, 32).alias("cache_key"))


@query("with p as (select cost_tier, provider, count(*) as n, max(acquired) as last from candidates group by 1, 2) select cost_tier, provider, n, last, row_number() over (partition by cost_tier order by last, provider)::int as eviction from p", "candidates")
def cache_eviction(spark, d):
    p = candidates(spark, d).groupBy("cost_tier", "provider").agg(F.count("*").alias("n"), F.max("acquired").alias("last"))
    return p.withColumn("eviction", F.row_number().over(Window.partitionBy("cost_tier").orderBy("last", "provider")))


@query("select dataset_id, data_type, acquired from candidates where data_type in ('sar', 'optical') and cost_tier = 'open' order by acquired desc, dataset_id limit 20 offset 10", "candidates")
def list_page(spark, d):
    c = candidates(spark, d).where("data_type in ('sar', 'optical') and cost_tier = 'open'")
    return c.orderBy(F.desc("acquired"), "dataset_id").offset(10).limit(20).select("dataset_id", "data_type", "acquired")


@query("with w as (select dataset_id, provider, (1 - coalesce(cloud, 0) / 100 + coverage / 100 + exp(-resolution_m / 100)) / 3 as q from candidates where coverage >= 98) select dataset_id, provider, round(q / sum(q) over (partition by provider), 6) as weight from w", "candidates")
def blending_weights(spark, d):
    c = candidates(spark, d).where("coverage >= 98").withColumn("q", (1 - F.coalesce("cloud", F.lit(0.0)) / 100 + F.col("coverage") / 100 + F.exp(-F.col("resolution_m") / 100)) / 3)
    return c.select("dataset_id", "provider", r("weight", F.col("q") / F.sum("q").over(Window.partitionBy("provider"))))


@query("select error_type as component, user_id % 10 as error, count(*) as occurrences, min(ts) as first, max(ts) as last from (select *, event_type as error_type from events where value > 40) group by all having count(*) >= 3")
def failure_patterns(spark, d):
    e = table(spark, d, "events").where("value > 40")
    return e.groupBy(F.col("event_type").alias("component"), (F.col("user_id") % 10).alias("error")).agg(F.count("*").alias("occurrences"), F.min("ts").alias("first"), F.max("ts").alias("last")).where("occurrences >= 3")


@query("select dataset_id, case when coalesce(cloud, 0) > 80 then 'DEGRADED' when coalesce(cloud, 0) > 50 then 'POOR' when coalesce(cloud, 0) > 20 then 'FAIR' else 'GOOD' end as condition, coalesce(cloud, 0) <= 30 and resolution_m <= 80 as optical_suitable, true as sar_suitable, coalesce(cloud, 0) <= 60 as thermal_suitable, round(0.9::double * case when coalesce(cloud, 0) > 80 then 0.3::double when coalesce(cloud, 0) > 60 then 0.5::double when coalesce(cloud, 0) > 30 then 0.8::double else 1 end, 6) as confidence from candidates", "candidates")
def atmospheric_suitability(spark, d):
    cloud = F.coalesce("cloud", F.lit(0.0))
    condition = F.when(cloud > 80, "DEGRADED").when(cloud > 50, "POOR").when(cloud > 20, "FAIR").otherwise("GOOD")
    factor = F.when(cloud > 80, 0.3).when(cloud > 60, 0.5).when(cloud > 30, 0.8).otherwise(1.0)
    return candidates(spark, d).select("dataset_id", condition.alias("condition"), ((cloud <= 30) & (F.col("resolution_m") <= 80)).alias("optical_suitable"), F.lit(True).alias("sar_suitable"), (cloud <= 60).alias("thermal_suitable"), r("confidence", 0.9 * factor))


@query("with a as (select provider, data_type, acquired, lag(acquired) over (partition by provider, data_type order by acquired, dataset_id) as p from candidates) select provider, data_type, count(*) as n, round(avg(epoch_us(acquired) - epoch_us(p)) / 8.64e10, 6) as mean_revisit, round(max(epoch_us(acquired) - epoch_us(p)) / 8.64e10, 6) as max_gap from a group by 1, 2", "candidates")
def revisit_times(spark, d):
    w = Window.partitionBy("provider", "data_type").orderBy("acquired", "dataset_id")
    us = lambda c: F.unix_micros(c.cast("timestamp"))
    a = candidates(spark, d).withColumn("gap", us(F.col("acquired")) - us(F.lag("acquired").over(w)))
    return a.groupBy("provider", "data_type").agg(F.count("*").alias("n"), r("mean_revisit", F.avg("gap") / 8.64e10), r("max_gap", F.max("gap") / 8.64e10))
