"""Queries of fusion: conflicts, consensus, ensembles and comparisons of sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from tellurion.functions.base import rounded
from tellurion.operators import fuse

from .fixtures import px_layers, px_votes
from .registry import query

CELL = ["row", "col"]


def r(name, expr, digits=6):
    return rounded(expr, digits).alias(name)


CONFLICT = """a as (select row, col, count(value) as n, avg(value) as mean, stddev_pop(value) as std, max(value) - min(value) as rng, list(value) as vs from px_layers group by 1, 2),
c as (select *, len(list_filter(vs, lambda v: abs(v - mean) <= 2.0 or abs(v - mean) <= 0.05 * abs(mean))) / n as agreement from a)"""
SEVERITY = "case when n < 2 or agreement >= 0.9 then 'none' when agreement >= 0.7 then 'low' when std / abs(mean) < 0.25 then 'medium' when std / abs(mean) < 0.5 then 'high' else 'critical' end"


@query(f"with {CONFLICT} select row, col, n, round(mean, 7) as mean, round(std, 7) as std, round(rng, 7) as range, round(agreement, 6) as agreement, {SEVERITY} as severity from c", "px_layers")
def conflict_detect(spark, d):
    c = fuse.conflicts(px_layers(spark, d), absolute=2.0)
    return c.select(*CELL, "n", r("mean", F.col("mean"), 7), r("std", F.col("std"), 7), r("range", F.col("range"), 7), r("agreement", F.col("agreement")), "severity")


@query(f"with {CONFLICT}, m as (select row, col, avg(value) as v, sum(quality * confidence * value) / sum(quality * confidence) as w, sum(quality * confidence) / count(*) as wc, median(value) as md, count(*) as k from px_layers group by 1, 2) select row, col, round(v, 9) as mean, round(w, 9) as weighted, round(wc, 9) as weighted_confidence, round(md, 9) as median, round(n / 5 * agreement, 6) as median_confidence, round(wc * case {SEVERITY} when 'none' then 1.0::double when 'low' then 0.95::double when 'medium' then 0.8::double when 'high' then 0.6::double else 0.3::double end, 9) as adjusted from m join c using (row, col)", "px_layers")
def conflict_means(spark, d):
    px = px_layers(spark, d)
    mean = fuse.resolve_mean(px).select(*CELL, F.col("value").alias("m"))
    weighted = fuse.resolve_weighted(px).select(*CELL, F.col("value").alias("w"), F.col("confidence").alias("wc"))
    c = fuse.conflicts(px, absolute=2.0)
    median = px.groupBy(*CELL).agg(F.median("value").alias("md"))
    factor = F.create_map(*[F.lit(x) for kv in fuse.SEVERITY_FACTORS.items() for x in kv])[F.col("severity")]
    j = mean.join(weighted, CELL).join(median, CELL).join(c, CELL)
    return j.select(*CELL, r("mean", F.col("m"), 9), r("weighted", F.col("w"), 9), r("weighted_confidence", F.col("wc"), 9), r("median", F.col("md"), 9), r("median_confidence", F.col("n") / 5 * F.col("agreement")), r("adjusted", F.col("wc") * factor, 9))


@query("with k as (select row, col, class, count(*) as votes, min(source_id) as source_id from px_votes group by 1, 2, 3), x as (select *, sum(votes) over (partition by row, col) as n, row_number() over (partition by row, col order by votes desc, class) as rn from k) select row, col, class as value, votes, round(votes / n, 6) as confidence, source_id from x where rn = 1", "px_votes")
def conflict_majority(spark, d):
    return fuse.majority(px_votes(spark, d)).select(*CELL, "value", "votes", r("confidence", F.col("confidence")), "source_id")


@query("with k as (select row, col, class, sum(quality * confidence) as w, arg_max(source_id, quality * confidence) as source_id from px_votes group by 1, 2, 3), x as (select *, sum(w) over (partition by row, col) as n, row_number() over (partition by row, col order by w desc, class) as rn from k) select row, col, class as value, round(w / n, 6) as confidence, source_id from x where rn = 1", "px_votes")
def conflict_weighted_vote(spark, d):
    votes = px_votes(spark, d).withColumn("place", F.monotonically_increasing_id())  # a cell's votes lie in one task, in order
    return fuse.weighted_vote(votes, place="place").select(*CELL, "value", r("confidence", F.col("confidence")), "source_id")


_PICK = "select row, col, round(value, 7) as value, source_id from (select *, row_number() over (partition by row, col order by {}, source_id) as rn from px_layers) where rn = 1"


@query(_PICK.format("quality * confidence desc"), "px_layers")
def conflict_highest_confidence(spark, d):
    return fuse.highest_confidence(px_layers(spark, d)).select(*CELL, r("value", F.col("value"), 7), "source_id")


@query(_PICK.format("case source_id when 3 then 0 when 1 then 1 else 2 end"), "px_layers")
def conflict_priority(spark, d):
    return fuse.by_priority(px_layers(spark, d), [3, 1]).select(*CELL, r("value", F.col("value"), 7), "source_id")


@query(_PICK.format("value"), "px_layers")
def conflict_minimum(spark, d):
    return fuse.lowest(px_layers(spark, d)).select(*CELL, r("value", F.col("value"), 7), "source_id")


@query(_PICK.format("value desc"), "px_layers")
def conflict_maximum(spark, d):
    return fuse.highest(px_layers(spark, d)).select(*CELL, r("value", F.col("value"), 7), "source_id")


@query("with s as (select row, col, avg(value) as m, stddev_pop(value) as s, count(*) as n from px_layers group by 1, 2) select row, col, round(avg(value), 7) as value, round(count(*) / any_value(n), 6) as confidence from px_layers join s using (row, col) where abs(value - m) <= 1.5001 * s group by 1, 2", "px_layers")
def conflict_range_check(spark, d):
    return fuse.range_checked(px_layers(spark, d), 1.5001).select(*CELL, r("value", F.col("value"), 7), r("confidence", F.col("confidence")))


@query("with x as (select row, col, value, row_number() over (partition by row, col order by value) as i, count(*) over (partition by row, col) as n from px_layers) select row, col, round(avg(value), 7) as value from x where not (1 < n // 2) or (i > 1 and i <= n - 1) group by 1, 2", "px_layers")
def consensus_trimmed(spark, d):
    return fuse.trimmed_mean(px_layers(spark, d)).select(*CELL, r("value", F.col("value"), 7))


def _huber_sql():
    out = "with x as (select row, col, list(value) as vs, median(value) as e0 from px_layers group by 1, 2), y as (select *, 1.4826::double * list_median(list_transform(vs, lambda v: abs(v - e0))) as sc from x), z0 as (select *, e0 as e from y)"
    out = out.replace("list_median(", "list_aggregate(").replace("abs(v - e0)))", "abs(v - e0)), 'median')")
    for i in range(1, 6):
        w = "(case when abs(v - e) <= 1.345::double * sc then 1.0::double else 1.345::double * sc / abs(v - e) end)"
        out += f", z{i} as (select row, col, vs, sc, case when sc > 0 then list_sum(list_transform(vs, lambda v: {w} * v)) / list_sum(list_transform(vs, lambda v: {w})) else e end as e from z{i - 1})"
    return out + " select row, col, round(e, 7) as value from z5"


@query(_huber_sql(), "px_layers")
def consensus_robust(spark, d):
    return fuse.robust_mean(px_layers(spark, d)).select(*CELL, r("value", F.col("value"), 7))


for _name, _t in (("majority", 0.5), ("plurality", 0.0), ("supermajority", 0.666), ("unanimous", 0.99)):

    def _vote(spark, d, t=_t):
        return fuse.vote_consensus(px_votes(spark, d), t).select(*CELL, "value", r("agreement", F.col("agreement")))

    _vote.__name__ = f"consensus_{_name}"
    query(f"with k as (select row, col, class, count(*) as votes from px_votes group by 1, 2, 3), x as (select *, sum(votes) over (partition by row, col) as n, row_number() over (partition by row, col order by votes desc, class) as rn from k) select row, col, case when votes / n >= {_t} then class else -1 end as value, round(votes / n, 6) as agreement from x where rn = 1", "px_votes")(_vote)


@query("with s as (select row, col, avg(value) as m, stddev_pop(value) as s, avg(confidence) as c, count(value) as n from px_layers group by 1, 2), t as (select *, case when abs(m) > 1e-10 then 1 - least(s / abs(m), 1) else 0 end as a from s) select row, col, round(m, 7) as mean, round(a, 6) as agreement, round(a * c, 6) as confidence, round(s * (1 - a * c), 6) as uncertainty, case when a >= 0.8 and a * c >= 0.7 then 'HIGH' when a >= 0.6 and a * c >= 0.5 then 'MODERATE' when a >= 0.4 then 'LOW' else 'DEGRADED' end as quality from t", "px_layers")
def consensus_mean(spark, d):
    c = fuse.agreement_of_mean(px_layers(spark, d))
    return c.select(*CELL, r("mean", F.col("mean"), 7), r("agreement", F.col("agreement")), r("confidence", F.col("confidence")), r("uncertainty", F.col("uncertainty")), fuse.consensus_quality(F.col("agreement"), F.col("confidence"), F.lit(1)).alias("quality"))


@query("with m as (select row, col, avg(value) as f from px_layers group by 1, 2), w as (select source_id, (corr(value, f) + 1) / 2 * avg(confidence) as w from px_layers join m using (row, col) group by 1) select source_id, round(w / sum(w) over (), 6) as share from w", "px_layers")
def source_contributions(spark, d):
    px = px_layers(spark, d)
    return fuse.contributions(px, fuse.resolve_mean(px)).select("source_id", r("share", F.col("share")))


WEIGHTS = {0: 0.3, 1: 0.25, 2: 0.2, 3: 0.15, 4: 0.1}
_W = "case source_id when 0 then 0.3::double when 1 then 0.25::double when 2 then 0.2::double when 3 then 0.15::double else 0.1::double end"
_C = "greatest(1e-6, least(1 - 1e-6, confidence))"
_TERMS = {"weighted_average": f"{_W} * case when yes = 1 then confidence else 1 - confidence end", "voting": f"{_W} * yes", "bayesian": f"{_W} * case when yes = 1 then ln({_C} / (1 - {_C})) else ln((1 - {_C}) / {_C}) end"}

for _m, _term in _TERMS.items():
    _p = "1 / (1 + exp(-t / w))" if _m == "bayesian" else "t / w"

    def _ensemble(spark, d, m=_m):
        return fuse.ensemble(px_votes(spark, d), WEIGHTS, m, 0.5001).select(*CELL, r("probability", F.col("probability"), 9), "detected", r("agreement", F.col("agreement"), 9), r("uncertainty", F.col("uncertainty"), 9), r("confidence", F.col("confidence"), 9))

    _ensemble.__name__ = f"ensemble_{_m}"
    query(f"with s as (select row, col, sum({_term}) as t, sum({_W}) as w, avg(yes) as share, var_pop(case when yes = 1 then confidence else 1 - confidence end) as v from px_votes group by 1, 2), q as (select *, {_p} as p from s), u as (select *, case when p >= 0.5001 then share else 1 - share end as a from q) select row, col, round(p, 9) as probability, p >= 0.5001 as detected, round(a, 9) as agreement, round(greatest(0, least(1, v / 0.25)), 9) as uncertainty, round((abs(p - 0.5001) / 0.5001 + a) / 2, 9) as confidence from u", "px_votes")(_ensemble)


_VOTES = {
    "majority": ("y / n > 0.5", "case when y / n > 0.5 then y / n else 1 - y / n end"),
    "weighted": ("wy / w > 0.5", "case when wy / w > 0.5 then wy / w else 1 - wy / w end"),
    "unanimous": ("y = n", "case when y = n then least else 0.3::double end"),
    "consensus": ("y / n >= 0.7", "case when y / n >= 0.7 or y / n <= 1 - 0.7 then 2 * abs(y / n - 0.5) else 0.3::double end"),
    "confidence_max": ("top = 1", "most"),
}
for _m, (_hit, _sure) in _VOTES.items():

    def _binary(spark, d, m=_m):
        return fuse.binary_vote(px_votes(spark, d), m).select(*CELL, "detected", r("confidence", F.col("confidence")))

    _binary.__name__ = f"vote_{_m}"
    query(f"with s as (select row, col, sum(yes) as y, count(*) as n, sum(confidence * yes) as wy, sum(confidence) as w, min(confidence) as least, max(confidence) as most from px_votes group by 1, 2), t as (select row, col, yes as top from (select *, row_number() over (partition by row, col order by confidence desc, source_id) as rn from px_votes) where rn = 1) select row, col, {_hit} as detected, round({_sure}, 6) as confidence from s join t using (row, col)", "px_votes")(_binary)


@query("with p as (select a.source_id as a, b.source_id as b, a.value as x, b.value as y, b.value - a.value as d from px_layers a join px_layers b on a.row = b.row and a.col = b.col and a.source_id < b.source_id) select a, b, count(*) as n, round(corr(x, y), 6) + 0.0 as correlation, round(avg(d), 6) + 0.0 as bias, round(sqrt(avg(d * d)), 6) as rmse, round(avg(abs(d)), 6) as mae, round(max(abs(d)), 6) as largest, round(avg((abs(d) <= 2 or abs(d) <= 0.05 * (abs(x) + abs(y)) / 2)::double), 6) as agreement, round(1 - sum(d * d) / (var_pop(x) * count(*)), 6) + 0.0 as efficiency from p group by 1, 2", "px_layers")
def compare_sources(spark, d):
    c = fuse.compare_pairs(px_layers(spark, d), absolute=2.0)
    return c.select("a", "b", "n", *[r(x, F.col(x)) for x in ("correlation", "bias", "rmse", "mae", "largest", "agreement", "efficiency")])


@query("with p as (select a.source_id as a, b.source_id as b, avg((abs(b.value - a.value) <= 2 or abs(b.value - a.value) <= 0.05 * (abs(a.value) + abs(b.value)) / 2)::double) as g from px_layers a join px_layers b on a.row = b.row and a.col = b.col and a.source_id < b.source_id group by 1, 2), e as (select a as s, g from p union all select b, g from p) select s as source_id, round(avg(g), 6) as score, row_number() over (order by avg(g) desc, s)::int as rank from e group by 1", "px_layers")
def rank_sources(spark, d):
    from pyspark.sql import Window

    p = fuse.compare_pairs(px_layers(spark, d), absolute=2.0)
    ends = p.select(F.explode(F.array("a", "b")).alias("source_id"), "agreement").groupBy("source_id").agg(F.avg("agreement").alias("s"))
    return ends.select("source_id", r("score", F.col("s")), F.row_number().over(Window.partitionBy().orderBy(F.desc("s"), "source_id")).alias("rank"))  # a row a source


@query("with s as (select row, col, max(value) - min(value) as spread from px_layers group by 1, 2), l as (select case when spread <= 5.001 then 'excellent' when spread <= 10.002 then 'good' when spread <= 20.004 then 'moderate' when spread <= 50.01 then 'poor' else 'disagreement' end as level, spread from s) select level, count(*) as cells, round(avg(spread), 6) as mean_spread from l group by 1", "px_layers")
def agreement_levels(spark, d):
    s = px_layers(spark, d).groupBy(*CELL).agg((F.max("value") - F.min("value")).alias("spread"))
    return s.groupBy(fuse.agreement_level(F.col("spread"), 10.002).alias("level")).agg(F.count("*").alias("cells"), r("mean_spread", F.avg("spread")))


@query("with m as (select row, col, avg(value) as ref from px_layers group by 1, 2), e as (select source_id, sqrt(avg(power(value - ref, 2))) as rmse from px_layers join m using (row, col) group by 1), s as (select stddev_pop(ref) as sd from m) select source_id, round(1 - rmse / sd, 6) + 0.0 as skill from e cross join s", "px_layers")
def skill_of_sources(spark, d):
    px = px_layers(spark, d)
    ref = fuse.resolve_mean(px).select(*CELL, F.col("value").alias("ref"))
    e = px.join(ref, CELL).groupBy("source_id").agg(F.sqrt(F.avg(F.pow(F.col("value") - F.col("ref"), 2))).alias("rmse"))
    return e.crossJoin(F.broadcast(ref.agg(F.stddev_pop("ref").alias("sd")))).select("source_id", r("skill", 1 - F.col("rmse") / F.col("sd")))
