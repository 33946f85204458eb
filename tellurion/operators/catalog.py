"""Catalogues: constraints, scores and ranking of datasets, the spatiotemporal index, registries and keyword classification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tellurion.functions import geodesy as G
from tellurion.functions.base import lookup

#: Weights of the ranking's criteria; fixed values.
WEIGHTS = {"spatial_coverage": 0.25, "temporal_proximity": 0.15, "resolution": 0.20, "cloud_cover": 0.15, "data_quality": 0.10, "access_cost": 0.10, "provider_preference": 0.05}
QUALITY_SCORES = {"excellent": 1.0, "good": 0.8, "fair": 0.6, "poor": 0.3, "bad": 0.1}
COST_SCORES = {"open": 1.0, "open_restricted": 0.7, "freemium": 0.5, "commercial": 0.3, "restricted": 0.1}


def passes(coverage: float = 50.0, cloud: float = 40.0, resolution: float = 60.0, start: str | None = None, end: str | None = None) -> Column:
    """All hard constraints: coverage, cloud (of optical data only, and unknown cloud passes), resolution and the closed time window."""
    ok = (F.col("coverage") >= coverage) & (F.col("resolution_m") <= resolution) & ((F.col("data_type") != "optical") | F.col("cloud").isNull() | (F.col("cloud") <= cloud))
    if start:
        ok = ok & (F.col("acquired") >= F.lit(start).cast("timestamp_ntz"))
    if end:
        ok = ok & (F.col("acquired") <= F.lit(end).cast("timestamp_ntz"))
    return ok


def scores(reference: str) -> dict[str, Column]:
    """A score of 0 to 1 for each criterion."""
    days = F.abs(F.unix_micros(F.col("acquired").cast("timestamp")) - F.unix_micros(F.lit(reference).cast("timestamp"))) / 8.64e10
    return {
        "spatial_coverage": F.col("coverage") / 100,
        "temporal_proximity": F.exp(-days / 7),
        "resolution": F.least(F.lit(1.0), F.exp(-F.col("resolution_m") / 100)),
        "cloud_cover": F.when(F.col("cloud").isNull(), 1.0).otherwise(1 - F.col("cloud") / 100),
        "data_quality": F.when(F.col("flag").isNull(), 0.8).otherwise(lookup(F.col("flag"), QUALITY_SCORES, 0.5)),
        "access_cost": lookup(F.col("cost_tier"), COST_SCORES, 0.5),
        "provider_preference": F.lit(0.5),
    }


def ranked(candidates: DataFrame, reference: str, keys: list[str]) -> DataFrame:
    """score_<criterion>, score and rank (from 1; ties to the smaller dataset_id) within keys."""
    s = scores(reference)
    out = candidates.select("*", *[c.alias(f"score_{k}") for k, c in s.items()])
    total = sum((F.col(f"score_{k}") * w for k, w in WEIGHTS.items()), F.lit(0.0))
    out = out.withColumn("score", F.round(total, 9))
    return out.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "dataset_id")))


def best(ranked_: DataFrame, keys: list[str], k: int = 1) -> DataFrame:
    """The first k of each key: Spark keeps only so many of each task's rows before they're shuffled."""
    return ranked_.where(F.col("rank") <= k)


def trade_offs(ranked_: DataFrame, keys: list[str], k: int = 4, n: int = 2) -> DataFrame:
    """For each runner-up, its n criteria that differ most from the winner's."""
    first = ranked_.where("rank = 1").select(*keys, *[F.col(f"score_{c}").alias(f"w_{c}") for c in WEIGHTS])
    rest = ranked_.where((F.col("rank") > 1) & (F.col("rank") <= k)).join(first, keys)
    deltas = F.array(*[F.struct(F.abs(F.round(F.col(f"score_{c}") - F.col(f"w_{c}"), 6)).alias("size"), F.lit(c).alias("criterion"), (F.round(F.col(f"score_{c}") - F.col(f"w_{c}"), 6) + 0.0).alias("delta")) for c in WEIGHTS])
    top = F.slice(F.array_sort(deltas, lambda a, b: F.when(a["size"] > b["size"], -1).when(a["size"] < b["size"], 1).when(a["criterion"] < b["criterion"], -1).otherwise(1)), 1, n)
    return rest.select(*keys, "dataset_id", "rank", F.posexplode(top).alias("place", "t")).select(*keys, "dataset_id", "rank", "place", "t.criterion", "t.delta")


def missing(required: DataFrame, available: DataFrame, key: str) -> DataFrame:
    return required.select(key).distinct().join(available.select(key), key, "left_anti")


def runnable(algorithms: DataFrame, available: list[str], memory_mb: int | None = None, gpu: bool = True) -> DataFrame:
    """Algorithms (requires array, memory_mb may be NULL, needs_gpu) whose required data types are all there."""
    ok = F.size(F.array_except("requires", F.array(*[F.lit(a) for a in available]))) == 0
    if memory_mb is not None:
        ok = ok & (F.col("memory_mb").isNull() | (F.col("memory_mb") <= memory_mb))
    return algorithms.where(ok if gpu else ok & ~F.col("needs_gpu"))


def class_matches(column: Column, pattern: str) -> Column:
    """A dotted class against a glob: `flood.*` takes every class under flood, and flood itself."""
    import re

    if pattern.endswith(".*"):
        return (column == pattern[:-2]) | column.startswith(pattern[:-1])
    return column.rlike("^" + re.escape(pattern).replace(r"\*", ".*").replace(r"\?", ".") + "$")


# ---------------------------------------------------------------- the index of boxes


def cells(df: DataFrame, size: float = 10.0) -> DataFrame:
    """A row for each cell of size degrees that a box reaches: boxes that meet share a cell, so a range join is an equi-join."""
    x = F.sequence(F.floor((F.col("west") + 180) / size), F.floor((F.col("east") + 180) / size))
    y = F.sequence(F.floor((F.col("south") + 90) / size), F.floor((F.col("north") + 90) / size))
    return df.withColumn("cx_", F.explode(x)).withColumn("cy_", F.explode(y))


def box_query(index: DataFrame, queries: DataFrame, limit: int) -> DataFrame:
    """query, key, score, rank: for each query box and closed time range, the boxes that meet it, by the root of spatial times temporal overlap."""
    a, b = cells(index), cells(queries)
    b = b.select("query", *[F.col(c).alias(f"q_{c}") for c in ("west", "south", "east", "north", "t0", "t1")], "cx_", "cy_")
    j = a.join(b, ["cx_", "cy_"])
    box, ask = tuple(F.col(c) for c in ("west", "south", "east", "north")), tuple(F.col(f"q_{c}") for c in ("west", "south", "east", "north"))
    # of the cells two boxes share, the lowest reports the pair
    own = (F.col("cx_") == F.floor((F.greatest("west", "q_west") + 180) / 10)) & (F.col("cy_") == F.floor((F.greatest("south", "q_south") + 90) / 10))
    j = j.where(own & G.boxes_intersect(box, ask) & (F.col("t0") <= F.col("q_t1")) & (F.col("t1") >= F.col("q_t0")))
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    spatial = G.overlap_area(box, ask) / ((F.col("q_east") - F.col("q_west")) * (F.col("q_north") - F.col("q_south")))
    temporal = (F.least(us("t1"), us("q_t1")) - F.greatest(us("t0"), us("q_t0"))) / (us("q_t1") - us("q_t0"))
    j = j.withColumn("score", F.round(F.sqrt(spatial * temporal), 9))
    return j.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "key"))).where(F.col("rank") <= limit).select("query", "key", "score", "rank")


# ---------------------------------------------------------------- text


def keyword_scores(texts: DataFrame, taxonomy: dict[str, list[str]], key: str, text: str = "text") -> DataFrame:
    """key, class, matches, confidence for each class of which a text has a keyword; words are lower-cased runs of letters of more than two.

    matches over the greater of the best class's matches and the class's keywords, and 0.7 of that where under half of the keywords are there.
    """
    words = F.array_distinct(F.filter(F.split(F.lower(text), r"[^\p{L}]+"), lambda w: F.length(w) > 2))
    t = texts.select(key, words.alias("w"))
    each = F.array(*[F.struct(F.lit(c).alias("class"), F.size(F.array_intersect("w", F.array(*[F.lit(k) for k in ks]))).alias("matches"), F.lit(len(ks)).alias("k")) for c, ks in taxonomy.items()])
    t = t.select(key, each.alias("m")).withColumn("best", F.array_max(F.transform("m", lambda m: m["matches"])))
    t = t.select(key, "best", F.explode(F.filter("m", lambda m: m["matches"] > 0)).alias("m")).select(key, "best", "m.*")
    base = F.least(F.lit(0.99), F.col("matches") / F.greatest("best", "k"))
    return t.select(key, "class", "matches", F.when(F.col("matches") < F.col("k") / 2, base * 0.7).otherwise(base).alias("confidence"))


def classify(texts: DataFrame, taxonomy: dict[str, list[str]], key: str) -> DataFrame:
    """The class of most matches of each text, ties to the first by name."""
    s = keyword_scores(texts, taxonomy, key)
    top = F.max_by(F.struct("class", "matches", "confidence"), F.struct("matches", F.lit(1), F.transform(F.split("class", ""), lambda c: -F.ascii(c))))
    return s.groupBy(key).agg(top.alias("t")).select(key, "t.*")
