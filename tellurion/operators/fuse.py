"""Several sources' values of a cell made one: conflicts, consensus, ensembles.

Input is a long table (row, col, source_id, value, quality, confidence); each operator is one aggregation by cell, which combines before it shuffles. Where
the winner's source is wanted, an ordered max of a struct picks it, so ties are settled the same way in every run. NULL values have no weight.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tellurion.functions.base import clip

CELL = ("row", "col")
#: Shares of confidence left by the severity of a conflict.
SEVERITY_FACTORS = {"none": 1.0, "low": 0.95, "medium": 0.8, "high": 0.6, "critical": 0.3}


def _valid() -> Column:
    return F.col("value").isNotNull()


def _weight() -> Column:
    return F.when(_valid(), F.coalesce("quality", F.lit(1.0)) * F.coalesce("confidence", F.lit(1.0)))


def conflicts(layers: DataFrame, absolute: float = 0.1, relative: float = 0.05) -> DataFrame:
    """n, mean, std, range, agreement (share of sources near the mean) and severity of each cell."""
    stats = layers.groupBy(*CELL).agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), (F.max("value") - F.min("value")).alias("range"), F.collect_list("value").alias("vs"))
    near = F.filter("vs", lambda v: (F.abs(v - F.col("mean")) <= absolute) | (F.abs(v - F.col("mean")) <= relative * F.abs(F.col("mean"))))
    out = stats.withColumn("agreement", F.when(F.col("n") > 0, F.size(near) / F.col("n")).otherwise(0.0)).drop("vs")
    spread = F.when(F.abs(F.col("mean")) > 1e-10, F.col("std") / F.abs(F.col("mean"))).otherwise(F.col("std"))
    severity = F.when((F.col("n") < 2) | (F.col("agreement") >= 0.9), "none").when(F.col("agreement") >= 0.7, "low").when(spread < 0.25, "medium").when(spread < 0.5, "high").otherwise("critical")
    return out.withColumn("severity", severity)


def resolve_mean(layers: DataFrame) -> DataFrame:
    return layers.groupBy(*CELL).agg(F.avg("value").alias("value"), (F.count("value") / F.count("*")).alias("confidence"))


def resolve_weighted(layers: DataFrame) -> DataFrame:
    """Weights are quality times confidence, of valid values only."""
    w = layers.groupBy(*CELL).agg(F.sum(_weight() * F.col("value")).alias("wv"), F.sum(_weight()).alias("w"), F.count("*").alias("n"))
    return w.select(*CELL, F.when(F.col("w") > 0, F.col("wv") / F.col("w")).alias("value"), (F.coalesce("w", F.lit(0.0)) / F.col("n")).alias("confidence"))


def resolve_median(layers: DataFrame, sources: int) -> DataFrame:
    """confidence: share of sources with a value times agreement."""
    c = conflicts(layers).select(*CELL, "agreement", "n")
    return layers.groupBy(*CELL).agg(F.median("value").alias("value")).join(c, list(CELL)).select(*CELL, "value", (F.col("n") / sources * F.col("agreement")).alias("confidence"))


def majority(votes: DataFrame, value: str = "class") -> DataFrame:
    """value, votes and source_id of the commonest value of each cell, ties to the smallest value, and its first source."""
    counts = votes.where(F.col(value).isNotNull()).groupBy(*CELL, value).agg(F.count("*").alias("votes"), F.min("source_id").alias("source_id"))
    best = F.max(F.struct("votes", (-F.col(value)).alias("low"), F.col(value).alias("value"), "source_id"))
    return counts.groupBy(*CELL).agg(best.alias("b"), F.sum("votes").alias("all")).select(*CELL, F.col("b.value").alias("value"), F.col("b.votes").alias("votes"), (F.col("b.votes") / F.col("all")).alias("confidence"), F.col("b.source_id").alias("source_id"))


def weighted_vote(votes: DataFrame, value: str = "class", place: str = "source_id") -> DataFrame:
    """The value with the greatest weight; its source is the weightiest that voted for it, of several the one with the least place."""
    w = F.coalesce("quality", F.lit(1.0)) * F.coalesce("confidence", F.lit(1.0))
    sums = votes.where(F.col(value).isNotNull()).withColumn("w", w).groupBy(*CELL, value).agg(F.sum("w").alias("w"), F.max(F.struct("w", (-F.col(place)).alias("low"), "source_id")).alias("top"))
    best = F.max(F.struct("w", (-F.col(value)).alias("low"), F.col(value).alias("value"), F.col("top.source_id").alias("source_id")))
    out = sums.groupBy(*CELL).agg(best.alias("b"), F.sum("w").alias("all"))
    return out.select(*CELL, F.col("b.value").alias("value"), F.when(F.col("all") > 0, F.col("b.w") / F.col("all")).otherwise(0.0).alias("confidence"), F.col("b.source_id").alias("source_id"))


def pick(layers: DataFrame, order: list[Column]) -> DataFrame:
    """The valid value that is greatest by order, then of the smallest source."""
    best = F.max(F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], (-F.col("source_id")).alias("low"), "value", "source_id"))
    return layers.where(_valid()).groupBy(*CELL).agg(best.alias("b")).select(*CELL, F.col("b.value").alias("value"), F.col("b.source_id").alias("source_id"))


def highest_confidence(layers: DataFrame) -> DataFrame:
    return pick(layers, [_weight()])


def by_priority(layers: DataFrame, priority: list[int]) -> DataFrame:
    """The first source of the list that has a value."""
    place = F.array_position(F.array(*[F.lit(p) for p in priority]), F.col("source_id"))
    return pick(layers, [-F.when(place > 0, place).otherwise(len(priority) + 1)])


def lowest(layers: DataFrame) -> DataFrame:
    return pick(layers, [-F.col("value")])


def highest(layers: DataFrame) -> DataFrame:
    return pick(layers, [F.col("value")])


def range_checked(layers: DataFrame, sigmas: float = 2.0) -> DataFrame:
    """The mean without values over so many population standard deviations away; confidence: the share kept."""
    s = layers.groupBy(*CELL).agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("s"), F.count("value").alias("n"), F.collect_list("value").alias("vs"))
    kept = F.filter("vs", lambda v: F.abs(v - F.col("m")) <= sigmas * F.col("s"))
    total = F.aggregate(kept, F.lit(0.0), lambda a, v: a + v)
    return s.select(*CELL, F.when(F.size(kept) > 0, total / F.size(kept)).otherwise(F.col("m")).alias("value"), F.when(F.col("n") > 0, F.size(kept) / F.col("n")).alias("confidence"))


def trimmed_mean(layers: DataFrame, share: float = 0.1) -> DataFrame:
    """The mean without the k = max(1, floor(share n)) least and greatest values, if k < n // 2; the plain mean else."""
    s = layers.groupBy(*CELL).agg(F.sort_array(F.collect_list("value")).alias("vs"), F.avg("value").alias("m"))
    n = F.size("vs")
    k = F.greatest(F.lit(1), F.floor(share * n).cast("int"))
    inner = F.slice("vs", k + 1, F.greatest(F.lit(0), n - 2 * k))
    total = F.aggregate(inner, F.lit(0.0), lambda a, v: a + v)
    return s.select(*CELL, F.when(k < F.floor(n / 2), total / F.size(inner)).otherwise(F.col("m")).alias("value"))


def robust_mean(layers: DataFrame, rounds: int = 5, k: float = 1.345) -> DataFrame:
    """Huber's mean by reweighting, from the median and the median absolute deviation; each round is an expression over the cell's few values."""
    s = layers.groupBy(*CELL).agg(F.collect_list("value").alias("vs"), F.median("value").alias("med"))
    dev = F.sort_array(F.transform("vs", lambda v: F.abs(v - F.col("med"))))
    n = F.size("vs")
    s = s.withColumn("dev", dev).withColumn("scale", 1.4826 * (F.get("dev", F.floor((n - 1) / 2).cast("int")) + F.get("dev", F.floor(n / 2).cast("int"))) / 2)
    s = s.withColumn("est", F.col("med"))
    for _ in range(rounds):
        def weight(v):
            u = F.abs(v - F.col("est"))
            return F.when(u <= k * F.col("scale"), 1.0).otherwise(k * F.col("scale") / u)

        top = F.aggregate("vs", F.lit(0.0), lambda a, v: a + weight(v) * v)
        bottom = F.aggregate("vs", F.lit(0.0), lambda a, v: a + weight(v))
        s = s.withColumn("est", F.when(F.col("scale") > 0, top / bottom).otherwise(F.col("est")))
    return s.select(*CELL, F.col("est").alias("value"))


def vote_consensus(votes: DataFrame, threshold: float, value: str = "class") -> DataFrame:
    """The majority's value, or -1 where its share is under threshold."""
    return majority(votes, value).select(*CELL, F.when(F.col("confidence") >= threshold, F.col("value")).otherwise(-1).alias("value"), F.col("confidence").alias("agreement"))


def agreement_of_mean(layers: DataFrame) -> DataFrame:
    """mean, agreement = 1 - min(std / |mean|, 1), confidence and uncertainty."""
    s = layers.groupBy(*CELL).agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.avg("confidence").alias("c"))
    s = s.withColumn("agreement", F.when(F.abs(F.col("mean")) > 1e-10, 1 - F.least(F.col("std") / F.abs(F.col("mean")), F.lit(1.0))).otherwise(0.0))
    s = s.withColumn("confidence", F.col("agreement") * F.col("c"))
    return s.select(*CELL, "mean", "agreement", "confidence", (F.col("std") * (1 - F.col("confidence"))).alias("uncertainty"))


def consensus_quality(agreement: Column, confidence: Column, sources: Column) -> Column:
    return F.when(sources < 1, "FAILED").when((agreement >= 0.8) & (confidence >= 0.7), "HIGH").when((agreement >= 0.6) & (confidence >= 0.5), "MODERATE").when(agreement >= 0.4, "LOW").otherwise("DEGRADED")


def contributions(layers: DataFrame, consensus: DataFrame) -> DataFrame:
    """source_id, share: (correlation with the consensus + 1) / 2 times mean confidence, made to sum to 1."""
    from pyspark.sql import Window

    j = layers.join(consensus.withColumnRenamed("value", "fused").select(*CELL, "fused"), list(CELL))
    c = j.groupBy("source_id").agg(((F.corr("value", "fused") + 1) / 2 * F.avg("confidence")).alias("w"))
    return c.select("source_id", (F.col("w") / F.sum("w").over(Window.partitionBy())).alias("share"))  # a row a source


def ensemble(votes: DataFrame, weights: dict[int, float], method: str, threshold: float = 0.5) -> DataFrame:
    """probability, detected, agreement, uncertainty and confidence of cells from detections (yes) and their confidence.

    weighted_average: sum of w * (c if yes else 1 - c); voting: sum of w * yes; bayesian: the sigmoid of the sum of w * logit. Weights sum to 1 over the
    sources that a cell has.
    """
    w = F.create_map(*[F.lit(x) for k, v in weights.items() for x in (k, float(v))])[F.col("source_id")]
    c = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), F.col("confidence")))
    p = F.when(F.col("yes") == 1, F.col("confidence")).otherwise(1 - F.col("confidence"))
    if method == "weighted_average":
        term = w * p
    elif method == "voting":
        term = w * F.col("yes")
    elif method == "bayesian":
        term = w * F.when(F.col("yes") == 1, F.log(c / (1 - c))).otherwise(F.log((1 - c) / c))
    else:
        raise ValueError(f"ensemble method {method!r} isn't supported")
    s = votes.groupBy(*CELL).agg(F.sum(term).alias("t"), F.sum(w).alias("w"), F.avg("yes").alias("share"), F.count("*").alias("n"), F.var_pop(p).alias("var"))
    raw = F.col("t") / F.col("w")
    s = s.withColumn("probability", 1 / (1 + F.exp(-raw)) if method == "bayesian" else raw).withColumn("detected", F.col("probability") >= threshold)
    s = s.withColumn("agreement", F.when(F.col("detected"), F.col("share")).otherwise(1 - F.col("share")))
    sure = F.abs(F.col("probability") - threshold) / max(threshold, 1 - threshold)
    return s.select(*CELL, "probability", "detected", "agreement", F.when(F.col("n") < 2, 0.0).otherwise(clip(F.col("var") / 0.25, 0, 1)).alias("uncertainty"), ((sure + F.col("agreement")) / 2).alias("confidence"))


def binary_vote(votes: DataFrame, method: str, power: float = 1.0, threshold: float = 0.7) -> DataFrame:
    """detected and confidence by majority, weighted, unanimous, consensus or confidence_max."""
    w = F.pow(F.col("confidence"), power)
    s = votes.groupBy(*CELL).agg(F.sum("yes").alias("y"), F.count("*").alias("n"), F.sum(w * F.col("yes")).alias("wy"), F.sum(w).alias("w"), F.min("confidence").alias("least"), F.max(F.struct("confidence", (-F.col("source_id")).alias("low"), "yes")).alias("top"))
    share = F.col("y") / F.col("n")
    if method == "majority":
        hit = share > 0.5
        sure = F.when(hit, share).otherwise(1 - share)
    elif method == "weighted":
        hit = F.col("wy") / F.col("w") > 0.5
        sure = F.when(hit, F.col("wy") / F.col("w")).otherwise(1 - F.col("wy") / F.col("w"))
    elif method == "unanimous":
        hit = F.col("y") == F.col("n")
        sure = F.when(hit, F.col("least")).otherwise(0.3)
    elif method == "consensus":
        hit = share >= threshold
        sure = F.when((share >= threshold) | (share <= 1 - threshold), 2 * F.abs(share - 0.5)).otherwise(0.3)
    elif method == "confidence_max":
        hit, sure = F.col("top.yes") == 1, F.col("top.confidence")
    else:
        raise ValueError(f"vote {method!r} isn't supported")
    return s.select(*CELL, hit.alias("detected"), sure.alias("confidence"))


def compare_pairs(layers: DataFrame, absolute: float = 0.1, relative: float = 0.05) -> DataFrame:
    """Every two sources on the cells they share: n, correlation, bias, rmse, mae, largest error, agreement, efficiency.

    Pairs are formed within a cell's few sources, by one shuffle on the cell; no source meets another as a whole.
    """
    per_cell = layers.where(_valid()).groupBy(*CELL).agg(F.sort_array(F.collect_list(F.struct("source_id", "value"))).alias("s"))
    pairs = per_cell.select(F.explode(F.flatten(F.transform("s", lambda a, i: F.transform(F.slice("s", i + 2, F.size("s")), lambda b: F.struct(a["source_id"].alias("a"), b["source_id"].alias("b"), a["value"].alias("x"), b["value"].alias("y")))))).alias("p")).select("p.*")
    d = F.col("y") - F.col("x")
    near = (F.abs(d) <= absolute) | (F.abs(d) <= relative * (F.abs(F.col("x")) + F.abs(F.col("y"))) / 2)
    return pairs.groupBy("a", "b").agg(
        F.count("*").alias("n"), F.corr("x", "y").alias("correlation"), F.avg(d).alias("bias"), F.sqrt(F.avg(d * d)).alias("rmse"), F.avg(F.abs(d)).alias("mae"),
        F.max(F.abs(d)).alias("largest"), F.avg(near.cast("double")).alias("agreement"), (1 - F.sum(d * d) / F.when(F.var_pop("x") > 0, F.var_pop("x") * F.count("*"))).alias("efficiency"),
    )


def agreement_level(spread: Column, tolerance: float) -> Column:
    return F.when(spread <= tolerance / 2, "excellent").when(spread <= tolerance, "good").when(spread <= 2 * tolerance, "moderate").when(spread <= 5 * tolerance, "poor").otherwise("disagreement")
