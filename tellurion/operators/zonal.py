"""Statistics of a whole raster, or of groups of it, put beside each of its cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_totals(df: DataFrame, **aggregates: Column) -> DataFrame:
    """df with one-row aggregates of itself as columns: two-phase aggregation, and a broadcast of exactly one row."""
    return df.crossJoin(F.broadcast(df.agg(*[v.alias(k) for k, v in aggregates.items()])))


def with_group_totals(df: DataFrame, keys: list[str], **aggregates: Column) -> DataFrame:
    return df.join(df.groupBy(*keys).agg(*[v.alias(k) for k, v in aggregates.items()]), keys)


def z_scores(df: DataFrame, value: str = "value") -> DataFrame:
    """value's distance from the mean in population standard deviations, NULL where those are 0."""
    out = with_totals(df, mean_=F.avg(value), std_=F.stddev_pop(value))
    return out.withColumn("z", F.when(F.col("std_") > 0, (F.col(value) - F.col("mean_")) / F.col("std_"))).drop("mean_", "std_")
