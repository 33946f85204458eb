"""The views over the supplied tables that the queries run on, for Spark and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SPLIT = "1998-06-01"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _cell(key):
    return [F.floor(F.col(key) / 50).cast("int").alias("row"), (F.col(key) % 50).cast("int").alias("col")]


def _numbered(df: DataFrame) -> DataFrame:
    """With each row's place in its table as at."""
    place = F.col("_metadata.row_index")
    return df.withColumn("at", place if len(df.inputFiles()) == 1 else F.struct("_metadata.file_path", place.alias("row_index")))


def _in_order(df: DataFrame) -> DataFrame:
    """A cell's rows together, in the order of at. Sums of doubles depend on their order, so this makes them the same however the table is split."""
    return df.repartition("row", "col").sortWithinPartitions("row", "col", "at")


def _obs(lineitem: DataFrame, *more: str) -> DataFrame:
    return lineitem.select(*_cell("l_partkey"), (F.col("l_suppkey") % 5).cast("int").alias("source_id"), F.col("l_shipdate").alias("ts"), F.col("l_quantity").alias("value"), F.when(F.col("l_discount") >= 0.1, 0.0).otherwise(1 - 10 * F.col("l_discount")).alias("quality"), (1 - F.col("l_tax")).alias("confidence"), *more)


def px_obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations of cells by five sources: row, col, source_id, ts, value, quality, confidence."""
    return _obs(table(spark, sf_dir, "lineitem"))


def px_pre_post(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean value of each cell before and after a date, and as decibels."""
    before = F.col("ts") < F.lit(SPLIT).cast("timestamp_ntz")
    px = px_obs(spark, sf_dir).groupBy("row", "col").agg(F.avg(F.when(before, F.col("value"))).alias("pre"), F.avg(F.when(~before, F.col("value"))).alias("post"))
    return px.withColumn("pre_db", -F.col("pre")).withColumn("post_db", -F.col("post"))


def px_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five reflectances of each cell, NULL where a band is missing."""
    l = _in_order(_numbered(table(spark, sf_dir, "lineitem")).select(*_cell("l_partkey"), "l_linenumber", (F.col("l_quantity") / 50).alias("v"), "at"))  # noqa: E741
    return l.groupBy("row", "col").agg(*[F.avg(F.when(F.col("l_linenumber") == i, F.col("v"))).alias(b) for i, b in enumerate(("blue", "green", "red", "nir", "swir"), 1)])


def px_static(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elevation and brightness of each cell."""
    return table(spark, sf_dir, "part").select(*_cell("p_partkey"), F.col("p_size").cast("double").alias("elev"), (F.col("p_retailprice") / 1000).alias("brightness"))


def px_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One value, quality and confidence for each cell and source; a cell's sources in the order of their first rows."""
    obs = _in_order(_obs(_numbered(table(spark, sf_dir, "lineitem")), "at"))
    layers = obs.groupBy("row", "col", "source_id").agg(F.avg("value").alias("value"), F.avg("quality").alias("quality"), F.avg("confidence").alias("confidence"), F.min("at").alias("at"))
    return layers.sortWithinPartitions("row", "col", "at").drop("at")


def px_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A class (a quarter of the value's range) and a yes or no for each cell and source."""
    return px_layers(spark, sf_dir).select("row", "col", "source_id", F.floor(F.col("value") / 12.5).cast("int").alias("class"), (F.col("value") > 25).cast("int").alias("yes"), "quality", "confidence", "value")


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Irregular series: entity, sensor, id, ts, hours (since 2024), value."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("entity"), F.col("event_type").alias("sensor"), F.col("event_id").alias("id"), "ts", (F.unix_micros(F.col("ts").cast("timestamp")) / 3.6e9 - 473352.0).alias("hours"), "value")


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A catalogue of datasets on offer."""
    o, c, n = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    joined = o.join(c, o["o_custkey"] == c["c_custkey"]).join(n, c["c_nationkey"] == n["n_nationkey"])
    kind = F.substring("o_orderpriority", 1, 1)
    data_type = F.when(kind == "1", "optical").when(kind == "2", "sar").when(kind == "3", "dem").when(kind == "4", "weather").otherwise("ancillary")
    key = F.col("o_orderkey")
    return joined.select(key.alias("dataset_id"), F.col("n_name").alias("provider"), data_type.alias("data_type"), F.col("o_orderdate").alias("acquired"), (key % 101).cast("double").alias("coverage"), (10 + F.col("o_custkey") % 90).cast("double").alias("resolution_m"), F.when(data_type == "optical", (key * 7 % 101).cast("double")).alias("cloud"), F.when(F.col("o_orderstatus") == "F", "open").when(F.col("o_orderstatus") == "O", "open_restricted").otherwise("commercial").alias("cost_tier"), F.when(key % 6 == 0, "excellent").when(key % 6 == 1, "good").when(key % 6 == 2, "fair").when(key % 6 == 3, "poor").when(key % 6 == 4, "bad").alias("flag"))


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Indexed boxes two degrees wide with a time range of their customer's orders."""
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    times = o.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.min("o_orderdate").alias("t0"), F.max("o_orderdate").alias("t1"))
    k = F.col("c_custkey")
    return c.join(times, "c_custkey").select(k.alias("key"), (k % 360 - 180).cast("double").alias("west"), (k * 7 % 170 - 85).cast("double").alias("south"), (k % 360 - 178).cast("double").alias("east"), (k * 7 % 170 - 83).cast("double").alias("north"), "t0", "t1", F.col("c_mktsegment").alias("data_type"), (10 + k % 90).cast("double").alias("resolution_m"))


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ensemble members of each cell."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("cell"), F.posexplode("embedding").alias("member", "value")).withColumn("value", F.col("value").cast("double"))


def binary_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.col("quality").cast("int").alias("observed"), F.col("toxic").cast("int").alias("forecast"))


def forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted probability (of an event's user among the events so far) and what came: p, o, by day."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("id"), ((F.col("user_id") * 37 % 100) / 100).alias("p"), (F.col("value") > 30).cast("int").alias("o"), F.to_date("ts").alias("day"), F.dayofmonth("ts").cast("int").alias("lead"))


#: name: (views that it stands on, SQL)
CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "px_obs": ((), "select cast(floor(l_partkey / 50) as int) as row, cast(l_partkey % 50 as int) as col, cast(l_suppkey % 5 as int) as source_id, l_shipdate as ts, l_quantity as value, case when l_discount >= 0.1 then 0.0::double else 1 - 10 * l_discount end as quality, 1 - l_tax as confidence from lineitem"),
    "px_pre_post": (("px_obs",), f"select *, -pre as pre_db, -post as post_db from (select row, col, avg(case when ts < timestamp '{SPLIT}' then value end) as pre, avg(case when ts >= timestamp '{SPLIT}' then value end) as post from px_obs group by all)"),
    "px_bands": ((), "select cast(floor(l_partkey / 50) as int) as row, cast(l_partkey % 50 as int) as col, " + ", ".join(f"avg(case when l_linenumber = {i} then l_quantity / 50 end) as {b}" for i, b in enumerate(("blue", "green", "red", "nir", "swir"), 1)) + " from lineitem group by 1, 2"),
    "px_static": ((), "select cast(floor(p_partkey / 50) as int) as row, cast(p_partkey % 50 as int) as col, p_size::double as elev, p_retailprice / 1000 as brightness from part"),
    "px_layers": (("px_obs",), "select row, col, source_id, avg(value) as value, avg(quality) as quality, avg(confidence) as confidence from px_obs group by all"),
    "px_votes": (("px_layers",), "select row, col, source_id, cast(floor(value / 12.5) as int) as class, cast(value > 25 as int) as yes, quality, confidence, value from px_layers"),
    "series": ((), "select user_id as entity, event_type as sensor, event_id as id, ts, epoch_us(ts) / 3.6e9 - 473352.0 as hours, value from events"),
    "candidates": ((), "select o_orderkey as dataset_id, n_name as provider, case left(o_orderpriority, 1) when '1' then 'optical' when '2' then 'sar' when '3' then 'dem' when '4' then 'weather' else 'ancillary' end as data_type, o_orderdate as acquired, (o_orderkey % 101)::double as coverage, (10 + o_custkey % 90)::double as resolution_m, case when left(o_orderpriority, 1) = '1' then (o_orderkey * 7 % 101)::double end as cloud, case o_orderstatus when 'F' then 'open' when 'O' then 'open_restricted' else 'commercial' end as cost_tier, case o_orderkey % 6 when 0 then 'excellent' when 1 then 'good' when 2 then 'fair' when 3 then 'poor' when 4 then 'bad' end as flag from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey"),
    "boxes": ((), "select c_custkey as key, (c_custkey % 360 - 180)::double as west, (c_custkey * 7 % 170 - 85)::double as south, (c_custkey % 360 - 178)::double as east, (c_custkey * 7 % 170 - 83)::double as north, t0, t1, c_mktsegment as data_type, (10 + c_custkey % 90)::double as resolution_m from customer join (select o_custkey, min(o_orderdate) as t0, max(o_orderdate) as t1 from orders group by 1) on c_custkey = o_custkey"),
    "members": ((), "select vec_id as cell, unnest(range(len(embedding)))::int as member, unnest(embedding)::double as value from embeddings"),
    "binary_labels": ((), "select doc_id as id, quality::int as observed, toxic::int as forecast from labels"),
    "forecast": ((), "select event_id as id, (user_id * 37 % 100) / 100 as p, cast(value > 30 as int) as o, ts::date as day, dayofmonth(ts)::int as lead from events"),
}
