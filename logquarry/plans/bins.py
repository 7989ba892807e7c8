"""Time bins for charts, and re-filtering of fact tables that are already made."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sql import count_rows

MOST_BINS = 200
MINUTE = 60_000_000


def interval(x: DataFrame, ts: str = "ts") -> DataFrame:
    """lo_us and width_us: a minute below an hour, 5 below six, 15 below a day, else an hour; wider if there would be over 200 bins."""
    span = x.agg(F.min(F.unix_micros(ts)).alias("lo_us"), F.max(F.unix_micros(ts)).alias("hi_us"))
    d = F.col("hi_us") - F.col("lo_us")
    width = F.when(d < 60 * MINUTE, MINUTE).when(d < 360 * MINUTE, 5 * MINUTE).when(d < 1440 * MINUTE, 15 * MINUTE).otherwise(60 * MINUTE)
    return span.select("lo_us", F.greatest(width.cast("long"), F.expr(f"(hi_us - lo_us) div {MOST_BINS} + 1")).alias("width_us"))


def binned(x: DataFrame, *measures: Column, ts: str = "ts") -> DataFrame:
    """Count and measures of each bin that has rows."""
    at = F.expr(f"(unix_micros({ts}) - lo_us) div width_us")
    return x.crossJoin(F.broadcast(interval(x, ts))).groupBy(at.alias("bin")).agg(count_rows().alias("count"), *measures)


def upper_median(binned_: DataFrame, column: str = "count") -> DataFrame:
    """The upper median of the filled bins, the line a chart draws."""
    return binned_.agg(F.expr(f"element_at(array_sort(collect_list({column})), cast(count(1) div 2 as int) + 1)").alias("median"))


def refilter(facts: DataFrame, begin: str | None, end: str | None, ts: str = "ts") -> DataFrame:
    if begin:
        facts = facts.where(F.col(ts) >= F.lit(begin).cast("timestamp"))
    return facts.where(F.col(ts) <= F.lit(end).cast("timestamp")) if end else facts


def overlapping(sessions: DataFrame, begin: str, end: str) -> DataFrame:
    """Sessions that are open at any moment of a range."""
    return sessions.where((F.col("start_ts") <= F.lit(end).cast("timestamp")) & (F.col("end_ts") >= F.lit(begin).cast("timestamp")))


def checkpoint_series(done: DataFrame) -> DataFrame:
    """Checkpoints of each hour by what started them: time, wal, other."""
    k = F.col("kind")
    return done.groupBy(F.date_trunc("hour", "ts").alias("hour")).agg(F.count_if(k == "time").alias("by_time"), F.count_if(k == "wal").alias("by_wal"), F.count_if(~k.isin("time", "wal")).alias("other"))


def concurrent_bins(sessions: DataFrame) -> DataFrame:
    """The most sessions at once in each bin that has a start or an end."""
    from logquarry.operators.associate import concurrency

    points = concurrency(sessions).withColumn("at", F.timestamp_micros("ts_us"))
    return binned(points, F.max("running").alias("most"), ts="at").drop("count")


def concurrent_split(sessions: DataFrame, begin: str) -> DataFrame:
    """For each bin the most sessions at once, and how many of them, at the first such moment, were open before the log begins."""
    from logquarry.operators.associate import concurrency, running_sum

    start = F.lit(begin).cast("timestamp")
    points = concurrency(sessions.withColumn("early", F.col("start_ts") < start), keep=("early",))
    early = running_sum(points.withColumn("early_delta", F.when(F.col("early"), F.col("delta")).otherwise(0)).withColumnRenamed("running", "total"), "early_delta", ["ts_us", F.desc("delta"), "seq"], F.expr("ts_us div 3600000000"))
    early = early.withColumn("at", F.timestamp_micros("ts_us"))
    first = F.struct(F.col("total"), -F.col("ts_us"), F.col("delta"), -F.col("seq"))
    return binned(early, F.max("total").alias("most"), F.max_by("running", first).alias("before_log"), ts="at").drop("count")
