"""Statement sections: totals, per fingerprint, per type, category and dimension, rankings and histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logquarry.constants import DURATION_BUCKETS
from logquarry.operators import ranks


def count_rows() -> Column:
    return F.count(F.lit(1))


def totals(x: DataFrame) -> DataFrame:
    return x.agg(count_rows().alias("count"), F.count_distinct("norm_query").alias("unique_queries"), F.min("duration_ms").alias("min_ms"), F.max("duration_ms").alias("max_ms"), F.sum("duration_ms").alias("sum_ms"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def median(x: DataFrame) -> DataFrame:
    return ranks.median(x, "duration_ms", "median_ms")


def p99(x: DataFrame, share: float = 0.99) -> DataFrame:
    """The element at index floor(share * n) in ascending order."""
    return ranks.element(x, "duration_ms", share, "p99_ms")


def top_share(x: DataFrame) -> DataFrame:
    """How many executions reach the 99th percentile."""
    return x.join(F.broadcast(p99(x)), F.col("duration_ms") >= F.col("p99_ms")).agg(count_rows().alias("slow_count"))


def query_stats(x: DataFrame) -> DataFrame:
    """Per normalised query: id, type, category, count, total, mean, longest, smallest raw text (and plan, if joined)."""
    more = [F.max_by("plan", F.when(F.col("plan").isNotNull(), F.col("seq"))).alias("plan")] if "plan" in x.columns else []
    g = x.groupBy("norm_query").agg(
        F.min_by("query_id", "seq").alias("query_id"), F.min("full_hash").alias("full_hash"), F.min_by("query_type", "seq").alias("query_type"), F.min_by("category", "seq").alias("category"),
        count_rows().alias("count"), F.sum("duration_ms").alias("total_ms"), F.avg("duration_ms").alias("avg_ms"), F.max("duration_ms").alias("max_ms"), F.min("raw_query").alias("raw_query"), *more,
    )
    return g


def type_stats(stats: DataFrame) -> DataFrame:
    return stats.groupBy("query_type").agg(count_rows().alias("unique_queries"), F.sum("count").alias("count"), F.sum("total_ms").alias("total_ms"), (F.sum("total_ms") / F.sum("count")).alias("avg_ms"), F.max("max_ms").alias("max_ms"))


def category_stats(stats: DataFrame) -> DataFrame:
    g = stats.groupBy("category").agg(F.sum("count").alias("count"), F.sum("total_ms").alias("total_ms"))
    return g.withColumn("percent", 100.0 * F.col("count") / F.sum("count").over(Window.partitionBy()))


def by_dimension(x: DataFrame) -> DataFrame:
    """(dimension, value, query_type) with count and total for database, user, host and application, in one pass."""
    dims = ["db", "user", "host", "app"]
    long = x.select("query_type", "duration_ms", F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).alias("value")) for d in dims])).alias("d"))
    return long.select("d.*", "query_type", "duration_ms").where("value <> ''").groupBy("dimension", "value", "query_type").agg(count_rows().alias("count"), F.sum("duration_ms").alias("total_ms"))


def dimension_totals(by: DataFrame) -> DataFrame:
    return by.groupBy("dimension", "value").agg(F.sum("count").alias("count"), F.sum("total_ms").alias("total_ms"))


def slowest(stats: DataFrame, n: int = 10) -> DataFrame:
    return stats.orderBy(F.desc("max_ms"), "norm_query").limit(n)


def most_frequent(stats: DataFrame, n: int = 15, repeated: bool = True) -> DataFrame:
    return (stats.where("count > 1") if repeated else stats).orderBy(F.desc("count"), "norm_query").limit(n)


def time_consuming(stats: DataFrame, n: int = 10) -> DataFrame:
    return stats.orderBy(F.desc("total_ms"), "norm_query").limit(n)


def split_transactions(stats: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Statistics without and with transaction commands, which reports list apart and without a limit."""
    return stats.where("category <> 'TCL'"), stats.where("category = 'TCL'")


def transactions_by_type(stats: DataFrame) -> DataFrame:
    return stats.where("category = 'TCL'").groupBy("query_type").agg(F.sum("count").alias("count"), F.sum("total_ms").alias("total_ms"))


def duration_label(ms: Column) -> Column:
    out = F.lit(DURATION_BUCKETS[-1][0])
    for name, below in reversed(DURATION_BUCKETS[:-1]):
        out = F.when(ms < below, name).otherwise(out)
    return out


def duration_hist(x: DataFrame, weight: str | None = None, value: str = "duration_ms", keys: tuple[str, ...] = ()) -> DataFrame:
    """Counts of six duration buckets, empty ones included when there are no keys."""
    n = F.sum(weight) if weight else count_rows()
    got = x.groupBy(*keys, duration_label(F.col(value)).alias("bucket")).agg(n.cast("long").alias("count"))
    if keys:
        return got
    return zero_filled(got, [b for b, _ in DURATION_BUCKETS])


def zero_filled(got: DataFrame, buckets: list[str]) -> DataFrame:
    every = got.sparkSession.createDataFrame([(i, b) for i, b in enumerate(buckets)], "bucket_index int, bucket string")
    return F.broadcast(every).join(got, "bucket", "left").select("bucket_index", "bucket", F.coalesce("count", F.lit(0).cast("long")).alias("count"))


def bucketed(x: DataFrame, ts: str = "ts", n: int = 6, keys: tuple[str, ...] = (), least_us: int = 1, span: DataFrame | None = None) -> DataFrame:
    """x with bucket_index: n equal parts of [first, last] of ts (of each key, or of a given span with lo and hi)."""
    us = F.unix_micros(ts)
    if span is None:
        span = x.groupBy(*keys).agg(F.min(us).alias("lo"), F.max(us).alias("hi"))
    joined = x.join(span if keys else F.broadcast(span), list(keys)) if keys else x.crossJoin(F.broadcast(span))
    width = F.greatest(F.expr(f"(greatest(hi - lo, {least_us}L)) div {n}"), F.lit(1))
    at = F.least(F.floor((us - F.col("lo")) / width).cast("int"), F.lit(n - 1))
    return joined.withColumn("bucket_index", at).where((us >= F.col("lo")) & (us <= F.col("hi"))).drop("lo", "hi")


def load_hist(x: DataFrame, n: int = 6, keys: tuple[str, ...] = ()) -> DataFrame:
    """Whole milliseconds of execution in each of n equal parts of the time between the first and the last."""
    return bucketed(x, n=n, keys=keys).groupBy(*keys, "bucket_index").agg(F.sum(F.floor("duration_ms")).cast("long").alias("load_ms"), count_rows().alias("count"))


def load_unit(peak_ms: float) -> tuple[str, int]:
    """The unit a histogram of milliseconds is shown in."""
    return ("ms", 1) if peak_ms < 1000 else ("s", 1000) if peak_ms < 60_000 else ("m", 60_000)


def detail_minmax(x: DataFrame) -> DataFrame:
    return x.groupBy("query_id").agg(count_rows().alias("count"), F.min("duration_ms").alias("min_ms"), F.max("duration_ms").alias("max_ms")).join(ranks.median_by(x, ["query_id"], "duration_ms", "median_ms"), "query_id", "left")


def detail(stats: DataFrame, temp: DataFrame, locks: DataFrame, ids: list[str] | None = None) -> DataFrame:
    """Per query hash: statement, temporary file and lock statistics side by side."""
    s = stats.select("full_hash", "query_id", "norm_query", "count", "total_ms", "max_ms")
    t = temp.select("full_hash", F.col("query_id").alias("t_id"), F.col("count").alias("temp_count"), F.col("total_size").alias("temp_bytes"))
    k = locks.select("full_hash", F.col("query_id").alias("l_id"), "acquired_count", "waiting_count", "total_wait_ms")
    out = s.join(t, "full_hash", "full").join(k, "full_hash", "full").withColumn("query_id", F.coalesce("query_id", "t_id", "l_id")).drop("t_id", "l_id")
    return out.where(F.col("query_id").isin(ids)) if ids else out


def without_duration(stats: DataFrame, others: DataFrame) -> DataFrame:
    """Queries seen only by locks or temporary files; others: full_hash, query_id."""
    return others.select("full_hash", "query_id").distinct().join(stats.select("full_hash"), "full_hash", "left_anti")
