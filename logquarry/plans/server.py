"""Sections about the server: summary, events, connections, temporary files, locks, checkpoints, maintenance, clients."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logquarry.constants import PAGE_BYTES, SESSION_BUCKETS, SEVERITIES
from logquarry.functions.events import class_description
from logquarry.operators import associate as A
from logquarry.operators import ranks

from .sql import count_rows, bucketed, zero_filled


def everything():
    return Window.partitionBy()


def summary(entries: DataFrame) -> DataFrame:
    """Entries (continuations not counted), first and last moment, duration and rate."""
    s = entries.agg(F.count_if(~F.col("is_continuation")).alias("entries"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    s = s.withColumn("duration_us", F.unix_micros("last_ts") - F.unix_micros("first_ts"))
    return s.withColumn("entries_per_s", F.try_divide(F.col("entries") * 1_000_000.0, F.col("duration_us")))


def severities(events: DataFrame) -> DataFrame:
    g = events.groupBy("severity").agg(count_rows().alias("count"))
    rank = F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), F.col("severity"))
    return g.select("severity", "count", (100.0 * F.col("count") / F.sum("count").over(everything())).alias("percent"), rank.cast("int").alias("rank"))


def event_patterns(events: DataFrame, first: int | None = 1000) -> DataFrame:
    """Per fingerprint: count, and severity, example and SQLSTATE class of its first event; only the first-seen fingerprints are kept."""
    g = events.where("pattern is not null").groupBy("pattern").agg(
        count_rows().alias("count"), F.min("seq").alias("first_seq"), F.min_by("severity", "seq").alias("severity"), F.min_by("message", "seq").alias("example"), F.min_by("sqlstate_class", "seq").alias("sqlstate_class")
    )
    return g if first is None else g.orderBy("first_seq").limit(first)


def top_events(events: DataFrame, n: int = 100) -> DataFrame:
    return event_patterns(events).orderBy(F.desc("count"), "pattern").limit(n)


def error_classes(patterns: DataFrame) -> DataFrame:
    """severity, class, description, count and share within the severity."""
    g = patterns.groupBy("severity", F.coalesce("sqlstate_class", F.lit("")).alias("sqlstate_class")).agg(F.sum("count").alias("count"), count_rows().alias("patterns"))
    share = 100.0 * F.col("count") / F.sum("count").over(Window.partitionBy("severity"))
    return g.select("severity", "sqlstate_class", F.when(F.col("sqlstate_class") != "", class_description(F.col("sqlstate_class"))).otherwise("").alias("description"), "count", "patterns", share.alias("percent"))


def connection_totals(c: DataFrame) -> DataFrame:
    """Received and disconnected connections, session time, and rates over the log's span of these events."""
    return c.agg(
        F.count_if(F.col("kind") == "received").alias("received"), F.count_if(F.col("kind") == "disconnected").alias("disconnected"),
        F.sum(F.when(F.col("dur_us") > 0, F.col("dur_us")).otherwise(0)).alias("session_us"),
    )


def peak(c: DataFrame) -> DataFrame:
    """The largest number of active connections at a connect, and its first moment."""
    r = A.active_connections(c).where("kind = 'received'")
    return r.agg(F.max("running").alias("peak"), F.min_by("ts", F.struct(-F.col("running"), "seq")).alias("peak_ts"))


def _session_measures():
    d = F.col("dur_us")
    return [count_rows().alias("count"), F.min(d).alias("min_us"), F.max(d).alias("max_us"), F.avg(d).alias("avg_us"), F.sum(d).alias("sum_us")]


def session_stats(s: DataFrame) -> DataFrame:
    return s.agg(*_session_measures()).crossJoin(ranks.median(s, "dur_us", "median_us"))


def session_by(s: DataFrame, key: str, accuracy: int | None = None) -> DataFrame:
    """Sessions of each user, db or host; an approximate median if an accuracy is given."""
    named = s.where(F.col(key) != "")
    if accuracy:
        return named.groupBy(key).agg(*_session_measures(), F.percentile_approx("dur_us", 0.5, accuracy).alias("median_us"))
    return named.groupBy(key).agg(*_session_measures()).join(ranks.median_by(named, [key], "dur_us", "median_us"), key, "left")


def paired_sessions(c: DataFrame) -> DataFrame:
    """pid, start_ts, end_ts: each connection received with the next disconnection of its process, if that comes before another connection."""
    w = Window.partitionBy("pid").orderBy("seq")
    named = c.where("pid <> ''").withColumns({"next_kind": F.lead("kind").over(w), "next_ts": F.lead("ts").over(w)})
    return named.where("kind = 'received'").select("pid", F.col("ts").alias("start_ts"), F.when(F.col("next_kind") == "disconnected", F.col("next_ts")).alias("end_ts"))


def session_distribution(s: DataFrame) -> DataFrame:
    out = F.lit(SESSION_BUCKETS[-1][0])
    for name, below in reversed(SESSION_BUCKETS[:-1]):
        out = F.when(F.col("dur_us") < below, name).otherwise(out)
    return zero_filled(s.groupBy(out.alias("bucket")).agg(count_rows().alias("count")), [b for b, _ in SESSION_BUCKETS])


def concurrent_hist(s: DataFrame, n: int = 6) -> DataFrame:
    """The most sessions at once in each of n equal parts of the sessions' span, those carried in included."""
    span = s.agg(F.min(F.unix_micros("start_ts")).alias("lo"), F.max(F.unix_micros("end_ts")).alias("hi"))
    width = F.greatest(F.expr(f"(hi - lo) div {n}"), F.lit(1))
    points = A.concurrency(s).crossJoin(F.broadcast(span)).withColumn("bucket_index", F.least(F.floor((F.col("ts_us") - F.col("lo")) / width).cast("int"), F.lit(n - 1)))
    by = points.groupBy("bucket_index").agg(F.max("running").alias("most"), F.max_by("running", F.struct("ts_us", -F.col("delta"), "seq")).alias("last"))
    every = s.sparkSession.range(n).select(F.col("id").cast("int").alias("bucket_index"))
    w = Window.orderBy("bucket_index").rowsBetween(*A.BEFORE)
    carried = F.coalesce(F.last("last", ignorenulls=True).over(w), F.lit(0))
    return F.broadcast(every).join(by, "bucket_index", "left").withColumn("in", carried).select("bucket_index", F.greatest(F.coalesce("most", F.lit(0)), F.col("in")).alias("most"))


def average_concurrent(s: DataFrame, entries: DataFrame) -> DataFrame:
    span = entries.agg((F.unix_micros(F.max("ts")) - F.unix_micros(F.min("ts"))).alias("span_us"))
    return s.agg(F.sum("dur_us").alias("sum_us")).crossJoin(span).select(F.try_divide(F.col("sum_us") * 1.0, "span_us").alias("avg_concurrent"))


def connection_hist(c: DataFrame, span: DataFrame | None = None, n: int = 6) -> DataFrame:
    return bucketed(c.where("kind = 'received'"), n=n, span=span).groupBy("bucket_index").agg(count_rows().alias("count"))


def temp_stats(t: DataFrame) -> DataFrame:
    return t.agg(count_rows().alias("count"), F.coalesce(F.sum("size"), F.lit(0)).alias("total_size"), F.expr("coalesce(sum(size) div count(1), 0)").alias("avg_size"))


def temp_queries(associated: DataFrame) -> DataFrame:
    """Per query hash: files and bytes. associated: temporary files with their query. Each different text is normalised once."""
    x = associated.where("query is not null and size > 0").groupBy("query").agg(F.min("seq").alias("seq"), count_rows().alias("count"), F.sum("size").alias("size"))
    return A.with_query_id(x).groupBy("full_hash").agg(F.min_by("query_id", "seq").alias("query_id"), F.min("norm_query").alias("norm_query"), F.sum("count").alias("count"), F.sum("size").alias("total_size"), F.min("query").alias("raw_query"))


def top_temp_queries(stats: DataFrame, n: int = 10) -> DataFrame:
    return stats.orderBy(F.desc("total_size"), "query_id").limit(n)


def temp_hist(t: DataFrame, n: int = 6, keys: tuple[str, ...] = ()) -> DataFrame:
    """Bytes and files in each of n equal parts of the time between the first and the last (of each key), a second at least."""
    return bucketed(t, n=n, least_us=1_000_000, keys=keys).groupBy(*keys, "bucket_index").agg(F.sum("size").alias("bytes"), count_rows().alias("count"))


def lock_totals(messages: DataFrame, deadlocks: DataFrame) -> DataFrame:
    m = messages.agg(
        F.count_distinct("lock_key").alias("locks"), F.count_if(F.col("event_type") == "acquired").alias("acquired"),
        F.coalesce(F.sum(F.when(F.col("event_type") == "acquired", F.col("wait_ms"))), F.lit(0.0)).alias("total_wait_ms"),
    )
    m = m.withColumn("waiting", F.greatest(F.col("locks") - F.col("acquired"), F.lit(0)))
    m = m.withColumn("avg_wait_ms", F.coalesce(F.try_divide(F.col("total_wait_ms"), F.col("waiting") + F.col("acquired")), F.lit(0.0)))
    return m.crossJoin(F.broadcast(deadlocks.agg(count_rows().alias("deadlocks"))))


def lock_dimension(locks: DataFrame, key: str) -> DataFrame:
    """Distinct lock keys of each lock_type, resource_type or relation."""
    return locks.where(F.coalesce(F.col(key), F.lit("")) != "").groupBy(key).agg(count_rows().alias("count")).withColumn("percent", 100.0 * F.col("count") / F.sum("count").over(everything()))


def lock_relations(waits: DataFrame) -> DataFrame:
    """Waits on each relation that a message of the process has named, and their share."""
    return lock_dimension(waits, "relation")


def lock_queries(locks: DataFrame) -> DataFrame:
    """Per query hash: locks acquired and still waiting, with the last reported wait of each. Each different text is normalised once."""
    got, no = F.col("acquired") == 1, F.col("acquired") == 0
    x = locks.where("query is not null").groupBy("query").agg(
        F.min("seq").alias("seq"), F.count_if(got).alias("acquired_count"), F.sum(F.when(got, F.col("last_wait_ms")).otherwise(0.0)).alias("acquired_ms"),
        F.count_if(no).alias("waiting_count"), F.sum(F.when(no, F.col("last_wait_ms")).otherwise(0.0)).alias("waiting_ms"), F.sum("last_wait_ms").alias("total_wait_ms"),
    )
    sums = [F.sum(c).alias(c) for c in ("acquired_count", "acquired_ms", "waiting_count", "waiting_ms", "total_wait_ms")]
    return A.with_query_id(x).groupBy("full_hash").agg(F.min_by("query_id", "seq").alias("query_id"), F.min("norm_query").alias("norm_query"), *sums)


def waiting_queries(stats: DataFrame, n: int = 10) -> DataFrame:
    return stats.where("acquired_count + waiting_count > 0").orderBy(F.desc("total_wait_ms"), "query_id").limit(n)


def acquired_queries(stats: DataFrame, n: int = 10) -> DataFrame:
    return stats.where("acquired_count > 0").withColumn("avg_ms", F.col("acquired_ms") / F.col("acquired_count")).orderBy(F.desc("acquired_ms"), "query_id").limit(n)


def still_waiting_queries(stats: DataFrame, n: int = 10) -> DataFrame:
    return stats.where("waiting_count > 0").orderBy(F.desc("waiting_ms"), "query_id").limit(n)


def frequent_waiters(stats: DataFrame, n: int = 10) -> DataFrame:
    return stats.withColumn("locks", F.col("acquired_count") + F.col("waiting_count")).orderBy(F.desc("locks"), "query_id").limit(n)


def blockers(waits: DataFrame) -> DataFrame:
    """Per blocking query: waits, time and mean; deadlocks are left out. Each different text is normalised once."""
    x = waits.where("event_type = 'waiting' and blocking_query is not null").groupBy("blocking_query").agg(count_rows().alias("blocked"), F.sum("wait_ms").alias("total_ms"))
    return A.with_query_id(x, "blocking_query").groupBy("query_id").agg(F.sum("blocked").alias("blocked"), F.sum("total_ms").alias("total_ms"), (F.sum("total_ms") / F.sum("blocked")).alias("avg_ms"))


def checkpoint_stats(done: DataFrame, span: DataFrame | None = None) -> DataFrame:
    """Counts and sums over completed checkpoints, with WAL and flush rates (bytes per second of log and of writing)."""
    pos = lambda c: F.when(F.col(c) > 0, F.col(c))
    out = done.agg(
        count_rows().alias("count"), F.coalesce(F.sum(pos("write_s")), F.lit(0.0)).alias("write_s"), F.coalesce(F.max(pos("write_s")), F.lit(0.0)).alias("max_write_s"),
        F.coalesce(F.sum(pos("buffers")), F.lit(0)).alias("buffers"), F.coalesce(F.sum("distance_kb"), F.lit(0)).alias("distance_kb"), F.coalesce(F.max("distance_kb"), F.lit(0)).alias("max_distance_kb"),
    )
    out = out.withColumn("flush_rate", F.try_divide(F.col("buffers") * float(PAGE_BYTES), "write_s"))
    if span is not None:
        out = out.crossJoin(F.broadcast(span)).withColumn("wal_rate", F.try_divide(F.col("distance_kb") * 1024.0 * 1_000_000, "span_us")).drop("span_us")
    return out


def checkpoint_types(done: DataFrame, span: DataFrame | None = None) -> DataFrame:
    g = done.groupBy("kind").agg(count_rows().alias("count")).withColumn("percent", 100.0 * F.col("count") / F.sum("count").over(everything()))
    return g if span is None else g.crossJoin(F.broadcast(span)).withColumn("per_hour", F.try_divide(F.col("count") * 3_600_000_000.0, "span_us")).drop("span_us")


def wal_series(done: DataFrame) -> DataFrame:
    z = F.lit(0).cast("long")
    return done.where("distance_kb is not null or estimate_kb is not null").select("ts", F.coalesce("distance_kb", z).alias("distance_kb"), F.coalesce("estimate_kb", z).alias("estimate_kb"))


def checkpoint_hist(done: DataFrame) -> DataFrame:
    """Checkpoints in six parts of the day, all days together."""
    return done.groupBy(F.floor(F.hour("ts") / 4).cast("int").alias("bucket_index")).agg(count_rows().alias("count"))


def wal_hist(done: DataFrame) -> DataFrame:
    return wal_series(done).groupBy(F.floor(F.hour("ts") / 4).cast("int").alias("bucket_index")).agg((F.avg("distance_kb") / 1024).alias("distance_mb"), (F.avg("estimate_kb") / 1024).alias("estimate_mb"))


def warning_stats(w: DataFrame) -> DataFrame:
    return w.agg(count_rows().alias("count"), F.min("interval_s").alias("min_s"), F.max("interval_s").alias("max_s"))


def vacuum(m: DataFrame) -> DataFrame:
    return m.where("op = 'vacuum'").groupBy("table").agg(count_rows().alias("count"), F.sum(F.when(F.col("pages_removed") > 0, F.col("pages_removed") * PAGE_BYTES).otherwise(0)).alias("bytes"))


def analyze(m: DataFrame) -> DataFrame:
    return m.where("op = 'analyze'").groupBy("table").agg(count_rows().alias("count"))


def head_of_total(counts: DataFrame, name: str = "table", share: float = 0.8, n: int = 10) -> DataFrame:
    """The rows that make up a share of the whole, the one that crosses it included, n at most."""
    w = Window.orderBy(F.desc("count"), name)
    c = counts.withColumns({"rn": F.row_number().over(w), "before": F.coalesce(F.sum("count").over(w.rowsBetween(*A.BEFORE)), F.lit(0)), "whole": F.sum("count").over(everything())})
    return c.where((F.col("rn") <= n) & (F.col("before") < share * F.col("whole"))).drop("before", "whole")


def entity_counts(entities: DataFrame, kind: str) -> DataFrame:
    return entities.where(F.col(kind).isNotNull()).groupBy(kind).agg(count_rows().alias("count"))


def entity_pairs(entities: DataFrame, a: str, b: str) -> DataFrame:
    return entities.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).agg(count_rows().alias("count"))


def entity_top(counts: DataFrame, kind: str, n: int | None = 10) -> DataFrame:
    out = counts.orderBy(F.desc("count"), kind)
    return out if n is None else out.limit(n)
