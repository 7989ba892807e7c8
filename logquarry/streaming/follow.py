"""Following logs: a report that is made anew at an interval, and incremental statistics of a stream."""

from __future__ import annotations

import os
import tempfile
import threading
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logquarry.functions import sql as Q
from logquarry.operators import facts
from logquarry.operators.filters import Filters, TimeRange
from logquarry.render.formats import FORMATS
from logquarry.sources import dialects


def write_whole(path: str, text: str) -> None:
    """Replace a file at once, so a reader never sees half a report."""
    folder = os.path.dirname(os.path.abspath(path))
    with tempfile.NamedTemporaryFile("w", dir=folder, delete=False, encoding="utf-8") as f:
        f.write(text)
    os.replace(f.name, path)


def follow(spark: SparkSession, inputs: list[str], interval: float = 30.0, output: str | None = None, last: str = "24h", fmt: str = "text", stop: threading.Event | None = None, cycles: int | None = None, now: Callable | None = None, **how) -> int:
    """A report of the last hours of the inputs every interval seconds, until stop is set or the cycles are done. Returns the cycles."""
    from logquarry.report import build
    from logquarry.sources.inputs import read_entries

    stop, n = stop or threading.Event(), 0
    while not stop.is_set() and (cycles is None or n < cycles):
        try:
            entries = Filters(TimeRange(last=last, now=now() if now else None)).apply(read_entries(spark, inputs))
            text = FORMATS[fmt](build(entries, **how))
        except ValueError as e:  # nothing in the window yet
            text = f"{e}\n"
        write_whole(output, text) if output else print(text)
        n += 1
        if cycles is None or n < cycles:
            stop.wait(interval)
    return n


def stream_lines(spark: SparkSession, folder: str, year: int | None = None) -> DataFrame:
    """Entries of one line each from text files that appear in a folder: ts, message, pid, as a stream."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    lines = spark.readStream.format("text").load(folder)
    p = lines.select(dialects.parse_line(F.col("value"), year).alias("p")).where("p.ts is not null")
    from logquarry.functions.text import pid

    return p.select(F.col("p.ts").alias("ts"), F.col("p.message").alias("message"), F.coalesce("p.pid", pid(F.col("p.message"))).alias("pid"))


def stream_query_stats(entries: DataFrame, window: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Per window and normalised query: count, total and longest; late rows up to the watermark are counted."""
    m = F.col("message")
    x = entries.where(m.contains("duration:")).withColumn("q", Q.executed_query(m)).where("q is not null")
    x = x.select("ts", Q.duration_ms(m).alias("duration_ms"), Q.normalize_query(Q.normalize_ws(F.col("q"))).alias("norm_query"))
    return x.withWatermark("ts", late).groupBy(F.window("ts", window), "norm_query").agg(F.count(F.lit(1)).alias("count"), F.sum("duration_ms").alias("total_ms"), F.max("duration_ms").alias("max_ms"))


def stream_severities(entries: DataFrame, window: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    from logquarry.functions.events import severity

    x = entries.select("ts", severity(F.col("message")).alias("severity")).where("severity is not null")
    return x.withWatermark("ts", late).groupBy(F.window("ts", window), "severity").agg(F.count(F.lit(1)).alias("count"))


def stream_report(entries: DataFrame, folder: str, checkpoint: str):
    """Window statistics appended to a folder as they close; returns the query."""
    Path(folder).mkdir(parents=True, exist_ok=True)
    return stream_query_stats(entries).writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append").start()


__all__ = ["facts", "follow", "stream_lines", "stream_query_stats", "stream_report", "stream_severities", "write_whole"]
