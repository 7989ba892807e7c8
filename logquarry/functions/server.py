"""Values in messages of the server's own work: temporary files, locks, sessions, checkpoints, maintenance."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import after

_LOCK = r"process ([0-9]+).*?(still waiting for|acquired) (.*?) on (.*?) after ([0-9]+\.?[0-9]*|\.[0-9]+)"
#: Stands between the groups of a lock message.
_BETWEEN = "\x1f"


def temp_size(message: Column) -> Column:
    """Bytes: the digits after the first ``size``; 0 if there are none."""
    return F.coalesce(F.regexp_extract(after(message, "size"), r"^[^0-9]*([0-9]+)", 1).try_cast("long"), F.lit(0))


def lock_event(message: Column) -> Column:
    """A struct (event_type, pid, lock_type, resource, wait_ms); fields are null if the message is no lock message."""
    return lock_event_of(lock_parts(message))


def lock_parts(message: Column) -> Column:
    """The five groups of a lock message, as an array of strings; empty strings if it is none.

    One search gives all of them, put together with a character between that messages do not hold; for one that does, each is searched for.
    """
    one = F.regexp_replace(message, rf"^(?s:.*?){_LOCK}(?s:.*)$", _BETWEEN.join(f"${i}" for i in range(1, 6)))
    parts = F.split(one, _BETWEEN)
    each = F.array(*[F.regexp_extract(message, _LOCK, i) for i in range(1, 6)])
    return F.when(message.contains(_BETWEEN), each).when(one.contains(_BETWEEN), parts).otherwise(F.array(*[F.lit("")] * 5))


def lock_event_of(parts: Column) -> Column:
    """lock_event of its lock_parts."""
    part = lambda i: F.nullif(parts[i - 1], F.lit(""))
    return F.struct(
        F.when(part(2) == "acquired", "acquired").when(part(2).isNotNull(), "waiting").alias("event_type"),
        part(1).alias("pid"),
        part(3).alias("lock_type"),
        part(4).alias("resource"),
        part(5).try_cast("double").alias("wait_ms"),
    )


def resource_type(resource: Column) -> Column:
    """The kind of a locked resource: its known name, else its first word; below four characters unknown."""
    known = F.regexp_extract(resource, "^(relation|transaction|tuple|advisory lock|page|extend) ", 1)
    return F.when(F.length(resource) < 4, "unknown").when(known != "", known).when(F.locate(" ", resource) > 1, F.substring_index(resource, " ", 1)).otherwise(resource)


def blocking_pid(message: Column) -> Column:
    """The one process that holds a lock; empty for several or none."""
    return F.coalesce(F.regexp_extract(after(message, "Process holding the lock: "), r"^([0-9]+)\.", 1), F.lit(""))


def relation(message: Column) -> Column:
    return F.coalesce(F.regexp_extract(after(message, 'in relation "'), r'^([^"]+)"', 1), F.lit(""))


def session_us(message: Column) -> Column:
    """Microseconds of ``session time: H:MM:SS.mmm``; 0 if it is missing or out of range."""
    part = F.regexp_extract(after(message, "session time: "), r"^([^ ]*)", 1)
    get = lambda i, kind: F.regexp_extract(part, r"^([0-9]+):([0-9]+):([0-9]+(?:\.[0-9]+)?)$", i).try_cast(kind)
    h, m, s = get(1, "long"), get(2, "long"), get(3, "decimal(20,6)")
    return F.coalesce(F.when((m < 60) & (s < 60), h * 3_600_000_000 + m * 60_000_000 + (s * 1_000_000).cast("long")), F.lit(0).cast("long"))


def checkpoint_type(message: Column) -> Column:
    """What started a checkpoint; null for other messages."""
    return F.nullif(F.trim(after(message, "checkpoint starting:")), F.lit(""))


def _number(message: Column, before: str, unit: str, kind: str) -> Column:
    return F.regexp_extract(after(message, before), rf"^ *([0-9.]+){unit}", 1).try_cast(kind)


def checkpoint_fields(message: Column) -> Column:
    """A struct (write_s, buffers, distance_kb, estimate_kb) of a completed checkpoint; null where missing."""
    return F.struct(
        _number(message, "total=", " s", "double").alias("write_s"),
        _number(message, "wrote ", " buffers", "long").alias("buffers"),
        _number(message, "distance=", " kB", "long").alias("distance_kb"),
        _number(message, "estimate=", " kB", "long").alias("estimate_kb"),
    )


def warning_interval(message: Column) -> Column:
    return F.regexp_extract(after(message, "("), "^([0-9]+) second", 1).try_cast("int")


def vacuum_table(message: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(message, '"([^"]*)"', 1), F.lit("")), F.lit("UNKNOWN"))


def removed_pages(message: Column) -> Column:
    return F.coalesce(F.regexp_extract(after(message, "pages: "), "^([0-9]+) ", 1).try_cast("long"), F.lit(0))
