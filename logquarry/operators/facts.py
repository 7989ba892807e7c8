"""Entries to fact tables, one row per event of a kind. Cheap substring tests stand before any regular expression."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logquarry.functions import events as E
from logquarry.functions import server as V
from logquarry.functions import sql as Q
from logquarry.functions import text as T

from .stage import on_disk, staged

#: What a message holds that statements, temporary files or locks are told from.
WORK = ["temporary file", "STATEMENT:", "QUERY:", "statement:", "execute", "still waiting for ", "acquired ", "Process holding the lock: ", 'in relation "', "deadlock detected"]


def m():
    return F.col("message")


def work(entries: DataFrame) -> DataFrame:
    """seq, ts, message, pid of the entries that statements, temporary files and locks are told from; written once for the plans that read them, if they are not on disk yet."""
    kept = entries.select("seq", "ts", "message", "pid")
    return kept if on_disk(entries) else staged(kept.where(reduce(or_, [m().contains(x) for x in WORK])))


def work_items(*kinds: str) -> Callable[[DataFrame], DataFrame]:
    """A function from entries to seq, ts, pid and what they hold of the kinds (statement, temp, lock, detail, deadlock), in one pass.

    What it gives is read by statements_of, temps_of, lock_messages_of, lock_details_of and deadlocks_of.
    """

    def items(entries: DataFrame) -> DataFrame:
        # a search passes over the whole text: what is not of a kind is told by as few as there can be
        e = entries.select("seq", "ts", "message", "pid")
        columns, some = ["seq", "ts", "pid"], []
        if "statement" in kinds or "temp" in kinds:
            e = e.select("*", F.explode(F.array(Q.statement_text(m()))).alias("query"))
            e = e.withColumn("query", F.nullif(Q.normalize_ws(F.col("query")), F.lit("")))
            columns.append("query")
        if "statement" in kinds:
            some.append(F.col("query").isNotNull())
        if "temp" in kinds:
            e = e.withColumn("size", F.when(m().contains("temporary file") & m().contains("path"), V.temp_size(m())))
            columns.append("size")
            some.append(F.col("size").isNotNull())
        if "lock" in kinds:
            e = e.select("*", F.explode(F.array(F.when(is_lock(), V.lock_parts(m())))).alias("parts"))
            e = e.withColumns({"event": F.when(F.col("parts").isNotNull(), V.lock_event_of(F.col("parts"))), "r": F.when(F.col("parts").isNotNull(), V.relation(m())), "b": F.when(F.col("parts").isNotNull(), V.blocking_pid(m()))})
            columns += ["event", F.col("r").alias("relation"), F.col("b").alias("blocking_pid")]
            some.append(F.col("event.wait_ms").isNotNull())
        if "detail" in kinds:
            e = e.withColumn("detail", F.when(is_detail(), detail()))
            columns.append("detail")
            some.append(F.col("detail").isNotNull())
        if "deadlock" in kinds:
            e = e.withColumn("dead", is_deadlock())
            columns.append("dead")
            some.append(F.col("dead"))
        return e.where(reduce(or_, some)).select(*columns)

    return items


def executions(entries: DataFrame, memo: bool = False) -> DataFrame:
    """seq, ts, duration_ms, raw_query, norm_query, query_id, full_hash, query_type, category, pid, db, user, host, app.

    memo normalises each distinct text once and joins the result back: worth a shuffle where texts repeat a lot.
    """
    # the flag: statements of a split syslog message are no executions of their own
    e = entries.where(m().contains("duration:") & (m().contains("execute") | m().contains("statement")))
    e = e.withColumn("q", Q.executed_query(m())).where("q is not null").withColumn("duration_ms", Q.duration_ms(m()))
    e = e.select("seq", "ts", "duration_ms", Q.normalize_ws(F.col("q")).alias("raw_query"), "pid", *[T.prefix_field(m(), k).alias(k) for k in ("db", "user", "host", "app")])
    if memo:
        unique = identified(e.select("raw_query").distinct())
        return e.join(unique, "raw_query")
    return identified(e)


def identified(df: DataFrame, raw: str = "raw_query") -> DataFrame:
    """Adds norm_query, query_id, full_hash, query_type and category of a raw text."""
    df = df.withColumns({"norm_query": Q.normalize_query(F.col(raw)), "word_": Q.keyword(F.col(raw))})
    df = df.withColumn("full_hash", Q.full_hash(F.col("norm_query")))
    df = df.withColumns({"query_id": F.concat(Q.prefix_of_keyword(F.col("word_")), Q.short_hash(F.col("full_hash"))), "query_type": F.when(F.col("word_") != "", F.col("word_")).otherwise(F.when(F.col(raw).isNotNull(), "OTHER"))})
    return df.withColumn("category", Q.query_category(F.col("query_type"))).drop("word_")


def plans(entries: DataFrame) -> DataFrame:
    """seq, pid, plan of auto_explain messages."""
    return entries.where(m().contains("plan:") & Q.is_plan(m())).select("seq", "pid", Q.plan_text(m()).alias("plan"))


def statements(entries: DataFrame, lower: bool = True) -> DataFrame:
    """seq, pid, query: every message that carries a statement (upper-case markers alone if not lower)."""
    has = m().contains("STATEMENT:") | m().contains("QUERY:")
    if lower:
        has = has | m().contains("statement:") | (m().contains("duration:") & m().contains("execute"))
    # explode, inline (below): what is made of a message is not made again where it is used again
    text = entries.where(has).select("seq", "pid", F.explode(F.array(Q.statement_text(m()))).alias("query"))
    return text.select("seq", "pid", Q.normalize_ws(F.col("query")).alias("query")).where("query <> ''")


def statements_of(items: DataFrame) -> DataFrame:
    """statements of the entries that work_items are made of."""
    return items.where("query is not null").select("seq", "pid", "query")


def temp_events(entries: DataFrame, compat: bool = False) -> DataFrame:
    """seq, ts, size, pid, own_query of temporary files; in compat also of messages about them without a path."""
    e = entries.where(m().contains("temporary file") & (F.lit(True) if compat else m().contains("path")))
    e = e.select("seq", "ts", V.temp_size(m()).alias("size"), "pid", F.explode(F.array(Q.statement_text(m()))).alias("own_query"))
    return e.withColumn("own_query", Q.normalize_ws(F.col("own_query")))


def temps_of(items: DataFrame) -> DataFrame:
    """temp_events of the entries that work_items are made of; own_query is null, not empty, where there is none."""
    return items.where("size is not null").select("seq", "ts", "size", "pid", F.col("query").alias("own_query"))


def is_lock() -> Column:
    return m().contains("process ") & (m().contains("still waiting for ") | m().contains("acquired "))


def lock_messages(entries: DataFrame) -> DataFrame:
    """seq, ts, event_type, log_pid, pid, lock_type, resource, resource_type, wait_ms, lock_key, relation, blocking_pid."""
    e = entries.where(is_lock()).select("seq", "ts", "message", F.col("pid").alias("log_pid"), F.explode(F.array(V.lock_parts(m()))).alias("parts"))
    e = e.select("seq", "ts", "message", "log_pid", V.lock_event_of(F.col("parts")).alias("event"))
    return _lock_rows(e.select("seq", "ts", "log_pid", "event", V.relation(m()).alias("relation"), V.blocking_pid(m()).alias("blocking_pid")))


def _lock_rows(events: DataFrame) -> DataFrame:
    e = events.select("seq", "ts", "log_pid", "event.*", "relation", "blocking_pid").where("wait_ms is not null")
    return e.select(
        "seq", "ts", "event_type", "log_pid", "pid", "lock_type", "resource", V.resource_type(F.col("resource")).alias("resource_type"), "wait_ms",
        F.concat_ws("-", "pid", "lock_type", "resource").alias("lock_key"), "relation", "blocking_pid",
    )


def lock_messages_of(items: DataFrame) -> DataFrame:
    """lock_messages of the entries that work_items are made of."""
    return _lock_rows(items.withColumnRenamed("pid", "log_pid"))


def lock_details(entries: DataFrame) -> DataFrame:
    """seq, pid, blocking_pid, relation of DETAIL and CONTEXT lines about a wait."""
    return _detail_rows(entries.where(is_detail()).select("seq", "pid", F.explode(F.array(detail())).alias("detail")))


def is_detail() -> Column:
    return (m().contains("Process holding the lock: ") | m().contains('in relation "')) & ~m().contains("still waiting for ") & ~m().contains("acquired ")


def detail() -> Column:
    return F.struct(V.blocking_pid(m()).alias("blocking_pid"), V.relation(m()).alias("relation"))


def _detail_rows(details: DataFrame) -> DataFrame:
    return details.select("seq", "pid", "detail.*").where("pid <> '' and (blocking_pid <> '' or relation <> '')")


def lock_details_of(items: DataFrame) -> DataFrame:
    """lock_details of the entries that work_items are made of."""
    return _detail_rows(items.where("detail is not null"))


def is_deadlock() -> Column:
    return m().contains("deadlock detected") & m().contains("ERROR:")


def deadlocks(entries: DataFrame) -> DataFrame:
    return entries.where(is_deadlock()).select("seq", "ts", "pid")


def deadlocks_of(items: DataFrame) -> DataFrame:
    """deadlocks of the entries that work_items are made of."""
    return items.where("dead").select("seq", "ts", "pid")


def connection_events(entries: DataFrame) -> DataFrame:
    """seq, ts, pid, kind (received, disconnected), dur_us and entities of a disconnection."""
    e = entries.where(m().contains("connection") & (F.length(m()) >= 12))
    at = F.locate("connection", m())
    gone = (at > 3) & (F.substring(m(), at - 3, F.lit(3)) == "dis")
    kind = F.when(gone, "disconnected").when(F.substring(m(), at, F.lit(19)) == "connection received", "received")
    return e.select("seq", "ts", "pid", kind.alias("kind"), F.when(gone, V.session_us(m())).alias("dur_us"), *[F.when(gone, T.session_entity(m(), k)).alias(k) for k in ("user", "db", "host")]).where("kind is not null")


def sessions(connections: DataFrame) -> DataFrame:
    """start_ts, end_ts, dur_us, user, db, host of sessions with a time."""
    s = connections.where("kind = 'disconnected' and dur_us > 0")
    return s.select("seq", F.timestamp_micros(F.unix_micros("ts") - F.col("dur_us")).alias("start_ts"), F.col("ts").alias("end_ts"), "dur_us", "user", "db", "host")


def checkpoints(entries: DataFrame) -> DataFrame:
    """seq, ts, start_type (of a start), done, write_s, buffers, distance_kb, estimate_kb."""
    e = entries.where(m().contains("checkpoint starting:") | m().contains("checkpoint complete"))
    return e.select("seq", "ts", V.checkpoint_type(m()).alias("start_type"), m().contains("checkpoint complete").alias("done"), V.checkpoint_fields(m()).alias("f")).select("seq", "ts", "start_type", "done", "f.*")


def checkpoint_warnings(entries: DataFrame) -> DataFrame:
    e = entries.where(m().contains("checkpoints are occurring too frequently"))
    return e.select("seq", "ts", V.warning_interval(m()).alias("interval_s")).where("interval_s is not null")


def maintenance(entries: DataFrame) -> DataFrame:
    """seq, ts, op (vacuum, analyze), table, pages_removed of automatic runs."""
    e = entries.where(m().contains("automatic") & (F.length(m()) >= 18))
    op = F.regexp_extract(T.after(m(), "automatic "), "^(?:aggressive )?(vacuum|analyze)", 1)
    return e.select("seq", "ts", op.alias("op"), V.vacuum_table(m()).alias("table"), V.removed_pages(m()).alias("pages_removed")).where("op <> ''")


def events(entries: DataFrame, compat: bool = True) -> DataFrame:
    """seq, ts, severity, pattern, sqlstate, sqlstate_class, message of classified entries; a pattern for warnings and worse."""
    e = entries.where("not is_continuation").withColumn("severity", E.severity(m(), compat)).where("severity is not null")
    code = E.sqlstate(m())
    pattern = F.when(F.col("severity").isin("PANIC", "FATAL", "ERROR", "WARNING"), E.normalize_event(m()))
    return e.select("seq", "ts", "severity", F.nullif(pattern, F.lit("")).alias("pattern"), code.alias("sqlstate"), E.sqlstate_class(code).alias("sqlstate_class"), "message")


def entities(entries: DataFrame) -> DataFrame:
    """seq and user, db, host, app of entries that name any."""
    e = entries.where("not is_continuation").where(m().contains("="))
    return e.select("seq", *[F.nullif(T.entity(m(), k), F.lit("")).alias(k) for k in ("user", "db", "host", "app")])
