"""Sections of a report as one tree of plain values.

Fact tables are lazy; only those that a requested section needs are computed, each section collects
aggregated rows, and event lists (one row for each execution, file, wait) are collected only with
``events=True``.
"""

from __future__ import annotations

from datetime import datetime
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logquarry.constants import SECTIONS
from logquarry.functions.events import class_description
from logquarry.operators import associate as A
from logquarry.operators import facts
from logquarry.operators.stage import staged
from logquarry.plans import server, sql
from logquarry.render.units import rate, size, span_us, time_ms

DEFAULT = [s for s in SECTIONS if s not in ("errors", "sql_overview")]


def choose_sections(names: list[str] | None, full: bool = False) -> list[str]:
    """Known sections in report order; ``all`` or full=True takes every one."""
    if full or names and "all" in names:
        return SECTIONS
    if not names:
        return DEFAULT
    if bad := set(names) - set(SECTIONS):
        raise ValueError(f"unknown sections: {', '.join(sorted(bad))}")
    return [s for s in SECTIONS if s in names]


def _ts(t: datetime | None) -> str:
    return t.strftime("%Y-%m-%d %H:%M:%S") if t else ""


class Report:
    """The fact tables of one set of entries, which are written once, and its sections."""

    def __init__(self, entries: DataFrame, events: bool = False, top: int | None = None):
        self.entries, self.events, self.top = staged(entries), events, top

    @cached_property
    def span(self):
        return server.summary(self.entries).first()

    @cached_property
    def executions(self) -> DataFrame:
        return A.plan_of_execution(facts.executions(self.entries), facts.plans(self.entries))

    @cached_property
    def stats(self) -> DataFrame:
        return sql.query_stats(self.executions)

    @cached_property
    def temps(self) -> DataFrame:
        return A.temp_file_query(facts.temp_events(self.entries), facts.statements(self.entries))

    @cached_property
    def locks(self) -> DataFrame:
        return A.locks(facts.lock_messages(self.entries), facts.statements(self.entries))

    @cached_property
    def waits(self) -> DataFrame:
        return A.waits(facts.lock_messages(self.entries), facts.lock_details(self.entries), facts.deadlocks(self.entries), facts.statements(self.entries))

    @cached_property
    def event_table(self) -> DataFrame:
        return facts.events(self.entries)

    # --- sections ---

    def summary(self) -> dict:
        s = self.span
        counts = {r.severity: r["count"] for r in server.severities(self.event_table).collect()}
        own = {f"{k.lower()}_count": counts.get(k, 0) for k in ("ERROR", "FATAL", "PANIC", "WARNING", "LOG")}
        return {"start_date": _ts(s.first_ts), "end_date": _ts(s.last_ts), "duration": span_us(s.duration_us or 0), "total_logs": s.entries, "throughput": f"{s.entries_per_s or 0:.2f} entries/s", **own}

    def sql_performance(self) -> dict:
        t = sql.totals(self.executions).first()
        if not t["count"]:
            return {}
        head = {
            "total_query_duration": time_ms(t.sum_ms), "total_queries_parsed": t["count"], "total_unique_queries": t.unique_queries,
            "top_1_percent_slow_queries": sql.top_share(self.executions).first().slow_count, "query_max_duration": time_ms(t.max_ms), "query_min_duration": time_ms(t.min_ms),
            "query_median_duration": time_ms(sql.median(self.executions).first().median_ms), "query_99th_percentile": time_ms(sql.p99(self.executions).first().p99_ms),
            "duration_distribution": [{"bucket": r.bucket, "count": r["count"]} for r in sql.duration_hist(self.executions).orderBy("bucket_index").collect()],
            "load": [r.asDict() for r in sql.load_hist(self.executions).orderBy("bucket_index").collect()],
        }
        main, transactions = sql.split_transactions(self.stats)
        rank = lambda df: [{"id": r.query_id, "normalized_query": r.norm_query, "count": r["count"], "total_time": time_ms(r.total_ms), "avg_time": time_ms(r.avg_ms), "max_time": time_ms(r.max_ms)} for r in df.collect()]
        head |= {"slowest_queries": rank(sql.slowest(main, self.top or 10)), "most_frequent_queries": rank(sql.most_frequent(main, self.top or 15)), "most_time_consuming": rank(sql.time_consuming(main, self.top or 10)), "transactions": rank(transactions.orderBy(F.desc("count"), "norm_query"))}
        if self.events:
            head["executions"] = [{"timestamp": _ts(r.ts), "duration_ms": r.duration_ms, "query_id": r.query_id} for r in self.executions.orderBy("seq").toLocalIterator()]
            head["queries"] = [{"id": r.query_id, "normalized_query": r.norm_query, "raw_query": r.raw_query, "type": r.query_type, "count": r["count"], "total_time_ms": r.total_ms, "avg_time_ms": r.avg_ms, "max_time_ms": r.max_ms, **({"plan": r.plan} if r.plan else {})} for r in self.stats.orderBy("query_id").collect()]
        return head

    def sql_summary(self) -> dict:
        rows = self._categories()
        return {"categories": rows} if rows else {}

    def _categories(self) -> list[dict]:
        return [{"category": r.category, "count": r["count"], "percentage": round(r.percent, 2), "total_time": time_ms(r.total_ms)} for r in sql.category_stats(self.stats).orderBy(F.desc("count"), "category").collect()]

    def sql_overview(self) -> dict:
        types = sql.type_stats(self.stats).orderBy(F.desc("count"), "query_type").collect()
        total = sum(r["count"] for r in types)
        if not total:
            return {}
        from logquarry.constants import QUERY_CATEGORIES

        of = {t: c for c, names in QUERY_CATEGORIES.items() for t in names}
        out = {"total_queries": total, "categories": self._categories(), "types": [{"type": r.query_type, "category": of.get(r.query_type, "OTHER"), "count": r["count"], "percentage": round(100 * r["count"] / total, 2), "total_time": time_ms(r.total_ms), "avg_time": time_ms(r.avg_ms), "max_time": time_ms(r.max_ms)} for r in types]}
        tree: dict[str, dict[str, list]] = {}
        for r in sql.by_dimension(self.executions).orderBy(F.desc("count"), "value", "query_type").collect():
            tree.setdefault(r.dimension, {}).setdefault(r.value, []).append(r)
        for key, name in (("db", "by_database"), ("user", "by_user"), ("host", "by_host"), ("app", "by_app")):
            if key in tree:
                rows = [{"name": v, "count": sum(r["count"] for r in rs), "total_time": time_ms(sum(r.total_ms for r in rs)), "query_types": [{"type": r.query_type, "count": r["count"], "total_time": time_ms(r.total_ms)} for r in rs]} for v, rs in tree[key].items()]
                out[name] = sorted(rows, key=lambda x: (-x["count"], x["name"]))
        return out

    def sql_detail(self, ids: list[str]) -> list[dict]:
        """One tree for each query id that any part of the log knows."""
        x = self.executions.where(F.col("query_id").isin(ids))
        rows = sql.detail(self.stats, server.temp_queries(self.temps), server.lock_queries(self.locks), ids).collect()
        more = {r.query_id: r for r in sql.detail_minmax(x).collect()}
        hist = {}
        for r in sql.duration_hist(x, keys=("query_id",)).collect():
            hist.setdefault(r.query_id, {})[r.bucket] = r["count"]
        full = {r.query_id: r for r in self.stats.where(F.col("query_id").isin(ids)).collect()}
        out = []
        for r in sorted(rows, key=lambda r: r.query_id):
            s, m = full.get(r.query_id), more.get(r.query_id)
            d = {"id": r.query_id, "normalized_query": r.norm_query}
            if s:
                d |= {"raw_query": s.raw_query, "type": s.query_type, "category": s.category, "statistics": {"count": s["count"], "total_time": time_ms(s.total_ms), "avg_time": time_ms(s.avg_ms), "max_time": time_ms(s.max_ms), "min_time": time_ms(m.min_ms), "median_time": time_ms(m.median_ms)}, "distribution": hist.get(r.query_id, {})}
                d |= {"plan": s.plan} if s.plan else {}
            if r.temp_count:
                d["temp_files"] = {"count": r.temp_count, "total_size": size(r.temp_bytes)}
            if r.total_wait_ms is not None:
                d["locks"] = {"acquired_count": r.acquired_count, "waiting_count": r.waiting_count, "total_wait_time": time_ms(r.total_wait_ms)}
            out.append(d)
        return out

    def event_section(self) -> dict:
        rows = server.severities(self.event_table).orderBy("rank").collect()
        top = server.top_events(self.event_table).collect()
        return {"events": [{"type": r.severity, "count": r["count"], "percentage": round(r.percent, 2)} for r in rows], "top_events": [{"message": r.pattern, "count": r["count"], "severity": r.severity, "example": r.example, **({"sql_state_class": r.sqlstate_class} if r.sqlstate_class else {})} for r in top]} if rows else {}

    def errors(self) -> list[dict]:
        p = server.event_patterns(self.event_table)
        rows = server.error_classes(p).orderBy("severity", F.desc("count")).collect()
        by = {}
        for r in p.withColumn("description", class_description(F.col("sqlstate_class"))).orderBy(F.desc("count"), "pattern").collect():
            by.setdefault((r.severity, r.sqlstate_class or ""), []).append({"message": r.pattern, "count": r["count"]})
        return [{"severity": r.severity, "class_code": r.sqlstate_class, "description": r.description, "count": r["count"], "percentage": round(r.percent, 2), "messages": by.get((r.severity, r.sqlstate_class), [])} for r in rows]

    def tempfiles(self) -> dict:
        t = server.temp_stats(self.temps).first()
        if not t["count"]:
            return {}
        q = server.top_temp_queries(server.temp_queries(self.temps), self.top or 10).collect()
        out = {"total_messages": t["count"], "total_size": size(t.total_size), "avg_size": size(t.avg_size), "queries": [{"id": r.query_id, "normalized_query": r.norm_query, "raw_query": r.raw_query, "count": r["count"], "total_size": size(r.total_size)} for r in q]}
        out["histogram"] = [r.asDict() for r in server.temp_hist(self.temps).orderBy("bucket_index").collect()]
        if self.events:
            named = A.with_query_id(self.temps).orderBy("seq").toLocalIterator()
            out["events"] = [{"timestamp": _ts(r.ts), "size": size(r.size), **({"query_id": r.query_id} if r.query else {})} for r in named]
        return out

    def locks_section(self) -> dict:
        t = server.lock_totals(facts.lock_messages(self.entries), facts.deadlocks(self.entries)).first()
        if not t.locks and not t.deadlocks:
            return {}
        names = lambda key: {r[key]: r["count"] for r in server.lock_dimension(self.locks, key).orderBy(F.desc("count"), key).collect()}
        q = server.lock_queries(self.locks)
        rows = server.waiting_queries(q, self.top or 10).collect()
        out = {"total_events": t.locks, "waiting_events": t.waiting, "acquired_events": t.acquired, "deadlock_events": t.deadlocks, "total_wait_time": time_ms(t.total_wait_ms), "avg_wait_time": time_ms(t.avg_wait_ms), "lock_type_stats": names("lock_type"), "resource_type_stats": names("resource_type"), "relation_stats": names("relation")}
        out["queries"] = [{"id": r.query_id, "normalized_query": r.norm_query, "acquired_count": r.acquired_count, "acquired_wait_time": time_ms(r.acquired_ms), "still_waiting_count": r.waiting_count, "still_waiting_time": time_ms(r.waiting_ms), "total_wait_time": time_ms(r.total_wait_ms)} for r in rows]
        out["blockers"] = [{"id": r.query_id, "blocked": r.blocked, "total_time": time_ms(r.total_ms), "avg_time": time_ms(r.avg_ms)} for r in server.blockers(self.waits).orderBy(F.desc("total_ms"), "query_id").limit(self.top or 10).collect()]
        return out

    def maintenance(self) -> dict:
        m = facts.maintenance(self.entries)
        v, a = server.vacuum(m).orderBy(F.desc("count"), "table").collect(), server.analyze(m).orderBy(F.desc("count"), "table").collect()
        if not v and not a:
            return {}
        return {"vacuum_count": sum(r["count"] for r in v), "analyze_count": sum(r["count"] for r in a), "vacuum_table_counts": {r.table: r["count"] for r in v}, "analyze_table_counts": {r.table: r["count"] for r in a}, "vacuum_space_recovered": {r.table: size(r.bytes) for r in v if r.bytes}}

    def checkpoints(self) -> dict:
        done = A.checkpoint_kinds(facts.checkpoints(self.entries))
        span = self.entries.agg((F.unix_micros(F.max("ts")) - F.unix_micros(F.min("ts"))).alias("span_us"))
        s = server.checkpoint_stats(done, span).first()
        w = server.warning_stats(facts.checkpoint_warnings(self.entries)).first()
        if not s["count"] and not w["count"]:
            return {}
        out = {"total_checkpoints": s["count"], "avg_checkpoint_time": f"{s.write_s / max(s['count'], 1):.2f} s", "max_checkpoint_time": f"{s.max_write_s:.2f} s", "total_buffers_written": s.buffers, "avg_wal_distance": size(s.distance_kb * 1024 // max(s["count"], 1)), "max_wal_distance": size(s.max_distance_kb * 1024)}
        out |= {"wal_rate": rate(s.wal_rate)} if s.wal_rate else {}
        out |= {"flush_rate": rate(s.flush_rate)} if s.flush_rate else {}
        out["types"] = {r.kind: {"count": r["count"], "percentage": round(r.percent, 2), "rate_per_hour": round(r.per_hour or 0, 2)} for r in server.checkpoint_types(done, span).orderBy(F.desc("count"), "kind").collect()}
        out["histogram"] = [r.asDict() for r in server.checkpoint_hist(done).orderBy("bucket_index").collect()]
        if w["count"]:
            out |= {"warning_count": w["count"], "warning_min_interval_seconds": w.min_s, "warning_max_interval_seconds": w.max_s}
        return out

    def connections(self) -> dict:
        c = facts.connection_events(self.entries)
        t = server.connection_totals(c).first()
        if not t.received and not t.disconnected:
            return {}
        s = facts.sessions(c)
        show = lambda r: {"count": r["count"], "min_duration": span_us(r.min_us), "max_duration": span_us(r.max_us), "avg_duration": span_us(r.avg_us), "median_duration": span_us(r.median_us), "cumulated_duration": span_us(r.sum_us)}
        hours = (self.span.duration_us or 0) / 3.6e9
        p, all_ = server.peak(c).first(), server.session_stats(s).first()
        out = {"connection_count": t.received, "avg_connections_per_hour": f"{t.received / hours if hours else 0:.2f}", "disconnection_count": t.disconnected, "avg_session_time": span_us(t.session_us / all_["count"] if all_["count"] else 0), "peak_concurrent_sessions": p.peak or 0, "peak_concurrent_timestamp": _ts(p.peak_ts)}
        if all_["count"]:
            out["session_stats"] = show(all_)
            out["session_distribution"] = {r.bucket: r["count"] for r in server.session_distribution(s).orderBy("bucket_index").collect()}
            for key, name in (("user", "sessions_by_user"), ("db", "sessions_by_database"), ("host", "sessions_by_host")):
                rows = server.session_by(s, key).orderBy(F.desc("count"), key)
                out[name] = {r[key]: show(r) for r in (rows if self.events else rows.limit(self.top or 10)).collect()}
            out["concurrency"] = [r.asDict() for r in server.concurrent_hist(s).orderBy("bucket_index").collect()]
        return out

    def clients(self) -> dict:
        e = facts.entities(self.entries)
        out: dict = {}
        for key, one, many in (("db", "unique_databases", "databases"), ("user", "unique_users", "users"), ("app", "unique_apps", "apps"), ("host", "unique_hosts", "hosts")):
            counts = server.entity_counts(e, key)
            out[one] = counts.count()
            out[many] = [{"name": r[key], "count": r["count"]} for r in server.entity_top(counts, key, None if self.events else self.top or 10).collect()]
        for a, b, name in (("user", "db", "user_database"), ("user", "host", "user_host")):
            rows = server.entity_pairs(e, a, b).orderBy(F.desc("count"), a, b)
            out[name] = [{"user": r[a], b: r[b], "count": r["count"]} for r in (rows if self.events else rows.limit(self.top or 10)).collect()]
        return out if any(out.values()) else {}


#: Section names that differ from the name of the table they are made of.
_SECTION_METHODS = {"events": Report.event_section, "locks": Report.locks_section}


def build(entries: DataFrame, sections: list[str] | None = None, full: bool = False, events: bool = False, top: int | None = None) -> dict:
    """The chosen sections of a report; an error if there are no entries."""
    r = Report(entries, events, top)
    if not r.span.entries:
        raise ValueError("no entries: nothing to report in this input and range")
    out = {}
    for name in choose_sections(sections, full):
        value = (_SECTION_METHODS.get(name) or getattr(Report, name))(r)
        if value:
            out[name] = value
    return out


def analyze(lines: DataFrame, filters=None, **how) -> dict:
    """A report of a table of lines (file_idx, split_start, line_no, line): the library's entry point."""
    from logquarry.operators.assemble import entries_from_lines

    entries = entries_from_lines(lines)
    return build(filters.apply(entries) if filters else entries, **how)
