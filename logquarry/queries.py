"""Registered queries of the log engine and the SQL that checks them.

Each query renders log lines from the tables, reads them back through the engine, and reports. The
SQL never sees a log line: it computes the answer from the base columns.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logquarry import samples
from logquarry.functions import events as E
from logquarry.functions import sql as Q
from logquarry.functions import text as T
from logquarry.operators import associate as A
from logquarry.operators import facts
from logquarry.operators.assemble import entries_from_lines
from logquarry.operators.filters import Filters, TimeRange
from logquarry.plans import bins, server, sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def m():
    return F.col("message")



def _plain(df: DataFrame) -> DataFrame:
    """Result columns as the SQL has them: doubles to three places, timestamps without a zone, whole numbers as long."""
    kinds = {"double": lambda c: F.round(c, 3), "timestamp": lambda c: F.col(c).cast("timestamp_ntz"), "int": lambda c: F.col(c).cast("long")}
    return df.select(*[(kinds[k](c).alias(c) if k in kinds else F.col(c)) for c, k in df.dtypes])


def _register(name: str, plan: Callable[[DataFrame], DataFrame], log: Callable, oracle: str | None, items: Callable[[DataFrame], DataFrame] | None = None) -> None:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        return _plain(plan(entries_from_lines(log(spark, sf_dir), items=items)))

    query.__name__ = name
    QUERIES[name] = query
    if oracle:
        ORACLE_SQL[name] = oracle


# --- statements -----------------------------------------------------------------------------------

_X = """
    WITH x0 AS (
        SELECT event_id, ts, user_id, value AS ms, 'db' || user_id % 4 AS db, 'u' || user_id % 10 AS usr, '10.0.0.' || user_id % 5 AS host, 'svc' || user_id % 3 AS app,
               (user_id + 1000)::VARCHAR AS pid,
               CASE event_type
                   WHEN 'click' THEN 'select * from clicks where id = ? and name = ?' || CASE WHEN event_id % 5 = 0 THEN ' order by ?' ELSE '' END
                   WHEN 'view' THEN 'select count(*) from view_' || user_id % 2 || ' where x in (?, ?)'
                   WHEN 'signup' THEN 'insert into signups values (?, ?, ?)'
                   ELSE CASE WHEN user_id % 2 = 0 THEN '/* c */ update purchases set total = ? where user_id = ?' ELSE 'commit' END END AS norm,
               CASE event_type WHEN 'click' THEN 'SELECT' WHEN 'view' THEN 'SELECT' WHEN 'signup' THEN 'INSERT'
                   ELSE CASE WHEN user_id % 2 = 0 THEN 'UPDATE' ELSE 'COMMIT' END END AS kind,
               CASE event_type
                   WHEN 'click' THEN 'SELECT * FROM clicks WHERE id = ' || event_id || ' AND name = ''n''''' || user_id || '''' || CASE WHEN event_id % 5 = 0 THEN ' ORDER BY 1' ELSE '' END
                   WHEN 'view' THEN 'select count(*) from view_' || user_id % 2 || ' where x in (' || user_id || ', ' || event_id || ')'
                   WHEN 'signup' THEN 'INSERT INTO signups VALUES (' || event_id || ', ''a b'', ' || printf('%.3f', value) || ')'
                   ELSE CASE WHEN user_id % 2 = 0 THEN '/* c */ UPDATE purchases SET total = ' || printf('%.3f', value) || ' WHERE user_id = $1' ELSE 'COMMIT' END END AS raw
        FROM events WHERE event_type <> 'error'
    ), x AS (
        SELECT *, CASE kind WHEN 'COMMIT' THEN 'TCL' ELSE 'DML' END AS cat, md5(norm) AS hash,
               CASE kind WHEN 'SELECT' THEN 'se-' WHEN 'INSERT' THEN 'in-' WHEN 'UPDATE' THEN 'up-' ELSE 'ct-' END
               || substr(regexp_replace(base64(unhex(md5(norm))), '[+/=]', '', 'g'), 1, 6) AS id
        FROM x0
    ), stats AS (
        SELECT norm, min(id) AS id, min(hash) AS hash, min(kind) AS kind, min(cat) AS cat, count(*) AS n, sum(ms) AS total, avg(ms) AS mean, max(ms) AS longest, min(raw) AS raw FROM x GROUP BY norm
    )
"""


def _x(name: str, plan: Callable[[DataFrame], DataFrame], oracle: str | None) -> None:
    _register(name, lambda e: plan(facts.executions(e)), samples.sql_log, oracle and _X + oracle)


def _stats(name: str, plan: Callable[[DataFrame], DataFrame], oracle: str) -> None:
    _x(name, lambda x: plan(sql.query_stats(x)), oracle)


_STATS_COLUMNS = ["norm_query", "query_id", "full_hash", "query_type", "category", "count", "total_ms", "avg_ms", "max_ms", "raw_query"]
_STATS_SELECT = "SELECT norm AS norm_query, id AS query_id, hash AS full_hash, kind AS query_type, cat AS category, n AS count, round(total, 3) AS total_ms, round(mean, 3) AS avg_ms, round(longest, 3) AS max_ms, raw AS raw_query FROM stats"
_x("duration_query", lambda x: x.select("ts", "duration_ms", "raw_query", "pid"), "SELECT ts, round(ms, 3) AS duration_ms, raw AS raw_query, pid FROM x")
_x("normalize_query", lambda x: x.select("ts", "norm_query"), "SELECT ts, norm AS norm_query FROM x")
_x("query_id", lambda x: x.select("ts", "query_id", "full_hash"), "SELECT ts, id AS query_id, hash AS full_hash FROM x")
_x("query_type", lambda x: x.select("ts", "query_type", "category", Q.query_type_from_id(F.col("query_id")).alias("id_type")), "SELECT ts, kind AS query_type, cat AS category, kind AS id_type FROM x")
_x("query_prefix", lambda x: x.select("ts", Q.query_prefix(F.col("raw_query")).alias("prefix")), "SELECT ts, id[1:3] AS prefix FROM x")
_x("normalize_ws", lambda x: x.groupBy(F.length(Q.normalize_ws(F.col("raw_query"))).alias("n")).agg(sql.count_rows().alias("count")), "SELECT len(raw) AS n, count(*) AS count FROM x GROUP BY 1")
_x("truncate_query", lambda x: x.select("ts", T.truncate(F.col("raw_query"), 30).alias("short")), "SELECT ts, CASE WHEN len(raw) > 30 THEN raw[1:27] || '...' ELSE raw END AS short FROM x")
_x("prefix_fields", lambda x: x.select("ts", "db", "user", "host", "app"), 'SELECT ts, db, usr AS "user", host, app FROM x')
_x("sql_global", sql.totals, "SELECT count(*) AS count, count(DISTINCT norm) AS unique_queries, min(ms) AS min_ms, max(ms) AS max_ms, round(sum(ms), 3) AS sum_ms, min(ts) AS first_ts, max(ts) AS last_ts FROM x")
_x("sql_median", sql.median, "SELECT round(quantile_cont(ms, 0.5), 3) AS median_ms FROM x")
_P99 = ", p AS (SELECT ms AS p99 FROM (SELECT ms, row_number() OVER (ORDER BY ms) - 1 AS i, count(*) OVER () AS n FROM x) WHERE i = least(floor(0.99 * n), n - 1))"
_x("sql_p99", sql.p99, _P99 + " SELECT round(p99, 3) AS p99_ms FROM p")
_x("top1pct", sql.top_share, _P99 + " SELECT count(*) AS slow_count FROM x, p WHERE ms >= p99")
_stats("query_stats", lambda s: s, _STATS_SELECT)
_stats("type_stats", sql.type_stats, "SELECT kind AS query_type, count(*) AS unique_queries, sum(n)::BIGINT AS count, round(sum(total), 3) AS total_ms, round(sum(total) / sum(n), 3) AS avg_ms, max(longest) AS max_ms FROM stats GROUP BY 1")
_stats("category_stats", sql.category_stats, "SELECT cat AS category, sum(n)::BIGINT AS count, round(sum(total), 3) AS total_ms, round(100.0 * sum(n) / sum(sum(n)) OVER (), 3) AS percent FROM stats GROUP BY 1")
_DIMS = ", d AS (SELECT 'db' AS dimension, db AS value, kind, ms FROM x UNION ALL SELECT 'user', usr, kind, ms FROM x UNION ALL SELECT 'host', host, kind, ms FROM x UNION ALL SELECT 'app', app, kind, ms FROM x)"
_x("type_by_dimension", sql.by_dimension, _DIMS + " SELECT dimension, value, kind AS query_type, count(*) AS count, round(sum(ms), 3) AS total_ms FROM d GROUP BY 1, 2, 3")
_x("dimension_totals", lambda x: sql.dimension_totals(sql.by_dimension(x)), _DIMS + " SELECT dimension, value, count(*) AS count, round(sum(ms), 3) AS total_ms FROM d GROUP BY 1, 2")
_stats("slowest", lambda s: sql.slowest(s, 3), _STATS_SELECT + " ORDER BY longest DESC, norm LIMIT 3")
_stats("most_frequent", lambda s: sql.most_frequent(s, 4), _STATS_SELECT + " WHERE n > 1 ORDER BY n DESC, norm LIMIT 4")
_stats("time_consuming", lambda s: sql.time_consuming(s, 3), _STATS_SELECT + " ORDER BY total DESC, norm LIMIT 3")
_stats("tcl_split", lambda s: sql.split_transactions(s)[1], _STATS_SELECT + " WHERE cat = 'TCL'")
_stats("tcl_by_type", sql.transactions_by_type, "SELECT kind AS query_type, sum(n)::BIGINT AS count, round(sum(total), 3) AS total_ms FROM stats WHERE cat = 'TCL' GROUP BY 1")
_BUCKET = "least(((epoch_us(ts) - lo) // greatest((hi - lo) // {n}, 1)), {n} - 1)"
_SPAN = ", s AS (SELECT min(epoch_us(ts)) AS lo, max(epoch_us(ts)) AS hi FROM x)"
_x("load_hist", sql.load_hist, _SPAN + f" SELECT {_BUCKET.format(n=6)} AS bucket_index, sum(floor(ms))::BIGINT AS load_ms, count(*) AS count FROM x, s GROUP BY 1")
_x("hist24", lambda x: sql.load_hist(x, 24), _SPAN + f" SELECT {_BUCKET.format(n=24)} AS bucket_index, sum(floor(ms))::BIGINT AS load_ms, count(*) AS count FROM x, s GROUP BY 1")
_LABEL = "CASE WHEN {v} < 1 THEN 0 WHEN {v} < 10 THEN 1 WHEN {v} < 100 THEN 2 WHEN {v} < 1000 THEN 3 WHEN {v} < 10000 THEN 4 ELSE 5 END"
_NAMES = "['< 1 ms', '< 10 ms', '< 100 ms', '< 1 s', '< 10 s', '>= 10 s']"
_x("duration_hist", sql.duration_hist, f" SELECT i::BIGINT AS bucket_index, {_NAMES}[i + 1] AS bucket, count(ms) AS count FROM range(6) r(i) LEFT JOIN x ON {_LABEL.format(v='ms')} = i GROUP BY i")
_stats("dist_by_avg", lambda s: sql.duration_hist(s, weight="count", value="avg_ms"), f" SELECT i::BIGINT AS bucket_index, {_NAMES}[i + 1] AS bucket, coalesce(sum(n), 0)::BIGINT AS count FROM range(6) r(i) LEFT JOIN stats ON {_LABEL.format(v='mean')} = i GROUP BY i")
_KSPAN = ", s AS (SELECT id AS sid, min(epoch_us(ts)) AS lo, max(epoch_us(ts)) AS hi FROM x GROUP BY 1)"
_x("q_exec_hist", lambda x: sql.load_hist(x, 6, ("query_id",)), _KSPAN + f" SELECT id AS query_id, {_BUCKET.format(n=6)} AS bucket_index, sum(floor(ms))::BIGINT AS load_ms, count(*) AS count FROM x JOIN s ON id = sid GROUP BY 1, 2")
_x("q_duration_dist", lambda x: sql.duration_hist(x, keys=("query_id",)), f" SELECT id AS query_id, {_NAMES}[{_LABEL.format(v='ms')} + 1] AS bucket, count(*) AS count FROM x GROUP BY 1, 2")
_x("detail_minmax", sql.detail_minmax, " SELECT id AS query_id, count(*) AS count, min(ms) AS min_ms, max(ms) AS max_ms, round(quantile_cont(ms, 0.5), 3) AS median_ms FROM x GROUP BY 1")

# --- entries, filters, events, clients ---------------------------------------------------------------

_HEAD = "'[' || (user_id + 1000) || ']: db=db' || user_id % 4 || ',user=u' || user_id % 10 || ',app=svc' || user_id % 3 || ',client=10.0.0.' || user_id % 5 || ' '"
_E = f"""
    , er AS (
        SELECT event_id, ts, user_id, CASE WHEN user_id % 3 = 0 THEN 'FATAL' ELSE 'ERROR' END AS sev, CASE WHEN user_id % 2 = 0 THEN '42P01' ELSE '23505' END AS code,
               CASE WHEN user_id % 2 = 0 THEN 'relation ? does not exist' ELSE 'duplicate key value violates unique constraint ?' END AS pattern,
               CASE WHEN user_id % 2 = 0 THEN 'relation "t' || user_id || '" does not exist at character ' || event_id ELSE 'duplicate key value violates unique constraint "k' || user_id || '"' END AS txt
        FROM events WHERE event_type = 'error'
    ), entries AS (
        SELECT ts, {_HEAD} || 'LOG:  duration: ' || printf('%.3f', ms) || ' ms  ' || CASE WHEN event_id % 2 = 0 THEN 'statement: ' ELSE 'execute s1: ' END
               || replace(raw, 'select count', 'select  count') AS message, false AS is_continuation, user_id, event_id, 0 AS k, 'LOG' AS sev FROM x
        UNION ALL SELECT ts, {_HEAD} || sev || ':  ' || txt || ' SQLSTATE = ''' || code || '''', false, user_id, event_id, 2, sev FROM er
        UNION ALL SELECT ts, {_HEAD} || 'STATEMENT:  SELECT ' || event_id, true, user_id, event_id, 3, NULL FROM er
    )
"""


def _e(name: str, plan: Callable[[DataFrame], DataFrame], oracle: str | None) -> None:
    _register(name, plan, samples.sql_log, oracle and _X + _E + oracle)


_ENTRY = "SELECT ts, message, is_continuation, (user_id + 1000)::VARCHAR AS pid FROM entries"
_show = lambda e: e.select("ts", "message", "is_continuation", "pid")
_e("entry_assembly", _show, _ENTRY)
_e("extract_pid", lambda e: e.groupBy(T.pid(m()).alias("pid")).agg(sql.count_rows().alias("count")), "SELECT (user_id + 1000)::VARCHAR AS pid, count(*) AS count FROM entries GROUP BY 1")
_e("filter_value", lambda e: e.groupBy(*[T.filter_value(m(), k).alias(k) for k in ("db", "user", "app")]).agg(sql.count_rows().alias("count")), "SELECT 'db' || user_id % 4 AS db, 'u' || user_id % 10 AS \"user\", 'svc' || user_id % 3 AS app, count(*) AS count FROM entries GROUP BY ALL")
_e("time_filter", lambda e: _show(Filters(TimeRange("2024-01-05 00:00:00", "2024-01-08 12:00:00")).apply(e)), _ENTRY + " WHERE ts BETWEEN '2024-01-05' AND '2024-01-08 12:00:00'")
_e("window_filter", lambda e: _show(Filters(TimeRange(begin="2024-01-05 00:00:00", window="2d12h")).apply(e)), _ENTRY + " WHERE ts BETWEEN '2024-01-05' AND '2024-01-07 12:00:00'")
_e("end_window_filter", lambda e: _show(Filters(TimeRange(end="2024-01-08 12:00:00", window="36h")).apply(e)), _ENTRY + " WHERE ts BETWEEN '2024-01-07' AND '2024-01-08 12:00:00'")
_e("last_filter", lambda e: _show(Filters(TimeRange(last="1d12h", now=datetime(2024, 1, 20, 6))).apply(e)), _ENTRY + " WHERE ts BETWEEN '2024-01-18 18:00:00' AND '2024-01-20 06:00:00'")
_e("db_filter", lambda e: _show(Filters(db=["db1", "db3"]).apply(e)), _ENTRY + " WHERE user_id % 4 IN (1, 3)")
_e("user_filter", lambda e: _show(Filters(user=["u2"]).apply(e)), _ENTRY + " WHERE user_id % 10 = 2")
_e("exclude_user", lambda e: _show(Filters(exclude_user=["u2", "u3"]).apply(e)), _ENTRY + " WHERE user_id % 10 NOT IN (2, 3)")
_e("app_filter", lambda e: _show(Filters(app=["svc1"]).apply(e)), _ENTRY + " WHERE user_id % 3 = 1")
_e("grep_filter", lambda e: _show(Filters(grep=["purchases", "UPDATE"]).apply(e)), _ENTRY + " WHERE contains(message, 'purchases') AND contains(message, 'UPDATE')")
_e("all_filters", lambda e: _show(Filters(TimeRange("2024-01-03 00:00:00"), db=["db1"], exclude_user=["u5"], app=["svc0", "svc1"]).apply(e)), _ENTRY + " WHERE ts >= '2024-01-03' AND user_id % 4 = 1 AND user_id % 10 <> 5 AND user_id % 3 < 2")
_e("summary", server.summary, "SELECT count(*) FILTER (NOT is_continuation) AS entries, min(ts) AS first_ts, max(ts) AS last_ts, epoch_us(max(ts)) - epoch_us(min(ts)) AS duration_us, round(count(*) FILTER (NOT is_continuation) * 1000000.0 / (epoch_us(max(ts)) - epoch_us(min(ts))), 3) AS entries_per_s FROM entries")
_e("event_severity", lambda e: server.severities(facts.events(e)), "SELECT sev AS severity, count(*) AS count, round(100.0 * count(*) / sum(count(*)) OVER (), 3) AS percent, list_position(['PANIC','FATAL','ERROR','WARNING','NOTICE','LOG','INFO','DEBUG'], sev)::BIGINT AS rank FROM entries WHERE NOT is_continuation GROUP BY 1")
_e("normalize_event", lambda e: facts.events(e).where("pattern is not null").select("ts", "severity", "pattern"), "SELECT ts, sev AS severity, pattern FROM er")
_e("sqlstate", lambda e: facts.events(e).where("sqlstate <> ''").select("ts", "sqlstate", "sqlstate_class", E.class_description(F.col("sqlstate_class")).alias("description")), "SELECT ts, code AS sqlstate, code[1:2] AS sqlstate_class, CASE code[1:2] WHEN '42' THEN 'Syntax Error or Access Rule Violation' ELSE 'Integrity Constraint Violation' END AS description FROM er")
_FIRST = "first(sev ORDER BY ts) AS severity, first(code[1:2] ORDER BY ts) AS sqlstate_class"
_e("top_events", lambda e: server.top_events(facts.events(e)).select("pattern", "count", "severity", "sqlstate_class"), f"SELECT pattern, count(*) AS count, {_FIRST} FROM er GROUP BY 1")
_e("error_classes", lambda e: server.error_classes(server.event_patterns(facts.events(e))).select("severity", "sqlstate_class", "count", "patterns"), f"SELECT severity, sqlstate_class, sum(n)::BIGINT AS count, count(*) AS patterns FROM (SELECT pattern, count(*) AS n, {_FIRST} FROM er GROUP BY 1) GROUP BY 1, 2")
for _k, _v in (("user", "'u' || user_id % 10"), ("db", "'db' || user_id % 4"), ("app", "'svc' || user_id % 3"), ("host", "'10.0.0.' || user_id % 5")):
    _e(f"entity_{_k}", lambda e, k=_k: server.entity_counts(facts.entities(e), k), f'SELECT {_v} AS "{_k}", count(*) AS count FROM entries WHERE NOT is_continuation GROUP BY 1')
_e("entity_top", lambda e: server.entity_top(server.entity_counts(facts.entities(e), "user"), "user", 3), "SELECT 'u' || user_id % 10 AS \"user\", count(*) AS count FROM entries WHERE NOT is_continuation GROUP BY 1 ORDER BY count DESC, 1 LIMIT 3")
_e("user_db", lambda e: server.entity_pairs(facts.entities(e), "user", "db"), "SELECT 'u' || user_id % 10 AS \"user\", 'db' || user_id % 4 AS db, count(*) AS count FROM entries WHERE NOT is_continuation GROUP BY 1, 2")
_e("user_host", lambda e: server.entity_pairs(facts.entities(e), "user", "host"), "SELECT 'u' || user_id % 10 AS \"user\", '10.0.0.' || user_id % 5 AS host, count(*) AS count FROM entries WHERE NOT is_continuation GROUP BY 1, 2")
_FULL_S = ", s AS (SELECT min(epoch_us(ts)) AS lo, max(epoch_us(ts)) AS hi FROM x), w AS (SELECT lo, hi, CASE WHEN hi - lo < 3600000000 THEN 60000000 WHEN hi - lo < 21600000000 THEN 300000000 WHEN hi - lo < 86400000000 THEN 900000000 ELSE 3600000000 END AS w0 FROM s), b AS (SELECT lo, greatest(w0, ((hi - lo) // 200 + 1)) AS width FROM w)"
_x("bin_combined", lambda x: bins.binned(x, F.sum("duration_ms").alias("total_ms")), _FULL_S + " SELECT (epoch_us(ts) - lo) // width AS bin, count(*) AS count, round(sum(ms), 3) AS total_ms FROM x, b GROUP BY 1")
_x("bin_ts", bins.binned, _FULL_S + " SELECT (epoch_us(ts) - lo) // width AS bin, count(*) AS count FROM x, b GROUP BY 1")
_x("bin_durations", lambda x: bins.binned(x, (F.sum("duration_ms").cast("decimal(38,3)") / 1000).cast("double").alias("seconds")).drop("count"), _FULL_S + " SELECT (epoch_us(ts) - lo) // width AS bin, round(sum(ms::DECIMAL(18,3))::DECIMAL(38,3) / 1000, 3) AS seconds FROM x, b GROUP BY 1")
_x("auto_interval", lambda x: bins.interval(x), _FULL_S + " SELECT lo AS lo_us, width AS width_us FROM b")
_x("refilter_sql", lambda x: sql.query_stats(bins.refilter(x, "2024-01-04 00:00:00", "2024-01-09 00:00:00")).select("norm_query", "count", "total_ms"), " SELECT norm AS norm_query, count(*) AS count, round(sum(ms), 3) AS total_ms FROM x WHERE ts BETWEEN '2024-01-04' AND '2024-01-09' GROUP BY 1")

# --- connections ---------------------------------------------------------------------------------------

_C = """
    WITH o AS (
        SELECT o_orderkey AS key, o_custkey AS cust, epoch_us(o_orderdate) + o_orderkey % 86400 * 1000000 AS at0, round(o_totalprice * 100)::BIGINT * 1000 AS us, o_orderstatus <> 'O' AS closed FROM orders
    ), s AS (
        SELECT at0 AS a, at0 + us AS z, us, 'u' || cust % 7 AS usr, 'db' || cust % 3 AS db, '10.1.0.' || cust % 5 AS host FROM o WHERE closed AND us > 0
    ), points AS (
        SELECT at0 AS t, 1 AS d, key FROM o UNION ALL SELECT at0 + us, -1, key FROM o WHERE closed
    ), running AS (
        SELECT t, d, sum(d) OVER (ORDER BY t, key % 256 ROWS UNBOUNDED PRECEDING) AS n FROM points
    ), sweep AS (
        SELECT t, d, sum(d) OVER (ORDER BY t, d DESC ROWS UNBOUNDED PRECEDING) AS n FROM (SELECT a AS t, 1 AS d FROM s UNION ALL SELECT z, -1 FROM s)
    )
"""


def _c(name: str, plan: Callable[[DataFrame], DataFrame], oracle: str) -> None:
    _register(name, lambda e: plan(facts.connection_events(e)), samples.connection_log, _C + oracle)


def _s(name: str, plan: Callable[[DataFrame], DataFrame], oracle: str) -> None:
    _c(name, lambda c: plan(facts.sessions(c)), oracle)


_M6 = "count(*) AS count, min(us) AS min_us, max(us) AS max_us, round(avg(us), 3) AS avg_us, round(quantile_cont(us, 0.5), 3) AS median_us, sum(us)::BIGINT AS sum_us"
_c("conn_counts", server.connection_totals, "SELECT (SELECT count(*) FROM o) AS received, (SELECT count(*) FROM o WHERE closed) AS disconnected, (SELECT sum(us) FROM s)::BIGINT AS session_us")
_c("session_time", lambda c: c.where("kind = 'disconnected'").select("ts", "dur_us", "user", "db", "host"), 'SELECT make_timestamp(z) AS ts, us AS dur_us, usr AS "user", db, host FROM s')
_s("sessions", lambda s: s.select("start_ts", "end_ts", "dur_us"), "SELECT make_timestamp(a) AS start_ts, make_timestamp(z) AS end_ts, us AS dur_us FROM s")
_s("session_stats", server.session_stats, f"SELECT {_M6} FROM s")
for _k, _v in (("user", "usr"), ("db", "db"), ("host", "host")):
    _s(f"session_by_{_k}", lambda s, k=_k: server.session_by(s, k), f'SELECT {_v} AS "{_k}", {_M6} FROM s GROUP BY 1')
_s("session_dist", server.session_distribution, "SELECT i::BIGINT AS bucket_index, ['< 1s', '1s - 1min', '1min - 30min', '30min - 2h', '2h - 5h', '> 5h'][i + 1] AS bucket, count(us) AS count FROM range(6) r(i) LEFT JOIN s ON CASE WHEN us < 1e6 THEN 0 WHEN us < 6e7 THEN 1 WHEN us < 18e8 THEN 2 WHEN us < 72e8 THEN 3 WHEN us < 18e9 THEN 4 ELSE 5 END = i GROUP BY i")
_c("peak_concurrent", server.peak, "SELECT max(n)::BIGINT AS peak, make_timestamp(min(t) FILTER (n = (SELECT max(n) FROM running WHERE d = 1))) AS peak_ts FROM running WHERE d = 1")
_c("conn_hist", lambda c: server.connection_hist(c, n=6), "SELECT least((at0 - lo) // greatest((hi - lo) // 6, 1), 5) AS bucket_index, count(*) AS count FROM o, (SELECT min(at0) AS lo, max(at0) AS hi FROM o) GROUP BY 1")
_s("concurrent_hist", server.concurrent_hist, """
    , g AS (SELECT min(a) AS lo, max(z) AS hi FROM s), p AS (SELECT least((t - lo) // greatest((hi - lo) // 6, 1), 5) AS i, n, t, d FROM sweep, g),
    b AS (SELECT i, max(n) AS most FROM p GROUP BY 1), c AS (SELECT k.i AS i, (SELECT last(n ORDER BY t, d DESC) FROM p WHERE p.i < k.i) AS carried FROM range(6) k(i))
    SELECT c.i::BIGINT AS bucket_index, greatest(coalesce(most, 0), coalesce(carried, 0))::BIGINT AS most FROM c LEFT JOIN b ON b.i = c.i""")
_s("concurrent_peak", lambda s: A.concurrency(s).agg(F.max("running").alias("peak")), "SELECT max(n)::BIGINT AS peak FROM sweep")
_s("bin_concurrent", bins.concurrent_bins, ", g AS (SELECT min(t) AS lo, max(t) AS hi FROM sweep) SELECT (t - lo) // greatest(3600000000, (hi - lo) // 200 + 1) AS bin, max(n)::BIGINT AS most FROM sweep, g GROUP BY 1")
_s("bin_concurrent_split", lambda s: bins.concurrent_split(s, "1995-01-01 00:00:00"), """
    , pts AS (SELECT a AS t, 1 AS d, a < epoch_us(TIMESTAMP '1995-01-01') AS early FROM s UNION ALL SELECT z, -1, a < epoch_us(TIMESTAMP '1995-01-01') FROM s),
    run AS (SELECT t, d, sum(d) OVER w AS n, sum(CASE WHEN early THEN d ELSE 0 END) OVER w AS e FROM pts WINDOW w AS (ORDER BY t, d DESC ROWS UNBOUNDED PRECEDING)),
    g AS (SELECT min(t) AS lo, max(t) AS hi FROM run), p AS (SELECT (t - lo) // greatest(3600000000, (hi - lo) // 200 + 1) AS bin, n, t, d, e FROM run, g)
    SELECT bin, max(n)::BIGINT AS most, arg_max(e, {n: n, t: -t, d: d})::BIGINT AS before_log FROM p GROUP BY 1""")
_register("avg_concurrent", lambda e: server.average_concurrent(facts.sessions(facts.connection_events(e)), e), samples.connection_log, _C + "SELECT round((SELECT sum(us) FROM s) * 1.0 / (max(t) - min(t)), 3) AS avg_concurrent FROM points")
_s("refilter_sessions", lambda s: server.session_stats(bins.overlapping(s, "1996-01-01 00:00:00", "1996-06-01 00:00:00")), f"SELECT {_M6} FROM s WHERE a <= epoch_us(TIMESTAMP '1996-06-01') AND z >= epoch_us(TIMESTAMP '1996-01-01')")

# --- temporary files and locks -----------------------------------------------------------------------------

_W = """
    WITH l0 AS (
        SELECT l_orderkey AS ok, l_linenumber AS ln, l_partkey AS pk, l_returnflag AS rf, l_quantity::BIGINT AS q, round(l_extendedprice * 100)::BIGINT AS price,
               epoch_us(l_shipdate) + l_orderkey % 86400 * 1000000 + l_linenumber * 1000 + l_partkey % 1000 AS t,
               ((l_orderkey * 10 + l_linenumber) * 100000 + l_partkey) * 10000 + l_suppkey AS pid FROM lineitem
    ), l AS (
        SELECT *, 'select ? from part_' || pk % 8 || ' where k = ?' AS norm, 'SELECT ' || q % 5 || ' FROM part_' || pk % 8 || ' WHERE k = ' || pk AS raw, q % 4 = 0 AS locked, q % 8 = 0 AS got,
               CASE WHEN ln % 2 = 0 THEN 'ShareLock' ELSE 'ExclusiveLock' END AS mode, CASE rf WHEN 'R' THEN 'relation' WHEN 'A' THEN 'transaction' ELSE 'tuple' END AS kind,
               CASE rf WHEN 'R' THEN 'relation ' || pk || ' of database 5' WHEN 'A' THEN 'transaction ' || pk ELSE 'tuple (0,1) of relation 7' END AS res,
               t * 256 + ok % 16 * 7 AS line FROM l0
    ), h AS (
        SELECT *, md5(norm) AS hash, 'se-' || substr(regexp_replace(base64(unhex(md5(norm))), '[+/=]', '', 'g'), 1, 6) AS id, CASE WHEN got THEN price / 50 ELSE price / 100 END AS wait,
               line > (SELECT min(line) FROM l WHERE locked) AS seen FROM l
    ), k AS (
        SELECT hash, min(id) AS id, count(*) FILTER (got) AS acquired_count, coalesce(sum(wait) FILTER (got), 0) AS acquired_ms, count(*) FILTER (NOT got) AS waiting_count,
               coalesce(sum(wait) FILTER (NOT got), 0) AS waiting_ms, sum(wait) AS total_wait_ms FROM h WHERE locked AND seen GROUP BY 1
    )
"""


def _w(name: str, plan: Callable[[DataFrame], DataFrame], oracle: str | None, *kinds: str) -> None:
    _register(name, plan, samples.work_log, oracle and _W + oracle, facts.work_items(*kinds))


def _locks(e: DataFrame) -> DataFrame:
    messages = facts.lock_messages_of(e)
    return A.locks(messages, A.near(facts.statements_of(e), messages))


def _waits(e: DataFrame) -> DataFrame:
    return A.waits(facts.lock_messages_of(e), facts.lock_details_of(e), facts.deadlocks_of(e), facts.statements_of(e))


_TEMPS, _LOCKS, _WAITS = ("temp", "statement"), ("lock", "statement"), ("lock", "detail", "deadlock", "statement")
_temps = lambda e: A.temp_file_query(facts.temps_of(e), facts.statements_of(e))
_w("temp_size", lambda e: facts.temps_of(e).select("ts", "pid", "size"), "SELECT make_timestamp(t) AS ts, pid::VARCHAR AS pid, price AS size FROM l", "temp")
_w("stmt_text", lambda e: facts.statements_of(e).select("pid", "query"), "SELECT pid::VARCHAR AS pid, raw AS query FROM l UNION ALL SELECT (ok % 50 + 1)::VARCHAR, 'SELECT 7 FROM holder_' || pk % 3 FROM l WHERE locked AND ln > 1", "statement")
_w("tempfile_stats", lambda e: server.temp_stats(facts.temps_of(e)), "SELECT count(*) AS count, sum(price)::BIGINT AS total_size, (sum(price) // count(*))::BIGINT AS avg_size FROM l", "temp")
_w("tempfile_assoc", lambda e: _temps(e).select("pid", "size", "query"), "SELECT pid::VARCHAR AS pid, price AS size, raw AS query FROM l", *_TEMPS)
_TQ = "SELECT hash AS full_hash, min(id) AS query_id, min(norm) AS norm_query, count(*) AS count, sum(price)::BIGINT AS total_size, min(raw) AS raw_query FROM h GROUP BY 1"
_w("tempfile_queries", lambda e: server.temp_queries(_temps(e)), _TQ, *_TEMPS)
_w("top_temp_queries", lambda e: server.top_temp_queries(server.temp_queries(_temps(e)), 3), _TQ + " ORDER BY total_size DESC, query_id LIMIT 3", *_TEMPS)
_TH = ", s AS (SELECT min(t) AS lo, max(t) AS hi FROM l)"
_w("temp_hist", lambda e: server.temp_hist(facts.temps_of(e)), _TH + " SELECT least((t - lo) // greatest(greatest(hi - lo, 1000000) // 6, 1), 5) AS bucket_index, sum(price)::BIGINT AS bytes, count(*) AS count FROM l, s GROUP BY 1", "temp")
_w("q_temp_hist", lambda e: server.temp_hist(A.with_query_id(_temps(e)), keys=("query_id",)), ", s AS (SELECT id AS sid, min(t) AS lo, max(t) AS hi FROM h GROUP BY 1) SELECT id AS query_id, least((t - lo) // greatest(greatest(hi - lo, 1000000) // 6, 1), 5) AS bucket_index, sum(price)::BIGINT AS bytes, count(*) AS count FROM h JOIN s ON id = sid GROUP BY 1, 2", *_TEMPS)
_w("bin_temp", lambda e: bins.binned(facts.temps_of(e), F.sum("size").alias("bytes")), _TH + ", b AS (SELECT lo, greatest(CASE WHEN hi - lo < 3600000000 THEN 60000000 WHEN hi - lo < 21600000000 THEN 300000000 WHEN hi - lo < 86400000000 THEN 900000000 ELSE 3600000000 END, (hi - lo) // 200 + 1) AS width FROM s) SELECT (t - lo) // width AS bin, count(*) AS count, sum(price)::BIGINT AS bytes FROM l, b GROUP BY 1", "temp")
_w("lock_parse", lambda e: facts.lock_messages_of(e).select("ts", "event_type", "pid", "lock_type", "resource", "resource_type", "wait_ms"), "SELECT make_timestamp(t) AS ts, 'waiting' AS event_type, pid::VARCHAR AS pid, mode AS lock_type, res AS resource, kind AS resource_type, round(price / 100, 3) AS wait_ms FROM l WHERE locked UNION ALL SELECT make_timestamp(t), 'acquired', pid::VARCHAR, mode, res, kind, round(price / 50, 3) FROM l WHERE got", "lock")
_w("lock_totals", lambda e: server.lock_totals(facts.lock_messages_of(e), facts.deadlocks_of(e)), "SELECT count(*) FILTER (locked) AS locks, count(*) FILTER (got) AS acquired, round(sum(price / 50) FILTER (got), 3) AS total_wait_ms, count(*) FILTER (locked) - count(*) FILTER (got) AS waiting, round(sum(price / 50) FILTER (got) / count(*) FILTER (locked), 3) AS avg_wait_ms, count(*) FILTER (q = 49) AS deadlocks FROM l", "lock", "deadlock")
for _k, _v, _n in (("lock_type", "mode", "lock_types"), ("resource_type", "kind", "resource_types")):
    _w(_n, lambda e, k=_k: server.lock_dimension(_locks(e), k), f"SELECT {_v} AS {_k}, count(*) AS count, round(100.0 * count(*) / sum(count(*)) OVER (), 3) AS percent FROM l WHERE locked GROUP BY 1", *_LOCKS)
_w("lock_query_assoc", lambda e: _locks(e).where("query is not null").select("pid", "lock_key", "last_wait_ms", "query"), "SELECT pid::VARCHAR AS pid, pid || '-' || mode || '-' || res AS lock_key, round(wait, 3) AS last_wait_ms, raw AS query FROM h WHERE locked AND seen", *_LOCKS)
_KR = "hash AS full_hash, id AS query_id, acquired_count, round(acquired_ms, 3) AS acquired_ms, waiting_count, round(waiting_ms, 3) AS waiting_ms, round(total_wait_ms, 3) AS total_wait_ms"
_lq = lambda e: server.lock_queries(_locks(e)).drop("norm_query")
_w("lock_queries", _lq, f"SELECT {_KR} FROM k", *_LOCKS)
_w("waiting_queries", lambda e: server.waiting_queries(_lq(e), 3), f"SELECT {_KR} FROM k ORDER BY k.total_wait_ms DESC, id LIMIT 3", *_LOCKS)
_w("acquired_queries", lambda e: server.acquired_queries(_lq(e), 3).drop("avg_ms"), f"SELECT {_KR} FROM k WHERE acquired_count > 0 ORDER BY k.acquired_ms DESC, id LIMIT 3", *_LOCKS)
_w("still_waiting_queries", lambda e: server.still_waiting_queries(_lq(e), 3), f"SELECT {_KR} FROM k WHERE waiting_count > 0 ORDER BY k.waiting_ms DESC, id LIMIT 3", *_LOCKS)
_w("frequent_waiters", lambda e: server.frequent_waiters(_lq(e), 3).select("query_id", "locks"), "SELECT id AS query_id, acquired_count + waiting_count AS locks FROM k ORDER BY 2 DESC, 1 LIMIT 3", *_LOCKS)
_w("blocking_pid", lambda e: _waits(e).select("pid", "blocking_pid", "event_type"), "SELECT pid::VARCHAR AS pid, CASE WHEN ln > 1 THEN (ok % 50 + 1)::VARCHAR ELSE '' END AS blocking_pid, 'waiting' AS event_type FROM l WHERE locked", *_WAITS)
_w("blockers", lambda e: server.blockers(_waits(e)), "SELECT 'se-' || substr(regexp_replace(base64(unhex(md5('select ? from holder_' || pk % 3))), '[+/=]', '', 'g'), 1, 6) AS query_id, count(*) AS blocked, round(sum(price / 100), 3) AS total_ms, round(avg(price / 100), 3) AS avg_ms FROM l WHERE locked AND ln > 1 GROUP BY 1", *_WAITS)

# --- maintenance and checkpoints ----------------------------------------------------------------------------------

_U = """
    WITH p AS (SELECT 'app.public.' || lower(regexp_replace(p_brand, '[^A-Za-z0-9]', '_', 'g')) AS tbl, p_size AS size, p_size % 3 <> 0 AS vac FROM part),
    c AS (SELECT c_custkey AS key, c_nationkey AS nk, make_timestamp(1704067200000000 + c_custkey * 600000000 + 30000000) AS ts,
                 CASE c_nationkey % 4 WHEN 0 THEN 'wal' WHEN 1 THEN 'time' WHEN 2 THEN 'immediate force wait' ELSE 'unknown' END AS kind FROM customer)
"""


def _u(name: str, plan: Callable[[DataFrame], DataFrame], oracle: str) -> None:
    _register(name, plan, samples.upkeep_log, _U + oracle)


_done = lambda e: A.checkpoint_kinds(facts.checkpoints(e))
_u("vacuum", lambda e: server.vacuum(facts.maintenance(e)), 'SELECT tbl AS "table", count(*) AS count, sum(size * 8192)::BIGINT AS bytes FROM p WHERE vac GROUP BY 1')
_u("analyze", lambda e: server.analyze(facts.maintenance(e)), 'SELECT tbl AS "table", count(*) AS count FROM p WHERE NOT vac GROUP BY 1')
_u("cum80", lambda e: server.head_of_total(server.vacuum(facts.maintenance(e)).drop("bytes")), """
    , v AS (SELECT tbl, count(*) AS n FROM p WHERE vac GROUP BY 1), r AS (SELECT *, row_number() OVER w AS rn, coalesce(sum(n) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(n) OVER () AS whole FROM v WINDOW w AS (ORDER BY n DESC, tbl))
    SELECT tbl AS "table", n AS count, rn FROM r WHERE rn <= 10 AND before < 0.8 * whole""")
_u("checkpoint_stats", lambda e: server.checkpoint_stats(_done(e)), "SELECT count(*) AS count, round(sum((nk + 1) / 8), 3) AS write_s, max((nk + 1) / 8) AS max_write_s, sum(key)::BIGINT AS buffers, sum(nk * 100)::BIGINT AS distance_kb, max(nk * 100)::BIGINT AS max_distance_kb, round(sum(key) * 8192.0 / sum((nk + 1) / 8), 3) AS flush_rate FROM c")
_u("ckpt_type", lambda e: _done(e).select("ts", "kind", "buffers", "distance_kb", "estimate_kb"), "SELECT ts, kind, key AS buffers, (nk * 100)::BIGINT AS distance_kb, (nk * 100 + 50)::BIGINT AS estimate_kb FROM c")
_u("checkpoint_types", lambda e: server.checkpoint_types(_done(e)), "SELECT kind, count(*) AS count, round(100.0 * count(*) / sum(count(*)) OVER (), 3) AS percent FROM c GROUP BY 1")
_u("wal_series", lambda e: server.wal_series(_done(e)), "SELECT ts, (nk * 100)::BIGINT AS distance_kb, (nk * 100 + 50)::BIGINT AS estimate_kb FROM c")
_u("ckpt_hist", lambda e: server.checkpoint_hist(_done(e)), "SELECT hour(ts) // 4 AS bucket_index, count(*) AS count FROM c GROUP BY 1")
_u("wal_hist", lambda e: server.wal_hist(_done(e)), "SELECT hour(ts) // 4 AS bucket_index, round(avg(nk * 100) / 1024, 3) AS distance_mb, round(avg(nk * 100 + 50) / 1024, 3) AS estimate_mb FROM c GROUP BY 1")
_u("ckpt_warnings", lambda e: server.warning_stats(facts.checkpoint_warnings(e)), "SELECT count(*) AS count, min(key % 29 + 1)::BIGINT AS min_s, max(key % 29 + 1)::BIGINT AS max_s FROM c WHERE nk = 7")
_u("bin_ckpt", lambda e: bins.checkpoint_series(_done(e)), "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS hour, count(*) FILTER (kind = 'time') AS by_time, count(*) FILTER (kind = 'wal') AS by_wal, count(*) FILTER (kind NOT IN ('time', 'wal')) AS other FROM c GROUP BY 1")


# --- several logs together ----------------------------------------------------------------------------------------


def _two(spark: SparkSession, sf_dir: str, items: Callable[[DataFrame], DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    a = entries_from_lines(samples.sql_log(spark, sf_dir))
    return a, entries_from_lines(samples.work_log(spark, sf_dir).withColumn("file_idx", F.lit(1)), items=items)


def sql_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _two(spark, sf_dir, facts.work_items("temp", *_LOCKS))
    return _plain(sql.detail(sql.query_stats(facts.executions(a)), server.temp_queries(_temps(b)), server.lock_queries(_locks(b))).drop("norm_query"))


def no_duration(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _two(spark, sf_dir, facts.work_items("temp", *_LOCKS))
    both = server.temp_queries(_temps(b)).select("full_hash", "query_id").union(server.lock_queries(_locks(b)).select("full_hash", "query_id"))
    return _plain(sql.without_duration(sql.query_stats(facts.executions(a)), both))


def union_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _two(spark, sf_dir)
    return _plain(server.summary(a.unionByName(b)))


QUERIES |= {f.__name__: f for f in (sql_detail, no_duration, union_inputs)}
_WX = _X + ", " + _W.strip().removeprefix("WITH ")
ORACLE_SQL |= {
    "sql_detail": _WX + """, tq AS (SELECT hash, min(id) AS id, count(*) AS n, sum(price)::BIGINT AS bytes FROM h GROUP BY 1)
        SELECT coalesce(s.hash, t.hash, k.hash) AS full_hash, coalesce(s.id, t.id, k.id) AS query_id, s.n AS count, round(s.total, 3) AS total_ms, s.longest AS max_ms, t.n AS temp_count, t.bytes AS temp_bytes,
               k.acquired_count, k.waiting_count, round(k.total_wait_ms, 3) AS total_wait_ms FROM stats s FULL JOIN tq t ON s.hash = t.hash FULL JOIN k ON coalesce(s.hash, t.hash) = k.hash""",
    "no_duration": _WX + " SELECT DISTINCT hash AS full_hash, id AS query_id FROM h WHERE hash NOT IN (SELECT hash FROM stats)",
    "union_inputs": _X + _E.replace("entries AS", "e1 AS") + ", " + _W.strip().removeprefix("WITH ") + """, u AS (SELECT is_continuation, epoch_us(ts) AS t FROM e1
        UNION ALL SELECT false, t FROM l UNION ALL SELECT true, t FROM l UNION ALL SELECT false, t FROM l WHERE locked UNION ALL SELECT true, t FROM l WHERE locked AND ln > 1 UNION ALL SELECT false, t FROM l WHERE locked AND ln > 1 UNION ALL SELECT false, t FROM l WHERE got UNION ALL SELECT false, t FROM l WHERE q = 49)
        SELECT count(*) FILTER (NOT is_continuation) AS entries, make_timestamp(min(t)) AS first_ts, make_timestamp(max(t)) AS last_ts, max(t) - min(t) AS duration_us, round(count(*) FILTER (NOT is_continuation) * 1000000.0 / (max(t) - min(t)), 3) AS entries_per_s FROM u""",
}
