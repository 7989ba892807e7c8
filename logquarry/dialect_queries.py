"""Registered queries that read other dialects, formats and files, and the SQL that checks them.

The same events are rendered in every dialect, so the same facts must come out of each; files are
written to the shared folder and read back through detection and the readers.
"""

from __future__ import annotations

import gzip
import io
import json
import tarfile
import uuid
import zipfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logquarry import samples
from logquarry.functions import sql as Q
from logquarry.operators import associate as A
from logquarry.operators import facts
from logquarry.operators.assemble import entries_from_lines
from logquarry.operators.stage import scratch
from logquarry.plans import server, sql
from logquarry.queries import _C, _E, _U, _X, _plain, _show
from logquarry.sources import detect, dialects, inputs
from logquarry.sources.storage import Storage

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _query(name: str, run: Callable[[SparkSession, str], DataFrame], oracle: str) -> None:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        return _plain(run(spark, sf_dir))

    query.__name__ = name
    QUERIES[name] = query
    ORACLE_SQL[name] = oracle


# --- dialects: lines to entries, and the facts in them ---------------------------------------------------

_text = lambda **how: lambda lines: entries_from_lines(lines, **how)
#: name: renderer, reader, whether a process and clients are named, whether statements are entries of their own
DIALECTS = {
    "rds": (samples.rds_log, _text(), True, False),
    "azure": (samples.azure_log, _text(), False, False),
    "syslog_bsd": (samples.syslog("bsd"), _text(year=2024, syslog=True), True, False),
    "syslog_iso": (samples.syslog("iso"), _text(syslog=True), True, False),
    "syslog_rfc5424": (samples.syslog("rfc5424"), _text(syslog=True), True, False),
    "csvlog": (samples.csv_log, inputs.entries_from_csv_lines, True, False),
    "jsonlog": (samples.json_log, inputs.entries_from_json_lines, True, False),
    "operator_json": (samples.operator_log(), inputs.entries_from_json_lines, True, False),
    "wrapped_json": (samples.operator_log(wrapped=True), inputs.entries_from_json_lines, True, False),
    "payload_json": (samples.payload_log, inputs.entries_from_json_lines, True, True),
}


def _executions(e: DataFrame) -> DataFrame:
    return facts.executions(e).select("ts", "duration_ms", "raw_query", "norm_query", "query_id", "query_type", "pid")


def _errors(e: DataFrame) -> DataFrame:
    return facts.events(e).where("severity in ('ERROR', 'FATAL')").groupBy("severity", "sqlstate", "sqlstate_class").agg(sql.count_rows().alias("count"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def _clients(e: DataFrame) -> DataFrame:
    return server.entity_pairs(facts.entities(e), "user", "db")


for _name, (_log, _read, _named, _more) in DIALECTS.items():
    _pid = "pid" if _named else "'' AS pid"
    _query(f"{_name}_executions", lambda s, d, log=_log, read=_read: _executions(read(log(s, d))), _X + f"SELECT ts, round(ms, 3) AS duration_ms, raw AS raw_query, norm AS norm_query, id AS query_id, kind AS query_type, {_pid} FROM x")
    _query(f"{_name}_errors", lambda s, d, log=_log, read=_read: _errors(read(log(s, d))), _X + _E + "SELECT sev AS severity, code AS sqlstate, code[1:2] AS sqlstate_class, count(*) AS count, min(ts) AS first_ts, max(ts) AS last_ts FROM er GROUP BY ALL")
    if _named:
        _query(f"{_name}_clients", lambda s, d, log=_log, read=_read: _clients(read(log(s, d))), _X + _E + f"SELECT 'u' || user_id % 10 AS \"user\", 'db' || user_id % 4 AS db, count(*) AS count FROM entries {'' if _more else 'WHERE NOT is_continuation'} GROUP BY 1, 2")

_query("glued_lines", lambda s, d: _show(entries_from_lines(samples.marked_log(s, d), foreign="glue")), _X + _E + "SELECT ts, message, is_continuation, (user_id + 1000)::VARCHAR AS pid FROM entries")
_query(
    "json_epoch_times",
    lambda s, d: inputs.entries_from_json_lines(samples.epoch_log(s, d)).groupBy("ts", "pid").agg(sql.count_rows().alias("count")),
    "SELECT CASE WHEN event_id % 2 = 0 THEN make_timestamp(epoch_us(ts) // 1000 * 1000) ELSE make_timestamp(epoch_us(ts) // 1000000 * 1000000) END AS ts, (user_id + 1000)::VARCHAR AS pid, count(*) AS count FROM events GROUP BY 1, 2",
)
_query(
    "syslog_parts",
    lambda s, d: samples.syslog("bsd")(s, d).select(dialects.is_syslog_chunk(F.col("line")).alias("part"), dialects.syslog_pid(F.col("line")).alias("pid"), F.trim(F.translate(dialects.syslog_content(F.col("line")), "#01", "")).alias("content")).groupBy("part", "pid", "content").agg(sql.count_rows().alias("count")),
    _X + _E + "SELECT part, (user_id + 1000)::VARCHAR AS pid, content, count(*) AS count FROM (SELECT false AS part, user_id, '' AS content FROM entries UNION ALL SELECT true, user_id, 'ORDER BY' FROM x WHERE norm LIKE '%order by ?') GROUP BY ALL",
)

# --- associations ----------------------------------------------------------------------------------------------


def _plans(s: SparkSession, d: str) -> DataFrame:
    e = entries_from_lines(samples.plan_log(s, d))
    return A.plan_of_execution(facts.executions(e), facts.plans(e)).select("ts", "pid", "raw_query", "plan")


_query("plan_assoc", _plans, "SELECT ts, user_id::VARCHAR AS pid, 'SELECT ' || event_id AS raw_query, CASE WHEN event_id % 3 = 0 THEN 'Seq Scan on t' || event_id || '  (cost=0.00..1.00 rows=' || user_id || ')' END AS plan FROM events WHERE event_type <> 'error'")
_query("is_plan", lambda s, d: entries_from_lines(samples.plan_log(s, d)).groupBy(Q.is_plan(F.col("message")).alias("plan")).agg(sql.count_rows().alias("count")), "SELECT p AS plan, count(*) AS count FROM (SELECT false AS p FROM events WHERE event_type <> 'error' UNION ALL SELECT true FROM events WHERE event_type <> 'error' AND event_id % 3 = 0) GROUP BY 1")
_query("plan_text", lambda s, d: facts.plans(entries_from_lines(samples.plan_log(s, d))).select("pid", "plan"), "SELECT user_id::VARCHAR AS pid, 'Seq Scan on t' || event_id || '  (cost=0.00..1.00 rows=' || user_id || ')' AS plan FROM events WHERE event_type <> 'error' AND event_id % 3 = 0")


def _waiting(s: SparkSession, d: str) -> DataFrame:
    e = facts.work(entries_from_lines(samples.wait_log(s, d)))
    return A.waits(facts.lock_messages(e), facts.lock_details(e), facts.deadlocks(e), facts.statements(e))


_O = "FROM (SELECT o_orderkey AS key, o_custkey AS cust, o_orderstatus AS st, round(o_totalprice, 2) AS ms FROM orders)"
_query("relation_ctx", lambda s, d: _waiting(s, d).select("pid", "relation", "wait_ms"), f"SELECT key::VARCHAR AS pid, CASE WHEN st = 'F' THEN 'acc_' || cust % 9 ELSE '' END AS relation, round(ms, 3) AS wait_ms {_O}")
_query("deadlock_mark", lambda s, d: _waiting(s, d).groupBy("event_type").agg(sql.count_rows().alias("count"), F.sum("wait_ms").alias("wait_ms")), f"SELECT CASE WHEN st = 'P' THEN 'deadlock' ELSE 'waiting' END AS event_type, count(*) AS count, round(sum(ms), 3) AS wait_ms {_O} GROUP BY 1")
_query("lock_relations", lambda s, d: server.lock_relations(_waiting(s, d)), f"SELECT 'acc_' || cust % 9 AS relation, count(*) AS count, round(100.0 * count(*) / sum(count(*)) OVER (), 3) AS percent {_O} WHERE st = 'F' GROUP BY 1")
_query(
    "context_relation_text",
    lambda s, d: facts.lock_details(entries_from_lines(samples.wait_log(s, d))).groupBy("relation").agg(sql.count_rows().alias("count")),
    f"SELECT 'acc_' || cust % 9 AS relation, count(*) AS count {_O} WHERE st = 'F' GROUP BY 1",
)


def _contexts(s: SparkSession, d: str) -> DataFrame:
    t = samples.table(s, d, "part")
    message = F.concat(F.lit('CONTEXT:  PL/pgSQL function f() line 1 at SQL statement "SELECT '), F.col("p_partkey").cast("string"), F.when(F.col("p_size") % 2 == 0, '"').otherwise('" and more'))
    return t.select("p_partkey", Q.context_statement(message).alias("statement"))


_query("context_text", _contexts, "SELECT p_partkey, 'SELECT ' || p_partkey || CASE WHEN p_size % 2 = 0 THEN '' ELSE '\" and more' END AS statement FROM part")
_query("transaction_command", lambda s, d: samples.event_parts(s, d).select("event_id", Q.is_transaction_command(F.regexp_extract("body", "(?:statement|execute s1): (.*)", 1)).alias("command")), "SELECT event_id, event_type = 'purchase' AND user_id % 2 = 1 AS command FROM events")


def _first_seen(s: SparkSession, d: str) -> DataFrame:
    p = samples.table(s, d, "part").select(F.col("p_partkey").alias("seq"), F.lit(None).cast("timestamp").alias("ts"), F.lit("ERROR").alias("severity"), F.concat(F.lit("pattern "), (F.col("p_partkey") * 7 % 1301).cast("string")).alias("pattern"), F.lit("42").alias("sqlstate_class"), F.lit("m").alias("message"))
    return server.event_patterns(p, first=100).select("pattern", "count", "first_seq")


_query("first_patterns", _first_seen, "SELECT 'pattern ' || p_partkey * 7 % 1301 AS pattern, count(*) AS count, min(p_partkey)::BIGINT AS first_seq FROM part GROUP BY 1 ORDER BY min(p_partkey) LIMIT 100")
_DONE = lambda s, d: A.checkpoint_kinds(facts.checkpoints(entries_from_lines(samples.upkeep_log(s, d))))


def _rates(s: SparkSession, d: str) -> DataFrame:
    e = entries_from_lines(samples.upkeep_log(s, d))
    done = A.checkpoint_kinds(facts.checkpoints(e))
    span = done.agg((F.unix_micros(F.max("ts")) - F.unix_micros(F.min("ts"))).alias("span_us"))
    return server.checkpoint_stats(done, span).select("wal_rate", "flush_rate")


_query("wal_rate", _rates, _U + "SELECT round(sum(nk * 100) * 1024.0 * 1000000 / (epoch_us(max(ts)) - epoch_us(min(ts))), 3) AS wal_rate, round(sum(key) * 8192.0 / sum((nk + 1) / 8), 3) AS flush_rate FROM c")
_query("pid_sessions", lambda s, d: server.paired_sessions(facts.connection_events(entries_from_lines(samples.connection_log(s, d)))).select("pid", "start_ts", "end_ts"), _C + "SELECT key::VARCHAR AS pid, make_timestamp(at0) AS start_ts, CASE WHEN closed THEN make_timestamp(at0 + us) END AS end_ts FROM o")

# --- files ---------------------------------------------------------------------------------------------------------


def _folder(spark: SparkSession, files: dict[str, bytes]) -> str:
    folder = f"{scratch(spark)}/in-{uuid.uuid4().hex[:12]}"
    store = Storage(spark)
    for name, data in files.items():
        store.write(f"{folder}/{name}", data)
    return folder


def _nation_lines(spark: SparkSession, sf_dir: str) -> list[str]:
    rows = spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", "n_regionkey").orderBy("n_nationkey").collect()
    return [f"2024-03-01 10:{r.n_nationkey:02d}:00 UTC [{100 + r.n_regionkey}]: user=u{r.n_regionkey},db=d LOG:  duration: {r.n_nationkey}.5 ms  statement: SELECT {r.n_nationkey}" for r in rows]


def _csv(lines: list[str]) -> str:
    out = []
    for x in lines:
        head, body = x.split(" LOG:  ")
        out.append(f'{head[:19]}.000 UTC,"u{head.split("user=u")[1].split(",")[0]}","d",{head.split("[")[1].split("]")[0]},"h",s,1,x,,,0,LOG,00000,"{body}",,,,,,,,,"app"')
    return "\n".join(out) + "\n"


def _jsonl(lines: list[str]) -> list[dict]:
    return [{"timestamp": x[:23], "pid": int(x.split("[")[1].split("]")[0]), "user": f"u{x.split('user=u')[1].split(',')[0]}", "dbname": "d", "error_severity": "LOG", "message": x.split(" LOG:  ")[1]} for x in lines]


def _archive(kind: str, members: dict[str, bytes]) -> bytes:
    out = io.BytesIO()
    if kind == "zip":
        with zipfile.ZipFile(out, "w") as z:
            for name, data in members.items():
                z.writestr(name, data)
    else:
        with tarfile.open(fileobj=out, mode="w") as t:
            for name, data in members.items():
                info = tarfile.TarInfo(name)
                info.size = len(data)
                t.addfile(info, io.BytesIO(data))
    return out.getvalue()


def _packed(data: bytes, kind: str) -> bytes:
    if kind == "gz":
        return gzip.compress(data)
    import zstandard

    return zstandard.compress(data)


def _file_kinds(spark: SparkSession, sf_dir: str) -> dict[str, bytes]:
    lines = _nation_lines(spark, sf_dir)
    text, rows = ("\n".join(lines) + "\n").encode(), _jsonl(lines)
    table, objects, array = _csv(lines).encode(), ("\n".join(map(json.dumps, rows)) + "\n").encode(), json.dumps(rows).encode()
    members = {"logs/a.log": text, "logs/b.csv": table, "c.jsonl.gz": _packed(objects, "gz"), "../up.log": text, "empty.log": b"", "notes.txt": b"no log at all"}
    return {
        "a.log": text, "b.csv": table, "c.jsonl": objects, "d.json": array, "e.log.gz": _packed(text, "gz"), "f.csv.gz": _packed(table, "gz"), "g.log.zst": _packed(text, "zst"), "h.json.zstd": _packed(array, "zst"),
        "i.tar": _archive("tar", members), "j.tgz": _packed(_archive("tar", members), "gz"), "k.tar.zst": _packed(_archive("tar", members), "zst"), "l.zip": _archive("zip", members), "m.log.2024-03-01": text,
    }


#: How often the lines are in each file: archives hold them three times (text, csv and objects).
_COPIES = {"a.log": 1, "b.csv": 1, "c.jsonl": 1, "d.json": 1, "e.log.gz": 1, "f.csv.gz": 1, "g.log.zst": 1, "h.json.zstd": 1, "i.tar": 3, "j.tgz": 3, "k.tar.zst": 3, "l.zip": 3, "m.log.2024-03-01": 1}
_FACTS = "('2024-03-01 10:00:00'::TIMESTAMP + n_nationkey * INTERVAL 1 MINUTE) AS ts, n_nationkey + 0.5 AS duration_ms, 'SELECT ' || n_nationkey AS raw_query, (100 + n_regionkey)::VARCHAR AS pid"


def _read(spark: SparkSession, paths: list[str]) -> DataFrame:
    return facts.executions(inputs.read_entries(spark, paths)).select("ts", "duration_ms", "raw_query", "pid")


def _one_by_one(only: tuple[str, ...]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        files = {k: v for k, v in _file_kinds(spark, sf_dir).items() if k in only}
        folder, out = _folder(spark, files), None
        for name in files:
            part = _read(spark, [f"{folder}/{name}"]).withColumn("file", F.lit(name))
            out = part if out is None else out.unionByName(part)
        return out

    return run


def _each_of(only: tuple[str, ...]) -> str:
    files = ", ".join(f"('{n}', {_COPIES[n]})" for n in only)
    return f"SELECT {_FACTS}, file FROM nation, (VALUES {files}) f(file, copies), range(3) r(i) WHERE i < copies"


for _name, _only in {"plain_files": ("a.log", "b.csv", "c.jsonl", "d.json"), "compressed_files": ("e.log.gz", "f.csv.gz", "g.log.zst", "h.json.zstd"), "tar_files": ("i.tar", "j.tgz", "k.tar.zst"), "zip_files": ("l.zip", "m.log.2024-03-01")}.items():
    _query(_name, _one_by_one(_only), _each_of(_only))


_MIXED = ("a.log", "b.csv", "c.jsonl", "e.log.gz", "l.zip", "m.log.2024-03-01")


def _folder_of_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = {k: v for k, v in _file_kinds(spark, sf_dir).items() if k in _MIXED} | {"notes.txt": b"not a log", "old.log.bak": b"2024-03-01 10:00:00 UTC [1]: LOG:  x\n", "sub/deep.log": b"2024-03-01 10:00:00 UTC [1]: LOG:  x\n"}
    return _read(spark, [_folder(spark, files)])


_query("folder_input", _folder_of_files, f"SELECT {_FACTS} FROM nation, range({sum(_COPIES[n] for n in _MIXED)}) r(i)")


def _bad_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inputs that cannot be read beside one that can; and none that can."""
    folder = _folder(spark, {"good.log": ("\n".join(_nation_lines(spark, sf_dir)) + "\n").encode(), "binary.log": b"\0\1\2" * 50, "empty.log": b"", "words.csv": b"no table here\n", "x.json": b"{}"})
    kept = inputs.read_entries(spark, [folder]).count()
    try:
        inputs.read_entries(spark, [f"{folder}/binary.log", f"{folder}/words.csv"])
        error = 0
    except ValueError:
        error = 1
    return spark.createDataFrame([(kept, error)], "entries long, errors long")


_query("unreadable_inputs", _bad_inputs, "SELECT count(*) AS entries, 1::BIGINT AS errors FROM nation")


def _expanded(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = [r.n_name for r in spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.lower(F.regexp_replace("n_name", " ", "_")).alias("n_name")).collect()]
    endings = [".log", ".csv", ".jsonl.gz", ".txt", ".log.2024-01-01", ".log.old", ".tar.zst", ".md"]
    folder = _folder(spark, {f"{n}{endings[i % 8]}": b"x" for i, n in enumerate(sorted(names))})
    store = Storage(spark)
    rows = [(what, p.rsplit("/", 1)[1], store.size(p)) for what, args in (("folder", [folder]), ("pattern", [f"{folder}/*.log", f"{folder}/*.md"])) for p in detect.collect_files(args, store)]
    return spark.createDataFrame(rows, "what string, name string, bytes long")


_query(
    "input_expansion",
    _expanded,
    """WITH f AS (SELECT name || ['.log', '.csv', '.jsonl.gz', '.txt', '.log.2024-01-01', '.log.old', '.tar.zst', '.md'][(row_number() OVER (ORDER BY name) - 1) % 8 + 1] AS name
                  FROM (SELECT lower(replace(n_name, ' ', '_')) AS name FROM nation))
       SELECT 'folder' AS what, name, 1::BIGINT AS bytes FROM f WHERE name NOT LIKE '%.txt' AND name NOT LIKE '%.old' AND name NOT LIKE '%.md'
       UNION ALL SELECT 'pattern', name, 1 FROM f WHERE name LIKE '%.log' OR name LIKE '%.md'""",
)
_SAMPLES = {
    "stderr": ("x", b"2024-01-01 10:00:00 UTC [1]: LOG:  x\n", "log"), "bsd": ("x", b"Jan  1 10:00:00 h postgres[1]: [1-1] LOG:  x\n", "syslog"), "iso": ("x", b"2024-01-01T10:00:00Z h postgres[1]: [1-1] LOG:  x\n", "syslog"),
    "rfc5424": ("x.log", b"<134>1 2024-01-01T10:00:00Z h postgres 1 - - [1-1] LOG:  x\n", "syslog"), "object": ("x", b'{"timestamp": "2024-01-01", "message": "m"}\n', "json"), "array": ("x.json", b'[{"timestamp": "2024-01-01"}, {"time', "array"),
    "table": ("x", b'2024-01-01 10:00:00.000 UTC,"u","d",1,"h",s,1,x,2024-01-01 10:00:00 UTC,1/1,0,LOG,00000,"m",,,,\n', "csv"), "wrong ending": ("x.csv", b"2024-01-01 10:00:00 UTC [1]: LOG:  x\n", "unknown"),
    "zeros": ("x", b"2024-01-01 10:00:00 UTC [1]: LOG:  x\0\n", "unknown"), "control": ("x", b"\1\2\3\4\5\6LOG", "unknown"), "words": ("x", b"some words\n", "unknown"), "empty": ("x.log", b" \n", "unknown"), "no time": ("x", b'{"message": "m"}\n', "unknown"),
}


def _detected(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = []
    for what, (name, data, _) in _SAMPLES.items():
        try:
            rows.append((what, inputs.kind_of(data, name)))
        except detect.UnknownFormat:
            rows.append((what, "unknown"))
    return spark.createDataFrame(rows, "what string, kind string")


_query("format_detection", _detected, "SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{v[2]}')" for k, v in _SAMPLES.items()) + ") t(what, kind)")


def _stdin(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _nation_lines(spark, sf_dir)
    out = None
    for name, data in (("log", "\n".join(lines)), ("csv", _csv(lines)), ("array", json.dumps(_jsonl(lines)))):
        part = facts.executions(inputs.read_stdin(spark, data.encode())).select("ts", "duration_ms", "raw_query", "pid").withColumn("file", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


_query("stdin_input", _stdin, f"SELECT {_FACTS}, file FROM nation, (VALUES ('log'), ('csv'), ('array')) f(file)")
