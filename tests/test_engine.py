import gzip
import io
import json
import tarfile
import zipfile
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from logquarry.operators import associate as A
from logquarry.operators import facts
from logquarry.operators.assemble import entries_from_lines
from logquarry.operators.filters import Filters, TimeRange, parse_duration
from logquarry.plans import server, sql

P = "db=a,user=u,app=x,client=1.2.3.4"
STDERR = f"""
2025-01-01 10:00:00.100 UTC [11]: {P} LOG:  duration: 12.5 ms  statement: SELECT 1 FROM t WHERE a = 'x'
\tAND b = 2
2025-01-01 10:00:01 UTC [11]: {P} LOG:  duration: 3.5 ms  execute p1: COMMIT
12345 output of another tool
2025-01-01 10:00:02 UTC [12]: {P} ERROR:  relation "t9" does not exist at character 15
2025-01-01 10:00:02 UTC [12]: {P} STATEMENT:  SELECT * FROM t9
2025-01-01 10:00:03 UTC [13]: LOG:  connection received: host=1.2.3.4 port=1
2025-01-01 10:00:04 UTC [14]: LOG:  connection received: host=1.2.3.4 port=2
2025-01-01 10:10:03 UTC [13]: LOG:  disconnection: session time: 0:10:00.000 user=u database=a host=1.2.3.4
2025-01-01 10:10:04 UTC [9]: LOG:  checkpoint starting: time
2025-01-01 10:10:05 UTC [9]: LOG:  checkpoint complete: wrote 5 buffers (0.0%); total=0.5 s; distance=10 kB, estimate=20 kB
2025-01-01 10:10:06 UTC [14]: {P} LOG:  temporary file: path "base/x", size 2048
2025-01-01 10:10:06 UTC [14]: {P} STATEMENT:  SELECT 2
"""


def messages(e):
    return [r.message for r in e.orderBy("seq").collect()]


def test_assembly_joins_and_drops(lines):
    e = entries_from_lines(lines(STDERR))
    m = messages(e)
    assert len(m) == 11 and m[0].endswith("a = 'x' AND b = 2")
    glued = messages(entries_from_lines(lines(STDERR), foreign="glue"))
    assert glued[1].endswith("COMMIT 12345 output of another tool")
    assert [r.is_continuation for r in e.orderBy("seq").collect()].count(True) == 2


def test_empty_input(lines, spark):
    empty = lines("x").where("false")
    e = entries_from_lines(empty)
    assert e.count() == 0 and sql.totals(facts.executions(e)).first()["count"] == 0
    assert server.peak(facts.connection_events(e)).first().peak is None


@pytest.mark.parametrize(
    "line, ts, message, pid",
    [
        ("2025-01-01 10:00:00 CET [5]: LOG:  x", "10:00:00", "[5]: LOG:  x", "5"),
        ("2025-01-01 10:00:00 UTC:10.0.0.1(55):bob@shop:[77]:LOG:  x", "10:00:00", "db=shop user=bob host=10.0.0.1 LOG:  x", "77"),
        ("2025-01-01 10:00:00 UTC-abc.1-LOG:  x", "10:00:00", "LOG:  x", ""),
        ("Jan  1 10:00:00 host postgres[5]: [1-1] LOG:  x", "10:00:00", "host postgres[5]: [1-1] LOG:  x", "5"),
        ("2025-01-01T10:00:00+02:00 host postgres[5]: [7-1] LOG:  x", "08:00:00", "[7-1] LOG:  x", "7"),
        ("<134>1 2025-01-01T10:00:00Z host postgres 5 - - [7-1] LOG:  x", "10:00:00", "[7-1] LOG:  x", "7"),
    ],
)
def test_dialects(lines, line, ts, message, pid):
    r = entries_from_lines(lines(line), year=2025).first()
    assert (r.ts, r.message) == (datetime.fromisoformat(f"2025-01-01 {ts}"), message)
    assert r.pid == pid


def test_syslog_chunks(lines):
    text = """
Jan  1 10:00:01 h postgres[5]: [1-1] LOG:  duration: 1.0 ms  statement: SELECT
Jan  1 10:00:01 h postgres[6]: [1-1] LOG:  other
Jan  1 10:00:01 h postgres[5]: [1-2] 2
Jan  1 10:00:02 h postgres[7]: [3-2] orphan
"""
    m = messages(entries_from_lines(lines(text), year=2025, syslog=True))
    assert len(m) == 2 and m[0].endswith("SELECT 2") and m[1].endswith("other")


def test_statistics(lines):
    x = facts.executions(entries_from_lines(lines(STDERR)))
    t = sql.totals(x).first()
    assert (t["count"], t.unique_queries, t.sum_ms) == (2, 2, 16.0)
    assert {r.category: r["count"] for r in sql.category_stats(sql.query_stats(x)).collect()} == {"DML": 1, "TCL": 1}
    assert sorted(r.norm_query for r in facts.executions(entries_from_lines(lines(STDERR)), memo=True).collect()) == sorted(r.norm_query for r in x.collect())


def test_plan_belongs_to_the_next_statement(lines):
    text = """
2025-01-01 10:00:00 UTC [1]: LOG:  duration: 5.0 ms  plan: Query Text: select 1 Seq Scan on t
2025-01-01 10:00:01 UTC [1]: LOG:  duration: 5.0 ms  statement: select 1
2025-01-01 10:00:02 UTC [1]: LOG:  duration: 6.0 ms  statement: select 2
"""
    e = entries_from_lines(lines(text))
    got = A.plan_of_execution(facts.executions(e), facts.plans(e)).orderBy("seq").collect()
    assert [r.plan for r in got] == ["Seq Scan on t", None]


def test_temp_file_query(lines):
    text = """
2025-01-01 10:00:00 UTC [1]: LOG:  duration: 5.0 ms  statement: select 'early'
2025-01-01 10:00:01 UTC [2]: LOG:  temporary file: path "a", size 10
2025-01-01 10:00:01 UTC [2]: STATEMENT:  select 2
2025-01-01 10:00:02 UTC [3]: LOG:  duration: 5.0 ms  statement: select 3
2025-01-01 10:00:03 UTC [3]: LOG:  temporary file: path "b", size 20
2025-01-01 10:00:04 UTC [1]: LOG:  temporary file: path "c", size 30
"""
    e = entries_from_lines(lines(text))
    got = A.temp_file_query(facts.temp_events(e), facts.statements(e)).orderBy("seq").collect()
    assert [(r.size, r["query"]) for r in got] == [(10, "select 2"), (20, "select 3"), (30, None)]


def test_locks_and_blockers(lines):
    text = """
2025-01-01 10:00:00 UTC [9]: LOG:  process 9 still waiting for ShareLock on relation 1 after 1.0 ms
2025-01-01 10:00:01 UTC [1]: LOG:  duration: 5.0 ms  statement: update a set b = 1
2025-01-01 10:00:02 UTC [2]: LOG:  process 2 still waiting for ExclusiveLock on transaction 7 after 1000.5 ms
2025-01-01 10:00:02 UTC [2]: DETAIL:  Process holding the lock: 1. Wait queue: 2.
2025-01-01 10:00:02 UTC [2]: CONTEXT:  while updating tuple (0,1) in relation "acc"
2025-01-01 10:00:02 UTC [2]: STATEMENT:  update acc set x = 2
2025-01-01 10:00:03 UTC [2]: LOG:  process 2 acquired ExclusiveLock on transaction 7 after 2000.0 ms
2025-01-01 10:00:04 UTC [9]: ERROR:  deadlock detected
"""
    e = entries_from_lines(lines(text))
    msgs, st = facts.lock_messages(e), facts.statements(e)
    t = server.lock_totals(msgs, facts.deadlocks(e)).first()
    assert (t.locks, t.acquired, t.waiting, t.total_wait_ms, t.deadlocks) == (2, 1, 1, 2000.0, 1)
    k = {r.pid: r for r in A.locks(msgs, st).collect()}
    assert k["2"].query == "update acc set x = 2" and k["2"].last_wait_ms == 2000.0 and k["9"].query is None
    w = {r.pid: r for r in A.waits(msgs, facts.lock_details(e), facts.deadlocks(e), st).collect()}
    assert (w["2"].blocking_pid, w["2"].relation, w["2"].blocking_query) == ("1", "acc", "update a set b = 1")
    assert w["9"].event_type == "deadlock"
    assert server.blockers(A.waits(msgs, facts.lock_details(e), facts.deadlocks(e), st)).first().blocked == 1


def test_sessions(lines):
    c = facts.connection_events(entries_from_lines(lines(STDERR)))
    p = server.peak(c).first()
    assert p.peak == 2 and p.peak_ts == datetime(2025, 1, 1, 10, 0, 4)
    s = facts.sessions(c)
    assert server.session_stats(s).first().median_us == 600e6
    assert [r["count"] for r in server.session_distribution(s).orderBy("bucket_index").collect()] == [0, 0, 1, 0, 0, 0]
    assert max(r.most for r in server.concurrent_hist(s).collect()) == 1


def test_checkpoint_kind_is_used_once(lines):
    text = """
2025-01-01 10:00:00 UTC [9]: LOG:  checkpoint starting: wal
2025-01-01 10:00:05 UTC [9]: LOG:  checkpoint complete: wrote 5 buffers (0.0%); total=0.5 s
2025-01-01 10:00:09 UTC [9]: LOG:  checkpoint complete: wrote 6 buffers (0.0%); total=0.5 s
"""
    got = A.checkpoint_kinds(facts.checkpoints(entries_from_lines(lines(text)))).orderBy("seq").collect()
    assert [r.kind for r in got] == ["wal", "unknown"]


def test_filters(lines):
    e = entries_from_lines(lines(STDERR))
    assert Filters(db=["a"]).apply(e).count() == 6
    assert Filters(exclude_user=["u"]).apply(e).count() == 4
    assert Filters(TimeRange(begin="2025-01-01 10:00:03", window="1m")).apply(e).count() == 2
    assert Filters(TimeRange(last="10s", now=datetime(2025, 1, 1, 10, 10, 6))).apply(e).count() == 5
    with pytest.raises(ValueError):
        TimeRange(last="1h", begin="2025-01-01 10:00:00").bounds()
    assert parse_duration("7d").days == 7
    with pytest.raises(ValueError):
        parse_duration("soon")


def write(path, data, how=None):
    if how == "gz":
        path.write_bytes(gzip.compress(data))
    elif how == "zst":
        import zstandard

        path.write_bytes(zstandard.compress(data))
    elif how == "zip":
        with zipfile.ZipFile(path, "w") as z:
            z.writestr("in/a.log", data)
    elif how == "tgz":
        with tarfile.open(path, "w:gz") as t:
            info = tarfile.TarInfo("a.log")
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))
    else:
        path.write_bytes(data)
    return str(path)


def test_formats_agree(spark, tmp_path, lines):
    from logquarry.sources.inputs import read_entries

    data = STDERR.lstrip("\n").encode()
    want = messages(entries_from_lines(lines(STDERR)))
    for name, how in (("a.log", None), ("b.log.gz", "gz"), ("c.log.zst", "zst"), ("c.log.zstd", "zst"), ("d.zip", "zip"), ("e.tgz", "tgz")):
        assert messages(read_entries(spark, [write(tmp_path / name, data, how)])) == want, name
    both = read_entries(spark, [str(tmp_path / "a.log"), str(tmp_path / "d.zip")])
    assert both.count() == 2 * len(want)


CSV = """2025-01-01 10:00:00.000 UTC,"u","a",11,"1.2.3.4:5",s,1,SELECT,2025-01-01 09:00:00 UTC,1/1,0,LOG,00000,"duration: 12.5 ms  statement: SELECT 1
FROM t",,,,,,,,,"x","client backend",,0
2025-01-01 10:00:01.000 UTC,"u","a",12,"1.2.3.4:5",s,2,SELECT,2025-01-01 09:00:00 UTC,1/1,0,ERROR,42P01,"relation ""t9"" does not exist",,,,,,"SELECT * FROM t9",15,,"x","client backend",,0
"""


def test_csv_and_json(spark, tmp_path):
    from logquarry.sources.inputs import read_entries

    c = read_entries(spark, [write(tmp_path / "a.csv", CSV.encode())]).orderBy("seq").collect()
    assert c[0].message == "[11]: user=u,db=a,app=x,client=1.2.3.4:5 LOG: duration: 12.5 ms  statement: SELECT 1\nFROM t"
    assert c[1].message.endswith("QUERY: SELECT * FROM t9 SQLSTATE = '42P01'") and c[1].pid == "12"
    rows = [
        {"timestamp": "2025-01-01 10:00:00.000 UTC", "user": "u", "dbname": "a", "pid": 11, "application_name": "x", "remote_host": "1.2.3.4", "error_severity": "LOG", "message": "duration: 12.5 ms  statement: SELECT 1"},
        {"logger": "postgres", "logging_pod": "p", "record": {"log_time": "2025-01-01 10:00:01 UTC", "user_name": "u", "database_name": "a", "process_id": "12", "connection_from": "1.2.3.4:77", "error_severity": "ERROR", "sql_state_code": "42P01", "message": "boom"}},
        {"logger": "instance-manager", "logging_pod": "p", "msg": "skip"},
        {"timestamp": "2025-01-01T10:00:02Z", "insertId": "i", "textPayload": "LOG:  hello"},
    ]
    want = ["[11]: user=u,db=a,app=x,client=1.2.3.4 LOG: duration: 12.5 ms  statement: SELECT 1", "[12]: user=u,db=a,client=1.2.3.4 ERROR: boom SQLSTATE = '42P01'", "LOG:  hello"]
    text = "\n".join(map(json.dumps, rows)) + "\n{bad\n"
    assert messages(read_entries(spark, [write(tmp_path / "a.jsonl", text.encode())])) == want
    assert messages(read_entries(spark, [write(tmp_path / "b.json", json.dumps(rows).encode())])) == want
    packed = read_entries(spark, [write(tmp_path / "z.csv.gz", CSV.encode(), "gz")])
    assert packed.count() == 2


def test_detection(tmp_path, spark):
    from logquarry.sources import detect
    from logquarry.sources.storage import Storage

    assert detect.is_rotated("x.log.2026-03-23") and not detect.is_rotated("x.log.old")
    assert detect.detect_text(CSV.encode(), "x") == "csv" and detect.detect_text(STDERR.encode()) == "log"
    assert detect.detect_text(b'[{"timestamp": "x"}, {"time', "x") == "json"
    for bad in (b"", b"\0\0", b"plain words"):
        with pytest.raises(detect.UnknownFormat):
            detect.detect_text(bad, "x")
    with pytest.raises(detect.UnknownFormat):
        detect.detect_text(STDERR.encode(), "x.csv")
    (tmp_path / "a.log").write_text("x")
    (tmp_path / "b.txt").write_text("x")
    assert detect.collect_files([str(tmp_path)], Storage(spark)) == [str(tmp_path / "a.log")]
    assert detect.collect_files([f"file://{tmp_path}/*.log", str(tmp_path / "b.txt")], Storage(spark)) == [f"file:{tmp_path}/a.log", str(tmp_path / "b.txt")]
    with pytest.raises(FileNotFoundError):
        detect.collect_files([str(tmp_path / "none*")], Storage(spark))
    assert detect.syslog_flavour("Jan  1 10:00:00 h p") == "bsd"


def test_report_and_renderers(lines):
    from logquarry.render.formats import FORMATS
    from logquarry.report import Report, build

    e = entries_from_lines(lines(STDERR)).cache()
    report = build(e, full=True, events=True)
    assert report["summary"]["total_logs"] == 9 and report["sql_performance"]["total_queries_parsed"] == 2
    assert report["errors"][0]["messages"][0]["message"] == "relation ? does not exist"
    for f in FORMATS.values():
        assert "relation ? does not exist" in f(report)
    id_ = report["sql_performance"]["slowest_queries"][0]["id"]
    assert Report(e).sql_detail([id_])[0]["statistics"]["count"] == 1
    assert list(build(e, ["events"])) == ["events"]
    with pytest.raises(ValueError):
        build(e.where("false"))
    with pytest.raises(ValueError):
        build(e, ["nonsense"])


def test_units():
    from logquarry.render import units

    assert [units.time_ms(x) for x in (99.192, 1500, 61_000, 3_661_000, 90_000_000)] == ["99 ms", "1.50 s", "1m 01s", "1h 01m 01s", "1d 1h 00m"]
    assert [units.size(x) for x in (5, 2048, 3 << 20, 5 << 40)] == ["5 B", "2.00 KB", "3.00 MB", "5.00 TB"]
    assert units.bar(80, 80) == "■" * 40


def test_follow_and_stream(spark, tmp_path):
    from logquarry.streaming import follow as S

    path = write(tmp_path / "a.log", STDERR.lstrip("\n").encode())
    out = tmp_path / "report.txt"
    n = S.follow(spark, [path], interval=0, output=str(out), last="1h", cycles=2, now=lambda: datetime(2025, 1, 1, 10, 30), sections=["summary"])
    assert n == 2 and "Total logs" in out.read_text()
    folder = tmp_path / "in"
    folder.mkdir()
    write(folder / "a.log", STDERR.lstrip("\n").encode())
    q = S.stream_query_stats(S.stream_lines(spark, str(folder))).writeStream.format("memory").queryName("stats").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert {r.norm_query: r["count"] for r in spark.sql("select * from stats").collect()}["commit"] == 1


def test_cli(tmp_path, capsys, spark):
    from logquarry import cli

    path = write(tmp_path / "a.log", STDERR.lstrip("\n").encode())
    assert cli.main([path, "--summary", "--json", "--dbname", "a"]) == 0
    assert json.loads(capsys.readouterr().out)["summary"]["total_logs"] == 4
    assert cli.main([path, "--begin", "2030-01-01 00:00:00"]) == 1
    with pytest.raises(SystemExit):
        cli.main([path, "--last", "1h", "--begin", "2025-01-01 00:00:00"])


def test_registry_holds_together():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) > 80


def test_bins(lines, spark):
    from logquarry.plans import bins

    x = facts.executions(entries_from_lines(lines(STDERR)))
    assert bins.interval(x).first().width_us == 60_000_000
    b = bins.binned(x, F.sum("duration_ms").alias("ms"))
    assert b.first()["count"] == 2 and bins.upper_median(b).first().median == 2


def _orders(spark, tmp_path, rows):
    path = str(tmp_path / "sf")
    schema = "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp"
    spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{path}/orders.parquet")
    return path


def test_orders_at_one_moment_stay_apart(spark, tmp_path):
    """Keys that are equal modulo a day of seconds and 64: their lines had one number, and a lock, its context and a deadlock went to several waits."""
    from logquarry.dialect_queries import QUERIES

    day = datetime(1996, 1, 2)
    path = _orders(spark, tmp_path, [(5, 1, "F", 10.0, day), (5 + 86400, 2, "P", 20.0, day), (5 + 2 * 86400, 3, "O", 40.0, day)])
    got = {r.pid: (r.relation, r.wait_ms) for r in QUERIES["relation_ctx"](spark, path).collect()}
    assert got == {"5": ("acc_1", 10.0), "86405": ("", 20.0), "172805": ("", 40.0)}
    assert {(r.event_type, r["count"], r.wait_ms) for r in QUERIES["deadlock_mark"](spark, path).collect()} == {("waiting", 2, 50.0), ("deadlock", 1, 20.0)}
    assert [(r.relation, r["count"]) for r in QUERIES["lock_relations"](spark, path).collect()] == [("acc_1", 1)]


def test_next_statement_takes_one_pass(lines):
    """A frame from the next row to the end of the process is computed anew for each row: 150000 statements of a process took their square."""
    e = entries_from_lines(lines(STDERR))
    st, temps, msgs = facts.statements(e), facts.temp_events(e), facts.lock_messages(e)
    for df in (A.temp_file_query(temps, st), A.locks(msgs, st)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "specifiedwindowframe(RowFrame" in plan and "unboundedfollowing" not in plan


def test_next_statement_is_the_nearest(lines):
    text = """
2025-01-01 10:00:00 UTC [1]: LOG:  temporary file: path "a", size 10
2025-01-01 10:00:00 UTC [1]: LOG:  process 1 still waiting for ShareLock on relation 1 after 1.0 ms
2025-01-01 10:00:01 UTC [1]: STATEMENT:  select 1
2025-01-01 10:00:02 UTC [1]: STATEMENT:  select 2
"""
    e = entries_from_lines(lines(text))
    st = facts.statements(e)
    assert A.temp_file_query(facts.temp_events(e), st).first()["query"] == "select 1"
    assert A.locks(facts.lock_messages(e), st).first()["query"] == "select 1"


def test_work_at_one_moment_stays_apart(spark, tmp_path):
    """Two items whose lines had one number: the holder of each lock runs a statement of its own."""
    from logquarry.queries import QUERIES

    rows = [(k, p, 1, 2, "A", 4.0, price, datetime(1996, 1, 2)) for k, p, price in ((1, 1, 10.0), (1 + 86400, 1001, 40.0))]
    schema = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_returnflag string, l_quantity double, l_extendedprice double, l_shipdate timestamp"
    path = str(tmp_path / "sf")
    spark.createDataFrame(rows, schema).write.parquet(f"{path}/lineitem.parquet")
    assert sorted((r.blocked, r.total_ms) for r in QUERIES["blockers"](spark, path).collect()) == [(1, 10.0), (1, 40.0)]
    got = QUERIES["blocking_pid"](spark, path).collect()
    assert len({r.pid for r in got}) == 2 and [(r.blocking_pid, r.event_type) for r in got] == [("2", "waiting")] * 2


def test_parse_stays_small(spark):
    """A generated method of more than 8000 bytes is never compiled: all dialects in one took 16912, and each line was parsed by the interpreter."""
    import re

    from logquarry.operators import assemble

    plans, staged = [], assemble.staged
    lines = spark.createDataFrame([(0, 0, 1, "2025-01-01 10:00:00 UTC [1]: LOG:  x")], "file_idx int, split_start long, line_no long, line string")
    assemble.staged = lambda df: plans.append(df) or staged(df)
    try:
        entries_from_lines(lines).collect()
    finally:
        assemble.staged = staged
    text = spark._jvm.PythonSQLUtils.explainString(plans[0]._jdf.queryExecution(), "codegen")
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", text)]
    assert sizes and max(sizes) < 8000


def test_work_is_sorted_once(lines):
    """The statement before and the one after come from one order of a process's rows; two orders sorted all rows twice."""
    e = facts.work(entries_from_lines(lines(STDERR)))
    st, temps, msgs = facts.statements(e), facts.temp_events(e), facts.lock_messages(e)
    for df in (A.temp_file_query(temps, st), A.locks(msgs, st)):
        assert df._jdf.queryExecution().optimizedPlan().toString().count("Window [") == 1
    plan = A.waits(msgs, facts.lock_details(e), facts.deadlocks(e), st)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan


def test_first_of_a_kind_is_no_join(lines):
    """Statements before the first temporary file or lock are left out by its number; a join with it parsed all lock messages once more. Locks meet by hashes, not by a sort."""
    e = facts.work(entries_from_lines(lines(STDERR + "2025-01-01 11:00:00 UTC [1]: LOG:  process 1 still waiting for ShareLock on relation 1 after 1.0 ms\n")))
    st, temps, msgs = facts.statements(e), facts.temp_events(e), facts.lock_messages(e)
    for df in (A.temp_file_query(temps, st), A.locks(msgs, st)):
        assert "Join" not in df._jdf.queryExecution().optimizedPlan().toString()
    plan = A.locks(msgs, st).select("query", "seq", "acquired", "last_wait_ms")._jdf.queryExecution().sparkPlan().toString()
    assert "SortAggregate" not in plan and "HashAggregate" in plan


def test_no_lock_and_no_temporary_file(lines):
    e = entries_from_lines(lines("2025-01-01 10:00:00 UTC [1]: STATEMENT:  select 1\n"))
    st = facts.statements(e)
    assert A.temp_file_query(facts.temp_events(e), st).count() == 0 and A.locks(facts.lock_messages(e), st).count() == 0


def test_clock_is_rendered_once(spark):
    """Each text of a row rendered its time anew."""
    from logquarry import samples

    plan = samples.work_log(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("date_format") == 1


def test_heads_of_lines(lines):
    text = "2025-01-01 10:00:00.25\tUTC\t[1]: LOG:  größer 😀 statement: select 'é'\n2025-01-01 10:00:01 UTC\n2025-01-01 10:00:02 +02 [2]: LOG:  é\n"
    got = [(str(r.ts), r.message, r.pid) for r in entries_from_lines(lines(text)).orderBy("seq").collect()]
    assert [g[1:] for g in got] == [("[1]: LOG:  größer 😀 statement: select 'é'", "1"), ("", ""), ("[2]: LOG:  é", "2")]
    assert got[0][0].endswith("10:00:00.250000")


WORK = """
2025-01-01 10:00:00 UTC [1]: LOG:  duration: 1.0 ms  execute p1: select  0
2025-01-01 10:00:01 UTC [2]: LOG:  temporary file: path "base/a", size 10
2025-01-01 10:00:02 UTC [2]: STATEMENT:  commit
2025-01-01 10:00:03 UTC [2]: STATEMENT:  select 2
2025-01-01 10:00:04 UTC [3]: LOG:  temporary file: path "base/b", size 20 STATEMENT: select 3
2025-01-01 10:00:05 UTC LOG:  temporary file: path "base/c", size 30 QUERY: select 4
2025-01-01 10:00:06 UTC [5]: LOG:  process 5 still waiting for ShareLock on transaction 9 after 10.5 ms
2025-01-01 10:00:07 UTC [5]: DETAIL:  Process holding the lock: 1. Wait queue: 5.
2025-01-01 10:00:08 UTC [5]: CONTEXT:  while updating tuple (0,1) in relation "acc"
2025-01-01 10:00:09 UTC [5]: STATEMENT:  update acc set a = 1
2025-01-01 10:00:10 UTC [5]: LOG:  process 5 acquired ShareLock on transaction 9 after 12 ms
2025-01-01 10:00:11 UTC [6]: ERROR:  deadlock detected
2025-01-01 10:00:12 UTC [7]: LOG:  process 7 acquired nothing
"""


@pytest.mark.parametrize("more", ["", "2025-01-01 10:00:13 UTC [5]: STATEMENT:  select 8\n\tfrom t\n\t, temporary file path size 7"])
def test_work_items_are_made_of_lines(lines, more):
    """Messages were written before statements, temporary files and locks were looked for in them. Lines that go on belong to them."""
    text = lines(WORK + more)
    e = entries_from_lines(text)
    w = entries_from_lines(text, items=facts.work_items("temp", "statement", "lock", "detail", "deadlock"))
    assert "message" not in w.columns
    rows = lambda df: sorted(str([v or "" for v in r]) for r in df.collect())
    both = [(facts.statements(e), facts.statements_of(w)), (facts.temp_events(e), facts.temps_of(w)), (facts.lock_messages(e), facts.lock_messages_of(w)), (facts.lock_details(e), facts.lock_details_of(w)), (facts.deadlocks(e), facts.deadlocks_of(w))]
    for (a, b), n in zip(both, (6 + bool(more), 3 + bool(more), 2, 2, 1)):
        assert a.columns == b.columns and a.count() == n and rows(a) == rows(b)
    st, msgs = facts.statements_of(w), facts.lock_messages_of(w)
    assert rows(A.locks(msgs, A.near(st, msgs))) == rows(A.locks(msgs, st)) == rows(A.locks(both[2][0], both[0][0]))
    assert rows(A.temp_file_query(facts.temps_of(w), st)) == rows(A.temp_file_query(both[1][0], both[0][0]))


def test_statements_near_locks(spark):
    """No statement of a process that has a lock is left out, and few others are kept: all statements were sorted with the locks."""
    st = spark.range(100_000).selectExpr("cast(id as string) pid", "id seq")
    few = st.where("seq % 50 = 0")
    got = A.near(st, few)
    assert got.columns == st.columns and got.where("seq % 50 = 0").count() == 2000 and got.count() < 2200
    assert A.near(st, few.where("false")).count() == 0


def test_plain_texts_need_no_tokens(spark):
    from logquarry.functions import server as V
    from logquarry.functions import sql as Q

    texts = ["SELECT  'a\t''b' ,\n-5.x1 FROM É_9 WHERE a-5 = $1 AND pg_temp_3_4.x='", 'select "A 1\'", 1', "9x x9 1._5 --5", "", "pg_toast_12"]
    got = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(Q.normalize_query(F.col("t"))).collect()]
    assert got == ["select ? , ?x1 from É_9 where a-? = ? and pg_temp_?.x=?", 'select "a 1\'", ?', "?x x9 ?_5 -?", "", "pg_toast_?"]
    odd = ["process 5 acquired A on b after 1", "x\nprocess 9 x process 5 still waiting for A\x1f on b\nc after .5 process 6 acquired C on d after 2.", "process 5 acquired A on b after x", "process 6 acquired C\x1fD on d after 2. ms\n"]
    parts = [list(r[0]) for r in spark.createDataFrame([(i, t) for i, t in enumerate(odd)], "i int, t string").orderBy("i").select(V.lock_parts(F.col("t"))).collect()]
    assert parts[0] == ["5", "acquired", "A", "b", "1"] and parts[1] == ["6", "acquired", "C", "d", "2."] and parts[2] == [""] * 5 and parts[3] == ["6", "acquired", "C\x1fD", "d", "2."]
    plan = spark.range(1).select(V.lock_parts(F.lit("x"))).schema
    assert plan[0].dataType.simpleString() == "array<string>"
