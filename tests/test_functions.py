import base64
import hashlib

import pytest
from pyspark.sql import functions as F

from logquarry.functions import events, server, sql, text


def one(spark, fn, values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.x for r in rows.select("i", fn(F.col("v")).alias("x")).orderBy("i").collect()]


CASES = [
    (text.pid, {"[12]: x": "12", "[12-1]: x [99]": "12", "[a] [3]": "", "none": ""}),
    (lambda c: text.filter_value(c, "app"), {"user=a,app=My App,client=h LOG:  x": "My App", "app=psql LOG: q": "psql", "db=x": "", "u=1,app=last one LOG:  x": "last one", "app=\"q\" x": "q"}),
    (lambda c: text.entity(c, "user"), {"user=bob db=x": "bob", "user=[unknown] x": "", "user=unknown,": "UNKNOWN", "user= user=al": "al", "user=%u,": "", "x": ""}),
    (lambda c: text.entity(c, "host"), {"client=1.2.3.4(55) x": "1.2.3.4", "host=name:54 x": "name", "host=::1 x": "::1"}),
    (lambda c: text.entity(c, "app"), {"user=a,app=My App LOG:  x": "My App", "app=one two": "one"}),
    (lambda c: text.prefix_field(c, "db"), {"db=a x db=b,": "b", "mydb=a x": "", "x" * 250 + " db=a": ""}),
    (lambda c: text.session_entity(c, "db"), {"user=a database=d1 db=d2": "d1", "db=d2": "d2"}),
    (lambda c: text.truncate(c, 6), {"abcdef": "abcdef", "abcdefg": "abc..."}),
    (sql.duration_ms, {"duration: 12.5 ms  x": 12.5, "duration: x ms": None, "no": None}),
    (sql.executed_query, {"LOG:  duration: 1 ms  statement: SELECT 1": "SELECT 1", "LOG:  duration: 1 ms  execute a: begin": "begin", "LOG:  duration: 1 ms  parse a: begin": None, "duration: 1 ms  st": None}),
    (sql.is_plan, {"duration: 1 ms  plan: Seq Scan": True, "duration: 1 ms  statement: plan: x": False, "plan: x": False}),
    (sql.plan_text, {"duration: 1 ms  plan: Query Text: select 1 Seq Scan on t": "Seq Scan on t", "plan:\nQuery Text: s\n  Result x": "Result x"}),
    (
        sql.normalize_query,
        {
            "SELECT  'a''b', -1.5, x1 FROM \"T\"": "select ?, ?, x1 from \"t\"",
            "where a=$1 and b= 'x": "where a=? and b= ?",
            "table2 order_2023 5": "table2 order_2023 ?",
            "from pg_temp_1_2.x": "from pg_temp_?.x",
            "É = 1": "É = ?",
            "": "",
        },
    ),
    (sql.query_prefix, {"select 1": "se-", "/* a /* b */ c */ Insert x": "in-", "-- x\nupdate y": "up-", "foo": "xx-", "SET x": "se-", "DOxyz": "do-", "": "xx-"}),
    (sql.query_type, {"SET x": "SET", "truncate t": "TRUNCATE", "zzz": "OTHER"}),
    (sql.query_type_from_id, {"se-abc": "SELECT", "xx-abc": "OTHER"}),
    (sql.statement_text, {"STATEMENT:  select 1 ": "select 1", "duration: 1 ms  execute a: x": "x", "x QUERY: q": "q", "x": ""}),
    (sql.context_statement, {'CONTEXT:  SQL statement "select 1"': "select 1", "x": ""}),
    (sql.is_transaction_command, {"BEGIN": True, "Begin": False, "end": True, "select": False}),
    (events.severity, {"LOG:  x": "LOG", "[1]: ERROR:  x": "ERROR", "a LOG: b PANIC: c": "PANIC", "x": None}),
    (events.sqlstate, {"x SQLSTATE = '42P01'": "42P01", "ERROR: 23505: dup": "23505", "[1] 57014 x": "57014", "SQLSTATE = '9zzzz'": "", "x": ""}),
    (
        events.normalize_event,
        {
            'ERROR:  relation "users" does not exist at character 15': "relation ? does not exist",
            "ERROR: d'exécution 5 fois": "d'exécution ? fois",
            "ERROR: value 'x''y' in t5 DETAIL: more": "value ? in t5",
            "ERROR: Key (a)=(b) exists": "Key (?)=(?) exists",
            "short: text": "text",
        },
    ),
    (server.temp_size, {'temporary file: path "x", size 15': 15, "size": 0}),
    (server.resource_type, {"relation 5 of": "relation", "advisory lock [1]": "advisory lock", "abc": "unknown", "object 5": "object", "userlock": "userlock"}),
    (server.blocking_pid, {"DETAIL:  Process holding the lock: 12. Wait": "12", "Process holding the lock: 1, 2. x": "", "x": ""}),
    (server.session_us, {"session time: 1:02:03.004 u": 3723004000, "session time: 0:61:00.0 u": 0, "x": 0}),
    (server.warning_interval, {"too frequently (7 seconds apart)": 7, "x": None}),
    (server.vacuum_table, {'table "a.b.c": x': "a.b.c", "x": "UNKNOWN", 'table ""': "UNKNOWN"}),
    (server.removed_pages, {"pages: 12 removed": 12, "x": 0}),
]


@pytest.mark.parametrize("k", range(len(CASES)))
def test_scalar(spark, k):
    fn, table = CASES[k]
    assert one(spark, fn, list(table)) == list(table.values())


def test_lock_event(spark):
    got = one(spark, server.lock_event, ["process 5 still waiting for ShareLock on transaction 9 after 10.5 ms", "process 5 acquired X on tuple after 3 ms", "x"])
    assert tuple(got[0]) == ("waiting", "5", "ShareLock", "transaction 9", 10.5)
    assert got[1].event_type == "acquired" and got[2].wait_ms is None


def test_checkpoint_fields(spark):
    got = one(spark, server.checkpoint_fields, ["checkpoint complete: wrote 7 buffers (1%); total=1.25 s; distance=3 kB, estimate=4 kB", "x"])
    assert tuple(got[0]) == (1.25, 7, 3, 4) and got[1].buffers is None


def test_query_id_matches_its_definition(spark):
    raw, norm = "SELECT 1", "select ?"
    digest = base64.b64encode(hashlib.md5(norm.encode()).digest()).decode()
    want = "se-" + "".join(c for c in digest if c not in "+/=")[:6]
    df = spark.createDataFrame([(raw, norm)], "r string, n string")
    assert df.select(sql.query_id(F.col("r"), F.col("n"))).first()[0] == want
