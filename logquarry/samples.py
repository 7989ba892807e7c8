"""Log lines rendered from relational tables, inside Spark: inputs with known answers, of any size.

Each function returns ``lines`` (file_idx, split_start, line_no, line). Lines follow the time, so
what the engine must find is a plain query over the base columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.withColumns({c: F.col(c).cast("timestamp") for c, kind in df.dtypes if kind == "timestamp_ntz"})


def _clock(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss.SSSSSS")


#: A day is a split of the file; so many lines fit in one.
DAY_SHIFT = 28


def _lines(df: DataFrame, ts: str, keys: list, texts: list[Column], parts: dict[str, Column] | None = None) -> DataFrame:
    """Rows with texts become lines in the order of (ts, keys), which tell rows apart. Lines are counted in a day, so no two have one number.

    parts: columns that several texts are made of, rendered once for a row when it has its place.
    """
    day = F.expr("us div 86400000000")
    rows = df.withColumn("us", F.unix_micros(ts)).withColumn("day", day).where("day is not null")
    rows = rows.withColumn("at", F.row_number().over(Window.partitionBy("day").orderBy("us", *keys))).withColumns(parts or {})
    out = rows.select("day", "at", F.posexplode(F.array(*texts)).alias("k", "line")).where("line is not null")
    return out.select(F.lit(0).alias("file_idx"), F.shiftleft("day", DAY_SHIFT).alias("split_start"), (F.col("at").cast("long") * len(texts) + F.col("k")).alias("line_no"), "line")


def _s(*parts) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def event_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as the fields of log entries: an execution each (value as milliseconds), errors as ERROR or FATAL with their statement.

    ts, event_id, pid, db, usr, app, host, sev, body, tail (a second line of the statement), code, statement (of an error).
    """
    e = table(spark, sf_dir, "events")
    uid, kind, eid = F.col("user_id").cast("string"), F.col("event_type"), F.col("event_id").cast("string")
    part = lambda before, n: _s(before, (F.col("user_id") % n).cast("string"))
    ms = F.format_string("%.3f", F.col("value"))
    query = (
        F.when(kind == "click", _s("SELECT * FROM clicks WHERE id = ", eid, " AND name = 'n''", uid, "'"))
        .when(kind == "view", _s("select  count(*) from view_", (F.col("user_id") % 2).cast("string"), " where x in (", uid, ", ", eid, ")"))
        .when(kind == "signup", _s("INSERT INTO signups VALUES (", eid, ", 'a b', ", ms, ")"))
        .when(kind == "purchase", F.when(F.col("user_id") % 2 == 0, _s("/* c */ UPDATE purchases SET total = ", ms, " WHERE user_id = $1")).otherwise(F.lit("COMMIT")))
    )
    run = _s("duration: ", ms, " ms  ", F.when(F.col("event_id") % 2 == 0, "statement: ").otherwise("execute s1: "), query)
    text = F.when(F.col("user_id") % 2 == 0, _s('relation "t', uid, '" does not exist at character ', eid)).otherwise(_s('duplicate key value violates unique constraint "k', uid, '"'))
    failed = kind == "error"
    return e.select(
        "ts", "event_id", (F.col("user_id") + 1000).cast("string").alias("pid"), part("db", 4).alias("db"), part("u", 10).alias("usr"), part("svc", 3).alias("app"), part("10.0.0.", 5).alias("host"),
        F.when(~failed, "LOG").when(F.col("user_id") % 3 == 0, "FATAL").otherwise("ERROR").alias("sev"), F.when(failed, text).otherwise(run).alias("body"),
        F.when((kind == "click") & (F.col("event_id") % 5 == 0), "ORDER BY 1").alias("tail"), F.when(~failed, "00000").when(F.col("user_id") % 2 == 0, "42P01").otherwise("23505").alias("code"), F.when(failed, _s("SELECT ", eid)).alias("statement"),
    )


def _texts(head: Column, between: str = "  ") -> list[Column]:
    """A line for the entry and one for the statement of an error, after a head; severities and text as the server writes them."""
    code = F.when(F.col("code") != "00000", _s(" SQLSTATE = '", F.col("code"), "'")).otherwise("")
    return [_s(head, F.col("sev"), ":", between, F.col("body"), code), F.when(F.col("statement").isNotNull(), _s(head, "STATEMENT:", between, F.col("statement")))]


def _who() -> Column:
    return _s("db=", F.col("db"), ",user=", F.col("usr"), ",app=", F.col("app"), ",client=", F.col("host"))


def sql_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_parts as a log of the server's standard error."""
    entry, statement = _texts(_s(F.col("clock"), " UTC [", F.col("pid"), "]: ", _who(), " "))
    return _lines(event_parts(spark, sf_dir), "ts", ["event_id"], [entry, _s("\t", F.col("tail")), statement], {"clock": _clock(F.col("ts"))})


def rds_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_parts in the lines of a managed service: time, host(port), user@db, [process]."""
    entry, statement = _texts(_s(_clock(F.col("ts")), " UTC:", F.col("host"), "(5432):", F.col("usr"), "@", F.col("db"), ":[", F.col("pid"), "]:"))
    return _lines(event_parts(spark, sf_dir), "ts", ["event_id"], [entry, _s("\t", F.col("tail")), statement])


def azure_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_parts in lines that name a session, and no process or client."""
    entry, statement = _texts(_s(_clock(F.col("ts")), " UTC-65f.", F.hex("event_id"), "-"))
    return _lines(event_parts(spark, sf_dir), "ts", ["event_id"], [entry, _s("\t", F.col("tail")), statement])


def syslog(flavour: str):
    """A function that renders event_parts as syslog: bsd, iso or rfc5424; a second line is a part with a number of its own."""

    def render(spark: SparkSession, sf_dir: str) -> DataFrame:
        ts, pid = F.col("ts"), F.col("pid")
        month = F.element_at(F.array(*[F.lit(m) for m in "Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split()]), F.month(ts))
        iso = _s(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), "Z")
        head = {
            "bsd": _s(month, " ", F.lpad(F.dayofmonth(ts).cast("string"), 2, " "), " ", F.date_format(ts, "HH:mm:ss.SSSSSS"), " db1 postgres[", pid, "]: "),
            "iso": _s(iso, " db1 postgres[", pid, "]: "),
            "rfc5424": _s("<134>1 ", iso, " db1 postgres ", pid, " - - "),
        }[flavour]
        number = F.col("event_id").cast("string")
        entry, _ = _texts(_s(head, "[", number, "-1] ", _who(), " "))
        _, statement = _texts(_s(head, "[", number, "1-1] ", _who(), " "))
        return _lines(event_parts(spark, sf_dir), "ts", ["event_id"], [entry, _s(head, "[", number, "-2] #011", F.col("tail")), statement])

    return render


def marked_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sql_log as a relay writes it that numbers no parts: a second line has a header and a tab marker, and lines of another tool stand between."""
    head = _s(_clock(F.col("ts")), " UTC [", F.col("pid"), "]: ", _who(), " ")
    entry, statement = _texts(head)
    return _lines(event_parts(spark, sf_dir), "ts", ["event_id"], [entry, _s(head, "#011", F.col("tail")), statement])


def csv_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_parts as csvlog: 23 fields, quotes doubled, a second line inside the quotes; and rows that are too short."""
    from logquarry.constants import CSV_COLUMNS

    quoted = lambda c: _s('"', F.replace(c, F.lit('"'), F.lit('""')), '"')
    own = {
        "log_time": _s(_clock(F.col("ts")), " UTC"), "user_name": quoted(F.col("usr")), "database_name": quoted(F.col("db")), "process_id": F.col("pid"), "connection_from": quoted(F.col("host")),
        "error_severity": F.col("sev"), "sql_state_code": F.col("code"), "query": F.coalesce(quoted(F.col("statement")), F.lit("")), "application_name": quoted(F.col("app")),
    }
    at = CSV_COLUMNS.index("message")
    before = F.concat_ws(",", *[own.get(c, F.lit("")) for c in CSV_COLUMNS[:at]])
    after = F.concat_ws(",", *[own.get(c, F.lit("")) for c in CSV_COLUMNS[at + 1 : 23]])
    body = F.replace(F.col("body"), F.lit('"'), F.lit('""'))
    one = _s(before, ',"', body, F.when(F.col("tail").isNull(), _s('",', after)).otherwise(""))
    short = F.when(F.col("event_id") % 50 == 0, _s(_clock(F.col("ts")), " UTC,a,b,1,c,LOG,a row that is cut off"))
    return _lines(event_parts(spark, sf_dir), "ts", ["event_id"], [one, _s("\t", F.col("tail"), '",', after), short])


def _json(spark: SparkSession, sf_dir: str, *texts: Column) -> DataFrame:
    return _lines(event_parts(spark, sf_dir), "ts", ["event_id"], list(texts))


def _full() -> Column:
    return F.when(F.col("tail").isNull(), F.col("body")).otherwise(_s(F.col("body"), "\n\t", F.col("tail")))


def json_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_parts as jsonlog, an object a line; and lines that are cut off."""
    fields = {"timestamp": _s(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"), " UTC"), "user": F.col("usr"), "dbname": F.col("db"), "pid": F.col("pid").cast("long"), "remote_host": F.col("host"), "application_name": F.col("app"), "error_severity": F.col("sev"), "state_code": F.col("code"), "message": _full(), "statement": F.col("statement")}
    cut = F.when(F.col("event_id") % 40 == 0, F.lit('{"timestamp": "2024-01-01 00:00:00 UTC", "mess'))
    return _json(spark, sf_dir, F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()])), cut)


def _record() -> Column:
    fields = {"log_time": _s(_clock(F.col("ts")), " UTC"), "user_name": F.col("usr"), "database_name": F.col("db"), "process_id": F.col("pid"), "connection_from": _s(F.col("host"), ":5432"), "error_severity": F.col("sev"), "sql_state_code": F.col("code"), "message": _full(), "application_name": F.col("app"), "query": F.col("statement")}
    return F.struct(*[v.alias(k) for k, v in fields.items()])


def operator_log(wrapped: bool = False):
    """A function that renders event_parts as a cluster operator's log: records in an envelope (in another one, if wrapped), among lines of other loggers."""

    def render(spark: SparkSession, sf_dir: str) -> DataFrame:
        own = F.struct(F.lit("info").alias("level"), F.lit("postgres").alias("logger"), F.lit("record").alias("msg"), F.lit("db-1").alias("logging_pod"), _record().alias("record"))
        other = F.struct(F.lit("info").alias("level"), F.lit("instance-manager").alias("logger"), F.lit("db-1").alias("logging_pod"), F.lit("duration: 9999.0 ms  statement: SELECT 'not a record'").alias("msg"), _clock(F.col("ts")).alias("ts"))
        if wrapped:
            own, other = (F.struct(F.lit("F").alias("logtag"), x.alias("message")) for x in (own, other))
        return _json(spark, sf_dir, F.to_json(own), F.when(F.col("event_id") % 7 == 0, F.to_json(other)))

    return render


def payload_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_parts as a cloud's objects, whose text payload is the line of the server."""
    head = _s("[", F.col("pid"), "]: ", _who(), " ")
    entry, statement = _texts(head)
    entry = F.when(F.col("tail").isNull(), entry).otherwise(_s(entry, "\n\t", F.col("tail")))
    wrap = lambda x: F.when(x.isNotNull(), F.to_json(F.struct(F.col("event_id").cast("string").alias("insertId"), x.alias("textPayload"), _s(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), "Z").alias("timestamp"))))
    return _json(spark, sf_dir, wrap(entry), wrap(statement))


def epoch_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_parts as objects whose time is a number: milliseconds since 1970, or seconds (every other one)."""
    us = F.unix_micros("ts")
    number = F.when(F.col("event_id") % 2 == 0, F.expr("unix_micros(ts) div 1000")).otherwise(F.expr("unix_micros(ts) div 1000000"))
    return _json(spark, sf_dir, F.when(us.isNotNull(), F.to_json(F.struct(number.alias("ts"), F.col("pid").alias("pid"), F.col("sev").alias("error_severity"), F.col("body").alias("message")))))


def plan_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events: the plan of a statement (of every third event), then its execution."""
    e = table(spark, sf_dir, "events").where("event_type <> 'error'")
    eid, uid = F.col("event_id").cast("string"), F.col("user_id").cast("string")
    head = _s(_clock(F.col("ts")), " UTC [", uid, "]: db=d LOG:  duration: 1.000 ms  ")
    plan = F.when(F.col("event_id") % 3 == 0, _s(head, "plan: Query Text: SELECT ", eid, " Seq Scan on t", eid, "  (cost=0.00..1.00 rows=", uid, ")"))
    return _lines(e, "ts", ["event_id"], [plan, _s(head, "statement: SELECT ", eid)])


def wait_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders: a process that waits for a lock, then says where (by status F), or is told of a deadlock (by status P)."""
    o = table(spark, sf_dir, "orders").withColumn("ts", F.timestamp_micros(F.unix_micros("o_orderdate") + F.col("o_orderkey") % 86400 * 1_000_000))
    key = F.col("o_orderkey").cast("string")
    head = _s(_clock(F.col("ts")), " UTC [", key, "]: db=d ")
    wait = _s(head, "LOG:  process ", key, " still waiting for ShareLock on transaction ", F.col("o_custkey").cast("string"), " after ", F.format_string("%.2f", F.col("o_totalprice")), " ms")
    context = F.when(F.col("o_orderstatus") == "F", _s(head, 'CONTEXT:  while updating tuple (0,1) in relation "acc_', (F.col("o_custkey") % 9).cast("string"), '"'))
    dead = F.when(F.col("o_orderstatus") == "P", _s(head, "ERROR:  deadlock detected"))
    return _lines(o, "ts", ["o_orderkey"], [wait, context, dead])


def connection_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders: a connection received at the order's time plus its key in seconds, and its end after (price) milliseconds."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.timestamp_micros(F.unix_micros("o_orderdate") + F.col("o_orderkey") % 86400 * 1_000_000).alias("at"), F.round(F.col("o_totalprice") * 100).cast("long").alias("ms"), (F.col("o_orderstatus") == "O").alias("open"))
    pid = F.col("o_orderkey").cast("string")
    who = _s("user=u", (F.col("o_custkey") % 7).cast("string"), " database=db", (F.col("o_custkey") % 3).cast("string"), " host=10.1.0.", (F.col("o_custkey") % 5).cast("string"))
    start = o.select("o_orderkey", F.col("at").alias("ts"), _s(_clock(F.col("at")), " UTC [", pid, "]: LOG:  connection received: host=10.1.0.", (F.col("o_custkey") % 5).cast("string"), " port=5432").alias("line"))
    end_ts = F.timestamp_micros(F.unix_micros("at") + F.col("ms") * 1000)
    span = _s((F.expr("ms div 3600000")).cast("string"), ":", F.lpad(F.expr("ms div 60000 % 60").cast("string"), 2, "0"), ":", F.lpad(F.expr("ms div 1000 % 60").cast("string"), 2, "0"), ".", F.lpad(F.expr("ms % 1000").cast("string"), 3, "0"))
    end = o.where("not open").select("o_orderkey", end_ts.alias("ts"), _s(_clock(end_ts), " UTC [", pid, "]: LOG:  disconnection: session time: ", span, " ", who).alias("line"))
    return _lines(start.unionByName(end), "ts", [F.pmod(F.col("o_orderkey"), F.lit(256)), "o_orderkey", "line"], [F.col("line")])


def work_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem: a temporary file and its statement, and for some lines a statement of another process and a lock wait on it."""
    x = table(spark, sf_dir, "lineitem")
    x = x.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", F.col("l_quantity").cast("long").alias("q"), F.round(F.col("l_extendedprice") * 100).cast("long").alias("price"), F.timestamp_micros(F.unix_micros("l_shipdate") + (F.col("l_orderkey") % 86400) * 1_000_000 + F.col("l_linenumber") * 1000 + F.col("l_partkey") % 1000).alias("ts"))
    pid = (((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 100_000 + F.col("l_partkey")) * 10_000 + F.col("l_suppkey")).cast("string")
    parts = {"clock": _clock(F.col("ts")), "pid": pid}
    clock, pid = F.col("clock"), F.col("pid")
    other = (F.col("l_orderkey") % 50 + 1).cast("string")
    head = _s(clock, " UTC [", pid, "]: db=d,user=u LOG:  ")
    temp = _s(head, 'temporary file: path "base/pgsql_tmp/t', pid, '.0", size ', F.col("price").cast("string"))
    statement = _s(clock, " UTC [", pid, "]: db=d,user=u STATEMENT:  SELECT ", (F.col("q") % 5).cast("string"), " FROM part_", (F.col("l_partkey") % 8).cast("string"), " WHERE k = ", F.col("l_partkey").cast("string"))
    locked = F.col("q") % 4 == 0
    mode = F.when(F.col("l_linenumber") % 2 == 0, "ShareLock").otherwise("ExclusiveLock")
    resource = F.when(F.col("l_returnflag") == "R", _s("relation ", F.col("l_partkey").cast("string"), " of database 5")).when(F.col("l_returnflag") == "A", _s("transaction ", F.col("l_partkey").cast("string"))).otherwise(F.lit("tuple (0,1) of relation 7"))
    wait = F.when(locked, _s(head, "process ", pid, " still waiting for ", mode, " on ", resource, " after ", F.format_string("%.2f", F.col("price") / 100), " ms"))
    blocked = locked & (F.col("l_linenumber") > 1)
    busy = F.when(blocked, _s(clock, " UTC [", other, "]: db=d,user=h LOG:  duration: 1.000 ms  statement: SELECT 7 FROM holder_", (F.col("l_partkey") % 3).cast("string")))
    detail = F.when(blocked, _s(clock, " UTC [", pid, "]: db=d,user=u DETAIL:  Process holding the lock: ", other, ". Wait queue: ", pid, "."))
    got = F.when(locked & (F.col("q") % 8 == 0), _s(head, "process ", pid, " acquired ", mode, " on ", resource, " after ", F.format_string("%.2f", F.col("price") / 50), " ms"))
    dead = F.when(F.col("q") == 49, _s(clock, " UTC [", pid, "]: db=d,user=u ERROR:  deadlock detected"))
    return _lines(x, "ts", ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"], [temp, statement, busy, wait, detail, got, dead], parts)


def upkeep_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part: automatic vacuum and analyze; customer: checkpoints and warnings. Moments follow the keys."""
    at = lambda key, shift: F.timestamp_micros(F.lit(1_704_067_200_000_000) + F.col(key) * 600_000_000 + shift)
    p = table(spark, sf_dir, "part").withColumn("ts", at("p_partkey", 1))
    name = _s('"app.public.', F.lower(F.regexp_replace("p_brand", "[^A-Za-z0-9]", "_")), '"')
    size = F.col("p_size").cast("string")
    line = F.when(F.col("p_size") % 3 == 0, _s("automatic analyze of table ", name)).otherwise(_s("automatic vacuum of table ", name, ": index scans: 1 pages: ", size, " removed, 10 remain"))
    up = p.select("ts", _s(_clock(F.col("ts")), " UTC [77]: LOG:  ", line).alias("line"), F.lit(0).alias("tie"))
    c = table(spark, sf_dir, "customer").withColumn("ts", at("c_custkey", 2)).withColumn("end", at("c_custkey", 30_000_000))
    kind = F.when(F.col("c_nationkey") % 4 == 0, "wal").when(F.col("c_nationkey") % 4 == 1, "time").when(F.col("c_nationkey") % 4 == 2, "immediate force wait")
    key = F.col("c_custkey").cast("string")
    start = c.where(F.col("c_nationkey") % 4 < 3).select("ts", _s(_clock(F.col("ts")), " UTC [78]: LOG:  checkpoint starting: ", kind).alias("line"), F.lit(0).alias("tie"))
    text = _s("checkpoint complete: wrote ", key, " buffers (1.0%); 0 WAL file(s) added; write=1.000 s, sync=0.1 s, total=", F.format_string("%.3f", (F.col("c_nationkey") + 1) / 8), " s; sync files=1; distance=", (F.col("c_nationkey") * 100).cast("string"), " kB, estimate=", (F.col("c_nationkey") * 100 + 50).cast("string"), " kB")
    done = c.select(F.col("end").alias("ts"), _s(_clock(F.col("end")), " UTC [78]: LOG:  ", text).alias("line"), F.lit(0).alias("tie"))
    warn = c.where("c_nationkey = 7").select(F.col("end").alias("ts"), _s(_clock(F.col("end")), " UTC [78]: LOG:  checkpoints are occurring too frequently (", (F.col("c_custkey") % 29 + 1).cast("string"), " seconds apart)").alias("line"), F.lit(1).alias("tie"))
    return _lines(up.unionByName(start).unionByName(done).unionByName(warn), "ts", ["tie", "line"], [F.col("line")])
