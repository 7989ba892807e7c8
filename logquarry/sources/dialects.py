"""Timestamp and message of a log line, for every dialect, as native expressions.

Zone abbreviations are not converted: the wall clock is kept as UTC. Numeric offsets are honoured.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from logquarry.functions.text import after, drop_bytes

_CLOCK = r"\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}(?:\.\d+)?"
_ZONE = r"(?:[A-Z]{3,5}|GMT[+-]\d{1,2}|[+-]\d{2}(?:\d{2})?)"
_ISO = r"\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:\d{2})?"

STDERR = rf"^{_CLOCK}[ \t]+{_ZONE}(?:[ \t]+|$)"
RDS = rf"(?s)^({_CLOCK})[ \t]+{_ZONE}:([^:]*):([^:]*):(?:\[([^\]]*)\]:?)?(.*)$"
AZURE = rf"(?s)^({_CLOCK})[ \t]+[A-Z]{{3,5}}-([^-]*)-(.*)$"
BSD = r"(?s)^([A-Z][a-z]{2}) ([ 0-9]\d) (\d{2}:\d{2}:\d{2}(?:\.\d+)?)[ \t]*(.*)$"
ISO = rf"(?s)^({_ISO})(.*)$"
RFC5424 = rf"(?s)^<\d{{1,4}}>\d ({_ISO})(.*)$"


def _entry(ts: Column, message: Column, pid: Column | None = None) -> Column:
    return F.struct(ts.alias("ts"), message.alias("message"), (pid if pid is not None else F.lit(None).cast("string")).alias("pid"))


def _part(line: Column, pattern: str, i: int) -> Column:
    return F.regexp_extract(line, pattern, i)


def stderr_head(line: Column) -> Column:
    """Clock, zone and the space after them, in front of a line of the server's standard error; else empty."""
    return _part(line, STDERR, 0)


def stderr(line: Column, head: Column) -> Column:
    """The entry of a line with its stderr_head."""
    # a clock has one space inside, and a space or tab behind it
    clock = F.substring_index(F.when(head.contains("\t"), F.substring_index(head, "\t", 1)).otherwise(head), " ", 2)
    return _entry(clock.try_cast("timestamp"), drop_bytes(line, F.octet_length(head)))


def rds(line: Column) -> Column:
    """``host(port):user@db:[pid]:`` in front becomes db=, user=, host=; the process id is kept beside the message."""
    host = F.substring_index(_part(line, RDS, 2), "(", 1)
    who = _part(line, RDS, 3)
    named = lambda key, v: F.when((v != "") & (v != "[unknown]"), F.concat(F.lit(f"{key}="), v, F.lit(" "))).otherwise("")
    at = who.contains("@")
    db, user = F.when(at, after(who, "@")).otherwise(""), F.when(at, F.substring_index(who, "@", 1)).otherwise("")
    return _entry(_part(line, RDS, 1).try_cast("timestamp"), F.concat(named("db", db), named("user", user), named("host", host), _part(line, RDS, 5)), F.nullif(_part(line, RDS, 4), F.lit("")))


def azure(line: Column) -> Column:
    return _entry(_part(line, AZURE, 1).try_cast("timestamp"), _part(line, AZURE, 3))


def bsd(line: Column, year: int | None = None) -> Column:
    """A syslog line without a year: the one given, or else the current one."""
    months = F.create_map(*[F.lit(x) for i, m in enumerate("Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split(), 1) for x in (m, f"{i:02d}")])
    day = F.lpad(F.trim(_part(line, BSD, 2)), 2, "0")
    stamp = F.concat(F.lit(f"{year or datetime.now().year:04d}-"), F.try_element_at(months, _part(line, BSD, 1)), F.lit("-"), day, F.lit(" "), _part(line, BSD, 3))
    return _entry(stamp.try_cast("timestamp"), _part(line, BSD, 4))


def iso(line: Column) -> Column:
    return _entry(_part(line, ISO, 1).try_cast("timestamp"), after(_part(line, ISO, 2), "]: "))


def rfc5424(line: Column) -> Column:
    rest = _part(line, RFC5424, 2)
    message = F.concat(F.lit("["), after(rest, " ["))
    return _entry(_part(line, RFC5424, 1).try_cast("timestamp"), F.when(message.rlike(r"^\[\d"), message))


def parse_line(line: Column, year: int | None = None) -> Column:
    """A struct (ts, message, pid) by the first dialect that fits but stderr; null if none does. Fixed positions choose what is tried."""
    dated = (F.substring(line, 5, 1) == "-") & (F.substring(line, 8, 1) == "-")
    spaced = dated & (F.substring(line, 11, 1) == " ")
    return (
        F.when(spaced & line.rlike(RDS), rds(line))
        .when(spaced & line.rlike(AZURE), azure(line))
        .when(dated & (F.substring(line, 11, 1) == "T") & line.rlike(ISO) & line.contains("]: "), iso(line))
        .when(line.startswith("<") & line.rlike(RFC5424), rfc5424(line))
        .when((F.substring(line, 4, 1) == " ") & (F.substring(line, 7, 1) == " ") & line.rlike(BSD), bsd(line, year))
    )


def is_syslog_chunk(line: Column) -> Column:
    """A later part of a split syslog message: ``[X-N]`` with N above 1, not followed by a timestamp."""
    return line.rlike(r"\[\d+-(?:[2-9]|[1-9]\d+)\](?![ \t]*[12]\d{3}-\d{2}-)")


def syslog_pid(line: Column) -> Column:
    get = lambda p: F.nullif(F.regexp_extract(line, p, 1), F.lit(""))
    return F.coalesce(get(r"postgres\[(\d+)\]"), get(r" postgres (\d+) "), get(r" UTC \[(\d+)\]"), get(r"\[(\d+)\]:"), F.lit(""))


def syslog_content(line: Column) -> Column:
    return F.trim(F.regexp_extract(line, r"(?s)\[\d+-(?:[2-9]|[1-9]\d+)\](.*)$", 1))


#: What follows an entry as a message of its own.
CONTINUATIONS = ["DETAIL:", "HINT:", "CONTEXT:", "STATEMENT:", "QUERY:", "LOCATION:"]


def is_continuation(message: Column) -> Column:
    """Whether a message belongs to the entry before it: the first occurrence of a keyword stands first or after a space."""
    out = is_syslog_chunk(message)
    for k in CONTINUATIONS:
        at = F.locate(k, message)
        out = out | (message.contains(k) & ((at == 1) | (F.substring(message, at - 1, F.lit(1)) == " ")))
    return out | message.contains("redirecting log output to logging collector process")


def csv_message(columns: dict[str, Column]) -> Column:
    """The message text of a csvlog row, as a stderr log would have it."""
    c = lambda k: F.coalesce(F.rtrim(columns[k]), F.lit("")) if k in columns else F.lit("")
    part = lambda before, v, end="": F.when(v != "", F.concat(F.lit(before), v, F.lit(end))).otherwise("")
    who = F.array_join(F.filter(F.array(*[part(f"{k}=", c(col)) for k, col in (("user", "user_name"), ("db", "database_name"), ("app", "application_name"), ("client", "connection_from"))]), lambda x: x != ""), ",")
    state = c("sql_state_code")
    return F.concat(
        part("[", c("process_id"), "]: "), part("", who, " "), part("", c("error_severity"), ": "), c("message"),
        part(" DETAIL: ", c("detail")), part(" HINT: ", c("hint")), part(" QUERY: ", c("query")), part(" CONTEXT: ", c("context")),
        F.when((state != "") & (state != "00000"), F.concat(F.lit(" SQLSTATE = '"), state, F.lit("'"))).otherwise(""),
    )


def json_message(get) -> Column:
    """The message text of a jsonlog object; get(name) is the field as a string column."""
    c = lambda *names: F.coalesce(*[F.nullif(get(n), F.lit("")) for n in names], F.lit(""))
    part = lambda before, v, end="": F.when(v != "", F.concat(F.lit(before), v, F.lit(end)))
    who = F.nullif(F.array_join(F.array(part("user=", c("user")), part("db=", c("dbname", "database")), part("app=", c("application_name")), part("client=", c("remote_host"))), ","), F.lit(""))
    state = c("state_code")
    parts = F.array(
        part("[", c("pid"), "]:"), who, part("", c("error_severity"), ":"), part("", c("message")), part("DETAIL: ", c("detail")),
        part("HINT: ", c("hint")), part("STATEMENT: ", c("query", "statement")), part("CONTEXT: ", c("context")),
        F.when((state != "") & (state != "00000"), F.concat(F.lit("SQLSTATE = '"), state, F.lit("'"))),
    )
    return F.coalesce(F.nullif(get("textPayload"), F.lit("")), F.array_join(parts, " "))


def timestamp_text(value: Column) -> Column:
    """RFC 3339 with its offset, or a wall clock with an optional zone abbreviation, or epoch seconds or milliseconds."""
    number = value.try_cast("double")
    epoch = F.when(number > 1e12, F.timestamp_millis(number.cast("long"))).otherwise(F.timestamp_seconds(number.cast("long")))
    wall = F.regexp_extract(value, rf"^({_CLOCK})(?: {_ZONE})?$", 1).try_cast("timestamp")
    return F.coalesce(F.when(value.rlike(rf"^{_ISO}$"), value.try_cast("timestamp")), wall, F.when(number.isNotNull(), epoch))
