"""Command line: ``python -m logquarry files... [filters] [sections] [format]``."""

from __future__ import annotations

import argparse
import signal
import sys
import threading

from logquarry.operators.filters import Filters, TimeRange
from logquarry.render.formats import FORMATS, html_name


def _list(text: str) -> list[str]:
    return [x for x in text.split(",") if x]


FLAGS = ["summary", "events", "errors", "sql-summary", "tempfiles", "locks", "maintenance", "checkpoints", "connections", "clients", "sql-performance", "sql-overview"]


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="logquarry", description="Reports from PostgreSQL server logs.")
    p.add_argument("inputs", nargs="+", help="files, patterns, folders, or - for standard input")
    for short, name in (("-b", "--begin"), ("-e", "--end"), ("-W", "--window"), ("-L", "--last")):
        p.add_argument(short, name)
    for short, name in (("-d", "--dbname"), ("-u", "--dbuser"), ("-U", "--exclude-user"), ("-N", "--appname")):
        p.add_argument(short, name, action="append", type=_list, default=[])
    p.add_argument("--grep", action="append", default=[])
    for f in FLAGS:
        p.add_argument(f"--{f}", dest="sections", action="append_const", const=f.replace("-", "_"))
    p.add_argument("--sql-detail", "-Q", action="append", type=_list, default=[])
    p.add_argument("--full", "-F", action="store_true")
    p.add_argument("--json", "-J", dest="format", action="store_const", const="json")
    p.add_argument("--json-compact", dest="format", action="store_const", const="json-compact")
    p.add_argument("--yaml", "-Y", dest="format", action="store_const", const="yaml")
    p.add_argument("--md", dest="format", action="store_const", const="md")
    p.add_argument("--html", "-H", dest="format", action="store_const", const="html")
    p.add_argument("--output", "-o")
    p.add_argument("--follow", action="store_true")
    p.add_argument("--interval", type=float, default=30.0)
    p.add_argument("--year", type=int, help="year of syslog lines without one")
    p.add_argument("--top", type=int, help="length of ranked lists")
    p.add_argument("--master", help="Spark master")
    return p


def check(o: argparse.Namespace, p: argparse.ArgumentParser) -> None:
    if o.last and (o.begin or o.end or o.window):
        p.error("--last cannot be combined with --begin, --end or --window")
    if o.window and o.begin and o.end:
        p.error("--window needs --begin or --end, not both")
    if o.follow and (o.begin or o.end or o.window):
        p.error("--follow takes --last only")
    if o.follow and "-" in o.inputs:
        p.error("--follow cannot read standard input")


def main(argv: list[str] | None = None) -> int:
    p = parser()
    o = p.parse_args(argv)
    check(o, p)
    flat = lambda lists: [x for part in lists for x in part]
    try:
        filters = Filters(TimeRange(o.begin, o.end, o.window, o.last), flat(o.dbname), flat(o.dbuser), flat(o.exclude_user), flat(o.appname), o.grep)
        filters.time.bounds()
    except ValueError as e:
        p.error(str(e))
    from logquarry.report import Report, build
    from logquarry.session import get_session
    from logquarry.sources.inputs import read_entries
    from logquarry.streaming.follow import follow, write_whole

    spark = get_session(o.master)
    how = {"sections": o.sections, "full": o.full, "events": o.full or o.format in ("json", "json-compact", "yaml", "html"), "top": o.top}
    fmt = o.format or "text"
    if o.follow:
        stop = threading.Event()
        for s in (signal.SIGINT, signal.SIGTERM):
            signal.signal(s, lambda *_: stop.set())
        follow(spark, o.inputs, o.interval, o.output, o.last or "24h", fmt, stop, **how)
        return 0
    try:
        entries = filters.apply(read_entries(spark, o.inputs, o.year))
        if ids := flat(o.sql_detail):
            report = {"sql_detail": Report(entries).sql_detail(ids)} | (build(entries, **how) if o.sections else {})
        else:
            report = build(entries, **how)
    except (ValueError, FileNotFoundError) as e:
        print(f"logquarry: {e}", file=sys.stderr)
        return 1
    text = FORMATS[fmt](report)
    target = o.output or (html_name(o.inputs) if fmt == "html" else None)
    write_whole(target, text) if target else sys.stdout.write(text)
    return 0
