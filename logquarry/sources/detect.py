"""Which files are read, and in which format: decided on the driver from names and a sample of each file."""

from __future__ import annotations

import csv
import io
import json
import os
import re

SAMPLE = 32 * 1024

#: Endings of files that a directory listing takes.
ENDINGS = [
    ".log", ".csv", ".json", ".jsonl", ".log.gz", ".csv.gz", ".json.gz", ".jsonl.gz", ".log.zst", ".log.zstd", ".csv.zst", ".csv.zstd",
    ".json.zst", ".json.zstd", ".jsonl.zst", ".jsonl.zstd", ".tar", ".tar.gz", ".tgz", ".tar.zst", ".tar.zstd", ".tzst", ".zip", ".7z",
]
TIME_KEYS = ["timestamp", "time", "ts", "@timestamp", "insertId", "textPayload"]
LEVELS = "PANIC|FATAL|ERROR|WARNING|NOTICE|LOG|INFO|DEBUG[1-5]?|DETAIL|HINT|CONTEXT|STATEMENT|QUERY"
#: How a line of a server log starts: a date and a clock, alone or in a syslog header, or seconds since 1970 with milliseconds.
STARTS = [r"\d{4}-\d\d-\d\d[T ]\d\d:\d\d:\d\d", r"[A-Z][a-z]{2} [ 0-9]\d \d\d:\d\d:\d\d", r"<\d{1,3}>\d+ \d{4}-\d\d-\d\dT", r"\d{10}\.\d{3}\b"]
LOG_LINE = re.compile(rf"(?:{'|'.join(STARTS)}).*?\b(?:{LEVELS}):\s")


def is_rotated(name: str) -> bool:
    """``x.log.2026-03-23``: a digit after the ending."""
    return bool(re.search(r"\.(?:log|csv)\.[0-9][^/]*$", name.lower()))


def is_supported(name: str) -> bool:
    return name.lower().endswith(tuple(ENDINGS)) or is_rotated(name)


def collect_files(args: list[str], store) -> list[str]:
    """Files of arguments in order: a file, a pattern, or the supported files of a folder (not of those below), by name. store: a Storage."""
    out: list[str] = []
    for arg in args:
        found = store.matches(arg)
        if not found:
            raise FileNotFoundError(arg)
        for p in found:
            out += [f"{p.rstrip('/')}/{n}" for n in store.files(p) if is_supported(n)] if store.is_folder(p) else [p]
    return list(dict.fromkeys(out))


def is_binary(sample: bytes) -> bool:
    if b"\0" in sample:
        return True
    odd = sum(b < 32 and b not in (9, 10, 13) for b in sample)
    return bool(sample) and odd / len(sample) > 0.3


def is_json(sample: str) -> bool:
    """An object, an array (cut off or not), or lines of objects, with a key that tells the time."""
    text = sample.strip()
    if not text.startswith(("{", "[")):
        return False
    try:
        json.loads(text)
    except ValueError:
        try:
            if text.startswith("["):
                if (at := text.find("{")) < 0:
                    return False
                json.JSONDecoder().raw_decode(text, at)
            else:
                json.loads(text.splitlines()[0])
        except ValueError as e:
            if not text.startswith("[") or getattr(e, "pos", 0) < len(text) - 1:
                return False
    return any(f'"{k}"' in text for k in TIME_KEYS)


def is_csv(sample: str) -> bool:
    if sample.count(",") < 12:
        return False
    try:
        row = next(csv.reader(io.StringIO(sample)))
    except (csv.Error, StopIteration):
        return False
    return len(row) >= 12 and bool(re.fullmatch(r"\d{4}-\d\d-\d\d \d\d:\d\d:\d\d(?:\.\d+)?(?: [A-Z]{2,5})?", row[0].strip()))


def is_log(sample: str) -> bool:
    """Whether any line starts like one of a server log and names a severity."""
    return any(LOG_LINE.match(line.strip() + " ") for line in sample.splitlines())


class UnknownFormat(ValueError):
    """No reader fits a file."""


def detect_text(sample: bytes, name: str = "", stdin: bool = False) -> str:
    """json, csv or log. A known ending must hold what it says; other names go by content (from stdin, csv is tried first)."""
    if not sample.strip():
        raise UnknownFormat(f"{name or 'input'} is empty")
    if is_binary(sample):
        raise UnknownFormat(f"{name or 'input'} is binary")
    text = sample.decode("utf-8", "replace")
    tests = {"json": is_json, "csv": is_csv, "log": is_log}
    ending = os.path.splitext(name.lower())[1].lstrip(".")
    if ending in tests:
        if tests[ending](text):
            return ending
        raise UnknownFormat(f"{name} does not hold {ending}")
    for kind in ("csv", "json", "log") if stdin else ("json", "csv", "log"):
        if tests[kind](text):
            return kind
    raise UnknownFormat(f"{name or 'input'} has no known format")


def syslog_flavour(sample: str) -> str | None:
    """bsd, iso or rfc5424 by the first line of 15 characters or more; None for other logs."""
    for line in sample.splitlines():
        if len(line) >= 15:
            if re.match(r"[A-Z][a-z]{2} [ 0-9]\d \d\d:\d\d:\d\d", line):
                return "bsd"
            if re.match(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d", line):
                return "iso"
            return "rfc5424" if re.match(r"<\d{1,4}>\d ", line) else None
    return None
