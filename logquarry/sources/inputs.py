"""Inputs of any format to entries.

Paths are those of any file system that Spark reads. Text, csvlog and jsonlog are read in splits by
Spark, compressed or not; archives are unpacked by a Python map, one task for each file. Every file
gets a file_idx in the order of the arguments, and all are merged into one table.
"""

from __future__ import annotations

import os
import sys
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logquarry.constants import CSV_COLUMNS
from logquarry.operators.assemble import FILE_SHIFT, canonical, entries_from_lines, line_seq, quoted_records

from . import archive, detect, dialects
from .storage import Storage


def read_lines(spark: SparkSession, paths: list[str], indexes: list[int] | None = None) -> DataFrame:
    """Lines of plain or compressed text files: file_idx, split_start, line_no, line. line_no grows within a split."""
    raw = spark.read.text(paths)
    index = F.create_map(*[F.lit(x) for i, p in zip(indexes or range(len(paths)), paths, strict=True) for x in (os.path.basename(p), i)])
    return raw.select(F.element_at(index, F.col("_metadata.file_name")).alias("file_idx"), F.col("_metadata.file_block_start").alias("split_start"), F.monotonically_increasing_id().alias("line_no"), F.col("value").alias("line"))


def entries_from_csv(rows: DataFrame, seq=None) -> DataFrame:
    """Entries of csvlog rows as strings (23 or 26 columns in their order, and seq if there is one); rows without a time are left out."""
    columns = [c for c in rows.columns if c != "seq"]
    named = {name: F.col(f"`{c}`") for name, c in zip(CSV_COLUMNS, columns, strict=False)}
    ts = dialects.timestamp_text(F.trim(named["log_time"]))
    seq = F.col("seq") if "seq" in rows.columns else F.monotonically_increasing_id()
    return canonical(rows.select(seq.alias("seq"), ts.alias("ts"), dialects.csv_message(named).alias("message"), named["process_id"].alias("own_pid")), structured=True)


def entries_from_csv_lines(lines: DataFrame) -> DataFrame:
    """Entries of lines of csvlog: fields in quotes may run over lines and splits; rows of fewer than 14 fields are left out."""
    rows = quoted_records(lines)
    fields = F.size(F.split(F.regexp_replace("record", '"[^"]*"', ""), ","))
    schema = ", ".join(f"`{c}` string" for c in CSV_COLUMNS)
    options = {"quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": "true", "mode": "PERMISSIVE", "maxCharsPerColumn": "-1"}
    return entries_from_csv(rows.where(fields >= 14).select("seq", F.from_csv("record", schema, options).alias("r")).select("seq", "r.*"))


def entries_from_json_lines(lines: DataFrame) -> DataFrame:
    """Entries of lines with one JSON object each."""
    return entries_from_json(lines.select(line_seq(F.col("file_idx"), F.col("split_start"), F.col("line_no")).alias("seq"), F.col("line").alias("value")))


def entries_from_json_arrays(whole: DataFrame) -> DataFrame:
    """Entries of rows (file_idx, text) with one array of objects each."""
    items = whole.select("file_idx", F.posexplode(F.expr("try_variant_get(try_parse_json(text), '$', 'array<variant>')")).alias("at", "o"))
    return entries_from_json(items.select((F.col("file_idx").cast("long") * F.lit(FILE_SHIFT) + F.col("at")).alias("seq"), F.to_json("o").alias("value")))


def entries_from_json(objects: DataFrame) -> DataFrame:
    """Entries of rows (seq, value) with one JSON object each; objects that do not parse are left out.

    Kubernetes envelopes (record in the object, or in its message) are unwrapped, and what other
    loggers wrote there is left out; a cloud text payload is the message itself.
    """
    v = objects.select("seq", F.try_parse_json("value").alias("o")).where("o is not null")
    at = lambda path, c="o": F.try_variant_get(c, f"$.{path}", "string")
    has = lambda path: F.try_variant_get("o", f"$.{path}", "variant").isNotNull()
    postgres = lambda path: at(path).isin("postgres", "pgaudit")
    wrapped = F.try_variant_get("o", "$.message.logger", "variant").isNotNull() | has("message.logging_pod") | has("message.msg") | (has("logtag") & has("message"))
    record = F.when(postgres("logger") & has("record"), F.try_variant_get("o", "$.record", "variant")).when(wrapped & postgres("message.logger"), F.try_variant_get("o", "$.message.record", "variant"))
    drop = (has("logger") & has("logging_pod") & ~postgres("logger")) | (wrapped & ~F.coalesce(postgres("message.logger"), F.lit(False)))
    v = v.where(~F.coalesce(drop, F.lit(False))).select("seq", F.coalesce(record, F.col("o")).alias("r"), record.isNotNull().alias("inner"))
    old = {"timestamp": "log_time", "user": "user_name", "dbname": "database_name", "pid": "process_id", "remote_host": "connection_from", "state_code": "sql_state_code"}

    def get(name: str):
        plain = at(name, "r")
        if name not in old:
            return plain
        other = at(old[name], "r")
        if name == "remote_host":
            other = F.regexp_replace(other, r"(?<=.):[^:]*$", "")
        return F.when(F.col("inner"), F.coalesce(other, plain)).otherwise(plain)

    time = F.coalesce(get("timestamp"), get("time"), get("ts"), F.try_variant_get("r", '$["@timestamp"]', "string"))
    out = v.select("seq", dialects.timestamp_text(time).alias("ts"), dialects.json_message(get).alias("message"), get("pid").alias("own_pid")).where("message <> ''")
    return canonical(out, structured=True)


def _of_kind(spark: SparkSession, kind: str, files: list[tuple[int, str]], year: int | None) -> DataFrame:
    """Entries of files of one kind: log, syslog, csv, json (one object a line) or array."""
    indexes, paths = [i for i, _ in files], [p for _, p in files]
    if kind == "array":
        index = F.create_map(*[F.lit(x) for i, p in files for x in (os.path.basename(p), i)])
        return entries_from_json_arrays(spark.read.text(paths, wholetext=True).select(F.element_at(index, F.col("_metadata.file_name")).alias("file_idx"), F.col("value").alias("text")))
    return _entries(read_lines(spark, paths, indexes), kind, year)


def _entries(lines: DataFrame, kind: str, year: int | None) -> DataFrame:
    if kind == "csv":
        return entries_from_csv_lines(lines)
    if kind == "json":
        return entries_from_json_lines(lines)
    return entries_from_lines(lines, year, syslog=kind == "syslog")


def kind_of(head: bytes, name: str, stdin: bool = False) -> str:
    """log, syslog, csv, json or array, from the start of a file and its name."""
    kind = detect.detect_text(head, name, stdin)
    if kind == "json":
        return "array" if head.lstrip().startswith(b"[") else "json"
    return "syslog" if kind == "log" and detect.syslog_flavour(head.decode("utf-8", "replace")) else kind


def read_packed(spark: SparkSession, path: str, file_idx: int, year: int | None = None) -> tuple[DataFrame, int]:
    """Entries of the files in an archive, each in its own format, and the next free file_idx. The archive is read once for each kind in it."""
    kinds: dict[str, list[tuple[int, str]]] = {}
    for name, head in archive.heads(spark, path, detect.SAMPLE):
        try:
            kinds.setdefault(kind_of(head, name), []).append((file_idx, name))
            file_idx += 1
        except detect.UnknownFormat:
            continue
    if not kinds:
        raise detect.UnknownFormat(f"{path} holds no log")
    parts = []
    for kind, found in kinds.items():
        index = F.try_element_at(F.create_map(*[F.lit(x) for i, name in found for x in (name, i)]), F.col("member"))
        lines = archive.lines(spark, path).select(index.alias("file_idx"), F.expr("line_no div 100000 * 100000").alias("split_start"), F.expr("line_no % 100000").alias("line_no"), "line").where("file_idx is not null")
        if kind == "array":
            text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("split_start", "line_no", "line"))), lambda x: x.line), "\n")
            parts.append(entries_from_json_arrays(lines.groupBy("file_idx").agg(text.alias("text"))))
        else:
            parts.append(_entries(lines, kind, year))
    return reduce(DataFrame.unionByName, parts), file_idx


def read_entries(spark: SparkSession, args: list[str], year: int | None = None) -> DataFrame:
    """Entries of all inputs, merged. Inputs that no reader fits are left out; if none is left, that is an error.

    "-" is standard input, which is taken to the driver whole and dealt out from there.
    """
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    store = Storage(spark)
    parts, failed, plain, i = [], [], {}, 0
    if "-" in args:
        parts.append(read_stdin(spark, sys.stdin.buffer.read(), year))
        args, i = [a for a in args if a != "-"], 1
    for path in detect.collect_files(args, store):
        try:
            if archive.is_archive(path):
                entries, i = read_packed(spark, path, i, year)
                parts.append(entries)
                continue
            head = archive.inflated(store.head(path, detect.SAMPLE), path, detect.SAMPLE)
            plain.setdefault(kind_of(head, archive.unpacked_name(path)), []).append((i, path))
            i += 1
        except (OSError, ValueError, RuntimeError) as e:
            failed.append(f"{path}: {e}")
    for kind, files in plain.items():
        names = [os.path.basename(p) for _, p in files]
        groups = [files] if len(set(names)) == len(names) else [[f] for f in files]  # equal names cannot be told apart in one scan
        parts += [_of_kind(spark, kind, g, year) for g in groups]
    if not parts:
        raise ValueError("no input could be read: " + "; ".join(failed))
    return reduce(DataFrame.unionByName, parts)


def read_stdin(spark: SparkSession, data: bytes, year: int | None = None) -> DataFrame:
    """Entries of text that the driver has read, whose kind is found in the order csv, json, log."""
    kind = kind_of(data[: detect.SAMPLE], "", stdin=True)
    text = data.decode("utf-8", "replace")
    if kind == "array":
        return entries_from_json_arrays(spark.createDataFrame([(0, text)], "file_idx int, text string"))
    rows = [(0, n // 100_000 * 100_000, n % 100_000, line) for n, line in enumerate(text.splitlines())]
    return _entries(spark.createDataFrame(rows, "file_idx int, split_start long, line_no long, line string"), kind, year)


def total_bytes(spark: SparkSession, args: list[str]) -> int:
    store = Storage(spark)
    return sum(store.size(p) for p in detect.collect_files(args, store))
