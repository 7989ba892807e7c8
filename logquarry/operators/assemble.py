"""Lines to entries.

``lines``: file_idx, split_start, line_no, line; no two lines have one place. ``entries``: seq, ts,
message, is_continuation, pid; seq orders all entries of all files. Of text, it is the number of an
entry's first line (line_seq), so lines are parsed once and neither shuffled nor sorted; only lines
that continue an entry look for it, among numbers, within each split of a file and then over the
splits before it (a row for each split), so no task ever orders a whole file. Elsewhere it is a
prefix sum over lines, in the same two phases.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from logquarry.functions.text import after, pid
from logquarry.sources import dialects

from .stage import staged

FILE_SHIFT = 1 << 44


def line_seq(file_idx, split_start, line_no):
    """A number for a line that grows with its place: a line has a byte at least, so its number in a split stays below the next split's start."""
    return file_idx.cast("long") * F.lit(FILE_SHIFT) + split_start + line_no.bitwiseAND((1 << 33) - 1)


def _trim(line: Column) -> Column:
    return F.regexp_replace(line, r"^\s+|\s+$", "")


def entries_from_lines(lines: DataFrame, year: int | None = None, foreign: str = "drop", syslog: bool = False, items: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Entries of text lines of any dialect.

    A line that starts with white space, or that no dialect parses, continues the entry before it.
    foreign="drop" leaves out lines that start with a digit but do not parse (output of backup
    tools); "glue" appends them. syslog=True also joins split messages of one process.

    items: what is made of entries, each by itself; it is written and returned in place of them. While
    lines are parsed it is made of their heads, and stands if no line of the log goes on; otherwise
    it is made anew of whole entries.
    """
    tab = after(F.col("line"), "#011")
    own = F.when(F.col("line").contains("#011"), F.concat(F.lit(" "), tab)).otherwise(F.col("line"))
    if syslog:  # a tab inside a part of a message
        own = F.replace(F.col("line"), F.lit("#011"), F.lit("\t"))
    raw = lines.where("line is not null").select("file_idx", "split_start", "line_no", own.alias("line"))
    indented = F.col("line").rlike(r"^[ \t]")
    # explode, inline: the parse is evaluated once for each line, however many columns are made of it
    parsed = raw.select("*", F.explode(F.array(dialects.stderr_head(F.col("line")))).alias("zone"))
    parsed = parsed.select("*", F.inline(F.array(F.when(F.col("zone") != "", dialects.stderr(F.col("line"), F.col("zone"))))).alias("ts", "head", "own_pid"))
    # transform: the other dialects stay out of the generated method, which is compiled only while it is small; no array, no call
    other = F.transform(F.when((F.col("zone") == "") & ~indented, F.array("line")), lambda line: dialects.parse_line(line, year))
    parsed = parsed.select("*", F.inline_outer(other).alias("ts2", "head2", "pid2"))
    parsed = parsed.select("file_idx", "split_start", "line_no", "line", *[F.coalesce(a, b).alias(a) for a, b in (("ts", "ts2"), ("head", "head2"), ("own_pid", "pid2"))])
    parsed = parsed.withColumn("is_new", F.col("ts").isNotNull() & F.col("head").isNotNull())
    if foreign == "drop":
        parsed = parsed.where(F.col("is_new") | ~F.col("line").rlike("^[0-9]"))
    if syslog:
        return _join_chunks(parsed) if items is None else staged(items(_join_chunks(parsed)))
    seen = Observation()
    own = F.when(~F.col("is_new"), _trim(F.col("line"))).alias("t")
    parsed = parsed.select("file_idx", "split_start", line_seq(F.col("file_idx"), F.col("split_start"), F.col("line_no")).alias("seq"), "is_new", "ts", "head", "own_pid", own)
    parsed = parsed.observe(seen, F.count_if(~F.col("is_new")).alias("more"))
    heads = lambda df: df.where("is_new").select("seq", "ts", F.col("head").alias("message"), "own_pid")
    if items is not None:
        made = staged(items(canonical(heads(parsed))))
        return staged(items(entries_from_lines(lines, year, foreign))) if seen.get["more"] else made
    parsed = staged(parsed)
    first = heads(parsed)
    if not seen.get["more"]:
        return canonical(first)
    tails = _tails(parsed).select(F.col("of").alias("seq"), "tail")
    message = F.when(F.col("tail").isNull(), F.col("message")).otherwise(F.concat_ws(" ", "message", "tail"))
    return canonical(first.join(tails, "seq", "left").select("seq", "ts", message.alias("message"), "own_pid"))


def _tails(parsed: DataFrame) -> DataFrame:
    """of (the entry's seq) and tail: the lines that continue it, joined by spaces. Those before the first entry of a file are left out."""
    keys = ["file_idx", "split_start"]
    lines = parsed.select(*keys, "seq", "t", F.when(F.col("is_new"), F.col("seq")).alias("new"))
    here = Window.partitionBy(*keys).orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("file_idx").orderBy("split_start").rowsBetween(Window.unboundedPreceding, -1)
    carried = lines.groupBy(*keys).agg(F.max("new").alias("last")).select(*keys, F.max("last").over(before).alias("carried"))
    more = lines.withColumn("of", F.max("new").over(here)).where("new is null").join(carried, keys).withColumn("of", F.coalesce("of", "carried"))
    c = more.where("of is not null").groupBy("of").agg(F.array_sort(F.collect_list(F.struct("seq", "t"))).alias("c"))
    return c.select("of", F.array_join(F.transform("c", lambda x: x.t), " ").alias("tail"))


def _bases(parsed: DataFrame, flag: str, *more: Column) -> DataFrame:
    """For each split: n (its lines with the flag) and base (those of the splits before it), a row for each."""
    totals = parsed.groupBy("file_idx", "split_start").agg(F.sum(F.col(flag).cast("long")).alias("n"), *more)
    before = Window.partitionBy("file_idx").orderBy("split_start").rowsBetween(Window.unboundedPreceding, -1)
    return totals.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0)))


def records(parsed: DataFrame, first: list[str], between: str) -> DataFrame:
    """Lines put together: seq, the columns ``first`` of a record's first line, and rest (its other lines; trimmed, if joined by a space).

    parsed: file_idx, split_start, line_no, line, is_new and the columns of ``first``.
    """
    keys = ["file_idx", "split_start"]
    own = F.when(~F.col("is_new"), F.col("line")).alias("line")
    parsed = staged(parsed.select(*keys, "line_no", "is_new", *first, own))
    bases = _bases(parsed, "is_new", F.min(F.when(F.col("is_new"), F.col("line_no"))).alias("opens"))
    line = _trim(F.col("line")) if between == " " else F.col("line")
    tail = lambda *order: F.array_sort(F.collect_list(F.when(~F.col("is_new"), F.struct(*order, line.alias("t")))))
    text = lambda c: F.when(F.size(c) > 0, F.array_join(F.transform(c, lambda x: x.t), between))
    # the heads of splits: they continue the last record of a split before
    loose = parsed.join(bases, keys).where("not is_new and base > 0 and (opens is null or line_no < opens)")
    loose = loose.groupBy("file_idx", F.col("base").alias("last")).agg(tail("split_start", "line_no").alias("c")).select("file_idx", "last", text(F.col("c")).alias("more"))
    ends = bases.where("n > 0").withColumn("last", F.col("base") + F.col("n")).join(loose, ["file_idx", "last"], "left").select(*keys, "base", "n", "more")
    numbered = parsed.withColumn("no", F.sum(F.col("is_new").cast("long")).over(Window.partitionBy(*keys).orderBy("line_no")))
    grouped = numbered.where("no > 0").groupBy(*keys, "no").agg(F.max(F.when(F.col("is_new"), F.struct(*first))).alias("e"), tail("line_no").alias("c"))
    rest = F.concat_ws(between, text(F.col("c")), F.when(F.col("no") == F.col("n"), F.col("more")))
    none = F.col("more").isNull() | (F.col("no") != F.col("n"))
    seq = F.col("file_idx").cast("long") * F.lit(FILE_SHIFT) + F.col("base") + F.col("no")
    return grouped.join(ends, keys).select(seq.alias("seq"), "e.*", F.when((F.size("c") > 0) | ~none, rest).alias("rest"))


def quoted_records(lines: DataFrame) -> DataFrame:
    """seq, record of lines in which a quoted field may run on: a line begins a record if the quotes before it are even."""
    quotes = F.length("line") - F.length(F.replace(F.col("line"), F.lit('"')))
    odd = lines.where("line is not null").select("file_idx", "split_start", "line_no", "line", (quotes % 2 == 1).alias("odd"))
    before = F.sum(F.col("odd").cast("long")).over(Window.partitionBy("file_idx", "split_start").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1))
    here = odd.withColumn("before", F.coalesce(before, F.lit(0))).join(_bases(odd, "odd").select("file_idx", "split_start", "base"), ["file_idx", "split_start"])
    parsed = here.select("file_idx", "split_start", "line_no", "line", ((F.col("before") + F.col("base")) % 2 == 0).alias("is_new"), F.col("line").alias("head"))
    return records(parsed, ["head"], "\n").select("seq", F.concat_ws("\n", "head", "rest").alias("record"))


def _join_chunks(parsed: DataFrame) -> DataFrame:
    """Split syslog messages of one process put together; parts without a first one are left out; order by (ts, line).

    A line without a process id is an entry of its own.
    """
    new = parsed.where("is_new").withColumn("chunk", dialects.is_syslog_chunk(F.col("line"))).withColumn("sp", dialects.syslog_pid(F.col("line")))
    new = new.withColumn("seq", line_seq(F.col("file_idx"), F.col("split_start"), F.col("line_no")))
    alone = new.where("sp = ''").select("seq", "ts", F.col("head").alias("message"), F.lit(None).cast("string").alias("own_pid"))
    order = Window.partitionBy("file_idx", "sp").orderBy("seq")
    new = new.where("sp <> ''").withColumn("no", F.sum((~F.col("chunk")).cast("long")).over(order)).where("no > 0")
    text = F.when(F.col("chunk"), dialects.syslog_content(F.col("line"))).otherwise(F.col("head"))
    parts = new.groupBy("file_idx", "sp", "no").agg(F.min("seq").alias("seq"), F.min_by("ts", "seq").alias("ts"), F.array_sort(F.collect_list(F.struct("seq", text.alias("t")))).alias("c"))
    message = F.array_join(F.transform("c", lambda x: x.t), " ")
    return canonical(parts.select("seq", "ts", message.alias("message"), F.col("sp").alias("own_pid")).unionByName(alone), own_first=True)


def canonical(entries: DataFrame, structured: bool = False, own_first: bool = False) -> DataFrame:
    """seq, ts, message, is_continuation, pid; rows without a timestamp are left out. Structured formats have no continuations.

    Messages of structured formats are put together from many fields: they are written once, so that
    this is neither done nor planned again for every expression that reads a message.

    own_first: a process id beside the message goes before one in brackets in it (which may be the number of a part).
    """
    if structured:
        entries = staged(entries.where("ts is not null"))
    flag = F.lit(False) if structured else dialects.is_continuation(F.col("message"))
    named, own = F.nullif(pid(F.col("message")), F.lit("")), F.nullif("own_pid", F.lit(""))
    both = [own, named] if own_first else [named, own]
    return entries.where("ts is not null").select("seq", "ts", "message", flag.alias("is_continuation"), F.coalesce(*both, F.lit("")).alias("pid"))
