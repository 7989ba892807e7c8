"""Values in a log message: process id, keys, entities, hosts. Column in, Column out; no Python at run time."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from logquarry.constants import VALUE_ENDS

_END = "(?=" + "|".join(re.escape(x) for x in VALUE_ENDS) + r"|[,\[)\"]|$)"


def first_filled(*columns: Column) -> Column:
    """The first that is not empty, else an empty string."""
    return F.coalesce(*[F.when(c != "", c) for c in columns], F.lit(""))


def drop_bytes(text: Column, n: Column) -> Column:
    """text without its first n bytes: no character is counted, which takes a pass over a text."""
    return F.substring(text.cast("binary"), n + 1, F.octet_length(text)).cast("string")


def after(text: Column, marker: str) -> Column:
    """What follows the first occurrence of a marker; null without one."""
    return F.when(text.contains(marker), drop_bytes(text, F.octet_length(F.substring_index(text, marker, 1)) + len(marker.encode())))


def pid(message: Column) -> Column:
    """Digits in the first square brackets, with an optional suffix after a hyphen; else empty."""
    return F.regexp_extract(message, r"^[^\[]*\[([0-9]+)(?:-[^\]]*)?\]", 1)


def cut_at_severity(text: Column) -> Column:
    """The text before the first of the severity markers, in their order of precedence."""
    return F.coalesce(*[F.when(F.locate(m, text) > 0, F.substring(text, F.lit(1), F.locate(m, text) - 1)) for m in VALUE_ENDS], text)


def filter_value(message: Column, key: str) -> Column:
    """The value after the first ``key=``, as row filters compare it; empty if there is none."""
    at = F.locate(f"{key}=", message)
    rest = after(message, f"{key}=")
    listed = (at > 1) & (F.substring(message, at - 1, F.lit(1)) == ",")
    value = F.when(listed, cut_at_severity(F.regexp_extract(rest, r"^([^,\[\]()]*)", 1))).otherwise(F.regexp_extract(rest, r"^([^ ,\[\]()]*)", 1))
    return F.coalesce(F.regexp_replace(F.trim(value), "^[\"']+|[\"']+$", ""), F.lit(""))


def _entity_value(value: Column) -> Column:
    bare = F.when((F.length(value) >= 2) & value.startswith("'") & value.endswith("'"), F.substring(value, F.lit(2), F.length(value) - 2)).otherwise(value)
    return F.when(value == "", "").when(bare.isin("", "[unknown]") | (F.lower(bare) == "unknown"), "UNKNOWN").when(bare.rlike("^%.$"), "").otherwise(bare)


def normalize_host(host: Column) -> Column:
    """A host without its port: ``[v6]:port``, ``ip(port)``, ``name:port``; addresses with several colons stay."""
    bracket = F.regexp_extract(host, r"^(\[[^\]]*\])", 1)
    return (
        F.when(host.startswith("["), F.when(bracket != "", bracket).otherwise(host))
        .when(F.locate("(", host) > 1, F.substring_index(host, "(", 1))
        .when(host.rlike(r"^[^:]+:[^:]*$"), F.substring_index(host, ":", 1))
        .otherwise(host)
    )


_ENTITY_PATTERNS = {
    "user": r'user=([^ ,\[)"]*)',
    "db": r'(?:database|db)=([^ ,\[)"]*)',
    "host": r'(?:client|host)=([^ ,\[)"]*)',
    "app": rf'((?<=,app=|,application_name=)[^,\[)"]*?{_END}|(?<=(?:^|[^,])app=|(?:^|[^,])application_name=)[^ ,\[)"]*)',
}


def entity(message: Column, kind: str) -> Column:
    """The first filled value of a kind (user, db, host, app), unknown ones as UNKNOWN; empty if there is none."""
    values = F.transform(F.regexp_extract_all(message, F.lit(_ENTITY_PATTERNS[kind]), F.lit(1)), _entity_value)
    first = F.try_element_at(F.filter(values, lambda v: v != ""), F.lit(1))
    return F.coalesce(normalize_host(first) if kind == "host" else first, F.lit(""))


_PREFIX_KEYS = {"db": "db", "user": "user", "host": "(?:host|client)", "app": "app"}


def prefix_field(message: Column, kind: str) -> Column:
    """The last value of a whole-word key among the first 200 bytes, as breakdowns by dimension use it."""
    head = F.substring(message.cast("binary"), 1, 200).cast("string")
    key = rf"(?<![A-Za-z0-9_]){_PREFIX_KEYS[kind]}=(?!$)"
    plain = F.regexp_extract_all(head, F.lit(key + r"([^, \[\]]*)"), F.lit(1))
    value = F.try_element_at(plain, F.lit(-1))
    if kind == "app":
        spaced = F.transform(F.regexp_extract_all(head, F.lit(key + r"([^,\[\]]*)"), F.lit(1)), cut_at_severity)
        listed = reduce(lambda a, b: a | b, [F.locate(k, head) > 0 for k in (",db=", ",user=", ",app=")])
        value = F.when(listed, F.try_element_at(spaced, F.lit(-1))).otherwise(value)
    return F.coalesce(value, F.lit(""))


def session_entity(message: Column, kind: str) -> Column:
    """user, db or host of a disconnection: the first occurrence; ``database=`` before ``db=``."""
    keys = {"user": ["user="], "db": ["database=", "db="], "host": ["host="]}[kind]
    return first_filled(*[F.coalesce(F.regexp_extract(after(message, k), r"^([^ ,\[)]*)", 1), F.lit("")) for k in keys])


def truncate(text: Column, n: int) -> Column:
    """At most n characters, with an ellipsis in place of what is cut."""
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n - 3), F.lit("..."))).otherwise(text)
