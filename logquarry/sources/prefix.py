"""Values in a log_line_prefix: from its definition, or inferred from a sample of lines.

A prefix becomes one regular expression with a group for each value; lines that match it get
``user=``, ``db=``, ``app=`` and ``host=`` in front of their severity, as the rest of the engine reads
them. Opt-in: most prefixes name their values already.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Escapes of log_line_prefix (PostgreSQL documentation) and what they print.
ESCAPES = {
    "a": r"[^\t]*?", "u": r"[^\s@/,|\]]*", "d": r"[^\s@/,|\]]*", "r": r"[^\s,]*?", "h": r"[^\s,|\]]*?", "p": r"\d+", "P": r"\d*", "t": r"\S+ \S+ \S+", "m": r"\S+ \S+ \S+",
    "n": r"\d+\.\d+", "i": r"[^\[\],]*?", "e": r"[0-9A-Z]{5}", "c": r"[0-9a-f]+\.[0-9a-f]+", "l": r"\d+", "s": r"\S+ \S+ \S+", "v": r"[0-9/]*", "x": r"\d+", "b": r"[^\[\],]*?", "Q": r"-?\d+", "q": "",
}
KEYS = {"u": "user", "d": "db", "a": "app", "h": "host", "r": "host", "p": "pid"}
SEVERITY = r"(?:LOG|WARNING|ERROR|FATAL|PANIC|NOTICE|INFO|DEBUG\d?|DETAIL|HINT|STATEMENT|CONTEXT|QUERY):"

#: Prefixes that inference tries, after the time: the first that fits most lines of the sample.
COMMON = ["[%p] %u@%d/%a %h ", "[%p] %u@%d %h ", "[%p] %u@%d ", "[%p] %q%u@%d ", "[%p]: [%l-1] %u@%d ", "[%p]: %u %d %a %h ", "%p %u %d %h ", "[%p] [%u] [%d] [%a] [%h] ", "%h %u %d [%p] ", "[%c] %u@%d ", "%u|%d|%a|%h|%p ", "[%p] %e %u@%d "]


@dataclass(frozen=True)
class Prefix:
    """A regular expression over what follows the time, and the key of each of its groups."""

    pattern: str
    keys: tuple[str, ...]


def compile_prefix(text: str) -> Prefix:
    """The expression of a log_line_prefix; a leading %t or %m is taken off, as the time is read before."""
    text = re.sub(r"^%[tmn]\s*", "", text)
    out, keys, i, optional = "", [], 0, False
    while i < len(text):
        c = text[i]
        if c == "%" and i + 1 < len(text):
            i += 1
            while text[i] in "-0123456789":  # padding
                i += 1
            k = text[i]
            if k == "%":
                out += "%"
            elif k == "q":
                out, optional = out + "(?:", True
            elif k in KEYS:
                out += f"({ESCAPES[k]})"
                keys.append(KEYS[k])
            elif k in ESCAPES:
                out += f"(?:{ESCAPES[k]})"
            else:
                raise ValueError(f"unknown escape %{k}")
        else:
            out += r"\s*" if c == " " else re.escape(c)
        i += 1
    return Prefix(rf"^{out}{')?' if optional else ''}\s*(?={SEVERITY})", tuple(keys))


def infer(messages: list[str], share: float = 0.65) -> Prefix | None:
    """The common prefix that fits at least a share of the messages (what follows the time) and finds a user or database."""
    best, most = None, 0
    for text in COMMON:
        p = compile_prefix(text)
        found = [m for x in messages if (m := re.match(p.pattern, x)) and all(m.groups())]
        if len(found) > most:
            best, most = p, len(found)
    return best if messages and most >= share * len(messages) else None


def sample(entries: DataFrame, n: int = 50) -> list[str]:
    """At most n messages that do not name their values."""
    return [r.message for r in entries.where(~F.col("message").rlike(r"\b(?:user|db|database)=")).select("message").limit(n).collect()]


def _named(message: Column, p: Prefix) -> Column:
    part = lambda i, k: F.when((v := F.regexp_extract(message, p.pattern, i)) != "", F.concat(F.lit(f"{k}="), v))
    who = F.array_join(F.array(*[part(i + 1, k) for i, k in enumerate(p.keys) if k != "pid"]), ",")
    pid = F.concat(*[F.when(F.regexp_extract(message, p.pattern, i + 1) != "", F.concat(F.lit("["), F.regexp_extract(message, p.pattern, i + 1), F.lit("]: "))).otherwise("") for i, k in enumerate(p.keys) if k == "pid"], F.lit(""))
    rest = F.regexp_replace(message, p.pattern, "")
    return F.when(message.rlike(p.pattern), F.concat(pid, who, F.when(who != "", " ").otherwise(""), rest)).otherwise(message)


def apply_prefix(entries: DataFrame, p: Prefix | None) -> DataFrame:
    """entries with the values of the prefix named in their messages."""
    return entries if p is None else entries.withColumn("message", _named(F.col("message"), p))
