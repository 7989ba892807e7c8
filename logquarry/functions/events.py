"""Severity, SQLSTATE and fingerprint of an event."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from logquarry.constants import EVENT_MARKERS, EVENT_SUFFIXES, SEVERITIES, SQLSTATE_CLASSES

from .text import after, first_filled

_CODE = "([0-5FHPX][0-9A-Z]{4})"


def severity(message: Column, compat: bool = True) -> Column:
    """A severity that the message starts with, else one whose marker it holds; null if none.

    compat looks for markers in order of weight; otherwise the earliest marker counts.
    """
    out = F.lit(None).cast("string")
    if compat:
        for s in reversed(SEVERITIES):
            out = F.when(message.contains(f"{s}:"), s).otherwise(out)
    else:
        out = F.nullif(F.regexp_extract(message, "(" + "|".join(SEVERITIES) + "):", 1), F.lit(""))
    for s in SEVERITIES:
        out = F.when(message.startswith(s), s).otherwise(out)
    return F.when(F.length(message) >= 3, out)


def sqlstate(message: Column) -> Column:
    """The five characters of an error code, or an empty string."""
    pull = lambda text, pattern: F.coalesce(F.regexp_extract(text, pattern, 1), F.lit(""))
    return first_filled(
        pull(after(message, "SQLSTATE"), rf"^[ \t]*=[ \t]*'{_CODE}"),
        pull(after(message, "ERROR:"), rf"^[ \t]*{_CODE}:"),
        pull(after(message, "] "), rf"^{_CODE}(?:[ :]|$)"),
    )


def sqlstate_class(code: Column) -> Column:
    """The first two characters of a code; null for none."""
    return F.nullif(F.substring(code, 1, 2), F.lit(""))


def class_description(class_: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in SQLSTATE_CLASSES.items() for x in p]), class_), F.lit("Unknown Error Class"))


def normalize_event(message: Column) -> Column:
    """Fingerprint of an event: what follows the severity, without details and places, with names, values and numbers as ?."""
    body = F.when(F.locate(":", message).between(1, 15), after(message, ":")).otherwise(message)
    for m in reversed(EVENT_MARKERS):
        body = F.when(F.locate(m, message) > 0, after(message, m)).otherwise(body)
    body = F.regexp_replace(body, r"^[ \t]+", "")
    ends = "|".join(EVENT_SUFFIXES)
    body = F.regexp_replace(body, f"(?s)(?:{ends}).*", "")
    body = F.regexp_replace(body, r"(?s) at character [0-9]+.*", "")
    body = F.regexp_replace(body, r"Key \([^)]+\)=\([^)]+\)", r"Key (?)=(?)")
    tokens = r"""(?s)"[^"]*+"?|(?<=[A-Za-z])'(?=[A-Za-z])|'(?:[^']++|'')*+'?|(?<![A-Za-z0-9_])[0-9]+|[ \t\r\n]++|."""
    one = lambda t: F.when((t == "'") | ~t.rlike(r"^[\"'0-9 \t\r\n]"), t).when(t.rlike(r"^[ \t\r\n]"), " ").otherwise("?")
    # a digit after an identifier character is matched by the last branch and stays
    kept = r"(?s)[A-Za-z_][A-Za-z0-9_]*"
    return F.trim(F.array_join(F.transform(F.regexp_extract_all(body, F.lit(tokens.replace("|.", f"|{kept[4:]}|.")), F.lit(0)), one), ""))
