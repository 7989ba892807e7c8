"""Statements: duration and text of an execution, normalised form, query id, type and category."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from logquarry.constants import QUERY_CATEGORIES, QUERY_PREFIXES

from .text import after, first_filled

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TOKENS = r"""(?s)'(?:[^']++|'')*+'?|"[^"]*+"?|[ \t\r\n]++|\$[0-9]*|(?<![A-Za-z0-9_])-?[0-9][0-9.]*|[A-Za-z0-9_]+|."""
_LITERALS = r"""(?s)'(?:[^']++|'')*+'?|\$[0-9]*|(?<![A-Za-z0-9_])-?[0-9][0-9.]*"""
_EXECUTION = r"(?s)^(.*?)(execute|statement)([^:]*):( *)(.*)$"


def ascii_lower(text: Column) -> Column:
    return F.translate(text, _UPPER, _LOWER)


def duration_ms(message: Column) -> Column:
    """Milliseconds after ``duration:``; null if there is no number."""
    return F.regexp_extract(after(message, "duration:"), "^ *([^ ]+)", 1).try_cast("double")


def executed_query(message: Column) -> Column:
    """The text of an execute or statement message with a duration; null if there is none."""
    rest = F.regexp_extract(after(message, "duration:"), _EXECUTION, 5)
    return F.when((F.length(message) >= 20) & duration_ms(message).isNotNull() & (rest != ""), rest)


def is_plan(message: Column) -> Column:
    """Whether a message is an auto_explain plan: a plan and a duration, with no statement or execute after it."""
    rest = after(message, "duration:")
    return F.coalesce(message.contains("plan:") & rest.isNotNull() & ~rest.contains("statement:") & ~rest.contains("execute"), F.lit(False))


#: What a flat plan starts with.
PLAN_NODES = [
    "Result ", "Seq Scan ", "Index Scan ", "Index Only Scan ", "Bitmap ", "Nested Loop", "Hash Join", "Merge Join", "Sort ", "Aggregate",
    "Group", "Limit ", "Append", "HashAggregate", "GroupAggregate", "WindowAgg", "Subquery Scan", "Materialize", "CTE Scan", "{",
]


def plan_text(message: Column) -> Column:
    """The plan of an auto_explain message without its query text."""
    text = F.regexp_replace(after(message, "plan:"), r"^[ \n\t]+", "")
    nodes = "|".join(n.replace("{", r"\{") for n in PLAN_NODES)
    lined = F.regexp_replace(text, r"^Query Text:[^\n]*\n[ \n\t]*", "")
    flat = F.regexp_replace(text, rf"(?s)^Query Text:.*?(?={nodes})", "")
    return F.trim(F.when(text.startswith("Query Text:"), F.when(text.contains("\n"), lined).otherwise(flat)).otherwise(text))


def _spaced(text: Column) -> Column:
    """Whether a text has white space other than single spaces."""
    return reduce(or_, [text.contains(x) for x in ("  ", "\t", "\r", "\n")])


def normalize_ws(query: Column) -> Column:
    return F.trim(F.when(_spaced(query), F.regexp_replace(query, r"[ \t\r\n]+", " ")).otherwise(query))


def normalize_query(query: Column) -> Column:
    """Literals, parameters and numbers as ?, one space for white space, ASCII letters lower, temporary schemas without numbers.

    Only a quoted name can hold what looks like a literal and is none; a text without one needs no tokens.
    """
    one = lambda t: F.when(t.rlike(r"^(?:'|\$|-?[0-9])"), "?").when(t.rlike(r"^[ \t\r\n]"), " ").otherwise(ascii_lower(t))
    text = F.array_join(F.transform(F.regexp_extract_all(query, F.lit(_TOKENS), F.lit(0)), one), "")
    # conditions ask the query, so that nothing made of it is made twice
    bare = F.regexp_replace(query, _LITERALS, "?")
    bare = F.when(_spaced(query), F.regexp_replace(bare, r"[ \t\r\n]+", " ")).otherwise(bare)
    bare = F.when(F.length(query) == F.octet_length(query), F.lower(bare)).otherwise(ascii_lower(bare))
    return F.regexp_replace(F.when(query.contains('"'), text).otherwise(bare), r"pg_(temp|toast)(?:_[0-9]+)+", r"pg_$1_?")


_INNER = r"/\*(?:[^*/]++|\*(?!/)|/(?!\*))*+\*/"
_COMMENT = rf"/\*(?:[^*/]++|{_INNER}|\*(?!/)|/(?!\*))*+\*/"


def keyword(query: Column) -> Column:
    """The statement keyword after comments (nested once at most); empty if it is none of those known."""
    words = "|".join(w for w, _ in QUERY_PREFIXES)
    return F.upper(F.regexp_extract(query, rf"^(?:[ \t\r\n]+|{_COMMENT}|--[^\n]*(?:\n|$))*+((?i:{words}))", 1))


def prefix_of_keyword(word: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in QUERY_PREFIXES for x in p]), word), F.lit("xx-"))


def query_prefix(query: Column) -> Column:
    return prefix_of_keyword(keyword(query))


def full_hash(normalized: Column) -> Column:
    return F.md5(normalized)


def query_id(raw: Column, normalized: Column) -> Column:
    """Prefix of the statement keyword and six characters of the digest of the normalised form."""
    return F.concat(query_prefix(raw), short_hash(full_hash(normalized)))


def short_hash(digest: Column) -> Column:
    """Six characters of a hexadecimal digest in base 64, without its special characters."""
    return F.substring(F.regexp_replace(F.base64(F.unhex(digest)), "[+/=]", ""), 1, 6)


def query_type(raw: Column) -> Column:
    return first_filled(keyword(raw), F.lit("OTHER"))


def query_type_from_id(id_: Column, compat: bool = True) -> Column:
    """The type an id's prefix stands for; SET shares its prefix with SELECT."""
    pairs = {}
    for word, prefix in QUERY_PREFIXES:
        pairs.setdefault(prefix, word)
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in pairs.items() for x in p]), F.substring(id_, 1, 3)), F.lit("OTHER"))


def query_category(type_: Column) -> Column:
    pairs = [F.lit(x) for name, types in QUERY_CATEGORIES.items() for t in types for x in (t, name)]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), type_), F.lit("OTHER"))


def is_transaction_command(query: Column) -> Column:
    return query.rlike("^(?:BEGIN|begin|COMMIT|commit|ROLLBACK|rollback|START|start|END|end)")


def statement_text(message: Column) -> Column:
    """The statement a message carries: after QUERY:, STATEMENT:, statement: or an executed one; else empty."""
    executed = F.regexp_extract(after(message, "duration:"), r"(?s)^.*?execute[^:]*:(.*)$", 1)
    parts = [after(message, "QUERY:"), after(message, "STATEMENT:"), after(message, "statement:"), F.nullif(executed, F.lit(""))]
    return F.coalesce(F.btrim(F.coalesce(*parts), F.lit(" \t\r\n")), F.lit(""))


def context_statement(message: Column) -> Column:
    """The statement quoted in a CONTEXT; else empty."""
    quoted = after(after(message, "CONTEXT:"), 'SQL statement "')
    return F.coalesce(F.trim(F.regexp_replace(quoted, '"$', "")), F.lit(""))
