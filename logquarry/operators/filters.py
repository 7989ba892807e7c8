"""Row filters on entries, before any analysis."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logquarry.functions.text import filter_value

FORMAT = "%Y-%m-%d %H:%M:%S"


def parse_duration(text: str) -> timedelta:
    """``90m``, ``2h30m``, ``7d``, ``1.5s``; units d, h, m, s, ms."""
    import re

    parts = re.findall(r"([0-9]*\.?[0-9]+)(ms|d|h|m|s)", text or "")
    if not parts or "".join(a + b for a, b in parts) != text:
        raise ValueError(f"not a duration: {text!r}")
    seconds = {"d": 86400, "h": 3600, "m": 60, "s": 1, "ms": 0.001}
    return timedelta(seconds=sum(float(a) * seconds[b] for a, b in parts))


@dataclass
class TimeRange:
    """Both bounds inclusive. window completes the bound that is missing; last counts back from now."""

    begin: str | None = None
    end: str | None = None
    window: str | None = None
    last: str | None = None
    now: datetime | None = None

    def bounds(self) -> tuple[datetime | None, datetime | None]:
        if self.last and (self.begin or self.end or self.window):
            raise ValueError("last cannot be combined with begin, end or window")
        if self.last:
            now = self.now or datetime.now(timezone.utc).replace(tzinfo=None)
            return now - parse_duration(self.last), now
        lo, hi = (datetime.strptime(x, FORMAT) if x else None for x in (self.begin, self.end))
        if self.window and (lo is None) != (hi is None):
            span = parse_duration(self.window)
            lo, hi = (lo, lo + span) if lo else (hi - span, hi)
        if lo and hi and lo > hi:
            raise ValueError("begin is after end")
        return lo, hi


@dataclass
class Filters:
    """All kinds must hold; values of one kind are alternatives. An entry without the value fails a whitelist and passes a blacklist."""

    time: TimeRange = field(default_factory=TimeRange)
    db: list[str] = field(default_factory=list)
    user: list[str] = field(default_factory=list)
    exclude_user: list[str] = field(default_factory=list)
    app: list[str] = field(default_factory=list)
    grep: list[str] = field(default_factory=list)

    def apply(self, entries: DataFrame) -> DataFrame:
        lo, hi = self.time.bounds()
        m = F.col("message")
        if lo:
            entries = entries.where(F.col("ts") >= F.lit(lo.isoformat(" ")).cast("timestamp"))
        if hi:
            entries = entries.where(F.col("ts") <= F.lit(hi.isoformat(" ")).cast("timestamp"))
        if self.exclude_user:
            entries = entries.where(~filter_value(m, "user").isin(self.exclude_user))
        for key in ("db", "user", "app"):
            if values := getattr(self, key):
                entries = entries.where(m.contains(f"{key}=") & filter_value(m, key).isin(values))
        for text in self.grep:
            entries = entries.where(m.contains(text))
        return entries
