"""Numbers as people read them."""

from __future__ import annotations


def time_ms(ms: float | None) -> str:
    """Milliseconds as ms, s, minutes, hours or days."""
    whole = int(ms or 0)
    if whole < 1000:
        return f"{whole} ms"
    s = (ms or 0) / 1000
    if s < 60:
        return f"{s:.2f} s"
    minutes, seconds = divmod(int(s), 60)
    if minutes < 60:
        return f"{minutes}m {seconds:02d}s"
    hours, minutes = divmod(minutes, 60)
    if hours < 24:
        return f"{hours}h {minutes:02d}m {seconds:02d}s"
    return f"{hours // 24}d {hours % 24}h {minutes:02d}m"


def span_us(us: float | None) -> str:
    """Microseconds as hours, minutes and seconds."""
    s = (us or 0) / 1_000_000
    if s < 60:
        return f"{s:.3f}".rstrip("0").rstrip(".") + "s"
    h, rest = divmod(int(s), 3600)
    return (f"{h}h" if h else "") + f"{rest // 60}m{rest % 60}s"


def _scaled(n: float, units: list[str], digits: list[int]) -> str:
    i = 0
    while n >= 1024 and i < len(units) - 1:
        n, i = n / 1024, i + 1
    return f"{n:.{digits[i]}f} {units[i]}"


def size(n: int | None) -> str:
    return _scaled(n or 0, ["B", "KB", "MB", "GB", "TB"], [0, 2, 2, 2, 2])


def rate(n: float | None) -> str:
    return _scaled(n or 0, ["B/s", "kB/s", "MB/s", "GB/s"], [0, 0, 2, 2])


def per_hour(n: float) -> str:
    return f"{n:.1f}/h" if n >= 1 else f"{n / 60:.3f}/m"


def bar(count: float, peak: float, width: int = 40, mark: str = "■") -> str:
    """A bar of a histogram: one mark for each ceil(peak / width)."""
    scale = max(1, -(-int(peak) // width))
    return mark * int(count // scale)


def indent_plan(plan: str) -> str:
    """A plan on one line, broken before each node; JSON plans are laid out."""
    import json
    import re

    text = plan.strip()
    if text.startswith(("{", "[")):
        try:
            return json.dumps(json.loads(text), indent=2)
        except ValueError:
            return text
    if "\n" in text:
        return text
    depth, lines = 0, []
    for part in re.split(r"\s*->\s*", text):
        lines.append("  " * depth + ("-> " if depth else "") + part)
        depth += 1
    return "\n".join(lines)


def layout_sql(query: str) -> str:
    """A query with its main clauses on lines of their own."""
    import re

    return re.sub(r"\s+(?=(?:FROM|WHERE|GROUP BY|ORDER BY|HAVING|LIMIT|LEFT JOIN|INNER JOIN|JOIN|UNION|VALUES|SET|RETURNING)\b)", "\n", query.strip(), flags=re.I)
