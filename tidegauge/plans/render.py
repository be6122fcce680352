"""Text of small results for a terminal: tables, sparklines and gauges. Only here are rows collected, and only so many."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Rows that a table shows at most.
ROWS = 200
GLYPHS = " ▁▂▃▄▅▆▇█"


def text_table(df: DataFrame, rows: int = ROWS) -> str:
    """The first rows as aligned text, doubles with one decimal (ties to even)."""
    cells = [df.columns] + [[f"{v:.1f}" if isinstance(v, float) else "" if v is None else str(v) for v in r] for r in df.limit(rows).collect()]
    widths = [max(len(r[k]) for r in cells) for k in range(len(df.columns))]
    return "\n".join("  ".join(c.ljust(w) for c, w in zip(r, widths, strict=True)).rstrip() for r in cells)


def sparkline(levels: list[int], height: int = 5) -> str:
    """Levels 0 to 8 as a column chart of ``height`` lines, the highest first: a column fills as many lines as its level has."""
    return "\n".join("".join(GLYPHS[level] if level >= line else " " for level in levels) for line in range(height, 0, -1))


def labelled_sparklines(series: dict[str, list[int]], width: int = 12) -> str:
    """One line a series, its levels on a common scale, behind its label at the right of a column of ``width``."""
    return "\n".join((f"{name + ':':>{width}} " if name else "") + sparkline(levels, 1) for name, levels in series.items())


def gauge(bar: str, percent: float | None = None, value: float | None = None, unit: str = "") -> str:
    """A bar with its percentage, or with its value and unit."""
    return bar + (f" {percent:5.1f}%" if percent is not None else f" {value:6.1f}{' ' * bool(unit)}{unit}" if value is not None else "")
