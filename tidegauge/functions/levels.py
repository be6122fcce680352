"""Threshold classification: the first threshold that a value reaches names its level."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The four colours of the levels.
RED, ORANGE, YELLOW, GREEN = "#BF616A", "#D08770", "#EBCB8B", "#A3BE8C"

Steps = tuple[tuple[float, str], ...]
# Thresholds from high to low, and the level below all of them.
TEMP_LABEL: tuple[Steps, str] = (((85, "Critical"), (70, "High"), (60, "Warm")), "Normal")
TEMP_STATUS: tuple[Steps, str] = (((85, "critical"), (70, "warning")), "normal")
TEMP_COLOR: tuple[Steps, str] = (((85, RED), (70, ORANGE), (60, YELLOW)), GREEN)
CPU_COLOR: tuple[Steps, str] = (((80, RED), (50, ORANGE), (30, YELLOW)), GREEN)
MEMORY_COLOR: tuple[Steps, str] = (((90, RED), (70, ORANGE), (50, YELLOW)), GREEN)
LIVE_CPU_COLOR: tuple[Steps, str] = (((80, RED), (50, ORANGE)), GREEN)
LIVE_MEMORY_COLOR: tuple[Steps, str] = (((90, RED), (70, ORANGE)), GREEN)


def level(x: Column, scale: tuple[Steps, str]) -> Column:
    steps, lowest = scale
    out = F.lit(lowest)
    for threshold, name in reversed(steps):
        out = F.when(x >= threshold, F.lit(name)).otherwise(out)
    return out


def first_below(x: Column, ends: list[tuple[float, str]], default: str) -> Column:
    """The name of the first column whose end lies beyond x: a range lookup against a few ordered bounds."""
    out = F.lit(default)
    for end, name in reversed(ends):
        out = F.when(x < end, F.lit(name)).otherwise(out)
    return out


def within(x: Column, spans: list[tuple[float, float, str]]) -> Column:
    """The name of the span with start <= x < end, null outside all."""
    out = F.lit(None).cast("string")
    for start, end, name in reversed(spans):
        out = F.when((x >= start) & (x < end), F.lit(name)).otherwise(out)
    return out
