"""Human-readable text of numbers, names, temperatures and gauges."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

FILLED, EMPTY = "▓", "░"
SUFFIXES = "KMGTPE"


def _text(x: Column) -> Column:
    return x.cast("string")


def zero_padded(n: Column) -> Column:
    """A whole number, with a leading zero below 10."""
    return F.when(n < 10, F.concat(F.lit("0"), _text(n.cast("bigint")))).otherwise(_text(n.cast("bigint")))


def one_decimal(x: Column) -> Column:
    """One decimal place, cut off rather than rounded; the digit is held within 0 and 9. For x >= 0."""
    whole = F.floor(x).cast("bigint")
    digit = F.least(F.greatest(F.floor((x - whole) * 10).cast("bigint"), F.lit(0)), F.lit(9))
    return F.concat(_text(whole), F.lit("."), _text(digit))


#: 10 and 100 as sums of powers of two, by which a product is exact.
_POWERS = {1: (8, 2), 2: (64, 32, 4)}


def fixed(x: Column, places: int = 1) -> Column:
    """One or two decimal places, rounded from the number's binary value, ties to even, as C's "%.1f" and "%.2f". For |x| < 2 ** 46.

    Ten or a hundred times x is a sum of exact products; what that sum loses by rounding decides where it looks like a tie.
    """
    scale = 10**places

    def product(size: Column) -> Column:
        total, *others = (size * p for p in _POWERS[places])
        lost = F.lit(0.0)
        for part in others:
            grown = total + part
            total, lost = grown, lost + (part - (grown - total))
        return F.struct(total.alias("total"), lost.alias("lost"), F.floor(total).cast("bigint").alias("low"))

    def text(p: Column) -> Column:
        over = p["total"] - p["low"] - 0.5
        up = (over > 0) | ((over == 0) & ((p["lost"] > 0) | ((p["lost"] == 0) & (p["low"] % 2 == 1))))
        return _digits(p["low"] + up.cast("bigint"), scale, places)

    # Each step is bound to a name, as the next one uses it several times.
    return F.concat(F.when(x < 0, "-").otherwise(""), _bound(_bound(F.abs(x), product), text))


def _digits(n: Column, scale: int, places: int) -> Column:
    return F.concat(_text(F.floor(n / scale).cast("bigint")), F.lit("."), F.lpad(_text(n % scale), places, "0"))


def _bound(x: Column, step: Callable[[Column], Column]) -> Column:
    """``step(x)`` with x worked out once."""
    return F.get(F.transform(F.array(x), step), F.lit(0))


def left_padded(s: Column, width: int) -> Column:
    """Blanks to the left up to ``width``; longer text stays whole."""
    return F.concat(F.repeat(F.lit(" "), F.greatest(F.lit(width) - F.length(s), F.lit(0))), s)


def whole(x: Column) -> Column:
    """Nearest whole number, halves up. For x >= 0."""
    return _text(F.floor(x + 0.5).cast("bigint"))


def short_float(x: Column) -> Column:
    """One decimal below 10, none from 10 on."""
    return F.when(x < 10, one_decimal(x)).otherwise(whole(x))


def format_bytes(n: Column) -> Column:
    """A size in units of 1024: the largest unit that is not above the size."""
    out = F.concat(zero_padded(n), F.lit(" B"))
    for power, suffix in enumerate(SUFFIXES, 1):
        unit = float(1024**power)
        out = F.when(n >= F.lit(unit), F.concat(short_float(n.cast("double") / unit), F.lit(f" {suffix}B"))).otherwise(out)
    return out


def scaled_number(n: Column) -> Column:
    """struct(value, suffix): a count in thousands, millions or billions; its text has two decimals."""
    steps = ((1e9, "B"), (1e6, "M"), (1e3, "K"))
    value, suffix = n.cast("double"), F.lit("")
    for size, name in reversed(steps):
        value = F.when(n >= size, n.cast("double") / size).otherwise(value)
        suffix = F.when(n >= size, F.lit(name)).otherwise(suffix)
    return F.struct(value.alias("value"), suffix.alias("suffix"))


def format_number(n: Column) -> Column:
    """``scaled_number`` as text for display; below 1000 the plain number."""
    s = scaled_number(n)
    return F.when(n < 1000, _text(n)).otherwise(F.concat(fixed(s["value"], 2), s["suffix"]))


def truncate(s: Column, most: int) -> Column:
    """At most ``most`` code points, the last three as dots where cut; ``most`` of 3 or less changes nothing."""
    if most <= 3:
        return s
    return F.when(F.length(s) <= most, s).otherwise(F.concat(F.substring(s, 1, most - 3), F.lit("...")))


def padded(s: Column, width: int) -> Column:
    """Blanks to the right up to ``width``; longer text stays whole."""
    return F.concat(s, F.repeat(F.lit(" "), F.greatest(F.lit(width) - F.length(s), F.lit(0))))


def percent_of(value: Column, most: float = 100.0) -> Column:
    """A gauge's percentage, held within 0 and 100; a maximum of 0 counts as 1."""
    return F.least(F.greatest(value / F.lit(float(most or 1.0)) * 100, F.lit(0.0)), F.lit(100.0))


def bar_cells(value: Column, most: float = 100.0, width: int = 20) -> Column:
    """Number of filled cells of a bar gauge."""
    return F.least(F.floor(F.lit(float(width)) * (percent_of(value, most) / 100.0)), F.lit(width)).cast("int")


def bar(value: Column, most: float = 100.0, width: int = 20) -> Column:
    cells = bar_cells(value, most, width)
    return F.concat(F.repeat(F.lit(FILLED), cells), F.repeat(F.lit(EMPTY), F.lit(width) - cells))


def colored_gauge(value: Column, color: Callable[[Column], Column], most: float = 100.0, width: int = 20) -> Column:
    """struct(bar, percent, color): a gauge whose colour any function of the raw value chooses."""
    return F.struct(bar(value, most, width).alias("bar"), percent_of(value, most).alias("percent"), color(value).alias("color"))


def gauge_text(value: Column, most: float = 100.0, width: int = 20, number: str = "percent") -> Column:
    """A bar gauge as text: with its percentage, its 'value', or 'none' of them."""
    cells = bar(value, most, width)
    if number == "percent":
        return F.concat(cells, F.lit(" "), left_padded(fixed(percent_of(value, most)), 5), F.lit("%"))
    return F.concat(cells, F.lit(" "), left_padded(fixed(value), 6)) if number == "value" else cells


def mini_gauge(value: Column, unit: str = "", most: float = 100.0, width: int = 15, number: bool = True) -> Column:
    """A compact gauge as text: the bar, the value and its unit, if it has one."""
    cells = bar(value, most, width)
    return F.concat(cells, F.lit(" "), left_padded(fixed(value), 6), F.lit(f" {unit}" if unit else "")) if number else cells


def fahrenheit(celsius: Column) -> Column:
    return celsius * 9 / 5 + 32


def in_unit(celsius: Column, unit: Column | str = "C") -> Column:
    unit = F.lit(unit) if isinstance(unit, str) else unit
    return F.when(unit == "F", fahrenheit(celsius)).otherwise(celsius)


def format_temperature(celsius: Column, unit: str = "C") -> Column:
    return F.concat(_text(F.rint(in_unit(celsius, unit)).cast("bigint")), F.lit(f"°{unit}"))


def clock(ts: Column) -> Column:
    return F.date_format(ts, "HH:mm:ss")


def interval_label(nanos: Column) -> Column:
    """500ms, 1s, 2s or 5s; any other interval reads 1s."""
    out = F.lit("1s")
    for size, name in ((500_000_000, "500ms"), (2_000_000_000, "2s"), (5_000_000_000, "5s")):
        out = F.when(nanos == size, F.lit(name)).otherwise(out)
    return out


def on_off(flag: Column) -> Column:
    return F.when(flag, F.lit("ON")).otherwise(F.lit("OFF"))


def parsed_int(s: Column) -> Column:
    """A whole number from text, null where it isn't one."""
    return s.try_cast("int")
