"""Column expressions over text: n-grams, lines, titles, sizes, durations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ngrams(word: Column, least: int = 5) -> Column:
    """Character n-grams: 3 for words below 7 characters, 4 below 9, else 5; a word below `least` is its own gram."""
    n = F.when(F.length(word) >= 9, 5).when(F.length(word) >= 7, 4).otherwise(3)
    grams = F.transform(F.sequence(F.lit(1), F.length(word) - n + 1), lambda i: F.substring(word, i, n))
    return F.when(F.length(word) >= least, grams).otherwise(F.array(word))


def line_number(text: Column, pos: Column) -> Column:
    """1-based line of a 0-based code point: one more than the line ends before it."""
    before = F.substring(text, F.lit(1), pos)
    return F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1


def lines(text: Column) -> Column:
    """Lines without their ends; a carriage return before a line end goes too."""
    return F.transform(F.split(text, "\n", -1), lambda x: F.regexp_replace(x, "\r$", ""))


def title(text: Column, n: int = 5) -> Column:
    """The first lines of a text, stripped."""
    return F.regexp_replace(F.array_join(F.slice(lines(text), 1, n), "\n"), r"^\s+|\s+$", "")


def in_units(n: Column, unit: int, name: str, up: bool = False) -> Column:
    """n in units (a power of two up to 2^30) with two decimals: of the double nearest to n, halves to the even digit, as C prints them, or up, as ROUND does."""
    whole = n.cast("double").cast("long")
    rest = F.pmod(whole, F.lit(unit)) * 100
    cents, left = F.floor(rest / unit), F.pmod(rest, F.lit(unit)) * 2  # rest / unit is exact: below 2^37, by a power of two
    cents = cents + F.when((left > unit) | ((left == unit) & (F.lit(up) | (cents % 2 == 1))), 1).otherwise(0)
    units = F.shiftright(whole, unit.bit_length() - 1) + F.floor(cents / 100)
    return F.concat(units.cast("string"), F.lit("."), F.lpad((cents % 100).cast("string"), 2, "0"), F.lit(f" {name}"))


def size_text(n: Column, up: bool = False) -> Column:
    """B below 1024, then KB, MB, GB with two decimals; up: halves are rounded up, else to the even digit."""
    kb, mb, gb = 1 << 10, 1 << 20, 1 << 30
    return (
        F.when(n < kb, F.concat(n.cast("string"), F.lit(" B")))
        .when(n < mb, in_units(n, kb, "KB", up))
        .when(n < gb, in_units(n, mb, "MB", up))
        .otherwise(in_units(n, gb, "GB", up))
    )


def duration_text(seconds: Column) -> Column:
    """[D day[s], ]H:MM:SS of whole seconds."""
    days, rest = F.expr("1") * F.floor(seconds / 86400), F.pmod(seconds, F.lit(86400))
    clock = F.format_string("%d:%02d:%02d", F.floor(rest / 3600), F.floor(F.pmod(rest, F.lit(3600)) / 60), F.pmod(rest, F.lit(60)))
    return F.when(days == 0, clock).otherwise(F.concat(days.cast("string"), F.when(F.abs(days) == 1, " day, ").otherwise(" days, "), clock))
