"""Column functions that the operators share. All are built-in expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Texts that stand for a missing value in the source files.
MISSING = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")
#: Fixed value: the last day of the rating log.
END_DATE = "2009-01-05"
DATE_PARTS = ("date_year", "date_month", "date_day", "date_hour", "date_minute", "date_second")


def null_if_missing(c: Column) -> Column:
    return F.when(~c.isin(*MISSING), c)


def event_time(parts=DATE_PARTS, strict: bool = True) -> Column:
    """A timestamp of six integer columns; bad parts raise, or give null if not strict."""
    return (F.make_timestamp if strict else F.try_make_timestamp)(*(F.col(p) for p in parts))


def elapsed_days(start: Column, end: Column) -> Column:
    """Whole days from start to end, rounded down; not the number of midnights between."""
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    return F.floor((micros(end) - micros(start)) / F.lit(86_400_000_000)).cast("long")


def or_zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0))


def share(part: Column, whole: Column, digits: int | None = None) -> Column:
    """100 * part / whole; 0 where whole is 0."""
    x = F.coalesce(F.try_divide(100.0 * part, whole), F.lit(0.0))
    return x if digits is None else F.round(x, digits)


def to_number(c: Column) -> Column:
    """A double, or null for text that isn't a number (or isn't one by name: NaN)."""
    x = c.cast("string").try_cast("double")
    return F.when(~F.isnan(x), x)


def clip(c: Column, low=None, high=None) -> Column:
    """Null stays null, unlike in greatest() and least()."""
    x = c
    if low is not None:
        x = F.greatest(x, F.lit(low))
    if high is not None:
        x = F.least(x, F.lit(high))
    return F.when(c.isNotNull(), x)


def half_star(c: Column) -> Column:
    """To half steps, halves to the even side."""
    return F.bround(c * 2) / 2


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column, least: float = 1e-9) -> Column:
    return F.greatest(F.sqrt(dot(a, a)), F.lit(least))


def cosine(a: Column, b: Column, floor: float = 1e-9) -> Column:
    return dot(a, b) / (norm(a, floor) * norm(b, floor))


def concat_reasons(reasons: dict[str, Column]) -> Column:
    """The names of the masks that hold, joined with semicolons; masks of null don't hold."""
    return F.concat_ws(";", *(F.when(F.coalesce(m, F.lit(False)), F.lit(n)) for n, m in reasons.items()))


def any_of(masks) -> Column:
    return reduce(lambda a, b: a | b, (F.coalesce(m, F.lit(False)) for m in masks))
