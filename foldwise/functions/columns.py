"""Column expressions for the feature operators.

Everything here returns a ``Column`` built from Spark SQL functions so it
stays inside whole-stage code generation; no Python UDFs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that must equal the reference for identical results.
RATIO_EPS = 1e-8                      # interaction_ratio denominator offset
TITLE_PATTERN = r" ([A-Za-z]+)\."     # honorific: space, letters, a dot
RARE_TITLE = "Rare"
UNKNOWN_DECK = "U"
MISSING_CATEGORY = "__na__"
UNSEEN_CODE = -1
MICROS_PER_DAY = 86_400_000_000


def as_double(c: str | Column) -> Column:
    """DOUBLE; NaN and text that is no number are missing (NULL)."""
    col = F.col(c) if isinstance(c, str) else c
    return F.nanvl(col.try_cast("double"), F.lit(None).cast("double"))


def log1p_or_null(c: str) -> Column:
    """ln(1+x); Spark yields NULL where the logarithm is undefined."""
    return F.log1p(as_double(c))


def sqrt_or_null(c: str) -> Column:
    x = as_double(c)
    return F.when(x >= 0, F.sqrt(x))


def multiply(a: str, b: str) -> Column:
    return as_double(a) * as_double(b)


def ratio(a: str, b: str) -> Column:
    return F.try_divide(as_double(a), as_double(b) + F.lit(RATIO_EPS))


def square(c: str) -> Column:
    x = as_double(c)
    return x * x


def right_closed_bin(c: str, interior_edges: Sequence[float]) -> Column:
    """Bin code of x for bins (-inf, e1], (e1, e2], ..., (ek, inf): the number
    of interior edges strictly below x; NULL stays NULL."""
    x = as_double(c)
    code = F.lit(0)
    for e in interior_edges:
        code = code + (x > F.lit(float(e))).cast("int")
    return F.when(x.isNotNull(), code)


def equal_width_edges(lo: float, hi: float, bins: int) -> list[float]:
    """Interior edges of ``bins`` equal-width bins between lo and hi (as
    numpy's linspace computes them: lo + i * ((hi - lo) / bins))."""
    step = (hi - lo) / bins
    return [lo + i * step for i in range(1, bins)]


def as_timestamp(c: str, dtype: str) -> Column:
    """Coerce to a timestamp; unparsable values become NULL."""
    if dtype.startswith("timestamp") or dtype == "date":
        return F.col(c).cast("timestamp")
    return F.try_to_timestamp(F.col(c).cast("string"))


def epoch_micros(c: str | Column, dtype: str) -> Column:
    """Microseconds since 1970-01-01 00:00 of the value's wall clock.

    Time-zone-free values (TIMESTAMP_NTZ, DATE, parsed text) are read as UTC
    wall clocks whatever the session time zone, so differences between them
    never pick up daylight-saving shifts; TIMESTAMP values are instants."""
    col = F.col(c) if isinstance(c, str) else c
    if dtype == "timestamp":
        return F.unix_micros(col)
    if dtype.startswith("timestamp") or dtype == "date":
        ts = col.cast("timestamp")
    else:
        ts = F.try_to_timestamp(col.cast("string"))
    # the cast read the wall clock in the session zone; shift the instant back
    # so its UTC rendering is that wall clock again
    return F.unix_micros(F.from_utc_timestamp(ts, F.current_timezone()))


def weekday_mon0(ts: Column) -> Column:
    """Day of week with Monday = 0."""
    return F.weekday(ts)


def days_since(micros: Column, origin_micros: int | None) -> Column:
    """Whole days between two ``epoch_micros`` values, floored (negative
    before the origin)."""
    if origin_micros is None:
        return F.lit(None).cast("bigint")
    return F.floor((micros - F.lit(origin_micros)) / F.lit(MICROS_PER_DAY)).cast("bigint")


def title_of(c: str) -> Column:
    return F.nullif(F.regexp_extract(F.col(c).cast("string"), TITLE_PATTERN, 1), F.lit(""))


def family_size(a: str, b: str) -> Column:
    return F.coalesce(as_double(a), F.lit(0.0)) + F.coalesce(as_double(b), F.lit(0.0)) + F.lit(1.0)


def is_alone(a: str, b: str) -> Column:
    return (family_size(a, b) == 1.0).cast("int")


def cabin_deck(c: str) -> Column:
    first = F.substring(F.col(c).cast("string"), 1, 1)
    return F.coalesce(F.nullif(first, F.lit("")), F.lit(UNKNOWN_DECK))


def category_text(c: str) -> Column:
    """Category value as text with NULL as its own category."""
    return F.coalesce(F.col(c).cast("string"), F.lit(MISSING_CATEGORY))
