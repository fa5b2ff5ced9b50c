"""Casts, money text, dates and small numeric helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampNTZType, TimestampType

# The characters stripped from money text and the date shape
# that marks a text column as a date column.
MONEY_STRIP = r"[$,]"
DATE_LIKE = r"\d{4}[-/]\d{2}[-/]\d{2}"
WHOLE_DATE = (r"^\s*\d{4}([-/])\d{2}\1\d{2}"
              r"([ T]\d{2}:\d{2}(:\d{2}(\.\d{1,9})?)?(Z|[+-]\d{2}:?\d{2})?)?\s*$")


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def money(col, strict: bool = True) -> Column:
    """'$1,234' -> 1234.0.  Text that is not a number afterwards raises (ANSI
    cast), as the source does; ``strict=False`` makes it NULL."""
    bare = F.regexp_replace(_c(col).cast("string"), MONEY_STRIP, "")
    return bare.cast("double") if strict else bare.try_cast("double")


def to_number(col) -> Column:
    """Lenient numeric cast: bad text -> NULL."""
    return _c(col).try_cast("double")


def to_int_strict(col) -> Column:
    """Strip '$' and ',' then cast to bigint; ANSI mode raises on bad text
    ('' or '1234.5'), as the source does.  NULL stays NULL."""
    return F.regexp_replace(_c(col).cast("string"), MONEY_STRIP, "").cast("bigint")


def to_int_lenient(col) -> Column:
    return F.regexp_replace(_c(col).cast("string"), MONEY_STRIP, "").try_cast("bigint")


def trunc_int(col) -> Column:
    """pandas ``astype(int)`` on floats: truncate toward zero."""
    return _c(col).cast("bigint")


def to_day(col) -> Column:
    """Parse 'yyyy-MM-dd' or 'yyyy/MM/dd', alone or followed by a time of day
    and an offset (both dropped); any other text -> NULL.  The whole text has
    to fit: '2022-01-05x' and '2022-01-05 25:00' are no dates."""
    c = F.trim(_c(col).cast("string"))
    plain = F.regexp_replace(F.regexp_replace(c, "/", "-"), r"(Z|[+-]\d{2}:?\d{2})$", "")
    whole = F.when(F.length(c) <= 10, F.regexp_replace(c, "/", "-")).otherwise(plain)
    return F.when(c.rlike(WHOLE_DATE), F.to_date(whole.try_cast("timestamp_ntz")))


def month_start_date(col) -> Column:
    """DATE_TRUNC('month', TO_DATE(x)) as DATE.  Text with a UTC offset keeps
    its wall-clock date (the offset is dropped, as ::TIMESTAMP_NTZ does)."""
    return F.trunc(F.to_date(_c(col).cast("string").try_cast("timestamp_ntz")), "month")


def month_start_text(col) -> Column:
    """TO_CHAR(DATE_TRUNC('month', x::TIMESTAMP_NTZ), 'YYYY-MM-DD')."""
    return F.date_format(month_start_date(col), "yyyy-MM-dd")


def epoch_seconds(col, dtype=None) -> Column:
    """Whole epoch seconds of a timestamp.  TIMESTAMP_NTZ is read as UTC wall
    clock with zone-free field arithmetic, so the result never depends on
    the session time zone (no DST shift)."""
    c = _c(col)
    if isinstance(dtype, TimestampType):
        return F.unix_seconds(c)
    if dtype is None or isinstance(dtype, TimestampNTZType):
        days = F.datediff(F.to_date(c), F.lit("1970-01-01").cast("date")).cast("bigint")
        return (days * 86400 + F.hour(c) * 3600 + F.minute(c) * 60
                + F.second(c)).cast("bigint")
    raise TypeError(f"not a timestamp type: {dtype}")


def log1p_positive(col) -> Column:
    """log(1 + x) for x > 0, else NULL."""
    return F.when(_c(col) > 0, F.log1p(_c(col)))


def money_text(col) -> Column:
    """'$' + thousands-grouped whole number (Python ``f"${x:,.0f}"``)."""
    return F.concat(F.lit("$"), F.format_number(F.bround(_c(col).cast("double"), 0), 0))


def fixed_text(col, digits: int) -> Column:
    """Python ``f"{x:.{digits}f}"``: the exact binary value is rounded, half
    to even.

    Rounding the shortest decimal text of a double goes wrong only where that
    text is exactly half-way (2.675 is a little less than 2.675).  There the
    sides are compared as integers: x = m / 2**k and the half-way point is
    t / 10**(digits + 1).  Exact for 2**-8 <= |x| < 2**42.
    """
    x = _c(col).cast("double")
    size = F.abs(x)
    # Powers of two that make every value of a range an integer below 2**63.
    k = F.when(size < 1, 60).when(size < 1024, 52).when(size < 2 ** 20, 42).otherwise(20)
    m = F.floor(size * F.pow(F.lit(2.0), k)).cast("decimal(38,0)")
    two_k = F.pow(F.lit(2.0), k).cast("bigint").cast("decimal(20,0)")
    scale = 10 ** (digits + 1)
    text = size.cast("string").cast(f"decimal(28,{digits + 8})")
    t = F.floor(text * F.lit(scale).cast("decimal(18,0)")).cast("decimal(18,0)")
    half = (text * F.lit(scale).cast("decimal(18,0)") == t) & (F.pmod(t, F.lit(10)) == 5)
    gap = m * F.lit(scale).cast("decimal(12,0)") - t * two_k
    down = F.floor(t / 10).cast("bigint")
    odd = F.pmod(down, F.lit(2)) == 1
    unit = down + F.when((gap > 0) | ((gap == 0) & odd), 1).otherwise(0)
    tie = F.when(x < 0, F.lit(-1.0)).otherwise(F.lit(1.0)) * unit / F.lit(float(10 ** digits))
    ok = half & size.between(2.0 ** -8, 2.0 ** 42)
    return F.format_string(f"%.{digits}f", F.when(ok, tie).otherwise(F.bround(x, digits)))
