"""Number helpers: exact millisecond sums, tolerant parsing of textual listings, labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Decimal byte units by suffix.
BYTE_UNITS = {"tb": 10**12, "gb": 10**9, "mb": 10**6, "kb": 10**3, "t": 10**12, "g": 10**9,
              "m": 10**6, "k": 10**3, "b": 1}


def hundredths(ms: Column) -> Column:
    """Milliseconds as whole hundredths: response times carry two decimals, so integer sums are
    exact and do not depend on the order in which partitions are merged."""
    return F.round(ms * 100).cast("bigint")


def sum_ms(ms: Column) -> Column:
    return F.sum(hundredths(ms)) / 100.0


def avg_ms(ms: Column) -> Column:
    return F.sum(hundredths(ms)) / 100.0 / F.count(ms)


def keep_rate(key: Column, rate: float, salt: str = "") -> Column:
    """Deterministic sampling by key, so a re-run or a retried task keeps the same rows."""
    if rate >= 1.0:
        return F.lit(True)
    if rate <= 0.0:
        return F.lit(False)
    digest = F.substring(F.md5(F.concat(F.lit(salt), key.cast("string"))), 1, 8)
    return F.conv(digest, 16, 10).cast("bigint") < int(rate * 2**32)


def safe_int(text: Column, default: int | None = 0) -> Column:
    """Whole number or the default; a text with a fraction is not a whole number."""
    trimmed = F.trim(text.cast("string"))
    whole = F.when(F.regexp_like(trimmed, F.lit(r"^[+-]?\d+$")), trimmed.try_cast("bigint"))
    return F.coalesce(whole, F.lit(default).cast("bigint"))


def safe_float(text: Column, default: float = 0.0) -> Column:
    number = text.try_cast("double")
    usable = number.isNotNull() & ~F.isnan(number) & (F.abs(number) != float("inf"))
    return F.when(usable, number).otherwise(default)


def half_even(number: Column, digits: int = 0) -> Column:
    """Fixed-point text, ties to even."""
    exact = number.cast("double").cast("decimal(38,12)")
    return F.bround(exact, digits).cast(f"decimal(38,{digits})").cast("string")


def byte_label(n: Column) -> Column:
    return (
        F.when(n >= 10**9, F.concat(half_even(n / 1e9, 1), F.lit("GB")))
        .when(n >= 10**6, F.concat(half_even(n / 1e6), F.lit("MB")))
        .otherwise(F.concat(half_even(n / 1e3), F.lit("KB")))
    )


def byte_count(text: Column) -> Column:
    """Bytes of a size such as '5gb' or '512 mb'; null if it cannot be read."""
    pattern = r"^(.*?)(tb|gb|mb|kb|t|g|m|k|b)?$"
    low = F.lower(F.trim(text))
    amount = F.trim(F.regexp_extract(low, pattern, 1)).try_cast("double")
    units = F.create_map(*[F.lit(x) for pair in BYTE_UNITS.items() for x in pair])
    factor = F.coalesce(F.try_element_at(units, F.regexp_extract(low, pattern, 2)), F.lit(1))
    finite = ~F.isnan(amount) & (F.abs(amount) != float("inf"))
    return F.when((low != "") & finite, (amount * factor).try_cast("bigint"))


def grouped(n: Column) -> Column:
    """Whole number with thousands separators."""
    return F.format_number(n, 0)
