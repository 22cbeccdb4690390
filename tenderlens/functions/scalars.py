"""Column expressions shared by the stages. All of them compile into JVM code."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def share(part: str | Column, whole: str | Column, int_division: bool = False) -> Column:
    """part / whole rounded to 3 places; 0 when the whole is 0."""
    part, whole = col(part), col(whole)
    quotient = F.try_divide(part, whole)
    if int_division:
        quotient = F.floor(quotient).cast("double")
    return F.when(whole == 0, F.lit(0.0)).otherwise(F.round(quotient, 3))


def ratio(part: str | Column, whole: str | Column) -> Column:
    """part / whole, NULL when the whole is 0."""
    return F.try_divide(col(part).cast("double"), col(whole).cast("double"))


def prefix(code: str | Column, length: int) -> Column:
    return F.substring(col(code), 1, length)


def decimal_comma(text: str | Column) -> Column:
    """Text such as 0,125 to double; text that is no number becomes NULL."""
    return F.regexp_replace(col(text), ",", ".").try_cast("double")


def to_date(yyyymmdd: str | Column) -> Column:
    """yyyymmdd integer to date; 20160000 and the like become NULL."""
    return F.try_to_date(col(yyyymmdd).cast("string"), "yyyyMMdd")


def days_between(start: str | Column, end: str | Column) -> Column:
    return F.datediff(to_date(end), to_date(start))


def month_of(yyyymmdd: str | Column) -> Column:
    return F.floor(col(yyyymmdd) / 100).cast("int") % 100


def quarter_of(month: str | Column) -> Column:
    return (F.floor((col(month) - 1) / 3) + 1).cast("int")


def clip(c: str | Column, low=None, high=None) -> Column:
    """Bound a column; NULL stays NULL (greatest and least would skip it)."""
    c = col(c)
    bounded = c
    if high is not None:
        bounded = F.least(bounded, high if isinstance(high, Column) else F.lit(high))
    if low is not None:
        bounded = F.greatest(bounded, low if isinstance(low, Column) else F.lit(low))
    return F.when(c.isNotNull(), bounded)


def log_floor_one(c: str | Column) -> Column:
    """Natural logarithm after raising values below 1 to 1."""
    return F.ln(clip(col(c).cast("double"), low=1.0))


def hash_percent(key: str | Column, mode: str = "hash") -> Column:
    """0..99 drawn from the key: by hash, or by modulo where another engine must agree."""
    drawn = F.xxhash64(col(key)) if mode == "hash" else col(key)
    return F.pmod(drawn, F.lit(100))


def flag(condition: Column) -> Column:
    """1 where the condition holds, else 0 (also when it is unknown)."""
    return F.when(condition, 1).otherwise(0)


def nan_to_null(c: str | Column) -> Column:
    return F.when(~F.isnan(col(c)), col(c))
