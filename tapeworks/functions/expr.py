"""Scalar functions as Column expressions."""

from pyspark.sql import Column, functions as F

EPSILON = 2.220446049250313e-16


def round_to(c: Column, precision: int = 4) -> Column:
    """Half away from zero, by scaling the double (not its decimal text)."""
    scale = F.lit(10.0**precision)
    return F.round(c * scale) / scale


def percent_change(old: Column, new: Column) -> Column:
    return F.when(old == 0, F.lit(0.0)).otherwise(F.try_divide(new - old, old) * 100)


def ieee_divide(n: Column, d: Column) -> Column:
    """n / d of doubles as processors divide: by zero it is infinite (signed as n and the zero are), or NaN for 0 / 0."""
    return F.when(d == 0, n * F.pow(d, F.lit(-1.0))).otherwise(F.try_divide(n, d))


def safe_divide(n: Column, d: Column, default: float) -> Column:
    return F.when(F.abs(d) < EPSILON, F.lit(default)).otherwise(F.try_divide(n, d))


def from_epoch_millis(c: Column) -> Column:
    return F.timestamp_millis(c)


def next_trading_day(ts: Column) -> Column:
    """A day later, over the weekend; keeps the time of day, knows no holidays."""
    days = F.when(F.weekday(ts) == 4, 3).when(F.weekday(ts) == 5, 2).otherwise(1)
    return ts + F.make_dt_interval(days)


def safe_truncate(s: Column, limit: int) -> Column:
    """At most ``limit`` bytes stay as they are; else the first characters and three dots."""
    return F.when(F.octet_length(s) <= limit, s).otherwise(F.concat(F.substring(s, 1, max(limit - 3, 0)), F.lit("...")))


def trim_whitespace(s: Column) -> Column:
    return F.regexp_replace(s, r"(?U)\s", "")


def is_valid_symbol(s: Column) -> Column:
    return (F.octet_length(s) <= 10) & s.rlike(r"^[\p{IsAlphabetic}\p{N}.]+\z")


def format_currency(v: Column, currency: Column) -> Column:
    code = F.upper(currency)
    sign = F.when(code == "USD", "$").when(code == "CNY", "¥").when(code == "EUR", "€").otherwise("")
    return F.concat(sign, F.format_string("%.2f", v))
