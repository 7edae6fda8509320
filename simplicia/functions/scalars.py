"""Column expressions for ingestion, labels and vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean(c: Column) -> Column:
    """A number from anything: unreadable, NaN and infinite values become null."""
    x = c.try_cast("double")
    return F.when(~(F.isnan(x) | (F.abs(x) == F.lit(float("inf")))), x)


def imbalance(buy: Column, sell: Column) -> Column:
    """Signed share of buys."""
    return (buy - sell) / (buy + sell + 1e-9)


def padded_id(c: Column, width: int = 6) -> Column:
    """Zero-filled id; lpad alone would cut longer ones."""
    return F.when(F.char_length(c) < width, F.lpad(c, width, "0")).otherwise(c)


def exchange_code(symbol: Column) -> Column:
    """Exchange-qualified symbol: 6 trades in sh, 0 and 3 in sz, others nowhere."""
    first = F.substring(symbol, 1, 1)
    return F.when(first == "6", F.concat(F.lit("sh."), symbol)).when(first.isin("0", "3"), F.concat(F.lit("sz."), symbol))


def price_limit(symbol: Column) -> Column:
    """Daily price limit of a symbol's board."""
    return F.when(symbol.startswith("3") | symbol.startswith("688"), 0.2).otherwise(0.1)


def month_key(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM")


def seed_of(*parts: Column) -> Column:
    """Deterministic seed of a sample: the first eight hex digits of the md5 of its joined parts, mod 2^31."""
    return F.pmod(F.conv(F.substring(F.md5(F.concat_ws("|", *parts).cast("binary")), 1, 8), 16, 10).cast("long"), F.lit(1 << 31))


def bar_code(c: Column) -> Column:
    """Bar of the day from a compact time (yyyyMMddHHmmss): hour and minute."""
    return F.substring(c, 9, 4)


def linspace(lo: Column, hi: Column, n: int) -> Column:
    """n evenly spaced values, both ends included."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: lo + i * (hi - lo) / (n - 1))


def clip(c: Column, lo: float, hi: float) -> Column:
    return F.least(F.greatest(c, F.lit(lo)), F.lit(hi))


def bin_of(x: Column, lo: Column, hi: Column, bins: int) -> Column:
    """Number of an equal-width bin from 0; the last bin is closed, and equal ends make one bin, 0."""
    return F.when(hi > lo, F.least(F.floor(F.try_divide(x - lo, hi - lo) * bins), F.lit(bins - 1))).when(x.isNotNull(), 0).cast("int")


def soft_mask(persistence: Column, threshold: Column, eta: float) -> Column:
    """Logistic weight of a bar against a threshold."""
    return 1 / (1 + F.exp(-eta * (persistence - threshold)))


def total(array: Column) -> Column:
    return F.aggregate(array, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))
