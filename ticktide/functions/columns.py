"""Column expressions of the engine: exact integer arithmetic, levels, schedules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import KEY

DAY_NANOS = 86_400_000_000_000
MAX_LONG = 9_223_372_036_854_775_807


def key() -> Column:
    return F.struct(*KEY)


def floor_div(value: Column, by: int) -> Column:
    """Floor of an integer division, exact for negative values."""
    return F.call_function("div", value - F.pmod(value, F.lit(by)), F.lit(by))


def utc_day(exchange_ts: Column) -> Column:
    """Days since 1970-01-01; days before that are negative."""
    return floor_div(exchange_ts, DAY_NANOS)


def artifact_name(venue_id: Column, day: Column) -> Column:
    date = F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), day.cast("int")), "yyyy-MM-dd")
    return F.concat(F.lit("venue-"), venue_id.cast("string"), F.lit("-"), date, F.lit(".bin"))


def split_levels(levels: Column, side: int) -> Column:
    """One side of source levels, best first; levels of equal price keep their order."""
    own = F.filter(
        F.transform(levels, lambda x, i: F.struct(x["side"].alias("side"), x["price"].alias("price"), x["size"].alias("size"), i.alias("i"))),
        lambda x: x["side"] == side,
    )

    def order(a: Column, b: Column) -> Column:
        first, second = (a, b) if side else (b, a)
        by_price = F.when(first["price"] < second["price"], -1).when(first["price"] > second["price"], 1)
        return by_price.when(a["i"] < b["i"], -1).when(a["i"] > b["i"], 1).otherwise(0)

    return F.transform(F.array_sort(own, order), lambda x: F.struct(x["price"].alias("price"), x["size"].alias("size")))


def saturating_add(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_add(a, b), F.lit(MAX_LONG))


def delivery_time(start: Column, base: Column, ts: Column, num: int, den: int) -> Column:
    """``start + trunc((ts - base) * den / num)``, saturating at the largest long.

    A timestamp at or before the base, or one whose distance from it does not fit
    a long, is due at the start. The product is exact in decimal(38,0); quotients
    beyond a long are caught before the division, which would wrap.
    """
    d = ts.cast("decimal(20,0)") - base.cast("decimal(20,0)")
    by = F.lit(num).cast("decimal(11,0)")
    product = d * F.lit(den).cast("decimal(11,0)")
    due = saturating_add(start, F.call_function("div", product, by))
    most = by * F.lit(str(MAX_LONG + 1)).cast("decimal(20,0)")
    return (
        F.when((d <= 0) | (d > F.lit(str(MAX_LONG)).cast("decimal(20,0)")), start)
        .when(product >= most, F.lit(MAX_LONG))
        .otherwise(due)
    )
