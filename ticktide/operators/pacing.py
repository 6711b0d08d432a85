"""Rational speeds and delivery schedules. Time decides when, never what."""

from __future__ import annotations

from dataclasses import dataclass
from math import gcd

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import errors
from ..functions.columns import MAX_LONG, delivery_time

MOST_TERM, MOST_RATIO, LEAST_RATIO = 2**31, 1_000_000, 1024


@dataclass(frozen=True)
class Speed:
    """``num / den`` times real time, in lowest terms, from 1/1024 to 1000000."""

    num: int
    den: int = 1

    def __post_init__(self):
        num, den = self.num, self.den
        if num <= 0 or den <= 0:
            raise errors.named("InvalidSpeed")(f"{num}/{den}")
        k = gcd(num, den)
        num, den = num // k, den // k
        if max(num, den) > MOST_TERM or num > MOST_RATIO * den or den > LEAST_RATIO * num:
            raise errors.named("InvalidSpeed")(f"{num}/{den}")
        object.__setattr__(self, "num", num)
        object.__setattr__(self, "den", den)

    def due(self, start: int, base: int, ts: int) -> int:
        span = ts - base
        if span <= 0 or span > MAX_LONG:
            return start
        return min(start + span * self.den // self.num, MAX_LONG)

    def due_column(self, start: Column, base: Column, ts: Column) -> Column:
        return delivery_time(start, base, ts, self.num, self.den)


def schedule(records: DataFrame, speed: Speed, start: int) -> DataFrame:
    """Records with their ``deadline_ns``; the base is the first timestamp."""
    base = records.agg(F.min("exchange_ts")).first()[0]
    due = speed.due_column(F.lit(start).cast("long"), F.lit(base).cast("long"), F.col("exchange_ts"))
    return records.withColumn("deadline_ns", due)


class Pacer:
    """Holds records back until they are due within ``window`` nanoseconds."""

    def __init__(self, clock, speed: Speed, window: int = 1_000_000):
        self.clock, self.speed, self.window = clock, speed, window
        self.base: int | None = None
        self.start, self.slip, self.stopped = 0, 0, False

    def begin(self, base: int) -> None:
        """Fix the base; later calls change nothing."""
        if self.base is None:
            self.base, self.start = base, self.clock.now()

    def wait(self, ts: int) -> bool:
        """Sleep until ``ts`` is due; False once stopped."""
        self.begin(ts)
        due = self.speed.due(self.start, self.base, ts)
        if not self.stopped and due - self.clock.now() > self.window:
            self.clock.sleep_until(due)
        self.slip = self.clock.now() - due
        return not self.stopped

    def stop(self) -> None:
        self.stopped = True
