"""Delivery of the merged stream: starts, retention, gaps, accounting.

A ring of a power of two slots holds the last records. A lossless (block)
subscriber holds the writer back; a lossy (drop) subscriber that is lapped goes on
with the record that its slot now holds and is told exactly what it missed.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import errors
from ..schema import SNAPSHOT
from . import order

BLOCK, DROP = "block", "drop"
RECORD_BYTES = 64
NO_CURSOR = str(2**64 - 1)


@dataclass(frozen=True)
class Ring:
    capacity: int
    max_blob_bytes: int = 0

    def __post_init__(self):
        if self.capacity < 2 or self.capacity & (self.capacity - 1):
            raise errors.named("BadCapacity")(str(self.capacity))
        if self.max_blob_bytes < 0:
            raise errors.named("MaxBlobBytes")(str(self.max_blob_bytes))

    def oldest(self, written: int) -> int:
        return max(0, written - self.capacity)

    def held(self, cursor: int, written: int) -> int:
        """The index in the slot of ``cursor`` once ``written`` records are written."""
        if cursor >= written:
            return cursor
        return cursor + self.capacity * ((written - 1 - cursor) // self.capacity)


@dataclass(frozen=True)
class Start:
    """Where a subscriber begins: kind is beginning, exchange_ts, emit_index or live."""

    kind: str
    value: int = 0


def beginning() -> Start:
    return Start("beginning")


def exchange_ts(ts: int) -> Start:
    return Start("exchange_ts", ts)


def emit_index(n: int) -> Start:
    return Start("emit_index", n)


def live() -> Start:
    return Start("live")


def parse_mode(mode: str | None) -> str:
    if mode not in (BLOCK, DROP):
        raise errors.named("ModeUnset")(repr(mode))
    return mode


def retained(stream: DataFrame, ring: Ring, written: int) -> DataFrame:
    """What the ring holds after ``written`` records."""
    return stream.where((F.col("emit_index") >= ring.oldest(written)) & (F.col("emit_index") < written))


def start_index(stream: DataFrame, ring: Ring, written: int, mode: str | None, start: Start | None) -> int:
    """The first cursor of a subscriber that joins after ``written`` records."""
    mode = parse_mode(mode)
    if start is None:
        raise errors.named("StartUnset")("start position must be set")
    if start.kind == "exchange_ts":
        at = retained(stream, ring, written).where(F.col("exchange_ts") >= F.lit(start.value))
        found = at.agg(F.min("emit_index")).first()[0]
        cursor = written if found is None else found
    else:
        cursor = {"beginning": 0, "emit_index": start.value, "live": written}[start.kind]
    if mode == BLOCK and cursor < ring.oldest(written):
        raise errors.named("StartLapped")(f"{cursor} is before {ring.oldest(written)}")
    return cursor


def held_index(cursor: Column, written: Column, capacity: int) -> Column:
    """Closed form of what a cursor's slot holds."""
    laps = F.call_function("div", written - 1 - cursor, F.lit(capacity))
    return F.when(cursor >= written, cursor).otherwise(cursor + capacity * laps)


def gap(cursor: Column, held: Column) -> Column:
    """(first_missed, last_missed, missed_count), null if nothing was missed."""
    return F.when(
        held > cursor,
        F.struct(cursor.alias("first_missed"), (held - 1).alias("last_missed"), (held - cursor).alias("missed_count")),
    )


def deliveries(stream: DataFrame, ring: Ring, cursor: int, written: int) -> DataFrame:
    """What a drop subscriber at ``cursor`` gets when it reads on after ``written`` records; the first row has the gap."""
    held = ring.held(cursor, written)
    got = stream.where((F.col("emit_index") >= held) & (F.col("emit_index") < written))
    at = F.lit(cursor).cast("long")
    first = gap(at, F.lit(held).cast("long"))
    return got.withColumn("gap", F.when(F.col("emit_index") == held, first))


def simulate(ring: Ring, written: list[int], cursor: int = 0) -> list[tuple[int, tuple[int, int, int] | None]]:
    """(index, gap) of the reads of a drop subscriber; ``written``: records written before each read."""
    out = []
    for w in written:
        if cursor >= w:
            continue
        held = ring.held(cursor, w)
        out.append((held, (cursor, held - 1, held - cursor) if held > cursor else None))
        cursor = held + 1
    return out


def accounting(delivered: DataFrame) -> DataFrame:
    """One row: received, gaps, missed."""
    return delivered.agg(
        F.count("*").alias("received"),
        F.count("gap").alias("gaps"),
        F.coalesce(F.sum("gap.missed_count"), F.lit(0)).alias("missed"),
    )


def unaccounted(stream: DataFrame, delivered: DataFrame) -> DataFrame:
    """Indexes that were neither delivered nor reported missed. A gap counts by its two ends, however long."""
    rest = stream.select("emit_index").join(delivered.select("emit_index"), "emit_index", "left_anti")
    gaps = delivered.where("gap IS NOT NULL").select("gap.*")
    ends = gaps.select(F.col("first_missed").alias("emit_index"), F.lit(1).alias("step")).unionByName(
        gaps.select((F.col("last_missed") + 1).alias("emit_index"), F.lit(-1).alias("step"))
    )
    rows = rest.withColumn("step", F.lit(0)).unionByName(ends).withColumn("one", F.lit(1))
    rows = order.carried(order.sliced(rows, "emit_index", "slice", dense=True), ["one"], "slice", F.sum("step"), F.sum, "open")
    # at one index the ends of gaps come before the record itself
    so_far = Window.partitionBy("one", "slice").orderBy("emit_index", F.col("step") == 0).rowsBetween(Window.unboundedPreceding, 0)
    inside = F.coalesce("open", F.lit(0)) + F.sum("step").over(so_far)
    return rows.withColumn("inside", inside).where("step = 0 AND inside = 0").select("emit_index")


def min_block_cursor(subscribers: DataFrame) -> DataFrame:
    """The least cursor of block subscribers, the largest unsigned 64-bit number without any."""
    least = F.min(F.when(F.col("mode") == BLOCK, F.col("cursor")).cast("decimal(20,0)"))
    return subscribers.agg(F.coalesce(least, F.lit(NO_CURSOR).cast("decimal(20,0)")).alias("min_cursor"))


def must_wait(ring: Ring, index: int, min_cursor: int) -> bool:
    """Whether the writer of ``index`` waits for block subscribers."""
    return index >= ring.capacity and min_cursor <= index - ring.capacity


def subscriber_mix(subscribers: DataFrame) -> DataFrame:
    return subscribers.groupBy("mode", "start_kind").agg(F.count("*").alias("n_subscribers"))


def payload_bytes() -> Column:
    n = F.coalesce(F.size("bids"), F.lit(0)) + F.coalesce(F.size("asks"), F.lit(0))
    return F.when(F.col("record_type") == SNAPSHOT, 4 + 16 * n).otherwise(0).cast("long")


def run_metrics(delivered: DataFrame) -> DataFrame:
    """Records, bytes, gaps, missed and the last index of a run."""
    return delivered.agg(
        F.count("*").alias("records"),
        F.coalesce(F.sum(F.lit(RECORD_BYTES) + payload_bytes()), F.lit(0)).alias("bytes"),
        F.count("gap").alias("gaps"),
        F.coalesce(F.sum("gap.missed_count"), F.lit(0)).alias("missed"),
        F.max("emit_index").alias("last_index"),
    )


def too_large(records: DataFrame, ring: Ring) -> DataFrame:
    """Snapshots whose payload does not fit a slot."""
    return records.where(payload_bytes() > ring.max_blob_bytes)


def to_wire(delivered: DataFrame) -> DataFrame:
    """Deliveries as a client gets them: widened integers, levels in one list, the gap's three numbers."""
    none = F.array().cast("array<struct<price: bigint, size: bigint>>")
    wide = [F.col(c).cast("long").alias(c) for c in ("instrument_id", "venue_id", "record_type", "side_flags")]
    return delivered.select(
        "emit_index", "exchange_ts", "sequence_number", *wide, "price", "size",
        F.concat(F.coalesce("bids", none), F.coalesce("asks", none)).alias("levels"),
        F.coalesce(F.size("bids"), F.lit(0)).cast("long").alias("bid_count"),
        F.col("gap.first_missed").alias("first_missed"), F.col("gap.last_missed").alias("last_missed"),
        F.coalesce("gap.missed_count", F.lit(0).cast("long")).alias("missed_count"),
    )
