"""Limit order books: the levels of each instrument at a time, as aggregates.

A snapshot replaces an instrument's book; a delta sets the size of a price on a
side, and size 0 removes it; trades do not matter. The book before a time is the
last event of each price since the instrument's last snapshot, without removals.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import errors
from ..functions.columns import key
from ..schema import ASK, BID, DELTA, KEY, SNAPSHOT, TRADE

PLACE = ("venue_id", "instrument_id")


def level_events(records: DataFrame, *extra: str) -> DataFrame:
    """One row per set level: (venue_id, instrument_id, extra, at, side, price, size, snap); ``at`` is the key."""
    deltas = records.where(F.col("record_type") == DELTA).select(
        *PLACE, *extra, key().alias("at"), F.col("side_flags").alias("side"), "price", "size", F.lit(False).alias("snap")
    )
    snaps = records.where(F.col("record_type") == SNAPSHOT)

    def sided(column: str, side: int) -> Column:
        return F.transform(
            column, lambda x: F.struct(F.lit(side).alias("side"), x["price"].alias("price"), x["size"].alias("size"))
        )

    both = F.concat(sided("bids", BID), sided("asks", ASK))
    levels = snaps.select(*PLACE, *extra, key().alias("at"), F.inline(both), F.lit(True).alias("snap"))
    return deltas.unionByName(levels)


def last_snapshots(records: DataFrame) -> DataFrame:
    return records.where(F.col("record_type") == SNAPSHOT).groupBy(*PLACE).agg(F.max(key()).alias("since"))


def ranked(levels: DataFrame) -> DataFrame:
    """Levels with their rank on their side, 1 the best."""
    better = F.when(F.col("side") == BID, -F.col("price").cast("decimal(20,0)")).otherwise(F.col("price"))
    rank = F.row_number().over(Window.partitionBy(*PLACE, "side").orderBy(better))
    return levels.withColumn("rank", rank.cast("int"))


def book_at(records: DataFrame, ts: int | None = None) -> DataFrame:
    """(venue_id, instrument_id, side, price, size) before the first record at or after ``ts``.

    Both steps are partial aggregates; nothing is sorted.
    """
    past = records if ts is None else records.where(F.col("exchange_ts") < F.lit(ts))
    events = level_events(past).join(last_snapshots(past), list(PLACE), "left")
    live = events.where(F.col("since").isNull() | (F.col("at") >= F.col("since")))
    last = live.groupBy(*PLACE, "side", "price").agg(F.max_by(F.struct("size", "snap"), "at").alias("l"))
    return last.where(F.col("l.snap") | (F.col("l.size") != 0)).select(*PLACE, "side", "price", F.col("l.size").alias("size"))


def best(book: DataFrame) -> DataFrame:
    """Best bid and best ask of each instrument; null where a side is empty."""
    level = F.struct("price", "size")
    sides = book.groupBy(*PLACE).agg(
        F.max(F.when(F.col("side") == BID, level)).alias("bid"), F.min(F.when(F.col("side") == ASK, level)).alias("ask")
    )
    return sides.select(
        *PLACE, F.col("bid.price").alias("bid_price"), F.col("bid.size").alias("bid_size"),
        F.col("ask.price").alias("ask_price"), F.col("ask.size").alias("ask_size"),
    )


def top(book: DataFrame, n: int) -> DataFrame:
    return ranked(book).where(F.col("rank") <= n)


def crossed(book: DataFrame) -> DataFrame:
    return best(book).where("bid_price >= ask_price")


def depth(book: DataFrame) -> DataFrame:
    return book.groupBy(*PLACE, "side").agg(F.count("*").alias("n_levels"), F.sum("size").alias("total_size"))


def side_arrays(book: DataFrame) -> DataFrame:
    """One row per instrument with ``bids`` and ``asks`` best first."""
    level = F.struct("price", "size")
    both = book.groupBy(*PLACE).agg(
        F.collect_list(F.when(F.col("side") == BID, level)).alias("bids"),
        F.collect_list(F.when(F.col("side") == ASK, level)).alias("asks"),
    )
    return both.withColumn("bids", F.sort_array("bids", False)).withColumn("asks", F.sort_array("asks"))


def with_segment(records: DataFrame) -> DataFrame:
    """Records with the number of snapshots of their instrument up to them."""
    so_far = Window.partitionBy(*PLACE).orderBy(*KEY).rowsBetween(Window.unboundedPreceding, 0)
    return records.withColumn("segment", F.count_if(F.col("record_type") == SNAPSHOT).over(so_far))


def divergence(records: DataFrame) -> DataFrame:
    """Deltas that remove a level that is not there."""
    marked = with_segment(records.where(F.col("record_type") != TRADE))
    flat = level_events(marked, "segment")
    before = Window.partitionBy(*PLACE, "segment", "side", "price").orderBy("at", F.col("snap").desc())
    prior = flat.withColumn("there", F.lag(F.col("snap") | (F.col("size") != 0)).over(before))
    gone = prior.where(~F.col("snap") & (F.col("size") == 0) & ~F.coalesce(F.col("there"), F.lit(False)))
    return gone.select(*PLACE, *(F.col(f"at.{k}").alias(k) for k in KEY if k not in PLACE), "side", "price")


def warm_up(records: DataFrame, instrument_id: int, ts: int, scope: str = "venue") -> tuple[DataFrame, int]:
    """The instrument's book before ``ts``, and how many records come before it.

    ``scope="file"`` starts at the last snapshot epoch before ``ts``, as a single
    file does; ``"venue"`` goes back as far as the instrument's own last snapshot.
    """
    past = records.where(F.col("exchange_ts") < F.lit(ts))
    own = past.where(F.col("instrument_id") == F.lit(instrument_id))
    if scope == "file":
        first = past.where(F.col("record_type") == SNAPSHOT).agg(F.max("exchange_ts")).first()[0]
        if first is not None:
            own = own.where(F.col("exchange_ts") >= F.lit(first))
    return book_at(own), past.count()


class Book:
    """One instrument's book in memory, for clients and streaming state."""

    def __init__(self, instrument_id: int):
        self.instrument_id = instrument_id
        self.sides: tuple[dict[int, int], dict[int, int]] = ({}, {})

    def snapshot(self, levels: list[tuple[int, int]], bid_count: int) -> None:
        if not 0 <= bid_count <= len(levels):
            raise errors.named("BidCountOutOfRange")(str(bid_count))
        parts = levels[:bid_count], levels[bid_count:]
        new = tuple(dict(p) for p in parts)
        if any(len(d) < len(p) for d, p in zip(new, parts, strict=True)):
            raise errors.named("DuplicateLevel")(f"instrument {self.instrument_id}")
        self.sides = new  # type: ignore[assignment]

    def apply(self, record_type: int, instrument_id: int, side: int, price: int, size: int) -> None:
        if record_type != DELTA:
            raise errors.named("WrongRecordType")(str(record_type))
        if instrument_id != self.instrument_id:
            raise errors.named("WrongInstrument")(str(instrument_id))
        levels = self.sides[side]
        if size:
            levels[price] = size
        elif levels.pop(price, None) is None:
            raise errors.named("LevelNotFound")(f"{price} on side {side}")

    def bids(self) -> list[tuple[int, int]]:
        return sorted(self.sides[BID].items(), reverse=True)

    def asks(self) -> list[tuple[int, int]]:
        return sorted(self.sides[ASK].items())

    def best_bid(self) -> tuple[int, int] | None:
        return next(iter(self.bids()), None)

    def best_ask(self) -> tuple[int, int] | None:
        return next(iter(self.asks()), None)


def folded(records: DataFrame, strict: bool = True) -> DataFrame:
    """(venue_id, instrument_id, side, price, size): all books by applying one record after the other.

    A task holds the books' levels, not their records. ``strict``: the removal of a
    level that is not there is an error, else it changes nothing. ``book_at`` gives
    the same without an order.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, book = None, None

        def levels() -> list[tuple]:
            if book is None:
                return []
            return [(*place, side, *x) for side, own in enumerate((book.bids(), book.asks())) for x in own]

        def table(rows: list[tuple]) -> pa.RecordBatch:
            kinds = (pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
            columns = zip(*rows) if rows else [()] * 5
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[*PLACE, "side", "price", "size"])

        for batch in batches:
            out: list[tuple] = []
            for r in batch.to_pylist():
                now = (r["venue_id"], r["instrument_id"])
                if now != place:
                    out += levels()
                    place, book = now, Book(now[1])
                if r["record_type"] == SNAPSHOT:
                    bids, asks = ([(x["price"], x["size"]) for x in r[c] or []] for c in ("bids", "asks"))
                    book.snapshot(bids + asks, len(bids))
                elif r["record_type"] == DELTA:
                    try:
                        book.apply(DELTA, r["instrument_id"], r["side_flags"], r["price"], r["size"])
                    except errors.named("LevelNotFound"):
                        if strict:
                            raise
            yield table(out)
        yield table(levels())

    rows = records.select(*KEY, "record_type", "side_flags", "price", "size", "bids", "asks")
    dealt = rows.repartition(*PLACE).sortWithinPartitions(*PLACE, *KEY)
    return dealt.mapInArrow(run, "venue_id int, instrument_id long, side int, price long, size long")


def is_best_first(side: str, ascending: bool) -> Column:
    """Whether an array of levels is in the order of its side."""
    prices = F.transform(side, lambda x: x["price"])
    return prices == F.sort_array(prices, ascending)
