"""Snapshot epochs: after every N records of a venue, a snapshot of all its books.

An epoch is due once N source records have come since the last one, and stands at
the end of the timestamp where that happened, if a later record follows. Where the
epochs fall depends on all epochs before, so one streaming pass over a venue's
counts per timestamp gives each timestamp its epoch, by jumps from epoch to epoch;
all else is joins on that and aggregates, folded to a row per level and epoch first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import shared
from ..functions.columns import key
from ..schema import DELTA, SNAPSHOT
from .book import PLACE, level_events

TIMES = "venue_id int, exchange_ts long, epoch long, due boolean, last_sequence decimal(20,0)"


def times(records: DataFrame, every: int) -> DataFrame:
    """(venue_id, exchange_ts, epoch, due, last_sequence) of each timestamp; epochs of a venue count from 0.

    ``due``: the epoch stands at the end of this timestamp, if a later one follows.
    """
    groups = records.groupBy("venue_id", "exchange_ts").agg(
        F.count("*").alias("n"), F.max("sequence_number").cast("decimal(20,0)").alias("last")
    )
    streams = groups.repartition("venue_id").sortWithinPartitions("venue_id", "exchange_ts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        venue, since, epoch = None, 0, 0  # records and epochs of the venue up to the batch
        for batch in batches:
            own = batch["venue_id"].to_numpy()
            n = batch["n"].to_numpy()
            epochs, due = np.empty(len(own), np.int64), np.zeros(len(own), bool)
            bounds = [0, *(np.flatnonzero(own[1:] != own[:-1]) + 1).tolist(), len(own)] if len(own) else []
            for a, b in zip(bounds, bounds[1:]):
                if own[a] != venue:
                    venue, since, epoch = own[a], 0, 0
                total = np.cumsum(n[a:b])
                at, gone = 0, -since  # the next timestamp, and the records before it that are in closed epochs
                while (end := int(np.searchsorted(total, gone + every))) < b - a:
                    epochs[a + at : a + end + 1], due[a + end] = epoch, True
                    at, gone, epoch = end + 1, int(total[end]), epoch + 1
                epochs[a + at : b] = epoch
                since = int(total[-1]) - gone
            columns = [batch["venue_id"], batch["exchange_ts"], pa.array(epochs), pa.array(due), batch["last"]]
            yield pa.RecordBatch.from_arrays(columns, names=["venue_id", "exchange_ts", "epoch", "due", "last_sequence"])

    return streams.mapInArrow(run, TIMES)


def _bounds(marked: DataFrame) -> DataFrame:
    """(venue_id, epoch, exchange_ts, last_sequence) of written ``times``; a venue's last time closes no epoch."""
    last = marked.groupBy("venue_id").agg(F.max("exchange_ts").alias("last_ts"))
    due = marked.where("due").join(F.broadcast(last), "venue_id")  # a row per venue
    return due.where("exchange_ts < last_ts").select("venue_id", "epoch", "exchange_ts", "last_sequence")


def boundaries(records: DataFrame, every: int) -> DataFrame:
    """(venue_id, epoch, exchange_ts, last_sequence); epochs of a venue count from 0."""
    return _bounds(shared.written(times(records, every), "times"))


def epoch_levels(dated: DataFrame, n_epochs: DataFrame) -> DataFrame:
    """(venue_id, instrument_id, epoch, side, price, size): all books at all epochs.

    ``dated``: deltas and snapshots with their epoch. The last event of a price in an
    epoch, after the epoch's last snapshot, holds until the epoch of its next event
    or of the instrument's next snapshot.
    """
    place = [*PLACE, "epoch"]
    since = F.max(F.when(F.col("record_type") == SNAPSHOT, key()))
    each = dated.groupBy(*place).agg(since.alias("since"))
    later = Window.partitionBy(*PLACE).orderBy(F.col("epoch").desc()).rowsBetween(Window.unboundedPreceding, -1)
    reset = F.last(F.when(F.col("since").isNotNull(), F.col("epoch")), ignorenulls=True).over(later)
    each = shared.written(each.withColumn("reset", reset), "instrument_epochs")
    events = level_events(dated, "epoch").join(each.where("since IS NOT NULL").drop("reset"), place, "left")
    events = events.where(F.col("since").isNull() | (F.col("at") >= F.col("since")))
    settled = events.groupBy(*place, "side", "price").agg(F.max_by(F.struct("size", "snap"), "at").alias("l"))
    following = F.lead("epoch").over(Window.partitionBy(*PLACE, "side", "price").orderBy("epoch"))
    held = settled.withColumn("following", following).join(each.select(*place, "reset"), place)
    held = held.join(F.broadcast(n_epochs), "venue_id")  # a row per venue
    held = held.withColumn("end", F.coalesce(F.least("following", "reset"), "n_epochs") - 1)
    held = held.where((F.col("l.snap") | (F.col("l.size") != 0)) & (F.col("end") >= F.col("epoch")))
    return held.select(
        *PLACE, F.explode(F.sequence("epoch", "end")).alias("epoch"), "side", "price", F.col("l.size").alias("size")
    )


def epoch_rows(records: DataFrame, every: int) -> DataFrame:
    """The snapshot records to add: one per epoch and instrument seen so far, in the order of instruments.

    Sequence numbers run on from the last record of the epoch's timestamp.
    """
    marked = shared.written(times(records, every), "times")
    bounds = _bounds(marked)
    n = bounds.groupBy("venue_id").agg(F.count("*").alias("n_epochs"))
    live = records.where(F.col("record_type").isin(DELTA, SNAPSHOT))
    dated = live.join(marked.select("venue_id", "exchange_ts", "epoch"), ["venue_id", "exchange_ts"])
    dated = dated.join(F.broadcast(n), "venue_id").where("epoch < n_epochs").drop("n_epochs")
    dated = shared.written(dated, "dated")
    seen = dated.groupBy(*PLACE).agg(F.min("epoch").alias("from_epoch"))
    heads = bounds.join(seen, "venue_id").where("epoch >= from_epoch").drop("from_epoch")
    rank = F.row_number().over(Window.partitionBy("venue_id", "epoch").orderBy("instrument_id"))
    heads = heads.withColumn("sequence_number", (F.col("last_sequence") + rank).cast("decimal(20,0)"))
    level = F.struct("price", "size")
    books = epoch_levels(dated, n).groupBy(*PLACE, "epoch").agg(
        F.sort_array(F.collect_list(F.when(F.col("side") == 0, level)), False).alias("bids"),
        F.sort_array(F.collect_list(F.when(F.col("side") == 1, level))).alias("asks"),
    )
    none = F.array().cast("array<struct<price: bigint, size: bigint>>")
    return heads.join(books, [*PLACE, "epoch"], "left").select(
        "exchange_ts", "sequence_number", "instrument_id", "venue_id",
        F.lit(SNAPSHOT).alias("record_type"), F.lit(0).alias("side_flags"),
        F.lit(0).cast("long").alias("price"), F.lit(0).cast("long").alias("size"),
        F.coalesce("bids", none).alias("bids"), F.coalesce("asks", none).alias("asks"), "epoch",
    )


def with_epochs(records: DataFrame, every: int) -> DataFrame:
    """Records and the epochs' snapshots."""
    return records.unionByName(epoch_rows(records, every).select(*records.columns))
