"""Order books kept by a stream, per venue and instrument."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StructField, StructType

from .. import errors
from ..schema import DELTA, KEY, RECORD_SCHEMA, SNAPSHOT

OUTPUT = "venue_id int, instrument_id long, side int, price long, size long, emit long"
_LEVEL = StructType([StructField("side", LongType()), StructField("price", LongType())])
_SIZE = StructType([StructField("size", LongType())])


class BookProcessor(StatefulProcessor):
    """Levels in a map of the state store, so a book of any depth stays out of the worker's memory.

    A micro-batch's records are folded to the last event of each level since the
    instrument's last snapshot first, column by column; the store is touched once
    for each level that changes. A record at or before the last one applied is late,
    and a removal of a level that is not there diverges: both are errors, nothing is
    dropped or repaired.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.levels = handle.getMapState("levels", _LEVEL, _SIZE)
        self.last = handle.getValueState("last", StructType([StructField("ts", LongType()), StructField("seq", LongType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        venue, instrument = (int(x) for x in key)
        batch = pd.concat(list(rows)).sort_values(list(KEY), ignore_index=True)
        at = pd.DataFrame({"ts": batch["exchange_ts"].astype("int64"), "seq": batch["sequence_number"].astype("int64")})
        self._check_order(venue, at)
        events = self._events(batch)
        replaced = (batch["record_type"] == SNAPSHOT).any()
        changed: dict[tuple[int, int], int] = {}
        if replaced:
            changed = {(int(s), int(p)): 0 for s, p in self.levels.keys()}
        self._check_removals(venue, instrument, events, changed.keys() if replaced else None)
        if replaced:
            self.levels.clear()
            events = events[events["segment"] == events["segment"].max()]
        events = events[events["side"] >= 0]
        for level in events.drop_duplicates(["side", "price"], keep="last").itertuples():
            place, size = (int(level.side), int(level.price)), int(level.size)
            if size or level.snap:
                self.levels.updateValue(place, (size,))
            elif not replaced:
                self.levels.removeKey(place)
            changed[place] = size
        if len(at):
            now = (int(at["ts"].iloc[-1]), int(at["seq"].iloc[-1]))
            self.last.update(now)
            out = [(venue, instrument, s, p, n, now[0]) for (s, p), n in changed.items()]
            yield pd.DataFrame(out, columns=["venue_id", "instrument_id", "side", "price", "size", "emit"])

    def _check_order(self, venue: int, at: pd.DataFrame) -> None:
        if self.last.exists():
            first = pd.DataFrame([tuple(self.last.get())], columns=["ts", "seq"])
            at = pd.concat([first, at], ignore_index=True)
        before = at.shift()
        same = at["ts"] == before["ts"]
        bad = (at["ts"] < before["ts"]) | same & (at["seq"] <= before["seq"])
        if bad.any():
            k = int(bad.idxmax())
            kind = "DuplicateKey" if same[k] and at["seq"][k] == before["seq"][k] else "OutOfOrder"
            raise errors.named(kind)(f"venue {venue}: {tuple(at.iloc[k])}")

    @staticmethod
    def _events(batch: pd.DataFrame) -> pd.DataFrame:
        """(order, segment, side, price, size, snap): set levels; a snapshot begins a segment, and marks it on side -1."""
        batch = batch.assign(segment=(batch["record_type"] == SNAPSHOT).cumsum(), order=range(len(batch)))
        deltas = batch[batch["record_type"] == DELTA]
        parts = [pd.DataFrame({c: deltas[d] for c, d in (("order", "order"), ("segment", "segment"), ("side", "side_flags"), ("price", "price"), ("size", "size"))}).assign(snap=False)]
        snaps = batch[batch["record_type"] == SNAPSHOT]
        parts.append(pd.DataFrame({"order": snaps["order"], "segment": snaps["segment"], "side": -1, "price": 0, "size": 0, "snap": True}))
        for side, column in enumerate(("bids", "asks")):
            each = snaps[["order", "segment", column]].explode(column).dropna(subset=[column])
            parts.append(
                pd.DataFrame(
                    {"order": each["order"], "segment": each["segment"], "side": side, "price": [int(x["price"]) for x in each[column]], "size": [int(x["size"]) for x in each[column]], "snap": True}
                )
            )
        return pd.concat(parts).sort_values(["order", "side"], kind="stable", ignore_index=True)

    def _check_removals(self, venue: int, instrument: int, events: pd.DataFrame, stored) -> None:
        own = events[events["side"] >= 0]
        before = own.groupby(["segment", "side", "price"], sort=False)[["size", "snap"]].shift()
        first = before["size"].isna()
        removals = (own["size"] == 0) & ~own["snap"].astype(bool)
        gone = removals & ~first & (before["size"] == 0) & ~before["snap"].fillna(False).astype(bool)
        # the first event of a level in a segment: it is there if the state before the first snapshot has it
        for level in own[removals & first].itertuples():
            place = (int(level.side), int(level.price))
            there = level.segment == 0 and (place in stored if stored is not None else self.levels.containsKey(place))
            if not there:
                raise errors.named("LevelNotFound")(f"venue {venue}, instrument {instrument}: {place}")
        if gone.any():
            level = own[gone].iloc[0]
            raise errors.named("LevelNotFound")(f"venue {venue}, instrument {instrument}: {(int(level.side), int(level.price))}")

    def close(self) -> None:
        pass


def book_changes(records: DataFrame) -> DataFrame:
    """A stream of level changes: the size of a price after a micro-batch, 0 if it is gone.

    Needs the RocksDB state store.
    """
    return records.groupBy("venue_id", "instrument_id").transformWithStateInPandas(
        statefulProcessor=BookProcessor(), outputStructType=OUTPUT, outputMode="Update", timeMode="None"
    )


def read_records(spark, folder: str, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(RECORD_SCHEMA).option("maxFilesPerTrigger", files_per_batch).parquet(folder)
