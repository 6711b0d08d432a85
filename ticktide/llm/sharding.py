"""Sharding through a fixed number of virtual slots.

A record's slot is a hash of its id and never changes. Bytes and rows are summed
per slot; a versioned map says which shard holds each slot. Rebalancing edits the
map: slots move, or change places, until the shards' bytes are near equal, and
the edited map is stored as the next version. A version keeps the bytes that its
slots held, so the next batch edits the newest map for what is there and what
comes. The map and the sums have one row per slot, so what reaches the driver or
is broadcast does not grow with the data.

Defined cases: a null text has no bytes and counts one for its end; a null id has
a slot like any other id; rows that repeat go to the same slot and get places of
their own; an empty table gives an empty result and an unchanged map; fewer shards
than the stored map has: the slots of those that go are dealt to the lightest;
other columns are carried, and where they have the name of an added column (shard,
slot), that one gets a leading underscore. Two batches at the same time are an
error of the second, since its version is there.
"""

from __future__ import annotations

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common, ranks

SLOTS = 4096


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(slots)).cast("int")


def even_map(shards: int, slots: int = SLOTS) -> np.ndarray:
    """Version 0: slots are dealt in turn."""
    return np.arange(slots) % shards


def rebalanced(shard_of: np.ndarray, weight: np.ndarray, shards: int, tolerance: float = 0.0) -> np.ndarray:
    """``shard_of`` edited, slot by slot, until no move or swap evens the weights out.

    Each step looks at the heaviest and the lightest shard and takes the move, or
    the exchange of two slots, that comes closest to half of their difference; a
    difference of up to ``tolerance`` of a fair share is left as it is.
    """
    shard_of, weight = shard_of.copy(), weight.astype(np.int64)
    gone = np.flatnonzero(shard_of >= shards)
    kept = shard_of < shards
    load = np.bincount(shard_of[kept], weights=weight[kept], minlength=shards).astype(np.int64)
    for slot in gone[np.argsort(-weight[gone], kind="stable")].tolist():
        shard_of[slot] = low = int(load.argmin())
        load[low] += weight[slot]
    for _ in range(4 * len(weight)):
        top, low = int(load.argmax()), int(load.argmin())
        gap = load[top] - load[low]
        if gap <= tolerance * load.mean():
            break
        mine, theirs = np.flatnonzero(shard_of == top), np.flatnonzero(shard_of == low)
        theirs = theirs[np.argsort(weight[theirs], kind="stable")]
        other = np.concatenate([[0], weight[theirs]])  # 0: a plain move
        want = weight[mine] - gap / 2
        at = np.searchsorted(other, want)
        best = None
        for near in (np.clip(at - 1, 0, len(other) - 1), np.clip(at, 0, len(other) - 1)):
            shift = weight[mine] - other[near]
            miss = np.where((shift > 0) & (shift < gap), np.abs(2 * shift - gap), np.iinfo(np.int64).max)
            k = int(miss.argmin()) if len(miss) else -1
            if k >= 0 and miss[k] < gap and (best is None or miss[k] < best[0]):
                best = (miss[k], mine[k], int(near[k]), shift[k])
        if best is None:
            break
        _, slot, partner, shift = best
        shard_of[slot] = low
        if partner:
            shard_of[theirs[partner - 1]] = top
        load[top] -= shift
        load[low] += shift
    return shard_of


class SlotMap:
    """Versions of a slot-to-shard map, as a Parquet table in a shared folder.

    A version has a row for each slot: its shard, and the bytes that it held then.
    """

    KINDS = "virtual_slot int, shard int, bytes long"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def store(self, version: int, shard_of: np.ndarray, weight: np.ndarray) -> None:
        rows = [(s, int(x), int(w)) for s, (x, w) in enumerate(zip(shard_of, weight, strict=True))]
        self.spark.createDataFrame(rows, self.KINDS).coalesce(1).write.parquet(f"{self.path}/version={version}")

    def read(self, version: int) -> DataFrame:
        return self.spark.read.schema(self.KINDS).parquet(f"{self.path}/version={version}")

    def newest(self) -> int | None:
        """The number of the newest version, None where there is no map yet."""
        try:
            return self.spark.read.schema(f"{self.KINDS}, version int").parquet(self.path).agg(F.max("version")).first()[0]
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return None

    def load(self, version: int) -> tuple[np.ndarray, np.ndarray]:
        """(shard, bytes) of each slot of a version."""
        rows = self.read(version).orderBy("virtual_slot").collect()  # one row per slot
        return np.array([r.shard for r in rows]), np.array([r["bytes"] for r in rows], dtype=np.int64)


def slot_weights(sized: DataFrame, slots: int = SLOTS, size: str = "size", slot: str = "virtual_slot") -> np.ndarray:
    weight = np.zeros(slots, dtype=np.int64)
    for s, n in sized.groupBy(slot).agg(F.sum(size)).collect():  # one row per slot
        weight[s] = n
    return weight


def shard_records(
    sized: DataFrame, slot_map: SlotMap, shards: int, slots: int = SLOTS, tolerance: float = 0.0
) -> DataFrame:
    """``sized`` (with virtual_slot and size) with its shard and its place there.

    The newest map is read, edited for the bytes that its slots hold with these
    records, and stored as the next version; a new map begins evenly dealt, as
    version 0. The place counts the rows of the batch in a shard from 0 without
    gaps: the rows of its slots before, and the number within the slot.
    """
    version = slot_map.newest()
    if version is None:
        version = 0
        slot_map.store(0, even_map(shards, slots), np.zeros(slots, np.int64))
    old, held = slot_map.load(version)
    if len(old) != slots:
        raise ValueError(f"the map has {len(old)} slots, not {slots}")
    part, rank, begin, n, at = common.fresh_names(sized, "part", "rank", "begin", "n", "at")
    shard, place = common.fresh_names(sized, "shard", "slot")
    dealt = common.written(ranks.locally_ranked(sized, "virtual_slot", slots - 1, part, rank), "sized")
    weight = held + slot_weights(dealt, slots)
    slot_map.store(version + 1, rebalanced(old, weight, shards, tolerance), weight)
    newest = slot_map.read(version + 1).select("virtual_slot", F.col("shard").alias(shard))
    counts = common.written(dealt.groupBy("virtual_slot", part).agg(F.count("*").alias(n)), "slot_counts")
    before = Window.partitionBy(shard).orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1)
    total = counts.groupBy("virtual_slot").agg(F.sum(n).alias(n))
    first = newest.join(total, "virtual_slot", "left").select(
        "virtual_slot", shard, F.coalesce(F.sum(n).over(before), F.lit(0)).alias(at)
    )
    ranked = dealt.join(ranks.begins(counts, "virtual_slot", part, n, begin).hint("merge"), ["virtual_slot", part])
    # a row per virtual slot: bounded by SLOTS
    out = ranked.join(F.broadcast(first), "virtual_slot")
    own = [F.col(f"`{c}`") for c in sized.columns]
    return out.select(*own, shard, (F.col(at) + F.col(begin) + F.col(rank)).cast("long").alias(place))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9: all ``documents`` into 8 shards of near equal bytes (law ``bytes``).

    ``slot`` is the row's place in its shard; ``virtual_slot`` the hashed slot.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    sized = spark.read.parquet(f"{sf_dir}/documents.parquet").select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        slot_of(F.col("doc_id")).alias("virtual_slot"),
    )
    out = shard_records(sized, SlotMap(spark, common.new_path(spark, "slot_map")), 8)
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "virtual_slot",
    )
