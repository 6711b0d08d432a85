"""Rules that source rows and records have to keep, as columns that name the first broken one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import errors
from ..functions.columns import split_levels
from ..schema import ASK, BID, SNAPSHOT, TRADE


def reject_class() -> Column:
    """The first rule that a source row breaks, or null."""
    levels = F.coalesce(F.size("levels"), F.lit(0))
    is_snap = F.col("record_type") == SNAPSHOT
    fields = (F.col("price") != 0) | (F.col("size") != 0) | (F.col("side_flags") != 0)
    bad_side = F.exists(F.coalesce(F.col("levels"), F.array()), lambda x: (x["side"] < BID) | (x["side"] > ASK))
    return (
        F.when((F.col("venue_id") < 0) | (F.col("venue_id") > 65535), "VenueIdRange")
        .when((F.col("record_type") < 0) | (F.col("record_type") > SNAPSHOT), "RecordTypeRange")
        .when((F.col("side_flags") < 0) | (F.col("side_flags") > 1), "SideFlagsRange")
        .when(~is_snap & (levels > 0), "LevelsOnNonSnapshot")
        .when(is_snap & fields, "SnapshotFieldSet")
        .when(bad_side, "LevelSide")
    )


def check_rows(source: DataFrame, position: str = "row_index") -> None:
    """Raise RowError for the first row that breaks a rule."""
    bad = source.select(position, reject_class().alias("kind")).where("kind IS NOT NULL").orderBy(position).limit(1).collect()
    if bad:
        raise errors.RowError(bad[0][position], bad[0]["kind"])


def to_records(source: DataFrame) -> DataFrame:
    """Records of source rows that keep the rules; other columns stay."""
    extra = [c for c in source.columns if c not in ("levels", "venue_id", "record_type", "side_flags")]
    snap = F.col("record_type") == SNAPSHOT
    return source.select(
        *extra,
        *(F.col(c).cast("int").alias(c) for c in ("venue_id", "record_type", "side_flags")),
        F.when(snap, split_levels(F.col("levels"), BID)).alias("bids"),
        F.when(snap, split_levels(F.col("levels"), ASK)).alias("asks"),
    )


def record_fault() -> Column:
    """The first rule that a record breaks, or null: types, flags, unused fields, the number of levels."""
    n_levels = F.coalesce(F.size("bids"), F.lit(0)) + F.coalesce(F.size("asks"), F.lit(0))
    snap = F.col("record_type") == SNAPSHOT
    return (
        F.when(~F.col("record_type").between(0, SNAPSHOT), "RecordType")
        .when(~F.col("side_flags").between(0, 1), "SideFlags")
        .when(snap & ((F.col("price") != 0) | (F.col("size") != 0) | (F.col("side_flags") != 0)), "UnusedFieldSet")
        .when(~snap & (n_levels > 0), "UnusedFieldSet")
        .when(n_levels > 65535, "TooManyLevels")
    )


def duplicate_levels(records: DataFrame) -> DataFrame:
    """Snapshots with two levels of one price on a side."""

    def twice(side: str) -> Column:
        prices = F.transform(side, lambda x: x["price"])
        return F.size(F.array_distinct(prices)) < F.size(prices)

    return records.where((F.col("record_type") == SNAPSHOT) & (twice("bids") | twice("asks")))


def trades(records: DataFrame) -> DataFrame:
    return records.where(F.col("record_type") == TRADE)
