"""Records seen in the ``events`` table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def _scalars(df: DataFrame) -> DataFrame:
    ts = F.unix_micros(F.date_trunc("HOUR", F.col("ts").cast("timestamp"))) * F.lit(1000)
    return df.select(
        ts.alias("exchange_ts"),
        F.col("event_id").alias("sequence_number"),
        (F.col("user_id") % 8).alias("instrument_id"),
        (F.col("user_id") % 4 + 1).cast("int").alias("venue_id"),
        (F.col("event_id") % 2).cast("int").alias("side_flags"),
        F.pmod(F.round(F.col("value") * 100).cast("long"), F.lit(20)).alias("price"),
        (F.get_json_object("props", "$.k").cast("long") % 10).alias("size"),
        "event_type",
    )


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deltas, and trades for purchases; timestamps are cut to the hour, so that many tie."""
    kind = F.when(F.col("event_type") == "purchase", 1).otherwise(0)
    return _scalars(events(spark, sf_dir)).withColumn("record_type", kind).drop("event_type")


def with_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``records``, and sign-ups are snapshots with two levels a side."""
    base = _scalars(events(spark, sf_dir))
    snap = F.col("event_type") == "signup"
    kind = F.when(F.col("event_type") == "purchase", 1).when(snap, 2).otherwise(0)

    def side(one: int, two: int):
        pair = F.array(
            F.struct((F.col("price") + one).alias("price"), (F.col("size") + 1).alias("size")),
            F.struct((F.col("price") + two).alias("price"), F.lit(3).cast("long").alias("size")),
        )
        return F.when(snap, pair)

    zero = F.lit(0).cast("long")
    return base.select(
        "exchange_ts", "sequence_number", "instrument_id", "venue_id", kind.alias("record_type"),
        F.when(snap, 0).otherwise(F.col("side_flags")).alias("side_flags"),
        F.when(snap, zero).otherwise(F.col("price")).alias("price"), F.when(snap, zero).otherwise(F.col("size")).alias("size"),
        side(0, -2).alias("bids"), side(5, 7).alias("asks"),
    )


def source_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source rows with faults of every class, and their number ``row_index``."""
    e = F.col("event_id")
    base = _scalars(events(spark, sf_dir)).withColumn("event_id", F.col("sequence_number"))
    level = F.struct(
        F.when(e % 61 == 0, 2).otherwise(e % 2).cast("long").alias("side"), F.col("price").alias("price"), F.col("size").alias("size")
    )
    second = F.struct(((e + 1) % 2).cast("long").alias("side"), (F.col("price") + 1).alias("price"), F.lit(2).cast("long").alias("size"))
    third = F.struct((e % 2).cast("long").alias("side"), (F.col("price") + 3).alias("price"), F.lit(4).cast("long").alias("size"))
    snap = F.col("event_type") == "signup"
    none = F.array().cast("array<struct<side: bigint, price: bigint, size: bigint>>")
    zero = F.lit(0).cast("long")
    return base.select(
        e.alias("row_index"), "exchange_ts", "sequence_number", "instrument_id",
        F.when(e % 97 == 0, 65536).otherwise(F.col("venue_id")).cast("long").alias("venue_id"),
        F.when(e % 89 == 0, 3).when(snap, 2).when(F.col("event_type") == "purchase", 1).otherwise(0).cast("long").alias("record_type"),
        F.when(e % 83 == 0, 2).when(snap, 0).otherwise(F.col("side_flags")).cast("long").alias("side_flags"),
        F.when(snap & (e % 71 != 0), zero).otherwise(F.col("price")).alias("price"),
        F.when(snap, zero).otherwise(F.col("size")).alias("size"),
        F.when(snap | (e % 79 == 0), F.array(level, second, third)).otherwise(none).alias("levels"),
    )
