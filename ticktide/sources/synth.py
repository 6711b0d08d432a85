"""A deterministic dataset of several venues, for tests and benchmarks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Records of each venue's days.
STANDARD = {1: (1500, 1200, 900), 2: (800, 0, 1100), 3: (2000, 300), 4: (90,), 5: ()}


def build(spark: SparkSession, shape: dict[int, tuple[int, ...]] = STANDARD, seed: int = 0x5EED, snapshot_every: int = 150) -> DataFrame:
    """Records of ``shape``; steps, prices and sizes come from a hash of seed, venue and number."""
    rows = [(v, sum(days)) for v, days in shape.items()]
    each = spark.createDataFrame(rows, "venue_id int, n long").where("n > 0")
    each = each.select("venue_id", F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("number"))

    def drawn(what: int, below: int):
        return F.pmod(F.xxhash64(F.lit(seed), "venue_id", "number", F.lit(what)), F.lit(below))

    order = Window.partitionBy("venue_id").orderBy("number")
    ts = (F.col("venue_id") - 1) * 7 + F.sum(drawn(0, 4)).over(order)
    snap = F.col("number") % snapshot_every == 0
    level = "array<struct<price: bigint, size: bigint>>"

    def side(*levels):
        made = F.array(*(F.struct(F.lit(p).cast("long").alias("price"), drawn(5 + k, 10).alias("size")) for k, p in enumerate(levels)))
        return F.when(snap, made.cast(level))

    zero = F.lit(0).cast("long")
    return each.select(
        ts.cast("long").alias("exchange_ts"), F.col("number").cast("decimal(20,0)").alias("sequence_number"),
        drawn(1, 8).alias("instrument_id"), "venue_id", F.when(snap, 2).otherwise(0).alias("record_type"),
        F.when(snap, 0).otherwise(drawn(2, 2)).cast("int").alias("side_flags"),
        F.when(snap, zero).otherwise(100 + drawn(3, 50)).alias("price"), F.when(snap, zero).otherwise(1 + drawn(4, 10)).alias("size"),
        side(120, 119).alias("bids"), side(121).alias("asks"),
    )


def stream(spark: SparkSession, n: int, venues: int = 4, seed: int = 0x5EED) -> DataFrame:
    """``n`` deltas of some venues, one after the other in time; no window, for benchmarks of any size."""
    number = F.col("id")

    def drawn(what: int, below: int):
        return F.pmod(F.xxhash64(F.lit(seed), number, F.lit(what)), F.lit(below))

    level = "array<struct<price: bigint, size: bigint>>"
    return spark.range(n).select(
        (number * 1_000_000 + drawn(0, 1_000_000)).alias("exchange_ts"), number.cast("decimal(20,0)").alias("sequence_number"),
        drawn(1, 8).alias("instrument_id"), (drawn(2, venues) + 1).cast("int").alias("venue_id"), F.lit(0).alias("record_type"),
        drawn(3, 2).cast("int").alias("side_flags"), (100 + drawn(4, 50)).alias("price"), (1 + drawn(5, 10)).alias("size"),
        F.lit(None).cast(level).alias("bids"), F.lit(None).cast(level).alias("asks"),
    )
