"""Conversion of a source file into ordered, partitioned artifacts with snapshot epochs.

All rules are checked before anything is written. The result is written to a
staging folder and renamed, so a rejected or broken conversion leaves nothing.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import errors, schema, shared
from ..functions.columns import artifact_name, utc_day
from . import book, epoch, order, validate

DEFAULT_EPOCH, DEFAULT_SCALE = 1000, 100_000_000


def check_order(rows: DataFrame, position: str = "row_index") -> None:
    """Raise RowError for the first row that goes back in time, or repeats or lowers a key, in its venue."""
    bad = []
    decreased = order.ts_decreases(rows, position).select(position, F.lit("ExchangeTsDecreased").alias("kind"))
    for found in (decreased, order.order_violations(rows, position).select(position, "kind")):
        bad += found.orderBy(position).limit(1).collect()
    if bad:
        first = min(bad, key=lambda r: r[position])  # of one row, going back in time is named first
        raise errors.RowError(first[position], first["kind"])


def check_books(records: DataFrame) -> None:
    if validate.duplicate_levels(records).limit(1).collect():
        raise errors.named("DuplicateLevel")("a snapshot has two levels of one price")
    if bad := book.divergence(records).limit(1).collect():
        raise errors.named("LevelNotFound")(str(bad[0].asDict()))


def with_partition(records: DataFrame) -> DataFrame:
    """Records with their UTC day and the name of their artifact."""
    dated = records.withColumn("day", utc_day(F.col("exchange_ts")))
    return dated.withColumn("artifact", artifact_name(F.col("venue_id"), F.col("day")))


def converted(source: DataFrame, epoch_every: int = DEFAULT_EPOCH) -> DataFrame:
    """Checked records of source rows, with epochs and partition columns."""
    validate.check_rows(source)
    rows = validate.to_records(source)
    check_order(rows)
    records = rows.drop("row_index")
    check_books(records)
    return with_partition(epoch.with_epochs(records, epoch_every) if epoch_every else records)


def write(records: DataFrame, folder: str, price_scale: int = DEFAULT_SCALE) -> None:
    """Records as Parquet by venue and day, sorted within files; the folder must not exist.

    A venue's day is dealt by ranges of time, so a large one makes many files.
    """
    if price_scale <= 0:
        raise errors.named("PriceScale")(str(price_scale))
    spark = records.sparkSession
    staging = f"{folder.rstrip('/')}.staging-{uuid.uuid4().hex}"
    scaled = records.withColumn("price_scale", F.lit(price_scale).cast("long"))
    dealt = scaled.repartitionByRange("venue_id", "day", "exchange_ts").sortWithinPartitions("venue_id", "day", *schema.KEY)
    try:
        dealt.write.partitionBy("venue_id", "day").parquet(staging)
        shared.rename(spark, staging, folder)
    except BaseException:
        shared.delete(spark, staging)
        raise


def convert(spark: SparkSession, source: str, folder: str, epoch_every: int = DEFAULT_EPOCH, price_scale: int = DEFAULT_SCALE) -> list[str]:
    """Convert a source Parquet file; returns the names of the artifacts."""
    schema.check_source_file(source)
    records = converted(schema.read_source(spark, source), epoch_every)
    write(records, folder, price_scale)
    made = spark.read.parquet(folder).select("artifact").distinct().orderBy("artifact")
    return [r[0] for r in made.collect()]  # a name per venue and day


def replay(spark: SparkSession, folder: str, from_ts: int | None = None) -> DataFrame:
    """Records of converted folders in total order with their index."""
    records = spark.read.parquet(folder)
    records = records.select(*(c for c in records.columns if c not in ("day", "artifact", "price_scale")))
    return order.with_emit_index(records if from_ts is None else order.seek(records, from_ts))
