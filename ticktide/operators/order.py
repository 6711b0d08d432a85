"""The ordered merge: total order, seeking, the contiguous index, order checks.

What depends on the records before within a venue is worked out per slice of its
stream: each slice gives one row (a count, a largest value, its last key), those rows
are carried on from slice to slice, and a window looks at a slice only. No task
holds a venue.
"""

from __future__ import annotations

from functools import reduce
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .. import errors, shared
from ..functions.columns import key
from ..schema import KEY, SNAPSHOT

#: Nanoseconds of a slot of time, and into how many shares very many records are cut.
SLOT, SLICES = 1 << 39, 2048
#: Records of a slice of a stream, on average.
STEP = 1 << 19


def merge(venues: list[DataFrame]) -> DataFrame:
    """The union of venue streams; an empty venue adds nothing."""
    if not venues:
        raise errors.named("NoVenues")("nothing to merge")
    return reduce(DataFrame.unionByName, venues)


def check_venues(venues: list[DataFrame]) -> list[int]:
    """Each stream holds one venue, and no two the same. One aggregate for all of them."""
    tagged = merge([v.select(F.lit(k).alias("k"), "venue_id") for k, v in enumerate(venues)])
    seen: dict[int, int] = {}
    for k, low, high in tagged.groupBy("k").agg(F.min("venue_id"), F.max("venue_id")).collect():
        if low != high:
            raise errors.named("VenueMismatch")(f"stream {k} holds venues {low} to {high}")
        if low in seen:
            raise errors.named("DuplicateVenue")(f"streams {seen[low]} and {k} hold venue {low}")
        seen[low] = k
    return sorted(seen)


def seek(records: DataFrame, from_ts: int) -> DataFrame:
    """Records from ``from_ts`` on: the tail of the whole replay. The filter reaches the scan."""
    return records.where(F.col("exchange_ts") >= F.lit(from_ts))


def ordered(records: DataFrame, partitions: int | None = None) -> DataFrame:
    """Ranges of the total order, sorted within; to be read in partition order."""
    dealt = records.repartitionByRange(partitions, *KEY) if partitions else records.repartitionByRange(*KEY)
    return dealt.sortWithinPartitions(*KEY)


def _slot() -> Column:
    return F.call_function("div", F.col("exchange_ts"), F.lit(SLOT).cast("long"))


def _prefix(rows: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """(slice, records before it) of sorted (slice, records)."""
    sums = accumulate((n for _, n in rows), initial=0)
    return [(s, before) for (s, _), before in zip(rows, sums)]


def _by_time(records: DataFrame, slices: int | None, name: str) -> tuple[DataFrame, list[tuple[int, int]]]:
    """Records with their slice of time in ``name``, and the sorted (slice, records).

    Slices follow the order of time. Slots that hold more than twice a fair share (STEP
    records at least, unless the number of ``slices`` is given), as in trading hours,
    are cut into parts of equal length and counted again, so that no task sorts much
    more than others; only records of one instant cannot be parted.
    """
    counts = sorted(map(tuple, records.groupBy(_slot()).agg(F.count("*")).collect()))
    total = sum(n for _, n in counts)
    if slices is None and total <= STEP:  # one slice
        return records.withColumn(name, F.lit(0).cast("long")), [(0, total)] if total else []
    if not counts:
        return records, []
    share = total // slices + 1 if slices else max(STEP, total // SLICES + 1)
    dealt = records.withColumn(name, _slot())
    if max(n for _, n in counts) > 2 * share:
        low_of, step_of, first_of = shared.fresh(dealt, "low", "step", "first")
        parts, first = [], 0
        for s, n in counts:
            k = -(-n // share) if n > 2 * share else 1
            # slot 0 lies on both sides of time 0 and is twice as long
            low, length = (s * SLOT, SLOT) if s > 0 else (s * SLOT - SLOT + 1, SLOT if s else 2 * SLOT - 1)
            step = -(-length // k)
            parts.append((s, max(low, -(2**63)), step, first))
            first += -(-length // step)
        kinds = f"`{name}` long, `{low_of}` long, `{step_of}` long, `{first_of}` long"
        table = F.broadcast(records.sparkSession.createDataFrame(parts, kinds))  # a row per slot
        part = F.call_function("div", F.col("exchange_ts") - F.col(low_of), F.col(step_of))
        dealt = dealt.join(table, name).select(*records.columns, (F.col(first_of) + part).alias(name))
        counts = sorted(map(tuple, dealt.groupBy(name).agg(F.count("*")).collect()))
    return dealt, counts


def with_emit_index(records: DataFrame, slices: int | None = None) -> DataFrame:
    """Records with their place in the total order, from 0 without gaps, as a long.

    One pass counts records per slot of time (9 minutes); the counts, whose number
    follows the span of time and not the data, are summed up on the driver and
    broadcast, and a record's index is its rank in its slice and the count before it.
    """
    name, begin, rank = shared.fresh(records, "slice", "begin", "rank")
    dealt, counts = _by_time(records, slices, name)
    if not counts:
        return records.withColumn("emit_index", F.lit(None).cast("long"))
    own = F.row_number().over(Window.partitionBy(name).orderBy(*KEY)).cast("long") - 1
    if len(counts) == 1:
        return dealt.select(*records.columns, own.alias("emit_index"))
    begins = F.broadcast(records.sparkSession.createDataFrame(_prefix(counts), f"`{name}` long, `{begin}` long"))
    out = dealt.withColumn(rank, own).join(begins, name)
    return out.select(*records.columns, (F.col(begin) + F.col(rank)).alias("emit_index"))


def last_records(records: DataFrame, n: int) -> DataFrame:
    """The last ``n`` records of the total order with their emit index: the rest is only counted."""
    total = records.count()
    last = records.orderBy(*(F.col(k).desc() for k in KEY)).limit(n)
    back = F.row_number().over(Window.orderBy(*(F.col(k).desc() for k in KEY)))  # over n rows
    return last.withColumn("emit_index", F.lit(total).cast("long") - back)


def sliced(rows: DataFrame, position: str, name: str, dense: bool = False) -> DataFrame:
    """``rows`` with their slice of about STEP rows, in the order of ``position``, a number or a struct that begins with one.

    ``dense``: positions count the rows of each stream, so the slice needs no look at the data.
    """
    kind = rows.schema[position].dataType
    lead = F.col(position)[kind.fields[0].name] if isinstance(kind, StructType) else F.col(position)
    if dense:
        return rows.withColumn(name, F.call_function("div", lead, F.lit(STEP)))
    low, high, n = rows.agg(F.min(lead), F.max(lead), F.count("*")).first()
    if n <= STEP or low is None:
        return rows.withColumn(name, F.lit(0).cast("long"))
    step = max(1, (high - low + 1) * STEP // n)
    return rows.withColumn(name, F.call_function("div", lead.cast("long") - F.lit(low), F.lit(step).cast("long")))


def carried(rows: DataFrame, by: list[str], name: str, own: Column, over, out: str) -> DataFrame:
    """``rows`` (sliced in ``name``) with what the slices before theirs give, per ``by``.

    ``own`` aggregates a slice; ``over(column)`` aggregates the slices before. There is
    a row for each slice of each stream.
    """
    before = Window.partitionBy(*by).orderBy(name).rowsBetween(Window.unboundedPreceding, -1)
    each = rows.groupBy(*by, name).agg(own.alias(out))
    return rows.join(each.select(*by, name, over(F.col(out)).over(before).alias(out)), [*by, name])


def duplicate_keys(records: DataFrame) -> DataFrame:
    return records.groupBy(*KEY).agg(F.count("*").alias("n")).where("n > 1")


def order_violations(records: DataFrame, position: str, by: str = "venue_id") -> DataFrame:
    """Rows whose key does not exceed that of the row before, per ``by``, in the order of ``position``.

    ``kind`` is DuplicateKey for an equal key and OutOfOrder for a smaller one.
    """
    name, now, last, before = shared.fresh(records, "slice", "now", "last", "before")
    rows = sliced(records, position, name).withColumn(now, key())
    rows = carried(rows, [by], name, F.max_by(now, position), lambda c: F.last(c, ignorenulls=True), last)
    prior = F.lag(now).over(Window.partitionBy(by, name).orderBy(position))
    rows = rows.withColumn(before, F.coalesce(prior, F.col(last)))
    kind = F.when(F.col(now) == F.col(before), "DuplicateKey").when(F.col(now) < F.col(before), "OutOfOrder")
    return rows.select(*records.columns, kind.alias("kind")).where("kind IS NOT NULL")


def ts_decreases(records: DataFrame, position: str) -> DataFrame:
    """Rows whose timestamp is below an earlier one of their venue."""
    name, most = shared.fresh(records, "slice", "most")
    rows = carried(sliced(records, position, name), ["venue_id"], name, F.max("exchange_ts"), F.max, most)
    earlier = Window.partitionBy("venue_id", name).orderBy(position).rowsBetween(Window.unboundedPreceding, -1)
    highest = F.greatest(F.max("exchange_ts").over(earlier), F.col(most))
    return rows.withColumn("earlier_max", highest).where("exchange_ts < earlier_max").select(*records.columns, "earlier_max")


def checked(records: DataFrame, position: str) -> DataFrame:
    """``records``, or DuplicateKey or OutOfOrder for the first bad row."""
    bad = order_violations(records, position).orderBy(position).limit(1).collect()
    if bad:
        raise errors.named(bad[0]["kind"])(f"at {position} {bad[0][position]}")
    return records


def seek_index(records: DataFrame, ts: int, by: str = "venue_id") -> DataFrame:
    """Records before ``ts`` per stream: the place of the first at or after it."""
    return records.groupBy(by).agg(F.count_if(F.col("exchange_ts") < F.lit(ts)).alias("seek_index"), F.count("*").alias("n"))


def with_position(records: DataFrame) -> DataFrame:
    """Records with their place in their venue's stream, from 0."""
    name, begin = shared.fresh(records, "slice", "begin")
    dealt, counts = _by_time(records, None, name)
    rank = F.row_number().over(Window.partitionBy("venue_id", name).orderBy(*KEY)).cast("long") - 1
    if len(counts) > 1:
        dealt = carried(dealt, ["venue_id"], name, F.count("*"), F.sum, begin)
        rank = rank + F.coalesce(begin, F.lit(0))
    return dealt.select(*records.columns, rank.alias("position"))


def snapshot_before(placed: DataFrame) -> DataFrame:
    """``placed`` with the place of the last snapshot at or before each record."""
    name, last = shared.fresh(placed, "slice", "last")
    here: Column = F.when(F.col("record_type") == SNAPSHOT, F.col("position"))
    rows = carried(sliced(placed, "position", name, dense=True), ["venue_id"], name, F.max(here), F.max, last)
    so_far = Window.partitionBy("venue_id", name).orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    found = F.coalesce(F.last(here, ignorenulls=True).over(so_far), F.col(last))
    return rows.select(*placed.columns, found.alias("snapshot_before"))


def epoch_runs(placed: DataFrame) -> DataFrame:
    """(venue_id, first_position, last_position, n) of the contiguous runs of snapshots."""
    name, n_before, run = shared.fresh(placed, "slice", "n_before", "run")
    snaps = sliced(placed.where(F.col("record_type") == SNAPSHOT), "position", name, dense=True)
    snaps = carried(snaps, ["venue_id"], name, F.count("*"), F.sum, n_before)
    rank = F.row_number().over(Window.partitionBy("venue_id", name).orderBy("position"))
    runs = snaps.withColumn(run, F.col("position") - F.coalesce(n_before, F.lit(0)) - rank)
    return runs.groupBy("venue_id", run).agg(
        F.min("position").alias("first_position"), F.max("position").alias("last_position"), F.count("*").alias("n")
    ).drop(run)


def venue_ranges(records: DataFrame) -> DataFrame:
    return records.groupBy("venue_id").agg(
        F.min("exchange_ts").alias("min_ts"), F.max("exchange_ts").alias("max_ts"), F.count("*").alias("n_records")
    )


def check_ranges(records: DataFrame, stated: DataFrame) -> DataFrame:
    """Venues whose stated (venue_id, min_ts, max_ts) differ from their records."""
    own = venue_ranges(records).select("venue_id", F.col("min_ts").alias("own_min"), F.col("max_ts").alias("own_max"))
    return stated.join(own, "venue_id", "left").where("NOT (min_ts <=> own_min AND max_ts <=> own_max)")
