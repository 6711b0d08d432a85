"""Ranks of rows among those with the same small number, without gathering them.

A task numbers the rows that it reads per value as they come; the counts per task
and value, summed up in the order of the tasks, tell where each task begins. No row
is shuffled for its rank, so a value that most rows have is no burden.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from . import common


class Counter:
    """Numbers the rows of a task per value, in the order they come; values go from 0 to ``bound``."""

    def __init__(self, bound: int):
        self.seen, self.task = np.zeros(bound + 1, np.int64), TaskContext.get().partitionId()

    def places(self, values: np.ndarray) -> np.ndarray:
        order = np.argsort(values, kind="stable")
        own = values[order]
        first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]]) if len(own) else np.empty(0, np.int64)
        many = np.diff(np.append(first, len(own)))
        out = np.empty(len(own), np.int64)
        out[order] = np.arange(len(own)) - np.repeat(first, many) + self.seen[own]
        self.seen[own[first]] += many
        return out

    def ranked(self, batch: pa.RecordBatch, key: str, part: str, rank: str) -> pa.RecordBatch:
        """``batch`` with the task's number and the rows' ranks."""
        places = self.places(batch.column(key).to_numpy(zero_copy_only=False).astype(np.int64))
        columns = [*batch.columns, pa.array(np.full(len(places), self.task, np.int32)), pa.array(places)]
        return pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, part, rank])


def locally_ranked(rows: DataFrame, key: str, bound: int, part: str, rank: str) -> DataFrame:
    """``rows`` with the number of their task in ``part`` and their rank there among rows of the same ``key``.

    ``key`` is an integer from 0 to ``bound``, never null. Write the result before
    reading it twice: another run may deal the rows otherwise.
    """
    schema = StructType([*rows.schema.fields, StructField(part, IntegerType(), False), StructField(rank, LongType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(bound)
        for batch in batches:
            yield counter.ranked(batch, key, part, rank)

    return rows.mapInArrow(run, schema)


def begins(counts: DataFrame, key: str, part: str, n: str, begin: str) -> DataFrame:
    """``counts`` (key, part, n) as (key, part, begin): rows of ``key`` in the parts before. A key has a row per part."""
    before = Window.partitionBy(key).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    return counts.select(key, part, F.coalesce(F.sum(n).over(before), F.lit(0)).cast("long").alias(begin))


def ranked_within(rows: DataFrame, key: str, order: str, rank: str) -> DataFrame:
    """``rows`` with their place, from 1, among those of the same ``key`` in ``order``, for keys as uneven as they come.

    Ranges of (key, order) are ranked each for itself; a key that fills many of them
    gets its counts summed up over the ranges. (key, order) does not repeat.
    """
    part, begin, n = common.fresh_names(rows, "part", "begin", "n")
    dealt = common.written(rows.repartitionByRange(key, order).withColumn(part, F.spark_partition_id()), "ranges")
    counts = dealt.groupBy(key, part).agg(F.count("*").alias(n))
    own = F.row_number().over(Window.partitionBy(key, part).orderBy(order)).cast("long")
    ranked = dealt.withColumn(rank, own).join(begins(counts, key, part, n, begin).hint("merge"), [key, part])
    return ranked.select(*rows.columns, (F.col(rank) + F.col(begin)).alias(rank))
