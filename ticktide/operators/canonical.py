"""The content digest of an ordered stream, the same for any partitioning.

A record counts as its length and its canonical bytes (little-endian): the eight
scalars, and for a snapshot the number of levels and the levels, but nothing about
where it is stored. Each range of the total order gives the CRC-32C and the length
of its bytes; the ranges are combined in order on the driver, one row each. At the
end stand the number of records and a terminator.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.crc32c import combine, crc32c, crc_rows, fold
from ..schema import SNAPSHOT
from .order import ordered, with_emit_index

#: Fixed values of the digest's format.
TERMINATOR = b"CANONv1\x00"
SCALARS = np.dtype(
    [
        ("length", "<u4"), ("exchange_ts", "<i8"), ("sequence_number", "<u8"), ("instrument_id", "<u4"),
        ("venue_id", "<u2"), ("record_type", "u1"), ("side_flags", "u1"), ("price", "<i8"), ("size", "<i8"),
    ]
)
FIELDS = SCALARS.names[1:]


def projection(records: DataFrame) -> DataFrame:
    """What counts as a record's content."""
    extra = [c for c in ("bids", "asks") if c in records.columns]
    return records.select(*FIELDS, *extra)


def bytes_length() -> Column:
    """Canonical bytes of a record, without the length before them."""
    n = F.coalesce(F.size("bids"), F.lit(0)) + F.coalesce(F.size("asks"), F.lit(0))
    return F.when(F.col("record_type") == SNAPSHOT, 46 + 16 * n).otherwise(40).cast("long")


def payload(bids: list[dict], asks: list[dict]) -> bytes:
    flat = [x for side in (bids, asks) for level in side for x in (level["price"], level["size"])]
    return struct.pack(f"<HH{len(flat)}q", len(bids), len(asks), *flat)


def frames(batch: pa.RecordBatch) -> np.ndarray | bytes:
    """The canonical bytes of a batch: rows of equal length if it has no snapshot."""
    rows = np.zeros(batch.num_rows, SCALARS)
    rows["length"] = 40
    for name in FIELDS:
        column = batch.column(name)
        if pa.types.is_decimal(column.type):
            column = column.cast(pa.uint64())
        rows[name] = column.to_numpy(zero_copy_only=False)
    table = rows.view(np.uint8).reshape(len(rows), SCALARS.itemsize)
    snaps = np.flatnonzero(rows["record_type"] == SNAPSHOT)
    if not len(snaps):
        return table
    out, at = [], 0
    names = batch.schema.names
    for k in snaps.tolist():
        bids, asks = ((batch.column(c)[k].as_py() or []) if c in names else [] for c in ("bids", "asks"))
        body = struct.pack("<H", len(bids) + len(asks)) + payload(bids, asks)
        rows["length"][k] = 40 + len(body)
        out += [table[at : k + 1].tobytes(), body]
        at = k + 1
    return b"".join([*out, table[at:].tobytes()])


def _partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    crc = length = n = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        data = frames(batch)
        if isinstance(data, bytes):
            part, size = crc32c(data), len(data)
        else:
            part, size = fold(crc_rows(data), data.shape[1]), data.size
        crc, length, n = combine(crc, part, size), length + size, n + batch.num_rows
    at = TaskContext.get().partitionId()
    yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (at, crc, length, n)], names=["at", "crc", "length", "n"])


def partials(records: DataFrame, partitions: int | None = None) -> DataFrame:
    stream = ordered(projection(records), partitions)
    return stream.mapInArrow(_partial, "at long, crc long, length long, n long")


def digest(records: DataFrame, partitions: int | None = None) -> tuple[str, int]:
    """(hex digest, number of records) of the stream in total order."""
    crc = n = 0
    for row in sorted(partials(records, partitions).collect()):  # a row per partition
        crc, n = combine(crc, row["crc"], row["length"]), n + row["n"]
    return struct.pack("<I", crc32c(struct.pack("<Q", n) + TERMINATOR, crc)).hex(), n


def sha256_digest(records: DataFrame) -> tuple[str, int]:
    """As ``digest`` by SHA-256, which cannot be combined: the ordered stream is read partition by partition."""
    schema = pa.schema([("frames", pa.binary()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                data = frames(batch)
                data = data if isinstance(data, bytes) else data.tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([data]), pa.array([batch.num_rows])], schema=schema)

    h, n = hashlib.sha256(), 0
    for row in ordered(projection(records)).mapInArrow(run, "frames binary, n long").toLocalIterator():
        h.update(row["frames"])
        n += row["n"]
    h.update(struct.pack("<Q", n) + TERMINATOR)
    return h.hexdigest(), n


#: Records of a leaf, and leaves of a node, of the digest tree.
LEAF, NODE = 1 << 16, 1 << 12


def tree_digest(records: DataFrame, leaf: int = LEAF, node: int = NODE) -> tuple[str, int]:
    """(hex digest, number of records) by a tree of SHA-256, for streams that one reader cannot take in.

    A leaf is the digest of ``leaf`` records in total order, a node that of the digests
    of ``node`` leaves; the root is the digest of the nodes and the end mark. Leaves
    follow the emit index, so the root is the same for any partitioning; a row per
    node goes to the driver.
    """
    stream = with_emit_index(projection(records))
    leaf_of = F.call_function("div", F.col("emit_index"), F.lit(leaf)).alias("leaf")
    dealt = stream.select(leaf_of, "emit_index", *[c for c in stream.columns if c != "emit_index"])
    dealt = dealt.repartitionByRange("leaf").sortWithinPartitions("leaf", "emit_index")
    schema = pa.schema([("leaf", pa.int64()), ("digest", pa.binary()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, h, n = None, hashlib.sha256(), 0
        for batch in batches:
            done: list[tuple[int, bytes, int]] = []
            own = batch["leaf"].to_numpy()
            bounds = [0, *(np.flatnonzero(own[1:] != own[:-1]) + 1).tolist(), len(own)] if len(own) else []
            for a, b in zip(bounds, bounds[1:]):
                if own[a] != now:
                    if now is not None:
                        done.append((now, h.digest(), n))
                    now, h, n = int(own[a]), hashlib.sha256(), 0
                data = frames(batch.slice(a, b - a))
                h.update(data if isinstance(data, bytes) else data.tobytes())
                n += b - a
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done) if done else [()] * 3, schema.types)], schema=schema)
        last = [(now, h.digest(), n)] if now is not None else []
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*last) if last else [()] * 3, schema.types)], schema=schema)

    leaves = dealt.mapInArrow(run, "leaf long, digest binary, n long")
    joined = F.aggregate(F.sort_array(F.collect_list(F.struct("leaf", "digest"))), F.lit(b""), lambda a, x: F.concat(a, x["digest"]))
    nodes = leaves.groupBy(F.call_function("div", F.col("leaf"), F.lit(node)).alias("node"))
    nodes = nodes.agg(F.unhex(F.sha2(joined, 256)).alias("digest"), F.sum("n").alias("n"))
    h, n = hashlib.sha256(), 0
    for row in nodes.orderBy("node").collect():  # a row per node
        h.update(bytes(row["digest"]))
        n += row["n"]
    h.update(struct.pack("<Q", n) + TERMINATOR)
    return h.hexdigest(), n
