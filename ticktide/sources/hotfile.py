"""Binary artifacts: one venue's records at a fixed stride, with indexes and checksums.

``encode`` and ``HotFile`` write and read the bytes of a file; ``HotFileSource`` is
the Spark data source ``hotfile`` that reads files by ranges of blocks; ``export``
writes artifacts from records. Everything is little-endian.
"""

from __future__ import annotations

import hashlib
import json
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, GreaterThanOrEqual, InputPartition

from .. import errors, shared
from ..functions.columns import artifact_name, utc_day
from ..functions.crc32c import crc32c, crc_rows, fold
from ..operators.canonical import payload
from ..schema import KEY, SNAPSHOT
from ..shared import store_of

# Fixed values of the format.
MAGIC = b"\x89RPL\r\n\x1a\n"
VERSION, RECORD_SIZE, DEFAULT_BLOCK, HEADER_BYTES, CRC_COVERS, FINALIZED_AT = 1, 64, 1024, 128, 120, 120
MAX_RECORDS, MAX_BLOCK, MAX_HEADER = 2**40, 2**24, 2**20
HEADER = struct.Struct("<8sIHHqQqqIIQQQQQQQII")
RECORD = np.dtype(
    [
        ("exchange_ts", "<i8"), ("sequence_number", "<u8"), ("instrument_id", "<u4"), ("venue_id", "<u2"),
        ("record_type", "u1"), ("side_flags", "u1"), ("price", "<i8"), ("size", "<i8"),
        ("blob_offset", "<u8"), ("blob_len", "<u4"), ("level_count", "<u2"), ("reserved", "V10"),
    ]
)
FOOTER = np.dtype([("start", "<u8"), ("crc", "<u4")])


@dataclass(frozen=True)
class Header:
    version: int
    venue_id: int
    reserved: int
    price_scale: int
    n_records: int
    min_ts: int
    max_ts: int
    header_size: int
    block_size: int
    blob_at: int
    blob_len: int
    time_at: int
    n_time: int
    snap_at: int
    n_snap: int
    footer_at: int
    trailer_crc: int


def block_count(n_records: int, block_size: int) -> int:
    return -(-n_records // block_size)


def header_size_for(page_size: int) -> int:
    """The header's fields rounded up to whole pages."""
    if page_size <= 0 or page_size > MAX_HEADER or page_size & (page_size - 1):
        raise errors.named("HeaderSize")(str(page_size))
    return max(page_size, -(-HEADER_BYTES // page_size) * page_size)


def _block_crcs(data: bytes, n: int, block: int) -> list[int]:
    """CRC-32C of each block of records."""
    size, out = block * RECORD_SIZE, []
    for at in range(0, n * RECORD_SIZE, size):
        part = data[at : at + size]
        rows = np.frombuffer(part, np.uint8).reshape(-1, RECORD_SIZE)
        out.append(fold(crc_rows(rows), RECORD_SIZE))
    return out


class Image:
    """One file that grows by batches of records in key order; what is kept of a record is its bytes."""

    def __init__(self, venue_id: int, price_scale: int = 100_000_000, block: int = DEFAULT_BLOCK, page: int = 4096):
        if price_scale <= 0:
            raise errors.named("PriceScale")(str(price_scale))
        if not 0 < block <= MAX_BLOCK:
            raise errors.named("BlockSize")(str(block))
        self.venue_id, self.price_scale, self.block, self.page = venue_id, price_scale, block, page
        self.rows: list[np.ndarray] = []
        self.blobs: list[bytes] = []
        self.n = self.blob_bytes = 0
        self.last: np.ndarray | None = None

    def _fault(self, kind: str, bad: np.ndarray) -> None:
        if bad.any():
            raise errors.named(kind)(f"record {self.n + int(bad.argmax())}")

    def add(self, batch: pa.RecordBatch) -> None:
        """Records with the columns of the record schema."""
        rows = np.zeros(batch.num_rows, RECORD)
        wide = {}
        for c in RECORD.names[:8]:
            column = batch.column(c)
            wide[c] = (column.cast(pa.uint64()) if pa.types.is_decimal(column.type) else column).to_numpy(zero_copy_only=False)
            rows[c] = wide[c]
        if not len(rows):
            return
        self._fault("VenueMismatch", wide["venue_id"] != self.venue_id)
        self._check_order(rows)
        self._fault("RecordType", (wide["record_type"] < 0) | (wide["record_type"] > SNAPSHOT))
        snap = rows["record_type"] == SNAPSHOT
        self._fault("UnusedFieldSet", snap & ((rows["price"] != 0) | (rows["size"] != 0) | (rows["side_flags"] != 0)))
        names = batch.schema.names
        for k in np.flatnonzero(snap).tolist():
            bids, asks = ((batch.column(c)[k].as_py() or []) if c in names else [] for c in ("bids", "asks"))
            if len(bids) + len(asks) > 65535:
                raise errors.named("TooManyLevels")(f"record {self.n + k}")
            body = payload(bids, asks)
            self.blobs.append(struct.pack("<I", crc32c(body)) + body)
            rows["blob_offset"][k], rows["blob_len"][k], rows["level_count"][k] = self.blob_bytes, len(body) + 4, len(bids) + len(asks)
            self.blob_bytes += len(body) + 4
        self.rows.append(rows)
        self.n += len(rows)

    def _check_order(self, rows: np.ndarray) -> None:
        seen = rows if self.last is None else np.concatenate([self.last, rows])
        same, less = np.ones(len(seen) - 1, bool), np.zeros(len(seen) - 1, bool)
        for c in KEY:
            less |= same & (seen[c][1:] < seen[c][:-1])
            same &= seen[c][1:] == seen[c][:-1]
        shift = np.zeros(len(rows) - len(less), bool)
        bad = np.concatenate([shift, same | less])
        if bad.any():
            k = int(bad.argmax())
            raise errors.named("DuplicateKey" if same[k - len(shift)] else "OutOfOrder")(f"record {self.n + k}")
        self.last = rows[-1:]

    def finished(self) -> bytes:
        """The bytes of the finalized file."""
        rows = np.concatenate(self.rows) if self.rows else np.zeros(0, RECORD)
        data, blob_bytes = rows.tobytes(), b"".join(self.blobs)
        n, head = len(rows), header_size_for(self.page)
        crcs = _block_crcs(data, n, self.block)
        footer = np.zeros(len(crcs), FOOTER)
        footer["start"], footer["crc"] = np.arange(len(crcs)) * self.block, crcs
        stamps = rows["exchange_ts"][:: self.block].astype("<i8").tobytes()
        snaps = np.flatnonzero(rows["record_type"] == SNAPSHOT).astype("<u8").tobytes()
        tail = stamps + snaps + footer.tobytes()
        blob_at = head + n * RECORD_SIZE
        time_at = blob_at + len(blob_bytes)
        low, high = (int(rows["exchange_ts"][0]), int(rows["exchange_ts"][-1])) if n else (0, 0)
        fields = HEADER.pack(
            MAGIC, VERSION, self.venue_id, 0, self.price_scale, n, low, high, head, self.block, blob_at, len(blob_bytes), time_at,
            len(stamps) // 8, time_at + len(stamps), len(snaps) // 8, time_at + len(stamps) + len(snaps), crc32c(tail), 0,
        )
        top = fields + b"\x01\0\0\0" + struct.pack("<I", crc32c(fields[:CRC_COVERS]))
        return top.ljust(head, b"\0") + data + blob_bytes + tail


_LEVELS = pa.list_(pa.struct([("price", pa.int64()), ("size", pa.int64())]))


def encode(records: list[dict], venue_id: int, price_scale: int = 100_000_000, block: int = DEFAULT_BLOCK, page: int = 4096) -> bytes:
    """The bytes of a finalized file. ``records``, in key order, have the columns of the record schema."""
    image = Image(venue_id, price_scale, block, page)
    columns = {c: pa.array([int(r[c]) for r in records], pa.uint64() if c == "sequence_number" else pa.int64()) for c in RECORD.names[:8]}
    columns |= {c: pa.array([[dict(zip(("price", "size"), x)) if isinstance(x, tuple) else x for x in r.get(c) or []] for r in records], _LEVELS) for c in ("bids", "asks")}
    image.add(pa.RecordBatch.from_pydict(columns))
    return image.finished()


def decode_header(data: bytes) -> Header:
    if len(data) < HEADER_BYTES:
        raise errors.named("ShortHeader")(str(len(data)))
    magic, *fields, reserved2 = HEADER.unpack_from(data)
    if magic != MAGIC:
        raise errors.named("BadMagic")(magic.hex())
    if struct.unpack_from("<I", data, 124)[0] != crc32c(data[:CRC_COVERS]):
        raise errors.named("HeaderChecksum")("header")
    h = Header(*fields)
    if h.reserved or reserved2 or any(data[121:124]) or data[FINALIZED_AT] > 1 or any(data[HEADER_BYTES : h.header_size]):
        raise errors.named("ReservedSet")("header")
    if h.version != VERSION:
        raise errors.named("FormatVersion")(str(h.version))
    if not data[FINALIZED_AT]:
        raise errors.named("NotFinalized")("header")
    return h


def check_header(h: Header, file_size: int) -> None:
    """Raise unless the regions follow each other exactly and end with the file."""
    for kind, good in (
        ("HeaderSize", HEADER_BYTES <= h.header_size <= MAX_HEADER),
        ("BlockSize", 0 < h.block_size <= MAX_BLOCK),
        ("PriceScale", h.price_scale > 0),
        ("RecordCount", h.n_records <= MAX_RECORDS),
        ("IndexCount", h.n_time == block_count(h.n_records, max(h.block_size, 1)) and h.n_snap <= h.n_records),
    ):
        if not good:
            raise errors.named(kind)("header")
    ends = [h.header_size + h.n_records * RECORD_SIZE, h.blob_len, h.n_time * 8, h.n_snap * 8, h.n_time * FOOTER.itemsize]
    starts = np.cumsum(np.array(ends, dtype=object)).tolist()
    if starts[:4] != [h.blob_at, h.time_at, h.snap_at, h.footer_at] or starts[4] != file_size:
        raise errors.named("OffsetChain")("header")


class HotFile:
    """A whole file image. Blocks and blobs are verified when they are read."""

    def __init__(self, data: bytes):
        self.data, self.header = data, decode_header(data)
        h = self.header
        check_header(h, len(data))
        if crc32c(data[h.time_at :]) != h.trailer_crc:
            raise errors.named("TrailerChecksum")("indexes")
        self.rows = np.frombuffer(data, RECORD, h.n_records, h.header_size)
        self.times = np.frombuffer(data, "<i8", h.n_time, h.time_at)
        self.snaps = np.frombuffer(data, "<u8", h.n_snap, h.snap_at)
        self.footer = np.frombuffer(data, FOOTER, h.n_time, h.footer_at)
        if (np.diff(self.times) < 0).any() or (np.diff(self.snaps.astype(np.int64)) <= 0).any():
            raise errors.named("IndexOrder")("indexes")
        if len(self.snaps) and self.snaps[-1] >= h.n_records:
            raise errors.named("IndexRange")("snapshots")
        if (self.footer["start"] != np.arange(h.n_time, dtype=np.uint64) * np.uint64(h.block_size)).any():
            raise errors.named("FooterGeometry")("footer")
        if len(self) and (self.rows["exchange_ts"][0] != h.min_ts or self.rows["exchange_ts"][-1] != h.max_ts):
            raise errors.named("HeaderRange")("header")

    def __len__(self) -> int:
        return self.header.n_records

    def verify_block(self, block: int) -> None:
        h = self.header
        if not 0 <= block < h.n_time:
            raise errors.named("BlockRange")(str(block))
        at = h.header_size + block * h.block_size * RECORD_SIZE
        end = min(at + h.block_size * RECORD_SIZE, h.blob_at)
        if _block_crcs(self.data[at:end], (end - at) // RECORD_SIZE, h.block_size)[0] != self.footer["crc"][block]:
            raise errors.named("BlockChecksum")(str(block))

    def verify_all(self) -> None:
        for block in range(self.header.n_time):
            self.verify_block(block)
        for k in self.snaps.tolist():
            self.levels(k)

    def record(self, k: int) -> dict:
        if not 0 <= k < len(self):
            raise IndexError(k)
        row = self.rows[k]
        out = {c: int(row[c]) for c in RECORD.names[:8]}
        bids, asks = self.levels(k) if out["record_type"] == SNAPSHOT else (None, None)
        return out | {"bids": bids, "asks": asks}

    def levels(self, k: int) -> tuple[list[dict], list[dict]]:
        row, h = self.rows[k], self.header
        if row["record_type"] != SNAPSHOT:
            raise errors.named("NotSnapshot")(str(k))
        at, size = int(row["blob_offset"]), int(row["blob_len"])
        if at + size > h.blob_len:
            raise errors.named("BlobOutOfRange")(str(k))
        blob = self.data[h.blob_at + at : h.blob_at + at + size]
        if crc32c(blob[4:]) != struct.unpack_from("<I", blob)[0]:
            raise errors.named("BlobChecksum")(str(k))
        return parse_payload(blob[4:], int(row["level_count"]))

    def seek(self, ts: int) -> int:
        """The first record at or after ``ts``."""
        return int(np.searchsorted(self.rows["exchange_ts"], ts, "left"))

    def snapshot_before(self, k: int) -> int | None:
        at = int(np.searchsorted(self.snaps.astype(np.int64), k, "right"))
        return int(self.snaps[at - 1]) if at else None


def parse_payload(body: bytes, level_count: int | None = None) -> tuple[list[dict], list[dict]]:
    if len(body) < 4 or (len(body) - 4) % 16:
        raise errors.named("BlobLength")(str(len(body)))
    n_bids, n_asks = struct.unpack_from("<HH", body)
    if (level_count is not None and n_bids + n_asks != level_count) or 16 * (n_bids + n_asks) != len(body) - 4:
        raise errors.named("BlobLevelCount")(f"{n_bids}+{n_asks}")
    flat = struct.unpack_from(f"<{2 * (n_bids + n_asks)}q", body, 4)
    levels = [{"price": p, "size": s} for p, s in zip(flat[::2], flat[1::2], strict=True)]
    return levels[:n_bids], levels[n_bids:]


def _store(path: str):
    """The store of a file, a folder, or a JSON list of them."""
    return store_of(json.loads(path)[0] if path.startswith("[") else path)[0]


def _files(path: str) -> tuple[object, list]:
    """The store and the artifacts of a file, a folder, or a JSON list of them."""
    from pyarrow import fs

    if path.startswith("["):
        parts = [_files(p) for p in json.loads(path)]
        return parts[0][0], [f for _, files in parts for f in files]
    store, root = store_of(path)
    info = store.get_file_info(root)
    found = [info] if info.is_file else store.get_file_info(fs.FileSelector(root))
    return store, sorted((f for f in found if f.path.endswith(".bin")), key=lambda f: f.path)


@dataclass
class BlockRange(InputPartition):
    path: str
    file: str
    first: int
    end: int


class HotFileReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.per_task = options.get("paths") or options["path"], int(options.get("blocks", 256))
        #: Blocks that end before this time are not read.
        self.from_ts: int | None = int(options["from_ts"]) if "from_ts" in options else None

    def partitions(self):
        store, files = _files(self.path)
        out = []
        for info in files:
            with store.open_input_file(info.path) as f:
                h = decode_header(f.read_at(min(info.size, MAX_HEADER), 0))
                check_header(h, info.size)
                first = 0
                if self.from_ts is not None and h.n_time:
                    times = np.frombuffer(f.read_at(h.n_time * 8, h.time_at), "<i8")
                    first = max(int(np.searchsorted(times, self.from_ts, "left")) - 1, 0)
                    if h.max_ts < self.from_ts:
                        first = h.n_time
            for at in range(first, h.n_time, self.per_task):
                out.append(BlockRange(self.path, info.path, at, min(at + self.per_task, h.n_time)))
        return out or [BlockRange(self.path, "", 0, 0)]

    def read(self, partition: BlockRange) -> Iterator[pa.RecordBatch]:
        if partition.first >= partition.end:
            return
        store = _store(partition.path)
        with store.open_input_file(partition.file) as f:
            h = decode_header(f.read_at(min(f.size(), MAX_HEADER), 0))
            footer = np.frombuffer(f.read_at(h.n_time * FOOTER.itemsize, h.footer_at), FOOTER)
            for block in range(partition.first, partition.end):
                begin = block * h.block_size
                n = min(h.block_size, h.n_records - begin)
                data = f.read_at(n * RECORD_SIZE, h.header_size + begin * RECORD_SIZE)
                if _block_crcs(data, n, n)[0] != footer["crc"][block]:
                    raise errors.named("BlockChecksum")(f"{partition.file} block {block}")
                yield self._batch(f, h, np.frombuffer(data, RECORD))

    def _batch(self, f, h: Header, rows: np.ndarray) -> pa.RecordBatch:
        levels = _LEVELS
        bids: list = [None] * len(rows)
        asks: list = [None] * len(rows)
        for k in np.flatnonzero(rows["record_type"] == SNAPSHOT).tolist():
            blob = f.read_at(int(rows["blob_len"][k]), h.blob_at + int(rows["blob_offset"][k]))
            if crc32c(blob[4:]) != struct.unpack_from("<I", blob)[0]:
                raise errors.named("BlobChecksum")(str(k))
            bids[k], asks[k] = parse_payload(blob[4:], int(rows["level_count"][k]))
        def own(c, kind):
            return pa.array(rows[c].astype(kind))

        sequence = pa.array(rows["sequence_number"].astype(np.uint64)).cast(pa.decimal128(20, 0))
        columns = [
            own("exchange_ts", "i8"), sequence, own("instrument_id", "i8"), own("venue_id", "i4"), own("record_type", "i4"),
            own("side_flags", "i4"), own("price", "i8"), own("size", "i8"), pa.array(bids, levels), pa.array(asks, levels),
        ]
        names = ["exchange_ts", "sequence_number", "instrument_id", "venue_id", "record_type", "side_flags", "price", "size", "bids", "asks"]
        return pa.RecordBatch.from_arrays(columns, names=names)


class PushingReader(HotFileReader):
    """Spark takes this one only if its setting ``spark.sql.python.filterPushdown.enabled`` is true."""

    def pushFilters(self, filters):
        """Timestamps from a bound on skip the blocks before it; rows are filtered again by Spark."""
        for f in filters:
            if isinstance(f, GreaterThanOrEqual) and f.attribute == ("exchange_ts",):
                self.from_ts = max(f.value, self.from_ts if self.from_ts is not None else f.value)
            yield f


class HotFileSource(DataSource):
    """``spark.read.format("hotfile").load(folder)``, after ``spark.dataSource.register(HotFileSource)``.

    Option ``paths``: a JSON list of files or folders instead; ``blocks``: blocks per
    task; ``from_ts``: leave out blocks before a time; ``pushdown``: take that time
    from the query's filters (``read`` sets it where the session allows it).
    """

    @classmethod
    def name(cls) -> str:
        return "hotfile"

    def schema(self) -> str:
        from ..schema import RECORD_SCHEMA

        return RECORD_SCHEMA

    def reader(self, schema) -> HotFileReader:
        return (PushingReader if self.options.get("pushdown") == "true" else HotFileReader)(self.options)


def read(spark: SparkSession, path: str, **options) -> DataFrame:
    """Records of a file or folder of artifacts, or a JSON list of them."""
    spark.dataSource.register(HotFileSource)
    pushes = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false").lower()
    return spark.read.format("hotfile").options(pushdown=pushes, **options).option("paths", path).load()


def export(records: DataFrame, folder: str, price_scale: int = 100_000_000, block: int = DEFAULT_BLOCK) -> list[tuple[str, str]]:
    """Artifacts of each venue and UTC day in ``folder`` with ``.hash`` sidecars; returns (name, hash).

    A venue's day is one file, as the format asks: its header covers all of it. One
    task puts it together as bytes, 64 for each record and those of its levels. A file
    appears under its name only when it is whole.
    """
    name_of, = shared.fresh(records, "artifact")
    named = records.withColumn(name_of, artifact_name(F.col("venue_id"), utc_day(F.col("exchange_ts"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = store_of(folder)
        store.create_dir(root, recursive=True)

        def close(name: str, image: Image) -> tuple[str, str]:
            data = image.finished()
            sha = hashlib.sha256(data).hexdigest()
            for suffix, body in (("", data), (".hash", (sha + "\n").encode())):
                part = f"{root}/.{name}{suffix}.{uuid.uuid4().hex}.part"
                with store.open_output_stream(part) as out:
                    out.write(body)
                store.move(part, f"{root}/{name}{suffix}")
            return name, sha

        name, image, done = None, None, []
        for batch in batches:
            names = batch.column(name_of).to_numpy(zero_copy_only=False)
            bounds = [0, *(np.flatnonzero(names[1:] != names[:-1]) + 1).tolist(), len(names)] if len(names) else []
            for a, b in zip(bounds, bounds[1:]):
                if names[a] != name:
                    if image is not None:
                        done.append(close(name, image))
                    name = names[a]
                    image = Image(batch.column("venue_id")[a].as_py(), price_scale, block)
                image.add(batch.slice(a, b - a))
        if image is not None:
            done.append(close(name, image))
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in (zip(*done) if done else [()] * 2)], names=["name", "hash"])

    dealt = named.repartition(name_of).sortWithinPartitions(name_of, *KEY)
    return sorted(tuple(r) for r in dealt.mapInArrow(run, "name string, hash string").collect())  # a row per file


def inspect(spark: SparkSession, folder: str, damage: dict[str, int] | None = None) -> DataFrame:
    """(artifact, damage, fault, header) of each file of a folder, checked as a whole where it is read.

    ``damage`` names bytes to flip before the check, by their place in the file (from
    its end if negative); without it, files are checked as they are. ``fault`` is the
    class of what is wrong, null if nothing is; ``header`` has the header's numbers.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.bin").load(folder)
    files = files.select(F.element_at(F.split("path", "/"), -1).alias("artifact"), "content")
    numbers = ("version", "venue_id", "n_records", "min_ts", "max_ts", "header_size", "block_size", "n_time", "n_snap", "blob_len")
    kinds = f"artifact string, damage string, fault string, file_size long, {', '.join(f'{x} long' for x in numbers)}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for name, content in zip(batch["artifact"].to_pylist(), batch["content"]):
                whole = content.as_py()
                for what, at in (damage or {"": None}).items():
                    data = whole
                    if at is not None:
                        at %= len(whole)
                        data = whole[:at] + bytes([whole[at] ^ 1]) + whole[at + 1 :]
                    fault, header = None, [None] * len(numbers)
                    try:
                        file = HotFile(data)
                        header = [getattr(file.header, x) for x in numbers]
                        file.verify_all()
                    except errors.TapeError as e:
                        fault = type(e).__name__
                    rows.append((name, what, fault, len(data), *header))
            columns = list(zip(*rows)) if rows else [()] * (4 + len(numbers))
            types = [pa.string()] * 3 + [pa.int64()] * (1 + len(numbers))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["artifact", "damage", "fault", "file_size", *numbers])

    return files.mapInArrow(run, kinds)
