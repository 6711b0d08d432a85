"""Token-id files in patched frame-of-reference blocks.

Ids of documents in ascending order of their ids are stored back to back. A block
of ``BLOCK`` ids keeps its minimum, the differences packed at the width that holds
the ``PERCENTILE`` of them, and an exception list (position, high bits) for the
outliers. A file (little-endian):

    magic "TKPF1", u32 block size
    blocks: packed differences | u16 positions | u32 high bits
    u64 start of each block | u32 minimum | u8 width | u16 exceptions      (the index)
    i64 document ids | u8 "has an id" | u64 number of ids of each document
    footer: u64 index start, u64 documents, u64 ids, u32 crc32 of all before, magic

Texts are encoded where they are read; their ids, not the texts, are dealt by ranges
of the document ids, of about ``TASK`` bytes of text each, by quantiles of the document
ids alone. Tasks write a file or more for each range, under names of their own; the list of files (Parquet, beside them) is committed by Spark, so that
lost or repeated tasks leave nothing that is read, and the manifest adds the ids
before each file. Files are read by Spark's ``binaryFile`` source and roll at
``ROLL`` ids. Executors write through pyarrow's file systems; ``store_of`` maps the
URLs that Spark uses to them.

Defined cases: a null text is empty; an empty document is the end id alone; a null
document id comes first and stays null; repeated rows are documents of their own,
however many; an empty table has an empty manifest and gives an empty result; other
columns are not read. Document ids are integers; any other type is an error.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..shared import store_of
from . import common, tokens

MAGIC, BLOCK, PERCENTILE, ROLL = b"TKPF1", 512, 0.95, 1 << 24
FOOTER = struct.Struct("<QQQI")
#: Blocks that are packed or unpacked at once.
AT_ONCE = 1024
#: Bytes of text whose ids make a range, unless that makes more ranges than MOST_TASKS.
TASK, MOST_TASKS = 5 << 20, 100_000


def _spread(width: int) -> tuple[np.ndarray, np.ndarray]:
    """(32-bit word, shift) of each packed value of a block."""
    at = np.arange(BLOCK) * width
    return at // 32, (at % 32).astype(np.uint64)


def _packed(values: np.ndarray, width: int) -> np.ndarray:
    """The low ``width`` bits of each value (uint32), back to back, in words of 32 bits."""
    word, shift = _spread(width)
    wide = (values.astype(np.uint64) & np.uint64((1 << width) - 1)) << shift
    first = np.searchsorted(word, np.arange(BLOCK * width // 32))  # a value begins in every word
    sums = np.add.reduceat(wide, first, axis=1)
    out = (sums & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    out[:, 1:] |= (sums[:, :-1] >> np.uint64(32)).astype(np.uint32)
    return out


def _unpacked(words: np.ndarray, width: int) -> np.ndarray:
    word, shift = _spread(width)
    pairs = words.astype(np.uint64)
    pairs[:, :-1] |= pairs[:, 1:] << np.uint64(32)
    return ((pairs[:, word] >> shift) & np.uint64((1 << width) - 1)).astype(np.uint32)


def packed_blocks(ids: np.ndarray) -> Iterator[tuple[bytes, int, int, int]]:
    """(payload, minimum, width, exceptions) of each block; the last block is filled up with its last id."""
    if len(ids) % BLOCK:
        ids = np.concatenate([ids, np.full(-len(ids) % BLOCK, ids[-1], ids.dtype)])
    for at in range(0, len(ids), BLOCK * AT_ONCE):
        part = ids[at : at + BLOCK * AT_ONCE].reshape(-1, BLOCK).astype(np.uint32)
        low = part.min(axis=1)
        part = part - low[:, None]
        rank = int(PERCENTILE * (BLOCK - 1))
        width = np.ceil(np.log2(np.partition(part, rank, axis=1)[:, rank].astype(np.float64) + 1)).astype(np.int64)
        payload: list[bytes] = [b""] * len(part)
        odd = (part >> width[:, None].astype(np.uint32)) > 0
        for w in np.unique(width).tolist():
            rows = np.flatnonzero(width == w)
            if w:
                for r, line in zip(rows.tolist(), _packed(part[rows], w).astype("<u4")):
                    payload[r] = line.tobytes()
        n_odd = odd.sum(axis=1)
        for r in np.flatnonzero(n_odd).tolist():
            where = np.flatnonzero(odd[r])
            payload[r] += where.astype("<u2").tobytes() + (part[r, where] >> np.uint32(width[r])).astype("<u4").tobytes()
        yield from zip(payload, low.tolist(), width.tolist(), n_odd.tolist())


def unpacked(data: bytes, start: np.ndarray, low: np.ndarray, width: np.ndarray, n_odd: np.ndarray) -> np.ndarray:
    """The ids of all blocks."""
    raw = np.frombuffer(data, np.uint8)
    out = np.empty((len(start), BLOCK), np.uint32)
    for w in np.unique(width).tolist():
        every = np.flatnonzero(width == w)
        for at in range(0, len(every), AT_ONCE):
            rows = every[at : at + AT_ONCE]
            values = np.zeros((len(rows), BLOCK), np.uint32)
            if w:
                lines = raw[start[rows][:, None] + np.arange(BLOCK * w // 8)]
                values = _unpacked(lines.view("<u4"), w)
            out[rows] = values
    for r in np.flatnonzero(n_odd).tolist():
        n, at = int(n_odd[r]), int(start[r]) + BLOCK * int(width[r]) // 8
        where = np.frombuffer(data, "<u2", n, at)
        out[r, where] += np.frombuffer(data, "<u4", n, at + 2 * n) << np.uint32(width[r])
    return (out + low[:, None].astype(np.uint32)).reshape(-1)


class FileWriter:
    """Writes one file to a binary stream, block by block."""

    def __init__(self, stream):
        self.stream, self.crc, self.at = stream, 0, 0
        self.rest, self.n_ids = np.empty(0, np.uint32), 0
        self.index: list[tuple[int, int, int, int]] = []
        self.docs: list[tuple[int | None, int]] = []
        self.waiting: list[bytes] = []
        self.n_waiting = 0
        self._put(MAGIC + struct.pack("<I", BLOCK))

    def _put(self, data: bytes) -> None:
        self.stream.write(data)
        self.crc = zlib.crc32(data, self.crc)
        self.at += len(data)

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.docs.append((doc_id, len(ids) // 4))
        self.waiting.append(ids)
        self.n_waiting += len(ids) // 4
        self.n_ids += len(ids) // 4
        if self.n_waiting >= BLOCK * AT_ONCE:
            self._flush(False)

    def _flush(self, final: bool) -> None:
        ids = np.concatenate([self.rest, np.frombuffer(b"".join(self.waiting), "<u4")])
        whole = len(ids) if final else len(ids) // BLOCK * BLOCK
        ids, self.rest, self.waiting, self.n_waiting = ids[:whole], ids[whole:], [], 0
        for payload, low, width, n_odd in packed_blocks(ids):
            self.index.append((self.at, low, width, n_odd))
            self._put(payload)

    def close(self) -> None:
        self._flush(True)
        at = self.at
        for column, kind in zip(zip(*self.index) if self.index else [()] * 4, ("<u8", "<u4", "u1", "<u2")):
            self._put(np.array(column, kind).tobytes())
        self._put(np.array([x or 0 for x, _ in self.docs], "<i8").tobytes())
        self._put(np.array([x is not None for x, _ in self.docs], "u1").tobytes())
        self._put(np.array([n for _, n in self.docs], "<u8").tobytes())
        self.stream.write(FOOTER.pack(at, len(self.docs), self.n_ids, self.crc) + MAGIC)


def parse(data: bytes) -> Iterator[tuple[int | None, int, int, bytes]]:
    """(document id, ids before it in the file, number of ids, ids) of each document of a file."""
    size = FOOTER.size + len(MAGIC)
    at, n_docs, n_ids, crc = FOOTER.unpack_from(data, len(data) - size)
    if not data.startswith(MAGIC) or not data.endswith(MAGIC) or zlib.crc32(memoryview(data)[:-size]) != crc:
        raise ValueError("not a whole token file")
    n_blocks = -(-n_ids // BLOCK)
    columns = []
    for kind, n in (("<u8", n_blocks), ("<u4", n_blocks), ("u1", n_blocks), ("<u2", n_blocks), ("<i8", n_docs), ("u1", n_docs), ("<u8", n_docs)):
        columns.append(np.frombuffer(data, kind, n, at))
        at += columns[-1].nbytes
    start, low, width, n_odd, doc_ids, known, counts = columns
    ids = unpacked(data, start.astype(np.int64), low, width, n_odd).astype("<u4").tobytes()
    begin = 0
    for doc_id, has, n in zip(doc_ids.tolist(), known.tolist(), counts.tolist()):
        yield doc_id if has else None, begin, n, ids[4 * begin : 4 * (begin + n)]
        begin += n


LISTED = "part int, roll int, file string, n_docs long, n_ids long"
MANIFEST = f"{LISTED}, base long"


def ranges(rows: DataFrame) -> np.ndarray:
    """Bounds of the ranges of doc_id: a range has the ids above the bound before it, up to its own."""
    n_bytes = rows.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 4)).first()[0] or 0
    n = min(max(1, -(-n_bytes // TASK)), MOST_TASKS)
    if n == 1:
        return np.empty(0, np.int64)
    shares = [k / n for k in range(1, n)]
    found = rows.agg(F.percentile_approx("doc_id", shares, max(10_000, 10 * n))).first()[0]
    return np.sort(np.array(found or [], np.int64))


def encoded(rows: DataFrame, path: str, end_id: int, bounds: np.ndarray) -> DataFrame:
    """(part, doc_id, at, n, ids) of (doc_id, text): n ids, the end id last, in 16 bits each if all of them fit, else in 32.

    ``part`` is the range of the id. An id that is a bound of several ranges, as one that
    very many rows have, is dealt to all of them in turn. ``at`` numbers a task's rows.
    """
    end = struct.pack("<I", end_id)
    kinds = pa.schema([("part", pa.int32()), ("doc_id", pa.int64()), ("at", pa.int64()), ("n", pa.int64()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, at = tokens.encoder(path, True).encode, count(TaskContext.get().partitionId() << 36)

        def each(batch):
            doc_ids = batch["doc_id"].to_pylist()
            known = np.array([x or 0 for x in doc_ids], np.int64)
            low, high = (np.searchsorted(bounds, known, side).tolist() for side in ("left", "right"))
            for doc_id, a, b, text in zip(doc_ids, low, high, batch["text"]):
                ids, k = np.frombuffer(encode(text.as_py() or "") + end, "<u4"), next(at)
                raw = (ids.astype("<u2") if ids.max() < 1 << 16 else ids).tobytes()
                yield len(raw), (0 if doc_id is None else a + k % (b - a + 1), doc_id, k, len(ids), raw)

        for batch in batches:
            yield from tokens.batched(each(batch), kinds)
        tokens.trim()

    return rows.mapInArrow(run, "part int, doc_id long, at long, n long, ids binary")


def write_tokens(
    docs: DataFrame, folder: str, path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text"
) -> None:
    """Token files of ``docs`` in ``folder``, a URL in a store that executors and driver share."""
    if docs.schema[id_col].dataType.typeName() not in ("byte", "short", "integer", "long"):
        raise TypeError(f"{id_col} is no integer column")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    bounds = ranges(rows)
    dealt = encoded(rows, path, end_id, bounds).repartition(len(bounds) + 1, "part").sortWithinPartitions("part", "doc_id", "at")
    dealt = dealt.select("part", "doc_id", "n", "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = store_of(folder)
        store.create_dir(root, recursive=True)
        done: list[tuple] = []
        writer, name, now, roll = None, "", -1, 0

        def close() -> None:
            writer.close()
            writer.stream.close()
            done.append((now, roll, name, len(writer.docs), writer.n_ids))

        for batch in batches:
            columns = (batch[c].to_pylist() for c in ("part", "doc_id", "n"))
            for part, doc_id, n, ids in zip(*columns, batch["ids"]):
                if writer is not None and (part != now or writer.n_ids >= ROLL):
                    close()
                    writer = None
                if writer is None:
                    now, roll = part, roll + 1 if part == now else 0
                    name = f"{part:06d}-{roll:04d}-{uuid.uuid4().hex}.tkpf"
                    writer = FileWriter(store.open_output_stream(f"{root}/{name}"))
                raw = ids.as_py()
                writer.add(doc_id, raw if len(raw) == 4 * n else np.frombuffer(raw, "<u2").astype("<u4").tobytes())
        if writer is not None:
            close()
        tokens.trim()
        kinds = [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(zip(*done) if done else [()] * 5, kinds)], names=["part", "roll", "file", "n_docs", "n_ids"]
        )

    files = dealt.mapInArrow(run, LISTED)
    files.write.parquet(f"{folder}/files")
    _with_base(docs.sparkSession.read.schema(LISTED).parquet(f"{folder}/files")).write.parquet(f"{folder}/manifest")


def _with_base(files: DataFrame) -> DataFrame:
    """``files`` with the ids before each: by hundreds of tasks first, then within them."""
    group = F.expr("part div 256")
    before = Window.orderBy("g").rowsBetween(Window.unboundedPreceding, -1)
    sums = files.groupBy(group.alias("g")).agg(F.sum("n_ids").alias("n"))  # at most MOST_TASKS / 256 rows
    first = sums.select("g", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    own = Window.partitionBy("g").orderBy("part", "roll").rowsBetween(Window.unboundedPreceding, -1)
    base = (F.col("first") + F.coalesce(F.sum("n_ids").over(own), F.lit(0))).cast("long")
    return files.withColumn("g", group).join(F.broadcast(first), "g").select(*files.columns, base.alias("base"))


def read_tokens(spark: SparkSession, folder: str, digests: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of the documents of a folder; ids are unsigned 32-bit, little-endian.

    With ``digests`` their CRC-32 as ``ids_crc32`` instead of the ids.
    """
    manifest = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    n_files = manifest.count()
    last = ("ids_crc32", "long", pa.int64()) if digests else ("ids", "binary", pa.binary())
    schema = f"doc_id long, start long, n_tokens long, {last[0]} {last[1]}"
    if not n_files:
        return spark.createDataFrame([], schema)
    name = F.element_at(F.split("path", "/"), -1).alias("file")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.tkpf").load(folder).select(name, "content")
    manifest = manifest.select("file", "base")
    files = files.join(F.broadcast(manifest) if n_files <= common.BROADCAST_ROWS else manifest, "file")
    kinds = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), (last[0], last[2])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for base, content in zip(batch["base"], batch["content"]):
                first = base.as_py()
                docs = parse(content.as_py())
                if digests:
                    rows = ((8, (doc_id, first + start, n, zlib.crc32(ids))) for doc_id, start, n, ids in docs)
                else:
                    rows = ((len(ids), (doc_id, first + start, n, ids)) for doc_id, start, n, ids in docs)
                yield from tokens.batched(rows, kinds)
        tokens.trim()

    return files.select("base", "content").mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8: all ``documents`` written to token files and read back from them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    folder = common.new_path(spark, "token_files")
    write_tokens(docs, folder, tokens.public_path("word_bpe_49k.json"), end_id=2)
    return read_tokens(spark, folder, digests=True)
