"""Queries that write and read: binary artifacts, conversion, catalogue, runs, the live fan-out, clocks; and their SQL.

Each writes to a folder of its own in the shared folder. What an operator does on the
driver (rules, schedules of a simulated clock) comes back as a small table.
"""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import functions as F

from .. import clock, errors, schema, shared
from ..functions.columns import artifact_name, utc_day
from ..operators import book, canonical, catalogue, convert, delivery, order, pacing, run
from ..schema import KEY, SNAPSHOT
from ..sources import hotfile, synth, tables
from ..streaming import fanout
from .catalog import _DAY, _EPOCH_SEEN, _PERM, BOUNDS, CAPACITY, EVERY, FROM_TS, RECORDS, SNAPS, SOURCE, SPEED, START, K, _permuted, book_sql, query

BLOCK = 64
_ARTIFACT = f"'venue-' || venue_id || '-' || strftime(DATE '1970-01-01' + CAST({_DAY} AS INT), '%Y-%m-%d') || '.bin' AS artifact"
_LEVELS = "len(bids) + len(asks)"
_FILES = f"""files AS (SELECT {_ARTIFACT}, CAST(venue_id AS BIGINT) AS venue_id, count(*) AS n_records, min(exchange_ts) AS min_ts, max(exchange_ts) AS max_ts,
  (count(*) + {BLOCK - 1}) // {BLOCK} AS n_time, count(*) FILTER (record_type = 2) AS n_snap,
  CAST(coalesce(sum(8 + 16 * ({_LEVELS})) FILTER (record_type = 2), 0) AS BIGINT) AS blob_len FROM snaps GROUP BY ALL)"""


def _exported(spark, sf):
    folder = shared.new_path(spark, "artifacts")
    hotfile.export(tables.with_snapshots(spark, sf), folder, block=BLOCK)
    return folder


def _plain(records):
    levels = F.concat(F.coalesce("bids", F.array().cast(schema.LEVELS)), F.coalesce("asks", F.array().cast(schema.LEVELS)))
    return records.select(
        "exchange_ts", "venue_id", F.col("sequence_number").cast("long").alias("sequence_number"), "instrument_id",
        "record_type", "side_flags", "price", "size", F.coalesce(F.size("bids"), F.lit(0)).cast("long").alias("n_bids"),
        F.size(levels).cast("long").alias("n_levels"), F.aggregate(levels, F.lit(0).cast("long"), lambda a, x: a + x["price"] * x["size"]).alias("weight"),
    )


_PLAIN = f"""SELECT {K}, record_type, side_flags, price, size, CAST(coalesce(len(bids), 0) AS BIGINT) AS n_bids, CAST(coalesce({_LEVELS}, 0) AS BIGINT) AS n_levels,
  CAST(coalesce(list_sum(list_transform(list_concat(bids, asks), lambda x: x.price * x.size)), 0) AS BIGINT) AS weight FROM snaps"""


@query("hotfile_round_trip", f"WITH {SNAPS} {_PLAIN}")
def _(spark, sf):
    """S-02, S-08, W-01, W-02, W-03, W-13, W-14, S-05, P-01, P-02, S-04b, M-15, V-09: records through binary artifacts."""
    return _plain(hotfile.read(spark, _exported(spark, sf), blocks=2))


@query("hotfile_seek", f"WITH {SNAPS} {_PLAIN} WHERE exchange_ts >= {FROM_TS}")
def _(spark, sf):
    """S-09, M-06, M-09: blocks before a time are left out by the index; a filter takes the rest of the first one."""
    found = hotfile.read(spark, _exported(spark, sf), from_ts=FROM_TS)
    return _plain(found.where(F.col("exchange_ts") >= FROM_TS))


_NUMBERS = ("version", "venue_id", "n_records", "min_ts", "max_ts", "header_size", "block_size", "n_time", "n_snap", "blob_len")


@query("hotfile_headers", f"""WITH {SNAPS}, {_FILES} SELECT artifact, 1::BIGINT AS version, venue_id, n_records, min_ts, max_ts, 4096::BIGINT AS header_size, {BLOCK}::BIGINT AS block_size,
  n_time, n_snap, blob_len, 4096 + 64 * n_records + blob_len + 20 * n_time + 8 * n_snap AS file_size, true AS whole FROM files""")
def _(spark, sf):
    """S-13, S-14, S-15, W-04, W-15, W-16, W-17, W-18, V-04, V-09b, V-09c, V-10, V-11, V-12, V-13: whole files, header by header."""
    found = hotfile.inspect(spark, _exported(spark, sf))
    return found.select("artifact", *_NUMBERS, "file_size", F.col("fault").isNull().alias("whole"))


#: A byte that is flipped, and what the check of the file says.
_DAMAGE = {
    "magic": (0, "BadMagic"), "field": (16, "HeaderChecksum"), "header checksum": (124, "HeaderChecksum"), "after the fields": (130, "ReservedSet"),
    "finalized": (120, "NotFinalized"), "record": (4096 + 8, "BlockChecksum"), "first time": (4096, "HeaderRange"), "footer": (-1, "TrailerChecksum"),
}


@query("hotfile_damage", f"""WITH {SNAPS}, {_FILES}, d AS (SELECT * FROM (VALUES {", ".join(f"('{k}', '{v}')" for k, (_, v) in _DAMAGE.items())}) t(damage, fault))
SELECT artifact, damage, fault FROM files CROSS JOIN d""")
def _(spark, sf):
    """S-13, S-14, V-09, V-10, V-11, V-12, V-13: every artifact with every kind of damage."""
    return hotfile.inspect(spark, _exported(spark, sf), {k: at for k, (at, _) in _DAMAGE.items()}).select("artifact", "damage", "fault")


@query("artifact_sidecars", f"WITH {SNAPS}, {_FILES} SELECT artifact, true AS recorded, 64::BIGINT AS n_hex FROM files")
def _(spark, sf):
    """W-06, S-19, S-20: the recorded digest of each artifact is that of its bytes."""
    folder = _exported(spark, sf)
    name = F.element_at(F.split("path", "/"), -1).alias("artifact")
    stated = catalogue.dataset_identity(spark, folder).select(name, F.col("hash").alias("stated"))
    own = catalogue.artifact_hashes(spark, folder).select(name, "hash")
    return own.join(stated, "artifact").select("artifact", (F.col("hash") == F.col("stated")).alias("recorded"), F.length("stated").cast("long").alias("n_hex"))


def _source(records):
    """Records as source rows in their total order; every delta sets a size, so that no removal misses its level."""
    def side(column, number):
        return F.transform(F.coalesce(column, F.array().cast(schema.LEVELS)), lambda x: F.struct(F.lit(number).cast("long").alias("side"), x["price"].alias("price"), x["size"].alias("size")))

    snap = F.col("record_type") == SNAPSHOT
    return order.with_emit_index(records).select(
        F.col("emit_index").alias("row_index"), "exchange_ts", F.col("sequence_number").cast("decimal(20,0)").alias("sequence_number"), "instrument_id",
        *(F.col(c).cast("long").alias(c) for c in ("venue_id", "record_type", "side_flags")), "price",
        F.when(snap, F.col("size")).otherwise(F.col("size") + 1).alias("size"), F.concat(side("bids", 0), side("asks", 1)).alias("levels"),
    )


@query("convert_replay", f"""WITH RECURSIVE {SNAPS}, {BOUNDS}, {_EPOCH_SEEN}, every AS (SELECT {K}, record_type FROM snaps UNION ALL
  SELECT exchange_ts, venue_id, last_seq + row_number() OVER (PARTITION BY venue_id, epoch ORDER BY instrument_id), instrument_id, 2 FROM seen)
SELECT {K}, record_type, row_number() OVER (ORDER BY {K}) - 1 AS emit_index FROM every""")
def _(spark, sf):
    """S-01, W-01, W-13, W-14, M-17, V-01, V-03, V-05, V-06, B-10, B-12, M-04: source rows checked, given epochs, written by venue and day, and replayed."""
    folder = shared.new_path(spark, "converted")
    convert.write(convert.converted(_source(tables.with_snapshots(spark, sf)), EVERY), folder)
    back = convert.replay(spark, folder)
    return back.select("exchange_ts", "venue_id", F.col("sequence_number").cast("long").alias("sequence_number"), "instrument_id", "record_type", "emit_index")


@query("convert_rejected", f"WITH {SOURCE} SELECT row_index, reject AS fault, 0::BIGINT AS files_left FROM rejects WHERE reject IS NOT NULL ORDER BY row_index LIMIT 1")
def _(spark, sf):
    """W-04, W-05, M-17, V-01: a rejected conversion names its first bad row and leaves nothing."""
    folder = shared.new_path(spark, "rejected")
    try:
        convert.write(convert.converted(tables.source_rows(spark, sf), EVERY), folder)
        row = (None, None)
    except errors.RowError as e:
        row = (e.row, e.kind.__name__)
    from pyarrow import fs

    store, at = shared.store_of(folder)
    left = store.get_file_info(fs.FileSelector(at, allow_not_found=True, recursive=True))
    return spark.createDataFrame([(*row, len(left))], "row_index long, fault string, files_left long")


@query("convert_order_faults", f"""WITH {RECORDS}, {_PERM}, r AS (SELECT *, row_number() OVER (ORDER BY position, sequence_number) - 1 AS row_at FROM permuted),
l AS (SELECT *, row(exchange_ts, venue_id, sequence_number, instrument_id) AS k, lag(row(exchange_ts, venue_id, sequence_number, instrument_id)) OVER v AS b,
  max(exchange_ts) OVER (PARTITION BY venue_id ORDER BY row_at ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM r WINDOW v AS (PARTITION BY venue_id ORDER BY row_at))
SELECT row_at AS row_index, CASE WHEN exchange_ts < m THEN 'ExchangeTsDecreased' WHEN k = b THEN 'DuplicateKey' ELSE 'OutOfOrder' END AS fault FROM l WHERE exchange_ts < m OR k <= b ORDER BY row_at LIMIT 1""")
def _(spark, sf):
    """V-05, V-06: the first row that goes back in time, or repeats or lowers a key."""
    rows = _permuted(spark, sf).withColumn("place", F.struct("position", "sequence_number"))
    try:
        convert.check_order(rows, "place")
        found = (None, None)
    except errors.RowError as e:
        before = rows.where((F.col("position") < e.row[0]) | ((F.col("position") == e.row[0]) & (F.col("sequence_number") < e.row[1])))
        found = (before.count(), e.kind.__name__)
    return spark.createDataFrame([found], "row_index long, fault string")


def _blamed(call) -> str | None:
    try:
        call()
    except errors.TapeError as e:
        return type(e).__name__ if not isinstance(e, errors.RowError) else e.kind.__name__
    return None


_ONE = {"exchange_ts": 5, "sequence_number": 1, "instrument_id": 1, "venue_id": 7, "record_type": 0, "side_flags": 0, "price": 1, "size": 1}
_WRITES = {
    "good": ([_ONE, _ONE | {"exchange_ts": 6}], {}, None), "same key": ([_ONE, _ONE], {}, "DuplicateKey"),
    "earlier": ([_ONE, _ONE | {"exchange_ts": 4}], {}, "OutOfOrder"), "other venue": ([_ONE | {"venue_id": 8}], {}, "VenueMismatch"),
    "snapshot with a price": ([_ONE | {"record_type": 2}], {}, "UnusedFieldSet"), "no such type": ([_ONE | {"record_type": 3}], {}, "RecordType"),
    "no scale": ([_ONE], {"price_scale": 0}, "PriceScale"), "no block": ([_ONE], {"block": 0}, "BlockSize"), "odd page": ([_ONE], {"page": 100}, "HeaderSize"),
}


def _values(rows, columns) -> str:
    def literal(x):
        return "NULL" if x is None else f"'{x}'" if isinstance(x, str) else str(x).lower() if isinstance(x, bool) else str(x)

    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(literal, r)) + ')' for r in rows)}) t({columns})"


@query("writer_faults", _values([(k, v[2]) for k, v in _WRITES.items()], "written, fault"))
def _(spark, sf):
    """W-02, W-03, W-16, V-03, V-12: what a writer refuses."""
    rows = [(k, _blamed(lambda r=r, o=o: hotfile.encode(r, 7, **o))) for k, (r, o, _) in _WRITES.items()]
    return spark.createDataFrame(rows, "written string, fault string")


def _source_schema(**change):
    fields = dict(schema._FIELDS) | {"levels": pa.list_(pa.struct(list(schema._LEVEL.items())))} | change
    return pa.schema([(k, v) for k, v in fields.items() if v is not None])


_SCHEMAS = {
    "exact": ({}, None), "missing": ({"price": None}, "price"), "signed": ({"sequence_number": pa.int64()}, "sequence_number"),
    "more": ({"received": pa.int64()}, "received"), "first of two": ({"exchange_ts": None, "size": pa.int32()}, "exchange_ts"), "flat levels": ({"levels": pa.int64()}, "levels"),
    "levels without a size": ({"levels": pa.list_(pa.struct(list(schema._LEVEL.items())[:2]))}, "levels.size"),
}


@query("source_files", _values([(k, v, None if v else 2) for k, (_, v) in _SCHEMAS.items()], "kind, blamed, n_rows"))
def _(spark, sf):
    """S-06, S-07: source files by their footers: the field that is wrong, or the number of rows."""
    import pyarrow.parquet as pq

    folder, rows = shared.new_path(spark, "sources"), []
    store, at = shared.store_of(folder)
    store.create_dir(at, recursive=True)
    for k, (change, _) in _SCHEMAS.items():
        own = _source_schema(**change)
        with store.open_output_stream(f"{at}/{len(rows)}.parquet") as f:
            pq.write_table(pa.Table.from_arrays([pa.nulls(2, x.type) for x in own], schema=own), f)
        try:
            rows.append((k, None, schema.check_source_file(f"{folder}/{len(rows)}.parquet")))
        except errors.named("SourceSchema") as e:
            rows.append((k, str(e).split(":")[0], None))
    return spark.createDataFrame(rows, "kind string, blamed string, n_rows int")


@query("venue_streams", f"WITH {RECORDS}, v AS (SELECT DISTINCT venue_id FROM records) SELECT 'each' AS streams, string_agg(venue_id, ',' ORDER BY venue_id) AS found FROM v UNION ALL VALUES ('one twice', 'DuplicateVenue'), ('all in one', 'VenueMismatch'), ('none', 'NoVenues')")
def _(spark, sf):
    """V-07, V-08, M-14: streams of one venue each, no venue in two of them."""
    every = tables.records(spark, sf)
    each = [every.where(F.col("venue_id") == v) for v in (1, 2, 3, 4)]
    rows = [("each", ",".join(map(str, order.check_venues(each))))]
    for name, streams in (("one twice", [each[0], each[0]]), ("all in one", [every])):
        rows.append((name, _blamed(lambda s=streams: order.check_venues(s))))
    rows.append(("none", _blamed(lambda: order.merge([]))))
    return spark.createDataFrame(rows, "streams string, found string")


@query("book_folds", f"WITH {SNAPS}, {book_sql('9223372036854775807')} SELECT * FROM book")
def _(spark, sf):
    """B-01, B-02, B-03, B-04, B-04b, B-04c, B-07, B-08, B-10: books by applying record after record."""
    return book.folded(tables.with_snapshots(spark, sf), strict=False)


@query("digest_partitions", f"WITH {SNAPS} SELECT kind, count(*) AS n_records, 1::BIGINT AS n_digests FROM snaps CROSS JOIN (VALUES ('crc32c'), ('sha256 tree')) t(kind) GROUP BY kind")
def _(spark, sf):
    """A-01, A-02, A-03: one digest, however the stream is dealt."""
    every = tables.with_snapshots(spark, sf)
    crc = {canonical.digest(every, n) for n in (1, 3, 16)}
    tree = {canonical.tree_digest(every.repartition(n), leaf=1000, node=4) for n in (1, 7)}
    rows = [(kind, found.copy().pop()[1], len(found)) for kind, found in (("crc32c", crc), ("sha256 tree", tree))]
    return spark.createDataFrame(rows, "kind string, n_records long, n_digests long")


@query("synthetic_venues", _values([(v, sum(days)) for v, days in synth.STANDARD.items() if days], "venue_id, n_records"))
def _(spark, sf):
    """S-12: the synthetic venues; their order has no fault."""
    made = synth.build(spark)
    return order.checked(order.with_position(made), "position").groupBy("venue_id").agg(F.count("*").cast("int").alias("n_records"))


# catalogue


@query("runs_catalogue", """SELECT 'run-' || n_nationkey AS run_id, sha256(n_name || '.bin' || chr(9) || n_regionkey || chr(10)) AS dataset_hash, CAST(n_nationkey * 10 AS BIGINT) AS emit_index_at_end,
  n_name AS canonical_hash, CAST(n_regionkey + 5 AS BIGINT) AS elapsed_nanos, 'DuplicateRun' AS again, 25::BIGINT AS n_rows FROM nation""")
def _(spark, sf):
    """S-10, W-07, W-08, W-10: manifests written as files, taken into the table of runs; a second time, none is."""
    folder, table = shared.new_path(spark, "manifests"), f"runs_{uuid.uuid4().hex}"
    store, at = shared.store_of(folder)
    store.create_dir(at, recursive=True)
    for n in spark.read.parquet(f"{sf}/nation.parquet").collect():  # 25 rows
        manifest = {
            "dataset": [{"path": f"{n.n_name}.bin", "hash": str(n.n_regionkey)}], "config": {"workers": 1},
            "result": {"emit_index_at_end": n.n_nationkey * 10, "pacing_slip_nanos": 0, "canonical_hash": n.n_name},
            "timing": {"started_unix_nano": 1, "ended_unix_nano": n.n_regionkey + 6, "elapsed_nanos": n.n_regionkey + 5},
        }
        with store.open_output_stream(f"{at}/run-{n.n_nationkey}.json") as f:
            f.write(catalogue.manifest_json(manifest).encode())
    with store.open_output_stream(f"{at}/notes.txt") as f:
        f.write(b"{}")
    catalogue.create_tables(spark, runs=table)
    catalogue.ingest_manifests(spark, folder, table)
    again = _blamed(lambda: catalogue.ingest_manifests(spark, folder, table))
    rows = spark.table(table).select("run_id", "dataset_hash", "emit_index_at_end", "canonical_hash", "elapsed_nanos")
    out = rows.withColumn("again", F.lit(again)).withColumn("n_rows", F.lit(rows.count()).cast("long"))
    return _kept(spark, out, table)


def _kept(spark, rows, table):
    """A copy of the rows of a table that is dropped."""
    out = shared.written(rows, "rows")
    spark.sql(f"DROP TABLE {table}")
    spark.sql(f"DROP TABLE IF EXISTS {'benchmarks' if table.startswith('runs_') else 'runs'}_of_{table}")
    return out


@query("benchmarks_catalogue", """SELECT 'BenchmarkRegion' || n_regionkey AS name, 'abc' AS git_commit, CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS INT) AS sample,
  CAST(n_nationkey + 1 AS BIGINT) AS iterations, n_nationkey * 1.5::DOUBLE AS ns_per_op, CAST(n_nationkey * 8 AS BIGINT) AS bytes_per_op, CAST(n_regionkey AS BIGINT) AS allocs_per_op,
  'DuplicateBenchmark' AS again, 'line 2: MissingMetric' AS broken FROM nation""")
def _(spark, sf):
    """S-11, W-09, W-10: a text of measurements taken into the table of benchmarks as a whole or not at all."""
    folder, table = shared.new_path(spark, "benchmarks"), f"benchmarks_{uuid.uuid4().hex}"
    store, at = shared.store_of(folder)
    store.create_dir(at, recursive=True)
    nations = sorted(tuple(r) for r in spark.read.parquet(f"{sf}/nation.parquet").select("n_nationkey", "n_regionkey").collect())  # 25 rows
    lines = ["goos: linux", *(f"BenchmarkRegion{r}-8 \\t {n + 1} \\t {n * 1.5} ns/op \\t {n * 8} B/op \\t {r} allocs/op" for n, r in nations), "PASS"]
    for name, text in (("good", lines), ("bad", [*lines[:1], "BenchmarkX-8 5 3 ns/op 1 B/op", *lines[1:]])):
        with store.open_output_stream(f"{at}/{name}.txt") as f:
            f.write("\n".join(text).replace("\\t", "\t").encode())
    catalogue.create_tables(spark, runs=f"runs_of_{table}", benchmarks=table)
    try:
        catalogue.ingest_benchmarks(spark, f"{folder}/bad.txt", "abc", table)
        broken = ""
    except errors.LineError as e:
        broken = str(e)
    catalogue.ingest_benchmarks(spark, f"{folder}/good.txt", "abc", table)
    again = _blamed(lambda: catalogue.ingest_benchmarks(spark, f"{folder}/good.txt", "abc", table))
    rows = spark.table(table).drop("recorded_unix_nano")
    return _kept(spark, rows.withColumns({"again": F.lit(again), "broken": F.lit(broken)}), table)


# runs and delivery


@query("run_manifest", f"""WITH {RECORDS} SELECT count(*) AS emit_index_at_end, 'block 1, drop 2' AS modes, 'beginning 1, live 1, emit_index 1' AS starts, '2/1' AS speed,
  'SpeedMismatch' AS other_speed, 'Closed' AS after_the_end, true AS has_digest, 8::BIGINT AS digest_length FROM records""")
def _(spark, sf):
    """S-18, W-07, D-02, D-22, D-22b, D-22c, D-25, D-26, A-06: a run with three subscribers, and its manifest."""
    sim = clock.SimClock(10)
    own = run.Run(tables.records(spark, sf), run.Config(delivery.Ring(CAPACITY)), sim)
    for mode, request in (("block", {"beginning": True}), ("drop", {"live": True}), ("drop", {"emit_index": 7})):
        own.attach(mode, run.parse_start(request), pacing.Speed(4, 2))
    other = _blamed(lambda: own.attach("drop", delivery.live(), pacing.Speed(3)))
    sim.advance(5)
    folder = shared.new_path(spark, "run")
    store, at = shared.store_of(folder)
    store.create_dir(at, recursive=True)
    m = own.write_manifest(f"{folder}/run.json")
    after = _blamed(lambda: own.attach("drop", delivery.live(), pacing.Speed(2)))
    n, who, digest = m["result"]["emit_index_at_end"], m["subscribers"], m["result"]["canonical_hash"]
    row = (
        n, f"block {who['block']}, drop {who['drop']}", ", ".join(f"{k} {who['start_' + k]}" for k in ("beginning", "live", "emit_index")),
        f"{m['config']['speed_num']}/{m['config']['speed_den']}", other, after, bool(digest), len(digest),
    )
    kinds = "emit_index_at_end long, modes string, starts string, speed string, other_speed string, after_the_end string, has_digest boolean, digest_length long"
    return spark.createDataFrame([row], kinds)


@query("paced_delivery", f"""WITH {RECORDS}, b AS (SELECT min(exchange_ts) AS base, max(exchange_ts) AS top, count(*) AS n FROM records)
SELECT n AS delivered, true AS in_order, CAST({START} + (CAST(top - base AS HUGEINT) * {SPEED.den}) // {SPEED.num} AS BIGINT) AS ended_at FROM b""")
def _(spark, sf):
    """W-11, D-17, D-18, D-19, T-03, T-05, T-07, M-12: the stream as a client pulls it, paced by a simulated clock."""
    sim = clock.SimClock(START)
    own = run.Run(tables.records(spark, sf), run.Config(delivery.Ring(CAPACITY)), sim)
    cursor = own.attach("block", delivery.beginning(), SPEED)
    n, last, good = 0, None, True
    for row in own.deliver(cursor, paced=True):
        now = tuple(row[k] for k in KEY)
        good, last, n = good and row["emit_index"] == n and (last is None or last < now), now, n + 1
    return spark.createDataFrame([(n, good, sim.now())], "delivered long, in_order boolean, ended_at long")


@query("status_codes", _values([("ModeUnset", "INVALID_ARGUMENT"), ("StartUnset", "INVALID_ARGUMENT"), ("InvalidSpeed", "INVALID_ARGUMENT"), ("StartLapped", "OUT_OF_RANGE"), ("Closed", "FAILED_PRECONDITION"), ("SpeedMismatch", "FAILED_PRECONDITION"), ("Canceled", "ABORTED"), ("Evicted", "ABORTED"), ("BlockChecksum", "INTERNAL"), ("two starts", "INVALID_ARGUMENT"), ("no mode", "INVALID_ARGUMENT"), ("half a ring", "INTERNAL"), ("no blobs", "INTERNAL")], "failure, code"))
def _(spark, sf):
    """D-01, D-23, D-24, D-25, D-26: what a client is told."""
    rows = [(k, run.status_code(errors.named(k)(""))) for k in ("ModeUnset", "StartUnset", "InvalidSpeed", "StartLapped", "Closed", "SpeedMismatch", "Canceled", "Evicted", "BlockChecksum")]
    calls = {
        "two starts": lambda: run.parse_start({"live": True, "beginning": True}), "no mode": lambda: delivery.parse_mode(None),
        "half a ring": lambda: delivery.Ring(3), "no blobs": lambda: delivery.Ring(2, -1),
    }
    for name, call in calls.items():
        rows.append((name, run.status_code(errors.named(_blamed(call))(""))))
    return spark.createDataFrame(rows, "failure string, code string")


_HALF = f"h AS (SELECT count(*) AS n, count(*) FILTER (exchange_ts < {FROM_TS}) AS half FROM records)"


@query("fanout_subscribers", f"""WITH {RECORDS}, {_HALF}, g AS (SELECT n, half, greatest(0, half - {CAPACITY}) AS oldest, 5 + {CAPACITY} * ((n - 6) // {CAPACITY}) AS held FROM h)
SELECT 'all' AS subscriber, 'ended' AS state, n AS received, 0::BIGINT AS gaps, 0::BIGINT AS missed, n AS cursor FROM g
UNION ALL SELECT 'stalled', 'running', n - held, CASE WHEN held > 5 THEN 1 ELSE 0 END, held - 5, n FROM g
UNION ALL SELECT 'retained', 'ended', n - oldest, 0, 0, n FROM g
UNION ALL SELECT 'from a time', 'ended', n - half, 0, 0, n FROM g
UNION ALL SELECT 'too late', CASE WHEN oldest > 0 THEN 'lapped' ELSE 'ended' END, CASE WHEN oldest > 0 THEN 0 ELSE n END, 0, 0, CASE WHEN oldest > 0 THEN 0 ELSE n END FROM g
UNION ALL SELECT 'left', 'canceled', 0, 0, 0, n FROM g UNION ALL SELECT 'after the end', 'Closed', 0, 0, 0, 0 FROM g""")
def _(spark, sf):
    """D-02, D-03a-d, D-04, D-05, D-06, D-07, D-09, D-11 to D-17, D-20, D-21c-e, W-11: the ring, live: every start, a lapped reader, leaves and late joins."""
    every = tables.records(spark, sf)
    ring = delivery.Ring(CAPACITY)
    fan = fanout.FanOut(clock.RealClock(), ring=ring)

    def sink(df):
        df.agg(F.max("emit_index")).collect()

    def sub(name, mode, start, deliver=sink):
        out.append(s := fanout.Subscriber(name, mode, deliver, start))
        fan.subscribe(s)
        return s

    out: list[fanout.Subscriber] = []
    sub("all", "block", delivery.beginning())
    stalled = sub("stalled", "drop", 5, None)
    fan.on_batch(every.where(F.col("exchange_ts") < FROM_TS), 0)
    half = fan.written
    sub("retained", "block", ring.oldest(half))
    sub("from a time", "block", delivery.exchange_ts(FROM_TS))
    sub("too late", "block", delivery.beginning())
    fan.on_batch(every.where(F.col("exchange_ts") >= FROM_TS), 1)
    gone = sub("left", "drop", delivery.live(), None)
    fan.on_batch(every.limit(0), 2)
    fan.unsubscribe(gone)
    fan.end()
    while fan.read(stalled) is not None:
        pass
    rows = [(s.name, s.state, s.received, len(s.gaps), sum(n for *_, n in s.gaps), s.cursor) for s in out]
    rows.append(("after the end", _blamed(lambda: fan.subscribe(fanout.Subscriber("x", "drop"))), 0, 0, 0, 0))
    return spark.createDataFrame(rows, "subscriber string, state string, received long, gaps long, missed long, cursor long")


@query("fanout_watchdog", f"""WITH {RECORDS}, h AS (SELECT count(*) AS n FROM records) SELECT 'stuck' AS subscriber, CASE WHEN n > {CAPACITY} THEN 'evicted' ELSE 'running' END AS state, CASE WHEN n > {CAPACITY} THEN 10 ELSE 0 END::BIGINT AS slip,
  n AS written, CASE WHEN n > {CAPACITY} THEN 18446744073709551615::HUGEINT ELSE 0 END::VARCHAR AS min_cursor FROM h""")
def _(spark, sf):
    """A-09, D-09, D-10, D-20, D-21e, T-12: a block subscriber that takes nothing is evicted when the ring is full, and the writer goes on."""
    sim = clock.SimClock()
    fan = fanout.FanOut(sim, watchdog_nanos=10, ring=delivery.Ring(CAPACITY))
    stuck = fanout.Subscriber("stuck", "block", None, 0)
    fan.subscribe(stuck)
    fan.on_batch(tables.records(spark, sf), 0)
    rows = [("stuck", stuck.state, fan.slip, fan.written, str(fan.min_block_cursor()))]
    fan.end()
    return spark.createDataFrame(rows, "subscriber string, state string, slip long, written long, min_cursor string")


# clocks


@query("pacer_releases", f"""WITH {RECORDS}, t AS (SELECT DISTINCT exchange_ts FROM records), b AS (SELECT min(exchange_ts) AS base FROM t)
SELECT exchange_ts, CAST({START} + (CAST(exchange_ts - base AS HUGEINT) * {SPEED.den}) // {SPEED.num} AS BIGINT) AS released_at, 0::BIGINT AS slip FROM t CROSS JOIN b""")
def _(spark, sf):
    """T-02, T-03, T-05, T-06, T-09, T-10, T-12, T-15, T-16: when a simulated pacer lets each timestamp go."""
    pacer = pacing.Pacer(clock.SimClock(START), SPEED, window=0)
    rows = []
    for (ts,) in tables.records(spark, sf).select("exchange_ts").distinct().orderBy("exchange_ts").toLocalIterator():
        pacer.wait(ts)
        rows.append((ts, pacer.clock.now(), pacer.slip))
    return spark.createDataFrame(rows, "exchange_ts long, released_at long, slip long")


@query("timer_order", """WITH t AS (SELECT n_nationkey AS timer, CASE WHEN n_nationkey % 5 = 0 THEN 3 ELSE n_regionkey * 10 END AS deadline FROM nation WHERE n_nationkey % 7 <> 0)
SELECT timer, CAST(deadline AS BIGINT) AS fired_at, CAST(row_number() OVER (ORDER BY deadline, timer) - 1 AS INT) AS place FROM t""")
def _(spark, sf):
    """T-09, T-10, T-13, T-14: timers by (deadline, registration); some stopped, some set anew, those without a delay at once."""
    sim, fired, timers = clock.SimClock(), [], []
    for k, region in sorted(tuple(r) for r in spark.read.parquet(f"{sf}/nation.parquet").select("n_nationkey", "n_regionkey").collect()):  # 25 rows
        timer = sim.timer(1000, lambda t, k=k: fired.append((k, t)))
        timers.append(timer)
        if k % 7 == 0:
            timer.stop()
        else:
            timer.reset(3 if k % 5 == 0 else region * 10)
    sim.advance(100)
    return spark.createDataFrame([(k, t, i) for i, (k, t) in enumerate(fired)], "timer int, fired_at long, place int")


@query("names_and_days", f"WITH {SNAPS} SELECT {_ARTIFACT}, count(*) AS n FROM snaps GROUP BY ALL")
def _(spark, sf):
    """P-04, P-05, W-01, S-08: the artifacts that an export makes, and the records that are read back from each."""
    folder = _exported(spark, sf)
    back = hotfile.read(spark, folder)
    return back.groupBy(artifact_name(F.col("venue_id"), utc_day(F.col("exchange_ts"))).alias("artifact")).agg(F.count("*").alias("n"))
