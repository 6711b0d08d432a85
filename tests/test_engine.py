import json
import random
import struct

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.helpers import BASE, WARM, frame, rec, session, snap
from ticktide import clock, errors, schema
from ticktide.functions import columns, crc32c
from ticktide.operators import book, canonical, catalogue, convert, delivery, epoch, order, pacing, validate
from ticktide.sources import hotfile, synth, tables


def kind(name):
    return errors.named(name)


# order


@pytest.mark.parametrize("seed", [1, 7, 99])
def test_merge_equals_a_sort(spark, seed):
    rnd = random.Random(seed)
    venues = []
    for v in range(1, 6):
        ts, rows = v * 7, []
        for q in range(rnd.choice([0, 1, 40])):
            ts += rnd.randint(0, 3)
            rows.append(rec(ts, q, rnd.randint(0, 3), v))
        venues.append(rows)
    want = sorted(((r[0], r[3], r[1], r[2]) for rows in venues for r in rows))
    for parts, slices in ((1, 1), (7, 16), (3, 4096)):
        merged = order.merge([frame(spark, rows) for rows in venues]).repartition(parts)
        got = order.with_emit_index(merged, slices).orderBy("emit_index").collect()
        assert [r.emit_index for r in got] == list(range(len(want)))
        assert [(r.exchange_ts, r.venue_id, int(r.sequence_number), r.instrument_id) for r in got] == want


def test_large_sequence_numbers_and_empty(spark):
    got = order.with_emit_index(frame(spark, [rec(5, 2**64 - 1, 1), rec(5, 2**63, 1), rec(5, 1, 1)])).orderBy("emit_index")
    assert [int(r.sequence_number) for r in got.collect()] == [1, 2**63, 2**64 - 1]
    assert order.with_emit_index(frame(spark, [])).count() == 0


@pytest.mark.parametrize("slices", [1, 16, 64, 4096])
def test_crowded_and_extreme_times(spark, slices):
    times = [-(2**63), -1, 0, 1, *(BASE + i // 4 * 10**9 for i in range(400)), 2**62, 2**63 - 1]
    times += [s * order.SLOT + d for s in (-2, -1, 1, 2) for d in (-1, 0, 1)]
    random.Random(2).shuffle(times)
    rows = frame(spark, [rec(t, i, 1) for i, t in enumerate(times)])
    got = order.with_emit_index(rows, slices).orderBy("emit_index").collect()
    assert [r.emit_index for r in got] == list(range(len(times)))
    assert [r.exchange_ts for r in got] == sorted(times)


def test_ordered_stream(spark):
    records = synth.build(spark)
    rows = [tuple(r[k] for k in schema.KEY) for r in order.ordered(records, 5).toLocalIterator()]
    assert rows == sorted(rows) and len(rows) == sum(map(sum, synth.STANDARD.values()))


def test_venue_checks(spark):
    one, two = frame(spark, [rec(1, 1, 1, 3)]), frame(spark, [rec(1, 1, 1, 3), rec(2, 2, 1, 4)])
    assert order.check_venues([one]) == [3]
    with pytest.raises(kind("DuplicateVenue")):
        order.check_venues([one, one])
    with pytest.raises(kind("VenueMismatch")):
        order.check_venues([two])
    with pytest.raises(kind("NoVenues")):
        order.merge([])


def test_order_checks(spark):
    rows = [rec(10, 1, 1), rec(10, 1, 1), rec(9, 5, 1), rec(11, 1, 1)]
    placed = frame(spark, rows).withColumn("at", F.monotonically_increasing_id()).coalesce(1)
    placed = spark.createDataFrame([(*r[:4], i) for i, r in enumerate(rows)], "exchange_ts long, sequence_number long, instrument_id long, venue_id int, at int")
    got = {(r["at"], r["kind"]) for r in order.order_violations(placed, "at").collect()}
    assert got == {(1, "DuplicateKey"), (2, "OutOfOrder")}
    assert [r["at"] for r in order.ts_decreases(placed, "at").collect()] == [2]
    with pytest.raises(kind("DuplicateKey")):
        order.checked(placed, "at")


@pytest.mark.parametrize(("ts", "at"), [(5, 0), (10, 0), (11, 1), (20, 1), (21, 9), (30, 9), (31, 11), (50, 12), (51, 13)])
def test_seek(spark, ts, at):
    times = [10, *[20] * 8, 30, 30, 40, 50]
    rows = [snap(t, i, 1) if i in (2, 9) else rec(t, i, 1, size=1) for i, t in enumerate(times)]
    got = order.seek_index(frame(spark, rows), ts).first()
    assert got.seek_index == at
    data = hotfile.encode([dict(zip(schema.KEY[:0] + ("exchange_ts", "sequence_number", "instrument_id", "venue_id", "record_type", "side_flags", "price", "size", "bids", "asks"), r)) for r in rows], 7, block=4)
    file = hotfile.HotFile(data)
    assert file.seek(ts) == at
    assert [file.snapshot_before(k) for k in (0, 1, 2, 5, 9, 12, -1)] == [None, None, 2, 2, 9, 9, None]
    placed = order.snapshot_before(order.with_position(frame(spark, rows))).orderBy("position").collect()
    assert [placed[k].snapshot_before for k in (0, 1, 2, 5, 9, 12)] == [None, None, 2, 2, 9, 9]


@pytest.mark.parametrize("step", [1, 7, 1 << 18])
def test_slices_carry_what_came_before(spark, step, monkeypatch):
    """Every operator that looks back in a venue gives the same, however its stream is cut."""
    monkeypatch.setattr(order, "STEP", step)
    rnd, rows = random.Random(11), []
    for venue in (3, 4, 9):
        for q in range(60 if venue < 9 else 1):
            ts = BASE + q // 2 * 10 + (rnd.choice([0, -30]) if q % 9 == 8 else 0)
            rows.append(snap(ts, q, 1, venue=venue) if q % 11 in (4, 5, 6) else rec(ts, q, q % 3, venue, size=1))
    rows += [rows[5], rows[40]]
    rnd.shuffle(rows)
    placed = frame(spark, rows).coalesce(1).withColumn("at", F.monotonically_increasing_id())
    own = [r.asDict(recursive=True) for r in placed.orderBy("at").collect()]

    def k(r):
        return tuple(r[c] for c in schema.KEY)

    wrong, decreased, seen = set(), set(), {}
    for r in own:
        before, top = seen.get(r["venue_id"], (None, None))
        if before is not None and k(r) <= before:
            wrong.add((r["at"], "DuplicateKey" if k(r) == before else "OutOfOrder"))
        if top is not None and r["exchange_ts"] < top:
            decreased.add((r["at"], top))
        seen[r["venue_id"]] = (k(r), max(top or r["exchange_ts"], r["exchange_ts"]))
    assert {(r["at"], r["kind"]) for r in order.order_violations(placed, "at").collect()} == wrong and wrong
    assert {(r["at"], r["earlier_max"]) for r in order.ts_decreases(placed, "at").collect()} == decreased and decreased
    streams = {}
    for r in sorted(own, key=k):
        streams.setdefault(r["venue_id"], []).append(r)
    want, runs = set(), set()
    for v, stream in streams.items():
        last, run = None, None
        for p, r in enumerate(stream):
            if r["record_type"] == 2:
                run = (run[0] if run and last == p - 1 else p, p)
                if p + 1 == len(stream) or stream[p + 1]["record_type"] != 2:
                    runs.add((v, *run, run[1] - run[0] + 1))
                last = p
            else:
                run = None
            want.add((v, p, last))
    monkeypatch.setattr(order, "SLOT", 1 << 6)
    in_place = order.with_position(placed.drop("at").withColumn("slice", F.lit(1)))
    assert sorted(r.position for r in in_place.where("venue_id = 3").collect()) == list(range(len(streams[3])))
    assert {tuple(r) for r in order.snapshot_before(in_place).select("venue_id", "position", "snapshot_before").collect()} == want
    assert {tuple(r) for r in order.epoch_runs(in_place).collect()} == runs
    tail = [tuple(r) for r in order.last_records(placed.drop("at"), 5).select("emit_index", *schema.KEY).orderBy("emit_index").collect()]
    assert [t[1:] for t in tail] == sorted(map(k, own))[-5:] and tail[0][0] == len(own) - 5
    stream = spark.range(40).select(F.col("id").alias("emit_index"))
    got = spark.createDataFrame([(3, None), (20, (4, 19, 16)), (31, (25, 30, 6))], "emit_index long, gap struct<first_missed: long, last_missed: long, missed_count: long>")
    left = {r[0] for r in delivery.unaccounted(stream, got).collect()}
    assert left == {0, 1, 2, *range(21, 25), *range(32, 40)}


def test_a_long_gap_costs_two_rows(spark):
    stream = spark.createDataFrame([(1,), (2**40 + 5,)], "emit_index long")
    got = spark.createDataFrame([(2**40, (2, 2**40 - 1, 2**40 - 2))], "emit_index long, gap struct<first_missed: long, last_missed: long, missed_count: long>")
    assert {r[0] for r in delivery.unaccounted(stream, got).collect()} == {1, 2**40 + 5}


# expressions


def test_days_and_names(spark):
    n = columns.DAY_NANOS
    rows = spark.createDataFrame([(-1,), (-n,), (-n - 1,), (0,), (n - 1,), (n,)], "exchange_ts long")
    got = rows.select(columns.utc_day(F.col("exchange_ts")).alias("d"), columns.artifact_name(F.lit(7), columns.utc_day(F.col("exchange_ts"))).alias("n")).collect()
    assert [r.d for r in got] == [-1, -1, -2, 0, 0, 1]
    assert got[0].n == "venue-7-1969-12-31.bin" and got[3].n == "venue-7-1970-01-01.bin"


def test_split_levels(spark):
    levels = [(1, 105, 2), (0, 99, 3), (1, 101, 4), (0, 100, 5), (0, 100, 6)]
    row = spark.createDataFrame([(levels,)], "levels array<struct<side: bigint, price: bigint, size: bigint>>")
    bids, asks = row.select(columns.split_levels(F.col("levels"), 0), columns.split_levels(F.col("levels"), 1)).first()
    assert [tuple(x) for x in bids] == [(100, 5), (100, 6), (99, 3)] and [tuple(x) for x in asks] == [(101, 4), (105, 2)]


@pytest.mark.parametrize("speed", [(1, 1), (10000, 1), (1, 1000), (3, 7), (7, 3), (1, 1024)])
def test_due_times(spark, speed):
    s, most = pacing.Speed(*speed), 2**63 - 1
    cases = [(t0, base, base + d) for t0 in (0, 5, most - 3) for base in (0, 10) for d in (-5, 0, 1, 2, 999, 10**6, 10**9, most - 10)]
    cases += [(7, -(2**63), 2**63 - 1)]
    rows = spark.createDataFrame(cases, "t0 long, base long, ts long")
    got = [r[0] for r in rows.select(s.due_column(F.col("t0"), F.col("base"), F.col("ts"))).collect()]
    assert got == [s.due(*c) for c in cases]
    for (t0, base, ts), due in zip(cases, got, strict=True):
        span = ts - base
        exact = t0 if span <= 0 or span > most else min(t0 + span * s.den // s.num, most)
        assert due == exact


def test_speeds():
    assert pacing.Speed(10000, 5000) == pacing.Speed(2, 1)
    for bad in ((0, 1), (1, 0), (-1, 2), (2**32, 1), (1_000_001, 1), (1, 1025)):
        with pytest.raises(kind("InvalidSpeed")):
            pacing.Speed(*bad)


def test_pacer_and_clock():
    sim = clock.SimClock(100)
    fired = []
    late, early = sim.timer(20, lambda t: fired.append(("late", t))), sim.timer(10, lambda t: fired.append(("early", t)))
    sim.advance(15)
    assert fired == [("early", 110)] and late.stop() and not late.stop()
    early.reset(0)
    assert fired[-1] == ("early", 115)
    pacer = pacing.Pacer(sim, pacing.Speed(2, 1), window=5)
    assert pacer.wait(1000) and sim.now() == 115
    assert pacer.wait(1100) and sim.now() == 165 and pacer.slip == 0
    assert pacer.wait(1108) and sim.now() == 165 and pacer.slip == -4
    pacer.stop()
    assert not pacer.wait(9999)


# validation


SOURCE = {"exchange_ts": 1, "sequence_number": 1, "instrument_id": 1, "venue_id": 7, "record_type": 0, "side_flags": 0, "price": 5, "size": 1, "levels": []}


@pytest.mark.parametrize(
    ("change", "want"),
    [
        ({"venue_id": 65536}, "VenueIdRange"), ({"record_type": 3}, "RecordTypeRange"), ({"side_flags": 2}, "SideFlagsRange"),
        ({"levels": [(0, 1, 1)]}, "LevelsOnNonSnapshot"), ({"record_type": 2}, "SnapshotFieldSet"),
        ({"record_type": 2, "price": 0, "size": 0, "levels": [(2, 1, 1)]}, "LevelSide"),
        ({"record_type": 2, "price": 0, "size": 0, "levels": [(256, 1, 1)]}, "LevelSide"),
        ({"venue_id": 65536, "record_type": 9}, "VenueIdRange"), ({}, None), ({"venue_id": 65535}, None),
    ],
)
def test_rejections(spark, change, want):
    from decimal import Decimal

    row = SOURCE | change
    rows = spark.createDataFrame([(*(Decimal(v) if k == "sequence_number" else v for k, v in row.items()), 0)], schema.SOURCE_SCHEMA + ", row_index long")
    assert rows.select(validate.reject_class()).first()[0] == want
    if want:
        with pytest.raises(errors.RowError) as e:
            validate.check_rows(rows)
        assert e.value.kind is kind(want) and e.value.row == 0


def source_schema(**change):
    fields = dict(schema._FIELDS) | {"levels": pa.list_(pa.struct(list(schema._LEVEL.items())))}
    return pa.schema([(k, v) for k, v in (fields | change).items() if v is not None])


def test_source_schema():
    schema.check_source_schema(source_schema())
    level = list(schema._LEVEL.items())
    for change, blamed in (
        ({"exchange_ts": None, "time": pa.int64()}, "exchange_ts"), ({"price": None}, "price"), ({"recv_ts": pa.int64()}, "recv_ts"),
        ({"sequence_number": pa.int64()}, "sequence_number"), ({"price": pa.float64()}, "price"),
        ({"levels": pa.list_(pa.struct([level[0], ("price", pa.int32()), level[2]]))}, "levels.price"),
        ({"levels": pa.list_(pa.struct(level[1:]))}, "levels.side"), ({"levels": pa.int64()}, "levels"),
    ):
        with pytest.raises(kind("SourceSchema"), match=f"^{blamed}:"):
            schema.check_source_schema(source_schema(**change))
    with pytest.raises(kind("SourceSchema"), match="optional"):
        schema.check_source_schema(source_schema(), strict=True)


# books


def levels(df, instrument):
    rows = df.where(F.col("instrument_id") == instrument).collect()
    return (
        sorted(((r.price, r["size"]) for r in rows if r.side == 0), reverse=True),
        sorted((r.price, r["size"]) for r in rows if r.side == 1),
    )


@pytest.mark.parametrize(
    ("instrument", "ts", "resume", "bids", "asks"),
    [
        (101, 0, 0, [], []), (101, 1125, 5, [(100, 12), (99, 5)], [(101, 8), (102, 3)]),
        (101, 1200, 7, [(100, 12), (99, 5)], [(101, 8), (102, 3), (103, 4)]), (101, 9999, 14, [(200, 5)], []),
        (303, 1125, 5, [(10, 100)], []),
    ],
)
def test_warm_up(spark, instrument, ts, resume, bids, asks):
    for scope in ("venue", "file"):
        got, at = book.warm_up(frame(spark, WARM), instrument, ts, scope)
        assert at == resume and levels(got, instrument) == (bids, asks)


def test_book_equals_a_fold(spark):
    records = synth.build(spark).withColumn("size", F.when(F.col("record_type") == 0, F.col("size") % 4).otherwise(F.col("size")))
    rows = [r.asDict(recursive=True) for r in records.orderBy(*schema.KEY).collect()]
    books = {}
    for r in rows:
        b = books.setdefault((r["venue_id"], r["instrument_id"]), book.Book(r["instrument_id"]))
        if r["record_type"] == 2:
            both = [(x["price"], x["size"]) for x in r["bids"] + r["asks"]]
            b.snapshot(both, len(r["bids"]))
        else:
            try:
                b.apply(0, r["instrument_id"], r["side_flags"], r["price"], r["size"])
            except kind("LevelNotFound"):
                r["missing"] = True
    want = {(*k, s, p): n for k, b in books.items() for s, side in enumerate((b.bids(), b.asks())) for p, n in side}
    got = {(r.venue_id, r.instrument_id, r.side, r.price): r["size"] for r in book.book_at(records).collect()}
    assert got == want
    missing = {tuple(r[k] for k in schema.KEY) for r in rows if r.get("missing")}
    assert {tuple(r[k] for k in schema.KEY) for r in book.divergence(records).collect()} == missing
    best = {(r.venue_id, r.instrument_id): r for r in book.best(book.book_at(records)).collect()}
    for k, b in books.items():
        if k in best:
            assert (best[k].bid_price, best[k].bid_size) == (b.best_bid() or (None, None))
            assert (best[k].ask_price, best[k].ask_size) == (b.best_ask() or (None, None))


def test_book_script():
    b = book.Book(1)
    b.snapshot([(99, 5), (100, 10), (101, 8), (102, 3)], 2)
    for side, price, size in ((0, 100, 20), (0, 98, 1), (1, 101, 0), (1, 103, 4)):
        b.apply(0, 1, side, price, size)
    assert b.bids() == [(100, 20), (99, 5), (98, 1)] and b.asks() == [(102, 3), (103, 4)]
    for call, name in (
        (lambda: b.apply(0, 1, 0, 500, 0), "LevelNotFound"), (lambda: b.apply(1, 1, 0, 1, 1), "WrongRecordType"),
        (lambda: b.apply(0, 2, 0, 1, 1), "WrongInstrument"), (lambda: b.snapshot([(1, 1)], 2), "BidCountOutOfRange"),
        (lambda: b.snapshot([(1, 1), (1, 2)], 2), "DuplicateLevel"),
    ):
        with pytest.raises(kind(name)):
            call()


def test_epochs(spark):
    out = epoch.with_epochs(session(spark), 4).orderBy(*schema.KEY).collect()
    assert len(out) == 14
    snaps = [(i, r.exchange_ts - BASE, int(r.sequence_number), r.instrument_id) for i, r in enumerate(out) if r.record_type == 2]
    assert snaps == [(4, 4, 5, 10), (5, 4, 6, 11), (10, 8, 9, 10), (11, 8, 10, 11)]

    def sides(k):
        return [tuple(x) for x in out[k].bids], [tuple(x) for x in out[k].asks]

    assert sides(4) == ([(100, 5), (99, 7)], []) and sides(5) == ([], [(200, 6), (201, 8)])
    assert sides(10) == ([(99, 7)], [(105, 9)])
    tie = frame(spark, [rec(BASE + t, q, 10, price=q, size=1) for t, q in ((1, 1), (2, 2), (2, 3), (2, 4), (3, 5))])
    got = epoch.epoch_rows(tie, 2).collect()
    assert [(r.exchange_ts - BASE, int(r.sequence_number)) for r in got] == [(2, 5)]


def test_epoch_books_equal_books(spark):
    records = synth.build(spark)
    rows = epoch.epoch_rows(records, 70).collect()
    assert rows
    for r in random.Random(3).sample(rows, 12):
        want = book.book_at(records.where(F.col("venue_id") == r.venue_id), r.exchange_ts + 1)
        assert levels(want, r.instrument_id) == ([tuple(x) for x in r.bids], [tuple(x) for x in r.asks])


# digest


GOLDEN = [rec(1000, 1, 10, 7, 0, 0, 500, 3), rec(1000, 2, 11, 7, 1, 1, 501, 1), snap(1001, 3, 10, [(100, 2)])]


def test_golden_digest(spark):
    assert crc32c.crc32c(b"123456789") == 0xE3069283
    for parts in (1, 3):
        assert canonical.digest(frame(spark, GOLDEN), parts) == ("68709540", 3)
    assert canonical.sha256_digest(frame(spark, GOLDEN))[0] == "573396cae4871ee4eb4aa366a12c5c93edf0a036aeea5fe67267818dc13b0c72"
    changed = {canonical.digest(frame(spark, [r[:k] + (r[k] + 1,) + r[k + 1 :], *GOLDEN[1:]]))[0] for r in GOLDEN[:1] for k in (0, 2, 6, 7)}
    assert len(changed | {"68709540"}) == 5


def test_digest_of_events(spark):
    got = {canonical.digest(tables.records(spark, "/root/testdata/sf0.01"), n) for n in (1, 3, 16)}
    assert got == {("5f354a96", 10_000)}


def test_digest_tree(spark):
    import hashlib

    records = synth.build(spark, {1: (500,), 2: (300, 41)})
    rows = records.orderBy(*schema.KEY).toArrow().combine_chunks().to_batches()
    whole = rows[0]
    for leaf, node in ((100, 4), (7, 3), (10_000, 2)):
        leaves = []
        for at in range(0, whole.num_rows, leaf):
            data = canonical.frames(whole.slice(at, leaf))
            leaves.append(hashlib.sha256(data if isinstance(data, bytes) else data.tobytes()).digest())
        h = hashlib.sha256()
        for at in range(0, len(leaves), node):
            h.update(hashlib.sha256(b"".join(leaves[at : at + node])).digest())
        h.update(struct.pack("<Q", 841) + canonical.TERMINATOR)
        assert canonical.tree_digest(records.repartition(3), leaf, node) == (h.hexdigest(), 841)


def test_crc_parts():
    data = np.random.default_rng(1).integers(0, 256, 100_003, dtype=np.uint8).tobytes()

    def slow(d, c=0):
        c ^= 0xFFFFFFFF
        for b in d:
            c = int(crc32c.TABLE[(c ^ b) & 255]) ^ (c >> 8)
        return c ^ 0xFFFFFFFF

    assert crc32c.crc32c(data) == slow(data) and crc32c.crc32c(data[:70], 5) == slow(data[:70], 5)
    assert crc32c.combine(slow(data[:999]), slow(data[999:]), len(data) - 999) == slow(data)


# delivery


def test_ring_and_starts(spark):
    for bad in (0, 1, 3):
        with pytest.raises(kind("BadCapacity")):
            delivery.Ring(bad)
    with pytest.raises(kind("MaxBlobBytes")):
        delivery.Ring(2, -1)

    def stream(n):
        return spark.range(n).select(F.col("id").alias("emit_index"), F.col("id").alias("exchange_ts"))

    def start(cap, n, mode, s):
        return delivery.start_index(stream(n), delivery.Ring(cap), n, mode, s)

    for s in (delivery.emit_index(0), delivery.beginning()):
        with pytest.raises(kind("StartLapped")):
            start(2, 10, "block", s)
    assert start(8, 5, "drop", delivery.live()) == 5
    assert start(32, 10, "drop", delivery.exchange_ts(7)) == 7
    assert start(32, 3, "drop", delivery.exchange_ts(100)) == 3
    assert start(2, 10, "drop", delivery.beginning()) == 0
    with pytest.raises(kind("ModeUnset")):
        start(2, 2, None, delivery.live())
    with pytest.raises(kind("StartUnset")):
        start(2, 2, "drop", None)
    got = delivery.deliveries(stream(10), delivery.Ring(2), 0, 10).orderBy("emit_index").collect()
    assert [r.emit_index for r in got] == [8, 9] and tuple(got[0].gap) == (0, 7, 8) and got[1].gap is None
    assert delivery.simulate(delivery.Ring(4), [2, 20], 1)[1] == (18, (2, 17, 16))
    out = delivery.deliveries(stream(20), delivery.Ring(4), 2, 20)
    assert out.agg(F.min("emit_index")).first()[0] == 18
    assert tuple(delivery.accounting(out).first()) == (2, 1, 16)
    assert [r[0] for r in delivery.unaccounted(stream(20), out).orderBy("emit_index").collect()] == [0, 1]


def test_barrier(spark):
    subs = spark.createDataFrame([("block", 9), ("block", 4), ("drop", 1)], "mode string, cursor long")
    assert delivery.min_block_cursor(subs).first()[0] == 4
    assert str(delivery.min_block_cursor(subs.where("mode = 'drop'")).first()[0]) == delivery.NO_CURSOR
    ring = delivery.Ring(4)
    assert delivery.must_wait(ring, 8, 4) and not delivery.must_wait(ring, 7, 4) and not delivery.must_wait(ring, 3, 0)


# conversion


def source_file(path, rows):
    columns = list(schema._FIELDS)
    table = pa.table(
        {c: pa.array([r[c] for r in rows], schema._FIELDS[c]) for c in columns}
        | {"levels": pa.array([[dict(zip(("side", "price", "size"), x)) for x in r["levels"]] for r in rows], pa.list_(pa.struct(list(schema._LEVEL.items()))))}
    )
    import pyarrow.parquet as pq

    pq.write_table(table, path)


def row(ts, seq, venue=7, **change):
    return SOURCE | {"exchange_ts": ts, "sequence_number": seq, "venue_id": venue} | change


def test_convert(spark, tmp_path):
    day = columns.DAY_NANOS
    rows = [row(BASE, 1), row(BASE + 1, 2, price=6), row(BASE + 2, 1, 9), row(BASE + day, 3, price=7), row(BASE + 3, 2, 9, price=4), row(BASE + 4, 3, 9, price=3)]
    rows.append(row(BASE + 5, 4, 9, record_type=2, price=0, size=0, levels=[(1, 105, 2), (0, 99, 3), (1, 101, 4), (0, 100, 5)]))
    source_file(tmp_path / "in.parquet", rows)
    names = convert.convert(spark, str(tmp_path / "in.parquet"), str(tmp_path / "out"), epoch_every=2)
    assert names == ["venue-7-2024-01-01.bin", "venue-7-2024-01-02.bin", "venue-9-2024-01-01.bin"]
    back = convert.replay(spark, str(tmp_path / "out")).orderBy("emit_index").collect()
    assert [r.record_type for r in back].count(2) == 3 and len(back) == 9
    last = [r for r in back if r.venue_id == 9 and r.exchange_ts == BASE + 5][0]
    assert [tuple(x) for x in last.bids] == [(100, 5), (99, 3)] and [tuple(x) for x in last.asks] == [(101, 4), (105, 2)]
    tail = convert.replay(spark, str(tmp_path / "out"), BASE + 3).count()
    assert tail == sum(r.exchange_ts >= BASE + 3 for r in back)


@pytest.mark.parametrize(
    ("rows", "at", "name"),
    [
        ([row(10, 1), row(9, 2)], 1, "ExchangeTsDecreased"), ([row(10, 1), row(10, 1)], 1, "DuplicateKey"),
        ([row(10, 2), row(10, 1)], 1, "OutOfOrder"), ([row(10, 1), row(11, 2, 65536)], 1, "VenueIdRange"),
    ],
)
def test_rejected_conversion_leaves_nothing(spark, tmp_path, rows, at, name):
    source_file(tmp_path / "in.parquet", rows)
    with pytest.raises(errors.RowError) as e:
        convert.convert(spark, str(tmp_path / "in.parquet"), str(tmp_path / "out"))
    assert e.value.row == at and e.value.kind is kind(name)
    assert sorted(p.name for p in tmp_path.iterdir()) == ["in.parquet"]


def test_removal_of_a_missing_level_is_rejected(spark, tmp_path):
    source_file(tmp_path / "in.parquet", [row(10, 1, size=0)])
    with pytest.raises(kind("LevelNotFound")):
        convert.convert(spark, str(tmp_path / "in.parquet"), str(tmp_path / "out"))


# binary files


def as_dicts(records):
    return [r.asDict(recursive=True) for r in records.orderBy(*schema.KEY).collect()]


def test_binary_record_layout():
    r = dict(exchange_ts=0x0102030405060708, sequence_number=0x1112131415161718, instrument_id=0x21222324, venue_id=0x3132, record_type=0,
             side_flags=1, price=0x4142434445464748, size=0x5152535455565758)
    data = hotfile.encode([r], 0x3132)
    body = data[4096 : 4096 + 64]
    assert body[:8].hex() == "0807060504030201" and body[20:24].hex() == "32310001" and body[40:] == bytes(24)
    assert hotfile.HotFile(data).record(0) == r | {"bids": None, "asks": None}


def test_binary_round_trip_and_corruption(spark, tmp_path):
    records = synth.build(spark)
    names = hotfile.export(records, str(tmp_path))
    assert len(names) == 4 and (tmp_path / (names[0][0] + ".hash")).read_text() == names[0][1] + "\n"
    spark.dataSource.register(hotfile.HotFileSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    back = spark.read.format("hotfile").option("blocks", 1).load(str(tmp_path))
    assert canonical.digest(back) == canonical.digest(records)
    two = json.dumps([str(tmp_path / n) for n, _ in names[:2]])
    some = spark.read.format("hotfile").option("paths", two).load()
    assert some.count() == sum(len(hotfile.HotFile((tmp_path / n).read_bytes())) for n, _ in names[:2])
    assert back.where("exchange_ts >= 900").count() == records.where("exchange_ts >= 900").count()
    assert sorted(r.path.split("/")[-1] for r in catalogue.dataset_identity(spark, str(tmp_path)).collect()) == [n for n, _ in names]
    assert {r.hash for r in catalogue.artifact_hashes(spark, str(tmp_path)).collect()} == {h for _, h in names}
    data = (tmp_path / names[0][0]).read_bytes()
    file = hotfile.HotFile(data)
    file.verify_all()
    with pytest.raises(kind("BlockRange")):
        file.verify_block(99)
    h = file.header

    def broken(at):
        return data[:at] + bytes([data[at] ^ 1]) + data[at + 1 :]

    for at, name in ((0, "BadMagic"), (16, "HeaderChecksum"), (130, "ReservedSet"), (120, "NotFinalized"), (h.time_at, "TrailerChecksum")):
        with pytest.raises(kind(name)):
            hotfile.HotFile(broken(at))
    for cut in (data[:100], data + b"x"):
        with pytest.raises((kind("ShortHeader"), kind("OffsetChain"))):
            hotfile.HotFile(cut)
    for at, name in ((h.header_size + 64 * 30, "BlockChecksum"), (h.blob_at + 6, "BlobChecksum")):
        with pytest.raises(kind(name)):
            hotfile.HotFile(broken(at)).verify_all()


def test_binary_files_in_a_default_session(spark, tmp_path):
    """Filters are pushed only where the session allows it; a time given as an option works everywhere."""
    records = synth.build(spark)
    hotfile.export(records, str(tmp_path), block=16)
    spark.dataSource.register(hotfile.HotFileSource)
    before = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    want = records.where("exchange_ts >= 900").count()
    try:
        for allowed in ("false", "true"):
            spark.conf.set("spark.sql.python.filterPushdown.enabled", allowed)
            assert spark.read.format("hotfile").load(str(tmp_path)).where("exchange_ts >= 900").count() == want
            assert hotfile.read(spark, str(tmp_path)).where("exchange_ts >= 900").count() == want
            some = hotfile.read(spark, f"file://{tmp_path}", from_ts=900)
            assert some.where("exchange_ts >= 900").count() == want and some.count() < records.count()
    finally:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", before)


def test_binary_writer_rules():
    one = dict(exchange_ts=5, sequence_number=1, instrument_id=1, venue_id=7, record_type=0, side_flags=0, price=1, size=1)
    for records, name in (
        ([one, one], "DuplicateKey"), ([one, one | {"exchange_ts": 4}], "OutOfOrder"), ([one | {"venue_id": 8}], "VenueMismatch"),
        ([one | {"record_type": 2}], "UnusedFieldSet"), ([one | {"record_type": 3}], "RecordType"),
    ):
        with pytest.raises(kind(name)):
            hotfile.encode(records, 7)
    with pytest.raises(kind("PriceScale")):
        hotfile.encode([one], 7, 0)
    assert len(hotfile.HotFile(hotfile.encode([], 7))) == 0
    with pytest.raises(kind("BlobLength")):
        hotfile.parse_payload(struct.pack("<HHq", 0, 0, 1))


# catalogue


MANIFEST = {
    "dataset": [{"path": "a.bin", "hash": "11"}, {"path": "b.bin", "hash": "22"}], "config": {"speed_num": 1, "workers": 4},
    "subscribers": {"block": 1}, "result": {"emit_index_at_end": 5, "pacing_slip_nanos": 0, "canonical_hash": "68709540"},
    "timing": {"started_unix_nano": 1, "ended_unix_nano": 3, "elapsed_nanos": 2},
}
BENCH = """goos: linux
BenchmarkRingRead-16      	77 	 20.93 ns/op	  0 B/op	 0 allocs/op
BenchmarkRingRead-16      	78 	 21.93 ns/op	  5.0 MB/s	  0 B/op	 0 allocs/op
BenchmarkOther/k_2-16     	79 	 1e3 ns/op	  8 B/op	 1 allocs/op
PASS
"""


def test_catalogue(spark, tmp_path):
    import hashlib

    catalogue.create_tables(spark)
    (tmp_path / "run-1.json").write_text(catalogue.manifest_json(MANIFEST))
    (tmp_path / "note.txt").write_text("{}")
    assert catalogue.ingest_manifests(spark, str(tmp_path)) == 1
    r = spark.table("runs").first()
    assert (r.run_id, r.emit_index_at_end, r.elapsed_nanos, json.loads(r.config)) == ("run-1", 5, 2, MANIFEST["config"])
    assert r.dataset_hash == hashlib.sha256(b"a.bin\t11\nb.bin\t22\n").hexdigest()
    with pytest.raises(kind("DuplicateRun")):
        catalogue.ingest_manifests(spark, str(tmp_path))
    bench = tmp_path / "bench.txt"
    bench.write_text(BENCH)
    assert catalogue.ingest_benchmarks(spark, str(bench), "abc") == 3
    rows = {(r.name, r.sample): r for r in spark.table("benchmarks").collect()}
    assert rows["BenchmarkRingRead", 1].ns_per_op == 21.93 and rows["BenchmarkOther/k_2", 0].ns_per_op == 1000
    with pytest.raises(kind("DuplicateBenchmark")):
        catalogue.ingest_benchmarks(spark, str(bench), "abc")
    bench.write_text("BenchmarkX-8 5 3 ns/op 1 B/op\n")
    with pytest.raises(errors.LineError) as e:
        catalogue.ingest_benchmarks(spark, str(bench), "abc")
    assert e.value.line == 1 and e.value.kind is kind("MissingMetric")
