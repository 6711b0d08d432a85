import uuid

import pytest

from tests.helpers import BASE, WARM, frame, rec
from ticktide import clock, errors
from ticktide.operators import book, delivery
from ticktide.streaming import books, fanout


def files(spark, rows, folder, parts):
    """One file for each part, in the order of modification times."""
    import os

    for k, part in enumerate(parts):
        frame(spark, [rows[i] for i in part]).coalesce(1).write.mode("append").parquet(str(folder))
        for name in os.listdir(folder):
            if name.endswith(".parquet") and not os.path.exists(f"{folder}/.seen-{name}"):
                open(f"{folder}/.seen-{name}", "w").close()
                os.utime(f"{folder}/{name}", (1_700_000_000 + k, 1_700_000_000 + k))


def test_fanout(spark, tmp_path):
    rows = [rec(BASE + i // 3, i, 1, price=i, size=1) for i in range(30)]
    files(spark, rows, tmp_path / "in", [range(0, 10), range(10, 20), range(20, 30)])
    got = {"a": [], "b": [], "late": []}

    def sink(name):
        return lambda df: got[name].extend(r.emit_index for r in df.orderBy("emit_index").collect())

    fan = fanout.FanOut(clock.RealClock())
    fan.subscribe(fanout.Subscriber("a", "block", sink("a"), 0))
    fan.subscribe(fanout.Subscriber("b", "drop", sink("b"), 12))
    fan.run(books.read_records(spark, str(tmp_path / "in")), str(tmp_path / "checkpoint"))
    assert got["a"] == list(range(30)) and got["b"] == list(range(12, 30)) and fan.written == 30
    with pytest.raises(errors.named("Closed")):
        fan.subscribe(fanout.Subscriber("late", "drop", sink("late")))
    with pytest.raises(errors.named("ModeUnset")):
        fanout.Subscriber("x", None, sink("a"))


def test_fanout_rejects_late_batches_and_evicts(spark):
    fan = fanout.FanOut(sim := clock.SimClock(), watchdog_nanos=10)
    slow = fanout.Subscriber("slow", "block", lambda df: sim.advance(50), 0)
    fan.subscribe(slow)
    fan.on_batch(frame(spark, [rec(10, 1, 1)]), 0)
    assert slow.state == "evicted" and fan.slip == 50
    assert fan.min_block_cursor() == 2**64 - 1
    with pytest.raises(errors.named("OutOfOrder")):
        fan.on_batch(frame(spark, [rec(9, 2, 1)]), 1)
    with pytest.raises(errors.named("DuplicateKey")):
        fan.on_batch(frame(spark, [rec(10, 1, 1)]), 1)
    lapped = fanout.Subscriber("lapped", "block", lambda df: None, 0)
    fan.subscribe(lapped)
    fan.on_batch(frame(spark, [rec(11, 3, 1)]), 2)
    assert lapped.state == "lapped"


def test_streamed_books_equal_batch_books(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    files(spark, WARM, tmp_path / "in", [range(0, 3), range(3, 9), range(9, 14)])
    changes = books.book_changes(books.read_records(spark, str(tmp_path / "in")))
    seen = {}

    def take(df, _):
        for r in df.collect():
            seen[r.venue_id, r.instrument_id, r.side, r.price] = r["size"]

    query = changes.writeStream.outputMode("update").foreachBatch(take).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    want = {(r.venue_id, r.instrument_id, r.side, r.price): r["size"] for r in book.book_at(frame(spark, WARM)).collect()}
    assert {k: n for k, n in seen.items() if n} == want


def numbered(spark, a, b):
    return frame(spark, [rec(BASE + i, i, 1, price=i, size=1) for i in range(a, b)])


def test_forced_lap(spark):
    """A drop subscriber that reads now and then gets the gaps of the closed form, live."""
    import random

    rnd, ring = random.Random(6), delivery.Ring(8)
    fan = fanout.FanOut(clock.SimClock(), ring=ring)
    slow = fanout.Subscriber("slow", "drop", None, 3)
    fan.subscribe(slow)
    got, written, schedule, cursor = [], 0, [], 3
    for _ in range(6):
        n = rnd.randint(1, 20)
        fan.on_batch(numbered(spark, written, written + n), 0)
        written += n
        schedule.append(written)
        found = fan.read(slow)
        if found is None:
            assert cursor >= written
            continue
        rows, missed = found
        own = sorted((r.emit_index, r.gap) for r in rows.select("emit_index", "gap").collect())
        held = ring.held(cursor, written) if cursor < ring.oldest(written) else cursor
        assert [i for i, _ in own] == list(range(held, written)) and all(g is None for _, g in own[1:])
        want = (cursor, held - 1, held - cursor) if held > cursor else None
        assert missed == want and (own[0][1] and tuple(own[0][1])) == want
        got.append((held, want))
        cursor = written
    assert any(g for _, g in got) and slow.gaps == [g for _, g in got if g]
    assert slow.received + sum(n for *_, n in slow.gaps) == written - 3
    assert delivery.simulate(ring, [schedule[0]], 3)[0] == got[0]


def test_block_barrier_and_watchdog(spark):
    """The writer waits for block subscribers only; one that is stuck in its sink is evicted, and the run goes on."""
    import threading

    stuck, seen, lossy = threading.Event(), [], []
    fan = fanout.FanOut(clock.RealClock(), watchdog_nanos=3_000_000_000, ring=delivery.Ring(4))
    good = fanout.Subscriber("good", "block", lambda df: seen.extend(r.emit_index for r in df.orderBy("emit_index").collect()), 0)
    hung = fanout.Subscriber("hung", "block", lambda df: stuck.wait(120), 0)
    drop = fanout.Subscriber("drop", "drop", lambda df: (lossy.append(1), stuck.wait(120)), 0)
    for s in (good, hung, drop):
        fan.subscribe(s)
    fan.on_batch(numbered(spark, 0, 30), 0)
    assert fan.written == 30 and hung.state == "evicted" and fan.slip >= 3_000_000_000
    assert lossy == [1] and drop.state == "running"
    stuck.set()
    fan.end()
    assert seen == list(range(30)) and good.state == "ended" and drop.received + sum(n for *_, n in drop.gaps) == 30
    with pytest.raises(errors.named("Evicted")):
        fan.read(hung)


def jobs_of(spark, call):
    """How many jobs ``call`` runs in this thread."""
    group = f"jobs of {uuid.uuid4()}"
    spark.sparkContext.setJobGroup(group, group)
    try:
        call()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


def test_parts_take_no_jobs(spark):
    """The jobs of a batch do not grow with the parts that it fills the ring with, nor do the frames that stay."""
    stored = spark.sparkContext._jsc.sc().getPersistentRDDs
    counts, held_by, before = [], {}, stored().size()
    for n in (6, 600):  # 3 and 300 parts
        fan = fanout.FanOut(clock.SimClock(), watchdog_nanos=10, ring=delivery.Ring(2))
        stuck, lossy = fanout.Subscriber("stuck", "block", None, 0), fanout.Subscriber("lossy", "drop", None, 0)
        late = fanout.Subscriber("late", "block", None, delivery.exchange_ts(BASE + n - 1))
        fan.subscribe(stuck)
        fan.subscribe(lossy)
        records = numbered(spark, 0, n)
        counts.append(jobs_of(spark, lambda: fan.on_batch(records, 0)))  # noqa: B023
        assert stuck.state == "evicted" and fan.slip == 10 and fan.written == n
        fan.subscribe(late)
        fan.on_batch(numbered(spark, n, n + 1), 1)
        assert late.cursor == n - 1 and [r.emit_index for r in fan.read(late)[0].orderBy("emit_index").collect()] == [n - 1, n]
        rows, missed = fan.read(lossy)
        held = delivery.Ring(2).held(0, n + 1)
        assert missed == (0, held - 1, held) and [r.emit_index for r in rows.orderBy("emit_index").collect()] == list(range(held, n + 1))
        held_by[n] = fan
    assert counts[1] <= counts[0] + 2
    for n, fan in held_by.items():
        assert [(a, b) for a, b, _ in fan._held] == [(n - 2, n), (n, n + 1)] and not fan._leaving
        for *_, records in fan._held:
            records.unpersist(True)
    assert stored().size() <= before


def test_sinks_take_long_frames(spark):
    """Block sinks get all records in a few frames, and the writer still pushes out nothing that one of them needs."""
    ring, n, frames, taken = delivery.Ring(2), 600, {}, {}

    def sink(name):
        def deliver(df):
            got = [r.emit_index for r in df.orderBy("emit_index").collect()]
            frames.setdefault(name, []).append((got, fan.written, fan.ring.oldest(fan.written)))

        return deliver

    fan = fanout.FanOut(clock.RealClock(), ring=ring)
    for name, start in (("a", 0), ("b", 0), ("later", 45)):
        fan.subscribe(s := fanout.Subscriber(name, "block", sink(name), start))
        taken[name] = s
    fan.subscribe(lossy := fanout.Subscriber("lossy", "drop", sink("lossy"), 0))
    fan.on_batch(numbered(spark, 0, 90), 0)
    fan.subscribe(s := fanout.Subscriber("joins", "block", sink("joins"), 89))
    taken["joins"] = s
    fan.on_batch(numbered(spark, 90, n), 1)
    fan.end()
    for name, start in (("a", 0), ("b", 0), ("later", 45), ("joins", 89)):
        assert [i for got, *_ in frames[name] for i in got] == list(range(start, n))
        assert taken[name].state == "ended" and taken[name].received == n - start
        assert len(frames[name]) <= 40 and all(oldest <= got[0] for got, _, oldest in frames[name])
    got = [i for own, *_ in frames["lossy"] for i in own]
    missed = [i for a, b, k in lossy.gaps for i in range(a, b + 1)]
    assert got == sorted(got) and sorted(got + missed) == list(range(n)) and lossy.received == len(got) and lossy.state == "ended"
    assert not fan._leaving


def test_slow_sinks_keep_short_frames(spark):
    """A sink that needs much of the watchdog's time for a ring of records gets no more at once, and is not evicted."""
    import time

    frames = []

    def deliver(df):
        frames.append(sorted(r.emit_index for r in df.collect()))
        time.sleep(0.5 * len(frames[-1]) / 2)

    fan = fanout.FanOut(clock.RealClock(), watchdog_nanos=4_000_000_000, ring=delivery.Ring(2))
    slow = fanout.Subscriber("slow", "block", deliver, 0)
    fan.subscribe(slow)
    fan.on_batch(numbered(spark, 0, 9), 0)
    fan.end()
    assert sum(frames, []) == list(range(9)) and max(map(len, frames)) == 2
    assert slow.state == "ended" and slow.received == 9


def test_starts_in_the_retained_window(spark):
    fan = fanout.FanOut(clock.SimClock(), ring=delivery.Ring(8))
    fan.on_batch(numbered(spark, 0, 20), 0)
    subs = {
        name: fanout.Subscriber(name, mode, None, start)
        for name, mode, start in (
            ("oldest", "block", 12), ("too old", "block", 11), ("time", "block", delivery.exchange_ts(BASE + 15)), ("past", "block", delivery.exchange_ts(BASE + 99)),
            ("live", "drop", None), ("future", "drop", 23), ("old drop", "drop", 0),
        )
    }
    for s in subs.values():
        fan.subscribe(s)
    fan.on_batch(numbered(spark, 20, 20), 1)
    assert {n: s.cursor for n, s in subs.items() if n != "too old"} == {"oldest": 12, "time": 15, "past": 20, "live": 20, "future": 23, "old drop": 0}
    assert subs["too old"].state == "lapped"
    assert [r.emit_index for r in fan.read(subs["time"])[0].orderBy("emit_index").collect()] == [15, 16, 17, 18, 19]
    assert fan.read(subs["live"]) is None and fan.read(subs["future"]) is None
    assert fan.read(subs["old drop"])[1] == (0, 15, 16)
    for name, start in (("oldest", 12), ("time", 15)):
        fan.taken(subs[name], 20)
        assert subs[name].received == 20 - start
    fan.on_batch(numbered(spark, 20, 25), 2)
    assert [r.emit_index for r in fan.read(subs["future"])[0].collect()] == [23, 24]


def test_streamed_books_fold_a_batch(spark, tmp_path):
    """Many events of a level in a batch, snapshots within it, and a removal of what is not there."""
    import random

    rnd, rows, live = random.Random(1), [], {}
    for q in range(240):
        if q % 37 == 5:
            live = {(0, 5): 2, (1, 9): 3}
            rows.append((BASE + q, q, 1, 7, 2, 0, 0, 0, [{"price": 5, "size": 2}], [{"price": 9, "size": 3}]))
            continue
        side, price = rnd.randint(0, 1), rnd.randint(1, 10)
        size = rnd.randint(0, 3) if (side, price) in live else rnd.randint(1, 3)
        live[side, price] = size
        if not size:
            del live[side, price]
        rows.append(rec(BASE + q, q, 1, side=side, price=price, size=size))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    files(spark, rows, tmp_path / "in", [range(0, 100), range(100, 170), range(170, 240)])
    seen = {}

    def take(df, _):
        seen.update({(r.side, r.price): r["size"] for r in df.collect()})

    def run():
        changes = books.book_changes(books.read_records(spark, str(tmp_path / "in")))
        changes.writeStream.outputMode("update").foreachBatch(take).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()

    run()
    assert {k: n for k, n in seen.items() if n} == live
    missing = next((s, p) for s in (0, 1) for p in range(1, 11) if (s, p) not in live)
    frame(spark, [rec(BASE + 999, 999, 1, side=missing[0], price=missing[1], size=0)]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    with pytest.raises(Exception, match="LevelNotFound"):
        run()
