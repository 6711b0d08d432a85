"""One ordered stream to many subscribers through a ring of retained records.

``FanOut.on_batch`` is the writer, called by ``foreachBatch``. It splits a micro-batch
into parts that fit the ring and writes a part once no block subscriber needs what
the part would push out: that is the barrier, and drop subscribers are no part of
it. Each subscriber reads for itself, in a thread of its own if it has a sink, or
when it is asked to: a block subscriber gets every record; a drop subscriber that
was lapped goes on with the record that its slot holds now and is told what it
missed. A block subscriber that holds the writer back for longer than the watchdog
allows, be its sink slow or stuck, is evicted. Joins and leaves take effect between
parts; a start anywhere in the retained window is accepted.

A sink may be ahead of the writer in the batch in hand, so that it gets a few long
frames and not a job for each part. The barrier holds as it is: what a part pushes out,
every block subscriber has taken. Frames begin with the ring's capacity and double, with
a watchdog only while a sink is far from its limit.

A micro-batch is indexed and persisted once. Its parts are ranges of the index, so to
write one moves numbers on the driver and runs no job. Once a batch is written, the
ring persists what it retains of it, the last records, and lets go of the rest when
no sink reads it any more.

Without a ring the fan-out goes in lockstep: nothing is retained, the writer itself
calls the sinks with each micro-batch, and one that took too long is evicted.
"""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import errors
from ..operators.delivery import BLOCK, NO_CURSOR, Ring, Start, gap, parse_mode
from ..operators.order import with_emit_index
from ..schema import KEY

Gap = tuple[int, int, int]


class Subscriber:
    """A reader of the ring.

    ``deliver`` gets each ordered part (with emit_index, and ``gap`` on the first row
    of a drop subscriber's part) and returns when it has taken it; without it, the
    owner calls ``FanOut.read``. ``start``: an emit index, a ``Start``, or None for
    the end of the stream.
    """

    def __init__(self, name: str, mode: str | None, deliver: Callable[[DataFrame], None] | None = None, start: int | Start | None = None):
        self.name, self.mode, self.deliver = name, parse_mode(mode), deliver
        self.start = Start("emit_index", start) if isinstance(start, int) else start or Start("live")
        self.cursor = 0
        #: joining, running, lapped, canceled, evicted, failed, closed or ended
        self.state = "joining"
        self.received, self.gaps = 0, list[Gap]()
        self.frame: tuple[int, int] | None = None  # what its sink has now
        self.error: BaseException | None = None

    def cancel(self) -> None:
        if self.state in ("joining", "running"):
            self.state = "canceled"


class FanOut:
    """Feeds subscribers from ``foreachBatch``; ``clock`` times the writer's waits for the watchdog."""

    def __init__(self, clock, watchdog_nanos: int | None = None, ring: Ring | None = None):
        self.clock, self.watchdog, self.ring = clock, watchdog_nanos, ring
        self.subscribers: list[Subscriber] = []
        self._joining: list[Subscriber] = []
        self._held: list[tuple[int, int, DataFrame]] = []  # (first index, end, records) of what is retained and of the batch in hand
        self._leaving: list[tuple[int, int, DataFrame]] = []  # the same of what only sinks that have it now still read
        self._threads: dict[str, threading.Thread] = {}
        self._moved = threading.Condition()
        self.written, self.slip, self.ended, self.last = 0, 0, False, None

    def subscribe(self, subscriber: Subscriber) -> None:
        with self._moved:
            if self.ended:
                raise errors.named("Closed")(subscriber.name)
            self._joining.append(subscriber)

    def unsubscribe(self, subscriber: Subscriber) -> None:
        with self._moved:
            subscriber.cancel()
            self._moved.notify_all()

    def min_block_cursor(self) -> int:
        own = [s.cursor for s in self.subscribers if s.mode == BLOCK and s.state == "running"]
        return min(own, default=int(NO_CURSOR))

    # the writer

    def oldest(self) -> int:
        """The first index that is still there for a block subscriber to start at."""
        return self.written if self.ring is None else self.ring.oldest(self.written)

    def _resolve(self, start: Start) -> int:
        if start.kind != "exchange_ts":
            return {"beginning": 0, "emit_index": start.value, "live": self.written}[start.kind]
        for _, _, records in self._held:
            own = records.where((F.col("exchange_ts") >= F.lit(start.value)) & (F.col("emit_index") >= self.oldest()) & (F.col("emit_index") < self.written))
            if (found := own.agg(F.min("emit_index")).first()[0]) is not None:
                return found
        return self.written

    def _apply_control(self) -> None:
        """Joins and leaves."""
        joining, self._joining = self._joining, []
        for s in joining:
            if s.state != "joining":
                continue
            s.cursor, s.state = self._resolve(s.start), "running"
            if s.mode == BLOCK and s.cursor < self.oldest():
                s.state = "lapped"
                continue
            self.subscribers.append(s)
            if s.deliver is not None and self.ring is not None:
                self._threads[s.name] = threading.Thread(target=self._feed, args=(s,), name=s.name, daemon=True)
                self._threads[s.name].start()
        self.subscribers = [s for s in self.subscribers if s.state == "running"]

    def _wait_for_room(self, n: int) -> None:
        """Wait until ``n`` more records push out nothing that a block subscriber needs; evict who takes too long."""
        began = progress = self.clock.now()
        least = self.min_block_cursor()
        while self.written + n - least > self.ring.capacity:
            until = None if self.watchdog is None else progress + self.watchdog
            self.clock.wait(self._moved, until)
            now, was, least = self.clock.now(), least, self.min_block_cursor()
            if least != was:
                progress = now
            elif until is not None and now >= until:
                slow = min((s for s in self.subscribers if s.mode == BLOCK and s.state == "running"), key=lambda s: s.cursor)
                slow.state, progress = "evicted", now
                self._moved.notify_all()
                least = self.min_block_cursor()
        self.slip += self.clock.now() - began

    def on_batch(self, batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            edge = F.struct(*KEY)
            low, high, n = batch.agg(F.min(edge), F.max(edge), F.count("*")).first()
            if not n:
                with self._moved:
                    self._apply_control()
                return
            if self.last is not None and tuple(low) <= tuple(self.last):
                kind = "DuplicateKey" if tuple(low) == tuple(self.last) else "OutOfOrder"
                raise errors.named(kind)(f"batch {batch_id} begins at {tuple(low)}")
            self.last = high
            first = self.written
            indexed = with_emit_index(batch).withColumn("emit_index", F.col("emit_index") + F.lit(first))
            if self.ring is None:
                self._in_lockstep(indexed, n)
                return
            indexed = indexed.persist(StorageLevel.MEMORY_AND_DISK)
            indexed.count()  # held before the batch is let go
        finally:
            batch.unpersist()
        self._through_ring(indexed, first, first + n)

    def _through_ring(self, indexed: DataFrame, first: int, last: int) -> None:
        with self._moved:
            self._held.append((first, last, indexed))
            self._moved.notify_all()
        for at in range(first, last, self.ring.capacity):
            end = min(at + self.ring.capacity, last)
            with self._moved:
                self._apply_control()
                self._wait_for_room(end - at)
                self.written = end
                self._let_go()
                self._moved.notify_all()
        if last - first > self.ring.capacity:
            oldest = self.oldest()
            kept = indexed.where(F.col("emit_index") >= oldest).persist(StorageLevel.MEMORY_AND_DISK)
            kept.count()
            with self._moved:
                self._held = [(oldest, last, kept)]
                self._leaving.append((first, last, indexed))
                self._let_go()

    def _in_lockstep(self, indexed: DataFrame, n: int) -> None:
        self._apply_control()
        for s in self.subscribers:
            if s.state != "running":
                continue
            began = self.clock.now()
            s.deliver(indexed.where(F.col("emit_index") >= F.lit(s.cursor)))
            took = self.clock.now() - began
            if s.mode == BLOCK:
                self.slip += took
                if self.watchdog is not None and took > self.watchdog:
                    s.state = "evicted"
            s.received += max(0, self.written + n - max(s.cursor, self.written))
            s.cursor = max(s.cursor, self.written + n)
        self.written += n

    def _let_go(self) -> None:
        oldest = self.oldest()
        leaving, self._leaving = self._leaving + [h for h in self._held if h[1] <= oldest], []
        self._held = [h for h in self._held if h[1] > oldest]
        frames = [s.frame for s in self.subscribers if s.state == "running" and s.frame is not None]
        for first, end, records in leaving:
            if any(a < end and first < b for a, b in frames):
                self._leaving.append((first, end, records))
            else:
                records.unpersist()

    # a reader

    def read(self, s: Subscriber) -> tuple[DataFrame, Gap | None] | None:
        """What ``s`` gets next: (records, what it missed before them); None if there is nothing now.

        The cursor of a drop subscriber moves on here, that of a block subscriber by ``taken``.
        """
        got = self._next(s, 0)
        return got and got[:2]

    def _next(self, s: Subscriber, length: int) -> tuple[DataFrame, Gap | None, int, int] | None:
        """As ``read``, with the first index and the end: all that is written, or ``length`` records if so many are in hand."""
        with self._moved:
            if s.state == "joining":
                return None
            for state, kind in (("evicted", "Evicted"), ("canceled", "Canceled"), ("lapped", "StartLapped"), ("closed", "Closed")):
                if s.state == state:
                    raise errors.named(kind)(s.name)
            held = s.cursor if s.mode == BLOCK or s.cursor >= self.oldest() else self.ring.held(s.cursor, self.written)
            end = max(self.written, min(held + length, self._held[-1][1] if self._held else 0))
            if s.cursor >= end:
                return None
            missed = (s.cursor, held - 1, held - s.cursor) if held > s.cursor else None
            own = [records for first, last, records in self._held if last > held and first < end]
            records = own[0]
            for more in own[1:]:
                records = records.unionByName(more)
            records = records.where((F.col("emit_index") >= held) & (F.col("emit_index") < end))
            if s.mode != BLOCK:
                at = F.lit(s.cursor).cast("long")
                records = records.withColumn("gap", F.when(F.col("emit_index") == held, gap(at, F.lit(held).cast("long"))))
                if missed:
                    s.gaps.append(missed)
                s.cursor = end
                s.received += end - held
            return records, missed, held, end

    def taken(self, s: Subscriber, end: int) -> None:
        """A block subscriber has all records before ``end``."""
        with self._moved:
            s.received += end - s.cursor
            s.cursor = end
            self._moved.notify_all()

    def _feed(self, s: Subscriber) -> None:
        length = self.ring.capacity
        try:
            while s.state == "running":
                with self._moved:
                    got = self._next(s, length)
                    if got is None:
                        if self.ended:
                            s.state = "ended"
                            return
                        self._moved.wait()
                        continue
                    records, _, first, end = got
                    s.frame = first, end
                began = self.clock.now()
                s.deliver(records)
                quick = self.watchdog is None or 8 * (self.clock.now() - began) <= self.watchdog
                length = max(self.ring.capacity, 2 * (end - first) if quick else (end - first) // 2)
                with self._moved:
                    s.frame = None
                    if s.mode == BLOCK and s.state == "running":
                        self.taken(s, end)
                    if self._leaving:
                        self._let_go()
        except errors.TapeError:
            pass  # its state tells why
        except BaseException as e:
            with self._moved:
                s.state, s.error = "failed", e
                self._moved.notify_all()

    def end(self, wait_nanos: int | None = None) -> None:
        """The stream is over: readers take what is left, joins fail, those that wait and later ones."""
        with self._moved:
            self.ended = True
            for s in self._joining:
                s.state = "closed"
            self._joining = []
            self._moved.notify_all()
        for name, thread in self._threads.items():
            limit = wait_nanos if wait_nanos is not None else self.watchdog
            thread.join(None if limit is None else limit / 1e9)
            if thread.is_alive():  # stuck in its sink
                for s in self.subscribers:
                    if s.name == name and s.state == "running":
                        s.state = "evicted"
        with self._moved:
            if self._leaving:
                self._let_go()

    def run(self, stream: DataFrame, checkpoint: str) -> None:
        """Deliver all that is there, then end; an error in a batch ends the run without an end mark."""
        query = (
            stream.writeStream.foreachBatch(self.on_batch)
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )
        try:
            query.awaitTermination()
        except BaseException as e:
            with self._moved:
                for s in (*self.subscribers, *self._joining):
                    if s.state in ("joining", "running"):
                        s.state, s.error = "failed", e
                self._moved.notify_all()
            raise
        self.end()
