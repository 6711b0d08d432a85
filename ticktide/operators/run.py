"""A run: one merged stream, delivered to subscribers at one speed, described by a manifest."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyarrow.fs import FileType
from pyspark.sql import DataFrame, Row

from .. import errors, shared
from . import canonical, catalogue, delivery, order, pacing

START_KINDS = ("beginning", "exchange_ts", "emit_index", "live")
#: Codes of failures to subscribe and to deliver.
_CODES = {
    "ModeUnset": "INVALID_ARGUMENT", "StartUnset": "INVALID_ARGUMENT", "InvalidSpeed": "INVALID_ARGUMENT",
    "StartLapped": "OUT_OF_RANGE", "Closed": "FAILED_PRECONDITION", "SpeedMismatch": "FAILED_PRECONDITION",
    "Canceled": "ABORTED", "Evicted": "ABORTED",
}


def status_code(error: BaseException) -> str:
    return _CODES.get(type(error).__name__, "INTERNAL")


def parse_start(request: dict) -> delivery.Start:
    """The one start position of a request: a key of START_KINDS with its value."""
    given = [k for k in START_KINDS if k in request]
    if len(given) != 1:
        raise errors.named("StartUnset")("start position must be set")
    kind = given[0]
    return delivery.Start(kind, int(request[kind]) if kind in ("exchange_ts", "emit_index") else 0)


@dataclass(frozen=True)
class Config:
    ring: delivery.Ring
    seek_exchange_ts: int | None = None
    workers: int = 1
    watchdog_timeout_nanos: int = 0

    def __post_init__(self):
        if self.workers < 1:
            raise errors.named("WorkerCount")(str(self.workers))


@dataclass
class Run:
    """The first accepted subscriber fixes the speed and starts the run."""

    records: DataFrame
    config: Config
    clock: object
    dataset: list[dict] = field(default_factory=list)
    speed: pacing.Speed | None = None
    started_at: int = 0
    ended: bool = False
    accepted: list[tuple[str, str]] = field(default_factory=list)

    def __post_init__(self):
        if self.config.seek_exchange_ts is not None:
            self.records = order.seek(self.records, self.config.seek_exchange_ts)
        self.stream = order.with_emit_index(self.records)

    def attach(self, mode: str | None, start: delivery.Start | None, speed: pacing.Speed, written: int = 0) -> int:
        """The cursor of a new subscriber after ``written`` records."""
        if self.ended:
            raise errors.named("Closed")("the run is over")
        if self.speed is not None and speed != self.speed:
            raise errors.named("SpeedMismatch")(f"the run is paced at {self.speed}")
        cursor = delivery.start_index(self.stream, self.config.ring, written, mode, start)
        if self.speed is None:
            self.speed, self.started_at = speed, self.clock.now()
        self.accepted.append((mode, start.kind))
        return cursor

    def deliver(self, cursor: int, paced: bool = False) -> Iterator[Row]:
        """Records from ``cursor`` on, in order, partition by partition; paced by the run's speed and clock."""
        rows = order.ordered(self.stream.where(f"emit_index >= {cursor}")).toLocalIterator(prefetchPartitions=True)
        pacer = pacing.Pacer(self.clock, self.speed or pacing.Speed(1)) if paced else None
        for row in rows:
            if pacer is not None and not pacer.wait(row["exchange_ts"]):
                return
            yield row

    def finish(self, slip: int = 0, error: str = "") -> dict:
        """The run's manifest. A run that failed or was stopped has no digest."""
        self.ended = True
        digest, n = ("", self.stream.count()) if error else canonical.digest(self.records)
        kinds, modes = Counter(k for _, k in self.accepted), Counter(m for m, _ in self.accepted)
        ended, speed, ring = self.clock.now(), self.speed or pacing.Speed(1), self.config.ring
        return {
            "dataset": self.dataset,
            "config": {
                "speed_num": speed.num, "speed_den": speed.den, "workers": self.config.workers,
                "ring_capacity": ring.capacity, "max_blob_bytes": ring.max_blob_bytes,
                "seek_exchange_ts": self.config.seek_exchange_ts,
                "watchdog_timeout_nanos": self.config.watchdog_timeout_nanos,
            },
            "subscribers": {m: modes[m] for m in (delivery.BLOCK, delivery.DROP)} | {f"start_{k}": kinds[k] for k in START_KINDS},
            "result": {"emit_index_at_end": n, "pacing_slip_nanos": slip, "canonical_hash": digest} | ({"error": error} if error else {}),
            "timing": {"started_unix_nano": self.started_at, "ended_unix_nano": ended, "elapsed_nanos": ended - self.started_at},
        }

    def write_manifest(self, path: str, **result) -> dict:
        """The manifest, also as a file that must not exist, in any store that Spark names by a URL."""
        store, at = shared.store_of(str(path))
        if store.get_file_info(at).type != FileType.NotFound:
            raise FileExistsError(path)
        manifest = self.finish(**result)
        with store.open_output_stream(at) as f:
            f.write(catalogue.manifest_json(manifest).encode())
        return manifest
