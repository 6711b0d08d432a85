import json

import pytest

from tests.helpers import WARM, frame
from ticktide import clock, errors
from ticktide.operators import catalogue, delivery, pacing, run


def test_run(spark, tmp_path):
    sim = clock.SimClock(50)
    r = run.Run(frame(spark, WARM), run.Config(delivery.Ring(8), seek_exchange_ts=1100), sim, [{"path": "a.bin", "hash": "1"}])
    speed = pacing.Speed(1, 1)
    with pytest.raises(errors.named("ModeUnset")):
        r.attach(None, delivery.live(), speed)
    assert r.attach("block", run.parse_start({"beginning": True}), speed) == 0
    with pytest.raises(errors.named("SpeedMismatch")):
        r.attach("drop", delivery.live(), pacing.Speed(2, 1))
    assert r.attach("drop", run.parse_start({"exchange_ts": 1300}), speed, 12) == 8
    got = [(x.emit_index, int(x.sequence_number)) for x in r.deliver(0, paced=True)]
    assert got == [(i, i + 3) for i in range(12)]
    m = r.write_manifest(str(tmp_path / "run-7.json"))
    assert m["result"]["emit_index_at_end"] == 12 and len(m["result"]["canonical_hash"]) == 8
    assert m["subscribers"] == {"block": 1, "drop": 1, "start_beginning": 1, "start_exchange_ts": 1, "start_emit_index": 0, "start_live": 0}
    with pytest.raises(errors.named("Closed")):
        r.attach("drop", delivery.live(), speed)
    back = catalogue.read_manifests(spark, str(tmp_path)).first()
    assert back.run_id == "run-7" and back.emit_index_at_end == 12 and json.loads(back.config)["ring_capacity"] == 8
    assert run.Run(frame(spark, WARM), run.Config(delivery.Ring(8)), sim).finish(error="stopped")["result"] == {
        "emit_index_at_end": 14, "pacing_slip_nanos": 0, "canonical_hash": "", "error": "stopped",
    }


def test_requests_and_codes():
    for bad in ({}, {"live": True, "beginning": True}):
        with pytest.raises(errors.named("StartUnset")):
            run.parse_start(bad)
    assert run.parse_start({"emit_index": "7"}) == delivery.emit_index(7)
    with pytest.raises(errors.named("WorkerCount")):
        run.Config(delivery.Ring(2), workers=0)
    codes = {k: run.status_code(errors.named(k)("")) for k in ("ModeUnset", "StartLapped", "SpeedMismatch", "Evicted", "OutOfOrder")}
    assert list(codes.values()) == ["INVALID_ARGUMENT", "OUT_OF_RANGE", "FAILED_PRECONDITION", "ABORTED", "INTERNAL"]
