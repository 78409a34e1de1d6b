import random
import time

import pytest
from pyspark.sql import functions as F

from webframe.streaming.links import first_sightings
from webframe.streaming.runs import ROCKSDB, LateRows, Progress, Run, admit
from webframe.streaming.transfers import Follower, last_states, transfer_states

SECOND = 1_000_000
STALL = 100 * SECOND


def messages(rng, n):
    out, ts = [], 0
    for k in range(n):
        ts += rng.choice([0, 200_000, 900_000, 3 * SECOND, 40 * SECOND, 100 * SECOND, 100 * SECOND + 1, 500 * SECOND])
        kind = rng.choice(["start", "length", "progress", "progress", "progress", "progress", "file", "finished", "failed"])
        out.append((ts, k, kind, rng.choice([0, 1, 7, 1000, 10**12])))
    return out


def closed(rows):
    return [r[:-1] for r in rows if r[3] in ("finished", "failed", "stalled", "abandoned")]


@pytest.mark.parametrize("seed", range(20))
def test_batches_do_not_matter(seed):
    """Messages in any batches, repeated and out of order up to the watermark, give the rows of one batch."""
    rng = random.Random(seed)
    sent = messages(rng, 120)
    end = sent[-1][0] + 10 * STALL
    want = closed(Follower().advance(7, sent, end, STALL))
    assert len(want) > 10 and {r[3] for r in want} == {"finished", "failed", "stalled", "abandoned"}
    late, got, state, now = 60 * SECOND, [], "", -1
    order = sorted(sent, key=lambda m: m[0] + rng.randrange(late))
    while order or now < end:
        batch, order = order[: rng.randrange(1, 20)], order[20:] if not order else order
        order = order[len(batch) :]
        batch = batch + rng.sample(batch, len(batch) // 2)
        follower = Follower.read(state) if state else Follower()
        got += closed(follower.advance(7, [m for m in batch if m[0] > now], now, STALL))
        assert follower.attempt is None or now - follower.attempt.ended <= STALL
        state = follower.text() if follower.attempt or follower.waiting else ""
        now = max(now, max((m[0] for m in batch), default=0) - late - 1) if order or batch else end
    follower = Follower.read(state) if state else Follower()
    got += closed(follower.advance(7, [], end, STALL))
    assert got == want


def test_totals_and_means():
    sent = [(0, 0, "start", 0), (1 * SECOND, 1, "progress", 10), (1 * SECOND + 5, 2, "progress", 5), (3 * SECOND, 3, "progress", 2), (4 * SECOND, 4, "finished", 0)]
    # Rates 15 and 2 have the mean 8, cut; the total is not told.
    assert Follower().advance(1, sent, 10 * SECOND, STALL) == [(1, 0, 4 * SECOND, "finished", 17, 17, 2, 8, 0)]
    told = [(0, 0, "length", 99), (5, 1, "progress", 0), (9, 2, "finished", 0)]
    assert Follower().advance(1, told, SECOND, STALL) == [(1, 0, 9, "finished", 99, 0, 0, 0, 0)]
    running = Follower()
    assert running.advance(1, sent[:3], 2 * SECOND, STALL) == [(1, 0, SECOND + 5, "progress", -1, 15, 1, 15, 0)]
    assert running.advance(1, [], 3 * SECOND, STALL) == []
    assert running.advance(1, [], 102 * SECOND, STALL) == [(1, 0, SECOND + 5, "stalled", -1, 15, 1, 15, 0)]
    assert running.attempt is None and not running.waiting


def _arrive(spark, path, rows, schema):
    time.sleep(0.02)
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(path))


def test_stalled_transfers_are_closed_and_forgotten(spark, tmp_path):
    schema = "transfer_id long, us long, event_id long, kind string, bytes long"
    arrivals = [
        [(1, 0, 0, "start", 0), (2, 1, 1, "start", 0)],
        [(1, 2 * SECOND, 3, "progress", 9), (1, 2 * SECOND, 3, "progress", 9), (1, 1 * SECOND, 2, "length", 50)],
        [(3, 5000 * SECOND, 4, "finished", 0)],
        [(2, 6000 * SECOND, 5, "failed", 0), (3, 9000 * SECOND, 6, "finished", 0)],
    ]
    for rows in arrivals:
        _arrive(spark, tmp_path / "m", rows, schema)
    stream = admit(spark, str(tmp_path / "m"), spark.createDataFrame([], schema).schema, max_files=1)
    # A watermark begins at 1970, and what is not behind it is late.
    stream = stream.withColumn("ts", F.timestamp_micros(F.col("us") + 10**15)).drop("us")
    run = Run("transfers", "update", store=ROCKSDB)
    found = last_states(run.run(transfer_states(stream, "10 seconds", 100)))
    got = {(r.transfer_id, r.phase, r.total, r.downloaded, r.n, r.avg_rate) for r in found.collect()}
    # The last message is not yet behind the watermark.
    assert got == {(1, "stalled", 50, 9, 1, 9), (2, "stalled", -1, 0, 0, 0), (3, "finished", 0, 0, 0, 0), (2, "failed", -1, 0, 0, 0)}
    last = run.progress.batches[max(run.progress.batches)]
    assert len(run.progress.batches) >= 4 and last["kept"] == 1 and run.progress.total("removed") >= 2


def test_sightings_after_a_stop(spark, tmp_path):
    rng = random.Random(2)
    sent = [[(f"s{rng.randrange(3)}", f"u{rng.randrange(40)}") for _ in range(60)] for _ in range(5)]
    for rows in sent:
        _arrive(spark, tmp_path / "u", rows, "site string, url string")
    schema = spark.createDataFrame([], "site string, url string").schema

    def stream():
        return first_sightings(admit(spark, str(tmp_path / "u"), schema, max_files=1), ["site", "url"])

    run = Run("sightings", store=ROCKSDB)
    part = run.run(stream(), stop_after=2).count()
    # A query that is told to stop may have begun one more batch.
    assert 2 <= len(run.progress.batches) < 5 and len(set(sent[0])) <= part < len({k for rows in sent for k in rows})
    again = Run("sightings", folder=run.folder, store=ROCKSDB)
    got = [tuple(r) for r in again.run(stream()).collect()]
    assert sorted(got) == sorted({k for rows in sent for k in rows})
    assert min(again.progress.batches) >= max(run.progress.batches)


def test_late_rows_of_early_batches_are_counted():
    """A query remembers its last hundred batches only."""

    class State:
        numRowsTotal = numRowsRemoved = 0

        def __init__(self, late):
            self.numRowsDroppedByWatermark = late

    class Batch:
        numInputRows = 1

        def __init__(self, k):
            self.batchId, self.stateOperators = k, [State(k == 3)]

    class Query:
        recentProgress = []

    query, progress = Query(), Progress()
    for k in range(500):
        query.recentProgress = [Batch(j) for j in range(max(0, k - 99), k + 1)]
        progress.note(query)
    assert progress.total("late") == 1 and progress.total("rows") == 500


def test_rows_behind_the_watermark_are_an_error(spark, tmp_path):
    schema = "transfer_id long, us long, event_id long, kind string, bytes long"
    for us in (0, 1000 * SECOND, 2000 * SECOND, 5):
        _arrive(spark, tmp_path / "m", [(1, us, us, "progress", 1)], schema)
    stream = admit(spark, str(tmp_path / "m"), spark.createDataFrame([], schema).schema, max_files=1)
    stream = stream.withColumn("ts", F.timestamp_micros("us")).drop("us")
    with pytest.raises(LateRows):
        Run("late", "update").run(transfer_states(stream, "10 seconds", 100))
