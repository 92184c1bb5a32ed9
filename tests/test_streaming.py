"""Streaming operators on small hand-made drops (time-ordered files)."""

import datetime as dt
import os
import random

import pandas as pd

from flowlens.session import scratch_path
from flowlens.streaming import detect

W = 10_000


def _drop(spark, root, k, rows):
    df = spark.createDataFrame(rows, "event_id long, user_id string, ts timestamp_ntz, event_type string")
    # one file per drop: a drop is one arrival (one micro-batch with maxFilesPerTrigger=1)
    df.coalesce(1).write.mode("overwrite").parquet(os.path.join(root, f"drop={k:04d}"))
    return df.schema


def _plain_gauge(events, w):
    """(run, ms, count, previous level, level, kind) from all events at once."""
    level = lambda n: "Low" if n <= 5 else "Medium" if n <= 10 else "High"
    out = []
    for run in {r for r, _ in events}:
        times = [t for r, t in events if r == run]
        count = lambda t: sum(t - w <= x <= t for x in times)
        last = "Low"
        for t in sorted(set(times)):
            now = level(count(t))
            if now != last:
                out.append((run, t, count(t), last, now, "change"))
            last = now
        for t in sorted({x + w + 1 for x in times}):
            was, now = level(count(t - 1)), level(count(t))
            if count(t) == 0:
                out.append((run, t, 0, was, now, "cleared"))
            elif ["Low", "Medium", "High"].index(now) < ["Low", "Medium", "High"].index(was):
                out.append((run, t, count(t), was, now, "decay"))
    return sorted(out, key=repr)


def test_intensity_stream_of_disordered_input_with_decay(spark):
    rng = random.Random(4)
    base = dt.datetime(2024, 1, 1)
    start = int(base.replace(tzinfo=dt.timezone.utc).timestamp() * 1000)
    events = [(run, rng.randrange(k * 20_000, (k + 1) * 20_000)) for k in range(4)
              for run, n in (("a", 25), ("b", 8), (None, 12)) for _ in range(n)]
    events += [("burst", 30_000)] * 12 + [("a", 500)] * 3
    rows = [(i, run, base + dt.timedelta(milliseconds=t), "DDoS") for i, (run, t) in enumerate(events)]
    root = scratch_path(spark, "t_stream")
    for k in range(4):  # files of a drop overlap in time
        drop = [r for r, (_, t) in zip(rows, events) if t // 20_000 == k]
        rng.shuffle(drop)
        for half in (0, 1):
            schema = _drop(spark, root, 2 * k + half, drop[half::2] + [(900 + k, "a", base, "BENIGN")])
    for k in range(2):  # moves the watermark; the next batch acts on it
        _drop(spark, root, 8 + k, [(999, "z", base + dt.timedelta(seconds=200), "BENIGN"), (998, "a", None, "DDoS")])
    stream = (spark.readStream.schema(schema).option("maxFilesPerTrigger", 1)
              .option("recursiveFileLookup", "true").parquet(root))
    out, ckpt = scratch_path(spark, "t_out"), scratch_path(spark, "t_ckpt")
    detect.run_intensity_stream(stream, "user_id", "ts", "event_id", "event_type", "BENIGN", W, out, ckpt, 20_000)
    got = [(r.user_id, r.ms - start, r["count"], r.previous_level, r.level, r.kind) for r in spark.read.parquet(out).collect()]
    assert sorted(got, key=repr) == _plain_gauge(events, W)
    assert {k for *_, k in got} == {"change", "decay", "cleared"}


def test_gauge_in_steps_equals_gauge_at_once():
    rng = random.Random(6)
    for _ in range(20):
        times = sorted(rng.randrange(60) for _ in range(rng.randint(1, 60)))
        frame = pd.DataFrame({"ms": times, "event_id": range(len(times))})
        whole, steps = detect.Gauge(9), detect.Gauge(9)
        whole.add(iter([frame]))
        want, got = whole.advance(100), []
        for upto in [*range(0, 100, rng.randint(1, 20)), 100]:
            steps.add(iter([frame[(frame.ms > steps.done) & (frame.ms <= upto)].sample(frac=1, random_state=1)]))
            got.append(steps.advance(upto))
        got = pd.concat(got)
        assert got.values.tolist() == want.values.tolist() or (
            sorted(map(repr, got.fillna(-1).values.tolist())) == sorted(map(repr, want.fillna(-1).values.tolist())))
        assert len(steps.times) == 0 and steps.next_due() is None


def test_gauge_of_many_runs_equals_one_gauge_a_run():
    rng = random.Random(8)
    events = [(rng.choice(["a", "b", "c", None]), rng.randrange(200)) for _ in range(300)]
    frame = pd.DataFrame({"run": [r for r, _ in events], "ms": [t for _, t in events], "event_id": range(len(events))})
    whole, got = detect.Gauge(9, 2, 4), []
    for upto in (40, 90, 300):
        whole.add(iter([frame[(frame.ms > whole.done) & (frame.ms <= upto)].sample(frac=1, random_state=2)]))
        got.append(whole.advance(upto))
    want = []
    for run in ("a", "b", "c", None):
        one = detect.Gauge(9, 2, 4)
        one.add(iter([frame[frame.run.isna() if run is None else frame.run == run]]))
        want.append(one.advance(300))
    key = lambda frames: sorted(repr([None if pd.isna(x) else x for x in r])
                                for f in frames for r in f.values.tolist())
    assert key(got) == key(want) and len(whole.times) == 0


def test_intensity_state_costs_a_call_per_group_not_per_run(spark, monkeypatch):
    base = dt.datetime(2024, 1, 1)
    start = int(base.replace(tzinfo=dt.timezone.utc).timestamp() * 1000)
    big = 2**53 + 1  # whole numbers beside a null stay whole
    events = [(None if k % 50 == 0 else big + k, k * 7) for k in range(500) for _ in range(k % 8 + 1)]
    root = scratch_path(spark, "t_many")
    for k, rows in enumerate((events, [(big, 200_000)], [(big, 200_001)])):
        df = spark.createDataFrame([(i, run, base + dt.timedelta(milliseconds=t), "DDoS" if k == 0 else "BENIGN")
                                    for i, (run, t) in enumerate(rows)],
                                   "event_id long, user_id long, ts timestamp_ntz, event_type string")
        df.coalesce(1).write.mode("overwrite").parquet(os.path.join(root, f"drop={k:04d}"))
    made = spark.sparkContext.accumulator(0)
    load = detect.IntensityProcessor._load

    class Counting(detect.IntensityProcessor):
        def _load(self):
            made.add(1)
            return load(self)

    monkeypatch.setattr(detect, "IntensityProcessor", Counting)
    stream = (spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1)
              .option("recursiveFileLookup", "true").parquet(root))
    out, ckpt = scratch_path(spark, "t_out"), scratch_path(spark, "t_ckpt")
    detect.run_intensity_stream(stream, "user_id", "ts", "event_id", "event_type", "BENIGN", W, out, ckpt, 20_000,
                                state_partitions=2, groups=4)
    got = [(r.user_id, r.ms - start, r["count"], r.previous_level, r.level, r.kind) for r in spark.read.parquet(out).collect()]
    assert sorted(got, key=repr) == _plain_gauge(events, W)
    assert 0 < made.value <= 5 * 2 * 4  # groups, calls, batches; 500 runs
