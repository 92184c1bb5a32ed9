"""Compaction of the detection history: bounded files, replays, writers that die."""

import glob
import os

from flowlens.session import scratch_path
from flowlens.sources import records

DAY = 86_400_000


def _batch(spark, ids):
    return spark.createDataFrame([(i, (i % 2) * DAY, "t", "DDoS", 0.9, "High", 1) for i in ids], records.HISTORY_SCHEMA)


def _ids(spark, path):
    return sorted(r.id for r in records.read_history(spark, path).collect())


def test_files_stay_few_and_replays_replace_only_themselves(spark):
    path = scratch_path(spark, "t_history")
    for k in range(12):
        records.append_history(_batch(spark, range(10 * k, 10 * k + 10)).coalesce(1), path, "a", k)
        if k % 3 == 2:
            records.compact_history(spark, path, max_segments=2)
            records.vacuum_history(spark, path)
    records.append_history(_batch(spark, [500]).coalesce(1), path, "b", 0)
    assert _ids(spark, path) == [*range(120), 500]
    files = glob.glob(os.path.join(path, "**", "*.parquet"), recursive=True)
    assert len(files) <= 2 * (2 + 1) + 2 + 1  # a day's segments and open batches
    records.append_history(_batch(spark, range(110, 115)).coalesce(1), path, "a", 11)  # replayed, shorter
    assert _ids(spark, path) == [*range(115), 500]
    days = records.read_history(spark, path, ["1970-01-02"]).collect()
    assert sorted(r.id for r in days) == [i for i in range(115) if i % 2]


def test_a_compaction_that_dies_changes_nothing(spark):
    path = scratch_path(spark, "t_history")
    assert records.compact_history(spark, path) == 0
    for k in range(4):
        records.append_history(_batch(spark, [k]).coalesce(1), path, "a", k)
    assert records.compact_history(spark, path) == 1 and _ids(spark, path) == [0, 1, 2, 3]  # before the vacuum
    records.append_history(_batch(spark, [4]).coalesce(1), path, "a", 4)
    broken = os.path.join(path, "_compacted", "manifests", "00000002.json")
    open(broken, "w").write('{"segments": [')
    assert _ids(spark, path) == [0, 1, 2, 3, 4]
    assert records.compact_history(spark, path) == 3 and _ids(spark, path) == [0, 1, 2, 3, 4]
    assert records.vacuum_history(spark, path) >= 4 and _ids(spark, path) == [0, 1, 2, 3, 4]


def test_one_batch_a_run_is_left_alone(spark):
    path = scratch_path(spark, "t_history")
    for run in ("a", "b"):
        records.append_history(_batch(spark, [1]).coalesce(1), path, run, 0)
    assert records.compact_history(spark, path) == 0 and _ids(spark, path) == [1, 1]
