"""Streaming detection: score arriving flows, append history, route alerts,
count per event-time window, and track intensity per run with state.

Every sink is written per micro-batch into (run, ``batch_id``) partitions with
dynamic overwrite, so a batch replayed after a failure replaces its own
output instead of duplicating it (exactly-once with the checkpoint).
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from concurrent.futures import Future
from contextlib import contextmanager
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from flowlens.functions.labels import is_benign
from flowlens.functions.levels import LOW_MAX, MEDIUM_MAX
from flowlens.functions.timefn import epoch_ms, ms_to_text
from flowlens.operators.model import score_requests
from flowlens.sources import bundle as versions
from flowlens.sources.records import append_history


def _write_batch(df: DataFrame, path: str, run_id: str, batch_id: int) -> None:
    (df.withColumn("run_id", F.lit(run_id)).withColumn("batch_id", F.lit(int(batch_id))).write.mode("overwrite")
       .option("partitionOverwriteMode", "dynamic").partitionBy("run_id", "batch_id").parquet(path))


def _drain(stream: DataFrame, sink: Callable[[DataFrame, str, int], None], checkpoint: str,
           mode: str = "append") -> None:
    """Run ``sink(batch, run id, batch id)`` over the available input.

    The run id is the query id that Spark keeps in the checkpoint: the same
    after a restart, another one for a new checkpoint, whose batch ids start
    at 0 again.
    """
    run_id: Future[str] = Future()
    q = (stream.writeStream.outputMode(mode)
         .foreachBatch(lambda batch, batch_id: sink(batch, run_id.result(), batch_id))
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    run_id.set_result(str(q.id))
    q.awaitTermination()


def run_detection_stream(stream: DataFrame, score: Callable[[DataFrame], DataFrame],
                         history_path: str, alerts_path: str, checkpoint: str,
                         benign: str = "BENIGN") -> None:
    """Score every arriving row, append it to history and non-benign rows to alerts.

    ``score`` maps the raw stream to detection records (id, ms, timestamp,
    predicted_label, confidence, threat_level, features_count).  Runs until
    the available input is processed.
    """
    scored = score(stream)

    def sink(batch: DataFrame, run_id: str, batch_id: int) -> None:
        batch = batch.persist()
        append_history(batch, history_path, run_id, batch_id)
        _write_batch(batch.filter(~is_benign("predicted_label", benign)), alerts_path, run_id, batch_id)
        batch.unpersist()

    _drain(scored, sink, checkpoint)


def run_request_stream(stream: DataFrame, body: str, id_col: str, ts: str, bundles: str, history_path: str,
                       alerts_path: str, rejects_path: str, checkpoint: str) -> None:
    """Raw JSON requests to detection history: validate, score, append.

    Each micro-batch is scored with the model version that is current when it
    begins (its number is kept in ``model_version``), so a version published
    while the stream runs takes over with the next batch.  Bodies that cannot
    be scored go to ``rejects_path`` with status and message.  History holds
    the requests' event times; a replayed batch replaces its own output.
    """
    loaded: dict[int, versions.Bundle] = {}

    def sink(batch: DataFrame, run_id: str, batch_id: int) -> None:
        spark = batch.sparkSession
        version = versions.current_version(spark, bundles)
        if version not in loaded:
            loaded.clear()
            loaded[version] = versions.load_bundle(spark, bundles, version)
        b = loaded[version]
        rows = batch.select(F.col(id_col).alias("id"), epoch_ms(ts).alias("ms"), F.col(body).alias("__body"))
        scored = score_requests(b.model, rows, "__body", b.contract, b.scaler, b.classes, b.benign, ["id", "ms"])
        scored = scored.withColumn("timestamp", ms_to_text("ms")).withColumn("model_version", F.lit(version)) \
            .withColumn("features_count", F.lit(len(b.contract))).persist()
        good = scored.filter(F.col("status") == "success")
        append_history(good, history_path, run_id, batch_id, extra=("model_version",))
        _write_batch(good.filter(~is_benign("predicted_label", b.benign)).select(
            "id", "ms", "timestamp", "predicted_label", "confidence", "threat_level", "model_version"),
            alerts_path, run_id, batch_id)
        _write_batch(scored.filter(F.col("status") == "error").select("id", "ms", "error", "message"),
                     rejects_path, run_id, batch_id)
        scored.unpersist()

    _drain(stream, sink, checkpoint)


def run_window_counts(stream: DataFrame, ts: str, label: str, benign: str, duration: str,
                      delay: str, out_path: str, checkpoint: str) -> None:
    """Non-benign events per tumbling window with a watermark (update mode).

    Each batch writes the windows it updated; state for a window is dropped
    once the watermark passes its end.
    """
    # event time as an instant (UTC), whatever the source type or session zone
    et = F.timestamp_millis(epoch_ms(ts))
    counts = (stream.filter(~is_benign(label, benign)).withColumn("__et", et).withWatermark("__et", delay)
              .groupBy(F.window(F.col("__et"), duration).alias("w")).agg(F.count(F.lit(1)).alias("count")))

    def sink(batch: DataFrame, run_id: str, batch_id: int) -> None:
        _write_batch(batch.select(F.unix_millis("w.start").alias("window_start_ms"),
                                  F.unix_millis("w.end").alias("window_end_ms"), "count"),
                     out_path, run_id, batch_id)

    _drain(counts, sink, checkpoint, "update")


def latest_window_counts(spark: SparkSession, path: str) -> DataFrame:
    """Final count per window: a run's value from the latest batch that updated
    it; runs (each counts its own input) add up."""
    window = ["window_start_ms", "window_end_ms"]
    latest = spark.read.parquet(path).groupBy(*window, "run_id").agg(F.max_by("count", "batch_id").alias("count"))
    return latest.groupBy(*window).agg(F.sum("count").alias("count"))


#: Rows of the intensity stream, next to the run.
INTENSITY_OUT = (("event_id", T.LongType()), ("ms", T.LongType()), ("count", T.LongType()),
                 ("previous_level", T.StringType()), ("level", T.StringType()), ("kind", T.StringType()))
_LEVELS = np.array(["Low", "Medium", "High"], dtype=object)
#: Arrays are kept as bytes: element by element they would cost more than the counting.
_STATE = T.StructType([
    T.StructField("runs", T.BinaryType()), T.StructField("ranks", T.BinaryType()),
    T.StructField("codes", T.BinaryType()), T.StructField("times", T.BinaryType()),
    T.StructField("counts", T.BinaryType()), T.StructField("ids", T.BinaryType()),
    T.StructField("done", T.LongType()), T.StructField("timer", T.LongType()), T.StructField("groups", T.LongType())])
_BEFORE = -(1 << 62)
_NO_ID = (1 << 63) - 1
#: Groups of runs that share a state (``run_intensity_stream``).
RUN_GROUPS = 64


def _none() -> np.ndarray:
    return np.zeros(0, np.int64)


@dataclass
class Gauge:
    """The live gauges of many runs: per run the distinct event times that still
    count or are still to come, events and first id at each, and the level at
    its last event; for all of them the time up to which rows have been emitted.

    Entries are sorted by run and time; ``codes`` are places in ``runs``."""

    window_ms: int
    low_max: int = LOW_MAX
    medium_max: int = MEDIUM_MAX
    runs: np.ndarray = field(default_factory=_none)
    last_rank: np.ndarray = field(default_factory=_none)
    codes: np.ndarray = field(default_factory=_none)
    times: np.ndarray = field(default_factory=_none)
    counts: np.ndarray = field(default_factory=_none)
    ids: np.ndarray = field(default_factory=_none)
    done: int = _BEFORE

    def add(self, rows: Iterator[pd.DataFrame], run: str = "run") -> None:
        """Take in events of any order: batches are folded to distinct times of a
        run first.  Without a column ``run`` all are of one run."""
        parts = []
        for b in rows:
            if len(b):
                b = pd.DataFrame({"run": b[run] if run in b else 0, "ms": b["ms"], "id": b["event_id"]})
                parts.append(b.groupby(["run", "ms"], dropna=False, sort=False)["id"].agg(n="size", id="min").reset_index())
        if not parts:
            return
        new = pd.concat(parts, ignore_index=True)
        every = pd.concat([pd.Series(self.runs), new["run"]], ignore_index=True) if len(self.runs) else new["run"]
        codes, runs = pd.factorize(every, use_na_sentinel=False)
        self.last_rank = np.append(self.last_rank, np.zeros(len(runs) - len(self.runs), np.int64))
        self.runs = np.asarray(runs)
        code = np.append(self.codes, codes[len(every) - len(new):])
        time, n, first = (np.append(x, new[c].to_numpy(np.int64)) for x, c in (
            (self.times, "ms"), (self.counts, "n"), (self.ids, "id")))
        order = np.lexsort((time, code))
        code, time = code[order], time[order]
        at = np.flatnonzero(np.append(True, (code[1:] != code[:-1]) | (time[1:] != time[:-1])))
        self.codes, self.times = code[at], time[at]
        self.counts, self.ids = np.add.reduceat(n[order], at), np.minimum.reduceat(first[order], at)

    def _count(self, code: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Events of the run in [t - W, t] for every (run, t)."""
        total = np.append(0, np.cumsum(self.counts))
        seen, place = np.unique(self.times, return_inverse=True)
        keys = self.codes * (len(seen) + 1) + place

        def before(t: np.ndarray, side: str) -> np.ndarray:
            return total[np.searchsorted(keys, code * (len(seen) + 1) + np.searchsorted(seen, t, side=side))]

        return before(at, "right") - before(at - self.window_ms, "left")

    def _rank(self, count: np.ndarray) -> np.ndarray:
        return (count > self.low_max).astype(np.int64) + (count > self.medium_max)

    def advance(self, upto: int) -> pd.DataFrame:
        """The rows of all times in (done, upto], in time order; what no later
        time can see is forgotten."""
        new = (self.times > self.done) & (self.times <= upto)
        code = self.codes[new]
        count = self._count(code, self.times[new])
        rank = self._rank(count)
        first = np.append(True, code[1:] != code[:-1])[:len(code)]
        before = np.where(first, self.last_rank[code], np.append(0, rank[:-1])[:len(code)])
        moved = rank != before
        rows = [self._rows(code[moved], self.ids[new][moved], self.times[new][moved], count[moved],
                           before[moved], rank[moved], "change")]
        last = np.append(first[1:], True)[:len(code)]
        self.last_rank[code[last]] = rank[last]

        ends = self.times + self.window_ms + 1
        due = (ends > self.done) & (ends <= upto)
        code, ends = self.codes[due], ends[due]
        count, earlier = self._count(code, ends), self._count(code, ends - 1)
        after, before = self._rank(count), self._rank(earlier)
        for kind, shown in (("decay", (count > 0) & (after < before)), ("cleared", count == 0)):
            rows.append(self._rows(code[shown], np.full(shown.sum(), _NO_ID), ends[shown], count[shown],
                                   before[shown], after[shown], kind))
        self._forget(upto)
        return pd.concat([r for r in rows if len(r)] or rows[:1]).sort_values("ms", kind="stable")

    def _rows(self, code, ids, ms, count, before, after, kind: str) -> pd.DataFrame:
        return pd.DataFrame({
            "run": pd.Series(self.runs[code]), "event_id": pd.array(ids, "Int64"), "ms": ms, "count": count,
            "previous_level": _LEVELS[before], "level": _LEVELS[after], "kind": kind}).assign(
            event_id=lambda r: r["event_id"].mask(ids == _NO_ID))

    def _forget(self, upto: int) -> None:
        """Drop times behind the window, and runs without times whose last level is the first one."""
        kept = self.times + self.window_ms + 1 > upto
        self.codes, self.times, self.counts, self.ids = (
            x[kept] for x in (self.codes, self.times, self.counts, self.ids))
        self.done = upto
        known = self.last_rank > 0
        known[self.codes] = True
        self.codes = (np.cumsum(known) - 1)[self.codes]
        self.runs, self.last_rank = self.runs[known], self.last_rank[known]

    def next_due(self) -> int | None:
        """The first time behind ``done`` at which a row may be due."""
        ends = self.times + self.window_ms + 1
        due = np.concatenate([self.times[self.times > self.done], ends[ends > self.done]])
        return int(due.min()) if len(due) else None


class IntensityProcessor(StatefulProcessor):
    """Keeps a ``Gauge`` per group of runs with an event-time timer at its next
    due time.

    A call, its state and its timer serve all runs of a group, so a batch costs
    groups times a fixed amount and numpy work in proportion to the events, not
    runs times calls.  Events wait in the state until the watermark has passed
    them, so input in any order within the delay gives the rows of ordered
    input.  The state is bounded by the runs' distinct milliseconds of window
    and delay (and one entry for each run last seen above the lowest level), not
    by the events.
    """

    def __init__(self, run: str, schema: T.StructType, window_ms: int, low_max: int, medium_max: int, groups: int) -> None:
        self.run, self.schema, self.groups = run, schema, groups
        self.limits = (window_ms, low_max, medium_max)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("gauge", _STATE)

    def _load(self) -> tuple[Gauge, int | None]:
        if not self.state.exists():
            return Gauge(*self.limits), None
        runs, *arrays, done, timer, groups = self.state.get()
        if groups != self.groups:
            raise ValueError(f"the checkpoint holds {groups} groups of runs, not {self.groups}")
        return Gauge(*self.limits, pickle.loads(runs), *(np.frombuffer(x, np.int64).copy() for x in arrays), done), timer

    def _save(self, gauge: Gauge, timer: int | None) -> None:
        due = gauge.next_due()
        if timer is not None and timer != due:
            self.handle.deleteTimer(timer)
        if due is not None and timer != due:
            self.handle.registerTimer(due)
        # last level and clock stay: a run that comes back goes on from there
        self.state.update((pickle.dumps(gauge.runs), *(x.astype(np.int64).tobytes() for x in (
            gauge.last_rank, gauge.codes, gauge.times, gauge.counts, gauge.ids)), gauge.done, due, self.groups))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        gauge, timer = self._load()
        gauge.add(rows, self.run)
        self._save(gauge, timer)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        gauge, _ = self._load()
        out = gauge.advance(timerValues.getCurrentWatermarkInMs())
        self._save(gauge, None)  # the timer that fired is gone
        if len(out):
            if key[0] == self.groups:
                out["run"] = pd.Series([None] * len(out), out.index, object)
            yield out.rename(columns={"run": self.run})[self.schema.fieldNames()]

    def close(self) -> None:
        pass


@contextmanager
def _state_store(spark: SparkSession, partitions: int | None) -> Iterator[None]:
    """Timers need the RocksDB state store; a new checkpoint fixes its number of
    state partitions.  The session's own settings come back."""
    wanted = {"spark.sql.streaming.stateStore.providerClass":
              "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
    if partitions:
        wanted["spark.sql.shuffle.partitions"] = str(partitions)
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def run_intensity_stream(stream: DataFrame, run: str, ts: str, id_col: str, label: str, benign: str,
                         window_ms: int, out_path: str, checkpoint: str, delay_ms: int = 0,
                         low_max: int = LOW_MAX, medium_max: int = MEDIUM_MAX,
                         state_partitions: int | None = None, groups: int = RUN_GROUPS) -> None:
    """Level rows per run over event time: ``change`` where an event's level
    differs from the level at the run's previous event, ``decay`` where the
    window's end lowers the level, ``cleared`` where it empties the window.

    Rows come once the watermark (``delay_ms`` behind the newest row) has passed
    their time; rows that come later than that are dropped.  Benign rows don't
    count but move the clock: a closing benign row moves the watermark, and the
    batch after it settles what lies behind.  The run may be of any type; rows without a run form a run of their
    own, rows without a time count nowhere.  ``state_partitions`` sizes the state of
    a new checkpoint (by default the session's shuffle partitions).  Runs are dealt by hash
    into ``groups``, each with one state that its task holds whole (take more for more
    events, a few to a state partition at least); a checkpoint keeps the number it began
    with, another one is an error.
    """
    # one condition that names the event time: the optimizer would move a plain
    # filter on the label below the watermark, and benign rows would not move it
    counts = F.when(F.col("__et").isNotNull(), ~is_benign(label, benign)).otherwise(False)
    ev = (stream.withColumn("__et", F.timestamp_millis(epoch_ms(ts))).withWatermark("__et", f"{delay_ms} milliseconds")
          .filter(counts)
          .select(F.col(run), F.coalesce(F.col(id_col).cast("bigint"), F.lit(_NO_ID)).alias("event_id"),
                  epoch_ms(ts).alias("ms"), "__et",
                  # the null run is a group alone
                  F.when(F.col(run).isNull(), F.lit(groups)).otherwise(F.pmod(F.xxhash64(run), F.lit(groups)))
                  .cast("int").alias("__group")))
    kind = ev.schema[run].dataType
    schema = T.StructType([T.StructField(run, kind), *(T.StructField(n, t) for n, t in INTENSITY_OUT)])
    if isinstance(kind, T.IntegralType):  # beside nulls pandas would turn whole numbers into doubles
        ev = ev.withColumn(run, F.coalesce(run, F.lit(0).cast(kind)))
    out = ev.groupBy("__group").transformWithStateInPandas(
        IntensityProcessor(run, schema, window_ms, low_max, medium_max, groups), schema, "append", "EventTime")

    def sink(batch: DataFrame, run_id: str, batch_id: int) -> None:
        _write_batch(batch, out_path, run_id, batch_id)

    with _state_store(stream.sparkSession, state_partitions):
        _drain(out, sink, checkpoint)
