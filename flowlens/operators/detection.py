"""Detection history, alerts and intensity over event time (batch forms).

Trailing-window counts are prefix sums, never one window over a run:

1. rows are pre-aggregated to distinct (run, time) with a weight (map-side);
2. each distinct time t gets a probe at t - W - 1, so that
   count(t) = C(<= t) - C(<= t - W - 1), C being the run's running total;
3. running totals are computed per (run, time range) of fixed width R, with
   each range's offset taken from a per-run prefix sum over range totals.

Every sort therefore holds at most R distinct times, however skewed a run
is (one attacker holding a third of all flows inside one window included),
and the result is exact.  ``level_changes`` uses the same ranges for its
``lag``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlens.functions.labels import is_benign
from flowlens.functions.levels import LOW_MAX, MEDIUM_MAX, intensity_level
from flowlens.functions.timefn import epoch_ms
from flowlens.operators._small import join_null_safe, materialize

_LEVEL_RANK = {"Low": 0, "Medium": 1, "High": 2}


# Ticks generated per task when a run's timeline is laid out.
TICK_CHUNK = 1_000_000
# Ticks of a run whose running counts are summed in one task.
TICK_RANGE = 100_000


def _cut(df: DataFrame) -> DataFrame:
    """Written once to the shared checkpoint folder: cuts lineage for a table read twice."""
    return materialize(df, "times")


def _level_rank(c: Column) -> Column:
    return (F.when(c == "Low", 0).when(c == "Medium", 1).when(c == "High", 2))


def _parts(run: str | None) -> list:
    return [F.col(run)] if run else []


def top_n(df: DataFrame, n: int, order: list[Column]) -> DataFrame:
    """Newest-first style top-n: a TakeOrdered (per-partition heaps, n rows merged)."""
    return df.orderBy(*order).limit(n)


def top_n_per_key(df: DataFrame, key: str, n: int, order: list[Column], salt_col: str,
                  salts: int = 16) -> DataFrame:
    """Exact top-n per key, skew-safe: top-n per (key, salt) first, then per key.

    A key holding a third of all rows is ranked in ``salts`` tasks; the second
    step sees at most ``salts x n`` rows per key.
    """
    salted = df.withColumn("__salt", F.pmod(F.xxhash64(F.col(salt_col)), F.lit(salts)))
    w1 = Window.partitionBy(key, "__salt").orderBy(*order)
    stage1 = salted.withColumn("__r", F.row_number().over(w1)).filter(F.col("__r") <= n)
    w2 = Window.partitionBy(key).orderBy(*order)
    return (stage1.withColumn("rank", F.row_number().over(w2)).filter(F.col("rank") <= n)
                  .drop("__salt", "__r"))


def recent_history(history: DataFrame, ts: str, id_col: str, n: int = 100) -> DataFrame:
    """Newest ``n`` detections; level is repeated as ``level`` and ``threat_level``."""
    top = top_n(history, n, [F.desc(ts), F.desc(id_col)])
    return top.select(F.col("timestamp"), F.col("predicted_label").alias("type"), "confidence",
                      F.col("threat_level").alias("level"), "threat_level", F.col(ts), F.col(id_col))


def recent_alerts(history: DataFrame, ts: str, id_col: str, benign: str = "BENIGN",
                  n: int = 50, run: str | None = None) -> DataFrame:
    """Newest ``n`` non-benign detections (globally, or per run when given)."""
    alerts = history.filter(~is_benign("predicted_label", benign))
    order = [F.desc(ts), F.desc(id_col)]
    top = (top_n_per_key(alerts, run, n, order, id_col) if run else top_n(alerts, n, order))
    cols = [F.col("timestamp"), F.col("predicted_label").alias("type"), "confidence",
            F.col("threat_level").alias("level"), F.col(ts), F.col(id_col)]
    return top.select(*(_parts(run) + cols))


def top_probabilities(df: DataFrame, probs: str, class_names: list[str] | None = None,
                      n: int = 5, min_p: float = 0.01, keep: list[str] | None = None) -> DataFrame:
    """Classes with probability > min_p, descending, first n (ties in class order).

    Returns long rows (keep..., position, class_idx, label, probability).
    """
    tagged = F.transform(F.col(probs), lambda p, i: F.struct((-p).alias("neg"), i.alias("class_idx"),
                                                             p.alias("probability")))
    kept = F.filter(tagged, lambda s: s["probability"] > F.lit(min_p))
    top = F.slice(F.array_sort(kept), 1, n)
    rows = df.select(*[F.col(k) for k in (keep or [])], F.posexplode(top).alias("pos", "__s"))
    label = (F.element_at(F.array(*[F.lit(c) for c in class_names]), F.col("__s.class_idx") + 1)
             if class_names else F.col("__s.class_idx").cast("string"))
    return rows.select(*[F.col(k) for k in (keep or [])], (F.col("pos") + 1).alias("position"),
                       F.col("__s.class_idx").alias("class_idx"), label.alias("label"),
                       F.col("__s.probability").alias("probability"))


RANGE_MS = 60_000


def trailing_by_time(df: DataFrame, run: str | None, ms: str, window_ms: int,
                     weight: Column | None = None, range_ms: int = RANGE_MS,
                     carry: dict[str, Column] | None = None) -> DataFrame:
    """Per distinct (run, time): total weight of rows with time in [t - W, t].

    Rows without a time are in no window; rows without a run form a run of their own.
    Returns (run, ``ms``, count, *carry) where ``carry`` maps output names to
    aggregates over the rows at that time (e.g. the first event id); join it
    back to the rows on (run, ms) when per-row output is needed.
    """
    rc = _parts(run)
    rn = [run] if run else []
    carry = carry or {}
    w = F.lit(1).cast("long") if weight is None else weight.cast("long")
    times = df.filter(F.col(ms).isNotNull()).groupBy(*rc, F.col(ms).alias("__t")).agg(
        F.sum(w).alias("__n"), *[agg.alias(name) for name, agg in carry.items()])
    # the distinct-times table is read twice (range totals, then running sums):
    # write it once to the shared checkpoint folder instead of rescanning the source
    times = _cut(times)
    nulls = [F.lit(None).cast(times.schema[name].dataType).alias(name) for name in carry]
    point = F.struct(F.col("__t").alias("__t"), F.col("__n").alias("__n"), F.lit(0).alias("__kind"),
                     *[F.col(name).alias(name) for name in carry])
    probe = F.struct((F.col("__t") - F.lit(window_ms + 1)).alias("__t"), F.lit(0).cast("long").alias("__n"),
                     F.lit(1).alias("__kind"), *nulls)
    u = (times.select(*rn, F.col("__t").alias("__origin"), F.explode(F.array(point, probe)).alias("__p"))
              .select(*rn, "__origin", "__p.*")
              .withColumn("__range", F.floor(F.col("__t") / F.lit(range_ms)).cast("bigint")))
    per_range = u.groupBy(*rn, "__range").agg(F.sum("__n").alias("__rn"))
    before = (Window.partitionBy(*rn) if rn else Window.partitionBy()).orderBy("__range") \
        .rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_range.select(*rn, "__range", F.coalesce(F.sum("__rn").over(before), F.lit(0)).alias("__off"))
    within = Window.partitionBy(*rn, "__range").orderBy("__t", "__kind") \
                   .rowsBetween(Window.unboundedPreceding, 0)
    c = (join_null_safe(u, offsets, rn + ["__range"])
          .withColumn("__c", F.col("__off") + F.sum("__n").over(within)))
    # each origin has one event row and one probe row: fold them in one aggregate
    signed = F.when(F.col("__kind") == 0, F.col("__c")).otherwise(-F.col("__c"))
    return c.groupBy(*rn, F.col("__origin").alias(ms)).agg(
        F.sum(signed).alias("count"), *[F.max(name).alias(name) for name in carry])


def trailing_count(df: DataFrame, run: str | None, ms: str, window_ms: int,
                   counted: Column | None = None, out: str = "count",
                   range_ms: int = RANGE_MS) -> DataFrame:
    """Each row plus the number of rows (or rows where ``counted``) of its run
    with time in [t - W, t], inclusive of rows at the same time; null for a row
    without a time."""
    counts = trailing_by_time(df, run, ms, window_ms, counted, range_ms).withColumnRenamed("count", out)
    return join_null_safe(df, counts, ([run] if run else []) + [ms], "left")


def sliding_attack_times(df: DataFrame, run: str | None, ts: str, label: str, benign: str,
                         window_ms: int, id_col: str, low_max: int = LOW_MAX,
                         medium_max: int = MEDIUM_MAX) -> DataFrame:
    """Per distinct (run, ms) of non-benign events: trailing count, level and the
    first event id at that time (the input of ``level_changes``)."""
    ev = df.filter(~is_benign(label, benign)).withColumn("ms", epoch_ms(ts))
    t = trailing_by_time(ev, run, "ms", window_ms, carry={id_col: F.min(id_col)})
    return t.withColumn("level", intensity_level("count", low_max, medium_max))


def sliding_attack_count(df: DataFrame, run: str | None, ts: str, label: str, benign: str,
                         window_ms: int, low_max: int = LOW_MAX,
                         medium_max: int = MEDIUM_MAX) -> DataFrame:
    """Per non-benign event: non-benign events of the run in the trailing window."""
    ev = df.filter(~is_benign(label, benign)).withColumn("ms", epoch_ms(ts))
    counted = trailing_count(ev, run, "ms", window_ms, out="count")
    return counted.withColumn("level", intensity_level("count", low_max, medium_max))


def level_changes(counted: DataFrame, run: str | None, ms: str, id_col: str,
                  range_ms: int = RANGE_MS) -> DataFrame:
    """Events whose level differs from the previous event's level of the run.

    The first event compares with ``Low``.  Events at the same time share a
    count and level, so a change can only happen at the first event of a
    distinct time; the previous level is the level at the run's previous
    distinct time (``lag`` inside a time range, and for the first time of a
    range the last level of the closest earlier range).
    """
    rn = [run] if run else []
    times = _cut(counted.groupBy(*[F.col(c) for c in rn], F.col(ms))
                 .agg(F.min(id_col).alias(id_col), F.max("count").alias("count"), F.max("level").alias("level"))
                 .withColumn("__range", F.floor(F.col(ms) / F.lit(range_ms)).cast("bigint")))
    w = Window.partitionBy(*rn, "__range").orderBy(ms)
    x = times.withColumn("__lag", F.lag("level").over(w))
    last = times.groupBy(*rn, "__range").agg(F.max_by("level", F.col(ms)).alias("__last"))
    wb = (Window.partitionBy(*rn) if rn else Window.partitionBy()).orderBy("__range")
    prev = last.withColumn("__prev_range", F.lag("__last").over(wb)).drop("__last")
    y = join_null_safe(x, prev, rn + ["__range"], "left")
    previous = F.coalesce(F.col("__lag"), F.col("__prev_range"), F.lit("Low"))
    y = y.withColumn("previous_level", previous).filter(F.col("previous_level") != F.col("level"))
    direction = F.when(_level_rank(F.col("level")) > _level_rank(F.col("previous_level")),
                       F.lit("up")).otherwise(F.lit("down"))
    return y.withColumn("direction", direction).drop("__lag", "__prev_range", "__range")


def window_frequency(df: DataFrame, ts: str, label: str, benign: str, duration: str,
                     run: str | None = None) -> DataFrame:
    """Non-benign events per tumbling window (per run when given) and its level."""
    ev = df.filter(~is_benign(label, benign))
    g = ev.groupBy(*(_parts(run) + [F.window(F.col(ts), duration).alias("w")])) \
          .agg(F.count(F.lit(1)).alias("count"))
    return g.select(*(_parts(run)), epoch_ms(F.col("w.start")).alias("window_start_ms"),
                    epoch_ms(F.col("w.end")).alias("window_end_ms"), "count",
                    intensity_level("count").alias("level"))


def intensity_timeline(df: DataFrame, run: str, ts: str, label: str, benign: str,
                       window_ms: int, tick_ms: int) -> DataFrame:
    """Trailing non-benign count sampled at fixed ticks, down to zero after decay.

    An event at t is counted at every tick in [t, t + W]; the ticks of a run
    span from its first event to the first tick after the last event's window.
    Events are pre-aggregated by the tick span they cover; a span adds its
    events at its first tick and takes them off behind its last one, and the
    counts are running sums over ranges of ticks.
    """
    ev = df.filter(~is_benign(label, benign)).select(F.col(run), epoch_ms(ts).alias("ms"))
    first_tick = F.ceil(F.col("ms") / F.lit(tick_ms)).cast("bigint")
    last_tick = F.floor((F.col("ms") + F.lit(window_ms)) / F.lit(tick_ms)).cast("bigint")
    # events with the same (first, last) tick cover the same ticks: count them
    # first (map-side), then fan out groups instead of rows
    # written once: the tick counts and the run spans both read it, so the
    # events are scanned once
    spans = materialize(ev.groupBy(F.col(run), first_tick.alias("__a"), last_tick.alias("__z"))
                          .agg(F.count(F.lit(1)).alias("__n")), "timeline_spans")
    # +n at the first tick, -n behind the last: two rows per span
    steps = spans.select(F.col(run), F.explode(F.array(
        F.struct(F.col("__a").alias("tick"), F.col("__n").alias("__s")),
        F.struct((F.col("__z") + 1).alias("tick"), (-F.col("__n")).alias("__s")))).alias("__p")) \
        .groupBy(run, F.col("__p.tick").alias("tick")).agg(F.sum("__p.__s").alias("__s"))
    # a run's ticks: from its first event's first tick to one past its last
    # event's last tick; both are monotonic in ms, so the span table (not a
    # second scan of the events) gives them
    span = spans.groupBy(run).agg(F.min("__a").alias("__lo"), (F.max("__z") + 1).alias("__hi"))
    # a long-lived run has many ticks: generate them in chunks spread over
    # tasks (chunk ids first, ticks inside each chunk second)
    chunk = F.lit(TICK_CHUNK)
    chunks = span.select(F.col(run), "__lo", "__hi", F.explode(F.sequence(
        F.floor(F.col("__lo") / chunk).cast("bigint"), F.floor(F.col("__hi") / chunk).cast("bigint")))
        .alias("__c")).repartition(run, "__c")
    domain = chunks.select(F.col(run), F.explode(F.sequence(
        F.greatest(F.col("__lo"), F.col("__c") * chunk),
        F.least(F.col("__hi"), (F.col("__c") + 1) * chunk - 1))).alias("tick"))
    # running sums per (run, range of ticks); a range starts from the ranges before it
    tick_range = F.floor(F.col("tick") / F.lit(TICK_RANGE)).cast("bigint")
    steps = materialize(steps.withColumn("__r", tick_range), "timeline_steps")
    totals = domain.select(F.col(run), tick_range.alias("__r")).distinct()
    totals = join_null_safe(totals, steps.groupBy(run, "__r").agg(F.sum("__s").alias("__t")), [run, "__r"], "left")
    before = Window.partitionBy(run).orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(F.col(run), "__r", F.coalesce(F.sum("__t").over(before), F.lit(0)).alias("__off"))
    out = join_null_safe(domain, steps.drop("__r"), [run, "tick"], "left").withColumn("__r", tick_range)
    out = join_null_safe(out, offsets, [run, "__r"])
    within = Window.partitionBy(run, "__r").orderBy("tick").rowsBetween(Window.unboundedPreceding, 0)
    out = out.withColumn("count", F.col("__off") + F.coalesce(F.sum("__s").over(within), F.lit(0)))
    return out.select(F.col(run), (F.col("tick") * F.lit(tick_ms)).alias("tick_ms"), "count",
                      intensity_level("count").alias("level"))


def live_log(df: DataFrame, label: str, confidence: str, threat: str) -> DataFrame:
    """Dashboard log rows: message, confidence text and success/danger type."""
    return df.withColumn("message", F.concat(F.lit("DETECTED: "), F.col(label))) \
             .withColumn("confidence_text", F.concat(F.lit("(Conf: "),
                                                     F.format_string("%.4f", F.col(confidence) * 100),
                                                     F.lit("%)"))) \
             .withColumn("type", F.when(F.col(threat) == F.lit("None"), F.lit("success"))
                         .otherwise(F.lit("danger")))


def event_log(detections: DataFrame, changes: DataFrame, run: str, ms: str, id_col: str, label: str,
              confidence: str, threat: str, window_s: int) -> DataFrame:
    """The dashboard's log: detection rows merged with level-change rows.

    Both streams of rows share one order, (``ms``, ``id``, ``entry``): at a
    time, an event's detection comes before the level change it brings about.
    A plain union; nothing is joined or sorted here.  ``changes`` comes from
    ``level_changes``.
    """
    seen = live_log(detections, label, confidence, threat).select(
        run, ms, F.col(id_col).alias("id"), F.lit(0).alias("entry"), "message", "confidence_text", "type")
    # fixed text, equal to the dashboard's
    alert = F.format_string(f"[ALERT] Traffic intensity escalated to <b>%s</b> ({window_s}s non-BENIGN count=%d)",
                            F.col("level"), F.col("count"))
    moved = changes.select(
        run, ms, F.col(id_col).alias("id"), F.lit(1).alias("entry"), alert.alias("message"),
        F.lit(None).cast("string").alias("confidence_text"),
        F.when(F.col("level") == "High", "danger").otherwise("info").alias("type"))
    return seen.unionByName(moved)


def display_threat(df: DataFrame, run: str, ts: str, label: str, benign: str, threat: str,
                   window_ms: int) -> DataFrame:
    """Intensity level while a run is active (a non-benign event in the trailing
    window), else the model's threat level, else ``Idle``."""
    x = df.withColumn("ms", epoch_ms(ts))
    counted = trailing_count(x, run, "ms", window_ms, counted=~is_benign(label, benign),
                             out="active_count")
    shown = F.when(F.col("active_count") > 0, intensity_level("active_count")) \
             .otherwise(F.coalesce(F.col(threat), F.lit("Idle")))
    return counted.withColumn("display_threat", shown)
