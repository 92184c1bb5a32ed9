"""Seeded sampling, quotas and splits, exact and skew-safe.

All draws are defined by ``md5(seed|key)`` (see ``functions.digest``), so the
result does not depend on partitioning or on task retries, and the same
numbers come out of plain SQL.

Ranking a group by digest is done in two levels so that a label holding a
third of all rows is never sorted in one task: rows are bucketed by the
digest's leading hex digits, bucket sizes are counted (a small table), their
prefix sums give each bucket's offset, and ``row_number`` runs inside each
(group, bucket) only.

The bucket table is also a directory from ranks to buckets.  Draws look up
their buckets in it, and only rows of those buckets are shuffled and ranked
(``rows_at``).  A split needs one order statistic a label: ``kth_digests``
selects it from bucket counts, and the rows are then compared with it where
they stand, without a shuffle.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlens.functions.digest import digest_int, draw_rank, order_digest
from flowlens.functions.labels import is_benign
from flowlens.functions.levels import MODE_INTERVAL_MS, intensity_level
from flowlens.operators._small import MAX_BROADCAST_ROWS, join_null_safe, materialize, materialize_small

_ALL = "__all__"
# Rows per sorted (group, bucket) above which group_rank deepens its buckets,
# and the deepest bucket key (16^8 buckets per group).
TARGET_BUCKET_ROWS = 2_000_000
MAX_BUCKET_HEX = 8
# Draws per bucket of a rank directory, and its deepest bucket key.
DRAWS_PER_BUCKET = 1 / 4
MAX_DIRECTORY_HEX = 6
# Hex digits of a whole digest.
DIGEST_HEX = 32
# With-replacement draws generated per task (a quota is split into chunks).
DRAW_CHUNK = 1_000_000


def _group_col(group: str | None) -> Column:
    return F.col(group) if group else F.lit(_ALL)


def bucket_counts(df: DataFrame, group: str | None, keys: list[str], seed=42,
                  bucket_hex: int = 3) -> DataFrame:
    """Rows per (group, digest bucket): one aggregate pass with map-side combine.

    The result (at most groups x 16^bucket_hex rows) is all that ranks,
    quotas and label dictionaries need, so one pass can feed all three.
    """
    d = df.select(_group_col(group).alias("__g"),
                  digest_int(order_digest(seed, *keys), bucket_hex).alias("__b"))
    return d.groupBy("__g", "__b").agg(F.count(F.lit(1)).alias("__n"))


def bucket_sizes(df: DataFrame, group: str | None, keys: list[str], seed=42,
                 bucket_hex: int = 3, counts: DataFrame | None = None) -> DataFrame:
    """Per (group, bucket): row count and the offset of the bucket inside its group.

    ``counts`` may carry a precomputed ``bucket_counts`` table (same seed,
    keys and bucket_hex) to skip the counting pass.
    """
    if counts is None:
        counts = bucket_counts(df, group, keys, seed, bucket_hex)
    w = Window.partitionBy("__g").orderBy("__b")
    return (counts
            .withColumn("__off", F.coalesce(F.sum("__n").over(
                w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
            .withColumn("__gsize", F.sum("__n").over(Window.partitionBy("__g"))))


def group_rank(df: DataFrame, group: str | None, keys: list[str], seed=42,
               max_rank: int | None = None, bucket_hex: int = 3,
               rank_col: str = "rank", counts: DataFrame | None = None,
               wanted: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """1-based rank of each row inside its group by the seeded digest order.

    Returns (ranked rows, sizes) where sizes holds ``group`` -> ``group_size``
    (broadcast-hinted when its row count is within the limit).
    With ``max_rank`` only buckets that can hold ranks <= max_rank are sorted;
    with ``wanted`` (group, rank) only buckets that hold one of its ranks.

    The bucket depth adapts to the data: when the largest bucket that would
    be sorted holds more than ``TARGET_BUCKET_ROWS`` rows (a group with a
    third of a very large table), the counts are taken again with more
    digest digits.  Ranks do not change (buckets are digest prefixes, so they
    follow the same order); only the size of each sort does.
    """
    while True:
        sizes = bucket_sizes(df, group, keys, seed, bucket_hex, counts)
        if max_rank is not None:
            sizes = sizes.filter(F.col("__off") < F.lit(max_rank))
        if wanted is not None:
            sizes = _holding(sizes, wanted, group)
        sizes = materialize(sizes, "bucket_sizes")
        n, largest = sizes.agg(F.count(F.lit(1)), F.max("__n")).first()
        if not largest or largest <= TARGET_BUCKET_ROWS or bucket_hex >= MAX_BUCKET_HEX:
            break
        bucket_hex = min(MAX_BUCKET_HEX, bucket_hex + math.ceil(math.log(largest / TARGET_BUCKET_ROWS, 16)))
        counts = None   # counts at the old depth no longer apply
    sizes_b = F.broadcast(sizes) if n <= MAX_BROADCAST_ROWS else sizes
    digest = order_digest(seed, *keys)
    rows = (df.withColumn("__g", _group_col(group))
              .withColumn("__d", digest)
              .withColumn("__b", digest_int(F.col("__d"), bucket_hex)))
    joined = join_null_safe(rows, sizes_b, ["__g", "__b"])
    w = Window.partitionBy("__g", "__b").orderBy("__d")
    ranked = joined.withColumn(rank_col, (F.col("__off") + F.row_number().over(w)).cast("bigint"))
    if max_rank is not None:
        ranked = ranked.filter(F.col(rank_col) <= F.lit(max_rank))
    ranked = ranked.withColumn("group_size", F.col("__gsize")).drop("__g", "__b", "__d", "__n",
                                                                     "__off", "__gsize")
    group_sizes = sizes.groupBy(F.col("__g").alias("__g")).agg(F.max("__gsize").alias("group_size"))
    # at most n rows: the size check made for the bucket table covers it
    return ranked, (F.broadcast(group_sizes) if n <= MAX_BROADCAST_ROWS else group_sizes)


def _holding(sizes: DataFrame, wanted: DataFrame, group: str | None) -> DataFrame:
    """The buckets that hold a wanted rank: in the order of places in the group,
    the last bucket that begins at or before it."""
    begins = sizes.select("__g", F.col("__off").alias("__at"), F.lit(0).alias("__kind"), "__b")
    asked = wanted.select(_group_col(group).alias("__g"), (F.col("rank") - 1).alias("__at"),
                          F.lit(1).alias("__kind"), F.lit(None).cast("bigint").alias("__b")).distinct()
    order = Window.partitionBy("__g").orderBy("__at", "__kind")
    found = begins.unionByName(asked).withColumn("__b", F.last("__b", ignorenulls=True).over(order))
    hit = found.filter(F.col("__kind") == 1).select("__g", "__b").distinct()
    return join_null_safe(sizes, hit, ["__g", "__b"], "left_semi")


def directory_depth(n_draws: int) -> int:
    """Hex digits of a directory in which ``n_draws`` touch a small share of the buckets."""
    return min(MAX_DIRECTORY_HEX, max(3, math.ceil(math.log(max(1, n_draws) / DRAWS_PER_BUCKET, 16))))


def group_sizes(counts: DataFrame) -> DataFrame:
    """(``__g``, group_size) of a ``bucket_counts`` table."""
    return counts.groupBy("__g").agg(F.sum("__n").alias("group_size"))


def rows_at(df: DataFrame, group: str | None, keys: list[str], draws: DataFrame, seed=42,
            counts: DataFrame | None = None, bucket_hex: int = 3) -> DataFrame:
    """The row at each wanted rank: the rows' columns and those of ``draws``,
    which holds (group, rank, ...).

    Up to MAX_BROADCAST_ROWS draws look up their buckets in the directory, and
    only rows of these buckets reach the shuffle; more draws touch most buckets
    anyway, and all are ranked.  Draws without a group meet rows without one.
    """
    draws, n = materialize_small(draws)
    ranked, _ = group_rank(df, group, keys, seed, bucket_hex=bucket_hex, counts=counts,
                           wanted=draws if n <= MAX_BROADCAST_ROWS else None)
    return attach_draw(ranked.drop("group_size"), draws, group, n)


def attach_draw(ranked: DataFrame, draws: DataFrame, group: str | None, n: int | None = None) -> DataFrame:
    """The row picked by each draw: null-safe equi-join on (group, rank).

    ``ranked`` comes from ``group_rank``; ``draws`` holds (group, rank, ...),
    ``n`` is its row count if it is written already.
    """
    if n is None:
        draws, n = materialize_small(draws)
    draws = F.broadcast(draws) if n <= MAX_BROADCAST_ROWS else draws
    return join_null_safe(ranked, draws, [group, "rank"] if group else ["rank"])


def kth_digests(df: DataFrame, group: str, keys: list[str], ranks: DataFrame, counts: DataFrame,
                seed=42, bucket_hex: int = 3) -> tuple[DataFrame, bool]:
    """Per group the digest at its rank: (``__g``, ``__d``, ``__need``, ``__tied``),
    where ``__need`` of the ``__tied`` rows with that digest are within the rank;
    and whether a rank falls among tied rows.

    ``ranks`` holds (``__g``, ``__k``), at most MAX_BROADCAST_ROWS groups,
    ``counts`` is the ``bucket_counts`` table.  Each step keeps the one bucket a group whose
    offsets enclose the rank and counts only its rows by more digest digits,
    until a bucket is one digest; no row is sorted.
    """
    sizes = bucket_sizes(df, group, keys, seed, bucket_hex, counts)
    prefix = F.lower(F.lpad(F.hex("__b"), bucket_hex, "0"))
    at = join_null_safe(sizes.select("__g", prefix.alias("__p"), "__n", "__off"), ranks, ["__g"])
    rows = df.select(_group_col(group).alias("__g"), order_digest(seed, *keys).alias("__d"))
    depth = bucket_hex
    while True:
        at = at.filter((F.col("__off") < F.col("__k")) & (F.col("__k") <= F.col("__off") + F.col("__n"))) \
               .select("__g", "__p", "__n", (F.col("__k") - F.col("__off")).alias("__k"))
        kept = at.collect()  # a row a group, which the caller has checked for a broadcast
        at = df.sparkSession.createDataFrame(kept, at.schema)
        if depth == DIGEST_HEX:
            return (at.select("__g", F.col("__p").alias("__d"), F.col("__k").alias("__need"), F.col("__n").alias("__tied")),
                    any(r["__k"] < r["__n"] for r in kept))
        largest = max((r["__n"] for r in kept), default=0)
        deeper = DIGEST_HEX if largest <= TARGET_BUCKET_ROWS else min(DIGEST_HEX, depth + 4)
        inside = join_null_safe(rows.withColumn("__p", F.substring("__d", 1, depth)),
                                F.broadcast(at.drop("__n")), ["__g", "__p"])
        counted = inside.groupBy("__g", "__k", F.substring("__d", 1, deeper).alias("__p")).agg(F.count(F.lit(1)).alias("__n"))
        before = Window.partitionBy("__g").orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
        at = counted.withColumn("__off", F.coalesce(F.sum("__n").over(before), F.lit(0)))
        depth = deeper


def top_per_group(df: DataFrame, group: str | None, keys: list[str], n: int,
                  seed=42) -> DataFrame:
    """Up to n rows per group without replacement (seeded)."""
    ranked, _ = group_rank(df, group, keys, seed, max_rank=n)
    return ranked


def sample_rows(df: DataFrame, keys: list[str], n: int, seed=42) -> DataFrame:
    """n rows: without replacement when the table has n rows, else with replacement."""
    # the bucket counts give the total and serve the ranking: one counting pass
    counts, _ = materialize_small(bucket_counts(df, None, keys, seed))
    total = counts.agg(F.sum("__n")).first()[0] or 0
    if total >= n:
        ranked, _ = group_rank(df, None, keys, seed, max_rank=n, counts=counts)
        return ranked.withColumn("draw_no", F.col("rank"))
    if total == 0:
        return df.limit(0).withColumn("rank", F.lit(None).cast("bigint")) \
                 .withColumn("group_size", F.lit(None).cast("bigint")) \
                 .withColumn("draw_no", F.lit(None).cast("bigint"))
    ranked, _ = group_rank(df, None, keys, seed, counts=counts)
    spark = df.sparkSession
    draws = (spark.range(1, n + 1).select(F.col("id").alias("draw_no"))
             .withColumn("rank", draw_rank(seed, F.lit(_ALL), F.col("draw_no"), F.lit(total))))
    return attach_draw(ranked, draws, None)


def quota_proportional(df: DataFrame, label: str, total_n: int) -> DataFrame:
    """Quota = half-even round of share x N; the remainder goes to the largest label."""
    counts = df.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("count"))
    whole = Window.partitionBy()
    q = (counts
         .withColumn("share", F.col("count") / F.sum("count").over(whole))
         .withColumn("raw_quota", F.bround(F.col("share") * F.lit(total_n), 0).cast("bigint"))
         .withColumn("__top", F.row_number().over(
             Window.orderBy(F.desc("count"), F.asc("label"))) == 1)
         .withColumn("quota", F.col("raw_quota") + F.when(
             F.col("__top"), F.lit(total_n) - F.sum("raw_quota").over(whole)).otherwise(0)))
    return q.select("label", "count", "share", "quota")


def quota_reweight(weights: DataFrame, label: str, weight: str, total_n: int,
                   zero_label: str | None = None) -> DataFrame:
    """Weights renormalised to N after zeroing one label; quotas truncated (floor)."""
    w = weights.select(F.col(label).alias("label"), F.col(weight).cast("double").alias("weight"))
    if zero_label is not None:
        w = w.withColumn("weight", F.when(F.col("label") == F.lit(zero_label), F.lit(0.0))
                         .otherwise(F.col("weight")))
    w = w.filter(F.col("weight") > 0)
    total = F.sum("weight").over(Window.partitionBy())
    return w.select("label", "weight",
                    F.floor(F.col("weight") / total * F.lit(float(total_n))).cast("bigint").alias("quota"))


def stratified_sample(df: DataFrame, label: str, keys: list[str], quotas: DataFrame,
                      seed=42, quota_col: str = "quota") -> tuple[DataFrame, DataFrame]:
    """Draw ``quota`` rows per label with replacement.

    Returns (sample, missing): labels with a quota but no rows come back in
    ``missing`` instead of failing the job.  A null label is a label.
    """
    # quotas usually come from a scan (label counts): written once, the depth of
    # the directory, the draws and the missing labels all read this table
    asked, _ = materialize_small(quotas.select(
        F.col("label").alias("__g"), F.col(quota_col).cast("bigint").alias("__q")).filter(F.col("__q") > 0))
    bucket_hex = directory_depth(asked.agg(F.sum("__q")).first()[0] or 0)
    counts = materialize(bucket_counts(df, label, keys, seed, bucket_hex), "directory")
    q, _ = materialize_small(join_null_safe(asked, group_sizes(counts), ["__g"], "left"))
    missing = q.filter(F.col("group_size").isNull()).select(
        F.col("__g").alias("label"), F.col("__q").alias("quota"))
    # draws are generated in chunks of DRAW_CHUNK: the chunk list is spread
    # over tasks first, so a huge quota never comes out of one task
    chunks = (q.filter(F.col("group_size").isNotNull())
               .select("__g", "group_size", "__q",
                       F.explode(F.sequence(F.lit(0).cast("bigint"),
                                            F.floor((F.col("__q") - 1) / F.lit(DRAW_CHUNK)).cast("bigint")))
                        .alias("__chunk")))
    n_chunks = chunks.select(F.sum(F.ceil(F.col("__q") / F.lit(DRAW_CHUNK)))).first()[0] or 0
    if n_chunks > 1:
        chunks = chunks.repartition(max(1, min(int(n_chunks), df.sparkSession.sparkContext.defaultParallelism * 4)),
                                    "__g", "__chunk")
    first = F.col("__chunk") * F.lit(DRAW_CHUNK) + F.lit(1)
    last = F.least(F.col("__q"), (F.col("__chunk") + F.lit(1)) * F.lit(DRAW_CHUNK))
    draws = (chunks.select("__g", "group_size", F.explode(F.sequence(first, last)).alias("draw_no"))
              .withColumn("rank", draw_rank(seed, F.col("__g"), F.col("draw_no"), F.col("group_size")))
              .select(F.col("__g").alias(label), "draw_no", "rank"))
    return rows_at(df, label, keys, draws, seed, counts, bucket_hex), missing


def boost_label(df: DataFrame, label: str, keys: list[str], value: str, n: int,
                seed=42) -> DataFrame:
    """n rows of one label with replacement; an unknown label gives no rows."""
    spark = df.sparkSession
    quotas = spark.createDataFrame([(value, n)], "label string, quota bigint")
    sample, _ = stratified_sample(df.filter(F.col(label) == F.lit(value)), label, keys, quotas, seed)
    return sample


def shuffle_rows(df: DataFrame, keys: list[str], seed=42, index_col: str = "row_index") -> DataFrame:
    """Seeded random order with a fresh 0-based index (global rank, distributed)."""
    ranked, _ = group_rank(df, None, keys, seed)
    return ranked.withColumn(index_col, F.col("rank") - 1).drop("rank", "group_size")


def sample_library(df: DataFrame, label: str, keys: list[str], benign: str = "BENIGN",
                   per_label: int = 5, seed=42) -> DataFrame:
    """Up to ``per_label`` rows of each attack label, without replacement."""
    attacks = df.withColumn(label, F.trim(F.col(label))).filter(~is_benign(label, benign))
    return top_per_group(attacks, label, keys, per_label, seed)


def split_quotas(df: DataFrame, label: str, test_size: float = 0.2,
                 counts: DataFrame | None = None) -> DataFrame:
    """Per-label train/test sizes of a stratified shuffle split.

    n_test = ceil(test_size x N); train quotas are the largest-remainder
    allocation of n_train by class share (ties: label order); test takes the
    rest of each class.  Fails when a class has fewer than 2 rows.
    """
    return _split_quotas(df, label, test_size, counts)[0]


def _split_quotas(df: DataFrame, label: str, test_size: float,
                  counts: DataFrame | None) -> tuple[DataFrame, int]:
    if counts is None:
        counts = df.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("count"))
    else:   # a bucket_counts table: sum the buckets of each label
        counts = counts.groupBy(F.col("__g").alias("label")).agg(F.sum("__n").alias("count"))
    counts, k = materialize_small(counts)
    stats = counts.agg(F.sum("count").alias("n"), F.min("count").alias("m")).first()
    n, smallest = stats["n"] or 0, stats["m"] or 0
    if k == 0:
        raise ValueError("cannot split an empty table")
    if smallest < 2:
        raise ValueError("The least populated class in y has only 1 member, which is too few. "
                         "The minimum number of groups for any class cannot be less than 2.")
    n_test = int(math.ceil(test_size * n))
    n_train = n - n_test
    if n_train < k or n_test < k:
        raise ValueError(f"test/train size must be at least the number of classes ({k})")
    whole = Window.partitionBy()
    cont = F.col("count") / F.lit(float(n)) * F.lit(float(n_train))
    q = (counts.withColumn("__cont", cont)
               .withColumn("__floor", F.floor("__cont").cast("bigint"))
               .withColumn("__rem", F.col("__cont") - F.col("__floor"))
               .withColumn("__need", F.lit(n_train) - F.sum("__floor").over(whole))
               .withColumn("__order", F.row_number().over(
                   Window.orderBy(F.desc("__rem"), F.asc("label"))))
               .withColumn("train_quota", F.col("__floor") + F.when(
                   F.col("__order") <= F.col("__need"), 1).otherwise(0))
               .withColumn("test_quota", F.col("count") - F.col("train_quota")))
    return q.select("label", "count", "train_quota", "test_quota"), k


def stratified_split(df: DataFrame, label: str, keys: list[str], test_size: float = 0.2,
                     seed=42, split_col: str = "split", counts: DataFrame | None = None) -> DataFrame:
    """Label-preserving train/test split; every row gets ``train`` or ``test``.

    Within each label the first ``test_quota`` rows of the seeded order are
    the test rows, so the split is exact (rare labels keep their share) and
    reproducible.  ``counts`` (a ``bucket_counts`` table of ``df`` grouped by
    ``label``) lets quotas and ranks share one counting pass.

    The digest at rank ``test_quota`` is selected per label and the rows are
    compared with it in place.  Rows of equal keys share a digest; where a
    boundary falls among them, these rows alone are numbered.  Only above
    MAX_BROADCAST_ROWS labels are the rows ranked.
    """
    if counts is None:   # one counting pass serves the quotas and the rank offsets
        counts, _ = materialize_small(bucket_counts(df, label, keys, seed))
    quotas, k = _split_quotas(df, label, test_size, counts)
    if k <= MAX_BROADCAST_ROWS:
        ranks = quotas.select(F.col("label").alias("__g"), F.col("test_quota").alias("__k"))
        return _split_at(df, label, keys, *kth_digests(df, label, keys, ranks, counts, seed), seed, split_col)
    q = quotas.select(F.col("label").alias("__lbl"), "test_quota")
    ranked, _ = group_rank(df, label, keys, seed, rank_col="__rank", counts=counts)
    out = ranked.join(q, F.col(label).eqNullSafe(F.col("__lbl")), "inner")
    out = out.withColumn(split_col, F.when(F.col("__rank") <= F.col("test_quota"), F.lit("test"))
                         .otherwise(F.lit("train")))
    return out.drop("__lbl", "test_quota", "__rank", "group_size")


def _split_at(df: DataFrame, label: str, keys: list[str], limits: DataFrame, tied: bool, seed,
              split_col: str) -> DataFrame:
    rows = df.withColumn("__g", F.col(label)).withColumn("__own", order_digest(seed, *keys))
    rows = join_null_safe(rows, F.broadcast(limits), ["__g"], "left")  # a row a label, checked by the caller
    cut = F.coalesce((F.col("__own") == F.col("__d")) & (F.col("__need") < F.col("__tied")), F.lit(False))
    is_test = F.coalesce(F.col("__own") <= F.col("__d"), F.lit(False))
    parts = [(rows, is_test)]
    if tied:
        numbered = Window.partitionBy("__g").orderBy("__own")
        parts = [(rows.filter(~cut), is_test), (rows.filter(cut).withColumn("__n", F.row_number().over(numbered)),
                                                F.col("__n") <= F.col("__need"))]
    done = [part.withColumn(split_col, F.when(test, F.lit("test")).otherwise(F.lit("train")))
                .drop("__g", "__own", "__d", "__need", "__tied", "__n") for part, test in parts]
    return done[0] if len(done) == 1 else done[0].unionByName(done[1])


def replay_schedule(df: DataFrame, keys: list[str], features: list[str],
                    label: str | None = None, window_s: int = 10, mode: str = "High",
                    start_ms: int = 0, seed=42) -> tuple[DataFrame, DataFrame]:
    """A time-stamped bootstrap of a flow table: one drawn row per offset.

    Offsets are 0, I, 2I, ... < W where I is the mode's interval and W is the
    window clamped to at least one second.  Returns (events, header).
    """
    if mode not in MODE_INTERVAL_MS:
        raise ValueError(f"unknown mode {mode!r}")
    window_ms = max(1000, int(window_s) * 1000)
    interval = MODE_INTERVAL_MS[mode]
    n_offsets = len(range(0, window_ms, interval))
    spark = df.sparkSession
    bucket_hex = directory_depth(n_offsets)
    counts = materialize(bucket_counts(df, None, keys, seed, bucket_hex), "directory")
    total = counts.agg(F.sum("__n")).first()[0]
    if not total:
        raise ValueError("No samples found for the replay")
    draws = (spark.range(0, window_ms, interval).select(F.col("id").alias("at_ms"))
             .withColumn("rank", draw_rank(seed, F.lit("replay"), F.col("at_ms"), F.lit(total))))
    picked = rows_at(df, None, keys, draws, seed, counts, bucket_hex)
    lbl = F.coalesce(F.col(label).cast("string"), F.lit("ANOMALY")) if label else F.lit("ANOMALY")
    events = picked.select(
        "at_ms", (F.lit(start_ms) + F.col("at_ms")).alias("ts"), lbl.alias("label"),
        F.array(*[F.coalesce(F.nanvl(F.col(c).try_cast("double"), F.lit(None).cast("double")),
                             F.lit(0.0)) for c in features]).alias("features"))
    header = spark.range(1).select(
        F.lit(mode).alias("mode"), F.lit(window_ms // 1000).alias("time_window_seconds"),
        F.lit(n_offsets).alias("attack_frequency"),
        intensity_level(F.lit(n_offsets)).alias("frequency_level"))
    return events, header
