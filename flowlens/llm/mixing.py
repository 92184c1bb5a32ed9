"""Mixing sources to target weights by min-cost flow.

The same text may stand in several sources.  Texts are aggregated by their
membership pattern (the set of sources that hold them), and a flow routes token
capacity from the patterns to the sources' quotas.  Costs are convex in
repetition: a further word costs as many units as its pattern's texts have been
passed over, and a little more for every pass over the rows of its (pattern,
source) cell, so the cheapest flow spreads repetition over the texts that many
sources could share.

The flow is found by its dual, a price a source.  At given prices every pattern
decides alone, so the patterns stay a table, however many there are, and a
round of Newton's method sends prices out and brings one sum a source and one a
pair of sources back.  A cell's flow then becomes whole documents: some repeats
for all, and one more for those whose seeded hash comes first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.llm.common import free_name, sum_ranges
from flowlens.operators._small import MAX_BROADCAST_ROWS, broadcast_checked, materialize

WEIGHTS = (3, 1, 2)
#: Words to take, as a share of all words; and repeats of a document at most.
BUDGET, REPEATS = 1.5, 2
#: Cost of a pass over a cell's rows, where one over the pattern's texts costs 1.
CELL_COST = 0.25
#: Newton rounds at most; prices tried in a round, by how far each is damped;
#: part of a target that may be open at the end (a corrected cell takes it up).
ROUNDS, DAMPING, OPEN = 60, (1e-9, 1e-3, 1e-2, 0.1, 1.0, 10.0), 1e-7
#: Hash buckets of a source's seeded order, per level of refinement.
BUCKETS = 4096
SEED = 97


def targets(sizes: list[int], weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET) -> list[float]:
    """Words wanted of each source: the budget shared by weight, no source
    above REPEATS times its size, the excess shared again among the others."""
    weight = [weights[i % len(weights)] for i in range(len(sizes))]
    out = [0.0] * len(sizes)
    open_ = list(range(len(sizes)))
    left = budget * sum(sizes)
    while open_:
        unit = left / sum(weight[i] for i in open_)
        full = [i for i in open_ if weight[i] * unit > REPEATS * sizes[i]]
        if not full:
            for i in open_:
                out[i] = weight[i] * unit
            break
        for i in full:
            out[i] = float(REPEATS * sizes[i])
            left -= out[i]
        open_ = [i for i in open_ if i not in set(full)]
    return out


def respond(prices: np.ndarray, unit: np.ndarray, first: np.ndarray, source: np.ndarray,
            words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(flow of every cell, passes over every pattern) at the prices: pattern i
    with ``unit[i]`` words of distinct texts owns cells ``first[i]:first[i + 1]``,
    each a source and its words.  A cell's flow rises with the price less the
    pattern's passes, which are the whole flow over the unit: one root a pattern."""
    slope, room = words / CELL_COST, float(REPEATS) * words
    owner = np.repeat(np.arange(len(unit)), np.diff(first))

    def flow(passes: np.ndarray) -> np.ndarray:
        return np.clip((prices[source] - passes[owner]) * slope, 0.0, room)

    low, high = np.zeros(len(unit)), sum_ranges(room, first) / unit
    for _ in range(64):
        middle = (low + high) / 2
        over = sum_ranges(flow(middle), first) > middle * unit
        low, high = np.where(over, middle, low), np.where(over, high, middle)
    passes = (low + high) / 2
    return flow(passes), passes


def _cells(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    unit, source, words = (batch.column(batch.schema.get_field_index(c)) for c in ("unit", "sources", "words"))
    first = np.zeros(len(unit) + 1, np.int64)
    np.cumsum([len(x) for x in source], out=first[1:])
    return unit.to_numpy().astype(np.float64), first, source.flatten().to_numpy(), words.flatten().to_numpy().astype(np.float64)


def _answers(tried: np.ndarray):
    """For each vector of prices: the patterns' gain (place 0), the flow into
    each source in whole words, and how it moves with every source's price."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = tried.shape[1]
        total = np.zeros((len(tried), 1 + n + n * n))
        for batch in batches:
            unit, first, source, words = _cells(batch)
            owner = np.repeat(np.arange(len(unit)), np.diff(first))
            for prices, out in zip(tried, total, strict=True):
                flow, passes = respond(prices, unit, first, source, words)
                paid = np.where(np.isfinite(prices), prices, 0.0)[source] * flow - CELL_COST * flow ** 2 / (2 * words)
                out[0] += np.rint(sum_ranges(paid, first) - passes ** 2 * unit / 2).sum()
                out[1:1 + n] += np.bincount(source, np.rint(flow), n)
                slope = np.where((flow > 0) & (flow < REPEATS * words), words / CELL_COST, 0.0)
                inner = np.zeros((len(unit), n))
                inner[owner, source] = slope
                moves = np.diag(inner.sum(0)) - inner.T @ (inner / (unit + inner.sum(1))[:, None])
                out[1 + n:] += moves.ravel()
        k, at = np.indices(total.shape)
        yield pa.RecordBatch.from_arrays(
            [pa.array(k.ravel(), pa.int32()), pa.array(at.ravel(), pa.int32()), pa.array(total.ravel())],
            names=["k", "at", "v"])
    return run


def clearing_prices(patterns: DataFrame, sizes: list[int], wanted: list[float]) -> np.ndarray:
    """Prices at which the cheapest flow out of ``patterns`` (unit, sources,
    words) fills the targets; infinite where a target is all that a source has."""
    size, want = np.array(sizes, np.float64), np.array(wanted, np.float64)
    full = want >= REPEATS * size - 0.5
    free = np.flatnonzero(~full)
    n = len(size)
    prices = np.full(n, np.inf)
    prices[free] = (1 + CELL_COST) * want[free] / size[free]
    best, tried = None, prices[None, :]
    for _ in range(ROUNDS if len(free) else 0):
        rows = patterns.mapInArrow(_answers(tried), "k int, at int, v double").groupBy("k", "at").agg(
            F.sum("v").alias("v")).toPandas()
        total = np.zeros((len(tried), 1 + n + n * n))
        total[rows["k"], rows["at"]] = rows["v"]
        gain = tried[:, free] @ want[free] - total[:, 0]
        k = int(np.argmax(gain))
        if best is not None and gain[k] <= best:
            break
        best, prices = gain[k], tried[k]
        short = (want - total[k, 1:1 + n])[free]
        if (np.abs(short) <= np.maximum(1.0, OPEN * want[free])).all():
            break
        moves = total[k, 1 + n:].reshape(n, n)[np.ix_(free, free)]
        tried = np.repeat(prices[None, :], len(DAMPING), 0)
        for row, damping in zip(tried, DAMPING, strict=True):
            # nine digits: sums taken in another order give the same prices
            row[free] = np.round(row[free] + np.linalg.solve(moves + np.diag(damping * size[free]), short), 9)
    return prices


def cell_flows(patterns: DataFrame, prices: np.ndarray) -> DataFrame:
    """(pattern, s, whole, part): repeats of all the cell's documents, and the
    share of them that is taken once more."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            unit, first, source, words = _cells(batch)
            flow = np.rint(respond(prices, unit, first, source, words)[0])
            whole = np.minimum(REPEATS, flow // words)
            owner = pa.array(np.repeat(np.arange(len(unit)), np.diff(first)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index("pattern")).take(owner), pa.array(source, pa.int32()),
                 pa.array(whole.astype(np.int32)), pa.array(flow / words - whole)], names=["pattern", "s", "whole", "part"])
    return patterns.mapInArrow(run, "pattern string, s int, whole int, part double")


def _shares(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A table with a row a source."""
    df = spark.createDataFrame(rows, schema)
    return F.broadcast(df) if len(rows) <= MAX_BROADCAST_ROWS else df


def mix(docs: DataFrame, text_col: str = "text", source_col: str = "source", id_col: str = "doc_id",
        weights: tuple[int, ...] = WEIGHTS, keep: list[str] | None = None) -> tuple[DataFrame, dict]:
    """Documents with the words that the mix takes of each.

    Returns the frame (columns ``keep``, all by default, plus four) and the
    names of the four: ``size`` (runs of non-space characters), ``source_size``
    and ``target`` of the document's source, ``taken`` (0, 1 or 2 times the
    size).  Sources are ordered by code point, a null source last; the driver
    holds a few numbers a source and a pair of sources, and no pattern.

    Null and empty texts have size 0 and give 0 words; a very long text is one
    document, taken whole.  Rows that agree in id and text are taken alike.  An
    empty table gives an empty table.  The result depends on ids, texts and
    sources only, not on the partitioning.
    """
    spark = docs.sparkSession
    keep = docs.columns if keep is None else keep
    names = {k: free_name(docs, k) for k in ("size", "source_size", "target", "taken")}
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    # the kept columns travel in a struct, so that no name of theirs meets one used here
    rows = materialize(docs.select(
        F.struct(*(F.col(f"`{c}`") for c in keep)).alias("row"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint").alias("size"),
        F.md5(text.cast("binary")).alias("content"), F.col(source_col).cast("string").alias("source"),
        F.shiftrightunsigned(F.xxhash64(F.lit(SEED), F.col(id_col), text), 16).alias("u")), "mix")

    found = [(r[0], r[1]) for r in rows.groupBy("source").agg(F.sum("size")).collect()]
    found.sort(key=lambda r: (r[0] is None, r[0] or ""))
    sizes = [n or 0 for _, n in found]
    wanted = targets(sizes, weights)
    recipe = _shares(spark, [(name, i, n, t) for i, ((name, n), t) in enumerate(zip(found, wanted, strict=True))],
                     "mix_name string, s int, source_size bigint, target double")
    rows = rows.join(recipe, F.col("source").eqNullSafe(F.col("mix_name")), "left").drop("mix_name")

    # membership patterns of texts that stand in several sources
    held = rows.where("size > 0").groupBy("content", "s").agg(F.first("size").alias("z"))
    held = held.groupBy("content").agg(F.sort_array(F.collect_set("s")).alias("sources"), F.first("z").alias("z"))
    shared = materialize(held.where(F.size("sources") > 1).select(
        F.col("content").alias("shared_content"), F.array_join("sources", ",").alias("pattern"), "z"), "mix-shared")
    rows = rows.join(shared.drop("z"), F.col("content") == F.col("shared_content"), "left").drop("shared_content") \
        .withColumn("pattern", F.coalesce("pattern", F.col("s").cast("string")))  # the pattern of one source
    rows = materialize(rows, "mix-cells")

    cells = materialize(rows.where("size > 0").groupBy("pattern", "s").agg(F.sum("size").alias("n")), "mix-sums")
    units = shared.groupBy("pattern").agg(F.sum("z").alias("unit"))
    listed = cells.groupBy("pattern").agg(F.sort_array(F.collect_list(F.struct("s", "n"))).alias("cells"))
    # copies inside one source are repetition, too, but no other source needs them
    patterns = materialize(listed.join(units, "pattern", "left").select(
        "pattern", F.coalesce("unit", F.col("cells")[0]["n"]).alias("unit"),
        F.col("cells.s").alias("sources"), F.col("cells.n").alias("words")), "mix-patterns")
    plan = cell_flows(patterns, clearing_prices(patterns, sizes, wanted))
    planned = rows.join(broadcast_checked(plan), ["pattern", "s"], "left")
    planned = planned.withColumn("repeats", F.coalesce("whole", F.lit(0)) + F.when(
        F.col("u") / F.lit(float(1 << 48)) < F.col("part"), 1).otherwise(0))

    # a source's largest cell takes up what whole documents leave open
    largest = {r["s"]: r["top"] for r in cells.groupBy("s").agg(F.max(F.struct("n", "pattern")).alias("top")).collect()}
    fixed = _shares(spark, [(top["pattern"], s) for s, top in largest.items()], "corrector string, s int")
    planned = planned.join(fixed, "s", "left")
    last = F.col("pattern") == F.col("corrector")
    done = {r["s"]: r["n"] for r in planned.where(~F.coalesce(last, F.lit(False))).groupBy("s").agg(
        F.sum(F.col("repeats") * F.col("size")).alias("n")).collect()}
    ends = _ends(spark, planned.where(last).select("s", "u", F.col("size").alias("z")),
                 {s: (top["n"], wanted[s] - (done.get(s) or 0)) for s, top in largest.items()})
    out = planned.join(_shares(spark, ends, "s int, base int, u_end bigint"), "s", "left")
    repeats = F.when(last, F.col("base") + F.when(F.col("u") < F.col("u_end"), 1).otherwise(0)).otherwise(F.col("repeats"))
    return out.select(
        *(F.col(f"row.`{c}`").alias(c) for c in keep), F.col("size").alias(names["size"]),
        F.col("source_size").alias(names["source_size"]), F.col("target").alias(names["target"]),
        (F.coalesce(repeats, F.lit(0)) * F.col("size")).cast("bigint").alias(names["taken"])), names


def _ends(spark: SparkSession, rows: DataFrame, need: dict[int, tuple[int, float]]) -> list[tuple[int, int, int]]:
    """(source, repeats of all, end of the hash range taken once more) so that
    each source's last cell takes the words it still needs, to one document or
    one hash bucket.  Two rounds of bucket sums per source refine the end."""
    out, extra = {}, {}
    for s, (n, words) in need.items():
        words = min(max(words, 0.0), float(REPEATS * n))
        base = min(REPEATS - 1, int(words // n))
        out[s], extra[s] = base, words - base * n
    lo = dict.fromkeys(need, 0)
    for level in range(1, 5):
        width = 1 << (48 - 12 * level)
        starts = _shares(spark, [(s, v) for s, v in lo.items()], "s int, lo bigint")
        inside = rows.join(starts, "s").where((F.col("u") >= F.col("lo")) & (F.col("u") < F.col("lo") + width * BUCKETS))
        sums = inside.groupBy("s", ((F.col("u") - F.col("lo")) / width).cast("int").alias("b")).agg(
            F.sum("z").alias("z"), F.count(F.lit(1)).alias("n")).toPandas().sort_values(["s", "b"])
        finer = False
        for s, part in sums.groupby("s"):
            upto = np.cumsum(part["z"].to_numpy(np.float64))
            k = int(np.searchsorted(upto, extra[s], side="right"))  # whole buckets that fit
            taken = upto[k - 1] if k else 0.0
            if k == len(upto):
                lo[s] += width * BUCKETS
                extra[s] = 0.0
                continue
            at, z, n = (int(part[c].iloc[k]) for c in ("b", "z", "n"))
            extra[s] -= taken
            lo[s] += width * at
            if n == 1 or level == 4:
                if extra[s] * 2 > z:  # the document at the end is nearer in than out
                    lo[s] += width
                extra[s] = 0.0
            else:
                finer = True
        if not finer:
            break
    return [(s, out[s], lo[s]) for s in need]
