"""Random forest grown to purity on the rows' own values: exact split search by
ranges for large nodes, whole subtrees for small ones.

Values are single precision, as in the original's forest, and a split lies half way
between two neighbouring values of its node.  Equal rows become one with a number.
Every tree draws a Poisson bag by a hash of row and tree.  Nodes of more than
GROUP_ROWS drawn rows are split level by level: tasks sum up class counts by ranges of
values, and only the ranges whose bound reaches the best split between ranges are
searched value by value.  The rows of a smaller node are gathered, and one task grows
the subtree below it.  Neither rows nor subtrees pass the driver, which holds the
ranges' ends and the few nodes above the subtrees.
"""

from __future__ import annotations

import json
import math
import os
from collections.abc import Iterator
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.functions.sqltext import ident
from flowlens.operators._small import materialize
from flowlens.session import create_if_absent

#: Drawn rows of a node whose subtree one task grows.
GROUP_ROWS = 50_000
#: Drawn rows that one task grows trees of, whole nodes together.
TASK_ROWS = 50_000
#: Drawn rows of ranges that one group searches value by value.
INSIDE_ROWS = 200_000
#: Rows of a block, the unit in which rows travel to be scored.
BLOCK_ROWS = 4096
#: Numbers in the histograms of one pass, and in one step of a subtree.
HISTOGRAM_CELLS = 8_000_000
#: Ranges of a feature in a histogram, at most 256.
RANGES = 128
LEAF, OPEN = -1, -2
_ODD = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
_SUBTREES = "tree int, node int, feature binary, cut binary, child binary, probs binary"


@dataclass
class Tree:
    """Nodes by number: feature (LEAF, OPEN), greatest value of the left side, left
    child (the right one follows it) or place of a leaf's probabilities."""

    feature: np.ndarray
    cut: np.ndarray
    child: np.ndarray

    def walk(self, values: np.ndarray) -> np.ndarray:
        """The node at which each row ends."""
        at, rows = np.zeros(len(values), np.int64), np.arange(len(values))
        while len(rows):
            rows = rows[self.feature[at[rows]] >= 0]
            now = at[rows]
            at[rows] = self.child[now] + (values[rows, self.feature[now]] > self.cut[now])
        return at


@dataclass
class Forest:
    features: list[str]
    n_classes: int
    tops: list[Tree]
    top_probs: list[np.ndarray]   # per tree: probabilities of the leaves above the subtrees
    subtrees: DataFrame

    def save(self, path: str) -> None:
        spark = self.subtrees.sparkSession
        self.subtrees.write.parquet(os.path.join(path, "subtrees"))
        told = {"features": self.features, "n_classes": self.n_classes,
                "tops": [[t.feature.tolist(), t.cut.tolist(), t.child.tolist(), p.tolist()]
                         for t, p in zip(self.tops, self.top_probs, strict=True)]}
        if not create_if_absent(spark, os.path.join(path, "metadata", "forest.json"), json.dumps(told)):
            raise OSError(f"{path} is taken")


def load(spark: SparkSession, path: str) -> Forest:
    told = json.loads(spark.read.option("wholetext", True).text(os.path.join(path, "metadata", "forest.json")).first()[0])
    if "edges" in told:
        raise ValueError(f"the forest under {path} splits by bins, the form before this one; train it anew")
    tops = [Tree(np.array(f, np.int64), np.array(x, np.float64), np.array(c, np.int64)) for f, x, c, _ in told["tops"]]
    probs = [np.array(p, np.float32).reshape(-1, told["n_classes"]) for *_, p in told["tops"]]
    return Forest(told["features"], told["n_classes"], tops, probs, spark.read.parquet(os.path.join(path, "subtrees")))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(_ODD[1])
    x = (x ^ (x >> np.uint64(27))) * np.uint64(_ODD[2])
    return x ^ (x >> np.uint64(31))


def bag_weights(digest: np.ndarray, copies: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """How often each row is drawn: a Poisson number of mean ``copies``, fixed by row, tree and seed."""
    start = np.uint64((seed * 1_000_003 + tree + 1) * _ODD[0] % (1 << 64))
    u = ((_mix(_mix(digest ^ start) + start) >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)
    out = np.zeros(len(u), np.int64)
    few = copies <= 64
    mean = copies[few].astype(np.float64)
    term = np.exp(-mean)
    total, drawn, k = term.copy(), np.zeros(len(mean), np.int64), 0
    while k < 200 and (beyond := u[few] > total).any():
        drawn += beyond
        k += 1
        term = term * mean / k
        total = total + np.where(beyond, term, 0)
    out[few] = drawn
    for i in np.flatnonzero(~few):  # the normal limit
        out[i] = max(0, round(copies[i] + math.sqrt(copies[i]) * NormalDist().inv_cdf(u[i])))
    return out


def draws(n_features: int) -> int:
    """Features a node looks at: the whole part of the square root, as in the original."""
    return max(1, math.isqrt(n_features))


def drawn_order(seed: int, tree: int, node: int, n_features: int) -> np.ndarray:
    """The order in which a large node draws its features."""
    return np.argsort(np.random.default_rng([seed, tree, node]).random(n_features))


def middle(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Half way between neighbouring values a < b; a itself beside an infinite one."""
    a, b = np.asarray(a, np.float64), np.asarray(b, np.float64)
    half = a / 2 + b / 2
    return np.where((half >= a) & (half < b), half, a)


def split_score(left: np.ndarray, total: np.ndarray) -> np.ndarray:
    """What Gini maximises, from the class counts on the left and of the node; rows of counts."""
    right = total - left
    return (left ** 2).sum(-1) / np.maximum(left.sum(-1), 1) + (right ** 2).sum(-1) / np.maximum(right.sum(-1), 1)


def best_splits(node: np.ndarray, slot: np.ndarray, value: np.ndarray, counts: np.ndarray,
                total: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Best Gini split a node from the class counts of its (slot, value) cells,
    sorted by node, slot and value: (nodes with a split, slot, value, counts on the
    left).  As in the original, a split that gains nothing is a split."""
    first = np.concatenate([[True], (node[1:] != node[:-1]) | (slot[1:] != slot[:-1])])
    sums = np.cumsum(counts, axis=0)
    at = np.flatnonzero(first)
    left = sums - (sums[at] - counts[at])[np.cumsum(first) - 1]
    score = np.where(np.concatenate([~first[1:], [False]]), split_score(left, total[node]), -1.0)
    starts = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
    best = np.maximum.reduceat(score, starts)
    run = np.cumsum(np.concatenate([[False], node[1:] != node[:-1]]))
    tops = np.flatnonzero(score == best[run])
    _, i = np.unique(run[tops], return_index=True)  # the first of equals
    won = tops[i][best > 0]
    return node[won], slot[won], value[won], left[won]


def most(base: np.ndarray, more: np.ndarray) -> np.ndarray:
    """Greatest sum of squares over sum of counts between ``base`` and ``base + more``,
    rows of counts.  The ratio is convex, so it lies at a corner, and the corner
    takes ``more`` of the classes with the greatest 2 base + more."""
    order = np.argsort(-(2 * base + more), axis=1)
    base, more = np.take_along_axis(base, order, 1), np.take_along_axis(more, order, 1)
    start = np.zeros((len(base), 1))
    squares = (base ** 2).sum(1, keepdims=True) + np.hstack([start, np.cumsum((2 * base + more) * more, 1)])
    return (squares / np.maximum(base.sum(1, keepdims=True) + np.hstack([start, np.cumsum(more, 1)]), 1)).max(1)


def running_scores(run: np.ndarray, node: np.ndarray, label: np.ndarray, weight: np.ndarray, total: np.ndarray,
                   before: np.ndarray | None = None) -> np.ndarray:
    """``split_score`` with each row and those before it in its run on the left, from
    running sums alone; ``before`` has class counts on the left of a run's rows."""
    def sums(x: np.ndarray, of: np.ndarray) -> np.ndarray:
        first = np.concatenate([[True], of[1:] != of[:-1]])
        up = np.cumsum(x)
        return up - (up - x)[first][np.cumsum(first) - 1]

    by_class = run * total.shape[1] + label
    order = np.argsort(by_class, kind="stable")
    mine = np.empty(len(run))  # drawn before of the row's class
    mine[order] = sums(weight[order], by_class[order]) - weight[order]
    mine += 0 if before is None else before[run, label]
    square, n_left = sums((2 * mine + weight) * weight, run), sums(weight, run)
    cross = sums(weight * total[node, label], run)
    if before is not None:
        square, n_left = square + (before ** 2).sum(1)[run], n_left + before.sum(1)[run]
        cross = cross + (before[run] * total[node]).sum(1)
    n_right = total.sum(1)[node] - n_left
    right = (total ** 2).sum(1)[node] - 2 * cross + square
    return square / np.maximum(n_left, 1) + right / np.maximum(n_right, 1)


def _best_cuts(ranks, label, weight, rows, of, slots, total):
    """(nodes with a split, feature, last rank on the left, first on the right) from
    rows sorted by node and the features each node looks at, in that order."""
    k = slots.shape[1]
    run = (of[:, None] * k + np.arange(k)).ravel()
    rank = ranks[rows[:, None], slots[of]].ravel().astype(np.int64)
    order = np.argsort(run * (len(ranks) + 1) + rank)
    run, rank, row = run[order], rank[order], np.repeat(rows, k)[order]
    node = run // k
    score = running_scores(run, node, label[row], weight[row], total)
    score[np.concatenate([(run[1:] != run[:-1]) | (rank[1:] == rank[:-1]), [True]])] = -1
    first = np.concatenate([[True], node[1:] != node[:-1]])
    best = np.maximum.reduceat(score, np.flatnonzero(first))[np.cumsum(first) - 1]
    hit = np.flatnonzero((score == best) & (score > 0))
    won, i = np.unique(node[hit], return_index=True)  # the first of equals
    hit = hit[i]
    return won, slots[won, run[hit] % k], rank[hit], rank[hit + 1]


def grow(values: np.ndarray, label: np.ndarray, weight: np.ndarray, n_classes: int, levels: int | None, seed: int,
         tree: int, root: int) -> tuple[Tree, np.ndarray]:
    """The subtree of a node from its drawn rows, all nodes of a level at once.
    A node whose drawn features are all constant goes on to the next that is not."""
    n_features, k = values.shape[1], draws(values.shape[1])
    ranks, distinct = np.empty(values.shape, np.int32), []
    for i in range(n_features):
        found, ranks[:, i] = np.unique(values[:, i], return_inverse=True)
        distinct.append(found)
    place, distinct = np.cumsum([0] + [len(x) for x in distinct[:-1]]), np.concatenate(distinct)
    feature, cuts, child, probs, leaves = [], [], [], [], 0
    rows, at, m, made, level = np.arange(len(values)), np.zeros(len(values), np.int64), 1, 1, 0
    rng = np.random.default_rng([seed, tree, root])
    while m:
        total = np.bincount(at * n_classes + label[rows], weight[rows], m * n_classes).reshape(m, n_classes)
        f, last, cut, c = np.full(m, LEAF), np.zeros(m, np.int64), np.zeros(m), np.zeros(m, np.int64)
        mixed = np.flatnonzero((total > 0).sum(1) > 1)
        if len(mixed) and (levels is None or level < levels):
            size = np.bincount(at, minlength=m)
            by_node, start = rows[np.argsort(at, kind="stable")], np.cumsum(size) - size
            step = np.cumsum(n_features + size[mixed] * k) // HISTOGRAM_CELLS
            for p in np.unique(step):
                nodes = mixed[step == p]
                of = np.repeat(np.arange(len(nodes)), size[nodes])
                mine = by_node[np.arange(len(of)) + (start[nodes] - np.cumsum(size[nodes]) + size[nodes])[of]]
                order = np.argsort(rng.random((len(nodes), n_features)), axis=1)
                found = [_best_cuts(ranks, label, weight, mine, of, order[:, :k], total[nodes])]
                lost = np.setdiff1d(np.arange(len(nodes)), found[0][0])
                if len(lost) and k < n_features:
                    here = np.isin(of, lost)
                    r = ranks[mine[here]]
                    starts = np.flatnonzero(np.concatenate([[True], np.diff(of[here]) > 0]))
                    varies = np.minimum.reduceat(r, starts) < np.maximum.reduceat(r, starts)
                    varies = np.take_along_axis(varies, order[lost], 1)
                    lost, varies = lost[varies.any(1)], varies[varies.any(1)]
                    if len(lost):
                        here = np.isin(of, lost)
                        won, *rest = _best_cuts(ranks, label, weight, mine[here], np.searchsorted(lost, of[here]),
                                                order[lost, varies.argmax(1)][:, None], total[nodes[lost]])
                        found.append((lost[won], *rest))
                for won, chosen, a, b in found:
                    f[nodes[won]], last[nodes[won]] = chosen, a
                    cut[nodes[won]] = middle(distinct[place[chosen] + a], distinct[place[chosen] + b])
        inner = f >= 0
        c[inner] = made + 2 * np.arange(inner.sum())
        c[~inner] = leaves + np.arange((~inner).sum())
        leaves += int((~inner).sum())
        probs.append((total[~inner] / total[~inner].sum(1, keepdims=True)).astype(np.float32))
        feature.append(f), cuts.append(cut), child.append(c)
        stay = inner[at]
        rows, at = rows[stay], at[stay]
        at = c[at] - made + (ranks[rows, f[at]] > last[at])
        m = 2 * int(inner.sum())
        made += m
        level += 1
    return Tree(*(np.concatenate(x) for x in (feature, cuts, child))), np.concatenate(probs)


def _values(columns: list[pa.Array]) -> np.ndarray:
    """Rows of single-precision values; missing ones are greater than all others."""
    out = np.empty((len(columns[0]), len(columns)), np.float32)
    with np.errstate(over="ignore"):
        for i, c in enumerate(columns):
            out[:, i] = c.cast(pa.float64()).fill_null(math.nan).to_numpy(zero_copy_only=False)
    out[np.isnan(out)] = np.inf
    return out + np.float32(0)  # no negative zero


def _ranges(edges: list[np.ndarray], values: np.ndarray) -> np.ndarray:
    out = np.empty(values.shape, np.uint8)
    for i, e in enumerate(edges):
        out[:, i] = np.searchsorted(e, values[:, i], side="left")
    return out


def range_edges(df: DataFrame, features: list[str], ranges: int) -> list[np.ndarray]:
    """Upper ends of all ranges but the last of every feature, from the rows of the
    smallest hashes (``ranges`` squared, 10,000 at least).  They only deal out the
    search for a split: the split found is the same by any ends."""
    values = df.select(*[F.col(ident(c)).cast("double").alias(f"x{i}") for i, c in enumerate(features)])
    looked = values.orderBy(F.xxhash64(*values.columns)).limit(max(ranges ** 2, 10_000)).toArrow()
    share = np.arange(1, ranges) / ranges
    columns = _values([c.combine_chunks() for c in looked.columns])
    return [np.unique(np.quantile(x, share, method="inverted_cdf")) if len(x) else x
            for x in (c[np.isfinite(c)] for c in columns.T)]


def _bags(values: np.ndarray, digest, label, copies, tops, tree, seed, bagged):
    """(node, places of the rows drawn, weights) of one tree, for the nodes still open."""
    weight = bag_weights(digest, copies, tree, seed) if bagged else copies
    drawn = np.flatnonzero(weight > 0)
    at = tops[tree].walk(values[drawn])
    keep = tops[tree].feature[at] == OPEN
    return at[keep], drawn[keep], weight[drawn[keep]]


def _read(batch: pa.RecordBatch):
    values = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.float32).reshape(batch.num_rows, -1)
    return (values, batch.column(3).to_numpy().view(np.uint64), batch.column(1).to_numpy().astype(np.int64),
            batch.column(2).to_numpy().astype(np.int64))


def _looked_at(active, seed, n_features, k) -> np.ndarray:
    """The features that the active nodes look at in this pass; past the last one it is repeated."""
    return np.array([np.take(drawn_order(seed, t, n, n_features), np.arange(s, s + k), mode="clip") for t, n, s in active])


def _cells(batches, tops, active, edges, seed, bagged, k):
    """For every batch and tree with active nodes: (cell by active node, slot and range,
    value, label and weight) of its drawn rows, ``k`` cells a row."""
    place = {}
    for i, (tree, node, _) in enumerate(active):
        place.setdefault(tree, {})[node] = i
    feats = None
    for batch in batches:
        if not batch.num_rows:
            continue
        values, digest, label, copies = _read(batch)
        feats = _looked_at(active, seed, values.shape[1], k) if feats is None else feats
        ranges = _ranges(edges, values)
        for tree, nodes in place.items():
            at, drawn, weight = _bags(values, digest, label, copies, tops, tree, seed, bagged)
            of = np.full(len(tops[tree].feature), -1)
            of[list(nodes)] = list(nodes.values())
            mine = of[at] >= 0
            o, r, w = of[at[mine]], drawn[mine], weight[mine]
            cell = (o[:, None] * k + np.arange(k)) * RANGES + ranges[r[:, None], feats[o]]
            yield cell.ravel(), values[r[:, None], feats[o]].ravel(), np.repeat(label[r], k), np.repeat(w, k)


def _histograms(tops, active, edges, seed, bagged, n_classes, k):
    """Class counts, least and greatest value of the ranges of the features looked at, summed in the task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = None
        for cell, value, label, weight in _cells(batches, tops, active, edges, seed, bagged, k):
            if counts is None:
                counts = np.zeros(len(active) * k * RANGES * n_classes)
                low, high = (np.full(len(active) * k * RANGES, x, np.float32) for x in (np.inf, -np.inf))
            np.add.at(counts, cell * n_classes + label, weight.astype(np.float64))
            np.minimum.at(low, cell, value)
            np.maximum.at(high, cell, value)
        if counts is not None:
            counts, low, high = (x.reshape(len(active) * k, -1) for x in (counts, low, high))
            for i in np.flatnonzero(counts.any(1)):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([i // k], pa.int32()), pa.array([i % k], pa.int32()),
                     *(pa.array([x[i].tobytes()]) for x in (counts, low, high))],
                    names=["active", "slot", "counts", "low", "high"])
    return run


_FOUND = ("active int, total array<double>, slot int, cut double, left array<double>, "
          "cells array<int>, rows array<double>, before array<double>")


def _between_ranges(active, n_classes, k):
    """A node's best split between ranges, and the ranges in which there may be a better one."""
    def run(table: pa.Table) -> pa.Table:
        counts = np.zeros((k, RANGES, n_classes))
        low, high = (np.full((k, RANGES), x, np.float32) for x in (np.inf, -np.inf))
        for slot, c, a, b in zip(*(table[x].to_pylist() for x in ("slot", "counts", "low", "high")), strict=True):
            counts[slot] += np.frombuffer(c).reshape(RANGES, n_classes)
            low[slot] = np.minimum(low[slot], np.frombuffer(a, np.float32))
            high[slot] = np.maximum(high[slot], np.frombuffer(b, np.float32))
        i, total = table["active"][0].as_py(), counts[0].sum(0)
        varies = low.min(1) < high.max(1)
        if active[i][2]:  # features beyond the drawn ones: the first that is not constant
            varies &= np.arange(k) == varies.argmax()
        slot, place = np.nonzero(counts.any(2) & varies[:, None])
        cells = counts[slot, place]
        left = np.cumsum(counts, axis=1)[slot, place]
        best, won, cut, side = -1.0, -1, 0.0, []
        if len(slot):
            _, s, v, x = best_splits(np.zeros(len(slot), np.int64), slot, place, cells, total[None])
            if len(s):
                after = place[np.flatnonzero((slot == s[0]) & (place > v[0]))[0]]
                best, won, side = float(split_score(x[0], total)), int(s[0]), x[0].tolist()
                cut = float(middle(high[s[0], v[0]], low[s[0], after]))
        bound = most(left - cells, cells) + most(total - left, cells)
        inner = (low[slot, place] < high[slot, place]) & (bound >= best * (1 - 1e-9))
        return pa.table({
            "active": pa.array([i], pa.int32()), "total": pa.array([total.tolist()], pa.list_(pa.float64())),
            "slot": pa.array([won], pa.int32()), "cut": pa.array([cut], pa.float64()),
            "left": pa.array([side], pa.list_(pa.float64())),
            "cells": pa.array([((i * k + slot) * RANGES + place)[inner].tolist()], pa.list_(pa.int32())),
            "rows": pa.array([cells[inner].sum(1).tolist()], pa.list_(pa.float64())),
            "before": pa.array([(left - cells)[inner].ravel().tolist()], pa.list_(pa.float64()))})
    return run


def _inside(tops, active, edges, seed, bagged, k, wanted, part):
    """The drawn rows of the wanted cells, a row of arrays a part."""
    def packed(kept: list) -> pa.RecordBatch:
        place, *columns = (np.concatenate(x) for x in zip(*kept, strict=True))
        order = np.argsort(part[place], kind="stable")
        of = part[place][order]
        cuts = np.flatnonzero(np.diff(of)) + 1
        return pa.RecordBatch.from_arrays(
            [pa.array(of[np.concatenate([[0], cuts])], pa.int32()),
             *(pa.array([p.tobytes() for p in np.split(x[order], cuts)], pa.binary()) for x in (place, *columns))],
            names=["part", "place", "value", "label", "weight"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, size = [], 0
        for cell, value, label, weight in _cells(batches, tops, active, edges, seed, bagged, k):
            at = np.minimum(np.searchsorted(wanted, cell), len(wanted) - 1)
            here = np.flatnonzero(wanted[at] == cell)
            if len(here):
                kept.append((at[here].astype(np.int32), value[here], label[here].astype(np.int32), weight[here]))
                size += len(here)
            if size > INSIDE_ROWS:
                yield packed(kept)
                kept, size = [], 0
        if kept:
            yield packed(kept)
    return run


def _within_ranges(wanted, before, totals, k):
    """The best split of every node between two values of one of its wanted ranges in this part."""
    def run(table: pa.Table) -> pa.Table:
        join = lambda c, t: np.frombuffer(b"".join(table[c].to_pylist()), t)
        place, value, weight = join("place", np.int32), join("value", np.float32), join("weight", np.int64)
        order = np.lexsort((value, place))
        place, value, weight = place[order], value[order], weight[order].astype(np.float64)
        label = join("label", np.int32)[order].astype(np.int64)
        cells, of = np.unique(place, return_inverse=True)
        node, nodes = np.unique(wanted[cells] // (RANGES * k), return_inverse=True)
        total = np.array([totals[i] for i in node])
        score = running_scores(of, nodes[of], label, weight, total, before[cells])
        score[np.concatenate([(value[1:] == value[:-1]) | (of[1:] != of[:-1]), [True]])] = -1
        starts = np.flatnonzero(np.concatenate([[True], np.diff(nodes[of]) > 0]))
        found = []
        for i, lo, hi in zip(node, starts, [*starts[1:], len(score)], strict=True):
            won = lo + int(score[lo:hi].argmax())  # the first of equals
            mine = slice(np.searchsorted(of, of[won]), won + 1)
            left = before[cells[of[won]]] + np.bincount(label[mine], weight[mine], total.shape[1])
            found.append((int(i), int(wanted[place[won]]) // RANGES % k, float(middle(value[won], value[won + 1])), left.tolist()))
        return pa.table([pa.array(c, t) for c, t in zip(zip(*found, strict=True), (
            pa.int32(), pa.int32(), pa.float64(), pa.list_(pa.float64())), strict=True)], names=["active", "slot", "cut", "left"])
    return run


def _split_nodes(table: DataFrame, tops, active, edges, seed, bagged, n_classes, k):
    """{place in ``active``: (total, slot or -1, cut, counts on the left)}: the best split of every active node."""
    found = table.mapInArrow(_histograms(tops, active, edges, seed, bagged, n_classes, k),
                             "active int, slot int, counts binary, low binary, high binary") \
        .groupBy("active").applyInArrow(_between_ranges(active, n_classes, k), _FOUND).collect()
    totals = {r["active"]: np.array(r["total"]) for r in found}
    options = {r["active"]: [(r["slot"], r["cut"], np.array(r["left"]))] if r["slot"] >= 0 else [] for r in found}
    wanted = np.array([c for r in found for c in r["cells"]], np.int64)
    if len(wanted):
        before = np.concatenate([np.array(r["before"]).reshape(-1, n_classes) for r in found])
        order = np.argsort(wanted)
        part = (np.cumsum(np.array([n for r in found for n in r["rows"]])[order]) // INSIDE_ROWS).astype(np.int32)
        wanted, before = wanted[order], before[order]
        inside = table.mapInArrow(_inside(tops, active, edges, seed, bagged, k, wanted, part),
                                  "part int, place binary, value binary, label binary, weight binary")
        for r in inside.groupBy("part").applyInArrow(
                _within_ranges(wanted, before, totals, k), "active int, slot int, cut double, left array<double>").collect():
            options[r["active"]].append((r["slot"], r["cut"], np.array(r["left"])))
    out = {}
    for i, those in options.items():
        best = min(those, key=lambda x: (-split_score(x[2], totals[i]), x[0], x[1]), default=(-1, 0.0, None))
        out[i] = (totals[i], *best)
    return out


def _grow_top(table: DataFrame, edges: list[np.ndarray], n_features: int, n_classes: int, num_trees: int,
              max_depth: int | None, seed: int, bagged: bool,
              group_rows: int) -> tuple[list[Tree], list[np.ndarray], list[list[int]]]:
    """Split the nodes of more than ``group_rows`` drawn rows, a level at a time; without edges there are none."""
    k = draws(n_features)
    nodes = [{"feature": [OPEN], "cut": [0.0], "child": [0], "depth": [0], "probs": []} for _ in range(num_trees)]
    trees = lambda: [Tree(np.array(t["feature"], np.int64), np.array(t["cut"], np.float64),
                          np.array(t["child"], np.int64)) for t in nodes]

    def settle(t: dict, node: int, total: np.ndarray) -> None:
        t["feature"][node], t["child"][node] = LEAF, len(t["probs"])
        t["probs"].append(total / total.sum())

    waiting = [(t, 0, 0) for t in range(num_trees)] if edges else []  # tree, node, features looked at before
    step = max(1, HISTOGRAM_CELLS // (k * RANGES * n_classes))
    while waiting:
        active, waiting, tops = waiting[:step], waiting[step:], trees()
        for i, (total, slot, cut, left) in sorted(_split_nodes(table, tops, active, edges, seed, bagged, n_classes, k).items()):
            tree, node, seen = active[i]
            t = nodes[tree]
            depth = t["depth"][node] + 1
            if (total > 0).sum() < 2 or (max_depth is not None and depth > max_depth) or (slot < 0 and seen + k >= n_features):
                settle(t, node, total)
                continue
            if slot < 0:
                waiting.append((tree, node, seen + k))
                continue
            t["feature"][node] = int(_looked_at([active[i]], seed, n_features, k)[0, slot])
            t["cut"][node], t["child"][node] = cut, len(t["feature"])
            for side in (left, total - left):
                if side.sum() > group_rows:
                    waiting.append((tree, len(t["feature"]), 0))
                for x, v in (("feature", OPEN), ("cut", 0.0), ("child", 0), ("depth", depth)):
                    t[x].append(v)
                if (side > 0).sum() < 2 and side.sum() > group_rows:  # pure: nothing to gather
                    settle(t, waiting.pop()[1], side)
    return trees(), [np.array(t["probs"], np.float32).reshape(-1, n_classes) for t in nodes], [t["depth"] for t in nodes]


def fit(train: DataFrame, features: list[str], label_idx: str, n_classes: int, num_trees: int, seed: int,
        max_depth: int | None, max_bins: int, group_rows: int = GROUP_ROWS) -> Forest:
    """The result depends on the rows' values only, not on their order or dealing.
    ``max_bins`` is the number of ranges large nodes are searched by, and changes no split."""
    n_features, bagged = len(features), num_trees > 1

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in _values(batch.columns[:-1])], pa.binary()),
                                              batch.column(n_features)], names=["values", "label"])

    plain = train.select(*[F.col(ident(c)).cast("double").alias(f"x{i}") for i, c in enumerate(features)],
                         F.col(ident(label_idx)).cast("int").alias("label"))
    table = materialize(plain.mapInArrow(packed, "values binary, label int").groupBy("values", "label").agg(
        F.count(F.lit(1)).alias("n")).withColumn("digest", F.xxhash64("values", "label")), "forest-rows")
    n_rows = table.agg(F.sum("n")).first()[0] or 0
    edges = range_edges(train, features, min(max_bins, RANGES)) if n_rows > group_rows else []
    tops, top_probs, depth = _grow_top(table, edges, n_features, n_classes, num_trees, max_depth, seed, bagged, group_rows)

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            values, digest, label, copies = _read(batch)
            for tree in range(num_trees):
                at, drawn, weight = _bags(values, digest, label, copies, tops, tree, seed, bagged)
                out = [(tree, int(n), values[drawn[at == n]].tobytes(), label[drawn[at == n]].astype(np.int32).tobytes(),
                        weight[at == n].tobytes()) for n in np.unique(at)]
                if out:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(zip(*out, strict=True), (
                            pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)],
                        names=["tree", "node", "values", "label", "weight"])

    def subtree(group: pa.Table) -> pa.Table:
        tree, node = group["tree"][0].as_py(), group["node"][0].as_py()
        join = lambda c, t: np.frombuffer(b"".join(group[c].to_pylist()), t)
        made, probs = grow(join("values", np.float32).reshape(-1, n_features), join("label", np.int32).astype(np.int64),
                           join("weight", np.int64).astype(np.float64), n_classes,
                           None if max_depth is None else max_depth - depth[tree][node], seed, tree, node)
        return pa.table({"tree": pa.array([tree], pa.int32()), "node": pa.array([node], pa.int32()),
                         "feature": [made.feature.astype(np.int32).tobytes()], "cut": [made.cut.tobytes()],
                         "child": [made.child.astype(np.int32).tobytes()], "probs": [probs.tobytes()]})

    drawn = table.mapInArrow(bags, "tree int, node int, values binary, label binary, weight binary")
    tasks = max(8, n_rows * num_trees // TASK_ROWS)
    subtrees = drawn.repartition(tasks, "tree", "node").groupBy("tree", "node").applyInArrow(subtree, _SUBTREES)
    return Forest(list(features), n_classes, tops, top_probs, materialize(subtrees, "forest-trees"))


def probabilities(forest: Forest, df: DataFrame, out: str) -> DataFrame:
    """``df`` with the mean of the trees' leaf probabilities (``out``, an array).

    Blocks of rows meet the subtrees by (tree, node, block), in groups of
    a block each; the votes of a block are added up in one group."""
    n_features, n_classes, n_trees = len(forest.features), forest.n_classes, len(forest.tops)
    tops, top_probs = forest.tops, forest.top_probs
    rows = materialize(df.withColumn("__row", F.monotonically_increasing_id()), "forest-in")

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(lo, BLOCK_ROWS)
                values, ids = _values(part.columns[:-1]), part.column(n_features).to_numpy()
                for tree in range(n_trees):
                    at = tops[tree].walk(values)
                    done = []
                    for n in np.unique(at):
                        mine = np.flatnonzero(at == n)
                        settled = tops[tree].feature[n] == LEAF
                        votes = np.tile(top_probs[tree][tops[tree].child[n]], (len(mine), 1)).tobytes() if settled else None
                        done.append((int(ids[0]), tree, int(n), ids[mine].tobytes(), values[mine].tobytes(), votes))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(zip(*done, strict=True), (
                            pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)],
                        names=["block", "tree", "node", "ids", "values", "votes"])

    def vote(left: pa.Table, right: pa.Table) -> pa.Table:
        found = []
        if len(right):
            tree = Tree(*(np.frombuffer(right[c][0].as_py(), t) for c, t in (
                ("feature", np.int32), ("cut", np.float64), ("child", np.int32))))
            probs = np.frombuffer(right["probs"][0].as_py(), np.float32).reshape(-1, n_classes)
        for r in left.to_pylist():
            votes = r["votes"]
            if votes is None:
                votes = probs[tree.child[tree.walk(np.frombuffer(r["values"], np.float32).reshape(-1, n_features))]].tobytes()
            found.append((r["block"], r["ids"], votes))
        return pa.table({"block": pa.array([x[0] for x in found], pa.int64()),
                         "ids": pa.array([x[1] for x in found], pa.binary()),
                         "votes": pa.array([x[2] for x in found], pa.binary())})

    def add(group: pa.Table) -> pa.Table:
        ids = np.concatenate([np.frombuffer(x, np.int64) for x in group["ids"].to_pylist()])
        votes = np.concatenate([np.frombuffer(x, np.float32) for x in group["votes"].to_pylist()]).reshape(-1, n_classes)
        row, at = np.unique(ids, return_inverse=True)
        order = np.lexsort((*votes.T[:1], at))  # one order of adding, however the votes arrive
        total = np.zeros((len(row), n_classes))
        np.add.at(total, at[order], votes[order].astype(np.float64))
        total /= n_trees
        return pa.table({"__row": pa.array(row, pa.int64()), out: pa.ListArray.from_arrays(
            pa.array(np.arange(len(row) + 1) * n_classes, pa.int32()), pa.array(total.ravel()))})

    narrow = rows.select(*[F.col(ident(c)).cast("double").alias(f"x{i}") for i, c in enumerate(forest.features)], "__row")
    n = rows.count()
    salts = max(1, n // (16 * BLOCK_ROWS))  # a group meets some blocks of one subtree
    asked = narrow.mapInArrow(blocks, "block bigint, tree int, node int, ids binary, values binary, votes binary") \
        .withColumn("salt", F.pmod(F.xxhash64("block"), F.lit(salts)).cast("int"))
    trees = forest.subtrees.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    key = ("tree", "node", "salt")
    votes = asked.groupBy(*key).cogroup(trees.groupBy(*key)).applyInArrow(vote, "block bigint, ids binary, votes binary")
    summed = votes.groupBy("block").applyInArrow(add, f"__row bigint, {out} array<double>")
    return rows.join(summed, "__row").drop("__row")
