"""Language-model scores by logistic context mixing over running text.

A text is its lower-case words and an end mark, coded as one stream of bytes
(every word is closed by a space) and each byte as binary decisions down a code
tree, in which the training texts' frequent bytes lie high (Huffman's; it spares
decisions, every byte keeps its leaf).  For each decision several predictors
look up counts under a hash of the last one to six bytes of the text, across the
bounds of words; a text begins behind spaces.  Their log-odds are added with
weights that a gate picks by how many contexts are known and how deep in the
tree the decision is, and a probability map refines the outcome.

Learning covers all training texts: their runs of seven bytes (a byte and the
six before it) are counted, and the count table (one row per distinct run)
feeds the predictors, the first weights and the first map, every occurrence
predicted from the counts of all the others.  From there every text, while it
is scored, keeps weights of its own that learn from each decision and shifts of
the map of its own under every node of the tree.  Nothing learned reaches a byte
before it is coded, so the probabilities stay proper.

Behind the bytes, several rates of trust in whole training words and in the
words seen so far in the text compete by their own success.

The score is the log10 probability of the token sequence; the bits per byte
follow from it.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlens.llm.common import (
    NON_SPACE, Words, free_name, lists, mix64, raw_bytes, slices, sum_ranges, text_column, word_hashes,
)
from flowlens.operators._small import materialize

ORDERS = (1, 2, 3, 4, 5, 6)
#: Log2 of the slots of each order's count table.
SLOTS = (16, 18, 19, 20, 20, 20)
#: Distinct runs per learning task, and words per task that hands words on.
TASK_RUNS = 1 << 20
TASK_WORDS = 400_000
#: Runs counted by a task before they are handed on.
HELD_RUNS = 1 << 21
#: Text coded together by a task, and texts.
CODED_BYTES = 1 << 21
CODED_TEXTS = 1 << 12
#: Words whose counts travel to the scoring tasks; the rest meet by a join.
HOT_WORDS = 1 << 21
END = 0xFF
#: Rates of trust in the text's own words and in the training words as wholes;
#: all pairs compete while a text is scored.
TRUST = (0.0, 0.05, 0.2, 0.5, 0.9)
WHOLE = (0.7, 0.93)
PATHS = tuple((whole, trust) for whole in WHOLE for trust in TRUST)
BUCKETS = 33
#: Learning rates of a text's weights and of its shifts of the map.
RATE = np.float32(0.004)
SHIFT_RATE = np.float32(0.05)
#: A text learns after every byte up to twice this place, then after every
#: 1 / PACE of the bytes it has had so far, MOST bytes at most.
PACE = 1 << 9
MOST = 1 << 12
_DELTA = np.float32(0.4)
_LIMIT = np.float32(8.0)
_GRAIN = np.float32(127 / 8.0)  # log-odds are held in signed bytes
#: The learning rates where errors are differences of tanh, twice as large, for half log-odds and inputs in grains.
_WEIGHT_STEP = float(RATE) / (4 * float(_GRAIN) ** 2)
_SHIFT_STEP = float(SHIFT_RATE) / 4
_STEP = 1 << 14  # runs that the first weights learn from together
_LOOK = 1 << 13  # bytes of texts whose inputs are looked up together
_TAIL = 256  # the last place of a table has room for all nodes
_BASES = np.concatenate([[0], np.cumsum([(1 << s) + _TAIL for s in SLOTS])])
_INPUTS = len(ORDERS)  # an even number
_DEEP = 32  # deeper than any tree
_DEPTHS = 12  # depths with gates of their own; the rest share the last
_GATES = (len(ORDERS) + 1) * _DEPTHS
_RUN = np.uint64((1 << 56) - 1)
_ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))

_PLACES = 64
_NUMBERS = mix64(np.arange(1, _PLACES * 256 + 1, dtype=np.uint64) * _ODD[0])


class Coded:
    """Words as bytes with closing spaces.  ``run[i]`` holds byte i in its low
    eight bits and the six bytes in front of it above them; byte i belongs to
    token ``owner[i]`` (the words, then the end marks) and to text ``unit[i]``,
    where it has place ``place[i]``.

    With ``first`` text i owns words ``first[i]:first[i + 1]`` and an end mark;
    without, every word and each of ``ends`` end marks is a text of its own.
    """

    def __init__(self, words: pa.StringArray, ends: int = 0, first: np.ndarray | None = None) -> None:
        n = len(words)
        size = np.diff(np.frombuffer(words.buffers()[1], np.int32)[words.offset:words.offset + n + 1]).astype(np.int64) \
            if n else np.zeros(0, np.int64)
        if first is None:
            token = np.arange(n + ends)
            tokens_of = np.ones(n + ends, np.int64)
        else:
            ends = len(first) - 1
            token = np.empty(n + ends, np.int64)
            closing = first[1:] + np.arange(ends)
            plain = np.ones(n + ends, bool)
            plain[closing] = False
            token[closing], token[plain] = n + np.arange(ends), np.arange(n)
            tokens_of = np.diff(first) + 1
        length = np.concatenate([size + 1, np.ones(ends, np.int64)])[token]
        start = np.concatenate([[0], np.cumsum(length)])
        unit_start = start[np.concatenate([[0], np.cumsum(tokens_of)])]
        total, units = int(start[-1]), len(tokens_of)
        lead = 7  # spaces in front of every text
        self.tokens, self.units, self.size = n + ends, units, total
        unit_size = np.diff(unit_start)
        small = np.int32 if total < 1 << 31 else np.int64
        self.unit = np.repeat(np.arange(units, dtype=np.int32), unit_size)
        self.place = np.arange(total, dtype=small)
        self.place -= np.repeat(unit_start[:-1].astype(small), unit_size)
        body = np.full(total + lead * units, 0x20, np.uint8)
        inside = np.ones(len(body), bool)
        front = (unit_start[:-1] + lead * np.arange(units))[:, None] + np.arange(lead)
        inside[front] = False
        own = inside.copy()
        closing = start[1:] - 1
        closing += lead * np.repeat(np.arange(1, units + 1), tokens_of)
        inside[closing] = False
        if size.any():
            begin = np.frombuffer(words.buffers()[1], np.int32)[words.offset]
            body[inside] = np.frombuffer(words.buffers()[2], np.uint8)[begin:begin + size.sum()]
        body[closing[token >= n]] = END
        self.owner = np.repeat(token.astype(np.int32), length)
        runs = np.ndarray((max(len(body) - 7, 0),), ">u8", body, strides=(1,)).astype(np.uint64)
        runs &= _RUN
        self.run = runs[own[7:]]


@dataclass
class Tree:
    """Binary code of the bytes: ``length`` and ``start`` of each path, ``step``
    the paths' decisions as node, bit and depth in one number; nodes are
    numbered by weight."""

    length: np.ndarray
    start: np.ndarray
    step: np.ndarray

    @staticmethod
    def of(counts: np.ndarray) -> Tree:
        """Huffman's tree; rare bytes count as one in 8,192 at least."""
        weight = counts.astype(np.int64) + int(counts.sum()) // 8192 + 1
        heap = [(int(w), i) for i, w in enumerate(weight)]
        heapq.heapify(heap)
        parent, side = [0] * 511, [0] * 511
        for new in range(256, 511):  # lighter nodes come first
            (w, i), (v, j) = heapq.heappop(heap), heapq.heappop(heap)
            parent[i] = parent[j] = new
            side[j] = 1
            heapq.heappush(heap, (w + v, new))
        steps, length = [], np.zeros(256, np.int64)
        for byte in range(256):
            path, at = [], byte
            while at != 510:
                path.append((510 - parent[at]) << 1 | side[at])
                at = parent[at]
            length[byte] = len(path)
            steps += [step << 4 | min(depth, _DEPTHS - 1) for depth, step in enumerate(reversed(path))]
        return Tree(length, np.cumsum(length) - length, np.array(steps, np.int16))


def _contexts(run: np.ndarray) -> Iterator[np.ndarray]:
    """For every order the slot of the first node behind the runs' contexts."""
    front = run >> np.uint64(8)
    for k, order in enumerate(ORDERS):
        h = front & np.uint64((1 << 8 * order) - 1)
        h += np.uint64(order << 56)
        h *= _ODD[0]
        h ^= h >> np.uint64(29)
        h *= _ODD[1]
        h ^= h >> np.uint64(32)
        h *= _ODD[2]
        h >>= np.uint64(64 - SLOTS[k])
        h += np.uint64(_BASES[k])
        yield h.view(np.int64)


def _paths(run: np.ndarray, tree: Tree) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first decision of each run and the end, run, depth, node, bit of each decision)."""
    key = (run & np.uint64(0xFF)).view(np.int64)
    length = tree.length.take(key, mode="clip")
    first = np.zeros(len(run) + 1, np.int64)
    np.cumsum(length, out=first[1:])
    of = np.repeat(np.arange(len(run)), length)
    at = (tree.start.take(key, mode="clip") - first[:-1]).take(of, mode="clip")
    at += np.arange(len(of))
    step = tree.step.take(at, mode="clip")
    return first, of, (step & np.int16(15)).astype(np.int8), (step >> np.int16(5)).astype(np.int64), \
        (step >> np.int16(4)).astype(np.int8) & np.int8(1)


def decisions(run: np.ndarray, tree: Tree) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first decision of each run and the end, depths, nodes, bits, slots of all
    orders) of the decisions of the runs' last bytes; a context's nodes are
    neighbours in a table."""
    first, of, depth, node, bit = _paths(run, tree)
    slots = np.empty((len(ORDERS), len(of)), np.int64)
    for at, h in zip(slots, _contexts(run), strict=True):
        h.take(of, out=at, mode="clip")
        at += node
    return first, depth, node, bit, slots


@dataclass
class Model:
    counts: np.ndarray | None  # 2 x slots: zeros and ones seen
    weights: np.ndarray  # gates x inputs
    refined: np.ndarray  # nodes x buckets: log-odds behind the map
    tree: Tree | None = None  # without one, all bytes lie eight deep
    odds: np.ndarray | None = None  # slots: log-odds in grains, 0 where nothing was seen

    def __post_init__(self) -> None:
        if self.tree is None:
            self.tree = Tree.of(np.zeros(256, np.int64))
        if self.odds is None:
            odds, seen = _log_odds(self.counts[0], self.counts[1])
            grains = np.rint(odds * _GRAIN).astype(np.int8)
            grains[seen & (grains == 0)] = 1
            self.odds = grains

    def fixed(self) -> Model:
        """What scoring needs."""
        return Model(None, self.weights, self.refined, self.tree, self.odds)

    def inputs(self, slots: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(log-odds of the predictors, gate)."""
        grains = self.odds.take(slots)
        known = np.zeros(len(depth), np.int8)
        for g in grains:
            known += (g != 0).view(np.int8)
        known *= np.int8(_DEPTHS)
        x = grains.astype(np.float32)
        x *= 1 / _GRAIN
        return x, depth + known

    def inputs_without(self, slots: np.ndarray, depth: np.ndarray, bit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same with the occurrence itself taken out of the counts."""
        x = np.empty(slots.shape, np.float32)
        known = np.zeros(len(depth), np.int64)
        one = bit.astype(np.float32)  # single precision throughout, as the counts are
        for k, s in enumerate(slots):
            x[k], seen = _log_odds(np.maximum(self.counts[0].take(s) - (1 - one), 0),
                                   np.maximum(self.counts[1].take(s) - one, 0))
            known += seen
        return x, known * _DEPTHS + depth

    def mixed(self, x: np.ndarray, gate: np.ndarray) -> np.ndarray:
        z = np.zeros(gate.shape, np.float32)
        for k in range(_INPUTS):
            z += x[k] * self.weights[:, k].take(gate)
        return np.clip(z, -_LIMIT * np.float32(1.4), _LIMIT * np.float32(1.4))

    def log_probability(self, coded: Coded) -> np.ndarray:
        """Natural log probability of every token.

        All texts are coded side by side, each with weights and map shifts of
        its own.  The decisions of a byte differ in node and, but for the
        deepest, in gate, so learning after the byte is learning after each
        decision.  Late in a long text some bytes go together (see PACE): their
        decisions use what was learned in front of them all."""
        if not coded.size:
            return np.zeros(coded.tokens)
        step = _learning_steps(coded.place)
        order = np.argsort(step, kind="stable")
        bounds = np.concatenate([[0], np.cumsum(np.bincount(step))])
        del step
        # half log-odds throughout, as tanh takes them; inputs stay in grains, and
        # two of them (or their weights) lie side by side as one complex number
        pairs = _INPUTS // 2
        weights = np.tile((self.weights / (2 * _GRAIN)).astype(np.float32).ravel().view(np.complex64)
                          .reshape(-1, pairs).T, coded.units)
        shift = np.zeros(coded.units << 8, np.float32)
        rise = np.diff(self.refined, append=np.float32(0)) / 4
        slope = rise.astype(np.float32).ravel()
        level = (self.refined / 4 - rise * np.arange(BUCKETS)).astype(np.float32).ravel()
        top, low_, high = _LIMIT * np.float32(0.7), -_LIMIT / 2, _LIMIT * np.float32(0.5 - 5e-7)
        scale, half = np.float32((BUCKETS - 1) / _LIMIT), np.float32(0.5)
        middle = np.float32((BUCKETS - 1) / 2)
        cost = np.empty(coded.size)
        done = 0
        while done < len(bounds) - 1:
            # the inputs of some steps at once; they don't change with learning
            last = max(done + 1, int(np.searchsorted(bounds, bounds[done] + _LOOK, side="right")) - 1)
            lo, hi = int(bounds[done]), int(bounds[last])
            bytes_ = order[lo:hi]
            first, gates, cells, places, sign, inputs = self._looked_up(coded.run.take(bytes_), coded.unit.take(bytes_))
            n = len(gates)
            mixed = np.empty(n, np.float32)
            held = np.empty((pairs, n), np.complex64)
            ends = first[bounds[done:last + 1] - lo].tolist()
            blocks = _blocks(coded.place[order[bounds[done:last]]]).tolist()
            for block, a, b in zip(blocks, ends, ends[1:]):
                # many bytes of a text move it like four, or they would overshoot
                slow = min(1.0, 4 / block)
                gate, own, s = gates[a:b], cells[a:b], sign[a:b]
                x = inputs[:, a:b]
                w = held[:, :b - a]
                for k in range(pairs):
                    weights[k].take(gate, out=w[k], mode="clip")
                z = np.add.reduce(w.view(np.float32) * x.view(np.float32), 0)
                z = z[0::2] + z[1::2]
                np.minimum(np.maximum(z, -top, out=z), top, out=z)
                error = s - np.tanh(z)
                error *= np.float32(_WEIGHT_STEP * slow)
                bucket = np.minimum(np.maximum(z, low_), high)
                bucket *= scale
                bucket += middle
                at = bucket.astype(np.int64)
                at += places[a:b]
                bucket *= slope.take(at, mode="clip")
                bucket += level.take(at, mode="clip")
                z *= half
                z += bucket
                z += shift.take(own, mode="clip")
                mixed[a:b] = z
                late = s - np.tanh(z)
                late *= np.float32(_SHIFT_STEP * slow)
                np.add.at(shift, own, late)
                x *= error
                for k in range(pairs):
                    np.add.at(weights[k], gate, x[k])
            sign *= np.float32(-2)
            mixed *= sign
            np.minimum(np.maximum(mixed, -4 * top, out=mixed), 4 * top, out=mixed)
            np.log1p(np.exp(mixed, out=mixed), out=mixed)
            cost[lo:hi] = np.add.reduceat(mixed, first[:-1])
            done = last
        return -np.bincount(coded.owner[order], cost, coded.tokens)

    def _looked_up(self, run: np.ndarray, unit: np.ndarray) -> tuple[np.ndarray, ...]:
        """What the decisions of some bytes need besides what their texts have
        learned: (first of each byte and the end, the text's gate, the text's
        shift, the first of the map's buckets, 1 or -1 for the bit, inputs)."""
        first, of, depth, node, bit = _paths(run, self.tree)
        grains = np.empty((_INPUTS // 2, len(of), 2), np.int8)
        known = np.zeros(len(of), np.int8)
        slot, grain = np.empty(len(of), np.int64), np.empty(len(of), np.int8)
        for k, h in enumerate(_contexts(run)):
            h.take(of, out=slot, mode="clip")
            slot += node
            self.odds.take(slot, out=grain, mode="clip")
            known += (grain != 0).view(np.int8)
            grains[k >> 1, :, k & 1] = grain
        known *= np.int8(_DEPTHS)
        known += depth
        unit = unit.astype(np.int64).take(of, mode="clip")
        gates = unit * _GATES
        gates += known
        unit <<= 8
        unit += node
        node *= BUCKETS
        bit <<= 1
        bit -= 1
        return first, gates, unit, node, bit.astype(np.float32), grains.astype(np.float32).view(np.complex64)[:, :, 0]


def _block(place: int) -> int:
    """Bytes that go together from a place of a text on."""
    return max(1, min(place // PACE, MOST))


def _blocks(place: np.ndarray) -> np.ndarray:
    return np.clip(place // PACE, 1, MOST)


def _learning_steps(place: np.ndarray) -> np.ndarray:
    """The step of learning in which a place of a text is coded."""
    bounds = [2 * PACE]
    end = int(place.max()) + 1
    while bounds[-1] < end:
        bounds.append(bounds[-1] + _block(bounds[-1]))
    kind = np.uint16 if 2 * PACE + len(bounds) < 1 << 16 else np.int64  # small numbers sort faster
    late = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds)) + 2 * PACE
    return np.concatenate([np.arange(2 * PACE), late]).astype(kind).take(place)


def _log_odds(zeros: np.ndarray, ones: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    odds = np.log(ones + _DELTA) - np.log(zeros + _DELTA)
    return np.clip(odds, -_LIMIT, _LIMIT).astype(np.float32), (zeros + ones) > 0


def _bucket(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = (np.clip(z, -_LIMIT, _LIMIT) + _LIMIT) * ((BUCKETS - 1) / (2 * _LIMIT))
    low = np.minimum(at.astype(np.int64), BUCKETS - 2)
    return at - low, low


def _start_weights() -> np.ndarray:
    return np.full((_GATES, _INPUTS), 0.3, np.float32)


def _start_map() -> np.ndarray:
    return np.tile(np.linspace(-_LIMIT, _LIMIT, BUCKETS, dtype=np.float32), (256, 1))


# ---- learning, over the tables (word, n), an end mark is the null word, and (run, n)


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = text_column(batch, "t")
        for lo, hi in slices(texts):
            coded = Words(texts.slice(lo, hi - lo), NON_SPACE).words.dictionary_encode()
            n = np.bincount(coded.indices.to_numpy(zero_copy_only=False), minlength=len(coded.dictionary)) \
                if len(coded) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.concat_arrays([coded.dictionary.cast(pa.string()), pa.array([None], pa.string())]),
                 pa.array(np.append(n, hi - lo), pa.int64())], names=["word", "n"])


def _count_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of seven bytes of the running texts, counted by task."""
    def merged(parts: list) -> tuple[np.ndarray, np.ndarray]:
        run, n = (np.concatenate(c) for c in zip(*parts, strict=True))
        order = np.argsort(run, kind="stable")
        run = run[order]
        first = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]]))
        return run[first], np.add.reduceat(n[order], first)

    def batch_of(run: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(run.view(np.int64)), pa.array(n)], names=["run", "n"])

    held, size = [], 0
    for batch in batches:
        texts = text_column(batch, "t")
        for lo, hi in slices(texts, CODED_BYTES):
            words = Words(texts.slice(lo, hi - lo), NON_SPACE)
            run = np.sort(Coded(words.words, first=words.first).run)
            first = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]]))
            held.append((run[first], np.diff(np.append(first, len(run)))))
            size += len(first)
            if size > HELD_RUNS:
                held = [merged(held)]
                size = len(held[0][0])
                if size > HELD_RUNS // 2:
                    yield batch_of(*held[0])
                    held, size = [], 0
    if held:
        yield batch_of(*merged(held))


def _parts(batches: Iterator[pa.RecordBatch], tree: Tree) -> Iterator[tuple]:
    """(depths, nodes, bits, slots) of the decisions of bounded parts of a task's
    runs and how often each occurs."""
    for batch in batches:
        run, n = batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy().astype(np.float64)
        for lo in range(0, len(run), _STEP):
            first, *found = decisions(run[lo:lo + _STEP], tree)
            yield *found, np.repeat(n[lo:lo + _STEP], np.diff(first))


def _fill(shared):
    """Zeros and ones under every slot of the count tables."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, _BASES[-1]))
        flat = counts.ravel()
        for _, _, bit, slots, times in _parts(batches, shared.value):
            for s in slots:
                np.add.at(flat, s + bit * _BASES[-1], times)
        at = np.flatnonzero(counts.sum(0))
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(counts[0, at]), pa.array(counts[1, at])],
                                         names=["slot", "zeros", "ones"])
    return run


def _learn_weights(shared):
    """Online learning over a task's runs: weights and their evidence."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        model = Model(model.counts, model.weights.copy(), model.refined, model.tree, model.odds)
        evidence = np.zeros(_GATES)
        for round_, (depth, _, bit, slots, times) in enumerate(_parts(batches, model.tree)):
            rate = 0.08 / math.sqrt(1 + round_ / 16)
            x, gate = model.inputs_without(slots, depth, bit)
            p = 1 / (1 + np.exp(-model.mixed(x, gate)))
            weight = np.bincount(gate, times, _GATES)
            error = (bit - p) * times
            for k in range(_INPUTS):
                step = np.bincount(gate, error * x[k], _GATES) / np.maximum(weight, 1)
                model.weights[:, k] += (rate * step).astype(np.float32)
            evidence += weight
        g, k = np.meshgrid(np.arange(_GATES), np.arange(_INPUTS), indexing="ij")
        yield pa.RecordBatch.from_arrays(
            [pa.array(g.ravel(), pa.int32()), pa.array(k.ravel(), pa.int32()),
             pa.array((model.weights * evidence[:, None]).ravel().astype(np.float64)),
             pa.array(np.repeat(evidence, _INPUTS))], names=["gate", "input", "weighted", "evidence"])
    return run


def _learn_map(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        seen = np.zeros((2, 256 * BUCKETS))
        for depth, node, bit, slots, times in _parts(batches, model.tree):
            place, low = _bucket(model.mixed(*model.inputs_without(slots, depth, bit)))
            for side, share in ((low, 1 - place), (low + 1, place)):
                for v in (0, 1):
                    seen[v] += np.bincount(node * BUCKETS + side, share * times * (bit == v), 256 * BUCKETS)
        at = np.flatnonzero(seen.sum(0))
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(seen[0, at]), pa.array(seen[1, at])],
                                         names=["place", "zeros", "ones"])
    return run


def fit(runs: DataFrame) -> Model:
    """Model from the table (run, n) of all bytes of the training texts.
    Tables of a fixed size reach the driver; a task learns from TASK_RUNS runs."""
    spark = runs.sparkSession
    counted = materialize(runs, "lm-runs")
    tasks = max(1, -(-counted.count() // TASK_RUNS))
    dealt = materialize(counted.repartition(tasks, F.xxhash64("run")), "lm-dealt")
    bytes_ = counted.groupBy(F.col("run").bitwiseAND(F.lit(0xFF)).alias("byte")).agg(F.sum("n").alias("n")).toArrow()
    often = np.zeros(256, np.int64)
    often[bytes_["byte"].to_numpy()] = bytes_["n"].to_numpy()
    tree = Tree.of(often)
    filled = dealt.coalesce(tasks).mapInArrow(_fill(spark.sparkContext.broadcast(tree)), "slot int, zeros double, ones double").groupBy("slot").agg(
        F.sum("zeros").cast("float").alias("zeros"), F.sum("ones").cast("float").alias("ones")).toArrow()
    counts = np.zeros((2, _BASES[-1]), np.float32)
    at = filled["slot"].to_numpy()
    counts[0, at], counts[1, at] = filled["zeros"].to_numpy(), filled["ones"].to_numpy()
    del filled
    model = Model(counts, _start_weights(), _start_map(), tree)

    learned = dealt.coalesce(tasks).mapInArrow(
        _learn_weights(spark.sparkContext.broadcast(model)), "gate int, input int, weighted double, evidence double") \
        .groupBy("gate", "input").agg(F.sum("weighted").alias("w"), F.sum("evidence").alias("e")).where("e > 0").toArrow()
    weights = model.weights.copy()
    weights[learned["gate"].to_numpy(), learned["input"].to_numpy()] = learned["w"].to_numpy() / learned["e"].to_numpy()
    model = Model(counts, weights, model.refined, tree, model.odds)

    mapped = dealt.coalesce(tasks).mapInArrow(
        _learn_map(spark.sparkContext.broadcast(model)), "place int, zeros double, ones double").groupBy("place").agg(
        F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones")).toArrow()
    refined = model.refined.astype(np.float64).ravel()
    at, zeros, ones = (mapped[c].to_numpy() for c in ("place", "zeros", "ones"))
    prior = 1 / (1 + np.exp(-refined[at]))  # as strong as a few decisions
    refined[at] = np.log(ones + 4 * prior) - np.log(zeros + 4 * (1 - prior))
    return Model(counts, weights, refined.reshape(256, BUCKETS).astype(np.float32), tree, model.odds).fixed()


# ---- scoring


def _own_share(word: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For every token the share that its word has among the tokens before it
    in its text (0 for the first)."""
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    order = np.argsort(text * (int(word.max()) + 1) + word, kind="stable")  # by text, word, place
    same = np.concatenate([[False], (word[order][1:] == word[order][:-1]) & (text[order][1:] == text[order][:-1])])
    place = np.arange(len(word))
    run = place - np.maximum.accumulate(np.where(same, 0, place))
    before = np.empty(len(word))
    before[order] = run
    return before / np.maximum(place - first[text], 1)


def score_slice(known: np.ndarray, words: Words, word: np.ndarray, share: np.ndarray, own: np.ndarray,
                settled: np.ndarray) -> np.ndarray:
    """Log probability of each text of a slice on every path of PATHS, without
    the tokens that are not ``settled`` (they follow by ``rare_terms``);
    ``known`` holds the log probability as coded bytes of every token and then of
    every text's end mark; ``word`` places every token among the distinct
    words, of which ``share`` holds the share of the training tokens; ``own`` is
    the token's share of its text so far.

    A token's probability mixes the coded bytes, the word's training share and
    its share of the text so far.  Every pair of trust rates keeps its own
    running product; the text's probability is their mean, in which the pair
    that fits the text best prevails.  The end mark comes from the bytes."""
    known, end = known[:len(word)], known[len(word):]
    spelled = np.exp(known)
    n = words.per_text()
    paths = []
    for whole, trust in PATHS:
        base = whole * share[word] + (1 - whole) * spelled if len(word) else np.zeros(0)
        step = np.log(np.maximum((1 - trust) * base + trust * own, 1e-300))
        # a word too long for double precision keeps its logarithm
        lost = np.flatnonzero((base < 1e-290) & (own * trust == 0))
        step[lost] = known[lost] + math.log1p(-trust) + math.log1p(-whole)
        paths.append(sum_ranges(np.where(settled, step, 0.0), words.first) + end + n.astype(bool) * math.log1p(-trust))
    return np.stack(paths, 1)


def rare_terms(share: Column, spelled: Column, own: Column) -> list[Column]:
    """The step of ``score_slice`` of one token on every path; ``spelled`` is
    the word's log probability as coded bytes."""
    terms = []
    for whole, trust in PATHS:
        base = F.lit(whole) * share + F.lit(1 - whole) * F.exp(spelled)
        terms.append(F.when((base < 1e-290) & (own * F.lit(trust) == 0),
                            spelled + F.lit(math.log1p(-trust) + math.log1p(-whole)))
                     .otherwise(F.log(F.greatest(F.lit(1 - trust) * base + F.lit(trust) * own, F.lit(1e-300)))))
    return terms


def _coded_slices(texts: pa.StringArray) -> Iterator[tuple[int, int]]:
    """Row ranges of at most CODED_BYTES (or one text) and CODED_TEXTS."""
    for lo, hi in slices(texts, CODED_BYTES):
        for at in range(lo, hi, CODED_TEXTS):
            yield at, min(at + CODED_TEXTS, hi)


def _score(shared, fields: list[str], text_col: str, schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, hashes, n_hot, end_n, tokens, total, all_hot = shared.value
        for batch in batches:
            # texts of a length go together: they reach their ends at the same step
            size = pc.binary_length(text_column(batch, text_col))
            batch = batch.take(pc.sort_indices(size))
            texts = text_column(batch, text_col)
            for lo, hi in _coded_slices(texts):
                words = Words(texts.slice(lo, hi - lo), NON_SPACE)
                coded = words.words.dictionary_encode()
                word = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
                distinct = coded.dictionary.cast(pa.string())
                code = _word_codes(distinct)
                at = np.minimum(np.searchsorted(hashes, code), max(len(hashes) - 1, 0))
                hit = hashes[at] == code if len(hashes) else np.zeros(len(code), bool)
                n = np.where(hit, n_hot[at], 0.0) if len(hashes) else np.zeros(len(code))
                settled = np.ones(len(code), bool) if all_hot else hit
                level = np.where(settled, np.log10((n + 1) / total), 0.0)
                base = sum_ranges(level[word], words.first) + math.log10((end_n + 1) / total)
                known = model.log_probability(Coded(words.words, first=words.first))
                share, hit, settled = n / max(tokens, 1), hit[word], settled[word]
                own = _own_share(word, words.first) if len(word) else np.zeros(0)
                paths = score_slice(known, words, word, share, own, settled)
                rare = np.flatnonzero(~settled)
                tokens_of = pa.array(np.searchsorted(rare, words.first), pa.int32())
                left = pa.StructArray.from_arrays(
                    [words.words.take(pa.array(rare)), pa.array(known[rare]), pa.array(own[rare])],
                    names=["w", "p", "own"])
                rows = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays(
                    [*(rows.column(rows.schema.get_field_index(f)) for f in fields),
                     pa.array(words.per_text() + 1, pa.int64()),
                     pa.array(sum_ranges(hit.astype(np.int64), words.first) + int(end_n > 0), pa.int64()),
                     pa.array(sum_ranges(words.end - words.start + 1, words.first) + 1, pa.int64()),
                     pa.array(base), lists(paths.ravel(), np.arange(hi - lo + 1) * len(PATHS), pa.float64()),
                     pa.ListArray.from_arrays(tokens_of, left)],
                    names=schema.fieldNames())
    return run


def score_texts(docs: DataFrame, training: Column, text_col: str = "text", keep: list[str] | None = None,
                hot_words: int = HOT_WORDS) -> tuple[DataFrame, dict]:
    """Documents scored by a model of those for which ``training`` holds.

    Returns the frame (columns ``keep``, all by default, plus six) and the
    names of the six: ``n_tokens`` (words and one end), ``n_known`` (of them in
    training texts), ``train_tokens``, ``base_score`` (log10 probability under
    add-one counts), ``score`` (of the mixed model) and ``bits_per_byte`` of
    the coded tokens.

    The counts of the ``hot_words`` most frequent words or fewer travel to the
    scoring tasks, where every text is coded; the other words' counts come by a
    join, after which their terms of the base score and of every path of the
    score are added: no result depends on ``hot_words`` beyond rounding.  Null
    and empty texts are one end; without training texts the decisions of a text
    start even; repeated rows each get a row; an empty table gives an empty table.
    """
    spark = docs.sparkSession
    keep = docs.columns if keep is None else keep
    texts = docs.where(training).select(F.col(text_col).cast("string").alias("t"))
    counted = texts.mapInArrow(_count_words, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    words = materialize(counted, "lm-counts")
    totals = words.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0)),
                       F.coalesce(F.sum(F.when(F.col("word").isNull(), F.col("n"))), F.lit(0))).first()
    v, tokens, ends = (int(x) for x in totals)
    model = fit(texts.mapInArrow(_count_runs, "run bigint, n bigint").groupBy("run").agg(F.sum("n").alias("n")))

    level = F.floor(F.log2("n")).cast("int")
    cut, held = 0, 0
    for row in sorted(words.where("word IS NOT NULL").groupBy(level.alias("k")).count().collect(), reverse=True):
        if held + row["count"] > hot_words:
            cut = row["k"] + 1
            break
        held += row["count"]
    plain = words.where("word IS NOT NULL")
    hot = plain.where(F.col("n") >= (1 << cut)).repartition(max(1, -(-held // TASK_WORDS)), F.xxhash64("word")) \
        .mapInArrow(_hash_words, "h bigint, n bigint").toArrow()
    hashes = hot["h"].to_numpy().view(np.uint64) if len(hot) else np.zeros(0, np.uint64)
    order = np.argsort(hashes)
    n_hot = hot["n"].to_numpy()[order].astype(np.float64) if len(hot) else np.zeros(0)
    total = float(tokens + v + 1)
    shared = spark.sparkContext.broadcast((model, hashes[order], n_hot, ends, tokens, total, cut == 0))

    names = {k: free_name(docs, k) for k in
             ("n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")}
    row_id, rare, size, paths = (free_name(docs, c) for c in ("lm_row", "lm_rare", "lm_bytes", "lm_paths"))
    given = docs.select(*dict.fromkeys([*keep, text_col])).withColumn(row_id, F.monotonically_increasing_id())
    fields = [f for f in given.schema.fields if f.name in [*keep, row_id]]
    schema = T.StructType([
        *fields, T.StructField(names["n_tokens"], T.LongType()), T.StructField(names["n_known"], T.LongType()),
        T.StructField(size, T.LongType()),
        T.StructField(names["base_score"], T.DoubleType()), T.StructField(paths, T.ArrayType(T.DoubleType())),
        T.StructField(rare, T.ArrayType(T.StructType([
            T.StructField("w", T.StringType()), T.StructField("p", T.DoubleType()),
            T.StructField("own", T.DoubleType())])))])
    scored = materialize(given.mapInArrow(_score(shared, [f.name for f in fields], text_col, schema), schema), "lm-scores")

    open_ = scored.select(F.col(row_id).alias("r"), F.inline(rare)).join(
        plain.select(F.col("word").alias("w"), F.col("n").alias("c")).hint("merge"), "w", "left")
    terms = rare_terms(F.coalesce("c", F.lit(0)) / F.lit(float(max(tokens, 1))), F.col("p"), F.col("own"))
    of, b, k, steps = (free_name(docs, c) for c in ("lm_of", "lm_base", "lm_known", "lm_steps"))
    late = open_.groupBy(F.col("r").alias(of)).agg(
        F.sum(F.log10((F.coalesce("c", F.lit(0)) + 1) / F.lit(total))).alias(b), F.count("c").alias(k),
        F.array(*(F.sum(t) for t in terms)).alias(steps))
    out = scored.join(late.hint("merge"), F.col(row_id) == F.col(of), "left").withColumn(
        paths, F.coalesce(F.zip_with(paths, steps, lambda x, y: x + y), paths)) if cut else \
        scored.withColumn(b, F.lit(0.0)).withColumn(k, F.lit(0))
    top = F.array_max(paths)
    mean = F.aggregate(paths, F.lit(0.0), lambda acc, x: acc + F.exp(x - top)) / len(PATHS)
    out = out.withColumn(names["score"], (top + F.log(mean)) / math.log(10))
    return out.select(
        *keep, F.col(names["n_tokens"]), (F.col(names["n_known"]) + F.coalesce(k, F.lit(0))).alias(names["n_known"]),
        F.lit(tokens).cast("bigint").alias(names["train_tokens"]),
        (F.col(names["base_score"]) + F.coalesce(b, F.lit(0.0))).alias(names["base_score"]),
        F.col(names["score"]), (-F.col(names["score"]) * math.log2(10) / F.col(size)).alias(names["bits_per_byte"])), names


def _word_codes(words: pa.StringArray) -> np.ndarray:
    """A 64-bit hash of every word: the sum of numbers that stand for its bytes
    at their places (long words are hashed one by one)."""
    body, at = raw_bytes(words)
    size = np.diff(at)
    place = np.arange(len(body)) - np.repeat(at[:-1], size)
    place &= _PLACES - 1
    place <<= 8
    place += body
    sums = np.zeros(len(body) + 1, np.uint64)
    np.cumsum(_NUMBERS.take(place), out=sums[1:])
    code = mix64(sums[at[1:]] - sums[at[:-1]] + size.astype(np.uint64))
    far = np.flatnonzero(size > _PLACES)
    if len(far):
        code[far] = word_hashes(words.take(pa.array(far)))
    return code


def _hash_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hash and count of every word."""
    for batch in batches:
        words = text_column(batch, "word")
        yield pa.RecordBatch.from_arrays([pa.array(_word_codes(words).view(np.int64), pa.int64()), batch.column(1)],
                                         names=["h", "n"])
