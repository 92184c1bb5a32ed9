"""Context mixing over running text: contexts cross words, every text learns."""

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from flowlens.llm import context_mixing as cm
from flowlens.llm.common import NON_SPACE, Words


def coded(texts):
    words = Words(pa.array(texts, pa.string()), NON_SPACE)
    return cm.Coded(words.words, first=words.first)


def learned(texts):
    """Counts of the texts under first weights and the straight map."""
    runs = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["t"])
    counted = list(cm._count_runs([runs]))
    often = np.zeros(256, np.int64)
    for batch in counted:
        np.add.at(often, batch.column(0).to_numpy() & 0xFF, batch.column(1).to_numpy())
    tree = cm.Tree.of(often)

    class Shared:
        value = tree

    found = next(iter(cm._fill(Shared)(counted)))
    counts = np.zeros((2, cm._BASES[-1]), np.float32)
    at = found.column(0).to_numpy()
    counts[0, at], counts[1, at] = found.column(1).to_numpy(), found.column(2).to_numpy()
    return cm.Model(counts, cm._start_weights(), cm._start_map(), tree)


def naive(model, text):
    """One text, byte by byte, in double precision."""
    stream = [ord(" ")] * 6 + [b for w in text.lower().split() for b in [*w.encode(), 0x20]] + [cm.END]
    weights = model.weights.astype(float).copy()
    shift = np.zeros(256)
    total = 0.0
    for i in range(6, len(stream)):
        run = sum(stream[i - j] << 8 * j for j in range(7))
        _, depth, node, bit, slots = cm.decisions(np.array([run], np.uint64), model.tree)
        grains = model.odds[slots].astype(float)
        gate = (grains != 0).sum(0) * cm._DEPTHS + depth
        moves, shifts = [], []
        for d in range(len(node)):
            x = grains[:, d] / float(cm._GRAIN)
            z = np.clip(weights[gate[d]] @ x, -11.2, 11.2)
            moves.append((gate[d], float(cm.RATE) * (bit[d] - 1 / (1 + np.exp(-z))) * x))
            at = (np.clip(z, -8, 8) + 8) * (cm.BUCKETS - 1) / 16
            low = min(int(at), cm.BUCKETS - 2)
            left, right = model.refined[node[d], low:low + 2].astype(float)
            z = 0.5 * z + 0.5 * (left + (at - low) * (right - left)) + shift[node[d]]
            total -= np.log1p(np.exp(-z if bit[d] else z))
            shifts.append((node[d], float(cm.SHIFT_RATE) * (bit[d] - 1 / (1 + np.exp(-z)))))
        for g, move in moves:
            weights[g] += move
        for n, move in shifts:
            shift[n] += move
    return total


def test_running_texts_equal_a_byte_by_byte_loop_however_they_are_batched():
    rng = random.Random(3)
    names = ["alpha", "beta", "of", "the", "Gämma", "x" * 30]
    texts = [" ".join(rng.choices(names, k=rng.randint(0, 40))) for _ in range(12)] + ["", " ", "q"]
    model = learned(texts[:8])
    c = coded(texts)
    logs = model.log_probability(c)
    words = c.tokens - c.units
    first = np.concatenate([[0], np.cumsum([len(t.split()) for t in texts])])
    for i, text in enumerate(texts):
        got = logs[first[i]:first[i + 1]].sum() + logs[words + i]
        assert abs(got - naive(model, text)) < 1e-3 * abs(got), text
        assert np.allclose(model.log_probability(coded([text])).sum(), got, rtol=1e-9)


def test_a_word_depends_on_the_words_before_it():
    model = learned(["big cat small dog " * 50])
    near, far = model.log_probability(coded(["big cat", "dog cat"]))[[1, 3]]
    assert near > far + 1


def test_weights_and_map_learn_while_a_text_is_scored():
    model = learned(["the cat and the dog"] * 5)
    text = " ".join(["0123456789"[k % 10] * 3 for k in range(0, 300, 7)])
    logs = model.log_probability(coded([text]))[:-1]
    assert logs[-10:].mean() > logs[:10].mean() + 1


def test_long_texts_learn_to_their_end_and_stay_finite():
    rng = random.Random(4)
    text = "ab " * 20_000 + " ".join(str(rng.randint(0, 9)) for _ in range(20_000)) + " zz" * 20_000
    logs = learned(["ab cd"]).log_probability(coded([text]))
    assert np.isfinite(logs).all() and logs.min() > -300
    assert logs[15_000:20_000].mean() > logs[:500].mean() and logs[-5_000:-1].mean() > logs[40_000:40_200].mean()


def test_every_byte_keeps_its_leaf():
    for counts in (np.zeros(256, np.int64), 2 ** np.minimum(np.arange(256), 40)):
        tree = cm.Tree.of(counts)
        assert (0.5 ** tree.length).sum() == 1 and tree.length.max() < cm._DEEP
    runs = np.arange(256, dtype=np.uint64) + np.uint64(0x6162636465 << 8)
    model = learned(["abcdef abcde"])
    first, depth, _, bit, slots = cm.decisions(runs, model.tree)
    z = model.mixed(*model.inputs(slots, depth))
    logs = np.add.reduceat(-np.logaddexp(0, np.where(bit == 1, -z, z).astype(float)), first[:-1])
    assert abs(np.exp(logs).sum() - 1) < 1e-4


def test_shuffled_words_score_worse(spark):
    rng = random.Random(5)
    names = [f"{a}{b}" for a in "bcdfgh" for b in ("an", "el", "ix")]
    texts = [" ".join(names[(s + k) % len(names)] for k in range(60)) for s in range(40)]
    mixed = []
    for t in texts[:10]:
        words = t.split()
        rng.shuffle(words)
        mixed.append(" ".join(words))
    rows = [(i, t, i < 40) for i, t in enumerate([*texts, *texts[:10], *mixed])]
    df = spark.createDataFrame(rows, "doc_id long, text string, training boolean")
    out, n = cm.score_texts(df, F.col("training"), keep=["doc_id"])
    bits = {r.doc_id: r[n["bits_per_byte"]] for r in out.collect()}
    assert all(bits[50 + i] > bits[40 + i] + 0.3 for i in range(10))


def test_word_codes_differ_by_bytes_places_and_length():
    rng = random.Random(9)
    words = list({"".join(rng.choices("abä", k=rng.randint(1, 9))) for _ in range(4000)})
    words += ["a" * k for k in range(20, 300)] + ["x" * 64 + "ab", "x" * 64 + "ba"]
    found = cm._word_codes(pa.array(words))
    assert len(set(found.tolist())) == len(words)
    assert (cm._word_codes(pa.array(words[::-1]))[::-1] == found).all()
    assert (cm._word_codes(pa.array(["", *words]).slice(1)) == found).all() and len(cm._word_codes(pa.array([], pa.string()))) == 0


def test_many_short_texts_are_coded_in_bounded_groups():
    texts = pa.array(["a"] * (2 * cm.CODED_TEXTS + 1) + ["b" * (cm.CODED_BYTES + 1), "c"])
    found = list(cm._coded_slices(texts))
    assert [lo for lo, _ in found] == [0, *(hi for _, hi in found[:-1])] and found[-1][1] == len(texts)
    assert max(hi - lo for lo, hi in found) == cm.CODED_TEXTS


def test_inputs_looked_up_at_once_are_those_of_the_decisions():
    model = learned(["the cat and the dog " * 9])
    c = coded(["the cow", "", "zz the dog"])
    first, depth, node, bit, slots = cm.decisions(c.run, model.tree)
    x, gate = model.inputs(slots, depth)
    unit = np.repeat(c.unit, np.diff(first)).astype(np.int64)
    got = model._looked_up(c.run, c.unit)
    want = (first, unit * cm._GATES + gate, unit * 256 + node, node * cm.BUCKETS, 2.0 * bit - 1)
    assert all((a == b).all() for a, b in zip(got, want, strict=False))
    assert np.allclose(np.stack([got[5].real, got[5].imag], 1).reshape(len(x), -1) / cm._GRAIN, x)
