"""Context mixing: exact base scores, a proper model, edge cases."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from flowlens.llm import queries
from flowlens.llm.common import NON_SPACE, Words, fold
from flowlens.llm.context_mixing import (
    _BASES, Coded, Model, _own_share, _start_map, _start_weights, score_texts,
)

SF = "/root/testdata/sf0.01"
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def base(texts, training):
    counts = Counter(w for t in training for w in tokens(t))
    n, v, ends = sum(counts.values()) + len(training), len(counts) + (len(training) > 0), len(training)
    return [(len(tokens(t)) + 1, sum(w in counts for w in tokens(t)) + (ends > 0), n,
             sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in tokens(t)) + math.log10((ends + 1) / (n + v + 1)))
            for t in texts]


def test_base_scores_and_the_model(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    training = [t for i, t in docs.items() if zlib.crc32(str(i).encode()) % 7 != 2]
    want = dict(zip(docs, base(docs.values(), training), strict=True))
    rows = queries.op8_context_mixing(spark, SF).collect()
    assert len(rows) == len(docs)
    for r in rows:
        n, known, total, score = want[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, total)
        assert abs(r.base_score - score) < 1e-6 * abs(score)
        assert r.score < 0 and r.bits_per_byte > 0
    held = [r.bits_per_byte for r in rows if r.held_out and r.n_tokens > 50]
    assert 1.0 < np.median(held) < 2.6  # eight bits a byte before learning
    # the same exact counts when hardly any word travels by broadcast
    few, n = score_texts(spark.read.parquet(f"{SF}/documents.parquet"), fold(F.col("doc_id"), 7) != 2,
                         keep=["doc_id"], hot_words=50)
    for r in few.collect():
        assert r[n["n_known"]] == want[r.doc_id][1] and abs(r[n["base_score"]] - want[r.doc_id][3]) < 1e-6 * abs(want[r.doc_id][3])


def test_scores_do_not_depend_on_the_words_that_travel(spark):
    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{int(k)}" for k in rng.zipf(1.4, 60) % 400) for _ in range(60)]
    rows = [(i, t, 0, 0) for i, t in enumerate([*texts, "w1 new new " + "y" * 400, "", "x" * 9000, None])]
    df = spark.createDataFrame(rows, "doc_id long, text string, lm_paths int, late int").repartition(3)
    scores = []
    for hot in (1 << 21, 50, 0):
        out, n = score_texts(df, F.col("doc_id") % 3 != 1, hot_words=hot)
        scores.append({r.doc_id: [r[n[k]] for k in ("score", "bits_per_byte", "base_score", "n_known")]
                       for r in out.collect()})
    for few in scores[1:]:
        for i, want in scores[0].items():
            assert np.allclose(few[i], want, rtol=1e-9), (i, few[i], want)


def test_decisions_of_a_byte_sum_to_one():
    rng = np.random.default_rng(1)
    counts = rng.integers(0, 5, (2, _BASES[-1])).astype(np.float32)
    model = Model(counts, _start_weights(), _start_map())
    every = [bytes([97, b]).decode("latin1") for b in range(33, 127)]
    logs = model.log_probability(Coded(pa.array(every + ["a"]), 1))
    assert 0 < np.exp(logs[:-2]).sum() <= 1 and logs[-1] < 0


def test_own_share_counts_earlier_tokens_only():
    w = Words(pa.array(["a b a a", "", "b b"]), NON_SPACE)
    word = w.words.dictionary_encode().indices.to_numpy().astype(np.int64)
    assert np.allclose(_own_share(word, w.first), [0, 0, 1 / 2, 2 / 3, 0, 1])


def test_nulls_repeats_long_words_and_clashing_names(spark):
    rows = [(1, "a b c", 0), (1, "a b c", 0), (None, None, 0), (2, "", 0), (3, "x" * 300_000, 0), (4, "B \t é\n", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, Score int")
    out, n = score_texts(df, F.col("doc_id") != 4)
    assert n["score"] == "score_"
    want = sorted((repr(i), *b[:3], round(b[3], 6)) for (i, *_), b in
                  zip(rows, base([r[1] for r in rows], [r[1] for r in rows if r[0] not in (4, None)]), strict=True))
    got = sorted((repr(r.doc_id), r[n["n_tokens"]], r[n["n_known"]], r[n["train_tokens"]], round(r[n["base_score"]], 6))
                 for r in out.collect())
    assert got == want and all(math.isfinite(r[n["score"]]) for r in out.collect())
    none, n = score_texts(df, F.lit(False))
    assert {r[n["train_tokens"]] for r in none.collect()} == {0}
    assert score_texts(df.limit(0), F.lit(True))[0].count() == 0
