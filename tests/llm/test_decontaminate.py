"""Decontamination against a plain scan of all windows."""

import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from flowlens.llm.common import ALNUM, Words
from flowlens.llm.decontaminate import (
    FMIndex, Phrases, RankBits, WaveletMatrix, cut_spans, decontaminate, mark_contamination, suffix_order,
)

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def plain(text, items):
    own, hit, ids = words(text), set(), set()
    for item_id, item in items:
        w = words(item)
        n = min(10, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            for j in range(len(own) - n + 1):
                if own[j:j + n] == w[i:i + n]:
                    hit.update(range(j, j + n))
                    if item_id is not None:
                        ids.add(str(item_id))
    return len(own), len(hit), sorted(ids)


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = ["ab", "b", "cé", "D", "e9", "ff", "ß"]
    def text(n):
        return "".join(rng.choice(vocabulary) + rng.choice([" ", ", ", "\n", " - "]) for _ in range(n))
    items = [(i, text(rng.choice([0, 1, 3, 9, 10, 11, 25]))) for i in range(12)] + [(None, text(12)), (3, text(14)), (77, None)]
    docs = []
    for i in range(40):
        t = text(rng.choice([0, 2, 20, 60]))
        if rng.random() < .5:
            t += " zz " + (rng.choice(items)[1] or "") + " " + text(5)
        docs.append((i, t, "x"))
    return docs + [(None, None, "y"), (1, docs[1][1], "x"), (1, docs[1][1], "x"), (5, "", "z")], items


def frames(spark, docs, items):
    return (spark.createDataFrame(docs, "doc_id long, text string, N_Words string").repartition(3),
            spark.createDataFrame(items, "item_id long, text string"))


def check(spark, docs, items, **options):
    d, b = frames(spark, docs, items)
    out, n = mark_contamination(d, b, **options)
    assert n["n_words"] != "n_words" and set(d.columns) < set(out.columns)
    got = sorted(((r.doc_id, r.text, r[n["n_words"]], sum(s.end - s.start for s in r[n["spans"]]), r[n["items"]])
                  for r in out.collect()), key=repr)
    assert got == sorted(((i, t, *plain(t, items)) for i, t, _ in docs), key=repr)


def test_all_windows(spark):
    for seed in range(2):
        check(spark, *corpus(seed))


def test_several_blocks(spark):
    check(spark, *corpus(5), block_words=60)


def test_empty_tables(spark):
    docs, items = corpus(1)
    d, b = frames(spark, docs, items)
    assert decontaminate(d.limit(0), b).count() == 0
    assert decontaminate(d, b.limit(0)).count() == len(docs)


def test_kept_documents_and_cut_texts(spark):
    docs, items = corpus(2)
    d, b = frames(spark, docs, items)
    clean = sorted((r.doc_id, r.text) for r in decontaminate(d, b).collect() if r.doc_id is not None)
    assert clean == sorted((i, t) for i, t, _ in docs if i is not None and not plain(t, items)[1])
    marked, n = mark_contamination(d, b)
    for r in cut_spans(marked.withColumn("before", F.col("text")), "text", n["spans"]).collect():
        total, hit, _ = plain(r.before, items)
        assert len(words(r.text)) == total - hit


def test_index_against_lists():
    rng = np.random.default_rng(4)
    bits = rng.random(1000) < .4
    at = np.arange(1001)
    assert (RankBits(bits).rank(at) == np.concatenate([[0], np.cumsum(bits)])).all()
    s = rng.integers(0, 11, 500)
    tree = WaveletMatrix(s, 11)
    assert (tree.get(np.arange(500)) == s).all()
    for c in range(11):
        assert (tree.rank(np.full(501, c), np.arange(501)) == np.concatenate([[0], np.cumsum(s == c)])).all()
    t = rng.integers(0, 2, 300)
    assert list(suffix_order(t)) == sorted(range(300), key=lambda i: list(t[i:]))
    s = rng.integers(1, 4, 400)
    opens = np.zeros(400, bool)
    opens[[0, 90, 91, 300]] = True
    index = FMIndex(s, np.arange(400), opens, 4)
    windows = np.array(np.meshgrid([1, 2, 3], [1, 2, 3], [1, 2, 3])).reshape(3, -1).T
    lo, hi = index.search(windows)
    for w, a, b in zip(windows, lo, hi, strict=True):
        true = [i for i in range(398) if list(s[i:i + 3]) == list(w) and not opens[i + 1:i + 3].any()]
        assert sorted(index.locate(np.arange(a, b))) == true


def test_word_edges():
    w = Words(pa.array(["Ab-c", "", "d", "É9 ", None or ""]), ALNUM)
    assert w.words.to_pylist() == ["ab", "c", "d", "É9"]
    assert list(w.first) == [0, 2, 2, 3, 4, 4]
    assert Phrases([], []).windows == {}
