"""Ranked search against plain scoring of every document."""

import math
import random
import re

import numpy as np
import pytest

from flowlens.llm import lexical_search
from flowlens.llm.lexical_search import Statistics, search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = {c: c + 32 for c in range(65, 91)}


def terms(text):
    return [t.translate(UPPER) for t in TERM.findall(text or "")]


def plain(docs, items, k=10):
    bags = [(d, terms(t)) for d, t in docs]
    n_docs = sum(1 for _, b in bags if b)
    total = sum(len(b) for _, b in bags)
    df = {}
    for _, b in bags:
        for t in set(b):
            df[t] = df.get(t, 0) + 1
    out = []
    for item, text in items:
        found = []
        for d, b in bags:
            score = 0
            for t in terms(text):
                tf = b.count(t)
                if tf:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    m = 100 - 75 + (75 * len(b) * n_docs) // total
                    score += w * ((1000000000 * tf) // (1000 * tf + 8 * m))
            if score > 0:
                found.append((-score, d is None, d or 0))
        out += [(item, r, None if none else d, -s) for r, (s, none, d) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=repr)


def run(spark, docs, items, parts=3, **more):
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(parts)
    i = spark.createDataFrame(items, "item_id long, text string")
    return sorted((tuple(r) for r in search(d, i, **more).collect()), key=repr)


def corpus(rng, n, words):
    return [(i, " ".join(rng.choices(words, weights=[1 / (j + 1) for j in range(len(words))], k=rng.randint(0, 40))))
            for i in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_same_as_scoring_every_document(spark, seed, monkeypatch):
    monkeypatch.setattr(lexical_search.slices, "__defaults__", (600,))  # many slices a task
    rng = random.Random(seed)
    words = [f"w{j}" for j in range(60)]
    docs = corpus(rng, 300, words)
    docs += docs[:20] + [(900 + i, docs[5][1]) for i in range(30)]  # repeated rows and ties
    items = [(i, " ".join(rng.choices(words, k=rng.randint(1, 12)))) for i in range(25)]
    want = plain(docs, items)
    assert run(spark, docs, items) == want
    assert run(spark, docs, items, parts=1, block_words=80) == want  # several blocks


def test_nulls_empty_texts_signs_and_case(spark):
    docs = [(1, None), (2, ""), (3, "--- !!"), (4, "Été été ÉTÉ x9_y"), (None, "x9 y x9"), (5, "x9 y x9"), (6, "y" * 9000),
            (7, "y " * 5000), (8, "other")]
    items = [(1, None), (2, ""), (None, "X9"), (3, "été y Y"), (3, "été y Y"), (4, "absent")]
    got = run(spark, docs, items)
    assert got == plain(docs, items)
    assert {r[0] for r in got} == {None, 3}


def test_empty_tables_and_clashing_names(spark):
    some = spark.createDataFrame([(1, "a b", 5, 6, 7)], "doc_id long, text string, score int, rank int, item_no int")
    items = spark.createDataFrame([(1, "a", 3)], "item_id long, text string, doc long")
    assert search(some, items.limit(0)).collect() == []
    assert search(some.limit(0), items).collect() == []
    assert [tuple(r)[:3] for r in search(some.union(some.replace("a b", "c", "text")), items).collect()] == [(1, 1, 1)]


def test_norms_beyond_64_bits():
    facts = Statistics(10 ** 12, 10 ** 15, [])
    assert facts.norms(np.array([10 ** 6, 10 ** 9])).tolist() == [25 + 75 * n * 10 ** 12 // 10 ** 15 for n in (10 ** 6, 10 ** 9)]
    assert Statistics(10, 100, []).norms(np.array([7])).tolist() == [25 + 75 * 7 * 10 // 100]
