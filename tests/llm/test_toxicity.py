"""Toxicity: Viterbi against all readings, restored words, held-out accuracy."""

import itertools
import re

import numpy as np
import pyarrow as pa
import pytest

from flowlens.llm import queries
from flowlens.llm.toxicity import (
    Restorer, _family, _TRIGGER, decode, fit, fit_characters, lattice, may_hide, score_toxicity,
)

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module", params=[SF, "/root/testdata/sf0.1"])
def characters(spark, request):
    return fit_characters(spark.read.parquet(f"{request.param}/documents.parquet"), "text")


def all_readings(stretch, model):
    best, found = -np.inf, None
    for path in itertools.product(*lattice(stretch)):
        text, total, context = "".join(p[0] for p in path), sum(p[2] for p in path), "  "
        for char in "".join(p[1] for p in path) + " ":
            if not (char == " " and context[1] == " "):
                total += model.logp(context, char)
                context = context[1] + char
        if total > best:
            best, found = total, text.strip()
    return best, found


def test_viterbi_finds_the_best_reading(characters):
    for stretch in ("l0ser", "1d10t", "s t u", "$cum", "cl0wnnn", "a-b-c", "tr4a5hh", "7ha7"):
        best, found = all_readings(stretch, characters)
        got = decode(stretch, characters)
        assert got == found, (stretch, got, found)


def test_hidden_words_are_restored(characters):
    restorer = Restorer(characters)
    for hidden, word in (("you l0ser", "loser"), ("an 1d10t", "idiot"), ("so stuuuupid", "stupid"),
                         ("s t u p i d", "stupid"), ("pathet1c", "pathetic"), ("tra5h", "trash"), ("$cum", "scum")):
        assert word in restorer.text(hidden), (hidden, restorer.text(hidden))
    assert restorer.text("plain words, kept.") == "plain words, kept."


SPELLINGS = (("a$$", "ass"), ("a55", "ass"), ("an i d ! 0 t", "idiot"), ("$ t u p i d", "stupid"),
             ("s  t  u  p  i  d", "stupid"), ("s, t, u, p, i, d", "stupid"), ("s/t/u/p/i/d", "stupid"),
             ("s\tt\tu\tp\ti\td", "stupid"), ("s\nt\nu\np\ni\nd", "stupid"), ("st.up.id", "stupid"),
             ("iiddiioott", "idiot"))


PLAIN = ("You there! Go, he said (twice).", "well-known facts", "costs 5 dollars or 1,000", "h2o", "covid19", "mp3", "v2",
         "x = y + z", "a, b, c and d", "e.g. this", "i.e. that", "www.example.com", "utf8", "b2b", "3d", "x1 x2 x3",
         "f(x)", "page 12a", "room b4", "iso9001", "p2p", "u.s.a.", "c++", "$5", "3rd", "21st", "1. a 2. b", "i + j")


def test_more_spellings_are_restored(characters):
    restorer = Restorer(characters)
    for hidden, word in SPELLINGS:
        assert may_hide(pa.array([hidden]))[0], hidden
        assert word in restorer.text(hidden), (hidden, restorer.text(hidden))
    for plain in PLAIN:
        assert restorer.text(plain) == plain.lower(), (plain, restorer.text(plain))


def test_prefilter_of_mixed_marks_misses_no_stretch():
    rng = np.random.default_rng(9)
    letters = list("aabbéé1$!@/,_. \t")
    texts = ["".join(rng.choice(letters, rng.integers(0, 14))) for _ in range(4000)]
    for text, flag in zip(texts, may_hide(pa.array(texts)), strict=True):
        assert flag or not _TRIGGER.search(text.lower()), repr(text)


def test_prefilter_misses_no_stretch():
    rng = np.random.default_rng(3)
    letters = list("ab éß10$ .-_x")
    texts = ["".join(rng.choice(letters, rng.integers(0, 14))) for _ in range(3000)]
    flags = may_hide(pa.array(texts))
    for text, flag in zip(texts, flags, strict=True):
        assert flag or not _TRIGGER.search(text.lower()), repr(text)


def test_long_stretches_are_linear(characters):
    restorer = Restorer(characters)
    assert restorer.text("a" * 200_000) in ("a", "aa")
    assert len(restorer.text("a1" * 3000)) <= 6000


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = queries.op3_noisy_channel_toxicity(spark, sf).collect()
    assert len(rows) == 10_000 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    held = [(labels[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in labels]
    hit = sum(y and p for y, p in held)
    assert hit / sum(y for y, _ in held) > 0.85 and hit / max(1, sum(p for _, p in held)) > 0.85


def test_only_copies_are_one_family():
    texts = ["the cat sat on the mat", "The mat: on the cat, sat!", "the dog ran", "the cat sat on a mat", "", None, "..."]
    batch = pa.RecordBatch.from_arrays([pa.array(range(7)), pa.array([0] * 7), pa.array(texts)], names=["id", "y", "t"])
    family = [f for part in _family([batch]) for f in part["family"].to_pylist()]
    assert family[0] == family[1] and family[4:] == [0, 0, 0] and len(set(family)) == 4


def test_unrelated_documents_with_a_common_word_all_count(spark):
    """Every text holds the same common words; toxic ones, and no others, one of six rare words."""
    common = [f"c{k}" for k in range(60)]
    rows = [(i, " ".join([*common, f"w{i}", f"v{i}", *([f"rude{i % 6}"] if i % 2 else [])]), i % 2)
            for i in range(300)]
    rows += [(1000 + i, " ".join([*common, "copied"]), i % 2) for i in range(40)]  # one of each label
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = fit(docs, docs.select("doc_id", "toxic"), "text", "doc_id", "toxic")
    scored, name = score_toxicity(docs.where("doc_id < 1000"), model)
    assert len(model.bins) >= 3
    assert all((r[name] >= 0.5) == bool(r.toxic) for r in scored.collect())


def test_nulls_empty_tables_and_clashing_names(spark):
    docs = spark.createDataFrame([(1, "a bad one", 1), (1, "a bad one", 1), (2, None, 1), (None, "", 2), (3, "good", 2)],
                                 "doc_id long, text string, toxicity int")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1), (3, 0)], "doc_id long, toxic int")
    model = fit(docs, labels, "text", "doc_id", "toxic")
    out, name = score_toxicity(docs, model)
    assert name == "toxicity_" and out.count() == 5
    assert all(0 <= r[name] <= 1 for r in out.collect())
    none = fit(docs, labels.limit(0), "text", "doc_id", "toxic")
    assert {r[name] for r in score_toxicity(docs, none)[0].collect()} == {0.5}
    assert score_toxicity(docs.limit(0), none)[0].count() == 0
    assert re.match("toxicity", name)
