"""Token counts against the library itself."""

import random

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from flowlens.llm import queries
from flowlens.llm.token_counts import Counter, count_tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def counter():
    return Counter(PATH)


def expected(library, texts):
    return [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(max_size=80), max_size=6))
def test_any_unicode(texts):
    lib, own = Tokenizer.from_file(PATH), _SHARED
    assert own.count(texts) == expected(lib, texts)


_SHARED = Counter(PATH)


def test_hard_shapes(library, counter):
    rng = random.Random(5)
    texts = ["", " ", "   ", "a" * 5000, "ab" * 3000, "aaa aaaa  aaaaa", "don't we'll 'tis ''s", "x  \n\n y\t\t",
             "<|endoftext|>", "a<|endoftext|>b <|endoftext|><|endoftext|>", "<|endoftext|", "é" * 999, "😀" * 300,
             "\x1c\x1d\x1e\x1f\x85 ​ 　﻿", "٣٤٥ ⅷ ² x", "́á", "0" * 4000]
    texts += ["".join(rng.choice("ab c'\n.0é") for _ in range(rng.randrange(400))) for _ in range(200)]
    assert counter.count(texts) == expected(library, texts)


def test_documents_match_the_library(spark, library):
    sf = "/root/testdata/sf0.001"
    rows = {r.doc_id: r for r in queries.op6_token_counts(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(rows) == len(docs)
    for d, n in zip(docs, expected(library, [d.text or "" for d in docs]), strict=True):
        assert (rows[d.doc_id].n_tokens, rows[d.doc_id].n_bytes) == (n, len((d.text or "").encode()))
        assert rows[d.doc_id].over_limit == (n > 1024)


def test_nulls_empty_tables_and_clashing_names(spark):
    df = spark.createDataFrame([(1, None, 7, "x"), (1, None, 7, "x"), (None, "a b", 8, None)],
                               "doc_id long, text string, N_TOKENS int, n_bytes string")
    out, names = count_tokens(df, PATH)
    assert names["n_tokens"] != "n_tokens" and set(df.columns) < set(out.columns)
    got = sorted((r[names["n_tokens"]], r[names["n_bytes"]]) for r in out.collect())
    assert got == [(0, 0), (0, 0), (2, 3)]
    assert count_tokens(df.limit(0), PATH)[0].count() == 0
