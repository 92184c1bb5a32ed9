"""Language identification: held-out accuracy and edge cases."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from flowlens.llm import queries
from flowlens.llm.common import mix64
from flowlens.llm.language_id import AMBIGUOUS, BINS, ORDERS, SMOOTHING, Model, codewords, fit, identify, predict

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()}
    rows = queries.op2_language_codes(spark, SF).collect()
    assert len(rows) == len(truth)
    held = [r for r in rows if r.held_out]
    assert 0.15 < len(held) / len(rows) < 0.35
    assert np.mean([truth[r.doc_id] == r.lang_pred for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_codewords_differ_and_are_apart():
    for n in (2, 3, 4, 5, 9, 40):
        code = codewords(n).astype(int)
        apart = [(code[i] != code[j]).sum() for i in range(n) for j in range(i)]
        assert min(apart) >= (1 if n < 3 else code.shape[1] // 4)
        assert (np.abs(code.sum(0)) < n).all()


def test_an_erring_bit_is_corrected():
    model = Model(list("abcd"), codewords(4), np.zeros((1, 7)), np.ones(7))
    evidence = model.code[2] * 4.0
    evidence[3] *= -0.5
    assert model.losses(evidence[None]).argmin() == 2


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")


def test_nulls_ties_and_clashing_names(spark):
    rows = [(1, "the cat sat on the mat", "en", 1), (2, "le chat est sur la table", "fr", 1),
            (3, None, "en", 2), (4, "", None, 2), (5, "123 !? 456", "fr", 2), (None, "the mat", None, 2),
            (2, "le chat est sur la table", "fr", 1), (9, "the " * 50_000, "en", 0)]
    df = frame(spark, rows)
    out, n = identify(df, fit(df, "text", "lang"))
    assert n["score"] == "score_" and set(df.columns) < set(out.columns)
    got = [(r.doc_id, r[n["lang_pred"]]) for r in out.collect()]
    assert sorted(got, key=repr) == sorted([(1, "en"), (2, "fr"), (2, "fr"), (3, "und"), (4, "und"), (5, "und"),
                                            (None, "en"), (9, "en")], key=repr)


def test_no_training_rows_one_language_and_empty_table(spark):
    df = frame(spark, [(1, "abc", None, 0)])
    out, n = identify(df, fit(df, "text", "lang"))
    assert [(r[n["lang_pred"]], r[n["score"]]) for r in out.collect()] == [("und", 0.0)]
    one = frame(spark, [(1, "abc", "xx", 0), (2, None, "xx", 0)])
    out, n = identify(one, fit(one, "text", "lang"))
    assert sorted((r[n["lang_pred"]], r[n["score"]]) for r in out.collect()) == [("und", 0.0), ("xx", 1.0)]
    assert identify(df.limit(0), fit(one, "text", "lang"))[0].count() == 0


def plain_grams(text):
    """Bins of the n-grams of a text's words, one by one."""
    lower = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    for word in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower):
        held = b" " + word.encode() + b" "
        for k in ORDERS:
            for i in range(len(held) - k + 1):
                yield int(mix64(np.array([int.from_bytes(held[i:i + k], "big") + (k << 56)], np.uint64))[0] % np.uint64(BINS))


def plain_model(rows):
    """Weights and trust by dictionaries: {(bin, bit): log-ratio}, [trust of each bit]."""
    languages = sorted({l for _, _, l, _ in rows if l is not None})
    counts = {l: Counter() for l in languages}
    for _, text, lang, _ in rows:
        if lang is not None:
            counts[lang].update(plain_grams(text))
    code = codewords(len(languages))
    bits = range(code.shape[1])

    def share(lang, b):
        return (counts[lang][b] + SMOOTHING) / (sum(counts[lang].values()) + SMOOTHING * BINS)

    weights, trust = {}, [0.0] * len(bits)
    for b in range(BINS):
        shares = [share(l, b) for l in languages]
        for bit in bits:
            plus = [s for s, c in zip(shares, code[:, bit]) if c > 0]
            minus = [s for s, c in zip(shares, code[:, bit]) if c < 0]
            p, m = sum(plus) / len(plus), sum(minus) / len(minus)
            weights[b, bit] = math.log(p / m)
            trust[bit] += (p - m) * weights[b, bit]
    mean = sum(trust) / len(trust)
    return languages, code, weights, [t / mean for t in trust]


def plain_prediction(text, languages, code, weights, trust):
    grams = list(plain_grams(text))
    evidence = [sum(weights[g, bit] for g in grams) / len(ORDERS) for bit in range(code.shape[1])]
    losses = [sum(t * math.log1p(math.exp(-abs(e * c))) + t * max(0.0, -e * c)
                  for t, e, c in zip(trust, evidence, word)) / max(1.0, code.shape[1] / 2) for word in code.tolist()]
    odds = [math.exp(min(losses) - x) for x in losses]
    best = losses.index(min(losses))
    rest = sorted(odds[:best] + odds[best + 1:])
    return languages[best], odds[best] / sum(odds), rest[-1] / odds[best] >= AMBIGUOUS


def test_model_and_decoding_match_plain_dictionaries(spark):
    rng = random.Random(4)
    letters = {"de": "äbcdeß", "en": "abcdef", "fr": "éacdefg", "ja": "日本語の", "ru": "абвгд"}
    rows = [(i, " ".join("".join(rng.choices(letters[l], k=rng.randint(1, 6))) for _ in range(rng.randint(1, 12))).title(),
             l if i % 9 else None, 0) for i, l in enumerate(sorted(letters) * 8)]
    rows += [(99, None, "en", 0), (98, "", "fr", 0), (97, "1a2b, ca-fe", "en", 0), (97, "1a2b, ca-fe", "en", 0)]
    df = frame(spark, rows).repartition(5)
    model = fit(df, "text", "lang")
    languages, code, weights, trust = plain_model(rows)
    assert model.languages == languages and (model.code == code).all()
    assert np.allclose(model.trust, trust, rtol=1e-9)
    seen = sorted({g for r in rows for g in plain_grams(r[1])})
    assert np.allclose(model.weights[seen], [[weights[g, b] for b in range(code.shape[1])] for g in seen], atol=1e-5)
    out, n = identify(df, model)
    got = out.collect()
    assert len(got) == len(rows)
    for r in got:
        if re.search(r"[^\W\d_]", r.text or ""):
            lang, score, ambiguous = plain_prediction(r.text, languages, code, weights, trust)
            assert r[n["lang_pred"]] == lang and abs(r[n["score"]] - score) < 1e-4 and r[n["ambiguous"]] == ambiguous
        else:
            assert (r[n["lang_pred"]], r[n["score"]], r[n["ambiguous"]]) == ("und", 0.0, False)


def test_more_languages_use_random_codes(spark):
    rows = [(i, " ".join(f"{'klmnopqrstu'[i % 11]}{c}" for c in "abcde"), f"l{i % 11:02}", 0) for i in range(33)]
    model = fit(frame(spark, rows), "text", "lang")
    languages, code, weights, trust = plain_model(rows)
    best, top, _ = predict(model, pa.array([r[1] for r in rows]))
    for r, b, t in zip(rows, best, top):
        lang, score, _ = plain_prediction(r[1], languages, code, weights, trust)
        assert languages[b] == lang == r[2] and abs(t - score) < 1e-4
