"""Licence scans against a plain search of every phrase at every place."""

import random
import re

import pytest

from flowlens.llm import license_scan
from flowlens.llm.license_scan import SLACK, TEMPLATES, Template, scan_licenses

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = {c: c + 32 for c in range(65, 91)}


def words(text):
    return WORD.findall((text or "").translate(UPPER))


def plain(text, templates=TEMPLATES):
    w = words(text)
    places, base, labels, share = [], set(), set(), 0.0
    for t in templates:
        whole, starts = words(t.text), []
        for key in map(words, t.keys):
            at = next(p for p in range(len(whole)) if whole[p:p + len(key)] == key)
            found = [p for p in range(len(w) - len(key) + 1) if w[p:p + len(key)] == key]
            places += [(p, p + len(key), t.label, t.base) for p in found]
            starts.append([p - at for p in found])
            if t.base and found:
                base.add(t.label)
        for o in {o for s in starts for o in s}:
            held = sum(any(o <= x <= o + SLACK for x in s) for s in starts)
            share = max(share, held / len(starts))
            if held == len(starts):
                labels.add(t.label)
    return (len(w), sorted(p[:3] for p in places), sorted(base), sorted(labels), share)


def run(spark, texts, parts=2, **more):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(parts)
    found, n = scan_licenses(df, **more)
    return [(r[n["n_words"]], sorted((p.start, p.end, p.label) for p in r[n["places"]]), r[n["base_labels"]],
             r[n["labels"]], r[n["share"]]) for r in sorted(found.collect(), key=lambda r: r.doc_id)]


def licence_texts(rng):
    out = []
    for t in TEMPLATES:
        out += [t.text, "/* " + t.text.replace(" ", "\n * ", 5) + " */", " ".join(t.text.split()[::-1])]
        w = t.text.split()
        for extra in (3, SLACK - 1, SLACK, SLACK + 1, 60):
            at = rng.randrange(len(w))
            out.append(" ".join([*w[:at], *["x"] * extra, *w[at:]]))
        out.append(" ".join(x for x in w if rng.random() > 0.03))
        out.append(" ".join(reversed(t.keys)))
        out.append(t.text + " filler " * 40 + rng.choice(TEMPLATES).text)
    return out


def test_same_as_searching_every_place(spark, monkeypatch):
    monkeypatch.setattr(license_scan.slices, "__defaults__", (3000,))
    rng = random.Random(3)
    pool = sorted({w for t in TEMPLATES for w in words(t.text)})
    texts = licence_texts(rng) + [" ".join(rng.choices(pool, k=200)) for _ in range(10)] + ["mit license " * 3]
    assert run(spark, texts) == [plain(t) for t in texts]


def test_every_whole_template_is_found():
    for t in TEMPLATES:
        assert t.label in plain(t.text)[3]


def test_nulls_empty_long_and_touching_texts(spark):
    texts = [None, "", "!!", "gnu general", "public license", "mit", "license", "CC-BY cc by CC BY-NC", "MIT Licenſe",
             "x " * 60000 + "apache license", "cc by " * 3000]
    got = run(spark, texts, parts=1)
    assert got == [plain(t) for t in texts]
    assert got[0] == (0, [], [], [], 0.0)
    assert len(got[-1][1]) == 3000


def test_empty_table_and_clashing_names(spark):
    df = spark.createDataFrame([(1, "mit license", "a", "b")], "doc_id long, text string, labels string, PLACES string")
    found, n = scan_licenses(df)
    row = found.first()
    assert row["labels"] == "a" and row["PLACES"] == "b" and row[n["labels"]] == ["mit"]
    assert scan_licenses(df.limit(0))[0].collect() == []


def test_templates_are_a_parameter(spark):
    own = (Template("z", "alpha beta gamma delta", ("alpha beta", "gamma delta")),)
    texts = ["alpha beta gamma delta", "gamma delta alpha beta", "alpha beta"]
    assert run(spark, texts, templates=own) == [plain(t, own) for t in texts]
    with pytest.raises(IndexError):
        Template("z", "alpha", ("beta",)).placed()
