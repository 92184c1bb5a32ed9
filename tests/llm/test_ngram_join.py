"""N-gram Jaccard join against all pairs of shingle sets."""

import itertools
import random
import re

from flowlens.llm import queries
from flowlens.llm.ngram_join import choose_bands, classify, keep_one_per_class, ngram_join

SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def shingles(text, width=5):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[i:i + width]) for i in range(max(1, len(w) - width + 1))) if w else frozenset()


def plain(rows, threshold=0.8):
    """(class, links) of each (id, text) row by comparing all distinct sets."""
    sets = [shingles(t) for _, t in rows]
    owners = {}
    for i, s in enumerate(sets):
        if s:
            owners.setdefault(s, []).append(i)
    near = {s: {s} for s in owners}
    for a, b in itertools.combinations(owners, 2):
        small, large = sorted((len(a), len(b)))
        if small / large >= threshold:
            common = len(a & b)
            if common / (len(a) + len(b) - common) >= threshold:
                near[a].add(b)
                near[b].add(a)
    root = {}
    for s in near:
        todo, seen = [s], {s}
        while todo and s not in root:
            for t in near[todo.pop()] - seen:
                seen.add(t)
                todo.append(t)
        if s not in root:
            ids = [rows[i][0] for t in seen for i in owners[t] if rows[i][0] is not None]
            root.update(dict.fromkeys(seen, min(ids) if ids else None))
    return [(root[s], sum(len(owners[t]) for t in near[s]) - 1) if s else (rows[i][0], 0) for i, s in enumerate(sets)]


def variants(seed):
    """Texts with chains of small edits, exact copies and short texts."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    out = []
    for _ in range(12):
        text = [rng.choice(vocabulary) for _ in range(rng.choice([3, 6, 40, 120]))]
        for _ in range(rng.choice([1, 2, 6])):
            out.append(" ".join(text))
            text = list(text)
            text[rng.randrange(len(text))] = rng.choice(vocabulary)
    return out + out[:3]


def test_bands_reach_the_recall():
    bands, rows = choose_bands(0.8, 0.9999, 200)
    assert bands * rows <= 200 and 1 - (1 - 0.8 ** rows) ** bands >= 0.9999


def test_query_equals_all_pairs(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = {i: w for (i, _), w in zip(rows, plain(rows), strict=True)}
    got = {r.doc_id: (r.class_id, r.n_links) for r in queries.op9_ngram_join(spark, SF).collect()}
    assert got == want and sum(n for _, n in want.values()) > 0


def test_edited_texts_and_one_of_each_class(spark):
    rows = list(enumerate(variants(4)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    out, n = ngram_join(df)
    want = plain(rows)
    assert {r.doc_id: (r[n["class"]], r[n["links"]]) for r in out.collect()} == \
        {i: w for (i, _), w in zip(rows, want, strict=True)}
    assert max(links for _, links in want) > 1
    assert sorted(r.doc_id for r in keep_one_per_class(df).collect()) == sorted({c for c, _ in want})


def test_blocks_of_a_large_component_meet(spark, monkeypatch):
    import flowlens.llm.ngram_join as module
    monkeypatch.setattr(module, "BLOCK_LEAST", 200)
    rows = list(enumerate(variants(9)))
    out, n = module.ngram_join(spark.createDataFrame(rows, "doc_id long, text string"))
    assert [(r[n["class"]], r[n["links"]]) for r in sorted(out.collect(), key=lambda r: r.doc_id)] == plain(rows)


def test_nulls_repeats_long_texts_and_clashing_names(spark):
    text = " ".join(f"t{i}" for i in range(30))
    rows = [(1, None, "p", 1), (2, "", "p", 2), (3, "- !", "p", 3), (5, text, "p", 4), (5, text, "p", 4),
            (None, text, "q", 5), (None, None, "q", 6), (7, text + " more", None, None), (8, "One two", "r", 7),
            (9, "one TWO", "r", 8), (10, "one two three " * 40_000, "r", 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, Node string, class int").repartition(4)
    out, n = ngram_join(df)
    got = sorted((repr(r.doc_id), repr(r[n["class"]]), r[n["links"]]) for r in out.collect())
    want = [(repr(r[0]), repr(c), k) for r, (c, k) in zip(rows, plain([r[:2] for r in rows]), strict=True)]
    assert got == sorted(want)
    kept = keep_one_per_class(df)
    assert kept.columns == df.columns
    assert sorted((repr(r.doc_id), r.text is None) for r in kept.collect()) == sorted(
        [("1", True), ("2", False), ("3", False), ("5", False), ("8", False), ("10", False), ("None", True)])
    empty = df.limit(0)
    assert ngram_join(empty)[0].count() == 0 and keep_one_per_class(empty).count() == 0


def test_a_class_of_copies_stays_one_row_a_document(spark):
    text = " ".join(f"c{i}" for i in range(50))
    df = spark.range(3000).selectExpr("id AS doc_id", f"'{text}' AS text")
    rows = classify(df, "doc_id", "text", 0.8, 0.9999, 5)
    assert [tuple(r) for r in rows.groupBy("links", "class").count().collect()] == [(2999, 0, 3000)]
    assert keep_one_per_class(df).collect()[0].doc_id == 0
