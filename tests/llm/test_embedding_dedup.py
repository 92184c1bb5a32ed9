"""Embedding near-duplicates against all cosines."""

import numpy as np

from flowlens.llm import queries
from flowlens.llm.embedding_dedup import embedding_dedup

SF = "/root/testdata/sf0.1"


def usable(v):
    return v is not None and len(v) > 0 and None not in v and np.isfinite(v).all() and np.any(v)


def plain(rows, threshold=0.9):
    """(links, component) of each (id, vector) row from all cosines."""
    near = np.zeros((len(rows), len(rows)), bool)
    for dim in {len(v) for _, v in rows if usable(v)}:
        own = [i for i, (_, v) in enumerate(rows) if usable(v) and len(v) == dim]
        x = np.array([rows[i][1] for i in own], float)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        near[np.ix_(own, own)] = x @ x.T >= threshold
    np.fill_diagonal(near, False)
    least = np.array([np.inf if i is None else i for i, _ in rows])
    while True:
        spread = np.minimum(least, np.where(near, least[None, :], np.inf).min(1))
        if (spread == least).all():
            return [(int(n), None if np.isinf(c) else int(c)) for n, c in zip(near.sum(1), least, strict=True)]
        least = spread


def recall(got, want):
    return sum(min(a, b) for a, b in zip(got, want, strict=True)) / sum(want) if sum(want) else 1.0


def test_query_finds_the_links_of_all_pairs(spark):
    rows = sorted((r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect())
    want = plain(rows)
    got = sorted(queries.op10_spherical_cells(spark, SF).collect(), key=lambda r: r.vec_id)
    assert [r.vec_id for r in got] == [i for i, _ in rows]
    assert all(r.n_links <= n for r, (n, _) in zip(got, want, strict=True))  # none below the threshold
    assert recall([r.n_links for r in got], [n for n, _ in want]) >= 0.9
    assert all(r.kept == (r.component_id == r.vec_id) and r.component_id <= r.vec_id for r in got)


def test_planted_neighbours_over_several_cells(spark):
    """Noise around the threshold in many directions, so that cells and probes matter."""
    rng = np.random.default_rng(6)
    base = rng.standard_normal((1500, 16))
    other = base + rng.standard_normal(base.shape) * rng.uniform(0, .6, (1500, 1))
    rows = list(enumerate(np.concatenate([base, other, base[:40]]).tolist()))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(6)
    out, n = embedding_dedup(df)
    got, want = sorted(out.collect(), key=lambda r: r.vec_id), plain(rows)
    found = [r[n["n_links"]] for r in got]
    assert all(a <= b for a, (b, _) in zip(found, want, strict=True))
    assert sum(b for b, _ in want) > 1000 and recall(found, [b for b, _ in want]) >= 0.97
    again = {r.vec_id: tuple(r) for r in embedding_dedup(df.repartition(2))[0].collect()}
    assert again == {r.vec_id: tuple(r) for r in got}


def test_recall_on_vectors_outside_the_sample(spark, monkeypatch):
    """A table far larger than the sample: most vectors are unseen by the fit."""
    import flowlens.llm.embedding_dedup as module
    monkeypatch.setattr(module, "SAMPLE_VALUES", 128 * 800)
    monkeypatch.setattr(module, "PER_CELL", 32)
    rng = np.random.default_rng(8)
    for rank in (128, 24):  # filling the space, and a part of it
        span = rng.standard_normal((rank, 128))
        base, aside = (module.unit_rows(rng.standard_normal((2500, rank)) @ span) for _ in "ab")
        aside = module.unit_rows(aside - (aside * base).sum(1, keepdims=True) * base)
        rows = list(enumerate(np.concatenate([base, .901 * base + np.sqrt(1 - .901 ** 2) * aside]).tolist()))
        out, n = module.embedding_dedup(
            spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(6))
        want = [b for b, _ in plain(rows)]
        found = [r[n["n_links"]] for r in sorted(out.collect(), key=lambda r: r.vec_id)]
        assert sum(want) >= 5000 and all(a <= b for a, b in zip(found, want, strict=True))
        assert recall(found, want) >= 0.95, rank


def test_as_many_probes_as_the_recall_needs():
    import flowlens.llm.embedding_dedup as module
    rng = np.random.default_rng(4)
    x = module.unit_rows(rng.standard_normal((1200, 32)))
    centres = module.spherical_kmeans(x[:900], 100)
    many = module.choose_probes(x[900:], centres, 0.1, 0.98)
    assert many > 16 and module.choose_probes(x[900:], centres, 0.95, 0.98) < many
    assert module.choose_probes(x[:0], centres, 0.9, 0.98) == 100


def test_blocks_of_a_large_cell_meet(spark, monkeypatch):
    import flowlens.llm.embedding_dedup as module
    monkeypatch.setattr(module, "BLOCK", 16)
    rng = np.random.default_rng(2)
    rows = list(enumerate((rng.standard_normal((5, 8))[rng.integers(0, 5, 120)]
                           + .1 * rng.standard_normal((120, 8))).tolist()))
    out, n = module.embedding_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = sorted(out.collect(), key=lambda r: r.vec_id)
    assert [(r[n["n_links"]], r[n["component_id"]]) for r in got] == plain(rows)


def test_unusable_vectors_repeats_ties_and_clashing_names(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [2.0, -0.0]), (None, [3.0, 0.1]), (None, None), (3, None), (4, []),
            (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [None, 1.0]), (9, [1.0, 0.0, 0.0]),
            (10, [1e300, 1e300]), (11, [1e-300, 1e-300]), (12, [-1.0, 0.0])]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)],
                               "vec_id long, embedding array<double>, Kept int").repartition(3)
    out, n = embedding_dedup(df)
    got = sorted((repr(r.vec_id), r[n["n_links"]], repr(r[n["component_id"]])) for r in out.collect())
    # both tiny and huge vectors are usable; plain cosines would overflow, so they are given here at length one
    same = [(i, [1.0, 1.0] if i in (10, 11) else v) for i, v in rows]
    assert got == sorted((repr(i), links, repr(c)) for (i, _), (links, c) in zip(same, plain(same), strict=True))
    assert embedding_dedup(df.limit(0))[0].count() == 0
