"""Mixing: targets, the flow's cost, nearness to targets, edge cases."""

import random

import numpy as np

from flowlens.llm import queries
from flowlens.llm.mixing import CELL_COST, clearing_prices, mix, respond, targets

SF = "/root/testdata/sf0.1"


def test_targets_stop_at_twice_the_size():
    assert targets([100, 100]) == [200.0, 100.0]
    got = targets([10, 1000, 1000])
    assert got[0] == 20 and abs(sum(got) - 1.5 * 2010) < 1e-9 and abs(got[2] / got[1] - 2) < 1e-9 or got[2] == 2000
    assert targets([]) == [] and targets([0, 0]) == [0.0, 0.0]


def network(rng, n_sources, n_patterns):
    """Patterns (unit, sources, words) with a pattern of its own for each source, and targets inside the room."""
    rows = [(str(k), 400, [k], [400]) for k in range(n_sources)]
    for p in range(n_patterns):
        held = sorted(rng.sample(range(n_sources), rng.randint(2, min(4, n_sources))))
        unit = rng.randint(1, 60)
        rows.append((f"p{p}", unit, held, [unit * rng.randint(1, 5) for _ in held]))
    sizes = [sum(w for r in rows for s, w in zip(r[2], r[3], strict=True) if s == k) for k in range(n_sources)]
    return rows, sizes, [n * rng.choice([0.3, 0.8, 1.4, 1.9, 2.0]) for n in sizes]


def flows(rows, prices):
    first = np.cumsum([0] + [len(r[2]) for r in rows])
    source, words = (np.array([x for r in rows for x in r[k]]) for k in (2, 3))
    unit = np.array([r[1] for r in rows], float)
    flow, _ = respond(prices, unit, first, source, words.astype(float))
    return flow, unit, first, source, words.astype(float)


def cost(flow, unit, first, words):
    whole = np.add.reduceat(flow, first[:-1])
    return (whole ** 2 / (2 * unit)).sum() + CELL_COST * (flow ** 2 / (2 * words)).sum()


def test_flow_is_of_least_cost(spark):
    rng = random.Random(8)
    for n_sources, n_patterns in ((1, 0), (2, 1), (3, 9), (6, 400)):
        rows, sizes, wanted = network(rng, n_sources, n_patterns)
        df = spark.createDataFrame(rows, "pattern string, unit long, sources array<int>, words array<long>").repartition(3)
        prices = clearing_prices(df, sizes, wanted)
        flow, unit, first, source, words = flows(rows, prices)
        assert np.abs(np.bincount(source, flow, n_sources) - wanted).max() <= 1 + len(flow) ** 0.5
        # a word's cost is its price inside a cell, no less where nothing flows and no more where all does
        owner = np.repeat(np.arange(len(unit)), np.diff(first))
        passes = np.add.reduceat(flow, first[:-1]) / unit
        dear = passes[owner] + CELL_COST * flow / words - prices[source]
        assert (dear[flow > 1e-6] < 1e-5).all() and (dear[flow < 2 * words - 1e-6] > -1e-5).all()


def test_no_cheaper_flow_on_a_grid(spark):
    rows = [("0", 4000, [0], [4000]), ("1", 2000, [1], [2000]), ("0,1", 2000, [0, 1], [4000, 2000])]
    sizes, wanted = [8000, 4000], [9000.0, 6000.0]
    df = spark.createDataFrame(rows, "pattern string, unit long, sources array<int>, words array<long>")
    flow, unit, first, source, words = flows(rows, clearing_prices(df, sizes, wanted))
    assert np.abs(np.bincount(source, flow) - wanted).max() <= 2
    steps = np.arange(0, 8001, 100.0)
    grid = [cost(np.array([9000 - a, 6000 - b, a, b]), unit, first, words) for a in steps for b in steps
            if a >= 1000 and 2000 <= b <= 4000]
    assert min(grid) * 0.999 <= cost(flow, unit, first, words) <= min(grid) * 1.001


def test_patterns_stay_a_table(spark):
    """Many patterns, each with few texts: every cell follows the flow, targets are met."""
    rng = random.Random(4)
    log, at = [], 0
    for k in range(3000):
        for s in rng.sample(range(12), rng.randint(1, 6)):
            log.append((at, f"w{k} " * rng.randint(1, 1 + k % 9), f"s{s:02}"))
            at += 1
    df = spark.createDataFrame(log, "doc_id long, text string, source string")
    out, n = mix(df)
    sums = {}
    for r in out.collect():
        got = sums.setdefault(r.source, [0, r[n["target"]], 0])
        got[0] += r[n["taken"]]
        got[2] = max(got[2], r[n["size"]])
    assert len(sums) == 12 and all(abs(a - b) <= most for a, b, most in sums.values())


def test_taken_is_near_the_targets_and_reruns_agree(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = queries.op5_source_flow(spark, SF).collect()
    text = {r.doc_id: r for r in docs.collect()}
    sums = {}
    for r in rows:
        d = text[r.doc_id]
        assert r.size == len(__import__("re").findall(r"[^\x20\x09-\x0D]+", d.text or "")) and 0 <= r.taken <= 2 * r.size
        s = sums.setdefault(d.source, [0, r.target, 0])
        s[0] += r.taken
        s[2] = max(s[2], r.size)
    assert len(rows) == docs.count()
    for taken, target, most in sums.values():
        assert abs(taken - target) <= most
    again, n = mix(docs.repartition(7, "lang"), keep=["doc_id"])
    assert {(r.doc_id, r[n["taken"]]) for r in again.collect()} == {(r.doc_id, r.taken) for r in rows}


def test_nulls_ties_empty_tables_and_clashing_names(spark):
    rows = [(1, "a b c", "x", 0), (1, "a b c", "x", 0), (2, "a b c", None, 0), (None, None, None, 0), (3, "", "y", 0),
            (4, "q " * 500, "z", 0), (5, "r s", "z", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, Size int")
    out, n = mix(df)
    assert n["size"] == "size_" and out.count() == 7
    got = out.collect()
    assert all(r[n["taken"]] <= 2 * r[n["size"]] for r in got)
    same = [r[n["taken"]] for r in got if r.doc_id == 1]
    assert same[0] == same[1]
    assert {r[n["size"]] for r in got if r.text in (None, "")} == {0}
    assert mix(df.limit(0))[0].count() == 0


def test_names_used_inside_are_free_for_the_table(spark):
    df = spark.createDataFrame([(k, f"a b {k % 3}", "xy"[k % 2], 1, 2, 3, 4, 5) for k in range(20)],
                               "doc_id long, text string, source string, s int, pattern int, taken int, target int, u int")
    out, n = mix(df)
    assert out.columns == [*df.columns, "size", "source_size", "target_", "taken_"]
    assert {(r.s, r.pattern, r.taken, r.target, r.u) for r in out.collect()} == {(1, 2, 3, 4, 5)}
