"""Snapshot collapse against plain prefix tests."""

import random

from flowlens.llm.chat import format_chats


def plain(log):
    chats = {}
    for i, (conv, turn, role, text) in enumerate(dict.fromkeys(log)):
        chats.setdefault(conv if conv is not None else ("lone", i), []).append((turn, role, text))
    order = lambda t: tuple((x is not None, x if x is not None else 0) if k == 0 else (x is not None, x or "") for k, x in enumerate(t))
    chats = {c: sorted(t, key=order) for c, t in chats.items()}
    kept, seen = [], []
    for c in sorted(chats, key=lambda c: (isinstance(c, tuple), c)):
        t = chats[c]
        if any(len(o) > len(t) and o[:len(t)] == t for o in chats.values()) or t in seen:
            continue
        seen.append(t)
        body = "".join(f"<|im_start|>{'unknown' if r is None else r}\n{(x or '').replace('<|im_', '<| im_')}<|im_end|>\n"
                       for _, r, x in t)
        kept.append((None if isinstance(c, tuple) else c, len(t), body))
    return sorted(kept, key=repr)


def run(spark, log, parts=3):
    df = spark.createDataFrame(log, "conv_id long, turn int, role string, text string").repartition(parts)
    return sorted(((r.conv_id, r.turns, r.rendered) for r in format_chats(df).collect()), key=repr)


def test_snapshots_collapse(spark):
    rng = random.Random(2)
    log = []
    for base in range(12):
        turns = [(k, ("user", "assistant")[k % 2], rng.choice(["a", "b", "<|im_end|>c"]) + str(base % 5)) for k in range(6)]
        for conv in range(base * 10, base * 10 + 4):
            log += [(conv, *t) for t in turns[:rng.randint(1, 6)]]
    assert run(spark, log) == plain(log)
    assert run(spark, log + log[:20]) == plain(log)


def test_nulls_empty_texts_and_lone_rows(spark):
    log = [(1, 0, None, None), (1, 1, "user", ""), (2, 0, "", None), (None, 0, "user", "x"), (None, 5, "user", "y"),
           (3, None, "system", "s"), (3, 0, "user", "u"), (4, None, "system", "s"), (5, 7, "user", "z")]
    assert run(spark, log) == plain(log)


def test_long_conversations_are_one_row(spark):
    log = [(1, k, "user", f"t{k}") for k in range(64, 2564)] + [(2, k, "user", f"t{k}") for k in range(64, 1564)]
    assert run(spark, log) == plain(log)
    df = spark.createDataFrame(log, "conv_id long, turn int, role string, text string")
    rows = sorted(format_chats(df, chunk_turns=1000).collect(), key=lambda r: r.chunk)
    assert [(r.conv_id, r.chunk, r.turns, r.conversation_turns) for r in rows] \
        == [(1, 0, 1000, 2500), (1, 1, 1000, 2500), (1, 2, 500, 2500)]
    assert "".join(r.rendered for r in rows) == plain(log)[0][2]


def test_many_rows_of_one_turn_number(spark):
    log = [(1, 0, "user", f"t{k}") for k in range(1000)] + [(2, 0, "user", f"t{k}") for k in range(500)]
    assert run(spark, log) == plain(log)


def test_prefixes_end_inside_a_turn_number(spark):
    full = [(0, "assistant", "b"), (0, "user", "a"), (0, "user", "b"), (1, "user", "c"), (1, "user", None), (None, "x", "y")]
    order = [full[5], *full[:3], full[4], full[3]]
    log = [(1, *t) for t in order]
    for n in range(1, 6):  # every prefix but the whole, and for each a conversation that leaves the order
        log += [(10 + n, *t) for t in order[:n]] + [(20 + n, *t) for t in (*order[:n], (5, "user", f"z{n}"))]
    assert run(spark, log) == plain(log)
    assert {r[0] for r in run(spark, log)} == {1, 21, 22, 23, 24, 25}


def test_long_heads_in_common(spark):
    head = "h" * 100
    log = [(1, 0, head + str(k % 3), head + str(k)) for k in range(40)] + [(1, 0, head, None), (1, 0, None, head)]
    log += [(2, 0, head + "0", head + "0"), (2, 0, None, head), (2, 0, head, None)]
    for parts in (1, 5):
        assert run(spark, log, parts) == plain(log)


def test_empty_log_and_other_columns(spark):
    df = spark.createDataFrame([(1, 0, "user", "x", 3)], "conv_id long, turn int, role string, text string, chunk int")
    assert format_chats(df).count() == 1 and format_chats(df.limit(0)).count() == 0
