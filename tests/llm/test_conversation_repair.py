"""Conversation repair against a plain search over whole audit strings."""

import hashlib
import random

import numpy as np
import pytest

from flowlens.llm import conversation_repair as cr
from flowlens.llm.conversation_repair import audit_conversations, repair, repaired_turns
from flowlens.llm.queries import damaged

SPACE = " \t\n\x0b\x0c\r"
LEGAL = {"": "su", "s": "u", "u": "a", "a": "u"}  # initials that may follow
NAME = {"u": "user", "a": "assistant"}


def plain(rows):
    """Everything about one conversation, from (turn, role, text) rows."""
    rows = [(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows]
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    seen, faults = set(), []
    for _, role, text in rows:
        body = text.rstrip(SPACE)
        faults.append("blank" if not body else "duplicate" if (role, text) in seen
                      else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    best = {"": (0, "", ())}  # last initial -> cost, audit, turns
    def inserted(best):
        for _ in range(3):
            for last, (cost, audit, turns) in list(best.items()):
                new = "a" if last == "u" else "u"
                way = (cost + 2, audit + "I", (*turns, (NAME[new], "")))
                if new not in best or way[:2] < best[new][:2]:
                    best[new] = way
        return best
    for (_, role, text), fault in zip(rows, faults):
        now, cut = {}, fault == "truncated"
        for last, (cost, audit, turns) in inserted(best).items():
            ways = [(last, cost + 3, "D", ())]
            if fault not in ("blank", "duplicate"):
                if role[:1] and role[0] in LEGAL[last]:
                    ways.append((role[0], cost + cut, "K", ((role, text),)))
                new = "a" if last == "u" else "u"
                ways.append((new, cost + 2 + cut, "R", ((NAME[new], text),)))
            for to, price, edit, turn in ways:
                way = (price, audit + edit, (*turns, *turn))
                if to not in now or way[:2] < now[to][:2]:
                    now[to] = way
        best = now
    cost, audit, turns = min(v for k, v in inserted(best).items() if k in ("", "a"))
    numbers = [t for t, _, _ in rows if t is not None]
    initials = [r[:1] for _, r, _ in rows]
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    digest = hashlib.sha256("\n".join(f"{r}:{x}" for r, x in turns).encode()).hexdigest()
    return (gaps, *(faults.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit, digest)


def log_of(rng, n, ids=12, roles=("user", "assistant", "user", "assistant", "system", "tool", "sys", "")):
    texts = ["Yes.", "No!", "cut", "", " \t", "ok? ", "a text of some letters more a.",
             "a text of some letters more b."]
    return [(rng.randrange(ids), rng.choice([None, *range(9)]), rng.choice([*roles, None]), rng.choice([*texts, None]))
            for _ in range(n)]


def frame(spark, log, parts=3):
    return spark.createDataFrame(log, "conv_id long, turn int, role string, text string").repartition(parts)


def expected(log):
    chats = {}
    for conv, *row in log:
        chats.setdefault(conv, []).append(row)
    return {c: plain(rows) for c, rows in chats.items()}


def run(spark, log, parts=3):
    got = repair(frame(spark, log, parts)).collect()
    assert len({r["conv"] for r in got}) == len(got)
    return {r["conv"]: tuple(r)[1:] for r in got}


def test_same_as_whole_search(spark):
    rng = random.Random(5)
    log = log_of(rng, 150) + [(100 + k, t, r, f"{k} {t}.") for k in range(15)
                              for t, r in enumerate(rng.choices(["user", "assistant", "system"], k=6))]
    log += [(None, 1, "user", "a."), (None, 2, "assistant", "b.")]
    assert run(spark, log) == expected(log)


@pytest.mark.parametrize("piece, block", [(3, 2), (7, 4096)])
def test_long_conversations_in_many_pieces(spark, monkeypatch, piece, block):
    monkeypatch.setattr(cr, "PIECE_ROWS", piece)
    monkeypatch.setattr(cr, "UNROLL_ROWS", block)
    rng = random.Random(piece)
    log = [(1, t, rng.choice(["user", "assistant", "system"]), rng.choice([f"{t}.", f"{t}", "", "same."]))
           for t in range(0, 400, 2)]
    log += [(2, 0, "user", "same.")] * 60 + [(3, t, "assistant", f"{t}.") for t in range(50)]
    log += [(4, t, "system", f"{t}") for t in range(30)] + log_of(rng, 60)
    assert run(spark, log, 5) == expected(log)


def test_run_powers_equal_single_steps():
    for symbol in range(9):
        for n in (1, 2, 5, 31, 1000):
            step = np.array(cr.ENDING)
            for _ in range(n):
                step = np.minimum((cr.power(symbol, 0) + step).min(1), cr.NEVER)
            assert cr.to_go(np.array(cr.ENDING), symbol, n).tolist() == step.tolist()


def test_repaired_turns_follow_the_pattern(spark):
    log = log_of(random.Random(8), 120)
    chats = {}
    for r in sorted(repaired_turns(frame(spark, log)).collect(), key=lambda r: (r.conv, r.place)):
        chats.setdefault(r.conv, []).append(r)
    want = expected(log)
    for conv, turns in chats.items():
        initials = "".join(r.role[0] for r in turns)
        assert initials.lstrip("s") == "ua" * (len(initials.lstrip("s")) // 2) and initials.count("s") <= 1
        assert [r.place for r in turns] == list(range(len(turns)))
        body = "\n".join(f"{r.role}:{r.text}" for r in turns)
        assert hashlib.sha256(body.encode()).hexdigest() == want[conv][-1]


def test_ties_beyond_the_head_have_an_order_of_their_own(spark):
    log = [(1, 0, r, "x" * 100 + f"{k}.") for k in range(6) for r in ("user", "assistant")]
    first = run(spark, log, 1)
    assert first == run(spark, log[::-1], 4) and first[1][5] == expected(log)[1][5]


def test_long_text_empty_log_and_clashing_names(spark):
    log = [(1, 0, "user", "w " * 200_000 + "."), (1, 1, "assistant", "x" * 300_000)]
    assert run(spark, log) == expected(log)
    clash = spark.createDataFrame([(1, 0, "user", "a.", "p", 9, 8)],
                                  "conv_id long, turn int, role string, text string, conv string, place int, Kind int")
    assert [r.audit for r in audit_conversations(clash).collect()] == ["KI"]
    assert repair(clash.limit(0)).collect() == []


def test_damage_of_nulls(spark):
    from zlib import crc32

    log = [(c, t, r, x) for c in (None, 1, 2) for t in (None, *range(40)) for r, x in (("system", "a. b!"), (None, None))]
    want = []
    for c, t, r, x in log:
        kind = crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = " " if r is None else r, " " if x is None else x
        x = "" if kind == 1 else x.translate({ord(k): None for k in ".!?"}) if kind == 2 else x
        want += [(c, t, "user" if kind == 4 else r, x)] * {0: 0, 3: 2}.get(kind, 1)
    assert sorted(map(repr, (tuple(r) for r in damaged(frame(spark, log)).collect()))) == sorted(map(repr, want))
