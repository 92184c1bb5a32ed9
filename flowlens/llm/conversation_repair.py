"""Conversation structure repair by a run-length dynamic program.

A conversation is a string of role/fault symbols.  Edits turn it into role
initials ``(s?(ua)+)?`` at least cost: keep a row (0), rerole it to user or
assistant (2), delete it (3, required of blank and repeated rows), insert an
empty user or assistant turn anywhere (2); a truncated row that stays adds 1.
What a symbol can do is a min-plus matrix over the four states of the pattern.
Equal consecutive symbols collapse to runs, a run advances by cached binary
powers of its matrix, and the choices are then unrolled against the costs to
go, which gives the least audit string among the cheapest.

Rows are range-partitioned by conversation and place, so a conversation of any
length is cut into pieces of at most PIECE_ROWS rows in many tasks.  Matrix
products over the pieces give the cost to go at each piece's end; every piece
is unrolled from every state on its own, and the outcomes are chained.  Texts
are shuffled once, for the digest; a digest is sequential by definition, so a
conversation's texts run through one task, as a stream in bounded memory.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlens.operators._small import materialize

#: Rows of a conversation that one piece holds.
PIECE_ROWS = 1 << 16
#: Rows whose costs to go are laid out at once while a run is unrolled.
UNROLL_ROWS = 4096
#: ASCII white space.
SPACE = " \t\n\x0b\x0c\r"
#: Characters of role and text that order rows of one turn number.
HEAD = 64

START, SYSTEM, USER, ASSISTANT = range(4)
_S, _U, _A, _OTHER = range(4)  # role initials
_FINE, _BLANK, _TRUNCATED = range(3)
MUST_GO = 8  # symbol of a blank or repeated row; others are 2 * initial + truncated
NEVER = 1 << 60
_NEXT = (USER, USER, ASSISTANT, USER)  # state after an inserted or reroled turn
_KEEP = {(START, _S): SYSTEM, (START, _U): USER, (SYSTEM, _U): USER, (USER, _A): ASSISTANT, (ASSISTANT, _U): USER}
_LEGAL = {(_S, _U), (_U, _A), (_A, _U)}
#: Cost of ending in each state, closing insertions included.
ENDING = (0, 4, 2, 0)
_TURN = {USER: "user", ASSISTANT: "assistant"}


def edits(symbol: int) -> list[list[tuple[str, int, int]]]:
    """Per state the ways (edit, cost, next state) to take a row of the symbol."""
    out = []
    for q in range(4):
        ways = [("D", 3, q)]
        if symbol != MUST_GO:
            initial, cut = divmod(symbol, 2)
            if (q, initial) in _KEEP:
                ways.append(("K", cut, _KEEP[q, initial]))
            ways.append(("R", 2 + cut, _NEXT[q]))
        out.append(ways)
    return out


WAYS = [edits(s) for s in range(MUST_GO + 1)]


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Min-plus product."""
    return np.minimum((a[:, :, None] + b[None]).min(1), NEVER)


def _row_matrix(symbol: int) -> np.ndarray:
    """Least costs from a state before a row (and insertions) to one after it."""
    insert = np.full((4, 4), NEVER, np.int64)
    for q in range(4):
        insert[q, q] = 0
        insert[q, _NEXT[q]] = min(2, insert[q, _NEXT[q]])
        twice = _NEXT[_NEXT[q]]
        insert[q, twice] = min(4, insert[q, twice])
    row = np.full((4, 4), NEVER, np.int64)
    for q, ways in enumerate(WAYS[symbol]):
        for _, cost, to in ways:
            row[q, to] = min(row[q, to], cost)
    return product(insert, row)


@lru_cache(maxsize=None)
def power(symbol: int, k: int) -> np.ndarray:
    """Matrix of 2**k rows of a symbol (at most 9 symbols x 17 powers a piece)."""
    if k == 0:
        return _row_matrix(symbol)
    half = power(symbol, k - 1)
    return product(half, half)


def _bits(n: int) -> list[int]:
    return [k for k in range(n.bit_length()) if n >> k & 1]


def to_go(after: np.ndarray, symbol: int, n: int) -> np.ndarray:
    """Costs to go before a run, from those after it."""
    for k in _bits(n):
        after = np.minimum((power(symbol, k) + after).min(1), NEVER)
    return after


def piece_matrix(runs: list[tuple[int, int]]) -> np.ndarray:
    return reduce(product, (power(s, k) for s, n in runs for k in _bits(n)))


def unroll(runs: list[tuple[int, int]], state: int, after: np.ndarray) -> tuple[str, int]:
    """(audit, state after the last row): the ASCII-least cheapest edits from
    ``state``, with the costs to go ``after`` the last row.

    From a state an edit letter leads to one state only, so the first letter
    that keeps the cost least is part of the least string."""
    ends = [np.asarray(after)]
    for s, n in reversed(runs):
        ends.append(to_go(ends[-1], s, n))
    ends.reverse()
    audit: list[str] = []
    for (symbol, n), end in zip(runs, ends[1:], strict=True):
        ways, one = WAYS[symbol], power(symbol, 0)
        for lo in range(0, n, UNROLL_ROWS):
            hi = min(n, lo + UNROLL_ROWS)
            costs = [to_go(end, symbol, n - hi)]
            for _ in range(lo, hi):
                costs.append(np.minimum((one + costs[-1]).min(1), NEVER))
            rows = [c.tolist() for c in reversed(costs)]
            for before, then in zip(rows, rows[1:], strict=False):
                while True:
                    letter, to = _least(ways[state], before, then, state)
                    audit.append(letter)
                    state = to
                    if letter != "I":
                        break
    return "".join(audit), state


def _least(ways: list[tuple[str, int, int]], before: list[int], then: list[int], state: int) -> tuple[str, int]:
    for letter, cost, to in (ways[0], ("I", 2, None), *ways[1:]):
        if to is None:
            if 2 + before[_NEXT[state]] == before[state]:
                return "I", _NEXT[state]
        elif cost + then[to] == before[state]:
            return letter, to
    raise AssertionError("no edit keeps the least cost")


def _initial(role: Column) -> Column:
    first = F.substring(role, 1, 1)
    return F.when(first == "s", _S).when(first == "u", _U).when(first == "a", _A).otherwise(_OTHER)


def turn_rows(log: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """The log under fixed names, null roles and texts as one space, with the
    order of rows inside a turn number."""
    rows = log.select(
        F.col(id_col).alias("conv"), F.col(turn_col).cast("bigint").alias("turn"),
        F.coalesce(F.col(role_col).cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(F.col(text_col).cast("string"), F.lit(" ")).alias("text"))
    return rows.select(
        "*", F.substring("role", 1, HEAD).alias("role_head"), F.substring("text", 1, HEAD).alias("text_head"),
        F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256).alias("content"))


_ORDER = ("turn", "role_head", "text_head", "content")


def _pieces(rows: DataFrame) -> DataFrame:
    """Summaries and runs of the conversations' pieces, in place order."""
    last = F.right(F.rtrim("text", F.lit(SPACE)), F.lit(1))
    narrow = rows.select(
        "conv", *_ORDER, _initial(F.col("role")).alias("initial"),
        F.when(last == "", _BLANK).when(last.isin(".", "!", "?"), _FINE).otherwise(_TRUNCATED).alias("flaw"))
    # the last key lets equal rows of one place, however many, go to several tasks
    narrow = narrow.withColumn("any", F.monotonically_increasing_id()).repartitionByRange(
        "conv", *_ORDER, "any").sortWithinPartitions("conv", *_ORDER, "any")
    placed = materialize(narrow.select(
        "conv", "turn", "content", "initial", "flaw", F.spark_partition_id().alias("part"),
        F.monotonically_increasing_id().alias("place")), "repair-places")
    # a row that is not the first of its role and text in the conversation is
    # repeated; the first places join the rows as neighbours in one sorted stream
    firsts = placed.where(F.col("flaw") != _BLANK).groupBy("conv", "content").agg(
        F.min(F.struct("place", "part")).alias("at"))
    both = placed.select("part", "place", F.lit(1).alias("kind"), "conv", "turn", "initial", "flaw").unionByName(
        firsts.select("at.part", "at.place", F.lit(0).alias("kind")), allowMissingColumns=True)
    both = both.repartition("part").sortWithinPartitions("part", "place", "kind")
    kind = rows.schema["conv"].dataType
    schema = T.StructType([T.StructField("conv", kind), *(T.StructField(n, T.LongType()) for n in (
        "place", "first_turn", "last_turn", "low", "high", "turns", "blank", "duplicate", "truncated", "illegal",
        "first_initial", "last_initial")), T.StructField("symbols", T.BinaryType()),
        T.StructField("lengths", T.ArrayType(T.IntegerType())), T.StructField("matrix", T.ArrayType(T.LongType()))])
    return materialize(both.mapInArrow(_piece_stream(schema), schema), "repair-pieces")


class _Piece:
    """What is kept of a piece's rows: counts and the runs of their symbols."""

    def __init__(self, conv, place: int) -> None:
        self.conv, self.place, self.rows = conv, place, 0
        self.first_turn = self.last_turn = self.low = self.high = None
        self.turns = self.illegal = 0
        self.flaws = [0, 0, 0]  # blank, duplicate, truncated
        self.first_initial = self.last_initial = None
        self.runs: list[list[int]] = []

    def add(self, turn: int | None, initial: int, flaw: int, first: bool) -> None:
        if self.rows == 0:
            self.first_turn, self.first_initial = turn, initial
        elif (self.last_initial, initial) not in _LEGAL:
            self.illegal += 1
        if turn is not None:
            if self.low is None:
                self.low = turn
            if turn != self.high:
                self.turns += 1
            self.high = turn
        self.last_turn, self.last_initial = turn, initial
        gone = flaw == _BLANK or not first
        if flaw == _BLANK:
            self.flaws[0] += 1
        elif not first:
            self.flaws[1] += 1
        elif flaw == _TRUNCATED:
            self.flaws[2] += 1
        symbol = MUST_GO if gone else 2 * initial + (flaw == _TRUNCATED)
        if self.runs and self.runs[-1][0] == symbol:
            self.runs[-1][1] += 1
        else:
            self.runs.append([symbol, 1])
        self.rows += 1

    def row(self) -> tuple:
        runs = tuple(map(tuple, self.runs))
        matrix = _known_matrix(runs) if len(runs) < 32 else piece_matrix(list(runs))
        return (self.conv, self.place, self.first_turn, self.last_turn, self.low, self.high, self.turns, *self.flaws,
                self.illegal, self.first_initial, self.last_initial, bytes(s for s, _ in runs),
                [n for _, n in runs], matrix.ravel().tolist())


@lru_cache(maxsize=1 << 14)
def _known_matrix(runs: tuple) -> np.ndarray:
    return piece_matrix(list(runs))


@lru_cache(maxsize=1 << 14)
def _known_unroll(runs: tuple, state: int, after: tuple) -> tuple[str, int]:
    return unroll(list(runs), state, np.array(after))


def _table(rows: list[tuple], schema: T.StructType) -> pa.RecordBatch:
    from pyspark.sql.pandas.types import to_arrow_schema

    form = to_arrow_schema(schema)
    return pa.RecordBatch.from_arrays(
        [pa.array([r[i] for r in rows], f.type) for i, f in enumerate(form)], names=form.names)


def _piece_stream(schema: T.StructType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece, part_now, first_at, done = None, None, None, []
        for batch in batches:
            columns = (batch.column(batch.schema.get_field_index(c)).to_pylist()
                       for c in ("part", "place", "kind", "conv", "turn", "initial", "flaw"))
            for part, place, kind, conv, turn, initial, flaw in zip(*columns, strict=True):
                if kind == 0:
                    first_at = place
                    continue
                if piece is None or part != part_now or conv != piece.conv or piece.rows >= PIECE_ROWS:
                    if piece is not None:
                        done.append(piece.row())
                    piece, part_now = _Piece(conv, place), part
                piece.add(turn, initial, flaw, place == first_at)
            if len(done) >= 1000:
                yield _table(done, schema)
                done = []
        if piece is not None:
            done.append(piece.row())
        if done:
            yield _table(done, schema)
    return run


def _costs_to_go(pieces: DataFrame) -> DataFrame:
    """(conv, place, after) of the pieces that another one follows: products
    of the matrices, gathered by conversation (a row per PIECE_ROWS rows and
    task)."""
    many = pieces.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("place", "matrix"))).alias("all")) \
        .where(F.size("all") > 1)
    schema = T.StructType([T.StructField("conv", pieces.schema["conv"].dataType),
                           T.StructField("place", T.LongType()), T.StructField("after", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                after, out = np.array(ENDING), []
                for piece in reversed(row["all"]):
                    out.append((row["conv"], piece["place"], after.tolist()))
                    after = np.minimum((np.array(piece["matrix"]).reshape(4, 4) + after).min(1), NEVER)
                yield _table(out, schema)

    return many.mapInArrow(run, schema)


def _unrolled(pieces: DataFrame) -> DataFrame:
    """Every piece with its audit and last state from each state, and its costs."""
    later = _costs_to_go(pieces).withColumnsRenamed({"conv": "c", "place": "p"})
    placed = pieces.join(later, F.col("conv").eqNullSafe(F.col("c")) & (F.col("place") == F.col("p")), "left").select(
        "*", F.col("p").isNull().alias("alone")).drop("c", "p", "matrix")
    dropped = ("symbols", "lengths", "after", "alone")
    schema = T.StructType([*(f for f in placed.schema.fields if f.name not in dropped),
                           T.StructField("cost", T.LongType()),
                           T.StructField("audits", T.ArrayType(T.StringType())),
                           T.StructField("ends", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                runs = tuple(zip(row["symbols"], row["lengths"], strict=True))
                after = tuple(row["after"] or ENDING)
                states = [START] if row["alone"] else range(4)
                ways = [_known_unroll(runs, q, after) if sum(row["lengths"]) < 64
                        else unroll(list(runs), q, np.array(after)) for q in states]
                cost = int(reduce(lambda v, r: to_go(v, *r), reversed(runs), np.array(after))[START])
                out.append((*(row[f.name] for f in schema.fields[:-3]), cost,
                            [a for a, _ in ways], [q for _, q in ways]))
            yield _table(out, schema)

    return placed.mapInArrow(run, schema)


_OUT = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def _chained(unrolled: DataFrame) -> DataFrame:
    """One row a conversation: its counts, cost and audit."""
    kind = unrolled.schema["conv"].dataType
    gathered = unrolled.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct(
        "place", *(c for c in unrolled.columns if c not in ("conv", "place"))))).alias("all"))
    schema = T.StructType([T.StructField("conv", kind), *(T.StructField(n, T.LongType()) for n in _OUT),
                           T.StructField("audit", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _table([_chain(row["conv"], row["all"]) for row in batch.to_pylist()], schema)

    return gathered.mapInArrow(run, schema)


def _chain(conv, pieces: list[dict]) -> tuple:
    state, audit, turns, low, high = START, [], 0, None, None
    illegal = sum(p["illegal"] for p in pieces)
    for before, p in zip([None, *pieces], pieces, strict=False):
        audit.append(p["audits"][state])
        state = p["ends"][state]
        turns += p["turns"]
        if before is not None:
            illegal += (before["last_initial"], p["first_initial"]) not in _LEGAL
            turns -= before["last_turn"] is not None and before["last_turn"] == p["first_turn"]
        if p["low"] is not None:
            low, high = p["low"] if low is None else low, p["high"]
    audit.append({USER: "I", SYSTEM: "II"}.get(state, ""))
    gaps = 0 if low is None else min(high - low + 1 - turns, (1 << 63) - 1)
    return (conv, gaps, *(sum(p[k] for p in pieces) for k in ("blank", "duplicate", "truncated")), illegal,
            pieces[0]["cost"], "".join(audit))


def audit_conversations(log: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                        text_col: str = "text") -> DataFrame:
    """One row a conversation: (``conv``, gaps, blank, duplicate, truncated,
    illegal, cost, audit).

    Rows go by turn number (nulls first), then by the first HEAD characters of
    role and text, then by a hash of both; equal rows stand side by side.  A
    null role or text is one space; rows without an id are one conversation
    with a null id.  A row's first fault counts: blank, then duplicate (role and
    text seen earlier in the conversation), then truncated.  ``gaps`` ignores
    turns without a number.  Texts and conversations of any length are read
    whole.  Other columns are not read; an empty log gives an empty table.
    """
    return _chained(_unrolled(_pieces(turn_rows(log, id_col, turn_col, role_col, text_col))))


def _with_audits(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """Every conversation's audit, followed by its rows in order."""
    both = audits.withColumn("kind", F.lit(0)).unionByName(
        rows.withColumn("kind", F.lit(1)), allowMissingColumns=True)
    return both.repartition("conv").sortWithinPartitions("conv", "kind", *_ORDER)


class _Walk:
    """Applies an audit to the rows of one conversation, in order."""

    def __init__(self, audit: str) -> None:
        self.audit, self.at, self.state = audit, 0, START

    def _inserted(self) -> Iterator[tuple[str, str, str]]:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.at += 1
            self.state = _NEXT[self.state]
            yield "I", _TURN[self.state], ""

    def row(self, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        """(edit, role, text) of the turns that this row gives rise to."""
        yield from self._inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            self.state = _KEEP[self.state, {"s": _S, "u": _U, "a": _A}[role[0]]]
            yield edit, role, text
        elif edit == "R":
            self.state = _NEXT[self.state]
            yield edit, _TURN[self.state], text

    def rest(self) -> Iterator[tuple[str, str, str]]:
        yield from self._inserted()


def _walked(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple]:
    """("begin", audit row), ("turn", (edit, role, text)) and ("end", audit row)
    events of a sorted stream."""
    walk = row = None
    for batch in batches:
        wanted = ["kind", "role", "text", *names]
        columns = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in wanted]
        for kind, role, text, *fields in zip(*columns, strict=True):
            if kind == 0:
                if walk is not None:
                    yield from (("turn", t) for t in walk.rest())
                    yield "end", row
                row = tuple(fields)
                walk = _Walk(row[-1])
                yield "begin", row
            else:
                yield from (("turn", t) for t in walk.row(role, text))
        yield "batch", None
    if walk is not None:
        yield from (("turn", t) for t in walk.rest())
        yield "end", row


def repair(log: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
           text_col: str = "text") -> DataFrame:
    """``audit_conversations`` with ``repaired_sha256``: the digest of the
    repaired conversation, ``role:text`` lines joined by a newline."""
    rows = turn_rows(log, id_col, turn_col, role_col, text_col)
    audits = _chained(_unrolled(_pieces(rows)))
    names = ["conv", *_OUT, "audit"]
    schema = T.StructType([*audits.select(*names).schema.fields, T.StructField("repaired_sha256", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, digest, lines = [], None, 0
        for event, what in _walked(batches, names):
            if event == "begin":
                digest, lines = hashlib.sha256(), 0
            elif event == "turn":
                digest.update(("\n" * (lines > 0) + f"{what[1]}:{what[2]}").encode())
                lines += 1
            elif event == "end":
                done.append((*what, digest.hexdigest()))
            elif len(done) >= 1000:
                yield _table(done, schema)
                done = []
        if done:
            yield _table(done, schema)

    return _with_audits(rows, audits).mapInArrow(run, schema)


def repaired_turns(log: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                   text_col: str = "text") -> DataFrame:
    """The repaired conversations themselves: (conv, place, edit, role, text),
    ``place`` counting a conversation's turns from 0, ``edit`` K, R or I."""
    rows = turn_rows(log, id_col, turn_col, role_col, text_col)
    names = ["conv", "audit"]
    schema = T.StructType([rows.schema["conv"], T.StructField("place", T.LongType()), *(
        T.StructField(n, T.StringType()) for n in ("edit", "role", "text"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, conv, place = [], None, 0
        for event, what in _walked(batches, names):
            if event == "begin":
                conv, place = what[0], 0
            elif event == "turn":
                done.append((conv, place, *what))
                place += 1
            elif event == "batch" and done:
                yield _table(done, schema)
                done = []
        if done:
            yield _table(done, schema)

    return _with_audits(rows, _chained(_unrolled(_pieces(rows))).select(*names)).mapInArrow(run, schema)
