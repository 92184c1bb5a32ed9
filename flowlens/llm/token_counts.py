"""Token counts of a byte-level BPE by rank-synchronous array merging.

The texts of a slice are cut into pre-tokens; the distinct ones that the task
has not met yet are laid out together as one ragged array of symbols.  Each
round finds every sequence's lowest-rank adjacent pair and merges all its
occurrences at once, in all sequences together, until no pair has a rank.  The
surviving symbols of a sequence are its tokens.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from flowlens.llm.common import free_name, slices, text_column

# Fixed value: the published pre-token pattern of this vocabulary family.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Distinct pre-tokens whose counts a task remembers; then it starts anew.
MEMO = 400_000
#: Longest pre-token (characters) that is remembered.
MEMO_CHARS = 64
#: Symbols merged together in one ragged array.
MERGE_SYMBOLS = 1 << 21
_NONE = np.int32(0x7FFFFFFF)


def byte_symbols() -> dict[str, int]:
    """The printable stand-in character of every byte, as such files write
    them: printable Latin-1 characters stand for themselves, the other bytes
    for the code points from 256 on."""
    plain = {b for lo, hi in ((0x21, 0x7E), (0xA1, 0xAC), (0xAE, 0xFF)) for b in range(lo, hi + 1)}
    names = {chr(b): b for b in plain}
    names.update({chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - plain))})
    return names


class Merges:
    """Merge table: (left, right) -> (rank, merged symbol), as sorted arrays."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        stand_in = byte_symbols()
        ids = {name: i for i, name in enumerate(spec["model"]["vocab"])}
        self.byte_id = np.zeros(256, np.int32)
        for name, byte in stand_in.items():
            self.byte_id[byte] = ids[name]
        keys, merged = [], []
        for pair in spec["model"]["merges"]:
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            keys.append(ids[a] << 32 | ids[b])
            merged.append(ids[a + b])
        keys, ranks = np.array(keys, np.int64), np.arange(len(keys), dtype=np.int32)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.merged = keys[order], ranks[order], np.array(merged, np.int32)
        self.specials = [t["content"] for t in spec.get("added_tokens", [])]

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], _NONE)


def surviving_symbols(pieces: list[bytes], merges: Merges) -> np.ndarray:
    """Number of symbols left of each byte string after all merges.

    The ragged array drops a sequence when none of its pairs has a rank.  A
    run of overlapping equal pairs merges from its left end, as the sequential
    rule does; a merge only makes pairs of higher rank, so one round may merge
    every occurrence of a sequence's lowest pair."""
    size = np.array([len(p) for p in pieces], np.int64)
    left_over = size.copy()
    symbol = merges.byte_id[np.frombuffer(b"".join(pieces), np.uint8)]
    owner = np.repeat(np.arange(len(pieces)), size)
    rank = _pair_ranks(symbol, owner, merges)
    while len(symbol):
        first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        low = np.minimum.reduceat(rank, first)
        count = np.diff(np.append(first, len(symbol)))
        left_over[owner[first]] = count
        live = np.repeat(low < _NONE, count)
        if not live.all():
            symbol, owner, rank = symbol[live], owner[live], rank[live]
            count, low = count[low < _NONE], low[low < _NONE]
        if not len(symbol):
            break
        hit = np.flatnonzero(rank == np.repeat(low, count))
        if len(hit) > 1:  # a, a, a: of consecutive hits every other one merges
            chain = np.concatenate([[True], hit[1:] != hit[:-1] + 1])
            place = np.arange(len(hit))
            hit = hit[(place - np.maximum.accumulate(np.where(chain, place, 0))) % 2 == 0]
        symbol[hit] = merges.merged[rank[hit]]
        keep = np.ones(len(symbol), bool)
        keep[hit + 1] = False
        symbol, owner = symbol[keep], owner[keep]
        place = (np.cumsum(keep) - 1)[hit]
        rank = rank[keep]
        touched = np.unique(np.concatenate([place, place[place > 0] - 1]))
        rank[touched] = _pair_ranks_at(symbol, owner, touched, merges)
    return left_over


def _pair_ranks(symbol: np.ndarray, owner: np.ndarray, merges: Merges) -> np.ndarray:
    return _pair_ranks_at(symbol, owner, np.arange(len(symbol)), merges)


def _pair_ranks_at(symbol: np.ndarray, owner: np.ndarray, at: np.ndarray, merges: Merges) -> np.ndarray:
    """Rank of the pair that starts at each place; none at a sequence's end."""
    out = np.full(len(at), _NONE, np.int32)
    inner = np.flatnonzero(at + 1 < len(symbol))
    inner = inner[owner[at[inner]] == owner[at[inner] + 1]]
    out[inner] = merges.rank(symbol[at[inner]], symbol[at[inner] + 1])
    return out


class Counter:
    """Token counts of texts, with a bounded memo of pre-token counts."""

    def __init__(self, path: str) -> None:
        self.merges = Merges(path)
        self.pattern = regex.compile(PRE_TOKEN)
        self.special = regex.compile("|".join(regex.escape(s) for s in self.merges.specials)) \
            if self.merges.specials else None
        self.memo: dict[str, int] = {}

    def _pieces(self, text: str) -> tuple[list[str], int]:
        """Pre-tokens of a text and the special strings in it, a token each."""
        if self.special is None or not self.special.search(text):
            return self.pattern.findall(text), 0
        parts = self.special.split(text)
        return [p for part in parts for p in self.pattern.findall(part)], len(parts) - 1

    def count(self, texts: list[str]) -> list[int]:
        cut = [self._pieces(t) for t in texts]
        memo = self.memo
        if len(memo) > MEMO:
            memo.clear()
        new = list({p for pieces, _ in cut for p in pieces if p not in memo})
        memo.update(self._merge(new))
        out = [n + sum(map(memo.__getitem__, pieces)) for pieces, n in cut]
        for p in new:
            if len(p) > MEMO_CHARS:
                del memo[p]
        return out

    def _merge(self, pieces: list[str]) -> Iterator[tuple[str, int]]:
        coded = [p.encode() for p in pieces]
        lo = 0
        while lo < len(coded):
            hi, size = lo, 0
            while hi < len(coded) and (hi == lo or size + len(coded[hi]) <= MERGE_SYMBOLS):
                size += len(coded[hi])
                hi += 1
            yield from zip(pieces[lo:hi], surviving_symbols(coded[lo:hi], self.merges).tolist(), strict=True)
            lo = hi


def count_tokens(docs: DataFrame, vocabulary: str, text_col: str = "text",
                 keep: list[str] | None = None) -> tuple[DataFrame, dict]:
    """Documents with their UTF-8 size and token count.

    ``vocabulary`` names the tokenizer file on every executor; the file is
    installed with the cluster's Python and never shipped.  Returns the frame
    (columns ``keep``, all by default, plus two) and the names of the two.
    Null and empty texts have 0 bytes and 0 tokens; a special string of the
    vocabulary inside a text is one token; repeated rows each get a row; an
    empty table gives an empty table.
    """
    keep = docs.columns if keep is None else keep
    names = {k: free_name(docs, k) for k in ("n_bytes", "n_tokens")}
    docs = docs.select(*dict.fromkeys([*keep, text_col]))
    fields = [f for f in docs.schema.fields if f.name in keep]
    schema = T.StructType([*fields, *[T.StructField(n, T.LongType()) for n in names.values()]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(vocabulary)
        for batch in batches:
            texts = text_column(batch, text_col)
            kept = [batch.schema.get_field_index(f.name) for f in fields]
            for lo, hi in slices(texts):
                part = texts.slice(lo, hi - lo).to_pylist()
                rows = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays(
                    [*(rows.column(k) for k in kept),
                     pa.array([len(t.encode()) for t in part], pa.int64()),
                     pa.array(counter.count(part), pa.int64())],
                    names=schema.fieldNames())

    return docs.mapInArrow(run, schema), names
