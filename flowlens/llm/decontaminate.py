"""Benchmark decontamination: an FM-index per training shard.

A shard is a bounded slice of a partition's texts.  Its words become symbols
of the test vocabulary; a word outside it cannot be part of a test phrase and
acts as a separator, so the index holds the runs of test-vocabulary words that
are long enough for the shortest phrase.  Every phrase is searched backward
through the wavelet-matrix ranks of the Burrows-Wheeler transform, all phrases
at once; occurrences are located by walking to sampled suffix positions, and
their word ranges are merged into removal spans.

Nothing is shuffled: the shards are indexed where they are read and the test
phrases travel in blocks of a fixed size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlens.llm.common import ALNUM, SLICE_BYTES, Words, free_name, slices, text_column
from flowlens.operators._small import materialize

#: Words of a test phrase.
WINDOW = 10
#: Test words per broadcast block; more test text takes more passes.
BLOCK_WORDS = 1_000_000
#: Every how many text positions a suffix position is stored.
SAMPLE = 8


class Phrases:
    """A block of test items: vocabulary, distinct windows by length, owners."""

    def __init__(self, item_ids: list, texts: list) -> None:
        split = Words(pa.array([t or "" for t in texts], pa.string()), ALNUM)
        coded = split.words.dictionary_encode()
        self.vocabulary = coded.dictionary
        symbols = coded.indices.to_numpy(zero_copy_only=False).astype(np.int32) + 1
        rows: dict[int, list[np.ndarray]] = {}
        owner: dict[int, list[np.ndarray]] = {}
        for i, (lo, hi) in enumerate(zip(split.first[:-1], split.first[1:], strict=True)):
            n = min(WINDOW, hi - lo)
            if n:
                grid = np.lib.stride_tricks.sliding_window_view(symbols[lo:hi], n)
                rows.setdefault(n, []).append(grid)
                owner.setdefault(n, []).append(np.full(len(grid), i))
        self.windows, self.owners = {}, {}
        for n, parts in rows.items():
            distinct, which = np.unique(np.concatenate(parts), axis=0, return_inverse=True)
            order = np.argsort(which, kind="stable")
            bounds = np.searchsorted(which[order], np.arange(len(distinct) + 1))
            self.windows[n] = distinct
            self.owners[n] = (np.concatenate(owner[n])[order], bounds)
        self.item_ids = [None if i is None else str(i) for i in item_ids]


class RankBits:
    """A bit vector with constant-time rank: packed words and running counts."""

    def __init__(self, bits: np.ndarray) -> None:
        padded = np.zeros((len(bits) // 64 + 1) * 64, bool)
        padded[:len(bits)] = bits
        self.packed = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.zeros(len(self.packed) + 1, np.int64)
        np.cumsum(np.bitwise_count(self.packed), out=self.before[1:])
        self.ones = int(self.before[-1])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones in front of each position."""
        word, bit = at >> 6, (at & 63).astype(np.uint64)
        below = (np.uint64(1) << bit) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.packed[word] & below)

    def get(self, at: np.ndarray) -> np.ndarray:
        return (self.packed[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1


class WaveletMatrix:
    """Rank and access over a symbol sequence, one bit vector per symbol bit."""

    def __init__(self, symbols: np.ndarray, n_symbols: int) -> None:
        self.levels = []
        for bit in range(max(1, int(n_symbols - 1).bit_length()) - 1, -1, -1):
            ones = (symbols >> bit & 1).astype(bool)
            vector = RankBits(ones)
            self.levels.append((bit, vector, len(symbols) - vector.ones))
            symbols = np.concatenate([symbols[~ones], symbols[ones]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol in front of each position."""
        base = np.zeros_like(at)
        for bit, vector, zeros in self.levels:
            one = (symbol >> bit & 1).astype(bool)
            a, b = vector.rank(base), vector.rank(at)
            base, at = np.where(one, zeros + a, base - a), np.where(one, zeros + b, at - b)
        return at - base

    def get(self, at: np.ndarray) -> np.ndarray:
        symbol = np.zeros(len(at), np.int64)
        for _, vector, zeros in self.levels:
            one = vector.get(at)
            ahead = vector.rank(at)
            symbol = symbol * 2 + one
            at = np.where(one, zeros + ahead, at - ahead)
        return symbol


def suffix_order(ranks: np.ndarray) -> np.ndarray:
    """Suffix array of a sequence by prefix doubling; suffixes already told
    apart leave the sort."""
    n = len(ranks)
    order = np.argsort(ranks, kind="stable")
    ordered = ranks[order]
    first = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    group = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[order] = group
    reach = 1
    slots = np.arange(n)  # places in the order that still share a rank
    while True:
        same = np.zeros(len(slots), bool)
        where = rank[order[slots]]
        same[1:] = where[1:] == where[:-1]
        same[:-1] |= same[1:].copy()
        slots = slots[same]
        if not len(slots):
            return order
        suffix = order[slots]
        follow = suffix + reach
        nxt = np.where(follow < n, rank[np.minimum(follow, n - 1)] + 1, 0)
        place = np.lexsort((nxt, rank[suffix]))
        suffix, nxt = suffix[place], nxt[place]
        order[slots] = suffix
        old = rank[suffix]
        new = np.concatenate([[True], (old[1:] != old[:-1]) | (nxt[1:] != nxt[:-1])])
        rank[suffix] = slots[np.maximum.accumulate(np.where(new, np.arange(len(slots)), 0))]
        reach *= 2


class FMIndex:
    """FM-index of runs of symbols (1 ..): count by backward search, locate by
    sampled suffix positions.  ``places`` are the runs' positions, ascending;
    a gap between them starts a new run."""

    def __init__(self, symbols: np.ndarray, places: np.ndarray, opens: np.ndarray, n_symbols: int) -> None:
        starts = np.flatnonzero(opens)
        n = len(symbols) + len(starts)
        seat = np.arange(len(symbols)) + np.cumsum(opens)  # one separator before each run
        text = np.zeros(n, np.int64)
        text[seat] = symbols
        self.place = np.full(n, -1, np.int64)
        self.place[seat] = places
        breaks = np.flatnonzero(text == 0)
        ranks = text + len(breaks)
        ranks[breaks] = np.arange(len(breaks))  # separators differ, so no order runs across one
        order = suffix_order(ranks)
        self.bwt = WaveletMatrix(text[order - 1], n_symbols)
        self.below = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=n_symbols))])
        sampled = np.arange(n) % SAMPLE == 0
        sampled[breaks] = True
        sampled[breaks + 1] = True  # a walk never leaves its run
        self.marked = RankBits(sampled[order])
        self.samples = order[sampled[order]]

    def search(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges [lo, hi) of the suffixes that start with each window."""
        last = windows[:, -1]
        lo, hi = self.below[last].copy(), self.below[last + 1].copy()
        for k in range(windows.shape[1] - 2, -1, -1):
            live = np.flatnonzero(lo < hi)
            if not len(live):
                break
            c = windows[live, k].astype(np.int64)
            lo[live] = self.below[c] + self.bwt.rank(c, lo[live])
            hi[live] = self.below[c] + self.bwt.rank(c, hi[live])
        return lo, np.maximum(lo, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions (as given in ``places``) of the rows' suffixes."""
        rows = rows.copy()
        found = np.zeros(len(rows), np.int64)
        live, steps = np.arange(len(rows)), 0
        while len(live):
            hit = self.marked.get(rows[live])
            done = live[hit]
            found[done] = self.samples[self.marked.rank(rows[done])] + steps
            live = live[~hit]
            c = self.bwt.get(rows[live])
            rows[live] = self.below[c] + self.bwt.rank(c, rows[live])
            steps += 1
        return self.place[found]


def shard_hits(phrases: Phrases, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text row, first word, end word, item index) of every located occurrence
    of a test window in a slice of texts, words counted within the slice."""
    none = np.zeros(0, np.int64)
    if not phrases.windows or not len(words.words):
        return none, none, none, none
    symbols = pc.fill_null(pc.index_in(words.words, value_set=phrases.vocabulary), -1) \
        .to_numpy(zero_copy_only=False).astype(np.int64) + 1
    known = symbols > 0
    opens = known.copy()
    opens[1:] &= ~known[:-1]
    firsts = words.first[:-1][np.diff(words.first) > 0]
    opens[firsts] = known[firsts]
    places = np.flatnonzero(known)
    run = np.cumsum(opens[places]) - 1
    long_enough = np.bincount(run)[run] >= min(phrases.windows) if len(run) else np.zeros(0, bool)
    places = places[long_enough]
    if not len(places):
        return none, none, none, none
    index = FMIndex(symbols[places], places, opens[places], len(phrases.vocabulary) + 1)
    spans = []
    for n, windows in phrases.windows.items():
        lo, hi = index.search(windows)
        hits = np.flatnonzero(lo < hi)
        if not len(hits):
            continue
        count = (hi - lo)[hits]
        window = np.repeat(hits, count)
        rows = np.repeat(lo[hits], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        at = index.locate(rows)
        owners, bounds = phrases.owners[n]
        per = np.diff(bounds)[window]
        item = owners[np.repeat(bounds[window], per) + np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)]
        spans.append((np.repeat(at, per), np.repeat(at + n, per), item))
    if not spans:
        return none, none, none, none
    begin, end, item = (np.concatenate(x) for x in zip(*spans, strict=True))
    return np.searchsorted(words.first, begin, side="right") - 1, begin, end, item


def merged_spans(first: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Union of word ranges: (row, start, end) of maximal hit stretches, with
    start and end counted from the text's first word."""
    n = int(first[-1])
    delta = np.bincount(begin, minlength=n + 1) - np.bincount(end, minlength=n + 1)
    inside = np.cumsum(delta)[:n] > 0
    opens, closes = inside.copy(), inside.copy()
    opens[1:] &= ~inside[:-1]
    closes[:-1] &= ~inside[1:]
    edges = first[1:-1]
    edges = edges[(edges > 0) & (edges < n)]
    opens[edges] = inside[edges]
    closes[edges - 1] = inside[edges - 1]
    start, stop = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    row = np.searchsorted(first, start, side="right") - 1
    return row, start - first[row], stop - first[row]


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, block_words: int) -> Iterator[Phrases]:
    ids, texts, words = [], [], 0
    for item, text in benchmark.select(item_col, text_col).toLocalIterator():
        n = len((text or "").encode()) // 2 + 1  # at least its words
        if ids and words + n > block_words:
            yield Phrases(ids, texts)
            ids, texts, words = [], [], 0
        ids.append(item)
        texts.append(text)
        words += n
    if ids:
        yield Phrases(ids, texts)


def mark_contamination(docs: DataFrame, benchmark: DataFrame, text_col: str = "text",
                       item_col: str = "item_id", item_text_col: str = "text",
                       keep: list[str] | None = None, block_words: int = BLOCK_WORDS) -> tuple[DataFrame, dict]:
    """Documents with their test-phrase hits.

    Returns the frame (columns ``keep``, all by default, plus three) and the
    names of the three: ``n_words`` bigint; ``spans``, an array of merged
    (start, end) word ranges hit by any phrase; ``items``, the distinct ids of
    the hitting items as strings, sorted.

    A phrase is ten consecutive words of an item; an item of fewer words is
    one phrase.  Null or empty texts have no words and no hits; an item with a
    null id hits words but has no id to report; repeated items count once;
    repeated rows each get a row; an empty benchmark hits nothing.  The
    benchmark is read in blocks of at most ``block_words`` words, one pass
    over the documents for each.
    """
    spark = docs.sparkSession
    keep = docs.columns if keep is None else keep
    names = {k: free_name(docs, k) for k in ("n_words", "spans", "items")}
    span_type = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    docs = docs.select(*dict.fromkeys([*keep, text_col])) \
        .withColumn(names["n_words"], F.lit(0).cast("bigint")) \
        .withColumn(names["spans"], F.array().cast(span_type)) \
        .withColumn(names["items"], F.array().cast("array<string>"))
    schema = docs.schema
    blocks = _blocks(benchmark, item_col, item_text_col, block_words)
    current = next(blocks, None) or Phrases([], [])
    while current is not None:
        following = next(blocks, None)
        known = spark.sparkContext.broadcast(current)
        docs = docs.mapInArrow(_marker(known, text_col, names), schema)
        if following is not None:
            docs = materialize(docs, "decontaminate")
        current = following
    return docs.select(*keep, *names.values()), names


def _marker(known, text_col: str, names: dict):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = known.value
        for batch in batches:
            texts = text_column(batch, text_col)
            for lo, hi in slices(texts, SLICE_BYTES):
                yield _mark(batch.slice(lo, hi - lo), texts.slice(lo, hi - lo), phrases, names)
    return run


def _mark(batch: pa.RecordBatch, texts: pa.StringArray, phrases: Phrases, names: dict) -> pa.RecordBatch:
    words = Words(texts, ALNUM)
    row, begin, end, item = shard_hits(phrases, words)
    earlier = batch.column(batch.schema.get_field_index(names["spans"]))
    if len(earlier.flatten()):  # spans of the blocks before
        held = np.repeat(np.arange(len(earlier)), pc.list_value_length(earlier).to_numpy(zero_copy_only=False))
        flat = earlier.flatten()
        begin = np.concatenate([begin, flat.field("start").to_numpy() + words.first[held]])
        end = np.concatenate([end, flat.field("end").to_numpy() + words.first[held]])
    owner, start, stop = merged_spans(words.first, begin, end)
    n = len(texts)
    found: list[set] = [set() for _ in range(n)]
    for r, i in np.unique(np.stack([row, item], 1), axis=0) if len(row) else []:
        if phrases.item_ids[i] is not None:
            found[r].add(phrases.item_ids[i])
    held_items = batch.column(batch.schema.get_field_index(names["items"])).to_pylist()
    bounds = np.searchsorted(owner, np.arange(n + 1))
    new = {
        names["n_words"]: pa.array(words.per_text(), pa.int64()),
        names["spans"]: pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.StructArray.from_arrays(
            [pa.array(start, pa.int64()), pa.array(stop, pa.int64())], ["start", "end"])),
        names["items"]: pa.array([sorted({*a, *b}) for a, b in zip(found, held_items, strict=True)],
                                 pa.list_(pa.string())),
    }
    columns = [new.get(f.name, c) for f, c in zip(batch.schema, batch.columns, strict=True)]
    return pa.RecordBatch.from_arrays(columns, names=batch.schema.names)


def cut_spans(docs: DataFrame, text_col: str, spans_col: str) -> DataFrame:
    """The texts with the words of their removal spans (and what stands
    between them) taken out; other columns stay."""
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            out = []
            spans = batch.column(batch.schema.get_field_index(spans_col)).to_pylist()
            for text, cut in zip(batch.column(at).to_pylist(), spans, strict=True):
                if text is None or not cut:
                    out.append(text)
                    continue
                words, body = Words(pa.array([text], pa.string()), ALNUM), text.encode()
                kept, last = [], 0
                for s in cut:
                    kept.append(body[last:int(words.start[s["start"]])])
                    last = int(words.end[s["end"] - 1])
                out.append(b"".join([*kept, body[last:]]).decode())
            columns = list(batch.columns)
            columns[at] = pa.array(out, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return docs.mapInArrow(run, schema)


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents that hold no test phrase, columns unchanged."""
    marked, names = mark_contamination(docs, benchmark, text_col)
    return marked.where(F.size(names["spans"]) == 0).select(*docs.columns)
