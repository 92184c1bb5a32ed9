"""Ranked lexical search: accumulator-limited term-at-a-time evaluation.

Every task is an index shard: it turns each slice of its texts into postings of
the query terms and ranks the items on them, so no text is shuffled.  An
item's terms are taken rarest first.  A document gets an accumulator while a
document without one could still reach the top; once the bounds of the
remaining terms add up to less than the kth partial score, no accumulator is
created any more and the survivors are updated exactly.  The best rows of all
shards are merged in two grouped steps.

Weights come from one counting pass over all texts.  Query items travel in
blocks of at most BLOCK_WORDS words, two passes over the texts for each.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlens.llm.common import ALNUM, Words, slices, text_column
from flowlens.operators._small import materialize

#: Words of query items sent to the tasks at once.
BLOCK_WORDS = 1 << 20
#: Parts into which an item's shard results are dealt in the first merge.
MERGE_PARTS = 64
_TOTAL_DOCS, _TOTAL_WORDS = -1, -2


@dataclass
class Queries:
    """A block of items: ids, and per item its (term number, repeats)."""

    ids: list = field(default_factory=list)
    terms: list = field(default_factory=list)
    numbers: dict = field(default_factory=dict)
    words: int = 0

    def add(self, item, words: list[str]) -> None:
        self.ids.append(item)
        self.terms.append([(self.numbers.setdefault(w, len(self.numbers)), n) for w, n in Counter(words).items()])
        self.words += len(words)

    @property
    def vocabulary(self) -> pa.Array:
        return pa.array(list(self.numbers), pa.string())


def _blocks(items: DataFrame, item_col: str, text_col: str, block_words: int) -> Iterator[Queries]:
    block = Queries()
    for item, text in items.select(item_col, text_col).toLocalIterator():
        words = Words(pa.array([text or ""], pa.string()), ALNUM).words.to_pylist()
        if block.words and block.words + len(words) > block_words:
            yield block
            block = Queries()
        if words:  # an item without a word finds nothing
            block.add(item, words)
    if block.ids:
        yield block


@dataclass
class Postings:
    """Postings of the query terms in a slice: term t owns rows
    ``first[t]:first[t + 1]`` of ``row`` and ``tf``; ``length`` counts each
    text's words."""

    row: np.ndarray
    tf: np.ndarray
    first: np.ndarray
    length: np.ndarray


def postings(texts: pa.StringArray, vocabulary: pa.Array) -> Postings:
    words = Words(texts, ALNUM)
    length = words.per_text()
    term = pc.fill_null(pc.index_in(words.words, value_set=vocabulary), -1).to_numpy(zero_copy_only=False)
    known = np.flatnonzero(term >= 0)
    row = np.searchsorted(words.first, known, side="right") - 1
    pair, tf = np.unique(term[known].astype(np.int64) * max(1, len(length)) + row, return_counts=True)
    term, row = np.divmod(pair, max(1, len(length)))
    return Postings(row, tf.astype(np.int64), np.searchsorted(term, np.arange(len(vocabulary) + 1)), length)


@dataclass
class Statistics:
    docs: int
    words: int
    weight: list[int]

    def norms(self, length: np.ndarray) -> np.ndarray:
        """A text's length norm; whole numbers, also where 64 bits overflow."""
        if len(length) and int(length.max()) * 75 * self.docs >= 1 << 63:
            return np.array([25 + 75 * int(n) * self.docs // self.words for n in length], np.int64)
        return 25 + 75 * length * self.docs // max(1, self.words)


def term_weight(docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * docs + 2) / (2 * df + 1)))


def collection_statistics(docs: DataFrame, text_col: str, vocabulary) -> Statistics:
    """Documents with a word, their words, and every query term's weight; one
    row a term and task, summed before and after the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = vocabulary.value
        df, n_docs, n_words = np.zeros(len(terms), np.int64), 0, 0
        for batch in batches:
            texts = text_column(batch, text_col)
            for lo, hi in slices(texts):
                found = postings(texts.slice(lo, hi - lo), terms)
                df += np.diff(found.first)
                n_docs += int((found.length > 0).sum())
                n_words += int(found.length.sum())
        held = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([
            pa.array([*held.tolist(), _TOTAL_DOCS, _TOTAL_WORDS], pa.int64()),
            pa.array([*df[held].tolist(), n_docs, n_words], pa.int64())], names=["term", "n"])

    counted = docs.select(text_col).mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    got = dict(map(tuple, counted.collect()))  # at most a block's terms and two totals
    n_docs = got.get(_TOTAL_DOCS, 0)
    return Statistics(n_docs, got.get(_TOTAL_WORDS, 0),
                      [term_weight(n_docs, got.get(t, 0)) for t in range(len(vocabulary.value))])


def order(score: np.ndarray, ids: np.ndarray, missing: np.ndarray) -> np.ndarray:
    """Best first: score, then id, a row without an id last."""
    return np.lexsort((ids, missing, -score))


class Ranking:
    """The best rows of one item in one task."""

    def __init__(self, k: int) -> None:
        self.k = k
        self.score = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.int64)
        self.missing = np.zeros(0, bool)

    @property
    def bar(self) -> int:
        """What a row must reach; 1 until k rows are held."""
        return int(self.score[-1]) if len(self.score) == self.k else 1

    def add(self, score: np.ndarray, ids: np.ndarray, missing: np.ndarray) -> None:
        score, ids, missing = (np.concatenate(x) for x in (
            (self.score, score), (self.ids, ids), (self.missing, missing)))
        best = order(score, ids, missing)[:self.k]
        self.score, self.ids, self.missing = score[best], ids[best], missing[best]


def evaluate(plan: list[tuple[int, int]], found: Postings, gain: np.ndarray, most: np.ndarray,
             k: int, bar: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, scores) of the slice that can be among the best k.

    ``plan`` lists (term, factor) rarest first, ``gain`` is each posting's
    unweighted score, ``most`` its maximum by term, and ``bar`` the score that
    k rows seen earlier reach.  Every score returned is whole; a row left out
    scores below the kth best.
    """
    terms = [(t, f) for t, f in plan if f > 0 and most[t] > 0]
    left = sum(f * int(most[t]) for t, f in terms)
    held = np.zeros(len(found.length), np.int64)
    opened, n_held, growing = [], 0, True
    for t, f in terms:
        if growing and left < bar:
            growing = False
        elif growing and n_held >= k and left < int(held.max()):
            rows = np.unique(np.concatenate(opened))
            opened = [rows]
            growing = len(rows) < k or left >= int(np.partition(held[rows], len(rows) - k)[len(rows) - k])
        at, gained = found.row[found.first[t]:found.first[t + 1]], gain[found.first[t]:found.first[t + 1]]
        if not growing:
            kept = held[at] > 0
            at, gained = at[kept], gained[kept]
        else:
            opened.append(at)
            n_held += len(at)
        held[at] += f * gained
        left -= f * int(most[t])
    if not opened:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    rows = np.unique(np.concatenate(opened))
    rows = rows[held[rows] >= bar]
    return rows, held[rows]


def _ranker(known, id_col: str, text_col: str, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, facts, base = known.value
        vocabulary, weight = queries.vocabulary, facts.weight
        names = list(queries.numbers)
        plans = [[(t, n * weight[t]) for t, n in sorted(terms, key=lambda x: (-weight[x[0]], names[x[0]]))]
                 for terms in queries.terms]
        best = [Ranking(k) for _ in plans]
        for batch in batches:
            texts = text_column(batch, text_col)
            column = batch.column(batch.schema.get_field_index(id_col)).cast(pa.int64())
            missing = column.is_null().to_numpy(zero_copy_only=False)
            ids = pc.fill_null(column, 0).to_numpy(zero_copy_only=False)
            for lo, hi in slices(texts):
                found = postings(texts.slice(lo, hi - lo), vocabulary)
                norm = facts.norms(found.length)
                gain = 1_000_000_000 * found.tf // (1000 * found.tf + 8 * norm[found.row])
                most = np.zeros(len(vocabulary), np.int64)
                full = np.flatnonzero(np.diff(found.first))
                if len(full):
                    most[full] = np.maximum.reduceat(gain, found.first[full])
                for plan, ranking in zip(plans, best, strict=True):
                    rows, score = evaluate(plan, found, gain, most, k, ranking.bar)
                    if len(rows):
                        ranking.add(score, ids[lo:hi][rows], missing[lo:hi][rows])
        number = np.repeat(np.arange(len(best)), [len(r.score) for r in best])
        if len(number):
            yield pa.RecordBatch.from_arrays([
                pa.array(number + base, pa.int64()),
                pa.array(np.concatenate([r.ids for r in best]), pa.int64(),
                         mask=np.concatenate([r.missing for r in best])),
                pa.array(np.concatenate([r.score for r in best]), pa.int64())], names=["item_no", "doc", "score"])
    return run


def _best(rows: DataFrame, key: list, k: int) -> DataFrame:
    by = Window.partitionBy(*key).orderBy(F.desc("score"), F.asc_nulls_last("doc"))
    return rows.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def search(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text",
           item_col: str = "item_id", item_text_col: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """The k best documents of every item: (``item_col``, rank int, ``id_col`` bigint, score bigint).

    Scores are whole numbers (the weights and norms of ``Statistics``, the
    gains of ``_ranker``), so they don't depend on the order of sums.  Equal
    scores go by ascending id, a document without an id last.  Ids are whole
    numbers.  Null and empty texts have no term: such documents are not counted
    and not found, such items give no rows.  Every row of either table counts
    for itself, repeated ones too.  A text of any length is indexed whole; a
    text longer than a slice is a slice of its own.  Empty tables give an
    empty table.  Other columns are not read.
    """
    spark = docs.sparkSession
    id_type = items.schema[item_col].dataType
    parts, base = [], 0
    for block in _blocks(items, item_col, item_text_col, block_words):
        vocabulary = spark.sparkContext.broadcast(block.vocabulary)
        facts = collection_statistics(docs, text_col, vocabulary)
        known = spark.sparkContext.broadcast((block, facts, base))
        found = docs.select(id_col, text_col).mapInArrow(
            _ranker(known, id_col, text_col, k), "item_no long, doc long, score long")
        part = F.pmod(F.xxhash64("doc"), F.lit(MERGE_PARTS))
        best = _best(_best(found, ["item_no", part], k).drop("rank"), ["item_no"], k)
        # at most block_words items, each of at least a word
        names = spark.createDataFrame(
            [(base + i, item) for i, item in enumerate(block.ids)],
            T.StructType([T.StructField("item_no", T.LongType()), T.StructField("item", id_type)]))
        parts.append(best.join(names, "item_no").select(
            F.col("item").alias(item_col), F.col("rank").cast("int").alias("rank"),
            F.col("doc").alias(id_col), "score"))
        base += len(block.ids)
    if not parts:
        return spark.createDataFrame([], T.StructType([
            T.StructField(item_col, id_type), T.StructField("rank", T.IntegerType()),
            T.StructField(id_col, T.LongType()), T.StructField("score", T.LongType())]))
    if len(parts) > 1:  # a block's result is written before the next block's passes are merged
        parts = [materialize(p, "search") for p in parts]
    return reduce(DataFrame.unionByName, parts)
