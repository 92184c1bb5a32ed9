"""Shared helpers: unused column names, bounded text slices, word splitting on
Arrow buffers, keyed folds and distributed connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.operators._small import materialize

#: Text held by one numpy work unit; a single longer text is a unit alone.
SLICE_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, base: str) -> str:
    """``base``, or ``base`` with underscores appended until no column has it
    (Spark resolves names without regard to case)."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def text_column(batch: pa.RecordBatch, name: str) -> pa.StringArray:
    """The named column as a string array without nulls (null reads as empty)."""
    texts = batch.column(batch.schema.get_field_index(name))
    if texts.type != pa.string():
        texts = texts.cast(pa.string())
    return pc.fill_null(texts, "") if texts.null_count else texts


def slices(texts: pa.StringArray, budget: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive row ranges [lo, hi) whose texts hold at most ``budget`` bytes."""
    size = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    lo, done, n = 0, 0, len(size)
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(size, done + budget, side="right")))
        yield lo, hi
        lo, done = hi, int(size[hi - 1])


def raw_bytes(texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts together, n + 1 byte offsets of the texts in them)."""
    n = len(texts)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, np.int32)[texts.offset:texts.offset + n + 1].astype(np.int64)
    body = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return body[ends[0]:ends[-1]], ends - ends[0]


_UPPER = np.arange(256, dtype=np.uint8)
_UPPER[ord("A"):ord("Z") + 1] += 32


def byte_set(*ranges: tuple[int, int]) -> np.ndarray:
    """Membership table of the bytes in the closed ranges."""
    found = np.zeros(256, bool)
    for lo, hi in ranges:
        found[lo:hi + 1] = True
    return found


#: Word bytes: digits, letters after lower-casing, and every non-ASCII byte.
ALNUM = byte_set((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))
#: Everything but ASCII white space.
NON_SPACE = ~byte_set((0x09, 0x0D), (0x20, 0x20))


class Words:
    """The words of a slice of texts.

    ``words`` is an Arrow string array over all texts; text i owns words
    ``first[i]:first[i + 1]``; ``start``/``end`` are byte offsets in the slice.
    """

    def __init__(self, texts: pa.StringArray, kept: np.ndarray, lower: bool = True) -> None:
        body, at = raw_bytes(texts)
        if lower:
            body = _UPPER[body]
        inside = kept[body]
        opens = inside.copy()
        closes = inside.copy()
        if len(body):
            opens[1:] &= ~inside[:-1]
            closes[:-1] &= ~inside[1:]
            edges = at[1:-1]
            edges = edges[(edges > 0) & (edges < len(body))]  # a word ends with its text
            opens[edges] = inside[edges]
            closes[edges - 1] = inside[edges - 1]
        self.start = np.flatnonzero(opens)
        self.end = np.flatnonzero(closes) + 1
        self.first = np.searchsorted(self.start, at)
        self.offsets = at
        ends = np.zeros(len(self.start) + 1, np.int32)
        np.cumsum(self.end - self.start, out=ends[1:])
        self.words = pa.StringArray.from_buffers(
            len(self.start), pa.py_buffer(ends), pa.py_buffer(body[inside]))

    def per_text(self) -> np.ndarray:
        return np.diff(self.first)


def sum_ranges(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of ``values[first[i]:first[i + 1]]`` along axis 0; empty ranges give 0."""
    shape = (len(first) - 1, *values.shape[1:])
    out = np.zeros(shape, values.dtype if values.dtype.kind == "f" else np.int64)
    full = np.flatnonzero(np.diff(first) > 0)
    if len(full):
        out[full] = np.add.reduceat(values, first[full], axis=0, dtype=out.dtype)
    return out


def lists(values: list, first: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """Arrow lists ``values[first[i]:first[i + 1]]``."""
    return pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(values, kind))


def connected_components(edges: DataFrame, a: str, b: str, kind: str = "long") -> DataFrame:
    """(node, root) of every node of the edge table; root is the smallest node
    reachable.  Nodes without an edge don't appear.

    Alternating large-star and small-star steps: every step is a grouped
    minimum (combined before the shuffle) and an equi-join on the node, whose
    large keys the adaptive skew join splits (the minima are written first, as
    it splits plain exchanges only).  The edge table of each round is written
    to the shared folder, so lineage stays short.
    """
    both = edges.select(F.col(a).cast(kind).alias("u"), F.col(b).cast(kind).alias("v"))
    step = materialize(both.where("u <> v").select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc")

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    state = mark(step)
    while state[0]:
        around = step.unionByName(step.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialize(around.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "cc")
        step = around.join(least.hint("merge"), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        step = materialize(step, "cc")
        least = materialize(step.groupBy("u").agg(F.min("v").alias("m")), "cc")
        linked = step.join(least.hint("merge"), "u")
        step = linked.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            least.select("u", F.col("m").alias("v"))).distinct()
        step = materialize(step, "cc")
        before, state = state, mark(step)
        if state == before:
            break
    roots = step.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("root"))
    return step.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root")).unionByName(roots)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalizer of a 64-bit mixing generator (public splitmix64 constants)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(words: pa.StringArray) -> np.ndarray:
    """A 64-bit keyed hash of every word, the same in every task; each distinct
    word of the slice is hashed once."""
    import pandas as pd

    coded = words.dictionary_encode()
    distinct = pd.util.hash_array(np.array(coded.dictionary.to_pylist(), dtype=object), categorize=False)
    return distinct[coded.indices.to_numpy(zero_copy_only=False)] if len(words) else np.zeros(0, np.uint64)


class Forest:
    """Union-find over array positions; every tree hangs on its least position."""

    def __init__(self, n: int) -> None:
        self.parent = np.arange(n)

    def join(self, i: np.ndarray, j: np.ndarray) -> None:
        """Unite the trees of i[k] and j[k] for all k."""
        parent = self.parent
        while True:
            a, b = parent[i], parent[j]
            apart = a != b
            if not apart.any():
                return
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
            while True:
                up = parent[parent]
                if (up == parent).all():
                    break
                parent[:] = up
