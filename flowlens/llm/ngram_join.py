"""N-gram Jaccard self-join by MinHash banding.

1. One pass gives every text the fingerprint of its shingle set and one hash
   per band.  Equal sets become one node with a multiplicity.
2. Band hashes are shuffled; the members of a bucket are tied to its smallest
   node, so a bucket of n nodes makes n - 1 edges and no pairs.  The connected
   components of these edges hold every pair that shares a bucket.
3. Each component's full shingle sets meet in one work unit; a large component
   is split into blocks, and every pair of blocks is a unit.  Inside a unit all
   pairs are verified exactly, and only link counts and a spanning forest of
   the links leave it.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.llm.common import (
    ALNUM, Forest, Words, connected_components, free_name, lists, mix64, slices, text_column, word_hashes,
)
from flowlens.operators._small import materialize

SHINGLE = 5
THRESHOLD = 0.8
#: Share of the pairs at exactly the threshold that must meet in some band.
RECALL = 0.9999
MAX_HASHES = 200
#: Shingles in one block of a component: at least, and at most; between them a
#: component has MAX_BLOCKS blocks.
BLOCK_LEAST, BLOCK_MOST, MAX_BLOCKS = 1 << 16, 1 << 22, 64
_TILE, _COLUMNS = 512, 4096


def choose_bands(threshold: float, recall: float, max_hashes: int) -> tuple[int, int]:
    """(bands, rows): the most rows a band, and so the fewest chance meetings,
    that reach the recall at the threshold within the hash budget."""
    best = (max_hashes, 1)
    for rows in range(1, max_hashes + 1):
        bands = max(1, math.ceil(math.log(1 - recall) / math.log1p(-threshold ** rows)))
        if bands * rows > max_hashes:
            break
        best = (bands, rows)
    return best


class Shingles:
    """Distinct shingle hashes of a slice of texts; text i owns
    ``values[first[i]:first[i + 1]]``, sorted.  A text of fewer words than a
    shingle, but not none, has one shingle of all its words."""

    def __init__(self, texts: pa.StringArray, width: int) -> None:
        words = Words(texts, ALNUM)
        code = word_hashes(words.words)
        count = words.per_text()
        n = len(code)
        value = np.zeros(n, np.uint64)
        text = np.repeat(np.arange(len(count)), count)
        ahead = words.first[1:][text] - np.arange(n)  # words left in the text, this one included
        for j in range(width):
            part = np.zeros(n, np.uint64)
            part[:n - j] = code[j:]
            inside = ahead > j
            value[inside] = mix64(value[inside] * np.uint64(0x9E3779B97F4A7C15) + part[inside] + np.uint64(j + 1))
        at_start = np.zeros(n, bool)
        at_start[words.first[:-1][count > 0]] = True
        valid = (ahead >= width) | at_start
        value, text = value[valid], text[valid]
        order = np.lexsort((value, text))
        value, text = value[order], text[order]
        new = np.ones(len(value), bool)
        new[1:] = (value[1:] != value[:-1]) | (text[1:] != text[:-1])
        self.values = value[new]
        self.first = np.searchsorted(text[new], np.arange(len(count) + 1))

    def of(self, i: int) -> np.ndarray:
        return self.values[self.first[i]:self.first[i + 1]]

    def fingerprints(self) -> list[bytes | None]:
        """128-bit digest of each distinct shingle set; None for no shingle."""
        return [hashlib.blake2b(self.of(i).tobytes(), digest_size=16).digest() if self.first[i] < self.first[i + 1]
                else None for i in range(len(self.first) - 1)]

    def band_hashes(self, bands: int, rows: int) -> np.ndarray:
        """One 64-bit hash per text and band over the band's MinHash values."""
        full = np.flatnonzero(np.diff(self.first) > 0)
        rng = np.random.default_rng(20_011)
        keys = rng.integers(0, 1 << 63, size=(bands * rows, 2), dtype=np.uint64)
        keys[:, 0] |= np.uint64(1)
        out = np.zeros((len(full), bands), np.uint64)
        for lo, hi in self._runs(full):
            part = full[lo:hi]
            values = self.values[self.first[part[0]]:self.first[part[-1] + 1]]
            starts = self.first[part] - self.first[part[0]]
            for b in range(bands):
                acc = np.full(hi - lo, b + 1, np.uint64)
                for a, c in keys[b * rows:(b + 1) * rows]:
                    acc = mix64(acc * np.uint64(0x9E3779B97F4A7C15) + np.minimum.reduceat(values * a + c, starts))
                out[lo:hi, b] = acc
        return out

    def _runs(self, full: np.ndarray, budget: int = 1 << 15) -> Iterator[tuple[int, int]]:
        """Ranges of ``full`` with few enough shingles to stay in the CPU cache."""
        ends = self.first[full + 1]
        lo = 0
        while lo < len(full):
            hi = max(lo + 1, int(np.searchsorted(ends, self.first[full[lo]] + budget, side="right")))
            yield lo, hi
            lo = hi


def _sketch(text_col: str, kept: list[str], bands: int, rows: int, width: int, schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = text_column(batch, text_col)
            for lo, hi in slices(texts):
                shingles = Shingles(texts.slice(lo, hi - lo), width)
                hashes = shingles.band_hashes(bands, rows).view(np.int64)
                size = np.diff(shingles.first)
                at = np.concatenate([[0], np.cumsum(np.where(size > 0, bands, 0))])
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(part.schema.get_field_index(k)) for k in kept),
                     pa.array(shingles.fingerprints(), pa.binary()), pa.array(size, pa.int64()),
                     lists(hashes.ravel(), at, pa.int64())], names=schema.fieldNames())
    return run


def _sets(width: int, schema):
    """(node, ..., text) -> (node, ..., shingle set)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = text_column(batch, "body")
            for lo, hi in slices(texts, 1 << 20):
                shingles = Shingles(texts.slice(lo, hi - lo), width)
                part = batch.slice(lo, hi - lo)
                columns = [lists(shingles.values.view(np.int64), shingles.first, pa.int64()) if f.name == "body"
                           else c for f, c in zip(part.schema, part.columns, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names=schema.fieldNames())
    return run


class Links:
    """Exact links among the sets of one component in a work unit."""

    def __init__(self, values: np.ndarray, first: np.ndarray, weight: np.ndarray, threshold: float) -> None:
        n = len(first) - 1
        self.size, self.weight, self.threshold = np.diff(first), weight, threshold
        owner = np.repeat(np.arange(n), self.size)
        order = np.argsort(values, kind="stable")
        values, owner = values[order], owner[order]
        new = np.ones(len(values), bool)
        new[1:] = values[1:] != values[:-1]
        column = np.cumsum(new) - 1
        shared = np.bincount(column)[column] > 1  # a shingle of one set meets no other
        _, column = np.unique(column[shared], return_inverse=True)
        owner = owner[shared]
        order = np.lexsort((column, owner))
        self.column, owner = column[order], owner[order]
        self.n_columns = int(column.max()) + 1 if len(column) else 0
        self.first = np.searchsorted(owner, np.arange(n + 1))
        self.links = np.zeros(n, np.int64)
        self.forest = Forest(n)

    def _dense(self, rows: np.ndarray, lo: int, hi: int) -> np.ndarray:
        grid = np.zeros((len(rows), hi - lo), np.float32)
        for i, r in enumerate(rows):
            own = self.column[self.first[r]:self.first[r + 1]]
            a, b = np.searchsorted(own, (lo, hi))
            grid[i, own[a:b] - lo] = 1
        return grid

    def tile(self, left: np.ndarray, right: np.ndarray, same: bool) -> None:
        """Verify all pairs of two row lists (each pair once if they are the same list)."""
        common = np.zeros((len(left), len(right)), np.float64)
        for lo in range(0, self.n_columns, _COLUMNS):
            hi = min(lo + _COLUMNS, self.n_columns)
            a = self._dense(left, lo, hi)
            common += a @ (a if same else self._dense(right, lo, hi)).T
        union = self.size[left][:, None] + self.size[right][None, :] - common
        linked = common / union >= self.threshold
        if same:
            linked = np.triu(linked, 1)
        i, j = np.nonzero(linked)
        i, j = left[i], right[j]
        np.add.at(self.links, i, self.weight[j])
        np.add.at(self.links, j, self.weight[i])
        self.forest.join(i, j)

    def all_pairs(self, left: np.ndarray, right: np.ndarray, same: bool) -> None:
        for x in range(0, len(left), _TILE):
            for y in range(x if same else 0, len(right), _TILE):
                self.tile(left[x:x + _TILE], right[y:y + _TILE], same and x == y)


def _verify(threshold: float):
    def run(unit: pa.Table) -> pa.Table:
        unit = unit.sort_by([("root", "ascending"), ("node", "ascending")]).combine_chunks()
        root = unit.column("root").combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
        node = unit.column("node").combine_chunks()
        sets = unit.column("body").combine_chunks()
        at = sets.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
        values = sets.values.to_numpy(zero_copy_only=False)
        weight = unit.column("copies").to_numpy()
        block, low, high = (unit.column(c).to_numpy() for c in ("block", "low", "high"))
        links, parent = np.zeros(len(node), np.int64), np.arange(len(node))
        bounds = np.flatnonzero(np.concatenate([[True], root[1:] != root[:-1], [True]])) if len(root) else []
        for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
            found = Links(values[at[lo]:at[hi]], at[lo:hi + 1] - at[lo], weight[lo:hi], threshold)
            if low[lo] == high[lo]:
                found.all_pairs(np.arange(hi - lo), np.arange(hi - lo), True)
            else:
                mine = block[lo:hi]
                found.all_pairs(np.flatnonzero(mine == low[lo]), np.flatnonzero(mine == high[lo]), False)
            links[lo:hi], parent[lo:hi] = found.links, found.forest.parent + lo
        return pa.table({"node": node, "links": pa.array(links, pa.int64()), "tied": node.take(pa.array(parent))})
    return run


def classify(docs: DataFrame, id_col: str, text_col: str, threshold: float, recall: float, width: int) -> DataFrame:
    """(id, body_hash, node, root, class, links) of every row; root names the
    class by one of its nodes and is null, as node is, for a text without a word."""
    bands, rows = choose_bands(threshold, recall, MAX_HASHES)
    row = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("body_hash"),
                      F.col(text_col).cast("string").alias("body"))
    schema = row.limit(0).select("id", "body_hash").withColumn("node", F.lit(None).cast("binary")) \
        .withColumn("size", F.lit(0).cast("bigint")).withColumn("bands", F.array().cast("array<bigint>")).schema
    sketch = materialize(row.mapInArrow(_sketch("body", ["id", "body_hash"], bands, rows, width, schema), schema),
                         "sketch")
    known = sketch.where("node IS NOT NULL")
    nodes = materialize(known.groupBy("node").agg(
        F.count(F.lit(1)).alias("copies"), F.min("id").alias("least"), F.first("size").alias("size"),
        F.min(F.struct("id", "body_hash")).alias("one")), "nodes")

    banded = known.select("node", F.explode("bands").alias("band"))
    heads = banded.groupBy("band").agg(F.min("node").alias("head"), F.max("node").alias("tail")) \
        .where("head <> tail").select("band", "head")
    # merge hints: one plan at every size, whose large keys the adaptive join splits
    edges = banded.join(heads.hint("merge"), "band").where("node <> head").select("node", "head").distinct()
    candidates = connected_components(edges, "node", "head", "binary")

    members = candidates.join(nodes, "node").select("node", "root", "copies", "size", "one.id", "one.body_hash")
    members = materialize(members, "members")
    weight = members.groupBy("root").agg(F.sum("size").alias("total"))
    cap = F.greatest(F.lit(BLOCK_LEAST), F.least(F.lit(BLOCK_MOST), F.col("total") / MAX_BLOCKS))
    weight = weight.withColumn("blocks", F.ceil(F.col("total") / cap).cast("int"))
    all_shingles = members.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    bins = max(1, all_shingles // BLOCK_LEAST)

    bodies = row.join(members.withColumnRenamed("id", "own_id").withColumnRenamed("body_hash", "own_hash").hint("merge"),
                      F.expr("id <=> own_id AND body_hash <=> own_hash")) \
        .select("node", "root", "copies", "body").dropDuplicates(["node"])
    body_schema = bodies.limit(0).withColumn("body", F.array().cast("array<bigint>")).schema
    sets = bodies.mapInArrow(_sets(width, body_schema), body_schema)
    placed = sets.join(weight, "root").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    alone = F.col("blocks") == 1
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    units = placed.select(
        "node", "root", "copies", "body", "block",
        F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"),
        F.when(alone, F.pmod(F.xxhash64("root"), F.lit(bins))).otherwise(F.xxhash64("root")).alias("bin"))
    verified = materialize(
        units.groupBy("bin", "low", "high").applyInArrow(_verify(threshold), "node binary, links bigint, tied binary"),
        "verified")
    linked = verified.groupBy("node").agg(F.sum("links").alias("links"))
    classes = connected_components(verified, "node", "tied", "binary")

    least = classes.join(nodes, "node").groupBy("root").agg(F.min("least").alias("class"))
    grouped = classes.join(least, "root").select("node", "root", "class")
    info = nodes.join(linked, "node", "left").join(grouped, "node", "left").select(
        F.col("node").alias("of"), F.coalesce("root", "node").alias("root"), F.coalesce("class", "least").alias("class"),
        (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("links"))
    info = materialize(info, "info")  # a plain exchange on both sides: the adaptive join can split a hot node
    out = sketch.select("id", "body_hash", "node").join(info.hint("merge"), F.col("node") == F.col("of"), "left")
    return out.select("id", "body_hash", "node", "root",
                      F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("class")).alias("class"),
                      F.coalesce("links", F.lit(0).cast("bigint")).alias("links"))


def ngram_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD,
               recall: float = RECALL, width: int = SHINGLE) -> tuple[DataFrame, dict]:
    """Documents with the Jaccard links of their word shingles.

    Returns (id, class, links, node) and the names of the last three: the
    class is the smallest id reachable by links, ``links`` the number of other
    rows whose shingle set has a Jaccard similarity of ``threshold`` or more,
    ``node`` the fingerprint of the shingle set.

    Words are as in decontamination, in lower case.  Rows with equal shingle
    sets are linked.  A text without a word (null and empty ones too) links
    with nothing: 0 links, its own id as class, null node.  Null ids are kept
    and never the smallest.  Repeated rows link with each other and each get a
    row.  An empty table gives an empty table.
    """
    out = classify(docs, id_col, text_col, threshold, recall, width)
    names = {k: free_name(docs.select(id_col), k) for k in ("class", "links", "node")}
    return out.select(F.col("id").alias(id_col), *(F.col(k).alias(n) for k, n in names.items())), names


def keep_one_per_class(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD,
                       recall: float = RECALL, width: int = SHINGLE) -> DataFrame:
    """One document of every class of linked texts: that with the smallest id,
    nulls last, then the smallest text hash; of rows equal in both, any one.
    Texts without a word all stay.  Columns are unchanged."""
    rows = materialize(classify(docs, id_col, text_col, threshold, recall, width), "classes")
    first = rows.where("root IS NOT NULL").groupBy("root").agg(
        F.min(F.struct(F.col("id").isNull().alias("last"), "id", "body_hash")).alias("one"))
    wordless = rows.where("root IS NULL").select("id", "body_hash").distinct()
    names = [free_name(docs, c) for c in ("kept_id", "kept_hash", "kept_one")]
    kept = first.select("one.id", "one.body_hash", F.lit(True).alias("one")).unionByName(
        wordless.withColumn("one", F.lit(False))).toDF(*names)
    own, body_hash, one = names
    # rows equal in id and text meet the same kept row; only such rows are dealt out and reduced to one
    many = rows.where("root IS NOT NULL").groupBy("id", "body_hash").count().where("count > 1") \
        .select(F.col("id").alias("m_id"), F.col("body_hash").alias("m_hash"))
    kept = kept.join(many, F.col(own).eqNullSafe(F.col("m_id")) & F.col(body_hash).eqNullSafe(F.col("m_hash"))
                     & F.col(one), "left").withColumn(one, F.col("m_hash").isNotNull()).drop("m_id", "m_hash")
    found = docs.join(kept.hint("merge"), F.col(id_col).eqNullSafe(F.col(own))
                      & F.xxhash64(F.col(text_col)).eqNullSafe(F.col(body_hash)))
    single = found.where(~F.col(one)).select(*docs.columns)
    repeated = found.where(F.col(one)).dropDuplicates([own, body_hash]).select(*docs.columns)
    return single.unionByName(repeated)
