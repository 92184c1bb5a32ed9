"""Near-duplicate embeddings by spherical k-means cells.

Centres are fitted on a bounded sample.  Every distinct vector goes to the
cells of its nearest centres, as many as a threshold pair needs to share one
with the wanted probability, measured on vectors that the centres were not
fitted on; inside a cell, blocks of vectors are compared by
matrix products in double precision.  Only link counts and a spanning forest
of the links leave a work unit; a large cell is split into pairs of blocks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.llm.common import Forest, connected_components, free_name
from flowlens.operators._small import materialize

THRESHOLD = 0.9
#: Share of the pairs at exactly the threshold that must share a cell.
RECALL = 0.98
#: Numbers in the sample that the centres are fitted on; vectors per cell;
#: cells at most; vectors that the cells of one vector are chosen by.
SAMPLE_VALUES, PER_CELL, MAX_CELLS, PROBED = 2_000_000, 512, 4096, 4000
ROUNDS = 10
#: Rows of a block.
BLOCK = 1024
_TILE = 1024


def unit_rows(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length one in double precision, safe from overflow."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def spherical_kmeans(x: np.ndarray, k: int, seed: int = 3) -> np.ndarray:
    """k unit centres of unit rows."""
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), k, replace=False)]
    for _ in range(ROUNDS):
        own = np.argmax(x @ centres.T, 1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        size = np.sqrt((sums * sums).sum(1, keepdims=True))
        lost = size[:, 0] < 1e-12
        sums[lost] = x[rng.choice(len(x), int(lost.sum()))]  # an empty cell starts anew
        size[lost] = 1.0
        centres = sums / size
    return centres


def nearest(x: np.ndarray, centres: np.ndarray, probes: int) -> np.ndarray:
    """The cells of each row, nearest first."""
    near = x @ centres.T
    probes = min(probes, len(centres))
    part = np.argpartition(-near, probes - 1, axis=1)[:, :probes]
    return np.take_along_axis(part, np.argsort(-np.take_along_axis(near, part, 1), axis=1, kind="stable"), 1)


def choose_probes(x: np.ndarray, centres: np.ndarray, threshold: float, recall: float, seed: int = 5) -> int:
    """Fewest cells a vector so that a partner at exactly the threshold shares
    one with the wanted probability; all cells without a vector to try.

    ``x`` are vectors that the centres were not fitted on.  The partner lies in
    a random direction, or in that of another vector (of the space the vectors
    fill); both kinds must reach the probability."""
    if not len(x):
        return len(centres)
    rng = np.random.default_rng(seed)
    probes = 1
    for aside in (rng.standard_normal(x.shape), x[rng.permutation(len(x))]):
        aside = aside - (aside * x).sum(1, keepdims=True) * x
        length = np.sqrt((aside * aside).sum(1, keepdims=True))
        partner = threshold * x + np.sqrt(1 - threshold ** 2) * aside / np.where(length > 1e-9, length, np.inf)
        needed = np.sort(np.concatenate([
            np.maximum(*(_ranks(v[lo:lo + _TILE] @ centres.T) for v in (x, partner))).min(1)
            for lo in range(0, len(x), _TILE)])) + 1
        probes = max(probes, int(needed[max(0, int(np.ceil(recall * len(x))) - 1)]))
    return probes


def _ranks(near: np.ndarray) -> np.ndarray:
    """Place of every cell in its row, the nearest 0."""
    order = np.argsort(-near, axis=1, kind="stable").astype(np.int32)
    out = np.empty_like(order)
    np.put_along_axis(out, order, np.arange(near.shape[1], dtype=np.int32)[None, :], 1)
    return out


def _rows(vectors: pa.ListArray, dim: int) -> np.ndarray:
    return vectors.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _identify(schema):
    """(id, vector) -> (id, node, dim, vector): node is the digest of a vector
    that can have a cosine, null for others."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, dims, vectors = [], [], []
            for v in batch.column(1):
                own = None
                if v.is_valid and not v.values.null_count and len(v.values):
                    own = v.values.to_numpy(zero_copy_only=False).astype(np.float64) + 0.0  # -0.0 becomes 0.0
                    if not np.isfinite(own).all() or not own.any():
                        own = None
                nodes.append(None if own is None else hashlib.blake2b(own.tobytes(), digest_size=16).digest())
                dims.append(None if own is None else len(own))
                vectors.append(own)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(nodes, pa.binary()), pa.array(dims, pa.int32()),
                 pa.array(vectors, pa.list_(pa.float64()))], names=schema.fieldNames())
    return run


def _assign(model, schema):
    """A row for every cell of a vector.  Vectors of another length than the
    fitted one share the cell -length."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        main, centres, probes = model.value
        for batch in batches:
            dim = batch.column(1).to_numpy()
            cells = [[-int(d)] for d in dim]
            fitted = np.flatnonzero(dim == main)
            for lo in range(0, len(fitted), _TILE):
                at = fitted[lo:lo + _TILE]
                x = unit_rows(_rows(batch.column(2).take(pa.array(at)), main))
                for i, own in zip(at, nearest(x, centres, probes).tolist(), strict=True):
                    cells[i] = own
            times = pa.array(np.repeat(np.arange(len(cells)), [len(c) for c in cells]))
            rows = batch.take(times)
            held = pa.array([sorted(c) for c in cells], pa.list_(pa.int32())).take(times)
            yield pa.RecordBatch.from_arrays(
                [*rows.columns, pa.array([c for own in cells for c in own], pa.int32()), held],
                names=schema.fieldNames())
    return run


def _verify(threshold: float):
    def run(unit: pa.Table) -> pa.Table:
        unit = unit.sort_by("node").combine_chunks()
        node, copies = unit.column("node").combine_chunks(), unit.column("copies").to_numpy()
        n = len(node)
        links, forest = np.zeros(n, np.int64), Forest(n)
        if n:
            cell, low, high = (unit.column(c)[0].as_py() for c in ("cell", "low", "high"))
            x = unit_rows(_rows(unit.column("vector").combine_chunks(), unit.column("dim")[0].as_py()))
            held = unit.column("cells").combine_chunks()
            width = int(pc.max(pc.list_value_length(held)).as_py())
            cells = _rows(held, width)
            block = unit.column("block").to_numpy()
            left, right = np.flatnonzero(block == low), np.flatnonzero(block == high)
            for a in range(0, len(left), _TILE):
                for b in range(a if low == high else 0, len(right), _TILE):
                    rows, columns = left[a:a + _TILE], right[b:b + _TILE]
                    linked = x[rows] @ x[columns].T >= threshold
                    if low == high and a == b:
                        linked = np.triu(linked, 1)
                    i, j = np.nonzero(linked)
                    i, j = rows[i], columns[j]
                    # a pair that shares several cells counts in the first
                    fresh = np.ones(len(i), bool)
                    step = max(1, (1 << 24) // width ** 2)
                    for at in range(0, len(i), step):
                        p, q = cells[i[at:at + step]], cells[j[at:at + step]]
                        common = (p[:, :, None] == q[:, None, :]) & (p < cell)[:, :, None]
                        fresh[at:at + step] = ~common.any((1, 2))
                    np.add.at(links, i[fresh], copies[j[fresh]])
                    np.add.at(links, j[fresh], copies[i[fresh]])
                    forest.join(i[fresh], j[fresh])
        return pa.table({"node": node, "links": pa.array(links, pa.int64()),
                         "tied": node.take(pa.array(forest.parent))})
    return run


def embedding_dedup(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
                    threshold: float = THRESHOLD, recall: float = RECALL) -> tuple[DataFrame, dict]:
    """Vectors with their near-duplicate groups.

    Returns (id, n_links, component_id, kept) and the names of the last three:
    ``n_links`` counts the other rows with a cosine of ``threshold`` or more,
    ``component_id`` is the smallest id reachable by links, and ``kept`` marks
    the row that has it.

    Null, empty and zero vectors, and those with null or non-finite components,
    link with nothing; vectors of different lengths don't link.  Equal vectors
    are one node and link with each other, repeated rows too; each row gets a
    row.  A null id is never the smallest.  An empty table gives an empty table.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    schema = rows.select("id").withColumn("node", F.lit(None).cast("binary")) \
        .withColumn("dim", F.lit(None).cast("int")).withColumn("vector", F.lit(None).cast("array<double>")).schema
    named = materialize(rows.mapInArrow(_identify(schema), schema), "vectors")
    nodes = materialize(named.where("node IS NOT NULL").groupBy("node").agg(
        F.first("dim").alias("dim"), F.first("vector").alias("vector"), F.count(F.lit(1)).alias("copies"),
        F.min("id").alias("least")), "vector-nodes")

    dims = nodes.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "dim").limit(1).collect()
    main, n = (dims[0]["dim"], dims[0]["n"]) if dims else (0, 0)
    centres, probes = np.zeros((0, main)), 1
    if n:
        # two disjoint samples: one fits the centres, the other chooses the probes
        fitted, tried = (int((1 << 30) * min(0.5, size / n)) for size in (SAMPLE_VALUES / main, PROBED))
        place = F.pmod(F.xxhash64("node"), F.lit(1 << 30))
        sample = nodes.where(F.col("dim") == main).select("node", "vector", place.alias("place")).where(
            (F.col("place") < fitted) | (F.col("place") >= (1 << 30) - tried)).toArrow().sort_by("node")
        x = unit_rows(_rows(sample["vector"].combine_chunks(), main)) if len(sample) else np.zeros((0, main))
        fit = sample["place"].to_numpy() < fitted
        centres = spherical_kmeans(x[fit], int(max(1, min(n // PER_CELL, MAX_CELLS, fit.sum() // 8)))) \
            if fit.any() else np.eye(1, main)
        probes = choose_probes(x[~fit], centres, threshold, recall)
        if probes ** 2 >= len(centres):  # one cell of all vectors compares no more pairs
            centres, probes = centres[:1], 1
    model = spark.sparkContext.broadcast((main, centres, probes))

    assigned = nodes.select("node", "dim", "vector", "copies")
    schema = assigned.withColumn("cell", F.lit(0)).withColumn("cells", F.array().cast("array<int>")).schema
    assigned = assigned.mapInArrow(_assign(model, schema), schema)
    sizes = materialize(assigned.select("cell").groupBy("cell").agg(
        F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks")), "cells")
    placed = assigned.join(F.broadcast(sizes), "cell").withColumn(
        "block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")) \
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    units = placed.select("node", "dim", "vector", "copies", "cell", "cells", "block",
                          F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))
    verified = materialize(units.groupBy("cell", "low", "high").applyInArrow(
        _verify(threshold), "node binary, links bigint, tied binary"), "vector-links")
    linked = verified.groupBy("node").agg(F.sum("links").alias("links"))
    classes = connected_components(verified, "node", "tied", "binary")
    least = classes.join(nodes, "node").groupBy("root").agg(F.min("least").alias("component"))
    grouped = classes.join(least, "root").select("node", "component")
    info = materialize(nodes.join(linked, "node", "left").join(grouped, "node", "left").select(
        F.col("node").alias("of"), F.coalesce("component", "least").alias("component"),
        (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("links")), "vector-info")
    out = named.select("id", "node").join(info.hint("merge"), F.col("node") == F.col("of"), "left")
    names = {k: free_name(vectors.select(id_col), k) for k in ("n_links", "component_id", "kept")}
    component = F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component"))
    return out.select(
        F.col("id").alias(id_col), F.coalesce("links", F.lit(0).cast("bigint")).alias(names["n_links"]),
        component.alias(names["component_id"]), F.col("id").eqNullSafe(component).alias(names["kept"])), names
