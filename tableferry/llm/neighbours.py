"""Near-duplicate embeddings by counting collisions of sorted one-dimensional projections.

Vectors of unit length are projected on ``PROJECTIONS`` fixed directions. Two vectors with
a cosine of at least ``SIMILARITY`` differ by at most ``sqrt(2 - 2 * SIMILARITY)``, and on
one direction by that over ``sqrt(d)``, as a standard deviation. Every projection is
sorted; around each vector, as a query, a window of ``WINDOW`` such deviations to both
sides holds its collisions. Pairs with as many collisions as a pair at the threshold has
with probability ``RECALL`` are verified by their cosine.

Vectors are compared only where they can be near: large groups are cut into cells by
ranges of up to three projections. A cell is as wide as two vectors at the threshold can
lie apart at all, so that near vectors lie in the same cell or in neighbouring ones: cells
lose no pair, and what is found does not depend on a group's size. Cells are cut into blocks by hash, and a task takes
one pair of blocks; every pair of vectors meets in one task only. It gives back how many
links each vector has and a spanning forest of the links, so that rows grow with the
vectors, not with the pairs.
"""

from __future__ import annotations

import math
from functools import lru_cache
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tableferry.llm.common import broadcast_if_small, components, stored

SIMILARITY = 0.98
PROJECTIONS, WINDOW, RECALL = 32, 1.5, 0.999
#: Vectors of a group from which one, two and three projections cut it.
LEVELS = (4_096, 40_960, 409_600)
#: Vectors of a block.
BLOCK = 2_048
SEED = 42
#: Rows that are broadcast, at most; more are joined by a shuffle.
BROADCAST_ROWS = 100_000

_CELLS = ["c0", "c1", "c2"]


def deviation(dim: int, similarity: float) -> float:
    """Standard deviation, on one direction, of the difference of two unit vectors at the threshold."""
    return math.sqrt(max(0.0, 2 - 2 * similarity) / dim)


def cell_width(similarity: float) -> float:
    """How far apart two unit vectors at the threshold can be, and so their values on any direction."""
    return math.sqrt(max(0.0, 2 - 2 * similarity)) * (1 + 1e-9) + 1e-9


@lru_cache(maxsize=8)
def directions(dim: int) -> np.ndarray:
    """Unit directions, fixed for a number of dimensions; at right angles while there are enough dimensions."""
    drawn = np.random.default_rng(SEED + dim).standard_normal((PROJECTIONS, dim))
    if dim >= PROJECTIONS:
        return np.linalg.qr(drawn.T)[0].T
    return drawn / np.linalg.norm(drawn, axis=1, keepdims=True)


@lru_cache(maxsize=1)
def collisions_needed() -> int:
    """The most collisions that a pair at the threshold reaches with probability ``RECALL``."""
    p = math.erf(WINDOW / math.sqrt(2))
    missed, k = 0.0, 0
    while missed + (one := math.comb(PROJECTIONS, k) * p**k * (1 - p) ** (PROJECTIONS - k)) <= 1 - RECALL:
        missed, k = missed + one, k + 1
    return k


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to length one; first by their largest component, so that no square overflows."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def collision_counts(x: np.ndarray, y: np.ndarray, half: float) -> np.ndarray:
    """For each row of ``x`` and ``y`` (projections by column), in how many windows around x's value y's lies."""
    counts = np.zeros((len(x), len(y)), dtype=np.uint8)
    for k in range(x.shape[1]):
        order = np.argsort(y[:, k], kind="stable")
        line = y[order, k]
        low = np.searchsorted(line, x[:, k] - half, side="left").tolist()
        high = np.searchsorted(line, x[:, k] + half, side="right").tolist()
        for row, start, stop in zip(counts, low, high, strict=True):
            row[order[start:stop]] += 1
    return counts


def compare_blocks(key, found: pa.Table, similarity: float) -> pa.Table:
    """Rows (a, NULL, links of a) and (a, b, NULL) for the edges of a spanning forest."""
    side = found.column("side").to_numpy()
    ids, weights = found.column("cid").to_numpy(), found.column("n").to_numpy()
    vectors = unit(_matrix(found.column("vec")))
    dim = vectors.shape[1]
    lines = vectors @ directions(dim).T
    half = WINDOW * deviation(dim, similarity) + 1e-9
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    alone = not len(right)  # a block with itself
    if alone:
        right = left
    counts = collision_counts(lines[left], lines[right], half)
    links, root, needed = np.zeros(len(ids), dtype=np.int64), np.arange(len(ids)), collisions_needed()
    others = vectors[right]
    for i, row in enumerate(counts):
        near = np.flatnonzero(row >= needed)
        if alone:
            near = near[near > i]
        near = near[others[near] @ vectors[left[i]] >= similarity]
        if len(near):
            near, at = right[near], left[i]
            links[at] += weights[near].sum()
            links[near] += weights[at]
            roots = np.unique(np.append(root[near], root[at]))
            if len(roots) > 1:
                root[np.isin(root, roots)] = roots[0]
    linked, below = np.flatnonzero(links), np.flatnonzero(root != np.arange(len(ids)))
    a = np.concatenate([ids[linked], ids[root[below]]])
    b = pa.array(np.concatenate([np.zeros(len(linked), np.int64), ids[below]]), mask=np.arange(len(a)) < len(linked))
    n = np.concatenate([links[linked], np.zeros(len(below), np.int64)])
    return pa.Table.from_arrays([pa.array(a), b, pa.array(n)], ["a", "b", "n"])


def _usable(vec: Column) -> Column:
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return vec.isNotNull() & (F.size(vec) > 0) & F.forall(vec, finite) & F.exists(vec, lambda x: x != 0)


def _in_cells(groups: DataFrame, similarity: float) -> DataFrame:
    """``cid``, ``label``, ``dim``, ``n``, ``vec`` and the cell of each vector; unused projections give cell 0."""

    def batches(frames):
        for batch in frames:
            dims, levels = batch.column("dim").to_numpy(), batch.column("levels").to_numpy()
            cells = np.zeros((len(dims), len(_CELLS)), dtype=np.int64)
            for dim in np.unique(dims):
                rows = np.flatnonzero(dims == dim)
                lines = unit(_matrix(batch.column("vec").take(pa.array(rows)))) @ directions(int(dim))[: len(_CELLS)].T
                cells[rows] = np.floor(lines / cell_width(similarity))
            cells[np.arange(len(_CELLS))[None, :] >= levels[:, None]] = 0
            kept = ["cid", "label", "dim", "n", "vec"]
            columns = [*(batch.column(c) for c in kept), *(pa.array(cells[:, i]) for i in range(len(_CELLS)))]
            yield pa.RecordBatch.from_arrays(columns, [*kept, *_CELLS])

    fields = [groups.schema[c] for c in ("cid", "label", "dim", "n", "vec")]
    schema = T.StructType([*fields, *(T.StructField(c, T.LongType()) for c in _CELLS)])
    return groups.mapInArrow(batches, schema)


def _seats(sizes: DataFrame) -> DataFrame:
    """Pairs of blocks, numbered: for each block (cell and ``blk``) the pairs it is in, and on which side."""
    offsets = [o for o in product((-1, 0, 1), repeat=len(_CELLS)) if o >= (0,) * len(_CELLS)]
    stepped = sizes.withColumn("o", F.explode(F.array(*[F.struct(*[F.lit(v).alias(f"o{i}") for i, v in enumerate(o)]) for o in offsets])))
    own = stepped.select(
        "label", "dim", *_CELLS, F.col("blocks").alias("blocks_l"), *[(F.col(c) + F.col(f"o.o{i}")).alias(f"d{i}") for i, c in enumerate(_CELLS)],
    )
    there = sizes.select("label", "dim", *[F.col(c).alias(f"d{i}") for i, c in enumerate(_CELLS)], F.col("blocks").alias("blocks_r"))
    same = F.lit(True)
    for i, c in enumerate(_CELLS):
        same = same & (F.col(c) == F.col(f"d{i}"))
    upto = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    jobs = (
        own.join(there, ["label", "dim", "d0", "d1", "d2"])
        .withColumn("same", same)
        .withColumn("i", F.explode(upto("blocks_l")))
        .withColumn("j", F.explode(upto("blocks_r")))
        .where(~F.col("same") | (F.col("i") <= F.col("j")))
        .withColumn("job", F.monotonically_increasing_id())
    )
    jobs = stored(jobs, "jobs")
    left = jobs.select("label", "dim", *_CELLS, F.col("i").alias("blk"), "job", F.lit(0).alias("side"))
    right = jobs.where(~F.col("same") | (F.col("i") < F.col("j"))).select(
        "label", "dim", *[F.col(f"d{i}").alias(c) for i, c in enumerate(_CELLS)], F.col("j").alias("blk"), "job", F.lit(1).alias("side")
    )
    return left.unionByName(right)


def near_vectors(
    vectors: DataFrame, key: str = "vec_id", vec: str = "embedding", label: str = "label", similarity: float = SIMILARITY
) -> DataFrame:
    """``key``, ``n_links``, ``component_id`` and ``kept`` of every row.

    Rows are linked if their labels are equal and not NULL, their vectors have as many
    components, and the cosine is at least ``similarity``. Vectors that are NULL, empty or
    zero, or hold a NULL, infinite or not-a-number component, have no link. Equal vectors
    of a label are compared as one and linked with each other; repeated rows are vectors
    of their own. ``component_id`` is the smallest key that links reach, the own one
    included; NULL keys name a component only where all its keys are NULL, and are never
    ``kept``. An empty table gives no rows; other columns are not read.
    """
    kind = vectors.schema[vec].dataType.elementType
    values = F.col(f"`{vec}`") if isinstance(kind, (T.FloatType, T.DoubleType)) else F.col(f"`{vec}`").cast("array<double>")
    rows = vectors.select(F.col(f"`{key}`").alias("_key"), F.col(f"`{label}`").alias("label"), values.alias("vec"))
    usable = F.col("label").isNotNull() & _usable(F.col("vec"))
    rows = rows.withColumn("cid", F.when(usable, F.xxhash64("label", "vec")))
    members = stored(rows.select("_key", "cid"), "members")
    classes = rows.where("cid IS NOT NULL").groupBy("cid").agg(
        F.first("label").alias("label"), F.first("vec").alias("vec"), F.count(F.lit(1)).alias("n")
    )
    classes = stored(classes.withColumn("dim", F.size("vec")), "vectors")

    level = F.lit(0)
    for i, n in enumerate(LEVELS):
        level = F.when(F.col("_size") > n, F.lit(i + 1)).otherwise(level)
    spaces = stored(classes.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("_size")), "spaces")
    spaces = spaces.select("label", "dim", level.alias("levels"))
    grouped = classes.join(broadcast_if_small(spaces, spaces.count(), BROADCAST_ROWS), ["label", "dim"])
    placed = stored(_in_cells(grouped, similarity), "cells")

    sizes = placed.groupBy("label", "dim", *_CELLS).agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("long").alias("blocks"))
    sizes = stored(sizes, "sizes")
    small = broadcast_if_small(sizes, sizes.count(), BROADCAST_ROWS)
    blocked = placed.join(small, ["label", "dim", *_CELLS]).withColumn("blk", F.pmod(F.xxhash64("cid", F.lit("block")), "blocks"))
    seated = blocked.join(_seats(sizes), ["label", "dim", *_CELLS, "blk"]).select("job", "side", "cid", "n", "vec")
    found = stored(
        seated.groupBy("job").applyInArrow(lambda k, t: compare_blocks(k, t, similarity), "a long, b long, n long"), "found"
    )
    counts = found.where("b IS NULL").groupBy(F.col("a").alias("cid")).agg(F.sum("n").alias("_links"))
    roots = components(found.where("b IS NOT NULL").select("a", "b")).withColumnsRenamed({"node": "cid"})

    least = members.where("cid IS NOT NULL").groupBy("cid").agg(F.min("_key").alias("_least"), F.count(F.lit(1)).alias("_n"))
    named = least.join(counts, "cid", "left").join(roots, "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    named = stored(named.select("cid", "root", "_least", (F.coalesce("_links", F.lit(0)) + F.col("_n") - 1).alias("_links")), "named")
    smallest = named.groupBy("root").agg(F.min("_least").alias("component_id"))
    named = named.join(smallest, "root").select("cid", "_links", "component_id")
    out = members.join(broadcast_if_small(named, named.count(), BROADCAST_ROWS), "cid", "left")
    component = F.when(F.col("cid").isNull(), F.col("_key")).otherwise(F.col("component_id"))
    return out.select(
        F.col("_key").alias(key),
        F.coalesce("_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("_key") == component, F.lit(False)).alias("kept"),
    )
