"""Near-duplicate vectors by a forest of random-projection trees with spill."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import stored
from tessera.llm.components import Forest, components
from tessera.session import ship

COSINE, TREES, SAMPLE, LEAF, TILE = 0.98, 6, 16_384, 2_048, 2_048
#: Half the width of the band that goes to both sides, as a part of the largest distance of a pair.
SPILL = 0.1
#: A leaf's number: its tree in six bits, its node there in fourteen, and above them the way down its further splits.
_FIRST = (1 << 20) - 1


class Tree:
    """Random splits at the median of a sample; vectors near a split go to both sides."""

    def __init__(self, sample: np.ndarray, leaves: float, margin: float, seed: int):
        self.nodes: list[tuple[np.ndarray, float, int, int] | None] = []
        self.margin, self.rng = margin, np.random.default_rng(seed)
        self.least = max(8, len(sample) / max(1.0, leaves))
        self.grow(sample)

    def grow(self, x: np.ndarray) -> int:
        me = len(self.nodes)
        self.nodes.append(None)
        if len(x) > self.least:
            for _ in range(4):
                direction = self.rng.standard_normal(x.shape[1])
                direction /= np.linalg.norm(direction)
                p = x @ direction
                at = float(np.median(p))
                low, high = p <= at + self.margin, p >= at - self.margin
                if max(low.sum(), high.sum()) <= 0.8 * len(x):
                    self.nodes[me] = (direction, at, self.grow(x[low]), self.grow(x[high]))
                    break
        return me

    def leaves_of(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) for every leaf that a row reaches."""
        rows, leaves, todo = [], [], [(0, np.arange(len(x)))]
        while todo:
            at, own = todo.pop()
            node = self.nodes[at]
            if node is None or not len(own):
                rows.append(own)
                leaves.append(np.full(len(own), at))
                continue
            direction, split, low, high = node
            p = x[own] @ direction
            todo += [(low, own[p <= split + self.margin]), (high, own[p >= split - self.margin])]
        return np.concatenate(rows), np.concatenate(leaves)


def _matrix(column) -> np.ndarray:
    """Rows of equal length as unit vectors in double precision."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    x = np.asarray(column.flatten()).astype(np.float64).reshape(n, -1) if n else np.zeros((0, 1))
    # scaled by the largest component first, so that no square over- or underflows
    x = x / np.abs(x).max(axis=1, keepdims=True) if n else x
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True)) if n else x


def _direction(dim: int, code: int) -> np.ndarray:
    """The direction that a leaf is split along if it has to be: random, but the same everywhere."""
    d = np.random.default_rng([dim, code]).standard_normal(dim)
    return d / np.linalg.norm(d)


def _refined(x: np.ndarray, rows: np.ndarray, codes: np.ndarray, splits: dict[tuple[int, int], float], margin: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, leaf) after the further splits of leaves; the bits above the first twenty are the way down."""
    by = np.argsort(codes, kind="stable")
    edge = np.flatnonzero(np.r_[True, codes[by][1:] != codes[by][:-1], True]) if len(codes) else np.zeros(1, np.int64)
    todo = [(int(codes[by[a]]), rows[by[a:b]]) for a, b in zip(edge[:-1], edge[1:], strict=True)]
    out_row, out_code = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    while todo:
        code, own = todo.pop()
        at = splits.get((x.shape[1], code))
        if at is None or not len(own):
            out_row.append(own)
            out_code.append(np.full(len(own), code))
            continue
        p = x[own] @ _direction(x.shape[1], code)
        low, way = code & _FIRST, code >> 20
        todo += [(2 * way << 20 | low, own[p <= at + margin]), (2 * way + 1 << 20 | low, own[p >= at - margin])]
    return np.concatenate(out_row), np.concatenate(out_code)


def _leaves(forests: dict[int, list[Tree]], splits, margin: float, probe: bool = False):
    """Rows with each leaf that they reach; probe: only (label, dim, leaf, p), p along the leaf's next direction."""

    def assign(batches):
        further = splits.value if splits is not None else {}
        for batch in batches:
            dims = np.asarray(batch.column("dim"))
            out_row, out_leaf, out_p = [], [], []
            for dim in np.unique(dims):
                own = np.flatnonzero(dims == dim)
                x = _matrix(batch.column("v").take(pa.array(own)))
                for t, tree in enumerate(forests.get(int(dim), [])):
                    rows, leaves = _refined(x, *_coded(tree, x, t), further, margin)
                    out_row.append(own[rows])
                    out_leaf.append(leaves)
                    if probe:
                        p = np.zeros(len(rows))
                        for code in np.unique(leaves):
                            there = leaves == code
                            p[there] = x[rows[there]] @ _direction(int(dim), int(code))
                        out_p.append(p)
                if int(dim) not in forests:
                    out_row.append(own)
                    out_leaf.append(np.full(len(own), 1 << 20))
                    out_p.append(np.zeros(len(own)))
            rows = pa.array(np.concatenate(out_row) if out_row else [], pa.int64())
            leaf = pa.array(np.concatenate(out_leaf) if out_leaf else [], pa.int64())
            columns = ["label", "dim"] if probe else batch.schema.names
            more = [pa.array(np.concatenate(out_p) if out_p else [], pa.float64())] if probe else []
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(rows) for c in columns), leaf, *more], names=[*columns, "leaf", *["p"] * probe])

    return assign


def _coded(tree: Tree, x: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, leaf), a leaf's number holding its tree and the beginning of the way down, 1."""
    rows, leaves = tree.leaves_of(x)
    return rows, 1 << 20 | leaves * 64 + t


def further_splits(vectors: DataFrame, forests: dict[int, list[Tree]], margin: float, leaf: int) -> dict[tuple[int, int], float]:
    """Where to split leaves that the sample was too small to split, level by level until none is large, at the median
    that Spark finds of all their rows. A leaf that a split doesn't part (copies, a dense cluster) is left to tiles.

    What comes to the driver is two numbers for each oversized leaf: at most one for every 4 x leaf rows and tree.
    """
    spark = vectors.sparkSession
    kinds = vectors.select("label", "dim").schema.add("leaf", "long").add("p", "double")
    splits: dict[tuple[int, int], float] = {}
    sizes: dict[tuple[int, int], int] = {}
    while True:
        shared = spark.sparkContext.broadcast(splits)
        probed = vectors.select("label", "dim", "v").mapInArrow(_leaves(forests, shared, margin, True), kinds)
        large = probed.groupBy("label", "dim", "leaf").agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("p", 0.5, 1000).alias("at")).where(F.col("n") > 4 * leaf)
        found: dict[tuple[int, int], tuple[int, float]] = {}
        for r in large.collect():
            k = (r["dim"], r["leaf"])
            found[k] = max(found.get(k, (0, 0.0)), (r["n"], r["at"]))
        new = {}
        for (dim, code), (n, at) in found.items():
            parent = (dim, (code >> 21) << 20 | code & _FIRST)
            if n <= 0.8 * sizes.get(parent, n * 2) and (dim, code) not in splits:
                new[dim, code] = at
                sizes[dim, code] = n
        if not new:
            return splits
        splits |= new


def tile_pairs(df: DataFrame, keys: list[str], tile: int) -> DataFrame:
    """Columns part, i, j for pairs of tiles of each group: one tile where a group has at most `tile` rows.

    Large groups are dealt by a hash of the node, and every pair of their tiles becomes a group of its own.
    """
    large = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > tile)
    dealt = df.join(large.select(*keys, F.ceil(F.col("_n") / tile).alias("_parts")), keys, "left")
    dealt = dealt.withColumn("_parts", F.coalesce("_parts", F.lit(1))).withColumn("part", F.pmod(F.xxhash64("node"), F.col("_parts")))
    dealt = dealt.withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1)))
    return dealt.withColumn("i", F.least("part", "_other")).withColumn("j", F.greatest("part", "_other")).drop("_parts", "_other")


def _blocks(table: pa.Table, cosine: float, found) -> np.ndarray:
    """Calls found(a, b) with places of linked pairs, each once; returns the nodes."""
    i, j = table["i"][0].as_py(), table["j"][0].as_py()
    x = _matrix(table["v"])
    part = np.asarray(table["part"].combine_chunks())
    one, two = (np.arange(len(x)),) * 2 if i == j else (np.flatnonzero(part == i), np.flatnonzero(part == j))
    for lo in range(0, len(one), 512):
        own = one[lo : lo + 512]
        a, b = np.nonzero(x[own] @ x[two].T >= cosine)
        a, b = own[a], two[b]
        keep = a < b if i == j else np.ones(len(a), bool)
        found(a[keep], b[keep])
    return np.asarray(table["node"].combine_chunks())


def _links(cosine: float):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def compare(table: pa.Table) -> pa.Table:
        forest = Forest(table.num_rows)
        node = _blocks(table, cosine, forest.add)
        links = np.array(forest.links, np.int64).reshape(-1, 2)
        return pa.Table.from_arrays([pa.array(node[links[:, 0]], pa.int64()), pa.array(node[links[:, 1]], pa.int64())], schema=schema)

    return compare


def _degrees(cosine: float):
    schema = pa.schema([("node", pa.int64()), ("n", pa.int64())])

    def count(table: pa.Table) -> pa.Table:
        copies, n = np.asarray(table["copies"].combine_chunks()), np.zeros(table.num_rows, np.int64)

        def found(a: np.ndarray, b: np.ndarray) -> None:
            n[:] += np.bincount(a, weights=copies[b], minlength=len(n)).astype(np.int64) + np.bincount(b, weights=copies[a], minlength=len(n)).astype(np.int64)

        node = _blocks(table, cosine, found)
        return pa.Table.from_arrays([pa.array(node, pa.int64()), pa.array(n, pa.int64())], schema=schema)

    return count


def embedding_dedup(vectors: DataFrame, cosine: float = COSINE, trees: int = TREES, sample: int = SAMPLE, leaf: int = LEAF, tile: int = TILE) -> DataFrame:
    """One row per row of vectors (vec_id, embedding, label): vec_id, n_links, component_id, kept.

    Linked are vectors of equal label (null equals nothing) and dimension with a cosine of at least `cosine`, found in
    a common leaf of any tree or, for n_links, in a common component. n_links counts other rows, copies included;
    component_id is the smallest vec_id reachable; kept marks that row. A vector that is null, empty or zero, or holds
    a null or non-finite component, or has no vec_id or label, is linked with nothing and is its own component. No
    other columns are read. No rows give no rows.

    The trees' first splits are fitted on `sample` vectors (fixed by a hash of the vector) and every vector is dealt by
    them; where there are more vectors than such leaves hold, leaves are split on at medians of all their rows. Copies
    are compared once; a leaf or component of more than `tile` vectors is compared tile by tile in many tasks, which
    give spanning forests and counts, never pairs.
    """
    ship(vectors.sparkSession)
    e = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").alias("label"), F.col("embedding").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    fit = F.coalesce(F.col("label").isNotNull() & F.col("vec_id").isNotNull() & finite & F.exists("v", lambda x: x != 0), F.lit(False))
    e = e.withColumn("fit", fit)
    # a node is a number that a vector gets as it is written: one vec_id may name several vectors, and hashes may collide
    distinct = stored(e.where("fit").groupBy("label", "v").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("copies")).withColumns({"dim": F.size("v"), "node": F.monotonically_increasing_id()}))
    total = distinct.count()
    drawn = distinct.orderBy(F.xxhash64("label", "v"), "least").limit(sample).select("dim", "v").collect()
    margin = SPILL * float(np.sqrt(max(0.0, 2 - 2 * cosine)))
    forests = {}
    for dim in {r["dim"] for r in drawn}:
        x = np.array([r["v"] for r in drawn if r["dim"] == dim], np.float64)
        x /= np.abs(x).max(axis=1, keepdims=True)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        forests[dim] = [Tree(x, total * len(x) / len(drawn) / leaf, margin, t) for t in range(trees)]
    schema = distinct.select("label", "dim", "node", "v").schema.add("leaf", "long")
    # a sample makes one leaf of eight rows at least
    splits = None
    if total > leaf * max(1, len(drawn) // 8):
        splits = vectors.sparkSession.sparkContext.broadcast(further_splits(distinct, forests, margin, leaf))
    leaves = distinct.select("label", "dim", "node", "v").mapInArrow(_leaves(forests, splits, margin), schema)
    keys = ["label", "dim", "leaf"]
    found = tile_pairs(leaves, keys, tile).groupBy(*keys, "i", "j").applyInArrow(_links(cosine), "a long, b long")
    near = components(found)
    joined = distinct.join(near, "node")
    degree = tile_pairs(joined.select("component", "node", "v", "copies"), ["component"], tile).groupBy("component", "i", "j").applyInArrow(_degrees(cosine), "node long, n long").groupBy("node").agg(F.sum("n").alias("n"))
    least = joined.groupBy("component").agg(F.min("least").alias("first"))
    of = joined.join(least, "component").join(degree, "node").select("node", "first", "n")
    classes = distinct.join(of, "node", "left").select("label", "v", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n"), F.coalesce("first", "least").alias("first"))
    good = e.where("fit").join(classes, ["label", "v"]).select("vec_id", F.col("n").alias("n_links"), F.col("first").alias("component_id"))
    bad = e.where("not fit").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return good.union(bad).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
