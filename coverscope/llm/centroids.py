"""Centroid clustering: dual-tree Lloyd with a cover tree over vectors and a tree over the centroids of each round."""

from __future__ import annotations

import hashlib
import math
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coverscope.runtime import settle

#: Vectors of a block, which has a cover tree of its own; vectors that a leaf holds at most; by how much a level's reach falls.
BLOCK, LEAF, BASE = 2048, 16, 1.3
#: Pairs whose distances are computed at once.
CHUNK = 8192
_EMPTY = np.empty(0, np.int64)


def squared(x: np.ndarray, i: np.ndarray, y: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Exact squared distances of x[i] and y[j]; the arrays hold whole numbers, and doubles only where these can't round."""
    out = np.empty(len(i), x.dtype)
    for at in range(0, len(i), CHUNK):
        gap = x[i[at : at + CHUNK]] - y[j[at : at + CHUNK]]
        out[at : at + CHUNK] = np.einsum("ij,ij->i", gap, gap)
    return out


def largest(dim: int, bits: int) -> int:
    """The greatest component for which a squared distance of vectors of dim components stays below 2^bits."""
    return math.isqrt(2**bits // dim) // 2


def exact(x: np.ndarray) -> np.ndarray:
    """Whole numbers as doubles where squared distances stay exact in them, else as longs."""
    return x.astype(np.float64 if not x.size or int(np.abs(x).max()) <= largest(x.shape[1], 52) else np.int64)


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[i], starts[i] + 1, ... , sizes[i] of them, for each i one after another."""
    total = int(sizes.sum())
    return np.repeat(starts - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes) + np.arange(total) if total else _EMPTY


@dataclass
class Tree:
    """A cover tree. A node stands for the points order[low:high]; all are within radius of its point, which is one of them.

    Children (first to last) are within their parent's reach, and their points are farther from each other than the level's reach; the first child has its parent's point.
    A node without children is a leaf: of LEAF points at most, or of equal ones.
    """

    order: np.ndarray
    point: np.ndarray
    radius: np.ndarray
    low: np.ndarray
    high: np.ndarray
    first: np.ndarray
    last: np.ndarray

    @property
    def leaf(self) -> np.ndarray:
        return self.first == self.last


def cover_tree(x: np.ndarray, leaf: int = LEAF) -> Tree:
    """The cover tree of the rows of x (at least one)."""
    order = np.arange(len(x))
    far = np.sqrt(squared(x, order, x, np.zeros(len(x), np.int64)).astype(float))
    nodes: list[list] = [[0, float(far.max()), 0, len(x), 0, 0]]
    gaps: list[np.ndarray] = [far]  # of a node's points from its own
    for n, gap in enumerate(gaps):  # grows as nodes are split
        point, radius, low, high = nodes[n][:4]
        if radius == 0 or high - low <= leaf:
            continue
        reach = BASE ** (math.ceil(math.log(radius, BASE)) - 1)
        reach = reach if reach < radius else radius / BASE
        own = order[low:high]
        near = gap <= reach
        parts, rest = [(point, own[near], gap[near])], own[~near]
        while len(rest):
            away = np.sqrt(squared(x, rest, x, np.full(len(rest), rest[0])).astype(float))
            near = away <= reach
            parts.append((int(rest[0]), rest[near], away[near]))
            rest = rest[~near]
        nodes[n][4], nodes[n][5] = len(nodes), len(nodes) + len(parts)
        for p, members, away in parts:
            order[low : low + len(members)] = members
            nodes.append([p, float(away.max()), low, low + len(members), 0, 0])
            gaps.append(away)
            low += len(members)
        gaps[n] = _EMPTY
    point, radius, low, high, first, last = zip(*nodes, strict=True)
    return Tree(order, *(np.array(a, t) for a, t in ((point, np.int64), (radius, np.float64), (low, np.int64), (high, np.int64), (first, np.int64), (last, np.int64))))


def nearest(x: np.ndarray, tree: Tree, c: np.ndarray, over: Tree) -> tuple[np.ndarray, int]:
    """The number of the nearest row of c for each row of x (the smaller of equally near ones), and how many distances it took.

    Pairs of a node of vectors and a node of centroids are split level by level. A pair goes when even the nearest centroid that its second node can have is farther from all points of the
    first than some centroid is. A node that is left with one centroid gives it to all its points; leaves that are left with several compare them exactly.
    """
    out = np.empty(len(x), np.int64)
    # Equal centroids share a leaf, for which the smallest number stands.
    least = np.array([over.order[a:b].min() for a, b in zip(over.low, over.high, strict=True)])
    v_leaf, c_leaf = tree.leaf, over.leaf
    v, c_node = np.zeros(1, np.int64), np.zeros(1, np.int64)
    compared: list[tuple[np.ndarray, np.ndarray]] = []
    taken = 0
    while len(v):
        away = np.sqrt(squared(x, tree.point[v], c, over.point[c_node]).astype(float))
        taken += len(v)
        new = np.concatenate(([True], v[1:] != v[:-1]))
        best = np.minimum.reduceat(away, np.flatnonzero(new))[np.cumsum(new) - 1]
        reach = tree.radius[v]
        keep = away - reach - over.radius[c_node] <= best + reach + 1e-9 * (away + best + reach)  # more than any rounding
        v, c_node = v[keep], c_node[keep]
        starts = np.flatnonzero(np.concatenate(([True], v[1:] != v[:-1])))
        sizes = np.diff(np.append(starts, len(v)))
        node, all_leaves = v[starts], np.minimum.reduceat(c_leaf[c_node], starts)
        for n, number in zip(node[only := (sizes == 1) & all_leaves].tolist(), least[c_node[starts[only]]].tolist(), strict=True):
            out[tree.order[tree.low[n] : tree.high[n]]] = number
        last = ~only & all_leaves & v_leaf[node]
        if last.any():
            compared.append((np.repeat(node[last], sizes[last]), c_node[spread(starts[last], sizes[last])]))
        widest = np.maximum.reduceat(np.where(c_leaf[c_node], -1.0, over.radius[c_node]), starts)
        down = ~only & ~last & ~v_leaf[node] & (tree.radius[node] >= widest)
        across = ~only & ~last & ~down
        # Children of the vectors' nodes, each with all the centroids' nodes of its parent.
        children = tree.last[node[down]] - tree.first[node[down]]
        of = np.repeat(np.flatnonzero(down), children)
        down_v, down_c = np.repeat(spread(tree.first[node[down]], children), sizes[of]), c_node[spread(starts[of], sizes[of])]
        # Children of the centroids' nodes; leaves stay.
        at = spread(starts[across], sizes[across])
        stays = c_leaf[c_node[at]]
        children = np.where(stays, 1, over.last[c_node[at]] - over.first[c_node[at]])
        across_v, across_c = np.repeat(v[at], children), spread(np.where(stays, c_node[at], over.first[c_node[at]]), children)
        v, c_node = np.concatenate((down_v, across_v)), np.concatenate((down_c, across_c))
    if compared:
        v, c_node = (np.concatenate(a) for a in zip(*compared, strict=True))
        size = np.where(tree.radius[v] == 0, 1, tree.high[v] - tree.low[v])  # equal points are one
        at, number = spread(tree.low[v], size), np.repeat(least[c_node], size)
        away = squared(x, tree.order[at], c, number)
        taken += len(at)
        order = np.lexsort((number, away, at))
        first = order[np.concatenate(([True], at[order][1:] != at[order][:-1]))]
        out[tree.order[at[first]]] = number[first]
        for n in np.unique(v[(tree.radius[v] == 0) & (tree.high[v] - tree.low[v] > 1)]).tolist():
            out[tree.order[tree.low[n] + 1 : tree.high[n]]] = out[tree.order[tree.low[n]]]
    return out, taken


def whole_numbers(vector: Column, dim: int, scale: int) -> Column:
    """floor(scale * x) of each component; null for what isn't dim finite numbers, or where squared distances would exceed a long."""
    x = vector.cast("array<double>")
    most = largest(dim, 62)
    fits = (F.size(x) == dim) & F.forall(x, lambda y: y.isNotNull() & ~F.isnan(y) & (F.abs(y * scale) < most))
    return F.when(fits, F.transform(x, lambda y: F.floor(y * scale)))


def first_centroids(vectors: DataFrame, k: int, prefix: str) -> np.ndarray:
    """The k vectors whose ids with the prefix have the smallest sha256, ascending; of equal ids the smaller vectors, a null id last."""
    rows = vectors.select("v", F.sha2(F.concat(F.lit(prefix), F.col("vec_id").cast("string")), 256).alias("h")).orderBy(F.col("h").asc_nulls_last(), "v").limit(k).collect()
    return np.array([r["v"] for r in rows], np.int64)


def blocks_of(vectors: DataFrame) -> DataFrame:
    """(block): blocks of vectors with their ids and cover trees."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                x = part.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(part.num_rows, -1)
                small = x.astype(np.int16) if np.abs(x).max() < 1 << 15 else x
                yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps((part.column(0).to_pylist(), small, vars(cover_tree(exact(x)))))], pa.binary())], names=["block"])

    return vectors.select("vec_id", "v").mapInArrow(run, "block binary")


class Round:
    """A round's centroids, ready for blocks; the tree is made where it is used."""

    def __init__(self, centroids: np.ndarray) -> None:
        self.centroids, self.tree = centroids, None

    def __getstate__(self) -> dict:
        return {"centroids": self.centroids, "tree": None}

    def of(self, block: bytes) -> tuple[list[int], np.ndarray, np.ndarray]:
        """(ids, vectors, clusters) of a block."""
        if self.tree is None:
            self.tree = cover_tree(exact(self.centroids), leaf=1)
        ids, x, tree = pickle.loads(block)  # noqa: S301  written by blocks_of
        tree = Tree(**tree)
        both = exact(x), exact(self.centroids)
        kind = np.result_type(*both) if both[0].dtype == both[1].dtype else np.int64
        found, _ = nearest(both[0].astype(kind), tree, both[1].astype(kind), self.tree)
        return ids, x, found


def cluster_sums(blocks: DataFrame, centroids: np.ndarray) -> dict[int, tuple[int, list[int]]]:
    """How many vectors are nearest to each centroid, and their sum. A task adds up its blocks; at most a row for each centroid comes back."""
    now, (k, dim) = Round(centroids), centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros(k, np.int64), np.zeros((k, dim), np.int64)
        for batch in batches:
            for block in batch.column(0):
                _, x, found = now.of(block.as_py())
                order = np.argsort(found, kind="stable")
                starts = np.flatnonzero(np.concatenate(([True], found[order][1:] != found[order][:-1])))
                own = found[order][starts]
                total[own] += np.add.reduceat(x[order].astype(np.int64), starts, axis=0)
                n += np.bincount(found, minlength=k)
        some = np.flatnonzero(n)
        for at in range(0, len(some), 1024):
            part = some[at : at + 1024]
            sums = pa.FixedSizeListArray.from_arrays(pa.array(total[part].ravel()), dim).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(n[part]), sums], names=["cluster", "n", "sums"])

    parts = blocks.mapInArrow(run, "cluster int, n long, sums array<long>")
    rows = parts.groupBy("cluster").agg(F.sum("n").alias("n"), *[F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(dim)]).collect()
    return {r["cluster"]: (r["n"], [r[f"s{i}"] for i in range(dim)]) for r in rows}


def lloyd(df: DataFrame, k: int, rounds: int, dim: int, scale: int, prefix: str, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """The blocks of all vectors that are kept, and the centroids after the rounds (fewer than k rows where fewer vectors are kept)."""
    vectors = df.select(F.col(id_col).cast("long").alias("vec_id"), whole_numbers(F.col(vector_col), dim, scale).alias("v")).where("v is not null")
    blocks = settle(blocks_of(vectors))
    centroids = first_centroids(vectors, k, prefix)
    for _ in range(rounds if len(centroids) else 0):
        for cluster, (n, sums) in cluster_sums(blocks, centroids).items():
            centroids[cluster] = [s // n for s in sums]
    return blocks, centroids


def clustered(df: DataFrame, k: int = 40, rounds: int = 5, dim: int = 64, scale: int = 256, prefix: str = "2:", id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every vector of df that is kept: dim components, none null, NaN or infinite.

    Components become floor(scale * x). The first centroids are the k kept vectors with the smallest hash of prefix and id. A round assigns every vector to its nearest
    centroid by squared Euclidean distance (the smaller number of equally near ones) and replaces each centroid that has vectors by floor(sum / count) of each component; after the
    last round vectors are assigned once more. All of it is exact. Vectors whose squared distances might not fit into a long (components of over some 2^27 after scaling, for 64) are left out.

    Repeated rows each count and come back; a null id stays, and begins a centroid only when ids run out; fewer than k vectors make fewer centroids; other columns
    aren't read; an empty table gives no rows.

    Vectors stay in blocks where they were read, each with its tree; a round moves a sum for each task and centroid. The driver holds the k centroids.
    """
    spark = df.sparkSession
    blocks, centroids = lloyd(df, k, rounds, dim, scale, prefix, id_col, vector_col)
    schema = "vec_id long, cluster int, distance long"
    if not len(centroids):
        return spark.createDataFrame([], f"{schema}, cluster_inertia long, inertia long, centroid_sha256 string")
    now = Round(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in batch.column(0):
                ids, x, found = now.of(block.as_py())
                gap = x.astype(np.int64) - now.centroids[found]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(found, pa.int32()), pa.array(np.einsum("ij,ij->i", gap, gap))], names=["vec_id", "cluster", "distance"])

    found = settle(blocks.mapInArrow(run, schema))
    inertia = {r["cluster"]: r["s"] for r in found.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    total = sum(inertia.values())
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    named = spark.createDataFrame([(i, s, total, digests[i]) for i, s in inertia.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(named), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # k rows


def centroid_table(df: DataFrame, k: int = 40, rounds: int = 5, dim: int = 64, scale: int = 256, prefix: str = "2:", id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(cluster, centroid): the centroids that `clustered` ends with."""
    _, centroids = lloyd(df, k, rounds, dim, scale, prefix, id_col, vector_col)
    return df.sparkSession.createDataFrame([(i, c) for i, c in enumerate(centroids.tolist())], "cluster int, centroid array<long>")
