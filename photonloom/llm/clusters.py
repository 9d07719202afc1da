"""Centroid clustering of vectors of whole numbers, filtered by ball trees.

Each task gathers its vectors into trees of TREE_ROWS, where they are; no vector is shuffled. A node of a
tree is a ball: the mean of its vectors as the centre, a radius that reaches all of them, their number and
their exact sum. In a round the nodes meet the centroids level by level. By the triangle inequality a
centroid is out for a ball if it is farther from all of the ball than another one; a ball with one centroid
left is assigned whole, by its number and sum, the others go on to their halves, and the vectors of the
leaves are compared exactly. A round returns a sum and a number for each centroid and task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from photonloom.llm.common import as_id, as_text, small_batches, staged, table

CLUSTERS, ROUNDS, SEED, DIMS, SCALE = 16, 3, "1", 64, 64
#: Vectors of a tree and of a leaf.
TREE_ROWS, LEAF_ROWS = 4096, 32
#: Components reach from -LARGEST to LARGEST, so that a squared distance of 64 of them fits 64 bits; up to EXACT it is a whole number in floating point.
LARGEST, EXACT = 1 << 27, 1 << 22
#: Bounds are widened by this share, far above the rounding of 64-bit floating point.
_SLACK = 1e-9


@dataclass(frozen=True)
class BallTree:
    """Vectors in the order of the leaves; node k has those from begin[k] to end[k], and the children left[k] and left[k] + 1, or none (0)."""

    vectors: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    left: np.ndarray
    radius: np.ndarray
    sums: np.ndarray

    @classmethod
    def grown(cls, vectors: np.ndarray, leaf_rows: int = LEAF_ROWS) -> tuple[BallTree, np.ndarray]:
        """The tree of some vectors, and which vector stands where. A ball is halved between two far vectors of it."""
        order = np.arange(len(vectors))
        x = vectors.astype(np.float64)
        begin, end, left, radius, sums = [0], [len(vectors)], [], [], []
        k = 0
        while k < len(begin):
            own = order[begin[k] : end[k]]
            total = vectors[own].sum(axis=0, dtype=np.int64)
            far = ((x[own] - total / max(len(own), 1)) ** 2).sum(axis=1)
            radius.append(float(np.sqrt(far.max(initial=0.0))) * (1 + _SLACK) + _SLACK)
            sums.append(total)
            if len(own) > leaf_rows and far.max() > 0:
                one = x[own[far.argmax()]]
                other = x[own[((x[own] - one) ** 2).sum(axis=1).argmax()]]
                side = np.argpartition(x[own] @ (other - one), len(own) // 2)
                order[begin[k] : end[k]] = own[side]
                middle = begin[k] + len(own) // 2
                left.append(len(begin))
                begin += [begin[k], middle]
                end += [middle, end[k]]
            else:
                left.append(0)
            k += 1
        return cls(vectors[order], *(np.array(v, np.int64) for v in (begin, end, left)), np.array(radius), np.array(sums, np.int64).reshape(len(begin), -1)), order

    def meet(self, centroids: np.ndarray) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray, np.ndarray]:
        """Balls that one centroid owns, as pairs of nodes and their centroids, and vectors of undecided leaves with their centroids; equal distances go to the smaller number."""
        node, open_ = np.zeros(1, np.int64), np.ones((1, len(centroids)), bool)
        z, balls, rows, allowed = centroids.astype(np.float64), [], [], []
        while len(node):
            centre = self.sums[node] / (self.end - self.begin)[node][:, None]
            d = np.sqrt(((centre[:, None, :] - z[None]) ** 2).sum(axis=2))
            slack = _SLACK * (1 + d)
            r = self.radius[node][:, None]
            reach = np.where(open_, d + r + slack, np.inf).min(axis=1)[:, None]
            open_ = open_ & (d - r - slack <= reach)
            one = open_.sum(axis=1) == 1
            balls.append((node[one], open_[one].argmax(axis=1)))
            leaf = ~one & (self.left[node] == 0)
            for k in np.flatnonzero(leaf):
                rows.append(np.arange(self.begin[node[k]], self.end[node[k]]))
                allowed.append(np.repeat(open_[k : k + 1], len(rows[-1]), axis=0))
            inner = ~one & ~leaf
            first = self.left[node[inner]]
            node, open_ = np.concatenate([first, first + 1]), np.concatenate([open_[inner]] * 2)
        if not rows:
            return balls, np.empty(0, np.int64), np.empty(0, np.int64)
        at, allowed = np.concatenate(rows), np.concatenate(allowed)
        return balls, at, squared(self.vectors[at], centroids, allowed).argmin(axis=1)


def squared(vectors: np.ndarray, centroids: np.ndarray, allowed: np.ndarray | None = None) -> np.ndarray:
    """Exact squared distances; what isn't allowed is farther than anything."""
    if max(np.abs(vectors).max(initial=0), np.abs(centroids).max(initial=0)) <= EXACT:
        v, z = vectors.astype(np.float64), centroids.astype(np.float64)
        out = ((v * v).sum(axis=1)[:, None] - 2 * (v @ z.T) + (z * z).sum(axis=1)).astype(np.int64)
    else:
        out = np.stack([((vectors.astype(np.int64) - z) ** 2).sum(axis=1) for z in centroids.astype(np.int64)], axis=1)
    return out if allowed is None else np.where(allowed, out, np.iinfo(np.int64).max)


_TREE = "ids array<string>, kind string, vectors binary, begin binary, end binary, left binary, radius binary, sums binary"


def _row(tree: BallTree, ids: list) -> list:
    kind = np.int16 if np.abs(tree.vectors).max(initial=0) < 1 << 15 else np.int32
    return [ids, np.dtype(kind).str, tree.vectors.astype(kind).tobytes(), *(getattr(tree, k).tobytes() for k in ("begin", "end", "left", "radius", "sums"))]


def _tree(r) -> BallTree:
    kinds = {"begin": np.int64, "end": np.int64, "left": np.int64, "radius": np.float64}
    own = {k: np.frombuffer(r[k], kind) for k, kind in kinds.items()}
    n = int(own["end"][0])
    return BallTree(np.frombuffer(r["vectors"], r["kind"]).reshape(n, -1), sums=np.frombuffer(r["sums"], np.int64).reshape(len(own["begin"]), -1), **own)


def whole_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """(id as text, v) of the rows with dims finite components, each floor(scale * component)."""
    v = F.col(f"`{vector_col}`")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != float("inf")))
    ok = F.coalesce((F.size(v) == dims) & finite, F.lit(False))
    return df.where(ok).select(as_text(df, id_col).alias("id"), F.transform(v, lambda x: F.floor(F.lit(float(scale)) * x.cast("double"))).alias("v"))


def ball_trees(vectors: DataFrame, tree_rows: int = TREE_ROWS, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """One row for each tree, from the vectors of each task as they come; written."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids: list = []
        held: list[np.ndarray] = []

        def grown(n: int) -> pd.DataFrame:
            v = np.stack(held[:n])
            if v.max() > LARGEST or v.min() < -LARGEST:
                raise ValueError(f"a component is beyond {LARGEST}, so a squared distance may not fit 64 bits")
            tree, order = BallTree.grown(v, leaf_rows)
            out = pd.DataFrame([_row(tree, [ids[k] for k in order])], columns=[c.split()[0] for c in _TREE.split(", ")])
            del held[:n], ids[:n]
            return out

        for x in batches:
            ids += x["id"].tolist()
            held += list(x["v"])
            while len(held) >= tree_rows:
                yield grown(tree_rows)
        if held:
            yield grown(len(held))

    with small_batches(vectors.sparkSession):
        return staged(vectors.mapInPandas(run, _TREE), "trees")


def first_centroids(vectors: DataFrame, clusters: int = CLUSTERS, seed: str = SEED) -> np.ndarray:
    """The vectors with the smallest hashes of seed and id, one for each cluster, in their order; a null id counts as empty."""
    drawn = vectors.withColumn("h", F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce("id", F.lit(""))), 256))
    return np.array([r.v for r in drawn.orderBy("h", "v").select("v").limit(clusters).collect()], np.int64)


def next_centroids(trees: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """One round: the floor of the mean of each centroid's vectors; a centroid without vectors stays."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, sums = np.zeros(len(centroids), np.int64), np.zeros(centroids.shape, np.int64)
        for x in batches:
            for r in x.to_dict("records"):
                tree = _tree(r)
                balls, at, own = tree.meet(centroids)
                for node, cluster in balls:
                    np.add.at(n, cluster, (tree.end - tree.begin)[node])
                    np.add.at(sums, cluster, tree.sums[node])
                np.add.at(n, own, 1)
                np.add.at(sums, own, tree.vectors[at].astype(np.int64))
        some = np.flatnonzero(n)
        if len(some):
            yield pd.DataFrame({"cluster": some, "n": n[some], "sums": list(sums[some])})

    with small_batches(trees.sparkSession):
        parts = trees.drop("ids").mapInPandas(run, "cluster int, n long, sums array<bigint>").select("cluster", "n", F.posexplode("sums").alias("i", "x"))
        # a row for each centroid and dimension
        totals = parts.groupBy("cluster", "i").agg(F.sum("n").alias("n"), F.sum(F.col("x").cast("decimal(38,0)")).alias("x")).collect()
    out = centroids.copy()
    for r in totals:
        out[r.cluster, r.i] = int(r.x) // r.n
    return out


def assigned(trees: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(id, cluster, distance) of every vector; written."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            for r in x.to_dict("records"):
                tree = _tree(r)
                cluster = np.empty(len(tree.vectors), np.int64)
                balls, at, own = tree.meet(centroids)
                for node, c in balls:
                    for k, j in zip(node, c):
                        cluster[tree.begin[k] : tree.end[k]] = j
                cluster[at] = own
                apart = tree.vectors.astype(np.int64) - centroids[cluster]
                yield pd.DataFrame({"id": r["ids"], "cluster": cluster, "distance": (apart * apart).sum(axis=1)})

    with small_batches(trees.sparkSession):
        return staged(trees.mapInPandas(run, "id string, cluster int, distance long"), "assigned")


def clustered(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", clusters: int = CLUSTERS, rounds: int = ROUNDS, seed: str = SEED, tree_rows: int = TREE_ROWS, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """(id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every vector with DIMS finite components.

    Null vectors, ones of other lengths, and ones with a null or non-finite component have no row. Repeated
    rows and ids are vectors of their own; a null id counts as empty where ids draw the first centroids, and
    of equal ids the smaller vector comes first. With fewer vectors than clusters each is a centroid. Equal
    distances go to the smaller number. A component beyond LARGEST is an error. Other columns, of whatever
    name, are ignored. An empty table gives an empty result.
    """
    spark = df.sparkSession
    vectors = whole_vectors(df, id_col, vector_col)
    trees = ball_trees(vectors, tree_rows, leaf_rows)
    centroids = first_centroids(vectors, clusters, seed)
    for _ in range(rounds if len(centroids) else 0):
        centroids = next_centroids(trees, centroids)
    found = assigned(trees, centroids)
    # a row for each centroid
    inertia = {r.cluster: int(r.d) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}
    facts = [(k, d, sum(inertia.values()), hashlib.sha256(",".join(map(str, centroids[k])).encode()).hexdigest()) for k, d in sorted(inertia.items())]
    known = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(known), "cluster").select(as_id(df, id_col).alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op13_clusters(spark, sf_dir: str) -> DataFrame:
    return clustered(table(spark, sf_dir, "embeddings"))


def _round_sql(k: int, last: bool) -> str:
    apart = "list_sum(list_transform(range(1, 65), lambda i: (v.c[i] - z.c[i]) * (v.c[i] - z.c[i])))"
    near = f"a{k} as materialized (select n, any_value(vec_id) vec_id, any_value(c) c, min({{'d': d, 'k': k}}) best from (select v.n, v.vec_id, v.c, z.k, {apart}::bigint d from v, z{k} z) group by n)"
    mean = f"""m{k} as (select k, list((s - ((s % n) + n) % n) // n order by i) c from (select best.k k, i, sum(c[i])::hugeint s, count(*)::hugeint n from a{k}, (select unnest(range(1, 65)) i) group by all) group by k),
z{k + 1} as materialized (select z.k, coalesce(m.c::bigint[], z.c) c from z{k} z left join m{k} m using (k))"""
    return near if last else f"{near},\n{mean}"


OP13_SQL = f"""
with v as materialized (select row_number() over () n, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::double)::bigint) c from embeddings
  where len(embedding) = {DIMS} and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = {DIMS}),
z0 as materialized (select row_number() over (order by h, c) - 1 k, c from (select c, sha256('{SEED}:' || coalesce(vec_id::varchar, '')) h from v order by h, c limit {CLUSTERS})),
{", ".join(_round_sql(k, k == ROUNDS) for k in range(ROUNDS + 1))}
select vec_id, best.k::int as cluster, best.d as distance, (sum(best.d) over (partition by best.k))::bigint cluster_inertia, (sum(best.d) over ())::bigint inertia, sha256(array_to_string(z.c, ',')) centroid_sha256
from a{ROUNDS} join z{ROUNDS} z on z.k = best.k
"""
