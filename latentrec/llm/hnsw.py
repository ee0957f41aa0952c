"""Approximate nearest neighbours: a navigable small-world graph for each shard.

Equal vectors are one node (with the ids that can ever be reported: ties go to
smaller ids, so a node needs only its ``k + 1`` smallest). Nodes are dealt to
shards by a hash of the vector; every row is indexed. Each shard builds a
hierarchical graph (Malkov & Yashunin 2018), stored as flat neighbour arrays in
one row of a Parquet table. All queries search all shards, in the cells of a
grid of query blocks and shards; distances are computed in double precision on
the original vectors, and the shard results are merged.

Insertion and search run for many vectors at once: a step takes the nearest
unexpanded candidates of every query of the block and looks at their
neighbours in one numpy operation.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from latentrec.llm.common import U64, mix, shuffle_partitions, stored
from latentrec.llm.vectors import QUERY_GROUP, best, clean_vectors, grid, matrix, query_blocks

M = 16  # links of a node in an upper layer; twice as many at the bottom
EF_BUILD = 64
EF_SEARCH = 128
EF_UPPER = 16  # candidates kept in the upper layers; all of them enter the layer below
EXPAND = 4  # candidates expanded in one step
BATCH = 256
SHARD_ROWS = 2_048


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of matching rows of ``x (n, d)`` and ``y (n, m, d)``."""
    return ((y - x[:, None, :]) ** 2).sum(2)


class Graph:
    """Layers of neighbour arrays over the rows of ``x``; -1 pads."""

    def __init__(self, x: np.ndarray, level: np.ndarray):
        self.x, self.level = x, level
        top = int(level.max(initial=0))
        self.links = [np.full((len(x), M * (2 if at == 0 else 1)), -1, np.int32) for at in range(top + 1)]
        self.entry = -1

    # ---- search ---------------------------------------------------------------
    def layer(self, q: np.ndarray, start: np.ndarray, at: int, ef: int) -> tuple[np.ndarray, np.ndarray]:
        """Best ``ef`` nodes of a layer for each query: ids (-1 pads) and squared distances, nearest first."""
        n, links, rows = len(q), self.links[at], np.arange(len(q))[:, None]
        seen = np.zeros((n, len(self.x) + 1), bool)  # the last column takes the padding
        ids, dist = self._distinct(start, seen, rows, q)
        ids, dist = self._cut(ids, dist, ef)
        done = np.zeros(ids.shape, bool)
        active = np.arange(n)
        while len(active):
            d = np.where(done[active], np.inf, dist[active])
            pick = np.argsort(d, 1)[:, : min(EXPAND, d.shape[1])]
            open_ = np.isfinite(np.take_along_axis(d, pick, 1))
            going = open_[:, 0]
            active, pick, open_ = active[going], pick[going], open_[going]
            if not len(active):
                break
            done[active[:, None], pick] |= open_
            nodes = np.where(open_, ids[active[:, None], pick], -1)
            near = np.where(nodes[:, :, None] >= 0, links[nodes], -1).reshape(len(active), -1)
            near, nd = self._distinct(near, seen, active[:, None], q)
            all_ids = np.concatenate([ids[active], near], 1)
            all_d = np.concatenate([dist[active], nd], 1)
            all_done = np.concatenate([done[active], np.zeros(near.shape, bool)], 1)
            width = max(ids.shape[1], min(ef, all_ids.shape[1]))
            if width > ids.shape[1]:
                more = width - ids.shape[1]
                ids = np.pad(ids, ((0, 0), (0, more)), constant_values=-1)
                dist = np.pad(dist, ((0, 0), (0, more)), constant_values=np.inf)
                done = np.pad(done, ((0, 0), (0, more)), constant_values=True)
            order = np.argsort(all_d, 1, kind="stable")[:, :width]
            ids[active] = np.take_along_axis(all_ids, order, 1)
            dist[active] = np.take_along_axis(all_d, order, 1)
            done[active] = np.take_along_axis(all_done, order, 1)
        return ids, dist

    def _distinct(self, near, seen, rows, q):
        """Unseen nodes once each, marked as seen, with their distances."""
        near = np.sort(near, 1)
        again = np.zeros(near.shape, bool)
        again[:, 1:] = near[:, 1:] == near[:, :-1]
        fresh = (near >= 0) & ~again & ~seen[rows, near]
        seen[rows, np.where(fresh, near, len(self.x))] = True
        near = np.where(fresh, near, -1)
        dist = np.full(near.shape, np.inf)
        at = np.nonzero(fresh)
        which = np.broadcast_to(rows, near.shape)[at]
        diff = self.x[near[at]] - q[which]
        dist[at] = np.einsum("ij,ij->i", diff, diff)
        return near, dist

    @staticmethod
    def _cut(ids, dist, ef):
        order = np.argsort(dist, 1, kind="stable")[:, :ef]
        return np.take_along_axis(ids, order, 1), np.take_along_axis(dist, order, 1)

    def descend(self, q: np.ndarray, to: int) -> np.ndarray:
        """Entries for layer ``to``: the nearest nodes found in the layers above."""
        start = np.full((len(q), 1), self.entry, np.int64)
        for at in range(len(self.links) - 1, to, -1):
            if self.level[self.entry] >= at:
                start = self.layer(q, start, at, EF_UPPER)[0]
        return start

    def search(self, q: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray]:
        return self.layer(q, self.descend(q, 0), 0, ef)

    # ---- construction ---------------------------------------------------------
    def choose(self, nodes: np.ndarray, ids: np.ndarray, dist: np.ndarray, m: int) -> np.ndarray:
        """Up to ``m`` links among candidates (nearest first): those nearer to the
        node than to any link chosen before, then the nearest of the others."""
        n, c = ids.shape
        out = np.full((n, m), -1, np.int32)
        for lo in range(0, n, 128):
            part, d = ids[lo : lo + 128], dist[lo : lo + 128]
            # seen from the node: differences keep their digits
            y = (self.x[part] - self.x[nodes[lo : lo + 128], None]).astype(np.float32)
            norm = np.einsum("ijk,ijk->ij", y, y)
            between = norm[:, :, None] + norm[:, None, :] - 2 * (y @ y.transpose(0, 2, 1))
            nearest = np.full(part.shape, np.inf, np.float32)
            taken = np.zeros(part.shape, bool)
            for j in range(c):
                take = (part[:, j] >= 0) & (d[:, j] < nearest[:, j]) & (taken.sum(1) < m)
                taken[:, j] = take
                nearest = np.where(take[:, None], np.minimum(nearest, between[:, j]), nearest)
            rank = np.where(taken, 0, np.where(part >= 0, 1, 2))
            order = np.argsort(rank, 1, kind="stable")[:, :m]
            best_ = np.take_along_axis(part, order, 1)
            out[lo : lo + 128, : best_.shape[1]] = best_
        return out

    def connect(self, at: int, nodes: np.ndarray, ids: np.ndarray, dist: np.ndarray) -> None:
        links = self.links[at]
        m = links.shape[1]
        chosen = self.choose(nodes, ids, dist, M)
        links[nodes, : chosen.shape[1]] = chosen
        # links back: a node that gets too many chooses anew
        src = np.repeat(nodes, chosen.shape[1])
        dst = chosen.ravel()
        src, dst = src[dst >= 0], dst[dst >= 0]
        order = np.argsort(dst, kind="stable")
        src, dst = src[order], dst[order]
        targets, first, count = np.unique(dst, return_index=True, return_counts=True)
        have = (links[targets] >= 0).sum(1)
        for t, f, k, h in zip(targets, first, count, have):
            new = src[f : f + k]
            if h + k <= m:
                links[t, h : h + k] = new
        over = np.flatnonzero(have + count > m)
        if len(over):
            wide = int((have[over] + count[over]).max())
            pool = np.full((len(over), wide), -1, np.int64)
            for i, o in enumerate(over):
                h, k = have[o], count[o]
                pool[i, :h] = links[targets[o], :h]
                pool[i, h : h + k] = src[first[o] : first[o] + k]
            d = np.where(pool >= 0, squared(self.x[targets[over]], self.x[pool]), np.inf)
            pool, d = self._cut(pool, d, 4 * m)
            links[targets[over]] = self.choose(targets[over], pool, d, m)

    def insert(self, nodes: np.ndarray) -> None:
        """Add a batch of nodes; they also see each other."""
        x = self.x[nodes]
        norm = (x * x).sum(1)
        mutual = np.maximum(norm[:, None] + norm[None, :] - 2 * (x @ x.T), 0)
        np.fill_diagonal(mutual, np.inf)
        top = int(self.level[nodes].max())
        start = None
        for at in range(top, -1, -1):
            here = np.flatnonzero(self.level[nodes] >= at)
            ids = np.full((len(here), 0), -1, np.int64)
            dist = np.zeros((len(here), 0))
            if self.entry >= 0 and self.level[self.entry] >= at:
                ids, dist = self.layer(x[here], self.descend(x[here], at), at, EF_BUILD)
            mates = mutual[np.ix_(here, here)]
            ids = np.concatenate([ids, np.broadcast_to(nodes[here], mates.shape)], 1)
            dist = np.concatenate([dist, mates], 1)
            ids = np.where(np.isfinite(dist), ids, -1)
            if ids.shape[1]:
                self.connect(at, nodes[here], *self._cut(ids, dist, EF_BUILD))
        highest = nodes[self.level[nodes].argmax()]
        if self.entry < 0 or self.level[highest] > self.level[self.entry]:
            self.entry = int(highest)


    def bridge(self) -> None:
        """Make every node of a layer reachable from the entry.

        In a dense cluster all links may end inside of it; then the nearest
        pair of a reachable and an unreachable node is linked both ways, in
        columns added for that, until all are reachable.
        """
        for at, links in enumerate(self.links):
            here = np.flatnonzero(self.level >= at)
            while len(lost := np.setdiff1d(here, reached := reachable(links, self.entry), assume_unique=True)):
                best_ = (np.inf, -1, -1)
                for lo in range(0, len(lost), 256):
                    y = self.x[lost[lo : lo + 256]]
                    d = (y * y).sum(1)[:, None] + (self.x[reached] ** 2).sum(1) - 2 * y @ self.x[reached].T
                    i, j = np.unravel_index(d.argmin(), d.shape)
                    best_ = min(best_, (float(d[i, j]), int(lost[lo + i]), int(reached[j])))
                _, u, v = best_
                if (links[[u, v]] >= 0).all(1).any():
                    links = np.concatenate([links, np.full((len(links), 1), -1, np.int32)], 1)
                for a, b in ((u, v), (v, u)):
                    links[a, np.flatnonzero(links[a] < 0)[0]] = b
            self.links[at] = links


def reachable(links: np.ndarray, start: int) -> np.ndarray:
    """Nodes that can be reached by links from ``start``."""
    seen = np.zeros(len(links) + 1, bool)
    seen[start] = True
    front = np.array([start])
    while len(front):
        near = np.unique(links[front])
        front = near[~seen[near] & (near >= 0)]
        seen[front] = True
    return np.flatnonzero(seen[:-1])


def levels(n: int, seed: int) -> np.ndarray:
    """Geometric layers from a hash of the position, the same at every retry."""
    with np.errstate(over="ignore"):
        h = mix(np.arange(n, dtype=U64) + U64(seed) * U64(0x9E3779B97F4A7C15))
    u = ((h >> U64(11)).astype(np.float64) + 0.5) / 2.0**53
    return np.minimum(np.floor(-np.log(u) / np.log(M)), 8).astype(np.int64)


def build(x: np.ndarray, seed: int = 0) -> Graph:
    g = Graph(x, levels(len(x), seed + 1))
    at = 0
    while at < len(x):  # batches grow with the graph, so that a batch does not outweigh it
        size = min(BATCH, max(32, at // 2))
        g.insert(np.arange(at, min(len(x), at + size)))
        at += size
    if len(x):
        g.bridge()
    return g


INDEX_SCHEMA = "dim int, shard int, n int, entry int, ids binary, ends binary, mat binary, level binary, links array<binary>"


def index(nodes: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row per shard: vectors, ids of each node and flat neighbour arrays."""
    shards = max(1, -(-nodes.count() // shard_rows))
    dealt = nodes.withColumn("shard", F.pmod(F.xxhash64("v"), F.lit(shards)).cast("int"))

    def run(key, rows: pd.DataFrame) -> pd.DataFrame:
        # ordered by a hash-like key, so that neither ids nor input order shape the graph
        rows = rows.sort_values("order", kind="stable")
        x = matrix(rows["v"])
        g = build(x, int(key[1]))
        ids = [np.asarray(i, np.int64) for i in rows["ids"]]
        ends = np.cumsum([len(i) for i in ids])
        return pd.DataFrame(
            {
                "dim": [key[0]], "shard": [key[1]], "n": [len(x)], "entry": [g.entry],
                "ids": [np.concatenate(ids).tobytes()], "ends": [ends.astype(np.int64).tobytes()],
                "mat": [x.tobytes()], "level": [g.level.tobytes()], "links": [[a.tobytes() for a in g.links]],
            }
        )

    n = min(shards, shuffle_partitions(nodes.sparkSession) * 4)
    dealt = dealt.withColumn("order", F.xxhash64("v", F.lit(1))).repartition(n, "dim", "shard")
    return dealt.groupBy("dim", "shard").applyInPandas(run, INDEX_SCHEMA)


def load(row: dict) -> tuple[Graph, np.ndarray, np.ndarray]:
    x = np.frombuffer(row["mat"], np.float64).reshape(row["n"], -1)
    g = Graph(x, np.frombuffer(row["level"], np.int64))
    g.links = [np.frombuffer(b, np.int32).reshape(row["n"], -1) for b in row["links"]]
    g.entry = row["entry"]
    return g, np.frombuffer(row["ids"], np.int64), np.frombuffer(row["ends"], np.int64)


def nearest(
    df: DataFrame,
    k: int = 10,
    every: int = 100,
    ef: int = EF_SEARCH,
    shard_rows: int = SHARD_ROWS,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
) -> DataFrame:
    """``(query_id, rank, vec_id, score)`` for every row whose id is divisible by ``every``.

    The score is the Euclidean distance in double precision. A query's
    candidates are all rows of another id and of its dimension. Rows without
    an id, and vectors that are null, zero or hold null or non-finite
    components, take no part; rows equal in id and vector count once.
    """
    vectors = clean_vectors(df, id_col, vec_col, lambda x: x).where(F.exists("v", lambda x: x != 0))
    vectors = stored(vectors, "vectors")
    first = Window.partitionBy("v").orderBy("id")
    few = vectors.withColumn("r", F.row_number().over(first)).where(F.col("r") <= k + 1)
    nodes = few.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids"), F.first("dim").alias("dim"))
    graphs = stored(index(stored(nodes, "nodes"), shard_rows), "hnsw")
    queries = stored(query_blocks(vectors.where(F.pmod("id", F.lit(every)) == 0)), "queries")
    n_shards, n_queries = graphs.count(), queries.count()
    cells = grid(
        graphs.withColumn("first", F.lit(0).cast("long")),
        queries.withColumn("shard", F.lit(-1)),
        max(1, n_shards),
        max(1, -(-n_queries // QUERY_GROUP)),
        F.xxhash64("dim", "shard"),
        F.xxhash64("first"),
    ).sortWithinPartitions("lg", "rg", "kind", "dim", "shard", "first")
    names = ("lg", "rg", "kind", "dim", "n", "ids", "mat", "entry", "ends", "level", "links")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cell, held = None, []
        for batch in batches:
            for values in zip(*(batch[c] for c in names)):
                row = dict(zip(names, values))
                if cell != (row["lg"], row["rg"]):
                    cell, held = (row["lg"], row["rg"]), []
                if row["kind"] == 0:
                    row["entry"] = int(row["entry"])
                    held.append((row["dim"], *load(row)))
                    continue
                own = np.frombuffer(row["ids"], np.int64)
                q = np.frombuffer(row["mat"], np.float64).reshape(row["n"], -1)
                for dim, g, ids, ends in held:
                    if dim == row["dim"]:
                        yield answers(g, ids, ends, own, q, k, max(ef, 2 * k))

    found = cells.select(*names).mapInPandas(run, "query_id long, vec_id long, score double")
    return best(found, k, ascending=True)


def answers(g: Graph, ids, ends, own: np.ndarray, q: np.ndarray, k: int, ef: int) -> pd.DataFrame:
    """The ``k`` nearest rows of one shard for each query."""
    near, _ = g.search(q, ef)
    near = near[:, : 2 * k]
    begins = ends - np.diff(ends, prepend=0)
    out_q, out_v, out_s = [], [], []
    for i, nodes in enumerate(near):
        nodes = nodes[nodes >= 0]
        d = np.sqrt(((g.x[nodes] - q[i]) ** 2).sum(1))
        v = np.concatenate([ids[begins[n] : ends[n]] for n in nodes] or [np.zeros(0, np.int64)])
        s = np.repeat(d, (ends - begins)[nodes])
        other = v != own[i]
        v, s = v[other], s[other]
        order = np.lexsort((v, s))[:k]
        out_q.append(np.full(len(order), own[i]))
        out_v.append(v[order])
        out_s.append(s[order])
    return pd.DataFrame(
        {
            "query_id": np.concatenate(out_q or [[]]).astype(np.int64),
            "vec_id": np.concatenate(out_v or [[]]).astype(np.int64),
            "score": np.concatenate(out_s or [[]]).astype(np.float64),
        }
    )
