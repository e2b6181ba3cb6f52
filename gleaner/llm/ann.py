"""Approximate nearest neighbours: sharded robust-pruned directed graphs.

Equal vectors are one node (with the few smallest ids that an answer can need), so
a vector that a third of all rows hold is indexed once.  Nodes are dealt by hash to
shards of about SHARD_ROWS, a number that doesn't grow with the data.  In each shard
a directed graph is built: nodes in random order are searched for greedily, what
the search visits are proposed neighbours, and pruning keeps the nearest while
dropping those that a kept one is nearer to by the factor ALPHA, so edges stay
diverse; edges also go back, pruned alike.  A beam search from the medoid and a few
fixed nodes answers each block of queries in every shard, and the exact cosines of
all that it finds, in double precision on the original vectors, decide; while the last
of them ties with the k-th, the beam widens, to the whole shard if need be, so that ties
go to the smaller id.  Cosines are taken after scaling each vector by its largest
component's power of two, which neither over- nor underflows nor rounds.

Every row is indexed; nothing is fitted on a sample.  Vectors that are null, empty,
zero, or hold null or non-finite components take no part, as queries or candidates.
Only vectors of one length are compared.  A query's own row is not its neighbour;
rows that repeat a vec_id are one row, the one with the least vector.  Other columns
are ignored, whatever their names; an empty table gives an empty result.

Every query searches every shard: queries grow with the rows, so searches grow with
their square over SHARD_ROWS * QUERY_BLOCK, each at a beam's cost.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gleaner.llm.common import save

SHARD_ROWS = 8_000
QUERY_BLOCK = 4_096
DEGREE = 24
ALPHA = 1.2
BEAM = 96
WIDTH = 4  # nodes that a search expands at a time
_FAR = np.float32(np.inf)


def _distances(x: np.ndarray, at: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Squared distances of unit vectors: q[i] to x[at[i, j]]; infinite at -1."""
    d = 2 - 2 * np.einsum("bd,bcd->bc", q, x[at])
    d[at < 0] = _FAR
    return np.maximum(d, 0)


def beam_search(x: np.ndarray, graph: np.ndarray, entries: np.ndarray, q: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
    """The beam's nodes, nearest first, and their distances, for each row of q; all
    rows advance together."""
    b = len(q)
    beam = max(beam, len(entries))
    ids = np.full((b, beam), -1)
    ids[:, : len(entries)] = entries
    dist = _distances(x, ids, q)
    done = ids < 0
    seen = np.zeros((b, len(x) + 1), bool)  # the last column takes the -1
    seen[:, entries] = True
    seen[:, -1] = True
    rows = np.arange(b)[:, None]
    while True:
        waiting = np.where(done, _FAR, dist)
        pick = np.argpartition(waiting, WIDTH, axis=1)[:, :WIDTH]
        live = ~np.take_along_axis(done, pick, 1)
        if not live.any():
            break
        np.put_along_axis(done, pick, True, 1)
        at = np.where(live, np.take_along_axis(ids, pick, 1), -1)
        near = np.where((at >= 0)[:, :, None], graph[at], -1).reshape(b, -1)
        near = np.sort(near, 1)
        near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
        near[seen[rows, near]] = -1
        seen[rows, near] = True
        ids, dist, done = np.hstack([ids, near]), np.hstack([dist, _distances(x, near, q)]), np.hstack([done, near < 0])
        best = np.argsort(dist, axis=1, kind="stable")[:, :beam]
        ids, dist, done = (np.take_along_axis(v, best, 1) for v in (ids, dist, done))
    return ids, dist


def robust_prune(x: np.ndarray, own: np.ndarray, candidates: np.ndarray, degree: int = DEGREE, alpha: float = ALPHA) -> np.ndarray:
    """Up to ``degree`` diverse neighbours of the nodes ``own`` among candidates."""
    candidates = np.sort(candidates, 1)
    candidates[:, 1:][candidates[:, 1:] == candidates[:, :-1]] = -1
    candidates[candidates == own[:, None]] = -1
    dist = _distances(x, candidates, x[own])
    vectors = x[candidates]
    out = np.full((len(own), degree), -1)
    alive = candidates >= 0
    rows = np.arange(len(own))
    for k in range(degree):
        best = np.where(alive, dist, _FAR).argmin(1)
        good = alive[rows, best]
        if not good.any():
            break
        out[:, k] = np.where(good, candidates[rows, best], -1)
        between = 2 - 2 * np.einsum("bd,bcd->bc", vectors[rows, best], vectors)
        alive &= ~(good[:, None] & (alpha**2 * between <= dist))
        alive[rows, best] = False
    return out


def build_graph(x: np.ndarray, degree: int = DEGREE, alpha: float = ALPHA, beam: int = BEAM, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Graph (n, degree) of unit vectors x, -1 where a node has fewer neighbours,
    and the entry nodes."""
    n, rng = len(x), np.random.default_rng(seed)
    entries = np.unique(np.append(rng.integers(0, n, 7), (x @ x.mean(0)).argmax()))
    if n <= degree + 1:
        full = np.tile(np.arange(n), (n, 1))
        full[full == np.arange(n)[:, None]] = -1
        return np.hstack([full, np.full((n, degree + 1 - n), -1)]) if n < degree + 1 else full, entries
    graph = (np.arange(n)[:, None] + rng.integers(1, n, (n, degree))) % n
    order = rng.permutation(n)
    at, size = 0, 64
    while at < n:
        own = order[at : at + size]
        found, _ = beam_search(x, graph, entries, x[own], beam)
        graph[own] = robust_prune(x, own, np.hstack([found, graph[own]]), degree, alpha)
        # Edges back: what each target gets, sorted into rows.
        source, target = np.repeat(own, degree), graph[own].ravel()
        source, target = source[target >= 0], target[target >= 0]
        by = np.argsort(target, kind="stable")
        source, target = source[by], target[by]
        nodes, first, many = np.unique(target, return_index=True, return_counts=True)
        for low in range(0, len(nodes), 512):
            part = slice(low, low + 512)
            width = many[part].max()
            column = np.arange(width)
            pos = np.minimum(first[part, None] + column, len(source) - 1)
            new = np.where(column < many[part, None], source[pos], -1)
            graph[nodes[part]] = robust_prune(x, nodes[part], np.hstack([graph[nodes[part]], new]), degree, alpha)
        at, size = at + size, min(512, size * 2)
    return graph, entries


def _clean(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    v = F.col(vector_column).cast("array<double>")
    rows = vectors.select(F.col(id_column).cast("long").alias("vec_id"), v.alias("v")).where("vec_id is not null and size(v) > 0")
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.where(~F.coalesce(bad, F.lit(True)) & F.exists("v", lambda x: x != 0))
    return rows.groupBy("vec_id").agg(F.min("v").alias("v"))


def index(rows: DataFrame, k: int) -> tuple[DataFrame, int]:
    """One row a shard (shard, body): vectors, ids, graph and entries.  ``rows``
    (vec_id, v) as _clean() gives them."""
    first = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    nodes = rows.withColumn("r", first).where(F.col("r") <= k + 1).groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    nodes = save(nodes, "ann-nodes")
    shards = 1 + nodes.count() // SHARD_ROWS
    dealt = nodes.withColumn("shard", F.pmod(F.xxhash64("v"), F.lit(shards)).cast("int"))

    def make(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("ids", key=lambda c: c.map(lambda ids: ids[0]))
        sizes = part["v"].map(len)
        bodies = []
        for _, own in part.groupby(sizes):
            raw = np.stack(own["v"].to_numpy())
            ids = np.full((len(own), k + 1), -1, np.int64)
            for i, few in enumerate(own["ids"]):
                ids[i, : len(few)] = few
            bodies.append(Shard.of(raw, ids))
        return pd.DataFrame({"shard": [int(part["shard"].iloc[0])], "body": [pickle.dumps(bodies, protocol=5)]})

    return save(dealt.groupBy("shard").applyInPandas(make, "shard int, body binary"), "ann-index"), shards


def _scaled(raw: np.ndarray) -> np.ndarray:
    """Each vector (last axis) times a power of two that brings it near 1."""
    return np.ldexp(raw, -np.frexp(np.abs(raw).max(-1, keepdims=True))[1])


def _unit(raw: np.ndarray) -> np.ndarray:
    scaled = _scaled(raw)
    return (scaled / np.linalg.norm(scaled, axis=1, keepdims=True)).astype(np.float32)


def _cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of the double vectors a[i] and b[i, j]."""
    a, b = _scaled(a), _scaled(b)
    dot = (a[:, None, :] * b).sum(2)
    return dot / (np.sqrt((a * a).sum(1))[:, None] * np.sqrt((b * b).sum(2)))


@dataclass
class Shard:
    """A searchable shard of vectors of one length."""

    raw: np.ndarray  # (n, d) doubles
    ids: np.ndarray  # (n, k + 1), -1 where a vector has fewer
    x: np.ndarray  # (m, d) the distinct directions, float32 unit vectors
    members: np.ndarray  # rows of raw, direction by direction
    starts: np.ndarray  # (m + 1,) where each direction's members start
    graph: np.ndarray
    entries: np.ndarray

    @classmethod
    def of(cls, raw: np.ndarray, ids: np.ndarray) -> "Shard":
        """Vectors of one direction are one node of the graph: among equals, pruning
        would cut the edges that lead to them."""
        x, where, many = np.unique(_unit(raw), axis=0, return_inverse=True, return_counts=True)
        graph, entries = build_graph(x)
        return cls(raw, ids, x, np.argsort(where.ravel(), kind="stable"), np.append(0, np.cumsum(many)), graph.astype(np.int32), entries)

    def search(self, q: np.ndarray, k: int, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
        """Rows of raw (-1: none) and exact cosines that hold each query's k + 1 best
        found and all that tie with the last of these."""
        n = len(self.x)
        if beam < n:
            nodes, _ = beam_search(self.x, self.graph, self.entries, _unit(q), beam)
        else:  # the beam holds the shard
            nodes = np.tile(np.arange(n), (len(q), 1))
        if len(self.members) == n:
            found = np.where(nodes >= 0, self.members[nodes], -1)
        else:
            own = [np.concatenate([self.members[self.starts[j] : self.starts[j + 1]] for j in row[row >= 0]]) for row in nodes]
            found = np.full((len(q), max(map(len, own))), -1)
            for i, rows in enumerate(own):
                found[i, : len(rows)] = rows
        score = np.where(found >= 0, _cosines(q, self.raw[found]), -np.inf)
        kth = -np.sort(-score, 1)[:, min(k, score.shape[1] - 1)]
        # The last found ties with the k-th, or the graph led to fewer nodes than asked for.
        tied = (np.where(found >= 0, score, np.inf).min(1) >= kth) | ((nodes >= 0).sum(1) < min(beam, n))
        if beam < n and tied.any():
            at = np.flatnonzero(tied)
            more, wider = self.search(q[at], k, min(n, 4 * beam))
            room = max(found.shape[1], more.shape[1])
            found = np.pad(found, ((0, 0), (0, room - found.shape[1])), constant_values=-1)
            score = np.pad(score, ((0, 0), (0, room - score.shape[1])), constant_values=-np.inf)
            found[at], score[at] = -1, -np.inf
            found[at, : more.shape[1]], score[at, : more.shape[1]] = more, wider
        return found, score


def nearest(vectors: DataFrame, k: int = 5, every: int = 50, id_column: str = "vec_id", vector_column: str = "embedding", beam: int = BEAM) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose id is divisible by
    ``every`` its ``k`` nearest found, ties to the smaller id."""
    rows = save(_clean(vectors, id_column, vector_column), "ann-rows")
    shards_of, shards = index(rows, k)
    queries = rows.where(F.col("vec_id") % every == 0)
    blocks = 1 + queries.count() // QUERY_BLOCK
    left = shards_of.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = queries.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))

    def search(shard: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(shard) and len(asked):
            for body in pickle.loads(shard["body"].iloc[0]):
                own = asked[asked["v"].map(len) == body.raw.shape[1]]
                for low in range(0, len(own), 256):
                    part = own.iloc[low : low + 256]
                    q = np.stack(part["v"].to_numpy())
                    found, score = body.search(q, k, beam)
                    names = np.where((found >= 0)[:, :, None], body.ids[found], -1)
                    me = part["vec_id"].to_numpy()
                    names[names == me[:, None, None]] = -1
                    score = np.repeat(score[:, :, None], k + 1, 2).reshape(len(part), -1)
                    names = names.reshape(len(part), -1)
                    score[names < 0] = -np.inf
                    order = np.lexsort((names, -score), axis=1)[:, :k]
                    out.append(pd.DataFrame({"query_id": np.repeat(me, order.shape[1]), "vec_id": np.take_along_axis(names, order, 1).ravel(), "score": np.take_along_axis(score, order, 1).ravel()}))
        if not out:
            return pd.DataFrame({"query_id": pd.Series([], dtype="int64"), "vec_id": pd.Series([], dtype="int64"), "score": pd.Series([], dtype="float64")})
        whole = pd.concat(out)
        return whole[whole["score"] > -np.inf]

    found = left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInPandas(search, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
