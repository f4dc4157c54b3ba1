"""Most similar vectors for every vector: a hierarchical navigable small-world graph per shard.

Vectors are routed to shards by a coarse quantiser (centroids fitted on a bounded sample, every vector indexed), so a
vector's neighbours are nearly all in its own shard or in those whose centroids are about as near.  In a shard a
hierarchical navigable small-world graph is built by insertion, level by level, with diversified neighbour lists kept
as flat arrays, and searched for all vectors routed there at once, its own as well: greedy descent through the upper
levels, then a beam at the lowest.  A vector's results from all its shards are merged by exact cosine.

Scale: each vector is shuffled once as a member of its shard and once per further shard it asks, which are all those
that are about as near: in a dense region that is split over many shards, each of its vectors asks all of them, and
the work grows with the region's size times its shards; results are ids and cosines.  The number of centroids follows
from the number of vectors; they start from rows of the sample, so a dense region gets many, and shards hold about
``SHARD`` vectors up to ``SHARD * CENTROIDS``, 67 million, vectors (raise CENTROIDS beyond that); one that is larger
than ``MOST`` is divided at random and asked in all its parts, and one that very many ask is searched in several tasks.  Of vectors with one direction (copies) only the
``K + 1`` smallest ids are indexed: they are the nearest of all further copies, which need no search.

Defined results of odd input: null, empty and all-zero vectors, vectors with a value that is not a number and vectors
of a length other than the most frequent one take no part; equal cosines go to the smaller id; fewer than k other
vectors give fewer rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexspark.runtime import cut, parallelism

K = 5
SHARD = 2048  # vectors a centroid is meant for
MOST = 6144  # vectors in one graph
SAMPLE = 65_536  # vectors that the centroids are fitted on, about
CENTROIDS = 32_768  # at most; every one is fitted on eight vectors of the sample at least, so many of them take a larger one
NEAR = 0.18  # a further shard is asked if its centroid's cosine is so close to the best, however many are
LINKS = 12  # neighbours chosen for a vector on each level; with the reverse links twice as many
BEAM = 24  # of a vector in its own shard
VISIT = 14  # of a vector in another shard
EXPAND = 2
BATCH = 256  # nodes inserted at once
TOGETHER = 512  # queries searched for at once: what they have seen fits in the processor's cache
TASK = 16_384  # vectors that a task searches for, about
ASKERS = 16_384  # vectors of other shards that one task searches for
_BROADCAST_ROWS = 200_000  # codes of 8 bytes; beyond that they are joined by shuffle


def fit_centroids(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means; deterministic: starts from evenly spaced rows, empty cells take the worst placed rows."""
    c = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        at, best = np.empty(len(x), np.int64), np.empty(len(x), np.float32)
        for a in range(0, len(x), 4096):
            s = x[a : a + 4096] @ c.T
            at[a : a + 4096] = s.argmax(1)
            best[a : a + 4096] = s.max(1)
        sums = np.zeros_like(c)
        np.add.at(sums, at, x)
        empty = np.flatnonzero(np.bincount(at, minlength=k) == 0)
        sums[empty] = x[np.argsort(best)[: len(empty)]]
        c = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return c


def _levels(ids: np.ndarray) -> np.ndarray:
    """Level of each vector, geometric with ratio 1 / ``LINKS``, from a hash of its id."""
    with np.errstate(over="ignore"):
        h = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(30)
    u = (h >> np.uint64(11)).astype(np.float64) / 2**53
    return np.floor(-np.log(np.maximum(u, 1e-300)) / np.log(LINKS)).astype(int)


class Graph:
    """A navigable graph over unit vectors ``x``: ``links[l]`` is the flat neighbour array of level l, -1 where empty.

    Levels are built from the top; on each, the nodes of the level above come first and the others are inserted in
    batches of ``BATCH``: a batch is searched for in the graph so far, its nodes are compared with each other, and the
    nearest of both, diversified, become neighbours, so construction costs n log n and a batch product per node.
    """

    def __init__(self, x: np.ndarray, ids: np.ndarray):
        self.x = x
        level = _levels(ids)
        top = 0
        while (level > top).sum() > 2 * LINKS:
            top += 1
        above = np.flatnonzero(level > top)
        self.entries = above if len(above) else np.flatnonzero(level >= top)[: 2 * LINKS]
        self.links: list[np.ndarray] = []  # the lowest level last, until all are built
        for at in range(top, -1, -1):
            nodes = np.flatnonzero(level >= at)
            first = self.entries if at == top else np.flatnonzero(level > at)
            self.links.append(np.full((len(x), 2 * LINKS), -1, np.int32))
            self._insert(first, first[:0])
            rest = np.setdiff1d(nodes, first, assume_unique=True)
            for a in range(0, len(rest), BATCH):
                self._insert(rest[a : a + BATCH], first)
        self.links.reverse()

    def _insert(self, batch: np.ndarray, inside: np.ndarray) -> None:
        """Link the nodes of a batch with each other and, where nodes are ``inside`` already, with the graph so far."""
        links, m = self.links[-1], LINKS
        n = len(batch)
        q = self.x[batch]
        g = q @ q.T
        np.fill_diagonal(g, -2.0)
        kc = min(2 * m, n - 1)
        near = np.argpartition(-g, kc - 1, axis=1)[:, :kc] if kc > 0 else np.zeros((n, 0), np.int64)
        cand, sim = batch[near], np.take_along_axis(g, near, 1)
        if len(inside):
            nodes, s = self._beam(q, *self._descend(q, self.links[:-1]), links, 2 * m, 4)
            cand, sim = np.concatenate([cand, nodes], 1), np.concatenate([sim, s], 1)
        order = np.argsort(-sim, axis=1, kind="stable")[:, : 2 * m]
        cand, sim = np.take_along_axis(cand, order, 1), np.take_along_axis(sim, order, 1)
        cand = np.where(sim > -1.5, cand, -1)
        width = cand.shape[1]
        if width == 0:
            return
        between = np.einsum("nid,njd->nij", self.x[cand], self.x[cand])
        chosen = np.zeros((n, width), bool)
        for j in range(width):  # a candidate nearer to a chosen neighbour than to the node adds no direction
            shadow = np.where(chosen, between[:, j, :], -2.0).max(1)
            chosen[:, j] = (sim[:, j] > shadow) & (cand[:, j] >= 0) & (chosen.sum(1) < m)
        spare = (cand >= 0) & ~chosen  # the rest of the list: the nearest that were passed over
        chosen |= spare & (np.cumsum(spare, 1) <= m - chosen.sum(1, keepdims=True))
        place = np.cumsum(chosen, 1) - 1
        r, c = np.nonzero(chosen)
        links[batch[r], place[r, c]] = cand[r, c]
        src, dst, s = batch[r], cand[r, c], sim[r, c]
        fresh = ~(links[dst] == src[:, None]).any(1)
        src, dst, s = src[fresh], dst[fresh], s[fresh]
        order = np.lexsort((-s, dst))
        src, dst, s = src[order], dst[order], s[order]
        nth = np.arange(len(dst)) - np.searchsorted(dst, dst)
        keep = nth < m
        src, dst, s, nth = src[keep], dst[keep], s[keep], nth[keep]
        whom, at = np.unique(dst, return_inverse=True)
        old = links[whom, m:]
        olds = np.where(old >= 0, np.einsum("nd,nmd->nm", self.x[whom], self.x[old]), -2.0)
        new, news = np.full((len(whom), m), -1, np.int32), np.full((len(whom), m), -2.0, np.float32)
        new[at, nth], news[at, nth] = src, s
        # A node keeps the neighbours it chose, which lead away from it too; of its reverse links the nearest stay.
        both, sims = np.concatenate([old, new], 1), np.concatenate([olds, news], 1)
        order = np.argsort(-sims, axis=1, kind="stable")[:, :m]
        links[whom, m:] = np.take_along_axis(both, order, 1)

    def _descend(self, q: np.ndarray, levels: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Node and cosine where greedy descent through ``levels``, from the top, ends for each query."""
        s = q @ self.x[self.entries].T
        at, best = self.entries[s.argmax(1)], s.max(1)
        for links in levels:
            active = np.arange(len(q))
            while len(active):
                nb = links[at[active]]
                sims = np.where(nb >= 0, np.einsum("qd,qmd->qm", q[active], self.x[nb]), -2.0)
                j = sims.argmax(1)
                s1 = sims[np.arange(len(active)), j]
                better = s1 > best[active]
                active, j, s1, nb = active[better], j[better], s1[better], nb[better]
                at[active], best[active] = nb[np.arange(len(active)), j], s1
        return at, best

    def search(self, q: np.ndarray, own: np.ndarray, k: int, width: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
        """(nodes, cosines) of the k best for each query; ``own`` is the query's own node, or -1, and is left out."""
        beam, sims = self._beam(q, *self._descend(q, self.links[:0:-1]), self.links[0], width + 1, EXPAND)
        sims[(beam == own[:, None]) & (own >= 0)[:, None]] = -3.0
        top = np.argsort(-sims, axis=1, kind="stable")[:, :k]
        r = np.arange(len(q))[:, None]
        return np.where(sims[r, top] > -2.5, beam[r, top], -1), sims[r, top]

    def _beam(self, q: np.ndarray, at: np.ndarray, best: np.ndarray, links: np.ndarray, width: int, expand: int) -> tuple[np.ndarray, np.ndarray]:
        """(nodes, cosines) of a beam search from node ``at`` of each query; -1 and -3 where it found fewer."""
        nq, n = len(q), len(self.x)
        beam = np.full((nq, width), -1, np.int64)
        sims = np.full((nq, width), -3.0, np.float32)
        beam[:, 0], sims[:, 0] = at, best
        done = np.ones((nq, width), bool)
        done[:, 0] = False
        known = np.zeros(nq * n, bool)
        known[np.arange(nq) * n + at] = True
        active = np.arange(nq)
        while len(active):
            b, sm, dn = beam[active], sims[active], done[active]
            pick = np.argsort(np.where(dn, 9.0, -sm), axis=1, kind="stable")[:, :expand]
            r = np.arange(len(active))[:, None]
            open_ = ~dn[r, pick]
            dn[r, pick] = True
            nb = np.where(open_[:, :, None], links[b[r, pick]], -1).reshape(len(active), -1)
            flat = active[:, None] * n + nb
            rr, cc = np.nonzero((nb >= 0) & ~known[flat])
            flat = flat[rr, cc]
            known[flat] = True
            if expand > 1:  # a node may come from several expanded neighbours
                order = np.argsort(flat, kind="stable")
                keep = np.ones(len(flat), bool)
                keep[order[1:]] = flat[order[1:]] != flat[order[:-1]]
                rr, cc = rr[keep], cc[keep]
            node = nb[rr, cc]
            new = np.full(nb.shape, -3.0, np.float32)
            new[rr, cc] = np.einsum("ij,ij->i", q[active[rr]], self.x[node])
            alls = np.concatenate([sm, new], 1)
            alln = np.concatenate([b, np.where(new > -3.0, nb, -1)], 1)
            alld = np.concatenate([dn, new <= -3.0], 1)
            top = np.argpartition(-alls, width - 1, axis=1)[:, :width]
            beam[active], sims[active], done[active] = alln[r, top], alls[r, top], alld[r, top]
            active = active[(~done[active]).any(1)]
        return beam, sims


def _units(raw: np.ndarray) -> np.ndarray:
    x = raw.astype(np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _stack(column: pd.Series, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Raw vectors of the given length, and which rows they are."""
    fit = np.array([v is not None and len(v) == dim for v in column], bool)
    raw = np.stack(column[fit].to_numpy()).astype(np.float32) if fit.any() else np.zeros((0, dim), np.float32)
    good = np.isfinite(raw).all(1) & (np.abs(raw) > 0).any(1)
    return raw[good], np.flatnonzero(fit)[good]


def nearest(vectors: DataFrame, k: int = K) -> DataFrame:
    """(id, other, cosine, rank): the k most similar other vectors of every vector (id long, v array<float>)."""
    spark = vectors.sparkSession
    usable = vectors.where("v is not null and size(v) > 0")
    lengths = usable.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    schema = "id long, other long, cosine double, rank int"
    if not lengths:
        return spark.createDataFrame([], schema)
    dim, total = lengths[0]["d"], lengths[0]["count"]
    cells = int(min(max(1, total // SHARD), CENTROIDS))
    share = min(1.0, max(SAMPLE, 8 * cells) / total)  # a sample of about SAMPLE vectors, eight times CENTROIDS at most
    rows = usable.where((F.size("v") == dim) & (F.pmod(F.xxhash64("id"), F.lit(1 << 40)) < int(share * (1 << 40)))).select("id", "v").toPandas().sort_values("id")
    raw, _ = _stack(rows["v"], dim)
    if not len(raw):
        return spark.createDataFrame([], schema)
    del rows
    raw /= np.linalg.norm(raw, axis=1, keepdims=True)
    cells = min(cells, max(1, len(raw) // 8))
    centroids = spark.sparkContext.broadcast(fit_centroids(raw, cells))
    del raw

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            raw, at = _stack(b["v"], dim)
            if not len(raw):
                continue
            x = _units(raw)
            s = x.astype(np.float32) @ centroids.value.T
            r, c = np.nonzero(s >= s.max(1, keepdims=True) - NEAR)
            c = c[np.lexsort((c, -s[r, c], r))]  # the own cell is the first
            cells_of = np.split(c, np.cumsum(np.bincount(r, minlength=len(x)))[:-1])
            codes = np.round(x, 6).astype(np.float32) + np.float32(0)
            yield pd.DataFrame(
                {
                    "id": b["id"].to_numpy()[at],
                    "code": np.array([xxhash.xxh64_intdigest(c.tobytes()) for c in codes], np.uint64).view(np.int64),
                    "cells": [own.tolist() for own in cells_of],
                    "raw": [r.tobytes() for r in raw],
                }
            )

    routed = usable.select("id", "v").mapInPandas(route, "id long, code long, cells array<int>, raw binary")
    return _search(routed, dim, k, total)


def _search(routed: DataFrame, dim: int, k: int, total: int) -> DataFrame:
    routed = cut(routed)
    # Copies: only the k + 1 smallest ids of one direction are searched; salted, as one direction may be very frequent.
    few = routed.select("id", "code")
    salted = few.withColumn("n", F.row_number().over(Window.partitionBy("code", F.pmod("id", F.lit(64))).orderBy("id"))).where(F.col("n") <= k + 1)
    firsts = salted.withColumn("n", F.row_number().over(Window.partitionBy("code").orderBy("id"))).where(F.col("n") <= k + 1).select("id", "code", "n")
    crowded = cut(firsts.where(F.col("n") == k + 1).select("code"))
    n_crowded = crowded.count()
    small = F.broadcast(crowded) if n_crowded <= _BROADCAST_ROWS else crowded
    extra, searched = None, routed
    if n_crowded:
        leaders = firsts.join(small, "code").where(F.col("n") <= k).select("code", F.col("id").alias("other"), F.col("n").alias("rank"))
        extra = few.join(small, "code", "left_semi").join(firsts.select("id"), "id", "left_anti").join(leaders, "code").select("id", "other", F.lit(1.0).alias("cosine"), "rank")
        searched = routed.join(small, "code", "left_anti").unionByName(routed.join(small, "code", "left_semi").join(firsts.select("id"), "id", "left_semi"), allowMissingColumns=True)

    sizes = searched.groupBy(F.col("cells")[0].alias("cell")).count()
    parts = sizes.select("cell", F.ceil(F.col("count") / MOST).cast("int").alias("parts"))  # a row per centroid
    asked = searched.select("id", "raw", F.posexplode("cells").alias("nth", "cell")).join(F.broadcast(parts), "cell")
    home = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")
    asked = asked.withColumn("home", home).select("id", "raw", "cell", "home", "nth", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    member = (F.col("nth") == 0) & (F.col("part") == F.col("home"))
    asked = asked.select((F.col("cell").cast("long") * 65536 + F.col("part")).alias("shard"), "id", "raw", member.alias("member"))
    # A shard that many strangers ask is searched in several tasks: its members go to each, the strangers are dealt.
    busy = cut(asked.groupBy("shard").agg(F.count_if(~F.col("member")).alias("n")).where(F.col("n") > ASKERS).select("shard", F.ceil(F.col("n") / ASKERS).cast("int").alias("turns")))
    n_busy = busy.count()
    turn = F.array(F.lit(0))
    if n_busy:
        asked = asked.join(F.broadcast(busy) if n_busy <= _BROADCAST_ROWS else busy, "shard", "left").withColumn("turns", F.coalesce("turns", F.lit(1)))
        turn = F.when(F.col("member"), F.sequence(F.lit(0), F.col("turns") - 1)).otherwise(F.array(F.pmod(F.xxhash64("id", F.lit("turn")), F.col("turns")).cast("int")))
    asked = asked.select("shard", "id", "raw", "member", F.explode(turn).alias("turn"))

    def run(frame):
        ids = frame["id"].to_numpy()
        exact = _units(np.frombuffer(b"".join(frame["raw"]), np.float32).reshape(-1, dim))
        inside = frame["member"].to_numpy()
        where = np.flatnonzero(inside)
        x = exact.astype(np.float32)
        graph = Graph(np.ascontiguousarray(x[where]), ids[where])
        own = np.full(len(ids), -1)
        own[where] = np.arange(len(where))
        asking = np.arange(len(ids)) if frame["turn"].iloc[0] == 0 else np.flatnonzero(~inside)
        out = []
        asking = asking[np.argsort(own[asking] < 0, kind="stable")]
        split = int((own[asking] >= 0).sum())
        for a, e in [(a, min(a + TOGETHER, end)) for begin, end in ((0, split), (split, len(asking))) for a in range(begin, end, TOGETHER)]:
            q = asking[a:e]
            nodes, _ = graph.search(x[q], own[q], k + 3, BEAM if a < split else max(VISIT, k + 3))
            r, c = np.nonzero(nodes >= 0)
            other = where[nodes[r, c]]
            cosine = np.einsum("ij,ij->i", exact[q[r]], exact[other])
            out.append(pd.DataFrame({"id": ids[q[r]], "other": ids[other], "cosine": cosine}))
        return pd.concat(out) if out else pd.DataFrame({"id": ids[:0], "other": ids[:0], "cosine": np.zeros(0)})

    # Tasks by number of vectors, not by bytes: searching is what costs.
    tasks = max(parallelism(routed.sparkSession), -(-total // TASK))
    found = asked.repartition(tasks, "shard", "turn").groupBy("shard", "turn").applyInPandas(run, "id long, other long, cosine double")
    order = Window.partitionBy("id").orderBy(F.desc("cosine"), "other")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    ranked = ranked.select("id", "other", "cosine", "rank")
    return ranked if extra is None else ranked.unionByName(extra)
