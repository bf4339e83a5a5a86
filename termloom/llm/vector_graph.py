"""Embedding near-dedup on a robust-pruned flat graph, audited, with an exact comparison where the graph isn't enough.

Vectors that are equal once scaled to unit length in double precision are one class from the start. Centroids are
fitted on a bounded sample (``SAMPLE`` classes, at most ``MAX_CLUSTERS`` centroids); every class has a home cluster.

*Shards.* A class belongs to the shards of its ``OVERLAP`` nearest clusters among those that can hold a link of it.

*Build.* In each shard, every class's ``CANDIDATES`` nearest are pruned robustly to ``DEGREE`` at most: one goes where a
nearer one kept is nearer to it by the factor ``ALPHA``. The lists that a class gets in its shards are united.

*Search.* Over the united lists, both ways, within a shard: from the shard's medoid each class walks greedily to where it
finds nothing nearer, and from there and from its own neighbours the search widens through all that is in range, until
nothing new is. Classes in range of very many are compared with the whole shard instead. Every link is verified, near the
threshold in double precision, found by either end counts for both, and counts in one shard only. Tasks return counts and
one root for each member, no pairs.

*Audit.* ``AUDITED`` sampled classes are compared with all others, without clusters. If the graph has found less than
``RECALL`` of their links, over all or in the mean of the classes, as where a group of near copies spreads over more clusters than shards overlap, or if a shard has
more than ``MAX_SHARD`` members, all classes are compared exactly instead.

*Exact comparison.* A class asks in every cluster that can hold a link of it: what is at home in cluster k is at least as
near to k's centroid as to any other, so a link of a class at home in h is in k only if the class is within the
threshold's angle of the plane between h's centroid and k's. No number of clusters bounds this. Of two clusters one asks
the other. Askers and those at home are parted by hash into ``MAX_SHARD`` at most and each part asks in each part, so a
hot cluster costs more tasks, never a larger one, and no link. Comparisons grow with the square of the number of classes.
The audit is made again; other counts than its own are an error now.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from termloom.functions.components import connected_components
from termloom.functions.shared import staged
from termloom.llm.common import narrow, table

#: Sampled classes that centroids are fitted on, or four a centroid if that is more (65,536 at the most).
SAMPLE, MAX_CLUSTERS, MAX_SHARD = 20_000, 16_384, 12_288
#: Classes at home in a cluster, in the mean, while there are clusters enough.
HOME, OVERLAP = 2048, 3
CANDIDATES, DEGREE, ALPHA = 48, 32, 1.2
#: A class in range of more than this share of a shard is compared with all of it.
DENSE = 1 / 32
AUDITED, RECALL, BLOCK = 1024, 0.97, 256


def _matrix(v) -> np.ndarray:
    return np.frombuffer(b"".join(v), np.float64).reshape(len(v), -1)


def unit_vectors(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """``(_id, dim, v)``: ``v`` the unit vector as 64-bit floats, null for vectors that link with nothing."""
    kind = dict(vectors.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for x in batch.column(1):
                a = np.array(x.as_py() or [], np.float64)  # a null component becomes nan
                top = np.abs(a).max(initial=0.0)
                ok = len(a) and np.isfinite(a).all() and top > 0
                a = a / top if ok else a
                out.append((a / np.sqrt(a @ a) + 0.0).tobytes() if ok else None)
            dims = pa.array([len(b) // 8 if b else 0 for b in out], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), dims, pa.array(out, pa.binary())], ["_id", "dim", "v"])

    own = narrow(vectors, _id=id_col, x=vec_col).withColumn("x", F.col("x").cast("array<double>"))
    return own.mapInArrow(run, f"_id {kind}, dim int, v binary")


def fit_centroids(x: np.ndarray, k: int, rounds: int = 6) -> np.ndarray:
    """Unit vectors, ``k`` at the most; a centroid that nothing is nearest to stays where it was."""
    c = x[np.random.default_rng(11).choice(len(x), k, replace=False)].copy()
    for _ in range(rounds if 1 < k <= 2048 else 2 if k > 1 else 0):
        at = np.concatenate([(x[i : i + 256] @ c.T).argmax(1) for i in range(0, len(x), 256)])
        order = np.argsort(at, kind="stable")
        begin = np.flatnonzero(np.r_[True, np.diff(at[order]) > 0])
        s = np.add.reduceat(x[order], begin)
        c[at[order][begin]] = s / np.maximum(np.linalg.norm(s, axis=1, keepdims=True), 1e-12)
    return c


def lowest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest number that links a-b reach from each of 0 to n - 1."""
    low = np.arange(n)
    while True:
        new = low.copy()
        np.minimum.at(new, a, low[b])
        np.minimum.at(new, b, low[a])
        new = new[new]
        if (new == low).all():
            return low
        low = new


def united(low: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``low`` with the links a-b added."""
    a, b = low[a], low[b]
    on = a != b
    return lowest(len(low), a[on], b[on])[low] if on.any() else low


def in_range(q: np.ndarray, x: np.ndarray, threshold: float) -> Iterator[tuple[int, np.ndarray]]:
    """First row and hits (rows of ``q`` by rows of ``x``) of each block; only cosines near the threshold need doubles."""
    slack = 1e-5 + q.shape[1] * 2.0**-23 if len(q) else 0
    f, g = q.astype(np.float32), x.astype(np.float32)
    for lo in range(0, len(q), BLOCK):
        s = f[lo : lo + BLOCK] @ g.T
        hit = s >= threshold - slack
        i, j = np.nonzero(hit & (s < threshold + slack))
        for at in range(0, len(i), 10_000):
            k, t = i[at : at + 10_000], j[at : at + 10_000]
            hit[k, t] = np.einsum("pd,pd->p", q[lo + k], x[t]) >= threshold
        yield lo, hit


def placements(v: np.ndarray, c: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """The home cluster of each row of ``v`` and its ``OVERLAP`` nearest clusters, -1 in place of those that can hold no link of it."""
    homes, nears = [], []
    few = min(OVERLAP, len(c))
    angle = np.sqrt(max(1 - threshold**2, 0))
    for lo in range(0, len(v), BLOCK):
        s = v[lo : lo + BLOCK] @ c.T
        row = np.arange(len(s))[:, None]
        top = np.argpartition(-s, few - 1, 1)[:, :few] if few < len(c) else np.tile(np.arange(len(c)), (len(s), 1))
        home = s.argmax(1)
        gap = np.sqrt(np.maximum(((c[top] - c[home][:, None]) ** 2).sum(2), 0))
        can = (s[row, home[:, None]] - s[row, top] <= gap * angle + 1e-9) | (threshold <= 0)
        homes.append(home)
        nears.append(np.where(can, top, -1))
    return np.concatenate(homes), np.concatenate(nears)


def probes(v: np.ndarray, c: np.ndarray, home: int, threshold: float) -> np.ndarray:
    """Whether each cluster can hold a vector in range of ``v``, at home in ``home``. Centroids are unit vectors."""
    if threshold <= 0:
        return np.ones(len(c), bool)
    s = c @ v
    gap = np.sqrt(np.maximum(((c - c[home]) ** 2).sum(1), 0))
    return s[home] - s <= gap * np.sqrt(max(1 - threshold**2, 0)) + 1e-9


def _audit(classes: DataFrame, per_node: DataFrame, threshold: float) -> dict:
    """Links of ``AUDITED`` classes, compared with every class, and as counted; ``share``: of a class's links found, the mean of classes with any."""
    sample = classes.orderBy(F.xxhash64(F.lit(2), "node"), "node").limit(AUDITED).select("node", "dim", "v").collect()
    by_dim = {d: ([r["node"] for r in sample if r["dim"] == d], _matrix([bytes(r["v"]) for r in sample if r["dim"] == d])) for d in {r["dim"] for r in sample}}
    held = classes.sparkSession.sparkContext.broadcast(by_dim)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of = np.array(batch.column(1).to_pylist())
            for dim, (nodes, q) in held.value.items():
                if not (mine := np.flatnonzero(of == dim)).size:
                    continue
                number, n = {node: i for i, node in enumerate(nodes)}, np.zeros(len(nodes))
                for lo in range(0, len(mine), 1000):
                    row = batch.take(pa.array(mine[lo : lo + 1000]))
                    hit = q @ _matrix(row.column(3).to_pylist()).T >= threshold
                    for j, node in enumerate(row.column(0).to_pylist()):
                        if (i := number.get(node)) is not None:
                            hit[i, j] = False
                    n += hit @ row.column(2).to_numpy().astype(np.float64)
                yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.string()), pa.array(n.astype(np.int64))], ["node", "n"])

    true = {r["node"]: r["n"] for r in classes.select("node", "dim", "m", "v").mapInArrow(run, "node string, n long").groupBy("node").agg(F.sum("n").alias("n")).collect()}
    found = {r["node"]: r["links"] for r in per_node.where(F.col("node").isin(list(true))).collect()}
    shares = [found.get(node, 0) / n for node, n in true.items() if n]
    return {"true": sum(true.values()), "found": sum(found.values()), "share": sum(shares) / max(len(shares), 1) if shares else 1.0}


def robust_pruned(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(from, to)``: the pruned lists of the rows of ``x``, unit vectors."""
    n = len(x)
    k = min(CANDIDATES, n - 1)
    if k < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    near, f = np.empty((n, k), np.int64), x.astype(np.float32)
    for lo in range(0, n, BLOCK):
        s = f[lo : lo + BLOCK] @ f.T
        s[np.arange(len(s)), np.arange(lo, lo + len(s))] = -2
        top = np.argpartition(s, n - k - 1, 1)[:, n - k :] if k < n - 1 else np.argsort(s, 1)[:, 1:]
        near[lo : lo + len(s)] = np.take_along_axis(top, np.argsort(-np.take_along_axis(s, top, 1), 1, kind="stable"), 1)
    kept = np.zeros((n, k), bool)
    for lo in range(0, n, BLOCK):
        c = f[near[lo : lo + BLOCK]]  # candidates, the nearest first
        mine = np.maximum(0, 2 - 2 * np.einsum("bd,bkd->bk", f[lo : lo + BLOCK], c))
        between = np.maximum(0, 2 - 2 * c @ c.transpose(0, 2, 1))  # squared distances
        left, out = np.ones(mine.shape, bool), kept[lo : lo + BLOCK]
        for j in range(k):
            out[:, j] = left[:, j] & (out.sum(1) < DEGREE)
            left &= ~(out[:, j, None] & (ALPHA**2 * between[:, j] <= mine))
    i, j = np.nonzero(kept)
    return i, near[i, j]


class FlatGraph:
    """The graph of a shard: unit vectors ``x`` and edges, each walked both ways."""

    def __init__(self, x: np.ndarray, a: np.ndarray, b: np.ndarray):
        self.x, self.f = x, x.astype(np.float32)
        both = np.unique(np.concatenate([a * len(x) + b, b * len(x) + a]))
        self.to = both % max(len(x), 1)
        self.at = np.r_[0, np.cumsum(np.bincount(both // max(len(x), 1), minlength=len(x)))]
        mean = x.sum(0)
        self.medoid = int((x @ mean).argmax()) if len(x) else 0
        self.slack = 1e-5 + (x.shape[1] if len(x) else 0) * 2.0**-23

    def neighbours(self, q: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each query with every neighbour of its node."""
        n = self.at[u + 1] - self.at[u]
        place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return np.repeat(q, n), self.to[np.repeat(self.at[u], n) + place]

    def cosines(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        out = np.empty(len(i), np.float32)
        for lo in range(0, len(i), 1 << 16):
            out[lo : lo + (1 << 16)] = np.einsum("pd,pd->p", self.f[i[lo : lo + (1 << 16)]], self.f[j[lo : lo + (1 << 16)]])
        return out

    def walk(self, q: np.ndarray) -> np.ndarray:
        """Where a greedy walk from the medoid ends for each of the nodes ``q``, which it steps around."""
        here = np.full(len(q), self.medoid)
        best = np.where(here == q, -2, self.cosines(q, here))
        going = np.arange(len(q))
        while len(going):
            k, w = self.neighbours(going, here[going])
            on = w != q[k]
            k, w = k[on], w[on]
            s = self.cosines(q[k], w)
            order = np.lexsort((-s, k))
            first = order[np.r_[True, np.diff(k[order]) > 0]] if len(order) else order
            better = first[s[first] > best[k[first]]]
            going = k[better]
            here[going], best[going] = w[better], s[better]
        return here

    def in_range(self, lo: int, hi: int, threshold: float) -> np.ndarray:
        """Verified links of the nodes ``lo`` to ``hi - 1``, by nodes."""
        n, size = len(self.x), hi - lo
        seen, hit = np.zeros((size, n), bool), np.zeros((size, n), bool)
        q = np.arange(size)
        seen[q, lo + q] = True
        k, w = self.neighbours(q, lo + q)
        k, w = np.concatenate([k, q]), np.concatenate([w, self.walk(lo + q)])
        while len(k):
            flat = np.unique(k * n + w)
            flat = flat[~seen.ravel()[flat]]
            seen.ravel()[flat] = True
            k, w = flat // n, flat % n
            s = self.cosines(lo + k, w)
            ok = s >= threshold - self.slack
            unsure = np.flatnonzero(ok & (s < threshold + self.slack))
            ok[unsure] = np.einsum("pd,pd->p", self.x[lo + k[unsure]], self.x[w[unsure]]) >= threshold
            hit[k[ok], w[ok]] = True
            dense = np.flatnonzero(np.bincount(k[ok], minlength=size) > DENSE * n)
            for at, rows in in_range(self.x[lo + dense], self.x, threshold):
                hit[dense[at : at + len(rows)]] = rows
            hit[q, lo + q] = False
            on = ok & ~np.isin(k, dense)
            k, w = self.neighbours(k[on], w[on])
        return hit


def graph_links(x: np.ndarray, m: np.ndarray, near: np.ndarray, shard: int, edges: tuple[np.ndarray, np.ndarray], threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Number of links and root of each row of a shard; ``m``: how many vectors a row stands for; ``near``: the shards of each row, -1 for none.

    A pair counts in the first of the shards that both are in.
    """
    n = len(x)
    graph = FlatGraph(x, *edges)
    found = np.zeros((n, -(-n // 8)), np.uint8)
    for lo in range(0, n, BLOCK):
        found[lo : lo + BLOCK] = np.packbits(graph.in_range(lo, min(lo + BLOCK, n), threshold), 1)
    links, low = np.zeros(n), np.arange(n)
    for lo in range(0, n, BLOCK):
        hi = min(lo + BLOCK, n)
        hit = np.unpackbits(found[lo:hi], 1, n).astype(bool)
        hit |= np.unpackbits(found[:, lo // 8 : -(-hi // 8)], 1, hi - lo).astype(bool).T  # found by the other end
        i, j = np.nonzero(hit)
        for at in range(0, len(i), 1 << 18):
            p, r = i[at : at + (1 << 18)], j[at : at + (1 << 18)]
            same = (near[lo + p][:, :, None] == near[r][:, None, :]) & (near[r] >= 0)[:, None, :]
            first = np.where(same, near[r][:, None, :], np.iinfo(near.dtype).max).min((1, 2))
            hit[p[first != shard], r[first != shard]] = False
        links[lo:hi] += hit @ m
        i, j = np.nonzero(hit)
        low = united(low, lo + i, j)
    return links, low


def _graph_hits(member: DataFrame, threshold: float) -> DataFrame:
    """``(node, links, root)`` by build, union and search; ``member (node, dim, m, v, near)``."""
    key = F.xxhash64("node")  # a number for the lists: two classes with one number would only add an edge
    dealt = member.withColumn("id", key).select("node", "id", "dim", "m", "v", "near", F.explode("near").alias("shard"))

    def build(of: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        i, j = robust_pruned(_matrix(pdf["v"].tolist()))
        ids = pdf["id"].to_numpy()
        lists = [[] for _ in range(len(ids))]
        for a, b in zip(i.tolist(), ids[j].tolist()):
            lists[a].append(b)
        return pd.DataFrame({"id": ids, "to": lists})

    built = dealt.select("dim", "shard", "id", "v").groupBy("dim", "shard").applyInPandas(build, "id long, to array<long>")
    united_ = staged(built.groupBy("id").agg(F.array_distinct(F.flatten(F.collect_list("to"))).alias("to")), "vec-lists")  # OVERLAP lists of DEGREE at most

    def search(of: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node", ignore_index=True)
        names, ids = pdf["node"].to_numpy(object), pdf["id"].to_numpy()
        near = np.full((len(names), OVERLAP), -1, np.int32)
        for k, row in enumerate(pdf["near"]):
            near[k, : len(row)] = row
        order = np.argsort(ids, kind="stable")
        size = [len(t) for t in pdf["to"]]
        a, to = np.repeat(np.arange(len(names)), size), np.concatenate([np.asarray(t, np.int64) for t in pdf["to"]])
        at = np.minimum(np.searchsorted(ids[order], to), len(ids) - 1)
        here = ids[order][at] == to  # the others are in another shard
        x = _matrix(pdf["v"].tolist())
        m = pdf["m"].to_numpy(np.float64)
        del pdf
        links, low = graph_links(x, m, near, int(of[1]), (a[here], order[at[here]]), threshold)
        out = np.flatnonzero(links > 0)
        return pd.DataFrame({"node": names[out], "links": links[out].astype(np.int64), "root": names[low[out]]})

    asking = dealt.join(united_, "id").select("dim", "shard", "node", "id", "m", "v", "near", "to")
    return staged(asking.groupBy("dim", "shard").applyInPandas(search, "node string, links long, root string"), "vec-graph-hits")


def _exact_hits(member: DataFrame, held, threshold: float) -> DataFrame:
    """``(node, links, root)`` by comparison in blocks; ``member (node, dim, m, v, home)``, ``held``: the broadcast centroids."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            homes, asks = [], []
            for dim, v, h in zip(*(batch.column(k).to_pylist() for k in (1, 3, 4))):
                c = held.value.get(dim)
                can = np.ones(1, bool) if c is None else probes(np.frombuffer(v), c, h, threshold)
                homes.append(f"{dim}/{h}")
                # of two clusters the same one always asks: half of all others for each
                asks.append([f"{dim}/{k}" for k in np.flatnonzero(can) if k == h or (k < h) == ((k + h) % 2 == 0)])
            cols = [batch.column(0), batch.column(2), batch.column(3), pa.array(homes, pa.string()), pa.array(asks, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(cols, ["node", "m", "v", "home", "asks"])

    rows = member.select("node", "dim", "m", "v", "home").mapInArrow(ask, "node string, m long, v binary, home string, asks array<string>")
    member = staged(rows, "vec-askers")
    at_home = member.groupBy(F.col("home").alias("shard")).agg(F.count("*").alias("n_to"))
    askers = member.select(F.explode("asks").alias("shard")).groupBy("shard").agg(F.count("*").alias("n_from"))
    # a row a cluster
    parts = F.broadcast(staged(at_home.join(askers, "shard").select("shard", F.ceil(F.col("n_to") / MAX_SHARD).alias("n_j"), F.ceil(F.col("n_from") / MAX_SHARD).alias("n_i")), "vec-parts"))
    part_of = lambda parts, salt: F.pmod(F.xxhash64(F.lit(salt), "node"), F.col(parts))
    all_of = lambda parts: F.explode(F.sequence(F.lit(0).cast("long"), F.col(parts) - 1))
    asking = member.select("node", "m", "v", "home", F.explode("asks").alias("shard")).join(parts, "shard")
    asked = member.select("node", "m", "v", "home", F.col("home").alias("shard")).join(parts, "shard")
    dealt = asking.select("shard", "node", "m", "v", "home", F.lit(True).alias("query"), part_of("n_i", 8).alias("i"), all_of("n_j").alias("j")).unionByName(
        asked.select("shard", "node", "m", "v", "home", F.lit(False).alias("query"), all_of("n_i").alias("i"), part_of("n_j", 9).alias("j"))
    )

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["query", "node"], ignore_index=True)
        cut = int((~pdf["query"]).sum())
        names, m, v = pdf["node"].to_numpy(object), pdf["m"].to_numpy(np.float64), pdf["v"].tolist()
        own = (pdf["home"] == pdf["shard"]).to_numpy(bool)[cut:]
        if not cut or cut == len(names):
            return pd.DataFrame({"node": [], "links": [], "root": []})
        x, q = _matrix(v[:cut]), _matrix(v[cut:])
        del pdf, v
        number = {k: i for i, k in enumerate(names[:cut])}
        self_at = np.array([number.get(k, -1) if o else -1 for k, o in zip(names[cut:], own)])
        links, low = np.zeros(len(names)), np.arange(len(names))
        low[cut:][self_at >= 0] = self_at[self_at >= 0]
        for lo, hit in in_range(q, x, threshold):
            k = np.arange(lo, lo + len(hit))
            same = self_at[k] >= 0
            hit[np.flatnonzero(same), self_at[k[same]]] = False
            links[cut + k] += hit @ m[:cut]
            away = ~own[k]  # these aren't asked in their turn
            links[:cut] += m[cut + k[away]] @ hit[away]
            i, j = np.nonzero(hit)
            low = united(low, cut + lo + i, j)
        out = np.flatnonzero((links > 0) | (low != np.arange(len(names))))
        return pd.DataFrame({"node": names[out], "links": links[out].astype(np.int64), "root": names[low[out]]})

    return staged(dealt.groupBy("shard", "i", "j").applyInPandas(compare, "node string, links long, root string"), "vec-hits")


def vector_components(vectors: DataFrame, threshold: float = 0.95, id_col: str = "vec_id", vec_col: str = "embedding") -> tuple[DataFrame, dict]:
    """``(vec_id, n_links, component_id, kept)`` for every row, and the audit: links of the sampled
    classes by plain comparison (``true``) and as found, and by what.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing: no links, their own
    component, kept. Vectors of different lengths don't link. Rows with a null id count as links of others; their
    component is null if it holds no other id, and they aren't kept. Rows with equal ids are vectors of their own. An
    empty table gives no rows.
    """
    spark = vectors.sparkSession
    key = F.concat(F.lower(F.hex(F.xxhash64("dim", "v"))), F.lit("."), F.lower(F.hex(F.xxhash64(F.lit(1), "dim", "v"))))
    units = staged(unit_vectors(vectors, id_col, vec_col).withColumn("node", F.when(F.col("v").isNotNull(), key)), "vec-units")
    classes = staged(
        units.where("v is not null").groupBy("node").agg(F.min("_id").alias("rep"), F.count("*").alias("m"), F.first("dim").alias("dim"), F.first("v").alias("v")),
        "vec-classes",
    )
    total = classes.count()
    clusters = min(MAX_CLUSTERS, max(1, round(total / HOME)))
    sample = classes.orderBy(F.xxhash64("node"), "node").limit(max(SAMPLE, 4 * clusters)).select("dim", "v").collect()
    centroids: dict[int, np.ndarray] = {}
    for dim in {r["dim"] for r in sample}:
        x = _matrix([bytes(r["v"]) for r in sample if r["dim"] == dim])
        centroids[dim] = fit_centroids(x, max(1, min(round(clusters * len(x) / len(sample)), len(x) // 4)))
    held = spark.sparkContext.broadcast(centroids)  # of a length outside the sample all are in one cluster

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = np.array(batch.column(1).to_pylist())
            homes, nears = np.zeros(len(dims), np.int64), np.full((len(dims), OVERLAP), -1)
            nears[:, 0] = 0
            for dim in set(dims.tolist()) & set(held.value):
                at = np.flatnonzero(dims == dim)
                c = held.value[dim]
                homes[at], near = placements(_matrix(batch.column(2).take(pa.array(at)).to_pylist()), c, threshold)
                nears[at] = -1
                nears[at, : near.shape[1]] = near
            cols = [batch.column(0), pa.array(homes, pa.int32()), pa.array([[k for k in sorted(row) if k >= 0] for row in nears.tolist()], pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(cols, ["node", "home", "near"])

    if not total:
        return units.select(F.col("_id").alias("vec_id"), F.lit(0).cast("long").alias("n_links"), F.col("_id").alias("component_id"), F.col("_id").isNotNull().alias("kept")), {"true": 0, "found": 0, "share": 1.0, "by": "graph"}
    placed = classes.select("node", "dim", "v").mapInArrow(place, "node string, home int, near array<int>")
    member = staged(classes.join(placed, "node").select("node", "dim", "m", "v", "home", "near"), "vec-members")
    largest = member.select("dim", F.explode("near").alias("shard")).groupBy("dim", "shard").count().agg(F.max("count")).first()[0]
    audit: dict = {}
    if largest <= MAX_SHARD:
        linked = _graph_hits(member, threshold)
        per_node = staged(linked.groupBy("node").agg(F.sum("links").alias("links")), "vec-links")
        audit = _audit(classes, per_node, threshold)
        audit["by"] = "graph"
    if not audit or min(audit["found"], audit["share"] * audit["true"]) < RECALL * audit["true"]:
        linked = _exact_hits(member, held, threshold)
        per_node = staged(linked.groupBy("node").agg(F.sum("links").alias("links")), "vec-links")
        graph, audit = audit.get("found"), _audit(classes, per_node, threshold)
        audit |= {"by": "exact comparison", "found by the graph": graph}
        # a cosine in the last digits of the threshold may come out either way
        if abs(audit["true"] - audit["found"]) > 1e-3 * audit["true"]:
            raise RuntimeError(f"links of sampled vectors: {audit['found']} found, {audit['true']} by plain comparison")
    comp = connected_components(linked.select(F.col("node").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "cn")
    named = classes.select("node", "rep", "m").join(comp, F.col("node") == F.col("cn"), "left").withColumn("root", F.coalesce("root", "node"))
    least = staged(named.groupBy("root").agg(F.min("rep").alias("least")), "vec-least")  # written, so that a hot root's join can be split
    result = named.join(least, "root").join(per_node, "node", "left").select(F.col("node").alias("_n"), (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("n_links"), "least")
    out = units.select("_id", "node").join(result, F.col("node") == F.col("_n"), "left")
    component = F.when(F.col("node").isNull(), F.col("_id")).otherwise(F.col("least"))
    return out.select(
        F.col("_id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("_id") == component, F.lit(False)).alias("kept"),
    ), audit


def op3_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_components(table(spark, sf_dir, "embeddings"))[0]
