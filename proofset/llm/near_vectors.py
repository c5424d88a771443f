"""Near-duplicate vectors by a robust-pruned flat graph.

Equal vectors become one class. Classes are dealt to their `overlap` nearest of some clusters (spherical k-means on a
bounded sample), and a cluster larger than `shard_rows` is cut into parts, so that shards overlap and have a bounded
size. Of each shard a task builds a graph: vectors enter in doubling batches, each by a greedy search from the shard's
medoids whose finds are pruned robustly (of two neighbours in about one direction only the nearer stays). A vector's
adjacency lists of all its shards are united. Then every vector of a cluster is searched in every part of it: greedily
from the medoids, and once a vector within the limit is found, through all neighbours of all such vectors, until no new
one appears. What is found is verified by the cosine of the original vectors in double precision. A pair counts in the
first cluster that both belong to, so tasks return counts and a spanning forest, never pairs.

Recall is audited twice. A task compares its finds for `audit_rows` of its vectors with all similarities, and searches
again with twice the beam if it found less than `target` of the links (a beam as long as the shard finds all). At the
end the links of `audit_sample` vectors are counted against the whole table; with less than `target` found, all is
done again with twice the overlap, up to all clusters, where no link can lie between them.

There are at most `most_clusters` clusters. In larger tables clusters have more parts, which keeps memory bounded and
loses nothing, but then work for each vector grows with the number of parts. So do groups of near copies that are all
different: their links are found one by one, though counted where they are found.

Defined cases: vectors that are null, empty, all zero, or hold a null or non-finite component link with nothing;
vectors of different length never link; equal vectors are linked; components may be as large or small as a double can
be; a repeated row is a row of its own; a null id stands for itself in no component (its component is the smallest id
in it, or null); an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofset.llm.ann import scaled, unit, usable
from proofset.llm.common import block_count, table, written
from proofset.llm.components import components


@dataclass(frozen=True)
class Graph:
    degree: int = 16
    alpha: float = 1.2
    beam: int = 24
    expand: int = 4
    batch: int = 512
    medoids: int = 64
    least_in: int = 3


def _once(keys: np.ndarray, scratch: np.ndarray) -> np.ndarray:
    """Each key once, in the order of their last places."""
    at = np.arange(len(keys), dtype=np.int32)
    scratch[keys] = at
    return keys[scratch[keys] == at]


def greedy(units: np.ndarray, adj: np.ndarray, starts: np.ndarray, queries: np.ndarray, beam: int, expand: int, floor: float = np.inf) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """The `beam` nearest found of each query (ids, nearest first, n for none), the keys (query * (n + 1) + id) of all
    that it met with a cosine of at least `floor`, and which it met at all. It begins with the nearest of the starts;
    each round enters the neighbours of the `expand` best that were not yet entered, of all queries at once. units and
    adj end with a row for "none"."""
    n, b = len(units) - 1, len(queries)
    seen, scratch = np.zeros((b, n + 1), bool), np.empty(b * (n + 1), np.int32)
    seen[:, starts] = seen[:, n] = True
    ids, sims = np.full((b, beam), n, np.int64), np.full((b, beam), -np.inf, np.float32)
    near = queries @ units[starts].T
    q, c = np.nonzero(near >= floor)
    met = [q * (n + 1) + starts[c]]
    first = np.argsort(-near, 1, kind="stable")[:, :beam]
    ids[:, : first.shape[1]], sims[:, : first.shape[1]] = starts[first], np.take_along_axis(near, first, 1)
    entered = ids == n
    active = np.arange(b)
    while len(active):
        open_ = ~entered[active]
        pick = open_ & (np.cumsum(open_, 1) <= expand)
        row, col = np.nonzero(pick)
        entered[active[row], col] = True
        key = ((active[row] * (n + 1))[:, None] + adj[ids[active[row], col]]).ravel()
        key = _once(key[~seen.ravel()[key]], scratch)
        q, c = np.divmod(key, n + 1)
        seen.ravel()[key] = True
        if len(q):
            first = np.flatnonzero(np.diff(q, prepend=-1))
            own, count = q[first], np.diff(first, append=len(q))
            width = int(count.max())
            at = np.arange(len(q)) - np.repeat(first, count)
            place = np.repeat(np.arange(len(own)), count)
            more, score = np.full((len(own), width), n, np.int64), np.full((len(own), width), -np.inf, np.float32)
            dots = np.einsum("ij,ij->i", queries[q], units[c])
            met.append(key[dots >= floor])
            more[place, at], score[place, at] = c, dots
            score = np.concatenate((sims[own], score), 1)
            best = np.argsort(-score, 1, kind="stable")[:, :beam]
            take = lambda x: np.take_along_axis(x, best, 1)
            ids[own], sims[own] = take(np.concatenate((ids[own], more), 1)), take(score)
            entered[own] = take(np.concatenate((entered[own], more == n), 1))
        active = active[~entered[active].all(1)]
    return ids, met, seen


def pruned(units: np.ndarray, at: np.ndarray, near: np.ndarray, degree: int, alpha: float, most: int = 64) -> np.ndarray:
    """Robust pruning: of each point's candidates the nearest stays, and those go that are nearer to it, by a factor of
    alpha, than to the point; and so on, up to `degree`."""
    n = len(units) - 1
    if not near.shape[1]:
        return np.full((len(at), degree), n, np.int64)
    near = np.sort(near, 1)
    near[:, 1:][near[:, 1:] == near[:, :-1]] = n
    near[near == at[:, None]] = n
    own = np.einsum("bcd,bd->bc", units[near], units[at])
    own[near == n] = -np.inf
    best = np.argsort(-own, 1, kind="stable")[:, :most]
    near, own = np.take_along_axis(near, best, 1), np.take_along_axis(own, best, 1)
    v = units[near]
    apart = 2 - 2 * np.matmul(v, v.transpose(0, 2, 1))
    alive, rows = near != n, np.arange(len(at))
    out = np.full((len(at), degree), n, np.int64)
    for k in range(degree):
        first = alive.argmax(1)
        some = alive[rows, first]
        if not some.any():
            break
        out[some, k] = near[rows, first][some]
        alive &= alpha**2 * apart[rows, first] > 2 - 2 * own
        alive[rows, first] = False
    return out


def medoids(v: np.ndarray, k: int) -> np.ndarray:
    """The vector nearest to each of k centres: searches begin there, as one medoid may lie in a group of near copies
    that all point at each other."""
    centres = spherical_means(v, min(k, len(v)), rounds=3)
    return np.unique((v @ centres.T).argmax(0))


def build(v: np.ndarray, how: Graph) -> np.ndarray:
    """Adjacency of unit vectors: n + 1 rows, n for "none". A list is pruned to `degree` when it has grown to twice
    that."""
    n, d = v.shape
    units = np.concatenate((v, np.zeros((1, d), v.dtype)))
    starts = medoids(v, how.medoids)
    rest = np.random.default_rng(n).permutation(n)
    order = np.concatenate((starts, rest[~np.isin(rest, starts)]))
    adj = np.full((n + 1, 2 * how.degree), n, np.int64)
    done = 0
    while done < n:
        now = order[done : done + max(len(starts), min(done, how.batch))]
        among = units[now] @ units[now].T
        np.fill_diagonal(among, -np.inf)
        near = now[np.argsort(-among, 1)[:, : min(8, len(now) - 1)]]
        if done:
            near = np.concatenate((greedy(units, adj, starts, units[now], how.beam, how.expand)[0], near), 1)
        adj[now, : how.degree] = pruned(units, now, near, how.degree, how.alpha)
        to, source = adj[now, : how.degree].ravel(), np.repeat(now, how.degree)  # and the other way round
        to, source = to[to < n], source[to < n]
        by = np.lexsort((-np.einsum("ij,ij->i", units[to], units[source]), to))
        to, source = to[by], source[by]
        own, first, count = np.unique(to, return_index=True, return_counts=True)
        rank = np.arange(len(to)) - np.repeat(first, count)
        width = min(int(count.max(initial=0)), 64)
        more = np.full((len(own), width), n, np.int64)
        fits = rank < width  # the nearest come first
        more[np.repeat(np.arange(len(own)), count)[fits], rank[fits]] = source[fits]
        both = np.sort(np.concatenate((adj[own], more), 1), 1)
        both[:, 1:][both[:, 1:] == both[:, :-1]] = n
        both = np.sort(both, 1)
        full = (both < n).sum(1) > 2 * how.degree
        adj[own[~full]] = both[~full][:, : 2 * how.degree]
        for k in range(0, int(full.sum()), 1024):
            part = np.flatnonzero(full)[k : k + 1024]
            adj[own[part]] = n
            adj[own[part], : how.degree] = pruned(units, own[part], both[part], how.degree, how.alpha)
        done += len(now)
    return reachable(adj, how.least_in)


def reachable(adj: np.ndarray, least: int) -> np.ndarray:
    """Pruning may leave a vector to which no list leads, so that no search meets it: those with fewer than `least`
    enter the lists of that many of their own neighbours, those with the shortest lists first."""
    n = len(adj) - 1
    few = np.flatnonzero(np.bincount(adj[:-1].ravel(), minlength=n + 1)[:n] < least)
    size = (adj < n).sum(1)
    size[n] = n  # no neighbour at all
    host = np.take_along_axis(adj[few], np.argsort(size[adj[few]], 1, kind="stable")[:, :least], 1)
    to, guest = host.ravel(), np.repeat(few, host.shape[1])
    to, guest = to[to < n], guest[to < n]
    by = np.argsort(to, kind="stable")
    to, guest = to[by], guest[by]
    first = np.flatnonzero(np.diff(to, prepend=-1))
    at = np.arange(len(to)) - np.repeat(first, np.diff(first, append=len(to)))
    more = np.full((n + 1, int(at.max(initial=-1)) + 1), n, np.int64)
    more[to, at] = guest
    return np.concatenate((adj, more), 1)


def in_range(units: np.ndarray, adj: np.ndarray, starts: np.ndarray, queries: np.ndarray, floor: float, beam: int, expand: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, id) of all found with a cosine of at least floor: a greedy search, and from all within range on through
    all their neighbours."""
    n = len(units) - 1
    _, met, seen = greedy(units, adj, starts, queries, beam, expand, floor)
    flat, scratch = seen.ravel(), np.empty(seen.size, np.int32)
    now = np.concatenate(met)
    out = [now]
    while len(now):
        fresh = []
        for k in range(0, len(now), 32768):
            q, c = np.divmod(now[k : k + 32768], n + 1)
            key = ((q * (n + 1))[:, None] + adj[c]).ravel()
            key = _once(key[~flat[key]], scratch)
            flat[key] = True
            q, c = np.divmod(key, n + 1)
            fresh.append(key[np.einsum("ij,ij->i", queries[q], units[c]) >= floor])
        now = np.concatenate(fresh)
        out.append(now)
    return np.divmod(np.concatenate(out), n + 1)


def spherical_means(v: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Centres of unit vectors by cosine, deterministic: begun at evenly spread rows."""
    centres = v[np.linspace(0, len(v) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        home = (v @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, home, v)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norm > 0, sums / np.where(norm > 0, norm, 1), centres)
    return centres


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least member of each one's component."""
    label = np.arange(n)
    while True:
        low = label.copy()
        np.minimum.at(low, a, label[b])
        np.minimum.at(low, b, label[a])
        low = low[low]
        if (low == label).all():
            return label
        label = low


def _matrix(t: pa.Table | pa.RecordBatch, column: str, d: int) -> np.ndarray:
    c = t.column(column)
    c = c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c
    return c.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _shard_edges(t: pa.Table, d: int, how: Graph) -> pa.Table:
    """One shard: node and the nodes that its own graph leads to."""
    nodes = t.column("node").to_numpy()
    adj = build(unit(_matrix(t, "v", d).astype(np.float64)).astype(np.float32), how)
    kept = adj[:-1] < len(nodes)
    ends = np.concatenate(([0], np.cumsum(kept.sum(1)))).astype(np.int32)
    return pa.table({"node": nodes, "near": pa.ListArray.from_arrays(ends, nodes[adj[:-1][kept]])})


def _first_common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest number that stands in both rows, row by row."""
    out = np.full(len(a), np.iinfo(np.int32).max)
    for i in range(a.shape[1]):
        for j in range(b.shape[1]):
            same = a[:, i] == b[:, j]
            out[same] = np.minimum(out[same], a[same, i])
    return out


def _search_tile(g: pa.Table, h: pa.Table, d: int, overlap: int, limit: float, how: Graph, audit_rows: int, target: float) -> pa.Table:
    """Vectors of h searched in the graph of g (one shard, or two parts of a cluster). Rows: kind 0: node a has n more
    links; kind 1: a and b are linked (a forest); kind 2: of n links in the audit a were found, with a beam of b."""
    if not (g.num_rows and h.num_rows):
        return pa.table({"kind": pa.array([], pa.int32()), **{c: pa.array([], pa.int64()) for c in "abn"}})
    g = g.sort_by("node")
    mine = g.column("part")[0].as_py() == h.column("part")[0].as_py()
    cluster = g.column("cluster")[0].as_py()
    nodes, asked = g.column("node").to_numpy(), h.column("node").to_numpy()
    exact_g, exact_h = (scaled(_matrix(t, "v", d).astype(np.float64)) for t in (g, h))
    norm_g, norm_h = (np.linalg.norm(x, axis=1) for x in (exact_g, exact_h))
    v = (exact_g / norm_g[:, None]).astype(np.float32)
    queries = (exact_h / norm_h[:, None]).astype(np.float32)
    units = np.concatenate((v, np.zeros((1, d), np.float32)))
    lists = g.column("near").combine_chunks()
    sizes = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy()
    local = np.minimum(np.searchsorted(nodes, flat), len(nodes) - 1)
    local = np.where(nodes[local] == flat, local, len(nodes))  # others are not in this shard
    adj = np.full((len(nodes) + 1, max(1, int(sizes.max(initial=0)))), len(nodes), np.int64)
    adj[np.repeat(np.arange(len(nodes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = local
    starts = medoids(v, how.medoids)
    own_g, own_h = (_matrix(t, "clusters", overlap) for t in (g, h))
    weight_g, weight_h = (t.column("copies").to_numpy() for t in (g, h))
    sample = np.linspace(0, len(asked) - 1, min(audit_rows, len(asked))).astype(int)
    true = (exact_h[sample] @ exact_g.T) / (norm_h[sample][:, None] * norm_g) >= limit
    true &= nodes[None] != asked[sample][:, None]
    beam = min(how.beam, len(nodes))

    def links() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for k in range(0, len(asked), how.batch):
            q, c = in_range(units, adj, starts, queries[k : k + how.batch], limit - 1e-5, beam, how.expand)
            q = q + k
            for s in range(0, len(q), 1 << 17):
                a, b = q[s : s + (1 << 17)], c[s : s + (1 << 17)]
                fine = (asked[a] != nodes[b]) & (np.einsum("ij,ij->i", exact_h[a], exact_g[b]) / (norm_h[a] * norm_g[b]) >= limit)
                yield a[fine], b[fine]

    while True:
        found = np.zeros((len(asked), len(nodes)), bool)
        for a, b in links():
            found[a, b] = True
        hit = int((found[sample] & true).sum())
        if hit >= target * true.sum() or beam >= len(nodes):
            break
        beam = min(2 * beam, len(nodes))
    if mine:  # the same vectors: a link found from either end
        place = np.searchsorted(nodes, asked)
        square = np.zeros((len(nodes), len(nodes)), bool)
        square[place] = found
        found = np.triu(square | square.T, 1)
        asked, own_h, weight_h = nodes, own_g, weight_g
    a, b = np.nonzero(found)
    keep = np.concatenate([_first_common(own_h[a[k : k + (1 << 20)]], own_g[b[k : k + (1 << 20)]]) == cluster for k in range(0, len(a), 1 << 20)]) if len(a) else np.zeros(0, bool)
    a, b = a[keep], b[keep]
    more_h = np.bincount(a, weight_g[b], len(asked)).astype(np.int64)
    more_g = np.bincount(b, weight_h[a], len(nodes)).astype(np.int64)
    both = np.concatenate((asked, nodes))
    names, inverse = np.unique(both, return_inverse=True)
    more = np.zeros(len(names), np.int64)
    np.add.at(more, inverse, np.concatenate((more_h, more_g)))
    x, y = inverse[: len(asked)][a], inverse[len(asked) :][b]
    root = roots(len(names), x, y)
    tied, some = np.flatnonzero(root != np.arange(len(names))), np.flatnonzero(more)
    parts = [(0, names[some], np.zeros(len(some), np.int64), more[some]), (1, names[tied], names[root[tied]], np.zeros(len(tied), np.int64)), (2, np.array([hit]), np.array([beam]), np.array([true.sum()]))]
    return pa.table({"kind": np.concatenate([np.full(len(p[1]), p[0], np.int32) for p in parts]), **{c: np.concatenate([p[k] for p in parts]).astype(np.int64) for k, c in enumerate("abn", 1)}})


def _linked(classes: DataFrame, d: int, n: int, centres: np.ndarray, overlap: int, limit: float, shard_rows: int, how: Graph, audit_rows: int, target: float) -> DataFrame:
    """kind, a, b, n of all tiles: see _search_tile()."""
    spark = classes.sparkSession
    held = spark.sparkContext.broadcast(centres)  # clusters x dimension
    kind = classes.schema["v"].dataType.simpleString()

    def homes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                near = np.argsort(-(unit(_matrix(b, "v", d).astype(np.float64)) @ held.value.T), 1, kind="stable")[:, :overlap].astype(np.int32)
                yield pa.record_batch([*b.columns, pa.FixedSizeListArray.from_arrays(pa.array(near.ravel()), overlap).cast(pa.list_(pa.int32()))], names=[*b.schema.names, "clusters"])

    placed = classes.select("node", "v", "copies").mapInArrow(homes, f"node long, v {kind}, copies long, clusters array<int>")
    placed = placed.select("*", F.explode("clusters").alias("cluster"))
    counts = np.zeros(len(centres), np.int64)
    for r in placed.groupBy("cluster").count().collect():  # one row a cluster
        counts[r.cluster] = r["count"]
    parts = F.element_at(F.array(*[F.lit(block_count(int(c), shard_rows)) for c in counts]), F.col("cluster") + 1)
    placed = placed.withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    edges = placed.groupBy("cluster", "part").applyInArrow(lambda t: _shard_edges(t, d, how), "node long, near array<bigint>")
    united = written(edges.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near")), "vector-graph")  # overlap x degree each
    left = placed.join(united, "node").withColumn("other", F.explode(F.sequence(F.col("part"), F.col("parts") - 1)))
    right = placed.withColumn("first", F.explode(F.sequence(F.lit(0), F.col("part"))))
    left = left.select("cluster", "part", "other", "node", "v", "copies", "clusters", "near")
    right = right.select(F.col("first").alias("of"), *[F.col(c).alias(c) for c in ("cluster", "part", "node", "v", "copies", "clusters")])
    tile = lambda g, h: _search_tile(g, h, d, overlap, limit, how, audit_rows, target)
    return written(left.groupBy("cluster", "part", "other").cogroup(right.groupBy("cluster", "of", "part")).applyInArrow(tile, "kind int, a long, b long, n long"), "vector-links")


def brute_links(classes: DataFrame, d: int, nodes: list[int], vectors: np.ndarray, limit: float) -> dict[int, int]:
    """Links (copies counted) of some vectors against the whole table."""
    spark = classes.sparkSession
    held = spark.sparkContext.broadcast((np.array(nodes), scaled(vectors)))  # the audit's sample

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, q = held.value
        q = q / np.linalg.norm(q, axis=1, keepdims=True)
        total = np.zeros(len(names), np.int64)
        for b in batches:
            if b.num_rows:
                near = q @ unit(_matrix(b, "v", d).astype(np.float64)).T >= limit
                near &= names[:, None] != b.column("node").to_numpy()[None]
                total += near @ b.column("copies").to_numpy()
        yield pa.record_batch([pa.array(names), pa.array(total)], names=["node", "n"])

    rows = classes.select("node", "v", "copies").mapInArrow(count, "node long, n long").groupBy("node").agg(F.sum("n").alias("n")).collect()
    return {r.node: r.n for r in rows}


def _of_dimension(classes: DataFrame, d: int, n: int, limit: float, overlap: int, cluster_rows: int, shard_rows: int, most_clusters: int, sample: int, how: Graph, audit_rows: int, audit_sample: int, target: float) -> DataFrame:
    """node, links, component (null without links)."""
    clusters = min(most_clusters, block_count(n, cluster_rows))
    drawn = classes.select("node", "v").orderBy(F.xxhash64("node"), "node").limit(max(sample, audit_sample)).collect()  # bounded by the parameters
    known = np.array([r.v for r in drawn], np.float64)
    centres = spherical_means(unit(known)[:sample], min(clusters, len(known)))
    names, vectors = [r.node for r in drawn[:audit_sample]], known[:audit_sample]
    true = brute_links(classes, d, names, vectors, limit)
    overlap = min(overlap, len(centres))
    while True:
        found = _linked(classes, d, n, centres, overlap, limit, shard_rows, how, audit_rows, target)
        links = found.filter("kind = 0").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("links"))
        if overlap == len(centres):
            break
        got = {r.node: r.links for r in links.filter(F.col("node").isin(names)).collect()}
        if sum(got.values()) >= target * sum(true.values()):
            break
        overlap = min(2 * overlap, len(centres))
    tied = components(found.filter("kind = 1").select("a", "b"))
    return links.join(tied, "node", "left")


def near_vectors(vectors: DataFrame, limit: float = 0.9, vec_id: str = "vec_id", vector: str = "embedding", overlap: int = 2, cluster_rows: int = 4096, shard_rows: int = 8192, most_clusters: int = 1024, sample: int = 16384, how: Graph = Graph(), audit_rows: int = 64, audit_sample: int = 512, target: float = 0.98) -> DataFrame:
    """vec_id, n_links, component_id, kept: each row with the number of other rows linked with it, and the smallest id
    that links lead to."""
    rows = vectors.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), F.col(f"`{vector}`").alias("v"))
    fine = usable(F.col("v").cast("array<double>"))
    classes = rows.filter(fine).groupBy("v").agg(F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("least"), F.count_if(F.col("vec_id").isNull()).alias("unnamed"))
    classes = written(classes.withColumn("node", F.monotonically_increasing_id()), "vector-classes")
    sizes = sorted((r.d, r.n) for r in classes.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).collect())  # one row a length
    linked = None
    for d, n in sizes:
        part = _of_dimension(classes.filter(F.size("v") == d), d, n, limit, overlap, cluster_rows, shard_rows, most_clusters, sample, how, audit_rows, audit_sample, target)
        linked = part if linked is None else linked.unionByName(part)
    alone = rows.filter(~fine).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    if linked is not None:
        named = classes.join(linked, "node", "left").withColumns({"component": F.coalesce("component", "node"), "n_links": F.coalesce("links", F.lit(0).cast("long")) + F.col("copies") - 1})
        named = written(named.select("node", "v", "copies", "least", "component", "n_links"), "vector-components")
        several = named.filter("component <> node or n_links >= copies")
        least = several.groupBy("component").agg(F.min("least").alias("component_id"))
        known = named.join(least, "component", "left").withColumn("component_id", F.coalesce("component_id", "least"))
        one = known.filter("copies = 1").select(F.col("least").alias("vec_id"), "n_links", "component_id")
        more = rows.filter(fine).join(known.filter("copies > 1").select("v", "n_links", "component_id"), "v").select("vec_id", "n_links", "component_id")
        alone = alone.unionByName(one).unionByName(more)
    return alone.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op12_embedding_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))
