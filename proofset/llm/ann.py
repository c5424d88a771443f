"""Approximate nearest neighbours by a permutation index.

A vector is represented by the order of its nearest pivots and posted in the inverted file of its nearest one. Files
of neighbouring numbers are bundled into shards of bounded size; a larger file is dealt over several. A query goes to
the shards that hold the files of its own `visited` nearest pivots (and on, until these hold ten times k rows).
There inverted lists of all places add up, for every vector of a visited file, how much its order agrees with the
query's, which is the footrule distance of the truncated permutations. The best share of what was visited is then
ranked by exact cosine in double precision; the best of all shards are kept.

Pivots are the only fitted part: `pivots` vectors with the smallest hash of their id (a bounded sample). Every vector
is indexed, once; queries of a shard are dealt into blocks, so a task holds a shard and a block of queries.

Defined cases: vectors that are null, empty, all zero, of another dimension than most (the smaller one of equally
many), or hold a null or non-finite component take no part; a component may be as large or small as a double can
be (vectors are scaled by powers of two, which changes no cosine); rows with a query's own id are not its candidates;
a query row that stands twice is answered twice; a candidate row that stands twice is found twice; ties go to the
smaller id; with fewer candidates than k, all are returned; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from proofset.llm.common import block_count, table


def usable(vector: Column) -> Column:
    """Whether a vector takes part; never null."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce(F.forall(vector, finite) & F.exists(vector, lambda x: x != 0), F.lit(False))


def permutations(units: np.ndarray, pivots: np.ndarray, posted: int) -> np.ndarray:
    """The `posted` nearest pivots of each unit vector, nearest first."""
    return np.argsort(-(units @ pivots.T), axis=1, kind="stable")[:, :posted].astype(np.int32)


class InvertedFiles:
    """For each pivot, the block's vectors that have it among their nearest, and its place there."""

    def __init__(self, order: np.ndarray, pivots: int) -> None:
        n, posted = order.shape
        self.n, self.posted = n, posted
        by = np.argsort(order.ravel(), kind="stable")
        self.vector, self.place = (by // posted).astype(np.int32), (by % posted).astype(np.int32)
        self.starts = np.searchsorted(order.ravel()[by], np.arange(pivots + 1))

    def agreement(self, order: np.ndarray) -> np.ndarray:
        """posted * (posted + 1) less the footrule distance to each vector, up to a constant: larger is nearer."""
        out = np.zeros(self.n, np.int32)
        for i, p in enumerate(order.tolist()):
            a, b = self.starts[p], self.starts[p + 1]
            # a shared pivot replaces the distances (posted - i) and (posted - place) by |i - place|
            out[self.vector[a:b]] += 2 * self.posted - i - self.place[a:b] - np.abs(self.place[a:b] - i)
        return out


def scaled(v: np.ndarray) -> np.ndarray:
    """Rows times powers of two, so that the largest component is about 1 and no square overflows or vanishes."""
    return np.ldexp(v, -np.frexp(np.abs(v).max(1, initial=0, keepdims=True))[1])


def unit(v: np.ndarray) -> np.ndarray:
    v = scaled(v)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def bundles(counts: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """First shard, and number of shards, of each pivot's file."""
    first, parts, shard, held = np.zeros(len(counts), np.int64), np.ones(len(counts), np.int64), 0, 0
    for p, n in enumerate(counts.tolist()):
        if held and held + n > most:
            shard, held = shard + 1, 0
        first[p], parts[p] = shard, block_count(n, most)
        held += n
        if parts[p] > 1:
            shard, held = shard + int(parts[p]), 0
    return first, parts


def files_visited(order: np.ndarray, counts: np.ndarray, visited: int, least: int) -> np.ndarray:
    """How many of its nearest pivots' files each query visits."""
    enough = (np.cumsum(counts[order], axis=1) < least).sum(1) + 1
    return np.minimum(order.shape[1], np.maximum(visited, enough))


def search_shard(ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, pivots: np.ndarray, counts: np.ndarray, posted: int, visited: int, share: float, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows (place of the query, vec_id, score)."""
    vectors, queries = scaled(vectors), scaled(queries)
    norm, query_norm = np.linalg.norm(vectors, axis=1), np.linalg.norm(queries, axis=1)
    order = permutations(vectors / norm[:, None], pivots, posted)
    files, home = InvertedFiles(order, len(pivots)), order[:, 0]
    orders = permutations(queries / query_norm[:, None], pivots, len(pivots))
    reach = files_visited(orders, counts, visited, 10 * (k + 1))
    out = []
    for q in range(len(queries)):
        open_ = np.zeros(len(pivots), bool)
        open_[orders[q, : reach[q]]] = True
        near = np.flatnonzero(open_[home] & (ids != query_ids[q]))
        take = max(k, int(np.ceil(share * len(near))))
        if take < len(near):
            near = near[np.argpartition(-files.agreement(orders[q, :posted])[near], take - 1)[:take]]
        score = (vectors[near] @ queries[q]) / (norm[near] * query_norm[q])
        best = np.lexsort((ids[near], -score))[:k]
        out.append((np.full(len(best), q), ids[near][best], score[best]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


def nearest(vectors: DataFrame, is_query: Column, k: int, vec_id: str = "vec_id", vector: str = "embedding", pivots: int = 256, posted: int = 128, visited: int = 224, share: float = 0.3, shard_rows: int = 8192, query_rows: int = 8192) -> DataFrame:
    """query_id, rank, vec_id, score: the k best found of each query row, by cosine."""
    spark = vectors.sparkSession
    kept = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).alias("v"), is_query.alias("q")).filter(F.col("vec_id").isNotNull() & usable(F.col("v").cast("array<double>")))
    schema = "query_id long, rank int, vec_id long, score double"
    common = kept.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if common is None:
        return spark.createDataFrame([], schema)
    dimension = common.d
    kept = kept.filter(F.size("v") == dimension)
    sample = kept.select(F.col("v").cast("array<double>").alias("v"), F.xxhash64("vec_id").alias("h"), "vec_id").orderBy("h", "vec_id").limit(pivots).collect()  # bounded by the parameter
    chosen = spark.sparkContext.broadcast(unit(np.array([r.v for r in sample], np.float64)))
    width = min(posted, len(sample))
    matrix = lambda x: pa.Table.from_batches([x]).column("v").combine_chunks().flatten().to_numpy().astype(np.float64).reshape(-1, dimension)

    def homes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.record_batch([*b.columns, pa.array(permutations(unit(matrix(b)), chosen.value, 1)[:, 0])], names=[*b.schema.names, "home"])

    kind = kept.schema["v"].dataType.simpleString()
    placed = kept.withColumn("h", F.xxhash64("vec_id")).mapInArrow(homes, f"vec_id long, v {kind}, q boolean, h long, home int")
    counts, asked = np.zeros(len(sample), np.int64), 0
    for r in placed.groupBy("home").agg(F.count(F.lit(1)).alias("n"), F.count_if("q").alias("asked")).collect():  # one row a pivot
        counts[r.home], asked = r.n, asked + r.asked
    first, parts = bundles(counts, shard_rows)
    blocks = block_count(asked, query_rows)

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Queries with the shards that they visit."""
        for b in batches:
            if not b.num_rows:
                continue
            order = permutations(unit(matrix(b)), chosen.value, len(counts))
            reach = files_visited(order, counts, visited, 10 * (k + 1))
            to = [np.unique(np.concatenate([first[p] + np.arange(parts[p]) for p in own[:n]])).tolist() for own, n in zip(order, reach, strict=True)]
            yield pa.record_batch([*b.columns, pa.array(to, pa.list_(pa.int32()))], names=[*b.schema.names, "shards"])

    of_pivot = lambda x: F.element_at(F.array(*[F.lit(int(v)) for v in x]), F.col("home") + 1)
    left = placed.select("vec_id", "v", (of_pivot(first) + F.pmod("h", of_pivot(parts))).cast("int").alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    queries = kept.filter("q").select(F.monotonically_increasing_id().alias("query_no"), "vec_id", "v")
    right = queries.mapInArrow(shards, f"query_no long, vec_id long, v {kind}, shards array<int>").select("query_no", "vec_id", "v", F.explode("shards").alias("shard"), F.pmod(F.xxhash64("query_no"), F.lit(blocks)).cast("int").alias("block"))

    def search(t: pa.Table, q: pa.Table) -> pa.Table:
        at, ids, score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        if t.num_rows and q.num_rows:
            at, ids, score = search_shard(t.column("vec_id").to_numpy(), matrix(t.combine_chunks().to_batches()[0]), q.column("vec_id").to_numpy(), matrix(q.combine_chunks().to_batches()[0]), chosen.value, counts, width, visited, share, k)
        return pa.table({"query_no": q.column("query_no").to_numpy()[at], "query_id": q.column("vec_id").to_numpy()[at], "vec_id": ids, "score": score})

    found = left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInArrow(search, "query_no long, query_id long, vec_id long, score double")
    best = F.row_number().over(Window.partitionBy("query_no").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", best).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")


def op5_permutation_index(spark, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)
