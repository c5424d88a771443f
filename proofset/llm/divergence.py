"""How far the sources of a language differ in their words: a group-term count matrix as a K-squared quadtree.

Groups are (language, source); terms of a language are those in at least `least_docs` of its documents. A group gives
each term p = 1 + floor(10^9 (count + 2) / (N + 2 V)), and two distributions differ by the sum of
floor((p - q)^2 / (p + q)). All of it is integer arithmetic.

Counts are added up inside tasks before the shuffle, then dealt by (language, term). The matrix of a language is cut
into tiles: `tile_groups` x `tile_groups` groups by `tile_terms` terms, a task each. There the nonzero counts of either
side become a quadtree (each level halves rows and columns, a bit for each quadrant with any count). Two trees are
walked together from the root: where both quadrants are all zero, every pair of their groups is priced at once by the
prices of two zeros times the quadrant's terms; otherwise their quadrants are entered; at the leaves, where at least
one count is not zero, the two values are priced. Terms that no tile holds are priced in the same way as one quadrant.

Defined cases: null text, language or source counts as empty; repeated rows are documents of their own; a group without
any term has all terms at a count of zero; a language without kept terms differs by 0 everywhere; texts are read whole,
one document at a time; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from proofset.llm.common import slices, table, utf8, written

SCALE, PRIOR = 1_000_000_000, 2
# A-Z become a-z; other ASCII that is no letter separates; all bytes of other characters belong to terms.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


def term_counts(docs: DataFrame, held: int = 200_000, most_bytes: int = 4_000_000) -> DataFrame:
    """lang, source, term, n (occurrences), docs (documents with it), added up inside a task until it holds `held`."""

    def flush(groups: dict) -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs_) in groups.items():
            terms = list(n)
            size = len(terms)
            yield pa.record_batch([pa.array([lang] * size, pa.string()), pa.array([source] * size, pa.string()), pa.array([t.decode() for t in terms], pa.string()), pa.array(list(n.values()), pa.int64()), pa.array([docs_[t] for t in terms], pa.int64())], names=["lang", "source", "term", "n", "docs"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict = {}
        size = 0
        for b in slices(batches, "text", most_bytes):
            for lang, source, text in zip(b.column("lang").to_pylist(), b.column("source").to_pylist(), utf8(b.column("text")), strict=True):
                n, docs_ = groups.setdefault((lang, source), (Counter(), Counter()))
                before = len(n)
                found = Counter(terms_of(text))
                n.update(found)
                docs_.update(found.keys())
                size += len(n) - before
            if size > held:
                yield from flush(groups)
                groups, size = {}, 0
        yield from flush(groups)

    return docs.mapInArrow(count, "lang string, source string, term string, n long, docs long")


def share(n: str, total: str, terms: str) -> Column:
    """p of a count among `total`, with `terms` terms: exact, whatever its size."""
    wide = lambda c: f"cast({c} as decimal(19,0))"
    return F.expr(f"1L + ({wide(n)} + {PRIOR}) * cast({SCALE} as decimal(10,0)) div ({wide(total)} + {PRIOR} * {wide(terms)})")


def price(p, q):
    """floor((p - q)^2 / (p + q)): Python numbers or numpy arrays of 64 bits, as p and q are at most 10^9 + 1."""
    return (p - q) ** 2 // (p + q)


def price_column(p: str, q: str) -> Column:
    return F.expr(f"({p} - {q}) * ({p} - {q}) div ({p} + {q})")


def interleaved(rows: np.ndarray, cols: np.ndarray, depth: int) -> np.ndarray:
    """Morton codes: of each level one row bit, then one column bit."""
    code = np.zeros(len(rows), np.int64)
    for d in range(depth):
        code |= ((rows >> d & 1) << (2 * d + 1)) | ((cols >> d & 1) << (2 * d))
    return code


class QuadTree:
    """A matrix of nonzero cells as levels of bits: four for each nonzero quadrant of the level above, in Morton order.
    The place of a quadrant below is the number of set bits before its own."""

    def __init__(self, rows: np.ndarray, cols: np.ndarray, values: np.ndarray, depth: int) -> None:
        code = interleaved(rows, cols, depth)
        order = np.argsort(code)
        self.values, code = values[order], code[order]
        self.empty = not len(code)
        self.bits, self.rank = [], []
        above = np.zeros(1, np.int64)
        for level in range(1, depth + 1):
            here = np.unique(code >> 2 * (depth - level))
            bits = np.zeros(4 * len(above), bool)
            bits[4 * np.searchsorted(above, here >> 2) + (here & 3)] = True
            self.bits.append(bits)
            self.rank.append(np.cumsum(bits) - bits)
            above = here

    def child(self, level: int, node: np.ndarray, quadrant: np.ndarray) -> np.ndarray:
        """Places of quadrants of nodes, -1 for all-zero ones (as all quadrants of an all-zero node are)."""
        if self.empty:
            return np.full(len(node), -1)
        at = 4 * np.maximum(node, 0) + quadrant
        return np.where((node >= 0) & self.bits[level][at], self.rank[level][at], -1)


def joint_prices(a: QuadTree, b: QuadTree, zero_a: np.ndarray, zero_b: np.ndarray, terms: int, depth: int, same: bool, most: int = 131_072) -> np.ndarray:
    """Summed prices of each row of a against each row of b over all terms. zero_a, zero_b: a row's value at a count
    of zero. same: a and b are one matrix, of which only pairs of a row and a later one are wanted."""
    n, m = len(zero_a), len(zero_b)
    quiet = [np.zeros((((n - 1) >> s) + 1, ((m - 1) >> s) + 1), np.int64) for s in range(depth + 1)]  # terms of all-zero quadrants
    total = np.zeros((n, m), np.int64)
    # node of a, node of b (-1: all zero), their row prefixes, the column prefix
    stack = [(0, *(np.array([x]) for x in (-1 if a.empty else 0, -1 if b.empty else 0, 0, 0, 0)))]
    while stack:
        level, ia, ib, ra, rb, c = stack.pop()
        s = depth - level
        calm = (ia < 0) & (ib < 0)
        if calm.any():
            first = c[calm] << s
            np.add.at(quiet[s], (ra[calm], rb[calm]), np.minimum(first + (1 << s), terms) - first)
            ia, ib, ra, rb, c = (x[~calm] for x in (ia, ib, ra, rb, c))
        if not len(ia):
            continue
        if s == 0:
            p = np.where(ia >= 0, a.values[np.maximum(ia, 0)] if not a.empty else 0, zero_a[ra])
            q = np.where(ib >= 0, b.values[np.maximum(ib, 0)] if not b.empty else 0, zero_b[rb])
            np.add.at(total, (ra, rb), price(p, q))
            continue
        x, y, z = (np.tile(v, len(ia)) for v in ([0, 0, 0, 0, 1, 1, 1, 1], [0, 0, 1, 1, 0, 0, 1, 1], [0, 1, 0, 1, 0, 1, 0, 1]))
        ia, ib, ra, rb, c = (np.repeat(v, 8) for v in (ia, ib, ra, rb, c))
        ia, ib = a.child(level, ia, 2 * x + z), b.child(level, ib, 2 * y + z)
        ra, rb, c = 2 * ra + x, 2 * rb + y, 2 * c + z
        s -= 1
        inside = (ra << s < n) & (rb << s < m) & (c << s < terms)
        if same:
            inside &= (ra <= rb) if s else (ra < rb)
        ia, ib, ra, rb, c = (v[inside] for v in (ia, ib, ra, rb, c))
        for at in range(0, len(ia), most):
            stack.append((level + 1, *(v[at : at + most] for v in (ia, ib, ra, rb, c))))
    none = price(zero_a[:, None], zero_b[None])
    for s, part in enumerate(quiet):
        i, j = np.arange(n) >> s, np.arange(m) >> s
        total += part[i][:, j] * none
    return total


def _tile(t: pa.Table) -> pa.Table:
    """One tile: rows (no, side, zero, term or null, p). Returns a, b (numbers of groups), value, terms."""
    cells = t.filter(pa.compute.is_valid(t.column("term")))
    coded = cells.column("term").combine_chunks().dictionary_encode() if cells.num_rows else None
    terms = len(coded.dictionary) if coded is not None else 0
    lo, hi = t.column("lo")[0].as_py(), t.column("hi")[0].as_py()
    side, no, zero = (t.column(c).to_numpy() for c in ("side", "no", "zero"))
    bare = t.column("term").is_null().to_numpy()
    cell = {"side": side[~bare], "no": no[~bare], "p": cells.column("p").to_numpy(), "col": coded.indices.to_numpy().astype(np.int64) if coded is not None else np.zeros(0, np.int64)}
    groups, zeros, depth = {}, {}, 0
    for k in {lo, hi}:
        own = bare & (side == k)
        order = np.argsort(no[own])
        groups[k], zeros[k] = no[own][order], zero[own][order]
        depth = max(depth, int(len(groups[k]) - 1).bit_length(), int(max(terms - 1, 0)).bit_length())
    trees = {}
    for k in groups:
        own = cell["side"] == k
        trees[k] = QuadTree(np.searchsorted(groups[k], cell["no"][own]), cell["col"][own], cell["p"][own], depth)
    value = joint_prices(trees[lo], trees[hi], zeros[lo], zeros[hi], terms, depth, lo == hi)
    i, j = np.triu_indices(len(groups[lo]), 1) if lo == hi else np.indices(value.shape).reshape(2, -1)
    key = t.column("lang").slice(0, 1).combine_chunks().take(pa.array(np.zeros(len(i), np.int64)))
    return pa.table({"lang": key, "a": groups[lo][i], "b": groups[hi][j], "value": value[i, j], "terms": np.full(len(i), terms, np.int64)})


def divergence(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least_docs: int = 10, top_terms: int = 10, tile_groups: int = 32, tile_terms: int = 4096) -> DataFrame:
    """lang, source, part, item, value, rank. Part pair: every other source of the language by how far its terms differ.
    Part term: the `top_terms` terms in which a group exceeds its language most."""
    empty = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    rows = docs.select(empty(lang).alias("lang"), empty(source).alias("source"), empty(text).alias("text"))
    per_term = Window.partitionBy("lang", "term")
    summed = term_counts(rows).repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    seen = summed.withColumns({"_docs": F.sum("docs").over(per_term), "lang_n": F.sum("n").over(per_term), "_first": F.row_number().over(per_term.orderBy("source"))})
    cells = written(seen.filter(F.col("_docs") >= least_docs).select("lang", "source", "term", "n", "lang_n", (F.col("_first") == 1).alias("lead")), "term-cells")
    langs = cells.groupBy("lang").agg(F.count_if("lead").alias("v"), F.sum("n").alias("all_n"))
    own = cells.groupBy("lang", "source").agg(F.sum("n").alias("own_n"))
    numbered = Window.partitionBy("lang").orderBy("source")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    groups = rows.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("_rows")).join(langs, "lang", "left").join(own, ["lang", "source"], "left")
    groups = groups.select("lang", "source", zero("v").alias("v"), zero("all_n").alias("all_n"), zero("own_n").alias("own_n"), (F.row_number().over(numbered) - 1).cast("long").alias("no"), F.count(F.lit(1)).over(Window.partitionBy("lang")).alias("s"))
    groups = groups.withColumns({"zero": F.when(F.col("v") > 0, share("0", "own_n", "greatest(v, 1)")), "side": F.floor(F.col("no") / tile_groups).cast("long"), "sides": F.ceil(F.col("s") / tile_groups).cast("long"), "blocks": F.ceil(F.col("v") / tile_terms).cast("long")})
    groups = written(groups.drop("s"), "term-groups")
    priced = cells.join(groups, ["lang", "source"]).withColumn("p", share("n", "own_n", "v"))
    tile = lambda: F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.col("sides") - 1), lambda k: F.struct(F.least("side", k).alias("lo"), F.greatest("side", k).alias("hi")))).alias("t")
    block = F.pmod(F.xxhash64("term"), F.col("blocks")).alias("block")
    counted = priced.select("lang", block, "no", "side", "zero", "term", "p", tile())
    bare = groups.filter("blocks > 0").select("lang", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), "no", "side", "zero", F.lit(None).cast("string").alias("term"), F.lit(None).cast("long").alias("p"), "sides")
    bare = bare.select("lang", "block", "no", "side", "zero", "term", "p", tile())
    tiles = counted.unionByName(bare).select("lang", "block", "no", "side", "zero", "term", "p", "t.lo", "t.hi")
    sums = tiles.groupBy("lang", "block", "lo", "hi").applyInArrow(_tile, "lang string, a long, b long, value long, terms long").groupBy("lang", "a", "b").agg(F.sum("value").alias("value"), F.sum("terms").alias("terms"))
    one = groups.select("lang", "source", F.col("no").alias("i"), F.col("zero").alias("zero_i"), "v")
    other = groups.select("lang", F.col("source").alias("item"), F.col("no").alias("j"), F.col("zero").alias("zero_j"))
    met = one.join(other, "lang").filter("i <> j").withColumns({"a": F.least("i", "j"), "b": F.greatest("i", "j")}).join(sums, ["lang", "a", "b"], "left")
    rest = (F.col("v") - zero("terms")) * F.coalesce(price_column("zero_i", "zero_j"), F.lit(0).cast("long"))
    per_group = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = met.select("lang", "source", F.lit("pair").alias("part"), "item", (zero("value") + rest).alias("value")).withColumn("rank", F.row_number().over(per_group))
    over = priced.withColumn("q", share("lang_n", "all_n", "v")).filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), price_column("p", "q").alias("value"))
    return pairs.unionByName(over.withColumn("rank", F.row_number().over(per_group)).filter(F.col("rank") <= top_terms))


def op13_source_divergence(spark, sf_dir: str) -> DataFrame:
    return divergence(table(spark, sf_dir, "documents").select("text", "lang", "source"))
