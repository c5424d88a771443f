"""Exact n-gram Jaccard join of whole texts, and its connected groups.

1. Each text becomes the sorted array of its distinct shingle hashes (64 bits), its size and a parity bitmap:
   bit h mod m is flipped by every hash h, so the bits in which two bitmaps differ bound the symmetric difference
   of the sets from below, and with the sizes their overlap from above. Equal texts share one set hash.
2. Two sets that link share one of the smallest hashes of both (the exact prefix, see Rule.prefix), so sets meet
   under their prefix hashes. A set stays there only if its neighbour in order of size is within the size band.
   The sets of one hash, in order of size, are cut into parts of `tile_sets`; a tile is one part, or a pair of
   parts whose sizes are within the band, so a hash that many sets share is compared by many tasks. Tiles compare
   bitmaps inside the band and report a spanning forest of the pairs that these cannot exclude.
3. Components of these near pairs hold every link. Only their members' texts are fetched, once per component,
   into tiles of size bands and bounded numbers of hashes; there the bitmaps go first and exact intersection of the
   sorted arrays decides. Pairs that are already connected are skipped. The components of the links are the result.

A shingle is known by a hash of 64 bits, a whole set by the 64 bits of another hash and its size.

Defined cases: a null, empty or blank text has no shingles, size 0, and links with nothing; a text of fewer
words than a shingle is one shingle; a null doc_id takes part but never names a group that has other ids;
repeated rows are rows of one group; ties go to the smallest doc_id; an empty table gives no rows; other
columns are ignored (groups) or kept as they are (deduplication).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofset.llm.common import free_name, quoted, slices, table, utf8, written
from proofset.llm.components import components

_P, _Q = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
SETS_DDL = "doc_id long, mark long, n long, set_hash long, bitmap binary, prefix binary"


@dataclass(frozen=True)
class Rule:
    """Link when den * overlap >= num * union, over shingles of `width` words."""

    width: int = 5
    num: int = 4
    den: int = 5

    def prefix(self, n: int) -> int:
        """How many of its smallest hashes a set of n posts: with one fewer left over than a link needs in common,
        a linked pair must share one of them."""
        return n + self.num * n // -self.den + 1

    def overlap_enough(self, overlap, total):
        """total: sum of both sizes."""
        return overlap * (self.den + self.num) >= self.num * total

    def in_band(self, small, large):
        return small * self.den >= self.num * large


def shingle_set(text: bytes | None, width: int) -> np.ndarray:
    words = text.lower().split() if text else []
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
    k = min(width, n)
    acc = np.full(n - k + 1, k, np.uint64)
    for j in range(k):
        acc = (acc ^ (acc >> np.uint64(31))) * _P + h[j : n - k + 1 + j]
    acc = (acc ^ (acc >> np.uint64(30))) * _Q
    acc ^= acc >> np.uint64(27)
    acc.sort()
    return acc[np.flatnonzero(np.concatenate(([True], acc[1:] != acc[:-1])))]


def set_hash(s: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(s.tobytes(), len(s)) - (1 << 63)


def bitmap_words(n: int) -> int:
    """64-bit words of a set's bitmap: about a bit for each member, 64 to 32,768 bits, a power of two."""
    return min(512, max(1, 1 << (max(0, n - 1).bit_length() - 6 if n > 64 else 0)))


def parity_bitmap(hashes: np.ndarray) -> np.ndarray:
    w = bitmap_words(len(hashes))
    odd = (np.bincount((hashes & np.uint64(64 * w - 1)).astype(np.int64), minlength=64 * w) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view(np.uint64)


def folded(bits: np.ndarray, words: int) -> np.ndarray:
    """Bitmaps (rows) of fewer words: parities of both halves combine."""
    while bits.shape[1] > words:
        half = bits.shape[1] // 2
        bits = bits[:, :half] ^ bits[:, half:]
    return bits


def signatures(docs: DataFrame, rule: Rule, doc_id: str, text: str) -> DataFrame:
    """One row per document, without its array. The prefix is reported once per set and task."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told: set[int] = set()
        for b in slices(batches, "text", 4 << 20):
            rows = []
            for name, mark, body in zip(b.column("doc_id").to_pylist(), b.column("mark").to_pylist(), utf8(b.column("text")), strict=True):
                s = shingle_set(body, rule.width)
                if not len(s):
                    rows.append((name, mark, 0, None, None, None))
                    continue
                own = set_hash(s)
                new = own not in told
                told.add(own)
                rows.append((name, mark, len(s), own, parity_bitmap(s).tobytes() if new else None, s[: rule.prefix(len(s))].tobytes() if new else None))
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (*[pa.int64()] * 4, pa.binary(), pa.binary()), strict=True)], names=["doc_id", "mark", "n", "set_hash", "bitmap", "prefix"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(F.col(text)).alias("mark"), F.col(text).alias("text")).mapInArrow(make, SETS_DDL)


POSTINGS_DDL = "token long, part long, set_hash long, n long"


def banded_postings(sets: DataFrame, rule: Rule, tile_sets: int) -> DataFrame:
    """token, part, set_hash, n: of each prefix hash, the sets that have a different set of their size band there,
    in parts of tile_sets by size."""

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = b.column("prefix").to_pylist()
            count = [len(x) // 8 for x in raw]
            yield pa.record_batch({"token": np.frombuffer(b"".join(raw), np.int64), "set_hash": np.repeat(b.column("set_hash").to_numpy(), count), "n": np.repeat(b.column("n").to_numpy(), count)})

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by token, size, set; only the last row waits for its neighbour."""
        wait, kept = np.zeros((3, 0), np.int64), np.zeros(0, bool)
        token, before = None, 0  # of the last kept row: its token, and how many rows that has had

        def numbered(out: np.ndarray) -> pa.RecordBatch:
            nonlocal token, before
            first = np.flatnonzero(np.concatenate(([True], out[0, 1:] != out[0, :-1])))
            place = np.arange(out.shape[1]) - np.repeat(first, np.diff(np.append(first, out.shape[1])))
            if out[0, 0] == token:
                place[: first[1] if len(first) > 1 else None] += before
            token, before = out[0, -1], int(place[-1]) + 1
            return pa.record_batch({"token": out[0], "part": place // tile_sets, "set_hash": out[2], "n": out[1]})

        for b in batches:
            rows = np.concatenate([wait, np.stack([b.column(c).to_numpy() for c in ("token", "n", "set_hash")])], 1)
            flag = np.concatenate([kept, np.zeros(b.num_rows, bool)])
            new = np.concatenate(([True], (rows[:, 1:] != rows[:, :-1]).any(0)))
            rows, flag = rows[:, new], flag[new]
            near = (rows[0, 1:] == rows[0, :-1]) & rule.in_band(rows[1, :-1], rows[1, 1:])
            flag[1:] |= near
            flag[:-1] |= near
            wait, kept = rows[:, -1:], flag[-1:]
            out = rows[:, :-1][:, flag[:-1]]
            if out.shape[1]:
                yield numbered(out)
        if kept.any():
            yield numbered(wait)

    posted = sets.filter("prefix is not null").select("set_hash", "n", "prefix").mapInArrow(post, "token long, set_hash long, n long")
    return posted.repartition("token").sortWithinPartitions("token", "n", "set_hash").mapInArrow(keep, POSTINGS_DDL)


def tiles_of(postings: DataFrame, rule: Rule) -> DataFrame:
    """token, a, b, part, set_hash, n: each part by itself (a = b), and pairs of parts of one token within the band."""
    parts = postings.groupBy("token", "part").agg(F.min("n").alias("low"), F.max("n").alias("high"))
    many = parts.join(parts.filter("part = 1").select("token"), "token", "left_semi")
    left, right = many.select("token", F.col("part").alias("a"), "high"), many.select("token", F.col("part").alias("b"), "low")
    pairs = left.join(right, "token").filter((F.col("a") < F.col("b")) & (F.col("high") * rule.den >= F.col("low") * rule.num))
    both = pairs.select("token", "a", "b", F.explode(F.array("a", "b")).alias("part"))
    own = postings.select("token", F.col("part").alias("a"), F.col("part").alias("b"), "part", "set_hash", "n")
    return own.unionByName(postings.join(both, ["token", "part"]).select("token", "a", "b", "part", "set_hash", "n"))


class Forest:
    """Union-find over 0..n-1, in numpy: edges come in arrays."""

    def __init__(self, n: int) -> None:
        self.label = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            x, y = self.label[a], self.label[b]
            open_ = x != y
            if not open_.any():
                return
            a, b, x, y = a[open_], b[open_], x[open_], y[open_]
            low = np.minimum(x, y)
            root = np.arange(len(self.label))
            np.minimum.at(root, x, low)
            np.minimum.at(root, y, low)
            while (root[root] != root).any():
                root = root[root]
            self.label = root[self.label]

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        at = np.flatnonzero(self.label != np.arange(len(self.label)))
        return at, self.label[at]


def near_rows(n: np.ndarray, bits: list[np.ndarray], rule: Rule, forest: Forest, cross: int = 0, block: int = 128, wide: int = 4096) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i < j in order of size, n ascending) inside the size band that the bitmaps cannot exclude and that
    are not connected yet, in arrays, block by block. With cross, only pairs of the first so many with the others."""
    words = np.array([len(x) for x in bits])
    ends = np.searchsorted(n, rule.den * n // rule.num, side="right")
    last, i1 = cross or len(n), 0
    while i1 < last:
        i0 = i1
        w = int(words[i0])
        i1 = min(last, i0 + block, int(np.searchsorted(words, w, side="right")))  # bitmaps are only folded to the width of the smaller set
        if (forest.label[i0:] == forest.label[i0]).all():
            continue
        mine = np.concatenate([folded(x[None], w) for x in bits[i0:i1]])
        for j0 in range(max(i0, cross), int(ends[i1 - 1]), wide):
            j1 = min(int(ends[i1 - 1]), j0 + wide)
            other = np.concatenate([folded(x[None], w) for x in bits[j0:j1]])
            differ = np.zeros((i1 - i0, j1 - j0), np.int32)
            for k in range(w):
                differ += np.bitwise_count(mine[:, k, None] ^ other[None, :, k])
            total = n[i0:i1, None] + n[None, j0:j1]
            ok = rule.overlap_enough(total - differ, 2 * total) & (np.arange(j0, j1)[None] > np.arange(i0, i1)[:, None]) & (np.arange(j0, j1)[None] < ends[i0:i1, None])
            ok &= forest.label[i0:i1, None] != forest.label[None, j0:j1]
            a, b = np.nonzero(ok)
            if len(a):
                yield a + i0, b + j0


def near_edges(postings: DataFrame, sets: DataFrame, rule: Rule) -> DataFrame:
    """a, b: spanning forests, tile by tile, of the pairs that bitmaps cannot exclude."""
    bitmaps = sets.filter("bitmap is not null").groupBy("set_hash").agg(F.first("bitmap").alias("bitmap"))
    tiles = tiles_of(postings, rule).join(bitmaps.hint("merge"), "set_hash").select("token", "a", "b", "part", "n", "set_hash", "bitmap")

    def tile_edges(t: pa.Table, bounds: np.ndarray, done: set) -> Iterator[tuple[int, int]]:
        n, own, part, a_col = (t.column(c).to_numpy() for c in ("n", "set_hash", "part", "a"))
        b_col, bits = t.column("b").to_numpy(), t.column("bitmap")
        for x, y in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if y - x < 2:
                continue
            cross = int((part[x:y] == a_col[x]).sum()) if a_col[x] < b_col[x] else 0
            names = own[x:y]
            key = hash((cross, names.tobytes()))
            if key in done:  # the same sets met in an earlier tile of this task
                continue
            if len(done) < 200_000:
                done.add(key)
            forest = Forest(y - x)
            for i, j in near_rows(n[x:y], [np.frombuffer(v, np.uint64) for v in bits[x:y].to_pylist()], rule, forest, cross):
                forest.join(i, j)
            for i, j in zip(*forest.edges(), strict=True):
                yield int(names[i]), int(names[j])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set = set()
        told: set = set()
        held: list[pa.RecordBatch] = []
        key = ("token", "a", "b")
        for b in _and_none(batches):
            if b is not None:
                held.append(b)
                if all(held[0].column(c)[0] == b.column(c)[b.num_rows - 1] for c in key):
                    continue  # one tile goes on
            if not held:
                break
            t = pa.Table.from_batches(held).combine_chunks()
            rows = np.stack([t.column(c).to_numpy() for c in key])
            starts = np.flatnonzero(np.concatenate(([True], (rows[:, 1:] != rows[:, :-1]).any(0))))
            bounds = np.append(starts, len(t)) if b is None else starts
            out = [e for e in tile_edges(t, bounds, done) if e not in told]
            if len(told) < 1_000_000:
                told.update(out)
            out = list(dict.fromkeys(out))
            yield pa.record_batch({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})
            held = [] if b is None else t.slice(int(bounds[-1])).to_batches()
            if b is None:
                break

    return tiles.repartition("token", "a", "b").sortWithinPartitions("token", "a", "b", "part", "n", "set_hash").mapInArrow(compare, "a long, b long")


def _and_none(batches):
    yield from (b for b in batches if b.num_rows)
    yield None


def tile_plan(members: DataFrame, rule: Rule, tile_hashes: int) -> DataFrame:
    """set_hash, component, tiles (array of strings) for members (set_hash, component, n). A component of at most
    tile_hashes hashes is one tile; a larger one is cut into size bands, bands into parts by hash, and a tile
    is a pair of parts of the same or of neighbouring bands."""
    banded = members.withColumn("band", F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(rule.den / rule.num))).cast("int"))
    bands = banded.groupBy("component", "band").agg(F.sum("n").alias("s"))
    size = bands.groupBy("component").agg(F.sum("s").alias("all"), F.max("s").alias("most"))
    parts = F.when(F.col("all") <= tile_hashes, F.lit(0)).otherwise(F.ceil(F.col("most") * 2 / tile_hashes)).cast("int")
    rows = banded.join(size.select("component", parts.alias("parts")), "component").withColumn("part", F.when(F.col("parts") > 0, F.pmod(F.xxhash64("set_hash"), F.col("parts"))).cast("int"))
    name = lambda b0, p0, b1, p1: F.concat_ws("/", F.col("component"), b0, p0, b1, p1)
    others = F.sequence(F.lit(0), F.col("parts") - 1)
    band, part = F.col("band"), F.col("part")
    tiles = F.concat(
        F.transform(others, lambda p: name(band, F.least(part, p), band, F.greatest(part, p))),
        F.transform(others, lambda p: name(band, part, band + 1, p)),
        F.transform(others, lambda p: name(band - 1, p, band, part)),
    )
    return rows.select("set_hash", "component", F.when(F.col("parts") > 0, tiles).otherwise(F.array(F.concat_ws("/", "component"))).alias("tiles"))


def exact_edges(docs: DataFrame, sets: DataFrame, near: DataFrame, rule: Rule, doc_id: str, text: str, tile_hashes: int = 1_500_000) -> DataFrame:
    """a, b: spanning forests of the exact links inside the components of near pairs."""
    sized = sets.filter("set_hash is not null").groupBy("set_hash").agg(F.first("n").alias("n"), F.min(F.struct("doc_id", "mark")).alias("rep"))
    members = near.select(F.col("node").alias("set_hash"), "component").join(sized, "set_hash")
    plan = tile_plan(members.select("set_hash", "component", "n"), rule, tile_hashes).join(members.select("set_hash", "rep"), "set_hash")
    bodies = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).filter("text is not null")
    # by id and text: many texts may stand under one id, or under none; of rows that are equal in both, one is enough
    named = written(plan.select(F.col("rep.doc_id").alias("rep"), F.col("rep.mark").alias("mark"), "set_hash", "tiles"), "shingle-plan")
    # merge: the size of the small file just written must not make it a broadcast, as its rows grow with the corpus
    wanted = bodies.join(named.hint("merge"), F.col("doc_id").eqNullSafe(F.col("rep")) & (F.xxhash64("text") == F.col("mark")))
    return wanted.select("set_hash", "text", F.explode("tiles").alias("tile")).groupBy("tile").applyInArrow(lambda t: verified(t, rule), "a long, b long")


def verified(t: pa.Table, rule: Rule) -> pa.Table:
    """One tile (set_hash, text): exact links among its sets, as a spanning forest."""
    own: dict[int, np.ndarray] = {}
    for piece in t.to_batches(max_chunksize=64):  # few texts at a time as Python objects
        for k, body in zip(piece.column("set_hash").to_pylist(), utf8(piece.column("text")), strict=True):
            if k not in own and len(s := shingle_set(body, rule.width)) and set_hash(s) == k:  # else another text under the same id: not it
                own[k] = s
    if not own:
        return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
    names = sorted(own, key=lambda k: (len(own[k]), k))
    sets = [own[k] for k in names]
    n = np.array([len(s) for s in sets], np.int64)
    forest = Forest(len(names))
    flat = np.unique(np.concatenate(sets), return_inverse=True)[1]
    starts = np.concatenate(([0], np.cumsum(n)))
    mark = np.zeros(int(flat.max()) + 1, bool)
    for a, b in near_rows(n, [parity_bitmap(s) for s in sets], rule, forest):
        cuts = np.flatnonzero(np.diff(a, prepend=-1))
        for i, js in zip(a[cuts].tolist(), np.split(b, cuts[1:]), strict=True):
            js = js[forest.label[js] != forest.label[i]]
            if not len(js):
                continue
            mine = flat[starts[i] : starts[i + 1]]
            mark[mine] = True
            at = np.repeat(starts[js] - np.concatenate(([0], np.cumsum(n[js])))[:-1], n[js]) + np.arange(int(n[js].sum()))
            common = np.add.reduceat(mark[flat[at]].astype(np.int64), np.concatenate(([0], np.cumsum(n[js])))[:-1])
            mark[mine] = False
            linked = js[rule.overlap_enough(common, n[i] + n[js])]
            forest.join(np.full(len(linked), i), linked)
    i, j = forest.edges()
    keys = np.array(names, np.int64)
    return pa.table({"a": keys[i], "b": keys[j]})


def similar_groups(docs: DataFrame, rule: Rule = Rule(), doc_id: str = "doc_id", text: str = "text", salts: int = 8, tile_sets: int = 4096) -> DataFrame:
    """doc_id, mark (hash of the text), n_shingles, group (null without shingles; one number for each group),
    component_id: the smallest doc_id of the group."""
    sets = written(signatures(docs, rule, doc_id, text), "shingle-sets")
    postings = written(banded_postings(sets, rule, tile_sets), "shingle-postings")
    near = components(near_edges(postings, sets, rule))
    links = components(exact_edges(docs, sets, near, rule, doc_id, text))
    by_set = sets.filter("set_hash is not null").groupBy("set_hash").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies"))
    labelled = by_set.join(links.withColumnRenamed("node", "set_hash"), "set_hash", "left").filter("copies > 1 or component is not null").withColumn("component", F.coalesce("component", "set_hash"))
    least = labelled.groupBy("component").agg(F.min("least").alias("component_id"))
    named = labelled.join(least, "component").select("set_hash", "component", "component_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))).alias("salt"))
    rows = sets.select("doc_id", "mark", F.col("n").alias("n_shingles"), "set_hash").withColumn("salt", F.pmod(F.xxhash64("doc_id", "mark"), F.lit(salts)))
    return rows.join(named, ["set_hash", "salt"], "left").select("doc_id", "mark", "n_shingles", F.coalesce("component", "set_hash").alias("group"), F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, rule: Rule = Rule(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one row of each group: the one with the smallest id (null ids come last; of two texts under one id,
    either). Documents without words stay, as they link with nothing. Same columns, whatever their names."""
    blank = F.coalesce(~F.col(text).rlike(r"[^\x20\x09-\x0D]"), F.lit(True))
    first = similar_groups(docs, rule, doc_id, text).filter("group is not null").groupBy("group", "doc_id", "mark").agg(F.count(F.lit(1)).alias("rows")).groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "mark", "rows")).alias("first"))
    names = [free_name(docs.columns, n) for n in ("kept_id", "kept_mark", "kept_rows")]
    stay = written(first.select(*[F.col(f"first.{c}").alias(n) for c, n in zip(("doc_id", "mark", "rows"), names, strict=True)]), "shingle-kept")  # read twice below, and narrow
    kept = docs.filter(~blank).join(stay.hint("merge"), F.col(doc_id).cast("long").eqNullSafe(F.col(names[0])) & (F.xxhash64(F.col(text)) == F.col(names[1])))
    own = [quoted(c) for c in docs.columns]
    once = kept.filter(F.col(names[2]) == 1).select(*own)
    repeated = kept.filter(F.col(names[2]) > 1).select(*own).dropDuplicates([doc_id, text])  # only rows that stand several times
    return docs.filter(blank).unionByName(once).unionByName(repeated)


def op3_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return similar_groups(table(spark, sf_dir, "documents"), Rule(width=4, num=85, den=100)).select("doc_id", "n_shingles", "component_id")
