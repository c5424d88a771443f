"""Grouping the photos of a set by person, and what to doubt about it. Vectors never meet across sets and are
never written."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from proofset.functions.paths import shot_number
from proofset.session import computed_once, stored_once

LOW, HIGH, STEP = 0.20, 0.90, 0.01
STABLE = (0.30, 0.78)
PAIR_LINE = 0.363


def cuts() -> list[tuple[float, float]]:
    """(raw, rounded): the raw cut decides merges, the rounded one is reported. Raw cuts are summed step by step."""
    out, t = [], LOW
    while t <= HIGH + 1e-9:
        out.append((t, round(t, 3)))
        t += STEP
    return out


def intake(prints: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of (set_id, photo_id, name, vec, detect_threshold): unit vectors with their capture index; skipped (name,
    reason); weak (name, detect_threshold)."""
    norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x))
    reason = F.when(F.col("vec").isNull(), "unreadable").when(F.col("detect_threshold").isNull(), "no face found").when(norm == 0, "empty fingerprint")
    rows = prints.withColumns({"_reason": reason, "_norm": norm})
    skipped = rows.filter("_reason is not null").select("set_id", "name", F.col("_reason").alias("reason"))
    kept = rows.filter("_reason is null").withColumn("vec", F.transform("vec", lambda x: x / F.col("_norm"))).drop("_reason", "_norm")
    order = Window.partitionBy("set_id").orderBy(shot_number(F.col("name")), "name", "photo_id")
    kept = kept.withColumn("idx", (F.row_number().over(order) - 1).cast("long"))
    return kept, skipped, kept.filter("detect_threshold < 0.8").select("set_id", "name", "detect_threshold")


def cosine(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def pairs(kept: DataFrame, floor: float | None = None) -> DataFrame:
    """set_id, i, j, sim (i < j) of all pairs inside a set, as a plain join; floor drops those below it."""
    a, b = kept.select("set_id", F.col("idx").alias("i"), F.col("vec").alias("va")), kept.select("set_id", F.col("idx").alias("j"), F.col("vec").alias("vb"))
    sim = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine(F.col("va"), F.col("vb"))))
    out = a.join(b, "set_id").filter("i < j").select("set_id", "i", "j", sim.alias("sim"))
    return out if floor is None else out.filter(F.col("sim") >= floor)


def _tiles(kept: DataFrame, block: int, *more: str, counts: DataFrame | None = None) -> DataFrame:
    """Rows of (set_id, idx, vec, ...) dealt to pairs of blocks (lo, hi) of their set; _p is a row's own block. counts:
    set_id, n, if the sets' rows need not be counted."""
    counts = kept.groupBy("set_id").agg(F.count(F.lit(1)).alias("n")) if counts is None else counts
    parts = counts.select(F.col("set_id").alias("_s"), F.ceil(F.col("n") / block).cast("int").alias("_parts"))
    rows = kept.select("set_id", "idx", "vec", *more).join(parts, F.col("set_id").eqNullSafe(F.col("_s"))).withColumn("_p", F.floor(F.col("idx") / block).cast("int"))
    tiles = F.transform(F.sequence(F.lit(0), F.col("_parts") - 1), lambda q: F.struct(F.least("_p", q).alias("lo"), F.greatest("_p", q).alias("hi")))
    return rows.select("set_id", "idx", "vec", *more, "_p", F.explode(F.array_distinct(tiles)).alias("t")).select("set_id", "idx", "vec", *more, "_p", "t.lo", "t.hi")


def _vectors(t: pa.Table) -> np.ndarray:
    return t.column("vec").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(t.num_rows, -1)


def _product(t: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The tile in order of idx, its rows of block lo and of block hi, their similarities, and which are pairs i < j."""
    t = t.sort_by("idx")
    p, idx, v = t.column("_p").to_numpy(), t.column("idx").to_numpy(), _vectors(t)
    a, b = np.flatnonzero(p == t.column("lo")[0].as_py()), np.flatnonzero(p == t.column("hi")[0].as_py())
    return t, a, b, np.clip(v[a] @ v[b].T, -1, 1), idx[a][:, None] < idx[b][None]


def _of_set(t: pa.Table, n: int) -> pa.Array:
    return pa.array([t.column("set_id")[0].as_py()] * n, t.schema.field("set_id").type)


def pair_blocks(kept: DataFrame, floor: float | None = None, block: int = 1024) -> DataFrame:
    """What pairs() returns, by matrix products over blocks of a set; a task holds two blocks."""

    def product(t: pa.Table) -> pa.Table:
        t, a, b, sim, keep = _product(t)
        idx = t.column("idx").to_numpy()
        i, j = np.nonzero(keep if floor is None else keep & (sim >= floor))
        return pa.table({"set_id": _of_set(t, len(i)), "i": idx[a][i], "j": idx[b][j], "sim": sim[i, j]})

    kind = kept.schema["set_id"].dataType.simpleString()
    return _tiles(kept, block).groupBy("set_id", "lo", "hi").applyInArrow(product, f"set_id {kind}, i long, j long, sim double")


def group_links(kept: DataFrame, members: DataFrame, block: int = 1024) -> DataFrame:
    """set_id, a, b, n, total, sim, i, j: number and summed similarity of the pairs between groups a <= b, and for
    a = b the least similar pair. Pairs are added up inside their tile, so that no row stands for a pair of photos."""
    rows = kept.select("set_id", "idx", "vec").join(members.select("set_id", "idx", F.col("group_no").cast("long").alias("_g")), ["set_id", "idx"])

    def links(t: pa.Table) -> pa.Table:
        t, a, b, sim, keep = _product(t)
        idx, g = t.column("idx").to_numpy(), t.column("_g").to_numpy()
        by_group = np.ix_(np.argsort(g[a], kind="stable"), np.argsort(g[b], kind="stable"))
        (ga, from_a), (gb, from_b) = (np.unique(np.sort(g[x]), return_index=True) for x in (a, b))
        added = lambda x: np.add.reduceat(np.add.reduceat(x[by_group], from_a, 0), from_b, 1)
        n, total = added(keep.astype(np.int64)), added(np.where(keep, sim, 0.0))
        p, q = np.nonzero(n)
        own = [None] * len(p)
        for k in np.flatnonzero(ga[p] == gb[q]).tolist():
            r, c = np.flatnonzero(g[a] == ga[p[k]]), np.flatnonzero(g[b] == ga[p[k]])
            part = np.where(keep[np.ix_(r, c)], sim[np.ix_(r, c)], np.inf)
            i, j = np.unravel_index(part.argmin(), part.shape)  # in order of idx: of equal ones the smallest
            own[k] = (float(part[i, j]), int(idx[a][r[i]]), int(idx[b][c[j]]))
        cols = [pa.array([x and x[f] for x in own], kind) for f, kind in enumerate((pa.float64(), pa.int64(), pa.int64()))]
        return pa.table([_of_set(t, len(p)), np.minimum(ga[p], gb[q]), np.maximum(ga[p], gb[q]), n[p, q].astype(np.int64), total[p, q].astype(float), *cols], names=["set_id", "a", "b", "n", "total", "sim", "i", "j"])

    kind = kept.schema["set_id"].dataType.simpleString()
    found = _tiles(rows, block, "_g").groupBy("set_id", "lo", "hi").applyInArrow(links, f"set_id {kind}, a long, b long, n long, total double, sim double, i long, j long")
    least = F.min(F.when(F.col("sim").isNotNull(), F.struct("sim", "i", "j"))).alias("w")
    return found.groupBy("set_id", "a", "b").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), least).select("set_id", "a", "b", "n", "total", "w.*")


def merge_history(sim: np.ndarray, sizes: np.ndarray | None = None) -> list[tuple[int, int, float]]:
    """Average-linkage merges (kept slot, absorbed slot, height), highest first, until one group is left; ties go to
    the smallest slots. Each slot remembers its best partner, so a merge costs one row of means. sizes: of groups that
    are there already, with their means in sim."""
    n = len(sim)
    if n < 2:
        return []
    mean = sim.astype(float).copy()
    np.fill_diagonal(mean, -np.inf)
    size = np.ones(n) if sizes is None else sizes.astype(float)
    best = mean.argmax(1)
    top = mean[np.arange(n), best]
    out = []
    for _ in range(n - 1):
        i = int(top.argmax())
        j = int(best[i])
        i, j = min(i, j), max(i, j)
        out.append((i, j, float(mean[i, j])))
        row = (size[i] * mean[i] + size[j] * mean[j]) / (size[i] + size[j])
        row[[i, j]] = -np.inf
        row[~np.isfinite(mean[i])] = -np.inf
        size[i] += size[j]
        mean[i], mean[:, i] = row, row
        mean[j], mean[:, j] = -np.inf, -np.inf
        top[j] = -np.inf
        stale = np.flatnonzero(np.isfinite(top) & ((best == i) | (best == j)))
        for k in {i, *stale.tolist()}:
            best[k] = mean[k].argmax()
            top[k] = mean[k, best[k]]
        rise = np.flatnonzero(np.isfinite(row) & ((row > top) | ((row == top) & (i < best))))
        best[rise], top[rise] = i, row[rise]
    return out


def near_history(vectors: np.ndarray, sizes: np.ndarray | None = None, floor: float = -1.0, cells: int = 1 << 22) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The merges of merge_history() at or above `floor` (kept slots, absorbed slots, heights, highest first) from the
    vectors alone, without a matrix of all pairs: `cells` similarities are held at once. Two groups that are each
    other's nearest join at once, wherever they stand in the greedy order: joining groups never brings one nearer to a
    third than its nearer part was. So what a group was nearest to holds until that is joined, and what it was then
    bounds what it may be near to later; it is asked anew only when some group is nearest to it. Ties (to 12 digits)
    go to the smallest slots."""
    n, d = vectors.shape
    size = np.ones(n) if sizes is None else sizes.astype(float)
    slot, live, known = np.arange(n), np.ones(n, bool), np.zeros(n, bool)
    best, top = np.zeros(n, np.int64), np.full(n, np.inf)
    mean = np.zeros((n, d + 1))  # the last column takes joined groups out of every search
    mean[:, :d] = vectors
    total = mean[:, :d] * size[:, None]
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    asked = slot
    while n > 1:
        step = max(1, cells // max(1, len(slot)))
        for k in range(0, len(asked), step):
            a = asked[k : k + step]
            q = mean[a]
            q[:, d] = 1
            sim = q @ mean.T
            sim[np.arange(len(a)), a] = -np.inf
            high = sim.max(1)
            best[a], top[a], known[a] = (sim >= high[:, None] - 1e-12).argmax(1), np.clip(high, -1, 1), True
        near = np.flatnonzero(live & known & (top >= floor))
        to = best[near]
        i = near[(near < to) & known[to] & (best[to] == near)]
        j, height = best[i], top[i]
        ask = np.zeros(len(slot), bool)
        ask[to] = True
        if not len(i) and not (ask & ~known).any():
            ask = live & ~known & (top >= floor)
            if not ask.any():
                if not len(near):
                    break
                i = near[[top[near].argmax()]]  # digits beyond the twelfth may lead round in a circle
                i, j, height = np.minimum(i, best[i]), np.maximum(i, best[i]), top[i]
        if len(i):
            out.append((slot[i], slot[j], height))
            total[i] += total[j]
            size[i] += size[j]
            mean[i, :d] = total[i] / size[i][:, None]
            mean[j, d] = -4
            live[j] = False
            joined = ~live
            joined[i] = True
            known &= ~joined[best] & ~joined
            left = np.flatnonzero(live)
            if len(left) < 2:
                break
            ask = np.zeros(len(slot), bool)
            ask[best[live & known & (top >= floor)]] = True
            ask[i] = True
            if len(left) < 0.8 * len(slot):
                new = np.zeros(len(slot), np.int64)
                new[left] = np.arange(len(left))
                slot, size, mean, total, known, top, best, ask = slot[left], size[left], mean[left], total[left], known[left], top[left], new[best[left]], ask[left]
                live = np.ones(len(left), bool)
        asked = np.flatnonzero(ask & live & ~known)
    i, j, height = (np.concatenate(x) for x in zip(*out, strict=True))
    order = np.argsort(-np.round(height, 12), kind="stable")  # a join comes after those that made its parts
    return i[order], j[order], height[order]


MATRIX = 2000  # photos of which one task holds all pairs
LOCAL = 100_000  # photos of 64 numbers that one task holds


def _merges(vectors: np.ndarray, sizes: np.ndarray | None = None, floor: float = -1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if len(vectors) > MATRIX:
        return near_history(vectors, sizes, floor)
    found = merge_history(np.clip(vectors @ vectors.T, -1, 1), sizes)
    return tuple(np.array([x[c] for x in found], kind) for c, kind in enumerate((np.int64, np.int64, float)))


_HISTORY = "i long, j long, height double"


def _key(t: pa.Table, n: int) -> pa.Array:
    return t.column("set_id").slice(0, 1).combine_chunks().take(pa.array(np.zeros(n, np.int64)))


def _weight(vec: Column) -> Column:
    """What a photo counts for in LOCAL."""
    return F.greatest(F.lit(1.0), F.size(vec) / 64)


def histories(kept: DataFrame, local: int = LOCAL, floor: float = -1.0, block: int = 1024) -> DataFrame:
    """set_id, step, i, j (the groups' smallest idx: j joins i), height (running minimum) for each set, down to `floor`
    at least: one history answers every cut above. A set of up to `local` photos (of 64 numbers; fewer, if theirs are
    more) is one task's work; a larger one goes by rounds (linked_history()) until it is."""

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("idx")
        idx = t.column("idx").to_numpy()
        i, j, height = _merges(_vectors(t), None, floor)
        return pa.table({"set_id": _key(t, len(i)), "step": np.arange(len(i)), "i": idx[i], "j": idx[j], "height": np.minimum.accumulate(height)})

    kind = kept.schema["set_id"].dataType.simpleString()
    small = lambda rows: rows.select("set_id", "idx", "vec").groupBy("set_id").applyInArrow(run, f"set_id {kind}, step long, {_HISTORY}")
    large = computed_once(kept.groupBy("set_id").agg(F.sum(_weight(F.col("vec"))).alias("_n")).filter(F.col("_n") > local).select(F.col("set_id").alias("_s")))
    if not large.limit(1).count():
        return small(kept)
    met = F.col("set_id").eqNullSafe(F.col("_s"))
    return small(kept.join(large, met, "left_anti")).unionByName(linked_history(kept.join(large, met, "left_semi"), local, floor, block))


def group_means(rows: DataFrame) -> DataFrame:
    """set_id, g, n, vec: size and mean vector of groups, from (set_id, g, vec). Vectors are added up in their task
    first, so a task gets a sum for each group and batch, never a group's photos."""
    kind = rows.schema["set_id"].dataType.simpleString()

    def added(t: pa.Table, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        codes = t.column("set_id").combine_chunks().dictionary_encode().indices
        g, v = t.column("g").to_numpy(), _vectors(t)
        order = np.lexsort((g, codes.fill_null(-1).to_numpy()))
        c, g = codes.fill_null(-1).to_numpy()[order], g[order]
        first = np.flatnonzero((np.diff(c, prepend=c[0] - 1) != 0) | (np.diff(g, prepend=g[0] - 1) != 0))
        return order[first], np.add.reduceat(n[order], first), np.add.reduceat(v[order], first)

    def table(t: pa.Table, at: np.ndarray, n: np.ndarray, v: np.ndarray) -> dict:
        flat = pa.ListArray.from_arrays(np.arange(0, v.size + 1, v.shape[1], dtype=np.int32), v.ravel())
        return {"set_id": t.column("set_id").combine_chunks().take(pa.array(at)), "g": t.column("g").to_numpy()[at], "n": n, "vec": flat}

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = pa.compute.list_value_length(b.column("vec"))
            for size in pa.compute.unique(sizes).to_pylist():  # sets may have vectors of different length
                t = pa.Table.from_batches([b]).filter(pa.compute.equal(sizes, size))
                yield from pa.table(table(t, *added(t, np.ones(t.num_rows, np.int64)))).combine_chunks().to_batches()

    def whole(t: pa.Table) -> pa.Table:
        at, n, v = added(t, t.column("n").to_numpy())
        return pa.table(table(t, at, n, v / n[:, None]))

    ddl = f"set_id {kind}, g long, n long, vec array<double>"
    return rows.select("set_id", "g", "vec").mapInArrow(partial, ddl).groupBy("set_id", "g").applyInArrow(whole, ddl)


def nearest_groups(means: DataFrame, block: int = 1024) -> DataFrame:
    """set_id, g, sim, partner: the group with the highest mean similarity to each; ties (to 12 digits) go to the
    smallest. The mean over all pairs of two groups is the product of their mean vectors, so tiles of blocks of groups
    are enough."""
    place = (F.row_number().over(Window.partitionBy("set_id").orderBy("g")) - 1).cast("long")

    def best(t: pa.Table) -> pa.Table:
        t, a, b, sim, keep = _product(t)
        g = t.column("g").to_numpy()
        sim = np.where(keep, np.round(sim, 12), -np.inf)
        r, c = sim.argmax(1), sim.argmax(0)  # in order of g: of equal ones the smallest
        own = np.concatenate((a, b))
        top = np.concatenate((sim[np.arange(len(a)), r], sim[c, np.arange(len(b))]))
        other = np.concatenate((g[b][r], g[a][c]))
        have = np.flatnonzero(top > -np.inf)
        return pa.table({"set_id": _key(t, len(have)), "g": g[own][have], "sim": top[have], "partner": other[have]})

    kind = means.schema["set_id"].dataType.simpleString()
    found = _tiles(means.withColumn("idx", place), block, "g").groupBy("set_id", "lo", "hi").applyInArrow(best, f"set_id {kind}, g long, sim double, partner long")
    return found.groupBy("set_id", "g").agg(F.max(F.struct("sim", (-F.col("partner")).alias("p"))).alias("b")).select("set_id", "g", F.col("b.sim").alias("sim"), (-F.col("b.p")).alias("partner"))


def linked_history(kept: DataFrame, local: int = LOCAL, floor: float = -1.0, block: int = 1024) -> DataFrame:
    """histories() of sets of any size, in rounds. In a round every two groups that are each other's nearest join at
    once. Joining groups never brings one nearer to a third than its nearer part was, so these joins are those of the
    greedy order, at the same heights. When a set has `local` groups left (of 64 numbers), one task finishes it. Labels
    and joins are stored; vectors are added up anew each round, as they never are."""
    kind = kept.schema["set_id"].dataType.simpleString()
    label = stored_once(kept.select("set_id", "idx", F.col("idx").alias("g"), _weight(F.col("vec")).alias("w")))
    joins, k = None, 0
    met = lambda a, b: F.col(a).eqNullSafe(F.col(b))

    def with_groups(sets: DataFrame) -> DataFrame:
        """Vectors with their group, of some sets (_s)."""
        own = label.join(sets, met("set_id", "_s"), "left_semi").select(F.col("set_id").alias("_t"), F.col("idx").alias("_i"), "g")
        return kept.join(own, met("set_id", "_t") & (F.col("idx") == F.col("_i"))).select("set_id", "g", "vec")

    while True:
        counts = stored_once(label.groupBy(F.col("set_id").alias("_s")).agg((F.countDistinct("g") * F.max("w")).alias("_n")))
        large = counts.filter(F.col("_n") > local)
        if not large.limit(1).count():
            break
        near = stored_once(nearest_groups(group_means(with_groups(large)), block).filter(F.col("sim") >= floor))
        back = near.select(F.col("set_id").alias("_t"), F.col("g").alias("_g"), F.col("partner").alias("_p"))
        mutual = near.join(back, met("set_id", "_t") & (F.col("partner") == F.col("_g")) & (F.col("g") == F.col("_p"))).filter("g < partner")
        now = stored_once(mutual.select("set_id", F.lit(k).alias("round"), F.col("g").alias("i"), F.col("partner").alias("j"), F.col("sim").alias("height")))
        if not now.limit(1).count():
            break  # what is left lies below the floor
        moved = now.select(F.col("set_id").alias("_t"), F.col("j").alias("_j"), F.col("i").alias("_to"))
        label = stored_once(label.join(moved, met("set_id", "_t") & (F.col("g") == F.col("_j")), "left").select("set_id", "idx", F.coalesce("_to", "g").alias("g"), "w"))
        joins, k = (now if joins is None else joins.unionByName(now)), k + 1

    def finish(t: pa.Table) -> pa.Table:
        t = t.sort_by("g")
        g = t.column("g").to_numpy()
        i, j, height = _merges(_vectors(t), t.column("n").to_numpy(), floor)
        return pa.table([_key(t, len(i)), np.arange(len(i)), g[i], g[j], height], names=["set_id", "late", "i", "j", "height"])

    rest = group_means(with_groups(counts.filter(F.col("_n") <= local))).groupBy("set_id").applyInArrow(finish, f"set_id {kind}, late long, {_HISTORY}")
    rest = rest.select("set_id", F.lit(k).alias("round"), "late", "i", "j", "height")
    whole = rest if joins is None else joins.withColumn("late", F.lit(0).cast("long")).unionByName(rest)
    # a join is never higher than what it joins, but for the last digits
    order = Window.partitionBy("set_id").orderBy(F.desc(F.round("height", 12)), "round", "late", "i", "j")
    whole = whole.withColumn("step", (F.row_number().over(order) - 1).cast("long"))
    low = F.min("height").over(Window.partitionBy("set_id").orderBy("step").rowsBetween(Window.unboundedPreceding, 0))
    return whole.select("set_id", "step", "i", "j", low.alias("height"))


def sweep(history: DataFrame, kept: DataFrame) -> DataFrame:
    """set_id, cut, students for the 71 cuts: photos less the merges at or above the cut. A merge counts once, at the
    last cut that it reaches; the others follow by a running sum over the cuts of a set."""
    grid = cuts()
    raws = F.array(*[F.lit(raw) for raw, _ in grid])
    last = F.size(F.filter(raws, lambda raw: raw <= F.col("height"))) - 1
    merges = history.groupBy("set_id", last.alias("place")).agg(F.count(F.lit(1)).alias("m"))
    rows = kept.groupBy("set_id").agg(F.count(F.lit(1)).alias("n")).select("set_id", "n", F.posexplode(F.array(*[F.lit(cut) for _, cut in grid])).alias("place", "cut"))
    reached = F.sum(F.coalesce("m", F.lit(0))).over(Window.partitionBy("set_id").orderBy(F.desc("place")))
    return rows.join(merges, ["set_id", "place"], "left").select("set_id", "cut", (F.col("n") - reached).cast("int").alias("students"))


def plateau(counts: DataFrame) -> DataFrame:
    """set_id, students, low, high, middle: the longest run of an unchanged count inside the stable range; of equal
    runs the later one."""
    w = Window.partitionBy("set_id").orderBy("cut")
    rows = counts.filter(F.col("cut").between(STABLE[0] - 1e-9, STABLE[1] + 1e-9))
    rows = rows.withColumn("_new", F.coalesce((F.col("students") != F.lag("students").over(w)).cast("int"), F.lit(1))).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = rows.groupBy("set_id", "_run").agg(F.first("students").alias("students"), F.array_sort(F.collect_list("cut")).alias("c"))
    best = runs.groupBy("set_id").agg(F.max_by(F.struct("students", "c"), F.struct(F.size("c").alias("n"), F.col("c")[0].alias("start"))).alias("b"))
    c = F.col("b.c")
    return best.select("set_id", F.col("b.students").alias("students"), c[0].alias("low"), F.element_at(c, -1).alias("high"), F.element_at(c, (F.floor(F.size(c) / 2) + 1).cast("int")).alias("middle"))


def operating_cut(sets: DataFrame, stable: DataFrame, asked: float | None = None) -> DataFrame:
    """set_id, cut, why."""
    two = lambda c: F.format_string("%.2f", c)
    if asked is not None:
        return sets.select("set_id").distinct().select("set_id", F.lit(asked).alias("cut"), F.lit("you asked for it").alias("why"))
    found = sets.select("set_id").distinct().join(stable, "set_id", "left")
    why = F.when(F.col("middle").isNotNull(), F.concat(F.lit("most stable: "), F.col("students").cast("string"), F.lit(" students holds from "), two(F.col("low")), F.lit(" to "), two(F.col("high")))).otherwise("no stable plateau; falling back to SFace's pair threshold")
    return found.select("set_id", F.coalesce("middle", F.lit(PAIR_LINE)).alias("cut"), why.alias("why"))


def change_points(counts: DataFrame) -> DataFrame:
    """Cuts at which the count changes, and always the one next to the published pair line."""
    before = F.lag("students").over(Window.partitionBy("set_id").orderBy("cut"))
    marked = F.abs(F.col("cut") - PAIR_LINE) < 0.005
    rows = counts.withColumns({"_before": before, "marked": marked})
    return rows.filter(F.col("_before").isNull() | (F.col("_before") != F.col("students")) | F.col("marked")).drop("_before")


def assign(history: DataFrame, kept: DataFrame, cut: DataFrame) -> DataFrame:
    """set_id, idx, first (the group's earliest photo), group_no: the history replayed down to each set's cut."""
    used = history.join(cut.select("set_id", "cut"), "set_id").filter(F.col("height") >= F.col("cut")).select("set_id", "step", "i", "j")

    def replay(t: pa.Table, m: pa.Table) -> pa.Table:
        idx = np.sort(t.column("idx").to_numpy())
        slot = np.arange(len(idx))
        if m.num_rows:  # each slot is absorbed once, so its last owner is found by leaps
            slot[np.searchsorted(idx, m.column("j").to_numpy())] = np.searchsorted(idx, m.column("i").to_numpy())
            while (slot[slot] != slot).any():
                slot = slot[slot]
        return pa.table({"set_id": pa.array([t.column("set_id")[0].as_py()] * len(idx), t.schema.field("set_id").type), "idx": idx, "first": idx[slot] if len(idx) else idx})

    kind = kept.schema["set_id"].dataType.simpleString()
    out = kept.select("set_id", "idx").groupBy("set_id").cogroup(used.groupBy("set_id")).applyInArrow(replay, f"set_id {kind}, idx long, first long")
    return numbered(out)


def numbered(members: DataFrame) -> DataFrame:
    """group_no from 1 in order of the groups' earliest photos, and its label."""
    n = F.dense_rank().over(Window.partitionBy("set_id").orderBy("first"))
    return members.withColumn("group_no", n).withColumn("student", F.format_string("S%02d", "group_no"))


def near_components(kept: DataFrame, cut: float) -> DataFrame:
    """set_id, idx, part: components of the pairs at or above a cut, by shortest labels; no merge crosses them, so a
    set can be clustered part by part."""
    edges = pair_blocks(kept, cut)
    both = computed_once(edges.select("set_id", "i", "j").unionByName(edges.select("set_id", F.col("j").alias("i"), F.col("i").alias("j"))))
    label = computed_once(kept.select("set_id", F.col("idx").alias("i"), F.col("idx").alias("part")))
    while True:
        least = both.join(label.withColumnRenamed("i", "j"), ["set_id", "j"]).groupBy("set_id", "i").agg(F.min("part").alias("near"))
        new = label.join(least, ["set_id", "i"], "left").select("set_id", "i", F.least("part", F.coalesce("near", "part")).alias("part"))
        hop = new.select("set_id", F.col("i").alias("part"), F.col("part").alias("far"))
        new = computed_once(new.join(hop, ["set_id", "part"]).select("set_id", "i", F.col("far").alias("part")))
        if not new.join(label.withColumnRenamed("part", "old"), ["set_id", "i"]).filter("part <> old").limit(1).count():
            return new.withColumnRenamed("i", "idx")
        label = new


def assign_large(kept: DataFrame, cut: float, local: int = LOCAL) -> DataFrame:
    """assign() at one given cut, by components of near pairs: cheaper than a history where the cut leaves small ones.
    A component beyond `local` photos goes by rounds, down to the cut."""
    parts = near_components(kept, cut)
    keyed = kept.join(parts, ["set_id", "idx"]).withColumn("_set", F.struct("set_id", "part")).select(F.col("_set").alias("set_id"), "idx", "vec")
    flat = keyed.withColumn("set_id", F.to_json("set_id"))
    own = flat.join(keyed.select("idx", F.col("set_id.set_id").alias("real"), F.to_json("set_id").alias("set_id")), ["set_id", "idx"])
    found = assign(histories(flat, local, cut), flat, flat.select("set_id").distinct().withColumn("cut", F.lit(cut)))
    return numbered(found.select(F.col("set_id").alias("key"), "idx", "first").join(own.select(F.col("set_id").alias("key"), "idx", F.col("real").alias("set_id")), ["key", "idx"]).select("set_id", "idx", "first"))


# ---- signals on a given assignment (set_id, idx, group_no); pairs and members only ever meet inside a set


def frames(members: DataFrame) -> DataFrame:
    w = Window.partitionBy("set_id", "group_no")
    return members.withColumns({"frame": F.row_number().over(w.orderBy("idx")), "frames": F.count(F.lit(1)).over(w)}).withColumn("frame_of", F.concat_ws("/", "frame", "frames"))


def group_sizes(members: DataFrame) -> DataFrame:
    """set_id, shots, students: how many groups have so many photos."""
    return members.groupBy("set_id", "group_no").agg(F.count(F.lit(1)).alias("shots")).groupBy("set_id", "shots").agg(F.count(F.lit(1)).alias("students"))


def totals(members: DataFrame, expected: int | None = None) -> DataFrame:
    out = members.groupBy("set_id").agg(F.countDistinct("group_no").alias("students"), F.count(F.lit(1)).alias("photos"))
    return out if expected is None else out.withColumn("off_by", F.col("students") - expected)


def spans(members: DataFrame) -> DataFrame:
    """One row per group: first and last index and name, its size, and whether it is one unbroken run."""
    out = members.groupBy("set_id", "group_no").agg(F.min("idx").alias("first"), F.max("idx").alias("last"), F.count(F.lit(1)).alias("shots"), F.min_by("name", "idx").alias("first_name"), F.max_by("name", "idx").alias("last_name"))
    return out.withColumns({"span": F.concat_ws("..", "first_name", "last_name"), "one_run": F.col("last") - F.col("first") + 1 == F.col("shots")})


def broken_runs(members: DataFrame, most: int = 20, names: int = 6) -> DataFrame:
    """The first groups that are not one run, with the names of shots inside their span that are not theirs."""
    at = members.select("set_id", "idx", "name", "group_no", F.row_number().over(Window.partitionBy("set_id").orderBy("idx")).alias("_at"))
    found = at.groupBy("set_id", "group_no").agg(F.min("idx").alias("first"), F.max("idx").alias("last"), F.min_by("name", "idx").alias("first_name"), F.max_by("name", "idx").alias("last_name"), (F.max("_at") - F.min("_at") + 1 - F.count(F.lit(1))).alias("_others"))
    broken = first_rows(found.filter("_others > 0"), most, "group_no")  # only these meet the photos of their set
    inside = broken.select("set_id", "group_no", "first", "last").join(members.select("set_id", "idx", "name", F.col("group_no").alias("own")), "set_id").filter((F.col("idx") > F.col("first")) & (F.col("idx") < F.col("last")) & (F.col("own") != F.col("group_no")))
    inside = inside.withColumn("_n", F.row_number().over(Window.partitionBy("set_id", "group_no").orderBy("idx"))).filter(F.col("_n") <= names)
    gaps = inside.groupBy("set_id", "group_no").agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "name"))), lambda x: x["name"]).alias("g"))
    text = F.concat(F.array_join("g", ", "), F.when(F.col("_others") > names, " ...").otherwise(""))
    return broken.join(gaps, ["set_id", "group_no"]).select("set_id", "group_no", "first_name", "last_name", text.alias("skipping"))


def group_pairs(links: DataFrame) -> DataFrame:
    """Mean similarity of every two groups, from group_links(): set_id, a, b (a < b), sim."""
    return links.filter("a <> b").select("set_id", "a", "b", (F.col("total") / F.col("n")).alias("sim"))


def weakest_inside(links: DataFrame) -> DataFrame:
    """The least similar pair of each group of two or more, from group_links(): set_id, group_no, sim, i, j."""
    return links.filter("a = b").select("set_id", F.col("a").alias("group_no"), "sim", "i", "j")


def weakest_pairs(kept: DataFrame, members: DataFrame, block: int = 1024) -> DataFrame:
    """weakest_inside() without the links between groups."""
    rows = kept.select("set_id", "idx", "vec").join(members.select("set_id", "idx", F.col("group_no").cast("long").alias("_g")), ["set_id", "idx"])

    def weakest(t: pa.Table) -> pa.Table:
        t, a, b, sim, keep = _product(t)
        idx, g = t.column("idx").to_numpy(), t.column("_g").to_numpy()
        i, j = np.nonzero(keep & (g[a][:, None] == g[b][None]))
        order = np.lexsort((idx[b][j], idx[a][i], sim[i, j], g[a][i]))
        i, j = i[order], j[order]
        own, first = np.unique(g[a][i], return_index=True)
        i, j = i[first], j[first]
        return pa.table({"set_id": _of_set(t, len(own)), "group_no": own, "sim": sim[i, j], "i": idx[a][i], "j": idx[b][j]})

    kind = kept.schema["set_id"].dataType.simpleString()
    found = _tiles(rows, block, "_g").groupBy("set_id", "lo", "hi").applyInArrow(weakest, f"set_id {kind}, group_no long, sim double, i long, j long")
    return found.groupBy("set_id", "group_no").agg(F.min(F.struct("sim", "i", "j")).alias("w")).select("set_id", "group_no", "w.*")


def between_groups(kept: DataFrame, members: DataFrame, n: int = 4, block: int = 2048, bins: int = 8192) -> tuple[DataFrame, DataFrame]:
    """What closest_groups() and separation() want of group_pairs(), where no row stands for a pair of groups either:
    set_id, closest, closest_median, n_pairs; and the n closest pairs (set_id, a, b, sim, place). group_no has no gaps
    (numbered()). The mean of a pair of groups is the product of their mean vectors. Tiles count the means by bins;
    the bins that hold the middle are then known, and only their values are sorted. What is stored holds no vectors."""
    kind = kept.schema["set_id"].dataType.simpleString()
    rows = kept.select("set_id", "idx", "vec").join(members.select("set_id", "idx", F.col("group_no").cast("long").alias("g")), ["set_id", "idx"])
    means = group_means(rows).select("set_id", (F.col("g") - 1).alias("idx"), "vec")
    counts = members.groupBy("set_id").agg(F.max("group_no").alias("n"))

    def counted(t: pa.Table) -> pa.Table:
        t, a, b, sim, keep = _product(t)
        x = sim[keep]
        held = np.bincount(np.minimum((x + 1) * (bins / 2), bins - 1).astype(np.int64), minlength=bins) if len(x) else np.zeros(0, np.int64)
        full = np.flatnonzero(held)
        i, j = np.nonzero(keep & (sim >= np.partition(x, -n)[-n]) if len(x) > n else keep)
        p, q, x = t.column("idx").to_numpy()[a][i] + 1, t.column("idx").to_numpy()[b][j] + 1, sim[i, j]
        last = np.lexsort((q, p, x))[-n:]
        none = np.zeros(len(full), np.int64)
        own = np.concatenate((held[full], np.zeros(len(last), np.int64)))
        cols = {"bin": np.concatenate((full, np.full(len(last), -1))), "held": own, "sim": np.concatenate((none.astype(float), x[last])), "a": np.concatenate((none, p[last])), "b": np.concatenate((none, q[last]))}
        return pa.table({"set_id": _of_set(t, len(own))} | cols)

    tiles = _tiles(means, block, counts=counts).groupBy("set_id", "lo", "hi").applyInArrow(counted, f"set_id {kind}, bin long, held long, sim double, a long, b long")
    seen = computed_once(tiles.groupBy("set_id", "bin", "a", "b").agg(F.sum("held").alias("held"), F.max("sim").alias("sim")))
    closest = closest_groups(seen.filter("bin < 0").select("set_id", "a", "b", "sim"), n)

    upto, whole = Window.partitionBy("set_id").orderBy("bin"), Window.partitionBy("set_id")
    held = seen.filter("bin >= 0").select("set_id", "bin", "held", F.sum("held").over(upto).alias("_to"), F.sum("held").over(whole).alias("n_pairs"))
    held = held.withColumns({"_r": F.floor((F.col("n_pairs") - 1) / 2), "_q": F.floor(F.col("n_pairs") / 2)})
    within = lambda r: (F.col("_to") > F.col(r)) & (F.col("_to") - F.col("held") <= F.col(r))
    middle = held.filter(within("_r") | within("_q")).groupBy("set_id").agg(F.min("bin").alias("_b"), F.max("bin").alias("_e"), F.max("n_pairs").alias("n_pairs"))
    middle = computed_once(middle)
    # means may come out with other last digits, so what lies about the bins' edges is taken too, and what lies below counted anew
    edges = middle.select("set_id", (F.col("_b") * (2 / bins) - 1 - 1e-9).alias("_low"), ((F.col("_e") + 1) * (2 / bins) - 1 + 1e-9).alias("_high"))

    def inside(t: pa.Table) -> pa.Table:
        t, a, b, sim, keep = _product(t)
        low, high = t.column("_low")[0].as_py(), t.column("_high")[0].as_py()
        x = np.append(sim[keep & (sim >= low) & (sim <= high)], 0.0)
        below = np.zeros(len(x), np.int64)
        below[-1] = (keep & (sim < low)).sum()
        return pa.table({"set_id": _of_set(t, len(x)), "sim": x, "below": below, "value": np.arange(len(x)) < len(x) - 1})

    near = _tiles(means.join(edges, "set_id"), block, "_low", "_high", counts=counts).groupBy("set_id", "lo", "hi").applyInArrow(inside, f"set_id {kind}, sim double, below long, value boolean")
    near = computed_once(near.filter("value or below > 0"))
    below = near.filter("not value").groupBy("set_id").agg(F.sum("below").alias("_below"))
    ranked = near.filter("value").select("set_id", "sim", (F.row_number().over(Window.partitionBy("set_id").orderBy("sim")) - 1).alias("_k"))
    ranked = ranked.join(middle, "set_id").join(below, "set_id", "left").withColumn("_k", F.col("_k") + F.coalesce("_below", F.lit(0)))
    medians = ranked.filter((F.col("_k") == F.floor((F.col("n_pairs") - 1) / 2)) | (F.col("_k") == F.floor(F.col("n_pairs") / 2))).groupBy("set_id").agg(F.avg("sim").alias("closest_median"), F.max("n_pairs").alias("n_pairs"))
    return closest.filter("place = 1").select("set_id", F.col("sim").alias("closest")).join(medians, "set_id").select("set_id", "closest", "closest_median", "n_pairs"), closest


def separation(inside: DataFrame, between: DataFrame) -> DataFrame:
    """One row per set with any pair; NULL where a set has no group of two or more, or only one group. between:
    group_pairs(), or its summary by between_groups()."""
    a = inside.groupBy("set_id").agg(F.min("sim").alias("weakest"), F.median("sim").alias("weakest_median"))
    b = between if "closest" in between.columns else between.groupBy("set_id").agg(F.max("sim").alias("closest"), F.median("sim").alias("closest_median"), F.count(F.lit(1)).alias("n_pairs"))
    return a.join(b, "set_id", "full").withColumn("n_pairs", F.coalesce("n_pairs", F.lit(0).cast("long"))).withColumn("gap", F.col("weakest") - F.col("closest")).withColumn("verdict", F.when(F.col("gap") > 0, "clean separation, no overlap").when(F.col("gap").isNotNull(), "they overlap, so the pairs listed below decide the count"))


def best_other(kept: DataFrame, block: int = 1024) -> DataFrame:
    """Largest similarity of each photo to any other of its set; none for the only photo of a set."""

    def best(t: pa.Table) -> pa.Table:
        t, a, b, sim, keep = _product(t)
        idx, top = t.column("idx").to_numpy(), np.full(t.num_rows, -np.inf)
        part = np.where(keep, sim, -np.inf)
        top[a] = part.max(1)
        top[b] = np.maximum(top[b], part.max(0))
        have = np.flatnonzero(top > -np.inf)
        return pa.table({"set_id": _of_set(t, len(have)), "idx": idx[have], "best_other": top[have]})

    kind = kept.schema["set_id"].dataType.simpleString()
    found = _tiles(kept, block).groupBy("set_id", "lo", "hi").applyInArrow(best, f"set_id {kind}, idx long, best_other double")
    return found.groupBy("set_id", "idx").agg(F.max("best_other").alias("best_other"))


def first_rows(rows: DataFrame, n: int, *order: Column | str) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("set_id").orderBy(*order))
    return rows.withColumn("place", place).filter(F.col("place") <= n)


def closest_groups(between: DataFrame, n: int = 4) -> DataFrame:
    return first_rows(between, n, F.desc("sim"), F.desc("a"), F.desc("b"))


def weakest_groups(inside: DataFrame, n: int = 4) -> DataFrame:
    return first_rows(inside, n, "sim", "group_no")


def loneliest(best: DataFrame, members: DataFrame, n: int = 6) -> DataFrame:
    """The photos whose best match is worst, with their group, and grade and sharpness where members have them."""
    return first_rows(best.join(members, ["set_id", "idx"], "left"), n, F.asc_nulls_first("best_other"), "idx")


def with_report(members: DataFrame, report: DataFrame) -> DataFrame:
    """members (name) plus source, grade, reasons, eye_sharpness and head_size of the report's outputs; defaults
    where the report has no such output. Of several rows with one output, that with the last source counts."""
    own = F.max(F.struct("source", "grade", "reasons", "eye_sharpness", "head_size")).alias("r")
    r = report.filter("output is not null").withColumn("name", F.col("output")).join(members.select("set_id", "name"), ["set_id", "name"], "left_semi")
    r = r.groupBy("set_id", "name").agg(own).select("set_id", "name", "r.*")
    out = members.join(r, ["set_id", "name"], "left")
    return out.withColumns({"source": F.coalesce("source", F.lit("")), "grade": F.coalesce("grade", F.lit("")), "reasons": F.coalesce("reasons", F.array().cast("array<string>")), "eye_sharpness": F.coalesce("eye_sharpness", F.lit(0.0)), "head_size": F.coalesce("head_size", F.lit(1.0))})


def picks(members: DataFrame) -> DataFrame:
    """members plus pick: the best own grade, then the sharpest eyes, then the head nearest to standard size."""
    own = F.when(F.size("reasons") == 0, 0).when(F.col("grade") != "FAIL", 1).otherwise(2)
    order = Window.partitionBy("set_id", "group_no").orderBy(own, F.desc("eye_sharpness"), F.abs(F.col("head_size") - 1), "idx")
    return members.withColumn("pick", F.row_number().over(order) == 1)


def fit_to_group(kept: DataFrame, members: DataFrame) -> DataFrame:
    """set_id, idx, fit: dot of each photo with its group's mean direction."""
    rows = kept.select("set_id", "idx", "vec").join(members.select("set_id", "idx", "group_no"), ["set_id", "idx"])
    centre = group_means(rows.select("set_id", F.col("group_no").cast("long").alias("g"), "vec")).select("set_id", F.col("g").alias("group_no"), F.col("vec").alias("c"))
    norm = F.sqrt(F.aggregate("c", F.lit(0.0), lambda s, x: s + x * x))
    centre = centre.withColumn("c", F.transform("c", lambda x: x / F.when(norm == 0, 1.0).otherwise(norm)))
    return rows.join(centre, ["set_id", "group_no"]).select("set_id", "idx", F.bround(cosine(F.col("vec"), F.col("c")), 3).alias("fit"))


def grouped_result(members: DataFrame, cut: DataFrame, counts: DataFrame) -> DataFrame:
    """One row per set: students, photos, threshold, why, sweep and groups, nested. members need name and pick."""
    groups = members.groupBy("set_id", "group_no").agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "name"))), lambda x: x["name"]).alias("photos"), F.min(F.when(F.col("pick"), F.col("name"))).alias("pick"))
    groups = groups.groupBy("set_id").agg(F.array_sort(F.collect_list(F.struct(F.format_string("S%02d", "group_no").alias("id"), "photos", "pick"))).alias("groups"))
    swept = counts.groupBy("set_id").agg(F.array_sort(F.collect_list(F.struct("cut", "students"))).alias("sweep"))
    return totals(members).join(cut.select("set_id", F.bround("cut", 3).alias("threshold"), "why"), "set_id").join(swept, "set_id").join(groups, "set_id")
