"""Photos as directions in a plane, given by an angle: two photos are as alike as the cosine of the angle between."""

import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from proofset.operators import grouping as gr
from proofset.operators import sets
from proofset.plans import passes

PRINTS = "set_id string, photo_id long, name string, vec array<double>, detect_threshold double"


def likeness(degrees):
    a = np.radians(np.array(degrees, float))
    return np.cos(a[:, None] - a[None])


def at_cut(sim, cut):
    owner = list(range(len(sim)))
    for keep, gone, height in gr.merge_history(sim):
        if height < cut:
            break
        owner = [keep if o == gone else o for o in owner]
    return owner


def by_definition(sim, cut):
    """The owner of each photo: the two groups with the highest mean likeness join, while it is at least the cut."""
    owner = list(range(len(sim)))
    while True:
        names = sorted(set(owner))
        rows = {n: [k for k, o in enumerate(owner) if o == n] for n in names}
        ranked = sorted((-sim[np.ix_(rows[x], rows[y])].mean(), x, y) for x in names for y in names if x < y)
        if not ranked or -ranked[0][0] < cut:
            return owner
        _, x, y = ranked[0]
        owner = [x if o == y else o for o in owner]


@pytest.mark.parametrize("seed", range(6))
def test_history_answers_every_cut(seed):
    rng = np.random.default_rng(seed)
    sim = likeness(rng.uniform(0, 180, 17))
    for cut in (-0.9, 0.1, 0.45, 0.8, 0.97, 0.9999):
        assert at_cut(sim, cut) == by_definition(sim, cut)


def test_three_fans_of_photos():
    fans = [3.0, 4.5, 1.0, 62.0, 60.5, 121.0, 119.0, 122.5, 118.0, 120.0]
    sim = likeness(fans)
    assert len(set(at_cut(sim, math.cos(math.radians(30))))) == 3
    assert len(set(at_cut(sim, -1.0))) == 1 and at_cut(sim, 1.1) == list(range(10))
    assert gr.merge_history(sim[:1, :1]) == [] == gr.merge_history(sim[:0, :0])


def test_no_chain_of_small_steps():
    """Steps of 20 degrees: neighbours are alike, the ends are not, and means keep them apart."""
    owner = at_cut(likeness([0, 20, 40, 60, 80, 100]), math.cos(math.radians(35)))
    assert owner == by_definition(likeness([0, 20, 40, 60, 80, 100]), math.cos(math.radians(35))) and len(set(owner)) > 1


def test_plateau_takes_the_later_of_equal_runs(spark):
    ladder = [(0.25, 1), (0.31, 3), (0.32, 3), (0.33, 3), (0.34, 5), (0.35, 8), (0.36, 8), (0.37, 8), (0.79, 8), (0.80, 8)]
    rows = spark.createDataFrame([("a", c, n) for c, n in ladder] + [("b", 0.1, 2)], "set_id string, cut double, students int")
    found = {r.set_id: r for r in gr.plateau(rows).collect()}
    assert set(found) == {"a"} and (found["a"].students, found["a"].low, found["a"].high, found["a"].middle) == (8, 0.35, 0.37, 0.36)
    cuts = {r.set_id: r.cut for r in gr.operating_cut(rows, gr.plateau(rows)).collect()}
    assert cuts == {"a": 0.36, "b": gr.PAIR_LINE}
    marked = [(r.cut, r.marked) for r in gr.change_points(rows.filter("set_id = 'a'")).orderBy("cut").collect()]
    assert marked == [(0.25, False), (0.31, False), (0.34, False), (0.35, False), (0.36, True)]


def fans(spark, spread=1.5, sets=("x", "y")):
    rng = np.random.default_rng(21)
    rows = []
    for s in sets:
        for person, (middle, n) in enumerate([(10, 4), (100, 3), (190, 5), (280, 2)]):
            for _ in range(n):
                a = math.radians(middle + rng.uniform(-spread, spread))
                k = len(rows)
                rows.append((s, k, f"A{k:03d}_{person}.jpg", [7 * math.cos(a), 7 * math.sin(a)], 0.5 if k % 6 == 0 else 0.9))
    rows += [("x", 500, "dark.jpg", None, None), ("x", 501, "flat.jpg", [0.0, 0.0], 0.9), ("y", 502, "empty.jpg", [1.0, 1.0], None)]
    return spark.createDataFrame(rows, PRINTS)


def test_a_whole_pass_groups_every_set(spark):
    report = spark.createDataFrame([("x", "A000_0.jpg", "raw0", "FAIL", ["soft"], 0.9, 1.0)], "set_id string, output string, source string, grade string, reasons array<string>, eye_sharpness double, head_size double")
    got = passes.analyze_sets(fans(spark), report)
    members = got.members.collect()
    groups = {(r.set_id, r.group_no): set() for r in members}
    for r in members:
        groups[r.set_id, r.group_no].add(r.name[-5])
    assert len(members) == 28 and len(groups) == 8 and all(len(v) == 1 for v in groups.values())
    assert sum(r.pick for r in members) == 8 and not next(r.pick for r in members if r.name == "A000_0.jpg") and all(r.fit > 0.99 for r in members)
    text = [r.line for r in got.lines.orderBy("set_id", "section", "ordinal").collect() if r.set_id == "x"]
    assert text[0] == "4 students across 14 photos"
    assert sum("unreadable" in t or "empty fingerprint" in t for t in text) == 2 and sum("found only at 0.5" in t for t in text) == 3
    nested = {r.set_id: r for r in got.result.collect()}
    assert [len(g.photos) for g in nested["y"].groups] == [4, 3, 5, 2] and len(nested["y"].sweep) == 71


def test_large_sets_by_components_give_the_same_groups(spark):
    kept, _, _ = gr.intake(fans(spark))
    cut = 0.8
    small = gr.assign(gr.histories(kept), kept, kept.select("set_id").distinct().withColumn("cut", F.lit(cut)))
    large = gr.assign_large(kept, cut, local=4)
    key = lambda df: sorted((r.set_id, r.idx, r.group_no) for r in df.collect())
    assert key(small) == key(large)


def same_history(rounds, greedy):
    """Equal heights, and equal groups after each distinct height."""
    assert [h for *_, h in rounds] == pytest.approx([h for *_, h in greedy], abs=1e-9)
    for cut in {round(h, 9) for *_, h in greedy}:
        owner = {}
        for name, found in (("rounds", rounds), ("greedy", greedy)):
            slot = list(range(len(greedy) + 1))
            for i, j, h in found:
                if h >= cut - 1e-9:
                    slot = [i if x == j else x for x in slot]
            owner[name] = slot
        assert owner["rounds"] == owner["greedy"]


@pytest.mark.parametrize("seed", [1])
def test_rounds_of_nearest_pairs_are_the_greedy_merges(spark, seed):
    """Sets of vectors with many exact ties (components of plus or minus a half) and of random ones."""
    rng = np.random.default_rng(seed)
    sets_ = {"ties": rng.choice([-0.5, 0.5], (50, 4)), "random": rng.normal(size=(60, 8)), "few": rng.normal(size=(5, 8)), None: rng.normal(size=(30, 3))}
    rows = [(s, k, [float(x) for x in v / np.linalg.norm(v)]) for s, vs in sets_.items() for k, v in enumerate(vs)]
    kept = spark.createDataFrame(rows, "set_id string, idx long, vec array<double>").repartition(3)
    got = {}
    for r in gr.histories(kept, local=20, block=16).orderBy("set_id", "step").collect():
        got.setdefault(r.set_id, []).append((r.i, r.j, r.height))
    for s, vs in sets_.items():
        v = np.array([x for t, _, x in rows if t == s])
        same_history(got[s], gr.merge_history(np.clip(v @ v.T, -1, 1)))


def test_rounds_end_at_the_floor(spark):
    rng = np.random.default_rng(5)
    v = rng.normal(size=(80, 16))
    kept = spark.createDataFrame([("s", k, [float(x) for x in u / np.linalg.norm(u)]) for k, u in enumerate(v)], "set_id string, idx long, vec array<double>")
    some = gr.histories(kept, local=30, floor=0.4).cache()
    every = gr.histories(kept).collect()
    assert some.filter("height >= 0.4").count() == sum(r.height >= 0.4 for r in every) > 0
    cut = kept.select("set_id").distinct().withColumn("cut", F.lit(0.4))
    key = lambda df: sorted((r.idx, r.group_no) for r in df.collect())
    assert key(gr.assign(some, kept, cut)) == key(gr.assign(gr.histories(kept), kept, cut))


def test_pairs_of_blocks_are_all_pairs(spark):
    kept, skipped, weak = gr.intake(fans(spark))
    assert {(r.name, r.reason) for r in skipped.collect()} == {("dark.jpg", "unreadable"), ("flat.jpg", "empty fingerprint"), ("empty.jpg", "no face found")} and weak.count() == 5
    for floor in (None, 0.5):
        want = {(r.set_id, r.i, r.j): r.sim for r in gr.pairs(kept, floor).collect()}
        got = {(r.set_id, r.i, r.j): r.sim for r in gr.pair_blocks(kept, floor, block=4).collect()}
        assert want.keys() == got.keys() and all(abs(want[k] - got[k]) < 1e-12 for k in want)


def test_reduced_pairs_are_all_pairs_reduced(spark):
    kept, _, _ = gr.intake(fans(spark, sets=("x", "y")))
    groups = kept.withColumn("group_no", F.col("idx") % 3)
    own = {(r.set_id, r.idx): r.group_no for r in groups.collect()}
    between, inside, best = {}, {}, {}
    for r in gr.pairs(kept).collect():
        a, b = sorted((own[r.set_id, r.i], own[r.set_id, r.j]))
        between.setdefault((r.set_id, a, b), []).append(r.sim)
        if a == b:
            inside.setdefault((r.set_id, a), []).append((r.sim, r.i, r.j))
        for k in (r.i, r.j):
            best[r.set_id, k] = max(best.get((r.set_id, k), -2), r.sim)
    for block in (2, 5, 1024):
        links = gr.group_links(kept, groups, block).cache()
        means = {(r.set_id, r.a, r.b): r.sim for r in gr.group_pairs(links).collect()}
        assert means == pytest.approx({k: sum(v) / len(v) for k, v in between.items() if k[1] < k[2]})
        weak = {(r.set_id, r.group_no): r.sim for r in gr.weakest_inside(links).collect()}
        assert weak == pytest.approx({k: min(v)[0] for k, v in inside.items()})
        assert {(r.set_id, r.idx): r.best_other for r in gr.best_other(kept, block).collect()} == pytest.approx(best)


def test_sweep_counts_the_merges_of_every_cut(spark):
    kept, _, _ = gr.intake(fans(spark, sets=("x", "y")))
    history = gr.histories(kept).cache()
    heights, photos = {}, {}
    for r in history.collect():
        heights.setdefault(r.set_id, []).append(r.height)
    for r in kept.collect():
        photos[r.set_id] = photos.get(r.set_id, 0) + 1
    got = {(r.set_id, r.cut): r.students for r in gr.sweep(history, kept).collect()}
    assert got == {(s, cut): n - sum(h >= raw for h in heights.get(s, [])) for s, n in photos.items() for raw, cut in gr.cuts()}


def test_separation_has_a_row_for_every_set(spark):
    kept, _, _ = gr.intake(fans(spark, sets=("x", "y", "z")))
    groups = kept.withColumn("group_no", F.when(F.col("set_id") == "x", F.col("idx")).when(F.col("set_id") == "y", 1).otherwise(F.col("idx") % 2))
    rows = gr.group_links(kept, groups, block=3)
    got = {r.set_id: r for r in gr.separation(gr.weakest_inside(rows), gr.group_pairs(rows)).collect()}
    assert got["x"].weakest is None and got["x"].closest is not None and got["x"].gap is None and got["x"].verdict is None
    assert got["y"].closest is None and got["y"].n_pairs == 0 and got["z"].gap < 0


def test_sheets_and_broken_runs(spark):
    rows = [("s", k, f"n{k:02d}", 1 if k < 15 and k != 4 else 2 + k // 10) for k in range(40)]
    members = spark.createDataFrame(rows, "set_id string, idx long, name string, group_no long")
    got = {r.group_no: r for r in sets.sheets(members, groups=2).collect()}
    assert (got[1].sheet, got[1].row, len(got[1].shown), got[1].more) == (1, 1, 12, "+2") and got[2].more == "" and (got[4].sheet, got[4].row) == (2, 2)
    broken = {r.group_no: r.skipping for r in gr.broken_runs(members).collect()}
    assert broken == {1: "n04"}
    many = spark.createDataFrame([("s", k, f"n{k:03d}", k % 30) for k in range(90)], "set_id string, idx long, name string, group_no long")
    shown = gr.broken_runs(many).collect()
    assert len(shown) == 20 and all(r.skipping.endswith(" ...") and r.skipping.count(",") == 5 for r in shown)


def test_a_report_that_repeats_an_output_does_not_double_members(spark):
    members = spark.createDataFrame([("s", 0, "a.jpg", 1), ("s", 1, "b.jpg", 1)], "set_id string, idx long, name string, group_no long")
    rows = [("s", "a.jpg", n, g, [], 0.5, 1.0) for n, g in (("raw1", "PASS"), ("raw2", "FAIL"))] + [("s", None, "raw3", "SKIPPED", [], None, None)]
    report = spark.createDataFrame(rows, "set_id string, output string, source string, grade string, reasons array<string>, eye_sharpness double, head_size double")
    assert sorted((r.name, r.source, r.grade) for r in gr.with_report(members, report).collect()) == [("a.jpg", "raw2", "FAIL"), ("b.jpg", "", "")]


def exact_merges(v, scale):
    """The greedy merges of vectors of whole numbers / scale, by fractions; ties to the smallest slots."""
    whole = {k: np.rint(x * scale).astype(int) for k, x in enumerate(v)}
    size, out = dict.fromkeys(whole, 1), []
    while len(whole) > 1:
        height, x, y = min((-Fraction(int(whole[x] @ whole[y]), scale * scale * size[x] * size[y]), x, y) for x in whole for y in whole if x < y)
        out.append((x, y, float(-height)))
        whole[x], size[x] = whole[x] + whole.pop(y), size[x] + size.pop(y)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_merges_from_vectors_alone_are_the_greedy_ones(seed):
    """Many exact ties, random vectors, copies, and a star: all are nearest to one of them."""
    rng = np.random.default_rng(seed)
    ties = rng.choice([-0.5, 0.5], (40, 4))
    same_history(list(zip(*gr.near_history(ties, cells=64), strict=True)), exact_merges(ties, 2))
    star = np.concatenate([np.eye(9)[:1], np.eye(9)[:1] + 0.1 * rng.normal(size=(60, 9))])
    for v in (rng.normal(size=(90, 8)), np.repeat(rng.normal(size=(9, 5)), 7, axis=0), star):
        v = v / np.linalg.norm(v, axis=1)[:, None]
        greedy = gr.merge_history(np.clip(v @ v.T, -1, 1))
        same_history(list(zip(*gr.near_history(v, cells=256), strict=True)), greedy)
        assert len(gr.near_history(v, floor=0.3)[0]) == sum(h >= 0.3 for *_, h in greedy)
    assert [len(x) for x in gr.near_history(np.ones((1, 3)))] == [0, 0, 0] == [len(x) for x in gr.near_history(np.ones((0, 3)))]


def test_a_set_of_thousands_needs_no_rounds(spark, monkeypatch):
    """Rounds are many jobs, each of which leaves something on the driver."""
    monkeypatch.setattr(gr, "linked_history", None)
    rng = np.random.default_rng(8)
    v = rng.normal(size=(2200, 16))
    v /= np.linalg.norm(v, axis=1)[:, None]
    kept = spark.createDataFrame([("s", k, u.tolist()) for k, u in enumerate(v)], "set_id string, idx long, vec array<double>")
    got = sorted((r.step, r.i, r.j, r.height) for r in gr.histories(kept).collect())
    greedy = gr.merge_history(np.clip(v @ v.T, -1, 1))
    assert sorted((i, j) for _, i, j, _ in got) == sorted((i, j) for i, j, _ in greedy)
    assert [h for *_, h in got] == pytest.approx([h for *_, h in greedy], abs=1e-9)


def test_the_sweep_of_a_set_of_thousands_needs_no_rounds(spark, monkeypatch):
    monkeypatch.setattr(gr, "linked_history", None)
    rng = np.random.default_rng(9)
    v = rng.normal(size=(2100, 12))
    v /= np.linalg.norm(v, axis=1)[:, None]
    kept = spark.createDataFrame([("s", k, u.tolist()) for k, u in enumerate(v)], "set_id string, idx long, vec array<double>")
    heights = np.minimum.accumulate([h for *_, h in gr.merge_history(np.clip(v @ v.T, -1, 1))])
    got = {r.cut: r.students for r in gr.sweep(gr.histories(kept), kept).collect()}
    assert got == {cut: 2100 - int((heights >= raw).sum()) for raw, cut in gr.cuts()}


def test_closest_groups_and_their_median_without_pairs_of_groups(spark):
    """Sets with an odd, an even and no number of pairs of groups; one of equal means."""
    rng = np.random.default_rng(4)
    sizes = {"odd": 30, "even": 33, "one": 4, "two": 2, "same": 12}
    rows, own = [], []
    for s, n in sizes.items():
        v = np.ones((n, 3)) if s == "same" else rng.normal(size=(n, 3))
        for k, u in enumerate(v):
            rows.append((s, k, (u / np.linalg.norm(u)).tolist()))
            own.append((s, k, {"odd": k // 2, "even": k // 3, "one": 0}.get(s, k) + 1))
    kept = spark.createDataFrame(rows, "set_id string, idx long, vec array<double>")
    members = spark.createDataFrame(own, "set_id string, idx long, group_no int")
    links = gr.group_links(kept, members).cache()
    want = {r.set_id: r for r in gr.separation(gr.weakest_inside(links), gr.group_pairs(links)).collect()}
    near = sorted((r.set_id, r.place, r.a, r.b) for r in gr.closest_groups(gr.group_pairs(links).filter("set_id <> 'same'")).collect())
    weak = sorted((r.set_id, r.group_no, r.i, r.j) for r in gr.weakest_inside(links).collect())
    for block, bins in ((4, 8), (1024, 8192)):
        assert sorted((r.set_id, r.group_no, r.i, r.j) for r in gr.weakest_pairs(kept, members, block).collect()) == weak
        between, closest = gr.between_groups(kept, members, block=block, bins=bins)
        got = {r.set_id: r for r in gr.separation(gr.weakest_pairs(kept, members, block), between).collect()}
        assert got.keys() == want.keys() and got["one"].n_pairs == 0 and got["two"].n_pairs == 1
        for s, r in want.items():
            assert (got[s].n_pairs, got[s].verdict) == (r.n_pairs, r.verdict)
            assert all(got[s][c] == pytest.approx(r[c], abs=1e-12) for c in ("weakest", "weakest_median", "closest", "closest_median", "gap"))
        assert sorted((r.set_id, r.place, r.a, r.b) for r in closest.collect() if r.set_id != "same") == near


def test_a_pass_makes_no_row_for_a_pair_of_groups(spark, monkeypatch):
    """Sets of strangers: each photo is a group, so there are as many pairs of groups as of photos."""
    monkeypatch.setattr(gr, "group_links", None)
    monkeypatch.setattr(gr, "group_pairs", None)
    v = np.eye(40)
    prints = spark.createDataFrame([("s", k, f"n{k:02d}.jpg", u.tolist(), 0.9) for k, u in enumerate(v)], PRINTS)
    report = spark.createDataFrame([], "set_id string, output string, source string, grade string, reasons array<string>, eye_sharpness double, head_size double")
    lines = [r.line for r in passes.analyze_sets(prints, report).lines.filter("section = 2").collect()]
    assert any("(median 0.000 over 780 pairs)" in t for t in lines)


def test_broken_runs_of_photos_with_gaps_between(spark):
    """A gap without photos is no break; only the first broken groups meet the photos of their set."""
    rows = [("s", k, f"n{k:02d}", g) for k, g in ((0, 1), (5, 1), (6, 2), (7, 3), (9, 2), (12, 3), (13, 4))]
    members = spark.createDataFrame(rows, "set_id string, idx long, name string, group_no long")
    assert [(r.group_no, r.first_name, r.last_name, r.skipping) for r in gr.broken_runs(members, most=1).collect()] == [(2, "n06", "n09", "n07")]
    assert {r.group_no: r.skipping for r in gr.broken_runs(members).collect()} == {2: "n07", 3: "n09"}
