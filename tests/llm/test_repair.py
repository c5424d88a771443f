import hashlib
import random
import re

from pyspark.sql import functions as F

from proofset.llm import repair as rp

ROWS = "conv_id long, turn long, role string, text string"


def brute(rows):
    """(cost, audit, repaired) by trying every edit of every row, with up to two inserts between rows."""
    seen, faults = set(), []
    for role, text in rows:
        body = re.sub(r"[\x20\x09-\x0D]+$", "", text)
        faults.append("blank" if not body else "duplicate" if (role, text) in seen else "" if body[-1] in ".!?" else "truncated")
        seen.add((role, text))
    best = None

    def go(i, cost, audit, out):
        nonlocal best
        for extra in ([], ["user"], ["assistant"], ["user", "assistant"], ["assistant", "user"]):
            done = out + [(r, "") for r in extra]
            c, a = cost + 5 * len(extra), audit + "I" * len(extra)
            if i == len(rows):
                if re.fullmatch("(s?(ua)+)?", "".join(r[:1] or "-" for r, _ in done)) and (best is None or (c, a) < best[:2]):
                    best = (c, a, done)
                continue
            role, text = rows[i]
            go(i + 1, c + 2, a + "D", done)
            if faults[i] not in ("blank", "duplicate"):
                late = 5 * (faults[i] == "truncated")
                go(i + 1, c + late, a + "K", done + [(role, text)])
                for r in ("user", "assistant"):
                    go(i + 1, c + 1 + late, a + "R", done + [(r, text)])

    go(0, 0, "", [])
    return faults, best


def check(spark, rows, **kw):
    fixed = rp.repair(spark.createDataFrame(rows, ROWS), **kw)
    report = {r.conv_id: r for r in fixed.report.collect()}
    digest = {r.conv_id: r.repaired_sha256 for r in rp.digests(fixed.blocks).collect()}
    turns = {}
    for t in sorted(fixed.turns().collect(), key=lambda t: (t.block, t.place)):
        turns.setdefault(t.conv_id, []).append((t.role, t.text))
    convs = {}
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        convs.setdefault(conv, []).append((turn is not None, turn or 0, role, hashlib.md5(text.encode()).hexdigest(), text))
    assert set(report) == set(convs)
    for conv, own in convs.items():
        own = sorted(own)
        faults, (cost, audit, done) = brute([(r, t) for *_, r, _, t in own])
        got = report[conv]
        assert (got.cost, got.audit, turns.get(conv, [])) == (cost, audit, done), (conv, own)
        assert [got[f] for f in ("blank", "duplicate", "truncated")] == [faults.count(f) for f in ("blank", "duplicate", "truncated")]
        marks = [r[:1] for _, _, r, _, _ in own]
        assert got.illegal == sum(a + b not in ("su", "ua", "au") for a, b in zip(marks, marks[1:]))
        known = [t for k, t, *_ in own if k]
        assert got.gaps == (max(known) - min(known) + 1 - len(set(known)) if known else 0)
        assert digest[conv] == hashlib.sha256("\n".join(f"{r}:{t}" for r, t in done).encode()).hexdigest()


def random_rows(seed, convs, most):
    r = random.Random(seed)
    out = []
    for c in range(convs):
        for k in range(r.randint(1, most)):
            turn = r.choice([None, k, k, k, k, max(0, k - 1)])
            row = (c if c else None, turn, r.choice(["user", "assistant", "user", "assistant", "system", None, "", "tool"]), r.choice(["Ok.", "Yes!", "cut", " \t", "", None, "Why?\n", "other. "]))
            out += [row] * r.choice([1, 1, 1, 2])
    return out


def test_repair_equals_trying_everything(spark):
    check(spark, random_rows(1, 40, 3))


def test_blocks_are_joined(spark):
    check(spark, random_rows(2, 12, 4), block_rows=1)
    check(spark, random_rows(3, 12, 4), block_rows=2)


def test_a_long_conversation_in_blocks_equals_one_derivation(spark):
    rows = [(7, k, ["user", "assistant", "system"][k * k % 3], f"{k % 40}" + ["", ".", "?"][k % 3]) for k in range(700)]
    whole, cut = (rp.repair(spark.createDataFrame(rows, ROWS), block_rows=n) for n in (1000, 50))
    assert whole.report.collect() == cut.report.collect()
    assert rp.digests(whole.blocks).collect() == rp.digests(cut.blocks).collect()


def test_edges(spark):
    none = rp.repair(spark.createDataFrame([], ROWS))
    assert none.report.count() == 0 and rp.digests(none.blocks).count() == 0
    odd = spark.createDataFrame([(1, 0, "user", "Hi. " * 1_000_000, 1, 2), (1, 1, "assistant", "Yes.", 3, 4)], "`conv.id` long, turn long, role string, text string, part long, `no` long")
    got = rp.repair(odd, conv_id="conv.id").report.collect()
    assert [(r.conv_id, r.cost, r.audit) for r in got] == [(1, 0, "KK")]
    many = spark.createDataFrame([(1, 0, "user", "Hi.")], ROWS)
    got = rp.repair(many, copies=F.lit(5)).report.first()
    assert (got.cost, got.audit, got.duplicate, got.illegal) == (10, "DDDDD", 4, 4)


def test_damage(spark):
    import zlib

    rows = [(c, t, "assistant", "One. Two!") for c in range(30) for t in range(3)] + [(None, None, None, None)]
    got = {(r.conv_id, r.turn): r for r in rp.damaged(spark.createDataFrame(rows, ROWS)).collect()}
    for c, t, *_ in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if kind == 0:
            assert (c, t) not in got
        elif c is not None:
            r = got[c, t]
            assert (r.role, r.text, r.copies) == ("user" if kind == 4 else "assistant", {1: "", 2: "One Two"}.get(kind, "One. Two!"), 2 if kind == 3 else 1)
