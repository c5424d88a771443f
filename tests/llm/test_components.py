import random

from proofset.llm import components as module
from proofset.llm import jaccard, language_id
from pyspark.sql import functions as F


def union_find(pairs):
    up = {x: x for p in pairs for x in p}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = sorted((root(a), root(b)))
        up[b] = a
    return {x: root(x) for x in up}


def planned(monkeypatch, *modules):
    """What these modules have written from now on: (label, exchanges and scans in the plan)."""
    seen = []
    for m in modules:
        def noted(df, label, write=m.written):
            seen.append((label, parts(df)))
            return write(df, label)

        monkeypatch.setattr(m, "written", noted)
    return seen


def parts(df):
    lines = df._jdf.queryExecution().executedPlan().toString().split("\n")
    return sum("Exchange" in x for x in lines), sum("FileScan" in x for x in lines)


def test_a_step_plans_little_and_components_are_right(spark, monkeypatch):
    """The driver plans, reports and keeps every step, so a step's plan must not hold the one before it several times."""
    rng = random.Random(5)
    chain = [(i, i + 1) for i in range(0, 60)]
    pairs = chain + [(100, k) for k in range(101, 160)] + [(400, k) for k in range(300, 350)] + [(rng.randrange(500, 600), rng.randrange(500, 600)) for _ in range(70)] + [(7, 7), (700, 700), *chain[:9]]
    pairs += [(b, a) for a, b in pairs[::3]]
    rng.shuffle(pairs)
    seen = planned(monkeypatch, module)
    got = {r.node: r.component for r in module.components(spark.createDataFrame(pairs, "a long, b long").repartition(3)).collect()}
    assert got == {k: v for k, v in union_find([p for p in pairs if p[0] != p[1]]).items()}
    assert len(seen) > 3 and max(p[0] for _, p in seen) <= 5 and max(p[1] for _, p in seen) <= 3, seen


def test_kept_documents_are_planned_from_what_is_stored(spark, tmp_path, monkeypatch):
    words = [f"w{i}" for i in range(40)]
    rows = [(k, " ".join(words[k % 7 :] + [f"x{k % 7}"])) for k in range(30)] + [(90, None), (91, " "), (3, " ".join(words[3:] + ["x3"]))]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    kept = jaccard.keep_one(docs, jaccard.Rule(width=5, num=4, den=5))
    assert parts(kept)[1] <= 5  # the documents three times, and twice who is kept
    sets = {i: frozenset(tuple((t or "").split()[j : j + 5]) for j in range(len((t or "").split()) - 4)) for i, t in rows}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    root = union_find(links)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i in sets if root.get(i, i) == i)


def test_a_repeated_id_is_one_text_of_the_sample(spark):
    rows = [(i, f"text number {i}", "ab"[i % 2]) for i in range(40)] + [(4, "text number 4", "a")] * 5
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    texts, labels = language_id.training_sample(docs, F.lit(True), "doc_id", "text", "lang", 100, 2, 48)
    assert sorted(texts) == sorted({t.encode() for _, t, _ in rows}) and labels.count("a") == labels.count("b") == 20
