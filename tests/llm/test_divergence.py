import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from proofset.llm import divergence as dv

DOCS = "doc_id long, text string, lang string, source string, term string, no long"


def brute(rows, least, top=10):
    docs = [(lang or "", source or "", Counter(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")))) for _, text, lang, source, *_ in rows]
    df, out = defaultdict(Counter), []
    for lang, _, n in docs:
        df[lang].update(n.keys())
    groups = defaultdict(Counter)
    for lang, source, n in docs:
        groups[lang, source].update({t: k for t, k in n.items() if df[lang][t] >= least})
    f = lambda p, q: (p - q) ** 2 // (p + q)
    for (lang, source), n in groups.items():
        terms = [t for t, k in df[lang].items() if k >= least]
        share = lambda c: {t: 1 + 10**9 * (c[t] + 2) // (sum(c.values()) + 2 * len(terms)) for t in terms}
        p = share(n)
        q = share(sum((m for (x, _), m in groups.items() if x == lang), Counter()))
        pairs = [(sum(f(p[t], v) for t, v in share(m).items()), s) for (x, s), m in groups.items() if x == lang and s != source]
        over = [(f(p[t], q[t]), t) for t in terms if n[t] and p[t] > q[t]]
        for part, found, most in (("pair", pairs, None), ("term", over, top)):
            out += [(lang, source, part, item, v, k + 1) for k, (v, item) in enumerate(sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most])]
    return sorted(out)


def rows(seed, docs=120, sources=9):
    r = random.Random(seed)
    words = ["alpha", "Beta", "GAMMA", "delta", "çé", "Ünï", "x", "y", "z", "mot"] + [f"w{chr(97 + k)}" for k in range(12)]
    out = [(k, " ,3".join(r.choices(words, k=r.randint(0, 20), weights=range(len(words), 0, -1))), r.choice(["en", "fr", None]), r.choice([None, *[f"s{i}" for i in range(sources)]]), None, 7) for k in range(docs)]
    return out + out[:5] + [(None, None, None, None, None, None), (1, "", "de", "only", None, 1), (2, "rare word", "xx", "a", None, 1), (3, None, "xx", "b", None, 1), (4, "long " * 200_000, "en", "s1", None, 1)]


@pytest.mark.parametrize("tiles", [{}, {"tile_groups": 3, "tile_terms": 4}, {"tile_groups": 1, "tile_terms": 1}])
def test_divergence_equals_the_sums(spark, tiles):
    made = rows(1)
    got = dv.divergence(spark.createDataFrame(made, DOCS).repartition(3), least_docs=3, **tiles)
    assert sorted(tuple(r) for r in got.collect()) == brute(made, 3)


def test_counts_flushed_on_the_way_add_up(spark):
    made = spark.createDataFrame([(k, f"a b{'c' * (k % 7)} a", "en", "s") for k in range(100)], "doc_id long, text string, lang string, source string")
    parts = dv.term_counts(made.select("lang", "source", "text").coalesce(1), held=2, most_bytes=10).groupBy("term").agg({"n": "sum", "docs": "sum"}).collect()
    assert {r.term: (r["sum(n)"], r["sum(docs)"]) for r in parts}["a"] == (200, 100)


def test_no_documents(spark):
    assert dv.divergence(spark.createDataFrame([], DOCS)).count() == 0


def test_trees_walked_together_price_every_cell():
    r = np.random.default_rng(2)
    for n, m, terms, most in ((5, 3, 17, 4), (1, 1, 1, 8), (8, 8, 64, 1000), (3, 9, 2, 8)):
        a, b = (np.where(r.random((k, terms)) < 0.2, r.integers(5, 10**9, (k, terms)), 0) for k in (n, m))
        za, zb = r.integers(1, 10**6, n), r.integers(1, 10**6, m)
        depth = max(int(x - 1).bit_length() for x in (n, m, terms))
        tree = lambda x: dv.QuadTree(*(v.astype(np.int64) for v in np.nonzero(x)), x[np.nonzero(x)], depth)
        full = lambda x, z: np.where(x > 0, x, z[:, None])
        want = dv.price(full(a, za)[:, None], full(b, zb)[None]).sum(-1)
        assert (dv.joint_prices(tree(a), tree(b), za, zb, terms, depth, False, most) == want).all()
        own = dv.price(full(a, za)[:, None], full(a, za)[None]).sum(-1)
        got = dv.joint_prices(tree(a), tree(a), za, za, terms, depth, True, most)
        i, j = np.triu_indices(n, 1)
        assert (got[i, j] == own[i, j]).all()


def test_shares_are_exact_for_large_counts(spark):
    n, total, v = 5 * 10**12, 10**16 + 1, 10**8 + 7
    got = spark.createDataFrame([(n, total, v)], "n long, t long, v long").select(dv.share("n", "t", "v").alias("p")).first().p
    assert got == 1 + 10**9 * (n + 2) // (total + 2 * v)
