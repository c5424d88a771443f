import numpy as np
import pytest

from proofset.llm import near_vectors as nv

SCHEMA = "vec_id long, embedding array<double>, label int, node long, part int, v string"


def brute(rows, limit=0.9):
    n = len(rows)
    fine = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v, *_ in rows]
    links, near = [0] * n, {k: {k} for k in range(n)}
    units = [np.ldexp(np.array(v), -int(np.frexp(np.abs(v).max())[1])) if ok else None for ok, (_, v, *_) in zip(fine, rows)]
    units = [u / np.linalg.norm(u) if u is not None else None for u in units]
    for i in range(n):
        for j in range(i):
            if fine[i] and fine[j] and len(units[i]) == len(units[j]) and units[i] @ units[j] >= limit:
                links[i] += 1
                links[j] += 1
                if near[i] is not near[j]:
                    both = near[i] | near[j]
                    for k in both:
                        near[k] = both
    out = []
    for k, (name, *_) in enumerate(rows):
        named = [rows[j][0] for j in near[k] if rows[j][0] is not None]
        least = min(named) if named else None
        out.append((name, links[k], least, name == least))
    return sorted(out, key=str)


def rows(seed=3, singles=150, d=16):
    r = np.random.default_rng(seed)
    out = list(r.normal(size=(singles, d)))
    for size, noise in ((60, 0.05), (25, 0.08), (2, 0.01), (2, 0.1), (3, 0.02)):
        c = r.normal(size=d)
        out += list(c / np.linalg.norm(c) + noise * r.normal(size=(size, d)))
    out += [out[0]] * 30 + [out[1] * 3.5] + [out[2] * 1e300, out[2] * 1e-300]
    made = [(int(k), [float(x) for x in v], 1, 7, 7, "x") for k, v in zip(r.permutation(len(out)), out)]
    odd = [None, [], [0.0] * d, [float("nan")] + [1.0] * (d - 1), [float("inf")] * d, [None] + [1.0] * (d - 1), [1.0, 2.0], [2.0, 4.0], [3.0, -1.0], [5.0]]
    made += [(1000 + k, v, None, None, None, None) for k, v in enumerate(odd)]
    return made + [made[5], made[5], (None, made[5][1], 0, 0, 0, ""), (None, None, 0, 0, 0, ""), (None, [9.0, -8.0, 3.0], 0, 0, 0, "")]


def got(spark, made, **kw):
    out = nv.near_vectors(spark.createDataFrame(made, SCHEMA).repartition(3), **kw).collect()
    return sorted((tuple(r) for r in out), key=str)


@pytest.mark.parametrize("sizes", [{}, {"cluster_rows": 60, "shard_rows": 40, "how": nv.Graph(degree=6, beam=8, batch=16, medoids=4)}])
def test_links_equal_brute_force(spark, sizes):
    made = rows()
    assert got(spark, made, target=1.0, **sizes) == brute(made)


def test_audits_widen_a_search_that_misses_links(spark):
    made = rows(seed=4, singles=40)
    poor = nv.Graph(degree=1, alpha=1.0, beam=1, expand=1, batch=4, medoids=1, least_in=0)
    assert got(spark, made, target=1.0, cluster_rows=10, overlap=1, audit_rows=1000, how=poor) == brute(made)


def test_no_vectors(spark):
    assert got(spark, []) == []
    assert got(spark, [(1, None, 0, 0, 0, ""), (2, [0.0], 0, 0, 0, "")]) == [(1, 0, 1, True), (2, 0, 2, True)]


def test_graph_search_finds_planted_copies_from_medoids():
    r = np.random.default_rng(0)
    v = r.normal(size=(3000, 32))
    v[1000:1400] = v[0] + 0.2 * r.normal(size=(400, 32))
    v[2000:2100] = v[100:200] + 0.1 * r.normal(size=(100, 32))
    v = (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)
    how = nv.Graph()
    adj = nv.build(v, how)
    units = np.concatenate((v, np.zeros((1, 32), np.float32)))
    q, c = nv.in_range(units, adj, nv.medoids(v, how.medoids), v, 0.9, how.beam, how.expand)
    found = np.zeros((3000, 3000), bool)
    found[q, c] = True
    assert len(set(zip(q.tolist(), c.tolist()))) == len(q)
    true = v @ v.T >= 0.9
    assert not (found & ~(v @ v.T >= 0.9 - 1e-5)).any()
    assert ((found | found.T) & true).sum() >= 0.99 * true.sum()
    assert true.sum() - 3000 > 50_000  # the planted group is there
