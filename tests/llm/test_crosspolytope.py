import numpy as np
import pytest

from lodeframe.llm import crosspolytope, graph

SCHEMA = "vec_id long, embedding array<float>, w string, c string, label int"


def brute(rows, least=0.9):
    ok = [(k, np.array(v, float)) for k, (_, v) in enumerate(rows) if v and None not in v and np.isfinite(v).all() and np.any(v)]
    n, parent = [0] * len(rows), list(range(len(rows)))

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i, (a, x) in enumerate(ok):
        for b, y in ok[:i]:
            if len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= least:
                n[a] += 1
                n[b] += 1
                parent[find(a)] = find(b)
    out = []
    for k, (d, _) in enumerate(rows):
        ids = [r[0] for j, r in enumerate(rows) if find(j) == find(k) and r[0] is not None]
        out.append((d, n[k], min(ids, default=None)))
    return out


def test_components(spark):
    rng = np.random.default_rng(1)
    for edges in ([], [(1, 1)], [(k, k + 1) for k in range(40)], [(0, k) for k in range(1, 200)], rng.integers(0, 60, (45, 2)).tolist()):
        got = {r.node: r.root for r in graph.components(spark.createDataFrame([tuple(e) for e in edges], "a long, b long")).collect()}
        parent = {x: x for e in edges for x in e}
        for _ in range(len(parent) + 1):
            for a, b in edges:
                parent[a] = parent[b] = min(parent[a], parent[b])
        assert got == {k: v for k, v in parent.items() if k != v}


def test_hadamard_is_a_rotation():
    x = np.random.default_rng(2).normal(size=(5, 16))
    assert np.allclose(crosspolytope.hadamard(x) @ crosspolytope.hadamard(x).T, x @ x.T)


def test_against_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(40, 64))
    rows = [(int(k), (base[k % 40] + 0.15 * rng.normal(size=64)).tolist()) for k in range(200)]
    rows += [(300 + k, rows[7][1]) for k in range(30)] + [(400, None), (401, [0.0] * 64), (402, [1.0, None]), (403, [float("nan")] * 64), (404, []), (405, [1.0, 2.0]), (406, [2.0, 4.0]), (None, rows[7][1]), (407, [float("inf"), 1.0]), (None, [5.0, -1.0])]
    rows.append(rows[7])
    monkeypatch.setattr(crosspolytope, "IN_BUCKET", 2)
    monkeypatch.setattr(crosspolytope, "TILE", 5)
    df = spark.createDataFrame([(k, v, None, "x", 1) for k, v in rows], SCHEMA)
    got = crosspolytope.near_duplicates(df, tables=24).collect()
    assert all(r.kept == (r.vec_id is not None and r.vec_id == r.component_id) for r in got)
    assert sorted(str((r.vec_id, r.n_links, r.component_id)) for r in got) == sorted(map(str, brute([(k, np.float32(v).tolist() if v and None not in v else v) for k, v in rows])))
    assert crosspolytope.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def planted(cosine, dim=64, pairs=1000):
    rng = np.random.default_rng(6)
    a, b = rng.normal(size=(2, pairs, dim))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= (a * b).sum(1, keepdims=True) * a
    return a, cosine * a + np.sqrt(1 - cosine**2) * b / np.linalg.norm(b, axis=1, keepdims=True)


@pytest.mark.parametrize("vectors", [10**3, 10**4, 10**5, 10**6, 10**7, 10**9, 10**11])
def test_recall_does_not_fall_with_size(vectors):
    shape = crosspolytope.shape_for(vectors, 64)
    assert vectors / 512 <= 128 ** (shape[0] - 1) * 2 * shape[1] or vectors < 1000
    tables = crosspolytope.tables_for(64, shape, crosspolytope.TABLES, crosspolytope.PROBES, 0.9)
    for cosine in (0.9, 0.92):
        a, b = planted(cosine)
        x, y = (crosspolytope.codes(v, tables, shape, crosspolytope.PROBES) for v in (a, b))
        assert np.any([crosspolytope._met(x[:, t], y[:, t]) for t in range(tables)], 0).mean() >= 0.99


@pytest.mark.parametrize(("in_bucket", "shape"), [(16, (1, 64)), (1, (2, 8)), (0.05, (3, 2))])
def test_recall_of_joined_codes(spark, monkeypatch, in_bucket, shape):
    a, b = planted(0.901)
    monkeypatch.setattr(crosspolytope, "IN_BUCKET", in_bucket)
    assert crosspolytope.shape_for(2000, 64) == shape
    df = spark.createDataFrame([(k, v) for k, v in enumerate([*a.tolist(), *b.tolist()])], "vec_id long, embedding array<double>")
    got = {r.vec_id: r.component_id for r in crosspolytope.near_duplicates(df).collect()}
    assert np.mean([got[k] == got[1000 + k] for k in range(1000)]) >= 0.995


def test_recall(spark):
    vectors = spark.read.parquet("/root/testdata/check_s/embeddings.parquet")
    got = {r.vec_id: r for r in crosspolytope.near_duplicates(vectors).collect()}
    x = {r.vec_id: np.array(r.embedding, float) for r in vectors.collect()}
    ids = sorted(x)
    m = np.array([x[k] / np.linalg.norm(x[k]) for k in ids])
    want = np.concatenate([((m[a : a + 1000] @ m.T) >= 0.9).sum(1) - 1 for a in range(0, len(m), 1000)])
    found = np.array([got[k].n_links for k in ids])
    assert want.sum() > 10_000 and (found <= want).all() and found.sum() >= 0.9 * want.sum()
