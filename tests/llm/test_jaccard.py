import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodeframe.llm import jaccard

SCHEMA = "doc_id long, text string, n string, fp string, root long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingle_set(text, width=5):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(words) < width:
        return {tuple(words)} if words else set()
    return {tuple(words[k : k + width]) for k in range(len(words) - width + 1)}


def brute(rows, least=75):
    sets = [shingle_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(k):
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    index = {}
    for k, s in enumerate(sets):
        shared = {}
        for x in s:
            for j in index.get(x, ()):
                shared[j] = shared.get(j, 0) + 1
            index.setdefault(x, []).append(k)
        for j, n in shared.items():
            if 100 * n >= least * (len(s) + len(sets[j]) - n):
                parent[find(k)] = find(j)
    names = {}
    for k, (d, _) in enumerate(rows):
        if d is not None:
            names[find(k)] = min(names.get(find(k), d), d)
    return [(d, len(s), names.get(find(k)) if s else d) for k, ((d, _), s) in enumerate(zip(rows, sets))]


def copies(seed, docs=60, edits=0.06):
    rng = np.random.default_rng(seed)
    vocabulary = [f"w{k}" for k in range(3000)]
    passage = [str(w) for w in rng.choice(vocabulary, 60)]
    out = []
    for k in range(docs):
        words = [str(w) for w in rng.choice(vocabulary, int(rng.integers(1, 150)))]
        if k % 3 == 0:
            words = words[: len(words) // 2] + passage + words[len(words) // 2 :]
        for _ in range(int(rng.integers(1, 6))):
            changed = [w if rng.random() > edits * rng.random() else "edit" + str(rng.integers(1e6)) for w in words]
            if rng.random() < 0.3:
                changed = changed[: int(len(changed) * rng.uniform(0.7, 1))]
            out.append(" ".join(changed))
    return [(int(i), t) for i, t in zip(rng.permutation(len(out)) + 10, out)]


EDGES = [(None, "one two three four five six seven"), (1, "One two THREE four five\tsix seven"), (2, ""), (3, None), (4, " \n "), (5, "a b"), (6, "A  b"), (6, "A  b"), (7, "b a"), (8, "é è"), (9, "É è"), (5000, "long " * 30000 + "tail words come here at last"), (5001, "long " * 29000 + "tail words come here at last")]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="aAbé \n\x0b\x1c.", max_size=40), max_size=4))
def test_sets(texts):
    got = jaccard.shingles([t.encode() for t in texts])
    assert [len(s) for s in got] == [len(shingle_set(t)) for t in texts]
    for s, t in zip(got, texts):
        for r, u in zip(got, texts):
            assert len(np.intersect1d(s, r)) == len(shingle_set(t) & shingle_set(u))


@pytest.mark.parametrize("dims", [4, 16])
def test_tree_bounds(dims):
    rng = np.random.default_rng(1)
    sets = sorted((np.unique(rng.integers(0, 400, int(n)).astype(np.uint64)) for n in rng.integers(3, 90, 300)), key=len)
    sizes, points = np.array([len(s) for s in sets]), np.stack([jaccard.counted(s, dims) for s in sets])
    tree = jaccard.CountTree(points, sizes)
    for k in range(0, 300, 7):
        found = set(tree.search(points[k], int(sizes[k]), 30).tolist())
        for j, s in enumerate(sets):
            shared = len(np.intersect1d(s, sets[k]))
            if 100 * shared >= 30 * (len(s) + sizes[k] - shared):
                assert j in found
    assert len(tree.levels) == 3


@pytest.mark.parametrize(("seed", "tile", "tile_sets", "counters"), [(1, 1 << 21, 256, 1 << 14), (2, 400, 3, 1 << 14), (3, 150, 256, 256)])
def test_against_brute_force(spark, seed, tile, tile_sets, counters):
    rows = copies(seed) + EDGES
    df = spark.createDataFrame([(d, t, None, "x", 5) for d, t in rows], SCHEMA).repartition(3)
    got = jaccard.jaccard_components(df, tile=tile, tile_sets=tile_sets, counters=counters).collect()
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, brute(rows)))


def test_one_stays(spark):
    rows = copies(4, docs=20) + EDGES
    df = spark.createDataFrame([(d, t, None, "x", 5) for d, t in rows], SCHEMA)
    kept = jaccard.one_of_each(df)
    assert kept.columns == df.columns
    want = sorted({(str(d), str(t)) for (d, t), (_, n, c) in zip(rows, brute(rows)) if d is not None and (d == c or not n)})
    assert sorted((str(r.doc_id), str(r.text)) for r in kept.collect()) == want
    assert jaccard.jaccard_components(df.limit(0)).count() == 0 and jaccard.one_of_each(df.limit(0)).count() == 0


def test_tables(spark):
    documents = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()]
    assert sorted(tuple(r) for r in jaccard.jaccard_components(documents).collect()) == sorted(brute(rows))


def test_long_sets_beside_short_ones():
    rng = np.random.default_rng(5)
    long = np.unique(rng.integers(0, 1 << 63, 1_300_000).astype(np.uint64))
    also = np.unique(np.append(long[10:], rng.integers(0, 1 << 63, 10).astype(np.uint64)))
    short = long[:10]
    dense = (np.arange(3_000, dtype=np.uint64) << np.uint64(40)) + np.uint64(5)  # all in one group: counts beyond a byte
    sets = [short, long, also, dense, dense[300:], dense[1800:]]
    found = jaccard.block_forest(sets, np.arange(6), None, 75)
    assert sorted(map(sorted, found)) == [[1, 2], [3, 4]]
    for least in (75, 30):
        u, v = jaccard.candidates([jaccard.point(s) for s in sets], np.array([len(s) for s in sets]), least)
        pairs = set(zip(u.tolist(), v.tolist()))
        for i, a in enumerate(sets):
            for j in range(i):
                both = jaccard.shared(a, sets[j])
                assert both == len(np.intersect1d(a, sets[j]))
                assert 100 * both < least * (len(a) + len(sets[j]) - both) or (j, i) in pairs


def test_words_that_collide_modulo_a_power_of_two():
    bits = "".join("ab"[bin(k).count("1") % 2] for k in range(1024))
    other = bits.translate(str.maketrans("ab", "ba"))
    one, two = jaccard.shingles([f"w x y z {w}".encode() for w in (bits, other)])
    assert not len(np.intersect1d(one, two))


def test_more_columns_and_rows_that_are_joined(spark, monkeypatch):
    rows = copies(5, docs=20) + EDGES
    names = ["doc_id", "text", "d", "h_", "H", "leader", "text_hash", "component_id"]
    df = spark.createDataFrame([(d, t, "p", "q", None, 1, 2, 3) for d, t in rows], "doc_id long, text string, d string, h_ string, H string, leader int, text_hash int, component_id int")
    want = sorted({(str(d), str(t)) for (d, t), (_, n, c) in zip(rows, brute(rows)) if d is not None and (d == c or not n)})
    for most in (1 << 24, 0):  # 0: sets' documents are joined by key, and nothing is broadcast
        monkeypatch.setattr(jaccard, "MARKED", most)
        monkeypatch.setattr(jaccard, "BROADCAST", most)
        kept = jaccard.one_of_each(df)
        assert kept.columns == names
        assert sorted((str(r.doc_id), str(r.text)) for r in kept.collect()) == want
