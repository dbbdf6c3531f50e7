import zlib
from collections import defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from lodeframe.llm import sharding

SCHEMA = "doc_id long, text string, shard string, k string"


def plain_differencing(weights, n):
    parts = [[0] * (n - 1) + [w] for w in weights]
    while len(parts) > 1:
        parts.sort(key=lambda p: p[0] - p[-1])
        a, b = parts[0], parts[1]
        parts = parts[2:] + [sorted(x + y for x, y in zip(a, reversed(b)))]
    return parts[0] if parts else [0] * n


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 1000), max_size=30, unique=True), st.integers(2, 5))
def test_differencing(weights, n):
    where = sharding.partition(weights, n)
    sums = sorted(sum(w for w, s in zip(weights, where) if s == k) for k in range(n))
    assert sum(sums) == sum(weights)
    if weights:
        want = plain_differencing(weights, n)
        assert sums[-1] - sums[0] <= max(max(weights), want[-1] - want[0])


def test_balance_beats_greedy():
    rng = np.random.default_rng(1)
    w = (rng.lognormal(7, 1, 3000)).astype(int) + 1
    sums = np.bincount(sharding.partition(w.tolist(), 40), w, 40)
    assert sums.max() - sums.min() <= 3


def rows_of(spark, docs, **how):
    return sharding.shard(spark.createDataFrame(docs, SCHEMA).repartition(3), **how).collect()


def test_law(spark, sf, monkeypatch):
    monkeypatch.setattr(sharding, "GROUPS_IN_BUCKET", 48)
    monkeypatch.setattr(sharding, "HEAVY", 2)
    monkeypatch.setattr(sharding, "ROWS_IN_CELL", 32)
    docs = [(r.doc_id, r.text, None, None) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    docs += [(800 + i, "same text again", "x", "y") for i in range(70)] + [(None, None, None, None), (900, "", None, None), (900, "", None, None), (901, "long " * 9000, None, None)]
    got = rows_of(spark, docs, shards=5)
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in got) == sorted((str(d), len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t, _, _ in docs)
    slots, where, sums = defaultdict(list), defaultdict(set), defaultdict(int)
    for r in got:
        slots[r.shard].append(r.slot)
        where[r.text_crc32].add(r.shard)
        sums[r.shard] += r.size
        assert r.law == "bytes" and r.grown_shard is None
    assert all(sorted(x) == list(range(len(x))) for x in slots.values()) and all(len(x) == 1 for x in where.values())
    assert max(sums.values()) < 1.02 * sum(sums.values()) / 5


def test_empty(spark):
    assert rows_of(spark, []) == []
