"""Jaccard self-join of documents' word shingles, with an R-tree over count vectors.

A document is the set of its distinct `width`-word shingles, as 64-bit hashes under a random key of the run;
documents with equal sets are one node from the start. The join runs in passes, none of which holds more than a
bounded block in a task:

1. Every set becomes a point: its elements are hashed into groups, about one for every four, and counted, a byte for
   each group. Every task also counts its shingles into a sketch of fixed size. Shingles are then ordered by how full
   their counter is, rarest first, and by hash: any common order is right, and this one keeps shared passages at the end.
2. A document deals the start of its ordered set to partitions: two sets that overlap enough share an element of
   those prefixes (for the smaller set a seventh of it, for the larger one a quarter, at 0.75). A partition finds
   the keys that several sets hold and names each such group by its smallest member, its leader. A key whose
   members all share the key before it, too, adds nothing and is left out.
3. Within a leader's block, an R-tree over the points bounds a set's overlap with all sets of a node by the sum of the
   smaller of its counts and the node's largest ones. Sets that the bound leaves together are a candidate group, named
   by its smallest member, so that equal candidates of many blocks fall into one. Only then the elements of these sets
   are fetched, and pairs that survive the bound are verified unless they are connected already; a group returns a
   spanning forest of links.
4. Components are formed from all forests. A block too large for a task is dealt into tiles, each with the leader;
   where its members don't all come out connected, the pairs of tiles are compared in a second round, again by points
   first and by elements for what is left.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeframe.llm.bytebpe import fresh_key, mixed, span_hashes
from lodeframe.llm.columns import column, raw_texts, released, rows, unused
from lodeframe.llm.graph import components, labelled
from lodeframe.llm.scratch import dropped, partitions, written

WIDTH = 5
LEAST = 75  # hundredths
COUNTERS = 1 << 20  # of the sketch
CHUNK = 1 << 14  # counters of a row that a task writes
TILE = 1 << 21  # shingles of a block that one task holds
TILE_SETS = 256  # sets of a block that one task holds
GROUP = 4  # elements of a set for each group of its point, at most
LEAST_DIMS = 16
LEAF = 16  # entries of an R-tree's node
CALL = 1 << 22  # bytes of small blocks that share a call, about
PART = 1 << 26  # bytes of prefix entries that a call holds, about
ENTRY = 24  # bytes of a prefix entry, at most
MARKED = 1 << 24  # sets that a bitmap tells from others; beyond that their documents are joined by key
BROADCAST = 1 << 18  # rows of two numbers that may be broadcast

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True


def shingles(texts: list[bytes], width: int = WIDTH, hash_key: int = 0) -> list[np.ndarray]:
    """Ascending distinct hashes of each text's shingles; of its words as one sequence, if there are fewer than width."""
    out, batch, size = [], [], 0
    for k, t in enumerate(texts):
        batch.append(t)
        size += len(t) + 1
        if size >= 1 << 18 or k == len(texts) - 1:
            out += _shingles(batch, width, hash_key)
            batch, size = [], 0
    return out


def _shingles(texts: list[bytes], width: int, hash_key: int) -> list[np.ndarray]:
    buf = _LOWER[np.frombuffer(b" ".join(texts) + b" ", np.uint8)]
    blank = _BLANK[buf]
    word = ~blank
    edge = np.flatnonzero(word[1:] != word[:-1]) + 1
    if len(word) and word[0]:
        edge = np.append(0, edge)
    start, end = edge[::2], edge[1::2]
    h = span_hashes(buf, start, end, hash_key)
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
    cuts = np.append(0, np.searchsorted(start, ends))
    with np.errstate(over="ignore"):
        rolled = np.zeros(max(0, len(h) - width + 1), np.uint64)
        for k in range(width):
            rolled += mixed(h[k : len(rolled) + k] + np.uint64(k * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        rolled = mixed(rolled)
        few = [mixed(sum((mixed(x + np.uint64((k + 101) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) for k, x in enumerate(h[a:b])), np.uint64(b - a))).reshape(1) if 0 < b - a < width else None for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
    out = []
    for k, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)):
        if b - a >= width:
            x = np.sort(rolled[a : b - width + 1])
            out.append(x[np.append(True, x[1:] != x[:-1])])
        else:
            out.append(np.zeros(0, np.uint64) if few[k] is None else few[k])
    return out


def fingerprint(s: np.ndarray) -> int:
    """A signed 64-bit fingerprint of a set."""
    with np.errstate(over="ignore"):
        return int((mixed(s).sum(dtype=np.uint64) + np.uint64(len(s) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)).astype(np.int64))


def overlap_needed(a, b, least: int):
    """Elements that sets of sizes a and b share at least, if they link."""
    return -((-least * (a + b)) // (100 + least))


# -- pass 1: sizes, fingerprints and the sketch --------------------------------------------------------------------


def _first_pass(docs: DataFrame, key: str, text: str, width: int, counters: int, hash_key: int) -> DataFrame:
    """Rows of kind 0: doc_id, text_hash, n, set; x: its point, in a task's first row of the set, if n > 2; rows of
    kind 1: chunk number as n and its counters as x."""

    def read(batches):
        counts, seen = np.zeros(counters, np.int64), set()
        for batch in (whole.slice(a, 512) for whole in batches for a in range(0, whole.num_rows, 512)):
            sets = shingles(raw_texts(column(batch, "t")), width, hash_key)
            prints, points, fresh = [fingerprint(s) for s in sets], [None] * len(sets), []
            for k, (s, p) in enumerate(zip(sets, prints, strict=True)):
                if p not in seen:
                    seen.add(p)
                    fresh.append(s)
                    if len(s) > 2:
                        points[k] = point(s)
            if fresh:
                counts += np.bincount((np.concatenate(fresh) >> np.uint64(20)).astype(np.int64) & (counters - 1), minlength=counters)
            n = len(sets)
            yield rows(kind=pa.array(np.zeros(n, np.int32)), doc_id=column(batch, "d").cast(pa.int64()), text_hash=column(batch, "h").cast(pa.int64()), n=pa.array([len(s) for s in sets], pa.int64()), fp=pa.array(prints, pa.int64()), x=pa.array(points, pa.binary()))
        chunks = counts.reshape(-1, CHUNK) if counters >= CHUNK else counts[None]
        some = np.flatnonzero(chunks.any(1))
        none = pa.nulls(len(some), pa.int64())
        yield rows(kind=pa.array(np.ones(len(some), np.int32)), doc_id=none, text_hash=none, n=pa.array(some, pa.int64()), fp=none, x=pa.array([np.minimum(chunks[k], 65535).astype(np.uint16).tobytes() for k in some], pa.binary()))
        released()

    picked = docs.select(F.col(key).cast("long").alias("d"), F.xxhash64(F.col(text)).alias("h"), F.col(text).alias("t"))
    return picked.mapInArrow(read, "kind int, doc_id long, text_hash long, n long, fp long, x binary")


def _levels(first: DataFrame, counters: int) -> bytes:
    """One byte for each counter: 0 for ordinary ones, and higher the fuller it is; the size is fixed."""

    def added(pdf: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(b, np.uint16).astype(np.int64) for b in pdf["x"])
        return pd.DataFrame({"n": [pdf["n"].iloc[0]], "total": [np.asarray(total, np.int64).tobytes()]})

    found = first.filter("kind = 1").select("n", "x").groupBy("n").applyInPandas(added, "n long, total binary").toArrow()
    width = min(CHUNK, counters)
    load = np.zeros(counters, np.int64)
    for n, raw in zip(found.column("n").to_pylist(), found.column("total").to_pylist(), strict=True):
        load[n * width : (n + 1) * width] = np.frombuffer(raw, np.int64)
    usual = max(1.0, float(np.median(load)) + 6 * math.sqrt(max(1.0, float(np.median(load)))))
    return np.clip(np.ceil(4 * np.log2(np.maximum(load, 1) / usual)), 0, 255).astype(np.uint8).tobytes()


# -- pass 2: prefixes and groups --------------------------------------------------------------------------------------


def _prefixes(docs: DataFrame, key: str, text: str, width: int, least: int, counters: int, levels, parts: int, hash_key: int) -> DataFrame:
    """part and a blob of the prefix entries that a batch has for it."""

    def dealt(batches):
        level, seen = np.frombuffer(levels.value, np.uint8), set()
        for batch in batches:
            texts = raw_texts(column(batch, "t"))
            for a in range(0, len(texts), 512):
                keys, before, ranks, of, prints, sizes = [], [], [], [], [], []
                for s in shingles(texts[a : a + 512], width, hash_key):
                    n, p = len(s), fingerprint(s)
                    if n < 3 or p in seen:  # sets of one or two elements link with equal sets only
                        continue
                    seen.add(p)
                    order = np.argsort(level[(s >> np.uint64(20)).astype(np.int64) & (counters - 1)], kind="stable")
                    long = n - -(-n * least // 100) + 1
                    head = s[order[:long]]
                    keys.append(head)
                    before.append(np.append(np.uint64(0), head[:-1]))
                    # an element's rank decides with which sizes it must be shared; small ranks belong to the index prefix
                    ranks.append(np.arange(long) < n - int(overlap_needed(n, n, least)) + 1)
                    of.append(np.full(long, len(prints), np.uint32))
                    prints.append(p)
                    sizes.append(n)
                if not prints:
                    continue
                keys, before, ranks, of = map(np.concatenate, (keys, before, ranks, of))
                part = (keys % np.uint64(parts)).astype(np.int64)
                order = np.argsort(part, kind="stable")
                cuts = np.searchsorted(part[order], np.arange(parts + 1))
                prints, sizes = np.array(prints, np.int64), np.array(sizes, np.uint32)
                some = np.flatnonzero(np.diff(cuts))
                blobs = []
                for p in some.tolist():
                    at = order[cuts[p] : cuts[p + 1]]
                    docs_, local = np.unique(of[at], return_inverse=True)
                    k = (keys[at] // np.uint64(parts)).astype(np.uint32)
                    blobs.append(b"".join((np.array([len(docs_), len(at)], np.int64).tobytes(), prints[docs_].tobytes(), sizes[docs_].tobytes(), k.tobytes(), (before[at] >> np.uint64(13)).astype(np.uint32).tobytes(), local.astype(np.uint16).tobytes(), ranks[at].astype(np.uint8).tobytes())))
                yield rows(part=pa.array(some, pa.int32()), blob=pa.array(blobs, pa.binary()))
        released()

    return docs.select(F.col(text).alias("t")).mapInArrow(dealt, "part int, blob binary")


def _entries(blobs: list[bytes]):
    """(key, key before, is in the index prefix, set number) of the entries; fingerprints and sizes of the sets."""
    parts, prints, sizes, at = [], [], [], 0
    for b in blobs:
        d, n = np.frombuffer(b, np.int64, 2).tolist()
        o = 16
        prints.append(np.frombuffer(b, np.int64, d, o))
        sizes.append(np.frombuffer(b, np.uint32, d, o + 8 * d).astype(np.int64))
        o += 12 * d
        key, prev = np.frombuffer(b, np.uint32, n, o), np.frombuffer(b, np.uint32, n, o + 4 * n)
        local, index = np.frombuffer(b, np.uint16, n, o + 8 * n), np.frombuffer(b, np.uint8, n, o + 10 * n)
        parts.append((key, prev, index, local.astype(np.int64) + at))
        at += d
    return *map(np.concatenate, zip(*parts, strict=True)), np.concatenate(prints), np.concatenate(sizes)


def grouped(blobs: list[bytes], least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(leader, member, member's size): the groups of one partition, without repetitions."""
    none = np.zeros(0, np.int64)
    if not blobs:
        return none, none, none
    key, prev, index, of, prints, sizes = _entries(blobs)
    fp = prints[of]
    order = np.lexsort((fp, key))
    key, prev, index, fp, n = key[order], prev[order], index[order], fp[order], sizes[of][order]
    # a set that several tasks have dealt counts once
    once = np.append(True, (key[1:] != key[:-1]) | (fp[1:] != fp[:-1]))
    key, prev, index, fp, n = key[once], prev[once], index[once], fp[once], n[once]
    head = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    count = np.diff(np.append(head, len(key)))
    smallest, largest = np.minimum.reduceat(prev, head), np.maximum.reduceat(prev, head)
    used = (count > 1) & np.maximum.reduceat(index, head).astype(bool) & ((smallest != largest) | (smallest == 0))
    of_group = np.repeat(np.arange(len(head)), count)
    member = used[of_group]
    group, fp, n, index = of_group[member], fp[member], n[member], index[member]
    if not len(group):
        return none, none, none
    # within a group, ascending by size: a member stays if a neighbour's size is within reach of its own
    order = np.lexsort((n, group))
    group, fp, n, index = group[order], fp[order], n[order], index[order]
    near = (group[1:] == group[:-1]) & (100 * n[:-1] >= least * n[1:])
    stays = np.append(near, False) | np.append(False, near)
    group, fp, n = group[stays], fp[stays], n[stays]
    # runs of members whose sizes reach each other are separate groups
    run = np.cumsum(np.append(True, ~near)) if len(near) else np.ones(1, np.int64)
    group = run[stays]
    if not len(group):
        return none, none, none
    order = np.lexsort((fp, group))
    group, fp, n = group[order], fp[order], n[order]
    head = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    leader = np.repeat(fp[head], np.diff(np.append(head, len(group))))
    pairs = np.unique(np.stack([leader, fp, n], 1), axis=0)
    return pairs[:, 0], pairs[:, 1], pairs[:, 2]


def _groups(prefixes: DataFrame, least: int, parts: int) -> DataFrame:
    def found(pdf: pd.DataFrame) -> pd.DataFrame:
        leader, fp, n = grouped(list(pdf["blob"]), least)
        return pd.DataFrame({"leader": leader, "fp": fp, "n": n})

    return prefixes.groupBy("part").applyInPandas(found, "leader long, fp long, n long").distinct()


# -- pass 3: blocks ----------------------------------------------------------------------------------------------------


def dims_of(size: int) -> int:
    """Groups of a set's point: a power of two, one for at most GROUP elements."""
    return max(LEAST_DIMS, 1 << max(0, (-(-size // GROUP) - 1).bit_length()))


def counted(s: np.ndarray, dims: int) -> np.ndarray:
    return np.bincount((s & np.uint64(dims - 1)).astype(np.int64), minlength=dims)


def point(s: np.ndarray) -> bytes:
    """A set's counts, a byte each, and lastly, in four bytes, what counts over 255 have beyond that."""
    counts = counted(s, dims_of(len(s)))
    return np.minimum(counts, 255).astype(np.uint8).tobytes() + np.array([np.maximum(counts - 255, 0).sum()], np.uint32).tobytes()


class CountTree:
    """R-tree over count vectors, packed level by level; a node keeps its members' largest counts and sizes' range."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray, slack: int = 0):
        """slack: how much more than the counts tell two sets may share."""
        self.levels, self.slack = [(points, sizes, sizes)], slack
        while len(self.levels[-1][0]) > LEAF:
            top, low, high = self.levels[-1]
            at = np.arange(0, len(top), LEAF)
            self.levels.append((np.maximum.reduceat(top, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at)))

    def search(self, point: np.ndarray, size: int, least: int) -> np.ndarray:
        """Members whose overlap with a set, as bounded, is enough for a link."""
        at = np.arange(len(self.levels[-1][0]))
        for depth in range(len(self.levels) - 1, -1, -1):
            top, low, high = self.levels[depth]
            at = at[(100 * high[at] >= least * size) & (100 * size >= least * low[at])]
            if len(at):
                bound = np.minimum(top[at], point).sum(1, dtype=np.int64) + self.slack
                at = at[bound >= overlap_needed(np.maximum(low[at], -(-least * size // 100)), size, least)]
            if depth:
                at = (at[:, None] * LEAF + np.arange(LEAF)).ravel()
                at = at[at < len(self.levels[depth - 1][0])]
        return at


def candidates(points: list[bytes], sizes: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(u, v), u < v: all pairs that may link, as far as their points tell.

    Sets that link differ by a factor of 100 / least at most, so that a point meets points of its own dimensions and
    of so many more, folded; no point is folded further, whatever else the block holds.
    """
    if len(points) == 2:  # most blocks
        return _pairs_of_two(points, sizes, least)
    dims = np.fromiter(map(len, points), np.int64, len(points)) - 4
    us, vs, reach = [], [], 1 << (-(-100 // least) - 1).bit_length()
    for d in np.unique(dims).tolist():
        at = np.flatnonzero((dims >= d) & (dims <= reach * d))
        at = at[np.argsort(sizes[at], kind="stable")]
        if len(at) < 2:
            continue
        flat = np.stack([np.frombuffer(points[k], np.uint8, dims[k]).reshape(-1, d).sum(0, dtype=np.uint16) for k in at.tolist()])
        slack = sum(sorted(int(np.frombuffer(points[k], np.uint32, 1, dims[k])[0]) for k in at.tolist())[-2:])
        tree, own = CountTree(flat, sizes[at], slack), dims[at] == d
        for k in range(len(at)):
            near = tree.search(flat[k], int(sizes[at[k]]), least)
            near = near[(near > k) & (own[near] | own[k])]
            if len(near):
                us.append(np.full(len(near), at[k]))
                vs.append(at[near])
    if not us:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    u, v = np.concatenate(us), np.concatenate(vs)
    return np.minimum(u, v), np.maximum(u, v)


def _pairs_of_two(points: list[bytes], sizes: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    a, b = (np.frombuffer(p, np.uint8, len(p) - 4) for p in points)
    if len(a) != len(b):
        d = min(len(a), len(b))
        a, b = (x.reshape(-1, d).sum(0, dtype=np.uint16) for x in (a, b))
    slack = sum(int(np.frombuffer(p, np.uint32, 1, len(p) - 4)[0]) for p in points)
    n, m = sizes.tolist()
    some = 100 * min(n, m) >= least * max(n, m) and int(np.minimum(a, b).sum(dtype=np.int64)) + slack >= overlap_needed(n, m, least)
    return np.zeros(int(some), np.int64), np.ones(int(some), np.int64)


def shared(a: np.ndarray, b: np.ndarray) -> int:
    """Elements that two ascending sets share."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())


def block_forest(sets: list[np.ndarray], component: np.ndarray, cross: np.ndarray | None, least: int) -> list[tuple[int, int]]:
    """Links that connect the sets of a block that do link, a spanning forest beyond the given components.

    cross: if given, only pairs of different values count.
    """
    sizes, component, out = np.array([len(s) for s in sets], np.int64), component.copy(), []
    u, v = candidates([point(s) for s in sets], sizes, least)
    if cross is not None:
        apart = cross[u] != cross[v]
        u, v = u[apart], v[apart]
    order = np.lexsort((v, u))
    u, v = u[order], v[order]
    for k in np.unique(u).tolist():
        near = v[np.searchsorted(u, k) : np.searchsorted(u, k, "right")]
        near = near[component[near] != component[k]]
        while len(near):
            j = int(near[0])
            both = shared(sets[k], sets[j])
            if 100 * both >= least * (sizes[k] + sizes[j] - both):
                out.append((k, j))
                component[component == component[j]] = component[k]
            near = near[1:]
            near = near[component[near] != component[k]]
    return out


def _fetched(docs: DataFrame, key: str, text: str, width: int, hash_key: int, wanted: DataFrame) -> DataFrame:
    """fp, x (the set's hashes) of the sets (fp, least_id) in `wanted`; perhaps of more sets, or several times.

    A set is read from the row with its smallest key. A bitmap tells the rows that may be meant, unless there are so
    many that it could not: then their rows are found by a join on the key.
    """
    number = wanted.count()
    bits = max(16, min(28, (16 * number).bit_length()))
    picked = docs.select(F.col(key).cast("long").alias("d"), F.col(text).alias("t"))
    if number > MARKED:
        some = wanted.select(F.coalesce("least_id", F.lit(-1)).alias("least_id")).distinct()
        picked = picked.join(some, F.coalesce("d", F.lit(-1)) == F.col("least_id"), "left_semi")
    bitmap = docs.sparkSession.sparkContext.broadcast(_marks(wanted, bits) if number <= MARKED else b"")

    def fetched(batches):
        bitmap_, seen = np.frombuffer(bitmap.value, np.uint8), set()
        for batch in batches:
            ids = pc.fill_null(column(batch, "d").cast(pa.int64()), -1).to_numpy(zero_copy_only=False)
            texts = raw_texts(column(batch, "t"))
            for a in range(0, len(texts), 512):
                sets = shingles(texts[a : a + 512], width, hash_key)
                prints = np.array([fingerprint(s) for s in sets], np.int64)
                at = _bit_of(prints, ids[a : a + 512], bits)
                found = []
                for k in np.flatnonzero(bitmap_[at >> 3] >> (at & 7) & 1).tolist() if len(bitmap_) else range(len(sets)):
                    if len(sets[k]) > 2 and prints[k] not in seen:
                        seen.add(prints[k])
                        found.append(k)
                if found:
                    yield rows(fp=pa.array(prints[found]), x=pa.array([sets[k].tobytes() for k in found], pa.binary()))
        released()

    return picked.mapInArrow(fetched, "fp long, x binary")


def _bit_of(prints: np.ndarray, ids: np.ndarray, bits: int) -> np.ndarray:
    return (mixed(mixed(prints.view(np.uint64)) ^ ids.astype(np.int64).view(np.uint64)) >> np.uint64(64 - bits)).astype(np.int64)


def _marks(wanted: DataFrame, bits: int) -> bytes:
    """A bitmap of 32 MB at most with a bit for every (fp, least_id) of `wanted`: tasks mark theirs, and the marks are merged."""

    def marked(batches):
        out = np.zeros(1 << bits, bool)
        for batch in batches:
            ids = pc.fill_null(column(batch, "least_id"), -1).to_numpy(zero_copy_only=False)
            out[_bit_of(column(batch, "fp").to_numpy(), ids, bits)] = True
        packed = np.packbits(out, bitorder="little").reshape(-1, 1 << 10)
        some = np.flatnonzero(packed.any(1))
        yield rows(k=pa.array(some, pa.int32()), b=pa.array([packed[i].tobytes() for i in some], pa.binary()))

    def merged(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"k": [pdf["k"].iloc[0]], "b": [np.bitwise_or.reduce([np.frombuffer(b, np.uint8) for b in pdf["b"]]).tobytes()]})

    found = wanted.select("fp", "least_id").mapInArrow(marked, "k int, b binary").groupBy("k").applyInPandas(merged, "k int, b binary").toArrow()
    out = np.zeros((1 << bits) >> 3, np.uint8).reshape(-1, 1 << 10)
    for k, b in zip(found.column("k").to_pylist(), found.column("b").to_pylist(), strict=True):
        out[k] = np.frombuffer(b, np.uint8)
    return out.tobytes()


# -- the join ----------------------------------------------------------------------------------------------------------


def _cut(table: pa.Table, names: tuple[str, ...]):
    """(values of `names`, fp, the rows' numbers) of each block in a call, ascending by fp and without repetitions."""
    keys = [table.column(c).to_numpy() for c in (*names, "fp")]
    order = np.lexsort(keys[::-1])
    same = np.ones(max(0, len(order) - 1), bool)
    for k in keys[:-1]:
        same &= k[order[1:]] == k[order[:-1]]
    again = np.append(False, same & (keys[-1][order[1:]] == keys[-1][order[:-1]])) if len(order) else np.zeros(0, bool)
    block = np.cumsum(np.append(True, ~same)) if len(order) else np.zeros(0, np.int64)
    order, block = order[~again], block[~again]
    for at in np.split(order, np.flatnonzero(np.diff(block)) + 1):
        if len(at):
            yield tuple(k[at[0]] for k in keys[:-1]), keys[-1][at], at


def _in_calls(blocks: DataFrame, names: tuple[str, ...], size: str, tasks: int, other: DataFrame):
    """blocks with a column x of `other`, grouped so that many small ones share a call; size: bytes of a row, in SQL."""
    total = blocks.agg(F.sum(F.expr(size))).first()[0] or 0
    call = F.pmod(F.xxhash64(*names), F.lit(max(tasks, -(-int(total) // CALL))))
    return blocks.join(other, "fp").withColumn("call", call).groupBy("call")


def _tiled(groups: DataFrame, tile: int, tile_sets: int) -> DataFrame:
    """groups with tiles, the number of tasks that a leader's block is dealt to."""
    sizes = groups.groupBy("leader").agg(F.sum("n").alias("weight"), F.count("*").alias("members"))
    sizes = sizes.select("leader", F.greatest(F.ceil(F.col("weight") / tile), F.ceil(F.col("members") / tile_sets)).cast("int").alias("tiles"))
    # written, so that a large leader's rows can be split in the join
    return groups.join(written(sizes.filter("tiles > 1"), "wide"), "leader", "left").withColumn("tiles", F.coalesce("tiles", F.lit(1)))


def _own_tile():
    return F.pmod(F.xxhash64("fp", "leader"), F.col("tiles")).cast("int")


def _dealt(tiled: DataFrame) -> DataFrame:
    """A row for each member's tile, low and high; the leader is in every one."""
    spread = F.when(F.col("fp") == F.col("leader"), F.sequence(F.lit(0), F.col("tiles") - 1)).otherwise(F.array(_own_tile()))
    return tiled.withColumn("low", F.explode(spread)).withColumn("high", F.col("low"))


def _live(dealt: DataFrame, points: DataFrame, least: int, tasks: int) -> DataFrame:
    """leader, fp, n: the groups of sets that the bound leaves together in a tile, each named by its smallest member."""

    def grouped_(table: pa.Table) -> pa.Table:
        n, x, out = table.column("n").to_numpy(), table.column("x").to_pylist(), []
        for _, fp, at in _cut(table, ("leader", "low")):
            u, v = candidates([x[k] for k in at.tolist()], n[at], least)
            if len(u):
                label = labelled(len(at), u, v)
                some = np.flatnonzero(np.bincount(label, minlength=len(at))[label] > 1)
                out.append((fp[label[some]], fp[some], n[at[some]]))
        leader, fp, n = map(np.concatenate, zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3
        return pa.table({"leader": leader, "fp": fp, "n": n})

    placed = dealt.select("leader", "low", "fp", "n")
    return _in_calls(placed, ("leader", "low"), f"n / {GROUP} + 40", tasks, points).applyInArrow(grouped_, "leader long, fp long, n long").distinct()


def _across(pairs: DataFrame, points: DataFrame, least: int, tasks: int) -> DataFrame:
    """The rows of pairs of tiles whose sets may link, by the bound, with a set of the other tile and another component."""
    names = ("leader", "low", "high")
    fields = [*names, "fp", "n", "component", "side"]

    def left(table: pa.Table) -> pa.Table:
        n, x, side, component, out = table.column("n").to_numpy(), table.column("x").to_pylist(), table.column("side").to_numpy(), table.column("component").to_numpy(), [np.zeros(0, np.int64)]
        for _, _, at in _cut(table, names):
            u, v = candidates([x[k] for k in at.tolist()], n[at], least)
            u, v = at[u], at[v]
            meets = (side[u] != side[v]) & (component[u] != component[v])
            out.append(np.unique(np.append(u[meets], v[meets])))
        return table.select(fields).take(pa.array(np.concatenate(out)))

    placed = pairs.select(*fields)
    return _in_calls(placed, names, f"n / {GROUP} + 60", tasks, points).applyInArrow(left, placed.schema)


def _forests(blocks: DataFrame, sets: DataFrame, least: int, tasks: int) -> DataFrame:
    """a, b: links of every block (leader, low, high) of rows with fp, n, component, side."""
    names = ("leader", "low", "high")

    def linked(table: pa.Table) -> pa.Table:
        x, side, component, out = table.column("x").to_pylist(), table.column("side").to_numpy(), table.column("component").to_numpy(), []
        for (_, low, high), fp, at in _cut(table, names):
            found = block_forest([np.frombuffer(x[k], np.uint64) for k in at.tolist()], component[at], None if low == high else side[at], least)
            out += [(fp[i], fp[j]) for i, j in found]
        released()
        return pa.table({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})

    placed = blocks.select(*names, "fp", "n", "component", "side")
    return _in_calls(placed, names, "8 * n + 60", tasks, sets).applyInArrow(linked, "a long, b long")


def _linked_sets(spark: SparkSession, docs: DataFrame, key: str, text: str, width: int, least: int, counters: int, tile: int, tile_sets: int, hash_key: int, first: DataFrame) -> DataFrame:
    """node, root of the sets that have links."""
    levels = spark.sparkContext.broadcast(_levels(first, counters))
    tasks = partitions(spark)
    longest = 100 - least + 1  # hundredths of a set that its prefix holds, about
    parts = max(tasks, -(-int(first.filter("kind = 0").agg(F.sum("n")).first()[0] or 0) * longest * ENTRY // (100 * PART)))
    groups = written(_groups(_prefixes(docs, key, text, width, least, counters, levels, parts, hash_key), least, parts), "groups")
    owners = first.filter("kind = 0 and n > 2").groupBy("fp").agg(F.min("doc_id").alias("least_id"))
    members = groups.select("fp").distinct()
    points = written(first.filter("kind = 0 and x is not null").select("fp", "x").join(members, "fp", "left_semi").dropDuplicates(["fp"]), "points")
    tiled = written(_tiled(groups, tile, tile_sets), "tiled")
    live = written(_live(_dealt(tiled), points, least, tasks), "live")
    placed = written(_tiled(live, tile, tile_sets), "placed")

    def elements(some: DataFrame) -> DataFrame:
        wanted = written(some.select("fp").distinct().join(owners, "fp"), "wanted")
        return written(_fetched(docs, key, text, width, hash_key, wanted), "sets")

    alone = _dealt(placed).withColumn("component", F.col("fp")).withColumn("side", F.lit(0))
    links = written(_forests(alone, elements(live), least, tasks), "links")
    roots = components(links)
    # blocks of several tiles whose members are not all connected: the pairs of tiles
    wide = tiled.filter("tiles > 1").withColumn("kind", F.lit(0)).unionByName(placed.filter("tiles > 1").withColumn("kind", F.lit(1)))
    known = wide.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("root", "fp")).drop("root")
    known = written(known.withColumn("side", _own_tile()), "known")
    split = known.groupBy("leader", "kind").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x <> y").select("leader", "kind")
    again = known.join(written(split, "split"), ["leader", "kind"])
    pairs = again.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).filter("side <> other")
    # a block's name holds its kind, as both kinds may have the same leader
    pairs = pairs.withColumn("low", 2 * F.least("side", "other") + F.col("kind")).withColumn("high", 2 * F.greatest("side", "other") + F.col("kind"))
    left = written(_across(pairs, points, least, tasks), "left")
    if not left.isEmpty():
        more = written(_forests(left, elements(left), least, tasks), "links")
        roots = components(links.unionByName(more))
        dropped(more)
    for table in (groups, points, tiled, live, placed, known, left, links):
        dropped(table)
    return roots


JOINED = "doc_id long, n_shingles long, component_id long"


def _joined(docs: DataFrame, key: str, text: str, width: int, least: int, counters: int, tile: int, tile_sets: int) -> DataFrame:
    """doc_id, text_hash, n, fp, component_id."""
    spark, hash_key = docs.sparkSession, fresh_key()
    first = written(_first_pass(docs, key, text, width, counters, hash_key), "shingled")
    roots = _linked_sets(spark, docs, key, text, width, least, counters, tile, tile_sets, hash_key, first)
    plain = first.filter("kind = 0").select("doc_id", "text_hash", "n", "fp")
    sets = plain.filter("n > 0").groupBy("fp").agg(F.min("doc_id").alias("least_id"))
    placed = written(sets.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp")), "placed")
    names = written(placed.groupBy("root").agg(F.min("least_id").alias("component_id")), "names")  # written, so that a large component's rows can be split in the join
    named = written(placed.join(names, "root").select("fp", "component_id"), "named")
    whole = plain.join(named, "fp", "left")
    return whole.withColumn("component_id", F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")))


def jaccard_components(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, least: int = LEAST, counters: int = COUNTERS, tile: int = TILE, tile_sets: int = TILE_SETS) -> DataFrame:
    """One row per row of docs: JOINED. Documents link when their shingle sets' Jaccard similarity is least / 100 or more.

    A null or empty text, or one without words, has an empty set and links with nothing. Rows with a null key take
    part, and their component is named by the smallest key in it, null if there is none; repeated rows are in one
    component; an empty table gives an empty result; other columns are not looked at.
    """
    return _joined(docs, key, text, width, least, counters, tile, tile_sets).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, least: int = LEAST, counters: int = COUNTERS, tile: int = TILE, tile_sets: int = TILE_SETS) -> DataFrame:
    """The rows of docs, with all their columns, that stay when one document of each component does: the one with the
    smallest key. Of repeated rows (equal key and text) one stays. Rows without a key go if their component has one.

    Null and empty texts, and texts without words, link with nothing and stay; texts of any length are compared whole;
    an empty table gives an empty result; other columns may have any name and are passed on as they are.
    """
    found = _joined(docs, key, text, width, least, counters, tile, tile_sets)
    d, h = unused(docs, "d"), unused(docs, "h")
    pair = [F.col("doc_id").alias(d), F.col("text_hash").alias(h)]
    gone = written(found.filter("doc_id is null and component_id is not null or doc_id <> component_id").select(*pair).distinct(), "gone")
    again = found.filter("doc_id is not null and doc_id = component_id and n > 0").groupBy("doc_id", "text_hash").count().filter("count > 1")
    again = written(again.select(*pair), "again")
    same = F.col(key).cast("long").eqNullSafe(F.col(d)) & (F.xxhash64(F.col(text)) == F.col(h))
    small = lambda df: F.broadcast(df) if df.count() <= BROADCAST else df
    marked = docs.join(small(gone), same, "left_anti")
    if again.isEmpty():
        return marked
    again = small(again)
    return marked.join(again, same, "left_anti").unionByName(marked.join(again, same, "left_semi").dropDuplicates([key, text]))
