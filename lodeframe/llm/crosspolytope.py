"""Near duplicates among embeddings: cross-polytope hashing after fast Hadamard rotations, multiprobe, verified pairs.

A vector is rotated by three rounds of random signs and a Hadamard transform; its code is the axis, with sign, that it
then lies nearest to. A table joins as many codes as the number of vectors asks for, the last one over the first few
axes alone, so that buckets keep about the same size whatever that number is. There are as many tables as pairs of
the least cosine need to meet in one of them, by the share of simulated pairs that meet, so that recall does not fall
with the number of vectors. A vector lies in its own bucket of every table and probes the next best ones. Pairs that
meet are verified by their cosine in double precision, and counted in the first bucket where they meet. Equal vectors
are one class with a weight, and a bucket emits counts and a spanning forest, so that groups of copies cost no more
rows than they have members.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeframe.llm.columns import column, rows
from lodeframe.llm.graph import components, labelled
from lodeframe.llm.scratch import dropped, partitions, written

TABLES = 4  # at least
PROBES = 2
MISSED = 0.0005  # pairs of the least cosine that meet in no table, at most, by simulation; this sets the number of tables
IN_BUCKET = 256  # vectors whose own bucket one is, on average, at most
TILE = 4096  # members of a bucket that one task compares with as many others
ROWS = 1 << 14  # of blocks that one call of the comparison gets, about


@lru_cache(1024)
def _signs(size: int, count: int, table: int, seed: int = 11) -> np.ndarray:
    return np.random.default_rng([seed, size, table]).choice([-1.0, 1.0], (count, 3, size))


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows, whose length is a power of two."""
    n, size = x.shape
    h = 1
    while h < size:
        x = x.reshape(n, -1, 2, h)
        x = np.concatenate([x[:, :, :1] + x[:, :, 1:], x[:, :, :1] - x[:, :, 1:]], 2).reshape(n, size)
        h *= 2
    return x / math.sqrt(size)


def shape_for(vectors: int, dim: int) -> tuple[int, int]:
    """(joined codes, axes of the last one) that give about vectors / IN_BUCKET buckets."""
    size = 1 << max(1, (dim - 1).bit_length())
    wanted, joined = max(2.0, vectors / IN_BUCKET), 1
    while (2 * size) ** joined < wanted:
        joined += 1
    last = 1
    while (2 * size) ** (joined - 1) * 2 * last < wanted:
        last *= 2
    return joined, last


def codes(x: np.ndarray, tables: int, shape: tuple[int, int], probes: int) -> np.ndarray:
    """(vectors, tables, 1 + probes): each vector's bucket and the next best ones, as int64, -1 for none."""
    (joined, last), (n, d) = shape, x.shape
    size = 1 << max(1, (d - 1).bit_length())
    padded = np.zeros((n, size))
    padded[:, :d] = x
    out = np.full((n, tables, 1 + probes), -1, np.int64)
    for t in range(tables):
        main, gaps, shifts = np.zeros(n, np.int64), [], []
        for j in range(joined):
            y = padded
            for s in _signs(size, joined, t)[j]:
                y = hadamard(y * s)
            if j == joined - 1:
                y = y[:, :last]
            both = np.concatenate([y, -y], 1)
            best = np.argpartition(-both, min(probes, both.shape[1] - 1), 1)[:, : probes + 1]
            best = np.take_along_axis(best, np.argsort(-np.take_along_axis(both, best, 1), 1, kind="stable"), 1)
            value = np.take_along_axis(both, best, 1)
            main = main * both.shape[1] + best[:, 0]
            unit = 2 * last * (2 * size) ** (joined - 2 - j) if j < joined - 1 else 1
            gaps.append(value[:, :1] - value[:, 1:])
            shifts.append((best[:, 1:] - best[:, :1]) * unit)
        out[:, t, 0] = main
        gap, shift = np.concatenate(gaps, 1), np.concatenate(shifts, 1)
        first = np.argsort(gap, 1, kind="stable")[:, :probes]
        out[:, t, 1 : 1 + first.shape[1]] = main[:, None] + np.take_along_axis(shift, first, 1)
    return out


def _met(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether pairs meet in a table; a, b: (pairs, 1 + probes)."""
    return (a[:, :1] == b).any(1) | (b[:, :1] == a).any(1)


@lru_cache(64)
def tables_for(dim: int, shape: tuple[int, int], tables: int, probes: int, least: float, pairs: int = 1000) -> int:
    """How many tables miss at most MISSED of the pairs of cosine `least`, by the share of random ones that meet in a table."""
    if dim < 2 or not -1 < least < 1:
        return tables
    a, b = np.random.default_rng([13, dim]).normal(size=(2, pairs, dim))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= (a * b).sum(1, keepdims=True) * a
    b = least * a + math.sqrt(1 - least**2) * b / np.linalg.norm(b, axis=1, keepdims=True)
    x, y = codes(a, tables, shape, probes), codes(b, tables, shape, probes)
    met = np.mean([_met(x[:, t], y[:, t]).mean() for t in range(tables)])
    return max(tables, math.ceil(math.log(MISSED) / math.log(1 - min(max(met, 1 / pairs), 1 - MISSED))))


def block_links(x: np.ndarray, code: np.ndarray, weight: np.ndarray, tile: np.ndarray, table: int, bucket: int, low: int, high: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """(links of each member to others, weighted; each member's root in the block) for the pairs that this block counts.

    x: unit vectors. A pair meets in a bucket that is one member's own; single precision tells the pairs that are far
    below the least cosine, and double precision decides on the others.
    """
    own, small = code[:, table, 0] == bucket, x.astype(np.float32)
    spare = np.float32(least - 1e-5 - 4e-7 * x.shape[1])
    first = np.flatnonzero(tile == low)
    second = first if low == high else np.flatnonzero(tile == high)
    us, vs = [first[:0]], [first[:0]]
    for some, others in [(first[own[first]], second)] + ([] if low == high else [(first[~own[first]], second[own[second]])]):
        right = small[others].T
        for a in range(0, len(some), 512):
            part = some[a : a + 512]
            i, j = np.nonzero(small[part] @ right >= spare)
            u, v = part[i], others[j]
            keep = (u < v) | ~own[v] if low == high else np.ones(len(u), bool)
            u, v = u[keep], v[keep]
            keep = np.einsum("ij,ij->i", x[u], x[v]) >= least
            u, v = u[keep], v[keep]
            for t in range(table):
                keep = ~_met(code[u, t], code[v, t])
                u, v = u[keep], v[keep]
            mine, other = code[u, table], code[v, table]
            both = (mine[:, :1] == other).any(1) & (other[:, :1] == mine).any(1)
            keep = ~both | (bucket == np.minimum(mine[:, 0], other[:, 0]))
            us.append(u[keep])
            vs.append(v[keep])
    u, v = np.concatenate(us), np.concatenate(vs)
    links = np.bincount(u, weight[v], len(x)) + np.bincount(v, weight[u], len(x))
    return links.astype(np.int64), labelled(len(x), u, v)


def _matrix(blobs: pa.ChunkedArray | pa.Array, kind: str) -> np.ndarray:
    """The numbers of binary values of equal lengths, a row for each."""
    return np.frombuffer(b"".join(blobs.to_pylist()), kind).reshape(len(blobs), -1)


def _units(blobs: pa.ChunkedArray | pa.Array, kind: str) -> np.ndarray:
    x = _matrix(blobs, kind).astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


LINKED = "vec_id long, n_links long, component_id long, kept boolean"


def near_duplicates(vectors: DataFrame, least: float = 0.9, key: str = "vec_id", vector: str = "embedding", tables: int = TABLES, probes: int = PROBES) -> DataFrame:
    """One row per row of vectors: LINKED; pairs of cosine `least` or more are links.

    Null vectors, zero vectors and vectors with null or non-finite components link with nothing, and vectors of
    different lengths don't link. A null key stays null; repeated rows count as other vectors with the same
    values; in a component all of whose keys are null the component is null. An empty table gives an empty result.
    """
    single = vectors.schema[vector].dataType.elementType.typeName() == "float"  # such vectors travel in half the bytes
    kind, width = ("<f4", 4) if single else ("<f8", 8)

    def usable(batches):
        for batch in batches:
            lists = column(batch, "x")
            values = lists.values.to_numpy(zero_copy_only=False).astype(kind)  # a null becomes a NaN
            ends, there, found = lists.offsets.to_numpy().tolist(), lists.is_valid().to_pylist(), []
            for a, b, is_there in zip(ends, ends[1:], there):
                x = values[a:b]
                found.append(x.tobytes() if is_there and b > a and np.isfinite(x).all() and x.any() else None)
            yield rows(vec_id=column(batch, "d").cast(pa.int64()), v=pa.array(found, pa.binary()))

    plain = vectors.select(F.col(key).cast("long").alias("d"), F.col(vector).cast("array<float>" if single else "array<double>").alias("x"))
    unit = written(plain.mapInArrow(usable, "vec_id long, v binary"), "unit")
    classes = unit.filter("v is not null").groupBy("v").agg(F.count("*").alias("w"), F.min("vec_id").alias("least_id"))
    classes = written(classes.withColumn("c", F.monotonically_increasing_id()), "classes")
    shapes = {r.n // width: shape_for(r.m, r.n // width) for r in classes.groupBy(F.octet_length("v").alias("n")).agg(F.count("*").alias("m")).collect()}
    of = {d: tables_for(d, shape, tables, probes, least) for d, shape in shapes.items()}

    def coded(batches):
        for batch in batches:
            raw = column(batch, "v")
            dims = np.array([len(r) // width for r in raw.to_pylist()], np.int32)
            for d in np.unique(dims).tolist():
                at = pa.array(np.flatnonzero(dims == d))
                found = codes(_units(raw.take(at), kind), of[d], shapes[d], probes)
                yield rows(c=column(batch, "c").take(at), w=column(batch, "w").take(at), v=raw.take(at), dim=pa.array(np.full(len(at), d), pa.int32()), codes=pa.array([x.tobytes() for x in found], pa.binary()))

    hashed = written(classes.select("c", "w", "v").mapInArrow(coded, "c long, w long, v binary, dim int, codes binary"), "hashed")

    def each_dim(batch, name):
        dims = column(batch, "dim").to_numpy()
        for d in np.unique(dims).tolist():
            at = pa.array(np.flatnonzero(dims == d))
            yield d, at, _matrix(column(batch, name).take(at), "<i8").reshape(len(at), of[d], 1 + probes)

    def loads(batches):
        for batch in batches:
            for d, _, code in each_dim(batch, "codes"):
                for t in range(of[d]):
                    bucket, n = np.unique(code[:, t][code[:, t] >= 0], return_counts=True)
                    yield rows(dim=pa.array(np.full(len(n), d), pa.int32()), t=pa.array(np.full(len(n), t), pa.int32()), bucket=bucket, n=n.astype(np.int64))

    block = ["dim", "t", "bucket"]
    load = hashed.select("dim", "codes").mapInArrow(loads, "dim int, t int, bucket long, n long").groupBy(*block).agg(F.sum("n").alias("n"))
    load = written(load.filter("n > 1").withColumn("tiles", F.ceil(F.col("n") / TILE).cast("int")), "buckets")
    calls = max(partitions(vectors.sparkSession), -(-(load.agg(F.sum(F.col("n") * F.col("tiles"))).first()[0] or 0) // ROWS))

    def dealt(batches):
        for batch in batches:
            for d, at, code in each_dim(batch, "codes"):
                k, t, p = np.nonzero(code >= 0)
                of_row = at.take(pa.array(k))
                yield rows(**{c: column(batch, c).take(of_row) for c in ("c", "w", "v", "codes", "dim")}, t=pa.array(t, pa.int32()), bucket=code[k, t, p])

    members = hashed.mapInArrow(dealt, "c long, w long, v binary, codes binary, dim int, t int, bucket long")
    members = members.join(load.filter("tiles > 1").select(*block, "tiles"), block, "left").withColumn("tiles", F.coalesce("tiles", F.lit(1)))
    members = members.withColumn("tile", F.pmod(F.xxhash64("c"), F.col("tiles")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    members = members.withColumn("low", F.least("tile", "other")).withColumn("high", F.greatest("tile", "other")).drop("tiles", "other")
    block += ["low", "high"]

    def linked(table: pa.Table) -> pa.Table:
        keys = [table.column(c).to_numpy() for c in (*block, "c")]
        order = np.lexsort(keys[::-1])
        c, w, tile = keys[-1], table.column("w").to_numpy(), table.column("tile").to_numpy()
        new = np.zeros(max(0, len(order) - 1), bool)
        for k in keys[:-1]:
            new |= k[order[1:]] != k[order[:-1]]
        out = [(c[:0], c[:0], c[:0])]
        for at in np.split(order, np.flatnonzero(new) + 1):
            if len(at) < 2:
                continue
            d, t, bucket, low, high = (int(k[at[0]]) for k in keys[:-1])
            here = pa.array(at)
            code = _matrix(table.column("codes").take(here), "<i8").reshape(len(at), of[d], 1 + probes)
            links, root = block_links(_units(table.column("v").take(here), kind), code, w[at], tile[at], t, bucket, low, high, least)
            some = np.flatnonzero(links > 0)
            out.append((c[at[some]], links[some], c[at[root[some]]]))
        return pa.table(dict(zip(("c", "n", "root"), map(np.concatenate, zip(*out, strict=True)), strict=True)))

    # many small blocks share a call; a call's rows are bounded as a block's are
    found = members.withColumn("call", F.pmod(F.xxhash64(*block), F.lit(calls))).groupBy("call").applyInArrow(linked, "c long, n long, root long")
    found = written(found, "links")
    counts = found.groupBy("c").agg(F.sum("n").alias("n"))
    roots = components(found.select(F.col("c").alias("a"), F.col("root").alias("b")))
    placed = written(classes.select("c", "v", "w", "least_id").join(roots.withColumnRenamed("node", "c"), "c", "left").withColumn("root", F.coalesce("root", "c")), "placed")
    names = written(placed.groupBy("root").agg(F.min("least_id").alias("component_id")), "names")
    whole = written(placed.join(names, "root").join(counts, "c", "left").select("v", (F.col("w") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), "component_id"), "named")
    for done in (classes, hashed, load, found, placed, names):
        dropped(done)
    component = F.when(F.col("v").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return unit.join(whole, "v", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
