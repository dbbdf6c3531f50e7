"""Packing of token sequences: first-fit decreasing with a tournament tree of bin capacities, in randomised groups."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeframe.llm.bytebpe import encoder
from lodeframe.llm.columns import column, raw_texts, rows
from lodeframe.llm.scratch import partitions, written

PIECES_IN_GROUP = 2048


class Tournament:
    """Capacities of bins; each inner node holds the largest capacity below it."""

    def __init__(self, bins: int, capacity: int):
        self.leaves = 1 << max(0, (max(1, bins) - 1).bit_length())
        self.best = [capacity] * (2 * self.leaves)

    def first_fit(self, size: int) -> int:
        """The first bin with room for size; takes the room."""
        best, k = self.best, 1
        while k < self.leaves:
            k *= 2
            if best[k] < size:
                k += 1
        best[k] -= size
        found = k - self.leaves
        while k > 1:
            k //= 2
            best[k] = max(best[2 * k], best[2 * k + 1])
        return found


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each item; no item may exceed the capacity."""
    sizes = np.asarray(sizes, np.int64)
    bins, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    order = np.argsort(-sizes, kind="stable")
    full = int((sizes == capacity).sum())
    bins[order[:full]] = np.arange(full)
    tree, used = Tournament(len(sizes) - full, capacity), [0] * (len(sizes) - full)
    for k in order[full:].tolist():
        size = int(sizes[k])
        b = tree.first_fit(size)
        bins[k], offsets[k] = full + b, used[b]
        used[b] += size
    return bins, offsets


def cut(ids: np.ndarray, most: int) -> list[tuple[int, int, int]]:
    """(start, length, crc32 of the ids as little-endian 32-bit integers) of the pieces of a document."""
    raw = ids.astype("<u4").tobytes()
    return [(a, min(most, len(ids) - a), zlib.crc32(raw[4 * a : 4 * (a + most)])) for a in range(0, len(ids), most)]


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def document_pieces(docs: DataFrame, path: str, most: int = 1024, end_id: int = 0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The pieces, of at most `most` ids, of every document with its end id."""

    def made(batches):
        enc, end = encoder(path), np.array([end_id], np.uint32)
        for batch in (b.slice(a, 512) for b in batches for a in range(0, b.num_rows, 512)):
            whole = [np.append(ids, end) for ids in enc.encode(raw_texts(column(batch, "t")))]
            parts = [cut(ids, most) for ids in whole]
            of = np.repeat(np.arange(len(whole)), [len(p) for p in parts])
            flat = np.array([x for p in parts for x in p], np.int64).reshape(-1, 3)
            yield rows(doc_id=column(batch, "d").cast(pa.int64()).take(pa.array(of)), start=flat[:, 0], length=flat[:, 1], ids_crc32=flat[:, 2], doc_tokens=np.array([len(x) for x in whole], np.int64)[of])

    return docs.select(F.col(key).cast("long").alias("d"), F.col(text).alias("t")).mapInArrow(made, PIECES)


PACKED = PIECES + ", sequence_id long, offset long, sequence_tokens long, padded_to long"


def pack(docs: DataFrame, path: str, most: int = 1024, in_group: int = PIECES_IN_GROUP, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: PACKED. Every id of every document lies in exactly one piece.

    Pieces are dealt to groups of about in_group by a hash of document, place, content and row, so that a group
    is a random sample of lengths, of bounded size whatever sources or repeated rows there are; each group is packed alone. A sequence
    is padded to `most` unless its ids number a power of two. Null and empty texts are the end id alone; a null
    key stays null and repeated rows are packed as often as they occur; an empty table gives an empty result.
    """
    pieces = written(document_pieces(docs, path, most, key=key, text=text), "pieces")
    groups = max(1, -(-pieces.count() // in_group))

    def packed(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["doc_id", "start", "ids_crc32"], ignore_index=True)
        bins, offsets = first_fit_decreasing(group["length"].to_numpy(), most)
        used = np.bincount(bins, group["length"].to_numpy()).astype(np.int64)[bins]
        out = group.drop(columns="g")
        out["sequence_id"], out["offset"], out["sequence_tokens"] = (group["g"].to_numpy().astype(np.int64) << 32) + bins, offsets, used
        out["padded_to"] = np.where(used & (used - 1) == 0, used, most)
        return out

    dealt = pieces.withColumn("g", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", F.monotonically_increasing_id()), F.lit(groups)))
    if groups > 1:
        dealt = dealt.repartition(min(groups, 4 * partitions(docs.sparkSession)), "g")
    return dealt.groupBy("g").applyInPandas(packed, PACKED)
