"""Token counts of whole texts by a two-tier map-side look-up.

Tier one is a compact hash table, broadcast: fingerprints of frequent pre-tokens and their lengths in ids, under a
random key of the run. It is made from a bounded summary that every task gives of all its texts: fingerprints and
counts of its SUMMARY most frequent pre-tokens are added up by a shuffle; the pre-tokens themselves are not. Tier two is the worker's cache, which the tokenizers library fills. The table's size is
bounded by TABLE entries of nine bytes; what it holds changes the speed and never a count.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeframe.llm.bytebpe import encoder, fresh_key, span_hashes
from lodeframe.llm.columns import column, raw_texts, rows

SUMMARY = 4096
TABLE = 1 << 16
OFTEN = 4  # times in a piece of a text batch, for a pre-token to enter a task's summary


def _merged(keys: np.ndarray, counts: np.ndarray, sizes: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    new, first, back = np.unique(keys, return_index=True, return_inverse=True)
    total = np.bincount(back, counts, len(new)).astype(np.int64)
    best = np.sort(np.argsort(-total, kind="stable")[:most])
    return new[best], total[best], sizes[first][best]


def frequent_lengths(texts: DataFrame, text: str, path: str, key: int, size: int = TABLE, summary: int = SUMMARY) -> tuple[np.ndarray, np.ndarray]:
    """(ascending fingerprints, lengths in ids) of the most frequent pre-tokens of all texts; at most `size` of them.

    key: of the fingerprints.
    """

    def summaries(batches):
        enc = encoder(path)
        keys, counts, sizes = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.uint32)
        for batch in batches:
            for _, buf, start, end, _ in enc.spans(raw_texts(column(batch, "t"))):
                if buf is None:
                    continue
                h, first, n = np.unique(span_hashes(buf, start, end, key), return_index=True, return_counts=True)
                often = n >= OFTEN
                known = enc._look_up(buf, start[first[often]], end[first[often]])[1]
                keys, counts, sizes = np.append(keys, h[often]), np.append(counts, n[often]), np.append(sizes, known)
                if len(keys) > 16 * summary:
                    keys, counts, sizes = _merged(keys, counts, sizes, 4 * summary)
        if len(keys):
            keys, counts, sizes = _merged(keys, counts, sizes, summary)
            yield rows(h=keys.view(np.int64), n=counts, k=sizes.astype(np.int32))

    found = texts.select(F.col(text).alias("t")).mapInArrow(summaries, "h long, n long, k int")
    top = found.groupBy("h").agg(F.sum("n").alias("n"), F.max("k").alias("k")).orderBy(F.desc("n"), "h").limit(size).toArrow()
    keys = top.column("h").to_numpy().view(np.uint64) if len(top) else np.zeros(0, np.uint64)
    order = np.argsort(keys)
    return keys[order], np.minimum(top.column("k").to_numpy(), 255).astype(np.uint8)[order] if len(top) else np.zeros(0, np.uint8)


class FrequentLengths:
    """Open-addressed table of fingerprints and one-byte lengths."""

    def __init__(self, keys: np.ndarray, lengths: np.ndarray):
        keys, lengths = keys[lengths < 255], lengths[lengths < 255]
        self.mask = (1 << max(4, int(np.ceil(np.log2(max(1, len(keys)) * 4))))) - 1
        self.keys = np.zeros(self.mask + 1, np.uint64)
        self.lengths = np.zeros(self.mask + 1, np.uint8)
        self.most = 1
        left = np.arange(len(keys))
        for step in range(self.mask + 1):
            if not len(left):
                break
            self.most = step + 1
            slot = (keys[left] + np.uint64(step) & np.uint64(self.mask)).astype(np.int64)
            free = np.flatnonzero(self.keys[slot] == 0)
            _, one = np.unique(slot[free], return_index=True)
            put = free[one]
            self.keys[slot[put]], self.lengths[slot[put]] = keys[left[put]], lengths[left[put]]
            left = np.delete(left, put)

    def __call__(self, h: np.ndarray) -> np.ndarray:
        """Lengths, 0 where the table lacks a key."""
        out = np.zeros(len(h), np.int64)
        left = np.arange(len(h))
        for step in range(self.most):
            slot = (h[left] + np.uint64(step) & np.uint64(self.mask)).astype(np.int64)
            found = self.keys[slot]
            hit = found == h[left]
            out[left[hit]] = self.lengths[slot[hit]]
            left = left[~hit & (found != 0)]
            if not len(left):
                break
        return out


@lru_cache(2)
def _table(keys: bytes, lengths: bytes) -> FrequentLengths:
    return FrequentLengths(np.frombuffer(keys, np.uint64), np.frombuffer(lengths, np.uint8))


def count_tokens(docs: DataFrame, path: str, limit: int = 512, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_tokens, over_limit.

    Null and empty texts have 0 bytes and 0 tokens. A null key stays null, repeated rows stay repeated, other
    columns are not looked at, and an empty table gives an empty result. Texts of any length are counted whole.
    """
    hash_key = fresh_key()
    keys, lengths = frequent_lengths(docs, text, path, hash_key)
    shared = docs.sparkSession.sparkContext.broadcast((keys.tobytes(), lengths.tobytes()))

    def counted(batches):
        enc, table = encoder(path), _table(*shared.value)
        for batch in batches:
            texts = raw_texts(column(batch, "t"))
            n = np.zeros(len(texts), np.int64)
            for owner, buf, start, end, of in enc.spans(texts):
                if buf is None:
                    for k in owner.tolist():
                        n[k] = len(enc._whole(texts[k]))
                    continue
                size = table(span_hashes(buf, start, end, hash_key))
                miss = np.flatnonzero(size == 0)
                size[miss] = enc._look_up(buf, start[miss], end[miss])[1]
                np.add.at(n, owner, np.bincount(of, size, len(owner)).astype(np.int64))
            sizes = np.fromiter(map(len, texts), np.int64, len(texts))
            yield rows(doc_id=column(batch, "d").cast(pa.int64()), n_bytes=sizes, n_tokens=n, over_limit=n > limit)

    return docs.select(F.col(key).cast("long").alias("d"), F.col(text).alias("t")).mapInArrow(counted, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
