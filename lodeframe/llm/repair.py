"""Re-Pair grammar compression of id sequences, and a segment format with random access.

Compression works in rounds: a round counts the adjacent pairs of the sequence, gives the most frequent ones a
nonterminal each, and replaces their occurrences from left to right (a run of overlapping occurrences keeps every
second one). The rounds repeat until no pair is frequent enough. A rule's two symbols come from earlier rounds,
so that a sequence expands round by round. Stored are the rules, their expansion lengths, the last sequence, and
the documents' keys and counts of ids: any range of ids is decoded from the symbols that cover it.
"""

from __future__ import annotations

import struct

import numpy as np

MAGIC = b"LFRP0001"
ROUNDS = 12
LEAST = 8  # occurrences of a pair that are worth a rule
GAIN = 0.02  # a round that shortens the sequence by less is the last
BUCKET_BITS = 18


def _round(seq: np.ndarray, first: int, least: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(sequence with its most frequent pairs replaced by first, first + 1, ..., the pairs as left << 32 | right).

    Pairs are counted by hash bucket. One pair stands for each bucket that is full enough; its occurrences are
    then counted exactly, and up to `most` pairs with `least` occurrences or more get a nonterminal. A frequent
    pair that shares its bucket may wait for a later round, whose hash differs.
    """
    with np.errstate(over="ignore"):
        bucket = ((seq[:-1] * np.uint32(0x9E3779B1 + 2 * first) ^ seq[1:] * np.uint32(0x85EBCA77)) * np.uint32(0xC2B2AE3D)) >> np.uint32(32 - BUCKET_BITS)
    load = np.bincount(bucket, minlength=1 << BUCKET_BITS)
    ranked = np.sort(load[load >= least])
    if not len(ranked):
        return seq, np.zeros(0, np.uint64)
    at = np.flatnonzero((load >= max(least, int(ranked[max(0, len(ranked) - most)])))[bucket])
    here = bucket[at]
    pair = seq[at].astype(np.uint64) << np.uint64(32) | seq[at + 1]
    stands = np.zeros(1 << BUCKET_BITS, np.uint64)
    stands[here] = pair
    is_it = stands[here] == pair
    at, here = at[is_it], here[is_it]
    chosen = np.bincount(here, minlength=1 << BUCKET_BITS) >= least
    kept = chosen[here]
    at, here = at[kept], here[kept]
    if not len(at):
        return seq, np.zeros(0, np.uint64)
    begins = np.append(True, np.diff(at) != 1)
    run = np.flatnonzero(begins)[np.cumsum(begins) - 1]
    apart = (np.arange(len(at)) - run) % 2 == 0
    at, here = at[apart], here[apart]
    used = np.zeros(1 << BUCKET_BITS, bool)
    used[here] = True
    number = np.cumsum(used) - 1
    out = seq.copy()
    out[at] = (first + number[here]).astype(np.uint32)
    keep = np.ones(len(seq), bool)
    keep[at + 1] = False
    return out[keep], stands[used]


def compress(ids: np.ndarray, rounds: int = ROUNDS, least: int = LEAST) -> tuple[np.ndarray, list[np.ndarray], int]:
    """(sequence, rules of each round as left << 32 | right, number of the first nonterminal).

    The rounds end when no pair is frequent enough, or when one has shortened the sequence by less than GAIN.
    """
    seq = np.ascontiguousarray(ids, np.uint32)
    base = int(seq.max()) + 1 if len(seq) else 1
    rules, first = [], base
    for _ in range(rounds):
        if len(seq) < 2:
            break
        shorter, used = _round(seq, first, least, max(256, len(seq) // 64))
        if not len(used):
            break
        rules.append(used)
        first += len(used)
        gained = len(seq) - len(shorter)
        seq = shorter
        if gained < GAIN * len(seq):
            break
    return seq, rules, base


def _lengths(rules: list[np.ndarray], base: int) -> list[np.ndarray]:
    """Expansion lengths of the nonterminals, by round."""
    flat = np.zeros(0, np.int64)
    out = []
    for keys in rules:
        both = [np.where((x := side.astype(np.int64)) < base, 1, flat[np.maximum(x - base, 0)] if len(flat) else 1) for side in (keys >> np.uint64(32), keys & np.uint64(0xFFFFFFFF))]
        out.append(both[0] + both[1])
        flat = np.concatenate([flat, out[-1]])
    return out


def _expansions(rules: list[np.ndarray], base: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(all nonterminals' ids one after another, where each one's begin, their counts)."""
    sizes = np.concatenate([np.zeros(0, np.int64), *_lengths(rules, base)])
    begins = np.cumsum(sizes) - sizes
    pool, first = np.zeros(int(sizes.sum()), np.uint32), 0
    for keys in rules:
        at = begins[first : first + len(keys)]
        for side in ((keys >> np.uint64(32)).astype(np.int64), (keys & np.uint64(0xFFFFFFFF)).astype(np.int64)):
            plain = side < base
            pool[at[plain]] = side[plain]
            inner = side[~plain] - base
            n = sizes[inner]
            step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            pool[np.repeat(at[~plain], n) + step] = pool[np.repeat(begins[inner], n) + step]
            at = at + np.where(plain, 1, sizes[np.maximum(side - base, 0)])
        first += len(keys)
    return pool, begins, sizes


def expand(seq: np.ndarray, rules: list[np.ndarray], base: int) -> np.ndarray:
    """The ids that a sequence of symbols stands for."""
    if not len(rules) or not len(seq):
        return seq.astype(np.uint32)
    pool, begins, sizes = _expansions(rules, base)
    pool = np.concatenate([np.arange(base, dtype=np.uint32), pool])
    begins = np.concatenate([np.arange(base), begins + base])
    n = np.concatenate([np.ones(base, np.int64), sizes])[seq]
    end = np.cumsum(n)
    return pool[np.repeat(begins[seq] - (end - n), n) + np.arange(int(end[-1]))]


def _packed(values: np.ndarray) -> bytes:
    """Kind, count, and little-endian values."""
    values = np.ascontiguousarray(values)
    return struct.pack("<cI", values.dtype.char.encode(), len(values)) + values.tobytes()


def _unpacked(blob: bytes, at: int) -> tuple[np.ndarray, int]:
    kind, n = struct.unpack_from("<cI", blob, at)
    at += struct.calcsize("<cI")
    kind = np.dtype(kind.decode())
    return np.frombuffer(blob, kind, n, at), at + n * kind.itemsize


def _narrow(values: np.ndarray) -> np.ndarray:
    return values.astype(np.uint16) if not len(values) or values.max() < 1 << 16 else values.astype(np.uint32)


class Segment:
    """Documents' ids in the file format: MAGIC, base, rounds, then rules, expansion lengths, sequence, keys, counts."""

    def __init__(self, blob: bytes):
        if blob[:8] != MAGIC:
            raise ValueError("not a segment of this format")
        self.base, n = struct.unpack_from("<II", blob, 8)
        at, self.rules, lengths = 16, [], []
        for _ in range(n):
            left, at = _unpacked(blob, at)
            right, at = _unpacked(blob, at)
            size, at = _unpacked(blob, at)
            self.rules.append(left.astype(np.uint64) << np.uint64(32) | right)
            lengths.append(size.astype(np.int64))
        self.lengths = np.concatenate(lengths) if lengths else np.zeros(0, np.int64)
        self.seq, at = _unpacked(blob, at)
        self.seq = self.seq.astype(np.uint32)
        self.keys, at = _unpacked(blob, at)
        self.has_key, at = _unpacked(blob, at)
        self.counts, at = _unpacked(blob, at)
        self.counts = self.counts.astype(np.int64)
        self._ends = None

    @staticmethod
    def written(keys: list[int | None], counts: np.ndarray, ids: np.ndarray, **how) -> bytes:
        seq, rules, base = compress(ids, **how)
        out = [MAGIC, struct.pack("<II", base, len(rules))]
        for r, size in zip(rules, _lengths(rules, base), strict=True):
            out += [_packed(_narrow((r >> np.uint64(32)).astype(np.uint32))), _packed(_narrow(r.astype(np.uint32))), _packed(_narrow(size))]
        out.append(_packed(_narrow(seq)))
        out.append(_packed(np.array([k or 0 for k in keys], np.int64)))
        out.append(_packed(np.array([k is not None for k in keys], np.uint8)))
        out.append(_packed(np.asarray(counts, np.uint32)))
        return b"".join(out)

    def all(self) -> np.ndarray:
        return expand(self.seq, self.rules, self.base)

    def range(self, start: int, stop: int) -> np.ndarray:
        """Ids start to stop of the segment; only the symbols that cover them are expanded."""
        if self._ends is None:
            s = self.seq.astype(np.int64)
            self._ends = np.cumsum(np.where(s < self.base, 1, self.lengths[np.maximum(s - self.base, 0)] if len(self.lengths) else 1))
        stop = min(stop, int(self._ends[-1]) if len(self._ends) else 0)
        if stop <= start:
            return np.zeros(0, np.uint32)
        a, b = np.searchsorted(self._ends, [start, stop - 1], "right")
        before = int(self._ends[a - 1]) if a else 0
        return expand(self.seq[a : b + 1], self.rules, self.base)[start - before : stop - before]

    def document(self, k: int) -> np.ndarray:
        """Ids of the segment's k-th document."""
        end = int(self.counts[: k + 1].sum())
        return self.range(end - int(self.counts[k]), end)
