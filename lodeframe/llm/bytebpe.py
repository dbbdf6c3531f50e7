"""Byte-level BPE over whole texts: pre-tokens are found with numpy, the tokenizers library encodes each one once.

The splitting rule is that of the library's byte-level pre-tokenizer: contractions, runs of letters, of
numbers, of other signs (each with one leading space), and white space. It is computed over byte classes for
texts whose characters lie below U+10000 and whose white space is ASCII; any other text, and a text holding a
special string, goes to the library as a whole. A pre-token's 64-bit fingerprint, under a random key of the worker,
finds its ids in a bounded cache; the library encodes what the cache lacks.
"""

from __future__ import annotations

import hashlib
import os
import unicodedata
from functools import lru_cache

import numpy as np

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

LETTER, NUMBER, OTHER, SPACE, WHITE, ODD = range(6)
PIECE = 1 << 18  # bytes of text that are split at once
WAYS = 4  # entries of a bucket of the cache


@lru_cache(1)
def _classes() -> np.ndarray:
    """Class of each character below U+10000."""
    out = np.full(1 << 16, OTHER, np.uint8)
    for cp in range(1 << 16):
        kind = unicodedata.category(chr(cp))
        if kind[0] == "L":
            out[cp] = LETTER
        elif kind[0] == "N":
            out[cp] = NUMBER
        elif kind in ("Cn", "Cs", "Zs", "Zl", "Zp") or 0x1C <= cp <= 0x1F or cp == 0x85:
            out[cp] = ODD
    out[0x20] = SPACE
    out[[0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = WHITE
    return out


@lru_cache(1)
def _ascii() -> np.ndarray:
    out = np.full(256, ODD, np.uint8)
    out[:128] = _classes()[:128]
    return out


def byte_classes(buf: np.ndarray) -> np.ndarray:
    """Class of the character that each UTF-8 byte belongs to."""
    cls = _ascii()[buf]
    high = np.flatnonzero(buf >= 0xC2)
    if len(high):
        table, lead = _classes(), buf[high]
        two = high[lead < 0xE0]
        two = two[two + 1 < len(buf)]
        kind = table[(buf[two].astype(np.int32) & 0x1F) << 6 | buf[two + 1] & 0x3F]
        cls[two] = cls[two + 1] = kind
        three = high[(lead >= 0xE0) & (lead < 0xF0)]
        three = three[three + 2 < len(buf)]
        kind = table[(buf[three].astype(np.int32) & 0x0F) << 12 | (buf[three + 1].astype(np.int32) & 0x3F) << 6 | buf[three + 2] & 0x3F]
        cls[three] = cls[three + 1] = cls[three + 2] = kind
    return cls


def token_starts(buf: np.ndarray, cls: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """Flags of the bytes at which a pre-token starts; heads: the texts' first bytes, ascending."""
    n = len(buf)
    white = cls >= SPACE
    first = np.zeros(n, bool)
    first[heads] = True
    before = np.empty(n, np.uint8)
    before[0], before[1:] = ODD, cls[:-1]
    before[first] = ODD
    last = np.zeros(n, bool)
    last[-1] = True
    last[:-1] = first[1:]
    followed = np.zeros(n, bool)  # by something else than white space
    followed[:-1] = ~white[1:]
    followed[last] = False
    starts = np.where(white, ((before != SPACE) & (before != WHITE)) | followed, (cls != before) & (before != SPACE))
    ticks = np.flatnonzero((buf == 0x27) & starts & ~last)
    if len(ticks):
        text_of = np.searchsorted(heads, ticks, "right")
        ends = np.append(heads, n)[text_of]
        a = buf[ticks + 1]
        b = buf[np.minimum(ticks + 2, n - 1)]
        one = np.isin(a, np.frombuffer(b"stmd", np.uint8))
        two = (ticks + 2 < ends) & (((a == 0x72) | (a == 0x76)) & (b == 0x65) | (a == 0x6C) & (b == 0x6C))
        for t, end, k in ((ticks[one], ends[one], 2), (ticks[two], ends[two], 3)):
            starts[t + 1] = False
            after = t + k
            inside = after < end
            after = after[inside]
            starts[after[cls[after] == LETTER]] = True
    return starts


LONG_SPAN = 256  # bytes; longer spans are hashed by the standard library
MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit numbers."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xFF51AFD7ED558CCD)
        return h ^ (h >> np.uint64(32))


def fresh_key() -> int:
    """A random key for span_hashes, so that nobody can write texts whose fingerprints collide."""
    return int.from_bytes(os.urandom(8), "little")


def span_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray, key: int = 0) -> np.ndarray:
    """Keyed 64-bit fingerprints of spans of bytes, never 0; equal bytes have equal ones wherever they stand.

    A span's length and its words of eight bytes are mixed in one after another, each by a bijection of the whole
    state, so that no difference of texts cancels without knowledge of the key.
    """
    n = end - start
    padded = np.zeros(len(buf) + 8, np.uint8)
    padded[: len(buf)] = buf
    lanes = np.ndarray((len(buf) + 1,), "<u8", padded, strides=(1,))
    h = mixed(n.astype(np.uint64) ^ np.uint64(key))
    h = mixed(h ^ (lanes[start] & MASKS[np.minimum(n, 8)]))
    at, left = 8, np.flatnonzero((n > 8) & (n <= LONG_SPAN))
    while len(left):
        h[left] = mixed(h[left] ^ (lanes[start[left] + at] & MASKS[np.minimum(n[left] - at, 8)]))
        at += 8
        left = left[n[left] > at]
    for k in np.flatnonzero(n > LONG_SPAN).tolist():
        digest = hashlib.blake2b(buf[start[k] : end[k]].tobytes(), digest_size=8, key=key.to_bytes(8, "little")).digest()
        h[k] ^= np.frombuffer(digest, "<u8")[0]
    return np.where(h == 0, np.uint64(1), h)


def pieces(texts: list[bytes], most: int = PIECE):
    """(first text, list of byte strings) with about `most` bytes; a long text is cut where a space stands between two ASCII letters."""
    batch, owner, size = [], [], 0
    for k, t in enumerate(texts):
        at = 0
        while len(t) - at > 2 * most:
            cut = _cut(t, at + most)
            if cut < 0:
                break
            if batch:
                yield owner, batch
                batch, owner, size = [], [], 0
            yield [k], [t[at:cut]]
            at = cut
        batch.append(t[at:] if at else t)
        owner.append(k)
        size += len(t) - at
        if size >= most:
            yield owner, batch
            batch, owner, size = [], [], 0
    if batch:
        yield owner, batch


def _cut(t: bytes, at: int) -> int:
    import re

    m = re.compile(rb"[a-zA-Z] (?=[a-zA-Z])").search(t, at)
    return m.start() + 1 if m else -1


class Encoder:
    """Ids and counts of whole texts as `path`'s tokenizer gives them, without added special tokens.

    slots: entries of the worker's cache; room: ids that it may hold before it is emptied.
    """

    def __init__(self, path: str, slots: int = 1 << 20, room: int = 1 << 22):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.slots, self.room, self.key = slots, room, fresh_key()
        self.keys = np.zeros(slots, np.uint64)
        self.place = np.zeros(slots, np.uint32)
        self.size = np.zeros(slots, np.uint32)
        self.pool = np.zeros(1 << 16, np.uint32)
        self.used = 0

    def _kept(self, ids: np.ndarray) -> None:
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.pool[self.used : self.used + len(ids)] = ids
        self.used += len(ids)

    def _slot(self, h: np.ndarray, key: np.uint64 | None = None) -> np.ndarray:
        """The place of each key (of h itself, if none is given) among the ways of its bucket; the first way where it is missing."""
        slot = (h & np.uint64(self.slots - WAYS)).astype(np.int64)
        first = slot.copy()
        wanted = h if key is None else key
        left = np.flatnonzero(self.keys[slot] != wanted)
        for way in range(1, WAYS):
            if not len(left):
                return slot
            here = first[left] + way
            hit = self.keys[here] == (h[left] if key is None else key)
            slot[left[hit]] = here[hit]
            left = left[~hit]
        return slot

    def _look_up(self, buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in the pool, count of ids) of each pre-token."""
        if self.used > self.room:
            self.keys[:], self.used = 0, 0
        h = span_hashes(buf, start, end, self.key)
        slot = self._slot(h)
        place, size = self.place[slot], self.size[slot]
        missing = np.flatnonzero(self.keys[slot] != h)
        if len(missing):
            new, first, back = np.unique(h[missing], return_index=True, return_inverse=True)
            at = missing[first]
            raw = buf.tobytes()
            words = [raw[a:b].decode("utf-8", "replace") for a, b in zip(start[at].tolist(), end[at].tolist(), strict=True)]
            found = [x.ids for x in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
            sizes = np.fromiter(map(len, found), np.uint32, len(found))
            places = (self.used + np.cumsum(sizes) - sizes).astype(np.uint32)
            self._kept(np.fromiter((i for x in found for i in x), np.uint32, int(sizes.sum())))
            place[missing], size[missing] = places[back], sizes[back]
            slot = self._slot(new, np.uint64(0))
            full = self.keys[slot] != 0
            slot[full] += (new[full] >> np.uint64(60) & np.uint64(WAYS - 1)).astype(np.int64)
            self.keys[slot], self.place[slot], self.size[slot] = new, places, sizes
        return place, size

    def spans(self, texts: list[bytes]):
        """Yields (owners, buf, start, end, owner number of each pre-token), and lastly (the texts that the library takes whole, None, ...)."""
        plain = [k for k, t in enumerate(texts) if not any(s in t for s in self.special)]
        whole = set(range(len(texts))) - set(plain)
        for owner, batch in pieces([texts[k] for k in plain]):
            sizes = np.fromiter(map(len, batch), np.int64, len(batch))
            buf = np.frombuffer(b"".join(batch), np.uint8)
            if not len(buf):
                continue
            ends = np.cumsum(sizes)
            heads = ends - sizes
            cls = byte_classes(buf)
            odd = np.unique(np.searchsorted(ends, np.flatnonzero(cls == ODD), "right"))
            whole.update(plain[owner[i]] for i in odd.tolist())
            starts = token_starts(buf, cls, np.unique(heads[sizes > 0]))
            start = np.flatnonzero(starts)
            end = np.append(start[1:], len(buf))
            of = np.searchsorted(ends, start, "right")
            if len(odd):
                even = ~np.isin(of, odd)
                start, end, of = start[even], end[even], of[even]
            if len(of):
                yield np.array([plain[k] for k in owner]), buf, start, end, of
        yield np.array(sorted(whole), np.int64), None, None, None, None

    def _whole(self, text: bytes) -> list[int]:
        return self.tokenizer.encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids

    def counts(self, texts: list[bytes]) -> np.ndarray:
        out = np.zeros(len(texts), np.int64)
        for owner, buf, start, end, of in self.spans(texts):
            if buf is None:
                for k in owner.tolist():
                    out[k] = len(self._whole(texts[k]))
            else:
                size = self._look_up(buf, start, end)[1]
                np.add.at(out, owner, np.bincount(of, size, len(owner)).astype(np.int64))
        return out

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """uint32 ids of each text."""
        parts: list[list[np.ndarray]] = [[] for _ in texts]
        for owner, buf, start, end, of in self.spans(texts):
            if buf is None:
                for k in owner.tolist():
                    parts[k] = [np.array(self._whole(texts[k]), np.uint32)]
                continue
            place, size = self._look_up(buf, start, end)
            size = size.astype(np.int64)
            stop = np.cumsum(size)
            ids = self.pool[np.repeat(place.astype(np.int64) - (stop - size), size) + np.arange(stop[-1])]
            cuts = np.append(0, stop)[np.searchsorted(of, np.arange(len(owner) + 1))]
            for i, k in enumerate(owner.tolist()):
                parts[k].append(ids[cuts[i] : cuts[i + 1]])
        return [p[0] if len(p) == 1 else np.concatenate(p) if p else np.zeros(0, np.uint32) for p in parts]


@lru_cache(4)
def encoder(path: str) -> Encoder:
    """One encoder, with its cache, for each Python worker."""
    return Encoder(path)
