import zlib

import numpy as np
import pytest

pytest.importorskip("tokenizers")
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lodeframe.llm import packing, token_counts
from lodeframe.llm.bytebpe import Encoder, span_hashes
from lodeframe.llm.queries import tokenizer_path

ODD = ["", " ", "it's  a 'sound' we'll y'all've ''s '", "tr  ", "\n\n a", "a\n\nb \n c", "x<|endoftext|>y", "日本語 テスト 123", "😀 ok", "a b", "1½²³ a_b", "“q” — …", "ab\x1cc", "DON'T 's's't", "é'd 12'34 's5", "\r\n\r\n  x", "a" * 3000, "word " * 70000]
SCHEMA = "doc_id long, text string, sequence_id string, n string"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(tokenizer_path())


@pytest.fixture(scope="module")
def enc():
    return Encoder(tokenizer_path(), slots=1 << 10, room=1 << 12)


def test_odd_texts(library, enc):
    want = [library.encode(t, add_special_tokens=False).ids for t in ODD]
    assert [x.tolist() for x in enc.encode([t.encode() for t in ODD])] == want
    assert enc.counts([t.encode() for t in ODD]).tolist() == [len(x) for x in want]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet="ab'stmdrevl  \n\t12.,_é×“日 ", max_size=30), max_size=5))
def test_random_texts(library, enc, texts):
    assert [x.tolist() for x in enc.encode([t.encode() for t in texts])] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_counts(spark, sf, library):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    texts = [(r.doc_id, r.text, None, "x") for r in docs] + [(9000 + i, t, None, None) for i, t in enumerate(ODD)] + [(None, None, "s", "n"), (9001, ODD[1], None, None)]
    got = token_counts.count_tokens(spark.createDataFrame(texts, SCHEMA), tokenizer_path()).collect()
    want = [(d, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for d, t, _, _ in texts]
    assert sorted(map(str, [(r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in got])) == sorted(str((d, b, n, n > 512)) for d, b, n in want)


def test_table():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(1, 1 << 63, 5000, dtype=np.uint64))
    sizes = rng.integers(1, 30, len(keys)).astype(np.uint8)
    table = token_counts.FrequentLengths(keys, sizes)
    assert (table(keys) == sizes).all() and not table(keys + np.uint64(1)).any()


def brute_first_fit(sizes, capacity):
    bins = []
    for k in sorted(range(len(sizes)), key=lambda k: -sizes[k]):
        for b in bins:
            if sum(sizes[i] for i in b) + sizes[k] <= capacity:
                b.append(k)
                break
        else:
            bins.append([k])
    return bins


def test_first_fit_decreasing():
    rng = np.random.default_rng(2)
    for n in (0, 1, 2, 57, 200):
        sizes = rng.integers(1, 101, n)
        bins, offsets = packing.first_fit_decreasing(sizes, 100)
        want = brute_first_fit(sizes.tolist(), 100)
        assert sorted(map(sorted, ([k for k in range(n) if bins[k] == b] for b in set(bins.tolist())))) == sorted(map(sorted, want))
        for b in set(bins.tolist()):
            at = 0
            for k in sorted(np.flatnonzero(bins == b), key=lambda k: offsets[k]):
                assert offsets[k] == at
                at += sizes[k]
            assert at <= 100


def test_pack(spark, sf, library):
    docs = [(r.doc_id, r.text, None, None) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    docs += [(9000 + i, t, None, None) for i, t in enumerate(ODD)] + [(None, None, "s", "n")]
    rows = packing.pack(spark.createDataFrame(docs, SCHEMA), tokenizer_path(), in_group=64).collect()
    ids = {d: np.array(library.encode(t or "", add_special_tokens=False).ids + [0], "<u4") for d, t, _, _ in docs}
    pieces, sequences = {}, {}
    for r in rows:
        assert zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id])
        pieces.setdefault(r.doc_id, []).append((r.start, r.length))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for d, x in ids.items():
        at = 0
        for a, n in sorted(pieces[d]):
            assert a == at
            at += n
        assert at == len(x)
    full = 0
    for parts in sequences.values():
        at = 0
        for a, n in sorted(parts):
            assert a == at
            at += n
        assert at <= 1024
        full += at
    assert full / (1024 * len(sequences)) > 0.9
    assert packing.pack(spark.createDataFrame([], SCHEMA), tokenizer_path()).count() == 0
    assert token_counts.count_tokens(spark.createDataFrame([], SCHEMA), tokenizer_path()).count() == 0


def test_words_that_collide_modulo_a_power_of_two(spark, library):
    bits = "".join("ab"[bin(k).count("1") % 2] for k in range(1024))
    words = [bits, bits.translate(str.maketrans("ab", "ba")), bits[:40], bits[:40].translate(str.maketrans("ab", "ba"))]
    fresh = Encoder(tokenizer_path())
    want = [library.encode(w, add_special_tokens=False).ids for w in words]
    assert [x.tolist() for x in fresh.encode([w.encode() for w in words])] == want
    rows = [(k, f"{w} " * 9) for k, w in enumerate(words)]
    got = token_counts.count_tokens(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), tokenizer_path()).collect()
    assert {r.doc_id: r.n_tokens for r in got} == {k: len(library.encode(t, add_special_tokens=False).ids) for k, t in rows}


def test_fingerprints():
    raw = b"".join(bytes([k % 251]) * (k % 23) for k in range(600)) * 3
    buf = np.frombuffer(raw, np.uint8)
    rng = np.random.default_rng(4)
    start = rng.integers(0, len(buf) - 900, 3000)
    end = start + rng.integers(0, 900, 3000)
    got = span_hashes(buf, start, end, 77)
    spans = [raw[a:b] for a, b in zip(start.tolist(), end.tolist())]
    assert len(set(got.tolist())) == len(set(spans)) == len(set(zip(got.tolist(), spans)))
    assert (got != span_hashes(buf, start, end, 78)).all() and got.all()
