import zlib

import numpy as np
import pytest

pytest.importorskip("tokenizers")
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lodeframe.llm import repair, token_files
from lodeframe.llm.queries import tokenizer_path

SCHEMA = "doc_id long, text string, start string, n string"


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 5), max_size=400), st.integers(2, 9), st.integers(0, 400), st.integers(0, 400))
def test_round_trip(ids, least, a, b):
    ids = np.array(ids, np.uint32)
    blob = repair.Segment.written([1], [len(ids)], ids, least=least)
    s = repair.Segment(blob)
    assert (s.all() == ids).all() and len(s.all()) == len(ids)
    assert s.range(a, b).tolist() == ids[a:b].tolist()


def test_it_compresses_and_stores_lengths():
    ids = np.tile(np.arange(50, dtype=np.uint32), 400)
    seq, rules, base = repair.compress(ids)
    assert len(seq) < len(ids) / 20 and sum(map(len, rules)) > 0
    for keys, size in zip(rules, repair._lengths(rules, base)):
        for k, n in zip(keys.tolist(), size.tolist()):
            assert len(repair.expand(np.array([k >> 32, k & 0xFFFFFFFF], np.uint32), rules, base)) == n


def test_files(spark, sf):
    library = Tokenizer.from_file(tokenizer_path())
    docs = [(r.doc_id, r.text, None, None) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    docs += [(5000, None, "x", "y"), (5001, "", None, None), (5002, "long text " * 20000, None, None), (None, "no key", None, None)]
    got = token_files.round_trip(spark.createDataFrame(docs, SCHEMA).repartition(3), tokenizer_path(), segment=5000).collect()
    at, want = 0, set()
    for d, t, _, _ in sorted(docs, key=lambda r: (r[0] is not None, r[0])):
        ids = np.array(library.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
        want.add((d, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert {tuple(r) for r in got} == want and len(got) == len(docs)


def test_repeated_rows_and_empty(spark):
    docs = spark.createDataFrame([(1, "a b", None, None)] * 5 + [(1, "c", None, None)], SCHEMA)
    got = token_files.round_trip(docs, tokenizer_path()).orderBy("start").collect()
    assert len(got) == 6 and [r.start for r in got] == np.cumsum([0] + [r.n_tokens for r in got])[:-1].tolist()
    assert token_files.round_trip(spark.createDataFrame([], SCHEMA), tokenizer_path()).count() == 0
