"""Every stage against a plain version on its own input."""

import re
import zlib

import numpy as np
import pytest

pytest.importorskip("tokenizers")
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline
from lodeframe.llm import quality, secrets
from lodeframe.llm.queries import tokenizer_path
from tests.llm.test_jaccard import brute


def test_stages(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = corpus_pipeline.written(stage(spark, docs, sf), "stage")
        seen.append((name, before, docs))
    assert [n for n, *_ in seen] == ["quality classifier", "near duplicates", "benchmark decontamination", "secrets", "packing"]
    assert all(after.columns == columns for _, _, after in seen[:-1])

    before, after = (df.collect() for df in seen[0][1:])
    scores = {r.doc_id: r.score for r in quality.classify(seen[0][1], spark.read.parquet(f"{sf}/labels.parquet")).collect()}
    assert {r.doc_id for r in after} == {r.doc_id for r in before if scores[r.doc_id] >= 0.3}

    before, after = (df.collect() for df in seen[1][1:])
    want = {d for d, n, c in brute([(r.doc_id, r.text) for r in before]) if d == c}
    assert {r.doc_id for r in after} == want and len(after) == len(want)

    before, after = (df.collect() for df in seen[2][1:])
    items = [re.findall(r"[^\W_]+", r.text.lower()) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    runs = {tuple(w[k : k + 15]) for w in items for k in range(len(w) - 14)}
    eights = {tuple(w[k : k + 8]) for w in items for k in range(len(w) - 7)}
    holds = lambda text, n, which: any(tuple(w[k : k + n]) in which for w in [re.findall(r"[^\W_]+", text.lower())] for k in range(len(w)))
    gone = {r.doc_id for r in before} - {r.doc_id for r in after}
    assert gone and all(holds(r.text, 8, eights) if r.doc_id in gone else not holds(r.text, 15, runs) for r in before)

    before, after = ({r.doc_id: r for r in df.collect()} for df in seen[3][1:])
    assert before.keys() == after.keys()
    forest = secrets.trained()
    for d, r in before.items():
        flagged = [f for f in secrets.scan([r.text.encode()], [r.source], forest)[0] if f[3] >= 0.5]
        assert after[d].text.count("[SECRET]") == len(flagged) and (flagged or after[d] == r)

    before, after = (df.collect() for df in seen[4][1:])
    library = Tokenizer.from_file(tokenizer_path())
    ids = {r.doc_id: np.array(library.encode(r.text, add_special_tokens=False).ids + [0], "<u4") for r in before}
    pieces = {}
    for r in after:
        assert zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) == r.ids_crc32
        pieces[r.doc_id] = pieces.get(r.doc_id, 0) + r.length
    assert pieces == {d: len(x) for d, x in ids.items()}


def test_registered():
    names = __spark_entry__.queries()
    assert "pipeline" in names and {f"op{n}" for n in range(1, 11)} == {k.split("_")[0] for k in names if k.startswith("op")}


EXTRA = "doc_id long, text string, lang string, source string, n_chars long, gone_id int, leaked string, component_id string, score string, t int"


def chained(spark, rows):
    """What each stage leaves of rows with columns whose names stages use themselves."""
    docs = spark.createDataFrame([(d, t, None, s, None, None, "x", None, "y", k) for k, (d, t, s) in enumerate(rows)], EXTRA)
    columns, left = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.written(stage(spark, docs, "/root/testdata/sf0.001"), "stage")
        assert name == "packing" or docs.columns == columns, name
        left.append(docs.collect())
    return left


def test_odd_rows_through_all_stages(spark):
    base = 10**9  # no labelled document, so that the classifier knows nothing and keeps all rows
    long_text = " ".join(f"w{k * k % 9973}" for k in range(30000))
    rows = [(base + 1, None, None), (base + 2, "", "web"), (base + 3, long_text, None), (base + 4, long_text, "web"), (base + 5, "a text of its own, told twice over", None), (base + 5, "a text of its own, told twice over", None), (base + 6, "short", "x"), (None, "words without a key stand here alone", None)]
    kept, single, clean, redacted, packed = chained(spark, rows)
    assert len(kept) == len(rows)
    assert sorted(str(r.doc_id) for r in single) == sorted(str(d) for d in (base + 1, base + 2, base + 3, base + 5, base + 6, None))
    assert len(clean) == len(redacted) == 6 and {r.text for r in redacted} == {t for _, t, _ in rows}
    library = Tokenizer.from_file(tokenizer_path())
    want = {d: len(library.encode(t or "", add_special_tokens=False).ids) + 1 for d, t, _ in rows if d != base + 4}
    pieces = {}
    for r in packed:
        pieces[r.doc_id] = pieces.get(r.doc_id, 0) + r.length
    assert pieces == want


def test_no_rows_through_all_stages(spark):
    assert [len(x) for x in chained(spark, [])] == [0] * 5
