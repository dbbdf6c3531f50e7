import re

import pytest

pytest.importorskip("ahocorasick")
from hypothesis import given, settings
from hypothesis import strategies as st

from lodeframe.llm import licenses

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, labels string, score string"


def brute(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    found = [(k, label) for phrase, label in licenses.BASE.items() for k in range(len(words)) if words[k : k + len(p := phrase.split())] == p]
    at = sorted(k for k, _ in found)
    return len(words), len(at), at[0] if at else None, at[-1] if at else None, ",".join(sorted({x for _, x in found}))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["MIT", "mit", "license", "License", "é", "licenseé", "general", "public", "apache", "x1"]), max_size=12), st.sampled_from([" ", "-", "\n", ", "]))
def test_places(words, gap):
    text = gap.join(words)
    assert licenses.scan(text.encode())[:4] == brute(text)[:4]
    assert ",".join(sorted(licenses.scan(text.encode())[4])) == brute(text)[4]


@pytest.mark.parametrize(
    ("text", "labels", "fine"),
    [
        ("MIT", {"mit"}, True),
        ("GPL-2.0-only WITH Classpath-exception-2.0", {"gpl"}, False),
        ("MIT OR GPL-3.0", {"mit", "gpl"}, True),
        ("MIT AND GPL-3.0", {"mit", "gpl"}, False),
        ("MIT OR GPL-3.0 AND AGPL-3.0", {"mit", "gpl", "agpl"}, True),
        ("(MIT OR GPL-3.0) AND AGPL-3.0", {"mit", "gpl", "agpl"}, False),
        ("Apache-2.0 with LLVM-exception or gpl-2.0+ */", {"apache", "gpl"}, True),
        ("((MIT))", {"mit"}, True),
    ],
)
def test_expressions(text, labels, fine):
    assert licenses.evaluate(text) == (labels, fine)


@pytest.mark.parametrize("text", ["", "AND MIT", "MIT OR", "(MIT", "()", "MIT AND OR GPL"])
def test_malformed(text):
    assert licenses.evaluate(text) is None


def test_postfix_order():
    assert licenses.postfix("a OR b AND c WITH d") == ["a", "b", "c", "d", "WITH", "AND", "OR"]


def test_query(spark, sf):
    docs = [(r.doc_id, r.text, None, None) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    docs += [(None, None, "a", "b"), (7000, "", None, None), (7001, "// SPDX-License-Identifier: (MIT OR GPL-2.0) AND Zlib\ncode " + "pad " * 50000, None, None), (7001, "dup", None, None), (7001, "dup", None, None)]
    got = licenses.scan_licenses(spark.createDataFrame(docs, SCHEMA)).collect()
    assert sorted(str((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels)) for r in got) == sorted(str((d, *brute(t))) for d, t, _, _ in docs)
    tagged = next(r for r in got if r.n_words > 50000)
    assert tagged.labels == "gpl,mit,zlib" and tagged.usable and 0.9 < tagged.score <= 1
    assert all(set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1 for r in got)
    assert licenses.scan_licenses(spark.createDataFrame([], SCHEMA)).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["released under the mit license", "licensed under the apache license version 2 0", "gnu lesser general public license", "cc by nc sa", "mit license", "apache", "x1", "é"]), max_size=12))
def test_places_of_notices(parts):
    words = " ".join(parts).split()
    phrases = {*licenses.BASE, *licenses.NOTICES}
    want = sorted((k, p) for p in phrases for k in range(len(words)) if words[k : k + len(p.split())] == p.split())
    assert licenses.scan(" ".join(parts).encode())[7] == want
    assert licenses.scan(" ".join(parts).encode())[:4] == brute(" ".join(parts))[:4]
