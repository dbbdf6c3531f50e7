import hashlib
import time

import numpy as np

from lodeframe.llm import secrets

SCHEMA = "doc_id long, text string, source string, n_chars long, rule string"
KEY = "9c8b45435718dcc700c184a7e303cdc64c6a8f7f"


def test_held_out_findings():
    forest = secrets.trained(secrets.labelled_findings(3000, seed=9), trees=20)
    unseen = secrets.labelled_findings(1500, seed=10)
    p = forest.scores(np.array([secrets.features(*f[:4]) for f in unseen]))
    y = np.array([f[4] for f in unseen])
    assert ((p >= 0.5) == y).mean() > 0.93


def test_forest_splits():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(500, 3))
    y = (x[:, 1] > 0.3).astype(float)
    assert ((secrets.Forest(x, y, trees=15).scores(x) > 0.5) == y).mean() > 0.97


def test_candidates():
    raw = f'see token = "{KEY}" and password: hunter2! but internationalization stays, commit {KEY[::-1]}'.encode()
    assert [(raw[a:b].decode(), r) for a, b, r in secrets.candidates(raw)] == [(KEY, "assigned"), ("hunter2!", "assigned"), (KEY[::-1], "run")]


def test_scan_and_redact(spark):
    sf = "/root/testdata/sf0.01"
    docs = [(r.doc_id, r.text, r.source, r.n_chars, None) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    extra = [(None, None, None, None, "r"), (8000, "", None, 0, None), (8001, f'été token = "{KEY}" ' + "über " * 40000 + f"api_key='{KEY[::-1]}'", "a.env", 1, None), (8002, "plain words only", "x", 16, None), (8002, "plain words only", "x", 16, None)]
    df = spark.createDataFrame(docs + extra, SCHEMA)
    forest = secrets.trained()
    got = secrets.scan_secrets(df, forest).collect()
    texts = {d: t for d, t, *_ in docs + extra}
    for r in got:
        value = texts[r.doc_id].encode()[r.start : r.start + r.length]
        assert hashlib.sha256(value).hexdigest() == r.digest
    assert sum(r.is_secret for r in got if r.doc_id == 8001) == 2 and not [r for r in got if r.doc_id in (8000, 8002)]
    planted = [d for d, t, *_ in docs if t and 'token = "' in t]
    assert planted and set(planted) <= {r.doc_id for r in got if r.is_secret}
    clean = secrets.redacted(df, forest).collect()
    assert len(clean) == len(docs + extra)
    for r in clean:
        flagged = [f for f in got if f.doc_id == r.doc_id and f.is_secret]
        assert (r.text == texts[r.doc_id]) == (not flagged)
        if flagged:
            assert "[SECRET]" in r.text and KEY not in r.text and r.n_chars == len(r.text)
    empty = spark.createDataFrame([], SCHEMA)
    assert secrets.scan_secrets(empty, forest).count() == 0 and secrets.redacted(empty, forest).count() == 0


def test_long_values(spark):
    rng = np.random.default_rng(4)
    some = lambda n: "".join(rng.choice(list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_-"), n))
    values = [f"eyJhbGciOiJSUzI1NiJ9.{some(380)}.{some(340)}", rng.bytes(256).hex(), rng.bytes(800).hex()]
    df = spark.createDataFrame([(k, f'some words before token = "{v}" and after', "src/app.py", 1, None) for k, v in enumerate(values)], SCHEMA)
    forest = secrets.trained()
    got = {r.doc_id: r for r in secrets.scan_secrets(df, forest).collect()}
    assert [(got[k].length, got[k].digest, got[k].is_secret) for k in range(3)] == [(len(v), hashlib.sha256(v.encode()).hexdigest(), True) for v in values]
    assert {r.text for r in secrets.redacted(df, forest).collect()} == {'some words before token = "[SECRET]" and after'}


def brute_candidates(text):
    """By the rule's words: assigned values first, then runs that touch none of them."""
    found, names = [], ("passwd", "password", "passwrd", "pwd", "secret", "token", "api_key", "api-key", "apikey", "access_key", "private_key", "credential", "credentials")
    run = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-")
    at = 0
    while at < len(text):
        end = None
        for name in names:
            if text[at:].lower().startswith(name):
                k = at + len(name)
                while k < len(text) and (text[k].isalnum() or text[k] == "_") and k - at - len(name) < 20:
                    k += 1
                blank = lambda k: k + min(3, len(text[k:]) - len(text[k:].lstrip(" \n")))
                quote = lambda k: k + (text[k : k + 1] in ("'", '"'))
                k = blank(quote(k))
                for signs in (2, 1):
                    if len(text) < k + signs or not set(text[k : k + signs]) <= set(":="):
                        continue
                    first = stop = quote(blank(k + signs))
                    while stop < len(text) and text[stop] not in " \n\"'<>,;":
                        stop += 1
                    if stop - first >= 6:
                        end = stop
                        found.append((first, stop, "assigned"))
                        break
                if end:
                    break
        at = end or at + 1
    at = 0
    while at < len(text):
        stop = at
        while stop < len(text) and text[stop] in run:
            stop += 1
        value = text[at:stop]
        if len(value) >= 16 and (any(c.isdigit() for c in value) or any(c.isupper() for c in value[1:])) and not (value.isupper() and value.isalpha()) and not any(a < stop and at < b for a, b, r in found if r == "assigned"):
            found.append((at, stop, "run"))
        at = max(stop, at + 1)
    return sorted(found)


def test_candidates_against_brute_force():
    rng = np.random.default_rng(8)
    parts = ["token", "my_secret", "password", " = ", "=", ": ", '"', " ", "\n", "plain words", KEY, "x" * 30, "AB12" * 6, "ABCDEFGHIJKLMNOPQRST", "hunter2!", "api_key", "'", ",", "q7" * 200, "/usr/local/lib64/python", "short1"]
    for _ in range(400):
        text = "".join(parts[i] for i in rng.integers(0, len(parts), 14))
        assert secrets.candidates(text.encode()) == brute_candidates(text), text


def test_long_texts_take_linear_time():
    text = (f'token = "{KEY}" and {KEY[::-1]} then ' * 40000).encode()
    began = time.process_time()
    assert len(secrets.candidates(text)) == 80000
    assert time.process_time() - began < 10


def test_long_values_and_other_columns(spark):
    value = (KEY + "/" + KEY[::-1]) * 125
    df = spark.createDataFrame([(1, f'token = "{value}" end', "7", "p"), (2, "nothing here", "12", None), (3, None, None, "p")], "doc_id long, text string, n_chars string, d string")
    got = {r.doc_id: r for r in secrets.redacted(df).collect()}
    assert got[1].text == 'token = "[SECRET]" end' and got[1].n_chars == str(len(got[1].text)) and got[2].n_chars == "12" and got[3].text is None and got[3].n_chars is None
