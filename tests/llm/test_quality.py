import zlib

import numpy as np

from lodeframe.llm import quality

SCHEMA = "doc_id long, text string, score string, t string, d string"


def plain_score(net, text):
    """The score by loops over chunks and positions."""
    k = len(net.filters)
    text = text.ljust(max(quality.WIDTH, -(-len(text) // quality.STRIDE) * quality.STRIDE), b"\0")
    blocks = [net.embedding[list(text[a : a + quality.STRIDE])].ravel() for a in range(0, len(text), quality.STRIDE)]
    z = [sum(blocks[i + j] @ net.filters[j] for j in range(k)) + net.bias for i in range(len(blocks) - k + 1)]
    chunks, at = [], 0
    while True:
        chunks.append(np.maximum(np.max(z[at : at + quality.CHUNK], 0), 0))
        if at + quality.CHUNK >= len(z):
            break
        at += quality.STEP
    f = np.concatenate([np.mean(chunks, 0), np.max(chunks, 0)])
    return 1 / (1 + np.exp(-float(f @ net.weights + net.offset[0])))


def test_whole_texts():
    net = quality.Network()
    net.weights += np.random.default_rng(1).normal(0, 0.3, net.weights.shape).astype(np.float32)
    rng = np.random.default_rng(2)
    texts = [bytes(rng.integers(0, 256, n, dtype=np.uint8)) for n in (0, 1, 15, 16, 17, 400, 1036, 1040, 1041, 5000, 9999)]
    want = [plain_score(net, t) for t in texts]
    assert np.allclose(net.scores(texts), want, atol=1e-5)
    assert np.allclose(net.scores(texts[::-1]), want[::-1], atol=1e-5)


def test_long_text_by_pieces(monkeypatch):
    monkeypatch.setattr(quality, "PIECE", 4000)
    net = quality.Network()
    net.weights += 0.1
    text = bytes(np.random.default_rng(3).integers(32, 127, 50001, dtype=np.uint8))
    assert np.allclose(net.scores([text]), plain_score(net, text), atol=1e-5)


def test_it_learns_and_holds_out(spark):
    rng = np.random.default_rng(4)
    words = ["the", "of", "stone", "river", "bread", "and"]
    docs, labels = [], []
    for k in range(600):
        good = k % 3 > 0
        docs.append((k, " ".join(w if good else w + "$$$" for w in rng.choice(words, rng.integers(3, 80)))))
        labels.append((k, int(good)))
    rows = [(d, t, None, "x", None) for d, t in docs] + [(None, None, None, None, None), (9999, "", "a", "b", None), (9999, "", None, None, None), (9998, "stone " * 60000, None, None, None)]
    marks = spark.createDataFrame([*labels, (None, 1), (5, None), (6, 7)], "doc_id long, quality int")
    got = quality.classify(spark.createDataFrame(rows, SCHEMA), marks).collect()
    assert len(got) == len(rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got if r.doc_id is not None)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    want = dict(labels)
    unseen = [r for r in got if r.held_out and r.doc_id in want]
    assert np.mean([r.predicted == want[r.doc_id] for r in unseen]) > 0.95
    kept = quality.accepted(spark.createDataFrame(rows, SCHEMA), marks)
    assert kept.columns == ["doc_id", "text", "score", "t", "d"] and kept.count() == sum(r.predicted for r in got)


def test_no_labels(spark):
    docs = spark.createDataFrame([(1, "a", None, None, None)], SCHEMA)
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.classify(docs, none).first().score == 0.5
    assert quality.classify(spark.createDataFrame([], SCHEMA), none).count() == 0


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = quality.classify(spark.read.parquet(f"{sf}/documents.parquet"), labels).filter("held_out").join(labels, "doc_id").collect()
    assert np.mean([r.predicted == r.quality for r in got]) > 0.88
