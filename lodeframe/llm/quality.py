"""Quality scores by a byte-level convolutional network in numpy.

A document is cut into overlapping chunks that cover it whole. Bytes are embedded; filters of WIDTH bytes, moved
by STRIDE, are learned; each chunk keeps a filter's largest response (max-pooling). A document's features are the
mean and the largest of its chunks' responses, combined by a logistic unit into one probability. The network is
trained on the driver from a bounded sample of labelled documents, each whole: SAMPLE documents of at most LONGEST
bytes each and BYTES together.
"""

from __future__ import annotations

import pickle
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodeframe.llm.columns import column, raw_texts, released, rows

SAMPLE = 5000  # labelled documents that the network is fitted on
LONGEST = 1 << 22  # bytes of such a document, at most
BYTES = 1 << 25  # bytes of them all, at most; where they have more, the longest ones are left out of the sample
BATCH, BATCH_BYTES = 64, 1 << 20  # documents of a training step, and bytes after which a step takes no more
EMBED, FILTERS, STRIDE, WIDTH = 6, 24, 4, 16
CHUNK = 256  # positions of a chunk, STRIDE bytes each
STEP = 240
PIECE = 1 << 18
CUT = 0.3


def laid_out(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The texts' bytes, padded and joined; of each chunk its text, and its first and last position, the last excluded."""
    sizes = np.array([max(WIDTH, -(-len(t) // STRIDE) * STRIDE) for t in texts])
    flat = np.frombuffer(b"".join(t.ljust(n, b"\0") for t, n in zip(texts, sizes.tolist(), strict=True)), np.uint8)
    first = np.append(0, np.cumsum(sizes // STRIDE))[:-1]
    places = sizes // STRIDE - WIDTH // STRIDE + 1
    chunks = 1 + np.maximum(0, -(-(places - CHUNK) // STEP))
    of = np.repeat(np.arange(len(texts)), chunks)
    begin = first[of] + (np.arange(len(of)) - np.repeat(np.cumsum(chunks) - chunks, chunks)) * STEP
    return flat, of, begin, np.minimum(begin + CHUNK, (first + places)[of])


class Network:
    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        normal = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape).astype(np.float32)
        self.embedding = (rng.normal(0, 0.7, (256, EMBED))).astype(np.float32)
        self.filters = [normal(STRIDE * EMBED, FILTERS) for _ in range(WIDTH // STRIDE)]
        self.bias = np.zeros(FILTERS, np.float32)
        self.weights = np.zeros(2 * FILTERS, np.float32)
        self.offset = np.zeros(1, np.float32)

    def parameters(self) -> list[np.ndarray]:
        return [self.embedding, *self.filters, self.bias, self.weights, self.offset]

    def responses(self, padded: np.ndarray) -> np.ndarray:
        """Responses at every position of bytes whose count is a multiple of STRIDE."""
        x = self.embedding[padded].reshape(-1, STRIDE * EMBED)
        n = len(x) - len(self.filters) + 1
        z = x[:n] @ self.filters[0]
        for k, f in enumerate(self.filters[1:], 1):
            z += x[k : n + k] @ f
        return z + self.bias

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """Probability of each text, over the whole text."""
        out = np.zeros(len(texts))
        batch, size = [], 0
        for k, t in enumerate(texts):
            batch.append(k)
            size += len(t)
            if size >= PIECE or k == len(texts) - 1:
                out[batch] = self._scores([texts[i] for i in batch])
                batch, size = [], 0
        return out

    def _scores(self, texts: list[bytes]) -> np.ndarray:
        if len(texts) == 1 and len(texts[0]) > 4 * PIECE:
            peak, total, chunks = self._long(texts[0])
        else:
            flat, of, begin, end = laid_out(texts)
            z = self.responses(flat)
            z = np.concatenate([z, z[-1:]])
            top = np.maximum(np.maximum.reduceat(z, np.stack([begin, end], 1).ravel())[::2], 0)
            heads = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
            peak, total, chunks = np.maximum.reduceat(top, heads), np.add.reduceat(top, heads), np.bincount(of)[:, None]
        features = np.concatenate([total / chunks, peak], 1)
        logit = (features @ self.weights + self.offset).astype(np.float64)
        return 1 / (1 + np.exp(-np.clip(logit, -40, 40)))

    def _long(self, text: bytes):
        """Peak, sum and count of a long text's chunk responses, piece by piece; a piece holds whole chunks."""
        each = max(1, PIECE // (STEP * STRIDE))
        peak, total, count, at = np.zeros((1, FILTERS), np.float32), np.zeros((1, FILTERS), np.float32), 0, 0
        places = -(-len(text) // STRIDE) - len(self.filters) + 1
        chunks = 1 + max(0, -(-(places - CHUNK) // STEP))
        for at in range(0, chunks, each):
            here = min(each, chunks - at)
            a = at * STEP * STRIDE
            part = text[a : a + ((here - 1) * STEP + CHUNK + len(self.filters) - 1) * STRIDE]
            z = self.responses(np.frombuffer(part.ljust(max(WIDTH, -(-len(part) // STRIDE) * STRIDE), b"\0"), np.uint8))
            for c in range(here):
                top = np.maximum(z[c * STEP : c * STEP + CHUNK].max(0), 0)
                peak, total, count = np.maximum(peak, top), total + top, count + 1
        return peak, total, count


def steps_of(order: np.ndarray, texts: list[bytes]):
    """order in runs of BATCH documents, or fewer that reach BATCH_BYTES."""
    run, size = [], 0
    for i in order.tolist():
        run.append(i)
        size += len(texts[i])
        if len(run) == BATCH or size >= BATCH_BYTES:
            yield np.array(run)
            run, size = [], 0
    if run:
        yield np.array(run)


def train(texts: list[bytes], labels: np.ndarray, epochs: int = 6, steps: int = 400, rate: float = 0.02, seed: int = 7) -> Network:
    """Fit by Adam to whole texts and their labels, 0 or 1, for `epochs` or at least `steps` steps."""
    net = Network()
    if len(labels) == 0 or labels.min() == labels.max():
        net.offset[0] = 0.0 if len(labels) == 0 else 4.0 * (2 * labels[0] - 1)
        return net
    rng = np.random.default_rng(seed)
    first = [np.zeros_like(p) for p in net.parameters()]
    second = [np.zeros_like(p) for p in net.parameters()]
    step = 0
    epochs = max(epochs, -(-steps * BATCH // len(labels)))
    for epoch in range(epochs):
        for at in steps_of(rng.permutation(len(labels)), texts):
            b = len(at)
            flat, of, begin, end = laid_out([texts[i] for i in at.tolist()])
            z = net.responses(flat)
            reach = np.minimum(begin[:, None] + np.arange(CHUNK), end[:, None] - 1)
            best = np.minimum(begin[:, None] + z[reach].argmax(1), end[:, None] - 1)  # (chunks, filters)
            top = np.maximum(np.take_along_axis(z, best, 0), 0)
            count = np.bincount(of)[:, None]
            heads = (np.cumsum(count) - count[:, 0]).astype(np.int64)
            peak = np.maximum.reduceat(top, heads)
            peak_at = np.minimum.reduceat(np.where(top == peak[of], np.arange(len(of))[:, None], len(of)), heads)
            features = np.concatenate([np.add.reduceat(top, heads) / count, peak], 1).astype(np.float32)
            p = 1 / (1 + np.exp(-(features @ net.weights + net.offset)))
            d = ((p - labels[at]) / b).astype(np.float32)
            g_features = d[:, None] * net.weights
            g = (g_features[:, :FILTERS] / count).astype(np.float32)[of]
            g[peak_at, np.arange(FILTERS)] += g_features[:, FILTERS:]
            g *= top > 0
            raw = flat.reshape(-1, STRIDE)
            g_embedding, g_filters = np.zeros_like(net.embedding), []
            for t, f in enumerate(net.filters):
                seen = net.embedding[raw[best + t]].reshape(*best.shape, STRIDE * EMBED)  # (chunks, filters, inputs)
                g_filters.append(np.einsum("wfi,wf->if", seen, g))
                back = (g[:, :, None] * f.T[None]).reshape(-1, EMBED)
                np.add.at(g_embedding, raw[best + t].reshape(-1), back)
            grads = [g_embedding, *g_filters, g.sum(0), features.T @ d + 1e-4 * net.weights, np.array([d.sum()], np.float32)]
            step += 1
            for param, grad, f1, f2 in zip(net.parameters(), grads, first, second, strict=True):
                f1 += 0.1 * (grad - f1)
                f2 += 0.001 * (grad * grad - f2)
                pace = rate * 0.5 * (1 + np.cos(np.pi * epoch / epochs))
                param -= (pace * (f1 / (1 - 0.9**step)) / (np.sqrt(f2 / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return net


def held_out(key: str = "doc_id"):
    """Whether a document's labels are kept from training."""
    return F.coalesce(F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE) -> Network:
    """A network fitted on up to `sample` labelled documents that are not held out, chosen by a hash of the key and
    taken whole; those over LONGEST bytes, and the longest beyond BYTES together, are left out of the sample."""
    marked = labels.select(F.col(key).cast("long").alias("d"), F.col(label).cast("int").alias("y")).filter("d is not null and y in (0, 1)").groupBy("d").agg(F.max("y").alias("y"))
    chosen = marked.filter(~held_out("d")).orderBy(F.xxhash64("d"), "d").limit(sample)
    whole = docs.select(F.col(key).cast("long").alias("d"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"))
    found = whole.withColumn("n", F.octet_length("t")).filter(F.col("n") <= LONGEST).join(F.broadcast(chosen), "d")
    found = found.groupBy("d").agg(F.min(F.struct("n", F.col("t").cast("binary").alias("t"), "y")).alias("s")).select("d", "s.*")  # a row for each key
    shorter = F.sum(F.col("n").cast("long")).over(Window.orderBy("n", "d").rowsBetween(Window.unboundedPreceding, 0))  # of a sample's rows
    found = found.withColumn("so_far", shorter).filter(F.col("so_far") <= BYTES).select("d", "y", "t").toArrow()
    found = sorted(zip(*(found.column(c).to_pylist() for c in "dyt"), strict=True))
    return train([t for _, _, t in found], np.array([y for _, y, _ in found], np.float32))


@lru_cache(2)
def _network(blob: bytes) -> Network:
    return pickle.loads(blob)


SCORED = "doc_id long, held_out boolean, score double, predicted int"


def _scored(net: Network, key: str, text: str, docs: DataFrame, keep: float | None):
    blob = docs.sparkSession.sparkContext.broadcast(pickle.dumps(net))

    def score(batches):
        model = _network(blob.value)
        for batch in batches:
            p = model.scores(raw_texts(column(batch, text if keep is not None else "t")))
            if keep is not None:
                yield batch.filter(pa.array(p >= keep))
            else:
                yield rows(doc_id=column(batch, "d").cast(pa.int64()), held_out=column(batch, "h"), score=p, predicted=pa.array((p >= CUT).astype(np.int32), pa.int32()))
        released()

    if keep is not None:
        return docs.mapInArrow(score, docs.schema)
    return docs.select(F.col(key).cast("long").alias("d"), held_out(key).alias("h"), F.col(text).alias("t")).mapInArrow(score, SCORED)


def classify(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: SCORED. Null and empty texts are scored as an empty text; null keys are not held
    out and stay null; repeated rows stay repeated; without labels of both kinds every score is the same; an empty
    table gives an empty result; other columns are not looked at."""
    return _scored(fit(docs, labels, key, text), key, text, docs, None)


def accepted(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", cut: float = CUT) -> DataFrame:
    """The rows of docs whose score is at least `cut`, with all their columns, whatever their names.

    Null and empty texts are scored as an empty text, and texts of any length whole; rows with a null key are scored
    like others; repeated rows stay or go together; without labels of both kinds all rows have one score, 0.5 where
    there are none at all; an empty table gives an empty result.
    """
    return _scored(fit(docs, labels, key, text), key, text, docs, cut)
