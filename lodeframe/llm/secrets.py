"""Secret scans: regular expressions propose candidates, a random forest removes the false positives.

The forest sees a candidate's length, its character classes and their transitions, how usual its letter pairs are,
how much of it dictionary words cover, the document's path, and the words beside it. It is trained on labelled
findings; `labelled_findings` makes a seeded set of them where none are given.
"""

from __future__ import annotations

import base64
import hashlib
import math
import pickle
import re
import uuid
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeframe.llm.columns import column, raw_texts, rows

RUN = re.compile(rb"[A-Za-z0-9+/_=-]{16,}")
ASSIGNED = re.compile(rb"(?:passw(?:or)?d|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|credentials?)[A-Za-z0-9_]{0,20}[\"']?\s{0,3}[:=]{1,2}\s{0,3}[\"']?([^\s\"'<>,;]{6,})", re.IGNORECASE)
BESIDE = 48  # bytes of context on either side
LONG = 200  # bytes; a longer value scores as its beginning does if that is more, as the labelled findings hold no longer ones

# Words beside a candidate that speak for a secret, and such that speak against one.
FOR = ("secret", "token", "password", "passwd", "pwd", "apikey", "api_key", "api-key", "access_key", "private", "credential", "auth", "bearer")
AGAINST = ("sha", "md5", "commit", "checksum", "digest", "hash", "uuid", "guid", "etag", "revision", "example", "sample", "placeholder", "dummy", "integrity", "blob", "build", "version", "id=", "http", "href", "src=", "img")
PREFIXES = ("akia", "asia", "ghp_", "gho_", "github_pat_", "sk_live_", "sk-", "xoxb-", "xoxp-", "aiza", "eyj", "glpat-", "npm_", "pypi-")
FAKE = ("example", "xxxx", "your", "changeme", "placeholder", "dummy", "sample", "test", "insert", "redacted", "1234567", "abcdef")
TEST_PATHS = ("test", "example", "sample", "fixture", "mock", "doc", "vendor", "node_modules", "lock")
WORDS = (
    "the and that with from this have for not are was but all can her his one our out you day get has him how man new now old see two way who boy did its let put say she too use "
    "user name file data value config server client service account admin login key public private default string number index table column group value time date create update delete "
    "return class function import export module package system process thread memory buffer stream socket request response header body content type length size count total test "
    "production staging development local remote master branch release version build deploy cluster node worker queue cache store bucket region zone image container "
    "handle manager factory builder provider listener controller adapter wrapper helper utils common core base abstract interface implementation"
).split()


@lru_cache(1)
def _usual_pairs() -> np.ndarray:
    """Log probability of each pair of lower-case letters in the dictionary's words."""
    n = np.full((26, 26), 0.2)
    for w in WORDS:
        for a, b in zip(w, w[1:]):
            n[ord(a) - 97, ord(b) - 97] += 1
    return np.log(n / n.sum())


@lru_cache(1)
def _dictionary() -> re.Pattern:
    return re.compile("|".join(sorted((w for w in set(WORDS) if len(w) > 2), key=lambda w: (-len(w), w))))


NAMES = ("length", "log_length", "digits", "upper", "lower", "other", "entropy", "distinct", "switches", "pairs", "coverage", "hex", "uuid", "prefix", "fake", "run", "words_for", "words_against", "near_for", "quoted", "assigned", "test_path", "code_path", "slashes", "padding")


def features(candidate: str, before: str, after: str, path: str) -> list[float]:
    n = len(candidate)
    kinds = ["d" if c.isdigit() else "u" if "A" <= c <= "Z" else "l" if "a" <= c <= "z" else "o" for c in candidate]
    counts = {c: candidate.count(c) for c in set(candidate)}
    low = candidate.lower()
    pairs, usual = [(ord(a) - 97, ord(b) - 97) for a, b in zip(low, low[1:]) if "a" <= a <= "z" and "a" <= b <= "z"], _usual_pairs()
    longest = run = 1
    for a, b in zip(candidate, candidate[1:]):
        run = run + 1 if a == b else 1
        longest = max(longest, run)
    b, a, p = before.lower(), after.lower(), path.lower()
    near = b[-16:]
    return [
        n, math.log(n), kinds.count("d") / n, kinds.count("u") / n, kinds.count("l") / n, kinds.count("o") / n,
        -sum(k / n * math.log2(k / n) for k in counts.values()), len(counts) / n, sum(x != y for x, y in zip(kinds, kinds[1:])) / max(1, n - 1),
        sum(usual[i] for i in pairs) / len(pairs) if pairs else -8.0, sum(map(len, _dictionary().findall(low))) / n,
        float(all(c in "0123456789abcdef" for c in low)), float(bool(re.fullmatch(r"[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}", low))),
        float(low.startswith(PREFIXES)), float(any(f in low for f in FAKE)), longest / n,
        sum(w in b for w in FOR), sum(w in b or w in a[:16] for w in AGAINST), float(any(w in near for w in FOR)),
        float(b[-1:] in ("'", '"')), float(bool(re.search(r"[:=]\s{0,3}[\"']?$", b))),
        float(any(w in p for w in TEST_PATHS)), float(bool(re.search(r"\.(py|js|ts|go|java|rb|sh|env|ya?ml|json|ini|cfg|toml|tf)$", p))),
        float(low.count("/") + low.count("-") + low.count("_")), float(candidate.endswith("=")),
    ]


def labelled_findings(n: int = 4000, seed: int = 9) -> list[tuple[str, str, str, str, int]]:
    """(candidate, before, after, path, label): secrets of known formats, and what is taken for them."""
    rng = np.random.default_rng(seed)
    pick = lambda x: x[int(rng.integers(len(x)))]
    raw = lambda k: rng.integers(0, 256, k, dtype=np.uint8).tobytes()
    some = lambda alphabet, k: "".join(alphabet[i] for i in rng.integers(0, len(alphabet), k))
    upper, lower, digits = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
    filler = lambda k: " ".join(pick(WORDS) for _ in range(int(rng.integers(1, k))))
    hexes = lambda: raw(pick((16, 20, 24, 32))).hex()
    secrets = (
        hexes, hexes, lambda: base64.b64encode(raw(int(rng.integers(18, 48)))).decode(), lambda: base64.urlsafe_b64encode(raw(int(rng.integers(18, 40)))).decode().rstrip("="),
        lambda: "AKIA" + some(upper + digits, 16), lambda: "ghp_" + some(upper + lower + digits, 36), lambda: "sk_live_" + some(upper + lower + digits, 24), lambda: "xoxb-" + some(digits, 12) + "-" + some(lower + upper + digits, 24),
        lambda: "AIza" + some(upper + lower + digits + "_-", 35), lambda: some(upper + lower + digits + "!@#%^*", int(rng.integers(9, 22))), lambda: some(lower + digits, int(rng.integers(20, 44))),
    )
    camel = lambda: "".join(pick(WORDS).title() for _ in range(int(rng.integers(3, 7))))
    others = (
        lambda: str(uuid.UUID(bytes=raw(16))), hexes, camel, lambda: "_".join(pick(WORDS) for _ in range(int(rng.integers(3, 7)))), lambda: "-".join(pick(WORDS) for _ in range(int(rng.integers(3, 7)))) + some(digits, 2),
        lambda: "/".join(pick(WORDS) for _ in range(int(rng.integers(3, 7)))) + some(digits, 1), lambda: some(digits, int(rng.integers(16, 30))), lambda: pick(("your", "example", "insert", "my")) + "_" + pick(("secret", "token", "api")) + "_" + pick(("here", "key", "1234567")),
        lambda: pick("xX*-=_") * int(rng.integers(16, 40)), lambda: "".join(pick(WORDS) for _ in range(int(rng.integers(3, 6)))) + some(digits, int(rng.integers(1, 4))), lambda: base64.b64encode(raw(int(rng.integers(90, 150)))).decode(),
    )
    named = ("token", "secret", "password", "api_key", "API_KEY", "access_key", "auth_token", "client_secret", "SECRET_TOKEN", "db_password", "private_key", "credential")
    plain = ("commit", "sha256", "md5", "checksum", "etag", "uuid", "revision", "build", "id", "image", "digest", "integrity", "href", "file", "class", "see", "ref", "version")
    joins = (' = "', "='", ": ", "=", ' : "', " = ", ' => "')
    paths = ("src/app.py", "config/prod.yaml", ".env", "main.go", "src7", "web", "README.md", "tests/test_login.py", "docs/example.md", "package-lock.json")
    out = []
    for k in range(n):
        label = int(k % 2)
        if label:
            value, before, path = pick(secrets)(), f"{filler(6)} {pick(named)}{pick(joins)}", pick(paths[:-4] if rng.random() < 0.9 else paths)
            if value.startswith(PREFIXES[:8]) and rng.random() < 0.3:
                before = filler(6) + " "
        else:
            value, before, path = pick(others)(), filler(6) + (f" {pick(plain)}{pick(joins)}" if rng.random() < 0.6 else " "), pick(paths)
            if rng.random() < 0.15 and not all(c in "0123456789abcdef" for c in value) and len(value) < 90:
                before = f"{filler(6)} {pick(named)}{pick(joins)}"
        out.append((value, before[-BESIDE:], ('" ' if before[-1] in "'\"" else " ") + filler(5), path, label))
    return out


class Forest:
    """Trees of bootstrap samples; each node splits on the best of a random few features by Gini impurity."""

    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 10, least: int = 3, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.trees = [self._tree(x, y, rng.integers(0, len(y), len(y)), depth, least, rng) for _ in range(trees)]

    @staticmethod
    def _tree(x, y, sample, depth, least, rng):
        """Arrays: feature (-1: leaf), threshold, left, right, value."""
        nodes: list[list] = []

        def grow(at, left_depth) -> int:
            me = len(nodes)
            share = float(y[at].mean())
            nodes.append([-1, 0.0, 0, 0, share])
            if left_depth == 0 or len(at) < 2 * least or share in (0.0, 1.0):
                return me
            best = (2.0, None)
            for f in rng.choice(x.shape[1], max(1, round(math.sqrt(x.shape[1]))), replace=False).tolist():
                order = np.argsort(x[at, f], kind="stable")
                v, ones = x[at[order], f], np.cumsum(y[at[order]])
                k = np.arange(1, len(at))
                fine = (v[1:] > v[:-1]) & (k >= least) & (len(at) - k >= least)
                if not fine.any():
                    continue
                p, q = ones[:-1] / k, (ones[-1] - ones[:-1]) / (len(at) - k)
                impurity = np.where(fine, (k * p * (1 - p) + (len(at) - k) * q * (1 - q)) / len(at), 2.0)
                i = int(impurity.argmin())
                if impurity[i] < best[0]:
                    best = (float(impurity[i]), (f, float(v[i] + v[i + 1]) / 2))
            if best[1] is None:
                return me
            f, cut = best[1]
            low = x[at, f] <= cut
            nodes[me][:4] = [f, cut, grow(at[low], left_depth - 1), grow(at[~low], left_depth - 1)]
            return me

        grow(sample, depth)
        f, cut, a, b, value = zip(*nodes, strict=True)
        return np.array(f), np.array(cut), np.array(a), np.array(b), np.array(value)

    def scores(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for f, cut, a, b, value in self.trees:
            node = np.zeros(len(x), np.int64)
            while (inner := np.flatnonzero(f[node] >= 0)).size:
                at = node[inner]
                node[inner] = np.where(x[inner, f[at]] <= cut[at], a[at], b[at])
            total += value[node]
        return total / len(self.trees)


def trained(findings: list[tuple[str, str, str, str, int]] | None = None, **how) -> Forest:
    found = labelled_findings() if findings is None else findings
    return Forest(np.array([features(*f[:4]) for f in found]), np.array([f[4] for f in found], float), **how)


def candidates(raw: bytes) -> list[tuple[int, int, str]]:
    """(first byte, end, rule) of what may be a secret, in order and without overlaps; assigned values come first."""
    found = [(*m.span(1), "assigned") for m in ASSIGNED.finditer(raw)]
    taken, at = [(a, b) for a, b, _ in found], 0
    for m in RUN.finditer(raw):
        value = m[0]
        # a run without a digit, and without capitals after its first letter, is a word or a rule of signs
        if not any(48 <= c <= 57 for c in value) and not any(65 <= c <= 90 for c in value[1:]) or value.isupper() and value.isalpha():
            continue
        while at < len(taken) and taken[at][1] <= m.start():  # both are in order
            at += 1
        if at == len(taken) or m.end() <= taken[at][0]:
            found.append((*m.span(), "run"))
    return sorted(found)


def scan(texts: list[bytes], paths: list[str], forest: Forest) -> list[list[tuple[int, int, str, float]]]:
    """(first byte, end, rule, score) of each text's candidates."""
    places, x, of = [candidates(t) for t in texts], [], []
    n = 0
    for t, path, found in zip(texts, paths, places, strict=True):
        for a, b, _ in found:
            for end in (b, a + LONG) if b - a > LONG else (b,):
                beside = t[max(0, a - BESIDE) : a].decode("utf-8", "replace"), t[end : end + BESIDE].decode("utf-8", "replace")
                x.append(features(t[a:end].decode("utf-8", "replace"), *beside, path))
                of.append(n)
            n += 1
    best = np.zeros(n)
    if x:
        np.maximum.at(best, of, forest.scores(np.array(x)))
    scores = iter(best.tolist())
    return [[(*p, next(scores)) for p in found] for found in places]


@lru_cache(2)
def _forest(blob: bytes) -> Forest:
    return pickle.loads(blob)


FINDINGS = "doc_id long, start long, length long, rule string, score double, is_secret boolean, digest string"


def _batch_scan(batch, text, path, blob):
    texts = raw_texts(column(batch, text))
    paths = [p or "" for p in column(batch, path).cast(pa.string()).to_pylist()] if path else [""] * len(texts)
    return texts, scan(texts, paths, _forest(blob))


def scan_secrets(docs: DataFrame, forest: Forest | None = None, cut: float = 0.5, key: str = "doc_id", text: str = "text", path: str | None = "source") -> DataFrame:
    """One row per candidate: FINDINGS. start and length count bytes of the UTF-8 text; digest is the value's SHA-256.

    Null and empty texts have no candidates; a null key or path stays null or counts as empty; repeated rows give
    repeated findings; an empty table gives an empty result. Texts are scanned whole. The path column is optional.
    """
    blob = docs.sparkSession.sparkContext.broadcast(pickle.dumps(forest or trained()))
    path = path if path in docs.columns else None

    def scanned(batches):
        for batch in batches:
            texts, found = _batch_scan(batch, "t", "p", blob.value)
            at = [(k, *f) for k, fs in enumerate(found) for f in fs]
            yield rows(
                doc_id=column(batch, "d").cast(pa.int64()).take(pa.array([k for k, *_ in at], pa.int64())), start=pa.array([a for _, a, *_ in at], pa.int64()), length=pa.array([b - a for _, a, b, *_ in at], pa.int64()),
                rule=pa.array([r for *_, r, _ in at], pa.string()), score=pa.array([s for *_, s in at], pa.float64()), is_secret=pa.array([s >= cut for *_, s in at], pa.bool_()),
                digest=pa.array([hashlib.sha256(texts[k][a:b]).hexdigest() for k, a, b, *_ in at], pa.string()),
            )

    where = F.col(path).cast("string") if path else F.lit("")
    return docs.select(F.col(key).cast("long").alias("d"), F.col(text).alias("t"), where.alias("p")).mapInArrow(scanned, FINDINGS)


def redacted(docs: DataFrame, forest: Forest | None = None, cut: float = 0.5, text: str = "text", path: str | None = "source", mark: bytes = b"[SECRET]", n_chars: str | None = "n_chars") -> DataFrame:
    """docs with every secret replaced by a mark and n_chars, where there is such a column, counted anew. No row goes.

    Null and empty texts stay as they are; texts of any length are scanned whole; a null path counts as empty; repeated
    rows are redacted alike; an empty table gives an empty result; other columns may have any name and are passed on.
    """
    blob = docs.sparkSession.sparkContext.broadcast(pickle.dumps(forest or trained()))
    path = path if path in docs.columns else None
    n_chars = n_chars if n_chars in docs.columns else None

    def cleaned(batches):
        for batch in batches:
            texts, found = _batch_scan(batch, text, path, blob.value)
            old = column(batch, text).to_pylist()
            changed = np.zeros(len(old), bool)
            for k, fs in enumerate(found):
                parts, at = [], 0
                for a, b, _, s in fs:
                    if s >= cut:
                        parts += [texts[k][at:a], mark]
                        at = b
                if parts:
                    old[k] = b"".join([*parts, texts[k][at:]]).decode("utf-8", "replace")
                    changed[k] = True
            new = {text: pa.array(old, batch.schema.field(text).type)}
            if n_chars:
                before = column(batch, n_chars)
                new[n_chars] = pc.if_else(pa.array(changed), pa.array([len(t or "") for t in old], pa.int64()).cast(before.type), before)
            yield pa.RecordBatch.from_arrays([new.get(f.name, batch.column(i)) for i, f in enumerate(batch.schema)], schema=batch.schema)

    return docs.mapInArrow(cleaned, docs.schema)
