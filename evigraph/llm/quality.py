"""Quality classifier (operator 7).

Method: naive Bayes support vectors. Indicators of n-grams - words and pairs of words, characters inside words, and word
shapes with the n-gram's share of the text in powers of two - are scaled by the class log-count ratios of the training
rows; a linear hinge-loss model over them is fitted by dual coordinate descent, and its margin is turned into a
probability on rows that the fit has not seen. Indicators are hashed to SIZE numbers.

Labels come only from rows that are not held out, at most ``max_labelled`` of them (those with the smallest hashes of
their doc_id); every text, however long, is scored whole. Null and empty texts have no n-grams and score by the bias.
Repeated rows score alike; a doc_id with several labels trains on its largest, one with several texts on the smallest. A
score equal to the threshold is good. If the labels have one class or none, every score is that class's share (0.5 for
none). An empty table gives no rows; other columns of docs, whatever their names, are not read.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Batches, WordHashes, held_out, mix, small_batches, text_frame, window_hashes
from .linear import Sparse, hinge_dual, log_count_ratios, sigmoid_fit

SIZE = 1 << 18
MAX_LABELLED = 6_000
LENGTHS = (1, 2, 3)
_RUNS = re.compile(rb"(.)\1+", re.S)
_KIND = bytes(
    0x41 if 0x41 <= b <= 0x5A else 0x61 if 0x61 <= b <= 0x7A else 0x30 if 0x30 <= b <= 0x39 else 0x75 if b >= 0x80 else b for b in range(256)
)


class _Shapes(WordHashes):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        shape = _RUNS.sub(rb"\1", word.translate(_KIND).replace(b"u", b"a"))
        self[word] = h = _plain[shape]
        return h


_plain, _shapes = WordHashes(), _Shapes()
CHARACTERS = 3


CHUNK = 50_000


def characters(words: list[bytes]) -> np.ndarray:
    """Numbers of the character n-grams of words, each with its two ends; several words at once."""
    found = []
    for at in range(0, len(words), CHUNK):
        part = words[at : at + CHUNK]
        b = np.frombuffer((b"^" + b"$^".join(part) + b"$").lower(), np.uint8).astype(np.uint32)
        h = np.zeros(len(b) - CHARACTERS + 1, np.uint32)
        for k in range(CHARACTERS):
            h = h * np.uint32(257) + b[k : k + len(h)]  # below 2**25
        own = np.ones(len(b), bool)
        ends = np.cumsum(np.fromiter(map(len, part), np.int64, len(part)) + 2)
        for k in range(1, CHARACTERS):
            own[ends - k] = False  # these would run into the next word
        found.append(np.unique(h[own[: len(h)]]))
    h = np.concatenate(found).astype(np.uint64)
    return (mix(h + np.uint64(1 << 40)) % np.uint64(SIZE)).astype(np.int64)


def features(text: bytes) -> np.ndarray:
    """Sorted feature numbers of a text."""
    words = text.split()
    if not words:
        return np.empty(0, np.int64)
    shape, word = _shapes.of(words), _plain.of(words)
    # streams of symbols: shapes; whether a word, pair, triple and line has been there before
    streams = [window_hashes(shape, n) for n in LENGTHS]
    streams.append(mix((word[1:] == word[:-1]).astype(np.uint64) + np.uint64(11)))
    for n in (2, 3, 6):
        w = window_hashes(word, n)
        fresh = np.zeros(len(w), np.uint64)
        fresh[np.unique(w, return_index=True)[1]] = 1
        streams.append(mix(fresh + np.uint64(100 * n)))
    lines = _plain.of(text.split(b"\n"))
    fresh = np.zeros(len(lines), np.uint64)
    fresh[np.unique(lines, return_index=True)[1]] = 1
    streams.append(mix(fresh + np.uint64(1000)))
    out = []
    for k, s in enumerate(streams):
        grams, counts = np.unique(s, return_counts=True)
        share = np.floor(np.log2(counts / max(1, len(s))) + 1e-9).astype(np.int64)
        own = mix(grams + np.uint64(k * 7919 + 13))
        out += [own, mix(own + share.astype(np.uint64))]
    out += [mix(word + np.uint64(3)), mix(window_hashes(word, 2) + np.uint64(5))]
    cells = (np.concatenate(out) % np.uint64(SIZE)).astype(np.int64)
    return np.unique(np.concatenate([cells, characters(list(set(words)))]))


def labelled_features(docs: DataFrame, labels: DataFrame, label: str, most: int, extract) -> tuple[list[np.ndarray], np.ndarray]:
    """Features and labels of the training rows: at most `most`, so the broadcast and what comes to the driver are bounded."""
    rows = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(0))
    rows = rows.groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.max(F.col(label).cast("int")).alias("_y"))
    rows = rows.orderBy(F.xxhash64("_id"), "_id").limit(most)
    small_batches(docs.sparkSession)
    own = docs.select(F.col("doc_id").cast("long").alias("_id"), F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"))
    own = own.join(F.broadcast(rows), "_id").groupBy("_id", "_y").agg(F.min("text").alias("text"))

    def run(batches: Batches) -> Batches:
        for b in batches:
            x = [extract(t).astype(np.int32).tobytes() for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("_id"), b.column("_y"), pa.array(x, pa.binary())], names=["_id", "_y", "x"])

    got = own.mapInArrow(run, "_id long, _y int, x binary").toPandas().sort_values("_id")
    return [np.frombuffer(x, np.int32) for x in got["x"]], got["_y"].to_numpy().astype(float)


class Model:
    """Weights, bias, and the sigmoid's two numbers."""

    def __init__(self, w: np.ndarray, bias: float, a: float, b: float):
        self.w, self.bias, self.a, self.b = w, bias, a, b

    def score(self, x: np.ndarray, scale: np.ndarray) -> float:
        v = scale[x]
        z = float(self.w[x] @ v) / max(1e-9, float(np.sqrt(v @ v))) + self.bias
        return 1 / (1 + np.exp(-max(-30.0, min(30.0, self.a * z + self.b))))


def fit(rows: list[np.ndarray], y: np.ndarray) -> tuple[Model, np.ndarray]:
    if len(set(y.tolist())) < 2:
        share = float(y.mean()) if len(y) else 0.5
        return Model(np.zeros(SIZE), 0.0, 0.0, float(np.log((share + 1e-9) / (1 - share + 1e-9)))), np.zeros(SIZE)
    test = np.arange(len(y)) % 5 == 0
    if len(set(y[~test].tolist())) < 2 or not test.any():
        test[:] = False
    x, t = Sparse([r for r, out in zip(rows, test, strict=True) if not out]), y[~test]
    ratios = log_count_ratios(x, SIZE, t)
    share = t.mean()
    cost = np.where(t > 0.5, 0.5 / share, 0.5 / (1 - share))
    w, bias = hinge_dual(x, ratios, np.where(t > 0.5, 1.0, -1.0), cost)
    model = Model(w, bias, 1.0, 0.0)
    used = test if test.any() else ~test
    z = np.array([np.log(max(p, 1e-12) / max(1 - p, 1e-12)) for p in (model.score(r, ratios) for r, u in zip(rows, used, strict=True) if u)])
    model.a, model.b = sigmoid_fit(z, y[used])
    return model, ratios


def classify(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs. labels: doc_id, quality."""
    model, ratios = fit(*labelled_features(docs, labels, "quality", max_labelled, features))
    shared = docs.sparkSession.sparkContext.broadcast((model, ratios))  # 2 * SIZE numbers

    def run(batches: Batches) -> Batches:
        model, ratios = shared.value
        for b in batches:
            s = [model.score(features(t), ratios) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(s, pa.float64())], names=["doc_id", "held_out", "score"])

    frame = text_frame(docs, held_out(0).alias("held_out"))
    kind = frame.schema["doc_id"].dataType.simpleString()
    scored = frame.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
