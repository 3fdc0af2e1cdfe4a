"""Toxicity by weak supervision (operator 2).

Method: voters look at a text and say toxic, clean or nothing.

- Fixed lexicons of English abuse by theme: the mind, contempt, disgust, vulgar words.
- Lexicons of signs that training labels set apart, whatever the language: one for each of FOLDS disjoint parts of the
  labelled rows. A lexicon says nothing of the rows that it is made of. Signs are words and word beginnings of several
  lengths, once, twice or four times in a text.
- Patterns: the signs' summed log odds, abuse per 1000 words, abuse addressed to somebody, shouting with abuse, abuse of
  several kinds, a text without any sign.

A generative label model over the votes, with a tree of the strongest correlations between voters given the class,
estimates by expectation-maximisation how accurate each voter is. Training labels count for its estimates where they
are known; they are no votes. The posteriors, made of votes alone, label a sample of training rows, with and without
labels, and a linear classifier (logistic regression over the signs, scaled by log-count ratios) learns from them and
scores every text.

Labels come only from rows that are not held out, at most ``max_labelled`` of them, and the classifier also learns from
at most ``max_unlabelled`` rows without labels (both: those with the smallest hashes of their doc_id). Votes are counted
over all documents that are not held out. Every text, however long, is scored whole.

Null and empty texts have no signs and score by the bias. Repeated rows score alike; a doc_id with several labels trains
on its largest, one with several texts on the smallest. A score equal to the threshold is toxic. Without labels of both
classes no sign is known, and every score is the share of toxic labels (0.05 for none). An empty table gives no rows;
other columns of docs, whatever their names, are not read.
"""

from __future__ import annotations

import zlib
from collections import Counter
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Batches, discard, held_out, small_batches, text_frame, written
from .linear import Sparse, log_count_ratios, logistic, sigmoid_fit

TERMS = 1 << 22
#: A term is a sign when a text has it so many times; sign numbers are 3 * term + position.
TIMES = (1, 2, 4)
MAX_LABELLED, MAX_UNLABELLED = 12_000, 6_000
#: Signs that are kept, those that a lexicon is made of at most, and the parts of the labelled rows.
MOST_SIGNS, MOST_TERMS, FOLDS = 6000, 120, 3
BEGINNINGS = range(3, 9)
#: Likelihood ratios (chi-square of one degree) that a sign must have, for the classifier and for a lexicon: by chance
#: one of 200 and one of some millions pass.
WEAK, STRONG = 8.0, 26.0
#: A lexicon's sign is so many times as frequent in toxic rows as in others.
PURE = 60
#: Common English abuse by theme.
LEXICONS = (
    "cretin dimwit dumb dumbass dunce fool halfwit idiot idiotic imbecile lunatic moron moronic nitwit retard stupid twit",
    "clown coward crap failure freak jerk liar loser pathetic sucker useless wimp worthless",
    "creep disgusting filth garbage pig rat scum scumbag sick trash ugly vermin vile",
    "arse ass asshole bastard bitch bullshit damn prick psycho shit",
)
INSULTS = {w: k for k, words in enumerate(LEXICONS) for w in words.split()}
ADDRESSED = frozenset("you your youre you're u ur du dein ihr tu toi vous ton eres te vosotros".split())
_EDGES = "".join(chr(b) for b in range(33, 127) if not chr(b).isalnum())


def _numbers(word: str) -> tuple[int, ...]:
    """A word's terms: itself without signs at its ends, and its beginnings."""
    plain = word.strip(_EDGES)
    if not plain:
        return ()
    return zlib.crc32(plain.encode()) % TERMS, *[zlib.crc32(plain[:n].encode(), n) % TERMS for n in BEGINNINGS if len(plain) >= n]


class _Terms(dict):
    """Word -> numbers of those of its terms that are wanted (None: all), and _INSULT + theme for abuse; bounded."""

    def __init__(self, wanted: frozenset[int] | None):
        super().__init__()
        self.wanted = wanted

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= 400_000:
            self.clear()
        x = _numbers(word)
        if self.wanted is not None:
            x = tuple(t for t in x if t in self.wanted)
        if (k := INSULTS.get(word.strip(_EDGES))) is not None:
            x += (_INSULT + k,)
        self[word] = x
        return x


_INSULT = 1 << 40


class Read:
    """What voters and the classifier see of a text: its signs' numbers, and what the patterns need."""

    def __init__(self, text: bytes, terms: _Terms):
        words = text.decode("utf-8", "replace").lower().split()
        count = Counter(chain.from_iterable(map(terms.__getitem__, words)))
        self.n_words, self.addressed = len(words), False
        self.themes = [count.pop(_INSULT + k, 0) for k in range(len(LEXICONS))]
        self.insults = sum(self.themes)
        self.signs = np.array(sorted(3 * t + k for t, n in count.items() for k, least in enumerate(TIMES) if n >= least), np.int64)
        if self.insults:
            you = [i for i, w in enumerate(words) if w.strip(_EDGES) in ADDRESSED]
            self.addressed = any(w.strip(_EDGES) in INSULTS for i in you for w in words[max(0, i - 3) : i + 4])
        self.shouts = text.count(b"!")


class Signs:
    """The signs kept: sorted numbers, log odds, and a bit for each fold whose lexicon has it. toxic, clean: bounds of the summed log odds."""

    def __init__(self, numbers: np.ndarray, odds: np.ndarray, folds: np.ndarray):
        order = np.argsort(numbers)
        self.numbers, self.odds, self.folds = numbers[order], odds[order], folds[order]
        self.toxic, self.clean = 1.0, -1.0
        self.terms = _Terms(frozenset((self.numbers // 3).tolist()))

    def __reduce__(self):
        return _signs_of, (self.numbers, self.odds, self.folds, self.toxic, self.clean)

    def read(self, text: bytes) -> Read:
        return Read(text, self.terms)

    def of(self, read: Read) -> np.ndarray:
        """Positions of the text's signs."""
        if not len(self.numbers):
            return np.empty(0, np.int64)
        at = np.minimum(np.searchsorted(self.numbers, read.signs), len(self.numbers) - 1)
        return at[self.numbers[at] == read.signs]


def _signs_of(numbers, odds, folds, toxic, clean) -> Signs:
    out = Signs(numbers, odds, folds)
    out.toxic, out.clean = toxic, clean
    return out


def votes(read: Read, at: np.ndarray, signs: Signs, own_fold: int = -1) -> str:
    """1 toxic, 0 clean, 2 nothing, for each voter: themes, folds' lexicons, summed odds, density, addressed, shouting, several kinds, no sign."""
    folds = signs.folds[at]
    strong = int((folds > 0).sum()) + read.insults
    total = float(signs.odds[at].sum())
    out = ["1" if n else "2" for n in read.themes]
    out += ["1" if k != own_fold and (folds >> k & 1).any() else "2" for k in range(FOLDS)]
    out.append("1" if total >= signs.toxic else "0" if total <= signs.clean else "2")
    out.append("1" if strong and 100 * strong >= read.n_words else "0" if not strong and read.n_words >= 20 else "2")
    out.append("1" if read.addressed else "2")
    out.append("1" if strong and 20 * read.shouts > read.n_words else "2")
    out.append("1" if sum(n > 0 for n in read.themes) + len(np.unique(folds[folds > 0])) > 1 else "2")
    out.append("2" if strong else "0")
    return "".join(out)


class LabelModel:
    """Class-conditional votes along a tree: each voter depends on the class and on one other voter at most.

    patterns: rows of votes; unlabelled, clean, toxic: how many documents voted so, by what is known of their class.
    Where the class is known it counts for the estimates, elsewhere the posterior does. Documents without labels weigh as
    much as those with labels at most, or the model would explain the language of most texts rather than their toxicity;
    without any labels they weigh what they are. The posteriors are those of the votes alone.
    """

    def __init__(self, patterns: np.ndarray, unlabelled: np.ndarray, clean: np.ndarray, toxic: np.ndarray, rounds: int = 80):
        self.parent = [-1] * patterns.shape[1]
        known = clean.sum() + toxic.sum()
        open_ = unlabelled * (min(1.0, known / max(1.0, unlabelled.sum())) if known else 1.0)
        pro, con = (patterns == 1).sum(1), (patterns == 0).sum(1)
        guess = np.where((pro >= 2) & (pro > con), 0.9, 0.02)
        p = (toxic + 2 * guess) / (toxic + clean + 2)
        p = self._run(patterns, open_, clean, toxic, p, rounds)
        self._correlate(patterns, open_ * p + toxic, open_ * (1 - p) + clean)
        self.posterior = self._run(patterns, open_, clean, toxic, p, rounds)

    def _run(self, x: np.ndarray, open_: np.ndarray, clean: np.ndarray, toxic: np.ndarray, p: np.ndarray, rounds: int) -> np.ndarray:
        for _ in range(rounds):
            logs, every = np.zeros((2, len(x))), (open_ + clean + toxic).sum()
            for y, w in ((1, open_ * p + toxic), (0, open_ * (1 - p) + clean)):
                logs[y] += np.log((w.sum() + 1) / (every + 2))
                for i, j in enumerate(self.parent):
                    table = np.full((3, 3), 0.5)
                    other = x[:, j] if j >= 0 else np.zeros(len(x), int)
                    np.add.at(table, (other, x[:, i]), w)
                    logs[y] += np.log(table / table.sum(1, keepdims=True))[other, x[:, i]]
            new = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -40, 40)))
            done = np.abs(new - p).max() < 1e-6
            p = new
            if done:
                break
        return p

    def _correlate(self, x: np.ndarray, toxic: np.ndarray, clean: np.ndarray) -> None:
        """The maximum spanning tree of the voters' mutual information given the class; weak edges stay out."""
        m = x.shape[1]
        info = np.zeros((m, m))
        for w in (toxic, clean):
            for i in range(m):
                for j in range(i):
                    t = np.full((3, 3), 1e-9)
                    np.add.at(t, (x[:, i], x[:, j]), w)
                    t /= max(1e-9, (toxic + clean).sum())
                    info[i, j] += (t * np.log(t * t.sum() / (t.sum(1, keepdims=True) * t.sum(0)))).sum()
        info += info.T
        tree = {0}
        while len(tree) < m:
            _, i, j = max((info[i, j], -i, j) for i in range(m) if i not in tree for j in tree)
            if info[-i, j] > 1e-3:
                self.parent[-i] = j
            tree.add(-i)


def _labelled(docs: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """_id, _y, text: training rows, at most `most`, one for each id."""
    rows = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(0))
    rows = rows.groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.max(F.col("toxic").cast("int")).alias("_y"))
    rows = rows.orderBy(F.xxhash64("_id"), "_id").limit(most)
    own = _texts(docs).join(F.broadcast(rows), "_id")
    return own.groupBy("_id", "_y").agg(F.min("text").alias("text"))


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("_id"), F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"))


def _fold(ids: np.ndarray) -> np.ndarray:
    """A labelled row's part."""
    return np.array([zlib.crc32(str(i).encode(), 1) % FOLDS for i in ids.tolist()], np.int64)


def _signs(labelled: DataFrame) -> tuple[Signs, float]:
    """The signs that the labels set apart best, and the share of toxic rows."""
    names = [f"{c}{k}" for k in range(FOLDS) for c in ("toxic", "clean")]

    def run(batches: Batches) -> Batches:
        every_term = _Terms(None)
        for b in batches:
            kind = 2 * _fold(b.column("_id").to_numpy()) + 1 - np.array(b.column("_y").to_pylist(), np.int64).clip(0, 1)
            x = Sparse([Read(t, every_term).signs for t in b.column("text").to_pylist()])
            numbers, at = np.unique(x.index, return_inverse=True)
            counts = [np.bincount(at, kind[x.row] == k, len(numbers)).astype(np.int64) for k in range(2 * FOLDS)]
            yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), *map(pa.array, counts)], names=["sign", *names])

    totals = labelled.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.least("_y", F.lit(1))), F.lit(0)).alias("t")).first()
    n, t = totals["n"], totals["t"]
    if not t or t == n:
        return Signs(np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64)), t / n if n else 0.05
    counts = labelled.mapInArrow(run, "sign long, " + ", ".join(f"{c} long" for c in names)).groupBy("sign").agg(*[F.sum(c).alias(c) for c in names])
    plus = lambda c: sum((F.col(f"{c}{k}") for k in range(1, FOLDS)), F.col(f"{c}0"))
    toxic, clean, share = plus("toxic"), plus("clean"), t / n
    part = lambda c, of: F.when(c > 0, c * F.log(c / of)).otherwise(0.0)

    def gain(a, b):
        """The likelihood ratio of the sign's own share of toxic rows against everybody's."""
        return 2 * (part(a, (a + b) * share) + part(b, (a + b) * (1 - share)))

    odds = F.log((toxic + 0.5) / (t + 1.0) / ((clean + 0.5) / (n - t + 1.0)))
    own = [F.when(F.col(f"toxic{k}") * (n - t) > PURE * F.col(f"clean{k}") * t, gain(F.col(f"toxic{k}"), F.col(f"clean{k}"))).otherwise(0.0).alias(f"gain{k}") for k in range(FOLDS)]
    best = counts.where(toxic + clean >= 3).select("sign", odds.alias("odds"), gain(toxic, clean).alias("gain"), *own).where(f"gain > {WEAK}")
    got = best.orderBy(F.col("gain").desc(), "sign").limit(MOST_SIGNS).toPandas()
    folds = np.zeros(len(got), np.int64)
    for k in range(FOLDS):
        g = got[f"gain{k}"].to_numpy(float)
        strong = np.lexsort((got["sign"], -g))[:MOST_TERMS]
        folds[strong[g[strong] > STRONG]] |= 1 << k
    return Signs(got["sign"].to_numpy(np.int64), got["odds"].to_numpy(float), folds), share


class Model:
    """Signs with the classifier's weights, bias, and the sigmoid's two numbers."""

    def __init__(self, signs: Signs, w: np.ndarray, bias: float, scale: np.ndarray, a: float, b: float):
        self.signs, self.w, self.bias, self.squares, self.a, self.b = signs, w * scale, bias, scale * scale, a, b

    def margin(self, at: np.ndarray) -> float:
        return float(self.w[at].sum()) / max(1e-5, float(np.sqrt(self.squares[at].sum()))) + self.bias

    def score(self, text: bytes) -> float:
        z = self.a * self.margin(self.signs.of(self.signs.read(text))) + self.b
        return float(1 / (1 + np.exp(-max(-30.0, min(30.0, z)))))


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, max_unlabelled: int = MAX_UNLABELLED) -> Model:
    small_batches(docs.sparkSession)
    labelled = written(_labelled(docs, labels, max_labelled), "toxic-labelled")
    try:
        return _train(docs, labelled, max_unlabelled)
    finally:
        discard(labelled)


def _train(docs: DataFrame, labelled: DataFrame, max_unlabelled: int) -> Model:
    context = docs.sparkSession.sparkContext
    signs, share = _signs(labelled)
    if not len(signs.numbers):
        share = min(max(share, 1e-3), 1 - 1e-3)
        return Model(signs, np.empty(0), 0.0, np.empty(0), 0.0, float(np.log(share / (1 - share))))
    kept = context.broadcast(signs)  # MOST_SIGNS at most

    def sums(batches: Batches) -> Batches:
        for b in batches:
            total = [float(kept.value.odds[kept.value.of(kept.value.read(t))].sum()) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("_y"), pa.array(total, pa.float64())], names=["_y", "total"])

    rows = labelled.mapInArrow(sums, "_y int, total double").toPandas()  # max_labelled rows
    toxic, clean = rows["total"][rows["_y"] > 0].to_numpy(), rows["total"][rows["_y"] <= 0].to_numpy()
    signs.toxic, signs.clean = float(np.quantile(clean, 0.99)), float(np.quantile(toxic, 0.02))
    signs.clean = min(signs.clean, float(np.quantile(clean, 0.9)), signs.toxic)
    voters = context.broadcast(signs)

    def ballot(batches: Batches) -> Batches:
        for b in batches:
            counts = Counter(votes(r := voters.value.read(t), voters.value.of(r), voters.value) for t in b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["votes", "n"])

    def look(batches: Batches) -> Batches:
        """Votes and signs of a row; a labelled one hears nothing from its own part's lexicon."""
        for b in batches:
            fold = np.where([y is None for y in b.column("_y").to_pylist()], -1, _fold(b.column("_id").to_numpy()))
            reads = [voters.value.read(t) for t in b.column("text").to_pylist()]
            at = [voters.value.of(r) for r in reads]
            own = [votes(r, x, voters.value, k) for r, x, k in zip(reads, at, fold.tolist(), strict=True)]
            packed = [x.astype(np.int32).tobytes() for x in at]
            yield pa.RecordBatch.from_arrays([b.column("_id"), b.column("_y"), pa.array(own, pa.string()), pa.array(packed, pa.binary())], names=["_id", "_y", "votes", "x"])

    training = text_frame(docs, held_out(0).alias("out")).where("not out").select("text")
    polled = training.mapInArrow(ballot, "votes string, n long").groupBy("votes").agg(F.sum("n").alias("n")).toPandas()  # patterns, not documents
    schema = "_id long, _y int, votes string, x binary"
    # a share of all ids by their hash, so that few more than max_unlabelled texts are read by Python
    share = min(1.0, 1.2 * max_unlabelled / max(1, int(polled["n"].sum())))
    below = F.lit(int((share - 0.5) * (1 - 1e-9) * 2**64))
    sample = _texts(docs).where(F.col("_id").isNotNull() & ~held_out(0, column="_id") & (F.xxhash64("_id", F.lit(1)) < below))
    sample = sample.join(labelled.select("_id"), "_id", "left_anti").select("_id", F.lit(None).cast("int").alias("_y"), "text")
    sample = sample.mapInArrow(look, schema).groupBy("_id", "_y").agg(F.min(F.struct("votes", "x")).alias("r")).select("_id", "_y", "r.*").orderBy(F.xxhash64("_id", F.lit(1)), "_id").limit(max_unlabelled)
    got = pd.concat([labelled.mapInArrow(look, schema).toPandas().sort_values("_id"), sample.toPandas()], ignore_index=True)

    known = got.dropna(subset="_y").groupby("votes")["_y"].agg(n="count", toxic="sum")
    every = polled.groupby("votes")["n"].sum().reindex(sorted({*polled["votes"], *got["votes"]}), fill_value=0)
    known = known.reindex(every.index, fill_value=0)
    unlabelled = (every - known["n"]).clip(lower=0).to_numpy(float)
    model = LabelModel(np.array([[int(c) for c in v] for v in every.index]), unlabelled, (known["n"] - known["toxic"]).to_numpy(float), known["toxic"].to_numpy(float))
    posterior = dict(zip(every.index, model.posterior.tolist(), strict=True))
    x = Sparse([np.frombuffer(bytes(r), np.int32).astype(np.int64) for r in got["x"]])
    return _classifier(signs, x, got["votes"].map(posterior).to_numpy(float))


def _classifier(signs: Signs, x: Sparse, target: np.ndarray) -> Model:
    size = len(signs.numbers)
    scale = log_count_ratios(x, size, target)
    w, bias = logistic(x, scale, target)
    model = Model(signs, w, bias, scale, 1.0, 0.0)
    z = np.array([model.margin(x.index[a:b]) for a, b in zip(x.start, x.start[1:], strict=False)])
    model.a, model.b = sigmoid_fit(z, target)
    return model


def classify(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs. labels: doc_id, toxic."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, max_labelled))  # MOST_SIGNS weights

    def run(batches: Batches) -> Batches:
        for b in batches:
            s = [shared.value.score(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(s, pa.float64())], names=["doc_id", "held_out", "score"])

    frame = text_frame(docs, held_out(0).alias("held_out"))
    kind = frame.schema["doc_id"].dataType.simpleString()
    scored = frame.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_clean(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, threshold: float = 0.5) -> DataFrame:
    """The rows of docs that score below the threshold, in one pass over whole rows."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, max_labelled))
    at = docs.columns.index("text")

    def run(batches: Batches) -> Batches:
        for b in batches:
            clean = [shared.value.score((t or "").encode()) < threshold for t in b.column(at).to_pylist()]
            yield b.filter(pa.array(clean, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
