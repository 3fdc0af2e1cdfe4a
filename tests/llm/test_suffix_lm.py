import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from evigraph.llm import queries, suffix_lm

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def tokens(text):
    return [*WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or "")), ""]


def base(rows):
    """doc_id, text -> what the base columns are."""
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1
    c = Counter(w for i, t in rows if not held(i) for w in tokens(t))
    n, v = sum(c.values()), len(c)
    below = n + 0.5 * (v + 1)
    return [(held(i), len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), n, sum(math.log10((c[w] + 0.5) / below) for w in tokens(t))) for i, t in rows]


def same(got, want):
    assert got[:4] == want[:4] and got[4] == pytest.approx(want[4], rel=1e-9)


def row(r):
    return r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]


def test_query_on_whole_table(spark, small):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    want = dict(zip((i for i, _ in rows), base(rows), strict=True))
    got = queries.op8_suffix_lm(spark, small).collect()
    assert len(got) == len(rows)
    for r in got:
        same(row(r), want[r["doc_id"]])
    held = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)  # contexts help on texts not trained on
    assert all(r["score"] < 0 for r in got)


def test_words_outside_the_head(spark, tiny):
    """Base columns do not depend on the head; the score is that of a root that knows the head's words only."""
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    a, b = ({r["doc_id"]: r for r in suffix_lm.score(docs, head=h).collect()} for h in (300_000, 200))
    frame = suffix_lm.text_frame(docs, suffix_lm.held_out(1).alias("held_out"))
    words = suffix_lm.root(suffix_lm.lexicon(frame), 200)[0].numbers.words
    assert 100 < len(words) <= 200
    want, _ = brute(rows, 3, 12, 0.05, {w.decode() for w in words})
    for i, r in a.items():
        same(row(b[i]), row(r))
        assert b[i]["score"] == pytest.approx(want[i], rel=1e-5)


def test_odd_texts(odd):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    got = suffix_lm.score(odd).collect()
    key = lambda x: str(x)
    assert sorted(((r["doc_id"], *row(r)[:4], round(r["base_score"], 6)) for r in got), key=key) == sorted(((i, *w[:4], round(w[4], 6)) for (i, _), w in zip(rows, base(rows), strict=True)), key=key)
    assert all(math.isfinite(r["score"]) and r["score"] <= 0 for r in got)

def brute(docs, depth, least_count, least_bits, head_words=None):
    """doc_id -> score by dictionaries, one context after the other; and the retained contexts."""
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 1
    texts = {i: tokens(t) for i, t in docs}
    n = Counter(w for i, t in texts.items() if not held(i) for w in t)
    below = sum(n.values()) + 0.5 * (len(n) + 1)
    inside = {w: c for w, c in n.items() if head_words is None or w in head_words or not w}
    rest = len(n) - len(inside) + 1
    other = (sum(n.values()) - sum(inside.values()) + 0.5 * rest) / below / rest
    after = {}
    for i, t in texts.items():
        for k, w in enumerate(t):
            for d in range(1, min(k, depth) + 1):
                if head_words is not None and t[k - d] not in head_words:
                    break  # contexts are made of head words
                own = after.setdefault(tuple(t[k - d : k]), Counter())
                if not held(i):
                    own[w] += 1
    kept = {}

    def p(context, w):
        if not context:
            return (inside[w] + 0.5) / below if w in inside else other
        if context not in kept:
            return p(context[1:], w)
        own = after[context]
        return (own[w] + len(own_seen := [x for x in own.values() if x]) * p(context[1:], w)) / (sum(own.values()) + len(own_seen))

    for context in sorted(after, key=len):
        own = {w: c for w, c in after[context].items() if c}
        total = sum(own.values())
        if total >= least_count and sum(c / total * math.log2(c / total / p(context[1:], w)) for w, c in own.items()) >= least_bits:
            kept[context] = True
    return {i: sum(math.log10(p(tuple(t[max(0, k - depth) : k]), w)) for k, w in enumerate(t)) for i, t in texts.items()}, kept


@pytest.mark.parametrize(("depth", "least_count", "part"), [(3, 12, 1 << 19), (3, 12, 1500), (2, 5, 400), (1, 30, 1 << 19)])
def test_score_against_dictionaries(spark, tiny, depth, least_count, part):
    """The second and third have hot contexts, of one word and of more, whose parts are several."""
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    want, kept = brute([(r["doc_id"], r["text"]) for r in docs.collect()], depth, least_count, 0.05)
    assert max(map(len, kept)) == min(depth, 3)
    got = {r["doc_id"]: r["score"] for r in suffix_lm.score(docs, depth=depth, least_count=least_count, part=part, least_part=1).collect()}
    assert got.keys() == want.keys()
    for i, s in got.items():
        assert s == pytest.approx(want[i], rel=1e-5), i


def test_hot_contexts_of_every_length(spark):
    """One text's passage is most of the table, so its contexts of one, two and three words are hot."""
    rows = [(i, "a b a b c " * 40 + f"word{i % 7} a b") for i in range(60)] + [(i, f"x{i} y z") for i in range(60, 90)] + [(90, "a"), (91, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want, _ = brute(rows, 3, 12, 0.05)
    for part in (50, 1000, 1 << 19):
        got = {r["doc_id"]: r["score"] for r in suffix_lm.score(docs, part=part, least_part=1).collect()}
        assert got == pytest.approx(want, rel=1e-5)


def test_distributions_sum_to_one(spark, tiny):
    """After any retained context, over all known words and one that is never seen."""
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()]
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 1
    x = [np.array([hash(w) % (1 << 31) for w in tokens(t)], np.uint32) for i, t in docs if not held(i)]
    words = np.unique(np.concatenate(x))
    h1 = np.concatenate([t[:-1] for t in x])
    s = np.concatenate([t[1:] for t in x])
    top = Counter(h1.tolist()).most_common(5)
    asked = np.append(words, 1 << 31).astype(np.uint32)
    for context, _ in top:
        h = [np.concatenate([h1, np.full(len(asked), context, np.uint32)])]
        w = np.concatenate([np.ones(len(h1)), np.zeros(len(asked))])
        p, kept = suffix_lm.probabilities(h, np.concatenate([s, asked]), lambda d, w=w: w, np.full(len(w), 1 / len(asked)), 12, 0.05)
        assert kept and p[len(h1) :].sum() == pytest.approx(1.0)


def test_empty_table(none):
    assert suffix_lm.score(none).collect() == []


def test_contexts_grow_with_the_input(spark, tiny, small):
    """A context stays retained however large the rest is, so more documents give more contexts."""

    def contexts(d):
        docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
        return len(brute(docs, 2, suffix_lm.LEAST_COUNT, suffix_lm.LEAST_BITS)[1])

    assert contexts(small) > 2 * contexts(tiny)


def test_very_long_text(spark):
    docs = spark.createDataFrame([(2, "lorem ipsum " * 400_000), (3, "x" * 2_000_000), (4, " " * 2_000_000)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in suffix_lm.score(docs).collect()}
    assert got[2]["n_tokens"] == 800_001 and got[3]["n_tokens"] == 2 and got[4]["n_tokens"] == 1
    assert all(math.isfinite(r["score"]) for r in got.values())


def test_held_out_texts_change_no_training_score(spark, tiny):
    """A head smaller than the vocabulary is chosen by training texts alone."""
    docs = spark.read.parquet(f"{tiny}/documents.parquet").select("doc_id", "text")
    out = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 1
    other = docs.withColumn("text", F.when(out, F.repeat(F.concat(F.lit("zebra quagga "), F.substring("text", 1, 40), F.lit(" ")), 300)).otherwise(F.col("text")))
    a, b = ({r["doc_id"]: r["score"] for r in suffix_lm.score(d, head=500).where("not held_out").collect()} for d in (docs, other))
    assert len(a) > 100 and a == pytest.approx(b, rel=1e-6)  # parts sum in 4-byte floats


@pytest.mark.parametrize(("at_hand", "depth", "least_count", "part"), [(200, 3, 12, 1 << 19), (0, 3, 12, 1500), (30, 3, 5, 400), (2000, 2, 1, 1 << 19)])
def test_words_at_hand_change_no_result(spark, tiny, at_hand, depth, least_count, part):
    """Words that do not go to every task are in contexts, and have probabilities, like any other."""
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    want, kept = brute(rows, depth, least_count, 0.05)
    frame = suffix_lm.text_frame(docs, suffix_lm.held_out(1).alias("held_out"))
    own = suffix_lm.root(suffix_lm.lexicon(frame), at_hand, True, least_count, part, 1)[0]
    assert own.others and any(w.encode() not in own.numbers.head for c in kept for w in c)
    got = suffix_lm.score(docs, depth=depth, least_count=least_count, part=part, least_part=1, at_hand=at_hand).collect()
    for r, w in zip(sorted(got, key=lambda r: r["doc_id"]), base(sorted(rows)), strict=True):
        same(row(r), w)
        assert r["score"] == pytest.approx(want[r["doc_id"]], rel=1e-5)


def test_words_at_hand_with_hot_contexts_of_every_length(spark):
    """Also with a word of most held-out texts that training texts do not have, which is at hand for its many tokens."""
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 1
    rows = [(i, ("zebra q " * 90 if held(i) else "a b a b c " * 40) + f"word{i % 7} a b rare{i % 3} x") for i in range(60)] + [(i, f"x{i} y z") for i in range(60, 90)] + [(90, "a"), (91, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want, _ = brute(rows, 3, 12, 0.05)
    for part in (50, 1000):
        got = {r["doc_id"]: r["score"] for r in suffix_lm.score(docs, part=part, least_part=1, at_hand=2).collect()}
        assert got == pytest.approx(want, rel=1e-5)


def test_more_words_than_any_task_holds(spark):
    """About 400,000 training words without a frequent context: each has the base probability, and so has one never seen."""
    rows = [(i, " ".join([*(f"w{i * 900 + k}" for k in range(900)), *(f"v{i // 2 * 600 + k}" for k in range(600))])) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    got = suffix_lm.score(docs).collect()
    assert len(got) == 400 and sum(r["n_tokens"] - r["n_known"] for r in got if r["held_out"]) > 40_000
    assert all(r["score"] == pytest.approx(r["base_score"], rel=1e-6) for r in got)


def test_hot_contexts_know_their_strings_counts(spark):
    """After a the words are as frequent as anywhere, so a is retained only if their counts are missing."""
    rows = [(i, " ".join(f"a w{(i * 7 + k) % 100}" for k in range(40))) for i in range(80)]
    want, kept = brute(rows, 1, 12, 1.5)
    assert ("a",) not in kept
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["score"] for r in suffix_lm.score(docs, depth=1, least_bits=1.5, part=200, least_part=1, at_hand=1).collect()}
    assert got == pytest.approx(want, rel=1e-5)


def test_only_distinct_words_are_looked_up(monkeypatch):
    """A word that comes again in a chunk costs no second look."""
    asked = []

    class Spy(suffix_lm.Numbers):
        def __getitem__(self, word):
            asked.append(word)
            return super().__getitem__(word)

    class Shared:
        def __init__(self, value):
            self.value = value

    digest = suffix_lm.xxhash.xxh64_intdigest
    monkeypatch.setattr(suffix_lm.xxhash, "xxh64_intdigest", lambda w, seed: asked.append(w) or digest(w, seed))
    own = suffix_lm.Root(Spy([b"a", b"b"]), np.ones(3, np.int64), np.ones(3), 0.1, 10.0, 5)
    layout = suffix_lm.Layout(1, 1, 10)
    layout.add(np.array([1], np.uint64), np.array([20]))
    texts = [f"a x{i % 3} B  x{i % 3}\n".encode() * 50 for i in range(20)]
    batches = [pa.RecordBatch.from_pydict({"text": pa.array(texts[k : k + 5], pa.binary()), "held_out": [False] * 5}) for k in range(0, 20, 5)]
    rows = [r for b in suffix_lm._hot_strings(Shared(own), Shared(layout), 1)(iter(batches)) for r in b.to_pylist()]
    number = [((1 << 63) | digest(f"x{k}".encode(), 42)) - (1 << 64) for k in range(3)]
    assert {(r["context"], r["s"]): r["n"] for r in rows} == {(0, number[0]): 350, (0, number[1]): 350, (0, number[2]): 300}
    assert len(asked) <= 6  # of 4,020 tokens


def test_tokens_are_those_of_split():
    rng = np.random.default_rng(8)
    for _ in range(300):
        texts = [bytes(rng.choice(list(b"aB \t\n\x0b\x0c\r\x00\x1c\xff\x85Z"), rng.integers(0, 9)).tolist()) for _ in range(rng.integers(1, 6))]
        for column in (pa.array(texts, pa.binary()), pa.array([b"x y", b"", *texts], pa.binary()).slice(2)):
            flat, lengths = suffix_lm._tokens(column)
            flat.validate(full=True)
            want = [[*t.lower().split(), b""] for t in texts]
            assert flat.to_pylist() == [w for t in want for w in t] and lengths.tolist() == [len(t) for t in want]
