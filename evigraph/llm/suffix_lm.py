"""LM scoring with a probabilistic suffix tree (operator 8).

Texts are sequences of words (A-Z lowered), each a token, and an end token. The tree predicts a token from the 0 to
``depth`` words before it in its text.

Method: a probabilistic suffix tree.

1. The lexicon: every word's count over all documents, and over the training ones, a table in the shared folder. It
   gives the base score's counts and the empty context's distribution, the base probability of every word.
2. A context is retained if ``least_count`` training tokens follow it, whatever the size of the input, and the
   divergence of its next-word distribution from that of its longest retained suffix is at least ``least_bits``. Its
   distribution is interpolated with the suffix's, weighed by its number of distinct next words.
3. Positions (a token with the words before it) go to the part of the tree that their last word belongs to, in one
   shuffle of packed columns: each task counts, tests and smooths the contexts of its part, longest last, and scores
   its positions by their longest retained context. So the tree grows with the input and is never in one place; what
   goes back is each document's sum.
4. A word before more than ``part`` tokens would overfill its part. Strings after such a hot context are counted by an
   aggregation with partial sums and sent to the context's several parts, over which positions are dealt by the next
   word before, or by where they come from if there is none. The same holds for hot contexts of two words or more.
5. The ``at_hand`` words most frequent in training texts, and those that hot contexts may hold, go to every task with
   their counts. Of the others, each part gets the counts of those among its tokens by a join with the lexicon, and
   contexts hold them like any word. Two bit maps of fixed size spare work where they can: a word whose bit is not set
   has fewer than ``least_count`` training tokens, so no retained context, and ends the context of the tokens after it;
   or it has at most one, so exactly one if it is a training token. Words that share a bit cost work, and change nothing:
   neither they nor which words are at hand change a result.

Words are numbers to the tree: the rank of a word at hand, a 63-bit hash of any other one. With ``head``, a model of a
limited vocabulary is made instead: contexts are of the ``head`` most frequent training words alone, a word outside ends
the context of the tokens after it, and all words outside, seen or not, have equal shares of what the head's leave of the
empty context's distribution.

Null and empty texts are the end token alone. A token with no context word before it has the empty context's probability.
Very long texts are cut nowhere; repeated rows score alike and train as often as they come; ties do not
occur; a null doc_id counts as empty text for the split. Without training documents all counts are 0, the base score is
that of its formula, and the model's score is 0, for its one outcome is a word never seen. An empty table gives no rows.
Other columns of docs, whatever their names, are not read.
"""

from __future__ import annotations

import io
import math
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, Batches, discard, held_out, mix, row_numbers, text_frame, written

DEPTH = 3
#: Most frequent words that go to every task.
AT_HAND = 300_000
#: Training tokens that follow a retained context at least, at any size of the input, and its divergence.
LEAST_COUNT, LEAST_BITS = 12, 0.05
#: Positions of a part of the tree. Small inputs have LEAST_PARTS of LEAST_PART positions at least; with MOST_PARTS, parts grow.
PART, LEAST_PARTS, LEAST_PART, MOST_PARTS = 1 << 19, 128, 1 << 14, 1 << 16
CHUNK, CHUNK_DOCS = 1 << 20, 30_000
END = b""
NONE = np.uint32(0xFFFFFFFF)
#: Numbers of words that are not at hand start here; hashes have the highest bit.
TAIL = 1 << 20
_HASH, _SEED = 1 << 63, 42
#: 8-byte words of a bit map of hashes, and of its slices.
BITS, SLICE = 1 << 19, 1 << 13
_FLUSH = 400_000
_IN_WORD = bytes(c not in SPACE for c in range(256))
_HELD = 1 << 15
POSITIONS, STRINGS, COUNTS, DOCUMENTS = 0, 1, 2, 3
ROW = "key int, kind int, chunk long, payload binary"


def _tokens(text: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All texts' tokens, A-Z lowered, ends as empty words; the texts' lengths in tokens."""
    text = text.cast(pa.large_binary())
    offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
    ends = offsets[1:] - offsets[0]
    raw = text.buffers()[2].slice(offsets[0], ends[-1]).to_pybytes().lower() if ends[-1] else b""
    inside = np.frombuffer(raw.translate(_IN_WORD), bool)
    begins = np.zeros(len(raw) + 1, bool)
    begins[0] = begins[ends] = True
    begins[1:-1] |= ~inside[:-1]
    begins = begins[:-1] & inside
    to = np.searchsorted(np.flatnonzero(begins), ends)  # words up to each text's end
    packed = np.frombuffer(raw, np.uint8)[inside]
    starts = np.append(np.flatnonzero(begins[inside]), len(packed))
    starts = np.insert(starts, to, starts[to])
    flat = pa.Array.from_buffers(pa.large_binary(), len(starts) - 1, [None, pa.py_buffer(starts.astype(np.int64)), pa.py_buffer(packed)])
    return flat, np.diff(to, prepend=0) + 1


def _count_words(batches: Batches) -> Batches:
    """Words are counted by batch, then batches are summed."""
    held: list[tuple[pa.Array, np.ndarray, np.ndarray]] = []
    rows = 0

    def out() -> pa.RecordBatch:
        words = pa.concat_arrays([w for w, _, _ in held]).dictionary_encode()
        at = words.indices.to_numpy()
        n, m = (np.bincount(at, np.concatenate(c), len(words.dictionary)).astype(np.int64) for c in list(zip(*held, strict=True))[1:])
        return pa.RecordBatch.from_arrays([words.dictionary.cast(pa.binary()), pa.array(n), pa.array(m)], names=["word", "n", "m"])

    for b in batches:
        if not b.num_rows:
            continue
        flat, lengths = _tokens(b.column("text"))
        words = flat.dictionary_encode()
        at, away = words.indices.to_numpy(), np.repeat(np.array(b.column("held_out").to_pylist(), bool), lengths)
        held.append((words.dictionary, np.bincount(at[~away], minlength=len(words.dictionary)), np.bincount(at)))
        rows += len(words.dictionary)
        if rows > _FLUSH:
            yield out()
            held, rows = [], 0
    if rows:
        yield out()


def lexicon(frame: DataFrame) -> DataFrame:
    """word, n, m: counts over training texts and over all; the end token is the empty word."""
    counted = frame.select("text", "held_out").mapInArrow(_count_words, "word binary, n long, m long")
    return written(counted.groupBy("word").agg(F.sum("n").alias("n"), F.sum("m").alias("m")), "lm-lexicon")


def _grade(count: Column) -> Column:
    """Classes of counts: at most 16 * 64, whatever the input."""
    return F.floor(F.log2(count) * 16)


def _most_frequent(words: DataFrame, most: int) -> int:
    """The smallest class of training counts so that at most `most` words are in it or above."""
    classes = {r["grade"]: r["words"] for r in words.where("n > 0").groupBy(_grade(F.col("n")).alias("grade")).agg(F.count("*").alias("words")).collect()}
    least, taken = 1 << 20, 0
    for g in sorted(classes, reverse=True):
        taken += classes[g]
        if taken > most:
            break
        least = g
    return least


class Numbers:
    """Word -> number: 0 the end, then words at hand by rank, then hashes of others."""

    def __init__(self, words: list[bytes]):
        self.words = words
        self.ranks = pa.array([END, *words], pa.large_binary())

    @property
    def head(self) -> dict[bytes, int]:
        return {w: i + 1 for i, w in enumerate(self.words)} | {END: 0}

    def of(self, flat: pa.Array) -> np.ndarray:
        """Tokens' numbers. Only distinct words are looked up, and only those not at hand are hashed."""
        encoded = flat.dictionary_encode()
        found = pc.index_in(encoded.dictionary, value_set=self.ranks)
        numbers = found.fill_null(0).to_numpy().astype(np.uint64)
        other = encoded.dictionary.filter(found.is_null()).to_numpy(zero_copy_only=False)
        numbers[found.is_null().to_numpy(zero_copy_only=False)] = np.fromiter((_HASH | xxhash.xxh64_intdigest(w, _SEED) for w in other), np.uint64, len(other))  # as _hash()
        return numbers[encoded.indices.to_numpy()]

    def __reduce__(self):
        return Numbers, (self.words,)


def _hash(word: str) -> Column:
    return F.xxhash64(word).bitwiseOR(F.lit(-_HASH))


@dataclass
class Root:
    """The words' numbers, and by number of words at hand their counts and the empty context's probabilities.

    whole: all other words have their own probabilities, and tail_p is that of one never seen; else tail_p is each other
    one's. others: there are other words in training texts. frequent, twice: bit maps of those with least_count training
    tokens, and with two; all others may be missing.
    """

    numbers: Numbers
    count: np.ndarray
    p: np.ndarray
    tail_p: float
    below: float
    tokens: int
    whole: bool = False
    others: bool = False
    frequent: np.ndarray | None = None
    twice: np.ndarray | None = None

    def of(self, s: np.ndarray) -> np.ndarray:
        return np.where(s < len(self.p), self.p[np.minimum(s, len(self.p) - 1)], self.tail_p)

    def in_contexts(self, s: np.ndarray) -> np.ndarray:
        """Which words contexts hold; others end them."""
        out = s < TAIL
        if self.frequent is not None:
            other = np.flatnonzero(~out)
            out[other] = _has(self.frequent, s[other])
        return out


def _has(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    return (bits[(hashes >> np.uint64(6)) & np.uint64(BITS - 1)] >> (hashes & np.uint64(63)) & np.uint64(1)).astype(bool)


def _slices(least_counts: list[int]):
    def run(batches: Batches) -> Batches:
        maps: dict[int, np.ndarray] = {}
        for b in batches:
            part, at, n = (b.column(c).to_numpy() for c in ("slice", "at", "n"))
            for s in np.unique(part).tolist():
                bits = maps.setdefault(s, np.zeros((len(least_counts), SLICE * 64), bool))
                for k, c in enumerate(least_counts):
                    bits[k, at[(part == s) & (n >= c)]] = True
        for s, bits in maps.items():
            payload = zstandard.ZstdCompressor(1).compress(np.packbits(bits, axis=1, bitorder="little").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([payload], pa.binary())], names=["slice", "bits"])

    return run


def bit_maps(words: DataFrame, least_counts: list[int]) -> list[np.ndarray]:
    """For each count, a bit map of the hashes of the words with as many training tokens; its slices are made by tasks."""
    bit = _hash("word").bitwiseAND(F.lit(BITS * 64 - 1))
    rows = words.where(F.col("n") >= min(least_counts)).select((bit / (SLICE * 64)).cast("int").alias("slice"), (bit % (SLICE * 64)).cast("int").alias("at"), "n")
    out = [np.zeros(BITS, np.uint64) for _ in least_counts]
    for r in rows.repartition("slice").mapInArrow(_slices(least_counts), "slice int, bits binary").collect():  # BITS / SLICE rows
        bits = np.frombuffer(zstandard.ZstdDecompressor().decompress(bytes(r["bits"])), np.uint64).reshape(len(out), SLICE)
        for k, b in enumerate(out):
            b[r["slice"] * SLICE : (r["slice"] + 1) * SLICE] = bits[k]
    return out


def part_size(tokens: int, part: int = PART, least_part: int = LEAST_PART) -> int:
    return max(min(part, tokens // LEAST_PARTS), least_part, -(-tokens // MOST_PARTS))


def root(words: DataFrame, head: int, whole: bool = False, least_count: int = LEAST_COUNT, part: int = PART, least_part: int = LEAST_PART) -> tuple[Root, int, dict[int, int], int]:
    """The root, the least class of training counts at hand, counts of all texts by number at hand, and the sum of these counts.

    Which words are the head is decided by training texts alone; counts of all texts only size the parts of the tree. With
    whole, the words of more tokens than a part are at hand too: MOST_PARTS at most.
    """
    sums = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.when(F.col("n") > 0, 1)), F.lit(0)).alias("v"), F.coalesce(F.sum("m"), F.lit(0)).alias("m")).first()
    least = _most_frequent(words, head)
    at_hand = ((F.col("n") > 0) & (_grade(F.col("n")) >= least)) | (F.octet_length("word") == 0)
    most, maps = 0, [None, None]
    if whole:
        at_hand |= F.col("m") > part_size(sums["m"], part, least_part)
        most = words.where(~at_hand).agg(F.max("n")).first()[0] or 0
        if most:
            maps = bit_maps(words.where(~at_hand), [least_count, 2])
    top = words.where(at_hand).toPandas()  # head rows at most, the end, and the words of more tokens than a part
    top["word"] = top["word"].map(bytes)
    top = top.sort_values(["n", "word"], ascending=[False, True])
    end = top["word"] == END
    top = top[~end], top[end]
    count = np.concatenate([[top[1]["n"].sum()], top[0]["n"]]).astype(np.int64)
    below = sums["n"] + 0.5 * (sums["v"] + 1)
    # other known words, and the one never seen, that share what is left
    left, rest = (0, 1) if whole else (sums["n"] - int(count.sum()), sums["v"] - int((count > 0).sum()) + 1)
    tail_p = (left + 0.5 * rest) / below / rest
    p = np.where(count > 0, (count + 0.5) / below, tail_p)
    every = dict(enumerate(top[0]["m"].tolist(), 1))
    return Root(Numbers(top[0]["word"].tolist()), count, p, tail_p, below, sums["n"], whole, most > 0, *maps), least, every, sums["m"]


def _wide(words: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Numbers of words, those of words not at hand as hashes; table: these hashes, from number TAIL."""
    out = words.astype(np.uint64)
    other = np.flatnonzero((words >= TAIL) & (words != NONE))
    out[other] = table[words[other] - TAIL]
    return out


def _planes(columns: list[np.ndarray]) -> bytes:
    """Columns of equal length, byte by byte of each."""
    return b"".join(c.view(np.uint8).reshape(len(c), -1).T.tobytes() for c in columns)


def _from_planes(raw: np.ndarray, n: int, *kinds) -> list[np.ndarray]:
    at, out = 0, []
    for size, k in ((np.dtype(k).itemsize, k) for k in kinds):
        out.append(np.ascontiguousarray(raw[at : at + n * size].reshape(size, n).T).view(k).reshape(n))
        at += n * size
    return out


def _pack(*columns: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(1).compress(_planes(list(columns)))


def _unpack(payload: bytes, *kinds) -> list[np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(payload), np.uint8)
    return _from_planes(raw, len(raw) // sum(np.dtype(k).itemsize for k in kinds), *kinds)


def _pack_rows(words: list[np.ndarray], last: np.ndarray, table: np.ndarray) -> bytes:
    """Columns of words, where TAIL stands for words that are not at hand, and another column; then these words' hashes."""
    hashes = []
    if len(table):
        words = list(words)
        for k, c in enumerate(words):
            other = np.flatnonzero((c >= TAIL) & (c != NONE))
            if len(other):
                hashes.append(table[c[other] - TAIL])
                words[k] = c.copy()
                words[k][other] = TAIL
    tail = _planes([np.concatenate(hashes)]) if hashes else b""
    return zstandard.ZstdCompressor(1).compress(len(last).to_bytes(8, "little") + _planes([*words, last]) + tail)


def _unpack_rows(payload: bytes, width: int, kind) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """Columns of words, each one's hashes, and the other column."""
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(payload), np.uint8)
    n = int(raw[:8].view(np.int64)[0])
    kinds = [*[np.uint32] * width, kind]
    rest = 8 + n * sum(np.dtype(k).itemsize for k in kinds)
    *words, last = _from_planes(raw[8:rest], n, *kinds)
    (hashes,) = _from_planes(raw[rest:], (len(raw) - rest) // 8, np.uint64)
    counts = [int(np.count_nonzero(c == TAIL)) for c in words] if len(hashes) else [0] * width
    return words, np.split(hashes, np.cumsum(counts)[:-1]), last


@dataclass
class Layout:
    """Parts of the tree: `plain` by the last word, then those of hot contexts. By depth, from 1: sorted codes (the shorter context's index and the word before), parts, the first part."""

    depth: int
    plain: int
    part: int
    codes: list[np.ndarray] = field(default_factory=list)
    width: list[np.ndarray] = field(default_factory=list)
    first: list[np.ndarray] = field(default_factory=list)
    parts: int = 0

    def add(self, codes: np.ndarray, positions: np.ndarray) -> None:
        order = np.argsort(codes)
        width = np.maximum(1, -(-positions[order] // self.part)).astype(np.int64)
        begin = self.parts or self.plain
        self.codes.append(codes[order])
        self.width.append(width)
        self.first.append(begin + np.cumsum(width) - width)
        self.parts = begin + int(width.sum())

    def find(self, h: list[np.ndarray], d: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions whose contexts of d words are hot, and which they are."""
        rows, at = np.arange(len(h[0])), np.zeros(len(h[0]), np.uint64)
        for k in range(d):
            code = at << np.uint64(32) | h[k][rows]
            x = np.minimum(np.searchsorted(self.codes[k], code), len(self.codes[k]) - 1)
            hit = self.codes[k][x] == code if len(self.codes[k]) else np.zeros(len(code), bool)
            rows, at = rows[hit], x[hit].astype(np.uint64)
        return rows, at.astype(np.int64)

    def keys(self, h: list[np.ndarray], table: np.ndarray, turns: np.ndarray) -> np.ndarray:
        out = (mix(_wide(h[0], table)) % np.uint64(self.plain)).astype(np.int64)
        for d in range(1, len(self.codes) + 1):
            rows, at = self.find(h, d)
            before = _wide(h[d][rows], table) if d < self.depth else np.full(len(rows), NONE, np.uint64)
            turn = np.where(before == NONE, turns[rows], mix(before + np.uint64(d)))
            out[rows] = self.first[d - 1][at] + (turn % self.width[d - 1][at].astype(np.uint64)).astype(np.int64)
        return out

    def words(self, d: int, at: int) -> list[int]:
        """The context's words, the last one first."""
        out: list[int] = []
        for k in range(d - 1, -1, -1):
            code = int(self.codes[k][at])
            out.insert(0, code & 0xFFFFFFFF)
            at = code >> 32
        return out

    def receivers(self) -> dict[tuple[int, int], list[int]]:
        """(depth, index) of hot contexts -> the parts of their own and of hot contexts that end with them."""
        out: dict[tuple[int, int], list[int]] = {}
        for d in range(len(self.codes), 0, -1):
            for i, (first, width) in enumerate(zip(self.first[d - 1].tolist(), self.width[d - 1].tolist(), strict=True)):
                own = out[d, i] = out.get((d, i), []) + list(range(first, first + width))
                if d > 1:
                    out.setdefault((d - 1, int(self.codes[d - 1][i]) >> 32), []).extend(own)
        return out

    def hot_depth(self, key: int) -> int:
        for d in range(len(self.codes), 0, -1):
            if len(self.first[d - 1]) and key >= self.first[d - 1][0]:
                return d
        return 0


class _Chunks:
    """Texts as numbers, given out as chunks of consecutive rows."""

    def __init__(self, own: Root, depth: int):
        self.own, self.depth = own, depth
        self.start = self.next = 0
        self.clear()

    def clear(self) -> None:
        self.batches: list[pa.RecordBatch] = []
        self.flat: list[pa.Array] = []
        self.lengths: list[np.ndarray] = []
        self.tokens = self.rows = 0
        self.start = self.next

    def add(self, b: pa.RecordBatch) -> None:
        flat, lengths = _tokens(b.column("text"))
        self.batches.append(b.drop_columns("text"))
        self.flat.append(flat)
        self.lengths.append(lengths)
        self.tokens += len(flat)
        self.rows += len(lengths)
        self.next += len(lengths)

    def numbered(self) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """All tokens, their numbers, and the texts' lengths in tokens."""
        flat = pa.concat_arrays(self.flat)
        return flat, self.own.numbers.of(flat), np.concatenate(self.lengths)

    def column(self, name: str) -> pa.Array:
        return pa.concat_arrays([b.column(name) for b in self.batches])

    def full(self) -> bool:
        return self.tokens >= CHUNK or self.rows >= CHUNK_DOCS

    def chunk(self) -> int:
        return int(row_numbers(1, self.start)[0])

    def turn(self) -> int:
        return int(mix(np.array([self.chunk()], np.uint64))[0] >> np.uint64(2))

    def positions(self, x: np.ndarray, lengths: np.ndarray, others: bool = False) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
        """Words before, last first; token; document with the mark of held-out ones: where the word before may be a context's.

        x, lengths: as numbered() gives them. The last is the hashes of words that are not at hand, from number TAIL. others:
        only positions of such words whose training count is not known to be one.
        """
        held = self.column("held_out").to_numpy(zero_copy_only=False).astype(bool)
        inside = self.own.in_contexts(x)
        other = np.flatnonzero(x >= TAIL)
        table, inverse = np.unique(x[other], return_inverse=True)
        x = x.astype(np.uint32)
        x[other] = (inverse + TAIL).astype(np.uint32)
        doc = np.repeat(np.arange(len(lengths)), lengths)
        place = np.arange(len(x)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        asked = (place > 0) & np.roll(inside, 1)
        if others:
            unknown = x >= TAIL
            unknown[other] &= _has(self.own.twice, table)[inverse] | np.repeat(held, lengths)[other]
            asked &= unknown
        at = np.flatnonzero(asked)
        h, goes_on = [], np.ones(len(at), bool)
        for d in range(1, self.depth + 1):
            before = x[np.maximum(at - d, 0)]
            goes_on &= (place[at] >= d) & inside[np.maximum(at - d, 0)]
            h.append(np.where(goes_on, before, NONE))
        marks = (doc[at] | np.where(held, _HELD, 0)[doc[at]]).astype(np.uint16)
        return h, x[at], marks, table

    def keys(self, layout: Layout, h: list[np.ndarray], s: np.ndarray, table: np.ndarray) -> np.ndarray:
        """The positions' parts. Words not at hand have few tokens and are dealt by themselves, so that their counts find them."""
        turns = np.full(len(s), self.turn(), np.uint64)
        if self.own.whole:
            other = np.flatnonzero(s >= TAIL)
            turns[other] = mix(table[s[other] - TAIL])
        return layout.keys(h, table, turns)


def _hot_strings(shared_root, shared_layout, d: int):
    """context, s, n, m: strings after hot contexts of d words, counted in each chunk."""

    def run(batches: Batches) -> Batches:
        chunks = _Chunks(shared_root.value, d)
        layout = shared_layout.value

        def out() -> pa.RecordBatch:
            h, s, marks, table = chunks.positions(*chunks.numbered()[1:])
            chunks.clear()
            rows, at = layout.find(h, d)
            code, inverse = np.unique(at << 32 | s[rows].astype(np.int64), return_inverse=True)
            n = np.bincount(inverse, marks[rows] < _HELD, len(code)).astype(np.int64)
            m = np.bincount(inverse, minlength=len(code)).astype(np.int64)
            string = _wide((code & 0xFFFFFFFF).astype(np.uint32), table).view(np.int64)  # hashes are below 0
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (code >> 32, string, n, m)], names=["context", "s", "n", "m"])

        for b in batches:
            if b.num_rows:
                chunks.add(b)
            if chunks.full():
                yield out()
        if chunks.rows:
            yield out()

    return run


def plan(frame: DataFrame, own: Root, shared_root, every: dict[int, int], tokens: int, depth: int, part: int, least_part: int) -> tuple[Layout, list[DataFrame]]:
    """The parts, and by depth the strings after hot contexts as tables."""
    part = part_size(tokens, part, least_part)
    layout = Layout(depth, max(1, -(-tokens // part)), part)
    hot = {s: m for s, m in every.items() if m > part}
    tables: list[DataFrame] = []
    while hot and len(layout.codes) < depth:
        layout.add(np.array(list(hot), np.uint64), np.array(list(hot.values()), np.int64))
        d = len(layout.codes)
        shared = frame.sparkSession.sparkContext.broadcast(layout)
        counted = frame.select("text", "held_out").mapInArrow(_hot_strings(shared_root, shared, d), "context long, s long, n long, m long")
        tables.append(written(counted.groupBy("context", "s").agg(F.sum("n").alias("n"), F.sum("m").alias("m")), f"lm-hot-{d}"))
        hot = {}
        if d < depth:  # a hot string's last words are a hot context: tokens / part rows at most
            for r in tables[-1].where((F.col("m") > part) & (F.col("s") >= 0)).collect():
                words = [r["s"], *layout.words(d, r["context"])]
                rows, at = layout.find([np.array([w], np.uint32) for w in words[:d]], d)
                if len(rows):
                    hot[int(at[0]) << 32 | words[d]] = r["m"]
    layout.parts = layout.parts or layout.plain
    return layout, tables


def _hot_rows(shared_layout, d: int):
    """Rows for the parts: strings after hot contexts of d words."""

    def run(batches: Batches) -> Batches:
        layout = shared_layout.value
        receivers = layout.receivers()
        held: list[pa.RecordBatch] = []
        rows = 0

        def out() -> pa.RecordBatch:
            context, s, n = (np.concatenate([b.column(c).to_numpy() for b in held]) for c in ("context", "s", "n"))
            other = np.flatnonzero(s < 0)
            table = s[other].view(np.uint64)
            s = np.where(s < 0, 0, s).astype(np.uint32)
            s[other] = TAIL + np.arange(len(other), dtype=np.uint32)
            keys, payloads = [], []
            for c in np.unique(context).tolist():
                at = context == c
                words = layout.words(d, c)
                h = [np.full(int(at.sum()), words[k] if k < d else NONE, np.uint32) for k in range(layout.depth)]
                payload = _pack_rows([*h, s[at]], n[at], table)
                keys += (own := receivers[d, c])
                payloads += [payload] * len(own)
            return _packed(keys, STRINGS, 0, payloads)

        for b in batches:
            held.append(b)
            rows += b.num_rows
            if rows > _FLUSH:
                yield out()
                held, rows = [], 0
        if rows:
            yield out()

    return run


def _other_tokens(shared_root, shared_layout):
    """0, key, hash: words not at hand among the tokens of each part's positions, if their training count is not known to be one."""

    def run(batches: Batches) -> Batches:
        layout = shared_layout.value
        chunks = _Chunks(shared_root.value, layout.depth)

        def out() -> pa.RecordBatch:
            h, s, _, table = chunks.positions(*chunks.numbered()[1:], others=True)
            code = np.unique(chunks.keys(layout, h, s, table) << 32 | s.astype(np.int64))
            chunks.clear()
            hashes = table[(code & 0xFFFFFFFF) - TAIL].view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(np.zeros(len(code), np.int32), pa.int32()), pa.array(code >> 32, pa.int64()), pa.array(hashes, pa.int64())], names=["d", "key", "hash"])

        for b in batches:
            if b.num_rows:
                chunks.add(b)
            if chunks.full():
                yield out()
        if chunks.rows:
            yield out()

    return run


def _count_rows(shared_layout):
    """Rows for the parts, of d, key, hash, n sorted by the first two: for part key, or with d for all of a hot context's."""

    def run(batches: Batches) -> Batches:
        receivers = shared_layout.value.receivers()
        held: list[pa.RecordBatch] = []
        rows = 0

        def out() -> pa.RecordBatch:
            d, key, hashes, n = (np.concatenate([b.column(c).to_numpy() for b in held]) for c in ("d", "key", "hash", "n"))
            first = np.flatnonzero(np.append(True, (d[1:] != d[:-1]) | (key[1:] != key[:-1]))).tolist()
            keys, payloads = [], []
            for a, b in zip(first, [*first[1:], len(key)], strict=True):
                own = receivers[int(d[a]), int(key[a])] if d[a] else [int(key[a])]
                keys += own
                payloads += [_pack(hashes[a:b], n[a:b])] * len(own)
            return _packed(keys, COUNTS, 0, payloads)

        for b in batches:
            held.append(b)
            rows += b.num_rows
            if rows > _FLUSH:
                yield out()
                held, rows = [], 0
        if rows:
            yield out()

    return run


def other_counts(frame: DataFrame, tables: list[DataFrame], rare: DataFrame, shared_root, shared_layout) -> DataFrame:
    """Rows for the parts: training counts of words not at hand among the tokens of positions and among hot contexts' strings."""
    asked = frame.select("text", "held_out").mapInArrow(_other_tokens(shared_root, shared_layout), "d int, key long, hash long")
    for d, t in enumerate(tables, 1):
        asked = asked.unionByName(t.where("n > 0 and s < 0").select(F.lit(d).alias("d"), F.col("context").alias("key"), F.col("s").alias("hash")))
    found = asked.join(rare.select(_hash("word").alias("hash"), F.col("c").alias("n")), "hash").where("d = 0 or n > 1")  # a string's word has one at least
    spread = F.when(F.col("d") == 0, F.col("key")).otherwise(F.col("hash"))
    return found.repartition(spread).sortWithinPartitions("d", "key").mapInArrow(_count_rows(shared_layout), ROW)


def _packed(keys: list[int], kind: int, chunk: int, payloads: list[bytes]) -> pa.RecordBatch:
    n = len(keys)
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array([kind] * n, pa.int32()), pa.array([chunk] * n, pa.int64()), pa.array(payloads, pa.binary())], names=["key", "kind", "chunk", "payload"])


_DOCUMENT = pa.schema({"doc_id": pa.int64(), "held_out": pa.bool_(), "n_tokens": pa.int64(), "n_known": pa.int64(), "base": pa.float64(), "score": pa.float64()})
_WORDS = pa.schema({"doc": pa.int32(), "word": pa.binary(), "n": pa.int64()})


def _ipc(t: pa.RecordBatch) -> bytes:
    sink = io.BytesIO()
    with pa.ipc.new_stream(sink, t.schema) as w:
        w.write_batch(t)
    return zstandard.ZstdCompressor(1).compress(sink.getvalue())


def _read_ipc(payload: bytes) -> pa.Table:
    return pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(payload)).read_all()


def _positions(shared_root, shared_layout):
    """Rows for the parts: packed positions; and for each chunk its documents with what words at hand give, then its other words."""

    def run(batches: Batches) -> Batches:
        own, layout = shared_root.value, shared_layout.value
        chunks = _Chunks(own, layout.depth)

        def out() -> Batches:
            flat, ids, lengths = chunks.numbered()
            chunk, turn = chunks.chunk(), chunks.turn()
            for k, t in enumerate(documents(flat, ids, lengths)):
                yield _packed([turn % layout.parts], DOCUMENTS + k, chunk, [_ipc(t)])
            h, s, marks, table = chunks.positions(ids, lengths)
            key = chunks.keys(layout, h, s, table)
            order = np.argsort(key.astype(np.uint64) << np.uint64(32) | h[0], kind="stable")
            key, marks, columns = key[order], marks[order], [c[order] for c in (*h, s)]
            keys, first = np.unique(key, return_index=True)
            cuts = [*first.tolist(), len(key)]
            yield _packed(keys.tolist(), POSITIONS, chunk, [_pack_rows([c[a:b] for c in columns], marks[a:b], table) for a, b in zip(cuts, cuts[1:], strict=False)])
            chunks.clear()

        def documents(flat: pa.Array, ids: np.ndarray, lengths: np.ndarray) -> tuple[pa.RecordBatch, pa.RecordBatch]:
            starts = np.cumsum(lengths) - lengths
            doc = np.repeat(np.arange(len(lengths)), lengths)
            inside = ids < len(own.count)
            n = np.where(inside, own.count[np.where(inside, ids, 0)], 0)
            known = np.bincount(doc, n > 0, len(lengths)).astype(np.int64)
            base = np.bincount(doc, np.where(inside, np.log10((n + 0.5) / own.below), 0.0), len(lengths))
            alone = np.append(True, ~own.in_contexts(ids[:-1]))
            alone[starts] = True
            without = np.bincount(doc, np.where(alone & (inside | (not own.whole)), np.log10(own.of(ids)), 0.0), len(lengths))
            rest = np.flatnonzero(~inside & (alone | (not own.whole)))  # the parts know the counts of all others
            found = Counter(zip(doc[rest].tolist(), flat.take(pa.array(rest)).to_numpy(zero_copy_only=False), strict=True))
            values = [chunks.column("doc_id"), chunks.column("held_out"), lengths, known, base, without]
            words = [[d for d, _ in found], [w for _, w in found], list(found.values())]
            return (
                pa.RecordBatch.from_arrays([pa.array(v, k) if isinstance(v, np.ndarray) else v for v, k in zip(values, _DOCUMENT.types, strict=True)], schema=_DOCUMENT),
                pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(words, _WORDS.types, strict=True)], schema=_WORDS),
            )

        for b in batches:
            if b.num_rows:
                chunks.add(b)
            if chunks.full():
                yield from out()
        if chunks.rows:
            yield from out()

    return run


def probabilities(h: list[np.ndarray], s: np.ndarray, weight, root_p: np.ndarray, least_count: int, least_bits: float) -> tuple[np.ndarray, int]:
    """Each row's probability by its longest retained context, and the number of retained contexts.

    h: words before, last first; weight(d): how often each row counts for contexts of d words.
    """
    p, context = root_p.copy(), np.zeros(len(s), np.int64)
    rows, retained = np.arange(len(s)), 0
    for d in range(1, len(h) + 1):
        rows = rows[h[d - 1][rows] != NONE]
        _, at = np.unique(context[rows] << 32 | h[d - 1][rows].astype(np.int64), return_inverse=True)
        w = weight(d)
        total = np.bincount(at, w[rows])
        frequent = total[at] >= least_count  # so are its suffixes
        rows, at = rows[frequent], at[frequent]
        context[rows] = at
        string, first, inverse = np.unique(at << 32 | s[rows].astype(np.int64), return_index=True, return_inverse=True)
        if not len(string):
            break
        of, n = string >> 32, np.bincount(inverse, w[rows])
        width, below = np.bincount(of, n > 0), total[of]
        suffix, share = p[rows][first], n / below
        bits = np.bincount(of, share * np.log2(np.where(n > 0, share / suffix, 1.0)))
        kept = bits >= least_bits
        retained += int(kept[np.unique(of)].sum())
        own = (n + width[of] * suffix) / (below + width[of])
        p[rows] = np.where(kept[of], own, suffix)[inverse]
    return p, retained


def _score_part(layout: Layout, own: Root, key: int, rows: list[tuple[int, int, bytes]], least_count: int, least_bits: float) -> tuple[list[tuple[int, int, bytes]], int]:
    """(kind, chunk, packed documents' sums, or training counts of their words not at hand) for a part's rows (kind, chunk, payload), and its retained contexts."""
    hot, depth = layout.hot_depth(key), layout.depth
    columns, hashes, chunks, counts = [], [], [], []
    for kind, chunk, payload in sorted(rows):
        if kind == COUNTS:
            counts.append(_unpack(payload, np.uint64, np.int64))
            continue
        x, other, last = _unpack_rows(payload, depth + 1, np.uint16 if kind == POSITIONS else np.int64)
        hashes.append(other)
        if kind == POSITIONS:
            chunks.append((chunk, last & (_HELD - 1)))
            columns.append([*x, np.where(last < _HELD, -1, 0).astype(np.int64)])  # -1: a training position
        else:
            columns.append([*x, last])
    *h, s, count = (np.concatenate(c) for c in zip(*columns, strict=True))
    by_column = [np.concatenate(c) for c in zip(*hashes, strict=True)]
    table, number = np.unique(np.concatenate(by_column), return_inverse=True)
    if len(table):
        number = (number + TAIL).astype(np.uint32)
        for x, own_numbers in zip((*h, s), np.split(number, np.cumsum([len(c) for c in by_column])[:-1]), strict=True):
            x[x == TAIL] = own_numbers
    root_p, other = own.of(s), np.flatnonzero(s >= TAIL)
    other = other if own.whole else other[:0]
    number = s[other] - TAIL
    known = np.zeros(len(table), np.int64)
    known[number[count[other] != 0]] = 1  # a training token whose count is not given has this one
    if counts:
        asked, n = (np.concatenate(c) for c in zip(*counts, strict=True))
        known[np.searchsorted(table, asked)] = n
    root_p[other] = (known[number] + 0.5) / own.below
    length = sum((x != NONE).astype(np.int8) for x in h)  # of a hot context, in its strings' rows

    def weight(d: int) -> np.ndarray:
        return np.where(count < 0, 1.0 if d > hot else 0.0, np.where(length == d, count, 0.0))

    p, retained = probabilities(h, s, weight, root_p, least_count, least_bits)
    out, at = [], 0
    for chunk, docs in chunks:  # positions come first
        sums = np.bincount(docs, np.log10(p[at : at + len(docs)]))
        some = np.unique(docs)
        out.append((POSITIONS, chunk, _pack(some.astype(np.uint16), sums[some].astype(np.float32))))
        a, b = np.searchsorted(other, [at, at + len(docs)])
        if a < b:
            out.append((COUNTS, chunk, _pack(docs[other[a:b] - at].astype(np.uint16), known[number[a:b]])))
        at += len(docs)
    return out, retained


def _score(shared_root, shared_layout, least_count: int, least_bits: float):
    def run(batches: Batches) -> Batches:
        parts: dict[int, list[tuple[int, int, bytes]]] = {}
        for b in batches:
            done = []
            for key, kind, chunk, payload in zip(*(b.column(c).to_pylist() for c in ("key", "kind", "chunk", "payload")), strict=True):
                if kind >= DOCUMENTS:
                    done.append((key, kind, chunk, payload))
                else:
                    parts.setdefault(key, []).append((kind, chunk, payload))
            for key, kind, chunk, payload in done:
                yield _packed([key], kind, chunk, [payload])
        for key in sorted(parts):
            rows = parts.pop(key)
            if any(kind == POSITIONS for kind, _, _ in rows):
                for kind, chunk, payload in _score_part(shared_layout.value, shared_root.value, key, rows, least_count, least_bits)[0]:
                    yield _packed([key], kind, chunk, [payload])

    return run


def _finish(below: float):
    """uid and a document's columns, with the sums of all parts."""

    def run(batches: Batches) -> Batches:
        chunks: dict[int, list[tuple[int, int, bytes]]] = {}
        for b in batches:
            for key, kind, chunk, payload in zip(*(b.column(c).to_pylist() for c in ("key", "kind", "chunk", "payload")), strict=True):
                chunks.setdefault(chunk, []).append((-kind, key, payload))
        for chunk in sorted(chunks):
            (_, _, payload), *parts = sorted(chunks.pop(chunk))
            docs = _read_ipc(payload)
            known, base, score = (docs.column(c).to_numpy().copy() for c in ("n_known", "base", "score"))
            for kind, _, p in parts:  # in the order of the parts, so that reruns agree
                if kind == -COUNTS:
                    at, n = _unpack(p, np.uint16, np.int64)
                    known += np.bincount(at, n > 0, len(known)).astype(np.int64)
                    base += np.bincount(at, np.log10((n + 0.5) / below), len(base))
                else:
                    at, sums = _unpack(p, np.uint16, np.float32)
                    score[at] += sums
            columns = [pa.array(chunk + np.arange(len(score))), *(docs.column(c).combine_chunks() for c in _DOCUMENT.names[:-3]), pa.array(known), pa.array(base), pa.array(score)]
            yield pa.RecordBatch.from_arrays([c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in columns], names=["uid", *_DOCUMENT.names])

    return run


def _other_words(batches: Batches) -> Batches:
    for b in batches:
        for chunk, payload in zip(b.column("chunk").to_pylist(), b.column("payload").to_pylist(), strict=True):
            for t in _read_ipc(payload).to_batches():
                yield pa.RecordBatch.from_arrays([pa.array(chunk + t.column("doc").to_numpy().astype(np.int64)), t.column("word"), t.column("n")], names=["uid", "word", "n"])


def score(
    docs: DataFrame,
    modulus: int = 5,
    remainder: int = 1,
    head: int | None = None,
    depth: int = DEPTH,
    least_count: int = LEAST_COUNT,
    least_bits: float = LEAST_BITS,
    part: int = PART,
    least_part: int = LEAST_PART,
    at_hand: int = AT_HAND,
) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row of docs (doc_id: an integer).

    head: a limited vocabulary, if one is wanted. at_hand: words in each task's memory; it changes no result.
    """
    spark = docs.sparkSession
    if head is not None and not 0 < head <= TAIL - 2:
        raise ValueError(f"head: 1 to {TAIL - 2} words")
    if not 0 <= at_hand <= TAIL - MOST_PARTS - 2:
        raise ValueError(f"at_hand: 0 to {TAIL - MOST_PARTS - 2} words")
    frame = text_frame(docs, held_out(remainder, modulus).alias("held_out")).withColumn("doc_id", F.col("doc_id").cast("long"))
    words = lexicon(frame)
    own, least, every, tokens = root(words, at_hand if head is None else head, head is None, least_count, part, least_part)
    shared_root = spark.sparkContext.broadcast(own)  # at_hand + MOST_PARTS words at most
    layout, tables = plan(frame, own, shared_root, every, tokens, depth, part, least_part)
    shared = spark.sparkContext.broadcast(layout)  # MOST_PARTS contexts of each depth at most
    # a known word that is not at hand is in few training texts; one of held-out texts alone matches nothing, and the outer join splits it
    rare = words.where((_grade(F.col("n")) < least) & (F.col("n") > 0)).select("word", F.col("n").alias("c"))

    rows = frame.mapInArrow(_positions(shared_root, shared), ROW)
    for d, t in enumerate(tables, 1):
        rows = rows.unionByName(t.where("n > 0").select("context", "s", "n").mapInArrow(_hot_rows(shared, d), ROW))
    if own.others:
        rows = rows.unionByName(other_counts(frame, tables, rare, shared_root, shared))
    scored = rows.repartition(layout.parts, "key").mapInArrow(_score(shared_root, shared, least_count, least_bits), ROW)
    scored = written(scored, "lm-scored")
    discard(*tables)

    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), tokens // (4 * CHUNK))
    out = scored.where(F.col("kind") <= DOCUMENTS).repartition(tasks, "chunk")
    out = out.mapInArrow(_finish(own.below), "uid long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double")
    tail = scored.where(F.col("kind") == DOCUMENTS + 1).select("chunk", "payload").mapInArrow(_other_words, "uid long, word binary, n long").join(rare, "word", "left")
    tail = tail.groupBy("uid").agg(
        F.sum(F.col("n") * F.log10((F.coalesce("c", F.lit(0)) + 0.5) / F.lit(own.below))).alias("tail_base"),
        F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("tail_known"),
    )
    return out.join(tail, "uid", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("tail_known", F.lit(0))).alias("n_known"),
        F.lit(own.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("tail_base", F.lit(0.0))).alias("base_score"),
        (F.col("score") + F.coalesce("tail_base", F.lit(0.0))).alias("score") if own.whole else F.col("score"),
    )
