"""BPE encoding and decoding of whole documents with a public vocabulary (operator 1).

Method: contiguous rank array. A short word holds its part boundaries and the ranks of adjacent parts in two
lists; the smallest rank is found by scanning, its boundary deleted and the neighbouring ranks refreshed. Words of
more than SHORT symbols (scanning them would take quadratic time) take their smallest rank from a heap instead.

Null and empty texts have no tokens. Repeated rows give repeated results. Special tokens in a text are encoded as
such. Every text is processed whole; the cache of words is bounded.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Batches, text_frame

SHORT = 96
_NONE = 1 << 60
_WHITE = r"\t-\r \x85\xa0" + "".join(map(chr, [0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
_ODD_SPLITS = regex.compile(r"[\x1c-\x1f]")
_CHUNK = regex.compile(rf"[^{_WHITE}]+")


def _byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = [""] * 256, 256
    for b in range(256):
        if b in plain:
            out[b] = chr(b)
        else:
            out[b], extra = chr(extra), extra + 1
    return out


class WordBpe:
    """A tokenizer file of kind word BPE: lower case, white space dropped, words end in a suffix."""

    def __init__(self, path: str, cache: int = 500_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.rank = {tuple(m): i for i, m in enumerate(model["merges"])}
        self.suffix: str = model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in [*self.vocab.items(), *self.special.items()]}
        self.split_special = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.pieces = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}]+|[\p{{N}}]|[^{_WHITE}\p{{L}}\p{{N}}]+")
        self.symbols = _byte_symbols()
        self.cache: dict[str, bytes] = {}
        self.most = cache

    def merge(self, parts: list[str]) -> list[str]:
        """Merge by rank, the leftmost first among equals."""
        if len(parts) > SHORT:
            return self._merge_long(parts)
        word, get = "".join(parts), self.rank.get
        n = len(parts)
        bounds = [*range(n), len(word)]
        ranks = [get(pair, _NONE) for pair in zip(parts, parts[1:], strict=False)]
        while ranks and (least := min(ranks)) < _NONE:
            i = ranks.index(least)
            del bounds[i + 1], ranks[i]
            merged = word[bounds[i] : bounds[i + 1]]
            if i < len(ranks):
                ranks[i] = get((merged, word[bounds[i + 1] : bounds[i + 2]]), _NONE)
            if i:
                ranks[i - 1] = get((word[bounds[i - 1] : bounds[i]], merged), _NONE)
        return [word[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]

    def _merge_long(self, parts: list[str]) -> list[str]:
        n, rank = len(parts), self.rank
        piece: list[str | None] = list(parts)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := rank.get((parts[i], parts[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = right[i]
            if piece[i] != a or j >= n or piece[j] != b:
                continue
            piece[i], piece[j], right[i] = a + b, None, right[j]
            if right[j] < n:
                left[right[j]] = i
            for x, y in ((left[i], i), (i, right[i])):
                if x >= 0 and y < n and (r := rank.get((piece[x], piece[y]))) is not None:
                    heapq.heappush(heap, (r, x, piece[x], piece[y]))
        return [p for p in piece if p is not None]

    def chunk(self, text: str) -> bytes:
        """The ids of a normalised stretch without white space, as packed int32."""
        if len(self.cache) >= self.most:
            self.cache.clear()
        found = self.pieces.findall(text)
        if len(found) == 1:
            return self.piece(found[0])
        out = b"".join([self.cache.get(p) or self.piece(p) for p in found])
        if len(text) < 40:
            self.cache[text] = out
        return out

    def piece(self, text: str) -> bytes:
        """One word, digit or run of signs, encoded by merging."""
        parts = list(text) if text.isascii() and text.isprintable() else [self.symbols[b] for b in text.encode()]
        parts[-1] += self.suffix
        out = array("i", [i for t in self.merge(parts) if (i := self.vocab.get(t)) is not None]).tobytes()
        if len(text) < 200:
            self.cache[text] = out
        return out

    def encode_text(self, text: str) -> bytes:
        """The whole text's ids as packed int32."""
        ids: list[bytes] = []
        at = 0
        for m in self.split_special.finditer(text) if self.split_special and "<" in text else ():
            self._segment(text[at : m.start()], ids)
            ids.append(array("i", [self.special[m.group()]]).tobytes())
            at = m.end()
        self._segment(text[at:] if at else text, ids)
        return b"".join(ids)

    def _segment(self, text: str, ids: list[bytes]) -> None:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # lowered one by one: no final sigma
        text = text.lower()
        chunks = _CHUNK.findall(text) if _ODD_SPLITS.search(text) else text.split()
        cache, chunk = self.cache, self.chunk
        ids += [cache.get(c) or chunk(c) for c in chunks]

    def decode_ids(self, ids) -> str:
        """The tokens joined by spaces, as a tokenizer without a decoder does; unknown ids are left out."""
        try:
            return " ".join(map(self.tokens.__getitem__, ids))
        except KeyError:
            return " ".join(self.tokens[i] for i in ids if i in self.tokens)


@lru_cache(maxsize=2)
def tokenizer(path: str) -> WordBpe:
    return WordBpe(path)


def _int_lists(packed: list[bytes]) -> pa.Array:
    ends = np.cumsum([0, *map(len, packed)], dtype=np.int64) // 4
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(np.frombuffer(b"".join(packed), np.int32)))


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids array<int>, decoded string: each whole text encoded, and decoded again from its ids."""

    def run(batches: Batches) -> Batches:
        bpe = tokenizer(path)
        for b in batches:
            packed = [bpe.encode_text(t.decode("utf-8", "replace")) for t in b.column("text").to_pylist()]
            decoded = [bpe.decode_ids(memoryview(x).cast("i")) for x in packed]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), _int_lists(packed), pa.array(decoded, pa.string())], names=["doc_id", "ids", "decoded"])

    frame = text_frame(docs)
    return frame.mapInArrow(run, f"doc_id {frame.schema['doc_id'].dataType.simpleString()}, ids array<int>, decoded string")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, text from doc_id, ids; a null list of ids decodes to an empty text."""

    def run(batches: Batches) -> Batches:
        bpe = tokenizer(path)
        for b in batches:
            texts = [bpe.decode_ids(ids or ()) for ids in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    frame = encoded.select("doc_id", "ids")
    return frame.mapInArrow(run, f"doc_id {frame.schema['doc_id'].dataType.simpleString()}, text string")


def digests(encoded: DataFrame) -> DataFrame:
    """The query's columns from what encode() returns."""
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(ids.cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
