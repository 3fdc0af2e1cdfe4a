"""Quality rules on repetition (operator 3).

Method: rolling 64-bit hashes of word windows of several lengths, in numpy, give the characters that lie inside
duplicated n-grams; equal lines give the characters inside duplicated lines. A document is kept unless it fails the
base rules or too large a share of its characters is covered by repetition.

Null texts count as empty: no words, base_failed true, kept false. Repeated rows give repeated results, an empty table
none. A share equal to its limit passes; ties do not occur otherwise. Whole texts are read, however long, one at a time in
arrays of their words; nothing is shuffled. Other columns of docs, whatever their names, are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import Batches, text_frame, window_hashes, word_hashes

#: Window lengths, and the largest share of word characters (in percent) that repeats of that length may cover.
COVER_LIMITS = {3: 40, 5: 30, 10: 20}
LINE_LIMIT = 20
MIN_WORDS = 50
_SYMBOLS = b"#*$%&|<>"
_NOT_SYMBOL = bytes(b for b in range(256) if b not in _SYMBOLS)
_CONTINUATION = bytes(range(0x80, 0xC0))


def covered(hashes: np.ndarray, n: int) -> np.ndarray:
    """For each word: does it lie in an n-word window that the text has twice or more?"""
    w = window_hashes(hashes, n)
    if not len(w):
        return np.zeros(len(hashes), bool)
    _, at, count = np.unique(w, return_inverse=True, return_counts=True)
    edge = np.zeros(len(hashes) + 1, np.int32)
    hit = np.flatnonzero(count[at] > 1)
    np.add.at(edge, hit, 1)
    np.add.at(edge, hit + n, -1)
    return np.cumsum(edge[:-1]) > 0


def measure(text: bytes) -> tuple:
    words = text.split()
    lengths = np.fromiter((len(w) for w in words), np.int64, len(words))
    plain = text.isascii()
    if not plain:
        lengths = np.fromiter((len(w.translate(None, _CONTINUATION)) for w in words), np.int64, len(words))
    chars = int(lengths.sum())
    h = word_hashes().of(words)
    cover = {n: covered(h, n) for n in COVER_LIMITS}
    seen: set[bytes] = set()
    dup_lines = dup_line_chars = 0
    for line in text.split(b"\n"):
        if line in seen:
            dup_lines += 1
            dup_line_chars += sum(len(w.translate(None, _CONTINUATION)) for w in line.split())
        elif line.strip():
            seen.add(line)
    repeat = int(cover[3].sum())
    covers = [int(lengths[c].sum()) for c in cover.values()]
    failed = len(words) < MIN_WORDS or 100 * repeat > 50 * len(words)
    kept = not failed and 100 * dup_line_chars <= LINE_LIMIT * chars and all(
        100 * c <= limit * chars for c, limit in zip(covers, COVER_LIMITS.values(), strict=True)
    )
    return len(words), chars, len(text.translate(None, _NOT_SYMBOL)), dup_lines, repeat, failed, kept, dup_line_chars, *covers


COLUMNS = {
    "n_words": pa.int64(), "word_chars": pa.int64(), "n_symbols": pa.int64(), "n_dup_lines": pa.int64(), "n_repeat_words": pa.int64(),
    "base_failed": pa.bool_(), "kept": pa.bool_(), "dup_line_chars": pa.int64(), **{f"dup_{n}gram_chars": pa.int64() for n in COVER_LIMITS},
}


def repetition(docs: DataFrame) -> DataFrame:
    """doc_id and the measures and verdicts of each whole text."""

    def run(batches: Batches) -> Batches:
        for b in batches:
            rows = [measure(t) for t in b.column("text").to_pylist()]
            parts = zip(*rows, strict=True) if rows else [[]] * len(COLUMNS)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), *(pa.array(x, kind) for x, kind in zip(parts, COLUMNS.values(), strict=True))], names=["doc_id", *COLUMNS]
            )

    frame = text_frame(docs)
    kinds = {pa.int64(): "long", pa.bool_(): "boolean"}
    schema = ", ".join(f"{c} {kinds[k]}" for c, k in COLUMNS.items())
    return frame.mapInArrow(run, f"doc_id {frame.schema['doc_id'].dataType.simpleString()}, {schema}")
