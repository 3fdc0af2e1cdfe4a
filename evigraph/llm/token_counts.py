"""Token counts by field and section (operator 5).

Method: offset-mapped attribution. Each whole document, which is the concatenation of its fields, is encoded once with a
public byte-level vocabulary. The tokens' bytes give spans of characters (a token that holds a part of a character
covers that character); the spans are joined to the sections' spans by binary search, and a token that crosses a
boundary goes to the section that holds its first character (rule "first"), its last one (rule "last"), or most of its
characters, ties to the earlier one (rule "most"). So the counts of a document's sections add up to that of the text.

Sections are the fields' lines, each with its line break (by="line"), paragraphs, which end with a run of two or more
line breaks (by="paragraph"), or whole fields (by="field"). An empty or null field has one empty section without
tokens. Fields follow each other without anything between, so a token may cross from one to the next.

Very long texts: the encoder's pattern recurses over runs of white space, so runs of LONG characters or more are cut out
at the places where the pattern must cut, and encoded as the one piece that they are; the ids are those of the whole text.

Nulls are empty fields, a null doc_id is kept. Ties are those of the rules above. Repeated rows give repeated results,
an empty table an empty one; other columns of docs, whatever their names, are not read.
"""

from __future__ import annotations

import base64
from collections.abc import Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Batches, small_batches

#: Fixed value: the pattern of the public byte-level vocabulary of 50,256 tokens.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LONG = 2000
_BLANKS = regex.compile(rf"\p{{White_Space}}{{{LONG},}}")
RULES, SECTIONS = ("first", "last", "most"), ("line", "paragraph", "field")
_BREAKS = {"line": regex.compile(r"\n"), "paragraph": regex.compile(r"\n{2,}")}


@lru_cache(maxsize=2)
def encoding(path: str) -> tuple[tiktoken.Encoding, np.ndarray]:
    """The encoder, and the length of each token in bytes."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    lengths = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, i in ranks.items():
        lengths[i] = len(token)
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), lengths


def encode(enc: tiktoken.Encoding, text: str) -> list[int]:
    """The ids of the whole text. A run of white space starts a piece; its last character belongs to what follows."""
    out: list[int] = []
    at = 0
    for run in _BLANKS.finditer(text):
        end = run.end() - (run.end() < len(text))
        out += enc.encode_ordinary(text[at : run.start()])
        out += enc._encode_single_piece(text[run.start() : end])
        at = end
    return out + enc.encode_ordinary(text[at:])


def sections(fields: Sequence[str], by: str) -> tuple[np.ndarray, np.ndarray]:
    """Each section's field and first character; empty sections stand only for empty fields."""
    of, starts, at = [], [], 0
    for k, text in enumerate(fields):
        cuts = [0] if by == "field" else [0, *(m.end() for m in _BREAKS[by].finditer(text) if m.end() < len(text))]
        of += [k] * len(cuts)
        starts += [at + c for c in cuts]
        at += len(text)
    return np.array(of, np.int64), np.array(starts, np.int64)


def token_spans(text: bytes, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last character of each token. lengths: the tokens' bytes."""
    character = np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80) - 1
    ends = np.cumsum(lengths)
    return character[ends - lengths], character[ends - 1]


def attribute(first: np.ndarray, last: np.ndarray, starts: np.ndarray, rule: str = "first") -> np.ndarray:
    """Tokens of each section. starts rise; of equal ones only the last section has characters."""
    a, b = np.searchsorted(starts, first, "right") - 1, np.searchsorted(starts, last, "right") - 1
    at = b if rule == "last" else a
    if rule == "most" and len(at):
        ends = np.append(starts[1:], np.iinfo(np.int64).max)
        at = a.copy()
        for i in np.flatnonzero(a != b):  # tokens are short, so they cross few boundaries
            inside = np.minimum(ends[a[i] : b[i] + 1], last[i] + 1) - np.maximum(starts[a[i] : b[i] + 1], first[i])
            at[i] += int(np.argmax(inside))
    return np.bincount(at, minlength=len(starts))


def token_counts(docs: DataFrame, path: str, rule: str = "first", by: str = "line", fields: Sequence[str] = ("text",)) -> DataFrame:
    """doc_id, field, section (from 0 in each field), start_char, end_char (in the field), n_tokens, doc_tokens: one row for each section."""
    if rule not in RULES or by not in SECTIONS:
        raise ValueError(f"rule: one of {RULES}; by: one of {SECTIONS}")
    names = list(fields)

    def run(batches: Batches) -> Batches:
        enc, byte_lengths = encoding(path)
        for b in batches:
            rows: list[list[np.ndarray]] = []
            for i, texts in enumerate(zip(*(b.column(f"f{k}").to_pylist() for k in range(len(names))), strict=True)):
                texts = [t.decode("utf-8", "replace") for t in texts]
                whole = "".join(texts)
                lengths = byte_lengths[np.asarray(encode(enc, whole), np.int64)]
                of, starts = sections(texts, by)
                first, last = token_spans(whole.encode(), lengths)
                base = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
                new = np.flatnonzero(np.diff(of, prepend=-1))
                rows.append(
                    [
                        np.full(len(of), i), of, np.arange(len(of)) - np.repeat(new, np.diff(new, append=len(of))),
                        starts - base[of], np.append(starts[1:], base[-1]) - base[of], attribute(first, last, starts, rule), np.full(len(of), len(lengths)),
                    ]
                )
            if rows:
                i, of, *numbers = (np.concatenate(c) for c in zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").take(pa.array(i)), pa.array(names).take(pa.array(of)), *(pa.array(x, pa.int64()) for x in numbers)],
                    names=["doc_id", "field", "section", "start_char", "end_char", "n_tokens", "doc_tokens"],
                )

    small_batches(docs.sparkSession)
    frame = docs.select("doc_id", *[F.coalesce(F.col(f"`{c}`").cast("binary"), F.lit(b"")).alias(f"f{k}") for k, c in enumerate(names)])
    kind = frame.schema["doc_id"].dataType.simpleString()
    return frame.mapInArrow(run, f"doc_id {kind}, field string, section long, start_char long, end_char long, n_tokens long, doc_tokens long")
