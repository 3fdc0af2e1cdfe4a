"""Exact deduplication (operator 6).

Method: an extendible-hash index on shared files.

1. Each task normalises its texts (ASCII white space deleted), hashes them, and folds its own copies: one entry per
   distinct text and task, with the text's bytes, its count and its best row. A group of copies of any size so
   leaves at most a few entries per task. Entries and members go to files in the shared folder.
2. The directory, a file of the shared folder: a cell for each value of a 64-bit key's leading bits, with its bucket and
   the bucket's depth. It starts at the depth where buckets hold ``bucket_bytes`` on average; buckets above it split by
   one more bit, and the directory doubles with them. A bucket of one key splits no further, nor does one that is EXTRA
   bits deeper than the start: it then holds a few very long texts.
3. Owner tasks each take whole buckets, that is key ranges, TASK_BYTES of them on average. Sorted by key, entries of one
   key form a chain; bytes are compared along the chain, so texts whose keys collide stay apart. The index (entry,
   class, size, best row) is written to the shared folder.
4. Members look up their entry's class.

Null texts count as empty; empty texts are equal to each other; texts are read whole, however long. The row with the
most code points stays, then the smallest doc_id (null last), then the first row read. Repeated rows are rows like
others: one of them stays. An empty table gives no rows; other columns of docs, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, SPACE_CLASS, Batches, discard, row_numbers, text_frame, written

#: Bits by which a bucket may be deeper than the directory's start.
EXTRA = 8
#: Directories up to so many cells are broadcast, larger ones joined.
MOST_BROADCAST = 1 << 20
TASK_BYTES = 48 << 20
#: A task's own texts are held up to this size, then given out.
FOLD_BYTES = 48 << 20
NO_ID = (1 << 63) - 1


def _fold(batches: Batches) -> Batches:
    """Rows (uid, entry, ...) of members, and of entries at the end: those have bytes."""
    held: dict[bytes, list] = {}
    size = start = 0

    def entries() -> pa.RecordBatch:
        rows = list(held.values())
        return _table(
            [r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows], [r[3] for r in rows], [r[4] for r in rows],
            [int.from_bytes(r[6][:8], "big", signed=True) for r in rows], [r[6].hex() for r in rows], [r[7] for r in rows], [r[5] for r in rows],
        )

    for b in batches:
        uids = row_numbers(b.num_rows, start).tolist()
        start += b.num_rows
        own: list[int] = []
        ids = b.column("doc_id").to_pylist()
        for uid, doc, chars, text in zip(uids, ids, b.column("chars").to_pylist(), b.column("text").to_pylist(), strict=True):
            norm = text.translate(None, SPACE)
            order = (-chars, NO_ID if doc is None else doc, uid)
            if (x := held.get(norm)) is None:
                held[norm] = [uid, doc, chars, uid, uid, 1, hashlib.sha256(norm).digest(), norm, order]
                size += len(norm) + 400
                own.append(uid)
            else:
                x[5] += 1
                own.append(x[0])
                if order < x[8]:
                    x[1], x[2], x[3], x[8] = doc, chars, uid, order
        none = [None] * len(uids)
        yield _table(own, ids, none, uids, none, none, none, none, none)
        if size > FOLD_BYTES:
            yield entries()
            held.clear()
            size = 0
    if held:
        yield entries()


_KINDS = {"entry": pa.int64(), "doc_id": pa.int64(), "chars": pa.int64(), "uid": pa.int64(), "first": pa.int64(), "key": pa.int64(), "sha": pa.string(), "norm": pa.binary(), "n": pa.int64()}
_FOLDED = "entry long, doc_id long, chars long, uid long, first long, key long, sha string, norm binary, n long"


def _table(*columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, _KINDS.values(), strict=True)], names=list(_KINDS))


def _leading(key: Column, bits: int) -> Column:
    return F.shiftrightunsigned(key, 64 - bits) if bits else F.lit(0).cast("long")


def directory(entries: DataFrame, bucket_bytes: int) -> tuple[DataFrame, int, int, int]:
    """cell, bucket, depth as a written table; the directory's depth, its cells, and the index's bytes. entries: key, bytes."""
    total = entries.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes")).first()["bytes"]
    start = max(0, math.ceil(math.log2(max(1, total) / bucket_bytes)))
    open_, done, depth = entries, [], start
    while True:
        own = open_.groupBy(_leading(F.col("key"), depth).alias("prefix")).agg(F.sum("bytes").alias("bytes"), F.min("key").alias("a"), F.max("key").alias("b"))
        own = written(own.withColumn("over", (F.col("bytes") > bucket_bytes) & (F.col("a") != F.col("b")) & F.lit(depth < min(start + EXTRA, 63))), "dedup-buckets")
        done.append(own.where("not over").select("prefix", F.lit(depth).alias("depth")))
        over = own.where("over").select("prefix")
        if over.isEmpty():
            break
        open_ = open_.join(over, _leading(F.col("key"), depth) == F.col("prefix"), "left_semi")
        depth += 1
    buckets = done[0]
    for more in done[1:]:
        buckets = buckets.unionByName(more)
    # a bucket of less depth than the directory has several cells; its number is its first cell
    first = F.expr(f"shiftleft(prefix, {depth} - depth)")
    cells = F.sequence(first, first + F.expr(f"shiftleft(1L, {depth} - depth)") - 1)
    table = written(buckets.select(F.explode(cells).alias("cell"), first.alias("bucket"), "depth"), "dedup-directory")
    return table, depth, table.count(), total


def text_sha256(text: Column) -> Column:
    """What the index calls text_sha256, as a column: lowercase hex of the normalised text's digest."""
    return F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), f"{SPACE_CLASS}+", "").cast("binary"), 256)


def _chain(batches: Batches) -> Batches:
    """Entries sorted by key come in; their class, its size and its best row go out when the key has ended."""
    key, chain = None, {}

    def ended() -> list[tuple]:
        out = []
        for members in chain.values():
            best = min(members, key=lambda m: (-m[2], NO_ID if m[1] is None else m[1], m[3]))
            n = sum(m[4] for m in members)
            out += [(m[0], best[1], best[3], n, m[5]) for m in members]
        return out

    for b in batches:
        out: list[tuple] = []
        names = ("entry", "doc_id", "chars", "uid", "n", "sha")
        for k, norm, *row in zip(b.column("key").to_pylist(), b.column("norm").to_pylist(), *(b.column(c).to_pylist() for c in names), strict=True):
            if k != key:
                out += ended()
                key, chain = k, {}
            chain.setdefault(norm, []).append(row)  # compares bytes along the chain of this key
        yield _index(out)
    yield _index(ended())


def _index(rows: list[tuple]) -> pa.RecordBatch:
    parts = list(zip(*rows, strict=True)) or [[]] * 5
    kinds = {"entry": pa.int64(), "keep_id": pa.int64(), "keep_uid": pa.int64(), "group_size": pa.int64(), "text_sha256": pa.string()}
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(parts, kinds.values(), strict=True)], names=list(kinds))


def exact_dedup(docs: DataFrame, bucket_bytes: int = 8 << 20) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row for each row of docs (doc_id: an integer)."""
    frame = text_frame(docs, F.length(F.coalesce(F.col("text"), F.lit(""))).cast("long").alias("chars"))
    frame = frame.withColumn("doc_id", F.col("doc_id").cast("long"))
    folded = written(frame.mapInArrow(_fold, _FOLDED), "dedup-folded")
    members = folded.where("n is null").select("entry", "doc_id", "uid")
    entries = folded.where("n is not null")
    sized = entries.select("key", (F.octet_length("norm") + 64).cast("long").alias("bytes"))
    cells, depth, n_cells, total = directory(sized, bucket_bytes)
    owned = entries.join(F.broadcast(cells) if n_cells <= MOST_BROADCAST else cells, _leading(F.col("key"), depth) == F.col("cell"))
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), total // TASK_BYTES)
    owned = owned.repartition(tasks, "bucket").sortWithinPartitions("bucket", "key")
    index = written(
        owned.select("key", "norm", "entry", "doc_id", "chars", "uid", "n", "sha").mapInArrow(
            _chain, "entry long, keep_id long, keep_uid long, group_size long, text_sha256 string"
        ),
        "dedup-index",
    )
    discard(cells)
    found = members.join(index, "entry")
    return found.select("doc_id", "keep_id", "group_size", (F.col("uid") == F.col("keep_uid")).alias("kept"), "text_sha256")


ORACLE = r"""
with t as (
  select doc_id, length(coalesce(text, '')) as chars, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') as norm from documents
), g as (
  select doc_id, norm, first_value(doc_id) over (partition by norm order by chars desc, doc_id) as keep_id, count(*) over (partition by norm) as group_size from t
)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, sha256(norm) as text_sha256 from g
"""
