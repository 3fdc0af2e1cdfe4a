import hashlib
import re

from evigraph.llm import exact_dedup, queries


def norm(text):
    return re.sub(r"[\x20\x09-\x0D]", "", text or "")


def brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(norm(t), []).append((i, t or ""))
    best = {k: min(g, key=lambda r: (-len(r[1]), 1 << 63 if r[0] is None else r[0])) for k, g in groups.items()}
    return sorted(
        ((i, best[norm(t)][0], len(groups[norm(t)]), hashlib.sha256(norm(t).encode()).hexdigest()) for i, t in rows), key=str
    )


def got(df):
    return sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in df), key=str)


def test_odd_texts(odd):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    out = exact_dedup.exact_dedup(odd).collect()
    assert got(out) == brute(rows)
    assert sum(r["kept"] for r in out) == len({norm(t) for _, t in rows})


def test_many_small_buckets(odd):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert got(exact_dedup.exact_dedup(odd.repartition(5), bucket_bytes=200).collect()) == brute(rows)


def test_directory_splits_and_doubles(spark):
    top = lambda x, bits: (x % (1 << 64)) >> (64 - bits) if bits else 0
    keys = [((i * 0x9E3779B97F4A7C15) % (1 << 64)) for i in range(1000)] + [5 << 40 | i for i in range(300)] + [7] * 50
    entries = spark.createDataFrame([(k - (1 << 64) if k >= 1 << 63 else k, 100) for k in keys], "key long, bytes long")
    cells, depth, n, total = exact_dedup.directory(entries, 20_000)
    rows = {r["cell"]: (r["bucket"], r["depth"]) for r in cells.collect()}
    assert total == 100 * len(keys) and 3 < depth <= 3 + exact_dedup.EXTRA and n == len(rows)
    size = {}
    for k in keys:
        bucket, d = rows[top(k, depth)]
        assert bucket == top(k, d) << (depth - d)
        size[bucket, d] = size.get((bucket, d), 0) + 100
    assert all(v <= 20_000 or d == 3 + exact_dedup.EXTRA for (_, d), v in size.items())
    assert len({d for _, d in size}) > 1  # some buckets are deeper than others


def test_very_long_texts(spark):
    rows = [(1, "x" * 3_000_000), (2, "x" * 3_000_000 + "\n"), (3, "y z" * 1_000_000), (4, " " * 2_000_000), (5, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(exact_dedup.exact_dedup(docs, bucket_bytes=1000).collect()) == brute(rows)


def test_collisions_are_told_apart_by_bytes():
    import pyarrow as pa

    rows = {"key": [1, 1, 1], "norm": [b"a", b"b", b"a"], "entry": [10, 11, 12], "doc_id": [3, 4, 2], "chars": [1, 1, 1], "uid": [10, 11, 12], "n": [1, 2, 3], "sha": ["x", "y", "x"]}
    out = pa.Table.from_batches(list(exact_dedup._chain(iter([pa.RecordBatch.from_pydict(rows)])))).to_pylist()
    assert sorted((r["entry"], r["keep_id"], r["group_size"]) for r in out) == [(10, 2, 4), (11, 4, 2), (12, 2, 4)]


def test_query_on_whole_table(spark, small):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    assert got(queries.op6_exact_dedup(spark, small).collect()) == brute(rows)


def test_empty_table(none):
    assert exact_dedup.exact_dedup(none).collect() == []
