from collections import Counter

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from evigraph.llm import toxicity

from .test_exact_dedup import norm
from .test_near_dedup import brute


def test_stages_against_brute_force(spark, tiny, tmp_path):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    columns, seen = docs.columns, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = str(tmp_path / str(k))
        stage(spark, docs, tiny).write.parquet(out)
        after = spark.read.parquet(out)
        seen[name] = (docs.collect(), after.collect())
        if name != "bpe":
            assert after.columns == columns
        docs = after
    before, after = seen["toxicity"]
    rejected = {r["doc_id"] for r in toxicity.classify(spark.read.parquet(f"{tiny}/documents.parquet"), spark.read.parquet(f"{tiny}/labels.parquet")).where("predicted = 1").collect()}
    assert {r["doc_id"] for r in before} - {r["doc_id"] for r in after} == rejected and rejected
    before, after = seen["exact dedup"]
    best = {}
    for r in before:
        order = (-len(r["text"] or ""), r["doc_id"])
        best[norm(r["text"])] = min(best.get(norm(r["text"]), order), order)
    assert sorted(r["doc_id"] for r in after) == sorted(i for _, i in best.values())
    before, after = seen["near dedup"]
    roots = brute([(r["doc_id"], r["text"]) for r in before], 5, 80)
    assert sorted(r["doc_id"] for r in after) == sorted(i for i, (_, root) in roots.items() if i == root)
    before, after = seen["mixing"]
    rows, many = {r["doc_id"]: r for r in before}, Counter(r["doc_id"] for r in after)
    assert set(many) <= set(rows) and max(many.values()) <= 3 and all(tuple(r) == tuple(rows[r["doc_id"]]) for r in after)
    before, after = seen["bpe"]
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    library.no_truncation()
    texts = {r["doc_id"]: r["text"] or "" for r in before}
    assert len(after) == len(before)
    assert all(list(r["ids"]) == library.encode(texts[r["doc_id"]], add_special_tokens=False).ids for r in after)


def test_stages_with_odd_documents(spark, odd, none, tiny, tmp_path):
    for at, rows in (("odd", odd), ("none", none)):
        docs = rows
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            stage(spark, docs, tiny).write.parquet(str(tmp_path / f"{at}{k}"))
            docs = spark.read.parquet(str(tmp_path / f"{at}{k}"))
            assert name == "bpe" or docs.columns == rows.columns
        assert (docs.count() == 0) == (at == "none")
