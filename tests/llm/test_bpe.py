import hashlib

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from evigraph.llm import bpe, queries

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def expect(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    return ids, library.decode(ids, skip_special_tokens=False)


def test_odd_texts(odd, library):
    got = bpe.encode(odd, PATH).collect()
    texts = [r["text"] for r in odd.collect()]
    assert len(got) == len(texts)
    for r, t in zip(got, texts, strict=True):
        assert (list(r["ids"]), r["decoded"]) == expect(library, t), (t or "")[:60]


def test_decode_operator(odd, spark):
    encoded = bpe.encode(odd, PATH)
    assert sorted(r["text"] for r in bpe.decode(encoded, PATH).collect()) == sorted(r["decoded"] for r in encoded.collect())
    assert [r["text"] for r in bpe.decode(spark.createDataFrame([(1, None), (2, [10**6])], "doc_id long, ids array<int>"), PATH).collect()] == ["", ""]


def test_query_on_whole_table(spark, small, library):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()
    got = {r["doc_id"]: r for r in queries.op1_bpe(spark, small).collect()}
    assert len(got) == len(docs)
    for d in docs:
        ids, decoded = expect(library, d["text"])
        r = got[d["doc_id"]]
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), digest(" ".join(map(str, ids))), digest(decoded))


def test_long_and_short_words_merge_alike():
    t = bpe.WordBpe(PATH)
    for word in ("ab" * 60, "hello" * 40, "zzz" * 50):
        parts = list(word)
        parts[-1] += t.suffix
        long = t._merge_long(list(parts))
        short, t_short = bpe.SHORT, None
        try:
            bpe.SHORT = 10**9
            t_short = t.merge(list(parts))
        finally:
            bpe.SHORT = short
        assert long == t_short


def test_empty_table(none):
    assert bpe.digests(bpe.encode(none, PATH)).collect() == []
