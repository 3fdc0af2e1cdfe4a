import public_tokenizers
import pytest

from evigraph.llm import queries, token_counts

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


def brute(fields, rule, by):
    """(field, section) -> tokens, token by token and character by character."""
    enc, lengths = token_counts.encoding(PATH)
    text = "".join(fields)
    of_byte = [i for i, c in enumerate(text) for _ in c.encode()]
    owner, sizes = [], {}
    for k, f in enumerate(fields):
        section = 0
        sizes[k, 0] = 0
        for i, c in enumerate(f):
            owner.append((k, section))
            broken = c == "\n" and (by == "line" or (f[max(0, i - 1) : i + 1] == "\n\n" and f[i + 1 : i + 2] != "\n")) and by != "field"
            if broken and i + 1 < len(f):
                section += 1
                sizes[k, section] = 0
    at = 0
    for n in lengths[enc.encode_ordinary(text)].tolist():
        chars = sorted(set(of_byte[at : at + n]))
        owners = [owner[c] for c in chars]
        best = owners[0] if rule == "first" else owners[-1] if rule == "last" else max(dict.fromkeys(owners), key=owners.count)
        sizes[best] += 1
        at += n
    return sizes


TEXTS = ["", "one\n\n\ntwo three\nfour", "\n", "a\n\n b\n\n\n\nüß 漢字 𝔘\n ", " x", "don't\n\n\n\n   stop\n\n", "naïve " * 30 + "\n" * 5 + "end"]


@pytest.mark.parametrize("by", token_counts.SECTIONS)
@pytest.mark.parametrize("rule", token_counts.RULES)
def test_fields_and_sections(spark, rule, by):
    rows = [(i, a, b, "other") for i, (a, b) in enumerate((a, b) for a in TEXTS for b in TEXTS)]
    docs = spark.createDataFrame([*rows, (None, None, None, "x")], "doc_id long, text string, `a.b` string, section string").repartition(3)
    got = {}
    for r in token_counts.token_counts(docs, PATH, rule, by, ("text", "a.b")).collect():
        got.setdefault(r["doc_id"], {})[("text", "a.b").index(r["field"]), r["section"]] = r["n_tokens"]
    assert got[None] == {(0, 0): 0, (1, 0): 0}
    for i, a, b, _ in rows:
        assert got[i] == brute((a, b), rule, by), (a, b)


def test_very_long_texts(spark):
    enc, _ = token_counts.encoding(PATH)
    for gap in (" " * 1999, " " * 2000, "\n" * 2001, "\t 　" * 900):  # short enough for the encoder's own pattern
        for text in (gap, f"{gap}a", f"a{gap}", f"a{gap}b{gap}", f"a{gap}\nb", f".{gap}'s"):
            assert token_counts.encode(enc, text) == enc.encode_ordinary(text)
    long = [" " * 1_200_000, "\n" * 2_000_000, "x" * 2_000_000, "a b\n" * 500_000, f"a{' ' * 2_000_000}b"]
    docs = spark.createDataFrame(list(enumerate(long)), "doc_id long, text string")
    rows = token_counts.token_counts(docs, PATH).groupBy("doc_id").sum("n_tokens").collect()
    for i, n in rows:
        assert enc.decode(ids := token_counts.encode(enc, long[i])) == long[i] and len(ids) == n


def test_sections_add_up(odd):
    for rule in ("first", "last"):
        by = {}
        for r in token_counts.token_counts(odd, PATH, rule).collect():
            by.setdefault((r["doc_id"], r["doc_tokens"]), []).append(r)
        for (_, total), rows in by.items():
            one = [r for r in rows if r["section"] == 0]
            assert sum(r["n_tokens"] for r in rows) == total * len(one)


def test_query_on_whole_table(spark, tiny):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()}
    got, spans = {}, {}
    for r in queries.op5_token_counts(spark, tiny).collect():
        got.setdefault(r["doc_id"], {})[0, r["section"]] = r["n_tokens"]
        spans.setdefault(r["doc_id"], []).append((r["start_char"], r["end_char"]))
    assert set(got) == set(docs)
    for i, t in docs.items():
        assert got[i] == brute((t,), "first", "line")
        s = sorted(spans[i])
        assert s[0][0] == 0 and s[-1][1] == len(t) and all(a[1] == b[0] for a, b in zip(s, s[1:]))


def test_empty_table(none):
    assert token_counts.token_counts(none, PATH).collect() == []
