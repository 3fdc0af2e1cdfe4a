import re

from evigraph.llm import queries, repetition

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    windows = {}
    for i in range(len(words) - 2):
        windows.setdefault(tuple(words[i : i + 3]), []).append(i)
    inside = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(inside), n < 50 or 100 * len(inside) > 50 * n


def covers(text):
    """Characters of words in repeated windows by length, and of words in repeated lines."""
    words = WORD.findall(text or "")
    out = []
    for n in repetition.COVER_LIMITS:
        windows = {}
        for i in range(len(words) - n + 1):
            windows.setdefault(tuple(words[i : i + n]), []).append(i)
        inside = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(n)}
        out.append(sum(len(words[i]) for i in inside))
    seen, lines = set(), 0
    for line in (text or "").split("\n"):
        if line in seen:
            lines += sum(map(len, WORD.findall(line)))
        elif WORD.search(line):
            seen.add(line)
    return lines, *out


def same_verdict(r, text):
    lines, *own = covers(text)
    assert (r["dup_line_chars"], *(r[f"dup_{n}gram_chars"] for n in repetition.COVER_LIMITS)) == (lines, *own)
    within = all(100 * c <= limit * r["word_chars"] for c, limit in zip(own, repetition.COVER_LIMITS.values(), strict=True))
    assert r["kept"] == (not r["base_failed"] and within and 100 * lines <= repetition.LINE_LIMIT * r["word_chars"])


def base(r):
    return r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]


def test_odd_texts(odd):
    for r, d in zip(repetition.repetition(odd).collect(), odd.collect(), strict=True):
        assert base(r) == brute(d["text"])
        assert not (r["base_failed"] and r["kept"])
        same_verdict(r, d["text"])


def test_query_on_whole_table(spark, small):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    got = queries.op3_repetition(spark, small).collect()
    assert len(got) == len(texts)
    assert all(base(r) == brute(texts[r["doc_id"]]) for r in got)
    for r in got:
        same_verdict(r, texts[r["doc_id"]])
    fine = [r for r in got if not r["base_failed"]]
    assert sum(r["kept"] for r in fine) > 0.9 * len(fine)


def test_verdict(spark):
    clean = " ".join(f"w{i}" for i in range(200))
    loops = " ".join(f"w{i % 12}" for i in range(30)) + " " + " ".join(f"v{i}" for i in range(40))
    lines = ("this very line is found again and again\n" * 12) + " ".join(f"x{i}" for i in range(100))
    rows = spark.createDataFrame([(1, clean), (2, loops), (3, lines)], "doc_id long, text string")
    got = {r["doc_id"]: r["kept"] for r in repetition.repetition(rows).collect()}
    assert got == {1: True, 2: False, 3: False}  # 37 % of the second lie in repeats


def test_repeats_below_the_base_rule(spark):
    """A passage found twice, 43 % of the text, and lines found again, 25 %: the base rule passes both."""
    own = [f"word{i}" for i in range(200)]
    passage = " ".join(own + own[50:104])
    lines = " ".join(own) + "\n" + "\n".join([" ".join(own[:9])] * 9)
    rows = spark.createDataFrame([(1, passage), (2, lines), (3, " ".join(own))], "doc_id long, text string")
    got = {r["doc_id"]: (r["base_failed"], r["kept"]) for r in repetition.repetition(rows).collect()}
    assert got == {1: (False, False), 2: (False, False), 3: (False, True)}


def test_very_long_texts(spark):
    rows = [(1, "lorem ipsum dolor " * 300_000), (2, "x" * 3_000_000), (3, " ".join(f"w{i}" for i in range(300_000))), (4, "\n".join(f"line {i % 7}" for i in range(300_000)))]
    got = {r["doc_id"]: r for r in repetition.repetition(spark.createDataFrame(rows, "doc_id long, text string").repartition(2)).collect()}
    assert {i: (r["n_words"], r["kept"]) for i, r in got.items()} == {1: (900_000, False), 2: (1, False), 3: (300_000, True), 4: (600_000, False)}
    assert got[4]["n_dup_lines"] == 299_993 and got[1]["n_repeat_words"] == 900_000


def test_empty_table(none):
    assert repetition.repetition(none).collect() == []
