"""Claims against small hand-made tables."""

import re
import time
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from evigraph.operators import claims
from evigraph.plans import catalogue
from evigraph.sources import annotations, articles
from evigraph.streaming import limits

HEADER = "database_id\tqualifier\thpo_id\treference\tevidence\taspect\n"


def test_terms_longest_first_without_overlap(spark):
    terms = spark.createDataFrame([("gene",), ("gene therapy",), ("therapy trial",), ("trial",), (None,)], "term string")
    questions = spark.createDataFrame([(1, "Gene-therapy trial, gene?"), (2, ""), (3, None), (4, "nothing here")], "key int, text string")
    got = {tuple(r) for r in claims.spot_terms(questions, terms, "key").collect()}
    assert got == {(1, "gene", 0), (1, "therapy trial", 1), (1, "gene", 3)}  # the longest in characters comes first
    assert claims.spot_terms(questions, terms.where("false"), "key").collect() == []


def test_quote_locators(spark):
    rows = spark.createDataFrame([("b c", "a b c b c"), (" b", "a b"), ("", "a"), (None, "a"), ("x", "a"), ("w " * 25 + "w", "w " * 30), ("b", None)], "quote string, text string")
    got = [(r.valid, r.start, r.end) for r in claims.quote_locators(rows).collect()]
    assert got == [(True, 2, 5), (False, None, None), (False, None, None), (False, None, None), (True, None, None), (False, None, None), (True, None, None)]


def test_shares_of_nothing_and_of_small_parts(spark):
    rows = spark.createDataFrame([("a", 995), ("b", 5)], "k string, v long")
    assert [tuple(r) for r in claims.shares(rows, "k", "v").orderBy("k").collect()] == [("a", 995, 0.995, 0.0, "100%"), ("b", 5, 0.005, 0.995, "<1%")]
    assert claims.shares(rows.where("false"), "k", "v").collect() == []


def test_annotations(spark, tmp_path):
    path = tmp_path / "a.tsv"
    path.write_text("#version: 2\n#site: http://x/y\n" + HEADER + "D:1\t\tHP:1\tR\tE\tP\nD:1\tNOT\tHP:2\tR\tE\tP\nD:1\t\tHP:3\tR\tE\tI\nD:2\t\tHP:1\tR\tE\tP\n")
    assert {tuple(r) for r in annotations.annotation_metadata(spark, str(path)).collect()} == {("version", "2"), ("site", "http://x/y")}
    wanted = spark.createDataFrame([("D:1",)], "disease string")
    got = annotations.annotations(spark, str(path), wanted).select("disease", "phenotype", "stance").collect()
    assert {tuple(r) for r in got} == {("D:1", "HP:1", "supports"), ("D:1", "HP:2", "contradicts")}
    path.write_text(HEADER + "D:1\tMAYBE\tHP:1\tR\tE\tP\n")
    with pytest.raises(Exception, match="MAYBE"):
        annotations.annotations(spark, str(path)).collect()


def test_spotted_terms_of_a_table(spark, tiny):
    """Against each question read word by word."""
    clean = lambda t: re.sub("[^a-z0-9]+", " ", (t or "").lower()).strip().split()
    terms = set()
    for r in spark.read.parquet(f"{tiny}/benchmark.parquet").collect():
        w = r["text"].split(" ")
        terms |= {tuple(clean(w[0])), tuple(clean(" ".join(w[:2])))}
    terms = sorted((t for t in terms if t), key=lambda t: (-len(" ".join(t)), t))
    want = set()
    for r in spark.read.parquet(f"{tiny}/conversations.parquet").collect():
        words, taken = clean(r["text"]), set()
        hits = sorted((-len(" ".join(t)), i, t) for t in terms for i in range(len(words) - len(t) + 1) if tuple(words[i : i + len(t)]) == t)
        for _, i, t in hits:
            if not taken & set(range(i, i + len(t))):
                taken |= set(range(i, i + len(t)))
                want.add((r["conv_id"], r["turn"], " ".join(t), i))
    assert {tuple(r) for r in catalogue.QUERIES["spotted_terms"](spark, tiny).collect()} == want


def test_most_similar_names_of_a_table(spark, tiny):
    names = {r["p_name"] for r in spark.read.parquet(f"{tiny}/part.parquet").collect()}
    got = {}
    for r in catalogue.QUERIES["difflib_topk"](spark, tiny).collect():
        got.setdefault(r["phrase"], []).append((r["name"], r["ratio"]))
    for phrase, rows in got.items():
        want = sorted(((n, SequenceMatcher(None, phrase, n).ratio()) for n in names), key=lambda x: (-x[1], x[0]))[:5]
        assert sorted(rows) == sorted(want)


def test_candidates_of_claims(spark):
    edges = spark.createDataFrame([("d", "rel", x) for x in "abc"] + [("e", "rel", "a")], "src string, type string, dst string")
    nodes = spark.createDataFrame([("a", "Gain of function"), ("b", "Loss of function"), ("c", "Other")], "id string, name string")
    claimed = spark.createDataFrame([("d", "rel", "gain of functions"), ("x", "rel", "y")], "subject string, relation string, text string")
    rows = claims.candidates(claimed, edges, nodes, 2).orderBy("place").collect()
    assert [(r.node_id, r.place) for r in rows] == [("a", 1), ("b", 2)] and rows[0].ratio > rows[1].ratio


XML = b"""<PubmedArticleSet><PubmedArticle><MedlineCitation><PMID>12</PMID><Article><ArticleTitle>A <i>gene</i> x</ArticleTitle>
<Abstract><AbstractText>One <b>two</b>.</AbstractText><AbstractText>Three.</AbstractText></Abstract>
<AuthorList><Author><LastName>Roe</LastName><Initials>J</Initials></Author><Author><CollectiveName>Group</CollectiveName></Author><Author/></AuthorList></Article></MedlineCitation></PubmedArticle>
<PubmedArticle><MedlineCitation><PMID>x</PMID></MedlineCitation></PubmedArticle>
<PubmedBookArticle><BookDocument><PMID>7</PMID><ArticleTitle>Chapter</ArticleTitle></BookDocument></PubmedBookArticle></PubmedArticleSet>"""


def test_article_records(spark):
    files = spark.createDataFrame([("f1", bytearray(XML))], "path string, content binary")
    rows = articles.articles(files).collect()
    assert [tuple(r) for r in rows] == [
        ("f1", "12", "A gene x", "One two. Three.", ["J Roe", "Group"], "https://pubmed.ncbi.nlm.nih.gov/12/"), ("f1", "7", "Chapter", "", [], "https://pubmed.ncbi.nlm.nih.gov/7/"),
    ]
    with pytest.raises(Exception, match="no such id"):
        articles.articles(spark.createDataFrame([("f", bytearray(b"<a><ERROR>no such id</ERROR></a>"))], "path string, content binary")).collect()


def test_rate_limit_on_a_stream(spark, tmp_path):
    """Batches of a stream end where the ordered fold over all events does."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = [(i, i % 3, f"2024-01-01 00:{i // 4:02d}:{i * 7 % 60:02d}") for i in range(160)]
    rows.sort(key=lambda r: r[2])
    events = spark.createDataFrame([(k, u, t) for k, (_, u, t) in enumerate(rows)], "event_id long, user_id long, t string").selectExpr("event_id", "user_id", "cast(t as timestamp) as ts")
    for k in range(3):
        events.where(F.col("event_id").between(60 * k, 60 * k + 59)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run = limits.rate_limited(stream, 30.0).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).start()
    for _ in range(90):  # batches without data follow for ever, so that state can expire
        if sum(p["numInputRows"] for p in run.recentProgress) >= 160:
            break
        time.sleep(1)
    run.stop()
    got = {r["event_id"]: r["accepted"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {r["event_id"]: r["accepted"] for r in limits.rate_limit(events, 30.0).collect()}
