import json
import time

import pytest
from pyspark.sql import functions as F

from evigraph.sources import gold, ontology
from evigraph.streaming import ingest, limits


def term(id_, **more):
    return {"obo_id": id_, "label": f"name of {id_}", **more}


def frame(spark, rows, schema):
    """Rows as JSON records, so that missing fields are null."""
    return spark.createDataFrame([(json.dumps(r),) for r in rows], "j string").select(F.from_json("j", schema).alias("r")).select("r.*")


TERMS = f"id string, terms array<struct<{ontology._nested(ontology.TERM)}>>"


def test_terms_fail_closed(spark):
    responses = [
        {"id": "A", "terms": [term("A", is_obsolete=False), term("B")]}, {"id": "C", "terms": [term("C", is_obsolete=True, term_replaced_by="D")]},
        {"id": "E", "terms": [term("E"), term("E")]}, {"id": "F", "terms": [term("G")]}, {"id": "H", "terms": None}, {"id": "J", "terms": [term("J", is_obsolete=True)]},
    ]
    got = ontology.active_terms(spark.createDataFrame([(x,) for x in "ACEFHIJ"], "id string"), frame(spark, responses, TERMS))
    assert {r["id"]: r["error"] for r in got.collect()} == {
        "A": None, "C": "obsolete term C, replaced by D", "E": "expected one term E", "F": "expected one term F", "H": "expected one term H", "I": "expected one term I", "J": "obsolete term J, replaced by nothing",
    }
    assert got.where("id = 'A'").first()["term"]["label"] == "name of A" and got.where("id = 'C'").first()["term"] is None
    with pytest.raises(ValueError, match="expected one term E; expected one term F"):
        ontology.fail_closed(got, 2)
    assert ontology.fail_closed(got.where("id = 'A'")).columns == ["id", "term"]


def test_only_statements_of_identity_join(spark):
    """Related, broader and untyped names are never exact; a cross-reference without the statement, or to another database, joins nothing."""
    same = ontology.EQUIVALENT
    t = term(
        "M:1", description=["first", "second"], synonyms=["z", "untold", "exact b", "untold"],
        obo_xref=[{"database": "OMIM", "id": "1", "description": same}, {"database": "OMIM", "id": "2", "description": same}, {"database": "Orphanet", "id": "9", "description": same}, {"database": "MEDGEN", "id": "7", "description": "MONDO:relatedTo"}, {"database": "ICD", "id": "5", "description": same}, {"database": "MEDGEN", "id": "8"}],
        obo_synonym=[{"name": "exact b", "scope": "hasExactSynonym"}, {"name": "exact a", "scope": "hasExactSynonym"}, {"name": "exact a", "scope": "hasExactSynonym"}, {"name": "z", "scope": "hasRelatedSynonym"}, {"name": "exact a", "scope": "hasBroadSynonym"}],
    )
    pins = spark.createDataFrame([("d1", "M:1"), ("d1b", "M:1"), ("d2", "M:2"), ("d3", "M:3")], "node_id string, id string")
    got = ontology.disease_nodes(pins, frame(spark, [{"id": "M:1", "terms": [t]}, {"id": "M:2", "terms": [term("M:2")]}], TERMS))
    rows = {r["node_id"]: r for r in got.collect()}
    one = rows["d1"]
    assert one["ext_ids"] == {"MONDO": "M:1", "OMIM": "2", "Orphanet": "9"} and one["synonyms"] == ["exact a", "exact b"] and one["description"] == "first"
    assert [tuple(x) for x in one["other_names"]] == [("exact a", "hasBroadSynonym"), ("z", "hasRelatedSynonym"), ("untold", ontology.UNTYPED)]
    assert tuple(rows["d1b"])[1:] == tuple(one)[1:]
    assert rows["d2"]["ext_ids"] == {"MONDO": "M:2"} and rows["d2"]["synonyms"] == rows["d2"]["other_names"] == [] and rows["d2"]["description"] == ""
    assert rows["d3"]["error"] == "expected one term M:3" and rows["d3"]["ext_ids"] is None
    assert {tuple(r) for r in ontology.annotation_lookup(got).collect()} == {("OMIM:2", "d1"), ("ORPHA:9", "d1"), ("OMIM:2", "d1b"), ("ORPHA:9", "d1b")}


def test_genes_and_variants(spark):
    doc = {"symbol": "S1", "status": "Approved", "name": "gene one", "hgnc_id": "HGNC:12", "entrez_id": "77", "alias_symbol": ["Z", "A", "Z"]}
    docs = [("S1", [doc]), ("S2", [doc]), ("S3", [doc | {"symbol": "S3", "status": "Withdrawn"}]), ("S4", [doc, doc]), ("S5", [doc | {"symbol": "S5", "hgnc_id": "HGNC:x"}]), ("S6", [])]
    responses = frame(spark, [{"asked": s, "docs": d} for s, d in docs], f"asked string, docs array<struct<{ontology._nested(ontology.GENE)}>>")
    genes = ontology.gene_nodes(spark.createDataFrame([(f"S{i}",) for i in range(1, 8)], "symbol string"), responses)
    rows = {r["symbol"]: r for r in genes.collect()}
    assert rows["S1"]["ext_ids"] == {"HGNC": "HGNC:12", "NCBIGene": "77", "Ensembl": ""} and rows["S1"]["synonyms"] == ["A", "Z", "gene one"] and rows["S1"]["error"] is None
    assert {s: r["error"].split(" ")[0] for s, r in rows.items() if r["error"]} == {"S2": "unapproved", "S3": "unapproved", "S4": "expected", "S5": "no", "S6": "expected", "S7": "expected"}

    fine = {"uid": "42", "accession_version": "VCV000000042.3", "title": "a variant", "protein_change": "R1W", "genes": [{"symbol": "S1", "geneid": "77"}], "germline_classification": {"description": "Pathogenic"}}
    cases = {
        None: [fine, fine | {"expected_symbol": "S1", "protein_change": ""}],
        "accession of another record": [fine | {"accession_version": "VCV000000043.3"}, fine | {"accession_version": "VCV42"}, fine | {"uid": "042"}, fine | {"accession_version": None}],
        "no title": [fine | {"title": " "}],
        "another gene": [fine | {"genes": []}, fine | {"genes": fine["genes"] * 2}, fine | {"genes": [{"symbol": "S1", "geneid": "78"}]}, fine | {"expected_symbol": "S9"}, fine | {"genes": [{"symbol": "S5", "geneid": "77"}]}],
    }
    for error, own in cases.items():
        got = ontology.variant_nodes(frame(spark, own, ontology.VARIANT + ", expected_symbol string"), genes).collect()
        assert [r["error"] for r in got] == [error] * len(own), error
        if error is None:
            assert (got[0]["id"], got[0]["gene"], got[0]["classification"]) == ("var_clinvar_42", "S1", "Pathogenic") and sorted(map(tuple, (r["synonyms"] for r in got))) == [(), ("R1W",)]
    asked = spark.createDataFrame([(x,) for x in "abcd"], "uid string")
    back = spark.createDataFrame([("a", "a"), ("b", "x"), ("c", "c"), ("c", "c"), ("e", "e")], "uid string, record_uid string")
    assert {tuple(r) for r in ontology.response_errors(asked, back).collect()} == {("b", "another record"), ("c", "returned twice"), ("d", "missing"), ("e", "not asked for")}


CLAIM = {"subject_type": "disease", "subject": "S", "relation": "disease_gene", "object_type": "gene", "object": "G", "effect": "not_applicable", "stance": "supports", "quote": "a Verbatim  quote"}


def test_gold_lines_by_number(spark, tmp_path):
    """Files in many splits: every line has its number, bad ones their error, a key that comes again the line of the first."""
    lines = [json.dumps({"pmid": str(i), "claims": [CLAIM]}) if i % 7 else "" for i in range(1, 400)]
    lines[10], lines[20], lines[30], lines[350] = "{broken", json.dumps({"claims": []}), json.dumps({"pmid": " "}), json.dumps({"pmid": "5", "claims": []})
    (tmp_path / "a.jsonl").write_text("\n".join(lines) + "\n")
    (tmp_path / "b.jsonl").write_text("\n\n" + json.dumps({"pmid": "5", "draft": True}) + "\n[1]\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000b")
    try:
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 5
        got = gold.gold_records(spark, str(tmp_path))
        rows = {(r["file"].rsplit("/", 1)[1], r["line"]): r for r in got.collect()}
        all_lines = {(r["file"].rsplit("/", 1)[1], r["line"]): r["value"] for r in gold.numbered_lines(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert all_lines == {("a.jsonl", i): t for i, t in enumerate(lines, 1)} | {("b.jsonl", 1): "", ("b.jsonl", 2): "", ("b.jsonl", 3): json.dumps({"pmid": "5", "draft": True}), ("b.jsonl", 4): "[1]"}
    assert {k for k in rows if k[0] == "a.jsonl"} == {("a.jsonl", i) for i, t in enumerate(lines, 1) if t}
    errors = {k: r["error"] for k, r in rows.items() if r["error"]}
    assert errors.pop(("b.jsonl", 4)) in ("not a valid record", "missing pmid")
    assert errors == {("a.jsonl", 11): "not a valid record", ("a.jsonl", 21): "missing pmid", ("a.jsonl", 31): "missing pmid", ("a.jsonl", 351): "same as line 5 of a.jsonl", ("b.jsonl", 3): "same as line 5 of a.jsonl"}
    assert all(rows["a.jsonl", i]["record"]["pmid"] == str(i) for i in (1, 6, 200, 399 - 399 % 7 - 1) if ("a.jsonl", i) in rows and i not in (11, 21, 31, 351))


def test_claims_that_cannot_be_used(spark, tmp_path):
    text = "There is a verbatim quote here."
    bad = {
        "unknown relation: r": {"relation": "r"}, "unknown effect: e": {"effect": "e"}, "unknown stance: s": {"stance": "s"}, "the quote is a placeholder": {"quote": "<quote>"}, "the quote is not in the text": {"quote": "verbatim  quotes"},
        "a mechanism has an effect, unknown if the text does not say": {"relation": "disease_mechanism"}, "only a mechanism has an effect": {"effect": "unknown"}, "missing or empty: subject, quote": {"subject": " ", "quote": None, "stance": "s"},
    }
    claims = [CLAIM, *[CLAIM | b for b in bad.values()]]
    (tmp_path / "g.jsonl").write_text("\n".join(json.dumps(r) for r in [{"pmid": "1", "claims": claims}, {"pmid": "2", "claims": [CLAIM]}, {"pmid": "1", "draft": True}, {"claims": []}]))
    got = gold.claim_errors(gold.gold_records(spark, str(tmp_path)), spark.createDataFrame([("1", text)], "pmid string, text string"))
    errors = {(r["line"], r["claim"], r["error"]) for r in got.collect()}
    want = {(1, i, e) for i, e in enumerate(bad, 2)} | {(1, 3, "only a mechanism has an effect")}
    want |= {(2, None, "no text to check quotes against"), (3, None, "same as line 1 of g.jsonl"), (3, None, "still a draft"), (3, None, "claims must be a list"), (4, None, "missing pmid")}
    assert errors == want


def test_records_are_taken_in_once(spark, tmp_path):
    """Again the same content, in one batch, in a later one, and in a batch that is run again after its driver was lost."""
    root, source = str(tmp_path / "root"), str(tmp_path / "in")
    rows = [(1, "a", None), (2, "b", ""), (1, "a", None), (3, "ab", "c"), (4, "a", "bc")]
    schema = "id long, x string, y string"
    put = lambda r: spark.createDataFrame(r, schema).coalesce(1).write.mode("append").parquet(source)
    run = lambda: ingest.ingest(spark.readStream.schema(schema).parquet(source), root, str(tmp_path / "check"), ["x", "y"]).awaitTermination()
    have = lambda: sorted((r["id"], r["x"], r["y"]) for r in ingest.taken_in(spark, root, schema).collect())
    put(rows)
    run()
    first = [(1, "a", None), (2, "b", ""), (3, "ab", "c"), (4, "a", "bc")]
    assert have() == first
    put([(9, "a", None), (5, "b", None), (6, "new", "n")])
    run()
    assert have() == sorted([*first, (5, "b", None), (6, "new", "n")])
    ingest.take_in(spark.createDataFrame([(9, "a", None), (5, "b", None), (6, "new", "n")], schema), 1, root, ["x", "y"])
    assert have() == sorted([*first, (5, "b", None), (6, "new", "n")])
    (tmp_path / "root" / "batch=7").mkdir()
    (tmp_path / "root" / "batch=7" / "part-0.parquet").write_bytes(b"half")
    assert len(have()) == 6


def test_a_version_is_put_in_place_in_one_step(spark, tmp_path):
    root = str(tmp_path / "table")
    with pytest.raises(FileNotFoundError):
        ingest.current(spark, root)
    ingest.publish(spark.range(3), root, "d1")
    assert ingest.publish(spark.range(99), root, "d1").endswith("version-00000001-d1") and ingest.current(spark, root).count() == 3
    spark.range(50).write.parquet(f"{root}/version-00000002-lost")  # a writer that was lost before its rename
    (tmp_path / "table" / "pointer-00000002-lost.aside").write_text("version-00000002-lost lost")
    assert ingest.current(spark, root).count() == 3
    ingest.publish(spark.range(7), root, "d2")
    assert ingest.current(spark, root).count() == 7
    (tmp_path / "table" / "pointer-00000003").write_text("version-00000002-d2 d2")
    (tmp_path / "table" / "pointer-00000004").write_text("version-00000001-d1 d1")
    assert ingest.current(spark, root).count() == 3


def brute_cache(rows, seconds, most):
    caches, out = {}, {}
    for e, c, k, t in sorted(rows, key=lambda r: (r[1], r[3], r[0])):
        held = caches.setdefault(c, [])  # [key, until], first in first
        mine = next((x for x in held if x[0] == k), None)
        out[e] = mine is not None and mine[1] > t
        if not out[e]:
            if len(held) >= most:
                if held.pop(0) is mine:
                    mine = None
            if mine is None:
                held.append([k, t + seconds])
            else:
                mine[1] = t + seconds
    return out


def test_ttl_cache_on_a_table_and_on_a_stream(spark, tmp_path):
    """Against a list of entries: they run out, the first goes when there are too many, batches go on where the last ended."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = [(i, i % 2, f"k{(i * i + i // 9) % (5 + i % 4)}", 1_700_000_000 + 7 * i + i % 5) for i in range(240)]
    events = spark.createDataFrame(rows, "event_id long, cache long, key string, t long").selectExpr("event_id", "cache", "key", "timestamp_seconds(t) as ts")
    for seconds, most in ((60.0, 3), (300.0, 100), (25.0, 1)):
        want = brute_cache(rows, seconds, most)
        assert {r["event_id"]: r["hit"] for r in limits.ttl_cache(events, seconds, most).collect()} == want and 0 < sum(want.values()) < 240
    for k in range(3):
        events.where(F.col("event_id").between(80 * k, 80 * k + 79)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run = limits.ttl_cached(stream, 60.0, 3).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).start()
    for _ in range(120):
        if sum(p["numInputRows"] for p in run.recentProgress) >= 240 or not run.isActive:
            break
        time.sleep(1)
    run.stop()
    assert {r["event_id"]: r["hit"] for r in spark.read.parquet(str(tmp_path / "out")).collect()} == brute_cache(rows, 60.0, 3)
