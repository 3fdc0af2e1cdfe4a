"""Ontology slices: terms, genes and variants from nested source records, taken only if their identity is beyond doubt.

Each function takes what was asked for and what came back, and gives a row for each request with an error or null;
nothing substituted, obsolete, ambiguous or missing gets through. fail_closed() turns errors into an exception.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TERM = (
    "obo_id string, label string, is_obsolete boolean, term_replaced_by string, description array<string>, synonyms array<string>, "
    "obo_xref array<struct<database:string,id:string,description:string>>, obo_synonym array<struct<name:string,scope:string>>"
)
GENE = "symbol string, status string, name string, hgnc_id string, entrez_id string, ensembl_gene_id string, alias_symbol array<string>, date_modified string"
VARIANT = (
    "uid string, accession_version string, title string, protein_change string, genes array<struct<symbol:string,geneid:string>>, "
    "germline_classification struct<description:string,review_status:string,last_evaluated:string>, molecular_consequence_list array<string>"
)
# The statement that makes a mapping an identity, the databases that it may join, the scope of an exact name.
EQUIVALENT, JOINED, EXACT = "MONDO:equivalentTo", ("Orphanet", "OMIM", "MEDGEN"), "hasExactSynonym"
UNTYPED = "untyped_in_ols_response"


def _none(kind: str) -> Column:
    return F.array().cast(f"array<{kind}>")


def active_terms(asked: DataFrame, responses: DataFrame) -> DataFrame:
    """id, term, error: the one term of each response that has the id asked for and is not obsolete. asked: id (once); responses: id, terms."""
    own = asked.select("id").join(responses.select("id", "terms"), "id", "left")
    own = own.withColumn("hits", F.filter(F.coalesce("terms", _none(f"struct<{_nested(TERM)}>")), lambda t: t["obo_id"] == F.col("id")))
    term = F.get("hits", F.lit(0))
    error = F.when(F.size("hits") != 1, F.concat(F.lit("expected one term "), "id")).when(
        F.coalesce(term["is_obsolete"], F.lit(False)), F.concat(F.lit("obsolete term "), "id", F.lit(", replaced by "), F.coalesce(term["term_replaced_by"], F.lit("nothing")))
    )
    return own.withColumn("error", error).select("id", F.when(F.col("error").isNull(), term).alias("term"), "error")


def _nested(schema: str) -> str:
    """'a string, b array<x>' as the fields of a struct."""
    return ", ".join(f"{name}: {kind}" for name, kind in (f.split(" ", 1) for f in schema.split(", ")))


def exact_ids(term: Column) -> Column:
    """A term's own id and those of records that are stated to be the same; the last statement for a database holds."""
    same = F.filter(F.coalesce(term["obo_xref"], _none("struct<database:string,id:string,description:string>")), lambda x: (x["description"] == EQUIVALENT) & x["database"].isin(*JOINED) & x["id"].isNotNull())
    rows = [F.struct(F.lit("MONDO").alias("key"), term["obo_id"].alias("value"))]
    for d in JOINED:
        rows.append(F.struct(F.lit(d).alias("key"), F.try_element_at(_of(same, d), F.lit(-1))["id"].alias("value")))
    return F.map_from_entries(F.filter(F.array(*rows), lambda e: e["value"].isNotNull()))


def _of(xrefs: Column, database: str) -> Column:
    return F.filter(xrefs, lambda x: x["database"] == database)


def aliases(term: Column) -> tuple[Column, Column]:
    """A term's exact names in order, and its other names as structs of name and scope; no related, broader or narrower name is ever exact.

    Spellings that the response lists without a scope are kept apart as untyped.
    """
    scoped = F.array_distinct(F.coalesce(term["obo_synonym"], _none("struct<name:string,scope:string>")))
    exact = F.array_sort(F.array_distinct(F.transform(F.filter(scoped, lambda s: s["scope"] == EXACT), lambda s: s["name"])))
    others = F.array_sort(F.transform(F.filter(scoped, lambda s: F.coalesce(s["scope"] != EXACT, F.lit(True))), lambda s: F.struct(s["scope"].alias("scope"), s["name"].alias("name"))))
    others = F.transform(others, lambda s: F.struct(s["name"].alias("name"), s["scope"].alias("scope")))
    known = F.transform(scoped, lambda s: s["name"])
    untyped = F.array_sort(F.array_except(F.coalesce(term["synonyms"], _none("string")), known))
    return exact, F.concat(others, F.transform(untyped, lambda n: F.struct(n.alias("name"), F.lit(UNTYPED).alias("scope"))))


def disease_nodes(pins: DataFrame, responses: DataFrame) -> DataFrame:
    """node_id, name, synonyms, other_names, ext_ids, description, error of each pinned disease. pins: node_id, id (of the term); responses: id, terms."""
    found = active_terms(pins.select("id").distinct(), responses)
    exact, others = aliases(F.col("term"))
    said = found.select("id", F.col("term.label").alias("name"), exact.alias("synonyms"), others.alias("other_names"), exact_ids(F.col("term")).alias("ext_ids"), F.coalesce(F.get("term.description", F.lit(0)), F.lit("")).alias("description"), "error")
    none = lambda c: F.when(F.col("error").isNull(), F.col(c)).alias(c)
    return pins.select("node_id", "id").join(said, "id").select("node_id", *[none(c) for c in ("name", "synonyms", "other_names", "ext_ids", "description")], "error")


def annotation_lookup(diseases: DataFrame) -> DataFrame:
    """database_id, node_id: the ids under which annotations of the diseases are found; by statements of identity alone."""
    ids = diseases.where("error IS NULL").select("node_id", F.explode("ext_ids").alias("k", "v")).where(F.col("k").isin("OMIM", "Orphanet"))
    return ids.select(F.concat(F.when(F.col("k") == "Orphanet", "ORPHA").otherwise(F.col("k")), F.lit(":"), "v").alias("database_id"), "node_id")


def gene_nodes(asked: DataFrame, responses: DataFrame) -> DataFrame:
    """symbol, ext_ids, synonyms, error: the one approved record of each symbol. asked: symbol (once); responses: asked (a symbol), docs (structs of GENE)."""
    own = asked.select("symbol").join(responses.select(F.col("asked").alias("symbol"), "docs"), "symbol", "left")
    doc = F.get("docs", F.lit(0))
    bad_id = ~F.coalesce(doc["hgnc_id"].rlike(r"^HGNC:[0-9]+\z") & doc["entrez_id"].rlike(r"^[0-9]+\z"), F.lit(False))
    error = (
        F.when(F.coalesce(F.size("docs"), F.lit(-1)) != 1, F.concat(F.lit("expected one record of "), "symbol"))
        .when(~F.coalesce((doc["symbol"] == F.col("symbol")) & (doc["status"] == "Approved"), F.lit(False)), F.concat(F.lit("unapproved or other record for "), "symbol"))
        .when(bad_id, F.concat(F.lit("no gene identifier for "), "symbol"))
    )
    ids = F.create_map(F.lit("HGNC"), doc["hgnc_id"], F.lit("NCBIGene"), doc["entrez_id"], F.lit("Ensembl"), F.coalesce(doc["ensembl_gene_id"], F.lit("")))
    names = F.array_sort(F.array_distinct(F.array_compact(F.concat(F.coalesce(doc["alias_symbol"], _none("string")), F.array(doc["name"])))))
    own = own.withColumn("error", error)
    return own.select("symbol", F.when(F.col("error").isNull(), ids).alias("ext_ids"), F.when(F.col("error").isNull(), names).alias("synonyms"), "error")


def response_errors(asked: DataFrame, returned: DataFrame) -> DataFrame:
    """uid, error: ids that are missing from the responses, came twice, were not asked for, or whose record says another id. asked: uid; returned: uid, record_uid."""
    n = returned.groupBy("uid").agg(F.count("*").alias("n"), F.coalesce(F.bool_and(F.col("record_uid") == F.col("uid")), F.lit(False)).alias("same"))
    both = asked.select("uid", F.lit(True).alias("wanted")).distinct().join(n, "uid", "full")
    error = (
        F.when(F.col("wanted").isNull(), "not asked for").when(F.col("n").isNull(), "missing").when(F.col("n") > 1, "returned twice").when(~F.col("same"), "another record")
    )
    return both.select("uid", error.alias("error")).where("error IS NOT NULL")


def variant_nodes(records: DataFrame, genes: DataFrame) -> DataFrame:
    """id, name, synonyms, ext_ids, gene, classification, error of each record (of VARIANT, and expected_symbol, null: any).

    The accession must be the record's own, the title not blank, and the one gene must be that of the slice: by its symbol
    and by its number. genes: of gene_nodes(). Clinical significance is never taken for an effect.
    """
    number = F.regexp_extract("accession_version", r"^VCV([0-9]+)\.[1-9][0-9]*\z", 1)
    same = F.col("uid").rlike(r"^[1-9][0-9]*\z") & (number != "") & (F.regexp_replace(number, "^0+", "") == F.col("uid"))
    own = records.withColumn("_gene", F.when(F.size("genes") == 1, F.get("genes", F.lit(0))))
    known = genes.where("error IS NULL").select(F.col("symbol").alias("_symbol"), F.col("ext_ids")["NCBIGene"].alias("_number"))
    own = own.join(known, F.col("_gene.symbol") == F.col("_symbol"), "left")
    fits = (F.col("_gene.geneid") == F.col("_number")) & (F.col("expected_symbol").isNull() | (F.col("expected_symbol") == F.col("_symbol")))
    error = (
        F.when(~F.coalesce(same, F.lit(False)), "accession of another record").when(F.trim(F.coalesce("title", F.lit(""))) == "", "no title").when(~F.coalesce(fits, F.lit(False)), "another gene")
    )
    own = own.withColumn("error", error)
    ids = F.create_map(F.lit("ClinVar"), F.col("accession_version"), F.lit("ClinVarVariation"), F.col("uid"))
    fine = F.col("error").isNull()
    return own.select(
        F.concat(F.lit("var_clinvar_"), "uid").alias("id"), F.when(fine, F.col("title")).alias("name"), F.when(fine, F.array_compact(F.array(F.nullif("protein_change", F.lit(""))))).alias("synonyms"),
        F.when(fine, ids).alias("ext_ids"), F.when(fine, F.col("_symbol")).alias("gene"), F.when(fine, F.coalesce("germline_classification.description", F.lit(""))).alias("classification"), "error",
    )


def fail_closed(rows: DataFrame, most: int = 5) -> DataFrame:
    """rows without their error, or an exception that names the first errors: a slice is whole or not at all."""
    errors = [r["error"] for r in rows.where("error IS NOT NULL").orderBy("error").limit(most).collect()]
    if errors:
        raise ValueError("; ".join(errors))
    return rows.drop("error")
