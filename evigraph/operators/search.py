"""Search over nodes: folded questions, scored rules, genes resolved to their diseases."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from .links import supported


def search(questions: DataFrame, nodes: DataFrame, disease_genes: DataFrame | None = None, types: list[str] | None = None, most: int = 20) -> DataFrame:
    """q, node_id, via, score, resolved_from, rank: the first `most` nodes of each question.

    questions: q, a stated few, compared with all nodes. nodes: id, type, name, synonyms, related, ids (namespace, value),
    centrality. Matches come by score (with the centrality added) and name; with disease_genes (edges), the diseases of
    matched genes follow, by their gene's place and the edge's id. types keeps nodes of these types. A node counts once,
    where it comes first.
    """
    asked = F.broadcast(questions.select("q", text.fold("q").alias("folded")).where("folded != ''"))
    own = nodes.select(
        "id", "type", F.col("name").alias("label"), "centrality", text.fold("name").alias("name"),
        text.fold_all("synonyms").alias("synonyms"), text.fold_all("related").alias("related"),
        text.fold_all(F.flatten(F.transform("ids", lambda i: F.array(i["value"], F.concat_ws(":", i["namespace"], i["value"]), F.concat_ws(" ", i["namespace"], i["value"]))))).alias("ids"),
    )
    rule = text.match_rule(F.col("folded"), F.col("name"), F.col("ids"), F.col("synonyms"), F.col("related"))
    found = own.crossJoin(asked).withColumn("rule", rule).where("rule is not null")  # the stated questions
    found = found.select("q", "id", "type", "label", F.col("rule.via").alias("via"), (F.col("rule.score") + F.col("centrality")).alias("score"))
    direct = found.select("q", F.col("id").alias("node_id"), "type", "via", "score", F.lit(None).cast("string").alias("resolved_from"), F.struct(F.lit(0).alias("late"), (-F.col("score")).alias("a"), F.col("label").alias("b"), F.col("id").alias("c")).alias("place"))
    every = direct
    if disease_genes is not None:
        genes = found.where("type = 'gene'").select("q", F.col("id").alias("gene"), "label", "score")
        edges = disease_genes.where(supported("usable")).select(F.col("dst").alias("gene"), F.col("src").alias("node_id"), F.col("id").alias("edge"))
        kinds = nodes.select(F.col("id").alias("node_id"), "type")
        place = F.struct(F.lit(1).alias("late"), (-F.col("score")).alias("a"), F.concat_ws("|", "label", "gene").alias("b"), F.col("edge").alias("c"))
        resolved = genes.join(edges, "gene").join(kinds, "node_id").select("q", "node_id", "type", F.lit("gene").alias("via"), F.lit(None).cast("double").alias("score"), F.col("gene").alias("resolved_from"), place.alias("place"))
        every = direct.unionByName(resolved)
    if types is not None:
        every = every.where(F.col("type").isin(types))
    first = every.groupBy("q", "node_id").agg(F.min_by(F.struct("via", "score", "resolved_from", "place"), "place").alias("m")).select("q", "node_id", "m.*")
    rank = F.row_number().over(Window.partitionBy("q").orderBy("place", "node_id"))
    return first.withColumn("rank", rank).where(F.col("rank") <= most).drop("place")


def no_match(questions: DataFrame, found: DataFrame) -> DataFrame:
    """q: questions that no node answers; coverage goes with them."""
    return questions.select("q").join(found.select("q"), "q", "left_anti")
