r"""Names in claims and the nodes that they stand for: an exact similarity join, candidates and proposals.

Two texts of a and b characters are alike if their matching blocks, M characters in all, make 2 M / (a + b) >= r. With
L = a + b, a pair that is alike

- has lengths with min(a, b) >= r L / 2, since M is at most the shorter one;
- leaves U = L - 2 M <= (1 - r) L characters unmatched, which part M characters into U + 1 blocks at most, so that it
  shares M - (U + 1) >= (1.5 r - 1) L - 1 pairs of neighbouring characters, counted with their repeats.

So of a text's neighbouring pairs, ordered by how rare they are, a prefix suffices that leaves fewer behind than any
partner must share: one of the shared pairs is in both prefixes. Where a pair of texts must share none (short ones), single
characters stand in for neighbouring pairs: they must share r L / 2 of them. Texts meet by an equality join on such a key,
once for each pair of texts (at their first common key), and the ratio itself decides. Nothing that is alike is lost.

Frequent keys come last in the order, so a syllable that all names have is hardly a key; a key that still is hot is
split by adaptive execution, for both sides of the join come straight from a shuffle.
"""

from __future__ import annotations

from collections import Counter
from difflib import SequenceMatcher
from math import ceil

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import ascii_words

ALIKE = 0.8
#: Characters of a proposed node's id.
SLUG = 40


def keys_of(text: str, rare: dict[str, int], ratio: float = ALIKE) -> list[str]:
    """Join keys of a text, so that texts alike share one. rare: the place of each neighbouring pair, frequent ones last."""
    a = len(text)
    if not a:
        return []
    least = ceil(ratio * a / (2 - ratio) - 1e-9)  # the shortest partner, for min(a, b) >= ratio * (a + b) / 2
    out = set()
    share = ceil((1.5 * ratio - 1) * (a + least) - 1 - 1e-9)
    pairs = _numbered(sorted((text[i : i + 2] for i in range(a - 1)), key=lambda p: (rare.get(p, -1), p)))
    if share < 1:  # some partner need share no neighbouring pair
        single = _numbered(sorted(text))
        out |= {f"1{c}" for c in single[: a - ceil(ratio * (a + least) / 2 - 1e-9) + 1]}
        share = 1
    out |= {f"2{p}" for p in pairs[: max(0, len(pairs) - share + 1)]}
    return sorted(out)


def _numbered(tokens: list[str]) -> list[str]:
    """Tokens with the number of their repeat."""
    seen: Counter[str] = Counter()
    out = []
    for t in tokens:
        out.append(f"{t}{seen[t]}")
        seen[t] += 1
    return out


def _ratio(a: str, b: str, least: float) -> float | None:
    """The ratio if it reaches least, by its cheap upper bounds first."""
    m = SequenceMatcher(None, a, b)
    if m.real_quick_ratio() < least or m.quick_ratio() < least:
        return None
    r = m.ratio()
    return r if r >= least else None


def rarity(keys: DataFrame) -> dict[str, int]:
    """The place of each neighbouring pair among all, the most frequent last: 37 * 37 at most, as keys have a-z, 0-9 and blanks."""
    pairs = F.transform(F.sequence(F.lit(1), F.length("key") - 1), lambda i: F.substring("key", i, F.lit(2)))
    counts = keys.where(F.length("key") > 1).select(F.explode(pairs).alias("p")).groupBy("p").agg(F.count("*").alias("n"))
    return {r["p"]: i for i, r in enumerate(counts.orderBy("n", "p").collect())}


def similar(texts: DataFrame, names: DataFrame, ratio: float = ALIKE) -> DataFrame:
    """type, text_key, name_key, ratio of all pairs of a type that are at least `ratio` alike. texts, names: type, key (folded by ascii_words, distinct).

    ratio: above 2/3. Keys of no characters are alike to none.
    """
    if not 2 / 3 < ratio <= 1:
        raise ValueError("ratio: above 2/3, 1 at most")
    rare = rarity(names)

    @F.pandas_udf("array<string>")
    def keys(s: pd.Series) -> pd.Series:
        return s.map(lambda t: keys_of(t, rare, ratio))

    @F.pandas_udf("double")
    def alike(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([_ratio(x, y, ratio) for x, y in zip(a, b, strict=True)], dtype="float64")

    def side(rows: DataFrame, name: str) -> DataFrame:
        own = rows.where("key != ''").select("type", F.col("key").alias(name), keys("key").alias(f"{name}s"))
        return own.select("type", name, f"{name}s", F.explode(f"{name}s").alias("k"))

    a, b = side(texts, "text_key"), side(names, "name_key")
    la, lb = F.length("text_key"), F.length("name_key")
    near = a.join(b, ["type", "k"]).where(2 * F.least(la, lb) >= ratio * (la + lb) - 1e-9)
    near = near.where(F.array_min(F.array_intersect("text_keys", "name_keys")) == F.col("k"))
    return near.withColumn("ratio", alike("text_key", "name_key")).where("ratio IS NOT NULL AND NOT isnan(ratio)").select("type", "text_key", "name_key", "ratio")


def name_keys(nodes: DataFrame) -> DataFrame:
    """type, key, id: the folded names and synonyms of all nodes. nodes: id, type, name, synonyms."""
    names = F.concat(F.array("name"), F.coalesce("synonyms", F.array().cast("array<string>")))
    return nodes.select("type", "id", F.explode(names).alias("text")).select("type", ascii_words("text").alias("key"), "id").where("key != ''").distinct()


def _first(of: list[str], order: list[Column], most: int) -> tuple[Column, Column]:
    place = F.row_number().over(Window.partitionBy(*of).orderBy(*order))
    return place, F.col("place") <= most


def best_candidates(texts: DataFrame, nodes: DataFrame, most: int = 5, ratio: float = ALIKE) -> DataFrame:
    """type, key, node_id, ratio, place: the nodes of a type most like each text, by name or synonym, at least `ratio`. Ties go to the smaller id."""
    names = name_keys(nodes)
    pairs = similar(texts.select("type", "key").distinct(), names.select("type", "key").distinct(), ratio)
    by_node = pairs.join(names.select("type", F.col("key").alias("name_key"), "id"), ["type", "name_key"]).groupBy("type", F.col("text_key").alias("key"), F.col("id").alias("node_id")).agg(F.max("ratio").alias("ratio"))
    place, few = _first(["type", "key"], [F.desc("ratio"), F.col("node_id")], most)
    return by_node.withColumn("place", place).where(few)


def linked_candidates(asked: DataFrame, nodes: DataFrame, edges: DataFrame, most: int = 5) -> DataFrame:
    """subject_id, relation, type, key, node_id, ratio, place: nodes of the type that the relation links to the subject, most alike first, however little.

    asked: subject_id, relation, type, key. The pairs are the subject's links, one comparison for each name.
    """
    known = edges.select(F.col("src").alias("subject_id"), F.col("type").alias("relation"), F.col("dst").alias("node_id")).distinct()

    @F.pandas_udf("double")
    def likeness(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")

    own = asked.join(known, ["subject_id", "relation"])
    own = own.join(name_keys(nodes).select("type", F.col("key").alias("name_key"), F.col("id").alias("node_id")), ["type", "node_id"])
    own = own.withColumn("ratio", likeness("key", "name_key")).groupBy("subject_id", "relation", "type", "key", "node_id").agg(F.max("ratio").alias("ratio"))
    place, few = _first(["subject_id", "relation", "type", "key"], [F.desc("ratio"), F.col("node_id")], most)
    return own.withColumn("place", place).where(few)


def proposal(type_: Column, text: Column) -> Column:
    """The id of a new node: type and text in lower case, other signs as _, cut to SLUG characters."""
    trim = lambda c: F.regexp_replace(c, "^_+|_+$", "")
    slug = trim(F.substring(trim(F.regexp_replace(F.lower(F.concat_ws("_", type_, text)), "[^a-z0-9]+", "_")), 1, SLUG))
    return F.when(slug == "", "x").otherwise(slug)


def reconciled(claims: DataFrame, nodes: DataFrame, edges: DataFrame, type_of: dict[str, str], most: int = 5, ratio: float = ALIKE) -> DataFrame:
    """claim_id, side (subject, object), type, text, outcome, node_id, candidates, proposed_id: what each name of a claim stands for.

    claims: claim_id, subject, relation, object; nodes: id, type, name, synonyms; edges: src, dst, type; type_of: the node
    type of a relation's object. An exact name or synonym decides (the smallest node id that has it). Otherwise candidates
    are left for a reader: for an object whose subject is known, the nodes that the relation already links to it; without
    any, as for subjects, those of the type that are at least `ratio` alike. candidates: structs of node_id and ratio, the
    most alike first. outcome: exact, review, or new with the proposed node's id. A null text is an empty one, and new.
    """
    kind = F.create_map(*[F.lit(x) for kv in type_of.items() for x in kv])
    rows = claims.select("claim_id", "relation", F.explode(F.array(
        F.struct(F.lit("subject").alias("side"), F.lit("disease").alias("type"), F.coalesce("subject", F.lit("")).alias("text")),
        F.struct(F.lit("object").alias("side"), kind[F.col("relation")].alias("type"), F.coalesce("object", F.lit("")).alias("text")),
    )).alias("n")).select("claim_id", "relation", "n.*").withColumn("key", ascii_words("text"))
    names = name_keys(nodes)
    exact = names.groupBy("type", "key").agg(F.min("id").alias("node_id"))
    rows = rows.join(exact, ["type", "key"], "left")
    subject = rows.where("side = 'subject' AND node_id IS NOT NULL").select("claim_id", F.col("node_id").alias("subject_id"))
    rows = rows.join(subject, "claim_id", "left")
    rows = rows.withColumn("subject_id", F.when(F.col("side") == "object", F.col("subject_id")))

    open_ = rows.where("node_id IS NULL")
    linked = linked_candidates(open_.where("subject_id IS NOT NULL").select("subject_id", "relation", "type", "key").distinct(), nodes, edges, most)
    pack = F.array_sort(F.collect_list(F.struct("place", "node_id", "ratio")))  # `most` at most
    linked = linked.groupBy("subject_id", "relation", "type", "key").agg(pack.alias("linked"))
    free = best_candidates(open_.select("type", "key"), nodes, most, ratio).groupBy("type", "key").agg(pack.alias("free"))
    out = rows.join(linked, ["subject_id", "relation", "type", "key"], "left").join(free, ["type", "key"], "left")
    found = F.transform(F.when(F.col("node_id").isNull(), F.coalesce("linked", "free")), lambda c: c.dropFields("place"))
    out = out.withColumn("candidates", F.coalesce(found, F.array().cast("array<struct<node_id:string,ratio:double>>")))
    outcome = F.when(F.col("node_id").isNotNull(), "exact").when(F.size("candidates") > 0, "review").otherwise("new")
    return out.select("claim_id", "side", "type", "text", outcome.alias("outcome"), "node_id", "candidates", F.when(outcome == "new", proposal(F.col("type"), F.col("text"))).alias("proposed_id"))


def proposed_nodes(found: DataFrame) -> DataFrame:
    """id, type, name of the new nodes of reconciled(): one for each id, the smallest text of its claims."""
    new = found.where("outcome = 'new'")
    return new.groupBy(F.col("proposed_id").alias("id"), "type").agg(F.min("text").alias("name"))
