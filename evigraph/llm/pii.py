r"""Personal data: patterns of four kinds, and bootstrapped contextual extraction (operator 11).

Base kinds are email, ip, card and phone, each a regular expression with a rule. The method adds what the expressions
miss, such as numbers that stand side by side and identifiers in forms that nobody wrote an expression for.

Method: bootstrapped contextual extraction over DataFrame functions only.

1. Chunks, runs of words with a digit or an @, are cut out of each text with the words around them; no later step reads
   a text. Possessive forms of the expressions keep the time linear and the stack flat, whatever the text.
2. Base matches and words are elements of a chunk; their places are running sums over a document's elements. Candidates
   are the one to four words in a row that overlap no base match, without the signs at their ends.
3. Base matches are seeds. Seeds and candidates induce lexical patterns: their own shape with all digits, and with runs
   folded beside the word before or after; the two words before; the words on both sides.
4. Distinct (pattern, instance) pairs are the graph. In each round a pattern's confidence is the share of seeds among
   its instances, an instance's score the noisy-or of its confident patterns; instances with a high score that satisfy
   the kind's rule are seeds of the next round.
5. Mentions of discovered instances are spans, unless they overlap one that starts earlier, or as early and is longer.

Null and empty texts have no spans. Very long texts are read whole; an identifier has MAX_LENGTH code points at most, and
words of a context count by their first or last CONTEXT ones. Repeated rows and ids give a row each and, as instances are
distinct, weigh no more. An instance of several kinds takes the one with the higher score, then the first. An empty table
gives no rows. Without seeds nothing is discovered. Other columns of docs, whatever their names, are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import discard, written

KINDS = ("email", "ip", "card", "phone")
#: Seeds that a pattern needs, its confidence, rounds, words of a candidate, code points of an identifier and of a context's word.
LEAST_SEEDS, CONFIDENT, ROUNDS, MOST_WORDS, MAX_LENGTH, CONTEXT = 3, 0.8, 3, 4, 100, 64

_S = r"\x20\x09-\x0D"
_WORD = rf"[^{_S}]++"
_DIGIT_WORD = rf"[^{_S}0-9@]*+[0-9@][^{_S}]*+"
#: Words with a digit or @ that only spaces and words of brackets, dots and hyphens part: no base match leaves its chunk.
_CHUNK = rf"(?<![^{_S}]){_DIGIT_WORD}(?:\x20++(?:{_DIGIT_WORD}|[().-]++(?![^{_S}])))*+"
#: The kinds' expressions, possessive, and begun only where a leftmost match can begin.
_BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_BYTE = r"0*+(?:[1-9]?[0-9]|1[0-9]{2}|2[0-4][0-9]|25[0-5])?"
_IPV4 = rf"^{_BYTE}(?:\.{_BYTE}){{3}}$"
_IPV6 = r"^(?=.*::|(?:[^:]*:){7})[0-9A-Fa-f]{0,4}(?::[0-9A-Fa-f]{0,4}){2,7}$"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]++", "")


def _is_card(value: Column) -> Column:
    return F.length(_digits(value)).between(12, 19) & F.call_function("luhn_check", _digits(value))


def _valid(kind: Column, value: Column) -> Column:
    """The rules that base matches must pass."""
    return (
        F.when(kind == "ip", value.rlike(_IPV4))
        .when(kind == "card", _is_card(value))
        .when(kind == "phone", F.length(_digits(value)).between(9, 15))
        .otherwise(True)
    )


def _plausible(kind: Column, value: Column) -> Column:
    """The rules that discovered instances must pass."""
    return (
        F.when(kind == "email", value.rlike("^[^@]++@[^@]++$"))
        .when(kind == "ip", value.rlike(_IPV4) & value.rlike(r"^[0-9]++(?:\.[0-9]++){3}$") | value.rlike(_IPV6))
        .when(kind == "card", value.rlike(r"^[0-9][0-9\x20-]*+$") & _is_card(value))
        .otherwise(value.rlike(r"^[+(]?[0-9][0-9\x20().-]*+$") & F.length(_digits(value)).between(9, 15))
    )


def _last_words(gap: Column) -> Column:
    """The last two words, parted by one space, of the last 2 * CONTEXT code points."""
    return F.substring_index(F.trim(F.regexp_replace(F.substring(gap, -2 * CONTEXT, 2 * CONTEXT), f"[{_S}]++", " ")), " ", -2)


def _first_word(gap: Column) -> Column:
    return F.regexp_extract(F.substring(gap, 1, CONTEXT), rf"^[{_S}]*+({_WORD})", 1)


def _elements(text: Column, pattern: str) -> Column:
    """gap, hit, next: the matches with the text before and after each; the last has no match."""
    gaps = F.split(text, pattern, -1)
    return F.arrays_zip(gaps.alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit"), F.slice(gaps, F.lit(2), F.size(gaps)).alias("next"))


def chunks(docs: DataFrame) -> DataFrame:
    """_row, doc_id, chunks: structs of skip (code points before), before (two words), chunk, after (a word)."""
    text = docs.select(F.monotonically_increasing_id().alias("_row"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    own = text.withColumn("e", F.when(F.col("text").rlike("[0-9@]"), _elements(F.col("text"), _CHUNK))).drop("text")
    own = own.withColumn("e", F.filter("e", lambda x: x["hit"].isNotNull()))
    own = own.withColumn("e", F.transform("e", lambda x: F.struct(F.length(x["gap"]).alias("skip"), _last_words(x["gap"]).alias("before"), x["hit"].alias("chunk"), _first_word(x["next"]).alias("after"))))
    return written(own.withColumnRenamed("e", "chunks"), "pii-chunks")


def elements(rows: DataFrame) -> DataFrame:
    """_row, pos, i, kind (or word), start, hit, before, after, chunk_before, chunk_after: matches and words of all chunks."""
    parts = rows.select("_row", F.posexplode("chunks").alias("pos", "c")).select("_row", "pos", "c.*")

    def of(kind: str, pattern: str) -> Column:
        return F.transform(
            _elements(F.col("chunk"), pattern),
            lambda x, i: F.struct(F.lit(kind).alias("kind"), i.alias("i"), F.length(x["gap"]).alias("gap"), x["hit"].alias("hit"), _last_words(x["gap"]).alias("before"), _first_word(x["next"]).alias("after")),
        )

    each = F.concat(*[of(k, p) for k, p in _BASE.items()], of("word", _WORD))
    each = parts.select("_row", "pos", "skip", F.col("before").alias("chunk_before"), F.col("after").alias("chunk_after"), F.explode(each).alias("e"))
    each = each.select("_row", "pos", "skip", "chunk_before", "chunk_after", "e.*")
    lead = F.when(F.col("i") == 0, F.col("skip")).otherwise(0) + F.col("gap")
    order = Window.partitionBy("_row", "kind").orderBy("pos", "i")
    length = F.coalesce(F.length("hit"), F.lit(0))
    each = each.withColumn("start", F.sum((lead + length).cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0)) - length)
    return each.where("hit IS NOT NULL").drop("skip", "gap")


def base_matches(each: DataFrame) -> DataFrame:
    """_row, start, end, kind, value, left (two words), right: the base matches that pass their rules."""
    left = F.when(F.col("i") == 0, F.concat_ws(" ", *[F.when(F.col(c) != "", F.col(c)) for c in ("chunk_before", "before")])).otherwise(F.col("before"))
    # what follows in the chunk, else after it; a chunk without a further word ends with the match
    right = F.when(F.col("after") != "", F.col("after")).otherwise(F.col("chunk_after"))
    own = each.where(F.col("kind") != "word").where(_valid(F.col("kind"), F.col("hit")))
    return own.select("_row", "start", (F.col("start") + F.length("hit")).alias("end"), "kind", F.col("hit").alias("value"), F.substring_index(left, " ", -2).alias("left"), right.alias("right"))


def candidates(each: DataFrame) -> DataFrame:
    """_row, start, end, kind (null), value, left, right: one to MOST_WORDS words of a chunk in a row, without the signs at their ends."""
    at = Window.partitionBy("_row").orderBy("pos", "i")
    words = each.where("kind = 'word'").select("_row", "pos", "i", "start", "hit", "chunk_before", "chunk_after")

    def near(name: str, k: int) -> Column:
        there = (F.lead if k > 0 else F.lag)
        return F.when(there("pos", abs(k)).over(at) == F.col("pos"), there(name, abs(k)).over(at))

    words = words.select("*", *[near("hit", k).alias(f"w{k}") for k in range(1, MOST_WORDS + 1)], *[near("start", k).alias(f"s{k}") for k in range(1, MOST_WORDS)], near("hit", -1).alias("l1"), near("hit", -2).alias("l2"))
    words = words.withColumns({"w0": F.col("hit"), "s0": F.col("start")})
    cut = F.length("hit") - F.length(F.regexp_replace("hit", r"^[^+(\p{L}\p{N}]++", ""))
    runs = []
    for n in range(1, MOST_WORDS + 1):
        last, ends = F.col(f"w{n - 1}"), F.col(f"s{n - 1}")
        tail = F.length(last) - F.length(F.regexp_replace(last, r"(?<![^\p{L}\p{N}])[^\p{L}\p{N}]++$", ""))
        right = F.coalesce(F.col(f"w{n}"), F.col("chunk_after"))
        joined = F.concat_ws(" ", *[F.col(f"w{k}") for k in range(n)])
        value = F.substring(joined, cut + 1, F.length(joined) - cut - tail)
        runs.append(F.struct((F.col("start") + cut).alias("start"), (ends + F.length(last) - tail).alias("end"), value.alias("value"), F.substring(right, 1, CONTEXT).alias("right")))
    left = F.concat_ws(" ", *[F.when(F.col(c) != "", F.col(c)) for c in ("chunk_before", "l2", "l1")])
    out = words.select("_row", F.substring_index(left, " ", -2).alias("left"), F.explode(F.array(*runs)).alias("c")).select("_row", "left", "c.*")
    return out.where((F.col("end") > F.col("start")) & (F.col("end") - F.col("start") <= MAX_LENGTH) & F.col("value").rlike("[0-9@]")).select(
        "_row", "start", "end", F.lit(None).cast("string").alias("kind"), "value", "left", "right"
    )


def mentions(each: DataFrame) -> DataFrame:
    """Base matches and the candidates that overlap none."""
    both = base_matches(each).unionByName(candidates(each))
    row, base = Window.partitionBy("_row"), F.col("kind").isNotNull()
    up = row.orderBy("start", F.col("kind").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    down = row.orderBy(F.desc("start"), F.col("kind").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("_before", F.max(F.when(base, F.col("end"))).over(up)).withColumn("_next", F.min(F.when(base, F.col("start"))).over(down))
    free = (F.coalesce("_before", F.lit(-1)) <= F.col("start")) & (F.col("_next").isNull() | (F.col("_next") >= F.col("end")))
    return both.where(base | free).drop("_before", "_next")


def patterns_of(value: Column, left: Column, right: Column) -> Column:
    """An instance's lexical patterns."""
    fold = lambda digits: F.regexp_replace(F.regexp_replace(value, digits, "9"), r"\p{L}++", "a")
    before, after = F.lower(left), F.lower(right)
    last = F.substring_index(before, " ", -1)
    p = [
        F.concat(F.lit("shape "), fold("[0-9]")),
        F.when(last != "", F.concat(F.lit("after "), last, F.lit(" "), fold("[0-9]++"))),
        F.when(after != "", F.concat(F.lit("before "), after, F.lit(" "), fold("[0-9]++"))),
        F.when(F.instr(before, " ") > 0, F.concat(F.lit("behind "), before)),
        F.when((last != "") & (after != ""), F.concat(F.lit("between "), last, F.lit(" "), after)),
    ]
    return F.array_compact(F.array(*p))


def graph(found: DataFrame) -> DataFrame:
    """p, value: distinct pairs of patterns and instances."""
    pairs = found.where(F.length("value") <= MAX_LENGTH).select(F.explode(patterns_of(F.col("value"), F.col("left"), F.col("right"))).alias("p"), "value")
    return pairs.groupBy("p", "value").agg(F.count("*").alias("n")).select("p", "value")


def confident_patterns(pairs: DataFrame, seeds: DataFrame, least: int, confident: float) -> DataFrame:
    """p, kind, confidence: the share of seeds among a pattern's instances, half an instance more being none."""
    of = [F.sum((F.col("kind") == k).cast("long")).alias(k) for k in KINDS]
    counted = pairs.join(seeds, "value", "left").groupBy("p").agg(F.count("*").alias("n"), *of)
    each = F.array(*[F.struct(F.lit(k).alias("kind"), F.coalesce(k, F.lit(0)).alias("s")) for k in KINDS])
    counted = counted.select("p", "n", F.explode(each).alias("k")).select("p", "k.kind", "k.s", (F.col("k.s") / (F.col("n") + 0.5)).alias("confidence"))
    return counted.where((F.col("s") >= least) & (F.col("confidence") >= confident)).drop("s")


def discovered(found: DataFrame, least: int = LEAST_SEEDS, confident: float = CONFIDENT, rounds: int = ROUNDS) -> DataFrame:
    """value, kind, score: instances that confident patterns vouch for, a written table."""
    pairs = written(graph(found), "pii-graph")
    order = F.expr(" ".join(["CASE kind", *[f"WHEN '{k}' THEN {-i}" for i, k in enumerate(KINDS)], "END"]))
    seeds = written(found.where("kind IS NOT NULL").groupBy("value").agg(F.max(F.struct(order.alias("o"), "kind")).alias("b")).select("value", "b.kind", F.lit(1.0).alias("score")), "pii-seeds")
    for _ in range(rounds):
        patterns = confident_patterns(pairs, seeds, least, confident)
        new = pairs.join(patterns, "p").groupBy("value", "kind").agg((1 - F.exp(F.sum(F.log(1 - F.col("confidence"))))).alias("score"))
        new = new.where((F.col("score") >= confident) & _plausible(F.col("kind"), F.col("value")))
        new = new.groupBy("value").agg(F.max(F.struct("score", order.alias("o"), "kind")).alias("b")).select("value", "b.kind", "b.score")
        more = written(new.join(seeds, "value", "left_anti"), "pii-new")
        if more.isEmpty():
            discard(more)
            break
        old, seeds = seeds, written(seeds.unionByName(more), "pii-seeds")
        discard(old, more)
    discard(pairs)
    return seeds


def personal_data(docs: DataFrame, least: int = LEAST_SEEDS, confident: float = CONFIDENT, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, spans for each row of docs; spans: structs of start, end (code points, end exclusive), kind, base, by start and kind."""
    rows = chunks(docs)
    found = written(mentions(elements(rows)), "pii-mentions")
    known = discovered(found, least, confident, rounds)
    new = found.where("kind IS NULL").drop("kind").join(known, "value").select("_row", "start", "end", "kind")
    earlier = Window.partitionBy("_row").orderBy("start", F.desc("end"), "kind").rowsBetween(Window.unboundedPreceding, -1)
    new = new.withColumn("_taken", F.max("end").over(earlier)).where("_taken IS NULL OR _taken <= start").drop("_taken")
    spans = found.where("kind IS NOT NULL").select("_row", "start", "end", "kind").withColumn("base", F.lit(True)).unionByName(new.withColumn("base", F.lit(False)))
    order = reduce(lambda c, k: c.when(F.col("kind") == k, KINDS.index(k)), KINDS[1:], F.when(F.col("kind") == KINDS[0], 0))
    spans = spans.groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("start", order.alias("order"), "end", "kind", "base"))).alias("spans"))
    spans = spans.withColumn("spans", F.transform("spans", lambda x: x.dropFields("order")))
    out = rows.select("_row", "doc_id").join(spans, "_row", "left")
    return out.select("doc_id", F.coalesce("spans", F.from_json(F.lit("[]"), spans.schema["spans"].dataType)).alias("spans"))


def digest(found: DataFrame) -> DataFrame:
    base = F.filter("spans", lambda x: x["base"])
    text = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    of = lambda k: F.filter(base, lambda x: x["kind"] == k)
    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))
