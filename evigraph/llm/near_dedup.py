"""MinHash near-deduplication with odd sketches (operator 10).

Method:

1. Each text gives its set of n-word shingles (64-bit hashes), BANDS x ROWS MinHash samples, the bands' hashes, and an
   odd sketch: SKETCH_BITS parity bits into which every sample (with its number) is folded. Texts with the same set
   are one class from here on; only its smallest doc_id goes on.
2. Banded candidates: in each band's bucket every member is paired with the bucket's leader, which differs from band to
   band. That is linear in the members. The population count of the XOR of two odd sketches estimates the similarity;
   pairs far below the threshold are let go.
3. Links are confirmed on full sets: first each member's most similar leader, then all other pairs whose ends are not
   connected yet. A leader's set goes once to each task that compares it, with SIDE of its members at most.
4. What leaders alone can't tell: buckets whose members still lie in two or more components. Their members are cut into
   blocks; pairs of blocks are dealt to tasks, where sketches of members of different components are compared, the
   MinHash samples' first, then parity bitmaps of the sets themselves (of a share of their hashes, for large sets).
   The population count never exceeds the number of shingles that one set has and the other lacks, so for sets of up to
   SAMPLE shingles no pair at the threshold is let go, and hardly any below it stays. For larger sets the bound leaves
   six standard deviations. Pairs that pass are confirmed like the others. So a link between different texts is lost
   only if all bands miss it, (1 - 0.8**ROWS)**BANDS or 5e-8 at the threshold itself, or by those deviations; the tests
   measure the recall of pairs near the threshold, and the README states it.
5. Components come from star contraction over links between classes.

A key of many rows (a bucket, its leader, a vertex) never fills a task: such hubs, 10,000 at most, are joined by a
broadcast of their own small rows. Members of one bucket that are near in their sketches and yet not linked are compared
pairwise, block by block, which no way around the full sets spares.

Null texts, empty texts and texts without words have an empty set and are linked with nothing. Texts of fewer words
than a shingle are one shingle. Very long texts are read whole. A pair exactly at the threshold is linked; of equals the
smallest doc_id stays. A null doc_id gets a component of its own: itself, not linked. Rows that repeat a doc_id are one
document each with equal results if their texts are equal; otherwise they share the doc_id's component, which any of
their texts may link. An empty table gives no rows; other columns of docs, whatever their names, are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Batches, discard, join_hubs, mix, shingles, text_frame, written
from .components import connected_components

BANDS, ROWS = 32, 4
SKETCH_BITS = 1024
#: Estimates this far below the threshold are let go: five standard deviations of the sketch at 128 samples.
SLACK = 0.25
BLOCK = 384
#: Larger sets are sampled by hash, so that about so many shingles are folded into the set's own bitmap.
SAMPLE = 400
#: Texts are read again for the sets of pairs' ends; those whose hashed id falls in no end's cell don't reach the shuffle.
#: The number is fixed, so that with very many ends the filter lets all pass, and the join alone decides.
CELLS = 1 << 19

#: Members that a leader's set is compared with in one run.
SIDE = 64

_rng = np.random.default_rng(20_240_601)
_MULTIPLY = _rng.integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)
_ADD = _rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)
_NUMBER = mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64))
_BAND_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], np.uint64)


def minhash(s: np.ndarray) -> np.ndarray:
    """The samples: for each hash function, its smallest value over the set."""
    out = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(s), 256):
        x = s[at : at + 256, None] * _MULTIPLY
        x += _ADD
        x ^= x >> np.uint64(32)
        np.minimum(out, x.min(0), out=out)
    return out


def band_hashes(samples: np.ndarray) -> np.ndarray:
    h = mix((samples.reshape(BANDS, ROWS) * _BAND_ODD[:ROWS]).sum(1, dtype=np.uint64))
    return mix(h + np.arange(BANDS, dtype=np.uint64)).view(np.int64)


def odd_sketch(samples: np.ndarray) -> np.ndarray:
    """Parity of the number of samples that fall on each bit."""
    at = (mix(samples ^ _NUMBER) % np.uint64(SKETCH_BITS)).astype(np.int64)
    bits = (np.bincount(at, minlength=SKETCH_BITS) & 1).astype(np.uint8)
    return np.packbits(bits).view(np.int64)


def sample_level(size: int) -> int:
    """A set of this size is sampled at 1 / 2**level."""
    return (max(0, size - 1) // SAMPLE).bit_length()


def set_sketches(s: np.ndarray) -> np.ndarray:
    """Parity bitmaps of the shingles at the set's level and at the next one, for pairs whose levels differ by one."""
    level, out = sample_level(len(s)), []
    for k in (level, level + 1):
        x = s[(s & np.uint64((1 << k) - 1)) == 0]
        bits = (np.bincount(((x >> np.uint64(40)) % np.uint64(SKETCH_BITS)).astype(np.int64), minlength=SKETCH_BITS) & 1).astype(np.uint8)
        out.append(np.packbits(bits).view(np.int64))
    return np.concatenate(out)


def most_set_bits(total: np.ndarray, level: np.ndarray, percent: int) -> np.ndarray:
    """Bound of the bitmaps' XOR for pairs at the threshold; total: shingles of both sets. Sampled: six deviations more."""
    most = total * (100 - percent) / (100 + percent)
    share = most * 0.5**level
    return np.where(level == 0, most, share + 6 * np.sqrt(share) + 4)


def most_different_bits(threshold: float) -> int:
    """The XOR's population count of a pair at threshold - SLACK: n/2 * (1 - exp(-4 k (1 - j) / n))."""
    k, n = BANDS * ROWS, SKETCH_BITS
    return int(np.ceil(n / 2 * (1 - np.exp(-4 * k * (1 - max(0.0, threshold - SLACK)) / n))))


def _sign(n: int):
    def run(batches: Batches) -> Batches:
        for b in batches:
            sizes, high, low, bands, sketches, own = [], [], [], [], [], []
            for text in b.column("text").to_pylist():
                s = shingles(text.lower().split(), n)
                sizes.append(len(s))
                d = xxhash.xxh3_128_intdigest(s.tobytes())
                high.append((d >> 64) - (1 << 63))
                low.append((d & (1 << 64) - 1) - (1 << 63))
                samples = minhash(s)
                bands.append(band_hashes(samples))
                sketches.append(odd_sketch(samples))
                own.append(set_sketches(s).tobytes())
            rows = len(sizes)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(high, pa.int64()), pa.array(low, pa.int64()), _lists(bands, rows), _lists(sketches, rows), pa.array(own, pa.binary())],
                names=["doc_id", "n_shingles", "high", "low", "bands", "sketch", "own"],
            )

    return run


def _lists(arrays: list[np.ndarray], rows: int) -> pa.Array:
    flat = np.concatenate(arrays) if rows else np.empty(0, np.int64)
    width = len(flat) // rows if rows else 0
    return pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * width), pa.array(flat))


def _sets(n: int):
    def run(batches: Batches) -> Batches:
        for b in batches:
            packed = [shingles(t.lower().split(), n).tobytes() for t in b.column("text").to_pylist()]
            digest = [xxhash.xxh3_128_digest(p) for p in packed]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(digest, pa.binary()), pa.array(packed, pa.binary())], names=["doc_id", "digest", "shingles"])

    return run


def _confirm(percent: int):
    """u, v of links; rows come sorted, for each leader and side first its sets (no member), then its members'."""

    def linked(x: np.ndarray, y: np.ndarray) -> bool:
        if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
            return False
        both = len(np.intersect1d(x, y, assume_unique=True))
        return 100 * both >= percent * (len(x) + len(y) - both)

    def run(batches: Batches) -> Batches:
        now, own = None, []
        for b in batches:
            us, vs = [], []
            for leader, side, member, s in zip(*(b.column(c).to_pylist() for c in ("leader", "side", "member", "shingles")), strict=True):
                if now != (leader, side):
                    now, own = (leader, side), []
                s = np.frombuffer(s, np.uint64)
                if member is None:
                    own.append(s)
                elif any(linked(x, s) for x in own):
                    us.append(max(leader, member))
                    vs.append(min(leader, member))
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])

    return run


def _different_bits(x: str, y: str) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda acc, c: acc + c)


class _Links:
    """Confirms pairs (member, leader) on full sets, and keeps what is linked so far."""

    def __init__(self, docs: DataFrame, n: int, percent: int):
        self.docs, self.n, self.percent = docs, n, percent
        self.links: DataFrame | None = None
        self.scratch: list[DataFrame] = []

    def sets(self, pairs: DataFrame) -> DataFrame:
        """doc_id, shingles of the pairs' ends; a doc_id with several texts has several rows."""
        ends = pairs.select(F.explode(F.array("member", "leader")).alias("_end")).distinct()
        ends = written(ends, "near-ends")
        cell = lambda c: F.pmod(F.xxhash64(c), F.lit(CELLS)).cast("int")
        cells = ends.select(cell("_end").alias("_cell")).distinct()  # CELLS rows at most, so it may be broadcast
        near = text_frame(self.docs).join(F.broadcast(cells), cell("doc_id") == F.col("_cell"), "left_semi")
        wanted = near.join(ends, F.col("doc_id") == F.col("_end"), "left_semi").dropDuplicates(["doc_id", "text"])
        own = wanted.mapInArrow(_sets(self.n), "doc_id long, digest binary, shingles binary").dropDuplicates(["doc_id", "digest"])
        own = written(own.select("doc_id", "shingles"), "near-sets")
        discard(ends)
        return own

    def confirm(self, pairs: DataFrame, sets: DataFrame) -> None:
        """Adds those of the pairs, a written table, that are links."""
        sides = written(pairs.groupBy("leader").agg(F.ceil(F.count("*") / SIDE).cast("int").alias("sides")), "near-sides")
        dealt = join_hubs(pairs, sides, "leader").select("leader", F.pmod(F.xxhash64("member"), F.col("sides")).cast("int").alias("side"), F.col("member").alias("doc_id"))
        members = dealt.join(sets, "doc_id").select("leader", "side", F.col("doc_id").alias("member"), "shingles")
        leaders = sides.join(sets.withColumnRenamed("doc_id", "leader"), "leader")
        leaders = leaders.select("leader", F.explode(F.sequence(F.lit(0), F.col("sides") - 1)).alias("side"), F.lit(None).cast("long").alias("member"), "shingles")
        rows = leaders.unionByName(members).repartition("leader", "side").sortWithinPartitions("leader", "side", F.col("member").asc_nulls_first())
        good = written(rows.mapInArrow(_confirm(self.percent), "u long, v long"), "near-links")
        discard(sides)
        self.scratch.append(good)
        self.links = good if self.links is None else self.links.unionByName(good)

    def labels(self) -> DataFrame:
        return written(connected_components(self.links), "near-labels")


def _apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs, a written table, whose ends no links connect yet."""
    own = labels.select(F.col("vertex").alias("leader"), F.col("component").alias("leader_label"))
    pairs = join_hubs(pairs, own, "leader", "left")
    own = labels.select(F.col("vertex").alias("member"), F.col("component").alias("member_label"))
    pairs = pairs.join(own, "member", "left")  # a member has BANDS leaders at most
    return pairs.where(F.coalesce("member_label", "member") != F.coalesce("leader_label", "leader")).select("member", "leader")


class _Side:
    """A block's members as arrays."""

    def __init__(self, members: list[dict]):
        self.id, self.label, self.n = (np.array([m[k] for m in members], np.int64) for k in ("id", "label", "n"))
        self.sketch = np.array([m["sketch"] for m in members], np.int64)
        self.own = np.frombuffer(b"".join(m["own"] for m in members), np.int64).reshape(len(members), 2, -1)
        self.level = np.array([sample_level(n) for n in self.n.tolist()], np.int64)


def _bits(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.bitwise_count((x ^ y).view(np.uint64)).sum(1, dtype=np.int64)


def _compare_blocks(most_bits: int, percent: int):
    """Pairs of members of two blocks (or of one) of different components whose sketches and sizes are near."""

    def run(batches: Batches) -> Batches:
        for b in batches:
            us, vs = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for p, q in zip(b.column("p").to_pylist(), b.column("q").to_pylist(), strict=True):
                x, y = _Side(p), _Side(q)
                for i in range(len(x.id)):
                    near = np.flatnonzero((y.label != x.label[i]) & (100 * np.minimum(y.n, x.n[i]) >= percent * np.maximum(y.n, x.n[i])))
                    near = near[_bits(y.sketch[near], x.sketch[i]) <= most_bits]
                    level, own = y.level[near], x.level[i]
                    theirs = np.where((level < own)[:, None], y.own[near, 1], y.own[near, 0])
                    mine = np.where((level > own)[:, None], x.own[i, 1], x.own[i, 0])
                    most = most_set_bits(y.n[near] + x.n[i], np.maximum(level, own), percent)
                    near = near[(np.abs(level - own) > 1) | (_bits(theirs, mine) <= most)]
                    us.append(np.maximum(y.id[near], x.id[i]))
                    vs.append(np.minimum(y.id[near], x.id[i]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(us)), pa.array(np.concatenate(vs))], names=["u", "v"])

    return run


def _left_apart(entries: DataFrame, classes: DataFrame, labels: DataFrame, most_bits: int, percent: int) -> tuple[DataFrame, tuple[DataFrame, ...]]:
    """u, v: pairs in a bucket of different components whose sketches are near; and the tables that they come from.

    A component of many members in a bucket has blocks of its own, which are not compared with each other; others
    share blocks. So a large group that is connected costs a comparison with the bucket's other members only.
    """
    labelled = entries.join(labels.withColumnRenamed("vertex", "id"), "id", "left").select("band", "id", F.coalesce("component", "id").alias("label"))
    labelled = written(labelled.withColumn("slot", F.xxhash64("band", "label")), "near-labelled")
    counts = labelled.groupBy("band", "label").agg(F.count("*").alias("own"))
    mixed = counts.groupBy("band").agg(F.count("*").alias("labels"), F.sum(F.when(F.col("own") < BLOCK, F.col("own")).otherwise(0)).alias("small")).where("labels > 1")
    plan = counts.join(mixed, "band").select(
        "band", "label", F.when(F.col("own") >= BLOCK, F.col("label")).alias("pure"), F.ceil(F.when(F.col("own") >= BLOCK, F.col("own")).otherwise(F.col("small")) / BLOCK).alias("parts")
    )
    plan = plan.select(F.xxhash64("band", "label").alias("slot"), "pure", "parts")
    members = join_hubs(labelled, plan, "slot").join(classes.select("id", "sketch", "own", "n"), "id")
    key = F.struct("pure", F.pmod(F.xxhash64("id"), F.col("parts")).alias("part")).alias("key")
    blocks = members.groupBy("band", key).agg(F.collect_list(F.struct("id", "label", "n", "sketch", "own")).alias("side"))  # about BLOCK members
    blocks = written(blocks.select(F.xxhash64("band", "key.pure", "key.part").alias("key"), "side"), "near-blocks")
    pure = members.select("band", "pure", F.pmod(F.xxhash64("id"), F.col("parts")).alias("part")).distinct()
    keys = written(pure.select("band", "pure", F.xxhash64("band", "pure", "part").alias("key")), "near-keys")
    other = keys.select("band", F.col("pure").alias("pure_q"), F.col("key").alias("key_q"))
    pairs = keys.withColumnRenamed("key", "key_p").join(other, "band").where("key_p <= key_q and (pure is null or pure_q is null or pure != pure_q)")
    sides = pairs.join(blocks.select(F.col("key").alias("key_p"), F.col("side").alias("p")), "key_p").join(blocks.select(F.col("key").alias("key_q"), F.col("side").alias("q")), "key_q")
    return sides.select("p", "q").mapInArrow(_compare_blocks(most_bits, percent), "u long, v long").distinct(), (labelled, blocks, keys)


def near_dedup(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row for each row of docs (doc_id: an integer)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = "doc_id long, n_shingles long, high long, low long, bands array<long>, sketch array<long>, own binary"
    signed = written(text_frame(docs).mapInArrow(_sign(n), schema), "near-signed")
    classes = signed.where("n_shingles > 0 and doc_id is not null").groupBy("high", "low").agg(F.min("doc_id").alias("id"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"), F.first("own").alias("own"), F.first("n_shingles").alias("n"))
    classes = written(classes, "near-classes")
    sketches = classes.select("id", "sketch")
    most_bits = most_different_bits(percent / 100)

    entries = written(classes.select("id", F.explode("bands").alias("band")), "near-entries")
    turn = F.struct(F.xxhash64("id", "band").alias("turn"), "id")
    shared = entries.groupBy("band").agg(F.count("*").alias("members"), F.min(turn).alias("leader")).where("members > 1")
    shared = written(shared.select("band", F.col("leader.id").alias("leader")), "near-shared")
    alone, entries = entries, written(join_hubs(entries, shared, "band"), "near-entries")
    discard(alone, shared)

    pairs = written(entries.where("id != leader").select(F.col("id").alias("member"), "leader").distinct(), "near-pairs")
    own = sketches.withColumnRenamed("sketch", "leader_sketch").withColumnRenamed("id", "leader")
    near = join_hubs(pairs, own, "leader").join(sketches.withColumnRenamed("id", "member"), "member")
    near = near.select("member", "leader", _different_bits("sketch", "leader_sketch").alias("bits")).where(F.col("bits") <= most_bits)
    all_pairs, pairs = pairs, written(near.groupBy("member", "leader").agg(F.min("bits").alias("bits")), "near-pairs")
    discard(all_pairs)

    links = _Links(docs, n, percent)
    sets = links.sets(pairs)
    best = pairs.groupBy("member").agg(F.min(F.struct("bits", "leader")).alias("best")).select("member", F.col("best.leader").alias("leader"))
    best = written(best, "near-best")
    links.confirm(best, sets)
    first = links.labels()
    rest = written(pairs.select("member", "leader").join(best, ["member", "leader"], "left_anti"), "near-rest")
    apart = written(_apart(rest, first), "near-apart")
    links.confirm(apart, sets)
    discard(sets, best, first, rest, apart)

    labels = links.labels()
    more, scratch = _left_apart(entries, classes, labels, most_bits, percent)
    done = pairs.select(F.greatest("member", "leader").alias("u"), F.least("member", "leader").alias("v")).distinct()
    more = written(more.join(done, ["u", "v"], "left_anti").select(F.col("u").alias("member"), F.col("v").alias("leader")), "near-more")
    if not more.isEmpty():
        sets = links.sets(more)
        links.confirm(more, sets)
        discard(sets, labels)
        labels = links.labels()
    discard(entries, pairs, more, *scratch, *links.scratch)

    found = signed.select("doc_id", "n_shingles", "high", "low")
    named = classes.select("high", "low", "id").join(labels.withColumnRenamed("vertex", "id"), "id", "left")
    named = named.select("high", "low", F.coalesce("component", "id").alias("component"))
    out = found.join(named, ["high", "low"], "left")
    component = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).otherwise(F.col("doc_id"))
    out = out.select("doc_id", "n_shingles", component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
