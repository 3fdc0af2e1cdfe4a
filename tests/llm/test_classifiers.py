import zlib

import numpy as np
import pytest

from evigraph.llm import linear, quality, queries, toxicity


def accuracy(spark, sf_dir, rows, label):
    truth = {r["doc_id"]: r[label] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect() if r[label] is not None}
    held = [r for r in rows if r["held_out"] and r["doc_id"] in truth]
    right = [(r["predicted"], truth[r["doc_id"]]) for r in held]
    pos = [r["score"] for r in held if truth[r["doc_id"]]]
    neg = [r["score"] for r in held if not truth[r["doc_id"]]]
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in pos for b in neg])
    return float(np.mean([a == b for a, b in right])), float(auc), len(held)


@pytest.mark.parametrize(("query", "label", "threshold"), [("op2_toxicity", "toxic", 0.5), ("op7_quality", "quality", 0.3)])
def test_query_on_whole_table(spark, large, query, label, threshold):
    rows = queries.QUERIES[query](spark, large).collect()
    assert len(rows) == spark.read.parquet(f"{large}/documents.parquet").count()
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= threshold)
    right, auc, n = accuracy(spark, large, rows, label)
    assert n >= 500 and auc > 0.95 and right > 0.97, (right, auc, n)


@pytest.mark.parametrize("module", [toxicity, quality])
def test_odd_texts(spark, odd, module):
    labels = spark.createDataFrame([(i, i % 2, i % 2, "x") for i in range(25)] + [(None, 1, 1, None), (3, None, None, None), (4, 1, 1, None)], "doc_id long, toxic int, quality int, text string")
    out = module.classify(odd, labels).collect()
    assert len(out) == odd.count() and all(0 <= r["score"] <= 1 for r in out)
    by = {}
    for r in out:
        by.setdefault((r["doc_id"], r["score"]), 0)
    texts = {(r["doc_id"], r["text"]) for r in odd.collect()}
    assert len(by) <= len(texts)  # repeated rows score alike


@pytest.mark.parametrize("module", [toxicity, quality])
def test_no_labels_one_class_and_empty_tables(spark, odd, none, module):
    labels = spark.createDataFrame([(i, 1, 1) for i in range(20)], "doc_id long, toxic int, quality int")
    for some in (labels.limit(0), labels):
        out = module.classify(odd, some).collect()
        assert len(out) == odd.count() and len({r["score"] for r in out}) == 1
    assert module.classify(none, labels).collect() == []


def test_held_out_labels_change_nothing(spark, tiny):
    docs, labels = (spark.read.parquet(f"{tiny}/{t}.parquet") for t in ("documents", "labels"))
    flipped = labels.selectExpr("doc_id", "case when crc32(cast(doc_id as string)) % 5 = 0 then 1 - toxic else toxic end as toxic", "case when crc32(cast(doc_id as string)) % 5 = 0 then 1 - quality else quality end as quality")
    for module in (toxicity, quality):
        a, b = ({r["doc_id"]: r["score"] for r in module.classify(docs, x).collect()} for x in (labels, flipped))
        assert a == b


def ballots(labelled=0.1):
    """Votes of four voters and the class; the fifth voter copies the second one nine times of ten."""
    rng = np.random.default_rng(3)
    y = (rng.random(6000) < 0.2).astype(int)
    votes = np.stack([np.where(rng.random(6000) < acc, y, 1 - y) for acc in (0.9, 0.8, 0.75, 0.7)], 1)
    copy = np.where(rng.random(6000) < 0.9, votes[:, 1], 2)
    return np.column_stack([votes, copy]), y, rng.random(6000) < labelled


def label_model(votes, y, labelled):
    patterns, at = np.unique(votes, axis=0, return_inverse=True)
    at = at.ravel()
    counts = [np.bincount(at, m, len(patterns)) for m in (~labelled, labelled & (y == 0), labelled & (y == 1))]
    return toxicity.LabelModel(patterns, *counts), at


def test_label_model_finds_accuracies():
    for share in (0.1, 0.3):
        votes, y, labelled = ballots(share)
        model, at = label_model(votes, y, labelled)
        majority = votes[:, :4].sum(1) >= 3
        assert ((model.posterior[at] > 0.5) == y).mean() >= max(0.9, (majority == y).mean() - 0.01)
        assert model.parent[4] == 1 or model.parent[1] == 4  # the copy is found


def test_label_model_against_one_document_after_the_other():
    """Expectation-maximisation over documents, given the model's tree, ends where the model does over patterns."""
    votes, y, labelled = ballots()
    votes, y, labelled = votes[:400], y[:400], labelled[:400]
    model, at = label_model(votes, y, labelled)
    weight = min(1.0, labelled.sum() / (~labelled).sum())
    p = model.posterior[at].tolist()
    for _ in range(3):
        table, sizes = {}, [1.0, 1.0]
        for v, t, known, q in zip(votes.tolist(), y.tolist(), labelled.tolist(), p, strict=True):
            for c, w in ((1, q), (0, 1 - q)):
                w = float(t == c) if known else weight * w
                sizes[c] += w
                for i, j in enumerate(model.parent):
                    key = (c, i, v[j] if j >= 0 else 0, v[i])
                    table[key] = table.get(key, 0.5) + w
        new = []
        for v in votes.tolist():
            both = []
            for c in (0, 1):
                like = sizes[c] / sum(sizes)
                for i, j in enumerate(model.parent):
                    row = [table.get((c, i, v[j] if j >= 0 else 0, k), 0.5) for k in range(3)]
                    like *= row[v[i]] / sum(row)
                both.append(like)
            new.append(both[1] / sum(both))
        p = new
    assert p == pytest.approx(model.posterior[at].tolist(), abs=1e-3)


def test_hinge_dual_separates():
    rows = [np.array([0, 2]), np.array([0, 3]), np.array([1, 2]), np.array([1, 3])] * 5
    y = np.array([1.0, 1.0, -1.0, -1.0] * 5)
    x = linear.Sparse(rows)
    scale = np.abs(linear.log_count_ratios(x, 4, (y > 0).astype(float))) + 0.1
    w, bias = linear.hinge_dual(x, scale, y, np.ones(len(y)))
    assert all(np.sign(w[r] @ scale[r] + bias) == t for r, t in zip(rows, y, strict=True))


def test_hinge_dual_against_a_plain_descent():
    """The dual's optimum: no row's variable can improve the dual objective by itself."""
    rng = np.random.default_rng(9)
    rows = [np.unique(rng.integers(0, 30, 6)) for _ in range(60)]
    y = np.where(rng.random(60) < 0.5, 1.0, -1.0)
    scale, cost = rng.random(30) + 0.2, np.full(60, 0.7)
    w, bias = linear.hinge_dual(linear.Sparse(rows), scale, y, cost, rounds=400)
    x = np.zeros((60, 31))
    for i, r in enumerate(rows):
        x[i, r] = scale[r] / np.linalg.norm(scale[r])
    x[:, 30] = 1
    full = np.append(w, bias)
    primal = 0.5 * full @ full + (cost * np.maximum(0, 1 - y * (x @ full))).sum()
    best, step = np.zeros(31), 0.02
    least = primal
    for k in range(20_000):
        margin = y * (x @ best)
        best -= step / (1 + k / 500) * (best - ((cost * y)[:, None] * x)[margin < 1].sum(0))
        least = min(least, 0.5 * best @ best + (cost * np.maximum(0, 1 - y * (x @ best))).sum())
    assert primal <= least * 1.01


def test_quality_scores_against_plain_sums(spark, tiny):
    """Features by sets of strings, ratios by counts and scores by sums over them equal the model's."""
    docs, labels = (spark.read.parquet(f"{tiny}/{t}.parquet") for t in ("documents", "labels"))
    model, ratios = quality.fit(*quality.labelled_features(docs, labels, "quality", 500, quality.features))
    got = {r["doc_id"]: r["score"] for r in quality.classify(docs, labels, 500).collect()}
    for r in docs.collect():
        x = quality.features((r["text"] or "").encode())
        dot = length = 0.0
        for i in x.tolist():
            dot += model.w[i] * ratios[i]
            length += ratios[i] ** 2
        z = model.a * (dot / max(1e-9, length**0.5) + model.bias) + model.b
        assert got[r["doc_id"]] == pytest.approx(1 / (1 + np.exp(-max(-30.0, min(30.0, z)))))
    own = labels.join(docs, "doc_id").where("crc32(cast(doc_id as string)) % 5 != 0 and quality is not null").collect()
    counts = {0: {}, 1: {}}
    for k, r in enumerate(sorted(own, key=lambda r: r["doc_id"])):
        if k % 5:
            for i in quality.features((r["text"] or "").encode()).tolist():
                counts[r["quality"]][i] = counts[r["quality"]].get(i, 0) + 1
    total = {c: sum(n.values()) + quality.SIZE for c, n in counts.items()}
    for i in list(counts[1])[:500]:
        want = np.log((1 + counts[1][i]) / total[1] / ((1 + counts[0].get(i, 0)) / total[0]))
        assert ratios[i] == pytest.approx(want)


def test_repeated_ids_with_several_texts_train_alike(spark, tiny):
    docs, labels = (spark.read.parquet(f"{tiny}/{t}.parquet") for t in ("documents", "labels"))
    twice = docs.unionByName(docs.withColumn("text", docs["text"].substr(1, 200)))
    for module in (toxicity, quality):
        a, b = (sorted((r["doc_id"], r["score"]) for r in module.classify(d, labels).collect()) for d in (twice, twice.repartition(5)))
        assert [x[0] for x in a] == [x[0] for x in b] and np.allclose([x[1] for x in a], [x[1] for x in b])


def test_very_long_texts(spark, tiny):
    labels = spark.read.parquet(f"{tiny}/labels.parquet")
    docs = spark.read.parquet(f"{tiny}/documents.parquet").select("doc_id", "text")
    long = spark.createDataFrame([(10**6, "word you idiot " * 150_000), (10**6 + 1, "x" * 2_000_000), (10**6 + 2, " " * 2_000_000)], "doc_id long, text string")
    for module in (toxicity, quality):
        rows = module.classify(docs.unionByName(long), labels).where("doc_id >= 1000000").collect()
        assert len(rows) == 3 and all(0 <= r["score"] <= 1 for r in rows)
