"""Quality and toxicity: held-out accuracy, the factorisation identity, the label model."""

import itertools
import zlib
from pathlib import Path

import numpy as np
import pytest
from edges import auc, documents, nothing
from pyspark.sql import functions as F

from graphloom.llm import quality, toxicity
from graphloom.llm.quality import FactorisationMachine, drop_rejected, quality_scores
from graphloom.llm.toxicity import LabelModel, Voters, toxicity_scores

LARGER = Path("/root/testdata/sf0.01")


@pytest.fixture(scope="module")
def larger(spark):
    if not LARGER.is_dir():
        pytest.skip("no larger tables")
    return [spark.read.parquet(f"{LARGER}/{t}.parquet") for t in ("documents", "labels")]


@pytest.mark.parametrize("scored,column,modulus,held,threshold,least", [(quality_scores, "quality", 5, 0, 0.3, 0.85), (toxicity_scores, "toxic", 3, 1, 0.7, 0.85)])
def test_held_out_rows(larger, scored, column, modulus, held, threshold, least):
    docs, labels = larger
    rows = scored(docs, labels).collect()
    assert len(rows) == docs.count()
    truth = {r["doc_id"]: r[column] for r in labels.collect()}
    for r in rows:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= threshold)
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % modulus == held)
    known = [r for r in rows if r["held_out"] and truth.get(r["doc_id"]) is not None]
    assert auc([r["score"] for r in known], [truth[r["doc_id"]] for r in known]) >= least


@pytest.mark.parametrize("scored,column,modulus,held", [(quality_scores, "quality", 5, 0), (toxicity_scores, "toxic", 3, 1)])
def test_held_out_labels_change_nothing(larger, scored, column, modulus, held):
    docs, labels = larger
    docs = docs.where("doc_id < 300")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == held
    other = labels.withColumn(column, F.when(fold, 1 - F.col(column)).otherwise(F.col(column)))
    score = lambda l: {r["doc_id"]: r["score"] for r in scored(docs, l).collect()}
    assert score(labels) == pytest.approx(score(other), abs=1e-12)


@pytest.mark.parametrize("scored", [quality_scores, toxicity_scores])
def test_edges(spark, scored):
    df = documents(spark)
    labels = spark.createDataFrame([(i, i % 2, int(i % 3 == 0)) for i in range(100, 140)] + [(1, 1, 0), (1, 0, 0), (2, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int").withColumn("label", F.lit("clash"))
    rows = scored(df, labels).collect()
    assert len(rows) == df.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert [r["held_out"] for r in rows if r["doc_id"] is None] == [False, False]
    assert scored(nothing(spark), labels).collect() == []
    none = labels.where("false")
    assert len(scored(df, none).collect()) == df.count()


def test_scores_of_every_row_against_brute_force(larger):
    """Row by row in plain Python: each pair of features for quality, each feature for toxicity, posteriors by Bayes' rule."""
    docs, labels = larger
    docs = docs.where("doc_id < 120")
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in docs.collect()}
    model = quality.fit(docs, labels)
    got = {r["doc_id"]: r for r in quality.score(docs, model).collect()}
    for i, t in texts.items():
        stats, words = quality.structure(t)
        ids, values = quality.features(stats, quality.hashed_words(words, quality.WORD_DIMS), model.edges)
        m, raw = model.machine, float(model.machine.bias)
        raw += sum(float(m.weights[k]) * float(v) for k, v in zip(ids, values))
        f = m.factors[ids].astype(float) * values[:, None]
        raw += float(np.triu(f @ f.T, 1).sum())
        want = 1 / (1 + np.exp(-np.clip(raw, -30, 30)))
        assert got[i]["score"] == pytest.approx(want, abs=2e-3)
        assert got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and got[i]["predicted"] == int(got[i]["score"] >= 0.3)
    model = toxicity.fit(docs, labels)
    got = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    for i, t in texts.items():
        ids, values = toxicity.linear_features(t, model.linear.voters)
        raw = model.linear.bias + sum(float(model.linear.weights[k]) * float(v) for k, v in zip(ids, values))
        assert got[i]["score"] == pytest.approx(1 / (1 + np.exp(-np.clip(raw, -30, 30))), abs=1e-9)
        assert got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) and got[i]["predicted"] == int(got[i]["score"] >= 0.7)
        bits = model.linear.voters.votes(toxicity.plain_words(t))[0]
        odds = model.labels.prior / (1 - model.labels.prior)
        for clique, table in zip(model.labels.cliques, model.labels.tables):
            vote = sum((bits >> v & 1) << k for k, v in enumerate(clique))
            odds *= table[1, vote] / table[0, vote]
        assert model.labels.posterior(np.array([bits]))[0] == pytest.approx(odds / (1 + odds), abs=1e-9)


def test_one_id_with_several_texts_trains_alike(larger):
    docs, labels = larger
    docs = docs.where("doc_id < 200")
    twice = docs.unionByName(docs.where("doc_id < 60").withColumn("text", F.concat(F.lit("zz "), "text")))
    for scored in (quality_scores, toxicity_scores):
        a, b = (sorted((r["doc_id"], r["score"]) for r in scored(d, labels).collect()) for d in (twice, twice.repartition(5).orderBy(F.desc("doc_id"))))
        assert a == b


def test_rejected_documents_go(larger):
    docs, labels = larger
    low = {r["doc_id"] for r in quality_scores(docs, labels).where("predicted = 0").collect()}
    out = drop_rejected(docs, labels)
    assert out.columns == docs.columns
    assert {r["doc_id"] for r in out.select("doc_id").collect()} == {r["doc_id"] for r in docs.select("doc_id").collect()} - low


def test_sum_of_squares_identity():
    rng = np.random.default_rng(1)
    m = FactorisationMachine(0.3, rng.normal(size=50).astype(np.float32), rng.normal(size=(50, quality.RANK)).astype(np.float32))
    ids, values = rng.choice(50, 12, replace=False), rng.normal(size=12).astype(np.float32)
    slow = m.bias + float((m.weights[ids] * values).sum()) + sum(float(m.factors[ids[a]] @ m.factors[ids[b]]) * values[a] * values[b] for a, b in itertools.combinations(range(12), 2))
    assert m.raw(ids, values, np.array([0]))[0] == pytest.approx(slow, rel=1e-3, abs=1e-3)


def test_factors_learn_a_pair_that_no_single_feature_shows():
    rng = np.random.default_rng(2)
    rows, y = [], []
    for _ in range(1200):
        a, b = rng.integers(0, 2, 2)
        rows.append((np.array([a, 2 + b], np.int32), np.ones(2, np.float32)))
        y.append(float(a == b))
    m = FactorisationMachine.trained(rows, np.array(y), 4, epochs=40, rate=0.2)
    raw = [m.raw(i, v, np.array([0]))[0] for i, v in rows[:40]]
    assert auc(raw, [int(x) for x in y[:40]]) == 1.0


def test_label_model_recovers_accuracies_and_correlations():
    """Voters 0 to 3 are independent; 4 copies 3, which must not count twice. One row in 20 has a label."""
    rng = np.random.default_rng(3)
    n = 60_000
    y = rng.random(n) < 0.2
    fire = [np.where(y, rng.random(n) < p, rng.random(n) < q) for p, q in ((0.8, 0.05), (0.7, 0.03), (0.6, 0.08), (0.5, 0.2))]
    fire.append(np.where(rng.random(n) < 0.95, fire[3], ~fire[3]))
    bits = sum(f.astype(np.int64) << k for k, f in enumerate(fire))
    patterns, counts = np.unique(bits, return_counts=True)
    known = {}
    for p, label in zip(bits[::20].tolist(), y[::20].astype(int).tolist()):
        known[p, label] = known.get((p, label), 0) + 1
    m = LabelModel.fitted(patterns, counts.astype(float), known, 5)
    assert [3, 4] in m.cliques
    assert m.prior == pytest.approx(0.2, abs=0.02)
    for k, (p, q) in enumerate(((0.8, 0.05), (0.7, 0.03), (0.6, 0.08))):
        clean, toxic = m.accuracy(k)
        assert toxic == pytest.approx(p, abs=0.04) and clean == pytest.approx(q, abs=0.02)


def test_label_model_counts_all_labelled_rows(larger):
    """The bound holds for the classifier's training rows only."""
    docs, labels = larger
    few, all_rows = (toxicity.fit(docs, labels, limit=n) for n in (40, 6000))
    assert few.linear.voters == all_rows.linear.voters and few.linear.voters.prefixes
    assert few.labels.prior == all_rows.labels.prior and few.labels.cliques == all_rows.labels.cliques
    assert all((a == b).all() for a, b in zip(few.labels.tables, all_rows.labels.tables))


def test_votes():
    v = Voters.of([b"mined"], [b"blor"])
    bits, hits, begun = v.votes(b"you idiot mined".split())
    assert bits & 1 and sum(hits) == 2 and not begun
    assert bits >> (len(v.lists) + toxicity.PREFIX_VOTERS) & 0b110 == 0b110  # two words, one beside "you"
    assert v.votes(b"blorx blory fine".split())[2] == {0: 2} and v.votes([])[0] == 0
