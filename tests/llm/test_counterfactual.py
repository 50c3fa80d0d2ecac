"""The counterfactual term of the toxicity model on the labelled documents, and the query against plain Python."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.llm import queries, toxicity
from textloom.llm.common import id_remainder

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def fitted(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    taught = labels.where(id_remainder(F.col("doc_id"), 5) != 0)
    rows = docs.join(labels, "doc_id").where("toxic in (0, 1)").select("doc_id", "text", "toxic").collect()
    return rows, {p: toxicity.fit_toxicity(docs, taught, penalty=p) for p in (0.0, 1.0)}


def swap_changes(model, rows):
    """|change of the score| when a mention that is put into a text is swapped for another, over all kinds."""
    known, found = {}, []
    for r in rows[::41]:
        words = toxicity.words_of(r.text)
        for kind in toxicity.IDENTITY_TERMS:
            scores = [model.score(words | {t.encode()}, known) for t in kind]
            found.append(max(scores) - min(scores))
    return float(np.mean(found))


def test_penalty_acts_on_the_labelled_documents(fitted):
    rows, models = fitted
    free, held = models[0.0], models[1.0]
    terms = [t.encode() for kind in toxicity.IDENTITY_TERMS for t in kind]
    assert free.weights != held.weights
    assert sum(held.weights.get(t, 0) ** 2 for t in terms) < sum(free.weights.get(t, 0) ** 2 for t in terms) / 2
    assert swap_changes(held, rows) < swap_changes(free, rows) / 2


def test_held_out_accuracy_stays(fitted):
    rows, models = fitted
    from zlib import crc32

    out = [r for r in rows if crc32(str(r.doc_id).encode()) % 5 == 0]
    right = {p: np.mean([(m.score(toxicity.words_of(r.text), {}) >= 0.5) == bool(r.toxic) for r in out]) for p, m in models.items()}
    assert len(out) > 500 and right[1.0] >= 0.97 and right[1.0] >= right[0.0] - 0.01


def test_gradient_by_differences():
    rng = np.random.default_rng(3)
    x, y = rng.integers(0, 2, (40, 6)).astype(float), rng.integers(0, 2, 40).astype(float)
    change = rng.integers(-1, 2, (15, 6)).astype(float)
    fixed = (x, y, rng.random(40), change.T @ change / 15, np.full(6, 0.01), 0.7)
    w = rng.normal(size=6)
    _, gradient = toxicity.objective(w, *fixed)
    plain = [(toxicity.objective(w + e, *fixed)[0] - toxicity.objective(w - e, *fixed)[0]) / 2e-5 for e in np.eye(6) * 1e-5]
    assert np.allclose(gradient, plain, atol=1e-6)
    assert np.isclose(toxicity.objective(w, *fixed)[0] - toxicity.objective(w, *fixed[:-1], 0.0)[0], 0.7 * np.mean((change @ w) ** 2))


def test_no_terms_is_an_error(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int")
    with pytest.raises(ValueError):
        toxicity.fit_toxicity(docs, labels, terms=())
    assert toxicity.fit_toxicity(docs, labels, terms=(), penalty=0.0).weights == {}


def test_query_against_plain_python(spark):
    from zlib import crc32

    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = toxicity.fit_toxicity(docs, labels.where(id_remainder(F.col("doc_id"), 5) != 0))
    got = {r.doc_id: r for r in queries.op3_toxicity_counterfactual(spark, SF).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert got.keys() == texts.keys()
    for i, text in texts.items():
        x = model.bias + sum(v for f, v in model.weights.items() if any(f in toxicity.features_of_word(w) for w in toxicity.words_of(text))) if i % 199 == 0 else None
        assert x is None or abs(got[i].score - 1 / (1 + np.exp(-x))) < 1e-9
        assert got[i].held_out == (crc32(str(i).encode()) % 5 == 0) and got[i].predicted == int(got[i].score >= 0.5)
