"""Quality by factorisation machine, language by recurrent network."""

import numpy as np
import pytest

from cindergrid.llm import language as L
from cindergrid.llm import quality as Q
from cindergrid.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def test_sum_of_squares_identity():
    draw = np.random.default_rng(1)
    model = Q.Machine(0.3, draw.normal(0, 0.2, Q.FEATURES), draw.normal(0, 0.2, (Q.FEATURES, Q.RANK)))
    numbers, values = draw.choice(Q.FEATURES, 30, replace=False), draw.random(30)
    raw = 0.3 + sum(model.weights[i] * x for i, x in zip(numbers, values, strict=True))
    for a in range(30):
        for b in range(a):
            raw += model.factors[numbers[a]] @ model.factors[numbers[b]] * values[a] * values[b]
    assert model.score(numbers, values) == pytest.approx(1 / (1 + np.exp(-raw)))


def test_machine_learns_a_pair():
    rows, marks = [], []
    for i in range(400):
        a, b = i % 2, i // 2 % 2
        rows.append((np.array([10 + a, 20 + b]), np.array([1.0, 1.0])))
        marks.append(float(a == b))
    model = Q.fit(rows, np.array(marks), rate=0.3)
    assert all((model.score(*r) > 0.5) == bool(m) for r, m in zip(rows[:8], marks[:8], strict=True))


def test_features_count_whole_texts():
    buckets = Q.Buckets()
    one, two = Q.features_of("a " * 50_000 + "rareword", buckets), Q.features_of("a " * 50_000, buckets)
    assert len(one[0]) == len(two[0]) + 1
    assert len(Q.features_of(None, buckets)[0]) == len(Q.STATISTICS)


def test_quality_of_edge_documents(edge_docs, no_docs, labels):
    model = Q.train(edge_docs, labels)
    rows = Q.score_texts(edge_docs, model).collect()
    assert len(rows) == edge_docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    assert len({r.score for r in rows if r.doc_id in (2, 3)}) == 1 and len({r.score for r in rows if r.doc_id == 6}) == 1
    kept = Q.score_texts(edge_docs, model, keep=True)
    assert kept.schema == edge_docs.schema and kept.count() == sum(r.predicted for r in rows)
    assert Q.score_texts(no_docs, Q.train(no_docs, labels)).count() == 0
    assert {r.score for r in Q.score_texts(edge_docs, Q.train(edge_docs, labels.limit(0))).collect()} == {0.5}


def auc(scores, marks):
    good, bad = scores[marks == 1], scores[marks == 0]
    return np.mean([(good > s).mean() + (good == s).mean() / 2 for s in bad])


def test_quality_query_on_held_out_rows(spark):
    rows = QUERIES["op8_factorisation_quality"](spark, SF).toPandas()
    known = rows.merge(spark.read.parquet(f"{SF}/labels.parquet").toPandas(), on="doc_id")
    held = known[known.held_out]
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert auc(held.score.to_numpy(), held.quality.to_numpy()) > 0.95
    assert held.predicted[held.quality == 1].mean() > 0.97


def test_backpropagation_against_differences():
    model = L.Network(["a", "b", "c"], seed=2)
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    data = np.frombuffer(b" word  text  more ", np.uint8).reshape(3, 6).T
    labels = np.array([0, 2, 1])
    _, slope = model.slopes(data, labels)
    draw = np.random.default_rng(0)
    for name, values in model.p.items():
        for _ in range(6):
            at = tuple(draw.integers(0, n) for n in values.shape)
            if name[0] == "x":
                at = (int(data[draw.integers(0, 6), draw.integers(0, 3)]), at[1])
            old, ends = values[at], []
            for move in (1e-2, -1e-2):
                values[at] = old + move
                logs = model.log_probabilities(data).astype(np.float64)
                ends.append(-logs[:, np.arange(3), labels].mean())
            values[at] = old
            assert slope[name][at] == pytest.approx((ends[0] - ends[1]) / 2e-2, abs=2e-4)


def test_words_are_labelled_alike_in_any_batch():
    model = L.fit(["the and with from", "der und mit von"] * 3, ["en", "de"] * 3, steps=60)
    one, two = L.WordLabels(model), L.WordLabels(model)
    one.learn({"the", "und", "x" * 100})
    two.learn({"the"})
    two.learn({"und", "other", "x" * 100})
    for word in ("the", "und", "x" * 100):
        assert np.allclose(one.table[one[word]], two.table[two[word]], atol=1e-4)


def test_language_of_edge_documents(edge_docs, no_docs):
    model = L.train(edge_docs)
    rows = L.detect(edge_docs, model).collect()
    assert len(rows) == edge_docs.count()
    assert {r.doc_id: r.lang_pred for r in rows if r.doc_id in (2, 3, 4, 7)} == dict.fromkeys((2, 3, 4, 7), "und")
    assert all(r.lang_pred in ("en", "und") and 0 <= r.score <= 1 for r in rows)
    none = L.train(no_docs)
    assert L.detect(no_docs, none).count() == 0
    assert {r.lang_pred for r in L.detect(edge_docs, none).collect()} == {"und"}


def test_no_letters_no_language(spark, edge_docs):
    texts = ["² " * 10, "² ³ " * 60, "½ 12 ㊿ " * 80, "² " * 60 + "word"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    found = {r.doc_id: r.lang_pred for r in L.detect(docs, L.train(edge_docs)).collect()}
    assert found == {0: "und", 1: "und", 2: "und", 3: "en"}


def test_language_query_on_held_out_rows(spark):
    rows = QUERIES["op3_byte_gru_language"](spark, SF).toPandas()
    docs = spark.read.parquet(f"{SF}/documents.parquet").toPandas()
    known = rows.merge(docs, on="doc_id")
    held = known[known.held_out]
    assert len(rows) == len(docs) and (held.lang == held.lang_pred).mean() > 0.98
