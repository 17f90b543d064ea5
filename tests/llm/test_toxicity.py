import numpy as np

from exposure.llm import toxicity as tx


def test_chain_learns_from_earlier_categories():
    r = np.random.default_rng(1)
    x = r.normal(size=(1200, 6))
    first = (x[:, 0] + x[:, 1] > 0).astype(float)
    second = ((first > 0) ^ (r.random(1200) < 0.05)).astype(float)
    labels = np.stack([first, second, second], 1)
    weights, intercepts = tx.fit_chain(x[:800], labels[:800], np.arange(800) % 3)
    assert [len(w) for w in weights] == [6, 7, 8] and weights[1][6] > 0.5
    p = tx.probabilities(tx.Chain({}, weights, intercepts), x[800:])
    assert ((p[:, 2] > 0.5) == (second[800:] > 0.5)).mean() > 0.88


def test_linear_model_is_the_optimum():
    r = np.random.default_rng(2)
    x = r.normal(size=(300, 3))
    y = (r.random(300) < tx.sigmoid(x @ np.array([1.0, -2.0, 0.0]) + 0.3)).astype(float)
    w, b = tx.fit_linear(x, y, 0.01, 3000)
    weight = np.where(y > 0, min(4.0, max(1.0, (300 - y.sum()) / y.sum())), 1.0)
    slope = x.T @ (weight * (tx.sigmoid(x @ w + b) - y)) / 300 + 0.01 * w
    assert np.abs(slope).max() < 1e-4


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    chain = tx.fit(docs, labels.where("doc_id % 2 = 0"))
    held = labels.where("doc_id % 2 = 1")
    got = {(r.toxic, r.is_toxic): r["count"] for r in tx.judge(docs.join(held.select("doc_id"), "doc_id", "left_semi"), chain).join(held, "doc_id").groupBy("toxic", "is_toxic").count().collect()}
    assert got[1, True] >= 0.92 * (got[1, True] + got.get((1, False), 0)) and got.get((0, True), 0) <= 0.005 * got[0, False]


def test_odd_rows(spark):
    good, bad = "plain words about the weather and the sea", "what a grotsnik you are grotsnik person"
    rows = [(i, (bad if i % 3 == 0 else good) + f" number{i}") for i in range(60)]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(60)] + [(None, 1), (7, None)], "doc_id long, toxic int")
    docs = spark.createDataFrame([(i, t, 0.5, "x") for i, t in rows], "doc_id long, text string, p_toxic double, is_toxic string")
    chain = tx.fit(docs, labels)
    odd = [(None, bad), (None, None), (5, ""), (5, ""), (6, "GROTSNIK! you are, what a person" + " the sea" * 3000)]
    got = tx.judge(spark.createDataFrame(odd, "doc_id long, text string"), chain).collect()
    assert sorted((str(r.doc_id), r.is_toxic) for r in got) == [("5", False), ("5", False), ("6", True), ("None", False), ("None", True)]
    assert tx.fit(docs, labels.where("toxic = 0")).weights is None
    none = tx.judge(docs, tx.fit(docs, labels.where("false"))).collect()
    assert len(none) == 60 and not any(r.is_toxic for r in none)
    assert tx.judge(docs.where("false"), chain).collect() == []


def test_repeated_rows_of_a_labelled_id(spark):
    good, bad = "plain words about the weather and the sea", "what a grotsnik you are grotsnik person"
    rows = [(i, (bad if i % 3 == 0 else good) + f" number{i}") for i in range(60)]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(60)], "doc_id long, toxic int")
    once = spark.createDataFrame(rows, "doc_id long, text string")
    chain = tx.fit(once, labels)
    for more in ([rows[0]] * 400, [(1, f"{good} number1")] * 400):
        docs = spark.createDataFrame(rows + more, "doc_id long, text string").repartition(4)
        again = tx.fit(docs, labels)
        assert again.features == chain.features and "=grotsnik" in again.features
        assert all(np.allclose(a, b) for a, b in zip(again.weights, chain.weights)) and np.allclose(again.intercepts, chain.intercepts)
    other = spark.createDataFrame(rows + [(0, f"{bad} text {k}") for k in range(400)], "doc_id long, text string").repartition(4)
    got = tx.judge(other, tx.fit(other, labels)).collect()
    assert all(r.is_toxic == (r.doc_id % 3 == 0) for r in got) and len(got) == 460
