import os
import sys

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline as cp
from exposure.llm import line_quality as lq
from exposure.llm import toxicity as tx

sys.path.insert(0, os.path.dirname(__file__))
from test_packing import check  # noqa: E402
from test_setsketch import by_hand as near_by_hand  # noqa: E402
from test_suffix_levels import by_hand as cut_by_hand  # noqa: E402

SF = "/root/testdata/sf0.01"


def texts_of(df):
    return sorted((r.doc_id, r.text) for r in df.collect())


def test_each_stage_by_hand_and_run(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    columns, rows = docs.schema, texts_of(docs)
    stages = dict(cp.STAGES)
    assert list(stages) == ["toxicity", "quality", "near_duplicates", "repeated_passages", "packing"]

    chain = tx.fit(docs, labels)

    def toxic(text):
        x = np.zeros((1, len(chain.features)))
        for w, c in tx.word_counts(text).items():
            for f in tx.features_of(w):
                if f in chain.features:
                    x[0, chain.features[f]] += c
        return tx.probabilities(chain, np.log1p(x))[0, -1] >= 0.5

    clean = stages["toxicity"](spark, docs, SF)
    assert clean.schema == columns and texts_of(clean) == [(i, t) for i, t in rows if not toxic(t)]
    known = {r.doc_id: r.toxic for r in labels.collect()}
    left = {i for i, _ in texts_of(clean)}
    assert sum(i in left for i in known if known[i]) <= 0.2 * sum(known.values()) and sum(i not in left for i in known if not known[i]) <= 0.01 * len(known)

    clean = spark.createDataFrame(clean.collect(), columns)
    field = lq.fit(clean, labels)
    table, move = lq.emissions(field), field.move.tolist()
    good = stages["quality"](spark, clean, SF)
    assert good.schema == columns and texts_of(good) == [(i, t) for i, t in texts_of(clean) if lq.verdict(t, table, move, 0.5, 50, 50)[6]]

    good = spark.createDataFrame(good.collect(), columns)
    single = stages["near_duplicates"](spark, good, SF)
    kept = {eval(x)[0] for x in near_by_hand(texts_of(good), 5, 80) if eval(x)[3]}
    assert single.schema == columns and texts_of(single) == [(i, t) for i, t in texts_of(good) if i in kept]

    single = spark.createDataFrame(single.collect(), columns)
    cut = stages["repeated_passages"](spark, single, SF)
    assert cut.columns == columns.names
    removed = {eval(x)[0]: eval(x)[2] for x in cut_by_hand(texts_of(single), 200)}
    before = dict(texts_of(single))
    for r in cut.collect():
        assert (r.text == before[r.doc_id]) == (removed[r.doc_id] == 0) and r.n_chars == len(r.text)
        assert len(before[r.doc_id].encode()) - removed[r.doc_id] - 6 <= len(r.text.encode()) <= len(before[r.doc_id].encode()) - removed[r.doc_id]

    check(cp.run(spark, SF).collect(), texts_of(cut), 4096)


def test_odd_documents(spark):
    """Nulls in every column, empty texts, repeated rows and ids, and no labels."""
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    text = "word " + " ".join(f"w{i}" for i in range(80))
    rows = [(None, None, None, None, None), (1, text, "en", "s", 5), (1, text, "en", "s", 5), (2, text, None, None, None), (3, "", "en", "s", 0), (None, text, None, None, 1)]
    docs = spark.createDataFrame(rows, schema)
    for name, stage in cp.STAGES[2:]:
        out = stage(spark, docs, SF).collect()
        assert {"near_duplicates": 4, "repeated_passages": 6, "packing": 6}.get(name) == len(out), name
    none = spark.createDataFrame([], schema)
    for _, stage in cp.STAGES:
        assert stage(spark, none, SF).collect() == []
    assert cp.STAGES[0][1](spark, docs, SF).select(F.count("*")).first()[0] == 6
