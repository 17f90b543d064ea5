"""From raw documents to packed sequences: toxicity, quality, near duplicates, repeated passages, packing.

Each stage works on all that its predecessor kept and returns the columns of ``documents``; the last returns a row for each piece of a sequence. Models are fitted on a
bounded sample of the labelled documents that the stage is given. Null texts, empty tables, repeated rows and null ids are handled as the operators say.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from exposure.llm import line_quality, packing, setsketch, suffix_levels, toxicity
from exposure.llm.common import save, table


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.without_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_quality.good(docs, line_quality.fit(docs, table(spark, sf_dir, "labels")))


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return setsketch.one_of_each(docs, shingle=5, percent=80)


def without_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts lose every string of 200 bytes that also stands elsewhere; n_chars is counted anew. A document stays even if nothing of it is left."""
    return suffix_levels.without_repeats(docs, length=200).withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), max_tokens=4096, end_id=1)


STAGES = [
    ("toxicity", without_toxic),
    ("quality", good_quality),
    ("near_duplicates", without_near_duplicates),
    ("repeated_passages", without_repeated_passages),
    ("packing", packed),
]

#: Trained models, sketches and a tokenizer have no SQL form; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
