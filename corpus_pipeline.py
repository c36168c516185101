"""A corpus pipeline: language ID, quality rules, near duplicates, packing.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept, and but for the
last returns the columns of ``documents``.  ``run`` writes each stage's rows as Parquet to the
shared folder and reads them again as the next one's input.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from cohortlens.llm import jaccard_join, langid, packing, quality, suffix_lm
from cohortlens.llm.shared import written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
MIN_SCORE = 0.3  # of the predicted language


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the network names; ``und`` and scores below MIN_SCORE go."""
    docs = docs.select(*COLUMNS)
    langs, model = langid.train(langid.sample(docs))
    return langid.predict(docs, langs, model).where(F.col("lang_pred") != langid.UNKNOWN).where(F.col("score") >= MIN_SCORE).select(*COLUMNS)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule of the policy rejects."""
    return quality.apply_policy(quality.ledger(docs.select(*COLUMNS)), quality.POLICY).where("kept").select(*COLUMNS)


def _apart(docs: DataFrame, marks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``docs`` (with ``name``) as rows whose name is surely not in ``marks``, and the others: those with
    one of its names, and a few more."""
    held = docs.sparkSession.sparkContext.broadcast(suffix_lm._filter(marks.select(F.col("name").alias("ctx")), marks.count()))

    @F.pandas_udf("boolean")
    def may(name: pd.Series) -> pd.Series:
        return pd.Series(suffix_lm._passes(held.value, name.to_numpy(np.int64).view(np.uint64)))

    return docs.where(~may("name")), docs.where(may("name"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component: that with the smallest id (of one id's texts the
    longest).  A document is an id with a text: where an id is repeated with texts that don't link, each is judged
    for itself; rows that repeat both are one document, and the one with the greatest other columns stays.  Rows without an id
    can't be named by a component; all of them stay.

    Only rows that may have to go or are repeated are dealt out by name; the others, most of the texts, stay where they are."""
    docs = docs.select(*COLUMNS)
    # a document's name in the join: a hash of id and text, so that a repeated id names several
    name = F.xxhash64("doc_id", F.col("text").isNull(), "text")
    found = jaccard_join.linked(docs.select(name.alias("doc_id"), "text")).select(F.col("doc_id").alias("name"), F.col("component_id").alias("component")).distinct()
    named = docs.where("doc_id IS NOT NULL").withColumn("name", name)
    ids = named.groupBy("name").agg(F.min(F.struct("doc_id", -F.length("text"), "name")).alias("m"), F.count("*").alias("times"))
    ids = written(ids.join(found, "name"), "named", few=True)
    best = ids.groupBy("component").agg(F.min("m").alias("best"))
    marks = ids.join(best, "component").select("name", "times", (F.col("name") == F.col("best.name")).alias("stays"))
    marks = written(marks.where("NOT stays OR times > 1").select("name", "stays"), "marks", few=True)
    once, rest = _apart(named, marks)
    rest = rest.groupBy("name").agg(F.max(F.struct("doc_id", "text", "lang", "source", "n_chars")).alias("r"))
    rest = rest.join(marks, "name", "left").where("coalesce(stays, true)").select("r.*")
    return once.select(*COLUMNS).unionByName(rest).unionByName(docs.where("doc_id IS NULL"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The kept documents as pieces of sequences of 2048 tokens."""
    return packing.packed(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language_id", language_id), ("quality_rules", quality_rules), ("near_duplicates", near_duplicates), ("packing", pack)]
#: Language ID, shingle components by hash order and tokenisation are beyond SQL; tests/llm holds brute-force twins.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
