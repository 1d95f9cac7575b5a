"""A corpus pipeline of five stages; each reads what the one before has written."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from waygraph.llm import decontaminate, langid, neardup, quality_rules, sentencepieces
from waygraph.llm.common import delete, shared_dir, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is a learned one go on; the model learns from the documents' own languages."""
    return langid.keep_documents(docs, langid.train(docs))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules and whose source isn't rejected go on."""
    return quality_rules.keep_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates, by shingles of five words and a similarity of 0.8, the document of least id goes on."""
    return neardup.keep_one(docs, neardup.Linking(words=5, percent=80))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages go on."""
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encoded documents: their piece ids, the text these decode to, counts, and whether it is the document's text."""
    return sentencepieces.encode_counts(docs, sentencepieces.PieceModel.load(sentencepieces.model_path()))


STAGES = [
    ("language", language),
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("pieces", pieces),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows, from all documents. A stage's rows are deleted once the next one's are written."""
    docs = table(spark, sf_dir, "documents")
    top = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    before = None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{top}/{name}")
        docs = spark.read.parquet(f"{top}/{name}")
        if before:
            delete(spark, f"{top}/{before}")
        before = name
    return docs


#: The language and piece stages have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None
