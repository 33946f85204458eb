"""The corpus pipeline: documents through toxicity, language, line and document de-duplication to packed sequences.

Every stage takes all that the one before it kept. The first four return the columns of documents; text and n_chars follow what a stage does to a text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tellurion.llm import language, line_dedup, ngram_join, packing, toxicity
from tellurion.llm.common import crc_mod, read, stash
from tellurion.llm.queries import TOKENIZER


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model, learnt from the labels of ids that aren't held out, scores under 0.5."""
    labels = read(spark, sf_dir, "labels").where(crc_mod("doc_id", 5) != 0)
    scored = toxicity.score(docs, toxicity.fit(docs, labels), docs.columns)
    return scored.where("predicted = 0").select(*docs.columns)


def drop_unknown_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a letter whose language the trees tell with a posterior of 0.5 or more."""
    trees = language.fit(docs.where(crc_mod("doc_id", 4) != 2))
    predicted = language.predict(docs, trees, docs.columns)
    return predicted.where("lang_pred <> 'und' and score >= 0.5").select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, less the lines that repeat or resemble one before them."""
    kept = line_dedup.dedup(docs)
    return kept.withColumn("n_chars", F.when(F.size("removed_lines") > 0, F.char_length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of documents with a Jaccard similarity of 0.8 or more over five-word shingles, the one with the smallest doc_id."""
    found = ngram_join.join(docs, n=5, percent=80)
    gone = found.where("component_id <> doc_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents' tokens in full sequences of up to 4096."""
    return packing.pack(docs, TOKENIZER, remember=32 << 20)


STAGES = [("toxicity", drop_toxic), ("language", drop_unknown_languages), ("line_dedup", drop_repeated_lines), ("ngram_join", drop_near_copies), ("packing", pack)]
#: The stages learn models and hash n-grams: SQL doesn't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each stage's rows are written to the shared folder and read again."""
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
