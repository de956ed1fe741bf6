"""From raw documents to token ids, in five stages, each over all that the one before it kept.

Defined cases of the first four stages: all columns of the documents stay, extra ones included, whatever their names; nulls in lang, source, n_chars
and extra columns stay as they are; an empty table stays empty; texts of any length are read whole. What becomes of null and empty
texts, null ids, repeated rows and ties is said at each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomlog.llm import decontaminate, langid, pieces, secrets, simhash
from loomlog.llm.common import drop_folder, new_folder, stage, table, working_in


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a recognisable language go: those whose text is null or holds no letter, or all, where no row has a label to learn from.

    Rows are judged by their text alone, so repeated rows and rows with a null id stay or go alike; of languages that cost the same the first by
    name is taken, which keeps the document either way.
    """
    return langid.known_language(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, a similarity of 0.8 or more) the document with the smallest id stays.

    Null, empty and word-less texts are copies of one another, so one of all these stays. An id names a document: of several rows with it one stays, that
    with the first text in order. Rows with a null id cannot be told apart and all stay; they do not take the place of a document with an id.
    """
    return simhash.keep_one(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents contaminated with benchmark passages go; single passages are taken out of the others, and n_chars follows.

    Null and empty texts have no words and stay; repeated rows and rows with a null id are treated by their text. Without benchmark items nothing changes.
    """
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def secret_values(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; the values of secrets in it are replaced, and n_chars with them.

    Null and empty texts, and those without a secret, stay as they are; of overlapping secrets the first one's kind is written.
    """
    return secrets.redact(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each row, as many rows as there are. A null text has null ids and a null count, an empty one no ids; other columns are left out.

    Of segmentations with equal scores the one with the longer last piece is taken.
    """
    return pieces.encode(docs).selectExpr("doc_id", "cast(size(ids) as bigint) as n_tokens", "ids", "round_trip")


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("benchmark", benchmark),
    ("secrets", secret_values),
    ("tokens", tokens),
]

#: Automata, fingerprints and segmentation are beyond SQL; tests hold the result against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each is written to the shared folder and read again by the next.

    What a stage has used goes once its result is written, so the folder holds two stages at most.
    """
    folder = new_folder(spark, "pipeline")
    docs, before = table(spark, sf_dir, "documents"), None
    for name, step in STAGES:
        with working_in(spark, f"{folder}/{name}-work"):
            docs = stage(step(spark, docs, sf_dir), name, folder)
        if before:
            drop_folder(spark, f"{folder}/{before}")
        before = name
    return docs
