"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again for the next.

Each stage takes the columns of documents from what it is given and ignores others; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strayfield.llm.common import persisted, table
from strayfield.llm.decontam import clean
from strayfield.llm.language_id import familiar, learned, with_language
from strayfield.llm.mixing import Mix
from strayfield.llm.neardup import deduplicated
from strayfield.llm.pii import sanitised

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or of too few trigrams that the language found is known to have, go; ``lang`` becomes the language found.

    Null and empty texts have no letter. Repeated rows are judged alike; where no row has a language to learn from, all go.
    """
    model = learned(docs)
    found = with_language(docs.select(COLUMNS), model, known=familiar(docs, model))
    return found.where(F.col("lang_pred") != "und").select("doc_id", "text", F.col("lang_pred").alias("lang"), "source", "n_chars")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five words, similarity 0.8) the document with the smallest id stays; of rows that repeat id and text one.

    Texts without words, and rows without an id, all stay.
    """
    return deduplicated(docs.select(COLUMNS))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share ten consecutive words, or a whole shorter item, with the benchmark go. Of rows that repeat an id each goes by its own text."""
    return clean(docs.select(COLUMNS), table(spark, sf_dir, "benchmark"))


def sanitise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and the words that disclose it are generalised in ``text``; ``n_chars`` follows. No row goes; a null text stays null, as does its n_chars."""
    return sanitised(docs.select(COLUMNS)).withColumn("n_chars", F.char_length("text").cast("long")).select(COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words of each document the mix to target weights takes. A row per row; a null text has no words, a null source is one of its own."""
    return Mix(docs).documents()


STAGES = [("language ID", language), ("MinHash near-dedup", near_dedup), ("benchmark decontamination", decontaminate), ("PII", sanitise), ("mixing sources to target weights", mix)]

#: MinHash candidates and the fitted language model have no SQL form: tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = persisted(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return docs
