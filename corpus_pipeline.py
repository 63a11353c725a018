"""The corpus pipeline: five stages over ``documents``, each written and read again as the next one's input.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm import jaccard, langid, mixing, repeats, segments
from weft.llm.common import crc_mod4, table
from weft.sources import remove, shared_folder

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents whose language is accepted; the model learns from those with crc32(doc_id) mod 4 other than 2."""
    model = langid.learn(docs.filter(crc_mod4("doc_id") != 2))
    return langid.identify(docs, model).filter("accepted").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the first document of each group of near duplicates."""
    return jaccard.keep_first(docs.select(*COLUMNS))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts out what stands earlier in the corpus; documents of which nothing is left go."""
    rest = repeats.remove_repeats(docs.select(*COLUMNS), into="text").filter(F.length("text") > 0)
    return rest.withColumn("n_chars", F.length("text").cast("bigint")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each document as often as the mix does, 0 to 2 times."""
    return mixing.mixed(docs.select(*COLUMNS))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled segmentations of every document into piece ids (16 bits each, little endian)."""
    return segments.encode(docs.select("doc_id", "text", "lang", "source"), "doc_id", drop=("text",))


STAGES = [
    ("language ID", language),
    ("n-gram Jaccard join", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("mixing sources to target weights", mix_sources),
    ("SentencePiece encoding", encode_pieces),
]

#: Learning, hashing and sampling have no form in SQL; the tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, top, before = table(spark, sf_dir, "documents"), shared_folder(spark), None
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = f"{top}/{uuid.uuid4().hex}"
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
            if before:
                remove(spark, before)
            before = path
    return docs.withColumn("ids_sha256", F.sha2("ids", 256)).drop("ids")
