"""Corpus pipeline over documents: language, quality, near duplicates, mixture, tokens.

Each stage takes (spark, docs, sf_dir) and works on all documents that its predecessor kept. run() writes each stage's
result to the folder that executors share and reads it again. Its rows have their place in the mixture.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.bpe import default_tokenizer, digests, encode_decode
from tessera.llm.common import materialize
from tessera.llm.partenum import deduplicate
from tessera.llm.pfair_mix import mixed
from tessera.llm.ppm import identify_languages
from tessera.llm.quality_rules import apply_quality_rules

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A document's place in the mixture, from 0, in run()'s result.
POSITION = "mix_position"


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that is known from the labelled ones; a missing label becomes the predicted language.

    Those without a letter go, and those whose code is much longer, for their size, than the predicted language's own
    texts have: noise, markup, and languages that no label names. The models are learnt from a bounded sample by hash.
    """
    found = identify_languages(docs, docs).where("lang_pred <> 'und' and is_usual")
    return found.withColumn("lang", F.coalesce("lang", "lang_pred")).select(COLUMNS)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules, without the lines that too many texts of their host share."""
    return apply_quality_rules(docs).select(COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each class of near duplicates (five-word shingles, similarity 0.8)."""
    return deduplicate(docs, n=5, percent=80).select(COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order in which blocks of their sources take turns by weight."""
    return mixed(docs).select(COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Numbers of tokens and digests of ids and decoded texts, with the place in the mixture where docs have it."""
    if POSITION not in docs.columns:
        return digests(encode_decode(docs, default_tokenizer()))
    docs = docs.withColumn("__at", F.struct("doc_id", POSITION))
    out = digests(encode_decode(docs, default_tokenizer(), "__at"), "__at")
    return out.select("__at.*", *out.columns[1:])


def positioned(docs: DataFrame) -> DataFrame:
    """docs, a result of materialize(), with the number of rows before each in the order in which they were written.

    Only the number of rows of each file, of which there is one for each partition, reaches the driver.
    """
    file = F.col("_metadata.file_name")
    part = F.regexp_extract(file, r"^part-(\d+)", 1).cast("int")
    counts = docs.select(part.alias("part"), file.alias("file")).groupBy("part", "file").count().orderBy("part", "file").collect()
    starts, before = [], 0
    for r in counts:
        starts.append((r["file"], before))
        before += r["count"]
    starts = docs.sparkSession.createDataFrame(starts, "__file string, __before long")
    placed = docs.select("*", file.alias("__name"), F.col("_metadata.row_index").alias("__row"))
    placed = placed.join(F.broadcast(starts), F.col("__name") == F.col("__file"))
    return placed.select(*docs.columns, (F.col("__before") + F.col("__row")).alias(POSITION))


STAGES = [("language ID", language_id), ("quality rules", quality), ("n-gram Jaccard join", near_duplicates), ("mixing", mixture), ("BPE", tokens)]
#: SQL can express neither PPM nor BPE.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if name == "mixing":  # a later stage deals rows out anew; the place keeps the order
            docs = positioned(docs)
    return STAGES[-1][1](spark, docs, sf_dir)
