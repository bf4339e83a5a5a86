"""A corpus pipeline of five stages, each written as Parquet and read again by the next.

Toxic documents go; lines that many documents share stay in one of them; of near copies one stays; sources are mixed
to target weights (every document at least once, sources below their share again); texts are encoded and decoded. All
stages but the last return the columns of the table that they are given, whatever else it holds beside the five of
``COLUMNS``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from termloom.functions.shared import staged
from termloom.llm import byte_bpe, line_dedup, mixing, simhash, toxicity

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _apart(docs: DataFrame) -> DataFrame:
    """``_doc_id``, ``_text`` and all other columns in one, where no name can clash."""
    others = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select(F.col("doc_id").alias("_doc_id"), F.col("text").alias("_text"), F.struct(F.lit(0).alias("_"), *others).alias("_others"))


def _together(apart: DataFrame, docs: DataFrame, **new: Column) -> DataFrame:
    """The columns of ``docs`` again, those of ``new`` in place of the old ones."""
    new = {"doc_id": F.col("_doc_id"), "text": F.col("_text")} | new
    return apart.select(*[(new[c] if c in new else F.col("_others").getField(c)).alias(c) for c in docs.columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text scores below one half stay, null and blank texts among them if their score does.

    Rows are independent, so null and repeated ids, ties and repeated rows make no difference; an empty table stays empty.
    """
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _together(toxicity.score(_apart(docs), model, "_doc_id", "_text").where("_score < 0.5"), docs)


def drop_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row stays; ``text`` loses lines, ``n_chars`` follows it. A null text becomes empty. Repeated rows: see the operator."""
    out = line_dedup.line_dedup(_apart(docs), "_doc_id", "_text")
    return _together(out, docs, n_chars=F.length("_text").cast("long"))


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component the row with the smallest id stays, of rows without a word, of repeated rows and of equal ids too, one."""
    return simhash.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row stays; rows of sources below their weight are there more than once.

    The written files, by name, follow the schedule, and each is a stretch of it in its order; Spark reads them again in
    any order of files, each in its own, so that every part that it reads is mixed to the weights.
    Rows are told apart by themselves, so null and repeated ids make no difference; a null source is a source.
    """
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids (binary, unsigned 32-bit little-endian) of every row and the digests of ids and decoded bytes."""
    return byte_bpe.encode_documents(docs, *byte_bpe.default_vocabulary())


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_shared_lines),
    ("simhash near-dedup", one_of_near_copies),
    ("mixing", mix_sources),
    ("byte-level bpe", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)


#: Learning and binary code fingerprints are beyond SQL; tests/llm holds the stages against plain versions.
ORACLE_SQL = None
