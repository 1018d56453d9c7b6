"""A corpus pipeline of five operators: toxicity, near duplicates, repeated passages, personal data, packing.

Each stage reads all rows that the stage before it kept, written as Parquet in between, so a lost executor costs one
stage at most. All stages but the last return the columns of ``documents``.

Each stage has a row for every row that it keeps, repeated ones too; a null text counts as empty, rows with a null id and
nulls in other columns stay, and an empty table gives an empty one. Columns beside those of ``documents`` go, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import jaccard_join, packing, pii, substring_dedup, toxicity
from textloom.llm.common import keep, small, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
_CARRY = ("lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored under 0.5 stay as they are; one at 0.5 goes. Repeated rows are scored alike. Empty texts have a score as others have."""
    model = toxicity.fit_sample(toxicity.sample(docs, table(spark, sf_dir, "labels")))
    return toxicity.score(docs, model, carry=("text", *_CARRY)).where("predicted = 0").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest doc_id stays.

    Decisions go by id: rows of one id stay or go together, whatever their texts, and are linked if one of them is. Texts
    without a word are linked with nothing and stay, as do rows with a null id.
    """
    extra = keep(jaccard_join.near_duplicates(docs).where("component_id <> doc_id").select("doc_id").distinct(), "extra")
    return docs.join(small(extra), "doc_id", "left_anti").select(*COLUMNS)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that an earlier document holds go; texts that lose nothing stay as they are.

    Of rows with one id none is earlier than the other, so neither loses what both hold.
    """
    out = substring_dedup.without_repeats(docs, carry=("text", *_CARRY))
    cut = F.size("spans") > 0
    return out.select("doc_id", F.when(cut, F.col("kept")).otherwise(F.col("text")).alias("text"), "lang", "source", F.when(cut, F.length("kept").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and secrets are replaced by their kind; every document stays.

    A run of overlapping spans is replaced once. Empty texts stay empty.
    """
    found = pii.find(docs, carry=_CARRY)
    any_ = F.size("spans") > 0
    out = pii.redact(found.withColumn("hit", any_))
    return out.select("doc_id", "text", "lang", "source", F.when(F.col("hit"), F.length("text").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A place in a training sequence for each piece of every document; an empty text is one piece, its end id. Pieces of one length may change places."""
    pieces = packing.token_pieces(docs)
    return packing.pack(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("substring_dedup", cut_repeats),
    ("personal_data", redact_personal_data),
    ("packing", pack_sequences),
]

#: SQL can't express these stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, one after another."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = keep(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
