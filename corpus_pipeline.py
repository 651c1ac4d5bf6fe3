"""Raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a table, which is written as Parquet and read again
as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievelake.llm import exactdedup, mixing, neardup, packing, registry, toxicity
from sievelake.llm.common import Scratch
from sievelake.session import ship

NEEDED = ("doc_id", "text", "lang", "source")


def apart(docs: DataFrame, needed: tuple[str, ...] = NEEDED) -> tuple[DataFrame, list]:
    """``docs`` with all columns but the needed ones under names that no operator has, and what gives them their own again."""
    names = {c: c if c in needed else f"_stage_{i}" for i, c in enumerate(docs.columns)}
    return docs.select(*[F.col(c).alias(k) for c, k in names.items()]), [F.col(k).alias(c) for c, k in names.items()]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under 0.5; learned from the labels, less the held-out ones. A null or empty text scores low and stays, as do rows without id."""
    ship(spark)
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.filter(toxicity.score(model, F.col("text")) < 0.5)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of identical texts the row with the largest id; a null text counts as empty. Of rows that repeat an id and its text one stays; a null id stays only if no other row has its text."""
    docs, back = apart(docs)
    told = exactdedup.exact_dedup(docs, keep="max", carry=tuple(c for c in docs.columns if c != "doc_id"))
    return told.filter("kept").select(*back)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies the row with the least id. A null text counts as empty; empty texts are identical.

    Rows are told apart by id and text, so of rows that repeat an id only those whose own text is a near copy go. Rows
    without id stay.
    """
    ship(spark)
    docs, back = apart(docs)
    gone = neardup.near_duplicates(docs).filter("not kept").select(F.col("doc_id").alias("_gone"), F.col("text_sha256").alias("_gone_sha")).distinct()
    told = docs.withColumn("_text_sha", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256))
    # the same plan at every size: texts are shuffled once, whether or not few of them go
    return told.join(gone.hint("merge"), (F.col("doc_id") == F.col("_gone")) & (F.col("_text_sha") == F.col("_gone_sha")), "left_anti").select(*back)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document at most once, up to its leaf's share of four fifths of all tokens. A null or empty text has no tokens and comes along where its place in the order is within the prefix; rows that repeat an id go together."""
    docs, back = apart(docs)
    mixed = mixing.mix(docs, registry.mix_levels(), registry.MIX_WEIGHTS, fraction=0.8, max_epochs=1)
    return mixed.select(*back)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 2048 tokens. A null or empty text is its end token; rows that repeat are packed each."""
    ship(spark)
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("toxicity", drop_toxic), ("exact_dedup", drop_copies), ("near_dedup", drop_near_copies), ("mixing", mix), ("packing", pack)]

#: SQL has no edit automata, alignment or tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        scratch = Scratch(spark)
        docs = scratch.settle(stage(spark, docs, sf_dir), name)
        if before:
            before.drop()
        before = scratch
    # packing has written its pieces when it returns but for those that it makes of them
    packed = STAGES[-1][1](spark, docs, sf_dir)
    before.drop()
    return packed
