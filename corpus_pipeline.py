"""The corpus pipeline: documents through five of the training-data operators, one Parquet table after the other.

Each stage takes all that the one before kept, and its decisions take effect: rejected rows are gone from what it
returns. All but the last return the columns of documents, with their values as they came.

Every stage decides row by row: rows that share a doc_id, and rows without one, are judged each by its own text. An empty table
gives an empty table. Columns beside those of documents pass through, whatever their names.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.common import numbered, scratch_root, staged, table
from palimpsest.llm.decontamination import contamination
from palimpsest.llm.language_id import identify
from palimpsest.llm.mixing import mixture
from palimpsest.llm.near_dedup import near_duplicates
from palimpsest.llm.queries import MIX
from palimpsest.llm.token_files import token_files

#: A document's language must reach this mean probability, little above what a text without any hint gets.
LEAST_SCORE = 0.3


def named(column: str) -> Column:
    """A column by its whole name, whatever stands in it."""
    return F.col("`" + column.replace("`", "``") + "`")


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs but for the rows whose number is a doc_id of gone. docs: what by_row gives."""
    rest = docs.join(gone.select(F.col("doc_id").alias("row")), "row", "left_anti")
    return rest.select(*(F.col("given").getField(c).alias(c) for c in rest.schema["given"].dataType.names))


def by_row(docs: DataFrame) -> DataFrame:
    """Each row with a number of its own as row (in the order of doc_id, null last, and text), its text, and all of it as given."""
    whole = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.struct(*(named(c) for c in docs.columns)).alias("given"))
    return numbered(whole, scratch_root(docs.sparkSession), nulls_first=False)


def aside(docs: DataFrame, *needed: str) -> DataFrame:
    """docs with all columns but the needed ones under names of their number, which nothing that an operator adds has."""
    return docs.select(*(named(c).alias(c if c in needed else f"given_{k}") for k, c in enumerate(docs.columns)))


def back(found: DataFrame, docs: DataFrame, *needed: str) -> DataFrame:
    """The columns of docs, as they came, from rows of aside(docs)."""
    return found.select(*(F.col(c if c in needed else f"given_{k}").alias(c) for k, c in enumerate(docs.columns)))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a letter (null and empty texts too) or without a recognisable language. A null or repeated doc_id is no reason to drop a row; without a labelled row nothing is recognised, and all go."""
    needed = ("doc_id", "text", "lang")
    own = aside(docs, *needed)
    found = identify(own, keep=own.columns)
    return back(found.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)), docs, *needed)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the row with the smallest id (of equal ids the smallest text; null comes last) of each group of near duplicates, however large. Rows that share an id are compared like any others; texts without words are like nothing and stay."""
    own = by_row(docs)
    return without(own, near_duplicates(own.select(F.col("row").alias("doc_id"), "text")).where("not kept"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop rows of which a twentieth or more stands in the benchmark. Null and empty texts hold nothing of it and stay; without items all stay."""
    own = by_row(docs)
    return without(own, contamination(own.select(F.col("row").alias("doc_id"), "text"), table(spark, sf_dir, "benchmark")).where("contaminated"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take documents to the target weights; one that is taken in two epochs stands twice. A null language or source is a leaf of its own; equal rows are taken together."""
    needed = ("doc_id", "text", "lang", "source")
    found = mixture(aside(docs, *needed), MIX).where("copies > 0")
    return back(found.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies")))), docs, *needed)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Write the token files, in ascending doc_id order (null first, equal ids by text), and return the digest of each document in them. A null text is an empty one."""
    return token_files(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language ID", language), ("MinHash near-dedup", near_dedup), ("benchmark decontamination", decontaminate), ("mixing to target weights", mix), ("token-ID output", tokens)]

#: Learned models and a tokenizer decide, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are written and read again before the next."""
    docs, root = table(spark, sf_dir, "documents"), scratch_root(spark)
    for k, (_, stage) in enumerate(STAGES):
        docs = staged(stage(spark, docs, sf_dir), f"stage{k}", root)
    return docs
