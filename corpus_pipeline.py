"""From documents to token files: quality, near duplicates, benchmark items, mixture, tokens.

A stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again
as the ``docs`` of the next one. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from uuid import uuid4

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colweave.llm.decontamination import drop_leaks
from colweave.llm.mixing import mixed_rows
from colweave.llm.quality import keep_good, train_quality
from colweave.llm.queries import tokenizer_file
from colweave.llm.simhash import RADIUS, drop_near_duplicates
from colweave.llm.token_files import read_token_files, write_token_files
from colweave.sources.staging import shared_folder, stage


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble, learned from the labels, does not reject.

    A null or empty text is scored like any other and repeated rows stay or go together. Without
    labels the score is constant and nothing is rejected. No rows give no rows.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return keep_good(docs, train_quality(docs, labels))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of SimHash links the document of the smallest id.

    Fingerprints are of three-word shingles and link at ``RADIUS`` differing bits or fewer. Texts
    without words, null ones too, share fingerprint zero. A null id counts as the largest; of rows
    that share the smallest id one stays. No rows give no rows.
    """
    return drop_near_duplicates(docs, reach=RADIUS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item.

    Null and empty texts hold none; repeated rows stay or go together. Without items all rows stay.
    """
    return drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order of the mixture: of the files by name, and of the rows in a file.

    A null source is a source of its own; null texts and repeated rows stay. No rows give no rows.
    """
    return mixed_rows(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per document, read back from the token files, which follow the order of the mixture.

    A null or empty text has the end id alone; null ids and repeated rows stay. No rows give no rows.
    """
    folder = f"{shared_folder(spark)}/token-files-{uuid4().hex}"
    files = write_token_files(docs, folder, tokenizer_file(), order_by=row_order(docs))
    return read_token_files(files)


def row_order(docs: DataFrame) -> list[Column]:
    """The order in which files hold their rows; of rows that come from no file, as they come."""
    order = [F.col("_metadata.file_name"), F.col("_metadata.row_index")]
    try:
        docs.select(*order)
    except AnalysisException:
        return [F.monotonically_increasing_id()]
    return order


STAGES = [
    ("quality classifier", quality),
    ("near-dedup", near_dedup),
    ("benchmark decontamination", decontaminate),
    ("source mixing", mix),
    ("token files", tokens),
]

#: SQL cannot express the classifier; the tests hold the rows against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over all of ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
