"""A corpus pipeline: quality, repeated lines, near-duplicates, source mix, packing.

STAGES are (name, function) pairs; a function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next one's docs. All but the last return the columns of documents.

Defined results, for every stage: other columns than those of documents are dropped, whatever their names; an empty
table gives an empty one. Nulls, empty texts, ties and repeated rows are told stage by stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernel.llm.bm25_packing import pack
from quernel.llm.common import cut
from quernel.llm.line_dedup import dedup_lines
from quernel.llm.ordinal_quality import grade, scored, train
from quernel.llm.simhash_slices import keep_similar
from quernel.llm.source_mixing import mixed_documents

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _sized(docs: DataFrame) -> DataFrame:
    """docs with n_chars of the text as it is now."""
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of the best grade is at least one half; the model is trained on the rated ones.

    A null text is judged as an empty one; repeated rows are judged alike; of several ratings of a document the lowest
    counts; ratings with a null and those without a document count for nothing; without ratings all documents stay.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    ratings = labels.select(F.col("doc_id").alias("id"), grade().alias("grade"))
    return scored(docs.select(*COLUMNS), train(docs, ratings)).where("keep").select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later repeated runs of lines; those of which only white space is left go.

    A null or empty text stays as it is, for nothing was removed from it; a row with a null doc_id neither removes nor
    loses lines; rows that share a doc_id and repeat each other stay alike. n_chars is that of the text that is left.
    """
    out = dedup_lines(docs.select(*COLUMNS))
    return _sized(out.where("n_removed = 0 or text rlike '[^\\\\x20\\\\x09-\\\\x0D]'"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group at a Jaccard similarity of five-word shingles of 0.8 or more: that with the least doc_id.

    Null, empty and blank texts are one group; of rows that repeat the least doc_id one stays; rows with a null doc_id
    go where their group has a doc_id, and one of them stays where it has none.
    """
    return keep_similar(docs.select(*COLUMNS))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in the source mix: per pass over its source, a document with the words that were drawn.

    A null source is a source of its own, last; documents without words are not drawn; repeated rows are drawn as rows
    of their own.
    """
    return _sized(mixed_documents(docs.select(*COLUMNS)))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in training sequences. A null text is an empty one; repeated rows are packed once each."""
    return pack(docs.select(*COLUMNS))


STAGES = [
    ("quality classifier", quality),
    ("line dedup", lines),
    ("SimHash near-dedup", near_duplicates),
    ("mixing", mixing),
    ("packing", packing),
]

#: A trained classifier and pseudorandom draws decide the rows, so SQL cannot give them; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; every stage's result is a table in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
