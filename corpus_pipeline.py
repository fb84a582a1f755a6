"""The corpus pipeline: toxic documents go, repeated lines go, near copies go, sources are mixed, texts are encoded.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
one's docs. All stages but the last return the columns of documents; the last gives doc_id, n_tokens and ids, a row
for each copy that the mix takes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.llm import bpe, linededup, mixing, nearcopies, toxicity
from inkwell.llm.common import fresh, saved, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity network rejects go; it learns from the labels of documents outside the held-out fifth.
    Null, empty and very long texts, repeated rows and empty tables: see `toxicity.without_toxic`."""
    return toxicity.without_toxic(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of repeated three-line windows go; n_chars follows the text. Every document keeps its row."""
    own = [c for c in docs.columns if c.lower() in ("n_lines", "n_removed")]  # of the documents, not of the operator
    aside = dict(zip(own, fresh(docs, *(f"own_{c}" for c in own)), strict=True))
    out = linededup.dedup_lines(docs.withColumnsRenamed(aside))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*(F.col(f"`{aside.get(c, c)}`").alias(c) for c in docs.columns))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity 0.8) the document with the smallest doc_id stays. The Gray
    index over SimHash fingerprints meets what differs in 3 bits; bands of min-hashes meet the rest, which is most of it,
    and each pair counts by its exact similarity."""
    return nearcopies.one_of_each(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them: not at all, once, or up to three times."""
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids) of every row; other columns are dropped. Null and empty texts have no ids, very long ones are
    encoded whole, an empty table gives an empty one."""
    return bpe.encode_documents(docs).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("simhash_dedup", drop_near_copies),
    ("mixing", mix),
    ("bpe", encode),
]
#: A trained network, a hierarchical index and BPE are beyond SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), name)
    return docs
