"""A corpus pipeline: toxic documents go, copies and near copies go, sources are mixed, the mix is packed into sequences.

Each stage takes ``(spark, docs, sf_dir)`` and works on every row its predecessor kept; all but the last return the
columns of ``documents``. ``run`` writes each stage's result as Parquet to the shared folder and reads it for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialmesh.llm.exact_dedup import exact_dedup
from trialmesh.llm.mixing import mix, mixed_rows, slim_documents
from trialmesh.llm.ngram_join import ngram_join
from trialmesh.llm.packing import pack
from trialmesh.llm.queries import quality_weight, table
from trialmesh.llm.rows import chosen, numbered, slim
from trialmesh.llm.tokens import tokenizer_path
from trialmesh.llm.toxicity import without_toxic
from trialmesh.runtime import Scratch


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain, fitted on the table of labels, doesn't find toxic."""
    return without_toxic(docs, table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    scratch = Scratch(spark)
    rows = numbered(docs, scratch)
    decided = exact_dedup(slim(rows, "doc_id", "text"), row_col="_row", scratch=scratch)
    return chosen(rows, decided.filter("kept"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of each component of similar texts."""
    scratch = Scratch(spark)
    rows = numbered(docs, scratch)
    joined = ngram_join(slim(rows, "doc_id", "text"), row_col="_row", scratch=scratch)
    return chosen(rows, joined.filter(F.col("_row") == F.col("component_row")))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; at most one document per source is cut to its first words."""
    scratch = Scratch(spark)
    rows = numbered(docs, scratch)
    sizes = slim_documents(slim(rows, "doc_id", "source", "text"), row_col="_row")
    taken = mix(quality_weight(sizes, table(spark, sf_dir, "labels")), F.col("quality_weight"), scratch=scratch)
    return mixed_rows(rows, taken)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 2,048 tokens."""
    return pack(docs, tokenizer_path("word_bpe_49k.json"), end=1).withColumn("ids_crc32", F.crc32("ids")).drop("ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("ngram_join", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

# The first stage is a trained classifier, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = scratch.table(stage(spark, docs, sf_dir), name)
    return docs
