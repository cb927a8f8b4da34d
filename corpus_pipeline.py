"""A training corpus from documents: rate, clean, deduplicate, mix, segment.

Each stage takes (spark, docs, sf_dir) and returns what goes on; all but the last keep
the columns of documents. A stage's rows are written to the shared folder and read from
there by the next one, so that a lost executor repeats tasks of one stage only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from labelweave.llm import cotraining, linededup, mixing, segmentations, simhash
from labelweave.llm.queries import table, vocabulary
from labelweave.llm.rounds import stored


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier keeps."""
    return cotraining.good_documents(docs, table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that an earlier line has, or nearly has."""
    return linededup.line_dedup(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of texts with near fingerprints."""
    return simhash.first_of_groups(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix of sources takes of the documents, as often as it takes it."""
    return mixing.mixed(docs)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Two sampled segmentations of each document, as piece ids."""
    return segmentations.segmentations(docs, vocabulary("piece_bpe_32k.model"))


STAGES = [
    ("quality classifier", quality),
    ("line dedup", lines),
    ("simhash near-dedup", near_duplicates),
    ("mixing sources", mix),
    ("sentencepiece segmentations", pieces),
]

#: No SQL: the classifier is fitted and the segmentations are sampled.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs
