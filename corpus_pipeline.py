"""A corpus pipeline: quality, near copies, secrets, mixture, packing.

Every stage takes the columns of documents and any others, whatever their names,
and all but the last return the same columns. An empty table stays empty in all
of them; texts of any length are read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillfold.llm import jaccard_join, mixing, packing, quality, secret_scan
from quillfold.llm.common import materialise, table

#: Every document is taken at least once, and none more than twice.
MIXTURE = mixing.MixingParams(keep_all=True, max_repeats=2.0)


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line chain rejects go; labels of all folds may teach it.

    Texts without words (null, empty, blank) go. Rows are judged one by one, so repeated rows and ties go or stay together. Without labels of both kinds only texts without words go.
    """
    model = quality.fit(docs, table(spark, sf_dir, "labels"), held_out=None)
    return quality.keep_good(docs, model)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, that of the smallest id: five-word shingles, similarity 0.8 or more.

    Texts without words are in no group and stay; so do rows without an id. Rows of one id are one document and stay or go together.
    """
    return jaccard_join.one_of_each(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Live secrets are masked in the text; widely copied examples stay.

    No row goes. Null texts stay null; a null source or language is one unknown party; n_chars follows a text that changed.
    """
    return secret_scan.redact(docs, repo_cols=("source", "lang"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document once, and those of small sources again, up to twice.

    A null source is a source of its own; null and empty texts count one token. Rows of one id are repeated together.
    """
    return mixing.mix_documents(docs, MIXTURE)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences; a null or empty text is its end id alone, and repeated rows are packed each for itself."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality classifier", keep_good),
    ("n-gram Jaccard join", drop_near_copies),
    ("secret scans", redact_secrets),
    ("mixing sources", mix_sources),
    ("packing", pack_sequences),
]

#: The trained chain, the graph search and the tokeniser can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each one's result written to the shared folder and read by the next."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs, f"pipeline-{k}")
    return docs
