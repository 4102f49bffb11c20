"""A corpus pipeline over ``documents``: quality rules, line dedup, near-dedup, decontamination, byte-level BPE.

Every stage works on all rows that the stage before it kept; all but the last
return the columns of ``documents``, with n_chars following the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm.byte_bpe import encode_documents
from barloom.llm.common import hidden
from barloom.llm.decontamination import without_contaminated
from barloom.llm.line_dedup import dedup_lines
from barloom.llm.near_duplicates import keep_one_of_each
from barloom.llm.quality import QualityParameters, filter_documents
from barloom.llm.queries import byte_bpe_50k, table
from barloom.session import staged

# a count of texts alone, which does not rise with the host
LINE_LIMITS = QualityParameters(min_documents=10, max_share=0.0)


def _with_length(docs: DataFrame) -> DataFrame:
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go; lines that more than ten different texts of a host share go from the others."""
    return _with_length(filter_documents(docs, LINE_LIMITS))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines similar to an earlier line go, and with them documents of which no word is left."""
    # columns that bear the names of the operator's counts step aside
    own = [c for c in docs.columns if c.lower() in ("n_lines", "n_removed")]
    aside = dict(zip(own, hidden(docs, *[f"_{c}" for c in own])))
    kept = dedup_lines(docs.withColumnsRenamed(aside)).where("n_lines = 0 or n_removed < n_lines").drop("n_lines", "n_removed")
    return _with_length(kept.withColumnsRenamed({a: c for c, a in aside.items()}))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: five-word shingles, a similarity of 0.8 or more."""
    return keep_one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the text decoded from them."""
    return encode_documents(docs, byte_bpe_50k())


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("byte_bpe", byte_bpe),
]

# byte-level BPE can't be said in SQL
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
