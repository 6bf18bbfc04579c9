"""A training corpus from raw documents, stage by stage; each stage reads what the one before wrote.

Quality rules drop bad documents, of each group of near copies one stays, passages that repeat an earlier
document's are cut out, sources are mixed to equal weights, and token sequences are packed.

Nulls, repeats and ties. Null texts fail the quality rules. Null ids pass quality, near copies (as rows of their own) and
passages untouched, and are mixed and packed like any other. Of rows that share doc_id and text one passes near copies; of a
group the smallest doc_id, of a passage the first document keeps it. Texts are read whole in all stages. An empty table gives an empty result. All stages but the last
return the columns of their input as they are, whatever their names, but for text and n_chars after passages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corroborate.llm.common import scratch, table
from corroborate.llm.mixing import mix_sources
from corroborate.llm.ngram_jaccard import BROADCAST_IDS, jaccard_components
from corroborate.llm.packing import pack, tokenised
from corroborate.llm.passages import shared_passages, without_repeats
from corroborate.llm.quality_rules import keep_good, train


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the trees fitted on the labelled documents."""
    return keep_good(docs, train(docs, table(spark, sf_dir, "labels")))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of the Jaccard join: that with the smallest doc_id; null ids stay."""
    components = jaccard_components(docs).filter("doc_id is not null and doc_id <> component_id").select("doc_id").distinct()
    gone = scratch(components, "pipeline-gone")
    few = gone.count() <= BROADCAST_IDS
    kept = docs.join(F.broadcast(gone) if few else gone, "doc_id", "left_anti").select(*docs.columns)
    # rows that share doc_id and text: one stays; only ids that occur again are shuffled with their texts
    again = scratch(docs.groupBy("doc_id").count().filter("count > 1").select("doc_id"), "pipeline-again")
    if again.isEmpty():
        return kept
    return kept.join(again, "doc_id", "left_anti").select(*docs.columns).unionByName(kept.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"]).select(*docs.columns))


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier one holds; n_chars follows the text."""
    out = without_repeats(docs, shared_passages(docs))
    return out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out so that each source has the same expected number of rows."""
    return mix_sources(docs).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their sequences and offsets."""
    return pack(tokenised(docs))


STAGES = [("quality rules", quality), ("near copies", near_copies), ("passages", passages), ("mixing", mixing), ("packing", packing)]

#: Trees, chains and tokens aren't SQL; tests hold each stage against a plain version on what the stage before it kept.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
