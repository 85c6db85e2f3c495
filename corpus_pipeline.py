"""Corpus pipeline: from raw documents to token ids, in five stages, each on all that its predecessor kept.

Every stage takes (spark, docs, sf_dir) and returns the columns of `documents`; the last one returns the encoded
documents. Between stages the rows are written as Parquet and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roboframe.llm import common
from roboframe.llm.benchmark_decontamination import decontaminate
from roboframe.llm.bpe import default_path, encode_documents
from roboframe.llm.ngram_jaccard_join import jaccard_components
from roboframe.llm.suffix_array_dedup import remove_repeats
from roboframe.llm.toxicity_chain import fit, toxicity


#: Bytes of the shortest repeated string that is cut out: less than 51 words of five bytes with their blanks.
REPEATED = 240


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain rejects go. Fitted on the labelled ones among docs."""
    common.prepare(spark)
    labels = common.table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label"))
    toxic = toxicity(fit(docs, labels))
    return docs.where(~toxic(F.col("text").cast("string"))["is_toxic"])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word shingles, similarity 0.8 or more) the smallest doc_id stays."""
    common.prepare(spark)
    groups = jaccard_components(docs)
    return common.without(docs, groups.where("component_id <> doc_id"), "doc_id")


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte strings of REPEATED or more that occur elsewhere are cut out, which are passages of over 50 words at least; a
    document of which nothing is left goes. A character that a cut splits goes with it."""
    common.prepare(spark)
    # columns that the operator doesn't need go through it under names of their own
    other = {c: f"other_{k}" for k, c in enumerate(docs.columns) if c not in ("doc_id", "text")}
    own = docs.select("doc_id", "text", *(F.col(f"`{c}`").alias(x) for c, x in other.items()))
    out = remove_repeats(own, REPEATED, REPEATED // 2, carry=tuple(other.values()), with_text=True)
    values = {c: F.col(x) for c, x in other.items()} | {"doc_id": F.col("doc_id"), "text": F.col("kept_text")}
    if "n_chars" in other:
        values["n_chars"] = F.when(F.col("n_removed") > 0, F.length("kept_text").cast("long")).otherwise(F.col(other["n_chars"]))
    return out.where("n_removed = 0 OR length(kept_text) > 0").select(*(values[c].alias(c) for c in docs.columns))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    common.prepare(spark)
    found = decontaminate(docs, common.table(spark, sf_dir, "benchmark"))
    return common.without(docs, found.where("contaminated"), "doc_id")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left, with their digests."""
    common.prepare(spark)
    return encode_documents(docs, default_path(), carry=("lang", "source"), with_ids=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("suffix_array_dedup", cut_repeats),
    ("benchmark_decontamination", drop_contaminated),
    ("bpe_encoding", encode),
]

#: SQL can't express the stages. Tests hold each but the first against brute force: the rows that stay, their texts and lengths. Of
#: the first they check that exactly the documents that the chain rejects go; the chain has tests of its own.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
