"""The corpus pipeline: quality rules, one document of each near-duplicate group, decontamination, pseudonyms, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, with the columns of `documents` but for the last. Other columns go
along whatever their names; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from inkstone.llm import decontaminate, jaccard, packing, pii, quality_rules
from inkstone.llm.queries import EXAMPLE_KEY, table, tokenizer_path
from inkstone.llm.scratch import Scratch


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that keep all quality rules. Null and empty texts have too few words and go; repeated rows are judged alike."""
    mine = [F.col(c).alias(f"_doc_{c}") for c in docs.columns]
    return quality_rules.judge(docs.select(*mine), text="_doc_text").where("kept").select(*(F.col(f"_doc_{c}").alias(c) for c in docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest id, a row without an id last. Rows that repeat are
    copies; texts without words all stay."""
    return jaccard.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark. Null and empty texts have none and stay; items without words match nothing."""
    return decontaminate.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with pseudonyms for personal values; n_chars follows the text. A null text stays null, with null n_chars."""
    out = pii.pseudonymise(docs, EXAMPLE_KEY).drop("pii_kinds")
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents, packed into sequences. A null or empty text is the end token alone; null and repeated ids are
    documents of their own."""
    return packing.pack_documents(docs, tokenizer_path(), with_ids=False)


STAGES = [
    ("quality_rules", quality),
    ("ngram_jaccard_join", near_duplicates),
    ("benchmark_decontamination", decontamination),
    ("pii", pseudonyms),
    ("best_fit_packing", best_fit_packing),
]

#: SQL can't express the pseudonyms and the packing; a test compares the documents it keeps with those expected.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark)
    for name, stage in STAGES[:-1]:
        docs = scratch.table(name, stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
