"""The registered queries of this subpackage: each operator over its whole table, and its SQL where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import bpe, chat, classifier, decontaminate, divergence, jaccard, licenses, oracles, packing, pii, quality_rules, toxicity, trie, urls


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    """The tokenizer of the packing query; a user passes their own file to the operator."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.find_matches(docs, table(spark, sf_dir, "benchmark"), keep_text=False)
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


#: The key of the registered query; a user of the operator keeps their own.
EXAMPLE_KEY = b"inkstone example key"


def op2_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), EXAMPLE_KEY)
    return found.select("doc_id", "text", F.size("pii_kinds").cast("long").alias("n_values"), F.array_join(F.array_sort(F.array_distinct("pii_kinds")), ",").alias("kinds"))


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id bigint, turn bigint, role string, text string")
    return chat.format_conversations(rows.unionByName(own), with_text=False)


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text"), weak=licenses.WEAK)
    joined = lambda c: F.array_join(c, ",").alias(c)
    return found.select("doc_id", F.size("sentence_ids").cast("long").alias("n_known"), joined("sentence_ids"), joined("licenses"), joined("unmatched"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urls.classify(pages, urls.EXAMPLE_RULES).select("page_id", "host", "path", "rule", "verdict")


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.link(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.score(docs, table(spark, sf_dir, "labels"), keep_text=False).select("doc_id", "held_out", "score", "predicted")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path(), with_ids=False)


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return classifier.score(docs, table(spark, sf_dir, "labels"), keep_text=False).select("doc_id", "held_out", "score", "predicted")


def op11_bpe_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path(), with_ids=False)


def op12_source_divergence_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents").select("text", "lang", "source"))


def op13_conversation_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return trie.prefix_trie(rows, with_text=False, rebuild=trie.with_shared_heads)


QUERIES = {
    f.__name__: f
    for f in (
        op1_decontamination,
        op2_pii_pseudonyms,
        op3_chat_format,
        op4_license_scan,
        op5_url_filter,
        op6_ngram_jaccard_join,
        op7_toxicity,
        op8_quality_rules,
        op9_best_fit_packing,
        op10_quality_classifier,
        op11_bpe_encode_decode,
        op12_source_divergence_audit,
        op13_conversation_prefix_trie,
    )
}
ORACLES = oracles.ORACLES
