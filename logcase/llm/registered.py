"""The thin queries of this subpackage over the test tables, and their SQL."""
from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logcase.llm import bpe_chunks, chat_snapshots, decontaminate, embedding_dup, lexical_search, line_dedup, near_dup, oracles, phrase_mining, quality_model, quality_rules, secret_scan, toxicity, url_rules
from logcase.llm.common import configure, fold, table

VOCABULARY = "byte_bpe_50k.json"


def op1_chat_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    configure(spark)
    return chat_snapshots.format_conversations(table(spark, sf_dir, "conversations"))


def op2_quality_discriminant(spark: SparkSession, sf_dir: str) -> DataFrame:
    configure(spark)
    stats = quality_model.measured(table(spark, sf_dir, "documents"))
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label")).where(fold(F.col("doc_id"), 5) != 0)
    model = quality_model.fit(stats.join(labels, "doc_id"))
    return quality_model.score(stats, model).select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted")


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    configure(spark)
    found = secret_scan.find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"), ("doc_id",))
    kinds = [k for k, *_ in secret_scan.BASE]
    number = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"].isin(kinds))
    return found.select("doc_id", *map(number, kinds), F.sha2(secret_scan.joined(base).cast("binary"), 256).alias("base_sha256"),
                        secret_scan.joined(F.col("spans")).alias("spans"))


def op4_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    configure(spark)
    return decontaminate.leak_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    configure(spark)
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("row.doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op6_bpe_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    configure(spark)
    return bpe_chunks.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))


def op7_toxicity_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    configure(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label")).where(fold(F.col("doc_id"), 4) != 2)
    return toxicity.score(docs, toxicity.fit(docs, labels)).select(
        "doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "score", "predicted")


def op8_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    configure(spark)
    out = url_rules.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), ("page_id",))
    return out.select("page_id", "host", "path", F.when(F.col("site"), F.col("rule")).alias("rule"), "verdict",
                      F.when(~F.col("site"), F.col("rule")).alias("pattern_rule"))


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    configure(spark)
    return near_dup.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    configure(spark)
    return quality_rules.measures(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op11_embedding_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    configure(spark)
    return embedding_dup.near_duplicates(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    configure(spark)
    index = lexical_search.build_index(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return lexical_search.search(index, table(spark, sf_dir, "benchmark").select("item_id", "text")).select("item_id", "rank", "doc_id", "score")


def op13_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    configure(spark)
    found = phrase_mining.collocations(table(spark, sf_dir, "documents").select("text", "lang"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    return found.withColumn("rank", rank).where("rank <= 2000").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


QUERIES = {f.__name__: f for f in (
    op1_chat_snapshots, op2_quality_discriminant, op3_secret_scan, op4_benchmark_leaks, op5_line_dedup, op6_bpe_chunks,
    op7_toxicity_grammar, op8_url_rules, op9_near_duplicates, op10_quality_rules,
    op11_embedding_dup, op12_lexical_search, op13_phrase_mining)}
ORACLE_SQL = {
    "op1_chat_snapshots": oracles.OP1, "op4_benchmark_leaks": oracles.OP4, "op5_line_dedup": oracles.OP5,
    "op8_url_rules": oracles.OP8, "op9_near_duplicates": oracles.OP9, "op10_quality_rules": oracles.OP10,
    "op11_embedding_dup": oracles.OP11, "op12_lexical_search": oracles.OP12, "op13_phrase_mining": oracles.OP13,
}
