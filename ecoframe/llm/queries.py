"""The registered queries of this subpackage and the SQL that DuckDB runs beside them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ecoframe.llm import (
    decontaminate, filter_audit, mixing, pii, prefix_trie, quality_rules, repeated_phrases, secrets_index, simhash, suffix_sort,
    toxicity, url_templates, warc)
from ecoframe.llm.common import spans_text, table
from ecoframe.llm.oracles import ORACLE  # noqa: F401


def op1_qgram_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return hits.select("doc_id", "item_id", "start", "end", "edits")


def op2_anchor_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents"))
    base = F.filter("found", lambda s: s["kind"].isin(*pii.KINDS[:4]))
    return found.select("doc_id", *[pii.n_of(kind).alias(f"n_{kind}") for kind in pii.KINDS[:4]],
                        F.sha2(spans_text(base), 256).alias("base_sha256"), spans_text(F.col("found")).alias("spans"))


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op4_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_templates.judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op5_phrase_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_phrases.summary(table(spark, sf_dir, "documents"))


def op6_salvage_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_and_read(table(spark, sf_dir, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_suffix_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_sort.summary(table(spark, sf_dir, "documents"))


def op8_deletion_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.components(table(spark, sf_dir, "documents"))


def op9_trigram_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = secrets_index.RULES
    found = secrets_index.scan(table(spark, sf_dir, "documents"))
    count = lambda i: F.size(F.filter("found", lambda s: s["rank"] == i)).cast("long")
    base = F.filter("found", lambda s: s["rank"] < sum(rule.base for rule in rules))
    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
                        F.sha2(spans_text(base), 256).alias("base_sha256"), spans_text(F.col("found")).alias("spans"))


def op10_rule_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(prefix_trie.rebuilt(table(spark, sf_dir, "conversations")))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_string_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {f.__name__: f for f in (
    op1_qgram_leaks, op2_anchor_pii, op3_mix_sources, op4_url_templates, op5_phrase_automata, op6_salvage_warc,
    op7_suffix_sort, op8_deletion_simhash, op9_trigram_secrets, op10_rule_ledger, op11_prefix_trie, op12_filter_audit,
    op13_string_kernel)}
