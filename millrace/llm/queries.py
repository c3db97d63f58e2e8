"""Registered queries over the text tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from millrace.llm.collocations import COLLOCATIONS_SQL, collocations
from millrace.llm.decontaminate import CONTAMINATED_SQL, contaminated
from millrace.llm.factorization import fit_machine, learnable, quality_scores, score_digest
from millrace.llm.html_extract import extract_text
from millrace.llm.interpolation import text_scores
from millrace.llm.license_scan import license_digest, license_scan, license_sql
from millrace.llm.packing import pack
from millrace.llm.quality_rules import fit_rules, quality_rules
from millrace.llm.secret_scan import infer_formats, secret_digest, secret_scan
from millrace.llm.signature_join import near_clusters, similar_documents
from millrace.llm.simhash import near_fingerprints
from millrace.llm.token_counts import token_counts
from millrace.llm.turn_repair import damaged, repair_digest
from millrace.tables import table

Build = Callable[[SparkSession, str], DataFrame]

BUILDS: dict[str, Build] = {}
SQL: dict[str, str] = {}


def _query(name: str, sql: str | None = None) -> Callable[[Build], Build]:
    """Register a query, and its DuckDB form where SQL can express it."""

    def add(build: Build) -> Build:
        BUILDS[name] = build
        if sql is not None:
            SQL[name] = sql.strip()
        return build

    return add


@_query("op10_license_scan", license_sql())
def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_digest(license_scan(table(spark, sf_dir, "documents")))


@_query("op4_quality_rules")
def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_rules(docs, fit_rules(docs, table(spark, sf_dir, "labels")))


@_query("op3_secret_scan")
def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return secret_digest(secret_scan(docs, infer_formats(docs)))


@_query("op2_quality_classifier")
def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    machine = fit_machine(docs, table(spark, sf_dir, "labels"), learnable())
    return score_digest(quality_scores(docs, machine))


@_query("op9_ngram_jaccard_join")
def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_documents(table(spark, sf_dir, "documents"))


@_query("op1_benchmark_decontamination", CONTAMINATED_SQL)
def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@_query("op6_html_extraction")
def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))


@_query("op5_lm_scoring")
def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_scores(table(spark, sf_dir, "documents"))


@_query("op7_token_counts")
def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))


@_query("op8_best_fit_packing")
def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pack(docs, clusters=near_clusters(docs))


@_query("op11_simhash_near_dedup")
def op11_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_fingerprints(table(spark, sf_dir, "documents"))


@_query("op12_conversation_repair")
def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    return repair_digest(damaged(turns), turns)


@_query("op13_phrase_collocations", COLLOCATIONS_SQL)
def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))
