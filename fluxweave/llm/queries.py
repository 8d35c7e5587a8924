"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bottom_k, class_lm, decontaminate, fill_in_middle, html_text, merkle, mixing, ngram_join, pii, quality, sharding, sql, toxicity, url_filter
from .common import materialize, table

Query = Callable[[SparkSession, str], DataFrame]


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return quality.line_frequency(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lost_chars")


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return class_lm.score(table(spark, sf_dir, "documents"))


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(table(spark, sf_dir, "documents"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def mixing_model(docs: DataFrame, labels: DataFrame, **options) -> mixing.Model:
    model = mixing.fit_classifier(docs, labels)
    return mixing.fit_rates(materialize(mixing.memberships(docs, model, "text")), model, **options)


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = mixing_model(docs, table(spark, sf_dir, "labels"), keep_all=False, flatten=0.0, relative=True)  # each domain the same share
    return mixing.mix(docs, model).withColumns({"converged": F.lit(model.converged), "residual": F.lit(model.residual), "optimality": F.lit(model.optimality), "n_steps": F.lit(len(model.steps))})


def toxicity_model(docs: DataFrame, labels: DataFrame) -> toxicity.Model:
    return toxicity.fit(toxicity.training_rows(docs, labels, "doc_id", "text", "toxic", max_train=20_000))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = toxicity.score(docs, toxicity_model(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_passages")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.detect(table(spark, sf_dir, "documents").select("doc_id", "text"), pii.train(spark))
    counts = [pii.count_of(F.col("base"), k).alias(f"n_{k}") for k in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(pii.joined(F.col("base")), 256).alias("base_sha256"), pii.joined(F.col("found")).alias("spans"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _ = sharding.shard(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "vslot", "map_version")


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op11_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bottom_k.near_duplicates(table(spark, sf_dir, "documents"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*merkle.FIELDS)
    given = merkle.leaf(*[merkle.tampered(F.col(c), F.col("doc_id")) if c == "text" else F.col(c) for c in merkle.FIELDS])
    return merkle.manifest(docs, given=given).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified", "n_siblings")


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fill_in_middle.transform(table(spark, sf_dir, "documents").select("doc_id", "text"))
    digest = lambda c: F.sha2(F.col(c).cast("binary"), 256).alias(f"{c}_sha256")
    return found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest("output"), digest("restored"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_quality_rules, op2_lm_scoring, op3_ngram_jaccard_join, op4_decontamination, op5_source_mixing, op6_toxicity, op7_pii, op8_sharding, op9_url_filter, op10_html_extraction,
        op11_minhash_near_dedup, op12_merkle_manifest, op13_fill_in_middle,
    )
}

ORACLE_SQL: dict[str, str] = {
    "op1_quality_rules": sql.QUALITY,
    "op3_ngram_jaccard_join": sql.NGRAM_JOIN,
    "op4_decontamination": sql.DECONTAMINATION,
    "op9_url_filter": sql.URL_FILTER,
    "op11_minhash_near_dedup": sql.MINHASH_NEAR_DEDUP,
    "op12_merkle_manifest": sql.MERKLE_MANIFEST,
    "op13_fill_in_middle": sql.FILL_IN_MIDDLE,
}
