"""The queries of this subpackage and the SQL that gives the same rows."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanternq.llm import alignment, chat, classifier, decontaminate, mixing, packing, pii, quality_rules, sharding, simhash, spelling, tokens, url_filter
from lanternq.llm.common import table


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classifier.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The given tables are invented, so a session without a key gets one that is no secret."""
    key = spark.conf.get(pii.KEY_SETTING, None) or "for invented tables only"
    return pii.pseudonymized(table(spark, sf_dir, "documents"), key.encode())


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_report(table(spark, sf_dir, "documents"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.sharded(table(spark, sf_dir, "documents"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(tokens.VOCABULARY))


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("</s>[INST] ok [/INST]").alias("text"),
    )
    return chat.digests(chat.formatted(rows.unionByName(own)))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page is labelled if the number that ends a segment of its path is a labelled document; the label is
    bad if quality is 0 or toxic is 1."""
    pages = table(spark, sf_dir, "pages")
    number = F.regexp_extract(url_filter.path(F.col("url")), r"/([0-9]{1,18})(?:[/.]|$)", 1).try_cast("long")
    labels = table(spark, sf_dir, "labels").select("doc_id", ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"))
    labelled = pages.select("url", number.alias("doc_id")).join(labels, "doc_id").select("url", "bad")
    return url_filter.judged(pages, labelled)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(table(spark, sf_dir, "documents"))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = public_tokenizers.path(alignment.VOCABULARY_A), public_tokenizers.path(alignment.VOCABULARY_B)
    return alignment.alignments(table(spark, sf_dir, "documents"), *paths)


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), public_tokenizers.path(packing.VOCABULARY))


QUERIES = {
    f.__name__: f
    for f in (
        op1_quality_classifier,
        op2_pii_surrogates,
        op3_quality_rules,
        op4_simhash,
        op5_sharding,
        op6_decontamination,
        op7_token_counts,
        op8_chat_format,
        op9_url_filter,
        op10_mixing,
        op11_spelling,
        op12_alignment,
        op13_packing,
    )
}
SQL = {"op3_quality_rules": quality_rules.SQL, "op5_sharding": sharding.SQL, "op8_chat_format": chat.SQL, "op9_url_filter": url_filter.SQL}
