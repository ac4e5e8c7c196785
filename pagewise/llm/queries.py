"""The registered queries of the ten operators, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import spread
from . import ann, bpe, decontaminate, langid, linededup, quality, secrets, sharding, simhash, toxicity
from .common import read_table


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(read_table(spark, sf_dir, "documents"))


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.digest(documents(spark, sf_dir), read_table(spark, sf_dir, "labels"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.digest(documents(spark, sf_dir), read_table(spark, sf_dir, "labels"))


def op3_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.digest(read_table(spark, sf_dir, "embeddings"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(documents(spark, sf_dir), read_table(spark, sf_dir, "benchmark"))


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.digest(documents(spark, sf_dir))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.digest(documents(spark, sf_dir))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest(documents(spark, sf_dir))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digest(documents(spark, sf_dir))


def op9_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.digest(documents(spark, sf_dir))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(documents(spark, sf_dir))


QUERIES = {f.__name__: f for f in (op1_quality, op2_toxicity, op3_ann, op4_decontaminate, op5_langid, op6_line_dedup, op7_bpe, op8_simhash, op9_shard, op10_secrets)}

ORACLES = {"op4_decontaminate": decontaminate.DIGEST_SQL, "op6_line_dedup": linededup.DIGEST_SQL}
