"""The registered queries of this subpackage: whole tables, production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import quality, toxicity
from .embedding_dedup import embedding_groups
from .hard_negatives import ORACLE_NEGATIVES, hard_negatives
from .inner_product_search import nearest_by_product
from .minhash_dedup import near_duplicates
from .mixing import ORACLE_MIX, mix_sources
from .pieces import encode_pieces
from .secret_scan import ORACLE_SECRETS, find_secrets, secret_digests
from .sharding import balanced_shards
from .suffix_dedup import remove_repeats
from .token_alignment import align_tokens
from .tokenstore import token_table


def tokenizer_file(name: str) -> str:
    """Place of a public tokenizer's file on this machine and its executors."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality.score_quality(docs, quality.fit(docs, _table(spark, sf_dir, "labels")))


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"))


def op3_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return balanced_shards(_table(spark, sf_dir, "documents"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_pieces(_table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


def op5_inner_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_by_product(_table(spark, sf_dir, "embeddings"))


def op6_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(_table(spark, sf_dir, "documents"))


def op7_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_groups(_table(spark, sf_dir, "embeddings"))


def op8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(_table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity.score_toxicity(docs, toxicity.fit(docs, _table(spark, sf_dir, "labels")))


def op10_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_table(_table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))


def op11_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_digests(find_secrets(_table(spark, sf_dir, "documents")))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_tokens(_table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model"))


def op13_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(_table(spark, sf_dir, "embeddings").withColumn("label", label))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": op1_quality,
    "op2_minhash": op2_minhash,
    "op3_shards": op3_shards,
    "op4_sentencepiece": op4_sentencepiece,
    "op5_inner_product": op5_inner_product,
    "op6_suffix": op6_suffix,
    "op7_embeddings": op7_embeddings,
    "op8_mix": op8_mix,
    "op9_toxicity": op9_toxicity,
    "op10_tokens": op10_tokens,
    "op11_secrets": op11_secrets,
    "op12_alignment": op12_alignment,
    "op13_negatives": op13_negatives,
}

ORACLES: dict[str, str] = {"op8_mix": ORACLE_MIX, "op11_secrets": ORACLE_SECRETS, "op13_negatives": ORACLE_NEGATIVES}
