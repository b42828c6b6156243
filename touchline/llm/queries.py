"""The queries of the corpus operators, with the parameters used in production."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from touchline.llm import chat, decontaminate, fingerprint, jaccard, kdtree, lines, mixing, packing, piece_bpe, quality, secrets, shards, trie


def tokenizer_file(name: str) -> str:
    """A vocabulary file's place in the package of public tokenizers; TOKENIZER_DIR may name another folder."""
    folder = os.environ.get("TOKENIZER_DIR")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return piece_bpe.digests(piece_bpe.round_trip(docs, tokenizer_file("piece_bpe_32k.model")).drop("text"))


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.score_texts(table(spark, sf_dir, "documents").select("doc_id", "text", (remainder(7) == 2).alias("held_out")))


#: The key of the training order; another key gives another order.
ORDER_KEY = b"training order 1"


def op4_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return shards.read_back(shards.materialise(docs, tokenizer_file("byte_bpe_50k.tiktoken"), ORDER_KEY))


def op5_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.digests(fingerprint.fingerprint_with_next(table(spark, sf_dir, "documents")))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.report(lines.dedup(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("</s>[INST] ok [/INST]").alias("text"),
    )
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    return chat.read_back(chat.format_chat(turns))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.digests(decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark")).drop("text"))


def remainder(modulus: int):
    """crc32 of the id as text, modulo ``modulus``."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus


QUALITY_THRESHOLD = 0.3


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    return quality.classify(table(spark, sf_dir, "documents"), labels, remainder(5) == 0, QUALITY_THRESHOLD)


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return secrets.digests(secrets.scan(docs).drop("text"))


#: Centroids, components, rounds and scale of the clustering query.
CENTROIDS, COMPONENTS, CLUSTER_ROUNDS, SCALE = 16, 64, 3, 64.0


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kdtree.cluster(table(spark, sf_dir, "embeddings"), CENTROIDS, COMPONENTS, CLUSTER_ROUNDS, "1:", SCALE)


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digests(packing.pack(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json")))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    seqs = trie.sequences(table(spark, sf_dir, "conversations"))
    taken = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9
    return trie.prefix_trie(trie.joined_prefixes(seqs, F.col("conv_id") - F.col("conv_id") % 5, taken))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_jaccard": op1_jaccard,
        "op2_sentencepiece": op2_sentencepiece,
        "op3_lm_scoring": op3_lm_scoring,
        "op4_token_shards": op4_token_shards,
        "op5_fingerprint": op5_fingerprint,
        "op6_chat": op6_chat,
        "op7_decontaminate": op7_decontaminate,
        "op8_quality": op8_quality,
        "op9_secrets": op9_secrets,
        "op10_substring_dedup": op10_substring_dedup,
        "op11_centroids": op11_centroids,
        "op12_packing": op12_packing,
        "op13_prefix_trie": op13_prefix_trie,
    }


def oracle_sql() -> dict[str, str]:
    return {}
