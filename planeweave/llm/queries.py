"""Registered queries of the training-data operators, and their check SQL."""

from __future__ import annotations

import public_tokenizers

from planeweave.llm import (
    bbit,
    bytepair,
    decontam,
    langid,
    lines,
    mixing,
    pii,
    polytope,
    quality,
    sharding,
    toxicity,
    trie,
    zonemap,
)
from planeweave.llm.common import table


def decontamination(spark, sf_dir):
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def source_mixing(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents"))


def language_id(spark, sf_dir):
    return langid.language_of(table(spark, sf_dir, "documents"))


def personal_data(spark, sf_dir):
    return pii.personal_data(table(spark, sf_dir, "documents"))


def minhash_dedup(spark, sf_dir):
    return bbit.near_duplicates(table(spark, sf_dir, "documents"))


def extendible_sharding(spark, sf_dir):
    return sharding.shards(table(spark, sf_dir, "documents"))


def quality_scores(spark, sf_dir):
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def line_dedup(spark, sf_dir):
    return lines.line_duplicates(table(spark, sf_dir, "documents"))


def embedding_dedup(spark, sf_dir):
    return polytope.duplicates(table(spark, sf_dir, "embeddings"))


def toxicity_scores(spark, sf_dir):
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def byte_pairs(spark, sf_dir):
    return bytepair.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"),
                               public_tokenizers.PATTERN)


def centroid_clusters(spark, sf_dir):
    return zonemap.cluster(table(spark, sf_dir, "embeddings"))


def conversation_trie(spark, sf_dir):
    return trie.conversation_trie(table(spark, sf_dir, "conversations"))


QUERIES = {
    "op1_decontamination": decontamination,
    "op2_source_mixing": source_mixing,
    "op3_language_id": language_id,
    "op4_personal_data": personal_data,
    "op5_minhash_dedup": minhash_dedup,
    "op6_sharding": extendible_sharding,
    "op7_quality": quality_scores,
    "op8_embedding_dedup": embedding_dedup,
    "op9_line_dedup": line_dedup,
    "op10_toxicity": toxicity_scores,
    "op11_byte_pairs": byte_pairs,
    "op12_centroid_clusters": centroid_clusters,
    "op13_conversation_trie": conversation_trie,
}

SQL = {
    "op2_source_mixing": mixing.ORACLE,
    "op6_sharding": sharding.ORACLE,
    "op12_centroid_clusters": zonemap.oracle(),
    "op13_conversation_trie": trie.ORACLE,
}
