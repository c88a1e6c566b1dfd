"""The registered queries of this subpackage: each applies one operator, with its production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pagewright.llm.vector_dedup import vector_groups

    return vector_groups(table(spark, sf_dir, "embeddings"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from pagewright.llm.pieces import encode_pieces

    return encode_pieces(table(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path("piece_bpe_32k.model")).drop("text")


def op3_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pagewright.llm.secrets import secret_digest

    return secret_digest(table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pagewright.llm.toxicity import toxicity_scores

    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pagewright.llm.simhash import simhash_groups

    rows = simhash_groups(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_chat_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pagewright.llm.preferences import preference_pairs

    pairs = preference_pairs(table(spark, sf_dir, "conversations"), gaps=True)
    said = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return pairs.withColumns({"chosen_loss": said("chosen_loss"), "rejected_loss": said("rejected_loss")})


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pagewright.llm.mixing import mix

    m = mix(table(spark, sf_dir, "documents", "doc_id", "text", "source", "lang"))
    shown = {"mix_source": "source", "mix_lang": "lang", "mix_topic": "topic", "mix_tokens": "n_tokens"}
    return m.select("doc_id", *[F.col(a).alias(b) for a, b in shown.items()], F.round("mix_weight", 6).alias("weight"), F.round("mix_probability", 6).alias("probability"), F.col("mix_sampled").alias("sampled"), F.round("mix_due", 6).alias("due"), F.col("mix_copies").alias("copies"))


def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pagewright.llm.neighbours import nearest

    return nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from pagewright.llm.token_counts import token_counts

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pagewright.llm.substrings import drop_repeats

    return drop_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def queries() -> dict[str, Query]:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    from pagewright.llm.oracle import SQL

    return dict(SQL)
