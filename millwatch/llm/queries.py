"""One query for each operator over its whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable
from hashlib import sha256

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millwatch.llm import classifier, codes, fingerprints, mixing, packing, pieces, rules, shards, simhash, substring, toxicity, trie, urls
from millwatch.llm.common import is_training_row, table


def op1_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return substring.repeated_passages(table(spark, folder, "documents"))


def op2_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return rules.quality_rules(table(spark, folder, "documents"), table(spark, folder, "labels"))[0]


def op3_document_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprints.fingerprint_documents(table(spark, folder, "documents"))


def op4_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    scored = classifier.score_quality(table(spark, folder, "documents"), table(spark, folder, "labels"))
    return scored.select(
        "doc_id", (~is_training_row(F.col("doc_id"))).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted")
    )


def url_list(pages: DataFrame) -> DataFrame:
    """Dated entries (pattern, day, action) that Spark derives from the hosts of ``pages``.

    Every host, and the domain above it, may be put on the list, allowed and taken
    off again on days that a hash of its name decides.
    """
    host = urls.host_of(F.col("url"))
    names = pages.select(F.explode(F.array(host, F.regexp_replace(host, r"^[^.]+\.", ""))).alias("pattern")).where("pattern is not null").distinct()
    sum_ = F.conv(F.substring(F.md5(F.col("pattern").cast("binary")), 1, 7), 16, 10).cast("bigint")
    entries = F.array(
        *(
            F.struct(F.date_add(F.lit("2024-01-01").cast("date"), ((sum_ / d).cast("bigint") % 300).cast("int")).alias("day"), F.lit(a).alias("action"))
            for d, a in ((7, "block"), (11, "allow"), (13, "remove"), (17, "block"))
        )
    )
    return names.where(sum_ % 3 < 2).select("pattern", F.explode(entries).alias("_e")).select("pattern", "_e.day", "_e.action")


def op5_url_filters(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages").select("page_id", "url")
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") % 366).cast("int"))
    return urls.judge_captures(pages.withColumn("day", day), url_list(pages), ["page_id"])


def op6_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    return pieces.encode_documents(table(spark, folder, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op7_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.simhash_components(table(spark, folder, "documents"))


def op8_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(table(spark, folder, "documents"))


def op9_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    scored = toxicity.score_toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"))
    return scored.select(
        "doc_id",
        (~is_training_row(F.col("doc_id"))).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        F.size("passages").alias("n_passages"),
    )


def op10_sharding(spark: SparkSession, folder: str) -> DataFrame:
    found = shards.shard_documents(table(spark, folder, "documents"), 16)
    return found.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("bigint").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op11_conversation_trie(spark: SparkSession, folder: str) -> DataFrame:
    paths = trie.with_shared_openings(trie.turn_paths(table(spark, folder, "conversations")))
    return trie.prefix_trie(paths).drop("turn")


def op12_vector_codes(spark: SparkSession, folder: str) -> DataFrame:
    found, books = codes.compress_vectors(table(spark, folder, "embeddings"))
    entries = ",".join(map(str, books.ravel().tolist())).encode()
    return found.select(
        "vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(sha256(entries).hexdigest()).alias("codebooks_sha256")
    )


def op13_source_mix(spark: SparkSession, folder: str) -> DataFrame:
    mixed = mixing.mix_documents(table(spark, folder, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source", "shard", "quota")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (
            op1_substring_dedup, op2_quality_rules, op3_document_fingerprints, op4_quality_classifier, op5_url_filters,
            op6_sentencepiece, op7_simhash, op8_best_fit_packing, op9_toxicity, op10_sharding,
            op11_conversation_trie, op12_vector_codes, op13_source_mix,
        )
    }
