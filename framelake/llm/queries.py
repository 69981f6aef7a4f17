"""The operators of this package as queries over the synthetic tables, with production parameters."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, chat, decontamination, embedding_dups, importance, language_id, line_dedup, prefix_trie, quality, simhash, token_counts, token_store
from ._common import read_table, removed_at_exit, shared_dir

TOKENIZER = "word_bpe_49k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    profiles = language_id.fit(read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return language_id.identify(spark, pages, profiles).select("page_id", "lang", "confidence", "text_lang", "declared")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    out = line_dedup.dedup_lines(spark, docs)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontamination.overlaps(spark, docs, read_table(spark, sf_dir, "benchmark").select("item_id", "text"), short_share=decontamination.SHORT_SHARE)


def op4_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return ann.nearest(spark, vectors, F.col("vec_id") % 50 == 0)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, read_table(spark, sf_dir, "labels"))
    return quality.score(docs, model).select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op6_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    path = removed_at_exit(spark, f"{shared_dir(spark)}/token-store-{uuid.uuid4().hex}")
    token_store.write(spark, docs, path, tokenizer_path())
    if not token_store.verify(spark, path):
        raise ValueError("the manifest of the store doesn't follow from its recipes")
    return token_store.read(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(spark, read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    out = bpe.encode_decode(docs, tokenizer_path())
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    role = F.when(F.col("id") == 0, "user").otherwise("assistant")
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), F.lit(said).alias("text"))
    rows = read_table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text").unionByName(extra)
    return read_back(chat.format_chats(rows))


def read_back(examples: DataFrame) -> DataFrame:
    """Digests per conversation of what its formatted examples hold: the longest has all turns, each its own trainable reply."""
    parsed = examples.select("conv_id", "example", "text", chat.loss_text(F.col("text"), F.col("loss_start"), F.col("loss_chars")).alias("reply"), F.length("text").alias("chars"))
    one = parsed.groupBy("conv_id").agg(F.max_by("text", "example").alias("text"), F.sort_array(F.collect_list(F.struct("example", "reply"))).alias("replies"), F.sum("chars").alias("formatted_chars"))
    turns = one.withColumn("turns", chat.parse_chat(F.col("text")))
    said = F.concat_ws("", F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    loss = F.concat_ws("", F.transform("replies", lambda r: r["reply"]))
    return turns.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), "formatted_chars")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(read_table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path())


def op11_embedding_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dups.near_duplicates(spark, read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(spark, read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))


def op13_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, target = (read_table(spark, sf_dir, t) for t in ("documents", "benchmark"))
    return importance.resample(spark, docs.select("doc_id", "text"), target.select("text"))


QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_line_dedup": op2_line_dedup,
    "op3_decontamination": op3_decontamination,
    "op4_ann": op4_ann,
    "op5_quality": op5_quality,
    "op6_token_store": op6_token_store,
    "op7_simhash": op7_simhash,
    "op8_bpe": op8_bpe,
    "op9_chat": op9_chat,
    "op10_token_counts": op10_token_counts,
    "op11_embedding_dups": op11_embedding_dups,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_importance": op13_importance,
}
