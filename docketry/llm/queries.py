"""The registered queries: each runs one operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.llm import (
    chat,
    decontaminate,
    hard_negatives,
    language,
    lattice_lm,
    merkle,
    quality_model,
    quality_rules,
    sampling,
    shards,
    simhash,
    token_files,
    urls,
)
from docketry.llm.common import id_remainder, ready, table
from docketry.session import work_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(function):
    """Register under the function's name; sets the session options first."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        return function(ready(spark), folder)

    run.__name__ = function.__name__
    run.__doc__ = function.__doc__
    QUERIES[function.__name__] = run
    return run


# --- 1: chat formatting ---------------------------------------------------------

CONTROL_CONVERSATION = (
    "SELECT CAST(conv_id AS BIGINT) conv_id, CAST(turn AS BIGINT) turn, role, text FROM VALUES "
    "(-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]') "
    "AS t(conv_id, turn, role, text)"
)


@query
def op1_chat_formatting(spark: SparkSession, folder: str) -> DataFrame:
    """Every row is a ``message`` event; counts and hashes are read back."""
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    events = rows.unionByName(spark.sql(CONTROL_CONVERSATION)).select(
        "conv_id", F.col("turn").alias("seq"), "turn", F.lit("message").alias("kind"), "role", "text"
    )
    return chat.conversation_digests(chat.format_chat(events))


# --- 5: sharding ----------------------------------------------------------------


@query
def op5_sharding(spark: SparkSession, folder: str) -> DataFrame:
    """Shards 0 to 39 by the law ``rows``; the rows are read from the files."""
    written = shards.shuffle_into_shards(
        table(spark, folder, "documents"), work_folder(spark, "shards"), shards=40
    )
    text = F.col("record.text")
    return written.select(
        F.col("record.doc_id").alias("doc_id"),
        shards.record_size(text).alias("size"),
        F.crc32(F.coalesce(text, F.lit(""))).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


# --- 6: url filters -------------------------------------------------------------

URL_RULES = (
    urls.Rule("allow", "org", "/"),
    urls.Rule("block", "example.org", "/es/"),
    urls.Rule("block", "example.org", "/en/1"),
    urls.Rule("allow", "com", "/fr/"),
    urls.Rule("block", "com", "/de/"),
)
SPAM_HOSTS = r"(^|[.-])(spam|pills|casino|warez|porn)([.-]|$)"


@query
def op6_url_filters(spark: SparkSession, folder: str) -> DataFrame:
    """The list: canonical URLs of the pages whose host has a spam word."""
    pages = table(spark, folder, "pages")
    listed = pages.where(urls.host_of(F.col("url")).rlike(SPAM_HOSTS)).select(
        urls.canonical(F.col("url")).alias("url")
    )
    return urls.filter_urls(pages, listed, URL_RULES).drop("listed")


# --- 3: quality rules -----------------------------------------------------------


@query
def op3_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Hosts are the sources of the documents."""
    return quality_rules.quality_verdicts(table(spark, folder, "documents")).select(
        "doc_id", "rules.*", "removed_words", "base_failed", "kept"
    )


# --- 4: SimHash near-duplicates -------------------------------------------------


@query
def op4_simhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, folder, "documents")).select(
        "doc_id", simhash.hex_digits(F.col("print")).alias("fingerprint"), "component_id"
    )


# --- 8: benchmark decontamination -----------------------------------------------


@query
def op8_benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = decontaminate.contamination(
        table(spark, folder, "documents"), table(spark, folder, "benchmark")
    )
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        "n_items",
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated",
        "n_near",
        F.sha2(F.array_join("near_items", ","), 256).alias("near_sha256"),
    )


# --- 7: language-model scoring --------------------------------------------------

PIECES = "piece_bpe_32k.model"


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op7_lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    """Trains on the documents whose id's remainder is not 1."""
    scored = lattice_lm.score_documents(
        table(spark, folder, "documents"),
        id_remainder(F.col("doc_id"), 5) != 1,
        tokenizer_path(PIECES),
    )
    return scored.select(
        "doc_id",
        (~F.col("training")).alias("held_out"),
        "n_tokens",
        "n_known",
        "train_tokens",
        "base_score",
        "score",
    )


# --- 9: SentencePiece encoding and decoding -------------------------------------


@query
def op9_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    """Two sampled segmentations of every text, and what they decode to."""
    path = tokenizer_path(PIECES)
    sampled = sampling.encode(table(spark, folder, "documents"), path, samples=2)
    return sampled.select(
        "doc_id",
        "sample",
        F.size("ids").cast("long").alias("n_ids"),
        F.xxhash64("ids").alias("ids_hash"),
        "log_prob",
        "log_inclusion",
        "text_crc32",
        F.crc32(sampling.decode(spark, F.col("ids"), path)).alias("decoded_crc32"),
    )


# --- 2: quality classifier ------------------------------------------------------

GOOD_ENOUGH = 0.3


def quality_model_of(spark: SparkSession, documents: DataFrame, folder: str):
    """Learns labels only of ids whose remainder is not 0."""
    return quality_model.fit_quality(
        documents, table(spark, folder, "labels"), id_remainder(F.col("doc_id"), 5) != 0
    )


@query
def op2_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    model = quality_model_of(spark, documents, folder)
    return documents.select(
        "doc_id",
        (id_remainder(F.col("doc_id"), 5) == 0).alias("held_out"),
        model.score(documents, F.col("text")).alias("score"),
    ).withColumn("predicted", (F.col("score") >= GOOD_ENOUGH).cast("int"))


# --- 10: token-id / binary output -----------------------------------------------

WORD_PIECES = "word_bpe_49k.json"


@query
def op10_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """Written in ascending order of the ids, then read back from the segments."""
    path = work_folder(spark, "token-files")
    token_files.write_token_files(table(spark, folder, "documents"), path, tokenizer_path(WORD_PIECES))
    documents = token_files.read_token_files(spark, path).select(
        "file", "segment", "doc_id", "first", "n_tokens", F.crc32("ids").alias("ids_crc32")
    )
    starts = token_files.segment_starts(spark, path)
    same = (F.col("file") == F.col("of_file")) & (F.col("segment") == F.col("of_segment"))
    return documents.join(starts, same).select(
        "doc_id", (F.col("before") + F.col("first")).alias("start"), "n_tokens", "ids_crc32"
    )


# --- 13: Merkle dataset manifest ------------------------------------------------


@query
def op13_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """A tree for each source; every second document (by crc32 of its id) is then
    tampered with, and its proof checked."""
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    text = F.col("text")
    touched = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    shown = F.when(touched, F.replace(text, F.lit("\n"), F.lit(""))).otherwise(text)
    found = merkle.manifest(
        table(spark, folder, "documents"),
        merkle.leaf_of(*fields, text),
        carry={"shown_leaf": merkle.leaf_of(*fields, shown)},
    )
    return found.select(
        "doc_id",
        "leaf",
        "subroot",
        "root",
        merkle.proof_of(F.col("path")).alias("proof_sha256"),
        merkle.folded(F.col("shown_leaf"), F.col("path")).alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


# --- 11: hard-negative mining ---------------------------------------------------


@query
def op11_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    """Anchors are every hundredth row; every seventh row's label is moved by one."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(
        table(spark, folder, "embeddings"), F.col("vec_id") % 100 == 0, label
    )


# --- 12: language identification ------------------------------------------------


@query
def op12_language_id(spark: SparkSession, folder: str) -> DataFrame:
    """Learns only from ids whose remainder is not 1."""
    documents = table(spark, folder, "documents")
    held_out = id_remainder(F.col("doc_id"), 3) == 1
    model = language.fit_language(documents, ~held_out)
    return documents.select(
        "doc_id", held_out.alias("held_out"), model.predict(documents, F.col("text")).alias("found")
    ).select("doc_id", "held_out", F.col("found.lang").alias("lang_pred"), "found.score")
