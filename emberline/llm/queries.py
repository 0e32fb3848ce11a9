"""The operators as queries on the driver's tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.llm import chat, covertree, egojoin, language, minhash, nbest, oracles, packing, personal, quality, repair, secrets, spelling, trie

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn: Callable) -> Callable:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


@query("op1_repair_tokens")
def op1_repair_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = repair.write_tokens(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))
    return repair.read_tokens(files)


@query("op2_superminhash_dedup", oracles.OP2)
def op2_superminhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), words=2)


@query("op3_grid_order_join", oracles.OP3)
def op3_grid_order_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return egojoin.near_duplicates(table(spark, sf_dir, "embeddings"))


@query("op4_credential_linking", oracles.OP4)
def op4_credential_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_secrets(table(spark, sf_dir, "documents"))


@query("op5_boosted_personal_data")
def op5_boosted_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal.scan_personal(table(spark, sf_dir, "documents"))


@query("op6_nbest_pieces")
def op6_nbest_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nbest.segment_digests(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


@query("op7_neighbour_quality")
def op7_neighbour_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op8_word_backoff_language")
def op8_word_backoff_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify_language(table(spark, sf_dir, "documents"))


@query("op9_pattern_packing")
def op9_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


@query("op10_cover_tree_topk", oracles.OP10)
def op10_cover_tree_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return covertree.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


@query("op11_prefix_trie", oracles.OP11)
def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(table(spark, sf_dir, "conversations"))


@query("op12_spelling_variants", oracles.OP12)
def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))


@query("op13_reply_trees", oracles.OP13)
def op13_reply_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.conversation_digests(table(spark, sf_dir, "conversations"))
