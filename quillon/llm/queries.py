"""The operators' queries, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontam, imatch, jaccardjoin, langid, linededup, minhash, packing, ranked, rans, sharding, urlfilter, vectorcodes
from .oracle import ORACLE_SQL as ORACLE_SQL  # the entry point takes both


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(_read(spark, sf_dir, "documents"))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op2_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linededup.dedup_lines(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "removed_lines", "removed_words", F.coalesce("text", F.lit("")).alias("text"))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    profiles = langid.learn(docs.where(~langid.held_out()))
    found = langid.identify(docs.select("doc_id", "text"), profiles)
    return found.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


def op4_rans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rans.encode_corpus(_read(spark, sf_dir, "documents")).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_read(spark, sf_dir, "documents")).drop("n_links")


def op6_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.fingerprints(_read(spark, sf_dir, "documents"))


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as transcripts in which three of ten speakers' names are left out; the turns that are recovered from them.

    role and hidden are the table's, to compare with: no role is read but to write names before texts. Both are null where a
    recovered turn begins within a turn of the table.
    """
    turns = _read(spark, sf_dir, "conversations")
    pieces = chat.transcripts(turns)
    found = chat.recover(pieces.select("conv_id", "turn", "text"))
    given = turns.select("conv_id", "turn", "role").distinct().join(pieces.select("conv_id", "turn", "hidden").distinct(), ["conv_id", "turn"])
    return found.join(given.withColumn("line", F.lit(0)), ["conv_id", "turn", "line"], "left").select("conv_id", "turn", "line", "n_lines", "role", "hidden", "role_pred", "rendered")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontam.leaks(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "item_id", "start_word", "n_words", F.round("similarity", 9).alias("similarity"))


#: The rules of the contract: host, path, allowed.
RULES = [urlfilter.Rule("net", "/", False), urlfilter.Rule("example.net", "/en/", True), urlfilter.Rule("example.com", "/de/", False), urlfilter.Rule("org", "/fr/", True)]


def op9_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(_read(spark, sf_dir, "pages"), RULES).drop("trust", "distrust")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    slim = _read(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    out = sharding.numbered(sharding.assign(slim, 40), ["doc_id", "text_crc32", "size"])
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op11_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, books = vectorcodes.compress(_read(spark, sf_dir, "embeddings"))
    return out.select("vec_id", "code", "error", "label_error", F.lit(vectorcodes.digest(books)).alias("codebooks_sha256"))


def op12_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.search(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op13_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccardjoin.groups(_read(spark, sf_dir, "documents")).drop("n_links")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": op1_packing,
    "op2_lines": op2_lines,
    "op3_language": op3_language,
    "op4_rans": op4_rans,
    "op5_minhash": op5_minhash,
    "op6_imatch": op6_imatch,
    "op7_chat": op7_chat,
    "op8_decontamination": op8_decontamination,
    "op9_urls": op9_urls,
    "op10_sharding": op10_sharding,
    "op11_vectors": op11_vectors,
    "op12_search": op12_search,
    "op13_join": op13_join,
}
