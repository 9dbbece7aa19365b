"""The queries opN_<name>, each over the whole of its table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, codebooks, jaccard, langid, licenses, linededup, mixing, quality, tokencount, toxicity, warc, whitening
from .common import table


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.classify(table(spark, sf_dir, "documents"))


def op2_seekable_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op3_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linededup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("text_sha256"))


#: The rank file of op4 in the folder of public tokenizers.
BPE_RANKS = "byte_bpe_50k.tiktoken"


def bpe_vocabulary() -> tuple[list[bytes], str]:
    import public_tokenizers

    return bpe.load_ranks(public_tokenizers.path(BPE_RANKS)), public_tokenizers.PATTERN


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), *bpe_vocabulary())


def op5_collision_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"))


def op6_license_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"), licenses.known(spark))


def op7_poisson_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.mix(docs).select("doc_id", "source", "copy_no", "shuffle_key", "text")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"))


def op11_code_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codebooks.encode(table(spark, sf_dir, "embeddings")).select("vec_id", "code", "error", "label_error", "codebooks_sha256")


#: The file of op12 in the folder of public tokenizers.
COUNTED_BY = "byte_bpe_50k.json"


def tokenizer_file() -> tuple[str, str]:
    import public_tokenizers

    with open(public_tokenizers.path(COUNTED_BY), encoding="utf-8") as file:
        return file.read(), public_tokenizers.PATTERN


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count(table(spark, sf_dir, "documents"), *tokenizer_file())


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.by_component(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_seekable_warc": op2_seekable_warc,
    "op3_fuzzy_lines": op3_fuzzy_lines,
    "op4_byte_bpe": op4_byte_bpe,
    "op5_collision_neighbours": op5_collision_neighbours,
    "op6_license_digest": op6_license_digest,
    "op7_poisson_mixing": op7_poisson_mixing,
    "op8_quality_rules": op8_quality_rules,
    "op9_toxicity": op9_toxicity,
    "op10_ngram_jaccard": op10_ngram_jaccard,
    "op11_code_search": op11_code_search,
    "op12_token_counts": op12_token_counts,
    "op13_whitening": op13_whitening,
}

ORACLE_SQL: dict[str, str] = {
    "op2_seekable_warc": warc.ORACLE,
    "op6_license_digest": licenses.oracle(),
    "op7_poisson_mixing": mixing.ORACLE,
    "op10_ngram_jaccard": jaccard.ORACLE,
    "op11_code_search": codebooks.ORACLE,
}
