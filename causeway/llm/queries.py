"""The queries op1 to op10 over the driver's tables: each applies its operator, with production
parameters, to its whole table, and derives the columns that are compared."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway.llm import scaled_sketch
from causeway.llm.decontaminate import with_matches
from causeway.llm.mixing import mix
from causeway.llm.oracles import ORACLES as SQL
from causeway.llm.pii import with_surrogates
from causeway.llm.quality import fit_quality, with_quality
from causeway.llm.simhash import simhash_components
from causeway.llm.substring_dedup import remove_repeated_words
from causeway.llm.suffix_dedup import remove_repeated_bytes
from causeway.llm.token_counts import read_vocabulary, with_token_counts
from causeway.llm.toxicity import fit_toxicity, with_toxicity

#: A real run takes its own key from a secret store.
PII_KEY = "public key of the test corpus"


def vocabulary_path() -> str:
    """The public unigram-style vocabulary file that op9 uses unless it is given another."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def fold(mod: int) -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % mod


def op1_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_surrogates(documents(spark, sf_dir).select("doc_id", "text"), PII_KEY)


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = with_matches(documents(spark, sf_dir).select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    items = F.transform("matches", lambda m: m["item_id"])
    return found.select("doc_id", (F.size("matches") > 0).alias("contaminated"), F.size("matches").alias("n_items"), items.alias("items"))


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(documents(spark, sf_dir), weights=(5, 2, 1), share=1.0, most=3)
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeated_words(documents(spark, sf_dir), window=20)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    model = fit_quality(docs, table(spark, sf_dir, "labels"), train=fold(5) != 0)
    out = with_quality(docs, model)
    return out.select("doc_id", (fold(5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(documents(spark, sf_dir), words=3, threshold=3)


def op7_scaled_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scaled_sketch
    out = s.edited_fingerprints(documents(spark, sf_dir))
    return out.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        s.as_text("sketch").alias("fingerprint"),
        s.as_text("edited_sketch").alias("edited_fingerprint"),
        s.likeness("sketch", "edited_sketch").alias("near_edited"),
        s.likeness("sketch", "next_sketch").alias("near_next"),
    )


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeated_bytes(documents(spark, sf_dir), length=100)
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op9_token_counts(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    vocabulary, _ = read_vocabulary(path or vocabulary_path())
    return with_token_counts(documents(spark, sf_dir).select("doc_id", "text"), vocabulary).select("doc_id", "n_tokens")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    model = fit_toxicity(docs, table(spark, sf_dir, "labels"), train=fold(3) != 1)
    out = with_toxicity(docs, model)
    return out.select("doc_id", (fold(3) == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_pii_surrogates,
        op2_decontamination,
        op3_source_mix,
        op4_substring_dedup,
        op5_quality,
        op6_simhash_near_dedup,
        op7_scaled_fingerprint,
        op8_suffix_dedup,
        op9_token_counts,
        op10_toxicity,
    )
}

#: op8 in SQL takes minutes on the smallest tables; the others are beyond DuckDB's SQL (XXH64, trained models, keyed
#: permutations, alignment). They are tested against brute force, a tokenizer, round trips and held-out labels.
ORACLES: dict[str, str] = dict(SQL)
