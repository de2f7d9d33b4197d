"""The queries opN_<name> and pipeline, with production parameters over whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from airgrid.llm import _store, linededup, oracles


def fold(doc_id: Column) -> Column:
    """crc32 of an id as text, by which labelled rows are dealt."""
    return F.crc32(doc_id.cast("string").cast("binary"))


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_noisy_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    from airgrid.llm import toxicity

    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    labels = _read(spark, sf_dir, "labels").select("doc_id", "toxic").where(fold(F.col("doc_id")) % 5 != 0)
    model = toxicity.learn(docs, labels, toxicity.corpus_trigrams(docs))
    held = F.coalesce(fold(F.col("doc_id")) % 5 == 0, F.lit(False))
    out = toxicity.score(docs, model)
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op2_dac(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from airgrid.llm import dac

    out = _store.fresh(spark, "dac-files")
    manifest = dac.write_tokens(_read(spark, sf_dir, "documents"), out, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return dac.read_tokens(manifest, out, digest=True)


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from airgrid.llm import bpe

    return bpe.digests(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op9_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from airgrid.llm import ring

    out = ring.assign(_read(spark, sf_dir, "documents"), shards=8)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from airgrid.llm import warc

    out = _store.fresh(spark, "warc-files")
    manifest = warc.write_archives(_read(spark, sf_dir, "pages"), out, min_bytes=0)
    return warc.records(manifest, out).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_rank_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    from airgrid.llm import langid

    docs = _read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = fold(F.col("doc_id")) % 3 == 1
    profiles = langid.learn(docs.where(~held))
    out = langid.predict(docs.select("doc_id", "text"), profiles, keep=["doc_id"])
    return out.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op4_vertical_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from airgrid.llm import jaccard

    return jaccard.classes(_read(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_shingles", "component_id")


def op5_multiprobe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from airgrid.llm import ann

    return ann.search(_read(spark, sf_dir, "embeddings").select("vec_id", "embedding"), every=20, k=20)


def op6_suffix_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    from airgrid.llm import decontam

    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontam.judged(decontam.match(docs, _read(spark, sf_dir, "benchmark"), keep=["doc_id"], spans=False))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op8_line_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from airgrid.llm import linededup

    return linededup.dedup(_read(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {f.__name__: f for f in (op1_noisy_channel, op2_dac, op3_rank_order, op4_vertical_join, op5_multiprobe, op6_suffix_arrays, op7_byte_bpe, op8_line_windows, op9_ring, op10_warc)}
ORACLE_SQL: dict[str, str] = {
    "op3_rank_order": oracles.RANK_ORDER,
    "op4_vertical_join": oracles.VERTICAL_JOIN,
    "op6_suffix_arrays": oracles.SUFFIX_ARRAYS,
    "op8_line_windows": linededup.ORACLE,
    "op10_warc": oracles.WARC,
}
