"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, bpe, licenses, mixing, near_dup, periodic_runs, pii, quality, secret_scan, sharding, spot_signatures, token_binary, url_lists
from .common import documents, id_and_text, spans_text


def op1_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = token_binary.store(documents(spark, sf_dir), public_tokenizers.path(token_binary.VOCAB))
    back = token_binary.read(spark, store)
    return back.select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return secret_scan.scan(documents(spark, sf_dir)).select("doc_id", *map(count, secret_scan.BASE_KINDS), F.sha2(spans_text(F.col("base")), 256).alias("base_sha256"), spans_text(F.col("spans")).alias("spans"))


def op3_spot_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spot_signatures.edited_pairs(documents(spark, sf_dir))


def spot_signature_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of equal fingerprints of each document, and how many other classes are similar to it: the comparison of
    all documents, partitioned by set length."""
    return spot_signatures.linked(documents(spark, sf_dir))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.decode(bpe.encode(id_and_text(documents(spark, sf_dir))))
    return coded.select("doc_id", "n_tokens", F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(documents(spark, sf_dir)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.replicate(documents(spark, sf_dir)).select("doc_id", "text", "lang", "source", "n_chars", F.col("copy").cast("long").alias("copy"), F.round("shuffle_key", 9).alias("shuffle_key"))


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.components(documents(spark, sf_dir))


def op8_url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a capture, judged against a dated list that is drawn from the pages' own hosts."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return url_lists.evaluate(url_lists.dated_captures(pages), url_lists.dated_entries(pages))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.matches(documents(spark, sf_dir))


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.scan(documents(spark, sf_dir))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of every text; in a tenth of the texts, as the contract says, known repetitions are made first."""
    docs = id_and_text(documents(spark, sf_dir))
    found = periodic_runs.scan(docs.withColumn("text", periodic_runs.repeated(F.col("doc_id"), F.col("text"))))
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("back"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    return found.withColumn("longest", longest).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("longest.back")).alias("start"), "longest.length", (-F.col("longest.period")).alias("period"),
        F.floor(1000 * F.col("longest.length") / -F.col("longest.period")).alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_balanced_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight shards of all documents, numbers of documents at most one apart; equal texts and texts that share long lines
    are drawn together."""
    placed = sharding.shard(documents(spark, sf_dir))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    aligned = alignment.align(documents(spark, sf_dir), public_tokenizers.path(alignment.VOCAB_A), public_tokenizers.path(alignment.VOCAB_B))
    return aligned.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    ops = (op1_token_binary, op2_secret_scan, op3_spot_signatures, op4_byte_bpe, op5_quality_rules, op6_source_mixing, op7_near_duplicates, op8_url_lists, op9_license_scan, op10_personal_data, op11_periodic_runs, op12_balanced_shards, op13_token_alignment, pipeline, spot_signature_links)
    return {f.__name__: f for f in ops}


def oracle_sql() -> dict[str, str]:
    from . import oracle

    return oracle.sql()
