"""One query per operator: apply it to the whole table and derive the digest columns from its output."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dendra.llm import chat, fill_in_middle, lm_scoring, minhash, packing, secrets_scan, sentencepiece_codec, sharding, simhash, topk, url_filter, whitening
from dendra.llm import quality_rules as rules
from dendra.llm.common import table


def secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets_scan.scan(table(spark, sf_dir, "documents").select("doc_id", "text"), keep_text=False)
    digest = F.sha2(secrets_scan.span_text(secrets_scan.base_spans(F.col("spans"))), 256)
    return found.select("doc_id", "n_assign", "n_access", "n_hex", digest.alias("base_sha256"), secrets_scan.span_text(F.col("spans")).alias("spans"), "n_random")


def lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = lm_scoring.score(table(spark, sf_dir, "documents"), reread=True)
    # sums of logarithms depend on their order in the last digits
    return scored.select("doc_id", "n_words", "n_backed_off", F.round("log_prob", 4).alias("log_prob"), F.round("lm_score", 6).alias("lm_score"))


def quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = rules.store_ledger(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])
    judged = rules.apply_policy(ledger, "prose-1").withColumns({"base_failed": ~rules.verdict(rules.POLICIES["base-1"]), "kept_leniently": rules.verdict(rules.POLICIES["lenient-1"])})
    gain = rules.ablate(ledger, "prose-1").select(F.col("mask").alias("fail_bits"), "n_only_this_rule")
    return judged.join(F.broadcast(gain), "fail_bits", "left").select(  # a row per rule
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "n_bangs", "fail_bits", "policy",
        "kept_leniently", F.coalesce("n_only_this_rule", F.lit(0)).alias("n_kept_without_its_rule"),
    )


def url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_filter.judge(table(spark, sf_dir, "pages").select("page_id", "url"))
    return judged.select("page_id", "host", "path", "rule", "verdict", F.round("p_block", 6).alias("p_block"))


def packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces(packing.pack(table(spark, sf_dir, "documents")))


def pieces(rows: DataFrame) -> DataFrame:
    return rows.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "sequence_tokens")


def exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = simhash.near_duplicates(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return rows.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def sentencepiece_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = sentencepiece_codec.encode(table(spark, sf_dir, "documents").select("doc_id", "text"))
    back = sentencepiece_codec.decode(encoded)
    marked = F.replace(F.col("text"), F.lit(sentencepiece_codec.MARK), F.lit(" "))
    return back.select(
        "doc_id",
        F.size("piece_ids").cast("long").alias("n_pieces"),
        F.crc32(F.array_join("piece_ids", ",").cast("binary")).alias("ids_crc32"),
        F.crc32(F.col("decoded").cast("binary")).alias("decoded_crc32"),
        F.col("decoded").eqNullSafe(marked).alias("round_trip"),
    )


def shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.assign(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])
    return rows.withColumn("grown_shard", F.lit(None).cast("int"))


def chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("long"), "role", "text").unionByName(extra)
    return chat.read_back(chat.format_chats(rows))


def whitened(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = whitening.whiten(table(spark, sf_dir, "embeddings"), keep=["vec_id"])
    each = rows.select("vec_id", "n", "deviation", "identity_error", F.posexplode(F.arrays_zip("whitened", "explained")).alias("at", "of"))
    deviation = F.expr("try_cast(deviation AS long)")  # null beyond 64 bits
    return each.select("vec_id", (F.col("at") + 1).cast("int").alias("component"), "n", deviation.alias("deviation"), "of.whitened", "of.explained", "identity_error")


def fill_in_the_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = fill_in_middle.reorder(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])
    chars = lambda c: F.length(c).cast("long").alias(f"{c}_chars")
    back = fill_in_middle.restored(F.col("output"), F.col("form"))
    return cut.select("doc_id", F.col("n_units").alias("n"), "form", chars("prefix"), chars("middle"), F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


def minhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = minhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])
    return rows.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
