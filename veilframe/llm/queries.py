"""The numbered operators as queries over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.llm import bpe, chat, divergence, exact, grid, lm, mixing, periodic, quality, shards, simhash, suffix, urls
from veilframe.llm.common import table
from veilframe.llm.oracles import ORACLE_SQL


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("component").alias("component_id"),
    )


def op2_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = grid.near_duplicates(table(spark, sf_dir, "embeddings"))
    return found.select("vec_id", "n_links", F.col("component").alias("component_id"), "kept")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.learned(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model).select(
        "doc_id",
        quality.held_out().alias("held_out"),
        "score",
        F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"),
    )


def op4_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", mixing.words(F.col("text")).alias("size"))
    taken = (F.col("size") * F.col("copies")).alias("taken")
    return mixing.mix(docs, size="size").select("doc_id", "size", "source_size", "target", taken)


def op5_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = shards.assign(table(spark, sf_dir, "documents"), [1.0] * 40)
    return found.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op6_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = urls.judge(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))
    return found.select("page_id", "host", "path", "rule", "verdict")


def op7_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.edited_fingerprints(table(spark, sf_dir, "documents"))


def op8_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.scores(table(spark, sf_dir, "documents"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return suffix.remove_repeats(docs).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")
    )


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.digests(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


def op11_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table's rows and one conversation given as messages, told apart by their fields."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", F.to_variant_object(F.struct("conv_id", "turn", "role", "text")).alias("record"))
    said = F.lit(r"\### Assistant: </turn> ok")
    messages = F.array(*[F.struct(F.lit(r).alias("role"), said.alias("content")) for r in ("user", "assistant")])
    more = spark.range(1).select(F.lit(-7).cast("long").alias("conv_id"), F.to_variant_object(F.struct(messages.alias("messages"))).alias("record"))
    texts = chat.read_back(chat.formatted(chat.canonical(rows.unionAll(more))))
    loss = F.array_join("loss", "")
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return texts.select(
        F.col("id").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op13_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words planted by doc_id first; runs and texts without their repeats are the operator's."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    over = lambda x, y: F.call_function("div", x, y)
    g = over(h, F.lit(10))
    some = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    split = docs.withColumn("g", g).withColumn("w", F.when(h % 10 == 0, some))
    n = F.size("w")
    a, p = F.col("g") % n, 1 + over(n - F.col("g") % n, 3 + F.col("g") % 8)
    again = F.transform("w", lambda w, i: F.when(i < a, w).otherwise(F.get("w", (a + (i - a) % p).cast("int"))))
    planted = split.select("doc_id", F.when(n > 0, F.array_join(again, " ")).otherwise(F.col("text")).alias("text"))
    runs = F.col("runs")
    better = lambda b, r: r["length"] * b["period"] > b["length"] * r["period"]
    best = F.aggregate(runs, F.get(runs, F.lit(0)), lambda b, r: F.when(better(b, r), r).otherwise(b))
    line = lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))
    return periodic.collapse(planted).select(
        "doc_id", F.size(runs).cast("long").alias("n_runs"), "collapsed", best.alias("best"),
        F.sha2(F.array_join(F.transform(runs, line), ""), 256).alias("runs_sha256"),
    ).select(
        "doc_id", "n_runs", "best.start", "best.length", "best.period",
        over(1000 * F.col("best.length"), F.col("best.period")).alias("exponent_milli"),
        "runs_sha256", F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_embeddings": op2_embeddings,
    "op3_quality": op3_quality,
    "op4_mix": op4_mix,
    "op5_shards": op5_shards,
    "op6_urls": op6_urls,
    "op7_fingerprint": op7_fingerprint,
    "op8_lm": op8_lm,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_bpe": op10_bpe,
    "op11_chat": op11_chat,
    "op12_divergence": op12_divergence,
    "op13_periodic": op13_periodic,
}

__all__ = ["ORACLE_SQL", "QUERIES"]
