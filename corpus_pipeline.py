"""A corpus pipeline of five stages: each takes the documents that its predecessor kept.

STAGES lists them; run() applies them to the table documents, writing each result as Parquet
in the shared folder and reading it again for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.llm import bpe, copies, mixing, quality, suffix
from veilframe.llm.common import stage, table

#: A document stays if its quality score is this or more.
ACCEPTED = 0.7


def _others(docs: DataFrame):
    """All columns but the text as one, whose name no operator uses."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("_others")


def _restored(docs: DataFrame, columns: list[str]) -> DataFrame:
    return docs.select(*[F.col("text") if c == "text" else F.col(f"_others.`{c}`").alias(c) for c in columns])


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts, learned from their own labels (held-out rows
    aside). Without any label nothing is known and all stay.

    A null text counts as empty; an empty text has the score of the bias alone. Rows without
    an id are judged like others and have no label. Repeated rows share their fate. An empty
    table gives an empty table; all columns are carried, whatever their names."""
    model = quality.learned(docs, table(spark, sf_dir, "labels"))
    if not (model[0].any() or model[1]):
        return docs
    scored = quality.score(docs.select("text", _others(docs)), model)
    return _restored(scored.where(F.col("score") >= ACCEPTED), docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, Jaccard 0.8 or more): see
    copies.one_of_each for nulls, empty texts, ties, repeated ids and rows."""
    return copies.one_of_each(docs)


def remove_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes that repeat 50 or more bytes of an earlier document. Where a cut
    leaves part of a character, that part goes too.

    A null text becomes empty; a null id counts as larger than all others; rows with one id
    don't cut each other. n_chars follows the text. An empty table gives an empty table; all
    columns are carried, whatever their names."""
    cut = suffix.remove_repeats(docs.select("doc_id", "text", _others(docs)))
    raw = F.col("kept").cast("string")
    # genuine U+FFFD are written as \1b (and \1 as \1a) while those that stand for broken bytes go
    marked = F.replace(F.replace(raw, F.lit("\1"), F.lit("\1a")), F.lit("\ufffd"), F.lit("\1b"))
    whole = F.replace(F.make_valid_utf8(marked), F.lit("\ufffd"), F.lit(""))
    whole = F.replace(F.replace(whole, F.lit("\1b"), F.lit("\ufffd")), F.lit("\1a"), F.lit("\1"))
    made = _restored(cut.withColumn("text", F.when(F.is_valid_utf8(raw), raw).otherwise(whole)), docs.columns)
    return made.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns) if "n_chars" in docs.columns else made


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it (0 to 3 times).

    Null and empty texts have no words: the mix takes them by their source's rate. A null
    source is one of its own, a null id is ordered first among its like, and repeated rows
    count each. An empty table gives an empty table; all columns are carried, whatever their names."""
    mixed = mixing.mix(docs.select("doc_id", "text", "source", _others(docs))).where("copies > 0")
    return _restored(mixed.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))), docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids (four little-endian bytes each), and the digest of what they decode to.

    Null and empty texts have no ids. Each row is coded alone; only doc_id, lang and source are
    carried. An empty table gives an empty table."""
    import public_tokenizers

    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    coded = bpe.round_trip(docs.select("doc_id", "lang", "source", "text"), path, pattern)
    return coded.select(
        "doc_id", "lang", "source",
        (F.octet_length("token_ids") / 4).cast("long").alias("n_tokens"),
        "token_ids",
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES = [
    ("quality classifier", keep_quality),
    ("SimHash near-dedup", drop_near_duplicates),
    ("suffix-array dedup", remove_repeats),
    ("mixing to target weights", mix_sources),
    ("byte-level BPE", encode),
]

#: Learned scores, fingerprints and token ids have no SQL form; tests hold run() against a
#: brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), name.split()[0])
    return STAGES[-1][1](spark, docs, sf_dir)
