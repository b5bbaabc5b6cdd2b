"""Texts of a known meaning made from the structured tables, one page for each order or customer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FIRST = ("Mario", "Anna", "Luca", "Giulia", "Paolo", "Elena", "Marco", "Sara", "Dario", "Irene")
LAST = ("Rossi", "Verdi", "Bianchi", "Neri", "Gallo", "Conti", "Greco", "Riva", "Serra", "Villa")
#: Sentences by order key modulo their number: text around the name, what the name becomes.
SENTENCES = (
    ("Il minore {} frequenta la scuola.", "B8", "B8", "mask"),
    ("Il Dirigente dott. {} autorizza la spesa.", "P", "P", "keep"),
    ("Ha deposto il testimone {} in aula.", "B7", "B7", "mask"),
    ("Di affidare al geom. {} il rilievo.", "C1", "C1_contractor", "keep"),
    ("Vista la richiesta del sig. {} agli atti.", "C1", "C1", "mask"),
    ("Si liquida al sig. {} il compenso di euro 500.", "C1", "C1_contractor", "keep"),
)


def pick(values: tuple[str, ...], n: str) -> str:
    """SQL for the entry n of values, understood by Spark and by DuckDB."""
    return "CASE " + " ".join(f"WHEN {n} = {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


NAME = f"concat({pick(FIRST, 'o_custkey % 10')}, ' ', {pick(LAST, '(o_custkey DIV 10) % 10')})"
AMOUNT = "CAST(o_orderkey * 37 % 2000 + 1 AS INT)"


def payments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, page, text: one payment for each order."""
    text = F.expr(f"concat('Si liquida a favore di ', {NAME}, ' la somma di euro ', {AMOUNT}, '.')")
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("doc_id"), F.lit(1).alias("page"), text.alias("text"))


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, name: what a recognizer would know of each order's page."""
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("doc_id"), F.expr(NAME).alias("name"))


def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, page, text: a sentence that qualifies the order's person."""
    text = F.expr(pick(tuple(s[0] for s in SENTENCES), f"o_orderkey % {len(SENTENCES)}"))
    text = F.replace(text, F.lit("{}"), F.expr(NAME))
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("doc_id"), F.lit(1).alias("page"), text.alias("text"))
