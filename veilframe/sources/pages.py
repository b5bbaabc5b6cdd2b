"""Pages of text runs, images and tokens with a known meaning, made from the orders' and customers' keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.sources.templates import FIRST, LAST, pick

#: SQL that Spark and DuckDB both understand; i is a run's number on its page, from 0.
RUNS_OF_PAGE = "CAST(1 + o_orderkey % 5 AS INT)"
JITTER = "(o_orderkey * 3 + i * 7) % 5"
WORDS = "concat('voce ', CAST(i AS STRING), CASE WHEN (o_orderkey + i) % 2 = 0 THEN ' ____' ELSE ' a_bc' END)"
#: The gap to the second run of a line: a blank wide, or none to speak of.
GAP = "CASE WHEN o_orderkey % 2 = 0 THEN 8.0 ELSE 0.5 END"
NAME = f"concat({pick(FIRST, 'c_custkey % 10')}, ' ', {pick(LAST, 'c_custkey % 7')})"


def _runs(spark: SparkSession, sf_dir: str, **columns: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", F.explode(F.expr(f"sequence(0, {RUNS_OF_PAGE} - 1)")).alias("i"))
    return rows.select(F.col("o_orderkey").alias("doc_id"), F.lit(1).alias("page"), *[F.expr(v).alias(k) for k, v in columns.items()])


def two_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs to a line, uneven and in no order: the second stands beside the first."""
    return _runs(
        spark, sf_dir, seg="CAST((i * 5 + 3) % 11 AS INT)", str=WORDS, x=f"CAST(50 + (i % 2) * (60.5 + {GAP}) AS DOUBLE)",
        y=f"CAST(700 - 14 * (i DIV 2) + {JITTER} AS DOUBLE)", w="CAST(60.5 AS DOUBLE)", h="CAST(11 AS DOUBLE)",
    )


def stacked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One run of eleven letters to a line, 14 points below the one before, five points a letter."""
    return _runs(spark, sf_dir, seg="i", str="'abcdefghijk'", x="50D", y="CAST(700 - 14 * i AS DOUBLE)", w="55D", h="11D")


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recognized words 40 points wide beside the runs of stacked(), moved by up to 59 points."""
    return _runs(spark, sf_dir, seg="i", x="CAST(65 + (o_orderkey * 7 + i * 11) % 60 AS DOUBLE)", y="CAST(700 - 14 * i AS DOUBLE)", w="40D", h="11D")


def views(spark: SparkSession, sf_dir: str, width: float, height: float) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return rows.select(
        F.col("o_orderkey").alias("doc_id"), F.lit(1).alias("page"), F.lit(0.0).alias("left"), F.lit(0.0).alias("low"),
        F.lit(width).alias("width"), F.lit(height).alias("height"),
    )


#: Sides of the images of a page of 600 by 800 points, in cells of 15 by 20 points.
IMAGE = {"cx": "(o_orderkey * 7 + i * 13) % 30", "cy": "(o_orderkey * 11 + i * 17) % 30", "cw": "1 + (o_orderkey + i * 19) % 45", "ch": "1 + (o_orderkey * 3 + i * 23) % 45"}


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    sides = {"x": f"15D * ({IMAGE['cx']})", "y": f"20D * ({IMAGE['cy']})", "w": f"15D * ({IMAGE['cw']})", "h": f"20D * ({IMAGE['ch']})"}
    return _runs(spark, sf_dir, i="i", **sides).where("i > 0")


def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with two persons."""
    text = F.concat(F.lit("Il sig. "), F.expr(NAME), F.lit(", "), F.expr(NAME), F.lit(" abita qui."))
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("doc_id"), F.lit(1).alias("page"), text.alias("text"))


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model's tokens of sentences(): the second half of each first name has a label in two of
    three pages, and the surname begins anew in every second."""
    first, last = pick(FIRST, "c_custkey % 10"), pick(LAST, "c_custkey % 7")
    rest = "CASE WHEN c_custkey % 3 = 0 THEN 'O' ELSE 'I-PER' END"
    surname = "CASE WHEN c_custkey % 2 = 0 THEN 'B-PER' ELSE 'I-PER' END"
    person = [
        (f"substr({first}, 1, 2)", "'B-PER'", "0.9D"), (f"concat('##', substr({first}, 3))", rest, "0.6D"), (last, surname, "0.75D"),
    ]
    plain = [("'Il'", "'O'", "1D"), ("'sig'", "'O'", "1D"), ("'.'", "'O'", "1D")]
    told = plain + person + [("','", "'O'", "1D")] + person + [("'[UNK]'", "'O'", "1D"), ("'abita'", "'O'", "1D"), ("'nowhere'", "'B-PER'", "1D")]
    all_of = F.expr("array(" + ", ".join(f"named_struct('word', {w}, 'entity', {e}, 'score', {s})" for w, e, s in told) + ")")
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("doc_id"), F.posexplode(all_of).alias("n", "t"))
    return rows.select("doc_id", F.lit(1).alias("page"), F.lit(0).alias("chunk"), "n", "t.word", "t.entity", "t.score")
