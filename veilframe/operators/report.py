"""The report's tables: one row for each document, tallies, and what was decided."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilframe.operators.decide import certainty
from veilframe.operators.geometry import percent_place
from veilframe.operators.redact import dropped_pages


def header(pages: DataFrame, findings: DataFrame, purpose: str, mode: str) -> DataFrame:
    """One row for each document: pages, dropped pages, findings by outcome, purpose, mode."""
    size = pages.groupBy("doc_id").agg(F.count("*").alias("n_pages"))
    gone = dropped_pages(findings).groupBy("doc_id").agg(F.count("*").alias("n_dropped"))
    sums = findings.groupBy("doc_id").agg(
        F.count("*").alias("n_findings"), F.count_if(F.col("decision") == "mask").alias("n_masked"),
        F.count_if((F.col("band") == "C") & F.col("decision").isNull()).alias("n_open"),
        F.count_if(F.col("proposed") & ~F.col("confirmed") & ~F.col("modified")).alias("n_to_confirm"),
    )
    rows = size.join(gone, "doc_id", "left").join(sums, "doc_id", "left").na.fill(0)
    ready = (F.col("n_open") == 0) & (F.col("n_to_confirm") == 0)
    return rows.withColumns({"purpose": F.lit(purpose), "mask_mode": F.lit(mode), "ready": ready})


def certainty_tally(findings: DataFrame) -> DataFrame:
    return findings.groupBy("doc_id", certainty(findings).alias("certainty")).agg(F.count("*").alias("n"))


def treated(findings: DataFrame) -> DataFrame:
    """Masked findings in reading order, numbered, without their text."""
    order = Window.partitionBy("doc_id").orderBy("page", F.coalesce("start", F.lit(-1)), "seq")
    rows = findings.where("decision = 'mask'").withColumn("nr", F.row_number().over(order))
    return rows.select("doc_id", "nr", "page", "category", "detector", certainty(findings).alias("certainty"), "reason")


def table(findings: DataFrame, boxes: DataFrame, views: DataFrame, told: DataFrame) -> DataFrame:
    """All findings (with rationale) in reading order, numbered, without their text: page, place
    (per cent from the left and from above of the first rectangle; empty without one), kind,
    certainty, band, outcome, modified, note. boxes: doc_id, page, seq, boxes; told: outcomes().
    Notes over 220 characters end after 217."""
    order = Window.partitionBy("doc_id").orderBy("page", F.coalesce("start", F.lit(-1)), "seq")
    rows = findings.join(boxes, ["doc_id", "page", "seq"], "left").join(views.select("doc_id", "page", "width", "height"), ["doc_id", "page"], "left")
    rows = rows.join(told.select("doc_id", "page", "seq", "outcome", "covered"), ["doc_id", "page", "seq"], "left")
    own = F.when((F.col("origin") == "manual") & (F.col("note") != ""), F.col("note"))
    why = F.when(F.col("rationale") != "", F.concat(F.lit("reason: "), F.col("rationale")))
    note = F.concat_ws("; ", own, why)
    kind = F.concat(F.col("category"), F.when(F.col("origin") == "automatic", "").otherwise(F.concat(F.lit(" ("), F.col("origin"), F.lit(")"))))
    return rows.select(
        "doc_id", F.row_number().over(order).alias("nr"), "page", percent_place(F.get("boxes", F.lit(0)), F.col("width"), F.col("height")).alias("place"),
        kind.alias("kind"), certainty(findings).alias("certainty"), "band",
        F.concat("outcome", F.when(F.col("covered"), " (covered by another mask)").otherwise("")).alias("outcome"), "modified",
        F.when(F.length(note) > 220, F.concat(F.substring(note, 1, 217), F.lit("…"))).otherwise(note).alias("note"),
    )


def band_c(findings: DataFrame) -> DataFrame:
    """What was decided on findings of band C, and by whom."""
    by = F.when(F.col("modified"), "changed by the user").when(F.col("confirmed"), "confirmed").when(F.col("proposed"), "proposed").otherwise("open")
    return findings.where("band = 'C'").groupBy("doc_id", "category", "proposal_key", F.coalesce("decision", F.lit("open")).alias("decision"), by.alias("by")).count()


def restored(findings: DataFrame) -> DataFrame:
    """Findings that a user left in the clear against the default."""
    return findings.where("decision = 'keep' and modified").select("doc_id", "page", "seq", "category", "detector", "note")


def pseudonyms(findings: DataFrame) -> DataFrame:
    """The person numbers in use; no table of names is kept."""
    return findings.where("decision = 'mask' and subject_no is not null").select("doc_id", "subject_no").distinct()
