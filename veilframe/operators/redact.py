"""Redacted text: labels for masked spans, pages dropped, the outcome of each finding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.functions.patterns import slice_of
from veilframe.operators.findings import is_person, keyed
from veilframe.operators.geometry import covered
from veilframe.operators.overlap import gaps, merged
from veilframe.operators.silence import swept

#: Fixed value: points that a drawn mask goes beyond its rectangle on each side.
MARGIN = 1.2
#: Points of a side of the cells by which rectangles meet.
CELL = 64.0
FULL, OMISSIS, PSEUDONYM = "full", "omissis", "pseudonym"


def label(mode: str) -> Column:
    """What stands for a masked finding: nothing (full), [OMISSIS], or the person's number."""
    if mode == FULL:
        return F.lit("")
    if mode == OMISSIS:
        return F.lit("[OMISSIS]")
    named = is_person(F.col("category")) & F.col("subject_no").isNotNull()
    return F.when(named, F.concat(F.lit("[SUBJECT "), F.col("subject_no"), F.lit("]"))).otherwise("[OMISSIS]")


def dropped_pages(findings: DataFrame) -> DataFrame:
    return findings.where("decision = 'mask' and action = 'drop'").select("doc_id", "page").distinct()


def redacted(pages: DataFrame, findings: DataFrame, mode: str = OMISSIS) -> DataFrame:
    """doc_id, page, redacted_text of the pages that are not dropped. Spans that overlap
    are masked as one, with the label of the first; spans that only touch have their own labels.
    Keys that are null are an error."""
    pages, findings = keyed(pages), keyed(findings)
    spans = findings.where("decision = 'mask' and start is not null").withColumn("label", label(mode))
    spans = spans.groupBy("doc_id", "page").agg(F.sort_array(F.collect_list(F.struct("start", "end", "seq", "label"))).alias("spans"))
    rows = pages.select("doc_id", "page", "text").join(dropped_pages(findings), ["doc_id", "page"], "left_anti").join(spans, ["doc_id", "page"], "left")
    none = F.array().cast("array<struct<start:int,end:int>>")
    masks = merged(F.coalesce(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))), none), touching=False)
    rows = rows.withColumn("masks", masks)
    clear = gaps(F.col("masks"), F.length("text"))
    parts = F.concat(
        F.transform(clear, lambda g: F.struct(g["start"].alias("at"), slice_of(F.col("text"), g["start"], g["end"]).alias("part"))),
        F.transform("masks", lambda m: F.struct(
            m["start"].alias("at"), F.get(F.filter("spans", lambda s: s["start"] == m["start"]), F.lit(0))["label"].alias("part")
        )),
    )
    text = F.array_join(F.transform(F.array_sort(parts), lambda p: p["part"]), "")
    return rows.select("doc_id", "page", text.alias("redacted_text"))


def outcomes(findings: DataFrame) -> DataFrame:
    """doc_id, page, seq, outcome: dropped, masked or clear, and whether a masked span covers a
    clear one."""
    findings = keyed(findings)
    gone = dropped_pages(findings).withColumn("gone", F.lit(True))
    rows = findings.join(gone, ["doc_id", "page"], "left")
    masks = findings.where("decision = 'mask' and start is not null").select("doc_id", "page", "start", "end")
    clear = rows.where("start is not null and (decision is null or decision <> 'mask')").select("doc_id", "page", "seq", "start", "end")
    # of the masks that begin before its end, does one end behind its start?
    over = swept(clear, F.col("end"), masks, F.col("start"), False).where("before > start").select("doc_id", "page", "seq").distinct()
    over = over.withColumn("covered", F.lit(True))
    rows = rows.join(over, ["doc_id", "page", "seq"], "left")
    outcome = F.when(F.col("gone"), "dropped").when(F.col("decision") == "mask", "masked").otherwise("clear")
    return rows.select("doc_id", "page", "seq", outcome.alias("outcome"), F.coalesce("covered", F.lit(False)).alias("covered"))


def _celled(boxes: DataFrame, margin: float) -> DataFrame:
    """Rectangles (x, y, w, h) grown by margin, once for each cell that they touch."""
    x, y, w, h = F.col("x") - margin, F.col("y") - margin, F.col("w") + 2 * margin, F.col("h") + 2 * margin

    def cells(at, size):
        return F.explode(F.sequence(F.floor(at / CELL), F.floor((at + size) / CELL)))

    rows = boxes.withColumns({"x": x, "y": y, "w": w, "h": h}).withColumn("cx", cells(F.col("x"), F.col("w")))
    return rows.withColumn("cy", cells(F.col("y"), F.col("h")))


def box_outcomes(findings: DataFrame, boxes: DataFrame) -> DataFrame:
    """outcomes() of findings by where they stand on the page: boxes (doc_id, page, seq, x, y, w, h)
    are their rectangles, one or more each. A finding in the clear counts as covered where another
    one's mask, as it is drawn, covers one of its rectangles by more than the tolerance of
    geometry.covered; on dropped pages nothing is covered. Rectangles meet by cells of the page."""
    findings, boxes = keyed(findings), keyed(boxes)
    gone = dropped_pages(findings).withColumn("gone", F.lit(True))
    rows = findings.select("doc_id", "page", "seq", "decision").join(gone, ["doc_id", "page"], "left")
    placed = boxes.join(rows, ["doc_id", "page", "seq"]).where("gone is null")
    rectangle = F.struct("x", "y", "w", "h")
    masks = _celled(placed.where("decision = 'mask'").select("doc_id", "page", "x", "y", "w", "h"), MARGIN)
    clear = _celled(placed.where("decision is null or decision <> 'mask'").select("doc_id", "page", "seq", "x", "y", "w", "h"), 0.0)
    met = clear.select("doc_id", "page", "cx", "cy", "seq", rectangle.alias("own")).join(masks.select("doc_id", "page", "cx", "cy", rectangle.alias("mask")), ["doc_id", "page", "cx", "cy"])
    over = met.where(covered(F.col("own"), F.col("mask"))).select("doc_id", "page", "seq").distinct().withColumn("covered", F.lit(True))
    outcome = F.when(F.col("gone"), "dropped").when(F.col("decision") == "mask", "masked").otherwise("clear")
    told = rows.select("doc_id", "page", "seq", outcome.alias("outcome")).join(over, ["doc_id", "page", "seq"], "left")
    note = F.when(F.col("covered"), "covered, in whole or in part, by another mask").when(F.col("outcome") == "dropped", "page dropped").otherwise("")
    return told.select("doc_id", "page", "seq", "outcome", F.coalesce("covered", F.lit(False)).alias("covered"), note.alias("note"))
