"""What users add to the findings, take back, and restore with a reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilframe.functions.validators import name_key
from veilframe.operators.detect import STRIDE
from veilframe.operators.findings import constructed, is_person, looked_up
from veilframe.operators.geometry import BOX, box, joined_boxes
from veilframe.operators.layout import span_boxes, spans_in
from veilframe.plans.staging import staged
from veilframe.rules.tables import CATEGORIES, REASON_NEEDED

BY_TEXT, BY_AREA = 300 * STRIDE, 400 * STRIDE


def _made(rows: DataFrame, detector: str) -> DataFrame:
    """Manual findings: band M, masked, whatever their category."""
    key = F.when(is_person(F.col("category")) & (F.col("text") != ""), name_key(F.col("text")))
    made = constructed(rows.withColumns({"detector": F.lit(detector), "origin": F.lit("manual"), "subject_key": key}))
    return made.withColumns({"band": F.lit("M"), "decision": F.lit("mask"), "default_decision": F.lit("mask")})


def valid_texts(requests: DataFrame) -> DataFrame:
    """Requests (doc_id, request, text, category, note) that name a text and a known category."""
    return requests.where((F.trim("text") != "") & F.col("category").isin(list(CATEGORIES)))


def found_texts(pages: DataFrame, requests: DataFrame) -> DataFrame:
    """A manual finding for each place where a page holds a request's text (trimmed, exactly as
    written, places do not overlap)."""
    wanted = valid_texts(requests).select("doc_id", "request", F.trim("text").alias("wanted"), "category", "note")
    met = pages.select("doc_id", "page", "text").join(wanted, "doc_id").where(F.contains(F.col("text"), F.col("wanted")))
    literal = F.concat(F.lit(r"\Q"), F.replace(F.col("wanted"), F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
    parts = met.select("doc_id", "page", "request", "wanted", "category", "note", F.posexplode(F.split("text", literal, -1)).alias("n", "part"))
    order = Window.partitionBy("doc_id", "page", "request").orderBy("n")
    upto = F.sum(F.length("part")).over(order.rowsBetween(Window.unboundedPreceding, 0)) + F.col("n") * F.length("wanted")
    rows = parts.withColumns({"start": upto.cast("int"), "more": F.lead("n").over(order).isNotNull()}).where("more")
    number = F.row_number().over(Window.partitionBy("doc_id", "page").orderBy("start", "request"))
    rows = rows.withColumns({"end": F.col("start") + F.length("wanted"), "text": F.col("wanted"), "seq": F.lit(BY_TEXT) + number})
    return _made(rows.select("doc_id", "page", "seq", "start", "end", "text", "category", "note"), "manual-text")


def valid_areas(requests: DataFrame, views: DataFrame) -> DataFrame:
    """Requests (doc_id, page, request, left, top, width, height in per cent of the page) on
    pages that exist, with a size, as page rectangles x, y, w, h."""
    rows = requests.join(views.select("doc_id", "page", F.col("width").alias("pw"), F.col("height").alias("ph")), ["doc_id", "page"])
    rows = rows.where((F.col("width") > 0) & (F.col("height") > 0) & F.col("left").isNotNull() & F.col("top").isNotNull())
    left, top = (F.greatest(F.lit(0.0), F.col(c)) / 100 for c in ("left", "top"))
    wide, high = (F.least(F.lit(100.0), F.col(c)) / 100 for c in ("width", "height"))
    sides = {"x": left * F.col("pw"), "y": F.col("ph") * (1 - top - high), "w": wide * F.col("pw"), "h": high * F.col("ph")}
    return rows.withColumns(sides).drop("left", "top", "width", "height", "pw", "ph")


def found_areas(requests: DataFrame, views: DataFrame, runs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A manual finding for each valid area, and its boxes (doc_id, page, seq, boxes): those of
    the text whose characters it holds, and the area itself. An area without text has no place."""
    areas = valid_areas(requests.where(F.col("category").isin(list(CATEGORIES))), views).withColumn("seq", F.lit(BY_AREA) + F.col("request"))
    # named twice below: written once, else runs and areas meet twice
    parts = staged(spans_in(areas, runs).withColumn("seq", F.lit(BY_AREA) + F.col("request")), "areas")
    told = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("start", "text"))), lambda p: p["text"]), " ")
    spans = parts.groupBy("doc_id", "page", "seq").agg(F.min("start").alias("start"), F.max("end").alias("end"), told.alias("text"))
    rows = areas.join(spans, ["doc_id", "page", "seq"], "left").withColumn("text", F.coalesce("text", F.lit("")))
    number = F.row_number().over(Window.partitionBy("doc_id", "page", "seq").orderBy("start"))
    pieces = parts.select("doc_id", "page", F.col("seq").alias("of"), number.alias("seq"), "start", "end")
    pieces = pieces.withColumn("seq", F.col("of") * 1000 + F.col("seq"))
    drawn = span_boxes(pieces, runs).withColumn("seq", F.floor(F.col("seq") / 1000).cast("long"))
    drawn = drawn.groupBy("doc_id", "page", "seq").agg(joined_boxes(F.flatten(F.collect_list("boxes"))).alias("inner"))
    own = areas.select("doc_id", "page", "seq", F.array(box(*(F.col(c) for c in "xywh"))).alias("own"))
    boxes = own.join(drawn, ["doc_id", "page", "seq"], "left")
    boxes = boxes.select("doc_id", "page", "seq", F.concat(F.coalesce("inner", F.array().cast(f"array<{BOX}>")), "own").alias("boxes"))
    return _made(rows.select("doc_id", "page", "seq", "start", "end", "text", "category", "note"), "manual"), boxes


def removed(findings: DataFrame, removals: DataFrame) -> DataFrame:
    """Findings without the manual ones of removals (doc_id, page, seq); others cannot be removed."""
    gone = removals.select("doc_id", "page", "seq").distinct().withColumn("origin", F.lit("manual"))
    return findings.join(gone, ["doc_id", "page", "seq", "origin"], "left_anti").select(*findings.columns)


def reason_rule(category: Column) -> Column:
    """required, optional or none: whether restoring a category's findings wants a reason."""
    return F.coalesce(looked_up(category, REASON_NEEDED), F.lit("none"))


def restored_by(findings: DataFrame, requests: DataFrame) -> DataFrame:
    """Findings with rationale, kept in the clear where a request (doc_id, page, seq, rationale;
    of several the longest reason) is admitted: one without a reason is not where it is required."""
    asked = requests.groupBy("doc_id", "page", "seq").agg(F.max_by(F.trim("rationale"), F.struct(F.length(F.trim("rationale")), F.trim("rationale"))).alias("why"))
    rows = findings.join(asked.withColumn("asked", F.lit(True)), ["doc_id", "page", "seq"], "left")
    given = F.coalesce("why", F.lit(""))
    fine = F.coalesce("asked", F.lit(False)) & ((reason_rule(F.col("category")) != "required") | (given != ""))
    rationale = F.when(fine & (reason_rule(F.col("category")) != "none"), given).otherwise("")
    return rows.withColumns({
        "rationale": rationale,
        "modified": F.when(fine, F.coalesce(F.col("default_decision") != "keep", F.lit(False))).otherwise(F.col("modified")),
        "confirmed": F.col("confirmed") | fine, "decision": F.when(fine, "keep").otherwise(F.col("decision")),
    }).select(*findings.columns, "rationale")


def spread_decisions(findings: DataFrame, chosen: DataFrame) -> DataFrame:
    """Findings with the decision and rationale of chosen ones (doc_id, page, seq) on all findings
    of the document with the same subject_key that were decided otherwise. Of several chosen
    for one key the last in reading order counts."""
    picked = findings.join(chosen.select("doc_id", "page", "seq").distinct(), ["doc_id", "page", "seq"])
    order = F.struct("page", "seq")
    picked = picked.where("subject_key is not null").groupBy("doc_id", "subject_key").agg(F.max_by(F.struct("decision", "rationale"), order).alias("to"))
    rows = findings.join(picked, ["doc_id", "subject_key"], "left")
    differs = F.col("to").isNotNull() & ~F.col("decision").eqNullSafe(F.col("to.decision"))
    decision = F.when(differs, F.col("to.decision")).otherwise(F.col("decision"))
    other = F.coalesce(F.col("default_decision") != F.col("to.decision"), F.lit(False))
    return rows.withColumns({
        "decision": decision, "rationale": F.when(differs, F.col("to.rationale")).otherwise(F.col("rationale")),
        "modified": F.when(differs, other).otherwise(F.col("modified")), "confirmed": F.col("confirmed") | (differs & F.col("proposed")),
    }).select(*findings.columns)


def panel(findings: DataFrame, bands: tuple[str, ...]) -> DataFrame:
    """Findings of the bands named, in their order, then by page and place, with nr."""
    rank = F.array_position(F.array(*map(F.lit, bands)), F.col("band"))
    order = Window.partitionBy("doc_id").orderBy(rank, "page", F.coalesce("start", F.lit(-1)), "seq")
    return findings.where(F.col("band").isin(list(bands))).withColumn("nr", F.row_number().over(order))


def summary_groups(findings: DataFrame) -> DataFrame:
    """doc_id, page, seq, group: masked, kept_by_rule, restored, to_check, institutional. A
    finding that a user restored is in no other group unless it is institutional."""
    kept, company = F.col("decision") == "keep", F.col("proposal_key") == "C6_company"
    groups = F.array_compact(F.array(
        F.when(F.col("decision") == "mask", "masked"),
        F.when((F.col("band") == "C") & kept & ~company & ~F.col("modified"), "kept_by_rule"),
        F.when(kept & F.col("modified") & (F.col("band") != "P"), "restored"),
        F.when((F.col("band") == "C") & F.col("decision").isNull(), "to_check"),
        F.when(kept & ((F.col("band") == "P") | company), "institutional"),
    ))
    return findings.select("doc_id", "page", "seq", F.explode(groups).alias("group"))
