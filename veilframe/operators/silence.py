"""Findings that matter only near a person.

Persons and findings of a page are swept once in the order of their places: a running last end and
the next start tell the nearest persons, so no page's findings meet all its persons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilframe.functions.patterns import same_clause
from veilframe.operators.findings import COLUMNS, is_person, keyed
from veilframe.rules.tables import HEALTH_LINES, HEALTH_RADIUS, NAME_RADIUS, SILENCED


def swept(rows: DataFrame, place: Column, marks: DataFrame, mark: Column, first: bool) -> DataFrame:
    """rows with `before`, the last end of their page's marks (doc_id, page, start, end) that stand
    before them in the sweep, and `after`, the first start of those that stand behind. Rows stand
    at place, marks at mark; at one place marks come first, or rows."""
    whole = F.struct(*[F.col(c) for c in rows.columns])
    turn = F.lit(1) if first else F.lit(-1)
    events = rows.select("doc_id", "page", place.alias("at"), turn.alias("turn"), whole.alias("row"), F.lit(None).cast("int").alias("s"), F.lit(None).cast("int").alias("e"))
    events = events.unionAll(marks.select("doc_id", "page", mark.alias("at"), F.lit(0).alias("turn"), F.lit(None).cast(rows.select(whole.alias("w")).schema["w"].dataType).alias("row"), F.col("start"), F.col("end")))
    order = Window.partitionBy("doc_id", "page").orderBy("at", "turn")
    before = F.max("e").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    after = F.min("s").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    return events.withColumns({"before": before, "after": after}).where("row is not null").select("row.*", "before", "after")


def _persons(findings: DataFrame) -> DataFrame:
    return findings.where(is_person(F.col("category")) & F.col("start").isNotNull()).select("doc_id", "page", "start", "end")


def silenced(findings: DataFrame) -> DataFrame:
    """Without judicial, hardship and employment findings that have no name within NAME_RADIUS."""
    findings = keyed(findings)
    quiet = F.col("category").isin(list(SILENCED)) & F.col("start").isNotNull()
    # of the persons that begin early enough, does one end late enough?
    seen = swept(findings.where(quiet), F.col("end") + NAME_RADIUS, _persons(findings), F.col("start"), True)
    kept = seen.where(F.col("before") >= F.col("start") - NAME_RADIUS)
    return findings.where(~quiet).unionByName(kept.select(*findings.columns))


def demoted(pages: DataFrame, findings: DataFrame) -> DataFrame:
    """Health findings (A1) without a person in the same clause become C8, to be decided.

    Only the nearest person on either side counts: what ends a clause before that one does so
    before all beyond it. A page's text comes once for all its findings."""
    findings = keyed(findings)
    health = (F.col("category") == "A1") & F.col("start").isNotNull()
    seen = swept(findings.where(health).select(*COLUMNS), F.col("end"), _persons(findings), F.col("start"), False)
    meets = F.col("before") >= F.col("start")
    left = F.when(F.col("before") >= F.col("start") - HEALTH_RADIUS, F.col("before"))
    right = F.when(F.col("after") <= F.col("end") + HEALTH_RADIUS, F.col("after"))
    seen = seen.select(*COLUMNS, F.coalesce(meets, F.lit(False)).alias("meets"), left.alias("left"), right.alias("right"))
    each = F.struct(*COLUMNS, "meets", "left", "right")
    by_page = seen.groupBy("doc_id", "page").agg(F.collect_list(each).alias("found")).join(pages.select("doc_id", "page", "shadow"), ["doc_id", "page"], "left")

    def near(x: Column) -> Column:
        clause = lambda a, b: a.isNotNull() & b.isNotNull() & F.coalesce(same_clause(F.col("shadow"), a, b, HEALTH_LINES), F.lit(False))
        return x["meets"] | clause(x["left"], x["start"]) | clause(x["end"], x["right"])

    told = F.transform("found", lambda x: F.struct(x.alias("x"), near(x).alias("near")))
    rows = by_page.select(F.explode(told).alias("t")).select("t.x.*", "t.near")
    nothing = F.lit(None).cast("string")
    new = {
        "category": F.lit("C8"), "band": F.lit("C"), "decision": nothing, "default_decision": nothing, "proposal_key": F.lit("C8"),
        "note": F.lit("no name nearby: maybe a general or legal reference"),
    }
    rows = rows.withColumns({k: F.when(F.col("near"), F.col(k)).otherwise(v) for k, v in new.items()})
    return findings.where(~health).select(*COLUMNS).unionByName(rows.select(*COLUMNS))
