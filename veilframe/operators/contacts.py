"""Contacts of bodies and companies, which stay in the clear although they look personal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.functions.patterns import last_place, let, slice_of, union
from veilframe.functions.validators import institutional_domain, personal_domain
from veilframe.operators.findings import COLUMNS, band_of, default_decision, looked_up
from veilframe.operators.geometry import BOX
from veilframe.rules import fixed
from veilframe.rules.tables import CATEGORIES

# ---- fixed values: characters of context before a contact, between it and the holder of a role,
# of a letterhead's text; shares of the page's height that are head and foot
CONTEXT, ROLE_RADIUS, ROLE_LINES, ZONE_TEXT, HEAD, FOOT = 320, 250, 3, 400, 0.13, 0.07
# ---- end of fixed values
#: Where text without positions is taken to stand: its first line and the lines' pitch and height.
TOP, PITCH, HEIGHT, PAGE_HEIGHT = 700.0, 14.0, 11.0, 841.89
CONTACTS = ("landline", "address", "email")
BODY = f"(?:{fixed.COMPANY_CONTEXT}|{fixed.INSTITUTION_CONTEXT})"
ROLE_NOTE = "role in the context"


def _breaks(text: Column) -> Column:
    return F.length(text) - F.length(F.translate(text, "\n", ""))


def is_contact() -> Column:
    """Findings that may be a body's."""
    return F.col("detector").isin(list(CONTACTS)) & (F.col("band") == "B") & F.col("start").isNotNull()


def institutional(pages: DataFrame, findings: DataFrame, boxes: DataFrame | None = None) -> DataFrame:
    """Findings whose landlines, addresses and e-mails (band B, with a place) become P where they
    belong to a body: beside the holder of a public role, in a head or foot that names a body, or
    in the block of a company or body that is not a natural person's.

    Addresses at personal mail providers and contacts in a personal context stay as they are.
    Where contacts stand is told by boxes (doc_id, page, seq, boxes: see layout.span_boxes) and the
    pages' page_height. Without boxes, pages are taken as plain text, whose first line is at top."""
    plain = {"top": F.lit(TOP), "page_height": F.lit(PAGE_HEIGHT)}
    geometry = [(F.col(c) if c in pages.columns else v).cast("double").alias(c) for c, v in plain.items()]
    holder = (F.col("category") == "P") & F.col("note").startswith(ROLE_NOTE) & F.col("start").isNotNull()
    roles = findings.where(holder).groupBy("doc_id", "page").agg(F.collect_list(F.struct("start", "end")).alias("roles"))
    found = findings.where(is_contact()).select("doc_id", "page", "seq", "start", "end", "text", "detector")
    if boxes is not None:
        found = found.join(boxes.select("doc_id", "page", "seq", "boxes"), ["doc_id", "page", "seq"], "left")
    else:
        found = found.withColumn("boxes", F.lit(None).cast(f"array<{BOX}>"))
    own = found.groupBy("doc_id", "page").agg(F.collect_list(F.struct("seq", "start", "end", "text", F.col("detector") == "email", "boxes")).alias("contacts"))
    rows = pages.select("doc_id", "page", F.col("text").alias("t"), *geometry).join(own, ["doc_id", "page"]).join(roles, ["doc_id", "page"], "left")
    t, none = F.col("t"), F.array().cast("array<struct<start:int,end:int>>")

    def high(line: Column) -> Column:
        return F.col("top") - F.lit(PITCH) * line > F.col("page_height") * (1 - HEAD)

    def low(line: Column) -> Column:
        return F.col("top") - F.lit(PITCH) * line + HEIGHT < F.col("page_height") * FOOT

    def near(c: Column) -> Column:
        def fits(x: Column) -> Column:
            apart = F.least(F.abs(x["start"] - c["end"]), F.abs(c["start"] - x["end"]))
            between = slice_of(t, F.least(x["start"], c["start"]), F.greatest(x["end"], c["end"]))
            return (apart <= ROLE_RADIUS) & (_breaks(between) <= ROLE_LINES)

        return F.exists(F.coalesce("roles", none), fits)

    def facts(c: Column) -> Column:
        before = slice_of(t, F.lit(0), c["start"])
        first = _breaks(before)
        if boxes is not None:
            placed = F.coalesce(c["boxes"], F.array().cast(f"array<{BOX}>"))
            above = lambda b: b["y"] > F.col("page_height") * (1 - HEAD)
            below = lambda b: b["y"] + b["h"] < F.col("page_height") * FOOT
            outer, upper = F.forall(placed, lambda b: above(b) | below(b)), F.forall(placed, above)
        else:
            lines = F.sequence(first, first + _breaks(slice_of(t, c["start"], c["end"])))
            outer, upper = F.forall(lines, lambda i: high(i) | low(i)), F.forall(lines, high)
        return F.struct(
            c["seq"].alias("seq"), c["text"].alias("text"), c["col5"].alias("email"), near(c).alias("near"),
            F.substring_index(before, "\n", -1).alias("line"),
            let(F.substring_index(before, "\n", -4), lambda x: F.substring(x, F.greatest(F.length(x) - CONTEXT, F.lit(0)) + 1, F.lit(CONTEXT))).alias("block"),
            outer.alias("outer"), upper.alias("upper"),
        )

    seen = rows.select(
        "doc_id", "page", F.explode(F.transform("contacts", facts)).alias("c"),
        F.substring(t, 1, ZONE_TEXT).alias("head"), F.substring(t, F.greatest(F.length(t) - ZONE_TEXT, F.lit(0)) + 1, F.lit(ZONE_TEXT)).alias("foot"),
    )
    impersonal = last_place(F.col("c.line"), fixed.PERSONAL_CONTEXT) < 0
    provider = F.col("c.email") & personal_domain(F.col("c.text"))
    official = F.when(F.col("c.email"), institutional_domain(F.col("c.text"))).otherwise(impersonal)
    zone = F.when(F.col("c.upper"), F.col("head")).otherwise(F.col("foot"))
    lettered = F.col("c.outer") & impersonal & (last_place(zone, BODY) >= 0)

    def blocked(block: Column) -> Column:
        places = F.struct(
            last_place(block, BODY).alias("body"), last_place(block, union(fixed.NATURAL_PERSON), place="end").alias("natural"),
            last_place(block, fixed.PERSONAL_CONTEXT).alias("personal"),
        )
        return let(places, lambda p: (p["body"] >= 0) & (p["natural"] < p["body"]) & (p["personal"] < p["body"]))

    why = (
        F.when(official & ~provider & F.col("c.near"), "contact of the holder of a public role")
        .when(lettered & ~provider, "contact in a head or foot: probably a body's")
        .when(blocked(F.col("c.block")), "contact in the block of a company or body")
    )
    made = seen.select("doc_id", "page", "c.seq", why.alias("why")).where("why is not null")
    joined = findings.join(made, ["doc_id", "page", "seq"], "left")
    public, nothing = F.col("why").isNotNull(), F.lit(None).cast("string")
    new = {
        "category": F.lit("P"), "band": band_of(F.lit("P")), "decision": default_decision(F.lit("P")), "default_decision": default_decision(F.lit("P")),
        "action": looked_up(F.lit("P"), {k: row[2] for k, row in CATEGORIES.items()}), "proposal_key": F.lit("P"), "note": F.col("why"), "subject_key": nothing,
    }
    return joined.withColumns({k: F.when(public, v).otherwise(F.col(k)) for k, v in new.items()}).select(*COLUMNS)
