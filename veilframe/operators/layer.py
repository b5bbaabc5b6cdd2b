"""The text layer of a redacted page: runs of text that no mask touches, and labels that fit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.functions.patterns import let
from veilframe.operators.geometry import BOX, box, common, covered, meets, share_of_run
from veilframe.operators.overlap import gaps, merged

PAD, TOUCH = 1.2, 0.05
SPANS = "array<struct<start:int,end:int>>"
#: A piece of blanks only; Unicode's blanks count, line feeds do not.
BLANK = r"^\p{Zs}*\z"
#: Half of a letter's height is taken as its width, as there are no fonts.
LETTER = 0.5


def padded(b: Column) -> Column:
    return box(b["x"] - PAD, b["y"] - PAD, b["w"] + 2 * PAD, b["h"] + 2 * PAD)


def label_fits(label: Column, mask: Column) -> Column:
    """True if the label can be written in the padded mask: letters begin at 0.62 of its height,
    11 points at most, and shrink by a tenth until they fit or are at most 4.5 points."""
    body = F.least(mask["h"] * 0.62, F.lit(11.0))
    steps = F.ceil(F.greatest(F.lit(0.0), F.log(4.5 / body) / F.log(F.lit(0.9))))
    return LETTER * F.length(label) * body * F.pow(F.lit(0.9), steps) <= mask["w"] - 2


def mask_modes(findings: DataFrame, boxes: DataFrame) -> DataFrame:
    """doc_id, page, seq, mask_mode of masked findings with a label (empty: none) and their
    boxes: full, omissis or pseudonym; full where no box has room for the label."""
    rows = findings.where("decision = 'mask'").join(boxes, ["doc_id", "page", "seq"])
    room = F.exists("boxes", lambda b: label_fits(F.col("label"), padded(b)))
    mode = F.when((F.col("label") == "") | ~room, "full").when(F.col("label").startswith("[SUBJECT"), "pseudonym").otherwise("omissis")
    return rows.select("doc_id", "page", "seq", mode.alias("mask_mode"), ((F.col("label") != "") & ~room).alias("no_room"))


def clear_pieces(runs: DataFrame, findings: DataFrame, boxes: DataFrame) -> DataFrame:
    """doc_id, page, start, end, text: what stays of placed runs beside masked findings.

    Characters in a masked span go, and so does each character that a mask's padded rectangle
    touches, whatever span it belongs to; a form field that a mask touches goes as a whole.
    boxes: doc_id, page, seq, boxes; also those of areas without text. Blank pieces: no row."""
    masked = findings.where("decision = 'mask'").select("doc_id", "page", "seq", "start", "end")
    drawn = masked.join(boxes, ["doc_id", "page", "seq"], "left")
    spans = F.collect_list(F.when(F.col("start").isNotNull(), F.struct("start", "end")))
    drawn = drawn.groupBy("doc_id", "page").agg(merged(spans).alias("spans"), F.flatten(F.collect_list(F.transform("boxes", padded))).alias("masks"))
    rows = runs.where(F.length("str") > 0).join(drawn, ["doc_id", "page"], "left")
    rows = rows.withColumns({
        "spans": F.coalesce("spans", F.array().cast(SPANS)), "masks": F.coalesce("masks", F.array().cast(f"array<{BOX}>")),
        "n": F.length("str"), "own": share_of_run(F.lit(0.0), F.lit(1.0)),
    })
    rows = rows.withColumn("masks", F.filter("masks", lambda b: meets(F.col("own"), b)))
    inner = F.transform(F.filter("spans", lambda s: (s["start"] < F.col("start") + F.col("n")) & (s["end"] > F.col("start"))), lambda s: F.struct(
        F.greatest(s["start"] - F.col("start"), F.lit(0)).alias("start"), F.least(s["end"] - F.col("start"), F.col("n")).alias("end")
    ))

    lying = (F.col("dx") == 1) & (F.col("dy") == 0)
    x, w, n = F.col("x"), F.col("w"), F.col("n")
    # all characters of a lying run are as high as it is: only their places along it tell them apart
    high_enough = lambda b: let(common(F.col("own"), b)[1], lambda v: (v > 0) & (v > F.least(F.lit(TOUCH), F.col("own.h") * 0.3)))
    rows = rows.withColumn("sides", F.when(lying, F.transform(F.filter("masks", high_enough), lambda b: F.struct(b["x"].alias("a"), (b["x"] + b["w"]).alias("b")))))

    def is_touched(i: Column) -> Column:
        def along(c: Column) -> Column:
            return F.exists("sides", lambda s: let(F.least(c["a"] + c["w"], s["b"]) - F.greatest(c["a"], s["a"]), lambda v: (v > 0) & (v > c["least"])))

        wide = F.abs(w * ((i + 1) / n - i / n))
        flat = let(F.struct((x + w * (i / n)).alias("a"), wide.alias("w"), F.least(F.lit(TOUCH), wide / 2).alias("least")), along)
        own = share_of_run(i / n, (i + 1) / n)
        return F.when(lying & (w >= 0), flat).otherwise(let(own, lambda c: F.exists("masks", lambda b: covered(c, b, TOUCH))))

    # a lying run's characters under no mask's width, one more on each side, need no look
    share = lambda at: F.when(lying, F.try_divide((at - x) * n, w))
    within = lambda i, other: F.least(F.greatest(F.coalesce(i, other), F.lit(0)), F.col("n") - 1).cast("int")
    low = within(F.floor(share(F.array_min(F.transform("masks", lambda b: b["x"])))) - 1, F.lit(0))
    high = within(F.ceil(share(F.array_max(F.transform("masks", lambda b: b["x"] + b["w"])))) + 1, F.col("n") - 1)
    touched = F.filter(F.sequence(low, F.greatest(low, high)), is_touched)
    # characters side by side are one interval
    def joined(t: Column) -> Column:
        begins, ends = F.array_except(t, F.transform(t, lambda i: i + 1)), F.array_except(t, F.transform(t, lambda i: i - 1))
        return F.zip_with(begins, ends, lambda a, b: F.struct(a.alias("start"), (b + 1).alias("end")))

    below = let(touched, joined)
    all_of_it = F.array(F.struct(F.lit(0).alias("start"), F.col("n").alias("end")))
    gone = F.when(F.col("whole") & (F.size("masks") > 0), all_of_it).when(F.size("masks") > 0, F.concat(inner, below)).otherwise(inner)
    rows = rows.withColumn("g", F.explode(let(merged(gone), lambda g: gaps(g, F.col("n")))))
    text = F.substring(F.col("str"), F.col("g.start") + 1, F.col("g.end") - F.col("g.start"))
    return rows.where(~text.rlike(BLANK)).select(
        "doc_id", "page", (F.col("start") + F.col("g.start")).alias("start"), (F.col("start") + F.col("g.end")).alias("end"), text.alias("text")
    )
