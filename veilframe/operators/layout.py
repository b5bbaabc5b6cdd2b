"""From runs of text with places to pages of text, and back from spans to rectangles.

Runs: doc_id, page, seg (order in the file), str, x, y, dx, dy, w, h; line_end (the file ends a
line after it), whole (a form field whose characters have no places of their own) and field
(its rectangle) if there are any."""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilframe.functions.patterns import let
from veilframe.operators.geometry import BOX, box, joined_boxes, meets, share_of_run
from veilframe.plans.folds import folded

CELL = 512
RUN = ("doc_id", "page", "seg", "str", "x", "y", "dx", "dy", "w", "h", "whole", "field", "line_end")


def runs_of(segments: DataFrame) -> DataFrame:
    """segments with all columns of a run: nulls are an empty text, lying, and no field."""
    plain = {"dx": F.lit(1.0), "dy": F.lit(0.0), "whole": F.lit(False), "field": F.lit(None).cast(BOX), "line_end": F.lit(False)}
    rows = segments.withColumns({k: v for k, v in plain.items() if k not in segments.columns})
    kinds = {"str": F.coalesce("str", F.lit("")), "whole": F.coalesce("whole", F.lit(False)), "line_end": F.coalesce("line_end", F.lit(False))}
    numbers = {c: F.coalesce(F.col(c).cast("double"), plain.get(c, F.lit(0.0))) for c in ("x", "y", "dx", "dy", "w", "h")}
    return rows.withColumns(kinds | numbers).select(*RUN)


def text_runs(items: DataFrame) -> DataFrame:
    """Runs from text items (doc_id, page, seg, str, a, b, d, e, f of the matrix, width, height):
    direction from the matrix, a descent of 0.22 of the height, 1.12 of it in all. Items that
    are empty, or have no width and are not blank, are dropped. No height: that of the matrix."""
    size = F.hypot("a", "b")
    known = [F.when(v > 0, v) for v in (F.col("height"), F.abs("d"), size)]
    dx, dy = F.when(size > 0, F.col("a") / size).otherwise(1.0), F.when(size > 0, F.col("b") / size).otherwise(0.0)
    wanted = (F.length("str") > 0) & ((F.coalesce("width", F.lit(0.0)) > 0) | (F.trim("str") == ""))
    rows = items.where(wanted).withColumns({"dx": dx, "dy": dy, "height": F.coalesce(*known, F.lit(1.0))})
    low = 0.22 * F.col("height")
    return runs_of(rows.withColumns({
        "x": F.col("e") + F.col("dy") * low, "y": F.col("f") - F.col("dx") * low, "w": F.col("width"), "h": 1.12 * F.col("height")
    }))


def field_runs(fields: DataFrame) -> DataFrame:
    """Runs from filled form fields (doc_id, page, seg, value, x, y, w, h): one for each line of
    the value that is not blank, all with the field's whole rectangle."""
    lines = F.split("value", r"\r?\n")
    rows = fields.select("doc_id", "page", "seg", F.posexplode(lines).alias("line", "str"), F.size(lines).alias("n"), "x", "y", "w", "h")
    high = F.col("h") / F.col("n")
    return runs_of(rows.where((F.trim("str") != "") & (F.col("w") > 0) & (F.col("h") > 0)).select(
        "doc_id", "page", (F.col("seg") * 1000 + F.col("line")).alias("seg"), "str", "x",
        (F.col("y") + F.col("h") - high * (F.col("line") + 1)).alias("y"), "w", high.alias("h"),
        F.lit(True).alias("line_end"), F.lit(True).alias("whole"), box(F.col("x"), F.col("y"), F.col("w"), F.col("h")).alias("field"),
    ))


def _woven(line: list[dict]) -> list[dict]:
    """A line's runs from left to right. Where one begins inside another, over nothing but
    underscores, points and blanks (a filled form line), the other is cut around it."""
    waiting = [(r["x"], 1, n, r) for n, r in enumerate(line)]
    heapq.heapify(waiting)
    out: list[dict] = []
    rests = 0
    while waiting:
        run = heapq.heappop(waiting)[3]
        out.append(run)
        over, size, text = waiting[0][3] if waiting else None, len(run["str"]), run["str"]
        if over is None or size < 3 or not run["x"] + 0.3 * run["h"] < over["x"] < run["x"] + run["w"] - 0.3 * run["h"]:
            continue
        begin, stop = ((over["x"] + d - run["x"]) / run["w"] for d in (0, over["w"]))
        first = next((k for k in range(1, size) if k / size >= begin), size)
        last = next((k for k in range(first, size) if k / size >= stop), size)
        if first == size or text[first:last].replace("_", "").replace(".", "").strip():
            continue
        out[-1] = run | {"str": text[:first], "w": run["w"] * first / size}
        if last < size:
            out.append(heapq.heappop(waiting)[3])
            far = run["w"] * last / size
            rest = run | {"str": text[last:], "x": run["x"] + run["dx"] * far, "y": run["y"] + run["dy"] * far, "w": run["w"] - far}
            rests += 1
            heapq.heappush(waiting, (rest["x"], 0, -rests, rest))
    return out


def _read(rows: list[dict]) -> list[dict]:
    """One page's runs in the order of reading, numbered, the last of each line marked."""
    lying = [r for r in rows if abs(r["dy"]) < 0.05 and r["dx"] > 0]
    if len(lying) < 2:
        ordered = rows
    else:
        lines: list[tuple[dict, float, list[dict]]] = []
        for run in sorted(lying, key=lambda r: (-r["y"], r["x"])):
            if lines and abs(lines[-1][0]["y"] - run["y"]) < 0.5 * min(lines[-1][1], run["h"]):
                leader, high, own = lines.pop()
                lines.append((leader, max(high, run["h"]), [*own, run]))
            else:
                lines.append((run, run["h"], [run]))
        ordered = []
        for _, _, own in lines:
            woven = _woven(sorted(own, key=lambda r: r["x"]))
            ordered += [r | {"line_end": n == len(woven) - 1} for n, r in enumerate(woven)]
        ordered += [r for r in rows if abs(r["dy"]) >= 0.05 or r["dx"] <= 0]
    return [r | {"place": n} for n, r in enumerate(ordered)]


def placed_runs(segments: DataFrame, reorder: bool = True) -> DataFrame:
    """Runs with place (their number on the page), line_end, lead (what stands before them: a
    line feed, a blank or nothing) and start (their place in the page's text).

    Read from top to bottom in lines whose runs lie less than half their height from the
    line's first one; runs in other directions follow. reorder=False keeps the order of seg."""
    # place follows seg where it is kept: one sort for all windows then
    page, order = ["doc_id", "page"], Window.partitionBy("doc_id", "page").orderBy("place" if reorder else "seg")
    rows = runs_of(segments).withColumn("place", F.lit(0))
    if reorder:
        rows = folded(rows, page, ["seg"], _read)
    else:
        rows = rows.withColumn("place", (F.row_number().over(order) - 1).cast("int"))
    before = F.lag(F.struct("x", "y", "dx", "dy", "w", "h", "line_end")).over(order)
    rows = rows.withColumn("p", before)
    p = F.col("p")
    high = F.greatest(p["h"], F.col("h"), F.lit(1.0))
    from_x, from_y = F.col("x") - p["x"], F.col("y") - p["y"]
    along = (from_x - p["dx"] * p["w"]) * p["dx"] + (from_y - p["dy"] * p["w"]) * p["dy"]
    across = F.abs(from_y * p["dx"] - from_x * p["dy"])
    lead = (
        F.when(p.isNull(), "").when(p["line_end"] | (across >= 0.6 * high) | (along <= -2 * high), "\n")
        .when(along > 0.12 * high, " ").otherwise("")
    )
    rows = rows.withColumn("lead", lead)
    size = F.length("str")
    start = F.sum(F.length("lead") + size).over(order.rowsBetween(Window.unboundedPreceding, 0)) - size
    return rows.withColumn("start", start.cast("int")).drop("p")


def page_texts(runs: DataFrame) -> DataFrame:
    """doc_id, page, text of placed runs. Underscores become blanks, but for one that stands
    between letters or digits; places stay as they are."""
    shown = F.concat("lead", F.regexp_replace("str", r"(?<![\p{L}\p{N}])_|_(?![\p{L}\p{N}])", " "))
    parts = F.sort_array(F.collect_list(F.struct("place", shown.alias("part"))))
    return runs.groupBy("doc_id", "page").agg(F.array_join(F.transform(parts, lambda p: p["part"]), "").alias("text"))


def _touched(spans: DataFrame, runs: DataFrame) -> DataFrame:
    """Spans (start, end as a, b) with the runs that they touch. Both are met by cells of CELL
    characters, each pair in the first cell that both reach."""
    cells = F.sequence((F.col("a") / CELL).cast("int"), ((F.greatest(F.col("b"), F.col("a") + 1) - 1) / CELL).cast("int"))
    left = spans.withColumn("cell", F.explode(cells))
    stop = F.col("start") + F.length("str")
    reach = F.sequence((F.col("start") / CELL).cast("int"), ((stop - 1) / CELL).cast("int"))
    right = runs.where(F.length("str") > 0).withColumn("cell", F.explode(reach))
    met = left.join(right, ["doc_id", "page", "cell"]).where((F.col("start") < F.col("b")) & (stop > F.col("a")))
    return met.where(F.col("cell") == (F.greatest("start", "a") / CELL).cast("int")).drop("cell")


def span_boxes(findings: DataFrame, runs: DataFrame) -> DataFrame:
    """doc_id, page, seq, boxes: the rectangles of each finding with a place, those side by side
    made one. A touched form field is covered whole. Findings over blanks only have no row."""
    spans = findings.where("start is not null").select("doc_id", "page", "seq", F.col("start").alias("a"), F.col("end").alias("b"))
    size = F.length("str")
    met = _touched(spans, runs).withColumns({
        "first": F.greatest(F.col("a") - F.col("start"), F.lit(0)), "last": F.least(F.col("b") - F.col("start"), size)
    })
    part = F.substring(F.col("str"), F.col("first") + 1, F.col("last") - F.col("first"))
    drawn = share_of_run(F.col("first") / size, F.col("last") / size)
    all_of_it = F.coalesce(F.col("field"), share_of_run(F.lit(0.0), F.lit(1.0)))
    met = met.where(F.trim(part) != "").withColumn("b1", F.when(F.col("whole"), all_of_it).otherwise(drawn))
    return met.groupBy("doc_id", "page", "seq").agg(joined_boxes(F.collect_list("b1")).alias("boxes"))


def with_geometry(findings: DataFrame, runs: DataFrame) -> DataFrame:
    """Findings with boxes (empty for those of a whole page); those over blanks only are dropped."""
    found = findings.join(span_boxes(findings, runs), ["doc_id", "page", "seq"], "left")
    return found.where("start is null or boxes is not null").withColumn("boxes", F.coalesce("boxes", F.array().cast(f"array<{BOX}>")))


def spans_in(rectangles: DataFrame, runs: DataFrame) -> DataFrame:
    """rectangles (doc_id, page, request, x, y, w, h) with a row for each run of which they hold
    the centre of a character: start, end of the characters from first to last, text. Only
    blanks: no row."""
    rect = rectangles.select("doc_id", "page", "request", box(*(F.col(c) for c in "xywh")).alias("rect"))
    met = rect.join(runs, ["doc_id", "page"]).where(meets(share_of_run(F.lit(0.0), F.lit(1.0)), F.col("rect")) & (F.length("str") > 0))
    size = F.length("str")

    def inside(i):
        at = F.col("w") * (i + 0.5) / size
        x = F.col("x") + F.col("dx") * at - F.col("dy") * F.col("h") / 2
        y = F.col("y") + F.col("dy") * at + F.col("dx") * F.col("h") / 2
        r = F.col("rect")
        return x.between(r["x"], r["x"] + r["w"]) & y.between(r["y"], r["y"] + r["h"])

    hit = F.filter(F.sequence(F.lit(0), size - 1), inside)
    first_last = lambda h: F.struct(F.array_min(h).alias("from"), (F.array_max(h) + 1).alias("to"))
    # each character is looked at once: a filter on from and to would repeat it for every mention of them
    met = met.select("doc_id", "page", "request", "start", "str", F.explode(F.array(let(hit, first_last))).alias("h"))
    text = F.substring(F.col("str"), F.col("h.from") + 1, F.col("h.to") - F.col("h.from"))
    return met.where(F.trim(text) != "").select(
        "doc_id", "page", "request", (F.col("start") + F.col("h.from")).alias("start"), (F.col("start") + F.col("h.to")).alias("end"), text.alias("text")
    )
