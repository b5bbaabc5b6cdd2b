"""Images of a page by its drawing operators: where each stands, and what of it is seen."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.plans.folds import listed

SAVE, RESTORE, FORM, FORM_END, TRANSFORM, IMAGE = "save", "restore", "form", "form_end", "transform", "image"
Matrix = tuple[float, float, float, float, float, float]
PLAIN: Matrix = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)


def product(m: Matrix, n: Matrix) -> Matrix:
    """The map that applies n, then m."""
    a, b, c, d, e, f = m
    g, h, i, j, k, l, *_ = n  # noqa: E741
    return (a * g + c * h, b * g + d * h, a * i + c * j, b * i + d * j, a * k + c * l + e, b * k + d * l + f)


def painted(ops: DataFrame) -> DataFrame:
    """doc_id, page, seq, m: the map in force at each image operator, from a page's operators
    (doc_id, page, seq, op, m: array of six numbers) in the order of seq. save and form keep the
    map, restore and form_end take back the last one kept (none: the plain one); transform and
    form apply m first; null maps change nothing. Pages come one after the other in a sorted
    partition; what is held is one page's kept maps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, now, kept = None, PLAIN, []
        for batch in batches:
            # the numbers of all maps at once: lists row by row take far longer to become Python's
            maps = batch["m"]
            sizes, values = listed(maps.value_lengths().fill_null(0)), listed(maps.flatten())
            images, drawn, end = [], [], 0
            columns = (listed(batch[c]) for c in ("doc_id", "page", "op"))
            for n, (doc, page, op, size) in enumerate(zip(*columns, sizes, strict=True)):
                end += size
                if at is None or page != at[1] or doc != at[0]:
                    at, now, kept = (doc, page), PLAIN, []
                if op == IMAGE:
                    images.append(n)
                    drawn += now
                elif op == SAVE or op == FORM:
                    kept.append(now)
                elif op == RESTORE or op == FORM_END:
                    now = kept.pop() if kept else PLAIN
                if size and (op == TRANSFORM or op == FORM):
                    now = product(now, values[end - size : end])
            rows = batch.select(["doc_id", "page", "seq"]).take(pa.array(images, pa.int64()))
            ends = pa.array(range(0, len(drawn) + 1, len(PLAIN)), pa.int32())
            made = pa.ListArray.from_arrays(ends, pa.array(drawn, pa.float64()))
            yield pa.RecordBatch.from_arrays([*rows.columns, made], ["doc_id", "page", "seq", "m"])

    known = ops.select(F.col("doc_id").cast("long"), F.col("page").cast("int"), F.col("seq").cast("long"), "op", F.col("m").cast("array<double>"))
    sorted_ = known.repartition("doc_id", "page").sortWithinPartitions("doc_id", "page", "seq")
    return sorted_.mapInArrow(run, "doc_id long, page int, seq long, m array<double>")


def image_boxes(ops: DataFrame, views: DataFrame) -> DataFrame:
    """doc_id, page, seq, x, y, w, h, share (of the page's area) of the images that are seen: the
    rectangle around the unit square under the map, cut by the view (doc_id, page, left, low,
    width, height). For pages' routes (scans.image_cover) and signatures (detect)."""
    m = [F.get("m", F.lit(i)) for i in range(6)]

    def ends(across, up, origin):
        corners = [origin, origin + across, origin + up, origin + across + up]
        return F.least(*corners), F.greatest(*corners)

    (x0, x1), (y0, y1) = ends(m[0], m[2], m[4]), ends(m[1], m[3], m[5])
    rows = painted(ops).join(views.select("doc_id", "page", "left", "low", "width", "height"), ["doc_id", "page"])
    rows = rows.withColumns({"x": F.greatest("left", x0), "y": F.greatest("low", y0), "x1": F.least(F.col("left") + F.col("width"), x1), "y1": F.least(F.col("low") + F.col("height"), y1)})
    rows = rows.withColumns({"w": F.col("x1") - F.col("x"), "h": F.col("y1") - F.col("y")}).where("w > 0 and h > 0")
    return rows.select("doc_id", "page", "seq", "x", "y", "w", "h", (F.col("w") * F.col("h") / (F.col("width") * F.col("height"))).alias("share"))
