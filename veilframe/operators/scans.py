"""Which pages want optical recognition, and what it adds to them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.operators.geometry import box, overlap_share

GRID, FEW_CHARACTERS, LARGE_IMAGE, WHOLE_PAGE, BAND = 40, 25, 0.25, 0.8, 50.0
VIEW = ("doc_id", "page", "left", "low", "width", "height")


def image_cover(views: DataFrame, images: DataFrame) -> DataFrame:
    """doc_id, page, cover (share of a 40 by 40 grid that images touch), largest (share of the
    page's area of its largest image) of pages (doc_id, page, left, low, width, height) with
    images (doc_id, page, x, y, w, h). A row of the grid is one number, so images meet by an
    aggregate of bits."""
    met = images.join(views.select(*VIEW), ["doc_id", "page"])

    def ends(at: str, size: str, origin: str, whole: str) -> tuple[Column, Column]:
        begin = (F.col(at) - F.col(origin)) / F.col(whole) * GRID
        stop = (F.col(at) - F.col(origin) + F.col(size)) / F.col(whole) * GRID
        first, last = F.greatest(F.lit(0), F.floor(begin).cast("int")), F.least(F.lit(GRID), F.ceil(stop).cast("int"))
        return F.least(first, F.lit(GRID)), F.greatest(last, F.lit(0))

    (x0, x1), (y0, y1) = ends("x", "w", "left", "width"), ends("y", "h", "low", "height")
    bits = F.expr("shiftleft(1L, y1) - shiftleft(1L, y0)")
    sides = [
        F.greatest(F.lit(0.0), F.least(F.col(a) + F.col(s), F.col(o) + F.col(w)) - F.greatest(a, o))
        for a, s, o, w in (("x", "w", "left", "width"), ("y", "h", "low", "height"))
    ]
    met = met.withColumns({"x0": x0, "x1": x1, "y0": y0, "y1": y1, "share": sides[0] * sides[1] / (F.col("width") * F.col("height"))})
    seen = (F.col("x1") > F.col("x0")) & (F.col("y1") > F.col("y0"))
    met = met.select("doc_id", "page", "share", *[F.when(seen, F.col(c)).alias(c) for c in ("x0", "x1")], bits.alias("bits"))
    # one row for each page, with a number for each column of the grid: images are not multiplied by the columns they reach
    drawn = [F.bit_or(F.when((F.col("x0") <= i) & (F.col("x1") > i), F.col("bits"))).alias(f"c{i}") for i in range(GRID)]
    rows = met.groupBy("doc_id", "page").agg(*drawn, F.max("share").alias("largest"))
    cells = F.aggregate(F.array(*[F.col(f"c{i}") for i in range(GRID)]), F.lit(0).cast("long"), lambda n, c: n + F.coalesce(F.bit_count(c), F.lit(0)))
    return rows.select("doc_id", "page", (cells / (GRID * GRID)).alias("cover"), "largest")


def page_routes(views: DataFrame, runs: DataFrame, images: DataFrame) -> DataFrame:
    """doc_id, page, n_chars, cover, route, is_scan: route is raster where images cover 0.8 of
    the page, text_free where it has under 25 characters, mixed where one image takes over a
    quarter of it, else native. All but native pages are read optically."""
    chars = runs.groupBy("doc_id", "page").agg(F.sum(F.length(F.trim("str"))).alias("n_chars"))
    rows = views.select(*VIEW).join(chars, ["doc_id", "page"], "left").join(image_cover(views, images), ["doc_id", "page"], "left")
    rows = rows.na.fill({"n_chars": 0, "cover": 0.0, "largest": 0.0})
    route = (
        F.when(F.col("cover") >= WHOLE_PAGE, "raster").when(F.col("n_chars") < FEW_CHARACTERS, "text_free")
        .when(F.col("largest") > LARGE_IMAGE, "mixed").otherwise("native")
    )
    return rows.select("doc_id", "page", "n_chars", "cover", route.alias("route"), (route != "native").alias("is_scan"))


def _banded(df: DataFrame) -> DataFrame:
    first, last = (F.floor(v / BAND).cast("int") for v in (F.col("y"), F.col("y") + F.col("h")))
    return df.withColumn("band", F.explode(F.sequence(first, last)))


def new_words(words: DataFrame, runs: DataFrame) -> DataFrame:
    """Recognized words (doc_id, page, seg, x, y, w, h) of which no native run covers over half.
    Words and runs meet by bands of 50 points."""
    mine = _banded(words.select("doc_id", "page", "seg", *"xywh")).withColumn("word", box(*(F.col(c) for c in "xywh"))).drop(*"xywh")
    theirs = _banded(runs.select("doc_id", "page", *"xywh")).withColumn("run", box(*(F.col(c) for c in "xywh"))).drop(*"xywh")
    known = mine.join(theirs, ["doc_id", "page", "band"]).where(overlap_share(F.col("word"), F.col("run")) > 0.5)
    return words.join(known.select("doc_id", "page", "seg").distinct(), ["doc_id", "page", "seg"], "left_anti")


def quality(confidence: Column) -> Column:
    """good from 88, fair from 75, else poor; null without a confidence."""
    return F.when(confidence >= 88, "good").when(confidence >= 75, "fair").when(confidence.isNotNull(), "poor")


def document_kinds(pages: DataFrame) -> DataFrame:
    """doc_id, kind (native, scan, mixed), ocr_conf (mean over scanned pages), quality, from
    pages with is_scan and ocr_conf."""
    scanned = F.count_if(F.col("is_scan"))
    kind = F.when(scanned == 0, "native").when(scanned == F.count("*"), "scan").otherwise("mixed")
    rows = pages.groupBy("doc_id").agg(kind.alias("kind"), F.avg(F.when(F.col("is_scan"), F.col("ocr_conf"))).alias("ocr_conf"))
    return rows.withColumn("quality", quality(F.col("ocr_conf")))
