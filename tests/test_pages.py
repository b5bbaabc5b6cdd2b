"""Pages, scans, manual findings and citations: awkward rows by hand, and queries against DuckDB."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from veilframe import page_queries
from veilframe.operators import geometry, layer, layout, legal, manual, recognizer, scans
from veilframe.sources import files
from veilframe.sources.templates import FIRST

SF = "/root/testdata/sf0.001"
RUN = "doc_id long, page int, seg int, str string, x double, y double, w double, h double"
#: An analysis each, so they run with the check of all queries only.
SLOW = ("restored_findings", "spread_decisions", "sql_views", "signature_images")


def _texts(spark, rows, schema=RUN, reorder=True):
    runs = layout.placed_runs(spark.createDataFrame(rows, schema), reorder)
    return runs, {(r.doc_id, r.page): r.text for r in layout.page_texts(runs).collect()}


def test_form_values_stand_where_they_are_seen(spark):
    _, texts = _texts(spark, [
        (1, 1, 0, "Nome: ________ fine", 50.0, 700.0, 190.0, 11.0), (1, 1, 1, "Mario", 100.0, 701.0, 50.0, 11.0),
        (1, 1, 2, "sotto", 50.0, 680.0, 50.0, 11.0), (1, 1, 3, "a__b c_d", 110.0, 680.0, 80.0, 11.0),
        # letters under a value are never cut
        (2, 1, 0, "Nome e cognome fine", 50.0, 700.0, 190.0, 11.0), (2, 1, 1, "Mario", 100.0, 701.0, 50.0, 11.0),
        # runs without text still are lines
        (3, 1, 0, None, None, None, None, None), (3, 1, 1, "", 1.0, 1.0, 0.0, 0.0), (4, 1, 0, "solo", 1.0, 1.0, 5.0, 5.0),
    ])
    assert texts == {(1, 1): "Nome:Mario     fine\nsotto a  b c_d", (2, 1): "Nome e cognome fine\nMario", (3, 1): "\n", (4, 1): "solo"}


def test_lines_are_measured_from_their_first_run(spark):
    """Each run is 4 points lower than the one before: the third is 8 below the leader, not in its line."""
    _, texts = _texts(spark, [(1, 1, n, w, 50.0 + 40 * n, 700.0 - 4 * n, 30.0, 11.0) for n, w in enumerate(("a", "b", "c", "d"))])
    assert texts == {(1, 1): "a b\nc d"}


def test_upright_text_follows_and_order_of_the_file_can_stay(spark):
    schema = RUN + ", dx double, dy double"
    rows = [(1, 1, 0, "up", 10.0, 10.0, 20.0, 11.0, 0.0, 1.0), (1, 1, 1, "low", 50.0, 10.0, 20.0, 11.0, 1.0, 0.0), (1, 1, 2, "high", 50.0, 90.0, 20.0, 11.0, 1.0, 0.0)]
    assert _texts(spark, rows, schema)[1] == {(1, 1): "high\nlow\nup"}
    runs, texts = _texts(spark, rows, schema, reorder=False)
    assert texts == {(1, 1): "up\nlow\nhigh"}
    found = spark.createDataFrame([(1, 1, 1, 0, 1)], "doc_id long, page int, seq long, start int, end int")
    (box,) = layout.span_boxes(found, runs).first().boxes
    assert [round(v, 6) for v in box] == [-1.0, 10.0, 11.0, 10.0]  # the first half of the upright run, to its left


def test_fields_are_covered_whole(spark):
    fields = spark.createDataFrame([(1, 1, 0, "Via Roma 1\r\n\r\nMessina", 10.0, 10.0, 90.0, 30.0)], "doc_id long, page int, seg int, value string, x double, y double, w double, h double")
    runs = layout.placed_runs(layout.field_runs(fields))
    assert layout.page_texts(runs).first().text == "Via Roma 1\nMessina"
    found = spark.createDataFrame([(1, 1, 1, 4, 8, "mask")], "doc_id long, page int, seq long, start int, end int, decision string")
    boxes = layout.span_boxes(found, runs)
    assert [tuple(b) for b in boxes.first().boxes] == [(10.0, 10.0, 90.0, 30.0)]
    assert layer.clear_pieces(runs, found, boxes).count() == 0


def test_text_items(spark):
    schema = "doc_id long, page int, seg int, str string, a double, b double, d double, e double, f double, width double, height double"
    rows = [(1, 1, 0, "a", 10.0, 0.0, 10.0, 50.0, 100.0, 20.0, 0.0), (1, 1, 1, "b", 10.0, 0.0, 10.0, 50.0, 100.0, 0.0, 10.0), (1, 1, 2, "", 1.0, 0.0, 1.0, 0.0, 0.0, 5.0, 5.0)]
    (run,) = layout.text_runs(spark.createDataFrame(rows, schema)).collect()
    assert (run.x, round(run.y, 6), run.dx, run.w, round(run.h, 6)) == (50.0, 97.8, 1.0, 20.0, 11.2)


@pytest.mark.parametrize("rotation", [0, 90, 180, 270])
def test_rectangles_come_back_from_the_view(spark, rotation):
    b = geometry.box(F.lit(10.0), F.lit(20.0), F.lit(30.0), F.lit(5.0))
    view = geometry.to_view(b, F.lit(200.0), F.lit(100.0), 2.0, rotation)
    row = spark.range(1).select(view.alias("v"), geometry.to_page(view, F.lit(200.0), F.lit(100.0), 2.0, rotation).alias("b")).first()
    assert tuple(row.b) == (10.0, 20.0, 30.0, 5.0)
    assert min(row.v) >= 0 and {row.v.width, row.v.height} == {60.0, 10.0}


def test_cards_and_quality(spark):
    regions = spark.createDataFrame([(1, 1.586, 0.4, 0.9), (2, 0.63, 0.4, 0.9), (3, 1.586, 0.9, 0.9), (4, 1.0, 0.4, 0.9), (5, 1.5, 0.4, 0.5)], "id int, ratio double, width double, fill double")
    assert {r.id for r in geometry.card_shaped(regions).collect()} == {1, 2}
    grades = spark.createDataFrame([(88.0,), (87.9,), (75.0,), (74.9,), (None,)], "c double").select(scans.quality(F.col("c")).alias("q"))
    assert [r.q for r in grades.collect()] == ["good", "fair", "fair", "poor", None]


def test_pieces_are_the_text(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab .;\n") for _ in range(n)) for n in (0, 1, 1100, 1101, 4000)] + ["x" * 3000, None, "à" * 2300]
    pages = spark.createDataFrame([(i, 1, t) for i, t in enumerate(texts)], "doc_id long, page int, text string")
    for i, text in enumerate(texts):
        rows = recognizer.chunks(pages.where(F.col("doc_id") == i)).orderBy("chunk").collect()
        assert "".join(r.text for r in rows) == (text or "")
        assert all(len(r.text) <= 1100 for r in rows) and all(len(r.text) > 550 for r in rows[:-1])
        assert all((text or "")[r.offset :].startswith(r.text) for r in rows)


def test_tokens_too_far_on_are_left_out():
    text = "Anna " + "x" * 100 + " Rossi"
    tokens = [{"word": w, "entity": e, "score": s} for w, e, s in (("Anna", "B-PER", 0.5), ("Rossi", "I-PER", 1.0), (None, "O", 1.0))]
    assert recognizer._persons(text, tokens) == [(0, 4, 0.5)]
    assert recognizer._persons("ANNA rossi", tokens) == [(0, 10, 0.75)]


def test_articles_in_order(spark):
    rows = spark.createDataFrame([(k,) for k in ("15", "7bis.4", "7", "26.2", "7bis", "8")], "key string")
    assert [r.key for r in rows.orderBy(legal.article_order(F.col("key"))).collect()] == ["7", "7bis", "7bis.4", "8", "15", "26.2"]


def test_manual_requests_that_are_none(spark):
    """Blank texts, unknown categories and areas without a size make nothing; marks of patterns are plain text."""
    pages = spark.createDataFrame([(1, 1, r"a.c \E a.c abc"), (2, 1, None)], "doc_id long, page int, text string")
    asked = spark.createDataFrame([(1, 1, "a.c", "C1", ""), (1, 2, r"\E", "C1", ""), (1, 3, " ", "C1", ""), (1, 4, "abc", "XX", ""), (2, 5, "a", "C1", "")], "doc_id long, request long, text string, category string, note string")
    found = manual.found_texts(pages, asked)
    assert {(r.start, r.end, r.text) for r in found.collect()} == {(0, 3, "a.c"), (7, 10, "a.c"), (4, 6, r"\E")}
    views = spark.createDataFrame([(1, 1, 0.0, 0.0, 100.0, 100.0)], "doc_id long, page int, left double, low double, width double, height double")
    areas = [(1, 1, 1, -5.0, 0.0, 200.0, 10.0), (1, 1, 2, 0.0, 0.0, 0.0, 10.0), (1, 9, 3, 0.0, 0.0, 10.0, 10.0), (1, 1, 4, None, 0.0, 10.0, 10.0)]
    valid = manual.valid_areas(spark.createDataFrame(areas, "doc_id long, page int, request long, left double, top double, width double, height double"), views).collect()
    assert [(r.request, r.x, r.y, r.w, r.h) for r in valid] == [(1, 0.0, 90.0, 100.0, 10.0)]


def test_no_character_under_a_mask_stays(spark):
    """Masks at random: what stays is what no padded mask touches, character by character."""
    rng = random.Random(2)
    rows = [(d, 1, n, "".join(rng.choice("abc ") for _ in range(20)), 50.0, 700.0 - 14 * n, 100.0, 11.0) for d in range(8) for n in range(3)]
    runs = layout.placed_runs(spark.createDataFrame(rows, RUN), reorder=False)
    areas = [(d, 1, s, None, None, "mask", [(50 + rng.random() * 90, 660 + rng.random() * 50, rng.random() * 30, rng.random() * 20)]) for d in range(8) for s in range(2)]
    schema = f"doc_id long, page int, seq long, start int, end int, decision string, boxes array<{geometry.BOX}>"
    masks = spark.createDataFrame(areas, schema)
    got = {}
    for r in layer.clear_pieces(runs, masks.drop("boxes"), masks.select("doc_id", "page", "seq", "boxes")).collect():
        got.setdefault(r.doc_id, set()).update(range(r.start, r.end))
    for d in range(8):
        stays = set()
        for _, _, n, text, x, y, w, h in (r for r in rows if r[0] == d):
            free = []
            for i in range(20):
                under = False
                for *_, ((bx, by, bw, bh),) in (a for a in areas if a[0] == d):
                    wide = min(x + 5 * i + 5, bx + bw + 1.2) - max(x + 5 * i, bx - 1.2)
                    high = min(y + h, by + bh + 1.2) - max(y, by - 1.2)
                    under |= wide > 0.05 and high > 0.05
                free.append(not under)
            at = 0
            while at < 20:
                stop = at
                while stop < 20 and free[stop]:
                    stop += 1
                if text[at:stop].strip():
                    stays |= {n * 21 + i for i in range(at, stop)}
                at = stop + 1
        assert got.get(d, set()) == stays, d


def test_empty_tables(spark):
    empty = spark.createDataFrame([], RUN)
    runs = layout.placed_runs(empty)
    found = spark.createDataFrame([], "doc_id long, page int, seq long, start int, end int, decision string")
    boxes = layout.span_boxes(found, runs)
    assert layout.page_texts(runs).count() == boxes.count() == layer.clear_pieces(runs, found, boxes).count() == 0
    assert len(FIRST) == 10


@pytest.mark.parametrize("name", [n for n in page_queries.QUERIES if n not in SLOW])
def test_queries_agree_with_sql(spark, name):
    db = duckdb.connect()
    for table in ("orders", "customer", "documents"):
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    df = page_queries.QUERIES[name](spark, SF)
    told = db.execute(page_queries.ORACLE_SQL[name])
    columns = [d[0] for d in told.description]
    assert sorted(columns) == sorted(df.columns)
    assert sorted(map(repr, told.fetchall())) == sorted(repr(tuple(r[c] for c in columns)) for r in df.collect())


def test_plain_text_is_an_office_file_where_it_is_asked_for(spark):
    row = spark.range(1).select(files.kind(F.lit("a.txt")).alias("whole"), files.kind(F.lit("a.txt"), office=files.OFFICE_ONLY).alias("only"), files.kind(F.lit("a.odp"), office=files.OFFICE_ONLY).alias("odp")).first()
    assert tuple(row) == ("office", "other", "office")


def test_images_are_not_multiplied_by_the_columns_they_reach(spark):
    views = spark.sql("SELECT 1L AS doc_id, 1 AS page, 0D AS left, 0D AS low, 400D AS width, 400D AS height")
    images = spark.sql("SELECT 1L AS doc_id, 1 AS page, CAST(10 * id AS DOUBLE) AS x, 0D AS y, 20D AS w, 10D AS h FROM range(3)")
    made = scans.image_cover(views, images)
    assert "Generate" not in made._jdf.queryExecution().optimizedPlan().toString()
    assert [(r.cover, r.largest) for r in made.collect()] == [(4 / 1600, 200 / 160000)]
