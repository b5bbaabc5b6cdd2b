"""Queries over whole tables for pages, scans, manual findings, citations, and their SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.operators import layer, layout, legal, manual, recognizer, report, scans
from veilframe.operators.findings import constructed
from veilframe.operators.geometry import box, joined_boxes, percent_place
from veilframe.operators.names import entities_of
from veilframe.operators.redact import OMISSIS, label, outcomes
from veilframe.plans import sql
from veilframe.plans.pipeline import analysed
from veilframe.sources import cases, files, pages as p, templates as t

Query = Callable[[SparkSession, str], DataFrame]


def _orders(spark: SparkSession, sf_dir: str, **columns: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return rows.select(F.col("o_orderkey").alias("doc_id"), *[F.expr(v).alias(k) for k, v in columns.items()])


def _long(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("long") for n in names})


def read_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages from runs in two uneven columns."""
    return layout.page_texts(layout.placed_runs(p.two_columns(spark, sf_dir))).select("doc_id", "text")


START, STOP = "CAST(o_orderkey % 7 AS INT)", "CAST(o_orderkey % 7 + 1 + o_orderkey % 30 AS INT)"


def _stacked_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders(spark, sf_dir, page="1", seq="1L", start=START, end=STOP, decision="'mask'", category="'C1'").withColumn("label", label(OMISSIS))


def finding_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rectangles of spans over several lines, and where they are."""
    runs = layout.placed_runs(p.stacked(spark, sf_dir), reorder=False)
    rows = layout.with_geometry(_stacked_findings(spark, sf_dir), runs)
    rows = rows.select("doc_id", F.explode("boxes").alias("b"))
    where = percent_place(F.col("b"), F.lit(600.0), F.lit(800.0))
    return rows.select("doc_id", *[F.round(F.col(f"b.{c}")).cast("long").alias(c) for c in "xywh"], where.alias("place"))


def joined_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rectangles side by side made one."""
    side = box(F.expr("50 + 70 * i"), F.lit(700.0), F.expr("60 + 10 * ((o_orderkey + i) % 2)"), F.lit(11.0))
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", F.explode(F.expr(f"sequence(0, {p.RUNS_OF_PAGE} - 1)")).alias("i"))
    rows = rows.groupBy(F.col("o_orderkey").alias("doc_id")).agg(joined_boxes(F.collect_list(side)).alias("boxes"))
    rows = rows.select("doc_id", F.explode("boxes").alias("b"))
    return rows.select("doc_id", *[F.round(F.col(f"b.{c}")).cast("long").alias(c) for c in "xw"])


def area_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manual findings by page and per cent, with and without text in them (T8, T9, C8o, S11)."""
    runs = layout.placed_runs(p.stacked(spark, sf_dir), reorder=False)
    requests = _orders(
        spark, sf_dir, page="1", request="1L", left="CAST(25 + 2.5 * (o_orderkey % 6) AS DOUBLE)", top="CAST(29 + 1.4 * (o_orderkey % 3) AS DOUBLE)",
        width="CAST(2.5 * (1 + o_orderkey % 9) AS DOUBLE)", height="CASE WHEN o_orderkey % 10 = 9 THEN 0D ELSE 0.9D END", category="'B6'", note="''",
    )
    found, boxes = manual.found_areas(requests, p.views(spark, sf_dir, 200.0, 1000.0), runs)
    rows = found.join(boxes, ["doc_id", "page", "seq"]).withColumn("n_boxes", F.size("boxes"))
    return _long(rows.select("doc_id", "start", "end", "text", "band", "decision", "n_boxes"), "start", "end", "n_boxes")


def text_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manual findings of a text, the first of every even page taken back (J14, C8o, C9o)."""
    pages = t.payments(spark, sf_dir)
    requests = _orders(spark, sf_dir, request="1L", text="' la '", category="'C1'", note="''").unionByName(
        _orders(spark, sf_dir, request="2L", text="'  '", category="'C1'", note="''")
    )
    found = manual.found_texts(pages, requests)
    first = _orders(spark, sf_dir, page="1", seq=f"{manual.BY_TEXT + 1}L").where("doc_id % 2 = 0")
    rows = manual.removed(found, first)
    return _long(rows.select("doc_id", "start", "end", "text", "category", "band", "detector", "decision"), "start", "end")


def restored_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings restored with a reason in even pages and without one in others (C7o, P8)."""
    pages = cases.pages(spark, sf_dir, cases.SENSITIVE)
    found = analysed(pages, entities_of(pages, cases.names(spark, sf_dir)), "publish")
    why = F.when(F.col("doc_id") % 2 == 0, "atto già pubblico").otherwise(" ")
    rows = manual.restored_by(found, found.select("doc_id", "page", "seq", why.alias("rationale")))
    groups = manual.summary_groups(rows)
    return rows.join(groups, ["doc_id", "page", "seq"]).select("doc_id", "category", "decision", "modified", "rationale", "group")


def spread_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A person's first finding kept, and that decision carried to all others (C6o)."""
    pages = p.sentences(spark, sf_dir)
    rows = analysed(pages, entities_of(pages, cases.names(spark, sf_dir, p.NAME)), "publish")
    first = rows.where("start = 8").select("doc_id", "page", "seq", F.lit("x").alias("rationale"))
    rows = manual.spread_decisions(manual.restored_by(rows, first), first)
    return _long(rows.select("doc_id", "start", "text", "decision", "modified"), "start")


def page_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which pages want optical recognition."""
    runs = layout.runs_of(_orders(spark, sf_dir, page="1", seg="1", str="repeat('x', CAST(o_orderkey % 50 AS INT))", x="0D", y="0D", w="1D", h="1D"))
    rows = scans.page_routes(p.views(spark, sf_dir, 600.0, 800.0), runs, p.images(spark, sf_dir))
    return rows.select("doc_id", F.col("n_chars").cast("long").alias("n_chars"), F.round(F.col("cover") * 1600).cast("long").alias("cells"), "route", "is_scan")


def recognized_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recognized words that native runs do not have."""
    runs = layout.placed_runs(p.stacked(spark, sf_dir).where("seg % 2 = 0").withColumns({"x": F.lit(65.0), "w": F.lit(40.0)}), reorder=False)
    return scans.new_words(p.words(spark, sf_dir), runs).select("doc_id", F.col("seg").cast("long").alias("seg"))


def scan_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by their share of scanned pages, and how well those were read."""
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet")
    pages = rows.select(F.col("o_custkey").alias("doc_id"), (F.col("o_orderkey") % 7 > 1).alias("is_scan"), (60 + F.col("o_orderkey") % 41).cast("double").alias("ocr_conf"))
    return scans.document_kinds(pages).select("doc_id", "kind", "quality")


def clear_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What masks leave of the text layer: no character that a mask touches."""
    runs = layout.placed_runs(p.stacked(spark, sf_dir), reorder=False)
    found = _stacked_findings(spark, sf_dir)
    return _long(layer.clear_pieces(runs, found, layout.span_boxes(found, runs)), "start", "end").drop("page")


def mask_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masks by whether their label fits."""
    runs = layout.placed_runs(p.stacked(spark, sf_dir), reorder=False)
    found = _stacked_findings(spark, sf_dir)
    return layer.mask_modes(found, layout.span_boxes(found, runs)).select("doc_id", "mask_mode", "no_room")


def _document_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.lit(1).alias("page"), "text")
    # lines stand in their order already: no fold, and what joins by page keeps the partitions
    return layout.placed_runs(files.segments(pages), reorder=False)


def document_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents as runs of lines, read back to pages of text."""
    runs = _document_runs(spark, sf_dir)
    read = layout.page_texts(runs).select("doc_id", F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("digest"))
    return read.join(runs.groupBy("doc_id").agg(F.count("*").alias("n_runs")), "doc_id")


def _line_findings(runs: DataFrame) -> DataFrame:
    """A finding in every third run of a page: up to 8 characters from its second on, if they are
    not all blanks, which make no finding (see layout.with_geometry)."""
    own = F.substring(F.col("str"), F.lit(2), F.least(F.length("str") - 2, F.lit(8)))
    rows = runs.where("place % 3 = 1 and length(str) > 2").where(~own.rlike(layer.BLANK))
    stop = F.col("start") + F.least(F.length("str") - 1, F.lit(9))
    return rows.select("doc_id", "page", F.col("place").cast("long").alias("seq"), (F.col("start") + 1).alias("start"), stop.alias("end"), F.lit("mask").alias("decision"))


def document_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rectangles of findings in the lines of whole documents, in hundredths of a point."""
    runs = _document_runs(spark, sf_dir)
    rows = layout.span_boxes(_line_findings(runs), runs).select("doc_id", "seq", F.explode("boxes").alias("b"))
    return rows.select("doc_id", "seq", *[F.round(F.col(f"b.{c}") * 100).cast("long").alias(c) for c in "xywh"])


def document_clear_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What masks in every third line leave of whole documents."""
    runs = _document_runs(spark, sf_dir)
    found = _line_findings(runs)
    rows = layer.clear_pieces(runs, found, layout.span_boxes(found, runs))
    return _long(rows.select("doc_id", "start", "end", F.md5("text").alias("digest")), "start", "end")


def text_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents in pieces for a recognizer."""
    pages = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.lit(1).alias("page"), "text")
    rows = recognizer.chunks(pages)
    return rows.select("doc_id", F.col("offset").cast("long").alias("offset"), F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("digest"))


def token_persons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Persons from a model's tokens."""
    rows = recognizer.aligned(recognizer.chunks(p.sentences(spark, sf_dir)), p.tokens(spark, sf_dir))
    return _long(rows.select("doc_id", "start", "end", F.round(F.col("score") * 1000).alias("score")), "start", "end", "score")


#: Sources, passages in no order, and what cites them.
SOURCES = (("act", 1, "Act on transparency", "act 33", "https://example.org/act", True), ("note", 2, "Guidelines", "note 243", "https://example.org/note", False))
PASSAGES = (
    ("act", "15", 1, "art. 15"), ("act", "7bis.4", 2, "art. 7-bis, 4"), ("act", "26.2", 3, "art. 26, 2"), ("act", "7", 4, "art. 7"), ("act", "7bis", 5, "art. 7-bis"),
    ("note", "b", 1, "part b"), ("note", "a", 2, "part a"),
)
CITES = (
    ("C1", "act", "15"), ("C1", "act", "7bis.4"), ("C2", "act", "26.2"), ("C2", "act", "7"), ("B1", "note", "a"), ("B1", "note", "b"), ("B1", "act", "7bis"),
    ("publish", "act", "7bis"), ("B2", "act", "nowhere"),
)
CITING = "CASE o_orderkey % 4 WHEN 0 THEN 'C1' WHEN 1 THEN 'C2' WHEN 2 THEN 'B1' ELSE 'B2' END"


def citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages that findings and the purpose cite, in the order of the articles."""
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_custkey").alias("doc_id"), F.expr(CITING).alias("category"))
    sources = spark.createDataFrame(SOURCES, "source string, place int, title string, short string, url string, verified boolean")
    passages = spark.createDataFrame([(*x, "summary", "") for x in PASSAGES], "source string, key string, place int, ref string, kind string, text string")
    cites = spark.createDataFrame(CITES, "of string, source string, key string")
    return _long(legal.cited(rows, cites, passages, sources, "publish").select("doc_id", "nr", "title", "verified", "ref"), "nr")


def panel_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of three bands in the order of a panel."""
    rows = _orders(spark, sf_dir, band="CASE o_orderkey % 4 WHEN 0 THEN 'A' WHEN 1 THEN 'B' WHEN 2 THEN 'C' ELSE 'P' END", seq="o_orderkey", start="CAST(o_orderkey % 100 AS INT)", doc="o_custkey")
    rows = rows.select(F.col("doc").alias("doc_id"), F.lit(1).alias("page"), "band", "seq", "start")
    return _long(manual.panel(rows, ("C", "A", "P")).select("doc_id", "band", "seq", "nr"), "nr")


def signature_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Small images low on native pages, which may be signatures."""
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("doc_id"), F.lit(1).alias("page"))
    pages = rows.select("*", F.lit("testo della pagina").alias("text"), (F.col("doc_id") % 5 == 0).alias("is_scan"), F.lit(90.0).alias("ocr_conf"))
    sides = {"x": "50D", "y": "CAST(650 + doc_id % 40 AS DOUBLE)", "w": "CAST(30 + doc_id % 30 AS DOUBLE)", "h": "CAST(8 + doc_id % 17 AS DOUBLE)"}
    first = rows.withColumns({k: F.expr(v) for k, v in sides.items()})
    second = rows.where("doc_id % 2 = 0").withColumns({k: F.lit(v) for k, v in zip("xywh", (300.0, 100.0, 90.0, 30.0))})
    large = rows.where("doc_id % 3 = 0").withColumns({k: F.lit(v) for k, v in zip("xywh", (0.0, 0.0, 600.0, 400.0))})
    images = first.unionByName(second).unionByName(large).withColumns({"page_width": F.lit(600.0), "page_height": F.lit(800.0)})
    found = analysed(pages, purpose="publish", images=images).where("detector = 'image'")
    return found.select("doc_id", "text", "category", "decision")


NOTES = "repeat('nota ', CAST(o_orderkey % 60 AS INT))"


def findings_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report's table of all findings: places, kinds, outcomes, notes cut short."""
    runs = layout.placed_runs(p.stacked(spark, sf_dir), reorder=False)
    rows = _orders(
        spark, sf_dir, page="1", start=START, end=STOP, text="'x'", category="CASE o_orderkey % 3 WHEN 0 THEN 'B1' WHEN 1 THEN 'A1' ELSE 'P' END",
        detector="CASE o_orderkey % 3 WHEN 0 THEN 'tax-code' WHEN 1 THEN 'health' ELSE 'role' END", note=NOTES, seq="1L",
        origin="CASE WHEN o_orderkey % 2 = 0 THEN 'manual' ELSE 'automatic' END",
    )
    found = constructed(rows).withColumn("rationale", F.when(F.col("doc_id") % 5 == 0, "atto pubblico").otherwise(""))
    views = p.views(spark, sf_dir, 600.0, 800.0)
    made = report.table(found, layout.span_boxes(found, runs), views, outcomes(found))
    return _long(made.drop("page"), "nr")


def file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of files and the names of what is made of them, plain text being no office file here."""
    ends = ("PDF", "jpeg", "pdf.p7m", "docx", "png", "txt")
    path = F.concat(F.lit("a/b c/atto."), F.col("c_custkey").cast("string"), F.lit("."), F.expr(t.pick(ends, f"c_custkey % {len(ends)}")))
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("id"), path.alias("path"))
    return rows.select("id", files.kind(F.col("path"), office=files.OFFICE_ONLY).alias("kind"), files.output_names(F.col("path"))["document"].alias("document"))


def sql_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings and redacted pages as views for SQL."""
    cases.pages(spark, sf_dir, cases.CONTACTS).createOrReplaceTempView("contact_pages")
    sql.register(spark, "contact_pages", "publish", prefix="contact_")
    return spark.sql(
        "SELECT p.doc_id, count(f.doc_id) AS n_masked, first(p.redacted_text) AS redacted_text FROM contact_redacted p "
        "LEFT JOIN (SELECT * FROM contact_findings WHERE decision = 'mask') f ON p.doc_id = f.doc_id AND p.page = f.page GROUP BY p.doc_id"
    )


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        read_pages, finding_boxes, joined_areas, area_findings, text_findings, restored_findings, spread_decisions, page_routes, recognized_words,
        scan_kinds, clear_text, mask_labels, document_pages, document_boxes, document_clear_text, text_chunks, token_persons, citations, panel_order, sql_views, signature_images,
        findings_table, file_names,
    )
}

# ---- SQL -----------------------------------------------------------------------------------


def _duck(expr: str) -> str:
    return expr.replace(" DIV ", " // ").replace("STRING", "VARCHAR")


_RUNS = f"runs AS (SELECT o_orderkey, CAST(i AS INT) AS i FROM orders, unnest(range({p.RUNS_OF_PAGE})) AS u(i))"
_SPANS = f"""{_RUNS},
spans AS (SELECT o_orderkey, i, greatest({START}, 12 * i) - 12 * i AS a, least({STOP}, 12 * i + 11) - 12 * i AS b FROM runs)"""
_MASKED = "(SELECT o_orderkey, i, a, b, 5.0 * (b - a) AS w FROM spans WHERE a < b)"
_IMG = {k: f"({v})" for k, v in p.IMAGE.items()}
_SENSITIVE = f"c_custkey % {len(cases.SENSITIVE)}"


def _values(rows: tuple) -> str:
    return ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in r) + ")" for r in rows)


def _chunk_sql(size: int = recognizer.SIZE) -> str:
    """One piece after the other, by the places of the marks in the second half."""
    half = size // 2

    def last(mark: str) -> str:
        # characters are turned round one by one: reverse() keeps those that combine together
        back = "list_aggregate(list_reverse(string_split(win, '')), 'string_agg', '')"
        turned = mark[::-1].replace("\n", "' || chr(10) || '")
        return f"CASE WHEN instr({back}, '{turned}') > 0 THEN length(win) - instr({back}, '{turned}') - {len(mark) - 1} END"

    return f"""
WITH RECURSIVE steps AS (
  SELECT doc_id, CAST(0 AS BIGINT) AS a, CAST(NULL AS BIGINT) AS b, text FROM documents WHERE length(coalesce(text, '')) > 0
  UNION ALL
  SELECT doc_id, b, NULL, text FROM (
    SELECT doc_id, text, CASE WHEN length(text) - a > {size} THEN
      coalesce(a + {half} + 1 + greatest({last(chr(10))}, {last('. ')}, {last('; ')}), a + {half} + 1 + {last(' ')}, a + {size}) ELSE length(text) END AS b
    FROM (SELECT doc_id, a, text, substr(text, a + {half} + 1, {size - half}) AS win FROM steps WHERE a < length(text)))),
cuts AS (SELECT doc_id, a, coalesce(lead(a) OVER (PARTITION BY doc_id ORDER BY a), length(text)) AS b, text FROM steps)
SELECT doc_id, a AS "offset", CAST(b - a AS BIGINT) AS n_chars, md5(substr(text, a + 1, b - a)) AS digest FROM cuts WHERE a < length(text)"""


_SORTED = {k: n for n, k in enumerate(("7", "7bis", "7bis.4", "15", "26.2"))}
_PLACED = ", ".join(f"('{s}', '{k}', {1 if s == 'act' else 2}, {_SORTED.get(k, place)}, '{ref}')" for s, k, place, ref in PASSAGES)
_CONTACT_TEXT = {
    i: "CASE " + " ".join(f"WHEN c_custkey % {len(cases.CONTACTS)} = {n} THEN " + (c[1] if i == 1 else "'" + c[i] + "'") for n, c in enumerate(cases.CONTACTS)) + " END"
    for i in range(3)
}
_IS_MASKED = f"c_custkey % {len(cases.CONTACTS)} IN ({', '.join(str(n) for n, c in enumerate(cases.CONTACTS) if c[5] == 'mask')})"

_BLANK = "regexp_full_match(s, '[\\x{09}-\\x{0D}\\x{20}\\x{A0}\\x{2028}\\x{2029}\\x{FEFF}]*')"
#: Runs of documents: place, str, n characters, w, y, and start of each run in its page's text.
_LINES = f"""lines AS (SELECT doc_id, CAST(i AS BIGINT) AS i, l[i + 1] AS s, len(l) AS n FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents), unnest(range(len(l))) AS u(i)),
shown AS (SELECT doc_id, i, s || repeat(chr(10), CAST(coalesce(lead(i) OVER d, n) - i - 1 AS BIGINT)) AS str, greatest(1.0, 5.5 * length(s)) AS w, 700 - 14 * i AS y
  FROM lines WHERE NOT {_BLANK} WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
runs AS (SELECT *, row_number() OVER d - 1 AS place, length(str) AS n, CAST(sum(length(str) + 1) OVER d AS BIGINT) - length(str) - 1 AS start
  FROM shown WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
found AS (SELECT *, 1 AS a, least(n - 1, 9) AS b FROM runs WHERE place % 3 = 1 AND n > 2 AND trim(substr(str, 2, least(n - 2, 8))) <> '')"""

ORACLE_SQL: dict[str, str] = {
    "document_pages": f"""
WITH {_LINES}, t AS (SELECT doc_id, count(*) AS n_runs, string_agg(str, chr(10) ORDER BY place) AS text FROM runs GROUP BY doc_id),
-- an underscore stays between letters or digits only
u AS (SELECT doc_id, n_runs, regexp_replace(regexp_replace(text, '(^|[^\\p{{L}}\\p{{N}}])_', '\\1 ', 'g'), '_([^\\p{{L}}\\p{{N}}]|$)', ' \\1', 'g') AS text FROM t)
SELECT doc_id, n_runs, length(text) AS n_chars, md5(text) AS digest FROM u""",
    "document_boxes": f"""
WITH {_LINES} SELECT doc_id, place AS seq, CAST(round(100 * (50 + w * a / n)) AS BIGINT) AS x, CAST(100 * y AS BIGINT) AS y,
  CAST(round(100 * (w * (b - a) / n)) AS BIGINT) AS w, CAST(1100 AS BIGINT) AS h FROM found""",
    "document_clear_text": f"""
WITH {_LINES},
-- the mask is 1.2 points wider on both sides; a character goes that it touches by more than 0.05
cut AS (SELECT r.doc_id, r.start, r.str, r.n, f.a - CAST(ceil(1.15 * r.n / r.w) AS BIGINT) AS a, f.b + CAST(ceil(1.15 * r.n / r.w) AS BIGINT) AS b
  FROM runs r LEFT JOIN found f USING (doc_id, place)),
pieces AS (SELECT doc_id, start, str, unnest(CASE WHEN a IS NULL THEN [[0, n]] ELSE [[0, greatest(a, 0)], [least(b, n), n]] END) AS g FROM cut)
SELECT doc_id, start + g[1] AS start, start + g[2] AS "end", md5(substr(str, g[1] + 1, g[2] - g[1])) AS digest FROM pieces
WHERE trim(substr(str, g[1] + 1, g[2] - g[1])) <> ''""",
    "read_pages": f"""
WITH {_RUNS}, shown AS (SELECT o_orderkey, i, CASE WHEN i = 0 THEN '' WHEN i % 2 = 0 THEN chr(10) WHEN o_orderkey % 2 = 0 THEN ' ' ELSE '' END
  || 'voce ' || i || CASE WHEN (o_orderkey + i) % 2 = 0 THEN '     ' ELSE ' a_bc' END AS part FROM runs)
SELECT o_orderkey AS doc_id, string_agg(part, '' ORDER BY i) AS text FROM shown GROUP BY o_orderkey""",
    "finding_boxes": f"""
WITH {_SPANS} SELECT o_orderkey AS doc_id, CAST(50 + 5 * a AS BIGINT) AS x, CAST(700 - 14 * i AS BIGINT) AS y, CAST(5 * (b - a) AS BIGINT) AS w, CAST(11 AS BIGINT) AS h,
  CAST(floor((50.0 + 5 * a) / 600 * 100 + 0.5) AS INT) || '% / ' || CAST(floor((800.0 - 711 + 14 * i) / 800 * 100 + 0.5) AS INT) || '%' AS place
FROM spans WHERE a < b""",
    "joined_areas": f"""
WITH {_RUNS}, marked AS (SELECT o_orderkey, i, 60 + 10 * ((o_orderkey + i) % 2) AS w, CASE WHEN (o_orderkey + i) % 2 = 0 THEN 1 ELSE 0 END AS fresh FROM runs),
grouped AS (SELECT *, sum(CASE WHEN i > 0 AND (o_orderkey + i - 1) % 2 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY o_orderkey ORDER BY i) AS g FROM marked)
SELECT o_orderkey AS doc_id, CAST(min(50 + 70 * i) AS BIGINT) AS x, CAST(max(50 + 70 * i + w) - min(50 + 70 * i) AS BIGINT) AS w FROM grouped GROUP BY o_orderkey, g""",
    "area_findings": f"""
WITH r AS (SELECT o_orderkey AS doc_id, o_orderkey % 3 AS j, o_orderkey % 6 AS k, least(o_orderkey % 6 + 1 + o_orderkey % 9, 11) AS z, {p.RUNS_OF_PAGE} AS n
  FROM orders WHERE o_orderkey % 10 <> 9)
SELECT doc_id, CAST(CASE WHEN j < n THEN 12 * j + k END AS BIGINT) AS start, CAST(CASE WHEN j < n THEN 12 * j + z END AS BIGINT) AS "end",
  CASE WHEN j < n THEN substr('abcdefghijk', k + 1, z - k) ELSE '' END AS text, 'M' AS band, 'mask' AS decision,
  CAST(CASE WHEN j < n THEN 2 ELSE 1 END AS BIGINT) AS n_boxes FROM r""",
    "text_findings": f"""
WITH pages AS (SELECT o_orderkey AS doc_id, concat('Si liquida a favore di ', {t.NAME.replace(" DIV ", " // ")}, ' la somma di euro ', {t.AMOUNT}, '.') AS text FROM orders),
hits AS (SELECT doc_id, i AS start, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS n FROM pages, unnest(range(length(text))) AS u(i) WHERE substr(text, i + 1, 2) = 'la')
SELECT doc_id, CAST(start AS BIGINT) AS start, CAST(start + 2 AS BIGINT) AS "end", 'la' AS text, 'C1' AS category, 'M' AS band, 'manual-text' AS detector, 'mask' AS decision
FROM hits WHERE n > 1 OR doc_id % 2 = 1""",
    "restored_findings": f"""
WITH f AS (SELECT doc_id, category, category IN ('A1', 'A2', 'A3', 'A4') AS strict FROM ({cases.expected(cases.SENSITIVE, names_too=True)}))
SELECT doc_id, category, CASE WHEN strict AND doc_id % 2 = 1 THEN 'mask' ELSE 'keep' END AS decision, NOT (strict AND doc_id % 2 = 1) AS modified,
  CASE WHEN strict AND doc_id % 2 = 0 THEN 'atto già pubblico' ELSE '' END AS rationale, CASE WHEN strict AND doc_id % 2 = 1 THEN 'masked' ELSE 'restored' END AS "group" FROM f""",
    "spread_decisions": f"""
WITH n AS (SELECT c_custkey AS doc_id, {p.NAME} AS text FROM customer)
SELECT doc_id, CAST(s AS BIGINT) AS start, text, 'keep' AS decision, true AS modified FROM (SELECT doc_id, text, unnest([8, 10 + length(text)]) AS s FROM n)""",
    "page_routes": f"""
WITH {_RUNS}, img AS (SELECT o_orderkey, i, {_IMG['cx']} AS cx, {_IMG['cy']} AS cy, {_IMG['cw']} AS cw, {_IMG['ch']} AS ch FROM runs WHERE i > 0),
cells AS (SELECT o_orderkey, count(DISTINCT a * 100 + b) AS cells FROM img, unnest(range(cx, least(cx + cw, 40))) AS u(a), unnest(range(cy, least(cy + ch, 40))) AS v(b) GROUP BY 1),
large AS (SELECT o_orderkey, max((least(cx + cw, 40) - cx) * (least(cy + ch, 40) - cy)) / 1600.0 AS largest FROM img GROUP BY 1),
f AS (SELECT o.o_orderkey AS doc_id, o.o_orderkey % 50 AS n_chars, coalesce(cells, 0) AS cells, coalesce(largest, 0) AS largest FROM orders o
  LEFT JOIN cells c ON c.o_orderkey = o.o_orderkey LEFT JOIN large l ON l.o_orderkey = o.o_orderkey),
r AS (SELECT *, CASE WHEN cells >= 1280 THEN 'raster' WHEN n_chars < 25 THEN 'text_free' WHEN largest > 0.25 THEN 'mixed' ELSE 'native' END AS route FROM f)
SELECT doc_id, CAST(n_chars AS BIGINT) AS n_chars, CAST(cells AS BIGINT) AS cells, route, route <> 'native' AS is_scan FROM r""",
    "recognized_words": f"WITH {_RUNS} SELECT o_orderkey AS doc_id, CAST(i AS BIGINT) AS seg FROM runs WHERE i % 2 = 1 OR (o_orderkey * 7 + i * 11) % 60 >= 20",
    "scan_kinds": """
WITH f AS (SELECT o_custkey AS doc_id, count(*) AS n, count(*) FILTER (o_orderkey % 7 > 1) AS s, avg(60 + o_orderkey % 41) FILTER (o_orderkey % 7 > 1) AS c FROM orders GROUP BY 1)
SELECT doc_id, CASE WHEN s = 0 THEN 'native' WHEN s = n THEN 'scan' ELSE 'mixed' END AS kind,
  CASE WHEN c >= 88 THEN 'good' WHEN c >= 75 THEN 'fair' WHEN c IS NOT NULL THEN 'poor' END AS quality FROM f""",
    "clear_text": f"""
WITH {_SPANS}, pieces AS (
  SELECT o_orderkey, i, unnest(CASE WHEN a < b THEN [[0, greatest(a - 1, 0)], [least(b + 1, 11), 11]] ELSE [[0, 11]] END) AS g FROM spans)
SELECT o_orderkey AS doc_id, CAST(12 * i + g[1] AS BIGINT) AS start, CAST(12 * i + g[2] AS BIGINT) AS "end", substr('abcdefghijk', g[1] + 1, g[2] - g[1]) AS text
FROM pieces WHERE g[1] < g[2]""",
    "mask_labels": f"""
WITH {_SPANS}, widest AS (SELECT o_orderkey, max(w) AS w FROM {_MASKED} GROUP BY o_orderkey)
-- 13.4 points high: letters from 8.308 points, after six steps 4.415
SELECT o_orderkey AS doc_id, CASE WHEN 0.5 * 9 * 8.308 * 0.9 ^ 6 <= w + 0.4 THEN 'omissis' ELSE 'full' END AS mask_mode,
  NOT (0.5 * 9 * 8.308 * 0.9 ^ 6 <= w + 0.4) AS no_room FROM widest""",
    "text_chunks": _chunk_sql(),
    "token_persons": f"""
WITH n AS (SELECT c_custkey AS doc_id, length({p.NAME}) AS n, CASE WHEN c_custkey % 3 = 0 THEN 825 ELSE 750 END AS score FROM customer)
SELECT doc_id, CAST(s AS BIGINT) AS start, CAST(s + n AS BIGINT) AS "end", CAST(score AS BIGINT) AS score FROM (SELECT *, unnest([8, 10 + n]) AS s FROM n)""",
    "citations": f"""
WITH cites(of_, source, key) AS (VALUES {_values(CITES)}), passages(source, key, sp, place, ref) AS (VALUES {_PLACED}),
sources(source, place, title, short, url, verified) AS (VALUES {_values(SOURCES)}),
used AS (SELECT DISTINCT o_custkey AS doc_id, {CITING} AS of_ FROM orders UNION SELECT DISTINCT o_custkey, 'publish' FROM orders),
found AS (SELECT DISTINCT doc_id, source, key FROM used JOIN cites USING (of_))
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY p.sp, p.place) AS nr, s.title, s.verified, p.ref
FROM found f JOIN passages p ON p.source = f.source AND p.key = f.key JOIN sources s ON s.source = f.source""",
    "panel_order": """
WITH f AS (SELECT o_custkey AS doc_id, ['A', 'B', 'C', 'P'][o_orderkey % 4 + 1] AS band, o_orderkey AS seq, o_orderkey % 100 AS start FROM orders)
SELECT doc_id, band, seq, row_number() OVER (PARTITION BY doc_id ORDER BY CASE band WHEN 'C' THEN 1 WHEN 'A' THEN 2 ELSE 3 END, start, seq) AS nr FROM f WHERE band <> 'B'""",
    "sql_views": f"""
SELECT c_custkey AS doc_id, CAST(CASE WHEN {_IS_MASKED} THEN 1 ELSE 0 END AS BIGINT) AS n_masked,
  concat({_CONTACT_TEXT[0]}, CASE WHEN {_IS_MASKED} THEN '[OMISSIS]' ELSE {_CONTACT_TEXT[1]} END, {_CONTACT_TEXT[2]}) AS redacted_text FROM customer""",
    "signature_images": """
WITH i AS (SELECT c_custkey AS k, 650 + c_custkey % 40 AS y, 30 + c_custkey % 30 AS w, 8 + c_custkey % 17 AS h FROM customer
  UNION ALL SELECT c_custkey, 100, 90, 30 FROM customer WHERE c_custkey % 2 = 0)
SELECT k AS doc_id, 'Image ' || w || 'x' || h AS text, 'B6' AS category, 'mask' AS decision FROM i WHERE w >= 40 AND h >= 12 AND y + h <= 680 AND k % 5 <> 0""",
    "findings_table": f"""
WITH {_SPANS}, f AS (SELECT o_orderkey AS k, o_orderkey % 3 AS c, o_orderkey % 2 = 0 AS by_hand, {NOTES} AS note, o_orderkey % 5 = 0 AS why FROM orders),
placed AS (SELECT o_orderkey AS k, min(i) AS i, min_by(a, i) AS a FROM spans WHERE a < b GROUP BY 1),
n AS (SELECT *, concat_ws('; ', CASE WHEN by_hand AND note <> '' THEN note END, CASE WHEN why THEN 'reason: atto pubblico' END) AS told FROM f)
SELECT n.k AS doc_id, CAST(1 AS BIGINT) AS nr,
  CAST(floor((50.0 + 5 * a) / 600 * 100 + 0.5) AS INT) || '% / ' || CAST(floor((800.0 - 711 + 14 * i) / 800 * 100 + 0.5) AS INT) || '%' AS place,
  ['B1', 'A1', 'P'][c + 1] || CASE WHEN by_hand THEN ' (manual)' ELSE '' END AS kind,
  CASE WHEN by_hand THEN 'manual' WHEN c = 0 THEN 'formal' ELSE 'statistical' END AS certainty, ['B', 'A', 'P'][c + 1] AS band,
  CASE WHEN c = 2 THEN 'clear' ELSE 'masked' END AS outcome, false AS modified,
  CASE WHEN length(told) > 220 THEN substr(told, 1, 217) || '…' ELSE told END AS note FROM n JOIN placed USING (k)""",
    "file_names": """
SELECT c_custkey AS id, ['pdf', 'image', 'signed', 'office', 'image', 'other'][c_custkey % 6 + 1] AS kind,
  'atto.' || c_custkey || ['', '', '', '.docx', '', '.txt'][c_custkey % 6 + 1] || '_redacted.pdf' AS document FROM customer""",
}
