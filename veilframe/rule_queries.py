"""Queries over SQL functions, users' rules, drawing operators, rectangles, files and reports, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe import queries as q
from veilframe.operators.decide import decided
from veilframe.operators.findings import constructed
from veilframe.operators.images import image_boxes
from veilframe.operators.layout import page_texts, placed_runs
from veilframe.operators.legal import citation_counts
from veilframe.operators.names import name_findings
from veilframe.operators.redact import box_outcomes
from veilframe.operators.rendered import RULES_VERSION, STATEMENT, Settings, rendered
from veilframe.operators.report import pseudonyms, restored
from veilframe.operators.scans import page_routes
from veilframe.operators.subjects import numbered
from veilframe.page_queries import CITES, CITING, _values
from veilframe.plans.pipeline import analysed
from veilframe.plans.sql import register_functions
from veilframe.plans.staging import staged
from veilframe.rules import user
from veilframe.rules.tables import CERTAINTY
from veilframe.sources import cases
from veilframe.sources.files import opened

# ---- SQL functions


def sql_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contacts by the table function in a lateral join, each place once (2.13, D10-D14)."""
    register_functions(spark)
    cases.pages(spark, sf_dir, cases.CONTACTS).createOrReplaceTempView("contact_pages")
    return spark.sql("""
SELECT DISTINCT p.doc_id, CAST(s.start AS BIGINT) AS start, CAST(s.end AS BIGINT) AS end, s.text, s.category
FROM contact_pages p, LATERAL detect_spans(p.text) s""")


def document_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of all detectors in whole documents, by the table function (2.13, D1-D28)."""
    register_functions(spark)
    spark.read.parquet(f"{sf_dir}/documents.parquet").createOrReplaceTempView("span_documents")
    return spark.sql("SELECT d.doc_id, s.start, s.end, s.category, s.detector FROM span_documents d, LATERAL detect_spans(d.text) s")


def sql_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' made numbers by the registered checks (2.13, V1, V2, V4)."""
    register_functions(spark)
    for name in ("iban_checks", "tax_code_checks", "vat_checks"):
        q.QUERIES[name](spark, sf_dir).createOrReplaceTempView(name)
    return spark.sql("""
SELECT id, is_iban(i.code) AS iban, is_tax_code(t.code) AS tax_code, is_vat_number(v.code) AS vat_number
FROM iban_checks i JOIN tax_code_checks t USING (id) JOIN vat_checks v USING (id)""")


# ---- users' rules


def custom_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A detector, words of a context and a purpose that users add as tables (2.13, J2, J9, G8)."""
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet")
    key, name = F.col("c_custkey").cast("string"), F.expr(cases.NAME)
    text = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("Pratica FASC-"), key, F.lit(" in archivio.")))
    text = text.otherwise(F.concat(F.lit("Il tutelato "), name, F.lit(" abita qui.")))
    pages = rows.select(F.col("c_custkey").alias("doc_id"), F.lit(1).alias("page"), text.alias("text"))
    names = rows.select(F.col("c_custkey").alias("doc_id"), F.lit(1).alias("page"), F.lit(12).alias("start"), (F.lit(12) + F.length(name)).alias("end"), F.lit(0.9).alias("score"))
    added = spark.sql("SELECT 'file-number' AS name, 'C6' AS category, 'FASC-[0-9]+' AS pattern, true AS words")
    words = spark.sql("SELECT 'minor' AS kind, 'tutelat[oa]' AS pattern, 30 AS radius")
    purposes = spark.sql("SELECT 'archive' AS purpose, 'C6' AS proposal_key, 'keep' AS decision, 'file numbers stay' AS reason")
    found = analysed(pages, names.where("doc_id % 2 = 1"), "archive", user.detectors(added), purposes=purposes, kinds=user.kinds(words))
    return found.select("doc_id", F.col("start").cast("long").alias("start"), "text", "category", "detector", "decision", "reason", "proposed_by")


CUSTOM_RULES = f"""
SELECT c_custkey AS doc_id, CAST(8 AS BIGINT) AS start, 'FASC-' || c_custkey AS text, 'C6' AS category, 'file-number' AS detector,
  'keep' AS decision, 'file numbers stay' AS reason, 'archive' AS proposed_by FROM customer WHERE c_custkey % 2 = 0
UNION ALL SELECT c_custkey, 12, {cases.NAME}, 'B8', 'recognizer', 'mask', '', NULL FROM customer WHERE c_custkey % 2 = 1"""

# ---- drawing operators: per order an image scaled, one turned, one in a form, one of the plain square

#: Numbers of an order's page, as SQL for both.
DRAWN = {"sx": "40 + o_orderkey % 60", "sy": "20 + o_orderkey % 30", "tx": "o_orderkey % 700", "ty": "o_orderkey % 780", "k": "o_orderkey % 7"}


def _drawing(spark: SparkSession, sf_dir: str) -> DataFrame:
    sx, sy, tx, ty, k = (f"CAST({v} AS DOUBLE)" for v in DRAWN.values())
    none = "CAST(NULL AS ARRAY<DOUBLE>)"
    ops = [
        ("save", none), ("transform", f"array(2D, 0D, 0D, 2D, {tx}, {ty})"), ("save", none), ("transform", f"array({sx}, 0D, 0D, {sy}, 10D, 5D)"),
        ("image", none), ("restore", none), ("transform", f"array(0D, {sy}, -({sx}), 0D, {sx}, 0D)"), ("image", none), ("restore", none),
        ("form", f"array(1D, 0D, 0D, 1D, {k}, 0D)"), ("transform", f"array({sx}, 0D, 0D, {sy}, 0D, 0D)"), ("image", none), ("form_end", none),
        ("image", none), ("restore", none),
    ]
    all_of = "array(" + ", ".join(f"named_struct('op', '{o}', 'm', {m})" for o, m in ops) + ")"
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("doc_id"), F.lit(1).alias("page"), F.posexplode(F.expr(all_of)).alias("seq", "o"))
    return rows.select("doc_id", "page", "seq", "o.op", "o.m")


def _views(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(
        F.col("o_orderkey").alias("doc_id"), F.lit(1).alias("page"), F.lit(0.0).alias("left"), F.lit(0.0).alias("low"), F.lit(600.0).alias("width"), F.lit(800.0).alias("height")
    )


def image_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images where the drawing state puts them, cut by the page."""
    rows = image_boxes(_drawing(spark, sf_dir), _views(spark, sf_dir))
    return rows.select("doc_id", F.col("seq").cast("long").alias("seq"), "x", "y", "w", "h", F.round("share", 9).alias("share"))


def drawn_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages' routes by the images of their drawing operators."""
    views = _views(spark, sf_dir)
    runs = views.where("doc_id % 3 > 0").select("doc_id", "page", F.lit("una riga di testo abbastanza lunga").alias("str"))
    rows = page_routes(views, runs, image_boxes(_drawing(spark, sf_dir), views))
    return rows.groupBy("route", "is_scan").agg(F.count("*").alias("n"))


_DRAWN = ", ".join(f"CAST({v} AS DOUBLE) AS {k}" for k, v in DRAWN.items())
_PLACES = f"""
d AS (SELECT o_orderkey AS doc_id, {_DRAWN} FROM orders),
r AS (SELECT doc_id, 4 AS seq, tx + 20 AS x0, ty + 10 AS y0, tx + 20 + 2 * sx AS x1, ty + 10 + 2 * sy AS y1 FROM d
  UNION ALL SELECT doc_id, 7, tx, ty, tx + 2 * sx, ty + 2 * sy FROM d UNION ALL SELECT doc_id, 11, k, 0, k + sx, sy FROM d UNION ALL SELECT doc_id, 13, 0, 0, 1, 1 FROM d),
b AS (SELECT doc_id, CAST(seq AS BIGINT) AS seq, x0 AS x, y0 AS y, least(x1, 600.0::DOUBLE) - x0 AS w, least(y1, 800.0::DOUBLE) - y0 AS h FROM r)"""
IMAGE_PLACES = f"WITH {_PLACES} SELECT doc_id, seq, x, y, w, h, round(w * h / 480000, 9) AS share FROM b WHERE w > 0 AND h > 0"
# no four such images cover 0.8 of a page, and none a quarter of it
DRAWN_ROUTES = """
SELECT route, route <> 'native' AS is_scan, count(*) AS n FROM (SELECT CASE WHEN o_orderkey % 3 = 0 THEN 'text_free' ELSE 'native' END AS route FROM orders) GROUP BY ALL"""

# ---- rectangles


def covered_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings in the clear under the drawn mask of another, by rectangles."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    k = F.col("o_orderkey")
    each = F.explode(F.array(*[F.struct(F.lit(s).alias("seq"), F.lit(d).alias("decision")) for s, d in ((1, "keep"), (2, "mask"), (3, None))])).alias("f")
    found = orders.select(k.alias("doc_id"), F.lit(1).alias("page"), each).select("doc_id", "page", "f.seq", "f.decision", F.when((F.col("f.seq") == 2) & (F.col("doc_id") % 11 == 0), "drop").otherwise("mask").alias("action"))
    places = [(1, F.lit(50.0), F.lit(700.0), F.lit(55.0), F.lit(11.0)), (1, F.lit(50.0), F.lit(686.0), F.lit(2.0), F.lit(11.0)),
              (2, 50.0 + (k % 60), 690.0 + (k % 23), F.lit(30.0), F.lit(6.0)), (3, F.lit(400.0), F.lit(100.0), F.lit(20.0), F.lit(11.0))]
    boxes = F.explode(F.array(*[F.struct(F.lit(s).alias("seq"), *[v.cast("double").alias(n) for v, n in zip(p, "xywh", strict=True)]) for s, *p in places])).alias("b")
    rectangles = orders.select(k.alias("doc_id"), F.lit(1).alias("page"), boxes).select("doc_id", "page", "b.*")
    return box_outcomes(found, rectangles).select("doc_id", F.col("seq").cast("long").alias("seq"), "outcome", "covered", "note")


COVERED_AREAS = """
WITH o AS (SELECT o_orderkey AS doc_id, o_orderkey % 11 = 0 AS gone, 50.0 + o_orderkey % 60 - 1.2 AS mx, 690.0 + o_orderkey % 23 - 1.2 AS my FROM orders),
t(x, y, w, h) AS (VALUES (50.0, 700.0, 55.0, 11.0), (50.0, 686.0, 2.0, 11.0)),
over_ AS (SELECT DISTINCT doc_id FROM o, t WHERE NOT gone
  AND least(x + w, mx + 32.4) - greatest(x, mx) > least(1.5, w / 2) AND least(y + h, my + 8.4) - greatest(y, my) > least(1.5, h * 0.3)),
f AS (SELECT doc_id, seq, CASE WHEN gone THEN 'dropped' WHEN seq = 2 THEN 'masked' ELSE 'clear' END AS outcome,
  seq = 1 AND doc_id IN (SELECT doc_id FROM over_) AS covered FROM o, (VALUES (1), (2), (3)) AS s(seq))
SELECT doc_id, CAST(seq AS BIGINT) AS seq, outcome, covered,
  CASE WHEN covered THEN 'covered, in whole or in part, by another mask' WHEN outcome = 'dropped' THEN 'page dropped' ELSE '' END AS note FROM f"""

# ---- files: envelopes around documents' texts


def _value(tag: str, body: str) -> str:
    """SQL for the hex digits of a value with four bytes of length."""
    return f"concat('{tag}84', lpad(hex(length({body}) DIV 2), 8, '0'), {body})"


def signed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files made of documents: plain, in a signed envelope, a detached one, a broken one, an
    image, an office file, and what is none; opened again (S1, S3, S4)."""
    text = "hex(encode(concat('%PDF-1.4\n', coalesce(text, '')), 'UTF-8'))"
    octets = _value("A0", _value("04", text))
    content = _value("30", f"concat('06092A864886F70D010701', {octets})")

    def signed(inner: str) -> str:
        return _value("30", "concat('06092A864886F70D010702', " + _value("A0", _value("30", f"concat('0201013100', {inner})")) + ")")

    detached = signed(_value("30", "'06092A864886F70D010701'"))
    png = "concat('89504E470D0A1A0A0000000D49484452', lpad(hex(1 + doc_id % 50), 8, '0'), lpad(hex(1 + doc_id % 70), 8, '0'))"
    digits = f"CASE doc_id % 7 WHEN 0 THEN {text} WHEN 1 THEN {signed(content)} WHEN 2 THEN {detached} WHEN 3 THEN substr({signed(content)}, 1, 60) WHEN 4 THEN {png} ELSE {text} END"
    ending = "element_at(array('.pdf', '.pdf.p7m', '.PDF.P7M', '.p7m', '.png', '', '.bin'), CAST(doc_id % 7 + 1 AS INT))"
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select(
        "doc_id", F.expr(f"concat('/in/atto', doc_id, {ending})").alias("path"), F.expr(f"unhex({digits})").alias("content"),
        F.when(F.col("doc_id") % 7 == 5, "application/vnd.oasis.opendocument.text").alias("mime"),
    )
    made = opened(rows, "mime")
    sha = F.when(F.col("found") == "pdf", F.sha2("document", 256))
    return made.select("doc_id", "kind", "found", "error", sha.alias("sha256"), F.round("page_width", 6).alias("page_width"), F.round("page_height", 6).alias("page_height"))


SIGNED_DOCUMENTS = """
WITH d AS (SELECT doc_id, doc_id % 7 AS k, 1 + doc_id % 50 AS w, 1 + doc_id % 70 AS h, sha256('%PDF-1.4' || chr(10) || coalesce(text, '')) AS sha FROM documents)
SELECT doc_id, ['pdf', 'signed', 'signed', 'signed', 'image', 'office', 'other'][k + 1] AS kind,
  ['pdf', 'pdf', NULL, NULL, 'png', 'pdf', 'pdf'][k + 1] AS found,
  [NULL, NULL, 'detached', 'truncated', NULL, 'to be saved as pdf first', 'not recognised'][k + 1] AS error,
  CASE WHEN k IN (0, 1, 5, 6) THEN sha END AS sha256,
  CASE WHEN k = 4 THEN round(CASE WHEN w >= h THEN 841.89 ELSE 841.89::DOUBLE * w / h END, 6) END AS page_width,
  CASE WHEN k = 4 THEN round(CASE WHEN h >= w THEN 841.89 ELSE 841.89::DOUBLE * h / w END, 6) END AS page_height FROM d"""

# ---- whole reports


def rendered_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of each document, from the header to the statement (Q1-Q8, K2, C10o)."""
    pages = cases.pages(spark, sf_dir, cases.IDENTIFIERS)
    return rendered(pages, analysed(pages, purpose="publish"), Settings("publish", body="Comune di Esempio", made_at="2026-01-01"))


RENDERED_REPORTS = f"""{q._IDS.replace("FROM customer)", f", {cases.chosen(cases.IDENTIFIERS)} AS text FROM customer)")}
SELECT doc_id, concat_ws(chr(10), '# Report of treatment', 'made: 2026-01-01', 'document: ' || doc_id, 'pages: 1', 'dropped pages: none', 'kind: native', 'quality: none',
  'purpose: publish', 'body: Comune di Esempio', 'mode: omissis', 'dots an inch: 200', 'rules: {RULES_VERSION}', '## Findings',
  CASE WHEN category IS NULL THEN 'none' ELSE '1 | page 1 | ' || category || ' | ' || detector || ' | ' ||
    CASE WHEN detector IN ({q._quoted(CERTAINTY["formal"])}) THEN 'formal' ELSE 'contextual' END || ' | ' || CASE WHEN decision = 'mask' THEN 'masked' ELSE 'clear' END END,
  '## Decisions of band C',
  CASE WHEN proposal_key = 'C6' THEN 'page 1 | C6 | (masked text) | mask (proposed) | VAT number of unknown nature'
    WHEN proposal_key = 'C6_company' THEN 'page 1 | C6 | "' || text || '" | keep (proposed) | VAT number in the context of a company or body | VAT number of a company or body' ELSE 'none' END,
  '## Restored', 'none', '## Persons', 'none', '## Statement', '{STATEMENT}') AS report FROM f"""

# ---- what single rules and decisions do


def form_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Residences and addresses in the fields of forms."""
    return q._placed(analysed(cases.pages(spark, sf_dir, cases.FORMS), purpose="publish"))


def work_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hardship and employment, grown to their clauses and proposed by the purpose."""
    return q._placed(analysed(cases.pages(spark, sf_dir, cases.WORK), purpose="publish"))


def name_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A recognizer's names by score: 0.55 at least, 0.9 without a capital."""
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet")
    key, name = F.col("c_custkey"), F.expr(cases.NAME)
    own = F.when(key % 4 < 2, name).otherwise(F.lower(name))
    score = F.element_at(F.array(*map(F.lit, (0.5499, 0.55, 0.8999, 0.9))), (key % 4 + 1).cast("int"))
    pages = rows.select(key.alias("doc_id"), F.lit(1).alias("page"), F.concat(F.lit("Oggi "), own, F.lit(" abita qui.")).alias("text"))
    entities = rows.select(key.alias("doc_id"), F.lit(1).alias("page"), F.lit(5).alias("start"), (F.lit(5) + F.length(own)).alias("end"), score.alias("score"))
    return name_findings(pages, entities, 0).select("doc_id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "text")


def _order_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two findings for each order: one of band C, one of band B, under the customer's key."""
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(c).alias("category")) for i, c in enumerate(("C1", "B7"))])).alias("f")
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_custkey", "o_orderkey", each)
    text = F.concat(F.lit("persona "), (F.col("o_orderkey") % 5).cast("string"))
    return constructed(rows.select(
        F.col("o_custkey").alias("doc_id"), F.lit(1).alias("page"), (2 * F.col("o_orderkey") + F.col("f.i")).alias("seq"), F.lit(0).alias("start"), F.length(text).alias("end"),
        text.alias("text"), "f.category", F.lit("recognizer").alias("detector"), text.alias("subject_key"),
    ))


def finding_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One finding kept, then masked again, and all of one person's (C4o, C5o)."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    one = orders.where("o_orderkey % 2 = 0").select(F.col("o_custkey").alias("doc_id"), F.lit(1).alias("step"), F.lit("finding").alias("op"), F.concat(F.lit("1:"), 2 * F.col("o_orderkey")).alias("target"), F.lit("keep").alias("decision"))
    again = orders.where("o_orderkey % 6 = 0").select(F.col("o_custkey").alias("doc_id"), F.lit(2).alias("step"), F.lit("finding").alias("op"), F.concat(F.lit("1:"), 2 * F.col("o_orderkey")).alias("target"), F.lit("mask").alias("decision"))
    person = orders.select("o_custkey").distinct().select(F.col("o_custkey").alias("doc_id"), F.lit(3).alias("step"), F.lit("subject").alias("op"), F.lit("persona 3").alias("target"), F.lit("keep").alias("decision"))
    rows = decided(_order_findings(spark, sf_dir), one.unionAll(again).unionAll(person))
    return rows.select("doc_id", "seq", "category", "decision", "confirmed", "modified")


def restored_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings that users left in the clear against the default, by document (Q5)."""
    rows = _order_findings(spark, sf_dir).withColumns({"decision": F.expr("CASE WHEN seq % 3 = 0 THEN 'keep' ELSE decision END"), "modified": F.expr("seq % 3 = 0 AND category = 'B7'")})
    return restored(rows).select("doc_id", "page", "seq", "category", "detector")


def person_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of the persons that are masked in a document."""
    rows = numbered(_order_findings(spark, sf_dir).withColumn("decision", F.expr("CASE WHEN subject_key = 'persona 4' THEN 'keep' ELSE 'mask' END")))
    return pseudonyms(rows).groupBy("doc_id").agg(F.count("*").alias("n"), F.sum("subject_no").cast("long").alias("sum"))


def citation_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Persons told apart and passages cited, by document."""
    cites = spark.createDataFrame(CITES, "of string, source string, key string")
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet")
    found = rows.select(F.col("o_custkey").alias("doc_id"), F.expr(CITING).alias("category"), (F.col("o_orderkey") % 3).alias("subject_no"))
    made = citation_counts(found, cites)
    return made.select("doc_id", *[F.col(c).cast("long").alias(c) for c in ("n_subjects", "n_passages")])


_F = """f AS (SELECT o_custkey AS doc_id, o_orderkey AS k, 2 * o_orderkey + i AS seq, ['C1', 'B7'][i + 1] AS category, 'persona ' || (o_orderkey % 5) AS who
  FROM orders, (VALUES (0), (1)) AS v(i))"""
FINDING_DECISIONS = f"""
WITH {_F}, d AS (SELECT *, CASE WHEN who = 'persona 3' THEN 'keep' WHEN category = 'C1' AND k % 6 = 0 THEN 'mask' WHEN category = 'C1' AND k % 2 = 0 THEN 'keep' END AS new FROM f)
SELECT doc_id, seq, category, coalesce(new, CASE WHEN category = 'B7' THEN 'mask' END) AS decision, new IS NOT NULL AS confirmed,
  coalesce(category = 'B7' AND new = 'keep', false) AS modified FROM d"""
RESTORED_LIST = f"WITH {_F} SELECT doc_id, CAST(1 AS INT) AS page, seq, category, 'recognizer' AS detector FROM f WHERE seq % 3 = 0 AND category = 'B7'"
PERSON_LABELS = f"""
WITH {_F}, w AS (SELECT doc_id, who, min(seq) AS s FROM f GROUP BY ALL), n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY s) AS nr FROM w)
SELECT doc_id, count(*) AS n, CAST(sum(nr) AS BIGINT) AS sum FROM n WHERE who <> 'persona 4' GROUP BY doc_id"""
CITATION_TOTALS = f"""
WITH cites(of_, source, key) AS (VALUES {_values(CITES)}), o AS (SELECT o_custkey AS doc_id, o_orderkey % 3 AS s, {CITING} AS of_ FROM orders)
SELECT doc_id, count(DISTINCT s) AS n_subjects, count(DISTINCT CASE WHEN cites.key IS NOT NULL THEN cites.source || '/' || cites.key END) AS n_passages
FROM o LEFT JOIN cites USING (of_) GROUP BY doc_id"""
NAME_SCORES = f"""
WITH n AS (SELECT c_custkey AS doc_id, c_custkey % 4 AS k, {cases.NAME} AS name FROM customer)
SELECT doc_id, CAST(5 AS BIGINT) AS start, CAST(5 + length(name) AS BIGINT) AS "end", CASE WHEN k < 2 THEN name ELSE lower(name) END AS text FROM n WHERE k IN (1, 3)"""

# ---- contacts by where they stand


def column_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contacts at the top of a second column, which the text has last: in the head of a page that
    names a body, below the head, and in the head of a page that names none (J8)."""
    k = F.col("c_custkey")
    heading = F.when(k % 3 == 2, "Curriculum vitae").otherwise("Comune di Esempio")
    contact = F.concat(F.lit("tel. 090 "), F.lpad(k.cast("string"), 7, "0"))
    lines = [(0, heading, 50, F.lit(700.0))] + [(i, F.lit(f"riga di testo {i}"), 50, F.lit(700.0 - 14 * i)) for i in range(1, 10)]
    lines += [(10, contact, 400, F.when(k % 3 == 1, 500.0).otherwise(800.0))]
    each = F.explode(F.array(*[F.struct(F.lit(s).alias("seg"), t.alias("str"), F.lit(float(x)).alias("x"), y.alias("y")) for s, t, x, y in lines])).alias("r")
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").select(k.alias("doc_id"), F.lit(1).alias("page"), each).select("doc_id", "page", "r.*")
    runs = staged(placed_runs(rows.withColumns({"w": 5.5 * F.length("str"), "h": F.lit(11.0)}), reorder=False), "runs")
    return q._placed(analysed(page_texts(runs), purpose="publish", runs=runs))


COLUMN_CONTACTS = """
SELECT c_custkey AS doc_id, CAST(CASE WHEN c_custkey % 3 = 2 THEN 16 ELSE 17 END + 1 + 9 * 16 + 5 AS BIGINT) AS start,
  CAST(CASE WHEN c_custkey % 3 = 2 THEN 16 ELSE 17 END + 1 + 9 * 16 + 16 AS BIGINT) AS "end", '090 ' || lpad(CAST(c_custkey AS VARCHAR), 7, '0') AS text,
  CASE WHEN c_custkey % 3 = 0 THEN 'P' ELSE 'B3' END AS category, CASE WHEN c_custkey % 3 = 0 THEN 'P' ELSE 'B3' END AS proposal_key,
  CASE WHEN c_custkey % 3 = 0 THEN 'keep' ELSE 'mask' END AS decision FROM customer"""

QUERIES = {f.__name__: f for f in (sql_spans, document_spans, sql_checks, custom_rules, image_places, drawn_routes, covered_areas, signed_documents, rendered_reports,
    form_findings, work_findings, name_scores, finding_decisions, restored_list, person_labels, citation_totals, column_contacts)}
ORACLE_SQL = {
    "sql_spans": f'SELECT doc_id, start, "end", text, category FROM ({cases.expected(cases.CONTACTS)})',
    "sql_checks": f"""
SELECT id, i.valid AS iban, t.valid AS tax_code, v.valid AS vat_number
FROM ({q.ORACLE_SQL["iban_checks"]}) i JOIN ({q.ORACLE_SQL["tax_code_checks"]}) t USING (id) JOIN ({q.ORACLE_SQL["vat_checks"]}) v USING (id)""",
    "custom_rules": CUSTOM_RULES, "image_places": IMAGE_PLACES, "drawn_routes": DRAWN_ROUTES, "covered_areas": COVERED_AREAS,
    "form_findings": cases.expected(cases.FORMS), "work_findings": cases.expected(cases.WORK), "name_scores": NAME_SCORES,
    "finding_decisions": FINDING_DECISIONS, "restored_list": RESTORED_LIST, "person_labels": PERSON_LABELS, "citation_totals": CITATION_TOTALS,
    "column_contacts": COLUMN_CONTACTS,
    "signed_documents": SIGNED_DOCUMENTS, "rendered_reports": RENDERED_REPORTS,
}
