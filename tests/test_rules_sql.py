"""Sweeps, islands and word joins against plain versions; users' rules, SQL functions, drawing operators."""

import os
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from veilframe import rule_queries
from veilframe.functions.patterns import STOP, last_place, matches
from veilframe.operators.decide import proposed
from veilframe.operators.detect import Detector, detect, prepared
from veilframe.operators.findings import COLUMNS, SCHEMA, constructed
from veilframe.operators.images import painted
from veilframe.operators.overlap import _resolve, resolved
from veilframe.operators.redact import box_outcomes, outcomes, redacted
from veilframe.operators.silence import demoted, silenced
from veilframe.operators.subjects import _places
from veilframe.plans.pipeline import analysed
from veilframe.plans.sql import register_functions
from veilframe.rules import user

#: Queries are held against SQL on these tables.
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def made(spark, rows):
    """Findings (doc_id, page, seq, start, end, category) with the defaults of their categories."""
    df = spark.createDataFrame([(*r, "x" * ((r[4] or 0) - (r[3] or 0)), "d") for r in rows], "doc_id long, page int, seq long, start int, end int, category string, text string, detector string")
    return constructed(df)


def some_findings(rng, pages, n, length):
    rows = []
    for page in range(pages):
        for seq in range(n):
            start = rng.randrange(length)
            rows.append((page % 3, page, seq, start, start + rng.randrange(1, 30), rng.choice(["C1", "C3", "C4", "A1", "B1", "P"])))
        rows.append((page % 3, page, n, None, None, "C7"))
    return rows


def test_silenced_and_demoted(spark):
    rng = random.Random(4)
    rows = [r for n in (1, 2, 5, 40) for r in some_findings(rng, 6, n, 3000 if n < 40 else 9000)]
    rows = [(i, *r[1:]) if r[3] is not None else (i, *r[1:]) for i, r in enumerate(rows)]
    rows = [(r[0] // 7, 1, i, *r[3:]) for i, r in enumerate(rows)]
    text = {d: "".join(rng.choice("abcdefgh\n\n" + " " * 60 + ("; " if d % 2 else "")) for _ in range(10_000)) for d in {r[0] for r in rows}}
    found = made(spark, rows)
    person = [r for r in rows if r[5] in ("C1", "P") and r[3] is not None]
    near = {r[2] for r in rows if r[3] is not None for p in person if p[0] == r[0] and p[4] >= r[3] - 300 and p[3] <= r[4] + 300}
    assert {r.seq for r in silenced(found).collect()} == {r[2] for r in rows if r[5] not in ("C3", "C4") or r[2] in near}

    def clause(t, a, b):
        return ";" not in t[a:b] and STOP not in t[a:b] and t[a:b].count("\n") <= 6 and "\n\n" not in t[a : b + 1]

    with_person = {
        r[2] for r in rows if r[5] == "A1" for p in person
        if p[0] == r[0] and p[4] >= r[3] - 400 and p[3] <= r[4] + 400 and (min(r[4], p[4]) >= max(r[3], p[3]) or clause(text[r[0]], min(r[4], p[4]), max(r[3], p[3])))
    }
    pages = spark.createDataFrame([(d, 1, t) for d, t in text.items()], "doc_id long, page int, shadow string")
    got = demoted(pages, found).collect()
    assert len(got) == len(rows)
    assert {r.seq: r.category for r in got} == {r[2]: "C8" if r[5] == "A1" and r[2] not in with_person else r[5] for r in rows}
    assert {r.decision for r in got if r.category == "C8"} == {None}
    masked = {r[2] for r in rows if r[5] in ("A1", "B1") and r[3] is not None}
    over = {r[2] for r in rows if r[3] is not None and r[2] not in masked for m in rows if m[2] in masked and m[0] == r[0] and m[3] < r[4] and r[3] < m[4]}
    assert {r.seq for r in outcomes(found).collect() if r.covered} == over


def test_islands_are_resolved_as_pages(spark):
    rng = random.Random(5)
    rows = [r for n in (0, 1, 3, 60, 400) for r in some_findings(rng, 4, n, 12 * n + 30)]
    rows = [(r[0], r[1] + 10 * i, i, *r[3:]) for i, r in enumerate(rows)]
    rows += [(9, 1, 10**6 + i, 100 * i, 100 * i + 5, "B1") for i in range(20_000)]  # a page of very many spans that do not meet
    found = made(spark, rows)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        got = sorted(str(r) for r in resolved(found).collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    by = {}
    for r in sorted((r.asDict() for r in found.collect()), key=lambda r: (-1 if r["start"] is None else r["start"], r["seq"])):
        by.setdefault((r["doc_id"], r["page"]), []).append(r)
    schema = spark.createDataFrame([], SCHEMA).columns
    assert list(COLUMNS) == schema
    expected = spark.createDataFrame([tuple(r[c] for c in schema) for page in by.values() for r in _resolve(page)], SCHEMA)
    assert got == sorted(map(str, expected.collect()))


FAMILIES = ["Rossi", "D'Angelo", "De Luca", "Èrcoli", "Lo"]


def test_places_of_surnames(spark):
    rng = random.Random(6)
    words = ["Rossi", "rossi", "ROSSI", "M. Rossi", "M.rossi", "m. rossi", "Rossini", "D’Angelo", "D'ANGELO", "d'angelo", "De Luca", "De  \n Luca", "De Lucas", "A. De luca", "èrcoli", "Èrcoli", "Lo", "lo", "AB. Rossi", "x", ".", "1", "\n"]
    texts = ["".join(rng.choice(words) + rng.choice([" ", "", ", "]) for _ in range(rng.randrange(60))) for _ in range(40)] + ["De " * 2000 + "Luca", ""]
    pages = spark.createDataFrame([(i, 1, t) for i, t in enumerate(texts)], "doc_id long, page int, text string")
    given = [(i, f, f.lower()) for i in range(len(texts)) for f in FAMILIES if (i + len(f)) % 3]
    families = spark.createDataFrame(given, "doc_id long, family string, k string").withColumn("persons", F.array("k"))
    got = sorted((r.doc_id, r.k, r.start, r.found) for r in _places(pages, families).collect())
    expected = []
    for i, f, k in given:
        own = re.escape(f).replace("'", "['’]").replace(r"\ ", r"\s+")
        for m in re.finditer(rf"(?i)(?<![^\W\d_])(?:[^\W\d_]\.\s?)?{own}(?![^\W\d_])", texts[i]):
            if m[0][0].isupper():
                expected.append((i, k, m.start(), m[0]))
    assert got == sorted(expected) and len(got) > 100


def test_many_matches(spark):
    text = "".join(f"{i} a" for i in range(3000))
    df = spark.createDataFrame([(text,), ("",), ("a",), (None,)], "t string")
    rows = df.select(matches(F.col("t"), r"\d+").alias("m"), last_place(F.col("t"), r"\d+").alias("s"), last_place(F.col("t"), r"a( ?)\d", place="end").alias("e")).collect()
    assert [m.text for m in rows[0].m] == re.findall(r"\d+", text) and all(text[m.start : m.end] == m.text for m in rows[0].m)
    assert rows[0].s == [m.start() for m in re.finditer(r"\d+", text)][-1]
    assert rows[0].e == [m.start(1) for m in re.finditer(r"a( ?)\d", text)][-1]
    assert [(r.s, r.e) for r in rows[1:3]] == [(-1, -1)] * 2


def test_keys_are_needed(spark):
    pages = spark.createDataFrame([(1, 1, "cell 347 1234567"), (None, 1, "cell 347 1234567")], "doc_id long, page int, text string")
    with pytest.raises(Exception, match="no doc_id"):
        analysed(pages, detectors=(Detector("mobile", "B3", r"347 \d+"),))
    twice = pages.where("doc_id is not null")
    with pytest.raises(ValueError, match="two pages"):
        analysed(twice.unionAll(twice), detectors=(Detector("mobile", "B3", r"347 \d+"),))
    found = made(spark, [(1, 1, 0, 5, 16, "B3")]).withColumn("subject_no", F.lit(None).cast("int"))
    with pytest.raises(Exception, match="no doc_id"):
        redacted(pages, found).collect()
    with pytest.raises(Exception, match="no doc_id"):
        silenced(found.withColumn("page", F.lit(None).cast("int"))).collect()


def test_user_rules(spark):
    table = lambda sql: spark.sql(sql)
    one = user.detectors(table("SELECT 'x' AS name, 'B1' AS category, 'a.c' AS pattern, true AS words, false AS ignore_case"))[-1]
    assert (one.name, one.category, one.ignore_case) == ("x", "B1", False) and one.pattern.startswith("(?<!")
    base = (Detector("x", "B1", "old"), Detector("y", "B2", "kept"))
    assert [d.pattern for d in user.detectors(table("SELECT 'x' AS name, 'B1' AS category, 'new' AS pattern"), base)] == ["new", "kept"]
    for bad in (
        "SELECT 'x' AS name, 'Z9' AS category, 'a' AS pattern", "SELECT 'x' AS name, 'B1' AS category", "SELECT 'x' AS name, 'B1' AS category, CAST(NULL AS STRING) AS pattern",
        "SELECT 'x' AS name, 'B1' AS category, 'a' AS pattern, 'no' AS validator", "SELECT 'x' AS name, 'B1' AS category, explode(array('a', 'b')) AS pattern",
        "SELECT concat('x', id) AS name, 'B1' AS category, 'a' AS pattern FROM range(1001)", "SELECT concat('x', id) AS name, 'B1' AS category, 'a' AS pattern FROM range(90)",
    ):
        with pytest.raises(ValueError):
            user.detectors(table(bad))
    with pytest.raises(ValueError):
        user.kinds(table("SELECT 'nobody' AS kind, 'a' AS pattern"))
    kinds = user.kinds(table("SELECT 'minor' AS kind, 'pupil' AS pattern, 5 AS radius, CAST(NULL AS INT) AS lines"))
    assert "pupil" in kinds["minor"][0] and kinds["minor"][1] == 5
    found = made(spark, [(1, 1, 0, 0, 1, "C6"), (1, 1, 1, 2, 3, "C3")])
    mine = table("SELECT 'publish' AS purpose, 'C6' AS proposal_key, 'keep' AS decision, 'mine' AS reason")
    assert {r.category: (r.decision, r.reason) for r in proposed(found, "publish", mine).collect()} == {"C6": ("keep", "mine"), "C3": ("mask", "judicial data")}


def test_functions(spark):
    register_functions(spark, prefix="t_")
    docs = [(i, t) for i, t in enumerate([
        "C.F. RSSMRA85T10A562S, IBAN IT60 X054 2811 1010 0000 0123 456 BANCA.", "Il sig. Mario Rossi, nato a Messina il 01/02/1980; P. IVA 00743110157 della società ALFA.",
        "Permessi ai sensi della legge 104/1992; cell. 347 1234567, mario.rossi@gmail.com \x01 it's", "", None,
    ])]
    spark.createDataFrame(docs, "doc_id long, text string").createOrReplaceTempView("t_docs")
    got = spark.sql("SELECT d.doc_id, s.* FROM t_docs d, LATERAL t_detect_spans(d.text) s").collect()
    pages = prepared(spark.table("t_docs").select("doc_id", F.lit(1).alias("page"), "text"))
    expected = detect(pages).select("doc_id", "start", "end", "text", "category", "detector", "proposal_key").collect()
    assert sorted(map(str, got)) == sorted(map(str, expected)) and len(got) > 6
    row = spark.sql("SELECT t_is_iban(NULL) a, t_is_payment_card('4111 1111 1111 1111') b, t_name_key('Ionuț D’Àngelo') c, t_surname('Mario De Luca') d, t_amount_of('1.234,56') e, t_is_birth_date('31/02/1990') f").first()
    assert (row.a, row.b, row.c, row.d, str(row.e), row.f) == (False, True, "ionut d'angelo", "De Luca", "1234.56", False)


def test_drawing(spark):
    ops = [(1, 1, 0, "restore", None), (1, 1, 1, "image", None), (1, 1, 2, "transform", [2.0, 0.0, 0.0, 2.0, 1.0, 1.0]), (1, 1, 3, "form", None), (1, 1, 4, "transform", [0.0, 1.0, -1.0, 0.0, 0.0, 0.0]),
           (1, 1, 5, "image", None), (1, 1, 6, "form_end", None), (1, 1, 7, "image", None), (1, 2, 0, "image", None), (2, 1, 0, "transform", None), (2, 1, 9, "image", None), (2, 1, 3, "transform", [1.0, 0.0, 0.0, 1.0, 7.0, 0.0])]
    df = spark.createDataFrame(ops, "doc_id long, page int, seq long, op string, m array<double>").repartition(3)
    got = {(r.doc_id, r.page, r.seq): tuple(r.m) for r in painted(df).collect()}
    plain = (1, 0, 0, 1, 0, 0)
    assert got == {(1, 1, 1): plain, (1, 1, 5): (0, 2, -2, 0, 1, 1), (1, 1, 7): (2, 0, 0, 2, 1, 1), (1, 2, 0): plain, (2, 1, 9): (1, 0, 0, 1, 7, 0)}
    assert painted(df.limit(0)).count() == 0


def test_rectangles(spark):
    rng = random.Random(7)
    boxes = [(d, 1, s, rng.uniform(-80, 300), rng.uniform(-80, 300), rng.choice([1.0, 20.0, 200.0]), rng.choice([2.0, 11.0, 90.0])) for d in range(12) for s in range(9) for _ in range(1 + s % 2)]
    found = spark.createDataFrame([(d, 1, s, ["mask", "keep", None][s % 3], "drop" if d == 5 and s == 0 else "mask") for d in range(12) for s in range(9)], "doc_id long, page int, seq long, decision string, action string")
    got = {(r.doc_id, r.seq): (r.outcome, r.covered) for r in box_outcomes(found, spark.createDataFrame(boxes, "doc_id long, page int, seq long, x double, y double, w double, h double")).collect()}

    def covers(t, m):
        x, y = min(t[3] + t[5], m[3] + m[5] + 1.2) - max(t[3], m[3] - 1.2), min(t[4] + t[6], m[4] + m[6] + 1.2) - max(t[4], m[4] - 1.2)
        return x > min(1.5, t[5] / 2) and y > min(1.5, t[6] * 0.3)

    for d in range(12):
        for s in range(9):
            mine, masks = [b for b in boxes if b[0] == d and b[2] == s], [b for b in boxes if b[0] == d and b[2] % 3 == 0]
            over = d != 5 and s % 3 > 0 and any(covers(t, m) for t in mine for m in masks)
            assert got[d, s] == ("dropped" if d == 5 else "masked" if s % 3 == 0 else "clear", over)


@pytest.mark.parametrize("name", sorted(rule_queries.ORACLE_SQL))
def test_query_agrees_with_sql(spark, name):
    db = duckdb.connect()
    for table in ("customer", "orders", "documents"):
        db.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    df = rule_queries.QUERIES[name](spark, SF)
    columns = ", ".join(f'"{c}"' for c in sorted(df.columns))
    expected = db.sql(f"SELECT {columns} FROM ({rule_queries.ORACLE_SQL[name]})").fetchall()
    assert sorted(map(str, (tuple(r[c] for c in sorted(df.columns)) for r in df.collect()))) == sorted(map(str, expected))


def test_files_of_a_folder(spark, tmp_path):
    from veilframe.sources import files

    png = b"\x89PNG\r\n\x1a\n\0\0\0\rIHDR" + (100).to_bytes(4) + (50).to_bytes(4)
    jpeg = b"\xff\xd8\xff\xe0\0\4ab\xff\xff\xc4\0\3x\xff\xc2\0\x0b\x08" + (30).to_bytes(2) + (60).to_bytes(2) + b"\1\1\1\1"
    for name, data in {"a.pdf": b"%PDF-1", "b/c.png": png, "d.JPG": jpeg, "lie.pdf": png, "e.p7m": b"nothing", "f.odp": b"x", "g": b"?", "broken.png": b"text", "cut.jpg": b"\xff\xd8\xff\xc0\0"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    rows = {r.path.rpartition("/")[2]: r for r in files.read_files(spark, str(tmp_path)).collect()}
    assert {n: (r.kind, r.found, r.error) for n, r in rows.items()} == {
        "a.pdf": ("pdf", "pdf", None), "c.png": ("image", "png", None), "d.JPG": ("image", "jpeg", None), "lie.pdf": ("pdf", "png", None), "e.p7m": ("signed", None, "not signed data"),
        "f.odp": ("office", None, "to be saved as pdf first"), "g": ("other", None, "not recognised"), "broken.png": ("image", None, "not recognised"), "cut.jpg": ("image", "jpeg", None),
    }
    assert (rows["c.png"].page_width, rows["c.png"].page_height) == (841.89, 841.89 / 2)
    assert (rows["d.JPG"].page_width, rows["d.JPG"].page_height) == (841.89, 841.89 / 2)
    assert rows["cut.jpg"].page_width is None and "content" not in rows["a.pdf"]
    nothing = spark.createDataFrame([(None, None, "application/pdf")], "path string, content binary, mime string")
    assert [(r.kind, r.error) for r in files.opened(nothing, "mime").collect()] == [("pdf", "not recognised")]


def test_whole_report(spark, tmp_path):
    from veilframe.operators import rendered as r

    rows = [(1, 1, 0, 0, 4, "C1"), (1, 1, 1, 9, 12, "C6"), (1, 2, 0, None, None, "B4P"), (1, 3, 0, 5, 6, "A1"), (1, 3, 1, 0, 4, "C1"), (1, 3, 2, 4, 6, "P")]
    new = {"decision": F.expr("CASE WHEN page = 3 AND seq = 0 THEN 'keep' WHEN category = 'C6' THEN NULL ELSE coalesce(decision, 'mask') END"), "modified": F.expr("page = 3 AND seq = 0"), "proposed": F.expr("category = 'C1'")}
    found = made(spark, rows).withColumns(new).withColumns({"subject_no": F.expr("CASE WHEN category = 'C1' THEN 2 - seq END"), "rationale": F.lit("public")})
    pages = spark.createDataFrame([(1, 1, True, 90.0), (1, 2, True, None), (1, 3, False, None), (7, 1, None, None)], "doc_id long, page int, is_scan boolean, ocr_conf double")
    cited = spark.createDataFrame([(1, 2, "Law B", "art. 2"), (1, 1, "Law A", "art. 1")], "doc_id long, nr int, title string, ref string")
    reports = r.rendered(pages, found, r.Settings("private", "pseudonym", dpi=300), cited)
    got = {x.doc_id: x.report.split("\n") for x in reports.collect()}
    assert got[1] == [
        "# Report of treatment", "made: none", "document: 1", "pages: 3", "dropped pages: 2", "kind: mixed", "quality: good", "purpose: private", "body: none", "mode: pseudonym",
        "dots an inch: 300", f"rules: {r.RULES_VERSION}", "## Findings", "1 | page 1 | C1 | d | statistical | masked", "2 | page 1 | C6 | d | statistical | clear",
        "3 | page 2 | B4P | d | statistical | dropped", "4 | page 3 | C1 | d | statistical | masked", "5 | page 3 | P | d | statistical | clear", "6 | page 3 | A1 | d | statistical | clear, changed",
        "## Decisions of band C", "page 1 | C1 | [SUBJECT 2] | mask (proposed)", 'page 1 | C6 | "xxx" | open', "page 3 | C1 | [SUBJECT 1] | mask (proposed)",
        "## Restored", 'page 3 | A1 (band A) | "x" | public', "## Persons", "[SUBJECT 1], [SUBJECT 2]", "## Sources", "Law A: art. 1", "Law B: art. 2", "## Statement", r.STATEMENT,
    ]
    assert got[7][3:7] == ["pages: 1", "dropped pages: none", "kind: native", "quality: none"] and got[7].count("none") == 5
    assert (r.default_mode("publish"), r.default_mode("private"), r.Settings(None).masked) == ("omissis", "full", "full")
    for bad in ({"dpi": 72}, {"mode": "blur"}):
        with pytest.raises(ValueError):
            r.Settings(**bad)
    r.write_reports(reports, str(tmp_path / "out"), 4)
    assert {x.doc_id for x in spark.read.parquet(str(tmp_path / "out")).collect()} == {1, 7}
