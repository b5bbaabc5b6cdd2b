"""The span engine: validators, interval algebra, cases of acts, and queries against DuckDB."""

import os
import random
from dataclasses import replace

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import __spark_entry__
from veilframe.functions import patterns, validators
from veilframe.operators import layout
from veilframe.operators.detect import DETECTORS, detect, prepared
from veilframe.operators.names import entities_of
from veilframe.operators.overlap import _resolve
from veilframe.operators.redact import OMISSIS, PSEUDONYM, redacted
from veilframe.plans.pipeline import analysed
from veilframe.plans.staging import staged
from veilframe.sources import files

#: Queries are held against SQL on these tables.
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

#: text, names, expected (text, category, proposal key, decision), texts that stay
CASES = [
    ("Si liquida a favore di Luca Bianchi la somma di euro 1.000,00.", ["Luca Bianchi"], [("Luca Bianchi", "C2", "C2_below", "mask")], []),
    ("Si liquida a favore di Luca Bianchi la somma di euro 1.500,00.", ["Luca Bianchi"], [("Luca Bianchi", "C2", "C2_above", "keep")], ["Luca"]),
    ("Il Responsabile del procedimento: dott. Anna Verdi. Controinteressato: Mario Rossi.", ["Anna Verdi", "Mario Rossi"],
     [("Anna Verdi", "P", "P", "keep"), ("Mario Rossi", "B7", "B7", "mask")], ["Anna Verdi"]),
    ("Il minore Luca Bianchi è accompagnato dalla madre Maria Rossi.", ["Luca Bianchi", "Maria Rossi"],
     [("Luca Bianchi", "B8", "B8", "mask"), ("Maria Rossi", "B7", "B7", "mask")], []),
    ("Permessi ai sensi della legge 104/1992.", [], [("Permessi ai sensi della legge 104/1992", "C8", "C8", "mask")], []),
    ("Ricorso al TAR senza persone.", [], [], ["Ricorso al TAR"]),
    ("C.F. RSSMRA85T10A562S e RSSMRA85T10A562X.", [], [("RSSMRA85T10A562S", "B1", "B1", "mask")], ["RSSMRA85T10A562X"]),
    ("IBAN IT60 X054 2811 1010 0000 0123 456 BANCA.", [], [("IT60 X054 2811 1010 0000 0123 456", "B2", "B2", "mask")], ["BANCA"]),
    ("P. IVA 00743110157 della società ALFA s.r.l.", [], [("00743110157", "C6", "C6_company", "keep")], ["00743110157"]),
    ("Scrivere a mario.rossi@gmail.com o protocollo@comune.messina.it.", [], [("mario.rossi@gmail.com", "B3", "B3", "mask")], ["protocollo@comune"]),
    ("Contributo di euro 1.500,00 a favore di Mario Rossi. Il sig. Rossi ringrazia.", ["Mario Rossi"],
     [("Mario Rossi", "C2", "C2_above", "keep"), ("Rossi", "C2", "C2_above", "keep")], ["Mario Rossi"]),
    ("Mario D'Angelo è presente. Oggi D’Angelo abita qui.", ["Mario D'Angelo"],
     [("Mario D'Angelo", "C1", "C1", "mask"), ("D’Angelo", "C1", "C1", "mask")], []),
    ("Comune di Messina\nUfficio tecnico\nTel. 090 7761234", [], [("090 7761234", "P", "P", "keep")], ["090 7761234"]),
    ("", [], [], []),
    (None, [], [], []),
]


@pytest.fixture(scope="module")
def found(spark):
    pages = spark.createDataFrame([(i, 1, c[0]) for i, c in enumerate(CASES)], "doc_id long, page int, text string")
    names = spark.createDataFrame([(i, n) for i, c in enumerate(CASES) for n in c[1]], "doc_id long, name string")
    return pages, analysed(pages, entities_of(pages, names), "publish").cache()


def test_cases(found):
    pages, findings = found
    got = {}
    for r in findings.collect():
        got.setdefault(r.doc_id, set()).add((r.text, r.category, r.proposal_key, r.decision))
    for i, (_, _, expected, _) in enumerate(CASES):
        assert set(expected) <= got.get(i, set()), (i, got.get(i))
    left = {r.doc_id: r.redacted_text for r in redacted(pages, findings, OMISSIS).collect()}
    for i, (_, _, expected, stays) in enumerate(CASES):
        assert all(s in left[i] for s in stays)
        assert not any(text in left[i] for text, *_, decision in expected if decision == "mask")


def test_names_that_touch_have_their_own_numbers(spark):
    pages = spark.createDataFrame([(1, 1, "AnnaLuca e Sara")], "doc_id long, page int, text string")
    rows = [(1, 1, i, a, b, "C1", "mask", "mask", i + 1) for i, (a, b) in enumerate([(0, 4), (4, 8), (11, 15), (12, 15)])]
    kinds = "doc_id long, page int, seq long, start int, end int, category string, decision string, action string, subject_no int"
    left = redacted(pages, spark.createDataFrame(rows, kinds), PSEUDONYM).first().redacted_text
    assert left == "[SUBJECT 1][SUBJECT 2] e [SUBJECT 3]"


def test_name_keys_drop_all_marks(spark):
    names = {"Ionuț Stănescu": "ionut stanescu", "Nikolić": "nikolic", "D’Àngelo": "d'angelo", "Nicolo\u0300 Ğül": "nicolo gul", "Łukasz": "ukasz"}
    df = spark.createDataFrame([(n,) for n in names], "n string").select("n", validators.name_key(F.col("n")).alias("k"))
    assert {r.n: r.k for r in df.collect()} == names


def test_pseudonyms_number_persons(found):
    left = {r.doc_id: r.redacted_text for r in redacted(*found, PSEUDONYM).collect()}
    assert left[3].startswith("Il minore [SUBJECT 1] è accompagnato dalla madre [SUBJECT 2]")


def luhn(number):
    digits = [int(c) for c in number[::-1]]
    return sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(digits)) % 10 == 0


def test_check_digits(spark):
    rng = random.Random(0)
    cards = ["".join(rng.choices("0123456789", k=rng.randrange(12, 21))) for _ in range(400)] + ["0" * 16]
    rows = spark.createDataFrame([(c,) for c in cards], "c string").select("c", validators.luhn(F.col("c")).alias("ok")).collect()
    assert all(r.ok == (13 <= len(r.c) <= 19 and len(set(r.c)) > 1 and luhn(r.c)) for r in rows)
    assert any(r.ok for r in rows)


spans = st.lists(st.tuples(st.integers(0, 60), st.integers(1, 20), st.sampled_from(["A1", "B1", "B3", "C3", "C1"])), max_size=12)


@settings(max_examples=200, deadline=None)
@given(spans)
def test_resolution_never_uncovers(rows):
    text = "".join(chr(97 + i % 26) for i in range(100))
    band = {"A1": "A", "B1": "B", "B3": "B", "C3": "C", "C1": "C"}
    given_ = [
        {"start": s, "end": s + n, "seq": i, "category": c, "band": band[c], "text": text[s : s + n], "note": ""}
        for i, (s, n, c) in enumerate(rows)
    ]
    covered = {p for r in given_ for p in range(r["start"], r["end"])}
    kept = _resolve(sorted((dict(r) for r in given_), key=lambda r: (r["start"], r["seq"])))
    assert {p for r in kept for p in range(r["start"], r["end"])} == covered
    assert all(r["text"] == text[r["start"] : r["end"]] for r in kept)


def test_matches_rebuild_the_text(spark):
    texts = ["ab12cd345", "12", "", "x", "1 2  3", "\x01 5"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("t", patterns.clean(F.col("t")))
    for r in df.select("t", patterns.matches(F.col("t"), r"\d+").alias("m")).collect():
        assert all(r.t[m.start : m.end] == m.text for m in r.m)
        assert "".join(m.text for m in r.m) == "".join(c for c in r.t if c.isdigit())


def tlv(tag, body):
    size = len(body)
    return bytes([tag]) + (bytes([size]) if size < 128 else bytes([0x82]) + size.to_bytes(2)) + body


def envelope(content):
    inner = tlv(0x30, bytes.fromhex("06092a864886f70d010701") + (tlv(0xA0, tlv(0x04, content)) if content is not None else b""))
    return tlv(0x30, files.SIGNED_DATA + tlv(0xA0, tlv(0x30, tlv(0x02, b"\1") + tlv(0x31, b"") + inner)))


def test_envelopes(spark):
    pdf = b"%PDF-1.4 " + b"x" * 300
    cases = [envelope(pdf), envelope(envelope(pdf)), envelope(None), envelope(pdf)[:50], b"abc!", None, envelope(b"text"), b"hello world this is text"]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, content binary")
    got = {r.i: (r.inner and bytes(r.inner), r.error) for r in files.unwrapped(df).collect()}
    assert got[0] == got[1] == (pdf, None)
    assert [got[i][1] for i in range(2, 8)] == ["detached", "truncated", "not signed data", "not signed data", "no document inside", "not signed data"]


def test_plain_text_as_runs(spark):
    texts = ["ab cd\n\nef gh", "\n \n x\n\t\n\ny \n", "", None, "\n\n", "a\r\nb"]
    pages = spark.createDataFrame([(i, 1, t) for i, t in enumerate(texts)], "doc_id long, page int, text string")
    runs = files.segments(pages)
    got = sorted((r.doc_id, r.seg, r.str, r.y, r.w) for r in runs.collect())
    assert got == [(0, 0, "ab cd\n", 700.0, 27.5), (0, 2, "ef gh", 672.0, 27.5), (1, 2, " x\n\n", 672.0, 11.0), (1, 5, "y \n", 630.0, 11.0), (5, 0, "a\r", 700.0, 11.0), (5, 1, "b", 686.0, 5.5)]
    placed = layout.placed_runs(runs, reorder=False)
    assert {r.doc_id: r.text for r in layout.page_texts(placed).collect()} == {0: "ab cd\n\nef gh", 1: " x\n\n\ny \n", 5: "a\r\nb"}
    findings = spark.createDataFrame([(0, 1, 0, 3, 9)], "doc_id long, page int, seq long, start int, end int")
    found = [(round(b.x, 2), b.y, round(b.w, 2)) for r in layout.span_boxes(findings, placed).collect() for b in r.boxes]
    # the line feed has its share of the first run's width
    assert sorted(found) == [(50.0, 672.0, 11.0), (63.75, 700.0, 13.75)]
    assert {r.y for r in files.segments(pages, files.HEAD).where("doc_id = 0").collect()} == {820.0, 792.0}


def test_stream(spark, tmp_path):
    from veilframe.streaming.ingest import analyse_stream, pages_stream

    spark.createDataFrame([(1, 1, "cell 347 1234567")], "doc_id long, page int, text string").write.parquet(str(tmp_path / "in"))
    analyse_stream(pages_stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "c"), "publish").awaitTermination()
    assert [r.text for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["347 1234567"]


def test_stream_of_runs(spark, tmp_path):
    from veilframe.plans.staging import shared_dir
    from veilframe.streaming.ingest import analyse_stream, pages_stream, runs_stream

    place = {k: str(tmp_path / k) for k in ("in", "out", "clear", "c")}
    names = spark.createDataFrame([(1, "Mario Rossi"), (2, "Anna Verdi")], "doc_id long, name string")
    texts = [(1, 1, "Si liquida a favore di Mario Rossi\nla somma di euro 500,00."), (2, 1, "Il RUP Anna Verdi.\ncell 347 1234567")]
    staged_before = _staged(spark, shared_dir(spark))
    for row in texts:
        runs = files.segments(spark.createDataFrame([row], "doc_id long, page int, text string"))
        runs.drop("line_end").coalesce(1).write.mode("append").parquet(place["in"])
        query = analyse_stream(runs_stream(spark, place["in"]), place["out"], place["c"], "publish", lambda pages: entities_of(pages, names), place["clear"])
        query.awaitTermination()
    found = {(r.doc_id, r.batch, r.text, r.decision) for r in spark.read.parquet(place["out"]).collect()}
    assert {(1, 0, "Mario Rossi", "mask"), (2, 1, "Anna Verdi", "keep"), (2, 1, "347 1234567", "mask")} <= found
    left = {r.doc_id: r.redacted_text for r in spark.read.parquet(place["clear"]).collect()}
    assert "Mario" not in left[1] and left[2].startswith("Il RUP Anna Verdi.") and "347" not in left[2]
    assert _staged(spark, shared_dir(spark)) == staged_before
    with pytest.raises(ValueError):
        analyse_stream(pages_stream(spark, place["in"]), place["out"], place["c"], clear=place["clear"])


def _staged(spark, place):
    folder = place.removeprefix("file://") + "/spans"
    return set(os.listdir(folder)) if os.path.isdir(folder) else set()


SPANS = sorted(__spark_entry__.spans.ORACLE_SQL)


@pytest.mark.parametrize("name", SPANS)
def test_query_agrees_with_sql(spark, name):
    db = duckdb.connect()
    for table in ("documents", "customer", "orders", "lineitem"):
        db.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    df = __spark_entry__.spans.QUERIES[name](spark, SF)
    names = sorted(df.columns)
    columns = ", ".join(f'"{c}"' for c in names)
    expected = db.sql(f"SELECT {columns} FROM ({__spark_entry__.spans.ORACLE_SQL[name]})").fetchall()
    assert sorted(map(str, (tuple(r[c] for c in names) for r in df.collect()))) == sorted(map(str, expected))


def test_house_numbers_of_any_length(spark):
    rows = spark.createDataFrame([(n, 1, f"Consegna in via Garibaldi {10**n}, piano terra.") for n in range(8)], "doc_id long, page int, text string")
    found = {r.doc_id: r.text for r in detect(prepared(rows)).where("detector = 'address'").collect()}
    assert found == {n: f"via Garibaldi {10**n}" for n in range(8)}


def test_few_bytes_of_many_rows_are_not_broadcast(spark, tmp_path):
    rows = spark.range(400_000).select(F.col("id").alias("doc_id"), F.lit(1).alias("page"), F.lit("Il sig. Mario Rossi abita qui. " * 8).alias("text"))
    pages = staged(rows.coalesce(1), "many")
    plan = pages.join(pages.select("doc_id", F.col("text").alias("t")), "doc_id")._jdf.queryExecution().sparkPlan().toString()
    assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan


def test_quick_looks_lose_no_match(spark):
    """Detectors find the same with what tells where to look as without."""
    heads = {
        "legge": "legge n. 104/92", "art": "art. 3, comma 1, legge 104", "equo": "equo indennizzo", "TSO": "TSO", "HIV": "hiv", "autosuff": "non autosufficiente", "vedent": "non vedenti",
        "asm": "asma", "asmatic": "asmatica", "cure": "cure mediche", "genetic": "dati genetici", "test": "test genetico", "DNA": "DNA", "biometric": "dato biometrico", "vita": "vita sessuale",
        "sesso": "attribuzione di sesso", "etni": "etnie", "RSU": "RSU", "CGIL": "CGIL", "UIL": "uil", "NURSIND": "NURSIND", "citazione": "atto di citazione", "precetto": "atto di precetto",
        "TAR": "TAR", "RG": "R.G. n. 12/2020", "ISEE": "ISEE", "casa": "casa famiglia", "buon": "buoni spesa", "odd": "ſfratto", "dotless": "ınvalidità", "dotted": "İCTUS", "kelvin": "parKinson",
    }
    lists = [x.removeprefix(r"\b").split("[")[0].split("(")[0].split("\\")[0] for d in DETECTORS for x in d.words]
    texts = [f"{a}{w}{b}" for w in [*heads.values(), *lists] for a, b in (("Qui ", " oggi."), ("é", "è"), ("", ""))]
    texts += [f"La {w.upper()} ieri" for w in heads.values()]
    texts += [
        "80380 00000 11111 22222", "IT60X0542811101000000123456", "c/c n. 1234567", "c. c. postale 1234567", "4111 1111 1111 1111", "333 1234567", "TEL. 090 1234567", "A.B@gmail.com",
        "RESIDENTE in Roma", "via Roma n. 12", "C. I. n. AB1234567", "NATA a Roma il 01/02/1970;", "nato a Roma\n il 01/02/1970", "residente in Roma\n", "\n via Roma\n", "DATA DI NASCITA: marzo", "Vedova",
        "stato civile: libero", "NUCLEO familiare di 3 persone", "Il sottoscritto Mario Rossi", "ISTANTE Anna De Bianchi", "Signora Bianchi", "Dott.ssa Anna Bianchi", "Dr. Rossi", "p. iva: IT 00743110157",
        "licenziamento", "MOROSITÀ", "RSSMRA70A01H501S",
    ]
    pages = prepared(spark.createDataFrame([(i, 1, x) for i, x in enumerate(texts)], "doc_id long, page int, text string"))
    plain = tuple(replace(d, literals=(), digit=False, words=()) for d in DETECTORS)
    found = [{tuple(r) for r in detect(pages, d).select("doc_id", "start", "end", "detector").collect()} for d in (plain, DETECTORS)]
    assert found[0] == found[1]
    assert {d.name for d in DETECTORS} == {d for *_, d in found[0]}
    assert all(d.literals or d.digit or d.words or d.name == "tax-code" for d in DETECTORS)
    # a text that does not hold what a detector wants is not looked at
    idle = tuple(replace(d, literals=("@@@",), digit=False, words=()) for d in DETECTORS)
    assert detect(pages.where("not contains(text, 'ſ') and not contains(text, 'ı') and not contains(text, 'İ')"), idle).isEmpty()
