"""All detectors over whole documents, on a small table with findings known by hand."""

from collections import Counter

import duckdb

from veilframe import page_queries, queries

#: text, (what is found, category); no recognizer, so nothing is demoted for want of a name
DOCUMENTS = [
    ("Permessi ai sensi della legge 104/1992.", [("Permessi ai sensi della legge 104/1992", "A1")]),
    ("C.F. RSSMRA85T10A562S e RSSMRA85T10A562X.", [("RSSMRA85T10A562S", "B1")]),
    ("IBAN IT60 X054 2811 1010 0000 0123 456 BANCA.", [("IT60 X054 2811 1010 0000 0123 456", "B2")]),
    ("P. IVA 00743110157 della società ALFA s.r.l.", [("00743110157", "C6")]),
    ("Scrivere a mario.rossi@gmail.com o protocollo@comune.messina.it.", [("mario.rossi@gmail.com", "B3")]),
    ("Carta 4111 1111 1111 1111 scaduta.", [("4111 1111 1111 1111", "B2")]),
    ("Nothing to be found in here.", []),
    ("", []),
    (None, []),
]


def test_all_detectors_run_over_documents(spark, tmp_path):
    long = " ".join(["The river flows on and on."] * 200)
    texts = [t if i % 2 else t and f"{long}\n\n{t}\n\n{long}" for i, (t, _) in enumerate(DOCUMENTS)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = queries.document_findings(spark, str(tmp_path)).collect()
    expected = Counter((i, text, category, texts[i].index(text)) for i, (_, found) in enumerate(DOCUMENTS) for text, category in found)
    assert Counter((r.doc_id, r.text, r.category, r.start) for r in rows) == expected
    graded = queries.certainty_report(spark, str(tmp_path)).collect()
    assert sum(r.n for r in graded) == sum(expected.values())
    assert len(graded) > 1 and {r.certainty for r in graded} <= {"formal", "contextual", "statistical"}


def test_masks_over_blanks_agree_with_sql(spark, tmp_path):
    """A mask over blanks only is none, and a piece of any of Unicode's blanks is no piece."""
    wide = "\u2003" * 9
    texts = ["a\nb         c\nd", f"a\nb{wide}c\nd", f"a\nbcdefghijk   \nd\n{wide}\n{wide}", "a\nb  \n\n\nc\nd", f"a\nbcdefghij{wide}\n{wide}\nx", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    for name in ("document_clear_text", "document_boxes"):
        told = db.execute(page_queries.ORACLE_SQL[name])
        columns = [d[0] for d in told.description]
        rows = page_queries.QUERIES[name](spark, str(tmp_path)).collect()
        assert sorted(told.fetchall()) == sorted(tuple(r[c] for c in columns) for r in rows), name
