"""What must not grow with the rows: work of Python for each row, looks that most rows do not need."""

import re
import time

import pyarrow as pa

from veilframe.functions import patterns
from veilframe.operators import context, detect, images, layer, layout, recognizer
from veilframe.plans import alike, pipeline
from veilframe.plans.folds import dicts
from veilframe.sources import files


class Caught:
    """A frame that keeps the function given to mapInArrow."""

    def select(self, *_):
        return self

    repartition = sortWithinPartitions = select

    def mapInArrow(self, run, _):
        self.run = run
        return self


def _passed(monkeypatch, module, make, batches):
    monkeypatch.setattr(module, "F", type("Any", (), {"col": staticmethod(lambda c: Any())}))
    frame = make(Caught())
    return list(frame.run(iter(batches)))


class Any:
    def cast(self, _):
        return self


def test_pieces_of_many_pages_come_in_one_batch(monkeypatch):
    monkeypatch.setattr(recognizer, "spread", lambda df: df, raising=False)
    pages = pa.RecordBatch.from_pydict({
        "doc_id": pa.array(range(1000), pa.int64()), "page": pa.array([1] * 1000, pa.int32()), "text": pa.array(["Il sig. Rossi"] * 999 + [None])
    })
    found = _passed(monkeypatch, recognizer, recognizer.chunks, [pages])
    assert len(found) == 1 and found[0].num_rows == 999


def test_drawing_operators_are_read_as_whole_columns(monkeypatch):
    ops = [("save", None), ("transform", [2.0, 0.0, 0.0, 2.0, 3.0, 4.0]), ("image", None), ("restore", None)] * 2500
    batch = pa.RecordBatch.from_pydict({
        "doc_id": pa.array([n // 4 for n in range(10_000)], pa.int64()), "page": pa.array([1] * 10_000, pa.int32()),
        "seq": pa.array([n % 4 for n in range(10_000)], pa.int64()), "op": pa.array([o for o, _ in ops]), "m": pa.array([m for _, m in ops], pa.list_(pa.float64())),
    })
    slow = time.perf_counter()
    rows = [batch.to_pylist() for _ in range(5)][0]
    fast = time.perf_counter()
    found = _passed(monkeypatch, images, images.painted, [batch] * 5)
    done = time.perf_counter()
    assert found[0].to_pylist() == [{"doc_id": r["doc_id"], "page": 1, "seq": 2, "m": [2.0, 0.0, 0.0, 2.0, 3.0, 4.0]} for r in rows if r["op"] == "image"]
    assert done - fast < fast - slow


def test_rows_by_way_of_numpy_are_the_rows():
    batch = pa.RecordBatch.from_pydict({
        "a": pa.array([1, None], pa.int32()), "b": pa.array(["x", None]), "c": pa.array([1.5, 2.5]), "d": pa.array([True, False]), "e": pa.array([b"x", None]),
        "f": pa.array([[1], None]), "g": pa.array([None, {"x": 1}]),
    })
    assert dicts(batch) == batch.to_pylist()
    assert [[type(v) for v in r.values()] for r in dicts(batch)] == [[type(v) for v in r.values()] for r in batch.to_pylist()]


def _plan(df, name="executedPlan"):
    return getattr(df._jdf.queryExecution(), name)().toString()


RUN = "doc_id long, page int, seg int, str string, x double, y double, w double, h double"


def test_runs_in_the_order_of_the_file_are_sorted_once(spark):
    runs = layout.placed_runs(spark.createDataFrame([(1, 1, 0, "abc", 50.0, 700.0, 15.0, 11.0)], RUN), reorder=False)
    assert _plan(runs).count("Sort [") == 1


def test_characters_of_an_area_are_looked_at_once(spark):
    runs = layout.placed_runs(spark.createDataFrame([(1, 1, 0, "abc", 50.0, 700.0, 15.0, 11.0), (1, 1, 1, "abc", 50.0, 686.0, 15.0, 11.0)], RUN), reorder=False)
    areas = spark.createDataFrame([(1, 1, 1, 54.0, 698.0, 12.0, 20.0)], "doc_id long, page int, request long, x double, y double, w double, h double")
    found = layout.spans_in(areas, runs)
    assert _plan(found, "optimizedPlan").count("sequence(") == 1
    assert [tuple(r) for r in found.collect()] == [(1, 1, 1, 1, 3, "bc")]


def test_touched_characters_side_by_side_are_one_interval(spark):
    runs = layout.placed_runs(spark.createDataFrame([(1, 1, 0, "abcdefghijk", 50.0, 700.0, 55.0, 11.0)], RUN), reorder=False)
    masks = [(1, 1, 1, 3, 5), (1, 1, 2, 8, 9)]
    found = spark.createDataFrame(masks, "doc_id long, page int, seq long, start int, end int").selectExpr("*", "'mask' AS decision")
    left = layer.clear_pieces(runs, found, layout.span_boxes(found, runs))
    assert sorted((r.start, r.end, r.text) for r in left.collect()) == [(0, 2, "ab"), (6, 7, "g"), (10, 11, "k")]
    assert "array_except" in _plan(left, "optimizedPlan")


def test_looks_are_held_by_every_alternative():
    assert patterns.literal(r"a\s+favore\s+di") == "favore" and patterns.literal(r"vice\s?sindac[oa]") == "sindac"
    assert patterns.literal(r"ab?c\p{L}{3,}x+yz") == "yz" and patterns.literal(r"ab|cd") == "" and patterns.literal(r"\b[^x\]]\d{12}\b") == ""
    assert patterns.literals(("minor[ei]", "minorenn[ei]", "figli[oa]")) == ("minor", "figli") and patterns.literals(("abc", r"\d+")) == ()


def test_keywords_are_looked_for_where_a_text_may_hold_them():
    for kind, (pattern, *_) in context.KINDS.items():
        assert context.LOOKS[pattern], kind
    # a user's pattern has no looks
    assert context.LOOKS.get(f"(?:{context.KINDS['minor'][0]}|tutelat[oa])") is None


def test_whole_page_patterns_wait_for_a_look(spark):
    schema = "doc_id long, page int, text string, is_scan boolean, ocr_conf double, n_cards int"
    rows = [(1, 1, "un testo", False, None, 0), (2, 1, "P<ITAROSSI<<MARIO<<<<<<<<<<1", False, None, 0), (3, 1, "poche parole", True, 90.0, 0),
            (4, 1, "PAſſAPORTO n. AB, repubblica italiana, ſtatura, cognome, nome, cittadinanza", False, None, 0)]
    found = detect.page_findings(spark.createDataFrame(rows, schema))
    assert _plan(found, "optimizedPlan").lower().count("contains(") >= 12
    assert sorted((r.doc_id, r.category) for r in found.collect()) == [(2, "B4P"), (3, "C7"), (4, "B4P")]


def test_envelopes_and_images_only_go_to_python(spark):
    png = b"\x89PNG\r\n\x1a\n\0\0\0\rIHDR\0\0\0\x02\0\0\0\x04"
    rows = [("a.pdf", b"%PDF-1.4"), ("b.p7m", b"0\x03abc"), ("c.png", png), ("d.p7m", None), ("e.pdf", png), ("f.pdf", None)]
    found = files.opened(spark.createDataFrame(rows, "path string, content binary"))
    assert "MapInArrow" not in _plan(found) and _plan(found).count("ArrowEvalPython") == 1
    told = {r.path: (r.document and bytes(r.document), r.error, r.page_width) for r in found.collect()}
    assert told == {
        "a.pdf": (b"%PDF-1.4", None, None), "b.p7m": (None, "not signed data", None), "c.png": (png, None, 420.945), "d.p7m": (None, "not recognised", None),
        "e.pdf": (png, None, 420.945), "f.pdf": (None, "not recognised", None),
    }


def test_copies_of_a_document_are_analysed_once(spark, monkeypatch):
    seen = []

    def looked(pages, *rest):
        seen.append(pages.count())
        return detect.detect(pages, *rest)

    monkeypatch.setattr(pipeline, "detect", looked)
    text = "Si liquida a favore di Mario Rossi, cell. 347 1234567, la somma di euro 500."
    rows = [(i, 1, text) for i in range(8)] + [(8, 2, text), (9, 1, text), (9, 2, "Rossi"), (10, 1, text + " "), (11, 1, None), (12, 1, None)]
    pages = spark.createDataFrame(rows, "doc_id long, page int, text string")
    at = text.index("Mario")
    names = spark.createDataFrame([(i, 1 if i != 8 else 2, at, at + 11, 0.99) for i in (*range(6), 8, 9, 10)], "doc_id long, page int, start int, end int, score double")
    few = sorted(map(str, pipeline.analysed(pages, names, "publish").collect()))
    monkeypatch.setattr(alike, "SHARE", 2.0)
    all_ = sorted(map(str, pipeline.analysed(pages, names, "publish").collect()))
    assert seen == [7, 14]  # texts 0 to 5, 6 and 7 (no name), 8, 9 (two pages), 10, 11 and 12
    assert few == all_ and len(few) >= 20


def test_keywords_are_looked_for_on_pages_with_names_only(spark, monkeypatch):
    seen = []

    def looked(pages, kinds, run=context._keywords):
        seen.append(sorted(r.doc_id for r in pages.collect()))
        return run(pages, kinds)

    monkeypatch.setattr(context, "_keywords", looked)
    text = "Il minore Mario Rossi frequenta la scuola."
    pages = detect.prepared(spark.createDataFrame([(1, 1, text), (2, 1, text), (3, 1, None)], "doc_id long, page int, text string"))
    names = spark.createDataFrame([(2, 1, 7, 10, 21), (2, 1, 8, 10, 15)], "doc_id long, page int, seq long, start int, end int")
    pairs, _ = context._pairs(pages, names, context.KINDS)
    assert seen == [[2]] and {(r.doc_id, r.kind, r.seq) for r in pairs.collect()} == {(2, "minor", 7), (2, "minor", 8)}


def test_long_pages_are_not_looked_at_for_identity_documents(spark):
    text = "CARTA D'IDENTITA' cognome nome nato il scadenza comune di rilasciata firma del titolare\nC<ITAROSSI<<MARIO<<<<<<<<<<<<<<<<<<<<<<<<<<<<<\n"
    rows = [(1, 1, text, False, None, 0), (2, 1, text + "x" * 1500, False, None, 0)]
    found = detect.page_findings(spark.createDataFrame(rows, "doc_id long, page int, text string, is_scan boolean, ocr_conf double, n_cards int"))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"Filter CASE WHEN \(is_scan#\d+ OR \(\(length\(text#\d+\) <= 1500\)", plan)
    assert 2 not in [r.doc_id for r in found.collect()]
