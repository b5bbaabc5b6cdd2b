"""From pages to decided findings: the stages in their order, which matters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.operators.contacts import institutional, is_contact
from veilframe.operators.context import KINDS, classified
from veilframe.operators.decide import proposed
from veilframe.operators.detect import DETECTORS, STRIDE, Detector, detect, page_findings, prepared, signature_findings
from veilframe.operators.findings import constructed, keyed
from veilframe.operators.layout import span_boxes
from veilframe.operators.names import name_findings
from veilframe.operators.overlap import resolved
from veilframe.operators.silence import demoted, silenced
from veilframe.operators.subjects import coherent, numbered, reconciled, variants
from veilframe.plans.alike import for_all, members, only_firsts
from veilframe.plans.staging import spread, staged


def analysed(
    pages: DataFrame,
    entities: DataFrame | None = None,
    purpose: str | None = None,
    detectors: tuple[Detector, ...] = DETECTORS,
    as_of: str | None = None,
    images: DataFrame | None = None,
    purposes: DataFrame | None = None,
    kinds: dict = KINDS,
    runs: DataFrame | None = None,
) -> DataFrame:
    """Findings of pages (doc_id, page, text; is_scan, ocr_conf, n_cards, top, page_height if
    there are any), with subject_no.

    entities: a recognizer's names (doc_id, page, start, end, score). Without a recognizer
    (None) keyword findings are neither silenced nor demoted for want of a name; a recognizer
    that found nothing is an empty table. images (doc_id, page, x, y, w, h, page_width,
    page_height) of pages that are no scans may be signatures. purposes: a user's table beside
    the given ones (see proposed); runs: the placed runs that the texts were read from (see
    layout.placed_runs), which tell where contacts stand; detectors and kinds may come from tables (see rules.user).

    Null keys and two pages of one doc_id and number are errors: neither could be told apart
    when spans and texts meet again.

    Documents are analysed each by itself, so where most of them are copies of others (same
    pages, same entities) one of each content is, and its findings are those of all (see
    plans.alike). With images or runs all documents are analysed."""
    plain = {"is_scan": F.lit(False), "ocr_conf": F.lit(None).cast("double"), "n_cards": F.lit(0)}
    pages = pages.withColumns({k: v for k, v in plain.items() if k not in pages.columns})
    layout = [c for c in ("top", "page_height") if c in pages.columns]
    pages, entities = keyed(pages), None if entities is None else staged(entities, "entities")
    alike = members(pages, entities, [*plain, *layout])
    alike = alike if images is None and runs is None else None
    if alike is not None:
        pages, entities = only_firsts(pages, alike), None if entities is None else only_firsts(entities, alike)
    pages = staged(prepared(spread(pages)).select("doc_id", "page", "text", "shadow", *plain, *layout), "pages")
    found = detect(pages, detectors, as_of).unionByName(page_findings(pages), allowMissingColumns=True)
    if images is not None:
        signed = signature_findings(images.drop("is_scan").join(pages.select("doc_id", "page", "is_scan"), ["doc_id", "page"]))
        found = found.unionByName(signed, allowMissingColumns=True)
    if entities is not None:
        found = found.unionByName(name_findings(pages, entities, 100 * STRIDE), allowMissingColumns=True)
    rows = staged(classified(pages, staged(resolved(constructed(found)), "found"), kinds), "classified")
    rows = staged(coherent(reconciled(rows)), "coherent")
    more = staged(variants(pages, rows, 200 * STRIDE), "variants")
    if not more.isEmpty():
        rows = staged(classified(pages, rows.unionByName(more), kinds), "classified")
        rows = coherent(rows)
    rows = staged(resolved(rows), "resolved")
    if entities is not None:
        rows = demoted(pages, silenced(rows))
    boxes = span_boxes(rows.where(is_contact()), runs) if runs is not None else None
    rows = staged(institutional(pages, rows, boxes), "contacts")
    rows = numbered(reconciled(rows))
    rows = proposed(rows, purpose, purposes) if purpose else rows
    return rows if alike is None else for_all(staged(rows, "firsts"), alike)
