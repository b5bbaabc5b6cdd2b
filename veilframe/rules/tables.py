"""Rules as small tables: categories, purposes, context kinds, certainty grades."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: category: band, concerns a person's name, action, clause extension before and after
CATEGORIES = {
    "A1": ("A", False, "mask", 40, 70),
    "A2": ("A", False, "mask", 30, 50),
    "A3": ("A", False, "mask", 30, 50),
    "A4": ("A", False, "mask", 30, 50),
    "B1": ("B", False, "mask", 0, 0),
    "B2": ("B", False, "mask", 0, 0),
    "B3": ("B", False, "mask", 0, 0),
    "B4": ("B", False, "mask", 0, 0),
    "B4P": ("B", False, "drop", 0, 0),
    "B5": ("B", False, "mask", 0, 0),
    "B6": ("B", False, "mask", 0, 0),
    "B7": ("B", True, "mask", 0, 0),
    "B8": ("B", True, "mask", 0, 0),
    "C1": ("C", True, "mask", 0, 0),
    "C2": ("C", True, "mask", 0, 0),
    "C3": ("C", False, "mask", 20, 60),
    "C4": ("C", False, "mask", 20, 60),
    "C5": ("C", False, "mask", 20, 60),
    "C6": ("C", False, "mask", 0, 0),
    "C7": ("C", False, "mask", 0, 0),
    "C8": ("C", False, "mask", 40, 70),
    "P": ("P", True, "mask", 0, 0),
    "M": ("M", False, "mask", 0, 0),
}
#: Whether a finding that is restored wants a reason; the other categories have none.
REASON_NEEDED = {
    "A1": "required", "A2": "required", "A3": "required", "A4": "required", "B1": "optional", "B2": "optional", "B3": "optional",
    "B4": "optional", "B4P": "optional", "B5": "optional", "B6": "optional", "B7": "optional", "B8": "required",
}
PRIORITY = {"M": 5, "A": 4, "B": 3, "C": 2, "P": 1}
DEFAULT_DECISION = {"A": "mask", "B": "mask", "M": "mask", "P": "keep"}
PERSONS = tuple(c for c, row in CATEGORIES.items() if row[1])

#: What each purpose proposes for findings of band C; keys that are missing get no proposal.
PURPOSES = {
    "publish": {
        "C1": "mask", "C1_contractor": "keep", "C2_above": "keep", "C2_below": "mask", "C2_health": "mask", "C3": "mask",
        "C4": "mask", "C5": "mask", "C6": "mask", "C6_company": "keep", "C8": "mask",
    },
    "private": {
        "C1": "mask", "C1_contractor": "mask", "C2_above": "mask", "C2_below": "mask", "C2_health": "mask", "C3": "mask",
        "C4": "mask", "C5": "mask", "C6": "mask", "C6_company": "keep", "C8": "mask",
    },
}
REASONS = {
    "C1": "no duty to publish this name was recognised",
    "C1_contractor": "contractor or appointee",
    "C2_above": "benefit above 1000 euro",
    "C2_below": "benefit not above 1000 euro",
    "C2_health": "the benefit reveals health or hardship",
    "C3": "judicial data",
    "C4": "economic or social hardship",
    "C5": "employment relation",
    "C6": "VAT number of unknown nature",
    "C6_company": "VAT number of a company or body",
    "C7": "page that cannot be read automatically",
    "C8": "health reference without a person nearby",
}

#: Certainty of a detector's findings; others are statistical.
CERTAINTY = {
    "formal": ("tax-code", "health-card", "iban", "payment-card", "vat-number"),
    "contextual": (
        "bank-account", "landline", "email", "residence", "residence-form", "id-document", "birth", "birth-date-form",
        "birth-date", "marital-status", "household", "name-declarant", "name-titled", "identity-page",
    ),
    "manual": ("manual", "manual-text"),
}

#: Weight of a qualification that spreads to a person's other occurrences.
WEIGHTS = {"B8": 7, "B7": 6, "P": 5, "C2_health": 4, "C2_below": 3, "C2_above": 2, "C1_contractor": 1}
THRESHOLD = 1000
MIN_SCORE, MIN_SCORE_LOWER, MIN_NAME = 0.55, 0.9, 3
SILENCED, NAME_RADIUS, HEALTH_RADIUS, HEALTH_LINES = ("C3", "C4", "C5"), 300, 400, 6


def purposes(spark: SparkSession) -> DataFrame:
    """purpose, proposal_key, decision, reason."""
    rows = [(p, k, d.get(k), REASONS[k]) for p, d in PURPOSES.items() for k in REASONS]
    return spark.createDataFrame(rows, "purpose string, proposal_key string, decision string, reason string")
