"""The table of findings: its columns, and their defaults by category."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.rules.tables import CATEGORIES, DEFAULT_DECISION

COLUMNS = (
    "doc_id", "page", "seq", "start", "end", "text", "category", "band", "detector", "origin", "action", "decision",
    "default_decision", "proposed", "proposed_by", "confirmed", "modified", "note", "reason", "health_context",
    "proposal_key", "subject_key",
)
SCHEMA = (
    "doc_id long, page int, seq long, start int, end int, text string, category string, band string, detector string, "
    "origin string, action string, decision string, default_decision string, proposed boolean, proposed_by string, "
    "confirmed boolean, modified boolean, note string, reason string, health_context string, proposal_key string, "
    "subject_key string"
)


def looked_up(key: Column, table: dict[str, str]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def band_of(category: Column) -> Column:
    return looked_up(category, {k: row[0] for k, row in CATEGORIES.items()})


def is_person(category: Column) -> Column:
    return category.isin([k for k, row in CATEGORIES.items() if row[1]])


def keyed(df: DataFrame) -> DataFrame:
    """df, or an error where a row has no doc_id or page: joins would lose what is found there,
    and its text would stay in the clear."""
    known = F.col("doc_id").isNotNull() & F.col("page").isNotNull()
    return df.where(F.when(known, True).otherwise(F.raise_error(F.lit("a page has no doc_id or no number")).cast("boolean")))


def default_decision(band: Column) -> Column:
    """mask for bands A, B and M, keep for P, null (to be decided) for C."""
    return looked_up(band, DEFAULT_DECISION)


def constructed(df: DataFrame) -> DataFrame:
    """Findings with all columns from doc_id, page, seq, start, end, text, category, detector
    and, where they are present, note, proposal_key, subject_key, origin."""

    def own(name: str, default: Column) -> Column:
        return F.coalesce(F.col(name), default) if name in df.columns else default

    band = band_of(F.col("category"))
    same = F.when(
        F.col("category").isin("B1", "B2", "B3", "B4", "C6") & (F.col("text") != ""),
        F.concat("category", F.lit(":"), F.lower(F.regexp_replace("text", r"[\s\x{A0}\x{FEFF}\p{Z}]+", ""))),
    )
    nothing = F.lit(None).cast("string")
    made = {
        "band": band,
        "origin": own("origin", F.lit("automatic")),
        "action": looked_up(F.col("category"), {k: row[2] for k, row in CATEGORIES.items()}),
        "decision": default_decision(band),
        "default_decision": default_decision(band),
        "proposed": F.lit(False),
        "proposed_by": nothing,
        "confirmed": F.lit(False),
        "modified": F.lit(False),
        "note": own("note", F.lit("")),
        "reason": F.lit(""),
        "health_context": nothing,
        "proposal_key": own("proposal_key", F.col("category")),
        "subject_key": own("subject_key", same),
    }
    kinds = dict(x.split() for x in SCHEMA.split(", "))
    return df.withColumns(made).select(*[F.col(c).cast(kinds[c]).alias(c) for c in COLUMNS])
