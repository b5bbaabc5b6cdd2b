"""The report of each document, from its header to the statement, as one text."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilframe.operators.decide import certainty
from veilframe.operators.findings import is_person
from veilframe.operators.redact import FULL, OMISSIS, PSEUDONYM, dropped_pages, outcomes
from veilframe.operators.report import header
from veilframe.operators.scans import document_kinds

#: Of the tables in rules/.
RULES_VERSION = "3"
#: Resolutions of redacted pages, in dots an inch.
RESOLUTIONS = (150, 200, 300)
STATEMENT = (
    "What is masked was found by rules and by the decisions told above. Automatic findings can be wrong or incomplete; "
    "whoever publishes the document answers for its content."
)
NONE = "none"


def default_mode(purpose: str | None) -> str:
    """Published acts keep a readable sentence; whatever else is made is masked in full."""
    return OMISSIS if purpose == "publish" else FULL


@dataclass(frozen=True)
class Settings:
    purpose: str | None = "publish"
    #: None: the purpose's.
    mode: str | None = None
    body: str = ""
    dpi: int = 200
    made_at: str = ""

    def __post_init__(self) -> None:
        if self.dpi not in RESOLUTIONS:
            raise ValueError(f"the resolution is one of {RESOLUTIONS}")
        if self.masked not in (FULL, OMISSIS, PSEUDONYM):
            raise ValueError(f"there is no mode {self.mode}")

    @property
    def masked(self) -> str:
        return self.mode or default_mode(self.purpose)


def full_header(pages: DataFrame, findings: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """header() with dropped (page numbers), kind, ocr_conf, quality, body, dpi, rules, made_at; a
    document is native where its pages don't tell whether they are scans."""
    plain = {"is_scan": F.lit(False), "ocr_conf": F.lit(None).cast("double")}
    pages = pages.withColumns({k: v for k, v in plain.items() if k not in pages.columns})
    gone = dropped_pages(findings).groupBy("doc_id").agg(F.array_join(F.sort_array(F.collect_set("page")), ", ").alias("dropped"))
    rows = header(pages, findings, settings.purpose, settings.masked).join(document_kinds(pages), "doc_id").join(gone, "doc_id", "left")
    own = {"body": settings.body, "dpi": settings.dpi, "rules": RULES_VERSION, "made_at": settings.made_at}
    return rows.withColumns({"dropped": F.coalesce("dropped", F.lit("")), **{k: F.lit(v) for k, v in own.items()}})


def _by() -> Column:
    return F.when(F.col("modified"), "changed by the user").when(F.col("confirmed"), "confirmed").when(F.col("proposed"), "proposed")


def lines(findings: DataFrame, mode: str) -> DataFrame:
    """doc_id, nr and, for each finding in reading order, its line of the table (row), of the list
    of band C (decided: what is masked is not told, what stays is quoted, with notes and reasons)
    and of the restored ones (restored); null where it has none. A masked person's label is
    person."""
    order = Window.partitionBy("doc_id").orderBy("page", F.coalesce("start", F.lit(-1)), "seq")
    told = outcomes(findings)
    rows = findings.withColumn("certainty", certainty(findings)).join(told, ["doc_id", "page", "seq"]).withColumn("nr", F.row_number().over(order))
    masked = F.col("decision") == "mask"
    page, kept = F.concat(F.lit("page "), F.col("page")), F.concat(F.lit('"'), F.col("text"), F.lit('"'))
    person = F.when(masked & (F.lit(mode) == PSEUDONYM) & is_person(F.col("category")) & F.col("subject_no").isNotNull(), F.concat(F.lit("[SUBJECT "), F.col("subject_no"), F.lit("]")))
    kind = F.concat("category", F.when(F.col("origin") == "automatic", "").otherwise(F.concat(F.lit(" ("), F.col("origin"), F.lit(")"))))
    outcome = F.concat("outcome", F.when(F.col("covered"), " (covered by another mask)").otherwise(""), F.when(F.col("modified"), ", changed").otherwise(""))
    said = F.when(masked, F.coalesce(person, F.lit("(masked text)"))).otherwise(kept)
    decision = F.concat(F.coalesce("decision", F.lit("open")), F.coalesce(F.concat(F.lit(" ("), _by(), F.lit(")")), F.lit("")))
    why = F.col("rationale") if "rationale" in findings.columns else F.lit("")
    filled = lambda c: F.nullif(c, F.lit(""))
    return rows.select(
        "doc_id", "nr",
        F.concat_ws(" | ", F.col("nr").cast("string"), page, kind, "detector", "certainty", outcome).alias("row"),
        F.when(F.col("band") == "C", F.concat_ws(" | ", page, "category", said, decision, filled(F.col("note")), filled(F.col("reason")))).alias("decided"),
        F.when((F.col("decision") == "keep") & F.col("modified"), F.concat_ws(" | ", page, F.concat("category", F.lit(" (band "), F.col("band"), F.lit(")")), kept, filled(why))).alias("restored"),
        person.alias("person"), F.when(person.isNotNull(), F.col("subject_no")).alias("subject_no"),
    )


def rendered(pages: DataFrame, findings: DataFrame, settings: Settings = Settings(), cited: DataFrame | None = None) -> DataFrame:
    """doc_id, report: header, all findings, decisions of band C, what a user restored, persons'
    labels, sources (cited: what legal.cited gives), statement; empty sections say none. Documents
    without findings have a report. One document's report is one text."""

    def of(name: str) -> Column:
        """The lines that are not null, in order."""
        rows = F.sort_array(F.collect_list(F.when(F.col(name).isNotNull(), F.struct("nr", name))))
        return F.array_join(F.transform(rows, lambda r: r[name]), "\n").alias(f"all_{name}")

    persons = F.sort_array(F.collect_set(F.when(F.col("person").isNotNull(), F.struct("subject_no", "person"))))
    sections = lines(findings, settings.masked).groupBy("doc_id").agg(
        of("row"), of("decided"), of("restored"), F.array_join(F.transform(persons, lambda p: p["person"]), ", ").alias("all_person")
    )
    rows = full_header(pages, findings, settings).join(sections, "doc_id", "left")
    if cited is not None:
        line = F.concat_ws(" ", F.concat(F.col("title"), F.lit(":")), "ref")
        sources = cited.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("nr", line.alias("line")))).alias("s"))
        rows = rows.join(sources.select("doc_id", F.array_join(F.transform("s", lambda x: x["line"]), "\n").alias("all_source")), "doc_id", "left")
    shown = lambda c: F.coalesce(F.nullif(c, F.lit("")), F.lit(NONE))
    head = {
        "made": F.col("made_at"), "document": F.col("doc_id").cast("string"), "pages": F.col("n_pages").cast("string"), "dropped pages": F.col("dropped"),
        "kind": F.col("kind"), "quality": F.col("quality"), "purpose": F.col("purpose"), "body": F.col("body"), "mode": F.col("mask_mode"),
        "dots an inch": F.col("dpi").cast("string"), "rules": F.col("rules"),
    }
    parts = [F.lit("# Report of treatment"), *[F.concat(F.lit(f"{k}: "), shown(v)) for k, v in head.items()]]
    titles = {"Findings": "all_row", "Decisions of band C": "all_decided", "Restored": "all_restored", "Persons": "all_person"}
    titles |= {"Sources": "all_source"} if cited is not None else {}
    for title, column in titles.items():
        parts += [F.lit(f"## {title}"), shown(F.col(column))]
    return rows.select("doc_id", F.concat_ws("\n", *parts, F.lit("## Statement"), F.lit(STATEMENT)).alias("report"))


def write_reports(reports: DataFrame, path: str, folders: int = 64) -> None:
    """Reports as Parquet in folders by a hash of the document, so that one is found by reading
    one folder, however many there are."""
    dealt = reports.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(folders)))
    dealt.repartition("part").write.partitionBy("part").mode("overwrite").option("compression", "zstd").parquet(path)
