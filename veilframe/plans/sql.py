"""For SQL users: findings as views over a view of pages, detection and checks as functions."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from veilframe.functions.patterns import clean, shadow
from veilframe.functions.sqltext import sql_text
from veilframe.functions.validators import VALIDATORS, amount, birth_date, name_key
from veilframe.operators.detect import DETECTORS, Detector, steps
from veilframe.operators.names import surname
from veilframe.operators.redact import OMISSIS, redacted
from veilframe.operators.report import band_c, certainty_tally, header, treated
from veilframe.plans.pipeline import analysed


def register(spark: SparkSession, pages: str, purpose: str | None = None, mode: str = OMISSIS, entities: str | None = None, prefix: str = "") -> None:
    """Makes views of what the pages (a table or view with doc_id, page, text) hold: findings,
    redacted, report_header, report_treated, report_decisions, report_certainty, each name with
    the prefix. entities: a table or view of a recognizer's names."""
    rows = spark.table(pages)
    found = analysed(rows, spark.table(entities) if entities else None, purpose)
    made = {
        "findings": found, "redacted": redacted(rows, found, mode), "report_treated": treated(found), "report_decisions": band_c(found),
        "report_certainty": certainty_tally(found), "report_header": header(rows, found, purpose, mode),
    }
    for name, df in made.items():
        df.createOrReplaceTempView(prefix + name)


def _scalar(spark: SparkSession, name: str, kind: str, value: Column) -> None:
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(value STRING) RETURNS {kind} RETURN {sql_text(value)}")


def register_functions(spark: SparkSession, detectors: tuple[Detector, ...] = DETECTORS, as_of: str | None = None, prefix: str = "") -> None:
    """Makes temporary functions, each name with the prefix:

    detect_spans(text), a table function for lateral joins: start, end, text, category, detector,
    proposal_key of every span that the detectors find, validated, trimmed and grown to clauses as
    in an analysis, before overlaps are resolved and persons looked at. Null gives no rows.

    is_tax_code, is_iban, is_payment_card, is_vat_number, is_birth_date, is_personal_email:
    false for null. name_key, surname, amount_of: null where there is none.

    All are expressions of built-in functions, so a query over them is planned as a whole."""
    value = F.col("value")
    checks = {
        "is_tax_code": VALIDATORS["tax_code"](value), "is_iban": VALIDATORS["iban"](value), "is_payment_card": VALIDATORS["luhn"](value),
        "is_vat_number": VALIDATORS["vat_number"](value), "is_birth_date": birth_date(value, as_of), "is_personal_email": VALIDATORS["personal_email"](value),
    }
    for name, check in checks.items():
        _scalar(spark, prefix + name, "BOOLEAN", F.coalesce(check, F.lit(False)))
    _scalar(spark, f"{prefix}name_key", "STRING", name_key(value))
    _scalar(spark, f"{prefix}surname", "STRING", surname(value))
    _scalar(spark, f"{prefix}amount_of", "DECIMAL(38,2)", amount(value).cast("decimal(38,2)"))

    by = steps(detectors, as_of)

    def listed(columns: dict[str, Column]) -> str:
        return ", ".join(f"{sql_text(c)} AS `{n}`" for n, c in columns.items())

    made = f"SELECT {sql_text(clean(F.col('text')))} AS text FROM (SELECT {prefix}detect_spans.text AS text)"
    made = f"SELECT text, {sql_text(shadow(F.col('text')))} AS shadow FROM ({made})"
    made = f"SELECT {listed(by.window)} FROM (SELECT text, shadow, explode({sql_text(by.every)}) AS m FROM ({made}))"
    made = f"SELECT * FROM (SELECT *, {listed(by.looks)} FROM ({made})) WHERE {sql_text(by.going)}"
    made = f"SELECT * EXCEPT (`start`, `end`), {listed(by.placed)} FROM ({made})"
    made = f"SELECT *, {sql_text(by.own)} AS own FROM ({made})"
    kept = {c: by.out[c] for c in ("start", "end", "text", "category", "detector", "proposal_key")}
    made = f"SELECT {listed(kept)} FROM ({made}) WHERE {sql_text(by.valid)}"
    columns = "`start` INT, `end` INT, text STRING, category STRING, detector STRING, proposal_key STRING"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}detect_spans(text STRING) RETURNS TABLE({columns}) RETURN {made}")
