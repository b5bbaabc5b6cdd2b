"""Queries over whole tables for the span engine's operators, and their SQL for DuckDB.

Expected results on template texts come from the structured columns, not from patterns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.functions import validators as v
from veilframe.functions.patterns import clean, matches
from veilframe.operators.decide import certainty, decided
from veilframe.operators.names import entities_of, surname
from veilframe.operators.overlap import gaps, merged
from veilframe.operators.redact import OMISSIS, PSEUDONYM, outcomes, redacted
from veilframe.operators.report import band_c, certainty_tally, header, treated
from veilframe.plans.pipeline import analysed
from veilframe.rules import fixed
from veilframe.rules.tables import CERTAINTY
from veilframe.sources import cases, templates as t

Query = Callable[[SparkSession, str], DataFrame]
NO_DIV = t.NAME.replace("(o_custkey DIV 10)", "(o_custkey // 10)")


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pattern(name: str) -> tuple[str, bool]:
    return next((p, i) for n, _, p, i, _ in fixed.PATTERNS if n == name)


def email_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal e-mail addresses in documents."""
    found = F.explode(matches(clean(F.col("text")), *_pattern("email"))).alias("m")
    rows = _read(spark, sf_dir, "documents").select("doc_id", found)
    return rows.where(v.personal_email(F.col("m.text"))).groupBy("doc_id", F.lower("m.text").alias("address")).agg(F.count("*").alias("n"))


def card_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Valid card numbers in documents, with their places."""
    found = F.explode(matches(clean(F.col("text")), *_pattern("payment-card"))).alias("m")
    rows = _read(spark, sf_dir, "documents").select("doc_id", found).where(v.luhn(F.col("m.text")))
    return rows.select("doc_id", F.col("m.start").cast("long").alias("start"), v.digits(F.col("m.text")).alias("digits"))


def iban_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Account numbers made from customers, with right and wrong check digits."""
    code = "concat('IT', lpad(CAST(c_custkey % 97 + 2 AS STRING), 2, '0'), 'X0542811101', lpad(CAST(c_custkey AS STRING), 12, '0'))"
    rows = _read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.expr(code).alias("code"))
    return rows.select("id", "code", v.iban(F.col("code")).alias("valid"))


def tax_code_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tax codes made from customers: every check letter in turn."""
    code = (
        "concat('RSSMRA', lpad(CAST(c_custkey % 100 AS STRING), 2, '0'), 'T', lpad(CAST(c_custkey % 80 AS STRING), 2, '0'), "
        "'A', lpad(CAST(c_custkey % 1000 AS STRING), 3, '0'), chr(65 + CAST(c_custkey % 26 AS INT)))"
    )
    rows = _read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.expr(code).alias("code"))
    return rows.select("id", "code", v.tax_code(F.col("code")).alias("valid"))


def vat_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """VAT numbers made from customers."""
    rows = _read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.lpad((F.col("c_custkey") * 7919).cast("string"), 11, "0").alias("code"))
    return rows.select("id", "code", v.vat_number(F.col("code")).alias("valid"))


def amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amounts written like 1.234,56 and read back."""
    cents = F.col("o_totalprice").cast("decimal(18,2)")
    written = F.translate(F.format_number(cents, 2), ",.", ".,")
    rows = _read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), v.amount(written).alias("value"))
    return rows.select("id", F.round(F.col("value").cast("double") * 100).cast("long").alias("cents"), (F.col("value") <= 1000).alias("below"))


def surnames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Surnames and keys of names in both orders and with particles."""
    name = f"CASE o_orderkey % 3 WHEN 0 THEN {t.NAME} WHEN 1 THEN upper({t.NAME}) ELSE concat('Nicolò De ', {t.pick(t.LAST, 'o_custkey % 10')}) END"
    rows = _read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.expr(name).alias("name"))
    return rows.select("id", surname(F.col("name")).alias("surname"), v.name_key(F.col("name")).alias("name_key"))


def masked_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals of order lines merged, and what they leave."""
    start = (F.col("l_partkey") % 90).cast("int")
    one = F.struct(start.alias("start"), (start + F.col("l_quantity").cast("int") % 20 + 1).alias("end"))
    rows = _read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_list(one).alias("spans"))
    rows = rows.withColumn("masks", merged(F.col("spans"))).withColumn("left", gaps(F.col("masks"), F.lit(120)))
    width = F.aggregate("masks", F.lit(0), lambda n, x: n + x["end"] - x["start"])
    return rows.select("id", F.size("masks").cast("long").alias("n_masks"), width.cast("long").alias("n_masked"), F.size("left").cast("long").alias("n_gaps"))


def _found(spark: SparkSession, sf_dir: str, pages: DataFrame, purpose: str) -> DataFrame:
    return analysed(pages, entities_of(pages, t.names(spark, sf_dir)), purpose)


def _placed(found: DataFrame) -> DataFrame:
    return found.select("doc_id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "text", "category", "proposal_key", "decision")


def payee_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payees above and below the threshold (D32, D33, J1, C1o, J9)."""
    return _placed(_found(spark, sf_dir, t.payments(spark, sf_dir), "publish"))


def qualified_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Minors, public roles, third parties, contractors, fees, others (D24, J1, J3, C1o, C2o)."""
    return _placed(_found(spark, sf_dir, t.sentences(spark, sf_dir), "publish"))


def private_purpose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions under the other purpose, by proposal key (C2o, G6)."""
    found = _found(spark, sf_dir, t.sentences(spark, sf_dir), "private")
    return found.groupBy("category", "proposal_key", "decision").agg(F.count("*").alias("n"))


def redacted_payments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payments with masked payees as numbered persons."""
    pages = t.payments(spark, sf_dir)
    return redacted(pages, _found(spark, sf_dir, pages, "publish"), PSEUDONYM).select("doc_id", "redacted_text")


def decision_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log that keeps every payee of even orders and then masks every fourth again (C3o-C6o)."""
    pages = t.payments(spark, sf_dir)
    found = _found(spark, sf_dir, pages, "publish")
    orders = _read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"))
    even = orders.where("doc_id % 2 = 0").select("doc_id", F.lit(1).alias("step"), F.lit("category").alias("op"), F.lit("C2").alias("target"), F.lit("keep").alias("decision"))
    fourth = orders.where("doc_id % 4 = 0").select("doc_id", F.lit(2).alias("step"), F.lit("category").alias("op"), F.lit("C2").alias("target"), F.lit("mask").alias("decision"))
    rows = decided(found, even.unionByName(fourth))
    return redacted(pages, rows.withColumn("subject_no", F.lit(None).cast("int")), OMISSIS).select("doc_id", "redacted_text")


def _document_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "documents").select("doc_id", F.lit(1).alias("page"), "text")


def document_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of all detectors over whole documents, without a recognizer."""
    return _placed(analysed(_document_pages(spark, sf_dir), purpose="publish"))


def certainty_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of all detectors by grade of certainty over all documents."""
    found = analysed(_document_pages(spark, sf_dir))
    return certainty_tally(found).groupBy("certainty").agg(F.sum("n").alias("n"))


def contact_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mobiles, landlines, residences, addresses, e-mails, and what is none."""
    return _placed(analysed(cases.pages(spark, sf_dir, cases.CONTACTS), purpose="publish"))


def identifier_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tax codes, health cards, accounts, cards, documents, VAT numbers."""
    return _placed(analysed(cases.pages(spark, sf_dir, cases.IDENTIFIERS), purpose="publish"))


def civil_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Births, forms, marital status, households, declarants and titled names."""
    return _placed(analysed(cases.pages(spark, sf_dir, cases.CIVIL), purpose="publish"))


def sensitive_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyword bands grown to clauses, with a name nearby or silenced and demoted without
    (D1-D4, D25, F6, J4, J5)."""
    pages = cases.pages(spark, sf_dir, cases.SENSITIVE)
    return _placed(analysed(pages, entities_of(pages, cases.names(spark, sf_dir)), "publish"))


def institutional_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contacts of offices, companies, holders of roles and persons."""
    pages = cases.pages(spark, sf_dir, cases.BODIES)
    found = analysed(pages, purpose="publish")
    return _placed(found.where(F.col("detector").isin("landline", "address", "email")))


def letterhead_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contacts in the heads of pages, which are a body's only where one is named."""
    pages = cases.pages(spark, sf_dir, cases.LETTERHEADS).withColumn("top", F.lit(820.0))
    return _placed(analysed(pages, purpose="publish"))


def same_persons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Surnames with another apostrophe take the qualification of the full name."""
    pages = cases.persons(spark, sf_dir)
    found = analysed(pages, entities_of(pages, cases.names(spark, sf_dir, cases.FULL)), "publish")
    return found.select(
        "doc_id", F.col("start").cast("long").alias("start"), "text", "category", "proposal_key", "decision", F.col("subject_no").cast("long").alias("subject_no")
    )


def page_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identity pages, dropped, and unreadable scans, to be decided."""
    found = analysed(cases.scans(spark, sf_dir), purpose="publish")
    told = found.select("doc_id", "page", "seq", "category", "decision", certainty(found).alias("certainty"))
    return told.join(outcomes(found), ["doc_id", "page", "seq"]).select("doc_id", "category", "decision", "certainty", "outcome", "covered")


def report_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document: pages, findings, masked, open, to be confirmed."""
    pages = cases.pages(spark, sf_dir, cases.IDENTIFIERS)
    made = header(pages, analysed(pages, purpose="publish"), "publish", OMISSIS)
    return made.select("doc_id", *[F.col(c).cast("long").alias(c) for c in ("n_pages", "n_dropped", "n_findings", "n_masked", "n_open", "n_to_confirm")], "ready")


def treated_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masked findings in order with their grades, after a confirmation of every even document (Q3, C6o)."""
    pages = cases.pages(spark, sf_dir, cases.IDENTIFIERS)
    even = pages.where("doc_id % 2 = 0").select(
        "doc_id", F.lit(1).alias("step"), F.lit("confirm").alias("op"), F.lit("").alias("target"), F.lit(None).cast("string").alias("decision")
    )
    rows = treated(decided(analysed(pages, purpose="publish"), even))
    return rows.select("doc_id", F.col("nr").cast("long").alias("nr"), "category", "detector", "certainty")


def confirmations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Band C by who decided, after a confirmation of every even document (Q5, C6o)."""
    pages = cases.pages(spark, sf_dir, cases.IDENTIFIERS)
    even = pages.where("doc_id % 2 = 0").select(
        "doc_id", F.lit(1).alias("step"), F.lit("confirm").alias("op"), F.lit("").alias("target"), F.lit(None).cast("string").alias("decision")
    )
    rows = band_c(decided(analysed(pages, purpose="publish"), even))
    return rows.groupBy("category", "proposal_key", "decision", "by").agg(F.sum("count").alias("n"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        email_findings, card_findings, iban_checks, tax_code_checks, vat_checks, amounts, surnames, masked_intervals,
        payee_findings, qualified_names, private_purpose, redacted_payments, decision_log, document_findings, certainty_report,
        contact_findings, identifier_findings, civil_findings, sensitive_findings, institutional_contacts, letterhead_contacts,
        same_persons, page_outcomes, report_header, treated_findings, confirmations,
    )
}

# card_findings, document_findings and certainty_report have none: DuckDB's patterns cannot look ahead, which tells
# numbers side by side apart.
# ---- SQL -----------------------------------------------------------------------------------


def _quoted(values: tuple[str, ...]) -> str:
    return ", ".join("'" + x + "'" for x in dict.fromkeys(values))


_LUHN = (
    "list_sum(list_transform(range(1, len(d) + 1), lambda i: CASE WHEN i % 2 = 1 THEN CAST(substr(reverse(d), i, 1) AS INT) "
    "WHEN CAST(substr(reverse(d), i, 1) AS INT) > 4 THEN 2 * CAST(substr(reverse(d), i, 1) AS INT) - 9 "
    "ELSE 2 * CAST(substr(reverse(d), i, 1) AS INT) END)) % 10 = 0"
)
_ENDS = " OR ".join(f"ends_with(dom, '{d}') OR dom = '{d[1:]}'" for d in fixed.INSTITUTION_DOMAINS if d.startswith("."))
_STARTS = "|".join(d for d in fixed.INSTITUTION_DOMAINS if not d.startswith("."))
_EMAILS = f"""
WITH found AS (
  SELECT doc_id, lower(unnest(regexp_extract_all(text, '[A-Za-z0-9_.+\\-]+@[A-Za-z0-9_\\-]+(?:\\.[A-Za-z0-9_\\-]+)+'))) AS address FROM documents),
cut AS (SELECT *, split_part(address, '@', 1) AS loc, split_part(address, '@', 2) AS dom FROM found),
facts AS (
  SELECT *, list_filter(regexp_split_to_array(loc, '[._\\-]'), lambda w: w <> '') AS words,
         regexp_replace(loc, '[._\\-]', '', 'g') AS plain, ({_ENDS} OR regexp_matches('.' || dom, '\\.(?:{_STARTS})')) AS body FROM cut)
SELECT doc_id, address, count(*) AS n FROM facts WHERE
  len(list_filter([{_quoted(fixed.PERSONAL_DOMAINS)}], lambda x: dom = x OR ends_with(dom, '.' || x))) > 0
  OR (len(words) >= 2 AND len(list_filter(words, lambda w: NOT regexp_full_match(w, '[a-z]+[0-9]{{0,3}}'))) = 0
      AND len(list_filter(words, lambda w: length(w) >= 3)) > 0
      AND len(list_filter(words, lambda w: list_contains([{_quoted(fixed.OFFICE_MAILBOXES)}], regexp_replace(w, '[0-9]+$', '')))) = 0)
  OR NOT (body AND len(list_filter([{_quoted(fixed.OFFICE_MAILBOXES)}], lambda x: plain = x OR (starts_with(plain, x) AND length(x) >= 4))) > 0)
GROUP BY ALL"""
_PAYEE = f"""
SELECT o_orderkey AS doc_id, CAST(23 AS BIGINT) AS start, CAST(23 + length({NO_DIV}) AS BIGINT) AS "end", {NO_DIV} AS text, 'C2' AS category,
  CASE WHEN {t.AMOUNT} <= 1000 THEN 'C2_below' ELSE 'C2_above' END AS proposal_key,
  CASE WHEN {t.AMOUNT} <= 1000 THEN 'mask' ELSE 'keep' END AS decision FROM orders"""


def _by_sentence(value) -> str:
    return t.pick(tuple(value(s) for s in t.SENTENCES), f"o_orderkey % {len(t.SENTENCES)}")


_PRIVATE = {"B8": "mask", "P": "keep", "B7": "mask", "C1_contractor": "mask", "C1": "mask"}
ORACLE_SQL: dict[str, str] = {
    "email_findings": _EMAILS,
    "iban_checks": """
WITH c AS (SELECT c_custkey AS id, concat('IT', lpad(CAST(c_custkey % 97 + 2 AS VARCHAR), 2, '0'), 'X0542811101', lpad(CAST(c_custkey AS VARCHAR), 12, '0')) AS code FROM customer)
SELECT id, code, CAST('330542811101' || substr(code, 16, 12) || '1829' || substr(code, 3, 2) AS HUGEINT) % 97 = 1 AS valid FROM c""",
    "tax_code_checks": """
WITH c AS (SELECT c_custkey AS id, concat('RSSMRA', lpad(CAST(c_custkey % 100 AS VARCHAR), 2, '0'), 'T', lpad(CAST(c_custkey % 80 AS VARCHAR), 2, '0'),
  'A', lpad(CAST(c_custkey % 1000 AS VARCHAR), 3, '0'), chr(65 + CAST(c_custkey % 26 AS INT))) AS code FROM customer),
o AS (SELECT [1, 0, 5, 7, 9, 13, 15, 17, 19, 21] AS dig, [1, 0, 5, 7, 9, 13, 15, 17, 19, 21, 2, 4, 18, 20, 11, 3, 6, 8, 12, 14, 16, 10, 22, 25, 24, 23] AS let)
SELECT id, code, (CAST(substr(code, 10, 2) AS INT) BETWEEN 1 AND 31 OR CAST(substr(code, 10, 2) AS INT) BETWEEN 41 AND 71) AND
  list_sum(list_transform(range(1, 16), lambda i: CASE
    WHEN substr(code, i, 1) BETWEEN '0' AND '9' THEN CASE WHEN i % 2 = 1 THEN dig[CAST(substr(code, i, 1) AS INT) + 1] ELSE CAST(substr(code, i, 1) AS INT) END
    ELSE CASE WHEN i % 2 = 1 THEN let[ascii(substr(code, i, 1)) - 64] ELSE ascii(substr(code, i, 1)) - 65 END END)) % 26 = ascii(substr(code, 16, 1)) - 65 AS valid
FROM c, o""",
    "vat_checks": f"""
WITH c AS (SELECT c_custkey AS id, lpad(CAST(c_custkey * 7919 AS VARCHAR), 11, '0') AS code FROM customer), e AS (SELECT *, code AS d FROM c)
SELECT id, code, length(replace(code, substr(code, 1, 1), '')) > 0 AND {_LUHN} AS valid FROM e""",
    "amounts": """
SELECT o_orderkey AS id, CAST(round(CAST(o_totalprice AS DECIMAL(18,2)) * 100) AS BIGINT) AS cents, CAST(o_totalprice AS DECIMAL(18,2)) <= 1000 AS below FROM orders""",
    "surnames": f"""
WITH n AS (SELECT o_orderkey AS id, o_orderkey % 3 AS k, {t.pick(t.FIRST, 'o_custkey % 10')} AS f, {t.pick(t.LAST, '(o_custkey // 10) % 10')} AS l,
  {t.pick(t.LAST, 'o_custkey % 10')} AS d FROM orders)
SELECT id, CASE k WHEN 0 THEN l WHEN 1 THEN upper(f) ELSE 'De ' || d END AS surname,
  CASE WHEN k < 2 THEN lower(f || ' ' || l) ELSE 'nicolo de ' || lower(d) END AS name_key FROM n""",
    "masked_intervals": """
WITH s AS (SELECT l_orderkey AS id, CAST(l_partkey % 90 AS INT) AS a, CAST(l_partkey % 90 AS INT) + CAST(l_quantity AS INT) % 20 + 1 AS b FROM lineitem),
places AS (SELECT DISTINCT id, p FROM s, unnest(range(a, b)) AS u(p)),
-- intervals that touch are one
runs AS (SELECT id, p, p - row_number() OVER (PARTITION BY id ORDER BY p) AS g FROM places),
spans AS (SELECT id, g, min(p) AS a, max(p) + 1 AS b FROM runs GROUP BY id, g)
SELECT id, count(*) AS n_masks, CAST(sum(b - a) AS BIGINT) AS n_masked,
  CAST(count(*) + 1 - count(*) FILTER (a = 0) - count(*) FILTER (b = 120) AS BIGINT) AS n_gaps FROM spans GROUP BY id""",
    "payee_findings": _PAYEE,
    "qualified_names": f"""
SELECT o_orderkey AS doc_id, CAST(instr({_by_sentence(lambda s: s[0])}, '{{}}') - 1 AS BIGINT) AS start,
  CAST(instr({_by_sentence(lambda s: s[0])}, '{{}}') - 1 + length({NO_DIV}) AS BIGINT) AS "end", {NO_DIV} AS text,
  {_by_sentence(lambda s: s[1])} AS category, {_by_sentence(lambda s: s[2])} AS proposal_key, {_by_sentence(lambda s: s[3])} AS decision FROM orders""",
    "private_purpose": f"""
SELECT {_by_sentence(lambda s: s[1])} AS category, {_by_sentence(lambda s: s[2])} AS proposal_key,
  {_by_sentence(lambda s: _PRIVATE[s[2]])} AS decision, count(*) AS n FROM orders GROUP BY ALL""",
    "redacted_payments": f"""
SELECT o_orderkey AS doc_id, concat('Si liquida a favore di ', CASE WHEN {t.AMOUNT} <= 1000 THEN '[SUBJECT 1]' ELSE {NO_DIV} END,
  ' la somma di euro ', {t.AMOUNT}, '.') AS redacted_text FROM orders""",
    "decision_log": f"""
SELECT o_orderkey AS doc_id, concat('Si liquida a favore di ', CASE WHEN o_orderkey % 4 = 0 THEN '[OMISSIS]' WHEN o_orderkey % 2 = 0 THEN {NO_DIV}
  WHEN {t.AMOUNT} <= 1000 THEN '[OMISSIS]' ELSE {NO_DIV} END, ' la somma di euro ', {t.AMOUNT}, '.') AS redacted_text FROM orders""",
}

_N = len(cases.IDENTIFIERS)
_CATEGORY, _DECISION, _KEY = (
    "CASE " + " ".join(f"WHEN c_custkey % {_N} = {i} THEN " + (f"'{c[k]}'" if c[k] else "NULL") for i, c in enumerate(cases.IDENTIFIERS)) + " END"
    for k in (3, 5, 4)
)
_DETECTOR = "CASE " + " ".join(
    f"WHEN c_custkey % {_N} = {i} THEN '{d}'"
    for i, d in enumerate(("tax-code", "", "health-card", "iban", "", "bank-account", "payment-card", "", "id-document", "vat-number", "vat-number", ""))
) + " END"
_IDS = f"WITH f AS (SELECT c_custkey AS doc_id, {_CATEGORY} AS category, {_DECISION} AS decision, {_KEY} AS proposal_key, {_DETECTOR} AS detector FROM customer)"
ORACLE_SQL |= {
    "contact_findings": cases.expected(cases.CONTACTS),
    "identifier_findings": cases.expected(cases.IDENTIFIERS),
    "civil_findings": cases.expected(cases.CIVIL),
    "sensitive_findings": cases.expected(cases.SENSITIVE, names_too=True),
    "institutional_contacts": cases.expected(cases.BODIES),
    "letterhead_contacts": cases.expected(cases.LETTERHEADS),
    "same_persons": cases.persons_expected(),
    "page_outcomes": """
SELECT c_custkey AS doc_id, CASE WHEN c_custkey % 4 = 2 THEN 'B4P' ELSE 'C7' END AS category, CASE WHEN c_custkey % 4 = 2 THEN 'mask' END AS decision,
  CASE WHEN c_custkey % 4 = 2 THEN 'formal' ELSE 'statistical' END AS certainty, CASE WHEN c_custkey % 4 = 2 THEN 'dropped' ELSE 'clear' END AS outcome,
  false AS covered FROM customer WHERE c_custkey % 4 < 3""",
    "report_header": f"""{_IDS}
SELECT doc_id, CAST(1 AS BIGINT) AS n_pages, CAST(0 AS BIGINT) AS n_dropped, CAST(CASE WHEN category IS NULL THEN 0 ELSE 1 END AS BIGINT) AS n_findings,
  CAST(CASE WHEN decision = 'mask' THEN 1 ELSE 0 END AS BIGINT) AS n_masked, CAST(0 AS BIGINT) AS n_open,
  CAST(CASE WHEN category = 'C6' THEN 1 ELSE 0 END AS BIGINT) AS n_to_confirm, coalesce(category, '') <> 'C6' AS ready FROM f""",
    "treated_findings": f"""{_IDS}
SELECT doc_id, CAST(1 AS BIGINT) AS nr, category, detector, CASE WHEN detector IN ({_quoted(CERTAINTY["formal"])}) THEN 'formal' ELSE 'contextual' END AS certainty
FROM f WHERE decision = 'mask'""",
    "confirmations": f"""{_IDS}
SELECT category, proposal_key, decision, CASE WHEN doc_id % 2 = 0 THEN 'confirmed' ELSE 'proposed' END AS "by", count(*) AS n
FROM f WHERE category = 'C6' GROUP BY ALL""",
}
