"""Pages of a known meaning for each detector and rule, made from the customers' keys.

A case is the text before a value, the value as SQL that Spark and DuckDB both understand, the
text after it, and what the value becomes: category, proposal key, decision (all None: it is no
finding). Pages take the cases in turn."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.sources.templates import FIRST, LAST, pick

KEY = "CAST(c_custkey AS STRING)"
NAME = f"concat({pick(FIRST, 'c_custkey % 10')}, ' ', {pick(LAST, 'c_custkey % 7')})"


def digits(n: int) -> str:
    return f"lpad({KEY}, {n}, '0')"


Case = tuple[str, str, str, str | None, str | None, str | None]
CONTACTS: tuple[Case, ...] = (
    ("Per informazioni cell. ", f"concat('347 ', {digits(7)})", ".", "B3", "B3", "mask"),
    ("Chiamare il tel. ", f"concat('090 ', {digits(7)})", " di sera.", "B3", "B3", "mask"),
    ("La persona, residente in ", f"concat('Borgo', {KEY})", ", come risulta.", "B3", "B3", "mask"),
    ("Consegna in ", f"concat('via Garibaldi ', {KEY})", ", piano terra.", "B3", "B3", "mask"),
    ("Scrivere a ", f"concat('mario.rossi', {KEY}, '@gmail.com')", " entro domani.", "B3", "B3", "mask"),
    ("Scrivere a ", "'protocollo@comune.esempio.it'", " entro domani.", None, None, None),
    ("Dal numero ", f"concat('347', {digits(5)})", " non risponde.", None, None, None),
)
IDENTIFIERS: tuple[Case, ...] = (
    ("Codice fiscale ", "'RSSMRA85T10A562S'", " in atti.", "B1", "B1", "mask"),
    ("Codice fiscale ", "'RSSMRA85T10A562X'", " in atti.", None, None, None),
    ("Tessera ", f"concat('80380', {digits(15)})", " valida.", "B1", "B1", "mask"),
    ("Bonifico su ", "'IT60X0542811101000000123456'", ".", "B2", "B2", "mask"),
    ("Bonifico su ", "'IT61X0542811101000000123456'", ".", None, None, None),
    ("Accredito sul conto corrente n. ", digits(10), " postale.", "B2", "B2", "mask"),
    ("Pagato con ", "'4111 1111 1111 1111'", " oggi.", "B2", "B2", "mask"),
    ("Pagato con ", "'4111 1111 1111 1112'", " oggi.", None, None, None),
    ("Esibisce il passaporto n. ", f"concat('AX', {digits(7)})", ", in originale.", "B4", "B4", "mask"),
    ("P. IVA ", "'00743110157'", " della società ALFA.", "C6", "C6_company", "keep"),
    ("P. IVA ", "'00743110157'", " in atti.", "C6", "C6", "mask"),
    ("P. IVA ", "'00743110158'", " in atti.", None, None, None),
)
CIVIL: tuple[Case, ...] = (
    ("Il candidato è nato a ", "concat('Messina il 01/02/', CAST(1950 + c_custkey % 50 AS STRING))", ", come da certificato.", "B5", "B5", "mask"),
    ("Data di nascita: ", "concat('3 maggio ', CAST(1950 + c_custkey % 50 AS STRING))", ", in archivio.", "B5", "B5", "mask"),
    ("La persona risulta ", "'coniugata'", " da tempo.", "B5", "B5", "mask"),
    ("Vive qui un ", "concat('nucleo familiare di ', CAST(2 + c_custkey % 5 AS STRING), ' persone')", " in affitto.", "B5", "B5", "mask"),
    ("Il sottoscritto ", NAME, " chiede il rinnovo.", "C1", "C1", "mask"),
    ("Vista la nota del sig. ", NAME, " in atti.", "C1", "C1", "mask"),
    ("nata a ", "concat('Messina\nil 02/03/', CAST(1950 + c_custkey % 50 AS STRING))", "\nprovincia ME", "B5", "B5", "mask"),
)
#: Fields of forms.
FORMS: tuple[Case, ...] = (
    ("Cognome e nome\nresidente in ", f"concat('Torre', {KEY})", "\nprovincia", "B3", "B3", "mask"),
    ("Dati del dichiarante\nvia ", f"concat('Colle ', {pick(LAST, 'c_custkey % 7')})", "\ntelefono", "B3", "B3", "mask"),
    ("Dati del dichiarante\nvia ", f"lower(concat('Colle ', {pick(LAST, 'c_custkey % 7')}))", "\ntelefono", None, None, None),
)
#: Economic hardship and employment, which are to be decided.
WORK: tuple[Case, ...] = (
    ("Nota; ", "'stato di bisogno'", "; fine", "C4", "C4", "mask"),
    ("Nota; ", "'emergenza abitativa del nucleo'", "; fine", "C4", "C4", "mask"),
    ("Nota; ", "'sanzione disciplinare'", "; fine", "C5", "C5", "mask"),
    ("Nota; ", "'periodo di aspettativa'", "; fine", "C5", "C5", "mask"),
    ("Nota; ", "'lavoro ordinario'", "; fine", None, None, None),
)
#: With a person beside them (a recognizer's name), and without.
SENSITIVE: tuple[Case, ...] = (
    ("{}\n", "'presenta invalidità civile al cento per cento'", ";", "A1", "A1", "mask"),
    ("{}; ", "'esito del test genetico'", ";", "A2", "A2", "mask"),
    ("{}; ", "'dichiara il proprio orientamento sessuale'", ";", "A3", "A3", "mask"),
    ("{}; ", "'appartenenza sindacale'", ";", "A4", "A4", "mask"),
    ("{}; ", "'imputato in sede locale'", ";", "C3", "C3", "mask"),
    ("", "'Permessi ai sensi della legge 104/1992'", ".", "C8", "C8", "mask"),
    ("Ricorso al ", "'TAR'", " senza persone.", None, None, None),
)
#: Offices, companies, holders of a role, and persons beside them.
BODIES: tuple[Case, ...] = (
    ("Per informazioni rivolgersi al Settore Lavori Pubblici, tel. ", f"concat('090 ', {digits(7)})", ", nei giorni di apertura.", "P", "P", "keep"),
    ("Responsabile del procedimento\ndott. Mario Rossi\ntel. ", f"concat('090 ', {digits(7)})", ".", "P", "P", "keep"),
    ("Responsabile del procedimento\ndott. Mario Rossi\ne-mail: ", f"concat('m.rossi', {KEY}, '@comune.esempio.it')", "", "P", "P", "keep"),
    ("Il Responsabile del procedimento: dott. Mario Rossi – ", f"concat('mario.rossi', {KEY}, '@gmail.com')", ".", "B3", "B3", "mask"),
    ("Per chiarimenti scrivere a ", f"concat('mario.rossi', {KEY}, '@comune.esempio.it')", " entro il termine.", "B3", "B3", "mask"),
    ("Settore Lavori Pubblici. Il richiedente sig. Mario Rossi, tel. ", f"concat('090 ', {digits(7)})", ".", "B3", "B3", "mask"),
    ("ALFA s.r.l., con recapito in ", f"concat('via Garibaldi ', {KEY})", ", Messina.", "P", "P", "keep"),
)
#: In the head of a page.
LETTERHEADS: tuple[Case, ...] = (
    ("Comune di Esempio\nSettore Affari Generali\n\n\n\ntel. ", f"concat('090 ', {digits(7)})", "\n\nOggetto: liquidazione", "P", "P", "keep"),
    ("Curriculum vitae\nEsperienze\ntel. ", f"concat('090 ', {digits(7)})", "\n\nLavori", "B3", "B3", "mask"),
)


def pages(spark: SparkSession, sf_dir: str, cases: tuple[Case, ...], name: str = NAME) -> DataFrame:
    """doc_id, page, text: one page for each customer."""
    number = f"c_custkey % {len(cases)}"
    text = F.concat(*[F.expr(pick(tuple(c[i].replace("'", "''") for c in cases), number) if i != 1 else chosen(cases)) for i in range(3)])
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet")
    return rows.select(F.col("c_custkey").alias("doc_id"), F.lit(1).alias("page"), F.replace(text, F.lit("{}"), F.expr(name)).alias("text"))


def names(spark: SparkSession, sf_dir: str, name: str = NAME) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("doc_id"), F.expr(name).alias("name"))


def chosen(cases: tuple[Case, ...]) -> str:
    return "CASE " + " ".join(f"WHEN c_custkey % {len(cases)} = {i} THEN {c[1]}" for i, c in enumerate(cases)) + " END"


def expected(cases: tuple[Case, ...], names_too: bool = False) -> str:
    """SQL for the findings that the cases should give; names_too: also for the names at their
    beginnings, which no context qualifies."""

    def by(values: list[str]) -> str:
        return "CASE " + " ".join(f"WHEN c_custkey % {len(cases)} = {i} THEN {v}" for i, v in enumerate(values)) + " END"

    def told(i: int) -> str:
        return by(["NULL" if c[i] is None else f"'{c[i]}'" for c in cases])

    named = [str(i) for i, c in enumerate(cases) if c[0].startswith("{}")]
    extra = ""
    if names_too:
        extra = f" UNION ALL SELECT c_custkey, 0, {NAME}, 'C1', 'C1', 'mask' FROM customer WHERE c_custkey % {len(cases)} IN ({', '.join(named)})"
    before = by([str(len(c[0].replace("{}", ""))) + (f" + length({NAME})" if "{}" in c[0] else "") for c in cases])
    return f"""
WITH f AS (SELECT c_custkey AS doc_id, CAST({before} AS BIGINT) AS start, {chosen(cases)} AS text, {told(3)} AS category, {told(4)} AS proposal_key,
  {told(5)} AS decision FROM customer{extra})
SELECT doc_id, start, CAST(start + length(text) AS BIGINT) AS "end", text, category, proposal_key, decision FROM f WHERE category IS NOT NULL"""


#: Persons met twice: text around the full name and around the surname, what both become.
FAMILY = "D''Angelo"
PERSONS = (
    ("Contributo di euro 1.500,00 a favore di ", ". Il sig. ", " ringrazia.", "C2", "C2_above", "keep"),
    ("Contributo di euro 500,00 a favore di ", ". Il sig. ", " ringrazia.", "C2", "C2_below", "mask"),
    ("Il minore ", " frequenta la scuola. Anche ", " partecipa.", "B8", "B8", "mask"),
)
FULL = f"concat({pick(FIRST, 'c_custkey % 10')}, ' {FAMILY}')"
#: The surname alone comes with the other apostrophe.
ALONE = "'D’Angelo'"


def persons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, page, text: a person named in full and then by the surname."""
    by = [F.expr(pick(tuple(c[i] for c in PERSONS), f"c_custkey % {len(PERSONS)}")) for i in range(3)]
    text = F.concat(by[0], F.expr(FULL), by[1], F.expr(ALONE), by[2])
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("doc_id"), F.lit(1).alias("page"), text.alias("text"))


def persons_expected() -> str:
    n = f"c_custkey % {len(PERSONS)}"
    first, between = (pick(tuple(c[i] for c in PERSONS), n) for i in (0, 1))
    told = ", ".join(f"{pick(tuple(c[i] for c in PERSONS), n)} AS {name}" for i, name in ((3, "category"), (4, "proposal_key"), (5, "decision")))
    rows = "SELECT c_custkey AS doc_id, CAST({} AS BIGINT) AS start, {} AS text, {}, CAST(1 AS BIGINT) AS subject_no FROM customer"
    return (
        rows.format(f"length({first})", FULL, told) + " UNION ALL " + rows.format(f"length({first}) + length({FULL}) + length({between})", ALONE, told)
    )


def scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of four kinds: too few words, badly read, an identity document, and plain text."""
    kind = F.col("c_custkey") % 4
    words = F.lit("questa pagina contiene molte parole che sono state lette molto bene dalla macchina nel nostro ufficio")
    text = F.when(kind == 0, "poche parole").when(kind == 2, F.concat(F.lit("P<ITAROSSI<<MARIO<<<<<<<<<<"), F.expr(KEY))).otherwise(words)
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select(
        F.col("c_custkey").alias("doc_id"), F.lit(1).alias("page"), text.alias("text"), (kind < 2).alias("is_scan"),
        F.when(kind == 1, 50.0).otherwise(90.0).alias("ocr_conf"), F.lit(0).alias("n_cards"),
    )
