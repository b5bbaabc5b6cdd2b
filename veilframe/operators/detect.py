"""Pattern detectors: one projection of pages into findings, without a shuffle."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilframe.functions.patterns import ODD_LETTERS, OPEN, beginnings, clean, extended, java, last_place, let, literals, marked, matches, places, same_clause, shadow, slice_of, stems, union
from veilframe.functions.validators import VALIDATORS, birth_date, iban, iban_length, name_key
from veilframe.operators.names import trimmed
from veilframe.plans.staging import staged
from veilframe.rules import fixed
from veilframe.rules.tables import CATEGORIES


@dataclass(frozen=True)
class Detector:
    name: str
    category: str
    pattern: str
    ignore_case: bool = True
    validator: str | None = None
    #: What a text must hold, else the pattern is not looked for: one of the literals, in small
    #: letters, and a digit; or a digit or a word that begins like one of words (BEGIN letters,
    #: three make a word).
    literals: tuple[str, ...] = ()
    digit: bool = False
    words: tuple[str, ...] = ()


#: Patterns of the lists that do not begin with enough letters, by what a match of them holds.
SHORT = {
    r"(?:legge|l\.|ex": "104", r"art\.?\s*3": "104", r"equo": "inden", r"\bTSO\b": "tso", r"\bHIV\b": "hiv", r"non\s+auto": "autos", r"non\s+vede": "veden",
    r"asm(?:a|atic": ("asma", "asmat"), r"cure": "medic", r"dat[oi]\s+gene": "genet", r"test\s+gene": "genet", r"\bDNA\b": "dna", r"dat[oi]\s+biom": "biome",
    r"vita": "sessu", r"(?:rettificazione|": "sesso", r"etni[ae]": ("etnia", "etnie"), r"\bRSU\b": "rsu",
    r"\b(?:CGIL|CISL": ("cgil", "cisl", "uil", "ugl", "usb", "cobas", "fials", "nursi", "dicca", "csa"),
    r"atto\s+di\s+cita": "citaz", r"atto\s+di\s+prec": "prece", r"\bTAR\b": "tar", r"\bR\.?\s?G": "", r"\bISEE\b": "isee",
    r"casa": "famig", r"buon[oi]\s+spesa": "spesa",
}


def _listed(name: str, category: str, words: tuple[str, ...]) -> Detector:
    short = {w: next((v for k, v in SHORT.items() if w.startswith(k)), None) for w in words}
    given = [x for v in short.values() if v is not None for x in (v if isinstance(v, tuple) else (v,))]
    begun = stems(tuple(w.removeprefix(r"\b") for w, v in short.items() if v is None))
    return Detector(name, category, union(words, bounded=True), words=begun + tuple(v for v in given if v.isalpha()), digit=any(not v.isalpha() for v in given))


#: Parts that each match of a fixed pattern has, quick to look for.
HOLDS: dict[str, dict] = {
    "health-card": {"literals": ("80380",)},
    "email": {"literals": ("@",)},
    "residence": {"literals": ("residente", "domiciliat", "abitante", "dimorante")},
    "birth": {"literals": ("nato", "nata", "nascit")},
    "residence-form": {"literals": ("residente", "domiciliat")},
    "address-form": {"literals": ("via", "piazza", "corso", "largo", "vicolo", "contrada", "c.da", "strada", "localit", "frazione")},
    "birth-date": {"literals": ("nascita",)},
    "marital-status": {"words": ("coniu", "celib", "nubil", "vedov", "divor", "separ", "stato")},
    "household": {"literals": ("nucleo",)},
    "name-declarant": {"literals": ("sottoscritt", "dichiarante", "richiedente", "istante", "interessat")},
    "name-titled": {"literals": ("sig.", "signor", "dott.", "dr.", "ing.", "arch.", "avv.", "geom.", "rag.", "prof.")},
    **{k: {"digit": True} for k in ("iban", "payment-card", "mobile")},
    "bank-account": {"literals": ("c/c", "conto", "c."), "digit": True},
    "landline": {"literals": ("tel", "fax", "cell", "recapito"), "digit": True},
    "address": {"digit": True, "literals": (
        "via", "piazz", "corso", "largo", "vico", "contrada", "c.da", "strada", "localit", "loc.", "fraz", "salita", "discesa", "lungomare", "traversa",
    )},
    "id-document": {"literals": ("carta", "c.", "documento", "passaporto", "patente", "permesso"), "digit": True},
    "birth-date-form": {"literals": ("nato", "nata"), "digit": True},
    "vat-number": {"literals": ("iva", "p."), "digit": True},
}


def _fixed(name: str, category: str, pattern: str, ignore_case: bool, validator: str | None) -> Detector:
    return Detector(name, category, pattern.replace("{NAME_WORD}", fixed.NAME_WORD), ignore_case, validator, **HOLDS.get(name, {}))


DETECTORS = (
    _listed("health", "A1", fixed.HEALTH),
    _listed("genetic-biometric", "A2", fixed.GENETIC_BIOMETRIC),
    _listed("sexual-life", "A3", fixed.SEXUAL_LIFE),
    _listed("origin-beliefs", "A4", fixed.ORIGIN_BELIEFS),
    *(_fixed(*row) for row in fixed.PATTERNS[:-1]),
    _listed("judicial", "C3", fixed.JUDICIAL),
    _listed("hardship", "C4", fixed.HARDSHIP),
    _listed("employment", "C5", fixed.EMPLOYMENT),
    _fixed(*fixed.PATTERNS[-1]),
)
#: Numbers of findings by detector: place of the detector times STRIDE, then by place.
STRIDE = 100_000_000


def prepared(pages: DataFrame) -> DataFrame:
    """pages with text free of marks and its shadow (see patterns)."""
    return pages.withColumn("text", clean(F.col("text"))).withColumn("shadow", shadow(F.col("text")))


def _vat_context(text: Column, shadowed: Column, lead: Column, end: Column) -> Column:
    """person, company or null: whom a VAT number belongs to, by the nearest words around."""
    company = f"(?:{fixed.COMPANY_CONTEXT}|{fixed.INSTITUTION_CONTEXT})"
    person = union(fixed.NATURAL_PERSON)
    before, after = slice_of(text, lead - 200, lead), slice_of(text, end, end + 80)

    def follows(pattern: str) -> Column:
        return F.exists(matches(after, pattern, True), lambda m: same_clause(shadowed, end, end + m["start"], 1))

    person_before, company_before, company_after = last_place(before, person), last_place(before, company), follows(company)
    is_person = follows(person) | ((person_before >= 0) & (person_before > company_before) & ~company_after)
    return F.when(is_person, "person").when(company_after | (company_before >= 0), "company")


#: Characters of an identity document's page, at most.
ID_LENGTH = 1500
#: Characters kept on either side of a match for what is decided from its surroundings.
WINDOW = 240


@dataclass(frozen=True)
class Steps:
    """Detection of spans as projections, one after the other: for DataFrames (detect) and for SQL
    (plans.sql). Columns refer to those of the step before; the first has text and shadow."""

    #: An array of struct<d, lead, start, end>: all matches, by the number of their detector.
    every: Column
    #: After every is exploded as m: the match in a window of text and shadow that begins at base.
    window: dict[str, Column]
    #: What takes several looks at the surroundings, worked out once, and which rows go on.
    looks: dict[str, Column]
    going: Column
    #: Places as they end up.
    placed: dict[str, Column]
    own: Column
    valid: Column
    #: The columns of a finding; places count from the text's beginning.
    out: dict[str, Column]


def steps(detectors: tuple[Detector, ...] = DETECTORS, as_of: str | None = None) -> Steps:
    def worth(x: Detector, seen: Column) -> Column | None:
        """Whether the text may hold a match of x, by what is quick to look for."""
        if x.literals:
            held = reduce(or_, [F.contains(seen["low"], F.lit(v)) for v in x.literals], seen["odd"])
            return seen["digit"] & held if x.digit else held
        tests = [seen["digit"]] if x.digit else []
        if x.words:
            tests.append(F.arrays_overlap(seen["words"], F.array(*map(F.lit, x.words))))
        return reduce(or_, tests, seen["odd"]) if tests else None

    def of_detector(n: Column, seen: Column) -> Column:
        """Matches of detector n: one expression for all detectors, one marked text at a time."""
        text = F.lit(None).cast("string")
        for i, x in reversed(list(enumerate(detectors))):
            own, fits = marked(F.col("text"), x.pattern, x.ignore_case), worth(x, seen)
            text = F.when(n == i, own if fits is None else F.when(fits, own)).otherwise(text)
        # most texts have no match of most detectors: nothing to cut then
        found = let(text, lambda t: F.when(F.contains(t, F.lit(OPEN)), places(t)))
        each = F.transform(found, lambda m: F.struct(n.alias("d"), *[m[c].alias(c) for c in ("lead", "start", "end")]))
        return F.coalesce(each, F.array().cast("array<struct<d:int,lead:int,start:int,end:int>>"))

    def kind(x: Detector) -> str:
        if x.name.startswith("name-"):
            return "name"
        if CATEGORIES[x.category][4]:
            return "clause"
        return x.validator or "plain"

    def of(name: str) -> Column:
        return F.col("d").isin([i for i, x in enumerate(detectors) if kind(x) == name])

    def by_detector(value) -> Column:
        values = [value(x) for x in detectors]
        made = F.lit(values[-1])
        for v in dict.fromkeys(values[:-1]):
            made = F.when(F.col("d").isin([i for i, x in enumerate(values) if x == v]), v).otherwise(made)
        return made if len(set(values)) > 1 else F.lit(values[0])

    text, shadowed, start, end = F.col("text"), F.col("shadow"), F.col("start"), F.col("end")
    base = F.greatest(F.col("m.lead") - WINDOW, F.lit(0))
    last = F.col("m.end") + WINDOW
    window = {
        "d": F.col("m.d"), "base": base, **{c: F.col(f"m.{c}") - base for c in ("lead", "start", "end")},
        "text": slice_of(text, base, last), "shadow": slice_of(shadowed, base, last),
    }
    own = slice_of(text, start, end)
    grown = extended(text, shadowed, start, end, by_detector(lambda x: CATEGORIES[x.category][3]), by_detector(lambda x: CATEGORIES[x.category][4]))
    # an account number may have swallowed the words after it
    filled = F.filter(F.sequence(F.lit(1), F.length(own)), lambda i: ~F.substring(own, i, F.lit(1)).rlike(r"\s"))
    looks = {
        "grown": F.when(of("clause"), grown),
        "named": F.when(of("name"), trimmed(text, start, end, F.lit(0.0))),
        "cut": F.when(of("iban"), F.when(~iban(own), start + F.get(filled, iban_length(own) - 1))),
        "context": F.when(of("vat_number"), _vat_context(text, shadowed, F.col("lead"), end)),
    }
    placed = {"start": F.coalesce("grown.start", "named.start", "start"), "end": F.coalesce("grown.end", "named.end", "cut", "end")}
    checks = {k: VALIDATORS[k] for k in ("tax_code", "luhn", "personal_email", "iban", "vat_number")}
    checks["birth_date"] = lambda x: birth_date(x, as_of)
    valid = F.lit(True)
    for check, fits in checks.items():
        if any(kind(x) == check for x in detectors):
            valid = F.when(of(check), fits(F.col("own"))).otherwise(valid)
    whose = F.col("context")
    note = F.when(whose == "person", "VAT number in the context of a natural person")
    note = note.when(whose == "company", "VAT number in the context of a company or body").otherwise("")
    out = {
        "seq": F.col("d").cast("long") * STRIDE + F.col("base") + start,
        "start": F.col("base") + start, "end": F.col("base") + end, "text": F.col("own"),
        "category": F.when(whose == "person", "B1").otherwise(by_detector(lambda x: x.category)),
        "detector": by_detector(lambda x: x.name), "note": note,
        "proposal_key": F.when(whose == "company", "C6_company"),
        "subject_key": F.when(of("name"), name_key(F.col("named.name"))),
    }
    numbers = F.sequence(F.lit(0), F.lit(len(detectors) - 1))
    listed = tuple(dict.fromkeys(w for x in detectors for w in x.words))
    no_words = F.array().cast("array<string>")

    def words(low: Column) -> Column:
        """The beginnings of the text's words that some detector looks for."""
        return F.array_intersect(beginnings(low), F.array(*map(F.lit, listed))) if listed else no_words

    seen = let(F.lower("text"), lambda low: F.struct(
        low.alias("low"), F.col("text").rlike("[0-9]").alias("digit"), words(low).alias("words"), F.col("text").rlike(f"[{ODD_LETTERS}]").alias("odd")
    ))
    every = let(seen, lambda s: F.flatten(F.transform(numbers, lambda n: of_detector(n, s))))
    return Steps(every, window, looks, ~of("name") | F.col("named").isNotNull(), placed, own, valid, out)


def _named(columns: dict[str, Column]) -> list[Column]:
    return [c.alias(n) for n, c in columns.items()]


def detect(pages: DataFrame, detectors: tuple[Detector, ...] = DETECTORS, as_of: str | None = None) -> DataFrame:
    """Columns for constructed() of every match of the detectors in pages (doc_id, page, text,
    shadow): validated, account numbers cut to their country's length, names trimmed, keyword
    spans grown to their clause. Matches are found in one pass over the pages and kept with
    their surroundings; the rest works on those."""
    by = steps(detectors, as_of)
    rows = pages.select("doc_id", "page", "text", "shadow", F.explode(by.every).alias("m"))
    rows = staged(rows.select("doc_id", "page", *_named(by.window)), "matches")
    rows = staged(rows.withColumns(by.looks), "surroundings").where(by.going)
    rows = rows.withColumns(by.placed).withColumn("own", by.own)
    return rows.where(by.valid).select("doc_id", "page", *_named(by.out))


def page_findings(pages: DataFrame) -> DataFrame:
    """Columns for constructed() of whole pages: identity documents (B4P), and scanned pages
    that could not be read (C7). pages: doc_id, page, text, is_scan, ocr_conf, n_cards (regions
    shaped like an identity card)."""

    def clues(patterns: tuple[str, ...]) -> Column:
        return sum((F.col("text").rlike(java(p, True)).cast("int") for p in patterns), F.lit(0))

    # a page that is no scan is known by a zone or the structure of a document only: most have neither
    shapes, odd = literals(fixed.ID_STRUCTURAL), F.col("text").rlike(f"[{ODD_LETTERS}]")
    holds = let(F.lower("text"), lambda low: reduce(or_, [F.contains(low, F.lit(x)) for x in (*shapes, "<<")]))
    # and pages of identity documents are short: longer texts are not looked at
    short = F.length("text") <= ID_LENGTH
    worth = F.col("is_scan") | (short & (holds | odd))
    strong, weak, scan, cards = clues(fixed.ID_STRONG), clues(fixed.ID_WEAK), F.col("is_scan"), F.when(F.col("is_scan"), F.col("n_cards")).otherwise(0)
    zone = F.col("text").rlike(java(fixed.ID_MRZ, False))
    shaped = scan | (clues(fixed.ID_STRUCTURAL) > 0)
    known = (
        zone
        | (shaped & (strong >= F.when(scan, 2).otherwise(3)))
        | (shaped & (strong >= 2) & (strong + weak >= 5))
        | ((cards > 0) & ((strong + weak >= 2) | (F.coalesce("ocr_conf", F.lit(0.0)) < 70)))
    )
    identity = short & known
    words = F.size(F.filter(F.split("text", r"\s+"), lambda w: w.rlike(r"^\p{L}{3,}\z")))
    unread = scan & ((words < 12) | (F.coalesce("ocr_conf", F.lit(100.0)) < 60))
    clue_text = F.concat(F.lit("Page "), F.col("page"), F.when(zone, ": machine-readable zone").otherwise(": clues of an identity document"))
    # a condition, not a filter before: Spark works out what a filter holds twice for every row
    what = F.when(worth, F.when(identity, "B4P").when(unread, "C7"))
    rows = pages.withColumn("what", what).where("what is not null")
    nowhere = F.lit(None).cast("int")
    return rows.select(
        "doc_id", "page", F.lit(90 * STRIDE).alias("seq"), nowhere.alias("start"), nowhere.alias("end"),
        F.when(F.col("what") == "B4P", clue_text).otherwise(F.concat(F.lit("Page "), F.col("page"), F.lit(": unreadable"))).alias("text"),
        F.col("what").alias("category"),
        F.when(F.col("what") == "B4P", "identity-page").otherwise("unreadable-page").alias("detector"),
    )


def signature_findings(images: DataFrame) -> DataFrame:
    """Columns for constructed() of images that may be signatures (B6), from images (doc_id,
    page, x, y, w, h) of pages (page_width, page_height) that are no scans: small, at least
    40 by 12 points, and not in the top 15 %."""
    small = F.col("w") * F.col("h") <= 0.25 * F.col("page_width") * F.col("page_height")
    low = F.col("y") + F.col("h") <= F.col("page_height") * 0.85
    rows = images.where(small & (F.col("w") >= 40) & (F.col("h") >= 12) & low & ~F.col("is_scan"))
    nowhere = F.lit(None).cast("int")
    number = F.row_number().over(Window.partitionBy("doc_id", "page").orderBy("y", "x", "w", "h"))
    return rows.select(
        "doc_id", "page", (F.lit(91 * STRIDE) + number).alias("seq"), nowhere.alias("start"), nowhere.alias("end"),
        F.concat(F.lit("Image "), F.round("w").cast("int"), F.lit("x"), F.round("h").cast("int")).alias("text"),
        F.lit("B6").alias("category"), F.lit("image").alias("detector"),
    )
