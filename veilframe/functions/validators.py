"""Checks of identifiers as column expressions (null counts as invalid)."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilframe.rules import fixed

# ---- fixed values: letters that stand for digits 0-9, values of odd places (0-9, A-Z), and
# lengths of bank account numbers by country
DIGIT_LETTERS = "LMNPQRSTUV"
ODD = (1, 0, 5, 7, 9, 13, 15, 17, 19, 21, 1, 0, 5, 7, 9, 13, 15, 17, 19, 21, 2, 4, 18, 20, 11, 3, 6, 8, 12, 14, 16, 10, 22, 25, 24, 23)
IBAN_LENGTHS = {
    "AT": 20, "BE": 16, "BG": 22, "CH": 21, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "EE": 20, "ES": 24, "FI": 18, "FR": 27,
    "GB": 22, "GR": 27, "HR": 21, "HU": 28, "IE": 22, "IT": 27, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MT": 31,
    "NL": 18, "NO": 15, "PL": 28, "PT": 25, "RO": 24, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "VA": 22,
}
# ---- end of fixed values

ALNUM = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def squeezed(text: Column) -> Column:
    return F.upper(F.regexp_replace(text, r"[\s\x{A0}\x{FEFF}\p{Z}]+", ""))


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _uniform(number: Column) -> Column:
    return number.rlike(r"^([0-9])\1+$")


def tax_code(text: Column) -> Column:
    """16 characters with a possible birthday and the right check letter."""
    code = squeezed(text)
    shape = code.rlike("^[A-Z]{6}[0-9LMNPQRSTUV]{2}[ABCDEHLMPRST][0-9LMNPQRSTUV]{2}[A-Z][0-9LMNPQRSTUV]{3}[A-Z]$")
    day = F.translate(F.substring(code, 10, 2), DIGIT_LETTERS, "0123456789").try_cast("int")
    odd = F.array(*[F.lit(x) for x in ODD])

    def place(i: Column) -> Column:
        n = F.instr(F.lit(ALNUM), F.substring(code, i, F.lit(1)))  # 1 to 36, 0 if there is none
        even = F.when(n > 10, n - 11).otherwise(n - 1)
        return F.when(i % 2 == 1, F.coalesce(F.get(odd, n - 1), F.lit(0))).otherwise(even)

    total = F.aggregate(F.transform(F.sequence(F.lit(1), F.lit(15)), place), F.lit(0), lambda a, x: a + x)
    letter = F.substring(F.lit(ALNUM), total % 26 + 11, F.lit(1))
    return F.coalesce(shape & (day.between(1, 31) | day.between(41, 71)) & (letter == F.substring(code, 16, 1)), F.lit(False))


def iban_length(text: Column) -> Column:
    """The length for the country of an account number, null for other countries."""
    return F.element_at(F.create_map(*[F.lit(x) for kv in IBAN_LENGTHS.items() for x in kv]), F.upper(F.substring(text, 1, 2)))


def iban(text: Column) -> Column:
    """15 to 34 characters, as many as the country has, with remainder 1 modulo 97."""
    code = squeezed(text)
    fits = F.length(code).between(15, 34) & code.rlike("^[A-Z]{2}[0-9]{2}[A-Z0-9]+$")
    fits &= F.coalesce(iban_length(code) == F.length(code), F.lit(True))
    turned = F.split(F.concat(F.substring(code, 5, 34), F.substring(code, 1, 4)), "")

    def step(rest: Column, c: Column) -> Column:
        n = F.instr(F.lit(ALNUM), c) - 1
        return (rest * F.when(n > 9, 100).otherwise(10) + n) % 97

    rest = F.aggregate(F.filter(turned, lambda c: c != ""), F.lit(0), step)
    return F.coalesce(fits & (rest == 1), F.lit(False))


def luhn(text: Column) -> Column:
    """13 to 19 digits, not all the same, with the right check digit."""
    number = digits(text)
    return F.coalesce(F.length(number).between(13, 19) & ~_uniform(number) & F.call_function("luhn_check", number), F.lit(False))


def vat_number(text: Column) -> Column:
    """11 digits, not all the same, with the right check digit (the same sum as luhn's)."""
    number = digits(text)
    return F.coalesce((F.length(number) == 11) & ~_uniform(number) & F.call_function("luhn_check", number), F.lit(False))


def birth_date(text: Column, as_of: str | None = None) -> Column:
    """A real date from 1900 to as_of (today if there is none)."""
    day = F.regexp_extract(text, r"(\d{1,2}[/.\-]\d{1,2}[/.\-]\d{4})", 1)
    date = F.try_to_date(F.regexp_replace(day, r"[.\-]", "/"), "d/M/yyyy")
    last = F.lit(as_of).cast("date") if as_of else F.current_date()
    return F.coalesce((date >= F.lit("1900-01-01").cast("date")) & (date <= last), F.lit(False))


def institutional_domain(address: Column) -> Column:
    """A label of the domain begins with a public body's prefix, or the domain has its suffix."""
    domain = F.coalesce(F.get(F.split(F.lower(address), "@"), F.lit(1)), F.lit(""))
    labels = F.split(domain, r"\.")
    ends = [d for d in fixed.INSTITUTION_DOMAINS if d.startswith(".")]
    starts = "^(?:" + "|".join(d for d in fixed.INSTITUTION_DOMAINS if not d.startswith(".")) + ")"
    suffix = F.lit(False)
    for d in ends:
        suffix |= domain.endswith(d) | (domain == d[1:])
    return suffix | F.exists(labels, lambda x: x.rlike(starts))


def personal_domain(address: Column) -> Column:
    domain = F.coalesce(F.get(F.split(F.lower(address), "@"), F.lit(1)), F.lit(""))
    return domain.rlike(r"(?:^|\.)(?:" + "|".join(d.replace(".", r"\.") for d in fixed.PERSONAL_DOMAINS) + r")\z")


def personal_email(address: Column) -> Column:
    """Not an office's mailbox at a public body: a personal provider, a name before the @, or
    anything else that is not both."""
    low = F.lower(address)
    parts = F.split(low, "@")
    local, domain = F.get(parts, F.lit(0)), F.coalesce(F.get(parts, F.lit(1)), F.lit(""))
    words = F.filter(F.split(local, r"[._\-]"), lambda w: w != "")
    offices = F.array(*[F.lit(x) for x in dict.fromkeys(fixed.OFFICE_MAILBOXES)])
    named = (
        (F.size(words) >= 2)
        & F.forall(words, lambda w: w.rlike(r"^[a-z]+\d{0,3}\z"))
        & F.exists(words, lambda w: F.length(w) >= 3)
        & ~F.exists(words, lambda w: F.array_contains(offices, F.regexp_replace(w, r"\d+\z", "")))
    )
    plain = F.regexp_replace(local, r"[._\-]", "")
    office = F.exists(offices, lambda x: (plain == x) | (plain.startswith(x) & (F.length(x) >= 4)))
    return F.coalesce((domain != "") & (personal_domain(low) | named | ~(institutional_domain(low) & office)), F.lit(False))


VALIDATORS = {
    "tax_code": tax_code, "iban": iban, "luhn": luhn, "vat_number": vat_number, "birth_date": birth_date, "personal_email": personal_email,
}


def amount(text: Column) -> Column:
    """A number like 1.234,56 as an exact decimal."""
    return F.regexp_replace(F.regexp_replace(text, r"\.", ""), ",", ".").try_cast("decimal(18,2)")


def _bare() -> tuple[str, str]:
    """Letters with marks, and the letters that they are without: by Unicode's decompositions,
    for all blocks of Latin letters."""
    pairs = []
    for code in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        plain = "".join(c for c in unicodedata.normalize("NFD", chr(code)) if not unicodedata.combining(c))
        if len(plain) == 1 and plain != chr(code):
            pairs.append((chr(code), plain))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


MARKED, BARE = _bare()


def name_key(name: Column) -> Column:
    """Lower case, without accents, one kind of apostrophe, letters and single blanks only."""
    plain = F.translate(F.regexp_replace(name, r"\p{M}", ""), MARKED + "’‘`´", BARE + "''''")
    low = F.regexp_replace(F.lower(plain), r"[^a-z\s']", " ")
    return F.trim(F.regexp_replace(low, r"\s+", " "))
