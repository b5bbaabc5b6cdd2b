"""Short acts with what they must and must not give, one or more for each rule of the analysis."""

import re
from dataclasses import dataclass, field

import pytest

from veilframe.operators.names import entities_of
from veilframe.operators.redact import OMISSIS, redacted
from veilframe.plans.pipeline import analysed
from veilframe.sources.files import BODY, HEAD


@dataclass
class Case:
    """expected: (text, category, proposal key, decision), null where any will do; "=" before a
    text: the finding is just that. forbidden: (text, category), null category: masked in any way."""

    text: str
    names: tuple[str, ...] = ()
    expected: tuple = ()
    forbidden: tuple = ()
    purpose: str = "publish"
    top: float = field(default=BODY)


CASES = {
    "health beside a name": Case(
        "La signora Carla Neri è affetta da una grave patologia cardiaca.", ("Carla Neri",),
        (("patologia", "A1", None, "mask"), ("Carla Neri", "C1", None, "mask")),
    ),
    "law on disability without a person": Case("Sono previsti permessi ai sensi della legge 104/1992.", (), (), (("104", "A1"),)),
    "judicial data beside a name": Case(
        "Visto il ricorso al TAR presentato da Paolo Gallo contro il diniego.", ("Paolo Gallo",),
        (("ricorso", "C3", "C3", "mask"), ("Paolo Gallo", "C1", None, "mask")),
    ),
    "tax code": Case("Codice fiscale: RSSMRA85T10A562S", (), (("=RSSMRA85T10A562S", "B1", None, "mask"),)),
    "tax code with a wrong sign": Case("Codice fiscale: RSSMRA85T10A562T", (), (), (("RSSMRA85T10A562T", "B1"),)),
    "account with words after it": Case(
        "Accredito su IT60X0542811101000000123456 presso la filiale.", (), (("=IT60X0542811101000000123456", "B2", None, None),), (("filiale", None),)
    ),
    "account in small letters": Case("Accredito su it60x0542811101000000123456.", (), (("it60x0542811101000000123456", "B2", None, None),)),
    "cards": Case(
        "Carta 4111 1111 1111 1111 oppure 5500-0000-0000-0004.", (), (("4111 1111 1111 1111", "B2", None, None), ("5500-0000-0000-0004", "B2", None, None))
    ),
    "VAT number of a company": Case("Affidamento alla società Beta s.r.l., P. IVA 00743110157.", (), (("00743110157", "C6", "C6_company", "keep"),), (("00743110157", None), ("Beta", None))),
    "VAT number of a person, published": Case("Il geometra indica la partita IVA 00743110157.", (), (("00743110157", "C6", "C6", "mask"),)),
    "VAT number of a person, private": Case("Il geometra indica la partita IVA 00743110157.", (), (("00743110157", "C6", "C6", "mask"),), purpose="private"),
    "personal mail": Case("Risponde a carla.neri@gmail.com entro domani.", (), (("=carla.neri@gmail.com", "B3", None, None),)),
    "contact of an office in the head": Case("Comune di Prato\nTel. 0574 1836111", (), (("0574 1836111", "P", None, "keep"),), (("0574", None),), top=HEAD),
    "contact of a person in the head": Case("Dott. Carla Neri\ncell. 347 7654321", ("Carla Neri",), (("347 7654321", "B3", None, "mask"),), top=HEAD),
    "contacts of a body": Case("Scrivere a protocollo@comune.prato.it o a ufficio.tecnico@pec.comune.prato.it.", (), (), (("protocollo", None), ("ufficio.tecnico", None))),
    "mobile phone": Case("Chiamare il cellulare 333 1234567.", (), (("333 1234567", "B3", None, None),)),
    "mobile phone of a company": Case("La ditta Beta s.r.l. risponde al cell. 333 1234567.", (), (("333 1234567", "B3", None, "mask"),), (("Beta", None),)),
    "telephone of an office in the text": Case("Rivolgersi all'Ufficio Tributi, tel. 0574 1836222.", (), (), (("0574", None),)),
    "birth and residence": Case(
        "Il sottoscritto Paolo Gallo, nato a Prato il 12/03/1980 e residente in Via Roma 12, Prato.", ("Paolo Gallo",),
        (("Paolo Gallo", "C1", None, "mask"), ("12/03/1980", "B5", None, None), ("Via Roma", "B3", None, None)),
    ),
    "date that is no birth": Case("La seduta del 12/03/1980 è stata rinviata.", (), (), (("12/03/1980", "B5"),)),
    "marital status and household": Case("Stato civile: coniugata, con nucleo familiare composto da 4 persone.", (), (("coniugata", "B5", None, None), ("nucleo familiare", "B5", None, None))),
    "number of a document": Case("Carta d'identità n. CA12345BB rilasciata dal Comune.", (), (("CA12345BB", "B4", None, None),)),
    "document without a number": Case("Si allega la carta d'identità del richiedente.", (), (), (("carta", "B4"),)),
    "documents that are let in": Case("Sono ammessi carta d'identità, patente di guida o passaporto.", (), (), (("patente", "B4"), ("carta", "B4P"))),
    "role and third party": Case(
        "Responsabile del procedimento: Anna Verdi. Controinteressato: Paolo Gallo.", ("Anna Verdi", "Paolo Gallo"),
        (("Anna Verdi", "P", None, "keep"), ("Paolo Gallo", "B7", None, "mask")),
    ),
    "word of a role that is none": Case("Il responsabile della caduta sarebbe Paolo Gallo, che passava di lì.", ("Paolo Gallo",), (("Paolo Gallo", "C1", None, None),), (("Paolo Gallo", "P"),)),
    "role without a name": Case("Il Responsabile del Servizio Finanziario", (), (), (("Servizio", "C1"),)),
    "name before its role": Case("Anna Verdi, Responsabile Unico del Procedimento", ("Anna Verdi",), (("Anna Verdi", "P", None, "keep"),)),
    "signature of a head of department": Case("Il Dirigente\nDott. Anna Verdi", ("Anna Verdi",), (("Anna Verdi", "P", None, "keep"),)),
    "signed but no role": Case("Il modulo è firmato da Paolo Gallo.", ("Paolo Gallo",), (("Paolo Gallo", "C1", None, "mask"),)),
    "witness": Case("È stato sentito il testimone Paolo Gallo.", ("Paolo Gallo",), (("Paolo Gallo", "B7", None, "mask"),)),
    "minor and parent": Case("Il minore Luca Sala vive con la madre Carla Neri.", ("Luca Sala", "Carla Neri"), (("Luca Sala", "B8", None, "mask"), ("Carla Neri", None, None, "mask"))),
    "minor, named again": Case(
        "Il minore Luca Sala frequenta la scuola. Il servizio mensa spetta a Luca Sala.", ("Luca Sala",), (("Luca Sala", "B8", None, "mask"),), (("Luca Sala", "C1"),)
    ),
    "representative who is no contractor": Case("La società Beta s.r.l., nella persona del legale rappresentante Paolo Gallo.", ("Paolo Gallo",), (("Paolo Gallo", "C1", None, "mask"),)),
    "sole trader with a contract": Case("Si affida il servizio alla ditta individuale Paolo Gallo.", ("Paolo Gallo",), (("Paolo Gallo", "C1", "C1_contractor", "keep"),)),
    "contractor in private": Case("Si affida il servizio alla ditta individuale Paolo Gallo.", ("Paolo Gallo",), (("Paolo Gallo", "C1", "C1_contractor", "mask"),), purpose="private"),
    "surname in capitals": Case("Paolo Gallo chiede il rimborso. Il sig. GALLO allega copia.", ("Paolo Gallo",), (("=GALLO", "C1", None, None),)),
    "surname alone": Case("Paolo Gallo chiede il rimborso. Il sig. Gallo allega copia.", ("Paolo Gallo",), (("=Gallo", "C1", None, None),)),
    "benefit above": Case("Contributo di euro 2.500,00 a favore di Paolo Gallo.", ("Paolo Gallo",), (("Paolo Gallo", "C2", "C2_above", "keep"),)),
    "benefit above, in private": Case("Contributo di euro 2.500,00 a favore di Paolo Gallo.", ("Paolo Gallo",), (("Paolo Gallo", "C2", "C2_above", "mask"),), purpose="private"),
    "benefit below": Case("Contributo di euro 400,00 a favore di Paolo Gallo.", ("Paolo Gallo",), (("Paolo Gallo", "C2", "C2_below", "mask"),)),
    "just one thousand": Case("Contributo di euro 1.000,00 a favore di Paolo Gallo.", ("Paolo Gallo",), (("Paolo Gallo", "C2", "C2_below", "mask"),)),
    "euro after the amount": Case("Contributo di 2.500,00 euro a favore di Paolo Gallo.", ("Paolo Gallo",), (("Paolo Gallo", "C2", "C2_above", None),)),
    "benefit that tells of health": Case("Contributo di euro 2.500,00 per disabilità grave a favore di Paolo Gallo.", ("Paolo Gallo",), (("Paolo Gallo", "C2", "C2_health", "mask"),)),
    "payee named again": Case("Contributo di euro 2.500,00 a favore di Paolo Gallo. La richiesta di Paolo Gallo è accolta.", ("Paolo Gallo",), (("Paolo Gallo", "C2", "C2_above", "keep"),), (("Paolo Gallo", None),)),
    "no text": Case(""),
}


@pytest.fixture(scope="module")
def results(spark):
    found, left = {}, {}
    for purpose in ("publish", "private"):
        rows = [(i, 1, c.text, c.top) for i, c in enumerate(CASES.values()) if c.purpose == purpose]
        pages = spark.createDataFrame(rows, "doc_id long, page int, text string, top double")
        names = [(i, n) for i, c in enumerate(CASES.values()) for n in c.names if c.purpose == purpose]
        entities = entities_of(pages, spark.createDataFrame(names, "doc_id long, name string"))
        findings = analysed(pages, entities, purpose).cache()
        for r in findings.collect():
            found.setdefault(r.doc_id, []).append(r)
        left |= {r.doc_id: r.redacted_text for r in redacted(pages, findings, OMISSIS).collect()}
    return found, left


def _plain(text):
    return re.sub(r"\s+", " ", text or "").strip().lower()


@pytest.mark.parametrize("name", CASES)
def test_case(results, name):
    at, case = list(CASES).index(name), CASES[name]
    rows, left = results[0].get(at, []), results[1].get(at, "")
    told = [(r.text, r.category, r.proposal_key, r.decision, r.band) for r in rows]
    for text, *wanted in case.expected:
        own = _plain(text.removeprefix("="))
        fits = [r for r in rows if (_plain(r.text) == own if text[0] == "=" else own in _plain(r.text))]
        fits = [r for r in fits if all(w is None or w == got for w, got in zip(wanted, (r.category, r.proposal_key, r.decision)))]
        assert fits, (text, wanted, told)
        if wanted[2] == "mask":
            assert any(r.text not in left for r in fits), left
    for text, category in case.forbidden:
        held = [r for r in rows if _plain(text) in _plain(r.text)]
        if category is None:
            assert not [r for r in held if r.decision == "mask" and r.band != "P"], told
            assert text in left
        else:
            assert category not in {r.category for r in held}, told
