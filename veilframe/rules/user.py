"""Rules that users give as tables: detectors, kinds of context, purposes.

Rules become expressions of the plan, so their tables come to the driver; a table of more than
MOST rows is refused."""

from __future__ import annotations

from pyspark.sql import DataFrame

from veilframe.functions.patterns import union
from veilframe.functions.validators import VALIDATORS
from veilframe.operators.context import KINDS
from veilframe.operators.detect import DETECTORS, STRIDE, Detector
from veilframe.rules.tables import CATEGORIES

MOST = 1000


def _rows(table: DataFrame, needed: tuple[str, ...]) -> list[dict]:
    missing = set(needed) - set(table.columns)
    if missing:
        raise ValueError(f"a table of rules lacks {', '.join(sorted(missing))}")
    rows = [r.asDict() for r in table.orderBy(*needed).limit(MOST + 1).collect()]
    if len(rows) > MOST:
        raise ValueError(f"a table of rules has more than {MOST} rows")
    if any(r[c] is None for r in rows for c in needed):
        raise ValueError(f"a rule lacks one of {', '.join(needed)}")
    return rows


def detectors(table: DataFrame, base: tuple[Detector, ...] = DETECTORS) -> tuple[Detector, ...]:
    """base and the table's detectors (name, category, pattern; words: boolean, the pattern is one
    of words as they stand; ignore_case, true where null; validator, a check's name). One with the
    name of a detector in base takes its place. Patterns are Java's."""
    made = {d.name: d for d in base}
    own = set()
    for r in _rows(table, ("name", "category", "pattern")):
        if r["category"] not in CATEGORIES:
            raise ValueError(f"{r['name']}: there is no category {r['category']}")
        if r.get("validator") and r["validator"] not in VALIDATORS:
            raise ValueError(f"{r['name']}: there is no check {r['validator']}")
        if r["name"] in own:
            raise ValueError(f"two detectors are named {r['name']}")
        own.add(r["name"])
        pattern = union((r["pattern"],), bounded=True) if r.get("words") else r["pattern"]
        made[r["name"]] = Detector(r["name"], r["category"], pattern, r.get("ignore_case") is not False, r.get("validator"))
    if len(made) > 90:  # numbers from 90 * STRIDE on are those of pages, names and variants
        raise ValueError(f"90 detectors at most; numbers of findings are spaced by {STRIDE}")
    return tuple(made.values())


def kinds(table: DataFrame) -> dict[str, tuple[str, int, int, bool]]:
    """The kinds of context with the table's patterns (kind, pattern), which are added to those
    there are; radius and lines, where they are not null, take the place of the kind's own."""
    made = dict(KINDS)
    for r in _rows(table, ("kind", "pattern")):
        if r["kind"] not in KINDS or r["kind"] == "amount":
            raise ValueError(f"patterns cannot be added to {r['kind']}")
        pattern, radius, lines, exclusive = made[r["kind"]]
        radius, lines = (own if r.get(c) is None else r[c] for own, c in ((radius, "radius"), (lines, "lines")))
        made[r["kind"]] = (f"(?:{pattern}|{r['pattern']})", radius, lines, exclusive)
    return made
