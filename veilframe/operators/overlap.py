"""Overlap resolution and interval algebra on spans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.operators.findings import COLUMNS
from veilframe.plans.folds import islands
from veilframe.rules.tables import PERSONS, PRIORITY


def _resolve(rows: list[dict]) -> list[dict]:
    """Spans of a page by start and number: an ordered sweep in which a kept span may grow.
    Spans that end before the present one starts leave the sweep."""
    kept: dict[int, dict] = {}
    open_: list[int] = []  # numbers of kept spans that may still be met, latest last
    for number, row in enumerate(rows):
        if row["start"] is None:
            kept[number] = row
            continue
        person, rank = row["category"] in PERSONS, PRIORITY[row["band"]]
        open_ = [n for n in open_ if kept[n]["end"] > row["start"]]
        gone: list[int] = []
        for n in reversed(open_):
            own = kept[n]
            if (own["category"] in PERSONS) != person:
                continue
            same, other = own["category"] == row["category"], PRIORITY[own["band"]]
            inside = own["start"] <= row["start"] and row["end"] <= own["end"]
            around = row["start"] <= own["start"] and own["end"] <= row["end"]
            if not (inside or around) and other == rank:
                own["text"] += row["text"][own["end"] - row["start"] :]
                own["end"] = row["end"]
                if not same:
                    own["note"] = "; ".join(x for x in (own["note"], "overlaps " + row["category"]) if x)
                break
            if same and inside and other >= rank:
                break
            if same and around and rank >= other:
                gone.append(n)
        else:
            kept[number] = row
            open_.append(number)
        for n in gone:
            del kept[n]
            open_.remove(n)
    return list(kept.values())


def resolved(findings: DataFrame) -> DataFrame:
    """Spans without needless overlaps, page by page: of two spans of one category the one
    inside the other goes if its band is no stronger; spans of equally strong bands that
    overlap in part become their union; names and other data never displace each other; other
    overlaps stay. Findings without a place stay as they are."""
    return islands(findings.select(*COLUMNS), ["start", "seq"], _resolve)


def merged(intervals: Column, touching: bool = True) -> Column:
    """Disjoint intervals (array<struct<start, end>>), in order, that cover the same places; those
    that only touch become one if touching."""
    empty = F.array().cast("array<struct<start:int,end:int>>")

    def step(done: Column, x: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        joined = F.concat(
            F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))),
            F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"))),
        )
        meets = x["start"] <= last["end"] if touching else x["start"] < last["end"]
        return F.when(last.isNotNull() & meets, joined).otherwise(F.concat(done, F.array(x)))

    return F.aggregate(F.sort_array(F.filter(intervals, lambda x: x["start"] < x["end"])), empty, step)


def gaps(intervals: Column, length: Column) -> Column:
    """What disjoint ordered intervals leave of [0, length)."""
    begins = F.concat(F.array(F.lit(0)), F.transform(intervals, lambda x: x["end"]))
    ends = F.concat(F.transform(intervals, lambda x: x["start"]), F.array(length))
    both = F.zip_with(begins, ends, lambda a, b: F.struct(a.alias("start"), b.alias("end")))
    return F.filter(both, lambda x: x["start"] < x["end"])
