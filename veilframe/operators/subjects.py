"""Persons across a document: shared keys, coherent treatment, variants of names, numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilframe.functions.patterns import BLANK, matches, slice_of
from veilframe.functions.validators import name_key
from veilframe.operators.findings import COLUMNS, constructed, is_person, looked_up
from veilframe.operators.names import surname
from veilframe.operators.silence import swept
from veilframe.plans.folds import islands
from veilframe.rules import fixed
from veilframe.rules.tables import WEIGHTS


def reconciled(findings: DataFrame) -> DataFrame:
    """A surname alone (or after an initial) takes the key of the full name with that surname,
    if the document has one such name only."""
    person = is_person(F.col("category")) & F.col("subject_key").isNotNull()
    full = findings.where(person).select("doc_id", name_key(surname(F.col("text"))).alias("alone"), F.col("subject_key").alias("full_key"))
    full = full.where("alone is not null").groupBy("doc_id", "alone").agg(F.min("full_key").alias("full_key"), F.count_distinct("full_key").alias("n")).where("n = 1")
    initial = r"^\p{Lu}\.\s?"
    alone = person & (~F.col("subject_key").contains(" ") | F.col("text").rlike(initial))
    rows = findings.withColumn("alone", F.when(alone, name_key(F.regexp_replace("text", initial, ""))))
    joined = rows.join(full.drop("n"), ["doc_id", "alone"], "left")
    return joined.withColumn("subject_key", F.coalesce("full_key", "subject_key")).select(*COLUMNS)


def coherent(findings: DataFrame) -> DataFrame:
    """A person's weightiest qualification spreads to their occurrences without one; a health
    context anywhere turns their payments into C2_health."""
    person = is_person(F.col("category")) & F.col("subject_key").isNotNull() & F.col("start").isNotNull()
    kind = F.when(F.col("band") == "P", "P").otherwise(F.col("proposal_key"))
    weight = F.coalesce(looked_up(kind, {k: str(v) for k, v in WEIGHTS.items()}).cast("int"), F.lit(0))
    rows = findings.withColumn("who", F.when(person, F.col("subject_key"))).withColumn("weight", weight)
    order = F.struct((-F.col("weight")).alias("w"), "page", "start", "seq", "category", "band", "proposal_key", "decision", "default_decision", "note")
    sick = F.min(F.when(F.col("health_context").isNotNull(), F.struct("page", "start", "seq", "health_context")))
    known = rows.where("who is not null").groupBy("doc_id", "who").agg(
        F.count("*").alias("n"), F.min(order).alias("guide"), sick["health_context"].alias("sick")
    )
    known = known.where("n > 1")
    rows = rows.join(known, ["doc_id", "who"], "left")
    to_health = F.col("sick").isNotNull() & (F.col("category") == "C2") & (F.col("proposal_key") != "C2_health")
    note = F.concat_ws("; ", F.nullif("note", F.lit("")), F.concat(F.lit("health or hardship of the same person: "), F.col("sick")))
    rows = rows.withColumns({"note": F.when(to_health, note).otherwise(F.col("note")), "proposal_key": F.when(to_health, "C2_health").otherwise(F.col("proposal_key"))})
    guide_key = F.when(F.col("sick").isNotNull() & (F.col("guide.category") == "C2"), F.lit("C2_health")).otherwise(F.col("guide.proposal_key"))
    spread = (F.col("guide.w") < 0) & (F.col("category") == "C1") & (F.col("proposal_key") == "C1") & (F.col("guide.seq") != F.col("seq"))
    spread = F.coalesce(spread, F.lit(False))
    told = F.concat(F.lit("same person"), F.when(F.col("guide.note") != "", F.concat(F.lit(" ("), F.col("guide.note"), F.lit(")"))).otherwise(""))
    new = {c: F.when(spread, F.col(f"guide.{c}")).otherwise(F.col(c)) for c in ("category", "band", "decision", "default_decision")}
    new |= {"proposal_key": F.when(spread, guide_key).otherwise(F.col("proposal_key")), "note": F.when(spread, told).otherwise(F.col("note"))}
    return rows.withColumns(new).select(*COLUMNS)


def _apart(rows: list[dict]) -> list[dict]:
    """Of new spans that overlap each other the first stays."""
    kept: list[dict] = []
    for row in rows:
        if not kept or row["start"] >= kept[-1]["end"]:
            kept.append(row)
    return kept


#: Characters between the parts of a surname of several words, at most.
SPACE = 256


def _places(pages: DataFrame, families: DataFrame) -> DataFrame:
    """doc_id, page, start, found, k, persons: where pages have a surname of their document (doc_id,
    family, k, persons), with the initial before it if there is one; found begins with a capital.

    Words of pages meet the first words of surnames by document and word; only surnames of
    several words look at the text again, which then comes once for all places of its page."""
    word = r"\p{L}+"
    families = families.withColumn("word", F.lower(F.regexp_extract("family", word, 0)))
    named = pages.select("doc_id", "page", "text").join(families.select("doc_id").distinct(), "doc_id", "left_semi")
    text = F.col("text")
    # capitals, and words after a capital and a dot
    words = matches(text, r"(?<!\p{L})(?:\p{Lu}\p{L}*|(?<=\p{Lu}\.|\p{Lu}\.\s)\p{L}+)(?!\p{L})")
    lead = F.transform(words, lambda m: F.struct(m["start"].alias("at"), m["text"].alias("own"), slice_of(text, m["start"] - 4, m["start"]).alias("lead")))
    rows = named.select("doc_id", "page", F.explode(lead).alias("m")).select("doc_id", "page", "m.at", "m.own", "m.lead", F.lower("m.own").alias("word"))
    rows = rows.join(families, ["doc_id", "word"])
    single = F.lower("family") == F.col("word")
    short = rows.where(single).select("doc_id", "page", "at", "lead", "own", "k", "persons")
    # the rest of the surname, with either apostrophe and any blanks
    quoted = F.replace(F.replace(F.col("family"), F.lit("'"), F.lit(r"\E['’]\Q")), F.lit(" "), F.lit(r"\E" + BLANK + r"+\Q"))
    pattern = F.concat(F.lit(r"(?iu)^\Q"), quoted, F.lit(r"\E(?!\p{L})"))
    each = F.struct("at", "lead", pattern.alias("pattern"), (F.length("family") + F.when(F.col("family").contains(" "), SPACE).otherwise(1)).alias("n"), "k", "persons")
    by_page = rows.where(~single).groupBy("doc_id", "page").agg(F.collect_list(each).alias("hits")).join(named, ["doc_id", "page"])
    own = lambda h: F.regexp_substr(slice_of(text, h["at"], h["at"] + h["n"]), h["pattern"])
    told = F.transform("hits", lambda h: F.struct(h["at"].alias("at"), h["lead"].alias("lead"), own(h).alias("own"), h["k"].alias("k"), h["persons"].alias("persons")))
    long = by_page.select("doc_id", "page", F.explode(told).alias("h")).select("doc_id", "page", "h.*").where("own is not null")
    both = short.unionByName(long).withColumn("initial", F.regexp_extract("lead", r"(?<!\p{L})\p{L}\." + BLANK + r"?\z", 0))
    found = F.concat("initial", "own")
    return both.select("doc_id", "page", (F.col("at") - F.length("initial")).alias("start"), found.alias("found"), "k", "persons").where(found.rlike(r"^\p{Lu}"))


def variants(pages: DataFrame, findings: DataFrame, first_seq: int) -> DataFrame:
    """New findings: surnames alone, with or without an initial, where no name was found yet.
    One that several persons of the document share is nobody's, unless its initial tells."""
    person = is_person(F.col("category"))
    named = findings.where(person & (F.col("band") != "P") & F.col("subject_key").isNotNull())
    upper = F.col("text") == F.upper("text")
    both = F.array(surname(F.col("text")), F.when(upper, surname(F.lower("text"))))
    rows = named.withColumn("family", F.explode(F.filter(both, lambda x: x.isNotNull()))).withColumn("k", name_key(F.col("family")))
    rows = rows.where((F.length("k") >= 3) & ~F.lower("family").isin(list(fixed.NOT_NAMES)))
    parts = F.filter(F.split(F.translate("text", "’‘`´", "''''"), r"\s+"), lambda x: (F.length(x) >= 2) & ~x.endswith("."))
    # the first part that is not the surname gives the initial
    given = F.get(F.filter(parts, lambda x: F.lower(x) != F.lower("family")), F.lit(0))
    rows = rows.withColumn("initial", F.upper(F.substring(given, 1, 1)))
    who = rows.groupBy("doc_id", "k", "subject_key").agg(
        F.min(F.struct("page", "start", "family", "category", "proposal_key", "initial")).alias("p")
    )
    families = who.groupBy("doc_id", "k").agg(
        F.min(F.struct("p.page", "p.start", "p.family"))["family"].alias("family"),
        F.collect_list(F.struct("subject_key", "p.category", "p.proposal_key", "p.initial")).alias("persons"),
    )
    seen = _places(pages, families)
    first = F.upper(F.regexp_extract("found", r"^(\p{L})\.", 1))
    fitting = F.filter("persons", lambda x: x["initial"] == first)
    one = F.when(F.size("persons") == 1, F.get("persons", F.lit(0))).when(F.size(fitting) == 1, F.get(fitting, F.lit(0)))
    seen = seen.select("doc_id", "page", "start", (F.col("start") + F.length("found")).alias("end"), F.col("found").alias("text"), one.alias("one"))
    taken = findings.where(person & F.col("start").isNotNull()).select("doc_id", "page", "start", "end")
    # of the names that begin before a place's end, does one end behind its start?
    fresh = swept(seen, F.col("end"), taken, F.col("start"), False).where("before is null or before <= start").drop("before", "after")
    fresh = islands(fresh, ["start", F.desc("end")], _apart)
    made = fresh.select(
        "doc_id", "page", (F.lit(first_seq) + F.col("start")).alias("seq"), "start", "end", "text",
        F.coalesce("one.category", F.lit("C1")).alias("category"), F.lit("variant").alias("detector"), F.lit("variant").alias("origin"),
        F.coalesce("one.proposal_key", F.lit("C1")).alias("proposal_key"), F.col("one.subject_key").alias("subject_key"),
        F.when(F.col("one").isNull(), "surname shared by several persons of the document").otherwise("").alias("note"),
    )
    return constructed(made)


def numbered(findings: DataFrame) -> DataFrame:
    """Findings with subject_no: persons of a document in the order of their first appearance."""
    person = is_person(F.col("category")) & F.col("subject_key").isNotNull()
    rows = findings.withColumn("who", F.when(person, F.col("subject_key")))
    first = rows.where("who is not null").groupBy("doc_id", "who").agg(F.min(F.struct("page", F.coalesce("start", F.lit(0)).alias("start"), "seq")).alias("first"))
    number = first.select("doc_id", "who", F.row_number().over(Window.partitionBy("doc_id").orderBy("first")).alias("subject_no"))
    return rows.join(number, ["doc_id", "who"], "left").drop("who")

