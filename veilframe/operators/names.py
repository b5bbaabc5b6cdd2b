"""Names of persons: recognizers that give entities, and the rules that make them findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilframe.functions.patterns import BLANK, let, slice_of, union
from veilframe.functions.validators import name_key
from veilframe.rules import fixed
from veilframe.rules.tables import MIN_NAME, MIN_SCORE, MIN_SCORE_LOWER

LETTER = r"[\p{L}'’\-]"
#: Characters looked at first for the letters before a name; where they are all letters, all are.
NEAR = 80


def trimmed(text: Column, start: Column, end: Column, score: Column) -> Column:
    """struct<start, end, name> of an entity: grown to whole words, without a leading title and
    marks at its ends; null if that is no name (too short, no capital, digits, common words)."""
    before = slice_of(text, start - NEAR, start)
    before = F.when((start > NEAR) & before.rlike(f"^{LETTER}*\\z"), slice_of(text, F.lit(0), start)).otherwise(before)
    grow_left = F.when(slice_of(text, start, start + 1).rlike(LETTER), F.regexp_extract(before, LETTER + r"*\z", 0))
    grow_right = F.when(slice_of(text, end - 1, end).rlike(LETTER), F.regexp_extract(F.substring(text, end + 1, F.length(text)), "^" + LETTER + "*", 0))
    a = start - F.length(F.coalesce(grow_left, F.lit("")))
    b = end + F.length(F.coalesce(grow_right, F.lit("")))
    titled = "(?iu)^" + union(fixed.TITLES) + BLANK + "+"

    def without(head: str):
        """The part without what the pattern finds at its beginning."""
        return lambda s: let(
            F.length(F.regexp_extract(s["part"], head, 0)),
            lambda n: F.struct((s["a"] + n).alias("a"), F.substring(s["part"], n + 1, F.length(s["part"])).alias("part")),
        )

    def judged(s: Column) -> Column:
        name = s["part"]
        words = F.filter(F.split(F.lower(name), r"[\s\x{A0}\p{Z}\-/]+"), lambda w: w != "")
        fine = (
            (F.length(name) >= MIN_NAME)
            & (name.rlike(r"\p{Lu}") | (score >= MIN_SCORE_LOWER))
            & name.rlike(r"\p{L}{2,}")
            & ~name.rlike(r"\p{N}")
            & ~F.forall(words, lambda w: w.isin(list(fixed.NOT_NAMES)))
        )
        return F.when(fine, F.struct(s["a"].alias("start"), (s["a"] + F.length(name)).alias("end"), name.alias("name")))

    part = let(F.struct(a.alias("a"), b.alias("b")), lambda s: F.struct(s["a"].alias("a"), slice_of(text, s["a"], s["b"]).alias("part")))
    part = let(part, without(titled))
    part = let(part, lambda s: F.struct(s["a"].alias("a"), F.regexp_replace(s["part"], r"[^\p{L}\p{N}.]+\z", "").alias("part")))
    return let(let(part, without(r"^[^\p{L}\p{N}]*")), judged)


def entities_of(pages: DataFrame, names: DataFrame, score: float = 0.99) -> DataFrame:
    """A literal recognizer: doc_id, page, start, end, score of every place where a page
    (doc_id, page, text) holds one of its document's names (doc_id, name)."""
    found = pages.select("doc_id", "page", "text").join(names.where("name <> ''").distinct(), "doc_id")
    found = found.where(F.instr(F.col("text"), F.col("name")) > 0)
    pieces = F.split("text", F.concat(F.lit(r"\Q"), F.col("name"), F.lit(r"\E")), -1)
    before = F.slice(pieces, 1, F.size(pieces) - 1)
    rows = found.select("doc_id", "page", "name", F.posexplode(before).alias("nth", "piece"))
    order = Window.partitionBy("doc_id", "page", "name").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
    n = F.length("name")
    start = (F.sum(F.length("piece")).over(order) + F.col("nth") * n).cast("int")
    return rows.select("doc_id", "page", start.alias("start"), (start + n).alias("end"), F.lit(score).alias("score"))


def name_findings(pages: DataFrame, entities: DataFrame, first_seq: int) -> DataFrame:
    """Columns for constructed() from a recognizer's entities (doc_id, page, start, end, score).
    Entities below the least score are left out."""
    each = F.struct("start", "end", "score")
    met = entities.where(F.col("score") >= MIN_SCORE).groupBy("doc_id", "page").agg(F.collect_list(each).alias("entities"))
    made = F.transform("entities", lambda e: F.struct(e["start"].alias("at"), trimmed(F.col("text"), e["start"], e["end"], e["score"]).alias("made")))
    rows = met.join(pages.select("doc_id", "page", "text"), ["doc_id", "page"])
    rows = rows.select("doc_id", "page", F.explode(F.filter(made, lambda m: m["made"].isNotNull())).alias("m"))
    return rows.select(
        "doc_id", "page", (F.lit(first_seq) + F.col("m.at")).alias("seq"), "m.made.start", "m.made.end",
        F.col("m.made.name").alias("text"), F.lit("C1").alias("category"), F.lit("recognizer").alias("detector"),
        name_key(F.col("m.made.name")).alias("subject_key"),
    )


def surname(name: Column) -> Column:
    """The surname of a full name with its particles; null for one word. Names in capitals are
    taken as surname first, others as surname last."""
    parts = F.filter(F.split(F.translate(name, "’‘`´", "''''"), BLANK + "+"), lambda p: (F.length(p) >= 2) & ~p.endswith("."))
    n = F.size(parts)
    # fixed value: particles that belong to a surname
    particle = r"(?iu)^(?:d[aeio]|d'|da[il]|dall[ao]?|dell[aeio]|del|de[il]|d[eu]s|l[ao]|le|san|santa|santo|van|von|mac|mc)\z"
    leading = F.aggregate(
        F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))),
        F.lit(1),
        lambda k, i: F.when((k == i) & (i < n - 1) & F.get(parts, i - 1).rlike(particle), k + 1).otherwise(k),
    )
    trailing = F.aggregate(
        F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))),
        n - 1,
        lambda k, i: F.when((k == n - i) & (k > 1) & F.get(parts, k - 1).rlike(particle), k - 1).otherwise(k),
    )
    front = F.array_join(F.slice(parts, 1, F.least(leading, F.greatest(n, F.lit(1)))), " ")
    back = F.array_join(F.slice(parts, F.greatest(trailing, F.lit(0)) + 1, F.greatest(n, F.lit(1))), " ")
    return F.when(n < 2, None).when(name == F.upper(name), front).when(F.length(back) >= 3, back)


