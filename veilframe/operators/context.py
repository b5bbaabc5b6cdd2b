"""What the words around a name say of the person: minor, third party, public role, payee."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilframe.functions.patterns import BLANK, ODD_LETTERS, java, let, literals, matches, same_clause, slice_of, union
from veilframe.functions.validators import amount
from veilframe.operators.findings import COLUMNS, band_of, default_decision
from veilframe.plans.folds import folded
from veilframe.plans.staging import staged
from veilframe.rules import fixed
from veilframe.rules.tables import HEALTH_LINES, HEALTH_RADIUS, THRESHOLD

#: kind: pattern, radius, most line ends between, whether a name takes one keyword only
KINDS = {
    "minor": (union(fixed.MINORS), 90, 1, False),
    "role": (union(fixed.PUBLIC_ROLES), 70, 2, True),
    "third": (union(fixed.THIRD_PARTIES), 40, 0, False),
    "fee": (union(fixed.FEES), 250, 2, False),
    "health": (union((union(fixed.HEALTH, True), union(fixed.HARDSHIP, True))), HEALTH_RADIUS, HEALTH_LINES, False),
    "contractor": (union(fixed.CONTRACTORS), 200, 2, False),
    "amount": (fixed.AMOUNT, 250, 1, False),
    "payee": (union(fixed.BENEFICIARIES), 250, 2, False),
}
#: Its letters are told apart by what may stand between them.
SHORT_ROLE = r"\bP\.?O\.?\b"
#: By pattern, what a text must hold in small letters, else the pattern is not looked for. Patterns of users have none.
LOOKS = {
    KINDS[kind][0]: literals(patterns)  # of each alternative its longest fixed part
    for kind, patterns in (
        ("minor", fixed.MINORS), ("role", tuple(p for p in fixed.PUBLIC_ROLES if p != SHORT_ROLE)), ("third", fixed.THIRD_PARTIES), ("fee", fixed.FEES), ("health", fixed.HEALTH + fixed.HARDSHIP),
        ("contractor", fixed.CONTRACTORS), ("payee", fixed.BENEFICIARIES),
    )
} | {fixed.AMOUNT: ("€", "eur")}
LOOKS[KINDS["role"][0]] += ("po", "p.o")
PRIVATE_REACH = 70 + 60
# fixed value: what introduces somebody who only represents another
REPRESENTS = (
    r"(?:legale\s+rappresentante|rappresentante\s+legale|amministratore\s+(?:unico|delegato)|procuratore|in\s+persona\s+del"
    r"|nella\s+persona\s+di|rappresentat[oa]\s+da)\s*[:,]?\s*(?:sig\.?\s*|sig\.ra\s*|dott\.?\s*|dott\.ssa\s*|ing\.?\s*|avv\.?\s*|geom\.?\s*)?$"
)
# fixed value: words that may stand between a role and its holder
FUNCTION_WORDS = (
    "il lo la i gli le l' un una uno di del dello della dei degli delle a al allo alla ai agli alle da dal dallo dalla dai "
    "dagli dalle in nel nello nella nei negli nelle e ed o con per su"
).split()
BRIDGE = (
    r"(?iu)^(?:" + "|".join(FUNCTION_WORDS) + "|" + "|".join(fixed.TITLES) + r"|f\.to|firmato|[-–—:,()/]+|n\.|\d+)\z",
    r"^\p{Lu}[\p{Ll}'’.-]+\z",
    r"^[\p{Lu}.]{1,4}\z",
)


def _bridged(text: Column) -> Column:
    words = F.filter(F.split(text, BLANK + "+"), lambda w: w != "")
    return F.forall(words, lambda w: w.rlike(BRIDGE[0]) | w.rlike(BRIDGE[1]) | w.rlike(BRIDGE[2]))


#: Characters in a cell: keywords and names meet by the cells that they reach.
CELL = 512


def _keywords(pages: DataFrame, kinds: dict) -> DataFrame:
    """Every keyword of pages with what surrounds it, which begins at base."""

    none = F.array().cast("array<struct<kind:string,k_start:int,k_end:int,word:string,radius:int,lines:int>>")

    def words(kind: str, seen: Column) -> Column:
        pattern, radius, lines, _ = kinds[kind]
        found = F.transform(
            matches(F.col("text"), f"({pattern})" if kind != "amount" else f"(?:{pattern.replace('(' + chr(92) + 'd', '(?:' + chr(92) + 'd')})", True),
            lambda m: F.struct(
                F.lit(kind).alias("kind"), m["start"].alias("k_start"), m["end"].alias("k_end"), m["text"].alias("word"),
                F.lit(radius).alias("radius"), F.lit(lines).alias("lines"),
            ),
        )
        looks = [F.contains(seen["low"], F.lit(x)) for x in LOOKS.get(pattern, ())]
        return F.when(reduce(or_, looks, seen["odd"]), found).otherwise(none) if looks else found

    seen = F.struct(F.lower("text").alias("low"), F.col("text").rlike(f"[{ODD_LETTERS}]").alias("odd"))
    rows = pages.select("doc_id", "page", "text", "shadow", F.explode(let(seen, lambda s: F.concat(*[words(k, s) for k in kinds]))).alias("k"))
    base, last = F.greatest(F.col("k.k_start") - F.col("k.radius") - 1, F.lit(0)), F.col("k.k_end") + F.col("k.radius") + 2
    return rows.select(
        "doc_id", "page", "k.*", base.alias("base"), slice_of(F.col("text"), base, last).alias("text"), slice_of(F.col("shadow"), base, last).alias("shadow")
    )


def _pairs(pages: DataFrame, names: DataFrame, kinds: dict) -> tuple[DataFrame, DataFrame]:
    """Candidate pairs of a keyword and a name near it in the same clause; and for each name
    whether private bodies are near and whether it is a representative's.

    A pair meets once: in the first cell that both reach."""
    places = names.select("doc_id", "page", "seq", F.col("start").alias("n_start"), F.col("end").alias("n_end"))
    first, last = F.floor(F.col("n_start") / CELL), F.floor(F.col("n_end") / CELL)
    placed = places.withColumn("n_first", first).withColumn("cell", F.explode(F.sequence(first, last)))
    reach_a, reach_b = F.greatest(F.col("k_start") - F.col("radius"), F.lit(0)), F.col("k_end") + F.col("radius")
    first, last = F.floor(reach_a / CELL), F.floor(reach_b / CELL)
    # keywords of a page without names meet none
    named = pages.join(names.select("doc_id", "page").distinct(), ["doc_id", "page"], "left_semi")
    keyed = _keywords(named, kinds).withColumn("k_first", first).withColumn("cell", F.explode(F.sequence(first, last)))
    both = keyed.join(placed, ["doc_id", "page", "cell"]).where(F.col("cell") == F.greatest("k_first", "n_first"))
    distance = F.greatest(F.col("n_start") - F.col("k_end"), F.col("k_start") - F.col("n_end"), F.lit(0))
    both = both.withColumns({
        "a": F.least("k_end", "n_end") - F.col("base"), "b": F.greatest("k_start", "n_start") - F.col("base"), "d": distance,
    })
    both = both.where(F.col("d") <= F.col("radius")).withColumn("gap", slice_of(F.col("text"), F.col("a"), F.col("b")))
    both = both.where(same_clause(F.col("shadow"), F.col("a"), F.col("b"), F.col("lines")))
    both = both.where((F.col("kind") != "role") | _bridged(F.col("gap")))
    breaks = F.length("gap") - F.length(F.translate("gap", "\n", ""))
    score = F.col("d") + 20 * breaks + F.when(F.col("n_end") <= F.col("k_start"), 5).otherwise(0)
    pairs = both.select("doc_id", "page", "kind", "k_start", "word", "seq", "n_start", score.alias("score"))
    near = names.groupBy("doc_id", "page").agg(F.collect_list(F.struct("start", "end", "seq")).alias("names"))
    text = F.col("text")

    def told(n: Column) -> Column:
        zone = slice_of(text, n["start"] - PRIVATE_REACH, n["end"] + PRIVATE_REACH)
        return F.struct(
            n["seq"].alias("seq"), zone.rlike(java(union(fixed.PRIVATE_ROLES), True)).alias("private"),
            slice_of(text, n["start"] - 60, n["start"]).rlike(java(REPRESENTS, True)).alias("represents"),
        )

    flags = pages.select("doc_id", "page", "text").join(near, ["doc_id", "page"])
    flags = flags.select("doc_id", "page", F.explode(F.transform("names", told)).alias("told")).select("doc_id", "page", "told.*")
    return pairs, flags


def _take(rows: list[dict]) -> list[dict]:
    """Roles: pairs in order of score, each keyword and each name once."""
    words, names, kept = set(), set(), []
    for row in rows:
        if row["k_start"] not in words and row["seq"] not in names:
            words.add(row["k_start"])
            names.add(row["seq"])
            kept.append(row)
    return kept


def associated(pages: DataFrame, names: DataFrame, kinds: dict = KINDS) -> tuple[DataFrame, DataFrame]:
    """kind, word of each keyword at the name it belongs to: the nearest one, a keyword at one
    name only. Without exclusive names that is the first pair of each keyword; where a name
    too takes one keyword only (roles), pairs are taken in order, page by page."""
    pairs, flags = _pairs(pages, names, kinds)
    pairs = staged(pairs, "pairs")
    first = Window.partitionBy("doc_id", "page", "kind", "k_start").orderBy("score", "n_start", "seq")
    free = pairs.where("kind <> 'role'").withColumn("nth", F.row_number().over(first)).where("nth = 1")
    roles = folded(pairs.where("kind = 'role'"), ["doc_id", "page"], ["score", "k_start", "n_start", "seq"], _take)
    return free.drop("nth").unionByName(roles), flags


def classified(pages: DataFrame, findings: DataFrame, kinds: dict = KINDS) -> DataFrame:
    """Findings with names of category C1 qualified by their context: minor (B8), third party
    (B7), holder of a public role (P), contractor, payee above or below the threshold or with
    a health context (C2), in this order."""
    names = findings.where("category = 'C1' and start is not null")
    taken, flags = associated(pages, names, kinds)
    best = taken.groupBy("doc_id", "page", "seq").pivot("kind", list(KINDS)).agg(F.min(F.struct("score", "k_start", "word"))["word"])
    facts = flags.join(best, ["doc_id", "page", "seq"], "left")
    rows = findings.join(facts, ["doc_id", "page", "seq"], "left")
    said = {k: F.trim(F.col(k)) for k in KINDS}
    value = amount(F.regexp_extract("amount", r"(\d[\d.]*(?:,\d{1,2})?)", 1))
    has = {k: F.col(k).isNotNull() for k in KINDS}
    role = has["role"] & ~F.coalesce("private", F.lit(False))
    fee, paid = has["amount"] & has["fee"], has["amount"] & has["payee"]
    hired = has["contractor"] & ~F.coalesce("represents", F.lit(False))
    eligible = (F.col("category") == "C1") & F.col("start").isNotNull()
    below = value <= THRESHOLD

    def chosen(minor, third, holder, by_fee, payee, contractor, else_) -> Column:
        return (
            F.when(~eligible, else_).when(has["minor"], minor).when(has["third"], third).when(role, holder).when(fee, by_fee)
            .when(paid, payee).when(hired, contractor).otherwise(else_)
        )

    category = chosen(F.lit("B8"), F.lit("B7"), F.lit("P"), F.col("category"), F.lit("C2"), F.col("category"), F.col("category"))
    contractor = F.when(F.col("represents"), "C1").otherwise("C1_contractor")
    payee = F.when(has["health"], "C2_health").when(below, "C2_below").otherwise("C2_above")
    key = chosen(F.lit("B8"), F.lit("B7"), F.lit("P"), contractor, payee, F.lit("C1_contractor"), F.col("proposal_key"))
    worth = F.concat(F.lit("amount: "), value.cast("string"), F.when(has["health"], F.concat(F.lit("; health or hardship: "), said["health"])).otherwise(F.concat(F.lit("; context: "), said["payee"])))
    note = chosen(
        F.concat(F.lit("context: "), said["minor"]), F.concat(F.lit("context: "), said["third"]),
        F.concat(F.lit("role in the context: "), said["role"]), F.concat(F.lit("fee: "), said["fee"]), worth,
        F.concat(F.lit("context: "), said["contractor"]), F.col("note"),
    )
    health = F.when(eligible & has["health"], said["health"]).otherwise(F.col("health_context"))
    rows = rows.withColumns({"new": category, "proposal_key": key, "note": note, "health_context": health})
    changed = F.col("new") != F.col("category")
    band = band_of(F.col("new"))
    return rows.withColumns({
        "band": F.when(changed, band).otherwise(F.col("band")),
        "decision": F.when(changed, default_decision(band)).otherwise(F.col("decision")),
        "default_decision": F.when(changed, default_decision(band)).otherwise(F.col("default_decision")),
        "category": F.col("new"),
    }).select(*COLUMNS)
