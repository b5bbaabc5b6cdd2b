"""Mixing sources to target weights by entropy balancing.

Sources weigh 5, 2, 1, repeating in their order (code points, null last), and share all
words; a target stops at `cap` times its source's size and the excess is shared again by
weight. The rates r of documents are those nearest to 1 in relative entropy, each word
counting alike, that meet two kinds of constraints: the words of every source come to its target,
and the words' mean log length of document stays what it was over all sources (so that long
documents keep their part of the mix). No rate is over cap:

    min  sum size * (r ln r - r + 1)    s. t.  sum_s size * r = target_s,  sum size * x * r = M,  r <= cap

with x the log of a document's size (shifted and scaled). The dual has a multiplier t for each
source and one, lam, for the length (with a small ridge, as it may be infeasible beside the
cap); r = min(exp(t + lam * x), cap) is a document's exponential tilt. Each Newton iteration
sums gradient and Hessian over all documents, source by source (from counts by source and size). The Hessian is an arrow: the
sources' part is diagonal, so lam's step is one quotient of sums over the sources, which is all
that reaches the driver, and each source's step follows in the table of sources. Sums are
of whole numbers (words times 2^16), so that they don't depend on the order of rows. Sources
whose target is at the cap have rate cap throughout. A document with more words than its whole
source's target has rate 0, if the source's other documents can make up the target.

Rounding: a document is taken floor(r) or floor(r) + 1 times. In each source, from its largest
to its smallest document, with F the sum of the fractions of r up to it (in 2^-20), a document gets
one more if floor(F + u) > floor(F - f + u). Neighbours are of like size, so the words taken stay
near the target. Of PHASES values of u each source gets the one that ends nearest, and one
document of each source makes up most of what is left. Everything is a function of the rows, so
reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilframe.llm.common import dense_index, stage

WEIGHTS, CAP = (5, 2, 1), 3
PHASES, STEPS = 16, 25
#: Fractions are whole numbers of 1 / ONE, words of 1 / GRAIN.
ONE, GRAIN = 1 << 20, 1 << 16
#: Weight of lam's ridge as a share of all words; residuals and steps below CLOSE end the iterations.
RIDGE, CLOSE = 1e-3, 1e-7
WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """source, source_size, target of the sources (source, source_size)."""
    ranked = dense_index(sizes, [F.col("source").asc_nulls_last()], "sources")
    weigh = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("idx") % len(weights) + 1).cast("int"))
    ranked = stage(ranked.select("source", "source_size", weigh.alias("weight"), (F.col("source_size") * cap).alias("most")), "sources")
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    level = 0.0  # words for each unit of weight; it only rises, as more sources are full
    while True:
        full = F.col("most") <= F.col("weight") * F.lit(level)
        held, left = ranked.agg(F.sum(F.when(full, F.col("most"))), F.sum(F.when(~full, F.col("weight")))).first()
        new = (total - (held or 0)) / left if left else level
        if new <= level:
            break
        level = new
    return ranked.select("source", "source_size", F.least(F.col("most").cast("double"), F.col("weight") * F.lit(level)).alias("target"))


def _length(size: Column) -> Column:
    return (F.ln(size + F.lit(1.0)) - F.lit(5.0)) / F.lit(2.0)


def _rate(size: Column, t: Column, lam: Column, cap: int) -> Column:
    return F.least(F.exp(t + lam * _length(size)), F.lit(float(cap)))


def _grains(x: Column) -> Column:
    """The sum over documents, which stand together by size, n of each."""
    return F.sum(F.round(x * F.lit(float(GRAIN))).cast("long") * F.col("n"))


def usable(rows: DataFrame, aims: DataFrame, cap: int = CAP) -> DataFrame:
    """aims with most, the size of the largest document that is taken (null: any), and usable,
    the words of those that are not larger."""
    small = rows.join(aims, F.col("own").eqNullSafe(F.col("source"))).where("size <= target").groupBy("source").agg(F.sum("size").alias("small"))
    small = small.withColumnRenamed("source", "_of")
    rows = aims.join(small, F.col("source").eqNullSafe(F.col("_of")), "left")
    enough = F.coalesce(F.col("small") * cap >= F.col("target"), F.lit(False))
    return rows.select(
        "source", "source_size", "target", F.when(enough, F.col("target")).alias("most"),
        F.when(enough, F.col("small")).otherwise(F.col("source_size")).alias("usable"),
    )


def balanced(rows: DataFrame, aims: DataFrame, cap: int = CAP) -> tuple[DataFrame, float]:
    """source, t of the sources below their cap, and lam: the dual's maximum. rows: own, size;
    aims: as of usable(). Documents of one source and size have one rate, so they are counted
    once and the iterations go over the counts."""
    rows = stage(rows.groupBy("own", "size").agg(F.count("*").alias("n")), "sizes")
    size, x = F.col("size"), _length(F.col("size"))
    open_ = (F.col("target") > 0) & (F.col("target") < F.col("usable") * F.lit(cap - 1e-9))
    tilts = stage(aims.where(open_).select("source", "target", "usable", "most", F.round(F.ln(F.col("target") / F.col("usable")), 12).alias("t")), "tilts")
    whole = tilts.agg(F.sum("usable"), F.sum(F.round(F.col("target") * 16).cast("long"))).first()
    lam, ridge, share = 0.0, RIDGE * float(whole[0] or 0), (whole[1] or 0) / 16 / (whole[0] or 1)
    for _ in range(STEPS if whole[0] else 0):
        r = _rate(size, F.col("t"), F.lit(lam), cap)
        words, free = size * r, r < cap
        met = rows.where("size > 0").join(tilts, F.col("own").eqNullSafe(F.col("source"))).where("most is null or size <= most")
        sums = met.groupBy("source").agg(
            F.first("target").alias("target"), F.first("usable").alias("usable"), F.first("most").alias("most"), F.first("t").alias("t"),
            _grains(words).alias("all"), _grains(F.when(free, words).otherwise(0.0)).alias("a"), _grains(F.when(free, words * x).otherwise(0.0)).alias("b"),
            _grains(F.when(free, words * x * x).otherwise(0.0)).alias("c"), _grains(words * x).alias("m"), _grains(size * x).alias("m0"),
        )
        sums = stage(sums.withColumn("g", F.col("target") * F.lit(float(GRAIN)) - F.col("all")), "sums")
        g, a, b = F.col("g"), F.col("a").cast("double"), F.col("b").cast("double")

        def total(x: Column) -> Column:
            return F.coalesce(F.sum(F.round(x).cast("decimal(38,0)")), F.lit(0)).cast("double")

        m, m0, c, bg, bb, off = sums.agg(
            total(F.col("m")), total(F.col("m0")), total(F.col("c")), total(F.try_divide(b * g, a)), total(F.try_divide(b * b, a)),
            F.max(F.abs(g) / (F.col("target") * F.lit(float(GRAIN)))),
        ).first()
        up, down = (m0 * share - m) / GRAIN - ridge * lam - bg / GRAIN, (c - bb) / GRAIN + ridge
        step = max(-0.5, min(0.5, up / down)) if down > 0 else 0.0
        own = F.coalesce(F.try_divide(g - b * F.lit(step), a), F.lit(0.0))
        if off < CLOSE and abs(step) < CLOSE:
            break
        lam = round(lam + step, 12)
        own = F.greatest(F.least(own, F.lit(1.0)), F.lit(-1.0))
        tilts = sums.select("source", "target", "usable", "most", F.round(F.col("t") + own, 12).alias("t"))
    return tilts.select("source", "t"), lam


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", size: str | None = None) -> DataFrame:
    """docs with size, source_size, target and copies (0 to 3: how often the mix takes the row).

    size: a column with the number of words, if it is known. Null texts have size 0 and are
    taken like any other of their source; null is a source of its own; repeated rows each
    count. Sources without words have target 0 and are not taken. Columns of docs with the
    four names above are replaced. Two rows of one id and size that differ elsewhere are told apart
    by a hash of the row (maps aside), so the order of the input changes nothing. An empty table
    gives an empty table."""
    sized = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.col(source).alias("own"),
        (F.coalesce(F.col(size), F.lit(0)).cast("long") if size else words(F.col(text))).alias("size"),
        F.coalesce(F.col(key).cast("string"), F.lit("")).alias("key"),
    )
    # two rows of one id and size: whatever else they hold tells which is first, not their place in the input
    told = [f.name for f in docs.schema.fields if not any(k in f.dataType.simpleString() for k in ("map<", "variant"))]
    sized = sized.withColumn("mark", F.xxhash64(*[F.col(f"row.`{c}`") for c in told]))
    order = [F.col("size").desc(), F.md5("key"), F.col("key"), F.col("mark")]
    rows = stage(sized.repartitionByRange(F.col("own").asc_nulls_last(), *order).withColumn("_range", F.spark_partition_id()), "mixed")
    aims = stage(targets(rows.groupBy(F.col("own").alias("source")).agg(F.sum("size").alias("source_size"))), "targets")
    aims = stage(usable(rows.select("own", "size"), aims), "usable")
    tilts, lam = balanced(rows.select("own", "size"), aims)
    aims = aims.join(tilts.withColumnRenamed("source", "_tilted"), F.col("source").eqNullSafe(F.col("_tilted")), "left").drop("_tilted")
    aims = stage(aims, "aims")
    found = F.when((F.col("target") <= 0) | (F.col("size") > F.col("most")), 0.0).when(F.col("t").isNull(), float(CAP)).otherwise(_rate(F.col("size"), F.col("t"), F.lit(lam), CAP))
    snapped = F.when(F.abs(found - F.round(found)) < 1e-9, F.round(found)).otherwise(found)

    def rated(table: DataFrame, by: DataFrame) -> DataFrame:
        """table with source's columns, whole and part of the rate, and cum, the parts up to a
        row in its range; nth numbers the rows of a source in a range."""
        met = table.join(by, F.col("own").eqNullSafe(F.col("source"))).withColumn("rate", snapped)
        met = met.withColumns({"whole": F.floor("rate"), "part": F.round((F.col("rate") - F.floor("rate")) * ONE).cast("long")})
        inside = Window.partitionBy("source", "_range").orderBy(*order)
        return met.withColumns({"cum": F.sum("part").over(inside.rowsBetween(Window.unboundedPreceding, 0)), "nth": F.row_number().over(inside)})

    narrow = rated(rows.select("own", "size", "key", "mark", "_range"), aims).select("source", "_range", "nth", "size", "target", "whole", "part", "cum")
    narrow = stage(narrow, "rates")
    before = Window.partitionBy("source").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = narrow.groupBy("source", "_range").agg(F.sum("part").alias("sum")).withColumn("start", F.coalesce(F.sum("sum").over(before), F.lit(0)))
    starts = stage(starts.select(F.col("source").alias("of"), F.col("_range").alias("range"), "start"), "starts")

    def started(table: DataFrame) -> DataFrame:
        met = (F.col("_range") == F.col("range")) & F.col("source").eqNullSafe(F.col("of"))
        return table.join(starts, met).withColumn("cum", F.col("cum") + F.col("start")).drop("of", "range", "start")

    def extra(u: Column) -> Column:
        return (F.floor((F.col("cum") + u) / ONE) - F.floor((F.col("cum") - F.col("part") + u) / ONE)).cast("int")

    phases = [int(ONE * ((j + 0.5) / PHASES + 0.0137)) for j in range(PHASES)]
    narrow = started(narrow)
    off = narrow.groupBy("source").agg(
        *[(F.first("target") - F.sum(F.col("size") * (F.col("whole") + extra(F.lit(u))))).alias(f"p{j}") for j, u in enumerate(phases)]
    )
    ends = [F.struct(F.abs(F.col(f"p{j}")).alias("off"), F.lit(u).alias("u"), F.col(f"p{j}").alias("left")) for j, u in enumerate(phases)]
    chosen = stage(off.select(F.col("source").alias("of"), F.array_min(F.array(*ends)).alias("best")).select("of", "best.u", "best.left"), "phases")
    # what is then left is made up by one document: the one whose extra copy, taken or given
    # back, brings the source nearest to its target
    placed = narrow.join(chosen, F.col("source").eqNullSafe(F.col("of"))).withColumn("copies", F.col("whole") + extra(F.col("u")))
    step = F.when(F.col("copies") > F.col("whole"), -1).otherwise(F.when(F.col("copies") < CAP, 1).otherwise(0))
    nearest = placed.withColumn("step", step).withColumn("then", F.abs(F.col("left") - F.col("step") * F.col("size")))
    nearest = nearest.where(F.col("then") < F.abs(F.col("left"))).groupBy("source").agg(F.min(F.struct("then", "_range", "nth", "step")).alias("one"))
    last = chosen.join(nearest, F.col("of").eqNullSafe(F.col("source")), "left").select("of", "u", "one")
    aims = aims.join(last, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    done = started(rated(rows, stage(aims, "chosen")))
    fixed = F.when((F.col("one._range") == F.col("_range")) & (F.col("one.nth") == F.col("nth")), F.col("one.step")).otherwise(0)
    made = ("size", "source_size", "target", "copies")
    return done.select(
        *[F.col(f"row.`{c}`").alias(c) for c in docs.columns if c not in made], "size", "source_size", "target",
        (F.col("whole") + extra(F.col("u")) + F.coalesce(fixed, F.lit(0))).cast("int").alias("copies"),
    )
