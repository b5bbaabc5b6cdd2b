"""Source divergence audit: how far the sources of a language are from each other, term by term.

Terms are counted where the texts are read and summed by language, source and term. For each pair
of sources a joint histogram tells how many terms have each combination of counts; terms that one
or both lack are worked out from the sources' own histograms, so no zero is ever a row. A distance
f of two shares is then evaluated once for each combination, times the terms that have it.

Defined results: null texts, languages and sources are ''; a language without kept terms has
distance 0 between all its sources and no terms; ties go by the item's bytes; repeated rows count
each; an empty table gives an empty table; other columns are ignored. Sums and quotients are
integers throughout. A text must fit into a task's memory, a few times its own size.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilframe.llm.common import map_batches, stage

#: Shares are parts of this many.
SCALE = 1_000_000_000
#: Words that a task holds, as numbers, before it hands on their sums.
HELD = 1 << 22

#: Bytes to terms: A-Z become a-z, all other ASCII characters but a-z separate.
_BYTES = bytes(b if b >= 0x80 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


def _summed(keys: np.ndarray, *values: np.ndarray) -> list[np.ndarray]:
    """The different keys, and the sums of the values of each."""
    order = np.argsort(keys)
    keys = keys[order]
    firsts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return [keys[firsts], *[np.add.reduceat(v[order], firsts) for v in values]]


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents by language, source and term, summed over HELD words or a text more."""
    groups: dict[tuple[str, str], int] = {}
    terms: dict[bytes, int] = defaultdict(count().__next__)
    of, words, held = [], [], 0

    def out() -> Iterator[pa.RecordBatch]:
        if not held:
            return
        doc, width = np.repeat(np.arange(len(of)), [len(w) for w in words]), len(terms)
        key, n = _summed(doc * width + np.concatenate(words), np.ones(held, np.int64))
        key, n, docs = _summed(np.array(of)[key // width] * width + key % width, n, np.ones(len(key), np.int64))
        names = [pa.array([g[i] for g in groups], pa.string()) for i in (0, 1)]
        term = pa.array(list(terms), pa.binary()).cast(pa.string())
        for at in range(0, len(key), 100_000):
            some = slice(at, at + 100_000)
            group = pa.array(key[some] // width)
            columns = [names[0].take(group), names[1].take(group), term.take(pa.array(key[some] % width)), pa.array(n[some]), pa.array(docs[some])]
            yield pa.RecordBatch.from_arrays(columns, ["lang", "source", "term", "n", "docs"])

    for batch in batches:
        for lang, source, text in zip(batch["lang"].to_pylist(), batch["source"].to_pylist(), batch["text"].cast(pa.binary()), strict=True):
            some = np.array(list(map(terms.__getitem__, text.as_py().translate(_BYTES).split())), np.int32)
            of.append(groups.setdefault((lang, source), len(groups)))
            words.append(some)
            held += len(some)
            if held >= HELD:
                yield from out()
                groups, terms, of, words, held = {}, defaultdict(count().__next__), [], [], 0
    yield from out()


def counts(docs: DataFrame, min_docs: int) -> DataFrame:
    """lang, source, term, n, lang_n for the terms in min_docs or more documents of the language."""
    read = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")])
    tallied = map_batches(read, _tally, "lang string, source string, term string, n long, docs long")
    # one shuffle: what has one language and term stays together for the sums by source and over all
    summed = tallied.repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    term = Window.partitionBy("lang", "term")
    kept = summed.withColumn("lang_n", F.sum("n").over(term)).withColumn("lang_docs", F.sum("docs").over(term))
    return stage(kept.where(F.col("lang_docs") >= min_docs).select("lang", "source", "term", "n", "lang_n"), "divergence")


def share(n: Column, total: Column, kept: Column, smoothing: int) -> Column:
    """1 + floor(SCALE * (n + smoothing) / (total + smoothing * kept)), exactly."""
    top = F.lit(SCALE).cast("decimal(10,0)") * (n + smoothing).cast("decimal(20,0)")
    return F.lit(1).cast("long") + F.call_function("div", top, (total + smoothing * kept).cast("decimal(20,0)"))


def distance(p: Column, q: Column) -> Column:
    return F.abs(p - q)


def _totals(kept: DataFrame, docs: DataFrame) -> DataFrame:
    """lang, source, total, lang_total, v for each group that occurs."""
    groups = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    by_group = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    # each kept term once: v and the language's total
    terms = kept.groupBy("lang", "term").agg(F.first("lang_n").alias("lang_n")).groupBy("lang").agg(F.count("*").alias("v"), F.sum("lang_n").alias("lang_total"))
    none = F.lit(0).cast("long")
    return groups.join(by_group, ["lang", "source"], "left").join(terms, "lang", "left").select(
        "lang", "source", *[F.coalesce(c, none).alias(c) for c in ("total", "lang_total", "v")]
    )


def histograms(kept: DataFrame, totals: DataFrame) -> DataFrame:
    """lang, a, b, na, nb, terms for sources a < b: how many kept terms occur na times in a and nb
    times in b, zeros included; with totals ta, tb and v of the pair."""
    left = totals.select("lang", F.col("source").alias("a"), F.col("total").alias("ta"), "v")
    pairs = left.join(totals.select("lang", F.col("source").alias("b"), F.col("total").alias("tb")), "lang").where("a < b")
    mine = kept.select("lang", "term", F.col("source").alias("a"), F.col("n").alias("na"))
    other = kept.select("lang", "term", F.col("source").alias("b"), F.col("n").alias("nb"))
    joint = mine.join(other, ["lang", "term"]).where("a < b").groupBy("lang", "a", "b", "na", "nb").agg(F.count("*").alias("terms"))
    joint = stage(joint, "joint")
    own = kept.groupBy("lang", F.col("source").alias("s"), "n").agg(F.count("*").alias("terms"))
    zero = F.lit(0).cast("long")
    cell = lambda df, na, nb, terms: df.select("lang", "a", "b", na.alias("na"), nb.alias("nb"), terms.alias("terms"))
    na, nb, m = F.col("na"), F.col("nb"), F.col("terms")
    of_a = own.withColumnRenamed("s", "a").join(pairs.select("lang", "a", "b"), ["lang", "a"])
    of_b = own.withColumnRenamed("s", "b").join(pairs.select("lang", "a", "b"), ["lang", "b"])
    cells = (
        cell(joint, na, nb, m)
        # in a and not in b: all of a's terms less the joint ones; likewise b's
        .unionAll(cell(of_a, F.col("n"), zero, m)).unionAll(cell(joint, na, zero, -m))
        .unionAll(cell(of_b, zero, F.col("n"), m)).unionAll(cell(joint, zero, nb, -m))
        # in neither: all kept terms less a's and b's, which count the joint ones twice
        .unionAll(cell(pairs, zero, zero, F.col("v")))
        .unionAll(cell(of_a, zero, zero, -m)).unionAll(cell(of_b, zero, zero, -m)).unionAll(cell(joint, zero, zero, m))
    )
    summed = cells.groupBy("lang", "a", "b", "na", "nb").agg(F.sum("terms").alias("terms")).where("terms > 0")
    return summed.join(pairs, ["lang", "a", "b"])


def audit(docs: DataFrame, min_docs: int = 30, smoothing: int = 5, top: int = 50, f: Callable[[Column, Column], Column] = distance) -> DataFrame:
    """lang, source, part, item, value, rank: for each group all other sources of its language by
    f summed over the kept terms (part pair; f is to be symmetric), and the top terms that the
    group has more of than its language (part term)."""
    kept = counts(docs, min_docs)
    totals = stage(_totals(kept, docs), "totals")
    n = lambda c: F.col(c)
    once = f(share(n("na"), n("ta"), n("v"), smoothing), share(n("nb"), n("tb"), n("v"), smoothing))
    # a language without kept terms has no combination, and its shares no denominator
    far = histograms(kept, totals).groupBy("lang", "a", "b").agg(F.sum(once * F.col("terms")).alias("value"))
    all_pairs = totals.select("lang", F.col("source").alias("a")).join(totals.select("lang", F.col("source").alias("b")), "lang").where("a < b")
    told = stage(all_pairs.join(far, ["lang", "a", "b"], "left").select("lang", "a", "b", F.coalesce("value", F.lit(0).cast("long")).alias("value")), "far")
    pairs = told.select("lang", F.col("a").alias("source"), F.col("b").alias("item"), "value").unionAll(
        told.select("lang", F.col("b").alias("source"), F.col("a").alias("item"), "value")
    )
    more = kept.join(totals, ["lang", "source"])
    p, q = share(n("n"), n("total"), n("v"), smoothing), share(n("lang_n"), n("lang_total"), n("v"), smoothing)
    terms = more.select("lang", "source", F.col("term").alias("item"), p.alias("p"), q.alias("q")).where("p > q")
    terms = terms.select("lang", "source", "item", f(F.col("p"), F.col("q")).alias("value"))
    order = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    ranked = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", order.alias("rank"))
    return ranked(pairs, "pair").unionAll(ranked(terms, "term").where(F.col("rank") <= top))
