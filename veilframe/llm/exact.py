"""Exact document fingerprints: equal canonical texts, and only those, share one.

Canonical form: NFKC, case folding, NFKC again, runs of white space as one blank, none at the
ends. Its fingerprint is the 128-bit xxhash (XXH3) in hex. Documents that share a digest are
compared byte by byte: a group-by on digest and canonical text, combined before the shuffle,
so that a thousand copies are one row for each task. Where one digest has several texts, all
but the first of them (in byte order) get "-1", "-2" ... after the digest.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilframe.llm.common import grown, stage, width

#: Repeated digests are broadcast to select their documents up to this number (16 bytes of
#: hash each), else joined by a shuffle.
BROADCAST_DIGESTS = 500_000
LAST = (1 << 63) - 1


def canonical(text: str | None) -> bytes:
    text = text or ""
    if text.isascii():
        return " ".join(text.lower().split()).encode()
    folded = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
    return " ".join(folded.split()).encode()


def digest(form: bytes) -> str:
    return xxhash.xxh3_128_hexdigest(form)


def _canonical_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        forms = [canonical(x.as_py()) for x in batch.column(0)]
        yield pa.RecordBatch.from_arrays(
            [pa.array([digest(f) for f in forms]), pa.array(forms, pa.binary())], ["digest", "form"]
        )


def collisions(docs: DataFrame, repeated: DataFrame, text: str = "text") -> DataFrame:
    """digest, sha256 (of the canonical form), place for each form of a digest that stands for
    several. repeated: the digests (distinct) of more than one row."""
    chosen = F.broadcast(repeated) if repeated.count() <= BROADCAST_DIGESTS else repeated
    forms = docs.select(text).mapInArrow(_canonical_rows, "digest string, form binary").join(chosen, "digest", "left_semi")
    each = forms.groupBy("digest", "form").count().select("digest", F.sha2("form", 256).alias("sha256"), "form")
    several = each.groupBy("digest").count().where("count > 1").select("digest")
    place = F.row_number().over(Window.partitionBy("digest").orderBy("form")) - 1
    return each.join(several, "digest").select("digest", "sha256", place.alias("place"))


def _named(df: DataFrame, clash: DataFrame, digest_col: str, sha_col: str, out: str) -> DataFrame:
    own = clash.select(F.col("digest").alias(digest_col), F.col("sha256").alias(sha_col), "place")
    suffix = F.when(F.col("place") > 0, F.concat(F.lit("-"), F.col("place").cast("string"))).otherwise("")
    return df.join(own, [digest_col, sha_col], "left").withColumn(out, F.concat(digest_col, suffix)).drop("place")


def fingerprints(docs: DataFrame, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """docs with their fingerprint. A null text is empty, an empty text has a fingerprint like
    any other. Other columns stay, but those named like out, _digest or _sha are dropped. An empty table gives an empty table."""
    docs = docs.drop(out, "_digest", "_sha")
    schema = grown(docs.schema, _digest="string", _sha="string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            forms = [canonical(x.as_py()) for x in batch.column(batch.schema.get_field_index(text))]
            made = [pa.array([digest(f) for f in forms]), pa.array([hashlib.sha256(f).hexdigest() for f in forms])]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], [*batch.schema.names, "_digest", "_sha"])

    made = docs.mapInArrow(run, schema)
    repeated = stage(made.groupBy(F.col("_digest").alias("digest")).count().where("count > 1").select("digest"), "digests")
    return _named(made, stage(collisions(docs, repeated, text), "clashes"), "_digest", "_sha", out).drop("_digest", "_sha")


def _dealt(bounds: np.ndarray, firsts: np.ndarray):
    """Rows (part, ahead, doc_id, text): each document in its range of ids; the first of a
    range (ties included) also ahead, at the end of the range before, as its last one's next."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).fill_null(LAST).to_numpy(zero_copy_only=False)
            part = np.searchsorted(bounds, ids, "right")
            found = np.searchsorted(firsts, ids)
            first = np.flatnonzero(firsts[np.minimum(found, len(firsts) - 1)] == ids) if len(firsts) else np.zeros(0, np.int64)
            if len(first):  # the parts in use are those of firsts
                parts = np.searchsorted(bounds, firsts, "right")
                again = batch.take(pa.array(first))
                before = parts[(found[first] - 1) % len(firsts)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(before), pa.array(np.ones(len(first), bool)), *again.columns], ["part", "ahead", "doc_id", "text"]
                )
            yield pa.RecordBatch.from_arrays(
                [pa.array(part), pa.array(np.zeros(len(ids), bool)), *batch.columns], ["part", "ahead", "doc_id", "text"]
            )

    return run


EDITED = (
    "doc_id long, n_chars long, digest string, sha string, edited_sha256 string, edited_digest string, "
    "edited_sha string, near_edited double, near_next double"
)


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """EDITED rows of partitions sorted by part, ahead, doc_id, text."""
    part = held = None  # held: doc_id, text, form
    out: list[tuple] = []

    def pair(doc_id, text, form, text2, form2):
        half = len(text) // 2
        edited = text[: len(text) - half] + text2[:half]
        other = canonical(edited)
        sha = hashlib.sha256
        return (
            doc_id, len(text), digest(form), sha(form).hexdigest(), sha(edited.encode()).hexdigest(), digest(other),
            sha(other).hexdigest(), float(form == other), float(form == form2),
        )

    def table():
        names = [c.split()[0] for c in EDITED.split(", ")]
        kinds = [pa.int64(), pa.int64(), *[pa.string()] * 5, pa.float64(), pa.float64()]
        columns = list(zip(*out, strict=True)) or [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    for batch in batches:
        for p, ahead, doc_id, text in zip(*(batch.column(i).to_pylist() for i in range(3)), batch.column(3), strict=True):
            if p != part:
                part = p
                held = None
            elif held is None:
                continue  # another row ahead, after the first
            text = text.as_py() or ""
            form = canonical(text)
            if held is not None:
                out.append(pair(*held, text, form))
            held = None if ahead else (doc_id, text, form)
        yield table()
        out = []


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, fingerprint, and what becomes of it when the last floor(n_chars / 2)
    characters are replaced by the first as many (or all) of the next document in the order
    of doc_id: edited_sha256, edited_fingerprint, near_edited; near_next compares with the
    next document itself. Likeness is 1 for equal fingerprints, else 0.

    After the last document comes the first (a single document is its own next). Equal ids
    are in the order of their texts, null ids come last. Documents are dealt once, by ranges
    of ids with a copy of each range's first document in the range before it; only the ranges'
    bounds reach the driver. An empty table gives an empty table."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ids = rows.select(F.coalesce("doc_id", F.lit(LAST)).alias("id"))
    parts = width(spark)
    cuts = ids.stat.approxQuantile("id", [i / parts for i in range(1, parts)], 0.2 / parts) if parts > 1 else []
    bounds = np.unique(np.array(cuts, np.float64).astype(np.int64))
    marks = F.array(*[F.lit(int(b)) for b in bounds]) if len(bounds) else F.array().cast("array<bigint>")
    part = F.size(F.filter(marks, lambda b: b <= F.col("id")))
    firsts = np.array(sorted(r[0] for r in ids.groupBy(part.alias("part")).agg(F.min("id")).select("min(id)").collect()), np.int64)
    dealt = rows.mapInArrow(_dealt(bounds, firsts), "part long, ahead boolean, doc_id long, text string")
    found = stage(
        dealt.repartition(parts, "part")
        .sortWithinPartitions("part", "ahead", F.col("doc_id").asc_nulls_last(), "text")
        .mapInArrow(_edited, EDITED),
        "edited",
    )
    repeated = stage(found.groupBy("digest").count().where("count > 1").select("digest"), "digests")
    clash = stage(collisions(rows, repeated), "clashes")
    return _named(_named(found, clash, "digest", "sha", "fingerprint"), clash, "edited_digest", "edited_sha", "edited_fingerprint").select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"
    )
