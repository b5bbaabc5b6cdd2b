"""SimHash near-duplicates by anchor-point covering.

Fingerprints. A text is lower-cased (A-Z) and cut into words; every run of three words
(fewer words: all of them), joined by spaces, is hashed by XXH64 with seed 42. A bit of the
fingerprint is 1 if it is set in over half of the hashes. Null and empty texts and texts
without words have fingerprint 0 and link like any other.

Links. The anchors are the words of a covering code over the first 46 bits: a pair of binary
Golay words of 23 bits. That code is perfect, so every fingerprint has exactly one anchor at
most 3 bits away in each half, its home. If x and y differ in t or fewer bits, y is at most
3 + t1 and 3 + t2 bits from the home of x, with t1 + t2 <= t. So y is replicated to every
anchor within those radii (61 on average for t = 2, about one in four million of all), x is
sent home, and homes are compared with replicas anchor by anchor on all 64 bits. Nothing is
missed: the covering is exact.

Scale. Equal fingerprints are one node, whatever their number. An anchor's rows are cut into
cells of bounded size (blocks of homes times blocks of replicas, homes among them, from counts
of the crowded anchors), so that one crowded anchor is many tasks and no task holds more than
two blocks of it. A cell yields a spanning forest of its links, never all pairs, and components are
found by alternating stars.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.llm.common import grown, map_batches, stage, width
from veilframe.llm.graph import components, spanning_forest

#: Words hashed at a time in a long text.
BLOCK = 1 << 16
#: Rows of one side in a cell, so that a cell has at most CELL * CELL comparisons.
CELL = 2048
#: Links of a cell that are held before they are reduced to a forest.
PRUNE = 200_000
#: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1, a generator of the binary Golay code of length 23.
GOLAY, N, CHECK, RADIUS = 0b101011100011, 23, 11, 3


def _hashed(text: str | None, shingle: int) -> Iterator[np.ndarray]:
    """Hashes of the text's runs of `shingle` words, block by block."""
    import xxhash

    words = (text or "").encode().lower().split()  # bytes: A-Z and the six ASCII blanks only
    if not words:
        return
    size, digest = min(shingle, len(words)), xxhash.xxh64_intdigest
    for at in range(0, len(words) - size + 1, BLOCK):
        block = words[at : at + BLOCK + size - 1]
        ends = np.cumsum(np.fromiter(map(len, block), np.int64, len(block)) + 1)
        starts = np.concatenate(([0], ends[: len(block) - size]))
        joined = b" ".join(block)
        pieces = [joined[a:b] for a, b in zip(starts.tolist(), (ends[size - 1 :] - 1).tolist(), strict=True)]
        yield np.fromiter(map(digest, pieces, repeat(42)), np.uint64, len(pieces))


def _majority(blocks: Iterable[np.ndarray]) -> int:
    counts, total = np.zeros(64, np.int64), 0
    for hashes in blocks:
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
        total += len(hashes)
    return int(np.packbits(2 * counts > total, bitorder="little").view(np.uint64)[0])


def fingerprint(text: str | None, shingle: int = 3) -> int:
    return _majority(_hashed(text, shingle))


def fingerprints(docs: DataFrame, text: str = "text", shingle: int = 3, out: str = "fp") -> DataFrame:
    """docs without the text, with its fingerprint as a long (the unsigned bits); a column
    named like out is replaced."""
    docs = docs.drop(out)
    schema = grown(docs.drop(text).schema, **{out: "long"})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text)
            made = np.array([fingerprint(x.as_py(), shingle) for x in batch.column(at)], np.uint64).view(np.int64)
            kept = [i for i in range(batch.num_columns) if i != at]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in kept), pa.array(made)], [*(batch.schema.names[i] for i in kept), out]
            )

    return map_batches(docs, run, schema)


def _mod(x: int) -> int:
    for bit in range(N - 1, CHECK - 1, -1):
        if x >> bit & 1:
            x ^= GOLAY << (bit - CHECK)
    return x


@lru_cache(maxsize=4)
def _code(reach: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of the low and high bits, and by syndrome the ways to a code word: errors of
    weight RADIUS + t at errors[first[s, t] : first[s, t + 1]] (t = 0: RADIUS or less)."""
    low = np.array([_mod(x) for x in range(1 << 12)], np.int64)
    high = np.array([_mod(x << 12) for x in range(1 << (N - 12))], np.int64)
    found: list[list[list[int]]] = [[[] for _ in range(reach + 1)] for _ in range(1 << CHECK)]
    for weight in range(RADIUS + reach + 1):
        for places in combinations(range(N), weight):
            e = sum(1 << p for p in places)
            found[low[e & 4095] ^ high[e >> 12]][max(0, weight - RADIUS)].append(e)
    first = np.zeros((1 << CHECK, reach + 2), np.int64)
    counts = np.array([[len(x) for x in s] for s in found])
    ends = np.cumsum(counts.ravel()).reshape(counts.shape)
    first[:, 1:], first[:, 0] = ends, ends[:, 0] - counts[:, 0]
    return low, high, first, np.array([e for s in found for x in s for e in x], np.int64)


def anchors(fp: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, anchor, home) of all anchors at which each fingerprint belongs."""
    low, high, first, errors = _code(reach)
    halves = [(fp >> np.uint64(shift)).astype(np.int64) & ((1 << N) - 1) for shift in (0, N)]
    syndromes = [low[x & 4095] ^ high[x >> 12] for x in halves]
    rows, found, home = [], [], []
    for t1 in range(reach + 1):
        for t2 in range(reach + 1 - t1):
            (a, n1), (b, n2) = ((first[s, t], first[s, t + 1] - first[s, t]) for s, t in zip(syndromes, (t1, t2), strict=True))
            each = n1 * n2
            row = np.repeat(np.arange(len(fp)), each)
            k = np.arange(len(row)) - np.repeat(np.cumsum(each) - each, each)
            one = halves[0][row] ^ errors[a[row] + k // n2[row]]
            two = halves[1][row] ^ errors[b[row] + k % n2[row]]
            rows.append(row)
            found.append(one | two << N)
            home.append(np.full(len(row), t1 == t2 == 0))
    return np.concatenate(rows), np.concatenate(found), np.concatenate(home)


def _replicas(nodes: DataFrame, reach: int) -> DataFrame:
    """anchor, home, fp, node of each distinct fingerprint (fp, node), at all its anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False)
            node = batch.column(1).to_numpy(zero_copy_only=False)
            for at in range(0, len(fp), 4096):
                part = fp[at : at + 4096]
                row, anchor, home = anchors(part.view(np.uint64), reach)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchor), pa.array(home), pa.array(part[row]), pa.array(node[at : at + 4096][row])],
                    ["anchor", "home", "fp", "node"],
                )

    return map_batches(nodes, run, "anchor long, home boolean, fp long, node long")


def _compare(threshold: int):
    """Links inside each cell of a partition that is sorted by anchor, cell."""

    def links(anchor, cell, home, fp, node) -> tuple[list[int], list[int]]:
        fp = fp.view(np.uint64)  # bits of a negative number would be counted in its absolute value
        cut = np.flatnonzero((anchor[1:] != anchor[:-1]) | (cell[1:] != cell[:-1])) + 1
        firsts, ends = np.concatenate(([0], cut)), np.concatenate((cut, [len(anchor)]))
        at = np.cumsum(np.concatenate(([0], home)))
        homes = at[ends] - at[firsts]  # homes stand first in a cell
        a, b = [], []
        some = (homes > 0) & (ends - firsts > 1)
        for s, e, h in zip(firsts[some].tolist(), ends[some].tolist(), homes[some].tolist(), strict=True):
            own, others, x, y = fp[s : s + h], fp[s:e], [], []
            for i in range(0, h, 64):
                near = np.bitwise_count(own[i : i + 64, None] ^ others[None, :]) <= threshold
                p, q = np.nonzero(near)
                p += i
                keep = own[p] != others[q]
                x += node[s + p[keep]].tolist()
                y += node[s + q[keep]].tolist()
                if len(x) > PRUNE:
                    x, y = spanning_forest(x, y)
            x, y = spanning_forest(x, y)
            a += x
            b += y
        return a, b

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        for batch in batches:
            cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if held is not None:
                cols = [np.concatenate(x) for x in zip(held, cols, strict=True)]
            new = np.flatnonzero((cols[0] != cols[0][-1]) | (cols[1] != cols[1][-1]))
            cut = int(new[-1]) + 1 if len(new) else 0  # the last cell may go on in the next batch
            held = [c[cut:] for c in cols]
            if cut:
                a, b = links(*(c[:cut] for c in cols))
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
        if held is not None and len(held[0]):
            a, b = links(*held)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def linked(nodes: DataFrame, threshold: int = 2) -> DataFrame:
    """Links (a, b) that connect all nodes (fp, node; fingerprints distinct) whose
    fingerprints differ in threshold or fewer bits: a spanning forest of each cell."""
    spark = nodes.sparkSession
    placed = _replicas(nodes.repartition(width(spark), "fp"), threshold)  # even tasks, however few the files
    crowded = stage(
        placed.groupBy("anchor")
        .agg(F.count("*").alias("n"), F.sum(F.col("home").cast("long")).alias("h"))
        .where((F.col("n") > CELL) & (F.col("h") > 0))
        .select("anchor", F.ceil(F.col("h") / CELL).alias("hb"), F.ceil(F.col("n") / CELL).alias("nb")),
        "crowded",
    )
    cells = (
        placed.join(crowded, "anchor", "left")
        .withColumn("hb", F.coalesce("hb", F.lit(1)))
        .withColumn("nb", F.coalesce("nb", F.lit(1)))
        # homes in different blocks meet as home and replica, so each is both where there are several
        .withColumn("home", F.explode(F.when(F.col("home") & (F.col("hb") > 1), F.array(F.lit(True), F.lit(False))).otherwise(F.array("home"))))
        .withColumn("own", F.pmod(F.xxhash64("fp"), F.when(F.col("home"), F.col("hb")).otherwise(F.col("nb"))))
        .withColumn(  # a home meets each block of replicas, a replica each block of homes
            "other", F.explode(F.sequence(F.lit(0), F.when(F.col("home"), F.col("nb")).otherwise(F.col("hb")).cast("int") - 1))
        )
        .withColumn(
            "cell",
            F.when(F.col("home"), F.col("own") * F.col("nb") + F.col("other")).otherwise(
                F.col("other") * F.col("nb") + F.col("own")
            ),
        )
        .select("anchor", "cell", "home", "fp", "node")
    )
    sorted_cells = cells.repartition(width(spark), "anchor", "cell").sortWithinPartitions("anchor", "cell", F.desc("home"))
    return map_batches(sorted_cells, _compare(threshold), "a long, b long")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 3, threshold: int = 2) -> DataFrame:
    """key, fp and component of every row: the smallest key whose fingerprint is reached by
    links between fingerprints that differ in threshold or fewer bits.

    Repeated rows share fingerprint and component. A row without a key has the component of
    its fingerprint if a row with a key shares it, else null, and links nothing. Other columns
    are not read, so their names are free. An empty table gives an empty table."""
    prints = stage(fingerprints(docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")), "text", shingle), "fp")
    nodes = stage(prints.groupBy("fp").agg(F.min("key").alias("key")).withColumn("node", F.coalesce("key", F.lit((1 << 63) - 1))), "nodes")
    keyed = nodes.where("key is not null")
    parts = components(linked(keyed.select("fp", "node"), threshold), "simhash-stars")
    known = keyed.join(parts, "node", "left").select("fp", F.coalesce("component", "node").alias("component"))
    return prints.join(known, "fp", "left").select(F.col("key").alias(key), "fp", "component")
