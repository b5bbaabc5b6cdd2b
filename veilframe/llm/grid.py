"""Embedding near-duplicates by an epsilon grid order join.

Vectors are scaled to length 1; a cosine of c is a distance of sqrt(2 - 2c) = eps. They are
turned into their principal axes (an orthogonal map from the covariance, which keeps
distances), put into grid cells of side eps on the LEADING axes, and sorted by cell, axis by
axis: the epsilon grid order. The sorted sequence is cut into intervals of BLOCK vectors with
the bounds of each on all leading axes. Two intervals whose boxes are further apart than eps
are skipped. Every pair of intervals is put to that test in a product of the intervals' files
with themselves, which reads a partition of either side in each task: no interval is copied
into a shuffle for each other one that it may be near, so disk grows with the vectors and not
with the pairs. Inside a pair of intervals the join goes on recursively: halves are bounded
again, distant halves skipped, and what is left at LEAF vectors is compared by a matrix product
in double precision.

Equal vectors are one node with a count. A task yields the number of links of each of its
vectors and a spanning forest of the links, so a dense cluster costs work but not rows. Where the leading axes tell nothing apart (vectors spread evenly over many dimensions,
all within eps on each axis) no block can be skipped and the join is a blocked comparison of
all vectors, spread over all tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.llm.common import dense_index, map_batches, stage
from veilframe.llm.graph import components, spanning_forest

LEADING, BLOCK, LEAF = 6, 2048, 256
#: Cosines this near the threshold are computed again, plainly.
NEAR = 1e-9


def _usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    v = F.transform(F.col(vector), lambda x: x.cast("double"))
    fine = F.size(F.filter(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))) == 0
    return vectors.select(F.col(key).cast("long").alias("key"), v.alias("v")).where(fine & F.exists("v", lambda x: x != 0))


def _unit(vectors: np.ndarray) -> np.ndarray:
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)  # squares neither overflow nor vanish
    return vectors / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))


def _matrices(batch: pa.RecordBatch, column: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, vectors) of a list column, by dimension."""
    lists = batch.column(column)
    sizes = np.asarray(lists.value_lengths().fill_null(0))
    for d in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == d)
        if d:
            yield rows, lists.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)


def _axes(nodes: DataFrame) -> dict[int, np.ndarray]:
    """For each dimension its leading principal axes, from sums over all vectors."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for _, m in _matrices(batch, 0):
                m = np.hstack([_unit(m), np.ones((len(m), 1))])
                total[m.shape[1] - 1] = total.get(m.shape[1] - 1, 0) + m.T @ m
        for d, t in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([d]), pa.array([t.tobytes()], pa.binary())], ["d", "sums"])

    def add(group: pa.Table) -> pa.Table:
        total = np.sum([np.frombuffer(x.as_py()) for x in group.column("sums")], axis=0)
        return pa.table({"d": group.column("d")[:1], "sums": pa.array([total.tobytes()], pa.binary())})

    axes = {}
    for r in nodes.select("v").mapInArrow(sums, "d long, sums binary").groupBy("d").applyInArrow(add, "d long, sums binary").collect():
        d, m = r["d"], np.frombuffer(r["sums"]).reshape(r["d"] + 1, -1)
        mean = m[:d, d] / m[d, d]
        _, vectors = np.linalg.eigh(m[:d, :d] / m[d, d] - np.outer(mean, mean))
        axes[d] = vectors[:, ::-1][:, :LEADING]
    return axes


def _celled(nodes: DataFrame, eps: float, axes: dict[int, np.ndarray]) -> DataFrame:
    """nodes with d, their grid cells c0, c1 ... and their places p (leading coordinates)."""
    cells = [f"c{i}" for i in range(LEADING)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.zeros((batch.num_rows, LEADING))
            dims = np.zeros(batch.num_rows, np.int64)
            for rows, m in _matrices(batch, 1):
                found = _unit(m) @ axes[m.shape[1]]
                at[rows, : found.shape[1]] = found
                dims[rows] = m.shape[1]
            grid = np.floor(at / eps).astype(np.int64)
            places = pa.array([x.tobytes() for x in at], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(dims), *(pa.array(grid[:, i]) for i in range(LEADING)), places],
                [*batch.schema.names, "d", *cells, "p"],
            )

    return nodes.mapInArrow(run, f"node long, v array<double>, n long, d long, {', '.join(c + ' long' for c in cells)}, p binary")


def _block(group: pa.Table) -> pa.Table:
    """One interval of the sequence: bounds, and its vectors in order."""
    group = group.sort_by("idx")
    places = np.array([np.frombuffer(x.as_py()) for x in group.column("p")])
    flat = group.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    single = flat.astype(np.float32)  # half the bytes where nothing is lost
    flat = single if np.array_equal(single, flat) else flat
    return pa.table({
        "d": group.column("d")[:1], "block": group.column("block")[:1],
        "low": pa.array([places.min(0).tolist()]), "high": pa.array([places.max(0).tolist()]),
        "nodes": pa.array([group.column("node").to_numpy().tobytes()], pa.binary()),
        "counts": pa.array([group.column("n").to_numpy().tobytes()], pa.binary()),
        "places": pa.array([places.tobytes()], pa.binary()), "vectors": pa.array([flat.tobytes()], pa.binary()),
    })


BLOCKS = (
    "d long, block long, low array<double>, high array<double>, nodes binary, counts binary, places binary, vectors binary"
)


def _joined(threshold: float, eps: float):
    """Rows (kind, a, b): a vector's links (0, node, number) and forest links (1, node, node)."""

    def apart(p: np.ndarray, q: np.ndarray) -> bool:
        gap = np.maximum(0, np.maximum(p.min(0) - q.max(0), q.min(0) - p.max(0)))
        return float(gap @ gap) > eps * eps * (1 + 1e-9)

    def opened(row: dict, s: str) -> tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        nodes, counts = (np.frombuffer(row[k + s], np.int64) for k in ("nodes", "counts"))
        single = len(row["vectors" + s]) == 4 * row["d"] * len(nodes)
        raw = np.frombuffer(row["vectors" + s], np.float32 if single else np.float64).astype(np.float64).reshape(-1, row["d"])
        return row["block" + s], nodes, counts, np.frombuffer(row["places" + s]).reshape(-1, LEADING), raw, _unit(raw)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        degrees: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        links: tuple[list[int], list[int]] = ([], [])
        most, first = 200_000, None
        for batch in batches:
            for i in range(batch.num_rows):
                d, block = batch.column("d")[i].as_py(), batch.column("block")[i].as_py()
                again = first is not None and first[0] == (d, block)  # rows come by their first interval
                row = {k: batch.column(k)[i].as_py() for k in batch.schema.names if k.endswith("2") or k == "d" or not again}
                first = first if again else ((d, block), opened(row, ""))
                both = (first[1], opened(row, "2"))
                same = both[0][0] == both[1][0]
                _, nodes, counts, places, raw, unit = zip(*both, strict=True)
                degree = [degrees.setdefault((d, x[0]), (x[1], np.zeros(len(x[1]), np.int64)))[1] for x in both]
                todo = [(0, len(nodes[0]), 0, len(nodes[1]))]
                while todo:
                    a, b, c, e = todo.pop()
                    if a == b or c == e or (same and c >= b and (a, b) != (c, e)) or apart(places[0][a:b], places[1][c:e]):
                        continue  # empty, the mirror of another pair, or distant
                    if max(b - a, e - c) > LEAF:
                        left = [(a, (a + b) // 2), ((a + b) // 2, b)] if b - a > LEAF else [(a, b)]
                        right = [(c, (c + e) // 2), ((c + e) // 2, e)] if e - c > LEAF else [(c, e)]
                        todo += [(*x, *y) for x in left for y in right]
                        continue
                    cosine = unit[0][a:b] @ unit[1][c:e].T
                    p, q = np.nonzero(cosine >= threshold - NEAR)
                    close = np.flatnonzero(np.abs(cosine[p, q] - threshold) <= NEAR)
                    keep = np.ones(len(p), bool)
                    for j in close.tolist():
                        x, y = raw[0][a + p[j]], raw[1][c + q[j]]
                        keep[j] = float(np.dot(x, y)) / float(np.sqrt(np.dot(x, x)) * np.sqrt(np.dot(y, y))) >= threshold
                    p, q = p[keep] + a, q[keep] + c
                    if same:
                        lower = p > q if (a, b) == (c, e) else np.ones(len(p), bool)
                        p, q = p[lower], q[lower]
                    np.add.at(degree[0], p, counts[1][q])
                    np.add.at(degree[1], q, counts[0][p])
                    links[0].extend(nodes[0][p].tolist())
                    links[1].extend(nodes[1][q].tolist())
                    if len(links[0]) > most:
                        links = spanning_forest(*links)
                        most = max(most, 2 * len(links[0]))
        links = spanning_forest(*links)
        own = [(n[k], g[k]) for n, g in degrees.values() for k in [np.flatnonzero(g)]]
        a = np.concatenate([*(n for n, _ in own), np.array(links[0], np.int64)])
        b = np.concatenate([*(g for _, g in own), np.array(links[1], np.int64)])
        kind = np.repeat([0, 1], [len(a) - len(links[0]), len(links[0])])
        yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(a), pa.array(b)], ["kind", "a", "b"])

    return run


def _met(blocks: DataFrame, eps: float) -> DataFrame:
    """Pairs of intervals that may hold links, each once, with what both hold: a product of the
    partitions of blocks with themselves, which shuffles nothing."""
    other = blocks.select(*[F.col(c).alias(c + "2") for c in blocks.columns])
    gap = F.aggregate(
        F.zip_with(
            F.zip_with("low", "high2", lambda x, y: x - y), F.zip_with("low2", "high", lambda x, y: x - y),
            lambda x, y: F.greatest(x, y, F.lit(0.0)),
        ),
        F.lit(0.0), lambda s, x: s + x * x,
    )
    once = F.when((F.col("d") - F.col("d2") == 0) & (F.col("block") >= F.col("block2")), gap <= eps * eps * (1 + 1e-9))
    # an equality of two columns would be taken as the key of a shuffle, in which one length of vectors is one group
    return blocks.join(other.hint("shuffle_replicate_nl"), once).drop("low", "high", "low2", "high2", "d2")


def near_duplicates(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", threshold: float = 0.9) -> DataFrame:
    """key, n_links, component, kept of every row.

    n_links counts the other rows at a cosine of threshold or more, component is the smallest
    key reached by links (itself included), kept says that it is the row's own. Null, empty
    and zero vectors and those with null, NaN or infinite components link with nothing, nor do
    vectors of different lengths. Equal vectors link with each other. Rows with a null key are
    left alone (no links, null component). Other columns are not read. An empty table gives
    an empty table."""
    spark = vectors.sparkSession
    eps = float(np.sqrt(max(0.0, 2 - 2 * threshold)))
    rows = _usable(vectors, key, vector).where("key is not null")
    nodes = stage(rows.groupBy("v").agg(F.min("key").alias("node"), F.count("*").alias("n")).select("node", "v", "n"), "vectors")
    order = ["d", *(f"c{i}" for i in range(LEADING)), "node"]
    ordered = dense_index(_celled(nodes, eps, _axes(nodes)), order, "grid-order")
    begin = ordered.groupBy("d").agg(F.min("idx").alias("begin"))  # one row for each length of vectors
    # sent to all tasks: a shuffle by d would put the vectors of one length into one task
    numbered = ordered.join(F.broadcast(begin), "d").withColumn("block", F.floor((F.col("idx") - F.col("begin")) / BLOCK).cast("long"))
    blocks = stage(numbered.select("d", "block", "idx", "node", "n", "v", "p").groupBy("d", "block").applyInArrow(_block, BLOCKS), "blocks")
    found = stage(map_batches(_met(blocks, eps), _joined(threshold, eps), "kind long, a long, b long"), "grid-links")
    degrees = found.where("kind = 0").groupBy(F.col("a").alias("node")).agg(F.sum("b").alias("links"))
    parts = components(found.where("kind = 1").select("a", "b"), "grid-stars")
    known = nodes.join(degrees, "node", "left").join(parts, "node", "left").select(
        "v", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "node").alias("component")
    )
    linked = rows.join(known, "v").select("key", "n_links", "component")
    alone = vectors.select(F.col(key).cast("long").alias("key"), F.col(vector).alias("v"))
    fine = F.size(F.filter("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))) == 0
    rest = alone.where(F.col("key").isNull() | ~F.coalesce(fine & F.exists("v", lambda x: x != 0), F.lit(False)))
    rest = rest.select("key", F.lit(0).cast("long").alias("n_links"), F.col("key").alias("component"))
    return linked.unionByName(rest).select(F.col("key").alias(key), "n_links", "component", (F.col("key") == F.col("component")).alias("kept"))
