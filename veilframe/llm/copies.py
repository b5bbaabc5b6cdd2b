"""Near copies of a similarity: SimHash anchors and min-hash bands propose, exact Jaccard decides.

Two texts are linked if the sets of their runs of five words (hashed as in simhash; fewer
words: all of them; no words: the empty set, equal to itself only) have a Jaccard similarity
of SIMILARITY or more. Components of the links are groups of copies.

Candidates. At a similarity of 0.8 about ten of 64 bits of a SimHash differ, which no covering
code reaches with few replicas. So the anchors (all pairs within 2 bits) are joined by BANDS
keys of ROWS min-hashes each: a pair of similarity s shares a key with probability
1 - (1 - s ** ROWS) ** BANDS, 0.99997 at 0.8 and more above.

Scale. Equal sets are one node. First each node is checked against its anchors' links and the
least node of each of its keys, as many pairs as there are rows. Only keys whose nodes are
still in several components are then compared in full, across components, in cells of
bounded size; nothing but links leaves a cell.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.llm.common import map_batches, stage
from veilframe.llm.graph import components
from veilframe.llm.simhash import _hashed, _majority, linked

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 20, 4
#: Nodes in a block; a cell of a crowded key is two blocks.
CELL = 256
#: Hashes that are permuted at a time.
PART = 4096


def _odd() -> np.ndarray:
    return np.random.default_rng(20).integers(1, 1 << 63, (BANDS * ROWS, 2), np.uint64) | np.uint64(1)


def shingles(text: str | None) -> np.ndarray:
    blocks = list(_hashed(text, SHINGLE))
    return np.unique(np.concatenate(blocks)) if blocks else np.zeros(0, np.uint64)


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Jaccard similarity of two sorted sets of SIMILARITY or more."""
    if min(len(a), len(b)) < SIMILARITY * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= SIMILARITY * (len(a) + len(b) - both)


def bands(own: np.ndarray) -> np.ndarray:
    """The keys of a set."""
    import xxhash

    odd = _odd()
    least = np.full(BANDS * ROWS, (1 << 64) - 1, np.uint64)
    for at in range(0, len(own), PART):
        part = (own[None, at : at + PART] ^ odd[:, :1]) * odd[:, 1:]
        np.minimum(least, part.min(axis=1), out=least)
    return np.array([xxhash.xxh64_intdigest(x.tobytes(), i) for i, x in enumerate(least.reshape(BANDS, ROWS))], np.uint64).view(np.int64)


def _digest(own: np.ndarray) -> int:
    import xxhash

    return int(np.uint64(xxhash.xxh64_intdigest(own.tobytes())).view(np.int64))


def described(docs: DataFrame) -> DataFrame:
    """key, own, fp, node (digest of the set) and keys of docs (key, text, own)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps, nodes, keys = [], [], []
            for text in batch.column(1):
                blocks = list(_hashed(text.as_py(), SHINGLE))
                own = np.unique(np.concatenate(blocks)) if blocks else np.zeros(0, np.uint64)
                fps.append(_majority(blocks))
                nodes.append(_digest(own))
                keys.append(bands(own).tolist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(nodes, pa.int64()), pa.array(keys, pa.list_(pa.int64()))],
                ["key", "own", "fp", "node", "keys"],
            )

    return map_batches(docs.select("key", "text", "own"), run, "key long, own long, fp long, node long, keys array<long>")


def _checked(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) that are similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, known = None, None
        for batch in batches:
            a, b = [], []
            for x, y, s, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
                if x != last:
                    last, known = x, shingles(s.as_py())
                if similar(known, shingles(t.as_py())):
                    a.append(x)
                    b.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    both = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("s")), "a")
    both = both.join(texts.select(F.col("node").alias("b"), F.col("text").alias("t")), "b")
    return map_batches(both.select("a", "b", "s", "t"), run, "a long, b long")


def _compared(group: pa.Table) -> pa.Table:
    """Links across components in a cell (node, component, text)."""
    nodes, of = group.column("node").to_pylist(), group.column("component").to_pylist()
    sets = [shingles(t.as_py()) for t in group.column("text")]
    root = {c: c for c in of}

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    a, b = [], []
    for i in range(len(nodes)):
        for j in range(i):
            p, q = find(of[i]), find(of[j])
            if p != q and similar(sets[i], sets[j]):
                root[p] = q
                a.append(nodes[i])
                b.append(nodes[j])
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def row_hash(docs: DataFrame):
    """A hash of all columns of a row, nulls included."""
    return F.xxhash64(*[x for c in docs.columns for x in (F.col(f"`{c}`"), F.col(f"`{c}`").isNull())])


def _grouped(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, own (hash of the row), node and part (the group) of every row, and component (the
    smallest key of the part)."""
    plain = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"), row_hash(docs).alias("own"))
    prints = stage(described(plain), "copies")
    nodes = stage(prints.where("key is not null").groupBy("node").agg(F.min("key").alias("key"), F.first("fp").alias("fp"), F.first("keys").alias("keys")), "sets")
    places = nodes.select("node", F.explode("keys").alias("k"))
    shared = stage(places.groupBy("k").agg(F.count("*").alias("n"), F.min("node").alias("a")).where("n > 1"), "shared")
    met = stage(places.join(shared, "k"), "met")
    prints_of = stage(nodes.groupBy("fp").agg(F.min("node").alias("node")), "prints")
    same = nodes.select("fp", F.col("node").alias("b")).join(prints_of.withColumnRenamed("node", "a"), "fp").select("a", "b")
    pairs = met.select("a", F.col("node").alias("b")).unionByName(same).unionByName(linked(prints_of))
    pairs = stage(pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")
    wanted = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    # the text of a node is that of any row with its smallest key and its set
    keyed = stage(nodes.join(wanted, "node", "left_semi").select("key", "node"), "wanted")
    chosen = prints.join(keyed, ["key", "node"]).groupBy("node").agg(F.min("own").alias("own"))
    texts = plain.select("text", "own").join(stage(chosen, "chosen"), "own").select("node", "text").dropDuplicates(["node"])
    texts = stage(texts, "texts")
    links = stage(_checked(pairs, texts), "links")
    parts = stage(components(links, "copies-stars"), "parts")
    placed = stage(met.select("k", "node").join(parts, "node", "left").withColumn("component", F.coalesce("component", "node")), "placed")
    open_ = placed.groupBy("k").agg(F.count("*").alias("n"), F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y")
    blocks = F.ceil(F.col("n") / CELL).cast("int")
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    cells = placed.join(stage(open_.select("k", blocks.alias("blocks")), "open"), "k").withColumn("own", own)
    cells = cells.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = cells.select("k", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "node", "component")
    more = stage(cells.join(texts, "node").groupBy("k", "i", "j").applyInArrow(_compared, "a long, b long"), "more")
    if not more.isEmpty():
        parts = stage(components(links.unionByName(more), "copies-stars"), "parts")
    known = stage(nodes.select("node", "key").join(parts, "node", "left").select("node", "key", F.coalesce("component", "node").alias("part")), "known")
    least = stage(known.groupBy("part").agg(F.min("key").alias("component")), "least")
    found = stage(known.join(least, "part").select("node", "part", "component"), "found")
    return prints.join(found, "node", "left").select("key", "own", "node", F.coalesce("part", "node").alias("part"), "component")


def near_copies(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, node and component of every row: the smallest key that links reach.

    Rows with equal sets share node and component. A row without a key has the component of
    its node if a row with a key shares it, else null, and links nothing. Other columns are
    not returned, so their names are free. An empty table gives an empty table."""
    return _grouped(docs, key, text).select(F.col("key").alias(key), "node", "component")


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one row of each group of near copies: the one with the smallest key, nulls
    last; of several such rows the one with the smallest hash of all columns, and one of rows
    that are equal in all columns.

    Rows of one key with unrelated texts are groups of their own and stay. Null texts, empty
    ones and those without words are copies of each other. Rows without a key are copies of
    rows with an equal set only. Columns may have any names. An empty table gives an empty
    table."""
    groups = stage(_grouped(docs, key, text).select("key", "own", "part"), "groups")
    first = groups.groupBy("part").agg(F.min(F.struct(F.col("key").isNull().alias("nameless"), "key", "own")).alias("one"))
    times = groups.groupBy("own").agg(F.count("*").alias("times"))
    chosen = stage(first.select("one.own").join(times, "own"), "chosen")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), row_hash(docs).alias("own"))
    kept = rows.join(chosen.where("times = 1"), "own", "left_semi")
    if not chosen.where("times > 1").isEmpty():
        kept = kept.unionByName(rows.join(chosen.where("times > 1"), "own", "left_semi").dropDuplicates(["own"]))
    return kept.select("row.*")
