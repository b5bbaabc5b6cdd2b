"""Quality classifier: logistic regression on hashed word n-grams, learned by FTRL.

A text's features are its words without the symbols around them (lower case), their shapes
(case, digits, symbols), and pairs of neighbours of either: four streams of n-grams, hashed
into 2^BITS slots. A feature's value is SCALE times its share of its stream, so long and
short texts score alike, and a score is a sparse dot product: the mean weight of the n-grams.

Learning takes a sample of at most `sample` labelled rows (those with the smallest hash of
their key and text; default 20,000), dealt into SHARDS shards. In each pass every shard runs
follow-the-regularised-leader over its rows from the common state, and the states are
averaged block by block of slots; states stay in tables, and the driver gets the 2^BITS
weights once, at the end. Scoring is one pass over all rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.llm.common import grown, map_batches, release, stage

BITS, SHARDS, PASSES, SCALE = 18, 8, 3, 8.0
SIZE = 1 << BITS
#: The state travels in so many blocks of slots.
BLOCKS = 16
WIDE = SIZE // BLOCKS + 1
#: Learning rate, its offset, and the two penalties.
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.0005
#: Words of a long text that are hashed at a time; remembered words in a worker.
BLOCK, REMEMBERED = 1 << 16, 100_000

SHAPE = {i: "9" if 48 <= i < 58 else "X" if 65 <= i < 91 else "x" if 97 <= i < 123 else chr(i) for i in range(128)}


class _Hashes(dict):
    """Hashes of a word (low half) and its shape (high half)."""

    def __missing__(self, word: str) -> int:
        marks = []
        for c in word.translate(SHAPE):
            c = c if c.isascii() else "X" if c.isupper() else "x" if c.isalpha() else c
            if not marks or marks[-1] != c:
                marks.append(c)
        bare = word.lower().strip("""!"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~""")
        made = crc32(bare.encode()) | crc32("".join(marks).encode()) << 32
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = made
        return made


@lru_cache(maxsize=1)
def _hashes() -> _Hashes:
    return _Hashes()


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    h = a * np.uint64(0x9E3779B97F4A7C15) ^ b * np.uint64(0xC2B2AE3D27D4EB4F)
    return h ^ h >> np.uint64(29)


def _slots(words: list[str]) -> list[np.ndarray]:
    """Slots of the n-grams of the four streams. A pair of shapes also says whether it is one
    word twice."""
    both = np.fromiter(map(_hashes().__getitem__, words), np.uint64, len(words))
    low, high = both & np.uint64(0xFFFFFFFF), both >> np.uint64(32)
    twice = (low[1:] == low[:-1]).astype(np.uint64) << np.uint64(40)
    streams = [
        _mix(low, np.ones_like(low)),
        _mix(low[:-1], low[1:]),
        _mix(high, np.zeros_like(high)),
        _mix(high[:-1], high[1:] ^ twice ^ np.uint64(7)),
    ]
    return [(s * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(64 - BITS)).astype(np.int64) for s in streams]


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct slots and their values."""
    words = (text or "").split()
    slots, values = [], []
    for s in _slots(words) if words else []:
        if len(s):
            found, count = np.unique(s, return_counts=True)
            slots.append(found)
            values.append(count * (SCALE / len(s)))
    if not slots:
        return np.zeros(0, np.int64), np.zeros(0)
    found, at = np.unique(np.concatenate(slots), return_inverse=True)
    return found, np.bincount(at, np.concatenate(values))


def margin(text: str | None, weights: np.ndarray, bias: float) -> float:
    """The log-odds of label 1."""
    words, total, count = (text or "").split(), np.zeros(4), np.zeros(4)
    for at in range(0, len(words), BLOCK):
        for i, s in enumerate(_slots(words[at : at + BLOCK + 1])):
            s = s[:BLOCK]  # the word after the block only ends its last pair
            total[i] += weights[s].sum()
            count[i] += len(s)
    return bias + SCALE * float((total / np.maximum(count, 1)).sum())


def _weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))


def _leader(group: pa.Table, state: pa.Table) -> pa.Table:
    """One pass over a shard from the common state (no rows: zeros); slot SIZE is the bias,
    with value 1. The shard's state in blocks."""
    z, n = np.zeros(BLOCKS * WIDE), np.zeros(BLOCKS * WIDE)
    for block, *parts in zip(*(state.column(c).to_pylist() for c in ("block", "z", "n")), strict=True):
        for whole, part in zip((z, n), parts, strict=True):
            whole[block * WIDE : (block + 1) * WIDE] = np.frombuffer(part, np.float32)
    group = group.sort_by([("order", "ascending"), ("label", "ascending")])
    for label, slots, values in zip(group.column("label").to_pylist(), group.column("slots"), group.column("vals"), strict=True):
        at = np.append(np.frombuffer(slots.as_py(), np.int32), SIZE)
        x = np.append(np.frombuffer(values.as_py(), np.float32), 1.0)
        w = _weights(z[at], n[at])
        g = x * (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - label)
        z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA * w
        n[at] += g * g
    blocks = range(BLOCKS if group.num_rows else 0)
    made = [pa.array([v[b * WIDE : (b + 1) * WIDE].astype(np.float32).tobytes() for b in blocks], pa.binary()) for v in (z, n)]
    release()
    return pa.table([pa.array(blocks, pa.int32()), *made], ["block", "z", "n"])


def _average(group: pa.Table) -> pa.Table:
    """The mean state of a block over the shards."""
    made = [np.mean([np.frombuffer(x.as_py(), np.float32) for x in group.column(c)], axis=0, dtype=float) for c in ("z", "n")]
    return pa.table(
        [group.column("block").slice(0, 1), *(pa.array([m.astype(np.float32).tobytes()], pa.binary()) for m in made)], ["block", "z", "n"]
    )


def train(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "label", sample: int = 20_000
) -> tuple[np.ndarray, float]:
    """Weights and bias from docs whose key has a label of 0 or 1 in labels; other labels are left
    out, and so are null keys. Without any such row all weights are zero.

    The sample is chosen by hashes of keys and texts before any text moves: of repeated rows
    one counts, and the texts of a key come in any number below `sample`."""
    order = F.xxhash64(F.col(key).cast("string"))
    known = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull()).select(F.col(key).alias("key"), F.col(label).cast("int").alias("label"))
    known = known.distinct().orderBy(F.xxhash64(F.col("key").cast("string")), "label").limit(sample)
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), order.alias("order"), F.xxhash64(F.col(text)).alias("own"))
    rows = rows.join(F.broadcast(stage(known, "quality-labels")), "key")
    chosen = rows.select("order", "own", "label").distinct().orderBy("order", "own", "label").limit(sample)
    rows = rows.join(F.broadcast(stage(chosen, "quality-chosen")), ["order", "own", "label"], "left_semi")
    rows = rows.select("order", "own", "label", "text").dropDuplicates(["order", "own", "label"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [features(x.as_py()) for x in batch.column(3)]
            slots = pa.array([m[0].astype(np.int32).tobytes() for m in made], pa.binary())
            values = pa.array([m[1].astype(np.float32).tobytes() for m in made], pa.binary())
            shard = pa.array([(o ^ w) % SHARDS for o, w in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)], pa.int32())
            yield pa.RecordBatch.from_arrays(
                [shard, batch.column(0), batch.column(2), slots, values], ["shard", "order", "label", "slots", "vals"]
            )

    made = stage(map_batches(rows, run, "shard int, order long, label int, slots binary, vals binary"), "quality-sample")
    spark = docs.sparkSession
    state = spark.createDataFrame([], "block int, z binary, n binary")
    for _ in range(PASSES):
        dealt = state.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(SHARDS - 1))))
        both = made.groupBy("shard").cogroup(dealt.groupBy("shard"))
        state = stage(both.applyInArrow(_leader, "block int, z binary, n binary").groupBy("block").applyInArrow(_average, "block int, z binary, n binary"), "quality-state")
    w = np.zeros(BLOCKS * WIDE, np.float32)
    for row in state.collect():  # BLOCKS rows of one model
        own = _weights(np.frombuffer(row["z"], np.float32).astype(float), np.frombuffer(row["n"], np.float32).astype(float))
        w[row["block"] * WIDE : (row["block"] + 1) * WIDE] = own
    return w[:SIZE], float(w[SIZE])


def score(docs: DataFrame, model: tuple[np.ndarray, float], text: str = "text", out: str = "score") -> DataFrame:
    """docs with the probability of label 1, from the text alone. A null text is empty; an
    empty text has the probability that the bias gives. Repeated rows score alike. A column
    named like out is replaced."""
    docs = docs.drop(out)
    held = docs.sparkSession.sparkContext.broadcast((np.asarray(model[0], np.float32), model[1]))
    schema = grown(docs.schema, **{out: "double"})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = held.value
        for batch in batches:
            m = np.array([margin(x.as_py(), weights, bias) for x in batch.column(batch.schema.get_field_index(text))])
            made = 1 / (1 + np.exp(-np.clip(m, -500, 500)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.float64())], [*batch.schema.names, out])
        _hashes().clear()  # the worker process lives on for other stages

    return map_batches(docs, run, schema)


def held_out(key: str = "doc_id"):
    """A null key counts as an empty text, so this is never null."""
    return F.pmod(F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2


def learned(docs: DataFrame, labels: DataFrame, sample: int = 20_000) -> tuple[np.ndarray, float]:
    """The model of documents' quality from the labels of rows that are not held out."""
    known = labels.where(~held_out()).select("doc_id", F.col("quality").alias("label"))
    return train(docs.select("doc_id", "text"), known, sample=sample)
