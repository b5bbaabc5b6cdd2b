"""Language-model scores of documents: smoothed unigram, and a log-bilinear model.

Tokens are the lower-cased (A-Z) words of a text and one end. Token counts cover all training
documents and stay a distributed table. The FREQUENT most frequent tokens (ties at the
boundary fall out) are also sent to every task; they are most of any text, also the hot keys,
so only the other tokens of a document meet the table in a join.

Model. Every token has a class: the end, each of the WORDS most frequent words, and for all
others one of SUFFIXES classes by their last two bytes. The log-bilinear part predicts the
class from the vectors of the CONTEXT classes before it (position-wise scaled sums, a product
with each class's vector, a bias); softmax over all classes makes it a probability. A token
has the probability of its class times its smoothed share of the class's count, with half a
count for unseen ones, so the model is a distribution over all tokens.

Training. Noise-contrastive estimation in numpy, one pass over all training documents: in
ROUNDS rounds (a hash of the id deals documents to rounds) each task learns from its rows,
starting from the common parameters, and the results are averaged by training tokens.
Scoring is batched matrix products over blocks of tokens.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.llm.common import stage

FREQUENT = 1 << 17
WORDS, SUFFIXES, CONTEXT, WIDTH = 159, 96, 4, 16
CLASSES = 1 + WORDS + SUFFIXES
ROUNDS, NOISE, BATCH, RATE = 2, 64, 4096, 0.15
#: Tokens counted in a task before it passes its counts on.
COUNTED = 400_000
#: No word holds a blank, so this is none.
END = b"\n"


def tokens(text: str | None) -> list[bytes]:
    return [*(text or "").encode().lower().split(), END]


def counted(docs: DataFrame) -> DataFrame:
    """token, c: how often each token occurs in docs (text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out():
            return pa.RecordBatch.from_arrays(
                [pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["token", "c"]
            )

        seen: Counter[bytes] = Counter()
        for batch in batches:
            for text in batch.column(0):
                seen.update(tokens(text.as_py()))
                if len(seen) > COUNTED:
                    yield out()
                    seen = Counter()
        yield out()

    return docs.select("text").mapInArrow(run, "token binary, c long").groupBy("token").agg(F.sum("c").alias("c"))


def _suffix(token: Column) -> Column:
    return (1 + WORDS + F.crc32(F.substring(token, -2, 2)) % SUFFIXES).cast("int")


class _Index(dict):
    """Place of a frequent token; -1 for others."""

    def __missing__(self, token: bytes) -> int:
        return -1


@dataclass
class Vocabulary:
    """Frequent tokens (the end first, then by count), with counts and classes; classes' denominators."""

    index: _Index
    count: np.ndarray
    kind: np.ndarray
    total: int
    distinct: int
    share: np.ndarray  # of each class among training tokens
    below: np.ndarray  # log10 of a class's smoothed count; 0 where the class is one token

    def classes(self, words: list[bytes], at: np.ndarray) -> np.ndarray:
        kind = self.kind[at]
        rare = np.flatnonzero(at < 0)
        kind[rare] = [1 + WORDS + crc32(words[i][-2:]) % SUFFIXES for i in rare.tolist()]
        return kind


def vocabulary(counts: DataFrame) -> Vocabulary:
    level = F.floor(F.log2("c") * 8).alias("level")
    levels = sorted(counts.where(F.col("token") != F.lit(END)).groupBy(level).count().collect(), reverse=True)
    kept, least = 0, None
    for r in levels:
        kept += r["count"]
        if kept > FREQUENT:
            break
        least = r["level"]
    ends = counts.where(F.col("token") == F.lit(END)).agg(F.sum("c")).first()[0] or 0
    frequent = counts.where((F.col("token") != F.lit(END)) & (level >= least)).toArrow() if least is not None else None
    found = sorted(zip(frequent.column("token").to_pylist(), frequent.column("c").to_pylist(), strict=True), key=lambda x: (-x[1], x[0])) if frequent else []
    words = [END, *(w for w, _ in found)]
    count = np.array([ends, *(c for _, c in found), 0], np.float64)  # the last is for -1
    kind = np.zeros(len(words) + 1, np.int32)
    one = min(WORDS, len(found))
    kind[1 : one + 1] = np.arange(1, one + 1)
    kind[one + 1 : -1] = [1 + WORDS + crc32(w[-2:]) % SUFFIXES for w in words[one + 1 :]]
    top = words[: one + 1]
    mass, types = np.zeros(CLASSES), np.zeros(CLASSES)
    mass[kind[: one + 1]] = count[: one + 1]
    rest = counts.where(~F.col("token").isin(top)).groupBy(_suffix(F.col("token")).alias("k"))
    for r in rest.agg(F.sum("c").alias("c"), F.count("*").alias("n")).collect():
        mass[r["k"]], types[r["k"]] = r["c"], r["n"]
    below = np.where(np.arange(CLASSES) > WORDS, np.log10(mass + 0.5 * (types + 1)), 0.0)
    prior = mass + 0.5 / SUFFIXES  # the half count of unseen tokens
    total = int(mass.sum())
    distinct = int(types.sum()) + sum(c > 0 for c in count[: one + 1])
    return Vocabulary(_Index(zip(words, range(len(words)), strict=True)), count, kind, total, distinct, prior / prior.sum(), below)


@dataclass
class Bilinear:
    """Class vectors and biases, and the scale of each context position."""

    vectors: np.ndarray
    scales: np.ndarray
    bias: np.ndarray

    @staticmethod
    def start(share: np.ndarray) -> Bilinear:
        rng = np.random.default_rng(0)
        return Bilinear(
            rng.normal(0, 0.1, (CLASSES, WIDTH)).astype(np.float32),
            np.ones((CONTEXT, WIDTH), np.float32),
            np.log(share).astype(np.float32),
        )

    def parts(self) -> list[np.ndarray]:
        return [self.vectors, self.scales, self.bias]

    def log10(self, context: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Normalised log10 probabilities of target classes (rows of CONTEXT classes before)."""
        out = np.empty(len(target))
        for at in range(0, len(target), BATCH):
            c, t = context[at : at + BATCH], target[at : at + BATCH]
            logits = np.einsum("bcw,cw->bw", self.vectors[c], self.scales) @ self.vectors.T + self.bias
            own = logits[np.arange(len(t)), t]
            top = logits.max(axis=1)
            logits -= top[:, None]
            np.exp(logits, out=logits)
            out[at : at + BATCH] = own - top - np.log(logits.sum(axis=1))
        return out / np.log(10)

    def learn(self, context: np.ndarray, target: np.ndarray, noise: np.ndarray, offset: np.ndarray, seen: list[np.ndarray]) -> None:
        """One step of noise-contrastive estimation on a batch. noise: classes drawn for the
        whole batch; offset: log(len(noise) * share); seen: sums of squared steps (Adagrad)."""
        r, s, b = self.parts()
        before = r[context]
        q = np.einsum("bcw,cw->bw", before, s)
        good = 1 / (1 + np.exp(-((q * r[target]).sum(1) + b[target] - offset[target]))) - 1  # d loss / d score
        bad = 1 / (1 + np.exp(-(q @ r[noise].T + b[noise] - offset[noise])))
        dq = good[:, None] * r[target] + bad @ r[noise]
        steps = [np.zeros_like(x) for x in self.parts()]
        _add(steps[0], target, good[:, None] * q)
        _add(steps[0], noise, bad.T @ q)
        for i in range(CONTEXT):
            _add(steps[0], context[:, i], dq * s[i])
            steps[1][i] = (dq * before[:, i]).sum(0)
        steps[2] += np.bincount(target, good, CLASSES) + np.bincount(noise, bad.sum(0), CLASSES)
        for x, step, sum2 in zip(self.parts(), steps, seen, strict=True):
            step /= len(target)
            sum2 += step * step
            x -= RATE * step / (np.sqrt(sum2) + 1e-6)


def _add(to: np.ndarray, at: np.ndarray, rows: np.ndarray) -> None:
    order = np.argsort(at.astype(np.uint16), kind="stable")
    first = np.flatnonzero(np.diff(at[order], prepend=-1))
    to[at[order][first]] += np.add.reduceat(rows[order], first, axis=0)


def _windows(kinds: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Contexts and targets of documents' classes; before a document stand ends."""
    line = np.concatenate(list(chain.from_iterable((np.zeros(CONTEXT, np.int32), k) for k in kinds)))
    sizes = np.array([len(k) for k in kinds])
    begins = np.cumsum(sizes + CONTEXT) - sizes - CONTEXT
    at = np.arange(sizes.sum()) + np.repeat(begins - (np.cumsum(sizes) - sizes), sizes)
    return line[at[:, None] + np.arange(CONTEXT)], line[at + CONTEXT]


def train(docs: DataFrame, words: Vocabulary) -> Bilinear:
    """Parameters learned from docs (text, and round: the round that a row belongs to)."""
    context = docs.sparkSession.sparkContext
    model, held = Bilinear.start(words.share), context.broadcast(words)

    def step(start: list[np.ndarray]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own, known = Bilinear(*(x.copy() for x in start)), held.value
            seen, rng, used = [np.full_like(x, 1e-3) for x in start], np.random.default_rng(1), 0
            offset = np.log(NOISE * known.share).astype(np.float32)
            waiting, size = [], 0
            drawn = np.cumsum(known.share)

            def use(kinds):
                c, t = _windows(kinds)
                for at in range(0, len(t), BATCH):
                    noise = np.minimum(np.searchsorted(drawn, rng.random(NOISE)), CLASSES - 1)
                    own.learn(c[at : at + BATCH], t[at : at + BATCH], noise, offset, seen)
                return len(t)

            for batch in batches:
                for text in batch.column(0):
                    found = tokens(text.as_py())
                    at = np.fromiter(map(known.index.__getitem__, found), np.int64, len(found))
                    waiting.append(known.classes(found, at))
                    size += len(found)
                    if size >= 16 * BATCH:
                        used += use(waiting)
                        waiting, size = [], 0
            if waiting:
                used += use(waiting)
            blob = b"".join(x.astype(np.float64).tobytes() for x in own.parts())
            yield pa.RecordBatch.from_arrays(
                [pa.array([TaskContext.get().partitionId() % 64]), pa.array([float(used)]), pa.array([blob], pa.binary())],
                ["part", "used", "blob"],
            )

        return run

    def mean(rows) -> tuple[float, np.ndarray]:
        used = np.array([u for u, _ in rows])
        parts = np.array([np.frombuffer(b) for _, b in rows])
        return float(used.sum()), (parts * (used / max(used.sum(), 1))[:, None]).sum(0) if used.sum() else parts[0]

    def joined(group: pa.Table) -> pa.Table:
        used, blob = mean(list(zip(group.column("used").to_pylist(), group.column("blob").to_pylist(), strict=True)))
        return pa.table({"used": [used], "blob": pa.array([blob.tobytes()], pa.binary())})

    for k in range(ROUNDS):
        own = docs.where(F.col("round") == k).select("text").mapInArrow(step(model.parts()), "part long, used double, blob binary")
        rows = own.groupBy("part").applyInArrow(joined, "used double, blob binary").collect()
        used, flat = mean([(r["used"], bytes(r["blob"])) for r in rows]) if rows else (0, None)
        if used:
            cut = np.cumsum([x.size for x in model.parts()])
            model = Bilinear(*(p.reshape(x.shape).astype(np.float32) for p, x in zip(np.split(flat, cut[:-1]), model.parts(), strict=True)))
    return model


SCORED = (
    "row long, doc_id long, held_out boolean, n_tokens long, n_known long, all_log double, score double, "
    "token binary, tf long"
)


def _scored(held) -> object:
    """SCORED rows: one for each document with what its frequent tokens give (token null),
    and one for each of its other tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, model = held.value
        logs = np.log10(words.count + 0.5)
        logs[-1] = 0.0  # tokens that aren't frequent get theirs from the join
        row = TaskContext.get().partitionId() << 33
        names = [x.split()[0] for x in SCORED.split(", ")]
        kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary(), pa.int64()]

        def use(waiting):
            nonlocal row
            context, target = _windows([w[4] for w in waiting])
            inner = np.cumsum(np.concatenate(([0.0], model.log10(context, target) - words.below[target])))
            end, docs, rare = 0, [], []
            for doc_id, held_out, found, at, kind in waiting:
                start, end = end, end + len(at)
                own = logs[at]
                score = inner[end] - inner[start] + own[kind > WORDS].sum()
                docs.append((row, doc_id, held_out, len(at), int((words.count[at] > 0).sum()), own.sum(), score, None, None))
                for token, n in Counter([found[i] for i in np.flatnonzero(at < 0).tolist()]).items():
                    rare.append((row, token, n))
                row += 1
            columns = [pa.array(c, k) for c, k in zip(zip(*docs, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, names)
            for i in range(0, len(rare), 100_000):
                r, t, n = zip(*rare[i : i + 100_000], strict=True)
                filled = {"row": pa.array(r, pa.int64()), "token": pa.array(t, pa.binary()), "tf": pa.array(n, pa.int64())}
                columns = [filled.get(x, pa.nulls(len(r), k)) for x, k in zip(names, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names)

        waiting, size = [], 0
        for batch in batches:
            for doc_id, held_out, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                found = tokens(text.as_py())
                at = np.fromiter(map(words.index.__getitem__, found), np.int64, len(found))
                waiting.append((doc_id, held_out, found, at, words.classes(found, at)))
                size += len(found)
                if size >= 8 * BATCH:
                    yield from use(waiting)
                    waiting, size = [], 0
        if waiting:
            yield from use(waiting)

    return run


def held_out(key: str = "doc_id") -> Column:
    return F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(5)) == 1


def scores(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row.

    The model and the counts come from the rows that are not held out. A null text is empty
    and has one token, the end; a null doc_id is not held out. Repeated rows each count.
    Without training rows every token has the smoothed count of an unseen one, and classes
    are equally likely. An empty table gives an empty table."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held_out(), F.lit(False)).alias("held_out"), "text")
    known = rows.where(~F.col("held_out"))
    counts = stage(counted(known), "counts")
    words = vocabulary(counts)
    model = train(known.withColumn("round", F.pmod(F.xxhash64("doc_id"), F.lit(ROUNDS))), words)
    held = spark.sparkContext.broadcast((words, model))
    found = stage(rows.mapInArrow(_scored(held), SCORED), "scored")
    log = F.log10(F.coalesce("c", F.lit(0)) + F.lit(0.5))
    rare = (
        found.where("token is not null").select("row", "token", "tf").join(counts, "token", "left").groupBy("row")
        .agg(F.sum(F.col("tf") * log).alias("rare_log"), F.sum(F.when(F.col("c") > 0, F.col("tf")).otherwise(0)).alias("rare_known"))
    )
    below = float(np.log10(words.total + 0.5 * (words.distinct + 1)))
    rest = F.coalesce("rare_log", F.lit(0.0))
    return found.where("token is null").join(rare, "row", "left").select(
        "doc_id", "held_out", "n_tokens",
        (F.col("n_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(words.total).cast("long").alias("train_tokens"),
        (F.col("all_log") + rest - F.col("n_tokens") * F.lit(below)).alias("base_score"),
        (F.col("score") + rest).alias("score"),
    )
