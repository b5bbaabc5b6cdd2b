"""Byte-level BPE encoding and decoding.

Each match of the splitting pattern (a pre-token) is merged on its own, but all new pre-tokens
of a slice of rows wait in one queue: their bytes form one linked list, in which no pair
reaches from one pre-token into the next. Every adjacent pair whose joined bytes have a rank
waits in the bucket of that rank, and a bitmap of two levels over the ranks gives the lowest
bucket in use by two find-first-set steps, whatever the length of the list. A bucket is taken
as a whole, leftmost position first; an entry whose pair has changed since is stale and
skipped, and if a merge makes a pair of a lower rank, the rest of the bucket waits again. So
every pre-token sees its own pairs in the order in which it would alone. The list costs some
50 bytes of memory for each byte of new pre-tokens, so one pre-token of 10 MB takes 500 MB.

Short pre-tokens are remembered for the life of a Python worker, in two generations, so that
frequent ones cost one look-up each and memory is bounded.

The vocabulary is a tiktoken rank file (base64 bytes and rank on each line); its path is a
parameter and must be readable on the executors.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.llm.common import grown, map_batches

BITS = [1 << i for i in range(256)]
#: Remembered pre-tokens in a worker's young generation, and the longest that is remembered
#: (characters).
REMEMBERED, LONGEST = 250_000, 48
#: Characters of text that are coded at a time (at least a row), and the pre-tokens that a text
#: beyond that is split into at a time.
SLICE, BLOCK = 1 << 20, 200_000


class Coder:
    """Ranks, pattern and memory of one worker."""

    def __init__(self, path: str, pattern: str):
        import regex

        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            tokens[rank] = token
        self.tokens = pa.array(tokens, pa.binary())
        self.bytes = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        self.pairs = np.full(1 << 16, -1, np.int32)  # the rank of two bytes, if they have one
        for token, rank in self.ranks.items():
            if len(token) == 2:
                self.pairs[token[0] << 8 | token[1]] = rank
        self.split = regex.compile(pattern)
        self.words = [0] * ((len(tokens) >> 8) + 1)  # the bitmap's low level: 256 ranks a word
        self.known: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each pre-token (none is empty).

        The queue: buckets[rank] lists the positions that wait there; bit r % 256 of
        words[r // 256] says that bucket r is in use, bit q of top that words[q] is not zero."""
        if not pieces:
            return []
        data, get, words, top = b"".join(pieces), self.ranks.get, self.words, 0
        n, ends = len(data), np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)))
        at = np.frombuffer(data, np.uint8)
        ids = array("i", self.bytes[at].tobytes())  # of the token that starts here; -1: merged away
        ranks = np.full(n + 1, -1, np.int32)  # of the pair that starts here; -1: none
        ranks[: n - 1] = self.pairs[at[:-1].astype(np.int32) << 8 | at[1:]]
        ranks[ends - 1] = -1
        pair = array("i", ranks.tobytes())
        after, before = array("i", range(1, n + 2)), array("i", range(-1, n))
        # where a piece ends, seen from its last token, and where it begins, seen from its first
        bound = array("b", bytes(n + 1))
        bound[0] = 1
        for end in ends.tolist():
            bound[end] = 1
        some = np.flatnonzero(ranks >= 0).astype(np.int32)
        some = some[np.argsort(ranks[some], kind="stable")]
        found, first = np.unique(ranks[some], return_index=True)
        buckets = dict(zip(found.tolist(), np.split(some, first[1:]), strict=True)) if len(found) else {}
        for rank in buckets:
            words[rank >> 8] |= BITS[rank & 255]
            top |= BITS[rank >> 8]
        while top:
            q = (top & -top).bit_length() - 1
            word = words[q]
            rank = q << 8 | (word & -word).bit_length() - 1
            bucket = buckets.pop(rank)
            words[q] = word = word & (word - 1)
            if not word:
                top &= top - 1
            lower = False
            waiting = iter(bucket.tolist() if isinstance(bucket, np.ndarray) else sorted(bucket))
            for i in waiting:
                if pair[i] != rank:
                    continue  # stale
                gone = after[i]
                after[i] = end = after[gone]
                ids[i], ids[gone] = rank, -1
                pair[gone] = pair[i] = -1
                before[end] = i
                # the new token's pair with the next one, and that of the one before with it
                for j, stop in ((i, 0 if bound[end] else after[end]), (-1 if bound[i] else before[i], end)):
                    if stop and j >= 0:
                        new = get(data[j:stop])
                        if new is None:
                            pair[j] = -1
                            continue
                        pair[j] = new
                        lower |= new < rank
                        if new in buckets:
                            held = buckets[new]
                            if isinstance(held, np.ndarray):
                                buckets[new] = held = held.tolist()
                            held.append(j)
                        else:
                            buckets[new] = [j]
                            words[new >> 8] |= BITS[new & 255]
                            top |= BITS[new >> 8]
                if lower:
                    if left := list(waiting):
                        buckets[rank] = left
                        words[q] |= BITS[rank & 255]
                        top |= BITS[q]
                    break
        ids = np.frombuffer(ids, np.int32)
        count = np.cumsum(ids >= 0)[ends - 1] * 4
        made = ids[ids >= 0].astype("<u4").tobytes()
        return [made[a:b] for a, b in zip([0, *count[:-1].tolist()], count.tolist(), strict=True)]

    def _learn(self, pieces: set[str]) -> list[str]:
        """Make all pieces known; returns those that are too long to be remembered."""
        if len(self.known) >= REMEMBERED:
            self.old, self.known = self.known, {}
        missing, known, old, get = [], self.known, self.old, self.ranks.get
        pieces = pieces.difference(known)
        for piece in pieces:
            if (ids := old.get(piece)) is not None:
                known[piece] = ids
            elif (whole := get(own := piece.encode())) is not None:
                known[piece] = whole.to_bytes(4, "little")
            else:
                missing.append((piece, own))
        known.update(zip([p for p, _ in missing], self.merge([own for _, own in missing]), strict=True))
        return [p for p in pieces if len(p) > LONGEST]

    def _coded(self, pieces: list[list[str]]) -> list[bytes]:
        long, find = self._learn(set().union(*pieces)), self.known.__getitem__
        made = [b"".join(map(find, own)) for own in pieces]
        for piece in long:
            del self.known[piece]
        return made

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        out, some, size = [], [], 0
        for text in texts:
            if len(text or "") > SLICE:
                pieces, parts = (m.group() for m in self.split.finditer(text)), []
                while block := list(islice(pieces, BLOCK)):
                    parts += self._coded([block])
                out += [*self._coded(some), b"".join(parts)]
                some, size = [], 0
                continue
            some.append(self.split.findall(text or ""))
            size += len(text or "")
            if size >= SLICE:
                out += self._coded(some)
                some, size = [], 0
        return out + self._coded(some)

    def decode(self, ids: list[bytes | None]) -> list[bytes]:
        """The bytes that the ids of each row stand for."""
        out, some, size = [], [], 0
        for row in [*ids, None]:
            if size >= SLICE or len(out) + len(some) == len(ids):
                found = self.tokens.take(pa.array(np.frombuffer(b"".join(some), "<u4")))
                places = np.frombuffer(found.buffers()[1], np.int32, len(found) + 1) if len(found) else np.zeros(1, np.int32)
                stop = places[np.cumsum([0, *(len(x) // 4 for x in some)])].tolist()
                plain = found.buffers()[2].to_pybytes() if len(found) else b""
                out += [plain[a:b] for a, b in zip(stop, stop[1:], strict=False)]
                some, size = [], 0
            some.append(row or b"")
            size += len(some[-1])
        return out


@lru_cache(maxsize=2)
def coder(path: str, pattern: str) -> Coder:
    return Coder(path, pattern)


def _mapped(df: DataFrame, path: str, pattern: str, source: str, targets: tuple[str, ...], change, drop: bool = False, size: int = 256) -> DataFrame:
    """df (without source, if drop) with the binary columns targets: what change() makes of a
    coder and the values of source."""
    plain = df.drop(source) if drop else df
    schema = grown(plain.schema, **dict.fromkeys(targets, "binary"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(path, pattern)
        for whole in batches:
            at = whole.schema.get_field_index(source)
            kept = [i for i in range(whole.num_columns) if i != at or not drop]
            for start in range(0, whole.num_rows, size):  # small slices bound the memory
                batch = whole.slice(start, size)
                made = change(own, batch.column(at).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i) for i in kept), *(pa.array(m, pa.binary()) for m in made)],
                    [*(batch.schema.names[i] for i in kept), *targets],
                )

    return map_batches(df, run, schema)


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "token_ids") -> DataFrame:
    """docs with the binary column ids: the text's token ids, four little-endian bytes each.

    A null text counts as empty and has no ids. Special tokens are ordinary text. Other
    columns stay, but one named like ids is replaced. Rows are independent: repeated rows, ties and
    empty tables need no care."""
    return _mapped(docs.drop(ids), path, pattern, text, (ids,), lambda own, x: (own.encode(x),))


def decode(docs: DataFrame, path: str, pattern: str, ids: str = "token_ids", out: str = "decoded") -> DataFrame:
    """docs with the binary column out: the bytes that ids stand for (null ids:
    none). A column named like out is replaced."""
    return _mapped(docs.drop(out), path, pattern, ids, (out,), lambda own, x: (own.decode(x),))


def round_trip(docs: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "token_ids", out: str = "decoded") -> DataFrame:
    """docs without the text, with ids as of encode() and out as of decode() of these ids, in
    one pass: one Python worker for each task, not two."""

    def change(own: Coder, x: list[str | None]) -> tuple[list[bytes], list[bytes]]:
        made = own.encode(x)
        return made, own.decode(made)

    return _mapped(docs.drop(ids, out), path, pattern, text, (ids, out), change, drop=True)


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row's whole text."""
    coded = round_trip(docs.select("doc_id", "text"), path, pattern)
    return coded.select(
        "doc_id",
        (F.octet_length("token_ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("token_ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
