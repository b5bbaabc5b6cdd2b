"""Periodic runs of words, and texts without their repeats, by the linear tandem-repeat method.

A run of period q is at least `least` words long and `times` periods. It holds a string of
least - least // times words twice, q words apart, so stretches of a text without such a string
seen twice hold no run (a lossless sieve). The stretches left are laid end to end as one array of
symbols; a symbol belongs to one stretch only, so nothing matches across stretches. On it:

1. Names of all factors of 2^k symbols, in order (level by level until all differ): the last level
   ranks the suffixes, and two names tell how far two places agree, forwards and backwards.
2. Lempel-Ziv blocks. For each block the squares whose first half ends in it and that are the
   first of their kind are found by their extensions at its two borders: a leftmost covering set.
3. From each square the suffix links are walked (drop its first word, add it at the end) as long
   as the text goes on: the vocabulary, each kind an interval of suffixes.
4. All suffixes of a kind's interval are its occurrences. Those of one period at successive
   places merge into runs. Squares of squares are left out, so a run's period is its smallest.

Defined results: a null text is empty and has no runs; equal rows have equal results each; an empty
table gives an empty table; other columns are carried whatever their names. Memory of a task grows
with the longest text, about 300 bytes a word of it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilframe.llm.common import grown, map_batches

#: Words of stretches that are worked on at once (a longer stretch goes alone).
GROUP = 1 << 17
#: Pairs of places that are compared at once.
QUERIES = 1 << 19


class Factors:
    """Names of all factors of 1, 2, 4, ... symbols, and the suffixes in order."""

    def __init__(self, x: np.ndarray) -> None:
        n = len(x)
        self.n, self.names = n, []
        name = np.unique(x, return_inverse=True)[1].astype(np.int64)
        size = 1
        while True:
            self.names.append(name.astype(np.int32))
            if n == 0 or name.max() == n - 1:
                break
            after = np.zeros(n, np.int64)
            after[: max(0, n - size)] = name[size:] + 1
            key = name * (n + 1) + after
            order = np.argsort(key, kind="stable")
            step = np.empty(n, np.int64)
            step[0] = 0
            step[1:] = key[order[1:]] != key[order[:-1]]
            name = np.empty(n, np.int64)
            name[order] = np.cumsum(step)
            size *= 2
        self.rank = self.names[-1]
        self.suffixes = np.empty(n, np.int32)
        self.suffixes[self.rank] = np.arange(n, dtype=np.int32)

    def forward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Symbols that agree from a and b (two different places) on."""
        at = np.zeros(len(a), np.int64)
        for k in range(len(self.names) - 2, -1, -1):
            i, j = a + at, b + at
            inside = np.maximum(i, j) + (1 << k) <= self.n
            inside[inside] = self.names[k][i[inside]] == self.names[k][j[inside]]
            at[inside] += 1 << k
        return at

    def backward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Symbols that agree up to a and b, these two included; places below 0 agree with nothing."""
        at = np.zeros(len(a), np.int64)
        for k in range(len(self.names) - 2, -1, -1):
            i, j = a - at - (1 << k) + 1, b - at - (1 << k) + 1
            inside = np.minimum(i, j) >= 0
            inside[inside] = self.names[k][i[inside]] == self.names[k][j[inside]]
            at[inside] += 1 << k
        return at


def blocks(f: Factors) -> np.ndarray:
    """Starts of the Lempel-Ziv blocks, and n: a block is the longest string that also begins at an
    earlier place, or one new symbol."""
    n, order = f.n, f.suffixes.tolist()
    before, after, stack = [-1] * n, [-1] * n, []
    for p in order:  # nearest suffixes in order, on both sides, that begin earlier
        while stack and stack[-1] > p:
            after[stack.pop()] = p
        before[p] = stack[-1] if stack else -1
        stack.append(p)
    longest = np.zeros(n, np.int64)
    for near in (before, after):
        other = np.array(near, np.int64)
        there = np.flatnonzero(other >= 0)
        for at in range(0, len(there), QUERIES):
            some = there[at : at + QUERIES]
            longest[some] = np.maximum(longest[some], f.forward(some, other[some]))
    starts, at, sizes = [], 0, np.maximum(longest, 1).tolist()
    while at < n:
        starts.append(at)
        at += sizes[at]
    return np.array([*starts, n], np.int64)


def _spread(starts: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All (index, 0 .. size-1) of the sizes, about QUERIES at once."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    for low in range(0, total, QUERIES):
        flat = np.arange(low, min(low + QUERIES, total))
        index = np.searchsorted(ends, flat, side="right")
        yield index, flat - (ends[index] - sizes[index])


def covering(f: Factors, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squares (place, period) among which is, for each kind of square, one at its first place or
    before that place in the same run."""
    h, h1, h2 = starts[:-2], starts[1:-1], starts[2:]
    h = np.append(h, starts[-2:-1]) if len(starts) > 1 else h
    h1, h2 = np.append(h1, starts[-1:]), np.append(h2, starts[-1:])
    first, places, periods = f.names[0], [], []

    def add(a: np.ndarray, b: np.ndarray, k: np.ndarray, border: np.ndarray) -> None:
        same = (np.maximum(a, b) < f.n) & (np.minimum(a, b) >= 0)
        same[same] = first[a[same]] == first[b[same]]
        a, b, k, border = a[same], b[same], k[same], border[same]
        on, back = f.forward(a, b), f.backward(a - 1, b - 1)
        low = np.minimum(a, b)
        start = np.maximum(low - back, low - k + 1)
        good = on + back >= k
        places.append(start[good])
        periods.append(k[good])

    for i, k in _spread(h, h1 - h):  # the second half reaches over the block's end
        k = k + 1
        add(h1[i], h1[i] - k, k, h1[i])
    for i, k in _spread(h, h2 - h):  # the first half reaches over the block's start
        k = k + 1
        add(h[i], h[i] + k, k, h[i])
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *places]), np.concatenate([none, *periods])


def _prime_divisors(k: int) -> list[int]:
    out, d = [], 2
    while d * d <= k:
        if k % d == 0:
            out.append(d)
            while k % d == 0:
                k //= d
        d += 1
    return [*out, k] if k > 1 else out


def primitive(f: Factors, places: np.ndarray, periods: np.ndarray) -> np.ndarray:
    """Whether each square's half is no repetition itself."""
    kinds, which = np.unique(periods, return_inverse=True)
    good = np.ones(len(places), bool)
    parts = [(i, int(k) // d) for i, k in enumerate(kinds) for d in _prime_divisors(int(k))]
    by_kind = np.argsort(which, kind="stable")
    ends = np.searchsorted(which[by_kind], np.arange(len(kinds) + 1))
    for i, q in parts:
        own = by_kind[ends[i] : ends[i + 1]]
        good[own] &= f.forward(places[own], places[own] + q) < kinds[i] - q
    return good


def squares(f: Factors, places: np.ndarray, periods: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All occurrences (place, period) of the kinds that walks from the given squares meet."""
    n = f.n
    # marks of one run share its end: one walk each, from the first mark on
    ends = places + periods + f.forward(places, places + periods)
    order = np.lexsort((places, ends, periods))
    places, periods, ends = places[order], periods[order], ends[order]
    new = np.ones(len(order), bool)
    new[1:] = (periods[1:] != periods[:-1]) | (ends[1:] != ends[:-1])
    places, periods, ends = places[new], periods[new], ends[new]
    walked = [(i, places[i] + j) for i, j in _spread(places, ends - 2 * periods - places + 1)]
    none = np.zeros(0, np.int64)
    index = np.concatenate([none, *[i for i, _ in walked]])
    at, q = np.concatenate([none, *[p for _, p in walked]]), periods[index]
    # a kind is an interval of suffixes that agree on 2q symbols: its first rank, found by halving
    common = np.zeros(n, np.int32)
    common[1:] = f.forward(f.suffixes[:-1].astype(np.int64), f.suffixes[1:].astype(np.int64))
    least = [common]  # least[k][r]: the least of common[r - 2^k + 1 .. r]
    while 2 ** len(least) <= n:
        half, last = 2 ** (len(least) - 1), least[-1]
        here = last.copy()
        here[half:] = np.minimum(last[half:], last[:-half])
        least.append(here)
    low, high = f.rank[at].astype(np.int64), f.rank[at].astype(np.int64)
    for k in range(len(least) - 1, -1, -1):
        down = low - (1 << k) >= 0
        down[down] = least[k][low[down]] >= 2 * q[down]
        low[down] -= 1 << k
        up = high + (1 << k) < n
        up[up] = least[k][high[up] + (1 << k)] >= 2 * q[up]
        high[up] += 1 << k
    kinds = np.unique(np.stack([q, low, high]), axis=1) if len(q) else np.zeros((3, 0), np.int64)
    q, low, high = kinds
    found = [(f.suffixes[low[i] + j].astype(np.int64), q[i]) for i, j in _spread(low, high - low + 1)]
    return np.concatenate([none, *[p for p, _ in found]]), np.concatenate([none, *[k for _, k in found]])


def runs(x: np.ndarray, least: int = 24, times: int = 3) -> list[tuple[int, int, int]]:
    """Runs (start, length, period) of an array of symbols, by start, then period."""
    if len(x) < least:
        return []
    f = Factors(x)
    places, periods = covering(f, blocks(f))
    if not len(places):
        return []
    good = primitive(f, places, periods)
    places, periods = squares(f, places[good], periods[good])
    order = np.lexsort((places, periods))
    places, periods = places[order], periods[order]
    new = np.ones(len(places), bool)
    new[1:] = (periods[1:] != periods[:-1]) | (places[1:] != places[:-1] + 1)
    firsts = np.flatnonzero(new)
    lasts = np.append(firsts[1:], len(places)) - 1
    start, period = places[firsts], periods[firsts]
    length = places[lasts] + 2 * period - start
    kept = (length >= least) & (length >= times * period)
    return sorted(zip(start[kept].tolist(), length[kept].tolist(), period[kept].tolist(), strict=True), key=lambda r: (r[0], r[2]))


def _stretches(ids: np.ndarray, owner: np.ndarray, least: int, times: int) -> Iterator[tuple[int, int]]:
    """Stretches (start, end) of the texts laid end to end that may hold a run, each inside one text."""
    gram = least - least // times
    n = len(ids) - gram + 1
    if n <= 1:
        return
    hashes = np.zeros(n, np.uint64)
    for j in range(gram):
        hashes = hashes * np.uint64(0x9E3779B97F4A7C15) + ids[j : j + n].astype(np.uint64)
    hashes = (hashes ^ (hashes >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + owner[:n].astype(np.uint64) * np.uint64(0x94D049BB133111EB)
    inside = np.flatnonzero(owner[:n] == owner[gram - 1 :])  # a string over two texts is none
    order = inside[np.argsort(hashes[inside], kind="stable")]
    same = hashes[order[1:]] == hashes[order[:-1]]
    marked = np.zeros(n, bool)
    marked[order[1:][same]] = True
    marked[order[:-1][same]] = True
    at = np.flatnonzero(marked)
    if not len(at):
        return
    # marks inside a run are never further apart than gram
    cut = np.flatnonzero((np.diff(at) > gram) | (np.diff(owner[at]) != 0))
    for a, b in zip(at[np.append(0, cut + 1)].tolist(), at[np.append(cut, len(at) - 1)].tolist(), strict=True):
        a, b = max(a - 1, 0), min(b + gram + 1, len(ids))  # with a word on each side, where there is one
        a, b = a + (owner[a] != owner[a + 1]), b - (owner[b - 1] != owner[b - 2])
        yield a, b


def runs_of(texts: list[list[bytes]], least: int = 24, times: int = 3) -> list[list[tuple[int, int, int]]]:
    """The runs of each text, given as words."""
    known: dict[bytes, int] = {}
    ids = np.array([known.setdefault(w, len(known)) for words in texts for w in words], np.int64)
    sizes = np.array([len(words) for words in texts], np.int64)
    owner, begin = np.repeat(np.arange(len(texts)), sizes), np.cumsum(sizes) - sizes
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]

    def work(group: list[tuple[int, int]]) -> None:
        which = np.repeat(np.arange(len(group)), [b - a for a, b in group])
        at = np.concatenate([np.arange(a, b) for a, b in group])
        # a symbol is a word of one stretch
        for start, length, period in runs(which * (len(known) + 1) + ids[at], least, times):
            a = int(at[start])
            out[owner[a]].append((a - int(begin[owner[a]]), length, period))

    group, held = [], 0
    for a, b in _stretches(ids, owner, least, times):
        if group and held + b - a > GROUP:
            work(group)
            group, held = [], 0
        group.append((a, b))
        held += b - a
    if group:
        work(group)
    return [sorted(found, key=lambda r: (r[0], r[2])) for found in out]


def without(words: list[bytes], found: list[tuple[int, int, int]]) -> bytes:
    """The words joined by one space, without those that a run holds after its first period."""
    if found:
        drop = np.zeros(len(words) + 1, np.int64)
        for start, length, period in found:
            drop[start + period] += 1
            drop[start + length] -= 1
        words = [w for w, d in zip(words, np.cumsum(drop).tolist(), strict=False) if not d]
    return b" ".join(words)


_RUNS = T.ArrayType(T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")]))


def collapse(docs: DataFrame, text: str = "text", least: int = 24, times: int = 3) -> DataFrame:
    """All columns of docs, runs (start, length, period in words, by start, then period) and
    collapsed: the words without those that a run repeats."""
    if times < 2 or least < 2:
        raise ValueError("a run holds its period twice at least, and two words")
    rest = [c for c in docs.columns if c != text]
    given = docs.select(F.col(f"`{text}`").alias("_text"), F.struct(*[F.col(f"`{c}`") for c in rest]).alias("_rest")) if rest else docs.select(F.col(f"`{text}`").alias("_text"))
    kind = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [(t.as_py() or b"").split() for t in batch["_text"].cast(pa.binary())]
            found = runs_of(texts, least, times)
            flat = np.array([r for one in found for r in one], np.int64).reshape(-1, 3)
            items = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(flat[:, i])) for i in range(3)], ["start", "length", "period"])
            offsets = pa.array(np.concatenate([[0], np.cumsum([len(one) for one in found])]), pa.int32())
            collapsed = pa.array([without(w, r) for w, r in zip(texts, found, strict=True)], pa.binary()).cast(pa.string())
            added = {"_runs": pa.ListArray.from_arrays(offsets, items).cast(kind), "_collapsed": collapsed}
            yield pa.RecordBatch.from_arrays([*batch.columns, *added.values()], [*batch.schema.names, *added])

    schema = grown(given.schema, _collapsed="string")
    schema = T.StructType([*given.schema.fields, T.StructField("_runs", _RUNS), schema["_collapsed"]])
    made = map_batches(given, run, schema)
    return made.select(
        *[F.col("_text").alias(c) if c == text else F.col(f"_rest.`{c}`").alias(c) for c in docs.columns],
        F.col("_runs").alias("runs"), F.col("_collapsed").alias("collapsed"),
    )
