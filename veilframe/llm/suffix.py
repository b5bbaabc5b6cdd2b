"""Suffix-array dedup: removal of bytes that a long string repeats from an earlier document.

A byte goes if a string of `length` bytes that covers it also starts in a document with a
smaller id. What is left is judged on the input, never on earlier removals.

Steps, each a Spark job over tables keyed by chunk (about one MB of packed documents) or by
bucket of a hash:

1. pack      documents become compressed chunks, so that a text moves as few large rows.
2. seeds     a window of `length` bytes is named by the smallest hash of the SEED-byte strings
             inside it. Equal windows have equal seeds, so a window whose seed occurs in one
             document only cannot repeat. Chunks send their distinct seeds (6 bytes each) to
             buckets and get back one bit for each.
3. runs      maximal runs of windows with one repeated seed become short strings, sent to the
             seed's bucket. Equal windows meet there, whichever documents they come from. A
             crowded seed (CROWD runs or more in all chunks) would make its bucket grow with
             the documents, so its runs are sent window by window instead, each window to the
             bucket of its own hash. All chunks know the same crowded seeds, so equal windows
             still meet.
4. merge     in a bucket, equal strings become one. Of the others only parts stay whose windows
             have a hash twice: seeds that two texts share by chance grow with the input, windows
             far less. What stays is dealt into shards; each
             shard gets its suffix array and Burrows-Wheeler transform, and the transforms
             are merged by interleave refinement: the order by k + 1 bytes comes from the
             order by k bytes in one stable distribution of the transforms' bytes, and where a
             class of equal prefixes splits, so does the class of what precedes it. After
             `length` rounds the classes are the intervals of common prefix `length`: the
             repeated windows, found without sorting suffixes of different shards again.
5. remove    intervals go back to their chunks, which cut the bytes.

Frequent lines or passages: equal runs of a chunk count once before they are sent, which holds
for runs inside a passage. Runs at its edges also hold the bytes around it and differ by
document; their seeds are crowded, so their windows are spread over all buckets. A window
reaches its bucket once for each chunk.
Null ids count as larger than all others; equal ids don't remove each other's bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.llm.common import grown, map_batches, release, stage

#: Bytes of packed text in a chunk, of text for each bucket, of strings in a shard.
CHUNK, BUCKET, SHARD = 1 << 20, 1 << 21, 1 << 17
#: Bytes of strings that are merged at a time (more only where they all share one seed).
MERGED = 1 << 19
#: Runs of one seed from which its windows are spread. Counts of a chunk stop at 255, so a seed
#: below CROWD has runs in fewer than CROWD / 255 chunks with more.
CROWD = 4096
#: Length of a seed as a share of the window's.
SEED_SHARE = 0.5
NONE = (1 << 63) - 1


def _zip(*parts: np.ndarray | bytes) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(b"".join(p.tobytes() if isinstance(p, np.ndarray) else p for p in parts))


def _unzip(b: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(b)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (chunk, n_bytes, rest, ends, text) of input rows (key, text, others): texts joined,
    where each ends, and the other columns as one Arrow block."""
    task, made, texts, rows, held = TaskContext.get().partitionId(), 0, [], [], 0

    def chunk():
        rest = pa.Table.from_batches(rows).combine_chunks()
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, rest.schema) as out:
            out.write_table(rest)
        ends = np.cumsum([len(x) for x in texts], dtype=np.int64)
        return pa.RecordBatch.from_arrays(
            [pa.array([task << 32 | made]), pa.array([held]), pa.array([_zip(sink.getvalue().to_pybytes())], pa.binary()),
             pa.array([ends.tobytes()], pa.binary()), pa.array([_zip(*texts)], pa.binary())],
            ["chunk", "n_bytes", "rest", "ends", "text"],
        )

    for batch in batches:
        rest, first = batch.select([i for i in range(batch.num_columns) if i != 1]), 0
        for i, text in enumerate(batch.column(1)):
            texts.append((text.as_py() or "").encode())
            held += len(texts[-1])
            if held >= CHUNK or i + 1 == batch.num_rows:
                rows.append(rest.slice(first, i + 1 - first))
                first = i + 1
            if held >= CHUNK:
                yield chunk()
                texts, rows, held, made = [], [], 0, made + 1
    if texts:
        yield chunk()


def _rest(row: dict) -> pa.Table:
    return pa.ipc.open_stream(_unzip(row["rest"])).read_all()


def _opened(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A chunk's bytes, its documents' keys and ends."""
    keys = _rest(row).column(0).fill_null(NONE).to_numpy()
    return np.frombuffer(_unzip(row["text"]), np.uint8), keys, np.frombuffer(row["ends"], np.int64)


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    for i in range(batch.num_rows):
        yield {k: batch.column(k)[i].as_py() for k in batch.schema.names}


def _hashes(text: np.ndarray, k: int) -> np.ndarray:
    """A hash of each string of k bytes in text, which is k bytes or longer."""
    base = 0x9E3779B97F4A7C15

    def joined(a, b, lb):
        m = len(b) - (len(text) - len(a) + 1)
        return a[:m] * np.uint64(pow(base, lb, 1 << 64)) + b[len(b) - m :]

    power, size = text.astype(np.uint64) + np.uint64(1), 1
    whole = None
    while True:
        if k & size:
            whole = power if whole is None else joined(whole, power, size)
        if size * 2 > k:
            break
        power, size = joined(power, power, size), size * 2
    h = whole ^ (whole >> np.uint64(31))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    return h


def _seeds(text: np.ndarray, ends: np.ndarray, length: int) -> np.ndarray:
    """For each window start the seed's hash; 0 where the window leaves its document."""
    n, k = len(text), max(1, int(length * SEED_SHARE))
    if n < length:
        return np.zeros(0, np.uint64)
    h = _hashes(text, k)
    h |= np.uint64(1)
    w, have = length - k + 1, 1  # the least of w hashes
    while have * 2 <= w:
        h = np.minimum(h[:-have], h[have:])
        have *= 2
    if have < w:
        h = np.minimum(h[: len(h) - (w - have)], h[w - have :])
    h = h[: n - length + 1]
    for end in ends[:-1].tolist():
        h[max(0, end - length + 1) : end] = 0
    return h


def _runs(seeds: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (of window starts) of runs of one seed, at most `most` long."""
    if not len(seeds):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts = np.flatnonzero(np.concatenate(([True], seeds[1:] != seeds[:-1])))
    ends = np.concatenate((starts[1:], [len(seeds)]))
    keep = seeds[starts] != 0
    starts, ends = starts[keep], ends[keep]
    parts = -(-(ends - starts) // most)
    first = np.repeat(starts, parts) + most * (np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts))
    return first, np.minimum(first + most, np.repeat(ends, parts))


def _bucket(seeds: np.ndarray, buckets: int) -> np.ndarray:
    return ((seeds >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _in_use(bucket: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """The distinct values of sorted bucket numbers, and where each begins; at last the end."""
    some, first = np.unique(bucket, return_index=True)
    return some, [*first.tolist(), len(bucket)]


def _once(seeds: np.ndarray, ends: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The chunk's distinct seeds in order, whether two of its documents have each, and how
    many runs have it (255: or more)."""
    at, _ = _runs(seeds, 1 << 40)
    doc = np.searchsorted(ends, at, "right")
    order = np.lexsort((doc, seeds[at]))
    found, doc = seeds[at][order], doc[order]
    new = np.concatenate(([True], found[1:] != found[:-1])) if len(found) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    last = np.concatenate((first[1:], [len(found)])) - 1
    runs = np.minimum(last - first + 1, 255).astype(np.uint8)
    return found[first], doc[first] != doc[last] if len(first) else np.zeros(0, bool), runs


def _send_seeds(length: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _rows(batch):
                text, _, ends = _opened(row)
                found, _, runs = _once(_seeds(text, ends, length), ends, length)
                some, cut = _in_use(_bucket(found, buckets))  # sorted by seed, so by bucket
                seven = np.ascontiguousarray(found).view(np.uint8).reshape(-1, 8)[:, :7].copy()  # the low 48 bits
                seven[:, 6] = runs
                yield pa.RecordBatch.from_arrays(
                    [pa.array(some), pa.array(np.full(len(some), row["chunk"])),
                     pa.array([seven[a:b].tobytes() for a, b in zip(cut, cut[1:], strict=False)], pa.binary())],
                    ["bucket", "chunk", "seeds"],
                )

    return run


def _shared(group: pa.Table) -> pa.Table:
    """For each chunk's seeds in a bucket two bits: another chunk has it too; it is crowded."""
    blobs = group.column("seeds").to_pylist()
    sizes = [len(b) // 7 for b in blobs]
    seven = np.frombuffer(b"".join(blobs), np.uint8).reshape(-1, 7)
    wide = np.zeros((sum(sizes), 8), np.uint8)
    wide[:, :6] = seven[:, :6]
    _, inverse, counts = np.unique(wide.view(np.uint64).ravel(), return_inverse=True, return_counts=True)
    crowd = np.bincount(inverse, seven[:, 6], len(counts)) >= CROWD

    def packed(flags: np.ndarray) -> pa.Array:
        parts = np.split(flags[inverse], np.cumsum(sizes)[:-1])
        return pa.array([np.packbits(x).tobytes() if x.any() else None for x in parts], pa.binary())

    return pa.table([group.column("chunk"), group.column("bucket"), packed(counts > 1), packed(crowd)], ["chunk", "bucket", "bits", "crowd"])


def _spread(raw: bytes, first: np.ndarray, last: np.ndarray, key: np.ndarray, length: int) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct windows of runs (from, to, key), with hash, a smallest key and a place that has
    it; and the places of windows with larger keys than the smallest one here."""
    import xxhash

    size = last - first
    at = np.repeat(first, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    key = np.repeat(key, size)
    order = np.argsort(key, kind="stable")
    at, key = at[order], key[order]
    pieces = [raw[a : a + length] for a in at.tolist()]
    seen: dict[bytes, int] = {}
    holder = np.fromiter((seen.setdefault(p, j) for j, p in enumerate(pieces)), np.int64, len(pieces))
    later = key > key[holder]
    sent = np.flatnonzero(~later)  # also the holder's document's other copies, judged alike
    pieces = [pieces[j] for j in sent.tolist()]
    own = np.fromiter(map(xxhash.xxh64_intdigest, pieces), np.uint64, len(pieces))
    return pieces, own, key[sent], at[sent], at[later]


def _send_runs(length: int, buckets: int):
    """Rows (bucket, chunk, runs) for buckets; with a bucket below 0 the intervals (from,
    bytes) that the chunk finds by itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            for row in _rows(batch):
                text, keys, ends = _opened(row)
                seeds = _seeds(text, ends, length)
                found, repeated, _ = _once(seeds, ends, length)
                crowded = np.zeros(len(found), bool)
                some, cut = _in_use(_bucket(found, buckets))
                of = dict(zip(some.tolist(), zip(cut, cut[1:], strict=False), strict=True))
                for mark in row["marks"] or ():
                    a, b = of[mark["bucket"]]
                    for flags, bits in ((repeated, mark["bits"]), (crowded, mark["crowd"])):
                        if bits is not None:
                            flags[a:b] |= np.unpackbits(np.frombuffer(bits, np.uint8), count=b - a).astype(bool)
                first, last = _runs(seeds, length)
                keep = np.isin(seeds[first], found[repeated])
                first, last = first[keep], last[keep]
                own, doc = seeds[first], np.searchsorted(ends, first, "right")
                raw, size = text.tobytes(), last - first + length - 1
                seen: dict[bytes, int] = {}
                pieces = [raw[a : a + n] for a, n in zip(first.tolist(), size.tolist(), strict=True)]
                for j in np.argsort(keys[doc], kind="stable").tolist():  # the smallest id has it first
                    seen.setdefault(pieces[j], j)
                holder = np.fromiter(map(seen.__getitem__, pieces), np.int64, len(pieces))
                later = keys[doc] > keys[doc[holder]] if len(doc) else np.zeros(0, bool)
                cuts = [(first[later], size[later])]
                # equal strings of the holder's own document are judged like the holder's
                sent, key = np.flatnonzero(~later), keys[doc]
                hot = np.isin(own[sent], found[crowded])
                if hot.any():
                    p = sent[hot]
                    copy = p != holder[p]  # the holder's document again: cut as the holder's is
                    cuts.append((first[p[copy]], -1 - (first[holder[p[copy]]] << 16 | last[p[copy]] - first[p[copy]])))
                    p = p[~copy]
                    windows, name, least, at, gone = _spread(raw, first[p], last[p], key[p], length)
                    cuts.append((gone, np.full(len(gone), length)))
                    sent = np.concatenate((sent[~hot], len(pieces) + np.arange(len(windows))))
                    pieces += windows
                    own, key, first = (np.concatenate(x) for x in ((own, name), (key, least), (first, at)))
                    size = np.concatenate((size, np.full(len(windows), length)))
                gone, span = (np.concatenate(x) for x in zip(*cuts, strict=True))
                to, sent_runs = [], []
                if len(gone):  # a group of its own, which is passed on as it is
                    to.append(-1 - row["chunk"])
                    sent_runs.append(_zip(gone, span))
                sent = sent[np.argsort(own[sent], kind="stable")]  # by seed, so by bucket
                some, cut = _in_use(_bucket(own[sent], buckets))
                for b, start, stop in zip(some.tolist(), cut, cut[1:], strict=False):
                    p = sent[start:stop]
                    table = _planes(own[p].astype(np.uint32), key[p], first[p].astype(np.uint32), size[p].astype(np.uint16))
                    to.append(b)
                    sent_runs.append(pack.compress(b"".join([len(p).to_bytes(8, "little"), *table, *[pieces[j] for j in p.tolist()]])))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(to, pa.int64()), pa.array(np.full(len(to), row["chunk"])), pa.array(sent_runs, pa.binary())],
                    ["bucket", "chunk", "runs"],
                )

    return run


def _planes(*columns: np.ndarray) -> list[bytes]:
    """Columns with their first bytes together, then their second ones and so on, which
    compresses better."""
    return [np.ascontiguousarray(c.view(np.uint8).reshape(len(c), -1).T).tobytes() for c in columns]


def _columns(raw: bytes, at: int, n: int, *kinds: str) -> tuple[list[np.ndarray], int]:
    out = []
    for kind in kinds:
        width = np.dtype(kind).itemsize
        planes = np.frombuffer(raw, np.uint8, n * width, at).reshape(width, n)
        out.append(np.ascontiguousarray(planes.T).view(kind).ravel())
        at += n * width
    return out, at


def _judge(length: int):
    """Rows (chunk, cuts) with the intervals to remove that a bucket's runs give."""

    def run(group: pa.Table) -> pa.Table:
        if group.column("bucket")[0].as_py() < 0:
            return group.select(["chunk", "runs"]).rename_columns(["chunk", "cuts"])
        strings, tables, chunks, unpack = [], [], [], zstandard.ZstdDecompressor()
        for chunk, blob in zip(group.column("chunk").to_pylist(), group.column("runs"), strict=True):
            raw = unpack.decompress(blob.as_py())
            n = int.from_bytes(raw[:8], "little")
            columns, at = _columns(raw, 8, n, "u4", "i8", "u4", "u2")
            tables.append(columns)
            ends = np.cumsum(columns[3], dtype=np.int64) + at
            strings += [raw[e - m : e] for e, m in zip(ends.tolist(), columns[3].tolist(), strict=True)]
            chunks.append(np.full(n, chunk))
        seed, key, start, size = (np.concatenate(x) for x in zip(*tables, strict=True))
        start, size, chunk = start.astype(np.int64), size.astype(np.int64), np.concatenate(chunks)
        number: dict[bytes, int] = {}
        which = np.fromiter((number.setdefault(s, len(number)) for s in strings), np.int64, len(strings))
        least = np.full(len(number), NONE)
        np.minimum.at(least, which, key)
        again = key > least[which]
        out = [(chunk[again], start[again], size[again])]
        seed_of = np.empty(len(number), np.uint32)
        seed_of[which] = seed
        _, inverse, counts = np.unique(seed_of, return_inverse=True, return_counts=True)
        met = np.flatnonzero(counts[inverse] > 1)  # strings that share a seed with another string
        if len(met):
            distinct = list(number)
            met = met[np.argsort(seed_of[met], kind="stable")]
            ends = np.cumsum([len(distinct[i]) for i in met.tolist()])
            last = np.flatnonzero(np.append(seed_of[met][1:] != seed_of[met][:-1], True))  # of each seed
            part = np.unique(last[np.append(np.flatnonzero(np.diff(ends[last] // MERGED)), len(last) - 1)]) + 1
            found = []
            for i, j in zip([0, *part[:-1].tolist()], part.tolist(), strict=True):  # equal windows share a seed
                own = met[i:j]
                parts, parent, base = _alike([distinct[k] for k in own.tolist()], length)
                if not parts:
                    continue
                which_, offset = repeated_windows(parts, least[own[parent]], length)
                found.append((own[parent[which_]], base[which_] + offset))
            nothing = np.zeros(0, np.int64)
            string, offset = (np.concatenate(x) for x in zip((nothing, nothing), *found, strict=True))
            order = np.lexsort((offset, string))
            string, offset = string[order], offset[order]
            first = np.concatenate(([True], (string[1:] != string[:-1]) | (offset[1:] > offset[:-1] + 1)))[: len(string)]
            at = np.flatnonzero(first)
            span = offset[np.concatenate((at[1:], [len(string)])) - 1] - offset[at] + length if len(at) else at
            by = np.searchsorted(string[at], np.arange(len(number) + 1))
            own = np.flatnonzero(~again)
            n = by[which[own] + 1] - by[which[own]]
            row = np.repeat(own, n)
            k = np.repeat(by[which[own]], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            out.append((chunk[row], start[row] + offset[at][k], span[k]))
        chunk, start, size = (np.concatenate(x) for x in zip(*out, strict=True))
        order = np.argsort(chunk, kind="stable")
        chunk, start, size = chunk[order], start[order].astype(np.int64), size[order].astype(np.int64)
        found, cut = np.unique(chunk, return_index=True)
        cut = [*cut.tolist(), len(chunk)]
        cuts = [_zip(start[a:b], size[a:b]) for a, b in zip(cut, cut[1:], strict=False)]
        release()
        return pa.table([pa.array(found, pa.int64()), pa.array(cuts, pa.binary())], ["chunk", "cuts"])

    return run


def _alike(strings: list[bytes], length: int) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The parts of strings whose windows have a hash that another window has too, each with
    its string and its place there. Equal windows have equal hashes, so no other part can repeat."""
    raw = b"".join(strings)
    if len(raw) < length:
        return [], np.zeros(0, np.int64), np.zeros(0, np.int64)
    ends = np.cumsum([len(s) for s in strings])
    inside = np.ones(len(raw) - length + 1, bool)  # windows that end in their own string
    delta = np.zeros(len(raw) + 1, np.int64)
    np.add.at(delta, np.maximum(ends - length + 1, np.concatenate(([0], ends[:-1]))), 1)
    np.subtract.at(delta, ends, 1)
    inside &= np.cumsum(delta)[: len(inside)] == 0
    at = np.flatnonzero(inside)
    h = _hashes(np.frombuffer(raw, np.uint8), length)[at]
    order = np.argsort(h)
    same = h[order][1:] == h[order][:-1]
    again = np.zeros(len(at), bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    at = at[again]
    string = np.searchsorted(ends, at, "right")
    first = np.concatenate(([True], (at[1:] > at[:-1] + 1) | (string[1:] != string[:-1])))[: len(at)]
    begin = at[first]
    last = at[np.append(first[1:], True)[: len(at)]]
    parent = string[first]
    starts = np.concatenate(([0], ends[:-1]))
    return [raw[a : b + length] for a, b in zip(begin.tolist(), last.tolist(), strict=True)], parent, begin - starts[parent]


def transform(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array and Burrows-Wheeler transform of strings with an end mark 0 after each
    (their own bytes are 1 or more). Suffixes are compared on as many bytes as the longest
    string has; equal ones are in one class of the merge whatever their order."""
    text = np.frombuffer(b"\0".join([*strings, b""]), np.uint8)
    deep = max(map(len, strings)) + 1
    wide = np.concatenate((text, np.zeros(deep, np.uint8)))
    order = np.argsort(np.ndarray((len(text),), f"S{deep}", wide, 0, (1,)), kind="stable")
    return order.astype(np.int32), text[order - 1]


def merged(transforms: list[np.ndarray], length: int) -> tuple[np.ndarray, np.ndarray]:
    """The interleave of sorted transforms, and for each place the class of equal prefixes of
    `length` bytes (numbered in order)."""
    sizes = [len(t) for t in transforms]
    source = np.repeat(np.arange(len(sizes), dtype=np.uint16), sizes)
    given = np.concatenate(transforms)
    classes = np.zeros(len(given), np.int32)
    for _ in range(length):
        byte = np.empty_like(given)
        byte[np.argsort(source, kind="stable")] = given  # each transform is read in its own order
        moved = np.argsort(byte, kind="stable")
        source, byte, above = source[moved], byte[moved], classes[moved]
        new = (byte[1:] != byte[:-1]) | (above[1:] != above[:-1])
        classes = np.concatenate(([0], np.cumsum(new, dtype=np.int32)))
    return source, classes


#: Moves every byte up by one, which frees 0 for the end mark; UTF-8 has no byte 0xFF.
UP = bytes([*range(1, 256), 255])


def repeated_windows(strings: list[bytes], keys: np.ndarray, length: int, shard: int = SHARD) -> tuple[np.ndarray, np.ndarray]:
    """(string, offset) of windows of `length` bytes that also occur in a string with a smaller key."""
    strings = [s.translate(UP) for s in strings]
    at, shards, held = 0, [], 0
    for i, s in enumerate(strings):
        held += len(s) + 1
        if held >= shard or i + 1 == len(strings):
            shards.append((at, i + 1))
            at, held = i + 1, 0
    transforms, owner, offset = [], [], []
    for a, b in shards:
        own = strings[a:b]
        order, bwt = transform(own)
        sizes = np.array([len(s) + 1 for s in own], np.int32)
        starts = np.cumsum(sizes, dtype=np.int32) - sizes
        which = np.repeat(np.arange(a, b, dtype=np.int32), sizes)
        transforms.append(bwt)
        owner.append(which[order])
        offset.append(order - starts[which[order] - a])
    source, classes = merged(transforms, length)
    place = np.argsort(source, kind="stable")
    string, start, group = np.concatenate(owner), np.concatenate(offset), classes[place]
    full = start + length <= np.array([len(s) for s in strings])[string]
    string, start, group = string[full], start[full], group[full]
    least = np.full(len(classes), NONE)
    np.minimum.at(least, group, keys[string])
    later = keys[string] > least[group]
    return string[later], start[later]


def _flags(n: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Which of n places lie in one of the intervals."""
    delta = np.zeros(n + 1, np.int64)
    np.add.at(delta, start, 1)
    np.subtract.at(delta, end, 1)
    return np.cumsum(delta[:-1]) > 0


def _gone(n: int, start: np.ndarray, size: np.ndarray, length: int) -> np.ndarray:
    """Which of n bytes go. A negative size is -1 - (from << 16 | count): the windows at start
    go where those at from do, whose bytes and document are the same."""
    copy = size < 0
    same, start, size = -1 - size[copy], np.append(start[~copy], start[copy]), size[~copy]
    own, start = start[len(size) :], start[: len(size)]
    if not len(same):
        return _flags(n, start, start + size)
    windows = _flags(n, start, start + size - length + 1)
    count = same & 0xFFFF
    step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    at, to = np.repeat(same >> 16, count) + step, np.repeat(own, count) + step
    windows[to[windows[at]]] = True
    begin = np.flatnonzero(windows)
    return _flags(n, begin, begin + length)


def _cut(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _rows(batch):
                text, ends = np.frombuffer(_unzip(row["text"]), np.uint8), np.frombuffer(row["ends"], np.int64)
                blobs = [np.frombuffer(_unzip(blob), np.int64).reshape(2, -1) for blob in row["cuts"] or ()]
                start, size = np.concatenate(blobs, axis=1) if blobs else np.zeros((2, 0), np.int64)
                gone = _gone(len(text), start, size, length)
                begin = np.concatenate(([0], ends[:-1]))
                opens = gone.copy()
                opens[1:] &= ~gone[:-1]
                opens[begin[begin < len(text)]] = gone[begin[begin < len(text)]]
                total, spans = (np.concatenate(([0], np.cumsum(x))) for x in (gone, opens))
                kept, left = text[~gone].tobytes(), ends - total[ends]
                parts = [kept[a:b] for a, b in zip([0, *left[:-1].tolist()], left.tolist(), strict=True)]
                rest = _rest(row)
                columns = [c.combine_chunks() for c in rest.columns[1:]]
                made = [pa.array(ends - begin), pa.array(total[ends] - total[begin]), pa.array(spans[ends] - spans[begin]), pa.array(parts, pa.binary())]
                yield pa.RecordBatch.from_arrays([*columns, *made], [*rest.schema.names[1:], "n_bytes", "n_removed", "n_spans", "kept"])

    return run


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = 50) -> DataFrame:
    """docs without the text, with n_bytes, n_removed, n_spans (long) and kept (binary: the
    bytes of the text that stay).

    A null text is empty. A null key counts as larger than all others; rows with equal keys
    don't remove each other's bytes. Texts shorter than `length` stay whole. Other columns are
    carried, but those with the four names above are replaced. An empty table gives an empty
    table."""
    rest = [c for c in docs.columns if c not in (text, "n_bytes", "n_removed", "n_spans", "kept")]
    plain = docs.select(F.col(key).cast("long").alias("_key"), F.col(text).cast("string").alias("_text"), *rest)
    chunks = stage(map_batches(plain, _pack, "chunk long, n_bytes long, rest binary, ends binary, text binary"), "chunks")
    total = chunks.agg(F.sum("n_bytes")).first()[0] or 0
    buckets = max(1, -(-total // BUCKET))
    marks = (
        map_batches(chunks, _send_seeds(length, buckets), "bucket long, chunk long, seeds binary")
        .groupBy("bucket")
        .applyInArrow(_shared, "chunk long, bucket long, bits binary, crowd binary")
        .where("bits is not null or crowd is not null")
        .groupBy("chunk")
        .agg(F.collect_list(F.struct("bucket", "bits", "crowd")).alias("marks"))
    )
    runs = map_batches(chunks.join(marks, "chunk", "left"), _send_runs(length, buckets), "bucket long, chunk long, runs binary")
    judged = runs.groupBy("bucket").applyInArrow(_judge(length), "chunk long, cuts binary")
    cuts = judged.groupBy("chunk").agg(F.collect_list("cuts").alias("cuts"))
    schema = grown(docs.select(*rest).schema, n_bytes="long", n_removed="long", n_spans="long", kept="binary")
    return map_batches(chunks.join(cuts, "chunk", "left"), _cut(length), schema)
