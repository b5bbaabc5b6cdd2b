"""Repeats of crowded seeds: against brute force, and no bucket that grows with the documents."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute
import pytest

from veilframe.llm import suffix


def brute(table, length):
    least, out = {}, {}
    for k, b in table:
        for i in range(len(b) - length + 1):
            least[b[i : i + length]] = min(k, least.get(b[i : i + length], k))
    for k, b in table:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if least[b[i : i + length]] < k:
                gone[i : i + length] = b"\1" * length
        out[k] = bytes(c for c, g in zip(b, gone, strict=True) if not g)
    return out


def texts(n):
    rng = random.Random(8)
    passage = "the same passage of sixty bytes or more is in every document at hand"
    some = ["".join(rng.choices("abcdefgh ", k=40)) for _ in range(12)]
    table = []
    for i in range(n):
        head, tail = rng.choice(some), rng.choice(some)  # so that windows at the edges repeat too
        table.append((i, "".join(rng.choices("xyz", k=30)) + head + passage + tail + "".join(rng.choices("uvw", k=30))))
    table += [(n, "q" * 400), (n + 1, "r" + "q" * 300), (n + 2, "ab" * 200 + passage + "ab" * 90), (n + 3, "ab" * 150)]
    rng.shuffle(table)
    return table


@pytest.mark.parametrize("crowd", [1, 20])
@pytest.mark.parametrize("chunk", [1500, 1 << 20])
def test_crowded_seeds_against_brute_force(spark, monkeypatch, crowd, chunk):
    monkeypatch.setattr(suffix, "CROWD", crowd)
    monkeypatch.setattr(suffix, "CHUNK", chunk)
    monkeypatch.setattr(suffix, "BUCKET", 4000)
    table = texts(120)
    found = suffix.remove_repeats(spark.createDataFrame(table, "doc_id long, text string").repartition(3)).collect()
    assert {r.doc_id: bytes(r.kept) for r in found} == brute([(k, t.encode()) for k, t in table], 50)


def test_no_bucket_takes_all_edges_of_a_passage(monkeypatch):
    monkeypatch.setattr(suffix, "CROWD", 50)
    rng, buckets, length = random.Random(2), 64, 50
    passage = bytes(rng.choices(range(97, 123), k=200))
    sides = [bytes(rng.choices(range(65, 91), k=120)) for _ in range(1200)]
    documents = [a + passage + b for a, b in zip(sides[::2], sides[1::2], strict=True)]
    chunks, per = [], 50
    for c in range(0, len(documents), per):
        own = documents[c : c + per]
        block = pa.table({"key": pa.array(range(c, c + per), pa.int64())})
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, block.schema) as out:
            out.write_table(block)
        ends = np.cumsum([len(x) for x in own], dtype=np.int64)
        chunks.append({"chunk": c, "rest": suffix._zip(sink.getvalue().to_pybytes()), "ends": ends.tobytes(), "text": suffix._zip(*own)})
    sent = pa.Table.from_batches(suffix._send_seeds(length, buckets)(iter(pa.RecordBatch.from_pylist(chunks).slice(i, 1) for i in range(len(chunks)))))
    marks = {c["chunk"]: [] for c in chunks}
    for b in set(sent.column("bucket").to_pylist()):
        group = sent.filter(pa.compute.equal(sent.column("bucket"), b))
        for r in suffix._shared(group).to_pylist():
            if any(v is not None for k, v in r.items() if k not in ("chunk", "bucket")):
                marks[r["chunk"]].append({k: v for k, v in r.items() if k != "chunk"})
    held = Counter()
    for c in chunks:
        row = pa.RecordBatch.from_pylist([c | {"marks": marks[c["chunk"]]}])
        for made in suffix._send_runs(length, buckets)(iter([row])):
            for r in made.to_pylist():
                if r["bucket"] >= 0:
                    held[r["bucket"]] += int.from_bytes(suffix._unzip(r["runs"])[:8], "little")
    assert max(held.values()) < 0.1 * sum(held.values())


def test_only_windows_that_may_repeat_are_merged():
    rng = random.Random(3)
    word = lambda n: bytes(rng.choices(range(97, 123), k=n))
    seed, window = word(5), word(10)
    strings = [word(8) + seed + word(8) for _ in range(50)] + [word(4) + window + word(6), b"short", word(9) + window + b"x", window]
    parts, parent, base = suffix._alike(strings, 10)
    assert parts == [window] * 3 and parent.tolist() == [50, 52, 53] and base.tolist() == [4, 9, 0]
    assert suffix._alike(strings[:50], 10)[0] == [] and suffix._alike([b"short"], 10)[0] == [] and suffix._alike([], 10)[0] == []
    same = b"ab" * 8
    parts, parent, base = suffix._alike([same, word(20), same], 10)
    assert parts == [same, same] and parent.tolist() == [0, 2] and base.tolist() == [0, 0]


def test_a_chunk_sends_its_runs_in_one_batch(monkeypatch):
    rng = random.Random(4)
    text = bytes(rng.choices(range(97, 123), k=3000)) * 2
    sink = pa.BufferOutputStream()
    keys = pa.table({"_key": [1, 2]})
    with pa.ipc.new_stream(sink, keys.schema) as out:
        out.write_table(keys)
    row = {"chunk": 7, "rest": suffix._zip(sink.getvalue().to_pybytes()), "ends": np.array([3000, 6000]).tobytes(), "text": suffix._zip(text), "marks": None}
    batches = list(suffix._send_runs(50, 500)(iter([pa.RecordBatch.from_pylist([row])])))
    assert len(batches) == 1 and batches[0].num_rows > 50 and min(batches[0].column("bucket").to_pylist()) == -8
