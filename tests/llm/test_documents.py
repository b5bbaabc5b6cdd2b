"""The operators on documents against brute force, on small tables with awkward rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from math import log10

import numpy as np
import pytest
import xxhash

from veilframe.llm import bpe, exact, lm, mixing, quality, shards, simhash, suffix
from veilframe.llm.graph import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, score double, row string, idx long, _range long"


def rows():
    rng = random.Random(5)
    words = ["alpha", "Beta", "gàmma", "delta", "ÉPS", "zeta,", "eta", "x1", "🙂", "then"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 90))) for _ in range(60)]
    texts += [texts[0], texts[0], texts[1] + " tail", "head " + texts[1], texts[2].upper(), "", "", None, " \t\n ", "a", "word " * 3000]
    texts += ["y" * 200, "y" * 170, texts[3] + "\n" + texts[4], "a\x1cb a\xa0b", "\x00" * 60, "\x00" * 70]
    docs = [(i, t) for i, t in enumerate(texts)] + [(None, texts[5]), (None, None), (7, texts[7])]
    return [(k, t, "en", None if i % 7 == 0 else f"s{i % 5}", 1, 2, 0.5, "r", 1, 1) for i, (k, t) in enumerate(docs)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def closed(links, nodes):
    near = defaultdict(set)
    for a, b in links:
        near[a].add(b)
        near[b].add(a)
    found = {}
    for n in sorted(nodes):
        todo = [] if n in found else [n]
        while todo:
            m = todo.pop()
            if m not in found:
                found[m] = n
                todo += near[m]
    return found


def test_components(spark):
    rng = random.Random(1)
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 50)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(60)]
    found = components(spark.createDataFrame(links, "a long, b long"), "t").collect()
    expected = closed([x for x in links if x[0] != x[1]], {x for p in links if p[0] != p[1] for x in p})
    assert {r.node: r.component for r in found} == expected
    assert components(spark.createDataFrame([], "a long, b long"), "t").count() == 0


def plain_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in re.split("[ \t-\r]+", low) if w]
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))] if words else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprint_of_blocks(monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 7)
    text = " ".join(f"w{i % 13}" for i in range(100))
    assert simhash.fingerprint(text) == plain_fingerprint(text)


def test_anchors_cover_all_near_fingerprints():
    rng = np.random.default_rng(2)
    fp = rng.integers(0, 1 << 63, 200, dtype=np.uint64)
    other = fp.copy()
    for i in range(200):
        for b in rng.choice(64, i % 3, replace=False):
            other[i] ^= np.uint64(1) << np.uint64(b)
    row, anchor, home = simhash.anchors(fp, 2)
    homes = dict(zip(row[home].tolist(), anchor[home].tolist(), strict=True))
    row, anchor, _ = simhash.anchors(other, 2)
    at = defaultdict(set)
    for i, a in zip(row.tolist(), anchor.tolist(), strict=True):
        at[i].add(a)
    assert all(homes[i] in at[i] for i in range(200))


@pytest.mark.parametrize("cell", [2048, 3])
def test_simhash(spark, docs, empty, monkeypatch, cell):
    monkeypatch.setattr(simhash, "CELL", cell)
    found = [(r.doc_id, r.fp % (1 << 64), r.component) for r in simhash.near_duplicates(docs).collect()]
    own = [(k, plain_fingerprint(t)) for k, t, *_ in rows()]
    assert Counter((k, f) for k, f, _ in found) == Counter(own)
    keyed = [x for x in own if x[0] is not None]
    links = [(a, b) for a, f in keyed for b, g in keyed if a < b and (f ^ g).bit_count() <= 2]
    expected = closed(links, {k for k, _ in keyed})
    by_print = {f: expected[k] for k, f in keyed}
    assert all(c == (by_print.get(f) if k is None else expected[k]) for k, f, c in found)
    assert simhash.near_duplicates(empty).count() == 0


def test_simhash_homes_of_one_anchor_meet(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CELL", 16)
    # one home for all, as they differ in the last 18 bits only: pairs one bit apart, other texts four or more
    words = []
    for w in range(0, 1 << 16, 3):
        if len(words) < 100 and all((w ^ v).bit_count() > 3 for v in words):
            words.append(w)
    pairs = [(w << 46, w << 46 | 1 << 62) for w in words]
    fps = np.array([x for p in pairs for x in p], np.uint64).view(np.int64).tolist()
    nodes = spark.createDataFrame([(f, i) for i, f in enumerate(fps)], "fp long, node long")
    found = {tuple(sorted((r.a, r.b))) for r in simhash.linked(nodes).collect()}
    assert len(pairs) > 20 and found == {(2 * i, 2 * i + 1) for i in range(len(pairs))}


def test_simhash_counts_the_highest_bit(spark):
    base = 0x0123456789ABCDEF
    prints = [base, base ^ 1 << 63 ^ 1, base ^ 1 << 63 ^ 1 << 40 ^ 1 << 20]
    rows = [(p - (1 << 64) if p >> 63 else p, i) for i, p in enumerate(prints)]
    found = {tuple(sorted((r.a, r.b))) for r in simhash.linked(spark.createDataFrame(rows, "fp long, node long")).collect()}
    assert found == {(0, 1)}


def test_simhash_of_a_tight_ball(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CELL", 16)
    base = 0x0123456789ABCDEF
    prints = sorted({base ^ (1 << a) ^ (1 << b) for a in range(12) for b in range(12)})
    nodes = spark.createDataFrame([(p, i) for i, p in enumerate(prints)], "fp long, node long")
    found = {(r.a, r.b) for r in simhash.linked(nodes).collect()}
    assert all((prints[a] ^ prints[b]).bit_count() <= 2 for a, b in found)
    assert set(closed(found, range(len(prints))).values()) == {0}


def learned(spark):
    good = [(i, f"The quiet river number {i} flows on and on to the sea.", 1) for i in range(200)]
    bad = [(i + 1000, f"WIN!! CASH!! {i}$$$ NOW!! CLICK!! {i}###", 0) for i in range(200)]
    table = spark.createDataFrame(good + bad, "doc_id long, text string, quality int")
    return table, quality.learned(table, table.select("doc_id", "quality"))


def test_quality(spark, docs, empty):
    table, model = learned(spark)
    found = quality.score(table, model).where(quality.held_out()).collect()
    assert found and all((r.score >= 0.7) == (r.quality == 1) for r in found)
    assert {zlib.crc32(str(r.doc_id).encode()) % 4 for r in found} == {2}
    again = quality.score(docs, model)
    assert again.columns.count("score") == 1 and again.where("score between 0 and 1").count() == docs.count()
    assert quality.score(empty, model).count() == 0
    none = quality.train(empty, spark.createDataFrame([], "doc_id long, label int"))
    assert not none[0].any() and none[1] == 0


def test_quality_margin_is_the_product_of_features(monkeypatch):
    rng = np.random.default_rng(0)
    w = rng.normal(size=quality.SIZE)
    text = " ".join(rng.choice(["one", "Two", "three!", "4", "FIVE"], 300))
    slots, values = quality.features(text)
    monkeypatch.setattr(quality, "BLOCK", 37)
    assert quality.margin(text, w, 0.25) == pytest.approx(0.25 + w[slots] @ values)


def test_mixing(spark, docs, empty):
    found = mixing.mix(docs).collect()
    plain = Counter()
    for _, t, _, s, *_ in rows():
        plain[s] += len([w for w in re.split("[ \t-\r]+", t or "") if w])
    order = sorted((s for s in plain if s is not None)) + [None]
    weight = dict(zip(order, (5, 2, 1) * 3, strict=False))
    level, total = 0.0, sum(plain.values())
    for _ in range(20):
        full = [s for s in order if 3 * plain[s] <= weight[s] * level]
        level = (total - sum(3 * plain[s] for s in full)) / max(1, sum(weight[s] for s in order if s not in full))
    taken = Counter()
    for r in found:
        assert r.source_size == plain[r.source] and 0 <= r.copies <= 3
        assert r.target == pytest.approx(min(3 * plain[r.source], weight[r.source] * level))
        taken[r.source] += r.size * r.copies
    aims = {r.source: r.target for r in found}
    assert sum(aims.values()) == pytest.approx(total)
    assert all(abs(taken[s] - aims[s]) <= 10 for s in order)
    assert len(found) == docs.count() and set(docs.columns) <= set(found[0].asDict())
    assert sorted(map(str, found)) == sorted(map(str, mixing.mix(docs.repartition(5)).collect()))
    assert mixing.mix(empty).count() == 0


def test_mixing_balances_by_brute_force(spark):
    """The optimum's conditions hold for the rates, and what the mix takes stays near them."""
    from pyspark.sql import functions as F

    rng = random.Random(9)
    table = [(i, rng.randrange(5, 400) if i % 3 else rng.randrange(300, 3000), ("a", "b", "c", None)[i % 4 if i % 5 else 0]) for i in range(3000)]
    df = spark.createDataFrame(table, "doc_id long, words long, source string").withColumn("text", F.lit(""))
    sources = ["a", "b", "c", None]
    size = np.array([n for _, n, _ in table], float)
    of = np.array([sources.index(s) for *_, s in table])
    sums, weight, level = np.bincount(of, size), np.array([5, 2, 1, 5.0]), 0.0
    for _ in range(10):  # the excess over three times a source, shared again
        full = 3 * sums <= weight * level
        level = (size.sum() - 3 * sums[full].sum()) / weight[~full].sum()
    target = np.minimum(3 * sums, weight * level)
    rows = df.select(F.col("source").alias("own"), F.col("words").alias("size"))
    aims = mixing.targets(rows.groupBy(F.col("own").alias("source")).agg(F.sum("size").alias("source_size")))
    assert {r.source: r.target for r in aims.collect()} == pytest.approx(dict(zip(sources, target, strict=True)))
    tilts, lam = mixing.balanced(rows, mixing.usable(rows, aims))
    t = {r.source: r.t for r in tilts.collect()}
    assert set(t) == {s for s, f in zip(sources, full, strict=True) if not f}
    x = (np.log(size + 1) - 5) / 2
    r = np.array([min(np.exp(t[s] + lam * x[i]), 3) if s in t else 3.0 for i, (*_, s) in enumerate(table)])
    assert np.bincount(of, size * r) == pytest.approx(target, rel=1e-5)
    free = ~full[of]
    aim = (size * x)[free].sum() * target[~full].sum() / sums[~full].sum()
    assert abs((size * x * r)[free].sum() + mixing.RIDGE * size[free].sum() * lam - aim) < 1e-4 * size.sum()
    found = {d.doc_id: d.copies for d in mixing.mix(df, size="words").collect()}
    assert all(np.floor(r[i]) - 1 <= found[i] <= np.ceil(r[i]) + 1 for i in range(3000)) and max(found.values()) <= 3
    taken = np.bincount(of, size * np.array([found[i] for i in range(3000)]))
    assert abs(taken - target)[~full].max() <= 50 and (taken[full] == target[full]).all()


def test_mixing_stops_at_three_times_a_source(spark):
    table = spark.createDataFrame([(i, "w " * 10, "a" if i < 2 else "b") for i in range(100)], "doc_id long, text string, source string")
    found = mixing.mix(table).collect()
    assert {r.copies for r in found if r.source == "a"} == {3}


def test_shards(spark, docs, empty):
    found = shards.assign(docs, [1.0] * 10).collect()
    assert len(found) == docs.count()
    for r in found:
        assert 0 <= r.shard < 10 and r.grown_shard in (r.shard, 10)
    for s in range(10):
        slots = sorted(r.slot for r in found if r.shard == s)
        assert slots == list(range(len(slots)))
    grown = {r.doc_id: r.shard for r in shards.assign(docs, [1.0] * 11).collect()}
    assert all(grown[r.doc_id] == r.grown_shard for r in found)
    sizes = Counter((r.doc_id, r.size, r.text_crc32) for r in found)
    assert sizes == Counter((k, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for k, t, *_ in rows())
    heavy = Counter(r.shard for r in shards.assign(spark.range(4000).selectExpr("id AS doc_id", "'' AS text"), [3.0, 1.0]).collect())
    assert 2800 < heavy[0] < 3200
    assert shards.assign(empty, [1.0] * 3).count() == 0


def test_exact(spark, docs, empty):
    found = [(r.text, r.fingerprint) for r in exact.fingerprints(docs).collect()]
    assert all(f == exact.digest(exact.canonical(t)) for t, f in found)
    assert exact.canonical("Ｆｕｌｌ\u00a0 Straße\n") == exact.canonical("full strasse")
    assert exact.fingerprints(empty).count() == 0
    assert exact.edited_fingerprints(empty).count() == 0


def test_exact_tells_texts_with_one_digest_apart(spark, monkeypatch):
    table = spark.createDataFrame([(1, "x"), (2, "y"), (3, "x"), (4, "z")], "doc_id long, text string")
    one = spark.createDataFrame([(exact.digest(b"x"),)], "digest string")
    forms = exact.collisions(table, one).collect()
    assert forms == []
    clash = spark.createDataFrame([("d", "s1", 0), ("d", "s2", 1)], "digest string, sha256 string, place int")
    named = exact._named(spark.createDataFrame([("d", "s1"), ("d", "s2"), ("e", "s1")], "digest string, sha string"), clash, "digest", "sha", "fingerprint")
    assert sorted(r.fingerprint for r in named.collect()) == ["d", "d-1", "e"]


def test_edited_fingerprints(spark, docs):
    found = Counter((r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, r.near_edited, r.near_next) for r in exact.edited_fingerprints(docs).collect())
    line = sorted(((k, t or "") for k, t, *_ in rows()), key=lambda x: (x[0] is None, x[0] or 0))
    line = sorted(line, key=lambda x: (x[0] is None, x[0] or 0, x[1].encode()))
    expected = Counter()
    for i, (k, t) in enumerate(line):
        u = line[(i + 1) % len(line)][1]
        half = len(t) // 2
        edited = t[: len(t) - half] + u[:half]
        a, b, c = (exact.digest(exact.canonical(x)) for x in (t, edited, u))
        expected[k, len(t), hashlib.sha256(edited.encode()).hexdigest(), a, b, float(a == b), float(a == c)] += 1
    assert found == expected


@pytest.mark.parametrize("frequent", [1 << 17, 4])
def test_lm(spark, docs, empty, monkeypatch, frequent):
    monkeypatch.setattr(lm, "FREQUENT", frequent)
    found = Counter()
    for r in lm.scores(docs).collect():
        found[r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)] += 1
        assert r.score < 0
    held = {k: k is not None and zlib.crc32(str(k).encode()) % 5 == 1 for k, *_ in rows()}
    counts = Counter()
    for k, t, *_ in rows():
        if not held[k]:
            counts.update(lm.tokens(t))
    n, v = sum(counts.values()), len(counts)
    expected = Counter()
    for k, t, *_ in rows():
        own = lm.tokens(t)
        base = sum(log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in own)
        expected[k, held[k], len(own), sum(counts[w] > 0 for w in own), n, round(base, 4)] += 1
    assert found == expected
    assert lm.scores(empty).count() == 0


def test_lm_is_a_distribution(spark):
    table = spark.createDataFrame([(i, "a b c a b " * (i % 3 + 1)) for i in range(40)], "doc_id long, text string")
    words = lm.vocabulary(lm.counted(table))
    model = lm.train(table.selectExpr("text", "0 AS round"), words)
    context = np.zeros((lm.CLASSES, lm.CONTEXT), np.int64) + 2
    assert (10 ** model.log10(context, np.arange(lm.CLASSES))).sum() == pytest.approx(1, abs=1e-4)


def test_lm_beats_the_unigram_on_held_out_documents(spark):
    held = lm.scores(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).where("held_out").collect()
    assert sum(r.score for r in held) > 0.97 * sum(r.base_score for r in held)


def cut(table, length):
    least = {}
    for k, t in table:
        b, k = (t or "").encode(), suffix.NONE if k is None else k
        for i in range(len(b) - length + 1):
            least[b[i : i + length]] = min(k, least.get(b[i : i + length], suffix.NONE))
    out = Counter()
    for k, t in table:
        b, own = (t or "").encode(), suffix.NONE if k is None else k
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if least[b[i : i + length]] < own:
                gone[i : i + length] = b"\1" * length
        spans = len(re.findall(b"\1+", bytes(gone)))
        out[k, len(b), sum(gone), spans, bytes(c for c, g in zip(b, gone, strict=True) if not g)] += 1
    return out


@pytest.mark.parametrize("length", [50, 6])
def test_suffix(spark, docs, empty, length):
    found = suffix.remove_repeats(docs, length=length)
    assert set(docs.columns) - {"text"} <= set(found.columns)
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in found.collect())
    assert got == cut([(k, t) for k, t, *_ in rows()], length)
    assert suffix.remove_repeats(empty).count() == 0


@pytest.mark.parametrize("shard", [10, 90, 100_000])
def test_repeated_windows(shard):
    rng = random.Random(shard)
    strings = [bytes(rng.choice(b"ab\0c") for _ in range(rng.randrange(5, 20))) for _ in range(80)]
    keys = np.array([rng.randrange(10) for _ in strings])
    least = {}
    for s, k in zip(strings, keys.tolist(), strict=True):
        for i in range(len(s) - 4):
            least[s[i : i + 5]] = min(k, least.get(s[i : i + 5], 99))
    expected = {(j, i) for j, s in enumerate(strings) for i in range(len(s) - 4) if least[s[i : i + 5]] < keys[j]}
    found = suffix.repeated_windows(strings, keys, 5, shard)
    assert set(zip(*(x.tolist() for x in found), strict=True)) == expected


def test_bpe(spark, docs, empty):
    import public_tokenizers as P
    import tiktoken

    path = P.path("byte_bpe_50k.tiktoken")
    coder = bpe.coder(path, P.PATTERN)
    plain = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=coder.ranks, special_tokens={})
    coded = bpe.decode(bpe.encode(docs.withColumn("own", docs["text"]), path, P.PATTERN), path, P.PATTERN).collect()
    assert len(coded) == docs.count()
    for r in coded:
        assert np.frombuffer(r.token_ids, "<u4").tolist() == plain.encode_ordinary(r.own or "")
        assert bytes(r.decoded) == (r.own or "").encode()
    both = bpe.round_trip(docs.withColumn("own", docs["text"]), path, P.PATTERN).drop("text").collect()
    assert sorted((r.token_ids, r.decoded) for r in both) == sorted((r.token_ids, r.decoded) for r in coded)
    rng = random.Random(2)
    hard = ["ab" * 5000, "a" * 3000, "<|endoftext|>", "\u0345 \x85\x1c", "é" * 999, "日本語" * 300, "🙂" * 200, " " * 2000, None, ""]
    hard += ["".join(rng.choices("etaoinshrdlu", k=k)) for k in (3, 50, 700, 9000)] + ["".join(rng.choices("abc é\n", k=3000))]
    for many in (hard, *([x] for x in hard), []):  # one queue for all, and alone
        made = coder.encode(many)
        assert [np.frombuffer(x, "<u4").tolist() for x in made] == [plain.encode_ordinary(x or "") for x in many]
        assert coder.decode(made) == [(x or "").encode() for x in many]


def test_bpe_in_small_slices_with_little_memory(monkeypatch):
    import public_tokenizers as P

    whole, rng = bpe.Coder(P.path("byte_bpe_50k.tiktoken"), P.PATTERN), random.Random(3)
    texts = ["".join(rng.choices("abcdefgh ", k=rng.randrange(300))) for _ in range(80)]
    expected = whole.encode(texts)
    for name, value in (("SLICE", 100), ("BLOCK", 7), ("REMEMBERED", 20), ("LONGEST", 4)):
        monkeypatch.setattr(bpe, name, value)
    small = bpe.Coder(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    assert small.encode(texts) == expected
    assert small.decode(expected) == [x.encode() for x in texts]
    assert max(map(len, small.known)) <= 4


def test_bpe_of_no_rows(empty):
    import public_tokenizers as P

    path = P.path("byte_bpe_50k.tiktoken")
    assert bpe.digests(empty, path, P.PATTERN).count() == 0
