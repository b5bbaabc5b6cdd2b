"""Each stage of the pipeline against a plain version, on rows with nulls, repeats, ties and clashing columns."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from test_copies import plain_set, similar

import corpus_pipeline as P
from veilframe.llm import mixing, quality

SF = "/root/testdata/sf0.001"
SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, own string, kept string, copies int, score double, "
    "row string, size long, part long, n long, key string, _others string"
)


def table():
    rng = random.Random(11)
    words = [f"w{i}" for i in range(900)]
    texts = [" ".join(rng.choices(words, k=rng.randrange(5, 120))) for _ in range(50)]
    texts += [texts[0], texts[0] + " more", texts[1].upper(), "", None, " ", "é" * 40 + texts[2], "�\x01b " + texts[3], "x " * 2000]
    rows = [(i, t) for i, t in enumerate(texts)]
    rows += [(7, "an unrelated text of the same id"), (7, texts[7]), (7, texts[7]), (None, texts[5]), (None, "no other has this"), (None, None)]
    return [(k, t, "en", None if i % 6 == 0 else f"s{i % 4}", len(t or ""), "OWN", "KEPT", 9, 0.5, "ROW", 1, 2, 3, "KEY", "O") for i, (k, t) in enumerate(rows)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(table(), SCHEMA).repartition(3)


def others(rows):
    """Columns that no stage may touch."""
    assert {(r.own, r.kept, r.copies, r.score, r.row, r["size"], r.part, r.n, r.key, r["_others"]) for r in rows} <= {("OWN", "KEPT", 9, 0.5, "ROW", 1, 2, 3, "KEY", "O")}


@pytest.mark.parametrize("stage", range(5))
def test_empty_tables(spark, docs, stage):
    made = P.STAGES[stage][1](spark, docs.limit(0), SF)
    assert made.count() == 0 and (stage == 4 or made.columns == docs.columns)


def test_quality(spark, docs):
    whole = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    weights, bias = quality.learned(whole, labels)
    for given in (whole, docs):
        model = quality.learned(given, labels)
        kept = P.keep_quality(spark, given, SF)
        assert kept.columns == given.columns
        plain = [r for r in given.collect() if 1 / (1 + np.exp(-quality.margin(r.text, model[0].astype(np.float32), model[1]))) >= P.ACCEPTED]
        assert Counter(map(str, kept.collect())) == Counter(map(str, plain))
    clean = {r.doc_id for r in labels.where("quality = 1 and toxic = 0").collect()} & {r.doc_id for r in whole.collect()}
    found = {r.doc_id for r in P.keep_quality(spark, whole, SF).collect()}
    assert len(clean & found) >= 0.9 * len(clean)
    junk = {r.doc_id for r in labels.where("quality = 0").collect()}
    assert len(junk & found) <= 0.1 * len(junk)


def test_near_duplicates(spark, docs):
    rows = docs.collect()
    kept = P.drop_near_duplicates(spark, docs, SF).collect()
    others(kept)
    assert docs.columns == P.drop_near_duplicates(spark, docs, SF).columns

    def own_set(r):
        return frozenset(plain_set(r.text))

    sets = {own_set(r) for r in rows}
    keyed = {own_set(r) for r in rows if r.doc_id is not None}
    group = {s: s for s in sets}

    def find(s):
        while group[s] != s:
            s = group[s]
        return s

    for a in keyed:
        for b in keyed:
            if a != b and similar(a, b):
                group[find(a)] = find(b)
    wanted = defaultdict(list)
    for r in rows:
        wanted[find(own_set(r))].append(r)
    found = defaultdict(list)
    for r in kept:
        found[find(own_set(r))].append(r)
    assert set(found) == set(wanted)
    for g, own in found.items():  # one row of each group, with the smallest id, nulls last
        assert len(own) == 1 and own[0] in wanted[g]
        assert own[0].doc_id == min((r.doc_id for r in wanted[g] if r.doc_id is not None), default=None)
    assert sum(r.doc_id == 7 for r in kept) == 2  # two texts of one id


def test_repeats(spark, docs):
    rows, found = docs.collect(), P.remove_repeats(spark, docs, SF).collect()
    others(found)
    first = {}
    for r in rows:
        b = (r.text or "").encode()
        for j in range(len(b) - 49):
            w = b[j : j + 50]
            first[w] = min(first.get(w, 1 << 62), 1 << 61 if r.doc_id is None else r.doc_id)
    expected = Counter()
    for r in rows:
        b, k = (r.text or "").encode(), 1 << 61 if r.doc_id is None else r.doc_id
        gone = bytearray(len(b))
        for j in range(len(b) - 49):
            if first[b[j : j + 50]] < k:
                gone[j : j + 50] = b"\1" * 50
        text = bytes(c for c, g in zip(b, gone, strict=True) if not g).decode(errors="ignore")
        expected[r.doc_id, text, len(text)] += 1
    assert Counter((r.doc_id, r.text, r.n_chars) for r in found) == expected


def test_mixing(spark, docs):
    found = P.mix_sources(spark, docs, SF).collect()
    others(found)
    plain = docs.select("doc_id", "text", "source")
    expected = Counter()
    for r in mixing.mix(plain).collect():
        expected[r.doc_id, r.text, r.source] += r.copies
    assert Counter((r.doc_id, r.text, r.source) for r in found) == +expected


def test_encoding(spark, docs):
    import public_tokenizers
    import tiktoken

    from veilframe.llm import bpe

    ranks = bpe.coder(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).ranks
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    found = Counter((r.doc_id, r.lang, r.source, r.n_tokens, bytes(r.token_ids), r.decoded_sha256) for r in P.encode(spark, docs, SF).collect())
    expected = Counter()
    for r in docs.collect():
        ids = plain.encode_ordinary(r.text or "")
        expected[r.doc_id, r.lang, r.source, len(ids), np.array(ids, "<u4").tobytes(), hashlib.sha256((r.text or "").encode()).hexdigest()] += 1
    assert found == expected
