"""Near copies against all pairs, on planted copies of every similarity."""

import random
from collections import defaultdict

import pytest

from veilframe.llm import copies


def plain_set(text):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def similar(a, b):
    return a == b or len(a & b) >= 0.8 * len(a | b) > 0


def table():
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(3000)]
    texts = ["", None, " ", "one", "One", "two words"]
    for _ in range(60):
        base = rng.choices(vocabulary, k=rng.randrange(20, 250))
        texts.append(" ".join(base))
        for _ in range(4):  # each changed word takes up to five shingles
            own = list(base)
            for at in rng.sample(range(len(own)), max(1, int(len(own) * rng.uniform(0, 0.06)))):
                own[at] = "changed" + str(rng.random())
            texts.append(" ".join(own))
    crowd = rng.choices(vocabulary, k=150)
    for i in range(40):
        texts.append(" ".join([*crowd[: i % 120], f"only{i}", *crowd[i % 120 :]]))
    rng.shuffle(texts)
    return list(enumerate(texts)) + [(None, texts[0]), (None, "no other has this")]


@pytest.mark.parametrize("cell", [256, 3])
def test_near_copies_against_all_pairs(spark, monkeypatch, cell):
    monkeypatch.setattr(copies, "CELL", cell)
    rows = table()
    sets = {k: plain_set(t) for k, t in rows if k is not None}
    near = defaultdict(set)
    links = [(a, b) for a in sets for b in sets if a < b and similar(sets[a], sets[b])]
    for a, b in links:
        near[a].add(b)
        near[b].add(a)
    expected = {}
    for k in sorted(sets):
        todo = [] if k in expected else [k]
        while todo:
            n = todo.pop()
            if n not in expected:
                expected[n] = k
                todo += near[n]
    found = copies.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(found) == len(rows) and len(links) > 300
    assert {r.doc_id: r.component for r in found if r.doc_id is not None} == expected
    nameless = sorted((r.component is None, r.component) for r in found if r.doc_id is None)
    assert nameless == [(False, expected[0]), (True, None)]
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert copies.near_copies(empty).count() == 0


def test_the_stage_drops_copies_with_a_changed_word(spark):
    import corpus_pipeline as P

    rng = random.Random(4)
    base = [" ".join(rng.choices([f"w{i}" for i in range(2000)], k=200)) for _ in range(50)]
    rows = [(i, t) for i, t in enumerate(base)]
    rows += [(100 + i, " ".join([*t.split()[:90], "changed", *t.split()[91:]])) for i, t in enumerate(base)]
    rows += [(None, base[0]), (None, "no other has this")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = P.drop_near_duplicates(spark, docs, "").collect()
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == list(range(50))
    assert [r.text for r in kept if r.doc_id is None] == ["no other has this"]
