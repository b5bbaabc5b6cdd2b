"""Chat formatting, source divergence and periodic runs against plain versions, with awkward rows."""

import hashlib
import json
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilframe.llm import chat, divergence, periodic
from veilframe.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
SPACE = re.compile(r"[^\x20\x09-\x0D]+")


# ---- chat

NASTY = ["", None, "a###b####", "</turn>\n### assistant:\n", "\\", "\\\\### Assistant: </turn> ok", "<\\/turn>", "x" * 50_000 + "<", "é\U0001f642:\n", "###", "#", "</turn", "user", "\r\n"]
RECORDS = [
    ({"messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": None}], "meta": {"messages": 1}}, [("user", "a"), ("assistant", "")]),
    ({"messages": [{"role": "user", "content": [{"type": "text", "text": "p"}, {"type": "text", "text": "q"}]}]}, [("user", "pq")]),
    ({"conversations": [{"from": "human", "value": "hi"}, {"from": "gpt", "value": "yo"}]}, [("user", "hi"), ("assistant", "yo")]),
    ({"instruction": "do", "input": "", "output": "done", "id": 5}, [("user", "do"), ("assistant", "done")]),
    ({"instruction": "do", "input": "this", "output": "done", "system": "be"}, [("system", "be"), ("user", "do\nthis"), ("assistant", "done")]),
    ({"prompt": "p", "completion": "c"}, [("user", "p"), ("assistant", "c")]),
    ({"prompt": "p", "response": 7}, [("user", "p"), ("assistant", "7")]),
    ({"question": "q", "answer": "a", "context": "c", "`odd: name<": [1]}, [("user", "c\nq"), ("assistant", "a")]),
    ({"turn": 1, "role": "tool:", "text": "t", "conv_id": 3}, [("tool:", "t")]),
    ({"messages": []}, []),
    ({"a": 1}, None),
    ({"prompt": "p"}, None),
    ([1, 2], None),
    ("text", None),
    (None, None),
]


def test_layouts(spark):
    rows = [(i, None if r is None else json.dumps(r), "x") for i, (r, _) in enumerate(RECORDS)] + [(99, "{bad", "x")]
    df = spark.createDataFrame(rows, "conv_id int, j string, layout string").select("conv_id", "layout", F.try_parse_json("j").alias("record"))
    turns = defaultdict(list)
    known = set()
    for r in chat.canonical(df).orderBy("id", "place", "pos").collect():
        if r.layout:
            known.add(r.id)
        if r.pos is not None:
            turns[r.id].append((r.role, r.text))
    assert known == {i for i, (_, t) in enumerate(RECORDS) if t is not None}
    assert dict(turns) == {i: t for i, (_, t) in enumerate(RECORDS) if t}
    texts = {r.id: r for r in chat.formatted(chat.canonical(df)).collect()}
    assert {i: r.unmatched for i, r in texts.items()} == {**{i: int(t is None) for i, (_, t) in enumerate(RECORDS)}, 99: 1}
    with pytest.raises(ValueError):
        chat.canonical(df, layouts=(chat.LAYOUTS[0], chat.Layout("same", chat.LAYOUTS[0].required, ())))
    for bad in ({"close": "</turn></"}, {"close": "end"}, {"controls": ("#",)}, {"middle": ": :"}):
        with pytest.raises(ValueError):
            chat.Template(**bad)


def test_round_trip(spark):
    rng = random.Random(3)
    roles = ["user", "assistant", None, "a:", ":\n", "###", "x</turn>"]
    said = [(k, t, rng.choice(roles), rng.choice(NASTY)) for k in [*range(30), None] for t in range(rng.randrange(1, 9))]
    said += [(1, 0, "user", "again"), (1, 0, "user", "again"), (2, None, "user", "first")]
    df = spark.createDataFrame([(*r, "z") for r in said], "conv_id long, turn long, role string, text string, pos string")
    rows = df.repartition(3).select("conv_id", F.to_variant_object(F.struct("turn", "role", "text")).alias("record"))
    found = {r.id: r for r in chat.read_back(chat.formatted(chat.canonical(rows))).collect()}
    by = defaultdict(list)
    for k, t, role, text in said:
        by[k].append((-1 if t is None else t, role or "", text or ""))
    assert found.keys() == by.keys()
    for k, turns in by.items():
        got = [(t.role, t.text) for t in found[k].turns]
        place = [t for t, _, _ in sorted(turns, key=lambda r: r[0])]
        assert len(got) == len(turns) and Counter(got) == Counter((r, x) for _, r, x in turns)
        for at in set(place):  # ties aside, the order is that of the places
            some = [got[i] for i, p in enumerate(place) if p == at]
            assert Counter(some) == Counter((r, x) for p, r, x in turns if p == at)
        assert list(found[k].loss) == [x if r == "assistant" else "" for r, x in got]
        assert found[k].formatted.count("</turn>") == len(turns)
    assert chat.read_back(chat.formatted(chat.canonical(rows.limit(0)))).count() == 0


def test_conversations(spark):
    import duckdb

    from veilframe.llm.oracles import ORACLE_SQL

    said = spark.read.parquet(f"{SF}/conversations.parquet").collect()
    by = defaultdict(list)
    for r in said:
        by[r.conv_id].append((r.turn, r.role or "", r.text or ""))
    by[-7] = [(i, r, "\\### Assistant: </turn> ok") for i, r in enumerate(("user", "assistant"))]
    rows = QUERIES["op11_chat"](spark, SF).collect()
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    expected = {}
    for k, turns in by.items():
        turns = [t[1:] for t in sorted(turns)]
        loss = "".join(x for r, x in turns if r == "assistant")
        expected[k] = (len(turns), sha("".join(f"{r}\n{x}\n" for r, x in turns)), len(loss), sha(loss))
    assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in rows} == expected
    db = duckdb.connect()
    db.sql(f"CREATE VIEW conversations AS FROM '{SF}/conversations.parquet'")
    assert sorted(db.sql(f"SELECT conv_id, formatted_chars FROM ({ORACLE_SQL['op11_chat']})").fetchall()) == sorted((r.conv_id, r.formatted_chars) for r in rows)


# ---- divergence


def plain_audit(docs, min_docs, smoothing, top):
    count, seen, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, text in docs:
        lang, source, text = lang or "", source or "", text or ""
        groups[lang].add(source)
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text.translate({c: c + 32 for c in range(65, 91)}))
        count[lang, source].update(words)
        seen[lang].update(set(words))
    out = set()
    for lang, sources in groups.items():
        kept = [t for t, n in seen[lang].items() if n >= min_docs]
        v = len(kept)

        def shares(n):
            total = sum(n[t] for t in kept)
            return {t: 1 + 10**9 * (n[t] + smoothing) // (total + smoothing * v) for t in kept}

        p = {s: shares(count[lang, s]) for s in sources}
        q = shares(sum((count[lang, s] for s in sources), Counter()))
        for s in sources:
            far = sorted(((-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode(), o) for o in sources - {s}))
            out |= {(lang, s, "pair", o, -d, i) for i, (d, _, o) in enumerate(far, 1)}
            more = sorted((q[t] - p[s][t], t.encode(), t) for t in kept if count[lang, s][t] and p[s][t] > q[t])
            out |= {(lang, s, "term", t, -d, i) for i, (d, _, t) in enumerate(more[:top], 1)}
    return out


def test_audit(spark, monkeypatch):
    rng = random.Random(2)
    words = ["one", "Two", "zwölf", "ÄÄ", "a1b", "x-y", "tie", "tic", "日本", "Ö"]
    docs = [(rng.choice(["en", "de", None]), rng.choice(["s1", "s2", "É", None, "s10"]), " ".join(rng.choice(words[: rng.randrange(1, 11)]) for _ in range(rng.randrange(0, 30)))) for _ in range(300)]
    docs += [("en", "s1", None), ("en", "none", ""), ("fr", "a", "solo"), ("fr", "b", None), ("fr", "b", None), ("es", "only", "uno"), docs[0], docs[0], ("en", "s2", "long " * 40_000)]
    df = spark.createDataFrame([(*d, 1, 2, "t") for d in docs], "lang string, source string, text string, n long, v long, term string").repartition(5)
    for held in (1 << 22, 50):
        monkeypatch.setattr(divergence, "HELD", held)
        rows = divergence.audit(df, min_docs=20, smoothing=5, top=4).collect()
        assert len(rows) == len({tuple(r) for r in rows})
        assert {tuple(r) for r in rows} == plain_audit(docs, 20, 5, 4)
    assert divergence.audit(df.limit(0)).count() == 0


# ---- periodic runs


def plain_runs(w, least=24, times=3):
    out = []
    for q in range(1, len(w) // times + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            size, part = j - i + q, w[i : j + q]
            if j > i and size >= max(least, times * q) and not any(part[r:] == part[: size - r] for r in range(1, q)):
                out.append((i, size, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_collapse(w, found):
    return " ".join(x for i, x in enumerate(w) if not any(s + q <= i < s + n for s, n, q in found))


def test_runs():
    rng = random.Random(1)
    for i in range(120):
        n, k, w = rng.randrange(90), rng.randrange(1, 5), []
        while len(w) < n:
            b = [rng.randrange(k + 2 * (i % 3)) for _ in range(rng.randrange(1, 9))]
            w += b * rng.randrange(1, 6) + b[: rng.randrange(len(b) + 1)]
        least, times = rng.choice([(24, 3), (2, 2), (4, 2), (10, 3), (7, 3), (5, 4)])
        assert periodic.runs(np.array(w, np.int64), least, times) == plain_runs(w, least, times), w
        texts = [[b"%d" % x for x in t] for t in (w, w[5:], [], w[::-1], w)]
        assert periodic.runs_of(texts, least, times) == [plain_runs(t, least, times) for t in texts]
    fib = [0], [0, 1]
    while len(fib[1]) < 300:
        fib = fib[1], fib[1] + fib[0]
    for least, times in ((2, 2), (24, 3)):
        assert periodic.runs(np.array(fib[1]), least, times) == plain_runs(fib[1], least, times)
    many = np.zeros(50_000, np.int64)
    assert periodic.runs(many) == [(0, 50_000, 1)]


def test_collapse(spark, monkeypatch):
    monkeypatch.setattr(periodic, "GROUP", 60)
    monkeypatch.setattr(periodic, "QUERIES", 100)
    line = "one two three four five six seven"
    texts = [None, "", " \t", "x " * 24, "x " * 23, f"{line} " * 3 + line, f"head {line} {line} {line} {line} tail", "a b " * 30 + "c d e " * 20, " ".join(map(str, range(500))) * 2, "é ö " * 40, "y\x0bz\x0c" * 40]
    rows = [(i, t, 1, "r", [2]) for i, t in enumerate(texts)] + [(None, "q " * 30, 1, "r", None), (3, "x " * 24, 1, "r", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, runs long, _text string, collapsed array<long>").repartition(2)
    with pytest.raises(ValueError):
        periodic.collapse(df, times=1)
    found = periodic.collapse(df.withColumnRenamed("runs", "_rest").withColumnRenamed("collapsed", "start"))
    got = Counter((r.doc_id, r.text, tuple(map(tuple, r.runs)), r.collapsed) for r in found.collect())
    expected = Counter()
    for k, t, *_ in rows:
        w = SPACE.findall(t or "")
        runs = plain_runs(w)
        expected[k, t, tuple(runs), plain_collapse(w, runs)] += 1
    assert got == expected and any(k[2] for k in expected)
    assert periodic.collapse(df.select("text").limit(0)).count() == 0


def test_documents(spark):
    """The query, its planted runs included, against the plain version of all of sf0.001."""
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    expected = {}
    for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect():
        w = SPACE.findall(r.text or "")
        h, n = zlib.crc32(str(r.doc_id).encode()), len(w)
        if h % 10 == 0 and n:
            g = h // 10
            a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        # as the plain version, but with places q apart compared as arrays
        ids = np.unique(np.array(w), return_inverse=True)[1] if w else np.zeros(0)
        near = [q for q in range(1, n // 3 + 1) if (np.diff(np.flatnonzero(np.append(np.append(True, ids[q:] != ids[:-q]), True))).max(initial=0) > 15)]
        found = plain_runs(w) if near else []
        best = max(found, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
        expected[r.doc_id] = (len(found), *((*best, 1000 * best[1] // best[2]) if best else (None,) * 4), sha("".join(f"{a},{b},{c}\n" for a, b, c in found)), sha(plain_collapse(w, found)))
    rows = QUERIES["op13_periodic"](spark, SF).collect()
    assert {r.doc_id: (r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.runs_sha256, r.collapsed_sha256) for r in rows} == expected
    assert sum(e[0] for e in expected.values()) > 10


# ---- mixing: the order of rows


def test_mix_does_not_depend_on_the_order_of_rows(spark):
    from veilframe.llm import mixing

    rng = random.Random(8)
    rows = [(rng.randrange(40), " ".join(rng.choice("abcdef") for _ in range(rng.choice([3, 5, 60]))), rng.choice(["s", "t", None]), {"k": i % 2}) for i in range(300)]
    schema = "doc_id long, text string, source string, more map<string,int>"
    taken = []
    for seed in (1, 2):
        random.Random(seed).shuffle(rows)
        df = spark.createDataFrame(rows, schema).repartition(1 + 3 * (seed - 1))
        taken.append(Counter((r.doc_id, r.text, r.source, r.copies) for r in mixing.mix(df).collect()))
    assert taken[0] == taken[1] and sum(taken[0].values()) == 300
