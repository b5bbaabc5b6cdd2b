"""Embeddings, urls, queries and the pipeline on small tables."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from veilframe.llm import grid, urls
from veilframe.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def test_grid(spark, monkeypatch):
    monkeypatch.setattr(grid, "BLOCK", 300)
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(30, 8))
    table = [(i, (centres[i % 30] + rng.normal(size=8) * 0.15).tolist()) for i in range(1200)]
    table += [(5000 + i, table[3][1]) for i in range(100)] + [(5200, [2 * x for x in table[3][1]])]
    table += [(6000, None), (6001, [0.0] * 8), (6002, []), (6003, [1.0, None]), (6004, [float("nan"), 1.0]), (6005, [1.0, 2.0]), (6006, [2.0, 4.0]), (6007, [float("inf"), 1.0])]
    df = spark.createDataFrame([(*r, 1, 2) for r in table], "vec_id long, embedding array<float>, node long, n long")
    found = {r.vec_id: (r.n_links, r.component, r.kept) for r in grid.near_duplicates(df).collect()}
    near, by = defaultdict(set), defaultdict(list)
    for k, x in table:
        if x and all(y is not None and np.isfinite(y) for y in x) and any(x):
            by[len(x)].append((k, np.array(x, np.float32).astype(float)))
    for same in by.values():
        m = np.array([x / np.linalg.norm(x) for _, x in same])
        for i, j in zip(*np.nonzero(m @ m.T >= 0.9), strict=True):
            if i != j:
                near[same[i][0]].add(same[j][0])
    component = {}
    for k in sorted(k for k, _ in table):
        todo = [] if k in component else [k]
        while todo:
            n = todo.pop()
            if n not in component:
                component[n] = k
                todo += near[n]
    assert found == {k: (len(near[k]), component[k], component[k] == k) for k, _ in table}
    assert grid.near_duplicates(df.limit(0)).count() == 0


def test_grid_pairs_of_intervals_are_not_shuffled(spark, monkeypatch):
    monkeypatch.setattr(grid, "BLOCK", 50)
    held, plans = {}, {}

    def kept(df, name, stage=grid.stage):
        held[name] = stage(df, name)
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return held[name]

    monkeypatch.setattr(grid, "stage", kept)
    rng = np.random.default_rng(1)
    centre = rng.normal(size=8)
    table = [(i, (centre + rng.normal(size=8) * 0.05).tolist()) for i in range(400)]
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = grid.near_duplicates(spark.createDataFrame(table, "vec_id long, embedding array<double>").repartition(4))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert {(r.n_links, r.component) for r in found.collect()} == {(399, 0)}
    assert held["blocks"].count() == 8  # 36 pairs
    assert "CartesianProduct" in plans["grid-links"] and "Exchange" not in plans["grid-links"]
    assert "BroadcastHashJoin" in plans["blocks"] and "SortMergeJoin" not in plans["blocks"]


CASES = [
    ("http://Sub.Example.NET/en/1?q#f", "sub.example.net", "/en/1", "example.net/en/", "allow"),
    ("https://example.net/fr/1", "example.net", "/fr/1", "net/", "block"),
    ("https://badexample.net/en/1", "badexample.net", "/en/1", "net/", "block"),
    ("x://example.com/de/", "example.com", "/de/", "example.com/de/", "block"),
    ("x://a.org/fr/y", "a.org", "/fr/y", "org/fr/", "allow"),
    ("x://a.org/en/y", "a.org", "/en/y", None, "allow"),
    ("http://net", "net", "", None, "allow"),
    ("http://É.Org?x://y", "É.org", "", None, "allow"),
    ("no scheme", "", "", None, "allow"),
    (None, "", "", None, "allow"),
    ("", "", "", None, "allow"),
]


def test_urls(spark):
    labels = spark.createDataFrame([(0, 1, 0), (1, None, 0), (1, 1, None)], "doc_id long, quality int, toxic int")
    pages = spark.createDataFrame([(i, c[0], "h", "p") for i, c in enumerate(CASES)], "page_id long, url string, host string, path string")
    found = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge(pages, labels).collect()}
    assert found == {i: c[1:] for i, c in enumerate(CASES)}
    assert urls.judge(pages.limit(0), labels).count() == 0


def test_templates_and_purity(spark):
    rng = random.Random(0)
    table, marks = [], []
    for i in range(400):
        branch = ("spam", "news", "blog")[i % 3]
        table.append((i, f"http://h.example.com/{branch}/{''.join(rng.choices('abcdefgh', k=8))}/{i}.html"))
        marks.append((i, 0 if branch == "spam" else 1, 0))
    pages = spark.createDataFrame(table, "page_id long, url string")
    found = urls.judge(pages, spark.createDataFrame(marks, "doc_id long, quality int, toxic int")).collect()
    templates = {r.template for r in found}
    assert templates == {"/spam/*/{n}.html"} | {t for t in templates if t.startswith("/~")} and len(templates) == 2  # news and blog are one
    assert all((r.verdict == "block") == r.path.startswith("/spam") for r in found)


def plain_verdicts(table, marks):
    """Templates and verdicts by the rules of the module, host by host, without Spark."""
    import re
    from math import sqrt

    def kind(x):
        name, ending = re.match(r"[^.]*", x)[0], (re.search(r"(\.[a-z]{1,5})\Z", x) or [""])[0]
        for what, fits in (("{n}", re.fullmatch("[0-9]+", name)), ("{d}", re.fullmatch(r"[0-9]{4}-[0-9]{1,2}(-[0-9]{1,2})?", name)), ("{x}", len(name) >= 8 and re.fullmatch("[0-9a-f-]*[0-9][0-9a-f-]*", name))):
            if fits:
                return what + ending
        return x

    total = [m for k, _, _ in table for m in [marks.get(k)] if m is not None]
    base, out = (sum(total) / len(total) if total else 1.0), {}

    def score(rows):
        known = [marks[k] for k, _ in rows if k in marks]
        return (sum(known) + urls.PRIOR * base) / (len(known) + urls.PRIOR)

    def grow(rows, template, depth):
        ended = [r for r in rows if len(r[1]) <= depth]
        more = [r for r in rows if len(r[1]) > depth]
        yield from [(template, r) for r in ended]
        if len(rows) < urls.SPLIT:
            yield from [(template + "/**", r) for r in more]
            return
        children = defaultdict(list)
        for r in more:
            children[r[1][depth]].append(r)
        wild = len(children) > urls.MANY and len(more) < urls.THIN * len(children)
        def evidence(rs):
            return score(rs), sum(k in marks for k, _ in rs) + urls.PRIOR

        bins, number, last = {}, 0, None
        for c in sorted(children, key=lambda c: evidence(children[c])):
            share, n = evidence(children[c])
            if last:
                mean = (last[0] * last[1] + share * n) / (last[1] + n)
                number += share - last[0] > urls.ERRORS * sqrt(mean * (1 - mean) * (1 / last[1] + 1 / n))
            bins[c], last = number, (share, n)
        count, merged_ = Counter(bins.values()), defaultdict(list)
        for c, rs in children.items():
            merged_["*" if wild else f"~{bins[c]}" if count[bins[c]] > 1 else c] += rs
        for step, rs in merged_.items():
            yield from grow(rs, f"{template}/{step}", depth + 1)

    hosts = defaultdict(list)
    for k, host, path in table:
        hosts[host].append((k, [kind(x) for x in re.sub("^/", "", path).split("/")]))
    for host, rows in hosts.items():
        leaves = defaultdict(list)
        for template, r in grow(rows, "", 0):
            leaves[template].append(r)
        for template, rs in leaves.items():
            for k, _ in rs:
                out[k] = (template, "block" if score(rs) < urls.PURITY else "allow")
    return out


def test_branches_merge_by_their_evidence(spark):
    # two branches with shares 0.4 and 0.6: few pages do not tell them apart, many do
    for each, one in ((10, True), (400, False)):
        rows = [(b * each + i, f"http://h.example.com/{'ab'[b]}/{i}", int(i % 10 < (4, 6)[b])) for b in (0, 1) for i in range(each)]
        pages = spark.createDataFrame([r[:2] for r in rows], "page_id long, url string")
        labels = spark.createDataFrame([(r[0], r[2], 0) for r in rows], "doc_id long, quality int, toxic int")
        found = urls.judge(pages, labels).collect()
        heads = {r.template.split("/")[1] for r in found}
        assert heads == ({"~0"} if one else {"a", "b"})
        if not one:
            assert {(r.path[1], r.verdict) for r in found} == {("a", "block"), ("b", "allow")}


def test_url_tree_against_brute_force(spark):
    rng = random.Random(7)
    table, marks = [], {}
    for i in range(900):
        host = rng.choice(["a.example.com", "b.example.com", "hot.example.com", "hot.example.com"])
        depth = rng.randrange(0, 9)
        path = "/" + "/".join(rng.choice(["news", "spam", "x", "shop", "2024-01", "deadbeef01", str(i), f"p{i}.html"]) for _ in range(depth))
        table.append((i, host, path))
        if rng.random() < 0.6:
            marks[i] = int(rng.random() < (0.1 if "spam" in path else 0.9))
    table += [(1000 + i, "", "") for i in range(30)]
    pages = spark.createDataFrame([(k, f"http://{h}{p}" if h else None) for k, h, p in table], "page_id long, url string")
    labels = spark.createDataFrame([(k, v, 0) for k, v in marks.items()], "doc_id long, quality int, toxic int")
    found = {r.page_id: (r.template, r.verdict) for r in urls.judge(pages, labels).collect()}
    assert found == plain_verdicts(table, marks)
    assert {v for _, v in found.values()} == {"allow", "block"}


def test_pipeline_runs_its_stages_in_turn(spark):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in P.STAGES:
        docs = stage(spark, docs, SF)
    found = P.run(spark, SF)
    assert found.columns == docs.columns
    assert Counter(map(str, found.drop("lang").collect())) == Counter(map(str, docs.drop("lang").collect()))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_returns_one_row_each(spark, name):
    table = {"op2": "embeddings", "op6": "pages"}.get(name[:3], "documents")
    assert QUERIES[name](spark, SF).count() == spark.read.parquet(f"{SF}/{table}.parquet").count()


def test_held_out_rows_do_not_train(spark):
    from veilframe.llm.lm import held_out

    found = spark.range(200).withColumnRenamed("id", "doc_id").where(held_out()).collect()
    assert {r.doc_id for r in found} == {i for i in range(200) if zlib.crc32(str(i).encode()) % 5 == 1}
