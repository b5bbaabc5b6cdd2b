"""URL filter: block and allow rules, and a tree of path templates for each host.

Parsing and rules: see parsed() and ruled(). For urls without a rule the method decides:

1. Segments of a path are turned into kinds where they vary by nature (numbers, hex and
   dates, with what is left of a file name's ending). The tree of a host grows level by level
   from its root: a node's children are the next segments of its paths.
2. Where a node's children are many and thin (over MANY distinct ones with fewer than THIN
   urls each on average), all become one wildcard "*".
3. Other children merge where they are statistically alike. Each has a share of good pages,
   smoothed by PRIOR pages of the overall share. Sorted by it, neighbours stay together while
   they differ by no more than ERRORS standard errors of the difference of two shares, of
   known + PRIOR pages each: thin branches merge easily, well-known ones only if they are
   equal. Children that stay together become one branch ("~" and its number from the worst),
   whose own children are then those of all of them.
4. Nodes with fewer than SPLIT urls are not split further; what is left of their paths is
   "**". All other paths are followed to their ends, however deep.
5. A template's purity is the share of good pages among its labelled ones, smoothed alike.
   Purity below PURITY blocks. A page is good if its label says quality 1 and not toxic;
   unlabelled pages count for the shape of the tree only.

All of it is joins and group-bys; the tree is built from distinct paths with counts, and rows
meet what becomes of their segment by (host, node, segment), so that a hot host is spread over
its branches. What is joined to pages and paths is read from files, so that Spark splits what
is hot even so. Neighbours are told apart among a node's distinct pairs of counts, which are few:
a node with K labelled pages has at most about K ** (2/3) of them.

Labels are given for pages: a label's doc_id is taken as the page_id that it speaks of.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilframe.llm.common import stage

MANY, THIN, SPLIT = 20, 3.0, 10
ERRORS, PRIOR, PURITY = 1.0, 20.0, 0.5
#: host suffix, path prefix, verdict
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))

NUMBER, HEX, DATE = r"^[0-9]+$", r"^[0-9a-f-]*[0-9][0-9a-f-]*$", r"^[0-9]{4}-[0-9]{1,2}(-[0-9]{1,2})?$"


def parsed(pages: DataFrame, url: str = "url") -> DataFrame:
    """pages with host and path. Host: after the first :// up to / ? # or the end, A-Z
    lower-cased; path: from there up to ? # or the end. Null urls and those without :// have
    both empty."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.expr(f"substring(`{url}`, instr(`{url}`, '://') + 3)")).otherwise("")
    capitals = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    host = F.translate(F.regexp_extract(F.col("_rest"), "^[^/?#]*", 0), capitals, capitals.lower())
    path = F.regexp_extract(F.col("_rest"), r"^[^/?#]*([^?#]*)", 1)
    return pages.withColumn("_rest", F.coalesce(rest, F.lit(""))).withColumns({"host": host, "path": path}).drop("_rest")


def ruled(rules: tuple[tuple[str, str, str], ...] = RULES) -> tuple[Column, Column]:
    """The rule (like net/) and verdict that fit host and path, null if none. A rule fits its
    host and all subdomains where the path starts with the rule's; the longest rule wins."""
    rule = verdict = F.lit(None).cast("string")
    for host, path, what in sorted(rules, key=lambda r: len(r[0] + r[1])):  # later ones win
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        rule = F.when(fits, host + path).otherwise(rule)
        verdict = F.when(fits, what).otherwise(verdict)
    return rule, verdict


def _kind(segment: Column) -> Column:
    name, ending = F.regexp_extract(segment, r"^([^.]*)", 1), F.regexp_extract(segment, r"(\.[a-z]{1,5})$", 1)
    kind = (
        F.when(name.rlike(NUMBER), "{n}").when(name.rlike(DATE), "{d}").when((F.length(name) >= 8) & name.rlike(HEX), "{x}")
    )
    return F.coalesce(F.concat(kind, ending), segment)


def _branches(children: DataFrame, base: float) -> DataFrame:
    """host, template, good, known, branch (a number within the node, from the worst share) and
    like, the number of children in that branch."""
    node, n = ["host", "template"], F.col("known") + F.lit(PRIOR)
    pairs = children.groupBy(*node, "good", "known").agg(F.count("*").alias("m"))
    pairs = pairs.withColumns({"share": (F.col("good") + F.lit(PRIOR * base)) / n, "n": n})
    order = Window.partitionBy(*node).orderBy("share", "n")
    far = pairs.withColumns({"s": F.lag("share").over(order), "k": F.lag("n").over(order)})
    mean = (F.col("s") * F.col("k") + F.col("share") * F.col("n")) / (F.col("k") + F.col("n"))
    error = F.sqrt(mean * (1 - mean) * (1 / F.col("k") + 1 / F.col("n")))
    fresh = F.coalesce(F.col("share") - F.col("s") > ERRORS * error, F.lit(False))
    told = far.withColumn("fresh", fresh.cast("int"))
    told = told.withColumn("branch", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    like = F.sum("m").over(Window.partitionBy(*node, "branch"))
    return told.select(*node, "good", "known", "branch", like.alias("like"))


def templates(paths: DataFrame, base: float) -> DataFrame:
    """host, path, template, known, good of the distinct paths (host, path, n: pages of a path;
    known: with a label; good: good ones). base: the overall share of good pages."""
    segments = F.transform(F.split(F.regexp_replace("path", "^/", ""), "/"), _kind)
    given = ["host", "path", "n", "known", "good"]
    rows = stage(paths.select(*given, segments.alias("segments"), F.lit("").alias("template")), "tree")
    done, depth = [], 0
    while True:
        # a node that is too small, or a path that has ended, is a template
        nodes = stage(rows.groupBy("host", "template").agg(F.sum("n").alias("urls")).where(F.col("urls") >= SPLIT).select("host", "template"), "nodes")
        rest = F.when(F.size("segments") > depth, "/**").otherwise("")
        ended = rows.where(F.size("segments") <= depth)
        more = rows.where(F.size("segments") > depth)
        small = more.join(nodes, ["host", "template"], "left_anti")
        done += [x.select("host", "path", F.concat("template", rest).alias("template"), "known", "good") for x in (ended, small)]
        open_ = more.join(nodes, ["host", "template"], "left_semi").withColumn("own", F.get("segments", F.lit(depth)))
        children = stage(open_.groupBy("host", "template", "own").agg(*[F.sum(c).alias(c) for c in ("n", "known", "good")]), "children")
        if children.isEmpty():
            return _all(done)
        wild = children.groupBy("host", "template").agg(F.count("*").alias("kinds"), F.sum("n").alias("n"))
        wild = stage(wild.where((F.col("kinds") > MANY) & (F.col("n") < F.lit(THIN) * F.col("kinds"))).select("host", "template", F.lit(True).alias("wild")), "wild")
        branches = stage(_branches(children, base), "branches")
        become = children.join(wild, ["host", "template"], "left").join(branches, ["host", "template", "good", "known"]).select(
            "host", "template", "own",
            F.when(F.col("wild"), "*").when(F.col("like") > 1, F.concat(F.lit("~"), F.col("branch"))).otherwise(F.col("own")).alias("step"),
        )
        rows = open_.join(stage(become, "steps"), ["host", "template", "own"])
        rows = stage(rows.withColumn("template", F.concat("template", F.lit("/"), "step")).select(*given, "segments", "template"), "tree")
        depth += 1


def _all(tables: list[DataFrame]) -> DataFrame:
    found = tables[0]
    for one in tables[1:]:
        found = found.unionByName(one)
    return found


def judged(pages: DataFrame) -> DataFrame:
    """host, path, template, purity, verdict of the distinct paths of pages (host, path, good:
    1, 0, or null where there is no label)."""
    paths = stage(
        pages.groupBy("host", "path").agg(F.count("*").alias("n"), F.count("good").alias("known"), F.coalesce(F.sum("good"), F.lit(0)).alias("good")),
        "paths",
    )
    base = paths.agg(F.coalesce(F.try_divide(F.sum("good"), F.sum("known")), F.lit(1.0))).first()[0]
    named = stage(templates(paths, base), "templates")
    leaves = named.groupBy("host", "template").agg(F.sum("known").alias("known"), F.sum("good").alias("good"))
    purity = (F.col("good") + F.lit(PRIOR * base)) / (F.col("known") + F.lit(PRIOR))
    scored = stage(leaves.select("host", "template", purity.alias("purity")), "purity")
    return named.select("host", "path", "template").join(scored, ["host", "template"]).select(
        "host", "path", "template", "purity", F.when(F.col("purity") < PURITY, "block").otherwise("allow").alias("verdict")
    )


def judge(pages: DataFrame, labels: DataFrame, key: str = "page_id", url: str = "url") -> DataFrame:
    """key, host, path, rule, verdict of every page; labels: doc_id (the page's key), quality,
    toxic. A page with several labels is good if all are. Null urls have the empty host and
    path, a template like any other. Other columns are not read. Repeated rows each count. Without
    labels all pages are good; an empty table gives an empty table."""
    plain = parsed(pages.select(F.col(key).alias("key"), F.col(url).alias("url")))
    good = ((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)).cast("int")
    marks = labels.where("quality is not null").groupBy(F.col("doc_id").alias("key")).agg(F.min(good).alias("good"))
    found = stage(judged(plain.join(marks, "key", "left")), "judged")
    rule, verdict = ruled()
    return plain.join(found.withColumnRenamed("verdict", "found"), ["host", "path"]).select(
        F.col("key").alias(key), "host", "path", rule.alias("rule"), F.coalesce(verdict, F.col("found")).alias("verdict"), "template", "purity"
    )
