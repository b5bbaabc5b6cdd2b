"""Sources of law that a report cites, as tables that an office keeps:

sources (source, place, title, short, url, verified), passages (source, key, place, ref, kind,
text) and cites (of: a category or a purpose; source, key)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def article_order(key: Column) -> Column:
    """A column that sorts the keys of articles like 7, 7bis, 7bis.4, 15: numbers by value and
    before letters, a beginning before what goes on."""
    part = r"(\d+|[A-Za-z]+)"
    return F.transform(F.regexp_extract_all(key, F.lit(part), F.lit(1)), lambda p: F.struct(
        p.rlike("^[A-Za-z]").alias("is_word"), F.coalesce(p.try_cast("long"), F.lit(0)).alias("number"), F.lower(p).alias("word")
    ))


def ordered_passages(passages: DataFrame) -> DataFrame:
    """passages with nr within their source: in the order of the articles where all of its keys
    begin with a digit, else by place."""
    source = Window.partitionBy("source")
    numbered = passages.withColumn("is_numbered", F.bool_and(F.col("key").rlike(r"^\d")).over(source))
    order = source.orderBy(F.when(F.col("is_numbered"), article_order(F.col("key"))), "place", "key")
    return numbered.withColumn("nr", F.row_number().over(order)).drop("is_numbered")


def labels(passages: DataFrame, sources: DataFrame) -> DataFrame:
    """source, key, label: a passage's short citation, like art. 26, comma 4, d.lgs. 33/2013."""
    rows = passages.join(sources.select("source", "short"), "source")
    return rows.select("source", "key", F.concat_ws(", ", "ref", "short").alias("label"))


def cited(findings: DataFrame, cites: DataFrame, passages: DataFrame, sources: DataFrame, purpose: str | None = None) -> DataFrame:
    """doc_id, nr, title, verified, url, ref, kind, text: each passage that a document's findings
    (by category) and the purpose cite, once, source by source in the order of the articles.
    Citations of passages that are not in the tables are left out. Documents without findings
    cite nothing."""
    used = findings.select("doc_id", F.col("category").alias("of")).distinct()
    if purpose:
        used = used.unionByName(findings.select("doc_id").distinct().withColumn("of", F.lit(purpose)))
    rows = used.join(cites, "of").select("doc_id", "source", "key").distinct()
    rows = rows.join(ordered_passages(passages).drop("place"), ["source", "key"]).join(sources, "source")
    order = Window.partitionBy("doc_id").orderBy("place", "source", "nr")
    return rows.withColumn("nr", F.row_number().over(order)).select("doc_id", "nr", "title", "verified", "url", "ref", "kind", "text")


def citation_counts(findings: DataFrame, cites: DataFrame) -> DataFrame:
    """doc_id, n_subjects, n_passages: persons that were told apart, and passages in use."""
    persons = findings.groupBy("doc_id").agg(F.countDistinct("subject_no").alias("n_subjects"))
    used = findings.select("doc_id", F.col("category").alias("of")).distinct().join(cites, "of")
    used = used.groupBy("doc_id").agg(F.countDistinct("source", "key").alias("n_passages"))
    return persons.join(used, "doc_id", "left").na.fill(0, ["n_passages"])
