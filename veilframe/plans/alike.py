"""Documents of one content: findings of the first of them hold for all."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.plans.staging import staged

#: Copies are told apart from their firsts where at least this share of the documents are copies;
#: with fewer, dealing out the texts would cost more than the copies' analysis.
SHARE = 0.5


def members(pages: DataFrame, entities: DataFrame | None, columns: list[str]) -> DataFrame | None:
    """doc_id, first (the smallest doc_id of the same content) of all documents, or None where
    most have a content of their own. A document's content are its pages (page, text and
    columns) and its entities, all of them; texts count by their SHA-256. Two pages of one
    doc_id and number are an error."""
    own = F.struct("page", F.sha2("text", 256).alias("text"), *columns)
    marks = pages.select("doc_id", F.col("page").alias("number"), F.to_json(own).alias("mark"))
    if entities is not None:
        rest = [c for c in entities.columns if c != "doc_id"]
        marks = marks.unionAll(entities.select("doc_id", F.lit(None).cast(pages.schema["page"].dataType), F.to_json(F.struct(*rest))))
    content = F.unhex(F.sha2(F.array_join(F.array_sort(F.collect_list("mark")), "\n"), 256))
    again = F.count("number") - F.size(F.collect_set("number"))
    docs = staged(marks.groupBy("doc_id").agg(content.alias("content"), again.alias("again")), "contents")
    twice = docs.where("again > 0").first()
    if twice:
        found = pages.where(F.col("doc_id") == twice["doc_id"]).groupBy("page").count().where("count > 1").first()
        raise ValueError(f"two pages are doc_id {twice['doc_id']}, page {found['page']}")
    firsts = docs.groupBy("content").agg(F.min("doc_id").alias("first"))
    if firsts.count() > (1 - SHARE) * docs.count():
        return None
    return staged(docs.join(firsts, "content").select("doc_id", "first"), "members")


def only_firsts(rows: DataFrame, members: DataFrame) -> DataFrame:
    """The rows of the first document of each content."""
    return rows.join(members.where("doc_id = first").select("doc_id"), "doc_id", "left_semi")


def for_all(findings: DataFrame, members: DataFrame) -> DataFrame:
    """Findings of first documents as those of all documents of their content."""
    own = findings.withColumnRenamed("doc_id", "first")
    return members.join(own, "first").select(*findings.columns)
