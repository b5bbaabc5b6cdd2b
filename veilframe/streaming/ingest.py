"""Pages, or runs of positioned text, from a growing folder, analysed batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from veilframe.operators.layout import page_texts, placed_runs
from veilframe.operators.redact import redacted
from veilframe.plans.pipeline import analysed
from veilframe.plans.staging import scratch, staged

PAGES = "doc_id long, page int, text string"
RUNS = "doc_id long, page int, seg int, str string, x double, y double, dx double, dy double, w double, h double"

#: Entities (doc_id, page, start, end, score) of pages (doc_id, page, text).
Recognizer = Callable[[DataFrame], DataFrame]


def pages_stream(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of the pages (Parquet) that appear in folder."""
    return spark.readStream.schema(PAGES).parquet(folder)


def runs_stream(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of the runs (Parquet) that appear in folder; a page's runs come in one file."""
    return spark.readStream.schema(RUNS).parquet(folder)


def analyse_stream(
    rows: DataFrame,
    out: str,
    checkpoint: str,
    purpose: str | None = None,
    recognizer: Recognizer | None = None,
    clear: str | None = None,
) -> StreamingQuery:
    """Findings of each batch of rows, written to out/batch=<n>; a batch that is repeated
    after a failure replaces its own folder. A document's pages must come in one batch, since
    persons are followed through a document; nothing is kept between documents.

    rows: pages, or runs (they have a column str), whose pages are read first and whose places
    tell heads and feet. recognizer gives a batch's names. clear: a folder for the redacted
    pages, batch by batch alike (it needs a purpose). What a batch stages is deleted at its end;
    an empty batch has an empty folder."""
    if clear and not purpose:
        raise ValueError("pages are redacted for a purpose")

    def write(batch: DataFrame, number: int) -> None:
        with scratch(batch.sparkSession):
            runs = staged(placed_runs(batch), "runs") if "str" in batch.columns else None
            pages = staged(batch if runs is None else page_texts(runs), "texts")
            entities = recognizer(pages) if recognizer else None
            place = f"{out}/batch={number}"
            analysed(pages, entities, purpose, runs=runs).write.mode("overwrite").parquet(place)
            if clear:
                found = batch.sparkSession.read.parquet(place)
                redacted(pages, found).write.mode("overwrite").parquet(f"{clear}/batch={number}")

    return rows.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write).trigger(availableNow=True).start()
