"""Ordered folds over the rows of each page, many pages to one Arrow batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema


def listed(column: pa.Array | pa.ChunkedArray) -> list:
    """column.to_pylist(), for plain kinds by way of numpy, which is many times as fast."""
    kind = column.type
    if pa.types.is_string(kind) or pa.types.is_binary(kind):
        return column.to_numpy(zero_copy_only=False).tolist()
    plain = pa.types.is_integer(kind) or pa.types.is_floating(kind) or pa.types.is_boolean(kind)
    return column.to_numpy(zero_copy_only=False).tolist() if plain and not column.null_count else column.to_pylist()


def dicts(batch: pa.RecordBatch | pa.Table) -> list[dict]:
    """batch.to_pylist(), by way of listed()."""
    names = batch.schema.names
    return [dict(zip(names, row)) for row in zip(*map(listed, batch.columns))]  # noqa: B905


def folded(df: DataFrame, keys: list[str], order: list[str], fold: Callable[[list[dict]], list[dict]]) -> DataFrame:
    """df with each group's rows (same keys, sorted by order) replaced by fold(rows).

    Rows are dealt by the keys and sorted inside partitions, so a group arrives in one piece;
    one pass over a partition then serves all its groups without a call for each. A group is
    one page, which is what the fold must hold."""
    schema = df.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = to_arrow_schema(schema)
        group: list[dict] = []
        out: list[dict] = []
        for batch in batches:
            for row in dicts(batch):
                if group and any(group[0][k] != row[k] for k in keys):
                    out += fold(group)
                    group = []
                group.append(row)
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=kind)
                out = []
        if group:
            out += fold(group)
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=kind)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def islands(df: DataFrame, order: list, fold: Callable[[list[dict]], list[dict]]) -> DataFrame:
    """df (doc_id, page, start, end and more) where the spans of a page that overlap, directly or
    through others, are replaced by fold(rows), sorted by order, which begins with start. Spans
    that meet no other, and rows without a place, pass as they are, in Arrow arrays."""
    schema = df.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = to_arrow_schema(schema)
        open_: pa.Table | None = None  # the last island so far, which the next batch may continue

        def done(rows: pa.Table, last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal open_
            doc, page = (rows[c].to_numpy() for c in ("doc_id", "page"))
            placed = rows["start"].is_valid().to_numpy()
            start, end = (rows[c].fill_null(-1).to_numpy().astype(np.int64) for c in ("start", "end"))
            group = np.cumsum(np.append(True, (doc[1:] != doc[:-1]) | (page[1:] != page[:-1])))
            # the last end before each row of its page: pages are set apart by more than any place
            wide = int(end.max(initial=0)) + 2
            reach = np.maximum.accumulate(end + group * wide)
            new = np.append(True, (start[1:] + group[1:] * wide >= reach[:-1]) | (group[1:] != group[:-1])) | ~placed
            number = np.cumsum(new) - 1
            closed = np.ones(len(start), bool)
            if not last:
                closed = number != number[-1]
                open_ = rows.filter(pa.array(~closed))
            alone = np.bincount(number)[number] == 1
            yield from rows.filter(pa.array(closed & alone)).to_batches()
            met = np.flatnonzero(closed & ~alone)
            out: list[dict] = []
            if len(met):
                some = dicts(rows.take(pa.array(met)))
                cuts = [0, *(np.flatnonzero(np.diff(number[met])) + 1).tolist(), len(met)]
                for a, b in zip(cuts, cuts[1:], strict=False):
                    out += fold(some[a:b])
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=kind)

        for batch in batches:
            rows = pa.Table.from_batches([batch]).cast(kind)
            rows, open_ = (pa.concat_tables([open_, rows]) if open_ is not None else rows), None
            if len(rows):
                yield from done(rows, False)
        if open_ is not None and len(open_):
            yield from done(open_, True)

    return df.repartition("doc_id", "page").sortWithinPartitions("doc_id", "page", *order).mapInArrow(run, schema)
