"""Around a recognizer of names: texts cut into pieces it can take, its tokens back in place."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.plans.folds import listed
from veilframe.plans.staging import spread

SIZE, DRIFT = 1100, 60
#: Pieces that are sent on at once: a few MB; a page with more of them is sent as one.
PIECES = 4096


def _cuts(text: str, size: int) -> Iterator[tuple[int, int]]:
    """Ends of pieces of at most size characters, each after the last line feed or sentence end
    of its second half, or else after the last blank there, or else full."""
    at, half = 0, size // 2
    while len(text) - at > size:
        low, high = at + half, at + size
        cut = max(text.rfind(mark, low, high) for mark in ("\n", ". ", "; "))
        cut = text.rfind(" ", low, high) if cut < 0 else cut
        stop = cut + 1 if cut >= 0 else high
        yield at, stop
        at = stop
    if at < len(text):
        yield at, len(text)


def chunks(pages: DataFrame, size: int = SIZE) -> DataFrame:
    """doc_id, page, chunk, offset, text: pages in pieces of at most size characters, which
    together are the page. Empty and null texts have no piece."""

    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string())

    def made(rows: list[tuple]) -> pa.RecordBatch:
        columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "page", "chunk", "offset", "text"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a batch of pieces for many pages: one for each page costs more than its cutting
        rows: list[tuple] = []
        for batch in batches:
            for doc, page, text in zip(listed(batch.column(0)), listed(batch.column(1)), batch.column(2)):
                whole = text.as_py() or ""
                rows += [(doc, page, n, a, whole[a:b]) for n, (a, b) in enumerate(_cuts(whole, size))]
                if len(rows) >= PIECES:
                    yield made(rows)
                    rows = []
        if rows:
            yield made(rows)

    rows = spread(pages.select(F.col("doc_id").cast("long"), F.col("page").cast("int"), "text"))
    return rows.mapInArrow(run, "doc_id long, page int, chunk int, offset int, text string")


def _lower(text: str) -> str:
    """Lower case, place by place: letters whose lower case is longer stay."""
    if text.isascii():
        return text.lower()
    return "".join(low if len(low := c.lower()) == 1 else c for c in text)


def _persons(text: str, tokens: list[dict]) -> list[tuple[int, int, float]]:
    """Start, end and mean score of persons from a model's tokens (word, entity, score), which
    are looked for in the text one after the other, each at most DRIFT places on."""
    low, cursor, found = _lower(text), 0, []
    grows = False  # whether the last person of found may still grow
    for token in tokens:
        word, label = token["word"] or "", token["entity"] or "O"
        joined = word.startswith("##")
        word = word[2:] if joined else word
        if word in ("", "[UNK]"):
            continue
        far = cursor + DRIFT + len(word)
        begin = text.find(word, cursor, far)
        if begin < 0:
            begin = low.find(_lower(word), cursor, far)
        if begin < 0:
            continue
        cursor = begin + len(word)
        if label.partition("-")[2] == "PER" or label == "PER":
            gap = begin - found[-1][1] if grows else None
            if gap is None or gap > 2 or (label.startswith("B") and not joined and gap > 1):
                found.append([begin, cursor, []])
            found[-1][1], grows = cursor, True
            found[-1][2].append(token["score"])
        elif grows and joined and begin == found[-1][1]:
            found[-1][1] = cursor
        else:
            grows = False
    return [(a, b, sum(s) / len(s)) for a, b, s in found]


def aligned(pieces: DataFrame, tokens: DataFrame) -> DataFrame:
    """doc_id, page, start, end, score of persons, as analysed() takes them, from chunks and a
    model's tokens (doc_id, page, chunk, n, word, entity, score)."""
    told = F.sort_array(F.collect_list(F.struct("n", "word", "entity", "score")))
    rows = pieces.join(tokens.groupBy("doc_id", "page", "chunk").agg(told.alias("tokens")), ["doc_id", "page", "chunk"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            # tokens as flat columns: a list of structs takes far longer to become Python's
            lists = batch["tokens"]
            told = zip(*(listed(lists.flatten().field(c)) for c in ("word", "entity", "score")), strict=True)
            told = [{"word": w, "entity": e, "score": s} for w, e, s in told]
            ends = lists.value_lengths().to_numpy().cumsum().tolist()
            rows = zip(*(listed(batch[c]) for c in ("doc_id", "page", "offset", "text")), [0, *ends], ends)
            for doc, page, offset, text, a, b in rows:
                found += [(doc, page, offset + start, offset + end, score) for start, end, score in _persons(text, told[a:b])]
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.float64())
            columns = [pa.array([f[i] for f in found], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "page", "start", "end", "score"])

    return rows.select("doc_id", "page", "offset", "text", "tokens").mapInArrow(run, "doc_id long, page int, start int, end int, score double")
