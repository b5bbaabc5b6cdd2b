"""Files as documents: kinds, names, signed envelopes, and plain text as pages."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# ---- fixed values: the object identifier of signed data, and office file endings
SIGNED_DATA = bytes.fromhex("06092a864886f70d010702")
OFFICE = ("doc", "docx", "odt", "rtf", "xls", "xlsx", "ods", "ppt", "pptx", "odp", "txt")
#: Office endings without plain text, which segments() takes as it is.
OFFICE_ONLY = OFFICE[:-1]
OFFICE_TYPES = "officedocument|opendocument|msword|ms-excel|ms-powerpoint|rtf|text/plain"
# the long side of a page made of an image, in points
LONG_SIDE = 841.89
# ---- end of fixed values
MOST_ENVELOPES = 4


def kind(path: Column, mime: Column | None = None, office: tuple[str, ...] = OFFICE) -> Column:
    """pdf, image, signed, office or other, by the file's ending or, where that tells nothing, by
    its media type if one is known. office: the endings of files that are to be saved as pdf first."""
    low, media = F.lower(F.coalesce(path, F.lit(""))), F.lower(F.coalesce(mime if mime is not None else F.lit(""), F.lit("")))
    return (
        F.when(low.endswith(".p7m"), "signed").when(low.endswith(".pdf") | (media == "application/pdf"), "pdf")
        .when(low.rlike(r"\.(?:jpe?g|png)\z") | media.isin("image/jpeg", "image/png"), "image")
        .when(low.rlike(r"\.(?:" + "|".join(office) + r")\z") | media.rlike(OFFICE_TYPES), "office").otherwise("other")
    )


def base_name(path: Column) -> Column:
    """The name without its folder, .p7m and document endings."""
    name = F.regexp_replace(F.regexp_replace(path, r"^.*[/\\]", ""), r"(?i)\.p7m\z", "")
    return F.regexp_replace(name, r"(?i)\.(?:pdf|jpe?g|png)\z", "")


def output_names(path: Column) -> Column:
    """struct<document, report>: the names of what is made of a file."""
    base = base_name(path)
    return F.struct(F.concat(base, F.lit("_redacted.pdf")).alias("document"), F.concat(base, F.lit("_report.pdf")).alias("report"))


def magic(content: Column) -> Column:
    """pdf, png, jpeg or null by the first bytes."""
    start = F.hex(F.substring(content, 1, 8))
    return F.when(start.startswith("25504446"), "pdf").when(start.startswith("89504E47"), "png").when(start.startswith("FFD8FF"), "jpeg")


def _parts(data: bytes, at: int, end: int) -> Iterator[tuple[int, int, int, int]]:
    """(tag, content from, content to, next) of the values in data[at:end]; an open-ended value
    (length 0x80) reaches to its two zero bytes."""
    while at < end:
        tag, size, begin = data[at], data[at + 1], at + 2
        if size == 0x80:
            stop = begin
            for *_, after in _parts(data, begin, end):
                stop = after
                if data[stop : stop + 2] == b"\0\0":
                    break
            yield tag, begin, stop, stop + 2
            at = stop + 2
            continue
        if size > 0x80:
            width = size & 0x7F
            size, begin = int.from_bytes(data[begin : begin + width]), begin + width
        if begin + size > end:
            raise ValueError("truncated")
        yield tag, begin, begin + size, begin + size
        at = begin + size
        if data[at : at + 2] == b"\0\0":
            return


def _octets(data: bytes, tag: int, a: int, b: int) -> bytes:
    if not tag & 0x20:
        return data[a:b]
    return b"".join(_octets(data, *x[:3]) for x in _parts(data, a, b))


def unwrap(data: bytes) -> tuple[bytes | None, str | None]:
    """The content of a signed envelope (nested ones too), or why there is none."""
    for _ in range(MOST_ENVELOPES):
        text = data.lstrip()
        if not text.startswith(b"\x30") and re.match(rb"[A-Za-z0-9+/=\s-]+\Z", text[:64]):
            try:
                data = base64.b64decode(re.sub(rb"-----[^-]+-----|\s", b"", text))
            except ValueError:
                return None, "not signed data"
        try:
            if not data or data[0] != 0x30 or SIGNED_DATA not in data[:32]:
                return None, "not signed data"
            _, a, b, _ = next(_parts(data, 0, len(data)))
            outer = list(_parts(data, a, b))
            inner = next(_parts(data, *outer[1][1:3]))
            fields = list(_parts(data, *inner[1:3]))
            content = next(x for x in fields if x[0] == 0x30)
            wrapped = list(_parts(data, *content[1:3]))
            if len(wrapped) < 2:
                return None, "detached"
            octets = next(_parts(data, *wrapped[1][1:3]))
            data = _octets(data, *octets[:3])
        except (IndexError, StopIteration, ValueError):
            return None, "truncated"
        except RecursionError:
            return None, "nested too deeply"
        if data[:4] in (b"%PDF", b"\x89PNG") or data[:3] == b"\xff\xd8\xff":
            return data, None
        if SIGNED_DATA not in data[:32]:
            return None, "no document inside"
    return None, "too many envelopes"


def unwrapped(files: DataFrame, content: str = "content") -> DataFrame:
    """files with inner (binary) and error: what signed envelopes hold. A null content has the
    error of an empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [unwrap(x.as_py() or b"") for x in batch.column(batch.schema.get_field_index(content))]
            columns = [pa.array([m[0] for m in made], pa.binary()), pa.array([m[1] for m in made], pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, "inner", "error"])

    schema = StructType(list(files.schema.fields)).add("inner", "binary").add("error", "string")
    return files.mapInArrow(run, schema)


def image_size(data: bytes) -> tuple[int, int] | None:
    """Width and height in pixels that a PNG's or JPEG's own bytes tell."""
    if data[:4] == b"\x89PNG" and len(data) >= 24:
        return int.from_bytes(data[16:20]), int.from_bytes(data[20:24])
    at = 2
    while data[:2] == b"\xff\xd8" and at + 9 <= len(data):
        if data[at] != 0xFF:
            return None
        mark = data[at + 1]
        if 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):  # the frame's header
            return int.from_bytes(data[at + 7 : at + 9]), int.from_bytes(data[at + 5 : at + 7])
        alone = mark in (0x01, 0xFF) or 0xD0 <= mark <= 0xD8  # no length follows; 0xff fills
        at += 1 if mark == 0xFF else 2 if alone else 2 + max(2, int.from_bytes(data[at + 2 : at + 4]))
    return None


def opened(files: DataFrame, mime: str | None = None) -> DataFrame:
    """Files (path, content and more) as documents: kind by name and media type (a column's name),
    document (what a signed envelope holds, else the content), found (pdf, png, jpeg by its first
    bytes: names may lie), page_width and page_height of an image's page, and error: why there is
    no document. An image's longer side is that of a sheet, the other in proportion."""
    rows = files.withColumn("kind", kind(F.col("path"), F.col(mime) if mime else None))
    # envelopes and images only go to Python, and only what envelopes hold comes back
    signed, image = F.col("kind") == "signed", F.hex(F.substring("content", 1, 4)).rlike("^(?:89504E47|FFD8)")
    parts = pa.struct([("document", pa.binary()), ("error", pa.string()), ("px", pa.int32()), ("py", pa.int32())])

    @F.arrow_udf("document binary, error string, px int, py int")
    def read(content: pa.Array, is_signed: pa.Array) -> pa.Array:
        made = []
        for own, envelope in zip(content, is_signed.to_pylist(), strict=True):
            data = own.as_py()
            document, error = (data, None) if data is None or not envelope else unwrap(data)
            size = (document and image_size(document)) or (None, None)
            made.append({"document": document if envelope else None, "error": error, "px": size[0], "py": size[1]})
        return pa.array(made, parts)

    rows = rows.withColumn("_read", read(F.when(signed | image, F.col("content")), signed))
    rows = rows.withColumns({"document": F.when(signed, F.col("_read.document")).otherwise(F.col("content")), **{c: F.col(f"_read.{c}") for c in ("error", "px", "py")}})
    rows = rows.drop("_read").withColumn("found", magic(F.col("document")))
    whole = (F.col("px") > 0) & (F.col("py") > 0)
    side = lambda own, other: F.when(whole, F.when(F.col(own) >= F.col(other), LONG_SIDE).otherwise(LONG_SIDE * F.col(own) / F.col(other)))
    fits = F.when(F.col("kind") == "image", F.col("found").isin("png", "jpeg")).when(F.col("kind").isin("pdf", "signed"), F.col("found").isNotNull()).otherwise(False)
    error = F.coalesce("error", F.when(~F.coalesce(fits, F.lit(False)), F.when(F.col("kind") == "office", "to be saved as pdf first").otherwise("not recognised")))
    return rows.withColumns({"page_width": side("px", "py"), "page_height": side("py", "px"), "error": error}).drop("px", "py")


def read_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """The files of a folder and those below, opened: path, length, modificationTime and what
    opened() adds; the raw content stays behind. Spark leaves out files without any bytes."""
    read = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return opened(read).drop("content")


#: Where the first line of a plain text stands: below a page's head, or in it.
BODY, HEAD = 700.0, 820.0
BLANK = r"^[\x09-\x0D\x20\u00A0\u2028\u2029\uFEFF]*$"


def segments(pages: DataFrame, top: float = BODY) -> DataFrame:
    """Plain text (doc_id, page, text) as runs for layout: one for each line that is not blank,
    11 points high, 14 points below the line before, 5.5 points for each character, 1 at least.

    A blank line moves on as any other and leaves a line feed at the end of the run before, so
    that paragraphs stay apart; blank lines before the first run leave nothing. Null and blank
    texts have no run. seg counts the page's lines, blank ones too."""
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    shown = F.filter(F.transform(lines, lambda s, i: F.struct(i.alias("seg"), s.alias("line"))), lambda r: ~r["line"].rlike(BLANK))
    rows = pages.select("doc_id", "page", F.size(lines).alias("n"), shown.alias("shown"))
    after = lambda i: F.coalesce(F.get("shown", i + 1)["seg"], F.col("n"))
    runs = F.transform("shown", lambda r, i: F.struct(r["seg"], r["line"], (after(i) - r["seg"] - 1).alias("blank")))
    rows = rows.select("doc_id", "page", F.explode(runs).alias("r")).select("doc_id", "page", "r.*")
    return rows.select(
        "doc_id", "page", "seg", F.concat("line", F.repeat(F.lit("\n"), F.col("blank"))).alias("str"),
        F.lit(50.0).alias("x"), (F.lit(top) - 14.0 * F.col("seg")).alias("y"), F.lit(1.0).alias("dx"), F.lit(0.0).alias("dy"),
        F.greatest(F.lit(1.0), 5.5 * F.length("line")).alias("w"), F.lit(11.0).alias("h"), F.lit(True).alias("line_end"),
    )
