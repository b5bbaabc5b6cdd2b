"""Chat formatting: records of any layout to canonical turns, and turns to one marked text.

A record is a VARIANT. The nested field paths that some mapping names are read from its schema,
hashed, and the hash selects the mapping; a mapping says where roles and texts stand. Each turn
is then formatted on its own row, so only the last step gathers a conversation. Built-in
functions throughout.

Defined results: an SQL null, a text that is no JSON, and paths that fit no mapping have no
layout and are told by `unmatched`; null texts and roles are empty; an empty list of messages is
a conversation without turns; turns stand by their place in the table, then in the record, nulls
first, ties by what they are formatted as; repeated rows give their turns each; rows with a null
id are one conversation; an empty table gives an empty table; other columns are ignored. A
conversation must fit into one string (2 GB), a record into a VARIANT (128 MB).
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import partial
from itertools import chain, combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class One:
    """One turn of a fixed role; its text is what stands at the paths, a line each."""

    role: str
    paths: tuple[str, ...]


@dataclass(frozen=True)
class Each:
    """A turn for each element of an array of objects ('' for the record itself)."""

    array: str
    role: str
    text: str
    #: For texts given in parts: the field of a part which holds its text.
    part: str = ""


@dataclass(frozen=True)
class Layout:
    """A declarative mapping: the paths by which a record is known, and its turns in order."""

    name: str
    required: tuple[str, ...]
    turns: tuple[One | Each, ...]
    optional: tuple[str, ...] = ()
    #: Path of the record's place among the records of its conversation.
    order: str = ""
    roles: dict[str, str] = field(default_factory=dict, hash=False)

    def path_sets(self) -> list[tuple[str, ...]]:
        kept = chain.from_iterable(combinations(self.optional, n) for n in range(len(self.optional) + 1))
        return [tuple(sorted({*self.required, *some})) for some in kept]


#: Other names of the canonical roles.
ALIASES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "chatbot": "assistant"}

LAYOUTS = (
    Layout("turn rows", ("role", "text", "turn"), (Each("", "role", "text"),), order="turn"),
    Layout("messages", ("messages",), (Each("messages", "role", "content"),), ("messages[].role", "messages[].content")),
    Layout(
        "message parts", ("messages", "messages[].role", "messages[].content", "messages[].content[].text"),
        (Each("messages", "role", "content", "text"),), ("messages[].content[].type",),
    ),
    Layout("exchanges", ("conversations",), (Each("conversations", "from", "value"),), ("conversations[].from", "conversations[].value"), roles=ALIASES),
    Layout("instruction", ("instruction", "output"), (One("system", ("system",)), One("user", ("instruction", "input")), One("assistant", ("output",))), ("input", "system")),
    Layout("prompt and completion", ("prompt", "completion"), (One("system", ("system",)), One("user", ("prompt",)), One("assistant", ("completion",))), ("system",)),
    Layout("prompt and response", ("prompt", "response"), (One("system", ("system",)), One("user", ("prompt",)), One("assistant", ("response",))), ("system",)),
    Layout("question and answer", ("question", "answer"), (One("user", ("context", "question")), One("assistant", ("answer",))), ("context",)),
)


def known_paths(shape: Column, known: list[str]) -> Column:
    """The field paths of a schema (as schema_of_variant writes it) that are in known, sorted.
    One pass over its names and brackets; nothing is kept but the open brackets and found paths."""
    tokens = F.regexp_extract_all(shape, F.lit(r"(`(?:[^`]|``)*`|\w+): |OBJECT<|ARRAY<|>"), 0)
    start = F.struct(F.array(F.lit("")).alias("open"), F.lit("").alias("at"), F.array().cast("array<string>").alias("found"))

    def step(s: Column, t: Column) -> Column:
        top = F.element_at(s["open"], -1)
        name = F.replace(F.regexp_replace(t, "^`|(?<=`)(?=`)`|: $|`: $", ""), F.lit("``"), F.lit("`"))
        here = F.concat(top, name)
        is_name = t.endswith(": ")
        opened = F.concat(s["open"], F.array(F.when(t == "OBJECT<", F.when(s["at"] == "", "").otherwise(F.concat(s["at"], F.lit(".")))).otherwise(top)))
        new = F.array_contains(F.array(*[F.lit(k) for k in known]), here) & ~F.array_contains(s["found"], here)
        return F.struct(
            F.when(is_name, s["open"]).when(t == ">", F.slice(s["open"], 1, F.greatest(F.size(s["open"]) - 1, F.lit(1)))).otherwise(opened).alias("open"),
            F.when(is_name, here).when(t == "ARRAY<", F.concat(s["at"], F.lit("[]"))).otherwise(s["at"]).alias("at"),
            F.when(is_name & new, F.concat(s["found"], F.array(here))).otherwise(s["found"]).alias("found"),
        )

    return F.aggregate(tokens, start, step, lambda s: F.array_sort(s["found"]))


def fingerprint(paths: Column) -> Column:
    return F.xxhash64(F.array_join(paths, "\n"))


def _get(v: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(v, "$" + (f".{path}" if path else ""), kind)


def _turns(v: Column, layout: Layout) -> Column:
    """The record's turns as an array of roles and texts."""

    def role(name: Column) -> Column:
        out = F.coalesce(name, F.lit(""))
        for other, canonical in layout.roles.items():
            out = F.when(F.coalesce(name, F.lit("")) == other, canonical).otherwise(out)
        return out

    def of(part: Each, x: Column) -> Column:
        text = _get(x, part.text)
        if part.part:
            # a text may also stand there as it is
            parts = F.array_join(F.transform(_get(x, part.text, "array<variant>"), lambda p: F.coalesce(_get(p, part.part), F.lit(""))), "")
            text = F.coalesce(parts, text)
        return F.struct(role(_get(x, part.role)).alias("role"), F.coalesce(text, F.lit("")).alias("text"))

    found = []
    for part in layout.turns:
        if isinstance(part, Each):
            elements = _get(v, part.array, "array<variant>") if part.array else F.array(v)
            found.append(F.coalesce(F.transform(elements, partial(of, part)), F.array().cast("array<struct<role:string,text:string>>")))
        else:
            there = [_get(v, p) for p in part.paths]
            text = F.array_join(F.filter(F.array(*there), lambda x: x.isNotNull() & (x != "")), "\n")
            turn = F.array(F.struct(F.lit(part.role).alias("role"), text.alias("text")))
            # a system turn is there only if it says something
            found.append(F.when((text != "") | F.lit(part.role != "system"), turn).otherwise(F.slice(turn, 1, 0)))
    return F.concat(*found)


def canonical(records: DataFrame, id: str = "conv_id", record: str = "record", layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """A row for each turn: id, layout, place (of the record), pos (in the record), role, text.
    A record that fits no layout, or has no turns, is one row without pos."""
    known = sorted({p for x in layouts for s in x.path_sets() for p in s})
    v = F.col("_v")
    by_hash: dict[str, str] = {}
    for x in layouts:
        for s in x.path_sets():
            if by_hash.setdefault("\n".join(s), x.name) != x.name:
                raise ValueError(f"{by_hash['\n'.join(s)]} and {x.name} have the same paths: {s}")
    table = F.create_map(*chain.from_iterable((F.xxhash64(F.lit(p)), F.lit(name)) for p, name in by_hash.items()))
    rows = records.select(F.col(f"`{id}`").alias("id"), F.col(f"`{record}`").alias("_v"))
    rows = rows.withColumn("fingerprint", fingerprint(known_paths(F.schema_of_variant(v), known)))
    rows = rows.withColumn("layout", F.element_at(table, F.col("fingerprint")))
    turns, place = F.lit(None), F.lit(None).cast("long")
    for x in layouts:
        here = F.col("layout") == x.name
        turns = F.when(here, _turns(v, x)).otherwise(turns)
        if x.order:
            place = F.when(here, _get(v, x.order, "long")).otherwise(place)
    rows = rows.select("id", "fingerprint", "layout", place.alias("place"), turns.alias("turns"))
    return rows.select("id", "fingerprint", "layout", "place", F.posexplode_outer("turns").alias("pos", "turn")).select(
        "id", "fingerprint", "layout", "place", "pos", "turn.role", "turn.text"
    )


@dataclass(frozen=True)
class Template:
    """A turn is open, role, middle, text, close. In roles and texts a backslash stands before
    each backslash, and inside each control string after its first character, so that neither
    a control string nor the closing mark is ever read there."""

    open: str = "### "
    middle: str = ":\n"
    close: str = "</turn>\n"
    controls: tuple[str, ...] = ("###", "</turn>")

    def __post_init__(self) -> None:
        for mark in (*self.controls, self.middle, self.close):
            if len(mark) < 2 or "\\" in mark:
                raise ValueError(f"a mark has two characters or more and no backslash: {mark!r}")
        if not any(c in self.close for c in self.controls):
            raise ValueError("the closing mark must hold a control string")
        for mark in (self.middle, self.close):
            if any(mark.endswith(mark[:n]) for n in range(1, len(mark))):
                raise ValueError(f"a mark must not end as it begins: {mark!r}")
        if self.close[0] in self.open + self.middle or self.middle[0] in self.close:
            raise ValueError("the marks must begin with characters of their own")

    def _escaped(self, text: Column, controls: tuple[str, ...]) -> Column:
        out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
        for c in controls:
            out = F.regexp_replace(out, rf"(?<=\Q{c[0]}\E)(?=\Q{c[1:]}\E)", r"\\")
        return out

    def role(self, role: Column) -> Column:
        return self._escaped(role, (*self.controls, self.middle))

    def text(self, text: Column) -> Column:
        return self._escaped(text, self.controls)

    def plain(self, text: Column) -> Column:
        return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def formatted(turns: DataFrame, template: Template = Template(), trained: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row for each id of canonical(): formatted, the mask (for each turn, where its part
    under the loss begins in the turn and how many characters it has, 0 for turns of others),
    and unmatched, the number of records without a layout."""
    head = F.concat(F.lit(template.open), template.role(F.col("role")), F.lit(template.middle))
    rows = turns.select("id", "layout", "place", "pos", "role", head.alias("head"), template.text(F.col("text")).alias("body"))
    take = F.when(F.col("role").isin(*trained), F.length("body")).otherwise(0)
    piece = F.struct("place", "pos", F.concat("head", "body", F.lit(template.close)).alias("piece"), F.length("head").alias("skip"), take.alias("take"))
    # struct order puts nulls first; rows without a turn are not collected
    gathered = rows.groupBy("id").agg(
        F.sort_array(F.collect_list(F.when(F.col("pos").isNotNull(), piece))).alias("pieces"),
        F.count_if(F.col("layout").isNull()).alias("unmatched"),
    )
    return gathered.select(
        "id",
        F.array_join(F.col("pieces.piece"), "").alias("formatted"),
        F.arrays_zip(F.col("pieces.skip").alias("skip"), F.col("pieces.take").alias("take")).alias("mask"),
        "unmatched",
    )


def read_back(texts: DataFrame, template: Template = Template()) -> DataFrame:
    """From formatted texts and masks alone: id, turns (roles and texts), loss (the texts under
    the mask), formatted."""
    parts = F.split("formatted", rf"\Q{template.close}\E", -1)
    chunks = texts.select("id", "formatted", "mask", F.slice(parts, 1, F.size(parts) - 1).alias("chunks"))

    def turn(c: Column) -> Column:
        inner = F.substring(c, F.lit(len(template.open) + 1), F.length(c))
        at = F.instr(inner, F.lit(template.middle))
        return F.struct(
            template.plain(F.substring(inner, F.lit(1), at - 1)).alias("role"),
            template.plain(F.substring(inner, at + len(template.middle), F.length(inner))).alias("text"),
        )

    under = F.zip_with("chunks", "mask", lambda c, m: template.plain(F.substring(c, m["skip"] + 1, m["take"])))
    return chunks.select("id", "formatted", F.transform("chunks", turn).alias("turns"), under.alias("loss"))
