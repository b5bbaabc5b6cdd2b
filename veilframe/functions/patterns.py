"""Patterns in Java's dialect, and all matches of a pattern with their places, as columns."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as the fixed patterns mean it; Java's \\s is ASCII only.
BLANK = r"[\s\x{A0}\x{FEFF}\p{Z}]"
#: Marks around a match, and between what leads to it and itself; texts have blanks instead.
OPEN, LEAD, CLOSE = "\u0001", "\u0004", "\u0002"
#: Pieces of a marked text that one fold takes.
CHUNK = 256


def java(pattern: str, ignore_case: bool) -> str:
    pattern = pattern.replace(r"\s", BLANK)
    pattern = re.sub(r"(?<!\\)\$", r"\\z", pattern)
    return ("(?iu)" if ignore_case else "") + pattern


def union(patterns: tuple[str, ...], bounded: bool = False) -> str:
    found = "(?:" + "|".join(patterns) + ")"
    return r"(?<![\p{L}\p{N}])" + found + r"(?![\p{L}\p{N}])" if bounded else found


#: Characters that count as i or s where case is ignored, but that lower-casing leaves.
ODD_LETTERS = "ıİſ"
#: Letters of a word that are compared first.
BEGIN = 5


def stems(patterns: tuple[str, ...]) -> tuple[str, ...]:
    """The letters that each pattern begins with, up to BEGIN, in small letters. A pattern must
    begin with as many letters, none of them optional."""
    found = [re.match(rf"([A-Za-z]{{{BEGIN}}})(?![?*{{])", p) for p in patterns]
    return tuple(dict.fromkeys(m[1].lower() for m in found))


def literal(pattern: str) -> str:
    """The longest part that each match of a pattern holds as it stands, in small letters: letters
    and digits outside groups and classes, none of them optional. Empty: there is none."""
    parts, own, depth, at = [], "", 0, 0
    while at < len(pattern):
        c, size = pattern[at], 1
        if c == "\\":
            size = pattern.index("}", at) - at + 1 if pattern[at + 1] in "pPx" and pattern[at + 2 : at + 3] == "{" else 2
        elif c == "{":
            size = pattern.index("}", at) - at + 1
        elif c == "[":
            size = re.match(r"\[\^?\]?(?:\\.|[^\]\\])*\]", pattern[at:]).end()
        depth += {"(": 1, ")": -1}.get(c, 0)
        if c == "|" and depth == 0:
            return ""
        optional = pattern[at + size : at + size + 1] in ("?", "*", "{")
        if depth == 0 and c.isascii() and c.isalnum() and not optional:
            own += c
        else:
            parts.append(own)
            own = ""
        at += size
    return max((*parts, own), key=len).lower()


def literals(patterns: tuple[str, ...]) -> tuple[str, ...]:
    """Parts of which each match of one of the patterns holds at least one; none if a pattern has no such part."""
    found = sorted(dict.fromkeys(map(literal, patterns)), key=len)
    short = [x for n, x in enumerate(found) if not any(y in x for y in found[:n])]
    return () if "" in found else tuple(short)


def beginnings(low: Column) -> Column:
    """The first letters of all words of a text in small letters, three at least and BEGIN at most."""
    return F.regexp_extract_all(low, F.lit(f"([a-z]{{3,{BEGIN}}})[a-z]*+"), 1)


def _group(pattern: str) -> tuple[int, int] | None:
    """Where the capturing group of a pattern opens and closes."""
    depth, inside, begin, at = 0, False, None, 0
    opened = []
    while at < len(pattern):
        c = pattern[at]
        if c == "\\":
            at += 2
            continue
        if inside:
            inside = c != "]"
        elif c == "[":
            inside = True
        elif c == "(":
            opened.append(at)
            if pattern[at + 1] != "?" and begin is None:
                begin, depth = at, len(opened)
        elif c == ")":
            if begin is not None and len(opened) == depth:
                return begin, at
            opened.pop()
        at += 1
    return None


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), where value is worked out once, however often use names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def clean(text: Column) -> Column:
    """The text with blanks for the three marks; a null text is empty."""
    marks, own = f"[{OPEN}-{LEAD}]", F.coalesce(text, F.lit(""))
    return F.when(own.rlike(marks), F.regexp_replace(own, marks, " ")).otherwise(own)


def matches(text: Column, pattern: str, ignore_case: bool = False) -> Column:
    """array<struct<lead, start, end, text>> of all matches of a (fixed) pattern in text, in
    order. With a capturing group, start and end are the group's and lead is where the whole
    match starts. Places count characters from 0.

    The matches are marked by one replacement of the whole text, whose pieces then alternate
    between text outside and matches; their lengths give the places. Look-around sees the
    text as it is."""
    return places(marked(text, pattern, ignore_case))


def marked(text: Column, pattern: str, ignore_case: bool = False) -> Column:
    """The text with marks around all matches of a pattern."""
    at = _group(pattern)
    if at is None:
        return F.regexp_replace(text, java(f"({pattern})", ignore_case), f"{OPEN}{LEAD}$1{CLOSE}")
    a, b = at
    grouped = f"({pattern[:a]})({pattern[a + 1 : b]})({pattern[b + 1 :]})"
    return F.regexp_replace(text, java(grouped, ignore_case), f"{OPEN}$1{LEAD}$2{CLOSE}$3")


def last_place(text: Column, pattern: str, ignore_case: bool = True, place: str = "start") -> Column:
    """Where the last match (its group, if it has one) starts or ends, -1 if there is none."""
    mark = {"start": LEAD, "end": CLOSE}[place]
    found = marked(text, pattern, ignore_case)
    behind = F.length(F.translate(F.substring_index(found, mark, -1), OPEN + LEAD + CLOSE, ""))
    return F.when(F.contains(found, F.lit(mark)), F.length(text) - behind).otherwise(-1)


def places(text: Column) -> Column:
    """The matches that a marked text tells: see matches()."""
    empty = F.array().cast("array<struct<lead:int,start:int,end:int,text:string>>")

    def step(state: Column, piece: Column) -> Column:
        lead = F.instr(piece, LEAD)
        one = F.length(piece) - 1
        found = F.substring(piece, lead + 1, F.length(piece))
        row = F.struct(
            state["at"].alias("lead"), (state["at"] + lead - 1).alias("start"), (state["at"] + one).alias("end"), found.alias("text")
        )
        is_match = lead > 0
        return F.struct(
            (state["at"] + F.when(is_match, one).otherwise(F.length(piece))).alias("at"),
            F.when(is_match & (found != ""), F.concat(state["found"], F.array(row))).otherwise(state["found"]).alias("found"),
        )

    def chunks_of(p: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(p) - 1) / CHUNK).cast("int")), lambda c: F.slice(p, c * CHUNK + 1, CHUNK))

    def chunk(state: Column, some: Column) -> Column:
        done = F.aggregate(some, F.struct(state["at"].alias("at"), empty.alias("found")), step)
        return let(done, lambda d: F.struct(d["at"].alias("at"), F.concat(state["found"], F.array(d["found"])).alias("found")))

    # an array grows by a copy of itself, so no growing one is longer than a chunk or the number of chunks
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<array<struct<lead:int,start:int,end:int,text:string>>>").alias("found"))
    # a text is marked and cut once, however often its pieces are named
    return let(F.split(text, f"[{OPEN}{CLOSE}]"), lambda p: F.flatten(F.aggregate(chunks_of(p), begin, chunk, lambda s: s["found"])))


#: Abbreviations whose dot does not end a sentence (fixed values).
ABBREVIATIONS = (
    "n nn art artt c co d l lgs dott sig prot rif all cap pag tel cell fax ss ing avv geom arch rag prof"
).split()
#: A dot that ends a sentence; what stands before it is looked at where there is a dot only.
FINAL_DOT = r"(?iu)\.(?=[\s\x{A0}\p{Z}]|\z)(?<!\p{L}\.\p{L}\.)(?<!(?:^|[\s\x{A0}\p{Z}])(?:" + "|".join(ABBREVIATIONS) + r")\.)"
STOP = "\u0003"


def shadow(text: Column) -> Column:
    """The text, as long as before, with \\x03 for each dot that ends a sentence."""
    return F.regexp_replace(text, FINAL_DOT, STOP)


def slice_of(text: Column, a: Column, b: Column) -> Column:
    """Characters a (from 0) to b, like a half-open slice."""
    return F.substring(text, F.greatest(a, F.lit(0)) + 1, F.greatest(b - F.greatest(a, F.lit(0)), F.lit(0)))


def same_clause(shadowed: Column, a: Column, b: Column, lines: int | Column) -> Column:
    """No semicolon, end of sentence or empty line from a to b, and at most `lines` line ends."""
    part = slice_of(shadowed, a, b)
    breaks = F.length(part) - F.length(F.translate(part, "\n", ""))
    after = slice_of(shadowed, a, b + 1)
    return (
        ~part.contains(";") & ~part.contains(STOP) & (breaks <= lines) & (~after.contains("\n\n"))
    )


def extended(text: Column, shadowed: Column, start: Column, end: Column, before: Column, after: Column) -> Column:
    """struct<start, end>: the span grown to its clause, by at most before and after characters,
    without cutting words and without blanks at the ends."""
    inner, letter = r"[^;:,\n()•\[\]" + STOP + "]*", r"[\p{L}\p{N}]"
    whole = f"(?:(?<!{letter})|(?!{letter}))"  # not inside a word
    # one character more than may be taken stands beyond each slice; at an end of the text a line end
    left = F.concat(F.when(start - before < 1, "\n").otherwise(""), slice_of(shadowed, start - before - 1, start))
    right = F.concat(slice_of(shadowed, end, end + after + 1), F.lit("\n"))
    right = F.substring(right, F.lit(1), after + 1)
    taken_left = F.length(F.regexp_extract(left, f"(?s)(?<=.){whole}(?!{BLANK}){inner}\\z", 0))
    taken_right = F.length(F.regexp_extract(right, f"(?s)\\A{inner}(?<!{BLANK}){whole}(?=.)", 0))
    return F.struct((start - taken_left).alias("start"), (end + taken_right).alias("end"))
