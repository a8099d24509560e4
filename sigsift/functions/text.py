"""Text as columns: decoding, lines, folding, match positions."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters that end a line; CR, LF and CRLF do not stay in the line's text.
KEPT_BREAKS = "\u000b\u000c\u001c-\u001e\u0085\u2028\u2029"
# Both try one character class per position, which is faster than alternatives; CRLF is one break.
BREAK = f"[\r\n{KEPT_BREAKS}](?:(?<=\r)\n)?"
DROPPED_BREAK = "[\r\n](?:(?<=\r)\n)?"
SPACES = (
    "\t\n\u000b\u000c\r\u001c\u001d\u001e\u001f \u0085\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
SPACE = "[\\s\u001c-\u001f]"
BOM = "\ufeff"
BLOCK = 256


def decode(content: Column, max_bytes: int | None = None, nul_probe: int | None = None) -> Column:
    """UTF-8 text, bad bytes replaced.

    ``max_bytes`` reads the first bytes only; with ``nul_probe`` content that has
    a NUL among its first bytes is no text.
    """
    head = content
    if max_bytes is not None:
        head = F.when(F.octet_length(content) > max_bytes, F.substring(content, 1, max_bytes)).otherwise(content)
    text = F.make_valid_utf8(head.cast("string"))
    return text if nul_probe is None else F.when(~has_nul(content, nul_probe), text)


def has_nul(content: Column, first: int) -> Column:
    return F.contains(F.substring(content, 1, first), F.lit(b"\x00"))


def fold(text: Column) -> Column:
    """Lower case for substring tests, with the letters that match i and s when case is ignored."""
    plain = F.replace(F.replace(F.replace(text, F.lit("\u0130"), F.lit("i")), F.lit("\u0131"), F.lit("i")), F.lit("\u017f"), F.lit("s"))
    return F.lower(plain)


def sql_string(value: str) -> str:
    """A value as a string literal of Spark SQL."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def constant(value, kind: str) -> Column:
    """A constant of any size and type: it is one literal to the parser, and a value of the plan once folded."""
    return F.from_json(F.lit(json.dumps(value)), kind)


def sql_array(values) -> str:
    return "array(" + ", ".join(sql_string(v) for v in values) + ")"


def contains_any(folded: str, literals) -> str:
    """SQL test whether a column contains one of the literals; true when there are none."""
    return " OR ".join(f"contains({folded}, {sql_string(x)})" for x in literals) or "true"


def broken_lines(text: Column) -> Column:
    """The text cut at every break, CR/LF left out; an empty line at the end follows a final break."""
    return F.split(F.regexp_replace(text, f"([{KEPT_BREAKS}])", "$1\n"), DROPPED_BREAK, -1)


def line_texts(text: Column) -> Column:
    """The lines of a text without their CR/LF; at least one, no extra one after a final break."""
    parts = broken_lines(text)
    return F.transform(
        F.array(parts),
        lambda p: F.when((F.size(p) > 1) & (F.element_at(p, -1) == ""), F.slice(p, F.lit(1), F.size(p) - 1)).otherwise(p),
    )[0]


def line_count(text: Column) -> Column:
    breaks = F.regexp_count(text, F.lit(BREAK))
    closed = F.right(text, F.lit(1)).rlike(f"[\r\n{KEPT_BREAKS}]")
    return F.when(closed, breaks).otherwise(breaks + 1)


def running_sums(numbers: Column, block: int = 256) -> Column:
    """Sum of the elements before each element.

    Done block by block, so that growing the result array costs one block
    length per element and not the whole array's.
    """
    def grow(values: Column) -> Column:
        start = F.struct(F.lit(0).alias("total"), F.array().cast("array<int>").alias("seen"))
        return F.aggregate(
            values,
            start,
            lambda acc, x: F.struct(
                (acc["total"] + x).cast("int").alias("total"),
                F.concat(acc["seen"], F.array(acc["total"])).alias("seen"),
            ),
            lambda acc: acc["seen"],
        )

    def add(acc: Column, x: Column) -> Column:
        return (acc + x).cast("int")

    blocks = F.transform(
        F.sequence(F.lit(0), F.floor((F.size(numbers) - 1) / block).cast("int")),
        lambda b: F.slice(numbers, b * block + 1, F.lit(block)),
    )
    offsets = F.transform(F.array(blocks), lambda bs: grow(F.transform(bs, lambda b: F.aggregate(b, F.lit(0), add))))[0]
    return F.flatten(
        F.zip_with(blocks, offsets, lambda b, base: F.transform(grow(b), lambda x: (x + base).cast("int")))
    )


def line_starts(text: Column, lines: Column) -> Column:
    """0-based code point offset of every line of ``lines`` in ``text``."""
    broken = F.regexp_replace(text, f"([{KEPT_BREAKS}])", "$1\n")
    breaks = F.regexp_extract_all(broken, F.lit(DROPPED_BREAK), 0)
    lengths = F.zip_with(
        lines,
        breaks,
        lambda line, brk: F.length(line)
        + F.when(F.right(line, F.lit(1)).rlike(f"[{KEPT_BREAKS}]"), 0).otherwise(F.coalesce(F.length(brk), F.lit(0))),
    )
    return running_sums(F.slice(lengths, F.lit(1), F.size(lines)))


def spots(pieces: Column, found: Column) -> Column:
    """Start, line and column of every match.

    ``pieces`` is the text split at the matches, ``found`` the matches.  Each
    step adds the line breaks and the length of one stretch of text, so the
    text is walked once however many matches there are.
    """
    def measure(stretch: Column, match: Column) -> Column:
        # a CR right before a match that begins with LF is half of a break: the LF counts for both
        half = F.endswith(stretch, F.lit("\r")) & F.startswith(match, F.lit("\n"))
        counted = F.when(half, F.left(stretch, F.length(stretch) - 1)).otherwise(stretch)
        return F.transform(
            F.array(F.split(counted, BREAK, -1)),
            lambda parts: F.struct(
                F.length(stretch).alias("length"),
                (F.size(parts) - 1).alias("breaks"),
                (F.length(F.element_at(parts, -1)) + F.when(half, 1).otherwise(0)).alias("tail"),
            ),
        )[0]

    stretches = F.transform(
        found,
        lambda m, i: measure(
            F.when(i == 0, pieces[0]).otherwise(F.concat(F.get(found, i - 1), F.get(pieces, i))), m
        ),
    )
    nothing = F.array().cast("array<struct<start:int,line:int,col:int>>")
    def step(acc: Column, s: Column) -> Column:
        start = acc["start"] + s["length"]
        line = acc["line"] + s["breaks"]
        tail = F.when(s["breaks"] > 0, s["tail"]).otherwise(acc["tail"] + s["tail"])
        spot = F.struct(start.alias("start"), line.alias("line"), (tail + 1).alias("col"))
        return F.struct(
            start.alias("start"), line.alias("line"), tail.alias("tail"),
            F.concat(acc["seen"], F.array(spot)).alias("seen"),
        )

    def walk(block: Column, state: Column) -> Column:
        """The spots of a block, from the state before it."""
        opened = F.struct(state["start"].alias("start"), state["line"].alias("line"), state["tail"].alias("tail"), nothing.alias("seen"))
        return F.aggregate(block, opened, step, lambda acc: acc["seen"])

    # an array that grows by every match would be copied for each: blocks are walked once for
    # the states between them and once for their spots
    def move(acc: Column, s: Column) -> Column:
        return F.struct(
            (acc["start"] + s["length"]).alias("start"), (acc["line"] + s["breaks"]).alias("line"),
            F.when(s["breaks"] > 0, s["tail"]).otherwise(acc["tail"] + s["tail"]).alias("tail"),
        )

    def cross(acc: Column, block: Column) -> Column:
        return F.struct(F.aggregate(block, acc["at"], move).alias("at"), F.concat(acc["states"], F.array(acc["at"])).alias("states"))

    def in_blocks(all_stretches: Column) -> Column:
        blocks = F.transform(
            F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size(all_stretches) - 1) / BLOCK).cast("int"))),
            lambda b: F.slice(all_stretches, b * BLOCK + 1, F.lit(BLOCK)),
        )
        at = F.struct(F.lit(0).alias("start"), F.lit(1).alias("line"), F.lit(0).alias("tail"))
        none = F.array().cast("array<struct<start:int,line:int,tail:int>>")
        return F.transform(
            F.array(blocks),
            lambda bs: F.flatten(
                F.zip_with(bs, F.aggregate(bs, F.struct(at.alias("at"), none.alias("states")), cross, lambda acc: acc["states"]), walk)
            ),
        )[0]

    return F.transform(F.array(stretches), in_blocks)[0]


def spot_at(text: Column, start: Column) -> Column:
    """Line and column of one 0-based offset."""
    return F.transform(
        F.array(F.split(F.substring(text, F.lit(1), start), BREAK, -1)),
        lambda parts: F.struct(
            start.alias("start"), F.size(parts).alias("line"), (F.length(F.element_at(parts, -1)) + 1).alias("col")
        ),
    )[0]


def first_start(text: Column, pattern: str) -> Column:
    """0-based offset of the first match, null without one."""
    return F.transform(
        F.array(F.split(text, pattern, 2)), lambda p: F.when(F.size(p) > 1, F.length(F.element_at(p, 1)))
    )[0]


def strip(text: Column) -> Column:
    return F.trim(text, F.lit(SPACES))


def strip_end(text: Column) -> Column:
    """Drop trailing white space.  Trimming is linear; a pattern would try every run of spaces in the text."""
    return F.rtrim(text, F.lit(SPACES))


def fixed(number: Column, places: int) -> Column:
    """A number with so many decimals, no grouping, rounded on its exact binary value."""
    return F.call_function("format_number", number, F.lit("0." + "0" * places))
