"""Conversations without quotations: quoted passages are linked to the messages they come from.

Lines that begin with ``>`` are quoted, each further ``>`` a level deeper; white
space between the marks is left out.  Lines of one level that follow each other
are a passage.  Passages are normalised (lower case, one space between words) and
hashed.  A quoted passage comes from the first message of its conversation whose
own words have such a passage, or which has it as one of its lines, if that
message stands before the quoting one.  A passage that is nowhere as a whole, a
trimmed or rewrapped one, comes from the message that first had most of it: its
lines, paragraphs and sentences are looked up, and those of one origin must hold
at least half of its words.

A message replies to the latest message that it quotes; one that quotes none to
the one before it.  A reply stands after what it replies to, so order of turns is
an order of replies; ``position`` numbers it from 1.  Lines that introduce a
quotation, ending in ``wrote:`` before a quoted line, go with it.

Null texts are empty messages.  Repeated rows stay, the one after the other.
Messages without a conversation or turn form a conversation of their own or come first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigsift.llm.common import whole
from sigsift.operators.ordering import with_ordinal
from sigsift.session import pin

MARKS = r"^[\x20\t]*+((?:>[\x20\t]?+)*+)"
PARAGRAPHS = "\n[\\x20\t]*\n"
SENTENCES = r"(?<=[.!?])\x20"
INTRODUCTION = r"(?i)\bwrote:[\x20\t]*$"


def parsed(text: Column) -> Column:
    """The lines of a text: array of (level, body, intro)."""
    lines = F.split(text, "\r?\n", -1)
    marks = F.transform(lines, lambda x: F.struct(F.length(F.regexp_replace(F.regexp_extract(x, MARKS, 1), "[^>]+", "")).alias("level"), x.alias("line")))
    return F.transform(marks, lambda x: F.struct(
        x["level"].alias("level"), F.when(x["level"] > 0, F.regexp_replace(x["line"], MARKS, "")).otherwise(x["line"]).alias("body"),
        F.rlike(x["line"], F.lit(INTRODUCTION)).alias("intro"),
    ))


def normal(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[\x20\x09-\x0D]+", " "))


def _conversation(conv: Column) -> Column:
    return F.when(conv.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), conv.cast("string")))


def _read(messages: DataFrame, conv: str, turn: str, text: str) -> DataFrame:
    """(_conv, _turn, _lines, _passages): lines as ``parsed`` gives them; passages as (level, text)."""
    frame = messages.select(_conversation(F.col(conv)).alias("_conv"), F.col(turn).alias("_turn"), parsed(whole(F.col(text))).alias("_lines"))
    level = lambda n: F.get("_lines", n)["level"]
    starts = F.filter(F.sequence(F.lit(0), F.size("_lines") - 1), lambda n: (n == 0) | (level(n) != level(n - 1)))
    frame = frame.withColumn("_starts", starts).withColumn("_bodies", F.transform("_lines", lambda x: x["body"]))
    def passage(start, n):
        end = F.coalesce(F.get("_starts", n + 1), F.size("_lines"))
        return F.struct(level(start).alias("level"), F.array_join(F.slice("_bodies", start + 1, end - start), "\n").alias("text"))
    return frame.select("_conv", "_turn", "_lines", F.transform("_starts", passage).alias("_passages"))


def _hash(text: Column) -> Column:
    """The hash of a passage; null for a blank one."""
    bare = normal(text)
    return F.when(bare != "", F.xxhash64(bare))


def _quoted(text: Column) -> Column:
    """What a quoted passage is looked up by: itself (kind 0), its lines, paragraphs and sentences; array of (passage, words, hash, kind, size)."""
    count = lambda x: F.size(F.split(normal(x), " "))
    parts = (F.array(text), F.split(text, "\n"), F.split(text, PARAGRAPHS), F.split(normal(text), SENTENCES))

    def piece(kind: int):
        return lambda x: F.struct(
            _hash(text).alias("passage"), count(text).alias("words"), _hash(x).alias("hash"), F.lit(kind).alias("kind"), count(x).alias("size")
        )

    return F.concat(*[F.transform(part, piece(kind)) for kind, part in enumerate(parts)])


def links(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", text: str = "text") -> DataFrame:
    """(_conv, _turn, reply_to, n_linked) for the messages that quote others: the latest turn quoted, the number of passages found.

    What moves is hashes of passages.  A passage has one origin, so nothing is paired within a conversation.
    """
    read = _read(messages, conv, turn, text)
    own = F.filter("_passages", lambda p: p["level"] == 0)
    said = F.concat(
        F.transform(own, lambda p: _hash(p["text"])), F.transform(F.filter("_lines", lambda x: x["level"] == 0), lambda x: _hash(x["body"])),
        F.flatten(F.transform(own, lambda p: F.transform(F.split(p["text"], PARAGRAPHS), _hash))),
        F.array(_hash(F.array_join(F.transform(own, lambda p: p["text"]), "\n"))),
    )
    told = F.flatten(F.transform(own, lambda p: F.transform(F.split(normal(p["text"]), SENTENCES), _hash)))
    spoken = F.concat(
        F.transform(said, lambda h: F.struct(h.alias("hash"), F.lit(True).alias("form"))),
        F.transform(told, lambda h: F.struct(h.alias("hash"), F.lit(False).alias("form"))),
    )
    known = lambda pieces: F.explode(F.array_distinct(F.filter(pieces, lambda x: x["hash"].isNotNull()))).alias("_piece")
    origins = (
        read.where("_turn IS NOT NULL").select("_conv", "_turn", known(spoken)).groupBy("_conv", F.col("_piece.hash").alias("_hash"))
        .agg(F.min(F.when(F.col("_piece.form"), F.col("_turn"))).alias("_whole"), F.min("_turn").alias("_part"))
    )
    quoted = F.flatten(F.transform(F.filter("_passages", lambda p: p["level"] > 0), lambda p: _quoted(p["text"])))
    asked = read.where(F.exists("_lines", lambda x: x["level"] > 0)).select("_conv", "_turn", known(quoted)).select("_conv", "_turn", "_piece.*")
    found = asked.join(origins, (asked["_conv"] == origins["_conv"]) & (asked["hash"] == origins["_hash"])).drop(origins["_conv"])
    found = found.withColumn("_origin", F.when(F.col("kind") == 0, F.col("_whole")).otherwise(F.col("_part"))).where("_origin < _turn")
    votes = found.groupBy("_conv", "_turn", "passage", "words", "kind", "_origin").agg(F.sum("size").alias("_size"))
    votes = votes.where((F.col("kind") == 0) | (F.col("_size") * 2 >= F.col("words")))
    best = F.max(F.struct((F.col("kind") == 0).alias("whole"), F.col("_size").alias("size"), F.col("_origin").alias("origin")))
    passages = votes.groupBy("_conv", "_turn", "passage").agg(best["origin"].alias("_origin"))
    return passages.groupBy("_conv", "_turn").agg(F.max("_origin").alias("reply_to"), F.count(F.lit(1)).alias("n_linked"))


def _unquoted(lines: Column) -> Column:
    """The lines a message has of its own: not quoted, and not the introduction of a quotation."""
    kept = F.filter(lines, lambda x, n: (x["level"] == 0) & ~(x["intro"] & F.coalesce(F.get(lines, n + 1)["level"] > 0, F.lit(False))))
    return F.array_join(F.transform(kept, lambda x: x["body"]), "\n")


def threaded(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, turn, role, position, reply_to, n_quoted, n_linked, text): every message without its quotations, and its place.

    ``reply_to`` is null for a message that quotes none before it: it replies to the message before.
    ``n_quoted`` counts quoted lines.  A text without quotations stays as it is.
    """
    keys = pin(messages.select(_conversation(F.col(conv)).alias("_conv"), F.col(turn).alias("_turn")).distinct())
    placed = with_ordinal(keys, "_conv", [F.col("_turn").asc_nulls_first()], "position")
    replies = links(messages, conv, turn, text).select(F.col("_conv").alias("_c"), F.col("_turn").alias("_t"), "reply_to", "n_linked")
    info = placed.join(replies, (F.col("_conv") == F.col("_c")) & (F.col("_turn") == F.col("_t")), "left").drop("_c", "_t")
    rows = messages.select(
        F.col(conv), F.col(turn), F.col(role), F.col(text).alias("_text"), _conversation(F.col(conv)).alias("_key"),
    ).withColumn("_lines", parsed(whole(F.col("_text"))))
    joined = rows.join(info, (F.col("_key") == F.col("_conv")) & F.col(turn).eqNullSafe(F.col("_turn")))
    count = F.size(F.filter("_lines", lambda x: x["level"] > 0))
    body = F.when(count > 0, F.trim(_unquoted(F.col("_lines")))).otherwise(whole(F.col("_text")))
    return joined.select(
        conv, turn, role, F.col("position").cast("long").alias("position"), "reply_to", count.alias("n_quoted"),
        F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"), body.alias(text),
    )
