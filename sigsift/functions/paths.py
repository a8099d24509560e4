"""Path columns: name, extension, language, depth, excluded directories."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from sigsift.catalog import quote
from sigsift.config import LANGUAGE_EXTENSIONS

# Grammar names by language.
GRAMMARS = {"php": "php", "js": "javascript", "ts": "typescript"}


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/", -1), -1)


def extension(path: Column) -> Column:
    """Lower-case suffix from the last dot; leading dots do not start one."""
    return F.lower(F.regexp_extract(file_name(path), r"^\.*[^.].*?(\.[^.]*)$", 1))


def language(ext: Column) -> Column:
    """Language of an extension; 'unknown' for others."""
    pairs = [(e, lang) for lang, group in LANGUAGE_EXTENSIONS.items() for e in group]
    table = F.create_map(*[F.lit(x) for pair in pairs for x in pair])
    return F.coalesce(F.try_element_at(table, ext), F.lit("unknown"))


def grammar(path: Column) -> Column:
    """Name of the highlighting grammar of a file; 'markup' for other files."""
    names = F.create_map(*[F.lit(x) for pair in GRAMMARS.items() for x in pair])
    return F.coalesce(F.try_element_at(names, language(extension(path))), F.lit("markup"))


def depth(path: Column) -> Column:
    return F.size(F.split(path, "/", -1))


def below(path: Column, root: str) -> Column:
    """The part of a file's address below a folder, whatever scheme and slashes the address begins with."""
    bare = re.sub("^[a-z0-9]+:/*", "", root.rstrip("/")).lstrip("/")
    return F.regexp_extract(path, "^(?:[a-z0-9]+:)?/*" + quote(bare) + "/(.*)$", 1)


def under_any(path: Column, names: Sequence[str]) -> Column:
    """Whether a directory on the way to the file has one of the names."""
    parts = F.split(path, "/", -1)
    return F.arrays_overlap(F.slice(parts, F.lit(1), F.size(parts) - 1), F.array(*[F.lit(n) for n in names]))
