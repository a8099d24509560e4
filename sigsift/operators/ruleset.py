"""Large sets of rules against files: a one-pass index of literals, rules looked up by what it finds.

With a few dozen rules each is a term of one expression (``matching.hit_rules``).
With thousands, one substring test for each literal of each rule would read a
text thousands of times.  Here all literals form one trie-shaped pattern that is
tried at every position of the text once; what it finds names the rules that
may match, and only their patterns are run.  Rules stay data, an array and a map
beside the plan, so neither the plan nor its compiled code grows with them.

A rule without literals is a candidate in every file of its languages.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterable
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from sigsift.catalog import Rule, check_rules
from sigsift.config import ScanConfig
from sigsift.functions import text as tx

#: From this many rules on a scan uses the index.
LARGE = 200
#: So many alternatives of a position are tried one after the other.
GROUP = 4
_SPECIAL = set("\\^$.|?*+()[]{}-&~# ")


def trie_pattern(literals: Iterable[str]) -> str:
    """A pattern that finds, at every position, the longest literal that begins there; it is group 1 of a match without length."""
    root: dict = {}
    for literal in literals:
        node = root
        for char in literal:
            node = node.setdefault(char, {})
        node[""] = {}

    def escaped(char: str) -> str:
        return "\\" + char if char in _SPECIAL else char

    def branched(chars: list[str], node: dict) -> str:
        """Alternatives in groups of groups, each behind a class of its first characters, so that few are tried at a position."""
        if len(chars) <= GROUP:
            return "|".join(escaped(c) + written(node[c]) for c in chars)
        step = -(-len(chars) // GROUP)
        parts = [chars[n : n + step] for n in range(0, len(chars), step)]
        return "|".join(f"(?=[{''.join(map(escaped, p))}])(?:{branched(p, node)})" for p in parts)

    def written(node: dict) -> str:
        chars = sorted(c for c in node if c)
        if not chars:
            return ""
        if "" in node:
            return f"(?:{branched(chars, node)})?+"
        return escaped(chars[0]) + written(node[chars[0]]) if len(chars) == 1 else f"(?:{branched(chars, node)})"

    return f"(?=({written(root)}))"


def usable(config: ScanConfig) -> list[tuple[int, Rule]]:
    """(catalog position, rule) of the rules at or above the threshold that run; all their patterns are tried in one job."""
    check_rules(config.rules)
    return [(n, r) for n, r in enumerate(config.rules, 1) if r.severity >= config.threshold and not check_rules([r])]


@lru_cache(maxsize=8)
def literal_index(config: ScanConfig) -> Column:
    """The distinct literals of the rules in ``folded``: at each position the longest one, which stands for those it begins with."""
    literals = {x for _, r in usable(config) for x in r.literals}
    if not literals:
        return F.array().cast("array<string>")
    return F.array_distinct(F.regexp_extract_all("folded", F.lit(trie_pattern(literals)), F.lit(1)))


def _looked_up(table: dict[str, set[int]], key: Column) -> Column:
    """The numbers that the table, a constant in buckets by hash, has for a text."""
    none = F.array().cast("array<int>")
    if not table:
        return none
    buckets = [[] for _ in range(len(table))]
    for name, numbers in table.items():
        buckets[zlib.crc32(name.encode()) % len(buckets)].append({"name": name, "numbers": sorted(numbers)})
    bucket = F.get(tx.constant(buckets, "array<array<struct<name:string,numbers:array<int>>>>"), (F.crc32(key) % len(buckets)).cast("int"))
    return F.coalesce(F.flatten(F.transform(F.filter(bucket, lambda e: e["name"] == key), lambda e: e["numbers"])), none)


@lru_cache(maxsize=8)
def hit_rules(config: ScanConfig) -> Column:
    """Catalog positions, ascending, of the rules that match ``text``, as ``matching.hit_rules`` gives them."""
    by_literal, anywhere = defaultdict(set), defaultdict(set)
    languages = [[] for _ in config.rules]
    for n, rule in usable(config):
        languages[n - 1] = [*rule.languages, *(("unknown",) if "php" in rule.languages else ())]
        for literal in rule.literals:
            by_literal[literal].add(n)
        for language in () if rule.literals else languages[n - 1]:
            anywhere[language].add(n)
    # the longest literal at a position names the rules of those it begins with
    named = {x: set().union(*(by_literal[x[:k]] for k in range(1, len(x) + 1) if x[:k] in by_literal)) for x in by_literal}
    spoken = tx.constant(languages, "array<array<string>>")
    by_name = F.array_distinct(F.flatten(F.transform(literal_index(config), lambda x: _looked_up(named, x))))
    fitting = F.filter(by_name, lambda n: F.array_contains(F.element_at(spoken, n), F.col("language")))
    patterns = tx.constant([r.search_pattern for r in config.rules], "array<string>")
    candidates = F.array_sort(F.concat(fitting, _looked_up(anywhere, F.col("language"))))
    return F.filter(candidates, lambda n: F.rlike(F.col("text"), F.element_at(patterns, n)))
