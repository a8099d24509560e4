"""Scans of files in parts: a file of any size covers as many tasks as it has parts.

A file is cut anew where no match can go on: behind a semicolon that ends a line.
Most signatures hold no semicolon, so nothing of theirs is open there.  The few
that read on to a bracket, a quote or a backtick could be: a cut is only made
where, for each of them, the file has no opening at all, or a delimiter stands
in the text before the cut with no opening behind it.  Between two cuts the text
is one piece and is searched like a small file, so findings are those of the
whole file whatever the parts were; a stretch of a file without a safe place
stays in one piece.

Every piece but a file's last has as many lines as any finding looks at either
side, so one neighbour has all of its surroundings.  Offsets, line numbers and
the file's facts (entropy, signals of the heuristic) are totals over narrow rows,
one a piece; text is moved to put pieces together and never sorted by file.
Where text can be cut is found beside it and decided without it, and lines at a
piece's ends are kept for its neighbours only.  A table of text goes as soon as
the next is written, and so do shuffle files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigsift.catalog import RULES, Rule
from sigsift.config import SUPPRESS_LINES, ScanConfig
from sigsift.functions import text as tx
from sigsift.functions.entropy import byte_histogram, entropy_of
from sigsift.operators import detectors, matching
from sigsift.session import Scratch, attach

#: A cut is looked for in the first characters of a part, and decided on the text before it.
HEAD = 32_768
SIGHT = 4_096
FILE = ("scan_id", "path")
_BUILT_IN = frozenset(RULES)

# The signatures whose matches may hold a semicolon, by the delimiter that ends their run: the texts they open with.
OPENINGS = {
    "bracket": ("$wpdb", "ini_set", "error_reporting", "curl_setopt", "isset"),
    "quote": ("like", "preg_replace"),
    "index": ("$_get", "$_post", "$_request"),
    "backtick": ("`",),
    "hook": ("wp_ajax_",),
}
_CLOSED = {
    # behind the last bracket there is no opening; behind the last quote but one, for the last may be an opening's own
    "bracket": lambda sight: _none_behind(sight, r"\)[^)]*\z", OPENINGS["bracket"]),
    "quote": lambda sight: _none_behind(sight, r"""["'][^"']*["'][^"']*\z""", OPENINGS["quote"]),
    "index": lambda sight: _none_behind(sight, r"\][^\]]*\z", OPENINGS["index"]),
    "backtick": lambda sight: sight.rlike(r"`[^`]*\z") & ~sight.rlike(r"`\s*\$[^`]*\z"),
    # two hundred characters may follow the hook's name, which may have begun before the text in sight
    "hook": lambda sight: ~sight.rlike(r"(?:wp_ajax_|\A)\w*[\s\S]{0,200}\z"),
}


def _none_behind(sight: Column, last: str, openings: tuple[str, ...]) -> Column:
    behind = F.regexp_extract(sight, f"({last})", 1)
    none = F.lit(True)
    for opening in openings:
        none = none & ~F.contains(behind, F.lit(opening))
    return (behind != "") & none


def unfit(rules: tuple[Rule, ...]) -> list[str]:
    """Ids of the rules that are not known to stay within the cuts."""
    def fits(rule: Rule) -> bool:
        return rule in _BUILT_IN or rule.one_statement or (not rule.is_regex and ";" not in rule.pattern)

    return [r.rule_id for r in rules if not fits(r)]


def _around(config: ScanConfig) -> int:
    """The lines either side that a finding may look at."""
    return max(SUPPRESS_LINES, config.context_lines, config.wide_lines) + 1


def _ends(lines: int) -> Column:
    """Where ``text`` may be cut, in order, and which delimiters are closed there; at least so many lines stand before a cut."""
    head = F.left("text", F.lit(HEAD))
    rows = F.split(head, "\n", -1)
    ends = F.transform(
        F.array(rows),
        lambda r: F.zip_with(r, tx.running_sums(F.transform(r, lambda x: F.length(x) + 1)), lambda x, before: F.struct(x.alias("line"), (before + F.length(x) + 1).alias("end"))),
    )[0]
    # the last element is what follows the last line feed
    whole = F.slice(ends, F.lit(1), F.size(ends) - 1)
    late = F.slice(whole, F.lit(max(lines, 1)), F.greatest(F.size(whole) - max(lines, 1) + 1, F.lit(0)))
    ending = F.filter(late, lambda e: e["line"].rlike(r";[ \t]*\r?\z"))

    def judged(end: Column) -> Column:
        sight = F.array(tx.fold(F.substring(F.col("text"), F.greatest(F.lit(1), end - SIGHT + 1), F.least(end, F.lit(SIGHT)))))
        return F.transform(sight, lambda s: F.struct(end.alias("end"), *[closed(s).alias(name) for name, closed in _CLOSED.items()]))[0]

    return F.transform(F.transform(ending, lambda e: e["end"]), judged)


def _border() -> Column:
    """Of ``_ends`` the first where nothing that the file has is open, null without one."""
    def safe(end: Column) -> Column:
        tests = F.lit(True)
        for name in _CLOSED:
            tests = tests & (~F.col(f"has_{name}") | end[name])
        return tests

    return F.get(F.filter("_ends", safe), F.lit(0))["end"]


def pieces(parts: DataFrame, config: ScanConfig, scratch: Scratch | None = None) -> DataFrame:
    """(scan_id, path, piece, text, language, last) between safe cuts; ``piece`` is the number of the part it begins in, ``last`` that of the file's last one."""
    scratch = scratch or Scratch(parts.sparkSession)
    order = Window.partitionBy(*FILE).orderBy("part")
    text = parts.select(*FILE, "part", "language", tx.decode(F.col("content")).alias("text"))
    folded = tx.fold(F.col("text"))
    flags = {f"has_{n}": F.expr("false") for n in OPENINGS}
    for name, openings in OPENINGS.items():
        for opening in openings:
            flags[f"has_{name}"] = flags[f"has_{name}"] | F.contains(folded, F.lit(opening))
    kept = scratch.pin("kept", text.withColumns(flags | {"_ends": _ends(_around(config))}))
    key = F.concat_ws("\x00", *FILE)
    of_file = kept.groupBy(key.alias("_file")).agg(*[F.max(f).alias(f) for f in flags], F.first("language").alias("language"))
    cut = attach(kept.select(*FILE, "part", "_ends", key.alias("_file")), of_file, "_file", ["part"]).select(*FILE, "part", "language", _border().alias("_border"))
    # the piece that a part's head belongs to is the one that the last cut before it began; a file's first piece has no cut
    numbered = cut.withColumn("_number", F.row_number().over(order) - 1)
    begins = F.when((F.col("_number") == 0) | F.col("_border").isNotNull(), F.col("_number"))
    owned = numbered.withColumn("_begun", F.last(begins, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)))
    owned = owned.withColumn("_last", F.max(begins).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    border = F.when(F.col("_number") > 0, F.col("_border"))
    # narrow rows are looked up by hash, so text is not sorted to meet them
    split = kept.select(*FILE, "part", "text").join(owned.hint("shuffle_hash"), [*FILE, "part"]).select(
        *FILE, "_number", "language", "_last",
        F.explode(F.array(
            F.struct(F.coalesce("_begun", F.lit(0)).alias("piece"), F.when(border.isNull(), F.col("text")).otherwise(F.left("text", border)).alias("text")),
            F.struct(F.when(border.isNotNull(), F.col("_number")).alias("piece"), F.substring(F.col("text"), border + 1, F.length("text")).alias("text")),
        )).alias("_p"),
    ).where("_p.piece IS NOT NULL")
    split = scratch.pin("split", split.select(*FILE, "_number", "language", "_last", "_p.piece", "_p.text"))
    scratch.drop("kept")
    texts = F.array_sort(F.collect_list(F.struct("_number", "text"))).alias("_texts")
    gathered = split.groupBy(*FILE, "piece").agg(texts, F.first("language").alias("language"), F.first("_last").alias("last"))
    return gathered.select(*FILE, "piece", F.array_join(F.transform("_texts", lambda x: x["text"]), "").alias("text"), "language", "last")


def _shifted(findings: Column) -> Column:
    """Findings of a piece as findings of its file."""
    lines = F.col("line_offset") - F.col("lines_before")

    def move(f: Column) -> Column:
        # the entropy finding stands at no line
        at = lambda name, by: F.when(f["line_number"] == 0, f[name]).otherwise(f[name] + by).cast("int").alias(name)
        wide = F.when(f["wide"].isNotNull(), F.struct((f["wide"]["first_line"] + lines).cast("int").alias("first_line"), (f["wide"]["last_line"] + lines).cast("int").alias("last_line"), f["wide"]["text"].alias("text")))
        moved = {"match_start": at("match_start", F.col("char_offset")), "line_number": at("line_number", lines), "wide": wide.alias("wide")}
        names = ("rule_ord", "severity", "match_start", "line_number", "match_column", "line_content", "context_before", "context_after", "false_positive", "detail", "wide")
        return F.struct(*[moved.get(n, f[n].alias(n)) for n in names])

    return F.transform(findings, move)


def file_findings(parts: DataFrame, config: ScanConfig) -> DataFrame:
    """(scan_id, path, language, findings) of files in parts, for ``plans.scan.explode_findings``; several rows a file.

    ``parts`` has scan_id, path, part, content and language.  Matches beyond the
    2^31st character of a file have no position that fits and end the job.
    """
    if unfit(config.rules):
        raise ValueError(f"files in parts need rules with one_statement: {', '.join(unfit(config.rules))}")
    around = _around(config)
    scratch = Scratch(parts.sparkSession)
    rows = pieces(parts, config, scratch).withColumn("folded", tx.fold(F.col("text")))
    placed = rows.withColumn("hits", matching.hit_rules(config)).withColumn("places", matching.hit_places(config))
    lined = detectors.with_signals(placed).withColumn("own_lines", tx.line_texts(F.col("text")))
    # a file's ends have no neighbours
    ends = {
        "first_lines": F.when(F.col("piece") > 0, F.slice("own_lines", 1, around)),
        "last_lines": F.when(F.col("piece") < F.col("last"), F.slice("own_lines", F.greatest(F.lit(1), F.size("own_lines") - around + 1), F.lit(around))),
    }
    scanned = scratch.pin("scanned", lined.withColumns(ends | {"chars": F.length("text").cast("long"), "breaks": F.size("own_lines").cast("long")}).drop("folded", "own_lines", "last"))
    scratch.drop("split")

    order = Window.partitionBy(*FILE).orderBy("piece")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    none = F.array().cast("array<string>")
    facts = scanned.select(
        *FILE, "piece", "sig", "chars", F.coalesce(F.sum("chars").over(earlier), F.lit(0)).alias("char_offset"), F.coalesce(F.sum("breaks").over(earlier), F.lit(0)).alias("line_offset"),
        F.coalesce(F.lag("last_lines").over(order), none).alias("before"), F.coalesce(F.lead("first_lines").over(order), none).alias("after"),
        (F.row_number().over(order) == 1).alias("leads"),
    )
    facts = scratch.pin("facts", facts)
    # the file's signals are the earliest of its pieces'
    names = [s.name for s in detectors.SIGNALS]
    earliest = [F.min(F.col(f"sig.{n}") + F.col("char_offset")).alias(n) for n in names]
    signals = facts.groupBy(*FILE).agg(F.struct(*earliest, F.max("sig.long_line").alias("long_line")).alias("of_file"))
    # a row per part and, of each task, a row per file: 256 sums
    counts = parts.select(*FILE, byte_histogram("content").alias("_n")).groupBy(*FILE).agg(*[F.sum(F.get("_n", F.lit(n))).alias(f"_{n}") for n in range(256)])
    entropies = scratch.pin("entropies", counts.select(*FILE, entropy_of(F.array(*[f"_{n}" for n in range(256)])).alias("entropy")))
    first = F.coalesce(F.array_min(F.array(*[F.col(f"of_file.{n}") for n in names])), F.lit(0))
    holds = (first >= F.col("char_offset")) & (first < F.col("char_offset") + F.col("chars"))
    local = F.struct(*[(F.col(f"of_file.{n}") - F.col("char_offset")).cast("int").alias(n) for n in names], F.col("of_file.long_line").alias("long_line"))
    known = facts.drop("sig").join(signals, list(FILE)).join(entropies, list(FILE))
    placed_facts = scratch.pin("placed", known.select(
        *FILE, "piece", "char_offset", "line_offset", "before", "after", F.when(F.col("leads"), F.col("entropy")).alias("leading_entropy"),
        "entropy", F.when(holds, local).alias("sig"),
    ))
    scratch.drop("facts", "entropies")

    whole = scanned.drop("sig", "chars", "breaks", "first_lines", "last_lines").join(placed_facts.hint("shuffle_hash"), [*FILE, "piece"])
    heuristic = detectors.heuristic()
    whole = whole.withColumn("lines_before", F.size("before")).withColumn("file_lines", F.concat("before", tx.line_texts(F.col("text")), "after"))
    whole = whole.withColumn("points", F.when(F.col("sig").isNotNull() & (F.col("language") == "php"), heuristic["score"])).withColumn("signals", heuristic["signals"])
    below = F.transform("places", lambda p: F.struct(
        p["rule_ord"].alias("rule_ord"),
        F.transform(p["at"], lambda s: F.struct(s["start"].alias("start"), (s["line"] + F.col("lines_before")).alias("line"), s["col"].alias("col"))).alias("at"),
        p["cut"].alias("cut"),
    ))
    whole = whole.withColumn("places", below)
    found = F.concat(F.coalesce(matching.catalog_matches(config), F.array().cast(matching.MATCH_TYPE)), F.coalesce(detectors.heuristic_matches(config, "lines_before"), F.array().cast(matching.MATCH_TYPE)))
    leading = whole.withColumn("findings", found).withColumn("entropy", F.col("leading_entropy")).withColumn("more", F.coalesce(detectors.entropy_matches(config), F.array().cast(matching.MATCH_TYPE)))
    return leading.select(*FILE, "language", _shifted(F.concat("findings", "more")).alias("findings"))
