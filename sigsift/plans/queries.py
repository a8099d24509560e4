"""Registered queries: every operator on the test corpus, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from sigsift.catalog import CRITICAL, HEURISTIC_ID, Rule, rules_frame
from sigsift.config import ScanConfig
from sigsift.functions import text as tx
from sigsift.functions.entropy import byte_counts, entropy_of
from sigsift.operators import duplicates, inventory, matching, metadata, reports, rescan, review, summary
from sigsift.operators.ordering import with_ordinal
from sigsift.plans.scan import ScanTables, findings_of_parts, scan
from sigsift.session import pin, shared_folder
from sigsift.sources import archives, corpus, parts
from sigsift.streaming import landing

DEFAULT = ScanConfig()
DEEP = ScanConfig(deep=True)
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def _scan(spark: SparkSession, sf: str, config: ScanConfig = DEFAULT) -> ScanTables:
    return scan(corpus.corpus_files(spark, sf), config)


def _deep(spark: SparkSession, sf: str) -> ScanTables:
    return scan(corpus.corpus_files(spark, sf).unionByName(corpus.packed_files(spark, sf)), DEEP)


def _listing(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.corpus_files(spark, sf, some_empty=True)


WHERE = ("scan_id", "path", "rule_id", "line_number", "match_column")


# --- sources and inventory


@query
def corpus_files(spark, sf):
    return corpus.corpus_files(spark, sf).select("scan_id", "path", "length", F.sha2("content", 256).alias("sha256"))


@query
def file_inventory(spark, sf):
    return inventory.scannable(_listing(spark, sf), DEFAULT).select(
        "scan_id", "path", "extension", "language", F.col("length").alias("size"), inventory.size_display(F.col("length")).alias("size_display")
    )


@query
def language_counts(spark, sf):
    return inventory.language_counts(_listing(spark, sf), DEFAULT)


@query
def skipped_files(spark, sf):
    return inventory.skipped(_listing(spark, sf), DEFAULT)


@query
def excluded_dirs(spark, sf):
    return inventory.excluded(_listing(spark, sf), DEFAULT)


def _chosen(spark, sf, config):
    return inventory.scannable(_listing(spark, sf), config).select("scan_id", "path", "language")


@query
def php_only(spark, sf):
    return _chosen(spark, sf, ScanConfig(php_only=True))


@query
def js_only(spark, sf):
    return _chosen(spark, sf, ScanConfig(js_only=True))


@query
def include_ext(spark, sf):
    return _chosen(spark, sf, ScanConfig(include_ext=("TWIG", ".md"), exclude_dirs=("a",)))


@query
def only_ext(spark, sf):
    return _chosen(spark, sf, ScanConfig(only_ext=("twig", ".inc")))


@query
def replaced_excludes(spark, sf):
    return _chosen(spark, sf, ScanConfig(only_exclude_dirs=("src",)))


@query
def inventory_partition(spark, sf):
    key = ("scan_id", "path")
    files = pin(_listing(spark, sf).select(*key, "length"))
    every = files.select(*key)
    outside = inventory.excluded(files, DEFAULT).select(*key)
    scanned = inventory.scannable(files, DEFAULT).select(*key)
    skipped = inventory.skipped(files, DEFAULT).select(*key)
    left = every.exceptAll(outside).exceptAll(scanned).exceptAll(skipped)
    both = scanned.intersect(skipped)
    parts = {"all": every, "excluded": outside, "scanned": scanned, "skipped": skipped, "neither": left, "both": both}
    out = None
    for name, frame in parts.items():
        row = frame.agg(F.count(F.lit(1)).alias("files")).select(F.lit(name).alias("part"), "files")
        out = row if out is None else out.unionByName(row)
    return out


@query
def text_gate(spark, sf):
    gated = ScanConfig(max_text_bytes=2 * 1024 * 1024, nul_probe_bytes=8192)
    decoded = matching.with_text(inventory.scannable(corpus.gated_files(spark, sf), gated), gated)
    return decoded.select(
        "scan_id", "path", F.col("text").isNotNull().alias("is_text"), F.coalesce(tx.line_count(F.col("text")), F.lit(0)).alias("lines")
    )


@query
def line_index(spark, sf):
    decoded = matching.with_text(inventory.scannable(corpus.corpus_files(spark, sf), DEFAULT), DEFAULT)
    lined = decoded.withColumn("file_lines", tx.line_texts(F.col("text"))).withColumn("starts", tx.line_starts(F.col("text"), F.col("file_lines")))
    rows = lined.select("scan_id", "path", F.posexplode_outer(F.arrays_zip("starts", "file_lines")).alias("n", "x"))
    return rows.select(
        "scan_id", "path", (F.col("n") + 1).alias("line_no"), F.col("x.starts").alias("start"), F.col("x.file_lines").alias("text")
    )


# --- matching


def _places(spark, sf, config):
    placed = matching.with_places(inventory.scannable(corpus.corpus_files(spark, sf), config), config)
    rows = placed.select("scan_id", "path", "language", F.explode_outer("places").alias("p")).where(F.col("p").isNotNull())
    rows = rows.select("scan_id", "path", "language", F.col("p.rule_ord").alias("rule_ord"), F.explode_outer("p.at").alias("s"))
    ids = rules_frame(spark, config.rules).select("rule_ord", "rule_id", "severity")
    return rows.join(F.broadcast(ids), "rule_ord").select(
        "scan_id", "path", "language", "rule_id", "severity",
        F.col("s.start").alias("match_start"), F.col("s.line").alias("line_number"), F.col("s.col").alias("match_column"),
    )


@query
def rule_hits(spark, sf):
    return _places(spark, sf, DEFAULT).groupBy("rule_id").agg(
        F.count(F.lit(1)).alias("matches"), F.countDistinct("scan_id", "path").alias("files")
    )


@query
def scan_counts(spark, sf):
    hit = matching.with_hits(inventory.scannable(corpus.corpus_files(spark, sf), DEFAULT), DEFAULT)
    return hit.groupBy("scan_id", "language").agg(
        F.count(F.lit(1)).alias("files"),
        F.count_if(F.size("hits") > 0).alias("hit_files"),
        F.sum(F.size("hits")).cast("bigint").alias("hits"),
    )


@query
def match_positions(spark, sf):
    return _places(spark, sf, DEFAULT).select("scan_id", "path", "rule_id", "match_start", "line_number", "match_column")


@query
def match_cap(spark, sf):
    return _places(spark, sf, ScanConfig(max_matches=1)).select("scan_id", "path", "rule_id", "match_start")


def _by_severity(spark, sf, config):
    found = _places(spark, sf, config)
    return found.groupBy("scan_id", "severity").agg(F.count(F.lit(1)).alias("matches"), F.countDistinct("rule_id").alias("rules"))


USER_RULES = (
    Rule("USER-001", "mail address of a test domain", CRITICAL, r"(?P<mail_box>[a-z0-9.]+)@mail\d\.example\.com", literals=("@MAIL",)),
    Rule("USER-002", "telephone number kept for fiction", CRITICAL, r"\+1 \(\d{3}\) 555-\d{4}"),
)
#: Every number of the range that is kept for fiction, a rule each.
NUMBER_RULES = tuple(
    Rule(f"NUMBER-{n:04d}", "listed telephone number", CRITICAL, rf"\) 555-{n:04d}\b", literals=(f"555-{n:04d}",)) for n in range(10_000)
)


@query
def user_rules(spark, sf):
    return _places(spark, sf, ScanConfig(rules=USER_RULES)).groupBy("rule_id").agg(
        F.count(F.lit(1)).alias("matches"), F.countDistinct("scan_id", "path").alias("files")
    )


LITERAL_RULES = (
    Rule("LITERAL-001", "country and area code", CRITICAL, "+1 (", is_regex=False), Rule("LITERAL-002", "mail host", CRITICAL, "@MAIL", is_regex=False),
    Rule("BROKEN-001", "no pattern of the engine's", CRITICAL, "+1 ("),
)


@query
def literal_rules(spark, sf):
    """Rules that are texts and no patterns; one that can't be compiled does not run."""
    return _places(spark, sf, ScanConfig(rules=LITERAL_RULES)).groupBy("rule_id").agg(
        F.count(F.lit(1)).alias("matches"), F.countDistinct("scan_id", "path").alias("files")
    )


@query
def rule_list(spark, sf):
    """A list of ten thousand numbers to look for, each a rule."""
    return _places(spark, sf, ScanConfig(rules=NUMBER_RULES)).groupBy("rule_id").agg(
        F.count(F.lit(1)).alias("matches"), F.countDistinct("scan_id", "path").alias("files")
    )


@query
def cut_notes(spark, sf):
    """What the cuts leave out when they are asked for: notes by kind."""
    limits = ScanConfig(max_text_bytes=4096, header_bytes=1024)
    noted = _scan(spark, sf, limits).facts.select(F.explode_outer("notes").alias("note")).where(F.col("note").isNotNull())
    return noted.groupBy(F.substring_index("note", ":", 1).alias("note")).agg(F.count(F.lit(1)).alias("files"))


@query
def severity_threshold(spark, sf):
    return _by_severity(spark, sf, ScanConfig(severity_threshold=CRITICAL))


@query
def quick_mode(spark, sf):
    return _by_severity(spark, sf, ScanConfig(quick=True))


@query
def unknown_language(spark, sf):
    """Files of other languages get the PHP rules."""
    found = _places(spark, sf, ScanConfig(include_ext=(".twig",)))
    return found.groupBy("language", "rule_id").agg(F.count(F.lit(1)).alias("matches"))


# --- context and suppression


@query
def context_lines(spark, sf):
    return _scan(spark, sf).all_findings.select(
        *WHERE, "line_content", F.array_join("context_before", "\n").alias("before"), F.array_join("context_after", "\n").alias("after")
    )


@query
def suppressed_findings(spark, sf):
    return _scan(spark, sf).all_findings.where("false_positive").select(*WHERE)


@query
def active_findings(spark, sf):
    return _scan(spark, sf).all_findings.where("NOT false_positive").select(*WHERE)


# --- detectors


@query
def file_entropy(spark, sf):
    files = corpus.corpus_files(spark, sf).unionByName(corpus.packed_files(spark, sf))
    return inventory.scannable(files, DEFAULT).select("scan_id", "path", entropy_of(byte_counts("content")).alias("entropy"))


@query
def group_entropy(spark, sf):
    return duplicates.group_entropy(inventory.scannable(corpus.corpus_files(spark, sf), DEFAULT), "scan_id")


@query
def page_entropy(spark, sf):
    return duplicates.group_entropy(corpus.page_files(spark, sf), "scan_id")


@query
def heuristic_scores(spark, sf):
    # a condition on the score itself would be pushed down and evaluate its parts again
    return _scan(spark, sf).scanned.where("language = 'php'").select("scan_id", "path", "score")


@query
def heuristic_findings(spark, sf):
    found = _scan(spark, sf).all_findings.where(F.col("rule_id") == HEURISTIC_ID)
    return found.select(*WHERE, "severity", "match_start", "description")


@query
def entropy_findings(spark, sf):
    found = scan(corpus.packed_files(spark, sf), DEEP).all_findings.where("rule_id = 'ENTROPY-001'")
    return found.select(*WHERE, "severity_label", "line_content")


@query
def all_findings(spark, sf):
    return _deep(spark, sf).all_findings.groupBy("rule_id", "severity_label").agg(
        F.count(F.lit(1)).alias("findings"), F.count_if("false_positive").alias("suppressed")
    )


@query
def chunked_findings(spark, sf):
    """The findings of all files, read in parts of two thousand bytes."""
    files = corpus.corpus_files(spark, sf).unionByName(corpus.packed_files(spark, sf))
    return findings_of_parts(parts.cut(files.select("scan_id", "path", "content"), 2000), DEEP).groupBy("rule_id", "severity_label").agg(
        F.count(F.lit(1)).alias("findings"), F.count_if("false_positive").alias("suppressed")
    )


# --- packages


@query
def package_metadata(spark, sf):
    return metadata.package_metadata(corpus.corpus_files(spark, sf), DEFAULT)


@query
def report_slug(spark, sf):
    """Report names of packages, from their metadata or else from their archive's name."""
    status = _scan(spark, sf).status
    name = metadata.display_name(F.col("plugin_name"), F.concat(F.lit("/in/My Pack_"), "scan_id", F.lit(".ZIP")))
    return status.select("scan_id", name.alias("plugin_name"), metadata.report_slug(name).alias("slug"))


@query
def nothing_scannable(spark, sf):
    """Packages with a name, and without, none of whose files is of a kind that is scanned."""
    files = corpus.corpus_files(spark, sf)
    return scan(files, ScanConfig(only_ext=(".vue",))).status.select("scan_id", "files_found", "message", "fatal")


@query
def report_ids(spark, sf):
    """The number of each package's report for a run at a given time."""
    run_time = F.lit("2026-01-01T00:00:00Z")
    return _scan(spark, sf).status.select("scan_id", reports.report_id(F.col("scan_id"), run_time).alias("report_id"))


@query
def scan_status(spark, sf):
    return scan(_listing(spark, sf), ScanConfig(include_ext=(".twig",))).status.select(
        "scan_id", "plugin_name", "files_found", "files_skipped", "message", "fatal"
    )


@query
def valid_scans(spark, sf):
    return _scan(spark, sf).pinned().findings.groupBy("scan_id").agg(F.count(F.lit(1)).alias("findings"))


@query
def archive_files(spark, sf):
    """Archives of equal names in two folders; one in thirteen reaches outside and is refused."""
    files, _ = archives.expand(corpus.document_archives(spark, sf))
    return files.select("scan_id", "path", "length", F.sha2("content", 256).alias("sha256"))


@query
def archive_errors(spark, sf):
    _, errors = archives.expand(corpus.document_archives(spark, sf))
    return errors.select("scan_id", "message", "fatal")


@query
def archive_gate(spark, sf):
    return archives.gate(corpus.archive_members(spark, sf))


# --- summaries


@query
def severity_summary(spark, sf):
    return summary.severity_counts(_scan(spark, sf).all_findings).drop("penalty")


@query
def scan_grades(spark, sf):
    return _scan(spark, sf).pinned().grades


@query
def scan_totals(spark, sf):
    return summary.scan_totals(_scan(spark, sf).scanned)


@query
def finding_details(spark, sf):
    records = reports.finding_records(_scan(spark, sf).all_findings)
    lists = ("context_before", "context_after", "step_by_step_fix")
    return records.withColumns({c: F.array_join(c, "\n") for c in lists})


@query
def finding_order(spark, sf):
    found = with_ordinal(_scan(spark, sf).pinned().all_findings, "scan_id", summary.order_keys(), "ordinal")
    return found.select("scan_id", "ordinal", "severity", "path", "line_number", "rule_id", "match_start")


@query
def top_findings(spark, sf):
    return summary.top_findings(_scan(spark, sf).pinned().all_findings).select("scan_id", "rank", "path", "rule_id", "line_number", "match_start", "more")


@query
def rule_rollup(spark, sf):
    return summary.rule_rollup(_scan(spark, sf).all_findings)


@query
def cwe_summary(spark, sf):
    return summary.cwe_summary(_scan(spark, sf).all_findings)


@query
def language_rollup(spark, sf):
    return summary.language_rollup(_scan(spark, sf).all_findings)


@query
def duplicate_content(spark, sf):
    doubled = corpus.corpus_files(spark, sf).unionByName(
        corpus.document_files(spark, sf).withColumn("scan_id", F.concat(F.lit("copy-"), F.substring("scan_id", 4, 1)))
    )
    return duplicates.duplicate_content(doubled, DEFAULT)


@query
def distinct_scan(spark, sf):
    doubled = corpus.corpus_files(spark, sf).unionByName(
        corpus.document_files(spark, sf).withColumn("scan_id", F.concat(F.lit("copy-"), "scan_id"))
    )
    found = duplicates.findings_by_content(doubled, DEFAULT)
    return found.groupBy("scan_id", "rule_id").agg(
        F.count(F.lit(1)).alias("findings"), F.count_if("false_positive").alias("suppressed"), F.sum("line_number").alias("line_sum")
    )


@query
def rescan_findings(spark, sf):
    """Findings after the corpus has grown: half of the files were scanned before and are looked up."""
    folder, files = shared_folder(spark), corpus.corpus_files(spark, sf)
    rescan.rescan(files.where(F.crc32("path") % 2 == 0), folder)
    return rescan.rescan(files, folder).groupBy("scan_id", "rule_id").agg(
        F.count(F.lit(1)).alias("findings"), F.count_if("false_positive").alias("suppressed"), F.sum("line_number").alias("line_sum")
    )


# --- review


def _batched(spark, sf):
    tables = _scan(spark, sf).pinned()
    return tables, review.batches(tables.all_findings)


@query
def review_batches(spark, sf):
    _, batched = _batched(spark, sf)
    return batched.select("scan_id", "batch_no", "pos", "path", "rule_id", "line_number", "match_start")


@query
def review_prompts(spark, sf):
    _, batched = _batched(spark, sf)
    return review.prompts(batched)


@query
def parse_verdicts(spark, sf):
    _, batched = _batched(spark, sf)
    return review.parse_responses(corpus.responses(batched))


def _judged(spark, sf):
    tables, batched = _batched(spark, sf)
    return tables, review.apply_verdicts(tables.all_findings, batched, corpus.responses(batched))


@query
def apply_verdicts(spark, sf):
    _, judged = _judged(spark, sf)
    return judged.select("scan_id", "path", "rule_id", "match_start", "false_positive", "ai_confirmed", "ai_analysis")


@query
def grade_after_review(spark, sf):
    tables, judged = _judged(spark, sf)
    return summary.scan_grades(tables.scans, judged).select("scan_id", "total", "suppressed", "score", "grade")


@query
def review_cost(spark, sf):
    return summary.review_cost(_scan(spark, sf).pinned().grades, "some-model")


@query
def review_wide_context(spark, sf):
    return review.wide_prompts(_scan(spark, sf, ScanConfig(wide_lines=review.WIDE_LINES)).all_findings)


# --- reports


@query
def json_report(spark, sf):
    return _scan(spark, sf).pinned().json_report


@query
def markdown_report(spark, sf):
    return _scan(spark, sf).pinned().markdown_report


# --- streams


def _landed(spark, sf):
    """The corpus as a stream: whole table, file k arrives at the time of event k."""
    # a table is a file or a folder of files; a stream reads a single file only where its path is a pattern
    stamped = spark.readStream.schema("doc_id bigint, text string, lang string, source string, n_chars bigint").parquet(f"{sf}/documents.parque[t]")
    events = spark.read.parquet(f"{sf}/events.parquet").select(F.col("event_id").alias("doc_id"), "ts")
    return corpus.files_of(stamped.join(events, "doc_id", "left"), [F.coalesce(F.col("ts").cast("timestamp"), F.timestamp_seconds(F.lit(0))).alias("arrived")])


def _run(stream: DataFrame, mode: str, folder: str | None = None) -> DataFrame:
    """Run a stream over what is there and return what it wrote, with its batch number; a folder of an earlier run has its state."""
    spark = stream.sparkSession
    folder = folder or shared_folder(spark)

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{folder}/out/_batch_no={number}")

    handle = (
        stream.writeStream.outputMode(mode).foreachBatch(keep)
        .option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    )
    handle.awaitTermination()
    rows = T.StructType([*stream.schema, T.StructField("_batch", T.IntegerType())])
    try:
        return spark.read.schema(rows).parquet(f"{folder}/out").drop("_batch_no")
    except AnalysisException as missing:
        if missing.getCondition() == "PATH_NOT_FOUND":  # nothing has arrived
            return spark.createDataFrame([], rows)
        raise


@query
def stream_findings(spark, sf):
    found = landing.stream_findings(_landed(spark, sf), DEFAULT)
    return _run(found.select(*WHERE), "append").drop("_batch")


@query
def stream_grades(spark, sf):
    graded = landing.running_grades(landing.stream_facts(_landed(spark, sf), DEFAULT))
    latest = _run(graded.select("scan_id", "total", "suppressed", "score", "grade"), "update")
    return latest.groupBy("scan_id").agg(
        *[F.max_by(c, "_batch").alias(c) for c in ("total", "suppressed", "score", "grade")]
    )


@query
def stream_status(spark, sf):
    stated = landing.running_status(landing.stream_facts(_landed(spark, sf), DEFAULT))
    latest = _run(stated.select("scan_id", "files_scanned", "fatal"), "update")
    return latest.groupBy("scan_id").agg(*[F.max_by(c, "_batch").alias(c) for c in ("files_scanned", "fatal")])


@query
def stream_once(spark, sf):
    twice = _landed(spark, sf)
    again = twice.unionByName(_landed(spark, sf).withColumn("arrived", F.col("arrived") + F.expr("INTERVAL 1 MINUTE")))
    kept = landing.once(again, "1 day")
    return _run(kept.select("scan_id", "path"), "append").groupBy("scan_id").agg(F.count(F.lit(1)).alias("files"))


@query
def stream_valid(spark, sf):
    """Findings of packages with a name, joined with the names as both arrive."""
    folder = shared_folder(spark)
    names = corpus.metadata_files(spark, sf).withColumn("arrived", F.lit("2024-01-01").cast("timestamp"))
    names.select("scan_id", "path", "length", "content", "arrived").write.parquet(folder)
    both = lambda: _landed(spark, sf).unionByName(landing.landing_tables(spark, folder))
    found = landing.findings_of_valid(both(), DEFAULT, both(), "100000 days")
    return _run(found.select(*WHERE), "append").drop("_batch")


@query
def stream_regrade(spark, sf):
    """Grades after all files were delivered a second time with other texts; the first version has a finding more in each."""
    folder, log = shared_folder(spark), shared_folder(spark)
    files = corpus.document_files(spark, sf)
    older = files.withColumn("content", F.concat(F.lit(b"phpinfo();\n"), "content")).withColumn("length", F.octet_length("content").cast("bigint"))
    out = None
    for number, version in enumerate((older, files)):
        version.withColumn("arrived", F.timestamp_seconds(F.lit(number))).select("scan_id", "path", "length", "content", "arrived").write.mode("append").parquet(folder)
        facts = landing.stream_facts(landing.landing_tables(spark, folder), DEFAULT, ("arrived",))
        out = _run(landing.last_counts(landing.file_counts(facts)), "update", log)
    latest = out.groupBy("scan_id", "path").agg(F.max_by(F.struct(*landing.COUNTED), "_batch").alias("last")).select("scan_id", "path", "last.*")
    return landing.regraded(latest).select("scan_id", "total", "suppressed", "score", "grade")


def _windowed(spark, sf, windowed, **kw):
    counted = windowed(landing.stream_findings(_landed(spark, sf), DEFAULT, ("arrived",)), **kw)
    rows = _run(counted, "complete")
    last = rows.where(F.col("_batch") == rows.agg(F.max("_batch")).first()[0])
    return last.select("scan_id", F.unix_seconds("from_time").alias("from_second"), F.unix_seconds("to_time").alias("to_second"), "findings")


@query
def stream_sliding(spark, sf):
    """Active findings per package in windows of six hours, one beginning every two."""
    return _windowed(spark, sf, landing.sliding, length="6 hours", every="2 hours")


@query
def stream_sessions(spark, sf):
    """Active findings per package and session of arrivals less than three hours apart."""
    return _windowed(spark, sf, landing.sessions, gap="3 hours")
