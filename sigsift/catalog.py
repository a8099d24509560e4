"""Signature rules: the fixed catalog, the row type, and the rules table.

A rule is a row.  The patterns run inside the JVM with the flags in
``MATCH_FLAGS``: ignore case, multi-line, only LF ends a line, Unicode classes.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from sigsift.guidance import guidance_for

CRITICAL, HIGH, MEDIUM, LOW = 5, 4, 3, 2

# Label, report colour and grade penalty of each severity.
SEVERITY_LABELS = {5: "Critical", 4: "High", 3: "Medium", 2: "Low"}
SEVERITY_COLORS = {5: "#dc2626", 4: "#ea580c", 3: "#d97706", 2: "#2563eb"}
SEVERITY_PENALTY = {5: 25, 4: 12, 3: 5, 2: 2}

MATCH_FLAGS = "(?imdU)"
SUPPRESS_FLAGS = "(?idU)"

PHP = ("php",)
JS = ("js", "jsx", "ts", "tsx")


@dataclass(frozen=True)
class Run:
    """The parts of a pattern that, once opened, reads on to a delimiter that need not come.

    A plain search starts again at every opening, and each reads to the end of
    the text where the delimiter is absent.  With the parts known, the text is
    walked once: what an opening can't find before the next delimiter, no later
    opening before that delimiter finds either, so the walk goes on behind them
    all.  The pattern's match is ``opening`` and ``rest``.  That holds if
    ``opening`` has none of the characters ``until``, and if ``rest`` begins with
    characters other than those and matches behind an opening whenever it does
    behind a later one.  ``first`` has every character an opening begins with.
    """

    opening: str
    until: str
    rest: str
    first: str

    @property
    def pattern(self) -> str:
        """One match and what stands before it: groups 2 and 1.  It goes on where the last match ended."""
        match = self.opening + self.rest
        return rf"\G((?:[^{self.first}]++|(?!{match})(?:{self.opening}[^{self.until}]*+|[\s\S]))*+)({match})"


@dataclass(frozen=True)
class Rule:
    """One signature.

    ``literals`` are substrings, case ignored, of which a matching file always
    contains at least one; an empty tuple switches the prefilter off.  Patterns
    may be written for the JVM or with named groups as Python writes them.
    ``run`` has the parts of a pattern that reads on to a delimiter.
    ``one_statement`` says that no match holds a semicolon with a line feed and
    only blanks between, and none depends on what stands beyond; files in parts
    may then be cut there.
    """

    rule_id: str
    title: str
    severity: int
    pattern: str
    cwe: str = ""
    confidence: str = "high"
    languages: tuple[str, ...] = PHP
    literals: tuple[str, ...] = ()
    fp_patterns: tuple[str, ...] = ()
    is_regex: bool = True
    description: str = ""
    impact: str = ""
    layman_fix: str = ""
    step_by_step_fix: tuple[str, ...] = field(default=())
    recommendation: str = ""
    run: Run | None = None
    one_statement: bool = False

    def __post_init__(self):
        # the text that literals are looked for in is folded alike
        folded = tuple(x.replace("\u0130", "i").replace("\u0131", "i").replace("\u017f", "s").lower() for x in self.literals)
        object.__setattr__(self, "literals", folded)

    @property
    def jvm_pattern(self) -> str:
        return MATCH_FLAGS + (jvm_syntax(self.pattern) if self.is_regex else quote(self.pattern))

    @property
    def search_pattern(self) -> str:
        """The pattern that texts are searched with; where there is a run, matches are its group 2 and what stands before them group 1."""
        return MATCH_FLAGS + self.run.pattern if self.run else self.jvm_pattern

    @property
    def suppressors(self) -> list[str]:
        return [SUPPRESS_FLAGS + jvm_syntax(p) for p in self.fp_patterns]


def jvm_syntax(pattern: str) -> str:
    """Named groups and references to them as the JVM writes them; its names have letters and digits only."""
    names: dict[str, str] = {}
    def named(match: re.Match, form: str) -> str:
        return form.format(names.setdefault(match[1], match[1] if match[1].isalnum() else f"group{len(names) + 1}"))
    pattern = re.sub(r"\(\?P<(\w+)>", lambda m: named(m, "(?<{}>"), pattern)
    return re.sub(r"\(\?P=(\w+)\)", lambda m: named(m, "\\k<{}>"), pattern)


def quote(text: str) -> str:
    """A JVM regular expression that matches ``text`` itself."""
    return "\\Q" + text.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def _r(rule_id, severity, confidence, cwe, title, pattern, literals, suppress=(), languages=PHP) -> Rule:
    help_text = guidance_for(rule_id)
    return Rule(
        rule_id=rule_id,
        title=title,
        severity=severity,
        pattern=pattern,
        cwe=f"CWE-{cwe}",
        confidence=confidence,
        languages=languages,
        literals=tuple(literals.split()),
        fp_patterns=tuple(suppress),
        description=help_text["description"],
        impact=help_text["impact"],
        layman_fix=help_text["layman_fix"],
        step_by_step_fix=tuple(help_text["steps"]),
        recommendation=help_text["recommendation"],
        run=RUNS.get(rule_id),
    )


# The signatures that read on to a delimiter, by their parts: they match what the signature of the catalog matches.
RUNS = {
    "PHP-SQLI-002": Run(r"\$wpdb\s*->\s*(?:query|get_results|get_row|get_var|get_col)\s*\(", ")", r"[^)]*\.\s*\$", "$"),
    "PHP-SQLI-003": Run(r"\$wpdb\s*->\s*\w+\s*\(", ")", r"[^)]*\$_(?:GET|POST|REQUEST)\b", "$"),
    "PHP-XSS-002": Run(r"""\becho\s++["']?+""", ";", r"[^;]*\$(?!wpdb)\w+", "e"),
    "PHP-CSRF-001": Run(r"if\s*\(\s*isset\s*\(\s*\$_(?:POST|GET|REQUEST)\b", ")", r"[^)]*+\)\s*\)", "i"),
    "PHP-INFO-002": Run(r"(?:ini_set|error_reporting)\s*\(", ")", r"[^)]*(?:E_ALL|display_errors)", "ie"),
    "PHP-MALWARE-009": Run(r"curl_setopt\s*\(", ")", r"(?>[^)]*?CURLOPT_POSTFIELDS\s*+,)[^)]*\$_(?:GET|POST|REQUEST|COOKIE|SERVER)", "c"),
    "PHP-BP-001": Run(r"""\$_(?:GET|POST|REQUEST)\s*\[\s*['"]""", r"\]", r"""[^\]]+['"]\s*\](?!\s*\))""", "$"),
    "JS-AJAX-001": Run(r"(?:jQuery\.(?:ajax|post|get)|fetch|XMLHttpRequest)", r"\n", r".*admin-ajax\.php", "jfx"),
}


# Rule ids, severities, confidences, CWE numbers, titles, signatures and
# suppression patterns, in catalog order.  The three chain signatures use a possessive
# repeat: it matches the same text but cannot overflow the JVM's regex stack.
RULES: tuple[Rule, ...] = (
    _r("PHP-RCE-001", CRITICAL, "high", 94, "eval() with dynamic input", r"\beval\s*\(\s*\$", "eval"),
    _r("PHP-RCE-002", CRITICAL, "high", 506, "eval(base64_decode()) backdoor pattern", r"\beval\s*\(\s*base64_decode\s*\(", "eval"),
    _r("PHP-RCE-003", CRITICAL, "high", 506, "eval(gzinflate()) obfuscated payload", r"\beval\s*\(\s*gzinflate\s*\(", "eval"),
    _r("PHP-RCE-004", CRITICAL, "high", 94, "assert() used as code execution", r"\bassert\s*\(\s*\$", "assert"),
    _r("PHP-RCE-005", CRITICAL, "high", 94, "preg_replace with /e modifier", r"""preg_replace\s*\(\s*["'][^"']*\/e["']""", "preg_replace"),
    _r("PHP-RCE-006", HIGH, "medium", 94, "Dynamic function call via variable", r"\$\w+\s*\(\s*\$", "$"),
    _r("PHP-RCE-007", CRITICAL, "high", 94, "create_function() usage", r"\bcreate_function\s*\(", "create_function"),
    _r("PHP-RCE-008", HIGH, "medium", 94, "call_user_func with variable", r"\bcall_user_func(?:_array)?\s*\(\s*\$", "call_user_func"),
    _r("PHP-CMD-001", CRITICAL, "high", 78, "system() call", r"\bsystem\s*\(\s*\$", "system"),
    _r("PHP-CMD-002", CRITICAL, "high", 78, "exec() call", r"\bexec\s*\(\s*\$", "exec"),
    _r("PHP-CMD-003", CRITICAL, "high", 78, "passthru() call", r"\bpassthru\s*\(\s*\$", "passthru"),
    _r("PHP-CMD-004", CRITICAL, "high", 78, "shell_exec() or backticks", r"\bshell_exec\s*\(\s*\$|`\s*\$[^`]*`", "shell_exec `"),
    _r("PHP-CMD-005", CRITICAL, "high", 78, "popen() call", r"\bpopen\s*\(\s*\$", "popen"),
    _r("PHP-CMD-006", HIGH, "high", 78, "proc_open() call", r"\bproc_open\s*\(", "proc_open"),
    _r("PHP-SQLI-001", HIGH, "high", 89, "Direct variable in SQL query", r"""\$wpdb\s*->\s*(?:query|get_results|get_row|get_var|get_col)\s*\(\s*["'].*\$""", "$wpdb", (r"\$wpdb\s*->\s*prepare",)),
    _r("PHP-SQLI-002", HIGH, "high", 89, "String concatenation in SQL", r"\$wpdb\s*->\s*(?:query|get_results|get_row|get_var|get_col)\s*\([^)]*\.\s*\$", "$wpdb"),
    _r("PHP-SQLI-003", CRITICAL, "high", 89, "Raw $_GET/$_POST in SQL", r"\$wpdb\s*->\s*\w+\s*\([^)]*\$_(?:GET|POST|REQUEST)\b", "$wpdb"),
    _r("PHP-SQLI-004", MEDIUM, "high", 89, "Unsafe LIKE query", r"""LIKE\s*["'][^"']*\$""", "like"),
    _r("PHP-XSS-001", HIGH, "high", 79, "Unescaped echo of superglobal", r"\becho\s+\$_(?:GET|POST|REQUEST|SERVER|COOKIE)\b", "echo"),
    _r("PHP-XSS-002", MEDIUM, "medium", 79, "Unescaped echo of variable", r"""\becho\s+["']?[^;]*\$(?!wpdb)\w+""", "echo", (r"esc_html|esc_attr|esc_url|wp_kses|esc_textarea",)),
    _r("PHP-XSS-003", HIGH, "medium", 79, "Reflected input via $_SERVER['REQUEST_URI']", r"""\$_SERVER\s*\[\s*['"]REQUEST_URI['"]\s*\]""", "request_uri"),
    _r("PHP-XSS-004", HIGH, "high", 79, "Reflected input via $_SERVER['PHP_SELF']", r"""\$_SERVER\s*\[\s*['"]PHP_SELF['"]\s*\]""", "php_self"),
    _r("PHP-CSRF-001", HIGH, "medium", 352, "Form handler without nonce verification", r"if\s*\(\s*isset\s*\(\s*\$_(?:POST|GET|REQUEST)\b[^)]*\)\s*\)", "isset", (r"wp_verify_nonce|check_admin_referer|check_ajax_referer",)),
    _r("PHP-CSRF-002", HIGH, "medium", 352, "AJAX handler without nonce check", r"""wp_ajax_(?:nopriv_)?\w+[\s\S]{0,200}?(?:function\s+\w+|['"]\s*,\s*function)""", "wp_ajax_"),
    _r("PHP-LFI-001", HIGH, "high", 98, "Dynamic include/require with variable", r"\b(?:include|require)(?:_once)?\s*\(\s*\$", "include require"),
    _r("PHP-LFI-002", HIGH, "high", 22, "File read with user input", r"\bfile_get_contents\s*\(\s*\$_(?:GET|POST|REQUEST)", "file_get_contents"),
    _r("PHP-UPLOAD-001", HIGH, "medium", 434, "Direct move_uploaded_file without validation", r"\bmove_uploaded_file\s*\(", "move_uploaded_file"),
    _r("PHP-DESER-001", CRITICAL, "high", 502, "unserialize() with user input", r"\bunserialize\s*\(\s*\$_(?:GET|POST|REQUEST|COOKIE)", "unserialize"),
    _r("PHP-DESER-002", MEDIUM, "medium", 502, "unserialize() usage", r"\bunserialize\s*\(\s*\$", "unserialize"),
    _r("PHP-AUTH-001", MEDIUM, "medium", 862, "Missing capability check", r"""(?:add_action|add_filter)\s*\(\s*['"](?:wp_ajax_|admin_)""", "add_action add_filter", (r"current_user_can",)),
    _r("PHP-AUTH-002", MEDIUM, "low", 862, "is_admin() used for authorization", r"\bis_admin\s*\(\s*\)", "is_admin"),
    _r("PHP-AUTH-003", HIGH, "medium", 862, "REST route exposed with __return_true permission callback", r"""['"]permission_callback['"]\s*=>\s*['"]?__return_true['"]?""", "permission_callback"),
    _r("PHP-REDIR-001", MEDIUM, "high", 601, "Unsafe redirect with user input", r"\bwp_redirect\s*\(\s*\$_(?:GET|POST|REQUEST)", "wp_redirect"),
    _r("PHP-REDIR-002", MEDIUM, "high", 601, "header() redirect with variable", r"""\bheader\s*\(\s*["']Location:\s*["']?\s*\.\s*\$""", "location"),
    _r("PHP-INFO-001", MEDIUM, "high", 200, "phpinfo() call", r"\bphpinfo\s*\(", "phpinfo"),
    _r("PHP-INFO-002", LOW, "high", 209, "Error display enabled", r"(?:ini_set|error_reporting)\s*\([^)]*(?:E_ALL|display_errors)", "ini_set error_reporting"),
    _r("PHP-INFO-003", LOW, "high", 200, "var_dump/print_r in production", r"\b(?:var_dump|print_r|var_export)\s*\(\s*\$", "var_dump print_r var_export"),
    _r("PHP-CRYPTO-001", MEDIUM, "medium", 328, "MD5 used for security purposes", r"\bmd5\s*\(\s*\$(?!file)", "md5"),
    _r("PHP-CRYPTO-002", MEDIUM, "medium", 328, "SHA1 used for security purposes", r"\bsha1\s*\(\s*\$", "sha1"),
    _r("PHP-CRYPTO-003", HIGH, "medium", 798, "Hardcoded cryptographic key", r"""(?:secret|key|password|token|api_key|apikey)\s*(?:=|=>)\s*['"][A-Za-z0-9+/=]{8,}['"]""", "secret key password token"),
    _r("PHP-MALWARE-001", CRITICAL, "high", 506, "Base64 decode + eval chain", r"(?:eval|assert|system|exec)\s*\(\s*(?:base64_decode|gzinflate|gzuncompress|str_rot13|rawurldecode)\s*\(", "eval assert system exec"),
    _r("PHP-MALWARE-002", HIGH, "medium", 506, "Suspicious long base64 string", r"""['"][A-Za-z0-9+/]{100,}={0,2}['"]""", "' \""),
    _r("PHP-MALWARE-003", CRITICAL, "high", 506, "Hex-encoded string execution", r"""(?:eval|assert)\s*\(\s*(?:pack\s*\(\s*["']H\*["']|hex2bin)""", "eval assert"),
    _r("PHP-MALWARE-004", HIGH, "medium", 829, "Remote file access via URL", r"""(?:file_get_contents|fopen|include|require)\s*\(\s*["']https?://""", "http"),
    _r("PHP-MALWARE-005", CRITICAL, "high", 94, "Webshell pattern: $_GET/$_POST in eval/exec", r"(?:eval|assert|system|exec|passthru|shell_exec)\s*\(\s*\$_(?:GET|POST|REQUEST|COOKIE)", "eval assert system exec passthru"),
    _r("PHP-MALWARE-006", CRITICAL, "medium", 506, "Hidden admin user creation", r"wp_(?:create_user|insert_user)\s*\(", "wp_create_user wp_insert_user"),
    _r("PHP-MALWARE-007", HIGH, "high", 506, "Suspicious chr() string building", r"(?:chr\s*\(\s*\d+\s*\)\s*\.?\s*){5,}+", "chr"),
    _r("PHP-MALWARE-008", MEDIUM, "medium", 506, "str_rot13 obfuscation", r"""\bstr_rot13\s*\(\s*["']""", "str_rot13"),
    _r("PHP-MALWARE-009", HIGH, "high", 200, "Data exfiltration via cURL", r"curl_setopt\s*\([^)]*CURLOPT_POSTFIELDS\s*,[^)]*\$_(?:GET|POST|REQUEST|COOKIE|SERVER)", "curlopt_postfields"),
    _r("PHP-MALWARE-010", CRITICAL, "high", 506, "Cryptocurrency miner pattern", r"(?:coinhive|cryptonight|minero|coin-hive|CoinImp)", "coinhive cryptonight minero coin-hive coinimp"),
    _r("PHP-MALWARE-011", CRITICAL, "high", 506, "Decoded payload executed through variable function", r"\$\w+\s*\(\s*(?:base64_decode|gzinflate|gzuncompress|str_rot13|rawurldecode|hex2bin)\s*\(", "$"),
    _r("PHP-MALWARE-012", HIGH, "medium", 506, "Error-suppressed dangerous execution", r"@\s*(?:eval|assert|system|exec|passthru|shell_exec|base64_decode|gzinflate)\s*\(", "@"),
    _r("PHP-MALWARE-013", HIGH, "medium", 94, "User input assigned to variable variables", r"(?:\$\$\w+|\$\w+\s*=\s*\$\$\w+)\s*=\s*\$_(?:GET|POST|REQUEST|COOKIE)", "$$"),
    _r("PHP-MALWARE-014", HIGH, "medium", 200, "Suspicious outbound request with request data", r"(?:wp_remote_post\s*\(|curl_setopt\s*\([^)]*CURLOPT_POSTFIELDS\s*,)[^\n;]*\$_(?:GET|POST|REQUEST|COOKIE|SERVER)", "wp_remote_post curlopt_postfields"),
    _r("PHP-BP-001", LOW, "low", 20, "Direct use of $_GET/$_POST without sanitization", r"""\$_(?:GET|POST|REQUEST)\s*\[\s*['"][^\]]+['"]\s*\](?!\s*\))""", "$_"),
    _r("PHP-BP-002", MEDIUM, "high", 621, "extract() usage", r"\bextract\s*\(\s*\$", "extract"),
    _r("PHP-BP-003", LOW, "high", 477, "Deprecated MySQL functions", r"\bmysql_(?:query|connect|select_db|fetch)\s*\(", "mysql_"),
    _r("PHP-BP-004", LOW, "high", 20, "Use of $_REQUEST superglobal", r"\b\$_REQUEST\b", "$_request"),
    _r("JS-XSS-001", MEDIUM, "high", 79, "innerHTML assignment with variable", r"""\.innerHTML\s*=\s*(?![\s]*["']<)""", ".innerhtml", (), JS),
    _r("JS-XSS-002", MEDIUM, "high", 79, "document.write() usage", r"\bdocument\.write\s*\(", "document.write", (), JS),
    _r("JS-RCE-001", HIGH, "high", 94, "eval() in JavaScript", r"\beval\s*\(", "eval", (), JS),
    _r("JS-MALWARE-001", HIGH, "high", 506, "eval(atob()) obfuscated JavaScript payload", r"\beval\s*\(\s*(?:atob|window\.atob)\s*\(", "eval", (), JS),
    _r("JS-RCE-002", HIGH, "high", 94, "Function() constructor", r"\bnew\s+Function\s*\(", "function", (), JS),
    _r("JS-MALWARE-002", MEDIUM, "medium", 506, "Obfuscated String.fromCharCode payload", r"(?:String\.)?fromCharCode\s*\((?:\s*\d+\s*,){5,}+\s*\d+\s*\)", "fromcharcode", (), JS),
    _r("JS-AJAX-001", MEDIUM, "medium", 352, "AJAX call without nonce", r"(?:jQuery\.(?:ajax|post|get)|fetch|XMLHttpRequest).*admin-ajax\.php", "admin-ajax.php", (), JS),
    _r("JS-PROTO-001", MEDIUM, "high", 1321, "Prototype pollution risk", r"""(?:__proto__|constructor\s*\[\s*["']prototype["']\s*\])""", "__proto__ constructor", (), JS),
    _r("JS-EXT-001", MEDIUM, "medium", 829, "External script loading", r"""(?:createElement\s*\(\s*["']script["']|\.src\s*=\s*["']https?://)""", "createelement .src", (), JS),
)

# Rows the two detectors outside the catalog refer to; they carry no signature.
HEURISTIC_ID = "PHP-MALWARE-HEUR-001"
ENTROPY_ID = "ENTROPY-001"

RULE_SCHEMA = T.StructType(
    [
        T.StructField("rule_ord", T.IntegerType(), False),
        T.StructField("rule_id", T.StringType(), False),
        T.StructField("title", T.StringType(), False),
        T.StructField("severity", T.IntegerType(), False),
        T.StructField("severity_label", T.StringType(), False),
        T.StructField("pattern", T.StringType(), False),
        T.StructField("languages", T.ArrayType(T.StringType(), False), False),
        T.StructField("literals", T.ArrayType(T.StringType(), False), False),
        T.StructField("fp_patterns", T.ArrayType(T.StringType(), False), False),
        T.StructField("cwe", T.StringType(), False),
        T.StructField("confidence", T.StringType(), False),
        T.StructField("description", T.StringType(), False),
        T.StructField("impact", T.StringType(), False),
        T.StructField("layman_fix", T.StringType(), False),
        T.StructField("step_by_step_fix", T.ArrayType(T.StringType(), False), False),
        T.StructField("recommendation", T.StringType(), False),
    ]
)


def label(severity: int) -> str:
    return SEVERITY_LABELS[severity]


def rules_frame(spark: SparkSession, rules: Sequence[Rule] = RULES) -> DataFrame:
    """The rules as a table, in catalog order (1-based ``rule_ord``)."""
    rows = [
        (
            n, r.rule_id, r.title, r.severity, label(r.severity), r.jvm_pattern, list(r.languages),
            list(r.literals), r.suppressors, r.cwe, r.confidence,
            r.description, r.impact, r.layman_fix, list(r.step_by_step_fix), r.recommendation,
        )
        for n, r in enumerate(rules, 1)
    ]
    return local_frame(spark, rows, RULE_SCHEMA)


def local_frame(spark: SparkSession, rows: list[tuple], schema: T.StructType) -> DataFrame:
    """A few rows as a literal of the plan, which needs no job to be read."""
    arrow = to_arrow_schema(schema)
    columns = [pa.array([row[n] for row in rows], type=f.type) for n, f in enumerate(arrow)]
    return spark.createDataFrame(pa.Table.from_arrays(columns, schema=arrow), schema)


def check_rules(rules: Iterable[Rule]) -> list[str]:
    """Problems that keep a rule from running, one message each.

    Unlike a scanner that drops such rules silently, callers get them as rows
    of ``scan_errors``.  The rules of ``RULES`` are known to run.  The patterns of
    all others are tried together, in one job.
    """
    others = [r for r in rules if r not in _BUILT_IN]
    sources = {r: tuple(dict.fromkeys((r.jvm_pattern, r.search_pattern, *r.suppressors))) for r in others}
    _try_patterns({x for own in sources.values() for x in own} - _FAULTS.keys())
    problems = []
    for rule in others:
        for source in sources[rule]:
            fault = _FAULTS[source]
            if fault == EMPTY_MATCH and source != rule.jvm_pattern:
                continue
            if fault:
                problems.append(f"Rule {rule.rule_id} {fault}")
                break
    return problems


EMPTY_MATCH = "can match the empty string"
#: What is wrong with patterns that were tried, None if nothing is.
_FAULTS: dict[str, str | None] = {}


def _try_patterns(sources: Iterable[str]) -> None:
    """Notes what is wrong with each pattern, asked of the engine that will run them."""
    sources = sorted(sources)
    if not sources:
        return
    spark = SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
    pattern = F.col("pattern")
    compiles = F.try_reflect(F.lit("java.util.regex.Pattern"), F.lit("compile"), pattern).isNotNull()
    # the test of the empty text reads a column, so that a broken pattern isn't tried ahead of its row
    tried = spark.createDataFrame([(x, "") for x in sources], "pattern string, nothing string").select(
        "pattern", compiles.alias("compiles"), F.when(compiles, F.rlike("nothing", pattern)).otherwise(False).alias("empty")
    )
    for row in tried.collect():  # as many rows as the configuration has patterns
        _FAULTS[row.pattern] = (EMPTY_MATCH if row.empty else None) if row.compiles else f"cannot be compiled: {row.pattern[:300]}"


_BUILT_IN = frozenset(RULES)


_UNBOUNDED_GROUP = re.compile(r"\)(?:\*|\+|\{\d+,\d*\})(?!\+)")


def risks(rules: Iterable[Rule]) -> list[str]:
    """A message for each rule of ``risky_rules``."""
    return [f"Rule {r} repeats a group that is not possessive: a long match may overflow the stack of a task" for r in risky_rules(rules)]


def risky_rules(rules: Iterable[Rule]) -> list[str]:
    """Ids of rules with a repeated group that is not possessive.

    Such a repeat recurses once per round in the JVM, so one long hostile file
    may overflow the stack of a task.
    """
    return [r.rule_id for r in rules if r.is_regex and _UNBOUNDED_GROUP.search(r.pattern)]
