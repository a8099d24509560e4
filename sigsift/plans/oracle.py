"""The registered queries as SQL over the same tables, for checking results.

The statements are written independently of the DataFrame code: positions come
from regular expression splits, context from a line table's arrays, entropy from
single bytes.  RE2 has no lookahead, so four signatures have an equivalent form.
"""

from __future__ import annotations

from sigsift.catalog import ENTROPY_ID, HEURISTIC_ID, RULES, SEVERITY_COLORS, label
from sigsift.config import BINARY_EXTENSIONS, DEFAULT_EXCLUDES, LANGUAGE_EXTENSIONS
from sigsift.operators import metadata, review
from sigsift.operators.detectors import DETECTOR_ROWS, SIGNALS
from sigsift.operators.summary import GRADE_COLORS, GRADE_FLOORS, REPORT_SCORES
from sigsift.sources import archives
from sigsift.sources.corpus import EXTENSIONS, SEEDS

# Signatures with a lookahead, restated for an engine without one.
NO_LOOKAHEAD = {
    "PHP-XSS-002": r"""\becho\s+["']?[^;]*\$(?:[^\Ww]\w*|w(?:[^\Wp]\w*|p(?:[^\Wd]\w*|d(?:[^\Wb]\w*|\b)|\b)|\b))""",
    "PHP-CRYPTO-001": r"\bmd5\s*\(\s*\$(?:[^f]|f[^i]|fi[^l]|fil[^e]|f?i?l?\z)",
    "PHP-BP-001": r"""\$_(?:GET|POST|REQUEST)\s*\[\s*['"][^\]]+['"]\s*\](?:\s*[^\s)]|\s*\z)""",
    "JS-XSS-001": r"""\.innerHTML\s*=(?:\s*[^\s"']|\s*["'][^<]|\s*["']?\z)""",
}


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def texts(values) -> str:
    return "[" + ", ".join(q(v) for v in values) + "]::VARCHAR[]"


def re2(rule) -> str:
    body = NO_LOOKAHEAD.get(rule.rule_id, rule.pattern).replace(",}+", ",}")
    return "(?im)" + body


def _rules() -> str:
    rows = ",\n".join(
        "(" + ", ".join(
            [
                str(n), q(r.rule_id), q(r.title), str(r.severity), q(label(r.severity)), q(re2(r)), texts(r.languages), texts(r.literals),
                q("(?i)" + r.fp_patterns[0]) if r.fp_patterns else "NULL", q(r.cwe), q(r.confidence), q(r.description), q(r.impact),
                q(r.layman_fix), q("\n".join(r.step_by_step_fix)), q(r.recommendation),
            ]
        ) + ")"
        for n, r in enumerate(RULES, 1)
    )
    return (
        "rules(rule_ord, rule_id, title, severity, severity_label, pattern, languages, literals, fp, cwe, confidence, description, "
        f"impact, layman_fix, steps, recommendation) AS MATERIALIZED (VALUES\n{rows})"
    )


def _details() -> str:
    extra = ", ".join(
        f"({o}, {q(i)}, {q(t)}, {q(c)}, {q(conf)}, NULL, {q(imp)}, '', '', {q(rec)})" for o, i, t, c, conf, imp, rec in DETECTOR_ROWS
    )
    return (
        "details AS (SELECT rule_ord, rule_id, title, cwe, confidence, description, impact, layman_fix, steps, recommendation FROM rules "
        f"UNION ALL SELECT * FROM (VALUES {extra}) AS d(rule_ord, rule_id, title, cwe, confidence, description, impact, layman_fix, steps, recommendation))"
    )


def _seeds() -> str:
    return "seeds AS (SELECT unnest(" + texts(SEEDS) + ") AS seed, unnest(range(" + str(len(SEEDS)) + ")) AS seed_no)"


def _doc_files(some_empty: bool) -> str:
    body = "d.text || chr(10) || s.seed"
    if some_empty:
        body = f"CASE WHEN doc_id % 41 = 40 THEN '' ELSE {body} END"
    return f"""doc_files AS (
  SELECT source AS scan_id,
    CASE WHEN doc_id % 13 = 0 THEN 'node_modules/' WHEN doc_id % 17 = 0 THEN 'a/build/' ELSE 'src/' END
      || 'd' || doc_id || ({texts(EXTENSIONS)})[doc_id % {len(EXTENSIONS)} + 1] AS path,
    {body} AS text
  FROM documents d JOIN seeds s ON s.seed_no = (d.doc_id // {len(EXTENSIONS)}) % {len(SEEDS)})"""


META_FILES = """meta_files AS (
  SELECT source AS scan_id, CASE WHEN k = 0 THEN 'readme.txt' ELSE 'plugin.php' END AS path,
    CASE WHEN k = 0 THEN '=== Pkg ' || source || ' ===' || chr(10) || 'Stable tag: 1.' || k
      ELSE '<?php' || chr(10) || '/*' || chr(10) || ' * Plugin Name: Pkg ' || source || chr(10) || ' * Version: 2.' || k || chr(10)
        || ' */' || chr(10) END AS text
  FROM (SELECT DISTINCT source, CAST(substr(source, 4) AS INTEGER) % 3 AS k FROM documents) WHERE k < 2)"""

EXT_CASE = "lower(regexp_extract(regexp_extract(path, '[^/]*$'), '^\\.*[^.].*?(\\.[^.]*)$', 1))"
LANG_CASE = "CASE " + " ".join(
    f"WHEN extension IN ({', '.join(q(e) for e in group)}) THEN {q(lang)}" for lang, group in LANGUAGE_EXTENSIONS.items()
) + " ELSE 'unknown' END"


def _listed(source: str, include=None, exclude=()) -> str:
    include = include or [e for g in LANGUAGE_EXTENSIONS.values() for e in g]
    names = texts(DEFAULT_EXCLUDES + tuple(exclude))
    return f"""listed AS MATERIALIZED (
  SELECT *, {LANG_CASE} AS language,
    list_has_any(string_split(path, '/')[:-2], {names}) AS excluded,
    CASE WHEN extension IN ({', '.join(q(e) for e in BINARY_EXTENSIONS)}) THEN 'binary extension'
      WHEN extension NOT IN ({', '.join(q(e) for e in include)}) THEN 'extension not included'
      WHEN length = 0 THEN 'empty file' END AS reason
  FROM (SELECT scan_id, path, text, strlen(text) AS length, {EXT_CASE} AS extension FROM {source})),
scanned AS MATERIALIZED (SELECT * FROM listed WHERE NOT excluded AND reason IS NULL)"""


BREAKS = "\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x85\\x{2028}\\x{2029}]"


def corpus_ctes(some_empty=False, include=None, exclude=(), source="files") -> list[str]:
    return [
        _seeds(), _doc_files(some_empty), META_FILES,
        "files AS (SELECT * FROM doc_files UNION ALL SELECT * FROM meta_files)", _listed(source, include, exclude),
    ]


def _hits(threshold: int) -> str:
    return f"""cut AS MATERIALIZED (
  SELECT f.scan_id, f.path, f.language, f.text, r.rule_ord, r.rule_id, r.severity, r.fp,
    string_split_regex(f.text, r.pattern) AS pieces, regexp_extract_all(f.text, r.pattern) AS found
  FROM scanned f JOIN rules r
    ON (list_contains(r.languages, f.language) OR (f.language = 'unknown' AND list_contains(r.languages, 'php')))
  WHERE r.severity >= {threshold}
    AND regexp_matches(f.text, r.pattern)),
starts AS (
  SELECT scan_id, path, language, text, rule_ord, rule_id, severity, fp, k,
    CAST(list_sum(list_transform(pieces[1:k], lambda x: length(x)))
      + coalesce(list_sum(list_transform(found[1:k - 1], lambda x: length(x))), 0) AS BIGINT) AS match_start
  FROM (SELECT *, unnest(range(1, len(found) + 1)) AS k FROM cut)),
placed AS MATERIALIZED (
  SELECT *, len(regexp_extract_all(before, {q(BREAKS)})) + 1 AS line_number,
    length(regexp_extract(before, '[^\\r\\n\\x0b\\x0c\\x1c-\\x1e\\x85\\x{{2028}}\\x{{2029}}]*\\z')) + 1 AS match_column
  FROM (SELECT *, substr(text, 1, match_start) AS before FROM starts))"""


def matches(threshold: int = 2, **kw) -> list[str]:
    return corpus_ctes(**kw) + [_rules(), _hits(threshold)]


def _signal(s) -> str:
    pattern = ("" if s.name == "blob" else "(?i)") + s.pattern.replace(",}+", ",}")
    return f"CASE WHEN regexp_matches(text, {q(pattern)}) THEN length(string_split_regex(text, {q(pattern)})[1]) END AS {s.name}"


def _bytes(source: str, name: str = "byte_counts", content: str = "hex(encode(text))") -> str:
    return f"""{name} AS MATERIALIZED (
  SELECT scan_id, path, b, count(*) AS n FROM (
    SELECT scan_id, path, unnest(regexp_extract_all(h, '..')) AS b
    FROM (SELECT scan_id, path, {content} AS h FROM {source}))
  GROUP BY ALL)"""


ENTROPY = """entropies AS MATERIALIZED (
  SELECT scan_id, path, round(log2(sum(n)) - sum(n * log2(n)) / sum(n), 4) AS entropy FROM byte_counts GROUP BY scan_id, path)"""


def _heuristic() -> str:
    flags = " + ".join(f"CASE WHEN {s.name} IS NOT NULL THEN {s.weight} ELSE 0 END" for s in SIGNALS)
    labels = ", ".join(f"CASE WHEN {s.name} IS NOT NULL THEN {q(s.label)} END" for s in SIGNALS)
    firsts = ", ".join(s.name for s in SIGNALS)
    return f"""{_bytes('scanned')},
{ENTROPY},
heur AS MATERIALIZED (
  SELECT *, {flags} + CASE WHEN entropy >= 6.1 THEN 1 ELSE 0 END + CASE WHEN long_line THEN 1 ELSE 0 END AS score,
    list_filter([{labels}, CASE WHEN entropy >= 6.1 THEN 'high entropy ' || printf('%.2f', entropy) END,
      CASE WHEN long_line THEN 'very long line payload' END], lambda x: x IS NOT NULL) AS signals,
    coalesce(least({firsts}), 0) AS match_start
  FROM (SELECT f.scan_id, f.path, f.language, f.text, e.entropy, {', '.join(_signal(s) for s in SIGNALS)},
      len(list_filter(string_split_regex(f.text, {q(BREAKS)}), lambda x: length(x) >= 500)) > 0 AS long_line
    FROM scanned f JOIN entropies e ON e.scan_id = f.scan_id AND e.path = f.path WHERE f.language = 'php')),
heur_placed AS (
  SELECT scan_id, path, language, text, 1000000 AS rule_ord, {q(HEURISTIC_ID)} AS rule_id,
    CASE WHEN score >= 6 THEN 5 ELSE 4 END AS severity, NULL AS fp, match_start,
    len(regexp_extract_all(substr(text, 1, match_start), {q(BREAKS)})) + 1 AS line_number,
    length(regexp_extract(substr(text, 1, match_start), '[^\\r\\n]*\\z')) + 1 AS match_column,
    'Signs of obfuscation and execution occur together in this file: ' || array_to_string(signals, ', ') || '.' AS detail
  FROM heur WHERE score >= 4)"""


FINDINGS = """located AS MATERIALIZED (
  SELECT scan_id, path, language, text, rule_ord, rule_id, severity, fp, match_start, line_number, match_column, NULL AS detail FROM placed
  UNION ALL BY NAME SELECT * FROM heur_placed),
lined AS (SELECT *, string_split_regex(text, '\\r\\n|\\n') AS ls FROM located),
found AS MATERIALIZED (
  SELECT l.scan_id, l.path, l.language, l.rule_ord, l.rule_id, l.severity, l.match_start, l.line_number, l.match_column,
    regexp_replace(ls[line_number], '\\s+\\z', '') AS line_content,
    ls[greatest(1, line_number - 3):line_number - 1] AS ctx_before, ls[line_number + 1:line_number + 3] AS ctx_after,
    coalesce(regexp_matches(array_to_string(ls[greatest(1, line_number - 10):line_number + 10], chr(10)), fp), false) AS false_positive,
    CASE l.severity WHEN 5 THEN 'Critical' WHEN 4 THEN 'High' WHEN 3 THEN 'Medium' ELSE 'Low' END AS severity_label,
    d.title, d.cwe, d.confidence, coalesce(l.detail, d.description) AS description, d.impact, d.layman_fix, d.steps, d.recommendation
  FROM lined l JOIN details d USING (rule_ord))"""


def findings(**kw) -> list[str]:
    return matches(**kw) + [_heuristic(), _details(), FINDINGS]


VALID = "valid AS (SELECT scan_id FROM meta_files)"
NAMES = """names AS (
  SELECT scan_id, 'Pkg ' || scan_id AS plugin_name, CASE WHEN k = 0 THEN '1.0' ELSE '2.' || k END AS plugin_version, path AS source_path
  FROM (SELECT scan_id, path, CAST(substr(scan_id, 4) AS INTEGER) % 3 AS k FROM meta_files))"""


def sql(ctes: list[str], body: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + body


def _case(pairs, key) -> str:
    return "CASE " + " ".join(f"WHEN {key} = {q(k) if isinstance(k, str) else k} THEN {q(v) if isinstance(v, str) else v}" for k, v in pairs) + " END"


GRADE = "CASE " + " ".join(f"WHEN score >= {floor} THEN '{name}'" for name, floor in GRADE_FLOORS) + " ELSE 'F' END"


def _counts(source: str) -> str:
    return f"""counts AS MATERIALIZED (
  SELECT scan_id, count(*) FILTER (NOT false_positive AND severity = 5) AS critical, count(*) FILTER (NOT false_positive AND severity = 4) AS high,
    count(*) FILTER (NOT false_positive AND severity = 3) AS medium, count(*) FILTER (NOT false_positive AND severity = 2) AS low,
    0::BIGINT AS info, count(*) FILTER (NOT false_positive) AS total, count(*) FILTER (false_positive) AS suppressed,
    CAST(sum(CASE WHEN false_positive THEN 0 WHEN severity = 5 THEN 25 WHEN severity = 4 THEN 12 WHEN severity = 3 THEN 5 ELSE 2 END) AS BIGINT) AS penalty
  FROM {source} GROUP BY scan_id)"""


GRADED = f"""graded AS MATERIALIZED (
  SELECT *, {_case(GRADE_COLORS.items(), "left(grade, 1)")} AS grade_color, {_case(REPORT_SCORES.items(), "grade")} AS report_score
  FROM (SELECT *, {GRADE} AS grade FROM (
    SELECT n.scan_id, plugin_name, plugin_version, coalesce(critical, 0) AS critical, coalesce(high, 0) AS high, coalesce(medium, 0) AS medium,
      coalesce(low, 0) AS low, coalesce(info, 0) AS info, coalesce(total, 0) AS total, coalesce(suppressed, 0) AS suppressed,
      greatest(0, 100 - coalesce(penalty, 0)) AS score
    FROM names n LEFT JOIN counts USING (scan_id))))"""

ORDER = "ORDER BY severity DESC, path, line_number, rule_ord, match_start"
NUMBERED = f"numbered AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY scan_id {ORDER}) AS ordinal FROM found)"
WHERE = "scan_id, path, rule_id, line_number, match_column"
LINE_COUNT = f"""CASE WHEN regexp_matches(text, '[\\r\\n\\x0b\\x0c\\x1c-\\x1e\\x85\\x{{2028}}\\x{{2029}}]\\z')
  THEN len(regexp_extract_all(text, {q(BREAKS)})) ELSE len(regexp_extract_all(text, {q(BREAKS)})) + 1 END"""

BATCHED = f"""batched AS MATERIALIZED (
  SELECT *, CAST((o - 1) // 5 AS INTEGER) AS batch_no, CAST((o - 1) % 5 + 1 AS INTEGER) AS pos
  FROM (SELECT *, row_number() OVER (PARTITION BY scan_id {ORDER}) AS o FROM found WHERE NOT false_positive))"""

# what the made-up responses say about each finding: no answer for a batch's last one in every fifth batch
JUDGED = """sizes AS (SELECT scan_id, batch_no, max(pos) AS last_pos FROM batched GROUP BY ALL),
answers AS MATERIALIZED (
  SELECT b.*, batch_no % 11 = 10 AS failed, NOT (batch_no % 5 = 4 AND pos = last_pos) AS answered, (batch_no + pos) % 3 = 0 AS denied
  FROM batched b JOIN sizes USING (scan_id, batch_no))"""

AFTER = f"""after_review AS MATERIALIZED (
  SELECT scan_id, path, rule_id, match_start, severity, NOT failed AND answered AND denied AS false_positive,
    CASE WHEN NOT failed AND answered THEN NOT denied END AS ai_confirmed,
    CASE WHEN failed THEN {q(review.ERROR_START + 'timeout')} WHEN answered THEN 'note on ' || rule_id ELSE {q(review.NO_ANSWER)} END AS ai_analysis
  FROM answers
  UNION ALL SELECT scan_id, path, rule_id, match_start, severity, true, NULL, NULL FROM found WHERE false_positive)"""


def _prompts() -> str:
    block = (
        "'[FINDING ' || pos || '] ' || rule_id || ' ' || title || chr(10) || 'level ' || severity_label || ', weakness ' || cwe || ', at ' || path"
        " || ' line ' || line_number || chr(10) || 'what the rule says: ' || description || chr(10) || 'code, the place marked with \">>>\":' || chr(10)"
        " || array_to_string(ctx_before, chr(10)) || chr(10) || '>>> ' || line_content || chr(10) || array_to_string(ctx_after, chr(10)) || chr(10)"
        " || '[end]' || chr(10)"
    )
    return (
        "SELECT scan_id, batch_no, count(*) AS findings, 'Below are ' || count(*) || ' places that signatures point to. Judge each by its code. "
        "Use one block per place, in this form:' || chr(10) || "
        + q(review.HEADER_FORMAT) + f" || string_agg({block}, chr(10) ORDER BY pos) AS prompt FROM batched GROUP BY scan_id, batch_no"
    )


def _wide() -> str:
    return """SELECT scan_id, path, rule_id, match_start, first_line, last_line,
  'Is this place a real weakness? Judge it by the code around it.' || chr(10) || chr(10) || 'rule: ' || rule_id || ' ' || title || chr(10)
  || 'level: ' || severity_label || chr(10) || 'place: ' || path || ' line ' || line_number || chr(10) || 'weakness: ' || cwe || chr(10)
  || 'what the rule says: ' || description || chr(10) || chr(10) || 'the place, marked with ">>>":' || chr(10)
  || CASE WHEN len(ctx_before) > 0 THEN array_to_string(ctx_before, chr(10)) ELSE '(nothing)' END || chr(10) || '>>> ' || line_content || chr(10)
  || CASE WHEN len(ctx_after) > 0 THEN array_to_string(ctx_after, chr(10)) ELSE '(nothing)' END || chr(10)
  || chr(10) || 'lines ' || first_line || ' to ' || last_line || ' of the file:' || chr(10)
  || array_to_string(ls[first_line:last_line], chr(10)) || chr(10) || '[end]' || chr(10) AS prompt
FROM (SELECT f.*, ls, greatest(0, line_number - 50) + 1 AS first_line, least(len(ls), line_number + 50) AS last_line
  FROM found f JOIN (SELECT scan_id, path, CASE WHEN len(x) > 1 AND x[-1] = '' THEN x[:-2] ELSE x END AS ls
    FROM (SELECT scan_id, path, string_split_regex(text, '\\r\\n|\\n') AS x FROM scanned)) s USING (scan_id, path))"""


TOTALS = f"totals AS MATERIALIZED (SELECT scan_id, count(*) AS files_scanned, CAST(sum({LINE_COUNT}) AS BIGINT) AS lines_analyzed FROM scanned GROUP BY scan_id)"
REPORTED = "reported AS MATERIALIZED (SELECT n.* FROM numbered n JOIN names USING (scan_id))"
PACKAGES = "packages AS MATERIALIZED (SELECT * FROM graded JOIN totals USING (scan_id))"

JSON_REPORT = """SELECT scan_id, 0 AS section, 0::BIGINT AS piece,
  regexp_replace(to_json({plugin_name: plugin_name, plugin_version: plugin_version, plugin_path: scan_id, grade: grade, scan_mode: 'standard',
    ai_enabled: false, summary: {total: total, critical: critical, high: high, medium: medium, low: low, info: info}, files_scanned: files_scanned})::VARCHAR,
    '\\}$', ',"findings":[') AS text FROM packages
UNION ALL SELECT scan_id, 1, CAST((ordinal - 1) // 500 AS BIGINT) AS piece,
  CASE WHEN (ordinal - 1) // 500 > 0 THEN ',' ELSE '' END || string_agg(to_json({id: rule_id, title: title, severity: severity_label, file: path,
    line: line_number, code: line_content, cwe: cwe, description: description, impact: impact, recommendation: recommendation,
    false_positive: false_positive, ai_analysis: NULL})::VARCHAR, ',' ORDER BY ordinal) FROM reported GROUP BY scan_id, (ordinal - 1) // 500
UNION ALL SELECT scan_id, 2, 0, '],"errors":[' FROM packages
UNION ALL SELECT scan_id, 4, 0, ']}' FROM packages"""

MARKDOWN_REPORT = """SELECT scan_id, 0 AS section, 0::BIGINT AS piece, '' AS path,
  '# Security Report — ' || plugin_name || chr(10) || chr(10) || '- **Version:** ' || plugin_version || chr(10) || '- **Path:** ' || scan_id || chr(10)
  || '- **Grade:** ' || grade || chr(10) || '- **Scan mode:** standard' || chr(10) || chr(10) || '## Summary' || chr(10) || '- Critical: ' || critical || chr(10)
  || '- High: ' || high || chr(10) || '- Medium: ' || medium || chr(10) || '- Low: ' || low || chr(10) || '- Total findings: ' || total || chr(10)
  || '- Files scanned: ' || files_scanned || chr(10) || '- Lines analyzed: ' || lines_analyzed || chr(10) || chr(10) || '## Findings'
  || CASE WHEN total + suppressed = 0 THEN chr(10) || 'No findings were detected.' || chr(10) ELSE '' END AS text FROM packages
UNION ALL SELECT scan_id, 1, ordinal, path,
  '### ' || ordinal || '. ' || rule_id || ' — ' || title || chr(10) || '- Severity: ' || severity_label || chr(10) || '- File: ' || path || ':' || line_number
  || ':' || match_column || chr(10) || '- Confidence: ' || confidence || chr(10) || '- Description: ' || description || chr(10)
  || CASE WHEN impact <> '' THEN '- Impact: ' || impact || chr(10) ELSE '' END
  || CASE WHEN recommendation <> '' THEN '- Recommendation: ' || recommendation || chr(10) ELSE '' END
  || CASE WHEN line_content <> '' THEN chr(10) || '```' || chr(10)
    || array_to_string(list_concat(list_concat(ctx_before, [line_content]), ctx_after), chr(10)) || chr(10) || '```' || chr(10) ELSE '' END FROM reported
UNION ALL SELECT scan_id, 2, 0, '', '## Files Scanned' FROM packages
UNION ALL SELECT s.scan_id, 3, 0, s.path, '- `' || s.path || '` (' || s.language || ', ' || lines || ' lines, entropy ' || printf('%.2f', entropy) || ')'
  FROM (SELECT scan_id, path, language, LINES_HERE AS lines FROM scanned) s JOIN names USING (scan_id) JOIN entropies e ON e.scan_id = s.scan_id AND e.path = s.path"""


def _roll(dims: str, measures: str, kind: str) -> str:
    return f"SELECT {dims}, {measures} FROM found WHERE NOT false_positive GROUP BY {kind}({dims})"


NUL = "chr(0)"
PACKED = "packed AS MATERIALIZED (SELECT source AS scan_id, 'packed/p' || doc_id || '.php' AS path, translate(" + " || ".join(
    f"sha256(text || '#{n}')" for n in range(8)
) + ", '0', 'f') AS h FROM documents)"
PACKED_ENTROPY = f"""{_bytes('packed', 'packed_counts', 'h')},
packed_entropy AS MATERIALIZED (
  SELECT scan_id, path, round(log2(sum(n)) - sum(n * log2(n)) / sum(n), 4) AS entropy FROM packed_counts GROUP BY scan_id, path)"""
GROUPED_ENTROPY = """SELECT scan_id, CAST(sum(n) AS BIGINT) AS bytes, count(*) AS byte_values, round(log2(sum(n)) - sum(n * log2(n)) / sum(n), 4) AS entropy
FROM (SELECT scan_id, b, sum(n) AS n FROM byte_counts GROUP BY scan_id, b) GROUP BY scan_id"""


def _doubled(prefix: str) -> list[str]:
    ctes = corpus_ctes(source="doubled")
    ctes.insert(4, f"doubled AS (SELECT * FROM files UNION ALL SELECT {prefix} AS scan_id, path, text FROM doc_files)")
    return ctes


ARCHIVED = """WITH members AS (SELECT doc_id, doc_id // 10 AS ten, 'v' || (doc_id // 10) % 2 || '/a' || doc_id // 20 || '.zip' AS scan_id,
  'd' || doc_id || '.php' AS path, text FROM documents)
"""


def all_findings() -> str:
    return sql(
        findings() + [PACKED, PACKED_ENTROPY],
        f"""SELECT rule_id, severity_label, count(*) AS findings, count(*) FILTER (false_positive) AS suppressed FROM found GROUP BY ALL
UNION ALL SELECT {q(ENTROPY_ID)}, 'Medium', count(*), 0 FROM (SELECT scan_id, path, entropy FROM packed_entropy WHERE entropy > 6.0
  UNION ALL SELECT e.* FROM entropies e JOIN scanned s ON s.scan_id = e.scan_id AND s.path = e.path WHERE s.language = 'php' AND entropy > 6.0) HAVING count(*) > 0""",
    )


def statements() -> dict[str, str]:
    listing = corpus_ctes(some_empty=True)
    chosen = "SELECT scan_id, path, language FROM scanned"
    severity_body = "SELECT scan_id, severity, count(*) AS matches, count(DISTINCT rule_id) AS rules FROM placed GROUP BY ALL"
    out: dict[str, str] = {
        "corpus_files": sql(corpus_ctes(), "SELECT scan_id, path, strlen(text) AS length, sha256(text) AS sha256 FROM files"),
        "file_inventory": sql(
            listing,
            "SELECT scan_id, path, extension, language, length AS size, "
            "CASE WHEN length >= 1024 THEN printf('%.1f KB', length / 1024.0::DOUBLE) ELSE length || ' B' END AS size_display FROM scanned",
        ),
        "language_counts": sql(listing, "SELECT language, count(*) AS files, CAST(sum(length) AS BIGINT) AS bytes FROM scanned GROUP BY language"),
        "skipped_files": sql(listing, "SELECT scan_id, path, reason FROM listed WHERE NOT excluded AND reason IS NOT NULL"),
        "excluded_dirs": sql(listing, "SELECT scan_id, path FROM listed WHERE excluded"),
        "php_only": sql(corpus_ctes(True, LANGUAGE_EXTENSIONS["php"]), chosen),
        "js_only": sql(corpus_ctes(True, LANGUAGE_EXTENSIONS["js"] + LANGUAGE_EXTENSIONS["ts"]), chosen),
        "include_ext": sql(
            corpus_ctes(True, [e for g in LANGUAGE_EXTENSIONS.values() for e in g] + [".twig", ".md"], ("a",)), chosen
        ),
        "only_ext": sql(corpus_ctes(True, [".twig", ".inc"]), chosen),
        "replaced_excludes": sql(
            listing, "SELECT scan_id, path, language FROM listed WHERE NOT list_contains(string_split(path, '/')[:-2], 'src') AND reason IS NULL"
        ),
        "user_rules": sql(
            corpus_ctes(),
            "SELECT rule_id, CAST(sum(n) AS BIGINT) AS matches, count(*) AS files FROM (SELECT 'USER-001' AS rule_id, "
            "len(regexp_extract_all(text, '(?i)[a-z0-9.]+@mail\\d\\.example\\.com')) AS n FROM scanned WHERE language = 'php' UNION ALL "
            "SELECT 'USER-002', len(regexp_extract_all(text, '\\+1 \\(\\d{3}\\) 555-\\d{4}')) FROM scanned WHERE language = 'php') WHERE n > 0 GROUP BY rule_id",
        ),
        "literal_rules": sql(
            corpus_ctes(),
            "SELECT rule_id, CAST(sum(n) AS BIGINT) AS matches, count(*) AS files FROM (SELECT 'LITERAL-001' AS rule_id, "
            "len(regexp_extract_all(text, '\\+1 \\(')) AS n FROM scanned WHERE language = 'php' UNION ALL "
            "SELECT 'LITERAL-002', len(regexp_extract_all(text, '(?i)@mail')) FROM scanned WHERE language = 'php') WHERE n > 0 GROUP BY rule_id",
        ),
        "rule_list": sql(
            corpus_ctes(),
            "SELECT 'NUMBER-' || number AS rule_id, count(*) AS matches, count(DISTINCT (scan_id, path)) AS files FROM (SELECT scan_id, path, "
            "unnest(regexp_extract_all(text, '\\) 555-(\\d{4})\\b', 1)) AS number FROM scanned WHERE language = 'php') GROUP BY number",
        ),
        "cut_notes": sql(
            corpus_ctes(),
            "SELECT 'Scanned in part' AS note, count(*) AS files FROM scanned WHERE length > 4096 HAVING count(*) > 0 UNION ALL "
            "SELECT 'Searched for a package name in part', count(*) FROM listed WHERE NOT excluded AND (reason IS NULL OR "
            "regexp_matches(path, '(^|/)readme\\.txt$') OR regexp_matches(path, '(?i)\\.(php|inc|module)$')) AND length > 1024 HAVING count(*) > 0",
        ),
        "archive_files": ARCHIVED + "SELECT scan_id, path, strlen(text) AS length, sha256(text) AS sha256 FROM members WHERE ten % 13 <> 12",
        "archive_errors": ARCHIVED + f"SELECT DISTINCT scan_id, {q(metadata.EXTRACT_FAILED + archives.TRAVERSAL)} AS message, true AS fatal "
        "FROM members WHERE ten % 13 = 12 AND doc_id % 10 = 3",
        "inventory_partition": sql(
            listing,
            "SELECT 'all' AS part, count(*) AS files FROM listed UNION ALL SELECT 'excluded', count(*) FROM listed WHERE excluded "
            "UNION ALL SELECT 'scanned', count(*) FROM scanned UNION ALL SELECT 'skipped', count(*) FROM listed WHERE NOT excluded AND reason IS NOT NULL "
            "UNION ALL SELECT 'neither', 0 UNION ALL SELECT 'both', 0",
        ),
        "text_gate": f"""WITH gated AS (SELECT source AS scan_id, 't' || doc_id || '.php' AS path,
  CASE doc_id % 7 WHEN 0 THEN {NUL} || text WHEN 1 THEN text || {NUL} ELSE text END AS text, doc_id % 7 AS k, strlen(text) AS n FROM documents),
told AS (SELECT *, NOT (k = 0 OR (k = 1 AND n < 8192)) AS is_text FROM gated)
SELECT scan_id, path, is_text, CASE WHEN is_text THEN {LINE_COUNT} ELSE 0 END AS lines FROM told""",
        "line_index": sql(
            corpus_ctes(),
            """SELECT scan_id, path, CAST(k AS INTEGER) AS line_no,
  CAST(coalesce(sum(length(t) + brk) OVER (PARTITION BY scan_id, path ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS start, t AS text
FROM (SELECT scan_id, path, k, ls[k] AS t, CASE WHEN k <= len(bs) THEN length(bs[k]) ELSE 0 END AS brk
  FROM (SELECT scan_id, path, ls, bs, unnest(range(1, len(ls) + 1)) AS k
    FROM (SELECT scan_id, path, bs, CASE WHEN len(x) > 1 AND x[-1] = '' THEN x[:-2] ELSE x END AS ls
      FROM (SELECT scan_id, path, string_split_regex(text, '\\r\\n|[\\r\\n]') AS x, regexp_extract_all(text, '\\r\\n|[\\r\\n]') AS bs FROM scanned))))""",
        ),
        "rule_hits": sql(
            matches(), "SELECT rule_id, count(*) AS matches, count(DISTINCT scan_id || ':' || path) AS files FROM placed GROUP BY rule_id"
        ),
        "scan_counts": sql(
            matches(),
            "SELECT scan_id, language, count(*) AS files, count(*) FILTER (n > 0) AS hit_files, CAST(sum(n) AS BIGINT) AS hits FROM ("
            "SELECT s.scan_id, s.path, s.language, count(c.rule_id) AS n FROM scanned s LEFT JOIN cut c ON c.scan_id = s.scan_id AND c.path = s.path "
            "GROUP BY ALL) GROUP BY scan_id, language",
        ),
        "match_positions": sql(matches(), "SELECT scan_id, path, rule_id, match_start, line_number, match_column FROM placed"),
        "match_cap": sql(matches(), "SELECT scan_id, path, rule_id, min(match_start) AS match_start FROM placed GROUP BY scan_id, path, rule_id"),
        "severity_threshold": sql(matches(5), severity_body),
        "quick_mode": sql(matches(4), severity_body),
        "unknown_language": sql(
            matches(include=[e for g in LANGUAGE_EXTENSIONS.values() for e in g] + [".twig"]),
            "SELECT language, rule_id, count(*) AS matches FROM placed GROUP BY ALL",
        ),
        "context_lines": sql(
            findings(),
            f"SELECT {WHERE}, line_content, array_to_string(ctx_before, chr(10)) AS before, array_to_string(ctx_after, chr(10)) AS after FROM found",
        ),
        "suppressed_findings": sql(findings(), f"SELECT {WHERE} FROM found WHERE false_positive"),
        "active_findings": sql(findings(), f"SELECT {WHERE} FROM found WHERE NOT false_positive"),
        "file_entropy": sql(
            corpus_ctes() + [_bytes("scanned"), ENTROPY, PACKED, PACKED_ENTROPY], "SELECT * FROM entropies UNION ALL SELECT * FROM packed_entropy"
        ),
        "group_entropy": sql(corpus_ctes() + [_bytes("scanned")], GROUPED_ENTROPY),
        "page_entropy": sql(
            [
                "hosted AS (SELECT regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) AS scan_id, 'p' || page_id AS path, html AS text FROM pages)",
                _bytes("hosted"),
            ],
            GROUPED_ENTROPY,
        ),
        "heuristic_scores": sql(matches() + [_heuristic()], "SELECT scan_id, path, score FROM heur"),
        "heuristic_findings": sql(
            matches() + [_heuristic()], f"SELECT {WHERE}, severity, match_start, detail AS description FROM heur_placed"
        ),
        "entropy_findings": sql(
            [PACKED, PACKED_ENTROPY],
            f"SELECT scan_id, path, {q(ENTROPY_ID)} AS rule_id, 0 AS line_number, 0 AS match_column, 'Medium' AS severity_label, "
            "'Entropy: ' || printf('%.4f', entropy) AS line_content FROM packed_entropy WHERE entropy > 6.0",
        ),
        "all_findings": all_findings(),
        "chunked_findings": all_findings(),
        "package_metadata": sql([META_FILES, NAMES], "SELECT * FROM names"),
        "report_slug": sql(
            [META_FILES, NAMES],
            "SELECT scan_id, coalesce(plugin_name, 'My Pack_' || scan_id) AS plugin_name, "
            "coalesce(regexp_replace(lower(plugin_name), '[^a-z0-9._-]+', '-', 'g'), 'my-pack_' || scan_id) AS slug "
            "FROM (SELECT DISTINCT source AS scan_id FROM documents) LEFT JOIN names USING (scan_id)",
        ),
        "nothing_scannable": sql(
            [META_FILES, NAMES],
            f"SELECT scan_id, 0::BIGINT AS files_found, CASE WHEN plugin_name IS NULL THEN {q(metadata.INVALID_PACKAGE)} ELSE {q(metadata.NO_FILES)} END AS message, "
            "true AS fatal FROM (SELECT DISTINCT source AS scan_id FROM documents) LEFT JOIN names USING (scan_id)",
        ),
        "report_ids": "SELECT DISTINCT source AS scan_id, 'R-' || upper(left(sha256(source || ':2026-01-01T00:00:00Z'), 12)) AS report_id FROM documents",
        "scan_status": sql(
            corpus_ctes(True, [e for g in LANGUAGE_EXTENSIONS.values() for e in g] + [".twig"]) + [NAMES],
            f"""SELECT scan_id, max(plugin_name) AS plugin_name, count(*) FILTER (NOT excluded AND reason IS NULL) AS files_found,
  count(*) FILTER (NOT excluded AND reason IS NOT NULL) AS files_skipped,
  CASE WHEN max(plugin_name) IS NULL THEN {q(metadata.INVALID_PACKAGE)} END AS message, max(plugin_name) IS NULL AS fatal
FROM listed LEFT JOIN names USING (scan_id) GROUP BY scan_id""",
        ),
        "valid_scans": sql(findings() + [VALID], "SELECT scan_id, count(*) AS findings FROM found WHERE scan_id IN (SELECT scan_id FROM valid) GROUP BY scan_id"),
        "archive_gate": f"""WITH members AS (SELECT source AS scan_id, doc_id, n_chars * 5000 AS size,
  CASE WHEN doc_id % 97 = 0 THEN '../evil.php' WHEN doc_id % 89 = 0 THEN '/abs.php' ELSE 'src/d' || doc_id || '.php' END AS name,
  doc_id % 101 = 0 AS link FROM documents),
summed AS (SELECT *, sum(size) OVER (PARTITION BY scan_id ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS running FROM members),
told AS (SELECT *, CASE WHEN running > 536870912 THEN {q(archives.TOO_LARGE)} WHEN name LIKE '/%' THEN {q(archives.ABSOLUTE)}
  WHEN name LIKE '../%' THEN {q(archives.TRAVERSAL)} WHEN link THEN {q(archives.SYMLINK)} END AS fault FROM summed)
SELECT scan_id, min_by(fault, doc_id) FILTER (fault IS NOT NULL) AS fault, min(doc_id) FILTER (fault IS NOT NULL) AS fault_member,
  count(*) AS members, CAST(sum(size) AS BIGINT) AS declared_bytes FROM told GROUP BY scan_id""",
        "severity_summary": sql(findings() + [_counts("found")], "SELECT * EXCLUDE (penalty) FROM counts"),
        "scan_grades": sql(findings() + [NAMES, _counts("found"), GRADED], "SELECT * FROM graded"),
        "scan_totals": sql(corpus_ctes() + [TOTALS], "SELECT * FROM totals"),
        "finding_details": sql(
            findings(),
            f"""SELECT scan_id, path, rule_id, title, severity_label, severity AS severity_value, line_number, match_column, line_content,
  array_to_string(ctx_before, chr(10)) AS context_before, array_to_string(ctx_after, chr(10)) AS context_after, description, impact, layman_fix,
  steps AS step_by_step_fix, CASE language WHEN 'php' THEN 'php' WHEN 'js' THEN 'javascript' WHEN 'ts' THEN 'typescript' ELSE 'markup' END AS language,
  cwe, replace(cwe, 'CWE-', '') AS cwe_num, confidence, recommendation, false_positive, {_case(SEVERITY_COLORS.items(), "severity")} AS severity_color FROM found""",
        ),
        "finding_order": sql(findings() + [NUMBERED], "SELECT scan_id, ordinal, severity, path, line_number, rule_id, match_start FROM numbered"),
        "top_findings": sql(
            findings(),
            f"""SELECT scan_id, rank, path, rule_id, line_number, match_start, greatest(n - 20, 0) AS more FROM (
  SELECT *, row_number() OVER (PARTITION BY scan_id {ORDER}) AS rank, count(*) OVER (PARTITION BY scan_id) AS n FROM found WHERE NOT false_positive) WHERE rank <= 20""",
        ),
        "rule_rollup": sql(
            findings(),
            _roll("severity_label, rule_id", "count(*) AS findings, count(DISTINCT scan_id || ':' || path) AS files, count(DISTINCT scan_id) AS packages", "ROLLUP"),
        ),
        "cwe_summary": sql(findings(), _roll("cwe, confidence", "count(*) AS findings, count(DISTINCT rule_id) AS rules", "CUBE")),
        "language_rollup": sql(findings(), _roll("language, severity_label", "count(*) AS findings", "ROLLUP")),
        "duplicate_content": sql(
            _doubled("'copy-' || substr(scan_id, 4, 1)"),
            """SELECT sha256(text) AS sha256, count(*) AS copies, count(DISTINCT scan_id) AS packages, CAST(sum(length) AS BIGINT) AS bytes,
  min(scan_id) AS first_scan, min_by(path, (scan_id, path)) AS first_path FROM scanned GROUP BY sha256(text) HAVING count(*) > 1""",
        ),
        "distinct_scan": sql(
            _doubled("'copy-' || scan_id") + [_rules(), _hits(2), _heuristic(), _details(), FINDINGS],
            "SELECT scan_id, rule_id, count(*) AS findings, count(*) FILTER (false_positive) AS suppressed, CAST(sum(line_number) AS BIGINT) AS line_sum FROM found GROUP BY scan_id, rule_id",
        ),
        "rescan_findings": sql(
            findings(),
            "SELECT scan_id, rule_id, count(*) AS findings, count(*) FILTER (false_positive) AS suppressed, CAST(sum(line_number) AS BIGINT) AS line_sum FROM found GROUP BY scan_id, rule_id",
        ),
        "review_batches": sql(findings() + [BATCHED], "SELECT scan_id, batch_no, pos, path, rule_id, line_number, match_start FROM batched"),
        "review_prompts": sql(findings() + [BATCHED], _prompts()),
        "parse_verdicts": sql(
            findings() + [BATCHED, JUDGED],
            "SELECT scan_id, batch_no, pos, CASE WHEN denied THEN 'FALSE_POSITIVE' ELSE 'TRUE_POSITIVE' END AS verdict, NOT denied AS ai_confirmed, "
            "'note on ' || rule_id AS ai_analysis FROM answers WHERE NOT failed AND answered",
        ),
        "apply_verdicts": sql(
            findings() + [BATCHED, JUDGED, AFTER],
            "SELECT scan_id, path, rule_id, match_start, false_positive, ai_confirmed, ai_analysis FROM after_review",
        ),
        "grade_after_review": sql(
            findings() + [BATCHED, JUDGED, AFTER, NAMES, _counts("after_review"), GRADED], "SELECT scan_id, total, suppressed, score, grade FROM graded"
        ),
        "review_cost": sql(
            findings() + [NAMES, _counts("found"), GRADED],
            "SELECT scan_id, total > 0 AS ai_enabled, 'some-model' AS ai_model, (total + suppressed) * 850 + 1200 AS ai_tokens FROM graded",
        ),
        "review_wide_context": sql(findings(), _wide()),
        "json_report": sql(findings() + [NUMBERED, NAMES, _counts("found"), GRADED, TOTALS, PACKAGES, REPORTED], JSON_REPORT),
        "markdown_report": sql(
            findings() + [NUMBERED, NAMES, _counts("found"), GRADED, TOTALS, PACKAGES, REPORTED], MARKDOWN_REPORT.replace("LINES_HERE", LINE_COUNT)
        ),
    }
    streamed = findings()
    streamed = [c.replace("UNION ALL SELECT * FROM meta_files", "") if c.startswith("files AS") else c for c in streamed]
    out["stream_findings"] = sql(streamed, f"SELECT {WHERE} FROM found")
    out["stream_grades"] = sql(
        streamed + [_counts("found")],
        f"SELECT scan_id, total, suppressed, score, {GRADE} AS grade FROM (SELECT *, greatest(0, 100 - penalty) AS score FROM counts)",
    )
    out["stream_status"] = sql(
        [c.replace("UNION ALL SELECT * FROM meta_files", "") if c.startswith("files AS") else c for c in corpus_ctes()],
        "SELECT scan_id, count(*) FILTER (NOT excluded AND reason IS NULL) AS files_scanned, true AS fatal FROM listed GROUP BY scan_id",
    )
    out["stream_regrade"] = out["stream_grades"]
    out["stream_valid"] = sql(findings() + [VALID], f"SELECT {WHERE} FROM found WHERE scan_id IN (SELECT scan_id FROM valid)")
    landed = [
        *streamed,
        "landed AS MATERIALIZED (SELECT scan_id, epoch_us(ts) AS us FROM found JOIN events ON event_id = CAST(regexp_extract(path, 'd(\\d+)\\.[^/]*$', 1) AS BIGINT) "
        "WHERE NOT false_positive)",
    ]
    out["stream_sliding"] = sql(
        landed,
        "SELECT scan_id, second AS from_second, second + 21600 AS to_second, count(*) AS findings FROM (SELECT scan_id, "
        "unnest([us // 7200000000 * 7200, us // 7200000000 * 7200 - 7200, us // 7200000000 * 7200 - 14400])::BIGINT AS second FROM landed) GROUP BY scan_id, second",
    )
    out["stream_sessions"] = sql(
        landed,
        "SELECT scan_id, min(us) // 1000000 AS from_second, (max(us) + 10800000000) // 1000000 AS to_second, count(*) AS findings FROM (SELECT *, "
        "sum(begins) OVER (PARTITION BY scan_id ORDER BY us) AS number FROM (SELECT *, (us - lag(us, 1, us - 99999999999) "
        "OVER (PARTITION BY scan_id ORDER BY us) > 10800000000)::INT AS begins FROM landed)) GROUP BY scan_id, number",
    )
    out["stream_once"] = "SELECT source AS scan_id, count(*) AS files FROM documents GROUP BY source"
    return out
