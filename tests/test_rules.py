"""Every rule on code it should and should not report, and agreement with Python's matcher."""

import random
import re
import time

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sigsift.catalog import RULES, Rule, check_rules, quote, risky_rules, rules_frame
from sigsift.config import ScanConfig
from sigsift.functions import text as tx
from sigsift.operators import matching, ruleset
from sigsift.plans.scan import scan
from sigsift.sources.corpus import SEEDS
from tests.conftest import README

BLOB = "QUFB" * 40

CASES = {
    "PHP-RCE-001": ("eval($x)", "eval('x')"),
    "PHP-RCE-002": ("eval( base64_decode('eA=='))", "eval(base64_encode('x'))"),
    "PHP-RCE-003": ("eval(gzinflate ($z))", "eval(gzdeflate($z))"),
    "PHP-RCE-004": ("assert($a)", "assert(true)"),
    "PHP-RCE-005": ("preg_replace('/a/e', $b, $c)", "preg_replace('/a/i', $b, $c)"),
    "PHP-RCE-006": ("$fn($x)", "$fn('x')"),
    "PHP-RCE-007": ("create_function('$a', 'x')", "recreate_functions('x')"),
    "PHP-RCE-008": ("call_user_func_array($cb, [])", "call_user_func('cb')"),
    "PHP-CMD-001": ("system($c)", "filesystem($c)"),
    "PHP-CMD-002": ("exec($c)", "shell_exec($c)"),
    "PHP-CMD-003": ("passthru($c)", "passthru('ls')"),
    "PHP-CMD-004": ("`$cmd -l`", "`ls -l`"),
    "PHP-CMD-005": ("popen($c, 'r')", "popen('ls', 'r')"),
    "PHP-CMD-006": ("proc_open('ls')", "proc_opens('ls')"),
    "PHP-SQLI-001": ("$wpdb->query(\"SELECT $id\")", "$wpdb->query('SELECT 1')"),
    "PHP-SQLI-002": ("$wpdb->get_var('a' . $id)", "$wpdb->get_var('a') . $id"),
    "PHP-SQLI-003": ("$wpdb->insert($_POST['x'])", "$wpdb->insert($x)"),
    "PHP-SQLI-004": ("LIKE '%$t'", "LIKE '%t'"),
    "PHP-XSS-001": ("echo $_GET['a']", "echo $_FILES['a']"),
    "PHP-XSS-002": ("echo 'a' . $b", "echo 'a'; $b"),
    "PHP-XSS-003": ("$_SERVER[ 'REQUEST_URI' ]", "$_SERVER['REQUEST_URL']"),
    "PHP-XSS-004": ("$_SERVER[\"PHP_SELF\"]", "$_SERVER[PHP_SELF]"),
    "PHP-CSRF-001": ("if (isset($_POST['a']))", "if (isset($a))"),
    "PHP-CSRF-002": ("wp_ajax_go', function", "wp_ajax_go', 'cb'"),
    "PHP-LFI-001": ("require_once($p)", "require_once('p')"),
    "PHP-LFI-002": ("file_get_contents($_GET['f'])", "file_get_contents($f)"),
    "PHP-UPLOAD-001": ("move_uploaded_file($a, $b)", "remove_uploaded_file($a)"),
    "PHP-DESER-001": ("unserialize($_COOKIE['c'])", "unserialize($c)"),
    "PHP-DESER-002": ("unserialize($c)", "unserialize('c')"),
    "PHP-AUTH-001": ("add_action('wp_ajax_x', 'y')", "add_action('init', 'y')"),
    "PHP-AUTH-002": ("is_admin( )", "is_admin($u)"),
    "PHP-AUTH-003": ("'permission_callback' => '__return_true'", "'permission_callback' => 'check'"),
    "PHP-REDIR-001": ("wp_redirect($_GET['u'])", "wp_redirect($u)"),
    "PHP-REDIR-002": ("header('Location: ' . $u)", "header('Location: /home')"),
    "PHP-INFO-001": ("phpinfo()", "myphpinfo()"),
    "PHP-INFO-002": ("error_reporting(E_ALL)", "error_reporting(0)"),
    "PHP-INFO-003": ("print_r($x)", "print_r('x')"),
    "PHP-CRYPTO-001": ("md5($pass)", "md5($file)"),
    "PHP-CRYPTO-002": ("sha1($x)", "sha1('x')"),
    "PHP-CRYPTO-003": ("api_key = 'ABCDEFGH'", "api_key = 'ABC'"),
    "PHP-MALWARE-001": ("system(rawurldecode('x'))", "system(rawurlencode('x'))"),
    "PHP-MALWARE-002": (f"'{BLOB}=='", f"'{BLOB[:99]}'"),
    "PHP-MALWARE-003": ("assert(pack('H*', $x))", "assert(pack('N', $x))"),
    "PHP-MALWARE-004": ("fopen('https://e.x/')", "fopen('ftp://e.x/')"),
    "PHP-MALWARE-005": ("passthru($_REQUEST['c'])", "passthru($_SERVER['c'])"),
    "PHP-MALWARE-006": ("wp_create_user('a')", "wp_update_user('a')"),
    "PHP-MALWARE-007": ("chr(1).chr(2).chr(3).chr(4).chr(5)", "chr(1).chr(2).chr(3).chr(4)"),
    "PHP-MALWARE-008": ("str_rot13('x')", "str_rot13($x)"),
    "PHP-MALWARE-009": ("curl_setopt($c, CURLOPT_POSTFIELDS, $_POST)", "curl_setopt($c, CURLOPT_POSTFIELDS, $x)"),
    "PHP-MALWARE-010": ("CoinHive.start()", "coin hive"),
    "PHP-MALWARE-011": ("$f(hex2bin($x))", "f(hex2bin($x))"),
    "PHP-MALWARE-012": ("@ eval('x')", "eval('x')"),
    "PHP-MALWARE-013": ("$$a = $_GET['b']", "$a = $_GET['b']"),
    "PHP-MALWARE-014": ("wp_remote_post($u, $_POST)", "wp_remote_post($u);\n$_POST"),
    "PHP-BP-001": ("$_GET['a'];", "$_GET['a'] )"),
    "PHP-BP-002": ("extract($a)", "extract(['a' => 1])"),
    "PHP-BP-003": ("mysql_query('q')", "mysqli_query('q')"),
    "PHP-BP-004": ("x$_REQUEST", " $_REQUEST"),
    "JS-XSS-001": ("a.innerHTML = b", "a.innerHTML = '<b>'"),
    "JS-XSS-002": ("document.write(a)", "document.writeln(a)"),
    "JS-RCE-001": ("eval('a')", "evaluate('a')"),
    "JS-MALWARE-001": ("eval(window.atob('a'))", "eval(btoa('a'))"),
    "JS-RCE-002": ("new Function('a')", "new Functional('a')"),
    "JS-MALWARE-002": ("String.fromCharCode(1,2,3,4,5,6)", "String.fromCharCode(1,2,3,4,5)"),
    "JS-AJAX-001": ("fetch('/admin-ajax.php')", "fetch('/x')\nadmin-ajax.php"),
    "JS-PROTO-001": ("constructor['prototype']", "constructor.prototype"),
    "JS-EXT-001": ("createElement('script')", "createElement('div')"),
}
# the near miss of these is reported by the rule on purpose
EDGE = [
    "", "\n", "evalé($x) éeval($x)", "EVAL($x)", "İs_admın()", "ſystem($c)", "mysqſ", "echo $aéb",
    "\U0001f600 eval($x) \U0001f600\neval($y)", "a\r\neval($x)\r\n\r\neval($y)", "\u2028eval($x)", "x\u0085eval($y)",
    "eval($a)eval($b)\neval($c)", "echo $wpdb; echo $wpdbx; echo $a", "md5($filename) md5($x)",
]


def expected(text):
    out = []
    for rule in RULES:
        for m in re.finditer(rule.pattern, text, re.IGNORECASE | re.MULTILINE):
            lines = text[: m.start()].splitlines(keepends=True) or [""]
            broken = lines[-1].endswith(("\r", "\n", "\u2028", "\u0085"))
            line = len(lines) + (1 if broken else 0)
            column = 1 if broken else len(lines[-1]) + 1
            out.append((rule.rule_id, m.start(), line, column))
    return sorted(out)


def test_catalog_is_complete():
    assert len(RULES) == 67
    assert set(CASES) == {r.rule_id for r in RULES}
    assert sum(r.rule_id.startswith("PHP") for r in RULES) == 58


@pytest.fixture(scope="module")
def located(spark):
    """Matches of all rules on all sample texts, languages ignored."""
    every = ScanConfig(rules=tuple(Rule(**{**r.__dict__, "languages": ("any",)}) for r in RULES))
    samples = [t for pair in CASES.values() for t in pair] + EDGE + list(SEEDS)
    rows = [(str(n), f"{n}.x", t, "any") for n, t in enumerate(samples)]
    frame = spark.createDataFrame(rows, "scan_id string, path string, text string, language string").withColumn(
        "content", F.col("text").cast("binary")
    )
    placed = matching.with_places(frame, every)
    found = (
        placed.select("scan_id", F.explode_outer("places").alias("p"))
        .where("p IS NOT NULL")
        .select("scan_id", "p.rule_ord", F.explode("p.at").alias("s"))
        .collect()
    )
    got = {n: [] for n in range(len(samples))}
    for row in found:
        got[int(row.scan_id)].append((RULES[row.rule_ord - 1].rule_id, row.s.start, row.s.line, row.s.col))
    return samples, {n: sorted(v) for n, v in got.items()}


@pytest.mark.parametrize("rule_id", CASES)
def test_rule_hits_and_misses(located, rule_id):
    samples, got = located
    hit, miss = CASES[rule_id]
    assert rule_id in {r for r, *_ in got[samples.index(hit)]}
    assert rule_id not in {r for r, *_ in got[samples.index(miss)]}


def test_positions_agree_with_python(located):
    samples, got = located
    wrong = [(t, got[n], expected(t)) for n, t in enumerate(samples) if got[n] != expected(t)]
    assert wrong == []


WITH_RUN = [r for r in RULES if r.run]
PARTS = (
    "$wpdb", "->", "query", "insert", "(", ")", ";", "\n", " ", "  ", ".", "$", "$a", "$_GET", "$_POST", "$_REQUEST", "['", "a']", "']", "]", "'", '"', "echo ", "echo",
    "ECHO\t", "xecho ", "wpdb", "é", "ini_set", "ınİ_set(", "error_reporting", "E_ALL", "display_errors", "curl_setopt", "CURLOPT_POSTFIELDS", ",", "if", "isset",
    "jQuery.ajax", "fetch", "XMLHttpRequest", "admin-ajax.php", "\r\n", "\u2028", "😀",
)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.integers(0, 2**32))
def test_runs_match_what_the_patterns_match(spark, seed):
    rng = random.Random(seed)
    texts = ["".join(rng.choices(PARTS, k=rng.randrange(60))) for _ in range(400)]
    # parts of one rule only meet more often
    for rule in WITH_RUN:
        own = [p for p in PARTS if re.search(re.escape(p.strip() or p), rule.pattern.replace("\\", ""), re.I)] + [" ", ")", ";", "$_GET", "$a", "]", "\n", "a']"]
        texts += ["".join(rng.choices(own, k=rng.randrange(30))) for _ in range(100)]
    frame = spark.createDataFrame([(t,) for t in texts], "text string")
    for rule in WITH_RUN:
        search = F.lit(rule.search_pattern)
        rows = frame.select(
            "text", F.regexp_extract_all("text", F.lit(rule.jvm_pattern), F.lit(0)).alias("plain"), F.regexp_extract_all("text", search, F.lit(2)).alias("found"),
            F.regexp_extract_all("text", search, F.lit(1)).alias("before"), F.rlike("text", search).alias("hit"),
        ).collect()
        for r in rows:
            there = [m for m in re.finditer(rule.pattern, r.text, re.IGNORECASE | re.MULTILINE)]
            assert r.found == r.plain == [m[0] for m in there] and r.hit == bool(there), (rule.rule_id, r.text)
            ends = [0] + [m.end() for m in there]
            assert r.before == [r.text[e : m.start()] for e, m in zip(ends, there, strict=False)], (rule.rule_id, r.text)


@pytest.mark.parametrize(
    "opening", ["echo $wpdb ", "$wpdb->query(", "$wpdb -> x ( ", "ini_set('a', ", "curl_setopt($c, CURLOPT_POSTFIELDS, ", "curl_setopt(", "if (isset($_POST ", "$_GET['a", "fetch "],
)
def test_openings_without_a_delimiter(spark, files, opening):
    text = opening * (20_000_000 // len(opening))
    rows = files({"a.js" if opening == "fetch " else "a.php": text + ("\nadmin-ajax.php" if opening == "fetch " else "")})
    only = ScanConfig(rules=tuple(r for r in WITH_RUN))
    start = time.monotonic()
    matching.with_places(rows.selectExpr("*", f"'{'js' if opening == 'fetch ' else 'php'}' AS language"), only).select(F.size("hits")).collect()
    assert time.monotonic() - start < 60


def test_hostile_chains_do_not_overflow(spark, files):
    chains = {"a.php": "chr(101)." * 200_000, "b.js": "fromCharCode(" + "1," * 200_000 + "1)"}
    frame = files(chains).withColumn("language", F.when(F.col("path") == "a.php", "php").otherwise("js"))
    hits = matching.with_hits(frame, ScanConfig()).select("path", "hits").collect()
    ids = {r.path: {RULES[h - 1].rule_id for h in r.hits} for r in hits}
    assert "PHP-MALWARE-007" in ids["a.php"] and "JS-MALWARE-002" in ids["b.js"]


def test_literal_rules_match_themselves(spark, files):
    rule = Rule("X-1", "literal", 5, "a.b(\\E$", is_regex=False)
    frame = files({"a.php": "A.B(\\E$ and axb(\\E$"}).withColumn("language", F.lit("php"))
    placed = matching.with_places(frame, ScanConfig(rules=(rule,))).select("places").first()[0]
    assert [s.start for s in placed[0]["at"]] == [0]
    assert quote("a\\Eb") == "\\Qa\\E\\\\E\\Qb\\E"


def test_rules_in_both_dialects(spark, files):
    rules = (
        Rule("X-1", "name", 5, "(?P<my_name>foo)"), Rule("X-2", "reference", 5, "(?P<n>a)b(?P=n)b"), Rule("X-3", "literal", 5, "FOO", literals=("FOO",)),
        Rule("X-4", "suppressed", 5, "foo", fp_patterns=("(?P<q>abc)",)), Rule("X-5", "class", 5, r"\p{L}oo"), Rule("X-6", "risky", 5, "(?:ab?)+c"),
        Rule("X-1", "same id, bad", 5, "("),
    )
    assert [m.split()[1] for m in check_rules(rules)] == ["X-1"]
    t = scan(files({"readme.txt": README, "a.php": "abc foo abab c"}), ScanConfig(rules=rules))
    found = sorted((r.rule_id, r.title, r.false_positive) for r in t.findings.collect())
    assert found == [
        ("X-1", "name", False), ("X-2", "reference", False), ("X-3", "literal", False), ("X-4", "suppressed", True), ("X-5", "class", False),
        ("X-6", "risky", False),
    ]
    messages = [r.message for r in t.scan_errors.collect()]
    assert len(messages) == 2 and any("X-6" in m and "stack" in m for m in messages)


def test_bad_rules_are_reported(spark):
    bad = Rule("X-1", "bad", 5, "(")
    empty = Rule("X-2", "empty", 5, "a*")
    assert [m.split()[1] for m in check_rules([*RULES, bad, empty])] == ["X-1", "X-2"]
    assert [r.rule_id for _, r in ruleset.usable(ScanConfig(rules=(bad, RULES[0])))] == ["PHP-RCE-001"]
    assert risky_rules([Rule("X-3", "risky", 5, "(?:ab?)+")]) == ["X-3"]
    assert risky_rules(RULES) == []


def test_patterns_are_tried_in_one_job(spark):
    rules = [Rule(f"X-{n}", "x", 5, f"own pattern {n}" + "(" * (n % 50 == 0)) for n in range(300)]
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("patterns", "patterns")
    broken = check_rules(rules)
    assert len(tracker.getJobIdsForGroup("patterns")) <= 1 and len(broken) == 6 and "cannot be compiled" in broken[0]
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_index_of_literals(spark):
    words = ["exec", "shell_exec", "shell", "$", "$_", "a.b", "(", "\\", "é", "[x]", "ab", "abc", "bc", "c-d", "x y", "#"]
    texts = ["", "shell_exec($_x)", "a.b axb [x] \\ é", "abcab bc-d", "x y x  y #", "shell exec", "éé$é$_"]
    frame = spark.createDataFrame([(t,) for t in texts], "folded string")
    found = frame.select("folded", F.array_distinct(F.regexp_extract_all("folded", F.lit(ruleset.trie_pattern(words)), F.lit(1))).alias("found")).collect()
    for r in found:
        begins = {max((w for w in words if r.folded.startswith(w, n)), key=len, default=None) for n in range(len(r.folded))} - {None}
        assert set(r.found) == begins


def test_large_sets_of_rules_hit_like_small_ones(located, spark, files):
    samples, _ = located
    rows = files({f"{n}.php": t for n, t in enumerate(samples)}).withColumn("language", F.element_at(F.array(*map(F.lit, ("php", "js", "unknown"))), F.pmod(F.xxhash64("path"), F.lit(3)).cast("int") + 1))
    own = (Rule("X-1", "no literal", 5, "k[a-z]e"), Rule("X-2", "broken", 5, "("), Rule("X-3", "any case", 3, "EVAL", literals=("EVAL", "eva"), languages=("js",)))
    config = ScanConfig(rules=(*RULES, *own))
    texts = matching.with_text(rows, config)
    both = texts.select(matching.hit_rules(config).alias("small"), ruleset.hit_rules(config).alias("large")).collect()
    assert len(ruleset.usable(config)) < ruleset.LARGE and [r.small for r in both] == [r.large for r in both] and sum(map(len, (r.small for r in both))) > 100


def test_ten_thousand_rules(spark, files):
    rules = RULES + tuple(Rule(f"X-{n}", "number", 4, rf"\bno{n}\b", literals=(f"no{n}",), fp_patterns=(f"not no{n}",)) for n in range(10_000))
    start = time.monotonic()
    t = scan(files({"readme.txt": README, "a.php": "eval($x) no12 no123\nnot no7777 xno5 no10000 no9999", "b.php": "no12"}), ScanConfig(rules=rules))
    found = sorted((r.path, r.rule_id, r.line_number, r.false_positive) for r in t.findings.collect())
    assert found == [
        ("a.php", "PHP-RCE-001", 1, False), ("a.php", "X-12", 1, False), ("a.php", "X-123", 1, False), ("a.php", "X-7777", 2, True), ("a.php", "X-9999", 2, False), ("b.php", "X-12", 1, False),
    ]
    assert time.monotonic() - start < 90


def test_rules_table(spark):
    table = rules_frame(spark)
    assert table.count() == 67
    assert [r.rule_id for r in table.orderBy("rule_ord").limit(2).collect()] == ["PHP-RCE-001", "PHP-RCE-002"]
    assert tx.sql_string("a'\\") == "'a\\'\\\\'"


def test_matches_that_begin_with_a_line_feed(files):
    text = "a\r\nq\r\nq b\nq\r\r\nq"
    rule = Rule("X-1", "lf", 5, r"\nq", is_regex=True)
    frame = files({"a.php": text}).withColumn("language", F.lit("php"))
    place = matching.with_places(frame, ScanConfig(rules=(rule,))).select("places").first()[0][0]
    starts, at = [], 0
    for line in text.splitlines(keepends=True):
        starts.append(at)
        at += len(line)
    want = []
    for m in re.finditer(rule.pattern, text):
        line = sum(s <= m.start() for s in starts)
        want.append((m.start(), line, m.start() - starts[line - 1] + 1))
    assert [(s.start, s.line, s.col) for s in place["at"]] == want
