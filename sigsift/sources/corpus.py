"""A test corpus of packages made from the ``documents`` and ``pages`` tables.

Each document becomes one file: its own text plus a snippet chosen by its
number, so that every rule meets code it should and should not report.
"""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sigsift.sources.tables import FILE_COLUMNS, from_table

LONG_BLOB = "QUFB" * 40
EXTENSIONS = (".php", ".php", ".php", ".inc", ".js", ".ts", ".png", ".twig")

SEEDS = tuple(
    s.replace("LONGBLOB", LONG_BLOB)
    for s in (
        "plain text only",
        "eval($_GET['cmd']); // a",
        "eval(\n  base64_decode('PD9waHA=')\n);",
        "$wpdb->query(\"SELECT * FROM t WHERE id = \" . $id);",
        "$sql = $wpdb->prepare($q, 1);\n$wpdb->query(\"SELECT $id\");",
        "echo $_POST['user_input'];",
        "echo esc_html($name);",
        "if (isset($_POST['save'])) { save(); }\nadd_action('wp_ajax_save', 'cb');",
        "check_admin_referer('x');\nif (isset($_POST['save'])) { save(); }",
        "register_rest_route('a/v1', '/s', ['permission_callback' => '__return_true']);\nwp_redirect($_GET['u']);",
        "$x = chr(101).chr(118).chr(97).chr(108).chr(40).chr(41).chr(59).chr(60);\n@eval(gzinflate($x));",
        "system($cmd); exec($cmd); passthru($cmd); shell_exec($cmd); popen($cmd); proc_open($cmd);",
        "unserialize($_COOKIE['p']);\nextract($args);\nmysql_query('q');",
        "md5($pass); md5($file); sha1($pass);\n$api_key = 'ABCDEFGH12345678';",
        "el.innerHTML = data;\nel.innerHTML = '<b>x</b>';\ndocument.write(x);",
        "eval(atob('eA=='));\nnew Function('x');\nString.fromCharCode(1,2,3,4,5,6,7);",
        "jQuery.post('/wp-admin/admin-ajax.php');\nobj.__proto__ = y;\ns.src = 'https://cdn.example.com/a.js';",
        "include($page); file_get_contents($_GET['f']); move_uploaded_file($a, $b);\nphpinfo(); var_dump($x);",
        "$f(base64_decode('eA==')); $$a = $_GET['b'];\nwp_insert_user($u);\nfopen('https://example.com/x');",
        "$v = 'LONGBLOB';\nstr_rot13('nop');\nini_set('display_errors', 1);\n$_SERVER['REQUEST_URI'];",
        "assert($a); preg_replace('/x/e', 'y', $z); $f($x); create_function('$a', 'b'); call_user_func($cb);",
        "$wpdb->query($_GET['id']);\n$q = \"LIKE '%$term\";\nheader('Location: ' . $u);\n$_SERVER['PHP_SELF'];\nis_admin();",
        "eval(hex2bin($h)); curl_setopt($c, CURLOPT_POSTFIELDS, $_POST);\nwp_remote_post($u, $_POST);\ncoinhive\nadd_action('wp_ajax_go', function() {});",
        "x$_REQUEST['a'];\necho $a . $b;\neval(base64_decode('LONGBLOB'));",
    )
)


def _pick(values, index: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), index.cast("int"))


def documents_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _spread(frame: DataFrame) -> DataFrame:
    """The test tables are single small files: give every core a part of them."""
    return frame.repartition(frame.sparkSession.sparkContext.defaultParallelism)


def files_of(documents: DataFrame, extra: list[Column] = (), some_empty: bool = False) -> DataFrame:
    """Documents, as a table or a stream, as files; ``extra`` columns are kept."""
    doc = F.col("doc_id")
    folder = F.when(doc % 13 == 0, "node_modules/").when(doc % 17 == 0, "a/build/").otherwise("src/")
    path = F.concat(folder, F.lit("d"), doc, _pick(EXTENSIONS, doc % len(EXTENSIONS)))
    seed = _pick(SEEDS, F.floor(doc / len(EXTENSIONS)) % len(SEEDS))
    text = F.concat("text", F.lit("\n"), seed)
    if some_empty:
        text = F.when(doc % 41 == 40, F.lit("")).otherwise(text)
    return from_table(documents, F.col("source"), path, text, extra)


def document_files(spark: SparkSession, sf_dir: str, some_empty: bool = False) -> DataFrame:
    documents = _spread(documents_table(spark, sf_dir).select("doc_id", "source", "text"))
    return files_of(documents, some_empty=some_empty)


def metadata_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The readme or header file of each package that has one."""
    kind = F.substring("source", 4, 10).cast("int") % 3
    sources = documents_table(spark, sf_dir).select("source").distinct().withColumn("k", kind).where("k < 2")
    readme = F.concat(F.lit("=== Pkg "), "source", F.lit(" ===\nStable tag: 1."), F.col("k").cast("string"))
    header = F.concat(
        F.lit("<?php\n/*\n * Plugin Name: Pkg "), "source", F.lit("\n * Version: 2."), F.col("k").cast("string"),
        F.lit("\n */\n"),
    )
    first = F.col("k") == 0
    return from_table(
        sources,
        F.col("source"),
        F.when(first, "readme.txt").otherwise("plugin.php"),
        F.when(first, readme).otherwise(header),
    )


def corpus_files(spark: SparkSession, sf_dir: str, some_empty: bool = False) -> DataFrame:
    """The whole corpus: documents as files plus each package's metadata file."""
    return document_files(spark, sf_dir, some_empty).unionByName(metadata_files(spark, sf_dir)).select(*FILE_COLUMNS)


def page_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Web pages as script files, one package per host."""
    pages = _spread(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
    host = F.regexp_extract("url", "^[a-z]+://([^/:?#]+)", 1)
    return from_table(pages, host, F.concat(F.lit("p"), "page_id", F.lit(".js")), F.col("html"))


def packed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file of noise-like bytes per document: digests of its text without zero nibbles."""
    documents = _spread(documents_table(spark, sf_dir).select("doc_id", "source", "text"))
    digests = F.concat(*[F.sha2(F.concat("text", F.lit(f"#{n}")), 256) for n in range(8)])
    content = F.unhex(F.translate(digests, "0", "f"))
    return documents.select(
        F.col("source").alias("scan_id"),
        F.concat(F.lit("packed/p"), "doc_id", F.lit(".php")).alias("path"),
        # eight digests of 32 bytes each
        F.lit(256).cast("bigint").alias("length"),
        content.alias("content"),
    )


def gated_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents some of which carry a NUL, in front or at the end."""
    doc = F.col("doc_id")
    nul = F.lit("\u0000")
    text = F.when(doc % 7 == 0, F.concat(nul, "text")).when(doc % 7 == 1, F.concat("text", nul)).otherwise(F.col("text"))
    documents = _spread(documents_table(spark, sf_dir).select("doc_id", "source", "text"))
    return from_table(documents, F.col("source"), F.concat(F.lit("t"), "doc_id", F.lit(".php")), text)


def archive_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A member table: each package's documents as the directory of one archive."""
    doc = F.col("doc_id")
    documents = documents_table(spark, sf_dir).select("doc_id", "source", "n_chars")
    name = (
        F.when(doc % 97 == 0, "../evil.php").when(doc % 89 == 0, "/abs.php").otherwise(F.concat(F.lit("src/d"), doc, F.lit(".php")))
    )
    return documents.select(
        F.col("source").alias("scan_id"),
        doc.alias("member_ord"),
        name.alias("name"),
        (F.col("n_chars") * 5000).alias("size"),
        F.when(doc % 101 == 0, 0o120777).otherwise(0o100644).alias("mode"),
    )


def responses(batched: DataFrame) -> DataFrame:
    """Made-up reviewer answers for a batch table, some incomplete, some with a preamble, some failed."""
    no = F.col("batch_no")
    block = F.concat(
        F.lit("FINDING "), F.col("pos").cast("string"), F.lit(":\nVERDICT: "),
        F.when((no + F.col("pos")) % 3 == 0, "FALSE_POSITIVE").otherwise("TRUE_POSITIVE"),
        F.lit("\nSEVERITY: LOW\nANALYSIS: note on "), F.col("rule_id"), F.lit("\nmore text\n"),
    )
    grouped = (
        batched.select("scan_id", "batch_no", F.struct("pos", block.alias("text")).alias("b"))
        .groupBy("scan_id", "batch_no")
        .agg(F.array_sort(F.collect_list("b")).alias("bs"))
    )
    kept = F.when(no % 5 == 4, F.slice("bs", F.lit(1), F.size("bs") - 1)).otherwise(F.col("bs"))
    intro = F.when(no % 7 == 6, "Here is my view.\n").otherwise("")
    return grouped.select(
        "scan_id",
        "batch_no",
        F.concat(intro, F.array_join(F.transform(kept, lambda b: b["text"]), "")).alias("response"),
        F.when(no % 11 == 10, "timeout").alias("error"),
    )


def _zipped(rows: pd.DataFrame) -> pd.DataFrame:
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as archive:
        for path, text in zip(rows["path"], rows["text"], strict=True):
            archive.writestr(path, text)
    return pd.DataFrame([(rows["scan_id"].iloc[0], buffer.getvalue())], columns=["scan_id", "content"])


def document_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every ten documents as an archive, names repeated over two folders; of each thirteenth one member climbs out."""
    ten = F.floor(F.col("doc_id") / 10)
    name = F.concat(F.lit("v"), (ten % 2).cast("string"), F.lit("/a"), F.floor(ten / 2).cast("string"), F.lit(".zip"))
    climbs = (ten % 13 == 12) & (F.col("doc_id") % 10 == 3)
    path = F.concat(F.when(climbs, "../").otherwise(""), F.lit("d"), F.col("doc_id").cast("string"), F.lit(".php"))
    members = documents_table(spark, sf_dir).select(name.alias("scan_id"), path.alias("path"), "text")
    return members.groupBy("scan_id").applyInPandas(_zipped, "scan_id string, content binary")
