"""Personal data, fingerprints, neighbours and URLs against plain versions."""

import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigsift.llm import ann, fingerprints, pii, urls
from sigsift.llm.queries import QUERIES, URL_RULES

SF = "/root/testdata/sf0.001"
BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    return sum(int(c) if n % 2 == 0 else sum(divmod(2 * int(c), 10)) for n, c in enumerate(reversed(digits))) % 10 == 0


def fits(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    return {"email": True, "card": 14 <= len(digits) <= 19 and luhn(digits), "phone": 10 <= len(digits) <= 15}[kind]


def base_spans(text):
    found = [(m.start(), n, k, m.end()) for n, (k, p) in enumerate(BASE.items()) for m in re.finditer(p, text or "") if fits(k, m[0])]
    return [f"{k}:{s}:{e}" for s, _, k, e in sorted(found)]


TEXTS = [
    None, "", "a@b", "a@b.c%x@d.e @x.y", "1.2.3.4.5.6.7.8 300.1.1.1 000255.1.1.1 1.1.1.99999999999999999999",
    "4111 1111 1111 1111, 4111-1111-1111-1112 5", "+1 (487) 555-7209+1 (487) 555-7209 +1--------9 +12",
    "é😀 x@y.zé 😀4111111111111111", "GB82 WEST 1234 5698 7654 32 and GB82 WEST 1234 5698 7654 33", "my ssn is 123-45-6789; id 123-45-6789",
    "a" * 50_000 + "@" + "b." * 2_000 + "c", "1" * 60_000, "12 " * 20_000, "+" * 1000 + "1 2 3", "x@y.zz " * 3_000,
]


def test_spans_equal_plain_search(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    got = {r.doc_id: r for r in pii.find(docs).select("doc_id", pii.listed(F.col("base")).alias("base"), pii.listed(F.col("spans")).alias("spans")).collect()}
    for n, text in enumerate(TEXTS):
        assert got[n].base == ",".join(base_spans(text)), text
        assert {*got[n].base.split(",")} - {""} <= {*got[n].spans.split(",")}
    assert "iban:0:27" in got[8].spans and got[8].spans.count("iban") == 1
    assert got[9].spans.count("ssn") >= 1


NUMBERS = ["AT611904300234573201", "ES91 2100 0418 4502 0005 1332", "GB82 WEST 1234 5698 7654 32", "NO93 8601 1117 947"]


@pytest.mark.parametrize("after", ["", " BIC", " BIC BKAUATWW", " 2024", " A", " AT611904300234573201", ", x"])
def test_account_numbers_before_words(spark, after):
    docs = spark.createDataFrame([(n, f"IBAN {x}{after}") for n, x in enumerate(NUMBERS)], "doc_id long, text string")
    for r in pii.find(docs).collect():
        found = [x.value for x in r.spans if x.kind == "iban"]
        assert found == [NUMBERS[r.doc_id]] + [after.strip()] * ("AT6" in after)


def test_pii_query(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = QUERIES["op2_pii"](spark, SF).collect()
    assert {r.doc_id for r in rows} == set(texts)
    for r in rows:
        spans = base_spans(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(spans).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s.startswith(k) for s in spans) for k in BASE]


def shingles(text):
    w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    return {tuple(w[n : n + 5]) for n in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def test_fingerprint_query(spark):
    docs = sorted(spark.read.parquet(f"{SF}/documents.parquet").collect(), key=lambda r: r.doc_id)
    got = {r.doc_id: r for r in QUERIES["op4_fingerprints"](spark, SF).collect()}
    errors, by_text = [], {}
    for n, d in enumerate(docs):
        after, r = docs[(n + 1) % len(docs)].text, got[d.doc_id]
        q = len(d.text) // 4
        edited = d.text[: len(d.text) - q] + after[:q]
        assert (r.n_chars, r.edited_sha256) == (len(d.text), hashlib.sha256(edited.encode()).hexdigest())
        for near, other in ((r.near_edited, edited), (r.near_next, after)):
            a, b = shingles(d.text), shingles(other)
            errors.append(abs(near - len(a & b) / max(1, len(a | b))))
        assert by_text.setdefault(d.text, r.fingerprint) == r.fingerprint
    assert np.mean(errors) < 0.05


@pytest.mark.parametrize("slices", [1, 3, 50])
def test_next_document_whatever_the_slices(spark, slices):
    rows = [(n * n - 40, f"w{n} " * (n % 7) + "é😀" * (n % 5)) for n in range(30)] + [(10**12, None), (-(10**15), "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    rows = sorted((k, t or "") for k, t in rows)
    got = {r.doc_id: r.edited_sha256 for r in fingerprints.with_edits(docs, slices=slices).collect()}
    for n, (key, text) in enumerate(rows):
        q = len(text) // 4
        assert got[key] == hashlib.sha256((text[: len(text) - q] + rows[(n + 1) % len(rows)][1][:q]).encode()).hexdigest()


def test_sketches_of_unequal_texts(spark):
    words = [f"w{n}" for n in range(4000)]
    docs = spark.createDataFrame([(0, " ".join(words[:400])), (1, " ".join(words))], "doc_id long, text string")
    a, b = (r.sketch for r in fingerprints.sketch(docs).orderBy("doc_id").collect())
    assert set(a.hashes) <= set(b.hashes) and 50 < len(a.hashes) < 150


def nearest(vectors, asked, count):
    out = {}
    for n in asked:
        order = sorted((-float(np.dot(vectors[n], v)), m) for m, v in vectors.items() if m != n)
        out[n] = [m for _, m in order[:count]]
    return out


@pytest.mark.parametrize("sf", [SF, "/root/testdata/sf0.01"])
def test_recall_and_scores(spark, sf):
    vectors = {r.vec_id: np.array(r.embedding, np.float64) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()}
    asked = [n for n in vectors if n % 20 == 0]
    got, true = {}, nearest(vectors, asked, 20)
    for r in QUERIES["op1_ann"](spark, sf).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(got[r.query_id]) and abs(r.score - np.dot(vectors[r.query_id], vectors[r.vec_id])) < 1e-12
    recall = np.mean([len({m for m, _ in got[n]} & set(true[n])) / len(true[n]) for n in asked])
    assert recall >= 0.9 and got.keys() == true.keys()


def test_neighbours_of_odd_vectors(spark):
    rng = np.random.default_rng(3)
    rows = [(n, [float(x) for x in rng.normal(size=6)], "x") for n in range(60)] + [(100 + n, [1.0, 0.0, 0.0, 0.0, 0.0, 0.0], "x") for n in range(50)]
    rows += [(200, None, "x"), (201, [0.0] * 6, "x"), (202, [float("nan")] * 6, "x"), (203, [float("inf")] * 6, "x"), (204, [None] * 6, "x"), (205, [50.0] * 6, "x"), (None, [1.0] * 6, "x")]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank string").withColumn("_id", F.lit(1))
    vectors = {k: np.array(np.float32(v), np.float64) for k, v, _ in rows if k is not None and (k < 200 or k == 205)}
    got = {}
    for r in ann.nearest(table, F.col("vec_id") % 20 == 0, probes=16).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    true = nearest(vectors, [n for n in vectors if n % 20 == 0], 20)
    assert got == true  # copies tie: the smaller ids; every bucket is searched
    assert ann.nearest(table.where("false"), F.col("vec_id") % 20 == 0).count() == 0
    alone = ann.nearest(table.where("vec_id IN (0, 1)"), F.col("vec_id") % 20 == 0).collect()
    assert [(r.query_id, r.vec_id) for r in alone] == [(0, 1)]


def found_and_true(spark, rows, asked):
    """The neighbours found, and those of the plain search; ids below ``asked`` are queries."""
    table = spark.createDataFrame([(n, v.tolist()) for n, v in enumerate(rows)], "vec_id long, embedding array<double>")
    got = {}
    for r in ann.nearest(table, F.col("vec_id") < asked).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    return got, nearest(dict(enumerate(rows)), range(asked), 20)


def test_neighbours_in_few_vectors(spark):
    rows = np.random.default_rng(1).normal(size=(25, 64))
    got, true = found_and_true(spark, rows / np.linalg.norm(rows, axis=1, keepdims=True), 25)
    assert got == true


def test_neighbours_of_outliers(spark):
    rng = np.random.default_rng(2)
    rows = rng.normal(size=64) + 0.05 * rng.normal(size=(2000, 64))
    rows[:10] = rng.normal(size=(10, 64))
    got, true = found_and_true(spark, rows / np.linalg.norm(rows, axis=1, keepdims=True), 10)
    assert all(len(v) == 20 for v in got.values()) and np.mean([len({*got[n]} & {*true[n]}) / 20 for n in true]) >= 0.9


def test_neighbours_of_mixed_lengths(spark):
    rng = np.random.default_rng(4)
    rows = rng.normal(size=(2000, 64))
    rows *= np.exp(rng.normal(size=(2000, 1))) / np.linalg.norm(rows, axis=1, keepdims=True)
    got, true = found_and_true(spark, rows, 20)
    assert np.mean([len({*got[n]} & {*true[n]}) / 20 for n in true]) >= 0.95


def test_queries_that_meet_only_themselves(spark):
    one = np.zeros(64)
    one[3] = 1.0
    cluster = -one + 0.01 * np.random.default_rng(8).normal(size=(500, 64))
    for rows, want in (([one], 0), ([one, -one], 1), ([one, *cluster], 20)):
        got, true = found_and_true(spark, np.array(rows), 1)
        assert got.get(0, []) == true[0] and len(true[0]) == want
    # copies of the query's own row leave room for those of other ids
    rows = [(0, one.tolist())] * 30 + [(n, one.tolist()) for n in range(1, 40)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = ann.nearest(table, F.col("vec_id") == 0).orderBy("rank").collect()
    assert {r.vec_id for r in got} == set(range(1, 21))


def test_buckets_of_several_axes():
    rows = np.random.default_rng(5).normal(size=(40, 8))
    rows /= np.linalg.norm(rows, axis=1, keepdims=True)
    found = ann._buckets(rows, 2, 2, 16)
    assert found.shape == (40, 2, 16) and (found[:, :, 0] == ann._buckets(rows, 2, 2, 1)[:, :, 0]).all() and found.max() < 256


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), re.match(r"[^?#]*", rest[len(host) :])[0]


def rule_of(host, path):
    fits = [r for r in URL_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.name), default=None)
    return (best.name, best.verdict) if best else (None, None)


URLS = [
    None, "", "no scheme", "http://", "HTTP://A.Example.ORG/es/1", "http://example.org/en/12?x=1", "http://example.org/en/2", "http://xexample.org/es/",
    "https://com/fr/", "https://a.com/de/x#y", "https://org", "https://org?x", "x://y://z/", "http://É.com/fr/", "http://a.b/" + "x" * 20_000, "http://a.com/fr", "http://\na.org/\n/b",
]


def test_url_rules(spark):
    pages = spark.createDataFrame([(n, u, "clash") for n, u in enumerate(URLS)] * 2, "page_id long, url string, score string")
    rows = urls.judged(pages, URL_RULES).collect()
    assert len(rows) == 2 * len(URLS)
    for r in rows:
        host, path = split(URLS[r.page_id])
        rule, verdict = rule_of(host, path)
        assert (r.host, r.path, r.rule) == (host, path, rule) and r.verdict == (verdict or r.verdict) and r.verdict in ("allow", "block"), URLS[r.page_id]
    assert urls.judged(pages.where("false"), URL_RULES).count() == 0


def test_learned_verdicts(spark):
    rows = [(n, f"http://host{n % 9}.net/{'a' * (n % 5)}/{'7' * (20 if n % 2 else 1)}", n % 2) for n in range(400)]
    labelled = spark.createDataFrame([(u, 1 - y) for _, u, y in rows[:200]], "url string, allowed int")
    pages = spark.createDataFrame([(n, u) for n, u, _ in rows[200:]], "page_id long, url string")
    got = {r.page_id: r.verdict for r in urls.judged(pages, URL_RULES, labelled).collect()}
    assert np.mean([got[n] == ("block" if y else "allow") for n, _, y in rows[200:]]) > 0.95
