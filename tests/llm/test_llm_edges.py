"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns, for every operator and stage on documents."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sigsift.llm import fingerprints, jaccard, lines, mixing, packing, pii, quality

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
PLAIN = "Some plain words that make a text of more than five words number "
ROWS = (
    [(n, PLAIN + str(n), "en", f"s{n % 3}", 70) for n in range(8)]
    + [(20, None, None, None, None), (21, "", "en", "s1", 0), (22, " \n\t", "en", None, 3), (None, "no id here but words", "en", "s0", 20), (None, None, None, None, None)]
    + [(30, "long words " * 20_000, "en", "s0", 220_000), (31, "x" * 100_000, "en", "s1", 100_000)]
    + [(40, PLAIN + "copy", "en", "s2", 70)] * 3 + [(41, PLAIN + "copy", "de", "s2", 70)]
)
CLASH = ("score", "_text", "_id", "_key", "_row", "_node", "_size", "_f", "size", "piece", "position", "_line", "kind", "count")


@pytest.fixture(scope="module")
def docs(spark):
    frame = spark.createDataFrame(ROWS, SCHEMA)
    return frame.select("*", *[F.lit("clash").alias(c) for c in CLASH])


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    labels = [(n, n % 2, 0) for n in range(8)] + [(None, 1, 0), (40, None, None), (30, 1, 0), (30, 1, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def tokenizer():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


OPERATORS = {
    "pii": lambda d: pii.find(d),
    "fingerprints": lambda d: fingerprints.with_edits(d),
    "sketch": lambda d: fingerprints.sketch(d),
    "near duplicates": lambda d: jaccard.near_duplicates(d),
    "lines": lambda d: lines.without_boilerplate(d),
    "mixing": lambda d: mixing.allocate(d),
    "quality": lambda d: quality.scored(d, quality.Ensemble(0.0, ())),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_every_row_has_a_result(docs, name):
    assert OPERATORS[name](docs).count() == len(ROWS)


@pytest.mark.parametrize("name", [*OPERATORS, "packing"])
def test_empty_table(docs, name):
    run = OPERATORS.get(name) or (lambda d: packing.packed(d, tokenizer()))
    assert run(docs.where("false")).count() == 0


def test_packing_of_odd_rows(docs):
    rows = packing.packed(docs, tokenizer()).collect()
    assert sum(r.piece == 0 for r in rows) == len(ROWS)
    assert sum(r.length for r in rows if r.doc_id == 20) == 1 and sum(r.length for r in rows if r.doc_id == 21) == 1


def test_sizes_of_odd_rows(docs):
    rows = mixing.allocate(docs).collect()
    assert {r._size for r in rows if r._row.doc_id in (20, 21, 22)} == {0}
    assert all(0 <= r._taken <= 2 * r._size for r in rows)
    by = {r._source_size: r._target for r in rows}
    assert abs(sum(by.values()) - 1.5 * sum(r._size for r in rows)) < 1e-6
    assert {r._target for r in mixing.allocate(docs.where("doc_id IN (20, 21)")).collect()} == {0.0}


def test_lines_of_odd_rows(docs):
    rows = lines.without_boilerplate(docs.unionByName(docs)).collect()
    assert all(r.text is None and (r.n_lines, r.n_dropped) == (0, 0) for r in rows if r.doc_id == 20)
    assert all(r.text == PLAIN + "copy" for r in rows if r.doc_id == 40)  # copies of a page are not their own boilerplate
    assert all(r.text == " \n\t" and r.n_lines == 2 for r in rows if r.doc_id == 22)


def test_lines_of_small_sites(spark):
    footer = "All rights reserved"
    rows = [(n, f"page {n}\n{footer}", "four") for n in range(4)] + [(10, f"alone\n{footer}", "one"), (20, "twice\nthe same", "copies"), (21, "twice\nthe same", "copies")]
    rows += [(30, f"line {n} only\n{footer if n < 3 else ''}", None) for n in range(60)] + [(None, "no id\nshared", "none"), (None, "none either\nshared", "none")]
    got = lines.without_boilerplate(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    left = {(r.doc_id, r.text) for r in got}
    assert {(n, f"page {n}") for n in range(4)} <= left  # a footer of four pages goes
    assert {(10, f"alone\n{footer}"), (20, "twice\nthe same"), (21, "twice\nthe same")} <= left
    assert sum(r.text.endswith(footer) for r in got if r.doc_id == 30) == 3  # on a twentieth of sixty pages: not above the ratio
    assert {(None, "no id"), (None, "none either")} <= left and len(got) == len(rows)


@pytest.mark.parametrize("number", range(5))
def test_stage_on_odd_rows(spark, docs, folder, number):
    name, stage = corpus_pipeline.STAGES[number]
    out = stage(spark, docs, folder)
    assert number == 4 or out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    count = out.count()
    if name == "line dedup":
        assert count == len(ROWS)
    if name == "n-gram Jaccard join":
        kept = [r.doc_id for r in out.collect()]
        # the plain texts are alike, so the first stands for all
        assert kept.count(0) == 1 and not {*range(1, 8), 40, 41} & set(kept) and {20, 21, 22, 30, 31, None} <= set(kept)
    assert stage(spark, docs.where("false"), folder).count() == 0
