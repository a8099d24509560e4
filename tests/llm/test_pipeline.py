"""The pipeline's stages against plain versions, each on its own input."""

import collections
import re

import corpus_pipeline
from sigsift.llm import quality
from tests.llm.test_llm_corpus import components_of, sets_of, whole_sequences

SF = "/root/testdata/sf0.001"
WORD = re.compile("[^\x20\x09-\x0d]+")


def test_stages(spark):
    inputs, docs = [], spark.read.parquet(f"{SF}/documents.parquet")
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        inputs.append(docs.collect())
        docs = stage(spark, docs, SF)
        if number < 4:
            docs = spark.createDataFrame(docs.collect(), "doc_id long, text string, lang string, source string, n_chars long")
    raw, good, clean, single, mixed = inputs
    packed = docs.collect()

    ensemble = quality.learn(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    scores = {r._row.doc_id: r._score for r in quality.scored(spark.read.parquet(f"{SF}/documents.parquet"), ensemble).collect()}
    assert {r.doc_id for r in good} == {k for k, s in scores.items() if s >= 0.7} and 0 < len(good) < len(raw)

    texts_of = {(r.source, r.text) for r in good}  # pages of one text count once
    pages, with_line = collections.Counter(s for s, _ in texts_of), collections.Counter()
    for source, text in texts_of:
        with_line.update({(source, x.strip(" ")) for x in text.split("\n") if x.strip(" ")})
    def common(source, line):
        n = with_line[source, line.strip(" ")]
        return n >= 2 and n / pages[source] > 0.05
    want = {r.doc_id: "\n".join(x for x in r.text.split("\n") if not common(r.source, x)) for r in good}
    assert {r.doc_id: r.text for r in clean} == want and all(r.n_chars == len(r.text) for r in clean)

    sets = sets_of({r.doc_id: r.text for r in clean}, 5)
    first = components_of(sets, 80)
    assert sorted(r.doc_id for r in single) == sorted(k for k in sets if first[k] == k)

    texts = {r.doc_id: r.text for r in single}
    taken = collections.Counter()
    for r in mixed:
        assert texts[r.doc_id].startswith(r.text)
        taken[r.source] += len(WORD.findall(r.text))
    sizes = collections.Counter()
    for r in single:
        sizes[r.source] += len(WORD.findall(r.text))
    assert abs(sum(taken.values()) - 1.5 * sum(sizes.values())) <= len(sizes) and all(taken[s] <= 2 * sizes[s] for s in sizes)

    assert sum(r.piece == 0 for r in packed) == len(mixed)
    assert whole_sequences(packed) <= 1.02 * sum(r.length for r in packed) / 1024 + 1


def test_run(spark):
    rows = corpus_pipeline.run(spark, SF).collect()
    assert len(rows) > 50 and whole_sequences(rows)
