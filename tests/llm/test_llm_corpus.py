"""Quality, near duplicates, lines, mixing, quotations and packing against SQL and plain versions."""

import collections
import re
import time
import zlib
from pathlib import Path

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sigsift.llm import jaccard, packing, quality, quotes, tokens
from sigsift.llm.queries import ORACLE_SQL, QUERIES, TOKENIZER
from sigsift.llm.trees import Test as Split
from sigsift.llm.trees import paths
from sigsift.session import Scratch

SF = "/root/testdata/sf0.001"
WORD = re.compile("[^\x20\x09-\x0d]+")


def compared(frame, result):
    names = [d[0] for d in result.description]
    assert sorted(frame.columns) == sorted(names)
    order = sorted(names)
    got = sorted((tuple(r[c] for c in order) for r in frame.collect()), key=str)
    want = sorted((tuple(r[names.index(c)] for c in order) for r in result.fetchall()), key=str)
    assert got == want and got


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_agrees_with_sql(spark, name):
    duck = duckdb.connect()
    for table in ("documents", "conversations", "embeddings"):
        duck.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    compared(QUERIES[name](spark, SF), duck.execute(ORACLE_SQL[name]))


def test_quality_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = QUERIES["op3_quality"](spark, sf).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
    held = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    assert len(held) > 50 and np.mean([p == q for p, q in held]) >= 0.95


def test_quality_without_labels_of_both_kinds(spark):
    docs = spark.createDataFrame([(n, "some words here") for n in range(9)] + [(20, None)], "doc_id long, text string")
    for value, score in ((1, 1.0), (0, 0.0)):
        labels = spark.createDataFrame([(n, value) for n in range(9)], "doc_id long, quality int")
        got = quality.scored(docs, quality.learn(docs, labels)).collect()
        assert len(got) == 10 and all(abs(r._score - score) < 1e-9 for r in got)
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r._score for r in quality.scored(docs, quality.learn(docs, none)).collect()} == {0.5}


def test_paths_of_trees():
    text = "Model\n  Tree 0 (weight 1.0):\n    If (feature 1 <= 0.5)\n     If (feature 1 <= 0.25)\n      Predict: 0.0\n     Else (feature 1 > 0.25)\n      Predict: 1.0\n    Else (feature 1 > 0.5)\n     Predict: 1.0\n"
    assert paths(text) == {
        (Split(1, False, 0.5),), (Split(1, False, 0.25),), (Split(1, False, 0.5), Split(1, True, 0.25)), (Split(1, True, 0.5),),
    }


def sets_of(texts, size):
    out = {}
    for key, text in texts.items():
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        out[key] = {tuple(w[n : n + size]) for n in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()
    return out


def components_of(sets, percent):
    first = {k: k for k in sets}
    def root(x):
        while first[x] != x:
            x = first[x]
        return x
    keys = sorted(sets)
    for n, a in enumerate(keys):
        for b in keys[n + 1 :]:
            if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                first[y] = x
    return {k: root(k) for k in keys}


def test_components_of_the_query(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    sets = sets_of(texts, 3)
    want = components_of(sets, 90)
    got = QUERIES["op5_ngram_jaccard"](spark, SF).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == {k: (len(sets[k]), want[k]) for k in sets}


def test_components_of_chains_and_copies(spark):
    base = [f"w{n}" for n in range(60)]
    texts = {n: " ".join(base[n : n + 50]) for n in range(11)}  # neighbours are similar, the ends are not
    texts |= {100 + n: " ".join(base[:30] + [f"x{n}"] + base[31:50]) for n in range(40)}
    texts |= {200 + n: "Same text here" for n in range(30)} | {300: "", 301: None, 302: " \t", 303: "one", 304: "ONE", 305: "Éne", 306: "éne"}
    sets = sets_of(texts, 3)
    docs = spark.createDataFrame([(k, t, 1) for k, t in texts.items()], "doc_id long, text string, _node int")
    for similarity in (0.8, 0.9):
        want = components_of(sets, round(100 * similarity))
        got = jaccard.near_duplicates(docs.unionByName(docs.where("doc_id < 5")), size=3, similarity=similarity).collect()
        assert len(got) == len(texts) + 5
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == {k: (len(sets[k]), want[k]) for k in sets}


@settings(max_examples=300, deadline=None)
@given(st.integers(1, 3000), st.floats(0, 1), st.sampled_from([800, 900]), st.integers(0, 2**32))
def test_similar_sets_share_a_key(size, cut, tenths, seed):
    rng = np.random.default_rng(seed)
    pool = np.unique(rng.integers(0, 2**63, 2 * size + 9, dtype=np.uint64))
    least = -(-tenths * size // 1000)
    # sets of a and b with c in common, as far apart as a link allows
    a = pool[:size]
    lost = int(cut * (size - least))
    common = size - lost
    added = max(0, common * 1000 // tenths - size)
    b = np.sort(np.concatenate([a[: size - lost], pool[size : size + added]]))
    if not len(b) or 1000 * common < tenths * (size + len(b) - common) or np.array_equal(a, b):
        return  # equal sets are one node and need no key
    # whatever the order of all words, one that both sets keep is shared
    def kept(value):
        return {w for words, n in jaccard._keys(value, tenths) for w in words[np.argsort(jaccard._mixed(words ^ np.uint64(seed)))][:n].tolist()}

    assert kept(a) & kept(b)
    checks = jaccard._check(a) ^ jaccard._check(b)
    folded = np.bitwise_xor.reduce(checks.reshape(-1, len(jaccard.AT_ONCE)))
    assert int(np.bitwise_count(folded).sum()) <= int(np.bitwise_count(checks).sum()) <= size + len(b) - 2 * common


@pytest.mark.parametrize(("tenths", "least"), [(900, 9), (800, 4)])
def test_sets_that_only_link_when_equal_have_no_keys(tenths, least):
    pool = np.random.default_rng(1).integers(0, 2**63, 40, dtype=np.uint64)
    assert [len(jaccard._keys(pool[:n], tenths)) > 0 for n in range(1, 20)] == [n >= least for n in range(1, 20)]


@pytest.mark.parametrize("count", [1000, 2000])
def test_pairs_of_near_copies(spark, monkeypatch, count):
    rng = np.random.default_rng(count)
    rows = []
    for n in range(count):
        text = [f"w{i}" for i in range(200)]
        for at in rng.integers(0, 200, rng.integers(1, 5)):
            text[at] = f"x{rng.integers(10**9)}"
        rows.append((n, " ".join(text)))
    pairs = []
    verified = jaccard._verified

    def counted(frame, *rest):
        frame = frame.cache()
        pairs.append(frame.count())
        return verified(frame, *rest)

    monkeypatch.setattr(jaccard, "_verified", counted)
    got = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(8), size=3, similarity=0.9).collect()
    sets = sets_of(dict(rows), 3)
    least = components_of(dict(list(sets.items())[:60]), 90)
    by = {r.doc_id: r.component_id for r in got}
    assert len({by[n] for n in range(60)}) <= len(set(least.values()))
    assert max(pairs) <= count and sum(pairs) <= 2 * count, pairs


def test_words_and_pairs_in_shares(spark, monkeypatch):
    """Groups whose words and pairs take many turns come out as in one; a turn reads as many hashes as it may."""
    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{n}x{i if i not in at else 'y' + str(k)}" for i in range(80)) for n in range(3) for k, at in enumerate(rng.integers(0, 80, (5, 2)))]
    monkeypatch.setattr(jaccard, "SHARE_ROWS", 400)
    shares, turns = [], []
    settled, verified, grouped = jaccard._settled, jaccard._verified, jaccard.groups_of

    def share(*args):
        shares.append(args[0].count())
        return settled(*args)

    def turn(frame, *rest):
        turns.append(frame.count())
        return verified(frame, *rest)

    monkeypatch.setattr(jaccard, "_settled", share)
    monkeypatch.setattr(jaccard, "_verified", turn)
    monkeypatch.setattr(jaccard, "groups_of", lambda rows, size: grouped(rows, min(size, 700)))
    got = jaccard.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), size=3, similarity=0.7).collect()
    sets = sets_of(dict(enumerate(texts)), 3)
    assert {r.doc_id: r.component_id for r in got} == components_of(sets, 70)
    assert len(shares) > 1 and max(shares) < sum(shares)
    assert 0 < max(turns) < sum(turns)


def test_sets_are_not_shuffled_to_be_verified(spark, monkeypatch):
    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{n}x{i if i != at else 'y'}" for i in range(60)) for n in range(20) for at in rng.integers(0, 60, 4)]
    plans = []
    verified = jaccard._verified

    def explained(*args):
        out = verified(*args)
        plans.append(out._jdf.queryExecution().executedPlan().toString())
        return out

    monkeypatch.setattr(jaccard, "_verified", explained)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = jaccard.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), size=3, similarity=0.8).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    sets = sets_of(dict(enumerate(texts)), 3)
    assert {r.doc_id: r.component_id for r in got} == components_of(sets, 80)
    for plan in plans:
        lines = plan.splitlines()
        scans = [n for n, line in enumerate(lines) if "FileScan" in line and "_hashes" in line]
        assert len(scans) == 2 and all("Bucketed: true" in lines[n] for n in scans)
        for n in scans:  # from the table up to the join
            up = next(m for m in range(n, 0, -1) if "Sort [_p" in lines[m])
            assert not any("Exchange" in line for line in lines[up:n])
    assert plans and not [t for t in spark.catalog.listTables() if t.name.startswith("sigsift_")]


def test_shuffle_files_of_an_iteration_go(spark):
    folders = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()

    def files():
        return {p for folder in folders for p in Path(folder).rglob("shuffle_*.data")}

    before = files()
    scratch = Scratch(spark)
    out = scratch.pin("sums", spark.range(100_000).groupBy((F.col("id") % 1000).alias("k")).agg(F.sum("id").alias("n")))
    end = time.time() + 20
    while files() - before and time.time() < end:
        time.sleep(0.2)
    assert not files() - before
    assert out.count() == 1000
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
    scratch.drop("sums")


TRICKY = [
    "", " ", "  ", "a", " a", "a ", "a  b", "a   b  ", "\n", "a\nb", "a \nb", "a\n b", "a\n\n b", "it's we'LL don't", "x\u00a0y \u00a0z", "\u3000a b", "é😀 ü\x85b",
    "1234 56,7.8 -- !!", "a\tb\t c", "\x1c \x1d a!\x1c b", "tail\n ", "<|endoftext|> in text<|endoftext|>", "\u2028a \u2028 b", "日本 語 テスト", "a" * 3000, "word " * 2000,
]


def test_ids_equal_the_library(spark):
    import public_tokenizers
    import pyarrow as pa
    from tokenizers import Tokenizer

    path = public_tokenizers.path(TOKENIZER)
    library, own = Tokenizer.from_file(path), tokens.Encoder(Path(path).read_bytes())
    texts = TRICKY + [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert own.plain.__name__ == "encode_ordinary"
    for text, ids in zip(texts, own.batch(pa.array([*texts, None])), strict=False):
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids, text


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="ab1'é \n\t\u00a0\u2003!😀", max_size=40), max_size=8))
def test_ids_of_odd_texts(texts):
    import public_tokenizers
    import pyarrow as pa
    from tokenizers import Tokenizer

    path = public_tokenizers.path(TOKENIZER)
    if "library" not in test_ids_of_odd_texts.__dict__:
        test_ids_of_odd_texts.library = Tokenizer.from_file(path)
    got = tokens.encoder(Path(path).read_bytes()).batch(pa.array(texts, pa.string()))
    assert [g.tolist() for g in got] == [test_ids_of_odd_texts.library.encode(t, add_special_tokens=False).ids for t in texts]


def whole_sequences(rows, capacity=1024):
    by = collections.defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_packing_query(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path(TOKENIZER))
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = QUERIES["op10_packing"](spark, SF).collect()
    by = collections.defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
    assert by.keys() == texts.keys()
    for key, text in texts.items():
        ids = np.array([*library.encode(text, add_special_tokens=False).ids, 2], "<u4")
        pieces = sorted(by[key], key=lambda r: r.piece)
        assert [r.piece for r in pieces] == list(range(-(-len(ids) // 1024))) and all(r.length == 1024 for r in pieces[1:])
        assert [r.start for r in pieces] == [0, *np.cumsum([r.length for r in pieces])[:-1]]
        assert [r.ids_crc32 for r in pieces] == [zlib.crc32(ids[r.start : r.start + r.length].tobytes()) for r in pieces]
    assert whole_sequences(rows) <= 1.02 * sum(r.length for r in rows) / 1024 + 1


@pytest.mark.parametrize("lengths", [[600] * 500, [1], [], [1024] * 5, [1, 1023] * 300, list(range(1, 1025))])
def test_rounds_of_packing(spark, lengths):
    items = spark.createDataFrame(list(enumerate(lengths)), "_uid long, length long")
    rows = packing.pack(items, group=40).join(items, "_uid").collect()
    assert len(rows) == len(lengths)
    count, least = whole_sequences(rows), -(-sum(lengths) // 1024)
    assert count == len(lengths) if 600 in lengths[:1] else count <= 1.1 * least + 1


@pytest.mark.parametrize("stored", [False, True])
def test_sequences_follow_the_documents(spark, stored, tmp_path):
    import public_tokenizers

    sizes = np.random.default_rng(6).integers(1, 700, 600).tolist()
    docs = spark.createDataFrame([(n, "word " * x) for n, x in enumerate(sizes)], "doc_id long, text string").coalesce(1)
    if stored:  # files of unequal size, which Spark reads largest first
        spread = docs.withColumn("_at", F.col("doc_id")).repartitionByRange(3, F.pow("doc_id", F.lit(3))).sortWithinPartitions("_at")
        spread.drop("_at").write.parquet(str(tmp_path / "docs"))
        docs = spark.read.parquet(str(tmp_path / "docs"))
    rows = packing.packed(docs, public_tokenizers.path(TOKENIZER), ordered=True, group=60).collect()
    assert len(rows) >= 600 and whole_sequences(rows) <= 1.05 * sum(r.length for r in rows) / 1024 + 1
    by = collections.defaultdict(list)
    for r in rows:
        by[r.sequence_id].append(r.doc_id)
    spans = [max(v) - min(v) for v in by.values()]
    assert np.mean(np.array(spans) < 60) > 0.8
    firsts = [min(by[s]) for s in sorted(by)]
    assert firsts == sorted(firsts)


def test_kept_ids(spark):
    import public_tokenizers

    docs = spark.createDataFrame([("k", "word " * 3000), (None, None)], "name string, body string")
    rows = packing.packed(docs, public_tokenizers.path(TOKENIZER), "name", "body", keep_ids=True).collect()
    assert all(len(r.ids) == r.length and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in rows)
    assert sum(r.length for r in rows if r.name is None) == 1


CHAT = [
    (1, 0, "user", "Hello there\nHow are you?"), (1, 1, "assistant", "On Monday user wrote:\n> Hello there\n> How are you?\nFine, thanks."),
    (1, 2, "user", "> > Hello there\n>> How are you?\n> Fine,   thanks.\nGood.\n\nAnother thing"), (1, 3, "assistant", "> another THING\n\nyes"),
    (1, 4, "user", "> never said\nno"), (1, 5, "user", "> later words\nx"), (1, 6, "user", "later words"), (2, 0, "user", None), (2, 1, None, ""), (2, 1, None, ""),
    (2, 2, "user", "  > How are you?\r\nkeep  this > mark\n"), (None, None, None, "> x"), (None, 3, "a", "x"), (1, 2, "user", "> > Hello there\n>> How are you?\n> Fine,   thanks.\nGood.\n\nAnother thing"),
]


def test_quotations(spark):
    talk = spark.createDataFrame(CHAT, "conv_id long, turn long, role string, text string")
    rows = {(r.conv_id, r.turn): r for r in quotes.threaded(talk.withColumn("position", F.lit(0)).withColumn("_lines", F.lit(0))).collect()}
    assert (rows[1, 1].text, rows[1, 1].reply_to, rows[1, 1].n_quoted) == ("Fine, thanks.", 0, 2)
    assert (rows[1, 2].text, rows[1, 2].reply_to, rows[1, 2].n_linked) == ("Good.\n\nAnother thing", 1, 2)
    assert (rows[1, 3].reply_to, rows[1, 4].reply_to, rows[1, 5].reply_to) == (2, None, None)
    assert [rows[1, n].position for n in range(7)] == [1, 2, 3, 4, 5, 6, 7]
    duck = duckdb.connect()
    duck.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    duck.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", CHAT)
    compared(quotes.threaded(talk), duck.execute(ORACLE_SQL["op9_quotes"]))
    assert quotes.threaded(talk.where("false")).count() == 0


LETTER = "One fine day we met.\nIt was a Monday in May.\nThe sun was shining.\nNobody had time to talk.\n\nSecond part is here.\n\nThird part is there."


@pytest.mark.parametrize("quotation, origin", [
    ("> It was a Monday in May.\n> The sun was shining.", 1),  # two lines of a paragraph
    ("> Second part is here.\n>\n> Third part is there.", 1),  # two of three paragraphs
    ("> One fine day we\n> met. It was a Monday in\n> May. Nobody had time to\n> talk.", 1),  # rewrapped, a line left out
    ("> Thanks.\n> The sun was shining.\n> Second part is here.", 1),  # most of it, though a line is from elsewhere
    ("> Thanks.\n> words that nobody\n> in this talk has ever said", None),
])
def test_trimmed_quotations(spark, quotation, origin):
    chat = [(1, 0, "user", "Thanks."), (1, 1, "user", LETTER), (1, 2, "user", "Thanks.\nThe end."), (1, 3, "user", quotation + "\nYes.")]
    rows = {r.turn: r for r in quotes.threaded(spark.createDataFrame(chat, "conv_id long, turn long, role string, text string")).collect()}
    assert (rows[3].reply_to, rows[3].n_linked, rows[3].text) == (origin, int(origin is not None), "Yes.")
