"""Quality of whole texts by a sparse ensemble of rules over text statistics.

A random forest is grown on the statistics of a bounded sample of labelled rows.
The paths of its trees are rules, conjunctions of a few tests; a lasso logistic
regression weighs them and leaves most at zero; the others are compiled into one
Spark column expression, so scoring is a narrow projection of built-in functions.

Null and empty texts get a score as all others do.  Where labels of one kind only
are left to learn from, every score is the share of label 1, and 0.5 without any.
Repeated documents each get a row; of several labels of a document the mean counts.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigsift.llm.common import whole, words
from sigsift.llm.trees import Test, paths
from sigsift.session import pin

#: About how many labelled rows are learned from; scoring reads all rows whatever it is.
SAMPLE = 20_000
TREES = 20
DEPTH = 3
LASSO = 0.001
ACCEPTED = 0.7
SEED = 7
FEATURES = (
    "chars", "words", "word_length", "upper_share", "digit_share", "symbol_share", "mark_share",
    "distinct_words", "distinct_lines", "line_words", "letter_share", "longest_word",
)


def statistics(docs: DataFrame, text: str, keep: tuple[Column, ...]) -> DataFrame:
    """The ``keep`` columns and _f, the array of the statistics named in FEATURES."""
    frame = docs.select(*keep, whole(F.col(text)).alias("_text")).withColumn("_words", words(F.col("_text")))
    without = lambda pattern: F.length(F.regexp_replace("_text", pattern, ""))
    lines = F.split("_text", "\n", -1)
    frame = frame.select(
        *[F.col(c) for c in frame.columns if c not in ("_text", "_words")],
        F.length("_text").alias("_chars"), F.size("_words").alias("_count"), without(r"[\x20\x09-\x0D]+").alias("_solid"),
        without(r"[^\p{Lu}]+").alias("_upper"), without(r"[^0-9]+").alias("_digits"), without(r"[^\p{L}]+").alias("_letters"),
        without(r"[\p{L}\p{M}\p{N}\s.,;:!?'\"()-]+").alias("_symbols"), without(r"[^!?]+").alias("_marks"),
        F.size(F.array_distinct("_words")).alias("_distinct"), F.size(lines).alias("_lines"), F.size(F.array_distinct(lines)).alias("_distinct_lines"),
        F.coalesce(F.array_max(F.transform("_words", F.length)), F.lit(0)).alias("_longest"),
    )
    chars, count = F.greatest("_solid", F.lit(1)), F.greatest("_count", F.lit(1))
    values = (
        F.log1p("_chars"), F.log1p("_count"), F.col("_solid") / count, F.col("_upper") / chars, F.col("_digits") / chars, F.col("_symbols") / chars,
        F.col("_marks") / chars, F.col("_distinct") / count, F.col("_distinct_lines") / F.col("_lines"), F.col("_count") / F.col("_lines"),
        F.col("_letters") / chars, F.col("_longest"),
    )
    inner = {"_chars", "_count", "_solid", "_upper", "_digits", "_letters", "_symbols", "_marks", "_distinct", "_lines", "_distinct_lines", "_longest"}
    return frame.select(*[c for c in frame.columns if c not in inner], F.array(*[v.cast("double") for v in values]).alias("_f"))


@dataclass(frozen=True)
class Ensemble:
    """Weighted rules; the score is the logistic function of the intercept and the weights of the rules that hold."""

    intercept: float
    rules: tuple[tuple[float, tuple[Test, ...]], ...]

    def score(self, statistics: Column) -> Column:
        total = F.lit(self.intercept)
        for weight, rule in self.rules:
            total = total + F.when(_holds(rule, statistics), weight).otherwise(0.0)
        return 1 / (1 + F.exp(-total))


def _holds(rule: tuple[Test, ...], statistics: Column) -> Column:
    tests = [statistics[t.feature] > t.limit if t.above else statistics[t.feature] <= t.limit for t in rule]
    return reduce(lambda a, b: a & b, tests)


def held_out(key: Column) -> Column:
    """Rows whose labels are kept for measuring."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, text: str = "text", sample: int = SAMPLE) -> Ensemble:
    """Learn from the rows of ``labels`` (doc_id, quality) that are not held out.

    About ``sample`` of them, chosen by a hash of the id, are joined to their
    texts: their ids, at most a few hundred KB, are broadcast, so texts don't move.
    """
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy(F.col("doc_id").alias("_labelled")).agg(F.avg("quality").alias("_mean"))
    share = min(1.0, sample / max(1, known.count()))
    chosen = known.where(F.pmod(F.xxhash64("_labelled", F.lit(SEED)), F.lit(1 << 30)) < int(share * (1 << 30)))
    chosen = chosen.select("_labelled", (F.col("_mean") >= 0.5).cast("double").alias("_label"))
    joined = docs.select("doc_id", text).join(F.broadcast(chosen), F.col("doc_id") == F.col("_labelled"))
    rows = statistics(joined, text, (F.col("doc_id").alias("_id"), F.col("_label")))
    # the sample is small and is learned from in one order, so that reruns learn the same
    rows = pin(rows.repartition(1).sortWithinPartitions("_id", "_f"))
    kinds = {r["_label"]: r["count"] for r in rows.groupBy("_label").count().collect()}
    if len(kinds) < 2:
        ones, total = kinds.get(1.0, 0), sum(kinds.values())
        return Ensemble(50.0 if total and ones == total else -50.0 if total else 0.0, ())
    forest = RandomForestClassifier(labelCol="_label", featuresCol="_v", numTrees=TREES, maxDepth=DEPTH, featureSubsetStrategy="onethird", seed=SEED)
    grown = forest.fit(rows.select("_label", array_to_vector("_f").alias("_v")))
    rules = sorted(paths(grown.toDebugString))
    held = F.array(*[_holds(rule, F.col("_f")).cast("double") for rule in rules])
    lasso = LogisticRegression(labelCol="_label", featuresCol="_v", elasticNetParam=1.0, regParam=LASSO, maxIter=60)
    fitted = lasso.fit(pin(rows.select("_label", held.alias("_held"))).select("_label", array_to_vector("_held").alias("_v")))
    weighted = [(float(w), rule) for w, rule in zip(fitted.coefficients.toArray(), rules, strict=True) if w]
    return Ensemble(float(fitted.intercept), tuple(weighted))


def scored(docs: DataFrame, ensemble: Ensemble, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns as a struct _row, and _score from 0 to 1."""
    rows = statistics(docs, text, (F.struct(*keep).alias("_row"),))
    return rows.select("_row", ensemble.score(F.col("_f")).alias("_score"))
