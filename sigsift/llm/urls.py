"""Judging URLs: rules of host and path where they fit, gradient-boosted trees on lexical features elsewhere.

The trees learn from URLs with labels, (url, allowed); in the registered query
these are the URLs that a rule judges.  The features are built-in functions of
the URL's characters, and the label statistics of its host's suffix.

Null URLs and such without ``://`` have an empty host and path and fit no rule;
the trees judge them as any other.  Repeated rows each get their own.  Without
labels of both kinds every URL gets the commoner label, and ``allow`` without any.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigsift.llm.common import lower_ascii, whole
from sigsift.session import pin

#: About how many labelled URLs are learned from; all URLs are judged whatever it is.
SAMPLE = 20_000
TREES = 12
DEPTH = 4
SEED = 7
#: Labelled URLs of a suffix count as much as this many of the average.
PRIOR = 20.0


@dataclass(frozen=True)
class Rule:
    """Fits a host and all its subdomains, where the path starts with the rule's."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def split_url(url: Column) -> tuple[Column, Column]:
    """Host, A-Z in lower case, and path of a URL; both empty where there is no ``://``."""
    at = F.locate("://", whole(url).substr(F.lit(1), F.length(whole(url))))
    rest = F.when(at > 0, F.substring(whole(url), at + 3, F.length(whole(url)))).otherwise(F.lit(""))
    return lower_ascii(F.regexp_extract(rest, "(?s)^([^/?#]*+)", 1)), F.regexp_extract(rest, "(?s)^[^/?#]*+([^?#]*+)", 1)


def fitting(host: Column, path: Column, rules: tuple[Rule, ...]) -> Column:
    """(rule, verdict) of the longest rule that fits, or null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        out = F.when(fits, F.struct(F.lit(rule.name).alias("rule"), F.lit(rule.verdict).alias("verdict"))).otherwise(out)
    return out


def lexical(frame: DataFrame, url: str, host: str, path: str) -> DataFrame:
    """Adds _f, the lexical features, and _suffix, the last label of the host."""
    without = lambda c, pattern: F.length(F.regexp_replace(c, pattern, ""))
    size = F.greatest(F.length(url), F.lit(1))
    frame = frame.withColumn("_chars", F.split(F.col(url), "")).withColumn("_kinds", F.array_distinct(F.filter("_chars", lambda c: c != "")))
    def share(c):
        p = (F.length(url) - F.length(F.replace(F.col(url), c, F.lit("")))) / size
        return -p * F.log2(p)
    entropy = F.aggregate(F.transform("_kinds", share), F.lit(0.0), lambda a, x: a + x)
    query = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)
    labels = F.split(host, r"\.")
    values = (
        F.length(url), F.length(host), F.length(path), without(path, "[^/]+"), F.size(labels), without(url, "[^0-9]+") / size,
        without(host, "[^0-9]+"), without(host, "[^-]+"), without(url, "[A-Za-z0-9]+") / size, entropy,
        F.when(query != "", 1 + without(query, "[^&]+")).otherwise(0), F.length(query), F.contains(url, F.lit("#")).cast("int"),
        F.startswith(url, F.lit("https")).cast("int"), F.length(F.element_at(labels, -1)), F.array_max(F.transform(labels, F.length)),
    )
    suffix = F.regexp_extract(host, "([^.]*)$", 1)
    return frame.withColumn("_f", F.array(*[F.coalesce(v.cast("double"), F.lit(0.0)) for v in values])).withColumn("_suffix", suffix).drop("_chars", "_kinds")


def _sampled(frame: DataFrame, sample: int) -> DataFrame:
    share = min(1.0, sample / max(1, frame.count()))
    return frame.where(F.pmod(F.xxhash64("_url", "_id", F.lit(SEED)), F.lit(1 << 30)) < int(share * (1 << 30)))


def judged(pages: DataFrame, rules: tuple[Rule, ...], labelled: DataFrame | None = None, key: str = "page_id", url: str = "url", sample: int = SAMPLE) -> DataFrame:
    """(key, host, path, rule, verdict, score): the rule's verdict, else that of the trees; score is the trees' share for ``allow``.

    ``labelled`` has url and allowed (0 or 1); where it is not given, the URLs that a rule judges are the labelled ones.
    """
    host, path = split_url(F.col("_url"))
    def prepared(frame):
        frame = frame.withColumn("_host", host).withColumn("_path", path)
        return frame.withColumn("_fit", fitting(F.col("_host"), F.col("_path"), rules))
    rows = prepared(pages.select(F.col(key).alias("_id"), whole(F.col(url)).alias("_url")))
    if labelled is None:
        known = rows.where("_fit IS NOT NULL").withColumn("_label", (F.col("_fit.verdict") == "allow").cast("double"))
    else:
        known = prepared(labelled.where("allowed IS NOT NULL").select(F.lit(0).alias("_id"), whole(F.col("url")).alias("_url"), F.col("allowed").cast("double").alias("_label")))
    # the sample is bounded and learned from in one order, so that reruns learn the same
    chosen = lexical(_sampled(known, sample), "_url", "_host", "_path").select("_url", "_f", "_suffix", "_label")
    train = pin(chosen.repartition(1).sortWithinPartitions("_url", "_label"))
    mean, kinds = train.agg(F.avg("_label"), F.countDistinct("_label")).first()
    described = lexical(rows, "_url", "_host", "_path")
    if kinds < 2:
        scored = described.withColumn("_score", F.lit(1.0 if mean is None else float(mean)))
    else:
        stats = pin(train.groupBy("_suffix").agg(
            ((F.sum("_label") + PRIOR * mean) / (F.count(F.lit(1)) + PRIOR)).alias("_rate"), F.log1p(F.count(F.lit(1))).alias("_seen")
        ))
        def with_stats(frame):
            known_rate = F.array(F.coalesce("_rate", F.lit(float(mean))), F.coalesce("_seen", F.lit(0.0)))
            return frame.join(stats, "_suffix", "left").withColumn("_v", array_to_vector(F.concat("_f", known_rate)))
        boosted = GBTClassifier(labelCol="_label", featuresCol="_v", maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=SEED)
        model = boosted.fit(with_stats(train).select("_label", "_v"))
        scored = model.transform(with_stats(described)).withColumn("_score", vector_to_array("probability")[1])
    learned = F.when(F.col("_score") >= 0.5, F.lit("allow")).otherwise(F.lit("block"))
    return scored.select(
        F.col("_id").alias(key), F.col("_host").alias("host"), F.col("_path").alias("path"), F.col("_fit.rule").alias("rule"),
        F.coalesce("_fit.verdict", learned).alias("verdict"), F.col("_score").alias("score"),
    )
