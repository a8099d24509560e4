"""Lines that most pages of a site share: counted against the number of the site's pages, and left out.

A line counts once for each page that has it, and pages of one text count once, so
that copies of a page are not their own boilerplate.  A line on a single page is
never boilerplate, whatever the site's size.  Lines are compared without the
spaces around them, by a 64-bit hash; blank lines are never boilerplate.  What
moves to count them is hashes; texts move once, to meet the hashes of the lines
that go.

Pages without a site form a site of their own.  Null texts stay null and have no
lines; they count as one page.  A page all of whose lines go stays with an empty
text.  Repeated rows are copies of a page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RATIO = 0.05
LEAST_PAGES = 2


def _site(source: Column) -> Column:
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source.cast("string")))


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _hash(line: Column) -> Column:
    """The hash of a line; null for a blank one."""
    bare = F.trim(line)
    return F.when(bare != "", F.xxhash64(bare))


def boilerplate(pages: DataFrame, ratio: float = RATIO, least: int = LEAST_PAGES) -> DataFrame:
    """(_site, _line, _share) of the lines on more than ``ratio`` of a site's pages, and on ``least`` of them or more.

    ``pages`` has _site and _text.  A site has at most (lines per page) / ratio such lines.
    """
    hashed = pages.withColumn("_page", F.xxhash64("_text"))
    totals = hashed.groupBy("_site").agg(F.count_distinct("_page").alias("_pages"))
    counted = _seen(hashed, "_site", "_page").groupBy("_site", "_line").agg(F.count_distinct("_page").alias("_with")).where(F.col("_with") >= least)
    share = F.col("_with") / F.col("_pages")
    return counted.join(totals, "_site").select("_site", "_line", share.alias("_share")).where(F.col("_share") > ratio)


def _seen(pages: DataFrame, *keys: str) -> DataFrame:
    """One row for each page and distinct line."""
    hashes = F.array_distinct(F.filter(F.transform(_lines(F.col("_text")), _hash), lambda h: h.isNotNull()))
    return pages.select(*keys, F.explode(hashes).alias("_line"))


def without_boilerplate(
    docs: DataFrame, key: str = "doc_id", site: str = "source", text: str = "text", keep: tuple[str, ...] = (),
    ratio: float = RATIO, least: int = LEAST_PAGES,
) -> DataFrame:
    """The columns key, site and ``keep`` with n_lines, n_dropped and the text that is left."""
    pages = docs.select(F.col(key).alias("_id"), _site(F.col(site)).alias("_site"), F.col(text).alias("_text"), F.xxhash64(text).alias("_page"))
    common = boilerplate(pages, ratio, least)
    gone = (
        _seen(pages, "_id", "_site", "_page").join(common, ["_site", "_line"])
        .groupBy(F.col("_id").alias("_of"), F.col("_site").alias("_at"), F.col("_page").alias("_like")).agg(F.collect_set("_line").alias("_gone"))
    )
    rows = docs.select(
        F.col(key).alias("_id"), _site(F.col(site)).alias("_site"), F.xxhash64(text).alias("_page"), F.struct(key, site, text, *keep).alias("_row")
    )
    # the hash of the text is part of the key, so that rows without an id are spread
    joined = rows.join(gone, F.col("_id").eqNullSafe(F.col("_of")) & (F.col("_site") == F.col("_at")) & (F.col("_page") == F.col("_like")), "left")
    body = F.col(f"_row.{text}")
    parts = joined.select("_row", "_gone", _lines(body).alias("_parts"))
    left = F.filter("_parts", lambda x: ~F.coalesce(F.array_contains("_gone", _hash(x)), F.lit(False)))
    kept = parts.select("_row", F.coalesce(F.size("_parts"), F.lit(0)).alias("_n"), F.when(F.col("_gone").isNull(), F.col("_parts")).otherwise(left).alias("_left"))
    count = F.when(body.isNull(), 0).otherwise(F.col("_n"))
    return kept.select(
        *[F.col(f"_row.{c}").alias(c) for c in (key, site, *keep)], count.alias("n_lines"),
        F.when(body.isNull(), 0).otherwise(F.col("_n") - F.size("_left")).alias("n_dropped"), F.array_join("_left", "\n").alias(text),
    )


def cleaned(docs: DataFrame, ratio: float = RATIO, least: int = LEAST_PAGES) -> DataFrame:
    """The columns of documents, texts without their source's boilerplate lines and ``n_chars`` counted anew where lines went."""
    left = without_boilerplate(docs, keep=("lang", "n_chars"), ratio=ratio, least=least)
    chars = F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return left.select("doc_id", "text", "lang", "source", chars.alias("n_chars"))
