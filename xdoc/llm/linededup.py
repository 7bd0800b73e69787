"""Line dedup by distinct-site spread.

A HyperLogLog sketch of the sites of each line hash, merged by aggregation,
tells on how many sites a line stands. Lines whose estimate is far above the
threshold are boilerplate, lines far below are not, and lines near it get an
exact distinct count. (Sketches of few sites list a 26-bit coupon for each, so an
estimate of half of ten or less for a line on ten sites would take five pairs of
sites with equal coupons; one of over twice ten for a line on nine would be eight
standard errors off.) A boilerplate line goes from every document but the first
(smallest id) that has it, so one copy of every line stays in the corpus.

A line is what stands between ``\n``; it is compared without surrounding
whitespace and counts only with ``min_words`` words.

Defined results: a null text stays null and has no lines; an empty text has
none that count; a null site is no site; a line that stands twice in its first
document stays there twice; rows of one id are one document as to which is first,
but each row loses its own lines only, whatever the texts of the others; a null
id comes after all others, so such rows lose a line unless no row with an id has
it; an empty table gives an empty table; extra columns, whatever their names, are
kept by ``remove_boilerplate``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, materialize

#: A line is boilerplate from so many distinct sites, and is looked at from so many words.
MIN_SITES, MIN_WORDS = 10, 3
#: log2 of a sketch's registers, and how far from the threshold an estimate is trusted.
LOG_K, TRUST = 6, 2.0


def _trimmed(line: Column) -> Column:
    return F.btrim(line, F.lit(" \t\n\x0b\x0c\r"))


def _row_key(doc_id: Column, text: Column) -> list[Column]:
    """What tells a row's lines: its id and two hashes of its whole text. Rows that agree in all are edited alike."""
    return [doc_id.cast("long"), F.xxhash64(text), F.xxhash64(F.lit(3), text)]


def lines_of(docs: DataFrame, doc_id: str, text: str, site: str, min_words: int) -> DataFrame:
    """A row per line that counts: two independent 64-bit hashes, the row's key, site, position."""
    body = F.col(text).cast("string")
    key = [c.alias(n) for c, n in zip(_row_key(F.col(doc_id), body), ("__doc", "__t1", "__t2"), strict=True)]
    lines = docs.select(*key, F.col(site).cast("string").alias("__site"), F.posexplode(F.split(body, "\n")).alias("__pos", "__raw"))
    lines = lines.withColumn("__line", _trimmed(F.col("__raw"))).drop("__raw")
    enough = F.col("__line").rlike(r"^[^\x20\x09-\x0D]+([\x20\x09-\x0D]+[^\x20\x09-\x0D]+){%d}" % (min_words - 1))
    return lines.where(enough).select(F.xxhash64("__line").alias("__h1"), F.xxhash64(F.lit(7), "__line").alias("__h2"), "__doc", "__t1", "__t2", "__site", "__pos")


def boilerplate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", site: str = "source", min_sites: int = MIN_SITES, min_words: int = MIN_WORDS) -> DataFrame:
    """Hashes of the lines on ``min_sites`` sites or more, with the smallest document that has them."""
    lines = lines_of(docs, doc_id, text, site, min_words)
    spread = lines.groupBy("__h1", "__h2").agg(F.hll_sketch_agg("__site", F.lit(LOG_K)).alias("__sketch"), F.min("__doc").alias("__first"), F.count(F.lit(1)).alias("__n"))
    # a line with fewer occurrences than min_sites can't stand on so many sites
    spread = spread.where(F.col("__n") >= min_sites).select("__h1", "__h2", "__first", F.hll_sketch_estimate("__sketch").alias("__sites"))
    spread = materialize(spread.where(F.col("__sites") * TRUST >= min_sites), "spread")
    near = spread.where(F.col("__sites") <= min_sites * TRUST)
    sure = spread.where(F.col("__sites") > min_sites * TRUST).select("__h1", "__h2", "__first")
    # distinct pairs first, which combines on the map side: a line that stands everywhere is as many rows as it has sites
    pairs = lines.where(F.col("__site").isNotNull()).select("__h1", "__h2", "__site").distinct().join(near.select("__h1", "__h2"), ["__h1", "__h2"], "left_semi")
    exact = pairs.groupBy("__h1", "__h2").agg(F.count(F.lit(1)).alias("__sites")).where(F.col("__sites") >= min_sites)
    return sure.union(near.join(exact.select("__h1", "__h2"), ["__h1", "__h2"]).select("__h1", "__h2", "__first"))


def removals(docs: DataFrame, found: DataFrame, doc_id: str, text: str, site: str, min_words: int) -> DataFrame:
    """Positions of the lines to remove, per row key."""
    lines = lines_of(docs, doc_id, text, site, min_words).drop("__site")
    hit = lines.join(found, ["__h1", "__h2"]).where(~F.col("__doc").eqNullSafe(F.col("__first")))
    return hit.groupBy("__doc", "__t1", "__t2").agg(F.collect_set("__pos").alias("__gone"))


def _edited(docs: DataFrame, doc_id: str, text: str, site: str, min_sites: int, min_words: int) -> tuple[DataFrame, Column, Column, Column]:
    """``docs`` with its removals; the text without them, its lines, and how many go."""
    found = boilerplate(docs, doc_id, text, site, min_sites, min_words)
    body = F.col(f"`{text}`").cast("string")
    names = [fresh(docs, x) for x in ("__owner", "__of1", "__of2", "__gone")]
    gone = removals(docs, found, doc_id, text, site, min_words).toDF(*names)
    owner, t1, t2, name = names
    key = _row_key(F.col(f"`{doc_id}`"), body)
    joined = docs.join(gone, key[0].eqNullSafe(F.col(owner)) & (key[1] == F.col(t1)) & (key[2] == F.col(t2)), "left")
    lines = F.split(body, "\n")
    kept = F.filter(lines, lambda _, k: ~F.array_contains(name, k))
    return joined, F.when(F.col(name).isNull(), body).otherwise(F.array_join(kept, "\n")), lines, F.size(name)


def remove_boilerplate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", site: str = "source", min_sites: int = MIN_SITES, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with its columns as they were, but for the text without boilerplate lines. No row goes."""
    joined, edited, _, _ = _edited(docs, doc_id, text, site, min_sites, min_words)
    return joined.select(*[(edited.alias(c) if c == text else F.col(f"`{c}`")) for c in docs.columns])


def line_report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", site: str = "source", min_sites: int = MIN_SITES, min_words: int = MIN_WORDS) -> DataFrame:
    """Per document: lines, removed lines, remaining text's length and hash."""
    joined, edited, lines, gone = _edited(docs, doc_id, text, site, min_sites, min_words)
    kept = F.coalesce(edited, F.lit(""))
    return joined.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.coalesce(F.size(lines), F.lit(0)).cast("long").alias("n_lines"), F.coalesce(gone, F.lit(0)).cast("long").alias("n_removed"), F.length(kept).cast("long").alias("kept_chars"), F.sha2(kept.cast("binary"), 256).alias("kept_sha256"))
