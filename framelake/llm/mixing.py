"""Mixing sources to target weights, with DataFrame functions only.

Every source has a budget of words. As many whole epochs of the source as fit come first;
the rest is drawn without replacement by Efraimidis-Spirakis keys: each document draws an
exponential whose rate is its quality weight, and the smallest keys win until the budget
is spent. The order of keys within a source is never sorted in one task: keys fall into
buckets by a rising function, bucket totals give each bucket's start by a prefix sum, and
only the documents of a bucket are sorted among themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelake.llm.shared import written

#: Buckets of a source at least, and rows of the table for each; so a bucket is one task's sort, whatever the table.
BUCKETS, BUCKET_ROWS = 1024, 10_000
RESULTS = ("size", "source_size", "target", "taken", "epochs")
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: str | Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def quality_weight(text: str | Column) -> Column:
    """From 0.05 to 1: the share of characters that are neither digits nor ASCII punctuation."""
    text = F.col(text) if isinstance(text, str) else text
    kept = F.length(F.regexp_replace(text, r"[!-@\[-`{-~]", ""))
    share = kept.cast("double") / F.length(text)
    return F.lit(0.05) + F.lit(0.95) * F.when(F.length(text) > 0, share).otherwise(F.lit(0.0))


def uniform(id_col: str | Column, seed: int) -> Column:
    """A number in (0, 1) drawn from the id and the seed, alike in each run."""
    id_col = F.col(id_col) if isinstance(id_col, str) else id_col
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit("")))
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """From one row per source (skey, source, source_size): its target in words.

    Sources in code-point order, null last, weigh ``weights`` in turn and share the sum of
    all sizes. A target stops at ``most`` times its size, the rest is shared by weight among
    the others, and so on: those with the least size per weight stop first, so one pass in that
    order finds the level at which the others stand. One row per source is one task's work.
    """
    weigh = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights) + 1).cast("int"))
    everything = Window.partitionBy()
    rising = Window.orderBy("fill", "skey")
    before = rising.rowsBetween(Window.unboundedPreceding, -1)
    df = sizes.withColumn("w", weigh.cast("double")).withColumn("cap", most * F.col("source_size").cast("double"))
    df = df.withColumn("fill", F.col("cap") / F.col("w"))
    spent = F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    left = F.sum("w").over(rising.rowsBetween(0, Window.unboundedFollowing))
    level = (F.sum(F.col("source_size").cast("double")).over(everything) - spent) / left
    df = df.withColumn("place", F.row_number().over(rising)).withColumn("level", level)
    first = F.min(F.when(F.col("fill") >= F.col("level"), F.struct("place", "level"))).over(everything)
    df = df.withColumn("stand", first["level"])
    return df.select("skey", "source_size", F.least("cap", F.coalesce(F.col("w") * F.col("stand"), F.col("cap"))).alias("target"))


def mix_sources(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", keep: tuple[str, ...] = (), seed: int = 17,
    weights: tuple[int, ...] = (1, 2, 3), most: int = 3, quality: Column | None = None, size: Column | None = None,
) -> DataFrame:
    """One row per row of ``docs``: id, source, the columns ``keep``, size, source_size, target,
    taken (words taken, repeats counted) and epochs (whole passes).

    The document at which a budget ends is taken in part, so a source's words meet its
    target to the word. A null text has size 0; a null source is a source; a null id draws as the empty text.
    Rows of one id draw one number and are told apart by their size and text; equal rows
    are interchangeable. An empty table gives an empty table. A kept column that bears the name of a
    result comes back as doc_<name>.
    """
    size = word_count(text) if size is None else size
    quality = quality_weight(text) if quality is None else quality
    # positive and finite, whatever the caller's weight
    quality = F.greatest(F.coalesce(quality, F.lit(0.0)), F.lit(1e-9))
    skey = F.when(F.col(source).isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col(source).cast("string")))
    base = docs.select(
        F.col(id_col).alias("__id"), F.col(source).alias("__source"), skey.alias("skey"), size.cast("long").alias("size"),
        (-F.log(uniform(id_col, seed)) / quality).alias("key"), F.xxhash64(text).alias("tie"),
        F.struct(*[F.col(c) for c in keep]).alias("kept") if keep else F.lit(0).alias("kept"),
    )
    buckets = max(BUCKETS, docs.count() // BUCKET_ROWS)
    base = written(base.withColumn("bucket", F.least(F.lit(buckets - 1), F.floor((1 - F.exp(-F.col("key"))) * buckets)).cast("int")), "mix")
    buckets = base.groupBy("skey", "bucket").agg(F.sum("size").alias("words"), F.min("__source").alias("source"))
    order = Window.partitionBy("skey").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = written(buckets.withColumn("before", F.coalesce(F.sum("words").over(order), F.lit(0))), "mixstarts")
    targets = source_targets(starts.groupBy("skey").agg(F.min("source").alias("source"), F.sum("words").alias("source_size")), weights, most)
    epochs = F.when(F.col("source_size") > 0, F.least(F.lit(most), F.floor(F.col("target") / F.col("source_size")))).otherwise(F.lit(0)).cast("long")
    targets = targets.withColumn("epochs", epochs)
    targets = targets.withColumn("budget", F.floor(F.col("target") - F.col("epochs") * F.col("source_size") + 0.5).cast("long"))
    starts = starts.join(targets, "skey").select("skey", "bucket", "before", "source_size", "target", "epochs", "budget")
    inside = Window.partitionBy("skey", "bucket").orderBy("key", "__id", "size", "tie").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("before") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("budget") - start))
    taken = F.col("epochs") * F.col("size") + part
    drawn = base.join(starts, ["skey", "bucket"]).withColumn("taken", taken.cast("long"))
    out = [F.col(f"kept.`{c}`").alias(f"doc_{c}" if c in RESULTS else c) for c in keep if c not in (id_col, source)]
    return drawn.select(F.col("__id").alias(id_col), F.col("__source").alias(source), *out, "size", "source_size", "target", "taken", "epochs")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source,
    CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
    0.05::DOUBLE + 0.95::DOUBLE * CASE WHEN length(text) > 0 THEN CAST(length(regexp_replace(text, '[!-@\[-`{-~]', '', 'g')) AS DOUBLE) / length(text) ELSE 0.0 END AS quality,
    (CAST(CAST('0x' || substr(md5('17:' || CAST(doc_id AS VARCHAR)), 1, 13) AS BIGINT) AS DOUBLE) + 0.5) / 4503599627370496.0::DOUBLE AS u
  FROM documents),
k AS (SELECT *, -ln(u) / quality AS key FROM d),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM k GROUP BY source),
w AS (SELECT *, CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS DOUBLE) AS w, 3 * CAST(source_size AS DOUBLE) AS cap FROM s),
l AS (SELECT *, cap / w AS fill,
    (sum(CAST(source_size AS DOUBLE)) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level,
    row_number() OVER (ORDER BY cap / w, source NULLS LAST) AS place FROM w),
t AS (SELECT source, source_size, least(cap, coalesce(w * (SELECT arg_min(level, place) FROM l WHERE fill >= level), cap)) AS target FROM l),
e AS (SELECT *, CAST(CASE WHEN source_size > 0 THEN least(3, floor(target / source_size)) ELSE 0 END AS BIGINT) AS epochs FROM t),
b AS (SELECT *, CAST(floor(target - epochs * source_size + 0.5) AS BIGINT) AS budget FROM e),
r AS (SELECT k.*, b.source_size, b.target, b.epochs, b.budget,
    coalesce(sum(size) OVER (PARTITION BY k.source ORDER BY key, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM k JOIN b ON k.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, source, size, source_size, target, CAST(epochs * size + greatest(0, least(size, budget - start)) AS BIGINT) AS taken, epochs FROM r
"""
