"""Operator 2: mixing sources to target weights, DataFrame and SQL functions only.

Targets: the sources, by code point with null last, weigh 5, 2, 1, repeating, and share 150 % of all words. No target exceeds
2 times its source's words; what is cut off is shared again by weight until none is above, which is the level L at which the sum
of least(2 * words, L * weight) is the whole (water filling, closed form over the sources sorted by words / weight).

Documents: Efraimidis-Spirakis sampling. u is uniform from a hash of the id, the key -ln(u) / quality weight is exponential;
sorted within the source, the keys give a weighted random order. Complete epochs of the source come first; of the rest of the
target, documents take words in key order until the prefix sum reaches it, the last one in part.

A source of any size is dealt into key ranges of a few thousand rows; only the ranges' sums are ordered per source, and each
range is then summed on its own, so no task holds a whole source.

Defined results: null and empty texts have size 0 and take 0; null is a source of its own; u of a row without id is from a hash of its
text; rows of one u are ordered by id and size; repeated rows count as often as they occur (equal rows may differ in ``taken`` where
the budget ends among them); an empty table gives an empty result; other columns are ignored; the words of a very long text are
counted over the whole of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import checkpointed, fresh, parallel, row_key

#: Rows that a key range holds on average.
RANGE_ROWS = 2000
WEIGHTS = (5, 2, 1)
SHARE, MOST = 1.5, 2
WORD = r"[^\x20\x09-\x0D]+"
#: Marks of low quality, of which a tenth of the characters is the most; the share of letters that is plenty.
JUNK, PLENTY = "!%&$#*|~^", 0.6
#: Least quality weight.
LEAST = 0.001


def quality_weight(text: Column) -> Column:
    """From 0.1 to 1 (empty: 1): falls with the share of marks, with a share of letters below PLENTY, and with repeated lines."""
    n, lines = F.length(text), F.split(text, "\n")
    marks = 1.0 - F.least(F.lit(1.0), 10.0 * (n - F.length(F.translate(text, JUNK, ""))) / n)
    letters = F.least(F.lit(1.0), F.length(F.regexp_replace(text, r"[^\p{L}]+", "")) / n / PLENTY)
    distinct = F.size(F.array_distinct(lines)) / F.size(lines)
    return F.when(n > 0, F.greatest(F.lit(0.1), marks * letters * distinct)).otherwise(F.lit(1.0))


def uniform(id_col: Column, text: Column, seed: str = "mix") -> Column:
    """In (0, 1), from 52 bits of a hash of the id, or of the text where there is none."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.concat(F.lit("text "), F.md5(text)))))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def targets(sizes: DataFrame) -> DataFrame:
    """Of (source, source_size): adds rank (by code point, null last) and target. One task sorts the sources and sums them in passes."""
    ranked = sizes.withColumn("rank", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())))
    ranked = ranked.withColumn("w", F.element_at(F.array(*map(F.lit, WEIGHTS)), ((F.col("rank") - 1) % len(WEIGHTS) + 1).cast("int")).cast("double"))
    ranked = ranked.withColumn("cap", (MOST * F.col("source_size")).cast("double")).withColumn("full", F.col("cap") / F.col("w"))
    before = W.orderBy("full", "rank").rowsBetween(W.unboundedPreceding, -1)
    every = W.partitionBy(F.lit(1))
    earlier = lambda name: F.coalesce(F.sum(name).over(before), F.lit(0.0))
    ranked = ranked.withColumn("level", (SHARE * F.sum("source_size").over(every) - earlier("cap")) / (F.sum("w").over(every) - earlier("w")))
    ranked = ranked.withColumn("level", F.min(F.when(F.col("full") >= F.col("level"), F.struct("full", "rank", "level"))).over(every)["level"])
    return ranked.select("source", "source_size", "rank", F.least("cap", F.col("level") * F.col("w")).alias("target"))


def _prepared(docs: DataFrame, more: list[str], weight: Column | None) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    u = uniform(F.col("doc_id"), text).alias("u")
    weighed = quality_weight(text) if weight is None else F.coalesce(F.greatest(weight.cast("double"), F.lit(LEAST)), F.lit(1.0))
    return parallel(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), weighed.alias("weight"), u, *more).withColumn("key", -F.ln("u") / F.col("weight")).drop("u")


def mix(docs: DataFrame, whole: bool = False, row: str | None = None, weight: Column | None = None) -> DataFrame:
    """doc_id, size, source_size, target, taken (words the mix takes, repeats counted) of every row.

    ``weight``: the documents' quality, as a classifier's score of them (null: 1); else ``quality_weight`` of their texts.

    ``whole``: documents are taken wholly; the one in which the budget ends is taken if at least half of it fits.
    ``row``: a column of ``docs`` that tells rows apart, added to the result; it orders rows of one id and size.
    """
    more = [row] if row else []
    per = checkpointed(_prepared(docs, more, weight))
    by_source = per.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"), F.avg("weight").alias("mean"))
    goal = targets(by_source.select("source", "source_size")).withColumnRenamed("source", "s")
    goal = checkpointed(goal.join(by_source.select(F.col("source").alias("s2"), "n", "mean"), F.col("s").eqNullSafe(F.col("s2"))).drop("s2"))
    ranges = F.ceil(F.col("n") / RANGE_ROWS)
    at = F.least(ranges - 1, F.floor((1 - F.exp(-F.col("key") * F.col("mean"))) * ranges)).cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    budget = F.round(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long")
    rows = per.join(goal, per["source"].eqNullSafe(goal["s"])).withColumn("range", at)
    rows = rows.select("doc_id", "size", "key", "rank", "range", "source_size", "target", epochs.alias("epochs"), *more).withColumn("budget", budget)
    sums = rows.groupBy("rank", "range").agg(F.sum("size").alias("in_range"))
    offsets = sums.select(F.col("rank").alias("r"), F.col("range").alias("g"), (F.sum("in_range").over(W.partitionBy("rank").orderBy("range")) - F.col("in_range")).alias("offset"))
    rows = rows.join(offsets, (F.col("rank") == F.col("r")) & (F.col("range") == F.col("g")))
    inside = F.sum("size").over(W.partitionBy("rank", "range").orderBy("key", F.col("doc_id").asc_nulls_last(), "size", *more).rowsBetween(W.unboundedPreceding, 0))
    left = F.col("budget") - F.col("offset") - inside + F.col("size")  # words of the budget before this document
    part = F.when(left * 2 >= F.col("size"), F.when(left > 0, F.col("size")).otherwise(F.lit(0))).otherwise(F.lit(0)) if whole else F.greatest(F.lit(0), F.least(left, F.col("size")))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("epochs") * F.col("size") + part).cast("long").alias("taken"), *more)


def mixed_documents(docs: DataFrame) -> DataFrame:
    """Rows of ``docs``, each as often as the mix takes the whole document; its columns. Equal rows are one with all their times."""
    times, key, copy = fresh(docs, "_times"), fresh(docs, "_row"), fresh(docs, "_copy")
    keyed = docs.withColumn(key, row_key(docs.columns))
    each = F.when(F.col("size") > 0, F.round(F.col("taken") / F.col("size"))).otherwise(F.lit(0))
    taken = mix(keyed, whole=True, row=key).groupBy(key).agg(F.sum(each).cast("int").alias(times)).where(F.col(times) > 0)
    joined = keyed.dropDuplicates([key]).join(taken, key)  # equal rows are combined before the shuffle
    return joined.withColumn(copy, F.explode(F.array_repeat(F.lit(1), F.col(times)))).select(docs.columns)


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    CASE WHEN length(text) > 0 THEN greatest(0.1::DOUBLE, (1.0::DOUBLE - least(1.0::DOUBLE, 10.0::DOUBLE * (length(text) - length(translate(text, '!%&$#*|~^', ''))) / length(text)))
      * least(1.0::DOUBLE, length(regexp_replace(text, '[^\p{L}]+', '', 'g'))::DOUBLE / length(text) / 0.6::DOUBLE)
      * (len(list_distinct(string_split(text, chr(10))))::DOUBLE / len(string_split(text, chr(10))))) ELSE 1.0::DOUBLE END AS weight,
    (('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, 'text ' || md5(coalesce(text, '')))), 1, 13))::BIGINT::DOUBLE + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rnk FROM d GROUP BY source
), w AS (
  SELECT *, ([5, 2, 1])[((rnk - 1) % 3 + 1)::INT]::DOUBLE AS w, (2 * source_size)::DOUBLE AS cap FROM s
), f AS (
  SELECT *, cap / w AS fill FROM w
), l AS (
  SELECT *, (1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE - coalesce(sum(cap) OVER (ORDER BY fill, rnk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(w) OVER (ORDER BY fill, rnk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM f
), t AS (
  SELECT source, source_size, least(cap, (SELECT level FROM l WHERE fill >= level ORDER BY fill, rnk LIMIT 1) * w) AS target FROM l
), e AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs FROM t
), r AS (
  SELECT d.doc_id, d.size, e.source_size, e.target, e.epochs, round(e.target - e.epochs * e.source_size)::BIGINT
    - (sum(d.size) OVER (PARTITION BY d.source ORDER BY -ln(u) / weight, doc_id NULLS LAST, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - d.size) AS budget_left
  FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source
)
SELECT doc_id, size, source_size, target, (epochs * size + greatest(0, least(budget_left, size)))::BIGINT AS taken FROM r
"""
