"""Files of rows that share a key, so that candidates meet, with dense ones dealt into blocks; joins that deal hot keys over salts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a file (or of two blocks of one) that one task holds.
DENSE = 20_000
#: Classes in which files are counted; the counts of one class are 16 bytes, so at most 16 MB are broadcast.
HASHES = 1 << 20
#: Parts into which a join deals the rows of a hot key; a key is hot with more than this share of all rows, so there are fewer than
#: its inverse.
SALTS, HOT = 16, 1 / 1000


def dealt(filed: DataFrame, dense: int) -> DataFrame:
    """``filed`` (fp, key and more columns) with keys under which at most about ``dense`` rows meet, and every two rows of one key do.

    Files are counted in classes by a hash of the key first, which combines before the shuffle. A row of a class with more than
    ``dense`` rows goes into one of the class's blocks by its fingerprint, and from there to the pairs of that block with every
    block; other rows keep their key. Two rows may meet more than once.
    """
    kind = F.pmod(F.col("key"), F.lit(HASHES)).alias("kind")
    classes = filed.groupBy(kind).agg(F.count("*").alias("n")).where(F.col("n") > dense).select("kind", F.ceil(2 * F.col("n") / dense).alias("blocks"))
    block = F.pmod(F.xxhash64("fp"), F.col("blocks"))
    pairs = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda j: F.xxhash64("key", F.least(block, j), F.greatest(block, j)))
    rest = [c for c in filed.columns if c != "key"]
    with_kind = filed.withColumn("kind", kind).join(F.broadcast(classes), "kind", "left")  # at most HASHES rows
    return with_kind.select(*rest, F.explode(F.when(F.col("blocks").isNull(), F.array("key")).otherwise(pairs)).alias("key"))


def joined(rows: DataFrame, named: DataFrame, key: str, n: str) -> DataFrame:
    """``rows`` with the columns of ``named``, which has one row for each key and in ``n`` the number of rows that have it (dropped)."""
    many = named.agg(F.coalesce(F.sum(n), F.lit(0))).first()[0] * HOT
    hot = F.broadcast(named.where(F.col(n) > many).select(key, F.lit(SALTS).alias("salts")))  # fewer than 1 / HOT rows
    own = F.when(F.col("salts").isNotNull(), F.pmod(F.monotonically_increasing_id(), F.col("salts")).cast("int")).otherwise(F.lit(0))
    salted = rows.join(hot, key, "left").withColumn("salt", own).drop("salts")
    spread = named.withColumn("salt", F.explode(F.when(F.col(n) > many, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))))).drop(n)
    return salted.join(spread, [key, "salt"]).drop("salt")


def scattered(rows: DataFrame, n: int, size: int = 100_000) -> DataFrame:
    """``n`` short rows in partitions of about ``size``, so that what is made of them is made in many tasks."""
    return rows.repartition(max(2 * rows.sparkSession.sparkContext.defaultParallelism, -(-n // size)))
