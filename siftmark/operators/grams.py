"""A trigram index: postings of the names and texts of samples, by which parts of words are looked up without reading all texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WIDTH = 3


def grams(text: Column) -> Column:
    """The distinct trigrams of a text, without regard to case; none in a shorter one."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(f"(?s)(?=(.{{{WIDTH}}}))"), F.lit(1)))


def indexed(samples: DataFrame, key: str, columns: tuple[str, ...] = ("file_name", "text"), buckets: int = 256) -> DataFrame:
    """(bucket, gram, field, key): a posting for each distinct trigram of each of the columns; null texts have none.

    Written by write(), a lookup reads the buckets of its own trigrams only.
    """
    of = [samples.select(key, F.lit(c).alias("field"), F.explode(grams(F.col(c))).alias("gram")) for c in columns]
    both = of[0]
    for x in of[1:]:
        both = both.unionByName(x)
    return both.select(F.pmod(F.xxhash64("gram"), F.lit(buckets)).cast("int").alias("bucket"), "gram", "field", F.col(key).alias("key"))


def write(index: DataFrame, folder: str) -> None:
    """By bucket, so that a bucket is a folder; rows of a gram that nearly all texts have are dealt over several files by key."""
    index.repartition(F.col("bucket"), F.pmod(F.xxhash64("key"), F.lit(4))).sortWithinPartitions("bucket", "gram").write.partitionBy("bucket").parquet(folder)


def maybe(index: DataFrame, part: str, fields: tuple[str, ...], buckets: int = 256) -> DataFrame | None:
    """(key): the samples of which one field has all trigrams of `part`; None where the part is shorter than one and a scan is due."""
    low = part.lower()
    wanted = list(dict.fromkeys(low[i : i + WIDTH] for i in range(len(low) - WIDTH + 1)))
    if not wanted:
        return None
    spark = index.sparkSession
    given = spark.range(1).select(F.explode(F.array(*map(F.lit, wanted))).alias("gram")).select("gram", F.pmod(F.xxhash64("gram"), F.lit(buckets)).cast("int").alias("b"))
    at = [r.b for r in given.select("b").distinct().collect()]  # a number a trigram of the part
    held = index.where(F.col("bucket").isin(at) & F.col("gram").isin(wanted) & F.col("field").isin(*fields))
    return held.groupBy("key", "field").agg(F.count("*").alias("n")).where(F.col("n") >= len(wanted)).select("key").distinct()


def holding(samples: DataFrame, index: DataFrame, part: str, key: str, fields: tuple[str, ...] = ("file_name", "text"), buckets: int = 256) -> DataFrame:
    """Rows of samples of which one field holds `part`, without regard to case: those that the index finds are compared; a part of one or two characters is looked for in all."""
    found = maybe(index, part, fields, buckets)
    some = samples if found is None else samples.join(found.withColumnRenamed("key", key), key, "left_semi")
    hit = F.lit(False)
    for f in fields:
        hit = hit | F.coalesce(F.contains(F.lower(F.col(f)), F.lit(part.lower())), F.lit(False))
    return some.where(hit)
