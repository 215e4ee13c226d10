"""Words in text without spaces: a dictionary learned from the samples, a graph of the words that can start at each place, and the likeliest path.

A run of characters is cut into words so that the product of the words' probabilities is greatest. Runs of letters of one
script that has spaces are words by themselves.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from ..functions.fixed import BUSINESS_TERMS
from ..sources.shared import pieces

HAN = r"[\p{IsHan}]+"
LONGEST = 4  # characters of a learned word
MOST_WORDS = 200_000  # of a dictionary, which goes to all tasks


def learned(samples: DataFrame, text: str = "text", runs: str = HAN, least: int = 5, bound: float = 20.0, longest: int = LONGEST, most: int = MOST_WORDS) -> dict[str, int]:
    """word -> count: the strings of two to `longest` characters in all runs that occur `least` times or more and hold together.

    A string holds together if at each place where it could be parted it is `bound` times as frequent as its parts would be
    beside each other by chance. All samples count; of the words found the `most` frequent are kept, which bounds the model.
    Single characters are counted too.
    """
    parts = samples.select(F.explode(F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(runs), F.lit(0))).alias("run"))
    grams = F.concat(*[F.regexp_extract_all("run", F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1)) for n in range(1, longest + 1)])
    counts = parts.select(F.explode(grams).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    total = counts.where(F.length("word") == 1).agg(F.sum("n")).first()[0] or 0
    whole = counts.where((F.length("word") > 1) & (F.col("n") >= least))
    cuts = whole.select("word", "n", F.explode(F.sequence(F.lit(1), F.length("word") - 1)).alias("k"))
    cuts = cuts.select("word", "n", F.expr("substring(word, 1, k)").alias("a"), F.expr("substring(word, k + 1)").alias("b"))
    left, right = counts.select(F.col("word").alias("a"), F.col("n").alias("na")), counts.select(F.col("word").alias("b"), F.col("n").alias("nb"))
    close = cuts.join(left, "a").join(right, "b").groupBy("word", "n").agg(F.min(F.col("n") * F.lit(float(total)) / (F.col("na") * F.col("nb"))).alias("held"))
    words = close.where(F.col("held") >= bound).select("word", "n").unionByName(counts.where(F.length("word") == 1))
    return {r.word: r.n for r in words.orderBy(F.desc("n"), "word").limit(most).collect()}


class Segmenter:
    """best() of a run: the path of the greatest probability; of equal ones that with the longer first word.

    whole: terms that are worth more than any probability, a longer one more than shorter ones in its place, so they stay whole.
    """

    def __init__(self, words: dict[str, int], whole: tuple[str, ...] = ()):
        total = sum(words.values()) or 1
        self.cost = {w: math.log(n / total) for w, n in words.items() if w} | {w: 1e4 * len(w) ** 2 for w in whole}
        self.unknown = math.log(0.5 / total)  # a character that is no word
        self.starts = {w[:i] for w in self.cost for i in range(1, len(w) + 1)}

    def best(self, run: str) -> list[str]:
        n = len(run)
        value, step = [0.0] * (n + 1), [1] * n
        for i in range(n - 1, -1, -1):
            best, size, j = self.cost.get(run[i], self.unknown) + value[i + 1], 1, i + 2
            while j <= n and run[i:j] in self.starts:
                if (c := self.cost.get(run[i:j])) is not None and c + value[j] >= best:
                    best, size = c + value[j], j - i
                j += 1
            value[i], step[i] = best, size
        out, i = [], 0
        while i < n:
            out.append(run[i : i + step[i]])
            i += step[i]
        return out


def segmented(df: DataFrame, runs: str, words: dict[str, int], cut: str = "cut", whole: tuple[str, ...] = BUSINESS_TERMS) -> DataFrame:
    """df with an array of the words of each element of the array column `runs`; nulls have none."""
    shared = df.sparkSession.sparkContext.broadcast(Segmenter(words, whole))
    names, place = [f"_{i}" for i in range(len(df.columns))], df.columns.index(runs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (some for batch in batches for some in pieces(batch)):
            got = [[w for r in rs or () if r for w in shared.value.best(r)] for rs in b.column(place).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(got, pa.list_(pa.string()))], [*names, cut])

    schema = StructType([*(StructField(n, f.dataType, f.nullable) for n, f in zip(names, df.schema, strict=True)), StructField(cut, ArrayType(StringType()))])
    return df.toDF(*names).mapInArrow(run, schema).toDF(*df.columns, cut)


def best_words(df: DataFrame, key: str, words: str, top: int = 30) -> DataFrame:
    """(key, word, points): by TF-IDF over all rows of df, 60 for a row's best word, 59 for its second, and so on down to the `top`-th; ties by word."""
    n = df.count()
    each = df.select(key, F.explode(words).alias("word")).groupBy(key, "word").agg(F.count("*").alias("tf"))
    seen = each.groupBy("word").agg(F.count("*").alias("df"))
    from pyspark.sql import Window

    value: Column = F.col("tf") * F.log(F.lit(float(n + 1)) / F.col("df"))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("value"), "word"))
    placed = each.join(seen, "word").select(key, "word", value.alias("value")).withColumn("rank", rank)
    return placed.where(F.col("rank") <= top).select(key, "word", (F.lit(61) - F.col("rank")).cast("long").alias("points"))
