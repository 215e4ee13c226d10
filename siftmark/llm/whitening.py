"""Embedding whitening by hierarchical SVD merging.

Each partition keeps, of its centred vectors, all singular values and right singular vectors, and its count and sums. Two
such factors merge by a singular value decomposition of both, scaled, and one row more, which corrects for the distance of
their means. No dimension is dropped, so the last factor is that of all vectors, up to rounding, and no product of
uncentred numbers is ever formed. Factors meet in groups over rounds of shuffles, never all in one place.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column_place, mapped, prepare, release, shared_dir, table, with_columns

FAN = 16  # factors that one task merges
LARGEST = 2**40  # of whole numbers, so that sums of a batch are exact
SCHEMA = "part long, n long, sums string, s binary, vt binary"


@dataclass
class Factor:
    """n vectors: their sums (exact for whole numbers), and the centred vectors' singular values and right singular vectors."""

    n: int
    sums: list
    s: np.ndarray
    vt: np.ndarray

    @staticmethod
    def of(x: np.ndarray) -> Factor:
        """Of the rows of x, one at least."""
        if x.dtype.kind == "i" and np.abs(x).max(initial=0) > LARGEST:
            raise OverflowError(f"an entry is beyond {LARGEST}")
        base = np.rint(x.mean(0)).astype(x.dtype)
        near = (x - base).astype(np.float64)  # exact for whole numbers
        _, s, vt = np.linalg.svd(np.linalg.qr(near - near.mean(0), mode="r"), full_matrices=False)
        return Factor(len(x), x.sum(0).tolist(), s, vt)

    def merge(self, other: Factor) -> Factor:
        if len(self.sums) != len(other.sums):
            raise ValueError(f"vectors of {len(self.sums)} and of {len(other.sums)} dimensions")
        n = self.n + other.n
        apart = np.array([(a * other.n - b * self.n) / (self.n * other.n) for a, b in zip(self.sums, other.sums, strict=True)])
        row = np.sqrt(self.n * other.n / n) * apart
        _, s, vt = np.linalg.svd(np.concatenate([self.s[:, None] * self.vt, other.s[:, None] * other.vt, row[None]]), full_matrices=False)
        return Factor(n, [a + b for a, b in zip(self.sums, other.sums, strict=True)], s, vt)

    def covariance(self) -> np.ndarray:
        return (self.vt.T * (self.s**2 / self.n)) @ self.vt

    def row(self, part: int) -> dict:
        return {"part": part, "n": self.n, "sums": json.dumps(self.sums), "s": self.s.tobytes(), "vt": self.vt.tobytes()}

    @staticmethod
    def from_row(n: int, sums: str, s: bytes, vt: bytes) -> Factor:
        values = np.frombuffer(s)
        return Factor(n, json.loads(sums), values, np.frombuffer(vt).reshape(len(values), -1))


ARROW = pa.schema([("part", pa.int64()), ("n", pa.int64()), ("sums", pa.string()), ("s", pa.binary()), ("vt", pa.binary())])


def matrix(column: pa.Array) -> np.ndarray:
    """The rows of a list column without nulls, all of one length."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    length = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    if len(length) and (length != length[0]).any():
        raise ValueError(f"vectors of {length.min()} and of {length.max()} dimensions")
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(length), -1)


def factored(vectors: DataFrame, folder: str) -> Factor | None:
    """The factor of all rows of one column of arrays (long or double, no nulls, not empty); None if there are no rows.

    A task's memory holds a batch and one factor. Each round writes a row per task, and a later one reads FAN of them per task.
    """
    spark = vectors.sparkSession
    prepare(spark)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        mine = None
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                f = Factor.of(matrix(b.column(0).slice(at, 4096)))
                mine = mine.merge(f) if mine else f
        if mine:
            yield pa.RecordBatch.from_pylist([mine.row(TaskContext.get().partitionId())], ARROW)
        release()

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine: dict[int, Factor] = {}
        for b in batches:
            for part, *rest in zip(*(c.to_pylist() for c in b.columns), strict=True):
                f = Factor.from_row(*rest)
                mine[part] = mine[part].merge(f) if part in mine else f
        if mine:
            yield pa.RecordBatch.from_pylist([f.row(part) for part, f in mine.items()], ARROW)
        release()

    made, step = vectors.mapInArrow(first, SCHEMA), 0
    while True:
        made.write.parquet(f"{folder}/{step}")
        rows = spark.read.parquet(f"{folder}/{step}")
        left, last = rows.agg(F.count("*"), F.max("part")).first()
        if left <= FAN:
            found = [Factor.from_row(r["n"], r["sums"], r["s"], r["vt"]) for r in rows.orderBy("part").collect()]
            return reduce(Factor.merge, found) if found else None
        step += 1
        dealt = rows.withColumn("next", F.expr(f"part div {FAN}").cast("int")).repartitionById(last // FAN + 1, F.col("next")).sortWithinPartitions("part")
        made = dealt.select(F.col("next").cast("long").alias("part"), "n", "sums", "s", "vt").mapInArrow(merged, SCHEMA)


@dataclass
class Whitening:
    """Components by falling variance: unit rows of `vectors`, `variances`; `explained` of all variance; what they were fitted on."""

    n: int
    sums: list
    vectors: np.ndarray
    variances: np.ndarray
    explained: np.ndarray

    @staticmethod
    def of(f: Factor | None, most: int) -> Whitening:
        """Components without variance (up to rounding) can't be scaled to one, and are left out."""
        if f is None:
            return Whitening(0, [], np.zeros((0, 0)), np.zeros(0), np.zeros(0))
        e = f.s**2 / f.n
        keep = int((f.s > f.s.max(initial=0) * len(f.sums) * max(f.n, 1) ** 0.5 * 1e-15).sum())
        k = min(most, keep)
        return Whitening(f.n, f.sums, f.vt[:k], e[:k], e[:k] / e.sum() if k else e[:0])

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n times x less the sums; exact for whole numbers."""
        return self.n * x - np.array(self.sums, x.dtype)

    def values(self, x: np.ndarray) -> np.ndarray:
        return (self.centred(x) / self.n) @ self.vectors.T / np.sqrt(self.variances)

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """Sums of the squares of centred(), exact; beyond 63 bits an error."""
        y = self.centred(x)
        if (y.astype(np.float64) ** 2).sum(1).max(initial=0) > 2.0**62 or float(self.n) * np.abs(x).max(initial=0) > 2.0**62:
            raise OverflowError("a deviation is beyond 63 bits")
        return (y * y).sum(1)


def finite(column: str) -> F.Column:
    """Whether a column of arrays holds a vector: not null, not empty, no null and no non-finite entries."""
    bad = F.exists(F.col(column), lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return F.col(column).isNotNull() & (F.size(column) > 0) & ~bad


def whitening(vectors: DataFrame, folder: str, most: int = 16) -> tuple[Whitening, float]:
    """Fit on the distinct rows of one column of arrays; and the largest entry of the whitened rows' covariance less the identity.

    Equal rows are summed up per task before they are shuffled. The distinct rows are written to the folder and read twice.
    """
    spark, vectors = vectors.sparkSession, vectors.toDF("x")
    vectors.distinct().write.parquet(f"{folder}/fit")
    fit = spark.read.parquet(f"{folder}/fit")
    model = Whitening.of(factored(fit, f"{folder}/factors"), most)
    if not len(model.vectors):
        return model, 0.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            w = model.values(matrix(b.column(0)))
            yield pa.RecordBatch.from_arrays([pa.array(list(w), pa.list_(pa.float64()))], ["x"])

    made = factored(fit.mapInArrow(run, "x array<double>"), f"{folder}/whitened")
    return model, float(np.abs(made.covariance() - np.eye(len(model.vectors))).max())


def transform(df: DataFrame, model: Whitening, vector: str = "x") -> DataFrame:
    """df with `whitened` (an array, a number per component) and, for vectors of whole numbers, the exact `deviation`.

    Rows need vectors as the fit had them; columns of these names are replaced, others kept.
    """
    prepare(df.sparkSession)
    kept = df.drop("whitened", "deviation")
    place, names = column_place(kept, vector), [f"_{i}" for i in range(len(kept.columns) + 2)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                some = b.slice(at, 4096)
                x = matrix(some.column(place))
                if model.n and x.shape[1] != len(model.sums):
                    raise ValueError(f"vectors of {x.shape[1]} and of {len(model.sums)} dimensions")
                w = list(model.values(x)) if len(model.vectors) else [[]] * len(x)
                d = model.deviations(x) if x.dtype.kind == "i" else [None] * len(x)
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(w, pa.list_(pa.float64())), pa.array(d, pa.int64())], names)
        release()

    return mapped(kept, run, with_columns(kept, whitened="array<double>", deviation="long"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings whitened by up to 16 components, a row for each. Repeated vectors count once in the fit and all get rows.

    Rows whose vector is null, empty or holds null or non-finite entries give none; vectors of different lengths are an error,
    and so are entries beyond 2**40. With one distinct vector, or none, there is no variance and there are no rows.
    """
    rows = table(spark, sf_dir, "embeddings").where(finite("embedding"))
    rows = rows.select("vec_id", F.transform("embedding", lambda c: F.floor(c.cast("double") * 64).cast("long") + 1_000_000).alias("x"))
    model, error = whitening(rows.select("x"), shared_dir(spark, "whitening"))
    share = F.array(*map(F.lit, model.explained.tolist())) if len(model.explained) else F.array().cast("array<double>")
    out = transform(rows, model).select("vec_id", "deviation", F.posexplode("whitened").alias("place", "whitened"))
    return out.select("vec_id", (F.col("place") + 1).cast("int").alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", F.get(share, F.col("place")).alias("explained"), F.lit(error).alias("identity_error"))
