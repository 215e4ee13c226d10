"""Document fingerprints: bottom-k sketches of word-shingle hashes, mergeable, for resemblance, containment and distinct counts."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, keyed, ordered_parts, partitions, prepare, shingle_lists, table

K = 128
RANGE = float(2**64)


class Sketch:
    """The k smallest distinct shingle hashes of a set; `full` if the set has no others, so that estimates are then exact."""

    def __init__(self, hashes: np.ndarray, k: int = K, full: bool | None = None):
        low = np.unique(hashes)
        self.full = len(low) <= k if full is None else full and len(low) <= k
        self.low, self.k = low[:k], k

    def merge(self, other: Sketch) -> Sketch:
        """The sketch of the union of both sets, as if made from it."""
        return Sketch(np.concatenate([self.low, other.low]), min(self.k, other.k), self.full and other.full)

    def count(self) -> float:
        """Distinct shingles."""
        return float(len(self.low)) if self.full else (self.k - 1) * RANGE / (float(self.low[-1]) + 1)

    def resemblance(self, other: Sketch) -> float:
        """Estimated Jaccard similarity: the share of the union's k smallest that both have. Two empty sets are alike."""
        union = np.union1d(self.low, other.low)
        union = union if self.full and other.full else union[: min(self.k, other.k)]
        if not len(union):
            return 1.0
        both = np.intersect1d(self.low, other.low, assume_unique=True)
        return float(np.count_nonzero(both <= union[-1])) / len(union)

    def containment(self, other: Sketch) -> float:
        """Estimated share of this set that the other has; an empty set is contained."""
        n = self.count()
        return min(1.0, self.resemblance(other) * self.merge(other).count() / n) if n else 1.0

    def text(self) -> str:
        """`+` if the sketch holds the whole set, else `~`; then the hashes as base64 of little-endian 64-bit integers."""
        return ("+" if self.full else "~") + base64.b64encode(self.low.astype("<u8").tobytes()).decode()

    @staticmethod
    def parse(text: str, k: int = K) -> Sketch:
        return Sketch(np.frombuffer(base64.b64decode(text[1:]), "<u8").astype(U64), k, text[0] == "+")


def sketches(raws: list[bytes], k: int = K) -> list[Sketch]:
    return [Sketch(x, k) for x in shingle_lists(raws)]


def fingerprints(df: DataFrame, id_column: str = "doc_id", k: int = K) -> DataFrame:
    """(id, n_shingles_estimate, fingerprint) per row. Null is empty text: an empty sketch. Equal texts have equal fingerprints.

    Repeated rows are sketched alike, and an empty table gives no rows. A very long text is sketched whole, as one array of its shingles.
    """
    prepare(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = sketches([x or b"" for x in b.column(1).cast(pa.binary()).to_pylist()], k)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([s.count() for s in made], pa.float64()), pa.array([s.text() for s in made], pa.string())], ["key", "n_shingles", "fingerprint"])

    return keyed(df, run, id_column, ["text"], {"n_shingles": "double", "fingerprint": "string"})


def merged(prints: DataFrame, group: str, k: int = K) -> DataFrame:
    """One fingerprint per group, of the union of its members' sets: each task merges its rows first, so a group is one sketch per task.

    A null group is a group. An empty table gives no rows.
    """
    prepare(prints.sparkSession)

    from pyspark.sql.pandas.types import to_arrow_type

    key_type, kind = to_arrow_type(prints.schema[group].dataType), f"`{group}` {dict(prints.dtypes)[group]}, fingerprint string"

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by: dict = {}
        for b in batches:
            for g, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                s = Sketch.parse(x, k)
                by[g] = by[g].merge(s) if g in by else s
        yield pa.RecordBatch.from_arrays([pa.array(list(by), key_type), pa.array([s.text() for s in by.values()], pa.string())], [group, "fingerprint"])

    def union(t: pa.Table) -> pa.Table:
        s = reduce(Sketch.merge, (Sketch.parse(x, k) for x in t.column("fingerprint").to_pylist()))
        return pa.table({group: t.column(group)[:1], "fingerprint": [s.text()]})

    parts = prints.select(group, "fingerprint").where("fingerprint IS NOT NULL").mapInArrow(within, kind)
    return parts.groupBy(group).applyInArrow(union, kind)


def op9_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's fingerprint beside that of its edited text and the next document's.

    One shuffle: ranges of doc_id, whose first keys are known, so a row that opens a range is sent to the range before it too.
    Null ids come first; equal ids are ordered by text. Null text is empty, with an empty sketch; a table of one row is its own
    next one, and an empty table gives no rows.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    parts, bounds = ordered_parts(docs, "doc_id", partitions(spark))
    n = max(1, len(bounds))
    first = bounds[0] if bounds else 0
    nulls_open = docs.where("doc_id IS NULL").limit(1).count() > 0  # then the first row is one without id
    opens = F.coalesce(F.col("doc_id") == (F.element_at(F.array(*map(F.lit, bounds)), F.col("part") + 1) if bounds else F.lit(first)), F.lit(False))
    head = F.col("doc_id").isNull() if nulls_open else F.coalesce(F.col("doc_id") == first, F.lit(False))
    before = F.when(head, n - 1).otherwise(F.when(opens, F.col("part") - 1).otherwise(F.lit(None).cast("int")))
    places = F.array_compact(F.array(F.struct(F.col("part"), F.lit(0).alias("halo")), F.when(before.isNotNull(), F.struct(before.alias("part"), F.lit(1).alias("halo")))))
    spread = parts.select("doc_id", "text", F.explode(places).alias("p")).select("doc_id", "text", "p.part", "p.halo")
    if nulls_open:  # the row that opens the first range with ids stays inside it
        spread = spread.where("part >= 0")
    sorted_parts = spread.repartitionById(n, F.col("part")).sortWithinPartitions("part", "halo", F.asc_nulls_first("doc_id"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []  # id, code points, sketch, the next one's sketch, edited text
        held: tuple | None = None  # the row whose next one is not known yet: part, id, text, sketch

        def finish(row: tuple, text: str, s: Sketch) -> None:
            _, key, own, mine = row
            cut = len(own) // 4
            done.append((key, len(own), mine, s, (own[: len(own) - cut] + text[:cut]).encode()))

        def flush() -> pa.RecordBatch:
            keys, sizes, mine, following, edited = zip(*done, strict=True) if done else ((),) * 5
            made = sketches(list(edited))
            columns = [
                pa.array(keys, pa.int64()), pa.array(sizes, pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in edited], pa.string()), pa.array([s.text() for s in mine], pa.string()), pa.array([s.text() for s in made], pa.string()),
                pa.array([s.resemblance(e) for s, e in zip(mine, made, strict=True)], pa.float64()), pa.array([s.resemblance(t) for s, t in zip(mine, following, strict=True)], pa.float64()),
            ]
            done.clear()
            return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

        closed = None  # the part whose halo row has been used
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                some = b.slice(at, 1000)
                raws = [x or b"" for x in some.column(1).cast(pa.binary()).to_pylist()]
                for key, raw, part, halo, s in zip(some.column(0).to_pylist(), raws, some.column(2).to_pylist(), some.column(3).to_pylist(), sketches(raws), strict=True):
                    if halo and closed == part:
                        continue
                    text = raw.decode("utf-8", "replace")
                    if held is not None and held[0] == part:
                        finish(held, text, s)
                        held = None
                    if halo:
                        closed = part
                    else:
                        held = (part, key, text, s)
                yield flush()
        yield flush()

    return sorted_parts.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
