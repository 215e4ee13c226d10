"""Token counts kept as additive totals: signed deltas by source, language and tokenizer version, committed in idempotent batches."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import content, hadoop, publish
from .common import prepare, shared_dir, table
from .tokenizing import encoder

KEY = ("source", "lang", "tokenizer")
DELTA = "source string, lang string, tokenizer string, n_docs long, n_tokens long"


def count_tokens(docs: DataFrame, tokenizer: str, spaced: bool) -> DataFrame:
    """(doc_id, source, lang, tokenizer, n_tokens) of whole texts, without an end id; null text counts 0. A repeated doc_id is counted as often as it occurs, and a delete by id takes all its rows out."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(tokenizer, spaced)
        for b in batches:
            n = [len(x) // 4 for x in coder.encoded([x or "" for x in b.column(3).to_pylist()])]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(n, pa.int64())], ["doc_id", "source", "lang", "n_tokens"])

    counted = docs.select("doc_id", "source", "lang", "text").mapInArrow(run, "doc_id long, source string, lang string, n_tokens long")
    return counted.withColumn("tokenizer", F.lit(tokenizer.split(".")[0]))


def signed(counts: DataFrame, sign: int) -> DataFrame:
    """Counts as inserts (sign 1) or deletes (-1). A revision is the delete of the old count and the insert of the new one."""
    return counts.select(*KEY, F.lit(sign).cast("long").alias("n_docs"), (F.col("n_tokens") * sign).alias("n_tokens"))


class Rollup:
    """Totals in a shared folder: a folder of summed deltas per attempt at a batch, and a small file that names the attempt that counts.

    That file is created only where there is none, so of several writers of one batch, also at once, one counts; the others'
    folders are never read, and neither are those of writers that died. Committing a batch id again changes nothing. After
    many batches the sums so far become a snapshot, published alike, so totals read one snapshot and the batches after it.
    Deltas of one key are summed per task before the shuffle, so a hot source is no hot task. Null sources and languages are
    keys of their own. Keys whose documents and tokens cancel out are left out.
    """

    most = 16  # batches beside a snapshot

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _names(self, kind: str) -> list[str]:
        fs, path = hadoop(self.spark, f"{self.folder}/{kind}")
        if not fs.exists(path):
            return []
        names = [x.getPath().getName() for x in fs.listStatus(path)]
        return sorted(n[:-5] for n in names if n.endswith(".json"))

    def committed(self) -> list[str]:
        return [unquote(n) for n in self._names("_batches")]

    def _snapshot(self) -> tuple[int, dict]:
        """The newest snapshot's number, and its folder and batches."""
        last = self._names("_snapshots")
        return (int(last[-1]), json.loads(content(self.spark, f"{self.folder}/_snapshots/{last[-1]}.json"))) if last else (-1, {"data": None, "batches": []})

    def commit(self, batch: str, *changes: DataFrame) -> bool:
        """Add signed rows as batch `batch`; False if it was committed before."""
        name = quote(batch, safe="")
        if name in self._names("_batches"):
            return False
        rows = changes[0]
        for x in changes[1:]:
            rows = rows.unionByName(x)
        summed = rows.groupBy(*KEY).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        mine = f"data/{uuid.uuid4().hex}"
        summed.where("n_docs != 0 OR n_tokens != 0").write.parquet(f"{self.folder}/{mine}")
        if not publish(self.spark, f"{self.folder}/_batches/{name}.json", json.dumps({"data": mine})):
            return False
        if len(self._names("_batches")) - len(self._snapshot()[1]["batches"]) > self.most:
            self.fold()
        return True

    def fold(self) -> bool:
        """Make a snapshot of all that is committed; False if another was made meanwhile, which is as good."""
        number, _ = self._snapshot()
        names = self._names("_batches")
        mine = f"data/{uuid.uuid4().hex}"
        self._sum(number, names).write.parquet(f"{self.folder}/{mine}")
        return publish(self.spark, f"{self.folder}/_snapshots/{number + 1:012d}.json", json.dumps({"data": mine, "batches": names}))

    def _sum(self, number: int, names: list[str]) -> DataFrame:
        held = json.loads(content(self.spark, f"{self.folder}/_snapshots/{number:012d}.json")) if number >= 0 else {"data": None, "batches": []}
        folded = set(held["batches"])
        folders = [held["data"]] * bool(held["data"]) + [json.loads(content(self.spark, f"{self.folder}/_batches/{n}.json"))["data"] for n in names if n not in folded]
        rows = self.spark.read.schema(DELTA).parquet(*[f"{self.folder}/{f}" for f in folders]) if folders else self.spark.createDataFrame([], DELTA)
        out = rows.groupBy(*KEY).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        return out.where("n_docs != 0 OR n_tokens != 0")

    def totals(self) -> DataFrame:
        """(source, lang, tokenizer, n_docs, n_tokens) of all committed batches; none gives no rows."""
        return self._sum(self._snapshot()[0], self._names("_batches"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals after three batches (texts are counted whole, however long; repeated rows count as often as they occur; null text is empty): all documents come in, those labelled toxic go out, and the others not in English are recounted with a newer tokenizer."""
    docs = table(spark, sf_dir, "documents")
    folder = shared_dir(spark, "token-counts")
    toxic = table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id")
    count_tokens(docs, "byte_bpe_50k.json", True).write.parquet(f"{folder}/old")
    old = spark.read.parquet(f"{folder}/old")
    foreign = "lang != 'en' OR lang IS NULL"
    count_tokens(docs.where(foreign), "word_bpe_49k.json", False).write.parquet(f"{folder}/new")
    new = spark.read.parquet(f"{folder}/new")
    rollup = Rollup(spark, f"{folder}/batches")
    rollup.commit("1-insert", signed(old, 1))
    rollup.commit("2-delete", signed(old.join(toxic, "doc_id", "left_semi"), -1))
    stay = lambda counts: counts.join(toxic, "doc_id", "left_anti")
    for _ in range(2):  # the second commit of the batch changes nothing
        rollup.commit("3-recount", signed(stay(old.where(foreign)), -1), signed(stay(new), 1))
    return rollup.totals()
