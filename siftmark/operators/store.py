"""The server's store: versioned Parquet tables under one folder, published by a manifest.

Every operation works on the snapshot of one manifest. A commit writes new folders and then the manifest that follows its
snapshot, by creating a file that must not exist: where another commit was first it fails, and nothing of it is seen. Readers
see whole commits only. A lost executor's task writes again, and an unpublished folder is never read. A table of many folders
is rewritten as one by the commit that finds it so.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import hashing
from ..functions.fixed import BUILTIN_RULES, LABEL_HINTS
from ..sources import extract
from ..sources.files import content, publish
from . import generate, library, search

SCHEMAS = {
    "samples": "sensitive_file_id string, file_name string, sha256 string, file_size long, sensitive_type string, risk_level string, description string, text string, uploaded_at timestamp, version int",
    "rules": library.RULE + ", rule_ord int, content string",
    "fingerprints": "sensitive_file_id string, sha256 string, simhash string, text_length int, version int",
    "features": "sensitive_file_id string, semantic_labels array<string>, embedding_id string, embedding array<double>, model_name string, version int",
    "reports": "report_id string, host_id string, scan_path string, scanned_at string, result_count long, created_at timestamp",
    "results": "id string, report_id string, file_path string, file_hash string, sensitive boolean, sensitive_type string, risk_level string, sensitive_file_id string, match_score int, confidence_level string, match_detail string",
    "tags": "file_path string, file_hash string, sensitive boolean, sensitive_type string, risk_level string, sensitive_file_id string, match_score int, confidence_level string, match_detail string, first_detected_at timestamp, last_detected_at timestamp",
}
CONFIG = {"simhash_threshold": 3, "semantic_label_hints": {k: list(v) for k, v in LABEL_HINTS.items()}}
MOST_RESULTS = 10_000
MOST_FOLDERS = 32  # of a table, before it is rewritten as one
BATCH_FILES, BATCH_BYTES = 50, 200 << 20  # of an upload of several files


class Conflict(RuntimeError):
    """Another commit came between this one's snapshot and its end."""


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        snap = self.manifest()
        missing = library.seed(self.table("rules", snap), self._builtin()).join(self.table("rules", snap).select("rule_id"), "rule_id", "left_anti")
        if snap["commit"] < 0 or not missing.isEmpty():
            try:
                self.commit(snap, {}, "seed", append={"rules": missing})
            except Conflict:  # another has just opened the store and seeded it
                pass

    def _builtin(self) -> DataFrame:
        rows = [(f"builtin_{n}", "regex", n, r, "builtin", 0, True, False, i, json.dumps({"name": n, "pattern": p}, ensure_ascii=False)) for i, (n, p, r) in enumerate(BUILTIN_RULES)]
        return self.spark.createDataFrame(rows, SCHEMAS["rules"])

    def _last(self) -> int | None:
        folder = self._path(f"{self.root}/_manifests")
        if not self.fs.exists(folder):
            return None
        names = [s.getPath().getName() for s in self.fs.listStatus(folder)]
        return max((int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()), default=None)

    def manifest(self) -> dict:
        last = self._last()
        if last is None:
            return {"commit": -1, "version": 0, "kind": "none", "tables": {}, "config": dict(CONFIG)}
        return json.loads(content(self.spark, self._manifest(last)))

    def _manifest(self, commit: int) -> str:
        return f"{self.root}/_manifests/{commit:012d}.json"

    def table(self, name: str, snap: dict | None = None) -> DataFrame:
        folders = (snap or self.manifest())["tables"].get(name, [])
        reader = self.spark.read.schema(SCHEMAS[name])
        return reader.parquet(*[f"{self.root}/{f}" for f in folders]) if folders else self.spark.createDataFrame([], SCHEMAS[name])

    def version(self) -> int:
        return self.manifest()["version"]

    def config(self) -> dict:
        """simhash_threshold and semantic_label_hints, as sent to hosts."""
        return self.manifest()["config"]

    def set_config(self, **changes) -> None:
        snap = self.manifest()
        self.commit(snap, {}, "config", config=snap["config"] | changes)

    def _write(self, name: str, df: DataFrame) -> str:
        folder = f"{name}/{uuid.uuid4().hex}"
        schema = self.spark.createDataFrame([], SCHEMAS[name]).schema
        df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema]).write.parquet(f"{self.root}/{folder}")
        return folder

    def commit(self, snap: dict, replace: dict[str, DataFrame], kind: str, append: dict[str, DataFrame] | None = None, library_version: int | None = None, config: dict | None = None) -> int:
        """All tables or none, on top of the snapshot that they were made from; returns the library's version, which is the given one or stays."""
        tables = {k: list(v) for k, v in snap["tables"].items()}
        for name, df in replace.items():
            tables[name] = [self._write(name, df)]
        for name, df in (append or {}).items():
            tables[name] = [*tables.get(name, []), self._write(name, df)]
        for name, folders in tables.items():
            if len(folders) > MOST_FOLDERS:
                tables[name] = [self._write(name, self.table(name, {"tables": tables}))]
        version = snap["version"] if library_version is None else library_version
        new = {"commit": snap["commit"] + 1, "version": version, "kind": kind, "tables": tables, "config": config or snap["config"]}
        if not publish(self.spark, self._manifest(new["commit"]), json.dumps(new, ensure_ascii=False)):
            raise Conflict(f"commit {new['commit']}")
        return version

    # samples

    def ingest(self, samples: DataFrame, kind: str = "upload", dialect: str = "re2", pdf=None, embed: Callable[[list[str]], list[list[float] | None]] | None = None, model: str = "", ask: Callable[[str], str | None] | None = None) -> tuple[int | None, DataFrame]:
        """samples (file_name, content, sensitive_type, risk_level, description) under one new version; (version, duplicates or rejects).

        A row that may not be uploaded, or equals an earlier one or a stored sample, rejects the whole: the version is null
        and the rows say why. embed gives the vectors of some texts, for the search by meaning; ask answers a prompt for the
        labels. Where they are not given, fail or answer null, a sample has no vector, or labels by rules.
        """
        snap = self.manifest()
        named = samples.withColumn("sha256", F.sha2("content", 256)).withColumn("file_size", F.length("content").cast("long"))
        stored = self.table("samples", snap).groupBy("sha256").agg(F.min_by(F.struct("sensitive_file_id", "file_name"), "sensitive_file_id").alias("old"))
        w = Window.partitionBy("sha256").orderBy("file_name")
        names = named.select("file_name", "sha256", "file_size", F.row_number().over(w).alias("n"), F.first("file_name").over(w).alias("first_name")).join(stored, "sha256", "left")
        bad = extract.upload_error(F.col("file_name"), F.col("file_size"))
        reason = F.coalesce(bad, F.when(F.col("n") > 1, "request_duplicate").when(F.col("old").isNotNull(), "existing_sample"))
        rejects = names.select("file_name", "sha256", reason.alias("reason"), F.coalesce(F.when(F.col("n") > 1, F.col("first_name")), F.col("old.file_name")).alias("existing_name"), F.when(F.col("n") == 1, F.col("old.sensitive_file_id")).alias("sensitive_file_id")).where("reason IS NOT NULL")
        if not rejects.isEmpty():
            return None, rejects
        version = snap["version"] + 1
        read = extract.sample_texts(named.withColumn("sensitive_file_id", F.concat(F.lit("file_"), F.substring("sha256", 1, 32))), pdf)
        text = generate.placeholder(F.col("text"), F.col("file_name"), F.col("file_size"))
        ready = read.withColumns({"text": text, "risk_level": library.normal_risk(F.coalesce("risk_level", F.lit(""))), "version": F.lit(version), "uploaded_at": F.current_timestamp()})
        # read once: the tables below all come from these rows
        staged = f"{self.root}/_staged/{uuid.uuid4().hex}"
        ready.drop("content").write.parquet(staged)
        ready = self.spark.read.parquet(staged)
        made = generate.rules(ready, "sensitive_file_id", dialect=dialect)
        rules = made.select(
            F.concat(F.lit("rule_"), F.substring(F.sha2(F.concat_ws("/", "sensitive_file_id", F.col("place").cast("string")), 256), 1, 32)).alias("rule_id"), "rule_type", "sensitive_type", "risk_level",
            F.lit("sample").alias("source"), F.lit(version).alias("version"), F.lit(True).alias("enabled"), F.lit(False).alias("deleted"), F.col("place").alias("rule_ord"), "content",
        )
        prints = ready.select("sensitive_file_id", "sha256", hashing.simhash("text").alias("simhash"), F.octet_length("text").alias("text_length"), "version")
        self.commit(snap, {}, kind, {"samples": ready, "rules": rules, "fingerprints": prints, "features": features(ready, embed, model, ask)}, version)
        self.fs.delete(self._path(staged), True)
        return version, rejects

    def ingest_batch(self, samples: DataFrame, **options) -> tuple[int | None, DataFrame]:
        """ingest() of 50 files and 200 MiB at most."""
        n, size = samples.agg(F.count("*"), F.coalesce(F.sum(F.length("content")), F.lit(0))).first()
        if not 1 <= n <= BATCH_FILES or size > BATCH_BYTES:
            raise ValueError(f"a batch has 1 to {BATCH_FILES} files and {BATCH_BYTES} bytes at most, not {n} and {size}")
        return self.ingest(samples, "batch_upload", **options)

    def ingest_zip(self, data: bytes, sensitive_type: str = "", risk_level: str = "", description: str = "") -> tuple[int | None, DataFrame]:
        """The members of one archive, of 100 MiB at most, as a batch."""
        rows = [(n, x, sensitive_type, risk_level, description) for n, x in extract.strict_members(data).items()]
        return self.ingest(self.spark.createDataFrame(rows, "file_name string, content binary, sensitive_type string, risk_level string, description string"), "zip_upload")

    def list_samples(self) -> DataFrame:
        return search.find_samples(self.table("samples"), limit=50)

    def find_samples(self, text: str | None = None, kind: str | None = None, risk: str | None = None) -> DataFrame:
        return search.find_samples(self.table("samples"), text, kind, risk)

    def lookup_hash(self, sha256: str) -> DataFrame:
        return search.lookup_hash(self.table("samples"), sha256, "sensitive_file_id")

    def query_file(self, file_hash: str = "", file_name: str = "", file_path: str = "") -> DataFrame:
        return search.query_file(self.table("samples"), "sensitive_file_id", file_hash, file_name, file_path)

    def semantic_search(self, query: list[float], top: int = 5, min_score: float = 0.0) -> DataFrame:
        snap = self.manifest()
        return search.feature_search(self.table("features", snap), self.table("samples", snap), query, top, min_score)

    # rules

    def update_rule(self, rule_id: str, content: dict | None = None, **fields) -> int:
        snap = self.manifest()
        rules = self.table("rules", snap)
        if rules.where(F.col("rule_id") == rule_id).isEmpty():
            raise KeyError(rule_id)
        if content is not None:
            fields["content"] = json.dumps(content, ensure_ascii=False)
        version = snap["version"] + 1
        return self.commit(snap, {"rules": library.update(rules, rule_id, version, **fields)}, "rule_delete" if fields.get("deleted") else "rule_update", library_version=version)

    def delete_rule(self, rule_id: str) -> int:
        return self.update_rule(rule_id, enabled=False, deleted=True)

    def sync(self, since: int = 0) -> dict:
        """What a host at version `since` needs: live rules, deleted ids, fingerprints, features, the config, the newest version."""
        snap = self.manifest()
        live, deleted, _ = library.sync(self.table("rules", snap), since)
        newer = lambda name: self.table(name, snap) if since == 0 else self.table(name, snap).where(F.col("version") > since)
        return {"version": snap["version"], "full_sync": since == 0, "rules": live, "deleted": deleted, "fingerprints": newer("fingerprints"), "features": newer("features"), "config": snap["config"]}

    def sync_batch(self, requests: list[tuple[int, str]]) -> list[dict]:
        """One answer for each (version, type); the type comes back and filters nothing."""
        return [{k: v for k, v in (self.sync(since) | {"sensitive_type": kind}).items() if k != "full_sync"} for since, kind in requests]

    # results

    def report(self, results: DataFrame, host_id: str, scan_path: str, scanned_at: str) -> str:
        """Stores a scan's results in one commit; a blank confidence is `unknown`, other nulls are empty."""
        if not host_id.strip():
            raise ValueError("host_id is empty")
        snap, n = self.manifest(), results.count()
        if n > MOST_RESULTS:
            raise ValueError(f"over {MOST_RESULTS} results")
        report_id = f"scan_{uuid.uuid4().hex}"
        blank = [c for c in ("file_path", "sensitive_type", "risk_level", "sensitive_file_id") if c in results.columns]
        rows = results.withColumns({c: F.coalesce(c, F.lit("")) for c in blank}).withColumns({"report_id": F.lit(report_id), "confidence_level": known(F.col("confidence_level")), "id": F.sha2(F.concat_ws("/", F.lit(report_id), "file_path", "file_hash"), 256)})
        head = self.spark.range(1).select(F.lit(report_id).alias("report_id"), F.lit(host_id).alias("host_id"), F.lit(scan_path).alias("scan_path"), F.lit(scanned_at).alias("scanned_at"), F.lit(n).alias("result_count"), F.current_timestamp().alias("created_at"))
        self.commit(snap, {}, "report", {"results": rows, "reports": head})
        return report_id

    def list_results(self, host: str | None = None, level: str | None = None, sensitive: bool = False, limit: int = 200) -> DataFrame:
        snap = self.manifest()
        rows = self.table("results", snap)
        return search.list_results(rows.where("sensitive") if sensitive else rows, self.table("reports", snap), host, level, limit)

    # tags of a scanning host

    def tag(self, results: DataFrame) -> None:
        snap, now = self.manifest(), F.current_timestamp()
        self.commit(snap, {"tags": library.upsert_tags(self.table("tags", snap), results.withColumns({"first_detected_at": now, "last_detected_at": now}))}, "tags")

    def list_tags(self, sensitive_only: bool = False) -> DataFrame:
        return library.list_tags(self.table("tags"), sensitive_only)

    def clear_tags(self) -> None:
        snap = self.manifest()
        self.commit(snap, {"tags": self.table("tags", snap).where("false")}, "tags")


def features(samples: DataFrame, embed=None, model: str = "", ask=None) -> DataFrame:
    """(sensitive_file_id, semantic_labels, embedding_id, embedding, model_name, version) of samples; see Store.ingest()."""
    told = generate.analyse(F.col("text"), F.col("sensitive_type"), F.col("risk_level"))
    rows = samples.select("sensitive_file_id", "version", "text", "sensitive_type", "risk_level", told.alias("a"), F.substring("text", 1, 4000).alias("_sent"), generate.prompt(F.col("text"), F.col("sensitive_type"), F.col("risk_level")).alias("_prompt"))
    rows = rows.withColumns({"_vector": F.lit(None).cast("array<double>"), "_reply": F.lit(None).cast("string")})
    if embed or ask:
        names = rows.columns
        place = {n: i for i, n in enumerate(names)}

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                sent, prompts = b.column(place["_sent"]).to_pylist(), b.column(place["_prompt"]).to_pylist()
                vectors, replies = [None] * len(sent), [None] * len(prompts)
                if embed:
                    try:
                        vectors = [None if v is None else [float(x) for x in v] for v in embed([x or "" for x in sent])]
                    except Exception:  # noqa: BLE001  a service that fails leaves samples without vectors
                        vectors = [None] * len(sent)
                for i, p in enumerate(prompts if ask else []):
                    try:
                        replies[i] = ask(p)
                    except Exception:  # noqa: BLE001  a service that fails leaves the rules' labels
                        replies[i] = None
                columns = b.columns
                columns[place["_vector"]], columns[place["_reply"]] = pa.array(vectors, pa.list_(pa.float64())), pa.array(replies, pa.string())
                yield pa.RecordBatch.from_arrays(columns, names)

        rows = rows.mapInArrow(run, rows.schema)
    reply = generate.parse_reply(F.col("_reply"), F.col("sensitive_type"), F.col("risk_level"))
    rows = rows.withColumn("r", reply)
    has = F.coalesce(F.size("_vector") > 0, F.lit(False))
    return rows.select(
        "sensitive_file_id", F.coalesce("r.semantic_labels", "a.semantic_labels").alias("semantic_labels"), F.when(has, generate.embedding_id(F.lit(model), F.col("text"))).otherwise("").alias("embedding_id"),
        F.when(has, F.col("_vector")).alias("embedding"), F.when(F.col("r").isNotNull(), F.lit(model)).otherwise(F.col("a.model_name")).alias("model_name"), "version",
    )


def known(level: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(level), F.lit("")), F.lit("unknown"))
