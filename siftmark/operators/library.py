"""The rule library and the tag table: seeds, versions, incremental sync, soft deletes, upserts."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RULE = "rule_id string, rule_type string, sensitive_type string, risk_level string, source string, version int, enabled boolean, deleted boolean"


def normal_risk(c):
    low = F.lower(F.trim(c))
    return F.when(low.isin("low", "medium", "high", "critical", "info"), low).otherwise(F.lit("medium"))


def seed(rules: DataFrame, builtin: DataFrame) -> DataFrame:
    """Builtin rules are added where their id is missing; edited ones stay."""
    return rules.unionByName(builtin.join(rules, "rule_id", "left_anti"))


def sync(rules: DataFrame, since: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(live rules, deleted ids, newest version) for a client at version `since`; builtin rules are always sent."""
    seen = rules.where((F.col("source") == "builtin") | (F.col("version") > since))
    gone = ~F.col("enabled") | F.col("deleted")
    newest = rules.agg(F.coalesce(F.max("version"), F.lit(0)).alias("version"))
    return seen.where(~gone), seen.where(gone & (F.col("version") > since)).select("rule_id"), newest


def apply(cache: DataFrame, live: DataFrame, deleted: DataFrame, full: bool) -> DataFrame:
    """A client's cache after a sync."""
    kept = cache.where("false") if full else cache.join(deleted, "rule_id", "left_anti").join(live, "rule_id", "left_anti")
    return kept.unionByName(live)


def update(rules: DataFrame, rule_id: str, version: int, **fields) -> DataFrame:
    """Only the given fields change; enabling a rule also brings it back."""
    mine = F.col("rule_id") == rule_id
    new = {**{k: F.lit(v) for k, v in fields.items()}, "version": F.lit(version)}
    if fields.get("enabled"):
        new["deleted"] = F.lit(False)
    return rules.withColumns({k: F.when(mine, v).otherwise(F.col(k)) for k, v in new.items()})


def change(rules: DataFrame, changes: DataFrame) -> DataFrame:
    """Many updates at once. changes: rule_id, version, and any of the rules' other columns, null where they stay.

    Of several changes of one rule that with the newest version counts. Enabling a rule brings it back, deleting one also
    disables it. Rules that no change names stay; changes of rules that there are not do nothing.
    """
    given = [c for c in changes.columns if c not in ("rule_id", "version")]
    last = changes.groupBy("rule_id").agg(F.max(F.struct("version", *given)).alias("new"))
    both = rules.join(last, "rule_id", "left")
    now = {c: F.coalesce(F.col("new")[c], F.col(c)) if c in ("version", *given) else F.col(c) for c in rules.columns}
    if "deleted" in given:
        now["enabled"] = F.when(F.col("new.deleted"), False).otherwise(now["enabled"])
    if "enabled" in given:
        now["deleted"] = F.when(F.col("new.enabled") & ~F.coalesce(F.col("new.deleted") if "deleted" in given else F.lit(None), F.lit(False)), False).otherwise(now["deleted"])
    return both.select(*[c.alias(n) for n, c in now.items()])


def delete(rules: DataFrame, rule_id: str, version: int) -> DataFrame:
    return update(rules, rule_id, version, enabled=False, deleted=True)


def upsert_tags(tags: DataFrame, new: DataFrame) -> DataFrame:
    """By (file_path, file_hash): the latest row's values, the first detection's time."""
    both = tags.withColumn("_turn", F.lit(0)).unionByName(new.withColumn("_turn", F.lit(1)))
    rest = [c for c in tags.columns if c not in ("file_path", "file_hash", "first_detected_at")]
    latest = F.max_by(F.struct(*rest), F.struct("_turn", "last_detected_at"))
    out = both.groupBy("file_path", "file_hash").agg(F.min("first_detected_at").alias("first_detected_at"), latest.alias("v"))
    return out.select("file_path", "file_hash", "first_detected_at", "v.*").select(*tags.columns)


def list_tags(tags: DataFrame, sensitive_only: bool = False) -> DataFrame:
    """All tags, latest first; or the sensitive ones, by score. Ties by path."""
    return tags.where("sensitive").orderBy(F.desc("match_score"), "file_path") if sensitive_only else tags.orderBy(F.desc("last_detected_at"), "file_path")


def duplicates(samples: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows whose content an earlier row has, with that row's key; a window of hashes only, no texts."""
    w = Window.partitionBy("sha256").orderBy(key)
    ranked = samples.select(key, F.sha2("text", 256).alias("sha256")).where("sha256 IS NOT NULL").select("*", F.row_number().over(w).alias("n"), F.first(key).over(w).alias("first_id"))
    return ranked.where("n > 1").select(key, "sha256", "first_id")
