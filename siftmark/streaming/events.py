"""The event pipeline: drop repeated and white-listed events, merge alike ones in a time window, lower known false positives, report.

The steps over events are one function for batch and streaming frames. Windows are tumbling, of one minute; late events count
for ten.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import keyed

#: Alike events: the same of these in one window. Those a table lacks don't count.
KEYS = ("user_id", "host_id", "process_name", "file_type", "sensitive_type", "operation")
LATE = "10 minutes"
LEVELS = ("info", "low", "medium", "high", "critical")


def timed(events: DataFrame, late: str = LATE) -> DataFrame:
    """A stream gets a watermark, for which its times need a zone; one that has a watermark keeps it."""
    if not events.isStreaming or "EventTimeWatermark" in events._jdf.queryExecution().logical().toString():
        return events
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def once(events: DataFrame, late: str = LATE) -> DataFrame:
    """One event of each event_id; events without one all stay. A stream remembers ids as long as events may be late."""
    if events.isStreaming:
        return timed(events, late).dropDuplicatesWithinWatermark(["event_id"])
    known = events.where("event_id IS NOT NULL").dropDuplicates(["event_id"])
    return known.unionByName(events.where("event_id IS NULL"))


def file_type(path: Column) -> Column:
    """The suffix of a path's last part, in lower case; empty where it has none."""
    return F.lower(F.regexp_extract(F.regexp_replace(path, r"\\", "/"), r"[^/]\.([^./]+)$", 1))


def merge(events: DataFrame, window: str = "1 minute", late: str = LATE, keys: tuple[str, ...] = ("user_id", "event_type")) -> DataFrame:
    """One alert per keys and window: how many events, their first and last time, and the sum of values."""
    source = timed(events, late)
    out = source.groupBy(F.window("ts", window).alias("w"), *keys).agg(F.count("*").alias("n_events"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.sum("value").alias("total"))
    return out.select(*keys, F.col("w.start").alias("window_start"), "n_events", "first_ts", "last_ts", "total")


def alerts(events: DataFrame, window: str = "1 minute", late: str = LATE, most_files: int | None = None) -> DataFrame:
    """One alert per user, host, process, file type, sensitive type, operation and window, with its files.

    events: event_id, ts, risk_level, file_path, file_hash and those of KEYS that there are. An alert bears its least event
    id, whether it stands for several, the number of its files and the files by path (all, or the first most_files), the
    highest risk, and the time range. Files are cut to one row each and dealt over parts before they meet, so that a busy
    process is no hot task. A stream keeps them as state until a window's watermark has passed, and then gives its alerts (append).
    """
    source = timed(events.withColumn("file_type", file_type(F.col("file_path"))), late)
    keys = [k for k in KEYS if k in source.columns]
    most = most_files or (1 << 31) - 1
    some = lambda c: F.slice(F.array_sort(c), 1, most)
    source = source.withColumn("r", F.array_position(F.array(*map(F.lit, LEVELS)), F.col("risk_level")).cast("int"))
    sums = lambda k: [F.min("event_id").alias("event_id"), F.sum("n").alias("n"), k.alias("k"), F.min("a").alias("a"), F.max("z").alias("z"), F.max("r").alias("r")]
    if events.isStreaming:
        out = keyed.whole(source, keys, window, most).withColumn("w", F.struct(F.col("window_start").alias("start")))
    else:
        files = source.groupBy(F.window("ts", window).alias("w"), *keys, "file_path", "file_hash").agg(F.min("event_id").alias("event_id"), F.count("*").alias("n"), F.min("ts").alias("a"), F.max("ts").alias("z"), F.max("r").alias("r"))
        spread = files.withColumn("part", F.pmod(F.xxhash64("file_path", "file_hash"), F.lit(keyed.PARTS)))
        first = spread.groupBy("w", *keys, "part").agg(*sums(F.count("*")), some(F.collect_list(F.struct("file_path", "file_hash"))).alias("f"))
        out = first.groupBy("w", *keys).agg(*sums(F.sum("k")), some(F.flatten(F.collect_list("f"))).alias("f"))
    level = F.get(F.array(*map(F.lit, LEVELS)), F.greatest(F.lit(1), F.col("r")).cast("int") - 1)
    return out.select("event_id", *keys, F.col("w.start").alias("window_start"), (F.col("n") > 1).alias("is_merge_event"), F.col("n").alias("n_events"), F.col("k").alias("file_count"), F.col("f").alias("files"), F.col("a").alias("first_ts"), F.col("z").alias("last_ts"), level.alias("risk_level"))


def allow(events: DataFrame, white_list: DataFrame, on: list[str]) -> DataFrame:
    """Events that no row of the white list equals in the columns `on`."""
    return events.join(white_list, on, "left_anti")


def allow_hours(events: DataFrame, white_list: DataFrame) -> DataFrame:
    """Drops events that a row of the white list (user_id, from_hour, to_hour) covers: of that user, or of all where it is null, from one hour of the day up to another, also past midnight.

    A row becomes one for each hour, so that hours are joined as equals.
    """
    span = F.pmod(F.col("to_hour") - F.col("from_hour"), F.lit(24))
    hours = F.when(span > 0, F.transform(F.sequence(F.lit(0), span - 1), lambda i: F.pmod(F.col("from_hour") + i, F.lit(24)))).when(F.col("from_hour") > F.col("to_hour"), F.sequence(F.lit(0), F.lit(23)))
    rows = white_list.select("user_id", F.explode(hours).alias("_hour")).distinct()
    e = events.withColumn("_hour", F.hour("ts"))
    e = e.join(rows.where("user_id IS NULL").select("_hour"), "_hour", "left_anti")
    return e.join(rows.where("user_id IS NOT NULL"), ["user_id", "_hour"], "left_anti").select(*events.columns)


def slashes(path: Column) -> Column:
    """A path with forward slashes only, without one at its end."""
    return F.regexp_replace(F.regexp_replace(path, r"\\", "/"), "(?<=.)/+$", "")


def ancestors(path: Column) -> Column:
    """A path and all folders above it."""
    names = F.split(slashes(path), "/")
    above = F.transform(F.sequence(F.lit(1), F.size(names)), lambda n: F.array_join(F.slice(names, F.lit(1), n), "/"))
    return F.transform(above, lambda p: F.when(p == "", "/").otherwise(p))


def allow_paths(events: DataFrame, white_list: DataFrame, path: str = "file_path") -> DataFrame:
    """Drops events whose file is, or lies below, a `prefix` of the white list; either kind of slash. Case counts, and prefixes are whole names.

    The distinct paths, each with all folders above it, are joined to prefixes as equals; events meet the paths found. Null
    paths and prefixes never match.
    """
    given = white_list.where("prefix IS NOT NULL").select(slashes(F.col("prefix")).alias("_folder")).distinct()
    paths = events.where(F.col(path).isNotNull()).select(path).distinct()
    listed = paths.withColumn("_folder", F.explode(ancestors(F.col(path)))).join(given, "_folder", "left_semi").select(path).distinct()
    return events.join(listed, path, "left_anti").select(*events.columns)


def allow_times(events: DataFrame, white_list: DataFrame, salts: int = 8) -> DataFrame:
    """Drops events in a range of time (from_ts up to, not with, to_ts) of a white list's row, of its user or of all where user_id is null.

    An interval join by buckets: a row becomes one for each day that it touches, a day's events are joined to these as equals,
    and the range is compared behind that. A day's events are dealt over salts. Ranges without a bound or without length cover nothing.
    """
    day = lambda c: F.floor(F.unix_seconds(F.col(c).cast("timestamp")) / 86_400)
    rows = white_list.where("from_ts < to_ts").withColumn("_day", F.explode(F.sequence(day("from_ts"), day("to_ts")))).withColumn("_salt", F.explode(F.array(*map(F.lit, range(salts)))))
    rows = rows.select(F.col("user_id").alias("_user"), "_day", "_salt", "from_ts", "to_ts")
    e = events.withColumn("_day", day("ts")).withColumn("_salt", F.pmod(F.xxhash64("event_id", "ts"), F.lit(salts)).cast("int"))
    for w, own in ((rows.where("_user IS NULL"), F.lit(True)), (rows.where("_user IS NOT NULL"), e["user_id"] == F.col("_user"))):
        e = e.join(w, own & (e["_day"] == w["_day"]) & (e["_salt"] == w["_salt"]) & (e["ts"] >= w["from_ts"]) & (e["ts"] < w["to_ts"]), "left_anti")
    return e.select(*events.columns)


def lower_false_positives(alerts: DataFrame, known: DataFrame, on: list[str]) -> DataFrame:
    """known: the columns `on` and a reason. A known alert becomes `info` and keeps its old level and the first reason; others stay as they are, each once."""
    first = known.groupBy(*on).agg(F.min("reason").alias("reason"), F.lit(True).alias("_known"))
    out = alerts.join(first, on, "left")
    return out.withColumn("old_level", F.when(F.col("_known"), F.col("level"))).withColumn("level", F.when(F.col("_known"), "info").otherwise(F.col("level"))).drop("_known")


def top_users(events: DataFrame, kind: str, n: int) -> DataFrame:
    return events.where(F.col("event_type") == kind).groupBy("user_id").agg(F.count("*").alias("n_events")).orderBy(F.desc("n_events"), "user_id").limit(n)


def trend(events: DataFrame) -> DataFrame:
    """Per day and type, the number of events and its share of the day."""
    daily = events.groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.count("*").alias("n_events"))
    days = daily.groupBy("day").agg(F.sum("n_events").alias("of_day"))
    return daily.join(days, "day").select("day", "event_type", "n_events", F.round(F.col("n_events") / F.col("of_day"), 6).alias("share"))


def ranking(events: DataFrame, by: str) -> DataFrame:
    """(by, n_events, place): most events first; equal numbers share a place.

    A place is one more than the groups with a larger number: numbers are summed up before they are put in order, and N events
    have fewer than sqrt(2 N) different numbers of events.
    """
    counted = events.groupBy(by).agg(F.count("*").alias("n_events"))
    above = Window.orderBy(F.desc("n_events")).rowsBetween(Window.unboundedPreceding, -1)
    places = counted.groupBy("n_events").agg(F.count("*").alias("_n")).select("n_events", (F.coalesce(F.sum("_n").over(above), F.lit(0)) + 1).cast("int").alias("place"))
    return counted.join(places, "n_events").select(by, "n_events", "place")


def reports(events: DataFrame, groups: DataFrame, on: str = "user_id", group: str = "department") -> DataFrame:
    """Day, week and month reports, of all and by group, with one row also for each event type and each whole period.

    (period, start, group, event_type, n_events, n_users, total): group and event_type are null where a row sums over all, and
    `of_group`, `of_type` tell such rows from members without a group. One aggregation over grouping sets.
    """
    e = events.join(groups.select(on, group), on, "left")
    at = {p: F.to_date(F.date_trunc(p, "ts")) for p in ("day", "week", "month")}
    e = e.select(on, group, "event_type", "value", *[c.alias(p) for p, c in at.items()])
    sets = [[p, *more] for p in at for more in ([], [group], ["event_type"], [group, "event_type"])]
    n_users = F.count_distinct(F.col(on))
    made = e.groupingSets([[F.col(c) for c in s] for s in sets], *at, group, "event_type").agg(*[F.grouping(c).alias(f"_{c}") for c in (*at, group, "event_type")], F.count("*").alias("n_events"), n_users.alias("n_users"), F.sum("value").alias("total"))
    period = F.when(F.col("_day") == 0, "day").when(F.col("_week") == 0, "week").otherwise("month")
    return made.select(period.alias("period"), F.coalesce("day", "week", "month").alias("start"), group, "event_type", (F.col(f"_{group}") == 0).alias("of_group"), (F.col("_event_type") == 0).alias("of_type"), "n_events", "n_users", "total")


def risk_sessions(events: DataFrame, gap: str = "30 minutes", least: int = 3, kinds: tuple[str, ...] | None = None, late: str = LATE) -> DataFrame:
    """Users' sessions of at least `least` events (of some kinds, if given) that follow each other within `gap`; also of streams."""
    e = timed(events if kinds is None else events.where(F.col("event_type").isin(*kinds)), late)
    s = e.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n_events"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.max("value").alias("highest"))
    return s.where(F.col("n_events") >= least).select("user_id", "first_ts", "last_ts", "n_events", "highest")


def compare(events: DataFrame, groups: DataFrame, on: str, group: str) -> DataFrame:
    """(group, event_type, n_events, n_members, per_member): events of each group's members by type; members without a group count as null."""
    members = groups.groupBy(group).agg(F.count_distinct(on).alias("n_members"))
    counted = events.groupBy(on, "event_type").agg(F.count("*").alias("n")).join(groups, on, "left").groupBy(group, "event_type").agg(F.sum("n").alias("n_events"))
    return counted.join(members, group, "left").select(group, "event_type", "n_events", "n_members", F.round(F.col("n_events") / F.col("n_members"), 6).alias("per_member"))
