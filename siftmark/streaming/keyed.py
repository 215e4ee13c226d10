"""Alerts of a stream as keyed state: one state per alert and part of its files, which a timer closes when its window is over."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from datetime import timezone

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import IntegerType, LongType, StructField, StructType, TimestampType

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PARTS = 64  # of an alert's files, so that a busy process is no hot task


class FileParts(StatefulProcessor):
    """Per key: totals in a value, and the files in a map, which the state store keeps on disk.

    The timer stands at the end of the window. When the watermark passes it, the part's row leaves and its state goes.
    """

    def __init__(self, names: list[str], event_id: str, most: int):
        self.row, self.event_id, self.most = Row(*names), event_id, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.total = handle.getValueState("total", f"event_id {self.event_id}, n bigint, k bigint, a timestamp, z timestamp, r int")
        self.files = handle.getMapState("files", "path string, hash string", "seen boolean")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        known = self.total.get() if self.total.exists() else None
        if known is None:
            event_id, n, k, a, z, r = None, 0, 0, None, None, None
        else:
            event_id, n, k, a, z, r = known
        least = lambda x, y: x if y is None else y if x is None else min(x, y)
        most = lambda x, y: x if y is None else y if x is None else max(x, y)
        end = None
        for row in rows:
            event_id, n, a, z, r = least(event_id, row.event_id), n + 1, least(a, row.ts), most(z, row.ts), most(r, row.rank)
            end = row.window_end
            file = (row.file_path, row.file_hash)
            if not self.files.containsKey(file):
                self.files.updateValue(file, (True,))
                k += 1
        if known is None and end is not None:
            self.handle.registerTimer(int(end.astimezone(timezone.utc).timestamp() * 1000))
        self.total.update((event_id, n, k, a, z, r))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        if not self.total.exists():
            return iter(())
        order = lambda f: tuple((x is not None, x or "") for x in f)
        first = heapq.nsmallest(self.most, (tuple(f) for f, _ in self.files.iterator()), key=order)
        out = self.row(*key, *self.total.get(), [{"file_path": p, "file_hash": h} for p, h in first])
        self.total.clear()
        self.files.clear()
        return iter([out])

    def close(self) -> None:
        pass


class Whole(StatefulProcessor):
    """An alert from its parts, which all leave when the same watermark passes their window, so in one batch; nothing is kept."""

    def __init__(self, names: list[str], most: int):
        self.row, self.most = Row(*names), most

    def init(self, handle: StatefulProcessorHandle) -> None:
        pass

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        got = list(rows)  # PARTS at most
        known = lambda name: [x for r in got if (x := getattr(r, name)) is not None]
        order = lambda f: tuple((x is not None, x or "") for x in f)
        files = heapq.nsmallest(self.most, ((f["file_path"], f["file_hash"]) for r in got for f in r.f), key=order)
        of = {"event_id": min, "n": sum, "k": sum, "a": min, "z": max, "r": max}
        yield self.row(*key, *((pick(known(c)) if known(c) else None) for c, pick in of.items()), [{"file_path": p, "file_hash": h} for p, h in files])

    def close(self) -> None:
        pass


def whole(source: DataFrame, keys: list[str], window: str, most: int) -> DataFrame:
    """(window_start, keys, event_id, n, k, a, z, r, f): each alert when its window is over, once.

    The state lives in RocksDB, for which the session's default store is exchanged.
    """
    spark = source.sparkSession
    if not spark.conf.get(PROVIDER, "").endswith("RocksDBStateStoreProvider"):
        spark.conf.set(PROVIDER, ROCKS)
    part = F.pmod(F.xxhash64("file_path", "file_hash"), F.lit(PARTS)).cast("int")
    rows = source.withColumn("w", F.window("ts", window)).withColumns({"window_start": F.col("w.start"), "window_end": F.col("w.end"), "part": part})
    rows = rows.select("window_start", "window_end", *keys, "part", "event_id", "ts", "file_path", "file_hash", F.col("r").alias("rank"))
    kinds = {f.name: f.dataType for f in rows.schema}
    event_id = kinds["event_id"]
    told = [StructField("event_id", event_id), StructField("n", LongType()), StructField("k", LongType()), StructField("a", TimestampType()), StructField("z", TimestampType()), StructField("r", IntegerType()), *StructType.fromDDL("f array<struct<file_path: string, file_hash: string>>")]
    schema = lambda group: StructType([*(StructField(c, kinds[c]) for c in group), *told])
    group = ["window_start", *keys]
    one, all_ = schema([*group, "part"]), schema(group)
    each = rows.groupBy(*group, "part").transformWithState(FileParts(one.names, event_id.simpleString(), most), one, "append", "EventTime")
    return each.groupBy(*group).transformWithState(Whole(all_.names, most), all_, "append", "None")
