"""Sharding: the minimax contiguous partition of ordered groups, by a binary search of the smallest capacity that suffices.

Groups lie in one order and are never split. A capacity is feasible if filling shard after shard, each with as many groups as
it holds, uses up no more than the shards there are. The driver never sees all groups: it sees the sums of blocks of groups,
between which a check gives a lower and an upper bound of each cut, and asks for finer sums only of the blocks that a cut
may fall into, until every cut lies between two groups. Each refinement is one aggregation over those blocks.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Callable
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import column_place, partitions, shared_dir, table

PARTS = 256  # of a block that is looked into


@dataclass(frozen=True)
class Block:
    """Consecutive groups: where they are (a stored block and the number of the first there), how many, their size."""

    home: int
    first: int
    groups: int
    size: int


class Line:
    """Blocks in order. Places are sums of sizes; a place inside a block of several groups is known within bounds only."""

    def __init__(self, blocks: list[Block]):
        self.blocks = blocks
        self.edge = [0, *accumulate(b.size for b in blocks)]
        self.total = self.edge[-1]

    def inside(self, x: int) -> int | None:
        """The block that has x strictly inside."""
        i = bisect_right(self.edge, x) - 1
        return i if i < len(self.blocks) and self.edge[i] < x else None

    def floor(self, x: int, low: bool) -> int:
        """A bound of the last place between groups that is at most x."""
        if x >= self.total:
            return self.total
        i = self.inside(x)
        return x if i is None or (not low and self.blocks[i].groups > 1) else self.edge[i]

    def ceil(self, x: int, low: bool) -> int:
        """A bound of the first place between groups that is at least x."""
        if x <= 0:
            return 0
        i = self.inside(x)
        return x if i is None or (low and self.blocks[i].groups > 1) else self.edge[i + 1]

    def filled(self, capacity: int, shards: int, low: bool) -> list[int]:
        """Where shards filled one after another end; low: at least, else at most."""
        out, at = [], 0
        for _ in range(shards):
            at = self.floor(at + capacity, low)
            out.append(at)
        return out

    def least(self, shards: int, low: bool) -> int:
        """The smallest capacity for which filling shards may reach the end (low: surely does)."""
        lo, hi = -(-self.total // shards), self.total
        while lo < hi:
            mid = (lo + hi) // 2
            if self.filled(mid, shards, low)[-1] >= self.total:
                hi = mid
            else:
                lo = mid + 1
        return lo

    def within(self, low: int, high: int) -> set[int]:
        """Blocks of several groups that have places between two bounds inside."""
        first = max(0, bisect_right(self.edge, low) - 1)
        return {i for i in range(first, min(bisect_left(self.edge, high), len(self.blocks))) if self.blocks[i].groups > 1 and self.edge[i] < high and self.edge[i + 1] > low}

    def balanced(self, capacity: int, shards: int) -> tuple[list[int], set[int]]:
        """Cuts that keep every shard within the capacity, each the nearest such to an even share of what is left, and no shard without a group before the end; blocks to look into."""
        early = [[self.total], [self.total]]  # from the right: before these, the shards behind would not suffice
        for bound, low in zip(early, (True, False), strict=True):
            for _ in range(shards - 1):
                bound.append(self.ceil(bound[-1] - capacity, low))
            bound.reverse()
        cuts, open_, at = [], set(), (0, 0)
        for k in range(shards - 1):
            share = [a + (self.total - a) // (shards - k) for a in at]
            least, most = (early[0][k], early[1][k]), (self.floor(at[0] + capacity, True), self.floor(at[1] + capacity, False))
            near = (self.floor(share[0], True), self.ceil(share[1], False))
            if at[0] == at[1] and near[0] == self.floor(share[0], False) and near[1] == self.ceil(share[0], True):
                near = (near[0],) * 2 if at[0] < near[0] and share[0] - near[0] <= near[1] - share[0] else (near[1],) * 2
            at = tuple(min(max(x, a), z) for x, a, z in zip(near, least, most, strict=True))
            if at[0] != at[1]:
                for a, z in (near, least, most):
                    open_ |= self.within(a, z)
            cuts.append(at[0])
        return cuts, open_


def cut(blocks: list[Block], shards: int, refine: Callable[[list[Block]], list[list[Block]]]) -> tuple[int, list[int], Line]:
    """The smallest feasible capacity, the places of the cuts, and the blocks as far as they were looked into."""
    line = Line(blocks)
    while True:
        low, high = line.least(shards, False), line.least(shards, True)
        if low == high:
            cuts, open_ = line.balanced(low, shards)
            if not open_:
                return low, cuts, line
        else:
            open_ = set()
            for a, z in zip(line.filled(low, shards, True), line.filled(high, shards, False), strict=True):
                open_ |= line.within(a, z)
        finer = dict(zip(sorted(open_), refine([line.blocks[i] for i in sorted(open_)]), strict=True))
        line = Line([x for i, b in enumerate(line.blocks) for x in finer.get(i, [b])])


def sharded(df: DataFrame, shards: int = 8, group: str = "group", size: str = "size", order: str = "doc_id") -> DataFrame:
    """df with `shard` (int) and `slot` (long): rows of one group share a shard, and the largest shard is as small as it can be.

    group: a column whose equal values (null among them) stay together; size: what a row weighs (null or negative: nothing);
    order: groups lie in the order of their least value, null first, ties by the group. Of the cuts that keep to the smallest
    capacity, each is the nearest to an even share of what is left, so that one large group does not leave later shards empty.
    The last shards can be empty if a few groups hold most of the size. slot numbers a shard's rows from 0 in the order of `order`, then group;
    repeated rows get different slots. Columns shard and slot of df are replaced, others keep their names. An empty table
    gives no rows. Rows are written twice to the shared folder; the driver holds sums of blocks.
    """
    spark, n = df.sparkSession, partitions(df.sparkSession)
    folder, df = shared_dir(spark, "sharding"), df.drop("shard", "slot")
    names = [f"_{i}" for i in range(len(df.columns))]
    g, s, o = (names[column_place(df, c)] for c in (group, size, order))
    df.toDF(*names).withColumn("row", F.monotonically_increasing_id()).write.parquet(f"{folder}/rows")
    rows = spark.read.parquet(f"{folder}/rows")
    groups = rows.groupBy(F.col(g).alias("g")).agg(F.min(o).alias("first"), F.sum(F.greatest(F.coalesce(F.col(s), F.lit(0)), F.lit(0)).cast("long")).alias("size"), F.count("*").alias("n"))
    line = Window.partitionBy("home").orderBy("first", "g")
    ranged = groups.repartitionByRange(n, "first", "g").withColumn("home", F.spark_partition_id())
    ranged.select("*", F.row_number().over(line).alias("place"), F.sum("size").over(line).alias("run")).write.parquet(f"{folder}/groups")
    groups = spark.read.parquet(f"{folder}/groups")

    def refine(blocks: list[Block]) -> list[list[Block]]:
        values = ", ".join(f"({i}, {b.home}, {b.first}L, {b.groups}L)" for i, b in enumerate(blocks))
        asked = spark.sql(f"SELECT * FROM VALUES {values} AS t(block, home, low, count)")
        inside = groups.where(F.col("home").isin([b.home for b in blocks])).join(F.broadcast(asked), "home").where("place >= low AND place < low + count")
        found = inside.groupBy("block", "home", F.expr(f"(place - low) * {PARTS} div count").alias("part")).agg(F.min("place").alias("place"), F.count("*").alias("n"), F.sum("size").alias("size")).collect()
        out: list[list[Block]] = [[] for _ in blocks]
        for r in sorted(found, key=lambda r: (r["block"], r["place"])):
            out[r["block"]].append(Block(r["home"], r["place"], r["n"], r["size"]))
        return out

    whole = [Block(r["home"], 1, r["n"], r["size"]) for r in groups.groupBy("home").agg(F.count("*").alias("n"), F.sum("size").alias("size")).orderBy("home").collect()]
    _, cuts, _ = cut(whole, shards, refine)
    edge = [0, *accumulate(b.size for b in whole)]
    number = F.lit(0)
    for c in cuts:  # a group is behind a cut if what lies before it reaches the cut
        i = max(0, min(bisect_right(edge, c) - 1, len(whole) - 1))
        home, left = (whole[i].home, c - edge[i]) if whole else (0, 0)
        number = number + F.when((F.col("home") > home) | ((F.col("home") == home) & (F.col("run") - F.col("size") >= left)), 1).otherwise(0)
    placed = groups.select("g", "n", number.cast("int").alias("shard"))
    total = groups.agg(F.sum("n")).first()[0] or 0
    frequent = F.col("n") > max(16, total // (4 * n))  # of fewer than 4 n groups
    hot = F.broadcast(placed.where(frequent).drop("n"))
    same = F.col(g).eqNullSafe(F.col("g"))
    rest = rows.join(hot.select("g"), same, "left_anti").join(placed.where(~frequent).drop("n"), same)
    dealt = rows.join(hot, same).unionByName(rest).drop("g").repartitionByRange(n, o, g, "row").withColumn("home", F.spark_partition_id())
    dealt.write.parquet(f"{folder}/dealt")
    dealt = spark.read.parquet(f"{folder}/dealt")
    before = dealt.groupBy("shard", "home").count().withColumn("before", F.sum("count").over(Window.partitionBy("shard").orderBy("home")) - F.col("count")).drop("count")
    slot = F.row_number().over(Window.partitionBy("shard", "home").orderBy(o, g, "row")) - 1
    out = dealt.withColumn("slot", slot).join(F.broadcast(before), ["shard", "home"])  # a row of `before` per shard and task
    return out.select(*names, "shard", (F.col("slot") + F.col("before")).alias("slot")).toDF(*df.columns, "shard", "slot")


def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in eight shards of nearly equal bytes; equal texts share a shard, null text is empty."""
    text = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.unhex(F.sha2(text, 256)).alias("digest"))
    return sharded(docs, 8, "digest").select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op12_sql(shards: int = 8) -> str:
    """The same by a recursive search over all prefix sums; the cuts from the right (e) and then from the left (c), one step each."""
    crc = "list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(t)), '..'), lambda x: CAST('0x' || x AS BIGINT))), lambda c, b: xor(c >> 8, codes[(xor(c, b) & 255) + 1]))"
    fill = "".join(f", LATERAL (SELECT max(p) AS p{k} FROM edge WHERE p <= {f'p{k - 1} + ' if k > 1 else ''}mid) AS f{k}" for k in range(1, shards + 1))
    right = "".join(f", e{k} AS (SELECT min(p) AS p FROM edge WHERE p >= (SELECT {'total' if k == shards - 1 else f'(SELECT p FROM e{k + 1})'} - capacity FROM best))" for k in range(shards - 1, 0, -1))
    left = ""
    for k in range(1, shards):
        last = "0" if k == 1 else f"(SELECT p FROM c{k - 1})"
        left += f""", s{k} AS (SELECT {last} + (total - {last}) // {shards - k + 1} AS share, capacity FROM best),
n{k} AS (SELECT share, (SELECT max(p) FROM edge WHERE p <= share) AS a, (SELECT min(p) FROM edge WHERE p >= share) AS z, (SELECT max(p) FROM edge WHERE p <= {last} + capacity) AS most FROM s{k}),
c{k} AS (SELECT least(greatest(CASE WHEN {last} < a AND share - a <= z - share THEN a ELSE z END, (SELECT p FROM e{k})), most) AS p FROM n{k})"""
    return f"""
WITH RECURSIVE codes AS (SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS codes),
d AS (SELECT doc_id, t, octet_length(encode(t)) + 1 AS size, sha256(t) AS g, xor({crc}, 4294967295) AS crc FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents), codes),
gs AS (SELECT g, min(doc_id) AS first, CAST(sum(size) AS BIGINT) AS size FROM d GROUP BY g),
line AS MATERIALIZED (SELECT g, size, CAST(sum(size) OVER (ORDER BY first NULLS FIRST, g ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run FROM gs),
edge AS MATERIALIZED (SELECT 0 AS p UNION SELECT run FROM line),
search(lo, hi, total) AS (SELECT (max(p) + {shards - 1}) // {shards}, max(p), max(p) FROM edge
  UNION ALL SELECT CASE WHEN p{shards} >= total THEN lo ELSE mid + 1 END, CASE WHEN p{shards} >= total THEN mid ELSE hi END, total
  FROM (SELECT lo, hi, total, (lo + hi) // 2 AS mid FROM search WHERE lo < hi) AS now{fill}),
best AS MATERIALIZED (SELECT lo AS capacity, total FROM search WHERE lo = hi){right}{left},
cuts AS ({' UNION ALL '.join(f'SELECT p FROM c{k}' for k in range(1, shards))}),
placed AS (SELECT g, (SELECT count(*) FROM cuts WHERE cuts.p <= run - size) AS shard FROM line)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(crc AS BIGINT) AS text_crc32, 'bytes' AS law, CAST(shard AS INT) AS shard,
  row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, g) - 1 AS slot, CAST(NULL AS INT) AS grown_shard
FROM d JOIN placed USING (g)
"""
