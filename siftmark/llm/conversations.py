"""Conversation prefix trie: an external mergesort that knows common prefixes, and a stack of open nodes over its output.

A conversation is a sequence of turns, each by a 128-bit part of the SHA-256 of its role and text. Sequences are dealt to tasks
by ranges of their order. A task sorts them in runs, on disk beyond the first; each sequence in a run carries the length of
the prefix that it shares with the one before it (LCP). A loser tree merges the runs: of two sequences the one that shares
more turns with the last output is the smaller, and only for equal lengths are turns compared, from there on. The merged
stream closes every open node deeper than the next LCP, so what is in memory is one path.

A node lies in one task, unless it is on the path of a task's first or last sequence. Such nodes leave the task in parts, which
are summed up by node and then stacked in their order; there are at most two paths per task.
"""

from __future__ import annotations

import hashlib
import pickle
import tempfile
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import partitions, prepare, release, shared_dir, table

WIDTH = 16  # bytes of a turn's digest
RUN = 32 << 20  # bytes of a run's sequences; what a task sorts at once
HELD = 10_000  # rows that wait for their parent, and ids of a node's ends, before they leave
WORD = r"[^\x20\x09-\x0D]+"
Sequence = tuple[bytes, int, array]  # digests, conversation, words of each turn


def shared(a: bytes, b: bytes, at: int = 0) -> int:
    """How many turns two sequences share; the first `at` are known to be equal."""
    most = min(len(a), len(b)) // WIDTH
    step = 1
    while at < most and a[WIDTH * at : WIDTH * (at + step)] == b[WIDTH * at : WIDTH * (at + step)]:
        at, step = at + step, 2 * step
    at = min(at, most)
    while step > 1:  # the last stretch has a difference, or ends behind one of them
        step //= 2
        if at + step <= most and a[WIDTH * at : WIDTH * (at + step)] == b[WIDTH * at : WIDTH * (at + step)]:
            at += step
    return at


def with_lcps(sequences: list[Sequence]) -> Iterator[tuple[Sequence, int]]:
    last = b""
    for s in sorted(sequences, key=lambda s: s[:2]):
        yield s, shared(last, s[0])
        last = s[0]


class Runs:
    """Sorted runs of what is added; all but the last lie in unnamed files, which the system removes with the task."""

    def __init__(self, size: int = RUN):
        self.size, self.files, self.now, self.held = size, [], [], 0

    def add(self, s: Sequence) -> None:
        self.now.append(s)
        self.held += len(s[0]) + 8 * len(s[2]) + 200
        if self.held >= self.size:
            f = tempfile.TemporaryFile(buffering=1 << 18)
            chunk: list = []
            for x in with_lcps(self.now):
                chunk.append(x)
                if len(chunk) == 256:
                    pickle.dump(chunk, f, 5)
                    chunk = []
            pickle.dump(chunk, f, 5)
            self.files.append(f)
            self.now, self.held = [], 0

    @staticmethod
    def read(f) -> Iterator[tuple[Sequence, int]]:
        f.seek(0)
        try:
            while True:
                yield from pickle.load(f)
        except EOFError:
            f.close()

    def merged(self) -> Iterator[tuple[Sequence, int]]:
        return merge([*map(self.read, self.files), with_lcps(self.now)])


def merge(runs: list[Iterator[tuple[Sequence, int]]]) -> Iterator[tuple[Sequence, int]]:
    """All sequences in order, each with its LCP to the one before, by a tree of losers.

    The loser at each node of the tree has its LCP with the sequence that won there. The last output has won all matches on
    its way, so when its run's next sequence goes up, all that it meets has LCPs with that output, and so has itself.
    """
    if len(runs) == 1:
        yield from runs[0]
        return
    size = 1 << (len(runs) - 1).bit_length()
    runs = [*runs, *(iter(()) for _ in range(size - len(runs)))]
    head: list[Sequence | None] = [None] * size
    lcp = [0] * size

    def pull(i: int) -> None:
        head[i], lcp[i] = next(runs[i], (None, -1))

    def match(a: int, b: int) -> tuple[int, int]:
        """Winner and loser; the loser's LCP becomes that with the winner."""
        if lcp[a] != lcp[b]:  # an ended run has -1
            return (a, b) if lcp[a] > lcp[b] else (b, a)
        if head[a] is None:
            return a, b
        x, y = head[a], head[b]
        m = shared(x[0], y[0], lcp[a])
        less = (x[0][WIDTH * m : WIDTH * (m + 1)], x[1]) <= (y[0][WIDTH * m : WIDTH * (m + 1)], y[1])
        a, b = (a, b) if less else (b, a)
        lcp[b] = m
        return a, b

    for i in range(size):
        pull(i)
    losers = [0] * size
    level = list(range(size))
    node = size
    while len(level) > 1:
        node //= 2
        played = [match(level[2 * i], level[2 * i + 1]) for i in range(node)]
        losers[node : 2 * node] = [x[1] for x in played]
        level = [x[0] for x in played]
    best = level[0]
    while head[best] is not None:
        yield head[best], lcp[best]
        pull(best)
        at = (size + best) // 2
        while at:
            best, losers[at] = match(best, losers[at])
            at //= 2


class Node:
    """A node on the open path, or one that is put together from its parts."""

    __slots__ = ("children", "conv", "ends", "first", "ids", "leaves", "looked_up", "n", "saved", "sha", "waiting", "words")

    def __init__(self, words: int, first: bool = False):
        self.words, self.first, self.looked_up = words, first, first
        self.conv, self.n, self.children, self.leaves, self.saved, self.ends = None, 0, 0, 0, 0, 0
        self.ids, self.sha, self.waiting = None, None, []

    def end(self, conv: int) -> None:
        """A member that ends here; they come in ascending order."""
        self.n, self.ends = self.n + 1, self.ends + 1
        self.conv = conv if self.conv is None else min(self.conv, conv)
        if self.sha is None:
            self.sha, self.ids = hashlib.sha256(b"%d" % conv), array("q", [conv])
        else:
            self.sha.update(b",%d" % conv)
            self.ids.append(conv)

    def over(self, child: Node) -> None:
        self.n, self.conv = self.n + child.n, child.conv if self.conv is None else min(self.conv, child.conv)
        self.children, self.leaves, self.saved = self.children + 1, self.leaves + child.leaves, self.saved + child.saved

    def close(self) -> None:
        """Its own share is added to what its children gave."""
        self.leaves = self.leaves or 1
        self.saved += (self.n - 1) * self.words


NONE = hashlib.sha256(b"").hexdigest()
FINISHED, PART, ENDS, NAMED = range(4)
#: FINISHED: a node, whose parent's conversation is in parent_conv_id or found by the parent's id; PART: a path's node in this
#: task, with all its members here, but other sums only over its finished children; ENDS: a part of a node's ends; NAMED: the conversation of a node that rows name as parent.
FIELDS = [("kind", pa.int8()), ("id", pa.binary()), ("parent", pa.binary()), ("path", pa.int64()), ("depth", pa.int64()), ("conv_id", pa.int64()), ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()), ("words", pa.int64()), ("ends_sha256", pa.string()), ("ends", pa.binary())]
ARROW = pa.schema(FIELDS)
SCHEMA = "kind byte, id binary, parent binary, path long, depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, words long, ends_sha256 string, ends binary"


class Names:
    """The ids of the nodes on a path, each by the hash of its turns; all of a path are made in one pass, and kept for its next node."""

    def __init__(self) -> None:
        self.key, self.ids = None, []

    def of(self, key: bytes, depth: int) -> bytes:
        if self.key is not key:
            so_far = hashlib.sha256()
            self.key, self.ids = key, [so_far.digest()[:WIDTH]]
            for at in range(0, len(key), WIDTH):
                so_far.update(key[at : at + WIDTH])
                self.ids.append(so_far.digest()[:WIDTH])
        return self.ids[depth]


def nodes(ordered: Iterator[tuple[Sequence, int]], part: int) -> Iterator[list[tuple]]:
    """Rows of FIELDS from a task's sequences in order, in lists of bounded length."""
    rows: list[tuple] = []
    path: list[Node] = []  # from the root
    key, first, name = b"", True, Names().of

    def row(kind: int, depth: int, n: Node, **more) -> tuple:
        given = {"kind": kind, "depth": depth, "conv_id": n.conv, "n_convs": n.n, "n_children": n.children, "n_leaves": n.leaves, "saved_tokens": n.saved, "words": n.words, "ends_sha256": n.sha.hexdigest() if n.sha else NONE} | more
        return tuple(given.get(f) for f, _ in FIELDS)

    def ship(depth: int, which: int) -> None:
        n = path[depth]
        if n.ids:
            rows.append(row(ENDS, depth, n, id=name(key, depth), path=which, ends=n.ids.tobytes(), conv_id=n.ids[0]))
            n.ids = array("q")

    def release_waiting(depth: int) -> None:
        """Rows that wait for a node leave with its id."""
        n = path[depth]
        if n.waiting:
            n.looked_up, parent = True, name(key, depth)
            rows.extend(row(FINISHED, depth + 1, child, parent=parent) for child in n.waiting)
            n.waiting = []

    def shut(n: Node, depth: int) -> None:
        """A node that lies in this task as a whole."""
        n.close()
        if n.looked_up:
            rows.append(row(NAMED, depth, n, id=name(key, depth)))
        rows.extend(row(FINISHED, depth + 1, child, parent_conv_id=n.conv) for child in n.waiting)
        n.waiting, n.ids = [], None
        up = path[depth - 1]
        up.over(n)
        up.waiting.append(n)
        if len(up.waiting) >= HELD:
            release_waiting(depth - 1)

    def leave(depth: int, which: int) -> None:
        """The deepest open node, on the task's first (which even) or last path: its part leaves."""
        release_waiting(depth)
        ship(depth, which)
        n = path.pop()
        if path:
            path[-1].n, path[-1].conv = path[-1].n + n.n, n.conv if path[-1].conv is None else min(path[-1].conv, n.conv)
        rows.append(row(PART, depth, n, id=name(key, depth), parent=name(key, depth - 1) if depth else None, path=which))

    for (turns, conv, words), lcp in ordered:
        if first:
            path.append(Node(0, True))
            lcp = 0
        while len(path) - 1 > lcp:
            depth = len(path) - 1
            if path[depth].first:
                leave(depth, 2 * part)
            else:
                shut(path.pop(), depth)
        key = turns
        path += [Node(w, first) for w in words[lcp:]]
        first = False
        path[-1].end(conv)
        if len(path[-1].ids) >= HELD:
            ship(len(path) - 1, 2 * part + (not path[-1].first))
        if len(rows) >= HELD:
            yield rows
            rows = []
    while path:
        n = path[-1]
        leave(len(path) - 1, 2 * part + (not n.first))
        if len(rows) >= HELD:
            yield rows
            rows = []
    yield rows


def batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, (_, t) in zip(zip(*rows, strict=True) if rows else [[]] * len(FIELDS), FIELDS, strict=True)], schema=ARROW)


def in_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    runs = Runs()
    for b in batches:
        for turns, conv, words in zip(*(c.to_pylist() for c in b.columns), strict=True):
            runs.add((turns, conv, array("q", words)))
    for rows in nodes(runs.merged(), TaskContext.get().partitionId()):
        yield batch(rows)
    release()


def put_together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """PART and ENDS rows sorted by id, kind and path: a row per node, with what all its parts have and the hash of all its ends."""
    at, node, best, ended = None, None, None, 0
    rows: list[tuple] = []

    def done() -> None:
        if node is not None:
            given = dict(zip((f for f, _ in FIELDS), best, strict=True)) | {"conv_id": node.conv, "n_convs": node.n, "n_children": node.children, "n_leaves": node.leaves, "saved_tokens": node.saved, "ends_sha256": node.sha.hexdigest() if node.sha else NONE}
            rows.append(tuple(given[f] for f, _ in FIELDS))

    for b in batches:
        for r in zip(*(c.to_pylist() for c in b.columns), strict=True):
            kind, key, _, _, _, conv, _, n, children, leaves, saved, words, _, ends = r
            if key != at:
                done()
                at, node = key, None
            if kind == PART:
                if node is None:
                    node, best = Node(words), r  # the first path that has it
                node.n, node.conv = node.n + n, conv if node.conv is None else min(node.conv, conv)
                node.children, node.leaves, node.saved = node.children + children, node.leaves + leaves, node.saved + saved
            elif node is not None:  # else the node lay in one task after all
                text = ",".join(map(str, array("q", ends))).encode()
                if node.sha is None:
                    node.sha = hashlib.sha256(text)
                else:
                    node.sha.update(b"," + text)
            if len(rows) >= HELD:
                yield batch(rows)
                rows = []
    done()
    yield batch(rows)


def stacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes of all paths in preorder, with the sums over their own subtrees of finished nodes: the sums over all. Parents come later, by id."""
    path: list[tuple[Node, tuple]] = []
    rows: list[tuple] = []

    def shut() -> None:
        n, r = path.pop()
        n.close()
        given = dict(zip((f for f, _ in FIELDS), r, strict=True)) | {"n_children": n.children, "n_leaves": n.leaves, "saved_tokens": n.saved}
        rows.append(tuple(given[f] for f, _ in FIELDS))
        if path:
            up = path[-1][0]
            up.children, up.leaves, up.saved = up.children + 1, up.leaves + n.leaves, up.saved + n.saved

    for b in batches:
        for r in zip(*(c.to_pylist() for c in b.columns), strict=True):
            while path and len(path) > r[4]:
                shut()
            n = Node(r[11])
            n.n, n.children, n.leaves, n.saved = r[7], r[8], r[9], r[10]
            path.append((n, r))
        if len(rows) >= HELD:
            yield batch(rows)
            rows = []
    while path:
        shut()
    yield batch(rows)


def sequences(turns: DataFrame, key: str = "conv_id", order: str = "turn", role: str = "role", text: str = "text", dealt_by: tuple[str, ...] = ()) -> DataFrame:
    """(conv_id, *dealt_by, turns): each conversation's turns in order (null first, ties by role and digest), as digests and numbers of words.

    Null role or text is empty. Rows without conversation are left out. A conversation is one row: 24 bytes a turn.
    dealt_by: columns that the conversation decides; if turns are partitioned by them, grouping needs no other shuffle.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role, text))
    digest = F.substring(F.sha2(F.encode(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), "UTF-8"), 256), 1, 2 * WIDTH)
    turn = F.struct(F.col(order).alias("turn"), role.alias("role"), digest.alias("digest"), F.size(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))).cast("long").alias("words"))
    rows = turns.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("conv_id"), *dealt_by, turn.alias("turn"))
    grouped = rows.groupBy("conv_id", *dealt_by).agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    return grouped.select("conv_id", *dealt_by, F.transform("turns", lambda t: F.struct(t.digest.alias("digest"), t.words.alias("words"))).alias("turns"))


def trie(conversations: DataFrame, folder: str) -> DataFrame:
    """The nodes of sequences() rows: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    A node is named by its conv_id and depth: its turns are the first `depth` of that conversation. Conversations without turns
    are members of the root. An empty table has no nodes. Equal sequences share all nodes, however many; they may lie in many
    tasks. The ids that end at one node are hashed in one stream, as the hash of a list can't be put together from parts.
    """
    spark = conversations.sparkSession
    prepare(spark)
    n = partitions(spark)
    rows = conversations.select(F.unhex(F.array_join(F.col("turns.digest"), "")).alias("key"), "conv_id", F.col("turns.words").alias("words"))
    dealt = rows.repartitionByRange(n, "key", "conv_id")
    dealt.mapInArrow(in_task, SCHEMA).write.parquet(f"{folder}/parts")
    made = spark.read.parquet(f"{folder}/parts")
    part = made.where(F.col("kind").isin(PART, ENDS)).repartition(n, "id").sortWithinPartitions("id", "kind", "path", "conv_id")
    part.mapInArrow(put_together, SCHEMA).write.parquet(f"{folder}/paths")
    paths = spark.read.parquet(f"{folder}/paths")
    # one task: at most two paths per task of the sort, whatever the number of conversations
    paths.repartition(1).sortWithinPartitions("path", "depth").mapInArrow(stacked, SCHEMA).write.parquet(f"{folder}/whole")
    whole = spark.read.parquet(f"{folder}/whole")
    out = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    named = whole.unionByName(made.where(F.col("kind") == NAMED)).select(F.col("id").alias("parent"), F.col("conv_id").alias("parent_conv"))
    if named.count() <= 100_000:  # of 24 bytes
        named = F.broadcast(named)
    finished = made.where(F.col("kind") == FINISHED)
    asking = finished.where("parent IS NOT NULL").unionByName(whole)
    told = asking.join(named, "parent", "left").withColumn("parent_conv_id", F.col("parent_conv"))
    return finished.where("parent IS NULL").select(*out).unionByName(told.select(*out))


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all conversations, each rebuilt with the first turns (none to three, by its id's checksum) of its block's first conversation.

    Blocks are of 20 ids. One shuffle brings a block's turns together: grouping and looking at the first conversation need no other.
    """
    turns = table(spark, sf_dir, "conversations").where("conv_id IS NOT NULL").select("conv_id", "turn", "role", "text", (F.col("conv_id") - F.col("conv_id") % 20).alias("block"))
    own = sequences(turns.repartition(partitions(spark), "block"), dealt_by=("block",))
    first = F.max(F.when(F.col("conv_id") == F.col("block"), F.slice("turns", 1, 3))).over(Window.partitionBy("block"))
    h = (F.crc32(F.encode(F.col("conv_id").cast("string"), "UTF-8")) % 4).cast("int")
    given = own.withColumn("first", F.coalesce(first, F.array().cast("array<struct<digest:string,words:bigint>>"))).withColumn("h", h)
    rebuilt = given.select("conv_id", F.concat(F.slice("first", F.lit(1), F.col("h")), F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns") - F.col("h"), F.lit(0)))).alias("turns"))
    return trie(rebuilt, shared_dir(spark, "conversation-trie"))


CRC = "xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode({})), '..'), lambda x: CAST('0x' || x AS BIGINT))), lambda c, b: xor(c >> 8, codes[(xor(c, b) & 255) + 1])), 4294967295)"
OP11_SQL = f"""
WITH RECURSIVE codes AS (SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS codes),
t AS (SELECT conv_id, turn, concat(octet_length(encode(coalesce(role, ''))), ':', coalesce(role, ''), coalesce(text, '')) AS x, coalesce(role, '') AS r, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS words FROM conversations WHERE conv_id IS NOT NULL),
turns AS (SELECT conv_id, x, words, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, r, sha256(x)) AS k FROM t),
c AS (SELECT conv_id, {CRC.format("CAST(conv_id AS VARCHAR)")} % 4 AS h FROM (SELECT DISTINCT conv_id FROM turns), codes),
both_ AS (SELECT c.conv_id, 0 AS own, k, x, words FROM c JOIN turns ON turns.conv_id = c.conv_id - c.conv_id % 20 AND k <= h
  UNION ALL SELECT c.conv_id, 1, k, x, words FROM c JOIN turns ON turns.conv_id = c.conv_id AND k > h),
built AS MATERIALIZED (SELECT conv_id, x, words, row_number() OVER (PARTITION BY conv_id ORDER BY own, k) AS d FROM both_),
p AS (SELECT conv_id, CAST(0 AS BIGINT) AS depth, '' AS id, CAST(0 AS BIGINT) AS words FROM c
  UNION ALL SELECT p.conv_id, depth + 1, sha256(id || x), built.words FROM p JOIN built ON built.conv_id = p.conv_id AND built.d = depth + 1),
n AS MATERIALIZED (SELECT id, depth, min(conv_id) AS conv_id, count(*) AS n_convs, max(words) AS words FROM p GROUP BY id, depth),
up AS (SELECT n.id, parent.id AS parent_id, parent.conv_id AS parent_conv_id FROM n JOIN p ON p.conv_id = n.conv_id AND p.depth = n.depth - 1 JOIN n AS parent ON parent.id = p.id),
kids AS (SELECT parent_id AS id, count(*) AS n_children FROM up GROUP BY parent_id),
sums AS (SELECT p.id, sum(CASE WHEN kids.n_children IS NULL THEN 1 ELSE 0 END) AS n_leaves, sum((n_convs - 1) * n.words) AS saved_tokens
  FROM n LEFT JOIN kids ON kids.id = n.id JOIN p ON p.conv_id = n.conv_id AND p.depth <= n.depth GROUP BY p.id),
last AS (SELECT conv_id, max(depth) AS depth FROM p GROUP BY conv_id),
ends AS (SELECT p.id, sha256(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id)) AS ends FROM p JOIN last USING (conv_id, depth) GROUP BY p.id)
SELECT n.conv_id, n.depth, up.parent_conv_id, n.n_convs, coalesce(kids.n_children, 0) AS n_children, CAST(sums.n_leaves AS BIGINT) AS n_leaves, CAST(sums.saved_tokens AS BIGINT) AS saved_tokens, coalesce(ends.ends, sha256('')) AS ends_sha256
FROM n LEFT JOIN up ON up.id = n.id LEFT JOIN kids ON kids.id = n.id JOIN sums ON sums.id = n.id LEFT JOIN ends ON ends.id = n.id
"""
