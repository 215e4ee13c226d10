"""N-gram Jaccard join: parity sketches of shingle sets, joined by pigeonhole on their blocks per size band, then verified.

A document's set holds its distinct five-word shingles. Sets of sizes a and b with similarity 0.8 or more differ in at most
(a + b) // 9 shingles. In a size band the hash space is cut into blocks, and a block's sketch is the XOR of the hashes in it,
so each differing shingle changes one block. A set that keeps more filled blocks than it may lose therefore shares a block
with every partner. Of its filled blocks, a set sends as many as it may lose and one more, the fullest first: both partners
choose by the same order, so their choices meet (the prefix principle). A set with too few filled blocks also sends every
shingle, which it shares with each partner of its own kind. So no pair is missed, whatever the hashes.

Sets, not documents, are joined: equal sets are one class from the start. Round one links each class to the first class of a
few of its groups, which joins most copies in a number of links in proportion to the classes. Later rounds look at the groups whose
members are still apart, and there compare only members of different components, first by the Hamming distance of their
parity bits, which never exceeds the number of differing shingles. Round two takes as many of these pairs as could join
everything; round three takes all that are then still between components. All candidates are verified on whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import U64, column_place, map_file, mix, packed, partitions, mapped, prepare, release, shared_dir, shingle_lists, table, write_file

FIRST_KEYS = 3  # of a band, for round one
GROUP = 1024  # members of a group compared in one place; larger groups are cut into pairs of parts
NONE = -(2**63)
ALL_ONES = b"\xff" * 8  # of a blob of documents; other blobs start with a number of keys
FALLBACK = U64(0xA5A5_5A5A_0F0F_F0F0)


def shingle_sets(raws: list[bytes | None]) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    return map(np.unique, shingle_lists([x or b"" for x in raws]))


def class_of(s: np.ndarray) -> int:
    """Equal sets have equal classes (a signed 64-bit hash)."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(s.tobytes())).astype(np.int64))


def similar(both: int, a: int, b: int) -> bool:
    return 100 * both >= 80 * (a + b - both)


def may_differ(a: int, b: int) -> int:
    """Most differing shingles of sets of these sizes that are similar."""
    return (a + b) // 9


def bands(n: int) -> list[int]:
    """A set's band by powers of two, and the next if a larger partner can lie there. A pair is found in its larger set's band."""
    g = n.bit_length() - 1
    return [g, g + 1] if 5 * n // 4 >= 2 << g else [g]


def blocks(g: int) -> int:
    return max(64, 13 * (may_differ((2 << g) - 1, (2 << g) - 1) + 1) // 10)


def block_keys(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Join keys of a set, and which of them serve in round one."""
    out, first = [], []
    n = len(s)
    for g in bands(n):
        need = may_differ(n, min(5 * n // 4, (2 << g) - 1)) + 1
        j = ((s >> U64(32)) * U64(blocks(g))) >> U64(32)  # ascending, as s is
        starts = np.concatenate([[0], np.flatnonzero(j[1:] != j[:-1]) + 1])
        load = np.diff(np.append(starts, n))
        keys = mix(np.bitwise_xor.reduceat(s, starts) ^ mix(j[starts] + U64(g << 40)))
        if len(keys) < need:
            keys = np.concatenate([keys, mix(s ^ FALLBACK ^ U64(g))])
        else:
            keys = keys[np.lexsort((keys, -load))[:need]]
        out.append(keys)
        first.append(np.arange(len(keys)) < FIRST_KEYS)
    return np.concatenate(out), np.concatenate(first)


def parity(s: np.ndarray) -> np.ndarray:
    """One bit per place, flipped by every shingle that hashes there; four places for each shingle of the band's largest set."""
    bits = max(256, 4 * (2 << (len(s).bit_length() - 1)))
    count = np.bincount((mix(s) % U64(bits)).astype(np.int64), minlength=bits)
    return np.packbits((count & 1).astype(np.uint8), bitorder="little")


def folded(p: np.ndarray, size: int) -> np.ndarray:
    """Parity bits brought to a smaller size: places are equal modulo it."""
    while p.shape[-1] > size:
        p = p[..., : p.shape[-1] // 2] ^ p[..., p.shape[-1] // 2 :]
    return p


def groups(docs: DataFrame, n: int) -> DataFrame:
    """kind 0: (first class of a group, another) for round one; 1: (key, class) of classes that share a key; 2: (doc_id, class, size) of each document.

    A null doc_id is the least value here, and so is the class of an empty set.
    """

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[int, bytes]]]:
        sent, turn = set(), TaskContext.get().partitionId()
        for batch in batches:
            for at in range(0, batch.num_rows, 1500):
                cls: list[int] = []
                made: list[tuple[np.ndarray, np.ndarray]] = []
                own_cls, sizes = [], []
                some = batch.slice(at, 1500)
                for s in shingle_sets(some.column(1).cast(pa.binary()).to_pylist()):
                    c = class_of(s) if len(s) else NONE
                    own_cls.append(c)
                    sizes.append(len(s))
                    if len(s) and c not in sent:
                        sent.add(c)
                        cls.append(c)
                        made.append(block_keys(s))
                ids = some.column(0).fill_null(NONE).to_numpy(zero_copy_only=False)
                turn += 1
                yield [(turn % n, b"".join(a.astype(np.int64).tobytes() for a in (np.array([-1, len(ids)]), ids, np.array(own_cls), np.array(sizes))))]
                if len(sent) > 200_000:
                    sent.clear()  # copies sent again are found again below
                if not cls:
                    continue
                keys, first = np.concatenate([k for k, _ in made]), np.concatenate([f for _, f in made])
                owner = np.repeat(np.array(cls, np.int64), [len(k) for k, _ in made])
                shard = (keys >> U64(32)) * U64(n) >> U64(32)
                order = np.argsort(shard, kind="stable")
                keys, first, owner, shard = keys[order], first[order], owner[order], shard[order]
                cuts = np.flatnonzero(np.diff(shard)) + 1
                out = []
                for k, f, o, i in zip(*(np.split(a, cuts) for a in (keys, first, owner, shard)), strict=True):
                    own, index = np.unique(o, return_inverse=True)
                    head = np.array([len(k), len(own)], np.int64)
                    out.append((int(i[0]), b"".join(a.tobytes() for a in (head, k, own, index.astype(np.uint16), f))))
                yield out

    def merge(_: int, blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
        ks, cs, fs = [], [], []
        rows = [np.frombuffer(x, np.int64).reshape(-1)[2:].reshape(3, -1) for x in blobs if x[:8] == ALL_ONES]
        blobs = [x for x in blobs if x[:8] != ALL_ONES]
        for ids, own_cls, sizes in rows:
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), 2, np.int32)), *map(pa.array, (ids, own_cls, sizes))], ["kind", "a", "b", "n"])
        if not blobs:
            return
        for x in blobs:
            n_keys, n_own = np.frombuffer(x, np.int64, 2)
            ks.append(np.frombuffer(x, U64, n_keys, 16))
            own = np.frombuffer(x, np.int64, n_own, 16 + 8 * n_keys)
            at = 16 + 8 * (n_keys + n_own)
            cs.append(own[np.frombuffer(x, np.uint16, n_keys, at)])
            fs.append(np.frombuffer(x, bool, n_keys, at + 2 * n_keys))
        keys, cls, first = np.concatenate(ks), np.concatenate(cs), np.concatenate(fs)
        order = np.lexsort((cls, keys))
        keys, cls, first = keys[order], cls[order], first[order]
        new = np.ones(len(keys), bool)
        new[1:] = (keys[1:] != keys[:-1]) | (cls[1:] != cls[:-1])
        keys, cls, first = keys[new], cls[new], first[new]
        starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        size = np.diff(np.append(starts, len(keys)))
        head, several = np.repeat(cls[starts], size), np.repeat(size > 1, size)
        near = several & first & (cls != head)
        for kind, a, b in ((0, head[near], cls[near]), (1, keys[several].view(np.int64), cls[several])):
            for i in range(0, len(a), 100_000):
                m = len(a[i : i + 100_000])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(m, kind, np.int32)), pa.array(a[i : i + m]), pa.array(b[i : i + m]), pa.nulls(m, pa.int64())], ["kind", "a", "b", "n"])

    return packed(docs.select("doc_id", "text"), n, emit, merge, "kind int, a long, b long, n long")


class Members:
    """A set of ids in a shared folder: sorted files by hash, memory-mapped by those who ask."""

    def __init__(self, folder: str, n: int):
        self.folder, self.n, self.files = folder, n, {}

    @staticmethod
    def write(ids: DataFrame, folder: str, n: int) -> Members:
        """ids: one long column, and if need be another that the files are dealt by. Null stands for itself as the least value."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            by: dict[int, list] = {}
            for b in batches:
                for s, i in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    by.setdefault(s, []).append(i)
            for s, got in by.items():
                write_file(f"{folder}/{s:06d}.members", [np.unique(np.array(got, np.int64))])
                yield pa.RecordBatch.from_pydict({"shard": pa.array([s], pa.int32())})

        name, by = ids.columns[0], ids.columns[-1]
        rows = ids.select(F.pmod(F.xxhash64(F.coalesce(by, F.lit(-(2**63)))), F.lit(n)).cast("int").alias("shard"), F.coalesce(name, F.lit(-(2**63))).alias("id")).distinct()
        rows.repartitionById(n, F.col("shard")).mapInArrow(run, "shard int").write.parquet(f"{folder}/shards")
        return Members(folder, n)

    def has(self, shards: np.ndarray, ids: np.ndarray) -> np.ndarray:
        out = np.zeros(len(ids), bool)
        for s in np.unique(shards):
            if s not in self.files:
                try:
                    self.files[s] = map_file(f"{self.folder}/{s:06d}.members").view(np.int64)
                except FileNotFoundError:
                    self.files[s] = np.zeros(0, np.int64)  # no id has this hash
            f, here = self.files[s], shards == s
            if len(f):
                at = np.minimum(np.searchsorted(f, ids[here]), len(f) - 1)
                out[here] = f[at] == ids[here]
        return out


def joined_by(left: DataFrame, right: DataFrame, key: str, n: int, how: str = "inner") -> DataFrame:
    """left.join(right, key), with the keys that many rows of left share spread over several tasks.

    A key is frequent if it has more than a quarter of a task's even share of rows, so there are fewer than 4 n such keys, which
    is all that comes to the driver. Their rows are dealt over salts by a hash of all columns, so that a task that runs again deals alike, and the rows of right that have them are copied to each.
    """
    counted = left.groupBy(key).count()  # summed per task before the shuffle
    total = counted.agg(F.sum("count")).first()[0] or 0
    limit = max(16, total // (4 * n))
    most = {r[key]: r["count"] for r in counted.where((F.col("count") > limit) & F.col(key).isNotNull()).collect()}
    if not most:
        return left.join(right, key, how)
    salts = {k: min(n, -(-c // limit)) for k, c in most.items()}
    given = left.sparkSession.createDataFrame(list(salts.items()), "hot_key long, salts int")
    spread = F.when(F.col("salts").isNotNull(), F.pmod(F.xxhash64(*left.columns), F.col("salts"))).otherwise(0).cast("int")
    a = left.join(F.broadcast(given), F.col(key) == F.col("hot_key"), "left").withColumn("salt", spread).drop("hot_key", "salts")
    b = right.join(F.broadcast(given), F.col(key) == F.col("hot_key"), "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("salts"), F.lit(1)) - 1))).drop("hot_key", "salts")
    return a.join(b, [key, "salt"], how).drop("salt")


def representatives(docs: DataFrame, base: DataFrame, classes: DataFrame, folder: str, n: int, schema: str, make) -> DataFrame:
    """make(class, text, set) rows, one per class of `classes` (column cls), from one document of it each.

    Only the documents whose ids are needed leave the scan; their ids are looked up in memory-mapped files.
    """
    first = base.groupBy("cls").agg(F.min("doc_id").alias("doc_id"))  # copies are summed up per task before they meet
    ids = first.join(classes.select("cls").distinct(), "cls")
    wanted = Members.write(ids.select("doc_id"), f"{folder}/ids", n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        members = Members(wanted.folder, wanted.n)
        for b in batches:
            shards, ids = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for at in range(0, b.num_rows, 1000):
                hit = members.has(shards[at : at + 1000], ids[at : at + 1000])
                raws = b.column(2).slice(at, 1000).filter(pa.array(hit)).cast(pa.binary()).to_pylist()
                rows = [make(class_of(s), x, s) for x, s in zip(raws, shingle_sets(raws), strict=True) if len(s)]
                if rows:
                    yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], pa.schema(list(zip(names, kinds, strict=True))))
        release()

    names = [c.split()[0] for c in schema.split(", ")]
    kinds = [{"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[c.split()[1]] for c in schema.split(", ")]
    key = F.coalesce("doc_id", F.lit(-(2**63)))
    rows = docs.select(F.pmod(F.xxhash64(key), F.lit(n)).cast("int").alias("shard"), key.alias("id"), "text").mapInArrow(run, schema)
    return rows.dropDuplicates([names[0]]).join(classes.select(F.col("cls").alias(names[0])).distinct(), names[0], "left_semi")


def linked(pairs: DataFrame, docs: DataFrame, base: DataFrame, folder: str, n: int) -> DataFrame:
    """The pairs (a, b) of classes whose sets are similar, by their whole texts; written to the folder."""
    classes = pairs.select(F.col("a").alias("cls")).unionByName(pairs.select(F.col("b").alias("cls")))
    representatives(docs, base, classes, folder, n, "cls long, text binary", lambda c, x, s: (c, x)).write.parquet(f"{folder}/texts")
    texts = docs.sparkSession.read.parquet(f"{folder}/texts")
    left, right = texts.select(F.col("cls").alias("a"), F.col("text").alias("x")), texts.select(F.col("cls").alias("b"), F.col("text").alias("y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, mine = None, None  # neighbouring rows often have the same first class
        for b in batches:
            keep = []
            for a, x, other in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), shingle_sets(b.column(3).to_pylist()), strict=True):
                if a != seen:
                    seen, mine = a, next(shingle_sets([x]))
                keep.append(similar(len(np.intersect1d(mine, other, assume_unique=True)), len(mine), len(other)))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(mask), b.column(1).filter(mask)], ["a", "b"])
        release()

    joined = joined_by(joined_by(pairs, left, "a", n), right, "b", n).select("a", "b", "x", "y")
    joined.mapInArrow(run, "a long, b long").write.parquet(f"{folder}/links")
    return docs.sparkSession.read.parquet(f"{folder}/links")


def components(edges: DataFrame, folder: str) -> DataFrame:
    """(node, label): the least node of each component, by alternating large and small stars until nothing changes.

    Each round is two aggregations and joins over the edges, written to the folder, so lineage stays short; rounds grow with
    the logarithm of the longest path. Nodes without an edge have no row.
    """
    spark = edges.sparkSession
    current = edges.selectExpr("greatest(a, b) AS u", "least(a, b) AS v").where("u != v").distinct()
    before, step = None, 0
    while True:
        both = current.unionByName(current.selectExpr("v AS u", "u AS v"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).selectExpr("u", "least(u, m) AS m")
        large = both.where("v > u").join(least, "u").selectExpr("v AS u", "m AS v").where("u != v").distinct()
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        star = large.join(small, "u").where("v != m").selectExpr("v AS u", "m AS v").unionByName(small.selectExpr("u", "m AS v")).distinct()
        star.write.parquet(f"{folder}/{step}")
        current = spark.read.parquet(f"{folder}/{step}")
        now = current.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("u", "v") % 1_000_003)).first()
        if now == before:
            return current.selectExpr("u AS node", "v AS label")
        before, step = now, step + 1


def apart(rows: DataFrame, labels: DataFrame, n: int) -> DataFrame:
    """Of the rows (key, cls), those in groups with several components: key, cls, label, size of the group."""
    named = rows.join(labels.withColumnRenamed("node", "cls"), "cls", "left").select("key", "cls", F.coalesce("label", "cls").alias("label"))
    mixed = named.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("size")).where("lo != hi").select("key", "size")
    return joined_by(named, mixed, "key", n)


def compared(rows: DataFrame, sketches: DataFrame, forest: bool) -> DataFrame:
    """Distinct pairs of members of different components in one group whose parity bits allow that they are similar.

    forest: of these, only as many as join what they can join, fewer than the group has components.
    """
    parts = F.expr(f"cast(ceil(size / {GROUP}) AS int)")
    mine = F.pmod(F.xxhash64("cls"), parts).cast("int")
    cells = F.transform(F.sequence(F.lit(0), parts - 1), lambda i: F.struct(F.least(i, mine).alias("i"), F.greatest(i, mine).alias("j")))
    spread = rows.select("key", "cls", "label", F.explode(cells).alias("c"), mine.alias("mine")).join(sketches, "cls")
    spread = spread.select("key", "c.i", "c.j", "mine", "cls", "label", "n", "bits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        cell = None
        found: set[tuple[int, int]] = set()

        def close() -> None:
            size = min(len(r[7]) for r in held)
            bits = np.stack([folded(np.frombuffer(r[7], np.uint8), size) for r in held]).view(U64)
            n, part, cls = np.array([r[6] for r in held]), np.array([r[3] for r in held]), [r[4] for r in held]
            names, label = np.unique([r[5] for r in held], return_inverse=True)
            over = list(range(len(names)))

            def root(x: int) -> int:
                while over[x] != x:
                    over[x] = x = over[over[x]]
                return x

            for x in np.flatnonzero(label != np.bincount(label).argmax()):  # the largest component's members meet the others from their side
                far = np.bitwise_count(bits ^ bits[x]).sum(1)
                ok = (far <= (n + n[x]) // 9) & (label != label[x])
                if cell[1] != cell[2]:
                    ok &= part != part[x]
                at = np.flatnonzero(ok)
                if forest:
                    at = at[np.unique(label[at], return_index=True)[1]]
                for y in at:
                    if forest:
                        p, q = root(label[x]), root(label[y])
                        if p == q:
                            continue
                        over[p] = q
                    found.add((min(cls[x], cls[y]), max(cls[x], cls[y])))

        def flush() -> pa.RecordBatch:
            pairs = list(found)
            found.clear()
            return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], ["a", "b"])

        for b in batches:
            for r in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if held and r[:3] != cell:
                    close()
                    held = []
                    if len(found) > 200_000:
                        yield flush()
                cell = r[:3]
                held.append(r)
        if held:
            close()
        yield flush()
        release()

    dealt = spread.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return dealt.mapInArrow(run, "a long, b long").distinct()


def classified(docs: DataFrame, folder: str) -> DataFrame:
    """(doc_id, n, cls, label) of each document: its set's size and class, and the least class that links reach; null for an empty set."""
    spark = docs.sparkSession
    prepare(spark)
    n = partitions(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    groups(docs, n).write.parquet(f"{folder}/groups")
    shared = spark.read.parquet(f"{folder}/groups")
    known = lambda c: F.when(F.col(c) != NONE, F.col(c))
    shared.where("kind = 2").select(known("a").alias("doc_id"), "n", known("b").alias("cls")).write.parquet(f"{folder}/base")
    base = spark.read.parquet(f"{folder}/base")
    stars = shared.where("kind = 0").select("a", "b").distinct()
    links = linked(stars, docs, base, f"{folder}/one", n)
    labels = components(links, f"{folder}/stars-one")
    apart(shared.where("kind = 1").selectExpr("a AS key", "b AS cls"), labels, n).write.parquet(f"{folder}/apart")
    rest = spark.read.parquet(f"{folder}/apart")
    made = representatives(docs, base, rest, f"{folder}/sketches", n, "cls long, n long, bits binary", lambda c, x, s: (c, len(s), parity(s).tobytes()))
    made.write.parquet(f"{folder}/sketches/bits")
    sketches, tried = spark.read.parquet(f"{folder}/sketches/bits"), stars
    for step in ("two", "three"):  # first what joins components, then every pair that is still open
        compared(rest, sketches, step == "two").join(tried, ["a", "b"], "left_anti").write.parquet(f"{folder}/{step}/pairs")
        pairs = spark.read.parquet(f"{folder}/{step}/pairs")
        more, tried = linked(pairs, docs, base, f"{folder}/{step}", n), tried.unionByName(pairs)
        labels = components(labels.selectExpr("node AS a", "label AS b").unionByName(more), f"{folder}/stars-{step}")
        if step == "two":
            apart(rest.select("key", "cls"), labels, n).write.parquet(f"{folder}/apart-two")
            rest = spark.read.parquet(f"{folder}/apart-two")
    named = joined_by(base, labels.withColumnRenamed("node", "cls"), "cls", n, "left")
    return named.select("doc_id", "n", "cls", F.coalesce("label", "cls").alias("label"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id): component_id is the smallest doc_id that links of similarity 0.8 or more reach.

    Null and empty texts have an empty set and stay alone under their own id. Texts of fewer than five words are one shingle
    and link to texts with the same words. Repeated rows and copies are in one component; rows without id take part, and a
    component of such rows alone has a null id. A very long text sends keys in proportion to its shingles, and is compared whole.
    An empty table gives no rows. Other columns of docs are not read.
    """
    folder, n = shared_dir(docs.sparkSession, "near-duplicates"), partitions(docs.sparkSession)
    classified(docs, folder).write.parquet(f"{folder}/named")
    named = docs.sparkSession.read.parquet(f"{folder}/named")
    least = named.where("label IS NOT NULL").groupBy("label").agg(F.min("doc_id").alias("least"))
    return joined_by(named, least, "label", n, "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("label").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("component_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of docs, with all columns, less all but one of each component: that of the smallest doc_id.

    Rows without text, or with white space only, all stay. Of rows that share an id and have the same set one stays, whatever
    their case and white space. Rows without id stay only if their component has no other. Texts are filtered where they are
    read, by memory-mapped files; only rows whose id is repeated are shuffled.
    """
    spark = docs.sparkSession
    folder, n = shared_dir(spark, "near-duplicates"), partitions(spark)
    classified(docs, folder).write.parquet(f"{folder}/named")
    named = spark.read.parquet(f"{folder}/named").where("label IS NOT NULL")
    key = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(NONE))
    chosen = named.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "cls")).alias("k")).select(key("k.doc_id").alias("id"), F.col("k.cls").alias("cls"))
    times = named.groupBy(key("doc_id").alias("id"), "cls").agg(F.count("*").alias("times"))
    chosen.join(times, ["id", "cls"]).write.parquet(f"{folder}/kept")
    kept = spark.read.parquet(f"{folder}/kept")
    text, names = column_place(docs, "text"), docs.columns
    shard = F.pmod(F.xxhash64(key("doc_id")), F.lit(n)).cast("int")

    def rows_of(docs: DataFrame, wanted: DataFrame, name: str, empty: bool) -> DataFrame:
        """Rows of docs whose id and class are wanted, with the class behind them; also those without words, if empty."""
        members = Members.write(wanted.select(F.col("id").bitwiseXOR(F.col("cls")).alias("id"), F.col("id").alias("by")), f"{folder}/{name}", n)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            mine = Members(members.folder, members.n)
            for b in batches:
                for at in range(0, b.num_rows, 1000):
                    some = b.slice(at, 1000)
                    shards, ids = (some.column(len(names) + i).to_numpy(zero_copy_only=False) for i in (0, 1))
                    sets = list(shingle_sets(some.column(text).cast(pa.binary()).to_pylist()))
                    cls = np.array([class_of(s) if len(s) else 0 for s in sets], np.int64)
                    bare = np.array([not len(s) for s in sets], bool)
                    keep = pa.array((mine.has(shards, ids ^ cls) & ~bare) | (bare & empty))
                    yield pa.RecordBatch.from_arrays([*(some.column(i).filter(keep) for i in range(len(names))), pa.array(cls).filter(keep)], [*(f"_{i}" for i in range(len(names))), "cls"])
            release()

        return mapped(docs.select("*", shard.alias("_shard"), key("doc_id").alias("_key")), run, StructType([StructField(f"_{i}", f.dataType, f.nullable) for i, f in enumerate(docs.schema)] + [StructField("cls", LongType())]))

    single, several = kept.where("times = 1"), kept.where("times > 1")
    out = rows_of(docs, single, "keep", True)
    if not several.isEmpty():
        ids = several.select(F.col("id").alias("_id")).distinct()
        repeated = docs.join(ids, key("doc_id") == F.col("_id"), "left_semi")
        place = column_place(docs, "doc_id")
        out = out.unionByName(rows_of(repeated, several, "keep-one", False).dropDuplicates([f"_{place}", "cls"]))
    return out.drop("cls").toDF(*names)


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
