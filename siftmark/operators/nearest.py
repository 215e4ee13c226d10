"""Exact nearest vectors for many queries: blocks of one cluster each, of which the triangle inequality skips those too far away.

The vectors are dealt to parts that a task can hold, and every part is asked by all queries, some hundred at a time: a product of
two matrices gives their scores. So what moves is the vectors once and the queries once for each part, never a pair. The work is
the product, which grows with queries times vectors where nothing can be skipped.

Angles between unit vectors are a metric. A block's vectors lie within an angle of its cluster's centre, so none of them is
nearer to a query than the centre's angle less that radius. Queries ask the likeliest blocks of a part first, which gives them
`top` scores to beat, and then only the blocks whose bound can beat them. Centres are fitted to a bounded sample; they set how
much is skipped, never what is found.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import pieces

SAMPLE = 20_000  # vectors that centres are fitted to, at most
CENTRES = 256  # at most
PART = 32 << 20  # bytes of vectors that a task holds, about
LEAST = 4 << 20  # bytes below which a part is not cut to use more cores
BLOCK = 1024  # vectors of a block, at most
MANY = 1024  # queries that ask together, at most
PAIRS = 1 << 20  # entries of the vectors whose scores are computed anew at a time
SLACK = 1e-9  # of a score, for rounding
BEND = 1e-7  # of an angle, for rounding: arccos has half as many digits near 1
ODD = -1  # the cluster of vectors with entries that are not finite; always asked


def units(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors, and which rows have a direction: zero vectors have none."""
    with np.errstate(invalid="ignore", over="ignore"):
        norm = np.sqrt((m * m).sum(1))
        ok = norm != 0
        return m[ok] / norm[ok, None], ok


def centres(sample: np.ndarray, most: int, rounds: int = 6) -> np.ndarray:
    """Spherical k-means of finite unit vectors."""
    k = max(1, min(most, int(len(sample) ** 0.5)))
    out = sample[:: max(1, len(sample) // k)][:k].copy()
    for _ in range(rounds):
        own = (sample @ out.T).argmax(1)
        total = np.zeros_like(out)
        np.add.at(total, own, sample)
        norm = np.sqrt((total * total).sum(1))
        out[norm > 0] = total[norm > 0] / norm[norm > 0, None]
    return out


def angles(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(a @ b.T, -1, 1))


def dots(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Row by row; equal rows have equal results, whatever stands beside them."""
    return (q * v).sum(1)


def blocks(cluster: np.ndarray, ids: np.ndarray, m: np.ndarray, middle: np.ndarray | None) -> list[tuple]:
    """(ids, unit vectors, centre, radius) of up to BLOCK vectors of a cluster; rows are sorted by cluster and id. No centre: always asked."""
    out = []
    edges = [0, *(np.flatnonzero(np.diff(cluster)) + 1), len(cluster)]
    for lo, hi in zip(edges[:-1], edges[1:], strict=True):
        for at in range(lo, hi, BLOCK):
            some = m[at : min(hi, at + BLOCK)]
            c = None if middle is None or cluster[at] == ODD else middle[cluster[at]]
            out.append((ids[at : at + len(some)], some, c, np.pi if c is None else float(angles(some, c[None]).max()) + BEND))
    return out


def contenders(score: np.ndarray, bar: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of scores that can be among the `top` of their row, those of equal last scores included; columns are in the order of ids.

    NaN is the largest, as in Spark; of a row's NaNs the first `top` are enough, as they are equal.
    """
    nan = np.isnan(score)
    if nan.any():
        score = np.where(nan, np.where(nan.cumsum(1) <= top, np.inf, -np.inf), score)
    may = score >= np.minimum(bar, np.finfo(float).max)[:, None] - SLACK
    full = np.flatnonzero(may.sum(1) > 2 * top)
    if len(full):
        last = np.partition(score[full], score.shape[1] - top, axis=1)[:, score.shape[1] - top]
        may[full] &= score[full] >= np.minimum(last, np.finfo(float).max)[:, None] - SLACK
    return np.nonzero(may)


def ask(q: np.ndarray, held: list[tuple], top: int, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(query's row, vector's id, score) of each query's `top` vectors in the blocks, at least `least`, ties by id; and the pairs whose score was computed."""
    best = np.full((len(q), top), -np.inf)  # NaN stands as infinity here
    names = np.full((len(q), top), np.iinfo(np.int64).max)
    bar = np.full(len(q), float(least))
    reach = np.full((len(held), len(q)), np.inf)  # no score of the block is larger
    bound = [k for k, b in enumerate(held) if b[2] is not None]
    finite = np.isfinite(q).all(1)
    if bound and finite.any():
        away = angles(np.array([held[k][2] for k in bound]), q[finite]) - np.array([held[k][3] for k in bound])[:, None]
        reach[np.ix_(bound, finite)] = np.cos(np.clip(away, 0, np.pi))
    asked = 0
    for k in np.argsort(-reach.mean(1), kind="stable"):
        ids, m, _, _ = held[k]
        rows = np.flatnonzero(reach[k] >= bar - SLACK)
        if not len(rows):
            continue
        asked += len(rows) * len(ids)
        mine = q if len(rows) == len(q) else q[rows]
        score = mine @ m.T
        some = np.flatnonzero(~(score.max(1) < bar[rows] - SLACK))  # a NaN is the maximum
        if not len(some):
            continue
        rows, mine = rows[some], mine[some]
        i, j = contenders(score[some], bar[rows], top)
        step = max(1, PAIRS // q.shape[1])
        exact = np.concatenate([dots(mine[i[at : at + step]], m[j[at : at + step]]) for at in range(0, len(i), step)])
        exact = np.where(np.isnan(exact), np.inf, exact)
        i, j, exact = (x[exact >= least] for x in (rows[i], j, exact))
        again = np.unique(i)
        old_i, old_j = np.nonzero(best[again] > -np.inf)
        i, own, exact = np.concatenate([again[old_i], i]), np.concatenate([names[again[old_i], old_j], ids[j]]), np.concatenate([best[again[old_i], old_j], exact])
        order = np.lexsort((own, -exact, i))
        i, own, exact = i[order], own[order], exact[order]
        place = np.arange(len(i)) - np.searchsorted(i, i)
        i, own, exact, place = (x[place < top] for x in (i, own, exact, place))
        best[i, place], names[i, place] = exact, own
        bar[again] = np.maximum(best[again, top - 1], least)
    i, place = np.nonzero(best > -np.inf)
    score = best[i, place]
    return i, names[i, place], np.where(np.isinf(score), np.nan, score), asked


def vectors_of(df: DataFrame, key: str) -> DataFrame:
    """(dim, id, x) of the rows that hold a vector: no nulls, and at least one entry."""
    x = F.col("embedding").cast("array<double>")
    rows = df.select(F.col(key).cast("long").alias("id"), x.alias("x")).where("id IS NOT NULL AND x IS NOT NULL")
    return rows.where((F.size("x") > 0) & ~F.exists("x", lambda c: c.isNull())).select(F.size("x").alias("dim"), "id", "x")


def by_length(dims: np.ndarray, entries: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, rows, matrix) of vectors that lie one after the other."""
    for dim in np.unique(dims):
        mine = dims == dim
        yield int(dim), np.flatnonzero(mine), (entries if mine.all() else entries[np.repeat(mine, dims)]).reshape(-1, dim)


def entries(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return np.asarray((column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).flatten())


def search(vectors: DataFrame, queries: DataFrame, top: int = 5, min_score: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """(query_id, vec_id, score) of each query's `top` vectors by cosine, at least min_score, ties by vec_id; and a row with `asked` and `all_pairs`.

    Both frames have vec_id and embedding; ids are unique. Rows without id or direction take no part, and vectors of other
    lengths than a query's are not its neighbours. Of equal vectors only the `top` smallest ids are asked, as no query can answer
    another. The second frame counts pairs whose score was computed, and all pairs. Both are computed when they are read.
    """
    sc = vectors.sparkSession.sparkContext
    v, q = vectors_of(vectors, "vec_id"), vectors_of(queries, "vec_id")
    fitted: dict[int, np.ndarray] = {}
    sample = v.orderBy(F.xxhash64("id")).limit(SAMPLE).select("dim", "x").toArrow()
    for dim, _, m in by_length(np.asarray(sample["dim"]), entries(sample["x"])):
        m, _ = units(m)
        m = m[np.isfinite(m).all(1)]
        if len(m):
            fitted[dim] = centres(m, CENTRES)
    shared = sc.broadcast(fitted)  # CENTRES vectors of each length

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(dim, id, cluster, unit) of vectors with a direction."""
        for b in (some for batch in batches for some in pieces(batch)):
            ids = np.asarray(b.column(1))
            for dim, rows, m in by_length(np.asarray(b.column(0)), entries(b.column(2))):
                m, ok = units(m)
                if not len(m):
                    continue
                cluster = (np.nan_to_num(m) @ shared.value[dim].T).argmax(1) if dim in shared.value else np.full(len(m), ODD)
                cluster = np.where(np.isfinite(m).all(1), cluster, ODD).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(m), dim, np.int32)), pa.array(ids[rows[ok]]), pa.array(cluster), pa.array([x.tobytes() for x in m], pa.binary())], ["dim", "id", "cluster", "unit"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A part's vectors of a length, sorted by cluster and id, then the queries of that length: the best of each, and a row of pairs asked."""
        at, some, held, asked = None, [], None, 0
        for b in (x for batch in batches for x in pieces(batch)):
            dims, asks, cluster, ids = (np.asarray(b.column(k).to_numpy(zero_copy_only=False)) for k in range(4))
            edges = [0, *(np.flatnonzero(np.diff(dims) | (asks[1:] != asks[:-1])) + 1), len(dims)] if len(dims) else [0]
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                dim = int(dims[lo])
                if dim != at:
                    at, some, held = dim, [], None
                m = np.frombuffer(b"".join(b.column(4).slice(lo, hi - lo).to_pylist())).reshape(-1, dim)
                if not asks[lo]:
                    some.append((cluster[lo:hi], ids[lo:hi], m))
                    continue
                if held is None:
                    held = blocks(*(np.concatenate(c) for c in zip(*some, strict=True)), shared.value.get(dim)) if some else []
                    some = []
                for k in range(0, len(m) if held else 0, MANY):
                    i, own, score, n = ask(m[k : k + MANY], held, top, min_score)
                    asked += n
                    yield pa.RecordBatch.from_arrays([pa.array(ids[lo + k + i]), pa.array(own), pa.array(score), pa.nulls(len(i), pa.int64())], ["query_id", "vec_id", "score", "asked"])
        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in ((None, pa.int64()), (None, pa.int64()), (None, pa.float64()), (asked, pa.int64()))], ["query_id", "vec_id", "score", "asked"])

    size = v.agg(F.coalesce(F.sum(F.col("dim").cast("long") * 8), F.lit(0))).first()[0]
    parts = max(1, math.ceil(size / PART), min(2 * sc.defaultParallelism, math.ceil(size / LEAST)))
    placed = "dim int, id long, cluster int, unit binary"
    first = F.row_number().over(Window.partitionBy("dim", "unit").orderBy("id"))
    own = v.mapInArrow(assign, placed)
    few = own.withColumn("n", first).where(F.col("n") <= top).select(F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int").alias("part"), "dim", F.lit(False).alias("asks"), "cluster", "id", "unit")
    asking = q.mapInArrow(assign, placed)
    sent = asking.select(F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), "dim", F.lit(True).alias("asks"), "cluster", "id", "unit")
    dealt = few.unionByName(sent).repartitionById(parts, "part").drop("part").sortWithinPartitions("dim", "asks", "cluster", "id")
    found = dealt.mapInArrow(meet, "query_id long, vec_id long, score double, asked long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    out = found.where("query_id IS NOT NULL").withColumn("rank", rank).where(F.col("rank") <= top).select("query_id", "vec_id", "score")
    pairs = found.agg(F.coalesce(F.sum("asked"), F.lit(0)).alias("asked"))
    every = asking.groupBy("dim").count().join(own.groupBy("dim").agg(F.count("*").alias("n")), "dim").agg(F.coalesce(F.sum(F.col("count") * F.col("n")), F.lit(0)).alias("all_pairs"))
    return out, pairs.crossJoin(F.broadcast(every))  # one row each
