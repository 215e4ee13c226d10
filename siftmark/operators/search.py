"""Lookups, lists and similarity search."""

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fixed import CONFIDENCE
from ..functions.hashing import cosine, hamming
from . import grams, nearest


def first_by_hash(files: DataFrame, library: DataFrame) -> DataFrame:
    """Each file with the first sample of equal content."""
    first = library.groupBy("sha256").agg(F.min("sample_id").alias("sample_id"))
    return files.join(first, "sha256")


def near_by_hamming(files: DataFrame, library: DataFrame, most: int = 3, shared: int = 3) -> DataFrame:
    """(doc_id, sample_id, distance): the nearest other sample within `most` bits, the smallest id of equal ones.

    Both sides have doc_id/sample_id and bits, and are read more than once. Values, not rows, are joined: the 64 bits are cut
    into most + shared blocks, of which `shared` are equal in two near values, whichever bits differ. A key is such a choice
    of blocks, so of about 64 * shared / (most + shared) bits, which few values have in common by chance. Keys are merged, never
    broadcast: Spark takes the size of a side before its values are exploded to keys, far less than what would be sent.
    """
    n = most + shared
    edges = [64 * i // n for i in range(n + 1)]
    keep = [sum(((1 << edges[i + 1]) - (1 << edges[i])) for i in choice) for choice in combinations(range(n), shared)]
    masks = [m - (1 << 64) if m >> 63 else m for m in keep]
    keys = lambda c: F.explode(F.array(*[F.struct(F.lit(i).alias("i"), c.bitwiseAND(F.lit(m)).alias("v")) for i, m in enumerate(masks)]))
    a = files.select(F.col("bits").alias("x")).distinct().select("x", keys(F.col("x")).alias("b"))
    few = library.select(F.col("bits").alias("y"), "sample_id", F.row_number().over(Window.partitionBy("bits").orderBy("sample_id")).alias("n")).where("n <= 2")
    b = few.groupBy("y").agg(F.array_sort(F.collect_list("sample_id")).alias("ids")).select("y", "ids", keys(F.col("y")).alias("b"))
    pairs = a.hint("merge").join(b.hint("merge"), "b").select("x", "y", "ids", hamming(F.col("x"), F.col("y")).alias("distance")).where(F.col("distance") <= most).distinct()
    near = files.join(pairs, F.col("bits") == F.col("x")).select("doc_id", "distance", F.explode("ids").alias("sample_id")).where("sample_id != doc_id")
    return near.groupBy("doc_id").agg(F.min(F.struct("distance", "sample_id")).alias("m")).select("doc_id", "m.sample_id", "m.distance")


def at_least(level: str, column: str = "confidence_level") -> Column:
    if level not in CONFIDENCE:
        raise ValueError(f"no confidence level {level}")
    return F.col(column).isin(*CONFIDENCE[CONFIDENCE.index(level) :])


def confidence_hist(results: DataFrame) -> DataFrame:
    """Results by report and confidence."""
    return results.groupBy("report_id", "confidence_level").agg(F.count("*").alias("n_results"))


def list_results(results: DataFrame, reports: DataFrame, host: str | None = None, level: str | None = None, limit: int = 200) -> DataFrame:
    """Newest first; a limit outside 1 to 1000 is ignored."""
    out = results.join(reports.select("report_id", "host_id", "created_at"), "report_id")
    out = out.where(F.col("host_id") == host) if host else out
    out = out.where(at_least(level)) if level else out
    return out.orderBy(F.desc("created_at"), "id").limit(limit if 1 <= limit <= 1000 else 200)


def semantic_search(vectors: DataFrame, query: list[float], top: int = 5, min_score: float = 0.0) -> DataFrame:
    """The most similar vectors by cosine; top is brought into 1 to 50, and lower scores than min_score are left out."""
    top = 5 if top <= 0 else min(top, 50)
    q = F.array(*[F.lit(float(x)) for x in query])
    scored = vectors.select("vec_id", cosine(F.col("embedding").cast("array<double>"), q).alias("score")).where(F.col("score") >= min_score)
    return scored.orderBy(F.desc("score"), "vec_id").limit(top)


def semantic_search_all(vectors: DataFrame, queries: DataFrame, top: int = 5, min_score: float = 0.0) -> DataFrame:
    """(query_id, vec_id, score): semantic_search for each row of queries (vec_id, embedding; ids are unique) over all vectors."""
    return nearest.search(vectors, queries, 5 if top <= 0 else min(top, 50), min_score)[0]


def find_samples(samples: DataFrame, text: str | None = None, kind: str | None = None, risk: str | None = None, limit: int = 100, key: str = "sensitive_file_id", index: DataFrame | None = None, more: dict[str, Column] | None = None) -> DataFrame:
    """Words in name or text and words in the type, both without regard to case, and the risk level, each if given; newest first, ties by key.

    index: the samples' grams.indexed(), by which words of three characters or more are looked up. more: columns that are made
    of the rows that are returned only, such as a text's hash.
    """
    has = lambda c, x: F.contains(F.lower(c), F.lit(x.lower()))
    out = samples
    if text and index is not None:
        out = grams.holding(out, index, text, key)
    elif text:
        out = out.where(has("file_name", text) | has("text", text))
    out = out.where(has("sensitive_type", kind)) if kind else out
    out = out.where(F.col("risk_level") == risk) if risk else out
    return out.orderBy(F.desc("uploaded_at"), key).limit(limit).withColumns(more or {}).drop("text")


def feature_search(features: DataFrame, samples: DataFrame, query: list[float], top: int = 5, min_score: float = 0.0, key: str = "sensitive_file_id") -> DataFrame:
    """semantic_search() over the features that have a vector and its id, with the samples' names where there are such."""
    vectors = features.where((F.size("embedding") > 0) & (F.col("embedding_id") != "")).withColumn("vec_id", F.col(key))
    best = semantic_search(vectors, query, top, min_score)
    names = samples.select(F.col(key).alias("vec_id"), "file_name", "sensitive_type", "risk_level")
    return best.join(names, "vec_id", "left").orderBy(F.desc("score"), "vec_id")


def lookup_hash(samples: DataFrame, sha256: str, key: str = "sample_id") -> DataFrame:
    """The first sample of that content, by key; no row where there is none."""
    return samples.where(F.col("sha256") == sha256).orderBy(key).limit(1)


def query_file(samples: DataFrame, key: str, file_hash: str = "", file_name: str = "", file_path: str = "", index: DataFrame | None = None) -> DataFrame:
    """One row: is such a file known? By hash if given, else by a part of the name, else by the last part of the path.

    Names are compared without regard to case; the first sample by key answers. index: the samples' grams.indexed().
    """
    file_hash, file_name, file_path = file_hash.strip(), file_name.strip(), file_path.strip()
    name = file_name or file_path.rstrip("/").rpartition("/")[2]
    if not file_hash and not name:
        raise ValueError("a hash or a name is needed")
    how = "sha256" if file_hash else "filename_like" if file_name else "filepath_basename_like"
    held = F.col("sha256") == file_hash if file_hash else F.contains(F.lower("file_name"), F.lit(name.lower()))
    asked = samples.where(held) if file_hash or index is None else grams.holding(samples, index, name, key, ("file_name",))
    first = asked.agg(F.min_by(F.struct(F.col(key).alias("sensitive_file_id"), "file_name", "sensitive_type", "risk_level"), key).alias("s"))
    return first.select(F.col("s").isNotNull().alias("sensitive"), F.when(F.col("s").isNotNull(), how).alias("match_type"), "s.*")
