"""The engine's queries over the standard tables, and the same in DuckDB's SQL."""

import io
import json
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed, hashing
from ..functions.fixed import BUILTIN_RULES
from ..operators import generate, grams, library, match, scanning, search, segment, words
from ..operators.guard import guarded
from ..sources import extract
from ..sources.shared import pieces
from ..streaming import events as ev

STOPS = ["the", "and", "this", "that", "with", "for", "from", "have", "has"]
TERMS = ["license", "token", "password"]
KEYWORDS = ["the", "que", "der", "license"]
COMBINED = [("keyword", ["token", "license", "under"], 1), ("regex", fixed.TEMPLATES[3][3])]
HINTS = {"secrets": ["token", "password"], "licenses": ["License", "license"]}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def content_scan(spark, d):
    docs = match.content_scan(scanning.spread(read(spark, d, "documents").select("doc_id", "text")), "doc_id").withColumnRenamed("doc_id", "id").withColumn("origin", F.lit("documents"))
    pages = match.content_scan(read(spark, d, "pages").withColumnRenamed("html", "text"), "page_id").withColumnRenamed("page_id", "id").withColumn("origin", F.lit("pages"))
    return docs.unionByName(pages)


LUHN = "list_sum(list_transform(range(1, length(m) + 1), lambda i: CASE WHEN (length(m) - i) % 2 = 1 THEN (CAST(m[i] AS INT) * 2) // 10 + (CAST(m[i] AS INT) * 2) % 10 ELSE CAST(m[i] AS INT) END)) % 10 = 0"


def content_sql() -> str:
    parts = []
    for origin, key, text in (("documents", "doc_id", "text"), ("pages", "page_id", "html")):
        for n, p, r in BUILTIN_RULES:
            found = f"regexp_extract_all({text}, '{p}')"
            found = f"list_filter({found}, lambda m: {LUHN})" if n == "bank_card" else found
            parts.append(f"SELECT {key} AS id, '{n}' AS rule_name, '{r}' AS risk_level, CAST(len({found}) AS INT) AS match_count, '{origin}' AS origin FROM {origin}")
    return "SELECT * FROM (" + " UNION ALL ".join(parts) + ") WHERE match_count > 0"


def regex_test(spark, d):
    test = match.regex_test(F.col("text"), r"\b[A-Z][a-z]+\b")
    return read(spark, d, "conversations").select("conv_id", "turn", test.alias("t")).select("conv_id", "turn", F.col("t.count").alias("n_matches"), F.array_join("t.matches", ",").alias("matches"), "t.error")


def simhash(spark, d):
    return scanning.spread(read(spark, d, "documents").select("doc_id", "text")).select("doc_id", hashing.simhash("text").alias("simhash"))


SIMHASH_SQL = r"""
WITH tok AS (SELECT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{Nd}]+')) AS t FROM documents),
own AS (SELECT DISTINCT t, hex(encode(t)) AS x FROM tok),
fnv AS (SELECT t, list_reduce(list_prepend(14695981039346656037::HUGEINT, list_transform(range(0, length(x) // 2), lambda i: CAST(('0x' || substr(x, CAST(2 * i + 1 AS INT), 2)) AS HUGEINT))),
  lambda h, b: (xor(h, b) * 1099511628211::HUGEINT) % 18446744073709551616::HUGEINT) AS h FROM own),
n AS (SELECT doc_id, t, count(*) AS n FROM tok GROUP BY ALL),
votes AS (SELECT doc_id, k, sum(CASE WHEN (h // (1::HUGEINT << k::INT)) % 2 = 1 THEN n ELSE -n END) AS v FROM n JOIN fnv USING (t), range(64) AS r(k) GROUP BY ALL),
bits AS (SELECT doc_id, CAST(sum(CASE WHEN v > 0 THEN 1::HUGEINT << k::INT ELSE 0 END) AS UBIGINT) AS b FROM votes GROUP BY doc_id)
SELECT doc_id, lower(lpad(hex(coalesce(b, 0)), 16, '0')) AS simhash FROM documents LEFT JOIN bits USING (doc_id)
"""


def near_duplicates(spark, d):
    own = match.materialise(simhash(spark, d).select("doc_id", hashing.simhash_bits(F.col("simhash")).alias("bits")))  # read three times
    return search.near_by_hamming(own, own.withColumnRenamed("doc_id", "sample_id"))


NEAR_SQL = f"""
WITH s AS (SELECT doc_id, CAST('0x' || simhash AS UBIGINT) AS b FROM ({SIMHASH_SQL})),
p AS (SELECT a.doc_id, b.doc_id AS sample_id, bit_count(CAST(xor(a.b, b.b) AS BIT)) AS distance FROM s a JOIN s b ON a.doc_id != b.doc_id)
SELECT doc_id, sample_id, CAST(distance AS INT) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY distance, sample_id) AS n FROM p WHERE distance <= 3) WHERE n = 1
"""


def sha_match(spark, d):
    docs = read(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"))
    return search.first_by_hash(docs, docs.withColumnRenamed("doc_id", "sample_id"))


def duplicates(spark, d):
    return library.duplicates(read(spark, d, "documents"))


def fingerprint(spark, d):
    b = read(spark, d, "benchmark")
    return b.select("item_id", F.sha2("text", 256).alias("sha256"), hashing.simhash("text").alias("simhash"), F.octet_length("text").alias("text_length"))


def keyword_match(spark, d):
    hits = match.keyword_hits(F.col("text"), KEYWORDS)
    return read(spark, d, "documents").select("doc_id", F.size(hits).alias("n_hits"), F.array_join(hits, ",").alias("hits")).where("n_hits >= 2")


def library_words(spark, d):
    """All distinct words of documents as a library: how many of them each page holds, anywhere in its text."""
    own = read(spark, d, "documents").select(F.explode(F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))).alias("word")).distinct()
    held = words.with_words(scanning.spread(read(spark, d, "pages").select("page_id", "html")), own, "page_id", "html")
    return held.select("page_id", F.size("held").alias("n_words"), F.aggregate("held", F.lit(0), lambda n, w: n + F.length(w)).alias("n_chars"), F.array_min("held").alias("first_word"), F.array_max("held").alias("last_word"))


#: A word without white space stands in a text if it is a part of one of the text's words.
LIBRARY_WORDS_SQL = r"""
WITH lib AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS word FROM documents),
own AS (SELECT DISTINCT page_id, unnest(regexp_extract_all(html, '[^\x20\x09-\x0D]+')) AS t FROM pages),
parts AS (SELECT DISTINCT t, substr(t, CAST(i AS INT), CAST(n AS INT)) AS word FROM (SELECT t, i, unnest(range(1, least(length(t) - i + 2, (SELECT max(length(word)) + 1 FROM lib)))) AS n FROM (SELECT t, unnest(range(1, length(t) + 1)) AS i FROM (SELECT DISTINCT t FROM own)))),
held AS (SELECT DISTINCT page_id, word FROM own JOIN parts USING (t) JOIN lib USING (word))
SELECT page_id, CAST(count(word) AS INT) AS n_words, CAST(coalesce(sum(length(word)), 0) AS INT) AS n_chars, min(word) AS first_word, max(word) AS last_word FROM pages LEFT JOIN held USING (page_id) GROUP BY page_id
"""


def combined_match(spark, d):
    t = F.coalesce("text", F.lit(""))
    return read(spark, d, "documents").select("doc_id", match.combined_match(t, COMBINED).alias("both"), match.combined_match(t, COMBINED, "OR").alias("either"))


def semantic_labels(spark, d):
    labels = match.infer_labels(F.coalesce("text", F.lit("")), {"secrets": ["TOKEN", "password"], "licenses": ["LICENSE"], "code": ["cc-by"]})
    return read(spark, d, "documents").select("doc_id", F.array_join(labels, "/").alias("labels"))


def keyword_extract(spark, d):
    """Keywords of documents as samples: their source is the type, their language the description."""
    docs = read(spark, d, "documents").select("doc_id", "text", F.col("source").alias("sensitive_type"), F.col("lang").alias("description"))
    return generate.keywords(docs, "doc_id", terms=TERMS, stop_words=STOPS).select("doc_id", "word", "score", "place")


def keyword_sql(kind: str) -> str:
    """Words by place of (doc_id, t, k, ds), the text, type and description of d."""
    stops, terms = (", ".join(f"'{x}'" for x in xs) for xs in (STOPS, TERMS))
    held = lambda c, n: f"CASE WHEN contains(lower({c}), lower(x)) THEN {n} ELSE 0 END"
    whole = "t || ' ' || k || ' ' || ds"
    return rf"""d AS (SELECT doc_id, coalesce(text, '') AS t, {kind} AS k, coalesce(lang, '') AS ds, CASE WHEN doc_id % 2 = 0 THEN 'low' ELSE 'medium' END AS risk FROM documents),
w AS (SELECT doc_id, unnest(regexp_extract_all({whole}, '[\p{{L}}\p{{Nd}}]+')) AS word FROM d),
own AS (SELECT doc_id, word, count(*) AS s FROM w WHERE length(word) BETWEEN 2 AND 32 AND NOT regexp_full_match(word, '\p{{Nd}}+') AND lower(word) NOT IN ({stops}) GROUP BY ALL),
held AS (SELECT doc_id, x AS word, {held(whole, 80)} + {held("k", 30)} + {held("ds", 40)} AS s FROM d, (SELECT unnest([{terms}]) AS x)),
b AS (SELECT doc_id, word, CAST(sum(s) AS BIGINT) AS score FROM (SELECT * FROM own UNION ALL SELECT * FROM held WHERE s > 0) GROUP BY ALL),
placed AS (SELECT doc_id, word, score, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, word) AS INT) AS place FROM b)"""


KEYWORD_SQL = f"""WITH {keyword_sql("coalesce(source, '')")} SELECT doc_id, word, score, place FROM placed WHERE place <= 12"""


def rules_of(spark, d):
    """Documents as the rules of a store: each tenth is builtin, labels tell which are off or gone."""
    marks = read(spark, d, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    n = F.col("doc_id")
    return read(spark, d, "documents").join(marks, "doc_id", "left").select(
        F.concat(F.lit("rule_"), n.cast("string")).alias("rule_id"), F.when(n % 4 == 0, "regex").otherwise("keyword").alias("rule_type"), F.coalesce("lang", F.lit("")).alias("sensitive_type"), F.when(n % 3 == 0, "high").otherwise("low").alias("risk_level"),
        F.when(n % 10 == 0, "builtin").otherwise("sample").alias("source"), (n % 50).cast("int").alias("version"), (F.coalesce("quality", F.lit(1)) == 1).alias("enabled"), (F.coalesce("toxic", F.lit(0)) == 1).alias("deleted"),
    )


RULES_SQL = """SELECT doc_id, 'rule_' || doc_id AS rule_id, CASE WHEN doc_id % 4 = 0 THEN 'regex' ELSE 'keyword' END AS rule_type, coalesce(lang, '') AS sensitive_type, CASE WHEN doc_id % 3 = 0 THEN 'high' ELSE 'low' END AS risk_level,
CASE WHEN doc_id % 10 = 0 THEN 'builtin' ELSE 'sample' END AS source, CAST(doc_id % 50 AS INT) AS version, coalesce(quality, 1) = 1 AS enabled, coalesce(toxic, 0) = 1 AS deleted
FROM documents LEFT JOIN (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id) USING (doc_id)"""


def rule_sync(spark, d):
    """What a host at version 20 gets: live rules, ids that are gone, and the newest version."""
    live, deleted, newest = library.sync(rules_of(spark, d), 20)
    rows = live.select("rule_id", F.lit("live").alias("state")).unionByName(deleted.select("rule_id", F.lit("deleted").alias("state")))
    return rows.crossJoin(F.broadcast(newest))  # one row


def changes_of(spark, d):
    """Labels as changes: toxic documents' rules are deleted, others come back with a higher risk; some labels repeat."""
    at = read(spark, d, "labels").select(F.concat(F.lit("rule_"), F.col("doc_id").cast("string")).alias("rule_id"), "quality", "toxic")
    return at.select("rule_id", (60 + F.col("quality")).cast("int").alias("version"), F.when(F.col("toxic") == 0, True).alias("enabled"), F.when(F.col("toxic") == 1, True).alias("deleted"), F.when(F.col("quality") == 1, "critical").alias("risk_level"))


CHANGED_SQL = f"""r AS ({RULES_SQL}), c AS (SELECT DISTINCT ON (rule_id) rule_id, version, toxic, risk_level FROM (SELECT 'rule_' || doc_id AS rule_id, 60 + quality AS version, toxic, CASE WHEN quality = 1 THEN 'critical' END AS risk_level FROM labels) ORDER BY rule_id, version DESC, (toxic = 0) DESC),
changed AS (SELECT r.doc_id, r.rule_id, r.source, r.rule_type, CAST(coalesce(c.version, r.version) AS INT) AS version, CASE c.toxic WHEN 1 THEN false WHEN 0 THEN true ELSE r.enabled END AS enabled, CASE c.toxic WHEN 1 THEN true WHEN 0 THEN false ELSE r.deleted END AS deleted, coalesce(c.risk_level, r.risk_level) AS risk_level FROM r LEFT JOIN c USING (rule_id))"""


def rule_delete(spark, d):
    """Deletions and updates of many rules at once."""
    return library.change(rules_of(spark, d), changes_of(spark, d)).select("rule_id", "version", "enabled", "deleted", "risk_level")


def segmentation(spark, d):
    """Pages' words written without spaces, cut by a dictionary of all documents' words: how many words there were, and how many are found again."""
    word = r"[a-z]+"
    docs = read(spark, d, "documents").select(F.lower(F.coalesce("text", F.lit(""))).alias("t"))
    counts = docs.select(F.explode(F.regexp_extract_all("t", F.lit(word), F.lit(0))).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    dictionary = {r.w: r.n for r in counts.orderBy(F.desc("n"), "w").limit(segment.MOST_WORDS).collect()}
    pages = read(spark, d, "pages").select("page_id", F.slice(F.regexp_extract_all(F.lower(F.coalesce("html", F.lit(""))), F.lit(word), F.lit(0)), 1, 1 << 30).alias("words"))
    joined = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size("words") - 1) / 8).cast("int"))), lambda k: F.array_join(F.slice("words", k * 8 + 1, F.lit(8)), ""))
    cut = segment.segmented(pages.withColumn("runs", joined), "runs", dictionary)
    return cut.select("page_id", F.size("words").cast("long").alias("n_words"), F.size("cut").cast("long").alias("n_cut"), (F.size("words") - F.size(F.array_except("words", "cut")) - (F.size("words") - F.size(F.array_distinct("words")))).cast("long").alias("n_found"))


def tag_upsert(spark, d):
    docs = read(spark, d, "documents").select(F.col("source").alias("file_path"), F.sha2("text", 256).alias("file_hash"), F.col("doc_id").alias("at"))
    first = docs.groupBy("file_path", "file_hash").agg(F.min("at").alias("first_detected_at"), F.max("at").alias("last_detected_at")).withColumn("match_score", F.lit(10))
    again = first.where("match_score >= 0").select("file_path", "file_hash", (F.col("first_detected_at") + 100).alias("first_detected_at"), (F.col("last_detected_at") + 100).alias("last_detected_at"), F.lit(20).alias("match_score"))
    return library.upsert_tags(first, again)


def semantic_search(spark, d):
    v = read(spark, d, "embeddings")
    return search.semantic_search(v, v.orderBy("vec_id").first()["embedding"]).select("vec_id", F.round("score", 6).alias("score"))


def semantic_search_all(spark, d):
    """Every vector whose id is divisible by 20 asks all vectors."""
    v = read(spark, d, "embeddings")
    return search.semantic_search_all(v, v.where("vec_id % 20 = 0")).withColumn("score", F.round("score", 6))


def as_samples(spark, d):
    """Documents as stored samples: ids and dates by doc_id, names by source."""
    return read(spark, d, "documents").select(
        F.col("doc_id").alias("sensitive_file_id"), F.concat("source", F.lit("-"), F.col("doc_id").cast("string"), F.lit(".TXT")).alias("file_name"), F.sha2("text", 256).alias("sha256"), "text", F.col("lang").alias("sensitive_type"),
        F.when(F.col("doc_id") % 3 == 0, "high").otherwise("low").alias("risk_level"), F.floor(F.col("doc_id") / 10).alias("uploaded_at"),
    )


SAMPLES_SQL = "SELECT doc_id AS sensitive_file_id, source || '-' || doc_id || '.TXT' AS file_name, sha256(text) AS sha256, text, lang AS sensitive_type, CASE WHEN doc_id % 3 = 0 THEN 'high' ELSE 'low' END AS risk_level, CAST(floor(doc_id / 10) AS BIGINT) AS uploaded_at FROM documents"


def list_samples(spark, d):
    return search.find_samples(as_samples(spark, d).drop("sha256"), limit=50, more={"sha256": F.sha2("text", 256)})


def find_samples(spark, d):
    return search.find_samples(as_samples(spark, d), "LICENSED under", "E", "low")


def indexed_samples(spark, d):
    """Samples that hold words, found by an index of trigrams: as the plain search finds them, and names by a part of them."""
    docs = as_samples(spark, d)
    index = match.materialise(grams.indexed(docs, "sensitive_file_id"))
    found = search.find_samples(docs, "LICENSED under", "E", "low", index=index).select("sensitive_file_id", F.lit("text").alias("by"))
    named = search.query_file(docs, "sensitive_file_id", file_name="-17.t", index=index).select("sensitive_file_id", F.lit("name").alias("by"))
    short = grams.holding(docs, index, "é", "sensitive_file_id").select("sensitive_file_id", F.lit("short").alias("by"))
    return found.unionByName(named).unionByName(short)


def lookup_hash(spark, d):
    """The sample with the content of the smallest document, and none for a hash of nothing."""
    docs = as_samples(spark, d)
    known = docs.where("sha256 IS NOT NULL").agg(F.min_by("sha256", "sensitive_file_id")).first()[0] or ""
    hit = search.lookup_hash(docs, known, "sensitive_file_id").unionByName(search.lookup_hash(docs, "0" * 64, "sensitive_file_id"))
    return hit.select("sensitive_file_id", "file_name", "sha256")


def list_tags(spark, d):
    """Documents as tags, of which the sensitive ones are listed."""
    tags = read(spark, d, "documents").select(F.concat("source", F.lit("/"), F.col("doc_id").cast("string")).alias("file_path"), (F.col("doc_id") % 7).cast("int").alias("match_score"), (F.col("doc_id") % 3 == 0).alias("sensitive"))
    return library.list_tags(tags, True)


def rule_seed(spark, d):
    """A store that lacks some builtin rules and has edited others, after seeding; and again, which changes nothing."""
    rules = rules_of(spark, d)
    builtin = rules.where("source = 'builtin'")
    held = rules.where("NOT (source = 'builtin' AND rule_type = 'regex')").withColumn("risk_level", F.when(F.col("version") == 30, "critical").otherwise(F.col("risk_level")))
    return library.seed(library.seed(held, builtin), builtin).select("rule_id", "risk_level", "enabled")


NAMES = ("a/b.txt", "", "/abs", "../up", "a/../../b", "a/../b", "..\\w", ".")
RISKS = (" HIGH ", "low", "odd", "", "Critical", "info", "MEDIUM", "none")


def upload_check(spark, d):
    """Why files of these names and sizes may not be uploaded, and their risk levels brought to form; documents give the turns and sizes."""
    of = lambda values: F.get(F.array(*map(F.lit, values)), (F.col("doc_id") % 8).cast("int"))
    docs = read(spark, d, "documents").select("doc_id", F.coalesce(F.length("text"), F.lit(0)).alias("size"))
    return docs.select("doc_id", extract.upload_error(of(NAMES), F.col("size"), 3000).alias("reason"), library.normal_risk(of(RISKS)).alias("risk_level"))


def template_rules(spark, d):
    """The five templates over documents whose type or description names a trigger of one of them."""
    kinds = F.array(*[F.lit(t[5][0]) for t in fixed.TEMPLATES], F.lit("other"))
    docs = scanning.spread(read(spark, d, "documents")).select("doc_id", "text", F.get(kinds, (F.col("doc_id") % 6).cast("int")).alias("sensitive_type"), F.lit("low").alias("risk_level"), F.when(F.col("doc_id") % 4 == 0, "不得披露").alias("description"))
    return generate.rules(docs, "doc_id").where("rule_type = 'combined'").select("doc_id", "place", "rule_name", "sensitive_type", "risk_level", F.sha2("content", 256).alias("content_sha256"))


def template_sql() -> str:
    kinds = "[" + ", ".join(f"'{t[5][0]}'" for t in fixed.TEMPLATES) + ", 'other']"
    parts = []
    for i, (n, words, least, pattern, r, triggers) in enumerate(fixed.TEMPLATES):
        content = json.dumps({"logic": "AND", "conditions": [{"type": "keyword", "value": list(words), "min_hits": least}, {"type": "regex", "value": pattern}]}, ensure_ascii=False).replace("'", "''")
        seen = " OR ".join(f"contains({c}, '{w}')" for w in triggers for c in ("t", "ds", "k"))
        parts.append(f"SELECT doc_id, {len(BUILTIN_RULES) + 1 + i} AS place, '{n}' AS rule_name, k AS sensitive_type, '{r}' AS risk_level, sha256('{content}') AS content_sha256 FROM d WHERE {seen}")
    return f"WITH d AS (SELECT doc_id, coalesce(text, '') AS t, {kinds}[CAST(doc_id % 6 AS INT) + 1] AS k, CASE WHEN doc_id % 4 = 0 THEN '不得披露' ELSE '' END AS ds FROM documents) " + " UNION ALL ".join(parts)


def feature_search(spark, d):
    """A store's search: features without a vector or an id are left out, and samples lend their names."""
    v = read(spark, d, "embeddings")
    q = v.orderBy("vec_id").first()
    features = v.select(F.col("vec_id").alias("sensitive_file_id"), F.when(F.col("vec_id") % 5 != 1, F.col("embedding")).alias("embedding"), F.when(F.col("vec_id") % 7 != 2, F.concat(F.lit("emb_"), F.col("vec_id").cast("string"))).otherwise("").alias("embedding_id"))
    return search.feature_search(features, as_samples(spark, d), q["embedding"] if q else [1.0], 10, 0.1).withColumn("score", F.round("score", 6))


def file_labels(spark, d):
    """Labels that documents hold, the samples that bear them and the first of these."""
    held = match.label_hits(F.coalesce("text", F.lit("")), list(HINTS), HINTS)
    docs = read(spark, d, "documents").select(F.col("doc_id").cast("string").alias("path"), held.alias("labels_held"))
    hits = scanning.label_matches(docs, spark.createDataFrame(LABELLED, "sensitive_file_id string, semantic_labels array<string>, embedding_id string"))
    return hits.select("path", F.inline("label_hits"))


def event_merge(spark, d):
    return ev.merge(read(spark, d, "events")).withColumn("total", F.round("total", 4))


def top_users(spark, d):
    return ev.top_users(read(spark, d, "events"), "click", 10)


def trend(spark, d):
    return ev.trend(read(spark, d, "events"))


def event_filter(spark, d):
    """White-listed types go, and known false positives are lowered."""
    e = read(spark, d, "events").select("event_id", "user_id", "event_type", F.lit("high").alias("level"))
    kept = ev.allow(e, spark.createDataFrame([("view",)], "event_type string"), ["event_type"])
    return ev.lower_false_positives(kept, spark.createDataFrame([(1, "click", "known")], "user_id long, event_type string, reason string"), ["user_id", "event_type"])


def agent_events(spark, d):
    """Events with the fields that an agent sends, made from the table's; each tenth is sent twice."""
    e = read(spark, d, "events")
    made = e.select(
        "event_id", "ts", "user_id", "value", "event_type", F.concat(F.lit("host-"), (F.col("user_id") % 5).cast("string")).alias("host_id"), F.concat(F.lit("app"), (F.col("event_id") % 3).cast("string")).alias("process_name"),
        F.concat(F.lit("C:\\dir\\f"), (F.col("event_id") % 20).cast("string"), F.lit(".XLSX")).alias("file_path"), F.sha2((F.col("event_id") % 20).cast("string"), 256).alias("file_hash"), F.col("event_type").alias("operation"),
        F.when(F.col("event_id") % 4 == 0, "high").otherwise("low").alias("risk_level"),
    )
    return made.unionByName(made.where("event_id % 10 = 0"))


def event_alerts(spark, d):
    """The pipeline: each event once, none of a white-listed program or hour, alike ones merged, known false positives lowered."""
    e = ev.once(agent_events(spark, d))
    e = ev.allow(e, spark.createDataFrame([("app2",)], "process_name string"), ["process_name"])
    e = ev.allow_hours(e, spark.createDataFrame([(None, 22, 2), (3, 9, 12)], "user_id long, from_hour int, to_hour int"))
    a = ev.alerts(e, "1 hour").withColumnRenamed("risk_level", "level")
    known = spark.createDataFrame([("host-1", "view", "b"), ("host-1", "view", "a"), ("host-2", "click", "c")], "host_id string, operation string, reason string")
    out = ev.lower_false_positives(a, known, ["host_id", "operation"])
    return out.withColumn("files", F.array_join(F.transform("files", lambda f: f.file_path), ","))


EVENT_ALERTS_SQL = r"""
WITH e AS (SELECT event_id, ts, user_id, 'host-' || (user_id % 5) AS host_id, 'app' || (event_id % 3) AS process_name, 'C:\dir\f' || (event_id % 20) || '.XLSX' AS file_path, event_type AS operation, event_id % 4 = 0 AS grave FROM events),
k AS (SELECT * FROM e WHERE process_name != 'app2' AND NOT (hour(ts) >= 22 OR hour(ts) < 2) AND NOT (user_id = 3 AND hour(ts) >= 9 AND hour(ts) < 12)),
a AS (SELECT min(event_id) AS event_id, user_id, host_id, process_name, 'xlsx' AS file_type, operation, time_bucket(INTERVAL '1 hour', ts) AS window_start, count(*) AS n_events, count(DISTINCT file_path) AS file_count,
  array_to_string(list_sort(list_distinct(list(file_path))), ',') AS files, min(ts) AS first_ts, max(ts) AS last_ts, bool_or(grave) AS grave FROM k GROUP BY user_id, host_id, process_name, operation, time_bucket(INTERVAL '1 hour', ts)),
r AS (SELECT *, CASE WHEN grave THEN 'high' ELSE 'low' END AS was, CASE WHEN host_id = 'host-1' AND operation = 'view' THEN 'a' WHEN host_id = 'host-2' AND operation = 'click' THEN 'c' END AS reason FROM a)
SELECT event_id, user_id, host_id, process_name, file_type, operation, window_start, n_events > 1 AS is_merge_event, n_events, file_count, files, first_ts, last_ts, CASE WHEN reason IS NULL THEN was ELSE 'info' END AS level, reason, CASE WHEN reason IS NOT NULL THEN was END AS old_level FROM r
""".replace("\\\\", "\\")


def event_allow(spark, d):
    """Events whose file lies in no white-listed folder, and whose time in no white-listed range, of their user or of all."""
    path = F.concat(F.lit("C:\\d"), (F.col("user_id") % 7).cast("string"), F.lit("\\s"), (F.col("event_id") % 9).cast("string"), F.lit("/f"), (F.col("event_id") % 50).cast("string"))
    e = read(spark, d, "events").select("event_id", "ts", "user_id", path.alias("file_path"))
    e = ev.allow_paths(e, spark.createDataFrame([("C:/d1",), ("C:\\d2\\s3\\",), ("C:\\d3\\s4\\f1",), ("C:/d",)], "prefix string"))
    day = lambda n: F.expr(f"date_trunc('day', ts) + INTERVAL {n} HOURS")
    of = e.groupBy("user_id").agg(F.min("ts").alias("ts")).where("user_id % 3 = 0")
    own = of.select("user_id", day(5).alias("from_ts"), day(60).alias("to_ts"))
    every = e.agg(F.min("ts").alias("ts")).select(F.lit(None).cast("long").alias("user_id"), day(100).alias("from_ts"), day(130).alias("to_ts"))
    return ev.allow_times(e, own.unionByName(every)).select("event_id", "user_id")


EVENT_ALLOW_SQL = r"""
WITH p AS (SELECT event_id, ts, user_id, 'C:/d' || (user_id % 7) || '/s' || (event_id % 9) || '/f' || (event_id % 50) AS path FROM events),
e AS (SELECT * FROM p WHERE NOT (starts_with(path, 'C:/d1/') OR starts_with(path, 'C:/d2/s3/') OR path = 'C:/d3/s4/f1')),
own AS (SELECT user_id, date_trunc('day', min(ts)) AS d FROM e WHERE user_id % 3 = 0 GROUP BY user_id), every AS (SELECT date_trunc('day', min(ts)) AS d FROM e)
SELECT event_id, e.user_id FROM e, every LEFT JOIN own ON own.user_id = e.user_id
WHERE NOT (ts >= every.d + INTERVAL 100 HOURS AND ts < every.d + INTERVAL 130 HOURS) AND NOT coalesce(ts >= own.d + INTERVAL 5 HOURS AND ts < own.d + INTERVAL 60 HOURS, false)
"""


def departments(e):
    """Users in three departments, some in none."""
    return e.select("user_id").distinct().where("user_id % 10 != 9").withColumn("department", F.concat(F.lit("d"), (F.col("user_id") % 3).cast("string")))


def event_reports(spark, d):
    """Day, week and month reports, of all and by department and type."""
    e = read(spark, d, "events")
    return ev.reports(e, departments(e)).withColumn("total", F.round("total", 4))


EVENT_REPORTS_SQL = """
WITH e AS (SELECT user_id, event_type, value, CASE WHEN user_id % 10 != 9 THEN 'd' || (user_id % 3) END AS department, CAST(ts AS DATE) AS day, CAST(date_trunc('week', ts) AS DATE) AS week, CAST(date_trunc('month', ts) AS DATE) AS month FROM events),
g AS (SELECT day, week, month, department, event_type, grouping(day) AS gd, grouping(week) AS gw, grouping(department) AS gg, grouping(event_type) AS gt, count(*) AS n_events, count(DISTINCT user_id) AS n_users, round(sum(value), 4) AS total
  FROM e GROUP BY GROUPING SETS ((day), (week), (month), (day, department), (week, department), (month, department), (day, event_type), (week, event_type), (month, event_type), (day, department, event_type), (week, department, event_type), (month, department, event_type)))
SELECT CASE WHEN gd = 0 THEN 'day' WHEN gw = 0 THEN 'week' ELSE 'month' END AS period, coalesce(day, week, month) AS start, department, event_type, gg = 0 AS of_group, gt = 0 AS of_type, n_events, n_users, total FROM g
"""


def risk_sessions(spark, d):
    """Users' sessions of three events or more that follow each other within six hours."""
    return ev.risk_sessions(read(spark, d, "events"), "6 hours", 3)


RISK_SESSIONS_SQL = """
WITH a AS (SELECT user_id, ts, value, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOURS THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM a)
SELECT user_id, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n_events, max(value) AS highest FROM s GROUP BY user_id, k HAVING count(*) >= 3
"""


def event_ranking(spark, d):
    return ev.ranking(read(spark, d, "events"), "user_id")


def group_compare(spark, d):
    """Departments by user: a third of the users each, and some users without one."""
    e = read(spark, d, "events")
    return ev.compare(e, departments(e), "user_id", "department")


def guarded_sql(spark, d):
    """A user's SELECT over the events that they may see, with masked ids."""
    sql = "SELECT user_id, count(*) AS n_events FROM events WHERE event_type IN ('click', 'view') GROUP BY user_id ORDER BY n_events DESC, user_id LIMIT 20"
    return guarded(spark, sql, {"events": read(spark, d, "events").select("user_id", "event_type", "value")}, masked=("value",), where={"events": "user_id % 2 = 0"})


def zip_scan(spark, d):
    """Pages as members of archives, extracted and scanned."""

    def pack(batches):
        import pyarrow as pa

        for b in (some for batch in batches for some in pieces(batch)):
            out = []
            for i, html in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                data = io.BytesIO()
                with zipfile.ZipFile(data, "w") as z:
                    z.writestr("page.html", html or "")
                    z.writestr("../evil.txt", "never read")
                out.append((f"{i}.zip", data.getvalue()))
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.binary())], ["path", "content"])

    files = read(spark, d, "pages").select("page_id", "html").mapInArrow(pack, "path string, content binary")
    return match.content_scan(extract.texts(files), "path")


def zip_sql() -> str:
    return "SELECT id || '.zip!page.html' AS path, rule_name, risk_level, match_count FROM (" + content_sql() + ") WHERE origin = 'pages'"


LABELLED = [("s1", ["secrets", "licenses"], "e1"), ("s0", ["licenses"], "e0")]
SCAN_RULES = [
    *({"rule_id": f"builtin_{n}", "rule_type": "regex", "sensitive_type": n, "risk_level": r, "content": {"name": n, "pattern": p}} for n, p, r in BUILTIN_RULES),
    {"rule_id": "k", "rule_type": "keyword", "sensitive_type": "words", "risk_level": "medium", "content": {"keywords": KEYWORDS, "min_hits": 3}},
    {"rule_id": "c", "rule_type": "combined", "sensitive_type": "both", "risk_level": "high", "content": {"logic": "AND", "conditions": [{"type": "keyword", "value": COMBINED[0][1], "min_hits": 1}, {"type": "regex", "value": COMBINED[1][1]}]}},
]
TEMPLATES_HERE = (("license terms", ["license", "under", "token"], 2, COMBINED[1][1], "high", ["license", "token"]),)


def scan_library(spark, d):
    prints = read(spark, d, "benchmark").where("text IS NOT NULL").select(F.concat(F.lit("b"), "item_id").alias("sensitive_file_id"), F.sha2("text", 256).alias("sha256"), hashing.simhash("text").alias("simhash"))
    labels = spark.createDataFrame(LABELLED, "sensitive_file_id string, semantic_labels array<string>, embedding_id string")
    return scanning.Library(SCAN_RULES, prints, labels, hints=HINTS)


def library_scan(spark, d):
    """The whole scan of documents against the benchmark's fingerprints, rules of all kinds and labels."""
    docs = read(spark, d, "documents").select(F.col("doc_id").cast("string").alias("path"), "text")
    return scanning.scan_texts(docs, scan_library(spark, d)).drop("match_detail")


def library_scan_sql(path: str = "CAST(doc_id AS VARCHAR)", known: str = "true") -> str:
    count = lambda words: " + ".join(f"CASE WHEN contains(t, '{w}') THEN 1 ELSE 0 END" for w in words)
    rx = lambda n, p: f"len(list_filter(regexp_extract_all(t, '{p}'), lambda m: {LUHN})) > 0" if n == "bank_card" else f"regexp_matches(t, '{p}')"
    label = lambda name: "(" + " OR ".join(f"contains(t, '{w}')" for w in [*HINTS[name], name]) + ")"
    first = " ".join(f"WHEN {rx(n, p)} THEN '{n}'" for n, p, _ in BUILTIN_RULES)
    sims = SIMHASH_SQL.replace("doc_id", "item_id").replace("documents", "benchmark")
    grade = "".join(f" + CASE WHEN {rx(n, p)} THEN {30 if r in ('high', 'critical') else 15} ELSE 0 END" for n, p, r in BUILTIN_RULES)
    return f"""
WITH ids AS (SELECT sha256(text) AS h, min('b' || item_id) AS sha_id FROM benchmark WHERE text IS NOT NULL GROUP BY 1),
d AS (SELECT doc_id, coalesce(text, '') AS t, sha256(text) AS file_hash, sha_id FROM documents LEFT JOIN ids ON sha256(text) = h AND {known}),
sd AS (SELECT doc_id, CAST('0x' || simhash AS UBIGINT) AS b FROM ({SIMHASH_SQL})), sb AS (SELECT item_id, CAST('0x' || simhash AS UBIGINT) AS b FROM ({sims})),
near AS (SELECT doc_id, arg_min('b' || item_id, (bit_count(CAST(xor(sd.b, sb.b) AS BIT)), 'b' || item_id)) AS near_id FROM sd JOIN sb ON bit_count(CAST(xor(sd.b, sb.b) AS BIT)) <= 3 GROUP BY doc_id),
m AS (SELECT doc_id, t, file_hash, sha_id, CASE WHEN sha_id IS NULL AND t != '' THEN near_id END AS near_id, ({count(KEYWORDS)}) >= 3 AS k, ({count(COMBINED[0][1])}) >= 1 AND regexp_matches(t, '{COMBINED[1][1]}') AS c, {label("secrets")} AS ls, {label("licenses")} AS ll FROM d LEFT JOIN near USING (doc_id)),
s AS (SELECT *, CASE WHEN sha_id IS NOT NULL THEN 100 ELSE least(100, (CASE WHEN near_id IS NOT NULL THEN 70 ELSE 0 END){grade} + (CASE WHEN k THEN 30 ELSE 0 END) + (CASE WHEN c THEN 50 ELSE 0 END) + least(30, (CASE WHEN ls THEN 20 ELSE 0 END) + (CASE WHEN ll THEN 40 ELSE 0 END))) END AS n FROM m)
SELECT {path} AS path, file_hash, n >= 80 AS sensitive, CASE WHEN sha_id IS NOT NULL THEN '{fixed.SAMPLE_HIT}' WHEN k THEN 'words' WHEN c THEN 'both' {first} WHEN ll THEN 'licenses' WHEN ls THEN 'secrets' END AS sensitive_type,
  CASE WHEN n >= 80 THEN 'high' WHEN n >= 50 THEN 'medium' WHEN n >= 30 THEN 'low' ELSE 'info' END AS risk_level, coalesce(sha_id, near_id, CASE WHEN ll THEN 's0' WHEN ls THEN 's1' END) AS sensitive_file_id, CAST(n AS INT) AS match_score,
  CASE WHEN n >= 80 THEN 'sensitive' WHEN n >= 50 THEN 'suspected' WHEN n >= 30 THEN 'low_confidence' ELSE 'clean' END AS confidence_level FROM s"""


def reported(spark, d):
    """The scan's results as those of seven reports, dealt by document."""
    report = F.concat(F.lit("r"), (F.col("path").cast("long") % 7).cast("string"))
    return library_scan(spark, d).select(F.col("path").cast("long").alias("id"), report.alias("report_id"), F.col("match_score").alias("score"), "confidence_level")


REPORTED_SQL = f"SELECT CAST(path AS BIGINT) AS id, 'r' || (CAST(path AS BIGINT) % 7) AS report_id, match_score AS score, confidence_level FROM ({library_scan_sql()})"


def confidence_hist(spark, d):
    return search.confidence_hist(reported(spark, d))


def list_results(spark, d):
    reports = spark.createDataFrame([(f"r{i}", f"host-{i % 2}", 100 - i) for i in range(7)], "report_id string, host_id string, created_at long")
    return search.list_results(reported(spark, d), reports, host="host-0", level="low_confidence", limit=5000)


def scan_summary(spark, d):
    return scanning.summary(library_scan(spark, d))


def rule_generate(spark, d):
    """Rules from documents as samples: their source is the type, their language the description."""
    docs = scanning.spread(read(spark, d, "documents")).select("doc_id", "text", F.col("source").alias("sensitive_type"), F.when(F.col("doc_id") % 2 == 0, "low").otherwise("").alias("risk_level"), F.col("lang").alias("description"))
    made = generate.rules(docs, "doc_id", terms=TERMS, stop_words=STOPS, templates=TEMPLATES_HERE)
    words = F.array_join(F.from_json("content", "keywords array<string>").keywords, ",")
    return made.select("doc_id", "place", "rule_name", "rule_type", "sensitive_type", "risk_level", F.when(F.col("rule_type") == "keyword", words).alias("words"))


def rule_generate_sql() -> str:
    k = "coalesce(nullif(source, ''), '{}')".format(fixed.UNCLASSIFIED)
    order = "['info', 'low', 'medium', 'high', 'critical']"
    higher = lambda r: f"CASE WHEN list_position({order}, '{r}') > list_position({order}, risk) THEN '{r}' ELSE risk END"
    rx = lambda n, p: f"len(list_filter(regexp_extract_all(t, '{p}'), lambda m: {LUHN})) > 0" if n == "bank_card" else f"regexp_matches(t, '{p}')"
    parts = [f"SELECT doc_id, {i} AS place, '{n}' AS rule_name, 'regex' AS rule_type, k AS sensitive_type, {higher(r)} AS risk_level, NULL::VARCHAR AS words FROM d WHERE {rx(n, p)}" for i, (n, p, r) in enumerate(BUILTIN_RULES)]
    for i, (n, _, _, _, r, triggers) in enumerate(TEMPLATES_HERE):
        seen = " OR ".join(f"contains({c}, '{w}')" for w in triggers for c in ("t", "ds", "k"))
        parts.append(f"SELECT doc_id, {len(BUILTIN_RULES) + 1 + i}, '{n}', 'combined', k, {higher(r)}, NULL FROM d WHERE {seen}")
    parts.append(f"SELECT doc_id, {len(BUILTIN_RULES)}, k || '{fixed.KEYWORD_RULE}', 'keyword', k, risk, words FROM d JOIN best USING (doc_id)")
    return f"""
WITH {keyword_sql(k)},
best AS (SELECT doc_id, string_agg(word, ',' ORDER BY place) AS words FROM placed WHERE place <= 12 GROUP BY doc_id)
{" UNION ALL ".join(parts)}"""


LABELS_HERE = {"运维账号": ["TOKEN", "password"], "保密协议": ["LICENSE"]}


def label_analysis(spark, d):
    a = generate.analyse(F.col("text"), F.lit(""), F.lit(""), LABELS_HERE)
    return read(spark, d, "documents").select("doc_id", a.alias("a")).select("doc_id", F.array_join("a.semantic_labels", "/").alias("labels"), "a.sensitive_type", "a.risk_level", "a.model_name")


def query_file(spark, d):
    """Three lookups: by hash, by a part of a name, by a path; the documents' sources serve as names."""
    docs = as_samples(spark, d).withColumn("risk_level", F.lit("low"))
    one = lambda n, **q: search.query_file(docs, "sensitive_file_id", **q).withColumn("n", F.lit(n))
    return one(1, file_hash="0" * 64).unionByName(one(2, file_name="-7.txt")).unionByName(one(3, file_path="/a/b/-12.txt"))


def embedding_ids(spark, d):
    return read(spark, d, "documents").select("doc_id", generate.embedding_id(F.lit("model-a"), F.coalesce("text", F.lit(""))).alias("embedding_id"), F.length(F.substring("text", 1, 4000)).alias("n_sent"))


def clean_text(spark, d):
    text = extract.clean(F.col("html"))
    return read(spark, d, "pages").select("page_id", F.sha2(text, 256).alias("sha256"), F.length(text).alias("n_chars"))


def rule_apply(spark, d):
    """A host's copy as of version 20, after the store has changed and the host synced."""
    rules = rules_of(spark, d)
    live, deleted, _ = library.sync(library.change(rules, changes_of(spark, d)), 20)
    cache = rules.where("version <= 20").withColumn("risk_level", F.lit("old"))
    return library.apply(cache, live, deleted, False).select("rule_id", "risk_level", "version")


def file_scan(spark, d):
    """Documents as files, scanned: plain text, UTF-16, archives and archives in archives."""

    def pack(batches):
        import pyarrow as pa

        def zipped(name: str, data: bytes) -> bytes:
            out = io.BytesIO()
            with zipfile.ZipFile(out, "w") as z:
                z.writestr(name, data)
            return out.getvalue()

        for b in (some for batch in batches for some in pieces(batch)):
            rows = []
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                t, kind = text or "", i % 4
                data = t.encode("utf-16" if kind == 1 else "utf-8")
                if kind == 3:
                    data = zipped("in.zip", zipped("d.txt", data))
                elif kind == 2:
                    data = zipped("d.txt", data)
                rows.append((f"{i}.{'zip' if kind > 1 else 'txt'}", data))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.binary())], ["path", "content"])

    files = scanning.spread(read(spark, d, "documents").select("doc_id", "text")).mapInArrow(pack, "path string, content binary")
    return scanning.scan_files(files, scan_library(spark, d)).drop("match_detail", "file_hash")


def file_scan_sql() -> str:
    path = "doc_id || CASE doc_id % 4 WHEN 2 THEN '.zip!d.txt' WHEN 3 THEN '.zip!in.zip!d.txt' ELSE '.txt' END"
    return f"SELECT * EXCLUDE (file_hash) FROM ({library_scan_sql(path, 'doc_id % 4 != 1')})"


def guarded_joins(spark, d):
    """A user's SELECT with common tables, a subquery and a join, over the columns and rows that they may see."""
    sql = """WITH seen AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY user_id, event_type), most AS (SELECT user_id, max(n) AS n FROM seen GROUP BY user_id)
SELECT s.user_id, s.event_type, s.n AS n_events, d.lang FROM seen s JOIN most m ON m.user_id = s.user_id AND m.n = s.n LEFT JOIN documents d ON d.doc_id = s.user_id WHERE s.user_id IN (SELECT user_id FROM events WHERE event_type = 'click')"""
    tables = {"events": read(spark, d, "events"), "documents": read(spark, d, "documents")}
    return guarded(spark, sql, tables, limit=1_000_000, masked=("lang",), where={"events": "user_id % 2 = 0", "documents": "source != 'src0'"}, columns={"events": ("user_id", "event_type"), "documents": ("doc_id", "lang")})


GUARDED_JOINS_SQL = """
WITH seen AS (SELECT user_id, event_type, count(*) AS n FROM events WHERE user_id % 2 = 0 GROUP BY ALL), most AS (SELECT user_id, max(n) AS n FROM seen GROUP BY user_id)
SELECT s.user_id, s.event_type, s.n AS n_events, CASE WHEN length(lang) > 2 THEN lang[1] || '***' || lang[-1] WHEN lang IS NOT NULL THEN '***' END AS lang FROM seen s JOIN most m ON m.user_id = s.user_id AND m.n = s.n
LEFT JOIN documents ON doc_id = s.user_id AND source != 'src0' WHERE s.user_id IN (SELECT user_id FROM events WHERE event_type = 'click')
"""


QUERIES = {
    f.__name__: f
    for f in (
        content_scan, regex_test, simhash, near_duplicates, sha_match, duplicates, fingerprint, keyword_match, library_words, combined_match, semantic_labels, library_scan, file_scan, confidence_hist, list_results, scan_summary, file_labels, keyword_extract, segmentation,
        rule_sync, rule_delete, rule_apply, rule_seed, tag_upsert, list_tags, semantic_search, semantic_search_all, feature_search, list_samples, find_samples, indexed_samples, lookup_hash, query_file, upload_check,
        event_merge, event_alerts, event_filter, event_allow, event_reports, risk_sessions, event_ranking, group_compare, top_users, trend, guarded_sql, guarded_joins, zip_scan, rule_generate, template_rules, label_analysis, embedding_ids, clean_text,
    )
}

_hits = "list_filter([" + ", ".join(f"'{w}'" for w in KEYWORDS) + "], lambda w: contains(text, w))"
_cond = "(" + " OR ".join(f"contains(coalesce(text, ''), '{w}')" for w in COMBINED[0][1]) + ")", f"regexp_matches(coalesce(text, ''), '{COMBINED[1][1]}')"
ORACLES = {
    "content_scan": content_sql(),
    "regex_test": r"SELECT conv_id, turn, CAST(len(regexp_extract_all(text, '\b[A-Z][a-z]+\b')) AS INT) AS n_matches, array_to_string(regexp_extract_all(text, '\b[A-Z][a-z]+\b'), ',') AS matches, CAST(NULL AS VARCHAR) AS error FROM conversations",
    "simhash": SIMHASH_SQL,
    "near_duplicates": NEAR_SQL,
    "sha_match": "SELECT doc_id, sha256(text) AS sha256, min(doc_id) OVER (PARTITION BY sha256(text)) AS sample_id FROM documents WHERE text IS NOT NULL",
    "duplicates": "SELECT doc_id, h AS sha256, f AS first_id FROM (SELECT doc_id, sha256(text) AS h, row_number() OVER w AS n, first(doc_id) OVER w AS f FROM documents WHERE text IS NOT NULL WINDOW w AS (PARTITION BY sha256(text) ORDER BY doc_id)) WHERE n > 1",
    "fingerprint": f"SELECT item_id, sha256(text) AS sha256, simhash, CAST(octet_length(encode(text)) AS INT) AS text_length FROM benchmark JOIN ({SIMHASH_SQL.replace('doc_id', 'item_id').replace('documents', 'benchmark')}) USING (item_id)",
    "keyword_match": f"SELECT doc_id, CAST(len({_hits}) AS INT) AS n_hits, array_to_string({_hits}, ',') AS hits FROM documents WHERE len({_hits}) >= 2",
    "library_words": LIBRARY_WORDS_SQL,
    "combined_match": f"SELECT doc_id, {_cond[0]} AND {_cond[1]} AS \"both\", {_cond[0]} OR {_cond[1]} AS either FROM documents",
    "semantic_labels": "SELECT doc_id, concat_ws('/', CASE WHEN contains(lower(text), 'token') OR contains(lower(text), 'password') OR contains(lower(text), 'secrets') THEN 'secrets' END, CASE WHEN contains(lower(text), 'license') THEN 'licenses' END, CASE WHEN contains(lower(text), 'cc-by') OR contains(lower(text), 'code') THEN 'code' END) AS labels FROM documents",
    "confidence_hist": f"SELECT report_id, confidence_level, count(*) AS n_results FROM ({REPORTED_SQL}) GROUP BY ALL",
    "list_results": f"SELECT id, report_id, score, confidence_level, 'host-0' AS host_id, 100 - CAST(substr(report_id, 2) AS BIGINT) AS created_at FROM ({REPORTED_SQL}) WHERE confidence_level != 'clean' AND CAST(substr(report_id, 2) AS INT) % 2 = 0 ORDER BY created_at DESC, id LIMIT 200",
    "keyword_extract": KEYWORD_SQL,
    "rule_sync": f"WITH r AS ({RULES_SQL}) SELECT rule_id, CASE WHEN enabled AND NOT deleted THEN 'live' ELSE 'deleted' END AS state, (SELECT max(version) FROM r) AS version FROM r WHERE (source = 'builtin' OR version > 20) AND ((enabled AND NOT deleted) OR version > 20)",
    "rule_delete": f"WITH {CHANGED_SQL} SELECT rule_id, version, enabled, deleted, risk_level FROM changed",
    "tag_upsert": "SELECT source AS file_path, sha256(text) AS file_hash, min(doc_id) AS first_detected_at, max(doc_id) + 100 AS last_detected_at, 20 AS match_score FROM documents GROUP BY ALL",
    "semantic_search": "WITH q AS (SELECT CAST(embedding AS DOUBLE[]) AS e FROM embeddings ORDER BY vec_id LIMIT 1), s AS (SELECT vec_id, list_cosine_similarity(CAST(embedding AS DOUBLE[]), e) AS score FROM embeddings, q) SELECT vec_id, round(score, 6) AS score FROM s WHERE score >= 0 ORDER BY score DESC, vec_id LIMIT 5",
    "semantic_search_all": "WITH q AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id % 20 = 0), s AS (SELECT query_id, vec_id, list_cosine_similarity(CAST(embedding AS DOUBLE[]), e) AS score FROM embeddings, q) SELECT query_id, vec_id, round(score, 6) AS score FROM s WHERE score >= 0 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5",
    "list_samples": f"SELECT * EXCLUDE (text) FROM ({SAMPLES_SQL}) ORDER BY uploaded_at DESC, sensitive_file_id LIMIT 50",
    "find_samples": f"SELECT * EXCLUDE (text) FROM ({SAMPLES_SQL}) WHERE (contains(lower(text), 'licensed under') OR contains(lower(file_name), 'licensed under')) AND contains(lower(sensitive_type), 'e') AND risk_level = 'low' ORDER BY uploaded_at DESC, sensitive_file_id LIMIT 100",
    "indexed_samples": f"WITH s AS ({SAMPLES_SQL}) SELECT * FROM (SELECT sensitive_file_id, 'text' AS by FROM s WHERE (contains(lower(text), 'licensed under') OR contains(lower(file_name), 'licensed under')) AND contains(lower(sensitive_type), 'e') AND risk_level = 'low' ORDER BY uploaded_at DESC, sensitive_file_id LIMIT 100) UNION ALL SELECT min(sensitive_file_id), 'name' FROM s WHERE contains(lower(file_name), '-17.t') UNION ALL SELECT sensitive_file_id, 'short' FROM s WHERE contains(lower(text), 'é') OR contains(lower(file_name), 'é')",
    "lookup_hash": f"WITH s AS ({SAMPLES_SQL}) SELECT sensitive_file_id, file_name, sha256 FROM s WHERE sha256 = (SELECT arg_min(sha256, sensitive_file_id) FROM s WHERE sha256 IS NOT NULL) ORDER BY sensitive_file_id LIMIT 1",
    "list_tags": "SELECT source || '/' || doc_id AS file_path, CAST(doc_id % 7 AS INT) AS match_score, true AS sensitive FROM documents WHERE doc_id % 3 = 0",
    "rule_seed": f"SELECT rule_id, CASE WHEN version = 30 AND NOT (source = 'builtin' AND rule_type = 'regex') THEN 'critical' ELSE risk_level END AS risk_level, enabled FROM ({RULES_SQL})",
    "upload_check": "SELECT doc_id, CASE WHEN doc_id % 8 IN (1, 2, 3, 4, 6, 7) THEN 'bad_name' WHEN coalesce(length(text), 0) = 0 THEN 'empty' WHEN length(text) > 3000 THEN 'too_large' END AS reason, CASE doc_id % 8 WHEN 0 THEN 'high' WHEN 1 THEN 'low' WHEN 4 THEN 'critical' WHEN 5 THEN 'info' ELSE 'medium' END AS risk_level FROM documents",
    "template_rules": template_sql(),
    "feature_search": f"WITH q AS (SELECT CAST(embedding AS DOUBLE[]) AS e FROM embeddings ORDER BY vec_id LIMIT 1), s AS (SELECT vec_id, list_cosine_similarity(CAST(embedding AS DOUBLE[]), e) AS score FROM embeddings, q WHERE vec_id % 5 != 1 AND vec_id % 7 != 2), t AS (SELECT vec_id, score FROM s WHERE score >= 0.1 ORDER BY score DESC, vec_id LIMIT 10) SELECT vec_id, round(score, 6) AS score, file_name, sensitive_type, risk_level FROM t LEFT JOIN ({SAMPLES_SQL}) ON sensitive_file_id = vec_id",
    "file_labels": "WITH l AS (SELECT CAST(doc_id AS VARCHAR) AS path, contains(t, 'token') OR contains(t, 'password') OR contains(t, 'secrets') AS s, contains(t, 'License') OR contains(t, 'license') OR contains(t, 'licenses') AS l FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)) SELECT path, 's1' AS sensitive_file_id, 'secrets' AS semantic_label, CAST(1 AS BIGINT) AS n_samples FROM l WHERE s UNION ALL SELECT path, 's0', 'licenses', 2 FROM l WHERE l",
    "event_alerts": EVENT_ALERTS_SQL,
    "event_allow": EVENT_ALLOW_SQL,
    "event_reports": EVENT_REPORTS_SQL,
    "risk_sessions": RISK_SESSIONS_SQL,
    "event_ranking": "SELECT user_id, n_events, CAST(rank() OVER (ORDER BY n_events DESC) AS INT) AS place FROM (SELECT user_id, count(*) AS n_events FROM events GROUP BY user_id)",
    "group_compare": "WITH g AS (SELECT DISTINCT user_id, 'd' || (user_id % 3) AS department FROM events WHERE user_id % 10 != 9), m AS (SELECT department, count(*) AS n_members FROM g GROUP BY ALL) SELECT department, event_type, n_events, n_members, round(n_events / n_members, 6) AS per_member FROM (SELECT department, event_type, count(*) AS n_events FROM events LEFT JOIN g USING (user_id) GROUP BY ALL) LEFT JOIN m USING (department)",
    "guarded_sql": "SELECT user_id, count(*) AS n_events FROM events WHERE event_type IN ('click', 'view') AND user_id % 2 = 0 GROUP BY user_id ORDER BY n_events DESC, user_id LIMIT 20",
    "guarded_joins": GUARDED_JOINS_SQL,
    "zip_scan": zip_sql(),
    "event_merge": "SELECT user_id, event_type, time_bucket(INTERVAL '1 minute', ts) AS window_start, count(*) AS n_events, min(ts) AS first_ts, max(ts) AS last_ts, round(sum(value), 4) AS total FROM events GROUP BY ALL",
    "top_users": "SELECT user_id, count(*) AS n_events FROM events WHERE event_type = 'click' GROUP BY user_id ORDER BY n_events DESC, user_id LIMIT 10",
    "trend": "SELECT day, event_type, n AS n_events, round(n / sum(n) OVER (PARTITION BY day), 6) AS share FROM (SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n FROM events GROUP BY ALL)",
    "event_filter": "SELECT user_id, event_type, event_id, CASE WHEN user_id = 1 AND event_type = 'click' THEN 'info' ELSE 'high' END AS level, CASE WHEN user_id = 1 AND event_type = 'click' THEN 'known' END AS reason, CASE WHEN user_id = 1 AND event_type = 'click' THEN 'high' END AS old_level FROM events WHERE event_type != 'view'",
    "library_scan": library_scan_sql(),
    "scan_summary": f"SELECT count(*) AS total, count(*) FILTER (confidence_level = 'sensitive') AS sensitive, count(*) FILTER (confidence_level = 'suspected') AS suspected, count(*) FILTER (confidence_level = 'low_confidence') AS low_confidence FROM ({library_scan_sql()})",
    "rule_generate": rule_generate_sql(),
    "label_analysis": f"SELECT doc_id, CASE WHEN l = '' THEN '{fixed.UNCLASSIFIED}' ELSE l END AS labels, CASE WHEN l = '' THEN '{fixed.UNCLASSIFIED}' ELSE l END AS sensitive_type, CASE WHEN contains(l, '运维账号') THEN 'high' WHEN l != '' THEN 'medium' ELSE 'low' END AS risk_level, 'rule-fallback' AS model_name FROM (SELECT doc_id, concat_ws('/', CASE WHEN contains(lower(text), 'token') OR contains(lower(text), 'password') THEN '运维账号' END, CASE WHEN contains(lower(text), 'license') THEN '保密协议' END) AS l FROM documents)",
    "query_file": """WITH d AS (SELECT doc_id, sha256(text) AS sha256, source || '-' || doc_id || '.TXT' AS file_name, lang AS sensitive_type FROM documents),
q(n, how, x) AS (VALUES (1, 'sha256', repeat('0', 64)), (2, 'filename_like', '-7.txt'), (3, 'filepath_basename_like', '-12.txt')),
f AS (SELECT n, how, min(doc_id) AS i FROM q LEFT JOIN d ON CASE WHEN n = 1 THEN sha256 = x ELSE contains(lower(file_name), x) END GROUP BY ALL)
SELECT n, i IS NOT NULL AS sensitive, CASE WHEN i IS NOT NULL THEN how END AS match_type, i AS sensitive_file_id, file_name, sensitive_type, CASE WHEN i IS NOT NULL THEN 'low' END AS risk_level FROM f LEFT JOIN d ON doc_id = i""",
    "embedding_ids": "SELECT doc_id, 'emb_' || substr(sha256('model-a' || chr(0) || coalesce(text, '')), 1, 16) AS embedding_id, CAST(length(substr(text, 1, 4000)) AS INT) AS n_sent FROM documents",
    "clean_text": r"SELECT page_id, sha256(t) AS sha256, CAST(length(t) AS INT) AS n_chars FROM (SELECT page_id, trim(regexp_replace(replace(html, chr(0), ' '), '\s+', ' ', 'g')) AS t FROM pages)",
    "rule_apply": f"""WITH {CHANGED_SQL}, s AS (SELECT *, (source = 'builtin' OR version > 20) AND enabled AND NOT deleted AS live, (NOT enabled OR deleted) AND version > 20 AS gone FROM changed)
SELECT rule_id, CASE WHEN live THEN s.risk_level ELSE 'old' END AS risk_level, CASE WHEN live THEN s.version ELSE r.version END AS version FROM s JOIN r USING (rule_id) WHERE live OR (r.version <= 20 AND NOT gone)""",
    "file_scan": file_scan_sql(),
}
