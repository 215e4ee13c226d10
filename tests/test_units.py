"""Operators on small inputs: dialects, hashes, scores, archives, library and events."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from siftmark.functions import dialect, hashing
from siftmark.functions.fixed import BUILTIN_RULES, LABEL_HINTS
from siftmark.operators import library, match, search
from siftmark.sources import extract
from siftmark.streaming import events

PATTERN = {n: p for n, p, _ in BUILTIN_RULES}


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "text, rule, want",
    [
        ("联系人手机号13800138000，…", "mobile_phone", ["13800138000"]),
        ("18位12345678901234567X。", "id_card", ["12345678901234567X"]),
        ("社保号号号123456789012号", "social_security", ["社保号号号123456789012"]),
        ("10.1.2.3号 192.168.0.1x", "private_ip", ["10.1.2.3"]),
        ("tax\r号 ABCDEFGHIJ12345", "tax_number", ["tax\r号 ABCDEFGHIJ12345"]),
        ("-foo.com a-foo.com _x.example.com 号-bar.cn", "domain", ["foo.com", "a-foo.com", "example.com", "bar.cn"]),
        ("paſſword = hunter2222", "password", ["paſſword = hunter2222"]),
        ("Key secret=ſabcdefghijklmnopq", "api_key", ["secret=ſabcdefghijklmnopq"]),
        ("api_key\x0b= abcdefghijklmnopqrst", "api_key", []),
    ],
)
def test_re2_dialect(spark, text, rule, want):
    assert one(spark, match.matches(F.lit(text), PATTERN[rule])) == want


def test_python_dialect_and_bad_patterns(spark):
    assert one(spark, match.matches(F.lit("手机号13800138000"), PATTERN["mobile_phone"], "python")) == []
    assert list(dialect.check(spark, ["(a", "b+"])) == ["(a"]


RE2_FORMS = [
    r"[[:digit:]]+", r"[[:^alpha:]]+", r"[^[:space:]]+", r"(?P<k>a+)b", r"\S+", r"[^\s]+", r"\w+\b", r"\bfoo\b", r"a{,3}", r"[a&&b]+", r"[\]\[x]+", r"x$", r"(?m)x$", r"\D+", r"\pL+", r"\p{Greek}+", r"(?i)straße", r"a*?b",
    r"(?s)a.b", r"\Qa.b\E", r"[^\d\w]+", r"\B.", r"\x{4e2d}", r"(?:a|b)+?c", r"[-a]+", r"\v", r"[\w-]+", r"\b[\w.-]+\b", r"\by", r"1\b", *PATTERN.values(),
]
FORM_TEXTS = [
    "id 12345 digit", "aab foo, foo_bar 中foo中", "x\nx", "x\n", "a{,3} aaa a&&b b", "[x] ]", "αβγ Ω", "STRASSE straße", "a\nb a.b", "手机号13800138000 1380013800 \x0b v-w.", "tab\tand\x0bvt\xa0nbsp",
    "4111111111111111, 10.1.2.3 -foo.com", "y1 1y 1 y", "contract no: ABC_123-9, tax ABCDEFGHIJ12345",
]


def test_dialects_against_their_engines(spark):
    """DuckDB runs RE2; the other is Python's own."""
    import re

    import duckdb

    compile_, db = spark._jvm.java.util.regex.Pattern.compile, duckdb.connect()

    def java(pattern, text, name):
        m, out = compile_(dialect.to_java(pattern, name)).matcher(text), []
        while m.find():
            out.append(m.group())
        return out

    for p in RE2_FORMS:
        for t in FORM_TEXTS:
            try:
                want = db.execute("SELECT regexp_extract_all(?, ?)", [t, p]).fetchone()[0]
            except duckdb.Error:
                with pytest.raises(dialect.Refused):
                    dialect.to_java(p)
                continue
            assert java(p, t, "re2") == want, (p, t)
            try:
                own = [m[0] for m in re.finditer(p, t)]
            except re.error:
                continue
            assert java(p, t, "python") == own, (p, t)


@pytest.mark.parametrize("pattern", [r"(?=a)", r"(?<!a)b", r"(a)\1", r"a**", r"[[:nope:]]", r"a{1,2000}", r"(?U)a", r"\h"])
def test_forms_that_re2_refuses(spark, pattern):
    with pytest.raises(dialect.Refused):
        dialect.to_java(pattern)
    assert pattern in dialect.check(spark, [pattern])
    assert one(spark, match.regex_test(F.lit("aab"), pattern)).error


def test_regex_test(spark):
    got = one(spark, match.regex_test(F.lit("a1 b22"), r"[a-z]\d+"))
    assert (got.matches, got["count"], got.error) == (["a1", "b22"], 2, None)


def test_simhash_tokens_are_letters_and_decimal_digits(spark):
    assert hashing.TOKEN.findall("½ Ⅷ x² a1") == ["x", "a1"] and one(spark, hashing.simhash(F.lit("½ Ⅷ"))) == "0" * 16
    import random

    r = random.Random(2)
    tokens = [bytes(r.choices(range(256), k=r.choice([1, 3, 9, 64, 65, 200]))) for _ in range(300)]
    assert hashing.fnv1a_all(tokens).tolist() == [hashing.fnv1a(t) for t in tokens]


def test_pdf_needs_a_reader():
    assert extract.extract("a.pdf", b"%PDF-1.4")[1] == "pdf_reader_missing"
    assert extract.extract("a.PDF", b"%PDF-1.4", lambda name, data: "") == ("", "pdf_text_empty", None)
    assert extract.extract("a.pdf", b"%PDF-1.4", lambda name, data: name + "!") == ("a.pdf!", None, None)
    text, reason, error = extract.extract("a.pdf", b"", lambda name, data: 1 / 0)
    assert (text, reason) == ("", "pdf_text_empty") and error.startswith("ZeroDivisionError")


def test_card_checksums(spark):
    assert one(spark, match.matches(F.lit("银行卡号 4111111111111111 流水号 4111111111111112"), PATTERN["bank_card"], card=True)) == ["4111111111111111"]


@pytest.mark.parametrize(
    "text, want",
    [("客户名称：四川示例科技有限公司\n联系人：张三\n报价：50万元", "9fa2c69b562580db"), ("hello world 123", "4579da5e102a8cdb"), ("手机号13800138000 API_KEY abcdefghijklmnop", "ffdd480d060bb877"), ("!?", "0" * 16)],
)
def test_simhash_vectors(spark, text, want):
    assert one(spark, hashing.simhash(F.lit(text))) == want


def test_cosine_and_hamming(spark):
    arr = lambda *v: F.array(*[F.lit(float(x)) for x in v])
    assert one(spark, hashing.cosine(arr(1, 0), arr(1, 0))) == 1
    assert one(spark, hashing.cosine(arr(1, 0), arr(1))) is None
    assert one(spark, hashing.hamming(hashing.simhash_bits(F.lit("f" * 16)), hashing.simhash_bits(F.lit("7" + "f" * 15)))) == 1


def test_near_by_hamming_against_all_pairs(spark):
    import random

    r = random.Random(1)
    base = [r.getrandbits(63) for _ in range(20)]
    rows = [(i, base[i % 20] ^ sum(1 << b for b in r.sample(range(63), r.randrange(0, 4)))) for i in range(150)]
    df = spark.createDataFrame(rows, "doc_id long, bits long")
    got = {x.doc_id: (x.distance, x.sample_id) for x in search.near_by_hamming(df, df.withColumnRenamed("doc_id", "sample_id")).collect()}
    want = {i: min(((a ^ b).bit_count(), j) for j, b in rows if j != i) for i, a in rows}
    assert got == {i: m for i, m in want.items() if m[0] <= 3}


def test_hamming_keys_are_not_broadcast(spark):
    df = spark.range(50).selectExpr("id AS doc_id", "id * 7919 AS bits")  # its size is known, and small
    near = search.near_by_hamming(df, df.withColumnRenamed("doc_id", "sample_id"))
    plan = near._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin [b#" in plan and "BroadcastHashJoin [b#" not in plan


@pytest.mark.parametrize("points, level, risk", [(100, "sensitive", "high"), (80, "sensitive", "high"), (79, "suspected", "medium"), (50, "suspected", "medium"), (49, "low_confidence", "low"), (30, "low_confidence", "low"), (29, "clean", "info")])
def test_verdicts(spark, points, level, risk):
    assert one(spark, match.confidence(F.lit(points))) == level and one(spark, match.risk(F.lit(points))) == risk


def test_scores(spark):
    s = lambda *v: one(spark, match.score(F.lit(v[0]), F.lit(v[1]), *map(F.lit, v[2:])))
    assert s(False, False, 1, 1, 1, 0, 0) == 75 and s(False, True, 0, 0, 0, 0, 0) == 70 and s(True, True, 1, 1, 1, 1, 1) == 100
    assert s(False, False, 0, 0, 0, 0, 2) == 30 and s(False, False, 0, 0, 0, 0, 1) == 20


def test_labels(spark):
    assert set(one(spark, match.label_hits(F.lit("客户联系人名单包含电话和报价金额"), ["客户名单", "报价信息"]))) == {"客户名单", "报价信息"}
    assert one(spark, match.label_hits(F.lit("项目代号蓝鲸"), ["自定义标签"])) == []
    assert one(spark, match.label_hits(F.lit("项目代号蓝鲸"), ["自定义标签"], {"自定义标签": ["蓝鲸"]})) == ["自定义标签"]
    assert "内部培训资料" in one(spark, match.infer_labels(F.lit("内部培训资料包含未公开课件"), LABEL_HINTS))


def test_unknown_logic_never_matches(spark):
    t = F.lit("a b")
    assert not one(spark, match.combined_match(t, [("keyword", ["a"], 1)], "XOR")) and not one(spark, match.combined_match(t, [("other",)]))
    assert one(spark, match.combined_match(t, [("keyword", ["a", "b"], 2), ("regex", "b$")]))


def zipped(**files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for n, x in files.items():
            z.writestr(n.replace("__", "/"), x)
    return out.getvalue()


def test_extraction(spark):
    doc = zipped(**{"word__document.xml": "<w:d xmlns:w='w'><w:p><w:t>Hello</w:t><w:t> you</w:t></w:p><w:p><w:t>two</w:t></w:p></w:d>"})
    sheet = zipped(**{"xl__sharedStrings.xml": "<s xmlns='m'><si><t>name</t></si></s>", "xl__worksheets__sheet1.xml": "<w xmlns='m'><row><c t='s'><v>0</v></c><c><v>5</v></c></row></w>"})
    inner = zipped(**{"docs__customer.txt": "客户名称", "..__secret.txt": "x", "deep.zip": zipped(**{"more.zip": zipped(a="b"), "in.txt": "nested"})})
    rows = [("a.docx", doc), ("b.xlsx", sheet), ("archive.zip", inner), ("slides.pptx", b"x"), ("broken.docx", b"no zip"), ("gb.txt", "客户".encode("gb18030")), ("n.txt", None), ("bad.zip", b"zz"), ("e.pdf", b"\x01\x02")]
    got = {r.path: (r.text, r.skip_reason or r.extract_error) for r in extract.texts(spark.createDataFrame(rows, "path string, content binary")).collect()}
    assert got["a.docx"] == ("Hello you\ntwo", None) and got["b.xlsx"] == ("name 5", None) and got["gb.txt"] == ("客户", None)
    assert got["archive.zip!docs/customer.txt"] == ("客户名称", None) and got["archive.zip!deep.zip!in.txt"] == ("nested", None)
    assert got["slides.pptx"] == ("", "unsupported_format") and "BadZipFile" in got["broken.docx"][1] and "BadZipFile" in got["bad.zip"][1] and (extract.pdf_reader() or got["e.pdf"][1] == "pdf_reader_missing")
    assert len(got) == 10 and got["n.txt"] == ("", None)


def test_library(spark):
    rules = spark.createDataFrame([("builtin_a", "regex", "a", "low", "builtin", 0, True, False), ("r1", "keyword", "x", "low", "sample", 3, True, False)], library.RULE)
    assert library.seed(rules, rules).count() == 2
    changed = library.delete(rules, "r1", 4)
    live, gone, newest = library.sync(changed, 3)
    assert [r.rule_id for r in live.collect()] == ["builtin_a"] and [r.rule_id for r in gone.collect()] == ["r1"] and newest.first()[0] == 4
    assert library.apply(rules, live, gone, False).count() == 1 and library.apply(rules, live, gone, True).count() == 1
    assert [one(spark, library.normal_risk(F.lit(x))) for x in (" HIGH ", "", "odd")] == ["high", "medium", "medium"]


def test_skipped_members_do_not_count():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for i in range(200):
            z.writestr(f"../{i}", "x")
        for i in range(201):
            z.writestr(f"in{i}.txt", "y")
    assert [n for n, _, _ in extract.members("a.zip", out.getvalue())] == [f"a.zip!in{i}.txt" for i in range(200)]


def test_tag_upsert_keeps_the_first_time(spark):
    tags = spark.createDataFrame([("p", "h", 1, 1, 10)], "file_path string, file_hash string, first_detected_at long, last_detected_at long, match_score int")
    assert [tuple(r) for r in library.upsert_tags(tags, tags.selectExpr("file_path", "file_hash", "9L AS first_detected_at", "9L AS last_detected_at", "90 AS match_score")).collect()] == [("p", "h", 1, 9, 90)]


def test_limits(spark):
    v = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(60)], "vec_id long, embedding array<double>")
    assert search.semantic_search(v, [1.0, 0.0], 0).count() == 5 and search.semantic_search(v, [1.0, 0.0], 99).count() == 50
    with pytest.raises(ValueError):
        search.at_least("unknown")


def test_search_of_many_equals_search_of_each(spark):
    rows = [(i, [float(i * 7 % 11 - 5), float(i * 3 % 13 - 6), 1.0]) for i in range(400)] + [(400, [0.0, 0.0, 0.0]), (401, None), (402, [1.0]), (403, [1.0, None, 2.0])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    asked = {i: x for i, x in rows if i % 40 == 0 or i == 402}
    got = search.semantic_search_all(v, v.where("vec_id % 40 = 0 OR vec_id = 402"), 3, 0.2).collect()
    for i, x in asked.items():
        want = [(r.vec_id, round(r.score, 6)) for r in search.semantic_search(v, x, 3, 0.2).collect()]
        assert sorted((r.vec_id, round(r.score, 6)) for r in got if r.query_id == i) == sorted(want)
    assert len({r.query_id for r in got}) == 11  # ten of the first 400 and the short one


def test_a_known_alert_stays_one(spark):
    alerts = spark.createDataFrame([(1, "click", "high"), (2, "view", "low")], "user_id long, event_type string, level string")
    known = spark.createDataFrame([(1, "click", "b"), (1, "click", "a"), (1, "click", None)], "user_id long, event_type string, reason string")
    got = {r.user_id: (r.level, r.old_level, r.reason) for r in events.lower_false_positives(alerts, known, ["user_id", "event_type"]).collect()}
    assert got == {1: ("info", "high", "a"), 2: ("low", None, None)}


def test_guarded_sql(spark):
    from siftmark.operators.guard import Forbidden, guarded

    tables = {"events": spark.createDataFrame([(1, "alice", "x"), (2, "bob", "y")], "id int, user string, dept string")}
    assert [tuple(r) for r in guarded(spark, "SELECT user FROM events ORDER BY id", tables, 1, ("user",)).collect()] == [("a***e",)]
    assert guarded(spark, "WITH e AS (SELECT * FROM events) SELECT * FROM e WHERE id IN (SELECT id FROM events)", tables, where={"events": "dept = 'x'"}).count() == 1
    for sql in ("DROP TABLE events", "INSERT INTO events SELECT 1", "SELECT * FROM other", "SELECT * FROM parquet.`/etc`", "SELECT * FROM events WHERE id IN (SELECT id FROM secret)", "SELECT reflect('java.lang.System', 'exit', 1)", "DELETE FROM events", "SELECT * FROM range(10)", "SET x=1"):
        with pytest.raises(Forbidden):
            guarded(spark, sql, tables)


def test_alerts_as_a_stream_in_append_mode(spark, tmp_path):
    """Repeated events count once, and each window's alert comes once, when it is over."""
    from datetime import datetime, timedelta

    at = datetime(2024, 1, 1)
    rows = [(i, at + timedelta(seconds=10 * i), i % 2, f"/a/f{i % 3}.txt", "h", "high", "upload") for i in range(60)]
    schema = "event_id long, ts timestamp, user_id long, file_path string, file_hash string, risk_level string, operation string"
    src = spark.createDataFrame(rows + rows[:10] + [(999, at + timedelta(hours=2), 0, "/z", "h", "low", "upload")], schema)
    src.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = events.alerts(events.once(spark.readStream.schema(src.schema).parquet(f"{tmp_path}/in")))
    q = stream.writeStream.outputMode("append").format("memory").queryName("whole_alerts").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination()
    batch = events.alerts(events.once(src)).where(F.col("window_start") < F.lit("2024-01-01 01:00:00").cast("timestamp"))
    plain = lambda df: sorted((r.event_id, r.user_id, r.n_events, r.file_count, tuple(r.files), r.risk_level) for r in df.collect())
    assert plain(spark.table("whole_alerts")) == plain(batch) and batch.agg(F.sum("n_events")).first()[0] == 60


def test_event_merge_as_a_stream(spark, sf_dir, tmp_path):
    src = spark.read.parquet(f"{sf_dir}/events.parquet")
    src.coalesce(2).write.parquet(f"{tmp_path}/in")
    stream = events.merge(spark.readStream.schema(src.schema).parquet(f"{tmp_path}/in"))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("alerts").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination()
    got = spark.table("alerts").agg(F.count("*"), F.sum("n_events")).first()
    assert tuple(got) == tuple(events.merge(src).agg(F.count("*"), F.sum("n_events")).first())
